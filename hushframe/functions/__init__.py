"""Column-level building blocks: keyed uniforms, noise laws, sorted search."""
