"""DataFrame operators: profile, protect, compare, account, advise."""
