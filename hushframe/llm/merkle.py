"""A Merkle manifest of a data set: one 16-ary tree per source, one over the sources."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from hushframe.llm.frames import materialize, per_batch

#: Children of a node, and levels of nodes that one builder writes: a page begins at FAN ** PAGE_LEVELS nodes.
FAN = 16
PAGE_LEVELS = 2
PAGE = FAN**PAGE_LEVELS

#: Columns of a leaf's digest, in order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@lru_cache(1 << 16)
def postorder(level: int, index: int, leaves: int) -> int:
    """The place of a node in the order in which nodes are completed, from 0.

    Before a subtree that begins at leaf ``index * FAN**level`` come the ``index`` full
    subtrees of its level and the ancestors these have completed; within it, the node
    is the last. The tree has ``leaves`` leaves; its last subtrees may be short.
    """
    full = (FAN ** (level + 1) - 1) // (FAN - 1)
    before, done = index * full, index // FAN
    while done:
        before, done = before + done, done // FAN
    held, size = min(FAN**level, leaves - index * FAN**level), 0
    for _ in range(level + 1):
        size, held = size + held, -(-held // FAN)
    return before + size - 1


_TOP = 13  # levels of a tree of 2^52 leaves


def _width(level: Column) -> Column:
    """Leaves below a full node."""
    return F.get(F.array(*[F.lit(FAN**k).cast("long") for k in range(_TOP + 1)]), level)


def place(level: Column, index: Column, leaves: Column) -> Column:
    """``postorder`` as a column."""
    full = F.get(F.array(*[F.lit((FAN ** (k + 1) - 1) // (FAN - 1)).cast("long") for k in range(_TOP + 1)]), level)
    held = F.least(_width(level), leaves - index * _width(level))
    before = index * full + sum((F.floor(index / FAN**k) for k in range(1, _TOP)), F.lit(0).cast("long"))
    size = sum((F.when(level >= k, F.ceil(held / FAN**k)).otherwise(0) for k in range(_TOP + 1)), F.lit(0).cast("long"))
    return (before + size - 1).cast("long")


def height(leaves: int) -> int:
    """Levels above the leaves."""
    levels, held = 0, leaves
    while held > 1:
        levels, held = levels + 1, -(-held // FAN)
    return levels


def _digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def build_page(entries: list[str], levels: int) -> list[str]:
    """The nodes over ``entries``, ``levels`` of them, in the order of their completion:
    each entry is appended, and so is every node whose last child it is."""
    log: list[str] = []
    open_: list[list[str]] = [[] for _ in range(levels + 1)]

    def append(level: int, digest: str) -> None:
        log.append(digest)
        if level < levels:
            open_[level].append(digest)
            if len(open_[level]) == FAN:
                close(level)

    def close(level: int) -> None:
        run, open_[level] = open_[level], []
        append(level + 1, _digest("".join(run)))

    for entry in entries:
        append(0, entry)
    for level in range(levels):
        if open_[level]:
            close(level)
    return log


def path(log: list[str], index: int, entries: int, levels: int) -> list[tuple[int, list[str]]]:
    """For each level of a page, from entry ``index`` up: the node's place in its run and its siblings."""
    steps, held = [], entries
    for level in range(levels):
        first = index - index % FAN
        last = min(first + FAN, held)
        steps.append((index - first, [log[postorder(level, k, entries)] for k in range(first, last) if k != index]))
        index, held = index // FAN, -(-held // FAN)
    return steps


def fold(digest: str, steps: list[tuple[int, list[str]]]) -> str:
    """The root that a node's digest and its siblings lead to."""
    for at, siblings in steps:
        digest = _digest("".join([*siblings[:at], digest, *siblings[at:]]))
    return digest


def encoded(fields: dict[str, Column]) -> Column:
    """The bytes a leaf's digest is taken of."""
    parts = []
    for value in fields.values():
        text = value.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return F.concat(*parts)


def leaves(docs: DataFrame, tamper: Column | None = None) -> DataFrame:
    """(tree, doc_id, entry, tampered, salt) of each row: tree is its source, entry the digest of
    its FIELDS, tampered the digest with the text's A-Z lower-cased where ``tamper`` holds, else
    null. Salts spread rows that are equal in all of it."""
    fields = {c: F.col(f"`{c}`") for c in FIELDS}
    # only texts that hold A-Z change
    lowered = F.translate(F.col("text").cast("string"), UPPER, LOWER)
    tampered = F.sha2(encoded(fields | {"text": lowered}).cast("binary"), 256)
    return docs.select(
        F.col("source").cast("string").alias("tree"), F.col("doc_id").cast("long").alias("doc_id"),
        F.sha2(encoded(fields).cast("binary"), 256).alias("entry"),
        (F.when(tamper, tampered) if tamper is not None else F.lit(None).cast("string")).alias("tampered"),
        F.monotonically_increasing_id().alias("salt"),
    )


def _same(a: str, b: str) -> Column:
    return F.col(a).eqNullSafe(F.col(b))


def numbered(entries: DataFrame, order: list[str]) -> DataFrame:
    """Adds ``index``, from 0 within each ``tree`` in the order of ``order``, and ``leaves``, the tree's rows.

    A range partitioning sorts all trees; a row's number is its place in its part and the
    rows of its tree in earlier parts, so no tree is one task's work.
    """
    parted = entries.repartitionByRange("tree", *order).sortWithinPartitions("tree", *order)
    at = F.monotonically_increasing_id()
    low = F.lit((1 << 33) - 1)
    parted = materialize(parted.withColumn("part", F.shiftright(at, 33)).withColumn("at", at.bitwiseAND(low)))
    stretches = parted.groupBy("tree", "part").agg(F.count(F.lit(1)).alias("held"), F.min("at").alias("first"))
    everything = Window.partitionBy("tree")
    earlier = everything.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # one row per tree and part
    bases = stretches.select(
        F.col("tree").alias("_tree"), F.col("part").alias("_part"),
        (F.coalesce(F.sum("held").over(earlier), F.lit(0)) - F.col("first")).alias("base"), F.sum("held").over(everything).alias("leaves"),
    )
    met = parted.join(bases, _same("tree", "_tree") & (F.col("part") == F.col("_part")))
    return met.select(*entries.columns, (F.col("at") + F.col("base")).alias("index"), "leaves")


@dataclass
class Forest:
    """Trees as pages of an append log, round by round from the leaves.

    ``pages`` of a round: tree, page, levels, entries, nodes (digests in the order of
    completion; the last is the page's root). ``roots``: tree, root, leaves.
    """

    pages: list[DataFrame]
    roots: DataFrame


def build(entries: DataFrame) -> Forest:
    """The trees over ``entries`` (tree, index, leaves, entry, ...).

    Builders are aligned: each takes PAGE neighbouring nodes of a tree and appends them and
    the nodes above, PAGE_LEVELS of them or up to the root, to its page of the log. The
    roots of its pages are the next round's entries, a PAGE-th of the rows.
    """
    def write(batch: pa.RecordBatch) -> pa.RecordBatch:
        logs = [build_page(e, n) for e, n in zip(batch["digests"].to_pylist(), batch["levels"].to_pylist())]
        nodes = pa.array(logs, pa.list_(pa.string()))
        return pa.RecordBatch.from_arrays([*[batch[c] for c in ("tree", "page", "leaves", "levels", "digests")], nodes], ["tree", "page", "leaves", "levels", "entries", "nodes"])

    at = entries.select("tree", "index", "leaves", "entry")
    pages, roots = [], None
    while True:
        n = F.col("leaves")
        # levels up to the root, at most those of a page
        height = sum((F.when(n > FAN**k, 1).otherwise(0) for k in range(PAGE_LEVELS)), F.lit(0))
        gathered = at.groupBy("tree", "leaves", F.floor(F.col("index") / PAGE).alias("page")).agg(
            F.sort_array(F.collect_list(F.struct("index", "entry"))).alias("found"),
        ).select("tree", "page", "leaves", height.alias("levels"), F.col("found.entry").alias("digests"))
        schema = "tree string, page long, leaves long, levels int, entries array<string>, nodes array<string>"
        written = materialize(per_batch(gathered, write, schema))
        pages.append(written)
        tops = written.select("tree", F.col("page").alias("index"), F.ceil(F.col("leaves") / PAGE).alias("leaves"), F.element_at("nodes", -1).alias("entry"))
        ended = tops.where("leaves <= 1").select("tree", F.col("entry").alias("root"), F.lit(len(pages)).alias("rounds"))
        roots = ended if roots is None else roots.union(ended)
        at = tops.where("leaves > 1")
        if at.isEmpty():
            return Forest(pages, roots)


STEPS = "array<struct<at:int, siblings:array<string>>>"


def _steps(steps: list[tuple[int, list[str]]]) -> list[dict]:
    return [{"at": at, "siblings": siblings} for at, siblings in steps]


_STEPS_ARROW = pa.list_(pa.struct([("at", pa.int32()), ("siblings", pa.list_(pa.string()))]))


def entry_paths(pages: DataFrame) -> DataFrame:
    """(tree, index, steps) of each entry of ``pages`` with ``above``: its siblings, level by level."""
    def hand(batch: pa.RecordBatch) -> pa.RecordBatch:
        tree, index, steps = [], [], []
        for t, page, levels, entries, nodes, on in zip(*[batch[c].to_pylist() for c in ("tree", "page", "levels", "entries", "nodes", "above")]):
            for k in range(len(entries)):
                tree.append(t)
                index.append(page * PAGE + k)
                steps.append([*_steps(path(nodes, k, len(entries), levels)), *(on or [])])
        return pa.RecordBatch.from_arrays([pa.array(tree, pa.string()), pa.array(index, pa.int64()), pa.array(steps, _STEPS_ARROW)], ["tree", "index", "steps"])

    return per_batch(pages, hand, f"tree string, index long, steps {STEPS}")


def page_paths(forest: Forest, above: DataFrame | None = None) -> DataFrame:
    """(tree, page, leaves, levels, entries, nodes, above) of the first round's pages; ``above``
    holds the steps from the page's root to the tree's, and on from there by ``above``
    (tree, steps).

    From the last round down, each page hands every entry its own steps and the siblings
    addressed in its log: pages and entries meet one to one, whatever the size of a tree.
    """
    none = F.lit(None).cast(STEPS)
    # pages in which trees end take up what lies above the tree
    ends = above.select(F.col("tree").alias("_tree"), F.lit(0).cast("long").alias("_page"), F.col("steps").alias("above")) if above is not None else None
    handed = None
    for k in range(len(forest.pages) - 1, -1, -1):
        pages = forest.pages[k]
        known = handed.select(F.col("tree").alias("_tree"), F.col("page").alias("_page"), "above") if handed is not None else None
        if ends is not None:
            # a tree ends in this round if it has one page in it
            single = pages.where(F.col("leaves") <= PAGE).select("tree").join(ends, _same("tree", "_tree")).select("_tree", "_page", "above")
            known = single if known is None else known.union(single)
        met = pages.withColumn("above", none) if known is None else pages.join(known, _same("tree", "_tree") & (F.col("page") == F.col("_page")), "left").drop("_tree", "_page")
        if k == 0:
            return met
        handed = materialize(entry_paths(met)).withColumnsRenamed({"index": "page", "steps": "above"})
    raise AssertionError("a forest has a round")


RESULT = (
    "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean, index long, tree string"
)


def manifest(docs: DataFrame, tamper: Column | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified, index, tree.

    Leaves of a source ascend by doc_id (null first), then digest, so repeated rows and
    rows that share an id have defined places. A null source is a tree of its own, the
    first. Null fields count as ``-``, an empty text as ``0:``. The proof holds the siblings
    of each level up to the root of all sources. ``folded_root`` is recomputed from the
    tampered leaf where ``tamper`` holds (nulls do not), and ``verified`` says whether it is
    the root. An empty table gives no rows. Columns besides FIELDS are not read.
    """
    placed = materialize(numbered(materialize(leaves(docs, tamper)), ["doc_id", "entry", "salt"]))
    forest = build(placed)
    sources = forest.roots.select(F.lit("").alias("tree"), F.col("tree").alias("name"), F.col("root").alias("entry"))
    ranked = materialize(numbered(materialize(sources), ["name"]))
    climbed = entry_paths(page_paths(build(ranked))).select(F.col("index").alias("_index"), "steps")
    tops = materialize(ranked.select("name", "index").join(climbed, F.col("index") == F.col("_index")).select(F.col("name").alias("tree"), "steps"))
    paths = page_paths(forest, tops)
    rows = placed.groupBy("tree", F.floor(F.col("index") / PAGE).alias("page")).agg(
        F.sort_array(F.collect_list(F.struct("index", "doc_id", "tampered"))).alias("rows"),
    )
    met = paths.join(rows.withColumnsRenamed({"tree": "_tree", "page": "_page"}), _same("tree", "_tree") & (F.col("page") == F.col("_page"))).drop("_tree", "_page")

    def prove(batch: pa.RecordBatch) -> pa.RecordBatch:
        out: list[tuple] = []
        names = ("tree", "leaves", "levels", "entries", "nodes", "above", "rows")
        for tree, leaves, levels, entries, nodes, on, rows in zip(*[batch[c].to_pylist() for c in names]):
            rest = [(s["at"], s["siblings"]) for s in on or []]
            within = height(leaves) - levels  # the steps that end at the tree's root
            subroot = fold(nodes[-1], rest[:within])
            root = fold(subroot, rest[within:])
            tail = "".join(d for _, siblings in rest for d in siblings)
            for k, row in enumerate(rows):
                steps = path(nodes, k, len(entries), levels)
                proof = "".join([*[d for _, siblings in steps for d in siblings], tail])
                folded = fold(row["tampered"] or entries[k], [*steps, *rest])
                out.append((row["doc_id"], entries[k], subroot, root, _digest(proof), folded, folded == root, row["index"], tree))
        kinds = [pa.int64(), *[pa.string()] * 5, pa.bool_(), pa.int64(), pa.string()]
        columns = list(zip(*out)) or [()] * len(kinds)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], [x.split()[0] for x in RESULT.split(", ")])

    return per_batch(met, prove, RESULT)


def log(entries: DataFrame, forest: Forest) -> DataFrame:
    """(tree, place, level, index, digest) of every node: the trees' logs, each in the
    order of completion. ``entries`` are the numbered leaves the forest was built from."""
    sizes = entries.select("tree", "leaves").distinct().select(F.col("tree").alias("_tree"), F.col("leaves").alias("n"))
    found = None
    for k, pages in enumerate(forest.pages):
        held = F.size("entries").cast("long")
        levels = F.explode(F.sequence(F.lit(0 if k == 0 else 1), F.col("levels"))).alias("level")
        nodes = pages.select("tree", "page", held.alias("held"), "nodes", levels)
        width = _width(F.col("level"))
        inner = nodes.select("*", F.posexplode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("held") / width) - 1)).alias("_", "at"))
        at = place(F.col("level"), F.col("at"), F.col("held"))
        here = inner.select(
            "tree", (F.col("level") + k * PAGE_LEVELS).alias("level"),
            (F.col("at") + F.col("page") * F.floor(F.lit(PAGE) / width)).cast("long").alias("index"), F.get("nodes", at.cast("int")).alias("digest"),
        )
        found = here if found is None else found.unionByName(here)
    met = found.join(sizes, _same("tree", "_tree"))
    return met.select("tree", place(F.col("level"), F.col("index"), F.col("n")).alias("place"), "level", "index", "digest")
