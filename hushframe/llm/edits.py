"""Token counts that follow edits without encoding whole texts again."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from hushframe.llm.bpe import Coder, coder
from hushframe.llm.frames import per_batch

#: Characters of a leaf, about: leaves end at the first safe place after so many.
LEAF = 512


def safe(text: str, i: int) -> bool:
    """Whether a pre-token begins at i whatever stands beyond its neighbours."""
    return 0 < i < len(text) - 1 and text[i] == " " and not text[i - 1].isspace() and not text[i + 1].isspace()


def next_safe(text: str, i: int) -> int:
    """The first safe place at or after i, or the end."""
    while True:
        i = text.find(" ", i)
        if i < 0 or i >= len(text) - 1:
            return len(text)
        if safe(text, i):
            return i
        i += 1


def leaves(text: str) -> list[str]:
    """The text in pieces of whole pre-tokens, each of about LEAF characters."""
    out, at = [], 0
    while at < len(text):
        end = next_safe(text, at + LEAF)
        out.append(text[at:end])
        at = end
    return out


class SegmentTree:
    """Sums over leaves: characters and tokens. Node i has the children 2i and 2i + 1."""

    def __init__(self, texts: list[str], counts: np.ndarray) -> None:
        self.texts = texts
        self.size = 1 << max(0, (len(texts) - 1).bit_length())
        self.sums = np.zeros((2 * self.size, 2), np.int64)
        self.sums[self.size:self.size + len(texts), 0] = [len(t) for t in texts]
        self.sums[self.size:self.size + len(texts), 1] = counts
        step = self.size
        while step > 1:
            self.sums[step // 2:step] = self.sums[step:2 * step:2] + self.sums[step + 1:2 * step:2]
            step //= 2

    @property
    def tokens(self) -> int:
        return int(self.sums[1, 1])

    @property
    def chars(self) -> int:
        return int(self.sums[1, 0])

    def find(self, position: int) -> tuple[int, int]:
        """The leaf that holds a character position, and where the leaf begins."""
        node, start = 1, 0
        while node < self.size:
            node *= 2
            if position >= start + self.sums[node, 0] and self.sums[node + 1, 0]:
                start += int(self.sums[node, 0])
                node += 1
        return node - self.size, start

    def put(self, leaf: int, text: str, tokens: int) -> None:
        """Replaces a leaf and the sums above it."""
        self.texts[leaf] = text
        node = leaf + self.size
        change = np.array([len(text), tokens]) - self.sums[node]
        while node:
            self.sums[node] += change
            node //= 2


def build(text: str, model: Coder) -> SegmentTree:
    parts = leaves(text) or [""]
    return SegmentTree(parts, np.array([model.count(p) for p in parts]))


def edit(tree: SegmentTree, start: int, end: int, new: str, model: Coder) -> int:
    """Replaces characters [start, end) and returns how many characters were encoded again.

    Touched are the leaves that overlap the range, and the leaves beside them
    as long as the place where they meet is not safe any more. Their new text
    goes into the first of them, unless it outgrew sixteen leaves: then the
    tree is built anew around it, encoding this text alone.
    """
    start = min(max(start, 0), tree.chars)
    end = min(max(end, start), tree.chars)
    first, begins = tree.find(start)
    last, last_begins = tree.find(max(start, end - 1))
    inside = "".join(tree.texts[first:last + 1])
    text = inside[:start - begins] + new + inside[end - begins:]

    def holds(left: str, right: str) -> bool:
        return not left or not right or safe(left[-1] + right[:2], 1)

    def beside(at: int, step: int) -> int | None:
        at += step
        while 0 <= at < len(tree.texts) and not tree.texts[at]:
            at += step
        return at if 0 <= at < len(tree.texts) else None

    while (before := beside(first, -1)) is not None and not (text and holds(tree.texts[before], text)):
        first, text = before, tree.texts[before] + text
    while (after := beside(last, 1)) is not None and not (text and holds(text, tree.texts[after])):
        last, text = after, text + tree.texts[after]
    if len(text) > 16 * LEAF:
        parts = leaves(text)
        counts = tree.sums[tree.size:tree.size + len(tree.texts), 1]
        grown = SegmentTree(
            tree.texts[:first] + parts + tree.texts[last + 1:],
            np.concatenate([counts[:first], [model.count(p) for p in parts], counts[last + 1:]]),
        )
        tree.texts, tree.size, tree.sums = grown.texts, grown.size, grown.sums
    else:
        tree.put(first, text, model.count(text))
        for leaf in range(first + 1, last + 1):
            tree.put(leaf, "", 0)
    return len(text)


SCHEMA = (
    "doc_id long, n_tokens long, n_leaves int, n_edits int, n_tokens_after long, n_chars_after long, "
    "chars_encoded_again long"
)


def counts_after_edits(
    docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", edits_col: str = "edits",
) -> DataFrame:
    """Token counts of each text before and after its edits.

    ``edits_col`` holds an array of (start, stop, text) in characters, applied in
    order, each to the text the earlier ones left; ranges are clipped to the
    text, a null field counts as the range's beginning, an empty range or an
    empty text. Null edits are none, a null text is empty. The text is
    encoded once, in leaves of a segment tree; an edit encodes the leaves it
    touches and updates the sums above them. Repeated rows are counted each.
    """

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        model: Coder = coder(vocabulary)
        rows = []
        texts, edits = batch.column("text"), batch.column("edits")
        for i in range(batch.num_rows):
            tree = build(texts[i].as_py() or "", model)
            before, n, again = tree.tokens, sum(map(bool, tree.texts)), 0
            changes = edits[i].as_py() or []
            for change in changes:
                start = (change or {}).get("start") or 0
                stop = (change or {}).get("stop")
                again += edit(tree, start, start if stop is None else stop, (change or {}).get("text") or "", model)
            rows.append((before, n, len(changes), tree.tokens, tree.chars, again))
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
        columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], names=[f.split()[0] for f in SCHEMA.split(", ")])

    return per_batch(
        docs.select(
            F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"),
            F.col(edits_col).cast("array<struct<start:int,stop:int,text:string>>").alias("edits"),
        ), work, SCHEMA,
    )


TREES = "doc_id long, leaves array<struct<text:string,tokens:int>>, n_tokens long"


def _leaves_of(tree: SegmentTree) -> list[dict]:
    counts = tree.sums[tree.size:tree.size + len(tree.texts), 1]
    return [{"text": t, "tokens": int(n)} for t, n in zip(tree.texts, counts) if t]


def _tree_rows(batch: pa.RecordBatch, trees: list[SegmentTree], *more: pa.Array) -> list[pa.Array]:
    leaf = pa.list_(pa.struct([("text", pa.string()), ("tokens", pa.int32())]))
    return [batch.column("doc_id"), pa.array([_leaves_of(t) for t in trees], leaf), pa.array([t.tokens for t in trees], pa.int64()), *more]


def stored_trees(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, leaves, n_tokens: the segment tree of each text by its leaves, to be written and kept.

    Sums above the leaves follow from them. A null or empty text has no leaves; repeated rows
    have a tree each; an empty table gives no rows.
    """
    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        model = coder(vocabulary)
        trees = [build(t or "", model) for t in batch.column("text").to_pylist()]
        return pa.RecordBatch.from_arrays(_tree_rows(batch, trees), names=["doc_id", "leaves", "n_tokens"])

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return per_batch(texts, work, TREES)


def edited_trees(trees: DataFrame, changes: DataFrame, vocabulary: str, edits_col: str = "edits") -> DataFrame:
    """The kept ``trees`` after ``changes`` (doc_id and an array of edits): doc_id, leaves, n_tokens, chars_encoded_again.

    Only the leaves an edit touches are encoded again, with the context their borders need; the
    rest of a text is not encoded, nor read as a text. Edits are those of ``counts_after_edits``;
    trees without changes pass as they are, changes without a tree are left out. Each doc_id
    has at most one row of changes; they apply to every tree of that id. A null id has no changes.
    """
    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        model, out, again = coder(vocabulary), [], []
        for leaves, edits in zip(batch.column("leaves").to_pylist(), batch.column("edits").to_pylist(), strict=True):
            held = leaves or [{"text": "", "tokens": 0}]
            tree, n = SegmentTree([x["text"] for x in held], np.array([x["tokens"] for x in held])), 0
            for change in edits or []:
                start, stop = (change or {}).get("start") or 0, (change or {}).get("stop")
                n += edit(tree, start, start if stop is None else stop, (change or {}).get("text") or "", model)
            out.append(tree)
            again.append(n)
        return pa.RecordBatch.from_arrays(_tree_rows(batch, out, pa.array(again, pa.int64())), names=["doc_id", "leaves", "n_tokens", "chars_encoded_again"])

    known = changes.select("doc_id", F.col(edits_col).cast("array<struct<start:int,stop:int,text:string>>").alias("edits"))
    met = trees.select("doc_id", "leaves").join(known, "doc_id", "left").select("doc_id", "leaves", "edits")
    return per_batch(met, work, f"{TREES}, chars_encoded_again long")


def sample_edits(text_col: str = "text") -> F.Column:
    """Three edits of any text: a word put in at a third, a quarter of the text's
    second half cut out, the first 40 characters copied to the end."""
    n = F.coalesce(F.length(text_col), F.lit(0))
    third, half, put_in = (n / 3).cast("int"), (n / 2).cast("int"), " inserted words"
    end = n + len(put_in)  # at or beyond the end after the first two edits
    return F.array(
        F.struct(third.alias("start"), third.alias("stop"), F.lit(put_in).alias("text")),
        F.struct(half.alias("start"), (half + n / 8).cast("int").alias("stop"), F.lit("").alias("text")),
        F.struct(end.alias("start"), end.alias("stop"), F.substring(F.coalesce(text_col, F.lit("")), 1, 40).alias("text")),
    )
