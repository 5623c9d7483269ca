"""Byte-level BPE over Arrow batches, and the way back to bytes."""

from __future__ import annotations

import re
from array import array
from collections.abc import Callable
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, functions as F

from hushframe.llm.arrays import text_runs
from hushframe.llm.frames import per_batch

#: A space between two characters that are not white space begins a pre-token
#: under the byte-level pattern, whatever stands further away.
PIECE = re.compile(r"(?<=\S)(?= \S)")
#: Texts without this are cut at all their spaces.
WIDE = re.compile(r" \s|\s ")
#: The byte-level pattern, fixed by the vocabularies. White space is the Unicode
#: property; ``\s`` of the regex module would add four control characters.
PRETOKEN = regex.compile(
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
    r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)

#: Pieces a worker remembers before it starts afresh, and pre-tokens beside them.
REMEMBERED = 250_000
REMEMBERED_PRETOKENS = 1 << 16


def pieces(text: str) -> list[str]:
    """The text cut where a pre-token surely begins."""
    if WIDE.search(text):
        return PIECE.split(text)
    first, *others = text.split(" ")
    return [first, *[" " + word for word in others]]


def byte_alphabet() -> dict[str, int]:
    """Character of a byte-level vocabulary -> byte: printable Latin-1 stands for
    itself, the other bytes follow from code point 256 on."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


class Places(dict):
    """Piece -> number of the piece, with the ids of all pieces one after another."""

    def __init__(self, ids_of: Callable[[str], list[int]]) -> None:
        super().__init__()
        self.ids_of, self.ids, self.borders = ids_of, array("i"), array("q", [0])

    def __missing__(self, piece: str) -> int:
        self.ids.extend(self.ids_of(piece))
        self.borders.append(len(self.ids))
        self[piece] = number = len(self)
        return number


class Sizes(dict):
    """Piece -> number of its ids."""

    def __init__(self, ids_of: Callable[[str], list[int]]) -> None:
        super().__init__()
        self.ids_of = ids_of

    def __missing__(self, piece: str) -> int:
        self[piece] = size = len(self.ids_of(piece))
        return size


class Coder:
    """A byte-level vocabulary file with the ids of the pieces seen so far.

    Each pre-token is mapped from bytes to the characters of the vocabulary and
    given to the library's model; strings of special tokens are ordinary text.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        model, alphabet = tokenizer.model, byte_alphabet()
        characters = {byte: c for c, byte in alphabet.items()}
        special = {token.content for token in tokenizer.get_added_tokens_decoder().values()}
        vocabulary = tokenizer.get_vocab()
        token_bytes = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            token_bytes[i] = token.encode() if token in special else bytes(alphabet[c] for c in token)
        self.lengths = np.array([len(b) for b in token_bytes], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(token_bytes), np.uint8)

        @lru_cache(REMEMBERED_PRETOKENS)
        def pretoken(text: str) -> list[int]:
            return [token.id for token in model.tokenize(text.encode().decode("latin-1").translate(characters))]

        self.pretoken = pretoken
        self.places, self.sizes = Places(self.ids_of), Sizes(self.ids_of)

    def ids_of(self, piece: str) -> list[int]:
        if piece[1:].isalpha() and (piece[0] == " " or piece[0].isalpha()):
            return self.pretoken(piece)
        return list(chain.from_iterable(map(self.pretoken, PRETOKEN.findall(piece))))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """ids of all texts one after another, and how many each text has."""
        if len(self.places) > REMEMBERED:
            self.places = Places(self.ids_of)
        split = [pieces(t) for t in texts]
        n = sum(map(len, split))
        at = np.fromiter(map(self.places.__getitem__, chain.from_iterable(split)), np.int64, n)
        known, borders = np.frombuffer(self.places.ids, np.int32), np.frombuffer(self.places.borders, np.int64)
        sizes = borders[at + 1] - borders[at]
        ends = np.cumsum(sizes)
        ids = known[np.arange(ends[-1] if n else 0) + np.repeat(borders[at] - (ends - sizes), sizes)]
        totals = np.r_[0, ends][np.cumsum([len(s) for s in split], dtype=np.int64)]
        return ids, np.diff(np.r_[0, totals])

    def count(self, text: str) -> int:
        """Number of ids of a text."""
        if len(self.sizes) > REMEMBERED:
            self.sizes = Sizes(self.ids_of)
        return sum(map(self.sizes.__getitem__, pieces(text)))

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of the ids one after another, and the end of each id's bytes."""
        lengths = self.lengths[ids]
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ids) else 0
        return self.bytes[np.arange(total) + np.repeat(self.starts[ids] - (ends - lengths), lengths)], ends


@lru_cache(maxsize=2)
def coder(path: str) -> Coder:
    return Coder(path)


def _encoded(vocabulary: str, offsets: bool = False) -> Callable[[pa.RecordBatch], pa.RecordBatch]:
    """doc_id, text -> doc_id, ids and, with ``offsets``, chars."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        model, ids, sizes, spans = coder(vocabulary), [], [], []
        for _, data, ends in text_runs(batch, "text", 1 << 18):
            texts = [data[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(ends[:-1], ends[1:], strict=True)]
            found, counts = model.encode(texts)
            ids.append(found)
            sizes.append(counts)
            if offsets:
                first = 0
                for text, n in zip(texts, counts, strict=True):
                    spans.append(character_spans(model, text.encode(), found[first:first + n]))
                    first += n
        flat = pa.array(np.concatenate(ids))
        borders = pa.array(np.r_[0, np.cumsum(np.concatenate(sizes))].astype(np.int32))
        columns = [batch.column("doc_id"), pa.ListArray.from_arrays(borders, flat)]
        if offsets:
            columns.append(pa.array(spans, pa.list_(pa.list_(pa.int32()))))
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", "ids", "chars"][:len(columns)])

    return work


def _decoded(vocabulary: str) -> Callable[[pa.RecordBatch], pa.RecordBatch]:
    """doc_id, ids -> doc_id, ids, decoded."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        model, lists = coder(vocabulary), batch.column("ids")
        flat = lists.flatten().to_numpy(zero_copy_only=False)
        sizes = np.array([0 if n is None else n for n in lists.value_lengths().to_pylist()], np.int64)
        data, ends = model.decode(flat)
        borders = np.r_[0, ends][np.r_[0, np.cumsum(sizes)]].astype(np.int64)
        out = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(borders), pa.py_buffer(data)])
        decoded = pc.if_else(lists.is_valid(), out, None).cast(pa.binary())
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), lists, decoded], names=["doc_id", "ids", "decoded"])

    return work


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def encode(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", offsets: bool = False) -> DataFrame:
    """doc_id, ids (array of int); with ``offsets`` also chars, the first and
    last-plus-one character of each id.

    ``vocabulary`` is the path of a byte-level tokenizers file on every
    executor. Texts are split at safe places, the library's model encodes the
    pre-tokens of each distinct piece once, and the ids are put together by text.
    An id that holds a part of a character spans the whole character. A null or
    empty text has no ids; repeated rows are encoded each.
    """
    schema = "doc_id long, ids array<int>" + (", chars array<array<int>>" if offsets else "")
    return per_batch(_texts(docs, id_col, text_col), _encoded(vocabulary, offsets), schema)


def character_spans(model: Coder, data: bytes, ids: np.ndarray) -> list[list[int]]:
    """Characters each id touches, through a map from bytes to characters."""
    lead = (np.frombuffer(data, np.uint8) & 0xC0) != 0x80
    character = np.cumsum(lead) - 1
    ends = np.cumsum(model.lengths[ids])
    first, last = character[ends - model.lengths[ids]], character[ends - 1] + 1
    return np.stack([first, last], axis=1).tolist()


def decode(encoded: DataFrame, vocabulary: str) -> DataFrame:
    """``encoded`` (doc_id, ids) with decoded (binary) added: the bytes of the ids.

    Bytes come from the reversed byte table, so a character whose bytes are
    spread over several ids is whole again; a list of ids that ends inside
    a character yields its bytes as they are. Null ids yield null. Ids
    outside the vocabulary fail.
    """
    return per_batch(encoded.select("doc_id", "ids"), _decoded(vocabulary), "doc_id long, ids array<int>, decoded binary")


def round_trip(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids, decoded: ``decode`` of ``encode`` in one worker, which holds the vocabulary once."""
    there, back = _encoded(vocabulary), _decoded(vocabulary)
    return per_batch(_texts(docs, id_col, text_col), lambda batch: back(there(batch)), "doc_id long, ids array<int>, decoded binary")


def digests(decoded: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of the decimal ids joined by a space), decoded_sha256."""
    return decoded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")).cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
