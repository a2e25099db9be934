"""Encoding of whole texts with a public byte-level BPE vocabulary, by tree reduction.

A text is halved down to short leaves; leaves are encoded and neighbours joined, from their ids alone. A window of a few
tokens on both sides of the cut is encoded again and grows until the tokens outside it are proven to stay. That is so

* at places that the pattern which splits text before the merges never matches across, whatever stands around: between a
  character that is no white space and a following blank or line feed;
* where there is no such place near, as in long runs of letters or of a script without blanks: once the window's first and last
  tokens come out as they were. All neighbours in the joined list have then been neighbours in a correct encoding, and
  a list of tokens is the encoding of its text just where each two neighbours are that of theirs.

Texts above SEGMENT characters are cut into segments that Spark spreads over tasks, so that a few very
long texts don't hold up one task; their lists are joined by the same rule. Decoding joins bytes, which
needs no window.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Folder of the vocabularies, the same on all machines.
FOLDER = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"
#: Characters of a leaf, and of a segment that is a task's own row.
LEAF, SEGMENT = 1024, 262_144
#: Tokens of the first window on each side of a cut, and those that must come out as they were at its ends.
WINDOW, AGREED = 8, 2
# Fixed value: the vocabulary's pattern, which splits text before the merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class Coder:
    """A vocabulary: encodes a text, and joins lists of ids."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.encoding = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.encode = self.encoding.encode_ordinary
        self.bytes = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.bytes[rank] = token

    def text(self, ids: list[int]) -> bytes:
        return b"".join([self.bytes[i] for i in ids])

    def joined(self, left: list[int], right: list[int]) -> list[int]:
        """Ids of the text that ``left`` and ``right`` are the ids of, one after the other."""
        if not left or not right:
            return left + right
        size = WINDOW
        while True:
            first, last = max(0, len(left) - size), min(len(right), size)
            # a window begins and ends between characters, not within one
            while first > 0 and self.bytes[left[first]][0] & 0xC0 == 0x80:
                first -= 1
            while last < len(right) and self.bytes[right[last]][0] & 0xC0 == 0x80:
                last += 1
            before, after = self.text(left[first:]).decode(), self.text(right[:last]).decode()
            window, cut = before + after, len(before)
            if splits_at(window, cut):
                return left + right
            start = next((at for at in range(cut - 1, 0, -1) if splits_at(window, at)), 0 if first == 0 else None)
            end = next((at for at in range(cut + 1, len(window)) if splits_at(window, at)), len(window) if last == len(right) else None)
            if start is not None and end is not None:
                kept = self._tokens_back(left, len(window[start:cut].encode()))
                dropped = self._tokens_on(right, len(window[cut:end].encode()))
                return left[: len(left) - kept] + self.encode(window[start:end]) + right[dropped:]
            ids = self.encode(window)
            stays_before = first == 0 or ids[:AGREED] == left[first : first + AGREED]
            stays_after = last == len(right) or ids[-AGREED:] == right[last - AGREED : last]
            if stays_before and stays_after and len(ids) > 2 * AGREED:
                return left[:first] + ids + right[last:]
            size *= 2

    def _tokens_back(self, ids: list[int], length: int) -> int:
        """How many tokens at the end of ``ids`` make up so many bytes."""
        n = 0
        while length > 0:
            n += 1
            length -= len(self.bytes[ids[-n]])
        return n

    def _tokens_on(self, ids: list[int], length: int) -> int:
        n = 0
        while length > 0:
            length -= len(self.bytes[ids[n]])
            n += 1
        return n

    def encoded(self, text: str) -> list[int]:
        """Ids of a text, by halves."""
        if len(text) <= LEAF:
            return self.encode(text)
        cut = len(text) // 2
        return self.joined(self.encoded(text[:cut]), self.encoded(text[cut:]))

    def reduced(self, parts: list[list[int]]) -> list[int]:
        """Ids of neighbouring parts, joined pairwise up the tree."""
        while len(parts) > 1:
            pairs = [self.joined(a, b) for a, b in zip(parts[::2], parts[1::2])]
            parts = pairs + parts[len(parts) - len(parts) % 2 :]
        return parts[0] if parts else []


@lru_cache(maxsize=2)
def coder(path: str) -> Coder:
    """The vocabulary of a rank file; once in each Python worker."""
    return Coder(path)


def splits_at(text: str, at: int) -> bool:
    """Whether the sides of this place are encoded independently, whatever surrounds them."""
    return text[at] in " \n" and not text[at - 1].isspace()


def _rows(path: str):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoded = coder(path).encoded
        for batch in batches:
            ids = [encoded(text) if text else [] for text in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(ids, pa.list_(pa.int32()))], [*batch.schema.names[:-1], "ids"])

    return scan


def _joins(path: str):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reduced = coder(path).reduced
        for batch in batches:
            ids = [reduced([p["ids"] for p in parts]) for parts in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return scan


def encode_texts(documents: DataFrame, path: str = f"{FOLDER}/{VOCABULARY}") -> DataFrame:
    """(doc_id, ids ARRAY<INT>) for every row of documents (doc_id, text), without special tokens.

    Null and empty texts get the empty list; strings that look like special tokens are ordinary text.
    Repeated rows, also with the same doc_id, stay apart; other columns play no part.
    """
    named = documents.select("doc_id", "text")
    is_long = F.coalesce(F.char_length("text") > SEGMENT, F.lit(False))
    kind = dict(named.dtypes)["doc_id"]
    short = named.where(~is_long).mapInArrow(_rows(path), f"doc_id {kind}, ids array<int>")
    at = F.sequence(F.lit(0), F.floor((F.char_length("text") - 1) / SEGMENT).cast("int"))
    rows = named.where(is_long).withColumn("row", F.monotonically_increasing_id())
    pieces = rows.select("row", "doc_id", F.posexplode(F.transform(at, lambda i: F.substring("text", i * SEGMENT + 1, F.lit(SEGMENT)))).alias("no", "text"))
    parts = int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ids = pieces.repartition(parts, "row", "no").mapInArrow(_rows(path), f"row long, doc_id {kind}, no int, ids array<int>")
    ordered = ids.groupBy("row", "doc_id").agg(F.array_sort(F.collect_list(F.struct("no", "ids"))).alias("parts"))
    return short.unionByName(ordered.select("doc_id", "parts").mapInArrow(_joins(path), f"doc_id {kind}, ids array<int>"))


def decode_ids(encoded_rows: DataFrame, path: str = f"{FOLDER}/{VOCABULARY}") -> DataFrame:
    """(doc_id, text) of rows (doc_id, ids); null and empty lists give the empty text."""
    kind = dict(encoded_rows.dtypes)["doc_id"]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = coder(path).text
        for batch in batches:
            texts = [decode(ids or []).decode("utf-8", errors="replace") for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded_rows.select("doc_id", "ids").mapInArrow(scan, f"doc_id {kind}, text string")
