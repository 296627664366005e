"""Packing token ids into rows of fixed length, and their binary form.

Each scan partition is packed by itself, a shard of documents at a time, so
nothing is shuffled and memory is bounded by a shard. Within a shard pieces go
in by decreasing length, each into the fullest row that still has room; the row
is found by a segment tree over capacities. A document longer than a row is
cut into full rows and a rest, so no token is lost.

Texts may be of any length and kind: white space runs too long for the
tokenizer's splitter are cut out as the words that they are.

Defined cases: a null or empty text is its end mark alone; a null doc_id is
kept as null; repeated rows are packed each; a shard holds one document at
least, however long; an empty table gives an empty table; other columns are
ignored. The same files and split sizes give the same rows.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from ..storage import small_batches
from .shingles import chunks

LENGTH = 2048
#: A shard ends with the document that brings it to this many tokens.
SHARD_TOKENS = 1 << 21
PACKED = "shard long, pack long, n_tokens int, ids binary, cu_seqlens array<int>, position_resets array<int>, doc_ids array<long>, doc_starts array<long>"


class Capacities:
    """Rows by what room they have: a segment tree that finds the least room of at least n."""

    def __init__(self, length: int):
        self.leaves = 1 << length.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.rows: list[list[int]] = [[] for _ in range(length + 1)]

    def put(self, room: int, row: int) -> None:
        self.rows[room].append(row)
        at = self.leaves + room
        while at:
            self.count[at] += 1
            at >>= 1

    def take(self, n: int) -> tuple[int, int] | None:
        """(room, row) of a fullest row that takes n, removed; None if there is none."""
        at = self.leaves + n
        if not self.count[at]:
            while at > 1 and (at & 1 or not self.count[at + 1]):
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.leaves:
                at = 2 * at if self.count[2 * at] else 2 * at + 1
        room = at - self.leaves
        while at:
            self.count[at] -= 1
            at >>= 1
        return room, self.rows[room].pop()


def best_fit(sizes: np.ndarray, length: int) -> list[list[int]]:
    """The pieces of each row, by best-fit decreasing; ties in order."""
    free, rows = Capacities(length), []
    for i in np.argsort(-sizes, kind="stable").tolist():
        n = int(sizes[i])
        found = free.take(n)
        if found is None:
            found = length, len(rows)
            rows.append([])
        room, row = found
        rows[row].append(i)
        if room > n:
            free.put(room - n, row)
    return rows


def pack_shard(shard: int, docs: list[tuple[int | None, np.ndarray]], length: int, pad: int, dtype: str) -> pa.RecordBatch:
    """Rows of PACKED from (doc_id, ids)."""
    pieces = [(d, start, ids[start : start + length]) for d, ids in docs for start in range(0, len(ids), length)]
    rows = best_fit(np.array([len(p[2]) for p in pieces], np.int64), length)
    columns: list[list] = [[] for _ in range(8)]
    for k, own in enumerate(rows):
        ends = np.cumsum([0, *(len(pieces[i][2]) for i in own)])
        row = np.full(length, pad, dtype)
        row[: ends[-1]] = np.concatenate([pieces[i][2] for i in own])
        values = (shard, k, int(ends[-1]), row.tobytes(), ends.tolist(), ends[:-1].tolist(), [pieces[i][0] for i in own], [pieces[i][1] for i in own])
        for c, v in zip(columns, values, strict=True):
            c.append(v)
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int64()))
    return pa.record_batch([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], [x.split()[0] for x in PACKED.split(", ")])


def position_ids(n_tokens: int, resets: list[int]) -> np.ndarray:
    """A row's positions: counted anew from each reset."""
    at = np.arange(n_tokens)
    starts = np.zeros(n_tokens, np.int64)
    starts[np.array(resets, np.int64)] = resets
    return at - np.maximum.accumulate(starts)


@lru_cache(2)
def ranked(text: bytes, pattern: str) -> tiktoken.Encoding:
    """A tokenizer from the lines of a rank file: base64 of a token, its rank."""
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, text.splitlines()) if a}
    return tiktoken.Encoding("ranked", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


#: Maximal runs of white space that are split by hand, as the splitter keeps a state for each of their characters.
LONG_RUN = re.compile("[\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]{64,}")


def encode_text(own: tiktoken.Encoding, text: str) -> list[int]:
    """The ids of any text, for a pattern that leaves the last space of a run to the word that follows.

    What stands before a run, and the run without its last character, are
    split from the rest by the pattern anyway; at the end of a text the whole
    run is one piece.
    """
    ids, at = [], 0
    for run in LONG_RUN.finditer(text):
        end = run.end() if run.end() == len(text) else run.end() - 1
        ids += own.encode_ordinary(text[at : run.start()])
        ids += own._encode_single_piece(text[run.start() : end])
        at = end
    return ids + own.encode_ordinary(text[at:])


def rank_file(df: DataFrame, path: str, pattern: str) -> tuple[Callable[[list[str]], list[np.ndarray]], int]:
    """(tokenize, size of the vocabulary); the file, a few MB, is broadcast."""
    with open(path, "rb") as f:
        text = f.read()
    shared = df.sparkSession.sparkContext.broadcast(text)

    def tokenize(texts: list[str]) -> list[np.ndarray]:
        own = ranked(shared.value, pattern)
        return [np.array(encode_text(own, t), np.uint32) for t in texts]

    return tokenize, len(text.splitlines())


def pack(docs: DataFrame, tokenize: Callable[[list[str]], list[np.ndarray]], end: int, length: int = LENGTH, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """PACKED rows of all docs: each document's ids and an end mark, which also pads.

    ids are length little-endian integers, of 16 bits if the end mark fits,
    else of 32; cu_seqlens bounds the segments, and positions restart at
    position_resets; doc_starts are a segment's first token in its document.
    """
    dtype = "<u2" if end < 1 << 16 else "<u4"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part_id, held, many, n = TaskContext.get().partitionId(), [], 0, 0
        for batch in batches:
            for part in chunks(batch, "text"):
                for d, ids in zip(part.column("doc_id").to_pylist(), tokenize([t or "" for t in part.column("text").to_pylist()]), strict=True):
                    held.append((d, np.append(ids, end).astype(dtype)))
                    many += len(ids) + 1
                    if many >= shard_tokens:
                        yield pack_shard(part_id << 32 | n, held, length, end, dtype)
                        held, many, n = [], 0, n + 1
        if held:
            yield pack_shard(part_id << 32 | n, held, length, end, dtype)

    return small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, PACKED)


FLAT = "shard long, first_pack long, n_rows int, matrix binary, segments array<int>, cu_seqlens array<int>, position_resets array<int>, doc_ids array<long>, doc_starts array<long>"


def flat(packed: DataFrame) -> DataFrame:
    """FLAT rows of packed rows: adjoining packs of a shard as one matrix of ids, row after row.

    segments counts the segments of each row; cu_seqlens, position_resets,
    doc_ids and doc_starts follow each other for all rows, cu_seqlens with one
    more value a row than it has segments. A matrix is a shard's at most; one that a
    partition boundary cuts comes in two.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []

        def made() -> pa.RecordBatch:
            joined = lambda name: [x for r in held for x in r[name]]
            row = (held[0]["shard"], held[0]["pack"], len(held), b"".join(r["ids"] for r in held), [len(r["doc_ids"]) for r in held], joined("cu_seqlens"), joined("position_resets"), joined("doc_ids"), joined("doc_starts"))
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int64()))
            return pa.record_batch([pa.array([v], t) for v, t in zip(row, kinds, strict=True)], [x.split()[0] for x in FLAT.split(", ")])

        for batch in batches:
            for r in batch.to_pylist():
                if held and (r["shard"], r["pack"]) != (held[-1]["shard"], held[-1]["pack"] + 1):
                    yield made()
                    held = []
                held.append(r)
        if held:
            yield made()

    return packed.mapInArrow(run, FLAT)


def unflat(row, length: int, dtype: str) -> list[tuple[np.ndarray, list[int], list[int], list[int | None], list[int]]]:
    """(ids, cu_seqlens, position_resets, doc_ids, doc_starts) of each packed row of a FLAT row."""
    ids, out, at = np.frombuffer(bytes(row.matrix), dtype).reshape(row.n_rows, length), [], 0
    for k, n in enumerate(row.segments):
        out.append((ids[k], row.cu_seqlens[at + k : at + k + n + 1], row.position_resets[at : at + n], row.doc_ids[at : at + n], row.doc_starts[at : at + n]))
        at += n
    return out


def write_packed(packed: DataFrame, path: str) -> None:
    """A Parquet folder of flat id matrices with their segments and position resets (FLAT)."""
    flat(packed).write.mode("overwrite").parquet(path)
