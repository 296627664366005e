"""Tokens of two tokenizers aligned by the bytes that they cover.

Texts, with a space before them, are split before white space runs that begin
with a space or a line feed, where neither vocabulary can merge across: the
byte-level tokenizer cuts there before it merges, and no piece of the other
holds one of the two behind something else. Both are verified on the files; if
they do not hold, a text is one segment. Documents come in blocks. A block asks
for its distinct segments; the requests for a segment meet in one task, in
order, so that it is tokenized and aligned once, and the alignment goes back to
the blocks, where documents are composed. The counts of id pairs are asked for
in the same way.

As cut places change no token, segments of a batch are tokenized as one text
and told apart by their bytes. That each segment's end is a token's end on both
sides is checked, and a batch where it is not is tokenized segment by segment.

Defined cases: a null or empty text, and one that the tokens of either
tokenizer do not give back (it holds U+2581, say), has zeros and an empty
digest, and adds to no count; texts and segments may be of any length; strings
of special tokens are plain text; repeated rows are a document each; a null
doc_id is kept; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F
from sentencepiece import sentencepiece_model_pb2
from tokenizers import Tokenizer

from ..storage import materialize, small_batches

#: Characters of texts in a block; a longer text is a block alone.
BLOCK = 6 << 20
#: Segments that are tokenized at a time, and alignments that are packed at a time.
BATCH, PACKED = 4000, 400_000

_BEFORE_RUN = re.compile(r"(?<=\S)(?=[ \n])")
_RUN = re.compile(r"^\s|\s\s|\s$|\0")
_MARKS = bytes.maketrans(b",|;\n", b"    ")
BLOCKS = "block long, doc_ids array<long>, sizes array<int>, segments binary, words array<string>"
COMPOSED = (
    "block long, doc_ids array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, digests array<string>,"
    " pairs array<long>, held array<long>, ends array<int>, linked binary, times binary"
)
ALIGNED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def squeezed(numbers: np.ndarray) -> bytes:
    """Unsigned 32-bit numbers, smallest the most frequent, compressed byte by byte."""
    return pa.compress(np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes(), "zstd", asbytes=True) if len(numbers) else b""


def unsqueezed(data: bytes, n: int) -> np.ndarray:
    if not n:
        return np.zeros(0, np.int64)
    return np.ascontiguousarray(np.frombuffer(pa.decompress(data, 4 * n, "zstd"), np.uint8).reshape(4, n).T).view("<u4").ravel().astype(np.int64)


def byte_alphabet() -> dict[str, int]:
    """The byte of each letter of a byte-level vocabulary: printable bytes are themselves, the others follow from 256."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Pair:
    """Both tokenizers, and the bytes of their tokens."""

    def __init__(self, byte_level: str, pieces: bytes):
        self.a = Tokenizer.from_str(byte_level)
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        self.b = sentencepiece.SentencePieceProcessor(model_proto=pieces)
        letters = byte_alphabet()
        self.a_bytes = {i: bytes(letters[c] for c in t) if all(c in letters for c in t) else t.encode() for t, i in self.a.get_vocab().items()}
        name = self.b.id_to_piece
        self.b_bytes = [bytes([int(name(i)[3:-1], 16)]) if self.b.is_byte(i) else name(i).replace("▁", " ").encode() for i in range(self.b.get_piece_size())]
        self.space = self.b.piece_to_id("▁")
        self.splits = self.splits_are_safe(json.loads(byte_level), pieces)
        self.a_size = np.zeros(max(self.a_bytes) + 1, np.int64)
        self.a_size[list(self.a_bytes)] = [len(x) for x in self.a_bytes.values()]
        self.b_size = np.array([len(x) for x in self.b_bytes])

    def splits_are_safe(self, told: dict, pieces: bytes) -> bool:
        """Whether no token of either can hold a space or a line feed behind something else, whatever the text."""
        before = told.get("pre_tokenizer") or {}
        cuts = told.get("normalizer") is None and before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")
        cuts = cuts and all(t["special"] for t in told.get("added_tokens", []))
        model = sentencepiece_model_pb2.ModelProto.FromString(pieces)
        rules, user = model.normalizer_spec, sentencepiece_model_pb2.ModelProto.SentencePiece.USER_DEFINED
        cuts = cuts and rules.add_dummy_prefix and not rules.remove_extra_whitespaces and not rules.precompiled_charsmap and rules.escape_whitespaces
        cuts = cuts and not model.trainer_spec.treat_whitespace_as_suffix and not any(p.type == user for p in model.pieces) and self.space != self.b.unk_id()
        names = [x.decode(errors="replace") for x in [*self.a_bytes.values(), *self.b_bytes]]
        # the space that the model puts before a text must not merge with a line feed either
        return bool(cuts) and not any(re.search(r"\S[ \n]", x) for x in names) and not any(" \n" in x.decode(errors="replace") for x in self.b_bytes)

    def words(self, text: str) -> list[str]:
        """The segments of a text, each named by a word: see segment()."""
        if not self.splits:
            return ["\0 " + text]
        if not _RUN.search(text):
            return text.replace("\n", " \n").split(" ")
        return [w if not _RUN.search(w := s.removeprefix(" ")) and s[0] == " " else s if s[0] == "\n" and not _RUN.search(s[1:]) else "\0" + s for s in _BEFORE_RUN.split(" " + text)]

    def segment(self, word: str) -> str:
        """A word stands for itself behind a space, one that begins with a line feed for itself, and one that begins with a zero for what follows."""
        return word[1:] if word[:1] == "\0" else word if word[:1] == "\n" else " " + word

    def b_ids(self, text: str) -> list[int]:
        """The piece model's ids of a text that begins with a space or a line feed, which has its own space already or none."""
        if text == " ":
            return [self.space]
        return self.b.encode(text[1:]) if text[0] == " " else self.b.encode(text)[1:]

    def align(self, words: list[str]) -> list[str]:
        """The groups of each word's segment, `a1,a2|b1;a3|b2`; of one that its tokens do not give back, nothing."""
        segments, out = list(map(self.segment, words)), [""] * len(words)
        plain = [k for k, w in enumerate(words) if w and w[0] != "\0" and not w[-1].isspace()]
        made = self.aligned_together([segments[k] for k in plain]) if plain else []
        if made is None:
            plain, made = [], []
        for k, g in zip(plain, made, strict=True):
            out[k] = g
        for k in {*range(len(words))} - {*plain}:
            a, b = self.a.encode(segments[k], add_special_tokens=False).ids, self.b_ids(segments[k])
            of_a, of_b = [self.a_bytes[i] for i in a], [self.b_bytes[i] for i in b]
            if b"".join(of_a) == segments[k].encode() == b"".join(of_b):
                out[k] = grouped(np.array(a), np.array(b), self.a_size, self.b_size, np.array([len(segments[k].encode())]))[0]
        return out

    def aligned_together(self, segments: list[str]) -> list[str] | None:
        """align() of segments that may follow each other in one text; None if a token crosses a segment's end."""
        text = "".join(segments)
        a = np.array(self.a.encode_batch_fast([text], add_special_tokens=False)[0].ids)
        b = np.array(self.b_ids(text))
        ends = np.cumsum([len(s.encode()) for s in segments])
        if b"".join(map(self.a_bytes.__getitem__, a.tolist())) != text.encode() or b"".join(map(self.b_bytes.__getitem__, b.tolist())) != text.encode():
            return None
        return grouped(a, b, self.a_size, self.b_size, ends)


def grouped(a: np.ndarray, b: np.ndarray, a_size: np.ndarray, b_size: np.ndarray, ends: np.ndarray) -> list[str] | None:
    """The groups of the segments that end at these bytes: ids between the places where tokens of both end."""
    a_ends, b_ends = np.cumsum(a_size[a]), np.cumsum(b_size[b])
    cuts = np.intersect1d(a_ends, b_ends)
    last = np.searchsorted(cuts, ends)
    if last[-1] >= len(cuts) or (cuts[last] != ends).any():
        return None
    group = np.concatenate((np.searchsorted(cuts, a_ends), np.searchsorted(cuts, b_ends)))
    side = np.repeat([0, 1], [len(a), len(b)])
    order = np.lexsort((np.arange(len(group)), side, group))
    names, group, side = list(map(str, np.concatenate((a, b))[order].tolist())), group[order], side[order]
    closes = np.append(group[1:] != group[:-1], True)
    mark = np.where(closes, ";", np.where(np.append(side[1:] != side[:-1], False), "|", ",")).tolist()
    bounds = [0, *np.searchsorted(group, last, "right").tolist()]
    joined = list(map(str.__add__, names, mark))
    return ["".join(joined[lo:hi])[:-1] for lo, hi in zip(bounds[:-1], bounds[1:], strict=True)]


@lru_cache(1)
def pair(byte_level: str, pieces: bytes) -> Pair:
    return Pair(byte_level, pieces)


class _Numbers(dict):
    """Numbers of words by their first occurrence."""

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


def _by_frequency(numbers: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(numbers' ranks by frequency, the number of each rank)."""
    order = np.argsort(-np.bincount(numbers, minlength=n), kind="stable")
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n)
    return rank[numbers], order


def blocks(docs: DataFrame, files) -> DataFrame:
    """BLOCKS: documents as numbers of segments among the distinct ones of their block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, part, n = pair(*files.value), TaskContext.get().partitionId(), 0
        ids, sizes, numbers, words, many = [], [], [], _Numbers(), 0

        def made() -> pa.RecordBatch:
            ranks, order = _by_frequency(np.concatenate([np.zeros(0, np.int64), *numbers]), len(words))
            row = (part << 32 | n, ids, sizes, squeezed(ranks), list(map(list(words).__getitem__, order.tolist())))
            kinds = (pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary(), pa.list_(pa.string()))
            return pa.record_batch([pa.array([v], t) for v, t in zip(row, kinds, strict=True)], ["block", "doc_ids", "sizes", "segments", "words"])

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                text = text.as_py()
                found = own.words(text) if text else []
                ids.append(doc_id)
                sizes.append(len(found))
                numbers.append(np.fromiter(map(words.__getitem__, found), np.int64, len(found)))
                many += len(text or "")
                if many >= BLOCK:
                    yield made()
                    ids, sizes, numbers, words, many, n = [], [], [], _Numbers(), 0, n + 1
        if ids:
            yield made()

    return small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, BLOCKS)


def aligned_segments(asked: DataFrame, files) -> DataFrame:
    """block, n, at, groups: the alignments of the segments that blocks asked for (block, at, word), packed.

    A block asks for a segment once, so no segment has more requests than
    there are blocks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, held, many, latest = pair(*files.value), [], 0, (None, "")

        def packed() -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(held)
            block = table.column("block").to_numpy()
            order = np.argsort(block, kind="stable")
            block, at, groups = block[order], table.column("at").to_numpy()[order], table.column("groups").to_pylist()
            bounds = np.concatenate((np.flatnonzero(np.append(True, block[1:] != block[:-1])), [len(block)]))
            for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
                data = "\n".join(groups[i] for i in order[lo:hi]).encode()
                row = (int(block[lo]), int(hi - lo), squeezed(at[lo:hi]), len(data), pa.compress(data, "zstd", asbytes=True))
                yield pa.record_batch([[x] for x in row], ["block", "n", "at", "size", "groups"])

        for batch in batches:
            for lo in range(0, batch.num_rows, BATCH):
                part = batch.slice(lo, BATCH)
                words = part.column("word").to_pylist()
                # equal words follow each other, also from one batch to the next
                new = [w for k, w in enumerate(words) if w != (words[k - 1] if k else latest[0])]
                made = iter(own.align(new))
                groups = []
                for w in words:
                    if w != latest[0]:
                        latest = (w, next(made))
                    groups.append(latest[1])
                held.append(pa.record_batch([part.column("block"), part.column("at"), pa.array(groups, pa.string())], ["block", "at", "groups"]))
                many += len(words)
            if many >= PACKED:
                yield from packed()
                held, many = [], 0
        if held:
            yield from packed()

    buckets = int(asked.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return asked.repartition(buckets, "word").sortWithinPartitions("word").select("block", "at", "word").mapInArrow(run, "block long, n long, at binary, size long, groups binary")


def parsed(groups: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of groups of segments: (numbers of A's and B's tokens, of groups and of links of each, all links as a << 32 | b, in order)."""
    full = np.array([bool(g) for g in groups])
    told = np.zeros((len(groups), 4), np.int64)
    text = "\n".join(g for g in groups if g) + "\n"
    if text == "\n":
        return told, np.zeros(0, np.int64), full
    raw = np.frombuffer(text.encode(), np.uint8)
    ids = np.fromstring(text.encode().translate(_MARKS).decode(), np.int64, sep=" ")
    mark = raw[(raw < 48) | (raw > 57)]
    ends = (mark == 59) | (mark == 10)
    group = np.cumsum(ends) - ends
    segment = np.cumsum(mark == 10) - (mark == 10)
    in_a = np.cumsum(mark == 124) - (mark == 124) == group
    of_a, of_b = np.flatnonzero(in_a), np.flatnonzero(~in_a)
    many_b = np.bincount(group[of_b])
    first_b = np.concatenate(([0], np.cumsum(many_b)[:-1]))
    size = many_b[group[of_a]]
    other = np.repeat(first_b[group[of_a]] - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(size.sum())
    links = np.repeat(ids[of_a] << 32, size) | ids[of_b][other]
    n = int(full.sum())
    told[full] = np.stack([np.bincount(segment[of_a], minlength=n), np.bincount(segment[of_b], minlength=n), np.bincount(segment[ends], minlength=n), np.bincount(np.repeat(segment[of_a], size), minlength=n)], axis=1)
    return told, links, full


def _compose(block: int, ids: list, sizes: list[int], segments: bytes, of: list[str]) -> pa.RecordBatch:
    """A COMPOSED row of a block whose segments have these groups."""
    told, links, full = parsed(of)
    pairs, links = np.unique(links, return_inverse=True)
    links, order = _by_frequency(links, len(pairs))
    pairs = pairs[order]
    starts = np.concatenate(([0], np.cumsum(told[:, 3])))
    numbers, lo, rows, linked, times, ends, held = unsqueezed(segments, sum(sizes)), 0, [], [], [], [0], np.zeros(len(pairs), np.int64)
    for n in sizes:
        own, lo = numbers[lo : lo + n], lo + n
        if not n or not full[own].all():
            rows.append((0, 0, 0, 0, ""))
            ends.append(ends[-1])
            continue
        digest = hashlib.sha256()
        for k in range(0, n, 100_000):
            digest.update((";" * (k > 0) + ";".join(map(of.__getitem__, own[k : k + 100_000].tolist()))).encode())
        used, often = np.unique(own, return_counts=True)
        size = told[used, 3]
        places = np.repeat(starts[used] - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(size.sum())
        count = np.bincount(links[places], np.repeat(often, size)).astype(np.int64)
        here = np.flatnonzero(count)
        held[here] += 1
        linked.append(here)
        times.append(count[here])
        ends.append(ends[-1] + len(here))
        rows.append((*(often @ told[used]).tolist(), digest.hexdigest()))
    flat = [squeezed(np.concatenate([np.zeros(0, np.int64), *x])) for x in (linked, times)]
    values = [block, ids, *([r[k] for r in rows] for k in range(5)), pairs, held, ends, *flat]
    longs = pa.list_(pa.int64())
    kinds = [pa.int64(), longs, longs, longs, longs, longs, pa.list_(pa.string()), longs, longs, pa.list_(pa.int32()), pa.binary(), pa.binary()]
    return pa.record_batch([pa.array([v], t) for v, t in zip(values, kinds, strict=True)], [x.split()[0] for x in COMPOSED.split(", ")])


def composed(own: DataFrame, files) -> DataFrame:
    """COMPOSED rows of blocks."""
    found = aligned_segments(own.select("block", F.posexplode("words").alias("at", "word")), files)
    found = found.groupBy("block").agg(F.collect_list(F.struct("n", "at", "size", "groups")).alias("got"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                got = batch.column("got")[k].as_py() or []
                of = [""] * sum(g["n"] for g in got)
                for g in got:
                    for at, groups in zip(unsqueezed(g["at"], g["n"]).tolist(), pa.decompress(g["groups"], g["size"], "zstd", asbytes=True).decode().split("\n"), strict=True):
                        of[at] = groups
                yield _compose(*(batch.column(c)[k].as_py() for c in ("block", "doc_ids", "sizes", "segments")), of)

    return own.drop("words").join(found, "block", "left").mapInArrow(run, COMPOSED)


def pair_counts(made: DataFrame) -> DataFrame:
    """pair, docs, best of every linked pair: how many documents hold it, and whether none with its A id is held by more."""
    counts = made.select(F.explode(F.arrays_zip("pairs", "held")).alias("x")).groupBy(F.col("x.pairs").alias("pair")).agg(F.sum("x.held").alias("docs")).filter("docs > 0")
    counts = materialize(counts, "pairs")
    a = F.shiftright("pair", 32)
    most = counts.groupBy(a.alias("a")).agg(F.max("docs").alias("most"))  # a row an id of A's vocabulary at most
    return counts.withColumn("a", a).join(F.broadcast(most), "a").select("pair", "docs", (F.col("docs") == F.col("most")).alias("best"))


def align(docs: DataFrame, byte_level: str, pieces: str) -> DataFrame:
    """ALIGNED rows of docs (doc_id, text), for the paths of a byte-level BPE (A) and a piece model (B).

    Both files, a few MB, are broadcast.
    """
    with open(byte_level, encoding="utf-8") as f, open(pieces, "rb") as g:
        files = docs.sparkSession.sparkContext.broadcast((f.read(), g.read()))
    made = materialize(composed(materialize(blocks(docs, files), "blocks"), files), "composed")
    asked = made.select("block", F.posexplode("pairs").alias("at", "pair")).join(pair_counts(made), "pair")
    told = asked.groupBy("block").agg(F.collect_list(F.struct("at", "docs", "best")).alias("got"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                r = {c: batch.column(c)[k].as_py() for c in ("doc_ids", "n_a", "n_b", "n_groups", "n_links", "digests", "ends", "linked", "times")}
                got = batch.column("got").slice(k, 1).flatten()
                docs_of, best_of = np.zeros(len(batch.column("pairs")[k]) + 1, np.int64), np.zeros(len(batch.column("pairs")[k]) + 1, np.int64)
                if len(got):
                    at = got.field(0).to_numpy(zero_copy_only=False)
                    docs_of[at], best_of[at] = got.field(1).to_numpy(zero_copy_only=False), got.field(2).to_numpy(zero_copy_only=False)
                ends = np.array(r["ends"])
                linked, times = unsqueezed(r["linked"], ends[-1]), unsqueezed(r["times"], ends[-1])
                sums = [np.concatenate(([0], np.cumsum(times * x[linked]))) for x in (best_of, docs_of)]
                best, total = (s[ends[1:]] - s[ends[:-1]] for s in sums)
                columns = [r["doc_ids"], r["n_a"], r["n_b"], r["n_groups"], r["n_links"], best, total]
                yield pa.record_batch([*(pa.array(c, pa.int64()) for c in columns), pa.array(r["digests"], pa.string())], [x.split()[0] for x in ALIGNED.split(", ")])

    return made.drop("held").join(told, "block", "left").mapInArrow(run, ALIGNED)
