"""BPE encoding and decoding by prefix-sharing trie traversal.

The encoding of a word is fixed by the last token of each of its prefixes: the
last token of a prefix is the one token that ends it and goes with the last
token of what stands before. So distinct words are walked as a trie, depth
first, and a prefix's last token is found once for all words that begin with
it. Texts are cut at white space, and each distinct piece is encoded once.

Defined cases: a null text is empty and has no ids; the two added tokens are
recognised in texts, as the library does by default; ids that the vocabulary
lacks decode to nothing; repeated rows are encoded alike; an empty table gives
an empty table; other columns of the input are ignored. Letters, numbers
and lower case are those of the edition of Unicode that the library has.
"""

from __future__ import annotations

import json
import re
import unicodedata
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StringType, StructField, StructType
from tokenizers import Regex
from tokenizers.normalizers import Lowercase
from tokenizers.pre_tokenizers import Split

from ..storage import small_batches
from .shingles import chunks

#: Bytes of pieces and words that a task remembers; beyond them it forgets and encodes again.
REMEMBERED = 48 << 20
#: What an entry weighs besides its own bytes, and the longest piece worth remembering.
ENTRY, LONGEST = 200, 64
#: Pairs of tokens whose meeting a task remembers.
MEETINGS = 200_000
# What the vocabulary's file names as its splitting of words, and white space.
WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
#: The same, where some letters and numbers (STRAYS) are neither.
FEWER_LETTERS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}--STRAYS]+|[\p{N}--STRAYS]|[[^\s\p{L}\p{N}]||STRAYS]+"
ASCII_WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9]+")
SPACES = re.compile("[\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]+")
NOT_SPACES = re.compile("[\x1c-\x1f]")
END = "</w>"
#: Bytes of texts or ids that are worked on at a time.
SLICE = 1 << 20
SHORT = (2, 1)
#: A digit or Latin letter, then a stop or comma before white space: always words of their own.
#: (Letters whose normal form or lower case ends with a mark are left out: the mark goes with the stop.)
STOP = re.compile(r"([0-9A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\u012f\u0131-\u024f])([.,](?=\s))")


class Vocabulary:
    """Tokens, merges and added tokens of a BPE vocabulary with word ends."""

    def __init__(self, text: str):
        told = json.loads(text)
        model = told["model"]
        ids: dict[str, int] = model["vocab"]
        self.names = {i: t for t, i in ids.items()} | {t["id"]: t["content"] for t in told["added_tokens"]}
        self.added = {t["content"]: t["id"] for t in told["added_tokens"]}
        self.find_added = re.compile("(" + "|".join(map(re.escape, self.added)) + ")") if self.added else None
        # merges: rank of a pair; each merged token's rank and halves, -1 for a single symbol
        self.rank_of: dict[tuple[int, int], int] = {}
        self.rank = {i: -1 for i in ids.values()}
        self.halves: dict[int, tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            whole = ids[a + b]
            self.rank_of[ids[a], ids[b]] = rank
            self.rank[whole], self.halves[whole] = rank, (ids[a], ids[b])
        byte = byte_of_symbol()
        self.inner: dict[bytes, int] = {}
        self.final: dict[bytes, int] = {}
        for token, i in ids.items():
            at_end = token.endswith(END)
            symbols = token[: -len(END)] if at_end else token
            if all(c in byte for c in symbols):
                (self.final if at_end else self.inner)[bytes(byte[c] for c in symbols)] = i
        self.size = {i: len(w) for table in (self.inner, self.final) for w, i in table.items()}
        self.inner_sizes, self.final_sizes = sizes_by_ending(self.inner), sizes_by_ending(self.final)
        self.goes: dict[int, bool] = {}

    def adjoin(self, a: int, b: int) -> bool:
        """Whether a and b stay two tokens when they meet.

        Their merges are undone from the last to the first. Two parts that
        face each other would have merged if their pair's rank comes before
        the merge that replaced one of them; among equals the left goes first.
        """
        rank_of, rank, halves = self.rank_of, self.rank, self.halves
        if (a, b) in rank_of:
            return False
        while True:
            ra, rb = rank[a], rank[b]
            if ra < 0 and rb < 0:
                return True
            if ra > rb:
                a = halves[a][1]
                if rank_of.get((a, b), ra) < ra:
                    return False
            else:
                b = halves[b][0]
                if rank_of.get((a, b), rb + 1) <= rb:
                    return False

    def last(self, tokens: dict[bytes, int], sizes: dict[bytes, tuple[int, ...]], word: bytes, end: int, states: list[int]) -> int:
        """The last token of word[:end]; states has those of its shorter prefixes."""
        goes = self.goes
        for n in sizes.get(word[end - 3 : end], SHORT) if end > 2 else SHORT:
            begin = end - n
            t = tokens.get(word[begin:end]) if begin >= 0 else None
            if t is None:
                continue
            if not begin:
                if self.whole(t):
                    return t
                continue
            key = states[begin] << 20 | t
            ok = goes.get(key)
            if ok is None:
                if len(goes) > MEETINGS:
                    goes.clear()
                ok = goes[key] = self.adjoin(states[begin], t)
            if ok:
                return t
        raise ValueError(f"no token ends {word[:end]!r}")

    def whole(self, t: int) -> bool:
        """Whether a token's own symbols are merged into it."""
        return t not in self.halves or self.adjoin_halves(t)

    @lru_cache(None)  # noqa: B019  one vocabulary a worker
    def adjoin_halves(self, t: int) -> bool:
        a, b = self.halves[t]
        return self.whole(a) and self.whole(b) and self._meet(a, b) == self.rank[t]

    def _meet(self, a: int, b: int) -> int:
        """The rank at which parts of a and b first merge, with a and b not yet whole."""
        rank_of, rank, halves = self.rank_of, self.rank, self.halves
        first = rank_of.get((a, b), 1 << 60)
        while rank[a] >= 0 or rank[b] >= 0:
            ra, rb = rank[a], rank[b]
            if ra > rb:
                a = halves[a][1]
                if rank_of.get((a, b), ra) < ra:
                    first = min(first, rank_of[a, b])
            else:
                b = halves[b][0]
                if rank_of.get((a, b), rb + 1) <= rb:
                    first = min(first, rank_of[a, b])
        return first

    def encode_words(self, words: list[bytes]) -> dict[bytes, bytes]:
        """The ids of distinct words, as bytes. Sorted words are the trie in depth-first order."""
        out, states, before = {}, [-1], b""
        last, size = self.last, self.size
        inner, final = (self.inner, self.inner_sizes), (self.final, self.final_sizes)
        for word in sorted(words):
            n, shared, most = len(word), 0, min(len(before), len(word), len(states)) - 1
            while shared < most and before[shared] == word[shared]:
                shared += 1
            del states[shared + 1 :]
            for end in range(shared + 1, n):
                states.append(last(*inner, word, end, states))
            t = last(*final, word, n, states)
            ids, at = [t], n - size[t]
            while at:
                t = states[at]
                ids.append(t)
                at -= size[t]
            out[word] = array("I", ids[::-1]).tobytes()
            before = word
        return out


@lru_cache(1)
def byte_of_symbol() -> dict[str, int]:
    """The byte that each symbol of a byte-level vocabulary stands for: printable ones are themselves."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def sizes_by_ending(tokens: dict[bytes, int]) -> dict[bytes, tuple[int, ...]]:
    """The lengths, longest first, of the tokens that can end where these three bytes do."""
    found: dict[bytes, set[int]] = {}
    for w in tokens:
        if len(w) > 2:
            found.setdefault(w[-3:], set()).add(len(w))
    return {k: (*sorted(v, reverse=True), *SHORT) for k, v in found.items()}


@lru_cache(2)
def vocabulary(text: str) -> Vocabulary:
    return Vocabulary(text)


@lru_cache(1)
def editions() -> tuple[frozenset[str], dict[int, str], regex.Pattern]:
    """Where the library's edition of Unicode is another than that of WORDS or of Python.

    Characters that one of them takes otherwise; lower-case letters that
    Python does not know; and WORDS where letters and numbers of a later
    edition only are neither.
    """
    every = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))
    known = "".join(regex.findall(r"[\p{L}\p{N}]", every))
    strays = "".join(w for w, _ in Split(Regex(r"[\p{L}\p{N}]+"), "removed").pre_tokenize_str(known)) or "\0"  # a zero is no letter anyway
    new = [c for c in regex.findall(r"\p{Lu}", every) if unicodedata.category(c) == "Cn"]
    lower = {ord(c): low for c, low in zip(new, Lowercase().normalize_str(" ".join(new)).split(" "), strict=True) if low != c} if new else {}
    return frozenset(strays) | set(map(chr, lower)), lower, regex.compile(FEWER_LETTERS.replace("STRAYS", "[" + "".join(map(regex.escape, strays)) + "]"), regex.V1)


def words_of(piece: str) -> list[bytes]:
    """The words of a piece without white space, in the vocabulary's normal form."""
    if piece.isascii():
        piece = piece.lower()
        return [piece.encode()] if piece.isalpha() else [w.encode() for w in ASCII_WORDS.findall(piece)]
    piece = unicodedata.normalize("NFC", piece)
    piece = "".join(c.lower() for c in piece) if "Σ" in piece else piece.lower()
    told_otherwise, lower, words = editions()
    if not told_otherwise.isdisjoint(piece):
        return [w.encode() for w in words.findall(piece.translate(lower))]
    return [w.encode() for w in WORDS.findall(piece)]


def pieces_of(text: str) -> list[str]:
    text = STOP.sub(r"\1 \2", text)
    return [p for p in SPACES.split(text) if p] if NOT_SPACES.search(text) else text.split()


class Memory:
    """What was made of short texts, up to so many bytes: the older half goes, but for what was asked for since."""

    def __init__(self, most: int):
        self.most = most // 2
        self.forget()

    def forget(self) -> None:
        self.young: dict = {}
        self.old: dict = {}
        self.weight = 0

    def put(self, key: str | bytes, ids: bytes) -> None:
        if len(key) <= LONGEST:
            self.young[key] = ids
            self.weight += ENTRY + len(key) + len(ids)

    def unknown(self, keys: Iterable) -> dict:
        """The distinct keys that are not remembered; the others are in young."""
        if self.weight > self.most:
            self.old, self.young, self.weight = self.young, {}, 0
        young, old, new = self.young, self.old, {}
        for k in keys:
            if k not in young and k not in new:
                if k in old:
                    self.put(k, old[k])
                else:
                    new[k] = None
        return new


class Encoder:
    """Encodes batches of texts for one task; remembers short pieces and words up to REMEMBERED bytes."""

    def __init__(self, vocabulary: Vocabulary, remembered: int = REMEMBERED):
        self.v = vocabulary
        self.pieces, self.words = Memory(remembered // 2), Memory(remembered // 2)

    def forget(self) -> None:
        self.pieces.forget()
        self.words.forget()
        self.v.goes.clear()

    def encode(self, texts: list[str]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit integers."""
        cut = []
        for t in texts:
            parts = self.v.find_added.split(t) if self.v.find_added and "<|" in t else [t]
            cut.append([p if i % 2 else pieces_of(p) for i, p in enumerate(parts)])
        new = self.pieces.unknown(p for parts in cut for own in parts[::2] for p in own)
        spelled = {p: words_of(p) for p in new}
        made = self.v.encode_words(list(self.words.unknown(w for ws in spelled.values() for w in ws)))
        known = self.words.young
        for p, ws in spelled.items():
            new[p] = b"".join([made[w] if w in made else known[w] for w in ws])
            self.pieces.put(p, new[p])
        for w, ids in made.items():
            self.words.put(w, ids)
        known = self.pieces.young
        added = {t: np.array([i], "<u4").tobytes() for t, i in self.v.added.items()}
        return [b"".join(added[own] if i % 2 else b"".join([known[p] if p in known else new[p] for p in own]) for i, own in enumerate(parts)) for parts in cut]


def encoder(text: str) -> Encoder:
    """An encoder of a vocabulary's file."""
    return Encoder(vocabulary(text))


class Decoder:
    """Names of ids: the tokens with a space between, word ends included."""

    def __init__(self, vocabulary: Vocabulary):
        names = vocabulary.names
        self.table = np.array([names.get(i) for i in range(max(names) + 1)], object)

    def decode(self, ids: bytes | None) -> str:
        at = np.frombuffer(ids or b"", "<u4")
        found = self.table[at if not len(at) or at.max() < len(self.table) else at[at < len(self.table)]].tolist()
        return " ".join(found if None not in found else [t for t in found if t is not None])


def _shared_vocabulary(df: DataFrame, path: str):
    """The vocabulary's file, a few MB, as a broadcast: executors need not have it."""
    with open(path, encoding="utf-8") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def _rows(docs: DataFrame) -> DataFrame:
    return small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def _encoded(batches: Iterator[pa.RecordBatch], own: Encoder) -> Iterator[tuple[pa.Array, list[bytes]]]:
    """(doc_ids, ids) of about a MB of texts at a time."""
    try:
        for batch in batches:
            for part in chunks(batch, "text", SLICE):
                yield part.column("doc_id"), own.encode([t or "" for t in part.column("text").to_pylist()])
    finally:  # the worker outlives the task
        own.forget()


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids of each row: ids are little-endian unsigned 32-bit integers."""
    shared = _shared_vocabulary(docs, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc_id, ids in _encoded(batches, Encoder(vocabulary(shared.value))):
            yield pa.record_batch([doc_id, pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())], ["doc_id", "n_tokens", "ids"])

    return _rows(docs).mapInArrow(run, "doc_id long, n_tokens long, ids binary")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """encoded's columns and decoded: the tokens' names with a space between, word ends included."""
    shared = _shared_vocabulary(encoded, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Decoder(vocabulary(shared.value))
        for batch in batches:
            for part in chunks(batch, "ids", SLICE):
                columns = [*part.columns, pa.array([own.decode(x) for x in part.column("ids").to_pylist()], pa.string())]
                yield pa.record_batch(columns, [*part.schema.names, "decoded"])

    return small_batches(encoded).mapInArrow(run, StructType([*encoded.schema.fields, StructField("decoded", StringType())]))


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids, decoded of each row: encode and decode in one pass, so that a task needs one worker."""
    shared = _shared_vocabulary(docs, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(shared.value)
        back = Decoder(v)
        for doc_id, ids in _encoded(batches, Encoder(v)):
            columns = [doc_id, pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary()), pa.array(map(back.decode, ids), pa.string())]
            yield pa.record_batch(columns, ["doc_id", "n_tokens", "ids", "decoded"])

    return _rows(docs).mapInArrow(run, "doc_id long, n_tokens long, ids binary, decoded string")
