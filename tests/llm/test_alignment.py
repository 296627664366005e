"""Alignments against whole texts, tokenized and compared without segments."""

import hashlib
import random
from bisect import bisect_left
from collections import defaultdict
from itertools import accumulate

import public_tokenizers
import pytest

from hashloom.llm import alignment

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def own():
    with open(A, encoding="utf-8") as f, open(B, "rb") as g:
        return alignment.Pair(f.read(), g.read())


def whole(own, text):
    """The groups of a whole text, [] if it has none: cuts are byte offsets that both have."""
    if not text:
        return []
    a = own.a.encode(" " + text, add_special_tokens=False).ids
    b = own.b.encode(text)
    raw = (" " + text).encode()
    if b"".join(own.a_bytes[i] for i in a) != raw or b"".join(own.b_bytes[i] for i in b) != raw:
        return []
    cut_of = []
    for ids, of in ((a, own.a_bytes), (b, own.b_bytes)):
        cut_of.append(list(accumulate(len(of[i]) for i in ids)))
    common = sorted(set(cut_of[0]) & set(cut_of[1]))
    out = [([], []) for _ in common]
    for side, ids, ends in ((0, a, cut_of[0]), (1, b, cut_of[1])):
        for i, e in zip(ids, ends, strict=True):
            out[bisect_left(common, e)][side].append(i)
    return out


def plain(own, rows):
    made = [(d, whole(own, t)) for d, t in rows]
    held = defaultdict(int)
    for _, g in made:
        for p in {(x, y) for a, b in g for x in a for y in b}:
            held[p] += 1
    most = defaultdict(int)
    for (x, _), n in held.items():
        most[x] = max(most[x], n)
    out = []
    for d, g in made:
        links = [(x, y) for a, b in g for x in a for y in b]
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in g)
        best = sum(held[p] == most[p[0]] for p in links)
        out.append((d, sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), len(links), best, sum(held[p] for p in links), hashlib.sha256(text.encode()).hexdigest() if g else ""))
    return sorted(out, key=str)


def texts(rng, n):
    bits = ["a", "The", "ing", " ", "  ", "\n", "\t", "\r\n", " ", "　", "\x1f", "\x85", "é", "漢字", "🙂", "'s", "don't", "123", "<|endoftext|>", "<s>", "</s>", "<unk>", "<0x0A>", "...", "_", "\x00", "Ġ", "straße", "́"]
    return ["".join(rng.choice(bits) for _ in range(rng.randrange(1, 30))) for _ in range(n)]


def test_splits_change_no_token(own):
    assert own.splits
    for t in [*texts(random.Random(3), 3000), "a b\nc d", "a\nb", "x", "x \n y", "\n\nq", "tail ", "tail\n", "tail\t", "a\tb c\n"]:
        words = own.words(t)
        assert "".join(map(own.segment, words)) == " " + t
        made = own.align(words)
        joined = ";".join(made) if all(made) else ""
        assert joined == ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in whole(own, t)), t


def test_documents_against_whole_texts(spark, own, monkeypatch):
    monkeypatch.setattr(alignment, "PACKED", 30)
    monkeypatch.setattr(alignment, "BATCH", 7)
    rng = random.Random(8)
    rows = [(i // 2 - 5, t) for i, t in enumerate(texts(rng, 80) + ["", None, " ", "  x  ", "a▁b", "no tokens ▁", "x" * 5000, " " * 3000, "same words here", "same words here"])] + [(None, "nobody")]
    docs = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, pair string, block int").repartition(4)
    got = sorted((tuple(r) for r in alignment.align(docs, A, B).collect()), key=str)
    assert got == plain(own, rows)


def test_blocks_and_odd_rows(spark, odd, empty, own, monkeypatch):
    want = plain(own, [(r.doc_id, r.text) for r in odd.collect()])
    assert sorted((tuple(r) for r in alignment.align(odd, A, B).collect()), key=str) == want
    assert alignment.align(empty, A, B).collect() == []


def test_small_blocks(spark, own):
    rows = [(i, f"w{i % 3} and w{i % 5}") for i in range(30)]
    monkey = alignment.BLOCK
    try:
        alignment.BLOCK = 40
        got = alignment.align(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), A, B).collect()
    finally:
        alignment.BLOCK = monkey
    assert sorted((tuple(r) for r in got), key=str) == plain(own, rows)


def test_without_safe_splits_texts_are_whole(own, monkeypatch):
    with monkeypatch.context() as m:
        m.setattr(own, "splits", False)
        assert [own.segment(w) for w in own.words("a b")] == [" a b"]
        one = own.align(own.words("a b"))
    assert one == [";".join(own.align(["a", "b"]))]
    with open(A, encoding="utf-8") as f, open(B, "rb") as g:
        told, pieces = alignment.json.loads(f.read()), g.read()
    assert not own.splits_are_safe(told | {"normalizer": {"type": "NFC"}}, pieces)
    assert not own.splits_are_safe(told | {"pre_tokenizer": {"type": "ByteLevel", "use_regex": False}}, pieces)


def test_documents_of_the_table(spark, documents, own):
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    assert sorted((tuple(r) for r in alignment.align(documents, A, B).collect()), key=str) == plain(own, rows)
