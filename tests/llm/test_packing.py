"""Lossless packing."""

import time

import numpy as np
import public_tokenizers
import pytest

from hashloom.llm import packing


def unpacked(rows, length, kind):
    docs = {}
    for r in rows:
        ids = np.frombuffer(bytes(r.ids), kind)
        assert len(ids) == length and r.cu_seqlens[-1] == r.n_tokens <= length and r.cu_seqlens[:-1] == r.position_resets
        for a, b, d, s in zip(r.cu_seqlens[:-1], r.cu_seqlens[1:], r.doc_ids, r.doc_starts, strict=True):
            docs.setdefault(d, []).append((s, ids[a:b].tolist()))
    return docs


@pytest.mark.parametrize("length", [64, 2048])
def test_documents_come_back(spark, documents, texts, length):
    tokenize, end = packing.rank_file(documents, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    own = packing.ranked(open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb").read(), public_tokenizers.PATTERN)
    packed = packing.pack(documents, tokenize, end, length, 20_000)
    docs = unpacked(packed.collect(), length, "<u2")
    assert set(docs) == set(texts)
    for d, pieces in docs.items():
        ids = []
        for s, part in sorted(pieces):
            assert s == len(ids)
            ids += part
        assert ids[-1] == end and own.decode(ids[:-1]) == texts[d]


def test_odd(odd, nobody):
    def tokenize(texts):
        return [np.frombuffer(t.encode(), np.uint8).astype(np.uint32) for t in texts]

    rows = odd.unionByName(nobody)
    docs = unpacked(packing.pack(rows, tokenize, 70_000, 1000).collect(), 1000, "<u4")
    want = {}
    for r in rows.collect():
        want.setdefault(r.doc_id, []).append(len((r.text or "").encode()) + 1)
    assert {d: sum(len(x) for _, x in p) for d, p in docs.items()} == {d: sum(n) for d, n in want.items()}


def test_empty(empty):
    assert packing.pack(empty, lambda t: [], 1).count() == 0


def test_best_fit():
    rng = np.random.default_rng(1)
    for _ in range(30):
        sizes = rng.integers(1, 101, rng.integers(1, 200))
        rows = packing.best_fit(sizes, 100)
        assert sorted(i for r in rows for i in r) == list(range(len(sizes)))
        room, want = [], []
        for i in np.argsort(-sizes, kind="stable"):  # a plain search for the fullest row that fits
            fit = [j for j, x in enumerate(room) if x >= sizes[i]]
            j = min(fit, key=lambda j: room[j]) if fit else len(room)
            room[j:] = [100] if j == len(room) else room[j:]
            room[j] -= sizes[i]
        assert len(rows) == len(room) and sorted(100 - sum(sizes[r]) for r in rows) == sorted(room)


def test_positions():
    assert packing.position_ids(6, [0, 2, 5]).tolist() == [0, 1, 0, 1, 2, 0]


def test_long_runs():
    rng, path = np.random.default_rng(4), public_tokenizers.path("byte_bpe_50k.tiktoken")
    with open(path, "rb") as f:
        own = packing.ranked(f.read(), public_tokenizers.PATTERN)
    for n in (63, 64, 65, 9_999, 10_000, 10_001, 20_000):  # the same as the tokenizer, where that can do it
        for kind in (" ", "\n", "　", "\n ", "\x1c"):
            for before, after in (("", ""), ("a", ""), ("", "b"), ("a'", "'s b"), (" . ", "1"), ("a", "\x1cb")):
                t = before + kind * n + after
                assert packing.encode_text(own, t) == own.encode_ordinary(t), (n, kind, before, after)
    for kind in ("a", " ", "\n", "\n ", "\U0001f642", "1", ".", "".join(map(chr, rng.integers(97, 123, 1000)))):
        t = kind * (4_000_000 // len(kind.encode()))
        assert own.decode(packing.encode_text(own, t)) == t


def test_many_runs_take_time_in_proportion():
    """1 MB of runs that are long, but not very long."""
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        own = packing.ranked(f.read(), public_tokenizers.PATTERN)
    for n in (60, 70, 500, 9_999):
        t = ("x" + " " * n) * (1_000_000 // n)
        began = time.process_time()
        assert own.decode(packing.encode_text(own, t)) == t
        assert time.process_time() - began < 1.5, n


def test_flat_matrices_come_back(spark, documents, tmp_path):
    tokenize, end = packing.rank_file(documents, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    packed = packing.pack(documents, tokenize, end, 256, 10_000)
    packing.write_packed(packed, str(tmp_path / "packed"))
    rows = spark.read.parquet(str(tmp_path / "packed")).collect()
    got = {(r.shard, r.first_pack + k): (ids.tobytes(), cu, resets, ids_of, starts) for r in rows for k, (ids, cu, resets, ids_of, starts) in enumerate(packing.unflat(r, 256, "<u2"))}
    assert got == {(r.shard, r.pack): (bytes(r.ids), r.cu_seqlens, r.position_resets, r.doc_ids, r.doc_starts) for r in packed.collect()}
    assert len(rows) < len(got)
