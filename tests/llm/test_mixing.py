"""Targets, thresholds, and what the mix takes."""

import hashlib
import re
from collections import defaultdict

import pytest

from hashloom.llm import mixing


def brute(rows, weights=(5, 2, 1)):
    """{(doc_id, source): (size, source_size, target, taken)} by water filling and a sort."""
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    of = defaultdict(list)
    for d, t, s in rows:
        of[s].append((int(hashlib.md5(b"" if d is None else str(d).encode()).hexdigest()[:15], 16), d, size(t)))
    names = sorted(of, key=lambda s: (s is None, s or ""))
    total = {s: sum(x[2] for x in own) for s, own in of.items()}
    w, target, open_ = {s: weights[i % 3] for i, s in enumerate(names)}, {}, set(names)
    rest = sum(total.values()) * 3 / 2
    while open_:
        each = rest / sum(w[s] for s in open_)
        full = {s for s in open_ if each * w[s] > 2 * total[s] + 1e-9}
        if not full:
            target |= {s: each * w[s] for s in open_}
            break
        target |= {s: 2.0 * total[s] for s in full}
        rest -= sum(2 * total[s] for s in full)
        open_ -= full
    out = {}
    for s, own in of.items():
        copies = int(target[s] > total[s] + 1e-9)
        budget, before = target[s] - copies * total[s], 0
        by_hash = defaultdict(list)
        for h, d, n in own:
            by_hash[h].append((d, n))
        for h in sorted(by_hash):
            words = sum(n for _, n in by_hash[h])
            extra = before < budget and 2 * (budget - before) >= words
            before += words
            for d, n in by_hash[h]:
                out[d, s] = (n, total[s], target[s], n * (copies + extra))
    return out


def check(df):
    rows = [(r.doc_id, r.text, r.source) for r in df.collect()]
    got, _ = mixing.mix(df)
    want = brute(rows)
    found = got.collect()
    assert len(found) == len(rows)
    for r in found:
        n, total, target, taken = want[r.doc_id, r.source]
        assert (r.size, r.source_size, r["size"] * r.repeats) == (n, total, taken)
        assert r.target == pytest.approx(target, rel=1e-9)
        assert r.repeats <= 2


def test_odd(odd):
    check(odd)


def test_documents(documents):
    check(documents)


def test_no_id(odd, nobody):
    check(odd.unionByName(nobody))


def test_empty(empty):
    assert mixing.mix(empty)[0].count() == 0
    assert mixing.mixed_documents(empty).count() == 0


def test_near_targets_and_copies(documents):
    got, _ = mixing.mix(documents)
    sums, largest, target = defaultdict(int), defaultdict(int), {}
    want = defaultdict(int)
    for r in got.collect():
        sums[r.source] += r["size"] * r.repeats
        largest[r.source] = max(largest[r.source], r["size"])
        target[r.source] = r.target
        want[r.doc_id] += r.repeats
    assert all(abs(sums[s] - target[s]) <= largest[s] for s in target)
    out = mixing.mixed_documents(documents)
    assert out.columns == documents.columns
    have = {r.doc_id: r["count"] for r in out.groupBy("doc_id").count().collect()}
    assert have == {d: n for d, n in want.items() if n}
