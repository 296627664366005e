"""Classes against all pairs by brute force."""

import random
import re

from hashloom.llm import neardup


def shingle_set(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m[0].lower(), t or ""))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) or (frozenset([tuple(w)]) if w else frozenset())


def brute(rows):
    """[(doc_id, n_shingles, component_id, kept)]."""
    sets = [shingle_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            same_id = rows[i][0] is not None and rows[i][0] == rows[j][0]
            if rows[i][0] is None or rows[j][0] is None or not a or not b:
                continue
            if same_id or (min(len(a), len(b)) * 100 >= 85 * max(len(a), len(b)) and 100 * len(a & b) >= 85 * len(a | b)):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None and sets[i]:
            least[find(i)] = min(d, least.get(find(i), d))
    out = []
    for i, (d, _) in enumerate(rows):
        c = None if d is None else least[find(i)] if sets[i] else d
        out.append((d, len(sets[i]), c, d == c))
    return out


def check(df):
    rows = [(r.doc_id, r.text) for r in df.collect()]
    got = [tuple(r) for r in neardup.near_duplicates(df).select("doc_id", "n_shingles", "component_id", "kept").collect()]
    assert sorted(got, key=str) == sorted(brute(rows), key=str)


def test_documents(documents):
    check(documents)


def test_odd(odd, nobody):
    check(odd.unionByName(nobody))


def test_empty(empty):
    assert neardup.near_duplicates(empty).count() == 0


def test_chains_thresholds_and_shared_passages(spark):
    rng = random.Random(11)
    words = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    rows, passage = [], words(300)
    base = words(104)  # 100 shingles
    for cut in range(0, 14):  # a truncated copy has (100 - cut) of 100 shingles
        rows.append(base[: 104 - cut])
    for _ in range(30):  # the passage is most of the text, yet no two are near
        rows.append(words(40) + passage + words(40))
    chain = words(200)
    for _ in range(15):  # each near the one before, the ends far apart
        rows.append(list(chain))
        chain[rng.randrange(200)] = words(1)[0]
        chain[rng.randrange(200)] = words(1)[0]
    rng.shuffle(rows)
    df = spark.createDataFrame([(i * 3 % 1009, " ".join(r)) for i, r in enumerate(rows)], "doc_id long, text string")
    check(df.repartition(4))


def test_parity_maps_never_deny_a_link(spark):
    import numpy as np
    from pyspark.sql import functions as F

    rng, rows = np.random.default_rng(3), []
    for _ in range(300):
        n = int(rng.integers(1, 800))
        a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64) * np.uint64(2))
        d = int(rng.integers(0, max(1, len(a) // 6)))
        b = np.unique(np.concatenate([a[d:], rng.integers(0, 1 << 63, int(rng.integers(0, d + 1))).astype(np.uint64)]))
        rows.append((neardup.parities(a).tolist(), neardup.parities(b).tolist(), len(a) + len(b), bool(100 * len(np.intersect1d(a, b)) >= 85 * len(np.union1d(a, b))), len(np.setxor1d(a, b))))
    df = spark.createDataFrame(rows, "a array<long>, b array<long>, size long, link boolean, apart long")
    got = df.withColumn("may", neardup.may_link(F.col("a"), F.col("b"), F.col("size"))).collect()
    assert all(r.may for r in got if r.link) and any(r.link for r in got)
    assert sum(r.may for r in got if not r.link) < sum(not r.link for r in got) / 2


def counted(monkeypatch):
    """The pairs that were confirmed, added up while the test runs."""
    tried, own = [], neardup.confirm

    def confirm(pairs, sets, *args):
        tried.append(pairs.count())
        return own(pairs, sets, *args)

    monkeypatch.setattr(neardup, "confirm", confirm)
    return tried


def test_template_pages_try_few_pairs(spark, monkeypatch):
    """Long pages of the same blocks, most pairs of which just miss the threshold."""
    rng, tried = random.Random(8), counted(monkeypatch)
    blocks = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(250)) for _ in range(40)]
    rows = [(i, " ".join(b for j, b in enumerate(blocks) if j not in gone)) for i, gone in enumerate(set(rng.sample(range(40), 6)) for _ in range(80))]
    check(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    assert sum(tried) < 80 * 79 / 2 / 10


def test_common_passages_try_few_pairs(spark, monkeypatch):
    """A passage in every text, nearly but not quite enough to link them, around copies of some."""
    rng, tried = random.Random(9), counted(monkeypatch)
    words = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    passage = words(150)
    rows = [(i, f"{words(15)} {passage} {words(15)}") for i in range(200)]
    rows += [(1000 + i, rows[i][1] + " tail") for i in range(0, 200, 5)]
    check(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    assert sum(tried) < 240 * 239 / 2 / 4


def test_hot_centres_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(neardup, "CROWD", 5)
    rng = random.Random(10)
    base = [f"w{rng.randrange(10**6)}" for _ in range(150)]
    rows = [(i, " ".join(base[:k] + [f"x{i}"] + base[k + 1 :])) for i, k in enumerate(rng.choices(range(5, 145), k=60))]
    check(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))


def test_large_parity_maps_never_deny_a_link(spark):
    import numpy as np
    from pyspark.sql import functions as F

    rng, rows = np.random.default_rng(7), []
    for _ in range(150):
        n = int(rng.integers(900, 9000))
        a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64) * np.uint64(2))
        d = int(rng.integers(0, n // 4))
        b = np.unique(np.concatenate([a[d:], rng.integers(0, 1 << 63, int(rng.integers(0, d + 1))).astype(np.uint64)]))
        link = bool(100 * len(np.intersect1d(a, b)) >= 85 * len(np.union1d(a, b)))
        rows.append((*(neardup.parities(s, neardup.map_words(len(s))).tolist() for s in (a, b)), len(a) + len(b), link))
    df = spark.createDataFrame(rows, "a array<long>, b array<long>, size long, link boolean")
    got = df.withColumn("may", neardup.may_link_large(F.col("a"), F.col("b"), F.col("size"))).collect()
    assert all(r.may for r in got if r.link) and any(r.link for r in got)
    assert sum(r.may for r in got if not r.link) < sum(not r.link for r in got) / 2
    assert any(len(r.a) != len(r.b) for r in got)


def test_pieces_of_any_size_give_the_same_words(monkeypatch):
    """Texts far longer than a piece are cut, between words and within long ones, without a trace."""
    import numpy as np
    import pyarrow as pa
    from hashloom.llm import shingles

    rng = random.Random(12)
    texts = ["".join(rng.choice("ab \n") for _ in range(rng.randrange(300))) for _ in range(60)] + ["x" * 500, "", " " * 200, "é" * 90 + " y"]
    want = shingles.words(pa.array(texts), shingles.SPACED)
    for size in (4, 16, 64):
        monkeypatch.setattr(shingles, "PIECE", size)
        got = shingles.words(pa.array(texts), shingles.SPACED)
        assert all(np.array_equal(a, b) for a, b in zip(got, want, strict=True))


def test_rows_are_decided_one_by_one(spark, odd, nobody):
    from pyspark.sql import functions as F

    key = lambda text: F.md5(F.coalesce(F.concat(F.lit("="), text), F.lit("")).cast("binary"))
    long = " ".join(f"w{i}" for i in range(60))
    rows = [(9, "a text of its own that no other has"), (9, long), (3, long + " tail"), (None, long), (None, "another text without an id at all"), (9, long)]
    df = odd.unionByName(nobody).select("doc_id", "text").unionByName(spark.createDataFrame(rows, "doc_id long, text string")).withColumn("k", key(F.col("text")))
    got = {(r.doc_id, r.row_key): r.kept for r in neardup.row_decisions(df, key).collect()}
    texts = {(r.doc_id, r.k): r.text for r in df.collect()}
    own = sorted(texts, key=lambda x: (x[0] is None, x[0] or 0, x[1]))
    classes = brute([(i, texts[x]) for i, x in enumerate(own)])
    assert got == {own[i]: kept for i, _, _, kept in classes}
