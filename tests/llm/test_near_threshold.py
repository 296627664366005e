"""Near-duplicate classes against all pairs at thresholds other than that of op10."""

import random

from hashloom.llm import neardup
from test_neardup import shingle_set


def groups(rows, least):
    """{doc_id: smallest doc_id of its group}, links of least hundredths or more."""
    sets, root = [shingle_set(t) for _, t in rows], list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= least * len(a | b):
                root[find(i)] = find(j)
    least_id = {}
    for i, (d, _) in enumerate(rows):
        least_id[find(i)] = min(d, least_id.get(find(i), d))
    return {d: least_id[find(i)] for i, (d, _) in enumerate(rows)}


def made(spark):
    """Pairs of texts with 100 shingles and 70 to 99 of them, and texts with a common passage."""
    rng = random.Random(5)
    words = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    texts, passage = [], words(300)
    for cut in range(1, 31):
        base = words(104)
        texts += [base, base[: 104 - cut]]
    texts += [words(60) + passage + words(60) for _ in range(10)]
    rng.shuffle(texts)
    return spark.createDataFrame([(i * 7 % 1009, " ".join(t), "en", "a", 0) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)


def test_operator_takes_the_threshold(spark):
    df = made(spark)
    rows = [(r.doc_id, r.text) for r in df.collect()]
    assert len(set(groups(rows, 80).values())) == len(set(groups(rows, 85).values())) - 5
    for least in (80, 85):
        assert {r.doc_id: r.component_id for r in neardup.near_duplicates(df, least).collect()} == groups(rows, least)
    assert {r.doc_id: r.component_id for r in neardup.near_duplicates(df).collect()} == groups(rows, 85)
