"""License scans by diagonal voting.

All rolling word pairs of all texts are joined, by hash, to their positions in
a few templates. A hit votes for the diagonal (offset of text against
template) it lies on. A phrase is found where all of its pairs vote for one
diagonal. For a longer notice neighbouring diagonals are merged, as words are
added and dropped in copies, and the merged span is verified: the share of the
template's pairs it covers, and its length.

Defined cases: null and empty texts have no words and no places; rows that
repeat a doc_id and text give as many equal rows, with another text rows of
their own; a null doc_id is kept; an empty table gives an empty table; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from ..storage import small_batches
from .shingles import ALNUM, chunks, shingles, words

PAIR = 2
# Phrases that are looked for word by word, with their labels.
PHRASES = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)
# Beginnings of public licence notices, lower case, without punctuation, with labels of this method.
NOTICES = (
    ("licensed under the apache license version 2 0", "apache-2.0"),
    ("licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at", "apache-2.0"),
    ("licensed under the gnu general public license version 3", "gpl-3.0"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license", "gpl-3.0"),
    ("released under the mit license", "mit-notice"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", "mit-notice"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("licensed under a creative commons attribution 4 0 international license", "cc-by-4.0"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl-2.0"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice", "isc"),
    ("this program and the accompanying materials are made available under the terms of the eclipse public license", "epl"),
    ("to the extent possible under law the author has waived all copyright and related or neighboring rights to this work", "cc0"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
)
#: Diagonals of a notice that differ by at most SLACK words, with gaps of at most GAP, are one span.
SLACK, GAP = 3, 12
#: A diagonal of a notice needs VOTES hits, a span COVER of the template's pairs in at most STRETCH times its words.
VOTES, COVER, STRETCH = 2, 0.75, 2
#: The pairs that a template may have: what a diagonal has seen of it is a bit each.
MOST_PAIRS = 63
#: The template that every row meets once, so that rows without hits stay, and rows are counted.
EVERY = -1


def _pairs(text: str) -> list[int]:
    h, at = words(pa.array([text]), ALNUM)
    return [int(x) for x in shingles(h, at, PAIR, short=False)[0].view(np.int64)]


def templates(spark: SparkSession) -> DataFrame:
    """template, gram, at, n (pairs), label, exact: one row for each pair of a template."""
    rows = [(EVERY, 0, 0, 1, "", True)]
    for i, (text, label) in enumerate([*PHRASES, *NOTICES]):
        grams = _pairs(text)
        if len(grams) > MOST_PAIRS:
            raise ValueError(f"a template of {len(grams)} pairs; {MOST_PAIRS} is the most")
        rows += [(i, g, at, len(grams), label, i < len(PHRASES)) for at, g in enumerate(grams)]
    return spark.createDataFrame(rows, "template int, gram long, at int, n int, label string, exact boolean")


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in chunks(batch, "text", 1 << 20):
            h, at = words(part.column("text"), ALNUM)
            g, off = shingles(h, at, PAIR, short=False)
            g = np.where(g == 0, np.uint64(1), g)  # 0 is what every row meets
            n = len(part)
            # one more gram before each row's own, at position -1
            own = np.insert(g.view(np.int64), off[:-1], 0)
            grams = pa.ListArray.from_arrays((off + np.arange(n + 1)).astype(np.int32), own)
            yield pa.record_batch([part.column("doc_id"), part.column("text_key"), pa.array(np.diff(at), pa.int64()), grams], ["doc_id", "text_key", "n_words", "grams"])


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, spans of each row.

    spans are (label, exact, start, end, cover) in order: words start to
    end - 1 hold the phrase (exact) or a copy of the notice.
    """
    rows = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), F.col("text").cast("string").alias("text"))
    grams = rows.mapInArrow(_grams, "doc_id long, text_key long, n_words long, grams array<long>")
    hits = grams.select("doc_id", "text_key", "n_words", F.posexplode("grams").alias("p", "gram")).withColumn("pos", F.col("p") - 1)
    hits = hits.join(F.broadcast(templates(docs.sparkSession)), "gram")
    row = ["doc_id", "text_key", "n_words"]
    # votes by diagonal, summed before the shuffle; equal rows vote together
    votes = hits.groupBy(*row, "template", "n", "label", "exact", (F.col("pos") - F.col("at")).alias("diagonal")).agg(
        F.count("*").alias("votes"),
        F.min("pos").alias("first"),
        F.max("pos").alias("last"),
        F.bit_or(F.expr("shiftleft(1L, at)")).alias("mask"),
    )
    votes = votes.filter((F.col("template") == EVERY) | F.when(F.col("exact"), F.bit_count("mask") == F.col("n")).otherwise(F.bit_count("mask") >= F.least(F.lit(VOTES), "n")))
    # neighbouring diagonals of a notice; each place of a phrase is its own
    key = [*row, "template", "n", "label", "exact"]
    by, across = W.partitionBy(*row, "template").orderBy("first", "diagonal"), W.partitionBy(*row, "template").orderBy("diagonal")
    upto = W.unboundedPreceding
    # diagonals that others, elsewhere in the range, may stand between
    jump = F.col("exact") | F.lag("diagonal").over(across).isNull() | (F.col("diagonal") - F.lag("diagonal").over(across) > SLACK)
    spans = votes.withColumn("jump", jump.cast("int")).withColumn("near", F.sum("jump").over(across.rowsBetween(upto, 0)))
    within = W.partitionBy(*row, "template", "near").orderBy("first", "diagonal")
    reached = F.max("last").over(within.rowsBetween(upto, -1))
    spans = spans.withColumn("gap", (reached.isNull() | (F.col("first") - reached > GAP)).cast("int")).withColumn("whole", F.sum("gap").over(within.rowsBetween(upto, 0)))
    # parts of these: rows that follow each other on neighbouring diagonals
    apart = F.col("exact") | F.lag("diagonal").over(by).isNull() | (F.abs(F.col("diagonal") - F.lag("diagonal").over(by)) > SLACK) | (F.col("first") - F.lag("last").over(by) > GAP)
    spans = spans.withColumn("apart", apart.cast("int")).withColumn("span", F.sum("apart").over(by.rowsBetween(upto, 0)))
    spans = spans.groupBy(*key, "near", "whole", "span").agg(F.max("votes").alias("votes"), F.min("first").alias("start"), (F.max("last") + PAIR).alias("end"), F.bit_or("mask").alias("mask"))
    part = F.struct("votes", "start", "end", "mask")
    spans = spans.groupBy(*key, "near", "whole").agg(F.struct(F.max("votes").alias("votes"), F.min("start").alias("start"), F.max("end").alias("end"), F.bit_or("mask").alias("mask")).alias("all"), F.collect_list(part).alias("parts"))
    holds = lambda x: (F.col("template") == EVERY) | F.col("exact") | ((F.bit_count(x["mask"]) / F.col("n") >= COVER) & (x["end"] - x["start"] <= STRETCH * (F.col("n") + 1)))
    # the parts stand for a span that does not hold
    spans = spans.select(*key, F.inline(F.when(holds(F.col("all")), F.array("all")).otherwise(F.filter("parts", holds))))
    spans = spans.withColumn("cover", F.bit_count("mask") / F.col("n"))
    found = F.struct("label", "exact", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), "cover")
    out = spans.groupBy(*row).agg(F.sort_array(F.collect_list(F.when(F.col("template") != EVERY, found))).alias("spans"), F.max(F.when(F.col("template") == EVERY, F.col("votes"))).alias("copies"))
    return out.withColumn("copy", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int")))).select("doc_id", "n_words", "spans")
