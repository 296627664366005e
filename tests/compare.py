"""Rows of two engines as sorted lines that can be compared."""

import math


def shown(v) -> str:
    if v is None or isinstance(v, float) and math.isnan(v):
        return "-"
    if isinstance(v, float):
        return f"{v:.9g}"
    if isinstance(v, list | tuple):
        return "[" + ",".join(map(shown, v)) + "]"
    return str(v)


def lines(columns, rows) -> list[str]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted("|".join(shown(r[i]) for i in order) for r in rows)


def agrees(query, sql, spark, sf_dir, duck) -> None:
    df = query(spark, sf_dir)
    told = duck.execute(sql)
    columns = [d[0] for d in told.description]
    assert sorted(columns) == sorted(df.columns)
    assert lines(df.columns, df.collect()) == lines(columns, told.fetchall())
