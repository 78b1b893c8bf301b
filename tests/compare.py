"""Rows as sorted tuples of texts, columns by name."""

import math


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "NULL"
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        return str(int(v)) if v == int(v) else f"{v:.6f}"
    if isinstance(v, (list, tuple)):
        return str([plain(x) for x in v])
    return str(v)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(tuple(plain(r[k]) for k in order) for r in data)


def same(df, relation):
    """True if a Spark result has the columns and rows of a DuckDB one."""
    names = [d[0] for d in relation.description]
    got, wanted = rows(df.columns, [tuple(r) for r in df.collect()]), rows(names, relation.fetchall())
    assert sorted(df.columns) == sorted(names)
    assert got == wanted, ([x for x in got if x not in set(wanted)][:3], [x for x in wanted if x not in set(got)][:3])
