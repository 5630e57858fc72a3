"""Rows of a query and of its SQL in one comparable form."""

import datetime
import decimal
from collections import Counter


def plain(v):
    if isinstance(v, bool) or v is None:
        return str(v)
    if isinstance(v, (float, decimal.Decimal)):
        return "nan" if v != v else f"{float(v):.6g}"
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(plain, v)) + "]"
    if isinstance(v, dict):
        return str(sorted((k, plain(x)) for k, x in v.items()))
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return repr(v)


def assert_same_rows(df, result):
    """``result`` is an executed DuckDB statement."""
    names = [d[0] for d in result.description]
    assert sorted(names) == sorted(df.columns)
    want = Counter(tuple(plain(r[names.index(c)]) for c in df.columns) for r in result.fetchall())
    got = Counter(tuple(plain(r[c]) for c in df.columns) for r in df.collect())
    assert got == want
