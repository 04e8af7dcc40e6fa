"""Comparing a query's rows with those of its SQL."""

import datetime as dt
import decimal
import math

SHOWN = 3


def plain(value: object) -> object:
    """A value in a form that both engines share: whole numbers digit by digit, others as floats of nine digits, the rest as text."""
    if value is None or isinstance(value, float) and math.isnan(value):
        return "null"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, int):
        return str(value)
    if isinstance(value, (float, decimal.Decimal)):
        return f"{float(value):.9g}" if value else "0"
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, (list, tuple)):
        return [plain(x) for x in value]
    return str(value)


def rows(columns: list[str], values: list) -> list:
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(repr([plain(row[at]) for at in order]) for row in values)


def assert_same(df, relation) -> None:
    """The same columns and the same rows, in any order."""
    names = [column[0] for column in relation.description]
    assert sorted(df.columns) == sorted(names)
    ours, theirs = rows(df.columns, [list(row) for row in df.collect()]), rows(names, relation.fetchall())
    assert len(ours) == len(theirs)
    assert ours == theirs, ([x for x in ours if x not in theirs][:SHOWN], [x for x in theirs if x not in ours][:SHOWN])
