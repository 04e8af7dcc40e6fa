"""Running columns over series of any length: sums, extremes, last known values, and the row before.

A window by symbol puts a whole series into one task. Here it is cut into buckets of time. Within a bucket a
running column is a window; what a bucket comes to as a whole is one row, these rows are folded in order, and each
bucket's rows are combined with what came before it. All that goes through one task is a row for each bucket of a
series. Any number of columns shares one pass, and passes that follow one another share the buckets' shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce
from operator import and_
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from barloom.operators.joins import broadcast_up_to
from barloom.sources.shared import checkpointed

#: Hours of a bucket.
HOURS = 720
#: So many buckets' rows are broadcast at most.
BROADCAST_BUCKETS = 100_000


class Running(NamedTuple):
    """A column over the rows so far: ``kind`` is last (the last known value), sum, max, or peak (the highest running sum)."""

    kind: str
    source: Column


class _Kind(NamedTuple):
    """How a running column is worked out: inside a bucket, what a whole bucket comes to, over the buckets before, and both together."""

    inside: Callable[[str, WindowSpec], Column]
    whole: Callable[[str, Column], Column]
    before: Callable[[str, WindowSpec], Column]
    both: Callable[[Column, Column], Column]


def _added(a: Column, b: Column) -> Column:
    return F.coalesce(a + b, a, b)


KINDS = {
    "last": _Kind(
        lambda x, so_far: F.last(x, ignorenulls=True).over(so_far), lambda x, order: F.max_by(x, F.when(F.col(x).isNotNull(), order)),
        lambda x, earlier: F.last(x, ignorenulls=True).over(earlier), lambda own, before: F.coalesce(own, before),
    ),
    "sum": _Kind(lambda x, so_far: F.sum(x).over(so_far), lambda x, order: F.sum(x), lambda x, earlier: F.sum(x).over(earlier), _added),
    "max": _Kind(lambda x, so_far: F.max(x).over(so_far), lambda x, order: F.max(x), lambda x, earlier: F.max(x).over(earlier), F.greatest),
}


def bucket(ts: str, hours: int = HOURS) -> Column:
    """The number of the bucket of a time; rows without one come first."""
    return F.coalesce(F.floor(F.unix_micros(F.col(ts).cast("timestamp")) / F.lit(hours * 3_600_000_000)), F.lit(-(1 << 62)))


def met(keys: Sequence[str], suffix: str) -> Column:
    """Equal keys, null ones too."""
    return reduce(and_, [F.col(key).eqNullSafe(F.col(f"{key}{suffix}")) for key in keys])


def scanned(
    df: DataFrame, running: Mapping[str, Running] | None = None, previous: Mapping[str, str] | None = None, keys: Sequence[str] = ("sym",), ts: str = "bar_ts", hours: int = HOURS
) -> DataFrame:
    """``df`` with ``running`` columns, and the value that the columns named by ``previous`` (of ``df`` or ``running``) have on the row before.

    Rows must be unique by (keys, ts). Sums and peaks of nulls alone are null; the first row has null before it.
    """
    running, previous, at = dict(running or {}), dict(previous or {}), "__bucket"
    inside = Window.partitionBy(*keys, at).orderBy(ts)
    so_far = inside.rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy(*keys).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    sources = {f"__x{i}": run.source for i, run in enumerate(running.values())}
    marked = df.withColumn(at, bucket(ts, hours)).withColumns(sources)
    order, local, wholes, folded = F.col(ts), {}, [F.count(F.lit(1)).alias("__n")], {}
    for i, (name, run) in enumerate(running.items()):
        kind = KINDS["sum" if run.kind == "peak" else run.kind]
        local[f"__s{i}"] = kind.inside(f"__x{i}", so_far)
        wholes.append(kind.whole(f"__x{i}", order).alias(f"__w{i}"))
        folded[f"__c{i}"] = kind.before(f"__w{i}", earlier)
    marked = marked.withColumns(local)
    peaks = [i for i, run in enumerate(running.values()) if run.kind == "peak"]
    marked = marked.withColumns({f"__p{i}": F.max(f"__s{i}").over(so_far) for i in peaks})
    wholes += [F.max(f"__s{i}").alias(f"__t{i}") for i in peaks]
    wholes += [F.max_by(F.struct(F.col(name).alias("x")), F.struct(F.col(ts).isNotNull(), ts)).alias(f"__e{j}") for j, name in enumerate(previous.values()) if name not in running]
    ends = marked.groupBy(*keys, at).agg(*wholes).withColumns(folded)
    ends = ends.withColumns({f"__h{i}": F.max(_added(F.col(f"__t{i}"), F.col(f"__c{i}"))).over(earlier) for i in peaks})
    final = {}  # what each running column is on a bucket's last row
    for i, (name, run) in enumerate(running.items()):
        if run.kind == "peak":
            final[name] = F.greatest(_added(F.col(f"__t{i}"), F.col(f"__c{i}")), F.col(f"__h{i}"))
        else:
            final[name] = KINDS[run.kind].both(F.col(f"__w{i}"), F.col(f"__c{i}"))
    last = {f"__l{j}": final[name] if name in running else F.col(f"__e{j}.x") for j, name in enumerate(previous.values())}
    ends = ends.withColumns(last).withColumns({f"__b{j}": F.lag(f"__l{j}").over(Window.partitionBy(*keys).orderBy(at)) for j in range(len(previous))})
    kept = [*(f"__c{i}" for i in range(len(running))), *(f"__h{i}" for i in peaks), *(f"__b{j}" for j in range(len(previous)))]
    carried = ends.select(*[F.col(key).alias(f"{key}__of") for key in (*keys, at)], *kept)
    joined = marked.join(broadcast_up_to(checkpointed(carried), BROADCAST_BUCKETS), met([*keys, at], "__of"))
    made = {}
    for i, (name, run) in enumerate(running.items()):
        if run.kind == "peak":
            made[name] = F.greatest(_added(F.col(f"__p{i}"), F.col(f"__c{i}")), F.col(f"__h{i}"))
        else:
            made[name] = KINDS[run.kind].both(F.col(f"__s{i}"), F.col(f"__c{i}"))
    whole = joined.withColumns(made) if made else joined
    first = F.row_number().over(inside) == 1
    shifted = {name: F.when(first, F.col(f"__b{j}")).otherwise(F.lag(source).over(inside)) for j, (name, source) in enumerate(previous.items())}
    names = [*df.columns, *[name for name in (*made, *shifted) if name not in df.columns]]
    return (whole.withColumns(shifted) if shifted else whole).select(*names)
