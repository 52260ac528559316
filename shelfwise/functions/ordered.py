"""Ordered-per-key computations that survive a hot key.

A plain ``lag`` sorts every row of a key in one task, and a plain ``RANGE`` minimum also
re-scans its frame for every row. Here time is cut into buckets and rows are dealt and
windowed per (key, bucket), whatever the key's size. What crosses a bucket edge comes from one
summary row per bucket, worked out per key over those rows alone and joined back to the bucket.
Rows and summaries read the same shuffle, so the input is scanned and shuffled once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKET, HASH = "_bucket", "_hash"
HOUR = 3600


def _bucket_of(ts: str, seconds: int) -> Column:
    return F.coalesce(F.floor(F.unix_seconds(F.col(ts)) / F.lit(seconds)), F.lit(-(1 << 62)))


def _named(keys: Sequence[str]) -> dict[str, Column]:
    """Keys as text that is never NULL: a join on them then adds no filter that would tell two readers of one shuffle apart."""
    return {f"_key{i}": F.coalesce(F.col(k).cast("string"), F.lit("\0")) for i, k in enumerate(keys)}


def ordered_lag(
    df: DataFrame, keys: Sequence[str], ts: str, ties: Sequence[str], value: str, out: str, bucket_seconds: int = HOUR
) -> DataFrame:
    """Previous ``value`` per key in (ts, ties) order, equal to ``lag`` over the whole key."""
    names = _named(keys)
    group = [*names, BUCKET]
    dealt = df.withColumns(names | {BUCKET: _bucket_of(ts, bucket_seconds)}).repartition(*group)
    order = [ts, *ties]
    # the last row of a bucket is kept whole: with equal columns both readers share the shuffle
    edges = dealt.groupBy(*group).agg(F.max_by(F.struct(*df.columns), F.struct(*order)).alias("_edge"))
    across = Window.partitionBy(*names).orderBy(BUCKET)
    carried = edges.select(*group, F.lag("_edge").over(across)[value].alias("_carry"))
    inside = Window.partitionBy(*group).orderBy(*order)
    placed = dealt.withColumn("_n", F.row_number().over(inside)).withColumn("_lag", F.lag(value).over(inside))
    previous = F.when(F.col("_n") == 1, F.col("_carry")).otherwise(F.col("_lag"))
    return placed.join(carried, group, "left").withColumn(out, previous).select(*df.columns, out)


def ordered_range_min(
    df: DataFrame, keys: Sequence[str], ts: str, value: str, out: str, span_seconds: int = 24 * HOUR, bucket_seconds: int = HOUR
) -> DataFrame:
    """Minimum of ``value`` over ``[ts - span, ts]`` per key, peers included.

    The frame of a row splits into three parts: rows of its own bucket up to ``ts`` (a
    running minimum), whole buckets strictly inside the frame (from the summary rows), and the
    tail of the bucket exactly one span earlier (a running minimum from the other end over
    copies of those rows moved forward by the span).
    """
    if span_seconds % bucket_seconds:
        raise ValueError("the span must be a whole number of buckets")
    steps = span_seconds // bucket_seconds
    names = _named(keys) if steps > 1 else {k: F.col(k) for k in keys}
    slim = [c for c in df.columns if c not in (value, ts, *names)]
    # a number leads the group: sorting tells most rows apart by eight bytes, and texts often begin alike
    group = [HASH, *names, BUCKET]
    # one scan yields both the row and its moved copy; the copy carries only what the minimum needs
    copies = df.withColumns(names).withColumn("_moved", F.explode(F.array(F.lit(0), F.lit(1))))
    dealt = copies.select(
        F.xxhash64(*names).alias(HASH),
        *names,
        value,
        *[F.when(F.col("_moved") == 0, F.col(c)).alias(c) for c in slim],
        (_bucket_of(ts, bucket_seconds) + F.col("_moved") * steps).alias(BUCKET),
        (F.unix_micros(F.col(ts)) + F.col("_moved") * (span_seconds * 1_000_000)).alias("_at"),
        "_moved",
    ).repartition(*group)
    upto = Window.partitionBy(*group).orderBy(F.col("_at").asc())
    since = Window.partitionBy(*group).orderBy(F.col("_at").desc())
    moved = F.col("_moved") == 1
    # copies have served once the tail is known, so the second order is one of the rows alone
    found = dealt.withColumn("_tail", F.min(F.when(moved, F.col(value))).over(since)).filter(~moved)
    found = found.withColumn("_head", F.min(value).over(upto))
    if steps > 1:
        # the whole row is read, as above, so that the shuffle is shared
        least = F.min(F.when(~moved, F.struct(value, "_at", *slim))).alias("_least")
        between = Window.partitionBy(*names).orderBy(BUCKET).rangeBetween(-(steps - 1), -1)
        inner = dealt.groupBy(*group).agg(least).select(*group, F.min(F.col("_least")[value]).over(between).alias("_inner"))
        found = found.join(inner, group, "left")
    else:
        found = found.withColumn("_inner", F.lit(None))
    found = found.withColumns({out: F.least("_head", "_tail", "_inner"), ts: F.timestamp_micros("_at")})
    return found.select(*df.columns, out)
