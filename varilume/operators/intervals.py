"""Interval joins by bins, unions of intervals, and the last interval at or before a point."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Width of a bin, in bases.
BIN = 2048
#: Rows that span more bins are joined on coarser bins, so no row is copied more often than this.
MOST_BINS = 64
#: Bases that unions and searches for the last interval put in order at once.
STRETCH = 1 << 18


def _levels(start: Column, end: Column, width: int) -> Column:
    """How many times the bin width has to grow 64-fold so that the span meets MOST_BINS bins at most."""
    span = F.floor((end - start) / width)
    return F.when(span < MOST_BINS, 0).when(span < MOST_BINS * 64, 1).when(span < MOST_BINS * 4096, 2).otherwise(3)


def _present(df: DataFrame, level: Column) -> list[int]:
    """Levels that rows of df live on: one small aggregate over the spans alone. A stream may hold all."""
    if df.isStreaming:
        return [0, 1, 2, 3]
    return sorted(df.agg(F.collect_set(level)).first()[0])


def overlap_join(left: DataFrame, right: DataFrame, region: str, left_span: tuple[str, str], right_span: tuple[str, str], halo: int = 0, width: int = BIN, how: str = "inner") -> DataFrame:
    """Pairs of the same region whose closed intervals overlap, the left one widened by halo.

    Both sides are dealt by (region, level, bin), an equi-join; the overlap is checked on each pair, and a pair counts in the
    first bin that both meet, so that none comes twice. Rows that span many bins use bins of 64, 4096.. times the
    width. A left row stands at its own level, and at those coarser ones alone on which right rows live, so that the left side,
    meant to be the large one, isn't copied where the right one is short; a right row stands at all coarser levels. Column names of the two sides must differ but for region.
    Spans may be reversed by one (interbase sites). Null regions or ends pair with nothing. The sides meet by a sort-merge join: the
    size of the right one is guessed from its files, which its generated columns and copies outgrow, and a broadcast of it would pass through the driver.
    """
    ls, le = (F.least(F.col(left_span[0]), F.col(left_span[1])) - halo).cast("long"), (F.greatest(F.col(left_span[0]), F.col(left_span[1])) + halo).cast("long")
    rs, re_ = F.least(F.col(right_span[0]), F.col(right_span[1])).cast("long"), F.greatest(F.col(right_span[0]), F.col(right_span[1])).cast("long")
    right_levels = _present(right, _levels(rs, re_, width))
    lefts = left.withColumns({"_ls": ls, "_le": le}).withColumn("_lv", _levels(F.col("_ls"), F.col("_le"), width))
    rights = right.withColumns({"_rs": rs, "_re": re_}).withColumn("_rv", _levels(F.col("_rs"), F.col("_re"), width))
    size = lambda level: F.lit(width).cast("long") * F.pow(F.lit(64), level).cast("long")
    # a pair meets at the coarser of its two levels, where at least one of them is at home: tag 0 pairs a left one
    # that is with any right one, tag 1 a left one that isn't with a right one that is
    up = lambda own, others: F.explode(F.concat(F.array(own), F.filter(F.array(*(F.lit(x) for x in others)).cast("array<int>"), lambda x: x > own)))
    lefts = lefts.withColumn("_lvl", up(F.col("_lv"), right_levels)).withColumns({"_w": size(F.col("_lvl")), "_tag": (F.col("_lvl") != F.col("_lv")).cast("int")})
    lefts = lefts.withColumn("_bin", F.explode(F.sequence(F.floor(F.col("_ls") / F.col("_w")), F.floor(F.col("_le") / F.col("_w")))))
    rights = rights.withColumn("_rlvl", up(F.col("_rv"), range(4))).withColumn("_rw", size(F.col("_rlvl")))
    # tag 1 serves left rows of lower levels alone
    rights = rights.withColumn("_rtag", F.explode(F.when((F.col("_rlvl") == F.col("_rv")) & (F.col("_rv") > 0), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    rights = rights.withColumn("_rbin", F.explode(F.sequence(F.floor(F.col("_rs") / F.col("_rw")), F.floor(F.col("_re") / F.col("_rw"))))).withColumnRenamed(region, "_region")
    first = F.floor(F.greatest(F.col("_ls"), F.col("_rs")) / F.col("_w"))
    on = (F.col(region) == F.col("_region")) & (F.col("_lvl") == F.col("_rlvl")) & (F.col("_tag") == F.col("_rtag")) & (F.col("_bin") == F.col("_rbin")) & (F.col("_bin") == first) & (F.col("_rs") <= F.col("_le")) & (F.col("_re") >= F.col("_ls"))
    out = lefts.join(rights.hint("merge"), on)
    return out.select(*left.columns, *(c for c in right.columns if c != region))


def interval_union(df: DataFrame, by: list[str], start: str, end: str, width: int = STRETCH) -> DataFrame:
    """(by.., start, end): overlapping or touching intervals merged, by the running maximum of the ends before.

    Each stretch of width bases of a region is merged by itself, given the furthest end of the stretches before it; what runs on from
    those is one interval for each stretch, added to the last one that began before. Windows over a whole region see one row for each
    stretch. Rows without a start or an end are left out; nulls in by are a group of their own.
    """
    rows = df.select(*by, start, end).filter(F.col(start).isNotNull() & F.col(end).isNotNull()).withColumn("_bin", F.floor(F.col(start) / width))
    earlier = Window.partitionBy(*by).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    reach = rows.groupBy(*by, "_bin").agg(F.max(end).alias("_reach")).withColumn("_reach", F.max("_reach").over(earlier)).filter("_reach is not null")
    # what reaches a stretch stands before its rows
    every = rows.withColumn("_own", F.lit(True)).unionByName(reach.select(*by, F.lit(None).cast(rows.schema[start].dataType).alias(start), F.col("_reach").alias(end), "_bin", F.lit(False).alias("_own")))
    w = Window.partitionBy(*by, "_bin").orderBy("_own", start, end)
    before = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = every.withColumn("_new", F.when(F.col("_own") & (before.isNull() | (F.col(start) > before + 1)), F.col(start)))
    first = F.last("_new", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    pieces = marked.withColumn("_first", first).filter("_own").groupBy(*by, "_bin", "_first").agg(F.max(end).alias("_end"))
    stretches = pieces.groupBy(*by, "_bin").agg(F.max("_first").alias("_last"), F.max(F.when(F.col("_first").isNull(), F.col("_end"))).alias("_end"))
    run_on = stretches.withColumn("_first", F.last("_last", ignorenulls=True).over(earlier)).filter("_end is not null")
    both = pieces.filter("_first is not null").select(*by, "_first", "_end").unionByName(run_on.select(*by, "_first", "_end"))
    return both.groupBy(*by, F.col("_first").alias(start)).agg(F.max("_end").alias(end))


def asof_interval(points: DataFrame, intervals: DataFrame, by: str, position: str, start: str, end: str, width: int = STRETCH) -> DataFrame:
    """points with the disjoint interval that starts last at or before them (start, end, or null), and inside: whether it reaches
    the point. Both sides are one stream by position within each stretch of width bases, so the join is a window's running last
    value; the last interval of the stretches before comes first. Windows over a whole region see one row for each stretch."""
    stretch = lambda c: F.floor(F.col(c) / width).alias("_bin")
    interval = F.struct(F.col(start).cast("bigint").alias("s"), F.col(end).cast("bigint").alias("e"))
    none = F.lit(None).cast("struct<s:bigint,e:bigint>")
    point = points.select(F.struct(*points.columns).alias("x")).schema["x"].dataType
    mine = points.select(F.col(by), stretch(position), F.col(position).cast("bigint").alias("_at"), F.lit(1).alias("_side"), F.struct(*points.columns).alias("_point"), none.alias("_interval"))
    known = intervals.filter(F.col(start).isNotNull()).select(F.col(by), stretch(start), interval.alias("_interval"))
    # stretches of either side, with the last interval that starts in each, and then in those before
    ends = known.unionByName(points.select(F.col(by), stretch(position), none.alias("_interval"))).groupBy(by, "_bin").agg(F.max("_interval").alias("_interval"))
    earlier = Window.partitionBy(by).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.withColumn("_interval", F.last("_interval", ignorenulls=True).over(earlier)).filter("_interval is not null")
    theirs = known.unionByName(carried.select(by, "_bin", "_interval")).select(by, "_bin", F.col("_interval.s").alias("_at"), F.lit(0).alias("_side"), F.lit(None).cast(point).alias("_point"), "_interval")
    w = Window.partitionBy(by, "_bin").orderBy("_at", "_side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    got = mine.unionByName(theirs).withColumn("_last", F.last("_interval", ignorenulls=True).over(w)).filter("_side = 1")
    return got.select("_point.*", F.col("_last.s").alias(start), F.col("_last.e").alias(end), F.coalesce(F.col("_last.e") >= F.col("_at"), F.lit(False)).alias("inside"))
