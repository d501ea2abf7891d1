"""Circular regions: objects that cross the origin are unrolled, and of three images the one nearest an event counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varilume.operators.annotate import RICH, small_variants


def lift(objects: DataFrame, regions: DataFrame, start: str, end: str, lists: dict[str, tuple[str, ...]] | None = None, more: tuple[str, ...] = ()) -> DataFrame:
    """objects with their spans unrolled, once for each image, and image: -1, 0 or 1 turns; region_length, null where nothing wraps.

    A region counts as circular where it is so named and has an object with start > end; there each object stands at three
    images, one length apart, above a base of one length, so that no place falls below 1. Coordinates below the object's start
    lie behind the origin. lists: array columns of structs with the fields that hold coordinates; more: further coordinates.
    """
    wrapped = objects.filter(F.col(start) > F.col(end)).select("seq_region").distinct()
    # a genome has few regions
    turns = regions.filter("circular").join(wrapped, "seq_region", "left_semi").select("seq_region", F.col("sequence_length").cast("long").alias("region_length"))
    got = objects.join(F.broadcast(turns), "seq_region", "left")
    n, wraps = F.col("region_length"), F.col("region_length").isNotNull() & (F.col(start) > F.col(end))
    got = got.withColumn("image", F.explode(F.when(n.isNull(), F.array(F.lit(0))).otherwise(F.array(F.lit(-1), F.lit(0), F.lit(1)))))
    base = F.when(n.isNull(), F.lit(0).cast("long")).otherwise(n * (F.col("image") + 1))
    place = lambda c: c + base + F.when(wraps & (c < F.col(start)), n).otherwise(F.lit(0).cast("long"))
    spans = {c: place(F.col(c)) for c in (start, end, *more)}

    def moved(name: str, fields: tuple[str, ...]) -> Column:
        kept = [f.name for f in objects.schema[name].dataType.elementType.fields]
        return F.array_sort(F.transform(name, lambda x: F.struct(*((place(x[k]) if k in fields else x[k]).alias(k) for k in kept))))

    spans |= {name: moved(name, fields) for name, fields in (lists or {}).items()}
    return got.withColumns(spans)


def lifted_events(events: DataFrame, lifted: DataFrame, position: str = "position") -> DataFrame:
    """events one length up in the regions that lift has unrolled, where image 0 of the objects stands."""
    turns = lifted.filter("region_length is not null").select("seq_region", "region_length").distinct()
    got = events.join(F.broadcast(turns), "seq_region", "left")
    return got.withColumn(position, F.col(position).cast("long") + F.coalesce("region_length", F.lit(0).cast("long"))).select(*events.columns)


def nearest(pairs: DataFrame, columns: list[str], distance: str, side: str) -> DataFrame:
    """Of the images of each (event_index, transcript_index), the one at the least distance; ties go by the side, which a turn of the whole region doesn't change."""
    best = F.min_by(F.struct(*columns), F.struct(F.col(distance), F.col(side)))
    return pairs.groupBy("event_index", "transcript_index").agg(best.alias("x")).select("event_index", "transcript_index", "x.*")


def annotate_circular(events: DataFrame, transcripts: DataFrame, regions: DataFrame, upstream: int = 5000, downstream: int = 5000, columns: tuple[str, ...] = RICH) -> DataFrame:
    """columns of small variants where transcripts may cross the origin of circular regions: one row for each event and transcript in reach.

    regions: seq_region, sequence_length, circular. The facts are those of the linear annotation on the unrolled coordinates.
    """
    tx = lift(transcripts, regions, "transcript_start", "transcript_end", {"exons": ("exon_start", "exon_end")}, ("cds_start", "cds_end"))
    ev = lifted_events(events, tx)
    spans = ("feature_start1", "feature_end1", "transcript_start", "transcript_end")
    wanted = tuple(dict.fromkeys(("event_index", "transcript_index", *columns, *spans)))
    got = small_variants(ev, tx, upstream, downstream, wanted)
    low, high = F.col("transcript_start") - F.greatest("feature_start1", "feature_end1"), F.least("feature_start1", "feature_end1") - F.col("transcript_end")
    got = got.withColumns({"_away": F.greatest(F.lit(0).cast("long"), low, high), "_side": (high > 0).cast("int")})
    rest = [c for c in columns if c not in ("event_index", "transcript_index")]
    return nearest(got, rest, "_away", "_side").select(*columns)
