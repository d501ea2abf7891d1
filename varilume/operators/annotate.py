"""Consequences of events on transcripts: a binned join, then column expressions on each pair."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from varilume.functions.hgvs import COLUMNS as HGVS
from varilume.functions.hgvs import REACH
from varilume.functions.vocab import consequence, impact, impact_code
from varilume.operators import kernel
from varilume.operators.classify import feature_mask, introns
from varilume.operators.events import GEOMETRY as events_geometry
from varilume.operators.events import allele_geometry
from varilume.operators.intervals import overlap_join

MODEL = ("transcript_index", "seq_region", "transcript_start", "transcript_end", "strand", "transcript_flags", "cds_start", "cds_end", "cds_sequence", "codon_table", "post_cds_sequence", "exons")
COMPACT = ("event_index", "transcript_index", "consequence_mask", "consequence", "impact_code", "impact", *kernel.PLACES)
RICH = (*COMPACT, "region", "strand", "exon", "exon_count", "ref_codons", "alt_codons", "ref_peptide", "alt_peptide", "nmd_prediction", "nmd_escape")
#: What kernel.evaluate reads of a pair.
READ = {
    "small": ("feature_start1", "feature_end1", "reference", "alternate", "reference_difference", "alternate_difference", "length_difference", "edit_start0", "edit_end0", "cds_length", "codon_table", "cds_sequence", "post_cds_sequence"),
    "structural": ("feature_start1", "feature_end1", "structural_type", "copy_change"),
    "breakend": ("feature_start1", "feature_end1"),
    "unspecified": ("feature_start1", "feature_end1", "cds_length"),
}
#: Names of the projected columns as they are returned.
PROJECTED = {c: c.replace("edit_cdna_first", "cdna_start").replace("edit_cdna_last", "cdna_end").replace("edit_cds_first", "cds_start").replace("edit_cds_last", "cds_end").replace("edit_protein_first", "protein_start").replace("edit_protein_last", "protein_end") for c in kernel.PROJECTED}
SPAN = ("transcript_start", "transcript_end", "strand", "transcript_flags", "cds_start", "cds_end", "exons")


def pairs(events: DataFrame, transcripts: DataFrame, upstream: int, downstream: int, model: tuple[str, ...] = MODEL) -> DataFrame:
    """Events and transcripts of a region within the larger distance, less those beyond the distance of their own side."""
    halo = max(upstream, downstream)
    got = overlap_join(events, transcripts.select(*model), "seq_region", ("feature_start1", "feature_end1"), ("transcript_start", "transcript_end"), halo)
    left, right = F.col("transcript_start") - F.greatest("feature_start1", "feature_end1"), F.least("feature_start1", "feature_end1") - F.col("transcript_end")
    fwd = F.col("strand") >= 0
    up, down = F.when(fwd, left).otherwise(right), F.when(fwd, right).otherwise(left)
    return got.filter((up <= upstream) & (down <= downstream))


def evaluated(df: DataFrame, columns: tuple[str, ...], family: str) -> DataFrame:
    """Those columns of each pair: facts by the kernel, others as they stand in df. No rule of the optimizer looks through it."""
    types = {f.name: f.dataType for f in df.schema.fields}
    schema = T.StructType([T.StructField(c, T._parse_datatype_string(kernel.TYPES[c]) if c in kernel.TYPES else types[c]) for c in columns])
    read = list(dict.fromkeys([*SPAN, *READ[family], *(c for c in ("window", "window_start") if c in types), *(c for c in columns if c not in kernel.TYPES)]))
    want = list(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield kernel.evaluate(batch, want, family)

    return df.select(*read).mapInArrow(run, schema)


def reference_around(events: DataFrame, chunks: DataFrame) -> DataFrame:
    """events with window, window_start: reference bases of the edit, and REACH on either side where it may move along a repeat.

    chunks: seq_region, start (0-based), end, seq, without overlaps. The window ends where chunks end; it is null where they
    have a gap or don't hold the edit.
    """
    moves = F.col("variant_kind").isin("insertion", "deletion")
    low, high = F.least("feature_start1", "feature_end1"), F.greatest("feature_start1", "feature_end1")
    halo = F.when(moves, F.lit(REACH)).otherwise(0)
    sites = events.select("event_index", "seq_region", low.alias("_low"), high.alias("_high"), (low - halo).alias("_from"), (high + halo).alias("_to"))
    pieces = overlap_join(sites, chunks.select("seq_region", (F.col("start") + 1).cast("long").alias("_ps"), F.col("end").cast("long").alias("_pe"), "seq"), "seq_region", ("_from", "_to"), ("_ps", "_pe"))
    a, b = F.greatest("_from", "_ps"), F.least("_to", "_pe")
    part = F.struct(a.alias("at"), F.substr("seq", (a - F.col("_ps") + 1).cast("int"), (b - a + 1).cast("int")).alias("x"))
    got = pieces.groupBy("event_index", "_low", "_high").agg(F.array_sort(F.collect_list(part)).alias("parts"), F.min(a).alias("window_start"), F.max(b).alias("_last"))
    text = F.upper(F.expr("array_join(transform(parts, p -> p.x), '')"))
    whole = (F.length(text) == F.col("_last") - F.col("window_start") + 1) & (F.col("window_start") <= F.col("_low")) & (F.col("_last") >= F.col("_high"))
    return events.join(got.select("event_index", F.when(whole, text).alias("window"), "window_start"), "event_index", "left")


def small_variants(events: DataFrame, transcripts: DataFrame, upstream: int = 5000, downstream: int = 5000, columns: tuple[str, ...] = (*RICH, *HGVS), chunks: DataFrame | None = None) -> DataFrame:
    """columns for literal alleles, one row for each event and transcript in reach: facts of the kernel, or columns of either side.

    A CDS goes along only with events on its span. With reference chunks HGVS covers introns, UTRs, insertions and deletions.
    """
    # null checks that a join derives may run before a filter by family: other families' alleles are no error here
    ev = allele_geometry(events, literal=F.col("_family") == "small" if "_family" in events.columns else None)
    if chunks is not None and set(columns) & set(HGVS):
        ev = reference_around(ev, chunks)
    got = pairs(ev, transcripts, upstream, downstream)
    got = _with_cds(got)
    if "window" in got.columns:
        near = (F.greatest("feature_start1", "feature_end1") >= F.col("transcript_start")) & (F.least("feature_start1", "feature_end1") <= F.col("transcript_end"))
        got = got.withColumn("window", F.when(near, F.col("window")))
    return evaluated(got, columns, "small")


def _with_cds(got: DataFrame) -> DataFrame:
    """Pairs with cds_length, and the sequences only where the event lies on the span of the CDS."""
    on = (F.greatest("feature_start1", "feature_end1") >= F.col("cds_start")) & (F.least("feature_start1", "feature_end1") <= F.col("cds_end"))
    return got.withColumns({"cds_length": F.length("cds_sequence"), "post_cds_sequence": F.when(on, F.col("post_cds_sequence")), "cds_sequence": F.when(on, F.col("cds_sequence"))})


def annotate_projected(events: DataFrame, transcripts: DataFrame, upstream_distance: int = 5000, downstream_distance: int = 5000) -> DataFrame:
    """The events' columns, the geometry of their alleles, the terms, and the edit as it lies on the transcript: spans, ranks of
    exons and introns, the distance outside, residues and codons. Literal alleles alone; <*> and other symbols are an error."""
    source = [c for c in events.columns if c not in ("seq_region",)]
    geometry = [c.split()[0] for c in events_geometry.split(", ")]
    columns = (*source, "seq_region", *geometry, "transcript_index", "consequence_mask", "consequence", "impact", "region", "nmd_prediction", "nmd_escape", *kernel.PROJECTED)
    got = small_variants(checked(events), transcripts, upstream_distance, downstream_distance, tuple(dict.fromkeys(columns)))
    plain = [c for c in dict.fromkeys(columns) if c not in geometry and c not in kernel.PROJECTED]
    return got.select(*plain, F.struct(*geometry).alias("geometry"), *(F.col(c).alias(n) for c, n in PROJECTED.items()))


def transcript_projection(events: DataFrame, annotations: DataFrame, transcripts: DataFrame) -> DataFrame:
    """The projected columns of annotations made before (event_index, transcript_index): the pairs as they are given, by two joins on keys."""
    got = annotate_pairs(annotations.select("event_index", "transcript_index"), events, transcripts, ("event_index", "transcript_index", *kernel.PROJECTED))
    return got.select("event_index", "transcript_index", *(F.col(c).alias(n) for c, n in PROJECTED.items()))


def annotate_pairs(keys: DataFrame, events: DataFrame, transcripts: DataFrame, columns: tuple[str, ...] = COMPACT) -> DataFrame:
    """columns for the pairs (event_index, transcript_index) that the caller names, whatever their distance; others of a region are dropped."""
    tx = transcripts.select(*MODEL).withColumnRenamed("seq_region", "_region")
    got = keys.join(allele_geometry(checked(events)), "event_index").join(tx, "transcript_index").filter("seq_region = _region")
    return evaluated(_with_cds(got), columns, "small")


def unspecified_alternates(events: DataFrame, transcripts: DataFrame, upstream: int = 5000, downstream: int = 5000) -> DataFrame:
    """COMPACT columns for <*>, the allele that stands for any not seen: where it lies, and that start and stop codons are kept."""
    ev = events.filter(F.col("alternate") == "<*>").withColumns({"feature_start1": F.col("position").cast("long"), "feature_end1": F.col("position").cast("long") + F.length("reference") - 1})
    got = pairs(ev, transcripts.withColumn("cds_length", F.length("cds_sequence")), upstream, downstream, ("transcript_index", "seq_region", *SPAN, "cds_length"))
    return evaluated(got, COMPACT, "unspecified")


def _named(df: DataFrame) -> DataFrame:
    m = F.col("consequence_mask")
    return df.withColumns({"consequence": consequence(m), "impact_code": impact_code(m), "impact": impact(m)})


def structural_variants(events: DataFrame, transcripts: DataFrame, upstream: int = 5000, downstream: int = 5000) -> DataFrame:
    """COMPACT columns for structural events (position, end_position, structural_type, copy_change)."""
    ev = events.withColumns({"feature_start1": F.col("position").cast("long"), "feature_end1": F.coalesce("end_position", "position").cast("long")})
    return evaluated(pairs(ev, transcripts, upstream, downstream, ("transcript_index", "seq_region", *SPAN)), COMPACT, "structural")


def breakends(events: DataFrame, transcripts: DataFrame, distance: int = 5000) -> DataFrame:
    """COMPACT columns for breakends: transcripts within the distance of the local or of the mate's point, each once.

    A transcript that holds either point is truncated; others are up- or downstream of the nearer point.
    """
    local = events.select("event_index", F.col("seq_region"), F.col("position").cast("long").alias("feature_start1"), F.lit(0).alias("side"))
    mate = events.filter("mate_position is not null").select("event_index", F.col("mate_seq_region").alias("seq_region"), F.col("mate_position").cast("long").alias("feature_start1"), F.lit(1).alias("side"))
    points = local.unionByName(mate).withColumn("feature_end1", F.col("feature_start1"))
    got = pairs(points, transcripts, distance, distance, ("transcript_index", "seq_region", *SPAN))
    masks = evaluated(got, ("event_index", "transcript_index", "consequence_mask"), "breakend")
    out = masks.groupBy("event_index", "transcript_index").agg(F.bit_or("consequence_mask").alias("consequence_mask"))
    return _named(out.withColumns(dict.fromkeys(COMPACT[6:], F.lit(None).cast("long")))).select(*COMPACT)


def family(events: DataFrame) -> Column:
    """small, unspecified (<*>), structural, breakend, or null for alleles that state no change (<NON_REF>, *, .)."""
    alt = F.col("alternate")
    kind = F.col("structural_type") if "structural_type" in events.columns else F.lit(None)
    mate = F.col("mate_position") if "mate_position" in events.columns else F.lit(None)
    # without columns for symbolic alleles <*> is an error of the literal ones
    other = (alt == "<*>") if "structural_type" in events.columns else F.lit(False)
    return F.when(alt.isin("<NON_REF>", "*", "."), None).when(other, "unspecified").when(mate.isNotNull() | alt.rlike(r"[\[\]]"), "breakend").when(kind.isNotNull() | alt.startswith("<"), "structural").otherwise("small")


def checked(events: DataFrame) -> DataFrame:
    """events, where the first row at fault raises an error when it is read: null key, bad position, missing allele, reversed
    span, half a mate."""
    bad = (
        (F.col("event_index").isNull() | F.col("seq_region").isNull(), "event_index and seq_region must not be null"),
        (F.col("position").isNull() | (F.col("position") < 1) | (F.col("position") > 4_294_967_294), "position must be a positive 32-bit coordinate"),
        (F.col("alternate").isNull() | F.col("reference").isNull(), "reference and alternate must not be null"),
        ((F.col("end_position") < F.col("position")) if "end_position" in events.columns else F.lit(False), "end_position must not precede position"),
        ((F.col("mate_position").isNull() != F.col("mate_seq_region").isNull()) if "mate_position" in events.columns else F.lit(False), "mate_seq_region and mate_position go together"),
    )
    why = F.coalesce(*(F.when(c, F.lit(m)) for c, m in bad))
    # the key of the joins that follow, so it is read in every plan; null keys would be dropped there without a word
    return events.withColumn("seq_region", F.when(why.isNotNull(), F.raise_error(why).cast(events.schema["seq_region"].dataType)).otherwise(F.col("seq_region")))


def annotate(events: DataFrame, transcripts: DataFrame, *, rich: bool = False, hgvs: bool = False, chunks: DataFrame | None = None, upstream_distance: int = 5000, downstream_distance: int = 5000) -> DataFrame:
    """Events of any family to one row for each transcript in reach; only the branches that the schema can hold are planned.

    chunks: reference bases, for HGVS beyond substitutions in the CDS.
    """
    if upstream_distance < 0 or downstream_distance < 0:
        raise ValueError("distances must not be negative")
    columns = (RICH if rich else COMPACT) + (HGVS if hgvs else ())
    events = checked(events).withColumn("_family", family(events))
    small = events.filter("_family = 'small'")
    out = small_variants(small, transcripts, upstream_distance, downstream_distance, columns, chunks)
    if "structural_type" in events.columns:
        out = out.unionByName(unspecified_alternates(events.filter("_family = 'unspecified'"), transcripts, upstream_distance, downstream_distance).select(*COMPACT), allowMissingColumns=True)
        out = out.unionByName(structural_variants(events.filter("_family = 'structural'"), transcripts, upstream_distance, downstream_distance).select(*COMPACT), allowMissingColumns=True)
    if "mate_position" in events.columns:
        out = out.unionByName(breakends(events.filter("_family = 'breakend'"), transcripts).select(*COMPACT), allowMissingColumns=True)
    return out


def interval_features(events: DataFrame, features: DataFrame) -> DataFrame:
    """(event_index, regulation_feature_index, consequence_mask, consequence, impact) of regulatory regions and motifs that events meet."""
    got = overlap_join(events, features, "seq_region", ("feature_start1", "feature_end1"), ("feature_start", "feature_end"))
    loss = (F.col("length_difference") < 0) if "length_difference" in events.columns else F.lit(False)
    gain = F.col("copy_change") == "GAIN" if "copy_change" in events.columns else F.lit(False)
    s, e, a, b = (F.col(c) for c in ("feature_start1", "feature_end1", "feature_start", "feature_end"))
    # an interbase site at the edge touches no base of the feature
    got = got.filter((e >= a) & (s <= b)).withColumn("consequence_mask", feature_mask(s, e, a, b, F.col("feature_kind"), loss, F.coalesce(gain, F.lit(False))))
    return _named(got).select("event_index", "regulation_feature_index", "consequence_mask", "consequence", "impact")


def without_candidates(events: DataFrame, annotated: DataFrame, coverage_complete: bool = True) -> DataFrame:
    """Events that met no transcript: intergenic where the model covers the genome, else undecided with the reason."""
    term, why = ("intergenic_variant", None) if coverage_complete else ("sequence_variant", "no_feature_in_loaded_model")
    rest = events.select("event_index").join(annotated.select("event_index").distinct(), "event_index", "left_anti")
    return rest.select("event_index", F.lit(term).alias("consequence"), F.lit("MODIFIER").alias("impact"), F.lit(why).cast("string").alias("unresolved_reason"))


def coding_transcripts(events: DataFrame, transcripts: DataFrame) -> DataFrame:
    """(event_index, transcripts): ascending indexes of coding transcripts whose CDS a literal allele touches; short gaps within it count."""
    ev = allele_geometry(events).select("event_index", "seq_region", "feature_start1", "feature_end1")
    tx = transcripts.filter("cds_start is not null").select("seq_region", "transcript_index", "cds_start", "cds_end", "exons")
    got = overlap_join(ev, tx, "seq_region", ("feature_start1", "feature_end1"), ("cds_start", "cds_end")).withColumn("_gaps", introns(F.col("exons")))
    s, e = F.col("feature_start1"), F.col("feature_end1")
    on = lambda a, b: (e >= F.greatest(a, F.col("cds_start"))) & (s <= F.least(b, F.col("cds_end")))
    hit = F.exists("exons", lambda x: on(x["exon_start"], x["exon_end"])) | F.exists("_gaps", lambda g: (g["ie"] - g["is"] < 13) & on(g["is"], g["ie"]))
    return got.filter(hit).groupBy("event_index").agg(F.sort_array(F.collect_set("transcript_index")).alias("transcripts"))
