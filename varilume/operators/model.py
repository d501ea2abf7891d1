"""Models: built from Ensembl-shaped relations, validated, named, saved and restored."""

from __future__ import annotations

import json
import threading
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from varilume.functions.dna import revcomp
from varilume.operators.events import dense_index
from varilume.operators.intervals import overlap_join


def regions(coord_system: DataFrame, seq_region: DataFrame, seq_region_attrib: DataFrame, attrib_type: DataFrame, contigs: DataFrame, assembly: str, species: int = 1) -> DataFrame:
    """(seq_region, seq_region_name, sequence_length, circular, source_id): contigs matched by name and length, numbered from 0.

    contigs: (chrom, length). Numbers go by the coordinate system's rank, then the source id. Regions are few.
    """
    cs = coord_system.filter((F.col("species_id") == species) & (F.col("version") == assembly)).select("coord_system_id", "rank")
    circular = seq_region_attrib.join(F.broadcast(attrib_type.filter("code = 'circular_seq'").select("attrib_type_id")), "attrib_type_id", "left_semi").filter("value = '1'").select("seq_region_id").distinct().withColumn("circular", F.lit(True))
    got = seq_region.join(F.broadcast(cs), "coord_system_id").join(contigs, (F.col("name") == F.col("chrom")) & (seq_region["length"] == contigs["length"]))
    got = got.join(circular, "seq_region_id", "left")
    n = F.row_number().over(Window.orderBy("rank", "seq_region_id")) - 1
    return got.select(n.alias("seq_region"), F.col("name").alias("seq_region_name"), seq_region["length"].alias("sequence_length"), F.coalesce("circular", F.lit(False)).alias("circular"), F.col("seq_region_id").alias("source_id"))


def contig_lengths(chunks: DataFrame) -> DataFrame:
    """(chrom, length, contiguous) of reference chunks (chrom, start, end, seq), 0-based and half-open: each starts where the last ended."""
    w = Window.partitionBy("chrom").orderBy("start")
    gap = (F.col("start") != F.coalesce(F.lag("end").over(w), F.lit(0))) | (F.length("seq") != F.col("end") - F.col("start"))
    return chunks.withColumn("gap", gap).groupBy("chrom").agg(F.max("end").alias("length"), (~F.bool_or("gap")).alias("contiguous"))


def transcripts(transcript: DataFrame, exon_transcript: DataFrame, exon: DataFrame, translation: DataFrame, region_map: DataFrame, chunks: DataFrame | None = None) -> DataFrame:
    """Model rows from core tables: spliced spans of exons by running length, coding span, exons in genomic order, sequences.

    Current transcripts with a stable id alone; indexes by region, start and id, from 0. Sequences are stitched from chunks
    where these are given: each exon's pieces by a range join, in order, turned for the minus strand.
    """
    t = transcript.filter("is_current = 1 and stable_id is not null and biotype != 'artifact'").join(region_map.select(F.col("source_id").alias("seq_region_id"), "seq_region"), "seq_region_id")
    e = exon_transcript.join(exon.select("exon_id", F.col("seq_region_start").alias("es"), F.col("seq_region_end").alias("ee")), "exon_id").join(t.select("transcript_id"), "transcript_id", "left_semi")
    w = Window.partitionBy("transcript_id").orderBy("rank")
    n = F.col("ee") - F.col("es") + 1
    e = e.withColumn("to", F.sum(n).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))).withColumn("from", F.col("to") - n + 1)
    ends = lambda c: e.select("transcript_id", F.col("exon_id").alias(f"{c}_exon_id"), F.col("from").alias(f"{c}_from"), F.col("es").alias(f"{c}_es"), F.col("ee").alias(f"{c}_ee"))
    cds = translation.join(ends("start"), ["transcript_id", "start_exon_id"]).join(ends("end"), ["transcript_id", "end_exon_id"])
    cds = cds.join(t.select("transcript_id", F.col("seq_region_strand").alias("strand")), "transcript_id")
    first = F.when(F.col("strand") > 0, F.col("start_es") + F.col("seq_start") - 1).otherwise(F.col("start_ee") - F.col("seq_start") + 1)
    last = F.when(F.col("strand") > 0, F.col("end_es") + F.col("seq_end") - 1).otherwise(F.col("end_ee") - F.col("seq_end") + 1)
    cds = cds.select("transcript_id", F.least(first, last).alias("cds_start"), F.greatest(first, last).alias("cds_end"), (F.col("start_from") + F.col("seq_start") - 1).alias("cdna_coding_start"), (F.col("end_from") + F.col("seq_end") - 1).alias("cdna_coding_end"))
    exons = e.groupBy("transcript_id").agg(F.array_sort(F.collect_list(F.struct(F.col("es").alias("exon_start"), F.col("ee").alias("exon_end"), F.col("from").alias("exon_cdna_start"), F.col("to").alias("exon_cdna_end")))).alias("exons"))
    out = t.join(exons, "transcript_id").join(cds, "transcript_id", "left")
    if chunks is not None:
        pieces = overlap_join(e.join(t.select("transcript_id", "seq_region"), "transcript_id"), chunks.select("seq_region", (F.col("start") + 1).alias("ps"), F.col("end").alias("pe"), "seq"), "seq_region", ("es", "ee"), ("ps", "pe"))
        piece = F.substr("seq", (F.greatest("es", "ps") - F.col("ps") + 1).cast("int"), (F.least("ee", "pe") - F.greatest("es", "ps") + 1).cast("int"))
        spliced = pieces.groupBy("transcript_id").agg(F.array_sort(F.collect_list(F.struct("es", "ps", piece.alias("x")))).alias("parts")).select("transcript_id", F.expr("array_join(transform(parts, p -> p.x), '')").alias("genomic"))
        out = out.join(spliced, "transcript_id", "left").withColumn("spliced", F.when(F.col("seq_region_strand") > 0, F.col("genomic")).otherwise(revcomp(F.col("genomic"))))
        part = lambda a, b: F.substr("spliced", a.cast("int"), (b - a + 1).cast("int"))
        out = out.withColumns({"cds_sequence": part(F.col("cdna_coding_start"), F.col("cdna_coding_end")), "pre_cds_sequence": part(F.lit(1), F.col("cdna_coding_start") - 1), "post_cds_sequence": part(F.col("cdna_coding_end") + 1, F.length("spliced"))})
    keep = [c for c in ("cds_sequence", "pre_cds_sequence", "post_cds_sequence") if c in out.columns]
    named = out.select("transcript_id", "stable_id", "seq_region", F.col("seq_region_start").alias("transcript_start"), F.col("seq_region_end").alias("transcript_end"), F.col("seq_region_strand").alias("strand"), "cds_start", "cds_end", "exons", *keep)
    # numbers by a sort over ranges of keys alone, so that no task holds all sequences
    index = dense_index(named.select("transcript_id", "seq_region", "transcript_start"), "transcript_index", F.col("seq_region"), F.col("transcript_start"), F.col("transcript_id"), start=0)
    return named.join(index.select("transcript_id", "transcript_index"), "transcript_id").select("transcript_index", *named.columns)


def regulation_features(regulatory: DataFrame, feature_type: DataFrame, motif: DataFrame, region_map: DataFrame) -> DataFrame:
    """Regulatory regions (kind 1, without EMAR) and motifs (kind 2) as one relation with dense numbers by region and place."""
    r = regulatory.join(F.broadcast(feature_type.filter("name != 'EMAR'").select("feature_type_id")), "feature_type_id", "left_semi").select("seq_region_id", F.col("seq_region_start").alias("feature_start"), F.col("seq_region_end").alias("feature_end"), F.col("regulatory_feature_id").alias("source_feature_id"), F.lit(1).alias("feature_kind"))
    m = motif.select("seq_region_id", F.col("seq_region_start").alias("feature_start"), F.col("seq_region_end").alias("feature_end"), F.col("motif_feature_id").alias("source_feature_id"), F.lit(2).alias("feature_kind"))
    both = r.unionByName(m).join(region_map.select(F.col("source_id").alias("seq_region_id"), "seq_region"), "seq_region_id").filter("feature_start > 0 and feature_end >= feature_start")
    order = ("seq_region", "feature_start", "feature_end", "feature_kind", "source_feature_id")
    return dense_index(both, "regulation_feature_index", *map(F.col, order), start=0).select("regulation_feature_index", *order)


def rna_edits(attributes: DataFrame) -> DataFrame:
    """(transcript_id, edit_start, edit_end, edit_sequence, operation) of values "start end sequence"; malformed ones are dropped."""
    pattern = r"^([0-9]+) ([0-9]+) ?([ACGTUNacgtun]*)$"
    got = attributes.filter(F.col("value").rlike(pattern)).select("transcript_id", *(F.regexp_extract("value", pattern, k).alias(n) for k, n in ((1, "a"), (2, "b"), (3, "edit_sequence"))))
    got = got.select("transcript_id", F.col("a").cast("bigint").alias("edit_start"), F.col("b").cast("bigint").alias("edit_end"), "edit_sequence")
    n = F.col("edit_end") - F.col("edit_start") + 1
    kind = F.when(n == 0, "insertion").when(F.col("edit_sequence") == "", "deletion").when(F.length("edit_sequence") == n, "substitution").otherwise("replacement")
    return got.filter(n >= 0).withColumn("operation", kind)


CHECKS = (
    ("transcript_index is null or seq_region is null", "transcript_index and seq_region must not be null"),
    ("transcript_start < 1 or transcript_end < transcript_start or transcript_end > 4294967295", "transcript spans must be positive 32-bit intervals"),
    ("strand not in (1, -1)", "strand must be 1 or -1"),
    ("(cds_start is null) != (cds_end is null)", "cds_start and cds_end go together"),
    ("cds_start < transcript_start or cds_end > transcript_end or cds_end < cds_start", "the CDS must lie within its transcript"),
    ("size(exons) = 0", "a transcript needs an exon"),
    ("exists(slice(exons, 1, size(exons) - 1), x -> x.exon_end < x.exon_start) or exists(transform(slice(exons, 2, size(exons)), (x, i) -> x.exon_start <= exons[i].exon_end), y -> y)", "exons must be ascending and apart"),
)


def validate(transcripts: DataFrame) -> int:
    """Rows of the relation; the first check that fails raises its error. One pass over the data for all checks."""
    counts = transcripts.agg(F.count("*").alias("n"), F.countDistinct("transcript_index").alias("distinct"), *(F.count_if(F.expr(c)).alias(f"c{i}") for i, (c, _) in enumerate(CHECKS))).first()
    for i, (_, message) in enumerate(CHECKS):
        if counts[f"c{i}"]:
            raise ValueError(f"{message}: {counts[f'c{i}']} rows")
    if counts["distinct"] != counts["n"]:
        raise ValueError("transcript_index must be unique")
    return counts["n"]


def receipt(transcripts: DataFrame) -> DataFrame:
    """(rows, coding, model_sha256): a hash of canonical row texts, by blocks of 4096 indexes, then of the blocks. Version 1.

    A row's text is its JSON with keys in the order of the columns named here; order and partitions don't matter.
    """
    columns = ("transcript_index", "seq_region", "transcript_start", "transcript_end", "strand", "cds_start", "cds_end", "cds_sequence", "exons")
    row = F.sha2(F.to_json(F.struct(*(F.col(c) for c in columns if c in transcripts.columns))), 256)
    rows = transcripts.select("transcript_index", row.alias("h"), F.col("cds_start").isNotNull().cast("long").alias("coding"), F.floor(F.col("transcript_index") / 4096).alias("block"))
    blocks = rows.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("transcript_index", "h"))).alias("hs"), F.count("*").alias("n"), F.sum("coding").alias("c"))
    blocks = blocks.select("block", "n", "c", F.sha2(F.expr("array_join(transform(hs, x -> x.h), '')"), 256).alias("h"))
    return blocks.agg(F.sum("n").alias("rows"), F.sum("c").alias("coding"), F.sha2(F.expr("array_join(transform(array_sort(collect_list(struct(block, h))), x -> x.h), '')"), 256).alias("model_sha256"))


@dataclass
class Model:
    """A named model: its relations, their rows, and a generation that tells a reload."""

    name: str
    transcripts: DataFrame
    features: DataFrame | None
    rows: int
    generation: int
    limits: dict = field(default_factory=dict)

    def budget(self, spark: SparkSession) -> DataFrame:
        """(owner, current, row_limit): what the model holds, by relation."""
        rows = [("transcripts", self.rows, self.limits.get("transcripts")), ("features", self.features.count() if self.features is not None else 0, self.limits.get("features"))]
        return spark.createDataFrame(rows, "owner string, current long, row_limit long")


class Limits:
    """What a process may hold and use: a ceiling on charged bytes with its high water, and bounds of an annotation's workers."""

    def __init__(self, ceiling: int = 1 << 40):
        self.ceiling, self.charged, self.high_water = ceiling, 0, 0
        self.workers: dict[str, int] = {}
        self._lock = threading.Lock()

    def set_ceiling(self, nbytes: int) -> int:
        """The new ceiling; below 1, or below what is charged, is an error."""
        with self._lock:
            if not nbytes or nbytes < 1 or nbytes < self.charged:
                raise ValueError("the ceiling must be positive and hold what is charged already")
            self.ceiling = int(nbytes)
            return self.ceiling

    def charge(self, nbytes: int) -> None:
        """Add (or, below 0, give back) bytes; beyond the ceiling is an error that changes nothing."""
        with self._lock:
            if self.charged + nbytes > self.ceiling:
                raise MemoryError("the ceiling is reached")
            self.charged = max(0, self.charged + nbytes)
            self.high_water = max(self.high_water, self.charged)

    def reset_high_water(self) -> bool:
        with self._lock:
            self.high_water = self.charged
        return True

    def set_workers(self, spark: SparkSession, workers: int, scratch_bytes: int, emit_bytes: int, idle_bytes: int) -> bool:
        """Bounds of the batches that Python workers get: rows follow from emit_bytes; workers say into how many tasks pairs are dealt."""
        if workers is None or not 1 <= workers <= 1024 or any(x is None or x < 0 for x in (scratch_bytes, emit_bytes, idle_bytes)):
            raise ValueError("workers must be 1 to 1024, and bytes not negative")
        self.workers = {"workers": workers, "scratch_bytes": scratch_bytes, "emit_bytes": emit_bytes, "idle_bytes": idle_bytes}
        if emit_bytes:
            spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(emit_bytes))
        return True


class Registry:
    """Models by name; loading replaces a name's model and advances the generation."""

    def __init__(self):
        self._models: dict[str, Model] = {}
        self._generation = 0
        self._lock = threading.Lock()

    def load(self, name: str, transcripts: DataFrame, features: DataFrame | None = None, row_limit: int | None = None) -> Model:
        rows = validate(transcripts)
        if row_limit is not None and rows > row_limit:
            raise ValueError(f"model {name} has {rows} rows, over the limit of {row_limit}")
        with self._lock:
            self._generation += 1
            self._models[name] = Model(name, transcripts, features, rows, self._generation, {"transcripts": row_limit})
            return self._models[name]

    def get(self, name: str, generation: int | None = None) -> Model:
        model = self._models.get(name)
        if model is None:
            raise KeyError(f"no model named {name}")
        if generation is not None and model.generation != generation:
            raise RuntimeError(f"model {name} was reloaded")
        return model

    def drop(self, name: str) -> bool:
        with self._lock:
            return self._models.pop(name, None) is not None

    def save(self, name: str, path: str) -> None:
        """Relations as Parquet and a manifest with the receipt, which is written last: without it a snapshot isn't complete."""
        model = self.get(name)
        spark = model.transcripts.sparkSession
        model.transcripts.write.mode("overwrite").parquet(f"{path}/transcripts")
        if model.features is not None:
            model.features.write.mode("overwrite").parquet(f"{path}/features")
        told = receipt(spark.read.parquet(f"{path}/transcripts")).first().asDict() | {"version": 1, "features": model.features is not None}
        spark.createDataFrame([(json.dumps(told),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest")

    def restore(self, spark: SparkSession, name: str, path: str) -> Model:
        """The saved model, checked against its manifest."""
        told = json.loads(spark.read.text(f"{path}/manifest").first()[0])
        transcripts = spark.read.parquet(f"{path}/transcripts")
        if receipt(transcripts).first()["model_sha256"] != told["model_sha256"]:
            raise ValueError("snapshot doesn't match its manifest")
        return self.load(name, transcripts, spark.read.parquet(f"{path}/features") if told["features"] else None)


MODELS = Registry()
