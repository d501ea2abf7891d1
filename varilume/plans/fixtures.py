"""Genomic relations derived from the driver's tables by integer arithmetic that Spark and other SQL engines share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Up- and downstream distance of the queries.
FLANK = 500


def base(p: str, r: str) -> str:
    """SQL for the letter of the made-up reference at position p of region r."""
    return f"substring('ACGT', cast(((({p}) % 7) * (({p}) % 11) + ({p}) * (({r}) + 3) + (({p}) % 5)) % 4 as int) + 1, 1)"


def genomic(c: str) -> str:
    """SQL for the position of place c of a transcript's spliced sequence."""
    step = f"(cast((({c}) - 1 - (({c}) - 1) % exon_len) / exon_len as bigint) * (exon_len + intron_len) + (({c}) - 1) % exon_len)"
    return f"(case when strand = 1 then transcript_start + {step} else transcript_end - {step} end)"


SHAPE = """p_partkey AS transcript_index, cast(p_partkey % 5 + (p_partkey - p_partkey % 2000) * 5 AS bigint) AS seq_region,
  cast(1001 + (p_partkey * 37) % 17000 AS bigint) AS transcript_start, cast(case when p_partkey % 2 = 0 then 1 else -1 end AS int) AS strand,
  cast(1 + p_partkey % 3 AS bigint) AS exon_count, cast(60 + 3 * (p_size % 10) AS bigint) AS exon_len, cast(40 + p_partkey % 50 AS bigint) AS intron_len, p_partkey % 4 <> 0 AS coding,
  cast(case when p_partkey % 4 <> 0 then 3 else 0 end + case when p_partkey % 17 = 0 then 4 else 0 end AS bigint) AS transcript_flags"""
ENDS = "transcript_start + exon_count * exon_len + (exon_count - 1) * intron_len - 1 AS transcript_end, (exon_count * exon_len - 20) - (exon_count * exon_len - 20) % 3 AS cds_length"
SPAN = f"case when coding then least({genomic('11')}, {genomic('10 + cds_length')}) end AS cds_start, case when coding then greatest({genomic('11')}, {genomic('10 + cds_length')}) end AS cds_end"
EVENT = """event_id AS event_index, cast(event_id % 5 + (event_id - event_id % 10000) AS bigint) AS seq_region,
  cast(1001 + (event_id * 13 + user_id * 7) % 18000 AS bigint) AS position, event_id % 10 AS form"""
_NEXT = "substring('ACGTACG', instr('ACGT', {b}) + 1 + cast(event_index % 3 as int), 1)"
_P, _R = "position", "seq_region"
REFERENCE = f"case when form = 9 then concat({base(_P, _R)}, {base(_P + ' + 1', _R)}, {base(_P + ' + 2', _R)}) when form = 7 then concat({base(_P, _R)}, {base(_P + ' + 1', _R)}) else {base(_P, _R)} end"
ALTERNATE = f"case when form = 9 then {base(_P, _R)} when form = 8 then concat({base(_P, _R)}, case when event_index % 4 = 0 then 'ACG' else 'AC' end) when form = 7 then concat({_NEXT.format(b=base(_P, _R))}, {_NEXT.format(b=base(_P + ' + 1', _R))}) else {_NEXT.format(b=base(_P, _R))} end"


def transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model's transcripts: one to three exons of one length, coding for three of four."""
    t = _table(spark, sf_dir, "part").selectExpr(*_split(SHAPE)).selectExpr("*", *_split(ENDS)).selectExpr("*", *_split(SPAN))
    letter = f"case when strand = 1 then {base(genomic('c'), 'seq_region')} else translate({base(genomic('c'), 'seq_region')}, 'ACGT', 'TGCA') end"
    return t.selectExpr(
        "*", f"case when coding then array_join(transform(sequence(11, 10 + cds_length), c -> {letter}), '') end AS cds_sequence", "cast(1 AS int) AS codon_table",
        f"case when coding then array_join(transform(sequence(11 + cds_length, exon_count * exon_len), c -> {letter}), '') end AS post_cds_sequence",
        "transform(sequence(0L, exon_count - 1), k -> named_struct('exon_start', transcript_start + k * (exon_len + intron_len), 'exon_end', transcript_start + k * (exon_len + intron_len) + exon_len - 1, "
        "'exon_cdna_start', if(strand = 1, k, exon_count - 1 - k) * exon_len + 1, 'exon_cdna_end', (if(strand = 1, k, exon_count - 1 - k) + 1) * exon_len)) AS exons",
    )


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alleles on the same regions: mostly substitutions, with some of two bases, insertions and deletions."""
    e = _table(spark, sf_dir, "events").selectExpr(*_split(EVENT))
    return e.selectExpr("event_index", "seq_region", "position", f"{REFERENCE} AS reference", f"{ALTERNATE} AS alternate", "form")


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regulatory regions and motifs."""
    return _table(spark, sf_dir, "part").selectExpr(*_split(FEATURE))


FEATURE = "p_partkey AS regulation_feature_index, cast(p_partkey % 5 + (p_partkey - p_partkey % 2000) * 5 AS bigint) AS seq_region, cast(1001 + (p_partkey * 53) % 17000 AS bigint) AS feature_start, cast(1001 + (p_partkey * 53) % 17000 + p_partkey % 40 AS bigint) AS feature_end, cast(1 + p_partkey % 2 AS int) AS feature_kind"


def structural_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "events").selectExpr(*_split(STRUCTURAL))


STRUCTURAL = """event_id AS event_index, cast(event_id % 5 + (event_id - event_id % 10000) AS bigint) AS seq_region, cast(1001 + (event_id * 13 + user_id * 7) % 18000 AS bigint) AS position,
  cast(1001 + (event_id * 13 + user_id * 7) % 18000 + (event_id * 7) % 600 AS bigint) AS end_position, case event_id % 4 when 0 then 'DEL' when 1 then 'DUP' when 2 then 'INV' else 'CNV' end AS structural_type,
  case event_id % 4 when 0 then 'LOSS' when 1 then 'GAIN' when 2 then 'NEUTRAL' else 'UNKNOWN' end AS copy_change"""


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table in as many parts as there are cores, or more: its few row groups would leave the costly columns to a few tasks."""
    df, n = spark.read.parquet(f"{sf_dir}/{name}.parquet"), 2 * spark.sparkContext.defaultParallelism
    return df.repartition(n)


def _split(columns: str) -> list[str]:
    """The top-level comma-separated parts, text in quotes kept whole."""
    out, depth, part, quoted = [], 0, "", False
    for ch in columns:
        quoted ^= ch == "'"
        depth += 0 if quoted else (ch == "(") - (ch == ")")
        if ch == "," and not depth and not quoted:
            out.append(part)
            part = ""
        else:
            part += ch
    return [*out, part]


#: The same relations for another engine: tx (one row for each transcript), ex (for each exon), ev, small (with alleles).
CTE = f"""
tx0 AS (SELECT {SHAPE} FROM part), tx1 AS (SELECT *, {ENDS} FROM tx0), tx AS (SELECT *, {SPAN} FROM tx1),
ex AS (SELECT t.*, k, transcript_start + k * (exon_len + intron_len) AS es, transcript_start + k * (exon_len + intron_len) + exon_len - 1 AS ee,
  (CASE WHEN strand = 1 THEN k ELSE exon_count - 1 - k END) * exon_len + 1 AS exon_cdna FROM tx t, unnest(range(exon_count)) AS u(k)),
ev0 AS (SELECT {EVENT} FROM events), ev AS (SELECT *, {REFERENCE} AS reference, {ALTERNATE} AS alternate FROM ev0)
"""


def seq(first: str, last: str) -> str:
    """SQL, for the other engine, for a transcript's spliced bases first..last on its own strand."""
    letter = f"CASE WHEN strand = 1 THEN {base(genomic('c'), 'seq_region')} ELSE translate({base(genomic('c'), 'seq_region')}, 'ACGT', 'TGCA') END"
    return f"array_to_string(list_transform(range({first}, {last} + 1), lambda c: {letter}), '')"


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The made-up reference in chunks of 1,000 bases (start counts from 0)."""
    letters = f"array_join(transform(sequence(start + 1, end), p -> {base('p', 'seq_region')}), '')"
    regions = transcripts(spark, sf_dir).select("seq_region").distinct()
    return regions.selectExpr("seq_region", "explode(sequence(0L, 20000L, 1000L)) AS start").selectExpr("seq_region", "start", "start + 1000 AS end").selectExpr("*", f"{letters} AS seq")
