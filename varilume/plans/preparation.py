"""Queries of vocabulary, sequence helpers and event preparation."""

from __future__ import annotations

from pyspark.sql import functions as F

from varilume.functions import dna, vocab
from varilume.operators import events as E
from varilume.plans import fixtures as X

_TABLES = sorted(vocab.GENETIC_CODES)
ALT = "case event_id % 7 when 0 then concat('A[chr', user_id, ':', event_id + 1, '[') when 1 then concat(']chr', user_id, ':', event_id + 1, ']GT') when 2 then 'AC.' when 3 then '.TTG' when 4 then 'ACGT' when 5 then concat('C]HLA:', user_id, ':', event_id + 1, ']') else concat('G[chr', user_id, ':', event_id + 1, ']') end"


def so_terms(spark, sf_dir):
    return vocab.so_terms(spark)


def _windows(spark, sf_dir):
    return X.events(spark, sf_dir).selectExpr("event_index", "concat(reference, alternate, 'nRyU', reference) AS s")


def revcomp(spark, sf_dir):
    return _windows(spark, sf_dir).select("event_index", dna.revcomp(F.col("s")).alias("reverse_complement"))


def dna_normalize(spark, sf_dir):
    return _windows(spark, sf_dir).select("event_index", dna.normalize(F.col("s")).alias("normalized"))


def codon_translate(spark, sf_dir):
    ev = X.events(spark, sf_dir).selectExpr("event_index", f"concat({X.base('position', 'seq_region')}, {X.base('position + 1', 'seq_region')}, {X.base('position + 2', 'seq_region')}) AS codon")
    tables = F.element_at(F.array(*map(F.lit, _TABLES)), (F.col("event_index") % len(_TABLES) + 1).cast("int"))
    return ev.withColumn("t", tables).select("event_index", F.col("t").alias("codon_table"), dna.residue(F.col("codon"), F.col("t")).alias("residue"))


def allele_geometry(spark, sf_dir):
    got = E.allele_geometry(X.events(spark, sf_dir))
    return got.select("event_index", "variant_kind", "start1", "end1", "feature_start1", "feature_end1", "edit_start0", "edit_end0", "reference_difference", "alternate_difference", "anchor", "boundary0")


def breakend_geometry(spark, sf_dir):
    ev = spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr("event_id AS event_index", f"{ALT} AS alt")
    return ev.withColumn("b", E.breakend_geometry(F.col("alt"))).select("event_index", "b.inserted", "b.mate_chrom", "b.mate_position", "b.local_left", "b.mate_left")


RECORD = """concat('chr', event_id % 6) AS CHROM, cast(100 + event_id % 900 AS bigint) AS POS, cast(event_id AS varchar(20)) AS ID, case when event_id % 13 = 12 then '' else 'A' end AS REF,
 case event_id % 17 when 0 then '<DEL>' when 1 then '<DUP:TANDEM>' when 2 then '<INS:ME:ALU>' when 3 then '<CN0>' when 4 then concat('A[chr', event_id % 6, ':77[') when 5 then 'A.' when 6 then 'A[x[' when 7 then '<INV>' when 8 then '<BND>' else 'G' end AS A1,
 event_id % 19 = 0 AS TWO, case when event_id % 17 in (0, 7) and event_id % 3 > 0 then case when event_id % 23 = 0 then '20.5' else cast(100 + event_id % 900 + event_id % 40 - 3 AS varchar(20)) end end AS INFO_END,
 case when event_id % 17 in (1, 2, 8) then cast(event_id % 30 AS varchar(20)) end AS INFO_SVLEN, case when event_id % 17 = 8 then 'DUP' when event_id % 29 = 0 then 'DEL' end AS INFO_SVTYPE"""


def vcf_events(spark, sf_dir):
    records = spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr(*X._split(RECORD.replace("varchar(20)", "string")))
    records = records.withColumn("ALT", F.when(F.col("TWO"), F.array("A1", F.lit("T"))).otherwise(F.array("A1")))
    regions = spark.read.parquet(f"{sf_dir}/region.parquet").selectExpr("r_regionkey AS seq_region", "concat('chr', r_regionkey) AS seq_region_name")
    got = E.vcf_events(records, regions)
    return got.select("event_index", "seq_region", "position", "end_position", "structural_type", "structural_geometry", "copy_change", "mate_seq_region", "mate_position", "event_kind", "event_status", "event_reason", "source_id", F.col("alt_index").cast("long").alias("alt_index"))


QUERIES = {f.__name__: f for f in (so_terms, revcomp, dna_normalize, codon_translate, allele_geometry, breakend_geometry, vcf_events)}

_SO = ", ".join(f"({b}, {1 << b}, '{n}', {i}, '{vocab.IMPACTS[i]}', {r}, {t})" for b, n, i, r, t in vocab.SO_TERMS)
_CODES = " ".join(f"WHEN {k} THEN '{v}'" for k, v in vocab.GENETIC_CODES.items())
_S = f"WITH {X.CTE}, w AS (SELECT event_index, concat(reference, alternate, 'nRyU', reference) AS s FROM ev)"
ORACLES = {
    "so_terms": f"SELECT CAST(b AS INTEGER) AS bit_index, CAST(m AS BIGINT) AS consequence_mask, n AS consequence, CAST(i AS INTEGER) AS impact_code, p AS impact, CAST(r AS INTEGER) AS severity_rank, CAST(t AS INTEGER) AS evaluator_tier FROM (VALUES {_SO}) v(b, m, n, i, p, r, t)",
    "revcomp": f"{_S} SELECT event_index, translate(reverse(s), 'ACGTUNRYKMBDHVSWacgtunrykmbdhvsw', 'TGCAANYRMKVHDBSWtgcaanyrmkvhdbsw') AS reverse_complement FROM w",
    "dna_normalize": f"{_S} SELECT event_index, replace(upper(s), 'U', 'T') AS normalized FROM w",
    "codon_translate": f"""WITH {X.CTE}, c AS (SELECT event_index, list_extract([{', '.join(map(str, _TABLES))}], event_index % {len(_TABLES)} + 1) AS t, concat({X.base('position', 'seq_region')}, {X.base('position + 1', 'seq_region')}, {X.base('position + 2', 'seq_region')}) AS k FROM ev)
 SELECT event_index, t AS codon_table, substring(CASE t {_CODES} END, (instr('TCAG', k[1]) - 1) * 16 + (instr('TCAG', k[2]) - 1) * 4 + instr('TCAG', k[3]), 1) AS residue FROM c""",
    "allele_geometry": f"""WITH {X.CTE}, g AS (SELECT *, length(reference) AS n, length(alternate) AS m FROM ev),
 p AS (SELECT *, coalesce(list_min(list_filter(range(1, least(n, m) + 1), lambda i: reference[i] <> alternate[i])) - 1, least(n, m)) AS pre FROM g),
 q AS (SELECT *, coalesce(list_min(list_filter(range(1, least(n, m) - pre + 1), lambda i: reference[n - i + 1] <> alternate[m - i + 1])) - 1, least(n, m) - pre) AS suf FROM p),
 d AS (SELECT *, reference[pre + 1 : n - suf] AS rd, alternate[pre + 1 : m - suf] AS ad FROM q)
 SELECT event_index, CASE WHEN rd = '' THEN 'insertion' WHEN ad = '' THEN 'deletion' WHEN length(rd) = length(ad) THEN CASE WHEN length(rd) = 1 THEN 'snv' ELSE 'mnv' END ELSE 'indel' END AS variant_kind,
 position AS start1, position + n - 1 AS end1, CASE WHEN n = m THEN position ELSE position + pre END AS feature_start1, CASE WHEN n = m THEN position + n - 1 ELSE position + n - 1 - suf END AS feature_end1,
 position - 1 + pre AS edit_start0, position - 1 + pre + length(rd) AS edit_end0, rd AS reference_difference, ad AS alternate_difference,
 CASE WHEN rd = '' THEN CASE WHEN pre > 0 THEN 'left' ELSE 'right' END END AS anchor, CASE WHEN rd = '' THEN position - 1 + pre END AS boundary0 FROM d""",
    "breakend_geometry": f"""WITH a AS (SELECT event_id AS event_index, {ALT} AS alt, event_id, user_id, event_id % 7 AS f FROM events)
 SELECT event_index, CASE f WHEN 0 THEN 'A' WHEN 1 THEN 'GT' WHEN 2 THEN 'AC' WHEN 3 THEN 'TTG' WHEN 5 THEN 'C' END AS inserted, CASE WHEN f IN (0, 1) THEN 'chr' || user_id WHEN f = 5 THEN 'HLA:' || user_id END AS mate_chrom,
 CASE WHEN f IN (0, 1, 5) THEN event_id + 1 END AS mate_position, CASE WHEN f IN (0, 2, 5) THEN false WHEN f IN (1, 3) THEN true END AS local_left, CASE WHEN f = 0 THEN false WHEN f IN (1, 5) THEN true END AS mate_left FROM a""",
    "vcf_events": f"""WITH r AS (SELECT {RECORD} FROM events), a AS (SELECT *, unnest(CASE WHEN TWO THEN [1, 2] ELSE [1] END) AS k FROM r),
 b AS (SELECT *, CASE WHEN k = 1 THEN A1 ELSE 'T' END AS alt, A1 <> 'G' AND (INFO_SVTYPE IS NOT NULL OR NOT (A1 = 'A.' AND TWO)) AS st, CASE WHEN regexp_full_match(INFO_END, '[0-9]+') THEN CAST(INFO_END AS BIGINT) END AS e, CAST(INFO_SVLEN AS BIGINT) AS l,
   CASE WHEN CAST(substring(CHROM, 4) AS INT) < 5 THEN CAST(substring(CHROM, 4) AS INT) END AS region FROM a),
 c AS (SELECT *, CASE WHEN A1 LIKE 'A[chr%' THEN 'bnd' WHEN A1 = 'A.' THEN 'one' END AS bk, coalesce(POS + abs(l), e, POS + 1) AS ve,
   CASE alt WHEN '<DEL>' THEN 'DEL' WHEN '<DUP:TANDEM>' THEN 'TDUP' WHEN '<INS:ME:ALU>' THEN 'INS' WHEN '<INV>' THEN 'INV' WHEN '<CN0>' THEN 'unsupported_symbolic_allele' WHEN '<BND>' THEN 'DUP' END AS ty FROM b),
 d AS (SELECT *, CASE WHEN region IS NULL THEN 'contig_not_in_model' WHEN REF = '' THEN 'missing_reference' WHEN NOT st THEN NULL WHEN TWO THEN 'multiallelic_structural_record' WHEN bk = 'one' THEN 'single_breakend'
   WHEN bk = 'bnd' THEN NULL WHEN A1 = 'A[x[' THEN 'malformed_breakend' WHEN ty IS NULL THEN 'literal_alleles_with_svtype' WHEN ty LIKE 'uns%' THEN ty WHEN INFO_END IS NOT NULL AND e IS NULL THEN 'invalid_end'
   WHEN ty = 'DEL' AND (POS + 1 > ve OR (e IS NULL AND l IS NULL)) THEN 'incomplete_deletion' WHEN ty = 'INS' AND ve < POS THEN 'invalid_span' WHEN ty <> 'INS' AND ve < POS + 1 THEN 'empty_span' END AS why,
   CASE WHEN NOT st THEN 'small_variant' WHEN bk IS NOT NULL AND NOT TWO THEN 'breakend' WHEN ty IS NOT NULL AND ty NOT LIKE 'uns%' THEN 'structural_variant' END AS kind FROM c),
 f AS (SELECT *, why IS NULL AS ok, CASE WHEN kind = 'structural_variant' AND NOT (ty = 'INS' AND ve < POS + 1) THEN POS + 1 ELSE POS END AS p, CASE WHEN kind = 'structural_variant' THEN CASE WHEN ty = 'INS' AND ve < POS + 1 THEN POS ELSE ve END END AS pe FROM d)
 SELECT row_number() OVER (ORDER BY CASE WHEN ok THEN region END NULLS LAST, CASE WHEN ok THEN p END NULLS LAST, CASE WHEN ok THEN pe END NULLS FIRST, CHROM, POS, ID, k) AS event_index, CASE WHEN ok THEN region END AS seq_region, CASE WHEN ok THEN p END AS position, CASE WHEN ok THEN pe END AS end_position,
 CASE WHEN ok AND kind = 'structural_variant' THEN ty END AS structural_type, CASE WHEN ok AND kind = 'structural_variant' AND ty = 'INS' AND ve = POS + 1 THEN 'POINT' END AS structural_geometry,
 CASE WHEN ok AND kind = 'structural_variant' THEN CASE ty WHEN 'DEL' THEN 'LOSS' WHEN 'DUP' THEN 'GAIN' WHEN 'TDUP' THEN 'GAIN' WHEN 'INV' THEN 'NEUTRAL' ELSE 'UNKNOWN' END END AS copy_change,
 CASE WHEN ok AND kind = 'breakend' THEN region END AS mate_seq_region, CASE WHEN ok AND kind = 'breakend' THEN CAST(77 AS BIGINT) END AS mate_position, kind AS event_kind, CASE WHEN ok THEN 'ok' ELSE 'unsupported' END AS event_status, why AS event_reason, ID AS source_id, CAST(k AS BIGINT) AS alt_index FROM f""",
}
