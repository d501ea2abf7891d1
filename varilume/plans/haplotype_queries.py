"""Queries of structural preparation, phase and haplotypes."""

from __future__ import annotations

from pyspark.sql import functions as F

from varilume.functions.vocab import GENETIC_CODES
from varilume.operators import haplotypes as H
from varilume.operators import structural as S
from varilume.plans import fixtures as X

BND = """event_id AS event_index, cast('chr1' AS {s}) AS CHROM, event_id * 10 AS POS, case when event_id % 31 = 0 then cast('.' AS {s}) else concat('b', event_id - event_id % 2 * (case when event_id % 37 = 1 then 1 else 0 end)) end AS ID,
 case when event_id % 41 = 0 then 'ACGT' when event_id % 43 = 0 then 'G.' when event_id % 2 = 0 then concat('A', case when event_id % 10 = 0 then 'T' else '' end, '[chr1:', (event_id + 1) * 10 + case when event_id % 22 = 0 then 1 else 0 end, '[') else concat(']chr1:', (event_id - 1) * 10, ']A') end AS ALT,
 case when event_id % 29 = 0 then cast(null AS {s}) when event_id % 2 = 0 then concat('b', event_id + 1) else concat('b', event_id - 1) end AS INFO_MATEID, case when event_id % 14 = 0 then 'E1' when event_id % 14 = 1 then 'E1' end AS INFO_EVENT"""


def breakend_pairs(spark, sf_dir):
    r = spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr(*X._split(BND.format(s="string")))
    return S.breakend_pairs(r).select("event_index", "record_kind", "status", "reason", "mate_event_index", "id_reciprocal", "coordinate_reciprocal", "orientation_reciprocal", "insert_agree", "pair_key")


def breakend_fusion(spark, sf_dir):
    r = spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr(*X._split(BND.format(s="string")))
    genes = spark.read.parquet(f"{sf_dir}/events.parquet").filter("event_id % 3 > 0").selectExpr("event_id AS event_index", "concat('g', cast((event_id - event_id % 4) / 4 as bigint)) AS gene_id")
    got = S.breakend_fusion(S.breakend_pairs(r), genes)
    return got.groupBy("status").agg(F.count("*").alias("records"))


SV = """event_id AS event_index, cast(event_id + 1 AS bigint) AS POS, case when event_id % 5 = 4 then 'AC' else 'A' end AS REF, case event_id % 5 when 0 then '<DEL>' when 1 then '<DUP>' when 2 then 'AGG' when 3 then 'T' else 'ACTT' end AS ALT,
 case when event_id % 3 = 0 then cast(event_id + 40 AS {s}) when event_id % 7 = 0 then '12.5' end AS INFO_END, case when event_id % 4 = 0 then cast(event_id % 50 AS {s}) end AS INFO_SVLEN, case when event_id % 6 = 0 then '-5,10' when event_id % 11 = 0 then '9,3' end AS INFO_CIPOS"""


def sv_geometry(spark, sf_dir):
    r = spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr(*X._split(SV.format(s="string")))
    return S.sv_geometry(r).select("event_index", "status", "mode", "nominal_start", "nominal_end", "outer_start", "inner_start", "inserted_sequence")


def repeat_alleles(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_size")
    side = lambda n: F.array(F.struct(F.lit("CAG").alias("unit"), n.cast("double").alias("count")), F.struct(F.lit("T").alias("unit"), F.when(F.col("p_partkey") % 9 == 0, F.lit(1.5)).when(F.col("p_partkey") % 11 != 0, F.lit(2.0)).alias("count")))
    r = S.repeat_alleles(side(F.col("p_size") % 10), side(F.col("p_partkey") % 8), F.col("p_partkey") % 5 != 0)
    return p.withColumn("r", r).select("p_partkey", "r.reference", "r.alternate", "r.reference_length", "r.length_change", "r.length_direction", "r.status")


def structural_hgvs(spark, sf_dir):
    e = X.structural_events(spark, sf_dir).withColumn("n", F.col("event_index") % 7)
    seq = f"array_join(transform(sequence(1, cast(n as int)), i -> {X.base('position + i', 'seq_region')}), '')"
    e = e.selectExpr("event_index", "concat('chr', seq_region) AS CHROM", "position AS POS", "structural_type AS kind", "position + n AS end_position", f"if(n = 0, '', {seq}) AS reference_sequence")
    return S.structural_hgvs(e)


def phase_call(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey")
    k = F.col("o_orderkey")
    alleles = F.array((k % 2).cast("int"), F.when(k % 7 != 0, (k % 3).cast("int")))
    s = H.phase_call(alleles, F.array(F.lit(False), k % 4 == 0), k % 5)
    return o.select("o_orderkey", F.explode(s).alias("s")).select("o_orderkey", "s.input_slot", "s.allele_index", "s.haplotype_lane", "s.phase_set", "s.phase_scope", "s.status")


def _calls(spark, sf_dir):
    """Substitutions of coding exons, carried by three samples each: phased, homozygous or in a single heterozygote."""
    tx = X.transcripts(spark, sf_dir).filter("coding")
    place = f"{X.genomic('10 + g')}"
    e = tx.selectExpr("*", "explode(sequence(1L, cds_length, 17L)) AS g").selectExpr("transcript_index", "strand", "seq_region", "g", f"{place} AS position", f"{X.base(place, 'seq_region')} AS reference")
    e = e.selectExpr("transcript_index", "seq_region", "position", "reference", "translate(reference, 'ACGT', 'CGTA') AS alternate", "transcript_index * 1000 + g AS event_index", "explode(sequence(0L, 2L)) AS sample_index", "g")
    return e.filter("(g + sample_index) % 3 < 2").select("*", F.lit(1).alias("alt_index"), F.when((F.col("g") + F.col("sample_index")) % 3 == 0, F.array(F.lit(1), F.lit(0))).otherwise(F.array(F.lit(0), F.lit(1))).alias("alleles"), F.array(F.lit(False), F.lit(True)).alias("phase_before"), F.lit(1).cast("long").alias("phase_set"))


def haplotypes_core(spark, sf_dir):
    got = H.haplotypes(_calls(spark, sf_dir), X.transcripts(spark, sf_dir).filter("coding"))
    return got.select("transcript_index", F.array_join(F.col("contributors").cast("array<string>"), ",").alias("contributors"), "carrier_count", "sample_count", "haplotype_cds", "haplotype_protein", "prediction_status")


def haplotype_consequences(spark, sf_dir):
    got = H.haplotypes(_calls(spark, sf_dir), X.transcripts(spark, sf_dir).filter("coding"))
    return got.groupBy("haplotype_consequence").agg(F.count("*").alias("paths"), F.sum("carrier_count").alias("carriers"))


def interaction_blocks(spark, sf_dir):
    path = F.expr("array(named_struct('cds_first', cast(event_id % 9 + 1 as int), 'ref', 'A', 'alt', 'AT', 'event_index', event_id), named_struct('cds_first', cast(event_id % 9 + 6 + event_id % 5 as int), 'ref', 'AC', 'alt', 'A', 'event_index', event_id + 1), named_struct('cds_first', cast(event_id % 9 + 40 as int), 'ref', 'A', 'alt', 'G', 'event_index', event_id + 2))")
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", path.alias("path"))
    return e.select(F.col("event_id").alias("event_index"), F.array_join(F.transform(H.interaction_blocks(F.col("path")), lambda b: F.array_join(F.transform(b, lambda x: (x - F.col("event_id")).cast("string")), "+")), "|").alias("blocks"))


def ejc50(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", (F.col("p_partkey") % 700).alias("stop_end"), F.when(F.col("p_partkey") % 6 != 0, F.col("p_partkey") % 500 + 60).alias("junction"), (F.col("p_partkey") % 450).alias("n"))
    return p.select("p_partkey", H.ejc50(F.col("stop_end"), F.col("junction"), F.col("n")).alias("decay"))


def arrangements(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").selectExpr("o_custkey AS transcript_index", "cast(o_orderkey % 2 as bigint) AS sample_index", "cast(o_orderkey % 3 as int) AS block", "o_orderkey AS event_index", "cast(1 + o_orderkey % 5 % 2 as int) AS first_lane")
    full = o.groupBy("transcript_index", "sample_index").agg(F.collect_set("block").alias("b")).filter("size(b) = 3").select("transcript_index", "sample_index")
    got = H.arrangements(o.join(full, ["transcript_index", "sample_index"]))
    return got.select("transcript_index", "sample_index", "arrangement", "lane", F.array_join(F.col("events").cast("array<string>"), ",").alias("events"))


def sequence_diff_positional(spark, sf_dir):
    e = X.events(spark, sf_dir).selectExpr("event_index", f"concat({X.base('position', 'seq_region')}, {X.base('position + 1', 'seq_region')}, {X.base('position + 2', 'seq_region')}, {X.base('position + 3', 'seq_region')}) AS a", f"concat({X.base('position', 'seq_region')}, {X.base('position + 7', 'seq_region')}, {X.base('position + 9', 'seq_region')}, {X.base('position + 12', 'seq_region')}) AS b")
    return e.select("event_index", F.explode(H.positional_difference(F.col("a"), F.col("b"))).alias("d")).select("event_index", F.col("d.start").cast("long").alias("start"), "d.reference", "d.alternate")


QUERIES = {f.__name__: f for f in (sv_geometry, breakend_pairs, breakend_fusion, structural_hgvs, repeat_alleles, phase_call, haplotypes_core, haplotype_consequences, interaction_blocks, ejc50, arrangements, sequence_diff_positional)}

_PAIRS = f"""WITH r AS (SELECT {BND.format(s='VARCHAR')} FROM events), a AS (SELECT *, nullif(ID, '.') AS rid, CASE WHEN event_index % 41 = 0 THEN 'not_breakend' WHEN event_index % 43 = 0 THEN 'single_breakend' ELSE 'paired_breakend' END AS kind,
  CASE WHEN event_index % 41 = 0 OR event_index % 43 = 0 THEN NULL WHEN event_index % 2 = 0 THEN (event_index + 1) * 10 + CASE WHEN event_index % 22 = 0 THEN 1 ELSE 0 END ELSE (event_index - 1) * 10 END AS mp, event_index % 2 = 0 AS ja,
  CASE WHEN event_index % 41 = 0 THEN NULL WHEN event_index % 43 <> 0 AND event_index % 10 = 0 THEN 1 ELSE 0 END AS ins FROM r),
 n AS (SELECT rid, count(*) AS c, min(event_index) AS f FROM a WHERE rid IS NOT NULL GROUP BY rid),
 j AS (SELECT a.*, o.c AS oc, t.c AS mc, CASE WHEN t.c = 1 THEN t.f END AS mi, m.event_index AS m, m.kind AS mk, m.INFO_MATEID AS mm, m.mp AS mmp, m.POS AS mpos, m.ja AS mja, m.ins AS mins, m.INFO_EVENT AS me FROM a LEFT JOIN n o ON o.rid = a.rid LEFT JOIN n t ON t.rid = a.INFO_MATEID LEFT JOIN a m ON m.event_index = CASE WHEN t.c = 1 THEN t.f END),
 c AS (SELECT *, coalesce(mk = 'paired_breakend' AND mm = rid AND m <> event_index, false) AS r1, coalesce(mk = 'paired_breakend' AND mp = mpos AND mmp = POS, false) AS r2, coalesce(mk = 'paired_breakend' AND kind = 'paired_breakend' AND ja <> mja, false) AS r3, coalesce(mk = 'paired_breakend' AND ins = mins, false) AS r4, INFO_EVENT IS NOT DISTINCT FROM me AS r5 FROM j),
 d AS (SELECT *, CASE WHEN kind <> 'paired_breakend' THEN CASE WHEN kind = 'single_breakend' AND INFO_MATEID IS NOT NULL THEN 'single_breakend_with_mateid' ELSE kind END WHEN rid IS NULL THEN 'missing_id' WHEN oc > 1 THEN 'duplicate_id' WHEN INFO_MATEID IS NULL THEN 'missing_mateid' WHEN INFO_MATEID = rid THEN 'self_mate'
  WHEN mc IS NULL THEN 'mate_not_found' WHEN mc > 1 THEN 'ambiguous_mate_id' WHEN mk <> 'paired_breakend' THEN 'mate_not_paired_breakend' WHEN mm IS NULL THEN 'mate_missing_mateid' WHEN NOT r1 THEN 'mate_not_reciprocal' WHEN NOT r2 THEN 'mate_coordinate_conflict' WHEN NOT r3 THEN 'mate_orientation_conflict' WHEN NOT r4 THEN 'mate_insert_conflict' WHEN NOT r5 THEN 'event_conflict' ELSE 'reciprocal' END AS reason FROM c)"""
_GENES = "g AS (SELECT event_id AS e, 'g' || ((event_id - event_id % 4) // 4) AS gene FROM events WHERE event_id % 3 > 0)"
_T1 = GENETIC_CODES[1]
_HAP = f"""WITH {X.CTE}, t AS (SELECT *, {X.seq('11', '10 + cds_length')} AS cds FROM tx WHERE coding), s AS (SELECT t.*, g, smp FROM t, unnest(range(1, cds_length + 1, 17)) a(g), unnest(range(3)) b(smp) WHERE (g + smp) % 3 < 2),
 u AS (SELECT *, CASE WHEN (g + smp) % 3 = 0 THEN 1 ELSE 2 END AS lane FROM s), l AS (SELECT transcript_index, smp, lane, list(g ORDER BY g) AS path, any_value(cds) AS cds FROM u GROUP BY ALL),
 p AS (SELECT transcript_index, path, count(*) AS carrier_count, count(DISTINCT smp) AS sample_count, any_value(cds) AS cds FROM l GROUP BY transcript_index, path),
 h AS (SELECT p.*, strand, array_to_string(list_transform(range(1, length(p.cds) + 1), lambda i: CASE WHEN list_contains(path, i) THEN CASE WHEN strand = 1 THEN translate(p.cds[i], 'ACGT', 'CGTA') ELSE translate(p.cds[i], 'ACGT', 'TACG') END ELSE p.cds[i] END), '') AS new FROM p JOIN t USING (transcript_index))"""
_PROT = "array_to_string(list_transform(range(0, length(new) // 3), lambda i: substring('" + _T1 + "', (instr('TCAG', new[3 * i + 1]) - 1) * 16 + (instr('TCAG', new[3 * i + 2]) - 1) * 4 + instr('TCAG', new[3 * i + 3]), 1)), '')"
ORACLES = {
    "breakend_pairs": f"""{_PAIRS} SELECT event_index, kind AS record_kind, CASE WHEN reason = 'reciprocal' THEN 'reciprocal' WHEN reason IN ('not_breakend', 'single_breakend') THEN 'not_applicable' WHEN reason IN ('missing_id', 'missing_mateid', 'mate_not_found', 'mate_missing_mateid') THEN 'unproven' ELSE 'conflict' END AS status, reason,
 CASE WHEN kind = 'paired_breakend' AND mc = 1 AND INFO_MATEID <> rid THEN m END AS mate_event_index, r1 AS id_reciprocal, r2 AS coordinate_reciprocal, r3 AS orientation_reciprocal, r4 AS insert_agree, CASE WHEN reason = 'reciprocal' THEN least(event_index, m) || '|' || greatest(event_index, m) END AS pair_key FROM d""",
    "breakend_fusion": f"""{_PAIRS}, {_GENES}, f AS (SELECT d.*, x.gene AS ga, y.gene AS gb, CASE WHEN kind = 'paired_breakend' AND mc = 1 AND INFO_MATEID <> rid THEN m END AS mate FROM d LEFT JOIN g x ON x.e = event_index LEFT JOIN g y ON y.e = CASE WHEN kind = 'paired_breakend' AND mc = 1 AND INFO_MATEID <> rid THEN m END)
 SELECT CASE WHEN NOT (r1 AND r2 AND r5) THEN 'identity_unproven' WHEN ga IS NULL OR gb IS NULL THEN 'endpoint_without_gene' WHEN ga = gb THEN 'shared_gene_endpoints' WHEN r3 THEN 'candidate_partner_genes' ELSE 'candidate_orientation_conflict' END AS status, count(*) AS records FROM f GROUP BY 1""",
    "sv_geometry": f"""WITH r AS (SELECT {SV.format(s='VARCHAR')} FROM events), a AS (SELECT *, ALT LIKE '<%' AS sym, length(ALT) > length(REF) AND starts_with(ALT, REF) AND ALT NOT LIKE '<%' AS lit, CASE WHEN INFO_END NOT LIKE '%.%' THEN CAST(INFO_END AS BIGINT) END AS e, CAST(INFO_SVLEN AS BIGINT) AS l FROM r),
 b AS (SELECT *, CASE WHEN sym THEN POS + 1 ELSE POS + length(REF) END AS s0, CASE WHEN sym THEN coalesce(POS + l, e, POS + 1) ELSE POS + length(REF) - 1 END AS e0 FROM a), c AS (SELECT *, s0 + CAST(split_part(INFO_CIPOS, ',', 1) AS BIGINT) AS o, s0 + CAST(split_part(INFO_CIPOS, ',', 2) AS BIGINT) AS i FROM b)
 SELECT event_index, CASE WHEN (sym OR lit) AND e0 >= s0 - 1 AND (INFO_END IS NULL OR e > 0) AND (NOT sym OR (length(REF) = 1 AND (e IS NOT NULL OR l IS NOT NULL))) AND (INFO_CIPOS IS NULL OR (o >= 0 AND o <= i)) THEN 'ok' ELSE 'unsupported_geometry' END AS status,
 CASE WHEN sym THEN 'structural' WHEN lit THEN 'literal_insertion' ELSE 'unsupported' END AS mode, s0 AS nominal_start, e0 AS nominal_end, o AS outer_start, i AS inner_start, CASE WHEN lit THEN substring(ALT, length(REF) + 1) END AS inserted_sequence FROM c""",
    "repeat_alleles": """WITH a AS (SELECT p_partkey, p_size % 10 AS x, p_partkey % 8 AS y, CASE WHEN p_partkey % 5 = 0 THEN 'summary_only' WHEN p_partkey % 9 = 0 THEN 'nonintegral_count' WHEN p_partkey % 11 = 0 THEN 'incomplete_input' ELSE 'ok' END AS status FROM part)
 SELECT p_partkey, CASE WHEN status = 'ok' THEN repeat('CAG', x) || 'TT' END AS reference, CASE WHEN status = 'ok' THEN repeat('CAG', y) || 'TT' END AS alternate, CASE WHEN status = 'ok' THEN CAST(3 * x + 2 AS BIGINT) END AS reference_length, CASE WHEN status = 'ok' THEN CAST(3 * (y - x) AS BIGINT) END AS length_change,
 CASE WHEN status = 'ok' THEN CASE WHEN y > x THEN 'GAIN' WHEN y < x THEN 'LOSS' ELSE 'NEUTRAL' END END AS length_direction, status FROM a""",
    "structural_hgvs": f"""WITH e AS (SELECT {X.STRUCTURAL} FROM events), a AS (SELECT *, event_index % 7 AS n, structural_type AS kind FROM e), b AS (SELECT *, array_to_string(list_transform(range(1, n + 1), lambda i: {X.base('position + i', 'seq_region')}), '') AS seq FROM a),
 c AS (SELECT *, translate(reverse(seq), 'ACGT', 'TGCA') AS flip FROM b), d AS (SELECT *, list_filter(range(1, n + 1), lambda i: seq[i] <> flip[i]) AS x FROM c),
 f AS (SELECT *, list_min(x) AS lo, list_max(x) AS hi, CASE WHEN kind = 'CNV' THEN 'unsupported_type' WHEN n < 1 THEN 'empty_span' WHEN kind = 'INV' AND len(x) = 0 THEN 'no_change' ELSE 'ok' END AS status FROM d),
 g AS (SELECT *, CASE WHEN kind = 'INV' THEN position + lo ELSE position + 1 END AS s, CASE WHEN kind = 'INV' THEN position + hi ELSE position + n END AS t FROM f)
 SELECT event_index, status, CASE WHEN status = 'ok' THEN 'chr' || seq_region || ':g.' || s || CASE WHEN s = t THEN '' ELSE '_' || t END || lower(kind) END AS genomic_hgvs, CASE WHEN status = 'ok' THEN CASE WHEN kind = 'INV' THEN seq[lo:hi] ELSE seq END END AS equivalent_reference,
 CASE WHEN status = 'ok' THEN CASE kind WHEN 'DEL' THEN '' WHEN 'DUP' THEN seq || seq ELSE flip[lo:hi] END END AS equivalent_alternate FROM g""",
    "phase_call": """WITH a AS (SELECT o_orderkey, CAST(o_orderkey % 2 AS INTEGER) AS x, CASE WHEN o_orderkey % 7 <> 0 THEN CAST(o_orderkey % 3 AS INTEGER) END AS y, o_orderkey % 4 = 0 AS ph, o_orderkey % 5 AS ps FROM orders),
 b AS (SELECT *, coalesce(x = y, false) AS same FROM a), c AS (SELECT *, CASE WHEN same THEN 'all_phase_sets' WHEN ph THEN 'phase_set' ELSE 'unresolved' END AS scope FROM b), s AS (SELECT *, 1 AS slot, x AS al FROM c UNION ALL SELECT *, 2, y FROM c)
 SELECT o_orderkey, CAST(slot AS INTEGER) AS input_slot, al AS allele_index, CASE WHEN scope <> 'unresolved' THEN CAST(slot AS INTEGER) END AS haplotype_lane, CASE WHEN scope = 'phase_set' THEN ps END AS phase_set, scope AS phase_scope, CASE WHEN al IS NULL THEN 'missing' WHEN scope = 'unresolved' THEN 'unphased' ELSE 'called' END AS status FROM s""",
    "haplotypes_core": f"""{_HAP} SELECT transcript_index, array_to_string(list_transform(path, lambda g: transcript_index * 1000 + g), ',') AS contributors, carrier_count, sample_count, new AS haplotype_cds, {_PROT} AS haplotype_protein, 'ok' AS prediction_status FROM h""",
    "ejc50": """WITH a AS (SELECT p_partkey, p_partkey % 700 AS s, CASE WHEN p_partkey % 6 <> 0 THEN p_partkey % 500 + 60 END AS j, p_partkey % 450 AS n FROM part) SELECT p_partkey, CASE WHEN j IS NULL THEN 'no_downstream_junction' WHEN s <= 100 THEN 'start_proximal' WHEN n > 407 THEN 'long_exon' WHEN j - s > 50 THEN 'triggering' ELSE 'escaping' END AS decay FROM a""",
    "arrangements": """WITH o AS (SELECT o_custkey AS t, o_orderkey % 2 AS s, o_orderkey % 3 AS b, o_orderkey AS e, 1 + o_orderkey % 5 % 2 AS f FROM orders), k AS (SELECT t, s FROM o GROUP BY ALL HAVING count(DISTINCT b) = 3),
 x AS (SELECT o.*, a, l, CASE WHEN b = 0 THEN 0 ELSE (a >> CAST(b - 1 AS INTEGER)) & 1 END AS flip FROM o JOIN k USING (t, s), unnest(range(4)) q(a), unnest([1, 2]) w(l)), y AS (SELECT *, CASE WHEN flip = 1 THEN 3 - f ELSE f END = l AS here FROM x)
 SELECT t AS transcript_index, s AS sample_index, CAST(a AS INTEGER) AS arrangement, CAST(l AS INTEGER) AS lane, coalesce(string_agg(CAST(e AS VARCHAR), ',' ORDER BY e) FILTER (WHERE here), '') AS events FROM y GROUP BY t, s, a, l""",
    "sequence_diff_positional": f"""WITH {X.CTE}, a AS (SELECT event_index, {X.base('position + 1', 'seq_region')} AS a2, {X.base('position + 2', 'seq_region')} AS a3, {X.base('position + 3', 'seq_region')} AS a4, {X.base('position + 7', 'seq_region')} AS b2, {X.base('position + 9', 'seq_region')} AS b3, {X.base('position + 12', 'seq_region')} AS b4 FROM ev),
 p AS (SELECT event_index, 2 AS i, a2 AS x, b2 AS y FROM a WHERE a2 <> b2 UNION ALL SELECT event_index, 3, a3, b3 FROM a WHERE a3 <> b3 UNION ALL SELECT event_index, 4, a4, b4 FROM a WHERE a4 <> b4), q AS (SELECT *, i - row_number() OVER (PARTITION BY event_index ORDER BY i) AS g FROM p)
 SELECT event_index, CAST(min(i) AS BIGINT) AS start, string_agg(x, '' ORDER BY i) AS reference, string_agg(y, '' ORDER BY i) AS alternate FROM q GROUP BY event_index, g""",
}
