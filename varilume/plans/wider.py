"""Queries of projected annotation, HGVS with a reference, circular regions, calls and relations beside a model."""

from __future__ import annotations

from pyspark.sql import functions as F

from varilume.operators import annotate as A
from varilume.operators import association, calls, circular, structural
from varilume.plans import fixtures as X
from varilume.plans.annotation import ALL
from varilume.sources.vcf import coding_calls as vcf_coding_calls

K = X.FLANK
PAIR = "event_index", "transcript_index"


def annotate_projected(spark, sf_dir):
    got = A.annotate_projected(X.events(spark, sf_dir), X.transcripts(spark, sf_dir), K, K)
    columns = ("output_allele", "interbase", "cdna_start", "cdna_end", "cds_start", "cds_end", "protein_start", "protein_end", "exon_first", "exon_last", "exon_total", "intron_first", "intron_last", "intron_total", "transcript_distance")
    return got.select(*PAIR, *(F.col(c).cast("bigint").alias(c) if c.startswith(("exon", "intron")) else F.col(c) for c in columns))


def transcript_projection(spark, sf_dir):
    """Codons and residues of substitutions in the CDS, from annotations made before."""
    ev, tx = X.events(spark, sf_dir), X.transcripts(spark, sf_dir)
    keys = A.small_variants(ev, tx, K, K, (*PAIR, "cds"))
    return A.transcript_projection(ev, keys, tx).filter("reference_codons is not null").select(*PAIR, F.upper("reference_codons").alias("codons"), F.length(F.regexp_replace("reference_codons", "[a-z]", "")).cast("bigint").alias("changed"))


def hgvs_substitutions(spark, sf_dir):
    """c. and n. names of all substitutions of one base within transcripts, in introns and UTRs too."""
    ev = X.events(spark, sf_dir).filter("length(reference) = 1 and length(alternate) = 1")
    got = A.small_variants(ev, X.transcripts(spark, sf_dir), K, K, (*PAIR, "within", "transcript_hgvs"), X.chunks(spark, sf_dir))
    return got.filter("within").select(*PAIR, "transcript_hgvs")


def hgvs_indels(spark, sf_dir):
    """c., n. and p. names of insertions, deletions and longer substitutions; no SQL, tests hold them to brute force."""
    ev = X.events(spark, sf_dir).filter("length(reference) > 1 or length(alternate) > 1")
    return A.small_variants(ev, X.transcripts(spark, sf_dir), K, K, (*PAIR, *A.HGVS), X.chunks(spark, sf_dir))


def unspecified_alternates(spark, sf_dir):
    ev = X.events(spark, sf_dir).withColumns({"reference": F.substring("reference", 1, 1), "alternate": F.lit("<*>")})
    got = A.unspecified_alternates(ev, X.transcripts(spark, sf_dir), K, K)
    term = lambda t: F.col("consequence").contains(t)
    return got.select(*PAIR, term("start_retained").alias("start"), term("stop_retained").alias("stop"), term("coding_sequence").alias("unknown"))


def _rotated(spark, sf_dir):
    """Transcripts on circles of 20,000 bases, turned by 15,000, so that some cross the origin."""
    turn = lambda c: (c + 14_999) % 20_000 + 1
    tx = X.transcripts(spark, sf_dir)
    exons = F.transform("exons", lambda x: F.struct(turn(x["exon_start"]).alias("exon_start"), turn(x["exon_end"]).alias("exon_end"), x["exon_cdna_start"].alias("exon_cdna_start"), x["exon_cdna_end"].alias("exon_cdna_end")))
    return tx.withColumns({c: turn(F.col(c)) for c in ("transcript_start", "transcript_end", "cds_start", "cds_end")} | {"exons": exons})


def circular_pairs(spark, sf_dir):
    tx = _rotated(spark, sf_dir)
    regions = tx.select("seq_region").distinct().select("seq_region", F.lit(20_000).alias("sequence_length"), F.lit(True).alias("circular"))
    got = circular.annotate_circular(X.events(spark, sf_dir), tx, regions, K, K, (*PAIR, "within", "upstream", "downstream", "exon_hit"))
    return got.withColumnRenamed("exon_hit", "exon")


GT = "case event_id % 13 when 0 then '0/0' when 1 then '0|1' when 2 then './1' when 3 then '1|2' when 4 then '.' when 5 then '0|0' when 6 then '|0|1' when 7 then './.' when 8 then '1/2|0' when 9 then '7/1' when 10 then '1//0' when 11 then '2' else '/1' end"


def raw_gt(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr("event_id AS event_index", f"{GT} AS gt")
    return e.select("event_index", calls.raw_gt(F.col("gt"), F.lit(2)).alias("x")).select("event_index", "x.status", "x.disposition", F.col("x.ploidy").cast("bigint").alias("ploidy"), "x.has_missing", F.col("x.slots").cast("bigint").alias("slots"), F.col("x.allele_first").cast("bigint").alias("allele_first"), F.col("x.allele_second").cast("bigint").alias("allele_second"))


CALLS = """o_orderkey AS event_index, o_custkey AS transcript_index, o_orderkey % 2 AS sample_index, cast(0 AS bigint) AS seq_region, o_orderkey AS position, 'A' AS reference, 'C' AS alternate, cast(1 AS bigint) AS alt_index,
 case o_orderkey % 7 when 0 then 0 when 1 then 1 else 0 end AS a1, case when o_orderkey % 11 = 0 then null when o_orderkey % 3 = 0 then 0 else 1 end AS a2, o_orderkey % 5 = 0 AS piped, case when o_orderkey % 4 = 0 then o_orderkey % 3 end AS phase_set"""


def _calls(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/orders.parquet").selectExpr(*X._split(CALLS))
    return c.withColumns({"alleles": F.array("a1", "a2"), "phase_before": F.array(F.lit(False), F.col("piped"))})


def resolve_single(spark, sf_dir):
    return calls.resolve_single(_calls(spark, sf_dir)).select("event_index", F.get("phase_before", F.lit(1)).alias("phased"))


def call_inputs(spark, sf_dir):
    got = calls.call_inputs(_calls(spark, sf_dir))
    return got.select("event_index", F.array_join(F.array_compact(F.transform("phase_sets", lambda x: x.cast("string"))), ",").alias("phase_sets"), "ploidies", "copies", "versions")


def record_order(spark, sf_dir):
    return calls.record_order(X.events(spark, sf_dir).withColumn("ordinal", F.col("event_index"))).select("event_index", "record_order")


def exon_rows(spark, sf_dir):
    return association.unnested(X.transcripts(spark, sf_dir), "exons").select("transcript_index", "exon_start", "exon_end", "exon_cdna_start", "exon_cdna_end")


MAPPING = """'m1' AS model_sha256, p_partkey AS transcript_index, case p_partkey % 3 when 0 then 'exact_model_match' when 1 then 'cds_exact_utr_differs' else 'no_match' end AS mapping_status,
 case when p_partkey % 2 = 0 then 'MANE_Select' else 'MANE_Plus' end AS status, concat('NM_', p_partkey) AS refseq_nuc, concat('NP_', p_partkey) AS refseq_prot, 'x' AS mapping_label, 'd' AS source_digest, 'GRCh38' AS target_assembly"""


def mane_association(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    one = p.selectExpr(*X._split(MAPPING))
    # a second mapping for each fourth transcript
    maps = one.unionByName(one.filter("transcript_index % 4 = 0").withColumns({"refseq_nuc": F.concat("refseq_nuc", F.lit(".2"))}))
    known = p.filter("p_partkey % 10 > 0").selectExpr("'m1' AS model_sha256", "p_partkey AS transcript_index", "p_partkey % 5 = 0 AS canonical", "true AS gencode_basic", "false AS no_retained_canonical")
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").selectExpr("'m1' AS model_sha256", "l_partkey AS transcript_index", "l_orderkey AS event_index", "l_linenumber AS line")
    got = association.with_mane(rows, known, maps)
    text = lambda c: F.array_join(F.transform(c, lambda x: F.concat(x["status"], F.lit(":"), x["refseq_nuc"])), ",")
    return got.select("event_index", F.col("line").cast("bigint").alias("line"), "transcript_index", "canonical", text("mane_mapped").alias("mapped"), text("mane_coding_region_only").alias("coding_only"))


REPEATS = """event_id AS event_index, case when event_id % 17 = 0 then 'cag' when event_id % 19 = 0 then null else 'CAG' end AS RU, case when event_id % 23 = 0 then -1 else event_id % 40 end AS REF_COUNT,
 case when event_id % 7 = 0 then './.' when event_id % 5 = 0 then '1' else '0/1' end AS GT, case event_id % 4 when 0 then 'SPANNING/FLANKING' when 1 then 'SPANNING/SPANNING' when 2 then 'SPANNING' else 'SPANNING/ODD' end AS SO,
 case when event_id % 5 = 0 then '12' when event_id % 29 = 0 then '12/x' else '12/30' end AS REPCN"""


def expansionhunter(spark, sf_dir):
    return structural.expansionhunter(spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr(*X._split(REPEATS)))


def coding_calls(spark, sf_dir):
    """Calls of two samples on the coding transcripts that each record touches."""
    r = X.events(spark, sf_dir).selectExpr("event_index AS ordinal", "concat('r', seq_region) AS CHROM", "position AS POS", "reference AS REF", "array(alternate) AS ALT", "'GT:PS' AS FORMAT", "array(case event_index % 3 when 0 then '0|1:5' when 1 then '1/1:.' else './1:7' end, '0/0:.') AS samples")
    tx = X.transcripts(spark, sf_dir)
    regions = tx.select("seq_region").distinct().selectExpr("seq_region", "concat('r', seq_region) AS seq_region_name")
    got = vcf_coding_calls(r, regions, tx)
    return got.select("event_index", "transcript_index", "sample_index", F.col("alt_index").cast("bigint").alias("alt_index"), F.array_join(F.transform("alleles", lambda x: x.cast("string")), ",", ".").alias("alleles"), F.get("phase_before", F.lit(1)).alias("piped"), "phase_set")


QUERIES = {f.__name__: f for f in (annotate_projected, transcript_projection, hgvs_substitutions, hgvs_indels, unspecified_alternates, circular_pairs, raw_gt, resolve_single, call_inputs, record_order, exon_rows, mane_association, expansionhunter, coding_calls)}

_SPLIT = "CASE WHEN gt LIKE '%|%' THEN string_split(gt, '|') ELSE string_split(gt, '/') END"
_TURN = "({c} + 14999) % 20000 + 1"
ORACLES = {
    "annotate_projected": f"""WITH {X.CTE}, {ALL},
 a AS (SELECT *, CASE WHEN within THEN CASE WHEN s > e THEN coalesce(c1, c2 + 1) ELSE c1 END END AS f, CASE WHEN within THEN CASE WHEN s > e THEN coalesce(c2, c1 - 1) ELSE c2 END END AS g FROM fa),
 b AS (SELECT *, coalesce(s > e AND (f > 10 + cds_length OR g < 11), false) AS out_ FROM a),
 c AS (SELECT *, CASE WHEN coding AND f BETWEEN 11 AND 10 + cds_length AND NOT out_ THEN f - 10 END AS q1, CASE WHEN coding AND g BETWEEN 11 AND 10 + cds_length AND NOT out_ THEN g - 10 END AS q2 FROM b),
 d AS (SELECT *, (q1 + 2) // 3 AS p1, (q2 + 2) // 3 AS p2 FROM c)
 SELECT event_index, transcript_index, CASE form WHEN 9 THEN '-' WHEN 8 THEN substring(alternate, 2) ELSE alternate END AS output_allele, s > e AS interbase,
 CASE WHEN f > g THEN g ELSE f END AS cdna_start, CASE WHEN f > g THEN f ELSE g END AS cdna_end, CASE WHEN q1 > q2 THEN q2 ELSE q1 END AS cds_start, CASE WHEN q1 > q2 THEN q1 ELSE q2 END AS cds_end,
 CASE WHEN p1 > p2 THEN p2 ELSE p1 END AS protein_start, CASE WHEN p1 > p2 THEN p1 ELSE p2 END AS protein_end, exon_first, exon_last, exon_count AS exon_total, intron_first, intron_last, exon_count - 1 AS intron_total,
 CASE WHEN e < transcript_start OR s > transcript_end THEN least(abs(s - transcript_start), abs(s - transcript_end), abs(e - transcript_start), abs(e - transcript_end)) END AS transcript_distance FROM d""",
    "transcript_projection": f"""WITH {X.CTE}, {ALL}, a AS (SELECT *, CASE WHEN coding AND c1 BETWEEN 11 AND 10 + cds_length AND c2 BETWEEN 11 AND 10 + cds_length AND c2 - c1 = e - s THEN c1 - 10 END AS q1, c2 - 10 AS q2 FROM fa),
 b AS (SELECT *, (q1 + 2) // 3 AS p1, (q2 + 2) // 3 AS p2 FROM a WHERE q1 IS NOT NULL)
 SELECT event_index, transcript_index, CASE WHEN p2 < p1 THEN '-' ELSE {X.seq('11 + (p1 - 1) * 3', 'least(10 + p2 * 3, 10 + cds_length)')} END AS codons, CASE WHEN p2 < p1 THEN 1 ELSE CAST(greatest(0, e - s + 1) AS BIGINT) END AS changed FROM b""",
    "hgvs_substitutions": f"""WITH {X.CTE}, {ALL}, a AS (SELECT event_index, transcript_index, max(CASE WHEN ee < s THEN ee END) AS low, min(CASE WHEN es > s THEN es END) AS up FROM g1 GROUP BY 1, 2),
 l AS (SELECT f.*, low, up, (CASE WHEN strand = 1 THEN reference ELSE translate(reference, 'ACGT', 'TGCA') END) || '>' || (CASE WHEN strand = 1 THEN alternate ELSE translate(alternate, 'ACGT', 'TGCA') END) AS change, s - low < up - s OR (s - low = up - s AND strand = 1) AS lower_
   FROM fa f JOIN a USING (event_index, transcript_index) WHERE form < 7 AND within),
 h AS (SELECT *, CASE WHEN c1 IS NOT NULL THEN 0 WHEN lower_ THEN (s - low) * strand ELSE (s - up) * strand END AS off, CASE WHEN lower_ THEN low ELSE up END AS edge FROM l),
 x AS (SELECT h.*, coalesce(c1, exon_cdna + CASE WHEN h.strand = 1 THEN edge - es ELSE ee - edge END) AS anchor FROM h LEFT JOIN (SELECT transcript_index AS ti, es, ee, exon_cdna FROM ex) x ON c1 IS NULL AND ti = transcript_index AND edge BETWEEN es AND ee),
 y AS (SELECT *, CASE WHEN off = 0 THEN '' WHEN off > 0 THEN '+' || off ELSE '' || off END AS tail FROM x)
 SELECT event_index, transcript_index, CASE WHEN NOT coding THEN 'n.' || anchor || tail WHEN anchor > 10 + cds_length THEN 'c.*' || (anchor - 10 - cds_length) || tail WHEN anchor = 10 + cds_length AND off <> 0 THEN 'c.*' || off
  WHEN anchor >= 11 THEN 'c.' || (anchor - 10) || tail ELSE 'c.' || (anchor - 11) || tail END || change AS transcript_hgvs FROM y""",
    "unspecified_alternates": f"""WITH {X.CTE}, p AS (SELECT e.event_index, e.position AS pos, t.* FROM ev e JOIN tx t ON e.seq_region = t.seq_region AND t.transcript_start <= e.position + {K} AND t.transcript_end >= e.position - {K}),
 h AS (SELECT p.event_index, p.transcript_index, any_value(p.strand) AS strand, any_value(pos) AS pos, any_value(p.cds_start) AS cs, any_value(p.cds_end) AS ce, coalesce(bool_or(pos BETWEEN es AND ee AND pos BETWEEN p.cds_start AND p.cds_end), false) AS cds FROM p JOIN ex x ON p.transcript_index = x.transcript_index GROUP BY 1, 2),
 i AS (SELECT *, cds AND CASE WHEN strand = 1 THEN pos <= cs + 2 ELSE pos >= ce - 2 END AS a, cds AND CASE WHEN strand = 1 THEN pos >= ce - 2 ELSE pos <= cs + 2 END AS b FROM h)
 SELECT event_index, transcript_index, a AS start, b AND NOT a AS stop, cds AND NOT a AND NOT b AS unknown FROM i""",
    "circular_pairs": f"""WITH {X.CTE}, {ALL.split("pa AS")[0]} t0 AS (SELECT *, {_TURN.format(c='transcript_start')} AS us FROM tx), t1 AS (SELECT *, us + transcript_end - transcript_start AS ue FROM t0),
 w AS (SELECT seq_region, bool_or(ue > 20000) AS wraps FROM t1 GROUP BY 1), t2 AS (SELECT t1.*, i, us + i * 20000 AS a, ue + i * 20000 AS b FROM t1 JOIN w USING (seq_region), unnest([-1, 0, 1]) AS v(i) WHERE wraps OR i = 0),
 c AS (SELECT m.event_index, m.s, m.e, t.*, greatest(0, a - greatest(s, e), least(s, e) - b) AS away, CASE WHEN least(s, e) - b > 0 THEN 1 ELSE 0 END AS side FROM sm m JOIN t2 t ON m.seq_region = t.seq_region AND a <= greatest(s, e) + {K} AND b >= least(s, e) - {K}),
 d AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY event_index, transcript_index ORDER BY away, side) = 1)
 SELECT event_index, transcript_index, e >= a AND s <= b AS within, CASE WHEN strand = 1 THEN e < a ELSE s > b END AS upstream, CASE WHEN strand = 1 THEN s > b ELSE e < a END AS downstream,
 e >= a AND s <= b AND EXISTS (SELECT 1 FROM (SELECT unnest(range(exon_count)) AS k) WHERE e >= a + k * (exon_len + intron_len) AND s <= a + k * (exon_len + intron_len) + exon_len - 1) AS exon FROM d""",
    "raw_gt": f"""WITH a AS (SELECT event_id AS event_index, {GT} AS gt FROM events), b AS (SELECT *, regexp_full_match(gt, '[|/]?([0-9]+|\\.)([|/]([0-9]+|\\.))*') AS valid, regexp_extract_all(gt, '[0-9]+|\\.') AS atoms FROM a),
 c AS (SELECT *, len(list_filter(atoms, lambda t: TRY_CAST(t AS BIGINT) > 2)) > 0 AS far, NOT regexp_matches(gt, '^[|/]') AND len(list_filter(atoms, lambda t: t = '.' OR TRY_CAST(t AS BIGINT) <> 0)) = 0 AS plain, list_filter({_SPLIT}, lambda t: t <> '.') AS tokens FROM (SELECT * REPLACE (CASE WHEN valid THEN atoms ELSE [] END AS atoms) FROM b)),
 d AS (SELECT *, valid AND NOT far AS ok, CASE WHEN plain THEN [] ELSE list_transform(tokens, lambda t: coalesce(TRY_CAST(regexp_extract(t, '^[0-9]+') AS BIGINT), 0)) END AS slot FROM c)
 SELECT event_index, CASE WHEN NOT valid THEN 'invalid_syntax' WHEN far THEN 'allele_out_of_range' ELSE 'ok' END AS status, CASE WHEN ok THEN CASE WHEN plain THEN 'omitted_reference' WHEN len(slot) > 0 THEN 'retained' ELSE 'omitted_empty' END END AS disposition,
 CASE WHEN ok THEN len(atoms) END AS ploidy, CASE WHEN ok THEN list_contains(atoms, '.') END AS has_missing, CASE WHEN ok THEN len(slot) END AS slots, CASE WHEN ok THEN slot[1] END AS allele_first, CASE WHEN ok THEN slot[2] END AS allele_second FROM d""",
    "resolve_single": f"""WITH c AS (SELECT {CALLS} FROM orders), d AS (SELECT *, count(*) FILTER (WHERE a1 IS NULL OR a2 IS NULL OR a1 <> a2) OVER (PARTITION BY transcript_index, sample_index) AS unsure FROM c)
 SELECT event_index, coalesce(a1 <> a2 AND NOT piped AND unsure = 1, false) OR piped AS phased FROM d""",
    "call_inputs": f"""WITH c AS (SELECT {CALLS} FROM orders), d AS (SELECT transcript_index, sample_index, coalesce(string_agg(DISTINCT CAST(phase_set AS VARCHAR), ',' ORDER BY CAST(phase_set AS VARCHAR)), '') AS phase_sets FROM c GROUP BY 1, 2)
 SELECT event_index, phase_sets, 1 AS ploidies, 1 AS copies, 1 AS versions FROM c JOIN d USING (transcript_index, sample_index)""",
    "record_order": f"WITH {X.CTE} SELECT event_index, row_number() OVER (PARTITION BY seq_region ORDER BY position, event_index) - 1 AS record_order FROM ev",
    "exon_rows": f"WITH {X.CTE} SELECT transcript_index, es AS exon_start, ee AS exon_end, exon_cdna AS exon_cdna_start, exon_cdna + exon_len - 1 AS exon_cdna_end FROM ex",
    "mane_association": f"""WITH o AS (SELECT {MAPPING} FROM part), m AS (SELECT * FROM o UNION ALL SELECT * REPLACE (concat(refseq_nuc, '.2') AS refseq_nuc) FROM o WHERE transcript_index % 4 = 0),
 g AS (SELECT transcript_index, string_agg(status || ':' || refseq_nuc, ',' ORDER BY status, refseq_nuc) FILTER (WHERE mapping_status = 'exact_model_match') AS mapped, string_agg(status || ':' || refseq_nuc, ',' ORDER BY status, refseq_nuc) FILTER (WHERE mapping_status = 'cds_exact_utr_differs') AS coding_only FROM m GROUP BY 1)
 SELECT l_orderkey AS event_index, CAST(l_linenumber AS BIGINT) AS line, l_partkey AS transcript_index, l_partkey % 5 = 0 AS canonical, mapped, coding_only FROM lineitem LEFT JOIN g ON l_partkey = transcript_index WHERE l_partkey % 10 > 0 AND l_partkey IN (SELECT p_partkey FROM part)""",
    "expansionhunter": f"""WITH r AS (SELECT {REPEATS} FROM events), s AS (SELECT *, string_split(replace(GT, '|', '/'), '/') AS g, string_split(SO, '/') AS so_, string_split(REPCN, '/') AS cn FROM r),
 t AS (SELECT *, CASE WHEN RU IS NULL OR NOT regexp_full_match(RU, '[ACGTURYKMSWBDHVN]+') THEN 'invalid_unit' WHEN REF_COUNT < 0 THEN 'invalid_reference_count' WHEN GT LIKE '%.%' THEN 'missing_genotype' WHEN len(g) <> len(so_) OR len(g) <> len(cn) THEN 'field_count_mismatch'
   WHEN len(list_filter(cn, lambda x: NOT regexp_full_match(x, '[0-9]+'))) > 0 THEN 'invalid_repeat_count' WHEN list_contains(so_, 'ODD') THEN 'unknown_support' END AS reason, NOT list_contains(so_, 'FLANKING') AND NOT list_contains(so_, 'ODD') AS exact_ FROM s)
 SELECT event_index, CASE WHEN reason IS NOT NULL THEN 'unsupported' WHEN exact_ THEN 'exact' ELSE 'summary_only' END AS status, reason, CASE WHEN reason IS NULL THEN array_to_string(list_transform(cn, lambda x: RU || 'x' || x), ',') END AS alleles, CASE WHEN reason IS NULL THEN exact_ END AS exact FROM t""",
    "coding_calls": f"""WITH {X.CTE}, {ALL}, h AS (SELECT DISTINCT event_index, transcript_index FROM g1 JOIN (SELECT transcript_index AS ti, coding AS c FROM tx) t ON ti = transcript_index WHERE c AND e >= greatest(es, cs) AND s <= least(ee, ce))
 SELECT event_index * 64 AS event_index, transcript_index, i AS sample_index, CAST(1 AS BIGINT) AS alt_index, CASE WHEN i = 1 THEN '0,0' ELSE CASE event_index % 3 WHEN 0 THEN '0,1' WHEN 1 THEN '1,1' ELSE '.,1' END END AS alleles, i = 0 AND event_index % 3 = 0 AS piped, CASE WHEN i = 0 THEN CASE event_index % 3 WHEN 0 THEN 5 WHEN 2 THEN 7 END END AS phase_set FROM h, unnest([0, 1]) AS v(i)""",
}
