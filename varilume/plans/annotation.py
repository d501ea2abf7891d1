"""Queries of joins, classification and annotation."""

from __future__ import annotations

from pyspark.sql import functions as F

from varilume.functions.vocab import GENETIC_CODES, SO_TERMS, consequence, impact, impact_code, rules
from varilume.operators import annotate as A
from varilume.operators import intervals
from varilume.operators import lof as L
from varilume.operators.events import allele_geometry
from varilume.plans import fixtures as X

K = X.FLANK
PAIR = "event_index", "transcript_index"


def _snv(spark, sf_dir):
    return X.events(spark, sf_dir).filter("form < 7")


def _facts(spark, sf_dir, **columns):
    """Kernel columns of all pairs, under the names given."""
    got = A.small_variants(X.events(spark, sf_dir), X.transcripts(spark, sf_dir), K, K, (*PAIR, *columns.values()))
    return got.select(*PAIR, *(F.col(c).alias(n) for n, c in columns.items()))


def interval_join(spark, sf_dir):
    ev, tx = X.events(spark, sf_dir).select("event_index", "seq_region", "position"), X.transcripts(spark, sf_dir).select("transcript_index", "seq_region", "transcript_start", "transcript_end")
    return intervals.overlap_join(ev, tx, "seq_region", ("position", "position"), ("transcript_start", "transcript_end"), K).select(*PAIR)


def _exons(spark, sf_dir):
    return X.transcripts(spark, sf_dir).select("seq_region", F.explode("exons").alias("x")).select("seq_region", F.col("x.exon_start").alias("first"), F.col("x.exon_end").alias("last"))


def interval_union(spark, sf_dir):
    return intervals.interval_union(_exons(spark, sf_dir), ["seq_region"], "first", "last")


def asof_interval(spark, sf_dir):
    ev = X.events(spark, sf_dir).select("event_index", "seq_region", "position")
    return intervals.asof_interval(ev, interval_union(spark, sf_dir), "seq_region", "position", "first", "last").select("event_index", "first", "last", "inside")


def region_class(spark, sf_dir):
    return _facts(spark, sf_dir, upstream="upstream", downstream="downstream", exon="exon_hit", cds="cds", utr5="utr5", utr3="utr3", intron="intron")


def splice_class(spark, sf_dir):
    return _facts(spark, sf_dir, donor="donor", acceptor="acceptor", fifth="fifth", donor_region="donor_region", ppt="ppt", region="splice_near", intronic="intronic")


def projection(spark, sf_dir):
    return _facts(spark, sf_dir, cdna_start="cdna_start", cds_pos="cds_start_pos", protein_start="protein_start")


def annotate_snv(spark, sf_dir):
    got = A.annotate(_snv(spark, sf_dir), X.transcripts(spark, sf_dir), rich=True, hgvs=True, upstream_distance=K, downstream_distance=K)
    return got.select(*PAIR, "consequence_mask", "consequence", "impact", "cds_start_pos", "ref_codons", "alt_codons", "ref_peptide", "alt_peptide", "nmd_prediction", "transcript_hgvs", "protein_hgvs")


def annotate_rich(spark, sf_dir):
    """Small variants of all classes with all columns."""
    return A.annotate(X.events(spark, sf_dir), X.transcripts(spark, sf_dir), rich=True, hgvs=True, upstream_distance=K, downstream_distance=K)


def annotate_compact(spark, sf_dir):
    """Counts of events and pairs by consequence, over all classes of small variants."""
    got = A.annotate(X.events(spark, sf_dir), X.transcripts(spark, sf_dir), upstream_distance=K, downstream_distance=K)
    return got.groupBy("consequence", "impact").agg(F.count("*").alias("pairs"), F.countDistinct("event_index").alias("events"))


def indel_frame(spark, sf_dir):
    """Insertions and deletions wholly inside an exon's coding part, away from both ends: whether the frame shifts."""
    columns = (*PAIR, "cds_start_pos", "cds_end_pos", "cds_length", "ref_peptide", "alt_peptide", "frameshift", "length_difference")
    got = A.small_variants(X.events(spark, sf_dir).filter("form >= 8"), X.transcripts(spark, sf_dir), K, K, columns)
    inner = got.filter("cds_start_pos > 3 and cds_end_pos > 3 and cds_end_pos + 6 < cds_length and cds_start_pos + 6 < cds_length")
    return inner.filter("instr(ref_peptide, '*') = 0 and instr(alt_peptide, '*') = 0").select(*PAIR, "frameshift", F.col("length_difference").cast("long").alias("length_difference"))


def coverage_intergenic(spark, sf_dir):
    return A.without_candidates(X.events(spark, sf_dir), interval_join(spark, sf_dir))


def coding_transcripts(spark, sf_dir):
    got = A.coding_transcripts(_snv(spark, sf_dir), X.transcripts(spark, sf_dir))
    return got.select("event_index", F.array_join(F.col("transcripts").cast("array<string>"), ",").alias("transcripts"))


def interval_features(spark, sf_dir):
    ev = allele_geometry(_snv(spark, sf_dir)).select("event_index", "seq_region", "feature_start1", "feature_end1")
    return A.interval_features(ev, X.features(spark, sf_dir))


def sv_consequence(spark, sf_dir):
    ev = X.structural_events(spark, sf_dir).withColumns({"reference": F.lit("N"), "alternate": F.concat(F.lit("<"), "structural_type", F.lit(">"))})
    return A.structural_variants(ev, X.transcripts(spark, sf_dir), K, K).select(*PAIR, "consequence", "impact")


def breakend_candidates(spark, sf_dir):
    ev = X.structural_events(spark, sf_dir).withColumns({"mate_seq_region": F.col("seq_region"), "mate_position": F.col("end_position"), "alternate": F.lit("N[x:1[")})
    return A.breakends(ev, X.transcripts(spark, sf_dir), K).select(*PAIR, F.expr("consequence like '%feature_truncation%'").alias("truncated"))


def breakend_annotate(spark, sf_dir):
    """All structural events as breakends on all transcripts, coding ones too; no SQL."""
    ev = X.structural_events(spark, sf_dir).withColumns({"mate_seq_region": F.col("seq_region"), "mate_position": F.col("end_position"), "alternate": F.lit("N[x:1[")})
    return A.breakends(ev, X.transcripts(spark, sf_dir), K).select(*PAIR, "consequence", "impact")


def rule_program(spark, sf_dir):
    """Terms of made-up fact bits: three bits of each event's number pick facts of the three tiers."""
    ev = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_id").alias("event_index"))
    i = F.col("event_index")
    mask = rules({"transcript_ablation": i % 7 == 0, "mature_miRNA_variant": i % 3 == 0, "missense_variant": i % 2 == 0, "stop_gained": i % 5 == 0, "intron_variant": i % 11 == 0})
    return ev.select("event_index", mask.alias("consequence_mask"))


def impact_text(spark, sf_dir):
    m = F.col("consequence_mask")
    return rule_program(spark, sf_dir).select("event_index", consequence(m).alias("consequence"), impact_code(m).alias("impact_code"), impact(m).alias("impact"))


def lof(spark, sf_dir):
    """Loss-of-function calls of substitutions, with splice bases from reference chunks."""
    tx = X.transcripts(spark, sf_dir)
    return L.lof(A.small_variants(_snv(spark, sf_dir), tx, K, K, L.READ), X.chunks(spark, sf_dir))


QUERIES = {f.__name__: f for f in (interval_join, interval_union, asof_interval, region_class, splice_class, projection, annotate_snv, annotate_rich, annotate_compact, indel_frame, coverage_intergenic, coding_transcripts, interval_features, sv_consequence, breakend_candidates, breakend_annotate, lof, rule_program, impact_text)}

_PR = f"""
pr AS (SELECT e.event_index, e.position AS pos, e.reference, e.alternate, t.* FROM ev e JOIN tx t ON e.seq_region = t.seq_region
  AND t.transcript_start <= e.position + {K} AND t.transcript_end >= e.position - {K} WHERE e.form < 7),
fx AS (SELECT p.event_index, p.transcript_index, bool_or(pos BETWEEN es AND ee) AS in_exon,
  max(CASE WHEN pos BETWEEN es AND ee THEN exon_cdna + CASE WHEN p.strand = 1 THEN pos - es ELSE ee - pos END END) AS cdna,
  max(CASE WHEN pos BETWEEN es AND ee THEN CASE WHEN p.strand = 1 THEN k ELSE p.exon_count - 1 - k END END) AS exon_at,
  bool_or(k < p.exon_count - 1 AND pos - ee BETWEEN 1 AND 2) AS at_left, bool_or(k < p.exon_count - 1 AND pos - ee BETWEEN p.intron_len - 1 AND p.intron_len) AS at_right,
  bool_or(k < p.exon_count - 1 AND pos - ee = 5) AS five_left, bool_or(k < p.exon_count - 1 AND pos - ee = p.intron_len - 4) AS five_right,
  bool_or(k < p.exon_count - 1 AND pos - ee BETWEEN 3 AND 6) AS dr_left, bool_or(k < p.exon_count - 1 AND pos - ee BETWEEN p.intron_len - 5 AND p.intron_len - 2) AS dr_right,
  bool_or(k < p.exon_count - 1 AND pos - ee BETWEEN p.intron_len - 16 AND p.intron_len - 2) AS ppt_right, bool_or(k < p.exon_count - 1 AND pos - ee BETWEEN 3 AND 17) AS ppt_left,
  bool_or(k < p.exon_count - 1 AND (pos - ee BETWEEN 3 AND 8 OR pos - ee BETWEEN p.intron_len - 7 AND p.intron_len - 2 OR pos - ee BETWEEN -2 AND 0 OR pos - ee BETWEEN p.intron_len + 1 AND p.intron_len + 3)) AS near,
  bool_or(k < p.exon_count - 1 AND pos - ee BETWEEN 3 AND p.intron_len - 2) AS deep
  FROM pr p JOIN ex x ON p.transcript_index = x.transcript_index GROUP BY ALL),
cl AS (SELECT p.*, in_exon, cdna, exon_at, pos < transcript_start AS before, pos > transcript_end AS after,
  CASE WHEN strand = 1 THEN at_left ELSE at_right END AS donor, CASE WHEN strand = 1 THEN at_right ELSE at_left END AS acceptor,
  CASE WHEN strand = 1 THEN five_left ELSE five_right END AS fifth, CASE WHEN strand = 1 THEN dr_left ELSE dr_right END AS dr, CASE WHEN strand = 1 THEN ppt_right ELSE ppt_left END AS ppt, near, deep
  FROM pr p JOIN fx USING (event_index, transcript_index))
"""
#: Pairs of all alleles with the span s..e of what they change (an insertion: s = e + 1), and facts of exons and introns.
ALL = f"""
sm AS (SELECT *, position + CASE WHEN form >= 8 THEN 1 ELSE 0 END AS s, position + CASE form WHEN 7 THEN 1 WHEN 9 THEN 2 ELSE 0 END AS e FROM ev),
pa AS (SELECT m.event_index, m.position, m.reference, m.alternate, m.form, m.s, m.e, t.*, m.e >= t.transcript_start AND m.s <= t.transcript_end AS within FROM sm m JOIN tx t ON m.seq_region = t.seq_region
  AND t.transcript_start <= greatest(s, e) + {K} AND t.transcript_end >= least(s, e) - {K}),
g1 AS (SELECT p.event_index, p.transcript_index, p.s, p.e, p.strand, p.exon_count AS n, k, es, ee, ee + 1 AS a, ee + p.intron_len AS b, k < p.exon_count - 1 AS gap, p.cds_start AS cs, p.cds_end AS ce, exon_cdna FROM pa p JOIN ex x ON p.transcript_index = x.transcript_index),
g2 AS (SELECT event_index, transcript_index, bool_or(e >= es AND s <= ee) AS hit, bool_or(gap AND e >= a AND s <= b) AS between_,
  coalesce(bool_or(e >= es AND s <= ee AND least(e, ee) >= cs AND greatest(s, es) <= ce), false) AS on_cds,
  bool_or(gap AND e >= a AND s <= a + 1) AS d2, bool_or(gap AND e >= b - 1 AND s <= b) AS a2,
  bool_or(gap AND CASE WHEN strand = 1 THEN e >= a + 4 AND s <= a + 4 ELSE e >= b - 4 AND s <= b - 4 END) AS fifth,
  bool_or(gap AND CASE WHEN strand = 1 THEN e >= a + 2 AND s <= a + 5 ELSE e >= b - 5 AND s <= b - 2 END) AS dr,
  bool_or(gap AND CASE WHEN strand = 1 THEN greatest(s, e) >= b - 16 AND least(s, e) <= b - 2 ELSE greatest(s, e) >= a + 2 AND least(s, e) <= a + 16 END) AS ppt,
  bool_or(gap AND ((e >= a + 2 AND s <= a + 7) OR (e >= b - 7 AND s <= b - 2) OR (e >= a - 3 AND s <= a - 1) OR (e >= b + 1 AND s <= b + 3) OR (s = e + 1 AND (s = a OR e = b OR s = a + 2 OR e = b - 2)))) AS near,
  bool_or(gap AND ((e >= a + 2 AND s <= b - 2) OR (s = e + 1 AND (s = a + 2 OR e = b - 2)))) AS deep,
  max(CASE WHEN s BETWEEN es AND ee THEN exon_cdna + CASE WHEN strand = 1 THEN s - es ELSE ee - s END END) AS at_s, max(CASE WHEN e BETWEEN es AND ee THEN exon_cdna + CASE WHEN strand = 1 THEN e - es ELSE ee - e END END) AS at_e,
  min(CASE WHEN e >= es AND s <= ee THEN CASE WHEN strand = 1 THEN k + 1 ELSE n - k END END) AS exon_first, max(CASE WHEN e >= es AND s <= ee THEN CASE WHEN strand = 1 THEN k + 1 ELSE n - k END END) AS exon_last,
  min(CASE WHEN gap AND s <= b AND e >= a THEN CASE WHEN strand = 1 THEN k + 1 ELSE n - 1 - k END END) AS intron_first, max(CASE WHEN gap AND s <= b AND e >= a THEN CASE WHEN strand = 1 THEN k + 1 ELSE n - 1 - k END END) AS intron_last
  FROM g1 GROUP BY 1, 2),
fa AS (SELECT p.*, g.* EXCLUDE (event_index, transcript_index), CASE WHEN strand = 1 THEN at_s ELSE at_e END AS c1, CASE WHEN strand = 1 THEN at_e ELSE at_s END AS c2 FROM pa p JOIN g2 g USING (event_index, transcript_index))
"""
_CODE = GENETIC_CODES[1]


def _letter(c: str) -> str:
    b = X.base(X.genomic(c), "seq_region")
    return f"(CASE WHEN strand = 1 THEN {b} ELSE translate({b}, 'ACGT', 'TGCA') END)"


def _aa(codon: str) -> str:
    at = " + ".join(f"(instr('TCAG', substring({codon}, {k}, 1)) - 1) * {w}" for k, w in ((1, 16), (2, 4), (3, 1)))
    return f"substring('{_CODE}', {at} + 1, 1)"


_THREE = "CASE {x} WHEN 'A' THEN 'Ala' WHEN 'C' THEN 'Cys' WHEN 'D' THEN 'Asp' WHEN 'E' THEN 'Glu' WHEN 'F' THEN 'Phe' WHEN 'G' THEN 'Gly' WHEN 'H' THEN 'His' WHEN 'I' THEN 'Ile' WHEN 'K' THEN 'Lys' WHEN 'L' THEN 'Leu' WHEN 'M' THEN 'Met' WHEN 'N' THEN 'Asn' WHEN 'P' THEN 'Pro' WHEN 'Q' THEN 'Gln' WHEN 'R' THEN 'Arg' WHEN 'S' THEN 'Ser' WHEN 'T' THEN 'Thr' WHEN 'V' THEN 'Val' WHEN 'W' THEN 'Trp' WHEN 'Y' THEN 'Tyr' WHEN '*' THEN 'Ter' END"
_NAMES = ", ".join(f"({b}, '{n}', {i}, {r})" for b, n, i, r, _ in SO_TERMS)
_SNV = f"""
cd AS (SELECT *, CASE WHEN coding AND cdna BETWEEN 11 AND 10 + cds_length THEN cdna - 10 END AS cds FROM cl),
ce AS (SELECT *, cds - 1 - (cds - 1) % 3 AS q, CASE WHEN strand = 1 THEN alternate ELSE translate(alternate, 'ACGT', 'TGCA') END AS alt, CASE WHEN strand = 1 THEN reference ELSE translate(reference, 'ACGT', 'TGCA') END AS ref FROM cd),
cf AS (SELECT *, CASE WHEN cds IS NOT NULL THEN {_letter('11 + q')} || {_letter('12 + q')} || {_letter('13 + q')} END AS codon FROM ce),
cg AS (SELECT *, CASE WHEN cds IS NOT NULL THEN substring(codon, 1, (cds - 1) % 3) || alt || substring(codon, (cds - 1) % 3 + 2, 3) END AS changed FROM cf),
ch AS (SELECT *, {_aa('codon')} AS rp, {_aa('changed')} AS ap FROM cg),
ci AS (SELECT *, coalesce(cds <= 3 AND changed <> 'ATG', false) AS no_start, coalesce(cds <= 3 AND changed = 'ATG', false) AS new_start FROM ch),
cj AS (SELECT *, CAST(
   CASE WHEN (strand = 1 AND before) OR (strand = -1 AND after) THEN 1 ELSE 0 END + CASE WHEN (strand = 1 AND after) OR (strand = -1 AND before) THEN 2 ELSE 0 END
 + CASE WHEN deep THEN 4 ELSE 0 END
 + CASE WHEN coding AND in_exon AND ((strand = 1 AND pos < cds_start) OR (strand = -1 AND pos > cds_end)) THEN 8 ELSE 0 END
 + CASE WHEN coding AND in_exon AND ((strand = 1 AND pos > cds_end) OR (strand = -1 AND pos < cds_start)) THEN 16 ELSE 0 END
 + CASE WHEN NOT coding AND in_exon THEN 32 ELSE 0 END + CASE WHEN NOT coding AND NOT in_exon AND NOT before AND NOT after THEN 64 ELSE 0 END
 + CASE WHEN near AND NOT donor AND NOT acceptor AND NOT fifth AND NOT (dr AND NOT fifth) THEN 128 ELSE 0 END
 + CASE WHEN donor THEN 256 ELSE 0 END + CASE WHEN acceptor THEN 512 ELSE 0 END + CASE WHEN fifth THEN 1024 ELSE 0 END
 + CASE WHEN rp = ap AND rp <> '*' AND NOT no_start THEN 4096 ELSE 0 END + CASE WHEN rp <> ap AND rp <> '*' AND ap <> '*' AND NOT no_start THEN 8192 ELSE 0 END
 + CASE WHEN ap = '*' AND rp <> '*' THEN 16384 ELSE 0 END + CASE WHEN rp = '*' AND ap <> '*' THEN 32768 ELSE 0 END
 + CASE WHEN no_start THEN 65536 ELSE 0 END + CASE WHEN rp = '*' AND ap = '*' THEN 131072 ELSE 0 END
 + CASE WHEN dr AND NOT fifth THEN 524288 ELSE 0 END + CASE WHEN ppt AND NOT in_exon THEN 1048576 ELSE 0 END
 + CASE WHEN transcript_index % 17 = 0 AND NOT before AND NOT after THEN 2097152 ELSE 0 END + CASE WHEN new_start THEN 4294967296 ELSE 0 END AS BIGINT) AS mask FROM ci),
so(bit, name, code, rank) AS (VALUES {_NAMES}),
nm AS (SELECT mask, string_agg(name, '&' ORDER BY rank) AS consequence, max(code) AS code FROM (SELECT DISTINCT mask FROM cj) m JOIN so ON (mask >> bit) & 1 = 1 GROUP BY mask)
"""
_LAST = "CASE WHEN strand = 1 THEN {e} = exon_count - 1 ELSE {e} = exon_count - 1 END"
ORACLES = {
    "interval_join": f"WITH {X.CTE} SELECT e.event_index, t.transcript_index FROM ev e JOIN tx t ON e.seq_region = t.seq_region AND t.transcript_start <= e.position + {K} AND t.transcript_end >= e.position - {K}",
    "interval_union": f"""WITH {X.CTE}, a AS (SELECT seq_region, es, ee, max(ee) OVER (PARTITION BY seq_region ORDER BY es, ee ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM ex),
 b AS (SELECT *, sum(CASE WHEN reach IS NULL OR es > reach + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY seq_region ORDER BY es, ee ROWS UNBOUNDED PRECEDING) AS g FROM a)
 SELECT seq_region, min(es) AS first, max(ee) AS last FROM b GROUP BY seq_region, g""",
    "asof_interval": f"""WITH {X.CTE}, a AS (SELECT seq_region, es, ee, max(ee) OVER (PARTITION BY seq_region ORDER BY es, ee ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM ex),
 b AS (SELECT *, sum(CASE WHEN reach IS NULL OR es > reach + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY seq_region ORDER BY es, ee ROWS UNBOUNDED PRECEDING) AS g FROM a),
 c AS (SELECT seq_region, min(es) AS first, max(ee) AS last FROM b GROUP BY seq_region, g)
 SELECT e.event_index, c.first, c.last, coalesce(c.last >= e.position, false) AS inside FROM ev e ASOF LEFT JOIN c ON e.seq_region = c.seq_region AND e.position >= c.first""",
    "region_class": f"""WITH {X.CTE}, {ALL} SELECT event_index, transcript_index, CASE WHEN strand = 1 THEN e < transcript_start ELSE s > transcript_end END AS upstream, CASE WHEN strand = 1 THEN s > transcript_end ELSE e < transcript_start END AS downstream, within AND hit AS exon,
 coding AND within AND on_cds AS cds, coding AND within AND hit AND CASE WHEN strand = 1 THEN s <= cds_start - 1 ELSE e >= cds_end + 1 END AS utr5, coding AND within AND hit AND CASE WHEN strand = 1 THEN e >= cds_end + 1 ELSE s <= cds_start - 1 END AS utr3, within AND (between_ OR NOT hit) AS intron FROM fa""",
    "splice_class": f"""WITH {X.CTE}, {ALL} SELECT event_index, transcript_index, CASE WHEN strand = 1 THEN d2 ELSE a2 END AS donor, CASE WHEN strand = 1 THEN a2 ELSE d2 END AS acceptor, fifth, dr AND NOT fifth AS donor_region, ppt,
 near AND NOT d2 AND NOT a2 AND NOT dr AND NOT fifth AS region, deep AS intronic FROM fa""",
    "projection": f"""WITH {X.CTE}, {ALL}, q AS (SELECT *, CASE WHEN coding AND c1 BETWEEN 11 AND 10 + cds_length AND c2 BETWEEN 11 AND 10 + cds_length AND c2 - c1 = e - s THEN c1 - 10 END AS cds_pos FROM fa)
 SELECT event_index, transcript_index, c1 AS cdna_start, cds_pos, (cds_pos - 1 - (cds_pos - 1) % 3) // 3 + 1 AS protein_start FROM q""",
    "annotate_snv": f"""WITH {X.CTE}, {_PR}, {_SNV}
 SELECT event_index, transcript_index, cj.mask AS consequence_mask, consequence, CASE code WHEN 3 THEN 'HIGH' WHEN 2 THEN 'MODERATE' WHEN 1 THEN 'LOW' ELSE 'MODIFIER' END AS impact, cds AS cds_start_pos, codon AS ref_codons, changed AS alt_codons, rp AS ref_peptide, ap AS alt_peptide,
 CASE WHEN (ap = '*' AND rp <> '*') OR donor OR acceptor THEN CASE WHEN cds IS NULL THEN 'unresolved'
   WHEN exon_count = 1 OR cds <= 101 OR exon_at = exon_count - 1 OR (exon_at = exon_count - 2 AND cdna > (exon_count - 1) * exon_len - 51) THEN 'escaping' ELSE 'triggering' END END AS nmd_prediction,
 'c.' || cds || ref || '>' || alt AS transcript_hgvs,
 CASE WHEN no_start THEN 'p.' || {_THREE.format(x='rp')} || (q // 3 + 1) || '?' WHEN rp = ap THEN 'p.' || {_THREE.format(x='rp')} || (q // 3 + 1) || '=' WHEN rp <> '*' THEN 'p.' || {_THREE.format(x='rp')} || (q // 3 + 1) || {_THREE.format(x='ap')} END AS protein_hgvs
 FROM cj LEFT JOIN nm ON cj.mask = nm.mask""",
    "coverage_intergenic": f"""WITH {X.CTE} SELECT event_index, 'intergenic_variant' AS consequence, 'MODIFIER' AS impact, CAST(NULL AS VARCHAR) AS unresolved_reason FROM ev e
 WHERE NOT EXISTS (SELECT 1 FROM tx t WHERE e.seq_region = t.seq_region AND t.transcript_start <= e.position + {K} AND t.transcript_end >= e.position - {K})""",
    "coding_transcripts": f"""WITH {X.CTE} SELECT e.event_index, string_agg(CAST(x.transcript_index AS VARCHAR), ',' ORDER BY x.transcript_index) AS transcripts FROM ev e JOIN ex x ON e.seq_region = x.seq_region AND e.position BETWEEN x.es AND x.ee AND e.position BETWEEN x.cds_start AND x.cds_end WHERE e.form < 7 AND x.coding GROUP BY e.event_index""",
    "interval_features": f"""WITH {X.CTE}, f AS (SELECT {X.FEATURE} FROM part), h AS (SELECT event_index, regulation_feature_index, feature_kind, e.position <= feature_start AND e.position >= feature_end AS whole FROM ev e JOIN f ON e.seq_region = f.seq_region AND e.position BETWEEN f.feature_start AND f.feature_end WHERE form < 7)
 SELECT event_index, regulation_feature_index, CASE WHEN feature_kind = 2 THEN CAST(68719476736 AS BIGINT) ELSE CAST(549755813888 AS BIGINT) END AS consequence_mask, CASE WHEN feature_kind = 2 THEN 'TF_binding_site_variant' ELSE 'regulatory_region_variant' END AS consequence, 'MODIFIER' AS impact FROM h""",
    "rule_program": """SELECT event_id AS event_index, CAST(CASE WHEN event_id % 7 = 0 THEN 33554432 WHEN event_id % 3 = 0 THEN 4194304
 WHEN event_id % 2 = 0 OR event_id % 5 = 0 OR event_id % 11 = 0 THEN (CASE WHEN event_id % 2 = 0 THEN 8192 ELSE 0 END) + (CASE WHEN event_id % 5 = 0 THEN 16384 ELSE 0 END) + (CASE WHEN event_id % 11 = 0 THEN 4 ELSE 0 END) ELSE 8589934592 END AS BIGINT) AS consequence_mask FROM events""",
    "impact_text": """SELECT event_id AS event_index, CASE WHEN event_id % 7 = 0 THEN 'transcript_ablation' WHEN event_id % 3 = 0 THEN 'mature_miRNA_variant'
 WHEN event_id % 2 = 0 OR event_id % 5 = 0 OR event_id % 11 = 0 THEN concat_ws('&', CASE WHEN event_id % 5 = 0 THEN 'stop_gained' END, CASE WHEN event_id % 2 = 0 THEN 'missense_variant' END, CASE WHEN event_id % 11 = 0 THEN 'intron_variant' END) ELSE 'intergenic_variant' END AS consequence,
 CASE WHEN event_id % 7 = 0 THEN 3 WHEN event_id % 3 = 0 THEN 0 WHEN event_id % 5 = 0 THEN 3 WHEN event_id % 2 = 0 THEN 2 ELSE 0 END AS impact_code,
 CASE WHEN event_id % 7 = 0 THEN 'HIGH' WHEN event_id % 3 = 0 THEN 'MODIFIER' WHEN event_id % 5 = 0 THEN 'HIGH' WHEN event_id % 2 = 0 THEN 'MODERATE' ELSE 'MODIFIER' END AS impact FROM events""",
    "sv_consequence": f"""WITH {X.CTE}, sv AS (SELECT {X.STRUCTURAL} FROM events), p AS (SELECT s.event_index, s.position AS a, s.end_position AS b, s.structural_type AS kind, t.* FROM sv s JOIN tx t ON s.seq_region = t.seq_region AND t.transcript_start <= s.end_position + {K} AND t.transcript_end >= s.position - {K}),
 g AS (SELECT p.event_index, p.transcript_index, any_value(a) AS a, any_value(b) AS b, any_value(kind) AS kind, any_value(p.transcript_start) AS ts, any_value(p.transcript_end) AS te, any_value(p.strand) AS strand, any_value(p.coding) AS coding, any_value(p.cds_start) AS cs, any_value(p.cds_end) AS ce,
   bool_or(b >= es AND a <= ee) AS exon, coalesce(bool_or(b >= es AND a <= ee AND least(b, ee) >= p.cds_start AND greatest(a, es) <= p.cds_end), false) AS on_cds, bool_or(a >= es AND b <= ee) AS in_one, bool_or(k < p.exon_count - 1 AND b >= ee + 3 AND a <= ee + p.intron_len - 2) AS deep,
   bool_or(k < p.exon_count - 1 AND CASE WHEN p.strand = 1 THEN b >= ee + p.intron_len - 16 AND a <= ee + p.intron_len - 2 ELSE b >= ee + 3 AND a <= ee + 17 END) AS ppt FROM p JOIN ex x ON p.transcript_index = x.transcript_index GROUP BY 1, 2),
 h AS (SELECT *, b >= ts AND a <= te AS within, a <= ts AND b >= te AS whole, a >= ts AND b <= te AS held, coding AND on_cds AS cds, coalesce(b >= cs AND a <= least(cs + 2, ce), false) AS low, coalesce(b >= greatest(ce - 2, cs) AND a <= ce, false) AS high FROM g),
 f AS (SELECT *, within AND NOT whole AS part, kind = 'DEL' AND within AND NOT whole AND in_one AND cds AND (b - a + 1) % 3 <> 0 AS shift, kind = 'DEL' AND within AND NOT whole AND in_one AND cds AND (b - a + 1) % 3 = 0 AND a >= cs AND b <= ce AS inframe FROM h),
 i AS (SELECT *, CASE WHEN whole AND kind = 'DEL' THEN 'transcript_ablation' WHEN whole AND kind = 'DUP' THEN 'transcript_amplification' ELSE concat_ws('&',
   CASE WHEN shift THEN 'frameshift_variant' END, CASE WHEN part AND kind = 'DEL' AND cds AND CASE WHEN strand = 1 THEN high ELSE low END THEN 'stop_lost' END, CASE WHEN part AND coding AND exon AND CASE WHEN strand = 1 THEN low ELSE high END THEN 'start_lost' END,
   CASE WHEN exon AND held AND kind = 'DUP' THEN 'feature_elongation' END, CASE WHEN exon AND part AND kind = 'DEL' THEN 'feature_truncation' END, CASE WHEN inframe THEN 'inframe_deletion' END,
   CASE WHEN ppt AND NOT exon AND NOT whole THEN 'splice_polypyrimidine_tract_variant' END, CASE WHEN cds AND NOT whole AND NOT shift AND NOT coalesce(inframe, false) THEN 'coding_sequence_variant' END,
   CASE WHEN coding AND exon AND NOT whole AND CASE WHEN strand = 1 THEN a <= cs - 1 ELSE b >= ce + 1 END THEN '5_prime_UTR_variant' END, CASE WHEN coding AND exon AND NOT whole AND CASE WHEN strand = 1 THEN b >= ce + 1 ELSE a <= cs - 1 END THEN '3_prime_UTR_variant' END,
   CASE WHEN NOT coding AND exon AND NOT whole THEN 'non_coding_transcript_exon_variant' END,
   CASE WHEN deep AND NOT whole THEN 'intron_variant' END, CASE WHEN within AND transcript_index % 17 = 0 THEN 'NMD_transcript_variant' END,
   CASE WHEN NOT coding AND within AND NOT (exon AND NOT whole) THEN 'non_coding_transcript_variant' END, CASE WHEN coding AND whole AND transcript_index % 17 <> 0 THEN 'coding_transcript_variant' END,
   CASE WHEN (strand = 1 AND b < ts) OR (strand = -1 AND a > te) THEN 'upstream_gene_variant' END, CASE WHEN (strand = 1 AND a > te) OR (strand = -1 AND b < ts) THEN 'downstream_gene_variant' END) END AS consequence FROM f)
 SELECT event_index, transcript_index, CASE WHEN consequence = '' THEN 'intergenic_variant' ELSE consequence END AS consequence, CASE WHEN regexp_matches(consequence, '^(transcript_a|feature_|frameshift|stop_lost|start_lost)') THEN 'HIGH' WHEN consequence LIKE 'inframe%' THEN 'MODERATE' WHEN consequence LIKE 'splice_poly%' THEN 'LOW' ELSE 'MODIFIER' END AS impact FROM i""",
    "breakend_candidates": f"""WITH {X.CTE}, sv AS (SELECT {X.STRUCTURAL} FROM events), pt AS (SELECT event_index, seq_region, position AS p FROM sv UNION ALL SELECT event_index, seq_region, end_position FROM sv)
 SELECT event_index, transcript_index, bool_or(p BETWEEN transcript_start AND transcript_end) AS truncated FROM pt JOIN tx ON pt.seq_region = tx.seq_region AND transcript_start <= p + {K} AND transcript_end >= p - {K} GROUP BY 1, 2""",
    "lof": f"""WITH {X.CTE}, {_PR}, {_SNV},
 k AS (SELECT *, CASE WHEN strand = 1 THEN cds_end ELSE cds_start END AS stop, ap = '*' AND rp <> '*' AS gained FROM cj WHERE coding AND ((ap = '*' AND rp <> '*') OR donor OR acceptor)),
 w AS (SELECT k.event_index, k.transcript_index, sum(CASE WHEN (k.strand = 1 AND pos > ee) OR (k.strand = -1 AND pos < es) THEN 0 ELSE abs(
   CASE WHEN (k.strand = 1 AND es < stop AND ee >= stop) OR (k.strand = -1 AND ee > stop AND es <= stop) THEN stop WHEN k.strand = 1 THEN ee ELSE es END - CASE WHEN pos BETWEEN es AND ee THEN pos WHEN k.strand = 1 THEN es ELSE ee END) END) AS dist,
   max(CASE WHEN stop BETWEEN es AND ee AND NOT ((k.strand = 1 AND pos > ee) OR (k.strand = -1 AND pos < es)) THEN CASE WHEN k.strand = 1 THEN stop - es ELSE ee - stop END END) AS own,
   max(CASE WHEN k2 < k.exon_count - 1 AND pos > ee AND pos <= ee + k.intron_len THEN ee END) AS edge FROM k JOIN (SELECT transcript_index, k AS k2, es, ee FROM ex) x ON x.transcript_index = k.transcript_index GROUP BY ALL),
 b AS (SELECT k.*, dist, own, edge, {X.base('edge + 1', 'seq_region')} || {X.base('edge + 2', 'seq_region')} AS l2, {X.base('edge + intron_len - 1', 'seq_region')} || {X.base('edge + intron_len', 'seq_region')} AS r2,
   {' || '.join(X.base(f'pos + {i}', 'seq_region') for i in range(-4, 5))} AS near9 FROM k JOIN w USING (event_index, transcript_index)),
 c AS (SELECT *, CASE WHEN strand = 1 THEN l2 ELSE translate(reverse(r2), 'ACGT', 'TGCA') END AS f2, CASE WHEN strand = 1 THEN r2 ELSE translate(reverse(l2), 'ACGT', 'TGCA') END AS e2, CASE WHEN strand = 1 THEN near9 ELSE translate(reverse(near9), 'ACGT', 'TGCA') END AS n9 FROM b),
 d AS (SELECT *, nullif(concat_ws(',', CASE WHEN gained AND cds IS NOT NULL AND dist - own <= 50 THEN 'END_TRUNC' END, CASE WHEN donor AND f2 = 'GC' AND ref = 'C' AND alt = 'T' THEN 'GC_TO_GT_DONOR' END,
   CASE WHEN (donor OR acceptor) AND ((strand = 1 AND pos < cds_start) OR (strand = -1 AND pos > cds_end)) THEN '5UTR_SPLICE' END, CASE WHEN (donor OR acceptor) AND ((strand = 1 AND pos > cds_end) OR (strand = -1 AND pos < cds_start)) THEN '3UTR_SPLICE' END), '') AS lof_filter FROM c)
 SELECT event_index, transcript_index, CASE WHEN lof_filter IS NULL THEN 'HC' ELSE 'LC' END AS lof, lof_filter,
 nullif(concat_ws(',', CASE WHEN gained AND exon_count = 1 THEN 'SINGLE_EXON' END, CASE WHEN (donor OR acceptor) AND NOT (f2 = 'GT' AND e2 = 'AG') THEN 'NON_CAN_SPLICE' END, CASE WHEN acceptor AND regexp_matches(n9, 'AG.AG') THEN 'NAGNAG_SITE' END), '') AS lof_flags,
 nullif(concat_ws(',', CASE WHEN gained AND cds IS NOT NULL THEN 'GERP_END_TRUNC' END, CASE WHEN exon_at IS NOT NULL THEN 'PHYLOCSF' END, 'ANC_ALLELE'), '') AS lof_unchecked FROM d""",
}
