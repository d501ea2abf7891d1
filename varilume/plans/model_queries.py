"""Queries that build models from Ensembl-shaped relations."""

from __future__ import annotations

from pyspark.sql import functions as F

from varilume.operators import model as M
from varilume.plans import fixtures as X


def _regions(spark, sf_dir):
    r = spark.read.parquet(f"{sf_dir}/region.parquet")
    coord = spark.createDataFrame([(1, 1, "chromosome", "A38", 1), (2, 1, "scaffold", "A38", 2), (3, 2, "chromosome", "A38", 1)], "coord_system_id int, species_id int, name string, version string, rank int")
    seq = r.selectExpr("cast(100 - r_regionkey as int) AS seq_region_id", "concat('chr', r_regionkey) AS name", "cast(1 + r_regionkey % 2 as int) AS coord_system_id", "20000 AS length")
    attrib = r.filter("r_regionkey = 3").selectExpr("cast(100 - r_regionkey as int) AS seq_region_id", "7 AS attrib_type_id", "'1' AS value")
    kinds = spark.createDataFrame([(7, "circular_seq")], "attrib_type_id int, code string")
    contigs = r.filter("r_regionkey < 4").selectExpr("concat('chr', r_regionkey) AS chrom", "20000 AS length")
    return M.regions(coord, seq, attrib, kinds, contigs, "A38")


def regions(spark, sf_dir):
    return _regions(spark, sf_dir).select(F.col("seq_region").cast("long").alias("seq_region"), "seq_region_name", "circular", "source_id")


def _map(spark, sf_dir):
    return X.transcripts(spark, sf_dir).select(F.col("seq_region").alias("source_id"), "seq_region").distinct()


def transcripts_build(spark, sf_dir):
    """The fixture's transcripts taken apart into core tables and built again, with sequences from reference chunks."""
    t = X.transcripts(spark, sf_dir)
    core = t.selectExpr("transcript_index AS transcript_id", "concat('T', transcript_index) AS stable_id", "1 AS is_current", "'protein_coding' AS biotype", "seq_region AS seq_region_id", "transcript_start AS seq_region_start", "transcript_end AS seq_region_end", "strand AS seq_region_strand")
    x = t.selectExpr("transcript_index AS transcript_id", "strand", "exon_count", "posexplode(exons) AS (k, e)").selectExpr("transcript_id", "transcript_id * 10 + k AS exon_id", "cast(if(strand = 1, k + 1, exon_count - k) as int) AS rank", "e.exon_start AS seq_region_start", "e.exon_end AS seq_region_end")
    place = "cast((({c}) - 1 - (({c}) - 1) % exon_len) / exon_len as bigint)"
    exon_of = lambda c: f"transcript_index * 10 + if(strand = 1, {place.format(c=c)}, exon_count - 1 - {place.format(c=c)})"
    tl = t.filter("coding").selectExpr("transcript_index AS transcript_id", "11 - 1 - (11 - 1) % exon_len AS z", "cast(10 % exon_len + 1 as bigint) AS seq_start", "cast((9 + cds_length) % exon_len + 1 as bigint) AS seq_end", f"{exon_of('11')} AS start_exon_id", f"{exon_of('10 + cds_length')} AS end_exon_id").drop("z")
    letters = f"array_join(transform(sequence(cast(start as bigint) + 1, cast(end as bigint)), p -> {X.base('p', 'seq_region')}), '')"
    chunks = t.select("seq_region").distinct().selectExpr("seq_region", "explode(sequence(0, 19900, 100)) AS start").selectExpr("seq_region", "start", "start + 100 AS end").selectExpr("*", f"{letters} AS seq")
    got = M.transcripts(core, x.select("transcript_id", "exon_id", "rank"), x.select("exon_id", "seq_region_start", "seq_region_end"), tl, _map(spark, sf_dir), chunks)
    return got.select("transcript_id", "seq_region", "transcript_start", "transcript_end", "cds_start", "cds_end", "cds_sequence", F.array_join(F.transform("exons", lambda e: F.concat_ws("-", e["exon_start"].cast("string"), e["exon_end"].cast("string"), e["exon_cdna_start"].cast("string"), e["exon_cdna_end"].cast("string"))), ",").alias("exons"))


def regulation_features(spark, sf_dir):
    f = X.features(spark, sf_dir)
    r = f.filter("feature_kind = 1").selectExpr("regulation_feature_index AS regulatory_feature_id", "cast(regulation_feature_index % 3 as int) AS feature_type_id", "seq_region AS seq_region_id", "feature_start AS seq_region_start", "feature_end AS seq_region_end")
    m = f.filter("feature_kind = 2").selectExpr("regulation_feature_index AS motif_feature_id", "seq_region AS seq_region_id", "feature_start AS seq_region_start", "feature_end AS seq_region_end")
    kinds = spark.createDataFrame([(0, "EMAR"), (1, "Promoter"), (2, "Enhancer")], "feature_type_id int, name string")
    regions = f.select(F.col("seq_region").alias("source_id"), "seq_region").distinct()
    got = M.regulation_features(r, kinds, m, regions)
    return got.select(F.col("regulation_feature_index").cast("long").alias("regulation_feature_index"), "seq_region", "feature_start", "feature_end", "feature_kind", "source_feature_id")


def rna_edits(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/part.parquet").selectExpr("p_partkey AS transcript_id", "case p_partkey % 5 when 0 then concat(p_size, ' ', p_size - 1, ' AC') when 1 then concat(p_size, ' ', p_size + 2, ' ') when 2 then concat(p_size, ' ', p_size, ' U') when 3 then concat(p_size, ' ', p_size + 3, ' G') else 'bad' end AS value")
    return M.rna_edits(p)


def model_receipt(spark, sf_dir):
    return M.receipt(X.transcripts(spark, sf_dir)).select("rows", "coding", F.length("model_sha256").cast("long").alias("digits"))


def model_budget(spark, sf_dir):
    model = M.MODELS.load("budget", X.transcripts(spark, sf_dir), X.features(spark, sf_dir), row_limit=10**9)
    return model.budget(spark)


QUERIES = {f.__name__: f for f in (regions, transcripts_build, regulation_features, rna_edits, model_receipt, model_budget)}
ORACLES = {
    "regions": "SELECT row_number() OVER (ORDER BY r_regionkey % 2, 100 - r_regionkey) - 1 AS seq_region, 'chr' || r_regionkey AS seq_region_name, r_regionkey = 3 AS circular, CAST(100 - r_regionkey AS INTEGER) AS source_id FROM region WHERE r_regionkey < 4",
    "transcripts_build": f"""WITH {X.CTE}, e AS (SELECT transcript_index AS i, string_agg(es || '-' || ee || '-' || exon_cdna || '-' || (exon_cdna + exon_len - 1), ',' ORDER BY es) AS exons FROM ex GROUP BY 1)
 SELECT transcript_index AS transcript_id, seq_region, transcript_start, transcript_end, cds_start, cds_end, CASE WHEN coding THEN {X.seq('11', '10 + cds_length')} END AS cds_sequence, exons FROM tx JOIN e ON e.i = transcript_index""",
    "regulation_features": f"""WITH f AS (SELECT {X.FEATURE} FROM part) SELECT row_number() OVER (ORDER BY seq_region, feature_start, feature_end, feature_kind, regulation_feature_index) - 1 AS regulation_feature_index, seq_region, feature_start, feature_end, feature_kind, regulation_feature_index AS source_feature_id FROM f WHERE feature_kind = 2 OR regulation_feature_index % 3 > 0""",
    "rna_edits": """SELECT p_partkey AS transcript_id, CAST(p_size AS BIGINT) AS edit_start, CAST(p_size + CASE p_partkey % 5 WHEN 0 THEN -1 WHEN 1 THEN 2 WHEN 2 THEN 0 ELSE 3 END AS BIGINT) AS edit_end, CASE p_partkey % 5 WHEN 0 THEN 'AC' WHEN 1 THEN '' WHEN 2 THEN 'U' ELSE 'G' END AS edit_sequence,
 CASE p_partkey % 5 WHEN 0 THEN 'insertion' WHEN 1 THEN 'deletion' WHEN 2 THEN 'substitution' ELSE 'replacement' END AS operation FROM part WHERE p_partkey % 5 < 4""",
    "model_receipt": f"WITH {X.CTE} SELECT count(*) AS rows, CAST(sum(CASE WHEN coding THEN 1 ELSE 0 END) AS BIGINT) AS coding, CAST(64 AS BIGINT) AS digits FROM tx",
    "model_budget": "SELECT 'transcripts' AS owner, count(*) AS current, CAST(1000000000 AS BIGINT) AS row_limit FROM part UNION ALL SELECT 'features', count(*), NULL FROM part",
}
