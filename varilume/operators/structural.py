"""Structural records: spans with confidence, breakend pairs, gene evidence, repeats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from varilume.functions.dna import let, revcomp
from varilume.operators.events import breakend_geometry, sv_span, whole

MOST = 2_147_483_647


def _column(df: DataFrame, name: str, kind: str = "string") -> Column:
    found = next((c for c in df.columns if c.lower() == name.lower()), None)
    return (F.col(found) if found else F.lit(None)).cast(kind)


def _allele(df: DataFrame) -> Column:
    """The ALT that alt_index chooses of a list, or the one there is."""
    kind = next(f for f in df.schema.fields if f.name.lower() == "alt")
    return F.try_element_at(F.col(kind.name), F.coalesce(_column(df, "alt_index", "int"), F.lit(1))) if kind.dataType.typeName() == "array" else F.col(kind.name)


def _values(df: DataFrame, name: str) -> Column:
    """Values of an INFO field that is a list, a scalar or text with commas; null where it is absent."""
    found = next((f for f in df.schema.fields if f.name.lower() == name.lower()), None)
    if found is None:
        return F.lit(None).cast("array<string>")
    c = F.col(found.name)
    return c.cast("array<string>") if found.dataType.typeName() == "array" else F.when(F.trim(c.cast("string")) != "", F.split(c.cast("string"), ","))


def sv_geometry(records: DataFrame) -> DataFrame:
    """(event_index, status, mode, nominal, outer and inner bounds, inserted_sequence) of symbolic alleles and literal insertions.

    CIPOS and CIEND widen the nominal bounds; what leaves the positive 32-bit range or contradicts itself is unsupported.
    """
    first = lambda n: F.nullif(F.trim(F.get(_values(records, n), F.lit(0))), F.lit(""))
    df = records.select(
        "event_index", _column(records, "pos", "bigint").alias("pos"), _column(records, "ref").alias("ref"), _allele(records).alias("alt"), first("info_end").alias("end_text"), first("info_svlen").alias("len_text"),
        _values(records, "info_cipos").alias("cipos"), _values(records, "info_ciend").alias("ciend"),
    )
    df = df.withColumns({"info_end": whole(F.col("end_text")), "info_svlen": whole(F.col("len_text")), "symbolic": F.coalesce(F.col("alt").rlike("^<[^>]+>$"), F.lit(False))})
    literal = F.col("ref").rlike("^[ACGT]+$") & F.col("alt").rlike("^[ACGT]+$") & (F.length("alt") > F.length("ref")) & F.startswith(F.col("alt"), F.col("ref"))
    start, end = sv_span(F.col("pos"), F.col("info_svlen"), F.col("info_end"))
    edge = F.col("pos") + F.length("ref")
    df = df.withColumns({"literal": F.coalesce(literal, F.lit(False)), "nominal_start": F.when(F.col("symbolic"), start).otherwise(edge), "nominal_end": F.when(F.col("symbolic"), end).otherwise(edge - 1)})
    bound = lambda c, i: F.when(F.size(c) == 2, whole(F.trim(F.get(F.col(c), F.lit(i)))))
    df = df.withColumns({"outer_start": F.col("nominal_start") + bound("cipos", 0), "inner_start": F.col("nominal_start") + bound("cipos", 1), "inner_end": F.col("nominal_end") + bound("ciend", 0), "outer_end": F.col("nominal_end") + bound("ciend", 1)})
    legal = lambda a, b: F.col(a).between(0, MOST) & F.col(b).between(0, MOST) & (F.col(a) <= F.col(b))
    ok = (
        (F.col("symbolic") | F.col("literal"))
        & F.col("pos").between(1, MOST)
        & F.col("nominal_start").between(0, MOST)
        & F.col("nominal_end").between(F.col("nominal_start") - 1, F.lit(MOST))
        & (F.col("end_text").isNull() | (F.col("info_end") > 0))
        & (F.col("len_text").isNull() | F.col("info_svlen").isNotNull())
        & (~F.col("symbolic") | (F.col("ref").rlike("^[ACGTN]$") & (F.col("info_end").isNotNull() | F.col("info_svlen").isNotNull())))
        & (F.col("cipos").isNull() | legal("outer_start", "inner_start"))
        & (F.col("ciend").isNull() | legal("inner_end", "outer_end"))
    )
    return df.select(
        "event_index", F.when(F.coalesce(ok, F.lit(False)), "ok").otherwise("unsupported_geometry").alias("status"), F.when(F.col("symbolic"), "structural").when(F.col("literal"), "literal_insertion").otherwise("unsupported").alias("mode"),
        "nominal_start", "nominal_end", "outer_start", "inner_start", "inner_end", "outer_end", F.when(F.col("literal"), F.substr("alt", F.length("ref") + 1, F.length("alt"))).alias("inserted_sequence"),
    )


STATUS = {
    "reciprocal": ("reciprocal",),
    "not_applicable": ("not_breakend", "single_breakend"),
    "invalid": ("malformed_alt",),
    "unproven": ("missing_id", "missing_mateid", "mate_not_found", "mate_missing_mateid"),
}


def breakend_pairs(records: DataFrame) -> DataFrame:
    """One row per record: what kind it is, whether its mate answers it, why not, and the key that both share.

    A mate is found by id with one equi-join; reciprocity needs ids, coordinates, orientation, inserted length and event alike.
    """
    tokens = lambda n: F.filter(F.coalesce(_values(records, n), F.array().cast("array<string>")), lambda x: F.trim(x) != "")
    alt = _allele(records)
    r = records.select("event_index", _column(records, "chrom").alias("chrom"), _column(records, "pos", "bigint").alias("pos"), _column(records, "id").alias("_id"), alt.alias("alt"), tokens("info_mateid").alias("mates"), tokens("info_event").alias("events_"), breakend_geometry(alt).alias("g"))
    alt = F.col("alt")
    odd = alt.rlike(r"[\[\]]") | ((F.length(alt) > 1) & (alt.startswith(".") | alt.endswith(".")))
    kind = F.when(F.col("g").isNotNull(), F.when(F.col("g.mate_chrom").isNull(), "single_breakend").otherwise("paired_breakend")).when(alt.isNotNull() & odd, "malformed_alt").otherwise("not_breakend")
    bases = F.col("g.inserted")
    r = r.select(
        "event_index", "chrom", "pos", F.when(~F.col("_id").isin("", "."), F.col("_id")).alias("id"), kind.alias("record_kind"), F.size("mates").alias("n_mates"), F.size("events_").alias("n_events"),
        F.when(F.size("mates") > 0, F.array_join(F.transform("mates", lambda x: F.trim(x)), ",")).alias("mate_id"), F.when(F.size("events_") == 1, F.trim(F.get("events_", F.lit(0)))).alias("event_id"),
        F.col("g.mate_chrom").alias("declared_mate_chrom"), F.col("g.mate_position").alias("declared_mate_position"), (~F.col("g.local_left")).alias("join_after"), (~F.col("g.mate_left")).alias("mate_right"),
        F.when(F.col("g").isNotNull(), F.greatest(F.length(bases) - 1, F.lit(0))).alias("inserted_length"),
    )
    ids = r.filter("id is not null").groupBy("id").agg(F.count("*").alias("n"), F.min("event_index").alias("first_index"))
    own, theirs = ids.select("id", F.col("n").alias("id_count")), ids.select(F.col("id").alias("mate_id"), F.col("n").alias("mate_count"), F.when(F.col("n") == 1, F.col("first_index")).alias("m_index"))
    mate = r.select(*(F.col(c).alias(f"m_{c}") for c in r.columns))
    j = r.join(own, "id", "left").join(theirs, "mate_id", "left").withColumnRenamed("m_index", "mi").join(mate, F.col("mi") == F.col("m_event_index"), "left")
    paired = F.col("m_record_kind") == "paired_breakend"
    yes = lambda c: F.coalesce(c, F.lit(False))
    j = j.withColumns(
        {
            "id_reciprocal": yes(paired & (F.col("m_mate_id") == F.col("id")) & (F.col("m_event_index") != F.col("event_index"))),
            "coordinate_reciprocal": yes(paired & (F.col("declared_mate_chrom") == F.col("m_chrom")) & (F.col("declared_mate_position") == F.col("m_pos")) & (F.col("m_declared_mate_chrom") == F.col("chrom")) & (F.col("m_declared_mate_position") == F.col("pos"))),
            "orientation_reciprocal": yes(paired & (F.col("join_after") != F.col("m_mate_right")) & (F.col("mate_right") != F.col("m_join_after"))),
            "insert_agree": yes(paired & (F.col("inserted_length") == F.col("m_inserted_length"))),
            "event_agree": F.col("event_id").eqNullSafe(F.col("m_event_id")),
            "event_record_count": F.when(F.col("event_id").isNotNull(), F.count("*").over(Window.partitionBy("event_id"))),
        }
    )
    several = lambda n, ids: (F.col(n) > 1) | F.contains(F.coalesce(ids, F.lit("")), F.lit(","))
    reason = (
        F.when(F.col("record_kind").isin("not_breakend", "malformed_alt"), F.col("record_kind"))
        .when(F.col("record_kind") == "single_breakend", F.when(F.col("n_mates") > 0, "single_breakend_with_mateid").otherwise("single_breakend"))
        .when(F.col("id").isNull(), "missing_id")
        .when(F.col("id_count") > 1, "duplicate_id")
        .when(several("n_mates", F.col("mate_id")), "duplicate_mateid")
        .when(F.col("mate_id").isNull(), "missing_mateid")
        .when(F.col("mate_id") == F.col("id"), "self_mate")
        .when((F.col("n_events") > 1) | (F.coalesce("m_n_events", F.lit(0)) > 1), "duplicate_event")
        .when(F.col("mate_count").isNull(), "mate_not_found")
        .when(F.col("mate_count") > 1, "ambiguous_mate_id")
        .when(~paired, "mate_not_paired_breakend")
        .when(several("m_n_mates", F.col("m_mate_id")), "mate_duplicate_mateid")
        .when(F.col("m_mate_id").isNull(), "mate_missing_mateid")
        .when(~F.col("id_reciprocal"), "mate_not_reciprocal")
        .when(~F.col("coordinate_reciprocal"), "mate_coordinate_conflict")
        .when(~F.col("orientation_reciprocal"), "mate_orientation_conflict")
        .when(~F.col("insert_agree"), "mate_insert_conflict")
        .when(~F.col("event_agree"), "event_conflict")
        .otherwise("reciprocal")
    )
    j = j.withColumn("reason", reason)
    status = F.lit("conflict")
    for name, reasons in STATUS.items():
        status = F.when(F.col("reason").isin(*reasons), name).otherwise(status)
    lo, hi = F.least("event_index", "m_event_index").cast("string"), F.greatest("event_index", "m_event_index").cast("string")
    return j.select("event_index", "id", "chrom", "pos", "record_kind", status.alias("status"), "reason", "mate_id", "event_id", F.when((F.col("record_kind") == "paired_breakend") & (F.col("mate_count") == 1) & (F.col("mate_id") != F.col("id")), F.col("m_event_index")).alias("mate_event_index"), "declared_mate_chrom", "declared_mate_position", "id_reciprocal", "coordinate_reciprocal", "orientation_reciprocal", "insert_agree", "event_agree", "event_record_count", "inserted_length", F.when(F.col("reason") == "reciprocal", F.concat(lo, F.lit("|"), hi)).alias("pair_key"))


def breakend_fusion(pairs: DataFrame, genes: DataFrame) -> DataFrame:
    """Genes at both ends of each pair and what they allow to say; a fusion is never asserted."""
    sets = genes.filter("gene_id is not null").groupBy("event_index").agg(F.sort_array(F.collect_set("gene_id")).alias("g"))
    none = F.array().cast("array<string>")
    j = pairs.join(sets.select("event_index", F.col("g").alias("ga")), "event_index", "left").join(sets.select(F.col("event_index").alias("mate_event_index"), F.col("g").alias("gb")), "mate_event_index", "left")
    j = j.withColumns({"endpoint_genes": F.coalesce("ga", none), "mate_endpoint_genes": F.coalesce("gb", none)})
    known = F.coalesce(F.col("id_reciprocal") & F.col("coordinate_reciprocal") & F.col("event_agree"), F.lit(False))
    status = F.when(~known, "identity_unproven").when((F.size("endpoint_genes") == 0) | (F.size("mate_endpoint_genes") == 0), "endpoint_without_gene").when(F.arrays_overlap("endpoint_genes", "mate_endpoint_genes"), "shared_gene_endpoints").when(F.col("orientation_reciprocal"), "candidate_partner_genes").otherwise("candidate_orientation_conflict")
    return j.select("event_index", "mate_event_index", "pair_key", status.alias("status"), F.when(~known, F.col("reason")).alias("reason"), "endpoint_genes", "mate_endpoint_genes", F.lit(False).alias("fusion_asserted"))


def repeat_alleles(reference: Column, alternate: Column, exact: Column, most: int = 5000) -> Column:
    """Struct of the sequences that lists of (unit, count) spell, their lengths and the direction of change, or why there are none."""
    missing = lambda a: a.isNull() | F.exists(a, lambda x: x.isNull() | x["unit"].isNull() | x["count"].isNull())
    fraction = lambda a: F.exists(a, lambda x: x["count"] != F.floor(x["count"]))
    bad = lambda a: F.coalesce(F.exists(a, lambda x: ~x["unit"].rlike("^[ACGTURYKMSWBDHVNacgturykmswbdhvn]+$")), F.lit(False))
    negative = lambda a: F.coalesce(F.exists(a, lambda x: x["count"] < 0), F.lit(False))
    need = lambda a: F.aggregate(a, F.lit(0.0), lambda t, x: t + F.length(x["unit"]) * x["count"])
    spell = lambda a: F.aggregate(a, F.lit(""), lambda t, x: F.concat(t, F.repeat(x["unit"], x["count"].cast("int"))))
    status = F.when(~exact, "summary_only").when(missing(reference) | missing(alternate), "incomplete_input").when(fraction(reference) | fraction(alternate), "nonintegral_count").otherwise("ok")
    status = F.when(bad(reference) | bad(alternate), F.raise_error(F.lit("repeat_alleles: repeat units must contain non-empty IUPAC DNA"))).when(negative(reference) | negative(alternate), F.raise_error(F.lit("repeat_alleles: repeat counts must be finite and nonnegative"))).otherwise(status)

    def told(s: Column) -> Column:
        ok = s == "ok"
        over = ok & ((need(reference) > most) | (need(alternate) > most))
        text = lambda a: F.when(over, F.raise_error(F.lit(f"repeat_alleles: an allele exceeds max_allele_bases={most}"))).when(ok, spell(a))
        size = lambda a: F.when(ok, need(a).cast("long"))
        change = need(alternate) - need(reference)
        return F.struct(text(reference).alias("reference"), text(alternate).alias("alternate"), size(reference).alias("reference_length"), size(alternate).alias("alternate_length"), F.when(ok, change.cast("long")).alias("length_change"), F.when(ok, F.when(change > 0, "GAIN").when(change < 0, "LOSS").otherwise("NEUTRAL")).alias("length_direction"), s.alias("status"))

    return let(status, told)


def structural_hgvs(events: DataFrame, most: int = 5000) -> DataFrame:
    """(event_index, status, genomic_hgvs, equivalent_reference, equivalent_alternate) of exact DEL, DUP and INV.

    events: event_index, CHROM, POS, kind, end_position, reference_sequence (the bases POS + 1 to the end). An inversion is
    reduced to the bases that differ from their own reverse complement; one that is its own reverse complement has no change.
    """
    df = events.withColumns({"n": F.col("end_position") - F.col("POS"), "seq": F.upper("reference_sequence")})
    status = (
        F.when(~F.col("kind").isin("DEL", "DUP", "INV"), "unsupported_type").when(F.col("n") < 1, "empty_span").when(F.col("n") > most, "span_too_long").when(F.col("seq").isNull(), "missing_reference")
        .when(F.length("seq") != F.col("n"), "reference_length_mismatch").when(~F.col("seq").rlike("^[ACGT]+$"), "ambiguous_reference").otherwise("ok")
    )
    df = df.withColumn("status", status).withColumn("flip", revcomp(F.col("seq")))
    places = F.when(F.col("status") == "ok", F.sequence(F.lit(1), F.col("n").cast("int")))
    differs = F.filter(places, lambda i: F.substr("seq", i, F.lit(1)) != F.substr("flip", i, F.lit(1)))
    df = df.withColumns({"lo": F.array_min(differs), "hi": F.array_max(differs)})
    df = df.withColumn("status", F.when((F.col("status") == "ok") & (F.col("kind") == "INV") & F.col("lo").isNull(), "no_change").otherwise(F.col("status")))
    ok = F.col("status") == "ok"
    a = F.when(F.col("kind") == "INV", F.col("POS") + F.col("lo")).otherwise(F.col("POS") + 1)
    b = F.when(F.col("kind") == "INV", F.col("POS") + F.col("hi")).otherwise(F.col("end_position"))
    span = F.when(a == b, a.cast("string")).otherwise(F.concat(a.cast("string"), F.lit("_"), b.cast("string")))
    core = lambda c: F.when(F.col("kind") == "INV", F.substr(c, F.col("lo"), F.col("hi") - F.col("lo") + 1)).otherwise(F.col(c))
    return df.select(
        "event_index", "status", F.when(ok, F.concat("CHROM", F.lit(":g."), span, F.lower("kind"))).alias("genomic_hgvs"),
        F.when(ok, core("seq")).alias("equivalent_reference"), F.when(ok, F.when(F.col("kind") == "DEL", "").when(F.col("kind") == "DUP", F.concat("seq", "seq")).otherwise(core("flip"))).alias("equivalent_alternate"),
    )


def expansionhunter(records: DataFrame) -> DataFrame:
    """(event_index, status, reason, alleles, exact) of repeat genotypes: unit, reference and called counts must agree.

    records: event_index, RU, REF_COUNT, GT, SO, REPCN. A called count is exact where its support is SPANNING, else a summary.
    """
    df = records.withColumns({"_gt": F.split("GT", r"[/|]"), "_so": F.split("SO", "/"), "_cn": F.split("REPCN", "/")})
    reason = (
        F.when(F.col("RU").isNull() | ~F.col("RU").rlike("^[ACGTURYKMSWBDHVN]+$"), "invalid_unit").when(F.col("REF_COUNT").isNull() | (F.col("REF_COUNT") < 0), "invalid_reference_count").when(F.col("GT").isNull() | F.col("GT").rlike(r"\."), "missing_genotype")
        .when((F.size("_gt") != F.size("_so")) | (F.size("_gt") != F.size("_cn")), "field_count_mismatch").when(F.exists("_cn", lambda x: ~x.rlike("^[0-9]+$")), "invalid_repeat_count").when(F.exists("_so", lambda x: ~x.isin("SPANNING", "FLANKING", "INREPEAT")), "unknown_support")
    )
    df = df.withColumn("reason", reason)
    exact = F.forall("_so", lambda x: x == "SPANNING")
    ok = F.col("reason").isNull()
    return df.select("event_index", F.when(~ok, "unsupported").when(exact, "exact").otherwise("summary_only").alias("status"), "reason", F.when(ok, F.array_join(F.transform("_cn", lambda x: F.concat(F.col("RU"), F.lit("x"), x)), ",")).alias("alleles"), F.when(ok, exact).alias("exact"))
