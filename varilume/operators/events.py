"""Alleles and VCF records into events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from varilume.functions.dna import let

GEOMETRY = (
    "variant_kind string, start1 bigint, end1 bigint, feature_start1 bigint, feature_end1 bigint, edit_start0 bigint, edit_end0 bigint, "
    "prefix_length int, suffix_length int, reference_difference string, alternate_difference string, anchor string, length_difference int, boundary0 bigint"
)
#: Alleles longer than this aren't taken apart.
LONGEST = 65_535


def common_prefix(a: Column, b: Column) -> Column:
    """Length of the longest common prefix: the first place that differs, less one."""
    n = F.least(F.length(a), F.length(b))
    places = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    first = F.array_min(F.filter(places, lambda i: F.substr(a, i, F.lit(1)) != F.substr(b, i, F.lit(1))))
    return F.coalesce(first - 1, n)


def allele_geometry(df: DataFrame, position: str = "position", reference: str = "reference", alternate: str = "alternate", literal: Column | None = None) -> DataFrame:
    """df with the columns of GEOMETRY: what is left of the alleles without their common prefix and suffix.

    Equal lengths keep the uploaded span as the feature; others take the trimmed span, an insertion as the
    reversed interval that ends before it starts. Empty, equal, overlong or non-ACGTN alleles raise an error, where literal holds.
    """
    ref, alt, pos = F.upper(F.col(reference)), F.upper(F.col(alternate)), F.col(position).cast("long")
    bad = ~ref.rlike("^[ACGTN]+$") | ~alt.rlike("^[ACGTN]+$") | (ref == alt) | (F.length(ref) > LONGEST) | (F.length(alt) > LONGEST)
    bad = bad if literal is None else literal & bad
    ref = F.when(bad, F.raise_error(F.lit("allele_geometry: alleles must differ and hold 1 to 65535 of ACGTN"))).otherwise(ref)

    def trimmed(x: Column) -> Column:
        """Alleles without their common prefix, then without the common suffix of the rest."""
        rest = F.struct(x["pos"].alias("pos"), F.length(x["r"]).alias("n"), F.length(x["a"]).alias("m"), x["p"].alias("p"), F.substr(x["r"], x["p"] + 1, F.length(x["r"])).alias("r"), F.substr(x["a"], x["p"] + 1, F.length(x["a"])).alias("a"))
        return let(rest, lambda y: let(F.struct(y["pos"].alias("pos"), y["n"].alias("n"), y["m"].alias("m"), y["p"].alias("p"), y["r"].alias("r"), y["a"].alias("a"), common_prefix(F.reverse(y["r"]), F.reverse(y["a"])).alias("s")), described))

    def described(x: Column) -> Column:
        rd, ad = F.length(x["r"]) - x["s"], F.length(x["a"]) - x["s"]
        start, end = x["pos"], x["pos"] + x["n"] - 1
        same, insertion = x["n"] == x["m"], rd == 0
        kind = F.when(insertion, "insertion").when(ad == 0, "deletion").when((rd == ad) & (rd == 1), "snv").when(rd == ad, "mnv").otherwise("indel")
        fields = {
            "variant_kind": kind, "start1": start, "end1": end,
            "feature_start1": F.when(same, start).otherwise(start + x["p"]), "feature_end1": F.when(same, end).otherwise(end - x["s"]),
            "edit_start0": start - 1 + x["p"], "edit_end0": start - 1 + x["p"] + rd, "prefix_length": x["p"], "suffix_length": x["s"],
            "reference_difference": F.substr(x["r"], F.lit(1), rd), "alternate_difference": F.substr(x["a"], F.lit(1), ad),
            "anchor": F.when(insertion, F.when(x["p"] > 0, "left").otherwise("right")), "length_difference": x["m"] - x["n"], "boundary0": F.when(insertion, start - 1 + x["p"]),
        }
        return F.struct(*(c.alias(k) for k, c in fields.items()))

    alleles = F.struct(pos.alias("pos"), ref.alias("r"), alt.alias("a"))
    geometry = let(alleles, lambda x: let(F.struct(x["pos"].alias("pos"), x["r"].alias("r"), x["a"].alias("a"), common_prefix(x["r"], x["a"]).alias("p")), trimmed))
    # one base for another, by far the most: nothing to trim, so the taking apart is not entered
    fields = {
        "variant_kind": F.lit("snv"), "start1": pos, "end1": pos, "feature_start1": pos, "feature_end1": pos, "edit_start0": pos - 1, "edit_end0": pos, "prefix_length": F.lit(0), "suffix_length": F.lit(0),
        "reference_difference": ref, "alternate_difference": alt, "anchor": F.lit(None).cast("string"), "length_difference": F.lit(0), "boundary0": F.lit(None).cast("bigint"),
    }
    short = F.struct(*(c.alias(k) for k, c in fields.items()))
    geometry = F.when((F.length(reference) == 1) & (F.length(alternate) == 1), short).otherwise(geometry)
    return df.withColumn("_g", geometry).select(*df.columns, "_g.*")


def breakend_geometry(alt: Column) -> Column:
    """Struct of a breakend's ALT, null where it is none: inserted bases, mate_chrom, mate_position, and whether the local and the
    mate side extend to the left of their points."""
    head, tail = r"^([ACGTNacgtn]+)([\[\]])(.+):([0-9]+)([\[\]])$", r"^([\[\]])(.+):([0-9]+)([\[\]])([ACGTNacgtn]+)$"
    single = alt.rlike(r"^\.[ACGTNacgtn]+$") | alt.rlike(r"^[ACGTNacgtn]+\.$")
    h = (F.regexp_extract(alt, head, 2) == F.regexp_extract(alt, head, 5)) & alt.rlike(head)
    t = (F.regexp_extract(alt, tail, 1) == F.regexp_extract(alt, tail, 4)) & alt.rlike(tail)
    none = F.lit(None)
    return F.when(
        h,
        F.struct(F.regexp_extract(alt, head, 1).alias("inserted"), F.regexp_extract(alt, head, 3).alias("mate_chrom"), F.regexp_extract(alt, head, 4).try_cast("bigint").alias("mate_position"), F.lit(False).alias("local_left"), (F.regexp_extract(alt, head, 2) == "]").alias("mate_left")),
    ).when(
        t,
        F.struct(F.regexp_extract(alt, tail, 5).alias("inserted"), F.regexp_extract(alt, tail, 2).alias("mate_chrom"), F.regexp_extract(alt, tail, 3).try_cast("bigint").alias("mate_position"), F.lit(True).alias("local_left"), (F.regexp_extract(alt, tail, 1) == "]").alias("mate_left")),
    ).when(
        single,
        F.struct(F.translate(alt, ".", "").alias("inserted"), none.cast("string").alias("mate_chrom"), none.cast("bigint").alias("mate_position"), F.startswith(alt, F.lit(".")).alias("local_left"), none.cast("boolean").alias("mate_left")),
    )


def _first(df: DataFrame, name: str) -> Column:
    """Text of an INFO value that may be a list or a scalar; blank counts as none, an absent column too."""
    found = next((f for f in df.schema.fields if f.name.lower() == name.lower()), None)
    if found is None:
        return F.lit(None).cast("string")
    c = F.col(found.name)
    c = F.get(c, F.lit(0)) if found.dataType.typeName() == "array" else c
    return F.nullif(F.trim(c.cast("string")), F.lit(""))


def whole(text: Column) -> Column:
    """The whole number that the text is; null for fractions and anything else."""
    return F.when(text.rlike(r"^[+-]?[0-9]+$"), text.try_cast("bigint"))


def sv_span(pos: Column, svlen: Column, end: Column) -> tuple[Column, Column]:
    """A structural record starts behind POS; it ends at POS + |SVLEN|, else at END, else where it starts."""
    return pos + 1, F.coalesce(pos + F.abs(svlen), end, pos + 1)


MOST_POSITION = 4_294_967_294


def vcf_events(records: DataFrame, regions: DataFrame) -> DataFrame:
    """One row per ALT of VCF-shaped records: event columns, event_kind, event_status, event_reason and the source columns.

    Column names match in any case. A row that no family supports keeps its source columns and says why. event_index
    orders the ok rows by region, position and end, then the others.
    """
    by = {c.lower(): c for c in records.columns}
    text = lambda n: F.col(by[n]) if n in by else F.lit(None)
    r = records.select(
        text("chrom").cast("string").alias("source_chrom"), text("pos").cast("bigint").alias("source_pos"), text("id").cast("string").alias("source_id"), text("ref").cast("string").alias("source_ref"),
        text("alt").cast("array<string>").alias("alts"), _first(records, "info_end").alias("end_text"), _first(records, "info_svlen").alias("svlen_text"), F.upper(_first(records, "info_svtype")).alias("svtype"),
    )
    alleles = F.concat(F.coalesce("source_ref", F.lit("")), F.coalesce(F.array_join("alts", ""), F.lit("")))
    symbolic = F.coalesce(F.array_join("alts", ","), F.lit("")).rlike(r"[<\[\]][^*]+[>\]\[]|^\.\w+|\w+\.$")
    r = r.withColumns(
        {
            "alt_count": F.coalesce(F.when(F.col("alts").isNotNull(), F.size("alts")), F.lit(0)),
            "structural": ~alleles.rlike("^[ACGT]+$") & (F.col("svtype").isNotNull() | symbolic),
            "info_end": whole(F.col("end_text")), "info_svlen": whole(F.col("svlen_text")),
        }
    )
    r = r.select("*", F.posexplode(F.when(F.col("alt_count") == 0, F.array(F.lit(None).cast("string"))).otherwise(F.col("alts"))).alias("at", "source_alt")).withColumn("alt_index", F.col("at") + 1)
    alt = F.col("source_alt")
    families = ("DEL", "DUP", "INV", "INS", "CNV")
    named = F.when(alt == "<DEL>", "DEL").when(alt == "<DUP>", "DUP").when(alt == "<DUP:TANDEM>", "TDUP").when(alt == "<INV>", "INV").when(alt == "<INS>", "INS").when(alt == "<CNV>", "CNV").otherwise("unsupported_symbolic_allele")
    other = F.when(F.col("svtype").isNull(), "unsupported_symbolic_allele").when(F.col("svtype").isin(*families), F.col("svtype")).otherwise("unsupported_structural_type")
    kind = F.when(alt.rlike(r"^<INS:[A-Za-z0-9_.-]+(:[A-Za-z0-9_.-]+)*>$"), "INS").when(alt.rlike(r"^<?(DEL|INS|DUP|INV|CNV|CN=?[0-9]+)"), named).when(alt.rlike("^<[^>]+>$"), other)
    r = r.withColumns({"bnd": F.when(F.col("structural") & (F.col("alt_count") == 1), breakend_geometry(alt)), "sv_type": kind})
    names = regions.groupBy(F.col("seq_region_name").cast("string").alias("name")).agg(F.min(F.col("seq_region").cast("int")).alias("region"), F.count("*").alias("rows"))
    # regions are the contigs of one genome: small on any corpus
    local = F.broadcast(names.select(F.col("name").alias("source_chrom"), F.col("region").alias("local_region"), F.col("rows").alias("local_rows")))
    mate = F.broadcast(names.select(F.col("name").alias("mate_name"), F.col("region").alias("mate_region"), F.col("rows").alias("mate_rows")))
    r = r.join(local, "source_chrom", "left").join(mate, F.col("bnd.mate_chrom") == F.col("mate_name"), "left")
    start, end = sv_span(F.col("source_pos"), F.col("info_svlen"), F.col("info_end"))
    r = r.withColumns({"vep_start": start, "vep_end": end})
    sv, bnd = F.col("sv_type"), F.col("bnd")
    reason = (
        F.when(F.col("local_region").isNull(), "contig_not_in_model")
        .when(F.col("local_rows") > 1, "ambiguous_contig")
        .when(F.col("source_pos").isNull() | (F.col("source_pos") < 1) | (F.col("source_pos") > MOST_POSITION), "invalid_position")
        .when(alt.isNull(), "no_alternate_allele")
        .when(F.coalesce("source_ref", F.lit("")) == "", "missing_reference")
        .when(~F.col("structural"), None)
        .when(F.col("alt_count") != 1, "multiallelic_structural_record")
        .when(bnd.isNotNull() & bnd["mate_chrom"].isNull(), "single_breakend")
        .when(bnd.isNotNull() & (F.col("mate_region").isNull() | (F.col("mate_rows") > 1)), "mate_contig_not_in_model")
        .when(bnd.isNotNull() & ~bnd["mate_position"].between(1, MOST_POSITION), "invalid_position")
        .when(bnd.isNotNull(), None)
        .when(alt.rlike(r"[\[\]]") | alt.rlike(r"^\.\w+|\w+\.$"), "malformed_breakend")
        .when(sv.isNull(), "literal_alleles_with_svtype")
        .when(sv.startswith("unsupported"), sv)
        .when(F.col("end_text").isNotNull() & F.col("info_end").isNull(), "invalid_end")
        .when(F.col("svlen_text").isNotNull() & F.col("info_svlen").isNull(), "invalid_svlen")
        .when((sv == "DEL") & ((start > end) | (F.col("info_end").isNull() & F.col("info_svlen").isNull())), "incomplete_deletion")
        .when((sv == "INS") & (end < F.col("source_pos")), "invalid_span")
        .when((sv != "INS") & (end < start), "empty_span")
        .when(end > MOST_POSITION, "invalid_position")
    )
    r = r.withColumn("event_reason", reason).withColumn("ok", F.col("event_reason").isNull())
    between = (sv == "INS") & (F.col("vep_end") < F.col("vep_start"))
    position = F.when(~F.col("structural") | bnd.isNotNull() | between, F.col("source_pos")).otherwise(F.col("vep_start"))
    stop = F.when(F.col("structural") & bnd.isNull(), F.when(between, F.col("source_pos")).otherwise(F.col("vep_end")))
    event = F.when(~F.col("structural"), "small_variant").when(bnd.isNotNull(), "breakend").when(sv.isNotNull() & ~sv.startswith("unsupported"), "structural_variant")
    ok = lambda c: F.when(F.col("ok"), c)
    is_sv = event == "structural_variant"
    copies = F.when(sv == "DEL", "LOSS").when(sv.isin("DUP", "TDUP"), "GAIN").when(sv == "INV", "NEUTRAL").otherwise("UNKNOWN")
    out = r.select(
        ok(F.col("local_region")).alias("seq_region"), ok(position).alias("position"), ok(F.col("source_ref")).alias("reference"), ok(alt).alias("alternate"), ok(stop).alias("end_position"),
        ok(F.when(is_sv, sv)).alias("structural_type"), ok(F.when(is_sv & (sv == "INS") & (F.col("vep_end") == F.col("vep_start")), "POINT")).alias("structural_geometry"), ok(F.when(is_sv, copies)).alias("copy_change"),
        ok(F.when(event == "breakend", F.col("mate_region"))).alias("mate_seq_region"), ok(F.when(event == "breakend", bnd["mate_position"])).alias("mate_position"),
        event.alias("event_kind"), F.when(F.col("ok"), "ok").otherwise("unsupported").alias("event_status"), "event_reason",
        "source_chrom", "source_pos", "source_id", "source_ref", "source_alt", "alt_index",
    )
    last, first = (lambda c: F.col(c).asc_nulls_last()), (lambda c: F.col(c).asc_nulls_first())
    return dense_index(out, "event_index", last("seq_region"), last("position"), first("end_position"), last("source_chrom"), last("source_pos"), last("source_id"), last("alt_index"))


def dense_index(df: DataFrame, name: str, *order: Column, start: int = 1) -> DataFrame:
    """df with consecutive numbers by a total order, without bringing all rows to one task.

    A sort deals rows by range; each row's number is its place in its partition plus the rows of the partitions before.
    """
    from varilume.session import reliable

    place = F.monotonically_increasing_id()
    rows = reliable(df.orderBy(*order).select("*", F.shiftright(place, 33).alias("_part"), place.bitwiseAND(F.lit((1 << 33) - 1)).alias("_at")))
    sizes = rows.groupBy("_part").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each partition
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    out = rows.join(F.broadcast(offsets), "_part")
    return out.select((F.col("_before") + F.col("_at") + start).cast("long").alias(name), *df.columns)
