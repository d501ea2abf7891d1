"""Document fingerprints: threshold-scaled sketches, in column expressions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from varilume.llm.common import ascii_lower, table

#: Words of a shingle, and the share of all hashes that a sketch keeps: one in so many.
WORDS, SCALE = 5, 8
#: Documents of a range of ids, and ranges cut by quantiles; what a quantile holds is cut evenly.
RANGE_DOCS, QUANTILES = 2000, 128
#: Ranges up to this number have their first documents broadcast: under 2 MB of ids.
BROADCAST_RANGES = 100_000


def shingle_hashes(text: Column, words: int = WORDS) -> Column:
    """Hash of each run of words; of the whole sequence where it is shorter; none without words."""
    tokens = F.transform(F.filter(F.split(ascii_lower(text), r"[\x20\x09-\x0D]+"), lambda w: w != ""), lambda w: F.xxhash64(w))
    # F.transform over a named array keeps the tokens from being hashed for each shingle
    run = lambda a: F.when(F.size(a) == 0, F.array().cast("array<bigint>")).when(F.size(a) < words, F.array(F.xxhash64(F.concat_ws(" ", a.cast("array<string>"))))).otherwise(F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.size(a) - words)), lambda i: F.xxhash64(*(F.get(a, i + k) for k in range(words)))))
    return F.get(F.transform(F.array(tokens), run), F.lit(0))


def sketch(text: Column, words: int = WORDS, scale: int = SCALE) -> Column:
    """Ascending distinct hashes below 1 / scale of their range, and the least of all, so that only texts without words have none.

    The union of two sketches, without hashes above the threshold but for the least, is the sketch of both texts.
    """
    most = -(1 << 63) + (1 << 64) // scale
    keep = lambda h: F.array_sort(F.array_distinct(F.concat(F.filter(h, lambda x: x < most), F.filter(F.array(F.array_min(h)), lambda x: x.isNotNull()))))
    return F.get(F.transform(F.array(shingle_hashes(text, words)), keep), F.lit(0))


def containment(a: Column, b: Column) -> Column:
    """Share of a's sketch that b's holds; two empty sketches are alike, an empty and another one aren't."""
    return F.when(F.size(a) == 0, (F.size(b) == 0).cast("double")).otherwise(F.size(F.array_intersect(a, b)) / F.size(a))


def as_text(s: Column) -> Column:
    return F.array_join(F.transform(s, lambda h: F.lpad(F.lower(F.hex(h)), 16, "0")), "")


def with_next(docs: DataFrame, carried: list[str], order: str = "doc_id") -> DataFrame:
    """docs with next_<c> of each carried column: the values of the next row by descending order, after the last the first.

    Rows are dealt by ranges of the key, with one shuffle; each range also gets the first row of the range that follows, so no
    task sees more than its range. Null keys count as the smallest; equal keys go by descending text.
    """
    key = F.coalesce(F.col(order).cast("long"), F.lit(-(1 << 63)))
    docs = docs.withColumn("key", key)
    n, quantiles = docs.agg(F.count("*"), F.percentile_approx("key", [i / QUANTILES for i in range(QUANTILES + 1)], 20_000)).first()
    if not n:
        return docs.drop("key").withColumns({f"next_{c}": F.col(c) for c in carried})
    bounds = sorted(set(quantiles))
    parts = max(1, -(-n // (RANGE_DOCS * len(bounds))))
    at = F.expr(f"greatest(1, size(filter(array({', '.join(f'{b}L' if b > -(1 << 63) else 'cast(-9223372036854775808 as bigint)' for b in bounds)}), b -> b <= key)))")
    low, high = (F.element_at(F.array(*(F.lit(float(b)) for b in [*bounds, bounds[-1] + 1])), (at + k).cast("int")) for k in (0, 1))
    inner = F.greatest(F.lit(0), F.least(F.lit(parts - 1), F.floor((F.col("key").cast("double") - low) * parts / F.greatest(high - low, F.lit(1.0)))))
    docs = docs.withColumn("range", (at * parts + inner).cast("long"))
    tops = docs.groupBy("range").agg(F.max("key").alias("top"))
    down = Window.orderBy(F.col("range").desc())
    heads = tops.select(F.coalesce(F.lag("range").over(down), F.lit(-1)).alias("to"), "top")
    first = tops.agg(F.max("top").alias("top"), F.min("range").alias("to"))
    heads = heads.filter("to >= 0").select("to", "top", F.lit(0).alias("guest")).unionByName(first.select("to", "top", F.lit(1).alias("guest")))
    if len(bounds) * parts <= BROADCAST_RANGES:
        heads = F.broadcast(heads)
    columns = docs.columns
    guests = docs.join(heads, docs["key"] == heads["top"]).select(*(F.col("to").alias("range") if c == "range" else docs[c] for c in columns), (F.col("guest") + 1).alias("guest"))
    every = docs.select(*columns, F.lit(0).alias("guest")).unionByName(guests)
    # a guest of guest = 2 is the very first row, and stands last
    w = Window.partitionBy("range").orderBy((F.col("guest") == 2).cast("int"), F.col("key").desc(), F.col("text").desc(), "guest")
    out = every.withColumns({f"next_{c}": F.lead(c).over(w) for c in carried}).filter("guest = 0")
    return out.drop("guest", "range", "key")


def fingerprints(docs: DataFrame) -> DataFrame:
    """One row per document: (doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next).

    A fingerprint is its sketch's hashes in hex, without a separator; near_* are shares of the document's own sketch.
    Null texts count as empty, with an empty fingerprint; a single document follows itself; repeated rows each give a row.
    """
    base = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("own", sketch(F.col("text")))
    got = with_next(base, ["text", "own"])
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    got = got.withColumn("edited", F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half)))
    got = got.select("doc_id", n.cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), "own", "next_own", sketch(F.col("edited")).alias("theirs"))
    return got.select("doc_id", "n_chars", "edited_sha256", as_text(F.col("own")).alias("fingerprint"), as_text(F.col("theirs")).alias("edited_fingerprint"), containment(F.col("own"), F.col("theirs")).alias("near_edited"), containment(F.col("own"), F.col("next_own")).alias("near_next"))


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))
