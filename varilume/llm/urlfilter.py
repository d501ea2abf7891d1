"""URL filter: a Bloom filter cascade over the keys of all pages, in column expressions alone."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from varilume.llm.common import ascii_lower, cut, table

BITS_PER_KEY, HASHES = 12, 6
#: Bits of one level at most; a list that needs more raises an error and has to be given in parts.
MOST_BITS = 1 << 27
#: Rules of the query, by verdict.
RULES = {"block": ("com/en/", "example.net/de/8", "org/es/"), "allow": ("example.com/en/7", "net/de/")}


@dataclass(frozen=True)
class Level:
    bits: int
    words: tuple[int, ...]

    def holds(self, key: Column, level: int) -> Column:
        array = F.expr(f"transform(split('{','.join(map(str, self.words))}', ','), x -> cast(x as bigint))")
        tests = []
        for p in positions(key, level, self.bits):
            tests.append(F.getbit(F.element_at(array, (F.shiftright(p, 6) + 1).cast("int")), F.pmod(p, F.lit(64)).cast("int")) == 1)
        out = tests[0]
        for t in tests[1:]:
            out = out & t
        return out


def positions(key: Column, level: int, bits: int) -> list[Column]:
    a, b = F.xxhash64(key, F.lit(2 * level)), F.xxhash64(key, F.lit(2 * level + 1))
    return [F.pmod(F.shiftrightunsigned(a, 8) + F.shiftrightunsigned(b, 8) * i, F.lit(bits)) for i in range(HASHES)]


def _level(keys: DataFrame, level: int, count: int) -> Level:
    bits = max(64, -(-count * BITS_PER_KEY // 64) * 64)
    if bits > MOST_BITS:
        raise ValueError(f"a level of {bits} bits exceeds {MOST_BITS}; give the list in parts")
    at = keys.select(F.explode(F.array(*positions(F.col("key"), level, bits))).alias("p"))
    rows = at.groupBy(F.shiftright("p", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(pmod(p, 64) as int))")).alias("v")).collect()
    words = [0] * (bits // 64)
    for r in rows:
        words[r["w"]] = r["v"]
    return Level(bits, tuple(words))


@dataclass(frozen=True)
class Cascade:
    """Levels that alternate: listed keys, then the keys that passed falsely, and so on until none does."""

    levels: tuple[Level, ...]

    @classmethod
    def build(cls, listed: DataFrame, universe: DataFrame) -> Cascade:
        """listed, universe: (key). Exact for every key of either; what reaches the driver are the levels' bits.

        Null keys are ignored, repeated ones count once; without listed keys nothing is a member.
        """
        both = listed.select("key", F.lit(True).alias("on")).unionByName(universe.select("key", F.lit(False).alias("on")))
        rest = cut(both.filter("key is not null").groupBy("key").agg(F.max("on").alias("on")))
        levels: list[Level] = []
        while True:
            turn = len(levels) % 2 == 0
            count = rest.filter(F.col("on") == turn).count()
            if not count:
                return cls(tuple(levels))
            levels.append(_level(rest.filter(F.col("on") == turn), len(levels), count))
            # the others stay only if this level takes them falsely
            rest = cut(rest.filter((F.col("on") == turn) | levels[-1].holds(F.col("key"), len(levels) - 1)))

    def has(self, key: Column) -> Column:
        """Whether the key is listed: the first level that lacks it decides, else the last one."""
        out = F.lit(len(self.levels) % 2 == 1)
        for i in reversed(range(len(self.levels))):
            out = F.when(~self.levels[i].holds(key, i), F.lit(i % 2 == 1)).otherwise(out)
        return out


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Both empty where the url is null or has no ://."""
    url = F.coalesce(url, F.lit(""))
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    return ascii_lower(F.regexp_extract(rest, "^[^/?#]*", 0)), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def keys(host: Column, path: Column, lengths: list[int]) -> Column:
    """All rules that could fit: the host and the domains above it, with the path's beginnings of the given lengths."""
    labels = F.split(host, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    heads = F.transform(F.filter(F.array(*map(F.lit, lengths)), lambda n: n <= F.length(path)), lambda n: F.substring(path, F.lit(1), n))
    return F.flatten(F.transform(suffixes, lambda h: F.transform(heads, lambda p: F.concat(h, p))))


def _hit(verdict: str):
    return lambda k: F.struct((-F.length(k)).alias("n"), k.alias("rule"), F.lit(verdict).alias("verdict"))


def judge(pages: DataFrame, rules: dict[str, tuple[str, ...]]) -> DataFrame:
    """One row per page: (page_id, host, path, rule, verdict).

    A rule is host and path as one string; it fits its host and all subdomains where the url's path starts with its own. The
    longest wins, of equal length the first in code point order. Without a rule the url is in no listed set: allow. Null urls
    and those without :// have empty host and path; repeated rows each give a row.
    """
    host, path = host_and_path(F.col("url"))
    parsed = pages.select("page_id", host.alias("host"), path.alias("path"))
    every = [r for rs in rules.values() for r in rs]
    lengths = sorted({len(r) - r.find("/") if "/" in r else 0 for r in every})
    candidates = keys(F.col("host"), F.col("path"), lengths)
    universe = cut(parsed.select("host", F.substring("path", 1, max(lengths, default=0)).alias("path")).distinct().select(F.explode(candidates).alias("key")).distinct())
    spark = pages.sparkSession
    found = F.array().cast("array<struct<n:int,rule:string,verdict:string>>")
    for verdict, listed in rules.items():
        cascade = Cascade.build(spark.createDataFrame([(r,) for r in listed], "key string"), universe)
        found = F.concat(found, F.transform(F.filter(candidates, cascade.has), _hit(verdict)))
    best = F.array_min(found)
    return parsed.select("page_id", "host", "path", best.alias("best")).select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit("allow")).alias("verdict"))


def op6_urlfilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"), RULES)


OP6_SQL = r"""
WITH parts AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), urls AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM parts
), rules(h, p, verdict) AS (
  VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'), ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')
), fits AS (
  SELECT page_id, host, path, h || p AS rule, verdict, row_number() OVER (PARTITION BY page_id, host, path ORDER BY length(h || p) DESC NULLS LAST, h || p) AS k
  FROM urls LEFT JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM fits WHERE k = 1
"""
