"""URL filters by a Bloom filter cascade, DataFrame functions only.

Rules (host, path) fit a url whose host is the rule's or a subdomain of it and whose path starts with the rule's path.
So a url asks for the keys host suffix + path prefix, where prefixes take only the lengths that rules have. All keys
of the corpus are the key universe. Level 1 of a cascade encodes the listed keys; level 2 the universe's keys that level
1 takes wrongly; level 3 the listed keys that level 2 takes, and so on until nothing is left over. A key is listed if
the first level that misses it has an even number. That is exact for each key of the universe, and no join is needed:
the levels' bits are literals in the expression.

Sizes: level 1 has a false-positive rate of about listed / universe, so level 2 encodes about as many keys as are listed,
and the cascade grows with the rules, not with the corpus: some 3 bytes a listed key at a universe of a million times
as many. Keys stay in tables; the driver sees the bits alone, and each level is one binary literal.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut

#: Bits are gathered in rows of so many bytes.
ROW_BYTES = 64

#: The production rules: host, path, verdict.
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty for null or no ://."""
    rest = F.substring_index(F.substring_index(F.substring_index(_after(url), "/", 1), "?", 1), "#", 1)
    return F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host, up to ?, # or the end."""
    bare = F.substring_index(F.substring_index(_after(url), "?", 1), "#", 1)
    slash = F.instr(bare, "/")
    return F.when(slash > 0, F.substr(bare, slash)).otherwise(F.lit(""))


def _after(url: Column) -> Column:
    at = F.instr(F.coalesce(url, F.lit("")), "://")
    return F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))


def candidate_keys(host: Column, path: Column, lengths: list[int]) -> Column:
    """Keys of a url, longest first: by host, then by path."""
    labels = F.split(host, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.lit(1 << 20)), "."))
    fitting = F.filter(F.array(*[F.lit(n) for n in sorted(lengths, reverse=True)]), lambda n: F.length(path) >= n)
    keys = F.flatten(F.transform(suffixes, lambda s: F.transform(fitting, lambda n: F.concat(s, F.substr(path, F.lit(1), n)))))
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.array_sort(F.array_distinct(keys), _longest_first))


def _longest_first(a: Column, b: Column) -> Column:
    slash_a, slash_b = F.instr(a, "/"), F.instr(b, "/")
    cmp = lambda x, y: F.when(x > y, F.lit(-1)).when(x < y, F.lit(1))
    return F.coalesce(cmp(F.length(a), F.length(b)), cmp(slash_a, slash_b), F.lit(0))


@dataclass(frozen=True)
class Level:
    """Bits of one Bloom filter, its number of hashes and their seed."""

    bits: bytes
    hashes: int
    seed: int

    def takes(self, key: Column) -> Column:
        literal = F.lit(bytearray(self.bits))

        def hit(b: Column) -> Column:
            byte = F.conv(F.hex(F.substring(literal, (F.shiftright(b, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
            return F.call_function("bit_get", byte, b.bitwiseAND(F.lit(7)).cast("int")) == 1

        hits = [hit(b) for b in _bits(key, self.hashes, self.seed, 8 * len(self.bits))]
        out = hits[0]
        for h in hits[1:]:
            out = out & h
        return out


def _bits(key: Column, hashes: int, seed: int, bits: int) -> list[Column]:
    return [F.pmod(F.xxhash64(F.lit(seed), F.lit(j), key), F.lit(bits)) for j in range(hashes)]


def _level(keys: DataFrame, n: int, rate: float, seed: int) -> Level:
    """A filter for the n keys. Bits are or-ed in rows of ROW_BYTES, eight longs each, before they come to the driver."""
    rows = max(1, math.ceil(n * math.log2(1 / rate) / math.log(2) / (8 * ROW_BYTES)))
    hashes = max(1, round(math.log2(1 / rate)))
    set_bits = keys.select(F.explode(F.array(*_bits(F.col("key"), hashes, seed, 8 * ROW_BYTES * rows))).alias("b"))
    word, one = F.pmod(F.shiftright("b", 6), F.lit(ROW_BYTES // 8)), F.expr("shiftleft(1L, cast(b & 63 as int))")
    found = set_bits.groupBy(F.floor(F.col("b") / (8 * ROW_BYTES)).alias("at")).agg(*[F.bit_or(F.when(word == w, one).otherwise(F.lit(0).cast("long"))).alias(f"w{w}") for w in range(ROW_BYTES // 8)])
    out = bytearray(ROW_BYTES * rows)
    for r in found.toLocalIterator():
        out[ROW_BYTES * r["at"] : ROW_BYTES * (r["at"] + 1)] = b"".join((r[f"w{w}"] & (2**64 - 1)).to_bytes(8, "little") for w in range(ROW_BYTES // 8))
    return Level(bytes(out), hashes, seed)


def build_cascade(listed: DataFrame, universe: DataFrame, seed: int = 0) -> list[Level]:
    """Levels for listed (key) that are exact on universe (key). An empty list has no levels."""
    listed = cut(listed.filter("key is not null").select("key").distinct())
    n = listed.count()
    if not n:
        return []
    size = universe.agg(F.approx_count_distinct("key")).first()[0]
    first = _level(listed, n, min(0.5, n / (max(size, n) * math.sqrt(2))), seed)
    wrong = universe.filter(first.takes(F.col("key"))).select("key").distinct().join(listed, "key", "left_anti")
    levels, inside, outside = [first], listed, cut(wrong)
    while left := outside.count():
        level = _level(outside, left, 0.5, seed + len(levels))
        levels.append(level)
        inside, outside = outside, cut(inside.filter(level.takes(F.col("key"))))
    return levels


def listed(levels: list[Level], key: Column) -> Column:
    """Whether the cascade lists the key: exact for keys of its universe."""
    out = F.lit(len(levels) % 2 == 1)
    for i in reversed(range(len(levels))):
        out = F.when(levels[i].takes(key), out).otherwise(F.lit(i % 2 == 1))
    return out


def filter_urls(pages: DataFrame, rules: list[tuple[str, str, str]] | DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """pages with host, path, rule and verdict; columns of these names are replaced.

    Null urls and urls without :// have an empty host and path and get the default, as do urls that no rule fits. The
    longest fitting rule wins; of equally long ones that with the longer host. Repeated rows are judged alike, an
    empty table stays empty. A rule listed both as block and as allow blocks. Rules with a null part are left out. The
    corpus's keys are written once, distinct, and serve all levels of both lists.
    """
    spark = pages.sparkSession
    if not isinstance(rules, DataFrame):
        rules = spark.createDataFrame(rules, "host string, path string, verdict string")
    rules = rules.filter("host is not null and path is not null and verdict is not null")
    lengths = sorted(r[0] for r in rules.select(F.length("path")).distinct().collect())
    keyed = rules.select(F.concat("host", "path").alias("key"), "verdict")
    out = pages.drop("host", "path", "rule", "verdict").withColumns({"host": host_of(F.col(url)), "path": path_of(F.col(url))})
    asks = candidate_keys(F.col("host"), F.col("path"), lengths or [0])
    universe = cut(out.select(F.explode(asks).alias("key")).distinct())
    blocks = build_cascade(keyed.filter("verdict = 'block'"), universe, 1)
    allows = build_cascade(keyed.filter("verdict = 'allow'"), universe, 1001)
    fits = F.filter(asks, lambda k: listed(blocks, k) | listed(allows, k))
    out = out.withColumn("rule", F.get(fits, F.lit(0)))
    verdict = F.when(F.col("rule").isNull(), F.lit(default)).when(listed(blocks, F.col("rule")), "block").otherwise("allow")
    return out.withColumn("verdict", verdict)


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return filter_urls(pages, RULES).select("page_id", "host", "path", "rule", "verdict")


ORACLE_SQL = """
WITH a AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
b AS (SELECT page_id, regexp_extract(rest, '^[^?#]*') AS bare, regexp_extract(rest, '^[^/?#]*') AS h FROM a),
c AS (SELECT page_id, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             substr(bare, length(h) + 1) AS path FROM b),
r AS (SELECT * FROM (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')) AS t(rh, rp, v)),
m AS (SELECT page_id, rh || rp AS rule, v, row_number() OVER (PARTITION BY page_id ORDER BY length(rh || rp) DESC, length(rh) DESC) AS k
      FROM c JOIN r ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp))
SELECT c.page_id, c.host, c.path, m.rule, coalesce(m.v, 'allow') AS verdict FROM c LEFT JOIN m ON m.page_id = c.page_id AND m.k = 1
"""
