"""URL filters: Bloom filter cascades give exact rule membership over the corpus's own keys. DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from blockframe.llm.common import LOWER, UPPER, bit_of, bits_at, checkpointed, table

#: Rules that one cascade lists, about: its filters, literals of the plan, hold some 3 bytes a rule. More rules are dealt over several cascades by a hash of the key.
CASCADE_RULES = 100_000
RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]


def _slot(key: Column, level: int, i: int, bits: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(level), F.lit(i), key), F.lit(bits).cast("long"))


class Cascade:
    """Levels (bits, hashes, bytes). Odd levels encode listed keys, even ones the false positives of the level before."""

    def __init__(self, levels: list[tuple[int, int, bytes]]):
        self.levels = levels

    def passes(self, key: Column, level: int) -> Column:
        bits, hashes, data = self.levels[level]
        out = F.lit(True)
        for i in range(hashes):
            out = out & bit_of(data, _slot(key, level, i, bits))
        return out

    def contains(self, key: Column) -> Column:
        """Exact for listed keys and for keys of the universe the cascade was built over."""
        out = F.lit(len(self.levels) % 2 == 1)
        for level in reversed(range(len(self.levels))):
            out = F.when(~self.passes(key, level), F.lit(level % 2 == 1)).otherwise(out)
        return out


def _encode(keys: DataFrame, level: int, n: int, rate: float) -> tuple[int, int, bytes]:
    """A Bloom filter over keys (column key): n of them, wanted false positive rate."""
    hashes = max(1, round(-math.log2(rate)))
    bits = max(64, math.ceil(n * hashes / math.log(2) / 8) * 8)
    slots = keys.select(F.explode(F.array(*[_slot(F.col("key"), level, i, bits) for i in range(hashes)])).alias("slot"))
    return bits, hashes, bits_at(slots, bits)


def build_cascade(listed: DataFrame, universe: DataFrame) -> Cascade:
    """listed, universe: DataFrames with a column key. Universe keys may repeat. The filters, 3 bytes a listed key about, come to the driver.

    The first level's rate is sqrt(1/2) * listed / universe (over the root of that only when it would exceed 1/2), so the
    false positives that level 2 encodes number about as many as the listed keys, however large the corpus.
    """
    listed = listed.where("key IS NOT NULL").distinct()
    n = listed.count()
    if not n:
        return Cascade([])
    foreign = universe.where("key IS NOT NULL").join(listed, "key", "left_anti")
    size = foreign.agg(F.approx_count_distinct("key")).first()[0]
    made = Cascade([_encode(listed, 0, n, min(0.5, math.sqrt(0.5) * n / max(1, size)))])
    sides = [listed, foreign]
    while True:
        level = len(made.levels)
        side = 0 if level % 2 else 1  # whose keys the level before encoded
        passed = sides[1 - side].where(made.passes(F.col("key"), level - 1)).distinct()
        wrong = passed.count()
        if not wrong:
            return made
        sides[1 - side] = passed
        made.levels.append(_encode(passed, level, wrong, 0.5))


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path as the rules see them; both empty if url is null or has no ://."""
    rest = F.when(F.instr(url, "://") > 0, F.regexp_replace(url, r"(?s)^.*?://", "")).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), UPPER, LOWER)
    return host, F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def _labels(host: Column) -> Column:
    return F.char_length(host) - F.char_length(F.replace(host, F.lit("."), F.lit(""))) + 1


def _keys(counts: list[int], lengths: list[int]) -> Column:
    """What a rule of so many labels and so long a path would have to be to fit columns host and path."""
    labels = F.filter(F.array(*[F.lit(c) for c in counts]), lambda c: c <= _labels(F.col("host")))
    cuts = F.filter(F.array(*[F.lit(x) for x in lengths]), lambda x: x <= F.char_length("path"))
    return F.flatten(F.transform(labels, lambda c: F.transform(cuts, lambda x: F.concat(F.call_function("substring_index", F.col("host"), F.lit("."), -c), F.lit("\t"), F.substring(F.col("path"), F.lit(1), x)))))


def _dealt(key: Column, k: int, passes: int) -> Column:
    """Whether key belongs to pass k."""
    return F.pmod(F.xxhash64(F.lit(5), key), F.lit(passes)) == k if passes > 1 else F.lit(True)


def _fitting(made: Cascade, action: str, k: int, passes: int) -> Column:
    """The listed ones of the array column keys that pass k deals with."""
    listed = F.filter("keys", lambda key: _dealt(key, k, passes) & made.contains(key))
    return F.transform(listed, lambda key: F.struct((F.char_length(key) - 1).alias("n"), F.translate(key, "\t", "").alias("rule"), F.lit(action).alias("action")))


def judge_urls(pages: DataFrame, rules: list[tuple[str, str, str]] | DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per input row: id, host, path, rule, verdict. Other columns are ignored; an empty table gives no rows.

    A rule (action, host, path), of a list or of a DataFrame with these columns, fits its host and all subdomains if the url's path starts with the rule's path; the
    longest fitting rule wins (ties: the greater string, then the greater action). rule is null and verdict allow where none fits, also for null, empty and malformed urls.
    The universe holds, of every page, the host's ends of as many labels and the path's beginnings of as many characters as some rule has, so membership is exact there
    and no page is joined with a rule. Hosts and paths may be of any length. Each CASCADE_RULES rules, about, take one pass over the pages; the passes' best fits are kept in the checkpoint folder.
    """
    spark = pages.sparkSession
    if not isinstance(rules, DataFrame):
        rows = F.array(*[F.struct(F.lit(a).alias("action"), F.lit(h).alias("host"), F.lit(p).alias("path")) for a, h, p in rules or [("", "", "")]])
        rules = spark.range(1 if rules else 0).select(F.explode(rows).alias("r")).select("r.*")
    listed = rules.where("action IS NOT NULL AND host IS NOT NULL AND path IS NOT NULL").select("action", F.concat("host", F.lit("\t"), "path").alias("key"), _labels(F.col("host")).alias("labels"), F.char_length("path").alias("length")).distinct()
    listed = checkpointed(listed)
    host, path = split_url(F.col(url_col))
    read = pages.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path"))
    shape = listed.agg(F.collect_set("labels").alias("labels"), F.collect_set("length").alias("lengths")).first()  # labels of a host and characters of a path, each once
    best = F.lit(None).cast("struct<n:int,rule:string,action:string>")
    sizes = {r.action: r["count"] for r in listed.groupBy("action").count().collect()}
    if sizes:
        keys = _keys(sorted(shape.labels), sorted(shape.lengths))
        universe = checkpointed(read.select(F.explode(keys).alias("key")).distinct())
        passes = max(-(-n // CASCADE_RULES) for n in sizes.values())
        read = read.withColumn("best", best)
        for k in range(passes):
            fits = []
            for action in sorted(sizes):
                made = build_cascade(listed.where((F.col("action") == action) & _dealt(F.col("key"), k, passes)).select("key"), universe.where(_dealt(F.col("key"), k, passes)))
                fits.append(_fitting(made, action, k, passes))
            read = read.withColumn("keys", keys).withColumn("best", F.array_max(F.concat(F.array("best"), *fits))).drop("keys")
            if k + 1 < passes:
                read = checkpointed(read)
        best = F.col("best")
    return read.select("id", "host", "path", best["rule"].alias("rule"), F.coalesce(best["action"], F.lit("allow")).alias("verdict"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"), RULES).withColumnRenamed("id", "page_id")


ORACLE_SQL = {
    "op8_url_filter": r"""
WITH p AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
u AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p),
r(action, h, q) AS (VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'), ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')),
m AS (SELECT page_id, max({'n': length(h || q), 'rule': h || q, 'action': action}) AS best FROM u JOIN r
      ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, q) GROUP BY page_id)
SELECT u.page_id, host, path, best.rule AS rule, coalesce(best.action, 'allow') AS verdict FROM u LEFT JOIN m USING (page_id)
"""
}
