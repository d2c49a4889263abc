"""URL filters: host and path rules, and exact membership of a key list by a cascade of Bloom filters.

The cascade's first filter encodes the listed keys. The second encodes the keys of the corpus that are not listed but
pass the first, the third the listed ones that pass the second, and so on until none are left. A key is decided by
the first filter that it fails, so the cascade is exact for every key of the universe it was built over, here all
the corpus's keys, and rows are judged by bit look-ups without a join. Filters are long arrays read as scalar
subqueries; a list whose filter would exceed ``max_bits`` is split into shards by key hash, which are built together, and each row
meets its shard's filters, one row a shard, by the shard's number: the table is read once at any size.

Only DataFrame functions are used. Defined cases: a null URL, or one without ``://``, has an empty host and path; the empty
host is a key like any other and is never listed by itself; null listed keys are ignored; repeated rows each give a row; an
empty table gives an empty table; other columns are kept, and a new column whose name they have gets underscores in front.
"""
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rostrum.llm._spark import Scratch, free_names

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Host labels of unwanted sites; with them op5 makes its list, in place of an external one.
UNWANTED = r"(^|[.-])(ads|adult|bets|casino|gambling|malware|phishing|pills|poker|porn|spam|tracker|viagra|xxx)([.-]|$)"
#: (host, path, verdict)
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))


def with_host_path(pages: DataFrame, url: str = "url", host: str = "host", path: str = "path") -> DataFrame:
    """``pages`` with two columns more, named as given."""
    at = F.locate("://", F.col(url))
    rest = F.when(at > 0, F.expr(f"substring({url}, locate('://', {url}) + 3)")).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    return pages.withColumns({host: F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER), path: F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)})


def rule_of(rules=RULES, at: str = "host", on: str = "path") -> tuple[Column, Column]:
    """The longest fitting rule and its verdict, null where none fits."""
    rule = verdict = F.lit(None).cast("string")
    for host, path, what in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):  # the longest ends up outermost
        fits = ((F.col(at) == host) | F.col(at).endswith("." + host)) & F.col(on).startswith(path)
        rule, verdict = F.when(fits, host + path).otherwise(rule), F.when(fits, what).otherwise(verdict)
    return rule, verdict


def _bit(key: Column, level: int, i: int, bits: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(level * 64 + i), key), F.lit(bits))


class Cascade:
    """Filters over ``keys`` (columns key and listed, one row a key), a row a shard; the verdicts are exact for those keys.

    All shards have filters of the size that the fullest one needs, level by level."""

    def __init__(self, scratch: Scratch, keys: DataFrame, bits_per_key: int = 10, hashes: int = 6, shards: int = 1):
        self.hashes, self.shards, self.levels = hashes, shards, []
        spark = scratch.spark
        keys = keys.select("key", "listed", self.shard(F.col("key")).alias("shard"))
        inside, outside = scratch.save(keys.where("listed").select("shard", "key")), keys.where("not listed").select("shard", "key")
        n = self._fullest(inside)
        while n:
            level, bits = len(self.levels), 64 * max(1, -(-n * bits_per_key // 64))
            at = F.explode(F.array(*[_bit(F.col("key"), level, i, bits) for i in range(hashes)]))
            set_ = inside.select("shard", at.alias("at")).selectExpr("shard", "at div 32 as word", "shiftleft(1L, cast(at % 32 as int)) as bits")
            words = bits // 32
            none = spark.range(words * shards).selectExpr(f"cast(id div {words} as int) as shard", f"id % {words} as word", "0L as bits")
            full = set_.unionAll(none).groupBy("shard", "word").agg(F.bit_or("bits").alias("bits"))
            # Of bits / 32 longs each: bounded by max_bits.
            rows = full.groupBy("shard").agg(F.transform(F.array_sort(F.collect_list(F.struct("word", "bits"))), lambda x: x.bits).alias("bits"))
            self.levels.append((scratch.save(rows), bits))
            passed = self.with_filters(outside, [level])
            passed = scratch.save(passed.where(self._hit(F.col("key"), level)).select("shard", "key"))
            inside, outside, n = passed, inside, self._fullest(passed)

    def shard(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(F.lit(-1), key), F.lit(self.shards)).cast("int") if self.shards > 1 else F.lit(0)

    def _fullest(self, keys: DataFrame) -> int:
        return keys.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0

    def with_filters(self, rows: DataFrame, levels=None, shard: str = "shard") -> DataFrame:
        """``rows`` with their shard's filters, where there are several; one shard's are read as scalar subqueries and need no column."""
        for level in (range(len(self.levels)) if levels is None else levels) if self.shards > 1 else ():
            table = self.levels[level][0].select(F.col("shard").alias(f"_at_{level}"), F.col("bits").alias(f"_filter_{level}"))
            rows = rows.join(table, F.col(shard) == F.col(f"_at_{level}"), "left")
        return rows

    def _hit(self, key: Column, level: int) -> Column:
        row, bits = self.levels[level]
        words, hit = F.col(f"_filter_{level}") if self.shards > 1 else row.select("bits").scalar(), F.lit(True)
        for i in range(self.hashes):
            at = _bit(key, level, i, bits)
            word = F.get(words, F.floor(at / 32).cast("int"))
            hit = hit & (F.getbit(word, F.pmod(at, F.lit(32)).cast("int")) == 1)
        return hit

    def has(self, key: Column) -> Column:
        """Decided by the first filter failed: an even one says no, an odd one yes; a key that passes all is as the last says."""
        out = F.lit(len(self.levels) % 2 == 1)
        for level in reversed(range(len(self.levels))):
            out = F.when(self._hit(key, level), out).otherwise(F.lit(level % 2 == 1))
        return out


def listed_flag(rows: DataFrame, key: str, listed: DataFrame, max_bits: int = 1 << 26, bits_per_key: int = 10, out: str = "listed") -> DataFrame:
    """``rows`` with the column ``out``: whether ``rows[key]`` is a row of the one-column table ``listed``.

    The universe is every distinct key of ``rows``."""
    scratch = Scratch(rows.sparkSession)
    names = listed.select(F.col(listed.columns[0]).alias("key")).where("key is not null").distinct().withColumn("l", F.lit(True))
    keys = rows.select(F.col(key).alias("key")).where("key is not null").distinct().join(names, "key", "left")
    keys = scratch.save(keys.select("key", F.coalesce("l", F.lit(False)).alias("listed")))
    shards = -(-keys.where("listed").count() * bits_per_key // max_bits) or 1
    cascade = Cascade(scratch, keys, bits_per_key, shards=shards)
    flag = F.coalesce(cascade.has(F.col(key)) & F.col(key).isNotNull(), F.lit(False)).alias(out)
    if shards == 1:
        return rows.select("*", flag)
    (own,) = free_names(rows, "_shard")
    return cascade.with_filters(rows.withColumn(own, cascade.shard(F.col(key))), shard=own).select(*rows.columns, flag)


def filter_urls(pages: DataFrame, listed: DataFrame, rules=RULES, url: str = "url", **options) -> DataFrame:
    """``pages`` with host, path, rule, listed and verdict: the rule's; else block where the host is listed, allow where not."""
    host, path, rule, flag, verdict = free_names(pages, "host", "path", "rule", "listed", "verdict")
    which, what = rule_of(rules, host, path)
    judged = listed_flag(with_host_path(pages, url, host, path), host, listed, out=flag, **options)
    method = F.when(F.col(flag), "block").otherwise("allow")
    return judged.withColumn(rule, which).withColumn(verdict, F.coalesce(what, method))


def op5_url_filter(spark, sf_dir: str) -> DataFrame:
    """The list is made of the corpus's hosts with a label among UNWANTED, in place of an external one."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    hosts = with_host_path(pages).select("host").distinct()
    listed = hosts.where(F.col("host").rlike(UNWANTED))
    return filter_urls(pages, listed).select("page_id", "host", "path", "rule", "verdict", "listed")


OP5_SQL = rf"""
WITH rest AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
ruled AS (
  SELECT *, CASE
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule,
    regexp_matches(host, '{UNWANTED}') AS listed
  FROM parts)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('example.com/de/', 'net/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
            WHEN listed THEN 'block' ELSE 'allow' END AS verdict, listed
FROM ruled
"""
