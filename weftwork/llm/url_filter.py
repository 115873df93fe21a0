"""URL filters: an exact Bloom filter cascade over listed keys, evaluated without joins and without Python.

The universe is every key that the corpus can ask for (each host with its parent domains, each with every path prefix of a
listed length). Level 1 encodes the listed keys; its false positives in the universe are encoded by level 2, the listed
keys that level 2 passes by level 3, and so on until a level passes nothing wrong. A key's answer is then the parity of
the first level that rejects it, which is exact for the whole universe.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import materialize, release

BITS_PER_KEY, HASHES, LEAST_BITS = 12, 4, 256
#: Size bound of all levels together, enough for some 4 million listed keys. The filters travel inside the plan, each level
#: as one literal; beyond the bound the same keys are looked up by joins.
MOST_BYTES = 8 << 20
RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"))


class Level(NamedTuple):
    bits: int
    words: list[int]
    seed: int

    def passes(self, key: Column) -> Column:
        """All of the key's bits are set."""
        # One string that is folded into one array literal when the plan is optimised.
        table = F.split(F.lit(",".join(map(str, self.words))), ",").cast("array<bigint>")
        return F.forall(F.array(*positions(key, self.bits, self.seed)), lambda p: F.getbit(F.element_at(table, (F.shiftright(p, 6) + 1).cast("int")), (p % 64).cast("int")) == 1)


def positions(key: Column, bits: int, seed: int) -> list[Column]:
    """The places of a key's bits, by double hashing."""
    n = F.lit(bits).cast("long")
    one, two = F.pmod(F.xxhash64(key, F.lit(seed)), n), F.pmod(F.xxhash64(key, F.lit(-seed)), n)
    return [(one + two * i) % n for i in range(HASHES)]


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty where it is null or has no `://`."""
    rest = F.when(F.contains(url, F.lit("://")), F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def candidate_keys(host: Column, path: Column, lengths: list[int], most_labels: int) -> Column:
    """Every `domain + path prefix` that could be listed for a url: the host and its parent domains of at most `most_labels`
    labels, with each prefix of a listed length."""
    labels = F.split(host, "\\.", -1)
    some = F.slice(labels, -F.least(F.size(labels), F.lit(most_labels)), F.least(F.size(labels), F.lit(most_labels)))
    domains = F.transform(F.sequence(F.lit(1), F.size(some)), lambda i: F.array_join(F.slice(some, i, F.size(some)), "."))
    prefixes = F.array(*[F.when(F.length(path) >= n, F.substring(path, 1, n)) for n in lengths])
    return F.filter(F.flatten(F.transform(domains, lambda d: F.transform(prefixes, lambda p: F.concat(d, p)))), lambda k: k.isNotNull())


def build_level(keys: DataFrame, n: int, seed: int) -> Level:
    """A Bloom filter of the n keys in column `key`, built by aggregating words of 64 bits."""
    bits = max(LEAST_BITS, -(-n * BITS_PER_KEY // 64) * 64)
    places = keys.select(F.explode(F.array(*positions(F.col("key"), bits, seed))).alias("place"))
    words = places.groupBy(F.shiftright("place", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(place % 64 as int))")).alias("v"))
    table = [0] * (bits // 64)
    for word, v in words.collect():  # at most bits / 64 rows, bounded by MOST_BYTES
        table[word] = v
    return Level(bits, table, seed)


class TooLarge(ValueError):
    """The filters would be larger than their bound."""


class Cascade(NamedTuple):
    levels: list[Level]

    def listed(self, key: Column) -> Column:
        """Whether a key of the universe is listed: rejected first by an even level, or passed by an odd last one."""
        answer = F.lit(len(self.levels) % 2 == 1)
        for i in range(len(self.levels) - 1, -1, -1):
            answer = F.when(self.levels[i].passes(key), answer).otherwise(F.lit(i % 2 == 1))
        return answer


def build_cascade(listed: DataFrame, universe: DataFrame, most_bytes: int = MOST_BYTES) -> Cascade:
    """The cascade of `listed` (key) over `universe` (key); both may repeat keys and hold nulls, which are ignored.

    Raises TooLarge, a ValueError, where the filters would be larger than `most_bytes`; `by_join` is the way for such lists.
    """
    inside = materialize(listed.select(F.col("key").cast("string")).where("key is not null").distinct(), "listed")
    other: DataFrame | None = None
    levels: list[Level] = []
    keys = inside
    try:
        while (n := keys.count()) or not levels:
            if sum(len(x.words) * 8 for x in levels) + n * BITS_PER_KEY // 8 > most_bytes:
                raise TooLarge("the listed keys need larger filters than most_bytes; use by_join")
            level = build_level(keys, n, len(levels) + 1)
            levels.append(level)
            if other is None:
                passed = universe.select(F.col("key").cast("string")).where("key is not null").where(level.passes(F.col("key"))).distinct()
                wrong = materialize(passed.join(inside, "key", "left_anti"), "passed")
            else:
                wrong = materialize(other.where(level.passes(F.col("key"))), "passed")
                release(other)
            # The next level encodes what this one passed wrongly; after it, the keys of this level are tested again.
            other, keys = keys, wrong
        return Cascade(levels)
    finally:
        release(inside, other, keys)


def judge_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow", most_bytes: int = MOST_BYTES) -> DataFrame:
    """(id, host, path, rule, verdict) for each row of `pages`.

    `rules` has `rule` (domain followed by a path prefix) and `action`, allow or block; rows with another action or a null are
    left out, and a rule that is listed with both blocks. A rule fits its domain and all subdomains where the path starts
    with its own; the longest fitting rule gives the verdict, of equally long ones that which is greater as text, and urls
    without one get `default`. The listed rules are found
    through the cascade, or by joins where its filters would be larger than `most_bytes`; both give the same rows. Null urls
    and urls without `://` have an empty host and path. Repeated rows and null ids stay; other columns are ignored, whatever
    their names; without rules or pages the result has the same columns.
    """
    host, path = host_and_path(F.col(url_col).cast("string"))
    base = pages.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path"))
    known = rules.select(F.col("rule").cast("string").alias("key"), F.col("action").cast("string").alias("action")).where("key is not null and action in ('allow', 'block')")
    known = materialize(known.groupBy("key").agg(F.max("action").alias("action")), "rules")
    domain = F.regexp_extract("key", r"(?s)^[^/]*", 0)
    # Distinct lengths of listed paths: no more than the longest has characters.
    lengths = [r[0] for r in known.select((F.length("key") - F.length(domain)).alias("n")).distinct().orderBy("n").collect()]
    if not lengths:
        return base.select(F.col("id").alias(id_col), "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    most_labels = known.agg(F.max(F.size(F.split(domain, "\\.", -1)))).first()[0]
    keys = candidate_keys(F.col("host"), F.col("path"), lengths, most_labels)
    parts = base.select("host", "path").distinct()
    try:
        cascade = build_cascade(known, parts.select(F.explode(keys).alias("key")), most_bytes)
        # Only listed rules are asked whether they block, so these are the second cascade's universe.
        blocks = build_cascade(known.where("action = 'block'"), known, most_bytes)
    except TooLarge:
        asked = parts.select("host", "path", F.explode(keys).alias("key"))
        found = by_join(asked, known).join(known, "key").groupBy("host", "path").agg(F.max(F.struct(F.length("key").alias("n"), "key", "action")).alias("r"))
        rule = F.col("r")["key"]
        verdict = F.coalesce(F.col("r")["action"], F.lit(default))
        return base.join(found, ["host", "path"], "left").select(F.col("id").alias(id_col), "host", "path", rule.alias("rule"), verdict.alias("verdict"))
    release(known)
    hits = F.filter(keys, cascade.listed)
    longest = F.array_max(F.transform(hits, lambda k: F.struct(F.length(k).alias("n"), k.alias("key"))))["key"]
    out = base.withColumn("rule", longest)
    verdict = F.when(F.col("rule").isNull(), F.lit(default)).otherwise(F.when(blocks.listed(F.col("rule")), "block").otherwise("allow"))
    return out.select(F.col("id").alias(id_col), "host", "path", "rule", verdict.alias("verdict"))


def by_join(keys: DataFrame, listed: DataFrame) -> DataFrame:
    """The rows of `keys` whose `key` is listed, by a semi join: for lists beyond the cascade's size bound."""
    return keys.join(listed.select("key").distinct(), "key", "left_semi")


def default_rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(RULES), "rule string, action string")
