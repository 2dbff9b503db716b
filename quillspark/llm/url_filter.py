"""URL filters by a cascade of Bloom filters (DataFrame functions only).

Level 1 encodes the listed keys; level 2 encodes those other keys of the corpus
that level 1 passes by mistake; level 3 the listed keys that level 2 passes by
mistake; and so on until a level makes no mistake over the complete universe of
keys that the corpus can ask about.  Walking the levels then answers membership
exactly, by bit tests inside the scan: the pages are never joined.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, UPPER, cut

#: Most bits that one level may have; the levels travel inside the plan.
MAX_LEVEL_BITS = 1 << 23
#: Bits in a word of a level; long values keep their sign bit free.
WORD_BITS = 32

BLOCK_RULES = ("net/", "example.com/de/")
ALLOW_RULES = ("example.net/en/", "org/fr/")
#: One host on a line; those that no rule decides are blocked when they, or a domain above them, are listed here.
BLOCKED_HOSTS_FILE = Path(__file__).with_name("blocked_hosts.txt")


class TooManyKeys(ValueError):
    """A list whose levels would not fit into a plan."""


def _keys(spark: SparkSession, keys: Sequence[str]) -> DataFrame:
    return spark.createDataFrame(pa.table({"key": pa.array(keys, pa.string())}))


def split_url(url: Column) -> tuple[Column, Column]:
    """Host and path of a url; both empty for null and for text without ``://``."""
    url = F.coalesce(url, F.lit(""))
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    path = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)
    return F.translate(host, UPPER, LOWER), path


@dataclass
class Shape:
    """The key shapes that listed keys have: (labels of the host, characters of the path)."""

    shapes: list[tuple[int, int]]

    @classmethod
    def of(cls, keys: Sequence[str]) -> Shape:
        found = set()
        for key in keys:
            host, slash, path = key.partition("/")
            found.add((host.count(".") + 1, len(slash + path)))
        return cls(sorted(found))

    def candidates(self, host: Column, path: Column) -> Column:
        """All keys of these shapes that fit the url, the longest first; other keys can't be listed.

        Built from the shapes, not from all suffixes, so a host of very many
        labels costs no more than another.
        """
        labels = F.length(host) - F.length(F.replace(host, F.lit("."), F.lit(""))) + 1
        each = [
            F.when(
                (host != "") & (labels >= k) & (F.length(path) >= n),
                F.concat(F.substring_index(host, ".", -k), F.substring(path, 1, n)),
            )
            for k, n in self.shapes
        ]
        keys = F.array_compact(F.array(*each)) if each else F.array().cast("array<string>")
        return F.transform(F.array_sort(F.transform(keys, lambda k: F.struct((-F.length(k)).alias("n"), k.alias("k")))), lambda s: s["k"])


@dataclass
class Level:
    seed: int
    bits: int
    hashes: int
    words: list[int]

    def passes(self, key: Column) -> Column:
        words = F.split(F.lit(",".join(map(str, self.words))), ",").cast("array<bigint>")
        tests = []
        for j in range(self.hashes):
            at = _position(key, self.seed, j, self.bits)
            word = F.element_at(words, F.floor(at / WORD_BITS).cast("int") + 1)
            tests.append(F.getbit(word, F.pmod(at, F.lit(WORD_BITS)).cast("int")) == 1)
        out = tests[0]
        for t in tests[1:]:
            out = out & t
        return out


def _position(key: Column, seed: int, j: int, bits: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(seed * 64 + j)), F.lit(bits))


@dataclass
class Cascade:
    levels: list[Level] = field(default_factory=list)

    def contains(self, key: Column) -> Column:
        """Exact for every key of the universe that the cascade was built over."""
        # after the last level: in the list if the number of levels is odd
        out = F.lit(len(self.levels) % 2 == 1)
        for i in range(len(self.levels) - 1, -1, -1):
            out = F.when(self.levels[i].passes(key), out).otherwise(F.lit(i % 2 == 1))
        return out


def build_cascade(
    listed: DataFrame, universe: DataFrame, seed: int, first_rate: float = 0.05, rate: float = 0.5, max_level_bits: int = MAX_LEVEL_BITS
) -> Cascade:
    """A cascade that tells ``listed`` from the rest of ``universe`` (both: one column ``key``).

    Only bit words reach the driver, at most ``max_level_bits`` a level.  A list
    beyond that raises ``TooManyKeys``; ``url_filter`` then joins.
    """
    listed = cut(listed.filter("key is not null").distinct(), "listed")
    inside, outside = listed, None
    levels: list[Level] = []
    while True:
        n = inside.count()
        if n == 0:
            return Cascade(levels)
        p = first_rate if not levels else rate
        bits = max(64, math.ceil(-n * math.log(p) / math.log(2) ** 2 / WORD_BITS) * WORD_BITS)
        if bits > max_level_bits:
            raise TooManyKeys(f"{n} keys need {bits} bits in a level; at most {max_level_bits} are allowed")
        hashes = max(1, round(bits / n * math.log(2))) if n < bits else 1
        hashes = min(hashes, 8)
        seed += 1
        at = F.explode(F.array(*[_position(F.col("key"), seed, j, bits) for j in range(hashes)]))
        set_bits = inside.select(at.alias("at")).groupBy(F.floor(F.col("at") / WORD_BITS).alias("w")).agg(
            F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("at", F.lit(WORD_BITS)).cast("int"))).alias("bits")
        )
        words = [0] * (bits // WORD_BITS)
        for row in set_bits.collect():
            words[row["w"]] = row["bits"]
        level = Level(seed, bits, hashes, words)
        levels.append(level)
        if outside is None:
            wrong = universe.filter(level.passes(F.col("key"))).join(listed, "key", "left_anti")
        else:
            wrong = outside.filter(level.passes(F.col("key")))
        inside, outside = cut(wrong, "passed-by-mistake"), inside


def _with_listed(parts: DataFrame, keys: Column, listed: DataFrame, universe: DataFrame, seed: int, max_level_bits: int) -> DataFrame:
    """Add ``_bad``: whether one of the page's keys is listed.

    A bit test in the scan; for a list too long for a plan, a join of the
    distinct hosts and paths with it, which is as exact.
    """
    try:
        cascade = build_cascade(listed, universe, seed, max_level_bits=max_level_bits)
    except TooManyKeys:
        asked = parts.select("host", "path").distinct().select("host", "path", F.explode(keys).alias("key"))
        bad = cut(asked.join(listed, "key", "left_semi").select("host", "path").distinct().withColumn("_bad", F.lit(True)), "listed-pages")
        return parts.join(bad, ["host", "path"], "left").withColumn("_bad", F.coalesce("_bad", F.lit(False)))
    return parts.withColumn("_bad", F.exists(keys, lambda k: cascade.contains(k)))


def url_filter(
    pages: DataFrame,
    block_rules: Sequence[str] = BLOCK_RULES,
    allow_rules: Sequence[str] = ALLOW_RULES,
    blocked_hosts: DataFrame | None = None,
    max_level_bits: int = MAX_LEVEL_BITS,
) -> DataFrame:
    """page_id, host, path, rule, verdict for each row of ``pages``.

    A rule (host and path) fits its host and all subdomains if the path starts
    with the rule's; the longest that fits decides.  Where none fits, the page
    is blocked if its host or a domain above it is in ``blocked_hosts`` (a table
    with a column ``host``, of any length; if none is given,
    ``BLOCKED_HOSTS_FILE``), else allowed.  A null url, or one without ``://``,
    has an empty host and path, fits nothing and is allowed.  Repeated rows are
    judged alike, each on its own; an empty table gives no rows; null and empty
    hosts of the list and other columns are ignored.
    """
    spark = pages.sparkSession
    if blocked_hosts is None:
        names = _keys(spark, BLOCKED_HOSTS_FILE.read_text().split())
    else:
        names = blocked_hosts.select(F.translate("host", UPPER, LOWER).alias("key")).filter("key <> ''")
    names = cut(names.distinct(), "blocked-hosts")
    host, path = split_url(F.col("url"))
    parts = pages.select("page_id", host.alias("host"), path.alias("path"))
    rules = Shape.of([*block_rules, *allow_rules])
    # numbers of labels, of which a host name has few
    labels = names.select((F.length("key") - F.length(F.replace("key", F.lit("."), F.lit(""))) + 1).alias("n")).distinct()
    hosts = Shape(sorted((r["n"], 0) for r in labels.collect()))
    rule_keys, host_keys = rules.candidates(F.col("host"), F.col("path")), hosts.candidates(F.col("host"), F.col("path"))
    # the complete universe: every key that any page can ask about
    universe = cut(parts.select(F.explode(F.concat(rule_keys, host_keys)).alias("key")).distinct(), "key-universe")
    blocks, allows = (build_cascade(_keys(spark, keys), universe, seed) for keys, seed in ((block_rules, 100), (allow_rules, 200)))
    fitting = F.filter(rule_keys, lambda k: blocks.contains(k) | allows.contains(k))
    rule = F.when(F.size(fitting) > 0, F.element_at(fitting, 1))
    judged = _with_listed(parts, host_keys, names, universe, 300, max_level_bits).select("page_id", "host", "path", rule.alias("rule"), "_bad")
    verdict = F.when(F.col("rule").isNotNull(), F.when(allows.contains(F.col("rule")), "allow").otherwise("block")).otherwise(
        F.when(F.col("_bad"), "block").otherwise("allow")
    )
    return judged.select("page_id", "host", "path", "rule", verdict.alias("verdict"))
