"""Operator 4: allow and block rules for URLs, looked up in Bloom filter cascades."""

from __future__ import annotations

from dataclasses import dataclass
from math import ceil, log

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratacat.llm.common import cut, table

#: (verdict, host, path)
RULES = (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_path(url: Column) -> tuple[Column, Column]:
    """What stands after the first :// up to / ? # or the end, A-Z lower-cased, and then up to ? or #. Null or no ://: two empty strings."""
    rest = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1), F.lit(""))
    return F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def candidates(host: Column, path: Column, shapes: list[tuple[int, int]]) -> Column:
    """The keys that could fit: for each (labels, length) that a rule has, the host's last labels and the path's first characters, joined.

    A host has no / and a path starts with one, so a key has one reading. There are as many as shapes at most, however long the URL is.
    """
    labels = F.size(F.split(host, r"\."))
    each = [F.when((host != "") & (labels >= n) & (F.length(path) >= m), F.concat(F.substring_index(host, ".", -n), F.substring(path, 1, m))) for n, m in shapes]
    return F.array_distinct(F.filter(F.array(*each), lambda k: k.isNotNull()))


@dataclass(frozen=True)
class Level:
    words: np.ndarray  # 64 bits each
    bits: int
    hashes: int

    def all_set(self, places: np.ndarray) -> np.ndarray:
        """Of each row of places whether all its bits are set."""
        return ((self.words[places >> 6] >> (places & 63).astype(np.uint64)) & np.uint64(1)).all(axis=1)


class TooLong(ValueError):
    """A list whose filter would take more than the bits allowed."""


def _places(key: Column, level: int, bits: int, hashes: int) -> list[Column]:
    return [F.pmod(F.xxhash64(key, F.lit(level), F.lit(i)), F.lit(bits)).cast("long") for i in range(hashes)]


def _build(keys: DataFrame, n: int, level: int, rate: float, most_bits: int) -> Level:
    """A filter of n keys. Tasks set the bits in words of 64, combined by bit_or before and after the shuffle; the driver gets the words that aren't zero, most_bits / 8 bytes at most."""
    bits = max(64, ceil(max(n, 1) * log(1 / rate) / log(2) ** 2))
    if bits > most_bits:
        raise TooLong(f"{n} keys need {bits} bits; most_bits is {most_bits}")
    hashes = max(1, round(log(1 / rate) / log(2)))
    at = keys.select(F.explode(F.array(*_places(F.col("key"), level, bits, hashes))).alias("at"))
    rows = at.groupBy(F.floor(F.col("at") / 64).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at % 64 as int))")).alias("set")).toArrow()
    out = np.zeros(ceil(bits / 64), dtype=np.uint64)
    out[rows["word"].to_numpy()] = rows["set"].to_numpy().view(np.uint64)
    return Level(out, bits, hashes)


class Cascade:
    """Exact membership of listed keys among the keys of a universe.

    Level 0 holds the listed keys, level 1 the universe's other keys that pass level 0, level 2 the listed keys that pass level 1, and so on until none is left.
    A key is listed if the first level that it fails is an odd one (or the last level is an even one that it passes). Every key of the universe gets the right answer;
    a key outside it might not. Each level is smaller than the one before by the false positive rate, so the whole is a few bits for each listed key.
    """

    def __init__(self, spark: SparkSession, listed: DataFrame, universe: DataFrame, rate: float = 0.1, most_bits: int = 1 << 27, most_levels: int = 60) -> None:
        """listed and universe: DataFrames with the column key. most_bits: of one level, broadcast as most_bits / 8 bytes; a list that needs more raises TooLong."""
        ins = cut(listed.select("key").where("key is not null").distinct())
        outs = universe.select("key").where("key is not null").distinct().join(ins, "key", "left_anti")
        self.levels: list[Level] = []
        n = ins.count()
        while n:
            if len(self.levels) == most_levels:
                raise ValueError("the filters don't tell the keys apart")
            self.levels.append(_build(ins, n, len(self.levels), rate, most_bits))
            passing = cut(outs.where(self._passes(spark, F.col("key"), len(self.levels) - 1)))
            ins, outs, n = passing, ins, passing.count()
        self._sent = spark.sparkContext.broadcast(self.levels)

    def _passes(self, spark: SparkSession, key: Column, level: int) -> Column:
        sent = spark.sparkContext.broadcast(self.levels[level])

        @F.pandas_udf("boolean")
        def passes(places: pd.Series) -> pd.Series:
            return pd.Series(sent.value.all_set(np.stack(places.to_list())) if len(places) else [], dtype=bool)

        return passes(F.array(*_places(key, level, self.levels[level].bits, self.levels[level].hashes)))

    def listed(self, keys: Column) -> Column:
        """For an array of keys an array of booleans."""
        sizes = [(x.bits, x.hashes) for x in self.levels]
        if not sizes:
            return F.transform(keys, lambda k: F.lit(False))
        places = F.flatten(F.transform(keys, lambda k: F.array(*[p for i, (bits, hashes) in enumerate(sizes) for p in _places(k, i, bits, hashes)])))
        sent, stride = self._sent, sum(h for _, h in sizes)

        @F.pandas_udf("array<boolean>")
        def member(all_places: pd.Series) -> pd.Series:
            counts = [len(x) // stride for x in all_places]
            flat = np.concatenate([*all_places, np.zeros(0, dtype=np.int64)]).astype(np.int64).reshape(-1, stride)
            result, open_, at = np.zeros(len(flat), dtype=bool), np.ones(len(flat), dtype=bool), 0
            for i, level in enumerate(sent.value):
                passed = level.all_set(flat[:, at : at + level.hashes])
                result[open_ & ~passed] = i % 2 == 1
                open_ &= passed
                at += level.hashes
            result[open_] = len(sent.value) % 2 == 1
            return pd.Series(np.split(result, np.cumsum(counts)[:-1]) if counts else [])

        return member(places)


def _cascaded(d: DataFrame, named: DataFrame, universe: DataFrame, rate: float, most_bits: int) -> DataFrame:
    """d with best: of its keys the longest that a cascade lists, with its length and which of the two list it."""
    for v in ("block", "allow"):
        d = d.withColumn(f"__{v}", Cascade(d.sparkSession, named.where(F.col("verdict") == v), universe.union(named.select("key")), rate, most_bits).listed(F.col("__keys")))
    each = F.transform("__keys", lambda k, i: F.struct(F.length(k).alias("n"), F.col("__block")[i].alias("block"), F.col("__allow")[i].alias("allow"), k.alias("key")))
    return d.withColumn("best", F.array_max(F.filter(each, lambda x: x["block"] | x["allow"])))


def _joined(d: DataFrame, named: DataFrame) -> DataFrame:
    """As _cascaded, by joins: each distinct host and path meets its rules by key, and the best goes back to the rows. For lists that are too long to send."""
    keys = d.select("host", "path", "__keys").distinct().select("host", "path", F.explode("__keys").alias("key"))
    lists = named.groupBy("key").agg(F.max(F.col("verdict") == "block").alias("block"), F.max(F.col("verdict") == "allow").alias("allow"))
    best = keys.join(lists, "key").groupBy("host", "path").agg(F.max(F.struct(F.length("key").alias("n"), "block", "allow", "key")).alias("best"))
    return d.join(best, ["host", "path"], "left")


def judge_urls(pages: DataFrame, rules: tuple[tuple[str, str, str], ...] | DataFrame = RULES, default: str = "allow", rate: float = 0.1, most_bits: int = 1 << 27) -> DataFrame:
    """The rows of pages, columns in the struct `page`, with host, path, rule and verdict.

    rules: (allow or block, host, path), a list on the driver or a DataFrame verdict, host, path. A rule fits its host and all subdomains if the path starts with the rule's; the longest wins,
    block before allow if both list the same. A URL that no rule fits gets default. Two cascades, of allowed and of blocked keys, over all keys that the pages' URLs can form
    answer without a join. One pass over url makes the universe, one judges. A list that needs more than most_bits for a level (16 MB; some 28 million rules at rate 0.1)
    is joined by key instead, with the same answers. Null URLs have an empty host and path and get the default. A URL forms no more keys than rules have shapes, however long it is.
    """
    spark = pages.sparkSession
    named = rules if isinstance(rules, DataFrame) else spark.createDataFrame(list(rules), "verdict string, host string, path string")
    named = named.select("verdict", F.concat("host", "path").alias("key"), (F.size(F.split("host", r"\.")).alias("labels")), F.length("path").alias("n"))
    shapes = sorted((r[0], r[1]) for r in named.select("labels", "n").distinct().collect())  # as many as rules have shapes
    host, path = host_path(pages["url"])
    d = pages.select(F.struct(*[pages[c] for c in pages.columns]).alias("page"), host.alias("host"), path.alias("path"))
    d = d.withColumn("__keys", candidates(F.col("host"), F.col("path"), shapes) if shapes else F.array().cast("array<string>"))
    alone = pages.select(host.alias("host"), path.alias("path")).distinct()
    named = named.select("verdict", "key")
    universe = cut(alone.select(F.explode(candidates(F.col("host"), F.col("path"), shapes)).alias("key")).distinct()) if shapes else named.select("key").limit(0)
    try:
        judged = _cascaded(d, named, universe, rate, most_bits)
    except TooLong:
        judged = _joined(d, named)
    best = F.col("best")
    return judged.select("page", "host", "path", best["key"].alias("rule"), F.when(best["block"], "block").when(best["allow"], "allow").otherwise(default).alias("verdict"))


def op4(spark, sf_dir: str) -> DataFrame:
    """A row for each row of pages. Null URLs and those without :// have an empty host and path, no rule and the verdict allow. Of rules that fit the longest counts, and of equally long ones block. Long URLs form no more keys than others; no rows give none."""
    return judge_urls(table(spark, sf_dir, "pages").select("page_id", "url")).select("page.page_id", "host", "path", "rule", "verdict")


SQL = r"""
with u as (select page_id, case when url is null or strpos(url, '://') = 0 then '' else substr(url, strpos(url, '://') + 3) end as rest from pages),
 h as (select page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from u),
 r(verdict, rhost, rpath) as (values ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'), ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')),
 m as (select page_id, arg_max(r.rhost || r.rpath, length(r.rhost || r.rpath)) as rule, arg_max(verdict, length(r.rhost || r.rpath)) as verdict
   from h join r on (host = rhost or ends_with(host, '.' || rhost)) and starts_with(path, rpath) group by page_id)
select h.page_id, h.host, h.path, m.rule, coalesce(m.verdict, 'allow') as verdict from h left join m on h.page_id = m.page_id
"""
