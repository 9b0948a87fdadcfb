"""Operator 7: benchmark passages in training texts, by spaced seeds. DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence
from functools import cache, reduce
from itertools import combinations
from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratacat.llm.common import let, sized, table


@cache
def masks(window: int, need: int, most: int = 3) -> tuple[tuple[int, ...], ...]:
    """Offsets of the tokens that seeds compare, so that wherever need of window tokens in a row are equal, some mask lies on equal ones only.

    At most `most` masks of the greatest weight for which a greedy choice covers every placement of the unequal tokens; wide windows take the run that always stays whole.
    """
    odd = window - need
    if window > 16:
        return (tuple(range(window // (odd + 1))),)
    places = [sum(1 << i for i in c) for c in combinations(range(window), odd)]
    for weight in range(need, 0, -1):
        options = [(0, *c) for c in combinations(range(1, window), weight - 1)]
        bits = [sum(1 << i for i in m) for m in options]
        hit = [sum(1 << n for n, p in enumerate(places) if any(not p & b << s for s in range(window - m[-1]))) for m, b in zip(options, bits, strict=True)]
        left, out = (1 << len(places)) - 1, []
        while left and len(out) < most:
            best = max(range(len(options)), key=lambda i: ((hit[i] & left).bit_count(), -options[i][-1]))
            left &= ~hit[best]
            out.append(options[best])
        if not left:
            return tuple(out)
    raise ValueError("need is at least 1")


def tokens(text: Column) -> Column:
    """XXH64 of each lower-cased run of letters, marks and digits."""
    runs = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{M}\p{N}]+"), lambda w: w != "")
    return F.transform(runs, lambda w: F.xxhash64(w))


def _seeds(df: DataFrame, keep: list[str], tokens_of: str, seeds: Sequence[tuple[int, ...]]) -> DataFrame:
    """keep, at, seed: each mask's hash at each token where it fits. The mask is hashed too."""
    n = F.size(tokens_of)
    used = sorted({k for m in seeds for k in m})
    shifted = [F.slice(tokens_of, F.lit(k + 1), F.greatest(n - k, F.lit(0))).alias(f"t{k}") for k in used]
    rows = df.where(n > min(max(m) for m in seeds)).select(*keep, F.posexplode(F.arrays_zip(*shifted)).alias("at", "t"))
    each = [F.when(F.col(f"t.t{max(m)}").isNotNull(), F.xxhash64(F.lit(str(m)), *[F.col(f"t.t{k}") for k in m])) for m in seeds]
    return rows.select(*keep, "at", F.explode(F.array(*each)).alias("seed")).where("seed is not null")


def leaks(docs: DataFrame, items: DataFrame, window: int = 13, share: float = 0.75) -> DataFrame:
    """Pairs of a row of docs and an item that overlap: k1, k2 (the row's doc_id and text hash), item_id, begin, n_matched, n_tokens.

    Hits of equal seeds put an item beside a text; along that alignment each token of the item is compared, and the pair stays if some min(window, item's tokens)
    tokens in a row have at least the share (rounded up) equal. begin: the token of the text at which the item's first would stand, of the alignment with most matches, first of equals.
    An item's seeds are those of its window, chosen so that no pair that meets the share is without a hit, down to items of one token; texts take the seeds of all windows that occur.
    Null texts have no tokens. Rows without an id are told apart by their text's hash.
    The items' seeds and the found alignments are broadcast where their measured size allows; texts are never shuffled then. Beyond it Spark joins by hash.
    """
    b = sized(items.select(items["item_id"].alias("item_id"), tokens(items["text"]).alias("b")).where(F.size("b") > 0))
    w = F.least(F.lit(window), F.size("b"))
    by_window = {r[0]: masks(r[0], max(1, ceil(share * r[0]))) for r in b.select(w).distinct().collect()} or {window: masks(window, max(1, ceil(share * window)))}
    each = [_seeds(b.where(w == n), ["item_id"], "b", m) for n, m in sorted(by_window.items())]
    b_seeds = sized(reduce(DataFrame.union, each).withColumnRenamed("at", "b_at").distinct())
    k1, k2 = F.coalesce(docs["doc_id"].cast("long"), F.lit(-(1 << 63))), F.xxhash64(docs["text"])
    d = docs.select(k1.alias("k1"), k2.alias("k2"), docs["text"].alias("text"))
    hits = _seeds(d.select("k1", "k2", tokens(F.col("text")).alias("d")), ["k1", "k2"], "d", sorted(set().union(*by_window.values()))).join(b_seeds, "seed")
    beside = sized(hits.select("k1", "k2", "item_id", (F.col("at") - F.col("b_at")).alias("begin")).distinct())
    pairs = d.join(beside, ["k1", "k2"]).join(b, "item_id").select("k1", "k2", "item_id", "begin", "b", "text")
    same = lambda d: F.transform("b", lambda x, j: F.when((F.col("begin") + j >= 0) & F.coalesce(F.get(d, F.greatest(F.col("begin") + j, F.lit(0))) == x, F.lit(False)), 1).otherwise(0))
    most = let(let(tokens(F.col("text")), same), lambda s: F.struct(F.aggregate(s, F.lit(0), lambda a, x: a + x).alias("all"), F.array_max(F.transform(F.sequence(F.lit(1), F.size(s) - w + 1), lambda i: F.aggregate(F.slice(s, i, w), F.lit(0), lambda a, x: a + x))).alias("run")))
    found = pairs.select("k1", "k2", "item_id", "begin", F.size("b").alias("n_tokens"), w.alias("w"), most.alias("m")).where(F.col("m.run") >= F.ceil(share * F.col("w")))
    best = F.max_by(F.struct("begin", F.col("m.all").alias("n_matched"), "n_tokens"), F.struct(F.col("m.all"), -F.col("begin")))
    return found.groupBy("k1", "k2", "item_id").agg(best.alias("x")).select("k1", "k2", "item_id", "x.*")


def decontaminate(docs: DataFrame, items: DataFrame, **how) -> DataFrame:
    """The rows of docs without a leak, with their columns."""
    bad = sized(leaks(docs, items, **how).select(F.col("k1").alias("__k1"), F.col("k2").alias("__k2")).distinct())
    k1, k2 = F.coalesce(docs["doc_id"].cast("long"), F.lit(-(1 << 63))), F.xxhash64(docs["text"])
    return docs.join(bad, (k1 == bad["__k1"]) & (k2 == bad["__k2"]), "left_anti")


def op7(spark, sf_dir: str) -> DataFrame:
    """The leaks: one row a document and benchmark item; documents without any are clean. Of several alignments the one with most equal tokens counts, of equal ones the first; rows that repeat a doc_id give one row, the best. Null and empty texts and items have no tokens, and no leaks."""
    found = leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    k1 = F.when(F.col("k1") != -(1 << 63), F.col("k1"))
    one = found.groupBy(k1.alias("doc_id"), "item_id").agg(F.max(F.struct("n_matched", -F.col("begin"), "n_tokens")).alias("x"))
    return one.select("doc_id", "item_id", (-F.col("x.col2")).cast("long").alias("begin"), F.col("x.n_matched").cast("long").alias("n_matched"), F.col("x.n_tokens").cast("long").alias("n_tokens"))


#: Without seeds: every alignment of an item beside a text in which enough tokens are equal.
SQL = r"""
with dt as (select doc_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{M}\p{N}]+'), lambda w: w <> '') as d, row_number() over () as r from documents),
 bt as (select item_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{M}\p{N}]+'), lambda w: w <> '') as b from benchmark),
 dp as (select r, unnest(d) as t, unnest(range(1, len(d) + 1)) as p from dt), bp as (select item_id, len(b) as n, unnest(b) as t, unnest(range(1, len(b) + 1)) as p from bt),
 h as (select r, item_id, dp.p - bp.p as g from dp join bp using (t) group by r, item_id, g having count(*) >= 0.75 * least(13, min(n))),
 v as (select doc_id, item_id, g, b, least(13, len(b)) as w, list_transform(range(1, len(b) + 1), lambda j: case when g + j >= 1 and d[g + j] = b[j] then 1 else 0 end) as m from h join dt using (r) join bt using (item_id)),
 f as (select doc_id, item_id, g, len(b) as n_tokens, list_sum(m) as n_matched from v where list_max(list_transform(range(1, len(b) - w + 2), lambda i: list_sum(m[i:i + w - 1]))) >= ceil(0.75 * w))
select doc_id, item_id, cast(arg_max(g, n_matched * 1000000000::bigint - g) as bigint) as begin, cast(max(n_matched) as bigint) as n_matched, cast(max(n_tokens) as bigint) as n_tokens from f group by doc_id, item_id
"""
