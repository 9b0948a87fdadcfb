"""Operator 9: mix sources to target weights. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratacat.llm.common import sized, words


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """source, source_size -> also target.

    sizes has one row a source. Sources in code point order, null last, take the weights in turn and split share times the whole size;
    a source stops at cap times its own size and its excess goes to the others by weight, again until none is above.
    That fixed point is a water level: in the order of cap/weight, those below the level are a prefix. One window over the sources (one row each) finds it.
    A size of 0 gives target 0. cap >= share is needed, or not all can be placed; then every source stands at its cap.
    """
    alone = Window.partitionBy()
    before = Window.orderBy("__ratio", "__rank").rowsBetween(Window.unboundedPreceding, -1)
    choice = F.lit(None).cast("double")
    for i, w in enumerate(weights):
        choice = F.when(F.col("__rank") % len(weights) == i, F.lit(float(w))).otherwise(choice)
    zero = F.lit(0.0)
    s = (
        sizes.withColumn("__rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
        .withColumn("__w", choice)
        .withColumn("__cap", F.lit(float(cap)) * F.col("source_size"))
        .withColumn("__ratio", F.col("__cap") / F.col("__w"))
        .withColumn("__all", F.lit(float(share)) * F.sum("source_size").over(alone))
        .withColumn("__ws", F.sum("__w").over(alone))
        .withColumn("__cap_b", F.coalesce(F.sum("__cap").over(before), zero))
        .withColumn("__w_b", F.coalesce(F.sum("__w").over(before), zero))
        .withColumn("__full", F.col("__w") * (F.col("__all") - F.col("__cap_b")) > F.col("__cap") * (F.col("__ws") - F.col("__w_b")))
        .withColumn("__cap_f", F.sum(F.when(F.col("__full"), F.col("__cap")).otherwise(zero)).over(alone))
        .withColumn("__w_f", F.sum(F.when(F.col("__full"), F.col("__w")).otherwise(zero)).over(alone))
    )
    level = F.col("__w") * (F.col("__all") - F.col("__cap_f")) / (F.col("__ws") - F.col("__w_f"))
    return s.select("source", "source_size", F.when(F.col("__full"), F.col("__cap")).otherwise(level).alias("target"))


def _uniform(seed: int, doc_id: Column, text: Column) -> Column:
    """In [0, 1), from 52 bits of a SHA-256 of the id; rows without an id hash their text."""
    key = F.concat(F.lit(f"mix-{seed}:"), F.coalesce(doc_id.cast("string"), F.sha2(text, 256), F.lit("")))
    return F.conv(F.substring(F.sha2(key, 256), 1, 13), 16, 10).cast("double") / float(1 << 52)


def mix_plan(docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0, seed: int = 9, columns: list[str] | None = None) -> DataFrame:
    """Every row of docs, its columns (or those named) in the struct `doc`, with size, source_size, target, copies and taken = size * copies.

    Size is the number of words of the text (null: 0). copies is floor(target / source_size) plus one with the fraction as probability,
    drawn from a hash of seed and doc_id, so reruns and retries agree. Rows that repeat an id get the same draw. A source without words takes no copies.
    The texts are read twice, for the sizes of sources and for the rows. The per-source table is broadcast where its measured size allows, so that no text is shuffled;
    beyond that it is joined with Spark's skew splitting.
    """
    d = docs.select(
        F.struct(*[docs[c] for c in columns or docs.columns]).alias("doc"), docs["source"].alias("__source"), F.size(words(docs["text"])).cast("long").alias("size"), _uniform(seed, docs["doc_id"], docs["text"]).alias("__u")
    )
    sizes = docs.select(docs["source"].alias("source"), F.size(words(docs["text"])).cast("long").alias("n")).groupBy("source").agg(F.sum("n").alias("source_size"))
    t = sized(source_targets(sizes, weights, share, cap))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    return (
        d.join(t, d["__source"].eqNullSafe(t["source"]), "inner")
        .withColumn("__rate", rate)
        .withColumn("copies", F.floor("__rate") + F.when(F.col("__u") < F.col("__rate") - F.floor("__rate"), 1).otherwise(0))
        .select("doc", "size", "source_size", "target", F.col("copies").cast("long").alias("copies"), (F.col("size") * F.col("copies")).cast("long").alias("taken"))
    )


def mix(docs: DataFrame, **how) -> DataFrame:
    """The mix itself: each row of docs as often as mix_plan says; the columns of docs."""
    return mix_plan(docs, **how).where("copies > 0").withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("doc.*")


def op9(spark, sf_dir: str) -> DataFrame:
    """A row for each row of documents. Null, empty and blank texts have size 0 and take nothing. A null source is a source, the last. Rows that repeat an id draw alike; rows without one draw by their text. A source without words has target 0. No rows give none."""
    from stratacat.llm.common import table

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mix_plan(docs, columns=["doc_id"]).select("doc.doc_id", "size", "source_size", "target", "taken")


SQL = r"""
with d as (select doc_id, text, source, cast(coalesce(len(list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda w: w <> '')), 0) as bigint) as size from documents),
 s as (select source, cast(sum(size) as double) as n, row_number() over (order by source nulls last) - 1 as r from d group by source),
 w as (select *, case r % 3 when 0 then 3.0::double when 1 then 1.0::double else 2.0::double end as w, 2.0::double * n as cap from s),
 b as (select *, 1.5::double * sum(n) over () as t, sum(w) over () as ws,
   coalesce(sum(cap) over (order by cap / w, r rows between unbounded preceding and 1 preceding), 0) as cb,
   coalesce(sum(w) over (order by cap / w, r rows between unbounded preceding and 1 preceding), 0) as wb from w),
 f as (select *, w * (t - cb) > cap * (ws - wb) as full_ from b),
 g as (select *, sum(case when full_ then cap else 0 end) over () as cf, sum(case when full_ then w else 0 end) over () as wf from f),
 h as (select source, n, case when full_ then cap else w * (t - cf) / (ws - wf) end as target from g),
 x as (select d.doc_id, d.size, cast(h.n as bigint) as source_size, h.target, case when h.n > 0 then h.target / h.n else 0 end as rate,
   ('0x' || substr(sha256('mix-9:' || coalesce(cast(d.doc_id as varchar), sha256(d.text), '')), 1, 13))::bigint::double / 4503599627370496.0 as u
   from d join h on d.source is not distinct from h.source)
select doc_id, size, source_size, target, cast(size * (floor(rate) + case when u < rate - floor(rate) then 1 else 0 end) as bigint) as taken from x
"""
