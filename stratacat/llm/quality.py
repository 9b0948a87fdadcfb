"""Operator 1: quality rules and robust multivariate outliers. DataFrame functions only."""

from __future__ import annotations

from math import exp, lgamma, log

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratacat.llm.common import cut, let, sized, table, words

WINDOW = 5
SYMBOLS = "[#*$%&|<>]"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: The transformed statistics, each with the standard deviation that stands in the covariance at least: differences below it never look like outliers.
FEATURES = (("x_length", 0.05), ("x_symbols", 0.6), ("x_lines", 0.6), ("x_repeats", 0.12))
P = len(FEATURES)


def repeat_words(w: Column) -> Column:
    """Words of the array w in a 5-word window found twice or more, each word once. Windows are compared by the XXH64 of their words' XXH64."""

    def covered(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        twins = let(pairs, lambda s: F.filter(s, lambda e, k: F.coalesce(F.get(s, k - 1)["h"] == e["h"], F.lit(False)) | F.coalesce(F.get(s, k + 1)["h"] == e["h"], F.lit(False))))
        at = F.sort_array(F.transform(twins, lambda e: e["i"]))
        return let(at, lambda p: F.aggregate(F.transform(p, lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get(p, k + 1) - x, F.lit(WINDOW)))), F.lit(0), lambda a, b: a + b))

    each = lambda x: F.transform(F.sequence(F.lit(0), F.size(x) - WINDOW), lambda i: F.xxhash64(*[F.get(x, i + k) for k in range(WINDOW)]))
    windows = let(F.transform(w, lambda x: F.xxhash64(x)), each)
    return F.when(F.size(w) > WINDOW, let(windows, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), covered(h)).otherwise(0))).otherwise(0)


def measure(docs: DataFrame) -> DataFrame:
    """docs with the column `q`: the counts, base_failed and the transformed statistics. A null text has no words."""
    text = F.coalesce(docs["text"], F.lit(""))
    lines = let(F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")), lambda x: F.size(x) - F.size(F.array_distinct(x)))
    of_words = let(words(docs["text"]), lambda w: F.struct(F.size(w).alias("n"), F.length(F.array_join(w, "")).alias("c"), repeat_words(w).alias("r")))
    d = docs.withColumn("__w", of_words).withColumn(
        "q",
        F.struct(
            F.col("__w.n").cast("long").alias("n_words"),
            F.col("__w.c").cast("long").alias("word_chars"),
            (F.length(text) - F.length(F.regexp_replace(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
            lines.cast("long").alias("n_dup_lines"),
            F.col("__w.r").cast("long").alias("n_repeat_words"),
        ),
    )
    n, chars, symbols, dup, rep = (F.col(f"q.{c}") for c in COUNTS)
    # Short texts vary more; 50 words of 5 letters are added to each, so that a mean of few words counts little.
    x = (F.log((chars + 250) / (n + 50)), F.log1p(1000 * symbols / (chars + 250)), F.log1p(500 * dup / (n + 50)), F.sqrt(rep / (n + 50)))
    failed = (n < 10) | (100 * rep > 20 * n)
    return d.withColumn("q", F.struct(*[F.col(f"q.{c}").alias(c) for c in COUNTS], failed.alias("base_failed"), *[v.alias(k) for v, (k, _) in zip(x, FEATURES, strict=True)])).drop("__w")


def chi2_cdf(x: float, k: int) -> float:
    """Of the chi-square distribution with k degrees of freedom, by the series of the lower incomplete gamma function."""
    if x <= 0:
        return 0.0
    a, y = k / 2, x / 2
    term = total = 1 / a
    i = 1
    while term > total * 1e-16:
        term *= y / (a + i)
        total += term
        i += 1
    return min(1.0, total * exp(a * log(y) - y - lgamma(a)))


def chi2_quantile(p: float, k: int) -> float:
    lo, hi = 0.0, 1000.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi2_cdf(mid, k) < p else (lo, mid)
    return hi


def _consistent(share: float) -> float:
    """By what the covariance of the share of a normal sample that lies nearest the centre falls short."""
    return share / chi2_cdf(chi2_quantile(share, P), P + 2)


PAIRS = [(i, j) for i in range(P) for j in range(i + 1)]
EST = [*[f"m{i}" for i in range(P)], *[f"l{i}{j}" for i, j in PAIRS]]


def _cholesky(df: DataFrame) -> DataFrame:
    """Columns s{i}{j}, a positive definite matrix, become l{i}{j}, its lower triangular root."""
    for i, j in PAIRS:
        rest = F.col(f"s{i}{j}") - sum((F.col(f"l{i}{k}") * F.col(f"l{j}{k}") for k in range(j)), F.lit(0.0))
        df = df.withColumn(f"l{i}{j}", F.sqrt(rest) if i == j else rest / F.col(f"l{j}{j}"))
    return df


def squared_distance(df: DataFrame, x: list[Column], name: str) -> DataFrame:
    """df with the column name: the squared Mahalanobis distance of x by the columns EST."""
    for i in range(P):
        rest = x[i] - F.col(f"m{i}") - sum((F.col(f"l{i}{k}") * F.col(f"__y{k}") for k in range(i)), F.lit(0.0))
        df = df.withColumn(f"__y{i}", rest / F.col(f"l{i}{i}"))
    return df.withColumn(name, sum((F.col(f"__y{i}") ** 2 for i in range(1, P)), F.col("__y0") ** 2)).drop(*[f"__y{i}" for i in range(P)])


def _fit(binned: DataFrame, keys: list[str], widen: float) -> DataFrame:
    """Mean and root of the covariance by keys, from partial sums; widen: the consistency factor."""
    sums = binned.groupBy(*keys).agg(F.sum("n").alias("n"), *[F.sum(f"a{i}").alias(f"a{i}") for i in range(P)], *[F.sum(f"b{i}{j}").alias(f"b{i}{j}") for i, j in PAIRS])
    s = sums.select(*keys, "n", *[(F.col(f"a{i}") / F.col("n")).alias(f"m{i}") for i in range(P)], *[F.col(f"b{i}{j}") for i, j in PAIRS])
    cov = lambda i, j: widen * (F.col(f"b{i}{j}") / F.col("n") - F.col(f"m{i}") * F.col(f"m{j}"))
    floor = [F.lit(f * f) for _, f in FEATURES]
    s = s.select("*", *[(F.greatest(cov(i, i), F.lit(0.0)) + floor[i] if i == j else cov(i, j)).alias(f"s{i}{j}") for i, j in PAIRS])
    return _cholesky(s).select(*keys, *EST)


def _binned(rows: DataFrame, est: DataFrame, keys: list[str]) -> DataFrame:
    """Partial sums of the rows of each key by bins of a 32nd in the logarithm of the squared distance: as many rows as keys and bins, combined before the shuffle. est: rows by group, and start if keys has it."""
    d = squared_distance(rows.join(est, "group"), [F.col(f"x{i}") for i in range(P)], "d2")
    at = F.greatest(F.lit(-640), F.least(F.lit(640), F.floor(F.log(F.col("d2") + 1e-9) * 32))).cast("int")
    return (
        d.withColumn("bin", at)
        .groupBy(*keys, "bin")
        .agg(F.count("*").alias("n"), *[F.sum(f"x{i}").alias(f"a{i}") for i in range(P)], *[F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"b{i}{j}") for i, j in PAIRS])
    )


def groups(measured: DataFrame, least: int) -> DataFrame:
    """lang, source, group (whose estimate judges the pair's rows) and feeds (the groups that its rows estimate), one row a pair of lang and source.

    A pair with least or more rows that pass the base rules is a group of its own; a smaller one takes the estimate of its whole language, or of all rows where the language has
    fewer than least too. A table with fewer than least such rows in all has no group.
    """
    text = lambda c: F.coalesce(F.concat(F.length(c).cast("string"), F.lit(":"), F.col(c)), F.lit("-"))
    pairs = cut(measured.groupBy("lang", "source").agg(F.count_if(~F.col("q.base_failed")).alias("n")))
    langs = pairs.groupBy(F.col("lang").alias("__l")).agg(F.sum("n").alias("of_lang"), F.count_if(F.col("n") < least).alias("small"))
    of_all, lost = langs.agg(F.coalesce(F.sum("of_lang"), F.lit(0)), F.count_if((F.col("small") > 0) & (F.col("of_lang") < least))).first()
    d = pairs.join(langs, pairs["lang"].eqNullSafe(langs["__l"])).drop("__l")
    own, lang, everything = F.concat(F.lit("2"), text("lang"), text("source")), F.concat(F.lit("1"), text("lang")), F.lit("0")
    group = F.when(F.col("n") >= least, own).when(F.col("of_lang") >= least, lang).when(F.lit(of_all >= least), everything)
    feeds = F.array(F.when(F.col("n") >= least, own), F.when((F.col("small") > 0) & (F.col("of_lang") >= least), lang), F.when(F.lit(lost > 0 and of_all >= least), everything))
    return sized(d.select("lang", "source", group.alias("group"), F.filter(feeds, lambda g: g.isNotNull()).alias("feeds")))


def estimates(measured: DataFrame, least: int = 100, most_steps: int = 12, half: float = 0.5) -> DataFrame:
    """lang, source -> EST: minimum-covariance-determinant centre and covariance root of the statistics of the rows that pass the base rules, by the groups of `groups`.

    measured: lang, source, q. Two starts, one from medians and quartiles and one from mean and covariance, take concentration steps until no group's determinant changes by
    a thousandth of itself, most_steps at most: the half of the rows nearest by the current estimate gives the next. The start that ends with the smaller determinant
    stays and is reweighted with the rows inside the 97.5 % ellipsoid. Each step is one pass over the statistics with partial sums by key and distance bin, combined before the
    shuffle; the estimates, one row a group and start, are broadcast where their measured size allows and joined with Spark's skew splitting beyond it.
    """
    ok = measured.where(~F.col("q.base_failed")).select("lang", "source", *[F.col(f"q.{c}").alias(f"x{i}") for i, (c, _) in enumerate(FEATURES)])
    pairs = groups(measured, least)
    p = pairs.select(F.col("lang").alias("__l"), F.col("source").alias("__s"), "feeds")
    rows = ok.join(p, ok["lang"].eqNullSafe(p["__l"]) & ok["source"].eqNullSafe(p["__s"])).select(F.explode("feeds").alias("group"), *[f"x{i}" for i in range(P)])

    quart = rows.groupBy("group").agg(*[F.percentile(F.round(f"x{i}", 3), [0.25, 0.5, 0.75]).alias(f"q{i}") for i in range(P)])
    first = _cholesky(
        quart.select("group", F.lit(0).alias("start"), *[F.col(f"q{i}")[1].alias(f"m{i}") for i in range(P)], *[(((F.col(f"q{i}")[2] - F.col(f"q{i}")[0]) / 1.349) ** 2 + FEATURES[i][1] ** 2 if i == j else F.lit(0.0)).alias(f"s{i}{j}") for i, j in PAIRS])
    ).select("group", "start", *EST)
    whole = rows.groupBy("group").agg(F.count("*").alias("n"), *[F.sum(f"x{i}").alias(f"a{i}") for i in range(P)], *[F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"b{i}{j}") for i, j in PAIRS])
    est = sized(first.unionByName(_fit(whole.withColumn("start", F.lit(1)), ["group", "start"], 1.0)))
    keys = ["group", "start"]
    inner = Window.partitionBy(*keys).orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    det = sum((F.log(f"l{i}{i}") for i in range(1, P)), F.log("l00"))
    for _ in range(most_steps):
        b = _binned(rows, est, keys).withColumn("below", F.coalesce(F.sum("n").over(inner), F.lit(0))).withColumn("all", F.sum("n").over(Window.partitionBy(*keys)))
        was, est = est, sized(_fit(b.where(F.col("below") < half * F.col("all")), keys, _consistent(half)))
        moved = est.select(*keys, det.alias("now")).join(was.select(*keys, det.alias("before")), keys).where("abs(now - before) > 0.001")
        if not moved.take(1):
            break
    best = sized(est.groupBy("group").agg(F.min_by(F.struct("start", *EST), F.struct(F.round(det, 9), "start")).alias("e")).select("group", "e.*").drop("start"))
    inside = F.col("bin") < F.lit(int(32 * log(chi2_quantile(0.975, P))))
    final = _fit(_binned(rows, best, ["group"]).where(inside), ["group"], _consistent(0.975))
    return sized(pairs.join(sized(final), "group", "left").select("lang", "source", *EST))


def judged(measured: DataFrame, est: DataFrame, tail: float = 1e-6) -> DataFrame:
    """measured with d2, the squared distance, and kept: passes the base rules and lies inside the ellipsoid that a normal vector leaves with probability tail.

    A row of a group without an estimate is kept if it passes the base rules; its d2 is null. Estimates have one row a pair of lang and source:
    broadcast where their measured size allows, and else joined with Spark's skew splitting.
    """
    e = est.withColumnRenamed("lang", "__l").withColumnRenamed("source", "__s")
    d = measured.join(e, measured["lang"].eqNullSafe(e["__l"]) & measured["source"].eqNullSafe(e["__s"]), "left").drop("__l", "__s")
    d = squared_distance(d, [F.col(f"q.{c}") for c, _ in FEATURES], "d2").drop(*EST)
    return d.withColumn("kept", ~F.col("q.base_failed") & (F.col("d2").isNull() | (F.col("d2") <= chi2_quantile(1 - tail, P))))


def keep_good(docs: DataFrame, **how) -> DataFrame:
    """The rows of docs that are kept, with their columns. Each text is measured once: the rows are stored in the shared folder with their statistics until they are judged; no text is shuffled.

    They are cut before any filter, which Spark would push below the statistics and so compute them twice.
    """
    d = docs.select("lang", "source", "text", F.struct(*[docs[c] for c in docs.columns]).alias("doc"))
    m = cut(measure(d).select("lang", "source", "q", "doc"))
    return judged(m, estimates(m, **how)).where("kept").select("doc.*")


def op1(spark, sf_dir: str) -> DataFrame:
    """A row for each row of documents, with its counts, base_failed, kept and d2.

    Null, empty and blank texts have no words and fail the base rules. Null languages and sources are values like others. Repeated rows count and are judged each; texts are taken whole, whatever their length;
    a table without rows gives none, and columns that aren't needed aren't read. Where no group has enough rows, d2 is null and the base rules alone decide.
    """
    m = cut(measure(table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text")).drop("text"))
    return judged(m, estimates(m)).select("doc_id", *[F.col(f"q.{c}").alias(c) for c in COUNTS], F.col("q.base_failed").alias("base_failed"), "kept", F.round("d2", 6).alias("d2"))
