"""Operators of DataFrame functions only: quality rules, decontamination, mixing."""

from __future__ import annotations

import random
import re
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from stratacat.llm import decontam, mixing, quality

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [None, "", " \t\n", "a", "a b c d e", "a b c d e a b c d e", "x " * 30, "été été été été été\n" * 4, "\n\n#*$\n#*$\n", "w" * 5000, "a\x0bb\x0cc\rd", "\U0001f600 \U0001f600 z", " a b "]


def counts(text):
    t = text or ""
    w = WORD.findall(t)
    grams = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    seen = {i + k for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for k in range(5)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(seen)


def docs(spark, texts, sources=("s",)):
    return spark.createDataFrame([(i, t, "en", sources[i % len(sources)], len(t or "")) for i, t in enumerate(texts)], DOCS)


def test_counts_equal_brute_force(spark):
    rng = random.Random(1)
    texts = ODD + [" ".join(rng.choice("abc") + rng.choice(["", "\n", "#"]) for _ in range(rng.randrange(60))) for _ in range(150)]
    got = quality.measure(docs(spark, texts)).select("doc_id", *[f"q.{c}" for c in quality.COUNTS]).collect()
    assert {r[0]: tuple(r[1:]) for r in got} == dict(enumerate(map(counts, texts)))


def prose(rng, n):
    return " ".join("".join(rng.choice("etaoinshr") for _ in range(max(1, round(rng.gauss(5, 2))))) for _ in range(n))


def test_outliers_go_and_clean_rows_stay(spark):
    rng = random.Random(2)
    clean = [prose(rng, rng.randrange(12, 900)) for _ in range(400)]
    junk = [prose(rng, 200).replace(" ", " ##%% ") for _ in range(60)] + ["|".join(prose(rng, 2) for _ in range(3)) + " " + prose(rng, 40).upper().replace(" ", "&& ") for _ in range(40)]
    d = docs(spark, clean + junk)
    m = quality.measure(d)
    kept = {r.doc_id for r in quality.judged(m, quality.estimates(m)).where("kept").collect()}
    assert kept >= set(range(400)) and len(kept) <= 404


def test_groups_pool_and_nulls_are_groups(spark):
    rng = random.Random(4)
    rows = [(i, prose(rng, 60), None if i % 3 == 0 else "de", None if i % 2 else f"s{i % 40}", 0) for i in range(900)]
    m = quality.measure(spark.createDataFrame(rows, DOCS))
    est = quality.estimates(m)
    assert est.where("m0 is not null").count() == est.count() == m.select("lang", "source").distinct().count()
    few = quality.estimates(m.limit(20))
    assert quality.judged(m.limit(20), few).where("kept and d2 is null").count() == 20


def test_quality_edges(spark):
    d = docs(spark, ODD).withColumn("q", F.lit("mine")).withColumn("m0", F.lit(1)).withColumn("kept", F.lit(0))
    out = quality.keep_good(d)
    assert out.columns == d.columns and out.count() == 0
    assert quality.keep_good(docs(spark, []).limit(0)).count() == 0


ITEM = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def test_leaks(spark):
    rng = random.Random(5)
    noise = lambda n: [rng.choice("abcdefgh") * rng.randrange(1, 5) for _ in range(n)]
    swap = lambda k: [w if i % k else "zz" for i, w in enumerate(ITEM, 1)]
    texts = [noise(40) + ITEM + noise(9), noise(5) + swap(4) + noise(5), swap(6), [w.upper() + "," for w in ITEM], ITEM[:13], ITEM[:8] + noise(30), noise(80), ITEM[::-1], noise(3) + ITEM + ITEM]
    items = spark.createDataFrame([(1, " ".join(ITEM)), (2, "too short an item"), (3, None), (4, "")], "item_id long, text string")
    d = docs(spark, [" ".join(t) for t in texts] + ODD)
    got = {r.k1: (r.item_id, r.begin, r.n_matched) for r in decontam.leaks(d, items).collect()}
    assert {k for k in got} == {0, 1, 2, 3, 4, 8}
    assert got[0] == (1, 40, 20) and got[1] == (1, 5, 15) and got[4] == (1, 0, 13) and got[8] == (1, 3, 20)
    clean = decontam.decontaminate(d.withColumn("k1", F.lit("mine")), items)
    assert {r.doc_id for r in clean.collect()} == set(range(len(texts) + len(ODD))) - set(got) and "k1" in clean.columns
    assert decontam.leaks(d, items.limit(0)).count() == 0 and decontam.leaks(d.limit(0), items).count() == 0


def test_leaks_without_ids(spark):
    d = spark.createDataFrame([(None, " ".join(ITEM)), (None, "clean words only here now yes"), (7, " ".join(ITEM)), (7, "other text of the same id")], "doc_id long, text string")
    items = spark.createDataFrame([(1, " ".join(ITEM))], "item_id long, text string")
    assert {r.text for r in decontam.decontaminate(d, items).collect()} == {"clean words only here now yes", "other text of the same id"}


def water(sizes, weights=(3, 1, 2), share=1.5, cap=2.0):
    w = {s: weights[i % len(weights)] for i, s in enumerate(sizes)}
    left, fixed, open_ = share * sum(sizes.values()), {}, set(sizes)
    while open_:
        total = sum(w[s] for s in open_)
        over = {s for s in open_ if left * w[s] / total > cap * sizes[s]}
        if not over:
            return fixed | {s: left * w[s] / total for s in open_}
        for s in over:
            fixed[s] = cap * sizes[s]
        left -= sum(fixed[s] for s in over)
        open_ -= over
    return fixed


def test_targets_equal_the_rounds(spark):
    rng = random.Random(6)
    for n in (1, 2, 7, 40):
        sizes = {f"{i:03d}": rng.choice([0, 1, 10, 1000, 10**6]) + rng.randrange(50) for i in range(n)}
        df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
        got = {r.source: r.target for r in mixing.source_targets(df).collect()}
        assert got == pytest.approx(water(sizes))


def test_mix(spark):
    rng = random.Random(7)
    texts = [" ".join("w" * rng.randrange(1, 40)) for _ in range(1500)] + ODD
    d = docs(spark, texts, ("b", "a", None, "a", "a")).withColumn("copies", F.lit("mine"))
    plan = mixing.mix_plan(d).select("doc.*", "size", "source_size", "target", F.col("taken"))
    rows = plan.collect()
    assert len(rows) == len(texts) and all(r.taken <= 2 * r["size"] for r in rows)
    by = {}
    for r in rows:
        by.setdefault(r.source, [0, r.target])[0] += r.taken
    assert all(abs(t - want) < 0.1 * want for t, want in by.values())
    assert {(r.doc_id, r.taken) for r in rows} == {(r.doc_id, r.taken) for r in mixing.mix_plan(d.repartition(3)).select("doc.doc_id", "taken").collect()}
    out = mixing.mix(d)
    assert out.columns == d.columns and sum(r[0] for r in out.select(F.size(F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != ""))).collect() if (r[0] or 0) > 0) == sum(r.taken for r in rows)
    assert mixing.mix(d.limit(0)).count() == 0
    assert mixing.mix(docs(spark, [None, ""])).count() == 0


def test_leaks_equal_every_alignment_without_seeds(spark):
    rng = random.Random(19)
    word = lambda: f"w{rng.randrange(10**6)}"
    items, texts = [], []
    for n in range(1, 15):
        for _ in range(6):
            b = [word() for _ in range(n)]
            t = list(b)
            for i in rng.sample(range(n), min(n, 13) - -(-3 * min(n, 13) // 4)):
                t[i] = word()
            items.append(b)
            texts += [[word() for _ in range(5)] + t + [word() for _ in range(4)], t, t[1:]]
    want = set()
    for k, b in enumerate(items):
        n = min(13, len(b))
        for i, d in enumerate(texts):
            for g in range(1 - len(b), len(d)) if set(b) & set(d) else ():
                same = [0 <= g + j < len(d) and d[g + j] == x for j, x in enumerate(b)]
                if max(sum(same[s : s + n]) for s in range(len(b) - n + 1)) >= 0.75 * n:
                    want.add((i, k))
    found = decontam.leaks(docs(spark, [" ".join(t) for t in texts]), spark.createDataFrame([(k, " ".join(b)) for k, b in enumerate(items)], "item_id int, text string"))
    assert {(r.k1, r.item_id) for r in found.collect()} == want and len(want) >= 2 * len(items)


@pytest.mark.parametrize("name", ["op4_url_cascade", "op7_spaced_seed_leaks", "op8_chat_round_trip", "op9_mix_sources"])
def test_equals_oracle(spark, name):
    from stratacat.llm.queries import ORACLES, QUERIES

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "conversations"):
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    df, rel = QUERIES[name](spark, sf), con.sql(ORACLES[name])
    order = lambda cols, data: sorted((tuple(r[cols.index(c)] for c in sorted(cols)) for r in data), key=repr)
    assert order(df.columns, df.collect()) == order(rel.columns, rel.fetchall())
