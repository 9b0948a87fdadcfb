"""The pipeline's stages, one after the other, against plain Python on the smallest documents."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter
from math import floor, log

import numpy as np
import pandas as pd
import pytest

import corpus_pipeline
from stratacat.llm import pii, quality

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def statistics(text):
    t = text or ""
    w = WORD.findall(t)
    grams = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    rep = len({i + k for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for k in range(5)})
    lines = [x for x in t.split("\n") if WORD.search(x)]
    n, chars, symbols, dup = len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines))
    failed = n < 10 or 100 * rep > 20 * n
    return failed, [log((chars + 250) / (n + 50)), np.log1p(1000 * symbols / (chars + 250)), np.log1p(500 * dup / (n + 50)), (rep / (n + 50)) ** 0.5]


def keep_good(df, least=100):
    stats = [statistics(t) for t in df.text]
    ok = np.array([not f for f, _ in stats])
    x = np.array([v for _, v in stats])
    key = list(zip(df.lang, df.source, strict=True))
    n = Counter(k for k, o in zip(key, ok, strict=True) if o)
    of_lang = Counter()
    for k in set(key):
        of_lang[k[0]] += n[k]
    group = [k if n[k] >= least else (k[0],) if of_lang[k[0]] >= least else () for k in key]
    floors = np.diag([f * f for _, f in quality.FEATURES])
    kept = ok.copy()
    for g in set(group):
        here = np.array([y == g for y in group])
        rows = x[np.array([k[: len(g)] == g for k in key]) & ok]
        if len(rows) < least:
            continue

        def fit(r, widen, floors=floors):
            c = np.cov(r.T, bias=True) * widen
            return r.mean(axis=0), c + floors

        def d2(mc, r):
            y = np.linalg.solve(np.linalg.cholesky(mc[1]), (r - mc[0]).T)
            return (y**2).sum(axis=0)

        bins = lambda d: np.clip(np.floor(np.log(d + 1e-9) * 32), -640, 640).astype(int)
        det = lambda e: float(np.log(np.diag(np.linalg.cholesky(e[1]))).sum())
        q = np.percentile(np.round(rows, 3), [25, 50, 75], axis=0)
        ends = []
        for e in ((q[1], np.diag(((q[2] - q[0]) / 1.349) ** 2) + floors), fit(rows, 1.0)):
            for _ in range(20):
                b = bins(d2(e, rows))
                counts = np.bincount(b + 640, minlength=1281)
                below = np.cumsum(counts) - counts
                e = fit(rows[below[b + 640] < 0.5 * len(rows)], quality._consistent(0.5))
            ends.append(e)
        best = min(ends, key=lambda e: round(det(e), 9))
        inside = bins(d2(best, rows)) < int(32 * log(quality.chi2_quantile(0.975, 4)))
        final = fit(rows[inside], quality._consistent(0.975))
        kept[here] &= d2(final, x[here]) <= quality.chi2_quantile(1 - 1e-6, 4)
    return df[kept]


def keep_one(df):
    """One row of each group that pairs of texts at 0.8 or more over 5-word shingles join: the smallest doc_id. All pairs that share a shingle are compared."""
    least = {}
    for d, t in sorted(zip(df.doc_id, df.text, strict=True)):
        least.setdefault(t, d)
    ws = {t: [x.lower() for x in WORD.findall(t)] for t in least}
    sets = {t: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for t, w in ws.items() if w}
    root = {t: t for t in least}

    def find(t):
        while root[t] != t:
            t = root[t]
        return t

    having = {}
    for t, s in sets.items():
        for u, n in Counter(u for g in s for u in having.get(g, ())).items():
            if n >= 0.8 * (len(s) + len(sets[u]) - n):
                a, b = sorted((find(t), find(u)), key=least.get)
                root[b] = a
        for g in s:
            having.setdefault(g, []).append(t)
    return df[[find(t) == t and least[t] == d for d, t in zip(df.doc_id, df.text, strict=True)]]


def tokens(text):
    return [w for w in re.split(r"[\W_]+", text.lower()) if w]


def decontaminate(df, items):
    """Every alignment of an item beside a text that shares a token with it."""
    items = [tokens(t) for t in items]

    def leaks(text):
        d = tokens(text)
        at = {}
        for i, w in enumerate(d):
            at.setdefault(w, []).append(i)
        for b in items:
            n = min(13, len(b))
            for g, hits in Counter(i - j for j, w in enumerate(b) for i in at.get(w, ())).items():
                if hits >= 0.75 * n:
                    same = [0 <= g + j < len(d) and d[g + j] == w for j, w in enumerate(b)]
                    if max(sum(same[s : s + n]) for s in range(len(b) - n + 1)) >= 0.75 * n:
                        return True
        return False

    return df[[not leaks(t) for t in df.text]]


def mix(df):
    size = {i: len(WORD.findall(t)) for i, t in zip(df.doc_id, df.text, strict=True)}
    by = Counter()
    for i, s in zip(df.doc_id, df.source, strict=True):
        by[s] += size[i]
    sources = sorted(by)
    w = {s: (3, 1, 2)[k % 3] for k, s in enumerate(sources)}
    target, open_, left = {}, set(sources), 1.5 * sum(by.values())
    while open_:
        total = sum(w[s] for s in open_)
        over = {s for s in open_ if left * w[s] / total > 2 * by[s]}
        if not over:
            target |= {s: left * w[s] / total for s in open_}
            break
        target |= {s: 2.0 * by[s] for s in over}
        left -= sum(target[s] for s in over)
        open_ -= over
    out = []
    for i, t, s in zip(df.doc_id, df.text, df.source, strict=True):
        rate = target[s] / by[s] if by[s] else 0
        u = int(hashlib.sha256(f"mix-9:{i}".encode()).hexdigest()[:13], 16) / 2**52
        out += [(i, t)] * (floor(rate) + (u < rate - floor(rate)))
    return sorted(out)


@pytest.fixture(scope="module")
def plain():
    df = pd.read_parquet(f"{SF}/documents.parquet")
    out = {"quality": (df := keep_good(df)), "near_duplicates": (df := keep_one(df)), "decontaminate": (df := decontaminate(df, pd.read_parquet(f"{SF}/benchmark.parquet").text))}
    out["pii"] = df = df.assign(text=[pii.masked(t, pii.scored(t)) for t in df.text])
    return out | {"mix": mix(df)}


def test_stages_equal_brute_force(spark, plain):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        docs = spark.createDataFrame(stage(spark, docs, SF).toPandas(), docs.schema)
        assert docs.columns == columns
        got = sorted((r.doc_id, r.text) for r in docs.select("doc_id", "text").collect())
        want = plain[name] if name == "mix" else sorted(zip(plain[name].doc_id, plain[name].text, strict=True))
        assert got == want, name


def test_pairs_with_enough_rows_have_their_own_estimate(spark):
    df = pd.read_parquet("/root/testdata/sf0.01/documents.parquet")
    want = keep_good(df, 20)
    assert set(df.groupby(["lang", "source"]).size()[lambda n: n >= 20].index.get_level_values(0)) == {"en"}
    got = quality.keep_good(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), least=20)
    assert {r.doc_id for r in got.select("doc_id").collect()} == set(want.doc_id)


def test_odd_rows_pass_all_stages(spark):
    """Null ids, texts and sources, repeated rows, an empty and a very long text, and extra columns with names of the operators' own."""
    rng = random.Random(3)
    prose = lambda n: " ".join("".join(rng.choice("etaoinshr") for _ in range(rng.randrange(2, 9))) for _ in range(n))
    rows = [(i if i % 7 else None, prose(40 + i % 50), "en", f"s{i % 3}" if i % 5 else None, 0, "mine", 1) for i in range(150)]
    long = (500, prose(200_000), "en", "s1", 0, "mine", 1)
    rows += [rows[3]] * 5 + [rows[0]] * 3 + [(None, None, None, None, None, None, None), (7, "", "en", "s1", 0, None, None), long, long]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, k1 string, q int")
    columns, kept = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        docs = spark.createDataFrame(stage(spark, docs, SF).collect(), docs.schema)
        assert docs.columns == columns
        kept.append((name, docs.count()))
    assert dict(kept)["quality"] > 150 and dict(kept)["near_duplicates"] == 151


def test_run_is_the_stages(spark, plain):
    got = corpus_pipeline.run(spark, SF)
    assert sorted((r.doc_id, r.text) for r in got.select("doc_id", "text").collect()) == plain["mix"]


def test_empty_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.count() == 0


def test_quality_measures_each_text_once(spark):
    from pyspark.sql import functions as F

    read = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def seen(t):
        read.add(1)
        return t

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = quality.keep_good(docs.withColumn("text", seen.asNondeterministic()("text")))
    assert 0 < kept.count() < docs.count() and read.value == docs.count()


def test_near_duplicates_are_found_by_simhash(spark, monkeypatch):
    """Without the candidates by prefixes, what SimHash links is still found, and verified."""
    from stratacat.llm import simhash

    monkeypatch.setattr(simhash, "candidates", lambda posts, *_: spark.createDataFrame([], "a long, b long, crowded boolean"))
    rng = random.Random(8)
    texts = [" ".join("".join(rng.choice("etaoinshr") for _ in range(6)) for _ in range(400)) for _ in range(5)]
    near = [f"{t} end" for t in texts[:3]]
    assert all((simhash.simhash(simhash.shingles(a, 3)) ^ simhash.simhash(simhash.shingles(b, 3))).bit_count() <= 3 for a, b in zip(texts, near, strict=False))
    docs = spark.createDataFrame(list(enumerate([*texts, *near, "", " ", None])), "doc_id long, text string")
    assert sorted(r.doc_id for r in simhash.keep_one(docs).collect()) == [0, 1, 2, 3, 4, 8, 9, 10]
    # Texts that SimHash links but whose shingles differ both stay.
    monkeypatch.setattr(simhash, "RADIUS", 64)
    monkeypatch.setattr(simhash, "simhash", lambda grams: 5)
    assert sorted(r.doc_id for r in simhash.keep_one(docs).collect()) == [0, 1, 2, 3, 4, 8, 9, 10]
