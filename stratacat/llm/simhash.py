"""Operator 6: SimHash near-duplicates by multi-index hashing."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce
from itertools import chain

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratacat.llm.common import cut, let, map_batches, sized, table, words
from stratacat.llm.components import components

SEED = 42
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RADIUS = 3


def shingles(text: str | None, size: int) -> list[bytes]:
    """Runs of size words, A-Z lower-cased, joined by single spaces, repeats included; fewer words: the whole sequence; none: no shingle."""
    ws = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: only ASCII letters and ASCII white space count
    if len(ws) <= size:
        return [b" ".join(ws)] if ws else []
    flat = b" ".join(ws)
    ends, at = [], -1
    for w in ws:
        at += len(w) + 1
        ends.append(at)
    starts = [0, *(e + 1 for e in ends)]
    return [flat[a:b] for a, b in zip(starts, ends[size - 1 :])]


def simhash(grams: Sequence[bytes], block: int = 1 << 14) -> int:
    """Bit i is 1 if more than half of the shingles' XXH64 have it; 0 for no shingles. Works in blocks, so a long text takes no more memory."""
    if not grams:
        return 0
    ones = np.zeros(64, dtype=np.int64)
    for lo in range(0, len(grams), block):
        h = np.array([xxhash.xxh64_intdigest(g, SEED) for g in grams[lo : lo + block]], dtype="<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(grams), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, size: int = 3) -> DataFrame:
    """doc_id, fp: the fingerprint's 64 bits as a signed long. A null text has no words."""

    def run(c: dict[str, list]) -> dict[str, list]:
        return {"doc_id": c["doc_id"], "fp": [simhash(shingles(t, size)) for t in c["text"]]}

    return map_batches(docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text")), run, "doc_id long, fp long")


def _ball(key: Column, bits: int = 32, radius: int = 1) -> Column:
    """All keys within radius (0, 1 or 2) bits of key."""
    out = [key]
    if radius >= 1:
        out += [key.bitwiseXOR(F.lit(1 << i).cast("long")) for i in range(bits)]
    if radius >= 2:
        out += [key.bitwiseXOR(F.lit(1 << i | 1 << j).cast("long")) for i in range(bits) for j in range(i)]
    return F.array(*out)


def _upward(key: Column, offset: int) -> Column:
    """key, and key with one 0 bit set, plus offset. Of two keys that differ in one bit exactly one reaches the other so, and each pair is met once."""
    bit = lambda i: F.lit(1 << i).cast("long")
    some = F.filter(F.array(key, *[F.when(key.bitwiseAND(bit(i)) == 0, key.bitwiseOR(bit(i))) for i in range(32)]), lambda k: k.isNotNull())
    return F.transform(some, lambda k: k + F.lit(offset).cast("long"))


def links(fps: DataFrame, crowd: int = 64, by: tuple[str, ...] = ()) -> DataFrame:
    """a, b, with the columns by: links between distinct fingerprints fp (of equal by) that differ in 1 to 3 bits, enough to join all that are so linked, and none besides.

    Multi-index hashing: of two 32-bit segments one differs in a bit at most. Each segment's table has the fingerprints by key; each fingerprint asks for
    the keys of the segment's ball of radius 1 (by set bits only, so that a pair meets once) and the whole distance is verified on what the table returns.
    A row of either side is a fingerprint and a key, the second segment's plus 2 ** 32; what else is needed follows from the two.
    Keys with more than crowd fingerprints would return pairs by the square. There the other segment is searched around shared points x instead: residents
    come to each x within 2 bits, askers (one bit off in this segment) within 1, and where a resident within 1 bit stands at x, the smallest such links to all
    others at x: they are 3 bits off at most in all. Any pair within 3 bits meets at such an x, so its two ends are joined; rows are a fixed multiple of fingerprints.
    """
    on, second = [*by, "k"], 1 << 32
    low = lambda c: c.bitwiseAND(F.lit(0xFFFFFFFF).cast("long"))
    high = lambda c: F.shiftrightunsigned(c, 32)
    own = lambda c, k: F.when(k >= second, high(c) + second).otherwise(low(c))
    rest = lambda c, k: F.when(k >= second, low(c)).otherwise(high(c))
    fp = F.col("fp")
    homes = fps.select(*by, "fp", F.explode(F.array(low(fp), high(fp) + second)).alias("k"))
    asks = fps.select(*by, "fp", F.explode(F.concat(_upward(low(fp), 0), _upward(high(fp), second))).alias("k"))
    crowded = cut(homes.groupBy(*on).count().where(F.col("count") > crowd).select(*on))
    any_crowd = bool(crowded.take(1))
    quiet = (homes.join(crowded, on, "left_anti") if any_crowd else homes).withColumnRenamed("fp", "a")
    met = quiet.join(asks.withColumnRenamed("fp", "b"), on)
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= RADIUS
    pairs = met.where(near & ((own(F.col("b"), F.col("k")) != F.col("k")) | (F.col("a") < F.col("b")))).select(*by, "a", "b")
    if not any_crowd:
        return pairs
    resident = homes.join(crowded, on, "left_semi").withColumn("rest", rest(fp, F.col("k")))
    visitor = asks.where(own(fp, F.col("k")) != F.col("k")).join(crowded, on, "left_semi").withColumn("rest", rest(fp, F.col("k")))
    at = resident.select(*on, "fp", F.explode(_ball(F.col("rest"), 32, 2)).alias("x"), "rest").withColumn("d", F.bit_count(F.col("x").bitwiseXOR(F.col("rest")))).drop("rest")
    at = at.unionByName(visitor.select(*on, "fp", F.explode(_ball(F.col("rest"), 32, 1)).alias("x"), F.lit(2).alias("d")))
    host = F.min(F.when(F.col("d") <= 1, F.col("fp"))).alias("host")
    hosts = at.groupBy(*on, "x").agg(host, F.count("*").alias("n")).where("host is not null and n > 1").drop("n")
    return pairs.union(at.join(hosts, [*on, "x"]).where("fp <> host").select(*by, F.col("host").alias("a"), F.col("fp").alias("b")).distinct())


def near_duplicates(docs: DataFrame, size: int = 3) -> DataFrame:
    """doc_id, fp, component_id of every row: the smallest doc_id reachable over links of 3 bits or fewer; equal fingerprints are linked.

    Copies meet first: all that follows has one row for each distinct fingerprint. Rows without a doc_id link too; a component without any id has a null one.
    Documents without words have fingerprint 0 and are linked as such.
    """
    fps = cut(fingerprints(docs, size))
    each = cut(fps.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = cut(components(links(each.select("fp"))))
    linked = roots.join(each, roots["node"] == each["fp"]).select("fp", "root", "least")
    names = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    named = linked.join(names, "root").select("fp", "component_id")
    all_named = each.join(named, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id"))
    return fps.join(all_named, "fp").select("doc_id", "fp", "component_id")


def op6(spark, sf_dir: str) -> DataFrame:
    """A row for each row of documents. Null, empty and blank texts have fingerprint 0 and are linked as such. Rows without an id link too; a component of such rows alone has a null component_id. Repeated rows are in one component. Texts are taken whole, in blocks; no rows give none."""
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def shingle_set(text: Column, size: int) -> Column:
    """The distinct shingles of a text as XXH64; fewer words than size: the whole sequence is the one shingle."""
    ws = words(F.translate(text, UPPER, LOWER))
    some = lambda w: F.transform(F.sequence(F.lit(0), F.greatest(F.size(w) - size, F.lit(0))), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(size)]))
    return let(ws, lambda w: F.when(F.size(w) > 0, F.array_distinct(some(w))).otherwise(F.array().cast("array<long>")))


def _shingle_hashes(text: str | None, size: int, memo: dict[bytes, int]) -> np.ndarray:
    """The distinct shingles of a text as sorted 64-bit hashes, combined from the hashes of their words."""
    ws = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if len(memo) > 1 << 15:
        memo.clear()
    for w in set(ws):
        if w not in memo:
            memo[w] = xxhash.xxh64_intdigest(w, SEED)
    h = np.array([memo[w] for w in ws], dtype=np.uint64)
    n = max(len(ws) - size + 1, min(len(ws), 1))
    x, m = np.zeros(n, dtype=np.uint64), 0x9E3779B97F4A7C15
    for k in range(min(size, len(ws))):
        x += h[k : k + n] * np.uint64(m)
        m = (m * 0xBF58476D1CE4E5B9 | 1) & 0xFFFFFFFFFFFFFFFF
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
    return np.unique((x ^ (x >> np.uint64(29))).view(np.int64))


def _to_share(least: float, n):
    """Of n shingles, how many a text of similarity least or more has in common."""
    return np.ceil(least * n - 1e-9).astype(np.int64)


def prefixes(docs: DataFrame, size: int, least: float, one_in: int = 16, often: int = 4, most: int = 1 << 16) -> DataFrame:
    """k, k2, n, at: of each text (text, and its hash k2) the shingles k of its prefix, with the number of its shingles and the place in the prefix.

    In any one order of all shingles, two texts of similarity least or more share a shingle among the first n - ceil(least * n) + 1 of each. The order affects the
    work only: shingles that are frequent in a sample of texts come last, most frequent at the end. At most `most` of those are brought to the driver.
    """
    memo: dict[bytes, int] = {}
    some = map_batches(docs.where(F.pmod("k2", F.lit(one_in)) == 0), lambda c: {"k": np.concatenate([_shingle_hashes(t, size, memo) for t in c["text"]])}, "k long")
    top = some.groupBy("k").count().where(F.col("count") >= often).orderBy(F.desc("count"), "k").limit(most).collect()
    by_value = sorted((r[0], len(top) - i) for i, r in enumerate(top))
    frequent, rank = np.array([k for k, _ in by_value], dtype=np.int64), np.array([r for _, r in by_value], dtype=np.int64)
    seen: set[int] = set()  # of a task: copies are met once

    def run(c: dict[str, list]) -> dict[str, list]:
        out = {"k": [np.zeros(0, np.int64)], "k2": [np.zeros(0, np.int64)], "n": [np.zeros(0, np.int64)], "at": [np.zeros(0, np.int64)]}
        for k2, t in zip(c["k2"], c["text"], strict=True):
            if k2 in seen:
                continue
            if len(seen) > 1 << 17:
                seen.clear()
            seen.add(k2)
            x = _shingle_hashes(t, size, memo)
            if not len(x):
                continue
            p = len(x) - int(_to_share(least, len(x))) + 1
            if len(frequent):
                i = np.minimum(np.searchsorted(frequent, x), len(frequent) - 1)
                x = x[np.argsort(np.where(frequent[i] == x, rank[i], 0), kind="stable")]
            for name, v in (("k", x[:p]), ("k2", np.full(p, k2)), ("n", np.full(p, len(x))), ("at", np.arange(p))):
                out[name].append(v)
        return {name: np.concatenate(v) for name, v in out.items()}

    return map_batches(docs, run, "k long, k2 long, n long, at long")


def candidates(posts: DataFrame, least: float, crowd: int = 128) -> DataFrame:
    """a, b, crowded: pairs of text hashes that may be similar by the shingles of their prefixes; of shingles with more than crowd / 2 pairs a text of fitting sizes the shingle and each text.

    Two bounds hold for every similar pair. From its first common shingle on, each text has as many shingles left as are shared (fit). And beyond the prefix that ends first no more than
    ceil(least * n) - 1 shingles follow, n of the larger, so the prefixes have at least the rest of what is shared in common (need). A pair with a crowded shingle is compared in that crowd.
    """
    import pyarrow as pa

    out = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("crowded", pa.bool_()), ("fit", pa.bool_()), ("need", pa.int64())])

    def met(rows: np.ndarray) -> Iterator[tuple]:
        """rows: sorted (k, k2, n, at) of whole shingles."""
        rows = rows[np.r_[True, (rows[1:, :2] != rows[:-1, :2]).any(axis=1)]]
        rows = rows[np.lexsort((rows[:, 2], rows[:, 0]))]
        sizes = np.diff(np.r_[np.flatnonzero(np.r_[True, rows[1:, 0] != rows[:-1, 0]]), len(rows)])
        group, size = np.repeat(np.arange(len(sizes)), sizes), np.repeat(sizes, sizes)
        fit, found, at, d = np.zeros(len(sizes), np.int64), [], np.flatnonzero(size > 1), 0
        while len(at):  # each text with the one d places on: of the same shingle and no smaller
            d += 1
            at = at[at + d < len(rows)]
            x, y = rows[at], rows[at + d]
            go = (x[:, 0] == y[:, 0]) & (x[:, 2] >= _to_share(least, y[:, 2])) & (2 * fit[group[at]] <= crowd * size[at])
            at, x, y = at[go], x[go], y[go]
            all_of = _to_share(least / (1 + least), x[:, 2] + y[:, 2])
            ok = np.minimum(x[:, 2] - x[:, 3], y[:, 2] - y[:, 3]) >= all_of
            found.append((x[:, 1], y[:, 1], group[at], ok, all_of - _to_share(least, y[:, 2]) + 1))
            fit += np.bincount(group[at], minlength=len(sizes))
        crowded = 2 * fit > crowd * sizes
        many = rows[crowded[group]]
        yield many[:, 0], many[:, 1], True, np.ones(len(many), bool), np.zeros(len(many), np.int64)
        for x, y, g, ok, need in found:
            few = ~crowded[g]
            yield x[few], y[few], False, ok[few], need[few]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[np.ndarray] = []
        for b in chain(batches, [None]):
            new = np.zeros((0, 4), np.int64) if b is None else np.column_stack([c.to_numpy() for c in b.columns])
            if b is not None and (not len(new) or waiting and waiting[0][0, 0] == new[-1, 0]):
                waiting += [new] if len(new) else []
                continue
            whole = np.concatenate([*waiting, new])
            at = len(whole) if b is None else int(np.searchsorted(whole[:, 0], whole[-1, 0]))
            waiting = [whole[at:]]
            for x, y, crowded, ok, need in met(whole[:at]) if at else ():
                if len(x):
                    yield pa.RecordBatch.from_pydict({"a": x, "b": y, "crowded": np.full(len(x), crowded), "fit": ok, "need": need}, schema=out)

    found = posts.select("k", "k2", "n", "at").repartition("k").sortWithinPartitions("k", "k2").mapInArrow(run, "a long, b long, crowded boolean, fit boolean, need long")
    each = found.groupBy("a", "b", "crowded").agg(F.max("fit").alias("fit"), F.max("need").alias("need"), F.count("*").alias("n"))
    return each.where(F.col("fit") & (F.col("n") >= F.col("need"))).select("a", "b", "crowded")


def joined(sets: DataFrame, groups: DataFrame, least: float) -> DataFrame:
    """a, b: links that join, in each group (root) of text hashes k2, all texts that pairs of similarity least or more join. sets: k2 and the shingles s.

    Each text is compared to those that nothing has reached yet, so a group of near copies takes one comparison a text or little more, and no rows for pairs. A group is one task's: for groups of bounded size.
    """

    def run(c):
        import pandas as pd

        ids, each = c["k2"].to_numpy(), [np.asarray(s) for s in c["s"]]
        flat, lens, left, out = np.unique(np.concatenate(each), return_inverse=True)[1], np.array([len(s) for s in each]), np.arange(len(ids)), []
        ends = np.cumsum(lens)
        of = [flat[e - n : e] for e, n in zip(ends, lens, strict=True)]
        marked = np.zeros(flat.max() + 1, dtype=np.int32)
        reached: list[int] = []
        root = -1
        while len(left):
            if not reached:
                root = left[0]
                reached, left, flat, lens = [root], left[1:], flat[lens[0] :], lens[1:]
                continue
            x = reached.pop()
            near = _near(marked, of[x], len(of[x]), flat, lens, least)
            if near.any():
                new = left[near]
                reached += new.tolist()
                out += [(ids[root], ids[i]) for i in new]
                left, flat, lens = left[~near], flat[np.repeat(~near, lens)], lens[~near]
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return groups.join(sets, "k2").select("root", "k2", "s").groupBy("root").applyInPandas(run, "a long, b long")


def _near(marked: np.ndarray, one: np.ndarray, n: int, flat: np.ndarray, lens: np.ndarray, least: float) -> np.ndarray:
    """Which of the sets that lie one after the other in flat, with lens members each, have a similarity of least or more to a set of n, of whose members one are known. marked: zeros, by member."""
    marked[one] = 1
    shared = np.add.reduceat(marked[flat], np.cumsum(lens) - lens)
    marked[one] = 0
    return shared >= least * (n + lens - shared)


def _weight(shingles: Column) -> Column:
    """What a text counts towards a task's share: one for each 1024 shingles begun."""
    return F.greatest(F.ceil(shingles / 1024), F.lit(1)).cast("long")


def _reached_by(left: DataFrame, hubs: DataFrame, least: float, share: int, block: int) -> DataFrame:
    """a, b: for texts b of left (root, k2, s) a text a of hubs (root, k2, s) of their group at similarity least or more, in one row or more where there is one.

    Both sides are dealt in parts of about share and block texts, long ones counting as several, and each part meets each of the other side: as many comparisons as the two sides ask for, in tasks of bounded size.
    """

    def run(key, x, y):
        import pandas as pd

        if not len(x) or not len(y):
            return pd.DataFrame({"a": [], "b": []}, dtype="int64")
        each, of = [np.asarray(s) for s in x["s"]], [np.asarray(s) for s in y["s"]]
        values = np.unique(np.concatenate(each))
        ids, lens, flat, out = x["k2"].to_numpy(), np.array([len(s) for s in each]), np.searchsorted(values, np.concatenate(each)), []
        marked = np.zeros(len(values), dtype=np.int32)
        for hub, s in zip(y["k2"], of, strict=True):
            if not len(ids):
                break
            at = np.minimum(np.searchsorted(values, s), len(values) - 1)
            one = at[values[at] == s]
            near = _near(marked, one, len(s), flat, lens, least)
            if near.any():
                out += [(hub, i) for i in ids[near]]
                ids, flat, lens = ids[~near], flat[np.repeat(~near, lens)], lens[~near]
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    parts = lambda d, n, name: d.groupBy("root").agg(F.ceil(F.sum(_weight(F.size("s"))) / n).cast("long").alias(name))
    n = sized(parts(left, share, "shares").join(parts(hubs, block, "blocks"), "root"))
    of = lambda c: F.pmod(F.xxhash64("k2"), F.col(c))
    each = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
    x = left.join(n, "root").select("root", of("shares").alias("share"), each("blocks").alias("block"), "k2", "s")
    y = hubs.join(n, "root").select(F.col("root").alias("root"), each("shares").alias("share"), of("blocks").alias("block"), F.col("k2").alias("k2"), F.col("s").alias("s"))
    on = ["root", "share", "block"]
    return x.groupBy(*on).cogroup(y.groupBy(*on)).applyInPandas(run, "a long, b long")


def spread(rows: DataFrame, least: float, whole: int = 4096, share: int = 2048, block: int = 128) -> DataFrame:
    """a, b: what joined gives, for groups of any size. rows: root, k2, s; no two rows of one k2.

    From one text of a group on, those that are reached are asked for others in rounds, few at first and eight times as many in each round, while what is left shrinks; when all have asked, what is left of the group is one task's
    if it has no more than `whole` texts (long ones counting as several), and else goes on from another text. A text is compared to all that came before it, unless one reached it. No row stands for a pair, and no task has more than a part of a group.
    """
    first = lambda d: d.groupBy("root").agg(F.min("k2").alias("k2"))
    left = cut(rows)
    hubs, take, later, links = cut(left.join(first(left), ["root", "k2"], "left_semi")), block, None, []
    left = cut(left.join(hubs.select("k2"), "k2", "left_anti"))
    while left.take(1):
        found = cut(_reached_by(left, hubs, least, share, block).groupBy("b").agg(F.min("a").alias("a")))
        links.append(found.select("a", "b"))
        reached = left.join(found.select(F.col("b").alias("k2")), "k2", "left_semi").select("root", "k2", "s")
        waiting = cut(reached if later is None else reached.unionByName(later))
        left = cut(left.join(found.select(F.col("b").alias("k2")), "k2", "left_anti"))
        # Of each group that has some waiting about `take` ask next.
        n = sized(waiting.groupBy("root").agg(F.count("*").alias("n")))
        chosen = waiting.join(n, "root").where((F.col("n") <= take) | (F.pmod(F.xxhash64("k2", F.lit(take)), F.col("n")) < take)).select("root", "k2", "s")
        idle = sized(left.groupBy("root").agg(F.sum(_weight(F.size("s"))).alias("m"), F.min("k2").alias("k2")).join(n.select("root"), "root", "left_anti"))
        ends = idle.where(F.col("m") <= whole).select("root")
        if ends.take(1):
            rest = cut(left.join(ends, "root", "left_semi").select("root", "k2", "s"))
            links.append(joined(rest.select("k2", "s"), rest.select("root", "k2"), least))
            left = left.join(ends, "root", "left_anti")
        seeds = left.join(idle.select("root", "k2"), ["root", "k2"], "left_semi").select("root", "k2", "s")
        hubs = cut(chosen.unionByName(seeds))
        later = cut(waiting.join(hubs.select("k2"), "k2", "left_anti").join(left.select("root").distinct(), "root", "left_semi"))
        left = cut(left.join(hubs.select("k2"), "k2", "left_anti"))
        take = min(8 * take, 1 << 40)
    return reduce(DataFrame.unionByName, links) if links else rows.select(F.col("k2").alias("a"), F.col("k2").alias("b")).limit(0)


def alike(d: DataFrame) -> DataFrame:
    """a, b: the keys k2 of d (k2, text) in each component of near_duplicates, as a star about the smallest. Texts without words are left out."""
    some = d.where(F.col("text").rlike(r"[^\x20\x09-\x0D]")).select(F.col("k2").alias("doc_id"), "text")
    return near_duplicates(some).where("doc_id <> component_id").select(F.col("component_id").alias("a"), F.col("doc_id").alias("b")).distinct()


def near_links(d: DataFrame, size: int = 5, least: float = 0.8, crowd: int = 128, whole: int = 4096) -> DataFrame:
    """a, b: pairs of keys k2 whose texts' shingle sets have a Jaccard similarity of least or more, enough to join all that such pairs join. Exact: see prefixes.

    d: k2 and text, equal keys for equal texts only. Candidates are the components that SimHash links (alike), and what three bits miss by the shingles of prefixes; all are verified on
    their shingles. Candidates that hang together are compared in one task up to `whole` texts, each 8 KB begun of a long one counting as a text, and larger
    groups in parts (spread): two ways to the same links.
    """
    met = cut(candidates(prefixes(d, size, least), least, crowd))
    pairs, crowds = met.where(~F.col("crowded")).select("a", "b"), met.where("crowded")
    stars = crowds.join(sized(crowds.groupBy("a").agg(F.min("b").alias("least"))), "a").select(F.col("least").alias("a"), "b")
    roots = cut(components(pairs.union(stars).union(alike(d))).select(F.col("node").alias("k2"), "root"))
    asked = d.join(sized(roots.select("k2")), "k2", "left_semi")
    sets = asked.dropDuplicates(["k2"]).select("k2", shingle_set(F.col("text"), size).alias("s"))
    weights = asked.groupBy("k2").agg(F.max(F.ceil(F.octet_length("text") / 8192)).alias("w")).join(roots, "k2").groupBy("root").agg(F.sum("w").alias("w"))
    large = sized(weights.where(F.col("w") > whole).select("root"))
    if not large.take(1):
        return joined(sets, roots, least)
    few, many = roots.join(large, "root", "left_anti"), roots.join(large, "root", "left_semi")
    return joined(sets, few, least).unionByName(spread(many.join(sets, "k2").select("root", "k2", "s"), least, whole))


def keep_one(docs: DataFrame, size: int = 5, least: float = 0.8, crowd: int = 128, whole: int = 4096, bits: int = 64) -> DataFrame:
    """docs, with its columns, without rows that repeat the text of a row with a smaller doc_id, and of each group of near duplicates the row with the smallest; ids come before nulls.

    Near duplicates are texts whose shingle sets have a Jaccard similarity of least or more; a group is what such pairs join. Candidates are the components that near_duplicates
    links by SimHash; since three bits miss pairs at 0.8, those that share a shingle of their prefixes are candidates too, so that all are found. Every one is verified.
    Only hashes are grouped and joined: a row is its doc_id and its text's hash, of bits bits. Where texts of one hash differ in a second, the second is their key, so neither takes
    the other's place; texts are taken as equal if both are, 128 bits in all. What goes is a list of such pairs, broadcast where its measured size allows and else
    joined by hash. Of rows that repeat id and text one stays. Null texts are equal to each other, and no duplicates of others.
    """
    k1 = F.coalesce(docs["doc_id"].cast("long"), F.lit((1 << 63) - 1))
    k2, second = F.shiftright(F.xxhash64(docs["text"]), 64 - bits), F.xxhash64(docs["text"], F.lit(SEED))
    rows = cut(docs.groupBy(k1.alias("k1"), k2.alias("k2"), second.alias("k3")).agg(F.count("*").alias("n")))
    clash = sized(rows.groupBy("k2").agg(F.min("k3").alias("low"), F.max("k3").alias("high")).where("low <> high").select(F.col("k2").alias("__clash")))
    columns = docs.columns
    if clash.take(1):
        docs = docs.join(clash, k2 == clash["__clash"], "left")
        k2 = F.when(clash["__clash"].isNull(), k2).otherwise(second)
        rows = cut(rows.join(clash, rows["k2"] == clash["__clash"], "left").select("k1", F.when(F.col("__clash").isNull(), F.col("k2")).otherwise(F.col("k3")).alias("k2"), "n"))
    now = rows.groupBy("k2").agg(F.min("k1").alias("k1"))
    roots = components(near_links(docs.select(k2.alias("k2"), docs["text"].alias("text")), size, least, crowd, whole))
    of_root = cut(roots.join(now.select(F.col("k2").alias("node"), "k1"), "node"))
    first = of_root.groupBy("root").agg(F.min(F.struct("k1", "node")).alias("first"))
    gone = of_root.join(first, "root").where(F.col("node") != F.col("first.node")).select(F.col("node").alias("k2"))
    stay = now.join(sized(gone), "k2", "left_anti").select("k1", "k2")
    lost = sized(rows.select("k1", "k2").join(stay, ["k1", "k2"], "left_anti").select(F.col("k1").alias("__k1"), F.col("k2").alias("__k2")))
    kept = docs.join(lost, (k1 == lost["__k1"]) & (k2 == lost["__k2"]), "left_anti")
    again = sized(rows.where("n > 1").select(F.col("k1").alias("__k1"), F.col("k2").alias("__k2")))
    once = kept.join(again, (k1 == again["__k1"]) & (k2 == again["__k2"]), "left_anti").select(*[docs[c] for c in columns])
    repeated = kept.join(again, (k1 == again["__k1"]) & (k2 == again["__k2"])).dropDuplicates(["__k1", "__k2"]).select(*columns)
    return once.unionByName(repeated)
