from __future__ import annotations

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from stratacat.functions import globs, identity, scalars
from stratacat.operators.projection import genesis_id

EMPTY = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"


def one(spark, *cols):
    return tuple(spark.range(1).select(*cols).first())


def test_frozen_id(spark):
    g = {"content_sha256": F.lit(EMPTY), "original_path": F.lit("pnp/board.pdf"), "ingest_op_id": F.lit("0192f3a4b5c6d7e8f9a0b1c2d3e4f5a6"), "origin_node": F.lit("home-pi")}
    assert one(spark, identity.mint_id(g)) == ("30092d830e2641b447745655bbe4171675720a1aa8cf80e0ae3736e6e43111f0",)


def test_escapes_agree(spark):
    text = "".join(map(chr, range(1, 130))) + 'é"\\'
    g = {"content_sha256": "a", "original_path": text, "ingest_op_id": "o", "origin_node": "n"}
    assert one(spark, identity.mint_id({k: F.lit(v) for k, v in g.items()})) == (genesis_id(g),)


@pytest.mark.parametrize(("text", "n"), [("5MB", 5242880), ("1.5MB", 1572864), ("512KB", 524288), ("100B", 100), ("1048576", 1048576), ("5 MB", 5242880), ("5MiB", 5242880), ("  5mb  ", 5242880), ("1GiB", 1 << 30), ("", None), ("abc", None), ("MB", None), ("-5MB", None), ("-5", -5), ("1.5", None)])
def test_sizes(spark, text, n):
    assert one(spark, scalars.parse_size(F.lit(text))) == (n,)


def test_small_texts(spark):
    assert one(spark, scalars.human_bytes(F.lit(1023)), scalars.human_bytes(F.lit(1536)), scalars.age_text(F.lit(-4)), scalars.age_text(F.lit(3599)), scalars.age_text(F.lit(200000))) == ("1023 B", "1.5 KiB", "0s", "59m", "2d")
    assert one(spark, scalars.newer(F.lit("v1.2.3"), F.lit("1.10.0-rc1")), scalars.newer(F.lit("dev"), F.lit("1.0.0")), scalars.newer(F.lit("1.2"), F.lit("1.3.0"))) == (True, False, False)
    assert one(spark, scalars.seq_of_marker(F.lit("000000000012.done"), "done"), scalars.seq_of_marker(F.lit("12.done"), "done"), scalars.entry_name(F.lit(7))) == (12, None, "000000000007.toml")
    assert one(spark, scalars.checksum_for(F.lit(f"{EMPTY}  a.tgz\n{'0' * 64} *b.tgz"), F.lit("b.tgz"))) == ("0" * 64,)
    assert one(spark, scalars.split_lines(F.lit(" a \n\n b\n"))) == (["a", "b"],)
    t = spark.range(1).select(scalars.target(F.lit("n/a/b")).alias("t")).first().t
    assert (t.id, t.member, t.path) == (None, "n", "a/b")


def test_paths(spark):
    given_ = ["a/../b", "./a//b/", "", "/../x", "../a", "a/../../b", "/"]
    assert [one(spark, identity.clean_path(F.lit(p)))[0] for p in given_] == ["b", "a/b", ".", "/x", "../a", "../b", "/"]


def test_pointers(spark):
    good = f"m.v1\nsha256 {EMPTY}\nsize 5\nlocation x y\n"
    bad = ["m.v2" + good[4:], "", good.replace("size 5", "size -5"), good.replace("size 5", "size a"), good.replace(EMPTY, EMPTY.upper()), good.replace("x y", " "), good + "more\n", good.replace("size", "siz")]
    p = lambda t: spark.range(1).select(identity.pointer(F.lit(t), "m.v1").alias("p")).first().p
    assert tuple(p(good)) == (EMPTY, 5, "x y")
    assert [p(t) for t in bad] == [None] * len(bad)
    assert one(spark, identity.is_pointer(F.lit("m.v1\n"), "m.v1"), identity.is_pointer(F.lit("m.v1x"), "m.v1"), identity.is_pointer(F.lit(good), "m.v1")) == (True, False, True)


def test_rules(spark):
    how = {"min_size": 5 << 20, "include": ["**/*.pdf", "**/*.stl"], "exclude": ["**/*.tmp", "drafts/**"], "history": False, "overrides": [("masters/**", True, True)]}
    cases = {("notes.txt", 1): (False, False, False), ("data.bin", 5): (True, False, False), ("art/logo.pdf", 0): (True, False, False), ("scratch/note.tmp", 50): (False, False, False), ("drafts/board.pdf", 50): (False, False, False), ("masters/board.pdf", 50): (True, True, True), ("pnp/board.pdf", 50): (True, False, False)}
    for (path, mib), want in cases.items():
        assert tuple(spark.range(1).select(globs.evaluate(F.lit(path), F.lit(mib << 20), **how).alias("r")).first().r) == want, path


def test_ignore(spark):
    pats = globs.parse_ignore("*.tmp\ndrafts/\nbuild/**\n!drafts/keep.md\n")
    is_ = lambda p: one(spark, globs.ignored(F.lit(p), pats))[0]
    assert all(map(is_, ["a.tmp", "sub/b.tmp", "drafts", "drafts/x.md", "build/out/bin"]))
    assert not any(map(is_, ["drafts/keep.md", "src/main.go"]))
    assert not one(spark, globs.ignored(F.lit("a.tmp"), pats, F.lit(True)))[0]


@pytest.mark.parametrize("glob", ["[", "a[b", "{a,b", "x\\"])
def test_bad_globs(glob):
    with pytest.raises(globs.BadGlob):
        globs.to_regex(glob)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab/.*?+()[]{}^$|-,", max_size=12))
def test_a_glob_is_bad_or_a_regex(glob):
    try:
        re.compile(globs.to_regex(glob))
    except globs.BadGlob:
        pass


@pytest.mark.parametrize(("glob", "yes", "no"), [("**/*.pdf", ["a.pdf", "x/y.pdf"], ["a.pdfx"]), ("a/*", ["a/b"], ["a/b/c", "a"]), ("a/**", ["a/b", "a/b/c"], ["a"]), ("x[!ab]", ["xc"], ["xa", "x/"]), ("{a,b}?", ["ax", "bx"], ["cx"]), ("a/**/b", ["a/b", "a/x/y/b"], ["a/xb"])])
def test_globs(glob, yes, no):
    rx = re.compile(globs.to_regex(glob))
    assert all(map(rx.search, yes)) and not any(map(rx.search, no))


def test_small_functions(spark):
    one = spark.range(1)
    v = lambda c: one.select(c).first()[0]
    lit = F.lit
    assert re.fullmatch("[0-9a-f]{12}4[0-9a-f]{3}[89ab][0-9a-f]{15}", v(scalars.random_op_id()))
    assert [v(scalars.exit_of(lit(k).cast("string"))) for k in (None, "network-down", "node-offline", "object-missing", "chain-broken", "auth-required", "odd")] == [0, 3, 4, 5, 6, 2, 1]
    assert v(scalars.rfc3339(lit("2024-05-06 07:08:09.9").cast("timestamp"))) == "2024-05-06T07:08:09Z" and v(scalars.rfc3339(lit(None).cast("timestamp"))) == ""
    assert [v(scalars.conflict_mode(lit(a))) for a in (" C", "copy", "r", "Rename", "s", "", "x")] == ["copy", "copy", "rename", "rename", "stop", "stop", "stop"]
    assert [v(scalars.is_yes(lit(a))) for a in ("Y", "yes ", "no", "")] == [True, True, False, False]
    assert v(scalars.status_verb(lit("left"))) == "left" and v(scalars.member_names(F.array().cast("array<string>"))) == "an unknown member" and v(scalars.member_names(F.array(lit("a"), lit("b")))) == "a, b"
    assert [v(scalars.pusher(lit(a), lit(b))) for a, b in (("n", "e"), ("@", "e"), ("", ""))] == ["n", "e", "unknown"] and v(scalars.actor(lit("@"), lit("e"))) == "@"
    assert v(scalars.with_include(F.array(lit("a")), lit("a"))) == ["a"] and v(scalars.with_include(F.array(lit("a")), lit("b"))) == ["a", "b"]
    want = F.array(lit(" x "), lit("a"), lit("x"))
    assert v(scalars.with_lines(lit("a\nb"), want)) == "a\nb\nx\n" and v(scalars.with_lines(lit(""), want)) == "x\na\n" and v(scalars.with_lines(lit("x \na\n"), want)) == "x \na\n"
    mode = lambda args, *flags: v(scalars.track_mode(F.array(*map(lit, args)), *map(lit, flags)))
    assert [mode(["l/p"], False, False, True, False), mode(["l/p"], False, False, True, True), mode(["l/p"], True, True, True, True), mode(["a", "b"], False, False, True, False), mode(["x"], True, False, False, True)] == ["vault", "ambiguous", "both-flags", "repo", "vault"]
    g = {k: lit("a" * 64 if k == "content_sha256" else "x") for k in identity.GENESIS}
    assert v(identity.guarded_id(g))[:] == (v(identity.mint_id(g)), None) and v(identity.guarded_id(g | {"origin_node": lit("")})).problem == "origin_node"
