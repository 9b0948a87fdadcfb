"""Operator 10: personal data by pattern, checksum and context."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import accumulate

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratacat.llm.common import map_batches, table

Span = tuple[int, int]
BASE = ("email", "ip", "card", "phone")
LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
# A digit whose left neighbour is a digit starts no address: its run has been tried from its first digit.
_IP = re.compile(r"[0-9](?<![0-9][0-9])[0-9]*+(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGITS = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(c), 10)) for c in even)) % 10 == 0


def mod97(iban: str) -> bool:
    """ISO 7064: country code and check digits go to the end, letters count from A = 10, and the number leaves 1."""
    s = iban.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def emails(text: str) -> Iterator[Span]:
    """Leftmost non-overlapping matches of local@label(.label)+, in one pass: a local part ends at its @ and holds none."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            end = m.end()
            yield start, end
        else:
            end = max(end, at + 1)
        at = text.find("@", max(end, at + 1))


def ips(text: str) -> Iterator[Span]:
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            yield m.span()


def cards(text: str) -> Iterator[Span]:
    for m in _CARD.finditer(text):
        d = _DIGITS.sub("", m[0])
        if 13 <= len(d) <= 19 and luhn(d):
            yield m.span()


def phones(text: str) -> Iterator[Span]:
    for m in _PHONE.finditer(text):
        if 9 <= len(_DIGITS.sub("", m[0])) <= 15:
            yield m.span()


def _matches(pattern: str, check: Callable[[str], bool] | None = None) -> Callable[[str], Iterator[Span]]:
    rx = re.compile(pattern)
    return lambda text: (m.span() for m in rx.finditer(text) if check is None or check(m[0]))


@dataclass(frozen=True)
class Kind:
    """find proposes spans that its validator has confirmed; score is what such a span starts with; a context word nearby adds boost."""

    name: str
    find: Callable[[str], Iterator[Span]]
    score: float
    boost: float
    context: tuple[str, ...]


KINDS = (
    Kind("email", emails, 0.7, 0.2, ("mail", "contact", "write")),
    Kind("ip", ips, 0.6, 0.3, ("ip", "host", "server", "address")),
    Kind("card", cards, 0.7, 0.2, ("card", "visa", "credit", "karte", "tarjeta", "carte")),
    Kind("phone", phones, 0.6, 0.3, ("tel", "phone", "call", "mobile", "fax")),
    Kind("iban", _matches(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])", mod97), 0.7, 0.2, ("iban", "account", "konto", "cuenta", "compte")),
    Kind("key", _matches(r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[0-9A-Z]{16}(?![A-Za-z0-9])"), 0.8, 0.1, ("key", "aws", "secret")),
    Kind("password", _matches(r"[Pp]ass(?:word|wd|phrase)[=:][^\s,;]{6,}+"), 0.7, 0.2, ("login", "user")),
    Kind("ssn", _matches(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", lambda s: s[:3] not in ("000", "666") and s[0] != "9" and s[4:6] != "00" and s[7:] != "0000"), 0.3, 0.4, ("ssn", "social", "security")),
    Kind("local_phone", _matches(r"(?<![0-9+.(-])\(?[0-9]{3,4}\)?[ .-][0-9]{3,4}[ .-][0-9]{3,4}(?![0-9.-])"), 0.3, 0.4, ("tel", "phone", "call", "mobile", "fax", "telefon")),
)
NEAR = 40
_WORD = re.compile(r"[^\W\d_]+")


def scored(text: str, kinds: tuple[Kind, ...] = KINDS, least: float = 0.5) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, score) by kind in the order given, then start; code points, end exclusive.

    A span's score is its kind's, plus the boost if one of the kind's context words stands within NEAR characters before or after it; those under least go.
    Base kinds come first. Spans of other kinds that overlap one of the base kinds go too: the base reading holds.
    """
    out: list[tuple[str, int, int, float]] = []
    taken: list[Span] = []
    reach: list[int] = []  # of the taken spans in order of start, the furthest end so far

    def overlaps(a: int, b: int) -> bool:
        i = bisect_left(taken, (b,))
        return i > 0 and reach[i - 1] > a

    for k in kinds:
        if k.name not in BASE and len(reach) < len(taken):
            taken.sort()
            reach = list(accumulate((y for _, y in taken), max))
        for a, b in k.find(text):
            near = {w.lower() for w in _WORD.findall(f"{text[max(0, a - NEAR) : a]} {text[b : b + NEAR]}")}
            score = min(1.0, k.score + (k.boost if near.intersection(k.context) else 0))
            if score >= least and (k.name in BASE or not overlaps(a, b)):
                out.append((k.name, a, b, round(score, 3)))
                if k.name in BASE:
                    taken.append((a, b))
    return out


SCHEMA = "doc_id long, spans array<struct<kind: string, begin: int, end: int, score: double>>"


def find_pii(docs: DataFrame, kinds: tuple[Kind, ...] = KINDS, least: float = 0.5) -> DataFrame:
    """doc_id and the scored spans of every row of docs, in one pass without a shuffle. A null or empty text has none."""

    def run(c: dict[str, list]) -> dict[str, list]:
        return {"doc_id": c["doc_id"], "spans": [[dict(zip(("kind", "begin", "end", "score"), s, strict=True)) for s in scored(t or "", kinds, least)] for t in c["text"]]}

    return map_batches(docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text")), run, SCHEMA)


def masked(text: str, spans: list[tuple[str, int, int, float]]) -> str:
    """text with each span replaced by its kind in angle brackets; of overlapping spans the first, then longest, counts and later ones only add what they cover beyond it."""
    out, at = [], 0
    for kind, a, b, _ in sorted(spans, key=lambda s: (s[1], -s[2])):
        if b <= at:
            continue
        out += [text[at:a] if a > at else "", f"<{kind.upper()}>" if a >= at else ""]
        at = b
    return "".join([*out, text[at:]])


def mask_pii(docs: DataFrame, kinds: tuple[Kind, ...] = KINDS, least: float = 0.5) -> DataFrame:
    """docs with masked texts and, where present, n_chars recounted; other columns and null texts stay."""

    @F.pandas_udf("string")
    def mask(s: pd.Series) -> pd.Series:
        return s.map(lambda t: t if t is None else masked(t, scored(t, kinds, least)))

    out = docs.withColumn("text", mask("text"))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def op10(spark, sf_dir: str) -> DataFrame:
    """A row for each row of documents, with the spans of find_pii counted and digested. Null and empty texts have no spans: counts of 0, the digest of nothing and empty spans. Repeated rows are read each, texts whole; no rows give none."""
    spans = find_pii(table(spark, sf_dir, "documents"))
    of = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    text = lambda s: F.concat_ws(":", s["kind"], s["begin"].cast("string"), s["end"].cast("string"))
    base = F.array_join(F.transform(F.filter("spans", lambda s: s["kind"].isin(*BASE)), text), ",")
    return spans.select("doc_id", *map(of, BASE), F.sha2(base, 256).alias("base_sha256"), F.array_join(F.transform("spans", text), ",").alias("spans"))
