"""Operator 8: chat formatting that is read back by its own grammar."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratacat.llm.common import map_batches, table

ROLES = {"user": "User", "assistant": "Assistant", "system": "System", "tool": "Tool"}
NAMES = {v: k for k, v in ROLES.items()}
END = "</turn>"
#: A line of a text that a marker could be taken for, with the backslashes before it.
_CONFLICT = re.compile(r"^(\\*)(?=### |</turn>)", re.M)
_ESCAPED = re.compile(r"^\\(\\*)(?=### |</turn>)", re.M)


def header(role: str) -> str:
    return f"### {ROLES[role]}:" if role in ROLES else f"### Role {json.dumps(role)}:"


def escape(text: str) -> str:
    """One more backslash before each line that starts, after any backslashes, like a marker."""
    return _CONFLICT.sub(lambda m: "\\" + m[1], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def render(role: str, body: str) -> str:
    return f"{header(role)}\n{body}\n{END}\n"


def parse(formatted: str) -> list[tuple[str, str, int, int]]:
    """(role, text, start, end) of each turn; formatted[start:end] is the text as escaped. ValueError if formatted isn't made by the grammar

    chat = { header "\\n" line "\\n" { line "\\n" } "</turn>\\n" }: a line that starts with "### " or is "</turn>" is a marker, one with backslashes before that loses one.
    One token of lookahead, a line, decides each step.
    """
    turns: list[tuple[str, str, int, int]] = []
    at, role, start = 0, None, 0
    while at < len(formatted):
        stop = formatted.find("\n", at)
        if stop < 0:
            raise ValueError("the last line has no end")
        line = formatted[at:stop]
        if role is None:
            if line.startswith("### Role ") and line.endswith(":"):
                role = json.loads(line[9:-1])
            elif line[:4] == "### " and line[4:-1] in NAMES and line[-1] == ":":
                role = NAMES[line[4:-1]]
            else:
                raise ValueError("a turn has no header")
            start = stop + 1
        elif line == END and at > start:
            turns.append((role, unescape(formatted[start : at - 1]), start, at - 1))
            role = None
        elif line.startswith(("### ", END)):
            raise ValueError("a marker stands inside a turn")
        at = stop + 1
    if role is not None:
        raise ValueError("a turn has no end")
    return turns


def _recovers(formatted: str, role: str, text: str) -> bool:
    try:
        return [t[:2] for t in parse(formatted)] == [(role, text)]
    except ValueError:
        return False


def format_turn(role: str, text: str) -> tuple[str, bool]:
    """The turn as formatted, and whether it was escaped: first as it is; where the grammar doesn't give it back, with its conflicting lines escaped."""
    if _recovers(plain := render(role, text), role, text):
        return plain, False
    if _recovers(escaped := render(role, escape(text)), role, text):
        return escaped, True
    raise ValueError(f"a turn of {role!r} isn't recovered")


def format_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text as given (null role or text: empty), formatted, escaped, and mask_begin, mask_end: the loss mask, code points of formatted, null but for assistants.

    A turn's block starts at a line and ends one, so a conversation's text is its blocks in the order of turn and its grammar is that of the blocks; no task holds a whole conversation.
    """

    def run(c: dict[str, list]) -> dict[str, list]:
        roles, texts = [r or "" for r in c["role"]], [t or "" for t in c["text"]]
        made = [format_turn(r, t) for r, t in zip(roles, texts, strict=True)]
        spans = [parse(f)[0][2:] if r == "assistant" else (None, None) for r, (f, _) in zip(roles, made, strict=True)]
        return {"conv_id": c["conv_id"], "turn": c["turn"], "role": roles, "text": texts, "formatted": [f for f, _ in made], "escaped": [e for _, e in made], "mask_begin": [a for a, _ in spans], "mask_end": [b for _, b in spans]}

    d = conversations.select(conversations["conv_id"].cast("long").alias("conv_id"), conversations["turn"].cast("long").alias("turn"), conversations["role"].alias("role"), conversations["text"].alias("text"))
    return map_batches(d, run, "conv_id long, turn long, role string, text string, formatted string, escaped boolean, mask_begin int, mask_end int")


DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def digest(formatted: DataFrame) -> DataFrame:
    """What each conversation's formatted text says when it is read back: DIGEST. formatted: as of format_turns.

    Sorted by conversation and turn, equal turns by role and text, the blocks pass through one reader that keeps only running digests: a long conversation takes no more memory than a short one.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    schema = to_arrow_schema(_parse_datatype_string(DIGEST))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[dict] = []
        now: list | None = None

        def close() -> None:
            rows.append(dict(zip(schema.names, (now[0], now[1], now[2].hexdigest(), now[3], now[4].hexdigest(), now[5]), strict=True)))

        for b in batches:
            for conv, block, begin, end in zip(*(b.column(k).to_pylist() for k in ("conv_id", "formatted", "mask_begin", "mask_end")), strict=True):
                if now is None or now[0] != conv:
                    if now is not None:
                        close()
                    now = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, text, _, _ in parse(block):
                    now[1] += 1
                    now[2].update(f"{role}\n{text}\n".encode())
                if begin is not None:
                    loss = unescape(block[begin:end])
                    now[3] += len(loss)
                    now[4].update(loss.encode())
                now[5] += len(block)
            yield pa.RecordBatch.from_pylist(rows, schema=schema)
            rows = []
        if now is not None:
            close()
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    d = formatted.select("conv_id", "turn", "role", "text", "formatted", "mask_begin", "mask_end")
    return d.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "formatted", "mask_begin", "mask_end").mapInArrow(run, DIGEST)


#: A conversation whose texts look like markers and like escaped ones.
HARD = (-7, "\\### Assistant: </turn> ok")


def op8(spark, sf_dir: str) -> DataFrame:
    """A row for each conversation, HARD's too. Null roles and texts are empty; turns that repeat a number are in the order of role and text, and repeated rows count each; a null conv_id is a conversation of its own. A conversation may be of any length; without rows only HARD's is given."""
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = spark.range(2).select(F.lit(HARD[0]).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(HARD[1]).alias("text"))
    return digest(format_turns(given.unionByName(hard)))


SQL = r"""
with c as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '\### Assistant: </turn> ok' union all select -7, 1, 'assistant', '\### Assistant: </turn> ok'),
 f as (select *, length(case when role in ('user', 'assistant', 'system', 'tool') then '### ' || role || ':' else '### Role ' || to_json(role)::varchar || ':' end) + 1 + length(text)
    + len(list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '^\\*(### |</turn>)'))) + 9 as n from c)
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  cast(sum(case when role = 'assistant' then length(text) else 0 end) as bigint) as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256, cast(sum(n) as bigint) as formatted_chars
from f group by conv_id
"""
