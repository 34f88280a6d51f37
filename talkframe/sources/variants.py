"""JSON exports and archive scripts read as VARIANT values, in expressions only.

`json_messages(texts)` and `archive_messages(texts)` take (file, text) and return a messages frame. Texts that aren't `readable`
(broken, over the size limit of a VARIANT, or with a key twice in an object) give nothing here; a parser by file may take them.

Rules of both: of several keys the first in order of preference whose value isn't empty counts (null, "", 0, false, [] and {}
are empty). A text may be a string, a number, a list of parts or an object with one, to DEPTH objects deep; messages without
text are left out and the others numbered from 1. Rows with a null text give nothing.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talkframe.functions import lexicon as L
from talkframe.operators.messages import messages
from talkframe.sources import keys as K
from talkframe.sources import times

DEPTH = 3
LIST = "array<variant>"
NUMBER = "-0123456789"
EMPTY = "''"
_names = itertools.count()
ASSIGNMENT = r"^\s*(?:window\.)?[\w.]+\s*=\s*"


# Rules are SQL texts about a value named by a text: hundreds of Column calls would cost more than the query.


def value(v: str, key: str) -> str:
    """The value of a key; a JSON null is a value, a missing key isn't."""
    return f"try_variant_get({v}, '$.{key}', 'variant')"


def kind(v: str) -> str:
    """The first character of a value as JSON: a quote, bracket or brace, t, f, n, or one of a number."""
    return f"left(to_json({v}), 1)"


def is_a(v: str, kinds: str) -> str:
    return f"coalesce({kind(v)} IN ({', '.join(map(repr, kinds))}), false)"


def bound(v: str, f: Callable[[str], str]) -> str:
    """f of a value that is computed once, however often f names it; rules stay linear in the depth of their nesting."""
    x = f"x{next(_names)}"
    return f"get(transform(array({v}), {x} -> {f(x)}), 0)"


def _stripped(text: str) -> str:
    return rf"regexp_replace({text}, r'^\s+|\s+$', '')"


def _written(x: str) -> str:
    plain = f"try_variant_get({x}, '$', 'string')"
    return f"CASE WHEN {is_a(x, 'tf')} THEN initcap({plain}) WHEN {is_a(x, NUMBER)} AND schema_of_variant({x}) RLIKE 'DECIMAL|DOUBLE|FLOAT' THEN CAST(try_variant_get({x}, '$', 'double') AS STRING) ELSE {plain} END"


def written(v: str) -> str:
    """A string, number or truth value as text; numbers with a point keep it."""
    return bound(v, _written)


def _filled(x: str) -> str:
    return f"""CASE WHEN to_json({x}) IN ('""', 'null', '[]', '{{}}', 'false') OR ({is_a(x, NUMBER)} AND try_variant_get({x}, '$', 'double') = 0) THEN NULL ELSE {x} END"""


def first(v: str, names: Sequence[str]) -> str:
    """The first value that isn't empty."""
    return bound(v, lambda x: f"coalesce({', '.join(bound(value(x, k), _filled) for k in names)})")


def present(v: str, names: Sequence[str]) -> str:
    """The value of the first key that exists."""
    return f"coalesce({', '.join(value(v, k) for k in names)})"


def _part(p: str) -> str:
    return f"""CASE WHEN {is_a(p, '"')} THEN try_variant_get({p}, '$', 'string') WHEN {is_a(p, '{')} THEN coalesce({written(first(p, ("text", "content")))}, '') ELSE '' END"""


def said(v: str, depth: int = DEPTH) -> str:
    """Text of a value that may be text, a number, a list of parts, or an object with one."""

    def of(x: str) -> str:
        inner = said(first(x, ("text", "content", "body")), depth - 1) if depth > 1 else "''"
        parts = f"array_join(transform(try_variant_get({x}, '$', '{LIST}'), p -> {_part('p')}), '')"
        return _stripped(f"coalesce(CASE WHEN {is_a(x, '[')} THEN {parts} WHEN {is_a(x, '{')} THEN {inner} WHEN {is_a(x, 'n')} THEN '' ELSE {_written(x)} END, '')")

    return bound(v, of)


def name_of(v: str, names: Sequence[str]) -> str:
    """A name that is a value or stands in an object under one of the keys; empty if there is none."""
    return bound(v, lambda x: _stripped(f"coalesce(CASE WHEN {is_a(x, '{')} THEN {written(first(x, names))} WHEN {is_a(x, 'n')} THEN '' ELSE {_written(x)} END, '')"))


def identity(v: str) -> str:
    """Strings and whole numbers; anything else is empty."""
    return bound(v, lambda x: f"""CASE WHEN {is_a(x, '"tf')} OR ({is_a(x, NUMBER)} AND schema_of_variant({x}) RLIKE 'INT') THEN {_written(x)} ELSE '' END""")


def _text(v: str) -> str:
    return bound(v, lambda x: f"""CASE WHEN {is_a(x, '"')} THEN try_variant_get({x}, '$', 'string') END""")


def _number(v: str) -> str:
    return bound(v, lambda x: f"CASE WHEN {is_a(x, NUMBER)} THEN try_variant_get({x}, '$', 'double') END")


def parsed(texts: DataFrame) -> DataFrame:
    return texts.select("file", F.try_parse_json("text").alias("v"))


def readable(text: Column, script: Column) -> Column:
    """Whether a text is a VARIANT (scripts after their assignment)."""
    return F.try_parse_json(F.when(script, F.regexp_replace(text, ASSIGNMENT, "")).otherwise(text)).isNotNull()


def _exploded(files: DataFrame, keys: Sequence[str], items: str, *more: str) -> DataFrame:
    """One row for each object of items with a text under one of the keys: file, the columns, seq, text, v."""
    read = f"transform({items}, m -> struct({said(first('m', keys))} AS text, m AS v))"
    kept = f"filter({read}, m -> m.text <> '' AND {is_a('m.v', '{')})"
    return files.selectExpr("file", *more, f"posexplode({kept}) AS (at, m)").selectExpr("file", *more, "at + 1 AS seq", "m.text", "m.v")


def _frame(rows: DataFrame) -> DataFrame:
    """A messages frame of rows with file, seq, text, who, stamp, id, quoted."""
    rows = rows.selectExpr("file", "seq", "text", "who", "id", "quoted", f"{_text('stamp')} AS t", f"{_number('stamp')} AS n")
    who = F.when(F.col("who") != "", F.col("who")).otherwise(L.UNKNOWN_SPEAKER)
    return messages(rows, conv_id=F.col("file"), seq=F.col("seq"), ts=times.parsed(F.col("t"), F.col("n")), speaker=who, text=F.col("text"), source_id=F.col("id"), reply_to=F.col("quoted"))


def private_export(v: str) -> str:
    """A desktop export: chat and username on top, and most of the first 50 messages with content, time and type."""
    top = f"filter(slice(try_variant_get({v}, '$.messages', '{LIST}'), 1, 50), m -> {is_a('m', '{')})"
    full = " AND ".join(f"{value('m', k)} IS NOT NULL" for k in ("content", "time", "type"))
    enough = bound(top, lambda t: f"size({t}) > 0 AND 2 * size(filter({t}, m -> {full})) >= size({t})")
    return f"coalesce({value(v, 'chat')} IS NOT NULL AND {value(v, 'username')} IS NOT NULL AND {enough}, false)"


def json_messages(texts: DataFrame) -> DataFrame:
    """Messages of JSON exports: a list, or an object with one under a known key."""
    lists = [f"CASE WHEN {is_a('v', '[')} THEN try_variant_get(v, '$', '{LIST}') END"]
    lists += [f"CASE WHEN {is_a(value('v', k), '[')} THEN try_variant_get(v, '$.{k}', '{LIST}') END" for k in K.JSON_LISTS]
    partner = f"CASE WHEN {first('v', ('is_group',))} IS NULL THEN {name_of(first('v', ('chat',)), ('name',))} ELSE '' END AS partner"
    files = parsed(texts).selectExpr("file", f"{private_export('v')} AS exported", partner, f"coalesce({', '.join(lists)}) AS items")
    rows = _exploded(files, K.JSON_TEXT, "items", "exported", "partner")
    stamp = f"coalesce({first('v', K.JSON_TIME_FIRST[:2])}, CASE WHEN {kind(value('v', 'timestamp_ms'))} <> 'n' THEN {value('v', 'timestamp_ms')} END, {first('v', K.JSON_TIME)})"
    quoted = bound(present("v", K.JSON_REPLY), lambda x: identity(f"CASE WHEN {is_a(x, '{')} THEN {present(x, ('message_id', 'id'))} ELSE {x} END"))
    rows = rows.selectExpr(
        "file", "exported", "partner", "seq", "text", f"{name_of(first('v', K.JSON_SPEAKER), K.JSON_PERSON)} AS who", f"{_stripped(f'coalesce({written(value('v', 'type'))}, {EMPTY})')} AS type",
        f"{stamp} AS stamp", f"{identity(present('v', K.JSON_ID))} AS id", f"{quoted} AS quoted",
    )
    side = F.when(F.col("partner") == "", F.col("who")).when(F.col("who") != "", L.SELF_SPEAKER).otherwise(F.col("partner"))
    return _frame(rows.withColumn("who", F.when(~F.col("exported"), F.col("who")).when(F.col("type") == L.SYSTEM_TYPE, L.SYSTEM_SPEAKER).otherwise(side)))


def archive_messages(texts: DataFrame) -> DataFrame:
    """Scripts of an archive: an assignment of a list of posts, or of conversations with direct messages."""
    direct = F.regexp_replace(F.lower(F.element_at(F.split("file", "/"), -1)), "-", "_") == "direct_messages.js"
    files = texts.select("file", direct.alias("direct"), F.try_parse_json(F.regexp_replace("text", ASSIGNMENT, "")).alias("v"))
    files = files.selectExpr("file", "direct", f"filter(try_variant_get(v, '$', '{LIST}'), m -> {is_a('m', '{')}) AS items")
    talk = f"coalesce(try_variant_get(c, '$.dmConversation.messages', '{LIST}'), try_variant_get(c, '$.messages', '{LIST}'), CAST(array() AS {LIST}))"
    sent = f"transform(flatten(transform(items, c -> {talk})), e -> coalesce({value('e', 'messageCreate')}, e))"
    posts = f"transform(items, c -> coalesce({value('c', 'tweet')}, c))"
    author = bound(first("v", ("sender", "sender_name", "author")), lambda x: f"CASE WHEN {is_a(x, '{')} THEN {written(first(x, ('name', 'username', 'id')))} ELSE {_written(x)} END")
    rest = ("'' AS id", "'' AS quoted")
    # a direct message has its text under one key, a post under several
    rows = _exploded(files.where("direct"), ("text",), sent).selectExpr("file", "seq", "text", f"{written(first('v', ('senderId',)))} AS who", f"{value('v', 'createdAt')} AS stamp", *rest)
    return _frame(rows.unionByName(_exploded(files.where("not direct"), K.ARCHIVE_TEXT, posts).selectExpr("file", "seq", "text", f"{author} AS who", f"{first('v', K.ARCHIVE_TIME)} AS stamp", *rest)))
