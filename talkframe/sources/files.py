"""Chat exports as a messages frame.

`read(spark, path)` takes a file or a folder. Line formats (queue exports, WhatsApp, generic) are parsed with column
functions over exploded lines, JSON and archive scripts as VARIANT values; other container formats (CSV, mbox, SQLite), and
JSON that is no VARIANT, by a parser per file. conv_id is the file's path.
"""

from __future__ import annotations

import csv
import email.header
import email.utils
import io
import json
import mailbox
import quopri
import re
import sqlite3
import tempfile
from collections.abc import Callable, Iterator
from datetime import UTC, datetime

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from talkframe.functions import lexicon as L
from talkframe.functions import text as X
from talkframe.functions.udfs import html_text
from talkframe.operators.messages import SCHEMA, messages
from talkframe.sources import times, variants
from talkframe.sources.keys import ARCHIVE_TEXT, ARCHIVE_TIME, CSV_ID, CSV_REPLY, CSV_SELF, CSV_SPEAKER, CSV_TEXT, CSV_TIME, JSON_ID, JSON_LISTS, JSON_PERSON, JSON_REPLY, JSON_SPEAKER, JSON_TEXT, JSON_TIME, JSON_TIME_FIRST

ENCODINGS = ("utf-8-sig", "utf-8", "gb18030", "utf-16")
SUFFIXES = ("txt", "csv", "json", "mht", "mhtml", "html", "htm", "js", "mbox")
SQLITE_MAGIC = b"SQLite format 3\x00"
WHATSAPP_TIMES = (
    "d/M/yyyy H:mm:ss", "d/M/yyyy H:mm", "d/M/yy H:mm:ss", "d/M/yy H:mm", "M/d/yyyy h:mm a", "M/d/yy h:mm a", "yyyy-M-d H:mm:ss", "yyyy-M-d H:mm",
)
WHATSAPP_HEAD = r"^\[?(\d{1,4}[/-]\d{1,2}[/-]\d{1,4}),?\s+(\d{1,2}:\d{2}(?::\d{2})?(?:\s*[APap][Mm])?)\]?\s*-?\s*([^:]+):\s*(.*)$"
QUEUE_HEAD = r"^(\d{4}-\d{1,2}-\d{1,2}\s+\d{1,2}:\d{2}(?::\d{2})?)\s+(.+?)(?:\(\d+\)|<[^>]+>)?\s*$"
NAMED_LINE = r"^([^:：\[\]]{1,24})\s*[:：]\s*(.+)$"

Row = tuple[datetime | None, str, str, str, str]


def decode(raw: bytes) -> str | None:
    """By the first encoding of the ladder that fits; UTF-8 before those that take almost anything."""
    for e in ENCODINGS:
        try:
            return raw.decode(e)
        except UnicodeDecodeError:
            continue
    return None


# --- line formats, as column expressions over (file, line_no, line)


def file_lines(texts: DataFrame) -> DataFrame:
    """Lines of texts (file, text)."""
    return texts.select("file", F.posexplode(F.split("text", r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]")).alias("line_no", "line"))


def is_banner(line: Column) -> Column:
    t = X.stripped(line)
    found = (t == "") | (t.rlike(r"^[=\- ]{3,}$"))
    for b in L.BANNER_STARTS:
        found = found | t.startswith(b)
    return found


def _w(*by: str):
    return Window.partitionBy("file", *by).orderBy("line_no")


def parse_queue(texts: DataFrame, default_year: int = 2000) -> DataFrame:
    """A head line with time and name, then lines that are a message each."""
    rows = file_lines(texts).withColumn("line", F.regexp_replace("line", r"\s+$", "")).where(~is_banner(F.col("line")))
    head = F.col("line").rlike(QUEUE_HEAD)
    ts, _ = times.prefix_time(F.regexp_extract("line", QUEUE_HEAD, 1), default_year)
    rows = rows.withColumns({"head": head, "h": F.when(head, F.struct(ts.alias("ts"), F.trim(F.regexp_extract("line", QUEUE_HEAD, 2)).alias("who")))})
    rows = rows.withColumn("h", F.last("h", ignorenulls=True).over(_w())).where("NOT head AND h.who <> ''")
    return messages(rows, conv_id=F.col("file"), seq=F.row_number().over(_w()), ts=F.col("h.ts"), speaker=F.col("h.who"), text=X.stripped("line"))


def parse_whatsapp(texts: DataFrame) -> DataFrame:
    """Head lines with time, name and text; other lines go on with the message before them."""
    rows = file_lines(texts).withColumn("line", X.stripped("line"))
    head = F.col("line").rlike(WHATSAPP_HEAD)
    rows = rows.withColumns({"head": head, "message": F.sum(head.cast("int")).over(_w())}).where("message > 0 AND (head OR line <> '')")
    part = lambda k: F.regexp_extract("line", WHATSAPP_HEAD, k)
    clock = F.upper(F.regexp_replace(F.concat_ws(" ", part(1), part(2)), r"\s+", " "))
    stamped = F.coalesce(*(F.when(clock.rlike(_shape(f)), F.try_to_timestamp(clock, F.lit(f))).cast("timestamp_ntz") for f in WHATSAPP_TIMES))
    said = F.when(F.col("head"), X.stripped(part(4))).otherwise(F.col("line"))
    rows = rows.withColumns({"ts": F.when(F.col("head"), stamped), "who": F.when(F.col("head"), X.stripped(part(3))), "said": said})
    whole = rows.groupBy("file", "message").agg(F.min("line_no").alias("line_no"), F.max("ts").alias("ts"), F.max("who").alias("who"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "said"))), lambda x: x["said"]), "\n").alias("text"))
    whole = whole.where(X.stripped("text") != "")
    return messages(whole, conv_id=F.col("file"), seq=F.row_number().over(_w()), ts=F.col("ts"), speaker=F.col("who"), text=F.col("text"))


def _shape(pattern: str) -> str:
    """What a date must look like for a pattern, so that a two-digit year isn't read with four digits or the other way."""
    sizes = {"yyyy": r"\d{4}", "yy": r"\d{2}", "mm": r"\d{2}", "ss": r"\d{2}", "a": "[AP]M"}
    return "^" + re.sub(r"[A-Za-z]+", lambda m: sizes.get(m[0], r"\d{1,2}"), pattern) + "$"


def parse_generic(texts: DataFrame, default_year: int = 2000) -> DataFrame:
    """`name: text` lines with an optional time; other lines go on with the message before them."""
    rows = file_lines(texts).withColumn("line", X.stripped("line")).where(~is_banner(F.col("line")))
    ts, rest = times.bracketed_time(F.col("line"), default_year)
    rows = rows.withColumns({"stamp": ts, "rest": F.when(ts.isNotNull(), X.stripped(rest)).otherwise(F.col("line"))})
    who = X.stripped(F.regexp_extract("rest", NAMED_LINE, 1))
    named = F.col("rest").rlike(NAMED_LINE) & (F.col("stamp").isNotNull() | (F.length(F.regexp_extract("rest", NAMED_LINE, 1)) <= 20))
    rows = rows.withColumns({"named": named, "message": F.sum(named.cast("int")).over(_w()), "ts": F.last("stamp", ignorenulls=True).over(_w())}).where("message > 0")
    rows = rows.withColumns({"who": F.when(F.col("named"), who), "said": F.when(F.col("named"), X.stripped(F.regexp_extract("rest", NAMED_LINE, 2))).otherwise(F.col("rest"))})
    whole = rows.groupBy("file", "message").agg(F.min("line_no").alias("line_no"), F.min_by("ts", "line_no").alias("ts"), F.max("who").alias("who"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "said"))), lambda x: x["said"]), " ").alias("text"))
    return messages(whole, conv_id=F.col("file"), seq=F.row_number().over(_w()), ts=F.col("ts"), speaker=F.col("who"), text=F.col("text"))


def is_whatsapp(texts: DataFrame) -> DataFrame:
    """Files of which the first line that isn't blank is a WhatsApp head, and at least two lines are."""
    rows = file_lines(texts).withColumn("line", X.stripped("line")).where("line <> ''")
    head = F.col("line").rlike(WHATSAPP_HEAD)
    return rows.groupBy("file").agg(F.min_by(head, "line_no").alias("first"), F.count_if(head).alias("heads")).where("first AND heads >= 2").select("file")


# --- containers, per file


def _first(row: dict, keys: tuple[str, ...]):
    """The first value that isn't empty."""
    return next((row[k] for k in keys if row.get(k)), None)


def _said(value) -> str:
    """Text of a value that may be text, a number, a list of parts, or an object with one."""
    if isinstance(value, str):
        return value.strip()
    if isinstance(value, dict):
        return _said(_first(value, ("text", "content", "body")) or "")
    if isinstance(value, list):
        return "".join(p if isinstance(p, str) else str(_first(p, ("text", "content")) or "") if isinstance(p, dict) else "" for p in value).strip()
    return str(value) if isinstance(value, (int, float)) else ""


def _id(value) -> str:
    return str(value) if isinstance(value, (str, int)) else ""


def _present(row: dict, keys: tuple[str, ...]):
    """The value of the first key that exists, whatever it is."""
    return next((row[k] for k in keys if k in row), "")


def csv_rows(raw: bytes) -> Iterator[Row]:
    text = next((t for e in ENCODINGS[:3] if (t := _try(raw, e)) is not None), None)
    table = [r for r in csv.reader(io.StringIO(text or "", newline="")) if any(c.strip() for c in r)]
    if not table:
        return
    head = [c.strip().lower() for c in table[0]]
    at = {n: next((i for k in keys for i, h in enumerate(head) if k in h), None) for n, keys in (("time", CSV_TIME), ("who", CSV_SPEAKER), ("text", CSV_TEXT), ("self", CSV_SELF), ("id", CSV_ID), ("reply", CSV_REPLY))}
    if at["text"] is None:
        at |= {"time": 0, "who": 1, "text": 2}
    else:
        table = table[1:]
    need = max(at[k] or 0 for k in ("time", "who", "text"))
    for r in table:
        cell = lambda k, r=r: r[at[k]] if at[k] is not None and at[k] < len(r) else ""
        if len(r) <= need or not cell("text").strip():
            continue
        who = cell("who").strip()
        if at["self"] is not None and at["self"] < len(r):
            who = L.SELF_SPEAKER if cell("self").strip().lower() in ("1", "true", "yes") else who or L.OTHER_SPEAKER
        yield times.parse(cell("time")), who or L.UNKNOWN_SPEAKER, cell("text").strip(), cell("id"), cell("reply")


def _try(raw: bytes, encoding: str) -> str | None:
    try:
        return raw.decode(encoding)
    except UnicodeDecodeError:
        return None


def is_private_export(data) -> bool:
    """A desktop export: chat and username on top, and most of the first 50 messages with content, time and type."""
    if not (isinstance(data, dict) and isinstance(data.get("messages"), list) and {"chat", "username"} <= data.keys()):
        return False
    first = [x for x in data["messages"][:50] if isinstance(x, dict)]
    return bool(first) and 2 * sum({"content", "time", "type"} <= x.keys() for x in first) >= len(first)


def json_rows(raw: bytes) -> Iterator[Row]:
    try:
        data = json.loads(raw.decode("utf-8", "ignore"))
    except ValueError:
        return
    rows = data if isinstance(data, list) else next((data[k] for k in JSON_LISTS if isinstance(data.get(k), list)), []) if isinstance(data, dict) else []
    exported = is_private_export(data)
    partner = str(data.get("chat") or "").strip() if exported and not data.get("is_group") else ""
    for r in rows:
        if not isinstance(r, dict) or not (text := _said(_first(r, JSON_TEXT) or "")):
            continue
        who = _first(r, JSON_SPEAKER) or ""
        who = str((_first(who, JSON_PERSON) or "") if isinstance(who, dict) else who).strip()
        if exported:
            system = str(r.get("type", "")).strip() == L.SYSTEM_TYPE
            who = L.SYSTEM_SPEAKER if system else who if not partner else L.SELF_SPEAKER if who else partner
        when = _first(r, JSON_TIME_FIRST[:2]) or r.get("timestamp_ms")
        when = _first(r, JSON_TIME) if when is None else when
        quoted = _present(r, JSON_REPLY)
        quoted = _present(quoted, ("message_id", "id")) if isinstance(quoted, dict) else quoted
        yield times.parse(when), who or L.UNKNOWN_SPEAKER, text, _id(_present(r, JSON_ID)), _id(quoted)


def archive_rows(raw: bytes, name: str = "") -> Iterator[Row]:
    """Scripts of an archive: an assignment of a list of posts, or of conversations with direct messages."""
    try:
        data = json.loads(re.sub(r"^(?:window\.)?[\w.]+\s*=\s*", "", raw.decode("utf-8", "ignore").strip(), count=1))
    except ValueError:
        return
    data = [x for x in data if isinstance(x, dict)] if isinstance(data, list) else []
    if name.lower().rsplit("/", 1)[-1].replace("-", "_") == "direct_messages.js":
        sent = [e.get("messageCreate", e) for c in data for e in c.get("dmConversation", c).get("messages", []) if isinstance(e, dict)]
        data = [{"text": e.get("text"), "sender": e.get("senderId"), "createdAt": e.get("createdAt")} for e in sent]
    else:
        data = [x.get("tweet", x) for x in data]
    for r in data:
        if isinstance(r, dict) and (text := _said(_first(r, ARCHIVE_TEXT) or "")):
            who = _first(r, ("sender", "sender_name", "author"))
            who = _first(who, ("name", "username", "id")) if isinstance(who, dict) else who
            yield times.parse(_first(r, ARCHIVE_TIME)), str(who or L.UNKNOWN_SPEAKER), text, "", ""


def mbox_rows(raw: bytes) -> Iterator[Row]:
    """Subject, blank line and the first plain part of each mail."""
    with tempfile.NamedTemporaryFile(suffix=".mbox") as f:  # mailbox reads files only; it is gone when the task has read it
        f.write(raw)
        f.flush()
        for mail in mailbox.mbox(f.name):
            part = next((p for p in mail.walk() if p.get_content_type() == "text/plain" and p.get_payload(decode=True)), None) if mail.is_multipart() else mail
            body = (part.get_payload(decode=True) or b"").decode(part.get_content_charset() or "utf-8", "replace").strip() if part else ""
            if not body:
                continue
            subject = str(email.header.make_header(email.header.decode_header(mail.get("Subject", ""))))
            try:
                when = email.utils.parsedate_to_datetime(mail["Date"]).replace(tzinfo=None) if mail["Date"] else None
            except (TypeError, ValueError):
                when = None
            yield when, mail.get("From", ""), f"{subject}\n\n{body}" if subject else body, "", ""


def sqlite_rows(raw: bytes, channel: str | None = None) -> Iterator[Row]:
    """Text messages of a MSG table in order of creation."""
    db = sqlite3.connect(":memory:")
    db.deserialize(raw)
    sql = "SELECT StrContent, CreateTime, IsSender, StrTalker FROM MSG WHERE Type = 1" + (" AND StrTalker = ?" if channel else "") + " ORDER BY CreateTime"
    for text, when, mine, talker in db.execute(sql, (channel,) if channel else ()):
        if text := str(text or "").strip():
            yield times.parse(when), L.SELF_SPEAKER if mine == 1 else str(talker or L.OTHER_SPEAKER), text, "", ""
    db.close()


def unwrapped(text: str) -> str:
    """The first part of a MIME envelope, if the text has one; bodies may have lines that begin with dashes."""
    text = text.replace("\r\n", "\n").replace("\r", "\n")
    head = text.split("\n\n", 1)[0]
    bound = re.search(r"^--(\S+)", text, re.M)
    if not re.search(r"^(?:MIME-Version|Content-Type|Content-Transfer-Encoding|From|Subject|Date):", head, re.M) or not bound or not bound[1].rstrip("-"):
        return text
    body = text[bound.end() :]
    own_head = re.search(r"\n[ \t]*\n", body)
    body = body[own_head.end() :] if own_head else body
    return re.split("^--" + re.escape(bound[1].rstrip("-")), body, flags=re.M)[0]


def unquoted(text: str) -> str:
    """Quoted-printable decoded, where there is any."""
    return quopri.decodestring(text.encode("utf-8", "ignore")).decode("utf-8", "ignore") if re.search("=[0-9A-Fa-f]{2}", text) else text


def plain_text(raw: bytes, suffix: str) -> str | None:
    """Decoded text of a file; pages and page archives lose their tags."""
    text = decode(raw)
    if text is not None and suffix in ("mht", "mhtml"):
        text = unquoted(unwrapped(text))
    return html_text(text) if text is not None and suffix in ("mht", "mhtml", "html", "htm") else text


CONTAINERS: dict[str, Callable] = {"csv": csv_rows, "json": json_rows, "js": archive_rows, "mbox": mbox_rows, "sqlite": sqlite_rows}


def _kind(path: str, raw: bytes) -> str:
    suffix = path.lower().rsplit(".", 1)[-1]
    if suffix in ("db", "sqlite", "sqlite3") or raw[:16] == SQLITE_MAGIC:
        return "sqlite"
    return suffix if suffix in CONTAINERS else "text"


def _files(spark: SparkSession, path: str) -> DataFrame:
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    if spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(spark._jvm.org.apache.hadoop.fs.Path(path)).isDirectory():
        df = df.where(F.lower(F.element_at(F.split("path", r"\."), -1)).isin(*SUFFIXES))
    return df.select(F.col("path").alias("file"), "content")


def contained_messages(files: DataFrame, channel: str | None = None) -> DataFrame:
    """Messages of container files (file, content), each parsed by one task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for file, raw in zip(pdf["file"], pdf["content"], strict=True):
                kind, raw = _kind(file, bytes(raw)), bytes(raw)
                if kind != "text":
                    args = (channel,) if kind == "sqlite" else (file,) if kind == "js" else ()
                    out += [(file, n, *r) for n, r in enumerate(CONTAINERS[kind](raw, *args), 1)]
            yield pd.DataFrame(out, columns=SCHEMA.names)

    return files.mapInPandas(run, SCHEMA)


def texts_of(files: DataFrame) -> DataFrame:
    """(file, text) of the other files that can be decoded."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(f, plain_text(bytes(c), f.lower().rsplit(".", 1)[-1])) for f, c in zip(pdf["file"], pdf["content"], strict=True) if _kind(f, bytes(c)) == "text"]
            yield pd.DataFrame([r for r in rows if r[1] is not None], columns=["file", "text"])

    return files.mapInPandas(run, "file string, text string")


def read(spark: SparkSession, path: str, channel: str | None = None, default_year: int = 2000) -> DataFrame:
    """All messages under a path, media marks normalised.

    Text files are queue exports if that parser finds five messages and more, else WhatsApp exports if their heads say
    so, else generic.
    """
    files = _files(spark, path)
    texts = texts_of(files)
    queue = parse_queue(texts, default_year)
    as_queue = queue.groupBy("conv_id").agg(F.count("*").alias("n"), F.bool_or(F.col("speaker") != L.UNKNOWN_SPEAKER).alias("known")).where("n >= 5 AND known").select(F.col("conv_id").alias("file"))
    left = texts.join(as_queue, "file", "left_anti")
    chats = is_whatsapp(left)
    suffix = F.lower(F.element_at(F.split("file", r"\."), -1))
    structured = suffix.isin("json", "js") & (F.substring("content", 1, len(SQLITE_MAGIC)) != F.lit(SQLITE_MAGIC))
    said = files.where(structured).select("file", suffix.alias("suffix"), F.try_validate_utf8(F.col("content").cast("string")).alias("text"))
    whole = files.where(~structured | ~variants.readable(F.try_validate_utf8(F.col("content").cast("string")), suffix == "js"))
    parts = [
        contained_messages(whole, channel), variants.json_messages(said.where("suffix = 'json'")), variants.archive_messages(said.where("suffix = 'js'")), queue.join(as_queue.withColumnRenamed("file", "conv_id"), "conv_id", "left_semi"),
        parse_whatsapp(left.join(chats, "file", "left_semi")), parse_generic(left.join(chats, "file", "left_anti"), default_year),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumn("text", X.normalized("text"))


def diagnose(spark: SparkSession, path: str, default_year: int = 2000) -> DataFrame:
    """What each parser finds in each file: messages, speakers, messages with a time."""
    files = _files(spark, path)
    texts = texts_of(files)
    found = {"container": contained_messages(files), "queue": parse_queue(texts, default_year), "whatsapp": parse_whatsapp(texts), "generic": parse_generic(texts, default_year)}
    out = None
    for name, df in found.items():
        one = df.groupBy(F.col("conv_id").alias("file")).agg(F.count("*").alias("messages"), F.count_distinct("speaker").alias("speakers"), F.count("ts").alias("with_ts")).withColumn("parser", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out
