"""Registration of queries, adapters of the tables, and their SQL forms."""

from __future__ import annotations

import re
from collections.abc import Callable
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession

from talkframe.operators import messages as M

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function of (spark, sf_dir) under its name, with the DuckDB SQL of the same rows."""

    def keep(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = with_ctes(sql)
        return f

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ev(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.from_events(table(spark, sf_dir, "events"))


def cv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.from_conversations(table(spark, sf_dir, "conversations"))


def dv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.from_documents(table(spark, sf_dir, "documents"))


def _zh_rows() -> list[tuple]:
    """A small chat: sessions, bursts, media, emoji, a third speaker, explicit replies, missing times, a time that goes back."""
    day = datetime(2024, 3, 1, 9, 0)
    said = [
        (0, "小雨", "今天有空吗"), (1, "阿木", "有啊"), (1, "阿木", "要不要去滨江公园"), (2, "小雨", "好啊 一起去"), (3, "阿木", "说定了 等我"), (33, "小雨", "好了 我到公园门口了"), (63, "阿木", "收到 等会就到"),
        (1500, "小雨", "报告写完了吗 快截止了"), (1501, "阿木", "别催 知道了"), (1502, "小雨", "[图片]"), (1503, "阿木", "[偷笑] 哈哈哈"), (1504, "小雨", "谢谢你帮我改"), (1506, "阿木", "请我喝奶茶"), (1507, "小雨", "没问题 宝贝"),
        (20160 + 60, "小雨", "你上次说好的那次呢"), (20160 + 61, "阿木", "那是上周的事"), (20160 + 62, "路人", "我也想去学校看看"), (20160 + 64, "小雨", "早点睡 别熬夜"), (20160 + 70, "阿木", "嗯嗯 晚安 我想你了"),
        (20160 + 900, "阿木", "烦死了 你又放鸽子"), (20160 + 901, "小雨", "对不起 别生气"), (20160 + 902, "阿木", "算了 行吧"), (20160 + 903, "小雨", "抱抱 下次一定"), (20160 + 904, "阿木", "下次一定！"),
        (40000, "小雨", "谢谢你来接我"), (40001, "阿木", "没事 小事"), (40002, "小雨", "快写报告"), (40003, "阿木", "别催"), (40004, "阿木", "等下就写"), (39000, "小雨", "这是补发的"), (39001, "阿木", "收到"),
        (None, "小雨", "没有时间的消息"), (39010, "阿木", "下次一定"), (39013, "小雨", "电话 13800138000 邮箱 a.b@c.org"), (39014, "阿木", "[回复消息: 电话] 记下了"),
        (39200, "阿木", "真的假的？"), (39200, "小雨", "真的"), (39201, "阿木", "那就说定"), (39229, "小雨", "恭喜你通过了"), (39230, "阿木", "我也没想到~"),
    ]
    rows = [("zh", i, None if at is None else day + timedelta(minutes=at), who, text, f"m{i}", "") for i, (at, who, text) in enumerate(said, 1)]
    rows += [("zh", len(rows) + 1, day + timedelta(minutes=39300), "小雨", "明天几点集合", "q1", ""), ("zh", len(rows) + 2, day + timedelta(minutes=39301), "路人", "我不去", "q2", "")]
    rows += [("zh", len(rows) + 1, day + timedelta(minutes=39302), "阿木", "八点", "q3", "q1"), ("zh", len(rows) + 2, day + timedelta(minutes=39303), "阿木", "老地方", "q4", "")]
    return rows


ZH = _zh_rows()
SIDES = [("zh", "阿木", "小雨")]


def zh(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ZH, M.SCHEMA)


def sides(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SIDES, "conv_id string, target string, counterpart string")


def chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The conversations of the table and the small chat."""
    return cv(spark, sf_dir).unionByName(zh(spark))


def chat_sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assistants answer users; the small chat has its own sides."""
    from pyspark.sql import functions as F

    ids = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("conv_id")).distinct()
    return ids.select("conv_id", F.lit("assistant").alias("target"), F.lit("user").alias("counterpart")).unionAll(sides(spark))


def literal(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, datetime):
        return f"TIMESTAMP '{v:%Y-%m-%d %H:%M:%S}'"
    return str(v) if isinstance(v, (int, float)) else "'" + str(v).replace("'", "''") + "'"


def values(name: str, columns: str, rows: list[tuple]) -> str:
    return f"{name}({columns}) AS (VALUES " + ", ".join("(" + ", ".join(map(literal, r)) + ")" for r in rows) + ")"


def words_re(words) -> str:
    from talkframe.functions.text import alternation

    return literal(alternation(words))


def any_like(column: str, words) -> str:
    return "(" + " OR ".join(f"contains({column}, {literal(w)})" for w in dict.fromkeys(words)) + ")"


def _sessions(name: str, of: str) -> str:
    return (
        f"{name} AS (SELECT * EXCLUDE (p, o), CAST(sum(o) OVER (PARTITION BY conv_id ORDER BY seq) AS BIGINT) AS session_id FROM (SELECT *, "
        f"CASE WHEN ts IS NOT NULL AND p IS NOT NULL AND (ts < p OR ts > p + INTERVAL 30 MINUTE) THEN 1 ELSE 0 END AS o FROM (SELECT *, "
        f"last_value(ts IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM {of})))"
    )


def _runs(name: str, of: str) -> str:
    return (
        f"{name} AS (SELECT * EXCLUDE (c), CAST(sum(c) OVER (PARTITION BY conv_id, session_id ORDER BY seq) AS BIGINT) AS run_id FROM (SELECT *, "
        f"CASE WHEN lag(speaker) OVER (PARTITION BY conv_id, session_id ORDER BY seq) <> speaker THEN 1 ELSE 0 END AS c FROM {of}))"
    )


def _gaps(name: str, of: str) -> str:
    return (
        f"{name} AS (SELECT conv_id, seq, speaker, g AS gap FROM (SELECT *, (epoch_us(ts) - epoch_us(lag(ts) OVER w)) / 60e6 AS g, lag(speaker) OVER w AS ps FROM {of} "
        f"WINDOW w AS (PARTITION BY conv_id ORDER BY seq)) WHERE ps <> speaker AND g BETWEEN 0 AND 30)"
    )


CTES = {
    "ev": "ev AS (SELECT CAST(user_id // 10 AS VARCHAR) AS conv_id, row_number() OVER (PARTITION BY user_id // 10 ORDER BY ts, event_id) AS seq, ts, event_type AS speaker, props AS text, CAST(event_id AS VARCHAR) AS source_id, '' AS reply_to FROM events)",
    "cv": "cv AS (SELECT CAST(conv_id AS VARCHAR) AS conv_id, turn + 1 AS seq, CAST(NULL AS TIMESTAMP) AS ts, role AS speaker, text, '' AS source_id, '' AS reply_to FROM conversations)",
    "dv": "dv AS (SELECT source AS conv_id, doc_id AS seq, CAST(NULL AS TIMESTAMP) AS ts, lang AS speaker, text, '' AS source_id, '' AS reply_to FROM documents)",
    "zh": values("zh", "conv_id, seq, ts, speaker, text, source_id, reply_to", ZH),
    "chats": "chats AS (SELECT * FROM cv UNION ALL SELECT * FROM zh)",
    "sides": "sides AS (SELECT DISTINCT CAST(conv_id AS VARCHAR) AS conv_id, 'assistant' AS target, 'user' AS counterpart FROM conversations UNION ALL SELECT 'zh', '阿木', '小雨')",
    "ev_s": _sessions("ev_s", "ev"), "ch_s": _sessions("ch_s", "chats"), "ev_r": _runs("ev_r", "ev_s"), "ch_r": _runs("ch_r", "ch_s"), "ev_g": _gaps("ev_g", "ev"), "ch_g": _gaps("ch_g", "chats"),
}
_NEEDS = {"chats": ("cv", "zh"), "ev_s": ("ev",), "ch_s": ("chats",), "ev_r": ("ev_s",), "ch_r": ("ch_s",), "ev_g": ("ev",), "ch_g": ("chats",)}


def with_ctes(sql: str) -> str:
    """The SQL with the shared expressions that it names in front."""
    order: list[str] = []

    def need(name: str) -> None:
        for n in _NEEDS.get(name, ()):
            need(n)
        if name not in order:
            order.append(name)

    for name in CTES:
        if re.search(rf"(?<![\w.']){name}(?![\w.'(])", sql) and not re.search(rf"(?:^|WITH|,)\s*{name} AS \(", sql):
            need(name)
    if not order:
        return sql
    head = ",\n".join(CTES[n] for n in order)
    body = sql.strip()
    return f"WITH {head},\n{body[4:].strip()}" if body.upper().startswith("WITH") else f"WITH {head}\n{body}"
