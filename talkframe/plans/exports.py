"""Exports written from the tables and read back by the sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from talkframe.functions import lexicon as L
from talkframe.plans.base import query, table
from talkframe.sources import variants

BLOCK = 64  # messages of a conversation in one export


def blocks(spark, sf, message):
    """One row for each block of a conversation: conv, block, items (the JSON of each message, joined by commas)."""
    c = table(spark, sf, "conversations").select(F.col("conv_id").alias("conv"), "turn", "role", "text", F.floor(F.col("turn") / BLOCK).alias("block"))
    one = F.to_json(message(c))
    return c.groupBy("conv", "block").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", one.alias("item")))), lambda x: x["item"]), ",").alias("items"))


def _stamp():
    return F.date_format(F.timestamp_seconds(1_700_000_000 + 60 * F.col("turn")), "yyyy-MM-dd'T'HH:mm:ss'Z'")


FILE = "concat(conv_id, '-', turn // 64"
SAID = r"regexp_replace(text, '^[ \t\n\x0B\f\r]+|[ \t\n\x0B\f\r]+$', '', 'g')"
ORDER = "row_number() OVER (PARTITION BY conv_id, turn // 64 ORDER BY turn) AS seq"
AT = "TIMESTAMP '2023-11-14 22:13:20' + to_seconds(CAST(60 * turn AS BIGINT)) AS ts"


@query(f"""SELECT {FILE}, '.json') AS conv_id, {ORDER}, {AT}, coalesce(nullif(trim(role), ''), '{L.UNKNOWN_SPEAKER}') AS speaker, {SAID} AS text,
    CAST(turn AS VARCHAR) AS source_id, CASE WHEN turn > 0 THEN CAST(turn - 1 AS VARCHAR) ELSE '' END AS reply_to FROM conversations WHERE {SAID} <> ''""")
def s03_json_exports(spark, sf):
    """Lists, and objects with a list under two keys; texts and names stand in objects, times are numbers or text."""
    turn = F.col("turn")

    def message(c):
        seconds = 1_700_000_000 + 60 * turn
        quoted = F.when(turn > 0, F.struct((turn - 1).alias("message_id")))
        return F.struct(turn.alias("id"), F.struct(F.col("role").alias("nickname")).alias("from"), F.struct(F.struct(F.col("text").alias("content")).alias("body")).alias("text"), seconds.alias("date"), quoted.alias("reply_to"))

    kind = F.col("conv") % 3
    text = F.when(kind == 0, F.concat(F.lit("["), "items", F.lit("]"))).when(kind == 1, F.concat(F.lit('{"data": 7, "items": ['), "items", F.lit("]}"))).otherwise(F.concat(F.lit('{"posts": ['), "items", F.lit(', {"text": ""}, 3, null]}')))
    return variants.json_messages(blocks(spark, sf, message).select(F.concat_ws("-", "conv", F.concat("block", F.lit(".json"))).alias("file"), text.alias("text")))


@query(f"""SELECT {FILE}, '.json') AS conv_id, {ORDER}, {AT}, CASE WHEN turn % 7 = 6 THEN '{L.SYSTEM_SPEAKER}' WHEN role = 'assistant' THEN '{L.SELF_SPEAKER}' ELSE 'friend' END AS speaker,
    {SAID} AS text, '' AS source_id, '' AS reply_to FROM conversations WHERE {SAID} <> ''""")
def s04_private_exports(spark, sf):
    """Desktop exports, in which only their owner's messages name a sender."""
    def message(c):
        return F.struct(F.col("text").alias("content"), F.when(F.col("role") == "assistant", "me").otherwise("").alias("sender"), _stamp().alias("time"), F.when(F.col("turn") % 7 == 6, L.SYSTEM_TYPE).otherwise("文本").alias("type"))

    text = F.concat(F.lit('{"chat": "friend", "username": "u", "is_group": false, "messages": ['), "items", F.lit("]}"))
    return variants.json_messages(blocks(spark, sf, message).select(F.concat_ws("-", "conv", F.concat("block", F.lit(".json"))).alias("file"), text.alias("text")))


@query(f"""SELECT {FILE}, CASE WHEN conv_id % 2 = 0 THEN '/direct-messages.js' ELSE '/tweets.js' END) AS conv_id, {ORDER}, {AT},
    CASE WHEN conv_id % 2 = 0 THEN coalesce(role, '{L.UNKNOWN_SPEAKER}') ELSE '{L.UNKNOWN_SPEAKER}' END AS speaker, {SAID} AS text, '' AS source_id, '' AS reply_to FROM conversations WHERE {SAID} <> ''""")
def s09_archive_scripts(spark, sf):
    """Scripts of posts and of direct messages."""
    def message(c):
        direct = F.struct(F.struct("text", F.col("role").alias("senderId"), _stamp().alias("createdAt")).alias("messageCreate"))
        post = F.struct(F.struct(F.col("text").alias("full_text"), _stamp().alias("created_at")).alias("tweet"))
        return F.struct(F.when(F.col("conv") % 2 == 0, direct["messageCreate"]).alias("messageCreate"), F.when(F.col("conv") % 2 != 0, post["tweet"]).alias("tweet"))

    direct = F.col("conv") % 2 == 0
    text = F.when(direct, F.concat(F.lit('window.YTD.messages.part0 = [{"dmConversation": {"messages": ['), "items", F.lit("]}}]"))).otherwise(F.concat(F.lit("window.YTD.tweets.part0 = ["), "items", F.lit("]")))
    name = F.when(direct, F.lit("/direct-messages.js")).otherwise(F.lit("/tweets.js"))
    return variants.archive_messages(blocks(spark, sf, message).select(F.concat(F.concat_ws("-", "conv", "block"), name).alias("file"), text.alias("text")))
