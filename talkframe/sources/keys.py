"""Columns and keys of exports in order of preference."""

CSV_TIME = ("strtime", "createtime", "time", "date", "时间", "日期")
CSV_SPEAKER = ("nickname", "remark", "昵称", "备注", "sendername", "sender", "发送", "name", "talker", "用户", "from")
CSV_TEXT = ("strcontent", "content", "text", "消息", "内容", "正文", "displaycontent", "msg")
CSV_SELF = ("issender", "is_sender")
CSV_ID = ("message_id", "msgid", "localid", "消息id")
CSV_REPLY = ("reply_to", "replytomsgid", "引用id")
JSON_LISTS = ("messages", "list", "items", "posts", "comments", "statuses", "data")
JSON_TEXT = ("text", "body", "content", "message", "post", "full_text", "msg")
JSON_SPEAKER = ("speaker", "sender", "sender_name", "author", "user", "talker", "name", "from", "actor")
JSON_PERSON = ("name", "remark", "nickname", "uin", "uid")
JSON_TIME_FIRST = ("created_at", "createdAt", "timestamp_ms")
JSON_TIME = ("time", "timestamp", "date")
JSON_ID = ("source_id", "message_id", "id", "msgid")
JSON_REPLY = ("reply_to_message_id", "reply_to", "replyTo")
ARCHIVE_TEXT = ("text", "full_text", "body", "content", "message", "post")
ARCHIVE_TIME = ("createdAt", "created_at", "timestamp_ms", "timestamp", "date", "time")
