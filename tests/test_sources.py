import json
import mailbox
import re
import sqlite3
from datetime import datetime

import pytest

from talkframe.functions import udfs
from talkframe.sources import files as S
from talkframe.sources import times


def rows(spark, path, **kw):
    return [(r["ts"], r["speaker"], r["text"]) for r in S.read(spark, str(path), **kw).orderBy("conv_id", "seq").collect()]


def test_csv_headers_and_encodings(spark, tmp_path):
    a, b = tmp_path / "a.csv", tmp_path / "b.csv"
    a.write_bytes("StrTime,NickName,StrContent,IsSender,MsgId\n2024-03-01 09:00:05,小雨,早,0,7\n2024/3/1 9:05,小雨,来了,1,8\n,,  ,0,9\n".encode("gb18030"))
    b.write_text("2024-03-01T09:00,Ann,hello\n", encoding="utf-8-sig")
    assert rows(spark, a) == [(datetime(2024, 3, 1, 9, 0, 5), "小雨", "早"), (datetime(2024, 3, 1, 9, 5), "我", "来了")]
    assert rows(spark, b) == [(datetime(2024, 3, 1, 9), "Ann", "hello")]


def test_json_shapes(spark, tmp_path):
    p = tmp_path / "a.json"
    p.write_text(json.dumps([{"id": 1, "from": {"nickname": "n"}, "text": ["a", {"text": "b"}], "date": 1709283600}, {"body": 5, "time": "2024-03-01 09:00", "reply_to": {"id": 1}}, {"text": ""}, 3]))
    got = S.read(spark, str(p)).orderBy("seq").collect()
    assert [(r["speaker"], r["text"], r["source_id"], r["reply_to"]) for r in got] == [("n", "ab", "1", ""), ("未知", "5", "", "1")]
    assert got[0]["ts"] == datetime(2024, 3, 1, 9)
    p.write_text(json.dumps({"chat": "小雨", "username": "u", "messages": [{"content": "hi", "time": "", "type": "文本", "sender": "me"}, {"content": "yo", "time": "", "type": "文本", "sender": ""}, {"content": "撤回", "time": "", "type": "系统", "sender": ""}]}))
    assert [r[1] for r in rows(spark, p)] == ["我", "小雨", "系统消息"]


def test_line_formats(spark, tmp_path):
    q, w, g = tmp_path / "q.txt", tmp_path / "w.txt", tmp_path / "g.txt"
    q.write_text("消息记录\n====\n2024-03-01 09:00:00 小雨(10001)\n一\n二\n2024-03-01 9:01 阿木<x@y>\n三\n四\n五\n")
    w.write_text("01/02/2024, 09:00 - Ann: hi\nsecond\n1/13/24, 9:05 PM - Bob: yo\n")
    g.write_text("[2024-03-01 09:00] a: one\ngoes on\nb：two\n12-31 10:00 a: no year\n")
    assert [(r[0].minute, r[1], r[2]) for r in rows(spark, q)] == [(0, "小雨", "一"), (0, "小雨", "二"), (1, "阿木", "三"), (1, "阿木", "四"), (1, "阿木", "五")]
    assert rows(spark, w) == [(datetime(2024, 2, 1, 9), "Ann", "hi\nsecond"), (datetime(2024, 1, 13, 21, 5), "Bob", "yo")]
    assert rows(spark, g, default_year=2023) == [(datetime(2024, 3, 1, 9), "a", "one goes on"), (datetime(2024, 3, 1, 9), "b", "two"), (datetime(2023, 12, 31, 10), "a", "no year")]


def test_containers(spark, tmp_path):
    db = tmp_path / "m.db"
    con = sqlite3.connect(db)
    con.execute("CREATE TABLE MSG (StrContent, CreateTime, IsSender, StrTalker, Type)")
    con.executemany("INSERT INTO MSG VALUES (?, ?, ?, ?, ?)", [("second", 1709283660000, 0, "t1", 1), ("first", 1709283600, 1, "t1", 1), ("other", 1, 0, "t2", 1), ("pic", 1, 0, "t1", 3)])
    con.commit()
    con.close()
    assert rows(spark, db, channel="t1") == [(datetime(2024, 3, 1, 9), "我", "first"), (datetime(2024, 3, 1, 9, 1), "t1", "second")]
    js = tmp_path / "tweets.js"
    js.write_text('window.YTD.tweets.part0 = [{"tweet": {"full_text": "hello", "created_at": "2024-03-01T09:00:00Z"}}]')
    dm = tmp_path / "direct-messages.js"
    dm.write_text('window.YTD.x = [{"dmConversation": {"messages": [{"messageCreate": {"text": "yo", "senderId": "9", "createdAt": "2024-03-01T09:00:00.000Z"}}]}}]')
    assert rows(spark, js) == [(datetime(2024, 3, 1, 9), "未知", "hello")] and rows(spark, dm) == [(datetime(2024, 3, 1, 9), "9", "yo")]
    box = mailbox.mbox(tmp_path / "x.mbox")
    mail = mailbox.mboxMessage()
    mail["From"], mail["Subject"], mail["Date"] = "a@b.c", "Hi", "Fri, 01 Mar 2024 09:00:00 +0000"
    mail.set_payload("body\n")
    box.add(mail)
    box.flush()
    assert rows(spark, tmp_path / "x.mbox") == [(datetime(2024, 3, 1, 9), "a@b.c", "Hi\n\nbody")]


def test_page_archives(spark, tmp_path):
    p = tmp_path / "a.mht"
    p.write_text('MIME-Version: 1.0\nContent-Type: multipart/related; boundary="x"\n\n--xx\nContent-Type: text/html\n\n<div>a: one=20two</div><p>b: -- three</p>\n--xx--\nrest: gone\n')
    assert [(s, t) for _, s, t in rows(spark, p)] == [("a", "one two"), ("b", "-- three")]
    assert udfs.html_text("<p>a&nbsp;&amp; b</p><br>c") == "\na & b\n\nc"


def test_folder_and_diagnosis(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub/a.txt").write_text("a: 1\nb: 2\n")
    (tmp_path / "b.json").write_text('[{"text": "x", "name": "n"}]')
    (tmp_path / "skip.db").write_bytes(b"SQLite format 3\x00")
    assert sorted(r[2] for r in rows(spark, tmp_path)) == ["1", "2", "x"]
    found = {(r["file"].rsplit("/", 1)[-1], r["parser"]): r["messages"] for r in S.diagnose(spark, str(tmp_path)).collect()}
    assert found[("a.txt", "generic")] == 2 and found[("b.json", "container")] == 1


def test_times():
    assert times.parse(1709283600) == datetime(2024, 3, 1, 9) == times.parse(1709283600000)
    assert times.parse("2024年3月1日 9:05:61") == datetime(2024, 3, 1, 9, 5, 59) and times.parse("3-1 09:05", 2020) == datetime(2020, 3, 1, 9, 5)
    assert times.parse("1960-01-01 00:00") is None or times.parse("1960-01-01 00:00").year == 1960
    assert times.parse("") is times.parse(None) is times.parse("soon") is times.parse(-5) is None


@pytest.mark.parametrize("page", ["<p>a&nbsp;&amp; b</p><br>c", "<!DOCTYPE html><title>t</title><script>var t=\"</p>\"; a < b</script><style>p{margin:0}</style>x", "a < b <i title='x>y'>c</i> <!-- <p> --> d &copy &#8364; &middot;", "<TD>1<Td/>2<table\n x>3<px>4</px>", "", "plain & simple"])
def test_page_text_equals_the_parser(page):
    from html.parser import HTMLParser

    out = []
    parser = HTMLParser(convert_charrefs=True)
    parser.handle_data = out.append
    parser.handle_starttag = lambda tag, attrs: out.append("\n" * (tag in udfs.L.BLOCK_TAGS))
    parser.handle_endtag = lambda tag: out.append("\n" * (tag in udfs.L.BLOCK_TAGS))
    parser.feed(page)
    parser.close()
    want = re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+", " ", "".join(out).replace("\xa0", " ")))
    assert udfs.html_text(page) == want


def test_claim_forms():
    known = frozenset({"小雨"})
    assert udfs.without_citation("[09-21 01:05] 小雨: 早点睡吧", known) == "早点睡吧" and udfs.without_citation("他说: 我不去", known) == "他说: 我不去"
    assert udfs.without_citation("2024-03-15 【x】 小雨：小雨: 好", known) == "好" and udfs.without_citation("小雨:", known) == "小雨:"
    assert udfs.needles("2024-03-15 小雨: 早点睡吧", known) == ["20240315小雨早点睡吧", "早点睡吧", "小雨早点睡吧"]
    assert udfs.needles("a b c d e f g h", frozenset()) == ["abcdefgh", "gh", "fgh", "efgh", "defgh"]


def test_variants_equal_the_parser_by_file(spark):
    """Every shape that both read gives the same messages, and broken files give none."""
    from talkframe.sources import variants

    shapes = [
        {"messages": [{"text": "  a\n"}, {"text": 5}, {"text": 5.0}, {"text": True}, {"text": False, "body": "b"}, {"text": 0, "content": 0.5}, {"text": None, "msg": "m"}]},
        {"messages": 3, "data": [{"text": ["x", 1, {"text": "", "content": "y"}, {"text": 7}, None]}, {"text": {"text": {"body": "deep"}}}, {"text": {}}, "s", None, []]},
        [{"text": "t", "from": {"uin": 12}, "date": 1709283600}, {"text": "t", "sender": "", "author": {"name": "", "remark": " r "}, "timestamp_ms": 1709283600123}],
        [{"text": "t", "user": 3, "created_at": "", "time": "2024年3月1日 9:05"}, {"text": "t", "timestamp_ms": 0, "date": "2024-03-01"}, {"text": "t", "date": "2024-03-01T09:00:00+08:00"}, {"text": "t", "date": "soon"}, {"text": "t", "date": -4}],
        [{"text": "t", "id": 5, "reply_to": None, "reply_to_message_id": "9"}, {"text": "t", "id": 5.5, "reply_to": {"message_id": 3}}, {"text": "t", "source_id": True, "replyTo": [1]}],
        {"chat": "c", "username": "u", "messages": [{"content": "1", "time": "", "type": 1, "sender": "me"}, {"content": "2", "time": "", "type": "系统"}, {"content": "3"}]},
        {"chat": "c", "username": "u", "is_group": True, "messages": [{"content": "1", "time": "2024-03-01 09:00:05", "type": 1, "sender": "x"}, {"content": "2", "time": "", "type": 1}]},
        {"chat": "c", "messages": []}, {}, [], 3, "s", None,
    ]
    made = [(f"{i}.json", json.dumps(s)) for i, s in enumerate(shapes)] + [("b1.json", "{"), ("b2.json", ""), ("b3.json", None)]
    got = variants.json_messages(spark.createDataFrame(made, "file string, text string")).collect()
    want = [(f, n, *r) for f, t in made if t is not None for n, r in enumerate(S.json_rows(t.encode()), 1)]
    assert sorted(map(tuple, got), key=lambda r: r[:2]) == sorted(want, key=lambda r: r[:2])
    scripts = [
        ("x/tweets.js", 'window.YTD.t.part0 = [{"tweet": {"full_text": "a", "author": {"username": "u"}}}, {"text": "b", "sender": "s", "date": 1709283600}, {"tweet": {"text": ""}}, 4]'),
        ("x/Direct-Messages.js", 'YTD = [{"dmConversation": {"messages": [{"messageCreate": {"text": "a", "senderId": "1"}}, {"text": "b", "senderId": 2}]}}, {"messages": [{"text": "c"}]}, {}]'),
        ("x/none.js", "var x = 1"), ("x/null.js", None),
    ]
    got = variants.archive_messages(spark.createDataFrame(scripts, "file string, text string")).collect()
    want = [(f, n, *r) for f, t in scripts if t is not None for n, r in enumerate(S.archive_rows(t.encode(), f), 1)]
    assert sorted(map(tuple, got), key=lambda r: r[:2]) == sorted(want, key=lambda r: r[:2])


def test_json_that_is_no_variant_is_read_by_file(spark, tmp_path):
    p = tmp_path / "a.json"
    p.write_text('[{"text": "old", "text": "new", "from": "a"}]')
    assert rows(spark, p) == [(None, "a", "new")]


def test_page_query_reads_terminated_references_only(spark, tmp_path):
    import duckdb

    from talkframe.plans import registry

    pages = [(1, "<title>a &amp;&amp;&amp; b&amp</title><p>c &am</p>"), (2, "<h1>x &lt;y&gt; &lt z &copy;&middot</h1>&amp;lt;"), (3, "&quot;q&quot;&quot")]
    spark.createDataFrame(pages, "page_id long, html string").coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    got = sorted(tuple(r) for r in registry.QUERIES["s11_html_text"](spark, str(tmp_path)).collect())
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    assert got == sorted(con.execute(registry.ORACLE_SQL["s11_html_text"]).fetchall())
    assert udfs.terminated("&nope; &#8364; &#x41; &notit; &not;") == "&nope; \u20ac A &notit; \xac"
