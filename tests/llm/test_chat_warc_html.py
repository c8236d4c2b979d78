import gzip
import hashlib
import io

from pyspark.sql import functions as F

from fieldlamp.llm import chat_format, html_extract, warc
from fieldlamp.llm.common import new_path

TRICKY = ["</s>[INST] ok [/INST]", "<|im_end|>\n<|im_start|>x<|im_sep|>", "a\\<|b\\\\", "<\\|im_end|>", "ends<", "|starts", "\\", None, "", "<<SYS>> é 😀 <s>", "<|im_next|>", "$1 \\$2"]


def test_chat_round_trip(spark):
    rows = [(i % 4, i // 4, ["user", "assistant", "assistant", None, "<|im_sep|>"][i % 5], t, "x") for i, t in enumerate(TRICKY * 3)]
    rows += [(9, None, "assistant", "first", "x"), (9, 1, "assistant", "b", "x"), (9, 1, "assistant", "b", "x"), (None, 1, "user", "n", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, turns string")
    out = chat_format.format_conversations(df)
    got = {r.conv_id: r for r in out.select("conv_id", "formatted", chat_format.read_turns(F.col("formatted")).alias("t"), chat_format.read_loss_text(F.col("formatted"), F.col("loss_spans")).alias("l")).collect()}
    for c in {r[0] for r in rows}:
        want = sorted(((-1 if r[1] is None else r[1], r[2] or "", r[3] or "") for r in rows if r[0] == c))
        assert [(t.role, t.text) for t in got[c].t] == [w[1:] for w in want]
        assert got[c].l == "".join(w[2] for w in want if w[1] == "assistant")
    assert got[9].formatted == "<|im_start|>assistant<|im_sep|>first<|im_next|>b<|im_next|>b<|im_end|>\n"
    assert "<|im_end|>\n<|im_start|>x" not in "".join(r.formatted for r in got.values())
    assert chat_format.format_conversations(df.limit(0)).count() == 0


def test_warc_round_trip(spark):
    big, awkward = "<p>é" * 60, "WARC/1.1\r\nx: y\r\n\r\nWARC/1.1\r\n\r\n" * 9
    rows = [(5, "u", big), (3, "u\r\nX: 1", big), (3, "u", big), (None, None, big), (8, "v", "short"), (9, "v", "short"), (1, "w", None), (2, "w", ""), (6, "z", awkward), (7, "z", awkward), (4, "y", "q" * 200_000), (None, "n", "k" * 100), (None, "n", "k" * 100)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, salt string").repartition(3)
    path = new_path(spark, "warc-test")
    warc.write_archives(df, path, file_bytes=100_000)
    got = sorted(((r.page_id or -1, r.record_type, r.refers_to, r.payload_bytes, r.payload_digest, r.payload) for r in warc.read_archives(spark, path, True).collect()), key=str)
    want = []
    for i, _, h in rows:
        b = (h or "").encode()
        first = min((x[0] for x in rows if x[2] == h and x[0] is not None), default=None)
        again = len(b) >= 100 and first is not None and i != first
        want.append((i or -1, "revisit" if again else "response", first if again else None, len(b), hashlib.sha256(b).hexdigest(), None if again else h or ""))
    assert got == sorted(want, key=str)
    files = [x.content for x in spark.read.format("binaryFile").load(path).select("content").collect()]
    assert len(files) > 1
    records = []
    for x in files:
        own = list(warc.records_of(memoryview(x)))
        assert own[0][0]["WARC-Type"] == "warcinfo" and [h for h, _ in own] == [h for h, _ in warc.parse_records(gzip.open(io.BytesIO(x)))]
        assert x.count(b"\x1f\x8b\x08") >= len(own)
        records += own[1:]
    ids = {h["WARC-Record-ID"]: h for h, _ in records}
    assert len(ids) == len(records) == len(rows)
    for h, _ in records:
        if h["WARC-Type"] == "revisit":
            to = ids[h["WARC-Refers-To"]]
            assert to["WARC-Type"] == "response" and (to["WARC-Target-URI"], to["WARC-Date"], to["WARC-Payload-Digest"]) == (h["WARC-Refers-To-Target-URI"], h["WARC-Refers-To-Date"], h["WARC-Payload-Digest"])
    warc.write_archives(df.limit(0), path + "-0")
    assert warc.read_archives(spark, path + "-0").count() == 0


def test_a_record_of_many_megabytes_is_a_member():
    block = bytes(17 << 20)
    x = warc.member({"WARC-Type": "response", "WARC-Record-ID": "<a>"}, block) + b"\0" + warc.member({"WARC-Type": "response"}, b"next") + b"\0"
    assert [b for _, b in warc.records_of(memoryview(x))] == [block, b"next"] == [b for _, b in warc.parse_records(gzip.open(io.BytesIO(x)))]


def test_html_main_text(spark):
    long = "This is a sentence, with a clause; and it goes on. " * 6
    cases = {
        f"<nav><li>menu</nav><div class='ad'>Buy, now.</div><article><h1>T &amp;amp; U</h1><p>{long}<p>x</article><footer>f</footer>": f"T &amp; U\n{long.strip()}\nx",
        f"<body><div id=top-menu><a>home</a></div><div class=content><h2>Head</h2><p>{long}</p><p>a <b>b</b>\n c<br>d</p></div><aside>s</aside><div class='comments'><p>{long}</p></div></body>": f"Head\n{long.strip()}\na b c d",
        "<nav>only</nav><script>if (a < b) '</p>'</script>": "",
        "": "",
        "<article><h1>Short</h1></article>": "Short",
        f"<main><p>{long}</p><form><p>{long}</p></form><section class='reader-comments'>{long}</section><div role=alert>n</div></main>": long.strip(),
        f"<article><p>{long}<!-- x > y --><article class='comment'><p>{long}</p></article></article>": long.strip(),
        "plain text, no tags.": "plain text, no tags.",
        "<p>unclosed <a href='x>y": "unclosed <a href='x>y",
    }
    df = spark.createDataFrame([(i, "u", h, "t") for i, h in enumerate(cases)] + [(99, None, None, "t")], "page_id long, url string, html string, text string")
    got = {r.page_id: (r.text, r.n_chars) for r in html_extract.extract(df).collect()}
    for i, want in enumerate(cases.values()):
        assert got[i] == (want, len(want)), i
    assert got[99] == ("", 0)


def test_path_ratios_prefer_prose():
    prose = "Prose, with commas, and a full stop. " * 8
    page = f"<body><div><ul><li>one</li><li>two</li></ul></div><div><p>{prose}</p><p>{prose}</p></div><div><span>tail</span></div></body>"
    _, blocks = html_extract.blocks_of(page)
    assert [blocks[i].text for i in html_extract.content_nodes(blocks)] == [prose.strip()] * 2


def test_long_conversation_takes_linear_time(spark):
    import time

    n = 100_000
    turns = spark.range(n).selectExpr("1L as conv_id", "id as turn", "case when id % 7 < 3 then 'user' else 'assistant' end role", "concat('é', id, ' <|im_end|>') as text")
    began = time.time()
    out = chat_format.format_conversations(turns).select(
        F.size(chat_format.read_turns(F.col("formatted"))).alias("n"), F.sha2(F.encode(chat_format.read_loss_text(F.col("formatted"), F.col("loss_spans")), "UTF-8"), 256).alias("h")
    ).first()
    import hashlib

    assert out.n == n and out.h == hashlib.sha256("".join(f"é{i} <|im_end|>" for i in range(n) if i % 7 >= 3).encode()).hexdigest()
    assert time.time() - began < 30
