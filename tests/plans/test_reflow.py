import random
import re

from pyspark.sql import functions as F

from fieldlamp.operators import reflow as R

PAGES = """CHAPTER ONE
IN THE WOODS

The first thing to learn is wood-
craft, which is fore-and-
aft of everything else that we shall learn in
this book about living
under it.
A new paragraph begins after a short line that ends its
sentence and goes on
\f
over the page where it ends at last in a full line.

Fig. 3. A tent in the rain

• first item that is long enough to be a whole line
which goes on in lower case
• second
The prose after the list begins with a capital letter and
- this dash is inside a sentence that goes on
2. Choosing a Site

Text under a numbered heading that is of the usual width
Fig. 4. Floats out of it
and goes on under the picture with more of its words.
1. Turn off the gas
2. Turn off the water
\x08lower case never starts a paragraph."""


def sequential(lines):
    """Blocks of [(page, line)] by one walk."""
    width = {}
    for page in {p for p, _ in lines}:
        sizes = sorted(len(x) for p, x in lines if p == page and x)
        width[page] = sizes[len(sizes) // 2] if sizes else None
    ends = lambda s: bool(re.search(R.TERMINAL, s))

    def title(s):
        letters = [c for c in s if c.isalpha()]
        if len(s) > 90 or re.search("[.,;]$", s) or re.search(R.MARKED_ITEM, s) or len(letters) < 3:
            return ""
        caps = sum(c.isupper() for c in letters) / len(letters)
        return "h1" if re.search(R.DIVISION, s) or (caps > 0.85 and len(letters) >= 4) else "h2" if re.search(R.NUMBERED_TITLE, s) and len(s.split()) <= 12 else ""

    def before(i, title_of):
        """(line, its title, is it numbered, has its block ended, is there a blank or page between) of the text before line i."""
        page, _ = lines[i]
        j = next((j for j in range(i - 1, -1, -1) if lines[j][1] and not caption(lines[j][1])), None)
        if j is None:
            return None, "", False, True, False
        p_page, p = lines[j]
        between = lines[j + 1 : i]
        gap = bool(between) and not between[0][1] and between[0][0] == p_page
        blank = gap and not any(x for _, x in between)
        closed = (ends(p) and len(p) < 0.55 * width[p_page]) or (ends(p) or blank if p_page != page else blank and not p.endswith("-"))
        return p, title_of(j), bool(re.search(R.NUMBERED_ITEM, p)), closed, gap or p_page != page

    def real_title(i):
        s = lines[i][1]
        p, p_title, p_number, closed, _ = before(i, lambda j: title(lines[j][1]))
        following = next((x for _, x in lines[i + 1 :] if x), "")
        t = title(s)
        among = t == "h2" and re.search(R.NUMBERED_ITEM, s) and (re.search(R.NUMBERED_ITEM, following) or p_number)
        return t if not among and (closed or ends(p) or p_title) else ""

    caption = lambda s: bool(re.search(R.CAPTION, s)) and len(s) < 90
    out, state = [], None
    for i, (page, s) in enumerate(lines):
        if not s:
            continue
        if caption(s):
            out.append(["caption", s, len([b for b in out if b[0] != "caption"])])
            continue
        p, p_title, _, closed, apart = before(i, real_title)
        t = real_title(i)
        if t:
            step = "join" if p_title == t and not apart else t
        elif re.search(R.ITEM, s) and not (s[0] in "-–—" and not closed and not ends(p)):
            step = "li"
        elif p is None or p_title:
            step = "p"
        elif s[0].islower():
            step = "join"
        elif closed or (re.search(R.RUN_IN, s) and ends(p)):
            step = "p"
        elif s[0].isupper() and len(p) < 0.8 * width[page] and p.split(" ")[-1].lower() not in R.DANGLING:
            step = "p" if state == "li" else "join"
        else:
            step = "join"
        if step == "join":
            block = [b for b in out if b[0] != "caption"][-1]
            if re.search(r"(^| )[^ -]*[^\W\d_]-$", p) and s[0].islower():
                block[1] = block[1][:-1] + s
            else:
                block[1] += ("" if p.endswith("-") else " ") + s
        else:
            state = step
            out.append([step, re.sub(R.ITEM, "", s) if step == "li" else s, None])
    plain = [b for b in out if b[0] != "caption"]
    captions = [b for b in out if b[0] == "caption"]
    ordered = [b for k in range(len(plain) + 1) for b in ([plain[k - 1]] if k else []) + [c for c in captions if c[2] == k]]
    return [(b[0], b[1]) for b in ordered]


def lines_of(text):
    clean = re.sub("[\x00-\x08\x0b\x0e-\x1f\x7f]", "", text)
    return [(p, re.sub(r"\s+", " ", x).strip()) for p, page in enumerate(clean.split("\f")) for x in page.split("\n")]


def found(spark, docs, chunk, monkeypatch):
    monkeypatch.setattr(R, "CHUNK_LINES", chunk)
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, page int")
    out = {}
    for r in sorted(R.blocks(R.lines_of(df)).collect(), key=lambda r: (r.doc_id, r.block)):
        out.setdefault(r.doc_id, []).append((r.kind, r.text))
    return out


def test_reflow_of_literal_pages(spark, monkeypatch):
    got = found(spark, [(1, PAGES), (2, None), (3, ""), (4, "\n\f\n")], 256, monkeypatch)
    assert set(got) == {1} and got[1] == [
        ("h1", "CHAPTER ONE IN THE WOODS"),
        ("p", "The first thing to learn is woodcraft, which is fore-and-aft of everything else that we shall learn in this book about living under it."),
        ("p", "A new paragraph begins after a short line that ends its sentence and goes on over the page where it ends at last in a full line."),
        ("caption", "Fig. 3. A tent in the rain"),
        ("li", "first item that is long enough to be a whole line which goes on in lower case"), ("li", "second"),
        ("p", "The prose after the list begins with a capital letter and - this dash is inside a sentence that goes on"), ("li", "Choosing a Site"),
        ("p", "Text under a numbered heading that is of the usual width and goes on under the picture with more of its words."), ("caption", "Fig. 4. Floats out of it"),
        ("li", "Turn off the gas"), ("li", "Turn off the water lower case never starts a paragraph."),
    ]


def test_reflow_equals_one_walk_at_any_chunk(spark, monkeypatch):
    rnd = random.Random(6)
    words = ["the", "of", "Water", "boil-", "rain.", "tent", "Gas", "1917", "salt,", "fire", "and", "road-side", "(a)", "éclair", "Ölfarbe"]
    starts = ["", "", "", "", "• ", "1. ", "2) ", "- ", "Fig. 2. ", "CHAPTER ", "2.1 The ", "SHELTER ", "TENT FLOOR.— "]
    docs = []
    for d in range(40):
        lines = ["" if rnd.random() < 0.15 else rnd.choice(starts) + " ".join(rnd.choices(words, k=rnd.randint(1, 9))) for _ in range(rnd.randint(1, 60))]
        docs.append((d, "".join(x + rnd.choice(["\n"] * 9 + ["\n\f", "\f"]) for x in lines)))
    want = {d: b for d, t in docs if (b := sequential(lines_of(t)))}
    kinds = {k for b in want.values() for k, _ in b}
    assert kinds == {"h1", "h2", "p", "li", "caption"}
    for chunk in (256, 5, 1):
        assert found(spark, docs, chunk, monkeypatch) == want


def test_a_long_book_is_many_tasks(spark):
    n = 300_000
    lines = spark.range(n).select(F.lit(1).alias("doc_id"), F.col("id").alias("n"), F.floor(F.col("id") / 40).alias("page"), F.when(F.col("id") % 10 == 9, "").when(F.col("id") % 1000 == 0, "CHAPTER").otherwise("some words of a long book that go on").alias("line"))
    x = R.with_neighbours(R.described(lines, "doc_id"), "doc_id")
    assert x.groupBy("c").count().agg(F.max("count")).first()[0] <= R.CHUNK_LINES
    kinds = {r.kind: r.n for r in R.blocks(lines).groupBy("kind").agg(F.count("*").alias("n")).collect()}
    assert kinds["h1"] == n // 1000


def test_lines_and_paragraphs_by_themselves(spark):
    one = lambda c, *rows: [r[0] for r in spark.createDataFrame([(i, x) for i, x in enumerate(rows)], "i int, x string").orderBy("i").select(c(F.col("x"))).collect()]
    assert one(R.heading_kind, "Chapter 2", "WATER AND FIRE", "2. Choosing a site", "2. choosing", "Water.", "a) Cut", "AB", "x" * 91) == ["h1", "h1", "h2", None, None, None, None, None]
    assert one(R.is_noise, "12", "page 3 of 9", "xiv", "—", "aa . ut", "Fire", "", "...") == [True, True, True, True, True, False, False, True]
    prose = "In the morning we went down to the river, and " * 4 + "there it was. It rained."
    assert one(R.is_prose, prose, prose.upper(), "too short.", "1 2 3 " * 40, "") == [True, False, False, False, False]
    text = "".join(f"Sentence {i} goes on and on. " for i in range(400))
    for w in one(lambda c: R.spread_windows(c, 3, 200), text)[0]:
        assert re.match(r"Sentence \d+ goes", w) and len(w) <= 200 and w in text
    assert one(lambda c: R.spread_windows(c, 2, 50), "")[0] == ["", ""]
    pages = spark.createDataFrame([(1, 0, f"Water {i} .... {i}") for i in range(4)] + [(1, 0, "Fire")] * 3 + [(1, 1, "Water 1")] * 5, "doc_id long, page long, line string")
    assert [tuple(r) for r in R.contents_pages(pages).collect()] == [(1, 0)]
