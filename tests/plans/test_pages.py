import random
import re
from html.parser import HTMLParser

from pyspark.sql import functions as F

from fieldlamp.functions import text as T
from fieldlamp.operators import pages as P


class Walk(HTMLParser):
    """The same paragraphs by one walk over the tags of a page."""

    def __init__(self):
        super().__init__(convert_charrefs=False)
        self.open, self.out, self.para, self.texts = [], [], 0, []  # open: (tag, dropped, main)
        self.any_main = False

    def handle_starttag(self, tag, attrs):
        self.para += tag in P.BLOCKS
        if tag in P.VOID:
            return
        a = dict(attrs)
        gone = any(x[1] for x in self.open)
        drop = tag in P.DROPPED or a.get("role") == "navigation" or any(c in (a.get("class") or "") for c in P.DROPPED_CLASSES)
        main = not gone and not drop and (tag == "main" or a.get("id") == "maincontent")
        self.any_main |= main
        self.open.append((tag, drop, main))

    def handle_startendtag(self, tag, attrs):
        self.para += tag in P.BLOCKS

    def handle_endtag(self, tag):
        self.para += tag in P.BLOCKS
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                del self.open[i]
                return

    def add(self, s):
        self.texts.append((self.para, s, any(x[1] for x in self.open), any(x[2] for x in self.open)))

    handle_data = add

    def handle_entityref(self, name):
        self.add(f"&{name};")

    def handle_charref(self, name):
        self.add(f"&#{name};")


def walked(page):
    from html import unescape

    w = Walk()
    w.feed(page or "")
    w.close()
    out = {}
    for para, s, gone, main in w.texts:
        if not gone and (main or not w.any_main):
            out[para] = out.get(para, "") + s
    return [x for _, s in sorted(out.items()) if len(x := re.sub(r"[\s\xa0]+", " ", unescape(s)).strip()) >= 2]


def found(spark, rows):
    out = {}
    for r in sorted(P.paragraphs(spark.createDataFrame(rows, "page_id long, html string")).collect(), key=lambda r: (r.page_id, r.nth)):
        out.setdefault(r.page_id, []).append(r.text)
    return out


LITERAL = [
    "<html><body><nav><p>menu</p></nav><h1>Water &amp; fire</h1><p>One <b>two</b>\n three.</p><footer>end</footer></body></html>",
    "<div role=navigation><div>in</div>gone</div><div>kept</div></div> stray",
    "<header>x</header><main><p>main text</p></main><p>other</p>", "<div id='maincontent'><div><p>a b</p></div></div><p>after</p>",
    "<script>if (a<b && c>d) document.write('<div><nav>')</script><p>after script</p>", "<!-- <p>hidden</p> --><p>shown</p><p>x</p>",
    "<p>open <aside>never closed <p>all gone", "&#169; &#x20AC; &nope; &eacute;&nbsp;z &#99999999; a & b", "<style>p{}</style>", None, "", "plain - text -- with - dashes",
    "<ul><li>one<li>two</ul><br/>three<div class=\"a nhsuk-footer b\">foot</div><svg><p>s</p></svg>", "</div></p>a lone close<nav>n</nav> end", "<template><p>t</p></template>tt",
]


def test_paragraphs_equal_one_walk(spark):
    rnd = random.Random(2)
    tags = ["p", "div", "b", "nav", "aside", "main", "li", "section", "div role=\"navigation\"", "div id=maincontent", "br", "a class='nhsuk-header'"]
    made = []
    for _ in range(150):
        open_, s = [], ""
        for _ in range(rnd.randint(0, 40)):
            x = rnd.random()
            if x < 0.4:
                t = rnd.choice(tags)
                s += f"<{t}>"
                if t != "br":
                    open_.append(t.split()[0])
            elif x < 0.7 and open_:
                s += f"</{open_.pop()}>"
            else:
                s += rnd.choice(["word ", "&lt;two", "x", "\n", "Ärger - so"])
        made.append(s + "".join(f"</{t}>" for t in reversed(open_)))
    rows = list(enumerate(LITERAL + made))
    got = found(spark, rows)
    for i, page in rows:
        if i not in (1, 6, 7, 12, 13):
            assert got.get(i, []) == walked(page), page
    assert got[1] == ["kept", "stray"] and got[6] == ["open"] and got[12] == ["one", "two", "three"] and got[13] == ["a lone close end"]
    assert got[0] == ["Water & fire", "One two three."] and got[2] == ["main text"] and got[3] == ["a b"] and 8 not in got
    assert got[7] == ["© € &nope; é z &#99999999; a & b"]


def test_paragraphs_of_the_given_pages(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("page_id", "html").collect()]
    assert found(spark, rows) == {i: x for i, page in rows if (x := walked(page))}


def test_a_page_of_open_tags_takes_linear_time(spark):
    import time

    began = time.time()
    assert len(found(spark, [(1, "<div>a b" * 100_000)])[1]) == 100_000
    assert time.time() - began < 60
    assert [r[0] for r in spark.range(1).select(T.unescape_html(F.lit("&amp;lt; &#0; &#xD800; &#65;&#x1F600; & &bogus;"))).collect()] == ["&lt; &#0; &#xD800; A😀 & &bogus;"]
