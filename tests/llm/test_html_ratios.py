import math
import re
import time

from fieldlamp.llm import html_extract as H

LONG = "A long paragraph, with commas, and a full stop at its end; it says what pages say, and more of it. " * 3
LINKS = "<ul>" + "".join(f'<li><a href="/{i}">more about {i}</a></li>' for i in range(12)) + "</ul>"


def test_ratios_decide_without_an_article():
    page = f"<body><div id=a1>{LINKS}</div><div id=a2><div><h2>Head</h2><p>{LONG}</p><p>Short one.</p><p>{LONG}</p></div></div><div id=a3><span>Seen by 12</span></div></body>"
    elements, blocks = H.blocks_of(page)
    everything = "\n".join(b.text for b in blocks)
    want = "\n".join(["Head", LONG.strip(), "Short one.", LONG.strip()])
    assert H.main_text(page) == want != everything


def test_a_link_list_in_an_article_goes_and_short_prose_stays():
    page = f"<article><h1>Title</h1><p>{LONG}</p><ul><li>first point</li><li>second point</li></ul><p>{LONG}</p><h3>Read on</h3>{LINKS}</article><p>{LONG}outside</p>"
    assert H.main_text(page).split("\n") == ["Title", LONG.strip(), "first point", "second point", LONG.strip()]


def test_ablated_ratios_change_results(monkeypatch):
    pages = [f"<div>{LINKS}</div><section><p>{LONG}</p></section>", f"<article><p>{LONG}</p>{LINKS}</article>"]
    by_ratio = [H.main_text(p) for p in pages]
    assert by_ratio == [LONG.strip()] * 2
    monkeypatch.setattr(H, "content_nodes", lambda blocks: list(range(len(blocks))))
    assert all(a != b for a, b in zip(by_ratio, map(H.main_text, pages)))


def brute_ratios(blocks):
    """Fused ratios by their definition, a path as a string."""
    def path(e):
        return (path(e.parent) + "/" if e.parent else "") + e.tag

    raw = []
    for b in blocks:
        same = [x for x in blocks if path(x.element) == path(b.element)]
        size, marks, links = sum(len(x.text) for x in same), sum(len(re.findall(r"[,.;:!?，。；：！？、]", x.text)) for x in same), sum(x.links for x in same)
        raw.append(size / len(same) * (1 + marks / len(same)) * (1 - links / size))
    w = [math.exp(-i * i / 2) for i in (-1, 0, 1)]
    n = len(raw)
    return [math.sqrt(raw[i] * sum(w[k + 1] * raw[min(max(i + k, 0), n - 1)] for k in (-1, 0, 1)) / sum(w)) for i in range(n)]


def test_ratios_by_their_definition():
    page = f"<div>{LINKS}<p>x</p></div><main><h1>T, t</h1><p>{LONG}</p><div><p>ok.</p><p>{LONG} <a href=x>link</a></p></div></main>"
    _, blocks = H.blocks_of(page)
    got, want = H.fused_ratios(blocks).tolist(), brute_ratios(blocks)
    assert len(blocks) == 17 and all(abs(a - b) < 1e-9 for a, b in zip(got, want))


def test_pages_of_a_megabyte_take_their_length():
    for page in ("<a " * 350_000, "<div>" * 200_000, "<a '>'" * 160_000, "<noscript>" * 100_000, "<b>" + "<div>" * 40_000 + "</b>" * 100_000, "<div>" * 50_000 + "<li></li>" * 50_000, "<" * 1_000_000):
        began = time.process_time()
        H.main_text(page)
        assert time.process_time() - began < 5


def test_extract_of_odd_tables(spark):
    schema = "page_id long, url string, html string, text string, n_chars int"
    rows = [(1, "u", None, "t", 0), (2, "u", "", "t", 0), (None, None, f"<p>{LONG}", "t", 0), (3, "u", f"<p>{LONG}", "t", 0), (3, "u", f"<p>{LONG}", "t", 0), (4, "u", "a < b &amp; c <!-- x", "t", 0)]
    got = H.extract(spark.createDataFrame(rows, schema).repartition(3)).collect()
    assert sorted((str(r.page_id), r.text, r.n_chars) for r in got) == sorted(
        [("1", "", 0), ("2", "", 0), ("None", LONG.strip(), len(LONG.strip())), ("3", LONG.strip(), len(LONG.strip())), ("3", LONG.strip(), len(LONG.strip())), ("4", "a < b & c", 9)]
    )
    assert H.extract(spark.createDataFrame([], schema)).count() == 0
