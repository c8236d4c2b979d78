import re

from fieldlamp.llm import line_frequency


def brute(text, width=8):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = [tuple(words[i : i + width]) for i in range(len(words) - width + 1)]
    cover = set()
    for i, g in enumerate(grams):
        if grams.count(g) > 1:
            cover.update(range(i, i + width))
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(cover)


def test_signals_against_brute_force(spark):
    texts = [None, "", " \n\t ", "a b c\x1fd e", "x|<y>&#*$%", "one two three four five six seven eight " * 3, "l\nl\n\nl \nL", "a b c d e f g h " * 2 + "z " + "b c d e f g h i",
             "w " * 40, "\n".join(["same line of words here"] * 5), "é" * 5000 + " " + "ü\n" * 300]
    rows = [(i, t, "h" if i % 2 else None, 7) for i, t in enumerate(texts)] + [(3, texts[3], "h", 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lines int").repartition(3)
    out = line_frequency.judge(df).collect()
    assert len(out) == len(rows)
    for r in out:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute(texts[r.doc_id]), r
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)


def test_common_lines_deplete_only_their_host(spark):
    own = lambda i: " ".join(f"w{i}x{chr(97 + j)}" for j in range(30))
    common = " ".join(f"menu{chr(97 + j)}" for j in range(40))
    rows = [(i, f"{common}\n{own(i)}", "a") for i in range(12)] + [(100 + i, f"{common.upper()}\n{own(100 + i)}", "b") for i in range(3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    kept = {r.doc_id: (r.kept, r.removed_lines) for r in line_frequency.judge(df).collect()}
    assert all(kept[i] == (False, 1) for i in range(12)) and all(kept[100 + i] == (True, 0) for i in range(3))


def test_the_limit_grows_with_the_host(spark):
    word = lambda i: "".join(chr(97 + int(x)) for x in str(i))
    own = lambda i: " ".join(f"w{word(i)}x{chr(97 + j)}" for j in range(30))
    line = lambda x: " ".join(f"{x}{chr(97 + j)}" for j in range(40))
    for n in (1000, 3000):
        of = lambda i: [line("menu")] * (i % 100 < 3) + [line("quote")] * (i % 100 == 50) + [line("pair")] * (i % 50 == 20)  # noqa: E731, B023
        rows = [(i, "\n".join([*of(i), own(i)]), None) for i in range(n)]
        out = line_frequency.judge(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
        lost = {r.doc_id for r in out if r.removed_lines}
        assert lost == {i for i in range(n) if i % 100 < 3} == {r.doc_id for r in out if not r.kept}


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string, source string")
    assert line_frequency.judge(df).count() == 0


def brute_removed(rows, max_docs, max_percent):
    """Per row the lines that go, by counting distinct documents of each host."""
    docs = {}
    for n, (i, text, host) in enumerate(rows):
        lines = docs.setdefault(host, {}).setdefault(("row", n) if i is None else i, set())
        lines.update(line_frequency.normal_line(x) for x in (text or "").split("\n") if x.strip(line_frequency.WHITE))
    out = []
    for _, text, host in rows:
        gone = set()
        for x in (text or "").split("\n"):
            k = sum(line_frequency.normal_line(x) in lines for lines in docs[host].values())
            if x.strip(line_frequency.WHITE) and k > max_docs and 100 * k > max_percent * len(docs[host]):
                gone.add(x)
        out.append("\n".join(x for x in (text or "").split("\n") if x not in gone))
    return out


def test_verdicts_and_clean_texts_against_brute_force(spark):
    import random

    random.seed(3)
    lines = [f"line {chr(97 + k)} " + "word " * random.randint(1, 30) for k in range(25)]
    text = lambda: "\n".join(random.choice(lines) for _ in range(random.randint(0, 6))) + "\n\n" + " ".join(f"u{random.random()}" for _ in range(random.randint(0, 40)))
    rows = [(random.choice([None, *range(60)]), text(), random.choice(["a", "a", "a", "b", None])) for _ in range(150)]
    rows += [(7, "only in one document\n" + text(), "a")] * 11 + [(7, "only in one document\nonce more", "a"), (3, None, "b"), (4, "", "b")]
    df = spark.createDataFrame([(*r, "x", n) for n, r in enumerate(rows)], "doc_id long, text string, source string, host string, row int").repartition(4)
    want = brute_removed(rows, 3, 5)
    kept = []
    for r in line_frequency.judge(df.withColumn("doc_id", df.doc_id), max_docs=3, max_percent=5).collect():
        kept.append((r.doc_id, r.n_words, r.removed_words, r.kept))
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    expected = []
    for (i, t, _), left in zip(rows, want):
        n, gone = words(t), words(t) - words(left)
        failed = n < 20 or 100 * brute(t)[4] > 30 * n
        expected.append((i, n, gone, not failed and not (gone > 0.5 * n or n - gone < 20)))
    assert sorted(kept, key=str) == sorted(expected, key=str) and any(x[3] and x[2] for x in expected)
    out = line_frequency.clean(df, max_docs=3, max_percent=5)
    assert out.columns == df.columns
    assert {r.row: r.text for r in out.collect()} == {n: want[n] for n, x in enumerate(expected) if x[3]}


def test_one_document_in_many_rows_holds_its_lines_once(spark):
    line = "a line of this document " * 8
    df = spark.createDataFrame([(5, f"{line}\n{'own word ' * 3}", "s")] * 11, "doc_id long, text string, source string")
    assert {r.removed_lines for r in line_frequency.judge(df).collect()} == {0}
    assert line_frequency.clean(df.limit(0)).count() == 0
