import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np

from fieldlamp.llm import spelling as S
from fieldlamp.llm.queries import op11_spelling_variants


def brute(rows, least=5, ratio=5, modulus=199):
    n = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % modulus == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1 :]
            n[run] += 1
    n = {w: k for w, k in n.items() if len(w) >= 6 and k >= least}
    by_gap = {}
    for w in n:
        for i in range(len(w)):
            by_gap.setdefault((w[:i], w[i + 1 :], "r"), set()).add(w)  # replaced, or deleted from a longer one
    near = {w: set() for w in n}
    for words in by_gap.values():
        for a, b in itertools.permutations(words, 2):
            near[a].add(b)
    for w in n:
        for i in range(len(w)):
            if (s := w[:i] + w[i + 1 :]) in n:
                near[w].add(s)
                near[s].add(w)
    form = {}
    for w in n:
        best = min(near[w], key=lambda u: (-n[u], u), default=None)
        form[w] = best if best and n[best] >= ratio * n[w] else None

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return {(w, form[w], root(w), n[w], len(near[w]), n[form[w]] if form[w] else None) for w in n}


def texts(seed, n=60):
    rnd = random.Random(seed)
    base = ["".join(rnd.choice("abé") for _ in range(rnd.randint(5, 12))) for _ in range(30)] + ["aaaaaa", "aaaaaaa", "aaaaaaaa", "Straße" * 2, "x" * 40]
    weights = [rnd.choice([1, 3, 20, 90]) for _ in base]
    rows = []
    for i in range(n):
        words = []
        for w in rnd.choices(base, weights, k=200):
            if rnd.random() < 0.3:
                k = rnd.randrange(len(w))
                w = w[:k] + rnd.choice(["", "a", "b", w[k] * 2]) + w[k + 1 :]
            words.append(rnd.choice([w, w.upper(), w.title()]) if w.isascii() else w)
        rows.append((rnd.choice([i, i, None, 7]), rnd.choice([" ", ", ", "9"]).join(words)))
    return rows + [(1, None), (2, ""), (3, "..."), (4, "colours " * 200 + "colour " * 33 + "kolour " * 5)]


def found(spark, rows, **options):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, word string, n int")
    return [tuple(r) for r in S.group_variants(df, **options).collect()]


def test_variants_equal_brute_force(spark):
    for seed, options in ((1, {}), (2, {"bucket_words": 16}), (3, {"modulus": 3})):
        rows = texts(seed)
        got = found(spark, rows, **options)
        want = brute(rows, modulus=options.get("modulus", 199))
        assert len(want) > 100 and len(got) == len(set(got)) and set(got) == want
        assert any(f and r != f for _, f, r, *_ in want)  # forms of forms


def test_variants_of_nothing(spark):
    assert found(spark, []) == [] == found(spark, [(None, None), (1, "a b c " * 9)])


def test_query_equals_brute_force(spark):
    d = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()]
    got = op11_spelling_variants(spark, d)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert {tuple(r) for r in got.collect()} == brute(rows)


def test_wavelet_tree_reports_rectangles():
    rnd = np.random.default_rng(5)
    for n in (1, 2, 3, 17, 64, 200):
        p = rnd.permutation(n)
        box = np.sort(rnd.integers(0, n + 1, (300, 2, 2)), axis=2)
        q, v = S.WaveletTree(p).report(box[:, 0, 0], box[:, 0, 1], box[:, 1, 0], box[:, 1, 1])
        want = {(i, int(y)) for i, ((a, z), (b, t)) in enumerate(box.tolist()) for y in p[a:z] if b <= y < t}
        assert len(q) == len(want) and set(zip(q.tolist(), v.tolist())) == want
