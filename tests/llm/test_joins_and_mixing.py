import itertools
import math
import random
import re

from pyspark.sql import functions as F

from fieldlamp.llm import mixing, partition_join as J, spaced_seed as S, toxic_segments as T

WORDS = [f"w{i}" for i in range(400)]


def shingles(text, width):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)} if len(words) >= width else {tuple(words)} - {()}


def brute_components(rows, width, percent):
    sets = [shingles(t, width) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
            parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), 1 << 60), d)
    return {d: (len(sets[i]), least[find(i)] if sets[i] else d) for i, (d, _) in enumerate(rows)}


def near_copies(seed, n=220):
    random.seed(seed)
    texts = [None, "", " ", "One", "one", "one two", "Two one", "x y z", "X Y z", "É a b c"]
    for _ in range(30):
        base = [random.choice(WORDS) for _ in range(random.choice([6, 12, 30, 60, 120, 400]))]
        for _ in range(random.randint(1, 9)):
            t = list(base)
            for _ in range(random.randint(0, max(1, len(t) // 25))):
                k = random.randrange(len(t))
                t[k : k + random.randint(0, 1)] = random.choice([[], [random.choice(WORDS)]])
            texts.append(random.choice([" ", "\n"]).join(t))
    random.shuffle(texts)
    return [(1000 - i, t) for i, t in enumerate(texts[:n])]


def test_join_against_all_pairs(spark):
    for seed, width, percent in ((1, 3, 90), (2, 5, 80), (3, 1, 60)):
        rows = near_copies(seed)
        df = spark.createDataFrame([(*r, "k") for r in rows], "doc_id long, text string, key string").repartition(5)
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in J.join(df, width, percent).collect()}
        assert got == brute_components(rows, width, percent)


def template_family(n, seed=8):
    """Copies of a template whose middle is one of several sub-templates, with changes: most fail the threshold against any one of them."""
    rnd = random.Random(seed)
    words = lambda k, head: [f"{head}{rnd.randrange(10**6)}" for _ in range(k)]
    frame, middles, out = words(60, "f"), [words(30, "m") for _ in range(8)], []
    for i in range(n):
        t = frame[:30] + rnd.choice(middles) + words(rnd.choice([0, 2, 12, 25]), "o") + frame[30:]
        for _ in range(rnd.randint(0, 3)):
            t[rnd.randrange(len(t))] = f"x{rnd.randrange(10**6)}"
        out.append((n - i, " ".join(t)))
    return out


def test_failed_members_of_a_family_are_linked_with_each_other(spark, monkeypatch):
    """Hubs of several parts: members gather round hubs of their own, round after round, and then pair by pair."""
    rows = template_family(1500)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    want = brute_components(rows, 5, 80)
    assert 20 < len({c for _, c in want.values()}) < 1400
    monkeypatch.setattr(J, "CHUNK", 20_000)
    for rounds in (6, 1, 0):
        monkeypatch.setattr(J, "ROUNDS", rounds)
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in J.join(df, 5, 80).collect()}
        assert got == want


def test_keep_one_does_not_hang_on_the_order_of_rows(spark):
    text = " ".join(WORDS[:40])
    rows = [(1, text, "s2"), (1, text, "s1"), (1, text, "s3"), (2, text, "s4"), (1, "other words " * 9, "s5"), (None, text, "s6")]
    kept = {tuple(sorted(map(str, J.keep_one(spark.createDataFrame(x, "doc_id long, text string, source string").coalesce(1)).collect()))) for x in (rows, rows[::-1], rows[2:] + rows[:2])}
    assert len(kept) == 1 and len(next(iter(kept))) == 3


def test_join_edge_cases(spark):
    a = " ".join(WORDS[:40])
    rows = [(None, a), (7, a), (7, a), (3, a.upper()), (None, "lonely one here"), (9, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in J.join(df, 3, 90).collect()), key=str)
    assert got == sorted([(None, 38, 3), (7, 38, 3), (7, 38, 3), (3, 38, 3), (None, 1, None), (9, 0, 9)], key=str)
    assert J.join(df.limit(0), 3, 90).count() == 0
    kept = sorted((str(r.doc_id) for r in J.keep_one(df, 3, 90).collect()))
    assert kept == ["3", "9", "None", "None"]


def test_join_of_a_doc_id_with_two_texts(spark):
    a, b = " ".join(WORDS[:60]), " ".join(WORDS[100:160])
    near = " ".join([*WORDS[1:60], "new"])
    rows = [(5, a), (5, b), (6, near), (7, b + " more"), (8, " ".join(WORDS[200:260])), (5, None)]
    for order in (rows, rows[::-1], rows[3:] + rows[:3]):
        df = spark.createDataFrame(order * 2, "doc_id long, text string").repartition(3)
        got = {(r.doc_id, r.n_shingles): r.component_id for r in J.join(df, 3, 90).collect()}
        assert got == {(5, 58): 5, (6, 58): 5, (7, 59): 5, (8, 58): 8, (5, 0): 5}


def test_join_leaves_nothing_but_what_is_read(spark):
    """Staged files of finished steps are gone: what is left is smaller than the index was."""
    import os

    from fieldlamp.session import shared_dir

    folder = shared_dir(spark).removeprefix("file://")
    before = set(os.listdir(folder))
    J.join(spark.createDataFrame(near_copies(4), "doc_id long, text string"), 3, 90).count()
    left = {x.rsplit("-", 1)[0] for x in set(os.listdir(folder)) - before}
    assert left == {"partition-docs", "classes", "cc-labels"}


def test_pigeonhole_of_segments():
    """Linked sets share a key, for every band near the sizes."""
    import numpy as np

    random.seed(5)
    for percent in (60, 80, 90):
        for size in (3, 9, 20, 57, 133, 700):
            for _ in range(40):
                u = np.unique(np.random.default_rng(random.randrange(1 << 30)).integers(0, 1 << 63, 3 * size).astype(np.uint64))
                a = set(u[:size].tolist())
                b, spare = set(a), iter(u[size:].tolist())
                while True:
                    c = set(b)
                    c.discard(random.choice(sorted(c))) if random.random() < 0.5 and len(c) > 1 else c.add(next(spare))
                    if 100 * len(a & c) < percent * len(a | c):
                        break
                    b = c
                keys = [set(J.set_keys(np.array(sorted(x), np.uint64), percent).tolist()) for x in (a, b)]
                assert keys[0] & keys[1]


def test_masks_find_every_overlap():
    for bad in itertools.combinations(range(S.WINDOW), S.WINDOW - S.NEED):
        assert any(not set(bad) & {o + k for k in m} for m in S.MASKS for o in range(S.WINDOW - S.SPAN + 1))
    for n in range(S.SPAN, S.WINDOW):
        allowed = n - -(-S.NEED * n // S.WINDOW)
        assert allowed == 1
        for bad in range(n):
            assert any(bad not in {o + k for k in m} for m in S.ALL_MASKS for o in range(n - S.SPAN + 1))


def brute_overlap(doc, item):
    d, t = (re.findall(r"[^\W_]+", (x or "").lower()) for x in (doc, item))
    w = min(S.WINDOW, len(t))
    best = None
    for shift in range(-len(t), len(d)):
        agree = [int(d[i + shift] == t[i]) for i in range(len(t)) if 0 <= i + shift < len(d)]
        if len(agree) < S.SPAN:
            continue
        top = max((sum(agree[i : i + w]) for i in range(max(1, len(agree) - w + 1))), default=0)
        if w >= S.SPAN and top * S.WINDOW >= S.NEED * w:
            best = max(best or 0, top)
    return best


def test_overlaps_against_all_alignments(spark):
    random.seed(8)
    items = [(i, " ".join(random.choice(WORDS) for _ in range(n))) for i, n in enumerate([5, 13, 14, 25, 40, 60, 8, 9, 10, 11, 12])] + [(50, None), (51, ""), (52, "W1, w2! w3? w4 w5 w6 w7 w8 w9 w10 w11 w12 w13")]
    docs = [(0, None), (1, ""), (2, "w1 w2 w3 w4 w5 w6 w7 w8 w9 w10 w11 w12 W13")]
    for d in range(3, 160):
        words = [random.choice(WORDS) for _ in range(random.randint(3, 60))]
        part = items[random.randrange(11)][1].split()
        a = random.randrange(len(part))
        part = [random.choice(WORDS) if random.random() < 0.1 else w for w in part[a : a + random.choice([8, 13, 20, 60])]]
        docs.append((d, " ".join(words[:9] + part + words[9:])))
    docs.append((59, docs[59][1]))
    docs += [(200 + k, " ".join([*WORDS[:3], *("other" if j == k else w for j, w in enumerate(items[6 + k % 5][1].split())), *WORDS[:2]])) for k in range(10)]
    df = spark.createDataFrame([(*d, 0) for d in docs], "doc_id long, text string, hits int").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.window_agreement for r in S.overlaps(df, bench).collect()}
    want = {(d, i): b for d, t in docs for i, x in items if (b := brute_overlap(t, x))}
    assert got == want and {k[1] for k in want} >= set(range(1, 11))
    assert len(want) > 10
    left = sorted(r.doc_id for r in S.clean(df, bench).collect())
    assert left == sorted(d for d, _ in docs if d not in {k[0] for k in got})
    assert S.overlaps(df.limit(0), bench).count() == 0 and S.overlaps(df, bench.limit(0)).count() == 0


def test_mixing_budget_and_weights(spark):
    random.seed(4)
    rows = [(i, random.choice(["big"] * 8 + ["mid", "mid", "small", None]), " ".join(["t"] * random.randint(0, 30)), "e") for i in range(900)] + [(None, "big", "a b", "e"), (5, "zero", None, "e")]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string, epoch string").repartition(4)
    narrow, planned = mixing.plan(df, entropy_share=0.9, max_repeats=4.0)
    plan = {(r.source if not r.unknown else None): r for r in planned.collect()}
    size = {}
    for _, s, t, _ in rows:
        size[s] = size.get(s, 0) + len((t or "").split())
    total = sum(size.values())
    entropy = lambda a: (lambda q: -sum(x / sum(q) * math.log(x / sum(q)) for x in q))([(n / total) ** a for n in size.values() if n])
    rep = lambda a: max((n / total) ** (a - 1) for n in size.values() if n) / sum((n / total) ** a for n in size.values() if n)
    a = min(x / 20000 for x in range(20001) if entropy(x / 20000) <= 0.9 * math.log(len(size)) and rep(x / 20000) <= 4.0)
    z = sum((n / total) ** a for n in size.values() if n)
    for s, n in size.items():
        assert abs(plan[s].weight - ((n / total) ** a / z if n else 0)) < 1e-3 and plan[s].tokens == n
    drawn = mixing.draw(narrow, planned).collect()
    took = {}
    for r in drawn:
        took.setdefault(None if r.unknown else r.source, []).append(r)
    for s, n in size.items():
        got = sum(r.n_tokens for r in took.get(s, []))
        assert got <= plan[s].budget and plan[s].budget - got <= 62 * (n > 0)
        epochs = [r.epoch for r in took.get(s, [])]
        assert all(epochs.count(e) == sum(x[1] == s for x in rows) for e in range(plan[s].epochs))
    out = mixing.mix(df, entropy_share=0.9, max_repeats=4.0)
    assert out.columns == df.columns and out.count() == len(drawn)
    assert mixing.mix(df.limit(0)).count() == 0
    _, p = mixing.plan(df.filter("source = 'zero'"))
    assert [(r.weight, r.budget) for r in p.collect()] == [(0.0, 0)]


def brute_segments(scores):
    """Maximal segments by their definition: the best segment, then the same left and right of it."""
    def solve(a, z):
        best = max(((sum(scores[i:j]), -(j - i), -i, i, j) for i in range(a, z) for j in range(i + 1, z + 1)), default=None)
        if not best or best[0] <= 1e-12:
            return []
        return solve(a, best[3]) + [(best[3], best[4] - 1, best[0])] + solve(best[4], z)
    return solve(0, len(scores))


def test_segments_against_their_definition():
    random.seed(11)
    for _ in range(300):
        n, loss = random.randint(1, 16), random.choice([0.37, 1.13])
        hits = sorted(random.sample(range(n), random.randint(0, min(n, 7))))
        w = [random.uniform(0.2, 3) for _ in hits]
        scores = [dict(zip(hits, w)).get(i, -loss) for i in range(n)]
        got, want = T.segments(hits, w, loss), brute_segments(scores)
        assert [(a, z) for a, z, _ in got] == [(a, z) for a, z, _ in want]
        assert all(abs(g[2] - x[2]) < 1e-9 for g, x in zip(got, want))


def test_toxicity_on_held_out_rows(spark):
    random.seed(2)
    calm, rude = [f"{a}{b}" for a in "krtplmn" for b in ("alo", "eni", "osu", "iva", "umi")], ["zgrobix", "zgrobal", "vlunker"]
    def text(toxic):
        return " ".join(random.choice(rude) if toxic and random.random() < 0.1 else random.choice(calm) for _ in range(random.randint(40, 200)))
    rows = [(i, text(i % 5 == 0), "l") for i in range(600)] + [(None, None, "l"), (9999, "", "l"), (9998, " \n", "l")]
    df = spark.createDataFrame(rows, "doc_id long, text string, statistic string").repartition(4)
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(600)] + [(5, None), (None, 1), (77777, 1)], "doc_id long, toxic int")
    got = T.score(df, labels, prior=50.0, lexicon_most=1000).collect()
    assert all((r.predicted == 1) == (r.doc_id is not None and r.doc_id % 5 == 0 and r.doc_id < 9000) for r in got)
    import zlib

    assert all(r.held_out == (zlib.crc32(str(r.doc_id if r.doc_id is not None else "").encode()) % 3 == 1) for r in got)
    joined = {r.doc_id: (r.score, r.n_passages) for r in T.score(df, labels, prior=50.0, lexicon_most=0).collect()}
    assert all(abs(joined[r.doc_id][0] - r.score) < 1e-9 and joined[r.doc_id][1] == r.n_passages for r in got)
    kept = T.keep_clean(df, labels, prior=50.0)
    assert kept.columns == df.columns and sorted(r.doc_id or -1 for r in kept.collect()) == sorted(i or -1 for i, _, _ in rows if i is None or i % 5 or i > 9000)
    assert {r.score for r in T.score(df, labels.limit(0)).collect()} == {T.score(df.limit(1), labels.limit(0)).first().score}
    assert T.score(df.limit(0), labels).count() == 0


def test_every_run_of_letters_is_a_token():
    import pyarrow as pa

    assert T.tokens_of("x-Idiot") == ["x", "idiot"] and T.tokens_of("l'abruti,scum") == ["l", "abruti", "scum"]
    assert T.tokens_of("12") == [""] and "".join(T.tokens_of("あ" * 40)) == "あ" * 40
    texts = ["one 2 l'abruti", None, "", "x-idiot scum"]
    begin, codes, word, tokens = T.tokens_of_batch(pa.array(texts))
    got = [[(tokens[c], int(w)) for c, w in zip(codes[a:z], word[a:z])] for a, z in zip(begin, begin[1:])]
    assert got == [[("one", 0), ("", 1), ("l", 2), ("abruti", 2)], [], [], [("x", 0), ("idiot", 0), ("scum", 1)]]


def test_a_rare_word_of_many_toxic_rows_is_evidence(spark):
    """A word in less than half a percent of the toxic rows, and in no clean one."""
    rnd = random.Random(7)
    calm, rude = [f"kal{x}mo" for x in "abcdefgh"], ["zgrobix", "drunkol"]
    rows = []
    for i in range(32_000):
        words = rnd.choices(calm, k=12)
        if i % 2 == 0:
            words[3:6] = rnd.choices(rude, k=3) if i % 450 else ["vlunker"] * 3
        rows.append((i, " ".join(words)))
    labels = [(i, int(i % 2 == 0)) for i, _ in rows]
    assert sum("vlunker" in t for _, t in rows) == 72 < 0.005 * 16_000
    rows += [(40_000 + i, " ".join([*rnd.choices(calm, k=6), "vlunker", "vlunker", "vlunker", *rnd.choices(calm, k=3)])) for i in range(10)]
    got = T.score(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert [r.predicted for r in got.filter("doc_id >= 40000").collect()] == [1] * 10
    assert got.filter("predicted = 1 and doc_id % 2 = 1 and doc_id < 32000").count() == 0


def brute_counts(rows, labels):
    """Documents that hold a token, by label."""
    import zlib

    known = {}
    for i, y in labels:
        if i is not None and y is not None and zlib.crc32(str(i).encode()) % 3 != 1:
            known[i] = max(known.get(i, 0), y)
    out = {}
    for i, t in rows:
        for x in {x for w in re.findall(r"[^\x20\x09-\x0D]+", t or "") for x in T.tokens_of(w)}:
            n = out.setdefault(x, [0, 0, 0])
            n[0] += 1
            n[1] += known.get(i) == 1
            n[2] += known.get(i) == 0
    return out


def test_scores_against_their_definition(spark):
    """The score of every row by counts, features, segments and statistic written down plainly."""
    random.seed(12)
    calm, rude = ["krala", "tranu", "plimo", "drost", "mnelu", "krasa"], ["zgrobix", "zgrobal", "x-vlunk"]
    rows = [(i, " ".join(random.choice(rude) if i % 4 == 0 and random.random() < 0.2 else random.choice(calm) for _ in range(random.randint(0, 30)))) for i in range(200)]
    labels = [(i, int(i % 4 == 0)) for i in range(0, 200, 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    options = dict(prior=40.0, least_weight=0.5)
    model = T.fit(df, spark.createDataFrame(labels, "doc_id long, toxic int"), **options)
    counts = brute_counts(rows, labels)
    n, x, c = (sum(v[k] for v in counts.values()) for k in range(3))
    feature = {}
    of = lambda t: [t[:k] + ("_" if k < len(t) else "") for k in range(min(3, len(t)), len(t) + 1)] if t else []
    for t, v in counts.items():
        for f in of(t):
            feature[f] = [a + b for a, b in zip(feature.get(f, [0, 0, 0]), v)]
    weight = {}
    for f, (m, y, z) in feature.items():
        a = m * 40.0 / n
        w = math.log((y + a) / (x + 40 - y - a)) - math.log((z + a) / (c + 40 - z - a)) - math.sqrt(1 / (y + a) + 1 / (z + a))
        if y > 1 and w >= 0.5:
            weight[f] = w
    tokens = {t: max(weight[f] for f in of(t) if f in weight) for t in counts if any(f in weight for f in of(t))}
    assert set(weight) == set(model.weights) and all(abs(model.weights[f] - w) < 1e-9 for f, w in weight.items())
    got = {r.key: r.statistic for r in T.statistics(df, model, F.col("doc_id")).collect()}
    for i, t in rows:
        seq = [y for w in t.split() for y in T.tokens_of(w)]
        found = brute_segments([tokens.get(y, -model.loss) for y in seq])
        want = max(T.NOTHING, math.log(sum(math.exp(s) for _, _, s in found) / len(seq))) if found else T.NOTHING
        assert abs(got[i] - want) < 1e-6


def test_texts_of_a_sliced_batch_are_read_right():
    import pyarrow as pa

    from fieldlamp.llm.common import small_batches

    texts = [f"Élan {i} été {'x' * (i % 7)} Zwölf {i % 3}" for i in range(200)]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])
    whole = [s.tolist() for s in J.shingle_sets(batch.column("text"), 2)]
    assert [s.tolist() for s in J.shingle_sets(batch.column("text").slice(50), 2)] == whole[50:]
    pieces = [s.tolist() for p in small_batches([batch], "text", 300) for s in J.shingle_sets(p.column("text"), 2)]
    assert pieces == whole
