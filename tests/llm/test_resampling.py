import hashlib
import math
import random
import re
import zlib

import pyarrow as pa

from fieldlamp.llm import resampling as R
from fieldlamp.llm.queries import op12_importance_resampling


def features(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return len(w), [" ".join(w[i : i + k]) for k in (1, 2, 3) for i in range(len(w) - k + 1)]


def brute(docs, target, percent=5, least_words=20):
    bucket = lambda f: zlib.crc32(f.encode()) % 10000
    s, t = [0] * 10000, [0] * 10000
    for rows, count in ((docs, s), (target, t)):
        for x in rows:
            for f in features(x[-1])[1]:
                count[bucket(f)] += 1
    gain = [math.floor(1000 * math.log((a + 1) * (sum(s) + 10000) / ((b + 1) * (sum(t) + 10000)))) for a, b in zip(t, s)]
    out, able = [], []
    for d, x in docs:
        n, f = features(x)
        weight = sum(gain[bucket(y)] for y in f)
        h = int(hashlib.sha256(f"42:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        out.append([d, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
        if n >= least_words:
            able.append(out[-1])
    able.sort(key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1], r[2]))
    for i, r in enumerate(able[: percent * len(able) // 100]):
        r[4] = i + 1
    return sorted(map(tuple, out), key=repr)


def test_buckets_of_texts_are_those_of_their_features():
    rnd = random.Random(3)
    texts = [None, "", " - ", "A", "a-B", "É é 1x", "x" * 300 + " y", "漢字  x\x7fy z"]
    texts += ["".join(rnd.choice(" .aBz9é漢") for _ in range(rnd.randint(0, 300))) for _ in range(200)]
    of, bucket, n = R.buckets_of(pa.array(texts))
    for i, t in enumerate(texts):
        words, want = features(t)
        assert n[i] == words and sorted(bucket[of == i].tolist()) == sorted(zlib.crc32(f.encode()) % 10000 for f in want)


def test_resampling_equals_brute_force(spark):
    rnd = random.Random(9)
    words = [f"w{i}" for i in range(80)]
    docs = [(i, " ".join(rnd.choices(words, k=rnd.choice([0, 3, 19, 20, 21, 90])))) for i in range(400)]
    docs += [(1000 + i, docs[7][1]) for i in range(200)] + [(None, docs[5][1])] * 3 + [(8, docs[8][1])] * 2 + [(2000, None), (2001, "")]
    target = [" ".join(rnd.choices(words[:20], k=30)) for _ in range(20)] + [None]
    df = spark.createDataFrame([(*x, 0, 0) for x in docs], "doc_id int, text string, digest int, rank int")
    goal = spark.createDataFrame([(x, 1) for x in target], "text string, copies int")
    got = R.resample(df, goal, percent=30).select("doc_id", "n_features", "weight", "score", "rank")
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(docs, [(x,) for x in target], 30)


def test_resampling_of_nothing(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, "a b " * 30), (None, None)], "doc_id long, text string")
    assert R.resample(docs, docs.select("text")).count() == 0
    got = [tuple(r) for r in R.resample(some, docs.select("text"), percent=100).select("doc_id", "n_features", "weight", "score", "rank").collect()]
    assert sorted(got, key=repr) == brute([(1, "a b " * 30), (None, None)], [], 100)


def test_query_equals_brute_force(spark):
    d = "/root/testdata/sf0.001"
    docs = [tuple(r) for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()]
    target = [tuple(r) for r in spark.read.parquet(f"{d}/benchmark.parquet").select("text").collect()]
    got = op12_importance_resampling(spark, d)
    assert set(dict(got.dtypes).values()) == {"bigint"}
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(docs, target)
