import random
import re
import zlib

import numpy as np
import pytest

import corpus_pipeline as P
from fieldlamp.llm.common import tokenizer_path
from test_joins_and_mixing import WORDS, brute_components, brute_overlap

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, label int, whole string, h long, hits int"


def write(spark, folder, docs, labels, items):
    spark.createDataFrame([(i, t, "en", s, len(t or ""), 1, "w", 2, 3) for i, t, s in docs], SCHEMA).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    random.seed(21)
    text = lambda n: [random.choice(WORDS) for _ in range(n)]
    rude = ["zgrobix", "zgrobal", "vlunker"]
    docs, labels = [], []
    for i in range(260):
        words = text(random.randint(30, 120))
        if i % 5 == 0:
            for k in range(0, len(words), 6):
                words[k] = random.choice(rude)
        docs.append((i, " ".join(words), random.choice(["a", "a", "a", "b", None])))
        labels.append((i, 1, int(i % 5 == 0)))
    for i in range(40):  # near and exact copies
        _, t, s = docs[random.randrange(1, 260) // 5 * 5 + 1 + i % 4 if i else 1]
        words = t.split()
        if i % 2:
            words[len(words) // 2 : len(words) // 2 + 1] = ["new"]
        docs.append((1000 + i, " ".join(words), s))
    items = [(k, " ".join(text(20))) for k in range(4)]
    docs += [(2000 + k, " ".join([*text(30), *x.split(), *text(30)]), "a") for k, x in items]
    docs += [(3000, None, "a"), (3001, "", "b"), (3002, " \n", None), (None, "no id " * 20, "a"), (2, docs[2][1], docs[2][2])]
    return write(spark, tmp_path_factory.mktemp("pipeline"), docs, labels, items), docs, items


def rows(df):
    return [(r.doc_id, r.text, r.source) for r in df.collect()]


def test_stages_one_after_the_other(spark, tables):
    d, docs, items = tables
    key = lambda r: str(r)
    df = spark.read.parquet(f"{d}/documents.parquet")
    clean = P.STAGES[0][1](spark, df, d)
    assert clean.columns == df.columns
    left = rows(clean)
    assert sorted(left, key=key) == sorted((r for r in docs if not re.search("zgrob|vlunker", r[1] or "")), key=key)

    apart = P.STAGES[1][1](spark, clean, d)
    assert apart.columns == df.columns
    named = [r for r in {*left} if r[0] is not None]
    least = brute_components([(i, t) for i, t, _ in named], 5, 80)
    kept = rows(apart)
    assert sorted(kept, key=key) == sorted([r for r in named if least[r[0]][1] == r[0]] + [r for r in left if r[0] is None], key=key)

    pure = P.STAGES[2][1](spark, apart, d)
    assert pure.columns == df.columns
    left = rows(pure)
    assert sorted(left, key=key) == sorted((r for r in kept if not any(brute_overlap(r[1], t) for _, t in items)), key=key) and len(kept) - len(left) == 4

    mixed = P.STAGES[3][1](spark, pure, d)
    assert mixed.columns == df.columns
    drawn = rows(mixed)
    assert set(drawn) <= set(left) and {r[2] for r in drawn} == {"a", "b", None}

    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    files = P.STAGES[4][1](spark, mixed, d).orderBy("start").collect()
    code = lambda x: np.array([*t.encode(x or "", add_special_tokens=False).ids, 1], "<u4")
    want = sorted(((-1 if i is None else i), len(code(x)), zlib.crc32(code(x).tobytes())) for i, x, _ in drawn)
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_tokens, r.ids_crc32) for r in files) == want
    assert all(a.start + a.n_tokens == b.start for a, b in zip(files, files[1:]))


def test_run_leaves_only_its_result(spark, tables):
    import os

    from fieldlamp.session import shared_dir

    folder = shared_dir(spark).removeprefix("file://")
    before = set(os.listdir(folder))
    got = P.run(spark, tables[0])
    assert got.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and got.count() > 100
    left = {x.rsplit("-", 1)[0] for x in set(os.listdir(folder)) - before}
    assert left == {"pipeline-ids"}


def test_run_on_empty_tables(spark, tmp_path):
    assert P.run(spark, write(spark, tmp_path, [], [], [])).count() == 0
