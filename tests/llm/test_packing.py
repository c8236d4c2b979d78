import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from fieldlamp.llm import packing as P
from fieldlamp.llm.common import tokenizer_path
from fieldlamp.llm.queries import op13_sum_of_squares_packing

NAME = "word_bpe_49k.json"


def encoded(texts):
    from tokenizers import Tokenizer

    return [[*e.ids, 0] for e in Tokenizer.from_file(tokenizer_path(NAME)).encode_batch([t or "" for t in texts], add_special_tokens=False)]


def wanted(rows, most):
    out = []
    for (d, _), ids in zip(rows, encoded(t for _, t in rows)):
        for piece, start in enumerate(range(0, len(ids), most)):
            x = ids[start : start + most]
            out.append((d, piece, start, len(x), zlib.crc32(np.array(x, "<u4").tobytes())))
    return sorted(out, key=repr)


def sound(rows, most):
    """Sequences without gaps or overlaps; how many there are."""
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for held in by.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at and length > 0
            at += length
        assert at <= most
    return len(by)


def literal_place(lengths, most):
    """Every gap tried, the sum of squares taken anew."""
    gaps, sequences = [], []
    for n in lengths:
        def squares(gs):
            return sum(gs.count(g) ** 2 for g in set(gs) if g)

        able = [g for g in sorted(set(gaps)) if g >= n]
        if able:
            best = min(able, key=lambda g: (squares([*gaps[: (i := gaps.index(g))], g - n, *gaps[i + 1 :]]), g))
            gaps[gaps.index(best)] = best - n
            sequences.append(best)
        else:
            gaps.append(most - n)
            sequences.append(most)
    return sequences, len(gaps)


def test_place_takes_the_smallest_sum_of_squares():
    rnd = random.Random(4)
    for most in (8, 30, 100):
        lengths = [rnd.randint(1, most - 1) for _ in range(120)]
        for order in (lengths, sorted(lengths, reverse=True)):
            sequence, offset, room = P.place(np.array(order), most)
            gaps, n = literal_place(order, most)
            assert [most - o for o in offset.tolist()] == gaps and len(room) == n
            for k in range(n):
                assert most - sum(x for x, s in zip(order, sequence) if s == k) == room[k]


def test_packing_is_whole_and_tight(spark):
    rnd = random.Random(2)
    rows = [(rnd.choice([i, i, None, 5]), " ".join(rnd.choices(["alpha", "Beta", "gamma!", "δ", "it's"], k=rnd.choice([0, 1, 5, 30, 200])))) for i in range(300)]
    rows += [(1, None), (2, ""), (3, "x " * 5000), (4, "y " * 199)]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, row int, offset int")
    for shard_pieces in (100_000, 40):
        packed = P.pack(df, NAME, most=200, shard_pieces=shard_pieces)
        got = packed.collect()
        assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got), key=repr) == wanted(rows, 200)
        part = [r.length for r in got if r.length < 200]
        least = len(got) - len(part) + max(-(-sum(part) // 200), sum(n > 100 for n in part))  # no sequence holds two of more than its half
        assert sound(got, 200) <= least * (1.02 if shard_pieces > 1000 else 1.05) + 1
        whole = P.sequences(packed).select("sequence_id", F.length("ids").alias("bytes"), F.crc32(F.expr("substring(ids, 1 + 4 * documents[0].offset, 4 * documents[0].length)")).alias("crc"), "documents").collect()
        by = {(r.sequence_id, r.offset): r for r in got}
        for w in whole:
            assert w.bytes == 4 * sum(x.length for x in w.documents) and by[w.sequence_id, 0].ids_crc32 == w.crc
            assert [(x.offset, x.length) for x in w.documents] == sorted((r.offset, r.length) for r in got if r.sequence_id == w.sequence_id)


def test_packing_of_nothing(spark):
    assert P.pack(spark.createDataFrame([], "doc_id long, text string"), NAME).count() == 0


def test_query_reaches_the_least_number(spark):
    d = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()]
    got = op13_sum_of_squares_packing(spark, d).collect()
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got), key=repr) == wanted(rows, 2048)
    full = sum(r.length == 2048 for r in got)
    assert sound(got, 2048) == full - (-sum(r.length for r in got if r.length < 2048) // 2048)
