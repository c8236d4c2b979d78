"""Chapters and exports in batches; reflow by way of written steps."""

import random

import pyarrow as pa

from fieldlamp.operators import corpus as P, merge as M, reflow as R


def walked(rows, cut, least):
    """One document's chapters, by a plain walk."""
    runs = []
    for pos, heading, words in sorted(rows):
        if not runs or (heading and runs[-1][1] >= cut):
            runs.append([pos, 0])
        runs[-1][1] += words
    out, carry = [], None
    for first, n in runs:
        first, n = (carry[0], carry[1] + n) if carry else (first, n)
        carry = [first, n] if n < least else None
        out += [] if carry else [[first, n]]
    if carry and out:
        out[-1][1] += carry[1]
    return out if out or not carry else [carry]


def test_chapters_are_walked_a_task_and_not_a_group(spark):
    r = random.Random(3)
    rows = [(k, pos, r.random() < 0.3, r.randint(0, 30)) for k in (None, *range(300)) for pos in range(r.randint(1, 60))]
    r.shuffle(rows)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "17")  # documents over the edges of batches
    try:
        x = P.chapters(spark.createDataFrame(rows, "k long, pos long, heading boolean, words long"), "k", 100, 40)
        got = sorted(((row.k, row.chapter, row.first, row.words) for row in x.collect()), key=str)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    want = [(k, i, *c) for k in (None, *range(300)) for i, c in enumerate(walked([y[1:] for y in rows if y[0] == k], 100, 40), 1)]
    assert got == sorted(want, key=str)
    assert "FlatMapGroups" not in x._jdf.queryExecution().executedPlan().toString()


def test_pieces_come_in_batches():
    batch = pa.RecordBatch.from_arrays([pa.array(range(5000)), pa.array([f"customer {i} " * 9 for i in range(4999)] + [None])], ["key", "payload"])
    out = list(M.cut_pieces([batch], 40))
    assert len(out) == 1 and out[0].schema.field("key").type == pa.int64()
    assert out[0].column("key").unique().to_pylist() == list(range(5000))


def test_reflow_reads_its_lines_once(spark):
    """Before, the lines' own plan stood eight times and more in the last one."""
    docs = spark.createDataFrame([(1, "CHAPTER ONE\nIt was so.\n\nAnd on it went,\nand on."), (2, None)], "doc_id long, text string")
    x = R.blocks(R.lines_of(docs))
    assert [(r.block, r.kind, r.text) for r in x.orderBy("block").collect()] == [(1, "h1", "CHAPTER ONE"), (2, "p", "It was so."), (3, "p", "And on it went, and on.")]
    assert x._jdf.queryExecution().executedPlan().toString().count("Window") < 15
