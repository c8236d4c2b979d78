import random

from pyspark.sql import functions as F

from fieldlamp.operators import builds as U, index as X, retrieval as S
from fieldlamp.session import new_path, written
from fieldlamp.sources import files


def plain_top(spark, docs, queries, k):
    terms = queries.select(F.explode("terms").alias("term"))
    posts = written(S.wanted_postings(docs, terms), "postings")
    scored = S.bm25(posts, queries.withColumn("terms", F.array_distinct("terms")), *S.lengths(posts))
    return {(r.qid, r.doc_id, r.score, r.rank) for r in S.top(scored, k).collect()}


def test_index_gives_what_a_scan_gives_and_skips_segments(spark):
    rnd = random.Random(3)
    words = [f"w{i}" for i in range(300)]
    docs = [(i, " ".join(rnd.choices(words, [1 / (j + 1) for j in range(300)], k=rnd.choice([0, 5, 40, 200])) + (["rare"] * 3 if i % 150 == 0 else []))) for i in range(3000)] + [(9000, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    queries = spark.createDataFrame([(1, ["rare", "w1"]), (2, ["w0", "w0", "w250"]), (3, ["nowhere"]), (4, []), (5, ["w299", "rare"])], "qid long, terms array<string>")
    path = new_path(spark, "index")
    X.build(df, path, buckets=8, segment=64)
    index = X.Index(spark, path)
    want = plain_top(spark, df, queries, 10)
    assert {tuple(r) for r in index.top(queries, 10).collect()} == want and len(want) == 30
    read = {r.qid: (r.segments, r.read) for r in index.search(queries, 10)[1].collect()}
    assert read[1][1] < read[1][0] / 2  # most segments can't reach the tenth score
    few = {tuple(r) for r in index.top(queries, 4000).collect()}
    assert few == plain_top(spark, df, queries, 4000)
    X.build(df.limit(0), path + "-0", buckets=2)
    assert X.Index(spark, path + "-0").top(queries, 10).count() == 0


def test_pointers_are_never_absent(spark, tmp_path):
    root = str(tmp_path / "lib")
    for g in ("a", "b", "c", "b"):
        files.publish(spark.createDataFrame([(g,)], "g string"), root, g)
        assert [r.g for r in files.current(spark, root).collect()] == [g]
    names = files.names_in(spark, root)
    assert [x for x in names if x.startswith("gen=")] == ["gen=b", "gen=c"]
    # a publication that died before its pointer was renamed changes nothing
    (tmp_path / "lib" / "CURRENT-000000000099.new").write_text("z")
    assert [r.g for r in files.current(spark, root).collect()] == ["b"]


def test_a_build_goes_on_where_it_stopped(spark):
    path, root = new_path(spark, "build"), new_path(spark, "published")
    rows = spark.createDataFrame([(i, f"text {i}") for i in range(200)] + [(None, "x"), (7, "again")], "id long, text string")
    calls = []

    def step(part, dies_at=None):
        calls.append(1)
        if len(calls) == dies_at:
            raise RuntimeError("killed")
        return part.withColumn("n", F.char_length("text"))

    identity = {"model": "length", "dims": 1}
    try:
        U.build(rows, "id", lambda p: step(p, 3), path, identity, ranges=12, wave=2)
    except RuntimeError:
        pass
    assert len(U.noted(spark, path)) == 4  # two waves stand
    assert len(U.build(rows, "id", step, path, identity, ranges=12, wave=2)) == 8
    assert U.build(rows, "id", step, path, identity, ranges=12, wave=2) == []
    key = lambda r: str(r)
    same = lambda r: sorted(map(tuple, U.built(spark, path).select("id", "text", "n").collect()), key=key) == sorted(((*x, len(x[1])) for x in r), key=key)
    assert same([tuple(r) for r in rows.collect()])
    changed = rows.filter("id <> 5 or id is null").unionByName(spark.createDataFrame([(5, "other")], "id long, text string"))
    try:
        U.publish(changed, "id", path, root, "1", ranges=12)
        raise AssertionError("published")
    except ValueError as e:
        assert "not built" in str(e)
    assert len(U.build(changed, "id", step, path, identity, ranges=12, wave=2)) == 1 and same([tuple(r) for r in changed.collect()])
    U.publish(changed, "id", path, root, "1", ranges=12)
    assert files.current(spark, root).count() == 202
    try:
        U.build(rows, "id", step, path, {"model": "other", "dims": 1}, ranges=12)
        raise AssertionError("built")
    except U.IdentityChanged:
        pass
    empty = new_path(spark, "build")
    assert U.build(rows.limit(0), "id", step, empty, identity, ranges=4) == []


def test_streaks_of_a_stream_that_is_restarted(spark, tmp_path):
    import datetime

    from fieldlamp.streaming import jobs

    rnd = random.Random(4)
    at = datetime.datetime(2026, 1, 1)
    rows = [(i, i % 7 if i % 50 else None, (at + datetime.timedelta(minutes=i // 3)).replace(tzinfo=datetime.timezone.utc), rnd.choice([5.0, 10.0, 30.0, None])) for i in range(900)]
    schema = "event_id long, user_id long, at timestamp, value double"
    folder, out, state = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state")
    for k in range(6):
        spark.createDataFrame(rows[150 * k : 150 * k + 150], schema).coalesce(1).write.mode("append").parquet(folder)
        if k in (2, 5):  # the second run begins at the first one's checkpoint
            stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
            jobs.drained_once(jobs.streaks(stream, 20.0, 3), out, state)
    got = sorted((str(r.user_id), r.event_id) for r in spark.read.parquet(out).collect())
    run, want = {}, []
    for i, user, _, value in rows:
        run[user] = run.get(user, 0) + 1 if value is not None and value < 20 else 0
        want += [(str(user), i)] * (run[user] == 3)
    assert got == sorted(want) and len(want) > 20


def test_blocks_are_shuffled_once_and_segments_end_by_bytes(spark):
    store = spark.sparkContext._jsc.sc().statusStore()

    def shuffled(since):
        stages = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._gateway.jvm.double, 0), None)
        found = {stages.apply(i).stageId(): stages.apply(i).shuffleWriteRecords() for i in range(stages.size())}
        return found, sum(n for i, n in found.items() if i not in since)

    texts = [" ".join(f"w{(i * 7 + j) % 90}" for j in range(60)) + " also" * 3 for i in range(400)] + [None, "", "é" * 4000, "a " * 5000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    path, (since, _) = new_path(spark, "index"), shuffled({})
    X.build(df, path, buckets=4, segment=64)
    # 7 segments of at most 93 terms; 400 documents of 61 terms were shuffled before they were counted and twice after
    assert shuffled(since)[1] <= 7 * 93 + 10
    index = X.Index(spark, path)
    assert (index.docs, index.mean) == (404, (400 * 63 + 1 + 5000) / 404)
    assert index.blocks.agg(F.sum("n")).first()[0] == 400 * 61 + 2
    queries = spark.createDataFrame([(1, ["w3", "also"]), (2, ["a", "é" * 4000])], "qid long, terms array<string>")
    assert {tuple(r) for r in index.top(queries, 500).collect()} == plain_top(spark, df, queries, 500)
    schema = "term string, segment long, doc array<long>, tf array<int>, dl array<int>"
    small = df.select(F.col("doc_id").alias("doc"), X.T.all_tokens(F.col("text")).alias("t")).mapInArrow(X.in_segments(64, 2000), schema).collect()
    segments = {}
    for r in small:
        segments.setdefault(r.segment, []).append(r)
    assert len(segments) > 50 and all([r.term for r in rows].count("") == 1 for rows in segments.values())
    assert sorted(d for r in small if r.term == "" for d in r.doc) == list(range(404))
    assert sum(sum(r.tf) for r in small) == 400 * 63 + 1 + 5000
