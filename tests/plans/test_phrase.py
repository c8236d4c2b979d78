from fieldlamp.operators import retrieval as S


def test_phrases_of_any_length(spark):
    docs = ["a b a b a b c", "b c", "a b c d", "a b x c", "c", ""]
    phrases = ["a b a b", "a b c", "c", "a b c d e", "b c", "a z"]
    texts = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    terms = spark.createDataFrame([(q, i, w) for q, p in enumerate(phrases) for i, w in enumerate(p.split())], "qid long, ord int, term string")
    want = {}
    for q, p in enumerate(phrases):
        for d, t in enumerate(docs):
            n = len(p.split())
            n = sum(t.split()[i : i + n] == p.split() for i in range(len(t.split())))
            want |= {(q, d): n} if n else {}
    assert {(r.qid, r.doc_id): r.n for r in S.phrase(S.positions(texts), terms).collect()} == want
    assert {(r.qid, r.doc_id): r.n for r in S.phrases_in(texts, terms).collect()} == want
