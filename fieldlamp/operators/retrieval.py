"""Keyword retrieval for batches of queries: postings, boolean matches, phrases, prefixes, BM25.

A batch is queries(qid, terms); postings are pre-aggregated to one row a term and document, and only those of query
terms leave the join with the (small) batch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import text as T
from ..session import written

K1, B = 1.2, 0.75


def postings(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, term, tf, dl) of every document."""
    t = docs.select(key, T.all_tokens(F.col(text)).alias("t"))
    rows = t.select(key, F.size("t").cast("long").alias("dl"), F.explode("t").alias("term"))
    return rows.groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf"), F.first("dl").alias("dl"))


def positions(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    return docs.select(key, F.posexplode(T.all_tokens(F.col(text))).alias("pos", "term"))


MARK = ""  # the term of the row that every document has in wanted_postings


def wanted_postings(docs: DataFrame, terms: DataFrame, key: str = "doc_id", text: str = "text", title_words: int = 0, title_weight: int = 1, carry: tuple[str, ...] = ()) -> DataFrame:
    """(key, term, tf, dl, first) of the wanted terms only, first being the term's first place from 1, and a row with the term MARK for each document.
    Tokens meet the terms before they are counted, so what is shuffled are the hits, not the tokens of the corpus. The first title_words tokens count
    title_weight times. Columns of the document in carry come along."""
    t = docs.select(key, *carry, F.explode(F.array(T.all_tokens(F.col(text)))).alias("t"))
    rows = t.select(key, *carry, F.size("t").cast("long").alias("dl"), F.posexplode(F.concat(F.array(F.lit(MARK)), F.col("t"))).alias("pos", "term"))
    # a range has a known size, so that a small batch is broadcast and the tokens stay where they are
    wanted = terms.select("term").unionByName(docs.sparkSession.range(1).select(F.lit(MARK).alias("term"))).distinct()
    tf = F.sum(F.when(F.col("pos") <= title_words, title_weight).otherwise(1))
    return rows.join(wanted, "term", "left_semi").groupBy(key, "term", "dl", *carry).agg(tf.alias("tf"), F.min("pos").alias("first"))


def lengths(posts: DataFrame) -> tuple[int, float]:
    """Documents and their mean length, from wanted_postings."""
    size = posts.filter(F.col("term") == MARK).agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("a")).first()
    return size.n, size.a or 1.0


def phrases_in(docs: DataFrame, terms: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """As ``phrase``, from texts: terms(qid, ord, term), ord from 0. A phrase begins to look where its rarest word stands; the
    few documents with such a place are then compared as token arrays, so no positions of other words are shuffled."""
    tokens = docs.select(key, T.all_tokens(F.col(text)).alias("t"))
    places = tokens.select(key, F.posexplode("t").alias("pos", "term"))
    df = places.join(terms.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    whole = terms.join(df, "term", "left").groupBy("qid").agg(
        F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "ord", "term")).alias("r"), F.transform(F.sort_array(F.collect_list(F.struct("ord", "term"))), lambda x: x["term"]).alias("phrase")
    )
    rare = written(whole.filter("r.df > 0").select("qid", "phrase", "r.ord", "r.term"), "rarest-words")
    starts = places.join(rare.select("qid", "ord", "term"), "term").select(key, "qid", (F.col("pos") - F.col("ord")).alias("start")).filter("start >= 0")
    by_doc = starts.groupBy(key).agg(F.collect_set(F.struct("qid", "start")).alias("starts"))
    met = tokens.join(by_doc, key).select(key, "t", F.explode("starts").alias("s")).select(key, "t", "s.*").join(rare.select("qid", "phrase"), "qid")
    same = F.slice("t", F.col("start") + 1, F.size("phrase")) == F.col("phrase")
    return met.filter(same).groupBy("qid", key).agg(F.count(F.lit(1)).alias("n"))


def query_terms(queries: DataFrame) -> DataFrame:
    """(qid, term, ord, n_terms) of queries(qid, terms)."""
    return queries.select("qid", F.size("terms").alias("n_terms"), F.posexplode("terms").alias("ord", "term"))


def matches(posts: DataFrame, queries: DataFrame, key: str = "doc_id") -> DataFrame:
    """(qid, key, found, n_terms): how many of a query's distinct terms a document has."""
    q = query_terms(queries)
    return posts.join(q, "term").groupBy("qid", key, "n_terms").agg(F.countDistinct("term").alias("found"))


def boolean(posts: DataFrame, queries: DataFrame, mode: str = "and", key: str = "doc_id") -> DataFrame:
    m = matches(posts, queries, key)
    return (m.filter("found = n_terms") if mode == "and" else m).select("qid", key)


def phrase(pos: DataFrame, terms: DataFrame, key: str = "doc_id") -> DataFrame:
    """How often documents hold phrases of any length, word beside word: terms(qid, ord, term), ord from 0. A phrase
    meets the positions of its rarest word; the others are then looked up in their places."""
    held = pos.join(terms.select("term").distinct(), "term")
    held_by = held.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    rarest = F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "ord", "term"))
    rare = terms.join(held_by, "term", "left").groupBy("qid").agg(rarest.alias("r"), F.count(F.lit(1)).alias("n_terms"))
    starts = pos.join(rare.select("qid", "n_terms", "r.ord", "r.term"), "term").select("qid", key, "n_terms", (F.col("pos") - F.col("ord")).alias("start"))
    wanted = starts.filter("start >= 0").distinct().join(terms, "qid").withColumn("pos", F.col("start") + F.col("ord")).drop("ord")
    met = wanted.join(held, [key, "pos", "term"]).groupBy("qid", key, "start", "n_terms").agg(F.count_distinct("pos").alias("found"))
    return met.filter("found = n_terms").groupBy("qid", key).agg(F.count(F.lit(1)).alias("n"))


def prefix_postings(docs: DataFrame, prefixes: DataFrame, key: str = "doc_id", text: str = "text", size: int = 3) -> DataFrame:
    """Postings of the words that share their first letters with a prefix."""
    rows = docs.select(key, F.explode(T.all_tokens(F.col(text))).alias("term")).withColumn("head", F.left("term", F.lit(size)))
    wanted = prefixes.select(F.left("prefix", F.lit(size)).alias("head")).distinct()
    return rows.join(wanted, "head", "left_semi").groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf"))


def prefix(posts: DataFrame, prefixes: DataFrame, key: str = "doc_id", size: int = 3) -> DataFrame:
    """Documents with a word that begins so: prefixes(qid, prefix) of size letters or more; an equi-join on the first
    letters comes before the test."""
    words = posts.withColumn("head", F.left("term", F.lit(size)))
    p = prefixes.withColumn("head", F.left("prefix", F.lit(size)))
    hit = words.join(p, "head").filter(F.startswith("term", F.col("prefix")))
    return hit.groupBy("qid", key).agg(F.sum("tf").alias("n"))


def bm25(posts: DataFrame, queries: DataFrame, n_docs: int, avg_len: float, key: str = "doc_id", tf: str = "tf", carry: tuple[str, ...] = (), also: tuple[Column, ...] = ()) -> DataFrame:
    """(qid, key, score): sum over the terms of ln(1 + (N - df + 0.5) / (df + 0.5)) * tf (k1 + 1) / (tf + k1 (1 - b + b dl / avg)). With the documents'
    columns in carry, and other aggregates over a query's postings (and its n_terms) in a document."""
    q = query_terms(queries)
    wanted = q.select("term").distinct()
    hit = posts.join(wanted, "term")
    df = hit.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = F.ln(1 + (F.lit(float(n_docs)) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    norm = F.col(tf) + K1 * (1 - B + B * F.col("dl") / F.lit(avg_len))
    scored = hit.join(df, "term").withColumn("s", idf * F.col(tf) * (K1 + 1) / norm)
    return scored.join(q.select("qid", "term", "n_terms"), "term").groupBy("qid", key, *carry).agg(F.round(F.sum("s"), 6).alias("score"), *also)


def top(scored: DataFrame, k: int | None, by: str = "score", key: str = "doc_id", part: str = "qid") -> DataFrame:
    """The k best rows of each query, all without k, ranked; ties by key."""
    w = Window.partitionBy(part).orderBy(F.desc(by), key)
    ranked = scored.withColumn("rank", F.row_number().over(w).cast("long"))
    return ranked if k is None else ranked.filter(F.col("rank") <= k)


def and_then_or(strict: DataFrame, loose: DataFrame, below: int, k: int, key: str = "doc_id") -> DataFrame:
    """Rows of strict by score; where a query has fewer than ``below``, those of loose after them, each document once,
    k at most."""
    n = strict.groupBy("qid").agg(F.count(F.lit(1)).alias("n"))
    both = strict.withColumn("tier", F.lit(0)).unionByName(
        loose.join(n, "qid", "left").filter(F.coalesce("n", F.lit(0)) < below).drop("n").withColumn("tier", F.lit(1))
    )
    once = both.withColumn("nth", F.row_number().over(Window.partitionBy("qid", key).orderBy("tier"))).filter("nth = 1").drop("nth")
    w = Window.partitionBy("qid").orderBy("tier", F.desc("score"), key)
    return once.withColumn("rank", F.row_number().over(w).cast("long")).filter(F.col("rank") <= k)
