"""Toxicity by maximum-scoring segments of token log-odds.

Tokens are runs of letters, lower-cased, wherever they stand in a word; a run longer than ``LONGEST`` is several tokens.
Every prefix of 3 letters or more, and the whole token, is a feature. A feature's count is that of the documents that hold
its tokens (a word that one document repeats is one observation), summed over its tokens; log-odds of the features
between toxic and clean labelled documents have a Dirichlet prior proportional to the whole corpus, which weighs
``PRIOR_SHARE`` of the observations. A feature counts as
evidence if the log-odds less ``deviations`` standard deviations stays above ``least_weight``; as the deviation falls with
the counts, few labels keep the features that are clearest. A token weighs what its best feature does, every other token
a small loss (the log-odds of a token that is no evidence). The maximal scoring segments of a document, all of them, come
from one linear scan (Ruzzo and Tompa) over its evidence, with gaps as single losses. By extreme-value theory
n * exp(-S) segments of score S are expected in n tokens of clean text; the segments of a document are aggregated as the
log of the sum of exp(S) / n, and a logistic function of it, fitted on a histogram of all training documents, gives the
score.

Passes: the toxic training documents give the candidates (features of ``LEAST_DOCS`` of them, however many there are; of fewer, where there are few); the labelled
ones leave those that could be evidence whatever their share of the corpus; one pass over all documents counts these and
only these, so what is shuffled is their counts; labelled documents give the loss and the histogram; the last
pass scores. The classifier is fitted on at most ``sample`` labelled rows (of smallest hash; the default exceeds the labels
of the test tables), which are broadcast up to ``BROADCAST_MOST`` rows; the counts behind the prior cover every document.
Candidates and evidence of up to ``LEXICON_MOST`` features go to the executors as a dictionary; beyond that, features meet
them in a join; a test shows that both give the same scores.

Defined results: a null or wordless text has no segments and the score of a clean document; a null doc_id hashes as the
empty string; labels of unknown documents, null labels and further labels of a document are ignored (the largest
counts); without toxic or clean training rows every score is 0; repeated rows are scored alike; other columns, whatever
their names, are ignored, and pass through ``keep_clean``; an empty table gives an empty table. Passages are given in
words of the text.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StructType

from .common import bounded, small_batches, staged, unstage, words_of_batch

SAMPLE, LEXICON_MOST = 150_000, 200_000
PRIOR_SHARE = 0.05  # of the observations, so that a larger table is learnt from alike
LEAST_DOCS = 10  # toxic documents that have to hold a feature, however many there are; fewer, two at least, where these are over a two hundredth of them
PIECE = 4 << 20  # bytes of text that a task looks at together
HELD_FEATURES = 100_000  # that a task counts before it starts anew
BROADCAST_MOST = 1_000_000  # rows of 12 bytes
LETTERS = re.compile(r"[^\W\d_]+")
SHORTEST, LONGEST = 3, 12
NOTHING = -12.0  # the statistic of a document without evidence
LOW, HIGH, STEP = -12.0, 20.0, 0.25  # the histogram's bins; what lies beyond counts in the outermost


def fold(doc_id: Column) -> Column:
    """The remainder of crc32(doc_id as text) by 3."""
    text = F.coalesce(doc_id.cast("string"), F.lit(""))
    return F.pmod(F.crc32(text.cast("binary")), F.lit(3)).cast("int")


def tokens_of(word: str) -> list[str]:
    """All runs of letters of a word, cut after LONGEST letters; one empty token if it has none."""
    word = word.lower()
    if len(word) <= LONGEST and word.isalpha():
        return [word]
    return [m[i : i + LONGEST] for m in LETTERS.findall(word) for i in range(0, len(m), LONGEST)] or [""]


def tokens_of_batch(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str]]:
    """Where each text's tokens begin (and the end), their codes, the word of its text that each stands in, and the tokens."""
    begin, words = words_of_batch(texts)
    codes: dict[str, int] = {}
    of = [[codes.setdefault(t, len(codes)) for t in tokens_of(w)] for w in words.dictionary.to_pylist()]
    sizes = np.fromiter(map(len, of), np.int64, len(of))
    flat, starts = np.fromiter((c for x in of for c in x), np.int64, int(sizes.sum())), np.cumsum(sizes) - sizes
    entries = words.indices.to_numpy()
    n = sizes[entries]
    ends = np.cumsum(n)
    within = np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - n, n)
    place = np.repeat(np.arange(len(entries)) - np.repeat(begin[:-1], np.diff(begin)), n)
    return np.concatenate([[0], ends])[begin], flat[np.repeat(starts[entries], n) + within], place, list(codes)


def features_of(token: str) -> list[str]:
    """Prefixes of SHORTEST letters or more, and the token (with fewer letters too)."""
    return [token[:k] + "_" for k in range(SHORTEST, len(token))] + [token] if token else []


@dataclass(frozen=True)
class Model:
    weights: dict[str, float] | DataFrame  # of features
    loss: float
    slope: float = 0.0
    shift: float = -100.0


def _held(piece: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """(document, token code) of all pairs that occur, and the tokens."""
    begin, codes, _, tokens = tokens_of_batch(piece.column("text"))
    held = np.unique(np.repeat(np.arange(piece.num_rows), np.diff(begin)) * max(1, len(tokens)) + codes)
    return held // max(1, len(tokens)), held % max(1, len(tokens)), tokens


COUNTED = "feature string, n long, toxic long, clean long"


class Matcher:
    """Which tokens hold which of some features: in sorted order they are a range a feature."""

    def __init__(self, features: list[str]):
        self.low = np.array([f.removesuffix("_") for f in features], f"U{LONGEST}")
        self.high = np.char.add(self.low, "\U0010ffff")
        self.begins = np.array([f.endswith("_") for f in features], bool)

    def ranges(self, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First place and end, among sorted tokens, of every feature's."""
        low, high = np.searchsorted(tokens, self.low), np.searchsorted(tokens, self.high)
        same = low < high
        same[same] = tokens[low[same]] == self.low[same]
        return np.where(self.begins, low + same, low), np.where(self.begins, high, low + same)


def in_order(tokens: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted tokens, and the code of each."""
    array = np.array(tokens, f"U{LONGEST}")
    order = np.argsort(array, kind="stable")
    return array[order], order


def _counts(wanted: set[str] | None):
    """Documents by feature, among all, toxic and clean ones; the feature "" has the sums over all tokens. With wanted, only of
    these features."""

    matcher = None if wanted is None else Matcher(sorted(wanted))
    names = [] if wanted is None else ["", *sorted(wanted)]

    def documents(piece):
        """(3, tokens) documents that hold a token: all, toxic and clean ones; and the tokens."""
        of, codes, tokens = _held(piece)
        label = piece.column("label").fill_null(-1).to_numpy(zero_copy_only=False)[of]
        return np.stack([np.bincount(codes[keep], minlength=len(tokens)) for keep in (slice(None), label == 1, label == 0)]), tokens

    def out(names, total):
        used = np.flatnonzero(total.any(0) | (np.arange(total.shape[1]) == 0))
        return pa.RecordBatch.from_arrays([pa.array(names, pa.string()).take(pa.array(used)), *(pa.array(x[used]) for x in total)], ["feature", "n", "toxic", "clean"])

    def run(batches):
        total = np.zeros((3, len(names)), np.int64)
        for piece in small_batches(batches, "text", PIECE):
            n, tokens = documents(piece)
            array, order = in_order(tokens)
            low, high = matcher.ranges(array)
            upto = np.concatenate([np.zeros((3, 1), np.int64), np.cumsum(n[:, order], axis=1)], axis=1)
            total[:, 1:] += upto[:, high] - upto[:, low]
            total[:, 0] += n.sum(1)
        yield out(names, total)

    def run_all(batches):
        known, total = {"": 0}, np.zeros((3, 1), np.int64)
        for piece in small_batches(batches, "text", PIECE):
            n, tokens = documents(piece)
            features = [[known.setdefault(x, len(known)) for x in features_of(t)] for t in tokens]
            sizes = np.fromiter(map(len, features), np.int64, len(features))
            at, of = np.fromiter(chain.from_iterable(features), np.int64, int(sizes.sum())), np.repeat(np.arange(len(sizes)), sizes)
            total = np.pad(total, ((0, 0), (0, len(known) - total.shape[1])))
            for row, x in zip(total, n):
                row += np.bincount(at, weights=x[of], minlength=len(known)).astype(np.int64)
            total[:, 0] += n.sum(1)
            if len(known) > HELD_FEATURES:
                yield out(list(known), total)
                known, total = {"": 0}, np.zeros((3, 1), np.int64)
        yield out(list(known), total)

    return run_all if wanted is None else run


def _evident(weights: dict[str, float]):
    """Documents' tokens that are evidence, by label."""
    matcher = Matcher(list(weights))

    def run(batches):
        for piece in small_batches(batches, "text", PIECE):
            of, codes, tokens = _held(piece)
            array, order = in_order(tokens)
            edges = np.zeros(len(tokens) + 1, np.int64)
            for places, step in zip(matcher.ranges(array), (1, -1)):
                np.add.at(edges, places, step)
            evident = np.zeros(len(tokens), bool)
            evident[order] = np.cumsum(edges[:-1]) > 0
            known = evident[codes]
            label = piece.column("label").to_numpy(zero_copy_only=False)[of]
            yield pa.RecordBatch.from_arrays([pa.array([1, 0], pa.int32()), pa.array([int((known & (label == y)).sum()) for y in (1, 0)])], ["label", "n"])

    return run


def training_rows(labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(known, label) of the rows to learn from, sample at most."""
    rows = labels.select(F.col("doc_id").cast("long").alias("known"), F.col("toxic").cast("int").alias("toxic")).filter("known is not null and toxic is not null")
    rows = rows.filter(fold(F.col("known")) != 1).groupBy("known").agg((F.max("toxic") > 0).cast("int").alias("label"))
    return staged(rows.orderBy(F.xxhash64("known"), "known").limit(sample), "training-rows")


def fit(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE, least_weight: float = 2.0, prior: float | None = None, deviations: float = 1.0, lexicon_most: int = LEXICON_MOST) -> Model:
    bounded(documents.sparkSession)
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    known = training_rows(labels, sample)
    near = F.broadcast(known) if sample <= BROADCAST_MOST else known
    labelled = texts.join(near, texts["doc_id"] == near["known"]).select("text", "label")
    add = lambda rows, wanted: rows.mapInArrow(_counts(wanted), COUNTED).groupBy("feature").agg(*[F.sum(c).alias(c) for c in ("n", "toxic", "clean")])
    least_docs = min(LEAST_DOCS, max(2, -(-known.filter("label = 1").count() // 200)))
    candidates = staged(add(labelled.filter("label = 1"), None).filter(F.col("toxic") >= least_docs).select("feature"), "toxic-features")
    seen = staged(_only(add, labelled, candidates, lexicon_most), "labelled-counts")
    unstage(candidates)
    total = seen.filter("feature = ''").first()
    if not total or not total.toxic or not total.clean:
        return Model({}, 0.0)
    prior = prior or PRIOR_SHARE * (total.toxic + total.clean)

    def weight(a: Column) -> Column:
        odds = lambda y, t: F.log((F.col(y) + a) / (F.lit(float(t + prior)) - F.col(y) - a))
        return odds("toxic", total.toxic) - odds("clean", total.clean) - deviations * F.sqrt(1 / (F.col("toxic") + a) + 1 / (F.col("clean") + a))

    # whatever its share of the corpus, a feature weighs no more than this; steps of a twentieth change less than the margin
    shares = [x for x in np.exp(np.arange(-9, math.log(prior), 0.05)).tolist() if x < prior] or [prior / 2]
    most = F.array_max(F.transform(F.array(*map(F.lit, shares)), weight))
    able = staged(seen.filter((F.col("feature") != "") & (F.col("toxic") >= least_docs)).filter(most + 0.1 >= least_weight), "able-features")
    unstage(seen)
    everywhere = texts.select("text", F.lit(None).cast("int").alias("label"))
    counts = staged(_only(add, everywhere, able.select("feature"), lexicon_most).select("feature", "n"), "feature-counts")
    n = counts.filter("feature = ''").first()["n"]
    evidence = able.drop("n").join(counts, "feature").withColumn("weight", weight(F.col("n") * F.lit(prior / n))).filter(F.col("weight") >= least_weight).select("feature", "weight")
    evidence = staged(evidence, "evidence")
    unstage(counts, able)
    size = evidence.count()
    if not size:
        return Model({}, 0.0)
    weights = {r.feature: r.weight for r in evidence.collect()} if size <= lexicon_most else evidence
    if size <= lexicon_most:
        held = labelled.mapInArrow(_evident(weights), "label int, n long").groupBy("label").agg(F.sum("n").alias("n"))
    else:
        words = labelled.withColumn("row", F.monotonically_increasing_id())
        words = staged(words, "labelled")
        tokens = words.select("row", "text").mapInArrow(_words, WORDS).select("row", "token").distinct()
        hit = exploded(tokens).join(evidence, "feature").select("row", "token").distinct()
        held = hit.join(words.select("row", "label"), "row").groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    held = {r.label: r.n for r in held.collect()}
    toxic, clean = held.get(1, 0), held.get(0, 0)
    loss = -math.log((1 - toxic / total.toxic) / (1 - clean / total.clean)) if toxic < total.toxic else 1.0
    model = Model(weights, max(loss, 1e-3))
    learnt = statistics(labelled, model, F.col("label")).select(F.col("key").alias("label"), "statistic")
    inside = F.least(F.greatest(F.col("statistic"), F.lit(LOW)), F.lit(HIGH - STEP))
    bins = learnt.groupBy(F.floor((inside - LOW) / STEP).alias("b")).agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("y")).collect()
    slope, shift = logistic([(LOW + (r.b + 0.5) * STEP, r.n, r.y) for r in bins]) if bins else (0.0, -100.0)
    return Model(weights, model.loss, slope, shift)


def exploded(tokens: DataFrame) -> DataFrame:
    """Rows of tokens with each of their features."""
    n = F.char_length("token")
    lengths = F.sequence(F.least(F.lit(SHORTEST), n), n)
    rows = tokens.filter("token <> ''").select("*", F.explode(lengths).alias("k"))
    return rows.withColumn("feature", F.expr("concat(left(token, k), case when char_length(token) > k then '_' else '' end)")).drop("k")


def _only(add, rows: DataFrame, features: DataFrame, lexicon_most: int) -> DataFrame:
    """Counts of these features and of all tokens together."""
    if features.count() <= lexicon_most:
        return add(rows, {r.feature for r in features.collect()})
    wanted = features.unionByName(features.sparkSession.createDataFrame([("",)], "feature string"))
    return add(rows, None).join(wanted, "feature", "left_semi")


def logistic(bins: list[tuple[float, int, int]], ridge: float = 1e-2) -> tuple[float, float]:
    """Slope and shift of a logistic function by Newton's method on (x, rows, toxic rows)."""
    x, n, y = (np.array(c, float) for c in zip(*bins))
    at = np.zeros(2)
    design = np.stack([x, np.ones_like(x)], 1)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(design @ at, -30, 30)))
        gradient = design.T @ (y - n * p) - ridge * at
        hessian = (design * (n * p * (1 - p))[:, None]).T @ design + ridge * np.eye(2)
        at = at + np.clip(np.linalg.solve(hessian, gradient), -2, 2)
    return float(at[0]), float(at[1])


def segments(places: list[int], weights: list[float], loss: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first word, last word, score) of a text whose words lose, but for the given ones.
    Linear: every candidate is merged once."""
    starts, ends, lefts, rights = [], [], [], []  # of the candidates; scores before and after each
    links: list[int] = []  # the nearest earlier candidate with a smaller left score
    total, before = 0.0, -1
    for at, w in zip(places, weights):
        total -= loss * (at - before - 1)
        before = at
        start, left, right = at, total, total + w
        total = right
        while True:
            j = len(lefts) - 1
            while j >= 0 and lefts[j] >= left:
                j = links[j]
            if j < 0 or rights[j] >= right:
                starts.append(start), ends.append(at), lefts.append(left), rights.append(right), links.append(j)
                break
            start, left = starts[j], lefts[j]
            for x in (starts, ends, lefts, rights, links):
                del x[j:]
    return [(s, e, r - l) for s, e, l, r in zip(starts, ends, lefts, rights)]


def statistic_of(found: list[tuple[int, int, float]], n: int) -> float:
    """log(sum of exp(score) / n), NOTHING at least."""
    if not found:
        return NOTHING
    top = max(s for _, _, s in found)
    return max(top + math.log(sum(math.exp(s - top) for _, _, s in found)) - math.log(n), NOTHING)


OUT = "statistic double, n_passages long, passages array<struct<first:int,last:int,score:double>>"
PASSAGES = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32()), ("score", pa.float64())]))


def _rows(found: list[list[tuple[int, int, float]]], sizes, words) -> list[pa.Array]:
    """statistic, number of significant passages, and these in words. words: per text, the words of its evidence by place."""
    kept = [[dict(first=w[a], last=w[b], score=s) for a, b, s in x if n * math.exp(-s) < 0.05] for x, n, w in zip(found, sizes, words)]
    return [pa.array([statistic_of(x, n) for x, n in zip(found, sizes)], pa.float64()), pa.array(map(len, kept), pa.int64()), pa.array(kept, PASSAGES)]


def _scan(weights: dict[str, float], loss: float):
    features = sorted(weights, key=weights.__getitem__)
    matcher, heavy = Matcher(features), [weights[f] for f in features]

    def run(batches):
        for piece in small_batches(batches, "text", PIECE):
            begin, codes, word, tokens = tokens_of_batch(piece.column("text"))
            array, order = in_order(tokens)
            in_place = np.zeros(len(tokens))
            low, high = matcher.ranges(array)
            for i in np.flatnonzero(low < high).tolist():  # the heaviest feature of a token comes last
                in_place[low[i] : high[i]] = heavy[i]
            best = np.zeros(len(tokens))
            best[order] = in_place
            w = best[codes]
            hits = np.flatnonzero(w)
            cut = np.searchsorted(hits, begin)
            at = [(hits[a:z] - s).tolist() for a, z, s in zip(cut, cut[1:], begin)]
            found = [segments(x, w[hits[a:z]].tolist(), loss) if x else [] for x, a, z in zip(at, cut, cut[1:])]
            words = [dict(zip(x, word[hits[a:z]].tolist())) for x, a, z in zip(at, cut, cut[1:])]
            yield pa.RecordBatch.from_arrays([piece.column("key"), *_rows(found, np.diff(begin), words)], ["key", "statistic", "n_passages", "passages"])

    return run


WORDS = "row long, place int, word int, token string"


def _words(batches):
    for piece in small_batches(batches, "text", PIECE):
        begin, codes, word, tokens = tokens_of_batch(piece.column("text"))
        of = np.repeat(np.arange(piece.num_rows), np.diff(begin))
        places = pa.array(np.arange(len(codes)) - begin[:-1][of], pa.int32())
        yield pa.RecordBatch.from_arrays([piece.column("row").take(pa.array(of)), places, pa.array(word, pa.int32()), pa.array(tokens, pa.string()).take(pa.array(codes))], ["row", "place", "word", "token"])


def _scan_joined(loss: float):
    def run(batches):
        for batch in batches:
            hits = [y or [] for y in batch.column("hits").to_pylist()]
            found = [segments([h["place"] for h in x], [h["weight"] for h in x], loss) for x in hits]
            words = [{h["place"]: h["word"] for h in x} for x in hits]
            yield pa.RecordBatch.from_arrays([batch.column("key"), *_rows(found, batch.column("n").to_pylist(), words)], ["key", "statistic", "n_passages", "passages"])

    return run


def statistics(documents: DataFrame, model: Model, key: Column) -> DataFrame:
    """(key, statistic, n_passages, passages) of every row of documents; key may be a struct."""
    bounded(documents.sparkSession)
    rows = documents.select(key.alias("key"), F.col("text").cast("string").alias("text"))
    schema = StructType([rows.schema["key"], *StructType.fromDDL(OUT)])
    if isinstance(model.weights, dict):
        return rows.mapInArrow(_scan(model.weights, model.loss), schema)
    rows = staged(rows.withColumn("row", F.monotonically_increasing_id()), "rows")
    words = rows.select("row", "text").mapInArrow(_words, WORDS)
    sizes = words.groupBy("row").agg(F.count(F.lit(1)).alias("n"))
    best = exploded(words).join(model.weights, "feature").groupBy("row", "place", "word").agg(F.max("weight").alias("weight"))
    hits = best.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("place", "word", "weight"))).alias("hits"))
    whole = rows.drop("text").join(sizes, "row", "left").join(hits, "row", "left").select("key", "hits", F.coalesce("n", F.lit(0)).alias("n"))
    return whole.mapInArrow(_scan_joined(model.loss), schema)


def score_of(statistic: Column, model: Model) -> Column:
    return 1 / (1 + F.exp(-(F.lit(model.slope) * statistic + F.lit(model.shift))))


def score(documents: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """(doc_id, held_out, score, predicted, n_passages, passages) of every row."""
    model = fit(documents, labels, **options)
    rows = statistics(documents, model, F.col("doc_id").cast("long"))
    rows = rows.select(F.col("key").alias("doc_id"), (fold(F.col("key")) == 1).alias("held_out"), score_of(F.col("statistic"), model).alias("score"), "n_passages", "passages")
    return rows.withColumn("predicted", (F.col("score") >= 0.7).cast("int"))


def keep_clean(documents: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """documents, all their columns, without those that are predicted toxic."""
    model = fit(documents, labels, **options)
    whole = F.struct(*[F.col(f"`{c}`") for c in documents.columns])
    rows = statistics(documents, model, whole)
    return rows.filter(score_of(F.col("statistic"), model) < 0.7).select("key.*")
