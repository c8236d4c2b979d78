"""Grouping of spelling variants: pairs of words that one inserted, deleted or replaced letter parts, by two-dimensional range
reporting.

Words that share what stands before an edit position are an interval of the words in forward order; those that share what
stands after it are an interval of the words read backwards. A word of the vocabulary is a point (place in one order, place in the
other), so the words within one edit at a position are the points of a rectangle. A wavelet tree over the permutation between the
orders reports them in time by what is found. Words of one length answer replacements; those that are one longer answer insertions,
and a deletion is an insertion seen from the other word.

Distribution: an edit leaves the first or the second half of a word whole. So a word of length L goes, once by its first and once by its second
half, to the class of its own length and, as the longer word, to the class below; words that share class and half lie in one bucket.
Each bucket is one structure of about ``BUCKET_WORDS`` words, in which the half is part of the sort order. A half that more words share
is dealt to several buckets: each of its words is a point in one of them and asks in all, in blocks. Edits that both halves,
or several positions, could report are reported at one place: replacements are in one half, and an insertion counts at its last position.

Counts: runs of letters are counted per task and summed; a run whose crc32 with the document's id is divided by ``MODULUS`` loses one letter.

Defined results: a null text has no words; a null doc_id is the empty string; repeated rows count again; ties between forms are broken by
code points; words are cut nowhere, however long; other columns are ignored, whatever their names; an empty table gives an empty table.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from .common import bounded, compact, small_batches, staged, unstage

MODULUS = 199
SHORTEST = 6
HELD_WORDS = 200_000  # that a task counts before it sends them on
BUCKET_WORDS = 1 << 16
QUERIES_AT_ONCE = 1 << 19
RUN = re.compile(f"[A-Za-zÀ-ÿ]{{{SHORTEST},}}")


def _counted(modulus: int):
    def run(batches):
        held: Counter[str] = Counter()

        def out():
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])

        for piece in small_batches(batches, "text"):
            texts = pc.ascii_lower(pc.fill_null(compact(piece.column("text")), ""))
            for doc_id, text in zip(piece.column("doc_id").to_pylist(), texts.to_pylist()):
                begin = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
                found = (m[0] for m in RUN.finditer(text)) if len(text) > 1 << 22 else iter(RUN.findall(text))
                while own := Counter(islice(found, 1 << 19)):
                    for word, n in own.items():
                        h = zlib.crc32(word.encode(), begin)
                        if h % modulus:
                            held[word] += n
                        elif len(word) > SHORTEST:
                            held[word[: (k := h % len(word))] + word[k + 1 :]] += n
            if len(held) > HELD_WORDS:
                yield out()
                held.clear()
        if held:
            yield out()

    return run


def vocabulary(documents: DataFrame, least: int = 5, modulus: int = MODULUS) -> DataFrame:
    """(word, n) of the words of at least SHORTEST letters and least occurrences."""
    bounded(documents.sparkSession)
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_counted(modulus), "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)


class WaveletTree:
    """Over a permutation: a level a bit of its values, from the highest; each level keeps the order of the one above, zeros first."""

    def __init__(self, values: np.ndarray):
        self.bits = max(1, int(len(values) - 1).bit_length()) if len(values) else 1
        self.zeros_before, now = [], values.astype(np.int64)
        for k in reversed(range(self.bits)):
            one = (now >> k) & 1
            self.zeros_before.append(np.concatenate([[0], np.cumsum(1 - one)]))
            now = np.concatenate([now[one == 0], now[one == 1]])

    def report(self, x0: np.ndarray, x1: np.ndarray, y0: np.ndarray, y1: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, value) of every point with place in [x0, x1) and value in [y0, y1)."""
        query = np.flatnonzero((x0 < x1) & (y0 < y1))
        a, z, value = x0[query], x1[query], np.zeros(len(query), np.int64)
        for k, zeros in zip(reversed(range(self.bits)), self.zeros_before):
            low_a, low_z = zeros[a], zeros[z]
            high_a, high_z = zeros[-1] + a - low_a, zeros[-1] + z - low_z
            middle = value + (1 << k)
            low = (low_a < low_z) & (y0[query] < middle)
            high = (high_a < high_z) & (y1[query] > middle)
            query = np.concatenate([query[low], query[high]])
            a, z = np.concatenate([low_a[low], high_a[high]]), np.concatenate([low_z[low], high_z[high]])
            value = np.concatenate([value[low], middle[high]])
            keep = (value < y1[query]) & (value + (1 << k) > y0[query])
            query, a, z, value = query[keep], a[keep], z[keep], value[keep]
        return query, value


class Order:
    """Words, as rows of code points, in sorted order: their places, and the intervals of those that begin alike."""

    def __init__(self, letters: np.ndarray):
        text = np.ascontiguousarray(letters).view(f"U{letters.shape[1]}").reshape(-1)
        self.rows = np.argsort(text, kind="stable")
        self.place = np.empty(len(self.rows), np.int64)
        self.place[self.rows] = np.arange(len(self.rows))
        s = letters[self.rows]
        same = np.cumprod(s[1:] == s[:-1], axis=1, dtype=np.uint8).sum(1, dtype=np.int64)
        self.common = np.concatenate([[-1], same, [-1]])  # letters that a place shares with the one before it
        self.most = np.maximum(self.common[:-1], self.common[1:])[self.place]  # that a word shares with any other

    def interval(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """By place: first place and end of those whose first letters, so many, are the same."""
        n = len(self.rows)
        edge = np.flatnonzero(self.common < length)  # 0 and n are edges always
        which = np.searchsorted(edge, np.arange(n), side="right") - 1
        return edge[which], edge[which + 1]


def near_pairs(words: list[str], asks: np.ndarray, holds: np.ndarray, size: int, whole: int, backwards: bool) -> tuple[np.ndarray, np.ndarray]:
    """(asking word, other word) within one edit, beyond the first ``whole`` letters. Words have size letters, or one more;
    asks: words of size letters that look for others; holds: words that may be found. With backwards, words are given from their ends."""
    letters = np.array(words, dtype=f"U{size + 1}").view(np.uint32).reshape(len(words), size + 1)
    long = np.array([len(w) > size for w in words])
    back = letters[:, ::-1].copy()
    back[~long, :-1] = back[~long, 1:]
    back[~long, -1] = 0
    forward, reverse = Order(letters), Order(back)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for longer in (False, True):
        held = holds & (long == longer)
        if not held.any():
            continue
        upto = [np.concatenate([[0], np.cumsum(held[o.rows])]) for o in (forward, reverse)]
        at = reverse.rows[held[reverse.rows]]  # words by value
        value = np.empty(len(words), np.int64)
        value[at] = np.arange(len(at))
        tree = WaveletTree(value[forward.rows[held[forward.rows]]])
        waiting: list[tuple[np.ndarray, ...]] = []

        def answer():
            who, position, *box = map(np.concatenate, zip(*waiting))
            waiting.clear()
            q, v = tree.report(*box)
            one, other, position = who[q], at[v], position[q]
            keep = one != other
            if longer:  # of neighbouring positions with the same letter the word's last counts
                a, p = letters[other], position
                if backwards:
                    keep &= (p == 0) | (a[np.arange(len(p)), np.maximum(p - 1, 0)] != a[np.arange(len(p)), p])
                else:
                    keep &= (p == size) | (a[np.arange(len(p)), np.minimum(p + 1, size)] != a[np.arange(len(p)), p])
            found.append((one[keep], other[keep]))

        n_after = size if longer else size - 1  # letters before and after the edit
        first = whole + (1 if longer and backwards else 0)
        able = np.flatnonzero(asks & (forward.most + reverse.most >= n_after))
        low, high = n_after - reverse.most[able], forward.most[able]  # positions that leave both intervals with another word
        for p in range(max(first, int(low.min(initial=n_after + 1))), min(n_after, int(high.max(initial=-1))) + 1):
            who = able[(low <= p) & (p <= high)]
            if not len(who):
                continue
            (xa, xz), (ya, yz) = forward.interval(p), reverse.interval(n_after - p)
            f, r = forward.place[who], reverse.place[who]
            waiting.append((who, np.full(len(who), p), upto[0][xa[f]], upto[0][xz[f]], upto[1][ya[r]], upto[1][yz[r]]))
            if sum(len(x[0]) for x in waiting) > QUERIES_AT_ONCE:
                answer()
        if waiting:
            answer()
    one, other = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 2
    return one, other


PAIRS = "word string, n long, near string, near_n long"


def _bucket(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    out: list[pa.Table] = []
    table = table.combine_chunks()
    kinds = table.column("size").to_numpy() * 2 + table.column("side").to_numpy()
    for kind in np.unique(kinds).tolist():
        rows = table.take(pa.array(np.flatnonzero(kinds == kind)))
        rows = rows.group_by("word").aggregate([("n", "max"), ("holds", "max")]).rename_columns({"n_max": "n", "holds_max": "holds"})  # two blocks may meet here
        size, backwards = kind // 2, bool(kind % 2)
        words, holds = rows.column("word").to_pylist(), rows.column("holds").to_numpy()
        long = np.array([len(w) > size for w in words])
        if long.all() or len(words) < 2:
            continue
        read = [w[::-1] for w in words] if backwards else words
        one, other = near_pairs(read, ~long, holds.astype(bool), size, size - size // 2 if backwards else size // 2, backwards)
        ways = [(one, other), (other[long[other]], one[long[other]])]
        for a, b in ways:
            a, b = pa.array(a), pa.array(b)
            out.append(pa.table({"word": rows.column("word").take(a), "n": rows.column("n").take(a), "near": rows.column("word").take(b), "near_n": rows.column("n").take(b)}))
    empty = pa.table({c: pa.array([], pa.string() if c in ("word", "near") else pa.int64()) for c in ("word", "n", "near", "near_n")})
    return pa.concat_tables([empty, *(x.cast(empty.schema) for x in out)])


def near(words: DataFrame, bucket_words: int = BUCKET_WORDS) -> DataFrame:
    """(word, n, near, near_n) of all ordered pairs of words, of distinct (word, n), that differ in one letter."""
    length = F.char_length("word")
    roles = []
    for longer in (False, True):
        size = length - 1 if longer else length
        half = F.floor(size / 2).cast("int")
        for side in (0, 1):
            key = F.col("word").substr(F.lit(1), half) if side == 0 else F.col("word").substr(length - (size - half) + 1, size - half)
            roles.append(F.struct(F.lit(side).alias("side"), size.alias("size"), F.lit(longer).alias("longer"), key.alias("key")))
    rows = words.select("word", "n", F.explode(F.array(*roles)).alias("r")).select("word", "n", "r.side", "r.size", "r.longer", F.xxhash64("r.side", "r.size", "r.key").alias("h"))
    rows = rows.filter(F.col("size") >= SHORTEST)
    many = max(int(words.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-4 * words.count() // bucket_words))
    # halves that more words share than a bucket takes: their blocks
    hot = rows.groupBy("h").agg(F.ceil(F.count(F.lit(1)) / F.lit(bucket_words)).cast("int").alias("blocks")).filter("blocks > 1")
    own = F.pmod(F.xxhash64("word"), F.col("blocks")).cast("int")
    rows = rows.join(hot, "h", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("own", own)
    blocks = F.when(F.col("longer"), F.array("own")).otherwise(F.sequence(F.lit(0), F.col("blocks") - 1))
    dealt = rows.withColumn("block", F.explode(blocks)).withColumn("holds", F.col("block") == F.col("own"))
    bucket = F.pmod(F.xxhash64("h", "block"), F.lit(many)).alias("bucket")
    return dealt.select(bucket, "word", "n", "side", "size", "holds").groupBy("bucket").applyInArrow(_bucket, PAIRS)


def followed(forms: DataFrame) -> DataFrame:
    """(word, root) for (word, form): forms are followed to the last by doubling. Each form is more frequent than its word by a factor, so chains are short
    and end."""
    roots = staged(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        further = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        joined = roots.join(further, "root", "left")
        if not joined.filter("next is not null").limit(1).count():
            return roots
        new = staged(joined.select("word", F.coalesce("next", "root").alias("root")), "roots")
        unstage(roots)
        roots = new


def group_variants(documents: DataFrame, least: int = 5, ratio: int = 5, modulus: int = MODULUS, bucket_words: int = BUCKET_WORDS) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word: form is the most frequent word within one edit, if it is ratio times
    as frequent; root is where forms end."""
    words = staged(vocabulary(documents, least, modulus), "words")
    pairs = near(words, bucket_words)
    best = pairs.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("b"))
    enough = -F.col("b.less") >= ratio * F.col("n")
    told = words.join(best, "word", "left").select("word", F.when(enough, F.col("b.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(enough, -F.col("b.less")).alias("form_n"))
    told = staged(told, "forms")
    roots = followed(told.filter("form is not null").select("word", "form"))
    return told.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
