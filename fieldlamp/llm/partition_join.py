"""Exact Jaccard self-join of documents on word shingles, by universe partition.

Shingles are hashed; a document is the set of its hashes. Sizes are cut into bands so that linked sets lie in one
band or in neighbours. For a band, the universe of hashes is partitioned into ``n`` ranges (segments). Two linked sets
differ in at most H elements, so by the pigeonhole principle some segment of the two is equal, or differs in one
element if the segment is indexed with its one-deletion neighbourhood. Allocation is by cost, per band: ``d`` segments
take deletions (each stands for two), every set may leave out its ``slack`` smallest segments (the keys of
empty ones are the commonest), and n is what the principle then needs: n + d = H + 1 + 2 * slack. A set is indexed for its own band
and for the band below.

What is shuffled is packed: a task sorts the keys of about 8 MB of text, keeps one member a key (the others are
noted beside it), and sends slices of sorted 5-byte keys with 2-byte owners to the buckets of the key's high
bits. Texts with equal sets are one class from the start, and all that follows is between classes. The class of a key
that holds most shared keys is its hub, and (hub, member) pairs are verified on whole texts, so families of near copies
cost a pair a member. If x is not linked with its hub, it may still be linked with another member y. Their differences
from the hub then have to share elements: x and y differ in |dx| + |dy| - 2 |dx & dy| elements, which is too many if dx
and dy are disjoint, as dx alone is too many. So differences are joined on the rarest elements of dx and dy (as many as
the threshold asks for) and compared exactly; no link between different texts is lost, and no pair is formed that shares
nothing beyond its hub. Where a hub's members fit one part, its failed members are settled there: what x and y share is at most
what each shares with the hub and what they share outside it, which an index of that part counts; pairs that this leaves and
that are not connected yet are compared exactly. For hubs of several parts, and parts in which this would take more than
``WORK`` steps, differences are kept, and the members that share an element of them gather round a hub of their own: a family with
several templates costs a pair a member and template again. Rounds go on while failed members remain; after ``ROUNDS`` of them the members that still share
rare elements are compared pair by pair.

Skew: a key held by a third of all rows sends one entry a piece of text. Verification gathers a first member
with parts of its partners of about ``CHUNK`` shingles. Components come from labels that take the smallest neighbour
and jump, with each round written to the shared folder. Staged files are deleted after their last reader.

Defined results: null or empty texts have empty sets and link with nothing, whatever their doc_id; texts with fewer
words than a shingle are one shingle; the rows of a doc_id are one node, so if its texts differ it links with the
partners of each; rows without doc_id link through copies only and get their class's component, null if no row of it
has an id; ties cannot change the result; other columns are ignored; empty tables give an empty table.
"""

from __future__ import annotations

import functools
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from .common import bounded, compact, mix64, small_batches, staged, unstage, words_of_batch

CHUNK = 1_000_000
REST_BITS = 40
OWNERS = 1 << 16
WORK = 100_000_000
ROUNDS = 6
GOLD = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Band:
    lo: int
    hi: int
    n: int
    d: int
    slack: int


def common_keys(size: int, n: int, d: int, slack: int) -> float:
    """Keys of a set that say nothing of its elements, as expected: those of empty segments beyond the slack, and of segments
    that a deletion empties. Each brings the set to a hub that it has nothing to do with, so its text is read once more."""
    if n == 1:
        return float(size <= 1) * d
    none = (1 - 1 / n) ** size
    one = size / (n - 1) * none
    mean, excess = (n - d) * none, 0.0
    term = math.exp(-mean)
    for k in range(1, int(mean + 8 * math.sqrt(mean)) + 12):
        term *= mean / k
        excess += max(0, k - slack) * term
    return excess + d * (2 * none + one)


@functools.cache
def band(index: int, percent: int) -> Band:
    lo = 1 if index == 0 else band(index - 1, percent).hi + 1
    hi = lo * 100 // percent
    most = hi * (100 - percent) // percent  # elements in which two linked sets of this band can differ
    best, slack = None, 0
    while slack < most + 2:
        for d in range(0, min(4, most) + 1):
            n = most + 1 + 2 * slack - d
            if n < max(1, d):
                break
            keys = n - slack + d * lo / n
            if best and keys >= best[0]:
                continue
            cost = keys + 5 * lo * common_keys(lo, n, d, slack)
            if best is None or cost < best[0]:
                best = (cost, n, d, slack)
        slack += 1 + slack // 12
    return Band(lo, hi, *best[1:])


def band_of(size: int, percent: int) -> int:
    i = max(0, int(math.log(max(size, 1)) / math.log(100 / percent)) - 12)
    while band(i, percent).lo > size:
        i -= 1
    while band(i, percent).hi < size:
        i += 1
    return i


def segment_keys(hashes: np.ndarray, index: int, b: Band) -> np.ndarray:
    """The keys of a sorted set for a band."""
    with np.errstate(over="ignore"):
        segment = ((hashes >> np.uint64(32)) * np.uint64(b.n)) >> np.uint64(32)
        edges = np.searchsorted(segment, np.arange(b.n + 1, dtype=np.uint64))
        mixed = mix64(hashes + GOLD)
        upto = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed)])
        sums, sizes = upto[edges[1:]] - upto[edges[:-1]], np.diff(edges)
        tags = mix64(np.arange(b.n, dtype=np.uint64) + np.uint64((index + 1) << 32))
        keys = mix64(sums ^ tags)
        if b.slack and b.n > b.d:
            left_out = b.d + np.argsort(sizes[b.d :], kind="stable")[: b.slack]
            keys = np.delete(keys, left_out)
        if b.d:
            k = edges[b.d]
            of = segment[:k].astype(np.int64)
            keys = np.concatenate([keys, mix64((sums[of] - mixed[:k]) ^ tags[of])])
    return keys


def set_keys(hashes: np.ndarray, percent: int) -> np.ndarray:
    size = len(hashes)
    i = band_of(size, percent)
    keys = [segment_keys(hashes, i, band(i, percent))]
    if i and -(-size * percent // 100) <= band(i - 1, percent).hi:
        keys.append(segment_keys(hashes, i - 1, band(i - 1, percent)))
    return np.concatenate(keys)


def shingle_sets(texts: pa.Array, width: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of every text."""
    begin, words = words_of_batch(pc.ascii_lower(pc.fill_null(compact(texts).cast(pa.large_string()), "")))
    distinct = words.dictionary.to_pylist()
    h = np.fromiter((xxhash.xxh3_64_intdigest(w.encode("utf-8", "replace")) for w in distinct), np.uint64, len(distinct))[words.indices.to_numpy()]
    with np.errstate(over="ignore"):
        n = max(len(h) - width + 1, 0)
        s = np.full(n, width, np.uint64)
        for k in range(width):
            s = mix64(s * GOLD + h[k : n + k])
        out = []
        for a, z in zip(begin[:-1], begin[1:]):
            if z - a >= width:
                out.append(np.unique(s[a : z - width + 1]))
            elif z > a:
                x = np.uint64(z - a)
                for w in h[a:z]:
                    x = mix64(np.array([x * GOLD + w]))[0]
                out.append(np.array([x], np.uint64))
            else:
                out.append(np.zeros(0, np.uint64))
    return out


def fingerprint(s: np.ndarray) -> tuple[int, int]:
    with np.errstate(over="ignore"):
        return int(np.sum(mix64(s + GOLD)).astype(np.int64)), int(np.sum(mix64(s ^ GOLD)).astype(np.int64))


INDEX = "kind string, node long, doc_id long, h long, n long, f1 long, f2 long, bucket int, key long, keys binary, owners binary"
INDEX_ARROW = pa.schema([("kind", pa.string()), ("node", pa.int64()), ("doc_id", pa.int64()), ("h", pa.int64()), ("n", pa.int64()), ("f1", pa.int64()), ("f2", pa.int64()),
                         ("bucket", pa.int32()), ("key", pa.int64()), ("keys", pa.binary()), ("owners", pa.binary())])


def _table(kind: str, rows: int, **columns) -> pa.RecordBatch:
    arrays = [pa.array([kind] * rows) if f.name == "kind" else pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(rows, f.type) for f in INDEX_ARROW]
    return pa.RecordBatch.from_arrays(arrays, schema=INDEX_ARROW)


def _index(width: int, percent: int, bits: int):
    def run(batches):
        at = TaskContext.get().partitionId() << 20
        for whole in small_batches(batches, "text"):
            for from_ in range(0, whole.num_rows, OWNERS):
                piece = whole.slice(from_, OWNERS)
                at += 1
                sets = shingle_sets(piece.column("text"), width)
                prints = [fingerprint(s) for s in sets]
                first: dict[tuple, int] = {}
                for i, p in enumerate(prints):
                    if len(sets[i]):
                        first.setdefault(p, i)
                base = at << 16
                nodes = [base + i if first.get(p) == i else None for i, p in enumerate(prints)]
                yield _table("doc", piece.num_rows, node=nodes, doc_id=piece.column("doc_id"), h=piece.column("h"), n=[len(s) for s in sets], f1=[p[0] for p in prints], f2=[p[1] for p in prints])
                found = [(i, set_keys(sets[i], percent)) for i in first.values()]
                if not found:
                    continue
                keys = np.concatenate([k for _, k in found]) >> np.uint64(64 - REST_BITS - bits)
                owners = np.repeat(np.array([i for i, _ in found], np.uint16), [len(k) for _, k in found])
                order = np.lexsort((owners, keys))
                keys, owners = keys[order], owners[order]
                new = np.ones(len(keys), bool)
                new[1:] = (keys[1:] != keys[:-1]) | (owners[1:] != owners[:-1])
                keys, owners = keys[new], owners[new]
                starts = np.flatnonzero(np.diff(keys, prepend=keys[0] ^ np.uint64(1)))
                sizes = np.diff(np.append(starts, len(keys)))
                shared = np.flatnonzero(sizes > 1)
                if len(shared):
                    yield _table("local", len(shared), node=[base] * len(shared), key=keys[starts[shared]].astype(np.int64), owners=[owners[a : a + n].tobytes() for a, n in zip(starts[shared], sizes[shared])])
                keys, owners = keys[starts], owners[starts]
                planes = keys.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 3:]
                buckets = (keys >> np.uint64(REST_BITS)).astype(np.int64)
                begins = np.flatnonzero(np.diff(buckets, prepend=-1))
                full, spans = buckets[begins], list(zip(begins.tolist(), [*begins[1:].tolist(), len(keys)]))
                yield _table("bucket", len(full), node=[base] * len(full), bucket=full, keys=[planes[a:z].T.tobytes() for a, z in spans], owners=[owners[a:z].tobytes() for a, z in spans])

    return run


def _groups(bucket: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """Keys that more than one piece of text holds: (key, nodes)."""
    keys, nodes = [], []
    for base, k, o in zip(table.column("node").to_pylist(), table.column("keys").to_pylist(), table.column("owners").to_pylist()):
        planes = np.frombuffer(k, np.uint8).reshape(5, -1)
        x = np.zeros(planes.shape[1], np.int64)
        for p in planes:
            x = (x << 8) | p
        keys.append(x)
        nodes.append(base + np.frombuffer(o, np.uint16).astype(np.int64))
    keys, nodes = np.concatenate(keys), np.concatenate(nodes)
    order = np.lexsort((nodes, keys))
    keys, nodes = keys[order], nodes[order]
    starts = np.flatnonzero(np.diff(keys, prepend=-1))
    sizes = np.diff(np.append(starts, len(keys)))
    shared = sizes > 1
    keep = np.repeat(shared, sizes)
    full = keys[starts[shared]] + (bucket[0].as_py() << REST_BITS)
    offsets = np.concatenate([[0], np.cumsum(sizes[shared])]).astype(np.int32)
    return pa.table({"key": pa.array(full), "nodes": pa.ListArray.from_arrays(offsets, pa.array(nodes[keep]))})


def _local(batches):
    for batch in batches:
        nodes = [b + np.frombuffer(o, np.uint16).astype(np.int64) for b, o in zip(batch.column("node").to_pylist(), batch.column("owners").to_pylist())]
        if nodes:
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in nodes])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(nodes)))], ["key", "nodes"])


TRIED = "hub long, rep long, n long, linked boolean, delta array<long>"


def _settle(hub: np.ndarray, sets: list[np.ndarray], linked: list[bool], percent: int) -> tuple[bool, list[tuple[int, int]]]:
    """Whether the failed members of a hub are settled, and links among members that connect all that is connected."""
    failed = [i for i, x in enumerate(linked) if not x]
    n = len(sets)
    if n < 2 or not failed:
        return True, []
    if len(failed) * n > WORK:
        return False, []
    size = np.array([len(s) for s in sets])
    outside = [np.setdiff1d(s, hub, assume_unique=True) for s in sets]
    inside = size - np.array([len(s) for s in outside])
    elements, holders = np.concatenate(outside), np.repeat(np.arange(n), [len(s) for s in outside])
    order = np.argsort(elements, kind="stable")
    elements, holders = elements[order], holders[order]
    starts = np.flatnonzero(np.diff(elements, prepend=elements[:1] ^ np.uint64(1))) if len(elements) else np.zeros(0, np.int64)
    runs = np.diff(np.append(starts, len(elements)))
    distinct = elements[starts]
    parent = [n if x else i for i, x in enumerate(linked)] + [n]  # the last is the hub

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    work, links = 0, []
    for x in failed:
        at = np.searchsorted(distinct, outside[x])
        work += int(runs[at].sum()) + n
        if work > WORK:
            return False, []
        own = holders[np.repeat(starts[at] - (np.cumsum(runs[at]) - runs[at]), runs[at]) + np.arange(int(runs[at].sum()))]
        most = np.minimum(inside[x], inside) + np.bincount(own, minlength=n)
        able = (100 + percent) * most >= percent * (size[x] + size)
        able[x] = False
        able &= 100 * np.minimum(size[x], size) >= percent * np.maximum(size[x], size)
        for y in sorted(np.flatnonzero(able).tolist(), key=lambda y: -most[y]):
            if find(x) == find(y):
                continue
            work += int(size[x] + size[y])
            if work > WORK:
                return False, []
            both = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
            if 100 * both >= percent * (size[x] + size[y] - both):
                links.append((x, y))
                parent[find(x)] = find(y)
    return True, links


def _verify(width: int, percent: int):
    schema = pa.schema([("hub", pa.int64()), ("rep", pa.int64()), ("n", pa.int64()), ("linked", pa.bool_()), ("delta", pa.list_(pa.int64()))])

    def run(group: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        sets = shingle_sets(table.column("text").combine_chunks() if table.num_rows else pa.array([], pa.string()), width)
        hub = group[0].as_py()
        by_class = dict(zip(table.column("rep").to_pylist(), sets))
        own = by_class.pop(hub, np.zeros(0, np.uint64))
        reps, members = list(by_class), list(by_class.values())
        both = [len(np.intersect1d(own, s, assume_unique=True)) for s in members]
        linked = [100 * k >= percent * (len(own) + len(s) - k) for k, s in zip(both, members)]
        alone = table.num_rows > 0 and table.column("parts")[0].as_py() == 1
        settled, links = _settle(own, members, linked, percent) if alone else (False, [])
        rows = [(hub, r, len(s), x, None if settled else np.setxor1d(own, s, assume_unique=True).astype(np.int64)) for r, s, x in zip(reps, members, linked)]
        rows += [(reps[j], reps[i], len(members[i]), True, None) for i, j in links]
        return pa.table([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else ([], [], [], [], []), schema)], schema=schema)

    return run


def verified(texts: DataFrame, pairs: DataFrame, classes: DataFrame, width: int, percent: int) -> DataFrame:
    """Pairs (hub, rep) of classes with the size of rep's set, whether they are linked, and the elements that only one of
    them has (null where the hub's members are settled; links among its members come as pairs of their own). texts: (doc_id, h, text), one row a pair of these."""
    sized = pairs.join(classes.select("rep", "n"), "rep")
    parts = sized.groupBy("hub").agg(F.ceil(F.sum("n") / F.lit(CHUNK)).cast("int").alias("parts"))
    members = sized.join(parts, "hub").select("hub", "parts", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int").alias("part"), "rep")
    hubs = members.select("hub", "parts", "part", F.col("hub").alias("rep")).distinct()
    roles = members.unionByName(hubs).join(classes.select("rep", "doc_id", "h"), "rep")
    return roles.join(texts, ["doc_id", "h"]).groupBy("hub", "part").applyInArrow(_verify(width, percent), TRIED)


def components(links: DataFrame) -> DataFrame:
    """(id, component) of every id in links (a, b): the smallest id that it reaches."""
    both = links.select(F.col("a").alias("id"), F.col("b").alias("other")).unionByName(links.select(F.col("b").alias("id"), F.col("a").alias("other")))
    both = staged(both, "cc-edges")
    labels = staged(both.groupBy("id").agg(F.min("other").alias("m")).select("id", F.least("id", "m").alias("component")), "cc-labels")
    while True:
        seen = both.join(labels.select(F.col("id").alias("other"), F.col("component").alias("c")), "other").groupBy("id").agg(F.min("c").alias("c"))
        nearer = labels.join(seen, "id").select("id", F.least("component", "c").alias("component"), F.col("component").alias("before"))
        jump = nearer.select(F.col("id").alias("component"), F.col("component").alias("further"))
        new = staged(nearer.join(jump, "component", "left").select("id", F.least("component", F.coalesce("further", "component")).alias("component"), "before"), "cc-labels")
        unstage(labels)
        labels = new
        if not new.filter("component <> before").limit(1).count():
            unstage(both)
            return labels


def join(documents: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, class_id, component_id) of every row: class_id is the smallest doc_id with the same set."""
    bounded(documents.sparkSession)
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("h", F.xxhash64("text"))
    size = int(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    if size > 1 << 50:  # Spark doesn't know
        size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = min(63 - REST_BITS, max(6, math.ceil(math.log2(max(size, 1) / (4 << 20)))))
    index = staged(rows.mapInArrow(_index(width, percent, bits), INDEX), "partition-index")
    docs = staged(index.filter("kind = 'doc'").select("node", "doc_id", "h", "n", "f1", "f2"), "partition-docs")
    first = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "h")))
    sets = docs.filter("n > 0").groupBy("f1", "f2").agg(first.alias("first"), F.first("n").alias("n")).select("f1", "f2", "n", "first.doc_id", "first.h")
    classes = staged(sets.withColumn("rep", F.monotonically_increasing_id()), "classes")
    named = classes.filter("doc_id is not null")
    nodes = docs.filter("node is not null").join(named.select("f1", "f2", "rep"), ["f1", "f2"]).select("node", "rep")
    across = index.filter("kind = 'bucket'").select("bucket", "node", "keys", "owners").groupBy("bucket").applyInArrow(_groups, "key long, nodes array<long>")
    local = index.filter("kind = 'local'").select("key", "node", "owners").mapInArrow(_local, "key long, nodes array<long>")
    held = staged(across.unionByName(local).select("key", F.explode("nodes").alias("node")).join(nodes, "node").select("key", "rep").distinct(), "held-keys")
    unstage(index)
    ranks = held.join(held.groupBy("rep").agg(F.count(F.lit(1)).alias("keys")), "rep")
    hubs = ranks.groupBy("key").agg(F.max(F.struct("keys", "rep"))["rep"].alias("hub"), F.count(F.lit(1)).alias("members")).filter("members > 1")
    stars = staged(held.join(hubs.select("key", "hub"), "key").filter("hub <> rep").select("hub", "rep").distinct(), "hub-members")
    unstage(held)
    texts = rows.filter("doc_id is not null")
    if docs.groupBy("doc_id", "h").count().filter("count > 1 and doc_id is not null").limit(1).count():
        texts = texts.dropDuplicates(["doc_id", "h"])
    tried = staged(verified(texts, stars, named, width, percent).withColumn("m", F.monotonically_increasing_id()), "verified")
    unstage(stars)
    owners = docs.filter("n > 0").join(classes.select("f1", "f2", "rep"), ["f1", "f2"]).select("doc_id", "rep")
    several = owners.filter("doc_id is not null").groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("z")).filter("a < z")
    one_id = owners.join(several, "doc_id").filter("rep <> a").select("a", F.col("rep").alias("b")).distinct()
    links = tried.filter("linked").select(F.col("hub").alias("a"), F.col("rep").alias("b")).unionByName(one_id)
    labels = components(links)
    for _ in range(ROUNDS):
        if not _open(tried):
            break
        nearer = staged(sub_stars(tried, labels, percent), "hub-members")
        before = tried
        tried = staged(verified(texts, nearer, named, width, percent).withColumn("m", F.monotonically_increasing_id()), "verified")
        unstage(before, nearer)
        labels = merged(labels, tried.filter("linked").select(F.col("hub").alias("a"), F.col("rep").alias("b")))
    if _open(tried):
        labels = merged(labels, further_links(tried, labels, percent))
    unstage(tried)
    of = classes.join(labels.select(F.col("id").alias("rep"), "component"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    least = of.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    classes = of.join(least, "component").select("f1", "f2", F.col("doc_id").alias("class_id"), "component_id")
    found = docs.join(classes, ["f1", "f2"], "left")
    full = F.col("n") > 0
    return found.select("doc_id", F.col("n").alias("n_shingles"), F.when(full, F.col("class_id")).otherwise(F.col("doc_id")).alias("class_id"), F.when(full, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def _open(tried: DataFrame) -> bool:
    """Whether failed members are left that may be linked with others of their hub."""
    return bool(tried.filter("not linked and delta is not null").limit(1).count())


def merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """labels, with the components that links (a, b) connect made one."""
    of = lambda end: labels.select(F.col("id").alias(end), F.col("component").alias(f"{end}_c"))
    ends = links.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("a_c", "a").alias("a"), F.coalesce("b_c", "b").alias("b"))
    ends = staged(ends.filter("a <> b").distinct(), "component-links")
    if not ends.limit(1).count():
        unstage(ends)
        return labels
    more = components(ends).select(F.col("id").alias("component"), F.col("component").alias("least"))
    known = labels.join(more, "component", "left").select("id", F.coalesce("least", "component").alias("component"))
    alone = more.join(labels.select("component").distinct(), "component", "left_anti").select(F.col("component").alias("id"), F.col("least").alias("component"))
    new = staged(known.unionByName(alone), "cc-labels")
    unstage(ends, labels)
    return new


def prefixes(tried: DataFrame, labels: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """The members of hubs with failed members, and, written, the rarest elements of their differences: as many as two linked members, one of
    them failed, need to share one."""
    known = tried.filter("delta is not null")
    full = known.groupBy("hub").agg(F.count(F.lit(1)).alias("members"), F.max((~F.col("linked")).cast("int")).alias("failed")).filter("members > 1 and failed = 1")
    members = known.join(full.select("hub"), "hub", "left_semi")
    # an element of a hub is a hash of both; if two share one, the exact comparison still decides
    elements = members.select("m", F.explode("delta").alias("e"), "hub").select("m", F.xxhash64("hub", "e").alias("e"))
    holders = elements.groupBy("e").agg(F.count(F.lit(1)).alias("holders")).filter("holders > 1")
    shared = staged(elements.join(holders, "e"), "shared-elements")
    of = labels.select(F.col("id").alias("rep"), "component")
    sized = members.join(of, "rep", "left").select("m", "hub", "rep", "n", "linked", F.size("delta").alias("d"), F.coalesce("component", "rep").alias("c"))
    named = shared.join(sized, "m")
    # elements that no other member has are the rarest, so a member's prefix begins with them
    order = Window.partitionBy("m").orderBy("holders", "e")
    ranked = named.withColumn("place", F.row_number().over(order) + F.col("d") - F.count(F.lit(1)).over(Window.partitionBy("m")))
    # the least that a member shares with any linked one bounds its prefix
    need = F.greatest(F.lit(1), F.col("d") - F.floor(F.col("n") * (100 - percent) / percent))
    ranked = staged(ranked.filter(F.col("place") <= F.col("d") - need + 1), "prefixes")
    unstage(shared)
    return members, ranked


def sub_stars(tried: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """(hub, rep) pairs to try next: of the members that share an element of their differences, and are of several components, the one with most such
    elements is a hub for the others."""
    _, ranked = prefixes(tried, labels, percent)
    weight = Window.partitionBy("rep")
    held = ranked.withColumn("elements", F.count(F.lit(1)).over(weight))
    groups = held.groupBy("e").agg(F.min("c").alias("a"), F.max("c").alias("z"), F.max((~F.col("linked")).cast("int")).alias("failed"), F.max(F.struct("elements", "rep"))["rep"].alias("sub"))
    groups = groups.filter("a < z and failed = 1").select("e", "sub")
    return ranked.join(groups, "e").filter("rep <> sub").select(F.col("sub").alias("hub"), "rep").distinct()


def further_links(tried: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between members of one hub, of which one at least is not linked with the hub, by their differences from it."""
    side = lambda rows, name: rows.select("e", *[F.col(x).alias(f"{name}_{x}") for x in ("hub", "rep", "n", "d", "c", "place")])
    members, ranked = prefixes(tried, labels, percent)
    probes, held = side(ranked.filter("not linked"), "x"), side(ranked, "y")
    # sets of too different sizes, or too differently far from the hub, differ too much; of others, the prefixes by rarity meet
    differ = F.floor((100 - percent) * (F.col("x_n") + F.col("y_n")) / (100 + percent))
    least = F.greatest(F.lit(1), F.ceil((F.col("x_d") + F.col("y_d") - differ) / 2))
    near = (F.col("x_c") != F.col("y_c")) & (100 * F.least("x_n", "y_n") >= percent * F.greatest("x_n", "y_n")) & (least <= F.least("x_d", "y_d"))
    near &= (F.col("x_place") <= F.col("x_d") - least + 1) & (F.col("y_place") <= F.col("y_d") - least + 1)
    near &= 1 + F.least(F.col("x_d") - F.col("x_place"), F.col("y_d") - F.col("y_place")) >= least
    met = probes.join(held, (probes["e"] == held["e"]) & (F.col("x_hub") == F.col("y_hub")) & near)
    apart = met.select(F.col("x_hub").alias("hub"), F.least("x_rep", "y_rep").alias("x"), F.greatest("x_rep", "y_rep").alias("y")).distinct()
    one = lambda side: members.select("hub", F.col("rep").alias(side), F.col("n").alias(f"{side}_n"), F.col("delta").alias(f"{side}_delta"))
    both = apart.join(one("x"), ["hub", "x"]).join(one("y"), ["hub", "y"])
    differ = F.size("x_delta") + F.size("y_delta") - 2 * F.size(F.array_intersect("x_delta", "y_delta"))
    shared_n = (F.col("x_n") + F.col("y_n") - differ) / 2
    found = staged(both.filter(100 * shared_n >= percent * (shared_n + differ)).select(F.col("x").alias("a"), F.col("y").alias("b")).distinct(), "further-links")
    unstage(ranked)
    return found


def keep_one(documents: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """documents without near copies: of every component its smallest doc_id stays. Of rows that repeat doc_id and text
    that with the smallest hash of all its columns stays; a doc_id with several texts stays with all of them if any of them stays; rows without doc_id stay."""
    joined = join(documents, width, percent)
    by_id = joined.filter("doc_id is not null").groupBy("doc_id").agg(F.max((F.col("component_id") == F.col("doc_id")).cast("int")).alias("stays"), F.count(F.lit(1)).alias("rows"))
    by_id = staged(by_id, "near-copies")
    gone = by_id.filter("stays = 0").select(F.col("doc_id").alias("gone_id"))
    left = documents.join(gone, documents["doc_id"] == gone["gone_id"], "left_anti")
    again = by_id.filter("stays = 1 and rows > 1").select(F.col("doc_id").alias("again_id"))
    if not again.limit(1).count():
        return left
    same = left["doc_id"] == again["again_id"]
    repeated = left.join(again, same, "left_semi")
    whole = F.struct(*[F.col(f"`{c}`") for c in documents.columns])
    one = repeated.groupBy(F.col("doc_id").alias("id_"), F.sha2(F.col("text").cast("string"), 256).alias("text_")).agg(F.min_by(whole, F.xxhash64(F.to_json(whole))).alias("row_"))
    return left.join(again, same, "left_anti").unionByName(one.select("row_.*"))
