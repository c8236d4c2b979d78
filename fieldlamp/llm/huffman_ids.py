"""Token-id files in canonical, length-limited Huffman code.

Writing: a tokenizer whose definition drops white space and never looks across it encodes each distinct word of a batch
once; one that also lower-cases and splits letters from punctuation, letters and punctuation apart; any other whole texts
(``way_of`` reads the definition). Ids are counted over the whole corpus; package-merge gives code lengths of
``MAX_BITS`` at most, which the canonical code turns into codes; documents are dealt by ranges of doc_id (and ids, if
a doc_id is repeated) into shards, sorted, and packed into independent blocks of about ``block_tokens`` ids. A document is never cut, so a longer one is a
block of its own. A block row has its bits, the bit offset of every ``EVERY``-th id, and its documents with their
lengths; the code lengths are a small table beside the blocks.

Reading: each block is decoded by itself with one lookup table; all stretches between checkpoints advance
together, one id a step.

What reaches the driver is the table of counts (one row an id of the vocabulary). Defined results: a null text is
empty and has the end id alone; a null doc_id sorts first; rows that repeat a doc_id stay, ordered by their first HEAD bytes of ids, then a hash of all; other
columns are ignored; an empty table gives empty files and no rows.
"""

from __future__ import annotations

import functools
import json
import os
import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .common import bounded, save, small_batches, staged, tokenizer_path, unstage, words_of_batch

MAX_BITS, EVERY = 18, 256
KNOWN_MOST = 400_000  # words that a worker remembers before it starts anew; no word is left out by it
HEAD = 64
#: The parts of a tokenizer's definition that make words independent.
SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
NORMAL = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
PLAIN = r"^(?P<a>\p{L}+)(?P<b>[.,;:!?]*)$"
TOGETHER = 200  # words of letters that are encoded as one text


def way_of(path: str) -> str:
    """How texts may be encoded by this tokenizer: by "letters", or as whole "texts"."""
    with open(path, encoding="utf-8") as f:
        d = json.load(f)
    steps = lambda x, key: (x or {}).get(key, [x] if x else [])
    normal, split = steps(d.get("normalizer"), "normalizers"), steps(d.get("pre_tokenizer"), "pretokenizers")
    same = normal == NORMAL and len(split) == 2 and split[1]["type"] == "ByteLevel" and not split[1]["add_prefix_space"]
    same = same and split[0]["type"] == "Split" and split[0]["pattern"] == {"Regex": SPLIT} and split[0]["behavior"] == "Removed" and split[0]["invert"]
    own = any(x["lstrip"] or x["rstrip"] or any(c.isspace() for c in x["content"]) for x in d.get("added_tokens", []))
    return "letters" if same and not own else "texts"


class WordEncoder:
    """Ids of words (texts without ASCII white space) by the tokenizers library. Trailing punctuation of words of letters is encoded apart,
    as the tokenizer does, and such words are encoded many at once: each ends with the only one of its tokens that has the vocabulary's mark of a word's end."""

    def __init__(self, name: str, end_id: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        path = tokenizer_path(name)
        self.tokenizer, self.way, self.end_id = Tokenizer.from_file(path), way_of(path), end_id
        with open(path, encoding="utf-8") as f:
            mark = json.load(f)["model"].get("end_of_word_suffix")
        vocabulary = self.tokenizer.get_vocab()
        self.ends_word = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        self.ends_word[[i for token, i in vocabulary.items() if mark and token.endswith(mark)]] = True
        self.clear()

    def clear(self) -> None:
        """The known words; entry 0 is the end of a document, entry 1 is nothing."""
        self.known: dict[str, int] = {"": 1}
        self.flat, self.used = np.array([self.end_id], np.uint32), 1
        self.starts, self.sizes = np.array([0, 0]), np.array([1, 0])

    def encoded(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other, and how many each has."""
        flat, sizes = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        for i in range(0, len(texts), 4000):
            ids = [e.ids for e in self.tokenizer.encode_batch_fast(texts[i : i + 4000], add_special_tokens=False)]
            sizes.append(np.fromiter(map(len, ids), np.int64, len(ids)))
            flat.append(np.fromiter(chain.from_iterable(ids), np.uint32, int(sizes[-1].sum())))
        return np.concatenate(flat), np.concatenate(sizes)

    def add(self, words: list[str]) -> None:
        together, alone = [w for w in words if w.isalpha()], [w for w in words if not w.isalpha()]
        flat, _ = self.encoded([" ".join(together[i : i + TOGETHER]) for i in range(0, len(together), TOGETHER)])
        ends = np.flatnonzero(self.ends_word[flat])
        if len(ends) == len(together):  # every word has one end at least, so each has one
            n = np.diff(ends, prepend=-1)
        else:
            flat, n = self.encoded(together)
        more, n_more = self.encoded(alone)
        words, n, new = together + alone, np.concatenate([n, n_more]), np.concatenate([flat, more])
        self.known.update(zip(words, range(len(self.starts), len(self.starts) + len(words))))
        self.starts = np.concatenate([self.starts, self.used + np.cumsum(n) - n])
        self.sizes = np.concatenate([self.sizes, n])
        if self.used + len(new) > len(self.flat):
            self.flat = np.concatenate([self.flat[: self.used], np.zeros(self.used + 2 * len(new), np.uint32)])
        self.flat[self.used : self.used + len(new)] = new
        self.used += len(new)

    def entries(self, words: pa.Array) -> np.ndarray:
        """Entries of distinct words: (n, 2), of the letters and of the punctuation after them."""
        parts = pc.extract_regex(words, PLAIN)
        plain = pc.is_valid(parts)
        first = pc.if_else(plain, pc.ascii_lower(pc.struct_field(parts, "a")), words)
        second = pc.if_else(plain, pc.struct_field(parts, "b"), "")
        coded = [x.dictionary_encode() for x in (first, second)]
        distinct = [x.dictionary.to_pylist() for x in coded]
        if len(self.known) + sum(map(len, distinct)) > KNOWN_MOST:
            self.clear()
        known = self.known
        if new := list(dict.fromkeys(w for d in distinct for w in d if w not in known)):
            self.add(new)
        return np.stack([np.fromiter(map(known.__getitem__, d), np.int64, len(d))[x.indices.to_numpy()] for d, x in zip(distinct, coded)], 1)


@functools.cache
def encoder(name: str, end_id: int) -> WordEncoder:
    """One a worker process, so that tasks share what it knows."""
    return WordEncoder(name, end_id)


def gather(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of the runs (start, length), one after the other."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)


def _by_words(own: WordEncoder, texts: pa.Array, kind: str) -> tuple[np.ndarray, np.ndarray]:
    begin, words = words_of_batch(texts)
    of = own.entries(words.dictionary)
    ends = 2 * begin[1:] + np.arange(1, len(begin))  # each word's two entries, and each document's end
    order = np.zeros(int(ends[-1]) if len(ends) else 0, np.int32)
    order[np.delete(np.arange(len(order)), ends - 1)] = of[words.indices.to_numpy()].reshape(-1)
    n = own.sizes[order]
    return own.flat[gather(own.starts[order], n)].astype(kind), np.cumsum(n)[ends - 1]


def _by_texts(own: WordEncoder, texts: pa.Array, kind: str) -> tuple[np.ndarray, np.ndarray]:
    ids = [[*e.ids, own.end_id] for e in own.tokenizer.encode_batch_fast([x or "" for x in texts.to_pylist()], add_special_tokens=False)]
    return np.fromiter(chain.from_iterable(ids), kind, sum(map(len, ids))), np.cumsum([len(x) for x in ids])


def ids_of(own: WordEncoder, texts: pa.Array, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all texts, each with its end id, one after the other, and where each ends."""
    return (_by_words if own.way == "letters" else _by_texts)(own, texts, kind)


def _encode(tokenizer: str, end_id: int, kind: str):
    def run(batches):
        own = encoder(tokenizer, end_id)
        for piece in small_batches(batches, "text", 4 << 20):
            tokens, ends = ids_of(own, piece.column("text"), kind)
            cut = np.concatenate([[0], ends]) * tokens.itemsize
            data = tokens.tobytes()
            yield pa.RecordBatch.from_arrays(
                [piece.column("doc_id"), pa.array([data[a:b] for a, b in zip(cut, cut[1:])], pa.binary()), pa.array(np.diff(cut) // tokens.itemsize)], ["doc_id", "ids", "n_tokens"]
            )

    return run


def id_kind(tokenizer: str) -> str:
    """The narrowest integers that hold a tokenizer's ids."""
    from tokenizers import Tokenizer

    return "<u2" if max(Tokenizer.from_file(tokenizer_path(tokenizer)).get_vocab().values()) < 1 << 16 else "<u4"


def token_ids(documents: DataFrame, tokenizer: str, end_id: int, kind: str) -> DataFrame:
    """(doc_id, ids as little-endian integers, n_tokens)."""
    bounded(documents.sparkSession)
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_encode(tokenizer, end_id, kind), "doc_id long, ids binary, n_tokens long")


def _counts(kind: str):
    def run(batches):
        total = np.zeros(0, np.int64)
        for x in small_batches(batches, "ids", 16 << 20):
            c = np.bincount(np.frombuffer(b"".join(x.column("ids").to_pylist()), kind))
            if len(c) > len(total):
                c, total = total, c
            total[: len(c)] += c
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], ["id", "n"])

    return run


def code_lengths(counts: np.ndarray, limit: int = MAX_BITS) -> np.ndarray:
    """Optimal prefix code lengths of at most limit bits, by package-merge; 0 for ids that do not occur."""
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.uint8)
    n = len(used)
    if n < 2:
        out[used] = 1
        return out
    if n > 1 << limit:
        raise ValueError(f"{n} ids do not fit codes of {limit} bits")
    order = used[np.argsort(counts[used], kind="stable")]
    leaves = merged = counts[order].astype(np.int64)
    is_leaf = [np.ones(n, bool)]
    for _ in range(limit - 1):
        k = len(merged) // 2
        both = np.concatenate([leaves, merged[: 2 * k : 2] + merged[1 : 2 * k : 2]])
        by = np.argsort(both, kind="stable")
        merged = both[by]
        is_leaf.append(by < n)
    lengths, take = np.zeros(n, np.uint8), 2 * n - 2
    for flags in reversed(is_leaf):
        k = int(flags[:take].sum())
        lengths[:k] += 1
        take = 2 * (take - k)
    out[order] = lengths
    return out


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """Codes in order of length, then id."""
    codes, code, before = np.zeros(len(lengths), np.uint64), 0, 0
    used = np.flatnonzero(lengths)
    for i in used[np.lexsort((used, lengths[used]))]:
        code <<= int(lengths[i]) - before
        codes[i], before = code, int(lengths[i])
        code += 1
    return codes


def pack(ids: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The bits of ids, and the bit offset of every EVERY-th."""
    n = lengths[ids].astype(np.int64)
    ends = np.cumsum(n)
    at = ends - n
    out = np.zeros((int(ends[-1]) >> 6) + 2, np.uint64)
    word, code = at >> 6, codes[ids]
    left = 64 - (at & 63) - n  # below 0: the code reaches into the next word
    over = np.flatnonzero(left < 0)
    high = np.where(left < 0, code >> np.maximum(-left, 0).astype(np.uint64), code << np.maximum(left, 0).astype(np.uint64))
    first = np.flatnonzero(np.diff(word, prepend=-1))
    out[word[first]] = np.add.reduceat(high, first)
    out[word[over] + 1] |= code[over] << (64 + left[over]).astype(np.uint64)
    return out.astype(">u8").tobytes()[: (int(ends[-1]) + 7) // 8], at[::EVERY].astype("<u4")


def decode_table(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every value of MAX_BITS bits: the id whose code it begins with, and the code's length."""
    used = np.flatnonzero(lengths)
    order = used[np.lexsort((used, lengths[used]))]
    spans = 1 << (MAX_BITS - lengths[order].astype(np.int64))
    ids, size = np.repeat(order, spans), np.repeat(lengths[order], spans)
    pad = (1 << MAX_BITS) - len(ids)
    return np.pad(ids, (0, pad)).astype(np.uint32), np.pad(size, (0, pad), constant_values=1).astype(np.int64)


def unpack(bits: bytes, checkpoints: np.ndarray, n: int, table: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """n ids; the stretches between checkpoints are decoded side by side."""
    data = np.frombuffer(bits + b"\0" * 8, np.uint8).astype(np.uint32)
    at, ids, size = checkpoints.astype(np.int64), table[0], table[1]
    out = np.zeros((len(at), EVERY), np.uint32)
    last = n - (len(at) - 1) * EVERY  # ids of the last stretch
    for k in range(min(EVERY, n)):
        if k == last:
            at = at[:-1]
        b = at >> 3
        v = (data[b] << 24) | (data[b + 1] << 16) | (data[b + 2] << 8) | data[b + 3]
        v = ((v << (at & 7).astype(np.uint32)) >> np.uint32(32 - MAX_BITS)) & np.uint32((1 << MAX_BITS) - 1)
        out[: len(at), k] = ids[v]
        at = at + size[v]
    return out.reshape(-1)[:n]


BLOCKS = "shard int, block int, n_tokens long, bits binary, checkpoints binary, doc_ids array<long>, doc_tokens array<long>"


def _pack(lengths: np.ndarray, block_tokens: int, kind: str):
    def run(batches):
        codes, shard = canonical_codes(lengths), TaskContext.get().partitionId()
        held, block, total, width = [], 0, 0, np.dtype(kind).itemsize

        def row():
            ids = np.frombuffer(b"".join(x for _, x in held), kind)
            bits, checkpoints = pack(ids, codes, lengths)
            cells = [shard, block, len(ids), bits, checkpoints.tobytes(), [i for i, _ in held], [len(x) // width for _, x in held]]
            types = [pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64())]
            names = ["shard", "block", "n_tokens", "bits", "checkpoints", "doc_ids", "doc_tokens"]
            return pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(cells, types)], names)

        for batch in batches:
            for i, x in zip(batch.column("doc_id").to_pylist(), batch.column("ids")):
                held.append((i, x.as_py()))
                total += len(held[-1][1]) // width
                if total >= block_tokens:
                    yield row()
                    held, block, total = [], block + 1, 0
        if held:
            yield row()

    return run


def write_ids(documents: DataFrame, path: str, tokenizer: str, end_id: int = 1, shard_tokens: int = 1 << 23, block_tokens: int = 1 << 18) -> None:
    """Files under path: blocks (in ascending doc_id by shard, block and place) and codes (id, length). tokenizer: a file of
    the tokenizers library, or the name of a public one."""
    spark = documents.sparkSession
    kind = id_kind(tokenizer)
    ids = staged(token_ids(documents, tokenizer, end_id, kind), "token-ids")
    counts = ids.select("ids").mapInArrow(_counts(kind), "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    size = max((r.id for r in counts), default=-1) + 1
    table = np.zeros(size, np.int64)
    for r in counts:
        table[r.id] = r.n
    lengths = code_lengths(table)
    used = [(int(i), int(lengths[i])) for i in np.flatnonzero(lengths)]
    spark.createDataFrame(used, "id int, length int").coalesce(1).write.parquet(f"{path}/codes")
    shards = max(1, -(-int(table.sum()) // shard_tokens))
    keyed = ids.select("doc_id", "ids", F.substring("ids", 1, HEAD).alias("head"), F.xxhash64("ids").alias("hash"), F.monotonically_increasing_id().alias("row"))
    order = ["doc_id", "head", "hash", "row"]
    dealt = keyed.repartitionByRange(shards, *order).sortWithinPartitions(*order).select("doc_id", "ids")
    save(dealt.mapInArrow(_pack(lengths, block_tokens, kind), BLOCKS), f"{path}/blocks")
    unstage(ids)


def _read(lengths: np.ndarray, with_ids: bool):
    def run(batches):
        table = decode_table(lengths)
        for batch in batches:
            for shard, block, n, bits, checkpoints, doc_ids, sizes in zip(*(batch.column(c) for c in ("shard", "block", "n_tokens", "bits", "checkpoints", "doc_ids", "doc_tokens"))):
                ids = unpack(bits.as_py(), np.frombuffer(checkpoints.as_py(), "<u4"), n.as_py(), table).astype("<u4")
                sizes = np.array(sizes.as_py(), np.int64)
                ends = np.cumsum(sizes)
                parts = [ids[a:b].tobytes() for a, b in zip(ends - sizes, ends)]
                k = len(parts)
                columns = [pa.array([shard.as_py()] * k, pa.int32()), pa.array([block.as_py()] * k, pa.int32()), pa.array(doc_ids.as_py(), pa.int64()),
                           pa.array(ends - sizes), pa.array(sizes), pa.array(map(zlib.crc32, parts), pa.int64()), pa.array(parts if with_ids else [None] * k, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["shard", "block", "doc_id", "within", "n_tokens", "ids_crc32", "ids"])

    return run


def read_ids(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, ids) of every document of the files."""
    codes = spark.read.schema("id int, length int").parquet(f"{path}/codes").collect()
    lengths = np.zeros(max((r.id for r in codes), default=-1) + 1, np.uint8)
    for r in codes:
        lengths[r.id] = r.length
    blocks = spark.read.schema(BLOCKS).parquet(f"{path}/blocks")
    shards = blocks.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    many = F.floor(F.col("shard") / F.lit(1024)).alias("many")
    groups = shards.groupBy(many).agg(F.sum("n").alias("group_n"))  # so that a row a shard doesn't meet in one task
    groups = groups.select("many", (F.sum("group_n").over(Window.orderBy("many")) - F.col("group_n")).alias("group_start"))
    upto = F.sum("n").over(Window.partitionBy("many").orderBy("shard")) - F.col("n")
    shards = shards.select("shard", "n", many).withColumn("upto", upto).join(groups, "many").select("shard", (F.col("group_start") + F.col("upto")).alias("shard_start"))
    within = F.sum("n_tokens").over(Window.partitionBy("shard").orderBy("block")) - F.col("n_tokens")
    starts = blocks.select("shard", "block", "n_tokens").withColumn("block_start", within).drop("n_tokens").join(shards, "shard")
    docs = blocks.mapInArrow(_read(lengths, with_ids), "shard int, block int, doc_id long, within long, n_tokens long, ids_crc32 long, ids binary")
    start = F.col("shard_start") + F.col("block_start") + F.col("within")
    return docs.join(starts, ["shard", "block"]).select("doc_id", start.alias("start"), "n_tokens", "ids_crc32", *(["ids"] if with_ids else []))
