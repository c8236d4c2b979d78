"""Packing of documents into sequences of at most ``most`` tokens, by the sum of squares.

Writing ids: every document is encoded with a tokenizer of the tokenizers library and gets an end id; a document of more than ``most``
ids is cut into pieces of ``most``, and the last piece may be shorter. Full pieces are sequences of their own. The others are
placed in order of falling length: N(g) is the number of open sequences with g tokens free, and a piece goes to the gap
where the sum of N(g)^2 becomes smallest, so gaps stay varied and later pieces find one that they fill. A sequence is opened
only if no open one has room: with all lengths known beforehand and the long ones placed first, this needs fewer sequences
than opening whenever the sum falls (on the test tables as many as the tokens need at least).

Only lengths are packed: pieces are dealt by hash to shards of about ``shard_pieces``, each shard is packed by one task,
and sequences that keep more than a sixteenth of their room are taken apart; their pieces are the next round's, in fewer shards, until one
shard holds them. So the count approaches that of a single packing, while a task never holds more than one shard.

Defined results: a null text is empty and has the end id alone; a null doc_id stays null; repeated rows are documents of their
own; pieces of equal length are interchangeable and are ordered by a row number that the written pieces have; other columns are
ignored, whatever their names; an empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import bounded, small_batches, staged
from .huffman_ids import encoder, ids_of

SHARD_PIECES = 100_000
PIECES_A_BATCH = 2048
PIECES = "doc_id long, piece int, start long, length long, ids binary"


def _pieces(tokenizer: str, end_id: int, most: int):
    def run(batches):
        own = encoder(tokenizer, end_id)
        for part in small_batches(batches, "text", 4 << 20):
            tokens, ends = ids_of(own, part.column("text"), "<u4")
            sizes = np.diff(ends, prepend=0)
            n = -(-sizes // most)
            of = np.repeat(np.arange(len(n)), n)
            piece = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
            start = piece * most
            length = np.minimum(sizes[of] - start, most)
            for a in range(0, len(of), PIECES_A_BATCH):
                z = min(a + PIECES_A_BATCH, len(of))
                cut = np.concatenate([[0], np.cumsum(length[a:z])]) * 4
                first = int(length[:a].sum())
                data = pa.py_buffer(tokens[first : first + int(cut[-1]) // 4].tobytes())
                ids = pa.Array.from_buffers(pa.binary(), z - a, [None, pa.py_buffer(cut.astype(np.int32).tobytes()), data])
                columns = [part.column("doc_id").take(pa.array(of[a:z])), pa.array(piece[a:z], pa.int32()), pa.array(start[a:z]), pa.array(length[a:z]), ids]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids"])

    return run


def place(lengths: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sequence, offset) of every length, in the order given, and the room that each sequence keeps."""
    count = np.zeros(most + 1, np.int64)  # open sequences by gap
    open_at: list[list[int]] = [[] for _ in range(most + 1)]
    sequence, offset, room = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), []
    for i, n in enumerate(lengths.tolist()):
        gaps = np.flatnonzero(count[n:]) + n
        if len(gaps):
            left = count[gaps - n]
            change = 2 * (left - count[gaps]) + 2  # of the sum of squares
            if gaps[0] == n:
                change[0] = 1 - 2 * count[n]  # what is filled counts no longer
            gap = int(gaps[change.argmin()])
            at = open_at[gap].pop()
            count[gap] -= 1
        else:
            gap, at = most, len(room)
            room.append(most)
        sequence[i], offset[i] = at, most - gap
        room[at] = gap - n
        if gap > n:
            count[gap - n] += 1
            open_at[gap - n].append(at)
    return sequence, offset, np.array(room, np.int64)


PLACED = "row long, length long, sequence_id long, offset long"


def _shard(most: int, round_: int, last: bool):
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        row, length = table.column("row").to_numpy(), table.column("length").to_numpy()
        order = np.lexsort((row, -length))
        row, length = row[order], length[order]
        sequence, offset, room = place(length, most)
        done = np.ones(len(row), bool) if last else room[sequence] * 16 <= most
        ids = (((round_ << 24) + key[0].as_py()) << 32) + sequence
        return pa.table({"row": row, "length": length, "sequence_id": pa.array(ids, mask=~done), "offset": pa.array(offset, mask=~done)})

    return run


def planned(lengths: DataFrame, most: int, shard_pieces: int = SHARD_PIECES) -> list[DataFrame]:
    """Parts, written, of (row, length, sequence_id, offset) for every (row, length)."""
    parts, left, n, round_ = [], lengths, lengths.count(), 1
    while n:
        shards = -(-n // shard_pieces)
        last = shards == 1
        dealt = left.select(F.pmod(F.xxhash64("row"), F.lit(shards)).alias("shard"), "row", "length")
        parts.append(staged(dealt.groupBy("shard").applyInArrow(_shard(most, round_, last), PLACED), "placed"))
        left = parts[-1].filter("sequence_id is null").select("row", "length")
        n, before = left.count(), n
        if not last and 2 * n > before:  # as happens if few pieces fill a sequence: what is left is packed for good, shard by shard
            shards = -(-n // shard_pieces)
            dealt = left.select(F.pmod(F.xxhash64("row"), F.lit(shards)).alias("shard"), "row", "length")
            parts.append(staged(dealt.groupBy("shard").applyInArrow(_shard(most, round_ + 1, True), PLACED), "placed"))
            break
        round_ += 1
    return parts


def pack(documents: DataFrame, tokenizer: str, end_id: int = 0, most: int = 2048, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset, ids) of every piece; ids are little-endian unsigned 32-bit
    integers."""
    bounded(documents.sparkSession)
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    pieces = staged(rows.mapInArrow(_pieces(tokenizer, end_id, most), PIECES).withColumn("row", F.monotonically_increasing_id()), "pieces")
    full = pieces.filter(F.col("length") == most).select("row", F.col("row").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    parts = planned(pieces.filter(F.col("length") < most).select("row", "length"), most, shard_pieces)
    for part in parts:
        # rows number from 0, so full pieces are told from packed sequences by the sign
        full = full.unionByName(part.filter("sequence_id is not null").select("row", (-F.col("sequence_id")).alias("sequence_id"), "offset"))
    known = pieces.withColumn("ids_crc32", F.crc32("ids"))
    return known.join(full, "row").select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "ids")


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids, documents) of packed pieces: the ids of a sequence one after the other, and (doc_id, piece, offset, length) of
    its pieces. A sequence is bounded by its length."""
    piece = F.struct("offset", "length", "doc_id", "piece", "ids")
    held = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(piece)).alias("p"))
    ids = F.aggregate(F.col("p"), F.lit(b""), lambda whole, x: F.concat(whole, x["ids"]))
    named = F.transform("p", lambda x: F.struct(x["doc_id"].alias("doc_id"), x["piece"].alias("piece"), x["offset"].alias("offset"), x["length"].alias("length")))
    return held.select("sequence_id", ids.alias("ids"), named.alias("documents"))
