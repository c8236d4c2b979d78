"""What the operators of this package share: hashing, words and pieces of batches; tables and staging come from the session module."""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from ..session import bounded, new_path, remove_path, save, scratch, table, unstage, written as staged

__all__ = ["bounded", "new_path", "remove_path", "save", "scratch", "table", "unstage", "staged", "ASCII_WORD", "mix64", "compact", "tokenizer_path", "words_of_batch", "small_batches"]

#: Words of the contracts: runs of anything but ASCII white space.
ASCII_WORD = r"[^\x20\x09-\x0D]+"


def tokenizer_path(name: str) -> str:
    """A tokenizer's file: a path, or the name of one of the installed public ones. Each process asks for itself."""
    if os.path.exists(name):
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


M1, M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix64(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser on an array of uint64."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * M1
        x = (x ^ (x >> np.uint64(27))) * M2
        return x ^ (x >> np.uint64(31))


def compact(texts: pa.Array) -> pa.Array:
    """A copy of a slice that begins later than its buffers: some string kernels read such slices wrongly."""
    return texts.take(pa.array(np.arange(len(texts)))) if texts.offset else texts


def words_of_batch(texts: pa.Array) -> tuple[np.ndarray, pa.DictionaryArray]:
    """Words of every text of a batch: (start of each text's words, with the end appended; the words,
    dictionary-encoded). Null texts have none. The split is on ASCII white space alone."""
    split = pc.ascii_split_whitespace(pc.fill_null(compact(texts).cast(pa.large_string()), ""))
    flat, parent = split.values, np.repeat(np.arange(len(texts)), np.diff(split.offsets.to_numpy()))
    if split.offsets[0].as_py() or len(flat) != len(parent):
        flat = flat.slice(split.offsets[0].as_py(), len(parent))
    full = pc.greater(pc.binary_length(flat), 0)
    flat = flat.filter(full)
    counts = np.bincount(parent[full.to_numpy(zero_copy_only=False)], minlength=len(texts))
    return np.concatenate([[0], np.cumsum(counts)]), flat.dictionary_encode()


def small_batches(batches, column: str, most_bytes: int = 8 << 20):
    """Cut record batches so that the texts of a piece stay near most_bytes; a single longer text is a piece
    of its own."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        begin, total = 0, 0
        for i, n in enumerate(size):
            if total and total + n > most_bytes:
                yield batch.take(pa.array(np.arange(begin, i))) if begin else batch.slice(0, i)
                begin, total = i, 0
            total += int(n)
        yield batch.take(pa.array(np.arange(begin, batch.num_rows))) if begin else batch
        pa.default_memory_pool().release_unused()  # workers live on between tasks
