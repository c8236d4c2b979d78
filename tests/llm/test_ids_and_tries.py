import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from fieldlamp.llm import huffman_ids as H, trie_unigram as U
from fieldlamp.llm.common import new_path, tokenizer_path

TEXTS = ["Hello, world's end!! don't STOP.", None, "", " \t\n", "İstanbul ΟΔΟΣ naïve café́ ﬁ x y a\x1cb", "<|endoftext|> a<|startoftext|>b <|ENDoftext|>", "trash### 12ab34 …“quoted”… a.b,c",
         "日本語 テキスト 😀😀 مرحبا", "word " * 3000, "é ́e", "don't.! it's, x's y'LL", "z" * 5000]


def test_files_equal_the_tokenizer(spark):
    from tokenizers import Tokenizer

    path = tokenizer_path("word_bpe_49k.json")
    rows = [(i * 3 - 4, t, i) for i, t in enumerate(TEXTS)] + [(None, "no id", 0), (2, TEXTS[2], 0), (2, "again", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids int").repartition(4)
    out = new_path(spark, "ids-test")
    H.write_ids(df, out, path, shard_tokens=700, block_tokens=100)
    got = sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in H.read_ids(spark, out).collect())
    t = Tokenizer.from_file(path)
    want = []
    for i, text, _ in rows:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 1]
        want.append((-(1 << 62) if i is None else i, np.array(ids, "<u4").tobytes()))
    start = 0
    for (i, data), g in zip(sorted(want), got, strict=True):
        assert g == (start, None if i == -(1 << 62) else i, len(data) // 4, zlib.crc32(data))
        start += len(data) // 4
    H.write_ids(df.limit(0), out + "-0", path)
    assert H.read_ids(spark, out + "-0").count() == 0


def test_a_tokenizer_that_looks_across_white_space_gets_whole_texts(spark):
    from tokenizers import Tokenizer

    name = "byte_bpe_50k.json"
    assert H.way_of(tokenizer_path(name)) == "texts" and H.way_of(tokenizer_path("word_bpe_49k.json")) == "letters"
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").repartition(3)
    out = new_path(spark, "ids-texts")
    H.write_ids(df, out, name, end_id=50256)
    t = Tokenizer.from_file(tokenizer_path(name))
    want = {i: np.array([*t.encode(x or "", add_special_tokens=False).ids, 50256], "<u4").tobytes() for i, x in enumerate(TEXTS)}
    assert {r.doc_id: bytes(r.ids) for r in H.read_ids(spark, out, with_ids=True).collect()} == want


def test_a_definition_that_differs_gets_whole_texts(tmp_path):
    """Only the normaliser that is known to leave words apart lets them be encoded apart."""
    import json

    with open(tokenizer_path("word_bpe_49k.json"), encoding="utf-8") as f:
        d = json.load(f)
    for pattern, content in (({"String": "a b"}, "ab"), ({"Regex": "\\s+"}, "")):
        d["normalizer"]["normalizers"][1] = {"type": "Replace", "pattern": pattern, "content": content}
        (tmp_path / "t.json").write_text(json.dumps(d))
        assert H.way_of(str(tmp_path / "t.json")) == "texts"


def test_words_of_letters_are_encoded_together_as_alone():
    own = H.WordEncoder("word_bpe_49k.json", 1)
    import pyarrow as pa

    texts = pa.array([*TEXTS, "Σας ΑΣ. İstanbul, é́a .;x ﬁx, 한국어! ᄒ", "x;y; Ⅷ ªº ʰa ǅx A.B,", " ".join(f"{chr(97 + i % 26)}é{i}" for i in range(900))])
    for got, want in zip(H._by_words(own, texts, "<u4"), H._by_texts(own, texts, "<u4")):
        assert got.tolist() == want.tolist()


def test_rows_of_one_doc_id_are_dealt_to_many_shards(spark):
    df = spark.createDataFrame([(None if i % 2 else 7, f"text number {i % 40} " * 5) for i in range(400)], "doc_id long, text string").repartition(4)
    out = new_path(spark, "ids-repeated")
    H.write_ids(df, out, "word_bpe_49k.json", shard_tokens=500, block_tokens=100)
    got = H.read_ids(spark, out).orderBy("start").collect()
    assert len(got) == 400 and spark.read.parquet(out + "/blocks").groupBy("shard").count().count() > 8
    assert all(a.start + a.n_tokens == b.start for a, b in zip(got, got[1:])) and [r.doc_id for r in got] == [None] * 200 + [7] * 200


@pytest.mark.parametrize("n", [1, 2, 3, 50, 3000])
def test_huffman_round_trip(n):
    rng = np.random.default_rng(n)
    counts = (1.6 ** np.minimum(np.arange(n), 60)).astype(np.int64) if n < 3000 else rng.zipf(1.3, n)
    lengths = H.code_lengths(counts)
    assert lengths.max() <= H.MAX_BITS and sum(2.0 ** -int(x) for x in lengths if x) <= 1
    ids = rng.integers(0, n, 5001).astype(np.uint32)
    for k in (1, 255, 256, 257, 5001):
        bits, checkpoints = H.pack(ids[:k], H.canonical_codes(lengths), lengths)
        assert (H.unpack(bits, checkpoints, k, H.decode_table(lengths)) == ids[:k]).all()


def test_code_lengths_are_optimal_without_a_limit():
    import heapq

    counts = [5, 9, 12, 13, 16, 45, 1, 1]
    heap, total = list(counts), 0
    heapq.heapify(heap)
    while len(heap) > 1:
        x = heapq.heappop(heap) + heapq.heappop(heap)
        total += x
        heapq.heappush(heap, x)
    assert int((np.array(counts) * H.code_lengths(np.array(counts)).astype(int)).sum()) == total


def every_split(word, pieces, byte_score):
    """Best (score, -tokens) over all segmentations, by brute force."""
    if not word:
        return (0.0, 0)
    best = None
    for k in range(1, len(word) + 1):
        s, t = pieces.get(word[:k], None), 1
        if s is None and k == 1:
            t = len(word[0].encode())
            s = t * byte_score
        if s is not None:
            rest = every_split(word[k:], pieces, byte_score)
            best = max(best or (-1e18, 0), (s + rest[0], rest[1] - t))
    return best


def test_trie_counts_against_all_segmentations():
    random.seed(3)
    pieces = {x: -random.randint(1, 9) / 2 for x in ["a", "b", "ab", "aba", "bb", "abab", "▁", "▁a", "é", "bé", "baba"]}
    u = U.Unigram(pieces)
    words = list({"▁" + "".join(random.choice("abéx😀") for _ in range(random.randint(0, 9))) for _ in range(300)})
    want = [-every_split(w, pieces, u.byte_score)[1] for w in words]
    assert u.counts(words).tolist() == want and [u.count(w) for w in words] == want


def test_trie_counts_of_documents(spark):
    path = tokenizer_path("piece_bpe_32k.model")
    u = U.Unigram.from_sentencepiece(path)
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)] + [(0, TEXTS[0], "x"), (None, "a b", "x")], "doc_id long, text string, n_tokens string")
    got = U.count_tokens(df, path).collect()
    assert len(got) == len(TEXTS) + 2
    for r in got:
        words = [w.decode() for w in (("a b" if r.doc_id is None else TEXTS[r.doc_id]) or "").encode().split()]
        assert (r.n_words, r.n_tokens) == (len(words), sum(u.count("▁" + w) for w in words))
    assert U.count_tokens(df.limit(0), path).count() == 0


def test_trie_equals_library_viterbi():
    """Scores of the library's own unigram model, over words that the pieces cover."""
    from tokenizers import models

    u = U.Unigram.from_sentencepiece(tokenizer_path("piece_bpe_32k.model"))
    model = models.Unigram([("<unk>", -100.0), *u.pieces.items()], 0, False)
    words = ["▁worthless", "▁internationalisation", "▁Éauouon", "▁the", "▁enunggebeit", "▁handlebars", "▁xylophone.", "▁2024-01-01"]
    for w, n in zip(words, u.counts(words)):
        own = [t.value for t in model.tokenize(w)]
        assert abs(sum(u.pieces[x] for x in own)) > 0 and n <= len(own)


def test_words_of_an_earlier_batch_are_still_known():
    """Two batches of 90,000 words each were more than an encoder kept, so it encoded the first one's words again."""
    own, encoded = H.WordEncoder("word_bpe_49k.json", 1), []
    add = own.add
    own.add = lambda words: (encoded.append(len(words)), add(words))
    letters = "abcdefghijklmnopqrstuvwxyz"
    word = lambda k: "".join(letters[k // 26**i % 26] for i in range(4))
    first, second = (pa.array([word(k) for k in ks]) for ks in (range(90_000), range(90_000, 180_000)))
    before = own.entries(first)
    own.entries(second)
    assert (own.entries(first) == before).all() and sum(encoded) == 180_000
