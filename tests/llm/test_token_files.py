import heapq
import random
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from stratalith.llm import token_files
from stratalith.llm.queries import op4_token_files
from stratalith.llm.tokens import Encoder

ODD = ["", " ", "a   b", "x  ", "q \n\n", "w\n\nz", "a\x00b c", "don't DON'T we'll 're", "İstanbul Σίσυφος ΣΑΣ", "tab\tnew\n\nline \n x", "a\x1cb \x85 c d　e", "été ẍ", "<|endoftext|> x<|endoftext|>", "日本語 テキスト", "12 345 6７", "🙂🙂 ok", "a" * 500, "ǅ ŉ ß ẞ", "\n", " \n a", "é" * 70, "ªº² ½"]


def test_encoder_equals_library(documents):
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        code = Encoder(public_tokenizers.path(name))
        texts = ODD + [d["text"] or "" for d in documents]
        ids, at = code.ids(texts)
        for k, e in enumerate(code.library.encode_batch(texts, add_special_tokens=False)):
            assert ids[at[k] : at[k + 1]].tolist() == e.ids


def huffman_cost(counts):
    heap = list(counts)
    heapq.heapify(heap)
    total = 0
    while len(heap) > 1:
        x = heapq.heappop(heap) + heapq.heappop(heap)
        total += x
        heapq.heappush(heap, x)
    return total


def test_code_is_optimal_limited_and_round_trips():
    rng = np.random.default_rng(5)
    for n in (1, 2, 3, 50, 3000):
        counts = (rng.pareto(0.7, n) * 10 + 1).astype(np.int64)
        counts[rng.random(n) < 0.2] = 0
        counts[0] = 7
        for limit in (12, 20):
            lengths = token_files.code_lengths(counts, limit)
            used = lengths > 0
            assert (used == (counts > 0)).all() and lengths.max() <= limit
            assert (2.0 ** -lengths[used]).sum() <= 1
            if limit == 20 and used.sum() > 1 and lengths.max() < 20:
                assert (lengths * counts).sum() == huffman_cost(counts[used].tolist())
            code = token_files.Code(lengths)
            ids = rng.choice(np.flatnonzero(used), 5000)
            assert (code.decode(*code.encode(ids), len(ids)) == ids).all()
    assert len(code.decode(*code.encode(np.zeros(0, np.int64)), 0)) == 0


def brute(rows, tokenizer):
    start, out = 0, []
    for i, text in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_query_equals_brute_force(spark, sf, documents):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = sorted((d["doc_id"], d["text"]) for d in documents)
    assert sorted(map(tuple, op4_token_files(spark, sf).collect())) == brute(rows, tokenizer)


def test_odd_rows(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    texts = [*ODD, None, "word " * 40_000, "y" * 100_000]
    rows = list(enumerate(texts))
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, ids int")
    library = Tokenizer.from_file(path)
    library.encode_special_tokens = True
    assert sorted(map(tuple, token_files.token_files(df, path).collect())) == brute(sorted(rows, key=lambda r: r[0]), library)
    repeated = token_files.token_files(df.unionByName(df).unionByName(spark.createDataFrame([(None, "x", 1)], df.schema)), path).collect()
    assert len(repeated) == 2 * len(rows) + 1
    at = 0
    for r in sorted(repeated, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    assert token_files.token_files(df.limit(0), path).count() == 0
