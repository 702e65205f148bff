import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from stratalith.llm import packing
from stratalith.llm.queries import op4_token_files
from stratalith.llm.tokens import Encoder

#: Added tokens' contents in all places, parts of them, and letters whose lower case takes more bytes.
MARKED = [
    "end <|endoftext|> next", "<|endoftext|>", "<|startoftext|>a b<|endoftext|>", "x<|endoftext|><|endoftext|>y", "a  <|endoftext|>  b \n", "<|ENDOFTEXT|> <|endoftext| > <|endoftext",
    "don't<|startoftext|>'t 12<|endoftext|>34 é日<|endoftext|>", "<<|endoftext|>>", "ȺȾ aȺb Ⱦ", "\n\n<|startoftext|>\n\n", "plain",
]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_ids_are_those_of_the_plain_call(name, documents):
    code, plain = Encoder(public_tokenizers.path(name)), Tokenizer.from_file(public_tokenizers.path(name))
    rng = random.Random(3)
    parts = ["<|endoftext|>", "<|startoftext|>", " ", "\n", "  ", "word", "'t", "12", "Ⱥ", "<|", "|>", "é"]
    texts = MARKED + ["".join(rng.choices(parts, k=8)) for _ in range(500)] + [d["text"] or "" for d in documents[:50]]
    for _ in range(2):  # the second time from the cache
        ids, at = code.ids(texts)
        for k, t in enumerate(texts):
            assert ids[at[k] : at[k + 1]].tolist() == plain.encode(t, add_special_tokens=False).ids, t


def marked_documents(spark, folder):
    spark.createDataFrame(list(enumerate(MARKED)), "doc_id long, text string").write.parquet(f"{folder}/documents.parquet")
    return str(folder)


def test_token_files_query_of_marked_texts(spark, tmp_path):
    plain, start, want = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), 0, []
    for i, t in enumerate(MARKED):
        ids = [*plain.encode(t, add_special_tokens=False).ids, 0]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(map(tuple, op4_token_files(spark, marked_documents(spark, tmp_path / "t")).collect())) == want


def test_packed_lengths_of_marked_texts(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    plain = Tokenizer.from_file(path)
    docs = spark.createDataFrame(list(enumerate(MARKED)), "doc_id long, text string")
    got = {r.doc_id: r.length for r in packing.packed(docs, path).collect()}
    assert got == {i: len(plain.encode(t, add_special_tokens=False).ids) + 1 for i, t in enumerate(MARKED)}
