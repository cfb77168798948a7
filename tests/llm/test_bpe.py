import hashlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from factloom.llm.bpe import Codec, bpe, tokenizer_spec

from .docs import awkward, empty

ODD = [
    "Hello  World's 12 é!!! <|endoftext|> a<|startoftext|><|endoftext|>b", "", " ", "Ünïtsİ x ΣΑΣ ὈΔΥΣΣΕΎΣ", "á \x1c\x1d\x85x\xa0y z ​",
    "x" * 5000, "don't I'LL 's '' 'sx ''s", "日本語テキスト１２３", "𝔘𝔫𝔦 🤣🤣 ñ̃", "a\x00b", "ﬁ Å Ω ǅ ẞ", "<|endoftext", "ab" * 1500 + " " + "idiot" * 700,
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def test_round_trip_equals_library(library):
    codec = Codec(tokenizer_spec())
    for text in ODD:
        ids = library.encode(text, add_special_tokens=False).ids
        assert codec.encode(text).tolist() == ids
        assert codec.decode(np.array(ids, "<u4")) == library.decode(ids, skip_special_tokens=False)


def test_table_equals_library(spark, library):
    docs = awkward(spark)
    docs = docs.unionByName(spark.createDataFrame([(20000 + i, t) for i, t in enumerate(ODD)], "doc_id long, text string"), allowMissingColumns=True)
    want = []
    for row in docs.collect():
        ids = library.encode(row.text or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        want.append((row.doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    assert sorted(map(str, map(tuple, bpe(docs).collect()))) == sorted(map(str, want))


def test_cache_turnover(library, monkeypatch):
    import pyarrow as pa

    from factloom.llm import bpe as module
    from factloom.llm.common import Texts

    monkeypatch.setattr(module, "MAX_CHUNKS", 20)
    monkeypatch.setattr(module, "MAX_WORDS", 20)
    codec = Codec(tokenizer_spec())
    for i in range(30):
        text = " ".join(f"word{chr(97 + j % 26)}{'xyz' * (j % 4)}, the" for j in range(i, i + 12))
        assert codec.encode_batch(Texts(pa.array([text])))[0].tolist() == library.encode(text, add_special_tokens=False).ids


def test_empty(spark):
    assert bpe(empty(spark)).count() == 0
