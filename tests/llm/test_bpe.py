

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from llm.fixtures import awkward_texts, clashing, documents
from pyspark.sql import functions as F

from tamarack.llm import bpe

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def reference():
    return tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={}
    )


@pytest.fixture(scope="module")
def model():
    return bpe.tokenizer_json(bpe.read_ranks(RANKS))


def test_every_character_as_tiktoken(reference, model):
    codec, decoder = bpe.codec(model, public_tokenizers.PATTERN), bpe.decoder(model)
    texts = [f"a{chr(c)}b {chr(c)}1 " for c in range(0x30000) if not 0xD800 <= c < 0xE000]
    for text, ids in zip(texts, codec.encode(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == reference.encode_ordinary(text), hex(ord(text[1]))
        assert decoder.decode(ids) == text.encode()


def test_bytes_and_characters():
    table = bpe.byte_characters()
    assert len(set(table)) == 256 and table[ord("a")] == "a" and table[0x20] == "\u0120"
    assert bpe.as_bytes(bpe.as_characters(bytes(range(256)))) == bytes(range(256))


def test_documents_as_tiktoken(spark, reference):
    shared = bpe.share(spark, RANKS, public_tokenizers.PATTERN)
    rows = awkward_texts()
    out = bpe.encode(clashing(documents(spark, rows)), shared, offsets=True, decoded=True)
    assert out.columns.count("token_ids") == 1 and "text" not in out.columns and "kept" in out.columns
    packed = out.withColumn("ids", bpe.pack(F.col("token_ids")))
    found = packed.withColumn("again", bpe.decode(F.col("ids"), shared)).collect()
    texts = sorted(((i, t or "") for i, t in rows), key=repr)
    found.sort(key=lambda r: repr((r.doc_id, bytes(r.decoded).decode())))
    for (i, text), row in zip(texts, found, strict=True):
        ids = reference.encode_ordinary(text)
        assert (row.doc_id, row.token_ids, row.n_tokens) == (i, ids, len(ids))
        assert bytes(row.ids) == np.array(ids, "<u4").tobytes()
        assert bytes(row.decoded) == bytes(row.again) == text.encode()
        for (start, end), token in zip(np.reshape(row.token_offsets, (-1, 2)), ids, strict=True):
            assert reference.decode_single_token_bytes(token) in text[start:end].encode()


def test_split_characters_and_unknown_ids(model, reference):
    decoder = bpe.decoder(model)
    ids = reference.encode_ordinary("a🙂中")
    steps = list(decoder.decode_steps(ids))
    assert "".join(steps) == "a🙂中" and "" in steps and len(ids) > 3
    assert list(decoder.decode_steps(ids[:2]))[-1] == "\ufffd"
    with pytest.raises(ValueError, match="no token"):
        decoder.decode(np.array([50256], "<u4").tobytes())


def test_no_rows(spark):
    shared = bpe.share(spark, RANKS, public_tokenizers.PATTERN)
    assert bpe.encode(documents(spark, []), shared).count() == 0
