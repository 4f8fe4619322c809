"""Packing by the plain call of ``tokenizers``: names of added tokens in a text become those tokens."""

import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import __spark_entry__

TEXTS = ["end <|endoftext|> start", "中文<|endoftext|>中文", "<|endoftext|>", "<|endoftext| >", "plain"]


def test_queries_encode_as_the_plain_call(spark, tmp_path):
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(TEXTS)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    body = [plain.encode(t, add_special_tokens=False).ids for t in TEXTS]
    assert body[0] == [437, 220, 50256, 923]
    got = {}
    for r in __spark_entry__.queries()["op5_packing"](spark, str(tmp_path)).collect():
        got.setdefault(r.doc_id, []).append((r.start, r.length, r.ids_crc32, r.doc_tokens))
    for i, ids in enumerate(body):
        n = {d for *_, d in got[i]}.pop()
        assert n - len(ids) == 1  # the end mark
        for start, length, crc, _ in got[i]:
            if start + length <= len(ids):
                assert crc == zlib.crc32(np.array(ids[start : start + length], "<u4").tobytes())
