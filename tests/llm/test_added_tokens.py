"""Packing: added tokens inside a text get the ids that the tokenizers file gives them."""

import zlib

import corpus_pipeline
import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from tallyspark.llm import queries

TEXTS = [
    "one text<|endoftext|>next text",
    "one text <|endoftext|> next text",
    "<|endoftext|>",
    "<|endoftext|><|endoftext|>\n\n<|endoftext|>",
    "almost <|endoftext| > and <|ENDOFTEXT|> and <<|endoftext|>>",
    "space  \t <|endoftext|>  漢字🙂<|endoftext|>é\n",
    "many words " * 1500 + "<|endoftext|>" * 3000,
    "",
    None,
]


def test_added_tokens_get_their_ids(spark, tmp_path):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = []
    for key, text in enumerate(TEXTS):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 0]
        cuts = [0, *range(len(ids) % 2048 or 2048, len(ids) + 1, 2048)]
        want += [(key, i, a, b - a, zlib.crc32(np.array(ids[a:b], dtype="<u4").tobytes())) for i, (a, b) in enumerate(zip(cuts, cuts[1:]))]
        assert ids.count(50256) == (text or "").count("<|endoftext|>")
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    for made in (queries.op7_best_fit_packing(spark, str(tmp_path)), corpus_pipeline.pack(spark, docs, str(tmp_path))):
        assert sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in made.collect()) == want
