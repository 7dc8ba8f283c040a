import hashlib

import public_tokenizers
import pyarrow.parquet as pq
from tokenizers import Tokenizer

from quern.llm.bpe import WordBpe, bpe_round_trip, tokenizer_definition

EDGE = [None, "", " ", "\n\n", "a", "Don't we'll I'M 's", "Straße ÉCOLE Σίσυφος ΟΔΟΣ İstanbul ﬁn é  x y\x85z\x1cq", "1234 5,6!?", "🙂👩‍👩‍👧 日本語",
        "x <|endoftext|> Y<|startoftext|>z <| |>", "<|ENDOFTEXT|>", "tab\tand\r\nreturn", "a" * 5000, "word " * 20000, "Ǆ ǅ K Å", "가 한"]


def test_like_the_library(spark):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    texts = EDGE + pq.read_table("/root/testdata/sf0.001/documents.parquet")["text"].to_pylist()
    docs = spark.createDataFrame([(i, x, "n") for i, x in enumerate(texts)] + [(None, "a b", "")], "doc_id long, text string, ids string")
    got = {r.doc_id: r for r in bpe_round_trip(docs, with_ids=True).collect()}
    assert len(got) == len(texts) + 1
    for i, text in enumerate(texts):
        ids = library.encode(text or "", add_special_tokens=False).ids
        assert got[i].ids == ids, text
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_decode_and_stale_entries():
    bpe = WordBpe(tokenizer_definition(None, "word_bpe_49k.json"))
    assert bpe.decode(bpe.encode("hello there")) == "hello</w> there</w>"
    bpe.ranks = {("a", "b"): 0, ("b", "c</w>"): 1, ("ab", "c</w>"): 2}
    bpe.vocab = {"abc</w>": 5, "ab": 1, "a": 2, "b": 3, "c</w>": 4}
    assert bpe.merge_word("abc") == [5]  # the entry for (b, c</w>) is stale by then


def test_empty(spark):
    assert bpe_round_trip(spark.createDataFrame([], "doc_id long, text string")).count() == 0
