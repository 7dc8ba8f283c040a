import random

import public_tokenizers
import pyarrow.parquet as pq
from tokenizers import Tokenizer

from quern.llm.bpe import tokenizer_definition
from quern.llm.library_encoder import LibraryEncoder
from quern.llm.piece_table import PieceTable
from quern.llm.token_counts import field_token_counts, section_token_counts

LIBRARY = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
EDGE = [None, "", " ", "\n", "\n\n\n", " lead", "trail ", "trail\n", "a  b", "a\n\nb\n \nc", "don't we'll", "日本語 テスト🙂\n🙂🙂", "x<|endoftext|>y z",
        "tab\there\r\nthere", " a  b", "word " * 3000 + "x", "y" * 4000, "a\x1cb \x1c c"]

# a surplus space or break beside other white space, so that cuts at spaces and cuts at white space are equally many
MIXED = ["x y\tz", "a b\u00a0c", "a\u00a0b ", " a\u3000b", "a  b\tc", "a\n\n\nb\u00a0c\u00a0d", "a\n\nb\u2003c", "a\r\n\nb\x1cc ", "\na\x85b", "a \n b\x0bc\td"]


def texts():
    return EDGE + pq.read_table("/root/testdata/sf0.001/documents.parquet")["text"].to_pylist()[:60]


def brute(text):
    text = text or ""
    spans, at = [], 0
    for line in text.split("\n"):
        spans.append((at, min(at + len(line) + 1, len(text))))
        at += len(line) + 1
    counts = [0] * len(spans)
    for a, b in LIBRARY.encode(text, add_special_tokens=False).offsets:
        over = [min(hi, b) - max(lo, a) for lo, hi in spans]
        counts[over.index(max(over))] += 1
    return counts


def test_encoder_is_the_library():
    encoder, all_texts = LibraryEncoder(tokenizer_definition(None, "byte_bpe_50k.json")), [t or "" for t in texts()]
    for got, (starts, ends), text in zip(encoder.encode_batch(all_texts), encoder.spans_batch(all_texts), all_texts, strict=True):
        want = LIBRARY.encode(text, add_special_tokens=False)
        assert got.tolist() == want.ids, text[:50]
        assert list(zip(starts.tolist(), ends.tolist(), strict=True)) == want.offsets, text[:50]


def test_sections_match_brute_force(spark):
    docs = spark.createDataFrame([(i, t, 5) for i, t in enumerate(texts())], "doc_id long, text string, n_tokens int")
    got = {}
    for r in section_token_counts(docs).orderBy("doc_id", "section").collect():
        got.setdefault(r.doc_id, []).append(r.n_tokens)
    assert got == {i: brute(t) for i, t in enumerate(texts())}
    assert section_token_counts(docs.limit(0)).count() == 0


def test_fields(spark):
    df = spark.createDataFrame([(1, "title here", "body text", None), (1, "title here", "body text", None), (None, None, "", "z")], "k int, title string, body string, field string")
    rows = field_token_counts(df, "k", ["title", "body", "field"]).collect()
    assert len(rows) == 9
    assert sorted(r.n_tokens for r in rows if r.field == "title") == [0, 2, 2]


def test_mixed_white_space_is_the_library(spark):
    encoder = LibraryEncoder(tokenizer_definition(None, "byte_bpe_50k.json"))
    for text in MIXED:
        want = LIBRARY.encode(text, add_special_tokens=False)
        ((starts, ends),) = encoder.spans_batch([text])
        assert encoder.encode_batch([text])[0].tolist() == want.ids, text
        assert list(zip(starts.tolist(), ends.tolist(), strict=True)) == want.offsets, text
    docs, got = spark.createDataFrame(list(enumerate(MIXED)), "doc_id long, text string"), {}
    for r in section_token_counts(docs).orderBy("doc_id", "section").collect():
        got.setdefault(r.doc_id, []).append(r.n_tokens)
    assert got == {i: brute(t) for i, t in enumerate(MIXED)}


def test_random_white_space_is_the_library():
    encoder, rng = LibraryEncoder(tokenizer_definition(None, "byte_bpe_50k.json")), random.Random(1)
    alphabet = [*"ab9Z.,-(_|\n\n\t\r\x00\x0b\x1c\x85  　​﻿́", " ", " ", " ", "'s", "'ll", "12", "é", "日", "ß²", "🙂", "<|", "<|endoftext|>"]
    for _ in range(40):
        batch = ["".join(rng.choices(alphabet, k=rng.randint(0, 14))) for _ in range(500)]
        for text, ids, (starts, ends) in zip(batch, encoder.encode_batch(batch), encoder.spans_batch(batch), strict=True):
            want = LIBRARY.encode(text, add_special_tokens=False)
            assert ids.tolist() == want.ids, repr(text)
            assert list(zip(starts.tolist(), ends.tolist(), strict=True)) == want.offsets, repr(text)


def test_a_full_table_changes_nothing():
    encoder = LibraryEncoder(tokenizer_definition(None, "byte_bpe_50k.json"))
    encoder.ids = PieceTable(6), encoder.ids[1]
    for text in [t or "" for t in texts()] * 2:
        assert encoder.encode_batch([text])[0].tolist() == LIBRARY.encode(text, add_special_tokens=False).ids
