import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from watchloom.llm import pieces, token_counts
from watchloom.llm.queries import QUERIES

ODD = ["", " ", "  a", "\n", "a\n b", "\n\n x", "a" * 17, "▁x ▁", "<s> </s> <0x0A> <unk>", "日本語テキスト😀 é́", "\r\n;\r {\r", "\x00\t\tx",
       "ab" * 900, " " * 40 + "deep" + " " * 17, "lalalalala erererererer ineinein", "😀" * 50]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(pieces.MODEL))


def cases():
    rnd = random.Random(1)
    noise = ["".join(rnd.choice("abcdeéx ▁\n\tth;(){}=>日本😀") for _ in range(rnd.randint(1, 300))) for _ in range(400)]
    parts = ["".join(rnd.choice(["th", "e", "er", "in", "an", "aa", "he", "re", " "]) for _ in range(200)) for _ in range(100)]
    return ODD + noise + parts


def test_rounds_equal_the_library(library):
    texts = cases()
    flat, counts = pieces.encode_texts(texts, pieces.MODEL)
    data, sizes = pieces.vocabulary(pieces.MODEL).decode(flat, counts)
    ends = np.cumsum(counts)
    for text, end, n, shown in zip(texts, ends, counts, pieces.cut(data.tobytes(), sizes)):
        want = library.encode(text, add_bos=True, add_eos=True)
        assert flat[end - n:end].tolist() == want, repr(text)
        assert shown == library.decode(want), repr(text)


def test_encode_and_decode_keep_other_columns(spark, odd, empty, library):
    out = pieces.decode(pieces.encode(odd)).collect()
    want = odd.collect()
    assert len(out) == len(want) and {"doc_id", "n_tokens", "ids", "decoded"} == set(out[0].asDict())
    for got, row in zip(out, want):
        assert got["ids"] == library.encode(row["text"] or "", add_bos=True, add_eos=True) and got["n_tokens"] == row["n_tokens"]
        assert got["decoded"] == library.decode(got["ids"])
    assert pieces.decode(pieces.encode(empty)).count() == 0


def test_query_four_equals_the_library(spark, data, docs, library):
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    rows = QUERIES["op4_sentencepiece"](spark, data).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = library.encode(texts[r["doc_id"]], add_bos=True, add_eos=True)
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids).encode()).hexdigest()


def test_counts_equal_the_library(spark, data, docs, odd, empty, library):
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in QUERIES["op2_token_counts"](spark, data).collect():
        assert r["n_tokens"] == len(library.encode(texts[r["doc_id"]])) and r["n_bytes"] == len(texts[r["doc_id"]].encode())
        assert r["over_limit"] == (r["n_tokens"] > 4096)
    want = sorted((len((r["text"] or "").encode()), len(library.encode(r["text"] or ""))) for r in odd.collect())
    got = token_counts.count_tokens(odd).collect()
    assert sorted((r["n_bytes"], r["n_tokens"]) for r in got) == want and got[0].asDict().keys() == {"doc_id", "n_bytes", "n_tokens", "over_limit"}
    assert token_counts.count_tokens(empty.select("doc_id", "text")).count() == 0


def test_counts_of_odd_texts(library):
    for text in cases():
        one = token_counts.Library(pieces.MODEL)
        assert sum(map(one.count, pieces.units_of(text))) == len(library.encode(text)), repr(text)


def test_counts_with_odd_units_in_the_table(spark, library):
    texts = ["a\x00b a\x00b \x00 plain words of several tokenization lengths", "\x00", "日本😀 \x00\x00 antidisestablishmentarianism x"] * 20 + ODD
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    packed = token_counts.frequent_units(docs, pieces.MODEL, "text")
    tiers = token_counts.Tiers(pieces.MODEL, packed)
    assert any("\x00" in u for u in tiers) and set(tiers) == {u for t in texts for u in pieces.units_of(t) if len(u) <= token_counts.LONG_UNIT}
    for r in token_counts.count_tokens(docs).collect():
        assert r["n_tokens"] == len(library.encode(texts[r["doc_id"]])), repr(texts[r["doc_id"]])
