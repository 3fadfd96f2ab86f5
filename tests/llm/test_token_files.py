import random
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from watchloom.llm import token_files as T
from watchloom.llm.queries import QUERIES


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path(T.VOCABULARY))


def ids_of(library, text):
    return library.encode(text or "", add_special_tokens=False).ids + [2]


def test_units_equal_the_library(library):
    rnd = random.Random(3)
    texts = ["", " ", "\n", "it's I'd 's", "<|endoftext|> x<|startoftext|>", "Ünïcode ÄÖÜß ÿ Ÿ", "日本 😀 é", "×÷ µ ª", "a\tb\x0bc\x1cd e f", "ΣΑΣ ΑΣ", "İI", "x" * 3000]
    texts += ["".join(rnd.choice("abcXYZéÀß 0123!?.,'<|>\n\t-_") for _ in range(rnd.randint(1, 200))) for _ in range(600)]
    flat, counts = T.encode_texts(texts, T.VOCABULARY, 2)
    for text, end, n in zip(texts, np.cumsum(counts), counts):
        assert flat[end - n:end].tolist() == ids_of(library, text), repr(text)


@pytest.mark.parametrize("width", [1, 7, 15, 16, 17, 31])
def test_packed_ids_come_back_from_any_place(width):
    ids = np.random.default_rng(width).integers(0, 1 << width, 1001)
    payload = T.pack(ids, width)
    assert len(payload) == -(-1001 * width // 8)
    for start, count in ((0, 1001), (333, 100), (1000, 1), (5, 0)):
        assert (T.unpack(payload, width, start, count) == ids[start:start + count]).all()


def check(spark, library, rows, got):
    start = 0
    assert len(got) == len(rows)
    for (doc_id, text), r in zip(rows, got):
        ids = ids_of(library, text)
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) == (doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_query_nine_reads_back_what_it_wrote(spark, data, docs, library):
    rows = sorted((r["doc_id"], r["text"]) for r in docs.collect())
    check(spark, library, rows, sorted(QUERIES["op9_token_files"](spark, data).collect(), key=lambda r: r["start"]))


def test_nulls_ties_and_random_access(spark, odd, empty, library):
    path = T.write_token_files(odd)
    rows = sorted(((r["doc_id"], r["text"]) for r in odd.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    check(spark, library, rows, sorted(T.read_token_files(spark, path).collect(), key=lambda r: r["start"]))
    every = np.array([i for _, t in rows for i in ids_of(library, t)])
    for first, count in ((0, 10), (20, 500), (len(every) - 5, 5)):
        assert (T.read_ids(spark, path, first, count) == every[first:first + count]).all()
    assert T.read_token_files(spark, T.write_token_files(empty.select("doc_id", "text"))).count() == 0


def test_distinct_pieces_become_units_all_at_once(monkeypatch):
    pieces = ["", "Plain", "x-Y,z", "É", "Ñandú", "×", "÷a", "don't", "<b>", "a\tb", "Ā", "日本", "\x00", "~|", "a b", "ÀÞß", "", "😀"]
    filled, units = T.distinct_units(pa.array(pieces))
    assert [pieces[i] for i in filled] == [p for p in pieces if p] and units == [u for p in pieces for u in T.units_of(p)]
    some = pa.array(pieces).slice(3, 9)
    assert T.distinct_units(some)[1] == [u for p in some.to_pylist() for u in T.units_of(p)]
    assert T.distinct_units(pa.array(["", ""]))[1] == [] and T.distinct_units(pa.array([], pa.string()))[1] == []
    monkeypatch.setattr(T, "units_of", lambda text: 1 / 0)
    texts = ["One\ntwo  Three\n", None, "", "don't\n日本"]
    flat, counts = T.encode_texts(pa.array(texts), T.VOCABULARY, 2)
    lib = T.library(T.VOCABULARY)
    want = [lib.encode(t or "") + [2] for t in texts]
    assert flat.tolist() == sum(want, []) and counts.tolist() == [len(w) for w in want]
