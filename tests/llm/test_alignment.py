import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

from watchloom.llm import alignment as A
from watchloom.llm.queries import QUERIES


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(public_tokenizers.path(A.TOKENIZER_A))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(A.TOKENIZER_B))


def groups(libraries, text):
    """[(A ids, B ids)] of a text by the libraries, or [] where the tokens do not spell it."""
    a, b = libraries
    if not text:
        return []
    spelled = A.byte_of_char()
    ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    bytes_a = [bytes(spelled[c] for c in a.id_to_token(i)) for i in ids_a]
    bytes_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
    if b"".join(bytes_a) != (" " + text).encode() or b"".join(bytes_b) != (" " + text).encode():
        return []
    ends_a, ends_b = np.cumsum([len(x) for x in bytes_a]).tolist(), np.cumsum([len(x) for x in bytes_b]).tolist()
    out, i, j = [], 0, 0
    for end in sorted(set(ends_a) & set(ends_b)):
        k, m = ends_a.index(end, i) + 1, ends_b.index(end, j) + 1
        out.append((ids_a[i:k], ids_b[j:m]))
        i, j = k, m
    return out


def expected(libraries, rows):
    every = [groups(libraries, t) for _, t in rows]
    count = Counter()
    for g in every:
        count.update({(x, y) for a, b in g for x in a for y in b})
    highest = defaultdict(int)
    for (x, _), n in count.items():
        highest[x] = max(highest[x], n)
    out = []
    for (doc_id, _), g in zip(rows, every):
        links = [(x, y) for a, b in g for x in a for y in b]
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in g)
        out.append((doc_id, sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), len(links), sum(count[p] == highest[p[0]] for p in links),
                    sum(count[p] for p in links), hashlib.sha256(text.encode()).hexdigest() if g else ""))
    return sorted(out, key=repr)


def got(df):
    return sorted(((r["doc_id"], r["n_a"], r["n_b"], r["n_groups"], r["n_links"], r["n_best"], r["count_sum"], r["groups_sha256"]) for r in df.collect()), key=repr)


ODD = ["", " ", "  ", "a", " a", "a ", "a  b", "a \n b", "\n\n\n b", "x\ty z", "it's I'd 's ' s", "<|endoftext|> <s> </s> <unk> <0x41>", "日本語 テキスト 😀 é", "▁ mark", "a▁b",
       "nul\0 inside", "no break and em", "zero​ width ᠎ x", "\x1c\x1d a \x85 b", "é" * 50, "aaaa" * 300, "—" * 40 + " x", "123456 789,0 ..  .", "🤷🏽‍♀️ family 👨‍👩‍👧", "﻿bom", "ſt ﬁ"]


def test_groups_are_those_of_the_libraries(libraries):
    rnd = random.Random(5)
    texts = ODD + ["".join(rnd.choice(["ab", "the", " ", " ", "\n", "  ", "é", "日", "'s", "1", ".", "😀", "▁", "\t", "Word"]) for _ in range(rnd.randint(1, 120))) for _ in range(500)]
    pair = A.Pair(A.TOKENIZER_A, A.TOKENIZER_B)
    for _ in range(2):  # the second time from the cache
        found = A.Aligned(pair, pa.array(texts))
        size_a, size_b = found.sizes()
        at = np.append(0, np.cumsum(found.n_groups))
        for k, text in enumerate(texts):
            own = [(found.a[found.a_ends[g] - size_a[g]:found.a_ends[g]].tolist(), found.b[found.b_ends[g] - size_b[g]:found.b_ends[g]].tolist()) for g in range(at[k], at[k + 1])]
            assert own == groups(libraries, text), repr(text)


def test_the_cache_forgets_and_stays_right(libraries, monkeypatch):
    monkeypatch.setattr(A, "CACHE_UNITS", 50)
    pair = A.Pair(A.TOKENIZER_A, A.TOKENIZER_B)
    rnd = random.Random(6)
    for _ in range(30):
        texts = [" ".join("".join(rnd.choice("abcdeé.") for _ in range(rnd.choice([2, 3, 60]))) for _ in range(12)) for _ in range(5)]
        found = A.Aligned(pair, pa.array(texts))
        assert found.n_links().tolist() == [sum(len(a) * len(b) for a, b in groups(libraries, t)) for t in texts]
        assert pair.count <= 50 + 70


def test_query_eleven_against_all_links(spark, data, docs, libraries):
    assert got(QUERIES["op11_alignment"](spark, data)) == expected(libraries, [(r["doc_id"], r["text"]) for r in docs.collect()])


@pytest.mark.parametrize("most", [A.TABLE_PAIRS, 20, 0])
def test_odd_rows_with_any_size_of_the_table(spark, odd, libraries, most):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()] + [(100 + i, t) for i, t in enumerate(ODD)] + [(900, "aaaaaaaab" * 9000)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(A.linked_counts(table, most=most)) == expected(libraries, rows)


def test_large_groups_and_parts_give_the_same_pairs(monkeypatch):
    texts = pa.array(["aaaaaaab bbbbbb ccccccccccc " * 40, "日本語日本語" * 30, "x"])
    pair = A.Pair(A.TOKENIZER_A, A.TOKENIZER_B)
    whole = A.Aligned(pair, texts).pairs()
    monkeypatch.setattr(A, "LARGE", 1)
    monkeypatch.setattr(A, "LINKS", 3)
    assert all((x == y).all() for x, y in zip(whole, A.Aligned(pair, texts).pairs()))


def test_alignment_gives_ids_and_cuts(spark, empty, libraries):
    text = "Some words, über alles\n\nand more"
    row = A.align(spark.createDataFrame([(1, text, 5)], "doc_id long, text string, a_ids int")).first()
    cut = lambda ids, ends: [ids[x:y] for x, y in zip([0, *ends], ends)]
    assert list(zip(cut(row["a_ids"], row["a_ends"]), cut(row["b_ids"], row["b_ends"]))) == groups(libraries, text)
    assert A.linked_counts(empty.select("doc_id", "text")).count() == 0
