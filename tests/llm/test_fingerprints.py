import hashlib
import random
from collections import Counter

import numpy as np

from watchloom.llm import fingerprints as P
from watchloom.llm.queries import QUERIES


def jaccard(a, b):
    x, y = Counter(P.PARAGRAPH.findall(a)), Counter(P.PARAGRAPH.findall(b))
    total = sum((x | y).values())
    return sum((x & y).values()) / total if total else 1.0


def texts():
    rnd = random.Random(3)
    out = ["", " ", "one", "a b c d e f g h i j k\n\nl m\n", "x\n" * 50, "same line\n" * 7 + "other\n"]
    for _ in range(120):
        out.append("".join(" ".join(f"w{rnd.randint(0, 60)}" for _ in range(rnd.randint(0, 20))) + "\n" for _ in range(rnd.randint(0, 40))))
    return out


def test_paragraphs_cover_the_text():
    for t in texts():
        assert "".join(P.PARAGRAPH.findall(t)) == t


def test_peeled_likeness_is_exact():
    a = texts()
    b = [P.edited(t, n) for t, n in zip(a, a[1:] + a[:1])]
    c = a[1:] + a[:1]
    da, na = P.paragraph_digests(a)
    for other in (b, c, a):
        db, nb = P.paragraph_digests(other)
        assert np.allclose(P.likeness(da, na, db, nb), [jaccard(x, y) for x, y in zip(a, other)])


def test_equal_texts_have_equal_fingerprints():
    a = texts()
    one, two = (P.fingerprints(*P.paragraph_digests(x)) for x in (a, list(a)))
    assert one == two and len(set(one)) == len({tuple(sorted(P.PARAGRAPH.findall(t))) for t in a})


def check(rows, got):
    assert len(rows) == len(got)
    by_key = Counter()
    for k, (doc_id, text) in enumerate(rows):
        after = P.edited(text or "", rows[(k + 1) % len(rows)][1] or "")
        by_key[(doc_id, len(text or ""), hashlib.sha256(after.encode()).hexdigest(), round(jaccard(text or "", after), 9),
                round(jaccard(text or "", rows[(k + 1) % len(rows)][1] or ""), 9))] += 1
    assert Counter((r["doc_id"], r["n_chars"], r["edited_sha256"], round(r["near_edited"], 9), round(r["near_next"], 9)) for r in got) == by_key


def test_query_eight_equals_the_plain_way(spark, data, docs):
    check(sorted((r["doc_id"], r["text"]) for r in docs.collect()), QUERIES["op8_fingerprints"](spark, data).collect())


def test_many_ranges(spark):
    rows = [(i * 3, f"text {i}\n" * (i % 50) + "tail " * (i % 7)) for i in range(4000)] + [(3000, "tie")]
    rows += [(20_000 + i, "long " * 900) for i in range(1200)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    check(sorted(rows), P.fingerprint(df).collect())


def test_odd_rows(spark, odd, empty):
    rows = sorted(((r["doc_id"], r["text"]) for r in odd.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    check(rows, P.fingerprint(odd).collect())
    assert P.fingerprint(empty).count() == 0
    alone = P.fingerprint(spark.createDataFrame([(1, "abcdefgh")], "doc_id long, text string")).first()
    assert alone["near_next"] == 1.0 and alone["edited_sha256"] == hashlib.sha256(b"abcdefab").hexdigest()
