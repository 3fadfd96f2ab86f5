import numpy as np
from pyspark.sql import functions as F

from watchloom.llm import language as L
from watchloom.llm.queries import QUERIES


def test_gradient_is_the_slope_of_the_loss():
    rng = np.random.default_rng(0)
    net = L.new_network(["a", "b", "c"], 3)
    net.inputs, net.state = [x.astype(np.float64) for x in net.inputs], [x.astype(np.float64) for x in net.state]
    net.out, net.bias = net.out.astype(np.float64), net.bias.astype(np.float64)
    codes, lengths, target = rng.integers(0, 256, (7, 5)).astype(np.uint8), np.array([7, 7, 3, 5, 1]), np.array([0, 1, 2, 1, 0])
    _, slopes = L.gradients(net, codes, lengths, target)
    for value, slope in zip(net.parameters(), slopes):
        at = tuple(int(rng.integers(0, n)) for n in value.shape)
        if value.shape[0] == 256:
            at = (int(codes[0, 0]), at[1])
        old, step = value[at], 1e-3
        value[at] = old + step
        up = L.gradients(net, codes, lengths, target)[0]
        value[at] = old - step
        down = L.gradients(net, codes, lengths, target)[0]
        value[at] = old
        assert abs((up - down) / (2 * step) - slope[at]) < 1e-4


def test_pooled_labels_are_means_over_all_bytes():
    net = L.new_network(["a", "b"])
    text = "räksmörgås " * 30
    data = text.encode()
    want = np.zeros(2)
    for i in range(0, len(data), L.WINDOW):
        codes, _ = L.lay_out([data[i:i + L.WINDOW]])
        p = L.probabilities(net, codes[:len(data[i:i + L.WINDOW])] if len(data) - i >= L.WINDOW else codes)
        want += p[:min(L.WINDOW, len(data) - i), 0].sum(axis=0)
    assert np.abs(L.label_texts(net, ["", text])[1] - want / len(data)).max() < 1e-5
    assert L.label_texts(net, [""]).tolist() == [[0.0, 0.0]]


def test_query_three_is_right_on_held_out_texts(spark, data, docs):
    rows = {r["doc_id"]: r for r in QUERIES["op3_language"](spark, data).collect()}
    truth = docs.where("lang IS NOT NULL").select("doc_id", "lang").collect()
    held = [r for r in truth if rows[r["doc_id"]]["held_out"]]
    assert len(rows) == docs.count() and len(held) > 20
    assert np.mean([rows[r["doc_id"]]["lang_pred"] == r["lang"] for r in held]) > 0.9
    assert all(0 <= r["score"] <= 1 for r in rows.values())


def test_texts_without_letters_and_small_tables(spark, odd, empty):
    net = L.fit(odd.withColumn("lang", F.when(F.col("n_tokens") % 2 == 0, "xx").otherwise("yy")), F.lit(True))
    out = L.identify(odd, net).collect()
    by_text = {r["n_tokens"]: r for r in out}
    assert by_text[1]["lang_pred"] == by_text[2]["lang_pred"] == by_text[6]["lang_pred"] == by_text[9]["lang_pred"] == "und"
    assert by_text[1]["score"] == 0 and by_text[0]["lang_pred"] in ("xx", "yy") and len(out) == 12
    none = L.fit(empty, F.lit(True))
    assert {r["lang_pred"] for r in L.identify(odd, none).collect()} == {"und"} and L.identify(empty, none).count() == 0
    one = L.fit(odd.withColumn("lang", F.lit("zz")), F.lit(True))
    assert {r["lang_pred"] for r in L.identify(odd, one).collect()} == {"und", "zz"}
