"""Toxicity: held-out quality, the fold's rule, calibration and awkward rows."""

import zlib

import numpy as np
from hypothesis import HealthCheck, assume, given, settings
from hypothesis import strategies as st

from framewright.llm import toxicity

from . import cases


def test_held_out_quality(spark):
    sf = "/root/testdata/sf0.1"
    out = {r.doc_id: r for r in toxicity.op1_toxicity(spark, sf).collect()}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert len(out) == 10_000 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in out.values())
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 5 == 0) for d, r in out.items())
    held = [(out[d].score, y) for d, y in labels.items() if out[d].held_out]
    s, y = np.array(held).T
    predicted = s >= 0.5
    # A few labels of toxic texts have no sign of it in the text.
    print("held out: precision", (y[predicted] == 1).mean(), "recall", predicted[y == 1].mean(), "accuracy", (predicted == y).mean())
    assert (y[predicted] == 1).mean() > 0.97 and predicted[y == 1].mean() > 0.85 and (predicted == y).mean() > 0.97
    words = {r.doc_id for r in spark.read.parquet(f"{sf}/documents.parquet").where(r"lower(text) rlike '\\b(idiot|moron|scum|trash|loser)\\b'").collect()}
    assert np.mean([out[d].predicted for d in words]) > 0.99


def test_labels_of_the_held_out_fold_are_not_read(spark):
    docs = spark.createDataFrame([(i, f"you idiot {cases.passage(i, 12)}" if i % 3 == 0 else cases.passage(i, 12)) for i in range(400)], "doc_id bigint, text string")
    truth = [(i, int(i % 3 == 0)) for i in range(400)]
    lies = [(i, 1 - y if zlib.crc32(str(i).encode()) % 5 == 0 else y) for i, y in truth]
    scores = [cases.got(toxicity.toxicity(docs, toxicity.fit(docs, spark.createDataFrame(rows, "doc_id bigint, toxic int"))), "doc_id", "score") for rows in (truth, lies)]
    assert scores[0] == scores[1]


def test_hidden_words_count():
    lexicon = toxicity.Lexicon(frozenset())
    at = toxicity.NAMES.index("hidden")
    for text in ("you 1d1ot", "what a m0r0n", "such l*o*s*e*r talk", "st.up.id"):
        assert toxicity.features(text, lexicon)[0][at] > 0
    assert toxicity.features("version 1.2.3 and e-mail", lexicon)[0][at] == 0


def test_awkward_rows(spark):
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)] + [(None, 1), (3, None), (3, 0)], "doc_id bigint, toxic int")
    model = toxicity.fit(cases.table(spark), labels)
    out = toxicity.toxicity(cases.table(spark).withColumnRenamed("n_chars", "score"), model)
    assert out.columns == ["doc_id", "text", "lang", "source", "score", "predicted"]
    assert out.count() == len(cases.rows()) and out.where("score is null or score < 0 or score > 1").count() == 0
    assert toxicity.toxicity(cases.empty(spark), model).collect() == []


def test_without_labels(spark):
    for rows, prior in (([], 0.0), ([(i, 1) for i in range(9)], 1.0), ([(i, 0) for i in range(9)], 0.0)):
        model = toxicity.fit(cases.table(spark), spark.createDataFrame(rows, "doc_id bigint, toxic int"))
        assert {r.score for r in toxicity.toxicity(cases.table(spark), model).collect()} == {prior}


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 9), st.integers(0, 1)), min_size=1, max_size=40))
def test_isotonic(rows):
    x, y = np.array(rows, float).T
    at, value = toxicity.isotonic(x, y)
    assert (np.diff(at) > 0).all() and (np.diff(value) > 0).all()
    # Each block's value is the mean of its rows: the total is kept.
    fitted = np.array([value[np.abs(at - m).argmin()] for m in at])
    assert (fitted == value).all() and 0 <= value.min() and value.max() <= 1


def test_booster_learns_an_interaction():
    r = np.random.default_rng(0)
    x = r.normal(size=(3000, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    m = toxicity.Booster().fit(x[:2000], y[:2000]).margin(x[2000:])
    assert ((m > 0) == y[2000:]).mean() > 0.95


def brute_tree(x, y, depth, rate, penalty, least):
    """One tree by trying every feature and every value as a cut; its margins."""
    base = np.log(y.mean() / (1 - y.mean()))
    p = 1 / (1 + np.exp(-base))
    g, h = p - y, np.full(len(y), p * (1 - p))
    out = np.full(len(y), base)

    def grow(rows, level):
        gs, hs = g[rows].sum(), h[rows].sum()
        best = None
        if level < depth and len(rows) >= 2 * least:
            for f in range(x.shape[1]):
                for cut in np.unique(x[rows, f])[:-1]:
                    left = x[rows, f] <= cut
                    if min(left.sum(), (~left).sum()) < least:
                        continue
                    gl, hl = g[rows][left].sum(), h[rows][left].sum()
                    gain = gl**2 / (hl + penalty) + (gs - gl) ** 2 / (hs - hl + penalty) - gs**2 / (hs + penalty)
                    assume(best is None or abs(gain - best[0]) > 1e-9)  # of equally good splits either will do
                    if gain > 1e-6 and (best is None or gain > best[0]):
                        best = gain, f, cut
        if best is None:
            out[rows] += -rate * gs / (hs + penalty)
        else:
            left = x[rows, best[1]] <= best[2]
            grow(rows[left], level + 1), grow(rows[~left], level + 1)

    grow(np.arange(len(y)), 0)
    return out


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.filter_too_much])
@given(st.integers(0, 10_000))
def test_a_tree_equals_brute_force(seed):
    r = np.random.default_rng(seed)
    x = r.integers(0, 30, (150, 3)).astype(float)  # fewer values than bins, so that binning loses nothing
    y = (x[:, 0] + r.normal(size=150) * 4 > x[:, 1]).astype(float)
    y[:2] = 0, 1
    b = toxicity.Booster(rounds=1, depth=2, bins=200)
    assert np.allclose(b.fit(x, y).margin(x), brute_tree(x, y, 2, b.rate, b.penalty, b.least))


def test_stems_of_a_language_are_learned(spark):
    """A family of words that stands only in toxic texts, no two texts with the same word."""
    docs = [(i, cases.passage(i, 20) + (f" grumm{chr(97 + i % 26)}{chr(97 + i // 26 % 26)} " if i % 4 == 0 else " ") + cases.passage(i + 9000, 20)) for i in range(600)]
    table = spark.createDataFrame(docs, "doc_id bigint, text string")
    model = toxicity.fit(table, spark.createDataFrame([(i, int(i % 4 == 0)) for i, _ in docs], "doc_id bigint, toxic int"))
    assert any(w.startswith("grum") for w in model.learned)
    assert model.score([f"{cases.passage(77777, 20)} grummxyz {cases.passage(88888, 9)}"])[0] > 0.5 > model.score([cases.passage(77777, 29)])[0]


def test_a_hot_id_is_learned_from_once(spark):
    docs = spark.createDataFrame([(1, f"text {i % 7}") for i in range(500)] + [(i, f"you idiot {i}") for i in range(2, 60)], "doc_id bigint, text string")
    model = toxicity.fit(docs, spark.createDataFrame([(i, int(i > 1)) for i in range(1, 60)], "doc_id bigint, toxic int"))
    assert model.booster is not None and abs(model.booster.base - np.log(46 / 1)) < 1.5


def test_pieces_make_the_same_features(monkeypatch):
    text = " ".join(f"{cases.passage(i, 9)} you st0pid idi0t, moron {cases.passage(i + 50, 3)} dich LOSER!!!" for i in range(60))
    lexicon = toxicity.Lexicon(frozenset(["loser", "such"]))
    (whole,) = toxicity.features(text, lexicon)
    pieces = toxicity.pieces
    for size in (7, 40, 333):
        cut = list(pieces(text, size))
        assert "".join(cut) == text and len(cut) > 2
        monkeypatch.setattr(toxicity, "pieces", lambda t, size=size: pieces(t, size))
        assert toxicity.features(text + " " * (1 << 18), lexicon)[0][:7] == whole[:7]
