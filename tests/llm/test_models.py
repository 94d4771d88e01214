"""Learned operators: held-out results, brute-force recursion, odd rows."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from larder.llm import language, quality, toxicity

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


@pytest.fixture(scope="module")
def network(docs, labels):
    return quality.fitted(docs, labels)


def _auc(score, y):
    rank = np.argsort(np.argsort(score))
    return (rank[y == 1].mean() - rank[y == 0].mean()) / len(y) + 0.5


def test_quality_of_held_out_documents(docs, labels, network):
    rows = quality.scored(docs, network).join(labels, "doc_id").filter("held_out").toPandas()
    assert _auc(rows.score.to_numpy(), rows.quality.to_numpy()) > 0.85
    assert (rows.predicted == rows.quality).mean() > 0.88


def test_quality_pools_the_whole_text(network):
    """Responses of chunks one by one: the end of a long text counts as much as its beginning."""
    text = ("ab cd " * 3000 + "XYZ!! ### THE END!!").encode()
    padded = list(text) + [quality.PAD] * (-len(text) % 8 + 8)
    responses = [np.concatenate([network.embed[padded[i + k]] for k in range(16)]) @ network.filters + network.bias for i in range(0, len(padded) - 15, 8)]
    want = network.head(np.max(responses, axis=0)[None])[2][0]
    assert network.scores(pa.array([None, "", text.decode()]))[2] == pytest.approx(want, abs=1e-4)


def test_quality_of_odd_rows(clashing, empty, network, docs, labels):
    rows = quality.scored(clashing, network).collect()
    assert len(rows) == clashing.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    assert quality.scored(empty, network).collect() == []
    one_class = quality.fitted(docs, labels.filter("quality = 1"))
    assert all(r.score > 0.9 for r in quality.scored(clashing, one_class).collect())
    assert quality.scored(clashing, quality.fitted(docs, labels.limit(0))).first().score == pytest.approx(0.5)


def brute_viterbi(e, penalty):
    v, back = e[0].copy(), []
    for row in e[1:]:
        best = v.argmax()
        back.append(np.where(v >= v[best] - penalty, np.arange(len(v)), best))
        v = np.maximum(v, v[best] - penalty) + row
    path = [int(v.argmax())]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    return path[::-1]


def test_viterbi_matches_the_plain_recursion():
    r = np.random.default_rng(0)
    counts = [0, 1, 5, 31, 32, 33, 200, 0, 64]
    first = np.concatenate([[0], np.cumsum(counts)])
    e = (r.standard_normal((first[-1], 3)) * 4).astype(np.float32)
    got = language.viterbi(e, first, 6.0)
    score = lambda p, x: sum(x[i, k] for i, k in enumerate(p)) - 6.0 * sum(a != b for a, b in zip(p, p[1:]))
    for a, b in zip(first, first[1:]):
        if b > a:
            assert score(got[a:b].tolist(), e[a:b]) == pytest.approx(score(brute_viterbi(e[a:b].astype(float), 6.0), e[a:b]), abs=1e-2)


def test_language_of_held_out_documents(docs):
    model = language.trained(docs.filter(~quality.held_out("doc_id")).select("text", "lang"))
    rows = language.with_languages(docs, model).filter(quality.held_out("doc_id")).select("lang", "lang_pred").collect()
    assert np.mean([r.lang == r.lang_pred for r in rows]) > 0.97


def test_spans_of_mixed_text(docs, clashing, empty, spark):
    model = language.trained(docs.select("text", "lang"))
    part = {x: docs.filter((F.col("lang") == x) & F.length("text").between(300, 3000)).orderBy("doc_id").first().text for x in ("de", "es")}
    lang, share, spans = language.identify([part["de"] + "\n" + part["es"], "12 !", ""], model)
    main = [s for s in spans[0] if s["end"] - s["start"] > 100]
    assert [s["lang"] for s in main] == ["de", "es"] and abs(main[1]["start"] - len(part["de"])) < 40
    assert lang[1:] == ["und", "und"] and share[1:].tolist() == [0, 0]
    lang, share, _ = language.identify(["❤️ 12", "\u0301", "e\u0301te\u0301 \u0301"], model)  # marks alone are no letters
    assert lang[:2] == ["und", "und"] and share[:2].tolist() == [0, 0] and lang[2] != "und"
    rows = language.with_languages(clashing, model).collect()
    assert len(rows) == clashing.count() and all((r.lang_pred == "und") == (r.lang_score == 0) for r in rows)
    assert language.with_languages(empty, model).collect() == []
    nothing = language.trained(spark.createDataFrame([(None, "a")], "lang string, text string"))
    assert language.with_languages(clashing, nothing).select("lang_pred").distinct().collect() == [("und",)]
    kept = language.in_known_language(docs.limit(50))
    assert kept.columns == docs.columns


def test_scripts_narrow_the_languages():
    model = language.Model(["el", "en"], np.zeros((language.BUCKETS, 2), np.float32), np.zeros((len(language.SCRIPT_NAMES), 2), bool))
    model.uses[language.SCRIPT_NAMES.index("greek"), 0] = model.uses[language.SCRIPT_NAMES.index("latin"), 1] = True
    assert language.identify(["αβγ δεζ", "abc def"], model)[0] == ["el", "en"]


def test_toxic_documents_are_found(docs, labels):
    model = toxicity.trained(docs, labels)
    assert (np.diff(model.thresholds) > 0).all()
    rows = toxicity.graded(docs, model).withColumnRenamed("toxic", "found").join(labels, "doc_id").toPandas()
    clean, bad = rows[rows.toxic == 0], rows[rows.toxic == 1]
    assert clean.found.mean() < 0.01 and bad.found.mean() > 0.6
    assert bad.severity.mean() > 10 * clean.severity.mean()


def test_gradient_of_the_ordinal_fit():
    """The fit lowers the loss to that of a fine search over one feature's weight."""
    r = np.random.default_rng(1)
    x = r.standard_normal((400, 1))
    grades = np.clip((x[:, 0] * 2 + r.logistic(size=400)).round(), 0, 3).astype(int)

    def loss(w, theta):
        c = np.column_stack([np.ones(400), toxicity._logistic(x * w - theta[None]), np.zeros(400)])
        return -np.log(c[np.arange(400), grades] - c[np.arange(400), grades + 1]).mean()

    w, theta = toxicity.fit(x, grades)
    assert (np.diff(theta) > 0).all() and 1 < w[0] < 3
    assert all(loss(w[0], theta) <= loss(w[0] + d, theta + s) + 2e-4 for d in (-0.2, 0, 0.2) for s in (-0.2, 0, 0.2))


def test_toxicity_of_odd_rows(clashing, empty, docs, labels):
    model = toxicity.trained(docs, labels.filter("toxic = 0"))
    rows = toxicity.graded(clashing, model).collect()
    assert len(rows) == clashing.count() and not any(r.toxic for r in rows)
    assert toxicity.graded(empty, model).collect() == []
