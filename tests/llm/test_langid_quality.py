import numpy as np
import pytest
from pyspark.sql import functions as F

from wattline.llm import langid, quality
from wattline.llm.common import fold

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_language_on_held_out_documents(docs):
    model = langid.fit(docs.filter(fold("doc_id", 4) != 2), per_lang=100)
    assert model.families == {"germanic": ["de", "en"], "romance": ["es", "fr"]}
    found = langid.with_language(docs.filter(fold("doc_id", 4) == 2), model).select("row.lang", "lang_pred", "score")
    rows = found.collect()
    assert sum(r["lang"] == r["lang_pred"] for r in rows) >= 0.98 * len(rows)
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_language_of_odd_rows(spark, docs, odd, none):
    model = langid.fit(docs, per_lang=50)
    got = langid.with_language(odd, model).select("row.doc_id", "row.text", "lang_pred", "score").collect()
    assert len(got) == odd.count()
    for r in got:
        if r["text"] is None or not any(c.isalpha() for c in r["text"]):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
        else:
            assert r["lang_pred"] in ("de", "en", "es", "fr")
    assert langid.with_language(none, model).count() == 0


def test_language_without_or_with_one_label(odd, none):
    assert langid.fit(none).predict(["some text"])[0] == ["und"]
    only = langid.fit(odd.filter("lang = 'en'"))
    assert only.predict(["some text", None])[0] == ["en", "und"]


def test_rows_without_ids_are_learnt_from(docs):
    """All ids null: the sample is drawn by text, and languages are told apart."""
    nameless = docs.withColumn("doc_id", F.lit(None).cast("long"))
    model = langid.fit(nameless, per_lang=100)
    assert model.families == {"germanic": ["de", "en"], "romance": ["es", "fr"]} and len(model.weights) == 3
    found = langid.with_language(nameless, model).select("row.lang", "lang_pred").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in found) >= 0.98 * len(found)


def test_a_language_without_a_sample_is_not_answered(spark):
    """Copies of one text are chosen together: if that one is not chosen, its
    language is unknown, and without any sample the answer is und."""
    copies = [(None, f"copy of a text number {k}", lang) for k, lang in enumerate(["aa", "bb", "cc", "dd"]) for _ in range(400)]
    rows = spark.createDataFrame(copies, "doc_id long, text string, lang string")
    seen = set()
    for per_lang in (1, 100, 200, 300):
        model = langid.fit(rows, per_lang=per_lang)
        answered = {l for members in model.families.values() for l in members}
        trained = {x for pair in model.weights for x in pair}
        assert {langid.family(l) for l in answered} <= trained or not answered
        names, _ = model.predict(["copy of a text"])
        assert names[0] in (answered or {"und"})
        seen.add(len(answered))
    assert len(seen) > 1


def test_svm_separates():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 3)).astype(np.float32)
    y = np.where(x[:, 0] + 0.5 * x[:, 1] + 0.2 > 0, 1.0, -1.0)
    w = langid.train_svm(x, y)
    assert (np.sign(x @ w[:-1] + w[-1]) == y).mean() > 0.97


def test_quality_on_held_out_documents(spark, docs):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = quality.fit(docs.filter(fold("doc_id", 5) != 0), labels)
    held = quality.with_quality(docs.filter(fold("doc_id", 5) == 0), model).select("row.doc_id", "score")
    rows = held.join(labels, "doc_id").collect()
    right = sum((r["score"] >= 0.3) == (r["quality"] == 1) for r in rows)
    assert right >= 0.95 * len(rows)


def test_quality_of_odd_rows(spark, docs, odd, none):
    labels = spark.read.parquet(f"{SF}/labels.parquet").union(spark.createDataFrame([(None, 1, 0), (3, None, 0), (5, 7, 0)], "doc_id long, quality int, toxic int"))
    model = quality.fit(docs, labels)
    got = quality.with_quality(odd, model).select("row.doc_id", "score").collect()
    assert len(got) == odd.count() and all(0 <= r["score"] <= 1 for r in got)
    assert quality.with_quality(none, model).count() == 0
    assert quality.fit(none, labels).scores(np.zeros((2, 12))).tolist() == [0.5, 0.5]
    one = quality.fit(docs, labels.filter("quality = 1"))
    assert one.scores(np.zeros((1, 12))).tolist() == [1.0]


def test_fitted_means_and_covariances(spark, docs):
    """The fit by partial sums against plain numpy over the labelled texts."""
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = quality.fit(docs, labels, shrink=0.1)
    rows = docs.join(labels, "doc_id").select("text", "quality").collect()
    x = np.array([quality.statistics(r["text"]) for r in rows])
    y = np.array([r["quality"] for r in rows])
    cov = [np.cov(x[y == c].T, bias=True) for c in (0, 1)]
    pooled = sum((y == c).sum() * np.diag(cov[c]) for c in (0, 1)) / len(y)
    for c in (0, 1):
        assert model.mean[c] == pytest.approx(x[y == c].mean(axis=0), rel=1e-9, abs=1e-9)
        want = 0.9 * cov[c] + 0.1 * np.diag(pooled) + 1e-3 * np.eye(x.shape[1])
        assert model.factor[c] @ model.factor[c].T == pytest.approx(want, rel=1e-6, abs=1e-7)
        assert model.log_prior[c] == pytest.approx(np.log((y == c).mean()))


def test_density_difference_against_a_direct_formula(spark, docs):
    model = quality.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    x = np.array([quality.statistics(r["text"]) for r in docs.limit(5).collect()])
    for row, got in zip(x, model.scores(x)):
        d = []
        for c in (0, 1):
            cov = model.factor[c] @ model.factor[c].T
            z = row - model.mean[c]
            d.append(model.log_prior[c] - 0.5 * np.linalg.slogdet(cov)[1] - 0.5 * z @ np.linalg.inv(cov) @ z)
        assert got == pytest.approx(1 / (1 + np.exp(-np.clip((d[1] - d[0]) / model.temper, -30, 30))), rel=1e-6, abs=1e-9)
