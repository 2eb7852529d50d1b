import itertools
import zlib

import numpy as np
import pytest
from lattica.llm import langid, toxicity
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def tables(spark):
    read = lambda t: spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet")
    return read("documents"), read("labels")


@pytest.fixture(scope="module")
def languages(spark, tables):
    return langid.train(tables[0], F.crc32(F.col("doc_id").cast("string")) % 4 != 2)


def test_marginals_against_all_paths():
    rng = np.random.default_rng(1)
    model = langid.Model(["a", "b", "c"], np.zeros((langid.BUCKETS, 3)), {}, np.zeros((1, 3)), rng.normal(size=3), rng.normal(size=(3, 3)))
    sizes = np.array([5, 3, 1])
    emitted = rng.normal(size=(9, 3))
    found, at = model.marginals(emitted, sizes), 0
    for n in sizes:
        want = np.zeros((n, 3))
        for path in itertools.product(range(3), repeat=int(n)):
            s = model.start[path[0]] + sum(emitted[at + k, y] for k, y in enumerate(path)) + sum(model.moves[a, b] for a, b in itertools.pairwise(path))
            for k, y in enumerate(path):
                want[k, y] += np.exp(s)
        assert np.allclose(found[at : at + n], want / want.sum(axis=1, keepdims=True))
        at += n


def test_language_held_out_accuracy(tables, languages):
    truth = {r.doc_id: r.lang for r in tables[0].select("doc_id", "lang").collect()}
    rows = langid.predictions(tables[0], languages, F.crc32(F.col("doc_id").cast("string")) % 4 == 2).collect()
    assert len(rows) == len(truth)
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in rows)
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in held]) > 0.97


def test_code_switched_words(tables, languages):
    texts = {r.lang: r.text for r in tables[0].where("n_chars > 2000").dropDuplicates(["lang"]).select("lang", "text").collect()}
    a, b = sorted(texts)[:2]
    x, y = langid.tokens(texts[a])[:30], langid.tokens(texts[b])[:30]
    found = languages.marginals(languages.emissions(x + y), np.array([60])).argmax(axis=1)
    assert np.mean(found[:30] == languages.languages.index(a)) > 0.9 and np.mean(found[30:] == languages.languages.index(b)) > 0.9


def test_predictions_against_brute_force(spark, languages):
    """Every word's distribution by sums over all paths, for whole short texts; ties go to the first language."""
    docs = {k: x for k, x in enumerate(["one two", "der die das und", "la casa", "a", "one der la"])}
    rows = langid.predictions(spark.createDataFrame(list(docs.items()), "doc_id long, text string"), languages, F.lit(False)).collect()
    for r in rows:
        words = langid.tokens(docs[r.doc_id])
        emitted, total = languages.emissions(words).astype(np.float64), np.zeros(len(languages.languages))
        weight = 0.0
        for path in itertools.product(range(len(total)), repeat=len(words)):
            w = np.exp(languages.start[path[0]] + sum(emitted[k, y] for k, y in enumerate(path)) + sum(languages.moves[a, b] for a, b in itertools.pairwise(path)))
            weight += w
            total += w * np.bincount(path, minlength=len(total)) / len(words)
        assert r.lang_pred == languages.languages[int((total / weight).argmax())] and abs(r.score - (total / weight).max()) < 1e-4
    same = langid.Model(["a", "b"], np.zeros((langid.BUCKETS, 2), dtype=np.float32), {}, np.zeros((1, 2), dtype=np.float32), np.zeros(2), np.zeros((2, 2)))
    assert same.predict(["x y"])[0] == ["a"]


def test_training_words_come_from_the_whole_text():
    text = " ".join("".join(chr(97 + int(c)) for c in str(k)) for k in range(5000))
    words, all_words = langid.sampled_runs(text, 12345), langid.tokens(text)
    places = [all_words.index(w) for w in words]
    assert len(words) == langid.RUNS * langid.RUN and min(places) < 1000 and max(places) > 4000
    assert langid.sampled_runs("a b c", 7) == ["a", "b", "c"] and langid.sampled_runs(None, 7) == []


def test_language_edges(spark, languages, edge_docs, no_docs):
    rows = langid.predictions(edge_docs, languages, F.lit(False)).collect()
    assert len(rows) == edge_docs.count()
    by = {r.doc_id: r for r in rows}
    assert all(by[k].lang_pred == "und" and by[k].score == 0 for k in (0, 1, 2)) and by[3].lang_pred != "und"
    assert langid.keep_identified(edge_docs, languages).columns == edge_docs.columns
    assert langid.predictions(no_docs, languages, F.lit(True)).count() == 0
    odd = spark.createDataFrame([(1, "½"), (2, "² 12"), (3, "Ⅷ ⅷ"), (4, "x½")], "doc_id long, text string")
    assert [r.lang_pred == "und" for r in langid.predictions(odd, languages, F.lit(False)).orderBy("doc_id").collect()] == [True, True, True, False]
    nothing = langid.train(no_docs)
    assert langid.keep_identified(edge_docs, nothing).count() == edge_docs.count()
    assert {r.lang_pred for r in langid.predictions(edge_docs, nothing, F.lit(False)).collect()} == {"und"}


def test_noisy_or_and_bags():
    model = toxicity.Model(np.zeros(toxicity.BUCKETS, dtype=np.float32), -1.0)
    p = 1 / (1 + np.exp(1.0))
    assert np.allclose(model.score(["a b. c\nd", "", None, "x", "..."]), [1 - (1 - p) ** 3, 0, 0, p, 0])
    buckets, first, per = toxicity.bags(["a b. c\nd", "", None, "x", "..."])
    assert len(buckets) == 20 and first.tolist() == [0, 8, 12, 16] and per.tolist() == [3, 0, 0, 1, 0]


def test_toxicity_held_out(spark, tables):
    docs, labels = tables
    model = toxicity.train(docs, labels, F.crc32(F.col("doc_id").cast("string")) % 3 != 1)
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    rows = toxicity.scores(docs, model, F.crc32(F.col("doc_id").cast("string")) % 3 == 1).collect()
    assert len(rows) == docs.count() and all(r.predicted == int(r.score >= 0.7) for r in rows)
    held = [(r.score, truth[r.doc_id]) for r in rows if r.held_out and r.doc_id in truth]
    bad, good = [s for s, y in held if y], [s for s, y in held if not y]
    assert np.mean([a > b for a in bad for b in good]) > 0.85
    toxic = next(r for r in docs.join(labels, "doc_id").where("toxic = 1").orderBy("doc_id").collect() if model.score([r.text])[0] > 0.7)
    spans = model.offending(toxic.text)
    assert spans and sum(b - a for a, b in spans) < len(toxic.text)


def test_toxicity_edges(spark, edge_docs, no_docs):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    some = spark.createDataFrame([(3, None, 1), (3, 1, 0), (5, 1, 0), (None, 1, 1), (6, 0, None)], "doc_id long, quality int, toxic int")
    for labels in (none, some):
        rows = toxicity.score_documents(edge_docs, labels).collect()
        assert len(rows) == edge_docs.count() and all(0 <= r.score <= 1 for r in rows)
    assert toxicity.score_documents(no_docs, some).count() == 0
