import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from lattica.llm import lm
from pyspark.sql import functions as F


def words(text):
    return [*(text or "").translate({c: c + 32 for c in range(65, 91)}).encode().split(), b"\n"]


def check(rows, texts):
    train = Counter(w for i, t in texts if i is not None and zlib.crc32(str(i).encode()) % 10 for w in words(t))
    n, v = sum(train.values()), len(train)
    left = Counter()
    for i, t in texts:
        ws = words(t)
        base = sum(math.log10((train[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws)
        left[i, i is None or zlib.crc32(str(i).encode()) % 10 == 0, len(ws), sum(train[w] > 0 for w in ws), n, round(base, 4)] += 1
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in rows) == left
    assert all(r.score < 0 and math.isfinite(r.score) for r in rows)


@pytest.mark.parametrize("hot, copy", [(1 << 19, 1 << 21), (300, 500), (0, 1 << 21)])
def test_counts_and_base_against_brute_force(spark, monkeypatch, hot, copy):
    monkeypatch.setattr(lm, "HOT", hot)
    monkeypatch.setattr(lm, "COPY_TOKENS", copy)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").repartition(3)
    rows = lm.score_documents(docs).collect()
    check(rows, [(r.doc_id, r.text) for r in docs.collect()])
    held = [r for r in rows if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)  # a lower perplexity on texts not learned from


def test_scores_do_not_depend_on_where_pairs_are_scored(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").repartition(3)
    found = []
    for hot, copy in ((1 << 19, 1 << 21), (200, 300)):
        monkeypatch.setattr(lm, "HOT", hot)
        monkeypatch.setattr(lm, "COPY_TOKENS", copy)
        found.append({r.doc_id: r.score for r in lm.score_documents(docs).collect()})
    assert found[0] == pytest.approx(found[1])


def test_word_contexts_beat_a_unigram_and_endings(spark, monkeypatch):
    """What follows depends on the whole word before, whose ending is shared."""
    rng = np.random.default_rng(4)
    words_before = [f"{x}ing" for x in "abcdefgh"]
    text = lambda: " ".join(f"{words_before[k]} next{k}" for k in rng.integers(0, 8, 60))
    docs = spark.createDataFrame([(k, text()) for k in range(120)], "doc_id long, text string")
    score = lambda: sum(r.score for r in lm.score_documents(docs).where("held_out").collect())
    whole = score()
    monkeypatch.setattr(lm, "LEAST", 10**9)
    assert whole > 0.75 * score()


@pytest.mark.parametrize("frequent", [0, 30])
def test_probabilities_sum_to_one(frequent):
    rng = np.random.default_rng(1)
    contexts = lm.Contexts(np.arange(frequent), np.r_[np.arange(lm.PARENTS), rng.integers(0, lm.PARENTS, frequent)])
    h, u = np.sort(rng.integers(0, 50, 400)), rng.integers(0, contexts.size, 400)
    u[::2] = contexts.size - 1 - rng.integers(0, 30, 200)
    bucket = lm.Bucket(contexts, *lm.merge(h, u, rng.integers(1, 200, 400)))
    model = lm.Model((0.7, 0.6, 0.5), int(bucket.c.sum()), len(bucket.words), contexts, [])
    for _ in range(lm.SWEEPS + 1):
        *_, state = bucket.sweeps(model, 9, len(model.totals))
        made = lm.Totals.cut(bucket.totals(state), contexts.size)
        made.strength = made.drawn(model.discount, (1.0, 1.0, 1.0), rng)
        model.totals.append(made)
    for context in (int(u[0]), 5, 77, contexts.size - 1):
        asked = np.r_[bucket.words, 10_000]  # every word and the unknown one
        _, p = bucket.probabilities(model, 9, asked, np.full(len(asked), context))
        assert abs(p.sum() - 1) < 1e-9 and (p > 0).all()


def test_strengths_find_those_of_the_seating():
    rng, d, s = np.random.default_rng(5), 0.5, 8.0
    tables = []
    for _ in range(400):
        t = 0
        for k in range(200):
            t += rng.random() < (s + d * t) / (s + k)
        tables.append(t)
    drawn, at = [], 1.0
    for _ in range(200):
        at = lm.draw_strength(np.full(400, 200.0), np.array(tables, dtype=np.float64), d, at, rng)
        drawn.append(at)
    assert abs(np.mean(drawn[50:]) - s) < 1
    assert lm.draw_strength(np.zeros(0), np.zeros(0), d, 1.0, rng) > 0
    assert 0 < lm.draw_strength(np.array([1e6]), np.array([2e5]), 0.7, 1.0, rng) < 1e4  # tables in blocks


def test_seating_against_one_at_a_time():
    rng = np.random.default_rng(2)
    c, a, d = 300, 2.0, 0.5
    slow = []
    for _ in range(400):
        t = 1
        for k in range(1, c):
            t += rng.random() < a / (a + k - d * t)
        slow.append(t)
    fast = lm.seat(np.full(4000, c), np.full(4000, a), d, rng)
    assert abs(np.mean(slow) - fast.mean()) < 0.5
    assert lm.seat(np.array([0, 1, 2]), np.ones(3), d, rng)[:2].tolist() == [0, 1]


def test_edges(spark, edge_docs, no_docs):
    check(lm.score_documents(edge_docs).collect(), [(r.doc_id, r.text) for r in edge_docs.collect()])
    assert lm.score_documents(no_docs).count() == 0
    rows = lm.score_documents(edge_docs, F.lit(True)).collect()
    assert len(rows) == edge_docs.count() and all(r.n_known == 0 and r.train_tokens == 0 for r in rows)


def test_contexts_depend_on_shares_in_training_alone(spark):
    """Neither held-out texts nor copies of the whole training set change which words have contexts."""
    rows = [(1, b"the a the b the c"), (2, b"the d e"), (3, None)]
    found = [lm.frequent_words(spark.createDataFrame(rows * k, "doc_id long, text binary"), 8).words.tolist() for k in (1, 40)]
    assert found[0] == found[1] and len(found[0]) == 6


def test_held_out_texts_do_not_change_scores(spark, monkeypatch):
    monkeypatch.setattr(lm, "BUCKET_BYTES", 1 << 40)
    train = [(k, " ".join(f"{w}ing next{w}" for w in "abcabd"), False) for k in range(20)]
    score = lambda rest: {r.doc_id: r.score for r in lm.score_documents(spark.createDataFrame([*train, *rest], "doc_id long, text string, out boolean"), F.col("out")).where("doc_id < 20").collect()}
    assert score([]) == pytest.approx(score([(99, "other " * 200_000, True)]))


def test_reading_against_plain_python():
    texts = [None, b"", b" \n", b"  A bc\tDEF  \xc3\x89a\xc2\xa0z\x0b\x0c\r\x1c\x1fq", b"x\x00y", b"end ", "İ word".encode()]
    cut, sizes = lm.split(pa.array(texts, type=pa.binary()).slice(1))
    plain = [x.translate(bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))).split() for x in texts[1:]]
    assert cut.to_pylist() == [w for x in plain for w in x] and sizes.tolist() == [len(x) for x in plain]
    assert lm.endings(cut).tolist() == [zlib.crc32(w[-1:]) % lm.LAST * lm.PER_LAST + zlib.crc32(w[-3:]) % lm.PER_LAST for w in cut.to_pylist()]
    keys = np.sort(np.random.default_rng(6).integers(-(2**63), 2**63 - 1, 5000))
    asked = np.r_[keys[::2], keys[1::2] + 1, -(2**63), 2**63 - 1]
    at, there = lm.Hot(keys, keys, keys, keys).find(asked)
    assert there.tolist() == np.isin(asked, keys).tolist() and (keys[at[there]] == asked[there]).all()


def test_every_word_of_training_is_a_context(spark, monkeypatch):
    """Rare words are contexts as frequent ones are: where their totals lie changes no more than the draws."""
    rng = np.random.default_rng(4)
    text = lambda: " ".join(f"{'abcdefgh'[k]}ing next{k}" for k in rng.integers(0, 8, 60))
    docs = spark.createDataFrame([(k, text()) for k in range(120)], "doc_id long, text string")
    score = lambda: sum(r.score for r in lm.score_documents(docs).where("held_out").collect())
    frequent = score()
    monkeypatch.setattr(lm, "SHARE", 1)
    assert score() == pytest.approx(frequent, rel=0.02)


def test_totals_by_key_against_totals_in_every_task(spark, monkeypatch):
    """On real texts, over several buckets and meetings; the scores of a text differ by its seating alone."""
    monkeypatch.setattr(lm, "BUCKET_BYTES", 20_000)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").repartition(3)
    found = []
    for share in (1 << 40, 300, 1):
        monkeypatch.setattr(lm, "SHARE", share)
        found.append({r.doc_id: r.score / r.n_tokens for r in lm.score_documents(docs).collect()})
    for other in found[1:]:
        assert other == pytest.approx(found[0], rel=0.03)
        assert sum(other.values()) == pytest.approx(sum(found[0].values()), rel=0.003)


@pytest.mark.parametrize("salts", [1, 2])
def test_customers_and_tables_by_key(spark, monkeypatch, salts):
    """What the meetings send back against counts and tables of all buckets together."""
    monkeypatch.setattr(lm, "SHARE", 1)
    texts = [(True, b"only held out")] + [(False, " ".join(f"w{k % 7} v{k % 5}" for k in range(n)).encode()) for n in (3, 40, 200)] + [(False, None)]
    held_rows = spark.createDataFrame(texts, "held_out boolean, text binary").repartition(3)
    known = spark.sparkContext.broadcast(lm.Contexts(np.zeros(0, dtype=np.int64), np.arange(lm.PARENTS)))
    held = lm.Held(known, lm.dealt(held_rows, 8, salts, known), 2, [])
    model, _ = lm.learn(held)
    states = lambda buckets, _: ((b.keys, b.customers, b.tables, b.by_key(b.c), [b.by_key(x[0]) for x in b.sweeps(model, k, lm.SWEEPS)]) for k, b in buckets)
    found = held.run(states).collect()
    customers, tables = Counter(), Counter()
    for keys, _, _, c, t in found:
        for i, key in enumerate(keys.tolist()):
            customers[key] += int(c[i])
            tables.update({(key, k): int(t[k][i]) for k in range(lm.SWEEPS + 1)})
    assert len(customers) == 12 and sum(customers.values()) == sum(len(t.split()) for held_out, t in texts if t and not held_out)
    for keys, c, t, *_ in found:
        for i, key in enumerate(keys.tolist()):
            assert c[i] == customers[key]
            assert [int(t[k][i]) for k in (0, *range(lm.BURN_IN + 1, lm.SWEEPS + 1))] == [tables[key, k] for k in (0, *range(lm.BURN_IN + 1, lm.SWEEPS + 1))]
