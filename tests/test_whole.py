"""Queries over whole tables and whole texts, against brute force on a small fixture."""

import hashlib

import pytest
from lattica.queries import QUERIES

TEXTS = [None, "", "t", "th", "the", "thethe", "ththe", "x" * 599 + "the", "é the 日本 🙂 the" * 60, "the " * 9000, " ", "\x00the"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("whole"))
    spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").repartition(3).write.parquet(f"{out}/documents.parquet")
    return out


def test_find_text(spark, folder):
    got = {r.doc_id: (r.n, r.hits, r.places) for r in QUERIES["find_text"](spark, folder).collect()}
    at = {k: [i for i in range(len(t or "") - 2) if t.startswith("the", i)] for k, t in enumerate(TEXTS)}
    assert got == {k: (None, None, None) if t is None else (max(0, len(t) - 2), len(at[k]), sum(at[k])) for k, t in enumerate(TEXTS)}


def test_text_code_points(spark, folder):
    got = {r.doc_id: (r.n, r.codes) for r in QUERIES["text_code_points"](spark, folder).collect()}
    assert got == {k: (None, None) if t is None else (len(t), hashlib.md5(" ".join(map(str, map(ord, t))).encode()).hexdigest()) for k, t in enumerate(TEXTS)}


def test_utf8_round_trip(spark, folder):
    got = {r.doc_id: (r.t, r.n) for r in QUERIES["utf8_round_trip"](spark, folder).collect()}
    assert got == {k: (None, None) if t is None else (hashlib.md5(t.encode()).hexdigest(), len(t.encode())) for k, t in enumerate(TEXTS)}


@pytest.fixture(scope="module")
def vectors(spark, tmp_path_factory):
    """120 vectors of 64 small whole numbers, and 400 events of few users, one of them hot and some past the vectors."""
    out = str(tmp_path_factory.mktemp("vectors"))
    rows = [[float((7 * i + k * k) % 5 - 2) for k in range(64)] for i in range(120)]
    users = [3 if i % 2 else i % 150 for i in range(400)]
    spark.createDataFrame(list(enumerate(rows)), "vec_id long, embedding array<float>").repartition(3).write.parquet(f"{out}/embeddings.parquet")
    spark.createDataFrame([(i, u, 1.0) for i, u in enumerate(users)], "event_id long, user_id long, value double").repartition(3).write.parquet(f"{out}/events.parquet")
    return out, rows, users


def test_matmul_join(spark, vectors):
    out, rows, _ = vectors
    got = {(r.i0, r.i1): r.v for r in QUERIES["matmul_join"](spark, out).collect()}
    assert got == {(a, b): sum(x[a] * x[b] for x in rows) for a in range(64) for b in range(64)}


def test_select_rows(spark, vectors):
    out, rows, users = vectors
    got = {(r.i0, r.i1): r.v for r in QUERIES["select_rows"](spark, out).collect()}
    assert got == {(i, k): rows[u % 120][k] for i, u in enumerate(users) for k in range(64)}


def test_sign_of_values_at_zero(spark, tmp_path):
    spark.createDataFrame([(i, (0.0, -0.0, 2.5, -2.5)[i // 4]) for i in range(16)], "event_id long, value double").write.parquet(f"{tmp_path}/events.parquet")
    assert [r.v for r in QUERIES["sign_of_not_a_number"](spark, str(tmp_path)).orderBy("i0").collect()] == [1.0, -1.0, 0.0, -1.0] * 4
