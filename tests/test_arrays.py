import math

import numpy as np
import pytest
from lattica.darray import Engine
from lattica.errors import DomainError, FillError, RankError, ShapeError
from lattica.functions import numeric as num
from lattica.operators import combinators as c
from lattica.operators import fold, linalg, order, pervasive, scan, search, selection, sets, structural
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def e(spark):
    return Engine(spark)


def test_reshaping_golden_values(e):
    six = e.literal([1, 2, 3, 4, 5, 6])
    assert structural.reshape(six, 2, 3).collect() == [[1, 2, 3], [4, 5, 6]]
    assert structural.reshape(e.literal([3, 1]), 5).collect() == [3, 1, 3, 1, 3]
    assert structural.take(e.literal([11, 12, 13]), -5).collect() == [0, 0, 11, 12, 13]
    assert structural.take(e.literal("ab"), 4).collect() == ["a", "b", " ", " "]
    assert structural.take(e.iota(0), 0).shape == (0,)
    assert structural.reshape(six, "pad", 4).collect() == [[1, 2, 3, 4], [5, 6, 0, 0]]
    assert structural.windows(six, 4).collect() == [[1, 2, 3, 4], [2, 3, 4, 5], [3, 4, 5, 6]]
    assert structural.rotate(six, 2).collect() == [3, 4, 5, 6, 1, 2]
    assert structural.shift_before(six, e.literal([8, 9])).collect() == [8, 9, 1, 2, 3, 4]
    assert structural.shift_after(six).collect() == [2, 3, 4, 5, 6, 0]
    m = structural.reshape(six, 2, 3)
    assert structural.transpose(m).collect() == [[1, 4], [2, 5], [3, 6]]
    assert structural.reorder(structural.reshape(six, 2, 3), 0, 0).collect() == [1, 5]
    assert structural.concat(m, e.literal([7, 8, 9])).collect() == [[1, 2, 3], [4, 5, 6], [7, 8, 9]]
    assert structural.prefixes(e.literal([1, 2])).collect() == [[], [1], [1, 2]]
    assert structural.suffixes(e.literal([1, 2])).collect() == [[1, 2], [2], []]
    assert structural.merge(structural.enclose_cells(m), 3).collect() == m.collect()


def test_shapes_that_must_not_agree(e):
    a, b = e.iota(3), e.iota(4)
    with pytest.raises(ShapeError):
        pervasive.zip_with(num.add, a, b)
    with pytest.raises(ShapeError):
        structural.couple(a, b)
    with pytest.raises(RankError):
        fold.fold("add", e.iota(2, 3))
    with pytest.raises(DomainError):
        search.bins(e.literal([5, 6, 2]), a)
    with pytest.raises(DomainError):
        selection.replicate(-2, a)
    with pytest.raises(ShapeError):
        structural.windows(a, 5)
    with pytest.raises(FillError):
        structural.take(structural.enclose_cells(e.iota(2, 2)), 3)


def test_scalar_edges(e):
    inf, nan = math.inf, math.nan
    x = e.literal([0.0, -0.0, inf, -inf, nan, 1e300, -7.0, 2.5])
    assert x.map(num.reciprocal).collect()[:4] == [inf, inf, 0, 0]
    floor = x.map(num.floor).collect()
    assert floor[2] == inf and math.isnan(floor[4]) and floor[5] == 1e300 and floor[7] == 2
    assert x.map(num.sign).collect()[4] == -1
    assert x.map(lambda v: num.modulus(-3.0, v)).collect()[6:] == [-1, -0.5]
    assert math.isnan(x.map(lambda v: num.modulus(0.0, v)).collect()[6])
    assert math.isnan(x.map(lambda v: num.minimum(v, 1.0)).collect()[4])
    assert x.map(num.ln).collect()[0] == -inf and math.isnan(x.map(num.ln).collect()[6])
    assert x.map(lambda v: num.equal(v, v)).collect() == [1, 1, 1, 1, 0, 1, 1, 1]
    assert x.map(lambda v: num.divide(v, 0.0)).collect()[6] == -inf


@pytest.mark.parametrize("parts", [1, 3, 8])
def test_lookups_against_a_model(e, parts):
    rng = np.random.default_rng(parts)
    w, x = rng.integers(0, 9, 40).astype(float), rng.integers(0, 12, 50).astype(float)
    W, X = (a.with_df(a.df.repartition(parts)) for a in (e.literal(w.tolist()), e.literal(x.tolist())))
    first = [next((k for k, v in enumerate(w) if v == y), len(w)) for y in x]
    assert search.index_of(W, X).collect() == first
    left = {v: [k for k, u in enumerate(w) if u == v] for v in w}
    assert search.progressive_index_of(W, X).collect() == [left[y].pop(0) if left.get(y) else len(w) for y in x]
    assert search.member(X, W).collect() == [float(y in w) for y in x]
    assert search.bins(order.sort(W), X).collect() == [float((w <= y).sum()) for y in x]
    assert search.bins(order.sort(W, True), X, up=False).collect() == [float((w >= y).sum()) for y in x]
    assert sets.unique(X).collect() == list(dict.fromkeys(x))
    assert sets.without(X, W).collect() == [y for y in x if y not in w]
    assert scan.occurrence(X).collect() == [float(list(x[:k]).count(y)) for k, y in enumerate(x)]
    assert scan.classify(X).collect() == [float(list(dict.fromkeys(x)).index(y)) for y in x]
    assert scan.mark_firsts(X).collect() == [float(y not in x[:k]) for k, y in enumerate(x)]
    assert order.grade(X).collect() == np.argsort(x, kind="stable").tolist()
    assert order.grade(X, True).collect() == np.argsort(-x, kind="stable").tolist()
    assert order.top(X, 5).collect() == sorted(x, reverse=True)[:5]


def test_not_a_number_matches_nothing(e):
    x = e.literal([math.nan, 0.0, -0.0, math.nan])
    assert search.index_of(x, x).collect() == [4, 1, 1, 4]
    assert scan.mark_firsts(x).collect() == [1, 1, 0, 1]
    assert not pervasive.match(x, x) and pervasive.match(e.literal([0.0]), e.literal([-0.0]))


def test_folds_and_scans(e, spark):
    x = e.literal([1, 2, 3, 4])
    assert fold.fold("subtract", x) == -2 and fold.fold("divide", x) == 0.375 and fold.fold("subtract", x, 10.0) == 8
    assert fold.fold("multiply", e.iota(0)) == 1 and fold.fold("minimum", e.iota(0)) == math.inf
    assert math.isnan(fold.fold("maximum", e.literal([1, math.nan])))
    m = e.literal([[1, 2], [3, 4], [5, 6]])
    assert fold.insert("add", m).collect() == [9, 12] and fold.insert("subtract", m).collect() == [3, 4]
    assert fold.insert("multiply", structural.take(m, 0)).collect() == [1, 1]
    assert fold.fold_rows("add", m).collect() == [3, 7, 11]
    assert scan.scan("add", m).collect() == [[1, 2], [4, 6], [9, 12]]
    assert scan.unscan(scan.scan("add", x)).collect() == [1, 2, 3, 4]
    from lattica.plans.index import running

    long = spark.range(1000).select(F.col("id").alias("i0"), (F.col("id") % 7).cast("double").alias("v"))
    got = [r.v for r in running(long, "i0", "v", "sum", block=64).orderBy("i0").collect()]
    assert got == np.cumsum(np.arange(1000) % 7).tolist()
    assert scan.window_fold("maximum", e.literal([3, 1, 2, 5, 4]), 2).collect() == [3, 2, 5, 5]
    groups = fold.group_places(e.literal([0, 3, 3, -1])).orderBy("g").collect()
    assert [list(r.places) for r in groups] == [[0], [], [], [1, 2]]
    assert fold.group_lengths(e.literal([0, 3, 3, -1]), 6).collect() == [1, 0, 0, 2, 0, 0]
    assert selection.counts_of(e.literal([2, 3, 1, 1])).collect() == [0, 2, 1, 1]


def test_folds_by_a_users_function(e):
    rng = np.random.default_rng(6)
    v = rng.integers(0, 9, 500).astype(float).tolist()
    x = e.literal(v)
    x = x.with_df(x.df.repartition(5))
    last = lambda a, b: F.when(b >= 7, b).otherwise(a)
    want = next((y for y in reversed(v) if y >= 7), v[0])
    assert [fold.fold_associative(last, x, block).first()["v"] for block in (3, 64, 4096)] == [want] * 3
    assert fold.fold_associative(lambda a, b: a + b, x, 7).first()["v"] == sum(v)
    assert fold.fold_associative(lambda a, b: a + b, e.literal([5])).first()["v"] == 5
    assert fold.fold_associative(lambda a, b: a + b, e.iota(0)).first()["v"] is None


def test_order_of_nested_arrays(e, spark):
    rng = np.random.default_rng(7)
    lists = [rng.integers(0, 3, rng.integers(0, 4)).astype(float).tolist() for _ in range(80)]
    df = spark.createDataFrame(list(enumerate(lists)), "i0 long, cell array<double>").repartition(3)
    up = sorted(range(80), key=lambda k: (lists[k], k))
    down = sorted(up, key=lambda k: lists[k], reverse=True)
    assert order.grade_nested(df).collect() == up and order.grade_nested(df, down=True).collect() == down
    assert [list(r.cell) for r in order.sort_nested(df).orderBy("i0").collect()] == [lists[k] for k in up]
    deep = spark.createDataFrame([(0, [[2.0], [1.0]]), (1, [[2.0]]), (2, [[], [9.0]]), (3, [[2.0], []])], "i0 long, cell array<array<double>>")
    assert order.grade_nested(deep).collect() == [2, 1, 3, 0]
    # the same elements: the atom, the list of one, the table of one; a letter after every number
    rows = [(0, "a", True, [1]), (1, "7", False, [1, 1]), (2, "7", False, []), (3, "7", False, [1]), (4, "900", False, [1])]
    mixed = spark.createDataFrame(rows, "i0 long, t string, c boolean, shape array<long>")
    cell = F.array(order.atom(F.when(F.col("c"), F.ascii("t")).otherwise(F.expr("try_cast(t AS double)")), F.col("c")))
    assert order.grade_nested(mixed.select("i0", "shape", cell.alias("cell"))).collect() == [2, 3, 1, 4, 0]
    assert order.grade_nested(df.limit(0)).collect() == []


def test_depth_and_formats(e, spark):
    from lattica.functions import library

    m = e.iota(2, 3)
    assert (structural.depth_of(m), structural.depth_of(structural.enclose_cells(m))) == (1, 2)
    df = spark.createDataFrame([([1.0, -2.5, math.inf],), ([],), (None,)], "x array<double>")
    assert [r[0] for r in df.select(library.format_list(F.col("x"))).collect()] == ["⟨ 1 ¯2.5 ∞ ⟩", "⟨⟩", None]
    assert c.left(1, 2) == 1 and c.right(1, 2) == 2 and c.right(3) == 3


def test_selection(e):
    x = e.literal([10, 20, 30])
    assert selection.indices(e.literal([0, 2, 1])).collect() == [1, 1, 2]
    assert selection.replicate(e.literal([2, 0, 1]), x).collect() == [10, 10, 30]
    assert selection.replicate(2, x).collect() == [10, 10, 20, 20, 30, 30] and selection.replicate(0, x).collect() == []
    assert selection.select(e.literal([[-1, 0], [1, 1]]), x).collect() == [[30, 10], [20, 20]]
    with pytest.raises(Exception, match="out of range"):
        selection.select(e.literal([3]), x).collect()
    assert selection.pick(e.literal([[1, 2], [3, 4]]), 1, -1) == 4
    assert search.find_cells(e.literal([1, 2]), e.literal([1, 2, 1, 2, 2])).collect() == [1, 0, 1, 0]


def test_under(e):
    squares, triple = e.literal([0, 1, 4, 9, 16, 25]), lambda p: p.map(lambda v: v * 3)
    assert c.under_take(structural.reverse, squares, -4).collect() == [0, 1, 25, 16, 9, 4]
    assert c.under_take(triple, squares, 2).collect() == [0, 3, 4, 9, 16, 25]
    assert c.under_drop(triple, squares, -4).collect() == [0, 3, 4, 9, 16, 25]
    assert c.under_filter(structural.reverse, e.literal([1, 0, 1, 1, 0, 1]), squares).collect() == [25, 1, 9, 4, 16, 0]
    with pytest.raises(ShapeError):
        c.under_places(triple, squares, e.literal([4, 4]))


def test_combinators(e):
    double, half = lambda v: v * 2, lambda v: v / 2
    assert c.repeat_each(double, [2, [4, -2, 1]], half)(1) == [4, [16, 0.25, 2]]
    assert c.fork(lambda x: x + 1, lambda a, b: a * b, lambda x: x - 1)(5) == 24
    assert c.before(3, lambda a, b: a - b)(1) == 2 and c.after(lambda a, b: a - b, 3)(1) == -2
    assert c.valences(lambda x: "one", lambda w, x: "two")(1, 2) == "two"
    assert c.catch(lambda x: 1 / x, lambda x: "caught")(0) == "caught"
    assert c.choose(lambda x: x > 2, [lambda x: "low", lambda x: "high"])(3) == "high"


def test_matmul(e):
    rng = np.random.default_rng(1)
    a, b = rng.integers(-9, 9, (20, 15)).astype(float), rng.integers(-9, 9, (15, 9)).astype(float)
    A, B = e.literal(a.tolist()), e.literal(b.tolist())
    want = (a @ b).tolist()
    assert linalg.matmul(A, B).collect() == want and linalg.matmul_sparse(A, B).collect() == want
    assert linalg.matmul(structural.take(A, 2, 0), structural.take(B, 0, 3)).collect() == [[0, 0, 0], [0, 0, 0]]


def test_text_and_maps(spark, e):
    from lattica.functions import library, maps

    df = spark.createDataFrame([(1, "aé日🙂"), (2, "")], "i long, t string")
    out = df.select(library.shift_chars(F.col("t"), 1), library.from_utf8(library.to_utf8(F.col("t"))), library.code_points(F.col("t"))).collect()
    assert tuple(out[0]) == ("bê旦🙃", "aé日🙂", [97, 233, 26085, 128578]) and tuple(out[1]) == ("", "", [])
    assert [library.number_text(v) for v in (1.0, -2.5, math.inf, 1e15, 1e-5, 0.5)] == ["1", "¯2.5", "∞", "1e15", "1e¯5", "0.5"]
    rows = spark.createDataFrame([(0, "a", 1), (1, "b", 2)], "seq long, k string, v long")
    m = maps.HashMap.of(rows, "seq", "k", "v").set(spark.createDataFrame([(0, "b", 5), (1, "c", 6)], "seq long, k string, v long"))
    assert [(r.k, r.v) for r in m.df.orderBy("seq").collect()] == [("a", 1), ("b", 5), ("c", 6)]
    with pytest.raises(DomainError):
        maps.HashMap.of(rows.union(rows), "seq", "k", "v")


def test_counts_in_blocks_of_one_key(spark):
    from lattica.plans.index import nth, running

    rng = np.random.default_rng(8)
    rows = [(i, int(k) or None, float(v)) for i, (k, v) in enumerate(zip(rng.choice(4, 500, p=[0.7, 0.1, 0.1, 0.1]), rng.integers(-9, 9, 500), strict=True))]
    df = spark.createDataFrame(rows, "p long, k int, v double").repartition(5)
    seen, total, count, want = {}, {}, {}, {}
    for p, k, v in rows:
        total[k] = total.get(k, 0) + v
        want[p] = (total[k], seen.get(k, 0))
        seen[k] = seen.get(k, 0) + 1
    for r in running(df, "p", "v", "sum", block=7, keys=["k"]).collect():
        count[r.p] = r.v
    assert count == {p: a for p, (a, _) in want.items()}
    assert {r.p: r.n for r in nth(df, ["k"], "p", "n").collect()} == {p: b for p, (_, b) in want.items()}
    assert {r.p: r.n for r in nth(df, ["k"], "p", "n", 500).collect()} == {p: b for p, (_, b) in want.items()}
    assert running(df.limit(0), "p", "v", "max", keys=["k"]).count() == 0
