"""Structural operators, selection, lookups, folds, scans, sorting and sets over lists and matrices."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lattica.darray import DArray, Engine
from lattica.functions import numeric as num
from lattica.operators import combinators, fold, order, scan, search, selection, sets, structural
from lattica.queries.registry import query, rounded, table, users, values, vectors
from lattica.sources import files

_N = "(SELECT count(*) FROM events)"
_V = "(SELECT vec_id, k - 1 AS k, CAST(x AS DOUBLE) AS x FROM (SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS k FROM embeddings))"


def part(spark, d, test: str, value="value") -> DArray:
    """The events that pass a test, as a list."""
    return Engine(spark).array(table(spark, d, "events").where(test), ["event_id"], F.col(value).cast("double"))


# sources


@query("SELECT i AS i0, CAST(i AS DOUBLE) AS v FROM range(100000) t(i)")
def iota(spark, d):
    return Engine(spark).iota(100_000).df


@query("SELECT i AS i0, j AS i1, CAST(i * 70 + j AS DOUBLE) AS v FROM range(300) a(i), range(70) b(j)")
def iota_matrix(spark, d):
    return Engine(spark).iota(300, 70).df


@query("SELECT * FROM (VALUES (0, 0, 1.0::DOUBLE), (0, 1, 2.0), (1, 0, 3.0), (1, 1, 4.0)) t(i0, i1, v)")
def literal(spark, d):
    return Engine(spark).literal([[1, 2], [3, 4]]).df


def _names(spark, d) -> str:
    """A folder of its own, shared by driver and executors, with the names of regions as a file of lines."""
    from lattica.plans.index import ensure_checkpoint_dir

    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/lines-{uuid.uuid4().hex}"
    files.write_lines(table(spark, d, "region").orderBy("r_regionkey").coalesce(1), "r_name", folder)
    return folder


@query("SELECT r_regionkey AS i0, r_name AS line FROM region")
def file_lines(spark, d):
    return files.lines(spark, _names(spark, d))


@query("SELECT string_agg(r_name || chr(10), '' ORDER BY r_regionkey) AS t FROM region")
def file_chars(spark, d):
    return spark.createDataFrame([(files.chars(spark, f"{_names(spark, d)}/part-*"),)], "t string")


@query("SELECT sum(strlen(r_name) + 1) AS n, md5(string_agg(r_name || chr(10), '' ORDER BY r_regionkey)) AS digest FROM region")
def file_bytes(spark, d):
    return files.map_bytes(spark, f"{_names(spark, d)}/part-*").select(F.col("length").alias("n"), F.md5("content").alias("digest"))


@query("SELECT 1 AS files, sum(strlen(r_name) + 1) AS bytes FROM region")
def file_list(spark, d):
    found = files.files_in(spark, _names(spark, d)).where("name like 'part-%'")
    return found.agg(F.count("*").alias("files"), F.sum("length").alias("bytes"))


@query("SELECT true AS same, true AS moved")
def make_rand(spark, d):
    """Two generators of one seed give the same lists; a generator's lists differ from each other."""
    a, b = files.Rand(spark, 7), files.Rand(spark, 7)
    first, second = a.range(1000, 50).df, a.range(1000, 50).df
    again = b.range(1000, 50).df
    both = first.join(again.withColumnRenamed("v", "w"), "i0").join(second.withColumnRenamed("v", "x"), "i0")
    return both.agg(F.every(F.col("v") == F.col("w")).alias("same"), F.some(F.col("v") != F.col("x")).alias("moved"))


@query("SELECT count(*) AS n, count(DISTINCT i) AS u, min(i) AS low, max(i) AS high FROM range(20000) t(i)")
def deal(spark, d):
    x = files.deal(spark, 20_000, 42).df
    return x.agg(F.count("*").alias("n"), F.countDistinct("v").alias("u"), F.min("v").cast("long").alias("low"), F.max("v").cast("long").alias("high"))


@query("SELECT 10000 AS n, 6 AS u, 0.0::DOUBLE AS low, 5.0::DOUBLE AS high")
def random_range(spark, d):
    return files.random_range(spark, 10_000, 6, 42).df.agg(F.count("*").alias("n"), F.countDistinct("v").alias("u"), F.min("v").alias("low"), F.max("v").alias("high"))


@query("SELECT 100 AS n, 100 AS u, true AS inside")
def random_subset(spark, d):
    return files.subset(spark, 100, 10_000, 42).df.agg(F.count("*").alias("n"), F.countDistinct("v").alias("u"), F.every((F.col("v") >= 0) & (F.col("v") < 10_000)).alias("inside"))


# structural


@query("SELECT vec_id * 64 + k AS i0, x AS v FROM " + _V)
def deshape(spark, d):
    return structural.deshape(vectors(spark, d)).df


@query("SELECT (vec_id * 64 + k) // 32 AS i0, (vec_id * 64 + k) % 32 AS i1, x AS v FROM " + _V)
def reshape(spark, d):
    return structural.reshape(vectors(spark, d), "exact", 32).df


@query(f"SELECT i // 3 AS i0, i % 3 AS i1, value AS v FROM (SELECT event_id + {_N} * r AS i, value FROM events, range(3) t(r)) WHERE i < {_N} * 2 + 700 - ({_N} * 2 + 700) % 3")
def reshape_cycle(spark, d):
    x = values(spark, d)
    return structural.reshape(x, (2 * x.shape[0] + 700) // 3, 3).df


@query(f"SELECT i // 7 AS i0, i % 7 AS i1, coalesce(value, 0) AS v FROM range((({_N} + 6) // 7) * 7) t(i) LEFT JOIN events ON event_id = i")
def reshape_pad(spark, d):
    return structural.reshape(values(spark, d), "pad", 7).df


@query(f"SELECT event_id AS i0, value AS v FROM events UNION ALL SELECT event_id + {_N}, -value FROM events")
def concat(spark, d):
    return structural.concat(values(spark, d), values(spark, d).map(num.negate)).df


@query("SELECT 0 AS i0, event_id AS i1, value AS v FROM events UNION ALL SELECT 1, event_id, -value FROM events")
def couple(spark, d):
    return structural.couple(values(spark, d), values(spark, d).map(num.negate)).df


@query("SELECT 0 AS i0, vec_id AS i1, k AS i2, x AS v FROM " + _V)
def solo(spark, d):
    return structural.couple(vectors(spark, d)).df


@query("SELECT vec_id AS i0, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings")
def enclose_cells(spark, d):
    return structural.enclose_cells(vectors(spark, d)).df


@query("SELECT vec_id AS i0, k AS i1, x AS v FROM " + _V)
def merge_cells(spark, d):
    return structural.merge(structural.enclose_cells(vectors(spark, d)), 64).df


@query("SELECT n AS i0, list_transform(range(n), lambda i: CAST(i AS DOUBLE)) AS v FROM range(31) t(n)")
def prefixes(spark, d):
    return structural.prefixes(Engine(spark).iota(30)).df


@query("SELECT n AS i0, list_transform(range(n, 30), lambda i: CAST(i AS DOUBLE)) AS v FROM range(31) t(n)")
def suffixes(spark, d):
    return structural.suffixes(Engine(spark).iota(30)).df


@query("SELECT event_id AS i0, value AS v FROM events WHERE event_id < 500")
def take(spark, d):
    return structural.take(values(spark, d), 500).df


@query(f"SELECT event_id - {_N} + 500 AS i0, value AS v FROM events WHERE event_id >= {_N} - 500")
def take_last(spark, d):
    return structural.take(values(spark, d), -500).df


@query(f"SELECT i AS i0, coalesce(value, 0) AS v FROM range({_N} + 50) t(i) LEFT JOIN events ON event_id = i - 50")
def take_pads(spark, d):
    x = values(spark, d)
    return structural.take(x, -(x.shape[0] + 50)).df


@query("SELECT vec_id AS i0, k - 60 AS i1, x AS v FROM " + _V + " WHERE vec_id < 9 AND k >= 60")
def take_axes(spark, d):
    return structural.take(vectors(spark, d), 9, -4).df


@query("SELECT event_id - 500 AS i0, value AS v FROM events WHERE event_id >= 500")
def drop(spark, d):
    return structural.drop(values(spark, d), 500).df


@query(f"SELECT event_id AS i0, value AS v FROM events WHERE event_id < {_N} - 500")
def drop_last(spark, d):
    return structural.drop(values(spark, d), -500).df


@query(f"SELECT event_id - k AS i0, k AS i1, value AS v FROM events, range(3) t(k) WHERE event_id >= k AND event_id - k <= {_N} - 3")
def windows(spark, d):
    return structural.windows(values(spark, d), 3).df


@query("SELECT event_id AS i0, coalesce(lag(value) OVER (ORDER BY event_id), 0) AS v FROM events")
def shift_before(spark, d):
    return structural.shift_before(values(spark, d)).df


@query("SELECT event_id AS i0, coalesce(lead(value) OVER (ORDER BY event_id), 0) AS v FROM events")
def shift_after(spark, d):
    return structural.shift_after(values(spark, d)).df


@query("SELECT event_id AS i0, CASE WHEN event_id < 3 THEN 7.0 + event_id ELSE lag(value, 3) OVER (ORDER BY event_id) END AS v FROM events")
def shift_before_cells(spark, d):
    return structural.shift_before(values(spark, d), Engine(spark).literal([7, 8, 9])).df


@query(f"SELECT {_N} - 1 - event_id AS i0, value AS v FROM events")
def reverse(spark, d):
    return structural.reverse(values(spark, d)).df


@query(f"SELECT (event_id - 7 + {_N}) % {_N} AS i0, value AS v FROM events")
def rotate(spark, d):
    return structural.rotate(values(spark, d), 7).df


@query("SELECT (vec_id + 2) % (SELECT count(*) FROM embeddings) AS i0, (k - 5 + 64) % 64 AS i1, x AS v FROM " + _V)
def rotate_axes(spark, d):
    return structural.rotate(vectors(spark, d), -2, 5).df


@query("SELECT k AS i0, vec_id AS i1, x AS v FROM " + _V)
def transpose(spark, d):
    return structural.transpose(vectors(spark, d)).df


@query("SELECT vec_id AS i0, k AS i1, x AS v FROM " + _V)
def untranspose(spark, d):
    return structural.untranspose(structural.transpose(vectors(spark, d))).df


@query("SELECT k AS i0, x AS v FROM " + _V + " WHERE vec_id = k")
def diagonal(spark, d):
    return structural.reorder(vectors(spark, d), 0, 0).df


# selection


@query("SELECT row_number() OVER (ORDER BY event_id, r) - 1 AS i0, CAST(event_id AS DOUBLE) AS v FROM events, range(3) t(r) WHERE r < event_id % 4")
def indices(spark, d):
    return selection.indices(values(spark, d, F.expr("event_id % 4"))).df


@query("SELECT row_number() OVER (ORDER BY event_id) - 1 AS i0, value AS v FROM events WHERE value > 100")
def compress(spark, d):
    return selection.replicate(values(spark, d).map(lambda v: num.greater(v, 100.0)), values(spark, d)).df


@query("SELECT row_number() OVER (ORDER BY event_id, r) - 1 AS i0, value AS v FROM events, range(3) t(r) WHERE r < event_id % 4")
def replicate(spark, d):
    return selection.replicate(values(spark, d, F.expr("event_id % 4")), values(spark, d)).df


@query("SELECT event_id * 2 + r AS i0, value AS v FROM events, range(2) t(r)")
def replicate_all(spark, d):
    return selection.replicate(2, values(spark, d)).df


@query("SELECT g AS i0, CAST(count(p_size) AS DOUBLE) AS v FROM (SELECT unnest(range(0, (SELECT max(p_size) + 1 FROM part))) g) LEFT JOIN part ON p_size = g GROUP BY g")
def counts_of(spark, d):
    return selection.counts_of(Engine(spark).array(table(spark, d, "part"), ["p_partkey"], "p_size")).df


@query("SELECT k AS i0, x AS v FROM " + _V + " WHERE vec_id = 0")
def first_cell(spark, d):
    return selection.first_cell(vectors(spark, d)).df


@query(f"SELECT a.event_id AS i0, b.value AS v FROM events a JOIN events b ON b.event_id = CASE WHEN a.event_id % 2 = 0 THEN (a.event_id * 7) % {_N} ELSE {_N} - 1 - a.event_id END")
def select_cells(spark, d):
    x = values(spark, d)
    at = values(spark, d, F.expr(f"CASE WHEN event_id % 2 = 0 THEN (event_id * 7) % {x.shape[0]} ELSE -1 - event_id END"))
    return selection.select(at, x).df


@query("SELECT w.event_id AS i0, k AS i1, x AS v FROM events w JOIN " + _V + " ON vec_id = w.user_id % (SELECT count(*) FROM embeddings)")
def select_rows(spark, d):
    """A row for every event."""
    rows = vectors(spark, d)
    return selection.select(values(spark, d, F.expr(f"user_id % {rows.shape[0]}")), rows).df


@query("SELECT max(CASE WHEN vec_id = 5 AND k = 63 THEN x END) AS v FROM " + _V)
def pick(spark, d):
    return spark.createDataFrame([(selection.pick(vectors(spark, d), 5, -1),)], "v double")


@query("SELECT event_id AS i0, 1.0::DOUBLE AS v FROM events")
def assert_ones(spark, d):
    return selection.assert_ones(values(spark, d).map(lambda v: num.at_least(v, 0.0))).df


# lookups


@query("WITH w AS (SELECT user_id, min(event_id) // 2 AS p FROM events WHERE event_id % 2 = 0 GROUP BY 1) SELECT event_id // 2 AS i0, CAST(coalesce(p, (SELECT count(*) FROM events WHERE event_id % 2 = 0)) AS DOUBLE) AS v FROM events LEFT JOIN w USING (user_id) WHERE event_id % 2 = 1")
def index_of(spark, d):
    return search.index_of(part(spark, d, "event_id % 2 = 0", "user_id"), part(spark, d, "event_id % 2 = 1", "user_id")).df


@query("WITH w AS (SELECT p_size % 9 AS a, length(p_brand) AS b, min(p_partkey) AS p FROM part GROUP BY 1, 2), n AS (SELECT p_partkey, row_number() OVER (ORDER BY p_partkey) - 1 AS i FROM part) SELECT n.i AS i0, CAST(m.i AS DOUBLE) AS v FROM part JOIN n USING (p_partkey) JOIN w ON a = p_size % 9 AND b = length(p_brand) JOIN n m ON m.p_partkey = w.p")
def index_of_rows(spark, d):
    parts = table(spark, d, "part")
    a = Engine(spark).array(parts, ["p_partkey"], F.expr("p_size % 9"))
    b = Engine(spark).array(parts, ["p_partkey"], F.length("p_brand"))
    rows = structural.transpose(structural.couple(a, b))
    return search.index_of(rows, rows).df


@query("WITH n AS (SELECT *, event_id % 2 AS side, row_number() OVER (PARTITION BY event_type, event_id % 2 ORDER BY event_id) AS o FROM events) SELECT x.event_id // 2 AS i0, CAST(coalesce(w.event_id // 2, (SELECT count(*) FROM events WHERE event_id % 2 = 0)) AS DOUBLE) AS v FROM (SELECT * FROM n WHERE side = 1) x LEFT JOIN (SELECT * FROM n WHERE side = 0) w USING (event_type, o)")
def progressive_index_of(spark, d):
    code = F.crc32("event_type").cast("double")
    e = table(spark, d, "events")
    w, x = (Engine(spark).array(e.where(f"event_id % 2 = {k}"), ["event_id"], code) for k in (0, 1))
    return search.progressive_index_of(w, x).df


@query("SELECT event_id AS i0, CAST(user_id IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0) AS INTEGER) * 1.0::DOUBLE AS v FROM events")
def member(spark, d):
    return search.member(users(spark, d), Engine(spark).array(table(spark, d, "customer").where("c_acctbal < 0"), ["c_custkey"], "c_custkey")).df


@query("SELECT event_id AS i0, CAST((SELECT count(*) FROM (VALUES (10.0), (50.0), (50.0), (100.0), (200.0)) b(e) WHERE e <= value) AS DOUBLE) AS v FROM events")
def bins_up(spark, d):
    return search.bins(Engine(spark).literal([10, 50, 50, 100, 200]), values(spark, d)).df


@query("SELECT event_id AS i0, CAST((SELECT count(*) FROM (VALUES (200.0), (100.0), (50.0), (10.0)) b(e) WHERE e >= value) AS DOUBLE) AS v FROM events")
def bins_down(spark, d):
    return search.bins(Engine(spark).literal([200, 100, 50, 10]), values(spark, d), up=False).df


@query("WITH p AS (SELECT event_id, ts FROM events WHERE event_type = 'purchase'), e AS (SELECT event_id, ts FROM events WHERE event_type = 'error') SELECT p.event_id, e.event_id AS e_id FROM p ASOF JOIN e ON p.ts >= e.ts")
def asof(spark, d):
    """The latest error at or before each purchase."""
    e = table(spark, d, "events").withColumn("t", F.unix_micros(F.col("ts").cast("timestamp")))
    errors = e.where("event_type = 'error'").select("t", F.col("event_id").alias("e_id"))
    return search.asof(errors, e.where("event_type = 'purchase'").select("event_id", "t"), "t").select("event_id", "e_id")


@query("SELECT event_id AS i0, CAST(value >= 50 AND value < 200 AS INTEGER) * 1.0::DOUBLE AS v FROM events")
def interval(spark, d):
    return search.bins(Engine(spark).literal([50, 200]), values(spark, d)).map(lambda v: num.equal(v, 1.0)).df


@query("SELECT a.s AS i0, b.s AS i1, CAST((a.s + 1) * (b.s + 1) AS DOUBLE) AS v FROM range(200) a(s), range(150) b(s)")
def table_times(spark, d):
    from lattica.operators import pervasive

    e = Engine(spark)
    return pervasive.table(num.multiply, e.iota(200).map(lambda v: v + 1), e.iota(150).map(lambda v: v + 1)).df


@query(
    "WITH p AS (SELECT doc_id, length(piece) + 3 AS n, k FROM (SELECT doc_id, unnest(string_split(text, 'the')) AS piece, generate_subscripts(string_split(text, 'the'), 1) AS k FROM documents)), "
    "q AS (SELECT doc_id, sum(n) OVER (PARTITION BY doc_id ORDER BY k) - 3 AS place, k = max(k) OVER (PARTITION BY doc_id) AS last FROM p), "
    "h AS (SELECT doc_id, count(*) AS hits, CAST(sum(place) AS BIGINT) AS places FROM q WHERE NOT last GROUP BY doc_id) "
    "SELECT doc_id, CAST(CASE WHEN text IS NOT NULL THEN greatest(length(text) - 2, 0) END AS BIGINT) AS n, CASE WHEN text IS NOT NULL THEN coalesce(hits, 0) END AS hits, CASE WHEN text IS NOT NULL THEN coalesce(places, 0) END AS places FROM documents LEFT JOIN h USING (doc_id)"
)
def find_text(spark, d):
    """Of the flags of every whole text their number, the number of ones and the sum of their places."""
    flags = table(spark, d, "documents").select("doc_id", search.find("the", F.col("text")).alias("flags"))
    total = lambda x: F.aggregate(x, F.lit(0).cast("long"), lambda a, v: a + v)
    return flags.select("doc_id", F.when(F.col("flags").isNotNull(), F.size("flags")).cast("long").alias("n"), total(F.col("flags")).alias("hits"), total(F.transform("flags", lambda v, k: v.cast("long") * k)).alias("places"))


@query("SELECT a.event_id AS i0, CAST(a.user_id % 3 = 1 AND b.user_id % 3 = 2 AS INTEGER) * 1.0::DOUBLE AS v FROM events a JOIN events b ON b.event_id = a.event_id + 1")
def find_cells(spark, d):
    return search.find_cells(Engine(spark).literal([1, 2]), users(spark, d).map(lambda v: num.modulus(3.0, v))).df


# folds


@query("SELECT round(sum(value), 2) AS add, round(sum(ln(value)), 6) AS logs, min(value) AS minimum, max(value) AS maximum, max(CAST(value > 490 AS INTEGER)) * 1.0::DOUBLE AS either, min(CAST(value > 0 AS INTEGER)) * 1.0::DOUBLE AS both, round(sum(value * (1 - 2 * (event_id % 2))), 4) AS subtract FROM events")
def folds(spark, d):
    x = values(spark, d)
    v = F.col("v")
    # one pass: every fold aggregates its own column
    made = {"add": ("add", v, 2), "logs": ("add", num.ln(v), 6), "minimum": ("minimum", v, None), "maximum": ("maximum", v, None), "either": ("either", num.greater(v, 490.0), None), "both": ("both", num.greater(v, 0.0), None), "subtract": ("subtract", v, 4)}
    return fold.folds_frame({name: (how, of) for name, (how, of, _) in made.items()}, x).select(*((F.col(name) if digits is None else F.round(name, digits)).alias(name) for name, (_, _, digits) in made.items()))


@query("SELECT round(exp(sum(ln(1 + value / 1e6) * (1 - 2 * (event_id % 2)))), 6) AS v FROM events")
def fold_divide(spark, d):
    return rounded(fold.fold_frame("divide", values(spark, d, F.lit(1) + F.col("value") / 1e6)), 6)


@query("SELECT round(exp(sum(ln(1 + value / 1e6))) - 1, 6) AS v FROM events")
def fold_associative(spark, d):
    return rounded(fold.fold_associative(lambda a, b: a + b + a * b, values(spark, d, F.col("value") / 1e6)), 6)


@query("SELECT coalesce(arg_max(value, event_id) FILTER (value >= 50), arg_min(value, event_id)) AS v FROM events")
def fold_last(spark, d):
    """A fold that depends on the order: the last large value, else the first of all."""
    return fold.fold_associative(lambda a, b: F.when(b >= 50, b).otherwise(a), values(spark, d))


@query("SELECT round(sum(value) + 10, 2) AS v FROM events")
def fold_seeded(spark, d):
    return spark.createDataFrame([(round(fold.fold("add", values(spark, d), 10.0), 2),)], "v double")


@query("SELECT 0.0::DOUBLE AS add, 1.0::DOUBLE AS multiply, CAST('inf' AS DOUBLE) AS minimum, CAST('-inf' AS DOUBLE) AS maximum")
def fold_identities(spark, d):
    none = Engine(spark).iota(0)
    names = ["add", "multiply", "minimum", "maximum"]
    return spark.createDataFrame([tuple(fold.fold(n, none) for n in names)], ", ".join(f"{n} double" for n in names))


@query("SELECT k AS i0, round(sum(x), 4) + 0 AS v FROM " + _V + " GROUP BY k")
def insert_add(spark, d):
    return rounded(fold.insert("add", vectors(spark, d)))


@query("SELECT vec_id AS i0, round(sum(x * x), 3) AS v FROM " + _V + " GROUP BY vec_id")
def row_dot(spark, d):
    return rounded(fold.fold_rows("add", vectors(spark, d).map(lambda v: v * v)), 3)


@query("SELECT vec_id, round(list_reduce(list_reverse(list_transform(embedding, lambda x: CAST(x AS DOUBLE))), lambda a, b: b - a), 6) + 0 AS v FROM embeddings")
def fold_cells(spark, d):
    cells = F.transform("embedding", lambda x: x.cast("double"))
    return table(spark, d, "embeddings").select("vec_id", (F.round(fold.fold_cells(lambda a, b: a - b, cells), 6) + 0.0).alias("v"))


@query("SELECT count(*) AS n, count(DISTINCT user_id) AS u FROM events")
def counts(spark, d):
    x = users(spark, d)
    return spark.createDataFrame([(x.shape[0], fold.count_distinct(x))], "n long, u long")


@query("SELECT g, list(event_id ORDER BY event_id) FILTER (event_id IS NOT NULL) AS places FROM range((SELECT max(user_id % 40) + 1 FROM events)) t(g) LEFT JOIN events ON user_id % 40 = g AND user_id % 40 <> 7 GROUP BY g HAVING g <> 7 UNION ALL SELECT 7, []")
def group_places(spark, d):
    return fold.group_places(values(spark, d, F.expr("CASE WHEN user_id % 40 = 7 THEN -1 ELSE user_id % 40 END")))


@query("SELECT g, list(value ORDER BY event_id) AS cells FROM (SELECT user_id % 40 AS g, * FROM events) GROUP BY g")
def group_cells(spark, d):
    return fold.group_cells(values(spark, d, F.expr("user_id % 40")), values(spark, d))


@query("SELECT g AS i0, CAST(count(p_size) AS DOUBLE) AS v FROM range(80) t(g) LEFT JOIN part ON p_size = g GROUP BY g")
def group_lengths(spark, d):
    return fold.group_lengths(Engine(spark).array(table(spark, d, "part"), ["p_partkey"], "p_size"), 80).df


@query("SELECT row_number() OVER (ORDER BY user_id % 40, event_id) - 1 AS i0, CAST(event_id AS DOUBLE) AS v FROM events")
def group_order(spark, d):
    return order.grade(values(spark, d, F.expr("user_id % 40"))).df


@query("SELECT vec_id, k, round(e / sum(e) OVER (PARTITION BY vec_id), 8) AS v FROM (SELECT vec_id, k, exp(x - max(x) OVER (PARTITION BY vec_id)) AS e FROM " + _V + ")")
def softmax(spark, d):
    x = vectors(spark, d).df.select(F.col("i0").alias("vec_id"), F.col("i1").alias("k"), "v")
    return fold.softmax(x, ["vec_id"], "v").withColumn("v", F.round("v", 8))


@query("SELECT vec_id, [round(y / list_sum(e), 8) FOR y IN e] AS v FROM (SELECT vec_id, [exp(CAST(x AS DOUBLE) - list_max(embedding)) FOR x IN embedding] AS e FROM embeddings)")
def softmax_cells(spark, d):
    made = fold.softmax_cells(F.transform("embedding", lambda x: x.cast("double")))
    return table(spark, d, "embeddings").select("vec_id", F.transform(made, lambda v: F.round(v, 8)).alias("v"))


# scans


@query("SELECT event_id AS i0, round(sum(value) OVER (ORDER BY event_id ROWS UNBOUNDED PRECEDING), 3) AS v FROM events")
def scan_add(spark, d):
    return rounded(scan.scan("add", values(spark, d)), 3)


@query("SELECT event_id AS i0, max(value) OVER (ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS v FROM events")
def scan_maximum(spark, d):
    return scan.scan("maximum", values(spark, d)).df


@query("SELECT event_id AS i0, least(100, min(value) OVER (ORDER BY event_id ROWS UNBOUNDED PRECEDING)) AS v FROM events")
def scan_seeded(spark, d):
    return scan.scan("minimum", values(spark, d), 100.0).df


@query("SELECT vec_id AS i0, k AS i1, round(sum(x) OVER (PARTITION BY k ORDER BY vec_id ROWS UNBOUNDED PRECEDING), 4) + 0 AS v FROM " + _V)
def scan_columns(spark, d):
    return rounded(scan.scan("add", vectors(spark, d)))


@query("SELECT event_id AS i0, round(value - coalesce(lag(value) OVER (ORDER BY event_id), 0), 4) + 0 AS v FROM events")
def undo_scan(spark, d):
    return rounded(scan.unscan(values(spark, d)))


@query("SELECT vec_id, [round(list_sum(embedding[1:k]), 4) + 0 FOR k IN range(1, 65)] AS v FROM (SELECT vec_id, [CAST(x AS DOUBLE) FOR x IN embedding] AS embedding FROM embeddings)")
def scan_cells(spark, d):
    made = scan.scan_cells(lambda a, b: a + b, F.transform("embedding", lambda x: x.cast("double")))
    return table(spark, d, "embeddings").select("vec_id", F.transform(made, lambda v: F.round(v, 4) + 0.0).alias("v"))


@query("WITH RECURSIVE o AS (SELECT event_id, user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events), r AS (SELECT event_id, user_id, n, value AS v FROM o WHERE n = 1 UNION ALL SELECT o.event_id, o.user_id, o.n, r.v * 0.3::DOUBLE + o.value FROM r JOIN o ON o.user_id = r.user_id AND o.n = r.n + 1) SELECT event_id, v FROM r")
def scan_general(spark, d):
    made = scan.scan_groups(table(spark, d, "events").select("event_id", "user_id", "value"), ["user_id"], "event_id", "value", lambda a, x: a * 0.3 + x)
    return made.select("event_id", "v")


@query("SELECT event_id - 2 AS i0, m AS v FROM (SELECT event_id, max(value) OVER (ORDER BY event_id ROWS 2 PRECEDING) AS m FROM events) WHERE event_id >= 2")
def window_fold(spark, d):
    return scan.window_fold("maximum", values(spark, d), 3).df


@query("SELECT event_id AS i0, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS DOUBLE) AS v FROM events")
def occurrence(spark, d):
    return scan.occurrence(users(spark, d)).df


@query("WITH f AS (SELECT user_id, min(event_id) AS m FROM events GROUP BY 1), r AS (SELECT user_id, row_number() OVER (ORDER BY m) - 1 AS c FROM f) SELECT event_id AS i0, CAST(c AS DOUBLE) AS v FROM events JOIN r USING (user_id)")
def classify(spark, d):
    return scan.classify(users(spark, d)).df


@query("SELECT event_id AS i0, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) = 1 AS INTEGER) * 1.0::DOUBLE AS v FROM events")
def mark_firsts(spark, d):
    return scan.mark_firsts(users(spark, d)).df


# order


@query("SELECT row_number() OVER (ORDER BY user_id, event_id) - 1 AS i0, CAST(event_id AS DOUBLE) AS v FROM events")
def grade_up(spark, d):
    return order.grade(users(spark, d)).df


@query("SELECT row_number() OVER (ORDER BY user_id DESC, event_id) - 1 AS i0, CAST(event_id AS DOUBLE) AS v FROM events")
def grade_down(spark, d):
    return order.grade(users(spark, d), down=True).df


@query("SELECT row_number() OVER (ORDER BY value) - 1 AS i0, value AS v FROM events")
def sort_up(spark, d):
    return order.sort(values(spark, d)).df


@query("SELECT row_number() OVER (ORDER BY value DESC) - 1 AS i0, value AS v FROM events")
def sort_down(spark, d):
    return order.sort(values(spark, d), down=True).df


@query("WITH r AS (SELECT p_size % 5 AS a, p_partkey % 7 AS b, row_number() OVER (ORDER BY p_size % 5, p_partkey % 7) - 1 AS p FROM part) SELECT p AS i0, 0 AS i1, CAST(a AS DOUBLE) AS v FROM r UNION ALL SELECT p, 1, CAST(b AS DOUBLE) FROM r")
def sort_rows(spark, d):
    parts = table(spark, d, "part")
    a, b = (Engine(spark).array(parts, ["p_partkey"], F.expr(e)) for e in ("p_size % 5", "p_partkey % 7"))
    return order.sort(structural.transpose(structural.couple(a, b))).df


_CELLS = "(SELECT vec_id, [CAST(floor(x * 2) AS DOUBLE) FOR x IN embedding[1:(vec_id % 5)]] AS cell FROM embeddings)"


def _ragged(spark, d):
    cells = F.slice(F.transform("embedding", lambda x: F.floor(x.cast("double") * 2).cast("double")), F.lit(1), F.expr("CAST(vec_id % 5 AS INT)"))
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("i0"), cells.alias("cell"))


@query(f"SELECT row_number() OVER (ORDER BY cell, vec_id) - 1 AS i0, cell FROM {_CELLS}")
def sort_nested(spark, d):
    return order.sort_nested(_ragged(spark, d))


@query(f"SELECT row_number() OVER (ORDER BY cell DESC, vec_id) - 1 AS i0, CAST(vec_id AS DOUBLE) AS v FROM {_CELLS}")
def grade_nested_down(spark, d):
    return order.grade_nested(_ragged(spark, d), down=True).df


_MIXED = "[CASE WHEN x < 0 THEN 1000 + ascii(event_type) ELSE x END FOR x IN [user_id % 3 - 1.0::DOUBLE, event_id % 2 - 1.0::DOUBLE]]"


@query(f"SELECT row_number() OVER (ORDER BY {_MIXED}, (event_id % 4 = 0), event_id) - 1 AS i0, CAST(event_id AS DOUBLE) AS v FROM events")
def grade_mixed(spark, d):
    """Numbers before characters, and a table after a list of the same elements."""
    letter = F.ascii("event_type")
    items = F.transform(F.array(F.expr("user_id % 3 - 1"), F.expr("event_id % 2 - 1")), lambda x: order.atom(F.when(x < 0, letter).otherwise(x), x < 0))
    shape = F.when(F.expr("event_id % 4 = 0"), F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(2)))
    return order.grade_nested(table(spark, d, "events").select(F.col("event_id").alias("i0"), items.alias("cell"), shape.alias("shape"))).df


@query("SELECT event_id AS i0, CAST(row_number() OVER (ORDER BY user_id, event_id) - 1 AS DOUBLE) AS v FROM events")
def ranks(spark, d):
    return order.ranks(users(spark, d)).df


@query("SELECT row_number() OVER (ORDER BY value DESC, event_id) - 1 AS i0, value AS v FROM events QUALIFY i0 < 100")
def top_k(spark, d):
    return order.top(values(spark, d), 100).df


@query("SELECT vec_id, list_sort([CAST(x AS DOUBLE) FOR x IN embedding]) AS v, list_transform(list_sort(list_zip([CAST(x AS DOUBLE) FOR x IN embedding], range(64))), lambda s: CAST(s[2] AS INTEGER)) AS g FROM embeddings")
def sort_cells(spark, d):
    cells = F.transform("embedding", lambda x: x.cast("double"))
    return table(spark, d, "embeddings").select("vec_id", order.sort_cells(cells).alias("v"), order.grade_cells(cells).alias("g"))


# sets


@query("SELECT row_number() OVER (ORDER BY min(event_id)) - 1 AS i0, CAST(user_id AS DOUBLE) AS v FROM events GROUP BY user_id")
def unique(spark, d):
    return sets.unique(users(spark, d)).df


@query("WITH u AS (SELECT user_id AS v, event_id AS i FROM events UNION ALL SELECT event_type_n, 1000000 + event_id FROM (SELECT event_id, length(event_type) AS event_type_n FROM events)) SELECT row_number() OVER (ORDER BY min(i)) - 1 AS i0, CAST(v AS DOUBLE) AS v FROM u GROUP BY u.v")
def union(spark, d):
    return sets.union(users(spark, d), values(spark, d, F.length("event_type"))).df


@query("SELECT row_number() OVER (ORDER BY event_id) - 1 AS i0, CAST(user_id AS DOUBLE) AS v FROM events WHERE user_id IN (SELECT s_suppkey FROM supplier)")
def intersect(spark, d):
    return sets.intersect(users(spark, d), Engine(spark).array(table(spark, d, "supplier"), ["s_suppkey"], "s_suppkey")).df


@query("SELECT row_number() OVER (ORDER BY doc_id) - 1 AS i0, CAST(doc_id AS DOUBLE) AS v FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def without(spark, d):
    docs, marked = (Engine(spark).array(table(spark, d, t), ["doc_id"], "doc_id") for t in ("documents", "labels"))
    return sets.without(docs, marked).df


_BAG = "WITH o AS (SELECT event_id, user_id, event_id % 3 = 0 AS side, row_number() OVER (PARTITION BY user_id, event_id % 3 = 0 ORDER BY event_id) AS n FROM events), w AS (SELECT * FROM o WHERE NOT side), x AS (SELECT user_id, n FROM o WHERE side) SELECT row_number() OVER (ORDER BY event_id) - 1 AS i0, CAST(user_id AS DOUBLE) AS v FROM w WHERE {} EXISTS (SELECT 1 FROM x WHERE x.user_id = w.user_id AND x.n = w.n)"


@query(_BAG.format(""))
def bag_intersect(spark, d):
    return sets.bag_intersect(part(spark, d, "event_id % 3 <> 0", "user_id"), part(spark, d, "event_id % 3 = 0", "user_id")).df


@query(_BAG.format("NOT"))
def bag_without(spark, d):
    return sets.bag_without(part(spark, d, "event_id % 3 <> 0", "user_id"), part(spark, d, "event_id % 3 = 0", "user_id")).df


# functions of functions


@query("SELECT event_id AS i0, CASE WHEN value > 100 THEN -value ELSE value END AS v FROM events")
def under_filter(spark, d):
    x = values(spark, d)
    return combinators.under_filter(lambda p: p.map(num.negate), x.map(lambda v: num.greater(v, 100.0)), x).df


@query(f"SELECT CASE WHEN event_id >= {_N} - 400 THEN 2 * {_N} - 401 - event_id ELSE event_id END AS i0, value AS v FROM events")
def under_take(spark, d):
    return combinators.under_take(structural.reverse, values(spark, d), -400).df


@query("SELECT event_id AS i0, CASE WHEN event_id < 400 THEN value ELSE value * 2 END AS v FROM events")
def under_drop(spark, d):
    return combinators.under_drop(lambda p: p.map(lambda v: v * 2), values(spark, d), 400).df


@query("SELECT event_id AS i0, CASE WHEN event_id IN (3, 1, 4) THEN value + 1000 ELSE value END AS v FROM events")
def under_select(spark, d):
    return combinators.under_places(lambda p: p.map(lambda v: v + 1000), values(spark, d), Engine(spark).literal([3, 1, 4])).df


@query("SELECT event_id AS i0, round(exp(ln(value) + 1), 4) AS v FROM events")
def under_inverse(spark, d):
    back = num.INVERSES["exp"]
    return rounded(values(spark, d).map(lambda v: back[0](back[1](v) + 1.0)))


@query("SELECT vec_id AS i0, round(max(x), 6) + 0 AS v FROM " + _V + " GROUP BY vec_id")
def rank_one(spark, d):
    return rounded(combinators.rank("maximum", 1, vectors(spark, d)), 6)


@query("SELECT user_id, list(length(event_type) * 2 ORDER BY event_id) AS v FROM events GROUP BY user_id")
def depth(spark, d):
    e = table(spark, d, "events")
    lists = e.groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("event_id", F.length("event_type").alias("n")))), lambda s: s["n"]).alias("v"))
    return lists.select("user_id", combinators.depth(lambda v: v * 2, 1)(F.col("v")).cast("array<long>").alias("v"))


@query("SELECT event_id AS i0, value * 8 AS v FROM events")
def repeat(spark, d):
    return values(spark, d).map(combinators.repeat(lambda v: v * 2, 3)).df


@query("SELECT event_id AS i0, value / 4 AS v FROM events")
def repeat_back(spark, d):
    return values(spark, d).map(combinators.repeat(lambda v: v * 2, -2, lambda v: v / 2)).df


@query("SELECT event_id AS i0, value * 4 AS a, value * 16 AS b, value / 4 AS c FROM events")
def repeat_each(spark, d):
    made = combinators.repeat_each(lambda v: v * 2, [2, [4, -2]], lambda v: v / 2)(F.col("v"))
    return values(spark, d).df.select("i0", made[0].alias("a"), made[1][0].alias("b"), made[1][1].alias("c"))


@query("SELECT event_id AS i0, CASE CAST(event_id % 3 AS INTEGER) WHEN 0 THEN value WHEN 1 THEN -value ELSE value * value END AS v FROM events")
def choose(spark, d):
    f = combinators.choose(lambda v, k: k, [lambda v, k: v, lambda v, k: -v, lambda v, k: v * v])
    return values(spark, d).df.select("i0", f(F.col("v"), F.col("i0") % 3).alias("v"))


@query("SELECT event_id AS i0, (value + 1) * (value - 1) AS v FROM events")
def fork(spark, d):
    return values(spark, d).map(combinators.fork(lambda v: v + 1, num.multiply, lambda v: v - 1)).df


@query("SELECT event_id AS i0, value AS v FROM events")
def catch(spark, d):
    bad = lambda x: selection.assert_ones(x)
    return combinators.catch(bad, lambda x: x)(values(spark, d)).df


def _of_values(name: str, sql: str, f) -> None:
    """A query of a function of Columns over the values of events."""
    query(f"SELECT event_id AS i0, {sql} AS v FROM events")(_named(name, lambda spark, d: values(spark, d).map(f).df))


def _named(name: str, f):
    f.__name__ = name
    return f


_of_values("constant", "7.0::DOUBLE", lambda v: combinators.constant(F.lit(7.0))(v))
_of_values("left_argument", "value", lambda v: combinators.left(v, F.lit(1.0)))
_of_values("right_argument", "1.0::DOUBLE", lambda v: combinators.right(v, F.lit(1.0)))
_of_values("fill_by", "-value", lambda v: combinators.fill_by(num.negate, num.floor)(v))
_of_values("swap", "3 - value", lambda v: combinators.swap(num.subtract)(v, F.lit(3.0)))
_of_values("swap_self", "value + value", lambda v: combinators.swap(num.add)(v))
_of_values("atop", "-floor(value)", lambda v: combinators.atop(num.negate, num.floor)(v))
_of_values("over", "floor(value) + 3", lambda v: combinators.over(num.add, num.floor)(v, F.lit(3.5)))
_of_values("before", "-value * value", lambda v: combinators.before(num.negate, num.multiply)(v))
_of_values("before_bound", "2 - value", lambda v: combinators.before(F.lit(2.0), num.subtract)(v))
_of_values("after", "value - floor(value)", lambda v: combinators.after(num.subtract, num.floor)(v))
_of_values("valences_one", "-value", lambda v: combinators.valences(num.negate, num.subtract)(v))
_of_values("valences_two", "value - 5", lambda v: combinators.valences(num.negate, num.subtract)(v, F.lit(5.0)))


@query("SELECT 1 AS list, 2 AS cells, 0 AS atom")
def depth_of(spark, d):
    x = vectors(spark, d)
    return spark.createDataFrame([(structural.depth_of(x), structural.depth_of(structural.enclose_cells(x)), structural.depth_of(DArray(values(spark, d).df.select("v"), ())))], "list int, cells int, atom int")


@query("SELECT true AS took")
def timed(spark, d):
    return spark.createDataFrame([(combinators.timed(lambda x: x.map(num.negate))(values(spark, d)) > 0,)], "took boolean")


@query("SELECT 1024 AS v")
def while_(spark, d):
    return spark.createDataFrame([(combinators.while_(lambda n: n * 2, lambda n: n < 1000)(1),)], "v int")
