"""Whole analyses: group folds, products of matrices, user functions, and the streaming extension."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lattica.darray import Engine
from lattica.functions import numeric as num
from lattica.operators import fold, linalg
from lattica.plans import rewrite
from lattica.queries.registry import query, rounded, table, values, vectors
from lattica.streaming import windows


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, max(l_quantity) AS most FROM lineitem WHERE l_quantity > 10 GROUP BY ALL")
def group_fold(spark, d):
    rows = table(spark, d, "lineitem").where("l_quantity > 10")
    price = num.multiply(F.col("l_extendedprice"), num.complement(F.col("l_discount")))
    return fold.group_fold(rows, ["l_returnflag", "l_linestatus"], n=F.count("*"), revenue=F.round(F.sum(price), 2), most=F.max("l_quantity"))


@query("SELECT l_suppkey % 100 AS a, l_linenumber AS b, count(*) AS n, round(sum(l_quantity), 2) AS q FROM lineitem GROUP BY ALL")
def group_axes(spark, d):
    rows = table(spark, d, "lineitem").withColumns({"a": F.expr("l_suppkey % 100"), "b": F.col("l_linenumber")})
    return fold.group_fold(rows, ["a", "b"], n=F.count("*"), q=F.round(F.sum("l_quantity"), 2))


@query("SELECT n_name, o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL")
def lookup_fold(spark, d):
    """Equi-joins then a group fold; the planner chooses their order and strategy."""
    joined = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return fold.group_fold(joined, ["n_name", "o_orderpriority"], n=F.count("*"), total=F.round(F.sum("o_totalprice"), 2))


@query("WITH e AS (SELECT vec_id AS i, CAST(unnest(embedding) AS DOUBLE) AS v, generate_subscripts(embedding, 1) AS k FROM embeddings) SELECT a.k - 1 AS i0, b.k - 1 AS i1, round(sum(a.v * b.v), 3) + 0 AS v FROM e a JOIN e b USING (i) GROUP BY ALL")
def matmul(spark, d):
    from lattica.operators.structural import transpose

    x = vectors(spark, d)
    return rounded(linalg.matmul(transpose(x), x), 3)


@query("WITH e AS (SELECT vec_id AS i, CAST(unnest(embedding) AS DOUBLE) AS v, generate_subscripts(embedding, 1) AS k FROM embeddings) SELECT a.k - 1 AS i0, b.k - 1 AS i1, round(sum(a.v * b.v), 3) + 0 AS v FROM e a JOIN e b USING (i) GROUP BY ALL")
def matmul_join(spark, d):
    """The sparse product over all vectors."""
    from lattica.operators.structural import transpose

    x = vectors(spark, d)
    return rounded(linalg.matmul_sparse(transpose(x), x), 3)


@query("WITH e AS (SELECT vec_id AS i, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS k FROM embeddings) SELECT a.k - 1 AS i0, b.k - 1 AS i1, round(sum(CAST(a.v AS DOUBLE) * b.v), 2) + 0 AS v FROM e a JOIN e b USING (i) GROUP BY ALL")
def matmul_single(spark, d):
    """The accelerator's product in single precision."""
    from lattica.operators.structural import transpose

    x = vectors(spark, d)
    return rounded(linalg.matmul(transpose(x), x, "float"), 2)


@query("SELECT vec_id, [round(CAST(CAST(y / list_sum(e) AS FLOAT) AS DOUBLE), 5) FOR y IN e] AS v FROM (SELECT vec_id, [exp(CAST(x AS DOUBLE) - list_max(embedding)) FOR x IN embedding] AS e FROM embeddings)")
def softmax_single(spark, d):
    """Softmax of rows in single precision."""
    made = F.transform(fold.softmax_cells(F.transform("embedding", lambda x: x.cast("double"))), lambda v: v.cast("float"))
    return table(spark, d, "embeddings").select("vec_id", F.transform(made, lambda v: F.round(v.cast("double"), 5)).alias("v"))


@query("SELECT round(sum(value * value + 2 * value), 2) AS v FROM events")
def fold_map(spark, d):
    return rounded(rewrite.fold_map("add", lambda v: v * v + 2.0 * v, values(spark, d)), 2)


@query("SELECT i AS i0, CASE WHEN a <= 1 THEN 1 ELSE a END * 1.0::DOUBLE AS v FROM (SELECT event_id AS i, event_id % 6 AS k, CASE event_id % 6 WHEN 0 THEN 1 WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 3 THEN 6 WHEN 4 THEN 24 ELSE 120 END AS a FROM events)")
def user_function(spark, d):
    """A block of the user's own as an Arrow function, a recursive one here."""

    @F.pandas_udf(T.DoubleType())
    def block(s: pd.Series) -> pd.Series:
        def f(n: float) -> float:
            return 1.0 if n < 2 else n * f(n - 1)

        return s.map(f)

    return values(spark, d, F.expr("event_id % 6")).map(block).df


@query("SELECT user_id, round(list_reduce(list(value ORDER BY event_id DESC), lambda a, b: b + a / 2), 4) AS v FROM events GROUP BY user_id")
def user_aggregate(spark, d):
    """A block under a fold: from the right, in the row."""
    lists = table(spark, d, "events").groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "value"))), lambda s: s["value"]).alias("a"))
    return lists.select("user_id", F.round(fold.fold_cells(lambda v, acc: v + acc / 2, F.col("a")), 4).alias("v"))


@query("SELECT event_id, unnest(range(event_id % 4)) AS v FROM events")
def user_table(spark, d):
    """A block that gives a list for each element, its lists joined."""
    many = F.expr("event_id % 4")
    return table(spark, d, "events").select("event_id", F.explode(F.when(many > 0, F.sequence(F.lit(0), F.greatest(many, F.lit(1)) - 1)).otherwise(F.array().cast("array<bigint>"))).alias("v"))


@query("WITH g AS (SELECT *, CAST(coalesce(epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) >= 21600000000, true) AS INTEGER) AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, epoch_us(min(ts)) AS start, count(*) AS n FROM s GROUP BY user_id, k")
def session_groups(spark, d):
    """Runs of a user's events: a gap mask, its running sum, and a group by it."""
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("t")
    e = table(spark, d, "events").withColumn("t", F.unix_micros(F.col("ts").cast("timestamp")))
    new = F.coalesce((F.col("t") - F.lag("t").over(w) >= 21_600_000_000).cast("int"), F.lit(1))
    runs = e.withColumn("new", new).withColumn("k", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy("user_id", "k").agg(F.min("t").alias("start"), F.count("*").alias("n")).drop("k")


@query("SELECT CAST(epoch(date_trunc('day', ts)) AS BIGINT) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def stream_windows(spark, d):
    """Extension: event-time windows; the same function runs on a stream."""
    return windows.tumbling(table(spark, d, "events"))


@query("SELECT s_suppkey AS i0, CAST(s_suppkey AS DOUBLE) AS v FROM supplier WHERE s_suppkey < 0 UNION ALL SELECT row_number() OVER (ORDER BY s_suppkey) - 1, s_acctbal FROM supplier")
def dense_index(spark, d):
    """Places from a sort by range and prefix sums, without a single partition."""
    return Engine(spark).array(table(spark, d, "supplier"), ["s_suppkey"], "s_acctbal").df
