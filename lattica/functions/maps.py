"""Insertion-ordered maps as rows (seq, k, v), with functional updates: every change gives a new map."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.errors import DomainError


@dataclass(frozen=True)
class HashMap:
    df: DataFrame

    @staticmethod
    def of(df: DataFrame, seq: str, k: str, v: str) -> HashMap:
        """A map of rows; a key that stands twice raises."""
        rows = df.select(F.col(seq).alias("seq"), F.col(k).alias("k"), F.col(v).alias("v"))
        if rows.groupBy("k").count().where("count > 1").limit(1).count():
            raise DomainError("a key stands twice")
        return HashMap(rows)

    def count(self) -> int:
        return self.df.count()

    def keys(self) -> DataFrame:
        return self.df.select("seq", "k")

    def values(self) -> DataFrame:
        return self.df.select("seq", "v")

    def has(self, asked: DataFrame, k: str) -> DataFrame:
        there = self.df.select(F.col("k").alias("__k"), F.lit(1).alias("has"))
        return asked.join(there, F.col(k) == F.col("__k"), "left").drop("__k").withColumn("has", F.coalesce("has", F.lit(0)))

    def get(self, asked: DataFrame, k: str, default: Column | None = None, out: str = "found") -> DataFrame:
        """Values of keys; an absent key takes the default, or raises without one."""
        there = self.df.select(F.col("k").alias("__k"), F.col("v").alias("__v"), F.lit(True).alias("__t"))
        other = F.raise_error(F.lit("key not found")).cast(self.df.schema["v"].dataType) if default is None else default
        return asked.join(there, F.col(k) == F.col("__k"), "left").withColumn(out, F.when(F.col("__t"), F.col("__v")).otherwise(other)).drop("__k", "__v", "__t")

    def set(self, rows: DataFrame) -> HashMap:
        """Rows (seq, k, v) put in, the last by seq winning; a key that was there keeps its place."""
        both = self.df.withColumn("__o", F.lit(0)).unionByName(rows.select("seq", "k", "v").withColumn("__o", F.lit(1)))
        last = F.struct("__o", "seq")
        made = both.groupBy("k").agg(F.min(last).alias("__first"), F.max_by("v", last).alias("v"))
        start = F.when(F.col("__first.__o") == 0, 0).otherwise(1 << 40)
        return HashMap(made.select((start + F.col("__first.seq")).alias("seq"), "k", "v"))

    def delete(self, keys: DataFrame, k: str) -> HashMap:
        return HashMap(self.df.join(keys.select(F.col(k).alias("k")).distinct(), "k", "left_anti"))
