"""Idioms that have a better plan than their parts: recognised by name and emitted as one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame

from lattica.darray import DArray
from lattica.operators import fold, linalg, order

#: Idiom -> what it stands for. Each function below is the plan that replaces the parts.
IDIOMS = {
    "group_fold": "a fold of each group, without building the groups",
    "top": "the first cells of a descending sort, without a full sort",
    "matmul": "sums of products over an inner axis, in blocks",
    "fold_map": "a fold of an elementwise expression, in one pass",
}


def group_fold(df: DataFrame, keys: list[str], **folds: Column) -> DataFrame:
    return fold.group_fold(df, keys, **folds)


def top(x: DArray, k: int, down: bool = True) -> DArray:
    return order.top(x, k, down)


def matmul(w: DArray, x: DArray) -> DArray:
    """Blocks for dense arrays; a plain join where an axis is small, as a block would be mostly zeros."""
    return linalg.matmul(w, x) if min(*w.shape, *x.shape) >= 32 else linalg.matmul_sparse(w, x)


def fold_map(name: str, f: object, x: DArray) -> DataFrame:
    return fold.fold_frame(name, x.map(f))
