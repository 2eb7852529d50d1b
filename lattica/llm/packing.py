"""Packing by concatenating and cutting.

The first pass encodes every document and writes its ids with their place inside the partition. Partition totals (one
number a partition) come to the driver, where a prefix sum gives each partition its global offset. The second pass
reads the written ids and cuts the one long sequence at every multiple of the window: a document that crosses a cut
leaves a boundary record on each side. Only the last window can be short, so padding is under one window in all.

The order is that of the written partitions, fixed by the first pass, so a task that runs again gives the same pieces.

Defined cases: a null or empty text is the end id alone; the string of a special token in a text makes that token's id; equal rows are packed one by one; an empty table gives an
empty result; other columns aren't read.
"""

from __future__ import annotations

import sys
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm.chunks import byte_level, id_kind, special_strings, whole_text
from lattica.llm.common import per_task, stored

#: Fixed values of the contract.
WINDOW, END = 2048, 1

#: Documents that a worker holds at once.
SLICE_ROWS = 1000

PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _little(ids: list[int], kind: str) -> bytes:
    """Ids as little-endian unsigned integers of that type code."""
    made = array(kind, ids)
    if sys.byteorder == "big":
        made.byteswap()
    return made.tobytes()


def default_path() -> str:
    return public_tokenizers.path("byte_bpe_50k.json")


def encoded(df: DataFrame, path: str, doc_id: str, text: str, end: int) -> DataFrame:
    """(part, place, doc_id, ids): part is the partition, place the ids before the document in it, ids little-endian and narrow."""
    kind = id_kind(path)
    width = array(kind).itemsize

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, place = TaskContext.get().partitionId(), 0
        one, special = byte_level(path), special_strings(path)
        last = _little([end], kind)
        for some in parts:
            texts = some.column(1).to_pylist()
            texts = [x or "" for x in texts]
            ids = [_little((whole_text(path) if any(y in x for y in special) else one)(x), kind) + last for x in texts]
            sizes = np.array([len(x) // width for x in ids], dtype=np.int64)
            places = place + np.cumsum(sizes) - sizes
            place += int(sizes.sum())
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), number)), pa.array(places), some.column(0), pa.array(ids, type=pa.binary())], names=["part", "place", "doc_id", "ids"])

    return df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(per_task(run, SLICE_ROWS), "part long, place long, doc_id long, ids binary")


def cut(ids: bytes, begin: int, window: int) -> list[tuple[int, int, int, int, int]]:
    """(start, length, crc32, sequence, offset) of the pieces of a document that begins at a global place."""
    total, start, out = len(ids) // 4, 0, []
    while start < total:
        sequence, offset = divmod(begin + start, window)
        length = min(window - offset, total - start)
        out.append((start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]), sequence, offset))
        start += length
    return out


def pack(df: DataFrame, path: str | None = None, window: int = WINDOW, end: int = END, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    path = path or default_path()
    narrow = f"<u{array(id_kind(path)).itemsize}"
    written = stored(encoded(df, path, doc_id, text, end))
    totals = sorted((r["part"], r["n"]) for r in written.groupBy("part").agg(F.sum(F.expr(f"octet_length(ids) div {np.dtype(narrow).itemsize}")).alias("n")).collect())
    before, base = 0, {}
    for part, n in totals:
        base[part] = before
        before += n

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in parts:
            rows: list[tuple] = []
            docs: list[int | None] = []
            for number, place, doc, ids in zip(*(c.to_pylist() for c in some.columns), strict=True):
                wide = np.frombuffer(ids, dtype=narrow).astype("<u4").tobytes()
                total = len(wide) // 4
                for start, length, crc, sequence, offset in cut(wide, base[number] + place, window):
                    docs.append(doc)
                    rows.append((start, length, crc, total, sequence, offset))
            table = np.array(rows, dtype=np.int64).reshape(-1, 6)
            yield pa.RecordBatch.from_arrays([pa.array(docs, type=pa.int64()), *(pa.array(np.ascontiguousarray(table[:, k])) for k in range(6))], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    return written.mapInArrow(per_task(run, SLICE_ROWS), PIECE)
