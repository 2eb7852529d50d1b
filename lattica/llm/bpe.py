"""Byte-level BPE by recursive queries: DuckDB inside each partition.

The distinct words (matches of the split pattern) of a batch become rows (word, list of elements), at first an element a
byte. An element holds what it makes with the next one, its position and its token, in this order, so the least element
is the leftmost pair of minimum rank. A recursive query contracts it in each word and looks up the two pairs that this
makes in the merge table, until no word has a pair to merge. An ordered aggregation of the tokens' bytes decodes the
ids. A word is encoded once in a worker's memory of words, which has a fixed size; texts are put together from it by
Arrow.

Each step copies a word's list, so words of over LONG bytes, which only texts without spaces hold, contract by a heap
with the same rule.

Defined cases: null is an empty text; an empty text has no tokens; equal rows give equal rows; an empty table gives an
empty result; other columns aren't read.
"""

from __future__ import annotations

import atexit
import hashlib
import heapq
import shutil
import tempfile
from collections.abc import Iterator
from functools import cache

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm.chunks import cut_texts, read_ranks
from lattica.llm.common import lists, per_task

LONG = 512
#: What a worker remembers at most, the words of one query, the squares of their bytes, and the bytes of the texts that are cut at once.
WORDS, QUERY_WORDS, QUERY_SQUARES, SLICE_BYTES = 500_000, 40_000, 1 << 25, 8_000_000
#: An element of a word's list: what it makes with the next one (NONE: nothing) << 40 | position << 20 | token. Before a word stands START, which makes nothing.
TOKEN, NONE = (1 << 20) - 1, 1 << 20
START = NONE << 40 | TOKEN

ENCODE = f"""
WITH RECURSIVE t(w, e, best) AS (
  SELECT w, e, list_min(e) FROM given
  UNION ALL
  (WITH p AS (
     SELECT w, e, best, best >> 40 AS tok, list_position(e, best) AS i FROM t WHERE best < {NONE << 40}
   ), r AS (
     SELECT w, list_concat(
       e[:i - 2],
       [coalesce(x.made, {NONE}) << 40 | (e[i - 1] & {(1 << 40) - 1}), coalesce(y.made, {NONE}) << 40 | (best & {TOKEN << 20}) | tok],
       e[i + 2:]
     ) AS e
     FROM p LEFT JOIN merges x ON x.pair = ((e[i - 1] & {TOKEN}) << 20 | tok) LEFT JOIN merges y ON y.pair = (tok << 20 | (e[i + 2] & {TOKEN}))
   )
   SELECT w, e, list_min(e) FROM r)
)
SELECT w, e FROM t WHERE best >= {NONE << 40} ORDER BY w
"""
DECODE = "SELECT w, string_agg(v.digits, '' ORDER BY pos) AS digits FROM ids JOIN vocabulary v USING (tok) GROUP BY w ORDER BY w"


def blobs(data: bytes | np.ndarray, sizes: np.ndarray) -> pa.LargeBinaryArray:
    """Consecutive slices of data, of so many bytes."""
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)), pa.py_buffer(data)])


def spread(column: pa.LargeBinaryArray) -> tuple[memoryview, np.ndarray]:
    """The bytes of a column without nulls, and where each value begins, and the last one ends."""
    _, offsets, data = column.buffers()
    return memoryview(data or b""), np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, dtype=np.int64)


def joined(column: pa.LargeBinaryArray, many: np.ndarray) -> pa.LargeBinaryArray:
    """So many consecutive values each put together."""
    data, ends = spread(column)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(many), [None, pa.py_buffer(ends[np.concatenate([[0], np.cumsum(many)]).astype(np.int64)]), pa.py_buffer(data)])


class Codec:
    """Encoder and decoder of one rank file, over an own DuckDB."""

    def __init__(self, path: str, memory: str = "300MB") -> None:
        self.ranks = read_ranks(path)
        if max(self.ranks.values()) >= TOKEN:
            raise ValueError(f"ranks of {path} exceed {TOKEN - 1}")
        scratch = tempfile.mkdtemp(prefix="lattica-bpe-")
        atexit.register(shutil.rmtree, scratch, ignore_errors=True)
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": memory, "temp_directory": scratch})
        pairs = [(x, y, made) for token, made in self.ranks.items() for k in range(1, len(token)) if (x := self.ranks.get(token[:k])) is not None and (y := self.ranks.get(token[k:])) is not None]
        left, right, made = np.array(pairs, dtype=np.int64).reshape(-1, 3).T
        self._table("merges", pa.table({"pair": left << 20 | right, "made": made}))
        self._table("vocabulary", pa.table({"tok": pa.array(self.ranks.values(), type=pa.int32()), "digits": [k.hex() for k in self.ranks]}))
        self.single = np.array([self.ranks[bytes([b])] for b in range(256)], dtype=np.int64)
        self.double = np.array([[self.ranks.get(bytes([a, b]), NONE) for b in range(256)] for a in range(256)], dtype=np.int64)
        self._forget()

    def _forget(self) -> None:
        self.words = self.ids = self.bytes = pa.array([], type=pa.large_binary())

    def _table(self, name: str, rows: pa.Table) -> None:
        self.db.register("rows_in", rows)
        self.db.execute(f"CREATE TABLE {name} AS SELECT * FROM rows_in")
        self.db.unregister("rows_in")

    def _heap(self, word: bytes) -> list[int]:
        tokens: list[bytes | None] = [word[k : k + 1] for k in range(len(word))]
        after, before = [*range(1, len(word)), -1], [*range(-1, len(word) - 1)]
        rank = lambda k: self.ranks.get(tokens[k] + tokens[after[k]]) if after[k] >= 0 else None
        heap = [(r, k) for k in range(len(word)) if (r := rank(k)) is not None]
        heapq.heapify(heap)
        while heap:
            r, k = heapq.heappop(heap)
            if tokens[k] is None or rank(k) != r:
                continue
            gone = after[k]
            tokens[k], tokens[gone], after[k] = tokens[k] + tokens[gone], None, after[gone]
            if after[k] >= 0:
                before[after[k]] = k
            for at in (k, before[k]):
                if at >= 0 and (r := rank(at)) is not None:
                    heapq.heappush(heap, (r, at))
        return [self.ranks[t] for t in tokens if t is not None]

    def _query(self, words: pa.LargeBinaryArray) -> tuple[np.ndarray, np.ndarray]:
        """(ids end to end, number of ids of each word) of words that aren't empty."""
        text, ends = spread(words)
        data = np.frombuffer(text, dtype=np.uint8)[ends[0] : ends[-1]]
        sizes, ends = np.diff(ends), ends[1:] - ends[0]
        made = np.append(self.double[data[:-1], data[1:]], NONE)
        made[ends - 1] = NONE
        at = np.arange(len(data)) - np.repeat(ends - sizes, sizes)
        element = np.insert(made << 40 | at << 20 | self.single[data], ends - sizes, START)
        self.db.register("given", pa.table({"w": np.arange(len(words), dtype=np.int32), "e": lists(element, sizes + 1, pa.int64())}))
        found = self.db.sql(ENCODE).to_arrow_table()["e"].combine_chunks()
        self.db.unregister("given")
        many = pc.list_value_length(found).to_numpy().astype(np.int64)
        return np.delete(found.flatten().to_numpy() & TOKEN, np.cumsum(many) - many).astype(np.int32), many - 1

    def _encode(self, words: pa.LargeBinaryArray) -> pa.LargeBinaryArray:
        """The ids of each word as little-endian unsigned 32-bit integers."""
        sizes = pc.binary_length(words).to_numpy().astype(np.int64)
        order = np.argsort(sizes, kind="stable")
        begin, stop = np.searchsorted(sizes[order], [1, LONG + 1])
        squares = np.cumsum(sizes[order] ** 2)
        parts, many = [np.zeros(0, dtype=np.int32)], [np.zeros(begin, dtype=np.int64)]
        while begin < stop:
            most = np.searchsorted(squares, squares[begin] + QUERY_SQUARES, side="right")
            end = min(begin + QUERY_WORDS, most, stop)
            for held, found in zip((parts, many), self._query(words.take(pa.array(order[begin:end]))), strict=True):
                held.append(found)
            begin = end
        for word in words.take(pa.array(order[stop:])).to_pylist():
            parts.append(np.array(self._heap(word), dtype=np.int32))
            many.append(np.array([len(parts[-1])]))
        return blobs(np.concatenate(parts).astype("<u4"), 4 * np.concatenate(many)).take(pa.array(np.argsort(order, kind="stable")))

    def _decode(self, ids: pa.LargeBinaryArray) -> pa.LargeBinaryArray:
        """The bytes of each sequence of ids."""
        data, ends = spread(ids)
        tok = np.frombuffer(data, dtype="<u4")[ends[0] // 4 : ends[-1] // 4].astype(np.int32)
        w = np.repeat(np.arange(len(ids), dtype=np.int32), np.diff(ends) // 4)
        self.db.register("ids", pa.table({"w": w, "pos": np.arange(len(w), dtype=np.int32), "tok": tok}))
        found = self.db.sql(DECODE).to_arrow_table().combine_chunks()
        self.db.unregister("ids")
        digits = found["digits"].cast(pa.large_binary()).combine_chunks()
        text, ends = spread(digits)
        sizes = np.zeros(len(ids), dtype=np.int64)
        sizes[found["w"].to_numpy()] = np.diff(ends) // 2
        return blobs(bytes.fromhex(str(text[ends[0] : ends[-1]], "ascii")), sizes)

    def encode_words(self, words: list[bytes]) -> list[np.ndarray]:
        """The ids of each word."""
        return [np.frombuffer(x, dtype="<i4") for x in self._encode(pa.array(words, type=pa.large_binary())).to_pylist()]

    def decode(self, sequences: list[np.ndarray]) -> list[bytes]:
        """The bytes of each sequence of ids."""
        return self._decode(pa.array([np.asarray(x, dtype="<u4").tobytes() for x in sequences], type=pa.large_binary())).to_pylist()

    def _numbers(self, words: list[str]) -> pa.Array:
        """The place of each word in the worker's memory, where new ones are put."""
        given = pa.array(words, type=pa.large_string()).dictionary_encode()
        distinct = given.dictionary.cast(pa.large_binary())
        if len(self.words) > WORDS:
            self._forget()
        known = pc.is_in(distinct, value_set=self.words)
        new = distinct.filter(pc.invert(known))
        for k in range(0, len(new), QUERY_WORDS):
            some = new.slice(k, QUERY_WORDS)
            ids = self._encode(some)
            self.words, self.ids, self.bytes = (pa.concat_arrays(x) for x in ((self.words, some), (self.ids, ids), (self.bytes, self._decode(ids))))
        return pc.index_in(distinct, value_set=self.words).take(given.indices)

    def encode_texts(self, texts: pa.Array) -> Iterator[tuple[pa.LargeBinaryArray, pa.LargeBinaryArray]]:
        """For slices of the texts, in order: the ids of each as little-endian unsigned 32-bit integers, and those ids decoded."""
        texts = texts.cast(pa.large_string()).fill_null("")
        ends = np.cumsum(pc.binary_length(texts).to_numpy())
        begin = 0
        while begin < len(texts):
            before = ends[begin - 1] if begin else 0
            end = max(begin + 1, int(np.searchsorted(ends, before + SLICE_BYTES, side="right")))
            words, many, pieces, counts = cut_texts(texts.slice(begin, end - begin))
            numbers = self._numbers(words)
            yield tuple(joined(joined(x.take(numbers), many).take(pa.array(pieces)), counts) for x in (self.ids, self.bytes))
            begin = end

    def encode_batch(self, texts: list[str | None]) -> list[tuple[bytes, bytes]]:
        """For each text its ids as little-endian unsigned 32-bit integers, and those ids decoded."""
        return [x for a, b in self.encode_texts(pa.array(texts, type=pa.large_string())) for x in zip(a.to_pylist(), b.to_pylist(), strict=True)]


@cache
def codec(path: str) -> Codec:
    """One codec for each worker process and file."""
    return Codec(path)


def default_path() -> str:
    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def encoded(part: pa.RecordBatch, path: str) -> Iterator[tuple[pa.Array, pa.LargeBinaryArray, pa.LargeBinaryArray]]:
    """(doc_id, ids, decoded) of slices of a batch (doc_id, text)."""
    at = 0
    for ids, decoded in codec(path).encode_texts(part.column(1)):
        yield part.column(0).slice(at, len(ids)), ids, decoded
        at += len(ids)


def encode(df: DataFrame, path: str | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, ids array<int>, decoded binary) of every row."""
    path = path or default_path()

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for doc, ids, decoded in encoded(part, path):
                data, ends = spread(ids)
                yield pa.RecordBatch.from_arrays([doc, lists(np.frombuffer(data, dtype="<i4")[ends[0] // 4 : ends[-1] // 4], np.diff(ends) // 4, pa.int32()), decoded.cast(pa.binary())], names=["doc_id", "ids", "decoded"])

    return df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(per_task(run), "doc_id long, ids array<int>, decoded binary")


def hashes(column: pa.LargeBinaryArray) -> pa.Array:
    data, ends = spread(column)
    return pa.array([hashlib.sha256(data[a:b]).hexdigest() for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)], type=pa.string())


def digests(df: DataFrame, path: str | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every row, hashed where the ids are made."""
    path = path or default_path()

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for doc, ids, decoded in encoded(part, path):
                yield pa.RecordBatch.from_arrays([doc, pa.array(np.diff(spread(ids)[1]) // 4, type=pa.int64()), hashes(ids), hashes(decoded)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(per_task(run), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
