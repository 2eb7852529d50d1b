"""Near duplicates by SimHash, with fuzzy keys from the binary Golay code.

A fingerprint of 64 bits is cut into segments. Two fingerprints that differ in three bits or fewer agree on all but
three segments (pigeonhole), and of the bits outside an agreeing choice, one half holds one error at most. That half
is read as a word of the [23, 12] Golay code, whose spheres of radius three tile the space: all codewords within
distance four of the word (one, or six) give its keys, and two words at distance two or less always share one. So
the exact segments with a shared codeword index bring every linked pair together; each pair is then verified.

Texts with equal fingerprints are one node before any key is made, so copies cost one row each. Rows of a key are
sorted next to each other and scanned as a stream; a scan emits edges that span each linked set, not its pairs, so
large sets of near copies stay linear. A scan of a large key cuts it again by the bits that vary in it.

Defined cases: null, empty and blank texts have fingerprint zero and are linked like any other; rows with equal text
are linked; rows that share a doc_id are one document to the links; a null doc_id keeps its fingerprint, gets a null
component and links with nothing; an empty table gives an empty result; other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import lower_ascii_bytes, per_task, stored
from lattica.llm.components import components

BITS, RADIUS = 64, 3
#: Fixed value: the generator polynomial of the binary Golay code of length 23.
GOLAY = 0b110001110101


def fingerprint(text: bytes | None, size: int = 3) -> int:
    """SimHash of the word shingles of a UTF-8 text, repeats included."""
    words = lower_ascii_bytes(text or b"").split()  # splits at exactly space and 09-0D
    if not words:
        return 0
    if len(words) <= size:
        return xxhash.xxh64_intdigest(b" ".join(words), 42)
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1
    ends = np.cumsum(lengths) - 1
    starts = (ends - lengths + 1)[: len(words) - size + 1].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], 42) for a, b in zip(starts, ends[size - 1 :].tolist(), strict=True)], dtype=np.uint64)
    counts = np.zeros(BITS, dtype=np.int64)
    for k in range(0, len(hashes), 1 << 14):
        counts += np.unpackbits(hashes[k : k + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view(np.uint64)[0])


@cache
def golay_tables() -> tuple[np.ndarray, np.ndarray]:
    """(remainder of each upper part, error patterns by syndrome): the patterns lead to every codeword within four."""

    def rest(word: int) -> int:
        for k in range(22, 10, -1):
            if word >> k & 1:
                word ^= GOLAY << (k - 11)
        return word

    upper = np.array([rest(x << 11) for x in range(1 << 12)], dtype=np.uint32)
    single = [rest(1 << k) for k in range(23)]
    found: list[list[int]] = [[] for _ in range(1 << 11)]
    for weight in range(5):
        for places in combinations(range(23), weight):
            syndrome = 0
            for k in places:
                syndrome ^= single[k]
            found[syndrome].append(sum(1 << k for k in places))
    patterns = np.array([(x * 6)[:6] for x in found], dtype=np.uint32)  # six each, or one repeated
    return upper, patterns


def codewords(words: np.ndarray) -> np.ndarray:
    """(n, 6) indices of the Golay codewords within distance four; words with one repeat it."""
    upper, patterns = golay_tables()
    words = words.astype(np.uint32)
    return (words[:, None] ^ patterns[(words & 0x7FF) ^ upper[words >> 11]]) >> 11


def keys(prints: np.ndarray, segments: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """(key, row) of all keys of the fingerprints (uint64)."""
    edges = [BITS * k // segments for k in range(segments + 1)]
    places = [list(range(a, b)) for a, b in zip(edges, edges[1:], strict=False)]

    def gather(bits: list[int]) -> np.ndarray:
        out = np.zeros(len(prints), dtype=np.uint64)
        for to, bit in enumerate(bits):
            out |= (prints >> np.uint64(bit) & np.uint64(1)) << np.uint64(to)
        return out

    made, rows = [], []
    for n, exact in enumerate(combinations(range(segments), segments - RADIUS)):
        same = gather([b for s in exact for b in places[s]])
        rest = [b for s in range(segments) if s not in exact for b in places[s]]
        width = sum(len(places[s]) for s in exact)
        for half, bits in enumerate((rest[0::2], rest[1::2])):
            index = codewords(gather(bits[:23])).astype(np.uint64)
            key = ((np.uint64(2 * n + half) << np.uint64(width)) | same)[:, None] << np.uint64(12) | index
            new = np.ones(index.shape, dtype=bool)
            new[:, 1:] = index[:, 1:] != index[:, :1]  # a single codeword is there six times
            where = np.flatnonzero(new)
            made.append(key.reshape(-1)[where])
            rows.append(where // 6)
    return np.concatenate(made), np.concatenate(rows)


def spanning(prints: np.ndarray, limit: int = 2048) -> list[tuple[int, int]]:
    """Edges of distinct fingerprints (by place) that connect all that are linked by three bits or fewer."""
    n = len(prints)
    varying = int(np.bitwise_or.reduce(prints) ^ np.bitwise_and.reduce(prints))
    if n <= limit or varying.bit_count() <= RADIUS:
        edges, left = [], np.arange(n)
        while len(left):
            queue, left = [int(left[0])], left[1:]
            while queue and len(left):
                at = queue.pop()
                near = np.bitwise_count(prints[left] ^ prints[at]) <= RADIUS
                if near.any():
                    found = left[near].tolist()
                    edges += [(at, k) for k in found]
                    queue += found
                    left = left[~near]
        return edges
    bits = [k for k in range(BITS) if varying >> k & 1]
    edges = []
    for part in range(RADIUS + 1):  # one of four parts of the varying bits is equal in a linked pair
        mask = np.uint64(sum(1 << k for k in bits[part :: RADIUS + 1]))
        value = prints & mask
        order = np.argsort(value, kind="stable")
        cuts = np.flatnonzero(np.diff(value[order])) + 1
        for group in np.split(order, cuts):
            if len(group) > 1:
                edges += [(int(group[a]), int(group[b])) for a, b in spanning(prints[group], limit)]
    return edges


def _fingerprints(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in parts:
        made = np.fromiter((fingerprint(x) for x in part.column(1).to_pylist()), dtype=np.uint64, count=part.num_rows)
        yield pa.RecordBatch.from_arrays([part.column(0), pa.array(made.view(np.int64))], names=["doc_id", "print"])


def fingerprints(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, print): the fingerprint of every row as a signed long."""
    return df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text")).mapInArrow(per_task(_fingerprints, 2000), "doc_id long, print long")


def _scan(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, print, node) sorted by key -> edges (u, v) that span what is linked within each key."""
    held: list[tuple[np.ndarray, ...]] = []

    def edges(key: np.ndarray, prints: np.ndarray, node: np.ndarray) -> pa.RecordBatch:
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        size = np.diff(np.r_[first, len(key)])
        two = first[size == 2]
        two = two[np.bitwise_count(prints[two] ^ prints[two + 1]) <= RADIUS]
        u, v = [node[two]], [node[two + 1]]
        for a, n in zip(first[size > 2].tolist(), size[size > 2].tolist(), strict=True):
            if found := spanning(prints[a : a + n]):
                i, j = np.array(found).T
                u.append(node[a : a + n][i])
                v.append(node[a : a + n][j])
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(u)), pa.array(np.concatenate(v))], names=["u", "v"])

    for part in parts:
        if not part.num_rows:
            continue
        key, prints, node = (part.column(k).to_numpy() for k in range(3))
        if held and held[-1][0][-1] == key[-1]:
            held.append((key, prints.view(np.uint64), node))
            continue
        last = int(np.searchsorted(key, key[-1]))  # the last key may go on
        held.append((key[:last], prints[:last].view(np.uint64), node[:last]))
        ready = [np.concatenate(x) for x in zip(*held, strict=True)]
        if len(ready[0]):
            yield edges(*ready)
        held = [(key[last:], prints[last:].view(np.uint64), node[last:])]
    if held:
        yield edges(*(np.concatenate(x) for x in zip(*held, strict=True)))


def links(nodes: DataFrame, segments: int | None = None) -> DataFrame:
    """(print, node) with distinct prints -> edges (u, v) between nodes that span all links of three bits or fewer.

    segments: more of them give longer keys; chosen by the number of nodes where not given. Any choice is exact.
    """
    if segments is None:
        segments = 4 if nodes.count() < 1 << 30 else 5

    def make(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            prints, node = part.column(0).to_numpy(), part.column(1).to_numpy()
            for k in range(0, len(prints), 20_000):
                key, row = keys(prints[k : k + 20_000].view(np.uint64), segments)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(prints[k + row]), pa.array(node[k + row])], names=["key", "print", "node"])

    keyed = nodes.select("print", "node").mapInArrow(per_task(make), "key long, print long, node long")
    return keyed.repartition("key").sortWithinPartitions("key").mapInArrow(per_task(_scan), "u long, v long")


def near_duplicates(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of df: doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable)."""
    prints = stored(fingerprints(df, doc_id, text))
    nodes = stored(prints.where("doc_id is not null").groupBy("print").agg(F.min("doc_id").alias("node")))
    linked = links(nodes)
    # a doc_id with several rows joins the prints of its rows
    same = prints.where("doc_id is not null").groupBy("doc_id").agg(F.min("print").alias("low"), F.max("print").alias("high")).where("low <> high").select("doc_id")
    again = prints.join(same, "doc_id", "left_semi").join(nodes, "print").select(F.col("doc_id").alias("u"), F.col("node").alias("v"))
    found = components(linked.union(again))
    named = nodes.join(found, "node", "left").select("print", F.coalesce("component", "node").alias("component_id"))
    return prints.join(named, "print", "left").select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def keep_first(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of df, with all their columns, that stand first in their component: one document of each group.

    Rows that repeat a doc_id count as copies of one document, and one of them stays. Rows without doc_id stay.
    """
    first = near_duplicates(df, doc_id, text).where("doc_id = component_id").groupBy("doc_id").agg(F.count("*").alias("n"))
    if first.where("n > 1").limit(1).count():
        df = df.where(F.col(doc_id).isNull()).union(df.where(F.col(doc_id).isNotNull()).dropDuplicates([doc_id]))
    ids = first.select(F.col("doc_id").alias("__id"))
    return df.join(ids, df[doc_id].cast("long") == F.col("__id"), "left_semi").union(df.where(F.col(doc_id).isNull()))
