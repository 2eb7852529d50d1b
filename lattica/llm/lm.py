"""Language-model scores from a hierarchical Pitman-Yor model.

Tokens are lower-cased words and one end mark a text. A context is the word before: a child restaurant for each word in
training (one that occurs LEAST times; words that don't, and a text's beginning, have that of their ending).
Children whose words end alike share a parent restaurant, and all parents share the root, whose base is uniform over
the vocabulary and one unknown word. Tables of a restaurant are customers of the one above. Gibbs sweeps seat the
customers of every restaurant anew, given the seating of the others from the sweep before, and then draw the strengths
of the three levels; the predictive probabilities of the sweeps after the first are averaged.

Counts, vocabulary and seating come from all training documents. They are gathered by word: all contexts of a word
lie in one bucket, whose number grows with the text, so a sweep is a pass over buckets that exchanges only the totals
of each restaurant. SHARE words at most make up 1 / SHARE of the words in training, whatever the size of the text:
every task holds their hashes and the totals of their restaurants. Those of all other words meet by a key: each bucket
asks for the contexts it has, and where the asking of all buckets meets, customers and tables are added up and sent
back. A word that follows a context once takes one table in every sweep, so after the first meeting a bucket sends only
contexts that some word follows more often there, until the last sweep's tables go to all that score by them. Both ways
give the same model. Scoring brings the words of all documents to their
buckets; the most frequent pairs of word and context, HOT at most, are scored where the text lies. A bucket that many
tokens would still reach is copied, and its tokens are dealt over the copies. Frequent words also reach a bucket from
many partitions, so counts are added up in two stages.

Defined cases: a null or empty text is the end mark alone; a null doc_id isn't in training and is held out; rows that
share a doc_id are scored one by one; without training documents every token is unknown (N and V are 0); an empty
table gives an empty result; other columns aren't read.
"""

from __future__ import annotations

import functools
import pickle
import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import RDD, Broadcast, TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import crc_rest, flat, give_back, lists, per_task, shared_dir, stored

LAST, PER_LAST = 32, 64
PARENTS = LAST * PER_LAST
SHARE, LEAST = 1 << 17, 1  # words of which one in SHARE is this one have their totals in every task; a context's word occurs that often
HOT, SWEEPS, BURN_IN = 1 << 19, 3, 1
COPY_TOKENS = 1 << 21  # of a bucket's copy
BINS = 256  # of counts, four a doubling
ADDED = 0.1  # of the base score
END = b"\n"  # no word holds it
BUCKET_BYTES, SLICE_ROWS = 6 << 20, 1000
MOST_HELD = 1 << 20  # words that a task counts before it sends them

GATHERED = 4  # buckets of a group, which one task of a sweep goes through
PACKED = "key long, packed binary"


_CRC = np.array([zlib.crc32(bytes([k])) for k in range(256)], dtype=np.uint32)
_CRC_STEP = _CRC[::-1] ^ np.uint32(0xFF000000)  # the table that a CRC goes through byte by byte


def endings(words: pa.Array) -> np.ndarray:
    """The parent restaurant of the contexts of words that end like each of these, by the CRC32 of its last byte and of its
    last three; 0 is that of a text's beginning and of few others. No word is empty."""
    ends = np.frombuffer(words.buffers()[1], dtype=np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
    data, last, sizes = np.frombuffer(words.buffers()[2], dtype=np.uint8), ends[1:], np.diff(ends)
    crc = np.full(len(words), 0xFFFFFFFF, dtype=np.uint32)
    for k in (3, 2, 1):
        there = sizes >= k
        byte = data[np.where(there, last - k, 0)] if len(data) else np.zeros(len(words), dtype=np.uint8)
        crc = np.where(there, _CRC_STEP[(crc ^ byte) & 255] ^ (crc >> 8), crc)
    return _CRC[data[last - 1]].astype(np.int64) % LAST * PER_LAST + (~crc).astype(np.int64) % PER_LAST if len(words) else np.zeros(0, dtype=np.int64)


def split(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The lower-cased words of binary texts (null: none) end to end, and how many each text has."""
    plain = texts.fill_null(b"").cast(pa.binary()).view(pa.string())  # only bytes are looked at
    cut = pc.ascii_split_whitespace(pc.ascii_lower(plain))
    words, bounds = cut.flatten(), np.asarray(cut.offsets).astype(np.int64)
    there = np.asarray(pc.binary_length(words)) > 0  # white space at either end leaves an empty piece
    before = np.r_[0, np.cumsum(there)]
    return words.filter(pa.array(there)).view(pa.binary()), np.diff(before[bounds - bounds[0]])


def hashed(words: pa.Array) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words.to_numpy(zero_copy_only=False)), dtype=np.uint64, count=len(words)).view(np.int64)


def packed_arrays(arrays: list[np.ndarray]) -> bytes:
    """Arrays of whole numbers in as few bytes as they need, compressed; hashes and other numbers as they are."""
    out = []
    for x in arrays:
        if x.dtype.kind != "f" and len(x) and x.min() >= 0:
            x = x.astype(np.min_scalar_type(int(x.max())))
            out.append((x.dtype.str, x.nbytes, pa.compress(x.tobytes(), "lz4", asbytes=True)))
        else:
            out.append((x.dtype.str, None, x.tobytes()))
    return pickle.dumps(out)


def unpacked_arrays(data: bytes) -> list[np.ndarray]:
    found = [np.frombuffer(x if size is None else pa.decompress(x, size, "lz4", asbytes=True), dtype=kind) for kind, size, x in pickle.loads(data)]
    return [x if x.dtype.kind == "f" else x.astype(np.int64) for x in found]


def parted(u: np.ndarray) -> list[np.ndarray]:
    """Contexts as small numbers, 0 for those by key, and these keys."""
    return [np.where(u < 0, 0, u + 1), u[u < 0]]


def joined(small: np.ndarray, keys: np.ndarray) -> np.ndarray:
    u = small - 1
    u[small == 0] = keys
    return u


def end_to_end(packed: list[bytes]) -> list[np.ndarray]:
    return [np.concatenate(x) for x in zip(*map(unpacked_arrays, packed), strict=True)]


def runs(part: np.ndarray, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """The places of each number there is below n, in their order."""
    order, sizes = by_bucket(part), np.bincount(part, minlength=n)
    ends = np.cumsum(sizes)
    for k in np.flatnonzero(sizes):
        yield int(k), order[ends[k] - sizes[k] : ends[k]]


def own(hashes: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Keys, all below 0, of words' own restaurants: 52 bits of the hash, and the parent."""
    return hashes & ~np.int64(PARENTS - 1) | ends | np.int64(-(1 << 63))


def meeting_of(keys: np.ndarray, n: int) -> np.ndarray:
    """Which of n meetings adds up a key; it rises with the keys."""
    return ((keys.view(np.uint64) << np.uint64(1) >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


@dataclass
class Contexts:
    """Child restaurants that every task holds: first one a parent, for a text's beginning and words that occur less than
    LEAST times, then one a frequent word, by hash in order. Other words' are known by their keys."""

    words: np.ndarray
    parent: np.ndarray  # of every child
    least: int = LEAST

    @property
    def size(self) -> int:
        return len(self.parent)

    def of(self, hashes: np.ndarray, ends: np.ndarray) -> np.ndarray:
        keys = own(hashes, ends)
        if not len(self.words):
            return keys
        at = np.minimum(np.searchsorted(self.words, hashes), len(self.words) - 1)
        return np.where(self.words[at] == hashes, PARENTS + at, keys)


@dataclass
class Tokens:
    """Tokens of some texts end to end: numbers of words and of words before (after the last: a beginning), and texts; of
    each number the hash and the context it is."""

    word: np.ndarray
    before: np.ndarray
    hashes: np.ndarray
    contexts: np.ndarray
    text: np.ndarray
    sizes: np.ndarray


def read(texts: pa.Array, contexts: Contexts) -> Tokens:
    cut, sizes = split(texts)
    sizes = sizes + 1  # the end mark
    ids = cut.dictionary_encode()
    distinct = pa.concat_arrays([ids.dictionary, pa.array([END], type=pa.binary())])
    word = np.full(int(sizes.sum()), len(distinct) - 1, dtype=np.int64)
    inner = np.ones(len(word), dtype=bool)
    inner[np.cumsum(sizes) - 1] = False
    word[inner] = np.asarray(ids.indices)
    hashes = hashed(distinct)
    before = np.full(len(word), len(distinct), dtype=np.int64)
    before[1:] = word[:-1]
    before[np.cumsum(sizes)[:-1]] = len(distinct)
    return Tokens(word, before, hashes, np.r_[contexts.of(hashes, endings(distinct)), 0], np.repeat(np.arange(len(texts)), sizes), sizes)


def buckets_of(hashes: np.ndarray, n: int) -> np.ndarray:
    return (hashes.view(np.uint64) % np.uint64(n)).astype(np.int64)


def by_bucket(bucket: np.ndarray) -> np.ndarray:
    """The stable order of buckets; narrow numbers are sorted by their digits."""
    return np.argsort(bucket.astype(np.uint16) if len(bucket) and bucket.max() < 1 << 16 else bucket, kind="stable")


def merge(h: np.ndarray, u: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts added up by word and context, in their order."""
    order = np.lexsort((u, h))
    h, u, c = h[order], u[order], c[order]
    new = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (u[1:] != u[:-1])][: len(h)])
    return h[new], u[new], np.add.reduceat(c, new) if len(new) else c


def frequent_words(df: DataFrame, n: int) -> Contexts:
    """The contexts of df (doc_id, text binary) that every task holds: words of the least share of all, counted in each partition and then by hash."""
    kinds = "bucket long, many long, h array<long>, e array<int>, c array<long>"
    names = ["bucket", "many", "h", "e", "c"]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h, e, c = (np.zeros(0, dtype=np.int64) for _ in range(3))

        def packed() -> pa.RecordBatch:
            bucket = buckets_of(h, n)
            order = by_bucket(bucket)
            sizes = np.bincount(bucket, minlength=n)
            there = np.flatnonzero(sizes)
            many = np.bincount(bucket, weights=c, minlength=n)[there].astype(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(there), pa.array(many), *(lists(x[order], sizes[there], kind) for x, kind in ((h, pa.int64()), (e, pa.int32()), (c, pa.int64())))], names=names)

        for part in parts:
            for k in range(0, part.num_rows, SLICE_ROWS):
                found = split(part.column(1).slice(k, SLICE_ROWS))[0].value_counts()
                words = found.field("values")
                h, e, c = merge(np.r_[h, hashed(words)], np.r_[e, endings(words)], np.r_[c, np.asarray(found.field("counts"))])
                if len(h) > MOST_HELD:
                    yield packed()
                    h, e, c = (np.zeros(0, dtype=np.int64) for _ in range(3))
        yield packed()

    def often(group: pa.Table) -> pa.Table:
        h, e, c = merge(*(flat(group[k].combine_chunks())[0] for k in ("h", "e", "c")))
        some = c >= least
        return pa.table({"h": h[some], "e": e[some].astype(np.int32)})

    counted = stored(df.mapInArrow(per_task(run), kinds))
    least = max(LEAST, -(-(counted.agg(F.sum("many")).first()[0] or 0) // SHARE))
    found = counted.drop("many").groupBy("bucket").applyInArrow(often, "h long, e int").toArrow()
    h, e = found["h"].to_numpy(), found["e"].to_numpy().astype(np.int64)
    order = np.argsort(h)
    return Contexts(h[order], np.r_[np.arange(PARENTS), e[order]], LEAST)


def itself(key: int) -> int:
    return key


def dealt(df: DataFrame, n: int, salts: int, known: Broadcast) -> RDD:
    """(group, (bucket, packed)): how often each word follows each context in texts that are not held out, and all
    contexts by key; df has (held_out, text binary). It is dealt out by groups and kept in the shared folder."""
    groups = -(-n // GATHERED)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salt, contexts = TaskContext.get().partitionId() % salts, known.value
        for part in parts:
            for k in range(0, part.num_rows, SLICE_ROWS):
                some = part.slice(k, SLICE_ROWS)
                for asked in (False, True):  # held-out texts are not counted; they say where totals are needed
                    t = read(some.column(1).filter(some.column(0) if asked else pc.invert(some.column(0))), contexts)
                    key, c = np.unique(t.word * len(t.contexts) + t.before, return_counts=True)
                    h, u = t.hashes[key // len(t.contexts)], t.contexts[key % len(t.contexts)]
                    if asked:
                        h, u, c = h[u < 0], u[u < 0], np.zeros(int((u < 0).sum()), dtype=np.int64)
                    new = np.flatnonzero(np.r_[True, h[1:] != h[:-1]][: len(h)])
                    times = np.diff(np.r_[new, len(h)])
                    group = buckets_of(h[new], n) % groups
                    places = runs(np.repeat(group, times), groups)
                    made = [(g + groups * salt, packed_arrays([h[new[words]], times[words], *parted(u[at]), c[at]])) for (g, words), (_, at) in zip(runs(group, groups), places, strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in made], type=kind) for i, kind in enumerate((pa.int64(), pa.binary()))], names=["key", "packed"])

    def groups_of(parts: Iterator[tuple]) -> Iterator[tuple]:
        found: dict[int, list[bytes]] = defaultdict(list)
        for key, x in parts:
            found[key].append(bytes(x))
        for key in [*found]:
            arrays = [unpacked_arrays(x) for x in found.pop(key)]
            yield key, np.concatenate([np.repeat(*x[:2]) for x in arrays]), np.concatenate([joined(*x[2:4]) for x in arrays]), np.concatenate([x[4] for x in arrays])
        give_back()

    def add(parts: Iterator[tuple]) -> Iterator[tuple]:
        for key, *some in groups_of(parts):
            h, u, c = merge(*some)
            words, times = np.unique(h, return_counts=True)
            yield key % groups, packed_arrays([words, times, *parted(u), c])

    def hold(parts: Iterator[tuple]) -> Iterator[tuple]:
        size, parent = known.value.size, known.value.parent
        for g, h, u, c in groups_of((key % groups, x) for key, x in parts):
            for b, at in runs(buckets_of(h, n), n):
                words, of = np.unique(h[at], return_inverse=True)
                number, times, keyed = u[at], c[at], np.flatnonzero(u[at] < 0)
                above = parent[np.maximum(number, 0)]
                above[keyed] = number[keyed] & (PARENTS - 1)
                keys, place = np.unique(number[keyed], return_inverse=True)
                number[keyed] = size + place
                key = (of * PARENTS + above) * (size + len(keys)) + number
                order = np.argsort(key)
                key = key[order]
                new = np.flatnonzero(np.r_[True, key[1:] != key[:-1]][: len(key)])
                times, number, of = np.add.reduceat(times[order], new), number[order[new]], of[order[new]]
                some = times > 0
                many = np.bincount(of[some], minlength=len(words))
                yield g, (b, packed_arrays([words[many > 0], many[many > 0], number[some], times[some], keys]))

    counted = df.mapInArrow(per_task(run), PACKED).rdd.map(tuple)
    if salts > 1:
        counted = counted.partitionBy(groups * salts, itself).mapPartitions(add)
    made, context = counted.partitionBy(groups, itself).mapPartitions(hold, preservesPartitioning=True), df.sparkSession.sparkContext
    shared_dir(df.sparkSession)  # where checkpoints go
    made.checkpoint()
    context.runJob(made, lambda parts: [], [0])
    return RDD(made._jrdd, context, made._jrdd_deserializer)


@dataclass
class Totals:
    """What a sweep knows of the restaurants that every task holds: customers and tables of children, parents and root."""

    child_c: np.ndarray
    child_t: np.ndarray
    parent_c: np.ndarray
    parent_t: np.ndarray
    root_c: float
    root_t: float
    strength: tuple[float, float, float] = (1.0, 1.0, 1.0)

    @classmethod
    def cut(cls, x: np.ndarray, size: int) -> Totals:
        cuts = np.split(x, np.cumsum([size, size, PARENTS, PARENTS]))
        return cls(*cuts[:4], float(cuts[4][0]), float(cuts[4][1]))

    def drawn(self, discount: tuple[float, float, float], before: tuple[float, float, float], rng: np.random.Generator, keyed: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None) -> tuple[float, float, float]:
        """Strengths of child, parent and root drawn given the seating; keyed has what draw_strength takes of the other children."""
        levels = ((self.child_c, self.child_t, keyed), (self.parent_c, self.parent_t, None), (np.array([self.root_c]), np.array([self.root_t]), None))
        return tuple(draw_strength(c, t, d, s, rng, more) for (c, t, more), d, s in zip(levels, discount, before, strict=True))


@dataclass
class Model:
    """Discounts of the three levels (child, parent, root), vocabulary, contexts, and the totals and strengths of each sweep."""

    discount: tuple[float, float, float]
    tokens: int
    words: int
    contexts: Contexts
    totals: list[Totals]

    @property
    def base(self) -> float:
        return 1 / (self.words + 1)


def _blocks() -> tuple[np.ndarray, np.ndarray]:
    """The first table and the number of tables of each block: one up to the 4096th, then a quarter of those before."""
    first, i = [*range(1, 1 << 12)], 1 << 12
    sizes = [1] * len(first)
    while i < 1 << 48:
        first.append(i)
        sizes.append(i // 4)
        i += i // 4
    return np.array(first, dtype=np.int64), np.array(sizes, dtype=np.int64)


BLOCK_AT, BLOCK_SIZE = _blocks()
MANY_DRAWS = 1 << 12  # of one distribution; the sum of more is drawn at once


def tables_after_first(t: np.ndarray) -> np.ndarray:
    """How many tables restaurants of t tables have in each block, without the first of each."""
    many = np.sort(t).astype(np.int64)
    out = len(many) - np.searchsorted(many, BLOCK_AT, side="right")
    for k in range((1 << 12) - 1, int(np.searchsorted(BLOCK_AT, many[-1] if len(many) else 0))):
        big = many[len(many) - out[k] :]
        out[k] = np.clip(big - BLOCK_AT[k], 0, BLOCK_SIZE[k]).sum()
    return out.astype(np.int64)


def draw_strength(c: np.ndarray, t: np.ndarray, discount: float, strength: float, rng: np.random.Generator, more: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None) -> float:
    """A strength from its posterior under a Gamma(1, 1) prior, by auxiliary variables: a beta one for each restaurant's
    customers and a Bernoulli one for each of its tables after the first. Tables beyond the 4096th are drawn in blocks,
    over which the chance hardly changes. Restaurants beside these come as the tables of each block, numbers of customers
    and how many restaurants have each; logarithms of MANY_DRAWS betas of one kind are drawn as one normal sum."""
    each, (values, counts) = tables_after_first(t), np.unique(c[c > 1], return_counts=True)
    if more is not None:
        each = each + more[0]
        values, at = np.unique(np.r_[values, more[1]], return_inverse=True)
        counts = np.bincount(at, weights=np.r_[counts, more[2]], minlength=len(values)).astype(np.int64)
    there = each > 0
    fresh = int(rng.binomial(each[there], strength / (strength + discount * (BLOCK_AT + (BLOCK_SIZE - 1) / 2)[there])).sum())
    values, counts = values[(values > 1) & (counts > 0)], counts[(values > 1) & (counts > 0)]
    few = counts < MANY_DRAWS
    logs = float(np.log(np.maximum(rng.beta(strength + 1, np.repeat(values[few], counts[few]) - 1), 1e-300)).sum())
    for value, n in zip(values[~few], counts[~few], strict=True):
        at = strength + 1 + np.arange(int(value) - 1)
        logs += rng.normal(-n * (1 / at).sum(), np.sqrt(n * (1 / at**2).sum()))
    return float(max(1e-3, rng.gamma(1 + fresh) / (1 - logs)))


def seat(c: np.ndarray, a: np.ndarray, discount: float, rng: np.random.Generator) -> np.ndarray:
    """Tables that c customers of a dish take, where a is the weight of a new table. The first always opens one.

    Customer k opens a table with weight a against k - discount * tables. The first 64 are seated one at a time for
    all dishes at once; later ones in blocks of a quarter of those seated, over which the chance hardly changes.
    """
    out = np.minimum(c, 1).astype(np.float64)
    order = np.flatnonzero(c > 1)
    order = order[np.argsort(-c[order], kind="stable")]
    many, weight = c[order], a[order]
    t = np.ones(len(many))
    k = 1
    while True:
        n = int(np.searchsorted(-many, -k, side="left"))  # dishes with more than k customers
        if not n:
            break
        step = 1 if k < 64 else k // 4
        here = np.minimum(step, many[:n] - k)
        chance = weight[:n] / (weight[:n] + (k + (here - 1) / 2) - discount * t[:n])
        t[:n] += rng.random(n) < chance if step == 1 else rng.binomial(here, np.clip(chance, 0, 1))
        k += step
    out[order] = t
    return out


class Bucket:
    """The counts of one bucket, by words in order, and the seating of its words, sweep by sweep.

    A context's number is its place among those that every task holds or, after them, among the bucket's keys. Of
    these the customers are known, and the tables of each sweep as far as they have been sent."""

    def __init__(self, contexts: Contexts, h: np.ndarray, u: np.ndarray, c: np.ndarray, keys: np.ndarray | None = None, customers: np.ndarray | None = None, tables: list[np.ndarray] | None = None) -> None:
        none = np.zeros(0, dtype=np.int64)
        self.contexts = contexts
        self.keys, self.customers, self.tables = (none, none, [none] * (SWEEPS + 1)) if keys is None else (keys, customers, tables)
        self.asked, self.some = self.keys, np.ones(len(self.keys), dtype=bool)  # all keys, and which of them have restaurants
        self.parent, self.size = np.r_[contexts.parent, self.keys & (PARENTS - 1)], contexts.size + len(self.keys)
        new = np.r_[True, h[1:] != h[:-1]][: len(h)]
        self.words, self.of = h[new], np.cumsum(new) - 1
        self.u, self.c = u.astype(np.int64), c
        parent = self.of * PARENTS + self.parent[self.u]
        self.key = parent * self.size + self.u
        if (self.key[1:] < self.key[:-1]).any():
            order = np.argsort(self.key)
            self.key, parent, self.u, self.c = self.key[order], parent[order], self.u[order], self.c[order]
        new = np.r_[True, parent[1:] != parent[:-1]][: len(parent)]
        self.parent_key, self.to_parent = parent[new], np.cumsum(new) - 1
        self.parent_of, self.p = self.parent_key // PARENTS, self.parent_key % PARENTS
        self.count = np.bincount(self.of, weights=c, minlength=len(self.words))

    @classmethod
    def made(cls, contexts: Contexts, held: bytes, sent: dict[int, list[tuple[int, bytes]]]) -> Bucket:
        """The bucket of what dealt has made of it and what meetings have sent back, by their number."""
        words, many, u, c, keys, *rest = unpacked_arrays(held)
        if rest:
            return cls(contexts, np.repeat(words, many), u, c, keys, rest[0], rest[1:])
        back = lambda k: end_to_end([x for _, x in sorted(sent[k])])
        customers, dishes = back(0) if len(keys) else (keys, keys)
        h, some, asked = np.repeat(words, many), customers >= contexts.least, keys
        if not some.all():
            number = np.where(some, contexts.size + np.cumsum(some) - 1, keys & (PARENTS - 1))
            u = np.r_[np.arange(contexts.size), number][u]
            if contexts.least > 1:  # with 1, a context without customers is in no pair
                h, u, c = merge(h, u, c)
            keys, customers, dishes = keys[some], customers[some], dishes[some]
        b = cls(contexts, h, u, c, keys, customers, [dishes] * (SWEEPS + 1))
        b.asked, b.some = asked, some
        for k in range(1, SWEEPS):
            if k in sent:
                b.tables[k] = dishes.copy()
                b.tables[k][b.moving] += back(k)[0]
        if SWEEPS in sent:
            for k, x in zip(range(BURN_IN + 1, SWEEPS + 1), back(SWEEPS), strict=True):
                b.tables[k] = dishes + x[some]
        return b

    def packed(self) -> bytes:
        return packed_arrays([self.words, np.bincount(self.of, minlength=len(self.words)), self.u, self.c, self.keys, self.customers, *self.tables])

    def by_key(self, x: np.ndarray) -> np.ndarray:
        """Sums over the pairs of each key."""
        mine = self.u >= self.contexts.size
        return np.bincount(self.u[mine] - self.contexts.size, weights=x[mine], minlength=len(self.keys)).astype(np.int64)

    @functools.cached_property
    def moving(self) -> np.ndarray:
        """The keys whose tables may change here: only a word that follows more than once may take a second one."""
        return np.flatnonzero(self.by_key(self.c > 1))

    def numbers(self, u: np.ndarray) -> np.ndarray:
        """The numbers of contexts that are in every task or have a key; a word that doesn't occur in training has its ending's."""
        at = np.minimum(np.searchsorted(self.keys, u), max(0, len(self.keys) - 1))
        there = self.keys[at] == u if len(self.keys) else np.zeros(len(u), dtype=bool)
        return np.where(u >= 0, u, np.where(there, self.contexts.size + at, u & (PARENTS - 1)))

    def first(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """One table for each dish of a restaurant."""
        t = np.ones(len(self.c))
        pc = np.bincount(self.to_parent, weights=t, minlength=len(self.parent_key))
        pt = np.ones(len(pc))
        return t, pc, pt, np.bincount(self.parent_of, weights=pt, minlength=len(self.words)), np.ones(len(self.words))

    def totals(self, state: tuple) -> np.ndarray:
        t, pc, pt, rc, rt = state
        size = self.contexts.size
        return np.concatenate([np.bincount(self.u, weights=self.c, minlength=size)[:size], np.bincount(self.u, weights=t, minlength=size)[:size], np.bincount(self.p, weights=pc, minlength=PARENTS), np.bincount(self.p, weights=pt, minlength=PARENTS), [rc.sum(), rt.sum()]])

    def root(self, model: Model, at: Totals, rc: np.ndarray | float, rt: np.ndarray | float) -> np.ndarray | float:
        d, s = model.discount[2], at.strength[2]
        return (rc - d * rt + (s + d * at.root_t) * model.base) / (s + at.root_c)

    def sweeps(self, model: Model, seed: int, upto: int) -> Iterator[tuple]:
        """The seating of each sweep, every one given the totals of the sweep before."""
        state = self.first()
        yield state
        for k in range(1, upto + 1):
            at, rng = model.totals[k - 1], np.random.default_rng([seed, k])
            t, pc, pt, rc, rt = state
            root = self.root(model, at, rc, rt)
            dp, sp = model.discount[1], at.strength[1]
            above = (pc - dp * pt + (sp + dp * at.parent_t[self.p]) * root[self.parent_of]) / (sp + at.parent_c[self.p])
            dc, sc = model.discount[0], at.strength[0]
            t = seat(self.c, (sc + dc * np.r_[at.child_t, self.tables[k - 1]][self.u]) * above[self.to_parent], dc, rng)
            pc = np.bincount(self.to_parent, weights=t, minlength=len(self.parent_key))
            pt = seat(pc.astype(np.int64), (sp + dp * at.parent_t[self.p]) * root[self.parent_of], dp, rng)
            rc = np.bincount(self.parent_of, weights=pt, minlength=len(self.words))
            rt = seat(rc.astype(np.int64), np.full(len(rc), (at.strength[2] + model.discount[2] * at.root_t) * model.base), model.discount[2], rng)
            state = t, pc, pt, rc, rt
            yield state

    def probabilities(self, model: Model, seed: int, h: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(count of the word, probability of the word after the context averaged over the kept sweeps) of each query."""
        w = np.minimum(np.searchsorted(self.words, h), max(0, len(self.words) - 1))
        known = self.words[w] == h if len(self.words) else np.zeros(len(h), dtype=bool)
        u = self.numbers(u)
        p = self.parent[u]

        def find(keys: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            at = np.minimum(np.searchsorted(keys, key), max(0, len(keys) - 1))
            return at, known & (keys[at] == key) if len(keys) else known

        i, has = find(self.key, (w * PARENTS + p) * self.size + u)
        j, has_p = find(self.parent_key, w * PARENTS + p)
        take = lambda x, at, ok: np.where(ok, x[at], 0) if len(x) else np.zeros(len(at))
        total = np.zeros(len(h))
        for k, (t, pc, pt, rc, rt) in enumerate(self.sweeps(model, seed, SWEEPS)):
            if k <= BURN_IN:
                continue
            at = model.totals[k]
            root = self.root(model, at, take(rc, w, known), take(rt, w, known))
            d, s = model.discount[1], at.strength[1]
            above = (take(pc, j, has_p) - d * take(pt, j, has_p) + (s + d * at.parent_t[p]) * root) / (s + at.parent_c[p])
            d, s = model.discount[0], at.strength[0]
            child_c, child_t = np.r_[at.child_c, self.customers], np.r_[at.child_t, self.tables[k]]
            total += (take(self.c, i, has) - d * take(t, i, has) + (s + d * child_t[u]) * above) / (s + child_c[u])
        return take(self.count, w, known), total / (SWEEPS - BURN_IN)


def asking(n: int, b: int, keys: np.ndarray, rest: list[np.ndarray], again: bool = False) -> Iterator[tuple]:
    """What bucket b sends to each of n meetings about its keys; again: without the keys, which the meetings have."""
    at = meeting_of(keys, n)
    there = np.unique(at)
    for k, i, j in zip(there, np.searchsorted(at, there), np.searchsorted(at, there, side="right"), strict=True):
        yield int(k), (b, packed_arrays([x[i:j] for x in (rest if again else [keys, *rest])]))


@dataclass
class Held:
    """Buckets, dealt out once, and what meetings have sent back, dealt out alike: they come together where the buckets lie."""

    known: Broadcast
    buckets: RDD
    n: int  # of groups, and of meetings
    back: list[RDD]
    first: RDD | None = None  # what buckets have asked first

    def run(self, f: Callable[[Iterator[tuple[int, Bucket]], list], Iterator[tuple]], *more: RDD) -> RDD:
        """f over (bucket's number, bucket), and over what else is dealt out by groups: this comes into the list before the first bucket."""
        known = self.known

        def each(parts: Iterator[tuple]) -> Iterator[tuple]:
            sent: dict[int, dict[int, list]] = defaultdict(lambda: defaultdict(list))
            others: list = []

            def made() -> Iterator[tuple[int, Bucket]]:
                for _, x in parts:  # buckets come last
                    if not isinstance(x, tuple):
                        others.append(bytes(x))
                    elif len(x) > 2:
                        sent[x[0]][x[1]].append(x[2:])
                    else:
                        yield x[0], Bucket.made(known.value, x[1], sent.pop(x[0], {}))

            try:
                yield from f(made(), others)
            finally:
                give_back()

        return self.buckets.context.union([*more, *self.back, self.buckets]).mapPartitions(each)

    def meet(self, number: int, asked: RDD, add: Callable[[list[np.ndarray]], tuple[list[np.ndarray], list[np.ndarray]]]) -> list[tuple]:
        """Brings what buckets ask to the meetings of its keys: pairs of meeting and (bucket, arrays) with keys first. add
        makes of the arrays, end to end, those that go back, and what the driver gets; (-1 - k, numbers) are part k of sums."""
        n = self.n

        def run(parts: Iterator[tuple]) -> Iterator[tuple]:
            groups: dict[int, list] = defaultdict(list)
            for key, x in parts:
                groups[key].append(x)
            for key in [*groups]:
                some = groups.pop(key)
                if key < 0:
                    yield -1, ("sum", -1 - key, np.sum([np.frombuffer(x) for x in some], axis=0))
                    continue
                arrays: dict[int, list[np.ndarray]] = defaultdict(list)
                for b, x in some:  # what was asked first comes before what is asked again
                    arrays[b] += unpacked_arrays(x)
                out, told = add([np.concatenate(x) for x in zip(*arrays.values(), strict=True)])
                yield -1, ("told", key, packed_arrays(told))
                cuts = np.cumsum([len(x[0]) for x in arrays.values()])[:-1]
                for b, *x in zip(arrays, *(np.split(x, cuts) for x in out), strict=True):
                    yield b % n, (b, number, key, packed_arrays(x))
            give_back()

        parts = self.buckets.getNumPartitions()
        asked = asked.partitionBy(parts, itself)
        if number == 0 and self.first is None:
            self.first = asked
        met = (asked if number < SWEEPS else asked.context.union([self.first, asked])).mapPartitions(run)
        told = met.filter(lambda x: x[0] < 0).values().collect()
        if number in (0, SWEEPS):  # Spark drops the shuffles that nothing refers to any more
            give_back()
            asked.context._jvm.System.gc()
        self.back.append(met.filter(lambda x: x[0] >= 0).partitionBy(parts, itself))
        return told


def bin_of(c: np.ndarray) -> np.ndarray:
    return np.minimum(np.log2(c) * 4, BINS - 1).astype(np.int64)


def learn(held: Held) -> tuple[Model, int]:
    """Customers and dishes of the contexts by key, then one pass a sweep for the restaurants' totals, the first for discounts too; and the bin from which pairs are hot."""
    known, n = held.known, held.n

    def ask(parts: Iterator[tuple]) -> Iterator[tuple]:
        size = known.value.size
        for _, (b, x) in parts:
            *_, u, c, keys = unpacked_arrays(x)
            mine = u >= size
            yield from asking(n, b, keys, [np.bincount(u[mine] - size, weights=w, minlength=len(keys)).astype(np.int64) for w in (c[mine], None)])
        give_back()

    def totals_of(x: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
        keys, at = np.unique(x[0], return_inverse=True)
        found = [np.bincount(at, weights=w, minlength=len(keys)).astype(np.int64) for w in x[1:]]
        return at, found, (found[0] >= known.value.least) & (found[0] > 0)

    def first(x: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Back go customers and dishes; the driver gets how many contexts have how many customers, and tables of all and of those that stay as they are."""
        at, (c, d), some = totals_of(x)
        return [c[at], d[at]], [*np.unique(c[some], return_counts=True), tables_after_first(d[some]), tables_after_first(d[some & (c == d)])]

    told = [unpacked_arrays(x) for _, _, x in held.meet(0, held.buckets.mapPartitions(ask), first)]
    values, at = np.unique(np.concatenate([x[0] for x in told] or [np.zeros(0, dtype=np.int64)]), return_inverse=True)
    counts = np.bincount(at, weights=np.concatenate([x[1] for x in told] or [np.zeros(0)]), minlength=len(values)).astype(np.int64)
    begun, fixed = (sum((x[k] for x in told), np.zeros(len(BLOCK_AT), dtype=np.int64)) for k in (2, 3))

    contexts = known.value
    size = 2 * contexts.size + 2 * PARENTS + 2
    cuts = np.linspace(0, size + 8 + BINS, n + 1).astype(np.int64)
    model, found = Model((0.0, 0.0, 0.0), 0, 0, contexts, []), np.zeros(8 + BINS)

    def facts(b: Bucket) -> np.ndarray:
        """Tokens, words, dishes with one and two customers at each level, and pairs by the bin of their count."""
        _, pc, _, rc, _ = b.first()
        counts = [b.c.sum(), len(b.words), *(float((x == n).sum()) for x in (b.c, pc, rc) for n in (1, 2))]
        return np.r_[counts, np.bincount(bin_of(b.c), minlength=BINS)]

    def sweep(buckets: Iterator[tuple[int, Bucket]], _: list, sent: Broadcast) -> Iterator[tuple]:
        out, at = np.zeros(size + 8 + BINS), sent.value
        upto = len(at.totals)
        for k, b in buckets:
            *before, state = b.sweeps(at, k, upto)
            out[:size] += b.totals(state)
            if not upto:
                out[size:] += facts(b)
            elif upto == SWEEPS:
                more = [np.zeros(len(b.asked), dtype=np.int64) for _ in range(SWEEPS - BURN_IN)]
                for x, kept in zip(more, [*before, state][BURN_IN + 1 :], strict=True):
                    x[b.some] = b.by_key(kept[0] - 1)
                yield from asking(n, k, b.asked, more, again=True)
            else:
                some = b.moving
                yield from asking(n, k, b.keys[some], [x[some] for x in (b.tables[0], b.by_key(state[0] - 1))])
        for k in range(n):
            if out[cuts[k] : cuts[k + 1]].any():
                yield -1 - k, out[cuts[k] : cuts[k + 1]].tobytes()

    def middle(x: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Back go the tables after the first of each dish; the driver gets tables of the contexts that may change."""
        keys, one, at = np.unique(x[0], return_index=True, return_inverse=True)
        more = np.bincount(at, weights=x[2], minlength=len(keys)).astype(np.int64)
        return [more[at]], [tables_after_first(x[1][one] + more)]

    def last(x: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """The same of the sweeps that are kept, for all contexts."""
        at, (c, d, *more), some = totals_of(x)
        return [w[at] for w in more], [tables_after_first((d + more[-1])[some & (c > d)])]

    context, rng = held.buckets.context, np.random.default_rng(7)
    for k in range(SWEEPS + 1):
        sent = context.broadcast(model)  # totals of the contexts that every task holds, whose number is bounded above
        told, sums = held.meet(k, held.run(functools.partial(sweep, sent=sent)), last if k == SWEEPS else middle), np.zeros(size + 8 + BINS)
        each = fixed.copy() if k else begun
        for kind, at, x in told:
            if kind == "sum":
                sums[cuts[at] : cuts[at + 1]] += x
            else:
                each += unpacked_arrays(x)[0]
        if not k:
            found = sums[size:]
            discount = tuple(float(min(0.95, max(0.05, found[i] / max(1.0, found[i] + 2 * found[i + 1])))) for i in (2, 4, 6))
            model = Model(discount, int(found[0]), int(found[1]), contexts, [])
        made = Totals.cut(sums[:size], contexts.size)
        made.strength = made.drawn(model.discount, model.totals[-1].strength if model.totals else made.strength, rng, (each, values, counts))
        model = Model(model.discount, model.tokens, model.words, contexts, [*model.totals, made])
    hot = int(np.argmax(np.cumsum(found[8:][::-1])[::-1] <= HOT)) if found[8:].sum() > HOT else 0
    return model, hot if found[8:][hot:].sum() <= HOT else BINS


def pair(h: np.ndarray, u: np.ndarray) -> np.ndarray:
    """A key of a word and its context."""
    with np.errstate(over="ignore"):
        return h ^ ((u + 1).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)


@dataclass
class Hot:
    """The most frequent pairs: keys in order, words' counts, log10 probabilities; and the copies of each bucket."""

    keys: np.ndarray
    n: np.ndarray
    p: np.ndarray
    copies: np.ndarray

    @functools.cached_property
    def begins(self) -> np.ndarray:
        """Where the keys of each of 2^20 equal ranges begin."""
        return np.searchsorted(self.keys >> 44, np.arange(-(1 << 19), (1 << 19) + 1))

    def find(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, whether it is there) of each key; keys are hashes, so a range holds few."""
        part = (key >> 44) + (1 << 19)
        at, stop = self.begins[part], self.begins[part + 1]
        found = np.zeros(len(key), dtype=bool)
        left = np.flatnonzero(at < stop)
        while len(left):
            same = self.keys[at[left]] == key[left]
            found[left[same]] = True
            left = left[~same]
            at[left] += 1
            left = left[at[left] < stop[left]]
        return at, found


def hot_pairs(held: Held, sent: Broadcast, least: int, n: int) -> Hot:
    def score(buckets: Iterator[tuple[int, Bucket]], _: list) -> Iterator[tuple]:
        for k, b in buckets:
            some = bin_of(b.c) >= least
            h, u = b.words[b.of[some]], np.r_[np.arange(b.contexts.size), b.keys][b.u[some]]
            seen, p = b.probabilities(sent.value, k, h, u)
            yield k, int(b.c[~some].sum()), pair(h, u), seen, np.log10(p)

    found = held.run(score).collect()
    copies = np.ones(n, dtype=np.int64)
    if not found:
        return Hot(np.zeros(0, dtype=np.int64), np.zeros(0), np.zeros(0), copies)
    copies[[x[0] for x in found]] = np.clip(-(-np.array([x[1] for x in found]) // COPY_TOKENS), 1, held.n)
    k, seen, p = (np.concatenate([x[i] for x in found]) for i in (2, 3, 4))
    order = np.argsort(k)
    return Hot(k[order], seen[order], p[order], copies)


RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"
PART_BYTES = 16 << 20


def score_documents(df: DataFrame, held_out: Column | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row; learns from rows not held out."""
    held_out = F.coalesce(crc_rest(doc_id, 10) == 0 if held_out is None else held_out, F.lit(True))
    rows = df.select(F.col(doc_id).cast("long").alias("doc_id"), held_out.alias("held_out"), F.col(text).cast("binary").alias("text"))
    size = rows.agg(F.sum(F.octet_length("text") + 1)).first()[0] or 0
    n = max(8, -(-size // BUCKET_BYTES))
    salts = max(1, rows.rdd.getNumPartitions() // 256)
    spark, context = df.sparkSession, df.sparkSession.sparkContext
    contexts = context.broadcast(frequent_words(rows.where("not held_out").select("doc_id", "text"), n))
    groups = -(-n // GATHERED)
    held = Held(contexts, dealt(rows.select("held_out", "text"), n, salts, contexts), groups, [])
    model, least = learn(held)
    learned = context.broadcast(model)
    found = hot_pairs(held, learned, least, n)
    hot = context.broadcast(found)  # HOT pairs at most, and a number a bucket
    below = model.tokens + ADDED * (model.words + 1)
    parts_of_rows = max(8, -(-size // PART_BYTES))

    def send(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A text's own row, with what the hot words make, goes along with its other words, which go to their buckets' groups."""
        at_hand, contexts = hot.value, learned.value.contexts
        number, row = TaskContext.get().partitionId(), TaskContext.get().partitionId() << 36
        for part in parts:
            for k in range(0, part.num_rows, SLICE_ROWS):
                some = part.slice(k, SLICE_ROWS)
                t = read(some.column(2), contexts)
                many, begin = some.num_rows, row
                row += many
                context = t.contexts[t.before]
                at, is_hot = at_hand.find(pair(t.hashes[t.word], context))
                text, at = t.text[is_hot], at[is_hot]
                known = np.bincount(text, minlength=many)
                base = np.bincount(text, weights=np.log10((at_hand.n[at] + ADDED) / below), minlength=many)
                own_p = np.bincount(text, weights=at_hand.p[at], minlength=many)
                ids, out = some.column(0), some.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
                made = [(number % groups, packed_arrays([np.array([begin]), np.arange(many), known, base, own_p, t.sizes, out, np.asarray(ids.is_valid()).astype(np.int64), np.asarray(ids.fill_null(0))]))]
                rest = np.flatnonzero(~is_hot)
                bucket = buckets_of(t.hashes, n)
                key = ((bucket + number % at_hand.copies[bucket]) % groups * len(t.hashes) + np.arange(len(t.hashes)))[t.word[rest]]
                order = np.argsort(key)
                rest, key = rest[order], key[order]
                new = np.flatnonzero(np.r_[True, key[1:] != key[:-1]][: len(key)])
                words, times, group = t.word[rest[new]], np.diff(np.r_[new, len(key)]), key[new] // len(t.hashes)
                for g in np.unique(group):
                    i, j = np.searchsorted(group, [g, g + 1])
                    places = rest[new[i] : new[i] + times[i:j].sum()]
                    made.append((int(g), packed_arrays([np.array([begin]), t.hashes[words[i:j]], times[i:j], *parted(context[places]), t.text[places]])))
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in made], type=kind) for i, kind in enumerate((pa.int64(), pa.binary()))], names=["key", "packed"])

    def packed(row: np.ndarray, columns: list[np.ndarray]) -> Iterator[tuple[int, bytes]]:
        """Rows of texts by parts of the texts, so that few rows leave a group."""
        part = ((row.view(np.uint64) >> np.uint64(8)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(20)) % np.uint64(parts_of_rows)
        for k, at in runs(part.astype(np.int64), parts_of_rows):
            yield k, packed_arrays([row[at], *(x[at] for x in columns)])

    def look(buckets: Iterator[tuple[int, Bucket]], others: list) -> Iterator[tuple[int, bytes]]:
        """Sums by text of a group's words; the texts' own rows pass."""
        contexts, sums, asked = learned.value.contexts, [], {}

        def score(number: int, b: Bucket) -> None:
            if number not in asked:
                return
            h, u, row = asked.pop(number)
            order = np.argsort(h)  # in order they are found sooner
            h, u, row = h[order], u[order], row[order]
            seen, p = b.probabilities(learned.value, number, h, u)
            texts, at = np.unique(row, return_inverse=True)
            sums.append((texts, np.bincount(at, weights=seen > 0), np.bincount(at, weights=np.log10((seen + ADDED) / below)), np.bincount(at, weights=np.log10(p))))

        def begin() -> Iterator[tuple[int, bytes]]:
            found = []
            for x in others:
                from_row, *arrays = unpacked_arrays(x)
                if len(arrays) > 5:
                    yield from packed(from_row[0] + arrays[0], arrays[1:])
                else:
                    words, times, small, keys, of = arrays
                    found.append((np.repeat(words, times), joined(small, keys), from_row[0] + of))
            others.clear()
            if found:
                h, u, row = (np.concatenate(x) for x in zip(*found, strict=True))
                asked.update((k, (h[at], u[at], row[at])) for k, at in runs(buckets_of(h, n), n))

        begun = False
        for number, b in buckets:
            if not begun:
                yield from begin()
                begun = True
            score(number, b)
        if not begun:
            yield from begin()
        for number in [*asked]:  # no text in training has a word of these buckets
            score(number, Bucket(contexts, *(np.zeros(0, dtype=np.int64),) * 3))
        if sums:
            row, *columns = (np.concatenate(x) for x in zip(*sums, strict=True))
            texts, at = np.unique(row, return_inverse=True)
            known, base, score_of = (np.bincount(at, weights=x) for x in columns)
            yield from packed(texts, [known.astype(np.int64), base, score_of])

    def gather(group: pa.Table) -> pa.Table:
        """One row a text."""
        found = [unpacked_arrays(x.as_py()) for x in group["packed"]]
        own_rows = [np.concatenate(x) for x in zip(*(x for x in found if len(x) > 4), strict=True)]
        names, at = np.unique(np.concatenate([x[0] for x in found]), return_inverse=True)
        known, base, score = (np.bincount(at, weights=np.concatenate([x[i] for x in found])) for i in (1, 2, 3))
        order = np.argsort(own_rows[0])  # each text has one
        sizes, out, valid, ids = (x[order] for x in own_rows[4:])
        return pa.table([pa.array(ids, mask=valid == 0), pa.array(out != 0), pa.array(sizes), pa.array(known.astype(np.int64)), pa.array(base), pa.array(score)], names=[x.split(" ")[0] for x in RESULT.split(", ")])

    parts = held.buckets.getNumPartitions()
    sent = [rows.mapInArrow(per_task(send), PACKED).rdd.map(tuple).partitionBy(parts, itself)]
    copied = {int(k): int(found.copies[k]) for k in np.flatnonzero(found.copies > 1)}
    if copied:  # buckets of over COPY_TOKENS
        sent.append(held.run(lambda buckets, _: (((k + i) % groups, (k, b.packed())) for k, b in buckets for i in range(1, copied.get(k, 1)))).partitionBy(parts, itself))
    summed = spark.createDataFrame(held.run(look, *sent), PACKED, verifySchema=False)
    return summed.groupBy("key").applyInArrow(gather, RESULT).select("doc_id", "held_out", "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")
