"""Language identification by a linear-chain conditional random field over words.

States are the languages that the training rows name. A word's features are its affixes, its letter bigrams and
trigrams, and whether it is in the lexicon of a language; transitions between the languages of neighbouring words are
learned too. Training sequences splice runs of words of different languages, so that the chain learns how code-switched
text changes. Forward-backward gives every word a distribution over the languages; a text's score for a language is
the mean over its words.

The model is fitted on a bounded sample: about PER_LANGUAGE documents of each language, drawn by a hash of doc_id from
the rows that the caller allows, each giving RUNS runs of words from all over its text. Prediction reads whole texts of
all rows and nothing but the text.

Defined cases: a null text and one without letters are `und` with score 0; equal texts are predicted alike; if no row
may be learned from, every text is `und`; an empty table gives an empty result; other columns aren't read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import bounded_sample, crc_rest, per_task

BUCKETS = 1 << 16
#: Documents of a language to learn from; runs of words, spread over a whole text, and words of a run that one gives.
PER_LANGUAGE, RUNS, RUN = 400, 8, 32
#: Words in the lexicon of a language at most.
LEXICON = 400
#: Texts that a worker holds as words at once; enough of them that long ones are few to a batch.
SLICE_ROWS = 2500
UNKNOWN = "und"

_WORD, _LETTERS = re.compile(r"[^\W\d_]+"), regex.compile(r"\p{L}+")


def tokens(text: str | None) -> list[str]:
    """The lower-cased letter runs of a text."""
    found = _WORD.findall(text.lower()) if text else []
    return found if all(map(str.isalpha, found)) else [y for x in found for y in _LETTERS.findall(x)]  # without such as fractions


def sampled_runs(text: str | None, seed: int) -> list[str]:
    """Runs of a text's words at even distances over the whole of it, seed saying where they begin; all words of a short text."""
    words = tokens(text)
    if len(words) <= RUNS * RUN:
        return words
    step = len(words) // RUNS
    return [w for k in range(RUNS) for w in words[k * step + seed % (step - RUN + 1) :][:RUN]]


def features(word: str) -> list[int]:
    """Buckets of a word's affixes and letter n-grams."""
    framed = f"^{word}$"
    names = [f"{k}<{word[:k]}" for k in (1, 2, 3, 4)] + [f"{k}>{word[-k:]}" for k in (1, 2, 3, 4)]
    names += [framed[k : k + n] for n in (2, 3) for k in range(len(framed) - n + 1)]
    return [zlib.crc32(x.encode("utf-8", "surrogatepass")) % BUCKETS for x in names]


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # bucket by language
    lexicon: dict[str, int]  # word -> row of its weights
    lexicon_weights: np.ndarray
    start: np.ndarray
    moves: np.ndarray  # log potentials from, to
    held: dict[str, int] = field(default_factory=dict)
    rows: list[np.ndarray] = field(default_factory=list)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"held": {}, "rows": []}

    def fresh(self) -> Model:
        """The same model, remembering no words: a task's memory goes with it."""
        return replace(self, held={}, rows=[])

    def emissions(self, words: list[str]) -> np.ndarray:
        """Log potentials of each word; those of the words seen are kept, up to a fixed number."""
        if len(self.held) > 300_000:
            self.held.clear()
            self.rows.clear()
        new = list({w for w in words if w not in self.held})
        for k in range(0, len(new), 20_000):
            some = new[k : k + 20_000]
            at = len(self.held)
            self.held.update((w, at + n) for n, w in enumerate(some))
            lists = [features(w) for w in some]
            sizes = np.array([len(x) for x in lists])
            flat = np.fromiter((b for x in lists for b in x), dtype=np.int64, count=int(sizes.sum()))
            made = np.add.reduceat(self.weights[flat], np.cumsum(sizes) - sizes, axis=0) / np.sqrt(sizes)[:, None]
            known = [(n, self.lexicon[w]) for n, w in enumerate(some) if w in self.lexicon]
            if known:
                n, row = np.array(known).T
                made[n] += self.lexicon_weights[row]
            self.rows.append(made.astype(np.float32))
        if len(self.rows) > 1:
            self.rows[:] = [np.concatenate(self.rows)]
        return self.rows[0][np.fromiter(map(self.held.__getitem__, words), dtype=np.int64, count=len(words))]

    def marginals(self, emitted: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """P(language of a word | text) for the words of many texts, laid end to end in order of falling length."""
        first = np.cumsum(sizes) - sizes
        pots = np.exp(emitted - emitted.max(axis=1, keepdims=True))
        move, back = np.exp(self.moves), np.exp(self.moves).T
        ahead, behind = np.empty_like(pots), np.ones_like(pots)
        active = np.searchsorted(-sizes, -np.arange(int(sizes[0])), side="left")  # texts with more than t words
        ahead[first] = pots[first] * np.exp(self.start)
        ahead[first] /= ahead[first].sum(axis=1, keepdims=True)
        for t in range(1, int(sizes[0])):
            at = first[: active[t]] + t
            now = (ahead[at - 1] @ move) * pots[at]
            ahead[at] = now / now.sum(axis=1, keepdims=True)
        for t in range(int(sizes[0]) - 2, -1, -1):
            at = first[: active[t + 1]] + t
            now = (behind[at + 1] * pots[at + 1]) @ back
            behind[at] = now / now.sum(axis=1, keepdims=True)
        out = ahead * behind
        return out / out.sum(axis=1, keepdims=True)

    def predict(self, texts: list[str | None], most_words: int = 300_000) -> tuple[list[str], np.ndarray, np.ndarray]:
        """(language, score, how sure its words' own languages are on average) of each text."""
        named, score, sure = [UNKNOWN] * len(texts), np.zeros(len(texts)), np.zeros(len(texts))
        if not self.languages:
            return named, score, sure
        cut = [tokens(x) for x in texts]
        order = sorted((k for k, x in enumerate(cut) if x), key=lambda k: -len(cut[k]))
        while order:  # texts of like length together, about most_words at a time
            total, n = 0, 0
            while n < len(order) and (not n or total + len(cut[order[n]]) <= most_words):
                total += len(cut[order[n]])
                n += 1
            some, order = order[:n], order[n:]
            sizes = np.array([len(cut[k]) for k in some])
            found = self.marginals(self.emissions([w for k in some for w in cut[k]]), sizes)
            begin = np.cumsum(sizes) - sizes
            mean = np.add.reduceat(found.astype(np.float64), begin, axis=0) / sizes[:, None]
            sure[some] = np.add.reduceat(found.max(axis=1).astype(np.float64), begin) / sizes
            for k, row in zip(some, mean, strict=True):
                best = int(row.argmax())  # the first of equals
                named[k], score[k] = self.languages[best], min(1.0, float(row[best]))
        return named, score, sure


def fit(passages: dict[str, list[list[str]]], sequences: int = 2400, length: int = 40, epochs: int = 4, rate: float = 0.25) -> Model:
    """Maximises the conditional likelihood of spliced sequences by AdaGrad. passages: language -> word lists."""
    languages = sorted(k for k, v in passages.items() if any(v))
    size = len(languages)
    if not size:
        return Model([], np.zeros((BUCKETS, 0)), {}, np.zeros((0, 0)), np.zeros(0), np.zeros((0, 0)))
    counts = {k: Counter(w for x in passages[k] for w in x) for k in languages}
    totals = {k: sum(c.values()) for k, c in counts.items()}
    lexicon: dict[str, int] = {}
    for k in languages:
        for w, n in sorted(counts[k].items(), key=lambda x: (-x[1], x[0]))[:LEXICON]:
            if n >= 5 and n / totals[k] >= 3 * max((counts[o][w] / totals[o] for o in languages if o != k), default=0):
                lexicon.setdefault(w, len(lexicon))
    model = Model(languages, np.zeros((BUCKETS, size)), lexicon, np.zeros((max(1, len(lexicon)), size)), np.zeros(size), np.zeros((size, size)))
    rng = np.random.default_rng(13)
    streams = {k: [w for x in passages[k] for w in x] for k in languages}
    made: list[tuple[list[str], list[int]]] = []
    for _ in range(sequences):
        ws: list[str] = []
        ys: list[int] = []
        while len(ws) < length:
            k = int(rng.integers(size))
            run, stream = 1 + int(rng.geometric(1 / 20)), streams[languages[k]]
            at = int(rng.integers(max(1, len(stream) - run)))
            ws += stream[at : at + run]
            ys += [k] * len(stream[at : at + run])
        made.append((ws[:length], ys[:length]))
    hashed: dict[str, list[int]] = {}
    squares = [np.full_like(x, 1e-3) for x in (model.weights, model.lexicon_weights, model.start, model.moves)]
    for epoch in range(epochs):
        order = rng.permutation(len(made))
        for k in range(0, len(order), 48):
            some = [made[i] for i in order[k : k + 48]]
            ws = [w for x, _ in some for w in x]
            y = np.array([x for _, x in some])
            for w in set(ws) - hashed.keys():
                hashed[w] = features(w)
            sizes = np.array([len(hashed[w]) for w in ws])
            flat = np.concatenate([hashed[w] for w in ws])
            begin, scale = np.cumsum(sizes) - sizes, 1 / np.sqrt(sizes)
            known = np.array([(n, lexicon[w]) for n, w in enumerate(ws) if w in lexicon], dtype=np.int64).reshape(-1, 2)
            emitted = np.add.reduceat(model.weights[flat], begin, axis=0) * scale[:, None]
            np.add.at(emitted, known[:, 0], model.lexicon_weights[known[:, 1]])
            pots = np.exp(emitted - emitted.max(axis=1, keepdims=True)).reshape(len(some), length, size)
            move = np.exp(model.moves)
            ahead, behind = np.empty_like(pots), np.ones_like(pots)
            ahead[:, 0] = pots[:, 0] * np.exp(model.start)
            ahead[:, 0] /= ahead[:, 0].sum(axis=1, keepdims=True)
            for t in range(1, length):
                now = (ahead[:, t - 1] @ move) * pots[:, t]
                ahead[:, t] = now / now.sum(axis=1, keepdims=True)
            pairs = np.zeros((size, size))
            for t in range(length - 2, -1, -1):
                right = behind[:, t + 1] * pots[:, t + 1]
                joint = ahead[:, t, :, None] * move * right[:, None, :]
                pairs += (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
                now = right @ move.T
                behind[:, t] = now / now.sum(axis=1, keepdims=True)
            gamma = ahead * behind
            gamma /= gamma.sum(axis=2, keepdims=True)
            truth = np.eye(size)[y]
            slope = (truth - gamma).reshape(-1, size)
            seen = np.zeros((size, size))
            np.add.at(seen, (y[:, :-1].ravel(), y[:, 1:].ravel()), 1)
            spread = np.repeat(slope * scale[:, None], sizes, axis=0)
            grads = [np.stack([np.bincount(flat, weights=spread[:, c], minlength=BUCKETS) for c in range(size)], axis=1), np.zeros_like(model.lexicon_weights), (truth - gamma)[:, 0].sum(axis=0), seen - pairs]
            np.add.at(grads[1], known[:, 1], slope[known[:, 0]])
            for value, grad, square in zip((model.weights, model.lexicon_weights, model.start, model.moves), grads, squares, strict=True):
                square += grad * grad
                value += rate * grad / np.sqrt(square)
    model.weights, model.lexicon_weights = model.weights.astype(np.float32), model.lexicon_weights.astype(np.float32)
    return model


def train(df: DataFrame, allowed: Column | None = None, per_language: int = PER_LANGUAGE, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> Model:
    """Fits a model on words of about per_language rows of each language. allowed: a condition on the rows to learn from."""
    rows = df.where(F.col(lang).isNotNull() & F.col(doc_id).isNotNull())
    if allowed is not None:
        rows = rows.where(allowed)
    chosen = bounded_sample(rows.select(F.col(doc_id).alias("__id"), F.col(lang).cast("string").alias("__lang"), F.col(text).alias("__text")), "__id", "__lang", per_language)

    def draw(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            words = [sampled_runs(x, seed) for x, seed in zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(words, type=pa.list_(pa.string()))], names=["id", "lang", "words"])

    found = chosen.select(F.col("__id").cast("string"), "__lang", "__text", F.pmod(F.xxhash64(F.col("__id"), F.lit("place")), F.lit(1 << 30))).mapInArrow(per_task(draw, 1000), "id string, lang string, words array<string>").collect()
    passages: dict[str, list[list[str]]] = {}
    for r in sorted(found, key=lambda r: (r["lang"], r["id"], r["words"])):
        passages.setdefault(r["lang"], []).append(r["words"])
    return fit(passages)


def predictions(df: DataFrame, model: Model, held_out: Column, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row."""
    shared = df.sparkSession.sparkContext.broadcast(model)  # BUCKETS rows of weights

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value.fresh()
        for part in parts:
            named, score, _ = model.predict(part.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(named, type=pa.string()), pa.array(score)], names=["doc_id", "held_out", "lang_pred", "score"])

    return df.select(F.col(doc_id).cast("long").alias("doc_id"), held_out.alias("held_out"), F.col(text).alias("text")).mapInArrow(per_task(run, SLICE_ROWS), "doc_id long, held_out boolean, lang_pred string, score double")


def keep_identified(df: DataFrame, model: Model, least: float = 0.5, text: str = "text") -> DataFrame:
    """The rows of df, with all their columns, whose words have a language each with at least that probability on average.

    A text of several languages stays if its words are clear. Without any language to know, all rows stay.
    """
    if not model.languages:
        return df
    shared, place = df.sparkSession.sparkContext.broadcast(model), df.columns.index(text)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value.fresh()
        for part in parts:
            named, _, sure = model.predict(part.column(place).to_pylist())
            yield part.filter(pa.array([n != UNKNOWN and s >= least for n, s in zip(named, sure, strict=True)], type=pa.bool_()))

    return df.mapInArrow(per_task(run, SLICE_ROWS), df.schema)


def identify(docs: DataFrame) -> DataFrame:
    """Learns from rows whose crc32(doc_id as text) mod 4 isn't 2 and predicts the language of every row."""
    return predictions(docs, train(docs, crc_rest("doc_id", 4) != 2), crc_rest("doc_id", 4) == 2)
