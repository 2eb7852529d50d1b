"""Quality rules as a short-circuit cascade.

Every rule looks at views of a text and rejects or passes it. A sample of the table tells what each view costs and
which rules reject which documents. The cascade is then built greedily: next comes the rule with the most rejections
per second among the documents that the rules before it leave, where views that those have paid for cost nothing. A
text leaves at the first rule that rejects it. The order never changes a verdict, only what it costs.

Defined cases: a null or empty text has no words and is rejected by ``few_words``; documents with equal rows are
judged alike, row by row; an empty table gives an empty result; other columns pass through unread.
"""

from __future__ import annotations

import time
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import WORD, per_task

#: Fixed values of the contract.
SYMBOLS = "#*$%&|<>"
WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20


def repeated_words(words: list[str], size: int = WINDOW) -> int:
    """Words inside windows of that size that the list holds twice or more, first ones included."""
    if len(words) <= size:
        return 0
    windows = list(zip(*(words[k:] for k in range(size)), strict=False))
    if len(seen := set(windows)) == len(windows):
        return 0
    del seen
    counts = Counter(windows)
    covered, until = 0, 0
    for start, window in enumerate(windows):
        if counts[window] > 1:
            covered += start + size - max(start, until)
            until = start + size
    return covered


class Text:
    """A text and the figures that rules ask for, each found once and only when asked for."""

    def __init__(self, text: str | None) -> None:
        self.text = text or ""

    @cached_property
    def words(self) -> list[str]:
        return WORD.findall(self.text)

    @cached_property
    def word_chars(self) -> int:
        return sum(map(len, self.words))

    @cached_property
    def n_symbols(self) -> int:
        return sum(map(self.text.count, SYMBOLS))

    @cached_property
    def lines(self) -> list[str]:
        return [x for x in self.text.split("\n") if WORD.search(x)]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def n_repeat_words(self) -> int:
        return repeated_words(self.words)

    @cached_property
    def n_upper(self) -> int:
        return sum(1 for w in self.words if w.isupper() and len(w) > 1)

    @cached_property
    def n_runs(self) -> int:
        """Words equal to the word before, commas and case apart."""
        plain = [w.rstrip(",.").lower() for w in self.words]
        return sum(a == b for a, b in zip(plain, plain[1:], strict=False))

    @cached_property
    def top_share(self) -> float:
        return max(Counter(self.words).values(), default=0) / max(1, len(self.words))


#: Views in an order in which each comes after the one that it is made of.
VIEWS = {"words": None, "word_chars": "words", "n_symbols": None, "lines": None, "n_dup_lines": "lines", "n_repeat_words": "words", "n_upper": "words", "n_runs": "words", "top_share": "words"}


@dataclass(frozen=True)
class Rule:
    """views: those that the rule asks for; what they are made of need not be named."""

    name: str
    views: tuple[str, ...]
    rejects: Callable[[Text], bool]

    def needs(self) -> set[str]:
        return {x for v in self.views for x in (v, VIEWS[v]) if x}


#: The base rules of the contract, then the method's own. Thresholds sit far from running prose.
BASE = (
    Rule("few_words", ("words",), lambda t: len(t.words) < MIN_WORDS),
    Rule("repeated_windows", ("n_repeat_words",), lambda t: 100 * t.n_repeat_words > MAX_REPEAT_PERCENT * len(t.words)),
)
RULES = (
    *BASE,
    Rule("symbols", ("n_symbols", "words"), lambda t: 5 * t.n_symbols > len(t.words)),
    Rule("duplicate_lines", ("n_dup_lines",), lambda t: 2 * t.n_dup_lines > len(t.lines)),
    Rule("word_length", ("word_chars",), lambda t: not 2 * len(t.words) <= t.word_chars <= 15 * len(t.words)),
    Rule("shouting", ("n_upper",), lambda t: 2 * t.n_upper > len(t.words)),
    Rule("word_runs", ("n_runs",), lambda t: 5 * t.n_runs > len(t.words)),
    Rule("one_word", ("top_share",), lambda t: 10 * t.top_share > 4),
)
#: The views behind the figures that measures returns of every text.
FIGURES = frozenset({"words", "word_chars", "n_symbols", "lines", "n_dup_lines", "n_repeat_words"})


def passes(text: Text, rules: tuple[Rule, ...]) -> bool:
    """Whether no rule rejects the text; stops at the first that does."""
    return not any(rule.rejects(text) for rule in rules)


def greedy_order(rules: tuple[Rule, ...], found: list[tuple[int, int, dict[str, float]]], paid: frozenset[str] = frozenset()) -> tuple[Rule, ...]:
    """The rules by marginal rejections per marginal second.

    found: (bits of the rules that reject, documents, seconds of each view) of documents with the same verdicts. paid:
    views that are made in any case. Rules that reject none of what is left come last, the cheapest first.
    """
    left, have, out = list(found), set(paid), []
    rest = list(range(len(rules)))
    while rest:
        worth = {}
        for k in rest:
            seconds = sum(x.get(v, 0.0) for _, _, x in left for v in rules[k].needs() - have)
            rejected = sum(n for bits, n, _ in left if bits >> k & 1)
            worth[k] = (rejected / (seconds + 1e-9 * (1 + sum(n for _, n, _ in left))), -seconds, -k)
        best = max(rest, key=worth.__getitem__)
        rest.remove(best)
        out.append(rules[best])
        have |= rules[best].needs()
        left = [x for x in left if not x[0] >> best & 1]
    return tuple(out)


def cascade_order(df: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES, sample_rows: int = 2000, paid: frozenset[str] = frozenset()) -> tuple[Rule, ...]:
    """greedy_order of the rules on about sample_rows rows (a bound on the sample, not on df).

    The sample is measured where it lies; only seconds and counts of documents with the same verdicts come to the driver.
    """
    total = df.count()
    if not total:
        return rules
    rows = df.select(text).sample(min(1.0, sample_rows / total), seed=7)

    def measure(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[int] = Counter()
        seconds: Counter[tuple[int, str]] = Counter()
        for part in parts:
            for value in part.column(0).to_pylist():
                t, spent = Text(value), {}
                for view in VIEWS:  # each after what it is made of, so a view's time is its own
                    began = time.perf_counter()
                    getattr(t, view)
                    spent[view] = time.perf_counter() - began
                bits = sum(1 << k for k, rule in enumerate(rules) if rule.rejects(t))
                counts[bits] += 1
                seconds.update({(bits, v): x for v, x in spent.items()})
        keys = list(seconds)
        yield pa.RecordBatch.from_pydict({"bits": pa.array([b for b, _ in keys], type=pa.int64()), "view": pa.array([v for _, v in keys], type=pa.string()), "documents": pa.array([counts[b] for b, _ in keys], type=pa.int64()), "seconds": pa.array([seconds[k] for k in keys], type=pa.float64())})

    by: dict[int, tuple[int, dict[str, float]]] = {}
    for r in rows.mapInArrow(per_task(measure, 1000), "bits long, view string, documents long, seconds double").groupBy("bits", "view").agg(F.sum("documents").alias("documents"), F.sum("seconds").alias("seconds")).collect():
        by.setdefault(r["bits"], (r["documents"], {}))[1][r["view"]] = r["seconds"]
    return greedy_order(rules, [(bits, n, x) for bits, (n, x) in sorted(by.items())], paid)


def measures(df: DataFrame, doc_id: str = "doc_id", text: str = "text", order: tuple[Rule, ...] | None = None) -> DataFrame:
    """The figures and verdicts of every document: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept."""
    order = order or cascade_order(df, text, paid=FIGURES)

    def judge(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            out: dict[str, list] = {k: [] for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")}
            for value in part.column(1).to_pylist():
                t = Text(value)
                kept, sound = passes(t, order), passes(t, BASE)
                for k, v in zip(out, (len(t.words), t.word_chars, t.n_symbols, t.n_dup_lines, t.n_repeat_words, not sound, kept and sound), strict=True):
                    out[k].append(v)
            yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(v, type=pa.bool_() if k in ("base_failed", "kept") else pa.int64()) for k, v in out.items())], names=["doc_id", *out])

    return df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(per_task(judge, 1000), "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean")


def keep_clean(df: DataFrame, text: str = "text", order: tuple[Rule, ...] | None = None) -> DataFrame:
    """The rows of df, with all their columns, whose text no rule rejects; the cascade stops at the first rejection."""
    order = order or cascade_order(df, text)
    place = df.columns.index(text)

    def choose(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            yield part.filter(pa.array([passes(Text(x), order) for x in part.column(place).to_pylist()], type=pa.bool_()))

    return df.mapInArrow(per_task(choose, 1000), df.schema)
