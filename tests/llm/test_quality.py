import random

from lattica.llm import quality
from lattica.llm.quality import Text, repeated_words

from tests.llm.conftest import EDGE_TEXTS


def slow_repeats(words):
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    return len({i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(5)})


def test_repeated_words_against_brute_force():
    rng = random.Random(1)
    for _ in range(200):
        words = rng.choices("abc", k=rng.randrange(40))
        assert repeated_words(words) == slow_repeats(words)


def test_figures():
    t = Text("one two\none two\n\n#a |b|")
    assert (len(t.words), t.word_chars, t.n_symbols, t.n_dup_lines) == (6, 17, 3, 1)


def test_order_never_changes_a_verdict(spark, edge_docs):
    a = quality.measures(edge_docs, order=quality.RULES).collect()
    b = quality.measures(edge_docs, order=quality.RULES[::-1]).collect()
    assert sorted(a, key=str) == sorted(b, key=str)
    assert len(a) == edge_docs.count()


def test_keep_clean_keeps_columns_and_agrees(spark, edge_docs, no_docs):
    kept = quality.keep_clean(edge_docs)
    assert kept.columns == edge_docs.columns
    want = sorted(str(r.doc_id) for r in quality.measures(edge_docs).where("kept").collect())
    assert sorted(str(r.doc_id) for r in kept.collect()) == want
    assert quality.measures(no_docs).count() == 0 and quality.keep_clean(no_docs).count() == 0


def test_sample_order_holds_every_rule(spark, edge_docs):
    assert {r.name for r in quality.cascade_order(edge_docs)} == {r.name for r in quality.RULES}


def test_greedy_order_counts_paid_views_and_rejected_documents():
    by = {r.name: k for k, r in enumerate(quality.RULES)}
    bit = lambda *names: sum(1 << by[n] for n in names)
    cost = {v: 1.0 for v in quality.VIEWS} | {"words": 10.0, "n_symbols": 5.0}
    found = [(bit("few_words", "word_length"), 10, cost), (bit("symbols"), 3, cost), (bit("duplicate_lines"), 8, cost), (0, 50, cost)]
    names = [r.name for r in quality.greedy_order(quality.RULES, found)]
    assert names[0] == "duplicate_lines"  # 8 in 2 x 4 seconds; few_words 10 in 10 x 4
    assert names[1] == "few_words" and names[2] == "symbols"  # its words are paid; word_length rejects none of what is left
    assert set(names) == set(by)
    paid = [r.name for r in quality.greedy_order(quality.RULES, found, quality.FIGURES)]
    assert paid[0] == "few_words"  # all views are there, so the most rejections come first


def test_junk_goes_and_prose_stays():
    prose = " ".join(f"word{k} of{k} some{k}" for k in range(40))
    assert quality.passes(Text(prose), quality.RULES)
    for junk in ("too short", "a b c d e f " * 50, " ".join(f"w{k}###" for k in range(50)), " ".join(f"LOUD{k}!!" for k in range(50)), EDGE_TEXTS[-1]):
        assert not quality.passes(Text(junk), quality.RULES)
