import itertools
import random
import re

from lattica.llm import chat


def brute(rows):
    """(conv, turn, role, text) -> {(conv, turn): (text, n_quoted, reply_to, thread)} and the order of each conversation."""
    level = lambda x: re.match(r"(?:[ \t]*>)*", x)[0].count(">")
    plain = lambda x: re.sub(r"[ \t\x0b\f\r]+", " ", x[re.match(r"(?:[ \t]*>)*", x).end() :]).lower().strip(" ")

    def runs(text):
        """(level, lines) of each passage."""
        found = [(k, [plain(x) for x in g if plain(x)]) for k, g in itertools.groupby(text.split("\n") if text is not None else [], key=level)]
        return [x for x in found if x[1]]

    out = {}
    for c, t, _, text in rows:
        votes = {}
        for k, lines in runs(text):
            whole = [u for d, u, _, other in rows if d == c and k and (k - 1, lines) in runs(other)]
            if whole and min(whole) < t:
                votes[k, min(whole)] = votes.get((k, min(whole)), 0) + len(lines)
                continue
            for x in lines if k else []:
                sources = [u for d, u, _, other in rows if d == c and any(not j and x in said for j, said in runs(other))]
                if sources and min(sources) < t:
                    votes[k, min(sources)] = votes.get((k, min(sources)), 0) + 1
        near = min((k for k, _ in votes), default=None)
        to = max(((n, s) for (k, s), n in votes.items() if k == near), default=(0, None))[1]
        ls = None if text is None else text.split("\n")
        out[c, t] = [None if ls is None else "\n".join(x for x in ls if not level(x)), sum(level(x) > 0 for x in ls or []), to]
    for (c, t), r in out.items():
        at = t
        while out[c, at][2] is not None:
            at = out[c, at][2]
        r.append(at)
    order = {}
    for c, t in sorted(out, key=lambda k: (k[0], out[k][3], k[1])):
        order.setdefault(c, []).append(t)
    return out, order


def check(df, rows):
    out, order = brute(rows)
    found = chat.conversations(df).collect()
    assert {(r.conv_id, r.turn): [r.text, r.n_quoted, r.reply_to, r.thread] for r in found} == out
    assert {c: [r.turn for r in sorted(found, key=lambda r: r.position) if r.conv_id == c] for c in order} == order
    assert sorted(r.position for r in found) == sorted(k for v in order.values() for k in range(len(v)))


def test_random_quotes_against_brute_force(spark):
    rng = random.Random(1)
    rows, said = [], ["alpha beta", "gamma", "delta  one", "Epsilon", "zeta", "eta"]
    for c in range(12):
        for t in range(rng.randrange(1, 9)):
            lines = [rng.choice(["", "", "", "> ", ">> ", " > > ", ">"]) + rng.choice([*said, f"line {c} {t}", "ALPHA   beta ", ""]) for _ in range(rng.randrange(1, 7))]
            rows.append((c, t, "user", "\n".join(lines)))
    check(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4), rows)


def test_long_chain_and_edges(spark):
    rows = [(1, 0, "user", "message 0")] + [(1, t, "user", f"> message {t - 1}\nmessage {t}") for t in range(1, 40)]
    rows += [(2, 0, None, None), (2, 1, "user", ""), (2, 2, "user", ">"), (2, 3, "user", "> never said"), (2, 4, "user", "own\n> own"), (3, 7, "user", "x\r\n> y" * 50)]
    df = spark.createDataFrame([(*r, "k", 1) for r in rows], "conv_id long, turn long, role string, text string, key string, level int")
    check(df, rows)
    assert chat.conversations(df.limit(0)).count() == 0
    odd = spark.createDataFrame([(None, 1, "u", "a"), (1, None, "u", "> a"), (1, 1, "u", "a"), (1, 1, "u", "a")], "conv_id long, turn long, role string, text string")
    found = chat.conversations(odd).collect()
    assert len(found) == 4 and all(r.reply_to is None for r in found)
    assert sorted(str(r.position) for r in found) == ["0", "1", "2", "None"]


def test_passages_go_before_lines_and_nested_levels_link(spark):
    rows = [
        (1, 0, "u", "yes"), (1, 1, "u", "one\ntwo"), (1, 2, "u", "two\n\nthree"),
        (1, 3, "u", "> two\n>\n>   THREE\nI agree"),  # whole in 2, though 1 said "two" before
        (1, 4, "u", ">> two\n>> three\nonly nested"),  # quoted once by 3
        (1, 5, "u", "> one\n> two\n> edited\n\n> yes\nno"),  # two lines of 1 against a whole passage of 0
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    check(df, rows)
    assert {r.turn: r.reply_to for r in chat.conversations(df).collect()} == {0: None, 1: None, 2: None, 3: 2, 4: 3, 5: 1}


def test_plan_is_native(spark):
    df = spark.createDataFrame([(1, 0, "u", "a"), (1, 1, "u", "> a\nb")], "conv_id long, turn long, role string, text string")
    plan = chat.conversations(df)._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas|CartesianProduct|NestedLoop", plan)
