"""A text front end: array expressions in glyphs, read right to left, over distributed arrays.

    Session(spark).run("+´ 2 × ↕5000000")

Values are numbers, strings and arrays (DArray). Functions take one or two arguments; 1-modifiers (´ ˝ ` ˘ ¨ ˜ ⁼ ˙ ⌜)
stand after their function, 2-modifiers (∘ ○ ⊸ ⟜ ⊘ ◶ ⌾ ⍟ ⎊) between two. Two functions in a row are an atop, three a
fork. {…} is a block of 𝕩 and 𝕨, its bodies parted by ; with predicates before ?, ← names a value, ⋄ parts statements, ‿ and ⟨⟩ make lists, # begins a comment. Array
values stay plans until a result is shown. Arrays from tables are put in with ``bind``.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from typing import Any

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from lattica.darray import DArray, Engine
from lattica.errors import ArrayError, DomainError
from lattica.functions import numeric as num
from lattica.operators import combinators as comb
from lattica.operators import fold, linalg, order, pervasive, scan, search, selection, sets, structural

#: Pervasive glyphs: (of one argument, of two, the fold's name).
PERVASIVE: dict[str, tuple[Callable | None, Callable | None, str | None]] = {
    "+": (num.identity, num.add, "add"),
    "-": (num.negate, num.subtract, "subtract"),
    "×": (num.sign, num.multiply, "multiply"),
    "÷": (num.reciprocal, num.divide, "divide"),
    "⋆": (num.exp, num.power, None),
    "√": (num.sqrt, num.root, None),
    "⌊": (num.floor, num.minimum, "minimum"),
    "⌈": (num.ceiling, num.maximum, "maximum"),
    "|": (num.absolute, num.modulus, None),
    "¬": (num.complement, num.span, None),
    "∧": (None, num.both, "both"),
    "∨": (None, num.either, "either"),
    "=": (None, num.equal, None),
    "≠": (None, num.unequal, None),
    "<": (None, num.less, None),
    ">": (None, num.greater, None),
    "≤": (None, num.at_most, None),
    "≥": (None, num.at_least, None),
}
FUNCTIONS = set(PERVASIVE) | set("⊣⊢⥊∾≍⋈↑↓↕«»⌽⍉/⊏⊑⊐⊒∊⍷⊔⍋⍒≡≢!")
ONE, TWO = set("˙˜˘¨⌜⁼´˝`"), set("∘○⊸⟜⊘◶⌾⍟⎊")
#: Names of inverses by glyph.
UNDONE = {"-": "negate", "÷": "reciprocal", "¬": "complement", "⋆": "exp", "√": "sqrt", "+": "identity"}
UNDONE_RIGHT = {"+": "add", "-": "subtract", "×": "multiply", "÷": "divide", "⋆": "power", "√": "root"}

_TOKEN = re.compile(r"""\s*(?:(#[^\n]*)|("(?:[^"]|"")*")|('.')|(¯?(?:∞|π|[0-9][0-9_]*(?:\.[0-9]+)?(?:[eE]¯?[0-9]+)?))|([𝕩𝕨𝕏𝕎𝕊𝕤])|([A-Za-z][A-Za-z0-9_]*)|([⋄,\n])|(\S))""")


class Fn:
    """A function with its glyph and operand, so that modifiers can choose a plan by them."""

    def __init__(self, call: Callable, glyph: str | None = None, held: Any = None) -> None:
        self.call, self.glyph, self.held = call, glyph, held

    def __call__(self, x: Any, w: Any = None) -> Any:
        return self.call(x, w)


def tokens(text: str) -> list[tuple[str, Any]]:
    out: list[tuple[str, Any]] = []
    at = 0
    text = text.rstrip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        at = m.end()
        comment, string, char, number, special, name, stop, glyph = m.groups()
        if comment is not None:
            continue
        if string is not None:
            out.append(("value", string[1:-1].replace('""', '"')))
        elif char is not None:
            out.append(("value", Char(char[1])))
        elif number is not None:
            plain = number.replace("_", "").replace("¯", "-")
            out.append(("value", {"∞": float("inf"), "-∞": float("-inf"), "π": 3.141592653589793, "-π": -3.141592653589793}.get(plain) if plain.lstrip("-") in "∞π" else float(plain)))
        elif special is not None:
            out.append(("name", special))
        elif name is not None:
            out.append(("name", name))
        elif stop is not None:
            out.append(("stop", stop))
        else:
            out.append(("glyph", glyph))
    return out


class Char(str):
    """One character, which is no list."""


class Session:
    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.engine = spark, Engine(spark)
        self.names: dict[str, Any] = {}

    def bind(self, name: str, value: Any) -> None:
        self.names[name] = value

    def run(self, text: str) -> Any:
        """The value of the last statement."""
        found, rest = self._statements(tokens(text), dict(self.names), top=True)
        if rest:
            raise DomainError(f"unexpected {rest[0][1]}")
        return found

    def show(self, text: str) -> Any:
        """run, with arrays as nested lists."""
        out = self.run(text)
        return self._shown(out)

    def _shown(self, out: Any) -> Any:
        if isinstance(out, DArray):
            got = out.collect()
            return "".join(got) if out.kind == "c" and out.rank == 1 else got
        return [self._shown(x) for x in out] if isinstance(out, list) else out

    # reading

    def _statements(self, toks: list, scope: dict, top: bool = False, close: str | None = None) -> tuple[Any, list]:
        out = None
        while toks:
            if toks[0][0] == "stop":
                toks = toks[1:]
                continue
            if close and toks[0] == ("glyph", close):
                return out, toks[1:]
            part, depth, n = [], 0, 0
            for n, (kind, v) in enumerate(toks):
                if depth == 0 and (kind == "stop" or (close and v == close and kind == "glyph")):
                    break
                depth += kind == "glyph" and v in "({⟨["
                depth -= kind == "glyph" and v in ")}⟩]"
                part.append((kind, v))
            else:
                n += 1
            toks = toks[n:]
            out = self._statement(part, scope)
            if top:
                self.names.update({k: v for k, v in scope.items() if len(k) > 1 or k.isascii()})
        return out, toks

    def _statement(self, part: list, scope: dict) -> Any:
        if len(part) > 2 and part[0][0] == "name" and part[1] in (("glyph", "←"), ("glyph", "↩")):
            scope[part[0][1]] = value = self._statement(part[2:], scope)
            return value
        return self._expression(self._units(part, scope))

    def _units(self, part: list, scope: dict) -> list:
        """Values, functions and modifiers of an expression, brackets and strands made."""
        out: list[Any] = []
        at, strand = 0, False

        def put(v: Any) -> None:
            nonlocal strand
            if strand:
                out[-1].append(v)
                strand = False
            else:
                out.append(v)

        while at < len(part):
            kind, v = part[at]
            at += 1
            if kind == "value":
                put(v)
            elif kind == "name":
                if v == "𝕊":
                    v = "𝕤"
                if v in "𝕏𝕎":
                    v = v.replace("𝕏", "𝕩").replace("𝕎", "𝕨")
                if v not in scope:
                    raise DomainError(f"{v} isn't defined")
                put(scope[v])
            elif v == "‿":
                if not (out and isinstance(out[-1], _Strand)):
                    out.append(_Strand([out.pop()]))
                strand = True
            elif v in "({⟨[":
                depth, end = 1, at
                while depth:
                    depth += part[end] in [("glyph", c) for c in "({⟨["]
                    depth -= part[end] in [("glyph", c) for c in ")}⟩]"]
                    end += 1
                inner, at = part[at : end - 1], end
                if v == "(":
                    put(self._statement(inner, scope))
                elif v == "{":
                    put(self._block(inner, scope))
                else:
                    items, one, depth = [], [], 0
                    for t in [*inner, ("stop", ",")]:
                        depth += t[0] == "glyph" and t[1] in "({⟨["
                        depth -= t[0] == "glyph" and t[1] in ")}⟩]"
                        if t[0] == "stop" and not depth:
                            if one:
                                items.append(self._statement(one, scope))
                            one = []
                        else:
                            one.append(t)
                    put(self._list(items))
            elif v in FUNCTIONS:
                put(self._primitive(v))
            elif v in ONE or v in TWO:
                out.append(_Modifier(v))
            else:
                raise DomainError(f"{v} isn't known")
        return [self._list(u) if isinstance(u, _Strand) else u for u in out]

    def _list(self, items: list) -> Any:
        """A list of atoms as an array, of other things as a host list."""
        if not items:
            return self.engine.iota(0)
        if all(isinstance(x, float) for x in items) or all(isinstance(x, Char) for x in items):
            return self.engine.literal([str(x) if isinstance(x, Char) else x for x in items], (len(items),))
        return list(items)

    @staticmethod
    def _parts(toks: list, mark: str) -> list[list]:
        """Tokens cut at a mark that stands in no bracket."""
        out, depth = [[]], 0
        for t in toks:
            depth += t[0] == "glyph" and t[1] in "({⟨["
            depth -= t[0] == "glyph" and t[1] in ")}⟩]"
            if t == ("glyph", mark) and not depth:
                out.append([])
            else:
                out[-1].append(t)
        return out

    def _body(self, inner: list, scope: dict) -> Any:
        """The first body whose predicates are 1: bodies are parted by ; and a predicate ends in ?"""
        for body in self._parts(inner, ";"):
            *tests, last = self._parts(body, "?")
            own = dict(scope)
            if all(self._statements(t, own)[0] == 1 for t in tests):
                return self._statements(last, own)[0]
        raise DomainError("no body of the block applies")

    def _block(self, inner: list, scope: dict) -> Any:
        if not any(k == "name" and v in "𝕩𝕨𝕤𝕊𝕏𝕎" for k, v in inner):
            return self._body(inner, scope)

        def call(x: Any, w: Any = None) -> Any:
            own = dict(scope) | {"𝕩": x, "𝕤": me}
            if w is not None:
                own["𝕨"] = w
            return self._body(inner, own)

        me = Fn(call)
        return me

    def _expression(self, units: list) -> Any:
        """Modifiers bind first, from the left; then functions apply from the right."""
        made: list[Any] = []
        at = 0
        while at < len(units):
            u = units[at]
            if isinstance(u, _Modifier):
                if u.glyph in ONE:
                    made[-1] = self._one(u.glyph, made[-1])
                else:
                    at += 1
                    right = units[at]
                    made[-1] = self._two(u.glyph, made[-1], right)
            else:
                made.append(u)
            at += 1
        if not made:
            raise DomainError("nothing to evaluate")
        if isinstance(made[-1], Fn):
            return self._train(made)
        value = made.pop()
        while made:
            f = made.pop()
            if not isinstance(f, Fn):
                raise DomainError("two values without a function between them")
            w = made.pop() if made and not isinstance(made[-1], Fn) else None
            value = f(value, w)
        return value

    def _train(self, parts: list) -> Fn:
        last = parts.pop()
        while parts:
            g = parts.pop()
            f = parts.pop() if parts else None
            last = self._fork(f, g, last) if f is not None else self._atop(g, last)
        return last

    @staticmethod
    def _atop(g: Fn, h: Fn) -> Fn:
        return Fn(lambda x, w=None: g(h(x, w)))

    @staticmethod
    def _fork(f: Any, g: Fn, h: Fn) -> Fn:
        return Fn(lambda x, w=None: g(h(x, w), f(x, w) if isinstance(f, Fn) else f))

    # functions

    def _primitive(self, glyph: str) -> Fn:
        return Fn(lambda x, w=None: self._apply(glyph, x, w), glyph)

    def _atom(self, f: Callable, *args: float) -> float:
        return self.spark.range(1).select(f(*(F.lit(a) for a in args))).first()[0]

    def array(self, x: Any) -> DArray:
        if isinstance(x, DArray):
            return x
        if isinstance(x, Char):
            return self.engine.literal([str(x)], (1,))
        if isinstance(x, str):
            return self.engine.literal(x, (len(x),))
        if isinstance(x, float):
            return self.engine.literal([x], (1,))
        return self.engine.literal([a.collect() if isinstance(a, DArray) else a for a in x])

    def _apply(self, glyph: str, x: Any, w: Any) -> Any:
        if isinstance(x, str) and not isinstance(x, Char):
            x = self.array(x)
        if isinstance(w, str) and not isinstance(w, Char):
            w = self.array(w)
        if glyph in PERVASIVE and (w is not None or PERVASIVE[glyph][0] is not None):
            return self._pervade(glyph, x, w)
        table = self._dyads if w is not None else self._monads
        if glyph not in table:
            raise DomainError(f"{glyph} takes another number of arguments")
        return table[glyph](self, x) if w is None else table[glyph](self, x, w)

    def _pervade(self, glyph: str, x: Any, w: Any) -> Any:
        one, two, _ = PERVASIVE[glyph]
        if isinstance(x, list):
            return [self._apply(glyph, v, w if not isinstance(w, list) else w[k]) for k, v in enumerate(x)]
        if isinstance(w, list):
            return [self._apply(glyph, x, v) for v in w]
        chars = [a for a in (x, w) if isinstance(a, Char) or (isinstance(a, DArray) and a.kind == "c")]
        if chars:
            return self._chars(glyph, x, w)
        if w is None:
            return x.map(one) if isinstance(x, DArray) else self._atom(one, x)
        if isinstance(x, DArray) or isinstance(w, DArray):
            return pervasive.zip_with(two, w, x)
        return self._atom(two, w, x)

    def _chars(self, glyph: str, x: Any, w: Any) -> Any:
        code = lambda a: float(ord(a)) if isinstance(a, Char) else DArray(a.df.withColumn("v", F.col("v").cast("double")), a.shape) if isinstance(a, DArray) and a.kind == "c" else a
        is_char = lambda a: isinstance(a, Char) or (isinstance(a, DArray) and a.kind == "c")
        if w is None or glyph not in "+-=≠<>≤≥":
            raise DomainError(f"{glyph} doesn't take characters")
        if glyph in "=≠<>≤≥" and is_char(x) == is_char(w):
            return self._pervade(glyph, code(x), code(w))
        if glyph in "=≠<>≤≥":  # numbers come before characters
            before = is_char(x)
            flag = {"=": False, "≠": True, "<": before, "≤": before, ">": not before, "≥": not before}[glyph]
            shaped = x if isinstance(x, DArray) else w
            return shaped.map(lambda v: F.lit(float(flag)), "n") if isinstance(shaped, DArray) else float(flag)
        if is_char(x) and is_char(w):
            if glyph == "+":
                raise DomainError("characters don't add")
            return self._pervade("-", code(x), code(w))
        if glyph == "-" and is_char(x):
            raise DomainError("a number less a character")
        out = self._pervade(glyph, code(x), code(w))
        if isinstance(out, float):
            return Char(chr(int(out)))
        return DArray(out.df.withColumn("v", F.col("v").cast("int")), out.shape, "c", 32)

    _monads: dict[str, Callable] = {
        "⊣": lambda s, x: x,
        "⊢": lambda s, x: x,
        "=": lambda s, x: float(x.rank if isinstance(x, DArray) else isinstance(x, list)),
        "≠": lambda s, x: float(x.shape[0] if isinstance(x, DArray) and x.rank else len(x) if isinstance(x, list) else 1),
        "≢": lambda s, x: s._list([float(n) for n in (x.shape if isinstance(x, DArray) else (len(x),) if isinstance(x, list) else ())]),
        "≡": lambda s, x: s._depth(x),
        "⥊": lambda s, x: structural.deshape(s.array(x)),
        "∾": lambda s, x: s._join(x),
        "≍": lambda s, x: structural.couple(s.array(x)),
        "⋈": lambda s, x: s._list([x]),
        "↑": lambda s, x: structural.prefixes(s.array(x)),
        "↓": lambda s, x: structural.suffixes(s.array(x)),
        "↕": lambda s, x: s._range(x),
        "«": lambda s, x: structural.shift_after(s.array(x)),
        "»": lambda s, x: structural.shift_before(s.array(x)),
        "⌽": lambda s, x: list(reversed(x)) if isinstance(x, list) else structural.reverse(x),
        "⍉": lambda s, x: structural.transpose(s.array(x)),
        "/": lambda s, x: selection.indices(s.array(x)),
        "⊏": lambda s, x: s._unit(selection.first_cell(s.array(x))),
        "⊑": lambda s, x: x[0] if isinstance(x, list) else x if isinstance(x, float) else s._element(x, *(0,) * x.rank),
        "⊐": lambda s, x: scan.classify(s.array(x)),
        "⊒": lambda s, x: scan.occurrence(s.array(x)),
        "∊": lambda s, x: scan.mark_firsts(s.array(x)),
        "⍷": lambda s, x: sets.unique(s.array(x)),
        "⊔": lambda s, x: [s._list([float(p) for p in r["places"]]) for r in fold.group_places(s.array(x)).orderBy("g").collect()],
        "⍋": lambda s, x: order.grade(s.array(x)),
        "⍒": lambda s, x: order.grade(s.array(x), True),
        "∧": lambda s, x: order.sort(s.array(x)),
        "∨": lambda s, x: order.sort(s.array(x), True),
        ">": lambda s, x: s.array(x),
        "<": lambda s, x: [x],
        "!": lambda s, x: s._assert(x, "assertion failed"),
    }
    _dyads: dict[str, Callable] = {
        "⊣": lambda s, x, w: w,
        "⊢": lambda s, x, w: x,
        "≡": lambda s, x, w: float(s._same(w, x)),
        "≢": lambda s, x, w: 1.0 - float(s._same(w, x)),
        "⥊": lambda s, x, w: structural.reshape(s.array(x), *s._whole(w)),
        "∾": lambda s, x, w: [*w, *x] if isinstance(w, list) and isinstance(x, list) else structural.concat(s.array(w), s.array(x)),
        "≍": lambda s, x, w: structural.couple(s.array(w), s.array(x)),
        "⋈": lambda s, x, w: s._list([w, x]),
        "↑": lambda s, x, w: structural.take(s.array(x), *s._whole(w)),
        "↓": lambda s, x, w: structural.drop(s.array(x), *s._whole(w)),
        "↕": lambda s, x, w: structural.windows(s.array(x), *s._whole(w)),
        "«": lambda s, x, w: structural.shift_after(s.array(x), w),
        "»": lambda s, x, w: structural.shift_before(s.array(x), w),
        "⌽": lambda s, x, w: structural.rotate(s.array(x), *s._whole(w)),
        "⍉": lambda s, x, w: structural.reorder(s.array(x), *s._whole(w)),
        "/": lambda s, x, w: selection.replicate(int(w) if isinstance(w, float) else s.array(w), s.array(x)),
        "⊏": lambda s, x, w: s._unit(selection.first_cell(selection.select(s.array(w), s.array(x)))) if isinstance(w, float) else selection.select(s.array(w), s.array(x)),
        "⊑": lambda s, x, w: x[int(w)] if isinstance(x, list) else s._element(x, *s._whole(w)),
        "⊐": lambda s, x, w: search.index_of(s.array(w), s.array(x)),
        "⊒": lambda s, x, w: search.progressive_index_of(s.array(w), s.array(x)),
        "∊": lambda s, x, w: search.member(s.array(w), s.array(x)),
        "⍷": lambda s, x, w: search.find_cells(s.array(w), s.array(x)),
        "⊔": lambda s, x, w: [s._list(list(r["cells"])) for r in fold.group_cells(s.array(w), s.array(x)).orderBy("g").collect()],
        "⍋": lambda s, x, w: search.bins(s.array(w), s.array(x)),
        "⍒": lambda s, x, w: search.bins(s.array(w), s.array(x), up=False),
        "!": lambda s, x, w: s._assert(x, str(w)),
    }

    def _element(self, x: DArray, *at: int) -> Any:
        v = selection.pick(x, *at)
        return Char(v) if x.kind == "c" else v

    def _unit(self, x: DArray) -> Any:
        return x if x.rank else self._element(x)

    def _whole(self, w: Any) -> tuple[int, ...]:
        values = [w] if isinstance(w, float) else w if isinstance(w, list) else w.collect()
        return tuple(int(v) for v in values)

    def _range(self, x: Any) -> DArray:
        if isinstance(x, float):
            return self.engine.iota(int(x))
        raise DomainError("a range takes a number; make tables of places with ⌜")

    def _depth(self, x: Any) -> float:
        if isinstance(x, list):
            return 1.0 + max((self._depth(v) for v in x), default=0.0)
        return float(isinstance(x, (DArray, str)) and not isinstance(x, Char))

    def _join(self, x: Any) -> Any:
        return structural.join([self.array(v) for v in x]) if isinstance(x, list) else x

    def _same(self, w: Any, x: Any) -> bool:
        if isinstance(w, list) or isinstance(x, list):
            return isinstance(w, list) and isinstance(x, list) and len(w) == len(x) and all(self._same(a, b) for a, b in zip(w, x, strict=True))
        if isinstance(w, DArray) and isinstance(x, DArray):
            return pervasive.match(w, x)
        return not isinstance(w, DArray) and not isinstance(x, DArray) and type(w) is type(x) and w == x

    def _assert(self, x: Any, message: str) -> Any:
        if isinstance(x, DArray):
            return selection.assert_ones(x, message)
        if x != 1:
            raise ArrayError(message)
        return x

    # modifiers

    def _call(self, f: Any, x: Any, w: Any = None) -> Any:
        return f(x, w) if isinstance(f, Fn) else f

    def _one(self, glyph: str, f: Any) -> Fn:
        name = PERVASIVE.get(f.glyph, (None, None, None))[2] if isinstance(f, Fn) and f.glyph else None
        if glyph == "˙":
            return Fn(lambda x, w=None: f)
        if glyph == "˜":
            return Fn(lambda x, w=None: f(x, x) if w is None else f(w, x), None, ("˜", f))
        if glyph == "´":
            return Fn(lambda x, w=None: self._fold(f, name, x, w), None, ("´", f))
        if glyph == "˝":
            return Fn(lambda x, w=None: self._insert(f, name, x, w), None, ("˝", f))
        if glyph == "`":
            return Fn(lambda x, w=None: scan.scan(self._named(name), self.array(x), w), None, ("`", f))
        if glyph == "¨":
            return Fn(lambda x, w=None: self._each(f, x, w))
        if glyph == "˘":
            return Fn(lambda x, w=None: self._cells(f, x, w), None, ("˘", f))
        if glyph == "⌜":
            return Fn(lambda x, w=None: self._each(f, x, None) if w is None else pervasive.table(PERVASIVE[f.glyph][1], self.array(w), self.array(x)))
        if glyph == "⁼":
            return Fn(lambda x, w=None: self._undo(f, x, w))
        raise DomainError(glyph)

    def _insert(self, f: Fn, name: str | None, x: Any, w: Any) -> Any:
        """The leading axis reduced; a seed is one more cell at its end."""
        a = self.array(x)
        if w is not None:
            a = structural.concat(a, self.array(w) if a.rank > 1 or isinstance(w, DArray) else self.engine.literal([w]))
        return self._unit(fold.insert(self._named(name), a))

    def _named(self, name: str | None) -> str:
        if name is None:
            raise DomainError("this function has no distributed fold")
        return name

    def _fold(self, f: Fn, name: str | None, x: Any, w: Any) -> Any:
        if isinstance(x, DArray) and name is not None:
            return fold.fold(name, x, w)
        items = x if isinstance(x, list) else [v for v in self.array(x).collect()]  # a block's own fold, for short lists
        acc = w
        for v in reversed(items):
            acc = v if acc is None else f(acc, v)
        return acc

    def _each(self, f: Fn, x: Any, w: Any) -> Any:
        if isinstance(x, list) or isinstance(w, list):
            n = len(x) if isinstance(x, list) else len(w)
            return self._list([f(x[k] if isinstance(x, list) else x, w[k] if isinstance(w, list) else w) for k in range(n)])
        return f(x, w)  # pervasive functions and blocks of them work on whole arrays

    def _cells(self, f: Fn, x: Any, w: Any) -> Any:
        held = f.held
        if w is None and isinstance(held, tuple) and held[0] in ("˝", "´") and isinstance(x, DArray):
            return fold.fold_rows(PERVASIVE[held[1].glyph][2], x)
        if w is None and isinstance(x, DArray) and f.glyph == "⌽":
            return structural.untranspose(structural.transpose(x)) if x.rank < 2 else x.with_df(x.df.withColumn(f"i{x.rank - 1}", F.lit(x.shape[-1] - 1) - F.col(f"i{x.rank - 1}")))
        return f(x, w)

    def _undo(self, f: Fn, x: Any, w: Any) -> Any:
        if isinstance(f.held, tuple) and f.held[0] == "`" and f.held[1].glyph == "+":
            return scan.unscan(self.array(x))
        if isinstance(f.held, tuple) and f.held[0] == "˜" and f.held[1].glyph == "+" and w is None:
            return self._pervade("÷", x=2.0, w=x)
        if f.glyph == "/" and w is None:
            return selection.counts_of(self.array(x))
        if w is None:
            back = comb.inverse(UNDONE[f.glyph])
            return x.map(back) if isinstance(x, DArray) else self._atom(back, x)
        back = num.INVERSES_RIGHT[UNDONE_RIGHT[f.glyph]]
        return pervasive.zip_with(back, w, x) if isinstance(x, DArray) or isinstance(w, DArray) else self._atom(back, w, x)

    def _two(self, glyph: str, f: Any, g: Any) -> Fn:
        if glyph == "∘":
            out = Fn(lambda x, w=None: self._call(f, self._call(g, x, w)), None, ("∘", f, g))
            return out
        if glyph == "○":
            return Fn(lambda x, w=None: f(g(x), None if w is None else g(w)))
        if glyph == "⊸":
            return Fn(lambda x, w=None: g(x, self._call(f, x if w is None else w)), None, ("⊸", f, g))
        if glyph == "⟜":
            return Fn(lambda x, w=None: f(self._call(g, x), x if w is None else w))
        if glyph == "⊘":
            return Fn(lambda x, w=None: f(x) if w is None else g(x, w))
        if glyph == "◶":
            return Fn(lambda x, w=None: self._call(g[int(self._call(f, x, w))], x, w))
        if glyph == "⍟":
            def again(x: Any, w: Any = None) -> Any:
                n = int(self._call(g, x, w))
                back = Fn(lambda y, v=None: self._undo(f, y, v))
                for _ in range(abs(n)):
                    x = (f if n >= 0 else back)(x, w)
                return x

            return Fn(again)
        if glyph == "⎊":
            def caught(x: Any, w: Any = None) -> Any:
                try:
                    out = f(x, w)
                    if isinstance(out, DArray):
                        out.df.write.format("noop").mode("overwrite").save()
                    return out
                except Exception:
                    return self._call(g, x, w)

            return Fn(caught)
        if glyph == "⌾":
            return Fn(lambda x, w=None: self._under(f, g, x))
        raise DomainError(glyph)

    def _under(self, f: Fn, g: Fn, x: Any) -> Any:
        a = self.array(x)
        if g.glyph == "⌽":
            return structural.reverse(f(structural.reverse(a)))
        if isinstance(g.held, tuple) and g.held[0] == "⊸" and g.held[2].glyph in "↑↓/⊏":
            left, at = g.held[1], g.held[2].glyph
            if at == "↑":
                return comb.under_take(f, a, int(left))
            if at == "↓":
                return comb.under_drop(f, a, int(left))
            if at == "/":
                return comb.under_filter(f, self.array(left), a)
            return comb.under_places(f, a, self.array(left))
        if g.glyph in UNDONE:
            return self._undo(g, f(g(x)), None)
        raise DomainError("no place to put the result back")

    def matmul(self, w: DArray, x: DArray) -> DArray:
        return linalg.matmul(w, x)


class _Strand(list):
    pass


class _Modifier:
    def __init__(self, glyph: str) -> None:
        self.glyph = glyph
