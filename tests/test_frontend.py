import math

import pytest
from lattica.errors import ArrayError
from lattica.frontend import Session


@pytest.fixture(scope="module")
def run(spark):
    return Session(spark).show


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("1", 1), ("3 - 5", -2), ("2 × 3 + 4", 14), ("(2×3)+4", 10), ("¯7 | 9", -5), ("1 ÷ 0", math.inf), ("+´ ↕10", 45),
        ("-´ 1‿2‿3", 2), ("+´ 2 × ↕1000", 999000), ("6 +´ 1‿2", 9), ("+` 1‿2‿3", [1, 3, 6]), ("+`⁼ 1‿3‿6", [1, 2, 3]),
        ("2‿3 ⥊ ↕6", [[0, 1, 2], [3, 4, 5]]), ("+˝ 2‿3⥊↕6", [3, 5, 7]), ("+´˘ 2‿3⥊↕6", [3, 12]), ("⌽ ↕3", [2, 1, 0]), ("1 ⌽ ↕3", [1, 2, 0]),
        ("¯6 ↑ 3+↕4", [0, 0, 3, 4, 5, 6]), ("⌽⌾(¯3⊸↑) 10×↕5", [0, 10, 40, 30, 20]), ("(1⊸-)⌾(¯2⊸↑) 11‿12‿13", [11, -11, -12]),
        ("⌽⌾(¯3⊸↓) 2×↕7", [6, 4, 2, 0, 8, 10, 12]), ("⌽⌾(1‿0‿0‿1‿1‿0⊸/) 21‿22‿23‿24‿25‿26", [25, 22, 23, 24, 21, 26]), ("12 +⁼ 31", 19), ("/⁼ ⟨3,1,1,5⟩", [0, 2, 0, 1, 0, 1]),
        ("⍋ 3‿1‿2", [1, 2, 0]), ("∨ 3‿1‿2", [3, 2, 1]), ("3‿1‿2 ⊐ 1‿5", [1, 3]), ("⊔ 0‿1‿0", [[0, 2], [1]]), ("0‿1‿0 ⊔ 5‿6‿7", [[5, 7], [6]]),
        ('⌽ "abc"', "cba"), ('"abc" + 1', "bcd"), ("'c' - 'a'", 2), ('"ab" ∾ "cd"', "abcd"), ("⍷ 1‿2‿1", [1, 2]), ("2‿4 ⍋ 1‿2‿5", [0, 1, 2]),
        ("(↕2) ×⌜ ↕3", [[0, 0, 0], [0, 1, 2]]), ("{𝕩×𝕩} 4", 16), ("{𝕩<2 ? 1 ; 𝕩×𝕊 𝕩-1} 4", 24), ("3 {𝕨-𝕩} 1", 2), ("f ← {𝕩+1} ⋄ f 4", 5), ("2⊸×⍟3 1", 8),
        ("(+´÷≠) 1‿2‿3", 2), ("⌊∘÷⟜2 7", 3), ("1‿2‿3 ≡ 1‿2‿3", 1), ("! ⎊ 5 0", 5), ("2 / 1‿2", [1, 1, 2, 2]), ("1‿0‿1 / 4‿5‿6", [4, 6]), ("≢ 2‿3⥊0", [2, 3]),
        ("3 ↕ ↕5", [[0, 1, 2], [1, 2, 3], [2, 3, 4]]), ("» 1‿2‿3", [0, 1, 2]), ("+˜ 3", 6), ("+˜⁼ 6", 3), ("1 = 'a'", 0), ("≡ ⟨1, 2‿3⟩", 2), ("×⟜2¨ 1‿2", [2, 4]),
    ],
)
def test_expressions(run, text, want):
    assert run(text) == want


def test_errors(run):
    for text in ("(↕3)+↕4", "1÷'a'", "! 0", "nosuch", "6‿7‿1‿3 ⍋ 2"):
        with pytest.raises(ArrayError):
            run(text)
