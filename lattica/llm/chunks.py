"""Byte-level tokenizing by chunk: texts are cut where the public split pattern always cuts, and each distinct chunk is encoded once."""

from __future__ import annotations

import base64
import json
from collections.abc import Callable
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
import tiktoken

PATTERN = public_tokenizers.PATTERN
_ADJACENT = regex.compile(r"\s\s")
_SPLIT = regex.compile(PATTERN)
#: Two adjacent characters that are white space to the pattern or to str.isspace, for Arrow.
_ADJACENT_ARROW = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{180e}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]{2}"


def pretokens(text: str) -> list[str]:
    """The matches of the split pattern, which cover the text."""
    return _SPLIT.findall(text)


def chunks(text: str) -> list[str]:
    """Pieces that join to the text, each ending where the pattern ends a match.

    A space between two characters that aren't white space always begins a match, so most texts are cut there.
    """
    if not text or _ADJACENT.search(text):
        return pretokens(text)
    first, *rest = text.split(" ")
    return [first] * bool(first) + [" " + x for x in rest]


def cut_texts(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """(words of the pieces end to end, number of words of each piece, pieces of the texts end to end, number of pieces of each text); texts has no nulls.

    Texts without adjacent white space are cut at spaces, and each piece between two spaces is matched once: put together
    by spaces they are a text whose words begin with a space where a piece begins, and only there. First and last
    pieces, and texts with adjacent white space, are pieces of their own.
    """
    odd = pc.match_substring_regex(texts, _ADJACENT_ARROW)
    split = pc.split_pattern(texts.filter(pc.invert(odd)), " ")
    values, many = split.flatten(), pc.list_value_length(split).to_numpy().astype(np.int64)
    last = np.cumsum(many) - 1
    first, last = last - many + 1, last[many > 1]
    inner = np.ones(len(values), dtype=bool)
    inner[first] = inner[last] = False
    between = values.filter(pa.array(inner)).dictionary_encode()
    words = _SPLIT.findall(" " + " ".join(between.dictionary.to_pylist())) if len(between) else []
    begins = np.flatnonzero(pc.starts_with(pa.array(words, type=pa.large_string()), " ").to_numpy(zero_copy_only=False))
    single = [*map(pretokens, values.take(pa.array(first)).to_pylist()), *(pretokens(" " + x) for x in values.take(pa.array(last)).to_pylist()), *map(pretokens, texts.filter(odd).to_pylist())]
    held = np.concatenate([np.diff(begins, append=len(words)), np.fromiter(map(len, single), dtype=np.int64, count=len(single))])
    words.extend(w for x in single for w in x)
    places = np.empty(len(values), dtype=np.int64)
    places[inner] = between.indices.to_numpy()
    places[first] = len(begins) + np.arange(len(first))
    places[last] = len(begins) + len(first) + np.arange(len(last))
    whole = odd.to_numpy(zero_copy_only=False)
    counts = np.ones(len(texts), dtype=np.int64)
    counts[~whole] = many
    pieces = np.empty(counts.sum(), dtype=np.int64)
    at = np.repeat(whole, counts)
    pieces[at], pieces[~at] = np.arange(len(held) - whole.sum(), len(held)), places
    return words, held, pieces, counts


class ChunkCache:
    """Chunk -> what encode makes of it, for the distinct chunks of the batches that a worker has seen; emptied when it holds most."""

    def __init__(self, encode: Callable[[list[str]], list], most: int = 250_000) -> None:
        self.encode, self.most, self.held = encode, most, {}

    def batch(self, texts: list[str | None]) -> list[list]:
        """For each text (null: empty) the results of its chunks, in order."""
        cut = [chunks(x or "") for x in texts]
        if len(self.held) > self.most:
            self.held.clear()
        new = [c for c in set().union(*cut) if c not in self.held]
        for k in range(0, len(new), 50_000):
            some = new[k : k + 50_000]
            self.held.update(zip(some, self.encode(some), strict=True))
        get = self.held.__getitem__
        return [list(map(get, x)) for x in cut]


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes -> rank of a rank file."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}


def _byte_symbols() -> dict[str, int]:
    """Symbol -> byte, as byte-level vocabularies write them: printable Latin-1 stands for itself, other bytes for 256 and up."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(other)}


@cache
def byte_level(path: str) -> Callable[[str], list[int]]:
    """Encoder of a byte-level `tokenizers` file: text without special tokens' strings -> ids.

    Where the file's merges are in the order of its ids, ranks say all, and the faster library gives the same ids.
    """
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, special = spec["model"], {x["content"] for x in spec.get("added_tokens", [])}
    symbols = _byte_symbols()
    vocab = {k: v for k, v in model["vocab"].items() if k not in special}
    merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
    singles = {k for k in vocab if len(k) == 1}
    if [vocab.get(a + b) for a, b in merges] == list(range(len(singles), len(vocab))) and {vocab[k] for k in singles} == set(range(256)) and not (spec.get("pre_tokenizer") or {}).get("add_prefix_space"):
        ranks = {bytes(symbols[c] for c in k): v for k, v in vocab.items()}
        return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    return whole_text(path)


@cache
def whole_text(path: str) -> Callable[[str], list[int]]:
    """The library's own encoder of a `tokenizers` file; strings of special tokens make their ids."""
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)
    return lambda text: library.encode(text, add_special_tokens=False).ids


@cache
def special_strings(path: str) -> list[str]:
    """The strings that a `tokenizers` file takes out of a text before it splits it."""
    with open(path, encoding="utf-8") as f:
        return [x["content"] for x in json.load(f).get("added_tokens", [])]


@cache
def id_kind(path: str) -> str:
    """The narrowest array type code that holds every id of a `tokenizers` file."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    most = max([*spec["model"]["vocab"].values(), *(x["id"] for x in spec.get("added_tokens", []))])
    return "H" if most < 1 << 16 else "I"


__all__ = ["PATTERN", "ChunkCache", "byte_level", "chunks", "cut_texts", "id_kind", "pretokens", "read_ranks", "special_strings", "whole_text"]
