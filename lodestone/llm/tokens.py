"""Token ids by the tokenizers library, with each distinct pre-token encoded once a worker.

Byte-pair encoders treat the matches of their split pattern apart, so the ids of a text are those of its
matches, one after another. The matches are found by the same pattern, and what the library's model gives for each
is remembered. The model is asked directly: a match is normalised and split already, only its bytes have to be
written as the characters that stand for them."""

from __future__ import annotations

import json
import sys
from array import array

import numpy as np

from .common import claim

LITTLE = sys.byteorder == "little" and array("I").itemsize == 4

#: Pre-tokens that a worker remembers; beyond it the memory starts anew (about 150 bytes each). More for jobs whose
#: workers do nothing else.
WORDS, MORE_WORDS = 250_000, 1_000_000
#: Fixed pattern of the library's byte-level splitting.
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The Latin-1 characters of the classes L, N and white space, for a pattern of Python's own (and faster) engine.
LATIN_1 = {r"\p{L}": "A-Za-zªµºÀ-ÖØ-öø-ÿ", r"\p{N}": "0-9²³¹¼-¾", r"\s": "\t-\r \x85\xa0"}

_encoders: dict[str, Encoder] = {}


def byte_characters() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies: itself where it is visible, else the next one from U+0100."""
    visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in visible else chr(next(others)) for b in range(256)]


class Words(dict):
    """The ids of each word that was met, by the model; at most so many words, then it starts anew."""

    def __init__(self, model, most: int):
        self.tokenize, self.most, self.character = model.tokenize, most, byte_characters().__getitem__

    def __missing__(self, word: str) -> bytes:
        if len(self) >= self.most:
            self.clear()
        ids = [t.id for t in self.tokenize("".join(map(self.character, word.encode())))]
        got = self[word] = array("I", ids).tobytes() if LITTLE else np.array(ids, "<u4").tobytes()
        return got


def latin_pattern(pattern: str) -> str:
    """The pattern for Latin-1 text, written without classes. It may hold L, N and white space, within brackets or not."""
    import re

    out, inside, k = [], False, 0
    while k < len(pattern):
        m = re.match(r"\\p\{[LN]\}|\\[sS]", pattern[k:])
        if m:
            name = m[0]
            if name == r"\S":
                out.append(f"[^{LATIN_1[chr(92) + 's']}]")
            else:
                out.append(LATIN_1[name] if inside else f"[{LATIN_1[name]}]")
            k += len(name)
            continue
        inside = (inside or pattern[k] == "[") and pattern[k] != "]"
        out.append(pattern[k])
        k += 1
    return "".join(out)


class Encoder:
    """encode(texts) gives the ids of each as little-endian unsigned 32-bit integers: those of the library as it is
    loaded from the file, with add_special_tokens=False (a special token's string within a text is that token)."""

    def __init__(self, path: str):
        import re

        import regex
        from tokenizers import Tokenizer

        # Pre-tokens are ordinary text; a text that holds a special token's string goes to the library whole.
        self.tok = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.added = [a["content"] for a in spec.get("added_tokens") or []]
        self.find = None
        pre, norm = spec.get("pre_tokenizer") or {}, spec.get("normalizer")
        parts = pre.get("pretokenizers", [pre])
        pattern = None
        if parts[-1].get("type") == "ByteLevel" and not parts[-1].get("add_prefix_space"):
            if len(parts) == 1 and parts[0].get("use_regex") and not norm:
                pattern = BYTE_LEVEL
            elif len(parts) == 2 and parts[0].get("type") == "Split" and parts[0].get("invert") and parts[0].get("behavior") == "Removed" and not parts[1].get("use_regex"):
                pattern = parts[0]["pattern"]["Regex"]
        # For Latin-1 text, composing changes nothing, and lower case is by character.
        self.lower = norm is not None and [x.get("type") for x in norm.get("normalizers", [])] == ["NFC", "Replace", "Lowercase"]
        self.normalise = self.tok.normalizer.normalize_str if norm else None
        if pattern:
            self.find = regex.compile(pattern).findall
            self.find_latin = re.compile(latin_pattern(pattern)).findall
        self.words = Words(self.tok.model, WORDS)

    def split(self, text: str) -> list[str]:
        """The pre-tokens of a text."""
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return self.find(self.normalise(text) if self.normalise else text)
        if self.lower:
            return self.find_latin(text.lower())
        return self.find(self.normalise(text)) if self.normalise else self.find_latin(text)

    def encode(self, texts: list[str]) -> list[bytes]:
        by_library = lambda some: [np.array(e.ids, dtype="<u4").tobytes() for e in self.tok.encode_batch_fast(some, add_special_tokens=False)]
        if self.find is None:
            return by_library(texts)
        ids, out = self.words.__getitem__, []
        for text in texts:
            if any(a in text for a in self.added):
                out += by_library([text])
            else:
                out.append(b"".join(map(ids, self.split(text))))
        return out


def encoder(path: str, words: int = WORDS) -> Encoder:
    """One a worker and vocabulary file, that remembers so many words; the file must be at this path on every executor."""
    claim(_encoders)
    if path not in _encoders:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        _encoders[path] = Encoder(path)
    _encoders[path].words.most = words
    return _encoders[path]


def slices(column, rows: int = 64):
    """The values of an Arrow column as Python lists of few rows at a time."""
    for at in range(0, len(column), rows):
        yield at, column.slice(at, rows).to_pylist()
