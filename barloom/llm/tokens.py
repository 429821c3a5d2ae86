"""Byte-level BPE ids and character spans of whole texts.

The vocabulary is read from a tokenizer file of the tokenizers library.  In
such a file the ids of a byte-level vocabulary are the ranks of its merges, so
tiktoken's encoder, several times faster on open vocabularies, can run it.
Every encoder compares the two on the first texts it sees and stops with an
error if they differ.  Texts that tiktoken's regular expressions cannot split,
those with white-space runs of about a million characters, go to tokenizers, and
so do texts that hold the string of an added token: as tokenizers has it by
default, that string is the token.
"""

from __future__ import annotations

import json
import re
import sys
import types
from collections.abc import Sequence

import numpy as np

#: How byte-level vocabularies split text before merging (fixed value).
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: White-space runs from here on are not given to tiktoken, whose stack holds about 1,000,000 characters of one.
LONG_SPACE = 500_000
_SPACES = re.compile(r"\s+")


def _letters() -> dict[str, int]:
    """Byte for each letter of a byte-level vocabulary: printable bytes stand for themselves, the others follow from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def long_space(text: str) -> bool:
    return len(text) >= LONG_SPACE and any(m.end() - m.start() >= LONG_SPACE for m in _SPACES.finditer(text))


class TextEncoder:
    def __init__(self, path: str, checked: int = 4):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letter = _letters()
        added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        special = set(added)
        self.added = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True)))) if special else None
        ranks = {bytes(letter[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in special}
        self.encoder = tiktoken.Encoding("corpus", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
        sizes = {i: len(b) for b, i in ranks.items()} | {i: len(t.encode()) for t, i in added.items()}
        self.size = np.zeros(max(sizes) + 1, np.int64)
        self.size[list(sizes)] = list(sizes.values())
        self.path, self.unchecked, self.tokenizer = path, checked, None

    def _plain(self, text: str) -> list[int]:
        """Ids by the tokenizers library."""
        if self.tokenizer is None:
            from tokenizers import Tokenizer

            self.tokenizer = Tokenizer.from_file(self.path)
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _fast(self, text: str) -> list[int] | None:
        """Ids by tiktoken; none if it fails on the text or would take an added token's string apart."""
        if long_space(text) or self.added is not None and self.added.search(text):
            return None
        try:
            return self.encoder.encode_ordinary(text)
        except BaseException as e:  # a panic is no Exception
            if type(e).__name__ != "PanicException":
                raise
            return None

    def ids(self, text: str) -> np.ndarray:
        ids = self._fast(text)
        if ids is None:
            return np.array(self._plain(text), "<u4")
        if self.unchecked and text:
            self.unchecked -= 1
            if self._plain(text) != ids:
                raise ValueError(f"{self.path} is not a byte-level vocabulary ranked by id")
            if not self.unchecked:
                self.tokenizer = None  # its memory
        return np.array(ids, "<u4")

    def spans(self, text: str) -> np.ndarray:
        """Start and end of each token in code points; tokens inside one character get that character."""
        ends = np.cumsum(self.size[self.ids(text)])
        raw = np.frombuffer(text.encode("utf-8"), np.uint8)
        place = np.cumsum((raw & 0xC0) != 0x80) - 1  # code point of each byte
        starts = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
        return np.stack([place[starts], place[ends - 1] + 1], axis=1) if len(ends) else np.empty((0, 2), np.int64)


def encoder(path: str) -> TextEncoder:
    """One encoder for all tasks of a Python worker."""
    kept = sys.modules.setdefault("_corpus_encoders", types.ModuleType("_corpus_encoders"))
    if path not in kept.__dict__:
        kept.__dict__[path] = TextEncoder(path)
    return kept.__dict__[path]


def encode_all(path: str, texts: Sequence[str | None]) -> list[np.ndarray]:
    enc = encoder(path)
    return [enc.ids(t or "") for t in texts]
