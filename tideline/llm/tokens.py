"""Token ids of whole texts by a public tokenizer, word by word from a cache."""

from __future__ import annotations

import json
import os
import re
import struct
from functools import lru_cache

import numpy as np

from tideline.llm.common import BLANKS, KEPT, LOWER
from tideline.llm.transducer import byte_symbols

#: Words that a process remembers in each of two generations.
GENERATION = 500_000
#: Longer words are encoded each time, so that the cache's memory is bounded.
CACHED_BYTES = 64
#: A full stop or comma after a letter or digit is a token of its own, also when set apart.
TRAILING = re.compile(rb"(?<=[a-z0-9])([.,])(?=\s)")
#: So are other ASCII marks after a small letter, where no special token is in the text.
MARKS = re.compile(rb"(?:(?<=[a-z])|(?<=\xc3[\x9f-\xb6\xb8-\xbf]))([!-/:-@\[-`{-~]+)(?=\s)")
#: Small ASCII and Latin-1 letters: no step before the model changes or cuts such a word.
PLAIN = re.compile(rb"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+")
#: Such letters with a Latin-1 capital among them: the ids are those of the small forms.
LATIN = re.compile(rb"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])*\xc3[\x80-\x96\x98-\x9e](?:[a-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])*")
#: Bits that a byte before a mark, the mark and the byte behind have for it to be cut off.
BEFORE = bytes(3 if 97 <= b <= 122 else 1 if 48 <= b <= 57 else 0 for b in range(256))
MARK = bytes(
    3 if b in b".," else 2 if 33 <= b <= 126 and not chr(b).isalnum() else 0 for b in range(256)
)
BEHIND = bytes(3 if b in BLANKS else 0 for b in range(256))
#: Steps before the model that make a text the sum of its words (fixed values).
WORDWISE = {
    "normalizer": ["NFC", "Replace", "Lowercase"],
    "split": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+",
}


def _is_wordwise(path: str) -> bool:
    """Whether the file lower-cases, drops white space and cuts words as this module expects."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    steps = (spec.get("normalizer") or {}).get("normalizers", [])
    cutters = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
    return (
        [s["type"] for s in steps] == WORDWISE["normalizer"]
        and [c["type"] for c in cutters] == ["Split", "ByteLevel"]
        and cutters[0]["pattern"] == {"Regex": WORDWISE["split"]}
        and cutters[0]["behavior"] == "Removed" and cutters[0]["invert"]
        and not cutters[1]["add_prefix_space"] and not cutters[1]["use_regex"]
        and spec["model"]["type"] == "BPE" and not spec["model"].get("dropout")
    )


def marks_apart(text: bytes) -> bytes:
    """A blank before most marks that ``parts_of`` would cut off; it finds the rest."""
    before, mark, behind = (np.frombuffer(text.translate(t), np.uint8) for t in (BEFORE, MARK, BEHIND))
    at = np.flatnonzero(before[:-2] & mark[1:-1] & behind[2:]) + 1
    return np.insert(np.frombuffer(text, np.uint8), at, 32).tobytes() if len(at) else text


def parts_of(word: bytes) -> list[bytes]:
    """A word without the marks behind it, and these, where they are tokens of their own."""
    if not MARK[word[-1]]:
        return [word]
    cut = TRAILING.sub(rb" \1", word + b" ")
    if b"<|" not in word:  # special tokens end in a mark
        cut = MARKS.sub(rb" \1", cut)
    return cut.split()


class WordEncoder:
    """Ids as the tokenizer gives them, with words remembered for one that drops white space.

    Such a tokenizer treats what stands between ASCII blanks apart from its
    neighbours, so the ids of a text are those of its words, one after another. It
    lower-cases as well, so words that differ by case or marks behind them are made
    once. With any other tokenizer texts are encoded whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.wordwise = _is_wordwise(path)
        self.model = self.tokenizer.model
        self.symbols = {b: c for c, b in byte_symbols().items()}
        # plain dicts of bytes, which Python's garbage collector passes over
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        KEPT.add(self)

    def forget(self) -> None:
        """Drops the words, not the tokenizer."""
        self.young, self.old = {}, {}

    def _whole(self, text: bytes) -> list[int]:
        return self.tokenizer.encode(text.decode("utf-8", "replace"), add_special_tokens=False).ids

    def _made(self, word: bytes) -> list[int]:
        """Ids of a word; a plain one needs the model of the tokenizer only."""
        if PLAIN.fullmatch(word):
            return [t.id for t in self.model.tokenize(word.decode("latin-1").translate(self.symbols))]
        return self._whole(word)

    def _ids(self, word: bytes) -> bytes:
        """Ids of a word not among the young ones."""
        ids = self.old.get(word)
        if ids is None:
            parts = parts_of(word)
            if len(parts) == 1 and LATIN.fullmatch(word):
                parts = [word.decode().lower().encode()]
            if parts == [word]:
                made = self._made(word)
                ids = struct.pack(f"<{len(made)}I", *made)
            else:
                ids = b"".join([self._word(p) for p in parts])
        if len(word) <= CACHED_BYTES:
            if len(self.young) >= GENERATION:
                # words not used since the last change are forgotten, frequent ones move on
                self.old, self.young = self.young, {}
            self.young[word] = ids
        return ids

    def _word(self, word: bytes) -> bytes:
        ids = self.young.get(word)
        return self._ids(word) if ids is None else ids

    def encode(self, text: bytes) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if not self.wordwise:
            return np.array(self._whole(text), "<u4").tobytes()
        if b"<|" not in text:  # special tokens are told apart by case
            text = marks_apart(text.translate(LOWER))
        words = text.split()
        found = list(map(self.young.get, words))
        if None in found:
            found = [self._word(w) if ids is None else ids for w, ids in zip(words, found)]
        return b"".join(found)


@lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    """The encoder of this process, with what it remembers from earlier tasks of its operator."""
    return WordEncoder(path)
