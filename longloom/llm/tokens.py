"""Token ids of whole texts by a public tokenizer, word by word through a bounded cache.

Both kinds of vocabulary used here cut a text at white space before they merge anything, so that the ids of a text are
the ids of its words one after the other. Words come again and again: a worker remembers the ids of the words it has
seen, and only new ones go through the tokenizers library, many at a time. The tests hold the ids against the library's
own encoding of the whole texts.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterable

import numpy as np

from .worker import kept

CACHE_WORDS = 600_000  # remembered words of a worker, about 150 MB; beyond, the next batch begins anew
CHUNK_WORDS = 4_000
BATCH_TEXTS = 500

_SPACE = " \t\n\r\x0b\x0c"
# what the tokenizers take for white space, which is less than str.isspace does
_ANY_SPACE = _SPACE + "\x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
# a word with the one space before it; white space before that one; white space that stands alone
_SPACED, _ANY_SPACED = (re.compile(rf" ?[^{s}]+|[{s}]+(?![^{s}])|[{s}]") for s in (_SPACE, _ANY_SPACE))
_MARK = "\x01"
_BREAK = "\x00"
_ODD = ("  ", " \n", "\n ", "\n\n", "\t", "\r", "\x0b", "\x0c", _BREAK)
_WIDE = re.compile(f"[{_ANY_SPACE[len(_SPACE):]}]")
_PROBES = ("a", "the", "Word", "naïve", "Straße", "ÉTÉ", "unbelievably", "ÿ")


class WordIds(dict):
    """Word -> its ids as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str):
        super().__init__()
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # a vocabulary that drops white space gives "a b" and "a  b" the same ids
        self.spaced = self._encode("a b") != self._encode("a  b")
        self.folded = self._encode("A b") == self._encode("a b")
        self.between = "\n" if self.spaced else f" {_MARK} "
        self.border = np.frombuffer(self._encode(self.between.strip(" ")), "<u4")[0]
        # a special token ends the text before it, and so a run of white space
        self.special = sorted((t.content for t in self.tokenizer.get_added_tokens_decoder().values()), key=len, reverse=True)
        self.at_special = re.compile(f"({'|'.join(map(re.escape, self.special))})")
        # a word of Latin letters is one piece for the merges; whether this holds of the vocabulary is tried
        self.direct = self._probe()

    def _probe(self) -> bool:
        from tokenizers import models, pre_tokenizers

        signs = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        # how a byte-level vocabulary writes a sign: ASCII letters as they are, a space and what is not ASCII otherwise
        self.signs = [signs.pre_tokenize_str(chr(c))[0][0] for c in range(256)]
        self.model = self.tokenizer.model
        words = [*_PROBES, *(f" {w}" for w in _PROBES)] if self.spaced else _PROBES
        return isinstance(self.model, models.BPE) and all(self._merge(w) == self._encode(w) for w in words)

    def _merge(self, word: str) -> bytes:
        """The ids of a word of letters, which nothing but the merges themselves divides."""
        if self.folded:
            word = word.lower()
        if not word.isascii():
            word = word.translate(self.signs)
        elif word[0] == " ":
            word = self.signs[32] + word[1:]
        return array("I", [t.id for t in self.model.tokenize(word)]).tobytes()

    @staticmethod
    def _latin(word: str) -> bool:
        """Whether a word, less a space before it, is of Latin letters that are one sign each."""
        return (word.isalpha() or word[0] == " " and word[1:].isalpha()) and (word.isascii() or max(word) < "\u0100")

    def _encode(self, text: str) -> bytes:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def split(self, text: str) -> list[str]:
        """The words of a text, with the one space before each where white space counts."""
        if self.spaced:
            odd = any(c in text for c in _ODD) or any(s in text for s in self.special) or not text.isascii() and _WIDE.search(text)
            if not odd:  # every space is the one before a word, every newline stands alone
                return text.replace(" ", f"{_BREAK} ").replace("\n", f"{_BREAK}\n{_BREAK}").split(_BREAK)
            spaced = _SPACED if text.isascii() else _ANY_SPACED
            if any(s in text for s in self.special):
                parts = self.at_special.split(text)
                return [w for i, p in enumerate(parts) for w in ([p] if i % 2 else spaced.findall(p))]
            return spaced.findall(text)
        if self.folded and text.isascii() and "<" not in text:  # the names of special tokens have a case
            text = text.lower()
        for c in _SPACE[1:]:
            text = text.replace(c, " ")
        return [w for w in text.split(" ") if w]

    def learn(self, words: set[str]) -> None:
        """Fill in the ids of words that are not known yet.

        A full stop or comma after a letter is a token of its own, and case may not matter, so fewer are encoded.
        """
        wanted, alone, tails, cased = set(), [], [], []
        for w in words:
            if w[-1] in ".," and w[-2:-1].isascii() and w[-2:-1].isalpha():
                tails.append(w)
                w = w[:-1]
                if w in self:
                    continue
            if self.folded and w.isascii() and "<" not in w and not w.islower():
                cased.append(w)
                w = w.lower()
                if w in self:
                    continue
            wanted.add(w)
        if self.direct:
            letters = [w for w in wanted if self._latin(w)]
            self.update(zip(letters, map(self._merge, letters)))
            wanted.difference_update(letters)
        if self.spaced:
            alone = [w for w in wanted if _MARK in w or not w.strip(_ANY_SPACE) or w.strip(_ANY_SPACE) != w.removeprefix(" ")]
        else:
            alone = [w for w in wanted if _MARK in w]
        wanted.difference_update(alone)
        for word in [*alone, ".", ","]:
            self[word] = self._encode(word)
        together = list(wanted)
        for i in range(0, len(together), CHUNK_WORDS):
            chunk = together[i:i + CHUNK_WORDS]
            text = self.between.join(chunk) + self.between
            ids = np.asarray(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4")
            ends = (4 * np.flatnonzero(ids == self.border)).tolist()
            buffer, starts = ids.tobytes(), [0, *(e + 4 for e in ends[:-1])]
            self.update(zip(chunk, [buffer[a:b] for a, b in zip(starts, ends, strict=True)], strict=True))
        for w in cased:
            self[w] = self[w.lower()]
        for w in tails:
            self[w] = self[w[:-1]] + self[w[-1]]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text; None is an empty text."""
        if len(self) > CACHE_WORDS:
            self.clear()
        self[""] = b""
        out = []
        for i in range(0, len(texts), BATCH_TEXTS):
            split = [self.split(t) if t else [] for t in texts[i:i + BATCH_TEXTS]]
            found = [list(map(self.get, words)) for words in split]
            holes = [[k for k, ids in enumerate(own) if ids is None] for own in found]
            unknown = {words[k] for words, own in zip(split, holes, strict=True) for k in own}
            if unknown:
                self.learn(unknown)
            for words, ids, own in zip(split, found, holes, strict=True):
                for k in own:
                    ids[k] = self[words[k]]
                out.append(b"".join(ids))
        return out


def word_ids(path: str) -> WordIds:
    """The worker's word memory for the tokenizer file at ``path``."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark runs one task per core already
    return kept(f"ids:{path}", lambda: WordIds(path))


def public_path(name: str) -> str:
    """Where a public tokenizer's file lies; the package of tokenizer files is installed on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)
