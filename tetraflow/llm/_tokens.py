"""Token ids of a byte-level BPE vocabulary, one cached word at a time.

The pre-tokenizer of such a vocabulary cuts a text into words that the model
encodes independently of each other. No word crosses a space or line break
that has no other white space beside it, so such a text is cut there and each
distinct piece is encoded once by the tokenizers library, then looked up. The
caches are bounded; when one is full, its first quarter stays, in which the
frequent words are. A text that holds the string of an added token goes to the
library whole. What the library returns for the whole text is the same; tests
compare them.
"""

from __future__ import annotations

import os
import re

import numpy as np

CACHE_WORDS = 900_000
_TWO_BLANKS = re.compile(r"\s\s")
#: White space beside space and line break, as \s has it.
_OTHER_BLANKS = [chr(x) for x in range(0x3001) if chr(x).isspace() and chr(x) not in " \n"]
_ASCII_BLANKS = [x for x in _OTHER_BLANKS if x.isascii()]


def _blanks_meet(text: str) -> bool:
    """Whether two characters of white space stand side by side; searches for single characters are fast."""
    if "  " in text or " \n" in text or "\n " in text or "\n\n" in text:
        return True
    for blank in _ASCII_BLANKS if text.isascii() else _OTHER_BLANKS:
        if blank in text:
            return _TWO_BLANKS.search(text) is not None
    return False


def _byte_letters() -> dict[int, str]:
    """The letters of a byte-level vocabulary: printable bytes stand for themselves, others follow 255."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class _Cache(dict):
    def __init__(self, encoder: Encoder, before: str) -> None:
        self.encoder, self.before = encoder, before
        self.letters = "".join(encoder.letters[b] for b in before.encode())

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= CACHE_WORDS:
            for old in list(self)[CACHE_WORDS // 4 :]:
                del self[old]
        known = self.encoder
        if piece.isascii() and piece.isalpha():
            ids = b"".join([known.packed[t.id] for t in known.tokenize(self.letters + piece)])
        elif piece and piece[-1] in ".," and piece[:-1].isalpha():  # as ``fresh`` has it, without a copy of the word and its tests
            ids = self[piece[:-1]] + known.at_start[piece[-1]]
        else:
            ids = known.fresh(self.before + piece)
        self[piece] = ids
        return ids


class Encoder:
    """Encodes texts with a vocabulary file of the tokenizers library."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task for each core
        import public_tokenizers
        import regex
        from tokenizers import Tokenizer
        from tokenizers.models import BPE
        from tokenizers.pre_tokenizers import ByteLevel

        self.whole = Tokenizer.from_file(path)
        self.added = [x.content for x in self.whole.get_added_tokens_decoder().values()]
        self.type = np.dtype("<u2" if self.whole.get_vocab_size() <= 65536 else "<u4")
        first = self.whole.pre_tokenizer
        self.by_word = isinstance(self.whole.model, BPE) and self.whole.normalizer is None and isinstance(first, ByteLevel) and first.use_regex and not first.add_prefix_space
        self.words = regex.compile(public_tokenizers.PATTERN).findall
        self.letters, self.tokenize, self.size = _byte_letters(), self.whole.model.tokenize, self.type.itemsize
        self.packed = [i.to_bytes(self.size, "little") for i in range(self.whole.get_vocab_size())]
        self.after_space, self.at_start = _Cache(self, " "), _Cache(self, "")
        self.line_break = self.fresh("\n") if self.by_word else b""

    def fresh(self, text: str) -> bytes:
        """The ids of a text as little-endian integers, by the library's model, word by word."""
        word = text[1:] if text[0] == " " else text
        if word.isalpha():
            return self._word(text)
        if word[:-1].isalpha() and word[-1] in ".,":
            return (self.after_space if len(word) < len(text) else self.at_start)[word[:-1]] + self.at_start[word[-1]]
        words = self.words(text)
        if len(words) > 1:
            return b"".join([self.after_space[w[1:]] if w[0] == " " else self.at_start[w] for w in words])
        return self._word(text)

    def _word(self, word: str) -> bytes:
        letters, packed = word.encode("utf-8", "surrogatepass").decode("latin-1").translate(self.letters), self.packed
        return b"".join([packed[t.id] for t in self.tokenize(letters)])

    def encode(self, text: str | None) -> np.ndarray:
        """The ids of a text; none for null and empty ones."""
        if not text:
            return np.empty(0, dtype=self.type)
        if not self.by_word or any(x in text for x in self.added):  # the library cuts texts at its added tokens first
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, dtype=self.type)
        if _blanks_meet(text):
            return np.frombuffer(self.fresh(text), dtype=self.type)
        out, spaced = [], self.after_space.__getitem__
        for line in text.split("\n"):
            pieces = line.split(" ")
            out.append(self.at_start[pieces[0]] if pieces[0] else b"")
            del pieces[0]
            out += map(spaced, pieces)
            out.append(self.line_break)
        del out[-1]
        return np.frombuffer(b"".join(out), dtype=self.type)


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """This Python worker's encoder for a vocabulary file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
