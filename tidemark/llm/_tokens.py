"""Token ids of whole texts through caches of short pieces, in bounded memory.

A text is cut at spaces where the splitting pattern always starts a new match. A piece that is met for the first time is
cut into the pattern's matches, and only matches never met are encoded. Ids are kept packed as little-endian unsigned
integers, so that joining bytes is all that a known piece costs.
"""

from __future__ import annotations

import os
from array import array
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import regex

#: Fixed value: the pattern of byte-level vocabularies, for which the cuts below hold.
BYTE_LEVEL = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: A space after which this pattern always starts a new match.
_BEFORE_WORD = regex.compile(r" (?=[^\s\x1c-\x1f])")
_GAP = regex.compile(r"[ \n\t]")
#: White space but the plain space and the line feed; the first eight are ASCII.
_OTHER_SPACE = "\t\x0b\x0c\r\x1c\x1d\x1e\x1f" + "".join(map(chr, [0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
#: ASCII marks but the apostrophe: after letters they are a match of their own.
_MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"


class Cache(dict):
    """What make gives for a key, kept in two generations of at most size entries: what is in use stays."""

    def __init__(self, make: Callable[[str], bytes], size: int):
        self.make, self.size, self.old = make, size, {}

    def __missing__(self, key: str) -> bytes:
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= self.size:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


class PieceEncoder:
    """Packed ids of texts.

    encode: ids of a match of the pattern. byte_level: texts are split by BYTE_LEVEL; otherwise white space is dropped and
    separates, and encode takes whatever stands between. The cache has two generations of cached pieces; texts are taken
    in windows of about window characters, however long they are.

    A cache key of a byte-level encoder is what follows a space; a text's first piece has a space before it instead, and
    one that begins with a line feed follows no space.
    """

    def __init__(self, encode: Callable[[str], list[int]], byte_level: bool, dtype=np.uint16, cached: int = 300_000, window: int = 1 << 20):
        self.encode_match, self.byte_level, self.dtype, self.window = encode, byte_level, np.dtype(dtype), window
        self.code = "H" if self.dtype.itemsize == 2 else "I"
        self.known = Cache(self._made_of, cached)
        self.marks = Cache(self._packed, 10_000)
        self._matches = regex.compile(BYTE_LEVEL).findall

    def _packed(self, match: str) -> bytes:
        return array(self.code, self.encode_match(match)).tobytes()

    def _made_of(self, key: str) -> bytes:
        """The ids of a cache key."""
        if key.isalpha():
            return self._packed(" " + key if self.byte_level else key)
        word = key.rstrip(_MARKS)
        if word.isalpha() and "İ" not in word:  # letters, and marks that stand alone (İ in lower case is no letter)
            return self.known[word] + self.marks[key[len(word) :]]
        if not self.byte_level:
            return self._packed(key) if key else b""
        if key[:1] in "\n ":
            word = key[1:]
            if word.isalpha():
                return self.marks["\n"] + self.known[" " + word] if key[0] == "\n" else self._packed(word)
            return b"".join(map(self._packed, self._matches(key if key[:1] == "\n" else word)))
        return b"".join(map(self._packed, self._matches(" " + key)))

    def _pieces(self, text: str, first: bool) -> list[str]:
        """Cache keys of a window."""
        if not self.byte_level:
            return text.replace("\n", " ").replace("\t", " ").split(" ")
        odd = _OTHER_SPACE[:8] if text.isascii() else _OTHER_SPACE
        if not first or "  " in text or " \n" in text or "\n\n\n" in text or "\n\n " in text or text[-1:] in " \n" or any(c in text for c in odd):
            parts = _BEFORE_WORD.split(text)
        else:
            # one or two line feeds between words are matches of their own, and the word after them has no space
            parts = text.replace("\n", " \n").split(" ")
        if first:
            parts[0] = " " + parts[0]
        return parts

    def _windows(self, text: str) -> Iterator[tuple[str, bool]]:
        at, first = 0, True
        gap = _BEFORE_WORD if self.byte_level else _GAP
        while len(text) - at > self.window and (m := gap.search(text, at + self.window)):
            yield text[at : m.start()], first
            at, first = m.end(), False
        yield (text[at:] if at else text), first

    def encode(self, texts: Iterable[str]) -> Iterator[bytes]:
        """Packed ids of each text, in order."""
        get = self.known.__getitem__
        for text in texts:
            if len(text) <= self.window:
                yield b"".join(map(get, self._pieces(text, True)))
            else:
                yield b"".join(b"".join(map(get, self._pieces(*w))) for w in self._windows(text))


def _byte_letters() -> dict[int, int]:
    """The letter that byte-level vocabularies write for each byte: itself if printable, else the next from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    return {b: b for b in plain} | {b: 0x100 + i for i, b in enumerate(b for b in range(256) if b not in plain)}


@lru_cache(maxsize=4)
def library_encoder(path: str) -> PieceEncoder:
    """Ids as the tokenizers library gives them without special tokens; special tokens' strings are ordinary text.

    Texts of letters go to the library's model as its own first steps would give them; all others go through the whole of it.
    """
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    steps = str(t.pre_tokenizer)
    byte_level = "ByteLevel" in steps and "Split" not in steps and t.normalizer is None
    letters, model = _byte_letters(), t.model

    def encode(part: str) -> list[int]:
        if (part[1:] if byte_level and part[:1] == " " else part).isalpha() and "ByteLevel" in steps:
            shown = part if t.normalizer is None else t.normalizer.normalize_str(part)
            if byte_level or shown.isalpha():
                shown = shown.replace(" ", "Ġ") if shown.isascii() else shown.encode().decode("latin-1").translate(letters)
                return [x.id for x in model.tokenize(shown)]
        return t.encode(part, add_special_tokens=False).ids

    return PieceEncoder(encode, byte_level, np.uint16 if t.get_vocab_size() <= 1 << 16 else np.uint32)
