"""Pre-tokens of the two JSON tokenizers, exactly as their library cuts them, and bounded caches over them.

Both pre-tokenizers never let a piece reach over a space that stands alone, so a text is cut at single spaces and
line ends by str.split and only chunks that were not met before are looked at closely.
"""

from __future__ import annotations

import functools
import gc
import json
import unicodedata
from collections.abc import Callable

import regex

#: The word pattern of byte_bpe_50k (fixed value, from the published tokenizer). Words are by far the most frequent match, so
#: their alternative is tried first, for speed; no two alternatives begin with the same character but blanks, so the order is free.
BYTE_PATTERN = r" ?\p{L}+|'(?:s|t|re|ve|m|ll|d)| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The word pattern of word_bpe_49k (fixed value, from its file).
WORD_PATTERN = r"'(?:s|t|re|ve|m|ll|d)|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+"
#: White space other than the blank and the line end (fixed values): what Python's str.split or the library cuts at besides.
_OTHER_SPACES = "\t\r\v\f\x1c\x1d\x1e\x1f"
_OTHER_WIDE_SPACES = "\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
#: Entries of each of a cache's two generations, and the longest key that is kept.
CACHE_ENTRIES = 400_000
CACHE_CHARS = 64


class Cache(dict):
    """chunk -> value, with two generations: what was not used since the older one filled up is forgotten."""

    def __init__(self, make: Callable[[str], object], entries: int = CACHE_ENTRIES):
        gc.set_threshold(200_000, 50, 100)  # strings and bytes make no cycles, but their number sets off collections
        self.make, self.entries, self.old = make, entries, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
            if len(key) > CACHE_CHARS:
                return value
        if len(self) >= self.entries:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


def byte_symbols() -> dict[int, str]:
    """The printable character for each byte in byte-level vocabularies (the published rule)."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return {b: chr(b) if b in set(keep) else chr(next(rest)) for b in range(256)}


@functools.cache
def spec(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        return json.load(f)


@functools.cache
def library(path: str):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_padding()
    t.no_truncation()
    return t


def _disputed() -> regex.Pattern:
    """Code points that the Unicode tables of `regex` and of Python class differently: the library may follow either."""
    every = "".join(chr(c) for c in range(0x100, 0x110000) if not 0xD800 <= c < 0xE000)
    kinds = {k: set() for k in ("L", "N", "Cn")}
    for c in every:
        kind = unicodedata.category(c)
        if kind == "Cn" or kind[0] in "LN":
            kinds[kind if kind == "Cn" else kind[0]].add(c)
    found = sorted(set().union(*(kinds[k] ^ set(regex.findall(rf"\p{{{k}}}", every)) for k in kinds)))
    return regex.compile("[" + "".join(f"\\U{ord(c):08x}" for c in found) + "]") if found else regex.compile(r"(?!)")


@functools.cache
def disputed() -> regex.Pattern:
    return _disputed()


def is_plain(text: str) -> bool:
    """Whether all code points are ones on whose class the library and `regex` agree."""
    try:
        text.encode("latin-1")
        return True
    except UnicodeEncodeError:
        return disputed().search(text) is None


def added_tokens(path: str) -> dict[str, int]:
    return {x["content"]: x["id"] for x in spec(path)["added_tokens"]}


@functools.cache
def _added_pattern(path: str) -> regex.Pattern:
    return regex.compile("(" + "|".join(regex.escape(x) for x in sorted(added_tokens(path), key=len, reverse=True)) + ")")


def segments(path: str, text: str) -> list[tuple[str, int | None]]:
    """The text cut at the tokenizer's special strings: (text, None) or (string, id)."""
    added = added_tokens(path)
    if "<|" not in text:
        return [(text, None)]
    return [(x, added.get(x)) for x in _added_pattern(path).split(text) if x]


def other_spaces(text: str) -> bool:
    """Whether the text has white space that is neither a blank nor a line end."""
    return any(c in text for c in _OTHER_SPACES) or not text.isascii() and any(c in text for c in _OTHER_WIDE_SPACES)


class BytePretokens:
    """byte_bpe_50k: chunks, and the pre-tokens of a chunk."""

    def __init__(self, path: str):
        self.path, self.find = path, regex.compile(BYTE_PATTERN).findall
        self.cut = library(path).pre_tokenizer.pre_tokenize_str

    def chunks(self, text: str) -> list[str]:
        """Strings that are cut independently of one another and give the text when joined."""
        if not text:
            return []
        pieces, bare = self.keys(text)
        if bare:
            pieces[1:] = [p if p[0] == "\n" else " " + p for p in pieces[1:]]
        return pieces

    def keys(self, text: str) -> tuple[list[str], bool]:
        """As chunks(); if the second value is true, without the space that begins every chunk but the first and those that begin with a line end.

        That is so where single spaces and line ends are the only white space, none at either end. Without other white
        space a piece holds one word at most, a line end only before it, so equal numbers of pieces and words mean that
        every piece holds exactly one: none is empty and none a line end alone.
        """
        if not other_spaces(text):
            pieces = text.replace("\n", " \n").split(" ")
            if len(pieces) == len(text.split()):
                return pieces, True
        return self.pretokens(text), False

    def pretokens(self, text: str) -> list[str]:
        kind = simple(text[1:]) if text[:1] == " " else 0
        if kind:
            return [text] if kind == 1 else [text[:-1], text[-1]]
        if is_plain(text):
            return self.find(text)
        return [text[a:b] for _, (a, b) in self.cut(text)]


class WordPretokens:
    """word_bpe_49k: lower-cased NFC words; white space only separates."""

    def __init__(self, path: str):
        self.path, self.find = path, regex.compile(WORD_PATTERN).findall
        self.odd = regex.compile("[\x1c-\x1f]").search
        self.lib = library(path)

    def chunks(self, text: str) -> list[str]:
        if self.odd(text):  # str.split also cuts at these, which are no white space for the library
            return regex.split(r"\s+", text)
        return text.split()

    def pretokens(self, chunk: str) -> list[str]:
        """The byte-level pre-tokens of a chunk, as characters of the vocabulary."""
        kind = simple(chunk)
        if kind and len(chunk) == len(chunk.lower()):  # composed Latin letters: NFC as they are
            low = byte_level(chunk.lower())
            return [low] if kind == 1 else [low[:-1], low[-1]]
        if not is_plain(chunk):
            return [s for s, _ in self.lib.pre_tokenizer.pre_tokenize_str(self.lib.normalizer.normalize_str(chunk))]
        low = unicodedata.normalize("NFC", chunk).replace("Σ", "σ").lower()
        if not is_plain(low):
            return [s for s, _ in self.lib.pre_tokenizer.pre_tokenize_str(low)]
        return [byte_level(x) for x in self.find(low)]


@functools.cache
def _table() -> tuple[list[str], dict[int, str]]:
    symbols = byte_symbols()
    return [symbols[b] for b in range(256)], {c: "".join(symbols[b] for b in chr(c).encode("utf-8")) for c in range(0x250)}


def byte_level(text: str) -> str:
    """The bytes of a text as characters of byte-level vocabularies; Latin letters by one translation."""
    table, latin = _table()
    if text.isascii() or max(text) < "\u0250":
        return text.translate(latin)
    return "".join([table[b] for b in text.encode("utf-8")])


#: Punctuation that may end an otherwise alphabetic chunk without a closer look.
_END = frozenset(".,;:!?")


def simple(chunk: str) -> int:
    """1 if the chunk is one run of letters, 2 if it is that and one mark at its end, else 0. Only for plain Latin letters."""
    if chunk.isalpha():
        return 1 if chunk.isascii() or max(chunk) < "\u0250" else 0
    if chunk[-1:] in _END and (head := chunk[:-1]).isalpha():
        return 2 if head.isascii() or max(head) < "\u0250" else 0
    return 0
