"""Token ids from a tokenizer file, fast on repetitive text.

A text is cut where a token can never cross, each unit is looked up in a bounded cache, and only
units not seen before go to the tokenizers library. Ids are kept as little-endian unsigned 32-bit
bytes, so that a document's ids are one join of byte strings.
"""

from __future__ import annotations

import json
import os
import re
import sys
from array import array
from functools import lru_cache

#: Printable characters below U+0250: one code point each, unchanged by NFC, none of them blank.
_PLAIN_UNIT = re.compile("[ \n]?[\x21-\x7e\u00a1-\u024f]+")
#: Blanks other than space and line feed, and the separators that only Python takes for blanks.
_ODD_BLANK = re.compile("[\t\x0b-\r\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_MARKS = ",.!?:;"
_PYTHON_BLANK = re.compile("[\x1c-\x1f]")


def default_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_symbols() -> dict[int, str]:
    """The printable stand-in of each byte that byte-level vocabularies are spelled with."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(others)}


def _ids(ids: list[int]) -> bytes:
    out = array("I", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


class Kept(dict):
    """What ``make`` gives for a key, kept for keys of up to ``longest`` characters.

    Once keys and values hold half of ``most`` bytes they become the old generation, and the one before is
    dropped; what is asked for again moves back. So a worker's memory is bounded whatever the texts hold.
    """

    #: Bytes of an entry besides its key's and its value's (a rough figure).
    ENTRY = 110

    def __init__(self, make, most: int, longest: int = 100):
        super().__init__()
        self.make, self.most, self.longest, self.held = make, most, longest, 0
        self.old: dict = {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(key) <= self.longest:
            size = sys.getsizeof(key) + sys.getsizeof(value) + self.ENTRY
            if 2 * (self.held + size) > self.most:
                self.old = dict(self)
                self.clear()
                self.held = 0
            self.held += size
            self[key] = value
        return value


class Encoder:
    """Exactly the ids of ``Tokenizer.encode(text, add_special_tokens=False)``.

    ``units`` bounds the bytes of each of two caches of blank-separated units, ``pretokens`` those of the pieces inside
    them. Files of another make than the two known ones are encoded by the library text by text.
    """

    def __init__(self, path: str, units: int = 176 << 20, pretokens: int = 40 << 20):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.vocab_size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.model = self.tokenizer.model
        self.symbols = str.maketrans({chr(b): s for b, s in byte_symbols().items()})
        pre = spec["pre_tokenizer"]
        kinds = [n["type"] for n in (spec["normalizer"] or {}).get("normalizers", [])]
        self.kind = "other"
        if spec["normalizer"] is None and pre["type"] == "ByteLevel" and pre["use_regex"] and not pre["add_prefix_space"]:
            self.kind = "spaced"
            # the published byte-level pattern (fixed value)
            self.split = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+").findall
        elif kinds == ["NFC", "Replace", "Lowercase"] and pre["type"] == "Sequence" and pre["pretokenizers"][0].get("behavior") == "Removed":
            self.kind = "blank"
            self.split = regex.compile(pre["pretokenizers"][0]["pattern"]["Regex"]).findall
        self.pretokens = Kept(self._pretoken, pretokens)
        self.units = Kept(self._word, units)
        # what follows a space, or a line feed, which is kept at the unit's start; the first unit of a
        # text follows neither and is marked by a null character, which no plain unit has
        self.mark = {"\n": lambda u: u, "\0": lambda u: u[1:]}
        self.later = Kept(self._later, units)

    def _whole(self, text: str) -> bytes:
        return _ids(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def _pretoken(self, word: str) -> bytes:
        # an ASCII character is its byte
        text = word if word.isascii() else word.encode().decode("latin-1")
        found = self.model.tokenize(text.translate(self.symbols))
        return _ids([t.id for t in found])

    def _later(self, unit: str) -> bytes:
        # most units are a word, or a word and one mark: the word alone is kept
        if unit.isascii():
            if unit.isalpha():
                return self._pretoken(" " + unit)
            if unit[-1] in _MARKS and unit[:-1].isalpha():
                return self.later[unit[:-1]] + self.pretokens[unit[-1]]
        return self._unit(self.mark.get(unit[0], " ".__add__)(unit))

    def _word(self, unit: str) -> bytes:
        """A unit of a file that drops blanks."""
        if unit.isascii():
            if unit.isalpha():
                return self._pretoken(unit.lower())
            if unit[-1] in _MARKS and unit[:-1].isalpha():
                return self.units[unit[:-1]] + self.pretokens[unit[-1]]
        return self._unit(unit)

    def _unit(self, unit: str) -> bytes:
        if not _PLAIN_UNIT.fullmatch(unit):
            return self._whole(unit)
        if self.kind == "blank":
            unit = unit.lower()
        # the pattern cuts what is more than a word and a mark
        start = 1 if unit[0] == " " else 0
        if unit[start:].isalpha():
            return self.pretokens[unit]
        if unit[-1] in _MARKS and unit[start:-1].isalpha():
            return self.pretokens[unit[:-1]] + self.pretokens[unit[-1]]
        return b"".join(map(self.pretokens.__getitem__, self.split(unit)))

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit bytes."""
        if self.kind == "other" or any(s in text for s in self.special):
            return self._whole(text)
        if self.kind == "blank":
            if _PYTHON_BLANK.search(text):
                return self._whole(text)
            return b"".join(map(self.units.__getitem__, text.split()))
        if _ODD_BLANK.search(text) or "  " in text or " \n" in text or "\n " in text or "\n\n\n" in text or text[-1:] == "\n":
            return self._whole(text)
        units = text.replace("\n", " \n").split(" ")
        if not units[0] or not units[-1] or "\0" in text:
            return self._whole(text)
        units[0] = "\0" + units[0]
        return b"".join(map(self.later.__getitem__, units))


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """This process's encoder of a file: a worker keeps its cache from task to task."""
    return Encoder(path)
