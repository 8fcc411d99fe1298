"""Token counts by a compiled finite-state tokenizer.

The tokenizer file is compiled into a deterministic transducer over characters that never builds a
token. Its transitions carry the number of tokens by which a character changes the count, which
merges can make negative. A state says what kind of pretoken is open, the open pretoken's last character (it
is spelled differently at a word's end) and the merge state of what is before that.

The merge state rests on two facts about merges learned in order. A sequence of tokens is what the merges
make of its text exactly if every two neighbours are, so each beginning of a pretoken has one last
token, and that is found from the last tokens of shorter beginnings. And no token reaches back
further than the longest end of the text that begins a token. So the state is that end, with the last
tokens and relative counts at its places: finitely many, compiled when first met and kept within a bound.

A blank leads from every state to the start. So a chunk of text is a map from states to states with a
count, given by what it holds before its first blank (``head``), what it emits after that whatever
came before (``inner``) and the state it ends in (``state``); a chunk without a blank is all head. Such maps compose
associatively. Every text is cut into chunks, whose maps are composed pairwise, level by level, as a prefix scan does.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty
from .tokens import Kept, byte_symbols, default_path

#: Unicode's White_Space (fixed value); the other characters that Python calls blank are none.
_WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
_BLANKS = re.compile(f"[{_WHITE}]+")
_MARKS = ",.!?:;"
_SUFFIXES = ("s", "t", "re", "ve", "m", "ll", "d")


def _char_class(c: str) -> str:
    if c in _WHITE:
        return "blank"
    kind = unicodedata.category(c)[0]
    return "letter" if kind == "L" else "digit" if kind == "N" else "other"


class CountTransducer:
    """Counts tokens of a lower-casing word-end BPE file. ``bound`` limits the transitions that are kept.

    States are numbers. A merge state is the longest end of what was read that begins a token (``tails``) and,
    for each place in it (``places``), the last token before it (0: none) times 256, plus 128 and the
    tokens that make up what is before it less those of all that was read. A state of the whole machine is the
    kind of the open pretoken, where an apostrophe that may begin a suffix is a kind of its own,
    the merge state before its last character, and that character. A transition is the next state
    times 4096, plus ZERO and the change of the count.
    """

    ZERO = 2048

    def __init__(self, path: str, bound: int = 600_000):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        kinds = [n["type"] for n in (spec["normalizer"] or {}).get("normalizers", [])]
        if model["type"] != "BPE" or not model["end_of_word_suffix"] or kinds != ["NFC", "Replace", "Lowercase"]:
            raise ValueError("only lower-casing BPE with word ends is compiled")
        self.special = re.compile("(" + "|".join(re.escape(t["content"]) for t in spec["added_tokens"]) + ")")
        # a symbol is a character: the stand-in of a byte, or 0x1000 further on at a word's end
        end, self.byte = model["end_of_word_suffix"], byte_symbols()
        spell = lambda t: t[: -len(end) - 1] + chr(ord(t[-len(end) - 1]) + 0x1000) if t.endswith(end) else t
        self.last_byte = {b: chr(ord(s) + 0x1000) for b, s in self.byte.items()}
        symbols = [*self.byte.values(), *self.last_byte.values()]
        self.tokens = {s: k for k, s in enumerate(symbols, 1)}
        self.parts: list[tuple[int, int] | None] = [None] * (len(symbols) + 1)
        self.born = [-1] * len(self.parts)
        self.rank: dict[tuple[int, int], int] = {}
        self.spines: tuple[dict, dict] = ({}, {})  # no more than the vocabulary has
        for k, m in enumerate(model["merges"]):
            a, b = map(spell, m if isinstance(m, list) else m.split(" ", 1))
            if a + b in self.tokens:
                raise ValueError("a token is made by two merges")
            pair = self.tokens[a], self.tokens[b]
            self.rank[pair] = k
            self.tokens[a + b] = len(self.parts)
            self.parts.append(pair)
            self.born.append(k)
        if max(map(len, self.tokens)) > 126:
            raise ValueError("a token has more symbols than the eight bits of a place can count")
        # tokens that the merges do not make of their own text never occur
        made = [True] * len(self.parts)
        for token in range(len(symbols) + 1, len(self.parts)):
            a, b = self.parts[token]
            made[token] = made[a] and made[b] and self._stays(a, b, self.born[token])
        self.tokens = {t: k for t, k in self.tokens.items() if made[k]}
        self.spines = ({}, {})
        self.begins = {t[:k] for t in self.tokens for k in range(len(t))}
        self.bound = bound
        self.classes: dict[str, str] = {}
        self.utf8: dict[str, tuple[str, str]] = {}
        self.pieces = Kept(self._piece, 128 << 20, longest=40)
        self._forget()

    def _forget(self, state: int | None = None) -> int | None:
        """Drop what was compiled and give ``state``, if any, its new number."""
        kept = None if state is None else (self.kinds[state], self.tails[self.merged[state]], self.places[self.merged[state]], self.lasts[state])
        self.tails, self.places, self.merge_ids, self.pushes = [], [], {}, {}
        self.kinds, self.merged, self.lasts, self.state_ids, self.moves = [], [], [], {}, {}
        self.ends: dict[int, int] = {}
        self.together: dict[int, bool] = {}
        self._merge_state("", (128,))
        self._state("start", 0, "")
        return kept and self._state(kept[0], self._merge_state(kept[1], kept[2]), kept[3])

    def _merge_state(self, tail: str, places: tuple[int, ...]) -> int:
        new = len(self.tails)
        got = self.merge_ids.setdefault((tail, places), new)
        if got == new:
            self.tails.append(tail)
            self.places.append(places)
        return got

    def _state(self, kind: str, merged: int, last: str) -> int:
        new = len(self.kinds)
        got = self.state_ids.setdefault((kind, merged, last), new)
        if got == new:
            self.kinds.append(kind)
            self.merged.append(merged)
            self.lasts.append(last)
        return got

    # merges

    def _spine(self, token: int, side: int) -> list[tuple[int, int, int]]:
        """(token, when it is made, when it is merged) along one edge of a token's merges."""
        out = self.spines[side].get(token)
        if out is None:
            out, at, until = [], token, 1 << 60
            while True:
                out.append((at, self.born[at], until))
                if self.parts[at] is None:
                    break
                until, at = self.born[at], self.parts[at][side]
            self.spines[side][token] = out
        return out

    def _stays(self, a: int, b: int, before: int = 1 << 60) -> bool:
        """Whether no merge learned before ``before`` crosses from token a's text to token b's: none of their edges meet while both exist."""
        right, rank = self._spine(b, 0), self.rank
        for x, made, until in self._spine(a, 1):
            for y, y_made, y_until in right:
                r = rank.get((x, y))
                # of equal pairs side by side the left one merges first
                if r is not None and r < before and made < r < until and y_made < r <= y_until:
                    return False
        return True

    def _last(self, text: str, places: tuple[int, ...]) -> tuple[int, int]:
        """The last token of what a state read and one more symbol, and by how many tokens the symbol changes the count."""
        tokens, together, k = self.tokens, self.together, 0
        for place in places:
            found = tokens.get(text[k:])
            if found is not None:
                key = place >> 8 << 20 | found
                fits = place < 256 or together.get(key)
                if fits is None:
                    if len(together) > 4 * self.bound:
                        together.clear()
                    fits = together[key] = self._stays(place >> 8, found)
                if fits:
                    return found, (place & 255) - 127
            k += 1
        raise ValueError("a symbol that is no token")

    def _read(self, state: int, symbols: str) -> tuple[int, int]:
        """The merge state after some more symbols, and by how many tokens they change the count."""
        n = 0
        for symbol in symbols:
            key = state << 13 | ord(symbol)
            got = self.pushes.get(key)
            if got is None:
                text, places, begins, k = self.tails[state] + symbol, self.places[state], self.begins, 0
                token, change = self._last(text, places)
                while text[k:] not in begins:
                    k += 1
                after = self._merge_state(text[k:], (*[p - change for p in places[k:]], token << 8 | 128))
                got = self.pushes[key] = after << 12 | change + self.ZERO
            state = got >> 12
            n += (got & 4095) - self.ZERO
        return state, n

    def _spelled(self, c: str) -> tuple[str, str]:
        """A character's symbols inside a word and at its end."""
        got = self.utf8.get(c)
        if got is None:
            data = c.encode()
            inside = "".join(map(self.byte.__getitem__, data))
            got = self.utf8[c] = inside, inside[:-1] + self.last_byte[data[-1]]
        return got

    # characters

    def _word(self, word: str) -> int:
        """Tokens of a whole pretoken."""
        # ASCII letters and marks are their own symbols
        s, n = self._read(0, word[:-1] if word.isascii() else "".join(self._spelled(c)[0] for c in word[:-1]))
        return n + self._close(s, word[-1])

    def _close(self, merged: int, last: str) -> int:
        """By how many tokens a word's last character changes the count."""
        symbols = self._spelled(last)[1]
        merged, n = self._read(merged, symbols[:-1])
        return n + self._last(self.tails[merged] + symbols[-1], self.places[merged])[1]

    def end(self, s: int) -> int:
        """Tokens that a blank or the end of the text adds."""
        n = self.ends.get(s)
        if n is None:
            kind = self.kinds[s]
            n = 0 if kind == "start" else sum(map(self._word, kind)) if kind[0] == "'" else self._close(self.merged[s], self.lasts[s])
            self.ends[s] = n
        return n

    def _step(self, s: int, c: str) -> tuple[int, int]:
        """The state that a character leads to and what it emits."""
        kind = self.classes.get(c)
        if kind is None:
            kind = self.classes[c] = _char_class(c)
        open_ = self.kinds[s]
        if open_ == "start":
            if kind == "blank":
                return 0, 0
            if kind == "digit":
                return 0, self._word(c)
            return self._state("'" if c == "'" else kind, 0, c), 0
        if open_ == kind:
            merged, n = self._read(self.merged[s], self._spelled(self.lasts[s])[0])
            return self._state(kind, merged, c), n
        if open_[0] == "'":
            suffix = open_[1:] + c
            if suffix in _SUFFIXES:
                return 0, self._word("'" + suffix)
            if any(x.startswith(suffix) for x in _SUFFIXES):
                return self._state("'" + suffix, 0, c), 0
            if open_ == "'" and kind == "other":
                merged, n = self._read(0, self._spelled("'")[0])
                return self._state("other", merged, c), n
            # no suffix: the apostrophe is a pretoken and what followed it begins another
            after, n = self.run(0, suffix)
            return after, self._word("'") + n
        after, n = self._step(0, c)
        return after, self.end(s) + n

    def run(self, s: int, text: str) -> tuple[int, int]:
        """Read text from a state: the state it leads to and what it emits. Transitions are compiled when first met."""
        n, moves = 0, self.moves
        for c in text:
            key = s << 21 | ord(c)
            got = moves.get(key)
            if got is None:
                after, change = self._step(s, c)
                got = moves[key] = after << 12 | change + self.ZERO
            s = got >> 12
            n += got & 4095
        return s, n - self.ZERO * len(text)

    # chunks

    def _piece(self, piece: str) -> int:
        """Tokens of the path from START over a piece without a blank, and back."""
        # most are one pretoken of letters, or that and a mark: the merge states alone tell these
        if piece.isalpha():
            return self._word(piece)
        if piece[:-1].isalpha() and piece[-1:] in _MARKS:
            return self._word(piece[:-1]) + self._word(piece[-1])
        s, n = self.run(0, piece)
        return n + self.end(s)

    def normalize(self, text: str) -> str:
        text = text if text.isascii() else unicodedata.normalize("NFC", text)
        # letter by letter: the library knows no final sigma
        return text.lower() if "Σ" not in text else "".join(c.lower() for c in text)

    def chunk_map(self, chunk: str) -> tuple[str, int, int | None]:
        """(head, inner, state) of a chunk of normalized text; state None where it has no blank and so no reset."""
        pieces = _BLANKS.split(chunk)
        if len(pieces) == 1:
            return chunk, 0, None
        state, n = self.run(0, pieces[-1])
        return pieces[0], n + sum(map(self.pieces.__getitem__, pieces[1:-1])), state

    def compose(self, a: tuple[str, int, int | None], b: tuple[str, int, int | None]) -> tuple[str, int, int | None]:
        """The map that reads a and then b; associative."""
        if a[2] is None:
            return a[0] + b[0], b[1], b[2]
        state, n = self.run(a[2], b[0])
        if b[2] is None:
            return a[0], a[1] + n, state
        return a[0], a[1] + n + self.end(state) + b[1], b[2]

    def scan(self, maps: list[tuple[str, int, int | None]]) -> tuple[str, int, int | None]:
        """Compose a sequence of maps pairwise, level by level."""
        while len(maps) > 1:
            maps = [self.compose(*maps[k : k + 2]) if k + 1 < len(maps) else maps[k] for k in range(0, len(maps), 2)]
        return maps[0] if maps else ("", 0, None)

    def finish(self, whole: tuple[str, int, int | None]) -> int:
        """Tokens that the map emits from START to the end of the text."""
        head, inner, state = whole
        return self.pieces[head] + inner + (self.end(state) if state is not None else 0)

    def count(self, text: str, chunk_chars: int = 4096, block: int = 64) -> int:
        """Tokens of a whole text. Special strings are one token each, as the library's default has it, and part it.

        Compiled transitions may be dropped after each ``block`` of chunks.
        """
        n = 0
        for k, part in enumerate(self.special.split(text)):
            if k % 2:
                n += 1
                continue
            part, whole = self.normalize(part), ("", 0, None)
            for at in range(0, len(part), block * chunk_chars):
                chunks = part[at : at + block * chunk_chars]
                whole = self.compose(whole, self.scan([self.chunk_map(chunks[k : k + chunk_chars]) for k in range(0, len(chunks), chunk_chars)]))
                if len(self.moves) + len(self.pushes) > self.bound:
                    whole = whole[0], whole[1], self._forget(whole[2])
            n += self.finish(whole)
        return n


@lru_cache(maxsize=2)
def transducer(path: str) -> CountTransducer:
    """This process's transducer of a file: a worker keeps what it has compiled from task to task."""
    return CountTransducer(path)


def count_tokens(docs: DataFrame, tokenizer: str | None = None, limit: int = 2048, chunk_chars: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every whole text (null: empty), a row for each row.

    Texts of every length go the same way: chunks of ``chunk_chars`` characters, their state maps,
    and the scan over these. Narrow: nothing is shuffled, and rows that repeat keep their number.
    """
    tokenizer = tokenizer or default_path("word_bpe_49k.json")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = transducer(tokenizer)
        for batch in batches:
            n = [machine.count(t, chunk_chars) for t in batch[2].to_pylist()]
            yield pa.record_batch([batch[0], batch[1], pa.array(n, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    text = text_or_empty(text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
