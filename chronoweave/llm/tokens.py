"""Looks up the token ids of texts word by word, so that a vocabulary's merges are worked out once per distinct word.

Byte-level BPE encodes each match of its pattern ("word") separately. Results are kept in two generations, so frequent words
stay and memory is bounded; rare ones are worked out anew when they come back.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

#: Words of one generation.
MEMO = 500_000


class Memo(dict):
    """The newer generation; ``learn`` fills it for all of ``keys``, from the older one or by ``work_out``."""

    def __init__(self, work_out: Callable[[list[str]], Iterable], size: int = MEMO):
        super().__init__()
        self.work_out, self.size, self.older = work_out, size, {}

    def learn(self, keys: set[str]) -> None:
        missing = keys.difference(self)
        if len(self) + len(missing) > self.size:
            self.older = dict(self)
            self.clear()
            missing = keys
        old = self.older
        self.update((key, old[key]) for key in missing if key in old)
        if new := [key for key in missing if key not in self]:
            self.update(zip(new, self.work_out(new)))


#: Code points of the planes that hold assigned characters; private and empty planes are left out.
PLANES = (range(0xD800), range(0xE000, 0x40000), range(0xE0000, 0xE1000))
#: The classes that patterns use, each with a character that stands for its members.
CLASSES = {r"\p{L}": "é", r"\p{N}": "1", r"\s": " "}


def every_character() -> str:
    return "".join(map(chr, (c for plane in PLANES for c in plane)))


def stand_ins(matches: Callable[[str, str], str]) -> dict[int, str]:
    """Characters that a library counts to another class than ``regex`` does, as their Unicode versions differ, and what stands for them.

    ``matches(class, text)`` gives the characters of a text that the library's own expressions find.
    """
    every = every_character()
    theirs = {name: set(matches(name, every)) for name in CLASSES}
    odd = set().union(*(theirs[name] ^ set(regex.findall(name, every)) for name in CLASSES))
    return {ord(c): next((sign for name, sign in CLASSES.items() if c in theirs[name]), "!") for c in odd}


class Lookup:
    """``encode`` maps words to values; ``values`` gives those of each text in order, ``of`` joins them (str or bytes).

    ``odd`` are stand-ins: a text with such characters is cut by their stand-ins' places.
    """

    def __init__(self, pattern: str, encode: Callable[[list[str]], Iterable], empty: str | bytes = "", odd: dict[int, str] | None = None):
        # alternatives that begin with an apostrophe cannot match where a run of letters does, so the frequent runs are tried first
        self.pattern = regex.compile(rf" ?\p{{L}}++|{pattern}" if pattern.startswith("'") else pattern)
        self.empty, self.words, self.odd = empty, Memo(encode), odd or {}
        self.odd_ones = frozenset(map(chr, self.odd))  # thousands; a matcher's class of them is searched one by one

    def cut(self, text: str) -> list[str]:
        if text.isascii() or self.odd_ones.isdisjoint(set(text)):
            return self.pattern.findall(text)
        return [text[slice(*found.span())] for found in self.pattern.finditer(text.translate(self.odd))]

    def values(self, texts: list[str]) -> list[list]:
        parts = list(map(self.cut, texts))
        self.words.learn(set().union(*parts))
        return [list(map(self.words.__getitem__, words)) for words in parts]

    def of(self, texts: list[str]) -> list:
        return list(map(self.empty.join, self.values(texts)))


#: Patterns in which white space follows no other character within a match, and which look ahead only behind white space. So a match
#: ends before each space that no white space precedes, and what lies between such places is cut the same wherever it stands.
SPACED = frozenset({r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"})
#: Parts of one generation, and bytes of the longest one that is kept.
PARTS, PART = 400_000, 64


class PartLookup:
    """``of`` gives the values (bytes) of texts whose pattern is in ``SPACED``, joined from those of the parts between their spaces.

    ``encode`` maps texts to values. Parts not seen before are given to it one after another in one text, and ``cut`` finds their
    bytes again: it maps parts and the value of their text to values. ``white`` holds what the pattern counts as white space.
    """

    def __init__(self, encode: Callable[[list[str]], list[bytes]], cut: Callable[[list[str], bytes], list[bytes] | None], white: Iterable[str]):
        self.encode, self.cut, self.white, self.parts = encode, cut, frozenset(white), Memo(self._work_out, PARTS)

    def _work_out(self, parts: list[str], together: int = 60) -> list[bytes]:
        """Of parts that begin with a space and do not end white, so that each is cut the same behind another one."""
        runs, found = [parts[i:i + together] for i in range(0, len(parts), together)], []
        for run, value in zip(runs, self.encode(list(map("".join, runs)))):
            values = self.cut(run, value)
            found += self.encode(run) if values is None else values
        return found

    def of(self, texts: list[str]) -> list[bytes]:
        if not texts:
            return []
        split = pc.split_pattern(pa.array(texts, pa.large_string()), " ")
        coded = split.values.dictionary_encode()
        joined = pc.binary_join(pa.ListArray.from_arrays([0, len(coded.dictionary)], coded.dictionary), pa.scalar(" ", pa.large_string()))
        names, sizes = joined[0].as_py().split(" "), pc.binary_length(coded.dictionary).to_numpy()
        last = pc.utf8_slice_codeunits(coded.dictionary, -1).dictionary_encode()
        white = np.array([sign in self.white or sign.isspace() for sign in last.dictionary.to_pylist()])[last.indices.to_numpy()]
        place, starts = coded.indices.to_numpy(), split.offsets.to_numpy()[:-1]
        first = np.zeros(len(place), bool)
        first[starts] = True
        # a part that white space ends, or that lies between two spaces, goes on behind the space
        begins = first.copy()
        begins[1:] |= ~(white[place] | ((sizes == 0)[place] & ~first))[:-1]
        begin = np.flatnonzero(begins)
        end = np.append(begin[1:], len(place))
        own = np.flatnonzero(first[begin] | (end - begin > 1))  # other than a space and one part
        kept = ~white & (sizes > 0) & (sizes <= PART)
        keys = [" " + names[k] for k in np.flatnonzero(kept).tolist()]
        self.parts.learn(set(keys))
        others = [" " + names[k] for k in np.flatnonzero(~kept).tolist()]
        others += [("" if first[a] else " ") + " ".join([names[k] for k in place[a:b]]) for a, b in zip(begin[own].tolist(), end[own].tolist())]
        values = pa.array([*map(self.parts.__getitem__, keys), *self.encode(others)], pa.large_binary())
        row = np.where(kept, np.cumsum(kept) - 1, len(keys) + np.cumsum(~kept) - 1)
        part = row[place[begin]]
        part[own] = len(values) - len(own) + np.arange(len(own))
        _, offsets, data = values.take(pa.array(part)).buffers()
        bounds = np.frombuffer(offsets, np.int64, len(part) + 1)[np.append(np.searchsorted(begin, starts), len(part))].tolist()
        whole = memoryview(data) if data else b""
        return [bytes(whole[a:b]) for a, b in zip(bounds, bounds[1:])]


def portions(texts: list[str], size: int = 4 << 20) -> Iterable[list[str]]:
    """Runs of texts of about ``size`` characters."""
    held, total = [], 0
    for text in texts:
        held.append(text)
        total += len(text)
        if total >= size:
            yield held
            held, total = [], 0
    if held:
        yield held
