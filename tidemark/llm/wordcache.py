"""Splitting text so that a byte-level BPE encoder sees each distinct piece once.

In the pre-tokenising pattern a space can only open a match or belong to a run of white space. So where no
white space precedes a space, every space opens a match, and a text is the independent concatenation of the
parts that begin at its spaces. Arrow splits a slice of texts and numbers its distinct parts; only those reach
Python, most of them are found in a bounded cache, and numpy gathers the ids of every text.
"""

from __future__ import annotations

import gc
import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

#: White space (any that some engine counts as such) before a space: such a text isn't cut at its spaces.
CROSSING = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{180e}\x{2000}-\x{200d}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}] "
#: Strings of these characters alone are split by ``re`` with the same classes spelt out.
PLAIN = re.compile("[\t\n\r\x20-\x7e\xa1-ſ]*").fullmatch
LETTER, NUMBER = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-ſ", "0-9\xb2\xb3\xb9\xbc-\xbe"
PLAIN_FIND = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTER}]+| ?[{NUMBER}]+| ?[^\s{LETTER}{NUMBER}]+|\s+(?!\S)|\s+").findall
#: The pre-tokenising pattern that PLAIN_FIND stands for.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class CachedEncoder:
    """Ids of texts as little-endian uint32 bytes.

    ``encode_words(list of pre-tokens) -> list of bytes`` does the BPE; ``encode_odd(list of strings)``, if given,
    takes strings with characters outside PLAIN undivided. A full cache takes nothing more, as the frequent
    pieces come first; it starts anew when most of a slice's pieces are missing from it.
    """

    def __init__(self, pattern: str, encode_words: Callable, encode_odd: Callable | None = None, most: tuple[int, int] = (150_000, 200_000)):
        self.find = regex.compile(pattern).findall
        self.plain_find = PLAIN_FIND if pattern == PATTERN else self.find
        self.encode_words, self.encode_odd = encode_words, encode_odd
        self.most_parts, self.most_words = most
        self.parts: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}

    def _by_words(self, texts: list[str]) -> list[bytes]:
        split, words = [self.plain_find(t) if PLAIN(t) else self.find(t) for t in texts], self.words
        missing = list({w for ws in split for w in ws if w not in words})
        fresh = dict(zip(missing, self.encode_words(missing))) if missing else {}
        if len(words) < self.most_words:
            words.update(fresh)
            return [b"".join([words[w] for w in ws]) for ws in split]
        return [b"".join([words[w] if w in words else fresh[w] for w in ws]) for ws in split]

    def _fresh(self, texts: list[str]) -> list[bytes]:
        if self.encode_odd is None:
            return self._by_words(texts)
        odd = [t for t in texts if not PLAIN(t)]
        if not odd:
            return self._by_words(texts)
        known = dict(zip(odd, self.encode_odd(odd)))
        known.update(zip(rest := [t for t in texts if t not in known], self._by_words(rest)))
        return [known[t] for t in texts]

    def _of_parts(self, parts: list[str]) -> list[bytes]:
        cache = self.parts
        found = list(map(cache.get, parts))
        missing = [i for i, x in enumerate(found) if x is None]
        for i, ids in zip(missing, self._fresh([" " + parts[i] for i in missing])):
            found[i] = ids
        if len(cache) < self.most_parts:
            cache.update((parts[i], found[i]) for i in missing)
        elif len(missing) > 0.8 * len(parts):
            cache.clear()
            self.words.clear()
        return found

    def __call__(self, texts: list[str]) -> list[bytes]:
        """Ids of each text. No cycles arise in here, so the collector rests meanwhile."""
        resting = gc.isenabled()
        gc.disable()
        try:
            return self._encode(texts)
        finally:
            if resting:
                gc.enable()

    def _encode(self, texts: list[str]) -> list[bytes]:
        given = pa.array(texts, pa.large_string())
        crossing = pc.match_substring_regex(given, CROSSING).to_numpy(zero_copy_only=False)
        cut = pc.split_pattern(pc.if_else(pa.array(crossing), pa.scalar("", pa.large_string()), given), " ")
        offsets = cut.offsets.to_numpy()
        numbered = cut.values.dictionary_encode()
        index = numbered.indices.to_numpy().astype(np.int64)
        pieces = self._of_parts(numbered.dictionary.to_pylist())
        first = [texts[i] if crossing[i] else cut.values[int(offsets[i])].as_py() for i in range(len(texts))]
        index[offsets[:-1]] = len(pieces) + np.arange(len(texts))
        pieces += self._fresh(first)
        sizes = np.array([len(p) >> 2 for p in pieces], np.int64)
        at = np.cumsum(sizes) - sizes
        blob = np.frombuffer(b"".join(pieces), "<u4")
        counts = sizes[index]
        stops = np.cumsum(counts)
        ids = blob[np.arange(int(stops[-1]) if len(stops) else 0) + np.repeat(at[index] - (stops - counts), counts)].tobytes()
        ends = np.concatenate([[0], stops])[offsets] * 4
        return [ids[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
