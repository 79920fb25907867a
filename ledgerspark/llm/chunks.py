"""Splitting texts into pre-tokens, with bounded caches of what pre-tokens stand for."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from itertools import chain, filterfalse, repeat
from operator import add

import regex

#: Entries of one cache at most, some 200 bytes each; a fuller cache is begun anew.
CACHE_ENTRIES = 500_000

#: Stands for a chunk whose text has to be matched in full.
_UNSAFE = object()


class Chunks:
    """Values of whole texts, put together from values of their chunks.

    A single space between other characters always begins a pre-token of the byte-level pattern, so texts
    are cut there and the value of a chunk is remembered as a whole; other texts are matched in full.
    ``encode`` gives the values of new pre-tokens, all at once; ``+`` makes one value of two.
    """

    def __init__(self, pattern: str, encode: Callable[[list[str]], list]):
        self.find, self.encode = regex.compile(pattern).findall, encode
        self.tokens: dict[str, object] = {}
        self.after: dict[str, object] = {}

    def values(self, texts: list[str]) -> list[list]:
        """For each text, the values of its chunks in order."""
        for cache in (self.tokens, self.after):
            if len(cache) > CACHE_ENTRIES:
                cache.clear()
        parts = [t.split(" ") for t in texts]
        first = [p.pop(0) for p in parts]
        # Each chunk is looked up once; what isn't there yet is filled in by place.
        known = [list(map(self.after.get, p)) for p in parts]
        gaps = [[j for j, v in enumerate(k) if v is None] if None in k else [] for k in known]
        new = {p[j] for p, gap in zip(parts, gaps) for j in gap}
        unsafe = set(filter(_odd, new))
        self.after.update(zip(unsafe, repeat(_UNSAFE)))
        odd, heads = {}, {}
        for i, f in enumerate(first):
            if not parts[i] or _odd(f) or _UNSAFE in known[i] or unsafe and not unsafe.isdisjoint(parts[i][j] for j in gaps[i]):
                odd[i] = self.find(texts[i])
            else:
                heads[i] = self.find(f)
        # Letters alone, or with a full stop or comma, need no matching.
        fresh = new - unsafe
        words = [c for c in fresh if c.isalpha()]
        marked = [c for c in fresh if c[-1] in ".," and c[:-1].isalpha()]
        found = {c: self.find(" " + c) for c in fresh.difference(words, marked)}
        begun, stems = [" " + c for c in words], [" " + c[:-1] for c in marked]
        missing = list(set(filterfalse(self.tokens.__contains__, chain(begun, stems, ".,", chain.from_iterable([*odd.values(), *heads.values(), *found.values()])))))
        if missing:
            self.tokens.update(zip(missing, self.encode(missing)))
        token, after = self.tokens.__getitem__, self.after
        after.update(zip(words, map(token, begun)))
        after.update(zip(marked, map(add, map(token, stems), [token(c[-1]) for c in marked])))
        after.update((c, reduce(add, map(token, tokens))) for c, tokens in found.items())
        for p, k, gap in zip(parts, known, gaps):
            for j in gap:
                k[j] = after[p[j]]
        return [list(map(token, odd[i])) if i in odd else [*map(token, heads[i]), *known[i]] for i in range(len(texts))]


def _odd(chunk: str) -> bool:
    """Whether white space stands beside the spaces around this chunk; these then don't bound pre-tokens."""
    return not chunk or chunk[0].isspace() or chunk[-1].isspace()
