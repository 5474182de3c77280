"""Numbers for words, worked out once a worker for common words."""

from __future__ import annotations

import re
from collections.abc import Callable

LETTERS = re.compile(r"[^\W\d_]+|\d+|[^\w\s]+|_+")
LONGEST_CACHED = 64
MOST_CACHED = 600_000


class WordCache:
    """``make`` of each word (bytes between ASCII white space), kept while there is room.

    ``make`` gets several words at once.
    """

    def __init__(self, make: Callable[[list[bytes]], list]):
        self.make, self.known = make, {}

    def look(self, words: list[bytes]) -> list:
        try:
            return [self.known[w] for w in words]
        except KeyError:
            pass
        if len(self.known) > MOST_CACHED:
            self.known.clear()
        missing = list({w for w in words if w not in self.known})
        made = dict(zip(missing, self.make(missing)))
        self.known.update((w, v) for w, v in made.items() if len(w) <= LONGEST_CACHED)
        return [self.known[w] if w in self.known else made[w] for w in words]


_CACHES: dict[str, WordCache] = {}
#: What empties the caches of a kind; a worker outlives a stage of the pipeline and would keep those of all.
FORGETS: list[Callable[[], None]] = [_CACHES.clear]


def forget_others(mine: Callable[[], None]) -> None:
    for forget in FORGETS:
        if forget is not mine:
            forget()


def cache(key: str, make: Callable[[list[bytes]], list]) -> WordCache:
    """This worker's cache for one model; the caches of earlier models go, and those of other kinds."""
    forget_others(FORGETS[0])
    if key not in _CACHES:
        for old in [k for k in _CACHES if k.split(":")[0] == key.split(":")[0]]:
            del _CACHES[old]
        _CACHES[key] = WordCache(make)
    return _CACHES[key]
