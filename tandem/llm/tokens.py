"""Token ids by the tokenizers library, with each word encoded once a worker.

Texts are cut where every pattern of the two vocabularies has a boundary anyway,
so that encoding the words one by one gives the ids of the whole text. The
library encodes each distinct word; common words come from a bounded cache.
"""

from __future__ import annotations

import json
import re
import sys
from array import array
from collections.abc import Iterable

import numpy as np

from tandem.llm.words import FORGETS, forget_others

#: A run of white space may be matched across a cut, so such texts go in whole.
RUN = re.compile(r"\s\s")
LONGEST_CACHED = 48
MOST_CACHED = 1_000_000
#: Words kept where a plain word is cheap to encode again.
MOST_PLAIN = 600_000
#: Letters that no edition of Unicode has changed, ASCII digits and signs: what :func:`byte_level` cuts as the library does.
LETTERS = r"A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u02AF\u0400-\u0481\u048A-\u0527\u3041-\u3096\u30A1-\u30FA\u4E00-\u9FA5\uAC00-\uD7A3"
SIGNS = r"!-&(-/:-@\[-`{-~"
PLAIN = re.compile(rf"[\n ]?[{LETTERS}0-9{SIGNS}]+")
PIECES = re.compile(rf"\n| ?[{LETTERS}]+| ?[0-9]+| ?[{SIGNS}]+")
DIGITS_AND_SIGNS = frozenset(chr(c) for c in range(33, 127) if not chr(c).isalpha())
#: The signs that stand for bytes in a byte-level vocabulary.
SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTES = dict(zip(sorted(set(range(256)) - set(SHOWN)), range(256, 324)))

_CODERS: dict[tuple[str, bool], "Coder"] = {}


def coder(path: str, spaced: bool) -> "Coder":
    """This worker's coder for a vocabulary file, kept over tasks; word caches of other operators go."""
    forget_others(_forget)
    if (path, spaced) not in _CODERS:
        _CODERS[path, spaced] = Coder(path, spaced)
    return _CODERS[path, spaced]


def _forget() -> None:
    for kept in _CODERS.values():
        kept.known.clear()


FORGETS.append(_forget)


def byte_level(file: str) -> bool:
    """Whether a vocabulary cuts texts by the pattern of letters, digits and signs alone, and knows bytes."""
    with open(file, encoding="utf-8") as lines:
        given = json.load(lines)
    cut, model = given.get("pre_tokenizer") or {}, given["model"]
    return (given.get("normalizer") is None and all(t["special"] for t in given.get("added_tokens") or [])
            and cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space", True)
            and model.get("type") == "BPE" and not model.get("dropout") and not model.get("continuing_subword_prefix")
            and not model.get("end_of_word_suffix"))


class Coder:
    """``spaced``: the vocabulary keeps the blank before a word as part of it.

    ``encode`` returns each text's ids as little-endian unsigned 32-bit integers.
    Texts are ordinary text throughout, also where they spell a special token.
    """

    def __init__(self, path: str, spaced: bool):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        self.spaced = spaced
        # the arrays of :meth:`words` are as the machine writes them
        self.model = self.library.model if spaced and sys.byteorder == "little" and byte_level(path) else None
        self.known: dict[str, bytes] = {}

    def whole(self, texts: list[str]) -> list[bytes]:
        """Ids of texts given to the library as they are."""
        found = self.library.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(x.ids, dtype="<u4").tobytes() for x in found]

    def words(self, words: list[str]) -> list[bytes]:
        """Ids of words; plain ones by the library's model piece by piece, without its search for pieces."""
        if self.model is None:
            return self.whole(words)
        tokenize, pieces, full = self.model.tokenize, PIECES.findall, PLAIN.fullmatch
        found = []
        for w in words:
            if not full(w):
                found.append(b"")
            elif w.isascii():
                parts = [w] if w[1:].isalpha() and w[0] != "\n" and w[0] not in DIGITS_AND_SIGNS else pieces(w)
                found.append(array("I", [t.id for p in parts for t in tokenize(p.replace(" ", "\u0120").replace("\n", "\u010a"))]).tobytes())
            else:
                found.append(array("I", [t.id for p in pieces(w) for t in tokenize(p.encode().decode("latin-1").translate(BYTES))]).tobytes())
        rest = [i for i, ids in enumerate(found) if not ids]
        for i, ids in zip(rest, self.whole([words[i] for i in rest])):
            found[i] = ids
        return found

    def encode(self, texts: Iterable[str]) -> list[bytes]:
        texts = list(texts)
        cuts = [cut_spaced(t) if self.spaced else cut_unspaced(t) for t in texts]
        if len(self.known) > (MOST_CACHED if self.model is None else MOST_PLAIN):
            self.known.clear()
        missing = [w for w in set().union(*cuts) if w not in self.known] if cuts else []
        self.known.update(zip(missing, self.words(missing)))
        encoded = [b"".join([self.known[w] for w in c]) for c in cuts]
        for w in missing:
            if len(w) > LONGEST_CACHED:
                del self.known[w]
        return encoded


def cut_spaced(text: str) -> list[str]:
    """Before each single blank or line end; the whole text if it has runs of space."""
    if RUN.search(text) or "\0" in text:
        return [text]
    return text.replace("\n", "\0\n").replace(" ", "\0 ").split("\0")


def cut_unspaced(text: str) -> list[str]:
    """At blanks and line ends, which the vocabulary drops."""
    return text.replace("\n", " ").split(" ")
