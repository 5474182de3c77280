"""Byte-level BPE by prefix dynamic programming.

For each prefix of a piece of text there is one token that its encoding ends
with. A token may follow another if merging the bytes of the two by rank leaves
just these two; a sequence is an encoding exactly if all its neighbours may
follow each other. So the last token of a prefix is the one token that ends there
and may follow the last token of the prefix before it. A trie of all tokens with links to suffixes names
the ones that end at a byte, longest first. Storing the last tokens makes an append
exact (the table only grows) and an edit cheap: the table is kept up to the edit, and
behind it as soon as as many last tokens as the longest token has bytes are the old ones.
Words are encoded in order, each from the table of the one before: what they begin with in
common is not worked out again.

Defined cases: null is the empty text, with no ids; texts are encoded whole, any
length; special tokens' strings are ordinary text; characters without UTF-8 form
cannot occur in a Spark string. Ids, also null or repeated ones, are carried
along; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from tandem.llm.common import ID, TEXT, id_and_text
from tandem.llm.tokens import LONGEST_CACHED, cut_spaced

#: Words of which a worker keeps the ids, in two generations, and pairs of tokens.
MOST_CACHED = 500_000
#: Characters of the texts whose words are looked up together.
BATCH_CHARS = 2_000_000
#: Bytes in which words are compared with the ones before them.
COMPARED = 32


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


class Vocabulary:
    """Tokens by rank, with what the table of last tokens needs."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.words = {rank: word for word, rank in ranks.items()}
        self.longest = max(map(len, ranks))
        self.follows: dict[int, bool] = {}
        self.spines: dict[int, list[int]] = {}
        self.alone: dict[int, bool] = {}
        self.coded = {rank: rank.to_bytes(4, "little") for rank in self.words}
        self.grow()

    def grow(self) -> None:
        """The trie: ``child`` by node and byte, of each node the node of its longest other suffix, and tokens.

        ``ending`` is the longest token that a node's string ends with (-1: none), ``shorter`` the next one of a token.
        """
        self.child: dict[int, int] = {}
        self.suffix, self.ending, at_node = [0], [-1], {}
        for word, rank in self.ranks.items():
            node = 0
            for byte in word:
                key = node << 8 | byte
                node = self.child.get(key)
                if node is None:
                    node = self.child[key] = len(self.suffix)
                    self.suffix.append(0)
                    self.ending.append(-1)
            at_node[node] = rank
        self.shorter: dict[int, int] = {}
        level = {0: 0}  # nodes of one depth, by depth: a suffix is less deep
        below: dict[int, list[tuple[int, int]]] = {}
        for key, node in self.child.items():
            below.setdefault(key >> 8, []).append((key & 255, node))
        while level:
            deeper = {}
            for parent in level:
                for byte, node in below.get(parent, ()):
                    deeper[node] = 0
                    self.suffix[node] = self.step(self.suffix[parent], byte) if parent else 0
                    longest = self.ending[self.suffix[node]]
                    rank = at_node.get(node)
                    if rank is not None:
                        self.shorter[rank] = longest
                        longest = rank
                    self.ending[node] = longest
            level = deeper

    def step(self, node: int, byte: int) -> int:
        """The node of the longest suffix that is the beginning of a token, one byte on."""
        child = self.child.get
        found = child(node << 8 | byte)
        while found is None and node:
            node = self.suffix[node]
            found = child(node << 8 | byte)
        return found or 0

    def merge(self, text: bytes) -> list[int]:
        """Encoding by definition: join the pair of lowest rank, leftmost first."""
        parts = [text[i:i + 1] for i in range(len(text))]
        while True:
            found = [(self.ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:]))
                     if a + b in self.ranks]
            if not found:
                return [self.ranks[p] for p in parts]
            _, i = min(found)
            parts[i:i + 2] = [parts[i] + parts[i + 1]]

    def spine(self, token: int, side: int) -> list[int]:
        """Parts at one end of the token (0 left, 1 right), from the byte up to it."""
        key = token << 1 | side
        known = self.spines.get(key)
        if known is None:
            halves = self.halves(self.words[token])
            known = [*(self.spine(halves[side], side) if halves else []), token]
            self.spines[key] = known
        return known

    def halves(self, word: bytes) -> tuple[int, int] | None:
        """The two tokens of the last merge; None for a single byte."""
        if len(word) == 1:
            return None
        top, parts = self.ranks[word], [word[i:i + 1] for i in range(len(word))]
        while len(parts) > 2:
            _, i = min((self.ranks.get(a + b, top), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
        return self.ranks[parts[0]], self.ranks[parts[1]]

    def may_follow(self, first: int, second: int) -> bool:
        """Whether no merge crosses from ``first`` into ``second``.

        Merges go by rank, and a token ranks after its parts. So the parts that
        meet at the border are walked upwards in the order in which they grow; a
        token across the border is merged if it ranks before what grows next. Of
        equal ranks the leftmost goes first.
        """
        pair = first << 20 | second
        known = self.follows.get(pair)
        if known is not None:
            return known
        left, right = self.spine(first, 1), self.spine(second, 0)
        words, ranks, never = self.words, self.ranks, 1 << 40
        i = j = 0
        while True:
            grow_left = left[i + 1] if i + 1 < len(left) else never
            grow_right = right[j + 1] if j + 1 < len(right) else never
            across = ranks.get(words[left[i]] + words[right[j]], never)
            if across < grow_left and across <= grow_right:
                known = False
                break
            if grow_left == grow_right == never:
                known = True
                break
            if grow_left <= grow_right:
                i += 1
            else:
                j += 1
        if len(self.follows) > MOST_CACHED:
            self.follows.clear()
        self.follows[pair] = known
        return known

    def stands(self, token: int) -> bool:
        """Whether merging makes the token at all."""
        known = self.alone.get(token)
        if known is None:
            known = self.alone[token] = self.merge(self.words[token]) == [token]
        return known


class PrefixTable:
    """The last token of each prefix of one piece (a match of the pattern)."""

    def __init__(self, vocabulary: Vocabulary, text: bytes = b""):
        self.vocabulary, self.text = vocabulary, b""
        self.last: list[int] = []
        self.nodes: list[int] = []  # of the trie, one a prefix
        self.append(text)

    def append(self, more: bytes) -> None:
        v, last, nodes = self.vocabulary, self.last, self.nodes
        self.text += more
        words, known, child, suffix, ending, shorter = v.words, v.follows.get, v.child.get, v.suffix, v.ending, v.shorter
        end, node = len(last), nodes[-1] if nodes else 0
        for byte in more:
            found = child(node << 8 | byte)
            while found is None and node:
                node = suffix[node]
                found = child(node << 8 | byte)
            node = found or 0
            end += 1
            token = ending[node]
            while token >= 0:
                start = end - len(words[token])
                if start:
                    fits = known(last[start - 1] << 20 | token)
                    if fits is None:
                        fits = v.may_follow(last[start - 1], token)
                else:
                    fits = v.stands(token)
                if fits:
                    break
                token = shorter[token]
            else:
                raise ValueError("the vocabulary lacks a byte of the text")
            last.append(token)
            nodes.append(node)

    def move(self, text: bytes, same: int) -> None:
        """Go on to another text, of which the first ``same`` bytes are those of this one."""
        del self.last[same:], self.nodes[same:]
        self.text = text[:same]
        self.append(text[same:])

    def edit(self, start: int, end: int, new: bytes) -> None:
        """Replace bytes start..end; only last tokens near the edit are worked out anew.

        A last token depends on the bytes and last tokens within the longest token's
        length before it, so once that many are the old ones, so are all that follow.
        """
        tail, old, nodes, near = self.text[end:], self.last[end:], self.nodes[end:], self.vocabulary.longest
        self.text, self.last, self.nodes = self.text[:start], self.last[:start], self.nodes[:start]
        self.append(new)
        for a in range(0, len(tail), near):
            self.append(tail[a:a + near])
            if a + near < len(tail) and min(start, end) + a > near and self.last[-near:] == old[a:a + near]:
                self.text += tail[a + near:]
                self.last += old[a + near:]
                self.nodes += nodes[a + near:]
                return

    def ids(self) -> list[int]:
        ids, end = [], len(self.last)
        while end:
            ids.append(self.last[end - 1])
            end -= len(self.vocabulary.words[ids[-1]])
        return ids[::-1]


class Encoder:
    """Encodes whole texts, match by match; common words come from a bounded cache."""

    def __init__(self, vocabulary: Vocabulary, pattern: str):
        self.vocabulary, self.pattern = vocabulary, regex.compile(pattern)
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}  # the words of the last full cache, dropped when the next one is full

    def words(self, words: list[str]) -> list[bytes]:
        """Ids of each word: of its pieces, in order of their bytes, one after the other by one table."""
        v, split = self.vocabulary, self.pattern.findall
        pieces = [split(word) for word in words]
        coded: dict[str, bytes] = {}
        rest = []
        for piece in set().union(*pieces):
            raw = piece.encode()
            whole = v.ranks.get(raw)
            if whole is not None and v.stands(whole):
                coded[piece] = v.coded[whole]
            else:
                rest.append((raw, piece))
        rest.sort()
        table, number = PrefixTable(v), v.coded.__getitem__
        for (raw, piece), same in zip(rest, shared_starts([raw for raw, _ in rest])):
            table.move(raw, same)
            coded[piece] = b"".join(map(number, table.ids()))
        return [coded[p[0]] if len(p) == 1 else b"".join([coded[x] for x in p]) for p in pieces]

    def encode(self, text: str) -> bytes:
        """Ids as little-endian signed 32-bit integers."""
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """:meth:`encode` of each text; the words of some texts at a time are looked up together."""
        found, start, chars = [], 0, 0
        for end, text in enumerate(texts, 1):
            chars += len(text)
            if chars >= BATCH_CHARS or end == len(texts):
                found += self._together(texts[start:end])
                start, chars = end, 0
        return found

    def _together(self, texts: list[str]) -> list[bytes]:
        cuts = [cut_spaced(text) for text in texts]
        if len(self.known) > MOST_CACHED // 2:
            self.known, self.older = {}, self.known
        known, older = self.known, self.older
        missing = [w for w in set().union(*cuts) if w not in known]
        known.update([(w, older[w]) for w in missing if w in older])
        new = [w for w in missing if w not in older]
        known.update(zip(new, self.words(new)))
        coded = [b"".join([known[w] for w in c]) for c in cuts]
        for word in missing:
            if len(word) > LONGEST_CACHED:
                del known[word]
        return coded


def shared_starts(texts: list[bytes]) -> list[int]:
    """How many bytes, of the first :data:`COMPARED`, each text has in common with the one before."""
    if not texts:
        return []
    first = np.array(texts, dtype=f"S{COMPARED}").view(np.uint8).reshape(-1, COMPARED)
    unlike = np.ones((len(texts), COMPARED + 1), bool)
    unlike[1:, :-1] = first[1:] != first[:-1]
    size = np.fromiter(map(len, texts), np.int64, len(texts))  # an end looks like a zero byte
    same = np.minimum(unlike.argmax(1), np.minimum(size, np.roll(size, 1)))
    same[0] = 0
    return same.tolist()


_LOADED: dict[tuple, object] = {}


def _vocabulary(path: str) -> Vocabulary:
    if path not in _LOADED:
        _LOADED[path] = Vocabulary(read_ranks(path))
    return _LOADED[path]


def _encoder(path: str, pattern: str) -> Encoder:
    if (path, pattern) not in _LOADED:
        _LOADED[path, pattern] = Encoder(_vocabulary(path), pattern)
    return _LOADED[path, pattern]


def encode(docs: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """doc_id and ``ids`` of each whole text; ``ranks`` is a file of token ranks."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(ranks, pattern)
        for batch in batches:
            for a in range(0, batch.num_rows, 1000):
                part = batch.slice(a, 1000)
                coded = encoder.encode_all(part.column(TEXT).to_pylist())
                ends = np.cumsum([0] + [len(c) // 4 for c in coded]).astype("<i4")
                ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(coded), "<i4")))
                yield pa.RecordBatch.from_arrays([part.column(ID), ids], [ID, "ids"])

    return id_and_text(docs).mapInArrow(run, "doc_id long, ids array<int>")


def decode(coded: DataFrame, ranks: str) -> DataFrame:
    """``coded`` (doc_id, ids) with ``decoded``, the bytes that the ids stand for."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, places = _token_bytes(ranks)
        for batch in batches:
            lists = batch.column("ids")
            ends = np.asarray(lists.offsets)
            found = tokens.take(pa.array(places[lists.flatten().to_numpy()]))
            # the tokens of a text lie one after the other, so that it is the bytes from its first to its last
            starts = np.frombuffer(found.buffers()[1], np.int64)[ends - ends[0]]
            decoded = pa.LargeBinaryArray.from_buffers(
                pa.large_binary(), len(lists), [None, pa.py_buffer(starts), found.buffers()[2]])
            yield pa.RecordBatch.from_arrays([batch.column(ID), lists, decoded.cast(pa.binary())], [ID, "ids", "decoded"])

    return coded.select(ID, "ids").mapInArrow(run, "doc_id long, ids array<int>, decoded binary")


def _token_bytes(path: str) -> tuple[pa.LargeBinaryArray, np.ndarray]:
    """The tokens' bytes, and the place of each rank among them."""
    if ("bytes", path) not in _LOADED:
        words = _vocabulary(path).words
        places = np.zeros(max(words) + 1, np.int64)
        places[list(words)] = np.arange(len(words))
        _LOADED["bytes", path] = pa.array(list(words.values()), pa.large_binary()), places
    return _LOADED["bytes", path]
