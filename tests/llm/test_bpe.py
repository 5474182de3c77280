import hashlib
import os

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from tandem.llm.bpe import COMPARED, Encoder, PrefixTable, Vocabulary, decode, encode, read_ranks, shared_starts
from tests.llm.conftest import EDGES

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
VOCABULARY = Vocabulary(read_ranks(RANKS))
LIBRARY = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=VOCABULARY.ranks,
                            special_tokens={})


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_encoder_equals_the_library(text):
    text = text.encode("utf-8", "ignore").decode()
    found = np.frombuffer(Encoder(VOCABULARY, public_tokenizers.PATTERN).encode(text), "<i4").tolist()
    assert found == LIBRARY.encode_ordinary(text)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from([b"the", b"ing", b" ", b"er", b"\xc3\xa9", b"aaaa", b"tion"]), max_size=8),
       st.integers(0, 20), st.integers(0, 20), st.binary(max_size=6))
def test_appends_and_edits_equal_encoding_anew(parts, a, b, new):
    table = PrefixTable(VOCABULARY)
    for part in parts:
        table.append(part)
    text = b"".join(parts)
    assert table.ids() == (VOCABULARY.merge(text) if text else [])
    a, b = sorted((min(a, len(text)), min(b, len(text))))
    table.edit(a, b, new)
    text = text[:a] + new + text[b:]
    assert table.text == text and table.ids() == (VOCABULARY.merge(text) if text else [])


def test_an_edit_reuses_what_is_far_from_it(monkeypatch):
    text = b"".join([b"thequickbrownfox", b"jumpsoverthelazydog"][i % 2] for i in range(400))
    table, worked = PrefixTable(VOCABULARY, text), []
    real = PrefixTable.append
    monkeypatch.setattr(PrefixTable, "append", lambda self, more: worked.append(len(more)) or real(self, more))
    table.edit(3000, 3004, b"XYZ")
    assert table.ids() == VOCABULARY.merge(text[:3000] + b"XYZ" + text[3004:])
    assert table.text == text[:3000] + b"XYZ" + text[3004:] and len(table.last) == len(table.text)
    assert sum(worked) < 600


def test_full_caches_give_the_same_ids(monkeypatch):
    from tandem.llm import bpe

    monkeypatch.setattr(bpe, "MOST_CACHED", 6)
    encoder = Encoder(VOCABULARY, public_tokenizers.PATTERN)
    text = " ".join(f"word{i % 17} thing{i % 5}" for i in range(200))
    assert np.frombuffer(encoder.encode(text), "<i4").tolist() == LIBRARY.encode_ordinary(text)


def test_words_go_on_from_the_table_of_the_word_before(monkeypatch):
    """Words of a batch begin alike; what they have in common is worked out once."""
    words = [f"conmutationalisch{a}{b}{'x' * (a == 'b') * 40}" for a in "abcdefgh" for b in ("", "isc", "unglich", "\u00e9n")]
    worked, real = [], PrefixTable.append
    monkeypatch.setattr(PrefixTable, "append", lambda self, more: worked.append(len(more)) or real(self, more))
    found = Encoder(VOCABULARY, public_tokenizers.PATTERN).encode_all([" ".join(words), "", " ".join(words[::-1])])
    assert [np.frombuffer(x, "<i4").tolist() for x in found] == [
        LIBRARY.encode_ordinary(t) for t in (" ".join(words), "", " ".join(words[::-1]))]
    assert sum(worked) * 2 < sum(len(w.encode()) + 1 for w in words)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab\0é", max_size=45), max_size=12))
def test_shared_starts_are_no_longer_than_what_is_shared(texts):
    texts = sorted(t.encode() for t in texts)
    found = shared_starts(texts)
    assert len(found) == len(texts) and not sum(found[:1])
    for a, b, n in zip(texts, texts[1:], found[1:]):
        assert n == min(COMPARED, len(os.path.commonprefix([a, b])))


def test_a_pair_may_stand_if_merging_leaves_it():
    made = np.random.default_rng(5).integers(0, 50_000, (3000, 2)).tolist()
    for a, b in made:
        whole = VOCABULARY.merge(VOCABULARY.words[a] + VOCABULARY.words[b])
        assert VOCABULARY.may_follow(a, b) == (whole == [a, b])


def test_documents_round_trip(edges):
    rows = decode(encode(edges, RANKS, public_tokenizers.PATTERN), RANKS).collect()
    key = lambda i, ids, raw: (str(i), hashlib.sha256(str(ids).encode() + raw).hexdigest())
    want = sorted(key(i, LIBRARY.encode_ordinary(t or ""), (t or "").encode()) for i, t in EDGES)
    assert sorted(key(r.doc_id, list(r.ids), bytes(r.decoded)) for r in rows) == want


def test_a_vocabulary_without_a_byte_is_an_error():
    with pytest.raises(ValueError, match="lacks a byte"):
        PrefixTable(Vocabulary({b"a": 0}), b"ab")


def test_empty_table(nothing):
    assert decode(encode(nothing, RANKS, public_tokenizers.PATTERN), RANKS).count() == 0
