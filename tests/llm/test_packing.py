import json
from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from tandem.llm.packing import pack, place
from tests.llm.conftest import EDGES

FILE = public_tokenizers.path("byte_bpe_50k.json")


def test_pieces_are_the_documents_and_fill_their_sequences(edges):
    library = Tokenizer.from_file(FILE)
    library.encode_special_tokens = True
    pieces = [r.asDict() for r in pack(edges, FILE, capacity=256, batch_tokens=3000).collect()]
    want = sorted(json.dumps(library.encode(t or "", add_special_tokens=False).ids + [1]) for _, t in EDGES)
    docs, parts = [], defaultdict(list)
    for p in pieces:
        p["ids"] = np.frombuffer(bytes(p["ids"]), "<u4").tolist()
        assert p["length"] == len(p["ids"]) > 0
        parts[p["sequence_id"]].append(p)
    for found in parts.values():
        found.sort(key=lambda p: p["offset"])
        assert [p["offset"] for p in found] == np.cumsum([0] + [p["length"] for p in found])[:-1].tolist()
        filled = sum(p["length"] for p in found)
        assert filled == found[0]["sequence_tokens"] <= 256
        assert filled & (filled - 1) == 0  # 256, or a smaller power of two: no padding
    by_doc = defaultdict(list)
    for p in pieces:
        by_doc[p["doc_id"], p["doc_tokens"]].append(p)
    for (_, tokens), found in by_doc.items():
        copies = sum(p["start"] == 0 for p in found)
        assert sum(p["length"] for p in found) == copies * tokens
        if copies == 1:
            docs.append(json.dumps([x for p in sorted(found, key=lambda p: p["start"]) for x in p["ids"]]))
    assert set(docs) <= set(want) and len(docs) >= len(want) - 4


def test_costs_are_balanced():
    lengths = [int(2000 / (i + 1)) + 1 for i in range(400)]
    pieces, tokens, costs = place(lengths, 512)
    assert sum(tokens) == sum(lengths)
    full = [c for c, n in zip(costs, tokens) if n == 512]
    mixed = sorted(full)[:len(full) // 2]
    assert mixed[-1] - mixed[0] < 512
    assert place([], 512) == ([], [], [])


def test_empty_table(nothing):
    assert pack(nothing, FILE).count() == 0


def test_plain_words_go_to_the_model_and_keep_their_ids():
    """The library's search for pieces is left out where it finds what a pattern finds; other caches are let go."""
    from tandem.llm import tokens, words

    texts = ["It's plain, isn't it? (42nd) a_b--c 3.14 x²", "naïve Ärger ÷ 中文字 한국어 привет е́ ٣ ࡰ ﬁ", "\nline\n-5\n", " a <|endoftext|>,", ""]
    made = tokens.Coder(FILE, True)
    words.cache("cells:test", lambda found: found).look([b"a"])
    sent = []
    whole = made.whole
    made.whole = lambda found: sent.extend(found) or whole(found)
    assert made.encode(texts) == [x for t in texts for x in whole([t])]
    assert not any(tokens.PLAIN.fullmatch(w) for w in sent)
    tokens.coder(FILE, True)
    assert not words._CACHES
    tokens.coder(FILE, True).encode(["some words"])
    words.cache("cells:test", lambda found: found)
    assert not tokens.coder.__globals__["_CODERS"][FILE, True].known
