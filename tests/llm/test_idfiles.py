import numpy as np
import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer

from tandem.llm.idfiles import ROW, ShardReader, read, write
from tandem.session import scratch_path
from tests.llm.conftest import EDGES

FILE = public_tokenizers.path("word_bpe_49k.json")


def ids_of(text):
    library = Tokenizer.from_file(FILE)
    library.encode_special_tokens = True
    return library.encode(text or "", add_special_tokens=False).ids + [1]


def test_files_hold_all_documents_in_order(spark, edges):
    path = scratch_path(spark, "ids")
    shards = write(edges, path, FILE)
    rows = sorted(read(spark, path, shards).collect(), key=lambda r: r.start)
    ordered = sorted(EDGES, key=lambda d: (d[0] is not None, d[0] or 0, d[1] or ""))
    assert [r.doc_id for r in rows] == [i for i, _ in ordered]
    start = 0
    for row, (_, text) in zip(rows, ordered):
        ids = ids_of(text)
        assert (row.start, row.n_tokens) == (start, len(ids))
        assert np.frombuffer(bytes(row.ids), "<u4").tolist() == ids
        start += len(ids)
    assert sum(n for _, n in shards) == start


def test_random_access_without_a_copy(spark, edges):
    path = scratch_path(spark, "ids")
    shards = write(edges, path, FILE)
    for number, size in shards:
        place = f"{path.removeprefix('file:')}/shard-{number:06d}.arrow"
        shard = ShardReader(pa.memory_map(place))
        last = -(-size // ROW) - 1
        stream = shard.ids(0, size)
        for i in (0, last):
            row = shard.sequence(i)
            assert len(row) == ROW and not row.flags.owndata and not row.flags.writeable
            used = min(ROW, size - i * ROW)
            assert shard.mask(i).sum() == used and (row[:used] == stream[i * ROW:][:used]).all()
        assert shard.ids(3, 3).size == 0


def test_empty_table(spark, nothing):
    path = scratch_path(spark, "ids")
    assert write(nothing, path, FILE) == [] and read(spark, path, []).count() == 0
