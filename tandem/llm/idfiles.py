"""Token ids on disk: Arrow files of fixed-size-list batches.

A file holds one shard, a range of documents in ascending doc_id: their ids, one
stream cut into rows of ``ROW`` ids, and beside each row its mask, a bit an id
(most significant first, 1 where an id stands; the last row of a file is padded
with 0). All rows have one length, so row ``i`` is found by arithmetic and read
without a copy or decoding; a document by the index in the file's metadata.

Shards are written by the tasks, each to a name of its own that is renamed when
complete, so a repeated task replaces the same file by the same bytes.

Defined cases: a null or empty text is the end id alone; a document may span rows
but not files; null ids sort first, rows of one id by their text; equal rows are
written each; an empty table makes no file and reads as no rows. Columns other
than doc_id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tandem.llm.common import ID, TEXT, id_and_text, ordered_buckets, task_count
from tandem.llm.tokens import coder

ROW, END_ID, BATCH_ROWS = 2048, 1, 256
SHARD_BYTES = 16 << 20
NULL_ID = -(1 << 63)


def file_system(path: str):
    """The pyarrow file system of a path as Spark writes it, and the path on it."""
    from pyarrow import fs

    if path.startswith("file:/") and not path.startswith("file://"):
        path = "file://" + path[len("file:"):]
    return fs.FileSystem.from_uri(path)


def layout(dtype: pa.DataType, row: int = ROW) -> pa.Schema:
    return pa.schema([("ids", pa.list_(dtype, row)), ("mask", pa.list_(pa.uint8(), row // 8))])


def write_shard(path: str, attempt: int, ids: np.ndarray, doc_ids: list, lengths: list[int],
                row: int = ROW) -> None:
    """One file: the rows, and in its metadata the documents' ids and lengths."""
    system, place = file_system(path)
    schema = layout(pa.from_numpy_dtype(ids.dtype), row).with_metadata({
        "doc_ids": np.array([NULL_ID if i is None else i for i in doc_ids], "<i8").tobytes(),
        "lengths": np.array(lengths, "<i8").tobytes()})
    partial = f"{place}.{attempt}.partial"
    with system.open_output_stream(partial) as sink, pa.ipc.new_file(sink, schema) as out:
        for a in range(0, len(ids), row * BATCH_ROWS):
            part = ids[a:a + row * BATCH_ROWS]
            pad = -len(part) % row
            mask = np.packbits(np.arange(len(part) + pad) < len(part))
            out.write_batch(pa.record_batch([
                pa.FixedSizeListArray.from_arrays(pa.array(np.pad(part, (0, pad))), row),
                pa.FixedSizeListArray.from_arrays(pa.array(mask), row // 8)], schema))
    system.move(partial, place)


class ShardReader:
    """Random access to a shard, from a memory map or the bytes of the file."""

    def __init__(self, source: pa.Buffer | pa.NativeFile):
        self.file = pa.ipc.open_file(source)
        kept = self.file.schema.metadata
        self.doc_ids = np.frombuffer(kept[b"doc_ids"], "<i8")
        self.lengths = np.frombuffer(kept[b"lengths"], "<i8")
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)])
        self.row = self.file.schema.field("ids").type.list_size
        self.batches = [self.file.get_batch(i) for i in range(self.file.num_record_batches)]
        self.views = [b.column("ids").flatten().to_numpy().reshape(-1, self.row) for b in self.batches]

    def sequence(self, i: int) -> np.ndarray:
        """Row ``i``, a view into the file."""
        return self.views[i // BATCH_ROWS][i % BATCH_ROWS]

    def mask(self, i: int) -> np.ndarray:
        bits = self.batches[i // BATCH_ROWS].column("mask").flatten().to_numpy()
        return np.unpackbits(bits.reshape(-1, self.row // 8)[i % BATCH_ROWS]).astype(bool)

    def ids(self, start: int, end: int) -> np.ndarray:
        """Ids ``start``..``end`` of the shard's stream."""
        size = self.row * BATCH_ROWS
        parts = [self.views[b].reshape(-1)[max(0, start - b * size):max(0, end - b * size)]
                 for b in range(start // size, -(-end // size))]
        return parts[0] if len(parts) == 1 else np.concatenate(parts or [np.empty(0, "<u4")])


def write(docs: DataFrame, path: str, tokenizer: str, dtype: str = "<u2",
          end_id: int = END_ID) -> list[tuple[int, int]]:
    """Write ``docs`` below ``path``; the shards in order with their ids in all.

    Driver and result hold one pair a file. ``dtype`` must hold the vocabulary.
    """
    bucketed, buckets = ordered_buckets(id_and_text(docs), task_count(docs, SHARD_BYTES))
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, bucket = coder(tokenizer, False), None
        parts, doc_ids, lengths = [], [], []
        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                part = batch.slice(a, 500)
                bucket = part.column("bucket")[0].as_py()
                coded = [c + end for c in encoder.encode(part.column(TEXT).to_pylist())]
                doc_ids += part.column(ID).to_pylist()
                lengths += [len(c) // 4 for c in coded]
                parts.append(np.frombuffer(b"".join(coded), "<u4").astype(dtype))
        if bucket is not None:
            write_shard(f"{path}/shard-{bucket:06d}.arrow", TaskContext.get().taskAttemptId(),
                        np.concatenate(parts), doc_ids, lengths)
            yield pa.RecordBatch.from_arrays(
                [pa.array([bucket], pa.int64()), pa.array([sum(lengths)], pa.int64())], ["shard", "n"])

    system, place = file_system(path)
    system.create_dir(place, recursive=True)
    done = (bucketed.repartitionById(buckets, F.col("bucket"))
            .sortWithinPartitions(F.col(ID).asc_nulls_first(), TEXT)
            .mapInArrow(run, "shard long, n long").collect())
    return sorted((r["shard"], r["n"]) for r in done)


def read(spark: SparkSession, path: str, shards: list[tuple[int, int]]) -> DataFrame:
    """One row a document, read from the files: doc_id, start, n_tokens, ids.

    ``start`` counts the ids of all documents before it over all shards; ``ids``
    are little-endian unsigned 32-bit integers.
    """
    schema = "doc_id long, start long, n_tokens long, ids binary"
    if not shards:
        return spark.createDataFrame([], schema)
    sizes = np.array([n for _, n in shards])
    before = dict(zip([s for s, _ in shards], (np.cumsum(sizes) - sizes).tolist()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content")):
                base = before[int(name.rpartition("shard-")[2].partition(".")[0])]
                shard = ShardReader(content.as_buffer())
                for a in range(0, len(shard.lengths), 2000):
                    some = range(a, min(a + 2000, len(shard.lengths)))
                    yield pa.RecordBatch.from_arrays([
                        pa.array([None if shard.doc_ids[i] == NULL_ID else int(shard.doc_ids[i])
                                  for i in some], pa.int64()),
                        pa.array(shard.starts[a:some.stop] + base, pa.int64()),
                        pa.array(shard.lengths[a:some.stop], pa.int64()),
                        pa.array([shard.ids(shard.starts[i], shard.starts[i + 1]).astype("<u4").tobytes()
                                  for i in some], pa.binary())],
                        ["doc_id", "start", "n_tokens", "ids"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "shard-*.arrow").load(path)
    return files.select("path", "content").mapInArrow(run, schema)
