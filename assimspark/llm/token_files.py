"""Token-id output: Arrow files of fixed-size-list batches.

A shard is one Arrow IPC file. Its rows are sequences of ``seq_len`` ids (``input_ids``, a fixed-size list of the narrowest unsigned type)
with a mask of the same length (``attention_mask``); record batches hold ``rows_per_batch`` rows. Documents follow one another without gaps,
each closed by ``end_id``, in ascending doc_id order within and across shards; only the last row of a shard is padded (mask false). Since
every row has the same length, token ``t`` of a shard is in row ``t // seq_len`` and is read from a memory map without a copy.

Each task writes the shard of its range of doc_ids under a name of its own attempt and then renames it, so a task that runs again leaves
one whole file. The index (doc_id, shard, start, n_tokens) is written as Parquet beside the shards.

A null text is an empty document (its end id alone); repeated doc_ids are documents of their own, in order of their texts; a null
doc_id sorts first; an empty table gives no shard. Other columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assimspark.llm.common import new_folder, small_batches
from assimspark.llm.tokens import crc32_of, encoder, tokenizer_path

INDEX = "doc_id long, shard int, start_in_shard long, n_tokens long"


def _open(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


class ShardWriter:
    def __init__(self, uri: str, dtype: np.dtype, seq_len: int, rows_per_batch: int):
        self.fs, self.path = _open(uri)
        self.temporary = f"{self.path}.{uuid.uuid4().hex}.part"
        self.ids_type = pa.uint16() if dtype.itemsize == 2 else pa.uint32()
        self.dtype, self.seq_len, self.rows = dtype, seq_len, rows_per_batch
        self.schema = pa.schema([("input_ids", pa.list_(pa.field("item", self.ids_type, nullable=False), seq_len)), ("attention_mask", pa.list_(pa.field("item", pa.bool_(), nullable=False), seq_len))])
        self.sink = self.fs.open_output_stream(self.temporary)
        self.file = pa.ipc.new_file(self.sink, self.schema)
        self.held: list[bytes] = []
        self.held_bytes = 0

    def add(self, raw: bytes) -> None:
        self.held.append(raw)
        self.held_bytes += len(raw)
        full = self.rows * self.seq_len * self.dtype.itemsize
        if self.held_bytes >= full:
            data = b"".join(self.held)
            whole = len(data) // full * full
            for k in range(0, whole, full):
                self._batch(np.frombuffer(data, self.dtype, full // self.dtype.itemsize, k), None)
            self.held, self.held_bytes = [data[whole:]], len(data) - whole

    def _batch(self, ids: np.ndarray, used: int | None) -> None:
        mask = np.ones(len(ids), bool) if used is None else np.arange(len(ids)) < used
        lists = [pa.FixedSizeListArray.from_arrays(pa.array(v), type=f.type) for v, f in zip((ids, mask), self.schema)]
        self.file.write_batch(pa.record_batch(lists, schema=self.schema))

    def close(self) -> None:
        ids = np.frombuffer(b"".join(self.held), self.dtype)
        if len(ids):
            padded = np.zeros(-(-len(ids) // self.seq_len) * self.seq_len, self.dtype)
            padded[:len(ids)] = ids
            self._batch(padded, len(ids))
        self.file.close()
        self.sink.close()
        self.fs.move(self.temporary, self.path)


class Shard:
    """Random access to a shard; on a local file system nothing is copied."""

    def __init__(self, uri: str):
        from pyarrow import fs

        files, path = _open(uri)
        source = pa.memory_map(path) if isinstance(files, fs.LocalFileSystem) else files.open_input_file(path)
        self.file = pa.ipc.open_file(source)
        self.seq_len = self.file.schema.field("input_ids").type.list_size
        self.held: tuple[int, pa.RecordBatch] = (-1, None)
        self.batch_rows = self.file.get_batch(0).num_rows if self.file.num_record_batches else 0

    def _values(self, b: int, column: str) -> pa.Array:
        if self.held[0] != b:
            self.held = (b, self.file.get_batch(b))
        return self.held[1].column(self.file.schema.get_field_index(column)).flatten()

    def tokens(self, start: int, length: int) -> np.ndarray:
        per, out = self.batch_rows * self.seq_len, []
        while length > 0:
            b, at = divmod(start, per)
            got = self._values(b, "input_ids").to_numpy(zero_copy_only=True)[at:at + length]
            out.append(got)
            start, length = start + len(got), length - len(got)
        return out[0] if len(out) == 1 else np.concatenate(out) if out else np.array([], "<u2")

    def sequence(self, row: int) -> tuple[np.ndarray, np.ndarray]:
        b, at = divmod(row, self.batch_rows)
        cut = slice(at * self.seq_len, (at + 1) * self.seq_len)
        return self._values(b, "input_ids").to_numpy(zero_copy_only=True)[cut], self._values(b, "attention_mask").to_numpy(zero_copy_only=False)[cut]


def _shard_uri(folder: str, shard: int) -> str:
    return f"{folder}/shards/shard-{shard:06d}.arrow"


def write_token_files(docs: DataFrame, folder: str | None = None, end_id: int = 2, seq_len: int = 1024, rows_per_batch: int = 256, tokenizer: str | None = None) -> tuple[str, DataFrame]:
    """Write the shards and their index under ``folder`` (in the shared folder if not given); the folder and the index come back."""
    spark = docs.sparkSession
    folder = folder or new_folder(spark, "token-files")
    path = tokenizer or tokenizer_path()
    small_batches(docs.sparkSession)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, ids_of, writer, at = TaskContext.get().partitionId(), encoder(path), None, 0
        width, end = ids_of.dtype.itemsize, np.array([end_id], ids_of.dtype).tobytes()
        for batch in batches:
            if not batch.num_rows:
                continue
            if writer is None:
                files, where = _open(f"{folder}/shards")
                files.create_dir(where, recursive=True)
                writer = ShardWriter(_shard_uri(folder, shard), ids_of.dtype, seq_len, rows_per_batch)
            starts, sizes = [], []
            for text in batch.column("text"):
                raw = ids_of.encode(text.as_py() or "") + end
                writer.add(raw)
                starts.append(at)
                sizes.append(len(raw) // width)
                at += sizes[-1]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([shard] * len(sizes), pa.int32()), pa.array(starts, pa.int64()), pa.array(sizes, pa.int64())], names=["doc_id", "shard", "start_in_shard", "n_tokens"])
        if writer is not None:
            writer.close()

    docs.select(F.col("doc_id").cast("long"), "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text").mapInArrow(write, INDEX).write.parquet(f"{folder}/index")
    return folder, spark.read.schema(INDEX).parquet(f"{folder}/index")


def read_documents(folder: str, index: DataFrame) -> DataFrame:
    """Each document's global start, length and the checksum of its ids, all read from the shards."""
    totals = index.groupBy("shard").agg(F.sum("n_tokens").alias("size"))
    before = totals.select("shard", F.coalesce(F.sum("size").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, held = None, None
        for batch in batches:
            sums = []
            for s, start, n in zip(*(batch.column(c).to_pylist() for c in ("shard", "start_in_shard", "n_tokens"))):
                if s != shard:
                    shard, held = s, Shard(_shard_uri(folder, s))
                sums.append(crc32_of(held.tokens(start, n)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("shard"), batch.column("start_in_shard"), batch.column("n_tokens"), pa.array(sums, pa.int64())], names=["doc_id", "shard", "start_in_shard", "n_tokens", "ids_crc32"])

    read_back = index.repartition("shard").sortWithinPartitions("shard", "start_in_shard").mapInArrow(read, INDEX + ", ids_crc32 long")
    return read_back.join(before, "shard").select("doc_id", (F.col("before") + F.col("start_in_shard")).alias("start"), "n_tokens", "ids_crc32")
