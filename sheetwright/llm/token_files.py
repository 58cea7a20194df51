"""Token ids as Arrow stream files of fixed-size lists.

The ids of all documents, in ascending order of doc_id, form one long row of
ids; each file holds a contiguous range of it, cut into sequences of ``length``
ids with a mask of the same shape (false on the padding of a file's last
sequence). Ids are 16 bits wide where the vocabulary allows it. Record batches
have a fixed number of sequences, so an id's batch, row and column follow from
its position, and a reader that maps the file gets them without a copy.

Files are named by task attempt. Only files listed in the manifest count; Spark
commits the manifest's rows for one attempt of each task, so that lost
executors and repeated tasks leave orphans but no double rows.

Edge cases: a null or empty text has the end id alone; rows with a null doc_id
come first; repeated rows and repeated ids each keep their own ids; an empty
table gives no file and no row; other columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sheetwright.llm.tokens import encoder
from sheetwright.llm.workspace import Workspace, shuffle_partitions

MANIFEST = "doc_id long, part int, file string, local_start long, n_tokens long"


def file_schema(length: int, wide: bool) -> pa.Schema:
    kind = pa.uint32() if wide else pa.uint16()
    return pa.schema([pa.field("ids", pa.list_(kind, length)), pa.field("mask", pa.list_(pa.bool_(), length))], metadata={"sequence_length": str(length)})


def open_stream(uri: str):
    """A reader over one token file; local files are mapped."""
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(uri)
    source = pa.memory_map(path) if isinstance(system, fs.LocalFileSystem) else system.open_input_file(path)
    return pa.ipc.open_stream(source)


class TokenFile:
    """Random access to a token file's ids."""

    def __init__(self, uri: str):
        self.batches = list(open_stream(uri))
        self.length = self.batches[0].schema.field("ids").type.list_size if self.batches else 1
        self.rows = self.batches[0].num_rows if self.batches else 1
        self._flat = [b.column("ids").flatten().to_numpy() for b in self.batches]

    def ids(self, start: int, n: int) -> np.ndarray:
        size = self.rows * self.length
        first, last = start // size, (start + n - 1) // size
        parts = [self._flat[k][max(0, start - k * size) : start + n - k * size] for k in range(first, last + 1)]
        return parts[0] if len(parts) == 1 else np.concatenate(parts)

    def sequence(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The k-th sequence and its mask."""
        batch, row = self.batches[k // self.rows], k % self.rows
        ids = self._flat[k // self.rows][row * self.length : (row + 1) * self.length]
        return ids, batch.column("mask")[row].values.to_numpy(zero_copy_only=False)


class _Writer:
    def __init__(self, uri: str, length: int, rows: int, wide: bool):
        from pyarrow import fs

        system, path = fs.FileSystem.from_uri(uri)
        system.create_dir(path.rpartition("/")[0], recursive=True)
        self.sink = system.open_output_stream(path, compression=None)
        self.schema = file_schema(length, wide)
        self.stream = pa.ipc.new_stream(self.sink, self.schema)
        self.length, self.rows, self.held, self.parts = length, rows, 0, []
        self.kind = np.uint32 if wide else np.uint16

    def add(self, ids: np.ndarray) -> None:
        self.parts.append(ids.astype(self.kind))
        self.held += len(ids)
        if self.held >= self.length * self.rows:
            self._flush(self.held // (self.length * self.rows))

    def _flush(self, batches: int) -> None:
        ids, size = np.concatenate(self.parts), self.length * self.rows
        for k in range(batches):
            self._batch(ids[k * size : (k + 1) * size], size)
        rest = ids[batches * size :]
        self.parts, self.held = [rest], len(rest)

    def _batch(self, ids: np.ndarray, size: int) -> None:
        n = -(-len(ids) // self.length) * self.length
        mask = np.ones(n, dtype=bool)
        mask[len(ids) :] = False
        padded = np.zeros(n, dtype=self.kind)
        padded[: len(ids)] = ids
        columns = [pa.FixedSizeListArray.from_arrays(pa.array(padded), self.length), pa.FixedSizeListArray.from_arrays(pa.array(mask), self.length)]
        self.stream.write_batch(pa.record_batch(columns, schema=self.schema))

    def close(self) -> None:
        if self.held:
            self._batch(np.concatenate(self.parts), self.length * self.rows)
        self.stream.close()
        self.sink.close()


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 2, length: int = 2048, rows: int = 64, partitions: int | None = None) -> DataFrame:
    """Write ``docs`` (doc_id, text) below ``folder``; the manifest, a row for each document.

    tokenizer: path of a tokenizers file. length: ids in a sequence. rows: sequences in a batch.
    """
    spark = docs.sparkSession

    def write(batches):
        from pyspark import TaskContext

        task, encode = TaskContext.get(), encoder(tokenizer, end_id)
        part = task.partitionId()
        uri = f"{folder}/part-{part:06d}-{task.taskAttemptId()}.arrows"
        wide = encode.tokenizer.get_vocab_size() > 1 << 16 or end_id >> 16
        writer, total = None, 0
        for batch in batches:
            sizes = np.zeros(batch.num_rows, dtype=np.int64)
            for row, ids, bounds in encode.encode(batch.column("text")):
                writer = writer or _Writer(uri, length, rows, bool(wide))
                writer.add(ids)
                sizes[row : row + len(bounds) - 1] = np.diff(bounds)
            starts = total + np.cumsum(sizes) - sizes
            total += int(sizes.sum())
            yield pa.record_batch([batch.column("doc_id"), pa.array(np.full(len(sizes), part, dtype=np.int32)), pa.array([uri] * len(sizes)), pa.array(starts), pa.array(sizes)], names=["doc_id", "part", "file", "local_start", "n_tokens"])
        if writer:
            writer.close()

    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text").asc()]
    ranged = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).repartitionByRange(partitions or shuffle_partitions(spark), *order)
    return ranged.sortWithinPartitions(*order).mapInArrow(write, MANIFEST)


def with_start(manifest: DataFrame) -> DataFrame:
    """Adds ``start``: the ids of all documents before a document."""
    parts = manifest.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    base = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"))  # a row for each file
    return manifest.join(base, "part").withColumn("start", F.col("base") + F.col("local_start")).drop("base")


def read_digests(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the files."""

    def read(batches):
        name, held = None, None
        for batch in batches:
            files = batch.column("file").to_pylist()
            starts, sizes = batch.column("local_start").to_numpy(), batch.column("n_tokens").to_numpy()
            crc = np.zeros(len(files), dtype=np.int64)
            for k in sorted(range(len(files)), key=lambda k: (files[k], starts[k])):
                if files[k] != name:
                    name, held = files[k], TokenFile(files[k])
                crc[k] = zlib.crc32(held.ids(int(starts[k]), int(sizes[k])).astype("<u4").tobytes())
            yield pa.record_batch([batch.column("doc_id"), batch.column("start"), batch.column("n_tokens"), pa.array(crc)], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return with_start(manifest).select("doc_id", "file", "local_start", "n_tokens", "start").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_digests(docs: DataFrame, tokenizer: str, end_id: int = 2, length: int = 2048) -> DataFrame:
    """Write all documents as token files, read them back, and describe what was read."""
    space = Workspace(docs.sparkSession, "token-files")
    manifest = space.save(write_token_files(docs, space.folder("ids"), tokenizer, end_id, length), "manifest")
    return read_digests(manifest)
