"""Token ids as Arrow files of equal-length sequences, with an index of the documents in them.

Documents are ordered by doc_id, encoded, ended by an end id and packed without gaps into rows of ``seq_len``
ids. A file (Arrow IPC file format, uncompressed) has record batches of two fixed-size-list columns: ``ids``,
and ``mask``, which is false only for the filling after a file's last id. Any row is found by its number and
read as a view of the mapped file. The index, a Parquet table, says for each document where its ids are.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelmill.llm.pretokens import PieceEncoder
from panelmill.llm.scratch import new_path, stored


def open_store(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a URI that the executors share, see ``qualified``; file: is a mounted folder."""
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)


def qualified(spark: SparkSession, folder: str) -> str:
    """The folder with the scheme of the file system that Spark takes it for; a path alone may be on a shared store."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()


@dataclass(frozen=True)
class Layout:
    seq_len: int = 2048
    rows_per_batch: int = 256
    end_id: int = 0
    wide: bool = False

    @property
    def dtype(self) -> np.dtype:
        return np.dtype("<u4" if self.wide else "<u2")

    @property
    def schema(self) -> pa.Schema:
        return pa.schema([("ids", pa.list_(pa.from_numpy_dtype(self.dtype), self.seq_len)), ("mask", pa.list_(pa.bool_(), self.seq_len))])


class SequenceWriter:
    """Writes one file row batch by row batch; holds at most one batch and the ids of one document."""

    def __init__(self, folder: str, name: str, layout: Layout):
        self.layout, self.name = layout, name
        self.store, path = open_store(folder)
        self.store.create_dir(path, recursive=True)
        self.path, self.draft = f"{path}/{name}", f"{path}/_{name}.draft"
        self.sink = self.store.open_output_stream(self.draft)
        self.out = pa.ipc.new_file(self.sink, layout.schema)
        self.held, self.n_held, self.n = [], 0, 0

    def add(self, ids: np.ndarray) -> int:
        """Appends ids; returns how many the file had before."""
        at = self.n
        self.held.append(ids)
        self.n += len(ids)
        self.n_held += len(ids)
        size = self.layout.seq_len * self.layout.rows_per_batch
        if self.n_held >= size:
            whole = np.concatenate(self.held)
            full = len(whole) // size * size
            for lo in range(0, full, size):
                self._write(whole[lo:lo + size], size)
            self.held, self.n_held = [whole[full:]], len(whole) - full
        return at

    def _write(self, ids: np.ndarray, real: int) -> None:
        n = self.layout.seq_len
        columns = [pa.FixedSizeListArray.from_arrays(pa.array(ids), n),
                   pa.FixedSizeListArray.from_arrays(pa.array(np.arange(len(ids)) < real), n)]
        self.out.write_batch(pa.RecordBatch.from_arrays(columns, schema=self.layout.schema))

    def close(self) -> None:
        """Ends the file and gives it its name, so that a file with this name is whole."""
        if self.n_held:
            ids = np.concatenate(self.held)
            filled = np.zeros(-(-len(ids) // self.layout.seq_len) * self.layout.seq_len, self.layout.dtype)
            filled[:len(ids)] = ids
            self._write(filled, len(ids))
        self.out.close()
        self.sink.close()
        self.store.move(self.draft, self.path)


class SequenceFile:
    """Random access to the rows and id ranges of one file."""

    def __init__(self, folder: str, name: str, layout: Layout):
        store, path = open_store(folder)
        path = f"{path}/{name}"
        self.source = pa.memory_map(path) if isinstance(store, fs.LocalFileSystem) else store.open_input_file(path)
        self.file, self.layout = pa.ipc.open_file(self.source), layout
        self._batch = lru_cache(maxsize=2)(self.file.get_batch)

    def close(self) -> None:
        """Views of its rows are not to be read any more."""
        self._batch.cache_clear()
        self.source.close()

    def rows(self, batch: int) -> tuple[np.ndarray, pa.Array]:
        """(ids as a two-dimensional view without copying, masks) of a record batch."""
        b = self._batch(batch)
        ids = b.column("ids")
        flat = ids.values.slice(ids.offset * self.layout.seq_len, len(ids) * self.layout.seq_len)
        return flat.to_numpy(zero_copy_only=True).reshape(-1, self.layout.seq_len), b.column("mask")

    def sequence(self, row: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, mask) of a row by its number."""
        ids, masks = self.rows(row // self.layout.rows_per_batch)
        return ids[row % self.layout.rows_per_batch], masks[row % self.layout.rows_per_batch].values.to_numpy(zero_copy_only=False)

    def ids(self, first: int, n: int) -> np.ndarray:
        """``n`` ids from the ``first``-th on, over rows and batches."""
        size = self.layout.seq_len * self.layout.rows_per_batch
        parts = [self.rows(b)[0].reshape(-1)[max(0, first - b * size):first + n - b * size]
                 for b in range(first // size, (first + max(n, 1) - 1) // size + 1)]
        return np.concatenate(parts)


class PieceModel:
    """Encodes pieces of text with the library's model, by its table from bytes to letters.

    As the library does by default, the file's added tokens are found in a text first, the longest of those that begin
    at one place, and stand for their ids; ``cut`` gives the texts between them.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        added = self.tokenizer.get_added_tokens_decoder()
        if any(t.lstrip or t.rstrip or t.single_word for t in added.values()):
            raise ValueError("added tokens that take blanks or whole words are not supported")
        self.added = {t.content: i for i, t in added.items()}
        either = sorted(map(re.escape, self.added), key=len, reverse=True)
        self.finds = re.compile(f"({'|'.join(either)})") if either else None
        self.model, self.size = self.tokenizer.model, self.tokenizer.get_vocab_size()
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
        hidden = [b for b in range(256) if b not in shown]
        self.letters = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}

    def __call__(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        tokenize, letters = self.model.tokenize, self.letters
        found = [[t.id for t in tokenize(p.encode().decode("latin-1").translate(letters))] for p in pieces]
        sizes = np.array([len(x) for x in found], np.int64)
        return np.array([i for x in found for i in x], np.uint32), sizes

    def cut(self, text: str) -> list[str]:
        """Texts and added tokens in turn, a text first and last; mostly the whole text alone."""
        return self.finds.split(text) if self.finds else [text]


def encoded(texts: list[str], model: PieceModel, encoder: PieceEncoder) -> Iterator[np.ndarray]:
    """The ids of each text in turn."""
    cuts = [model.cut(text) for text in texts]
    parts = encoder([part for cut in cuts for part in cut[::2]])
    for cut in cuts:
        ids = [next(parts) if i % 2 == 0 else np.array([model.added[part]], encoder.dtype) for i, part in enumerate(cut)]
        yield ids[0] if len(ids) == 1 else np.concatenate(ids)


@lru_cache(maxsize=1)
def _model(path: str) -> PieceModel:
    return PieceModel(path)


def write_sequences(docs: DataFrame, tokenizer_file: str, folder: str, layout: Layout = Layout()) -> DataFrame:
    """Writes the files to ``folder`` and returns the stored index: doc_id, shard, file, first, n_tokens.

    Files of tasks that failed or ran twice are not in the index and may be deleted. Rows with a null doc_id come
    first; rows of one doc_id are ordered by a hash of their text. A null or empty text has the end id alone.
    """
    folder = qualified(docs.sparkSession, folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(tokenizer_file)
        if model.size > np.iinfo(layout.dtype).max + 1:
            raise ValueError(f"{model.size} ids do not fit in {layout.dtype}")
        encoder, shard = PieceEncoder(model, layout.dtype.type), TaskContext.get().partitionId()
        end, writer = np.array([layout.end_id], layout.dtype), None
        for batch in batches:
            first, size = [], []
            for ids in encoded(batch.column("text").fill_null("").to_pylist(), model, encoder):
                writer = writer or SequenceWriter(folder, f"part-{shard:06d}-{uuid.uuid4().hex}.arrow", layout)
                whole = np.concatenate([ids, end])
                first.append(writer.add(whole))
                size.append(len(whole))
            n = batch.num_rows
            if n:
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), pa.array([shard] * n, pa.int32()), pa.array([writer.name] * n, pa.string()),
                     pa.array(first, pa.int64()), pa.array(size, pa.int64())], ["doc_id", "shard", "file", "first", "n_tokens"])
        if writer:
            writer.close()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text").asc()]
    return stored(rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(
        run, "doc_id long, shard int, file string, first long, n_tokens long"), "sequence-index")


def with_starts(index: DataFrame, sizes: DataFrame) -> DataFrame:
    """The index with ``start``: how many ids all documents before have. The running sum is over files, not rows."""
    files = sizes.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    before = F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    base = files.select("shard", F.coalesce(before, F.lit(0)).alias("base"))
    return index.join(base, "shard").withColumn("start", F.col("base") + F.col("first")).drop("base")


def _ranges(batch: pa.RecordBatch, folder: str, layout: Layout) -> Iterator[np.ndarray]:
    """The ids of each row of an index batch, from files that are opened one after the other."""
    name, file = None, None
    for which, first, n in zip(*(batch.column(c).to_pylist() for c in ("file", "first", "n_tokens"))):
        if which != name:
            if file:
                file.close()
            name, file = which, SequenceFile(folder, which, layout)
        yield file.ids(first, n).astype("<u4")
    if file:
        file.close()


def read_documents(index: DataFrame, folder: str, layout: Layout = Layout()) -> DataFrame:
    """doc_id, ids (binary, little-endian unsigned 32-bit) of the index's rows, read from the files."""
    folder = qualified(index.sparkSession, folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = pa.array([x.tobytes() for x in _ranges(batch, folder, layout)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), ids], ["doc_id", "ids"])
    return index.select("doc_id", "file", "first", "n_tokens").mapInArrow(run, "doc_id long, ids binary")


def read_checksums(index: DataFrame, folder: str, layout: Layout = Layout()) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (of the ids as little-endian unsigned 32-bit integers, read from the files)."""
    names, folder = ["doc_id", "shard", "first", "n_tokens"], qualified(index.sparkSession, folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = [zlib.crc32(x) for x in _ranges(batch, folder, layout)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(sums, pa.int64())], [*names, "ids_crc32"])
    sums = index.select(*names, "file").mapInArrow(run, "doc_id long, shard int, first long, n_tokens long, ids_crc32 long")
    return with_starts(sums, index).select("doc_id", "start", "n_tokens", "ids_crc32")


def encode_and_check(docs: DataFrame, tokenizer_file: str, layout: Layout = Layout(), folder: str | None = None) -> DataFrame:
    """Writes ``docs`` as sequences, by default to a new folder beside the checkpoints, and reads them back."""
    folder = folder or new_path(docs.sparkSession, "sequences")
    return read_checksums(write_sequences(docs, tokenizer_file, folder, layout), folder, layout)
