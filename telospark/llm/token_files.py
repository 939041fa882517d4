"""Token ids in Arrow stream files: record batches of fixed-size lists of ids and masks.

The corpus is dealt by doc_id ranges; each range becomes one file whose sequences all have the same
length, so that sequence k is a slice of one buffer, found by arithmetic and read without a copy
(memory map). The last sequence of a file is padded; its mask says which ids count. A second file
beside it lists the range's documents. A file ends at the first document after FILE_IDS ids, so
that readers of stores without memory maps hold little. Writers name files by task attempt; only files in the
returned manifest count, so a repeated or lost task does no harm.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from telospark.llm.common import cut, new_folder
from telospark.llm.tokens import encoder, slices, trim

LENGTH = 2048
FILE_IDS = 1 << 25
MANIFEST = "part int, number int, file string, docs string, n_docs long, n_tokens long"


def _open(uri: str):
    """(filesystem, path) of a path or URI in the shared folder."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


class _Writer:
    """Appends ids to a stream file of full sequences; batches of `rows` sequences."""

    def __init__(self, uri: str, length: int, rows: int = 256, wide: bool = False):
        self.uri = uri
        self.fs, self.path = _open(uri)
        self.fs.create_dir(self.path.rpartition("/")[0], recursive=True)
        self.kind = np.uint32 if wide else np.uint16
        self.schema = pa.schema([("ids", pa.list_(pa.from_numpy_dtype(self.kind), length)), ("mask", pa.list_(pa.bool_(), length))])
        self.out = self.fs.open_output_stream(self.path)
        self.writer = pa.ipc.new_stream(self.out, self.schema)
        self.length, self.block, self.held, self.n, self.total = length, rows * length, [], 0, 0

    def _flush(self, ids: np.ndarray, real: int) -> None:
        mask = np.arange(len(ids)) < real
        cols = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.length) for x in (ids, mask)]
        self.writer.write_batch(pa.RecordBatch.from_arrays(cols, schema=self.schema))

    def add(self, ids: np.ndarray) -> None:
        if len(ids) and int(ids.max()) > np.iinfo(self.kind).max:
            raise ValueError(f"id {int(ids.max())} doesn't fit into {np.dtype(self.kind).name}")
        self.held.append(ids.astype(self.kind))
        self.n += len(ids)
        self.total += len(ids)
        if self.n >= self.block:
            ids = np.concatenate(self.held)
            full = len(ids) // self.block * self.block
            for at in range(0, full, self.block):
                self._flush(ids[at : at + self.block], self.block)
            self.held, self.n = [ids[full:]], len(ids) - full

    def close(self) -> None:
        ids = np.concatenate(self.held) if self.n else np.zeros(0, self.kind)
        if len(ids):
            short = -len(ids) % self.length
            self._flush(np.concatenate([ids, np.zeros(short, self.kind)]), len(ids))
        self.writer.close()
        self.out.close()


class TokenFile:
    """Random access to the equal-length sequences of one file; local files are memory-mapped."""

    def __init__(self, uri: str):
        from pyarrow import fs

        at, path = _open(uri)
        self.source = pa.memory_map(path) if isinstance(at, fs.LocalFileSystem) else at.open_input_file(path)
        reader = pa.ipc.open_stream(self.source)
        self.batches = list(reader)
        self.length = reader.schema.field("ids").type.list_size
        self.starts = np.concatenate(([0], np.cumsum([b.num_rows for b in self.batches]))).astype(np.int64)

    def __len__(self) -> int:
        return int(self.starts[-1])

    def sequence(self, k: int) -> tuple[np.ndarray, pa.Array]:
        """Ids (a view of the file's buffer) and mask of sequence k."""
        at = int(np.searchsorted(self.starts, k, "right")) - 1
        row = k - int(self.starts[at])
        ids, mask = (self.batches[at].column(c) for c in (0, 1))
        return ids.values.to_numpy()[row * self.length : (row + 1) * self.length], mask.values.slice(row * self.length, self.length)

    def span(self, start: int, n: int) -> np.ndarray:
        """n ids from the file's id number `start` on."""
        out, got = [], 0
        while got < n:
            seq = (start + got) // self.length
            at = int(np.searchsorted(self.starts, seq, "right")) - 1
            flat = self.batches[at].column(0).values.to_numpy()
            x = flat[start + got - int(self.starts[at]) * self.length :][: n - got]
            out.append(x)
            got += len(x)
        return out[0] if len(out) == 1 else np.concatenate(out) if out else np.zeros(0, np.uint16)


def write_token_files(df: DataFrame, tokenizer: str, end_id: int = 2, folder: str | None = None, length: int = LENGTH, text: str = "text", key: str = "doc_id", keeps_space: bool = True, partitions: int | None = None, file_ids: int = FILE_IDS) -> DataFrame:
    """Writes each text's ids plus end_id, in ascending doc_id order, to token files; returns the
    manifest (one row per file, small), cut from its lineage.

    A null text counts as empty: it has the end id alone. Null doc_ids come first. Repeated doc_ids
    are ordered by the hash of their text. An empty table gives an empty manifest. Other columns
    are not read. Ids take 16 bits where the tokenizer's vocabulary and end_id fit, else 32.
    """
    spark = df.sparkSession
    folder = folder or new_folder(spark, "tokens")
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def write(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        enc, out, number, ids_of, lengths = None, None, 0, [], []

        def finish() -> pa.RecordBatch:
            out.close()
            docs = pa.table({"doc_id": pa.chunked_array(ids_of), "n_tokens": pa.array(np.concatenate(lengths))})
            uri = out.uri.removesuffix(".arrow") + ".docs.arrow"
            at, path = _open(uri)
            with at.open_output_stream(path) as f, pa.ipc.new_stream(f, docs.schema) as w:
                w.write_table(docs)
            row = {"part": part, "number": number, "file": out.uri, "docs": uri, "n_docs": docs.num_rows, "n_tokens": out.total}
            return pa.RecordBatch.from_pylist([row], pa.schema([("part", pa.int32()), ("number", pa.int32()), ("file", pa.string()), ("docs", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())]))

        for batch in batches:
            for b in slices(batch, "_text", 10 << 20):
                enc = enc or encoder(tokenizer, keeps_space)
                if out is None:
                    name = f"{folder}/part-{part:06d}-{number:04d}-{uuid.uuid4().hex}.arrow"
                    out = _Writer(name, length, wide=max(enc.size, end_id + 1) > 1 << 16)
                ids, n_of = enc.encode(b.column(1), end_id)
                out.add(ids)
                ids_of.append(b.column(0))
                lengths.append(n_of)
                if out.total >= file_ids:
                    yield finish()
                    out, number, ids_of, lengths = None, number + 1, [], []
        if out is not None:
            yield finish()
        trim()

    rows = df.select(F.col(key).cast("long").alias("_id"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    dealt = rows.repartitionByRange(n, F.col("_id").asc_nulls_first()).sortWithinPartitions(F.col("_id").asc_nulls_first(), F.xxhash64("_text"))
    return cut(dealt.mapInArrow(write, MANIFEST))


def read_token_files(manifest: DataFrame) -> DataFrame:
    """From the files: doc_id, start (ids of all documents before it), n_tokens and the ids' crc32
    (little-endian unsigned 32-bit). Files are read where the tasks run, one at a time."""
    order = Window.orderBy("part", "number").rowsBetween(Window.unboundedPreceding, -1)  # a row per file
    files = manifest.withColumn("base", F.coalesce(F.sum("n_tokens").over(order), F.lit(0)))
    n = max(1, int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def read(batches):
        for b in batches:
            for row in b.to_pylist():
                tokens = TokenFile(row["file"])
                at, path = _open(row["docs"])
                with at.open_input_stream(path) as f:
                    docs = pa.ipc.open_stream(f).read_all().combine_chunks()
                n_of = docs["n_tokens"].to_numpy()
                starts = np.cumsum(n_of) - n_of
                crc = [zlib.crc32(tokens.span(s, k).astype("<u4").tobytes()) for s, k in zip(starts.tolist(), n_of.tolist())]
                yield from pa.table({"doc_id": docs["doc_id"], "start": pa.array(starts + row["base"]), "n_tokens": docs["n_tokens"], "ids_crc32": pa.array(crc, pa.int64())}).to_batches()

    return files.repartition(n, "part", "number").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")
