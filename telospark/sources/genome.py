"""GTF and FASTA as Spark data sources: partitions are byte ranges of the files, and filters decide
which files, lines and records are read at all.

`telospark_gtf` (option path: a file, or a folder with one folder `release=<n>` per release) takes
equality and IN on contig and feature, which skip lines before they are parsed, and on release,
which skips files. `telospark_fasta` (option path; its index path.fai lies beside it) takes equality
and IN on name: only these records' bytes are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition
from pyspark.sql.types import StructType

#: Bytes of a partition.
RANGE = 32 << 20
GTF_SCHEMA = "contig string, source string, feature string, start string, end string, score string, strand string, frame string, attributes string, release int"
FASTA_SCHEMA = "name string, sequence string"


def _open(path: str):
    """(file system, path in it) of a path or URI that all tasks can reach."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


@dataclass
class Part(InputPartition):
    """Bytes start to end of a file; or records (name, offset, bases, line's bases, line's bytes)."""

    path: str
    start: int = 0
    end: int = 0
    release: int | None = None
    records: list[tuple] = field(default_factory=list)

    def __post_init__(self) -> None:
        super().__init__((self.path, self.start))


class _Reader(DataSourceReader):
    columns: tuple[str, ...] = ()

    def __init__(self, options: dict):
        self.path, self.range = options["path"], int(options.get("range", RANGE))
        self.wanted: dict[str, set] = {}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Takes equality and IN on the source's columns; Spark applies the others."""
        for f in filters:
            name = f.attribute[0] if isinstance(f, (EqualTo, In)) and len(f.attribute) == 1 else None
            if name not in self.columns:
                yield f
                continue
            values = set(f.value) if isinstance(f, In) else {f.value}
            self.wanted[name] = self.wanted.get(name, values) & values


class GtfReader(_Reader):
    columns = ("contig", "feature", "release")

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        system, root = _open(self.path)
        info = system.get_file_info(root)
        files = [info] if info.type == fs.FileType.File else [f for f in system.get_file_info(fs.FileSelector(root, recursive=True)) if f.type == fs.FileType.File]
        out: list[InputPartition] = []
        for f in sorted(files, key=lambda f: f.path):
            found = [p[8:] for p in f.path.split("/") if p.startswith("release=") and p[8:].isdigit()]
            release = int(found[-1]) if found else None
            if "release" in self.wanted and release not in self.wanted["release"]:
                continue
            out += [Part(f.path, at, min(at + self.range, f.size), release) for at in range(0, f.size, self.range)]
        return out or [Part("")]

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        """Lines that begin in the part's bytes."""
        if not part.path:
            return
        contigs, features = ({v.encode() for v in self.wanted[c]} if c in self.wanted else None for c in ("contig", "feature"))
        rows: list[list[bytes]] = []

        def batch() -> pa.RecordBatch:
            cols = [pa.array([r[k].decode() for r in rows], pa.string()) for k in range(9)]
            names = [c.split(" ")[0] for c in GTF_SCHEMA.split(", ")]
            return pa.RecordBatch.from_arrays([*cols, pa.array([part.release] * len(rows), pa.int32())], names)

        with _open(self.path)[0].open_input_file(part.path) as file:
            for line in _lines(file, part.start, part.end):
                if line.startswith(b"#"):
                    continue
                if contigs is not None and line.partition(b"\t")[0] not in contigs:
                    continue
                cells = line.split(b"\t")
                if len(cells) < 9 or features is not None and cells[2] not in features:
                    continue
                rows.append(cells)
                if len(rows) >= 10_000:
                    yield batch()
                    rows.clear()
        if rows:
            yield batch()


def _lines(file, start: int, end: int, step: int = 1 << 20) -> Iterator[bytes]:
    """Lines of a file that begin at bytes start to end - 1; the last may go beyond."""
    at = max(start - 1, 0)  # a line begins at start if the byte before ends one
    file.seek(at)
    held, skip = b"", start > 0
    while True:
        more = file.read(step)
        held += more
        done = 0
        while (cut := held.find(b"\n", done)) >= 0:
            if not skip:
                if at + done >= end:
                    return
                yield held[done:cut].rstrip(b"\r")
            skip, done = False, cut + 1
        held, at = held[done:], at + done
        if not more:
            if held and not skip and at < end:
                yield held.rstrip(b"\r")
            return
        if not skip and at >= end:
            return


class FastaReader(_Reader):
    columns = ("name",)

    def partitions(self) -> list[InputPartition]:
        """Records in the order of the file, in groups of about `range` bytes."""
        system, path = _open(self.path)
        with system.open_input_stream(path + ".fai") as f:
            index = [line.split("\t") for line in f.read().decode().splitlines() if line]
        names = self.wanted.get("name")
        kept = sorted((int(x[2]), x[0], int(x[1]), int(x[3]), int(x[4])) for x in index if names is None or x[0] in names)
        out, size = [Part(path)], 0
        for offset, name, bases, line, width in kept:
            if size >= self.range:
                out.append(Part(path, offset))
                size = 0
            out[-1].records.append((name, offset, bases, line, width))
            size += bases
        return out

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        names, found, held = [], [], 0
        with _open(self.path)[0].open_input_file(part.path) as file:
            for name, offset, bases, line, width in part.records:
                full, rest = divmod(bases, line) if line else (0, 0)
                file.seek(offset)
                raw = file.read(full * width + rest)
                names.append(name)
                found.append(raw.replace(b"\n", b"").replace(b"\r", b"")[:bases].decode().upper())
                held += bases
                if held >= 4 << 20:
                    yield pa.RecordBatch.from_pydict({"name": names, "sequence": found})
                    names, found, held = [], [], 0
        if names:
            yield pa.RecordBatch.from_pydict({"name": names, "sequence": found})


class GtfSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "telospark_gtf"

    def schema(self) -> str:
        return GTF_SCHEMA

    def reader(self, schema: StructType) -> GtfReader:
        return GtfReader(self.options)


class FastaSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "telospark_fasta"

    def schema(self) -> str:
        return FASTA_SCHEMA

    def reader(self, schema: StructType) -> FastaReader:
        return FastaReader(self.options)


def read(spark: SparkSession, source: type[DataSource], path: str, **options) -> DataFrame:
    """A file by one of the sources, with filters handed to it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(source)
    return spark.read.format(source.name()).options(path=path, **options).load()
