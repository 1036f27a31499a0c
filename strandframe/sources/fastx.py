"""FASTA and FASTQ, plain or gzip, as a Spark data source named "fastx".

One partition per file: records span lines and gzip cannot be split. Rows carry the
file's position in the argument list and the record's in the file, from which gapless
read ordinals follow.
"""

from __future__ import annotations

import gzip
import io
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "file_ord int, file string, rec_no long, name string, comment string, seq string, qual string"
#: Bases of one Arrow batch.
BATCH_BASES = 4 << 20


def parse(stream) -> Iterator[tuple[str, str, str, str | None]]:
    """(name, comment, seq, qual) of each record of a binary stream; qual is None for FASTA.

    A quality string of another length than its sequence raises ValueError.
    """
    line = stream.readline()
    while line and line[:1] not in (b">", b"@"):
        line = stream.readline()
    while line:
        head = line[1:].rstrip(b"\r\n")
        parts = head.split(None, 1) if head and not head[:1].isspace() else [b"", head]
        name, comment = (parts + [b"", b""])[:2]
        seq = []
        line = stream.readline()
        while line and line[:1] not in (b">", b"+", b"@"):
            seq.append(line.rstrip(b"\r\n").replace(b" ", b""))
            line = stream.readline()
        text = b"".join(seq).decode("ascii", "replace")
        qual = None
        if line[:1] == b"+":
            got, size = [], 0
            # A quality line may begin with any sign, so lines are taken until the lengths meet.
            while size < len(text):
                line = stream.readline()
                if not line:
                    break
                got.append(line.rstrip(b"\r\n"))
                size += len(got[-1])
            if size != len(text):
                raise ValueError(f"record {name.decode()!r}: quality of {size} for a sequence of {len(text)}")
            qual = b"".join(got).decode("ascii", "replace")
            line = stream.readline()
            while line and line[:1] not in (b">", b"@"):
                line = stream.readline()
        yield name.decode(), comment.decode(), text, qual


def opened(raw: bytes | io.BufferedReader):
    """A stream of plain bytes, whether or not the input is gzip."""
    stream = io.BytesIO(raw) if isinstance(raw, bytes) else raw
    magic = stream.read(2)
    stream.seek(0)
    return io.BufferedReader(gzip.GzipFile(fileobj=stream)) if magic == b"\x1f\x8b" else stream


class _File(InputPartition):
    def __init__(self, at: int, path: str):
        super().__init__((at, path))
        self.at, self.path = at, path


class _Reader(DataSourceReader):
    def __init__(self, paths: list[str]):
        self.paths = paths

    def partitions(self):
        return [_File(i, p) for i, p in enumerate(self.paths)]

    def read(self, partition):
        with open(re.sub("^file:(//)?", "", partition.path), "rb") as f:
            yield from batches_of(partition.at, partition.path, opened(f))


class FastxDataSource(DataSource):
    """spark.read.format("fastx").option("paths", "a.fq,b.fa.gz").load(); paths may also be given to load()."""

    @classmethod
    def name(cls) -> str:
        return "fastx"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema):
        import json

        given = self.options.get("paths") or self.options.get("path") or ""
        paths = json.loads(given) if given.startswith("[") else [p for p in given.split(",") if p]
        return _Reader(paths)


def read_fastx(spark: SparkSession, paths: list[str], local: bool | None = None) -> DataFrame:
    """All records of the files in argument order.

    local: read by the "fastx" source, which streams files of any size that every executor can
    open. Otherwise files come through Spark's own reader, so any store that it reads will do,
    but a file is one row and so at most 2 GiB. Left open, paths with a scheme other than file:
    go through Spark's reader.
    """
    if not paths:
        return spark.createDataFrame([], SCHEMA)
    if local is None:
        local = not any("://" in p and not p.startswith("file:") for p in paths)
    if local:
        import json

        spark.dataSource.register(FastxDataSource)
        return spark.read.format("fastx").option("paths", json.dumps(paths)).load()
    conf, path_of = spark._jsc.hadoopConfiguration(), spark._jvm.org.apache.hadoop.fs.Path
    full = [path_of(p).getFileSystem(conf).makeQualified(path_of(p)).toString() for p in paths]
    # One row per argument: the list is in the driver's hands already.
    order = spark.createDataFrame([(q, i, p) for i, (q, p) in enumerate(zip(full, paths))], "path string, file_ord int, file string")
    files = spark.read.format("binaryFile").load(sorted(set(full))).select("path", "content")
    out = files.join(F.broadcast(order), "path").select("file_ord", "file", "content")

    def run(batches):
        for batch in batches:
            for at, file, content in zip(*(c.to_pylist() for c in batch.columns)):
                yield from batches_of(at, file, opened(content))

    return out.mapInArrow(run, SCHEMA)


def batches_of(at: int, file: str, stream) -> Iterator[pa.RecordBatch]:
    """Arrow batches of about BATCH_BASES bases of the records of a stream."""
    rows: list[tuple] = []
    size = 0
    for rec_no, rec in enumerate(parse(stream)):
        rows.append((at, file, rec_no, *rec))
        size += len(rec[2])
        if size > BATCH_BASES:
            yield _batch(rows)
            rows, size = [], 0
    if rows:
        yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string())
    names = ["file_ord", "file", "rec_no", "name", "comment", "seq", "qual"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)


def path_list(spark: SparkSession, list_file: str) -> list[str]:
    """Paths of a list file, one for each run of characters without white space."""
    return [r[0] for r in spark.read.text(list_file, wholetext=True).select(F.explode(F.split(F.trim("value"), r"\s+"))).collect() if r[0]]


def with_ordinals(records: DataFrame) -> DataFrame:
    """Reads (rid, file_ord, seq): empty sequences are skipped and the others numbered without gaps, in file and record order.

    Ordinals are a prefix sum of the counts of the files, one row per file, plus the place in the file.
    """
    from strandframe.operators.reads import ordinals

    return ordinals(records.where(F.length("seq") > 0), "file_ord", "rec_no").select("rid", "file_ord", "seq")
