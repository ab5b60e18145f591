"""Thin helpers over the Hadoop FileSystem of the session, so every path may be any Hadoop URI.

Only metadata operations live here (rename, delete, size, small JSON documents, rows about files that the driver
holds); data always goes through Spark readers and writers.
"""

from __future__ import annotations

import io
import uuid
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import SparkSession

#: Moves of files that are under way together.
MOVES_AT_ONCE = 16


def _jvm(spark: SparkSession):
    return spark.sparkContext._jvm


def _path(spark: SparkSession, uri: str):
    return _jvm(spark).org.apache.hadoop.fs.Path(uri)


def _fs(spark: SparkSession, uri: str):
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    return _path(spark, uri).getFileSystem(conf)


def qualify(spark: SparkSession, uri: str) -> str:
    """Fully qualified form (scheme included), as Spark reports file paths."""
    p = _path(spark, uri)
    return _fs(spark, uri).makeQualified(p).toString()


def exists(spark: SparkSession, uri: str) -> bool:
    return bool(_fs(spark, uri).exists(_path(spark, uri)))


def mkdirs(spark: SparkSession, uri: str) -> None:
    _fs(spark, uri).mkdirs(_path(spark, uri))


def delete(spark: SparkSession, uri: str, recursive: bool = True) -> bool:
    return bool(_fs(spark, uri).delete(_path(spark, uri), recursive))


def rename(spark: SparkSession, src: str, dst: str) -> None:
    """Move, or raise: Hadoop only returns False on failure."""
    Handle(spark, src).rename(src, dst)


def size_bytes(spark: SparkSession, uri: str) -> int:
    """Total bytes under a directory (O-34); 0 when absent."""
    if not exists(spark, uri):
        return 0
    return int(_fs(spark, uri).getContentSummary(_path(spark, uri)).getLength())


def list_dir(spark: SparkSession, uri: str) -> list[tuple[str, bool, int]]:
    """(name, is_dir, length) of the direct children of a directory."""
    if not exists(spark, uri):
        return []
    out = []
    for st in _fs(spark, uri).listStatus(_path(spark, uri)):
        out.append((st.getPath().getName(), bool(st.isDirectory()), int(st.getLen())))
    return out


def glob(spark: SparkSession, pattern: str) -> list[str]:
    sts = _fs(spark, pattern).globStatus(_path(spark, pattern))
    return [st.getPath().toString() for st in (sts or [])]


def _write(fs, path, body: bytes) -> None:
    out = fs.create(path, True)
    try:
        out.write(bytearray(body))
    finally:
        out.close()


def append_rows(spark: SparkSession, folder: str, rows: pa.Table) -> None:
    """Add a few rows of the driver to a Parquet table: a file of their own, which appears whole and costs no Spark job."""
    body, name = io.BytesIO(), f"part-00000-{uuid.uuid4()}.zstd.parquet"
    pq.write_table(rows, body, compression="zstd")
    h = Handle(spark, folder)
    _write(h.fs, _path(spark, f"{folder}/.{name}.tmp"), body.getvalue())
    h.rename(f"{folder}/.{name}.tmp", f"{folder}/{name}")


def write_text(spark: SparkSession, uri: str, text: str) -> None:
    """Write a small document: temp file, then one rename that replaces the target."""
    fs = _fs(spark, uri)
    tmp = _path(spark, uri + ".tmp")
    _write(fs, tmp, text.encode("utf-8"))
    jvm = _jvm(spark)
    kind = jvm.org.apache.hadoop.fs.Options.Rename
    replace = spark.sparkContext._gateway.new_array(kind, 1)
    replace[0] = kind.OVERWRITE
    target = fs.makeQualified(_path(spark, uri))
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), fs.getConf()).rename(fs.makeQualified(tmp), target, replace)


def read_text(spark: SparkSession, uri: str) -> str:
    fs = _fs(spark, uri)
    jvm = _jvm(spark)
    stream = fs.open(_path(spark, uri))
    try:
        return jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


class Handle:
    """One resolved FileSystem for many metadata calls under a root (fewer JVM round trips)."""

    def __init__(self, spark: SparkSession, uri: str):
        self.spark = spark
        self._P = _jvm(spark).org.apache.hadoop.fs.Path
        self.fs = _fs(spark, uri)

    def rename(self, src: str, dst: str) -> None:
        """Move, or raise: Hadoop only returns False on failure."""
        if not self.fs.rename(self._P(src), self._P(dst)):
            raise OSError(f"can't move {src} to {dst}")

    def rename_all(self, moves: list[tuple[str, str]]) -> None:
        """Many independent moves, several at a time; the first that fails is raised once all have ended."""
        with ThreadPoolExecutor(MOVES_AT_ONCE) as pool:
            for done in [pool.submit(self.rename, src, dst) for src, dst in moves]:
                done.result()

    def delete(self, uri: str, recursive: bool = True) -> bool:
        return bool(self.fs.delete(self._P(uri), recursive))

    def exists(self, uri: str) -> bool:
        return bool(self.fs.exists(self._P(uri)))

    def mkdirs(self, uri: str) -> None:
        self.fs.mkdirs(self._P(uri))

    def status(self, uri: str):
        """(qualified path, length) of a file, or None when absent or a directory."""
        p = self._P(uri)
        if not self.fs.exists(p):
            return None
        st = self.fs.getFileStatus(p)
        if not st.isFile():
            return None
        return st.getPath().toString(), int(st.getLen())

    def names(self, uri: str) -> list[str]:
        """Child names of a directory (empty when absent)."""
        p = self._P(uri)
        if not self.fs.exists(p):
            return []
        return [st.getPath().getName() for st in self.fs.listStatus(p)]

    def sizes(self, uri: str) -> list[tuple[str, int]]:
        """(name, length) of the files directly in a directory."""
        p = self._P(uri)
        if not self.fs.exists(p):
            return []
        return [(st.getPath().getName(), int(st.getLen())) for st in self.fs.listStatus(p) if st.isFile()]
