"""What the training-data operators share: folders, text keys, folds, size-checked broadcasts."""

from __future__ import annotations

import ctypes
import re
import sys
import tempfile
import uuid
from collections.abc import Callable
from contextlib import suppress
from functools import reduce

import pyarrow as pa
from py4j.java_collections import JavaArray
from py4j.java_gateway import JavaClass
from py4j.protocol import Py4JError
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"
#: ASCII white space, as bytes.split() and bytes.strip() take it.
BLANKS = " \t\n\x0b\x0c\r"
#: Bytes of a table, as Spark holds its rows, that may be broadcast.
BROADCAST_BYTES = 32 << 20


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir, which driver and executors share; it goes when the session ends.

    Only where that setting is missing, as in a test, is a local folder made and set.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="shared-")
        spark.conf.set("spark.checkpoint.dir", base)
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}")
    hadoop = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    hadoop.mkdirs(path)
    hadoop.deleteOnExit(path)
    return re.sub(r"^file:/(?!/)", "file:///", hadoop.makeQualified(path).toString())


def give_back() -> None:
    """Returns what numpy and Arrow have freed to the system: a Python worker lives on after its task, and all workers of
    an executor share its memory."""
    pa.default_memory_pool().release_unused()
    if _TRIM:
        _TRIM(0)


def give_back_driver(spark: SparkSession) -> None:
    """The same for the driver: its Python, the heap of its JVM where that has grown to two thirds of what it may have,
    and the memory that the JVM has freed outside of its heap, which malloc keeps for itself otherwise."""
    give_back()
    gateway, jvm = spark.sparkContext._gateway, spark.sparkContext._jvm
    heap = jvm.java.lang.Runtime.getRuntime()
    if heap.totalMemory() > heap.maxMemory() // 3 * 2:
        heap.gc()

    def array(kind: JavaClass, values: list) -> JavaArray:
        out = gateway.new_array(kind, len(values))
        for i, x in enumerate(values):
            out[i] = x
        return out

    # the platform's server is of a class that isn't public, so the method is that of its interface
    of = jvm.java.lang.Class.forName
    kinds = ["javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;"]
    with suppress(Py4JError):  # a JVM without this command keeps the memory
        call = of("javax.management.MBeanServerConnection").getMethod("invoke", array(jvm.java.lang.Class, [of(x) for x in kinds]))
        name = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand")
        server = jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer()
        call.invoke(server, array(jvm.java.lang.Object, [name, "systemTrimNativeHeap", None, None]))


_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None) if sys.platform == "linux" else None


def store(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder or file and its path there, for code on the driver and on executors alike."""
    return fs.FileSystem.from_uri(re.sub(r"^s3[an]:", "s3:", uri))


#: Rows of a narrow table that go to one file, if their number is known beforehand; and files at least.
FILE_ROWS = 250_000
FILES = 8


def kept(df: DataFrame, name: str = "table", most: int | None = None) -> DataFrame:
    """df, written to the shared folder and read again: cuts the lineage and lives through lost executors. The files stay
    until release(), or the session's end. most: about how many rows there may be, so that a small table isn't written
    as many small files, whatever the number of partitions that shuffles have."""
    folder = shared_folder(df.sparkSession, name)
    df = df if most is None else df.coalesce(max(FILES, most // FILE_ROWS))
    df.write.parquet(f"{folder}/rows")
    give_back_driver(df.sparkSession)
    found = df.sparkSession.read.schema(df.schema).parquet(f"{folder}/rows")
    _KEPT[id(found)] = found, folder
    return found


_KEPT: dict[int, tuple[DataFrame, str]] = {}


def release(*tables: DataFrame) -> None:
    """Deletes the files of tables from kept(), once nothing that is still to be computed reads them."""
    for df in tables:
        found, folder = _KEPT.pop(id(df))
        remove(found.sparkSession, folder)


def remove(spark: SparkSession, folder: str) -> None:
    """Deletes a folder with all that is in it."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def _bytes(value: Column, kind: T.DataType) -> Column:
    """About how many bytes a value takes in a row."""
    if isinstance(kind, T.StructType):
        return reduce(lambda a, b: a + b, [_bytes(value[f.name], f.dataType) for f in kind], F.lit(8))
    if isinstance(kind, T.ArrayType):
        each = F.aggregate(value, F.lit(0).cast("long"), lambda a, x: a + _bytes(x, kind.elementType))
        return F.coalesce(each, F.lit(0)) + 24
    if isinstance(kind, T.StringType | T.BinaryType):
        return F.coalesce(F.octet_length(value), F.lit(0)) + 16
    return F.lit(8).cast("long")


def small_side(df: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """df with a broadcast hint if it has no more than `most` bytes; else as it is, for a shuffled join.

    df should be a table that is written already (see kept), as it is measured here.
    """
    size = reduce(lambda a, b: a + b, [_bytes(F.col(f"`{f.name}`"), f.dataType) for f in df.schema], F.lit(8).cast("long"))
    return F.broadcast(df) if (df.agg(F.sum(size)).first()[0] or 0) <= most else df


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once; an alias may be copied into a lambda and computed for each element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def packed(keep: list[str] | None) -> Column:
    """The columns `keep` of a row, or all, as a struct `row`, out of the way of an operator's own columns."""
    return F.struct(*(keep or ["*"])).alias("row")


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def text_key(text: Column) -> Column:
    """16 bytes that stand for a text; null and empty texts differ."""
    return F.unhex(F.coalesce(F.md5(text), F.lit("00")))


def fold(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo parts; null for a null id."""
    return F.crc32(doc_id.cast("string")) % parts


def held_out(doc_id: Column, parts: int, part: int) -> Column:
    """Whether a row's labels are not learned from. A null id is held out."""
    return F.coalesce(fold(doc_id, parts) == part, F.lit(True))


def word_count(text: Column) -> Column:
    """Number of words [^\\x20\\x09-\\x0D]+; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
