"""Folders of plain-text papers, one document per file."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from fnmatch import fnmatchcase

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusflow.session import handed_over

# Fixed value: which files of a folder are documents.
FILE_PATTERN = "*.txt"
BINARY_SCHEMA = "path string, modificationTime timestamp, length long, content binary"


# Stands for a replacement character that a broken file holds itself, while its bytes that are
# not UTF-8 are taken out; no text has this.
MASK = "\x00\x02fffd\x03\x00"


def decode(content: Column) -> Column:
    """UTF-8 text of raw bytes with Unix line ends; bytes that are not UTF-8 are dropped."""
    text = content.cast("string")
    # As Latin-1 every byte is one character, so bytes can be replaced.
    latin = F.replace(F.decode(content, "ISO-8859-1"), F.lit("\u00ef\u00bf\u00bd"), F.lit(MASK))
    masked = F.make_valid_utf8(F.encode(latin, "ISO-8859-1").cast("string"))
    repaired = F.replace(F.replace(masked, F.lit("\ufffd"), F.lit("")), F.lit(MASK), F.lit("\ufffd"))
    return F.regexp_replace(F.when(F.is_valid_utf8(text), text).otherwise(repaired), "\r\n?", "\n")


def file_stem(name: Column) -> Column:
    """File name without its last suffix; a leading dot does not start a suffix."""
    return F.regexp_replace(name, r"(?<=.)\.[^.]*[^.]\z", "")


def as_documents(files: DataFrame) -> DataFrame:
    name = F.element_at(F.split("path", "/"), -1)
    return files.select(
        file_stem(name).alias("doc_key"), name.alias("source_file"), decode(F.col("content")).alias("text")
    )


LISTED = "folder string, name string, length bigint"
#: Files that a listing task hands on at a time, and bytes of files that a task reads at a time.
LISTED_ROWS = 10_000
READ_BYTES = 8 << 20
#: Bytes and files of about so many make a task of the scan.
TASK_BYTES, TASK_FILES = 128 << 20, 20_000


def qualified(spark: SparkSession, folder: str) -> str:
    """A folder with its scheme; one without is of the file system that the cluster has by default."""
    context = spark.sparkContext
    hadoop = context._jvm.org.apache.hadoop.fs.Path(folder)
    return hadoop.getFileSystem(context._jsc.hadoopConfiguration()).makeQualified(hadoop).toString()


def make_folders(spark: SparkSession, *folders: str) -> None:
    for folder in folders:
        system, path = fs.FileSystem.from_uri(qualified(spark, folder))
        system.create_dir(path, recursive=True)


def is_folder(spark: SparkSession, path: str) -> bool:
    """Whether tasks can list a path and read the files in it."""
    jvm, context = spark.sparkContext._jvm, spark.sparkContext
    place = jvm.org.apache.hadoop.fs.Path(path)
    system = place.getFileSystem(context._jsc.hadoopConfiguration())
    if not (system.exists(place) and system.getFileStatus(place).isDirectory()):
        return False
    try:
        fs.FileSystem.from_uri(system.makeQualified(place).toString())
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, OSError):  # a scheme that Hadoop alone reaches
        return False
    return True


def _taken(name: str) -> bool:
    """Whether Spark's sources read a file of a folder: it is not hidden, and folders between are named ``k=v``."""
    *inner, last = name.split("/")
    return not last.startswith(".") and not (last.startswith("_") and "=" not in last) and not last.endswith("._COPYING_") and all("=" in p and p[0] != "." for p in inner)


def list_files(folders: DataFrame, pattern: str = FILE_PATTERN, deep: bool = False) -> DataFrame:
    """``(folder, name, length)`` of the files directly in each of ``folders(folder)``, empty ones too.

    ``deep``: also of those in folders ``k=v`` below, ``name`` beginning with these; none that are hidden.

    Each folder is listed by the task that holds its row, so no name passes through the driver.
    Folders need a scheme; see ``qualified``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.schema([("folder", pa.string()), ("name", pa.string()), ("length", pa.int64())])
        for b in batches:
            for folder in b.column("folder").to_pylist():
                system, path = fs.FileSystem.from_uri(folder)
                found = [f for f in system.get_file_info(fs.FileSelector(path, recursive=deep)) if f.is_file and fnmatchcase(f.base_name, pattern)]
                for k in range(0, len(found), LISTED_ROWS):
                    some = [(f.path[len(path.rstrip("/")) + 1 :] if deep else f.base_name, f.size) for f in found[k : k + LISTED_ROWS]]
                    some = [x for x in some if not deep or _taken(x[0])]
                    yield pa.record_batch([[folder] * len(some), [n for n, _ in some], [size for _, size in some]], schema=kind)

    return folders.select("folder").mapInArrow(run, LISTED)


def read_files(files: DataFrame, made_of: Callable[[bytes], bytes | None] = bytes) -> DataFrame:
    """``files`` of ``list_files`` as ``(path, length, content)``, each read by the task that holds its row.

    The content is what ``made_of`` makes of a file's bytes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.schema([("path", pa.string()), ("length", pa.int64()), ("content", pa.binary())])
        systems: dict[str, tuple[fs.FileSystem, str]] = {}

        def made(rows: list[tuple[str, int, bytes]]) -> pa.RecordBatch:
            return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), kind.types)], schema=kind)

        for b in batches:
            rows, size = [], 0
            for folder, name, length in zip(*(c.to_pylist() for c in b.columns)):
                if folder not in systems:
                    systems[folder] = fs.FileSystem.from_uri(folder)
                system, path = systems[folder]
                with system.open_input_stream(f"{path}/{name}") as file:
                    content = file.read()
                rows.append((f"{folder.rstrip('/')}/{name}", length, made_of(content)))
                size += len(content)
                if size >= READ_BYTES:
                    yield made(rows)
                    rows, size = [], 0
            if rows:
                yield made(rows)

    return files.select("folder", "name", "length").mapInArrow(run, "path string, length bigint, content binary")


def read_folders(
    spark: SparkSession, *folders: str, pattern: str = FILE_PATTERN, deep: bool = False, made_of: Callable[[bytes], bytes | None] = bytes
) -> DataFrame:
    """Files ``(path, length, content)`` of folders; see ``list_files`` and ``read_files``.

    Tasks list the folders; the list is written, and its files are dealt to the tasks that read
    them, as many as their bytes and their number ask for. A folder that is not there raises an error.
    """
    named = spark.createDataFrame([(qualified(spark, f),) for f in folders], "folder string")
    listed = handed_over(list_files(named.repartition(len(folders)), pattern, deep), "files")
    n, size = listed.agg(F.count("*"), F.sum("length")).first()
    tasks = max(1, -(-(size or 0) // TASK_BYTES), -(-n // TASK_FILES), min(n, spark.sparkContext.defaultParallelism))
    return read_files(listed.repartition(tasks, F.xxhash64("folder", "name")), made_of)


def read_papers(spark: SparkSession, *folders: str) -> DataFrame:
    """Documents ``(doc_key, source_file, text)`` of the files directly in the folders.

    They are listed and read as in ``read_folders``. Empty files count as documents with an
    empty text.
    """
    return as_documents(read_folders(spark, *folders))


def stream_papers(spark: SparkSession, folder: str, files_per_batch: int = 10_000) -> DataFrame:
    """The same as a stream of the files that arrive in the folder."""
    files = (
        spark.readStream.format("binaryFile")
        .schema(BINARY_SCHEMA)
        .option("pathGlobFilter", FILE_PATTERN)
        .option("maxFilesPerTrigger", files_per_batch)
        .load(folder)
    )
    return as_documents(files)
