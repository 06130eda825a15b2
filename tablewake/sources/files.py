"""Script and log files as lines or whole texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.names import stem
from ..functions.text import unify_newlines
from ..session import save_point

# File suffixes, in any case.
SCRIPT_FILES = "*.{[tT][xX][tT],[sS][qQ][lL]}"
LOG_FILES = "*.{[lL][oO][gG],[mM][sS][gG]}"

SUFFIXES = {SCRIPT_FILES: (".txt", ".sql"), LOG_FILES: (".log", ".msg")}

TABLE_FILES = (".csv", ".parquet")

FILE_KEYS = ("script_file", "file_path")


def _hidden(name: str) -> bool:
    return name.startswith(("_", "."))


def _listed(spark: SparkSession, path: str, suffixes: tuple[str, ...]) -> list[tuple[str, bool]]:
    """Files of a folder and all below it, or one file, by suffix: each with whether its name, or a folder's on the way, is hidden."""
    top = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = top.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(top):
        return []
    above = len(system.getFileStatus(top).getPath().toUri().getPath().rstrip("/"))
    found, files = [], system.listFiles(top, True)
    while files.hasNext():
        file = files.next().getPath()
        name = file.toUri().getPath()
        below = name[above:] or name.rsplit("/", 1)[-1]
        if name.lower().endswith(suffixes):
            found.append((file.toString(), any(map(_hidden, below.strip("/").split("/")))))
    return sorted(found)


def _refuse_hidden(spark: SparkSession, path: str, suffixes: tuple[str, ...]) -> None:
    """Raise if the folder holds files to read whose name, or a folder's on the way, begins with ``_`` or ``.``:
    Spark's file sources leave those out without a word."""
    found = [name for name, hidden in _listed(spark, path, suffixes) if hidden]
    if found:
        raise ValueError(f"{len(found)} files have hidden names and would not be read: {', '.join(sorted(found)[:20])}")


def script_files(spark: SparkSession, path: str) -> list[str]:
    return [name for name, _ in _listed(spark, path, SUFFIXES[SCRIPT_FILES])]


def table_files(spark: SparkSession, path: str) -> list[str]:
    """Line tables of a folder and all below it, or one file. Each has headers of its own, so each is read by itself."""
    _refuse_hidden(spark, path, TABLE_FILES)
    return [name for name, _ in _listed(spark, path, TABLE_FILES)]


def _script_name() -> Column:
    """The file's name as it is, not as in a URL, without its suffix."""
    name = F.replace(F.col("_metadata.file_name"), F.lit("+"), F.lit("%2B"))
    return stem(F.url_decode(name))


def _reader(spark: SparkSession, pattern: str):
    return spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern)


def _lines(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """Files are cut into splits and read line by line, so a file may be of any size.

    ``block`` is the offset of the split in its file, ``pos`` grows within a split. Splits may differ from
    one scan to the next, so the numbered lines are written once and read from there.
    """
    _refuse_hidden(spark, path, SUFFIXES[pattern])
    return save_point(
        _reader(spark, pattern).text(path).select(
            _script_name().alias("script_file"),
            F.col("_metadata.file_path").alias("file_path"),
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("pos"),
            F.col("value").alias("line"),
        )
    )


def read_script_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of the ``.txt`` and ``.sql`` files of a folder and all below it, or of one file."""
    return _lines(spark, path, SCRIPT_FILES)


def read_log_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of the ``.log`` and ``.msg`` files of a folder and all below it, or of one file."""
    return _lines(spark, path, LOG_FILES)


def _texts(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    _refuse_hidden(spark, path, SUFFIXES[pattern])
    return _reader(spark, pattern).text(path, wholetext=True).select(
        _script_name().alias("script_file"),
        F.col("_metadata.file_path").alias("file_path"),
        unify_newlines(F.col("value")).alias("text"),
    )


def read_scripts(spark: SparkSession, path: str) -> DataFrame:
    """One row per script file with its whole text, for files that fit in a row."""
    return _texts(spark, path, SCRIPT_FILES)


def read_logs(spark: SparkSession, path: str) -> DataFrame:
    """One row per log file with its whole text, for files that fit in a row."""
    return _texts(spark, path, LOG_FILES)
