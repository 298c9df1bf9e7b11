"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import ship_package

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: The characters U+0020 and U+0009 to U+000D.
BLANKS = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quoted(name: str) -> str:
    """A column's name as an expression, whatever characters it has."""
    return "`" + name.replace("`", "``") + "`"


def own(docs: DataFrame) -> list[Column]:
    """All columns, also those whose names hold dots or backticks."""
    return [F.col(quoted(c)) for c in docs.columns]


def free_name(docs: DataFrame, name: str) -> str:
    """``name``, with underscores before it until no column is called so in either case."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def python_ready(spark: SparkSession) -> None:
    """Workers can import this package, and get Arrow batches of bounded size, so that queries can be built in any order."""
    ship_package(spark)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, ``spark.checkpoint.dir``. A session on one machine without it gets a temporary
    one; on a cluster that would split the data, so it is an error there."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        path = spark.conf.get("corpusseek.shared.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = "file://" + tempfile.mkdtemp(prefix="corpusseek-")
        spark.conf.set("corpusseek.shared.dir", path)
    return path.rstrip("/")


#: Rows of a file, at about, where a table's size is known beforehand.
ROWS_PER_FILE = 250_000


def write_shared(df: DataFrame, label: str, rows: int | None = None, per_file: int = ROWS_PER_FILE) -> DataFrame:
    """Writes ``df`` to the shared folder and returns a reader of it, which cuts the lineage.

    Files survive the loss of any executor; nothing is kept in executor memory. ``rows``, a bound of the table's rows, keeps a
    small table from being written in many tiny files; ``per_file`` is the bound of a file's rows, less where rows are texts.
    """
    spark = df.sparkSession
    if rows is not None:
        df = df.coalesce(max(8, rows // per_file))
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.shared_path = path
    return out


def drop_shared(df: DataFrame) -> None:
    """Deletes a table that :func:`write_shared` made and that no later step reads."""
    spark, path = df.sparkSession, getattr(df, "shared_path", None)
    if path:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z only. For pure ASCII text ``lower`` is the same and much faster."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, UPPER.lower()))


def text_or_empty(c: str | Column) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


#: Up to so many ids (8 bytes each) are broadcast; more are shuffled, evenly, as each is there once.
BROADCAST_IDS = 200_000


def without(docs: DataFrame, dropped: DataFrame, id_col: str) -> DataFrame:
    """``docs`` without the rows whose id is in ``dropped`` (column ``id``); rows with a null id stay."""
    key = free_name(docs, "id")
    dropped = write_shared(dropped.select(F.col("id").alias(key)), "dropped")
    small = dropped.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return docs.join(F.broadcast(dropped) if small else dropped, F.col(quoted(id_col)) == F.col(quoted(key)), "left_anti")
