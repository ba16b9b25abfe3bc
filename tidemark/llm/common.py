"""What the operators of this subpackage share: tables, shared folders, word and line rules."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that separates words, as a regular expression class and as characters.
SPACE = r"[\x20\x09-\x0D]"
SPACE_CHARS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or where it is unset one of our own. Only a local
    master, whose tasks run on this machine, gets its own; a cluster has to name one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    context = spark.sparkContext
    if not context.getCheckpointDir():
        if not re.match(r"local(\[|$)", context.master):
            raise ValueError("spark.checkpoint.dir is unset: set it to a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="tidemark-"))
    return context.getCheckpointDir().rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/tidemark/{name}-{uuid.uuid4().hex}"


#: Intermediate tables need no checksum files on a local file system, which would double its files and start a process for each.
#: Other file systems do not read these settings.
PLAIN_FILES = {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true"}


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a written table: its lineage ends there, so a lost executor costs one task and not the whole history."""
    path = scratch(df.sparkSession, name)
    df.write.options(**PLAIN_FILES).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def unused(taken: Iterable[str], *names: str) -> list[str]:
    """``names``, each with as many underscores appended as keep it apart from the names ``taken``; case does not matter."""
    held = {x.lower() for x in taken}
    out = []
    for name in names:
        while name.lower() in held:
            name += "_"
        held.add(name.lower())
        out.append(name)
    return out


def columns_of(df: DataFrame) -> list[Column]:
    """Every column of ``df``, whatever characters its name holds."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def clear_scratch(spark: SparkSession) -> None:
    """Deletes what the operators have written to the shared folder. Their DataFrames read it: finish those first."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/tidemark")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once for each row and hand it to ``body``, however often that uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def whole_text(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def words_of(text: Column) -> Column:
    """The words of a text; an empty array where there are none."""
    bare = F.btrim(text, F.lit(SPACE_CHARS))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SPACE + "+"))
