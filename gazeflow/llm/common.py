"""What the training-data operators share: column handling, words and shared-folder tables."""

from __future__ import annotations

import atexit
import uuid
from weakref import WeakKeyDictionary

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gazeflow.session import shared_dir

#: White space between words, as a regular-expression class and as the characters themselves.
SPACE_CLASS = r"[\x20\x09-\x0D]"
SPACES = " \t\n\x0b\x0c\r"

#: A side with at most so many narrow rows is broadcast; a larger one is joined by shuffle.
BROADCAST_ROWS = 250_000

#: With this setting a finished query's shuffle files go at once, rather than when the driver collects its garbage.
_SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_made: list[tuple[SparkSession, str]] = []
_tables: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def shared_path(spark: SparkSession, tag: str) -> str:
    """A new path below the shared folder; it is removed when the driver ends."""
    path = f"{shared_dir(spark)}/gazeflow/{tag}-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


def drop_path(spark: SparkSession, path: str) -> None:
    """Remove a table in the shared folder that nothing reads any more."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def _clean() -> None:
    for spark, path in _made:
        try:
            drop_path(spark, path)
        except Exception:  # noqa: BLE001, S110  the JVM may be gone; the folder's owner removes it then
            pass


def written(df: DataFrame, tag: str) -> DataFrame:
    """df as a table in the shared folder: lineage ends there, and a lost executor costs no recomputation. The shuffle files
    of the write have no later reader and are removed with its end."""
    spark, path = df.sparkSession, shared_path(df.sparkSession, tag)
    before = spark.conf.get(_SHUFFLE_CLEANUP, None)
    spark.conf.set(_SHUFFLE_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(_SHUFFLE_CLEANUP) if before is None else spark.conf.set(_SHUFFLE_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    _tables[out] = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Remove tables of written() that no later plan reads."""
    for t in tables:
        drop_path(t.sparkSession, _tables.pop(t))


def plain(df: DataFrame, **wanted: str) -> DataFrame:
    """Only the wanted columns, as new name=type: an exact name comes before one in another case, the first of several
    equal names counts, and a column that is missing is null. Other columns, whatever their names, are left out."""
    names = df.columns
    at = df.toDF(*(f"c{i}" for i in range(len(names))))
    return at.select(*(_pick(names, *spec.split(":")).alias(new) for new, spec in wanted.items()))


def _pick(names: list[str], name: str, kind: str) -> Column:
    found = [i for i, x in enumerate(names) if x == name] or [i for i, x in enumerate(names) if x.lower() == name.lower()]
    return F.col(f"c{found[0]}").cast(kind) if found else F.lit(None).cast(kind)


def packed(df: DataFrame, **wanted: str) -> tuple[DataFrame, list[str]]:
    """The wanted columns as in plain(), and the whole row as struct `row`; unpacked() restores it."""
    names = df.columns
    at = df.toDF(*(f"c{i}" for i in range(len(names))))
    row = F.struct(*at.columns).alias("row")
    return at.select(row, *(_pick(names, *spec.split(":")).alias(new) for new, spec in wanted.items())), names


def unpacked(df: DataFrame, names: list[str], replaced: dict[str, Column] | None = None) -> DataFrame:
    """Only the original columns, those in replaced (by exact or else case-blind name) with new values."""
    swap = {}
    for name, value in (replaced or {}).items():
        found = [i for i, x in enumerate(names) if x == name] or [i for i, x in enumerate(names) if x.lower() == name.lower()]
        if found:
            swap[found[0]] = value
    return df.select(*(swap.get(i, F.col(f"row.c{i}")).alias(f"c{i}") for i in range(len(names)))).toDF(*names)


def maybe_broadcast(df: DataFrame, rows: int, most: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if its counted rows are few; otherwise Spark joins it by shuffle."""
    return F.broadcast(df) if rows <= most else df


def words_sql(text: str) -> str:
    """SQL for the array of words of a text expression (null or blank: an empty array)."""
    trimmed = f"btrim({text}, ' \\t\\n\\u000b\\f\\r')"
    return f"(CASE WHEN {text} IS NULL OR {trimmed} = '' THEN cast(array() AS array<string>) ELSE split({trimmed}, '[\\\\x20\\\\x09-\\\\x0D]+') END)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
