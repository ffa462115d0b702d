"""Reading many record dumps as numbered lines or whole documents."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from reeltally.functions import exprs as X


def read_lines(spark: SparkSession, paths: str | Sequence[str], *, glob: str | None = None, skip_blank: bool = True) -> DataFrame:
    """``path, n, value`` with ``n`` the line's position in its file, counted over the kept lines.

    Lines are numbered inside their file split and shifted by the sizes of the splits before
    it, so a huge dump is read by many tasks.  The row id only orders lines inside one split.
    """
    reader = spark.read.option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    raw = reader.text(list(paths) if not isinstance(paths, str) else paths).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("__split"), "value"
    )
    if skip_blank:
        raw = raw.where(X.strip("value") != "")
    before = W.partitionBy("path").orderBy("__split").rowsBetween(W.unboundedPreceding, -1)
    sizes = raw.groupBy("path", "__split").agg(F.count(F.lit(1)).alias("__c")).select(
        "path", "__split", F.coalesce(F.sum("__c").over(before), F.lit(0)).alias("__c")
    )
    inside = W.partitionBy("path", "__split").orderBy("__id")
    d = raw.withColumn("__id", F.monotonically_increasing_id()).join(sizes, ["path", "__split"])
    return d.select("path", (F.col("__c") + F.row_number().over(inside) - 1).cast("long").alias("n"), "value")


def read_documents(spark: SparkSession, paths: str | Sequence[str], *, glob: str | None = None) -> DataFrame:
    """``path, value`` with each file as one document."""
    reader = spark.read.option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.text(list(paths) if not isinstance(paths, str) else paths, wholetext=True).select(
        F.col("_metadata.file_path").alias("path"), "value"
    )


def write_bundles(rows: DataFrame, path: str, member: Column) -> None:
    """Small files, gathered in few: each of ``rows``' documents (``value``) or lines (``n, value``) is a JSON line that names its file ``member``.

    A folder for each file would cost a rename, a listing and a task's opening for each; here the number of files is that of the tasks.
    """
    fields = [member.alias("member"), *[c for c in ("n", "value") if c in rows.columns]]
    rows.select(F.to_json(F.struct(*fields)).alias("value")).write.text(path)


def read_bundles(spark: SparkSession, path: str, *, lines: bool = False) -> DataFrame:
    """``path, value`` or, with ``lines``, ``path, n, value`` of the files that :func:`write_bundles` gathered below ``path``.

    A file's path is the folder with its name: where it lies among the bundles does not matter, and they are cut into splits at any line.
    """
    fields = "member string, n long, value string" if lines else "member string, value string"
    raw = spark.read.schema(fields).option("mode", "FAILFAST").json(path)
    name = F.concat(F.regexp_replace(F.col("_metadata.file_path"), r"[^/]*$", ""), F.col("member"))
    return raw.select(name.alias("path"), *(["n"] if lines else []), F.coalesce("value", F.lit("")).alias("value"))


def with_file_id(df: DataFrame) -> DataFrame:
    """Adds ``file_id`` from the path unless the caller already provided one."""
    return df if "file_id" in df.columns else df.withColumn("file_id", X.path_id("path"))


def with_fields(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Adds the raw text of every ``name=`` field of a ``k=v|k=v`` record as ``__f_<name>``, null when absent.

    Plain substring search on the record with a leading bar; a regular expression per field costs several
    times as much.  ``__plain`` is true when the record holds each found field once and nothing else.
    """
    d = df.withColumn("__rec", F.concat(F.lit("|"), X.strip("value")))
    rec = F.col("__rec")

    def text(name: str) -> Column:
        mark = F.lit(f"|{name}=")
        return F.when(F.contains(rec, mark), F.substring_index(F.substring_index(rec, f"|{name}=", -1), "|", 1))

    d = d.withColumns({f"__f_{n}": text(n) for n in names})
    found = F.lit(0)
    for n in names:
        found = found + F.col(f"__f_{n}").isNotNull().cast("int")
    return d.withColumn("__plain", F.length(rec) - F.length(F.replace(rec, F.lit("|"), F.lit(""))) == found)


def unexpected(names: Sequence[str]) -> Column:
    """The record holds a field outside ``names``; only looked at closely when it is not plain."""
    rest = F.regexp_replace(F.regexp_replace("__rec", rf"\|(?:{'|'.join(names)})=[^|]*", ""), r"\|", "")
    return F.when(~F.col("__plain"), rest != "").otherwise(False)


def judged(df: DataFrame, why: Column) -> DataFrame:
    """Adds ``__reason`` and passes the row through a one-row generator.

    Later filters (good rows against quarantine, null checks of join keys) then work on the parsed
    columns instead of being pushed below as further copies of the parsing.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns], why.alias("__reason"))
    return df.select(F.explode(F.array(row)).alias("__row")).select("__row.*")


def repeated(names: Sequence[str]) -> Column:
    """One of the fields occurs twice."""
    out = F.lit(False)
    for n in names:
        out = out | (F.regexp_count("__rec", F.lit(rf"\|{n}=")) > 1)
    return F.when(~F.col("__plain"), out).otherwise(False)


def split_quarantine(df: DataFrame, keep: Sequence[str | Column], bad: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Accepted rows and quarantined ones, by the ``__reason`` column."""
    return df.where(F.col("__reason").isNull()).select(*keep), df.where(F.col("__reason").isNotNull()).select(
        *bad, F.col("__reason").alias("reason")
    )
