"""The register: one row for each document in 62 columns of text, kept as Parquet, read by column name.

Rows are added in batches. A batch is committed by its manifest, which also says what the scan did; adding a committed
batch again does nothing, so a scan or a stream that is run again after a failure adds no row twice. What follows from a
batch (its hashes in the index, its files staged and archived) is marked when done, and made up for by the next scan
if a scan ends before.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.text import text
from ..sources.store import Log, Rows, listed

#: Columns of a batch beside the contract's: the file that a row is about.
FILED = ["source_path"]
#: What is done for each batch after its commit.
MARKS = ["indexed", "filed"]


def to_register(df: DataFrame, wide: bool = False, more: list[str] | tuple[str, ...] = ()) -> DataFrame:
    """The contract's columns in their order, with the five quality columns if ``wide``; structs and arrays as JSON, absent ones empty."""
    kinds = dict(df.dtypes)

    def value(name: str) -> Column:
        if name not in kinds:
            return F.lit("")
        nested = kinds[name].startswith(("struct", "array", "map"))
        return text(F.to_json(F.col(name)) if nested else F.col(name))

    return df.select(*[value(c).alias(c) for c in [*fixed.REGISTER, *(fixed.QUALITY if wide else []), *more]])


def migrated(old: DataFrame, wide: bool = False) -> DataFrame:
    """Rows of another header, by column name: what the contract lacks goes, what the rows lack is empty."""
    return to_register(old, wide)


def append(df: DataFrame, path: str, wide: bool = False, batch: str | None = None, **told) -> dict:
    """Add rows to the register in one commit; its manifest. A ``batch`` that is committed already is left as it is."""
    spark, log, batch = df.sparkSession, Log(path), batch or uuid.uuid4().hex
    if not log.committed(spark, batch):
        watched = Observation()
        seconds = F.sum(F.col("model_seconds")) if "model_seconds" in df.columns else F.lit(0.0)
        rows = df.observe(watched, F.count("*").alias("rows"), F.count(F.when(F.col("processing_status") == "error", 1)).alias("errors") if "processing_status" in df.columns else F.lit(0).alias("errors"), seconds.alias("model_seconds"))
        to_register(rows, wide, FILED).write.mode("overwrite").parquet(log.folder(batch))
        log.commit(spark, batch, **{k: v or 0 for k, v in watched.get.items()}, **{k: v() if callable(v) else v for k, v in told.items()})
    return log.manifests(spark)[batch] | {"batch": batch}


def _batches(spark: SparkSession, path: str, batches: list[str]) -> list[str]:
    """The folders and files of batches, and of a register of before there were batches."""
    log = Log(path)
    return [log.folder(x) for x in batches] + listed(spark, path, ".parquet", deep=False)


def read(spark: SparkSession, path: str, wide: bool = False) -> DataFrame:
    """All rows; a register that isn't there yet has none."""
    found = _batches(spark, path, Log(path).live(spark))
    columns = [*fixed.REGISTER, *(fixed.QUALITY if wide else [])]
    if not found:
        return spark.createDataFrame([], ", ".join(f"{c} string" for c in columns))
    return migrated(spark.read.option("mergeSchema", True).parquet(*found), wide)


def hash_index(path: str) -> Rows:
    """The registered hashes alone, in folders by their first two digits."""
    return Rows(f"{path.rstrip('/')}-hashes", "sha256 string, prefix string", "prefix")


def hashes(spark: SparkSession, path: str, of: DataFrame | None = None) -> DataFrame:
    """(sha256) of all registered contents; of those only that may be among ``of``, if given.

    Read from the index alone, once what it lacks is added. With few hashes to look for only the folders of their first
    digits are read.
    """
    index_new(spark, path)
    known = hash_index(path).read(spark)
    if of is not None:  # 256 prefixes at most
        known = known.where(F.col("prefix").isin([r["prefix"] for r in of.select(F.left("sha256", F.lit(2)).alias("prefix")).distinct().collect()]))
    return known.select("sha256")


def index_new(spark: SparkSession, path: str) -> None:
    """Add the hashes of batches that the index lacks, and of files of a register without batches, to the index."""
    log = Log(path)
    lacking = log.lacking(spark, "indexed")
    old = [] if log.is_done(spark, "before-batches", "indexed") else listed(spark, path, ".parquet", deep=False)
    if not lacking and not old:
        return
    rows = spark.read.parquet(*[log.folder(x) for x in lacking], *old).select("sha256").where("sha256 != ''")
    hash_index(path).add(rows.distinct().withColumn("prefix", F.left("sha256", F.lit(2))))
    for x in [*lacking, *["before-batches"] * bool(old)]:
        log.done(spark, x, "indexed")


def unfiled(spark: SparkSession, path: str) -> tuple[list[str], DataFrame | None]:
    """Batches whose files are not all dealt with yet, and their rows (source_path, copied_file_path, processing_status)."""
    log = Log(path)
    batches = log.lacking(spark, "filed")
    if not batches:
        return [], None
    return batches, spark.read.schema("source_path string, copied_file_path string, processing_status string").parquet(*[log.folder(x) for x in batches]).where("source_path != ''")


def compact(spark: SparkSession, path: str, wide: bool = True) -> None:
    """Make many batches one, so that the register's files stay few."""
    def rows(spark: SparkSession, batches: list[str]) -> DataFrame:
        return to_register(spark.read.option("mergeSchema", True).parquet(*[Log(path).folder(x) for x in batches]), wide, FILED)

    Log(path).merge(spark, rows, MARKS)


def scans(spark: SparkSession, path: str) -> DataFrame:
    """(batch, rows, errors, listed, read, read_bytes, model_seconds, seconds) of each committed scan, from the manifests."""
    kinds = {"rows": "long", "errors": "long", "listed": "long", "read": "long", "read_bytes": "long", "model_seconds": "double", "seconds": "double"}
    told = {b: m for b, m in Log(path).manifests(spark).items() if "replaces" not in m}
    of = {"long": int, "double": float}
    rows = [(b, *(of[k](m.get(c) or 0) for c, k in kinds.items())) for b, m in sorted(told.items())]
    return spark.createDataFrame(rows, ", ".join(["batch string", *(f"{c} {k}" for c, k in kinds.items())]))


def error_row(message: Column) -> dict[str, Column]:
    """What a document that failed is registered as."""
    return {"processing_status": F.lit("error"), "processed_ok": F.lit("no"), "needs_review": F.lit("yes"), "review_reason": F.lit(fixed.ERROR_REASON), "error_message": F.left(text(message), F.lit(1000)), "confidence": F.lit("low")}


def with_dead_letters(df: DataFrame, failure: str, kept: list[str]) -> DataFrame:
    """``df`` where rows with a ``failure`` are error rows: ``kept`` columns stay, the result's others are empty."""
    failed = text(failure) != ""
    told = error_row(F.col(failure))
    of = lambda c: F.when(failed, told.get(c, F.lit(""))).otherwise(F.col(c))
    kinds = dict(df.dtypes)
    results = [c for c in (*fixed.REGISTER, *fixed.QUALITY) if c in kinds and c not in kept]
    nested = {c: F.to_json(F.col(c)) for c in results if kinds[c].startswith(("struct", "array", "map"))}
    out = df.withColumns({c: nested.get(c, text(c)) for c in results} | {c: F.lit("") for c in told if c not in kinds})
    return out.withColumns({c: of(c) for c in {*results, *told}})


def export_csv(spark: SparkSession, path: str, to: str, wide: bool = True) -> None:
    """The register as CSV with a header, for spreadsheets."""
    read(spark, path, wide).write.mode("overwrite").option("header", True).option("escape", '"').csv(to)
