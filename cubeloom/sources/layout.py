"""Period files: one directory per load, table and period, and the manifest beside them as commit log.

``<root>/facts/version=.../table_id=.../tid=...`` holds the rows of one load;
``<root>/manifest/version=...`` one row per period of that load. A load counts
once its manifest directory holds the mark that Spark writes when a job is
committed. The latest load of a period is the current one, so a replaced period
is never overwritten: who reads during a replacement sees the old rows or, if
they looked later, the new ones, and a load that broke off is never seen.

Spark writes no file for a period without rows; the manifest says that such a
period was fetched. Readers name the directories of the periods they want, so
the rest isn't even listed. The driver sees one row per wanted
period, as Spark's own list of files does.
"""

from __future__ import annotations

import re
import time
from collections.abc import Iterable

from pyspark.sql import DataFrame, Observation, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage, delete_paths, stored

KEYS = ["table_id", "tid"]
MANIFEST = "table_id string, tid string, rows bigint, version bigint"
#: Characters that Spark escapes in the names of partition directories.
_ESCAPED = re.compile(r"""[\x01-\x1f\x7f"#%'*/:=?\\{\[\]^]""")


def _name(value: str | None) -> str:
    """A partition value as Spark writes it into a path."""
    return _ESCAPED.sub(lambda m: f"%{ord(m[0]):02X}", value) if value else "__HIVE_DEFAULT_PARTITION__"


def _folder(root: str, entry: Row) -> str:
    return f"{root}/facts/version={entry['version']}/table_id={_name(entry['table_id'])}/tid={_name(entry['tid'])}"


def published(spark: SparkSession, root: str) -> list[int]:
    """Versions whose manifest is complete, ascending."""
    marks = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root}/manifest/version=*/_SUCCESS")
    found = marks.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(marks)
    return sorted(int(f.getPath().getParent().getName()[8:]) for f in found or [])


def _log(spark: SparkSession, root: str, versions: Iterable[int] | None = None) -> DataFrame:
    """Manifest rows of the given versions, of all published ones by default."""
    wanted = published(spark, root) if versions is None else versions
    paths = [f"{root}/manifest/version={v}" for v in wanted]
    if not paths:
        return spark.createDataFrame([], MANIFEST)
    return spark.read.schema(MANIFEST).option("basePath", f"{root}/manifest").parquet(*paths)


def write_periods(
    df: DataFrame, root: str, requested: DataFrame | None = None, version: int | None = None,
    max_records_per_file: int = 20_000_000,
) -> DataFrame:
    """Replace the periods that ``df`` holds and record what was written.

    ``requested`` is ``(table_id, tid)``; a requested period without rows is
    recorded with 0 rows. The rebalance hint lets Spark gather a period's rows
    and split a period that is much larger than the rest over several files.

    The input runs once: rows per period are counted in the footers of what was
    written, and their sum must be the number that went in. Nothing is current
    before the manifest is complete. A version can be published once; one that
    broke off before that may be written again.
    """
    spark = df.sparkSession
    before = published(spark, root)
    if version is None:
        version = max(int(time.time() * 1000), max(before, default=0) + 1)
    if version in before:
        raise ValueError(f"version {version} is published already")
    folder, entered = f"{root}/facts/version={version}", Observation()
    (
        df.hint("rebalance", *KEYS)
        .observe(entered, F.count(F.lit(1)).alias("rows"))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "static")
        .option("maxRecordsPerFile", max_records_per_file)
        .partitionBy(*KEYS)
        .parquet(folder)
    )
    footers = spark.read.schema("table_id string, tid string").parquet(folder)
    counts = stored(footers.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("rows")), "counts")
    found = counts.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
    if found != entered.get["rows"]:
        raise OSError(f"{entered.get['rows']} rows went into {folder}, {found} are there")
    entries = period_manifest(counts, counts.select(*KEYS) if requested is None else requested)
    entries.write.mode("overwrite").option("partitionOverwriteMode", "static").parquet(f"{root}/manifest/version={version}")
    return _log(spark, root, [version]).select(*KEYS, "rows")


def replace_periods(reloaded: DataFrame, root: str, changed: DataFrame, version: int | None = None) -> DataFrame:
    """Replace ``changed (table_id, tid)`` by their reloaded rows; a changed period without rows becomes empty."""
    keys = stored(changed.select(*KEYS).distinct(), "changed")
    return write_periods(reloaded.join(keys, KEYS, "left_semi"), root, requested=keys, version=version)


def period_manifest(counts: DataFrame, requested: DataFrame) -> DataFrame:
    """Every requested or written period with its row count, 0 where nothing came."""
    asked = requested.select(*KEYS, F.lit(0).cast("bigint").alias("rows"))
    return counts.select(*KEYS, "rows").unionByName(asked).groupBy(*KEYS).agg(F.max("rows").alias("rows"))


def write_report(written: DataFrame) -> DataFrame:
    """Rows and files written, over all periods."""
    return written.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("rows_written"), F.count(F.lit(1)).alias("files_written"))


def _current(spark: SparkSession, root: str) -> DataFrame:
    """Latest entry of every period, with the version that holds its rows."""
    return _log(spark, root).groupBy(*KEYS).agg(F.max_by("rows", "version").alias("rows"), F.max("version").alias("version"))


def manifest(spark: SparkSession, root: str) -> DataFrame:
    """Latest entry of every period: ``table_id, tid, rows``."""
    return _current(spark, root).select(*KEYS, "rows")


def _read(spark: SparkSession, root: str, entries: DataFrame) -> DataFrame:
    """Rows of the given current entries; no other directory is listed or read.

    Columns are those of the newest of them; older files give null for a column they lack.
    """
    full = entries.where("rows > 0").select("version", *KEYS)
    wanted = sorted(full.collect(), key=lambda e: e["version"])
    reader = spark.read.option("basePath", f"{root}/facts")
    sample = wanted[-1:] or _current(spark, root).where("rows > 0").orderBy(F.desc("version")).select("version", *KEYS).take(1)
    if not sample:
        return spark.createDataFrame([], "table_id string, tid string")
    found = reader.parquet(_folder(root, sample[0])).schema
    # left alone, Spark would read ``2024`` as a number
    fields = [T.StructField(f.name, T.StringType()) if f.name in KEYS else f for f in found.fields if f.name != "version"]
    if not wanted:
        return spark.createDataFrame([], T.StructType(fields))
    whole = T.StructType([*fields, T.StructField("version", T.LongType())])
    return reader.schema(whole).parquet(*[_folder(root, e) for e in wanted]).drop("version")


def read_periods(spark: SparkSession, root: str) -> DataFrame:
    """All current rows."""
    return _read(spark, root, _current(spark, root))


def scan_periods(spark: SparkSession, root: str, table_id: str, tids: list[str]) -> DataFrame:
    """Rows of the named periods of one table; only their directories are read."""
    return _read(spark, root, _current(spark, root).where((F.col("table_id") == table_id) & F.col("tid").isin(*tids)))


def load_periods(spark: SparkSession, root: str, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of ``wanted (table_id, tid)`` over many tables, and the wanted periods not on disk.

    The wanted keys meet the manifest first; of the facts only their directories are listed and read.
    """
    keys = stored(wanted.select(*KEYS).distinct(), "wanted")
    held = _current(spark, root)
    missing = keys.join(held.select(*KEYS), KEYS, "left_anti")
    return _read(spark, root, held.join(keys, KEYS, "left_semi")), missing


def drop_superseded(spark: SparkSession, root: str, before: int) -> int:
    """Delete rows of loads older than ``before`` that are no longer current; how many directories went.

    Loads that broke off go as well. ``before`` should lie further back than the longest read takes.
    """
    log = _log(spark, root).where((F.col("version") < before) & (F.col("rows") > 0))
    newest = _current(spark, root).select(*KEYS, F.col("version").alias("newest"))
    old = log.join(newest, KEYS).where("version < newest").select("version", *KEYS).collect()
    versions = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root}/facts/version=*")
    found = versions.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(versions) or []
    done = set(published(spark, root))
    broken = [f"{root}/facts/{n}" for n in (f.getPath().getName() for f in found) if int(n[8:]) < before and int(n[8:]) not in done]
    delete_paths(spark, [*[_folder(root, e) for e in old], *broken])
    return len(old) + len(broken)


def local_periods(held: DataFrame) -> DataFrame:
    """Periods of a manifest, sorted within each table."""
    return held.select(*KEYS).distinct().orderBy(*KEYS)


def migration_plan(legacy: DataFrame, present: DataFrame, overwrite: bool = False, dry_run: bool = False) -> DataFrame:
    """Per source and period of old files: rows, and whether it is to be written.

    ``legacy`` has ``source`` beside the keys. Sources are taken in order of
    name. Unless ``overwrite``, a period already on disk is left alone, and so
    is one that an earlier source has just written; a dry run writes nothing, so
    there only the first applies.
    """
    on_disk = present.select(*KEYS).distinct().withColumn("_present", F.lit(True))
    periods = legacy.groupBy("source", *KEYS).agg(F.count(F.lit(1)).alias("rows"))
    firsts = periods.groupBy(*KEYS).agg(F.min("source").alias("_first"))
    joined = periods.join(on_disk, KEYS, "left").join(firsts, KEYS)
    first = F.lit(dry_run) | (F.col("source") == F.col("_first"))
    write = F.lit(overwrite) | (F.col("_present").isNull() & first)
    return joined.select("source", *KEYS, "rows", write.alias("write"))


def migration_report(plan: DataFrame) -> DataFrame:
    """Per source: rows, periods, periods written and periods skipped."""
    return plan.groupBy("table_id", "source").agg(
        F.sum("rows").alias("rows_total"),
        F.count(F.lit(1)).alias("tids_total"),
        F.count_if(F.col("write")).alias("files_written"),
        F.count_if(~F.col("write")).alias("files_skipped_existing"),
    )


def migrate_layout(legacy: DataFrame, root: str, overwrite: bool = False, dry_run: bool = False) -> DataFrame:
    """Bring old files into the period layout and report; a dry run only reports.

    With ``overwrite`` the last source that holds a period is the one that stays.
    """
    # the plan is kept, because writing changes the manifest it was made from
    plan = cut_lineage(migration_plan(legacy, manifest(legacy.sparkSession, root), overwrite, dry_run))
    if not dry_run:
        last = plan.where("write").groupBy(*KEYS).agg(F.max("source").alias("source"))
        write_periods(legacy.join(last, [*KEYS, "source"], "left_semi").drop("source"), root)
    return migration_report(plan)
