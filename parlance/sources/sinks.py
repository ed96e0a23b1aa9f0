"""Where results go: an archive in parts of a month with a manifest, logs, segment files, ordered text."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parlance.operators.ordering import resequence
from parlance.session import materialize
from parlance.sources.lines import read_lines

HASHED_LINES = 4096
BUCKETS = 32
UNDATED = "undated"
ARCHIVE = T.StructType([
    T.StructField("chat_id", T.LongType()),
    T.StructField("seq", T.LongType()),
    T.StructField("dt", T.TimestampNTZType()),
    T.StructField("block_text", T.StringType()),
    T.StructField("slot_date", T.StringType()),
    T.StructField("slot_time", T.StringType()),
    T.StructField("slot_sender", T.StringType()),
    T.StructField("src_file", T.StringType()),
])
#: Rows as they are stored: what orders them never changes when others come in between.
STORED = T.StructType([T.StructField("merge_no", T.LongType()), T.StructField("entry", T.LongType()), *(f for f in ARCHIVE if f.name != "seq")])
MANIFEST = T.StructType([
    T.StructField("version", T.LongType()), T.StructField("bucket", T.IntegerType()), T.StructField("month", T.StringType()),
    T.StructField("folder", T.StringType()), T.StructField("number", T.LongType()),
])


def write_normalized(rows: DataFrame, path: str) -> None:
    """Normalized rows, range-partitioned so that one big chat is many files in order."""
    rows.repartitionByRange("chat_id", "file", "entry").sortWithinPartitions("chat_id", "file", "entry").write.parquet(path)


def write_ordered_text(archive: DataFrame, path: str) -> None:
    """Archive blocks as text files that read in archive order."""
    archive.orderBy("chat_id", "seq").select(F.col("block_text").alias("value")).write.text(path)


def _manifests(spark: SparkSession, root: str) -> DataFrame | None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/versions")
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    return spark.read.schema(MANIFEST).json(f"{root}/versions") if fs.exists(folder) else None


def current_version(spark: SparkSession, root: str) -> int:
    """The newest published version of the archive, 0 before the first merge."""
    table = _manifests(spark, root)
    return 0 if table is None else table.agg(F.max("version")).first()[0] or 0


def manifest(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """(version, bucket, month, folder): the parts that make up the archive, by default its newest version."""
    version = current_version(spark, root) if version is None else version
    table = _manifests(spark, root)
    if table is None:
        return spark.createDataFrame([], MANIFEST).drop("number")
    return table.where((F.col("number") == version) & F.col("folder").isNotNull()).drop("number")


def in_parts(rows: DataFrame) -> DataFrame:
    """Adds `bucket` and `month`, the part of the archive a row belongs to; rows without a time have a month of their own.

    Big chats are spread over files by time, small ones share a bucket, so the number of parts follows the calendar.
    """
    month = F.coalesce(F.date_format("dt", "yyyy-MM"), F.lit(UNDATED))
    return rows.withColumns({"bucket": F.pmod(F.xxhash64("chat_id"), F.lit(BUCKETS)).cast("int"), "month": month})


def read_parts(spark: SparkSession, root: str, parts: DataFrame | None = None, version: int | None = None) -> DataFrame:
    """Archive rows as they are stored (with `merge_no` and `entry` in place of `seq`), of the given (bucket, month) or of all parts."""
    live = manifest(spark, root, version)
    if parts is not None:
        live = live.join(parts.select("bucket", "month").distinct(), ["bucket", "month"], "left_semi")
    # One path for each live part, BUCKETS a month at most.
    paths = [f"{root}/{r['folder']}/bucket={r['bucket']}/month={r['month']}" for r in live.select("folder", "bucket", "month").collect()]
    return spark.read.schema(STORED).parquet(*paths) if paths else spark.createDataFrame([], STORED)


def publish_merge(root: str, old: DataFrame, added: DataFrame) -> int:
    """Publishes the archive with `added` rows and returns the version. Only parts that gain rows are written anew, out of their rows in `old`
    and the added ones. Readers see the new parts when the manifest is there; a job that dies before leaves the old version."""
    spark = added.sparkSession
    before = current_version(spark, root)
    gained = materialize(in_parts(added.select(*(c for c in STORED.names if c not in ("merge_no", "entry")), F.col("seq").alias("entry"))), "added")
    changed = gained.select("bucket", "month").distinct()
    kept = in_parts(old).join(changed, ["bucket", "month"], "left_semi")
    rows = kept.unionByName(gained.withColumn("merge_no", F.lit(before + 1).cast("long")))
    folder = f"parts/{uuid.uuid4().hex}"
    order = ["bucket", "month", "chat_id", "dt", "merge_no", "entry"]
    rows.repartitionByRange(*order).sortWithinPartitions(*order).select(*STORED.names, "bucket", "month").write.partitionBy("bucket", "month").parquet(f"{root}/{folder}")
    version = F.lit(before + 1).cast("long").alias("version")
    after = manifest(spark, root, before).join(changed, ["bucket", "month"], "left_anti").select("version", "bucket", "month", "folder")
    after = after.unionByName(changed.select(version, "bucket", "month", F.lit(folder).alias("folder")))
    # A row without a part says that there is such a version, even if nothing was ever added.
    mark = spark.range(1).select(version, F.lit(None).cast("int").alias("bucket"), F.lit(None).cast("string").alias("month"), F.lit(None).cast("string").alias("folder"))
    # A folder per version: a second writer of the same version fails here instead of hiding this merge.
    after.unionByName(mark).coalesce(1).write.mode("error").json(f"{root}/versions/number={before + 1}")
    return before + 1


def read_archive(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """The archive in order: by time, within a minute by merge and place in it, undated rows last; `seq` counts its rows."""
    rows = resequence(read_parts(spark, root, version=version), "dt", ["merge_no", "entry"])
    return rows.select(*ARCHIVE.names)


def drop_old_parts(spark: SparkSession, root: str, keep: int = 2) -> int:
    """Deletes the folders that none of the `keep` newest versions refers to, and returns how many."""
    newest = current_version(spark, root)
    live = {r["folder"] for v in range(max(newest - keep + 1, 1), newest + 1) for r in manifest(spark, root, v).select("folder").distinct().collect()}
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/parts")
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    gone = [f.getPath() for f in fs.listStatus(folder) if f"parts/{f.getPath().getName()}" not in live]
    for path in gone:
        fs.delete(path, True)
    return len(gone)


def file_hashes(spark: SparkSession, paths) -> DataFrame:
    """(file, sha256) of source files of any length: the hash over the hashes of each 4,096 lines.

    Lines are numbered through the file, so the result doesn't depend on how it is split.
    """
    lines = read_lines(spark, paths).select("file", "block", "pos", "value")
    place = F.row_number().over(Window.partitionBy("file", "block").orderBy("pos"))
    cut = lines.withColumn("_n", place)
    sizes = cut.groupBy("file", "block").agg(F.max("_n").alias("_size"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("file", "block", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_start"))
    numbered = cut.join(starts, ["file", "block"]).select("file", (F.col("_start") + F.col("_n") - 1).alias("n"), "value")
    pieces = numbered.groupBy("file", F.floor(F.col("n") / HASHED_LINES).alias("piece")).agg(F.array_sort(F.collect_list(F.struct("n", "value"))).alias("_lines"))
    hashed = pieces.select("file", "piece", F.sha2(F.array_join(F.transform("_lines", lambda x: x["value"]), "\n"), 256).alias("h"))
    whole = hashed.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("piece", "h"))).alias("_hashes"))
    return whole.select("file", F.sha2(F.array_join(F.transform("_hashes", lambda x: x["h"]), "\n"), 256).alias("sha256"))


def log_rows(counts: DataFrame, hashes: DataFrame | None = None) -> DataFrame:
    """Merge log rows from per-file verdict counts, one for every hashed file too, with a note where there is something to say."""
    if hashes is None:
        rows = counts.withColumn("sha256", F.lit(None).cast("string"))
    else:
        names = [c for c in counts.columns if c != "file"]
        rows = hashes.join(counts, "file", "full").withColumns({c: F.coalesce(c, F.lit(0)) for c in names})
    said = [F.when(F.col("placeholders") > 0, F.format_string("%d placeholder line(s) skipped: the archive has content in their slots", "placeholders"))]
    if "undated" in counts.columns:
        said.append(F.when(F.col("undated") > 0, F.format_string("%d undated row(s) appended at the end", "undated")))
    note = F.concat_ws("; ", *said)
    return rows.withColumns({"merged_at": F.current_timestamp(), "note": F.when(note != "", note)})


def append_log(rows: DataFrame, root: str) -> None:
    rows.write.mode("append").json(f"{root}/merge_log")


def write_segments(table: DataFrame, csv_path: str, json_path: str) -> None:
    """Segments as CSV without the nested lists and as JSON with them."""
    table.drop("top_contributors", "distinctive").write.option("header", True).csv(csv_path)
    table.write.json(json_path)
