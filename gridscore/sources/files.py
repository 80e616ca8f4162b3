"""Reading and writing record files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from gridscore.session import path_exists, scratch_path


def read_jsonl(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """One object per line. A missing file is an empty table, blank lines are skipped, a line
    that is not JSON stops the job."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_json_array(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """A file that holds one array of objects; anything else stops the job."""
    texts = spark.read.text(path, wholetext=True)
    is_array = F.substring(F.trim(F.regexp_replace("value", r"\A\s+", "")), 1, 1) == "["
    checked = F.when(is_array, F.col("value")).otherwise(F.raise_error(F.lit("the dataset must be an array")).cast("string"))
    fields = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
    rows = F.from_json(checked, ArrayType(fields), {"mode": "FAILFAST"})
    return texts.select(F.posexplode(rows).alias("pos", "item")).select("pos", "item.*")


def read_large_json_array(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """The elements of files that hold one array of objects each, read by many tasks: ``pos`` and the fields, like
    :func:`read_json_array`; anything else stops the job.

    A text value never goes over a line end in JSON, so the brackets that a line opens can be counted without its neighbours.
    Sums of these per file split, then within a split, give the depth at which every line begins, and a line that begins between
    elements cuts the file. Elements that go over the end of a split are put together from their parts, of which a split has
    two at most. Positions come from counts in the same two levels. What is between two such lines is parsed at once, so an array on a single line is
    the limit: it is one row of one task, as with ``read_json_array``.
    """
    fields = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
    outside = F.regexp_replace(F.regexp_replace("value", r"\\.", ""), '"[^"]*"', "")
    count = lambda signs: F.length(F.regexp_replace(outside, f"[^{signs}]", ""))
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("line"),
        "value", (count(r"\[{") - count(r"\]}")).alias("opened"),
    ).where(F.col("value").rlike(r"\S"))
    first = F.min_by("value", "line")
    splits = lines.groupBy("file", "split").agg(F.sum("opened").alias("opened"), first.alias("first"))
    in_file = Window.partitionBy("file").orderBy("split")
    whole = Window.partitionBy("file")
    good = (F.first("first").over(in_file).rlike(r"^\s*\[")) & (F.sum("opened").over(whole) == 0)
    depth = F.coalesce(F.sum("opened").over(in_file.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    checked = F.when(good, depth).otherwise(F.raise_error(F.lit("the dataset must be an array")).cast("bigint"))
    begun = splits.select("file", "split", checked.alias("depth"))

    in_split = Window.partitionBy("file", "split").orderBy("line")
    before = F.col("depth") + F.coalesce(F.sum("opened").over(in_split.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = lines.join(begun, ["file", "split"]).select("file", "split", "line", "value", before.alias("before"), (before + F.col("opened")).alias("after"))
    placed = placed.withColumn("part", F.sum(F.when(F.col("before") <= 1, 1).otherwise(0)).over(in_split))
    in_order = F.array_sort(F.collect_list(F.struct("line", "value")))
    parts = placed.groupBy("file", "split", "part").agg(
        F.array_join(F.transform(in_order, lambda e: e["value"]), "\n").alias("text"), F.min_by("before", "line").alias("before"), F.max_by("after", "line").alias("after"),
    )
    # Part 0 of a split goes on from the split before; an element still open in the end goes on in the next.
    reaches = (F.col("part") == 0) | (F.col("after") > 1)
    chain = F.sum(F.when(F.col("part") > 0, 1).otherwise(0)).over(Window.partitionBy("file").orderBy("split", "part"))
    joined = parts.where(reaches).withColumn("chain", chain).groupBy("file", "chain").agg(
        F.min(F.struct("split", "part")).alias("at"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("split", "part", "text"))), lambda e: e["text"]), "\n").alias("text"),
        F.min_by("before", F.struct("split", "part")).alias("before"), F.max_by("after", F.struct("split", "part")).alias("after"),
    ).select("file", "at.split", "at.part", "text", "before", "after")
    pieces = parts.where(~reaches).select("file", "split", "part", "text", "before", "after").unionByName(joined)
    bare = F.when(F.col("before") == 0, F.regexp_replace("text", r"^\s*\[", "")).otherwise(F.col("text"))
    bare = F.when(F.col("after") == 0, F.regexp_replace(bare, r"\]\s*\z", "")).otherwise(bare)
    items = F.from_json(F.concat(F.lit("["), F.regexp_replace(bare, r"^[\s,]+|[\s,]+\z", ""), F.lit("]")), ArrayType(fields), {"mode": "FAILFAST"})
    stored = scratch_path(spark, "array-parts")
    pieces.select("file", "split", "part", items.alias("items"), (F.col("before") == 0).alias("outermost")).write.parquet(stored)
    pieces = spark.read.parquet(stored)
    counts = pieces.groupBy("file", "split").agg(F.sum(F.size("items")).alias("n"), F.count_if("outermost").alias("arrays"))
    n = F.coalesce(F.sum("n").over(in_file.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    one = F.when(F.sum("arrays").over(whole) == 1, n).otherwise(F.raise_error(F.lit("the dataset must be one array")).cast("bigint"))
    earlier = counts.select("file", "split", one.alias("earlier"))
    within = F.coalesce(F.sum(F.size("items")).over(Window.partitionBy("file", "split").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = pieces.join(earlier, ["file", "split"]).withColumn("base", F.col("earlier") + within)
    return rows.select("base", F.posexplode("items").alias("at", "item")).select((F.col("base") + F.col("at")).alias("pos"), "item.*")


def read_batches(spark: SparkSession, folder: str, item_schema: str, multi_line: bool = True) -> DataFrame:
    """Items of all batches of a folder, with file name and position as order.

    Files hold one pretty-printed batch each, or (``multi_line=False``) one batch per line, which
    keeps the number of files independent of the number of batches.
    """
    schema = f"datasetId string, batchId string, items array<{item_schema}>"
    batches = spark.read.schema(schema).option("multiLine", multi_line).option("mode", "FAILFAST").option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").json(folder)
    named = batches.withColumn("file", F.element_at(F.split(F.input_file_name(), "/"), -1))
    return named.select("datasetId", "batchId", "file", F.posexplode("items").alias("pos", "item")).select(
        "datasetId", "batchId", "file", "pos", "item.*"
    )


def append_jsonl(rows: DataFrame, path: str) -> None:
    """Append objects, one per line. Null fields are written, as the record format demands."""
    rows.write.mode("append").option("ignoreNullFields", "false").json(path)


def fingerprint(spark: SparkSession, path: str) -> DataFrame:
    """SHA-256 of each file (path, length, sha256)."""
    return spark.read.format("binaryFile").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))


def row_digest(rows: DataFrame, *text: Column) -> Column:
    """Order-free digest of a table: the sum of each row's whole SHA-256, in four parts, after the number of rows.

    A sum tells how often a row occurs, so repeated rows do not cancel out.
    """
    digest = F.sha2(F.concat_ws("\x1f", *text), 256)
    parts = [F.sum(F.conv(F.substring(digest, 16 * k + 1, 16), 16, 10).cast("decimal(38,0)")).cast("string") for k in range(4)]
    return F.concat_ws("-", F.count(F.lit(1)).cast("string"), *parts)


def _file_system(spark: SparkSession, path: str):
    hadoop_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hadoop_path


def latest_version(spark: SparkSession, root: str) -> int:
    """Highest committed version below ``root``; 0 when there is none."""
    fs, path = _file_system(spark, root)
    if not fs.exists(path):
        return 0
    names = [status.getPath().getName() for status in fs.listStatus(path)]
    return max((int(name.split("=")[1].split(".")[0]) for name in names if name.startswith("committed=")), default=0)


def folder_names(spark: SparkSession, root: str) -> list[str]:
    fs, path = _file_system(spark, root)
    return [status.getPath().getName() for status in fs.listStatus(path)] if fs.exists(path) else []


def prune_versions(spark: SparkSession, root: str, keep: int = 3) -> None:
    """Delete committed versions but the last ``keep``; a reader of the newest is not disturbed."""
    last = latest_version(spark, root)
    for name in folder_names(spark, root):
        kind, _, number = name.removesuffix(".marker").partition("=")
        if kind in ("version", "committed") and int(number) <= last - keep:
            fs, path = _file_system(spark, f"{root}/{name}")
            fs.delete(path, True)


def read_version(spark: SparkSession, root: str, schema: StructType | str, version: int | None = None) -> DataFrame:
    number = latest_version(spark, root) if version is None else version
    return read_jsonl(spark, f"{root}/version={number}", schema)


def write_version(rows: DataFrame, root: str) -> int:
    """Write a full new version. The path being read is never overwritten, the old version is
    the backup, and a marker written last makes the new one visible."""
    spark = rows.sparkSession
    number = latest_version(spark, root) + 1
    rows.write.mode("overwrite").option("ignoreNullFields", "false").json(f"{root}/version={number}")
    write_marker(spark, root, number)
    return number


def write_marker(spark: SparkSession, root: str, number: int) -> None:
    """Make a version that is written in full the one that readers see."""
    fs, marker = _file_system(spark, f"{root}/committed={number}.marker")
    fs.create(marker, True).close()


def rewrite_repaired(repaired: DataFrame, root: str, failures: DataFrame | None = None, failure_root: str | None = None) -> int | None:
    """Store repaired judgments, and the failures that remain, as new versions; the versions before are the backups. Nothing
    is written if nothing was repaired."""
    from gridscore.operators.normalize import remaining_failures

    if repaired.where("repaired").isEmpty():
        return None
    number = write_version(repaired.drop("repaired"), root)
    if failures is not None:
        write_version(remaining_failures(failures, repaired), failure_root)
    return number


def write_csv(lines: DataFrame, columns: list[str], path: str, order: list[str]) -> None:
    """Header and lines as one text file. Reports are bounded by participants and slices, so one
    task may sort and write them."""
    body = lines.select("value", F.lit(1).alias("_part"), *order)
    header = lines.sparkSession.range(1).select(F.lit(",".join(columns)).alias("value"), F.lit(0).alias("_part"))
    whole = header.unionByName(body, allowMissingColumns=True).repartition(1).sortWithinPartitions("_part", *order)
    whole.select("value").write.mode("overwrite").text(path)


def write_scaffold(items: DataFrame, existing: DataFrame | None, root: str, force: bool = False, by: str = "batch_id") -> None:
    """One folder per batch, or per coarser column ``by`` when batches are many; existing batches
    that are not pristine are only replaced by force."""
    from gridscore.operators.items import pristine_rules, violations

    if existing is not None and not force:
        touched = violations(existing, pristine_rules()).where(F.size("violations") > 0)
        if not touched.isEmpty():
            raise ValueError("existing batches are not a pristine scaffold; use force to replace them")
    items.repartition(by).write.mode("overwrite").partitionBy(by).option("ignoreNullFields", "false").json(root)


def read_scaffold(spark: SparkSession, root: str, part: str, schema: StructType | str) -> DataFrame:
    """``manifest`` or ``batches`` of the newest complete scaffold below ``root``; an empty table if there is none."""
    return read_jsonl(spark, f"{root}/version={latest_version(spark, root)}/{part}", schema)


def write_scaffold_set(items: DataFrame, root: str, dataset: str, force: bool = False, by: str = "batch_id") -> int:
    """Write a scaffold as a new version below ``root``: ``manifest`` (one line per item: ``datasetId, sampleId, locked`` and
    the batch) and ``batches`` (a folder per value of ``by``). A marker written last makes both visible at once, and the
    versions before are the backups.

    ``items`` is the plan, with ``sampleId, locked, status, fill``. Unless forced, the batches that are there now must be an
    untouched scaffold of the same plan (:func:`~gridscore.operators.items.scaffold_problems`); no batches are no
    obstacle. The driver sees at most three of the ids that are not.
    """
    from gridscore.operators.items import scaffold_problems

    spark = items.sparkSession
    number = latest_version(spark, root) + 1
    if not force and number > 1:
        existing = read_scaffold(spark, root, "batches", items.schema)
        found = scaffold_problems(existing, items).take(3) if existing.take(1) else []
        if found:
            named = ", ".join(f"{row.sampleId} ({row.problem})" for row in found)
            raise ValueError(f"existing batches are not a pristine scaffold of this plan: {named}; use force to replace them")
    folder = f"{root}/version={number}"
    manifest = items.select(F.lit(dataset).alias("datasetId"), "sampleId", "locked", *dict.fromkeys(["batch_id", by]))
    manifest.write.mode("overwrite").option("ignoreNullFields", "false").json(f"{folder}/manifest")
    write_scaffold(items, None, f"{folder}/batches", by=by)
    write_marker(spark, root, number)
    return number
