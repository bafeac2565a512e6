"""Sources and sinks: line-delimited JSON, tolerant of malformed lines, of malformed files or of nothing; multi-line
CSV, id lists, labelled trees of files, reports, state tables of many writers, logs that take a batch once."""

from __future__ import annotations

import functools
import re
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import run_label
from ..operators.select import small
from .scratch import written

CORRUPT = "_corrupt_record"


def read_jsonl(spark: SparkSession, paths: str | list[str], schema: T.StructType, tolerant: bool = True, keep_corrupt: bool = False, **options: str) -> DataFrame:
    """Rows of JSON lines; blank lines vanish. tolerant: malformed lines are dropped (or kept, with only their text in
    _corrupt_record), else the first one fails the job."""
    reader = spark.read.options(**options)
    if not tolerant:
        return reader.schema(schema).option("mode", "FAILFAST").json(paths)
    found = reader.schema(T.StructType([*schema, T.StructField(CORRUPT, T.StringType())])).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT).json(paths)
    return found if keep_corrupt else found.where(F.col(CORRUPT).isNull() & _parsed(schema)).drop(CORRUPT)


def _parsed(schema: T.StructType) -> Column:
    """Always true, but not to the optimizer: lines are only found to be malformed while their fields are read."""
    return F.xxhash64(*schema.names) >= F.lit(-(2**63))


def corrupt_lines(spark: SparkSession, paths: str | list[str], schema: T.StructType) -> DataFrame:
    """file, dropped: how many lines of each file a tolerant read drops."""
    return read_jsonl(spark, paths, schema, keep_corrupt=True).select(F.col("_metadata.file_path").alias("file"), (F.col(CORRUPT).isNotNull() & _parsed(schema)).alias("bad")).groupBy("file").agg(F.count_if(F.col("bad")).alias("dropped"))


def read_whole_files(spark: SparkSession, paths: str | list[str], schema: T.StructType) -> DataFrame:
    """Rows of the files that have no malformed line; corrupt_lines() tells which have, and read_until_bad() keeps the
    rows before the first one."""
    found = read_jsonl(spark, paths, schema, keep_corrupt=True).withColumn("_file", F.col("_metadata.file_path"))
    bad = found.where(F.col(CORRUPT).isNotNull() & _parsed(schema)).select("_file").distinct()
    return found.join(bad, "_file", "left_anti").where(F.col(CORRUPT).isNull() & _parsed(schema)).drop("_file", CORRUPT)


def lines_in_order(spark: SparkSession, paths: str | list[str], **options: str) -> DataFrame:
    """value, file, block, seq of each line: ordered by (file, block, seq), lines stand as in their files.

    A block is the byte at which Spark's split of the file begins, and lines of a split are numbered as they are read, so
    the order costs no shuffle and files of any size are read by many tasks. Splits may differ from scan to scan (they
    depend on the executors there are): what compares places of two scans needs a written table of one.
    """
    found = spark.read.options(**options).text(paths)
    return found.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("seq"))


def read_lines(spark: SparkSession, paths: str | list[str], **options: str) -> DataFrame:
    """value, file and ordinal (from 0, blank lines count) of each line. Blocks are counted, not sorted: a block's first
    ordinal is the number of lines in the file's blocks before it."""
    lines = written(lines_in_order(spark, paths, **options), "lines")
    blocks = lines.groupBy("file", "block").agg(F.min("seq").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("file").orderBy("block")  # a row per split of the file
    starts = blocks.select("file", "block", (F.sum("_n").over(before) - F.col("_n") - F.col("_first")).alias("_shift"))
    return lines.join(starts, ["file", "block"]).select("value", "file", (F.col("seq") + F.col("_shift")).alias("ordinal"))


def read_until_bad(spark: SparkSession, paths: str | list[str], schema: T.StructType, **options: str) -> DataFrame:
    """Rows of JSON lines up to each file's first malformed one, as a reader that goes line by line keeps them, with
    file and place (struct that orders the rows of a file). Blank lines are skipped."""
    parsed = F.from_json("value", T.StructType([*schema, T.StructField(CORRUPT, T.StringType())]), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT})
    lines = lines_in_order(spark, paths, **options).where(F.trim("value") != "")
    rows = written(lines.select(parsed.alias("row"), "file", F.struct("block", "seq").alias("place")), "parsed")
    bad = rows.where(F.col(f"row.{CORRUPT}").isNotNull()).groupBy("file").agg(F.min("place").alias("_end"))  # a row per file at most
    kept = rows.join(bad, "file", "left").where(F.col("_end").isNull() | (F.col("place") < F.col("_end")))
    return kept.select(*[F.col("row")[c].alias(c) for c in schema.names], "file", "place")


def read_csv(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """CSV with quoted line breaks, all columns as strings (empty ones null, ids without blanks at their ends); header
    names without byte-order mark, blanks or case."""
    found = spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').csv(paths)
    found = found.toDF(*[c.lstrip("\ufeff").strip().lower() for c in found.columns])
    return found.withColumn("id", F.trim("id")) if "id" in found.columns else found


def write_csv(df: DataFrame, path: str) -> None:
    """CSV that read_csv reads back: every value quoted, quotes doubled, blanks kept."""
    df.write.mode("overwrite").option("header", True).option("quoteAll", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def read_ids(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Distinct ids of files that hold them between white space."""
    return spark.read.text(paths).select(F.explode(F.split("value", r"\s+")).alias("id")).where("id <> ''").distinct()


def read_labelled(spark: SparkSession, root: str, schema: T.StructType, name: str = "results.jsonl") -> DataFrame:
    """root/<label>/name with the label as a column; labels of test runs (`_test...`) are left out."""
    found = read_jsonl(spark, f"{root}/*/{name}", schema).withColumn("label", F.regexp_extract("_metadata.file_path", f"/([^/]+)/{re.escape(name)}(/[^/]*)?$", 1))
    return found.where(~F.col("label").startswith("_test"))


def read_tree(spark: SparkSession, root: str, schema: T.StructType, name: str = "results.jsonl") -> DataFrame:
    """All files of a name (or pattern) below root, with source_file and label: the normalised name of the folder of a
    results.jsonl, the own name of any other file, both without what marks captures. Folders that begin with an underscore
    or a dot are hidden from Spark and left out."""
    found = read_jsonl(spark, root, schema, recursiveFileLookup="true", pathGlobFilter=name).withColumn("source_file", F.col("_metadata.file_path"))
    file = F.element_at(F.split("source_file", "/"), -1)
    stem = F.regexp_replace(F.regexp_replace(file, r"\.[^.]*$", ""), "_existing$", "")
    return found.withColumn("label", F.when(file == "results.jsonl", run_label(F.element_at(F.split("source_file", "/"), -2))).otherwise(stem))


def read_registry(spark: SparkSession, registry: dict[str, str], schema: T.StructType) -> tuple[DataFrame, list[str]]:
    """The union of registered files with their source, and the sources whose files are missing."""
    parts, missing = [], []
    for source, path in registry.items():
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        if where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
            parts.append(read_jsonl(spark, path, schema).withColumn("source", F.lit(source)))
        else:
            missing.append(source)
    empty = spark.createDataFrame([], T.StructType([*schema, T.StructField("source", T.StringType())]))
    return functools.reduce(DataFrame.unionByName, parts, empty), missing


def union_all(*frames: DataFrame) -> DataFrame:
    """Bag union of frames whose columns differ; missing ones are null."""
    return functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def append_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def overwrite_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_ids(df: DataFrame, column: str, path: str) -> None:
    """Ids as lines of text, sorted across the files."""
    df.select(F.col(column).cast("string").alias("value")).orderBy("value").write.mode("overwrite").text(path)


def result_line(df: DataFrame, tag: str) -> DataFrame:
    """Each row as a line `tag {json}`."""
    return df.select(F.concat(F.lit(f"{tag} "), F.to_json(F.struct(*df.columns))).alias("value"))


def markdown(df: DataFrame) -> str:
    """An aggregated frame, all of its rows, as a Markdown table."""
    lines = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join([*lines, *("| " + " | ".join("" if v is None else f"{v:.3f}" if isinstance(v, float) else str(v) for v in r) + " |" for r in df.toLocalIterator())])


def fixed_width(df: DataFrame) -> str:
    """An aggregated frame, all of its rows, as a table of aligned columns."""
    rows = [df.columns, *([("" if v is None else str(v)) for v in r] for r in df.toLocalIterator())]
    widths = [max(len(r[k]) for r in rows) for k in range(len(df.columns))]
    return "\n".join("  ".join(v.ljust(w) for v, w in zip(r, widths)).rstrip() for r in rows)


#: Commits whose files stay: a writer that falls behind by fewer finds its number taken.
KEPT_COMMITS = 100


def _on_storage(spark: SparkSession, path: str) -> tuple:
    """A Hadoop path and its file system."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def claim(spark: SparkSession, source: str, target: str) -> bool:
    """Gives a file or folder a name that nothing has, in one step; False, and source stays, if the name is taken.

    Renames of local file systems replace what is there, so a local file gets its second name by a hard link, which
    fails if the name is taken; elsewhere the rename itself does.
    """
    (old, fs), (new, _) = _on_storage(spark, source), _on_storage(spark, target)
    jvm, gateway = spark._jvm, spark.sparkContext._gateway
    try:
        if fs.getUri().getScheme() == "file" and fs.getFileStatus(old).isFile():
            local = lambda at: jvm.java.io.File(at.toUri().getPath()).toPath()
            jvm.java.nio.file.Files.createLink(local(new), local(old))
            fs.delete(old, False)
        else:
            nothing = gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.makeQualified(new).toUri(), spark._jsc.hadoopConfiguration()).rename(fs.makeQualified(old), fs.makeQualified(new), nothing)
    except Py4JJavaError as e:
        if e.java_exception.getClass().getSimpleName() != "FileAlreadyExistsException":
            raise
        return False
    return True


def _commits(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the commits of a state table, ascending."""
    where, fs = _on_storage(spark, f"{path}/_commits")
    return sorted(int(f.getPath().getName()) for f in fs.listStatus(where) if f.getPath().getName().isdigit()) if fs.exists(where) else []


def _version(spark: SparkSession, path: str, number: int) -> str:
    where, fs = _on_storage(spark, f"{path}/_commits/{number:020d}")
    stream = fs.open(where)
    try:
        return bytes(stream.readNBytes(32)).decode()
    finally:
        stream.close()


def update_state(spark: SparkSession, path: str, change: Callable[[DataFrame | None], DataFrame], tries: int = 50) -> None:
    """Replaces a keyed state table, as a whole and at once, by change(the table as last saved, None before that).

    A version is written beside the others; a commit, a file of the next number that names it, makes it the table.
    Only one writer gets a number: any other removes its version and starts again from the newer table, so no change is
    lost, whoever runs at the same time. change may run several times; a writer KEPT_COMMITS behind may apply it twice,
    so it should be one that changes nothing the second time. Readers see the old or the new version, and the version
    before the last stays for those that still read it. Versions that a stopped writer never committed stay unread.
    """
    for _ in range(tries):
        done, name = _commits(spark, path), uuid.uuid4().hex
        last = done[-1] if done else -1
        version, draft = f"{path}/version={name}", f"{path}/_commits/_next-{name}"
        try:
            change(spark.read.parquet(f"{path}/version={_version(spark, path, last)}") if done else None).write.parquet(version)
        except Exception:
            _remove(spark, version)
            if _commits(spark, path)[-1:] == done[-1:]:
                raise
            continue  # what it read was replaced twice, and removed
        where, fs = _on_storage(spark, draft)
        out = fs.create(where, True)
        out.write(bytearray(name.encode()))
        out.close()
        if claim(spark, draft, f"{path}/_commits/{last + 1:020d}"):
            now = _commits(spark, path)
            if now[-1] < last + 1 + KEPT_COMMITS:
                if last > 0:
                    _remove(spark, f"{path}/version={_version(spark, path, last - 1)}")
                for number in now:
                    if number <= last + 1 - KEPT_COMMITS:
                        _remove(spark, f"{path}/_commits/{number:020d}")
                return
            _remove(spark, f"{path}/_commits/{last + 1:020d}")  # a number that was given long ago
        _remove(spark, draft)
        _remove(spark, version)
    raise RuntimeError(f"{path}: other writers came first {tries} times")


def _remove(spark: SparkSession, path: str) -> None:
    where, fs = _on_storage(spark, path)
    fs.delete(where, True)


def save_state(df: DataFrame, path: str) -> None:
    """A keyed state table, replaced as a whole and at once, whatever it holds; see update_state()."""
    update_state(df.sparkSession, path, lambda _: df)


def load_state(spark: SparkSession, path: str) -> DataFrame | None:
    """The state table as it was last saved; None before that."""
    done = _commits(spark, path)
    return spark.read.parquet(f"{path}/version={_version(spark, path, done[-1])}") if done else None


def load_log(spark: SparkSession, path: str) -> DataFrame | None:
    """The rows of all batches that append_batch() has added, with the batch; None before the first."""
    where, fs = _on_storage(spark, path)
    if not fs.exists(where) or not any(f.getPath().getName().startswith("batch=") for f in fs.listStatus(where)):
        return None
    return spark.read.parquet(path).withColumn("batch", F.col("batch").cast("string"))


def append_batch(df: DataFrame, path: str, batch: str, keys: list[str]) -> bool:
    """Adds a batch to a log once: False, and nothing changes, if it has been added before.

    The log's folders are the ledger: a batch is written under a hidden name and then renamed to its own, in one step.
    A row whose key a row without error of the log has is left out, and of rows of one batch with equal keys and no
    error one stays; rows with an error never count as done and are all kept. Null is a key like any other. Of the log
    only keys that the batch has are shuffled, where the batch's keys are few enough to be broadcast.
    """
    spark, target = df.sparkSession, f"{path}/batch={batch}"
    where, fs = _on_storage(spark, target)
    if fs.exists(where):
        return False
    failed = F.coalesce("error", F.lit("")) != "" if "error" in df.columns else F.lit(False)
    good, old = df.where(~failed).dropDuplicates(keys), load_log(spark, path)
    if old is not None:
        key = "_key"
        while key in df.columns:
            key += "_"
        done = (old.where(F.coalesce("error", F.lit("")) == "") if "error" in old.columns else old).select(F.struct(*keys).alias(key))
        good = good.withColumn(key, F.struct(*keys))
        good = good.join(done.join(small(good.select(key)), key, "left_semi"), key, "left_anti").drop(key)
    draft = f"{path}/_draft-{uuid.uuid4().hex}"
    good.unionByName(df.where(failed)).write.parquet(draft)
    if claim(spark, draft, target):
        return True
    _remove(spark, draft)
    return False
