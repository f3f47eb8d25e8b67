"""Sources: shards with missing columns, fallback chains, CSV, JSON, lines, binaries with checksums, paged and limited scans."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType


def shards(spark: SparkSession, paths: list[str], defaults: dict[str, object]) -> DataFrame:
    """Parquet shards with differing columns by name; columns that are missing or null get their default. Missing paths are skipped; none at all is an error."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    there = [p for p in paths if (q := jvm.org.apache.hadoop.fs.Path(p)).getFileSystem(conf).exists(q)]
    if not there:
        raise FileNotFoundError(f"none of {paths}")
    out = None
    for p in there:
        df = spark.read.parquet(p)
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    for c, v in defaults.items():
        out = out.withColumn(c, F.coalesce(F.col(c), F.lit(v)) if c in out.columns else F.lit(v))
    return out


def first_available(loaders: list[Callable[[], DataFrame]]) -> DataFrame:
    """The first source of a chain that can be read; the last error if none can."""
    error: Exception = ValueError("no source")
    for load in loaders:
        try:
            df = load()
            df.schema  # noqa: B018 - resolves the source
            return df
        except Exception as e:  # noqa: BLE001 - any failure moves on to the next source
            error = e
    raise error


def until_filled(sources: list[DataFrame], need: int) -> DataFrame:
    """Rows of sources in order until ``need`` are there; limits stop each scan early."""
    out = None
    for df in sources:
        part = df.limit(need)
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out.limit(need)


def csv_rows(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """CSV with a header; rows that don't fit the schema are dropped."""
    return spark.read.csv(path, header=True, schema=schema, mode="DROPMALFORMED")


def csv_sample(spark: SparkSession, glob: str, schema: StructType | str, per_file: int = 2000, files: int = 5) -> DataFrame:
    """At most ``per_file`` rows, by a hash order, of each of the first ``files`` CSV files by name."""
    from pyspark.sql import window as W

    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(glob)
    found = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(where)
    paths = sorted(f.getPath().toString() for f in found or [])[:files]
    if not paths:
        raise FileNotFoundError(glob)
    df = spark.read.csv(paths, header=True, schema=schema)
    named = df.withColumn("file", F.col("_metadata.file_path")).withColumn("_h", F.xxhash64(*df.columns))
    return named.withColumn("_r", F.row_number().over(W.Window.partitionBy("file").orderBy("_h"))).filter(F.col("_r") <= per_file).drop("_r", "_h")


def json_rows(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    return spark.read.json(path, schema=schema, multiLine=True)


def lines(spark: SparkSession, path: str) -> DataFrame:
    """Trimmed lines of text files, blank ones dropped."""
    return spark.read.text(path).select(F.trim("value").alias("text")).filter("text <> ''")


def checksums(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, sha256) of binary files."""
    return spark.read.format("binaryFile").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))


def verified(found: DataFrame, manifest: DataFrame) -> DataFrame:
    """Files against a manifest (name, sha256): ok, changed, or missing."""
    name = F.element_at(F.split("path", "/"), -1)
    joined = manifest.join(found.withColumn("name", name).select("name", F.col("sha256").alias("_found")), "name", "left")
    return joined.select("name", F.when(F.col("_found").isNull(), "missing").when(F.col("_found") == F.col("sha256"), "ok").otherwise("changed").alias("state"))


def reassembled(parts: DataFrame, manifest: DataFrame) -> DataFrame:
    """(name, length, sha256, state) of files that were cut into parts.

    ``parts`` (path, content) are binary files whose names end in a number, ``manifest`` (name, length, sha256) says what
    they should give together: ok, changed, short (wrong length) or missing. A file's parts meet in one task, as its
    bytes must: files are bounded by what an array of bytes can hold.
    """
    name = F.element_at(F.split("path", "/"), -1)
    cut = parts.select(
        F.regexp_extract(name, r"^(.*?)[._-]?(?:part)?[._-]?[0-9]+$", 1).alias("name"),
        F.regexp_extract(name, r"([0-9]+)$", 1).cast("long").alias("_no"), "content",
    )
    ordered = cut.groupBy("name").agg(F.array_sort(F.collect_list(F.struct("_no", "content"))).alias("_all"))
    empty = F.to_binary(F.lit(""), F.lit("utf-8"))
    whole = F.aggregate("_all", empty, lambda a, p: F.concat(a, p["content"]))
    found = ordered.withColumn("_whole", whole)
    found = found.select("name", F.octet_length("_whole").alias("_length"), F.sha2("_whole", 256).alias("_sha"))
    joined = manifest.join(found, "name", "left")
    state = F.when(F.col("_sha").isNull(), "missing").when(F.col("_length") != F.col("length"), "short")
    state = state.when(F.col("_sha") == F.lower("sha256"), "ok").otherwise("changed")
    return joined.select("name", F.col("_length").alias("length"), F.col("_sha").alias("sha256"), state.alias("state"))


def hub_table(spark: SparkSession, root: str, name: str, split: str = "train") -> DataFrame:
    """A dataset kept as parquet files under ``root/name/split``; an unknown split is an error that names the known ones."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(f"{root}/{name}")
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    known = sorted(s.getPath().getName() for s in fs.listStatus(folder)) if fs.exists(folder) else []
    if split not in known:
        raise FileNotFoundError(f"{name} has no split {split!r}; there are {', '.join(known) or 'none'}")
    return spark.read.parquet(f"{root}/{name}/{split}")


def ingested(spark: SparkSession, folder: str, schema: StructType | str, keep, need: int, target: str) -> int:
    """Reads new files of a folder as a stream, file by file, until ``need`` rows that ``keep`` lets through (a function
    of a frame) are in ``target``, and stops there; what is left is read by the next call. Returns the rows held."""
    held = [0]

    def take(batch: DataFrame, _: int) -> None:
        short = need - held[0]
        if short > 0:
            part = keep(batch).limit(short).persist()
            held[0] += part.count()
            part.write.mode("append").parquet(target)
            part.unpersist()
        if held[0] >= need:
            query[0].stop()

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
    query = [None]
    writer = stream.writeStream.foreachBatch(lambda b, i: started.wait() and take(b, i))
    started = threading.Event()
    query[0] = writer.option("checkpointLocation", f"{target}-offsets").trigger(availableNow=True).start()
    started.set()
    try:
        query[0].awaitTermination()
    except Exception:
        if held[0] < need:
            raise
    return held[0]


def json_field(df: DataFrame, column: str, path: str, value: str | None = None) -> DataFrame:
    """A field of a JSON string column, and only rows where it has the value if one is given."""
    out = df.withColumn("field", F.get_json_object(column, path))
    return out if value is None else out.filter(F.col("field") == value)


def text_of(df: DataFrame, candidates: tuple[str, ...] = ("generation", "text", "passage")) -> DataFrame:
    """``text``: the first of the candidate columns that exist and aren't null."""
    have = [F.col(c) for c in candidates if c in df.columns]
    return df.withColumn("text", F.coalesce(*have) if have else F.lit(None).cast("string"))


class TooMany(OSError):
    """The server asks to wait; ``after`` seconds."""

    def __init__(self, after: float = 1.0):
        super().__init__(f"too many requests, wait {after} s")
        self.after = after


def fetched(fetch: Callable[[str | None], tuple[list, str | None]], cursor: str | None, retries: int, wait=time.sleep):
    """One page, fetched again after failures: where the server asks to wait, for as long as it says or twice the time of
    the attempt before, whichever is longer."""
    pause = 0.0
    for attempt in range(retries + 1):
        try:
            return fetch(cursor)
        except OSError as e:
            if attempt == retries:
                raise
            pause = max(getattr(e, "after", 0.0), 2 * pause or 0.1)
            wait(pause)


class CursorPages(DataSource):
    """A scan of pages behind cursors: each page names the next, so one feed is read in order by one task; several feeds
    (option ``feeds``, names parted by commas) side by side. Option ``need`` ends a feed early.

    Subclasses give ``fetch(feed, cursor)``, which returns the page's texts and the next cursor, None at the end.
    """

    retries = 5

    @classmethod
    def name(cls) -> str:
        return "cursor_pages"

    def schema(self) -> str:
        return "feed string, place int, text string"

    def fetch(self, feed: str, cursor: str | None) -> tuple[list[str], str | None]:
        raise ValueError(f"{type(self).__name__} must say how a page of {feed} is fetched")

    def reader(self, schema: StructType) -> DataSourceReader:
        return _CursorReader(self)


class _CursorReader(DataSourceReader):
    def __init__(self, source: CursorPages):
        self.source = source
        self.need = int(source.options.get("need", str(2**31 - 1)))

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(f) for f in self.source.options.get("feeds", "main").split(",")]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        feed, cursor, place = partition.value, None, 0
        while place < self.need:
            page, cursor = fetched(lambda c: self.source.fetch(feed, c), cursor, self.source.retries)
            for text in page[: self.need - place]:
                yield feed, place, text
                place += 1
            if cursor is None:
                return
