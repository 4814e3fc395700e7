"""Sources and sinks: typed scans, caches, pinned inputs, audits, feature collections, content-addressed output."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from acrework.operators.audits import assert_unique

POINT = "struct<type:string,coordinates:array<double>>"


def read_csv(spark: SparkSession, path: str, schema: StructType | str, sep: str = ",", header: bool = True) -> DataFrame:
    """Delimited text with a stated schema (ids stay text); blank lines are dropped."""
    return spark.read.schema(schema).option("header", header).option("sep", sep).option("mode", "PERMISSIVE").csv(path)


def read_text_files(spark: SparkSession, path: str) -> DataFrame:
    """Whole documents: path and text."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def read_features(spark: SparkSession, path: str, properties: str, geometry: str = POINT) -> DataFrame:
    """Features of GeoJSON files as rows: the properties (a DDL string) and the geometry.

    Truncated files and files without features are dropped; columns that later steps do not use are not parsed.
    """
    feature = f"struct<type:string,properties:struct<{properties}>,geometry:{geometry}>"
    schema = f"type string, features array<{feature}>, _corrupt string"
    pages = spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path)
    good = pages.filter(F.col("_corrupt").isNull() & F.col("features").isNotNull())
    return good.select(F.explode("features").alias("f")).select("f.properties.*", "f.geometry")


def write_features(df: DataFrame, path: str, columns: Sequence[str], geometry: str = "geometry") -> None:
    """One GeoJSON feature on each line, with the chosen columns as properties."""
    feature = F.struct(F.lit("Feature").alias("type"), F.struct(*columns).alias("properties"), F.col(geometry).alias("geometry"))
    df.select(F.to_json(feature).alias("value")).write.text(path)


def read_feature_lines(spark: SparkSession, path: str, properties: str, geometry: str = POINT) -> DataFrame:
    """Features written one on each line."""
    return spark.read.schema(f"type string, properties struct<{properties}>, geometry {geometry}").json(path).select("properties.*", "geometry")


def cached(spark: SparkSession, path: str, build, partition: Sequence[str] = ()) -> DataFrame:
    """The table at ``path``; built and written once if it is not there."""
    from py4j.protocol import Py4JError
    from pyspark.errors import AnalysisException

    try:
        return spark.read.parquet(path)
    except (AnalysisException, Py4JError):
        writer = build().write
        (writer.partitionBy(*partition) if partition else writer).parquet(path)
        return spark.read.parquet(path)


def crosswalk(pairs: DataFrame, key: str, target: str) -> DataFrame:
    """The target of each key if it is the only one, else null."""
    return pairs.groupBy(key).agg(F.min(target).alias("_lo"), F.max(target).alias("_hi")).select(key, F.when(F.col("_lo") == F.col("_hi"), F.col("_lo")).alias(target))


def verify_pins(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """State of each input against its manifest (columns name, sha256): verified, changed, undeclared, missing."""
    both = files.join(manifest.withColumnRenamed("sha256", "_pinned"), "name", "full")
    state = F.when(F.col("sha256").isNull(), "missing").when(F.col("_pinned").isNull(), "undeclared").when(F.col("sha256") == F.col("_pinned"), "verified").otherwise("changed")
    return both.select("name", state.alias("state"))


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """Name and sha256 of the bytes of each file."""
    return spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("name"), F.sha2("content", 256).alias("sha256"))


def lock_faults(lock: DataFrame) -> DataFrame:
    """Faults of a lock table (id, snapshot, sha256): repeated id, blank snapshot, malformed digest."""
    twice = lock.groupBy("id").count().filter("count > 1").select("id", F.lit("repeated").alias("fault"))
    rows = lock.select("id", F.when(F.coalesce(F.trim("snapshot"), F.lit("")) == "", "snapshot").when(~F.coalesce(F.col("sha256").rlike("^[0-9a-f]{64}$"), F.lit(False)), "digest").alias("fault"))
    return rows.filter("fault IS NOT NULL").unionByName(twice)


def canonical_digest(columns: Sequence[str]) -> Column:
    """Digest of a row as JSON with sorted names; nulls are kept."""
    return F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}), 256)


def _contents(df: DataFrame) -> tuple:
    """Number of rows and sums of their digests: the same for the same rows, in any order and layout."""
    digest = canonical_digest(df.columns)
    part = lambda k: F.sum(F.conv(F.substring(digest, 1 + 12 * k, 12), 16, 10).cast("decimal(38,0)"))
    return tuple(df.agg(F.count("*"), *(part(k) for k in range(5))).first())


def publish(df: DataFrame, root: str) -> str:
    """Write rows under the digest of their contents and return it; the same contents go to the same place.

    The digest of the set is that of its sums of row digests, so it needs neither an order nor all rows in one place.
    What is there is read back: other contents under the same name are refused.
    """
    contents = _contents(df)
    name = df.sparkSession.range(1).select(F.sha2(F.lit("|".join(map(str, contents))), 256)).first()[0]
    df.write.mode("ignore").parquet(f"{root.rstrip('/')}/{name}")
    if _contents(df.sparkSession.read.schema(df.schema).parquet(f"{root.rstrip('/')}/{name}")) != contents:
        raise ValueError(f"{name} holds other contents")
    return name


def _latest_file(root: str) -> str:
    return f"{root.rstrip('/')}/latest"


def latest(spark: SparkSession, root: str) -> list[str]:
    """The names that the pointer of ``root`` lists, in order; none if nothing was published."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_latest_file(root))
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return []
    return [r["value"] for r in spark.read.text(_latest_file(root)).collect()]  # as many as were published one after the other


def _point(spark: SparkSession, root: str, names: Sequence[str]) -> None:
    """Let the pointer list these names.  It is written beside and renamed over the old one, so readers see one of both."""
    fs, conf = spark._jvm.org.apache.hadoop.fs, spark._jsc.hadoopConfiguration()
    new, old = fs.Path(f"{root.rstrip('/')}/.latest-{uuid.uuid4().hex}"), fs.Path(_latest_file(root))
    context = fs.FileContext.getFileContext(new.getFileSystem(conf).getUri(), conf)
    out = new.getFileSystem(conf).create(new, True)
    out.write(bytearray(("\n".join(names) + "\n").encode()))
    out.close()
    how = spark.sparkContext._gateway.new_array(getattr(fs, "Options$Rename"), 1)
    how[0] = getattr(fs, "Options$Rename").OVERWRITE
    context.rename(new, old, how)


def publish_latest(df: DataFrame, root: str) -> str:
    """Publish rows and, once they are verified, let the pointer name them alone; a writer that dies before leaves the old one."""
    name = publish(df, root)
    _point(df.sparkSession, root, [name])
    return name


def append_published(df: DataFrame, root: str) -> str:
    """Publish rows as an addition to those that the pointer lists already.  For one writer at a time."""
    listed = latest(df.sparkSession, root)
    name = publish(df, root)
    if name not in listed:
        _point(df.sparkSession, root, [*listed, name])
    return name


def read_latest(spark: SparkSession, root: str, schema: StructType | str) -> DataFrame:
    """The rows that the pointer lists; an empty table if nothing was published."""
    names = latest(spark, root)
    return spark.read.schema(schema).parquet(*(f"{root.rstrip('/')}/{n}" for n in names)) if names else spark.createDataFrame([], schema)


def key_slice(df: DataFrame, key: str, slices: int, i: int) -> DataFrame:
    """The i-th of equal slices by key hash."""
    return df.filter(F.pmod(F.xxhash64(key), F.lit(slices)) == i)


def merge_slices(parts: Sequence[DataFrame], key: str) -> DataFrame:
    """Union of slices; a key in two of them is an error."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return assert_unique(out, key)


def write_audit(df: DataFrame, summary: DataFrame, root: str) -> None:
    """Rows as CSV and a one-row summary as JSON."""
    df.write.mode("overwrite").option("header", True).csv(f"{root}/rows")
    summary.write.mode("overwrite").json(f"{root}/summary")


def feed_check(members: DataFrame, required: Sequence[str], days: DataFrame, service_day: str) -> DataFrame:
    """One row: missing members, first and last day, and whether the service day lies between."""
    found = members.agg(F.collect_set("name").alias("_m"))  # the names of one feed's members
    span = days.agg(F.min("day").alias("first"), F.max("day").alias("last"))
    return found.crossJoin(span).select(F.array_sort(F.array_except(F.array(*map(F.lit, required)), "_m")).alias("missing"), "first", "last", F.lit(service_day).cast("date").between(F.col("first"), F.col("last")).alias("served"))


def register_views(spark: SparkSession, sf_dir: str, names: Sequence[str]) -> None:
    """Temporary views over a folder of tables for ad-hoc SQL."""
    for name in names:
        spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)
