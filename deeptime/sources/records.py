"""Line-based record sources: curated files with a manifest, bulk files, slices as GeoJSON, query-result pages."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.fs  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from deeptime.operators.polygons import parsed, slice_faults
from deeptime.functions import text as X
from deeptime.functions import vocab as V
from deeptime.sources.scratch import small, written

RECORD = (
    "id string, type string, name string, description string, t0 string, t1 string, precision string, status string, categories array<string>, importance double, "
    "point array<double>, wikidata string, wikipedia string, media_thumb string, rel array<struct<type:string,target:string>>, "
    "props array<struct<property:string,value:double,min:double,max:double,unit:string,value_type:string,method:string,source:string,published_at:string,confidence:double>>, part_of_qid string"
)


#: Folders that many small files are written into.
FOLDERS = 256
#: A bulk line of more bytes than this is rejected unparsed.
MAX_LINE_BYTES = 1 << 20


def file_name() -> Column:
    return F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)


def arrow_knows(path: str) -> bool:
    """Whether Arrow can write to the file system that ``path`` names."""
    try:
        pa.fs.FileSystem.from_uri(path)
    except (pa.ArrowException, OSError):
        return False
    return True


def write_files(files: DataFrame, path: str) -> None:
    """A text file for each row ``(folder, name, value)``; no two files of a folder may have one name.

    Tasks write the files under their own names, so a thousand of them need neither a thousand folders to be made,
    renamed and listed nor a commit each; a task that runs again writes the same files. On a file system that Arrow
    does not know, Spark's writer makes a folder of each name instead.
    """
    spark = files.sparkSession
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    path = place.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(place).toString()
    if not arrow_knows(path):
        files.write.partitionBy("folder", "name").text(path)
        return

    def run(batches):
        system, root = pa.fs.FileSystem.from_uri(path)
        made = set()
        for batch in batches:
            for folder, name, value in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if folder not in made:
                    system.create_dir(f"{root}/folder={folder}", recursive=True)
                    made.add(folder)
                with system.open_output_stream(f"{root}/folder={folder}/{name}") as out:
                    out.write(f"{value}\n".encode())
            yield pa.RecordBatch.from_pydict({"n": pa.array([batch.num_rows], pa.int64())})

    system, root = pa.fs.FileSystem.from_uri(path)
    system.create_dir(root, recursive=True)
    files.select("folder", "name", "value").mapInArrow(run, "n long").agg(F.sum("n")).collect()


def numbered_lines(spark: SparkSession, path: str, name: Column | None = None) -> DataFrame:
    """``file, line, value`` with exact line numbers, counted from 1 in each file.

    Lines are numbered within the blocks that the reader splits files into, and
    the blocks' counts give the offsets, so no file has to fit a task. ``name``
    makes the file's name from ``_metadata``.
    """
    file = file_name() if name is None else name
    raw = spark.read.text(path).select(file.alias("file"), F.col("_metadata.file_path").alias("_path"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_at"), "value")
    return number_lines(raw)


def number_lines(raw: DataFrame) -> DataFrame:
    """``file, line, value`` of read lines ``(file, _path, _block, _at, value)``; ``_at`` goes up by one from line to line of a block.

    A block is read by one task without a break, so a line's number is its distance from the
    block's first one and the lines are not shuffled, however long they are.
    """
    rows = written(raw, "lines")
    sizes = rows.groupBy("_path", "_block").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    before = F.sum("_n").over(Window.partitionBy("_path").orderBy("_block")) - F.col("_n")
    offsets = small(written(sizes.select("_path", "_block", (before - F.col("_first") + 1).alias("_from")), "line-offsets"))
    return rows.join(offsets, ["_path", "_block"]).select("file", (F.col("_from") + F.col("_at")).alias("line"), F.trim("value").alias("value"))


def bulk_lines(spark: SparkSession, path: str, name: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Records and rejects of bulk files: no comments, and no line over ``MAX_LINE_BYTES``."""
    lines = numbered_lines(spark, path, name)
    long = F.octet_length("value") > MAX_LINE_BYTES
    good, bad = parse_lines(lines.filter(~long), comments=False)
    return good, bad.unionByName(lines.filter(long).select("file", "line", F.lit("line too long").alias("reason")))


def parsed_lines(lines: DataFrame, comments: bool) -> DataFrame:
    """Non-blank lines as ``file, line, fault`` and the fields of ``RECORD``; ``#`` lines are comments only where they are allowed."""
    used = lines.filter(F.col("value") != "")
    if comments:
        used = used.filter(~F.col("value").startswith("#"))
    parsed = used.withColumn("r", F.from_json("value", RECORD + ", _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    fault = F.when(F.col("r").isNull() | F.col("r._bad").isNotNull(), "invalid JSON")
    return parsed.select("file", "line", fault.alias("fault"), "r.*").drop("_bad")


def parse_lines(lines: DataFrame, comments: bool) -> tuple[DataFrame, DataFrame]:
    """Records and rejects of non-blank lines."""
    rows = parsed_lines(lines, comments)
    return rows.filter("fault IS NULL").drop("fault"), rows.filter("fault IS NOT NULL").select("file", "line", F.col("fault").alias("reason"))


def file_digests(spark: SparkSession, path: str, name: Column | None = None) -> DataFrame:
    """``file, n_bytes, sha256``; meant for curated files, each of which is read as one value of 2 GB at most."""
    file = file_name() if name is None else name
    return spark.read.format("binaryFile").load(path).select(file.alias("file"), F.length("content").cast("long").alias("n_bytes"), F.sha2("content", 256).alias("sha256"))


def derived_version(digests: DataFrame) -> DataFrame:
    """``version`` of a curated set, from the digests of its files in the order of their names."""
    each = F.transform(F.array_sort(F.collect_list(F.struct("file", "sha256"))), lambda x: x["sha256"])
    return digests.agg(F.concat(F.lit("seed-"), F.substring(F.sha2(F.array_join(each, "").cast("binary"), 256), 1, 8)).alias("version"))


def manifest_faults(spark: SparkSession, path: str, manifest: DataFrame, name: Column | None = None) -> DataFrame:
    """Files of ``manifest(file, sha256, count)`` that are missing or differ."""
    content = file_digests(spark, path, name).select("file", F.col("sha256").alias("have"))
    good, _ = parse_lines(numbered_lines(spark, path, name), comments=True)
    counts = good.groupBy("file").agg(F.count(F.lit(1)).alias("n"))
    j = manifest.join(content, "file", "left").join(counts, "file", "left")
    why = F.when(F.col("have").isNull(), "missing").when(F.col("have") != F.col("sha256"), "sha256").when(F.coalesce("n", F.lit(0)) != F.col("count"), "count")
    return j.select("file", why.alias("fault")).filter("fault IS NOT NULL")


def normalized(records: DataFrame) -> DataFrame:
    """Parsed records as rows of the model: an entity's columns, its ``categories``, ``rel`` and ``props``, and ``fault`` if they have it; an end that isn't given is the start."""
    t0 = authored_time(F.col("t0"))
    own = {"seed_id": F.col("id"), "t0": t0, "t1": F.when(F.col("t1").isNull(), t0).otherwise(authored_time(F.col("t1"))), "lon": F.get("point", F.lit(0)), "lat": F.get("point", F.lit(1))}
    return records.select("file", "line", *(c for c in ("fault",) if c in records.columns), "type", "name", "description", "precision", "status", "importance", "wikidata", "wikipedia", "categories", "rel", "props", *(c.alias(k) for k, c in own.items()))


def authored_time(text: Column) -> Column:
    """Seconds of ``YYYY-MM-DD``, an RFC 3339 instant or ``{"y": n}``; null for anything else."""
    year = F.get_json_object(text, "$.y").try_cast("double")
    day = F.try_to_timestamp(text, F.lit("yyyy-MM-dd"))
    instant = F.when(text.rlike(r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(\.\d+)?(Z|[+-]\d\d:\d\d)$"), text.try_cast("timestamp"))
    seconds = lambda c: F.unix_seconds(c).cast("double")
    return F.when(text.rlike(r"^\d{4}-\d\d-\d\d$"), seconds(day)).when(text.startswith("{"), (year - 1970.0) * V.YEAR_S).otherwise(seconds(instant))


def page_time(text: Column) -> tuple[Column, Column]:
    """Seconds and precision of a query page's date, negative years included.

    Years 1 to 9999 are exact days, where 1 January stands for the year; others
    go by the mean year.
    """
    pattern = r"^(-?)(\d+)-(\d+)-(\d+)(?:T.*)?Z?$"
    part = lambda k: F.regexp_extract(text, pattern, k)
    y = F.when(part(1) == "-", -part(2).try_cast("int")).otherwise(part(2).try_cast("int"))
    m, d = part(3).try_cast("int"), part(4).try_cast("int")
    exact = F.unix_seconds(F.try_to_timestamp(F.concat_ws("-", F.lpad(part(2), 4, "0"), part(3), part(4)), F.lit("yyyy-MM-dd"))).cast("double")
    near = y.between(1, 9999)
    approx = (y + ((m - 1) + (d - 1) / 30.0) / 12.0 - 1970.0) * V.YEAR_S
    return F.when(near, exact).otherwise(approx), F.when(~near | ((m == 1) & (d == 1)), "year").otherwise("day")


def page_records(bindings: DataFrame) -> DataFrame:
    """Records of query-result rows ``(ord, item, label, date, coord, links)``.

    Rows without a label of their own or a date are dropped; the first row of an item counts.
    """
    qid = F.element_at(F.split("item", "/"), -1)
    t0, precision = page_time(F.col("date"))
    lon, lat = X.point_wkt(F.col("coord"))
    rows = bindings.select("ord", qid.alias("qid"), "label", t0.alias("t0"), precision.alias("precision"), lon.alias("lon"), lat.alias("lat"), X.importance(F.col("links").cast("double")).alias("importance"))
    good = rows.filter(F.col("t0").isNotNull() & (F.coalesce("label", F.lit("")) != "") & (F.col("label") != F.col("qid")))
    first = good.groupBy("qid").agg(F.min_by(F.struct("label", "t0", "precision", "lon", "lat", "importance"), "ord").alias("r"))
    return first.select("qid", "r.*")


def geojson_slices(spark: SparkSession, path: str, name: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Slices and features of ``<year>.geojson`` files, with the first rule of ``slice_faults`` that a slice breaks as ``fault``.

    A feature's geometry is read by its type into ``polygons``; null where that is neither a polygon nor several.
    """
    schema = "type string, properties struct<year:int,t_from:int,t_to:int,label:string,source:string>, features array<struct<properties:struct<name:string,entity:string,representation:string>,geometry:struct<type:string,coordinates:string>>>"
    raw = spark.read.schema(schema).json(path, multiLine=True).withColumn("file", file_name() if name is None else name)
    slices = slice_faults(raw.select("file", "type", "properties.*", F.size("features").alias("n_features")))
    f = raw.select(F.col("properties.year").alias("year"), F.posexplode("features").alias("pos", "f"))
    return slices, f.select("year", "pos", "f.properties.*", parsed(F.col("f.geometry.type"), F.col("f.geometry.coordinates")).alias("polygons"))
