"""Files around videos as DataFrames: run settings, parts of a video, subtitles with clock times, annotated shapes, video graphs."""
from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def merged_settings(own: DataFrame, base: DataFrame) -> DataFrame:
    """key, value of both; own wins."""
    both = own.select("key", "value", F.lit(0).alias("o")).unionByName(base.select("key", "value", F.lit(1).alias("o")))
    return both.groupBy("key").agg(F.min_by("value", "o").alias("value"))


def settings(spark: SparkSession, path: str, inlined: tuple[str, ...] = ("detection", "tracking")) -> dict:
    """A run's settings: one JSON file, over its `base` if it names one, with the files that the inlined keys name in their place.

    Settings are a parameter of the driver's; paths are relative to the file. A file that has a base keeps the names of the inlined keys; keys with an object in its place keep it.
    """
    read = lambda p: json.loads(spark.read.text(p, wholetext=True).first()[0].removeprefix("\ufeff"))
    beside = lambda name: name if name.startswith("/") or "://" in name else f"{path.rpartition('/')[0]}/{name}"
    own = read(path)
    if "base" in own:
        out = read(beside(own["base"])) | own
        out.pop("base")
        return out
    return own | {k: read(beside(own[k])) for k in inlined if isinstance(own.get(k), str)}


def many_video_settings(spark: SparkSession, paths: list[str]) -> DataFrame:
    """path and key, value (as JSON text) of plain settings files; a nested value stays as it is."""
    rows = spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.regexp_replace("value", "^\ufeff", "").alias("text"))
    return rows.select("path", F.explode(F.from_json("text", "map<string,string>")).alias("key", "value"))


def part_paths(sources: DataFrame) -> DataFrame:
    """video_id, part_no, path: `{0}` in template is the part's number, from 1 to parts. sources: video_id, template, parts."""
    each = sources.withColumn("part_no", F.explode(F.sequence(F.lit(1), "parts")))
    return each.select("video_id", "part_no", F.replace("template", F.lit("{0}"), F.col("part_no").cast("string")).alias("path"))


def part_spans(parts: DataFrame) -> DataFrame:
    """parts (video_id, part_no, frames, fps) with before (frames of earlier parts), total, and changed (another rate than the part before)."""
    w = Window.partitionBy("video_id").orderBy("part_no")
    before = F.coalesce(F.sum("frames").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    changed = F.coalesce(F.lag("fps").over(w) != F.col("fps"), F.lit(False))
    return parts.withColumns({"before": before, "changed": changed, "total": F.sum("frames").over(Window.partitionBy("video_id"))})


def sought(spans: DataFrame, seeks: DataFrame) -> DataFrame:
    """video_id, seconds, part_no, frame (of the part, from 0): where a seek from the video's start lands, by the rate of its first part. Seeks past the end have no row.

    spans: from part_spans(); seeks: video_id, seconds. Parts of a video are few, so the join is on the video.
    """
    first = spans.groupBy("video_id").agg(F.min_by("fps", "part_no").alias("_fps"))
    at = seeks.join(first, "video_id").withColumn("_at", F.floor(F.col("seconds") * F.col("_fps")))
    both = at.join(spans, "video_id").filter((F.col("_at") >= F.col("before")) & (F.col("_at") < F.col("before") + F.col("frames")))
    return both.select("video_id", "seconds", "part_no", (F.col("_at") - F.col("before")).cast("long").alias("frame"))


def frames_of(spans: DataFrame, head: Column, tail: Column, gap: Column) -> DataFrame:
    """video_id, part_no, frame_index (over the whole video), frame (of its part): every gap-th frame, without the video's first `head` and last `tail`."""
    rows = spans.withColumn("frame", F.explode(F.sequence(F.lit(0), F.col("frames").cast("int") - 1))).withColumn("frame_index", F.col("before") + F.col("frame"))
    kept = (F.col("frame_index") >= head) & (F.col("frame_index") < F.col("total") - tail) & (F.col("frame_index") % gap == 0)
    return rows.filter(kept).select("video_id", "part_no", "frame_index", "frame")


def image_frames(spark: SparkSession, folder: str) -> DataFrame:
    """path, frame_index, content of a folder of single frames whose names end in their number."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return rows.select("path", F.regexp_extract("path", r"(\d+)\.[^./]+$", 1).try_cast("long").alias("frame_index"), "content").filter("frame_index is not null")


def clock_ms(text: Column) -> Column:
    """`yyyy-MM-dd HH:mm:ss,mmm,uuu` in UTC as milliseconds since 1970; null for anything else."""
    n = lambda i, k: F.substring(text, i, k).try_cast("long")
    days = F.datediff(F.substring(text, 1, 10).try_cast("date"), F.lit("1970-01-01").cast("date")).cast("long")
    return ((days * 24 + n(12, 2)) * 60 + n(15, 2)) * 60000 + n(18, 2) * 1000 + n(21, 3)


def offset_ms(unix_ms: Column, frames: Column, fps: Column) -> Column:
    """A clock moved by so many frames."""
    return unix_ms + frames * (1000 / fps)


def subtitles(spark: SparkSession, paths: list[str]) -> DataFrame:
    """path, place, block, unix_ms of subtitle files: blocks parted by empty lines, the clock in the last line of each.

    place is the block's order in its file from 0; block its own number and unix_ms its clock, null where there is none. A byte order mark is dropped.
    """
    plain = F.trim(F.regexp_replace("value", "[\r\ufeff]", ""))
    files = spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.posexplode(F.split(plain, "\n\n+")).alias("place", "text")).filter("text <> ''")
    clock = F.regexp_extract("text", r"(\d{4}-\d\d-\d\d \d\d:\d\d:\d\d,\d{3},\d{3})", 1)
    return files.select("path", "place", F.trim(F.get(F.split("text", "\n"), F.lit(0))).try_cast("int").alias("block"), clock_ms(clock).alias("unix_ms"))


def video_clock(spark: SparkSession, parts: DataFrame) -> DataFrame:
    """video_id, frame_index, unix_ms: the clocks of a video's parts one after another, frames from 0.

    parts: video_id, part_no, path (a subtitle file). If a file of any part is missing its video has no clock: no rows.
    """
    paths = [r.path for r in parts.select("path").distinct().collect()]  # one a part of a video: settings, not data
    from py4j.protocol import Py4JJavaError

    def there(path: str) -> bool:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        try:
            return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)
        except Py4JJavaError:
            return False

    found = {p for p in paths if there(p)}
    if not found:
        return spark.createDataFrame([], "video_id string, frame_index long, unix_ms long")
    whole = parts.withColumn("_there", F.col("path").isin(*found)).groupBy("video_id").agg(F.bool_and("_there").alias("_all")).filter("_all").select("video_id")
    plain = F.regexp_replace(F.col("path"), "^file:/*", "/")
    rows = subtitles(spark, sorted(found)).withColumn("path", F.regexp_replace("path", "^file:/*", "/"))
    rows = parts.withColumn("path", plain).join(whole, "video_id").join(rows, "path")
    order = Window.partitionBy("video_id").orderBy("part_no", "place")
    return rows.select("video_id", (F.row_number().over(order) - 1).cast("long").alias("frame_index"), "unix_ms")


def shapes(spark: SparkSession, paths: list[str]) -> DataFrame:
    """path, shape_no, label, kind, points of annotation files. kind is the label's part before its first underscore."""
    schema = "shapes array<struct<label:string,points:array<array<double>>>>"
    rows = spark.read.schema(schema).json(paths, multiLine=True).select(F.col("_metadata.file_path").alias("path"), F.posexplode("shapes").alias("shape_no", "s"))
    places = F.transform("s.points", lambda p: F.struct(p[0].alias("x"), p[1].alias("y")))
    return rows.select("path", "shape_no", "s.label", F.substring_index("s.label", "_", 1).alias("kind"), places.alias("points"))


def video_graph(spark: SparkSession, paths: list[str]) -> DataFrame:
    """src, dst of lines `from,to`; blank lines go, repeated edges count once."""
    rows = spark.read.text(paths).filter(F.trim("value") != "")
    part = F.split("value", ",")
    return rows.select(F.trim(part[0]).alias("src"), F.trim(part[1]).alias("dst")).distinct()


def trajectories(spark: SparkSession, path: str, videos: list[str] | None = None) -> DataFrame:
    """What sinks.write_detections() or a like writer left, a folder a video: of the named videos alone, whose folders alone are read."""
    rows = spark.read.parquet(path)
    return rows if videos is None else rows.filter(F.col("video_id").isin(*videos))
