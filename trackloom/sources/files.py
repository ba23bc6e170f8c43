"""Annotation and detection file formats, read and written by Spark alone."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DETECTIONS = "seq string, frame int, detections array<struct<bbox:array<double>,class:string,confidence:double,state:string>>"


def read_detections_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines, one object per frame: seq, frame, det_ord (place in the line), box, cls, conf, state."""
    rows = spark.read.schema(DETECTIONS).json(path)
    each = rows.select("seq", "frame", F.posexplode("detections").alias("det_ord", "d"))
    return each.select("seq", "frame", "det_ord", *(F.col("d.bbox")[i].alias(c) for i, c in enumerate(("x1", "y1", "x2", "y2"))), F.col("d.class").alias("cls"), F.col("d.confidence").alias("conf"), "d.state")


_MOT = "frame int, id long, x double, y double, w double, h double, conf double, cls int, visibility double"


def read_mot(spark: SparkSession, path: str) -> DataFrame:
    """MOTChallenge CSV (1-based frames): seq (from a folder seq=… if there is one), frame (0-based), track_id, box, conf, cls, visibility."""
    rows = spark.read.schema(_MOT).csv(path).select("*", F.regexp_extract(F.col("_metadata.file_path"), "seq=([^/]+)", 1).alias("seq"))
    return rows.select("seq", (F.col("frame") - 1).alias("frame"), F.col("id").alias("track_id"), F.col("x").alias("x1"), F.col("y").alias("y1"), (F.col("x") + F.col("w")).alias("x2"), (F.col("y") + F.col("h")).alias("y2"), "conf", "cls", "visibility")


def write_mot(tracks: DataFrame, path: str) -> None:
    """tracks (seq, frame, track_id, box) as MOTChallenge CSV in a folder for each sequence, with two decimals, in frame order."""
    two = lambda c: F.format_string("%.2f", c)
    rows = tracks.select("seq", (F.col("frame") + 1).alias("frame"), "track_id", two(F.col("x1")), two(F.col("y1")), two(F.col("x2") - F.col("x1")), two(F.col("y2") - F.col("y1")), F.lit(1).alias("c"), F.lit(1).alias("k"), F.lit(1).alias("v"))
    rows.repartition("seq").sortWithinPartitions("seq", "frame", "track_id").write.partitionBy("seq").csv(path)


def read_yolo_labels(spark: SparkSession, path: str) -> DataFrame:
    """Label text files, boxes or polygons: image (file name without extension), line, cls_id, cx, cy, w, h, polygon (bool), problem."""
    rows = spark.read.text(path).select(F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)\.txt$", 1).alias("image"), F.trim("value").alias("line")).where("line <> ''")
    n = rows.withColumn("v", F.transform(F.slice(F.split("line", r"\s+"), 2, 10_000), lambda x: x.try_cast("double"))).withColumn("cls_id", F.split("line", r"\s+")[0].try_cast("int"))
    poly = F.size("v") > 4
    xs, ys = F.filter("v", lambda _, i: i % 2 == 0), F.filter("v", lambda _, i: i % 2 == 1)
    bad = F.col("cls_id").isNull() | F.exists("v", lambda x: x.isNull()) | (F.size("v") < 4) | (poly & (F.size("v") % 2 == 1))
    pick = lambda box, of: F.when(~bad, F.when(poly, of).otherwise(box))
    return n.select(
        "image", "line", "cls_id", pick(F.get("v", F.lit(0)), (F.array_min(xs) + F.array_max(xs)) / 2).alias("cx"), pick(F.get("v", F.lit(1)), (F.array_min(ys) + F.array_max(ys)) / 2).alias("cy"),
        pick(F.get("v", F.lit(2)), F.array_max(xs) - F.array_min(xs)).alias("w"), pick(F.get("v", F.lit(3)), F.array_max(ys) - F.array_min(ys)).alias("h"), poly.alias("polygon"), F.when(bad, "malformed").alias("problem"),
    )


_COCO = "images array<struct<id:long,file_name:string,width:int,height:int>>, annotations array<struct<id:long,image_id:long,category_id:long,bbox:array<double>>>, categories array<struct<id:long,name:string>>"


def read_coco(spark: SparkSession, path: str) -> DataFrame:
    """COCO documents: file_name, width, height, ann_id, cls, box; images without annotations have one row with nulls."""
    doc = spark.read.schema(_COCO).option("multiLine", True).json(path).withColumn("doc", F.col("_metadata.file_path"))
    images = doc.select("doc", F.explode("images").alias("i")).select("doc", F.col("i.id").alias("image_id"), "i.file_name", "i.width", "i.height")
    names = doc.select("doc", F.explode("categories").alias("c")).select("doc", F.col("c.id").alias("category_id"), F.col("c.name").alias("cls"))
    anns = doc.select("doc", F.explode("annotations").alias("a")).select("doc", F.col("a.id").alias("ann_id"), "a.image_id", "a.category_id", *(F.col("a.bbox")[i].alias(c) for i, c in enumerate("xywh")))
    rows = images.join(anns.join(names, ["doc", "category_id"], "left"), ["doc", "image_id"], "left")
    return rows.select("file_name", "width", "height", "ann_id", "cls", F.col("x").alias("x1"), F.col("y").alias("y1"), (F.col("x") + F.col("w")).alias("x2"), (F.col("y") + F.col("h")).alias("y2"))


_CVAT = "_id long, _label string, box array<struct<_frame:int,_xtl:double,_ytl:double,_xbr:double,_ybr:double,_outside:int,_occluded:int>>"


def read_cvat_tracks(spark: SparkSession, path: str) -> DataFrame:
    """CVAT-for-video XML: track_id, cls, frame, box, outside, occluded of every keyframe."""
    rows = spark.read.format("xml").option("rowTag", "track").schema(_CVAT).load(path).select(F.col("_id").alias("track_id"), F.col("_label").alias("cls"), F.explode("box").alias("b"))
    return rows.select("track_id", "cls", F.col("b._frame").alias("frame"), F.col("b._xtl").alias("x1"), F.col("b._ytl").alias("y1"), F.col("b._xbr").alias("x2"), F.col("b._ybr").alias("y2"), (F.col("b._outside") == 1).alias("outside"), (F.col("b._occluded") == 1).alias("occluded"))


def read_decisions(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """A decision log as JSON lines with line_no; a missing mode is "candidates"."""
    reader = spark.readStream if stream else spark.read
    rows = reader.schema("line_no long, box_id string, mode string, value string, recorded_utc timestamp").json(path)
    return rows.withColumn("mode", F.coalesce("mode", F.lit("candidates")))


def scan_annotations(annotations: DataFrame, every: int, order: list[str], attributes: str) -> tuple[DataFrame, DataFrame]:
    """Every n-th row in a total order, and over all rows how often each key of a map column occurs with a value."""
    from pyspark.sql import Window

    sampled = annotations.withColumn("rn", F.row_number().over(Window.partitionBy(order[0]).orderBy(*order[1:]))).where((F.col("rn") - 1) % every == 0).drop("rn")
    census = annotations.select(F.explode(attributes).alias("key", "value")).groupBy("key").agg(F.count(F.lit(1)).alias("rows"), F.count("value").alias("values"))
    return sampled, census


def manifest(images: DataFrame) -> DataFrame:
    """source, images, share of all images."""
    from pyspark.sql import Window

    n = images.groupBy("source").agg(F.count(F.lit(1)).alias("images"))
    return n.withColumn("share", F.col("images") / F.sum("images").over(Window.partitionBy(F.lit(0))))


def write_manifest(images: DataFrame, path: str) -> None:
    """The images as JSON, and their counts and shares by source as CSV."""
    images.write.json(f"{path}/images")
    manifest(images).write.option("header", True).csv(f"{path}/sources")


def run_key(config: dict) -> str:
    """A name for all settings that decide a result."""
    return hashlib.sha256(json.dumps(config, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def materialize(df: DataFrame, path: str, config: dict) -> DataFrame:
    """df under path/run_key=…: read back if a run with exactly these settings wrote it, else written."""
    spark, key = df.sparkSession, run_key(config)
    there = f"{path}/run_key={key}"
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{there}/_SUCCESS")
    if not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        df.write.mode("overwrite").parquet(there)
    return spark.read.schema(df.schema).parquet(there)


def write_report(stats: DataFrame, path: str) -> None:
    """Per-track statistics as JSON lines."""
    stats.write.json(path)
