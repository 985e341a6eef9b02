"""Reading page extracts and files, writing snapshots, exports and audits. Schemas are given, never inferred."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PAGE = "array<struct<pageNumber:int,text:string,usedOcr:boolean>>"
IMAGES = ("question_image", "page_image", "figure_image")


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: that of spark.checkpoint.dir, or of the context. A fresh local one only
    in local mode; on a cluster, where executors could not read it, an error."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not named:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="spark-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(named)
    return named.rstrip("/")


def fresh_dir(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has used."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """df kept in the shared folder, with a plan of one scan."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def read_page_extracts(spark: SparkSession, path: str) -> DataFrame:
    """pages(set_id, kind, page_number, text, used_ocr) from one JSON file per booklet, {"q": [page…]} or {"a": [page…]}. The
    set is the leading number of the file's name, or of its folder's where that says `name=…`, else the name."""
    raw = spark.read.schema(f"q {PAGE}, a {PAGE}, name string").json(path, multiLine=True)
    raw = raw.withColumn("name", F.coalesce("name", F.regexp_replace(file_name(F.input_file_name()), "%20", " ")))
    base = F.regexp_replace("name", r"(?i)\.json$", "")
    rows = raw.withColumn("set_id", F.coalesce(F.nullif(F.regexp_extract(base, r"^(\d+)", 1), F.lit("")), base))
    one = lambda kind: rows.select("set_id", F.lit(kind).alias("kind"), F.explode(kind).alias("p"))
    return one("q").unionByName(one("a")).select("set_id", "kind", F.col("p.pageNumber").alias("page_number"), F.col("p.text").alias("text"), F.col("p.usedOcr").alias("used_ocr"))


def read_file_meta(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """files(name, path, size): listing only, contents are never loaded."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).select(file_name(F.col("path")).alias("name"), "path", F.col("length").alias("size"))


def lean(items: DataFrame) -> DataFrame:
    return items.drop(*IMAGES)


def write_snapshot(items: DataFrame, path: str) -> None:
    """Items without image columns, as JSON lines."""
    lean(items).write.mode("overwrite").json(path)


def read_snapshot(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).json(path)


def write_notes(notes: DataFrame, path: str) -> None:
    notes.write.mode("overwrite").option("header", True).option("quoteAll", True).option("escape", '"').csv(path)


def write_issues(issues: DataFrame, path: str) -> None:
    issues.write.mode("overwrite").partitionBy("set_id").json(path)
