"""Files in and out: directory scans, imports, uploads, logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmesh.functions.text import key_of, mapped, norm_key_full, redact_log
from quillmesh.sources.convert import CONVERTERS, convert_files, decode

MOST_BYTES = 50 << 20


def path_identity(path: str) -> str:
    """What two spellings of a path share: composed and folded, without slashes at its ends."""
    return key_of(path.replace("\\", "/")).strip("/")


def scan_directory(spark: SparkSession, root: str, most: int = 1000) -> DataFrame:
    """``relative_path, path_hash, content_hash, text`` of Markdown files under ``root``; too many or clashing ones raise."""
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.[mM][dD]").load(root)
    )
    root_literal = root.rstrip("/").split(":", 1)[-1].lstrip("/") + "/"
    relative = F.expr(f"substring_index(path, {root_literal!r}, -1)")
    text = mapped(lambda b: decode(bytes(b)))
    found = files.select(relative.alias("relative_path"), F.sha2("content", 256).alias("content_hash"), text(F.col("content")).alias("text"))
    found = found.withColumn("path_hash", F.sha2(norm_key_full(F.col("relative_path")), 256))
    names = files.select(relative.alias("relative_path"))
    count = names.count()
    if count > most:
        raise ValueError(f"{count} files are more than {most}")
    clash = names.groupBy(norm_key_full(F.col("relative_path")).alias("k")).count().filter("count > 1")
    if not clash.isEmpty():
        raise ValueError(f"paths clash: {clash.first()['k']}")
    return found.select("relative_path", "path_hash", "content_hash", "text").orderBy(F.lower("relative_path"))


def import_files(spark: SparkSession, paths: str | list[str], most_bytes: int = MOST_BYTES) -> DataFrame:
    """``path, markdown, error`` of files in any supported format; kinds and sizes that aren't allowed are errors."""
    files = spark.read.format("binaryFile").load(paths)
    suffix = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1))
    refused = F.when(~suffix.isin(*CONVERTERS), F.concat(F.lit("kind "), suffix)).when(F.col("length") > most_bytes, F.lit("size"))
    marked = files.withColumn("why", refused)
    bad = marked.filter("why IS NOT NULL").select("path", F.lit(None).cast("string").alias("markdown"), F.concat(F.lit("refused: "), "why").alias("error"))
    return convert_files(marked.filter("why IS NULL")).unionByName(bad)


def upload(files: DataFrame, new: DataFrame) -> DataFrame:
    """Files with new ``relative_path, text``; a path that exists raises."""
    taken = new.join(files.select("relative_path"), "relative_path", "left_semi")
    if not taken.isEmpty():
        raise ValueError(f"{taken.first()['relative_path']} exists")
    return files.select("relative_path", "text").unionByName(new.select("relative_path", "text"))


LEVELS = {"DEBUG": 10, "INFO": 20, "WARNING": 30, "ERROR": 40}


def write_log(lines: DataFrame, path: str, least: str = "INFO") -> None:
    """Append ``ts, level, message`` as tab-separated files by day, redacted, from a level up."""
    rank = F.lit(0)
    for name, value in LEVELS.items():
        rank = F.when(F.upper("level") == name, value).otherwise(rank)
    kept = lines.filter(rank >= LEVELS[least]).select(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("at"), F.upper("level").alias("level"), redact_log(F.col("message")).alias("message"), F.to_date("ts").alias("day"))
    kept.write.mode("append").partitionBy("day").option("sep", "\t").csv(path)
