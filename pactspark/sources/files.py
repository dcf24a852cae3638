"""Files: JSON lines, whole texts, binary files and their listing, reports, an object store, folders that are replaced at once.

Paths are Spark's: every file system that its readers know. Nothing opens a file on the driver.
"""

from __future__ import annotations

import posixpath
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values.
PDF_TYPE, PDF_MAGIC, MOST_BYTES = "application/pdf", b"%PDF", 20 * 1024 * 1024
LISTED_BYTES = (15 * 1024, 180 * 1024)
MOST_LISTED, TYPE_KEY = 14, 18
PAGE_MARK = "===== PAGE {} ====="
# End of the fixed values.


def _fs(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def parse_json(rows: DataFrame, column: str, schema: str, out: str = "parsed") -> DataFrame:
    """Rows whose ``column`` is an object of ``schema``, as ``out``; malformed lines (null, cut off, no JSON, no object) go."""
    corrupt = F.from_json(column, f"{schema}, _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    is_object = F.get_json_object(column, "$").isNotNull() & F.ltrim(column).startswith("{")
    return rows.withColumn(out, F.when(is_object, corrupt)).where(F.col(out).isNotNull() & F.col(f"{out}._corrupt").isNull()).withColumn(out, F.col(out).dropFields("_corrupt"))


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Objects of a file or folder of JSON lines; malformed lines are left out."""
    return parse_json(spark.read.text(path), "value", schema).select("parsed.*")


def write_jsonl(df: DataFrame, path: str, *by: str) -> None:
    """One folder of JSON lines for each value of ``by`` (such as the split); each is written by as many tasks as hold its rows."""
    df.write.mode("overwrite").partitionBy(*by).json(path)


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """(path, page, text) of whole text files; pages are parted by form feeds and numbered from 1."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    return whole.select("path", F.posexplode(F.split("value", "\f", -1)).alias("page", "text")).select("path", (F.col("page") + 1).alias("page"), "text")


def page_dump(pages: DataFrame) -> DataFrame:
    """(path, text): each file's pages in order, each under its mark."""
    mark = F.concat(F.lit(PAGE_MARK.split("{}")[0]), F.col("page").cast("string"), F.lit(PAGE_MARK.split("{}")[1]))
    parts = F.array_sort(F.collect_list(F.struct("page", F.concat(mark, F.lit("\n"), F.trim("text")).alias("text"))))
    return pages.groupBy("path").agg(F.array_join(F.transform(parts, lambda x: x["text"]), "\n").alias("text"))


def list_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(path, size, modified) of the files under a folder; contents aren't read."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    return found.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


def rank_files(files: DataFrame, keywords: list[str], most: int = MOST_LISTED) -> DataFrame:
    """Files (path, size) of medium size by how many keywords their name holds, then the smallest; the first of each type, ``most`` at most.

    A file's type is the last part of its name after an underscore, cut to ``TYPE_KEY`` characters. Equal ones go by path.
    """
    name = F.lower(F.element_at(F.split("path", "/"), -1))
    score = sum((name.contains(k.lower()).cast("int") for k in keywords), F.lit(0))
    kind = F.left(F.element_at(F.split(name, "_"), -1), F.lit(TYPE_KEY))
    scored = files.where(F.col("size").between(*LISTED_BYTES)).withColumns({"score": score, "kind": kind}).where("score > 0")
    order = F.struct((-F.col("score")).alias("minus"), "size", "path")
    firsts = scored.groupBy("kind").agg(F.min(order).alias("x"))
    return firsts.select("x.path", "x.size", (-F.col("x.minus")).alias("score")).orderBy(F.desc("score"), "size", "path").limit(most)


def upload_error(content_type: Column, size: Column, head: Column) -> Column:
    """Why an upload is refused: its declared type, its size, being empty, its first bytes, in this order; null if it is accepted."""
    kind = F.lower(F.trim(F.get(F.split(F.coalesce(content_type, F.lit("")), ";"), 0)))
    magic = F.coalesce(F.hex(F.substring(head, 1, len(PDF_MAGIC))) == PDF_MAGIC.hex().upper(), F.lit(False))
    return F.when(kind != PDF_TYPE, "unsupported type").when(size > MOST_BYTES, "too large").when(F.coalesce(size, F.lit(0)) == 0, "empty").when(~magic, "not a PDF")


def label_names(rows: DataFrame, names: DataFrame, column: str = "label") -> DataFrame:
    """Add ``label_name`` from names (label, name); unknown and null labels give null. Spark broadcasts the names if they are small."""
    return rows.join(names.select(F.col("label").alias(column), F.col("name").alias("label_name")), column, "left")


def write_report(lines: DataFrame, path: str) -> None:
    """A text report from (place, line): one file, its lines in order. A report is a summary; its lines pass one task."""
    lines.orderBy("place").select(F.coalesce("line", F.lit("")).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def replace_folder(df: DataFrame, path: str) -> None:
    """Write ``df`` as Parquet beside ``path`` and swap it in: readers see the old rows or the new ones, never a part. ``df`` may read ``path``."""
    spark = df.sparkSession
    staging, old = f"{path}.staging-{uuid.uuid4().hex}", f"{path}.old-{uuid.uuid4().hex}"
    df.write.parquet(staging)
    fs, target = _fs(spark, path)
    Path = spark._jvm.org.apache.hadoop.fs.Path
    if fs.exists(target):
        fs.rename(target, Path(old))
    fs.rename(Path(staging), target)
    fs.delete(Path(old), True)


class ObjectStore:
    """Objects under a root folder, by keys that can't leave it. Reads and writes go through Spark's file systems."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def url(self, key: str) -> str:
        """The object's path; ValueError for an empty key and for one that leaves the root."""
        if not key or not key.strip():
            raise ValueError("the key is empty")
        parts = posixpath.normpath(key.replace("\\", "/").lstrip("/"))
        if parts == ".." or parts.startswith("../"):
            raise ValueError(f"the key leaves the root: {key!r}")
        return self.root if parts == "." else f"{self.root}/{parts}"

    def put(self, key: str, content: bytes) -> str:
        """Store an object, replacing an older one."""
        fs, target = _fs(self.spark, self.url(key))
        out = fs.create(target, True)
        try:
            out.write(bytearray(content))
        finally:
            out.close()
        return self.url(key)

    def get(self, key: str) -> bytes:
        """An object's content; KeyError without one."""
        if not self.exists(key):
            raise KeyError(key)
        row = self.spark.read.format("binaryFile").load(self.url(key)).select("content").first()
        return bytes(row.content) if row else b""  # the reader skips empty files

    def exists(self, key: str) -> bool:
        fs, target = _fs(self.spark, self.url(key))
        return fs.exists(target)

    def delete(self, key: str) -> bool:
        """Whether there was an object to delete."""
        fs, target = _fs(self.spark, self.url(key))
        return fs.exists(target) and fs.delete(target, False)
