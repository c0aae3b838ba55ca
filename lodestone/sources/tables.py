"""Readers and writers of tables and dumps."""

from __future__ import annotations

import gzip
import re
import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.functions import text as tx


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; one of our own only where all runs on one machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "/tmp/lodestone-checkpoints"
    return folder.rstrip("/")


def settled(df: DataFrame) -> DataFrame:
    """`df` written to the shared folder and read again: iterations go on from a table, not from a growing plan."""
    path = f"{shared_folder(df.sparkSession)}/step-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Delete what `settled` wrote, once no frame that is still needed reads it."""
    spark = df.sparkSession
    for file in df.inputFiles()[:1]:
        path = spark._jvm.org.apache.hadoop.fs.Path(file).getParent()
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def read_wiki_dump(spark: SparkSession, path: str) -> DataFrame:
    """Pages of an XML dump: id, title, ns, redirect, text, format. Compressed dumps are read as they are."""
    schema = "id BIGINT, title STRING, ns INT, redirect STRUCT<_title: STRING>, revision STRUCT<text: STRUCT<_VALUE: STRING>, format: STRING>"
    pages = spark.read.format("xml").option("rowTag", "page").schema(schema).load(path)
    return pages.select("id", "title", "ns", F.col("redirect._title").alias("redirect"), F.col("revision.text._VALUE").alias("text"), F.col("revision.format").alias("format"))


def write_table(df: DataFrame, path: str, *, kind: str = "parquet", by: list[str] | None = None) -> None:
    """Write as parquet, orc, json or csv, partitioned by columns where given."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*by) if by else writer).format(kind).option("header", "true").save(path)


def write_bucketed(df: DataFrame, name: str, key: str, buckets: int) -> None:
    """A table whose later joins and aggregates on `key` need no shuffle."""
    df.write.mode("overwrite").bucketBy(buckets, key).sortBy(key).saveAsTable(name)


def write_gml(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """A graph in GML: nodes (id, label), edges (src, dst)."""
    lines = nodes.select(F.lit(1).alias("k"), F.format_string('  node [ id %d label "%s" ]', "id", "label").alias("value"))
    lines = lines.unionByName(edges.select(F.lit(2).alias("k"), F.format_string("  edge [ source %d target %d ]", "src", "dst").alias("value")))
    spark = nodes.sparkSession
    ends = spark.createDataFrame([(0, "graph ["), (3, "]")], "k int, value string")
    lines.unionByName(ends).orderBy("k").select("value").write.mode("overwrite").text(path)


def read_csv(spark: SparkSession, path: str, schema: str | None = None, delimiter: str = ",", quote: str = '"', escape: str = '"', header: bool = True) -> DataFrame:
    """Delimited text by RFC 4180, with other delimiters, qualifiers and escapes as given; line breaks in quotes are read."""
    reader = spark.read.option("sep", delimiter).option("quote", quote).option("escape", escape).option("header", header).option("multiLine", True)
    return (reader.schema(schema) if schema else reader).csv(path)


def write_csv(df: DataFrame, path: str, delimiter: str = ",", quote: str = '"', escape: str = '"', header: bool = True) -> None:
    df.write.mode("overwrite").option("sep", delimiter).option("quote", quote).option("escape", escape).option("header", header).csv(path)


def write_lines(df: DataFrame, path: str, separator: str = "\t") -> None:
    """Rows as lines of text, columns by the separator, arrays spread out."""
    parts = [F.concat_ws(separator, c) if t.startswith("array") else F.col(c).cast("string") for c, t in df.dtypes]
    df.select(F.concat_ws(separator, *parts).alias("value")).write.mode("overwrite").text(path)


def write_split(df: DataFrame, path: str, kind: str = "kind") -> None:
    """A folder for each value of a column: articles and categories apart."""
    df.write.mode("overwrite").partitionBy(kind).parquet(path)


def link_json(links: DataFrame) -> DataFrame:
    """(src, value): a page's links as one JSON object, in order."""
    each = links.groupBy("src").agg(F.array_sort(F.collect_list(F.struct("dst", "freq"))).alias("links"))
    return each.select("src", F.to_json(F.struct("src", "links")).alias("value"))


def neighbours_json(names: DataFrame, links: DataFrame, node: int) -> DataFrame:
    """One row of JSON: a node, its neighbours and theirs, each of size 10 * (links in and out)."""
    ends = links.select(F.col("src").alias("id")).unionByName(links.select(F.col("dst").alias("id")))
    size = names.join(ends.groupBy("id").agg((F.count("*") * 10).alias("size")), "id", "left").select("id", "name", F.coalesce("size", F.lit(0)).alias("size"))
    near = links.filter(F.col("src") == node).select(F.col("dst").alias("id")).distinct()
    far = links.join(near.withColumnRenamed("id", "src"), "src", "left_semi").select("src", F.col("dst").alias("id")).distinct()
    below = far.join(size, "id").groupBy("src").agg(F.array_sort(F.collect_list(F.struct("id", "name", "size"))).alias("children"))
    level = near.join(size, "id").join(below.withColumnRenamed("src", "id"), "id", "left")
    children = level.agg(F.array_sort(F.collect_list(F.struct("id", "name", "size", "children"))).alias("children"))
    return size.filter(F.col("id") == node).crossJoin(children).select(F.to_json(F.struct("id", "name", "size", "children")).alias("value"))  # one row


def read_sql_dump(spark: SparkSession, path: str, value: str) -> DataFrame:
    """(from_id, lang, title) of the insert lines of a language-link dump, the rows of one language."""
    lines = spark.read.text(path).filter(F.col("value").contains("VALUES") & F.col("value").contains(f",'{value}',"))
    found = lines.select(F.explode(F.regexp_extract_all("value", F.lit(r"(\((\d+),'([^']*)','((?:[^'\\]|\\.|'')*)'\))"), F.lit(1))).alias("t"))
    part = lambda k: F.regexp_extract("t", r"\((\d+),'([^']*)','((?:[^'\\]|\\.|'')*)'\)", k)
    rows = found.select(part(1).cast("long").alias("from_id"), part(2).alias("lang"), F.regexp_replace(part(3), r"\\(.)|'(')", "$1$2").alias("title"))
    return rows.filter(F.col("lang") == value)


def sampled_pages(pages: DataFrame, per_mille: int, known: DataFrame, seed: int = 1, least: int = 50) -> DataFrame:
    """(id, title, text) of pages drawn by a hash of id and seed, not known by title, with a plain text of `least` characters."""
    drawn = pages.filter(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1000)) < per_mille)
    fresh = drawn.join(known.select("title"), "title", "left_anti")
    return fresh.withColumn("text", tx.plain_text(F.col("text"))).filter(F.length("text") >= least).select("id", "title", "text")


def write_xml(df: DataFrame, path: str, root: str = "pages", row: str = "page") -> None:
    df.write.mode("overwrite").format("xml").option("rootTag", root).option("rowTag", row).save(path)


def category_rows(pages: DataFrame) -> DataFrame:
    """(id, title, category): a row for each category of an article or common category; ROOT for a category without one;
    redirects and articles without one are left out."""
    found = pages.filter("redirect is null").select("id", "ns", "title", F.explode_outer(tx.categories(F.col("text"))).alias("category"))
    return found.filter("category is not null or ns = 14").select("id", "title", F.coalesce("category", F.lit("ROOT")).alias("category"))


def anchors(pages: DataFrame) -> DataFrame:
    """(id, target, label) of links whose label is another text than their target."""
    found = F.regexp_extract_all("text", F.lit(r"(\[\[[^\]|:#]+\|[^\]]+\]\])"), F.lit(1))
    rows = pages.select("id", F.explode(found).alias("l"))
    part = lambda k: F.trim(F.regexp_extract("l", r"\[\[([^\]|:#]+)\|([^\]]+)\]\]", k))
    return rows.select("id", part(1).alias("target"), part(2).alias("label")).filter("target <> label")


def traverse(df: DataFrame, *sinks) -> None:
    """One scan, every sink sees every row: the frame is read once and kept until all sinks are done."""
    held = df.persist()
    try:
        for sink in sinks:
            sink(held)
    finally:
        held.unpersist()


@F.pandas_udf(T.BinaryType())
def gzipped(text: pd.Series) -> pd.Series:
    """Strings as gzip bytes, the same on every run; null stays null."""
    return text.map(lambda x: None if x is None else gzip.compress(x.encode(), mtime=0))


@F.pandas_udf(T.StringType())
def gunzipped(data: pd.Series) -> pd.Series:
    return data.map(lambda x: None if x is None else gzip.decompress(bytes(x)).decode())
