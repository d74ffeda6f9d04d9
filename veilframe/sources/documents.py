"""Text documents in and out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe.functions import fixed_values as fv
from veilframe.operators.names import output_file_name


def format_of(name: Column) -> Column:
    """The format a file name stands for, or null."""
    ext = F.lower(F.substring_index(name, ".", -1))
    table = F.create_map(*[F.lit(x) for pair in fv.FORMAT_BY_EXTENSION.items() for x in pair])
    return F.try_element_at(table, ext)


def judged(files: DataFrame, name: str = "file_name", size: str = "bytes") -> DataFrame:
    """Add ``format`` and the reason a file is refused (``unsupported``, ``too_large``), or null."""
    reason = F.when(F.col("format").isNull(), "unsupported").when(F.col(size) > fv.MAX_FILE_BYTES, "too_large")
    return files.withColumn("format", format_of(F.col(name))).withColumn("refused", reason)


def read_text_files(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Plain-text and Markdown files as documents; gives (documents, refused files).

    One file is one document. Refused files are told by their metadata alone;
    the size is a filter of the scan, so content is only read below the limit.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    name = F.substring_index("path", "/", -1).alias("file_name")
    listed = files.select(F.col("path").alias("doc_id"), name, F.col("length").alias("bytes"))
    refused = judged(listed).where("refused is not null or format not in ('txt', 'md')").select(
        "doc_id", "file_name", "bytes", F.coalesce("refused", F.lit("not_text")).alias("refused"))
    small = files.where(F.col("length") <= fv.MAX_FILE_BYTES).select("path", name, "content")
    docs = small.withColumn("format", format_of(F.col("file_name"))).where("format in ('txt', 'md')").select(
        F.col("path").alias("doc_id"), "file_name", "format", F.decode("content", "UTF-8").alias("text"))
    return docs, refused


def pasted(spark: SparkSession, text: str, doc_id: str = "pasted") -> DataFrame:
    """A pasted text as a document."""
    return spark.createDataFrame([(doc_id, fv.PASTED_NAME, "txt", text)],
                                 "doc_id string, file_name string, format string, text string")


def as_documents(table: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Any table with a text column as documents (reads only the two columns)."""
    return table.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))


def too_large(docs: DataFrame, text: str = "text", limit: int = fv.MAX_FILE_BYTES) -> Column:
    """Whether a text is larger than the size a document may have."""
    return F.octet_length(F.col(text)) > limit


def write_documents(docs: DataFrame, path: str, suffix: str = "deid", text: str = "redacted") -> None:
    """Write results as a table, one folder per format, with the output file name of each document."""
    docs.select("doc_id", output_file_name(F.col("file_name"), suffix).alias("file_name"), "format",
                F.col(text).alias("text")).write.partitionBy("format").parquet(path)
