"""The row-local steps on streams.

Detection, redaction and per-document codes look at one row only, so they run
unchanged on a streaming DataFrame in append mode, without state or watermark.
Codes shared between documents continue from the table of the batches before.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe.functions.retention import Retention
from veilframe.operators.codes import code_shared
from veilframe.operators.detect import detect
from veilframe.operators.redact import MAPPING_COLUMNS, mapping_shared, redact
from veilframe.operators.rules import Rule
from veilframe.plans.pipelines import deidentify
from veilframe.session import materialize


def _earlier(spark: SparkSession, path: str, batch_id: int) -> DataFrame | None:
    """The mapping rows of the batches before, or None where there is no table yet."""
    try:
        table = spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None
    rows = table.where(F.col("batch") < batch_id).drop("batch").withColumn("line_no", F.monotonically_increasing_id())
    return None if rows.isEmpty() else rows


def deidentify_stream(docs: DataFrame, key: str = "doc_id", rules: Iterable[Rule] | None = None, style: str = "label",
                      mode: str = "hide", overrides: dict[str, Retention] | None = None, secret: str | None = None,
                      text: str = "text") -> DataFrame:
    """A stream of documents with items and redacted text (any style; codes per document)."""
    return deidentify(docs, key, rules, style, mode, overrides, secret, text)


def redact_new_files(spark: SparkSession, source: str, folder: str, schema: str, key: str = "doc_id",
                     rules: Iterable[Rule] | None = None, style: str = "label", mode: str = "hide",
                     overrides: dict[str, Retention] | None = None, secret: str | None = None, text: str = "text",
                     files: int = 1000) -> DataFrame:
    """Redact the Parquet files of ``source`` that earlier calls with this ``folder`` haven't seen; gives all results so far.

    What is there is worked off in batches of ``files`` files, then the call
    ends. ``folder/checkpoint`` holds what was read, and the log of
    ``folder/documents`` which output counts, so a call that follows a failed
    one goes on with the batch that failed, and every row of ``source`` has one
    row in the result (``key``, ``redacted``). ``key`` isn't looked at: rows that
    repeat are all returned. A null text has a null result.
    """
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(source)
    done = deidentify_stream(stream, key, rules, style, mode, overrides, secret, text).select(key, "redacted")
    done.writeStream.format("parquet").outputMode("append").trigger(availableNow=True).option(
        "checkpointLocation", f"{folder}/checkpoint").start(f"{folder}/documents").awaitTermination()
    return spark.read.schema(done.schema).parquet(f"{folder}/documents")


def continuing_batches(folder: str, secret: str, key: str = "doc_id", rules: Iterable[Rule] | None = None,
                       mode: str = "hide", text: str = "text") -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function whose codes continue from batch to batch.

    Batch n writes ``mapping/batch=n`` and ``documents/batch=n`` under
    ``folder``, one table each with a batch column; codes of the batches before
    are reused, and batches without output may be missing. A repeated batch
    overwrites its own output and reads only earlier ones, so a retry gives the
    same result. Texts are scanned once.
    """
    rules = None if rules is None else list(rules)

    def run(batch: DataFrame, batch_id: int) -> None:
        known = _earlier(batch.sparkSession, f"{folder}/mapping", batch_id)
        found = materialize(detect(batch, rules, text, mode), "stream-items")
        coded, _ = code_shared(found, key, secret, imported=known)
        mapping = mapping_shared(coded, key)
        if known is not None:
            mapping = mapping.join(known.select("code"), "code", "left_anti")
        mapping.select("scope", *MAPPING_COLUMNS).write.mode("overwrite").parquet(f"{folder}/mapping/batch={batch_id}")
        redact(coded, "code", text).drop("items").write.mode("overwrite").parquet(f"{folder}/documents/batch={batch_id}")

    return run
