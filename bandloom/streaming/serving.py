"""Requests as micro-batches: a stream of JSON lines is parsed, refused or answered, and each answer is kept once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from bandloom.plans import requests

ANSWER = "batch long, caller string, request_id string, status int, reason string, value string"


def lines(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """Text files of requests as a stream of lines."""
    reader = spark.readStream.schema("value string").format("text")
    return (reader.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else reader).load(path)


def replies(batch: DataFrame, defaults: DataFrame | None = None) -> DataFrame:
    """``caller, request_id, status, reason, value``: a row a request, refused or with its answers as JSON.

    A sound request that no voice could answer has status 200 and no value.
    """
    checked = requests.checked(requests.parsed(batch))
    answered = requests.encoded_calls(requests.calls(checked, defaults))
    told = checked.select("caller", "request_id", F.coalesce("refusal.status", F.lit(200)).alias("status"), "refusal.reason")
    key = (told["caller"].eqNullSafe(answered["caller"])) & (told["request_id"].eqNullSafe(answered["request_id"])) & (told["status"] == 200)
    return told.join(answered, key, "left").select(told["caller"], told["request_id"], "status", "reason", "value")


def serve(stream: DataFrame, path: str, defaults: DataFrame | None = None) -> StreamingQuery:
    """Answers a stream of lines into ``path``, all that is available now; started again, it goes on with what is new.

    A batch is a folder of its own that is written whole. If a run ends between its answers and the note that they are
    done, the next run answers the same lines under the same number and replaces that folder: each answer is there once.
    """

    def write(batch: DataFrame, number: int) -> None:
        replies(batch, defaults).write.mode("overwrite").parquet(f"{path}/answers/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{path}/log").trigger(availableNow=True).start()


def replied(spark: SparkSession, path: str) -> DataFrame:
    """``batch, caller, request_id, status, reason, value`` of all batches so far."""
    return spark.read.schema(ANSWER).parquet(f"{path}/answers")
