"""Access events, raw logs and configuration as inputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chainlake.schemas import ACCESS_EVENT, OBJECT_LOG, QUERY_LOG


def decode_access(raw: DataFrame, value: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(decoded access events, undecodable messages) of a batch or streaming source.

    An event needs an id, an action and a timestamp; everything else goes to the
    dead-letter side with its raw text.
    """
    text = (F.col("value") if value is None else value).cast("string")
    parsed = raw.select(
        text.alias("raw"), F.from_json(text, ACCESS_EVENT, {"mode": "PERMISSIVE"}).alias("e")
    )
    good = F.col("e.event_id").isNotNull() & F.col("e.action").isNotNull() & F.col("e.timestamp").isNotNull()
    good = F.coalesce(good, F.lit(False))
    return parsed.filter(good).select("e.*"), parsed.filter(~good).select("raw")


def access_stream(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """File stream of JSON messages, one per line; see ``kafka_stream`` for a broker."""
    return decode_access(spark.readStream.format("text").load(path))


def kafka_stream(spark: SparkSession, servers: str, topic: str) -> tuple[DataFrame, DataFrame]:
    """Broker stream; needs the Kafka connector on the class path."""
    source = (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", topic)
        .load()
    )
    return decode_access(source)


def read_query_log(spark: SparkSession, path: str, fmt: str = "json", stream: bool = False) -> DataFrame:
    reader = spark.readStream if stream else spark.read
    return reader.schema(QUERY_LOG).format(fmt).load(path)


def read_object_log(spark: SparkSession, path: str, fmt: str = "json", stream: bool = False) -> DataFrame:
    reader = spark.readStream if stream else spark.read
    return reader.schema(OBJECT_LOG).format(fmt).load(path)
