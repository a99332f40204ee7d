"""The snippet bus: JSON messages in a ``value`` column, on Kafka or in files.

Records carry no key, so a producer spreads them over all partitions. Messages
on files use the same ``value`` column, for replays and tests.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from hunkwise.functions.text import trim_white_space
from hunkwise.schemas import SNIPPET, SNIPPET_COLUMNS

# Topic, consumer group and message compression.
TOPIC = "code-snippets"
GROUP = "gateway-inference"
COMPRESSION = "snappy"

MESSAGE = T.StructType([T.StructField("value", T.StringType())])
_CORRUPT = "_corrupt"


def encode(snippets: DataFrame) -> DataFrame:
    return snippets.select(F.to_json(F.struct(*SNIPPET_COLUMNS)).alias("value"))


def _parsed(messages: DataFrame) -> DataFrame:
    """Each message with its fields and the reason it may be malformed.

    The fields come out of a generator: a filter on them stays above it, so every
    message is parsed once.
    """
    schema = T.StructType([*SNIPPET.fields, T.StructField(_CORRUPT, T.StringType())])
    value = F.col("value").cast("string")
    parsed = F.from_json(value, schema, {"columnNameOfCorruptRecord": _CORRUPT})
    return messages.select(value.alias("value"), F.inline_outer(F.array(parsed)))


def _malformed() -> Column:
    blank = F.coalesce(trim_white_space(F.col("value")) == "", F.lit(True))
    return blank | F.col(_CORRUPT).isNotNull()


def decode(messages: DataFrame) -> DataFrame:
    """Snippets of the well-formed messages; a missing field becomes its zero value."""
    zero = {T.StringType(): "", T.IntegerType(): 0, T.LongType(): 0}
    return (
        _parsed(messages)
        .filter(~_malformed())
        .select(*(F.coalesce(F.col(f.name), F.lit(zero[f.dataType])).cast(f.dataType).alias(f.name) for f in SNIPPET.fields))
    )


def malformed(messages: DataFrame) -> DataFrame:
    """Messages that are no snippet, kept aside."""
    return _parsed(messages).filter(_malformed()).select("value")


def kafka_options(brokers: str, topic: str = TOPIC, group: str | None = None) -> dict[str, str]:
    """Options of a reader; offsets that have expired are an error.

    Without ``group`` every query gets a group of its own, so that they do not
    disturb each other; progress is in the checkpoint either way.
    """
    return {
        "kafka.bootstrap.servers": brokers,
        "subscribe": topic,
        **({"kafka.group.id": group} if group else {"groupIdPrefix": GROUP}),
        "startingOffsets": "earliest",
        "failOnDataLoss": "true",
    }


def kafka_sink_options(brokers: str, topic: str = TOPIC) -> dict[str, str]:
    return {"kafka.bootstrap.servers": brokers, "topic": topic, "kafka.compression.type": COMPRESSION}


def publish_kafka(snippets: DataFrame, brokers: str, topic: str = TOPIC) -> None:
    encode(snippets).write.format("kafka").options(**kafka_sink_options(brokers, topic)).save()


def publish_kafka_stream(snippets: DataFrame, brokers: str, checkpoint: str, topic: str = TOPIC) -> StreamingQuery:
    writer = encode(snippets).writeStream.format("kafka").options(**kafka_sink_options(brokers, topic))
    return writer.option("checkpointLocation", checkpoint).start()


def consume_kafka(spark: SparkSession, brokers: str, topic: str = TOPIC) -> DataFrame:
    reader = spark.readStream.format("kafka").options(**kafka_options(brokers, topic))
    return reader.load().select(F.col("value").cast("string").alias("value"))


def publish_files(messages: DataFrame, path: str) -> None:
    messages.select("value").write.mode("append").option("compression", COMPRESSION).parquet(path)


def consume_files(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(MESSAGE)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)
