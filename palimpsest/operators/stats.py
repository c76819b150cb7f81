"""Counts of an archive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def span_stats(spans: DataFrame) -> DataFrame:
    """archive, spans, conversations, titles, summaries, messages, text_bytes."""
    of = lambda name: F.count(F.when(F.col("field") == name, 1))
    return spans.groupBy("archive").agg(F.count("*").alias("spans"), F.countDistinct("conversation_id").alias("conversations"), of("title").alias("titles"), of("summary").alias("summaries"), of("message").alias("messages"), F.sum(F.octet_length("text")).alias("text_bytes"))


def export_labels(exports: DataFrame) -> DataFrame:
    """archive, exports, labels: 'path (id=...)' in order of ingest, each once."""
    label = F.concat("source_path", F.when(F.col("id").isNotNull(), F.concat(F.lit(" (id="), "id", F.lit(")"))).otherwise(""))
    rows = exports.withColumn("archive", F.concat_ws("/", "service", "account"))
    return rows.groupBy("archive").agg(F.count("*").alias("exports"), F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("export_index", label.alias("l")))), lambda x: x["l"])).alias("labels"))
