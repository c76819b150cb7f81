"""Incremental ingest: micro-batches of items are folded into the state of their conversations.

A state is a merged conversation with the digests of the dumps that are in it, so that dumps cut into batches in any way
give what one fold over all of them gives. There is no watermark: late dumps are always taken.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.merge import MERGED, STATE, fold, merge_states


def upsert(state: DataFrame | None, batch: DataFrame) -> DataFrame:
    """State (STATE rows) and new items -> state. Conversations that the batch doesn't touch are passed through."""
    if state is None:
        return merge_states(batch)
    key = ["service", "account", "id"]
    ids = batch.select("service", "account", F.get_json_object("item", "$.conversation.id").alias("id")).where("id is not null").distinct()
    new = merge_states(batch, state.join(ids, key, "left_semi"))
    return state.join(ids, key, "left_anti").select(*new.columns).unionByName(new)


def start(items: DataFrame, folder: str, checkpoint: str, trigger: dict | None = None):
    """Writes each batch's state as a new version, whole; a batch that runs again writes the same version again. The version
    before stays for readers, older ones go. See ``start_keyed`` for states that are too large to be written again."""

    def each(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        state = spark.read.schema(STATE).parquet(f"{folder}/v{number - 1}") if number else None
        upsert(state, batch).write.mode("overwrite").parquet(f"{folder}/v{number}")
        if number > 1:
            old = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/v{number - 2}")
            old.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(old, True)

    return items.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


# ---------------------------------------------------------------- keyed state

_VALUE = "seq long, export_indices array<int>, n_dumps int, item string, seen array<string>"


class Conversations(StatefulProcessor):
    """The state of one conversation, in the store of the task that its key belongs to. Gives the merged conversation after each batch that has dumps of it."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("conversation", _VALUE)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        dumps = sorted((r.asDict() for r in rows), key=lambda r: r["seq"])
        have = self.state.get() if self.state.exists() else None
        if have is not None:
            have = dict(zip(("seq", "export_indices", "n_dumps", "item", "seen"), have, strict=True))
        new = fold(have, dumps)
        self.state.update((new["seq"], new["export_indices"], new["n_dumps"], new["item"], new["seen"]))
        own = json.loads(dumps[0]["item"]).get("conversation") or {}
        yield Row(service=key[0], account=key[1], seq=new["seq"], id=own.get("id"), export_indices=new["export_indices"], n_dumps=new["n_dumps"], item=new["item"])

    def close(self) -> None:
        pass


#: Spark's name for the store that such states need.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def start_keyed(items: DataFrame, folder: str, checkpoint: str, trigger: dict | None = None):
    """Each batch writes the conversations that it touches, and no others, to a folder of its own; ``read_keyed`` gives the
    last of each. A batch that runs again writes its folder again."""
    items.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    own = F.get_json_object("item", "$.conversation.id")
    # conversations without an id are merged with nothing: each is a key of its own
    keyed = items.withColumn("_key", F.when(own.isNotNull(), F.concat(F.lit("id "), own)).otherwise(F.concat(F.lit("seq "), "seq")))
    merged = keyed.groupBy("service", "account", "_key").transformWithState(Conversations(), MERGED, "Update", "None")

    def each(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return merged.writeStream.foreachBatch(each).outputMode("update").option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def read_keyed(spark: SparkSession, folder: str) -> DataFrame:
    """MERGED rows: each conversation as it was after the last batch that touched it."""
    rows = spark.read.parquet(folder)
    last = rows.groupBy("service", "account", "id", F.when(F.col("id").isNull(), F.col("seq")).alias("_alone")).agg(F.max_by(F.struct("seq", "export_indices", "n_dumps", "item"), "batch").alias("x"))
    return last.select("service", "account", "x.seq", "id", "x.export_indices", "x.n_dumps", "x.item")
