"""Incremental ingest with Structured Streaming: a change stream kept as a latest-per-key state."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from siltstone.operators.resolve import KEY, latest_view
from siltstone.sources.published import Folder
from siltstone.sources.tables import SCHEMAS

STATE = "db_id bigint, key_entry binary, seq_num bigint, log_no bigint, value_entry binary, type int"


def read_log(spark: SparkSession, folder: str, files_per_batch: int = 64) -> DataFrame:
    """The log as a stream of the Parquet files that appear in a folder; offsets live in the checkpoint."""
    return spark.readStream.schema(SCHEMAS["changelog"]).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


class LatestState:
    """A state table with the newest version of every key, in buckets by the hash of store and key.

    A batch is merged with the last state by sequence, never by arrival, so
    late and repeated rows settle to the same state whatever the batches are.
    Only the buckets a batch touches are read and written anew; the others
    stay where they are. A version names the folder of each bucket and the
    newest batch, and is published by one rename; a batch that is run again
    after a failure finds itself there and does nothing, which makes the sink
    exactly-once. Folders that the last two versions don't name are removed.
    The number of buckets belongs to the state: a bucket should hold what a task can sort.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.spark, self._folder = spark, Folder(spark, path)
        self.buckets = self._folder.state().get("buckets", buckets)

    def read(self) -> DataFrame:
        """The newest published state; empty before the first batch."""
        return self._rows(self._folder.state().get("folders", {}).values())

    def _rows(self, folders) -> DataFrame:
        paths = [f"{self._folder.path}/{f}" for f in folders]
        return self.spark.read.schema(STATE).parquet(*paths) if paths else self.spark.createDataFrame([], STATE)

    def apply(self, batch: DataFrame, batch_id: int) -> None:
        """Merge a batch; the foreachBatch function of the sink."""
        version, state = self._folder.version(), self._folder.state()
        if state.get("batch", -1) >= batch_id:
            return
        cols = [x.split()[0] for x in STATE.split(", ")]
        folders = state.get("folders", {})
        bucket = F.pmod(F.hash(*KEY), F.lit(self.buckets))
        # Reduced before it is read twice: a hot key is one row.
        news = latest_view(batch.select(*cols), tie=[-F.col("log_no")], carry=("log_no", "value_entry", "type"))
        news.persist()
        try:
            touched = [str(r[0]) for r in news.select(bucket).distinct().collect()]  # at most the number of buckets
            have = self._rows([folders[b] for b in touched if b in folders])
            both = have.select(*cols).unionByName(news.select(*cols))
            won = latest_view(both, tie=[-F.col("log_no")], carry=("log_no", "value_entry", "type"))
            own = f"state-{uuid.uuid4().hex}"
            if touched:
                won.select(*cols, bucket.alias("bucket")).write.partitionBy("bucket").parquet(f"{self._folder.path}/{own}")
        finally:
            news.unpersist()
        new = folders | {b: f"{own}/bucket={b}" for b in touched}
        self._folder.publish(version + 1, {"batch": batch_id, "buckets": self.buckets, "folders": new})
        self._clean(version)

    def _clean(self, before: int) -> None:
        """Remove what neither the newest version nor the one before names."""
        states = [self._folder.state(v) for v in (before, before + 1) if v]
        named = {f for s in states for f in s["folders"].values()}
        for v in self._folder.versions()[:-2]:
            for f in self._folder.state(v)["folders"].values():
                if f not in named:
                    self._folder.delete(f)
            self._folder.delete(f"version-{v}.json")

    def start(self, stream: DataFrame, checkpoint: str, once: bool = True) -> StreamingQuery:
        """Run the stream into the state: everything available now, or on and on."""
        sink = stream.writeStream.foreachBatch(self.apply).option("checkpointLocation", checkpoint)
        return sink.trigger(availableNow=True).start() if once else sink.start()
