"""Batches from a stream of shards: a micro-batch holds many resident windows, leftovers are carried over.

Whole batches of each band are emitted as they fill; what is left waits in a table of the checkpoint folder until later windows or the final flush.
The state between micro-batches is at most one short batch per band, and the number of the next window. Batches are the same however many windows a
micro-batch holds: the windows of a band follow each other in one numbered queue, of which each batch is a stretch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lenforge.operators.batches import band_counts, positioned
from lenforge.operators.numbering import sent

#: Resident windows of a micro-batch, where a file is a shard: few enough for small tables of windows, many enough that a micro-batch's own jobs don't count.
WINDOWS = 256


class WindowBatcher:
    """foreachBatch sink that writes (batch_id, band, row_idx, key, total_len, window) per micro-batch; a repeated micro-batch overwrites its own output.

    ``shard``: the column by which rows are told apart and put in order as shards, ``window`` of which are a resident window; None: a micro-batch is one window.
    """

    def __init__(self, out: str, batch: int = 32, key: str = "doc_id", seed: int = 42, shard: str | None = None, window: int = 4):
        self.out, self.batch, self.key, self.seed, self.shard, self.window = out, batch, key, seed, shard, window

    def _left(self, spark: SparkSession, micro: int) -> DataFrame | None:
        if micro <= 0:
            return None
        return spark.read.parquet(f"{self.out}/left/micro={micro - 1}")

    def _next(self, spark: SparkSession, micro: int) -> int:
        """The number of the first window of a micro-batch."""
        return 0 if micro <= 0 else spark.read.parquet(f"{self.out}/next/micro={micro - 1}").first()[0]

    def _windows(self, rows: DataFrame, first: int) -> tuple[DataFrame, int]:
        """Rows with their window, and the number of the window after them. The shards of a micro-batch, a small table, come to the driver."""
        if self.shard is None:
            return rows.withColumn("window", F.lit(first)), first + 1
        shards = rows.select(F.col(self.shard).alias("_shard")).distinct()
        ranked = shards.select("_shard", (F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("_shard")) - 1).alias("_r"))
        found = ranked.select("_shard", (F.floor(F.col("_r") / self.window) + first).cast("int").alias("window"))
        table = found.collect()
        few = F.broadcast(rows.sparkSession.createDataFrame(table, found.schema))
        return rows.join(few, F.col(self.shard).eqNullSafe(F.col("_shard"))).drop("_shard"), max((r["window"] for r in table), default=first - 1) + 1

    def __call__(self, rows: DataFrame, micro: int) -> None:
        spark = rows.sparkSession
        rows, after = self._windows(rows, self._next(spark, micro))
        rows = rows.select(self.key, "band", "total_len", "window")
        left = self._left(spark, micro)
        if left is not None:
            rows = rows.unionByName(left)
        # A band's queue: windows in turn, carried rows by theirs, and in each its own shuffled order.
        placed = positioned(rows, self.key, self.seed, ("band",), ("window",))
        stretch = placed.groupBy("band", "window").agg(F.floor(F.min("pos") / self.batch).alias("_first"), F.floor((F.max("pos") + 1) / self.batch).alias("_whole"))
        # What a window leaves goes into the first batch of the next window that fills one.
        later = Window.partitionBy("band").orderBy("_whole").rangeBetween(1, Window.unboundedFollowing)
        few, _ = sent(stretch.select(F.col("band").alias("_b"), F.col("window").alias("_w"), "_first", "_whole", F.min("window").over(later).alias("_later")))
        nth = F.floor(F.col("pos") / self.batch)
        at = placed.join(few, F.col("band").eqNullSafe(F.col("_b")) & (F.col("window") == F.col("_w"))).withColumn("_own", nth < F.col("_whole"))
        at = at.withColumn("_in", F.when(F.col("_own"), F.col("window")).otherwise(F.col("_later"))).withColumn("_nth", F.when(F.col("_own"), nth - F.col("_first")).otherwise(F.lit(0)))
        batches = at.where("_in IS NOT NULL").select(F.concat_ws("-", "_in", "band", "_nth").alias("batch_id"), "band", (F.col("pos") % self.batch).alias("row_idx"), self.key, "total_len", F.col("_in").alias("window"))
        batches.write.mode("overwrite").parquet(f"{self.out}/batches/micro={micro}")
        at.where("_in IS NULL").select(self.key, "band", "total_len", "window").repartition(1).write.mode("overwrite").parquet(f"{self.out}/left/micro={micro}")
        spark.createDataFrame([(after,)], "window int").coalesce(1).write.mode("overwrite").parquet(f"{self.out}/next/micro={micro}")

    def flush(self, spark: SparkSession, last_micro: int) -> None:
        """The short batches at the end of the stream."""
        left = self._left(spark, last_micro + 1)
        if left is None or not band_counts(left):
            return
        placed = positioned(left, self.key, self.seed, ("band",), ("window",))
        named = F.concat_ws("-", F.lit("end"), "band", F.floor(F.col("pos") / self.batch)).alias("batch_id")
        placed.select(named, "band", (F.col("pos") % self.batch).alias("row_idx"), self.key, "total_len", F.lit(self._next(spark, last_micro + 1)).alias("window")).write.mode("overwrite").parquet(f"{self.out}/batches/micro={last_micro + 1}")


def run(spark: SparkSession, shards: str, schema: str, out: str, checkpoint: str, window: int = 4, batch: int = 32, key: str = "doc_id", shard: str | None = None, files: int | None = None) -> DataFrame:
    """Streams a folder of shard files, ``window`` shards a resident window, to the end; gives the batches.

    ``shard`` names the column that tells the shards of a file apart; None: each file is a shard, in the stream's order.
    ``files`` of a micro-batch (None: ``WINDOWS`` windows of them); where files are shards, a multiple of ``window``, or windows end short with their micro-batch.
    """
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files or WINDOWS * window).parquet(shards)
    if shard is None:
        file = F.struct(F.unix_micros("_metadata.file_modification_time").alias("at"), F.col("_metadata.file_path").alias("path"))
        stream = stream.withColumn("_file", file)
    sink = WindowBatcher(out, batch, key, shard=shard or "_file", window=window)
    q = stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    last = q.lastProgress["batchId"] if q.lastProgress else -1
    sink.flush(spark, last)
    return spark.read.parquet(f"{out}/batches").drop("micro")
