"""Exact deduplication as a stateful stream.

A file stream of documents is folded into keyed state that lives in RocksDB on
the executors' disks and is checkpointed in the shared folder.  The key is the
digest of the normalised text; the state keeps, without expiry, how many rows had
it and the holder: the identifier of the row that stays and where its content
lies (file and row).  Rows of a batch are aggregated before the exchange, so a
text that a third of all rows share is one row a task.  Each batch appends the
classes that it changed to a log (again, if the batch is replayed), so a
restarted stream goes on from its state.

A digest is a hint only.  ``checked`` compares the full bytes of every row whose
digest was hit with the bytes at its holder's locator, in one equi-join on the
digest; texts come along only where a bitmap of the hit digests (BITS bits,
whatever the input) lets them.  Rows that differ from their holder are classed by
their whole text.

Texts are equal when identical after lower-casing A to Z.  Defined cases: null
text is the empty text; of rows with one id and text the last locator stays; a
null id is below all others, and keep_id is null if all ids of a class are;
repeated rows are rows of their own; an empty table gives an empty result; only
the id and the text are read, so other columns don't matter.
"""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veltrial.llm.common import shared_checkpoint, shared_folder

#: Bits of the bitmap of hit digests (4 MB): all that is ever broadcast.
BITS = 1 << 25
#: Files that a batch takes in at most.
FILES = 1000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Of the session while a stream starts.
_STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",  # else each of many small stores sets megabytes of disk aside
}


def normalised(text: Column) -> Column:
    """A to Z lower-cased, nothing else; null is empty."""
    text = F.coalesce(text, F.lit(""))
    # of ASCII alone, lower() is the same and quicker
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


@contextlib.contextmanager
def _settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


class StreamingDedup:
    """Deduplicates the Parquet files at ``path``; state, offsets and the log of
    classes are in ``work``, a folder that all executors share."""

    def __init__(self, spark: SparkSession, path: str, work: str, id_column: str = "doc_id", text_column: str = "text", digest: Callable[[Column], Column] = sha256, files_per_batch: int = FILES):
        self.spark, self.path, self.work, self.digest, self.files_per_batch = spark, path.rstrip("/"), work, digest, files_per_batch
        self.id, self.text = id_column, text_column
        fields = {f.name: f for f in spark.read.parquet(path).schema}
        self.schema = T.StructType([fields[id_column], fields[text_column]])

    def _rows(self, source: DataFrame) -> DataFrame:
        """_id, _norm, _digest, _at (the locator)."""
        rows = source.select(F.col(self.id).alias("_id"), normalised(F.col(self.text)).alias("_norm"), F.struct("_metadata.file_path", "_metadata.row_index").alias("_at"))
        return rows.withColumn("_digest", self.digest(F.col("_norm")))

    def rows(self) -> DataFrame:
        return self._rows(self.spark.read.schema(self.schema).parquet(self.path))

    def run(self) -> None:
        """Take in all files that aren't in the state yet."""
        pattern = f"{self.path[:-1]}[{self.path[-1]}]"  # the same path as a pattern: a stream takes a single file by pattern only
        stream = self._rows(self.spark.readStream.schema(self.schema).option("maxFilesPerTrigger", self.files_per_batch).parquet(pattern))
        classes = stream.groupBy("_digest").agg(F.count("*").alias("_n"), F.max(F.struct("_id", "_at")).alias("_holder"))
        self.rows().groupBy("_digest").agg(F.count("*").alias("_n"), F.max(F.struct("_id", "_at")).alias("_holder")).limit(0).write.mode("overwrite").parquet(f"{self.work}/classes/batch=-1")

        def append(changed: DataFrame, batch: int) -> None:
            changed.write.mode("overwrite").parquet(f"{self.work}/classes/batch={batch}")

        with _settings(self.spark, _STATE):
            query = classes.writeStream.outputMode("update").option("checkpointLocation", f"{self.work}/state").trigger(availableNow=True).foreachBatch(append).start()
        query.awaitTermination()

    def classes(self) -> DataFrame:
        """_digest, _n, _holder: as the state has them now (counts only grow, so a class's last state is its largest)."""
        log = self.spark.read.parquet(f"{self.work}/classes")
        return log.groupBy("_digest").agg(F.max(F.struct("_n", "_holder")).alias("_c")).select("_digest", "_c.*")

    def checked(self) -> DataFrame:
        """One row per row of the source: _id, keep_id, group_size, kept, text_sha256."""
        classes = shared_checkpoint(self.classes())
        rows = self.rows().withColumn("text_sha256", F.sha2("_norm", 256))
        placed = rows.drop("_norm").join(classes, "_digest")
        wrong = shared_checkpoint(self._unlike(classes.where("_n > 1")))
        if wrong.isEmpty():
            keep, size = F.col("_holder._id"), F.col("_n")
            holder = F.col("_holder._at")
        else:
            others = wrong.groupBy("_digest", "_norm").agg(F.count("*").alias("_m"), F.max(F.struct("_id", "_at")).alias("_other"))
            own = wrong.join(others, ["_digest", "_norm"]).select(F.col("_at"), "_m", "_other")
            less = others.groupBy("_digest").agg(F.sum("_m").alias("_less"))
            placed = placed.join(own, "_at", "left").join(less, "_digest", "left")
            keep = F.when(F.col("_m").isNotNull(), F.col("_other._id")).otherwise(F.col("_holder._id"))
            size = F.coalesce("_m", F.col("_n") - F.coalesce("_less", F.lit(0)))
            holder = F.coalesce("_other._at", "_holder._at")
        return placed.select("_id", keep.alias("keep_id"), size.cast("long").alias("group_size"), (F.col("_at") == holder).alias("kept"), "text_sha256")

    def _unlike(self, hit: DataFrame) -> DataFrame:
        """_digest, _at, _id, _norm of the rows whose bytes differ from their holder's."""
        place = F.pmod(F.xxhash64("_digest"), F.lit(BITS))
        bucket, bit = F.bitmap_bucket_number(place), F.bitmap_bit_position(place)
        bitmap = hit.groupBy(bucket.alias("_bucket")).agg(F.bitmap_construct_agg(bit).alias("_bits"))
        byte = F.conv(F.hex(F.substring("_bits", (bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        likely = self.rows().join(F.broadcast(bitmap), F.col("_bucket") == bucket).where(F.getbit(byte, (bit % 8).cast("int")) == 1)
        texts = likely.select("_digest", "_at", "_id", "_norm")
        holders = hit.select("_digest", F.col("_holder._at").alias("_at")).join(texts.drop("_id"), ["_digest", "_at"]).select("_digest", F.col("_norm").alias("_held"))
        return texts.join(holders, "_digest").where(F.col("_norm") != F.col("_held")).drop("_held")


def deduplicate(spark: SparkSession, path: str, id_column: str = "doc_id", text_column: str = "text", **options) -> DataFrame:
    """One run over the files at ``path``, with state that goes when it ends:
    doc_id, keep_id, group_size, kept, text_sha256."""
    work = f"{shared_folder(spark)}/dedup-{uuid.uuid4().hex}"
    dedup = StreamingDedup(spark, path, work, id_column, text_column, **options)
    dedup.run()
    out = shared_checkpoint(dedup.checked().withColumnRenamed("_id", id_column))
    folder = spark._jvm.org.apache.hadoop.fs.Path(work)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    return out


def op12_stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicate(spark, f"{sf_dir}/documents.parquet")


OP12_SQL = f"""
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept, sha256(t) AS text_sha256
FROM d WINDOW g AS (PARTITION BY t)
"""
