"""A stored key-value database: puts are appended, everything else is derived from them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyrill.functions.keys import NIL_KEY, shard_of
from keyrill.operators import router, store, views
from keyrill.operators.log import value_offsets
from keyrill.sources.storage import BUCKETS

LOG = "seq long, key string, value string, op string"


@dataclass
class Database:
    """One writer, any readers; a path that Spark can read and write.

    Puts lie in Parquet, in buckets of shards: a lookup of one key reads one
    bucket. Each append is a batch of its own, committed as a whole.
    """

    spark: SparkSession
    path: str

    @property
    def _log(self) -> str:
        return f"{self.path}/log"

    def log(self) -> DataFrame:
        """All puts: seq, key, value, op, shard, bucket; opening a database is reading it."""
        schema = f"{LOG}, shard int, bucket int"
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(self._log)
        if not hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(hadoop):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(self._log)

    def put(self, puts: DataFrame) -> None:
        """Append (seq, key, value) and op, if there (put, put_dyna or put_perm).

        seq must be unique and above those stored before; a lesser or null one,
        the nil key and a null key are refused.
        """
        op = F.coalesce("op", F.lit("put")) if "op" in puts.columns else F.lit("put")
        refuse = lambda why: F.raise_error(F.lit(why))
        key = F.when(F.col("key").isNull() | (F.col("key") == NIL_KEY), refuse("the nil key can't be stored")).otherwise(F.col("key"))
        seq = F.when(F.col("seq").isNull() | (F.col("seq") <= self.new_view()), refuse("a put's seq must be above those stored")).otherwise(F.col("seq"))
        rows = puts.select(seq.cast("long").alias("seq"), key.alias("key"), "value", op.alias("op"))
        rows = rows.withColumn("shard", shard_of(F.col("key"))).withColumn("bucket", F.col("shard") % BUCKETS)
        # rebalanced, so that Spark may split the shard of a hot key over several tasks
        rows = rows.hint("rebalance", F.col("bucket"), F.col("shard")).sortWithinPartitions("bucket", "shard", "key", "seq")
        rows.write.mode("append").partitionBy("bucket").option("parquet.bloom.filter.enabled#key", "true").parquet(self._log)

    def _of(self, key: str) -> DataFrame:
        """The puts of one key: filters on bucket, shard and key reach the scan."""
        shard = int(key[8:16], 16) % 512
        return self.log().where((F.col("bucket") == shard % BUCKETS) & (F.col("shard") == shard) & (F.col("key") == key))

    def get(self, key: str) -> DataFrame:
        """key, value, seq of one key: the mutable layer first, else the permanent one."""
        return router.get(self._of(key))

    def get_perm(self, key: str) -> DataFrame:
        return router.perm_layer(self._of(key))

    def get_dyna(self, key: str) -> DataFrame:
        return router.dyna_layer(self._of(key))

    def multi_get(self, probe: DataFrame) -> DataFrame:
        """probe_id, key, found, value."""
        return store.multi_get(probe, self.current())

    def current(self) -> DataFrame:
        """key, value, seq of every key, as get() finds it."""
        return router.get(self.log())

    def layers(self) -> tuple[DataFrame, DataFrame]:
        """key, value of the write-once and of the mutable layer, whatever operations made them."""
        return router.perm_layer(self.log()), router.dyna_layer(self.log())

    def new_view(self) -> int:
        """A snapshot handle: the last seq stored so far."""
        return self.log().agg(F.coalesce(F.max("seq"), F.lit(-1))).first()[0]

    def view(self, handle: int) -> DataFrame:
        """The state at a handle; later puts don't show."""
        return router.get(self.log().where(F.col("seq") <= handle))

    def changed_since(self, handle: int) -> DataFrame:
        """view_id, key, changed of the keys that the view holds."""
        return views.against_current(self.view(handle).select(F.lit(handle).alias("view_id"), "key", "value"), self.current())

    def _live(self) -> DataFrame:
        """shard, layer (perm or dyna), key, value, seq of what the layers hold."""
        held = router.layers(self.log())
        both = F.array(
            F.struct(F.lit("perm").alias("layer"), F.col("has_perm").alias("held"), F.col("perm").alias("value"), F.col("perm_seq").alias("seq")),
            F.struct(F.lit("dyna").alias("layer"), F.col("has_dyna").alias("held"), F.col("dyna").alias("value"), F.col("seq").alias("seq")),
        )
        rows = held.select("key", F.explode(both).alias("at")).where("at.held")
        return rows.select(shard_of(F.col("key")).alias("shard"), "at.layer", "key", "at.value", "at.seq")

    def reclaimable(self) -> DataFrame:
        """shard, live_bytes, garbage_bytes: of the bytes that accepted puts wrote, those the layers still hold and the rest."""
        size = F.coalesce(F.octet_length("value"), F.lit(0)).cast("long")
        wrote = router.mixed_ops(self.log().select("seq", "key", "value", "op")).where(F.col("action").isin("PERM_INSERT", "DYNA_WRITE"))
        wrote = wrote.groupBy(shard_of(F.col("key")).alias("shard")).agg(F.sum(size).alias("written"))
        live = self._live().groupBy("shard").agg(F.sum(size).alias("live_bytes"))
        return wrote.join(live, "shard").select("shard", "live_bytes", (F.col("written") - F.col("live_bytes")).alias("garbage_bytes"))

    def compress(self, to: str) -> Database:
        """Write what the layers hold, each in its layer, as a database at `to`; views older than now go.

        The old one stays whole until the caller swaps the paths.
        """
        new = Database(self.spark, to)
        new.put(self._live().select("seq", "key", "value", F.concat(F.lit("put_"), "layer").alias("op")))
        return new

    def layout(self) -> DataFrame:
        """shard, layer, key, offset, length of live values in two files a shard."""
        rows = self._live().withColumn("length", F.coalesce(F.octet_length("value"), F.lit(0)).cast("long"))
        return value_offsets(rows, ["shard", "layer"]).select("shard", "layer", "key", "offset", "length")
