"""Adam over parameters that are kept as a table: parameters and both moments in one state table, bucketed by their key.

A step joins gradients to the state's buckets: only the gradients are moved, the state is read and written where it lies, as the result has the state's own partitioning. Each step
writes the next state to the shared folder and drops the one before, so a lost executor costs tasks of one step.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernel.models.nn import adam_columns
from quernel.session import shared_folder


class AdamTable:
    """df (key, w array<double>): a row for each group of parameters; key names a row, nulls are refused. buckets: as many files and tasks as a step has."""

    def __init__(self, df: DataFrame, key: str, lr: float = 1e-3, beta1: float = 0.9, beta2: float = 0.999, eps: float = 1e-8, weight_decay: float = 0.0, buckets: int | None = None):
        self.spark, self.key, self.lr, self.t = df.sparkSession, key, lr, 0
        self.rates = {"beta1": beta1, "beta2": beta2, "eps": eps, "weight_decay": weight_decay}
        self.buckets = buckets or max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), self.spark.sparkContext.defaultParallelism)
        self.folder, self.name = shared_folder(self.spark, "adam"), None
        named = F.when(F.col(key).isNull(), F.raise_error(F.lit(f"a null in {key}"))).otherwise(F.col(key))
        zeros = F.transform("w", lambda x: F.lit(0.0))
        self._write(df.select(named.alias(key), F.col("w").cast("array<double>").alias("w")).select(key, "w", zeros.alias("m"), zeros.alias("v")).repartition(self.buckets, key))

    def _write(self, state: DataFrame) -> None:
        old, self.name = self.name, f"adam_{uuid.uuid4().hex}"
        state.write.bucketBy(self.buckets, self.key).sortBy(self.key).option("path", f"{self.folder}/{self.name}").saveAsTable(self.name)
        if old:
            self._drop(old)

    def _drop(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        where = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        where.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(where, True)

    @property
    def state(self) -> DataFrame:
        """(key, w, m, v) as it is now."""
        return self.spark.table(self.name)

    def stepped(self, grads: DataFrame) -> DataFrame:
        """The state after a step by grads (key, g array<double> as long as w), without taking it. Keys without gradients have zeros; a key may come once."""
        g = grads.select(self.key, F.col("g").cast("array<double>").alias("g"))
        both = self.state.join(g, self.key, "left").withColumn("g", F.coalesce("g", F.transform("w", lambda x: F.lit(0.0))))
        same = F.when(F.size("g") == F.size("w"), F.arrays_zip("w", "g", "m", "v")).otherwise(F.raise_error(F.lit("a gradient of another length")))

        def one(s):
            w, m, v = adam_columns(s["w"], s["g"], s["m"], s["v"], self.t + 1, self.lr, **self.rates)
            return F.struct(w.alias("w"), m.alias("m"), v.alias("v"))

        moved = both.select(self.key, F.transform(same, one).alias("s"))
        return moved.select(self.key, "s.w", "s.m", "s.v")

    def step(self, grads: DataFrame) -> None:
        self._write(self.stepped(grads))
        self.t += 1

    def set_lr(self, lr: float) -> None:
        self.lr = lr

    def drop(self) -> None:
        if self.name:
            self._drop(self.name)
            self.name = None
