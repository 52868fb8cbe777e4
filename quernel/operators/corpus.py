"""Random windows of a joined text that fits no task, by a two-level offset index.

Documents are put in order by a range partitioning; each partition has the running sum of its documents' lengths, and the driver the sum of each partition's. So a place in the joined text
names the documents that hold it, and a step reads those only: no window is ever stored. Cached batches know the range of their places, so others aren't even opened.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernel.functions.rng import Rng


class TokenCorpus:
    """docs (key columns, ids array<int>): the ids of all documents one after the other, in the order of keys, which should name a document. Null ids count as none."""

    def __init__(self, docs: DataFrame, keys: Sequence[str], ids: str = "ids"):
        schema = "part int, below long, n long, ids array<int>"
        ordered = docs.repartitionByRange(*keys).sortWithinPartitions(*keys).select(F.spark_partition_id().alias("part"), F.coalesce(ids, F.array().cast("array<int>")).cast("array<int>").alias("ids"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            below = 0
            for batch in batches:
                n = np.diff(batch.column(1).offsets.to_numpy()).astype(np.int64)
                start = below + np.cumsum(n) - n
                below += int(n.sum())
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(start), pa.array(n), batch.column(1)], names=["part", "below", "n", "ids"])

        placed = ordered.mapInArrow(run, schema).where("n > 0").persist(StorageLevel.MEMORY_AND_DISK)
        self.base, self.offsets, total = placed, {}, 0
        for part, n in sorted(tuple(r) for r in placed.groupBy("part").agg(F.sum("n")).collect()):
            self.offsets[part] = total
            total += n
        self.size = total

    def unpersist(self) -> None:
        self.base.unpersist()

    def __getitem__(self, places: Sequence[tuple[int, int]]) -> DataFrame:
        """(draw int, ids array<int>) of each (start, width) of places, by its number in them; what lies outside of the text isn't there. Places may overlap, go over documents and repeat."""
        parts = sorted(self.offsets.items())
        wanted = []
        for draw, (start, width) in enumerate(places):
            for i, (part, offset) in enumerate(parts):
                end = parts[i + 1][1] if i + 1 < len(parts) else self.size
                low, high = max(start, offset) - offset, min(start + width, end) - offset
                if low < high:
                    wanted.append((part, draw, low, high, offset))
        spark = self.base.sparkSession
        if not wanted:
            return spark.createDataFrame([], "draw int, ids array<int>")
        # as literals, so that batches are passed over by their ranges
        holds = None
        for part, _, low, high, _ in wanted:
            one = (F.col("part") == part) & (F.col("below") < high) & (F.col("below") + F.col("n") > low) & (F.col("below") >= 0)
            holds = one if holds is None else holds | one
        ranges = F.broadcast(spark.createDataFrame(wanted, "at int, draw int, low long, high long, offset long"))
        met = self.base.where(holds).join(ranges, (F.col("part") == F.col("at")) & (F.col("below") < F.col("high")) & (F.col("below") + F.col("n") > F.col("low")))
        first = F.greatest(F.col("low") - F.col("below"), F.lit(0))
        last = F.least(F.col("high") - F.col("below"), F.col("n"))
        piece = F.slice("ids", (first + 1).cast("int"), (last - first).cast("int"))
        pieces = met.select("draw", (F.col("offset") + F.col("below") + first).alias("place"), piece.alias("ids"))
        return pieces.groupBy("draw").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("place", "ids"))), lambda p: p["ids"])).alias("ids"))

    def starts(self, rng: Rng, n: int, width: int) -> list[int]:
        """Where n windows of width ids, and the one after, begin: drawn from the stream as a loop over the joined text draws them."""
        most = self.size - width - 1
        if most < 0:
            raise ValueError(f"{self.size} ids have no window of {width} and one more")
        return [min(int(rng.uniform(0.0, float(most + 1))), most) for _ in range(n)]

    def sample(self, rng: Rng, n: int, width: int) -> DataFrame:
        """(id long, x, y array<int>): n random windows, and the same one further on."""
        got = self[[(s, width + 1) for s in self.starts(rng, n, width)]]
        return got.select(F.col("draw").cast("long").alias("id"), F.slice("ids", 1, width).alias("x"), F.slice("ids", 2, width).alias("y"))

    def split(self, tenths: int = 9) -> tuple[int, int]:
        """How many ids go to training, rounded down, and how many are left."""
        n = self.size * tenths // 10
        return n, self.size - n
