"""Incremental maps: streams of cell updates folded into log-odds."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from orbweave.functions.keys import TreeSetting
from orbweave.operators.fold import fold
from orbweave.operators.tree import axes_of


def stateful_cells(updates: DataFrame, s: TreeSetting, frame: str = "frame") -> DataFrame:
    """keys, log_odds, frame, late for each cell that a batch changes: the state of a cell is two numbers.

    updates: frame, keys, delta, one a frame and cell. Within a batch frames are put in order; an update older than the
    cell's last frame can't be put in order any more: it is counted in `late` and not applied.
    """
    names = axes_of(updates)
    low, high = s.log_odds_min, s.log_odds_max

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        value, last = state.get if state.exists else (0.0, -(1 << 62))
        late = 0
        for f, d in pd.concat(list(batches))[["_frame", "delta"]].sort_values("_frame").itertuples(index=False):
            if f <= last:
                late += 1
                continue
            value, last = min(high, max(low, value + d)), int(f)
        state.update((float(value), int(last)))
        yield pd.DataFrame([(*key, float(value), int(last), late)], columns=[*names, "log_odds", "frame", "late"])

    keys = ", ".join(f"{k} int" for k in names)
    rows = updates.select(F.col(frame).cast("long").alias("_frame"), *names, F.col("delta").cast("double"))
    return rows.groupBy(*names).applyInPandasWithState(run, f"{keys}, log_odds double, frame long, late long", "log_odds double, frame long", "update", GroupStateTimeout.NoTimeout)


class Snapshots:
    """A tree kept as versions of a table: each micro-batch folds its updates into the last version and writes the next.

    A version is written once: a batch that is run again after a failure finds its version or writes it anew from the one before.
    Each cell has the last frame that it was told of; updates of that frame or older ones are late and don't count.
    """

    def __init__(self, spark: SparkSession, path: str, s: TreeSetting):
        self.spark, self.path, self.s = spark, path.rstrip("/"), s

    def read(self, version: int) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/v{version}")

    def merge(self, updates: DataFrame, version: int, frame: str = "frame") -> None:
        names = axes_of(updates)
        updates = updates.select(F.col(frame).cast("long").alias("frame"), *names, "delta")
        start = self.read(version - 1) if version else None
        if start is not None:
            last = start.select(*names, F.col("frame").alias("_last"))
            updates = updates.join(last, names, "left").filter("_last is null or frame > _last").drop("_last")
        folded = fold(updates, names, ["frame"], self.s, start=start)
        told = updates.groupBy(*names).agg(F.max("frame").alias("_told"))
        known = start.select(*names, F.col("frame").alias("_known")) if start is not None else told.select(*names, F.col("_told").alias("_known"))
        out = folded.join(told, names, "left").join(known, names, "left")
        out = out.select(F.lit(self.s.depth).alias("d"), *names, "log_odds", F.coalesce("_told", "_known").alias("frame"))
        out.write.mode("overwrite").parquet(f"{self.path}/v{version}")

    def follow(self, updates: DataFrame, checkpoint: str, frame: str = "frame") -> StreamingQuery:
        return updates.writeStream.foreachBatch(lambda df, version: self.merge(df, version, frame)).option("checkpointLocation", checkpoint).start()
