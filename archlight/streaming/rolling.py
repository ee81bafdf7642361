"""Rolling metrics of a stream: the mean of the last values of each key, kept as state between micro-batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from archlight.operators.metrics import RECENT

#: The state store that keyed state needs.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


#: Groups that keys are dealt to. Each group is one call of Python and one list of state for a batch, whatever the number of its keys.
BUCKETS = 2048


class Ring(StatefulProcessor):
    """The last ``RECENT`` values of every key of a bucket; a key is forgotten once the watermark is ``idle`` milliseconds past its last row.

    Rows come as bucket, name of the key, time in milliseconds, the columns to return, value.
    """

    def __init__(self, columns: list[str], order: list[str], idle: int | None) -> None:
        self.columns, self.idle = columns, idle
        self.order = [3 + columns.index(c) for c in order]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.recent = handle.getListState("recent", "name string, last long, held array<double>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803  Spark's names
        """Rows of the batch in each key's order; the state holds RECENT values of a key, whatever a batch brings."""
        new = pd.concat(list(rows), ignore_index=True)
        new.columns = range(new.shape[1])  # by their places: Spark may rename columns
        new = new.sort_values(self.order, kind="stable", na_position="first")
        state = {name: (last, held) for name, last, held in self.recent.get()} if self.recent.exists() else {}
        code, names = pd.factorize(new[1])
        before = [[float("nan") if v is None else v for v in state[n][1]] if n in state else [] for n in names]
        # values held come before those of the batch
        owner = np.concatenate((np.repeat(np.arange(len(names)), [len(v) for v in before]), code))
        x = np.concatenate((*map(np.array, before), new.iloc[:, -1].to_numpy(float)))
        by = np.argsort(owner, kind="stable")
        x, starts = x[by], np.searchsorted(owner[by], np.arange(len(names) + 1))
        averages, counts = recent_means(x, np.arange(len(x)) - starts[owner[by]])
        latest = new[2].groupby(code).max().to_numpy()
        for i, name in enumerate(names):
            held = x[max(starts[i], starts[i + 1] - RECENT) : starts[i + 1]].tolist()
            state[name] = (int(latest[i]), [None if v != v else v for v in held])
        self.keep(state)
        fresh = by >= len(x) - len(new)
        shown = new.iloc[by[fresh] - (len(x) - len(new)), 3:-1].set_axis(self.columns, axis=1)
        yield shown.assign(recent_avg=averages[fresh], recent_n=counts[fresh])

    def keep(self, state: dict) -> None:
        """Writes the bucket's state; its timer is that of the key that is forgotten first."""
        if self.idle is not None:
            for old in list(self.handle.listTimers()):
                self.handle.deleteTimer(old[0] if isinstance(old, tuple) else old)
        if not state:
            self.recent.clear()
            return
        self.recent.put([(name, last, held) for name, (last, held) in state.items()])
        if self.idle is not None:
            self.handle.registerTimer(min(last for last, _ in state.values()) + self.idle)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803  Spark's names
        now = timerValues.getCurrentWatermarkInMs()
        self.keep({name: (last, held) for name, last, held in self.recent.get() if last + self.idle > now})
        return iter(())

    def close(self) -> None:
        pass


def recent_means(x: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The mean and the number of the last RECENT known values up to each; ``place`` counts the values of the same key before."""
    known = ~np.isnan(x)
    filled = np.where(known, x, 0.0)
    total, count = np.zeros(len(x)), np.zeros(len(x), np.int64)
    for back in range(min(RECENT, len(x)) - 1, -1, -1):  # the oldest first
        own, upto = place[back:] >= back, len(x) - back
        total[back:] += np.where(own, filled[:upto], 0.0)
        count[back:] += own & known[:upto]
    return np.divide(total, count, out=np.full(len(x), np.nan), where=count > 0), count


def moving_average(stream: DataFrame, key: str, order: list[str], value: str, time: str | None = None, idle: int = 0) -> DataFrame:
    """``key, order, recent_avg, recent_n``: as the batch operator gives them, while rows arrive.

    Rows of a batch are taken in their order, batches in theirs; a row that comes late counts when it comes. Keys are
    dealt to ``BUCKETS`` by hash, and a bucket's keys share a call and a list of state: a batch costs as its rows and the
    keys of the buckets that it touches, not a call for each key. A batch holds a bucket's own rows in memory, so the
    source's bound on a batch bounds them. With ``time``, a column of ``order`` that the stream has a watermark on, keys
    that are idle for so many milliseconds are forgotten; late rows are then those that the watermark lets through. The
    session's state store is set to the one that keyed state needs. A checkpoint holds for one number of buckets.
    """
    spark = stream.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    columns = list(dict.fromkeys([key, *order]))
    kinds = dict(stream.dtypes)
    out = ", ".join(f"{c} {kinds[c]}" for c in columns) + ", recent_avg double, recent_n long"
    name = F.when(F.col(key).isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), F.col(key).cast("string")))
    at = F.coalesce(F.unix_millis(F.col(time)), F.lit(0)) if time else F.lit(0)
    rows = stream.select(F.pmod(F.xxhash64(name), F.lit(BUCKETS)).alias("_bucket"), name.alias("_name"), at.cast("long").alias("_at"), *columns, F.col(value).cast("double").alias("_value"))
    ring = Ring(columns, order, idle if time else None)
    return rows.groupBy("_bucket").transformWithStateInPandas(statefulProcessor=ring, outputStructType=out, outputMode="append", timeMode="eventTime" if time else "none")


def write(rows: DataFrame, target: str, checkpoint: str) -> None:
    """Appends what has arrived since the last run to a table, then stops; state and progress are in the checkpoint."""
    rows.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()
