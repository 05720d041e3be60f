"""A daily budget kept as the state of a stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from lexloom.operators.ledger import walk

#: Keyed state with more than one value needs this store; set before a query starts.
STATE_STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
}
_PAISE = 100
_ORDER = ["ts", "id"]


class _Budget(StatefulProcessor):
    """What is left of each day's budget. A new day is a new key and starts whole."""

    def __init__(self, cap: int, expiry: str | None):
        self.cap, self.expiry = cap, expiry

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.spent = handle.getValueState("spent", "paise bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        left = self.cap - (self.spent.get()[0] if self.spent.exists() else 0)
        held: pd.DataFrame | None = None
        for part in rows:
            part = part.reset_index(drop=True)
            price = part.cost_paise
            open_ = price.notna() & (price > 0) & (price <= left)
            yield _answered(part[~open_], (price[~open_] == 0).to_numpy())
            more = part[open_] if held is None else pd.concat([held, part[open_]])
            # Of one price only as many as the budget holds can still be admitted: the first ones.
            more = more.sort_values(_ORDER, kind="stable")
            fits = more.groupby("cost_paise").cumcount() < left // more.cost_paise.clip(lower=1)
            yield _answered(more[~fits], False)
            held = more[fits]
        if held is not None and len(held):
            admitted, now = walk(zip(held.cost_paise.astype("int64").tolist(), range(len(held))), left)
            places = pd.Series(range(len(held)), index=held.index)
            last = held.cost_paise.astype("int64").map(admitted)
            yield _answered(held, (places <= last.fillna(-1)).to_numpy())
            if now != left:
                self.spent.update((self.cap - now,))

    def close(self) -> None:
        pass


def _answered(rows: pd.DataFrame, admitted) -> pd.DataFrame:
    return rows[["id", "day", "cost_paise"]].assign(admitted=admitted)


def admitted_stream(calls: DataFrame, budget: float) -> DataFrame:
    """Each call of a stream (id, ts, cost_paise) as it arrives: id, day (UTC), cost_paise, admitted.

    Calls of one batch are taken by time and id, batches as they come; what was admitted stays admitted. State is one number
    per day. A day's calls meet in one task, a part at a time: no more are held than can still be admitted (see
    ``admit_calls``), so a busy day needs no more memory than its budget. A call without a price is refused,
    one of price 0 admitted.
    """
    for name, value in STATE_STORE.items():
        calls.sparkSession.conf.set(name, value)
    keyed = calls.select("id", "ts", F.to_date("ts").alias("day"), F.col("cost_paise").cast("bigint").alias("cost_paise"))
    return keyed.groupBy("day").transformWithStateInPandas(
        statefulProcessor=_Budget(round(budget * _PAISE), None),
        outputStructType="id bigint, day date, cost_paise bigint, admitted boolean",
        outputMode="append",
        timeMode="none",
    )


def run_admitted(calls: DataFrame, budget: float, out: str, checkpoint: str) -> StreamingQuery:
    """Write the answers of :func:`admitted_stream` under ``out`` until the source is drained."""
    return (
        admitted_stream(calls, budget)
        .writeStream.format("parquet").option("path", out)
        .option("checkpointLocation", checkpoint)
        .outputMode("append").trigger(availableNow=True)
        .start()
    )
