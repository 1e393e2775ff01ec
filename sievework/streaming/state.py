"""Keyed streaming state: a token budget for each folder that holds across micro-batches and restarts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

#: Arbitrary state needs the store that keeps keys on disk.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

BUDGET = "folder string, id long, n long, cum long, closed boolean, parts map<string,long>"


class FolderBudget(StatefulProcessor):
    """For each folder the tokens seen so far, the tokens taken of each part, and a timer that ends an idle folder."""

    def __init__(self, budget: int, idle_ms: int):
        self.budget, self.idle = budget, idle_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "tokens long, taken long, rows long")
        self.parts = handle.getMapState("parts", "part string", "tokens long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        """The rows of one micro-batch, in the order of time and id, as far as the budget goes."""
        got = pd.concat(list(rows)).sort_values(["ms", "id"], kind="stable")
        seen, taken, count = self.seen.get() if self.seen.exists() else (0, 0, 0)
        got["cum"] = seen + got["n"].cumsum()
        kept = got[got["cum"] <= self.budget]
        self.seen.update((int(got["cum"].iloc[-1]), taken + int(kept["n"].sum()), count + len(kept)))
        for part, n in kept.groupby("part")["n"].sum().items():
            before = self.parts.getValue((part,))[0] if self.parts.containsKey((part,)) else 0
            self.parts.updateValue((part,), (before + int(n),))
        self._ends_at(int(got["ms"].max()) + self.idle)
        if len(kept):
            yield pd.DataFrame({"folder": key[0], "id": kept["id"], "n": kept["n"], "cum": kept["cum"], "closed": False, "parts": None})

    def _ends_at(self, ms: int) -> None:
        """One timer for each folder: the latest."""
        for t in list(self.handle.listTimers()):
            if t >= ms:
                ms = t
            else:
                self.handle.deleteTimer(t)
        self.handle.registerTimer(ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """An idle folder is closed: a last row with what was taken, by part; then its state goes."""
        if self.seen.exists():
            _, taken, count = self.seen.get()
            parts = {k[0]: v[0] for k, v in self.parts.iterator()}
            self.seen.clear()
            self.parts.clear()
            yield pd.DataFrame({"folder": [key[0]], "id": [None], "n": [count], "cum": [taken], "closed": [True], "parts": [parts]})

    def close(self) -> None:
        pass


def token_budget(stream: DataFrame, folder: Column, key: Column, n: Column, part: Column, ts: str, budget: int, delay: str, idle_ms: int) -> DataFrame:
    """(folder, id, n, cum, closed, parts): of each folder the rows in order of arrival while their total is within the budget.

    The rule is that of sampling.group_stop_before: the first row that overflows ends the folder.  Within a micro-batch rows
    come in the order of ts and key, so a folder's rows of one micro-batch are held together; the trigger bounds
    them.  After idle_ms of event time without rows a folder is closed: a row with closed true gives the rows
    taken (n), their tokens (cum) and the tokens of each part; a folder that comes again begins anew.
    Rows later than the watermark, and rows with a null folder, key, time or n, are left out.
    """
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    rows = stream.withWatermark(ts, delay).select(folder.cast("string").alias("folder"), key.cast("long").alias("id"), n.cast("long").alias("n"), F.coalesce(part.cast("string"), F.lit("")).alias("part"), F.unix_millis(ts).alias("ms"), ts)
    whole = rows.where("folder IS NOT NULL AND id IS NOT NULL AND n IS NOT NULL AND ms IS NOT NULL")
    return whole.groupBy("folder").transformWithStateInPandas(FolderBudget(budget, idle_ms), BUDGET, "append", "eventTime")
