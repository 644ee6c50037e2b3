"""Price history of a stream: a point is kept when value or store changes."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

STATE = "value double, store string, seen long"


def price_changes(points: DataFrame) -> DataFrame:
    """points: key string, ts timestamp, value double, store string. State per key is
    the last kept value and store and the time of the last point seen. Points of a
    batch are taken in order of time, those without a value are ignored. A point of a
    later batch that is older than one seen before is late and left out, as what
    follows it has been given out already; equal times are not late."""

    def step(key, batches, state: GroupState):
        last, seen = (tuple(state.get)[:2], state.get[2]) if state.exists else (None, None)
        kept = []
        pdf = pd.concat([b.loc[b["value"].notna(), ["ts", "value", "store"]] for b in batches]).sort_values(["ts", "value", "store"], kind="stable")
        for row in pdf.itertuples():
            if seen is not None and row.ts.value < seen:
                continue
            if last is None or (row.value, row.store) != last:
                kept.append((key[0], row.ts, row.value, row.store))
                last = (row.value, row.store)
            seen = row.ts.value
        if last is not None:
            state.update((*last, seen))
        yield pd.DataFrame(kept, columns=["key", "ts", "value", "store"])

    return points.groupBy("key").applyInPandasWithState(step, "key string, ts timestamp, value double, store string", STATE, "append", GroupStateTimeout.NoTimeout)
