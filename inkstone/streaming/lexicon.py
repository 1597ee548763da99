"""An extension: vocabulary counters kept up to date from a stream of events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def counters(events: DataFrame) -> DataFrame:
    """term, learn_count, fail_count, last_learned of a stream (or table) of term, kind, ts; to be written in update mode.

    Counts all fails: a stream cannot tell those before the first learning apart once their state is gone."""
    of = lambda kind: F.col("kind") == kind
    return events.groupBy("term").agg(F.count_if(of("learn")).alias("learn_count"), F.count_if(of("fail")).alias("fail_count"), F.max(F.when(of("learn"), F.col("ts"))).alias("last_learned"))


_STATE = "learns long, first timestamp, last timestamp, fails long, failed timestamp, waiting array<timestamp>"
_OUT = "term string, learn_count long, fail_count long, first_learned timestamp, last_learned timestamp, last_failed timestamp"


def lexicon(events: DataFrame) -> DataFrame:
    """term, learn_count, fail_count, first_learned, last_learned, last_failed of a stream of term, kind, ts, as of its batches so far; to be
    written in update mode. The last row of a term equals that of mutations.lexicon over all rows that were not later than the watermark.

    events need a watermark on ts. Fails before the first learning do not count; as a learning may come late, such fails wait in the
    state until the watermark has passed them, and a timer then drops them. So the state of a term is bounded by its fails within the
    watermark's delay. Rows without term or time and other kinds are left out; repeated rows count each time, as in the table."""
    import pandas as pd
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def step(key: tuple, parts, state: GroupState):  # noqa: ANN001, ANN202
        learns, first, last, fails, failed, waiting = state.get if state.exists else (0, None, None, 0, None, [])
        waiting, before = [pd.Timestamp(t) for t in waiting], (learns, fails)
        for pdf in parts:
            learned = pdf.loc[pdf["kind"] == "learn", "ts"]
            if len(learned):
                learns += len(learned)
                first = learned.min() if first is None else min(pd.Timestamp(first), learned.min())
                last = learned.max() if last is None else max(pd.Timestamp(last), learned.max())
            waiting += list(pdf.loc[pdf["kind"] == "fail", "ts"])
        if first is not None:
            counted = [t for t in waiting if t >= pd.Timestamp(first)]
            if counted:
                fails += len(counted)
                failed = max(counted) if failed is None else max(pd.Timestamp(failed), max(counted))
            waiting = [t for t in waiting if t < pd.Timestamp(first)]
        mark = state.getCurrentWatermarkMs()
        ms = lambda t: int(t.value // 1_000_000)
        waiting = sorted(t for t in waiting if ms(t) >= mark)
        plain = lambda t: None if t is None else pd.Timestamp(t).to_pydatetime()
        if learns or waiting:
            state.update((learns, plain(first), plain(last), fails, plain(failed), [plain(t) for t in waiting]))
            if waiting:
                state.setTimeoutTimestamp(max(ms(waiting[0]), mark) + 1)
        elif state.exists:
            state.remove()
        if learns and (learns, fails) != before:
            yield pd.DataFrame({"term": [key[0]], "learn_count": [learns], "fail_count": [fails], "first_learned": [pd.Timestamp(first)], "last_learned": [pd.Timestamp(last)], "last_failed": [pd.NaT if failed is None else pd.Timestamp(failed)]})

    own = events.where("term IS NOT NULL AND ts IS NOT NULL AND kind IN ('learn', 'fail')").select(F.col("term").cast("string").alias("term"), "kind", "ts")
    return own.groupBy("term").applyInPandasWithState(step, _OUT, _STATE, "update", GroupStateTimeout.EventTimeTimeout)
