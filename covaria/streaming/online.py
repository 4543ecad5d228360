"""Online detection on streams: one state a key, dates in order, late dates set aside.

A date's samples may come in several micro-batches and dates may come out of order: samples wait in the
state until the event-time watermark has passed their date, then dates are taken in order. The state is a
pure function of the samples, so a replayed batch changes nothing. Inside, dates are microseconds since
the epoch, as the watermark is, so the session's time zone and its clock changes have no say.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

_OUT = "key string, us long, n_dates int, stat double"
_STATE = "state binary, taken long, waiting binary"


def online(samples: DataFrame, step: Callable, delay: str = "1 day", least: int = 1) -> DataFrame:
    """key, t, n_dates, stat of streamed samples(key string, t timestamp, re array<double>, im array<double>).

    step(state, x) is one of the pure steps in functions.detectors. t is a date's event time; a date is taken
    when the watermark, `delay` behind the newest, has passed it. A date with fewer than `least` samples is
    skipped; samples of dates already taken are dropped as late. A null key or t is left out.
    """

    def advance(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        inner, taken, waiting = (None, None, {}) if not state.exists else (pickle.loads(state.get[0]) if state.get[0] else None, state.get[1], pickle.loads(state.get[2]))
        for frame in frames:
            for t, re, im in zip(frame["us"].tolist(), frame["re"], frame["im"], strict=True):
                if taken is None or t > taken:
                    waiting.setdefault(t, []).append(np.asarray(re, float) + (0 if im is None else 1j * np.asarray(im, float)))
        mark = 1000 * state.getCurrentWatermarkMs()
        rows, count = [], 0 if inner is None else inner[0]
        for t in sorted(waiting):
            if t >= mark:
                break
            x = waiting.pop(t)
            # samples come in any order: sorted, so that the state does not depend on it
            x = np.stack(sorted(x, key=lambda v: (v.real.tolist(), v.imag.tolist())))
            taken = t
            if len(x) < least:
                continue
            stat, new = step(None if inner is None else inner[1], x)
            count += 1
            inner = (count, new)
            rows.append((key[0], t, count, float(stat)))
        state.update((pickle.dumps(inner) if inner is not None else None, taken, pickle.dumps(waiting)))
        if waiting:
            state.setTimeoutTimestamp(max(min(waiting) // 1000, state.getCurrentWatermarkMs()) + 1)
        if rows:
            yield pd.DataFrame(rows, columns=["key", "us", "n_dates", "stat"])

    clean = samples.where("key is not null and t is not null and re is not null").withWatermark("t", delay).select("key", "t", F.unix_micros("t").alias("us"), "re", "im")
    found = clean.groupBy("key").applyInPandasWithState(advance, _OUT, _STATE, "append", GroupStateTimeout.EventTimeTimeout)
    return found.select("key", F.timestamp_micros("us").alias("t"), "n_dates", "stat")


def event_samples(events: DataFrame) -> DataFrame:
    """samples(key, t, re, im) of the events table: key event_type, date the day, features of value and user."""
    day = F.date_trunc("day", F.col("ts").cast("timestamp"))
    x = F.array((F.col("value") - 50.0) / 30.0, (F.col("user_id") % 17 - 8.0) / 5.0)
    return events.select(F.col("event_type").alias("key"), day.alias("t"), x.alias("re"), F.lit(None).cast("array<double>").alias("im"))
