"""Alert lifecycle as a stateful stream: every raise creates an alert, an acknowledgement closes the one
it names, and what nobody acknowledged expires by its level.

State per (region, cell) is the list of open alerts with their expiries. An acknowledgement counts when
its event time is before the expiry; expiries are told by the watermark through event-time timers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from gridgale.constants import ALERT_TTL_HOURS, DEFAULT_ALERT_TTL_HOURS

STATE = "ids array<long>, levels array<string>, expires_ms array<long>"
CHANGES = "region_code string, cell long, alert_id long, at timestamp, change string, severity string"
_WRITTEN = [c.split()[0] for c in CHANGES.split(", ")]
_READ = ["at_ms", "is_ack", "alert_id", "severity"]


def _order(row: tuple) -> tuple:
    """By time, raises before acknowledgements (rows of unknown kind last), then by alert."""
    at, is_ack, alert, _ = row
    return at, 2 if is_ack is None else int(is_ack), alert


def _play(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    out: list[tuple[int, int, str, str]] = []
    # Expiry and level of each open alert, in the order they were raised.
    open_alerts = {i: (x, level) for i, level, x in zip(*state.get, strict=True)} if state.exists else {}

    def record(alert: int, ms: int, change: str, level: str) -> None:
        out.append((alert, ms, change, level))

    if state.hasTimedOut:
        now = state.getCurrentWatermarkMs()
        for alert, (expiry, level) in list(open_alerts.items()):
            if expiry < now:
                record(alert, expiry, "expired", level)
                del open_alerts[alert]
    else:
        # Plain lists: a group has few rows, and a table operation costs more than reading them all.
        for at, is_ack, alert, severity in sorted(
            (row for rows in batches for row in zip(*(rows[c].tolist() for c in _READ), strict=True)), key=_order
        ):
            at = int(at)
            if not is_ack:
                hours = ALERT_TTL_HOURS.get(severity, DEFAULT_ALERT_TTL_HOURS)
                open_alerts[alert] = (at + hours * 3_600_000, severity)
                record(alert, at, "created", severity)
            elif alert in open_alerts and at < open_alerts[alert][0]:
                record(alert, at, "acknowledged", open_alerts.pop(alert)[1])
    if open_alerts:
        state.update((
            list(open_alerts), [level for _, level in open_alerts.values()], [x for x, _ in open_alerts.values()],
        ))
        # A timer must lie ahead of the watermark; one already due fires at the next batch.
        soonest = min(x for x, _ in open_alerts.values())
        state.setTimeoutTimestamp(max(soonest, state.getCurrentWatermarkMs() + 1))
    elif state.exists:
        state.remove()
    if out:
        alerts, ms, changes, levels = zip(*out, strict=True)
        yield pd.DataFrame(dict(zip(
            _WRITTEN,
            (key[0], key[1], alerts, pd.to_datetime(np.array(ms, np.int64), unit="ms"), changes, levels),
            strict=True,
        )))


def alert_lifecycle(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """``events``: region_code, cell, event_time, kind ('raise' | 'ack'), severity, alert_id."""
    rows = events.withWatermark("event_time", delay).filter("alert_id IS NOT NULL").select(
        "region_code", "cell", "event_time", "severity", "alert_id",
        (F.col("kind") == "ack").alias("is_ack"), F.unix_millis("event_time").alias("at_ms"),
    )
    return rows.groupBy("region_code", "cell").applyInPandasWithState(
        _play, CHANGES, STATE, "append", GroupStateTimeout.EventTimeTimeout
    )
