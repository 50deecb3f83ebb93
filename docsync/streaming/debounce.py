"""Debouncing: the first event of a key opens a window, later ones join it until it is due.

Which events open windows depends on all earlier ones of the key. A key with few moments is folded in
order, inside one row. One key may also hold a third of all events; such keys are never gathered.
For them every event points to the event that would open the next window if it opened one itself,
and following those pointers from events that open a window for certain finds all the others.
Pointers are doubled each round, so a chain of a million windows takes twenty rounds.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from datetime import timedelta

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from docsync.session import cut_lineage

KEYS = ("handler", "web", "path")

# A key with at most this many different moments is folded in one row.
FOLD_LIMIT = 1000

# Time is cut into cells, and cells into blocks of this many; a block is at least one gap long.
CELLS = 1024

WINDOW = "struct<opened:bigint,n:bigint,last:bigint>"


def _micros(gap: timedelta) -> int:
    micros = gap // timedelta(microseconds=1)
    if micros <= 0:
        raise ValueError("gap must be positive")
    return micros


def _start(moment: Column, length: int) -> Column:
    """Start of the stretch of ``length`` microseconds a moment lies in."""
    return moment - F.pmod(moment, F.lit(length).cast("bigint"))


def _folded(points: DataFrame, keys: list[str], gap: int) -> DataFrame:
    """Windows ``(keys, opened, n, last)`` of keys with at most ``FOLD_LIMIT`` moments each."""
    closed_and_open = F.struct(
        F.array().cast(f"array<{WINDOW}>").alias("closed"), F.lit(None).cast(WINDOW).alias("open")
    )

    def step(state: Column, point: Column) -> Column:
        window = state["open"]
        joins = window.isNotNull() & (point["_t"] < window["opened"] + gap)
        joined = F.struct(
            window["opened"].alias("opened"), (window["n"] + point["_n"]).alias("n"),
            point["_last"].alias("last"),
        )
        opened = F.struct(
            point["_t"].alias("opened"), point["_n"].alias("n"), point["_last"].alias("last")
        )
        closed = F.when(joins | window.isNull(), state["closed"]).otherwise(
            F.concat(state["closed"], F.array(window))
        )
        return F.struct(closed.alias("closed"), F.when(joins, joined).otherwise(opened).alias("open"))

    in_order = F.sort_array(F.collect_list(F.struct("_t", "_n", "_last")))
    windows = F.aggregate(
        "_points", closed_and_open, step, lambda s: F.concat(s["closed"], F.array(s["open"]))
    )
    rows = points.groupBy(*keys).agg(in_order.alias("_points"))
    return rows.select(*keys, F.inline(windows))


def _next_openers(
    points: DataFrame, blocks: DataFrame, keys: list[str], gap: int, cell: int
) -> DataFrame:
    """``(keys, _src, _dst)``: for each point the first point at least ``gap`` later, as far as the
    end of the block after the one ``_src + gap`` falls in; beyond that a point opens for certain.

    Groups are cells of one key (bounded by the microseconds in a cell) and cells of one block
    (at most ``CELLS`` rows).
    """
    asked = points.select(
        *keys, F.inline(F.array(
            F.struct(F.col("_t").alias("_x"), F.lit(None).cast("bigint").alias("_src")),
            F.struct((F.col("_t") + gap).alias("_x"), F.col("_t").alias("_src")),
        ))
    ).withColumn("_cell", _start(F.col("_x"), cell))
    point_x = F.when(F.col("_src").isNull(), F.col("_x"))
    # Latest first, points before questions at the same moment: the running minimum is the answer.
    later_in_cell = (
        Window.partitionBy(*keys, "_cell")
        .orderBy(F.desc("_x"), F.col("_src").asc_nulls_first())
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    answered = asked.withColumn("_dst", F.min(point_x).over(later_in_cell))
    cells = (
        asked.groupBy(*keys, "_cell")
        .agg(F.min(point_x).alias("_first"))
        .withColumn("_block", _start(F.col("_cell"), cell * CELLS))
    )
    later_in_block = (
        Window.partitionBy(*keys, "_block")
        .orderBy(F.desc("_cell"))
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    next_block = blocks.select(
        *keys, (F.col("_block") - cell * CELLS).alias("_block"), F.col("_first").alias("_next_first")
    )
    after = (
        cells.withColumn("_after", F.min("_first").over(later_in_block))
        .join(next_block, [*keys, "_block"], "left")
        .select(*keys, "_cell", F.coalesce("_after", "_next_first").alias("_after"))
    )
    return (
        answered.filter(F.col("_src").isNotNull())
        .join(after, [*keys, "_cell"], "left")
        .select(*keys, "_src", F.coalesce("_dst", "_after").alias("_dst"))
        .filter(F.col("_dst").isNotNull())
    )


def _openers(points: DataFrame, keys: list[str], gap: int, cell: int) -> DataFrame:
    """``(keys, _t)``: every point that opens a window."""
    blocks = cut_lineage(
        points.groupBy(*keys, _start(F.col("_t"), cell * CELLS).alias("_block")).agg(
            F.min("_t").alias("_first"), F.max("_t").alias("_last")
        ),
        "debounce",
    )
    # Certain: the first point of a block, with no point in the gap before it.
    before = blocks.select(
        *keys, (F.col("_block") + cell * CELLS).alias("_block"), F.col("_last").alias("_prev")
    )
    certain = blocks.join(before, [*keys, "_block"], "left").filter(
        F.col("_prev").isNull() | (F.col("_first") - F.col("_prev") >= gap)
    )
    found = cut_lineage(certain.select(*keys, F.col("_first").alias("_t")), "debounce")
    at_dst = found.withColumnRenamed("_t", "_dst")
    hops = _next_openers(points, blocks, keys, gap, cell)
    hops = cut_lineage(hops.join(at_dst, [*keys, "_dst"], "left_anti"), "debounce")
    hops = hops.select(*keys, "_src", "_dst")
    while True:
        new = found.withColumnRenamed("_t", "_src").join(hops, [*keys, "_src"])
        new = new.select(*keys, F.lit(None).cast("bigint").alias("_src"), "_dst")
        onward = hops.select(*keys, F.col("_src").alias("_dst"), F.col("_dst").alias("_next"))
        doubled = hops.join(onward, [*keys, "_dst"])
        doubled = doubled.select(*keys, "_src", F.col("_next").alias("_dst"))
        # One write per round holds both: openers just found have no source.
        both = cut_lineage(new.unionByName(doubled), "debounce")
        new = both.filter("_src is null").select(*keys, F.col("_dst").alias("_t"))
        if new.isEmpty():
            return found
        found = found.unionByName(new)
        hops = both.filter("_src is not null")


def _pointed(points: DataFrame, keys: list[str], gap: int) -> DataFrame:
    """Windows ``(keys, opened, n, last)`` of keys of any size."""
    cell = -(-gap // CELLS)
    block = cell * CELLS
    first_block = _start(F.col("_t"), block)
    windows = _openers(points.select(*keys, "_t"), keys, gap, cell).select(
        *keys,
        F.col("_t").alias("opened"),
        # A window reaches into the block it opens in and the one after.
        F.explode(F.array(first_block, first_block + block)).alias("_block"),
    )
    return (
        points.withColumn("_block", _start(F.col("_t"), block))
        .join(windows, [*keys, "_block"])
        .filter((F.col("opened") <= F.col("_t")) & (F.col("_t") < F.col("opened") + gap))
        .groupBy(*keys, "opened")
        .agg(F.sum("_n").alias("n"), F.max_by("_last", "_t").alias("last"))
    )


def debounce_events(
    events: DataFrame, gap: timedelta, keys: Sequence[str] = KEYS
) -> DataFrame:
    """``(keys, opened, due, n_events, last_event)``, one row per window.

    The first event of a key opens a window due ``gap`` later. Events before ``due`` join it, the
    next one opens a new window. ``last_event`` is the id of the window's latest event: the handler
    runs at ``due`` and sees the latest state. ``events`` has the keys, ``ts`` and ``event_id``.
    """
    keys, gap_us = list(keys), _micros(gap)
    # Events of one key at one moment count as one point from here on.
    points = cut_lineage(
        events.groupBy(*keys, F.unix_micros("ts").alias("_t")).agg(
            F.count("*").alias("_n"), F.max("event_id").alias("_last")
        ),
        "debounce",
    )
    counted = points.groupBy(*keys).agg(F.count("*").alias("_moments"))
    large = cut_lineage(counted.filter(F.col("_moments") > FOLD_LIMIT).select(*keys), "debounce")
    if large.isEmpty():
        windows = _folded(points, keys, gap_us)
    else:
        windows = _folded(points.join(large, keys, "left_anti"), keys, gap_us).unionByName(
            _pointed(cut_lineage(points.join(large, keys, "left_semi"), "debounce"), keys, gap_us)
        )
    return windows.select(
        *keys,
        F.timestamp_micros("opened").alias("opened"),
        F.timestamp_micros(F.col("opened") + gap_us).alias("due"),
        F.col("n").alias("n_events"),
        F.col("last").alias("last_event"),
    )


def _joined(window: list | None, t: np.ndarray, n: np.ndarray, last: np.ndarray, gap: int) -> tuple[list, list | None]:
    """Windows that points in order close, and the one left open; jumps from opener to opener."""
    sums, closed, i = np.concatenate(([0], np.cumsum(n))), [], 0
    while i < len(t):
        if window is not None and t[i] >= window[0] + gap:
            closed.append(window)
            window = None
        opened = int(t[i]) if window is None else window[0]
        end = int(np.searchsorted(t, opened + gap))
        window = [opened, int(sums[end] - sums[i]) + (window[1] if window else 0), int(last[end - 1])]
        i = end
    return closed, window


def debounce_stream(
    events: DataFrame, gap: timedelta, delay: str = "10 seconds", keys: Sequence[str] = KEYS
) -> DataFrame:
    """The streaming form of ``debounce_events``: a window is emitted once the watermark passes its
    ``due``. Events may come in any order within ``delay``: they wait until the watermark has passed them
    and are then taken in order, so the result is that of the batch form.

    Events of one moment count as one point as soon as they are read, one Arrow batch at a time. State per
    key is its open window and the points that wait; a task holds the points of one key, of one micro-batch
    and ``delay``, and goes from window to window over them, not from event to event."""
    keys, gap_us = list(keys), _micros(gap)
    out = [f"`{k}` string" for k in keys]
    out += ["opened timestamp", "due timestamp", "n_events bigint", "last_event bigint"]
    state_schema = "opened bigint, n bigint, last bigint, points string"

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        window, waiting = None, []
        if state.exists:
            *window, points = state.get
            window = None if window[0] is None else window
            if points:
                found = np.array(points.split(","), np.int64).reshape(-1, 3)
                waiting.append(pd.DataFrame(found, columns=["t", "n", "last"]))
        if not state.hasTimedOut:
            for rows in batches:
                waiting.append(rows.groupby("t", as_index=False).agg(n=("event_id", "size"), last=("event_id", "max")))
        points = pd.concat(waiting) if waiting else pd.DataFrame({"t": [], "n": [], "last": []}, dtype="int64")
        points = points.groupby("t", as_index=False).agg({"n": "sum", "last": "max"})
        watermark = state.getCurrentWatermarkMs() * 1000
        t, n, last = (points[c].to_numpy(np.int64) for c in ("t", "n", "last"))
        # No event up to the watermark can still come.
        done = int(np.searchsorted(t, watermark, "right"))
        closed, window = _joined(window, t[:done], n[:done], last[:done], gap_us)
        if window is not None and window[0] + gap_us - 1 <= watermark:
            closed.append(window)
            window = None
        left = np.stack((t[done:], n[done:], last[done:]), axis=1)
        if window is not None or len(left):
            state.update((*(window or (None, None, None)), ",".join(map(str, left.ravel().tolist()))))
            # Called again when the window is due or a point is no longer to wait.
            moments = ([window[0] + gap_us] if window else []) + left[:1, 0].tolist()
            state.setTimeoutTimestamp(max(-(-min(moments) // 1000), state.getCurrentWatermarkMs() + 1))
        elif state.exists:
            state.remove()
        if closed:
            frame = pd.DataFrame(closed, columns=["opened", "n_events", "last_event"])
            for i, k in enumerate(keys):
                frame[k] = key[i]
            frame["due"] = pd.to_datetime(frame["opened"] + gap_us, unit="us", utc=True)
            frame["opened"] = pd.to_datetime(frame["opened"], unit="us", utc=True)
            yield frame[[*keys, "opened", "due", "n_events", "last_event"]]

    timed = events.withWatermark("ts", delay).select(
        *keys, "ts", F.unix_micros("ts").alias("t"), "event_id"
    )
    return timed.groupBy(*keys).applyInPandasWithState(
        fold, ", ".join(out), state_schema, "append", GroupStateTimeout.EventTimeTimeout
    )
