"""Work that must finish in time, and calls that fail in a row.

The batch functions answer over stored logs. The stream versions take the rows of a
key in the order of their event times, across micro-batches, and give the same answers
once the watermark has passed; a key that has nothing open keeps no state.
"""

from __future__ import annotations

import sys
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tallyspark.operators.ordered import fitting_time_block, neighbours, running_totals
from tallyspark.schema import TERMINAL_STATUSES

# executors get the processors by value and need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def polling_budget(attempts: int = 30, first: float = 1.5, factor: float = 1.5, longest: float = 12.0) -> float:
    """Seconds from a poller's first look to its last: growing delays up to a longest one, one between two looks."""
    return sum(min(first * factor**i, longest) for i in range(attempts - 1))


def _after(ts: Column, seconds: float) -> Column:
    return F.timestamp_micros(F.unix_micros(ts) + F.lit(round(seconds * 1_000_000)))


def readiness(reports: DataFrame, budget_seconds: float, terminal: Sequence[str] = TERMINAL_STATUSES) -> DataFrame:
    """Per drawing: its first final status, or `timeout` when none came in time."""
    final = F.col("status").isin(*terminal)
    moment = F.when(final, F.struct("ts", "status"))
    seen = reports.groupBy("drawing_id").agg(F.min("ts").alias("started"), F.min(moment).alias("first"))
    in_time = F.col("first.ts") <= _after(F.col("started"), budget_seconds)
    return seen.select(
        "drawing_id",
        "started",
        F.when(in_time, F.col("first.status")).otherwise("timeout").alias("outcome"),
        F.when(in_time, F.col("first.ts")).alias("finished"),
    )


def stuck_work(log: DataFrame, started: str, seconds: float = 300.0, block_seconds: int | None = None) -> DataFrame:
    """Started entries whose key shows no later entry within the allowed time."""
    near = neighbours(
        log, ["key"], ["ts", "event_id"], fitting_time_block(log, "ts", block_seconds), following={"ts": "next_ts"}
    )
    late = F.col("next_ts").isNull() | (F.col("next_ts") > _after(F.col("ts"), seconds))
    return near.where((F.col("status") == started) & late).select("key", "event_id", "ts", "next_ts")


def failure_runs(log: DataFrame, least: int = 3, cool_down_seconds: float = 30.0, block_seconds: int | None = None) -> DataFrame:
    """Runs of consecutive failures per key, and when the breaker opened and closed.

    Failures between two successes share the difference of two running counts.
    """
    counted = running_totals(
        log,
        ["key"],
        [F.col("ts"), F.col("event_id")],
        fitting_time_block(log, "ts", block_seconds),
        {"n_all": F.lit(1).cast("long"), "n_failed": F.col("failed").cast("long")},
    )
    failed = counted.where(F.col("failed")).select("key", "ts", "n_failed", (F.col("n_all") - F.col("n_failed")).alias("island"))
    runs = (
        failed.groupBy("key", "island")
        .agg(F.min("ts").alias("started"), F.count("*").alias("failures"), F.min("n_failed").alias("first_no"))
        .where(F.col("failures") >= least)
        .withColumn("n_failed", F.col("first_no") + least - 1)
    )
    opening = failed.select("key", "n_failed", F.col("ts").alias("opened"))
    return runs.join(opening, ["key", "n_failed"]).select(
        "key", "started", "failures", "opened", _after(F.col("opened"), cool_down_seconds).alias("closes")
    )


def _packed(table: pd.DataFrame) -> bytes:
    sink = pa.BufferOutputStream()
    batch = pa.RecordBatch.from_pandas(table, preserve_index=False)
    with pa.ipc.new_stream(sink, batch.schema) as writer:
        writer.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _unpacked(packed: Iterable[bytes]) -> pd.DataFrame | None:
    tables = [pa.ipc.open_stream(pa.py_buffer(bytes(b))).read_all() for b in packed]
    return pa.concat_tables(tables).to_pandas() if tables else None


def _reached(code: np.ndarray, us: np.ndarray, of: np.ndarray, until: np.ndarray) -> np.ndarray:
    """For each (of, until) the number of rows, which are in order, up to it."""
    order = np.lexsort((np.repeat([0, 1], [len(us), len(until)]), np.append(us, until), np.append(code, of)))
    rows = order < len(us)
    found = np.empty(len(until), "int64")
    found[order[~rows] - len(us)] = np.cumsum(rows)[~rows]
    return found


class InOrder(StatefulProcessor):
    """Hands on the rows of many keys in the order of their times, each once the watermark has passed it.

    Keys are dealt to groups by hash, and the rows of a group are taken together as arrays: a call of the state
    costs the same for one key as for thousands. Rows wait in a list state, a packed piece for
    each delivery; the watermark lets no earlier row in after it has passed. A timer at the group's earliest
    moment releases all rows up to the watermark. `taken` gets what is kept of the keys (`KEPT`) and their rows
    in order, with `code`, the number of the key, and returns the columns to emit, with the code of
    their key, what is to be kept, and for each kept key the next moment, in microseconds,
    at which it changes by itself. A key whose rows are released and whose state has run out keeps nothing.
    """

    KEPT: tuple[str, ...] = ()

    def __init__(self, key: str):
        self.key = key

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "rows BINARY")
        self.kept = handle.getValueState("kept", "rows BINARY")

    def words(self, table: pd.DataFrame) -> pd.Series:
        raise NotImplementedError

    def taken(self, kept: pd.DataFrame, rows: pd.DataFrame, now: int) -> tuple[dict[str, np.ndarray], pd.DataFrame, np.ndarray]:
        raise NotImplementedError

    def timer(self, us: int) -> None:
        self.handle.registerTimer(-(-us // 1000))  # the first millisecond not before

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        earliest = None
        for table in rows:
            us = table["ts"].to_numpy("datetime64[us]").astype("int64")
            ids = table["event_id"].to_numpy() if "event_id" in table else np.zeros(len(table), "int64")
            words = self.words(table).fillna("").astype(str)
            piece = {"key": table[self.key].to_numpy(), "no_key": table["no_key"].to_numpy(), "us": us, "event_id": ids, "word": words.to_numpy()}
            self.waiting.appendList([(_packed(pd.DataFrame(piece)),)])
            earliest = int(us.min()) if earliest is None else min(earliest, int(us.min()))
        # an earlier timer looks at all that waits and sets the next one
        if earliest is not None and not any(first <= -(-earliest // 1000) for first in self.handle.listTimers()):
            self.timer(earliest)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        rows = _unpacked(piece for (piece,) in self.waiting.get()) if self.waiting.exists() else None
        if rows is None:
            rows = pd.DataFrame({c: np.array([], kind) for c, kind in (("key", "int64"), ("no_key", bool), ("us", "int64"), ("event_id", "int64"), ("word", object))})
        ready = rows["us"].to_numpy() <= now
        rest = rows[~ready]
        if ready.any() and len(rest):
            self.waiting.put([(_packed(rest),)])
        elif len(rows) and not len(rest):
            self.waiting.clear()
        rows = rows[ready]
        kept = _unpacked(self.kept.get()) if self.kept.exists() else None
        had = kept is not None
        if not had:
            kept = pd.DataFrame({c: np.array([], "int64") for c in ("key", "no_key", *self.KEPT)})
        names = pd.concat([kept[["key", "no_key"]], rows[["key", "no_key"]]]).astype({"key": "int64", "no_key": bool})
        code = names.groupby(["key", "no_key"], sort=True).ngroup().to_numpy()
        firsts = np.unique(code, return_index=True)[1]
        names = names.iloc[firsts]
        kept = kept.drop(columns=["key", "no_key"]).assign(code=code[: len(kept)]).sort_values("code", ignore_index=True)
        rows = rows.drop(columns=["key", "no_key"]).assign(code=code[len(code) - len(rows) :]).sort_values(["code", "us", "event_id", "word"], ignore_index=True)
        found, after, moments = self.taken(kept, rows, now)
        if len(after):
            own = names.iloc[after["code"].to_numpy()].reset_index(drop=True)
            self.kept.update((_packed(pd.concat([own, after.drop(columns="code").reset_index(drop=True)], axis=1)),))
        elif had:
            self.kept.clear()
        later = np.append(rest["us"].to_numpy(), moments)
        if len(later):
            self.timer(int(later.min()))
        own = names.iloc[found.pop("code")]
        keys = pd.arrays.IntegerArray(own["key"].to_numpy("int64"), own["no_key"].to_numpy(bool))
        return iter((pd.DataFrame({self.key: keys, **found}),) if len(keys) else ())

    def close(self) -> None:
        pass


class Deadline(InOrder):
    """The first final status of a key within its budget, or a timeout, decided once the watermark has passed the budget.

    Reports up to `forget_seconds` after the budget belong to the same work; later ones start anew.
    """

    KEPT = ("started", "status", "decided")

    def __init__(self, key: str, budget_seconds: float, terminal: Sequence[str], forget_seconds: float):
        super().__init__(key)
        self.budget, self.forget = round(budget_seconds * 1_000_000), round(forget_seconds * 1_000_000)
        self.terminal = tuple(terminal)

    def words(self, table: pd.DataFrame) -> pd.Series:
        return table["status"]

    def taken(self, kept, rows, now):
        code, us, words = (rows[c].to_numpy() for c in ("code", "us", "word"))
        n, span = len(us), self.budget + self.forget
        final = np.isin(words.astype(str), self.terminal)
        next_final = np.minimum.accumulate(np.where(final, np.arange(n), n)[::-1])[::-1]
        ends = np.searchsorted(code, code, "right")
        next_work = _reached(code, us, code, us + span)  # of work that starts with a row
        outcomes, left = [], []

        def judged(who, started, status, decided, begin, end, work_end):
            """Decide what can be decided of one piece of work of each key; returns where the next one starts."""
            final_at = np.append(next_final, n)[begin]
            hit = (final_at < work_end) & (np.append(us, 0)[final_at] <= started + self.budget)
            status = np.where((status == "") & hit, np.append(words, "")[final_at], status)
            over = (work_end < end) | (started + span <= now)
            due = ~decided & (over | (started + self.budget <= now))
            outcomes.append((who[due], np.where(status == "", "timeout", status)[due]))
            decided = decided | due
            left.append(pd.DataFrame({"code": who, "started": started, "status": status, "decided": decided})[~over])
            return work_end[over & (work_end < end)]

        who = kept["code"].to_numpy("int64")
        begin, end = np.searchsorted(code, who, "left"), np.searchsorted(code, who, "right")
        started = kept["started"].to_numpy("int64")
        starts = judged(who, started, kept["status"].to_numpy(object), kept["decided"].to_numpy(bool), begin, end, _reached(code, us, who, started + span))
        heads = np.flatnonzero(np.diff(code, prepend=-1) != 0)
        starts = np.append(starts, heads[~np.isin(code[heads], who)])
        while len(starts):
            fresh = np.full(len(starts), "", object), np.zeros(len(starts), bool)
            starts = judged(code[starts], us[starts], *fresh, starts, ends[starts], next_work[starts])
        found = {"code": np.concatenate([c for c, _ in outcomes]).astype("int64"), "outcome": np.concatenate([o for _, o in outcomes])}
        after = pd.concat(left, ignore_index=True)
        moments = after["started"].to_numpy("int64") + self.budget + np.where(after["decided"].to_numpy(bool), self.forget, 0)
        return found, after, moments


def _behind_kept(kept: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
    """Rows in order, each key's behind what is kept of it (`old`); `first` and `last` tell where a key begins and ends."""
    both = pd.concat([kept.assign(old=True), rows.assign(old=False)], ignore_index=True)
    both = both.sort_values("code", kind="stable", ignore_index=True)
    edge = np.diff(both["code"].to_numpy("int64"), prepend=-1, append=-1) != 0
    return both.assign(first=edge[:-1], last=edge[1:])


class StuckWork(InOrder):
    """Started entries that no entry of their key follows within the budget."""

    KEPT = ("us", "event_id")

    def __init__(self, key: str, started: str, budget_seconds: float):
        super().__init__(key)
        self.started, self.budget = started, round(budget_seconds * 1_000_000)

    def words(self, table: pd.DataFrame) -> pd.Series:
        return table["status"]

    def taken(self, kept, rows, now):
        both = _behind_kept(kept.assign(word=self.started), rows)
        us, last = both["us"].to_numpy("int64"), both["last"].to_numpy()
        started = both["word"].to_numpy().astype(str) == self.started
        until = np.where(last, now, np.append(us[1:], 0)) - us
        stuck = started & np.where(last, until >= self.budget, until > self.budget)
        found = both.loc[stuck, ["code", "event_id"]]
        after = both.loc[started & last & ~stuck, ["code", "us", "event_id"]]
        return {c: found[c].to_numpy("int64") for c in found}, after, after["us"].to_numpy("int64") + self.budget


class Breaker(InOrder):
    """When a key has failed the given number of times in a row.

    A success ends a run, and so does a pause of over `forget_seconds`, after which nothing of the key is kept.
    """

    KEPT = ("us", "failures")

    def __init__(self, key: str, least: int, forget_seconds: float):
        super().__init__(key)
        self.least, self.forget = least, round(forget_seconds * 1_000_000)

    def words(self, table: pd.DataFrame) -> pd.Series:
        return table["failed"].map({True: "failed", False: ""}).fillna("")

    def taken(self, kept, rows, now):
        # what is kept stands for a row that has failed as often as it counts
        both = _behind_kept(kept.assign(word="failed"), rows.assign(failures=1))
        us, first, old = both["us"].to_numpy("int64"), both["first"].to_numpy(), both["old"].to_numpy(bool)
        failed = both["word"].to_numpy().astype(str) == "failed"
        times = np.where(failed, both["failures"].to_numpy("int64"), 0)
        count = np.cumsum(times)
        anew = first | ~failed | (np.diff(us, prepend=us[:1]) > self.forget)
        runs = count - np.maximum.accumulate(np.where(anew, count - times, 0)) if len(us) else count
        opened = failed & ~old & (runs == self.least)
        found = {"code": both["code"].to_numpy("int64")[opened], "opened": us[opened].astype("datetime64[us]")}
        keep = both["last"].to_numpy() & (runs > 0) & (us + self.forget > now)
        after = pd.DataFrame({"code": both["code"].to_numpy("int64")[keep], "us": us[keep], "failures": runs[keep]})
        return found, after, us[keep] + self.forget


GROUPS = 1024


def _by_group(rows: DataFrame, key: str, delay: str, groups: int):
    """Keys dealt to groups by hash; a null key is a key."""
    dealt = rows.withColumns(
        {"group_no": F.pmod(F.xxhash64(key), F.lit(groups)).cast("int"), "no_key": F.col(key).isNull(), key: F.coalesce(F.col(key).cast("long"), F.lit(0))}
    )
    return dealt.withWatermark("ts", delay).groupBy("group_no")


def readiness_stream(
    reports: DataFrame, budget_seconds: float, terminal: Sequence[str] = TERMINAL_STATUSES, delay: str = "10 seconds", forget_seconds: float = 86_400.0, groups: int = GROUPS
) -> DataFrame:
    """Needs the RocksDB state store; `reports` is a stream of (drawing_id, status, ts).

    A group of keys is worked on in memory, so `groups` is to grow with the rows that wait for the watermark.
    """
    return _by_group(reports, "drawing_id", delay, groups).transformWithStateInPandas(
        Deadline("drawing_id", budget_seconds, terminal, forget_seconds), "drawing_id long, outcome string", "Append", "EventTime"
    )


def stuck_work_stream(log: DataFrame, started: str, seconds: float = 300.0, delay: str = "10 seconds", groups: int = GROUPS) -> DataFrame:
    """Needs the RocksDB state store; `log` is a stream of (key, event_id, status, ts)."""
    return _by_group(log, "key", delay, groups).transformWithStateInPandas(
        StuckWork("key", started, seconds), "key long, event_id long", "Append", "EventTime"
    )


def breaker_stream(log: DataFrame, least: int = 3, delay: str = "10 seconds", forget_seconds: float = 86_400.0, groups: int = GROUPS) -> DataFrame:
    """Needs the RocksDB state store; `log` is a stream of (key, event_id, failed, ts)."""
    return _by_group(log, "key", delay, groups).transformWithStateInPandas(
        Breaker("key", least, forget_seconds), "key long, opened timestamp", "Append", "EventTime"
    )
