"""Structured Streaming versions of the ordered-window and audit operators.

Each is a stateful map over groups: a group's rows of a micro-batch are put in order, its state is moved on, and its rows
come out. Run twice over the same input with the same checkpoint, they give nothing new.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.audit import EVENT_FIELDS
from ..operators.trends import LEAST
from ..plans.moments import BASES, last_fits, starts
from ..plans.storage import shared_folder


def run_available(stream: DataFrame, name: str) -> DataFrame:
    """Run a streaming table over all its input as a stream of micro-batches into Parquet, and read that."""
    spark = stream.sparkSession
    path = shared_folder(spark, name)
    q = stream.writeStream.format("parquet").option("path", f"{path}/data").option("checkpointLocation", f"{path}/checkpoint").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/data")


def read_stream(spark: SparkSession, table: DataFrame, path: str, glob: str | None = None) -> DataFrame:
    """A stream of Parquet files with the table's schema: those of a folder or, with `glob`, what it names there, files or folders of part files."""
    if glob:
        # A pattern of the path takes both: a filter of file names would leave out the parts of a folder. A pattern it must
        # be, since a stream's plain path has to be a folder.
        path = f"{path}/{glob if set(glob) & set('*?[{') else f'{glob[:-1]}[{glob[-1]}]'}"
    return spark.readStream.schema(table.schema).parquet(path)


def stream_windows(samples: DataFrame, width: int, key: str = "acquisition_id") -> DataFrame:
    """(key, window_order, n, mean): windows of `width` rows in the order of (ts, event_id), once they are full.

    Rows of later micro-batches come after those of earlier ones; the rest that fills no window waits in the state.
    """

    def run(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        order, held = state.get if state.exists else (0, [])
        rows = pd.concat(list(batches))
        values = [*held, *rows.sort_values(["ts", "event_id"])["value"].tolist()]
        out = []
        while len(values) >= width:
            out.append((k[0], order, width, float(np.mean(values[:width]))))
            order, values = order + 1, values[width:]
        state.update((order, values))
        yield pd.DataFrame(out, columns=[key, "window_order", "n", "mean"])

    kind = samples.schema[key].dataType.simpleString()
    return samples.groupBy(key).applyInPandasWithState(run, f"{key} {kind}, window_order long, n int, mean double", "window_order long, held array<double>", "append", GroupStateTimeout.NoTimeout)


class Prefixes:
    """The prefix sums of a series that later fits can ask for: those from the start of the second knot interval on.

    `sums` has the rows after `first`, ..., n values: sums of i^0 z .. i^3 z and z^2, z being the value less the first one.
    """

    def __init__(self, n: int, first: int, level: float, sums: np.ndarray) -> None:
        self.n, self.first, self.level, self.sums = n, first, level, list(sums)

    def add(self, y: float) -> None:
        if self.n == 0:
            self.level, self.sums = y, [np.zeros(5)]
        i, z = float(self.n), y - self.level
        self.sums.append(self.sums[-1] + np.array([z, i * z, i * i * z, i * i * i * z, z * z]))
        self.n += 1

    def fit(self, penalty: float) -> tuple[float, float, float]:
        """(value, slope, root mean square error) at the last value, from four prefix sums whatever the length."""
        return self.fits([self.n], penalty)[0]

    def fits(self, lengths: list[int], penalty: float) -> list[tuple[float, float, float]]:
        """The same after each of the lengths, rising from the one that the prefix sums were kept for: all in one go."""
        n = np.array(lengths)
        prefix = np.array([[np.zeros(5), *(self.sums[p - self.first] for p in places[1:])] for places in starts(n)])
        value, slope, error = last_fits(n, prefix, penalty)
        return list(zip((self.level + value).tolist(), slope.tolist(), error.tolist(), strict=True))

    def kept(self) -> tuple[int, np.ndarray]:
        """What later fits need: their second knot interval never starts before this length's."""
        first = int(starts(np.array([self.n]))[0][1]) if self.n > BASES else 0
        first = max(first, self.first)
        return first, np.array(self.sums[first - self.first :])


def online_trend(windows: DataFrame, key: str = "acquisition_id", penalty: float = 0.0, idle_ms: int | None = None) -> DataFrame:
    """(key, boundary, status, trend_value, first_derivative, fit_rmse) after every window of (key, window_order, y, boundary).

    A window beyond its observation boundary, and one that repeats or goes back, is rejected with its status and leaves the
    state alone; fits start with the fourth window, and a value that isn't finite ends them. The fit is that of all windows
    seen, from prefix sums: a window costs the same however long the series is. The state holds the sums of the last two
    thirds, which later knots can fall on. With `idle_ms` it goes when a series is idle for so many milliseconds; a stream that
    stops once its input is read then needs spark.sql.streaming.noDataMicroBatches.enabled to be false.
    """

    def run(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        n, first, last, level, flat = state.get if state.exists else (0, 0, None, 0.0, [])
        held, out, fitted = Prefixes(n, first, level, np.reshape(flat, (-1, 5))), [], {}
        for r in pd.concat(list(batches)).sort_values("arrival").itertuples():
            status = "FIT_OK"
            if r.window_order > r.boundary:
                status = "FUTURE_WINDOW_FORBIDDEN"
            elif last is not None and r.window_order <= last:
                status = "UNORDERED_WINDOWS"
            else:
                last = int(r.window_order)
                held.add(float(r.y))
                if held.n < LEAST:
                    status = "INSUFFICIENT_HISTORY"
                elif not np.isfinite(held.sums[-1]).all():
                    status = "NON_FINITE_SIGNAL"
                else:
                    fitted[len(out)] = held.n
            out.append((k[0], int(r.window_order), status, None, None, None))
        if fitted:
            for at, fit in zip(fitted, held.fits(list(fitted.values()), penalty), strict=True):
                out[at] = (*out[at][:3], *fit)
        first, sums = held.kept()
        state.update((held.n, first, last, held.level, sums.ravel().tolist()))
        if idle_ms is not None:
            state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame(out, columns=[key, "window_order", "status", "trend_value", "first_derivative", "fit_rmse"])

    kind = windows.schema[key].dataType.simpleString()
    return windows.groupBy(key).applyInPandasWithState(run, f"{key} {kind}, window_order long, status string, trend_value double, first_derivative double, fit_rmse double", "n long, first long, last long, level double, sums array<double>", "append", GroupStateTimeout.NoTimeout if idle_ms is None else GroupStateTimeout.ProcessingTimeTimeout)


def append_audit(events: DataFrame, run_id: str = "run_id") -> DataFrame:
    """(run_id, event_index, payload, previous_event_hash, event_hash): a chain that goes on from the state's last hash."""

    def run(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        index, last = state.get if state.exists else (0, "")
        out = []
        for payload in pd.concat(list(batches)).sort_values("event_index")["payload"]:
            index += 1
            h = hashlib.sha256(f"{last}|{index}|{payload}".encode()).hexdigest()
            out.append((k[0], index, payload, last, h))
            last = h
        state.update((index, last))
        yield pd.DataFrame(out, columns=[run_id, "event_index", "payload", "previous_event_hash", "event_hash"])

    kind = events.schema[run_id].dataType.simpleString()
    return events.groupBy(run_id).applyInPandasWithState(run, f"{run_id} {kind}, event_index long, payload string, previous_event_hash string, event_hash string", "event_index long, last string", "append", GroupStateTimeout.NoTimeout)


def append_events(rows: DataFrame, schema_version: str = "1.0") -> DataFrame:
    """Full audit events of a stream: each batch's rows go on from the run's last index and hash, in the order of event_index.

    The twin of `audit_events` for fields that are texts: those that the rows have are taken as texts, others are null. The
    state of a run is one number and one hash, so it stays small however long the run is. What comes out is verified by
    `verify_chain` as it stands.
    """
    told = [f for f in EVENT_FIELDS if f in rows.columns and f not in ("run_id", "event_id", "event_index", "schema_version", "previous_event_hash", "event_hash")]

    def run(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        index, last = state.get if state.exists else (0, None)
        out = []
        for row in pd.concat(list(batches)).sort_values(["event_index", *told])[told].itertuples(index=False):
            index += 1
            event: dict = dict.fromkeys(EVENT_FIELDS) | {f: None if pd.isna(v) else v for f, v in zip(told, row, strict=True)}
            event |= {"schema_version": schema_version, "run_id": k[0], "event_index": index, "event_id": f"{k[0]}:{index:06d}", "previous_event_hash": last}
            del event["event_hash"]
            last = hashlib.sha256(json.dumps(event, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
            out.append([last if f == "event_hash" else event[f] for f in EVENT_FIELDS])
        state.update((index, last))
        yield pd.DataFrame(out, columns=list(EVENT_FIELDS))

    e = rows.select(F.col("run_id").cast("string").alias("run_id"), F.col("event_index").cast("long").alias("event_index"), *[F.col(f).cast("string").alias(f) for f in told])
    kinds = ", ".join(f"{f} {'long' if f == 'event_index' else 'string'}" for f in EVENT_FIELDS)
    return e.groupBy("run_id").applyInPandasWithState(run, kinds, "event_index long, last string", "append", GroupStateTimeout.NoTimeout)
