"""Live views over arriving metric events (event_id, experiment_id, run_id, metric, step, value)."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues


def str_live_best(stream: DataFrame, by: tuple[str, ...] = ("experiment_id", "run_id"), step: str = "step", value: str = "value") -> DataFrame:
    """Best (smallest) and last value of each run so far; output mode update or complete. Works on batches too."""
    return stream.groupBy(*by).agg(F.min(value).alias("best_value"), F.max_by(value, step).alias("last_value"), F.count(F.lit(1)).alias("n"))


def keep_states(stream: DataFrame) -> None:
    """Let the session keep streams' states in RocksDB, which the processors below need."""
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


#: Parts that runs are dealt to. A part's runs share one state, so that a batch fetches and stores a state for a part and not for each run.
PARTS = 4096


class Smooth(StatefulProcessor):
    """The last ``window`` points of each run's metric by step, and the number and sum of all; for the runs of a part."""

    def __init__(self, window: int):
        self.window = window

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.part = handle.getValueState("part", "runs binary")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        held = self.part.get()
        runs = pickle.loads(bytes(held[0])) if held else {}  # (run_id, metric) -> points, n, total
        new: dict[tuple, list] = {}
        for r in rows:  # batches may come out of order
            new.setdefault((r.run_id, r.metric), []).append((r.step, r.value))
        out = []
        for run, more in new.items():
            points, n, total = runs.get(run, ([], 0, 0.0))
            for _, value in more:
                total += value
            n += len(more)
            points = sorted(points + more)[-self.window :]
            runs[run] = points, n, total
            values = [v for _, v in points]
            out.append(Row(run_id=run[0], metric=run[1], n=n, median=sorted(values)[(len(values) - 1) // 2], avg=sum(values) / len(values), global_avg=total / n, last=values[-1]))
        self.part.update((pickle.dumps(runs, pickle.HIGHEST_PROTOCOL),))
        return iter(out)

    def close(self) -> None:
        pass


def str_smoothed(stream: DataFrame, window: int = 20) -> DataFrame:
    """Per run and metric, after each batch: median (lower middle) and mean of the last ``window`` steps, mean of all, last value. Points without a value are left out."""
    keep_states(stream)
    part = F.pmod(F.xxhash64("run_id", "metric"), F.lit(PARTS)).cast("int").alias("part")
    rows = stream.filter("step IS NOT NULL AND value IS NOT NULL").select(part, "run_id", "metric", "step", "value")
    return rows.groupBy("part").transformWithState(Smooth(window), "run_id long, metric string, n long, median double, avg double, global_avg double, last double", "Update", "None")


#: Steps of a run that wait beside its state; where more wait, those that come later are put away by chunks of so many.
CHUNK = 4096


class Stop(StatefulProcessor):
    """The best step of each run of a part and where it stopped. Steps are 1, 2, ...; those that come before their turn wait, and a timer ends the wait."""

    def __init__(self, by: tuple[str, ...], patience: int, wait_ms: int | None):
        self.by, self.patience, self.wait_ms = by, patience, wait_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.part = handle.getValueState("part", "runs binary")
        self.far = handle.getMapState("far", "run binary, chunk long", "steps binary")

    def _start(self) -> tuple[int | None, dict]:
        """When the part's timer ends, and its runs: best, best_step, idle, stopped, seen, waiting steps, chunks put away, when the wait ends."""
        held = self.part.get()
        return pickle.loads(bytes(held[0])) if held else (None, {})

    def _take(self, run: list, step: int, value: float) -> None:
        run[4] = step
        if value < run[0]:
            run[:3] = value, step, 0
        else:
            run[2] += 1
            if run[2] >= self.patience:
                run[3] = step

    def _back(self, key: tuple, run: list, chunk: int) -> None:
        """A chunk that was put away, beside the run's state again."""
        at = (pickle.dumps(key), chunk)
        run[5] = pickle.loads(bytes(self.far.getValue(at)[0])) | run[5]
        self.far.removeKey(at)
        run[6].remove(chunk)

    def _rest(self, key: tuple, run: list) -> None:
        """What need not stay beside the state: all after a stop, since it changes nothing, and of many steps those of later chunks."""
        if run[3] >= 0:
            for chunk in run[6]:
                self.far.removeKey((pickle.dumps(key), chunk))
            run[5:] = {}, set(), None
        elif len(run[5]) > CHUNK:
            now, later = (run[4] + 1) // CHUNK, {}
            for step in [s for s in run[5] if s // CHUNK > now]:
                later.setdefault(step // CHUNK, {})[step] = run[5].pop(step)
            for chunk, steps in later.items():
                at = (pickle.dumps(key), chunk)
                if chunk in run[6]:
                    steps = pickle.loads(bytes(self.far.getValue(at)[0])) | steps
                self.far.updateValue(at, (pickle.dumps(steps, pickle.HIGHEST_PROTOCOL),))
                run[6].add(chunk)

    def _end(self, timer: int | None, runs: dict, met: list[tuple]) -> Iterator[Row]:
        due = min((r[7] for r in runs.values() if r[7] is not None), default=None) if self.wait_ms is not None else None
        if due != timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            if due is not None:
                self.handle.registerTimer(due)
        self.part.update((pickle.dumps((due, runs), pickle.HIGHEST_PROTOCOL),))
        for key in met:
            best, best_step, _, stopped = runs[key][:4]
            yield Row(**dict(zip(self.by, key, strict=True)), best_step=best_step, best_value=best, stopped_at=stopped if stopped >= 0 else None)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        timer, runs = self._start()
        met: dict[tuple, dict] = {}
        for r in rows:  # part, by, step, value
            met.setdefault(tuple(r[1:-2]), {})[r[-2]] = r[-1]
        for name, new in met.items():
            run = runs.setdefault(name, [float("inf"), -1, 0, -1, 0, {}, set(), None])
            if run[3] < 0:
                run[5].update((s, v) for s, v in new.items() if s > run[4])
            while run[3] < 0:
                step = run[4] + 1
                if step // CHUNK in run[6]:
                    self._back(name, run, step // CHUNK)
                if step not in run[5]:
                    break
                self._take(run, step, run[5].pop(step))
            self._rest(name, run)
            waits = self.wait_ms is not None and (run[5] or run[6])
            run[7] = timerValues.getCurrentProcessingTimeInMs() + self.wait_ms if waits else None
        return self._end(timer, runs, list(met))

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:
        _, runs = self._start()
        now = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentProcessingTimeInMs())
        over = [name for name, run in runs.items() if run[7] is not None and run[7] <= now]
        for name in over:
            run = runs[name]
            while run[3] < 0 and (run[5] or run[6]):
                chunk = min([s // CHUNK for s in run[5]] + list(run[6]))
                if chunk in run[6]:
                    self._back(name, run, chunk)
                for step in sorted(s for s in run[5] if s // CHUNK == chunk):
                    value = run[5].pop(step)
                    if run[3] < 0:
                        self._take(run, step, value)
            self._rest(name, run)
            run[7] = None
        return self._end(None, runs, over)

    def close(self) -> None:
        pass


def str_early_stop(stream: DataFrame, patience: int, by: tuple[str, ...] = ("run_id",), wait_ms: int | None = None) -> DataFrame:
    """Per run, after each batch: best step so far, and the step at which ``patience`` steps had passed without strict improvement.

    With ``wait_ms``, for streams that go on, a run whose next step doesn't come in that time goes on with the steps that it has;
    steps that come later than that are left out. Without it they wait; a stream that ends when all is read (availableNow)
    needs that, since Spark keeps a stream with timers open.
    """
    keep_states(stream)
    kinds = dict(stream.dtypes)
    keys = ", ".join(f"{b} {kinds[b]}" for b in by)
    part = F.pmod(F.xxhash64(*by), F.lit(PARTS)).cast("int").alias("__part")
    rows = stream.select(part, *by, F.col("step").cast("long").alias("step"), F.col("value").cast("double").alias("value")).filter("step IS NOT NULL AND value IS NOT NULL")
    return rows.groupBy("__part").transformWithState(Stop(tuple(by), patience, wait_ms), f"{keys}, best_step long, best_value double, stopped_at long", "Update", "None" if wait_ms is None else "ProcessingTime")


def run_available(stream_out: DataFrame, path: str, mode: str = "update") -> DataFrame:
    """Run a streaming frame over what is there, each batch's rows into a folder of its own under ``path`` (which all executors
    see), and return all of them, with the batch's number in the column ``batch``. A batch that runs again replaces its folder."""

    def put(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/rows/batch={batch}")

    spark = stream_out.sparkSession
    query = stream_out.writeStream.foreachBatch(put).outputMode(mode).option("checkpointLocation", f"{path}/progress").trigger(availableNow=True).start()
    query.awaitTermination()
    schema = T.StructType([*stream_out.schema.fields, T.StructField("batch", T.IntegerType())])
    if query.lastProgress is None:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{path}/rows")
