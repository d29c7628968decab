"""Structured Streaming forms of the stream operators."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tidemark.operators import decay
from tidemark.operators.book import Book


def read_events(spark: SparkSession, path: str, schema: T.StructType, files: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def timed(df: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Adds ``time`` from ts_us and its watermark."""
    return df.withColumn("time", F.timestamp_micros("ts_us")).withWatermark("time", late)


def ticks(trades: DataFrame, gap: str, late: str = "10 minutes") -> DataFrame:
    """One-sided trade bursts as session windows over (sym, buy): start, stop, n, ps."""
    return timed(trades, late).groupBy("sym", "buy", F.session_window("time", gap)).agg(F.count("*").alias("n"), F.sum(F.col("price") * F.col("size")).alias("ps")).select("sym", "buy", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("stop"), "n", "ps")


def periods(rows: DataFrame, value: str, period: str, late: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """n, min, max and sum of a value in tumbling (or sliding) windows by symbol."""
    window = F.window("time", period, slide) if slide else F.window("time", period)
    return timed(rows, late).groupBy("sym", window).agg(F.count("*").alias("n"), F.min(value).alias("min"), F.max(value).alias("max"), F.sum(value).alias("sum")).select("sym", F.col("window.start").alias("start"), "n", "min", "max", "sum")


class _Sampler(StatefulProcessor):
    """Counts valid trades of a key and passes every ``every``-th on."""

    def __init__(self, every: int):
        self.every = every

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.count = handle.getValueState("count", "n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        n = self.count.get()[0] if self.count.exists() else 0
        frames = list(rows)
        pdf = pd.concat(frames).sort_values(["ts_us", "seq"])
        place = n + 1 + pd.RangeIndex(len(pdf))
        self.count.update((n + len(pdf),))
        yield pdf[(place % self.every == 0)][["sym", "ts_us", "seq", "price", "size"]]

    def close(self) -> None:
        pass


def count_sample(trades: DataFrame, every: int) -> DataFrame:
    """Every ``every``-th trade of a symbol."""
    return trades.select("sym", "ts_us", "seq", "price", "size").groupBy("sym").transformWithStateInPandas(_Sampler(every), "sym string, ts_us long, seq long, price double, size double", "Append", "None")


class _BookState(StatefulProcessor):
    """A book side in map states; emits the best bid and ask after each message."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.sides = {s: handle.getMapState(f"side_{s}", "price double", "size double") for s in "BS"}

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        book = Book()
        for s, state in self.sides.items():
            for (price,), (size,) in state.iterator():
                book.apply(s, price, size)
        out = []
        for r in pd.concat(list(rows)).sort_values(["ts_us", "seq"]).itertuples():
            book.apply(r.side, float(r.price), float(r.size))
            if r.size == 0:
                if self.sides[r.side].containsKey((float(r.price),)):
                    self.sides[r.side].removeKey((float(r.price),))
            else:
                self.sides[r.side].updateValue((float(r.price),), (float(r.size),))
            bid, ask = book.levels("B", 1), book.levels("S", 1)
            ok = bool(bid and ask)
            out.append((key[0], r.ts_us, r.seq, bid[0]["price"] if ok else None, ask[0]["price"] if ok else None))
        yield pd.DataFrame(out, columns=["sym", "ts_us", "seq", "bid", "ask"])

    def close(self) -> None:
        pass


def best_quotes(depth: DataFrame) -> DataFrame:
    """Best bid and ask of each symbol after each level message, both NULL while a side is empty."""
    return depth.select("sym", "ts_us", "seq", "side", "price", "size").groupBy("sym").transformWithStateInPandas(_BookState(), "sym string, ts_us long, seq long, bid double, ask double", "Append", "None")


class _TickState(StatefulProcessor):
    """The open run of one-sided trades of a key; a run ends at a trade of the other side, after a gap, or when event time
    passes its last trade by ``idle_us``, with or without another trade."""

    SCHEMA = "sym string, buy boolean, start_us long, stop_us long, n long, ps double"

    def __init__(self, idle_us: int):
        self.idle_us = idle_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "buy boolean, start_us long, stop_us long, n long, ps double")

    def _frame(self, key, runs: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame([(key[0], *r) for r in runs], columns=[c.split()[0] for c in self.SCHEMA.split(", ")])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        run, done = (list(self.open.get()) if self.open.exists() else None), []
        for r in pd.concat(list(rows)).sort_values(["ts_us", "seq"]).itertuples():
            if run and (bool(r.buy) != run[0] or r.ts_us - run[2] >= self.idle_us):
                done.append(tuple(run))
                run = None
            if run is None:
                run = [bool(r.buy), int(r.ts_us), int(r.ts_us), 0, 0.0]
            run[2], run[3], run[4] = int(r.ts_us), run[3] + 1, run[4] + float(r.price) * float(r.size)
        self.open.update(tuple(run))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        # Timers have milliseconds; one that is due already fires when the watermark passes it.
        self.handle.registerTimer(-(-(run[2] + self.idle_us) // 1000))
        yield self._frame(key, done)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        runs = []
        if self.open.exists():
            run = self.open.get()
            if -(-(run[2] + self.idle_us) // 1000) <= expiredTimerInfo.getExpiryTimeInMs():
                runs.append(tuple(run))
                self.open.clear()
        yield self._frame(key, runs)

    def close(self) -> None:
        pass


def idle_ticks(trades: DataFrame, idle_us: int, late: str = "10 minutes") -> DataFrame:
    """Runs of one-sided trades of a symbol: buy, start_us, stop_us, n, ps, as soon as they are over.

    A run that no trade follows ends by a timer in event time, once the watermark (which any symbol's trades move) has
    passed it.
    """
    rows = timed(trades, late).select("sym", "time", "ts_us", "seq", "price", "size", "buy")
    return rows.groupBy("sym").transformWithStateInPandas(_TickState(idle_us), _TickState.SCHEMA, "Append", "EventTime")


def collated(streams: list[DataFrame], late: str = "10 minutes") -> DataFrame:
    """One stream of several, with ``source`` (the number of the stream), ``time`` and its watermark. Columns that a
    stream lacks are NULL."""
    numbered = [timed(s, late).withColumn("source", F.lit(i)) for i, s in enumerate(streams)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), numbered)


class _InOrder(StatefulProcessor):
    """Buffers a key's rows until the watermark has passed them, then takes them by time, source and seq.

    A key has one timer, for its earliest row (or its own next fire); when it fires it registers its successor. Rows are
    kept in a map state, so a restart goes on with those that wait.
    """

    #: Columns of the result, without the key.
    RESULT: str
    #: State besides the buffer.
    HELD: str

    def __init__(self, columns: list[str]):
        self.columns = columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "ts_us long, source int, seq long", ", ".join(f"{c} double" for c in self.columns))
        self.held = handle.getValueState("held", self.HELD)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        earliest = None
        for pdf in rows:
            values = pdf[self.columns].astype(object).where(pdf[self.columns].notna(), None)
            for ts, source, seq, *row in zip(pdf["ts_us"], pdf["source"], pdf["seq"], *[values[c] for c in self.columns]):
                self.waiting.updateValue((int(ts), int(source), int(seq)), tuple(None if v is None else float(v) for v in row))
                earliest = int(ts) if earliest is None else min(earliest, int(ts))
        timers = list(self.handle.listTimers())
        if earliest is not None and (not timers or min(timers) > _ms(earliest)):
            self._arm(earliest)
        yield self._frame(key, [])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        upto = timerValues.getCurrentWatermarkInMs() * 1000
        every = sorted(k for k, _ in self.waiting.iterator())
        state, out = (list(self.held.get()) if self.held.exists() else None), []
        due = [k for k in every if k[0] <= upto]
        for place in due:
            state = self.take(state, place, self.waiting.getValue(place), out)
            self.waiting.removeKey(place)
        state = self.pass_time(state, upto, out)
        if state is not None:
            self.held.update(tuple(state))
        after = [t for t in (every[len(due)][0] if len(due) < len(every) else None, self.next_fire(state)) if t is not None]
        if after:
            self._arm(min(after))
        yield self._frame(key, out)

    def _arm(self, ts_us: int) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(_ms(ts_us))

    def _frame(self, key, out: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame([(key[0], *r) for r in out], columns=["sym", *[c.strip().split()[0] for c in self.RESULT.split(",")]])

    def take(self, state, place: tuple, row: tuple, out: list[tuple]):
        """The state after a row."""
        raise NotImplementedError

    def pass_time(self, state, upto: int, out: list[tuple]):
        """The state once time has come to ``upto``."""
        return state

    def next_fire(self, state) -> int | None:
        return None

    def close(self) -> None:
        pass


def _ms(ts_us: int) -> int:
    return -(-ts_us // 1000)


class _AsOf(_InOrder):
    """Source 0 writes values, source 1 reads the last ones."""

    def __init__(self, columns: list[str]):
        super().__init__(columns)
        self.HELD = ", ".join(f"{c} double" for c in columns)
        self.RESULT = f"ts_us long, seq long, {self.HELD}"

    def take(self, state, place, row, out):
        ts, source, seq = place
        if source == 0:
            return list(row)
        out.append((ts, seq, *(state or [None] * len(row))))
        return state


def as_of(probes: DataFrame, data: DataFrame, columns: list[str], late: str = "10 minutes") -> DataFrame:
    """sym, ts_us, seq of each row of ``probes`` with the ``columns`` (doubles) of the last row of ``data`` at or before it:
    ``operators.events.as_of`` on two streams. Rows may come in any order within the watermark."""
    both = collated([data.select("sym", "ts_us", "seq", *columns), probes.select("sym", "ts_us", "seq")], late)
    made = _AsOf(columns)
    return both.groupBy("sym").transformWithStateInPandas(made, f"sym string, {made.RESULT}", "Append", "EventTime")


class _Future(_InOrder):
    """Source 0 is the series, source 1 what waits for a later value of it, taken at the time that it is due."""

    HELD = "value double"
    RESULT = "ts_us long, seq long, future double"

    def __init__(self, horizon_us: int):
        super().__init__(["value"])
        self.horizon_us = horizon_us

    def take(self, state, place, row, out):
        ts, source, seq = place
        if source == 0:
            return [row[0]]
        out.append((ts - self.horizon_us, seq, state[0] if state else None))
        return state


def future_value(rows: DataFrame, series: DataFrame, column: str, horizon_us: int, late: str = "10 minutes") -> DataFrame:
    """sym, ts_us, seq of each row with the value that ``column`` of ``series`` has ``horizon_us`` later, as soon as the
    watermark has passed that time: ``operators.events.future_value`` on streams."""
    due = rows.select("sym", (F.col("ts_us") + F.lit(horizon_us)).alias("ts_us"), "seq")
    both = collated([series.select("sym", "ts_us", "seq", F.col(column).cast("double").alias("value")), due], late)
    return both.groupBy("sym").transformWithStateInPandas(_Future(horizon_us), f"sym string, {_Future.RESULT}", "Append", "EventTime")


class _Ewma(_InOrder):
    """A timer every ``step_us`` from a key's first row on averages what the signal was just before it."""

    HELD = "due long, k long, signal double, average double"
    RESULT = "k long, ts_us long, signal double, ewma double"

    def __init__(self, half_life_us: int):
        super().__init__(["signal"])
        self.step_us, self.factor = decay.step_us(half_life_us), decay.factor(half_life_us)

    def _fire(self, state, upto: int, out) -> None:
        """All fires up to a time; a gap is caught up on."""
        due, k, signal, average = state
        while due <= upto:
            average = None if signal is None else signal if average is None else self.factor * average + (1 - self.factor) * signal
            out.append((k, due, signal, average))
            due, k = due + self.step_us, k + 1
        state[:] = due, k, signal, average

    def take(self, state, place, row, out):
        state = state or [place[0], 0, None, None]
        self._fire(state, place[0], out)
        state[2] = row[0]
        return state

    def pass_time(self, state, upto, out):
        if state is not None:
            self._fire(state, upto, out)
        return state

    def next_fire(self, state):
        return None if state is None else state[0]


def ewma(rows: DataFrame, column: str, half_life_us: int, late: str = "10 minutes") -> DataFrame:
    """sym, k, ts_us, signal, ewma at each fire of a timer that reschedules itself: ``operators.decay.ewma`` on a stream. Fires
    go on with the watermark, also where no row comes."""
    signal = collated([rows.select("sym", "ts_us", "seq", F.col(column).cast("double").alias("signal"))], late)
    return signal.groupBy("sym").transformWithStateInPandas(_Ewma(half_life_us), f"sym string, {_Ewma.RESULT}", "Append", "EventTime")
