"""Operators that Structured Streaming rejects, as keyed state processors.

Each processor's state is one key's; nothing is held for all keys. Outputs are changelogs (op +I, -U, +U, -D) or appends
that event-time timers release when the watermark allows.
"""

from __future__ import annotations

import heapq
import pickle
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import UTC, datetime
from decimal import ROUND_HALF_UP, Context, Decimal

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidemill.functions.numeric import INT_BITS


def _millis(t: datetime) -> int:
    return int((t.replace(tzinfo=UTC) if t.tzinfo is None else t).timestamp() * 1000)


def _dump(row: dict) -> bytes:
    """A row for a state column: the state's own encoding doesn't take rows within rows."""
    return pickle.dumps(tuple(row.values()), protocol=5)


def _load(raw: bytes, names: list[str]) -> dict:
    """As a dictionary, which is what an output's nested rows are made from."""
    return dict(zip(names, pickle.loads(bytes(raw)), strict=True))


def _fields(*pairs: tuple[str, str]) -> str:
    return ", ".join(f"`{n}` {t}" for n, t in pairs)


_EXACT = Context(prec=76)


def _total_type(kind: str) -> str:
    """Sums of integers are kept as decimals of 38 digits, so that a removal undoes what only the result wraps."""
    return "decimal(38,0)" if kind in INT_BITS else re.sub(r"decimal\(\d+", "decimal(38", kind)


def _kept(total, kind: str):
    return Decimal(total) if total is not None and kind in INT_BITS else total


def _quotient(total, n: int):
    """Integers truncate toward zero."""
    if isinstance(total, float):
        return total / n
    if isinstance(total, Decimal) and total.as_tuple().exponent < 0:
        return _EXACT.divide(total, n).quantize(total, ROUND_HALF_UP, _EXACT)
    return abs(int(total)) // n * (1 if total >= 0 else -1)


def _typed(x, kind: str):
    """A result in the argument's type: integers wrap."""
    if kind not in INT_BITS:
        return x
    bits = INT_BITS[kind]
    return (int(x) + (1 << bits - 1)) % (1 << bits) - (1 << bits - 1)


def _changelog(df: DataFrame, columns: list[str]) -> str:
    return _fields(("op", "string"), *((c, df.schema[c].dataType.simpleString()) for c in columns))


class KeepLast(StatefulProcessor):
    """Row-time deduplication that keeps the last row: first +I, then -U and +U; an earlier row changes nothing.

    A row without a time is earlier than all others.
    """

    def __init__(self, columns: list[str], kinds: str, ts: str):
        self.columns, self.kinds, self.ts = columns, kinds, ts

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.row = Row("op", *self.columns)
        self.last = handle.getValueState("last", self.kinds)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        at = self.columns.index(self.ts)
        now = tuple(self.last.get()) if self.last.exists() else None
        for row in sorted((tuple(r[c] for c in self.columns) for r in rows), key=lambda r: (r[at] is not None, r[at])):
            if now is None:
                yield self.row("+I", *row)
            elif now[at] is None or row[at] is not None and row[at] >= now[at]:
                if row == now:
                    continue
                yield self.row("-U", *now)
                yield self.row("+U", *row)
            else:
                continue
            now = row
        self.last.update(now)

    def close(self) -> None:
        pass


class TopN(StatefulProcessor):
    """The n rows of a key with the highest value (ties: the smaller tie column): +I and -D as rows enter and leave.

    Equal rows count one by one; a NULL value is lower than all others, a NULL tie greater.
    """

    def __init__(self, columns: list[str], kinds: str, by: str, tie: str, n: int):
        self.columns, self.kinds, self.by, self.tie, self.n = columns, kinds, by, tie, n

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.row = Row("op", *self.columns)
        self.top = handle.getListState("top", self.kinds)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        by, tie = self.columns.index(self.by), self.columns.index(self.tie)
        old = [tuple(r) for r in self.top.get()] if self.top.exists() else []
        order = lambda r: (r[by] is None, 0 if r[by] is None else -r[by], r[tie] is None, 0 if r[tie] is None else r[tie])
        new = heapq.nsmallest(self.n, [*old, *(tuple(r[c] for c in self.columns) for r in rows)], key=order)
        left, entered = Counter(old) - Counter(new), Counter(new) - Counter(old)
        for r in left.elements():
            yield self.row("-D", *r)
        for r in entered.elements():
            yield self.row("+I", *r)
        self.top.put(new)

    def close(self) -> None:
        pass


class DistinctCount(StatefulProcessor):
    """COUNT(DISTINCT value) of a key over a changelog; value counts make removals exact.

    A key whose last row is removed goes (-D) and starts anew with its next one. A removal may come before its row.
    """

    def __init__(self, keys: list[str], value: str, kind: str):
        self.keys, self.value, self.kind = keys, value, kind

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.row = Row("op", *self.keys, "n")
        self.times = handle.getMapState("times", f"value {self.kind}", "n bigint")
        self.total = handle.getValueState("total", "n bigint, held bigint, shown boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        before, held, shown = self.total.get() if self.total.exists() else (0, 0, False)
        total = before
        for r in rows:
            value, step = (r[self.value],), (1 if r["op"] in ("+I", "+U") else -1)
            held += step
            if value[0] is None:
                continue
            n = self.times.getValue(value)[0] if self.times.containsKey(value) else 0
            total += (n <= 0 < n + step) - (n > 0 >= n + step)
            if n + step:
                self.times.updateValue(value, (n + step,))
            elif n:
                self.times.removeKey(value)
        if held > 0 and not shown:
            yield self.row("+I", *key, total)
        elif held > 0 and total != before:
            yield self.row("-U", *key, before)
            yield self.row("+U", *key, total)
        elif held <= 0 and shown:
            yield self.row("-D", *key, before)
        self.total.update((total, held, held > 0))

    def close(self) -> None:
        pass


@dataclass(frozen=True)
class Call:
    """An aggregate call: COUNT, SUM, AVG, MIN or MAX of a column (COUNT: or of rows), DISTINCT and FILTER (a condition)."""

    kind: str
    column: str | None = None
    distinct: bool = False
    where: str | None = None

    @property
    def by_value(self) -> bool:
        """Whether a removal can only be answered from how often each value is there."""
        return self.distinct or self.kind in ("MIN", "MAX")


class GroupAggregate(StatefulProcessor):
    """Any aggregate calls of a key over a changelog, with one change out for each key and batch.

    A call's state is a number of values and their sum; calls that depend on single values also count each of them. An
    extremum that was removed is searched for once a batch, among the key's values. A key whose last row is removed goes
    (-D) and starts anew with its next one; a removal may come before its row. NULL arguments are passed over.
    """

    def __init__(self, keys: list[str], calls: list[Call], kinds: list[str], ttl: int | None):
        self.keys, self.calls, self.kinds, self.ttl = keys, calls, kinds, ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.row = Row("op", *self.keys, *(f"c{i}" for i in range(len(self.calls))))
        state = _fields(("held", "bigint"), ("shown", "boolean"), *(p for i, k in enumerate(self.kinds) for p in ((f"n{i}", "bigint"), (f"t{i}", _total_type(k)))))
        self.total = handle.getValueState("total", state, self.ttl)
        self.times = {i: handle.getMapState(f"times{i}", f"value {k}", "n bigint", self.ttl) for i, (c, k) in enumerate(zip(self.calls, self.kinds, strict=True)) if c.by_value}

    def _add(self, i: int, value, step: int) -> int:
        """Counts a value of a call; 1 if it is there now and was not before, -1 the other way round."""
        times = self.times[i]
        n = times.getValue((value,))[0] if times.containsKey((value,)) else 0
        if n + step:
            times.updateValue((value,), (n + step,))
        else:
            times.removeKey((value,))
        return (n <= 0 < n + step) - (n > 0 >= n + step)

    def _result(self, i: int, n: int, total):
        kind = self.calls[i].kind
        if kind == "COUNT":
            return n
        if n <= 0 or total is None:
            return None
        return _typed(_quotient(total, n) if kind == "AVG" else total, self.kinds[i])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        state = self.total.get() if self.total.exists() else (0, False, *(None, None) * len(self.calls))
        held, shown = state[:2]
        sums = [[state[2 + 2 * i] or 0, state[3 + 2 * i]] for i in range(len(self.calls))]
        before = [self._result(i, *s) for i, s in enumerate(sums)]
        search = set()
        for r in rows:
            sign = 1 if r["op"] in ("+I", "+U") else -1
            held += sign
            for i, call in enumerate(self.calls):
                value = r[f"c{i}"]
                if value is None:
                    continue
                step = self._add(i, value, sign) if call.by_value else sign
                sums[i][0] += step
                total = sums[i][1]
                if call.kind in ("SUM", "AVG"):
                    sums[i][1] = _EXACT.add(total or 0, step * value) if isinstance(value, Decimal) else (total or 0) + step * value
                elif call.by_value and step > 0 and call.kind != "COUNT":
                    sums[i][1] = value if total is None else (max if call.kind == "MAX" else min)(total, value)
                elif call.by_value and step < 0 and value == total:
                    search.add(i)
        for i in search:
            there = (v[0] for v, n in self.times[i].iterator() if n[0] > 0)
            sums[i][1] = (max if self.calls[i].kind == "MAX" else min)(there, default=None)
        now = [self._result(i, *s) for i, s in enumerate(sums)]
        if held > 0 and not shown:
            yield self.row("+I", *key, *now)
        elif held > 0 and now != before:
            yield self.row("-U", *key, *before)
            yield self.row("+U", *key, *now)
        elif held <= 0 and shown:
            yield self.row("-D", *key, *before)
        self.total.update((held, held > 0, *(x for i, (n, t) in enumerate(sums) for x in (n, _kept(t, self.kinds[i])))))

    def close(self) -> None:
        pass


class OuterJoin(StatefulProcessor):
    """A left outer equi join without watermarks: a row pads with NULLs until its first match retracts that."""

    def __init__(self, left: list[str], right: list[str]):
        self.columns = (left, right)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.row = Row("op", "key", "l", "r")
        self.left = handle.getListState("left", "v binary")
        self.right = handle.getListState("right", "v binary")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        lefts = [_load(r[0], self.columns[0]) for r in self.left.get()] if self.left.exists() else []
        rights = [_load(r[0], self.columns[1]) for r in self.right.get()] if self.right.exists() else []
        for r in rows:
            if r["side"] == 0:
                left = r["l"]
                lefts.append(left)
                self.left.appendValue((_dump(r["l"]),))
                for x in rights:
                    yield self.row("+I", *key, left, x)
                if not rights:
                    yield self.row("+I", *key, left, None)
            else:
                right = r["r"]
                for x in lefts:
                    if not rights:
                        yield self.row("-D", *key, x, None)
                    yield self.row("+I", *key, x, right)
                rights.append(right)
                self.right.appendValue((_dump(r["r"]),))

    def close(self) -> None:
        pass


class TemporalJoin(StatefulProcessor):
    """Event-time temporal join: a probe row waits until the watermark passes its time, then meets the latest version."""

    def __init__(self, probe: list[str], build: list[str], inner: bool):
        self.columns, self.inner = (probe, build), inner

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.row = Row("key", "l", "r")
        self.handle = handle
        self.versions = handle.getMapState("versions", "t bigint", "v binary")
        self.probes = handle.getListState("probes", "t bigint, v binary")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        for r in rows:
            t = _millis(r["t"])
            if r["side"] == 1:
                self.versions.updateValue((t,), (_dump(r["r"]),))
            else:
                self.probes.appendValue((t, _dump(r["l"])))
                self.handle.registerTimer(t + 1)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = expiredTimerInfo.getExpiryTimeInMs()
        versions = sorted(((k[0], v[0]) for k, v in self.versions.iterator()), key=lambda x: x[0])
        waiting = []
        for t, probe in (tuple(p) for p in self.probes.get()) if self.probes.exists() else ():
            if t >= now:
                waiting.append((t, bytes(probe)))
                continue
            found = [v for at, v in versions if at <= t]
            if found or not self.inner:
                yield self.row(*key, _load(probe, self.columns[0]), _load(found[-1], self.columns[1]) if found else None)
        self.probes.put(waiting) if waiting else self.probes.clear()
        # Versions before the latest one that the watermark has passed can't be met again.
        passed = [at for at, _ in versions if at < now]
        for at in passed[:-1]:
            self.versions.removeKey((at,))

    def close(self) -> None:
        pass


class RunningSum(StatefulProcessor):
    """OVER (ORDER BY event time ROWS UNBOUNDED PRECEDING): rows wait for the watermark, then go out in time order."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.row = Row("key", "seq", "v", "running")
        self.handle = handle
        self.rows = handle.getListState("rows", "t bigint, seq bigint, v bigint")
        self.total = handle.getValueState("total", "v bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        for r in rows:
            t = _millis(r["t"])
            self.rows.appendValue((t, r["seq"], r["v"]))
            self.handle.registerTimer(t + 1)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = expiredTimerInfo.getExpiryTimeInMs()
        held = [tuple(r) for r in self.rows.get()] if self.rows.exists() else []
        total = self.total.get()[0] if self.total.exists() else 0
        for _, seq, v in sorted(r for r in held if r[0] < now):
            total += v or 0
            yield self.row(*key, seq, v, total)
        self.total.update((total,))
        rest = [r for r in held if r[0] >= now]
        self.rows.put(rest) if rest else self.rows.clear()

    def close(self) -> None:
        pass


def keep_last(df: DataFrame, keys: list[str], ts: str) -> DataFrame:
    columns = df.columns
    kinds = _fields(*((f.name, f.dataType.simpleString()) for f in df.schema))
    return df.groupBy(*keys).transformWithState(KeepLast(columns, kinds, ts), _changelog(df, columns), "Update", "None")


def top_n(df: DataFrame, keys: list[str], by: str, tie: str, n: int) -> DataFrame:
    columns = df.columns
    kinds = _fields(*((f.name, f.dataType.simpleString()) for f in df.schema))
    return df.groupBy(*keys).transformWithState(TopN(columns, kinds, by, tie, n), _changelog(df, columns), "Update", "None")


def distinct_count(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    kind = df.schema[value].dataType.simpleString()
    out = _changelog(df, keys) + ", n bigint"
    return df.groupBy(*keys).transformWithState(DistinctCount(keys, value, kind), out, "Update", "None")


def group_aggregate(df: DataFrame, keys: list[str], calls: dict[str, Call], ttl: int | None = None) -> DataFrame:
    """The changelog of SELECT keys, calls GROUP BY keys over a changelog (columns op and others).

    With ttl, a key's state ends so many milliseconds after its last change; a stream with it does not end by itself, not
    even with availableNow, because Spark goes on to look for state that is over.
    """
    argument = lambda c: F.expr(c.column) if c.column else F.lit(1)
    values = [(F.when(F.expr(c.where), argument(c)) if c.where else argument(c)).alias(f"c{i}") for i, c in enumerate(calls.values())]
    rows = df.select("op", *keys, *values)
    kinds = [rows.schema[f"c{i}"].dataType.simpleString() for i in range(len(calls))]
    results = [(f"c{i}", "bigint" if c.kind == "COUNT" else kinds[i]) for i, c in enumerate(calls.values())]
    out = f"{_changelog(df, keys)}, {_fields(*results)}"
    found = rows.groupBy(*keys).transformWithState(GroupAggregate(keys, list(calls.values()), kinds, ttl), out, "Update", "None" if ttl is None else "ProcessingTime")
    return found.withColumnsRenamed({f"c{i}": name for i, name in enumerate(calls)})


def _tagged(left: DataFrame, right: DataFrame, key: str, ts: str | None = None) -> tuple[DataFrame, str, str]:
    """Both sides in one relation (key, side, l, r[, t]), so that one processor sees a key's rows of both."""
    lk, rk = (T.StructType(list(x.schema)).simpleString() for x in (left, right))
    l_cols = [F.col(key).alias("key"), F.lit(0).alias("side"), F.struct(*left.columns).alias("l"), F.lit(None).cast(rk).alias("r")]
    r_cols = [F.col(key).alias("key"), F.lit(1).alias("side"), F.lit(None).cast(lk).alias("l"), F.struct(*right.columns).alias("r")]
    if ts:
        l_cols, r_cols = [*l_cols, F.col(ts).alias("t")], [*r_cols, F.col(ts).alias("t")]
    return left.select(*l_cols).unionByName(right.select(*r_cols)), lk, rk


def left_outer_join(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    both, lk, rk = _tagged(left, right, key)
    kind = left.schema[key].dataType.simpleString()
    return both.groupBy("key").transformWithState(OuterJoin(left.columns, right.columns), f"op string, key {kind}, l {lk}, r {rk}", "Update", "None")


def temporal_join(probe: DataFrame, build: DataFrame, key: str, ts: str, delay: str, inner: bool = False) -> DataFrame:
    """Probe and build rows with the same key and time columns; rows (key, l, r) go out as the watermark passes them."""
    both, lk, rk = _tagged(probe, build, key, ts)
    both = both.withColumn("t", F.col("t").cast("timestamp")).withWatermark("t", delay)
    kind = probe.schema[key].dataType.simpleString()
    return both.groupBy("key").transformWithState(TemporalJoin(probe.columns, build.columns, inner), f"key {kind}, l {lk}, r {rk}", "Append", "EventTime")


def running_sum(df: DataFrame, key: str, ts: str, seq: str, value: str, delay: str) -> DataFrame:
    rows = df.select(F.col(key).alias("key"), F.col(ts).cast("timestamp").alias("t"), F.col(seq).cast("bigint").alias("seq"), F.col(value).cast("bigint").alias("v"))
    kind = df.schema[key].dataType.simpleString()
    return rows.withWatermark("t", delay).groupBy("key").transformWithState(RunningSum(), f"key {kind}, seq bigint, v bigint, running bigint", "Append", "EventTime")
