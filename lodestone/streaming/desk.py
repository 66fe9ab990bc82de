"""The review desk: edits of watched files, the operators' commands on them and their undoing as one keyed state.

An input (path, sequence, ts, kind, sha256, command_id, expected, target) is an edit or a command; those of a path come in the
order of their sequence. The state of a path is its accepted content, the pending item, the log of what was processed, which
log entries were undone, and the commands that were seen:

* EDIT: content that is the accepted one withdraws the item; other content makes or replaces it. An item that nobody
  touches for ``delay`` seconds is accepted by itself, at a time in event time.
* ACCEPT takes the item's candidate (or removes what is gone), REJECT restores the accepted content, HOLD leaves the item to
  a person: no timer takes it. ``expected`` names the candidate that the operator saw ('' if it was gone, null unchecked);
  another one is a conflict and changes nothing.
* RESTORE undoes the log entry whose sequence is ``target`` and all later ones, last first: the accepted content and the item
  are those from before it, and the item waits for a person. Entries undone before are answered as such.
* A command_id that was seen in the last ``KEPT`` seconds answers REPLAY, or CONFLICT where it named another kind of command.

The same fold runs over a stream, with the state in Spark's store (``desk_stream``), and over stored inputs, path by path in
sorted partitions (``desk_batch``): neither holds more than the state of one path.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

INPUT = "path string, sequence bigint, ts timestamp, kind string, sha256 string, command_id string, expected string, target bigint"
OUTPUT = "path string, sequence bigint, change string, accepted string, candidate string, undone int"
COLUMNS = [c.split()[0] for c in OUTPUT.split(", ")]

VALUE = "accepted string, pending boolean, candidate string, auto boolean, since double, sequence bigint"
ENTRY = "at bigint, sequence bigint, accepted string, candidate string"
#: For how many seconds of event time a command_id or an undone entry is known.
KEPT = 90 * 24 * 3600.0


def known(mapping, key, now: float):
    """What a mapping of (value, time) has for a key, unless it is too old."""
    found = mapping.get(key)
    return found[0] if found is not None and now - found[1] < KEPT else None


class Desk:
    """The state of a path. ``commands`` and ``undone`` are mappings; whoever keeps the state brings its own."""

    def __init__(self, path: str, delay: float, value: tuple | None, log: Iterable[tuple], commands, undone):
        self.path, self.delay = path, delay
        self.accepted, self.pending, self.candidate, self.auto, self.since, self.sequence = value or (None, False, None, False, 0.0, 0)
        self.log, self.commands, self.undone = [tuple(e) for e in log], commands, undone

    @property
    def value(self) -> tuple:
        return self.accepted, self.pending, self.candidate, self.auto, self.since, self.sequence

    @property
    def deadline(self) -> float | None:
        return self.since + self.delay if self.pending and self.auto else None

    def row(self, sequence: int, change: str, undone: int = 0) -> tuple:
        return self.path, sequence, change, self.accepted, self.candidate if self.pending else None, undone

    def _take(self, at: int, content: str | None) -> None:
        """Writes the item to the log as of ``at`` and makes ``content`` the accepted one."""
        self.log.append((at, self.sequence, self.accepted, self.candidate))
        self.accepted, self.pending = content, False

    def due(self, now: float) -> list[tuple]:
        if self.deadline is None or now < self.deadline:
            return []
        self._take(self.sequence, self.candidate)
        return [self.row(self.sequence, "ACCEPTED")]

    def edit(self, sequence: int, now: float, sha256: str | None) -> list[tuple]:
        if sha256 == self.accepted:
            was, self.pending = self.pending, False
            return [self.row(sequence, "WITHDRAWN")] if was else []
        change = "ADDED" if self.accepted is None else "DELETED" if sha256 is None else "MODIFIED"
        self.pending, self.candidate, self.auto, self.since, self.sequence = True, sha256, True, now, sequence
        return [self.row(sequence, change)]

    def command(self, sequence: int, now: float, kind: str, command_id: str | None, expected: str | None, target: int | None) -> list[tuple]:
        if command_id is not None:
            seen = known(self.commands, command_id, now)
            if seen is not None:
                return [self.row(sequence, "REPLAY" if seen == kind else "CONFLICT")]
            self.commands[command_id] = kind, now
        if kind == "RESTORE":
            return self._restore(sequence, now, target)
        if not self.pending:
            return [self.row(sequence, "MISSING")]
        if expected is not None and expected != (self.candidate or ""):
            return [self.row(sequence, "CONFLICT")]
        if kind == "HOLD":
            self.auto = False
            return [self.row(sequence, "HELD")]
        self._take(sequence, self.candidate if kind == "ACCEPT" else self.accepted)
        return [self.row(sequence, "RESTORED" if kind == "REJECT" else "REMOVED" if self.accepted is None else "INDEXED")]

    def _restore(self, sequence: int, now: float, target: int | None) -> list[tuple]:
        place = next((i for i, e in enumerate(self.log) if e[0] == target), None)
        if place is None:
            return [self.row(sequence, "ALREADY" if target is not None and known(self.undone, target, now) else "MISSING")]
        entries = self.log[place:]
        for entry in reversed(entries):
            at, self.sequence, self.accepted, self.candidate = entry
            self.undone[at] = True, now
        self.pending, self.auto = True, False
        del self.log[place:]
        return [self.row(sequence, "UNDONE", len(entries))]

    def fold(self, rows: Iterable[tuple]) -> list[tuple]:
        """What inputs (sequence, time, kind, sha256, command_id, expected, target) make, in order."""
        out = []
        for sequence, now, kind, sha256, command_id, expected, target in rows:
            out += self.due(now)
            out += self.edit(sequence, now, sha256) if kind == "EDIT" else self.command(sequence, now, kind, command_id, expected, target)
        return out


def _rows(frame: pd.DataFrame) -> list[tuple]:
    """The inputs of a frame, with None for what is missing and seconds for times."""
    text = lambda x: x if isinstance(x, str) else None
    return [
        (int(r.sequence), r.ts.timestamp(), r.kind, text(r.sha256), text(r.command_id), text(r.expected), None if pd.isna(r.target) else int(r.target))
        for r in frame.itertuples()
    ]


class _Map:
    """A map state as a mapping of (value, time); ``until`` is when the newest of what was put is to go."""

    def __init__(self, state):
        self.state, self.until = state, []

    def get(self, key):
        return tuple(self.state.getValue((key,))) if self.state.containsKey((key,)) else None

    def __setitem__(self, key, value) -> None:
        self.state.updateValue((key,), value)
        self.until.append(value[1] + KEPT)

    def sweep(self, now: float) -> None:
        for key in [k for k, v in self.state.iterator() if now - v[1] >= KEPT]:
            self.state.removeKey(key)


def _ms(seconds: float) -> int:
    return int(seconds * 1000)


class DeskProcessor(StatefulProcessor):
    """A path's desk in value, list and map state. Timers in event time take items and sweep what is known of old commands
    (state that goes by itself does so in processing time only, which would tell a stream from its replay)."""

    def __init__(self, delay: float):
        self.delay = delay

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.value = handle.getValueState("desk", VALUE)
        self.log = handle.getListState("log", ENTRY)
        self.commands = handle.getMapState("commands", "command_id string", "kind string, seen double")
        self.undone = handle.getMapState("undone", "at bigint", "undone boolean, seen double")

    def _desk(self, key: tuple) -> Desk:
        return Desk(key[0], self.delay, tuple(self.value.get()) if self.value.exists() else None, self.log.get() if self.log.exists() else (), _Map(self.commands), _Map(self.undone))

    def _keep(self, desk: Desk, before: list[tuple], due: float | None, watermark: int) -> None:
        self.value.update(desk.value)
        if desk.log[: len(before)] == before:
            for entry in desk.log[len(before) :]:
                self.log.appendValue(entry)
        elif desk.log:
            self.log.put(desk.log)
        else:
            self.log.clear()
        timers = {desk.deadline, *desk.commands.until[-1:], *desk.undone.until[-1:]} - {None, due}
        if due is not None and due != desk.deadline:
            self.handle.deleteTimer(_ms(due))
        for at in timers:
            self.handle.registerTimer(max(_ms(at), watermark + 1))

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        accepted = initialState["accepted"].iloc[0]
        self.value.update((accepted if isinstance(accepted, str) else None, False, None, False, 0.0, 0))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        desk = self._desk(key)
        before, due = list(desk.log), desk.deadline
        out = desk.fold(_rows(pd.concat(list(rows)).sort_values("sequence")))
        self._keep(desk, before, due, timerValues.getCurrentWatermarkInMs())
        yield pd.DataFrame(out, columns=COLUMNS)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        desk = self._desk(key)
        now, before, due = expiredTimerInfo.getExpiryTimeInMs() / 1000, list(desk.log), desk.deadline
        # a timer's time is a whole number of milliseconds
        out = desk.due(due) if due is not None and now >= _ms(due) / 1000 else []
        desk.commands.sweep(now)
        desk.undone.sweep(now)
        self._keep(desk, before, desk.deadline, timerValues.getCurrentWatermarkInMs())
        yield pd.DataFrame(out, columns=COLUMNS)

    def close(self) -> None:
        pass


def desk_stream(inputs: DataFrame, accepted: DataFrame | None = None, delay: float = 5.0, late: str = "0 seconds") -> DataFrame:
    """The transitions of a stream of inputs. ``accepted``(path, accepted) is the content that paths begin with."""
    initial = accepted.groupBy("path") if accepted is not None else None
    keyed = inputs.withWatermark("ts", late).groupBy("path")
    return keyed.transformWithStateInPandas(DeskProcessor(delay), OUTPUT, "Append", "EventTime", initial)


def desk_batch(inputs: DataFrame, accepted: DataFrame | None = None, delay: float = 5.0) -> DataFrame:
    """The same transitions of stored inputs, up to the time of the newest. A path's inputs stream through one task in order;
    only its state is held."""
    newest = inputs.agg(F.max("ts").alias("until"))
    rows = inputs.select(*(c.split()[0] for c in INPUT.split(", ")))
    if accepted is not None:
        base = accepted.where(F.col("path").isNotNull()).select("path", F.lit(None).cast("bigint").alias("sequence"), F.lit(None).cast("timestamp").alias("ts"), F.lit("BASE").alias("kind"), F.col("accepted").alias("sha256"), F.lit(None).cast("string").alias("command_id"), F.lit(None).cast("string").alias("expected"), F.lit(None).cast("bigint").alias("target"))
        rows = rows.union(base)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        desk, until, out = None, None, []
        for frame in frames:
            frame = frame.reset_index(drop=True)
            bounds = [0, *frame.index[frame["path"] != frame["path"].shift()][1:].tolist(), len(frame)] if len(frame) else [0]
            for a, b in zip(bounds, bounds[1:], strict=False):
                part, path = frame.iloc[a:b], frame["path"].iloc[a]
                if desk is None or desk.path != path:
                    out += desk.due(until) if desk else []
                    desk, until = Desk(path, delay, None, (), {}, {}), part["until"].iloc[0].timestamp()
                if part["kind"].iloc[0] == "BASE":
                    desk.accepted = part["sha256"].iloc[0]
                    part = part.iloc[1:]
                out += desk.fold(_rows(part))
            yield pd.DataFrame(out, columns=COLUMNS)
            out = []
        if desk:
            yield pd.DataFrame(desk.due(until), columns=COLUMNS)

    # nulls, the first content, come first
    dealt = rows.where("path IS NOT NULL").join(F.broadcast(newest)).repartition("path").sortWithinPartitions("path", "sequence")
    return dealt.mapInPandas(run, OUTPUT)


def restores(asked: DataFrame, log: DataFrame) -> DataFrame:
    """RESTORE inputs for asked(queue, at, ts, command_id): of each path of the queue whose log(queue, path, at) has entries from
    ``at`` on, the first of them is the target, so that the selected entry and all later ones of all paths are undone."""
    first = asked.withColumnRenamed("at", "selected").join(log, "queue").where(F.col("at") >= F.col("selected"))
    return first.groupBy("queue", "path", "ts", "command_id").agg(F.min("at").alias("target"))


def inputs_of(events: DataFrame) -> DataFrame:
    """Inputs out of the event table: a user is a file, views and clicks its edits, errors its removal; signups and purchases are
    commands, some of them stale, repeated under one id or for entries that aren't there."""
    command = F.col("event_type").isin("signup", "purchase")
    restore = (F.col("event_type") == "purchase") & (F.col("event_id") % 2 == 1)
    named: Column = F.element_at(F.array(F.lit("ACCEPT"), F.lit("REJECT"), F.lit("HOLD")), (F.col("event_id") % 3 + 1).cast("int"))
    kind = F.when(restore, "RESTORE").when(F.col("event_type") == "purchase", "ACCEPT").when(command, named).otherwise("EDIT")
    content = F.when(~command & (F.col("event_type") != "error"), F.sha2((F.length("props") + F.col("event_id") % 4).cast("string"), 256))
    before = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, -1)
    return events.withColumn("_kind", kind).select(
        F.concat(F.lit("docs/"), "user_id", F.lit(".md")).alias("path"),
        F.col("event_id").alias("sequence"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("_kind").alias("kind"),
        content.alias("sha256"),
        F.when(command, F.concat(F.col("user_id").cast("string"), "props")).alias("command_id"),
        F.when(command & (F.col("event_id") % 7 == 0), F.lit("stale")).alias("expected"),
        F.when(restore, F.last(F.when(F.col("_kind").isin("ACCEPT", "REJECT"), F.col("event_id")), ignorenulls=True).over(before)).alias("target"),
    )
