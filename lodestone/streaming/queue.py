"""The change queue of a watched folder as a stateful stream, and the same fold over stored events.

An event (path, sequence, sha256, ts) tells a file's content at a time; a null sha256 tells that it is gone. Per path,
the state holds the accepted content and the pending candidate: content that returns to the accepted one withdraws the
candidate; a new edit replaces it; a candidate that nobody touches for ``delay`` seconds is accepted.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUTPUT = "path string, sequence bigint, change string, accepted string, candidate string"
STATE = "accepted string, candidate string, since double, sequence bigint"


def step(accepted: str | None, candidate: str | None, sha256: str | None, known: bool) -> tuple[str, str | None]:
    """(change, candidate) that an event makes."""
    if sha256 == accepted:
        return ("WITHDRAWN" if known and candidate != accepted else "UNCHANGED"), accepted
    if accepted is None:
        return "ADDED", sha256
    return ("DELETED" if sha256 is None else "MODIFIED"), sha256


def _due(state: tuple | None, now: float, delay: float) -> bool:
    """Whether a candidate has been left alone for long enough to be accepted."""
    return state is not None and state[1] != state[0] and now - state[2] >= delay


def _accept(path: str, state: tuple) -> tuple[tuple, tuple]:
    _, candidate, since, sequence = state
    return (path, sequence, "ACCEPTED", candidate, candidate), (candidate, candidate, since, sequence)


def _fold(path: str, rows: pd.DataFrame, state: tuple | None, delay: float, until: float | None = None) -> tuple[list[tuple], tuple]:
    """Transitions and the state (accepted, candidate, since, sequence) after ``rows``, and up to the time ``until``."""
    out = []
    for r in rows.sort_values("sequence").itertuples():
        sha = r.sha256 if isinstance(r.sha256, str) else None
        at = r.ts.timestamp()
        if _due(state, at, delay):
            row, state = _accept(path, state)
            out.append(row)
        accepted, candidate = state[:2] if state else (None, None)
        change, candidate = step(accepted, candidate, sha, state is not None)
        if change != "UNCHANGED":
            out.append((path, int(r.sequence), change, accepted, candidate))
        state = (accepted, candidate, at, int(r.sequence))
    if until is not None and _due(state, until, delay):
        row, state = _accept(path, state)
        out.append(row)
    return out, state


COLUMNS = ["path", "sequence", "change", "accepted", "candidate"]


def queue_stream(events: DataFrame, delay: float = 5.0, late: str = "0 seconds") -> DataFrame:
    """The transitions of a stream of events, keyed by path. A timer in event time accepts a candidate that no later event
    touches: it fires when the watermark, ``late`` behind the newest event of all paths, passes the delay."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = state.get if state.exists else None
        if state.hasTimedOut:
            row, held = _accept(key[0], held)
            out = [row]
        else:
            out, held = _fold(key[0], pd.concat(list(batches)), held, delay)
        state.update(held)
        if held[1] != held[0]:
            state.setTimeoutTimestamp(max(int((held[2] + delay) * 1000), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=COLUMNS)

    return events.withWatermark("ts", late).groupBy("path").applyInPandasWithState(run, OUTPUT, STATE, "append", GroupStateTimeout.EventTimeTimeout)


def queue_batch(events: DataFrame, delay: float = 5.0) -> DataFrame:
    """The same transitions of stored events, up to the time of the newest. A path's events meet in one group, which its
    own edits bound."""
    newest = events.agg(F.max("ts").alias("until"))

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        out, _ = _fold(rows["path"].iloc[0], rows, None, delay, rows["until"].iloc[0].timestamp())
        return pd.DataFrame(out, columns=COLUMNS)

    return events.join(F.broadcast(newest)).groupBy("path").applyInPandas(run, OUTPUT)


def item_id(path: Column) -> Column:
    """The name of a path's item in the queue."""
    return F.concat(F.lit("chg_"), F.substring(F.sha2(path, 256), 1, 16))


def with_baselines(items: DataFrame, accepted: DataFrame) -> DataFrame:
    """Queue items (id, path, candidate) with the content accepted for their path, in public columns; an addition that is gone
    again before anybody took it is no change."""
    rows = items.join(accepted, "path", "left").where("accepted IS NOT NULL OR candidate IS NOT NULL")
    kind = F.when(F.col("accepted").isNull(), "ADDED").when(F.col("candidate").isNull(), "DELETED").otherwise("MODIFIED")
    return rows.select("id", "path", kind.alias("change_type"), F.col("accepted").alias("baseline_sha256"), F.col("candidate").alias("candidate_sha256"))


def commanded(items: DataFrame, commands: DataFrame) -> DataFrame:
    """(id, outcome, accepted) of items (id, accepted, candidate) after commands (id, command, expected, at, command_id).
    An item's first command decides: ACCEPT takes the candidate, or removes what is gone; REJECT restores the baseline;
    HOLD keeps the item for a person. One that expects another candidate is a conflict and changes nothing."""
    first = commands.groupBy("id").agg(F.min_by(F.struct("command", "expected"), F.struct("at", "command_id")).alias("c")).select("id", "c.*")
    rows = items.join(first, "id", "left")
    command, candidate = F.col("command"), F.col("candidate")
    stale = ~F.col("expected").eqNullSafe(candidate)
    taken = F.when(candidate.isNull(), "REMOVED").otherwise("INDEXED")
    outcome = F.when(command.isNull(), "PENDING").when(stale, "CONFLICT").when(command == "ACCEPT", taken).when(command == "REJECT", "RESTORED").otherwise("HELD")
    accepts = F.coalesce((command == "ACCEPT") & ~stale, F.lit(False))
    return rows.select("id", outcome.alias("outcome"), F.when(accepts, candidate).otherwise(F.col("accepted")).alias("accepted"))


def same_content(before_status: Column, before: Column, after_status: Column, after: Column) -> Column:
    """Whether two documents that could both be read hold the same text."""
    return F.coalesce((before_status == "SUCCESS") & (after_status == "SUCCESS") & (before == after), F.lit(False))


def edge_stream(events: DataFrame) -> DataFrame:
    """Edge-triggered changes of a digest by key: (key, sequence, edge), an event only where the digest is another."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        out = []
        for r in pd.concat(list(batches)).sort_values("sequence").itertuples():
            if r.digest != last:
                out.append((key[0], int(r.sequence), "INITIAL" if last is None else "CHANGED"))
                last = r.digest
        state.update((last,))
        yield pd.DataFrame(out, columns=["key", "sequence", "edge"])

    return events.groupBy("key").applyInPandasWithState(run, "key string, sequence bigint, edge string", "digest string", "append", GroupStateTimeout.NoTimeout)


def file_events(events: DataFrame) -> DataFrame:
    """File events out of the event table: a user is a file, props its content, an error its removal."""
    return events.select(
        F.concat(F.lit("docs/"), "user_id", F.lit(".md")).alias("path"),
        F.col("event_id").alias("sequence"),
        F.when(F.col("event_type") != "error", F.sha2("props", 256)).alias("sha256"),
        F.col("ts").cast("timestamp").alias("ts"),
    )
