"""The stopping rule (E1) run live over an event stream, in event time.

``transformWithState`` keeps, for each annotator, votes that are not final
yet and the rule's state: next position, position of the last issue, the stop
position once reached, and the votes dropped after the stop. Annotators share
``BUCKETS`` state keys by hash, as a call to the state store costs far more
than the rows it moves: a bucket's votes of a micro-batch are one packed
entry of its buffer, its annotators' rules one packed value, and the rule runs
over all annotators of a bucket at once.
A vote is final when the watermark has passed its time: a timer set at the
earliest buffered vote then takes the final votes out of the buffer in the
order ``(ts, event_id)`` and runs the rule over them. Positions therefore
don't depend on the order of arrival, as long as a vote comes at most
``delay`` after the latest vote seen. Later ones are dropped by Spark before
the state sees them; :func:`late_votes` counts them.

The batch operator E1 gives the same votes on the same events. An output row
carries the annotator's running count of votes dropped after the stop.

The buffer holds a bucket's votes of ``delay`` and one micro-batch. The
last ``delay`` of a feed that ends stays in it until the feed goes on or is
closed by a heartbeat (``event_type`` = ``HEARTBEAT``), a row that moves the
watermark and is no vote. With ``forget`` an annotator's state goes when that
much event time has passed since the last final vote; if the annotator comes
back, positions start again. Without it state is kept for good.

Defined cases: a null event type is a vote without an issue; a null ``ts``
is never final and is left out; rows that repeat an event are votes each; a
null annotator is an annotator of its own.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from tidemark.session import ensure_checkpoint_dir

EVENTS_SCHEMA = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"
OUT_SCHEMA = "annotator bigint, pos bigint, vote int, kept_vote int, stopped boolean, dropped bigint"
PACKED = "packed binary"
RULE = ("annotator", "next_pos", "last_issue", "stop_pos", "dropped", "last_us")   # rows of a bucket's packed rules
VOTE = ("annotator", "us", "event_id", "vote")                                     # and of its packed votes
BUCKETS = 256   # state keys; a feed's own checkpoint needs the same number all along
HEARTBEAT = "heartbeat"
NONE = -(1 << 63)
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _packed(rows: np.ndarray) -> tuple:
    return (rows.astype("<i8").tobytes(),)


def _unpacked(value, columns: int) -> np.ndarray:
    return np.frombuffer(value[0], dtype="<i8").reshape(columns, -1)


class StoppingRule(StatefulProcessor):
    """The rules of a bucket of annotators: buffered votes become final as the watermark passes them."""

    def __init__(self, n_clean: int, forget_ms: int | None = None) -> None:
        self.n_clean, self.forget_ms = n_clean, forget_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.rule = handle.getValueState("rules", PACKED)
        self.buffer = handle.getListState("votes", PACKED)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for pdf in rows:
            pdf = pdf[pdf["counts"].astype(bool)]
            if len(pdf):
                votes = np.stack([pdf[c].to_numpy(np.int64) for c in VOTE])
                self.buffer.appendValue(_packed(votes))
                low = int(votes[1].min())
                first = low if first is None else min(first, low)
        if first is not None:
            self._wake(-(-first // 1000))
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark, gone = timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs()
        held = [_unpacked(v, len(VOTE)) for v in self.buffer.get()]
        held = np.concatenate(held, axis=1) if held else np.zeros((len(VOTE), 0), dtype=np.int64)
        final = held[1] <= mark * 1000
        rest = held[:, ~final]
        rules = _unpacked(self.rule.get(), len(RULE)) if self.rule.exists() else np.zeros((len(RULE), 0), dtype=np.int64)
        out = None
        if final.any():
            if rest.size:
                self.buffer.put([_packed(rest)])
            else:
                self.buffer.clear()
            votes = held[:, final]
            rules, out = self._run(rules, votes[:, np.lexsort((votes[2], votes[1], votes[0]))])
        wake = -(-int(rest[1].min()) // 1000) if rest.size else None
        if self.forget_ms is not None and rules.size:
            ends = rules[5] // 1000 + self.forget_ms
            here = np.isin(rules[0], rest[0])
            rules = rules[:, (ends > mark) | here]   # an annotator's time is up, unless a vote of theirs is held
            ends = ends[(ends > mark) & ~here]
            if ends.size:
                wake = int(ends.min()) if wake is None else min(wake, int(ends.min()))
        if rules.size:
            self.rule.update(_packed(rules))
        elif self.rule.exists():
            self.rule.clear()
        if wake is not None:
            self._wake(max(wake, mark + 1), gone)
        if out is not None:
            yield out

    def close(self) -> None:
        pass

    def _wake(self, ms: int, gone: int | None = None) -> None:
        """Let the one timer of the bucket go off at ``ms`` or earlier; ``gone`` is the timer that just did."""
        at = [t for t in self.handle.listTimers() if t != gone]
        earlier = [t for t in at if t <= ms]
        if not earlier:
            for t in at:
                self.handle.deleteTimer(t)
            self.handle.registerTimer(ms)

    def _run(self, rules: np.ndarray, votes: np.ndarray) -> tuple[np.ndarray, pd.DataFrame]:
        """The rules after ``votes`` (by annotator and in order), and the votes with the rule applied."""
        annotator, us, _, vote = votes
        who, start, many = np.unique(annotator, return_index=True, return_counts=True)
        state = np.repeat(np.array([[0], [0], [-1], [-1], [0], [0]], dtype=np.int64), len(who), axis=1)
        known, old, new = np.intersect1d(rules[0], who, assume_unique=True, return_indices=True)
        state[:, new] = rules[:, old]
        state[0] = who
        of = np.repeat(np.arange(len(who)), many)
        pos = state[1][of] + np.arange(len(vote)) - start[of]
        # position of the last issue so far, annotator by annotator: each lies in a range of its own
        issue = np.where(vote == 1, pos, -1)
        issue[start] = np.maximum(issue[start], state[2])
        span = int(pos.max()) + 2
        last = np.maximum.accumulate(issue + 1 + of * span) - 1 - of * span
        reached = np.flatnonzero((pos - last >= self.n_clean) & (state[3][of] < 0))
        first, at = np.unique(of[reached], return_index=True)
        stop = state[3].copy()
        stop[first] = pos[reached[at]]
        stopped = (stop[of] >= 0) & (pos >= stop[of])
        after = stopped & (pos > stop[of])
        dropped = state[4][of] + np.where(after, pos - np.maximum(stop, state[1] - 1)[of], 0)
        end = start + many - 1
        state[1], state[2], state[3], state[4], state[5] = pos[end] + 1, last[end], stop, dropped[end], us[end]
        others = rules[:, ~np.isin(rules[0], who)]
        out = pd.DataFrame({
            "annotator": pd.arrays.IntegerArray(annotator.copy(), annotator == NONE), "pos": pos, "vote": vote.astype(np.int32),
            "kept_vote": pd.arrays.IntegerArray(vote.astype(np.int32), after), "stopped": stopped, "dropped": dropped})
        return np.concatenate([others, state], axis=1), out


def stopping_rule(events: DataFrame, n_clean: int = 5, issue_type: str = "error", delay: str = "1 day",
                  forget_ms: int | None = None) -> DataFrame:
    """Votes of a stream of ``EVENTS_SCHEMA`` with the rule applied (``OUT_SCHEMA``)."""
    # pandas turns integers beside a null into floats and can't group by them: null ids go as NONE, which sorts first
    votes = events.withWatermark("ts", delay).select(
        F.coalesce("user_id", F.lit(NONE)).alias("annotator"), "ts",
        F.coalesce(F.unix_micros("ts"), F.lit(NONE)).alias("us"), F.coalesce("event_id", F.lit(NONE)).alias("event_id"),
        F.coalesce((F.col("event_type") == issue_type).cast("int"), F.lit(0)).alias("vote"),
        (F.col("ts").isNotNull() & ~F.col("event_type").eqNullSafe(HEARTBEAT)).alias("counts"))
    votes = votes.withColumn("bucket", F.pmod(F.xxhash64("annotator"), F.lit(BUCKETS)).cast("int"))
    return votes.groupBy("bucket").transformWithStateInPandas(
        StoppingRule(n_clean, forget_ms), OUT_SCHEMA, "append", "eventTime")


def stopping_stream(spark: SparkSession, source_dir: str, n_clean: int = 5, issue_type: str = "error",
                    out_dir: str | None = None, max_files_per_trigger: int = 1, delay: str = "1 day",
                    forget_ms: int | None = None):
    """Start the live stopping rule over Parquet files; returns ``(query, out_dir)`` with votes in Parquet."""
    out_dir = out_dir or f"{ensure_checkpoint_dir(spark).rstrip('/')}/stop-stream-{uuid.uuid4().hex}"
    events = (spark.readStream.schema(EVENTS_SCHEMA).option("maxFilesPerTrigger", max_files_per_trigger)
              .parquet(source_dir))
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKSDB)   # lists and timers need it; the query keeps its own copy of the settings
    try:
        q = (stopping_rule(events, n_clean, issue_type, delay, forget_ms).writeStream.format("parquet")
             .option("path", f"{out_dir}/votes").option("checkpointLocation", f"{out_dir}/_checkpoint")
             .outputMode("append").trigger(availableNow=True).start())
    finally:
        if before is None:
            spark.conf.unset(_PROVIDER)
        else:
            spark.conf.set(_PROVIDER, before)
    return q, out_dir


def late_votes(query) -> int:
    """Votes that came behind the watermark and were dropped, over the progress reports that Spark keeps."""
    return sum(s["numRowsDroppedByWatermark"] for p in query.recentProgress for s in p["stateOperators"])
