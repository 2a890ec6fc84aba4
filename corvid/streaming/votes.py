"""Streams: the vote log as stateful labels, scoring of arriving clips, and idempotent clients."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from corvid.operators import progress, search
from corvid.storage import ship


def toggled_stream(votes: DataFrame) -> DataFrame:
    """clip_id, seq, label of a stream of clicks (clip_id, seq, vote): state is the label that stands, one string a clip.

    Clicks of a clip are applied in order of seq within a batch."""
    ship(votes.sparkSession)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.get[0] if state.exists else "unlabel"
        rows = pd.concat(list(batches)).sort_values("seq")
        out = []
        for vote in rows["vote"]:
            now = "unlabel" if vote == now else vote
            out.append(now)
        state.update((now,))
        yield pd.DataFrame({"clip_id": rows["clip_id"], "seq": rows["seq"], "label": out})

    return votes.groupBy("clip_id").applyInPandasWithState(
        step, "clip_id long, seq long, label string", "label string", "append", GroupStateTimeout.NoTimeout
    )


def once(votes: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """A stream of clicks without the repeats (by event_id) of clients that send at least once, within a watermark on ts."""
    return votes.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["event_id"])


def scored_stream(clips: DataFrame, detectors: DataFrame) -> DataFrame:
    """Hits among arriving clips; scoring keeps no state."""
    ship(clips.sparkSession)
    return search.detector_scores(clips, detectors).where(F.col("raw") >= F.col("threshold")).withColumn("score", F.round("raw", 4))


def activity(events: DataFrame, size: str = "5 minutes", delay: str = "10 minutes") -> DataFrame:
    """window, label, n: votes by event-time window, rows later than the watermark left out."""
    return events.withWatermark("ts", delay).groupBy(F.window("ts", size), "label").agg(F.count(F.lit(1)).alias("n"))


def live_status(steps: DataFrame) -> DataFrame:
    """session, n_steps, n_good, n_bad, status, slope after each batch of a stream of steps (session, step, was, label, cost).

    ``was`` and ``label`` are a clip's label before and after the step, ``cost`` the error after it (null without a model).
    State is two counts and the costs of the last ten steps, whatever the length of the log; the advice is that of
    ``progress.status``."""
    ship(steps.sparkSession)

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, good, bad, at, costs = state.get if state.exists else (0, 0, 0, [], [])
        rows = pd.concat(list(batches)).sort_values("step")
        for side, sign in (("label", 1), ("was", -1)):
            good += sign * int((rows[side] == "good").sum())
            bad += sign * int((rows[side] == "bad").sum())
        n = max(n, int(rows["step"].max()) + 1)
        told = rows[rows["cost"].notna()]
        held = sorted({**dict(zip(at, costs, strict=True)), **dict(zip(told["step"].astype(int), told["cost"].astype(float), strict=True))}.items())
        held = [(s, c) for s, c in held if s >= n - progress.RECENT]
        state.update((n, good, bad, [s for s, _ in held], [c for _, c in held]))
        status, slope = progress.status_of(held, good, bad, n)
        yield pd.DataFrame([(key[0], n, good, bad, status, slope)], columns=["session", "n_steps", "n_good", "n_bad", "status", "slope"])

    return steps.groupBy("session").applyInPandasWithState(
        run, "session string, n_steps long, n_good long, n_bad long, status string, slope double", "n long, good long, bad long, at array<long>, costs array<double>", "update",
        GroupStateTimeout.NoTimeout,
    )
