"""Event traces of tasks: one reducer, run in batch by task or on a stream with keyed state."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StringType, StructField, StructType

OUT = "task_id string, prompt_index bigint, observation_id string, stage string, tier string, level bigint, switched boolean"
NAMES = [x.split()[0] for x in OUT.split(", ")]
ARROW = [{"string": pa.string(), "bigint": pa.int64(), "boolean": pa.bool_()}[x.split()[1]] for x in OUT.split(", ")]
#: Rows of a batch that is handed on.
ROWS = 10_000


def fresh() -> dict:
    return {"step": 0, "prompts": 0, "obs": {}, "shown": []}


def apply(task: str, state: dict, event: dict, hot: int = 2) -> list[tuple]:
    """Changes the state by an event; a prompt returns a row for each observation.

    An observation is captured, seen when an action follows a prompt with it, and
    enriched if it was the latest of those.  All but the last `hot` are cold; a
    cold enriched one that isn't pinned is shown compact from then on.
    """
    kind, obs = event["type"], state["obs"]
    if kind == "observation":
        state["step"] += 1
        i = event.get("observation_id") or f"obs-{state['step']:04d}"
        if i in obs:
            raise ValueError(f"observation {i} is there already")
        obs[i] = {"stage": "CAPTURED", "pinned": False, "level": None, "last": None}
    elif kind == "action":
        waiting = [i for i in state["shown"] if obs[i]["stage"] == "CAPTURED"]
        for i in waiting:
            obs[i]["stage"] = "SEEN"
        if waiting:
            obs[waiting[-1]]["stage"] = "ENRICHED"
    elif kind in ("pin", "unpin"):
        obs[event["observation_id"]]["pinned"] = kind == "pin"
    elif kind == "finish":
        for o in obs.values():
            o["stage"] = "ARCHIVED"
    elif kind == "prompt":
        rows, state["shown"] = [], list(obs)
        for at, (i, o) in enumerate(obs.items()):
            tier = "HOT" if at >= len(obs) - hot else "COLD"
            if tier == "COLD" and o["stage"] == "ENRICHED" and not o["pinned"] and o["level"] is None:
                o["level"] = 1
            level = 3 if o["level"] is None or o["pinned"] else o["level"]
            rows.append((task, state["prompts"], i, o["stage"], tier, level, o["last"] is not None and o["last"] != level))
            o["last"] = level
        state["prompts"] += 1
        return rows
    else:
        raise ValueError(f"unknown event {kind}")
    return []


def replay(events: DataFrame) -> DataFrame:
    """The prompts' rows of events (task_id, event_index, type, observation_id), task by task in their order.

    Tasks come sorted, many in a batch and a long one over many, so that there
    is no call for each and only a task's state is held.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, state, out = None, None, []
        for batch in batches:
            for now, kind, i in zip(*(batch.column(c).to_pylist() for c in ("task_id", "type", "observation_id")), strict=True):
                if state is None or now != task:
                    task, state = now, fresh()
                out += apply(now, state, {"type": kind, "observation_id": i})
                if len(out) >= ROWS:
                    yield told(out)
                    out = []
        yield told(out)

    x = events.select("task_id", "event_index", "type", "observation_id")
    return x.repartition("task_id").sortWithinPartitions("task_id", F.asc_nulls_last("event_index")).mapInArrow(run, OUT)


def told(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(NAMES)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, ARROW, strict=True)], names=NAMES)


class _Replayer(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("trace", StructType([StructField("json", StringType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        got = self.state.get()
        state, out = (fresh() if got is None else json.loads(got[0])), []
        for e in pd.concat(list(rows)).sort_values("event_index").to_dict("records"):
            out += apply(key[0], state, e)
        self.state.update((json.dumps(state),))
        yield pd.DataFrame(out, columns=NAMES)

    def close(self) -> None:
        pass


def replay_stream(events: DataFrame) -> DataFrame:
    """replay() on a stream: a task's events have to arrive in their order of batches."""
    rows = events.select("task_id", "event_index", "type", "observation_id")
    return rows.groupBy("task_id").transformWithStateInPandas(_Replayer(), OUT, "Append", "None")


def windowed_counts(events: DataFrame, *, time: str = "ts", kind: str = "event_type", width: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """(window_start, kind, n) of a stream or table by event time; an extension, with a watermark for late rows."""
    return events.withWatermark(time, late).groupBy(F.window(time, width), kind).agg(F.count("*").alias("n")).select(F.col("window.start").alias("window_start"), kind, "n")


def trace_of_turns(turns: DataFrame) -> DataFrame:
    """Events of conversation turns (conv_id, turn, role): assistants' turns are a prompt and an action, others observations."""
    kinds = F.when(F.col("role") == "assistant", F.array(F.lit("prompt"), F.lit("action"))).otherwise(F.array(F.lit("observation")))
    x = turns.select(F.col("conv_id").cast("string").alias("task_id"), F.col("turn"), F.posexplode(kinds).alias("k", "type"))
    return x.select("task_id", (F.col("turn") * 2 + F.col("k")).alias("event_index"), "type", F.lit(None).cast("string").alias("observation_id"))
