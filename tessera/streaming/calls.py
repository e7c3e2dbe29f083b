"""Call streams: utterances, rolling extraction, claim state and the dashboard's events."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tessera.functions import fixed, rules
from tessera.operators import claims


def timed(events: DataFrame, ts: str = "ts", late: str = "1 hour") -> DataFrame:
    """events with a watermark; a time stamp without zone is read in the session's."""
    return events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)


def utterances(pieces: DataFrame, key: str = "call_id", ts: str = "ts", silence: str = f"{fixed.SILENCE_SECONDS:g} seconds", seq: str = "seq", text: str = "text") -> DataFrame:
    """key, started, ended and text: pieces of speech joined in order until a silence.

    For streams and tables alike; a stream in append mode gives an utterance once the watermark has passed its silence.
    """
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(ts, seq, text))), lambda x: x[text]), " ")
    out = pieces.groupBy(key, F.session_window(ts, silence).alias("_w")).agg(joined.alias("text"))
    return out.select(key, F.col("_w.start").alias("started"), F.col("_w.end").alias("ended"), "text")


def rolling_chunks(pieces: DataFrame, words: int = fixed.CHUNK_WORDS) -> DataFrame:
    """call_id, seq and chunk of a stream of pieces (call_id, seq, text): what an extractor is given.

    A call's words are kept until there are `words` of them; from then on every piece gives the last 2 * words
    words, which are all that is kept, so that a call's state is bounded.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = state.get[0].split() if state.exists else []
        out = []
        for r in pd.concat(frames).sort_values("seq").itertuples():
            held = held + (r.text or "").split()
            if len(held) >= words:
                held = held[-2 * words :]
                out.append((key[0], r.seq, " ".join(held)))
        state.update((" ".join(held),))
        yield pd.DataFrame(out, columns=["call_id", "seq", "chunk"])

    return pieces.groupBy("call_id").applyInPandasWithState(step, "call_id long, seq long, chunk string", "held string", "append", GroupStateTimeout.NoTimeout)


def extractions(chunks: DataFrame) -> DataFrame:
    """Best spans of each chunk of a stream, kept only where there are some; without a window, so that it runs on streams.

    call_id, seq and spans, an array of kind, label, value and score with the best of each label.
    """
    found = [rules._found(F.col("chunk"), n, *rule) for n, rule in enumerate(fixed.EXTRACTIONS)]
    every = F.flatten(F.array(*found))
    labels = F.array_distinct(F.transform(every, lambda s: F.struct(s["kind"].alias("kind"), s["label"].alias("label"))))

    def best(name):
        own = F.filter("_every", lambda s: (s["kind"] == name["kind"]) & (s["label"] == name["label"]))
        first = F.get(F.array_sort(F.transform(own, lambda s: F.struct((-s["score"]).alias("n"), s["seq"].alias("q"), s["value"].alias("value")))), F.lit(0))
        return F.struct(name["kind"].alias("kind"), name["label"].alias("label"), first["value"].alias("value"), (-first["n"]).alias("score"))

    rows = chunks.withColumn("_every", every).withColumn("_labels", labels)
    return rows.select("call_id", "seq", F.transform("_labels", best).alias("spans")).where(F.size("spans") > 0)


def claim_states(spans: DataFrame) -> DataFrame:
    """call_id, seq, pillars and fraud (JSON) after each update of a stream of extractions (call_id, seq, spans).

    A pillar changes only with a strictly higher score; a signal takes the last evidence.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        pillars, fraud = (json.loads(x) for x in state.get) if state.exists else ({}, {})
        out = []
        for r in pd.concat(frames).sort_values("seq").itertuples():
            for s in r.spans:
                if s["kind"] == "fraud":
                    fraud[s["label"]] = s["value"]
                elif s["label"] not in pillars or pillars[s["label"]][1] < s["score"]:
                    pillars[s["label"]] = [s["value"], float(s["score"])]
            out.append((key[0], r.seq, json.dumps(pillars, sort_keys=True), json.dumps(fraud, sort_keys=True)))
        state.update((json.dumps(pillars), json.dumps(fraud)))
        yield pd.DataFrame(out, columns=["call_id", "seq", "pillars", "fraud"])

    return spans.groupBy("call_id").applyInPandasWithState(step, "call_id long, seq long, pillars string, fraud string", "pillars string, fraud string", "append", GroupStateTimeout.NoTimeout)


def dashboard(events: DataFrame) -> DataFrame:
    """call_id, seq and view (JSON) after each batch of a call's events (call_id, seq, type, name, value).

    A start empties the view; entities (by their alias) and signals upsert, tools keep the newest TOOL_FEED; events without a known type change nothing.
    """
    aliases = dict(fixed.LABEL_ALIASES)
    fresh = {"mode": "calm", "active": False, "lines": 0, "tools": [], "pillars": {}, "fraud": {}}

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        view = json.loads(state.get[0]) if state.exists else json.loads(json.dumps(fresh))
        rows = pd.concat(frames).sort_values("seq")
        for r in rows.itertuples():
            if r.type == "call_start":
                view = json.loads(json.dumps(fresh)) | {"active": True}
            elif r.type == "call_end":
                view["active"] = False
            elif r.type == "entity":
                view["pillars"][aliases.get(r.name, r.name)] = r.value
            elif r.type == "fraud_signal":
                view["fraud"][r.name] = r.value
            elif r.type == "emotional_state":
                view["mode"] = r.value
            elif r.type in ("tool_call", "tool_result"):
                view["tools"] = [r.name, *view["tools"]][: fixed.TOOL_FEED]
            elif r.type == "transcript":
                view["lines"] += 1
        state.update((json.dumps(view),))
        yield pd.DataFrame([(key[0], int(rows["seq"].max()), json.dumps(view, sort_keys=True))], columns=["call_id", "seq", "view"])

    valid = events.where(F.col("type").isNotNull()).select("call_id", "seq", "type", F.col("name").alias("name"), "value")
    return valid.groupBy("call_id").applyInPandasWithState(step, "call_id long, seq long, view string", "view string", "append", GroupStateTimeout.NoTimeout)


def to_all(stream: DataFrame, sinks: list, checkpoint: str):
    """Starts a query that gives each micro-batch to every sink (a function of the batch and its number).

    A batch that is given again after a failure has the same number, by which a sink can replace what it wrote.
    """

    def each(batch: DataFrame, number: int) -> None:
        batch.persist()
        for sink in sinks:
            sink(batch, number)
        batch.unpersist()

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def final_states(spans: DataFrame) -> DataFrame:
    """The batch equivalent of `claim_states`: call_id, label, value, score and turn."""
    flat = spans.select("call_id", F.col("seq").alias("turn"), F.explode("spans").alias("s")).select("call_id", "turn", "s.*")
    return claims.filled(flat)
