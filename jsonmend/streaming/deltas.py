"""Streamed repair: chunks in, stable deltas and one completed result out."""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from jsonmend.functions.result import RESULT_TYPE, as_row
from jsonmend.kernel.engine import Options, Result, engine_for
from jsonmend.kernel.schema import compile_schema
from jsonmend.kernel.stream import StablePrefix
from jsonmend.kernel.values import utf16_length

EVENT_TYPE = f"stream_id string, kind string, offset long, text string, missing_seq long, repair {RESULT_TYPE}"
STATE_TYPE = "streams string"
#: Groups that the streams are dealt over, each with one state row.
BUCKETS = 2_048
COLUMNS = ["stream_id", "kind", "offset", "text", "missing_seq", "repair"]


class State(NamedTuple):
    """A stream so far: contiguous text, next chunk, chunks held behind a gap, UTF-16 units of both, scanner, last chunk (-1: unknown), whether it is complete."""

    text: str = ""
    next: int = 0
    pending: str = "{}"
    units: int = 0
    scanner: str = "{}"
    last: int = -1
    done: bool = False

    @property
    def missing(self) -> int | None:
        """The first chunk that never came, if any is known to be missing."""
        return self.next if json.loads(self.pending) or self.next <= self.last else None

    def whole(self) -> str:
        """All text there is, chunks behind gaps included, in order."""
        held = json.loads(self.pending)
        return self.text + "".join(held[k] for k in sorted(held, key=int))


def feed(state: State | None, chunks: list[tuple[int, str | None, bool]], most: int) -> tuple[State, list[tuple[int, str]], bool]:
    """Add chunks, in ``seq`` order with gaps held back: (state, deltas, whether the stream is complete).

    Held chunks count towards ``most`` UTF-16 units too; a stream that exceeds
    it is complete.  A repeated chunk is dropped, as is any after completion.
    """
    text, following, pending, units, scanner, last, done = state or State()
    if done:
        return State(text, following, pending, units, scanner, last, True), [], False
    waiting = {int(k): v for k, v in json.loads(pending).items()}
    for seq, chunk, is_last in chunks:
        if seq >= following and seq not in waiting:
            waiting[seq] = chunk or ""
            units += utf16_length(waiting[seq])
        if is_last:
            last = seq
    parts = [text]
    while following in waiting:
        parts.append(waiting.pop(following))
        following += 1
    text = "".join(parts)
    scan = StablePrefix(**json.loads(scanner))
    found = scan.advance(text) if units <= most else None
    done = units > most or last >= 0 and following > last
    return State(text, following, json.dumps(waiting), units, json.dumps(scan.state()), last, done), [found] if found else [], done


def _dump(streams: dict[str | None, tuple[State, int]]) -> str:
    """A bucket's streams and the times until which they are kept."""
    return json.dumps([[k, until, *([kept.next, kept.last] if kept.done else kept)] for k, (kept, until) in streams.items()], ensure_ascii=False, separators=(",", ":"))


def _load(text: str) -> dict[str | None, tuple[State, int]]:
    return {k: (State(next=kept[0], last=kept[1], done=True) if len(kept) == 2 else State(*kept), until) for k, until, *kept in json.loads(text)}


def complete(state: State, options: Options, schema: str | None) -> Result:
    """The audited result of everything that arrived."""
    if state.units > options.limits.input:
        return Result(False, error=("limit", f"Input length {state.units} exceeds the configured maximum of {options.limits.input} characters."))
    return engine_for(options).repair(state.whole(), compile_schema(schema))


def repair_stream(chunks: DataFrame, schema: str | None = None, options: Options | None = None, timeout_ms: int | None = 600_000, buckets: int = BUCKETS) -> DataFrame:
    """Events of a streaming DataFrame (stream_id string, seq long, chunk string, is_last boolean).

    ``delta`` rows carry contiguous slices from offset 0 as they become stable;
    one ``completed`` row carries the repaired text and the result struct
    ``repair``.  A stream also completes when nothing arrives for ``timeout_ms``:
    then chunks held behind a gap join the text in order, and ``missing_seq``
    names the first chunk that never came.  A stream over the input limit
    completes with that error.  A completed stream is remembered for
    ``timeout_ms``, so that late and repeated chunks do not open it again.
    With ``timeout_ms`` None nothing times out and completed streams are
    remembered for good: for replays with ``availableNow``, which Spark keeps
    running while a processing-time timeout is set.

    Spark's cost is by group, about a millisecond of Python each, so streams
    share ``buckets`` groups by a hash of their id; every stream keeps a state
    and a timeout of its own in its bucket's state row, which is written again
    in each batch that brings one of its streams chunks.  A checkpoint holds for
    one number of buckets.
    """
    options = options or Options()

    def run(key, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        streams = _load(state.get[0]) if state.exists else {}
        now = state.getCurrentProcessingTimeMs() if timeout_ms is not None else 0
        arrived: dict[str | None, list] = {}
        if not state.hasTimedOut:
            for p in parts:
                for stream, s, c, e in zip(p["stream_id"], p["seq"], p["chunk"], p["is_last"], strict=True):
                    arrived.setdefault(stream, []).append((int(s), c, bool(e)))
        rows, finished = [], []
        for stream, chunks in arrived.items():
            kept, deltas, done = feed(streams[stream][0] if stream in streams else None, sorted(chunks, key=lambda x: x[0]), options.limits.input)
            rows += [(stream, "delta", at, piece, None, None) for at, piece in deltas]
            if done:
                finished.append((stream, kept))
            streams[stream] = kept, now + (timeout_ms or 0)
        if timeout_ms is not None:
            for stream in [k for k, (_, until) in streams.items() if until <= now and k not in arrived]:
                kept, _ = streams[stream]
                if kept.done:
                    del streams[stream]
                else:
                    finished.append((stream, kept))
        results = [complete(kept, options, schema) for _, kept in finished]
        for stream, kept in finished:
            streams[stream] = State(next=kept.next, last=kept.last, done=True), now + (timeout_ms or 0)
        if streams:
            state.update((_dump(streams),))
            if timeout_ms is not None:
                state.setTimeoutDuration(max(1, min(until for _, until in streams.values()) - now))
        else:
            state.remove()
        rows += [(stream, "completed", None, r.repaired_text, kept.missing, as_row(r)) for (stream, kept), r in zip(finished, results, strict=True)]
        if rows:
            yield pd.DataFrame(rows, columns=COLUMNS, dtype=object)

    timeout = GroupStateTimeout.NoTimeout if timeout_ms is None else GroupStateTimeout.ProcessingTimeTimeout
    bucket = F.pmod(F.xxhash64("stream_id"), F.lit(buckets)).alias("bucket")
    return chunks.select(bucket, "stream_id", "seq", "chunk", "is_last").groupBy("bucket").applyInPandasWithState(run, EVENT_TYPE, STATE_TYPE, "append", timeout)
