"""Sessions and vaults over streams: a vault opens with a session's first text and closes after it has been idle."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.detect import Config, detect_text
from ..operators.render import Vault

#: Idle minutes after which a vault is forgotten; 0 keeps it.
IDLE_MINUTES = 30


def sessions(events: DataFrame, key: str, ts: str, minutes: int = IDLE_MINUTES, late: str | None = None) -> DataFrame:
    """(key, opened, n_events) of sessions that end after `minutes` without an event; on a stream, give `late` as watermark."""
    if late:
        events = events.withWatermark(ts, late)
    window = F.session_window(ts, f"{minutes} minutes")
    return events.groupBy(key, window.alias("w")).agg(F.count("*").alias("n_events")).select(key, F.col("w.start").alias("opened"), "n_events")


def dumped(v: Vault) -> str:
    return json.dumps({"counters": v.counters, "tags": v.tags, "seen": [[*k, t] for k, t in v.seen.items()], "persons": v.persons, "fakes": [[*k, t] for k, t in v.fakes.items()], "behind": v.behind, "words": v.words, "owners": v.owners})


def loaded(key: str, mode: str, now: int, state: str) -> Vault:
    x = json.loads(state)
    pairs = lambda name: {(a, b): t for a, b, t in x[name]}
    return Vault(key, mode, now, x["counters"], x["tags"], pairs("seen"), x["persons"], pairs("fakes"), x["behind"], x["words"], x["owners"])


def redact_stream(texts: DataFrame, mode: str = "tag", now: int = 2025, minutes: int = IDLE_MINUTES, config: Config = Config()) -> DataFrame:
    """(session_id, ord, text) of a stream texts(session_id, ord, text), redacted with one vault for each session.

    State is one session's vault; it is dropped after `minutes` of processing time without a text.
    """

    def fold(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        vault = loaded(str(key[0]), mode, now, state.get[0]) if state.exists else Vault(str(key[0]), mode, now)
        rows = pd.concat(list(frames)).sort_values("ord")
        out = []
        for r in rows.to_dict("records"):
            spans, _ = detect_text(r["text"], config)
            text, _ = vault.render(r["text"] or "", ((s[0], s[1], s[2], s[5]) for s in spans))
            out.append((key[0], r["ord"], text))
        state.update((dumped(vault),))
        if minutes:
            state.setTimeoutDuration(minutes * 60_000)
        yield pd.DataFrame(out, columns=["session_id", "ord", "text"])

    timeout = GroupStateTimeout.ProcessingTimeTimeout if minutes else GroupStateTimeout.NoTimeout
    keyed = texts.select(F.col("session_id").cast("string").alias("session_id"), F.col("ord").cast("bigint").alias("ord"), "text")
    return keyed.groupBy("session_id").applyInPandasWithState(fold, "session_id string, ord bigint, text string", "vault string", "append", timeout)


def latest(reviews: DataFrame, key: str, ts: str, late: str | None = None) -> DataFrame:
    """The last review of each session: what is pending until it is approved or replaced."""
    if late:
        reviews = reviews.withWatermark(ts, late)
    rest = [c for c in reviews.columns if c != key]
    return reviews.groupBy(key).agg(F.max_by(F.struct(*rest), ts).alias("r")).select(key, "r.*")
