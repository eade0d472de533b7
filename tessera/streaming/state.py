"""The revision state of libraries over a stream of events, with state kept for each library."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUTPUT = "library_id long, library_rev int, text_rev int, chunk_rev int, embedding_rev int, needs_update boolean"


def after(state: tuple[int, int, int, int], kind: str) -> tuple[int, int, int, int]:
    """(library, text, chunk, embedding) revisions after one event."""
    library, text, chunk, embedding = state
    if kind == "library_changed":
        library += 1
    elif kind == "text_current":
        text = library
    elif kind == "chunks_current" and text == library:
        chunk = library
    elif kind == "embeddings_current" and chunk == library:
        embedding = library
    elif kind in ("invalidate_text", "invalidate_chunks", "invalidate_embeddings"):
        text, chunk, embedding = (0 if kind == "invalidate_text" else text), (chunk if kind == "invalidate_embeddings" else 0), 0
    return library, text, chunk, embedding


def kb_state_stream(events: DataFrame) -> DataFrame:
    """A stream of events(library_id, ts, seq, type) to updated states; each micro-batch applies its events by (ts, seq)."""

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = tuple(state.get) if state.exists else (1, 0, 0, 0)
        for kind in pd.concat(list(batches)).sort_values(["ts", "seq"]).type:
            now = after(now, kind)
        state.update(now)
        yield pd.DataFrame([(key[0], *now, now[3] != now[0])], columns=["library_id", "library_rev", "text_rev", "chunk_rev", "embedding_rev", "needs_update"])

    return events.groupBy("library_id").applyInPandasWithState(update, OUTPUT, "library int, text int, chunk int, embedding int", "update", GroupStateTimeout.NoTimeout)
