"""Compare-and-set per span over a stream: what is live is state, and each write is checked against it."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

SPAN = ["namespace", "source_id", "stable_key"]
OUT = "namespace string, source_id string, stable_key string, op_seq long, outcome string"


def outcomes(events: DataFrame) -> DataFrame:
    """(span, op_seq, outcome) of a stream of events (span, op_seq, kind, record_id, old_id), as each is taken in.

    A forget is an event of each span that it may end, with its target as
    old_id.  Within a batch the events of a span go by op_seq; one that comes
    after a later one was taken in is judged by what is live by then.  The
    state of a span is its live record, and nothing else is kept.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        live = state.get[0] if state.exists else None
        pdf = pd.concat(list(batches), ignore_index=True).drop_duplicates("op_seq").sort_values("op_seq")
        out = []
        for seq, kind, record, old in zip(pdf["op_seq"], pdf["kind"], pdf["record_id"], pdf["old_id"]):
            if kind == "forget":
                if live is not None and live == old:
                    live = None
                    out.append((*key, seq, "forgotten"))
                continue
            if kind == "assert":
                done = "unchanged" if live == record else "created" if live is None else "converted"
            else:
                done = "superseded" if live is not None and live == old else "refused"
            live = record if done != "refused" else live
            out.append((*key, seq, done))
        state.update((live,))
        yield pd.DataFrame(out, columns=[*SPAN, "op_seq", "outcome"])

    return events.groupBy(*SPAN).applyInPandasWithState(step, OUT, "live string", "append", GroupStateTimeout.NoTimeout)
