"""Mate pairing over a stream of reads, with bounded waiting.

A name's records are paired as they come, 1-2, 3-4, ...; the state of a name is the one record that waits for its mate. A record
that waits longer than the timeout is given up as an orphan, and its mate, when it comes, waits anew: the streaming
counterpart of evicting the oldest entries of a cache.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUTPUT = "qname string, ord long, mate_ord long, kind string"
STATE = "ord long"


def pair_stream(reads: DataFrame, timeout_ms: int = 60_000) -> DataFrame:
    """A row for each pair (ord, mate_ord) and each orphan. reads: a stream with qname and ord."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        out, waiting = [], state.get[0] if state.exists else None
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame([(key[0], waiting, None, "orphan")], columns=["qname", "ord", "mate_ord", "kind"]).astype({"mate_ord": "Int64"})
            return
        for order in sorted(int(o) for batch in batches for o in batch["ord"]):
            if waiting is None:
                waiting = order
            else:
                out.append((key[0], waiting, order, "pair"))
                waiting = None
        if waiting is None:
            if state.exists:
                state.remove()
        else:
            state.update((waiting,))
            state.setTimeoutDuration(timeout_ms)
        yield pd.DataFrame(out, columns=["qname", "ord", "mate_ord", "kind"]).astype({"ord": "int64", "mate_ord": "Int64"})

    return reads.select("qname", "ord").groupBy("qname").applyInPandasWithState(step, OUTPUT, STATE, "append", GroupStateTimeout.ProcessingTimeTimeout)
