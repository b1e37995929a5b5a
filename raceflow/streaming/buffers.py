"""Bounded buffers between a producer and a slower consumer, and what each policy loses."""

from __future__ import annotations

from collections import deque

from pyspark.sql import DataFrame

from raceflow.operators.folds import folded


class Buffer:
    """At most `size` items. When it is full, drop_old (a camera) loses the oldest, drop_new (a push queue) the newcomer; newest is a drop_old of one slot."""

    def __init__(self, size: int = 256, policy: str = "drop_new"):
        if policy not in ("drop_old", "drop_new", "newest"):
            raise ValueError(f"unknown policy {policy}")
        self.size, self.policy, self.items = 1 if policy == "newest" else size, policy, deque()

    def put(self, item: object) -> object | None:
        """The item that is lost, or None."""
        if len(self.items) < self.size:
            self.items.append(item)
            return None
        if self.policy == "drop_new":
            return item
        lost = self.items.popleft()
        self.items.append(item)
        return lost

    def take(self) -> object | None:
        """The oldest item, or None (the consumer would send a ping)."""
        return self.items.popleft() if self.items else None


def outcomes(arrivals: DataFrame, size: int = 256, policy: str = "drop_new", run: str = "run_id") -> DataFrame:
    """run, seq, outcome (taken, lost or left) of every item put; arrivals: run, seq, put (else the consumer takes), in order of seq."""

    def step(buffer: Buffer, row) -> list[tuple]:
        key = getattr(row, run)
        if not row.put:
            got = buffer.take()
            return [] if got is None else [(*got, "taken")]
        lost = buffer.put((key, int(row.seq)))
        return [] if lost is None else [(*lost, "lost")]

    kind = arrivals.schema[run].dataType.simpleString()
    rows = arrivals.select(run, "seq", "put")
    return folded(rows, [run], ["seq"], lambda: Buffer(size, policy), step, f"{run} {kind}, seq bigint, outcome string", lambda b: [(*x, "left") for x in b.items])
