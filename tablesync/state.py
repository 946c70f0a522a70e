"""States of a synced table and the edges between them."""

from __future__ import annotations

PENDING, SNAPSHOT, CATCHUP, STREAMING, ERRORED = "PENDING", "SNAPSHOT", "CATCHUP", "STREAMING", "ERRORED"
EDGES = {PENDING: {SNAPSHOT, STREAMING}, SNAPSHOT: {CATCHUP, ERRORED}, CATCHUP: {STREAMING, ERRORED}, STREAMING: {SNAPSHOT, ERRORED}, ERRORED: {SNAPSHOT, STREAMING}}


class IllegalTransition(ValueError):
    pass


def move(old: str, new: str) -> str:
    """new, if the edge is allowed; staying is."""
    if new != old and new not in EDGES[old]:
        raise IllegalTransition(f"a table can't go from {old} to {new}")
    return new
