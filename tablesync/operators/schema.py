"""Column changes between two versions of a source table's schema."""

from __future__ import annotations

from dataclasses import dataclass

from ..functions.pgtypes import type_name


@dataclass(frozen=True)
class ColumnChange:
    kind: str  # add, drop, rename, retype
    column: str
    new: str | None = None  # the new name of a rename; the new type of an add or retype
    old: str | None = None  # the old type of a retype


def schema_diff(old: list[tuple[str, int]], new: list[tuple[str, int]]) -> list[ColumnChange]:
    """Changes from old to new, lists of (name, type id).

    A changed type stands alone, as it can't be applied. A name that went and one that came at the
    same place with the same type are a rename; what else went is dropped, what else came is added.
    Drops and adds are in the order of their columns.
    """
    was, now = dict(old), dict(new)
    retyped = [ColumnChange("retype", name, type_name(kind), type_name(was[name])) for name, kind in new if name in was and was[name] != kind]
    if retyped:
        return retyped
    renames = {a: b for (a, ka), (b, kb) in zip(old, new, strict=False) if a not in now and b not in was and ka == kb}
    return [
        *(ColumnChange("rename", a, b) for a, b in renames.items()),
        *(ColumnChange("drop", a) for a, _ in old if a not in now and a not in renames),
        *(ColumnChange("add", b, type_name(kind)) for b, kind in new if b not in was and b not in renames.values()),
    ]
