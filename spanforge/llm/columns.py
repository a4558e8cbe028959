"""Names that do not clash with a table's own columns."""

from __future__ import annotations

from collections.abc import Iterable


def unused(name: str, taken: Iterable[str]) -> str:
    """name, with as many underscores behind it as it takes to differ from all others (in any case)."""
    have = {t.lower() for t in taken}
    while name.lower() in have:
        name += "_"
    return name


def beside(kept: Iterable[str], own: Iterable[str]) -> dict[str, str]:
    """For each kept column the name it goes by beside an operator's own columns, which keep theirs."""
    out, own = {}, list(own)
    for c in kept:
        out[c] = unused(c, [*own, *out.values()])
    return out
