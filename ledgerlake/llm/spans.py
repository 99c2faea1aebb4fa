"""Spans in texts and their digest."""

from __future__ import annotations

import hashlib


def joined(spans, kinds: tuple[str, ...]) -> str:
    """kind:start:end by start, then kind as listed, then end, comma-joined."""
    order = {k: i for i, k in enumerate(kinds)}
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda x: (x[1], order[x[0]], x[2])))


def digest(spans, kinds: tuple[str, ...]) -> str:
    return hashlib.sha256(joined(spans, kinds).encode()).hexdigest()
