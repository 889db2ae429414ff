"""Bounded samples by hash."""

from __future__ import annotations


def cutoff(rows: int, count: int) -> int:
    """The 63-bit hash up to which about ``rows`` of ``count`` rows are taken, all where there are no more; for any count."""
    return (1 << 63) - 1 if count <= rows else (rows << 63) // count
