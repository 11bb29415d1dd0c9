"""Staging in the folder that driver and executors share, and small helpers."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame

from tetraflow.staging import shared_folder as shared_dir  # noqa: F401
from tetraflow.staging import staged as stage  # noqa: F401


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores before it as keep it from meeting a column of ``df``."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        out.append(name)
        taken.add(name.lower())
    return out


def slices(batches: Iterator, limit: int) -> Iterator:
    """Arrow batches cut to at most ``limit`` rows, so that long texts stay bounded."""
    for batch in batches:
        for at in range(0, batch.num_rows, limit):
            yield batch.slice(at, limit)
