"""Batches that mix kinds of change."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping

from pyspark.sql import DataFrame

from parcelyard.schemas import ASSETS

Job = Callable[[Mapping[str, DataFrame], DataFrame], dict[str, DataFrame]]


def apply_runs(
    tables: Mapping[str, DataFrame],
    runs: Iterable[tuple[Job, DataFrame]],
    store: Callable[[DataFrame], DataFrame] | None = None,
) -> dict[str, DataFrame]:
    """Apply change sets of different kinds in the order of their requests.

    Each run holds requests of one kind that may be applied together. ``store`` cuts the lineage of
    the changed tables after each run, for example by ``DataFrame.checkpoint``.
    Photos to remove are gathered over all runs.
    """
    state, gathered = dict(tables), None
    for job, changes in runs:
        changed = job(state, changes)
        changed = {name: store(rows) if store else rows for name, rows in changed.items()}
        assets = changed.pop(ASSETS, None)
        if assets is not None:
            gathered = assets if gathered is None else gathered.unionByName(assets)
        state |= changed
    return state if gathered is None else {**state, ASSETS: gathered}
