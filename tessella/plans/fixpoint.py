"""The loop of all iterative operators: write the state, look at a few numbers, go on.

Each round's state is written to the shared folder and the one before it
deleted, so that plans do not grow with the rounds and a lost executor costs
at most one round.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from tessella.plans.store import Scratch


def fixpoint(state: DataFrame, step: Callable[[DataFrame, int], DataFrame], done: Callable[[DataFrame, int], bool], max_rounds: int, scratch: Scratch) -> tuple[DataFrame, int, bool]:
    """(last state, rounds, whether ``done`` held).  ``done`` sees each new state once; it runs the round's only action besides the write."""
    now = scratch.keep(state)
    for k in range(max_rounds):
        fresh = scratch.keep(step(now, k))
        scratch.drop(now)
        now = fresh
        if done(now, k):
            return now, k + 1, True
    return now, max_rounds, False
