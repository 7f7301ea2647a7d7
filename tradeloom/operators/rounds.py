"""Several rounds of an iteration between two writes of its state."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradeloom.session import durable

#: Rounds that one job makes. Each adds a shuffle to its plan; a write and its listing are paid once.
AT_ONCE = 2


def advance(state: DataFrame, one_round: Callable[[DataFrame], DataFrame], first: int, rounds: int = AT_ONCE) -> DataFrame:
    """A durable table of the states after ``rounds`` rounds, with their numbers from ``first`` in ``round``.

    A state that a later one is made from isn't computed again: both read the same shuffle.
    """
    made = []
    for k in range(rounds):
        state = one_round(state)
        made.append(state.withColumn("round", F.lit(first + k)))
    return durable(reduce(DataFrame.unionByName, made))
