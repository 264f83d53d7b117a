"""Numbered changes to a store's layout, each applied once and in order."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import SparkSession

from quarry.sources import files


def version(spark: SparkSession, path: str) -> int:
    """The number of the last change that was applied, or 0."""
    return max((int(n.split(".")[0]) for n in files.names(spark, f"{path}/applied") if n.endswith(".json")), default=0)


def migrate(spark: SparkSession, path: str, changes: dict[int, Callable[[SparkSession, str], None]]) -> list[int]:
    """Applies what is newer than the store; returns the numbers.  One that fails is not recorded, and ends the run.

    Of two runs at once only one records a number; the other raises, so a
    change must bear being applied again.
    """
    if sorted(changes) != list(range(1, len(changes) + 1)):
        raise ValueError("changes must be numbered from 1 without gaps")
    done = []
    for number in range(version(spark, path) + 1, len(changes) + 1):
        changes[number](spark, path)
        if not files.write_text_atomic(spark, f"{path}/applied/{number:06d}.json", json.dumps({"number": number})):
            raise RuntimeError(f"change {number} was applied by another run")
        done.append(number)
    return done
