"""REC-06: a stage of a plan whose failure becomes rows, so that the other stages and questions go on."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.retrieval import RetrievalOutage
from ..session import DEFAULTS, kept


class BudgetSpent(RuntimeError):
    """A stage would cost more than its questions may."""


def failure_state(error: Exception) -> str:
    if isinstance(error, RetrievalOutage):
        return "outage"
    if isinstance(error, BudgetSpent):
        return "budget"
    return "timeout" if isinstance(error, TimeoutError) else "failed"


def guarded(questions: DataFrame, node: str, stage: Callable[[DataFrame], DataFrame], attempts: int = DEFAULTS.recovery_attempts) -> tuple[DataFrame | None, DataFrame]:
    """What the stage gives (None if it failed), and its events: query_id, node, event, state and attempt.

    The stage is worked out here, so that its failure is seen here. An outage uses up all attempts (there is nothing to try again
    with); every other failure counts one. questions: query_id, attempt.
    """
    begun = questions.select("query_id", F.lit(node).alias("node"), F.lit("started").alias("event"), F.lit("running").alias("state"), "attempt")
    try:
        out, state = kept(stage(questions)), "completed"
    except Exception as error:  # noqa: BLE001  whatever a stage raises is its questions' failure
        out, state = None, failure_state(error)
    attempt = F.col("attempt") if out is not None else F.lit(attempts) if state == "outage" else F.col("attempt") + 1
    ended = questions.select("query_id", F.lit(node).alias("node"), F.lit("finished" if out is not None else "failed").alias("event"), F.lit(state).alias("state"), attempt.cast("int").alias("attempt"))
    return out, begun.unionByName(ended)
