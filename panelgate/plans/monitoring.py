"""Gates over whole version tables."""

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelgate.operators.joins import spread_join
from panelgate.operators.metrics import TOLERANCE, monitor_pair, score_two, validate_pair
from panelgate.operators.versions import promote, version_pairs
from panelgate.storage import scratch_table


def validate_and_promote(
    versions: DataFrame, scored: DataFrame, tol: float = TOLERANCE
) -> DataFrame:
    """Versions after the gate: models whose two predictions agree move to Staging.

    ``scored`` holds ``name, y, y_hat1, y_hat2``.
    """
    return promote(versions, validate_pair(score_two(scored, by=["name"]), tol))


def monitor(
    versions: DataFrame,
    examples: DataFrame,
    score: Callable[[DataFrame], DataFrame],
    tol: float = TOLERANCE,
) -> DataFrame:
    """Newest Production version of every model against the one numbered below.

    ``examples`` holds ``name``, the features and ``y``. ``score`` adds ``y_hat1``
    for ``version`` and ``y_hat2`` for ``previous_version``; both models then see
    the same rows, in one pass. Row order plays no part in the errors, so nothing
    is sorted. Every model has a row: where nothing could be compared, the outcome
    says why (``too few versions``, ``no previous version``, ``no examples``).
    """
    # One row per model, written down: looked up once, used for the join and the report.
    pairs = scratch_table(version_pairs(versions), "pairs")
    comparable = pairs.filter("previous_found").select("name", "version", "previous_version")
    scored = score(spread_join(examples, comparable, ["name"]))
    compared = monitor_pair(
        score_two(scored, by=["name", "version", "previous_version"]), tol
    ).drop("version", "previous_version")
    reason = (
        F.when(~F.col("ok"), "too few versions")
        .when(~F.col("previous_found"), "no previous version")
        .otherwise("no examples")
    )
    return pairs.join(compared, "name", "left").select(
        "name", "version", "previous_version",
        "mse1", "mse2", "difference", F.coalesce("outcome", reason).alias("outcome"),
    )
