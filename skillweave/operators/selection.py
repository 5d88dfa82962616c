"""Gates and the per-repository cap over scored units."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skillweave.functions.vocab import SCORES
from skillweave.operators.ranking import within_top

MIN_SELECTION, MIN_SKILL_VALUE, MAX_PER_REPO = 0.50, 0.45, 400


def mean_score(scores: list[Column]) -> Column:
    """Plain sum in a fixed order over the number of scores, the same on every engine."""
    total = scores[0]
    for s in scores[1:]:
        total = total + s
    return total / float(len(scores))


def tag_mean(tag: str = "") -> Column:
    prefix = f"{tag}." if tag else ""
    return mean_score([F.col(f"{prefix}{s}_score") for s in SCORES])


def passes_selection(keep: Column, mean: Column, least: float = MIN_SELECTION) -> Column:
    return F.coalesce(keep, F.lit(False)) & (mean >= least)


def passes_value(worth: Column, value: Column, least: float = MIN_SKILL_VALUE) -> Column:
    return F.coalesce(worth, F.lit(False)) & (value >= least)


def repository_cap(
    units: DataFrame, repo: str = "repo_path", mean: str = "mean", key: str = "data_id", k: int = MAX_PER_REPO
) -> DataFrame:
    """units with selected: among the best k of their repository by mean, then id. A null repository is one."""
    return within_top(units, repo, key, [F.col(mean).desc(), F.col(key).asc()], k)
