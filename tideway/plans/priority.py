"""Smallest complete job: categorical decisions to probabilities and their score."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from tideway.operators.choices import expand_by_context, mark_selected, require_selected
from tideway.operators.evaluation import nlp
from tideway.operators.norms import Norm, apply_norm
from tideway.operators.scoring import LinearModel, choice_probability, score


def scored_choices(
    decisions: DataFrame, facts: DataFrame, on: Sequence[str], actual: str, alternative: str,
    classes: Sequence, spec: dict[str, Norm], params: DataFrame, model: LinearModel,
) -> DataFrame:
    """Expand, label, scale, score and normalise."""
    choices = expand_by_context(decisions, facts, on, alternative, classes)
    labelled = require_selected(mark_selected(choices, actual, alternative))
    return choice_probability(score(apply_norm(labelled, spec, params), model))


def split_score(scored: DataFrame) -> DataFrame:
    """Log likelihood per split, individuals weighted alike."""
    return nlp(scored, "decision", by=["_train"])
