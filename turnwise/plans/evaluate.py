"""From a turn table or from files to scored transcripts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from turnwise.operators.metrics import Evaluator, compute_metrics, kept_facts
from turnwise.operators.normalize import normalize_turns
from turnwise.operators.phases import label_phases, timeline
from turnwise.operators.report import normalized_turns
from turnwise.operators.scoring import score


@dataclass(frozen=True)
class Evaluation:
    """``results``: one row per transcript, with its timeline; ``turns``: the normalised turns with their phases."""

    results: DataFrame
    turns: DataFrame


def evaluate(
    turns: DataFrame,
    strip_sensitive: bool = False,
    keep_system: bool = False,
    phases: bool = True,
    weights: dict[str, float] | None = None,
    extra: list[tuple[str, Evaluator]] | None = None,
) -> DataFrame:
    """One row per transcript: all metrics, scores, confidences, findings and recommendations."""
    return score(compute_metrics(normalize_turns(turns, strip_sensitive, keep_system, once=False), phases, extra), weights)


def evaluate_fully(
    turns: DataFrame,
    strip_sensitive: bool = False,
    keep_system: bool = False,
    phases: bool = True,
    weights: dict[str, float] | None = None,
    extra: list[tuple[str, Evaluator]] | None = None,
    with_timeline: bool = True,
) -> Evaluation:
    """As ``evaluate``, with the phase timeline of each transcript and its turns."""
    normal = normalize_turns(turns, strip_sensitive, keep_system, once=False)
    facts = kept_facts(normal, bool(extra))
    labelled = label_phases(facts, phases)
    results = score(compute_metrics(normal, phases, extra, facts), weights)
    if with_timeline:
        results = results.join(timeline(labelled).withColumnRenamed("timeline", "phase_timeline"), "transcript_id", "left")
    return Evaluation(results, normalized_turns(normalize_turns(turns, strip_sensitive, keep_system), labelled))
