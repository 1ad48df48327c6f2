"""Twelve weighted scores with confidences, the overall score, and recommendations: one projection."""

from __future__ import annotations

import json
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from turnwise.functions.text import half_even

#: The default weights, in order.
WEIGHTS = {
    "turn_balance": 0.07,
    "correction_efficiency": 0.11,
    "suggestion_acceptance": 0.10,
    "feedback_quality": 0.04,
    "code_discussion_balance": 0.08,
    "phase_coverage": 0.07,
    "prompt_efficiency": 0.07,
    "observability": 0.04,
    "context_retention": 0.09,
    "phase_stability": 0.06,
    "code_quality": 0.09,
    "security_hygiene": 0.18,
}
#: Why each score is given; the second text stands where there is nothing to go by.
RATIONALES = {
    "turn_balance": [
        "Closer to a 1:1 conversational cadence generally indicates tighter iteration loops.",
        "No user turns found; interaction balance is underdetermined.",
    ],
    "correction_efficiency": ["Frequent correction prompts often indicate low first-pass utility."],
    "suggestion_acceptance": [
        "Higher acceptance usually indicates outputs are aligned with developer intent.",
        "No AI suggestions detected, so acceptance cannot be estimated.",
    ],
    "feedback_quality": ["Measured acknowledgements are treated as a weak success proxy."],
    "code_discussion_balance": ["An effective workflow alternates implementation with reasoning and verification."],
    "phase_coverage": ["Coverage across planning, implementation, debugging, and testing is rewarded."],
    "prompt_efficiency": ["Concise but explicit prompts tend to improve assistant reliability."],
    "observability": ["Transparent tool usage can improve reproducibility and debugging traceability."],
    "context_retention": ["Higher lexical overlap across turn pairs indicates stronger intent retention."],
    "phase_stability": ["Stable progression through phases usually reduces context-switch overhead."],
    "code_quality": ["Code quality rewards parseable, maintainable, and well-documented outputs."],
    "security_hygiene": ["Security anti-patterns and exposed secrets are heavily penalized."],
}


def resolve_weights(overrides: dict[str, float] | None = None) -> dict[str, float]:
    """Defaults with overrides; negatives count as 0; the sum is 1. Unknown names and a zero sum are errors."""
    unknown = sorted(set(overrides or {}) - set(WEIGHTS))
    if unknown:
        raise ValueError(f"unknown scores: {', '.join(unknown)}")
    merged = {k: max(float((overrides or {}).get(k, v)), 0.0) for k, v in WEIGHTS.items()}
    total = sum(merged.values())
    if total <= 0:
        raise ValueError("the weights must have a positive sum")
    return {k: v / total for k, v in merged.items()}


def weights_from_file(path: str) -> dict[str, float]:
    with open(path, encoding="utf-8") as f:
        told = json.load(f)
    if isinstance(told, dict) and isinstance(told.get("weights"), dict):
        told = told["weights"]
    if not isinstance(told, dict):
        raise ValueError("a weight file holds one JSON object")
    return resolve_weights({k: float(v) for k, v in told.items()})


def clamp(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), x))


class Dimension(NamedTuple):
    """One score over the metric columns; ``value`` is what it was given for, as JSON text."""

    value: Column
    score: Column
    confidence: Column
    rationale: Column


def _steps(x: Column, *steps: tuple[float, Column | float], above: Column | float) -> Column:
    """The value of the first step whose bound ``x`` does not exceed."""
    out = F.when(F.lit(False), F.lit(None).cast("double"))
    for bound, value in steps:
        out = out.when(x <= bound, value)
    return out.otherwise(above)


def dimensions() -> dict[str, Dimension]:
    c = F.col
    upto = lambda name, most: F.least(c(name), F.lit(most)).cast("double")
    turns, users, ideas, files = "total_turns", "user_turns", "ai_suggestion_count", "ai_code_block_count"
    balance, accepted = c("ai_to_user_turn_ratio"), c("acceptance_rate")
    praise, code, length = c("positive_feedback_ratio"), c("code_turn_ratio"), c("avg_user_prompt_words")
    tools, kept, corrected = c("tool_call_turn_count"), c("context_retention_score"), c("correction_ratio")
    syntax, branching = c("python_syntax_valid_ratio"), c("avg_estimated_cyclomatic_complexity")
    seen = [(c(f"{p}_phase_percentage") > 0).cast("double") for p in ("planning", "implementation", "debugging", "testing")]
    covered = sum(seen, F.lit(0.0)) / 4.0

    quality = (
        F.coalesce(syntax * 100.0, F.lit(55.0)) * 0.35
        + _steps(branching, (8.0, 100.0), above=clamp(100.0 - (branching - 8.0) * 8.0)) * 0.20
        + F.coalesce(c("type_hint_coverage") * 100.0, F.lit(60.0)) * 0.20
        + F.coalesce(c("docstring_coverage") * 100.0, F.lit(60.0)) * 0.15
        + clamp(100.0 - c("long_line_count") * 3.0) * 0.10
    )
    hygiene = (
        100.0
        - c("security_risk_count") * 18.0
        - c("secret_exposure_count") * 28.0
        - c("insecure_dependency_mention_count") * 10.0
        + F.least(c("security_discussion_count") * 2.0, F.lit(10.0))
    )
    scores = {
        "turn_balance": F.when(balance.isNull(), 50.0).otherwise(clamp(100.0 - F.abs(balance - 1.0) * 40.0)),
        "correction_efficiency": clamp((1.0 - corrected) * 100.0),
        "suggestion_acceptance": F.when(accepted.isNull(), 50.0).otherwise(clamp(accepted * 100.0)),
        "feedback_quality": F.when((praise == 0) & (c(users) > 0), 40.0).otherwise(
            _steps(praise, (0.35, clamp(praise / 0.35 * 100.0)), above=clamp(100.0 - (praise - 0.35) * 180.0))
        ),
        "code_discussion_balance": F.when(code < 0.30, clamp(code / 0.30 * 100.0)).otherwise(
            _steps(code, (0.75, 100.0), above=clamp(100.0 - (code - 0.75) * 300.0))
        ),
        "phase_coverage": covered * 100.0,
        "prompt_efficiency": F.when(length == 0, 50.0)
        .when(length < 4, 45.0)
        .otherwise(_steps(length, (60.0, 100.0), (120.0, clamp(100.0 - (length - 60.0) * 1.2)), above=25.0)),
        "observability": F.when(tools == 0, 70.0).otherwise(clamp(70.0 + 6.0 * upto("tool_call_turn_count", 5))),
        "context_retention": clamp(kept),
        "phase_stability": clamp(100.0 - c("phase_switch_rate") * 70.0 - c("phase_loopback_count") * 5.0),
        "code_quality": F.when(c(files) == 0, 65.0).otherwise(clamp(quality)),
        "security_hygiene": clamp(hygiene),
    }
    confidences = {
        "turn_balance": F.when(balance.isNull(), 45.0).otherwise(55.0 + 2.0 * upto(turns, 20)),
        "correction_efficiency": 65.0 + 1.5 * upto(users, 20),
        "suggestion_acceptance": F.when(accepted.isNull(), 50.0).otherwise(50.0 + 2.0 * upto(ideas, 20)),
        "feedback_quality": 60.0 + 1.2 * upto(users, 20),
        "code_discussion_balance": 65.0 + 1.5 * upto(turns, 20),
        "phase_coverage": 70.0 + upto(turns, 20),
        "prompt_efficiency": F.when(length == 0, 40.0).when(length < 4, 60.0).otherwise(_steps(length, (120.0, 80.0), above=75.0)),
        "observability": F.lit(80.0),
        "context_retention": 60.0 + 1.5 * upto(users, 20),
        "phase_stability": 70.0 + upto(turns, 25),
        "code_quality": F.when(c(files) == 0, 45.0).otherwise(55.0 + 2.0 * upto(files, 20)),
        "security_hygiene": 65.0 + 1.2 * upto(turns, 25),
    }
    record = lambda **names: F.to_json(F.struct(*[c(m).alias(k) for k, m in names.items()]), {"ignoreNullFields": "false"})
    values = {
        "turn_balance": balance,
        "correction_efficiency": corrected,
        "suggestion_acceptance": accepted,
        "feedback_quality": praise,
        "code_discussion_balance": code,
        "phase_coverage": covered,
        "prompt_efficiency": length,
        "observability": tools,
        "context_retention": kept,
        "phase_stability": record(phase_switch_rate="phase_switch_rate", phase_loopback_count="phase_loopback_count"),
        "code_quality": record(
            syntax_valid_ratio="python_syntax_valid_ratio",
            avg_complexity="avg_estimated_cyclomatic_complexity",
            type_hint_coverage="type_hint_coverage",
            docstring_coverage="docstring_coverage",
            long_line_count="long_line_count",
        ),
        "security_hygiene": record(
            security_risk_count="security_risk_count",
            secret_exposure_count="secret_exposure_count",
            security_discussion_count="security_discussion_count",
        ),
    }

    def why(name: str) -> Column:
        told = RATIONALES[name]
        return F.lit(told[0]) if len(told) == 1 else F.when(values[name].isNull(), told[1]).otherwise(told[0])

    return {k: Dimension(values[k].cast("string"), scores[k].cast("double"), clamp(confidences[k].cast("double")), why(k)) for k in WEIGHTS}


def score(metrics: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """Adds score_*, score_confidence_*, score_value_*, score_rationale_*, overall_score, overall_confidence, recommendations."""
    chosen = resolve_weights(weights)
    dims = dimensions()
    names = {"": "score", "confidence_": "confidence", "value_": "value", "rationale_": "rationale"}
    x = metrics.withColumns({f"score_{prefix}{k}": getattr(d, part) for prefix, part in names.items() for k, d in dims.items()})
    total, sure = F.lit(0.0), F.lit(0.0)
    for k, v in chosen.items():
        total, sure = total + F.col(f"score_{k}") * F.lit(v), sure + F.col(f"score_confidence_{k}") * F.lit(v)
    #: The sentences and their thresholds.
    rules = [
        (
            F.col("security_risk_count") > 0,
            "Resolve detected security risks in transcript code patterns before adoption (review security_findings).",
        ),
        (
            F.col("secret_exposure_count") > 0,
            "Secrets or credential-like material were detected; rotate secrets and enforce redaction in transcripts.",
        ),
        (
            F.col("acceptance_rate") < 0.4,
            "Increase prompt precision with explicit constraints and acceptance tests to improve first-pass acceptance.",
        ),
        (
            F.col("context_retention_score") < 30.0,
            "Context retention is weak; ask the assistant to restate goals and preserve identifiers across iterations.",
        ),
        (
            F.col("python_syntax_valid_ratio") < 0.8,
            "A significant portion of code snippets is not parseable Python; add syntax checks before accepting outputs.",
        ),
        (
            F.col("score_phase_stability") < 55.0,
            "Workflow phase thrashing detected; separate planning, implementation, and debugging into explicit steps.",
        ),
    ]
    default = "Workflow quality appears strong; continue with the same structure and enforce automated security checks in CI."
    told = F.filter(F.array(*[F.when(c, F.lit(t)) for c, t in rules]), lambda y: y.isNotNull())
    advice = F.when(F.size(told) > 0, told).otherwise(F.array(F.lit(default)))
    return x.withColumns({"overall_score": half_even(total, 2), "overall_confidence": half_even(sure, 2), "recommendations": advice})


def score_rows(scored: DataFrame) -> DataFrame:
    """Long form: (transcript_id, name, score, confidence, value, rationale), numbers rounded to two digits."""
    part = lambda k, p: F.col(f"score_{p}{k}")
    items = [
        F.struct(
            F.lit(k).alias("name"), half_even(part(k, ""), 2).alias("score"), half_even(part(k, "confidence_"), 2).alias("confidence"),
            part(k, "value_").alias("value"), part(k, "rationale_").alias("rationale"),
        )
        for k in WEIGHTS
    ]
    return scored.select("transcript_id", F.explode(F.array(*items)).alias("s")).select("transcript_id", "s.*")


def ranked_scores(scored: DataFrame) -> DataFrame:
    """The score rows with the rank of each in its transcript, best first, ties in the order of the dimensions."""
    order = F.array_position(F.array(*map(F.lit, WEIGHTS)), F.col("name"))
    items = F.struct((-F.col("score")).alias("o"), order.alias("i"), "name", "score", "confidence")
    best = score_rows(scored).groupBy("transcript_id").agg(F.sort_array(F.collect_list(items)).alias("s"))
    x = best.select("transcript_id", F.posexplode("s").alias("rank", "s"))
    return x.select("transcript_id", (F.col("rank") + 1).cast("long").alias("rank"), "s.name", "s.score", "s.confidence")


def portfolio_summary(scored: DataFrame) -> DataFrame:
    """One row: counts, averages, and the best transcript (the smallest id on ties); failed ones count but score nothing.

    A transcript failed if its row, where there is a column ``errors``, has any.
    """
    good = F.size("errors") == 0 if "errors" in scored.columns else F.lit(True)
    mean = lambda c: F.coalesce(half_even(F.avg(F.when(good, F.col(c))), 2), F.lit(0.0))
    best = F.when(good, F.struct("overall_score", (-F.col("transcript_id")).alias("o")))
    return scored.agg(
        F.count("*").alias("transcript_count"),
        F.count_if(good).alias("successful_evaluations"),
        F.count_if(~good).alias("failed_evaluations"),
        mean("overall_score").alias("average_overall_score"),
        mean("overall_confidence").alias("average_overall_confidence"),
        F.max_by("transcript_id", best).alias("best_transcript"),
        F.coalesce(F.sum(F.when(good, F.col("security_risk_count"))), F.lit(0)).alias("total_security_risks"),
        mean("context_retention_score").alias("average_context_retention"),
    )
