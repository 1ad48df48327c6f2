"""Per-transcript metrics over normalised turns.

The text and the code of a turn are read once, into small facts.  A ``Part`` is a set of metrics over
these facts: what it must see ahead of a turn, its aggregates and its columns.  All parts share one
window pass and one aggregation with map-side partial sums, so a transcript with a third of the turns is
no hot spot.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from turnwise.functions.text import LINE_BREAK, half_even, has_term, keywords, normal_tokens, ratio, term_hits
from turnwise.operators.codeintel import MEASURES, RISKS, analyze_blocks, is_python_candidate, line_risks, secret_count
from turnwise.operators.normalize import SPEAKERS, is_code_turn
from turnwise.operators.phases import PHASES, RANKS, label_phases, step
from turnwise.operators.sequence import delivered_once, look_ahead, next_row
from turnwise.session import ensure_checkpoint_dir

#: The term lists, in normal form.
CORRECTION = [
    "not quite", "try again", "incorrect", "wrong", "fix this", "does not work", "failed", "error", "change that",
]
REJECTION = ["no", "not this", "different approach", "start over", "discard", "replace", "that is wrong"]
POSITIVE = ["good", "great", "perfect", "nice", "thanks", "thank you", "looks good", "works"]
CONTINUATION = ["now", "next", "also", "can you add", "please add", "extend", "continue", "looks good", "proceed"]
DEPENDENCIES = ["event-stream", "ua-parser-js", "axios", "left-pad"]
SECURITY = [
    "security", "sanitize", "escape", "validate", "csrf", "xss", "sql injection", "auth", "authorization", "least privilege", "secrets",
]
SPECIFICITY = [
    "requirements", "constraint", "validate", "test", "edge case", "error handling", "performance", "security", "modular", "scalable",
    "json", "cli", "frontend", "report",
]
TOOL_MENTION = r"(?i)\b(?:tool|run_in_terminal|function call|execute command|shell command|terminal)\b"
TOKENS_PER_WORD = 1.35
#: A bearer mark may end a turn with its token opening the next one, as the turns are joined by line breaks.
BEARER_END = r"(?i)\bBearer$"
BEARER_HEAD = r"^[A-Za-z0-9\-._~+/]+=*\b"

KEY = "transcript_id"


def _by(speaker: str) -> Column:
    return F.col("speaker") == speaker


# --- facts ----------------------------------------------------------------------------------------


def _specificity(words: Column, norm: Column, text: Column) -> Column:
    length = F.when(words < 4, 25.0).when(words <= 14, 70.0).when(words <= 60, 100.0).when(words <= 120, 80.0).otherwise(55.0)
    named = F.least(term_hits(norm, SPECIFICITY), F.lit(6)) / 6.0 * 100.0
    signs = [text.contains(":"), text.contains("\n"), text.rlike("must|should|need|required"), text.rlike(r"\p{Nd}")]
    share = sum((s.cast("int") for s in signs[1:]), signs[0].cast("int")) / 4.0 * 100.0
    return F.lit(0.4) * length + F.lit(0.4) * named + F.lit(0.2) * share


def code_facts(blocks: Column) -> Column:
    """The measures of a turn's code blocks as one struct: line measures and risks in expressions, the rest by syntax trees.

    Risks of a block come from its syntax tree where it parses, else line by line.
    """
    python = lambda b: is_python_candidate(b["code"], b["language"])
    marked = F.transform(blocks, lambda b: F.struct(b["code"].alias("code"), python(b).alias("py")))

    def measure(m: Column) -> Column:
        candidates = F.transform(F.filter(m, lambda b: b["py"]), lambda b: b["code"])
        others = F.transform(F.filter(m, lambda b: ~b["py"]), lambda b: b["code"])
        lines = F.flatten(F.transform(m, lambda b: F.split(b["code"], LINE_BREAK)))
        return F.struct(
            F.size(m).alias("blocks"),
            candidates.alias("candidates"),
            others.alias("others"),
            F.size(F.filter(lines, lambda x: x.rlike(r"(?U)\S"))).alias("code_lines"),
            F.size(F.filter(lines, lambda x: F.length(F.regexp_replace(x, r"(?U)\s+$", "")) > 120)).alias("long_lines"),
            F.size(F.filter(lines, lambda x: x.rlike(r"(?U)^\s*#"))).alias("comments"),
        )

    return F.get(F.transform(F.array(marked), measure), F.lit(0))


def _with_code(x: DataFrame) -> DataFrame:
    """Adds ``code``.  Syntax trees are Python's; only the codes of candidates go there."""
    x = x.withColumn("_c", code_facts(F.when(_by("AI"), F.col("blocks")).otherwise(F.slice("blocks", 1, 0))))
    x = x.withColumn("_a", analyze_blocks("_c.candidates"))
    unparsed = F.filter(F.arrays_zip("_c.candidates", "_a.parsed"), lambda z: ~z["parsed"])
    by_line = F.concat("_c.others", F.transform(unparsed, lambda z: z["candidates"]))
    risks = F.transform(F.array(F.array_join(by_line, "\n")), lambda t: F.struct(*[c.alias(k) for k, c in line_risks(t).items()]))
    x = x.withColumns({"_r": F.get(risks, F.lit(0)), "_l": F.size(by_line)})
    told = {k: F.col(f"_c.{k}") for k in ("blocks", "code_lines", "long_lines", "comments")}
    told |= {"candidates": F.size("_c.candidates"), "by_line": F.col("_l"), **{m: F.col(f"_a.{m}") for m in MEASURES}}
    told |= {f"r_{k}": F.col(f"_a.{k}") + F.col(f"_r.{k}") for k in RISKS}
    code = F.struct(*[told[k].cast("long").alias(k) for k in CODE_FIELDS])
    return x.withColumn("code", code).drop("_c", "_a", "_r", "_l")


def turn_facts(turns: DataFrame, names: list[str] | None = None) -> DataFrame:
    """Adds the facts of each turn, or those named, which alone are then planned."""
    text, norm = F.col("content"), F.col("norm")
    bearer = lambda t: secret_count(t, ["bearer"])
    facts: dict[str, Callable[[], Column]] = {
        "words": lambda: F.size("norm").cast("long"),
        "is_code": lambda: is_code_turn(F.col("blocks"), text),
        "tool_call": lambda: _by("Tool") | text.rlike(TOOL_MENTION),
        "corrects": lambda: has_term(norm, CORRECTION),
        "rejects": lambda: has_term(norm, REJECTION),
        "approves": lambda: has_term(norm, POSITIVE),
        "continues": lambda: has_term(norm, CONTINUATION),
        "kw": lambda: F.when(_by("User") | _by("AI"), keywords(text)),
        "specific": lambda: F.when(_by("User"), _specificity(F.size("norm"), norm, text)),
        "secure": lambda: has_term(norm, SECURITY),
        "depends": lambda: has_term(norm, DEPENDENCIES),
        "step": lambda: step("speaker", "size(blocks) > 0", "content"),
        "secrets": lambda: secret_count(text),
        "bearer_end": lambda: text.rlike(BEARER_END),
        "filled": lambda: text != "",
        "bearer_head": lambda: F.when(text.rlike(BEARER_HEAD), bearer(F.regexp_replace(text, BEARER_HEAD, "")) - bearer(text) + 1),
        "languages": lambda: F.when(_by("AI"), F.filter(F.transform("blocks", lambda b: b["language"]), lambda v: v.isNotNull())),
    }
    chosen = {k: make() for k, make in facts.items() if names is None or k in names}
    x = turns
    if not chosen.keys().isdisjoint(_OF_TOKENS):
        x = x.withColumn("norm", normal_tokens(text))
    x = (x.withColumns(chosen) if chosen else x).drop("norm")
    return _with_code(x) if names is None or "code" in names else x


#: Facts made from the tokens of a turn.
_OF_TOKENS = {"words", "corrects", "rejects", "approves", "continues", "specific", "secure", "depends"}
#: The type of the fact ``code``.
CODE_FIELDS = ["blocks", "code_lines", "long_lines", "comments", "candidates", "by_line", *MEASURES, *[f"r_{k}" for k in RISKS]]
CODE_TYPE = "struct<" + ",".join(f"{k}:bigint" for k in CODE_FIELDS) + ">"
#: The facts kept of a turn; its text and code are not among them.
FACTS = [
    KEY, "turn_idx", "_block", "speaker", "words", "is_code", "tool_call", "corrects", "rejects", "approves", "continues", "kw", "specific",
    "secure", "depends", "step", "secrets", "bearer_end", "filled", "bearer_head", "code", "languages",
]


# --- parts ----------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Part:
    """Metrics over turn facts: what they see ahead ({name: (condition, value)}), aggregates, and columns over these."""

    reads: list[str]
    aggregates: list[Column]
    columns: list[Column]
    ahead: dict[str, tuple[Column, Column | None]] = field(default_factory=dict)
    from_end: bool = False


def metrics_of(facts: DataFrame, *parts: Part) -> DataFrame:
    """One row per transcript with the columns of all parts: one window pass (if any part looks ahead) and one aggregation."""
    reads = list(dict.fromkeys([KEY, "turn_idx", "_block", *[r for p in parts for r in p.reads]]))
    x = facts.select(*reads)
    ahead = {k: v for p in parts for k, v in p.ahead.items()}
    if ahead or any(p.from_end for p in parts):
        x = look_ahead(x, KEY, "turn_idx", ahead, "from_end" if any(p.from_end for p in parts) else None)
    a = x.groupBy(KEY).agg(*[c for p in parts for c in p.aggregates])
    return a.select(KEY, *[c for p in parts for c in p.columns])


def _count(condition: Column) -> Column:
    return F.count_if(condition).cast("long")


def _sum(value: Column | str, condition: Column | None = None) -> Column:
    value = F.col(value) if isinstance(value, str) else value
    return F.coalesce(F.sum(value if condition is None else F.when(condition, value)), F.lit(0)).cast("long")


def _mean(value: Column, digits: int) -> Column:
    return F.coalesce(half_even(F.avg(value), digits), F.lit(0.0))


def _tokens(words: str) -> Column:
    return F.ceil(F.col(words) * F.lit(TOKENS_PER_WORD)).cast("long")


def _conversation() -> Part:
    c = F.col
    talk = c("total_turns") - c("code_turn_count")
    return Part(
        ["speaker", "words", "is_code", "tool_call"],
        [
            F.count("*").alias("total_turns"), _count(_by("User")).alias("user_turns"), _count(_by("AI")).alias("ai_turns"),
            _count(c("speaker") == "Tool").alias("tool_turns"), _sum("words", _by("User")).alias("user_word_count"),
            _sum("words", _by("AI")).alias("ai_word_count"), _count(c("is_code")).alias("code_turn_count"),
            _count(c("tool_call")).alias("tool_call_turn_count"),
        ],
        [
            c("total_turns"), c("user_turns"), c("ai_turns"), c("tool_turns"),
            ratio(c("ai_turns"), c("user_turns"), 3).alias("ai_to_user_turn_ratio"), c("user_word_count"), c("ai_word_count"),
            _tokens("user_word_count").alias("estimated_user_tokens"), _tokens("ai_word_count").alias("estimated_ai_tokens"),
            (_tokens("user_word_count") + _tokens("ai_word_count")).alias("estimated_total_tokens"),
            ratio(c("user_word_count"), c("user_turns"), 2, 0.0).alias("avg_user_prompt_words"),
            ratio(c("ai_word_count"), c("ai_turns"), 2, 0.0).alias("avg_ai_response_words"), c("code_turn_count"),
            talk.alias("discussion_turn_count"), ratio(c("code_turn_count"), c("total_turns"), 3, 0.0).alias("code_turn_ratio"),
            ratio(c("code_turn_count"), talk, 3).alias("code_to_discussion_ratio"), c("tool_call_turn_count"),
        ],
    )


def _suggestions() -> Part:
    """Each AI turn is a suggestion, judged by the next User turn."""
    c = F.col
    no = F.lit(False)
    judged = F.struct((c("rejects") | c("corrects")).alias("r"), (c("approves") | c("continues")).alias("a"))
    rejected = _by("AI") & F.coalesce(c("verdict.r"), no)
    accepted = _by("AI") & ~F.coalesce(c("verdict.r"), no) & F.coalesce(c("verdict.a"), no)
    n, yes, nay = c("ai_suggestion_count"), c("accepted_suggestion_count"), c("rejected_suggestion_count")
    return Part(
        ["speaker", "rejects", "corrects", "approves", "continues"],
        [
            _count(_by("User")).alias("_users"), _count(_by("User") & c("corrects")).alias("correction_count"),
            _count(_by("User") & c("approves")).alias("positive_feedback_count"), _count(_by("AI")).alias("ai_suggestion_count"),
            _count(accepted).alias("accepted_suggestion_count"), _count(rejected).alias("rejected_suggestion_count"),
        ],
        [
            c("correction_count"), ratio(c("correction_count"), c("_users"), 3, 0.0).alias("correction_ratio"),
            c("positive_feedback_count"), ratio(c("positive_feedback_count"), c("_users"), 3, 0.0).alias("positive_feedback_ratio"),
            n, yes, nay, (n - yes - nay).alias("unresolved_suggestion_count"), ratio(yes, n, 3).alias("acceptance_rate"),
            ratio(nay, n, 3).alias("rejection_rate"),
        ],
        {"verdict": (_by("User"), judged)},
    )


def _retention() -> Part:
    """Mean share of a prompt's keywords that the next AI turn takes up, times 100; 0.0 without any."""
    counted = _by("User") & F.col("ai_kw").isNotNull() & (F.size("kw") > 0)
    share = F.when(counted, F.size(F.array_intersect("kw", "ai_kw")) / F.size("kw"))
    mean = F.coalesce(half_even(F.avg(share) * 100.0, 2), F.lit(0.0)).alias("context_retention_score")
    return Part(["speaker", "kw"], [mean], [F.col("context_retention_score")], {"ai_kw": (_by("AI"), F.col("kw"))})


def _simple(reads: list[str], **aggregates: Column) -> Part:
    return Part(reads, [c.alias(k) for k, c in aggregates.items()], [F.col(k) for k in aggregates])


def _secrets() -> Part:
    """Secrets of the turns joined by line breaks: a bearer mark at a turn's end takes its token from the next filled turn."""
    over = F.when(F.col("bearer_end"), F.col("next_head"))
    return Part(
        ["secrets", "bearer_end", "bearer_head", "filled"],
        [(_sum("secrets") + _sum(over)).alias("secret_exposure_count")],
        [F.col("secret_exposure_count")],
        {"next_head": (F.col("filled"), F.col("bearer_head"))},
    )


def _code() -> Part:
    c = F.col
    of = lambda m: F.col(f"code.{m}")
    files = c("ai_code_block_count")
    cand, parsed, funcs = c("python_candidate_block_count"), c("parseable_python_block_count"), c("function_count")
    risks = [c(f"_r_{k}") for k in RISKS]
    every = sum(risks[1:], risks[0])
    entries = F.array(*[F.struct(F.lit(k).alias("k"), c(f"_r_{k}").alias("v")) for k in sorted(RISKS)])
    entries = F.filter(entries, lambda e: (e["v"] > 0) | (c("_by_line") > 0))
    severity = lambda e: F.when(e["k"] == "weak_hashing", "medium").otherwise("high").alias("severity")
    high = F.transform(F.filter(entries, lambda e: e["v"] > 0), lambda e: F.struct(e["k"].alias("type"), e["v"].alias("count"), severity(e)))
    secret = F.array(F.struct(F.lit("secret_exposure").alias("type"), c("secret_exposure_count").alias("count"), F.lit("critical").alias("severity")))
    exposed = F.when(c("secret_exposure_count") > 0, secret).otherwise(F.slice(secret, 1, 0))
    total = every + c("secret_exposure_count")
    return Part(
        ["code"],
        [
            _sum(of("blocks")).alias("ai_code_block_count"), _sum(of("code_lines")).alias("ai_code_line_count"),
            _sum(of("candidates")).alias("python_candidate_block_count"), _sum(of("n_parsed")).alias("parseable_python_block_count"),
            _sum(of("complexity")).alias("_cx"), F.coalesce(F.max(of("most_complex")), F.lit(0)).cast("long").alias("_cm"),
            _sum(of("functions")).alias("function_count"), _sum(of("lines")).alias("_fl"), _sum(of("typed")).alias("_ty"),
            _sum(of("documented")).alias("_do"), _sum(of("tries")).alias("_tr"), _sum(of("long_lines")).alias("long_line_count"),
            _sum(of("comments")).alias("_co"), _sum(of("by_line")).alias("_by_line"),
            *[_sum(of(f"r_{k}")).alias(f"_r_{k}") for k in RISKS],
        ],
        [
            files, c("ai_code_line_count"), cand, (files - cand).alias("non_python_code_block_count"), parsed,
            ratio(parsed, cand, 3).alias("python_syntax_valid_ratio"),
            ratio(c("_cx"), parsed, 2, 0.0).alias("avg_estimated_cyclomatic_complexity"),
            c("_cm").alias("max_estimated_cyclomatic_complexity"), funcs, ratio(c("_fl"), funcs, 2, 0.0).alias("avg_function_length"),
            ratio(c("_ty"), funcs, 3).alias("type_hint_coverage"), ratio(c("_do"), funcs, 3).alias("docstring_coverage"),
            ratio(c("_tr"), parsed, 3, 0.0).alias("exception_handling_density"), c("long_line_count"),
            ratio(c("_co"), F.greatest(c("ai_code_line_count"), F.lit(1)), 3, 0.0).alias("comment_density"),
            total.alias("security_risk_count"), every.alias("insecure_code_pattern_count"),
            ratio(total, F.greatest(files, F.lit(1)), 3, 0.0).alias("security_issue_density"),
            F.map_from_entries(entries).alias("security_risk_breakdown"), F.concat(high, exposed).alias("security_findings"),
        ],
    )


def _latency() -> Part:
    """Mean distance in turns from a User turn to the next AI turn; 0.0 without any."""
    far = F.when(_by("User"), F.col("from_end") - F.col("ai_from_end"))
    mean = _mean(far, 2).alias("avg_response_latency_turns")
    return Part(["speaker"], [mean], [F.col("avg_response_latency_turns")], {"ai_from_end": (_by("AI"), None)}, from_end=True)


#: The parts of a full evaluation that read turn facts alone, in order.
PARTS: dict[str, Callable[[], Part]] = {
    "conversation": _conversation,
    "latency": _latency,
    "suggestions": _suggestions,
    "retention": _retention,
    "specificity": lambda: _simple(["specific"], prompt_specificity_score=_mean(F.col("specific"), 2)),
    "mentions": lambda: _simple(
        ["secure", "depends"],
        security_discussion_count=_count(F.col("secure")),
        insecure_dependency_mention_count=_count(F.col("depends")),
    ),
    "secrets": _secrets,
    "code": _code,
}


# --- transitions ----------------------------------------------------------------------------------


def transitions(rows: DataFrame, group: str, order: str, state: str) -> DataFrame:
    """(group, src, dst, weight) of adjacent states; ``_block`` must exist."""
    x = next_row(rows.select(group, order, "_block", state), group, order, F.col(state), "dst").where("dst IS NOT NULL")
    return x.groupBy(group, F.col(state).alias("src"), "dst").agg(F.count("*").alias("weight"))


def dense_transitions(edges: DataFrame, groups: DataFrame, group: str, domain: list[str]) -> DataFrame:
    """The zero-filled matrix: every group with every pair of the label domain (a fixed handful of labels)."""
    pairs = F.array(*[F.struct(F.lit(a).alias("src"), F.lit(b).alias("dst")) for a in domain for b in domain])
    cells = groups.select(group).distinct().select(group, F.explode(pairs).alias("c")).select(group, "c.src", "c.dst")
    weight = F.coalesce("weight", F.lit(0)).cast("long").alias("weight")
    return cells.join(edges, [group, "src", "dst"], "left").select(group, "src", "dst", weight)


def _matrix(edges: DataFrame, domain: list[str], name: str) -> DataFrame:
    """Nested map and ordered edge list of a transition table."""
    rank = lambda c: F.array_position(F.array(*map(F.lit, domain)), F.col(c))
    edge = F.struct(rank("src").alias("i"), rank("dst").alias("j"), F.col("src").alias("source"), F.col("dst").alias("target"), "weight")
    e = edges.groupBy(KEY).agg(F.sort_array(F.collect_list(edge)).alias("e"))
    cell = lambda x: F.struct(F.concat_ws("\u0001", x["source"], x["target"]).alias("k"), x["weight"].alias("v"))
    at = lambda a, b: F.coalesce(F.try_element_at("m", F.lit(f"{a}\u0001{b}")), F.lit(0)).cast("long")
    row = lambda a: F.create_map(*[y for b in domain for y in (F.lit(b), at(a, b))])
    dense = F.create_map(*[y for a in domain for y in (F.lit(a), row(a))])
    told = F.transform("e", lambda x: F.struct(x["source"].alias("source"), x["target"].alias("target"), x["weight"].alias("weight")))
    e = e.withColumn("m", F.map_from_entries(F.transform("e", cell)))
    return e.select(KEY, dense.alias(f"{name}_transition_matrix"), told.alias(f"{name}_transition_edges"))


def phase_dynamics(labelled: DataFrame) -> DataFrame:
    """Switches, their rate, loopbacks and the share of each phase over (transcript_id, turn_idx, _block, phase)."""
    x = next_row(labelled.select(KEY, "turn_idx", "_block", "phase"), KEY, "turn_idx", F.col("phase"), "nxt")

    def rank(c: str) -> Column:
        out = F.lit(None).cast("int")
        for p, n in RANKS.items():
            out = F.when(F.col(c) == p, n).otherwise(out)
        return out

    loop = (rank("nxt") < rank("phase")) & (F.col("nxt") != "discussion")
    a = x.groupBy(KEY).agg(
        F.count("*").alias("_n"), _count(F.col("nxt") != F.col("phase")).alias("context_switch_count"),
        _count(loop).alias("phase_loopback_count"), *[_count(F.col("phase") == p).alias(f"_{p}") for p in PHASES],
    )
    n, switches = F.col("_n"), F.col("context_switch_count")
    rate = F.when(n > 1, half_even(switches / F.greatest(n - 1, F.lit(1)), 3)).otherwise(F.lit(0.0)).alias("phase_switch_rate")
    shares = [half_even(F.col(f"_{p}") / n * 100.0, 2).alias(f"{p}_phase_percentage") for p in PHASES]
    return a.select(KEY, "context_switch_count", rate, "phase_loopback_count", *shares)


def known_speakers(facts: DataFrame) -> DataFrame:
    """Speakers outside the domain count as Unknown."""
    known = F.when(F.col("speaker").isin(*SPEAKERS), F.col("speaker")).otherwise("Unknown")
    return facts.select(KEY, "turn_idx", "_block", known.alias("speaker"))


def language_breakdown(facts: DataFrame) -> DataFrame:
    """(transcript_id, declared_code_language_breakdown): blocks by declared language, in name order."""
    x = facts.select(KEY, F.explode("languages").alias("language")).groupBy(KEY, "language").agg(F.count("*").alias("n"))
    entries = F.sort_array(F.collect_list(F.struct("language", "n")))
    return x.groupBy(KEY).agg(F.map_from_entries(entries).alias("declared_code_language_breakdown"))


def workflow_findings(m: DataFrame) -> DataFrame:
    """Adds the six threshold findings."""
    #: The sentences and their thresholds.
    rules = [
        (
            F.col("security_risk_count") > 0,
            "Security risks detected in transcript code/content. Review security_findings for high-impact patterns.",
        ),
        (F.col("context_retention_score") < 25.0, "Low context retention between user prompts and AI responses suggests alignment drift."),
        (F.col("acceptance_rate") < 0.35, "Low suggestion acceptance indicates poor first-pass output quality or unclear prompts."),
        (
            F.col("prompt_specificity_score") < 45.0,
            "Prompt specificity is low; adding constraints and acceptance criteria should improve outcomes.",
        ),
        (F.col("phase_switch_rate") > 0.75, "High phase switching suggests context fragmentation and potential workflow thrashing."),
        (
            F.col("python_syntax_valid_ratio") < 0.7,
            "A significant portion of Python-targeted code snippets appears non-parseable; increase validation before acceptance.",
        ),
    ]
    return m.withColumn("workflow_findings", F.filter(F.array(*[F.when(c, F.lit(t)) for c, t in rules]), lambda x: x.isNotNull()))


# --- all ------------------------------------------------------------------------------------------

#: An added evaluator: (turn facts with content and blocks, phase labels, metrics so far) -> one row per transcript.
Evaluator = Callable[[DataFrame, DataFrame, DataFrame], DataFrame]


def pandas_evaluator(function: Callable[[pd.DataFrame], dict], schema: str) -> Evaluator:
    """An evaluator in Python: ``function`` gets one transcript's turns in order and returns its metrics.

    A transcript must fit into one task, so this is for measures that columns and parts cannot express.
    """

    def run(facts: DataFrame, labelled: DataFrame, metrics: DataFrame) -> DataFrame:
        def one(pdf: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame([{KEY: pdf[KEY].iloc[0], **function(pdf.sort_values("turn_idx"))}])

        return facts.drop("code").groupBy(KEY).applyInPandas(one, f"{KEY} long, {schema}")

    return run


def metrics_over(facts: DataFrame, phases: bool = True) -> DataFrame:
    """The default metrics of turn facts, one row per transcript."""
    labelled = label_phases(facts, phases)
    out = metrics_of(facts, *(make() for make in PARTS.values()))
    out = out.join(phase_dynamics(labelled), KEY, "left")
    out = out.join(_matrix(transitions(labelled, KEY, "turn_idx", "phase"), PHASES, "phase"), KEY, "left")
    out = out.join(_matrix(transitions(known_speakers(facts), KEY, "turn_idx", "speaker"), SPEAKERS, "speaker"), KEY, "left")
    out = out.join(language_breakdown(facts), KEY, "left")
    none = F.create_map().cast("map<string,bigint>")
    return workflow_findings(out.withColumn("declared_code_language_breakdown", F.coalesce("declared_code_language_breakdown", none)))


def kept_facts(turns: DataFrame, extra: bool = False) -> DataFrame:
    """The facts of each turn, written once to the shared checkpoint folder: a small part of the turns, read by several passes."""
    ensure_checkpoint_dir(turns.sparkSession)
    kept = FACTS + (["content", "blocks"] if extra else [])
    return delivered_once(turn_facts(turns).select(*kept), KEY, "turn_idx").checkpoint()


def compute_metrics(turns: DataFrame, phases: bool = True, extra: list[tuple[str, Evaluator]] | None = None, facts: DataFrame | None = None) -> DataFrame:
    """All metrics of normalised turns (with repeated deliveries or without), one row per transcript.

    ``extra`` evaluators run in order and may read the metrics before them; a metric name that exists
    already is an error.
    """
    facts = facts if facts is not None else kept_facts(turns, bool(extra))
    out = metrics_over(facts, phases)
    for name, evaluator in extra or []:
        part = evaluator(facts, label_phases(facts, phases), out)
        if twice := (set(out.columns) & set(part.columns)) - {KEY}:
            raise ValueError(f"{name} repeats metrics: {', '.join(sorted(twice))}")
        out = out.join(part, KEY, "left")
    return out
