"""Queries of the conversation operators over the driver's tables; the SQL that says the same is in ``conversation_sql``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from turnwise.operators import metrics as M
from turnwise.operators.codeintel import line_risks
from turnwise.operators.normalize import SPEAKERS, code_blocks, normal_content, normal_speaker, normalize_turns, redact
from turnwise.operators.phases import PHASES, label_phases, timeline
from turnwise.operators.report import edge_rows, graph_text, matrix_cells
from turnwise.operators.scoring import portfolio_summary, score, score_rows
from turnwise.operators.segment import segment_text
from turnwise.operators.sequence import delivered_once, next_row, with_position
from turnwise.plans.evaluate import evaluate
from turnwise.session import ensure_checkpoint_dir
from turnwise.sources.tables import table

KEY = "transcript_id"


def _turns(spark: SparkSession, base: str) -> DataFrame:
    """Normalised turns, without system and empty ones, as delivered."""
    return normalize_turns(table(spark, base, "turns"), once=False)


def _facts(spark: SparkSession, base: str, *reads: str) -> DataFrame:
    """The named facts of each turn, made in one scan; only they are shuffled."""
    facts = M.turn_facts(_turns(spark, base), list(reads)).select(KEY, "turn_idx", "_block", *reads)
    return delivered_once(facts, KEY, "turn_idx")


def _metrics(spark: SparkSession, base: str, *names: str) -> DataFrame:
    parts = [M.PARTS[n]() for n in names]
    return M.metrics_of(_facts(spark, base, *dict.fromkeys(r for p in parts for r in p.reads)), *parts)


def conversation_counts(spark, base):
    return _metrics(spark, base, "conversation")


def suggestion_outcomes(spark, base):
    return _metrics(spark, base, "suggestions")


def response_latency(spark, base):
    return _metrics(spark, base, "latency")


def context_retention(spark, base):
    return _metrics(spark, base, "retention")


def prompt_specificity(spark, base):
    return _metrics(spark, base, "specificity")


def mention_counts(spark, base):
    """Turns that speak of security, and of packages with a bad history."""
    return _metrics(spark, base, "mentions")


def secret_counts(spark, base):
    return _metrics(spark, base, "secrets")


def code_turns(spark, base):
    """Which turns count as code."""
    return _facts(spark, base, "speaker", "is_code").select(KEY, "turn_idx", "speaker", "is_code")


def turn_positions(spark, base):
    """The dense position of each turn that is left after the filters."""
    return with_position(_facts(spark, base), KEY, "turn_idx").select(KEY, "turn_idx", "pos")


def speaker_transitions(spark, base):
    return M.transitions(_facts(spark, base, "speaker"), KEY, "turn_idx", "speaker")


def speaker_transition_matrix(spark, base):
    known = M.known_speakers(_facts(spark, base, "speaker"))
    return M.dense_transitions(M.transitions(known, KEY, "turn_idx", "speaker"), known, KEY, SPEAKERS)


def phase_labels(spark, base):
    return label_phases(_facts(spark, base, "step")).select(KEY, "turn_idx", "phase")


def phase_timelines(spark, base):
    return timeline(phase_labels(spark, base))


def phase_distribution(spark, base):
    """Shares of the labelled phases."""
    x = M.phase_dynamics(label_phases(_facts(spark, base, "step")))
    return x.select(KEY, *[f"{p}_phase_percentage" for p in PHASES])


def phase_unpivot(spark, base):
    """The distribution in long form, one row per phase."""
    x = phase_distribution(spark, base)
    return x.unpivot([KEY], [F.col(f"{p}_phase_percentage").alias(p) for p in PHASES], "phase", "percentage")


def phase_switches(spark, base):
    """Switches, their rate and loopbacks of the labelled phases."""
    x = M.phase_dynamics(label_phases(_facts(spark, base, "step")))
    return x.select(KEY, "context_switch_count", "phase_switch_rate", "phase_loopback_count")


def phase_transition_matrix(spark, base):
    x = label_phases(_facts(spark, base, "step"))
    return M.dense_transitions(M.transitions(x, KEY, "turn_idx", "phase"), x, KEY, PHASES)


def redacted_turns(spark, base):
    """Content with the sensitive patterns replaced."""
    x = normalize_turns(table(spark, base, "turns"))
    return x.select(KEY, "turn_idx", redact(F.col("content")).alias("content"))


def extracted_blocks(spark, base):
    """Code blocks read from the content of each turn: the fenced ones, else the whole text where it looks like code."""
    x = table(spark, base, "turns").where("transcript_id IS NOT NULL AND turn_idx IS NOT NULL").dropDuplicates([KEY, "turn_idx"])
    x = x.select(KEY, "turn_idx", normal_content(F.col("content")).alias("content"))
    x = x.select(KEY, "turn_idx", F.posexplode(code_blocks(F.col("content"))).alias("block_no", "b"))
    return x.select(KEY, "turn_idx", F.col("block_no").cast("long").alias("block_no"), "b.code", "b.language")


def line_risk_counts(spark, base):
    """Risk patterns line by line over the code of all AI turns."""
    x = normalize_turns(table(spark, base, "turns")).where("speaker = 'AI'")
    x = x.select(KEY, F.explode("blocks.code").alias("code"))
    return x.groupBy(KEY).agg(*[F.sum(c).cast("long").alias(k) for k, c in line_risks(F.col("code")).items()])


def code_block_counts(spark, base):
    """The measures of AI code that need no syntax tree."""
    told = [
        "ai_code_block_count", "ai_code_line_count", "python_candidate_block_count", "non_python_code_block_count", "long_line_count",
        "comment_density",
    ]
    return _metrics(spark, base, "secrets", "code").select(KEY, *told)


def language_breakdown(spark, base):
    """Blocks by declared language, in long form."""
    x = M.language_breakdown(_facts(spark, base, "languages"))
    return x.select(KEY, F.explode("declared_code_language_breakdown").alias("language", "blocks"))


def event_transitions(spark, base):
    """Adjacent event types per user: the ordered-sequence operators on the event stream, in blocks of an hour."""
    hour = F.expr("unix_micros(CAST(ts AS TIMESTAMP)) div 3600000000")
    e = table(spark, base, "events").withColumn("_block", hour).withColumn("o", F.struct("ts", "event_id"))
    x = next_row(e.select("user_id", "o", "_block", "event_type"), "user_id", "o", F.col("event_type"), "dst").where("dst IS NOT NULL")
    return x.groupBy(F.col("event_type").alias("src"), "dst").agg(F.count("*").alias("weight"))


def segmented_documents(spark, base):
    """Document texts as plain-text transcripts: their turns, speakers normalised."""
    x = segment_text(table(spark, base, "documents").select("doc_id", "text"), "doc_id", "text")
    speaker = normal_speaker(F.col("speaker_raw")).alias("speaker")
    return x.select("doc_id", "turn_no", speaker, F.length("content").cast("long").alias("n_chars"), "content")


def code_quality(spark, base):
    return _metrics(spark, base, "secrets", "code")


def evaluations(spark, base):
    return evaluate(table(spark, base, "turns"))


def score_dimensions(spark, base):
    return score_rows(evaluations(spark, base))


def portfolio(spark, base):
    return portfolio_summary(evaluations(spark, base))


def _of_text(spark, base) -> DataFrame:
    """Scored metrics of the text alone: the evaluation of transcripts whose code is not looked into."""
    facts = M.turn_facts(_turns(spark, base), [f for f in M.FACTS if f != "code"]).withColumn("code", F.lit(None).cast(M.CODE_TYPE))
    ensure_checkpoint_dir(spark)
    return score(M.metrics_over(delivered_once(facts.select(*M.FACTS), KEY, "turn_idx").checkpoint()))


def text_scores(spark, base):
    """Scores and confidences of the text alone, in long form."""
    return score_rows(_of_text(spark, base)).select(KEY, "name", "score", "confidence", "value", "rationale")


def text_advice(spark, base):
    """Findings and recommendations of the text alone, one row each."""
    x = _of_text(spark, base)
    kinds = {"finding": "workflow_findings", "recommendation": "recommendations"}
    parts = [x.select(KEY, F.lit(k).alias("kind"), F.posexplode(c).alias("n", "sentence")) for k, c in kinds.items()]
    both = parts[0].unionByName(parts[1])
    return both.select(KEY, "kind", F.col("n").cast("long").alias("n"), "sentence")


def text_portfolio(spark, base):
    """The summary over all transcripts, of the text alone."""
    return portfolio_summary(_of_text(spark, base))


def phase_edges(spark, base):
    """Phase transitions of each transcript by falling weight, with their rank."""
    return edge_rows(_of_text(spark, base))


def phase_matrix_cells(spark, base):
    """The phase matrix of the evaluation, melted."""
    return matrix_cells(_of_text(spark, base))


def phase_graphs(spark, base):
    """The phase transitions as text for a graph renderer."""
    return graph_text(_of_text(spark, base))


QUERIES = {
    f.__name__: f
    for f in (
        conversation_counts, suggestion_outcomes, response_latency, context_retention, prompt_specificity, mention_counts, secret_counts,
        code_turns, turn_positions, speaker_transitions, speaker_transition_matrix, phase_labels, phase_timelines, phase_distribution,
        phase_unpivot, phase_switches, phase_transition_matrix, redacted_turns, extracted_blocks, line_risk_counts, code_block_counts,
        language_breakdown, event_transitions, segmented_documents, code_quality, evaluations, score_dimensions, portfolio, text_scores,
        text_advice, text_portfolio, phase_edges, phase_matrix_cells, phase_graphs,
    )
}
