"""Command line: evaluate transcript files and write a report."""

from __future__ import annotations

import argparse
import logging
import os
import sys

from turnwise.operators.report import with_errors, write_report
from turnwise.operators.scoring import weights_from_file
from turnwise.plans.evaluate import evaluate_fully
from turnwise.session import build_session
from turnwise.sources.files import collect_files, turns_of_files

LOG = logging.getLogger("turnwise")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("turnwise", description="Evaluate transcripts of work with coding assistants.")
    p.add_argument("inputs", nargs="+", help="files, folders or glob patterns")
    p.add_argument("-o", "--output", default="report.json")
    p.add_argument("--output-format", choices=["json", "csv", "md"], help="told by the suffix of the output if left out")
    p.add_argument("--strip-sensitive", action="store_true", help="redact secrets in the normalised content")
    p.add_argument("--keep-system-messages", action="store_true")
    p.add_argument("--disable-phase-detection", action="store_true")
    p.add_argument("--include-turns", action="store_true", help="put the normalised turns into a JSON report")
    p.add_argument("--no-timeline", action="store_true")
    p.add_argument("--score-config", help="a JSON file of score weights")
    p.add_argument("--log-level", default="INFO", choices=["DEBUG", "INFO", "WARNING", "ERROR"])
    return p


def main(argv: list[str] | None = None) -> int:
    """Exit 0: all evaluated; 1: bad inputs or weights; 2: some transcripts failed."""
    a = parser().parse_args(argv)
    logging.basicConfig(format="%(levelname)s: %(message)s")
    LOG.setLevel(a.log_level)
    try:
        paths = collect_files(a.inputs)
        weights = weights_from_file(a.score_config) if a.score_config else None
    except (OSError, ValueError) as e:
        LOG.error("%s", e)
        return 1
    spark = build_session(shuffle_partitions=4)
    rows = turns_of_files(spark, paths).persist()
    done = evaluate_fully(
        rows.where("error IS NULL"), a.strip_sensitive, a.keep_system_messages, not a.disable_phase_detection, weights,
        with_timeline=not a.no_timeline,
    )
    results = with_errors(done.results, rows).persist()
    try:
        summary = write_report(results, a.output, a.output_format, done.turns if a.include_turns else None)
    finally:
        results.unpersist()
        rows.unpersist()
    counts = summary["transcript_count"], summary["successful_evaluations"], summary["failed_evaluations"]
    LOG.info("Evaluated %s transcripts (%s succeeded, %s failed).", *counts)
    LOG.info("Average overall score: %s", summary["average_overall_score"])
    LOG.info("Report written to: %s", os.path.abspath(a.output))
    return 2 if counts[2] else 0


if __name__ == "__main__":
    sys.exit(main())
