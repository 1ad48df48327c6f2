import csv
import json

import pytest

from turnwise.cli import main
from turnwise.operators.report import csv_columns, infer_format, metric_names, phase_rows, with_errors, write_report, write_results
from turnwise.operators.scoring import ranked_scores
from turnwise.operators.segment import segment_text
from turnwise.plans.evaluate import evaluate_fully
from turnwise.sources.files import collect_files, pasted_texts, read_files, turns_of_files, turns_of_texts, uploaded_texts
from turnwise.sources.messages import BadTranscript, read_json, read_lines
from turnwise.streaming.live import touched_transcripts


def test_json_shapes():
    rows = read_json(json.dumps({"messages": [{"role": "user", "content": [{"text": "First line"}, {"content": [{"text": "Nested line"}]}], "time": 5}]}))
    assert rows[0]["content"] == "First line\nNested line" and rows[0]["timestamp"] == "5"
    assert [r["speaker"] for r in read_json('[[{"role": "a", "text": "x"}], {"k": {"speaker": "b", "content": "y"}}]')] == ["a", "b"]
    for bad in ('{"messages": [{"foo": "bar"}]}', '{"messages": [{"role": 123, "content": "x"}]}', "3", "{"):
        with pytest.raises(ValueError):
            read_json(bad)
    with pytest.raises(BadTranscript, match="line 2"):
        read_lines('{"role": "user", "content": "x"}\n{oops}\n')


def test_files_to_turns(spark, tmp_path):
    (tmp_path / "a.txt").write_text("[10:00] User: hi\nmore\nAI: ok")
    (tmp_path / "b.JSON").write_text('{"messages": [{"role": "user", "content": "x"}]}')
    (tmp_path / "c.jsonl").write_text('{"role": "user", "content": "x"}\nnope')
    (tmp_path / "d.md").write_text("  ")
    (tmp_path / "e.bin").write_text("User: no")
    paths = collect_files([str(tmp_path), str(tmp_path / "a.txt")])
    assert [p[-5:] for p in paths] == ["a.txt", ".JSON", "jsonl", "/d.md"]
    rows = turns_of_texts(read_files(spark, paths)).orderBy("transcript_id", "turn_idx").collect()
    assert [(r.transcript_id, r.turn_idx, r.content) for r in rows if r.error is None] == [(0, 0, "hi\nmore"), (0, 1, "ok"), (1, 0, "x")]
    assert {r.transcript_id: r.error for r in rows if r.error}.keys() == {2, 3}
    with pytest.raises(FileNotFoundError):
        collect_files([str(tmp_path / "none*")])


def test_segmentation(spark):
    df = spark.createDataFrame([(1, "lost\nUser: a\nb"), (2, "no speaker here"), (3, None), (4, " "), (5, "AI - x\r\ny")], "k long, t string")
    got = sorted((r.k, r.turn_no, r.speaker_raw, r.content) for r in segment_text(df, "k", "t").collect())
    assert got == [(1, 0, "User", "a\nb"), (2, 0, "Unknown", "no speaker here"), (5, 0, "AI", "x\ny")]
    assert pasted_texts(spark, "a: b\n---TRANSCRIPT---\n \n---TRANSCRIPT---\nc: d").count() == 2


def test_messages_are_looked_for_further():
    """A container that leads to no message does not end the search; a null speaker speaks as None."""
    for text in ('{"data": {"x": 1}, "role": "user", "content": "hi"}', '{"messages": [1], "chat": [{"role": "user", "content": "hi"}]}', '{"items": 5, "role": "user", "content": "hi"}'):
        assert [(r["speaker"], r["content"]) for r in read_json(text)] == [("user", "hi")]
    assert read_json('[{"speaker": null, "content": [{"content": ["  x "]}, "", 7]}]')[0] == {"speaker": "None", "content": "x", "timestamp": None, "metadata": '{"index": 0}'}


def test_lines_are_split_over_tasks(spark, tmp_path):
    lines = [json.dumps({"role": "user", "content": f"{i} " + "x" * 50}) if i % 7 else "" for i in range(3000)]
    (tmp_path / "a.jsonl").write_text("\n".join(lines))
    (tmp_path / "b.ndjson").write_text("\n".join([*lines[:50], "{oops"]))
    (tmp_path / "c.txt").write_text("User: hi")
    paths = [str(tmp_path / n) for n in ("a.jsonl", "b.ndjson", "c.txt")]
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        df = turns_of_files(spark, paths)
        rows = df.orderBy("transcript_id", "turn_idx").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    own = [r for r in rows if r.transcript_id == 0]
    assert [int(r.content.split()[0]) for r in own] == [i for i in range(3000) if i % 7] and [r.turn_idx for r in own] == list(range(len(own)))
    assert [(r.transcript_id, r.error is None) for r in rows if r.transcript_id] == [(1, False), (2, True)]


def test_texts_in_memory(spark):
    up = uploaded_texts(spark, [("d/a.txt", b"User: h\xffi"), ("b.bin", b"x"), ("c.json", b'{"role": "user", "text": "y"}')])
    rows = turns_of_texts(up).orderBy("transcript_id").collect()
    assert [(r.transcript_id, r.path, r.content) for r in rows] == [(0, "a.txt", "h\ufffdi"), (2, "c.json", "y")]


@pytest.fixture(scope="module")
def reports(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("in")
    (folder / "a.txt").write_text("User: Plan the parser.\nAI: ```python\ndef f():\n    return 1\n```\nUser: Thanks, great.")
    (folder / "b.json").write_text("{}")
    (folder / "c.jsonl").write_text('{"role": "user", "content": "x", "time": 5}\n{"role": "ai", "content": "Bearer abcdef"}\n')
    out = tmp_path_factory.mktemp("out")
    code = main([str(folder), "-o", str(out / "r.json"), "--include-turns", "--log-level", "ERROR"])
    assert code == 2 and main([str(folder / "none*")]) == 1
    rows = turns_of_files(spark, collect_files([str(folder)])).persist()
    done = evaluate_fully(rows.where("error IS NULL"))
    results = with_errors(done.results, rows).persist()
    return out, results


def test_json_report(reports):
    r = json.loads((reports[0] / "r.json").read_text())
    assert {k: r["summary"][k] for k in ("transcript_count", "successful_evaluations", "failed_evaluations")} == {"transcript_count": 3, "successful_evaluations": 2, "failed_evaluations": 1}
    assert r["summary"]["best_transcript"] in ("a.txt", "c.jsonl") and r["summary"]["average_overall_score"] > 0
    a, b, c = r["results"]
    assert [x["transcript"] for x in (a, b, c)] == ["a.txt", "b.json", "c.jsonl"] and b["errors"] and b["metrics"] == {} and b["normalized_turns"] == []
    assert a["phase_timeline"] == "P I I" and len(a["normalized_turns"]) == 3 and a["normalized_turns"][1]["code_blocks"] == ["def f():\n    return 1"]
    assert a["normalized_turns"][1]["code_block_languages"] == ["python"] and c["normalized_turns"][0]["timestamp"] == "5"
    assert a["scores"]["turn_balance"]["value"] == 0.5 and a["scores"]["turn_balance"]["rationale"].startswith("Closer to")
    assert a["scores"]["phase_stability"]["value"] == {"phase_switch_rate": 0.5, "phase_loopback_count": 0}
    assert set(a["analysis_artifacts"]) == {"phase_transition_edges", "speaker_transition_edges", "workflow_findings", "security_findings"}
    assert c["metrics"]["secret_exposure_count"] == 1


def test_csv_and_markdown_reports(reports, spark):
    out, results = reports
    write_report(results, str(out / "x/r.csv"))
    with open(out / "x/r.csv", encoding="utf-8", newline="") as f:
        rows = list(csv.DictReader(f))
    names = list(rows[0])
    assert names[:5] == ["transcript", "overall_score", "overall_confidence", "recommendations", "errors"] and names[5:] == sorted(names[5:])
    at = names.index
    assert at("score_code_quality") < at("score_confidence_code_quality") < at("score_context_retention")
    assert rows[0]["metric_workflow_findings"].startswith("[") and rows[1]["metric_total_turns"] == "" and rows[1]["errors"]
    summary = write_report(results, str(out / "r.md"))
    text = (out / "r.md").read_text()
    assert "- Successful evaluations: 2" in text and "| Transcript | Score | Confidence | Turns | Tokens | Acceptance | Context Retention | Security Risks |" in text
    assert "Errors for b.json:" in text and f"- Average overall score: {summary['average_overall_score']}" in text
    assert infer_format("a.MD") == "md" and infer_format("a") == "json"
    with pytest.raises(ValueError):
        write_report(results, str(out / "r"), "xml")
    for fmt in ("csv", "json", "parquet"):
        write_results(results, str(out / fmt), fmt)
    assert spark.read.option("header", True).csv(str(out / "csv")).columns == csv_columns(metric_names(results))
    assert spark.read.parquet(str(out / "parquet")).count() == spark.read.json(str(out / "json")).count() == 3
    assert phase_rows(results).count() == 18 and ranked_scores(results.where("total_turns > 0")).where("rank = 1").count() == 2


def test_touched_transcripts(make_turns):
    seen = []
    every = make_turns([(1, 0, "User", "x"), (1, 1, "AI", "y"), (2, 0, "User", "z")])
    touched_transcripts(lambda: every, lambda df, epoch: seen.append((df.count(), epoch)))(make_turns([(1, 1, "AI", "y"), (None, 0, "User", "q")]), 7)
    assert seen == [(2, 7)]
