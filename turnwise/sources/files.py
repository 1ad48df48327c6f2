"""Transcript files: discovery, format dispatch, turns and error rows."""

from __future__ import annotations

import glob
import logging
import os
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, functions as F

from turnwise.operators.segment import segment_text
from turnwise.operators.sequence import with_position
from turnwise.sources.messages import LINE_MESSAGES, MESSAGES, parse_batches, parse_line_batches

LOG = logging.getLogger("turnwise")

SUFFIXES = (".json", ".jsonl", ".ndjson", ".txt", ".log", ".md")
PASTE_MARK = "\n---TRANSCRIPT---\n"


def is_supported(path: str) -> bool:
    return path.lower().endswith(SUFFIXES)


def looks_like_glob(value: str) -> bool:
    return any(c in value for c in "*?[]")


def expand(value: str) -> list[str]:
    """The supported files a path, folder or pattern stands for."""
    if not looks_like_glob(value):
        if os.path.isfile(value):
            if not is_supported(value):
                LOG.warning("Skipping unsupported file: %s", value)
                return []
            return [value]
        if os.path.isdir(value):
            return [str(p) for p in Path(value).rglob("*") if p.is_file() and is_supported(p.name)]
    return [p for p in glob.glob(value, recursive=True) if os.path.isfile(p) and is_supported(p)]


def collect_files(inputs: list[str]) -> list[str]:
    """Files of all inputs, sorted by lower-case path, each resolved file once; none is an error."""
    seen: dict[str, str] = {}
    for p in sorted((p for i in inputs for p in expand(i)), key=str.lower):
        seen.setdefault(os.path.realpath(p), p)
    if not seen:
        raise FileNotFoundError("No transcript files found for the given inputs.")
    return list(seen.values())


def read_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(input_idx, path, text) of whole files, bytes that are no UTF-8 replaced."""
    listed = spark.createDataFrame([(i, p, "file:" + os.path.realpath(p)) for i, p in enumerate(paths)], "input_idx long, path string, uri string")
    read = spark.read.format("binaryFile").load([os.path.realpath(p) for p in paths]).select(F.regexp_replace("path", "^file:/+", "file:/").alias("uri"), F.expr("make_valid_utf8(CAST(content AS STRING))").alias("text"))
    return listed.join(read, "uri").select("input_idx", "path", "text")


def collect_listed(raw: str) -> list[str]:
    """Files of the paths, folders and patterns of a text, one a line; blank lines are left out."""
    return collect_files([line.strip() for line in raw.splitlines() if line.strip()])


def pasted_texts(spark: SparkSession, raw: str, kind: str = "text") -> DataFrame:
    """(input_idx, path, text) of pasted transcripts separated by the mark line; blank parts are dropped."""
    parts = [p.strip() for p in raw.split(PASTE_MARK) if p.strip()]
    ending = "json" if kind == "json" else "txt"
    return spark.createDataFrame([(i, f"pasted_{kind}_{i + 1}.{ending}", p) for i, p in enumerate(parts)], "input_idx long, path string, text string")


def uploaded_texts(spark: SparkSession, files: list[tuple[str, bytes]]) -> DataFrame:
    """(input_idx, path, text) of files held in memory as (name, bytes); bytes that are no UTF-8 are replaced."""
    rows = [(i, os.path.basename(name), data.decode("utf-8", "replace")) for i, (name, data) in enumerate(files) if is_supported(name)]
    for name, _ in files:
        if not is_supported(name):
            LOG.warning("Skipping unsupported file: %s", name)
    return spark.createDataFrame(rows, "input_idx long, path string, text string")


_TURN_COLUMNS = ["input_idx", "path", "turn_idx", "speaker", "content", "timestamp", "metadata", "error"]


def _turn_table(rows: DataFrame) -> DataFrame:
    return rows.select(
        F.col("input_idx").alias("transcript_id"), "turn_idx", "speaker", "content", "timestamp",
        F.lit(None).cast("array<struct<code:string,language:string>>").alias("code_blocks"), F.lit("discussion").alias("phase"), "metadata",
        "path", "error",
    )


def turns_of_lines(spark: SparkSession, paths: list[str], numbers: list[int] | None = None) -> DataFrame:
    """Turn table of JSON Lines files, read line by line: a large file is split over tasks, and so are its turns.

    Lines are numbered within the splits of a file, turns over the whole file by their dense position.  A
    file with an unreadable line is one error row, which names the line within its split.
    """
    listed = spark.createDataFrame(
        [(i, p, "file:" + os.path.realpath(p)) for i, p in zip(numbers or range(len(paths)), paths)], "input_idx long, path string, uri string"
    )
    read = spark.read.text([os.path.realpath(p) for p in paths]).select(
        F.regexp_replace("_metadata.file_path", "^file:/+", "file:/").alias("uri"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("n"), F.expr("make_valid_utf8(CAST(value AS STRING))").alias("line"),
    )
    lines = read.groupBy("uri", "block").agg(F.min("n").alias("first"))
    lines = read.join(lines, ["uri", "block"]).join(listed, "uri")
    lines = lines.select("input_idx", "path", "block", (F.col("n") - F.col("first") + 1).alias("line_no"), "line")
    rows = lines.mapInPandas(parse_line_batches, LINE_MESSAGES)
    bad = rows.where("error IS NOT NULL").groupBy("input_idx").agg(F.min_by("error", F.struct("block", "line_no")).alias("error"))
    bad = bad.join(listed.select("input_idx", "path"), "input_idx")
    good = rows.where("error IS NULL").join(bad.select("input_idx"), "input_idx", "left_anti").drop("error")
    good = with_position(good.withColumn("_o", F.struct("block", "line_no", "turn_idx")).withColumnRenamed("block", "_block"), "input_idx", "_o")
    good = good.withColumn("turn_idx", F.col("pos").cast("long")).withColumn("error", F.lit(None).cast("string")).select(*_TURN_COLUMNS)
    return _turn_table(good.unionByName(bad, allowMissingColumns=True))


def turns_of_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Turn table of files of all formats; JSON Lines are split over tasks, other files are read whole."""
    by_line = [(i, p) for i, p in enumerate(paths) if p.lower().endswith((".jsonl", ".ndjson"))]
    whole = [(i, p) for i, p in enumerate(paths) if (i, p) not in set(by_line)]
    parts = [turns_of_lines(spark, [p for _, p in by_line], [i for i, _ in by_line])] if by_line else []
    if whole:
        texts = read_files(spark, [p for _, p in whole])
        number = spark.createDataFrame(list(enumerate(i for i, _ in whole)), "input_idx long, number long")
        parts.append(turns_of_texts(texts.join(number, "input_idx").select(F.col("number").alias("input_idx"), "path", "text")))
    found = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    listed = spark.createDataFrame(list(enumerate(paths)), "transcript_id long, path string")
    none = listed.join(found.select("transcript_id").distinct(), "transcript_id", "left_anti").withColumn("error", no_turns())
    return found.unionByName(none, allowMissingColumns=True)


def no_turns():
    return F.concat(F.lit("Transcript '"), F.regexp_extract("path", "[^/]+$", 0), F.lit("' did not contain parseable turns."))


def turns_of_texts(texts: DataFrame) -> DataFrame:
    """Turn table of (input_idx, path, text): transcript_id, turn_idx, speaker, content, timestamp, code_blocks, phase, metadata, path, error.

    The suffix decides the format. A file that cannot be read, or has no turns, is one row with its
    error and a null turn_idx.
    """
    low = F.lower("path")
    json_like = low.rlike(r"\.(json|jsonl|ndjson)$")
    parsed = texts.where(json_like).select("input_idx", "path", "text", (~low.endswith(".json")).alias("lines_only")).mapInPandas(parse_batches, MESSAGES)
    plain = texts.where(~json_like)
    cut = segment_text(plain, "input_idx", "text").join(plain.select("input_idx", "path"), "input_idx")
    none = F.lit(None).cast("string")
    cut = cut.withColumnsRenamed({"turn_no": "turn_idx", "speaker_raw": "speaker"}).withColumns({"metadata": none, "error": none})
    rows = parsed.select(*_TURN_COLUMNS).unionByName(cut.select(*_TURN_COLUMNS))
    empty = texts.join(rows.select("input_idx").distinct(), "input_idx", "left_anti").select("input_idx", "path", no_turns().alias("error"))
    return _turn_table(rows.unionByName(empty, allowMissingColumns=True))
