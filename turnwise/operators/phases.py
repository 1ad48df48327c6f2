"""Workflow phase of each turn: term similarity and a fold that carries the previous phase.

The label of a turn depends on the label before it, so each turn is a function from the previous to
the new phase.  There are six phases, each with a letter, so the function is a word of six letters (the
new phase for each previous one), and two functions are composed by ``translate``.  Functions are
composed within blocks of turns, blocks within long stretches, stretches within a transcript; then the
states run back down.  No task holds more than one block of turns, or the words of 512 blocks.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame, functions as F

from turnwise.functions.text import TOKEN

PHASES = ["planning", "implementation", "debugging", "testing", "review", "discussion"]
CATEGORIES = PHASES[:5]
#: The phrases of each category.
PHRASES = {
    "planning": [
        "plan", "architecture", "design", "approach", "strategy", "requirements", "outline", "concept", "spec", "blueprint",
    ],
    "implementation": [
        "implement", "write code", "function", "class", "refactor", "build", "code", "module", "script", "api", "logic", "develop",
    ],
    "debugging": [
        "error", "bug", "fix", "traceback", "fails", "not working", "issue", "exception", "stack", "crash", "resolve", "patch",
    ],
    "testing": [
        "test", "unit test", "integration", "assert", "coverage", "pytest", "verify", "mock", "validate", "fixture",
    ],
    "review": [
        "review", "security", "audit", "improve", "optimize", "cleanup", "harden", "performance", "analyze", "evaluate",
    ],
}
#: The suffixes taken off, the first that fits; the stay bonus and the least score.
SUFFIXES = ["ing", "ed", "es", "s", "ion"]
STAY, LEAST = 0.1, 0.05
RANKS = {"discussion": 0, "planning": 1, "implementation": 2, "debugging": 3, "testing": 4, "review": 5}
LETTERS = {"planning": "P", "implementation": "I", "debugging": "D", "testing": "T", "review": "R", "discussion": "U"}
#: The letters in phase order, which is also the word of the function that changes nothing.
SAME = "".join(LETTERS[p] for p in PHASES)
#: Blocks in one stretch of a transcript.
STRETCH = 512


def stem(word: str) -> str:
    for s in SUFFIXES:
        if word.endswith(s) and len(word) > len(s) + 2:
            return word[: -len(s)]
    return word


def category_counts() -> dict[str, Counter]:
    """How often each stem stands in the phrases of a category.

    No stem is in two categories, so inverse frequencies are equal and cancel out of the cosine.
    """
    return {c: Counter(stem(w) for p in PHRASES[c] for w in re.findall(r"\w+", p)) for c in CATEGORIES}


def _in(words: list[str]) -> str:
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


def _cosines(known: str) -> str:
    """SQL of the cosine of an array of category stems to each category, in category order.

    Only category stems have a weight on either side, so the cosine is a ratio of whole numbers and the
    lengths of both vectors.
    """
    cells = []
    for c, counts in category_counts().items():
        part = []
        for times in sorted(set(counts.values())):
            of = [w for w, n in counts.items() if n == times]
            part.append(f"{float(times)}D * size(filter({known}, s -> s IN {_in(of)}))")
        cells.append(f"({' + '.join(part)}) / (len * {math.sqrt(sum(n * n for n in counts.values()))!r}D)")
    length = f"sqrt(aggregate(array_distinct({known}), 0D, (n, s) -> n + power(size(filter({known}, x -> x = s)), 2)))"
    zeros = ", ".join(["0D"] * len(CATEGORIES))
    return f"if(size({known}) = 0, array({zeros}), transform(array({length}), len -> array({', '.join(cells)}))[0])"


def _word(sims: str, default: str) -> str:
    """SQL of the six letters for an array of similarities: the previous category stays if its score with the bonus is the first best."""
    other = f"if(array_max({sims}) > {LEAST}D, substring('{SAME}', CAST(array_position({sims}, array_max({sims})) AS INT), 1), {default})"
    cells = []
    for i, c in enumerate(CATEGORIES):
        bonus = f"({sims}[{i}] + {STAY}D)"
        stays = " AND ".join(f"{bonus} {'>' if j < i else '>='} {sims}[{j}]" for j in range(len(CATEGORIES)) if j != i)
        cells.append(f"if({stays} AND {bonus} > {LEAST}D, '{LETTERS[c]}', {other})")
    return f"concat({', '.join(cells)}, {other})"


def step(speaker: str, has_code: str, text: str) -> Column:
    """The six-letter function of a turn, of SQL expressions: its phase after each phase, in phase order.

    Code of the AI or a tool is implementation and a blank text discussion, whatever came before.  Else
    the most similar category counts, the previous one with a bonus, if its score exceeds the least.
    """
    default = f"if({speaker} = 'Tool', '{LETTERS['implementation']}', '{LETTERS['discussion']}')"
    endings = "|".join(SUFFIXES)
    # A suffix goes if three characters stay; the shortest rest takes the longest suffix, as the order above does.
    stems = f"""transform(regexp_extract_all(lower({text}), r"({TOKEN})", 1), w -> regexp_replace(w, '^(.{{3,}}?)(?:{endings})$', '$1'))"""
    every = [w for counts in category_counts().values() for w in counts]
    said = f"transform(array({_cosines('k')}), v -> {_word('v', default)})[0]"
    said = f"transform(array(filter(words, s -> s IN {_in(every)})), k -> {said})[0]"
    said = f"transform(array({stems}), words -> if(size(words) = 0, repeat({default}, {len(PHASES)}), {said}))[0]"
    n = len(PHASES)
    return F.expr(
        f"""CASE WHEN {speaker} IN ('AI', 'Tool') AND {has_code} THEN '{LETTERS["implementation"] * n}'
        WHEN {text} = '' THEN '{LETTERS["discussion"] * n}' ELSE {said} END"""
    )


def _after(first: Column, second: Column) -> Column:
    """The function that does ``first`` and then ``second``; ``first`` may also be a single state."""
    return F.call_function("translate", first, F.lit(SAME), second)


def _running(functions: Column, start: Column) -> Column:
    """For an array of functions the state (or function) before each of them, and after the last."""
    zero = F.struct(start.alias("s"), F.array().cast("array<string>").alias("before"))
    return F.aggregate(functions, zero, lambda acc, f: F.struct(_after(acc["s"], f).alias("s"), F.array_append(acc["before"], acc["s"]).alias("before")))


def label_phases(turns: DataFrame, enabled: bool = True) -> DataFrame:
    """(transcript_id, turn_idx, _block, phase) of facts with a ``step``; all ``discussion`` where disabled."""
    if not enabled:
        return turns.select("transcript_id", "turn_idx", "_block", F.lit("discussion").alias("phase"))
    key = "transcript_id"
    item = F.struct("turn_idx", "step")
    blocks = turns.groupBy(key, "_block").agg(F.sort_array(F.collect_list(item)).alias("turns"))
    whole = F.aggregate("turns.step", F.lit(SAME), _after)
    ends = blocks.select(key, "_block", F.expr(f"floor(_block / {STRETCH})").alias("_stretch"), whole.alias("f"))
    ends = ends.groupBy(key, "_stretch").agg(F.sort_array(F.collect_list(F.struct("_block", "f"))).alias("bs"))
    ends = ends.withColumn("r", _running(F.col("bs.f"), F.lit(SAME)))
    # One word per stretch of 262,144 turns is run over a transcript.
    chain = ends.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("_stretch", F.col("r.s").alias("f")))).alias("ss"))
    chain = chain.withColumn("before", _running(F.col("ss.f"), F.lit(LETTERS["discussion"])).getField("before"))
    starts = chain.select(key, F.explode(F.arrays_zip(F.col("ss._stretch").alias("n"), F.col("before").alias("s"))).alias("z"))
    starts = starts.select(key, F.col("z.n").alias("_stretch"), F.col("z.s").alias("state"))
    per_block = ends.select(key, "_stretch", F.explode(F.arrays_zip(F.col("bs._block").alias("n"), F.col("r.before").alias("f"))).alias("z"))
    per_block = per_block.join(starts, [key, "_stretch"], "left")
    per_block = per_block.select(key, F.col("z.n").alias("_block"), _after(F.col("state"), F.col("z.f")).alias("state"))
    labelled = blocks.join(per_block, [key, "_block"], "left")
    # Shifted by one: the state after each turn is its phase.
    run = _running(F.col("turns.step"), F.col("state"))
    labelled = labelled.select(key, "_block", "turns", run.alias("r"))
    letters = F.array_append(F.slice("r.before", F.lit(2), F.greatest(F.size("r.before") - 1, F.lit(0))), F.col("r.s"))
    rows = labelled.select(key, "_block", F.explode(F.arrays_zip(F.col("turns.turn_idx").alias("turn_idx"), letters.alias("l"))).alias("z"))
    return rows.select(key, F.col("z.turn_idx").alias("turn_idx"), "_block", phase_of(F.col("z.l")).alias("phase"))


def phase_of(letter: Column) -> Column:
    out = F.lit(None).cast("string")
    for p in PHASES:
        out = F.when(letter == LETTERS[p], p).otherwise(out)
    return out


def timeline(labelled: DataFrame) -> DataFrame:
    """(transcript_id, timeline): the phase letters in order, separated by blanks.

    Letters are joined within blocks of turn numbers; one string per block is joined over a transcript.
    """
    letters = F.create_map(*[F.lit(x) for pair in LETTERS.items() for x in pair])
    item = F.struct("turn_idx", F.coalesce(F.try_element_at(letters, F.col("phase")), F.lit("U")).alias("l"))
    block = F.floor(F.col("turn_idx") / 512).alias("block")
    parts = labelled.groupBy("transcript_id", block).agg(F.sort_array(F.collect_list(item)).alias("ls"))
    parts = parts.select("transcript_id", F.struct("block", F.array_join("ls.l", " ").alias("l")).alias("part"))
    whole = parts.groupBy("transcript_id").agg(F.sort_array(F.collect_list("part")).alias("ps"))
    return whole.select("transcript_id", F.array_join("ps.l", " ").alias("timeline"))
