import random
import re

from pyspark.sql import functions as F

from turnwise.functions.text import half_even, tokens
from turnwise.operators import metrics as M
from turnwise.operators.normalize import normal_content, normal_speaker, normalize_turns, redact
from turnwise.operators.phases import CATEGORIES, SUFFIXES, category_counts, label_phases
from turnwise.operators.scoring import resolve_weights, score
from turnwise.operators.sequence import delivered_once, look_ahead, next_matching, with_block, with_position

import pytest

FENCE = "```python\ndef parse(text):\n    return text\n```"
DEMO = [
    (1, 0, "User", "Plan the parser design first."),
    (1, 1, "AI", "Here is a plan for the design."),
    (1, 2, "User", "Good, now implement it."),
    (1, 3, "AI", FENCE),
    (1, 4, "User", "No, that is wrong. Fix the error."),
    (1, 5, "AI", "Fixed."),
    (1, 6, "User", "Thanks"),
]


def test_text_functions(spark):
    texts = ["don't re-use x_y", "naïve — Ünïcode's", "", "a-b- -c", "it's 'quoted'"]
    got = [r.t for r in spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, x string").select("i", tokens(F.col("x")).alias("t")).orderBy("i").collect()]
    assert got == [re.findall(r"\b[\w'-]+\b", x) for x in texts]
    values = [random.Random(3).random() * 100 for _ in range(300)]
    got = [r.y for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double").orderBy("i").select(half_even(F.col("v"), 2).alias("y")).collect()]
    assert got == [round(v, 2) for v in values]


def test_normal_forms(spark):
    df = spark.createDataFrame([(" HUMAN ", "a “b” \r\nc  \n"), (None, None), ("code-bot x", "mail a.b@c.org ghp_" + "a" * 24)], "s string, c string")
    rows = df.select(normal_speaker(F.col("s")).alias("s"), normal_content(F.col("c")).alias("c"), redact(F.col("c"), "$1").alias("r")).collect()
    assert [r.s for r in rows] == ["User", "Unknown", "Code-Bot X"]
    assert rows[0].c == 'a "b"\nc' and rows[1].c == "" and rows[2].r == "mail $1 $1"


def test_demo(spark, make_turns):
    m = M.compute_metrics(normalize_turns(make_turns(DEMO + DEMO[:2] + [(1, 7, "System", "x"), (1, 8, "Tool", None), (None, 1, "User", "lost")])))
    r = score(m).first().asDict(recursive=True)
    assert (r["total_turns"], r["user_turns"], r["ai_turns"], r["tool_turns"]) == (7, 4, 3, 0)
    assert (r["accepted_suggestion_count"], r["rejected_suggestion_count"], r["unresolved_suggestion_count"]) == (2, 1, 0)
    assert r["avg_response_latency_turns"] == 1.0 and r["ai_code_block_count"] == 1 and r["function_count"] == 1 and r["python_syntax_valid_ratio"] == 1.0
    assert sum(sum(v.values()) for v in r["phase_transition_matrix"].values()) == 6 == sum(e["weight"] for e in r["speaker_transition_edges"])
    assert abs(sum(v for k, v in r.items() if k.endswith("_phase_percentage")) - 100) < 0.1
    assert 0 <= r["overall_score"] <= 100 and r["recommendations"]


def test_weights():
    w = resolve_weights({"turn_balance": 1.0, **{k: 0.0 for k in resolve_weights() if k != "turn_balance"}})
    assert w["turn_balance"] == 1.0
    with pytest.raises(ValueError):
        resolve_weights({"nope": 1})
    with pytest.raises(ValueError):
        resolve_weights({k: -1 for k in resolve_weights()})


def test_extra_evaluators_must_not_repeat_names(make_turns):
    t = normalize_turns(make_turns(DEMO))
    twice = ("twice", lambda f, p, m: f.groupBy("transcript_id").agg(F.count("*").alias("total_turns")))
    with pytest.raises(ValueError):
        M.compute_metrics(t, extra=[twice])
    share = ("share", lambda f, p, m: m.select("transcript_id", (F.col("ai_turns") / F.col("total_turns")).alias("ai_share")))
    python = ("last", M.pandas_evaluator(lambda pdf: {"last_words": str(pdf["content"].iloc[-1])}, "last_words string"))
    r = M.compute_metrics(t, extra=[share, python]).first()
    assert r.ai_share == 3 / 7 and r.last_words == "Thanks"


def test_forward_asof_and_position_over_blocks(spark):
    rnd = random.Random(1)
    rows = [(g, i * 3, rnd.random() < 0.1) for g in range(3) for i in range(400)]
    df = with_block(spark.createDataFrame(rows, "g int, o long, hit boolean"), "o", 50)
    got = {(r.g, r.o): r.nxt for r in next_matching(df, "g", "o", F.col("hit"), F.col("o"), "nxt").collect()}
    for g in range(3):
        own = [r for r in rows if r[0] == g]
        for n, r in enumerate(own):
            assert got[g, r[1]] == next((x[1] for x in own[n + 1 :] if x[2]), None)
    pos = {(r.g, r.o): r.pos for r in with_position(df, "g", "o").collect()}
    assert all(pos[g, i * 3] == i for g in range(3) for i in range(400))


def test_phase_fold_equals_a_loop(spark, make_turns):
    rnd = random.Random(2)
    words = "plan design code fix error tests review the a unit writing audits hello ok bugs".split()
    rows = [(t, i, rnd.choice(["User", "AI", "Tool"]), " ".join(rnd.choice(words) for _ in range(rnd.randint(1, 4))) if rnd.random() < 0.9 else FENCE) for t in range(3) for i in range(0, 1100 if t == 0 else 30)]
    facts = M.turn_facts(normalize_turns(make_turns(rows)), ["step"])
    got = {(r.transcript_id, r.turn_idx): r.phase for r in label_phases(facts).collect()}
    counts = category_counts()
    length = {c: sum(n * n for n in counts[c].values()) ** 0.5 for c in CATEGORIES}

    def cut(w):
        return next((w[: -len(s)] for s in SUFFIXES if w.endswith(s) and len(w) > len(s) + 2), w)

    for t in range(3):
        previous = "discussion"
        for _, i, speaker, text in [r for r in rows if r[0] == t]:
            known = [w for w in map(cut, re.findall(r"[\w'-]+", text.lower())) if any(w in v for v in counts.values())]
            norm = sum(known.count(w) ** 2 for w in set(known)) ** 0.5
            scores = {c: sum(counts[c][w] for w in known) / norm / length[c] if norm else 0.0 for c in CATEGORIES}
            if previous in scores:
                scores[previous] += 0.1
            best = max(scores, key=scores.get)
            if text == FENCE and speaker != "User":
                previous = "implementation"
            else:
                previous = best if scores[best] > 0.05 else "implementation" if speaker == "Tool" else "discussion"
            assert got[t, i] == previous, (t, i, text)


def test_timeline_is_joined_by_blocks(spark):
    from turnwise.operators.phases import LETTERS, timeline

    phases = sorted(LETTERS)
    rows = [(t, i, phases[(i * 7 + t) % len(phases)]) for t in (1, 2) for i in range(-3, 1200)]
    out = timeline(spark.createDataFrame(rows[::-1], "transcript_id long, turn_idx long, phase string"))
    assert {r.transcript_id: r.timeline for r in out.collect()} == {t: " ".join(LETTERS[p] for u, _, p in rows if u == t) for t in (1, 2)}
    assert "block" in out._jdf.queryExecution().optimizedPlan().toString()


def test_look_ahead_from_the_end(spark):
    rnd = random.Random(4)
    rows = [(g, i, rnd.random() < 0.2) for g in range(3) for i in range(500) if rnd.random() < 0.8]
    df = with_block(spark.createDataFrame(rows + rows[:50], "g int, o long, hit boolean"), "o", 64)
    df = look_ahead(delivered_once(df, "g", "o"), "g", "o", {"far": (F.col("hit"), None), "nxt": (F.lit(True), F.col("o"))}, "left")
    got = {(r.g, r.o): (r.far, r.nxt, r.left) for r in df.collect()}
    assert len(got) == len(rows) == df.count()
    for g in range(3):
        own = [r for r in rows if r[0] == g]
        for n, r in enumerate(own):
            far = next((len(own) - m for m in range(n + 1, len(own)) if own[m][2]), None)
            assert got[g, r[1]] == (far, own[n + 1][1] if n + 1 < len(own) else None, len(own) - n)


def test_secrets_over_turns_and_densities(make_turns):
    """A bearer mark takes its token from the next turn; tries are counted over blocks that parse."""
    code = [{"code": "try:\n    x = 1\nexcept ValueError:\n    pass", "language": "python"}, {"code": "def (:", "language": "python"}]
    t = make_turns(
        [(1, 0, "User", "it is Bearer"), (1, 1, "AI", "", {"code_blocks": code}), (1, 2, "User", "abcdef123 works"), (2, 0, "User", "Bearer"), (2, 1, "AI", "Bearer abc"), (3, 0, "AI", "Bearer"), (3, 1, "User", "?")]
    )
    m = {r.transcript_id: r for r in M.compute_metrics(normalize_turns(t)).collect()}
    want = {1: "it is Bearer\n\nabcdef123 works", 2: "Bearer\nBearer abc", 3: "Bearer\n?"}
    for k, text in want.items():
        assert m[k].secret_exposure_count == len(re.findall(r"(?i)\bBearer\s+[A-Za-z0-9\-._~+/]+=*\b", text)), k
    assert m[1].exception_handling_density == 1.0 and m[1].python_candidate_block_count == 2 and m[1].parseable_python_block_count == 1


def test_code_analysis():
    from turnwise.operators.codeintel import measure

    m = measure("import yaml, hashlib\ndef f(a: int) -> int:\n    'doc'\n    eval('1')\n    yaml.safe_load(x)\n    return hashlib.md5(b'')\nself.api_key = 'x'\nrequests.get(u, verify=False)\nsubprocess.run(c, shell=True)")
    assert {k: v for k, v in m.items() if v} == {
        "dynamic_code_execution": 1, "unsafe_deserialization": 1, "weak_hashing": 1, "plaintext_secret_assignment": 1, "tls_verification_disabled": 1,
        "dangerous_subprocess": 1, "n_parsed": 1, "complexity": 1, "functions": 1, "lines": 5, "typed": 1, "documented": 1,
    }
    assert measure("def (:") is None and measure(None)["n_parsed"] == 1
