import random

from turnwise.llm.pairs import defect, find_defects, lcs_length, prompt_response_pairs


def test_defects():
    q = "Why does `load()` raise an error when the list is empty?"
    assert [defect(q, a) for a in (None, "  ​", "-", "...", "```\n\n```")] == ["empty"] * 5
    assert [defect(q, a) for a in ("Yes.", "`O(n log n)`", "[code block]", "- a b\n- c d e f", "```py\nx = 1\n```", "It fails early.\n\n> " + q)] == [None] * 6
    assert [defect(q, a) for a in ("The list is read before it", "It is,", "Here:\n```py\nx = (", "The loader ends …")] == ["truncated"] * 4
    assert [defect(q, a) for a in (q, q.upper(), q + "\n" + q, "> " + q)] == ["copy"] * 4
    assert [defect(q, a) for a in ("I'm sorry, but I can't help with that.", "Let me see. As an assistant I must decline. I hope you understand.")] == ["refusal"] * 2
    assert defect(q, "I'm afraid the old format has a bug, but the new reader works around it.") is None
    de = "Die Funktion geht die Liste nur einmal durch, weil der Eintrag dann schon da ist."
    assert defect(q, de) == "wrong_language" and defect(q + " Please answer in German.", de) is None and defect(None, de) is None
    assert lcs_length(list("abcde"), list("xbxdx")) == 2 and lcs_length([], ["a"]) == 0


def test_pairs_equal_a_loop(spark, make_turns):
    rnd = random.Random(5)
    names = {"U": ["User", " human ", "DEVELOPER"], "A": ["AI", "Copilot"], "O": ["Tool", None]}
    rows, want = [], {}
    for t in range(4):
        user = None
        for i in range(0, 900 if t == 0 else 25):
            if rnd.random() < 0.2:
                continue
            r = rnd.choices("UAO", [1, 1, 6 if t == 0 else 1])[0]
            rows.append((t, i, rnd.choice(names[r]), f"{t}-{i}"))
            if r == "U":
                user = i
            elif r == "A" and user is not None:
                want[t, i] = (f"{t}-{user}", f"{t}-{i}")
                user = None
    turns = make_turns(rows + rows[::3] + [(None, 1, "User", "x"), (1, None, "AI", "y")])
    got = {(r.transcript_id, r.turn_idx): (r.prompt, r.response) for r in prompt_response_pairs(turns, block=64).collect()}
    assert got == want


def test_query(spark, make_turns):
    t = make_turns([(1, 0, "User", "hi there my friend"), (1, 1, "Tool", "x"), (1, 2, "AI", None), (1, 2, "AI", None), (1, 3, "AI", "more")])
    assert [tuple(r) for r in find_defects(t).collect()] == [(1, 2, "empty")]
    assert find_defects(t.limit(0)).count() == 0


def test_inline_code_ends_no_sentence():
    q = "Why does `load()` raise an error when the list is empty?"
    assert [defect(q, a) for a in ("The BufferReader owns the snapshot, and `route_session()`", "It was unused.\n\nI moved the check into `publish_queue()`")] == ["truncated"] * 2
    assert [defect(q, a) for a in ("`O(n log n)`", "`load()`, `store()`", "It needs this call:\n`load(None)`", "I moved the check into `load()`.", "It prints `No rows.`")] == [None] * 5
