import random

import numpy as np

from turnwise.llm.leakage import K, WINDOW, HeldOut, find_leaks, gram_hashes, held_words, leaked_items, winnow, words_of
from turnwise.llm.packing import fill_containers, pack, pieces, usage
from turnwise.llm.subjects import find_subjects, subject_shares

RND = random.Random(3)
VOCABULARY = [f"w{i}" for i in range(400)]


def text(n):
    return " ".join(RND.choice(VOCABULARY) for _ in range(n))


def test_winnowing_guarantee():
    for _ in range(200):
        a, b, shared = (np.array([RND.randrange(1 << 30) for _ in range(n)], dtype=np.uint64) for n in (20, 15, K + WINDOW - 1))
        x, y = (gram_hashes(np.concatenate([s, shared, t])) for s, t in ((a, b), (b, a)))
        assert set(x[winnow(x)]) & set(y[winnow(y)])


def test_local_alignment_against_brute_force():
    for _ in range(30):
        doc, item = (np.array([RND.randrange(5) for _ in range(RND.randint(3, 14))]) for _ in range(2))
        h = np.zeros((len(item) + 1, len(doc) + 1), dtype=int)
        for i in range(1, len(item) + 1):
            for j in range(1, len(doc) + 1):
                h[i, j] = max(0, h[i - 1, j - 1] + (1 if item[i - 1] == doc[j - 1] else -1), h[i - 1, j] - 1, h[i, j - 1] - 1)
        a, b = held_words(doc, item)
        best = int(h.max())
        assert (b - a >= best) if best else b == a
        if best:
            assert int(h[b].max()) == best


def test_leaks():
    passages = {i: text(120) for i in range(30)}
    held = HeldOut.of(list(passages.items()))
    words = passages[4].split()
    changed = [RND.choice(VOCABULARY) if k % 8 == 3 else w for k, w in enumerate(words)]
    half, third = words[:66], words[:40]
    layout = "  ".join(words).upper().replace("  ", " ,\n", 20)
    pad = text(150)
    assert [leaked_items(f"{pad} {' '.join(x)} {pad}", held) != [] for x in (words, changed, half, third)] == [True, True, True, False]
    assert [i for i, _ in leaked_items(pad + layout, held)] == [4]
    assert leaked_items(None, held) == leaked_items("", held) == leaked_items("a b", held) == [] and words_of("Ab-\nc d_e​") == ["abc", "d", "e"]


def test_leak_query(spark):
    items = [(i, text(100)) for i in range(6)] + [(7, None), (None, "x"), (8, "too short")]
    docs = [(1, text(80) + " " + items[0][1]), (2, items[5][1]), (3, items[5][1]), (4, None), (5, ""), (6, text(200))]
    d = spark.createDataFrame([(*x, "q") for x in docs], "doc_id long, text string, item_id string")
    i = spark.createDataFrame(items, "item_id long, passage string")
    assert sorted((r.doc_id, r.item_id) for r in find_leaks(d, i).collect()) == [(1, 0), (2, 5), (3, 5)]
    assert sorted((r.doc_id, r.item_id) for r in find_leaks(d.union(d), i.union(i)).collect()) == [(1, 0), (2, 5), (3, 5)]
    assert find_leaks(d, i.limit(0)).count() == 0 == find_leaks(d.limit(0), i).count()


def test_packing():
    for _ in range(50):
        capacity = RND.randint(10, 200)
        lengths = [RND.randint(0, capacity) for _ in range(RND.randint(0, 300))]
        bins: dict[int, int] = {}
        for b, n in zip(pack(lengths, capacity), lengths):
            bins[b] = bins.get(b, 0) + n
        assert all(v <= capacity for v in bins.values())
        assert len(bins) <= 1.7 * -(-sum(lengths) // capacity) + 18
    assert pieces(25, 10) == [10, 10, 5] and pieces(20, 10) == [10, 10] and pieces(0, 10) == [0]


def test_packing_query(spark):
    docs = [(i, "word " * RND.randint(1, 900)) for i in range(60)] + [(100, None), (101, ""), (102, "same"), (103, "same")]
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    w = spark.createDataFrame([(1, "s", 256), (2, "m", 1024), (3, "bad", None)], "window_id int, window_name string, capacity_tokens int")
    placed = fill_containers(d, w).collect()
    assert {r.doc_id for r in placed if r.window_id == 1} == {*range(60), 102, 103}
    used: dict[tuple, int] = {}
    for r in placed:
        used[r.window_id, r.container] = used.get((r.window_id, r.container), 0) + r.n_tokens
    assert all(v <= (256 if k[0] == 1 else 1024) for k, v in used.items())
    totals = {k: sum(r.n_tokens for r in placed if r.window_id == k) for k in (1, 2)}
    assert totals[1] == totals[2]
    assert all(0.5 < r.filled <= 1 for r in usage(spark.createDataFrame(placed), w).collect())


def test_subjects(spark):
    law = "The appeal deadline is stored. A missing court filing is grey. Nothing else was touched. Old entries keep the `trial_brief`."
    assert subject_shares(law).keys() == {"law"} and subject_shares(law)["law"] >= 0.6 and subject_shares("") == {}
    mention = "The CropRotation is stored here. " + "Nothing else was touched at all. " * 9
    docs = [(1, law), (2, law), (3, mention), (4, None), (5, ""), (6, "```\ncompiler pass\n```")]
    d = spark.createDataFrame([(*x, "y") for x in docs], "doc_id long, text string, subject string")
    s = spark.createDataFrame([("Law", "x"), ("farming", "x"), (None, "x")], "subject string, description string")
    assert sorted((r.doc_id, r.subject) for r in find_subjects(d, s).collect()) == [(1, "Law"), (2, "Law")]
    assert find_subjects(d.limit(0), s).count() == 0


def test_a_passage_in_two_pieces_is_held():
    from turnwise.llm.leakage import HeldOut, leaked_items

    words = [f"w{i}" for i in range(100)]
    held = HeldOut.of([(1, " ".join(words))])
    filler = lambda n, c: [f"{c}{i}" for i in range(n)]
    for gap in (40, 400):
        text = " ".join([*filler(30, "x"), *words[:33], *filler(gap, "y"), *words[60:93], *filler(30, "z")])
        assert [i for i, _ in leaked_items(text, held)] == [1]
    assert leaked_items(" ".join([*words[:30], *filler(400, "y"), *words[80:90]]), held) == []
    moved = " ".join([*words[60:93], *filler(90, "y"), *words[:33]])
    assert [i for i, _ in leaked_items(moved, held)] == [1]


def test_leaks_in_stretches_against_brute_force(spark):
    """Copies in one to three stretches with asides and scattered changes: the held words, counted directly, decide."""
    passages = {i: text(120).split() for i in range(12)}
    docs, want = [], set()
    for n in range(120):
        item = RND.randrange(12)
        parts = RND.choice([[(0, 120)], [(0, 45), (75, 120)], [(0, 40), (40, 80), (80, 120)], [(10, 80)], [(0, 40)], [(20, 50)], []])
        words = text(60).split()
        for a, b in parts:
            words += [RND.choice(VOCABULARY) if RND.random() < 0.04 else w for w in passages[item][a:b]] + text(RND.choice([60, 200])).split()
        docs.append((n, " ".join(words)))
        if sum(b - a for a, b in parts) >= 66:
            want.add((n, item))
    d = spark.createDataFrame(docs, "doc_id long, text string")
    i = spark.createDataFrame([(k, " ".join(v)) for k, v in passages.items()], "item_id long, passage string")
    assert {(r.doc_id, r.item_id) for r in find_leaks(d, i).collect()} == want


def test_containers_follow_from_the_data(spark):
    docs = [(i, "word " * RND.randint(1, 400)) for i in range(80)]
    w = spark.createDataFrame([(1, "s", 256)], "window_id int, window_name string, capacity_tokens int")
    first, again = (
        {tuple(r) for r in fill_containers(spark.createDataFrame(x, "doc_id long, text string").repartition(k), w, parts=2).collect()}
        for x, k in ((docs, 2), (docs[::-1] + docs[:5], 5))
    )
    assert first == again


def test_large_texts_share_their_rest():
    lengths = [RND.randint(520, 900) for _ in range(2000)] + [RND.randint(20, 400) for _ in range(2600)]
    bins = pack(lengths, 1000)
    assert sum(lengths) / 1000 / len(set(bins)) > 0.95
