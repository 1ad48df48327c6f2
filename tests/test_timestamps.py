from datetime import datetime, timezone

import pytest

from turnwise.operators.timestamps import find_instants

CLIENTS = [(1, "a", "Europe/Berlin", "de-DE"), (2, "b", "America/Chicago", "en-US"), (3, "c", None, None), (4, "d", "Asia/Shanghai", "en-GB"), (5, "e", "No/Where", "en-US")]


def us(*a, micro=0):
    return int(datetime(*a, tzinfo=timezone.utc).timestamp()) * 1_000_000 + micro


CASES = [
    ("2025-07-20T00:23:54.373536+10:00", 3, us(2025, 7, 19, 14, 23, 54, micro=373536)),
    ("2025-07-20 10:00:00", 1, us(2025, 7, 20, 8)),
    ("2025-07-20 10:00:00", 3, None),
    ("2025-07-20 10:00:00", 5, None),
    ("2025-10-26 02:30:00", 1, us(2025, 10, 26, 0, 30)),  # happens twice: the earlier
    (" 2025-07-10t12:13:59z ", 3, us(2025, 7, 10, 12, 13, 59)),
    ("1725170410", 3, us(2024, 9, 1, 6, 0, 10)),
    ("1725170410123", 3, us(2024, 9, 1, 6, 0, 10, micro=123000)),
    ("1725170410123456", 3, us(2024, 9, 1, 6, 0, 10, micro=123456)),
    ("1777727686.448", 3, us(2026, 5, 2, 13, 14, 46, micro=448000)),
    ("02/01/2026 21:20", 2, us(2026, 2, 2, 3, 20)),
    ("02/01/2026 21:20", 4, us(2026, 1, 2, 13, 20)),
    ("02/01/2026 21:20", 3, None),
    ("2025/06/03 21:27:29", 4, us(2025, 6, 3, 13, 27, 29)),
    ("12/31/2025 12:21:39 AM", 2, us(2025, 12, 31, 6, 21, 39)),
    ("15.09.2024 01:38:21", 1, us(2024, 9, 14, 23, 38, 21)),
    ("Jun 9, 2025 4:01 PM", 1, us(2025, 6, 9, 14, 1)),
    ("Sun, 06 Oct 2024 01:34:44 +0930", 3, us(2024, 10, 5, 16, 4, 44)),
    ("02-Jun-2026 18:34:56 UTC", 3, us(2026, 6, 2, 18, 34, 56)),
    ("2025-11-30 07:25:13 CST", 2, us(2025, 11, 30, 13, 25, 13)),
    ("2025-11-30 07:25:13 CST", 4, us(2025, 11, 29, 23, 25, 13)),
    ("2025-10-17T17:42:25+09:30[Australia/Adelaide]", 3, us(2025, 10, 17, 8, 12, 25)),
    ("20250816T172048Z", 3, us(2025, 8, 16, 17, 20, 48)),
    ("2025-12-06T14:55Z", 3, us(2025, 12, 6, 14, 55)),
    *[(t, 1, None) for t in ("2025-02-29 10:00:00", "25:61", "0000-00-00 00:00:00", "2025-13-01 00:00:00", "2025-01-01 24:00:00", "yesterday 14:10", "", "n/a", "2025-01-01", "12345", None)],
]


def test_formats(spark, make_turns):
    rows = [(1, i, "User", "x", {"timestamp": t, "metadata": (c, None, None, None)}) for i, (t, c, _) in enumerate(CASES)]
    turns = make_turns(rows + rows[:3])
    messages = spark.createDataFrame([(9, 0, "2025-07-20 10:00:00", 1), (9, 1, None, None), (None, None, "1725170410", None)], "session_id long, msg_idx int, timestamp string, client_id int")
    clients = spark.createDataFrame(CLIENTS, "client_id int, client_name string, home_zone string, locale string")
    got = find_instants(turns, messages, clients).collect()
    assert len(got) == len({tuple(r) for r in got})
    found = {(r.origin, r.owner_id, r.idx): r.epoch_us for r in got}
    for i, (text, client, want) in enumerate(CASES):
        assert found.get(("turns", 1, i)) == want, (text, client)
    assert found["session_messages", 9, 0] == us(2025, 7, 20, 8) and ("session_messages", 9, 1) not in found
    assert found["session_messages", None, None] == us(2024, 9, 1, 6, 0, 10)


@pytest.mark.parametrize("which", ["turns", "clients"])
def test_empty_tables(spark, make_turns, which):
    turns = make_turns([(1, 0, "User", "x", {"timestamp": "1725170410"})])
    clients = spark.createDataFrame(CLIENTS, "client_id int, client_name string, home_zone string, locale string")
    messages = spark.createDataFrame([], "session_id long, msg_idx int, timestamp string, client_id int")
    n = find_instants(turns.limit(0) if which == "turns" else turns, messages, clients.limit(0) if which == "clients" else clients).count()
    assert n == (0 if which == "turns" else 1)
