import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from turnwise.session import build_session

    s = build_session(cores=4, shuffle_partitions=4, spark__sql__warehouse__dir=str(tmp_path_factory.mktemp("warehouse")))
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


TURNS = "transcript_id long, turn_idx long, speaker string, content string, timestamp string, code_blocks array<struct<code:string,language:string>>, phase string, metadata struct<client_id:int,channel:string,model:string,tool:string>, ingested_at timestamp, extra string"


@pytest.fixture(scope="session")
def make_turns(spark):
    """Turns of (transcript_id, turn_idx, speaker, content) with optional further columns by name."""

    def make(rows):
        full = []
        for r in rows:
            base = dict(zip(("transcript_id", "turn_idx", "speaker", "content"), r[:4])) | (r[4] if len(r) > 4 else {})
            full.append(tuple(base.get(c.split()[0]) for c in ("transcript_id", "turn_idx", "speaker", "content", "timestamp", "code_blocks", "phase", "metadata", "ingested_at", "extra")))
        return spark.createDataFrame(full, TURNS)

    return make
