"""What a lane's task of the stream packer holds at once."""

import numpy as np
import pandas as pd
from packloom.streaming.ingest import SMALL_BATCH, small_batches
from packloom.streaming.packer import PACKS_AT_ONCE, _packer

ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


class Lane:
    exists, hasTimedOut, get = False, False, None

    def update(self, value):
        self.get = value


def test_a_lane_gives_its_packs_on_as_it_goes():
    n, size = 1000, 30
    slots = [[np.full(size, i, np.int32), np.empty(0, np.int32)] for i in range(n)]
    rows = pd.DataFrame({"sample_key": range(n), "slots": slots, "source_id": [""] * n})
    lane = Lane()
    given = list(_packer(size * 2, 8, None)(("lane",), iter([rows.iloc[n // 2 :], rows.iloc[: n // 2]]), lane))
    assert max(map(len, given)) <= PACKS_AT_ONCE
    packs = pd.concat(given)
    assert packs["pack_no"].tolist() == list(range(n // 2 - 1))
    assert [key for keys in packs["sample_keys"] for key in keys] == list(range(n - 2))
    assert [int(tokens[0]) for tokens in packs["input_ids"]] == list(range(0, n - 2, 2))
    assert lane.get[:2] == (n // 2 - 1, [n - 2, n - 1])


def test_queries_inside_get_small_batches(spark):
    before = spark.conf.get(ROWS)
    with small_batches(spark):
        assert int(spark.conf.get(ROWS)) == SMALL_BATCH
    assert spark.conf.get(ROWS) == before
    spark.conf.set(ROWS, "7")
    try:
        with small_batches(spark):
            assert spark.conf.get(ROWS) == "7"
    finally:
        spark.conf.set(ROWS, before)
