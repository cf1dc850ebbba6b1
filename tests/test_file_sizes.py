"""Files of triplets that queries write and read back: no task writes a fixed share of all lines."""

import glob
import os

import pytest
from packloom.plans import queries

FOLDER = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")


@pytest.mark.parametrize("write, least", [(queries._written_triplets, 6), (queries._mixed_lines, 5)])
def test_files_follow_the_texts(spark, monkeypatch, write, least):
    def sizes() -> list[int]:
        path = write(spark, FOLDER).removeprefix("file:")
        return [os.path.getsize(file) for file in glob.glob(f"{path}/part-*")]

    few = sizes()
    assert len(few) == least
    monkeypatch.setattr(queries, "FILE_BYTES", 1 << 16)
    many = sizes()
    assert len(many) >= 3 * least
    assert abs(sum(many) - sum(few)) < 0.01 * sum(few)
    # The largest document alone is a good part of a file here.
    assert max(many) < max(few) / 2
