import numpy as np
import pandas as pd
import pyarrow as pa
from packloom.operators.vocabulary import _ids_of


class Counted:
    """An index that says how many words it was asked for."""

    def __init__(self, tokens):
        self.index, self.asked = pd.Index(tokens), 0

    def get_indexer(self, words):
        self.asked += len(words)
        return self.index.get_indexer(words)


def test_a_repeated_word_is_looked_up_once():
    tokens, ids = Counted(["a", "b", "c"]), np.array([5, 6, 7, 0], np.int32)
    words = pa.array(["b", "x", "a", None, "b"] * 1000)
    assert _ids_of(words, tokens, ids).tolist() == [6, 0, 5, 0, 6] * 1000
    assert tokens.asked == 3
    assert _ids_of(pa.array([], pa.string()), tokens, ids).tolist() == []
