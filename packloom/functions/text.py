"""Built-in tokenizers: text column to token array column."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed value: a word is a run of letters and digits.
WORD_PATTERN = r"[\p{L}\p{N}]+"

Tokenizer = Callable[[Column], Column]


def words(text: Column | str) -> Column:
    """Lower-case words of a text, in order."""
    column = F.col(text) if isinstance(text, str) else text
    return F.regexp_extract_all(F.lower(column), F.lit(WORD_PATTERN), 0)


def codepoints(text: Column | str) -> Column:
    """One token per character, its Unicode code point. An empty text has no tokens."""
    column = F.col(text) if isinstance(text, str) else text
    points = F.transform(F.split(column, ""), lambda c: F.ascii(c))
    return F.when(column == "", F.array().cast("array<int>")).otherwise(points)


def arrow_tokenizer(encode_batch: Callable[[list[str]], list[list[int]]]) -> Tokenizer:
    """Turn a user's batch encoder (no special tokens) into a column function over Arrow batches."""

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def encode(texts: pa.Array) -> pa.Array:
        return pa.array(encode_batch(texts.to_pylist()), type=pa.list_(pa.int32()))

    return encode
