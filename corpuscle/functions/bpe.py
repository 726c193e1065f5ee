"""Encoding with a given byte-level BPE vocabulary. The file's path is a parameter and must be readable by the executors;
nothing is trained here."""

from __future__ import annotations

from functools import cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


@cache
def tokenizer(path: str):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(path)
    own.encode_special_tokens = True  # their strings in a text are ordinary text
    return own


def encode(text: Column, path: str, most: int | None = None) -> Column:
    """Token ids, the first `most` if given; null texts stay null. A worker loads the file once."""

    @F.pandas_udf("array<int>")
    def run(values: pd.Series) -> pd.Series:
        own = tokenizer(path)
        batch = own.encode_batch([v or "" for v in values], add_special_tokens=False)
        return pd.Series([None if v is None else e.ids[:most] for v, e in zip(values, batch, strict=True)])

    return run(text)


def decode(ids: Column, path: str) -> Column:
    @F.pandas_udf("string")
    def run(values: pd.Series) -> pd.Series:
        own = tokenizer(path)
        return values.map(lambda v: None if v is None else own.decode([int(x) for x in v]))

    return run(ids)
