"""Token ids of texts by a tokenizer file, in Arrow batches."""

from __future__ import annotations

import os

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_LOADED: dict = {}


def _tokenizer(path: str):
    """The tokenizer of a file, loaded once a worker."""
    if path not in _LOADED:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        _LOADED[path] = Tokenizer.from_file(path)
        _LOADED[path].encode_special_tokens = True  # such strings in a text are ordinary text
    return _LOADED[path]


def token_ids(text: Column, tokenizer: str, most: int | None = None) -> Column:
    """The ids of whole texts, the first `most` of them where given; null texts have none. tokenizer is a JSON file that every
    executor has at that path; no special ids are added."""

    @F.pandas_udf("array<int>")
    def run(texts: pd.Series) -> pd.Series:
        found = _tokenizer(tokenizer).encode_batch([x or "" for x in texts], add_special_tokens=False)
        return pd.Series([x.ids[:most] for x in found], dtype=object)

    return run(text)
