"""Subword tokens of public tokenizers, as batched functions over columns.

``path`` names a tokenizer file of the ``tokenizers`` library (JSON). It is loaded once per worker;
no file is part of this package. The default stands for any other: only ids are used.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

#: A public tokenizer with word ends: lower case, white space dropped.
DEFAULT = "/opt/tokenizers/word_bpe_49k.json"

_loaded: dict = {}


def load(path: str):
    """The tokenizer of a file; strings of special tokens in a text are ordinary text."""
    if path not in _loaded:
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.encode_special_tokens = True
        t.no_padding()
        t.no_truncation()
        _loaded[path] = t
    return _loaded[path]


def special_ids(path: str, names: tuple[str, ...]) -> dict[str, int]:
    """Ids of tokens that the vocabulary must hold; an error names those it lacks."""
    t = load(path)
    ids = {n: t.token_to_id(n) for n in names}
    missing = sorted(n for n, i in ids.items() if i is None)
    if missing:
        raise ValueError(f"tokenizer {path} has no {', '.join(missing)}")
    return ids


def token_ids(path: str = DEFAULT):
    """Ids of a text, without special tokens; null and empty texts have none.

    Texts are encoded one after the other: an encoding takes some hundred bytes a token, its ids four.
    """

    @F.pandas_udf("array<int>")
    def ids(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        t = load(path)
        for part in parts:
            yield pd.Series([np.array(t.encode_batch_fast([x or ""], add_special_tokens=False)[0].ids, np.int32) for x in part], dtype=object)

    return ids


def token_texts(path: str = DEFAULT):
    """Tokens of a text as they stand in the vocabulary."""

    @F.pandas_udf("array<string>")
    def texts(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        t = load(path)
        for part in parts:
            yield pd.Series([e.tokens for e in t.encode_batch([x or "" for x in part], add_special_tokens=False)], dtype=object)

    return texts


def truncated(path: str = DEFAULT, most: int = 550):
    """A text of more than ``most`` tokens cut behind these; shorter ones as they are."""

    @F.pandas_udf("string")
    def cut(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        t = load(path)
        for part in parts:
            out = t.encode_batch([x or "" for x in part], add_special_tokens=False)
            yield pd.Series([None if x is None else x if len(e.ids) <= most else x[: e.offsets[most - 1][1]] for x, e in zip(part, out)], dtype=object)

    return cut
