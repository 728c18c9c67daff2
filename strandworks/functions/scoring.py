"""Seam for batched models: judges, generators, annotators.

The factory is called once per worker task and gives a function from a list of prompts to a
list of replies. Rows that need no call are filtered by the caller before they get here.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

Model = Callable[[list[str]], list[str | None]]


def with_retry(model: Model, attempts: int = 5, wait: float = 4.0, sleep: Callable[[float], None] = time.sleep) -> Model:
    """Repeats a failing batch, doubling the pause; the last failure is raised."""

    def call(prompts: list[str]) -> list[str | None]:
        pause = wait
        for k in range(attempts):
            try:
                return model(prompts)
            except Exception:
                if k == attempts - 1:
                    raise
                sleep(pause)
                pause *= 2
        return []

    return call


def score(df: DataFrame, prompt: str, reply: str, factory: Callable[[], Model], batch: int = 64) -> DataFrame:
    """The table with a column of replies; the order of rows and all columns stay."""
    schema = StructType(list(df.schema.fields)).add(reply, "string")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = factory()
        for part in parts:
            out: list[str | None] = []
            for at in range(0, len(part), batch):
                chunk = part[prompt].iloc[at : at + batch].tolist()
                got = model(chunk)
                if len(got) != len(chunk):
                    raise ValueError("the model gave another number of replies than prompts")
                out += got
            yield part.assign(**{reply: pd.Series(out, index=part.index, dtype=object)})

    return df.mapInPandas(run, schema)


def judged_by_all(df: DataFrame, prompt: str, factories: list[Callable[[], Model]], batch: int = 64) -> DataFrame:
    """Rows that every judge answers with yes; each judge sees only what the ones before accepted."""
    from strandworks.functions.text import leading_verdict

    for i, f in enumerate(factories):
        df = score(df, prompt, f"_v{i}", f, batch).filter(leading_verdict(F.col(f"_v{i}"))).drop(f"_v{i}")
    return df


def recover(df: DataFrame, prompt: str, reply: str, parsed: str, factory: Callable[[], Model]) -> DataFrame:
    """A second call only for rows whose reply could not be parsed."""
    kept = df.filter(F.col(parsed).isNotNull())
    again = score(df.filter(F.col(parsed).isNull()).drop(reply), prompt, reply, factory)
    return kept.unionByName(again.select(kept.columns))
