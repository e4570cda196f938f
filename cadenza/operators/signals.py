"""Signal operators over tables of recordings: a row's arrays to a map of scalar features, in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def measure(df: DataFrame, key: str, inputs: Sequence[str], kernel: Callable[..., dict]) -> DataFrame:
    """(key, features map<string,double>): ``kernel`` of each row's arrays. NaN becomes null; infinite values fail; a null array gives a null map.

    One recording is one row, so tasks hold a batch of recordings; nothing is shuffled.
    """
    kind = dict(df.dtypes)[key]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for row in zip(*[pdf[c] for c in inputs]):
                if any(v is None for v in row):
                    out.append(None)
                    continue
                f = kernel(*[np.asarray(v, float) for v in row])
                if any(np.isinf(v) for v in f.values()):
                    raise ValueError("infinite measurement")
                out.append({k: None if np.isnan(v) else float(v) for k, v in f.items()})
            yield pd.DataFrame({key: pdf[key], "features": pd.Series(out, dtype=object)})

    return df.select(key, *inputs).mapInPandas(run, f"{key} {kind}, features map<string,double>")


def produce(df: DataFrame, key: str, inputs: Sequence[str], kernel: Callable[..., list[dict]], schema: str) -> DataFrame:
    """Row-expanding kernel: the rows of each recording, with its key; NaN becomes null."""
    kind = dict(df.dtypes)[key]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [{key: k, **r} for k, *row in zip(pdf[key], *[pdf[c] for c in inputs]) if all(v is not None for v in row) for r in kernel(*[np.asarray(v, float) for v in row])]
            if rows:
                yield pd.DataFrame(rows)

    return df.select(key, *inputs).mapInPandas(run, f"{key} {kind}, {schema}")


def long(df: DataFrame, key: str) -> DataFrame:
    return df.select(key, F.explode("features").alias("name", "value")).withColumn("value", F.round("value", 6))
