"""Python functions over batches of rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame


def batch_process(df: DataFrame, function: Callable[[pd.DataFrame], pd.DataFrame], schema: str, batch_size: int = 1000) -> DataFrame:
    """function over batches of at most ``batch_size`` rows of each partition, in parallel over partitions."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for i in range(0, len(b), batch_size):
                yield function(b.iloc[i : i + batch_size])

    return df.mapInPandas(run, schema)
