"""A user's own model over rows, batch by batch."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame


def batch_infer(rows: DataFrame, load: Callable[[], Callable[[pd.DataFrame], pd.DataFrame]], schema: str, on_error: str = "drop", batch_size: int = 256) -> DataFrame:
    """``load()`` runs once a task and returns a function from a batch to result rows (``schema`` plus a column ``error``).

    A batch that fails is tried row by row; a row that fails is dropped, or kept with its error (``on_error="keep"``)."""
    columns = [x.strip().split()[0] for x in schema.split(",")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for whole in batches:
            for at in range(0, len(whole), batch_size):
                part = whole.iloc[at : at + batch_size]
                try:
                    yield model(part).assign(error=None)[[*columns, "error"]]
                except Exception:
                    for i in range(len(part)):
                        one = part.iloc[i : i + 1]
                        try:
                            yield model(one).assign(error=None)[[*columns, "error"]]
                        except Exception as error:
                            if on_error == "keep":
                                yield one.reindex(columns=columns).assign(error=str(error))

    return rows.mapInPandas(run, schema + ", error string")
