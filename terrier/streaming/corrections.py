"""T3 as a stream: what the reviewers' corrections taught so far, kept as state by field and reading."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X

STATE = "correction string, ts long, count long"
LEARNED = "field string, ocr_norm string, correction string, count long"


def corrections(log: DataFrame) -> DataFrame:
    """The corrections of a log (field, ocr_value, correction, ts in any order type that casts to long) that teach something: readings of three signs or more
    that the correction changes.
    """
    own = log.select("field", X.learned_key("ocr_value").alias("ocr_norm"), "correction", F.col("ts").cast("long").alias("ts"))
    return own.filter((F.length("ocr_norm") >= 3) & (F.trim("correction") != "") & (F.col("ocr_norm") != X.learned_key("correction")))


def _learn(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    correction, ts, count = state.get if state.exists else (None, None, 0)
    for rows in batches:
        count += len(rows)
        top = rows.sort_values(["ts", "correction"]).iloc[-1]
        if ts is None or (top.ts, top.correction) >= (ts, correction):
            correction, ts = top.correction, int(top.ts)
    state.update((correction, ts, count))
    yield pd.DataFrame({"field": [key[0]], "ocr_norm": [key[1]], "correction": [correction], "count": [count]})


def learned(log: DataFrame) -> DataFrame:
    """Of a streaming log, a row for each field and reading that a batch touched: the last correction by time (of equal times the last by text), and how often one
    was made since the stream's first start. The state is a row a key, so a key that a third of all corrections have is one row too.
    """
    return corrections(log).groupBy("field", "ocr_norm").applyInPandasWithState(_learn, LEARNED, STATE, "update", "NoTimeout")
