"""Scoring requests with a user's model: batched, distinct inputs once, errors per row."""

from __future__ import annotations

import time
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def infer(requests: DataFrame, tokens: str, make_model: Callable[[], Callable[[list[np.ndarray]], list[list[float]]]], request_id: str = "request_id") -> DataFrame:
    """(request_id, inference, error, time_ms, cache_hit): the model runs once for each distinct input.

    make_model() is called once a task and returns a function from token arrays to lists of numbers.  A batch that
    fails is tried again row by row, so one bad request yields an error and not a failed job.
    """
    rows = requests.select(F.col(request_id).alias("request_id"), F.col(tokens).cast("array<long>").alias("tokens"))
    distinct = rows.where("tokens is not null").groupBy("tokens").agg(F.min("request_id").alias("first"))

    def run(batches):
        model = make_model()
        for pdf in batches:
            if not len(pdf):
                continue
            began, inputs = time.perf_counter(), [np.array(list(t)) for t in pdf["tokens"]]
            out, errors = [], [None] * len(inputs)
            try:
                out = [list(map(float, r)) for r in model(inputs)]
            except Exception:  # noqa: BLE001  the user's model
                for i, t in enumerate(inputs):
                    try:
                        out.append(list(map(float, model([t])[0])))
                    except Exception as e:  # noqa: BLE001
                        out.append(None)
                        errors[i] = str(e)[:500]
            ms = 1000 * (time.perf_counter() - began) / len(inputs)
            yield pd.DataFrame({"tokens": pdf["tokens"], "first": pdf["first"], "inference": out, "error": errors, "time_ms": ms})

    kind = dict(rows.dtypes)["request_id"]
    scored = distinct.mapInPandas(run, f"tokens array<long>, first {kind}, inference array<double>, error string, time_ms double")
    return rows.join(scored, "tokens", "left").select(
        "request_id", "inference", F.when(F.col("tokens").isNull(), "no tokens").otherwise(F.col("error")).alias("error"),
        "time_ms", (F.col("request_id") != F.col("first")).alias("cache_hit"),
    )
