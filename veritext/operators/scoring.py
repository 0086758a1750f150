"""Batch scoring by a pluggable external model (M7).

``score_batches`` runs ``mapInPandas``: each Python worker calls
``scorer.load()`` once (model state arrives through a Spark broadcast, so
it is shipped once per executor), then ``scorer.score(pdf)`` per Arrow
batch.  The default scorer is a linear log-probability model (e.g. naive
Bayes parameters) over the sparse TF-IDF entries of each row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


class LinearLogProbScorer:
    """scores = log_prior + X @ theta.T over (indices, values) arrays; returns
    the arg-max class (first maximum) and its softmax probability."""

    def __init__(self, bc):
        self.bc = bc          # broadcast of {"theta": k x V ndarray, "prior": k, "classes": k}
        self.state = None

    def load(self):
        if self.state is None:
            self.state = self.bc.value
        return self.state

    def score(self, pdf: pd.DataFrame) -> pd.DataFrame:
        """One vectorised pass per Arrow batch: the batch's sparse entries are
        flattened (row id, column, value) and accumulated into an n x k score
        matrix; no per-row Python."""
        st = self.load()
        theta, prior, classes = st["theta"], st["prior"], st["classes"]
        n = len(pdf)
        lens = np.fromiter((0 if x is None else len(x) for x in pdf["idx"]), dtype=np.int64, count=n)
        scores = np.tile(np.asarray(prior, dtype=np.float64), (n, 1))
        if lens.sum() > 0:
            nz = [x for x in pdf["idx"] if x is not None and len(x)]
            nv = [x for x in pdf["val"] if x is not None and len(x)]
            cols = np.concatenate([np.asarray(x, dtype=np.int64) for x in nz])
            vals = np.concatenate([np.asarray(x, dtype=np.float64) for x in nv])
            rows = np.repeat(np.arange(n), lens)
            np.add.at(scores, rows, theta[:, cols].T * vals[:, None])
        j = np.argmax(scores, axis=1)                        # first maximum wins
        top = scores[np.arange(n), j]
        p_max = 1.0 / np.exp(scores - top[:, None]).sum(axis=1)
        return pd.DataFrame({"id": pdf["id"].values, "pred_id": np.asarray(classes)[j].astype(np.int32),
                             "p_max": p_max})


def score_batches(df: DataFrame, scorer, schema: str = "id long, pred_id int, p_max double") -> DataFrame:
    """``df`` columns: id, idx array<int>, val array<double>."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer.load()
        for pdf in batches:
            yield scorer.score(pdf)
    return df.mapInPandas(run, schema)
