"""veritext: Spark-native analytics for labelled text corpora.

Every public operator is a function ``DataFrame -> DataFrame`` (or a
pyspark.ml Estimator/Model where there is fitted state).  Work stays in
Catalyst expressions; Python runs only in the few Arrow-batched helpers
(vector assembly for MLlib, pluggable batch scorers).
"""

__all__ = ["session", "functions", "sources", "operators", "plans", "streaming"]
