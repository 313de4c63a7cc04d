"""Market regime by boosted trees: one-vs-rest GBTs of pyspark.ml, probabilities normalised."""

from __future__ import annotations

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FEATURES = ["cvd_delta", "depth_ratio", "nupl", "roc_30d"]
NAMES = ("BULL", "BEAR", "CONSOLIDATION")
GAMMA = (1.0, 3.0, 2.0)


def assemble(df: DataFrame) -> DataFrame:
    return VectorAssembler(inputCols=FEATURES, outputCol="_x", handleInvalid="keep").transform(df)


def train(features: DataFrame, trees: int = 50, depth: int = 4, rate: float = 0.1, seed: int = 42) -> list[GBTClassificationModel]:
    """A model per class; no rows, no models (the caller then uses regime_rules)."""
    rows = assemble(features.where(F.col("label").isNotNull()).fillna(0.0, FEATURES)).select("_x", "label").cache()
    try:
        if not rows.take(1):
            return []
        fit = GBTClassifier(featuresCol="_x", labelCol="_y", maxIter=trees, maxDepth=depth, stepSize=rate, seed=seed)
        return [fit.fit(rows.withColumn("_y", (F.col("label") == k).cast("double"))) for k in range(len(NAMES))]
    finally:
        rows.unpersist()


def classify(df: DataFrame, models: list[GBTClassificationModel]) -> DataFrame:
    out = assemble(df.fillna(0.0, FEATURES))
    for k, m in enumerate(models):
        scored = m.setProbabilityCol(f"_p{k}").setRawPredictionCol(f"_r{k}").setPredictionCol(f"_c{k}").transform(out)
        out = scored.withColumn(f"_q{k}", F.get(vector_to_array(f"_p{k}"), F.lit(1))).drop(f"_p{k}", f"_r{k}", f"_c{k}")
    total = F.col("_q0") + F.col("_q1") + F.col("_q2")
    out = out.withColumns({p: F.col(f"_q{k}") / total for k, p in enumerate(("p_bull", "p_bear", "p_consolidation"))})
    best = F.array_position(F.array("_q0", "_q1", "_q2"), F.greatest("_q0", "_q1", "_q2")).cast("int")
    pick = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), best)
    return out.withColumn("regime", pick(NAMES)).withColumn("gamma", pick(GAMMA)).drop("_x", "_q0", "_q1", "_q2")
