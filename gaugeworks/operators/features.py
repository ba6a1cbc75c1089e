"""Dense features: pooling, blending, and a linear probe."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pool(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """key, pos, most, mean: maximum and mean of every position over the key's vectors."""
    each = rows.select(key, F.posexplode(vector).alias("pos", "v"))
    return each.groupBy(key, "pos").agg(F.max("v").alias("most"), F.avg("v").alias("mean"))


def blend(a: Column, b: Column, alpha: float) -> Column:
    """(1 - alpha) a + alpha b, elementwise; 0 and 1 give the ends exactly."""
    if alpha in (0, 1):
        return b if alpha else a
    return F.zip_with(a, b, lambda x, y: x * F.lit(1 - alpha) + y * F.lit(alpha))


def linear_probe(rows: DataFrame, vector: str, label: str, held: str, components: int = 16, strengths: tuple[float, ...] = (0.0, 0.01)) -> DataFrame:
    """Standardise, project, fit a multinomial logistic model for each strength; accuracy on fitted and held-out rows."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import PCA, StandardScaler
    from pyspark.ml.functions import array_to_vector

    data = rows.select(array_to_vector(F.col(vector).cast("array<double>")).alias("x"), F.col(label).cast("double").alias("y"), F.col(held).alias("held"))
    fit = data.filter(~F.col("held"))
    out = None
    for strength in strengths:
        model = Pipeline(
            stages=[
                StandardScaler(inputCol="x", outputCol="z", withMean=True),
                PCA(k=components, inputCol="z", outputCol="p"),
                LogisticRegression(featuresCol="p", labelCol="y", regParam=strength, maxIter=30),
            ]
        ).fit(fit)
        hit = (F.col("prediction") == F.col("y")).cast("double")
        one = model.transform(data).groupBy("held").agg(F.count(F.lit(1)).alias("n"), F.avg(hit).alias("accuracy")).withColumn("strength", F.lit(strength))
        out = one if out is None else out.unionByName(one)
    return out


def one_vs_rest_probe(rows: DataFrame, vector: str, label: str, held: str, most_classes: int = 64) -> DataFrame:
    """held, n, exact, n_named: a balanced logistic model for each class; exact where the classes named are the label alone.

    Rows weigh n / (2 x rows on their side), so a rare class counts as much as all others.
    A class that all fitted rows have, or none, is not fitted: it is named for all rows or for none.
    """
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import StandardScaler
    from pyspark.ml.functions import array_to_vector, vector_to_array

    data = rows.select(array_to_vector(F.col(vector).cast("array<double>")).alias("x"), F.col(label).alias("label"), F.col(held).alias("held"))
    fit = data.filter(~F.col("held"))
    counts = {r[0]: r[1] for r in fit.groupBy("label").agg(F.count(F.lit(1))).limit(most_classes + 1).collect()}
    if len(counts) > most_classes:
        raise ValueError(f"more than {most_classes} classes")
    n = sum(counts.values())
    if not n:
        return data.groupBy("held").agg(F.count(F.lit(1)).alias("n"), F.lit(None).cast("double").alias("exact"), F.lit(None).cast("double").alias("n_named"))
    scaler = StandardScaler(inputCol="x", outputCol="z", withMean=True).fit(fit)
    fitted, out = scaler.transform(fit), scaler.transform(data).withColumn("named", F.lit(0)).withColumn("hit", F.lit(False))
    for name, own in sorted(counts.items()):
        mine = F.col("label") == F.lit(name)
        if own == n:
            said = F.lit(True)
        else:
            weighed = fitted.select("z", mine.cast("double").alias("y"), F.when(mine, n / (2 * own)).otherwise(n / (2 * (n - own))).alias("w"))
            model = LogisticRegression(featuresCol="z", labelCol="y", weightCol="w", regParam=0.01, maxIter=20).fit(weighed)
            score = F.aggregate(
                F.zip_with(vector_to_array("z"), F.array(*(F.lit(float(c)) for c in model.coefficients)), lambda a, b: a * b), F.lit(float(model.intercept)), lambda acc, x: acc + x
            )
            said = score > 0
        out = out.withColumn("named", F.col("named") + said.cast("int")).withColumn("hit", F.col("hit") | (mine & said))
    exact = (F.col("hit") & (F.col("named") == 1)).cast("double")
    return out.groupBy("held").agg(F.count(F.lit(1)).alias("n"), F.avg(exact).alias("exact"), F.avg("named").alias("n_named"))
