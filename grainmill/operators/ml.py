"""Pay models with Spark ML: encoding, three regressors, metrics, cross-validation, importances, predictions."""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor

import numpy as np
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import Column, DataFrame, functions as F

from grainmill.session import cut_lineage

# Settings of the three regressors.
SEED = 42
MOST_LABELS = 100_000
FOREST = {"numTrees": 200, "maxDepth": 10, "minInstancesPerNode": 5}
METRICS = "model string, train_r2 double, test_r2 double, cv_r2_mean double, cv_r2_std double, mae double, rmse double"
BOOSTED = {"maxIter": 200, "maxDepth": 5, "stepSize": 0.1, "minInstancesPerNode": 5}
BLOCKS = 5  # not under minInstancesPerNode, so that many equal rows still make a node
TASK_ROWS = 20_000  # counted rows to a task of a boosting job


def model_rows(df: DataFrame, features: Sequence[str], label: str, key: str) -> DataFrame:
    return df.select(key, *features, F.col(label).cast("double").alias("label")).dropna()


def draw(key: str, salt: int) -> Column:
    """A number from 0 to 2^32 - 1 that depends on the key only, so that a row is dealt alike whenever a task is run."""
    text = F.concat(F.lit(f"{salt}:"), F.col(key).cast("string"))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long")


def in_train(key: str, train_share: float = 0.8, seed: int = SEED) -> Column:
    return draw(key, seed) % 1_000_000 < int(train_share * 1_000_000)


def split(df: DataFrame, key: str, train_share: float = 0.8, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """Split by a hash of the key."""
    return df.where(in_train(key, train_share, seed)), df.where(~in_train(key, train_share, seed))


def folds(df: DataFrame, key: str, k: int = 5, seed: int = SEED) -> DataFrame:
    return df.withColumn("fold", (draw(key, seed + 1) % k).cast("int"))


def encoder(features: Sequence[str]):
    """Alphabetical codes per column; values not seen in training get code 0 when predicting."""
    indexer = StringIndexer(
        inputCols=list(features),
        outputCols=[f"{f}_code" for f in features],
        stringOrderType="alphabetAsc",
        handleInvalid="keep",
    )
    return indexer, VectorAssembler(inputCols=[f"{f}_enc" for f in features], outputCol="features")


class Encoder:
    """Fitted label codes: unseen values become 0."""

    def __init__(self, df: DataFrame, features: Sequence[str], most: int = MOST_LABELS):
        self.features = list(features)
        # The labels come to the driver, so a feature that is no category is refused before they do.
        sizes = df.agg(*[F.approx_count_distinct(f).alias(f) for f in self.features]).first().asDict()
        wide = [f for f, n in sizes.items() if n > most]
        if wide:
            raise ValueError(f"too many different values to encode: {wide}")
        indexer, self.assembler = encoder(self.features)
        self.indexer = indexer.fit(df)
        self.sizes = [len(labels) for labels in self.indexer.labelsArray]

    def transform(self, df: DataFrame) -> DataFrame:
        coded = self.indexer.transform(df)
        zeroed = {
            f"{f}_enc": F.when(F.col(f"{f}_code") >= n, 0.0).otherwise(F.col(f"{f}_code"))
            for f, n in zip(self.features, self.sizes)
        }
        return self.assembler.transform(coded.withColumns(zeroed)).drop(*[f"{f}_code" for f in self.features])


class LinearModel:
    """A constant and a weight per encoded feature; predictions are plain expressions."""

    def __init__(self, weights: np.ndarray, columns: Sequence[str]):
        self.weights, self.columns = [float(w) for w in weights], list(columns)

    def prediction(self) -> Column:
        out = F.lit(self.weights[0])
        for weight, column in zip(self.weights[1:], self.columns):
            out = out + F.lit(weight) * F.col(column)
        return out

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumn("prediction", self.prediction())


class Moments:
    """Sums of products of (1, features, label) over some rows: all that least squares needs. They add and subtract."""

    def __init__(self, products: np.ndarray):
        self.products = products

    def __add__(self, other: Moments) -> Moments:
        return Moments(self.products + other.products)

    def __sub__(self, other: Moments) -> Moments:
        return Moments(self.products - other.products)

    def solve(self) -> np.ndarray:
        """Least-squares weights; of least length where the features are dependent."""
        left, right = self.products[:-1, :-1], self.products[:-1, -1]
        scale = np.sqrt(np.maximum(np.diag(left), 1e-300))
        return np.linalg.lstsq(left / np.outer(scale, scale), right / scale, rcond=1e-13)[0] / scale

    def r2(self, weights: np.ndarray) -> tuple[float, float]:
        """R² of the weights on these rows, and the mean squared error."""
        signed = np.append(weights, -1.0)
        n, label = self.products[0, 0], self.products[0, -1]
        squared = float(signed @ self.products @ signed)
        return 1 - squared / float(self.products[-1, -1] - label * label / n), squared / float(n)


class NormalEquations:
    """Linear regression from one aggregate: sums of products per part of the rows, solved for any union of parts."""

    def __init__(self, columns: Sequence[str] | None = None):
        self.columns = columns

    def names(self, df: DataFrame) -> list[str]:
        return list(self.columns or [c for c in df.columns if c.endswith("_enc")])

    def moments(self, df: DataFrame, parts: dict[str, Column]) -> dict[tuple, Moments]:
        """One scan; one row per part reaches the driver. Labels are counted from one row's label, which least squares
        with a constant allows, so that their squares keep their digits."""
        names = self.names(df)
        size = len(names) + 2
        first = df.select("label").head()
        self.centre = first["label"] if first else 0.0
        row = [F.lit(1.0), *[F.col(c).cast("double") for c in names], F.col("label") - F.lit(self.centre)]
        sums = [F.sum(row[i] * row[j]).alias(f"s{i}_{j}") for i in range(size) for j in range(i, size)]
        out = {}
        for r in df.groupBy(*[c.alias(n) for n, c in parts.items()]).agg(*sums).collect():
            products = np.zeros((size, size))
            for i in range(size):
                for j in range(i, size):
                    products[i, j] = products[j, i] = r[f"s{i}_{j}"]
            out[tuple(r[n] for n in parts)] = Moments(products)
        return out

    def model(self, moments: Moments, df: DataFrame) -> LinearModel:
        weights = moments.solve()
        weights[0] += self.centre
        return LinearModel(weights, self.names(df))

    def fit(self, df: DataFrame) -> LinearModel:
        return self.model(self.moments(df, {"part": F.lit(0)})[(0,)], df)


def regressors(forest: dict | None = None, boosted: dict | None = None) -> dict:
    return {
        "Linear Regression": NormalEquations(),
        "Random Forest": RandomForestRegressor(seed=SEED, **(forest or FOREST)),
        "Gradient Boosting": GBTRegressor(seed=SEED, **(boosted or BOOSTED)),
    }


def parts(rows: DataFrame, key: str, marks: dict[str, Column] | None = None) -> DataFrame:
    """Rows with equal features are one to a tree, so they are counted: `n`, the label's `total` and its `spread` (squared
    distances from the mean) per features, marks and block (a hash of the key, up to `BLOCKS`). Runs a job; every
    training set is drawn from the result, and every R² that needs no test rows."""
    marks = {**(marks or {}), "block": draw(key, SEED + 2) % BLOCKS}
    counted = rows.groupBy("features", *[c.alias(name) for name, c in marks.items()])
    n = F.count(F.lit(1))
    return cut_lineage(counted.agg(n.alias("n"), F.sum("label").alias("total"), (F.var_pop("label") * n).alias("spread")))


def boosting_rows(counted: DataFrame, least: int) -> DataFrame:
    """Counted rows for boosting: up to `least` equal shares per features. Runs a job, their count.

    Each of the rounds runs a job a level, and a job costs more by its tasks than by some thousands of rows, so the rows
    are dealt to as few tasks as they need and not to all there are.
    """
    shares = F.least(F.col("n"), F.lit(least).cast("long"))
    rows = counted.groupBy("features").agg(F.sum("n").alias("n"), (F.sum("total") / F.sum("n")).alias("label"))
    rows = rows.withColumn("weight", F.col("n") / shares)
    rows = rows.withColumn("block", F.explode(F.sequence(F.lit(1).cast("long"), shares)))
    tasks = min(-(-rows.count() // TASK_ROWS), rows.sparkSession.sparkContext.defaultParallelism)
    return rows.repartition(max(tasks, 1), "features", "block")


def fit_trees(regressor, counted: DataFrame):
    """Fit on weighted rows. Their number is bounded by the different features, whatever the number of rows.

    Boosting takes whole rows, so each features' rows enter as up to `minInstancesPerNode` equal shares with their mean
    label: the same sums and the same least node as the rows themselves. A forest draws its rows with replacement; here
    it draws blocks, weighted by their rows.
    """
    if isinstance(regressor, GBTRegressor):
        rows = boosting_rows(counted, regressor.getMinInstancesPerNode())
    else:
        total = [F.sum("n").alias("n"), (F.sum("total") / F.sum("n")).alias("label")]
        rows = counted.groupBy("features", "block").agg(*total).withColumn("weight", F.col("n").cast("double"))
        # A small table would be read by one task.
        rows = rows.repartition(rows.sparkSession.sparkContext.defaultParallelism, "features", "block")
    # Sorted, as the forest's draws follow the rows' order.
    rows = rows.sortWithinPartitions("features", "block").select("features", "label", "weight")
    return regressor.fit(rows, {regressor.weightCol: "weight"})


def fit(regressor, rows: DataFrame, key: str):
    """A fitted model of any of the regressors."""
    return regressor.fit(rows) if isinstance(regressor, NormalEquations) else fit_trees(regressor, parts(rows, key))


def with_predictions(model, rows: DataFrame) -> DataFrame:
    """`rows` with their prediction; trees are asked once for each different features."""
    if isinstance(model, LinearModel):
        return model.transform(rows)
    asked = model.transform(rows.select("features").distinct()).select("features", "prediction")
    return rows.join(asked, "features")


def score(model, rows: DataFrame) -> dict[str, float]:
    """r2, mae and rmse in one aggregate over the predictions."""
    error = F.col("label") - F.col("prediction")
    sums = (
        with_predictions(model, rows)
        .agg(
            F.avg(error * error).alias("mse"),
            F.avg(F.abs(error)).alias("mae"),
            F.var_pop("label").alias("variance"),
        )
        .first()
    )
    return {"r2": 1 - sums["mse"] / sums["variance"], "mae": sums["mae"], "rmse": sums["mse"] ** 0.5}


def counted_r2(model, counted: DataFrame) -> float:
    """R² over the rows that `parts` counted: a row's squared error is its cell's spread and the cell's mean error."""
    mean, n = F.col("total") / F.col("n"), F.col("n")
    centre = counted.agg(F.sum("total") / F.sum("n")).scalar()
    left = F.sum(F.col("spread") + n * (mean - F.col("prediction")) ** 2)
    whole = F.sum(F.col("spread") + n * (mean - F.col("_centre")) ** 2)
    sums = with_predictions(model, counted).withColumn("_centre", centre).agg(left.alias("left"), whole.alias("whole")).first()
    return 1 - sums["left"] / sums["whole"]


def evaluate(name: str, regressor, rows: DataFrame, key: str, k: int = 5) -> tuple[object, DataFrame]:
    """Train on four fifths; metrics on both parts and R² over `k` folds (mean and population deviation).

    `rows` are encoded and should be persisted by the caller: they are read twice, whatever k is. Once they are counted,
    which serves every fit and R², and once the test rows are scored, whose absolute errors take the rows themselves.
    """
    if isinstance(regressor, NormalEquations):
        return evaluate_linear(name, regressor, rows, key, k)
    marked = folds(rows, key, k) if k else rows.withColumn("fold", F.lit(0))
    counted = parts(marked, key, {"train": in_train(key), "fold": F.col("fold")})

    def fold_score(i: int) -> float:
        return counted_r2(fit_trees(regressor, counted.where(F.col("fold") != i)), counted.where(F.col("fold") == i))

    # All fits are independent jobs; boosting rounds leave most of a cluster idle, so they run side by side.
    with ThreadPoolExecutor(max(k, 1)) as pool:
        running = [pool.submit(fold_score, i) for i in range(k)]
        model = fit_trees(regressor, counted.where("train"))
        train_r2, test_score = counted_r2(model, counted.where("train")), score(model, split(rows, key)[1])
        fold_scores = [fold.result() for fold in running]
    mean = sum(fold_scores) / k if k else None
    spread = (sum((s - mean) ** 2 for s in fold_scores) / k) ** 0.5 if k else None
    row = (name, train_r2, test_score["r2"], mean, spread, test_score["mae"], test_score["rmse"])
    return model, rows.sparkSession.createDataFrame([row], METRICS)


def evaluate_linear(name: str, regressor: NormalEquations, rows: DataFrame, key: str, k: int = 5) -> tuple[LinearModel, DataFrame]:
    """As `evaluate`: one scan for the sums of products per split and fold, from which every training set is had by
    addition or subtraction, and one over the test rows for the mean absolute error."""
    fold = F.col("fold") if k else F.lit(0)
    sums = regressor.moments(folds(rows, key, k) if k else rows, {"train": in_train(key), "fold": fold})
    size = len(regressor.names(rows)) + 2

    def total(keep) -> Moments:
        return sum((m for part, m in sums.items() if keep(*part)), Moments(np.zeros((size, size))))

    whole, train = total(lambda t, f: True), total(lambda t, f: t)
    test = whole - train
    weights = train.solve()
    test_r2, test_mse = test.r2(weights)
    fold_scores = []
    for i in range(k):
        own = total(lambda t, f: f == i)
        fold_scores.append(own.r2((whole - own).solve())[0])
    model = regressor.model(train, rows)
    mae = split(rows, key)[1].agg(F.avg(F.abs(F.col("label") - model.prediction())).alias("mae")).first()["mae"]
    spread = float(np.std(fold_scores)) if k else None
    row = (name, train.r2(weights)[0], test_r2, float(np.mean(fold_scores)) if k else None, spread, mae, float(test_mse) ** 0.5)
    return model, rows.sparkSession.createDataFrame([row], METRICS)


def best_model(metrics: DataFrame) -> DataFrame:
    return metrics.orderBy(F.col("test_r2").desc(), "model").limit(1).select("model", "test_r2")


def importances(model, features: Sequence[str], spark) -> DataFrame:
    """Importance per feature of a tree model, largest first; empty for other models."""
    if not hasattr(model, "featureImportances"):
        return spark.createDataFrame([], "feature string, importance double")
    rows = [(f, float(v)) for f, v in zip(features, model.featureImportances.toArray())]
    return spark.createDataFrame(rows, "feature string, importance double").orderBy(F.col("importance").desc())


def predict(model, encoder_: Encoder, df: DataFrame, name: str = "predicted") -> DataFrame:
    """Predictions for a table; missing features read as "Unknown", negative predictions become 0."""
    filled = df.na.fill("Unknown", encoder_.features)
    rows = model.transform(encoder_.transform(filled))
    drop = ["features", "prediction", *[f"{f}_enc" for f in encoder_.features]]
    return rows.withColumn(name, F.greatest(F.col("prediction"), F.lit(0.0))).drop(*drop)


