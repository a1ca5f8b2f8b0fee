"""Attribution of predictions to features, for all rows or chosen ones.

A row's attributions and its base value add up to the model's output.  Linear models have a closed form and trees an exact one, both over
all rows.  Any other model is asked: along random feature orders a row's values replace those of a background row one by one, and each
change of the output is credited to the feature replaced.  The mixed rows are ordinary rows scored by the model in parallel.

Rows are kept with one array of contributions each; long tables of one row per feature are spelled out from them only where asked for.
"""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabprofile.functions.frames import col, require_columns
from tabprofile.functions.sampling import hash_sample, unit_hash
from tabprofile.operators.metrics import regression_metrics
from tabprofile.plans.training import FittedModel, Prepared
from tabprofile.plans.trees import can_flatten, tree_attributions
from tabprofile.session import materialise

BACKGROUND_ROWS = 100
TOP_FEATURES = 8
DEPENDENCE_FEATURES = 3
ORDERS = 8


def method_of(model: FittedModel) -> str:
    m = model.model
    if hasattr(m, "coefficientMatrix") or hasattr(m, "coefficients"):
        return "linear"
    return "tree" if can_flatten(m) else "sampled"


def by_row(model: FittedModel, rows: DataFrame, background: DataFrame, key: str, orders: int = ORDERS) -> DataFrame:
    """``key, contributions, base, output`` with one row per explained row; contributions are (feature, value, phi).

    Two classes: the positive class, on the log-odds scale for linear and boosted models.  More classes: mean size of phi over the
    classes, and no single output.  The background counts for linear and sampled models; trees carry their own shares of training rows.
    """
    require_columns(rows, [key])
    method = method_of(model)
    if method == "tree":
        found, base = tree_attributions(model.model, _features(model, rows).select(col(key).alias("key"), "x"))
        return found.select("key", _contributions(model, F.col("x"), F.col("phi")), F.lit(base).alias("base"), "output")
    return (_linear if method == "linear" else _sampled)(model, rows, background, key, orders)


def attributions(model: FittedModel, rows: DataFrame, background: DataFrame, key: str, orders: int = ORDERS) -> DataFrame:
    """``key, feature, value, phi, base, output`` with one row per explained row and feature; see :func:`by_row`."""
    return spelled_out(by_row(model, rows, background, key, orders))


def spelled_out(found: DataFrame) -> DataFrame:
    return found.select("key", F.explode("contributions").alias("e"), "base", "output").select(
        "key", "e.feature", "e.value", "e.phi", "base", "output")


def _contributions(model: FittedModel, values: Column, phis: Column) -> Column:
    names = F.array(*[F.lit(n) for n in model.preprocessor.feature_names])
    return F.zip_with(F.arrays_zip(names.alias("feature"), values.alias("value")), phis, lambda e, p: F.struct(
        e["feature"].alias("feature"), e["value"].alias("value"), p.alias("phi"))).alias("contributions")


def _features(model: FittedModel, df: DataFrame) -> DataFrame:
    return model.preprocessor.transform(df, "x", as_array=True)


def _linear(model: FittedModel, rows: DataFrame, background: DataFrame, key: str, orders: int) -> DataFrame:
    names = model.preprocessor.feature_names
    center = _features(model, background).agg(*[F.avg(F.col("x")[i]).alias(f"m{i}") for i in range(len(names))]).first()
    m = model.model
    if hasattr(m, "coefficientMatrix") and m.numClasses > 2:
        weights = [list(map(float, r)) for r in m.coefficientMatrix.toArray()]
        intercepts = [float(v) for v in m.interceptVector.toArray()]
    else:
        weights, intercepts = [[float(v) for v in m.coefficients.toArray()]], [float(m.intercept)]
    bases = [b + sum(w * c for w, c in zip(ws, center)) for ws, b in zip(weights, intercepts)]
    scored = _features(model, rows)
    entries = []
    for i, name in enumerate(names):
        shift = F.col("x")[i] - F.lit(center[i])
        phis = [F.lit(ws[i]) * shift for ws in weights]
        phi = phis[0] if len(phis) == 1 else sum((F.abs(p) for p in phis), F.lit(0.0)) / len(phis)
        entries.append(F.struct(F.lit(name).alias("feature"), F.col("x")[i].alias("value"), phi.alias("phi")))
    single = len(weights) == 1
    output = sum((F.lit(w) * F.col("x")[i] for i, w in enumerate(weights[0])), F.lit(intercepts[0])) if single else F.lit(None)
    base = F.lit(bases[0] if single else sum(bases) / len(bases))
    return scored.select(
        col(key).alias("key"), F.array(*entries).alias("contributions"), base.alias("base"), output.cast("double").alias("output"))


def _outputs(model: FittedModel, df: DataFrame) -> DataFrame:
    """Add ``f``: the explained outputs of the row's feature array ``x``."""
    scored = model.model.transform(df.withColumn("features", array_to_vector("x")))
    if model.classes is None or "probability" not in scored.columns:
        f = F.array(F.col("prediction")) if model.classes is None else F.array(*[
            (F.col("prediction") == F.lit(c)).cast("double") for c in model.classes])
    elif len(model.classes) == 2:
        f = F.array(vector_to_array("probability")[1])
    else:
        f = vector_to_array("probability")
    return scored.select(*df.columns, f.alias("f"))


def _sampled(model: FittedModel, rows: DataFrame, background: DataFrame, key: str, orders: int) -> DataFrame:
    names = model.preprocessor.feature_names
    width = len(names)
    zs = [list(map(float, r["x"])) for r in hash_sample(
        _features(model, background).select(col(key).alias("k"), "x"), "k", BACKGROUND_ROWS).collect()]
    pool = F.array(*[F.array(*[F.lit(v) for v in z]) for z in zs])
    walks = (
        _features(model, rows).select(col(key).alias("key"), "x")
        .withColumn("walk", F.explode(F.sequence(F.lit(0), F.lit(orders - 1))))
        .withColumn("tag", F.concat_ws(":", F.col("key").cast("string"), F.col("walk").cast("string")))
        .withColumn("z", pool[F.floor(unit_hash("tag", "background") * len(zs)).cast("int")])
        # a random order: features sorted by a hash of row, walk and feature
        .withColumn("order", F.transform(
            F.array_sort(F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.struct(
                F.xxhash64("tag", i).alias("h"), i.alias("i")))), lambda e: e["i"]))
    )
    steps = walks.withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(width))))
    replaced = F.slice("order", F.lit(1), F.col("step"))
    mixed = steps.withColumn("own", F.col("x")).withColumn("x", F.transform(
        F.sequence(F.lit(0), F.lit(width - 1)),
        lambda i: F.when(F.array_contains(replaced, i), F.get("own", i)).otherwise(F.get("z", i))))
    scored = _outputs(model, mixed.select("key", "walk", "step", "order", "own", "x"))
    walk = Window.partitionBy("key", "walk").orderBy("step")  # one short walk: width + 1 rows
    moved = scored.withColumn("before", F.lag("f").over(walk))
    ends = scored.groupBy("key").agg(
        F.avg(F.when(F.col("step") == 0, F.col("f")[0])).alias("base"),
        F.avg(F.when(F.col("step") == width, F.col("f")[0])).alias("output"))
    single = model.classes is None or len(model.classes) == 2
    per_class = moved.where("step > 0").select(
        "key", F.get("order", F.col("step") - 1).alias("i"), F.get("own", F.get("order", F.col("step") - 1)).alias("value"),
        F.posexplode(F.zip_with("f", "before", lambda a, b: a - b)).alias("c", "d"))
    averaged = per_class.groupBy("key", "i", "c").agg(F.avg("d").alias("phi"), F.first("value").alias("value"))
    reduced = averaged.groupBy("key", "i").agg(
        (F.sum("phi") if single else F.avg(F.abs("phi"))).alias("phi"), F.first("value").alias("value"))
    labels = F.array(*[F.lit(n) for n in names])
    entry = F.struct("i", labels[F.col("i")].alias("feature"), "value", "phi")
    gathered = reduced.groupBy("key").agg(F.array_sort(F.collect_list(entry)).alias("e"))  # one short list: a row's features
    return gathered.join(ends, "key").select(
        "key", F.transform("e", lambda e: F.struct(e["feature"].alias("feature"), e["value"].alias("value"), e["phi"].alias("phi"))).alias("contributions"),
        "base", (F.col("output") if single else F.lit(None).cast("double")).alias("output"))


def global_impact(long: DataFrame, top: int = TOP_FEATURES) -> DataFrame:
    """``feature, mean_abs, mean_signed`` of the most important features, rounded to six digits."""
    return (
        long.groupBy("feature").agg(F.avg(F.abs("phi")).alias("mean_abs"), F.avg("phi").alias("mean_signed"))
        .orderBy(F.desc("mean_abs"), "feature").limit(top)
        .select("feature", F.round("mean_abs", 6).alias("mean_abs"), F.round("mean_signed", 6).alias("mean_signed"))
    )


def row_impact(found: DataFrame, top: int = TOP_FEATURES) -> DataFrame:
    """Per row its base value and the ``top`` largest contributions, largest first, of :func:`by_row` or a long table."""
    if "contributions" not in found.columns:
        found = found.groupBy("key").agg(F.first("base").alias("base"), F.collect_list(F.struct("feature", "value", "phi")).alias("contributions"))
    ranked = F.array_sort(F.transform("contributions", lambda e: F.struct(
        (-F.abs(e["phi"])).alias("o"), e["feature"].alias("feature"), F.round(e["phi"], 6).alias("phi"))))
    return found.select("key", F.round("base", 6).alias("base"), F.transform(F.slice(ranked, 1, top), lambda e: F.struct(
        e["feature"].alias("feature"), e["phi"].alias("phi"))).alias("contributions"))


def fidelity(found: DataFrame, model: FittedModel) -> float | None:
    """R squared between the model's output and base + attributions; none for several classes.

    Where probabilities are explained on the log-odds scale the sum is brought back first.
    """
    if model.classes is not None and len(model.classes) != 2:
        return None
    if "contributions" in found.columns:
        phi = F.aggregate("contributions", F.lit(0.0), lambda s, e: s + e["phi"])
        sums = found.select((F.col("base") + phi).alias("prediction"), F.col("output").alias("label"))
    else:
        sums = found.groupBy("key").agg((F.first("base") + F.sum("phi")).alias("prediction"), F.first("output").alias("label"))
    if model.classes is not None and (method_of(model) == "linear" or type(model.model).__name__.startswith("GBT")):
        squash = lambda c: 1 / (1 + F.exp(-F.col(c)))
        sums = sums.select(squash("prediction").alias("prediction"), squash("label").alias("label"))
    return regression_metrics(sums).first()["r2"]


def explain_model(model: FittedModel, prepared: Prepared, rows: int | None = None) -> dict:
    """The global picture of a model; a model that cannot be explained says so instead of failing.

    Linear and tree models are explained over all rows unless ``rows`` asks for a sample; models that have to be asked over
    :data:`BACKGROUND_ROWS`, as each row costs them many predictions.  ``points`` is spelled out from the stored rows when it is read.
    """
    try:
        method = method_of(model)
        if method == "sampled" and rows is None:
            rows = BACKGROUND_ROWS
        some = prepared.data if rows is None else hash_sample(prepared.data, prepared.key, rows, "explain")
        found = materialise(by_row(model, some, prepared.data if method == "linear" else some, prepared.key))
        return {"method": method, "impact": global_impact(spelled_out(found)), "fidelity": fidelity(found, model), "points": spelled_out(found),
                "rows": found, "note": None}
    except Exception as problem:
        return {"method": "unavailable", "impact": None, "fidelity": None, "points": None, "rows": None,
                "note": f"explanation unavailable for this model: {problem}"}


def dependence_points(long: DataFrame, features: int = DEPENDENCE_FEATURES) -> DataFrame:
    """``feature, value, phi`` of the features with the largest mean effect."""
    top = long.groupBy("feature").agg(F.avg(F.abs("phi")).alias("m")).orderBy(F.desc("m"), "feature").limit(features)
    return long.join(F.broadcast(top.select("feature")), "feature").select("key", "feature", "value", "phi")


def local_example(model: FittedModel, prepared: Prepared, seed: int = 0) -> DataFrame:
    """One held-out row chosen by seed: actual, predicted, contributions, base and the test size."""
    key = prepared.key
    size = prepared.test.agg(F.count(F.lit(1))).scalar()
    chosen = materialise(prepared.test.orderBy(unit_hash(key, f"{seed}-"), col(key)).limit(1))
    scored = model.score_codes(chosen).select(col(key).alias("key"), F.col("label").alias("actual"), "prediction")
    impact = row_impact(by_row(model, chosen, prepared.train, key))
    return scored.join(impact, "key").select("key", "actual", "prediction", "base", "contributions", size.alias("test_size"))
