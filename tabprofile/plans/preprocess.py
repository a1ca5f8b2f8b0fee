"""Fold-safe preprocessing: everything learned comes from the training rows handed to ``fit``.

Numeric columns are filled and scaled by literals learned in one or two aggregations.  Target-encoded
columns join a table of category statistics.  Other non-numeric columns are left out.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabprofile.functions.frames import as_double, col, is_nested, is_numeric, normalise, scalars, small_or_same, type_of
from tabprofile.functions.sampling import unit_hash
from tabprofile.functions.stats import exact_quantiles
from tabprofile.operators.steps import modes
from tabprofile.plans.spec import FeatureStep, settings
from tabprofile.session import materialise

ENCODING_FOLDS = 5
SCALERS = ("standard", "minmax", "robust")


@dataclass(frozen=True)
class NumericRule:
    """``(value - center) / spread`` with gaps filled before (``fill``) or after by zero."""

    column: str
    fill: float | None = None
    center: float = 0.0
    spread: float = 1.0

    def expression(self, value: Column) -> Column:
        if self.fill is not None:
            value = F.coalesce(value, F.lit(float(self.fill)))
        if self.center != 0.0 or self.spread != 1.0:
            value = (value - F.lit(self.center)) / F.lit(self.spread)
        return value if self.fill is not None else F.coalesce(value, F.lit(0.0))


@dataclass(frozen=True)
class Encoding:
    """Category statistics of one column for one target class (``None``: the target itself)."""

    column: str
    label: float | None
    prior: float
    table: DataFrame
    folds: DataFrame
    fold_priors: list[float]

    @property
    def feature(self) -> str:
        return self.column if self.label is None else f"{self.column}_{self.label:g}"


def impute_literals(train: DataFrame, strategies: dict[str, str]) -> dict[str, float | None]:
    """Fill values from the training rows: mean, exact median or smallest mode."""
    of = lambda kind: [c for c, s in strategies.items() if s == kind]
    fills: dict[str, float | None] = {}
    if of("mean"):
        fills |= scalars(train, {c: F.avg(as_double(train, c)) for c in of("mean")})
    if of("median"):
        fills |= {c: q[0] for c, q in exact_quantiles(train, of("median"), [0.5]).items()}
    if of("most_frequent"):
        best = modes(train, of("most_frequent"))
        fills |= {c: float(best[c]) if c in best else None for c in of("most_frequent")}
    return fills


def scale_literals(train: DataFrame, methods: dict[str, str], values: dict[str, Column] | None = None) -> dict[str, tuple[float, float]]:
    """(center, spread) per column: population deviation, range, or median and quartile distance.

    A column without spread is only shifted.
    """
    values = values or {c: as_double(train, c) for c in methods}
    wanted = {}
    for c, method in methods.items():
        if method == "standard":
            wanted[c, "a"], wanted[c, "b"] = F.avg(values[c]), F.stddev_pop(values[c])
        elif method == "minmax":
            wanted[c, "a"], wanted[c, "b"] = F.min(values[c]), F.max(values[c]) - F.min(values[c])
        elif method != "robust":
            raise ValueError(f"unknown scaling '{method}'")
    facts = scalars(train, wanted) if wanted else {}
    robust = [c for c, m in methods.items() if m == "robust"]
    quartiles = exact_quantiles(train, robust, [0.25, 0.5, 0.75], exprs={c: values[c] for c in robust}) if robust else {}
    out = {}
    for c in methods:
        if c in quartiles:
            low, center, high = quartiles[c]
            spread = None if center is None else high - low
        else:
            center, spread = facts[c, "a"], facts[c, "b"]
        out[c] = (center or 0.0, spread or 1.0)
    return out


def _smoothed(n: Column, s: Column, q: Column, mean: Column, variance: Column) -> Column:
    """Category mean shrunk towards the overall mean by its own variance over the overall one."""
    own = F.try_divide(s, n)
    within = F.greatest(F.try_divide(q, n) - own * own, F.lit(0.0))
    weight = F.try_divide(n * variance, n * variance + within)
    return F.coalesce(weight * own + (1 - weight) * mean, mean)


def fit_encoding(train: DataFrame, column: str, target: Column, fold: Column, label: float | None = None) -> Encoding:
    """Statistics of all training rows for later rows, and of the other folds for the training rows."""
    return fit_encodings(train, column, [(target, label)], fold)[0]


def fit_encodings(train: DataFrame, column: str, targets: Sequence[tuple[Column, float | None]], fold: Column) -> list[Encoding]:
    """:func:`fit_encoding` for several (target, label) of one column, which share two passes over the rows.

    Rows collapse to (category, fold) sums; a fold's view is the total minus its own part.
    """
    means = train.agg(*[F.avg(target) for target, _ in targets]).first()
    centers = [m or 0.0 for m in means]  # shifted sums keep their digits
    shifted = train.select(
        col(column).cast("string").alias("v"), fold.alias("f"), *[(t - F.lit(c)).alias(f"y{i}") for i, ((t, _), c) in enumerate(zip(targets, centers))])
    cells = materialise(shifted.groupBy("v", "f").agg(*[a for i in range(len(targets)) for a in (  # read several times below
        F.count(f"y{i}").cast("double").alias(f"n{i}"), F.sum(f"y{i}").alias(f"s{i}"), F.sum(F.col(f"y{i}") * F.col(f"y{i}")).alias(f"q{i}"))]))
    return [
        _encoding(cells.select("v", "f", *[F.col(f"{c}{i}").alias(c) for c in "nsq"]), column, label, center)
        for i, ((_, label), center) in enumerate(zip(targets, centers))]


def _encoding(cells: DataFrame, column: str, label: float | None, center: float) -> Encoding:
    """The encoding by sums per (category, fold) of a target shifted by ``center``."""
    by_fold = {r["f"]: r for r in cells.groupBy("f").agg(*[F.sum(c).alias(c) for c in "nsq"]).collect()}
    total = {c: sum(r[c] or 0.0 for r in by_fold.values()) for c in "nsq"}

    def moments(n, s, q):
        mean = s / n if n else 0.0
        return mean, max(q / n - mean * mean, 0.0) if n else 0.0

    mean, variance = moments(*total.values())
    known = cells.where(F.col("v").isNotNull())
    whole = known.groupBy("v").agg(*[F.sum(c).alias(c) for c in "nsq"])
    table = whole.select("v", (_smoothed(F.col("n"), F.col("s"), F.col("q"), F.lit(mean), F.lit(variance)) + center).alias("e"))

    others = {f: moments(*[total[c] - (r[c] or 0.0) for c in "nsq"]) for f, r in by_fold.items()}
    pick = lambda i: F.element_at(F.create_map(*[F.lit(x) for f, m in others.items() for x in (int(f), m[i])]), F.col("f"))
    over = Window.partitionBy("v")
    rest = [F.sum(c).over(over) - F.col(c) for c in "nsq"]
    left = known.select("v", "f", *[r.alias(c) for r, c in zip(rest, "nsq")])
    folds = left.select("v", "f", (_smoothed(F.col("n"), F.col("s"), F.col("q"), pick(0), pick(1)) + center).alias("e"))
    priors = [others[f][0] + center if f in others else mean + center for f in range(ENCODING_FOLDS)]
    return Encoding(column, label, mean + center, _stored(table), _stored(folds), priors)


def _stored(table: DataFrame) -> DataFrame:
    """Computed once: a broadcast table when small, else a stored one that joins by shuffle."""
    small = small_or_same(table)
    return materialise(table) if small is table else small


def encoding_fold(key: str) -> Column:
    return F.floor(unit_hash(key, "encode") * ENCODING_FOLDS).cast("int")


@dataclass(frozen=True)
class Preprocessor:
    """What was learned from the training rows; ``transform`` never looks at other rows' values."""

    rules: list[NumericRule]
    encodings: list[Encoding] = field(default_factory=list)

    @property
    def feature_names(self) -> list[str]:
        return [r.column for r in self.rules] + [e.feature for e in self.encodings]

    @property
    def input_columns(self) -> list[str]:
        return list(dict.fromkeys([r.column for r in self.rules] + [e.column for e in self.encodings]))

    def columns(self, df: DataFrame, key: str | None = None) -> tuple[DataFrame, list[Column]]:
        """The frame joined with what the features need, and the feature expressions."""
        df = normalise(df)
        if key is not None and self.encodings:  # hashed once per row, however many encodings look it up
            df = df.withColumn("_ef", encoding_fold(key))
        fold = F.col("_ef")
        features = [r.expression(_finite(as_double(df, r.column))) for r in self.rules]
        for i, e in enumerate(self.encodings):
            value, joined = f"_v{i}", f"_e{i}"
            if key is None:
                table = e.table.select(F.col("v").alias(value), F.col("e").alias(joined))
                df = df.join(table, col(e.column).cast("string") == F.col(value), "left").drop(value)
                features.append(F.coalesce(F.col(joined), F.lit(e.prior)))
            else:
                table = e.folds.select(F.col("v").alias(value), F.col("f").alias(f"_f{i}"), F.col("e").alias(joined))
                df = df.join(table, (col(e.column).cast("string") == F.col(value)) & (fold == F.col(f"_f{i}")), "left")
                df = df.drop(value, f"_f{i}")
                prior = F.array(*[F.lit(p) for p in e.fold_priors])[fold]
                features.append(F.coalesce(F.col(joined), prior))
        return df, features

    def transform(self, df: DataFrame, output: str = "features", as_array: bool = False) -> DataFrame:
        """Add the feature vector for rows the model has not seen (batch or stream)."""
        return self._assemble(*self.columns(df), output, as_array)

    def transform_training(self, train: DataFrame, key: str, output: str = "features", as_array: bool = False) -> DataFrame:
        """Add the feature vector of the training rows; a row's own label never enters its encoding."""
        return self._assemble(*self.columns(train, key), output, as_array)

    def _assemble(self, df, features, output, as_array):
        packed = F.array(*features)
        helpers = ["_ef", *(f"_e{i}" for i in range(len(self.encodings)))] if self.encodings else []
        return df.withColumn(output, packed if as_array else array_to_vector(packed)).drop(*helpers)

    def export(self) -> dict:
        return {
            "rules": [(r.column, r.fill, r.center, r.spread) for r in self.rules],
            "encodings": [(e.column, e.label, e.prior, e.fold_priors) for e in self.encodings],
        }


def _finite(value: Column) -> Column:
    return F.when(F.abs(value) < float("inf"), value)


def fit_preprocessor(
    train: DataFrame,
    features: Sequence[str],
    target: str,
    key: str,
    steps: Sequence[FeatureStep] = (),
    classes: Sequence[float] | None = None,
) -> Preprocessor:
    """Learn the plan's fitted steps from training rows.

    ``classes`` lists the target codes of a classification; with three or more, an encoded column
    yields one feature per class.
    """
    train = normalise(train)
    numeric = [c for c in features if is_numeric(type_of(train, c))]
    texts = [c for c in features if c not in numeric and not is_nested(type_of(train, c))
             and type_of(train, c).typeName() in ("string", "char", "varchar")]
    strategies, scalings = settings(steps, "impute", numeric), settings(steps, "scale", numeric)
    encoded = [c for c, method in settings(steps, "encode", features).items() if method == "target"]
    plain = [c for c in numeric if c not in encoded]
    if not plain and not encoded:
        encoded = texts  # nothing numeric: encode the categories rather than train on nothing
        if not encoded:
            raise ValueError("no usable feature columns: nothing numeric or categorical to train on")

    fills = impute_literals(train, {c: s for c, s in strategies.items() if c in plain and s in ("mean", "median", "most_frequent")})
    empty = {c for c, f in fills.items() if f is None}  # no training value at all: nothing to learn
    plain = [c for c in plain if c not in empty]
    values = {
        c: F.coalesce(_finite(as_double(train, c)), F.lit(float(fills[c]))) if c in fills else _finite(as_double(train, c))
        for c in plain
    }
    scales = scale_literals(train, {c: scalings[c] for c in plain if c in scalings}, values)
    rules = [NumericRule(c, fills.get(c), *scales.get(c, (0.0, 1.0))) for c in plain]

    encodings = []
    many = classes is not None and len(classes) > 2
    for c in encoded:
        fold = encoding_fold(key)
        if many:
            encodings += fit_encodings(train, c, [((col(target) == F.lit(k)).cast("double"), float(k)) for k in classes], fold)
        else:
            encodings.append(fit_encoding(train, c, col(target).cast("double"), fold))
    return Preprocessor(rules, encodings)
