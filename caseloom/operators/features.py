"""From categorical columns to a feature vector and a 0/1 label."""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.ml.feature import OneHotEncoder, StringIndexerModel, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseloom import functions as X
from caseloom.domain import FeatureSpec
from caseloom.operators.aggregate import tally
from caseloom.operators.clean import complete_cases

MAX_LEVELS = 10_000


@dataclass(frozen=True)
class Encoder:
    """Levels of every feature and the fitted stages that turn them into a vector."""

    spec: FeatureSpec
    levels: dict[str, list[str]]
    stages: PipelineModel

    def transform(self, df: DataFrame, levels: str | None = None) -> DataFrame:
        """Add ``features`` and, where the label column is present, ``label``. With ``levels``, an
        array of that name has the number of the level of each feature."""
        coded = self.stages.transform(df)
        if levels is not None:
            numbers = [F.col(f"{c}_index").cast("int") for c in self.spec.features]
            coded = coded.withColumn(levels, F.array(*numbers))
        coded = coded.drop(*[f"{c}_{s}" for c in self.spec.features for s in ("index", "slots")])
        if self.spec.label not in df.columns:
            return coded
        label = F.when(F.col(self.spec.label) == self.spec.positive, 1.0).when(
            F.col(self.spec.label).isNotNull(), 0.0
        )
        return coded.withColumn("label", label)


    @property
    def slots(self) -> list[tuple[int, int]]:
        """Which feature and which of its levels each place of the vector stands for."""
        return [(i, k) for i, c in enumerate(self.spec.features) for k in range(len(self.levels[c]) - 1)]

    def by_level(self, coefficients: Sequence[float]) -> list[list[float]]:
        """Coefficients of the vector as one list per feature; the last level has 0."""
        parts, at = [], 0
        for c in self.spec.features:
            n = len(self.levels[c]) - 1
            parts.append([*map(float, coefficients[at : at + n]), 0.0])
            at += n
        return parts


def feature_kinds(df: DataFrame, spec: FeatureSpec) -> DataFrame:
    """Distinct complete rows of label and features with their number in ``rows``."""
    return tally(complete_cases(df, spec.columns), spec.columns)


def level_counts(kinds: DataFrame, spec: FeatureSpec, rows: str = "rows") -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("level")) for c in spec.features])
    return kinds.select(F.inline(pairs), rows).groupBy("feature", "level").agg(F.sum(rows).alias(rows))


def fit_encoder(kinds: DataFrame, spec: FeatureSpec, rows: str = "rows", max_levels: int = MAX_LEVELS) -> Encoder:
    """Index levels by falling frequency (text order between equals) and one-hot code
    them without the last one.

    Levels come from the whole table, so every fold has the same vector and meets no
    unknown level. The level names are part of the model and live on the driver; more
    than ``max_levels`` of any feature are refused, never cut.
    """
    counted = level_counts(kinds, spec, rows)
    bound = max_levels * len(spec.features)
    found = counted.limit(bound + 1).collect()
    many = Counter(r["feature"] for r in found)
    wide = [c for c, n in many.items() if n > max_levels]
    if wide:
        raise ValueError(f"more than {max_levels} levels of {', '.join(wide)}: these columns are not categories")
    ranked = sorted(found, key=lambda r: (-r[rows], r["level"]))
    levels = {c: [r["level"] for r in ranked if r["feature"] == c] for c in spec.features}
    index = [f"{c}_index" for c in spec.features]
    slots = [f"{c}_slots" for c in spec.features]
    indexers = PipelineModel(
        [
            StringIndexerModel.from_labels(levels[c], inputCol=c, outputCol=i, handleInvalid="error")
            for c, i in zip(spec.features, index, strict=True)
        ]
    )
    # The indexers state the number of levels in the column metadata; fitting the
    # one-hot stage reads that and no rows.
    onehot = OneHotEncoder(inputCols=index, outputCols=slots, dropLast=True).fit(indexers.transform(kinds))
    vector = VectorAssembler(inputCols=slots, outputCol="features")
    return Encoder(spec, levels, PipelineModel([indexers, onehot, vector]))


def encode_features(df: DataFrame, spec: FeatureSpec) -> tuple[DataFrame, Encoder]:
    """Row-level form: the complete cases of ``df`` with ``features`` and ``label``."""
    rows = complete_cases(df, spec.columns)
    encoder = fit_encoder(tally(rows, spec.columns), spec)
    return encoder.transform(rows), encoder
