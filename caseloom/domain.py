"""What the case table looks like and which of its values carry a meaning."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

# --- Fixed values: spelling of the data, needed for right results -----------
MISSING_TOKENS = ("Unknown", "Missing", "NA")
CONFIRMED = "Laboratory-confirmed case"
AGE_GROUPS = ("0 - 17 years", "18 to 49 years", "50 to 64 years", "65+ years")
SEXES = ("Male", "Female")
YES, NO = "Yes", "No"
SYMPTOMATIC, ASYMPTOMATIC = "Symptomatic", "Asymptomatic"
OUTCOME_HOSPITALIZED = "Hospitalized"
OUTCOME_DEATH = "Death"
OUTCOME_ASYMPTOMATIC = "Asymptomatic"
OUTCOME_MILD = "Symptomatic, not severe"
OUTCOME_OTHER = "Other"

# --- Fixed values: the grids that are searched ------------------------------
FOLDS = 4
SPLIT_SEED = 1
MAX_ITERS = (1, 3, 10)
THRESHOLDS = (0.5, 0.45, 0.55)
MIN_INSTANCES = (1, 1000, 2000)
MAX_DEPTHS = (3, 5, 20)
KMEANS_RUNS = ((7, 1), (7, 3), (4, 1))  # (k, max_iter)
LABEL_CUTOFF = 0.5
SPINE_MONTHS = 6

# --- Fixed values: columns of the case table, and those that the analyses use ----
CASE_SCHEMA = T.StructType(
    [
        T.StructField("case_month", T.StringType()),
        T.StructField("res_state", T.StringType()),
        T.StructField("age_group", T.StringType()),
        T.StructField("sex", T.StringType()),
        T.StructField("race", T.StringType()),
        T.StructField("case_positive_specimen_interval", T.IntegerType()),
        T.StructField("case_onset_interval", T.IntegerType()),
        T.StructField("current_status", T.StringType()),
        T.StructField("symptom_status", T.StringType()),
        T.StructField("hosp_yn", T.StringType()),
        T.StructField("icu_yn", T.StringType()),
        T.StructField("death_yn", T.StringType()),
        T.StructField("underlying_conditions_yn", T.StringType()),
    ]
)

INTERVALS = ("case_positive_specimen_interval", "case_onset_interval")

# Columns without which a record does not belong to the cohort.
REQUIRED = ("case_month", "age_group", "res_state")


@dataclass(frozen=True)
class FeatureSpec:
    """A label and the categorical columns that predict it.

    ``positive`` names the label value encoded as 1. It is stated, never derived
    from frequencies, so a table with a positive majority keeps its orientation.
    """

    label: str
    features: tuple[str, ...]
    positive: str = YES

    @property
    def columns(self) -> tuple[str, ...]:
        return (*self.features, self.label)


DEATH_MODEL = FeatureSpec(
    label="death_yn",
    features=(
        "age_group",
        "sex",
        "race",
        "symptom_status",
        "underlying_conditions_yn",
        "hosp_yn",
        "icu_yn",
    ),
)

CELL_KEYS = ("age_group_index", "sex", "case_month", "res_state", "race")
CLUSTER_FEATURES = ("age_group_index", "death_count")
# -----------------------------------------------------------------------------
