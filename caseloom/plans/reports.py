"""Counts, shares and trends. Each takes the cohort, or a tally of it with ``weight``."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseloom import domain as D
from caseloom import functions as X
from caseloom.operators import aggregate as A
from caseloom.operators import shares as S
from caseloom.operators.clean import complete_cases
from caseloom.operators.correlate import correlation_codes, correlation_matrix
from caseloom.sources.cases import cache_table
from caseloom.sources.sinks import write_stage

# Every categorical column that a report below reads.
REPORT_COLUMNS = (
    "case_month",
    "res_state",
    "age_group",
    "sex",
    "race",
    "symptom_status",
    "hosp_yn",
    "icu_yn",
    "death_yn",
    "underlying_conditions_yn",
)


# The reports that are counts over few keys, and their keys.
REPORT_SETS = {
    "age": ("age_group",),
    "race": ("race",),
    "sex": ("sex",),
    "age_sex": ("age_group", "sex"),
    "state_month": ("res_state", "case_month"),
    "outcome": ("age_group", "sex", "outcome"),
    "stay": ("age_group", "death_yn", "hosp_yn"),
}
REPORT_KEYS = ("age_group", "race", "sex", "res_state", "case_month", "outcome", "death_yn", "hosp_yn")

CORRELATED = ("age_group", "hosp_yn", "death_yn", "symptom_status", "underlying_conditions_yn")


def cohort_tally(cohort: DataFrame) -> DataFrame:
    """One scan of the cohort for all reports: its distinct rows over
    ``REPORT_COLUMNS`` with their number in ``rows``, written to the shared folder.
    Hand the result to a report with ``weight="rows"``."""
    return write_stage(A.tally(cohort, REPORT_COLUMNS), "tally")


def cases_by_age(cohort: DataFrame, weight: str | None = None) -> DataFrame:
    """Cases per age group with the rank of the group, last group first."""
    counts = A.count_by(cohort, ["age_group"], weight=weight)
    ranked = counts.withColumn("age_rank", X.ordinal("age_group", D.AGE_GROUPS))
    return ranked.orderBy(F.desc("age_group"))


def cases_by_age_in_order(cohort: DataFrame, weight: str | None = None) -> DataFrame:
    """The same from the youngest group to the oldest, unknown labels last."""
    return cases_by_age(cohort, weight).orderBy(F.asc_nulls_last("age_rank"), "age_group")


def icu_by_age(cohort: DataFrame, weight: str | None = None) -> DataFrame:
    """Cases and ICU admissions per age group, largest group first."""
    counts = A.count_and_flag(cohort, ["age_group"], X.yes_flag("icu_yn"), weight=weight)
    return counts.orderBy(F.desc("case_count"), "age_group")


def monthly_state(cohort: DataFrame, state: str, weight: str | None = None) -> DataFrame:
    return A.count_by_month(cohort.filter(F.col("res_state") == state), weight=weight)


def state_spine(cohort: DataFrame, state: str) -> DataFrame:
    return A.month_spine(cohort.filter(F.col("res_state") == state))


def outcome_known() -> Column:
    """Whether sex, hospital stay, death and symptoms have one of the known values."""
    return (
        X.one_of("sex", D.SEXES)
        & X.one_of("hosp_yn", (D.YES, D.NO))
        & X.one_of("death_yn", (D.YES, D.NO))
        & X.one_of("symptom_status", (D.SYMPTOMATIC, D.ASYMPTOMATIC))
    )


def outcome_rows(cohort: DataFrame) -> DataFrame:
    """Cases whose sex, hospital stay, death and symptoms are known, with an outcome
    other than "Other"."""
    known = cohort.filter(outcome_known())
    return known.withColumn("outcome", X.classify_outcome()).filter(F.col("outcome") != D.OUTCOME_OTHER)


def outcome_share(cohort: DataFrame, weight: str | None = None) -> DataFrame:
    """Outcomes per age group and sex: count, percent, and share of the full bar. The
    share is taken from the counts, whose sum does not depend on the order of rows."""
    return outcome_shares(A.count_by(outcome_rows(cohort), ["age_group", "sex", "outcome"], "count", weight))


def outcome_shares(counts: DataFrame) -> DataFrame:
    """The same from counts per age group, sex and outcome."""
    percent = S.share_within(counts, ["age_group", "sex"], "count")
    return S.share_within(percent, ["age_group", "sex"], "count", "share", 1.0)


def share_of_cases(cohort: DataFrame, column: str, weight: str | None = None) -> DataFrame:
    """Cases per value of a column with the share in all, NULL being a value."""
    return S.share_of_total(A.count_by(cohort, [column], "count", weight), "count")


def cases_by_age_sex(cohort: DataFrame, weight: str | None = None) -> DataFrame:
    return A.count_by(cohort, ["age_group", "sex"], "count", weight)


def outcome_contingency(cohort: DataFrame, weight: str | None = None) -> DataFrame:
    """Age group by death by hospital stay."""
    return S.contingency(cohort, "age_group", "death_yn", "hosp_yn", weight=weight)


def interval_description(cohort: DataFrame) -> DataFrame:
    return A.describe_numeric(A.valid_intervals(cohort), D.INTERVALS)


def correlation(cohort: DataFrame, weight: str | None = None) -> DataFrame:
    """Correlations of the coded columns. The five columns are categories, so their
    distinct rows are counted first and the moments come from a few hundred rows."""
    kinds = A.tally(cohort, CORRELATED, "rows", weight)
    return correlation_matrix(correlation_codes(kinds, ["rows"]), weight="rows", centre=False)


def model_rows(cohort: DataFrame) -> DataFrame:
    """The complete cases the classifiers are trained on."""
    return complete_cases(cohort, D.DEATH_MODEL.columns)


def report_counts(cohort: DataFrame, weight: str | None = None) -> DataFrame:
    """The counts behind the reports from one scan: ``report`` (a name in ``REPORT_SETS``), all
    ``REPORT_KEYS`` (NULL where the report does not ask for them), ``rows`` and ``icu_rows``.

    The outcome of a case is worked out before the counting; it is NULL where the rules leave
    the case out. A key that is asked for may be NULL as well; the report's name tells these apart.
    """
    outcome = F.when(outcome_known(), F.nullif(X.classify_outcome(), F.lit(D.OUTCOME_OTHER)))
    asked = [outcome.alias(c) if c == "outcome" else F.col(c) for c in REPORT_KEYS]
    flag = X.yes_flag("icu_yn")
    extra = [] if weight is None else [F.col(weight)]
    rows = cohort.select(*asked, flag.alias("icu"), *extra)
    icu = F.col("icu") if weight is None else F.col("icu") * F.col(weight)
    sets = [[F.col(c) for c in keys] for keys in REPORT_SETS.values()]
    counted = rows.groupingSets(sets, *[F.col(c) for c in REPORT_KEYS]).agg(
        F.grouping_id(*REPORT_KEYS).alias("set"), A.row_count(weight).alias("rows"), F.sum(icu).cast("bigint").alias("icu_rows")
    )
    name = F.lit(None)
    for report, keys in REPORT_SETS.items():
        # A bit per key, the first key highest, set where the key is summed over.
        bits = sum(1 << i for i, c in enumerate(reversed(REPORT_KEYS)) if c not in keys)
        name = F.when(F.col("set") == bits, report).otherwise(name)
    return counted.select(name.alias("report"), *REPORT_KEYS, "rows", "icu_rows")


@dataclass(frozen=True)
class ReportSet:
    """All counting reports from one scan of the cohort. The counts are a few thousand rows and
    stay cached until :meth:`close`; every report gives what its function gives for the rows."""

    counts: DataFrame

    @classmethod
    def of(cls, cohort: DataFrame, weight: str | None = None) -> ReportSet:
        return cls(cache_table(report_counts(cohort, weight)))

    def close(self) -> None:
        self.counts.unpersist()

    def __enter__(self) -> ReportSet:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def part(self, report: str) -> DataFrame:
        """The counts of one report, with its keys only."""
        return self.counts.filter(F.col("report") == report).select(*REPORT_SETS[report], "rows", "icu_rows")

    def cases_by_age(self) -> DataFrame:
        return cases_by_age(self.part("age"), "rows")

    def cases_by_age_in_order(self) -> DataFrame:
        return cases_by_age_in_order(self.part("age"), "rows")

    def icu_by_age(self) -> DataFrame:
        counts = self.part("age").select("age_group", F.col("rows").alias("case_count"), F.col("icu_rows").alias("icu_count"))
        return counts.orderBy(F.desc("case_count"), "age_group")

    def share_of_cases(self, column: str) -> DataFrame:
        """``race`` or ``sex``: the columns that are a report of their own."""
        return share_of_cases(self.part(column), column, "rows")

    def cases_by_age_sex(self) -> DataFrame:
        return cases_by_age_sex(self.part("age_sex"), "rows")

    def monthly_state(self, state: str) -> DataFrame:
        return monthly_state(self.part("state_month"), state, "rows")

    def state_spine(self, state: str) -> DataFrame:
        return state_spine(self.part("state_month"), state)

    def date_range(self) -> DataFrame:
        return A.date_range(self.part("state_month"), X.month_start("case_month"))

    def outcome_share(self) -> DataFrame:
        known = self.part("outcome").filter(F.col("outcome").isNotNull())
        return outcome_shares(known.select("age_group", "sex", "outcome", F.col("rows").alias("count")))

    def contingency(self) -> DataFrame:
        return outcome_contingency(self.part("stay"), "rows")
