"""ANSI SQL (DuckDB dialect) for every query that SQL can express.

Left out: predictions and centers of models that a solver stops early (``fit_logistic``,
``fit_svc``, ``fit_tree``, ``fit_kmeans``, ``kmeans_profiles``) and the grid over them
(``grid_summary``, ``grid_best``). What
must hold of fitted models is checked by the ``fit_*`` and ``kmeans_*`` queries named below.
"""

from __future__ import annotations

from caseloom import domain as D
from caseloom.plans.reports import REPORT_COLUMNS, REPORT_KEYS, REPORT_SETS
from registry.fixture import CASES_SQL, CLEAN_SQL, STATE, TEXT_COLUMNS, WITH_COHORT
from registry.queries import CENTERS, DIGITS, TOP

AGE_CODE = (
    "case age_group when '0 - 17 years' then {0} when '18 to 49 years' then {1} "
    "when '50 to 64 years' then {2} when '65+ years' then {3} end"
)
AGE_1 = f"cast({AGE_CODE.format(1, 2, 3, 4)} as double)"
AGE_0 = f"cast({AGE_CODE.format(0, 1, 2, 3)} as double)"


def _yes_no(column: str, yes: str = "Yes", no: str = "No") -> str:
    return f"cast(case {column} when '{yes}' then 1 when '{no}' then 0 end as double)"


def _round(expression: str, name: str) -> str:
    return f"round({expression}, {DIGITS}) as {name}"


def _count(column: str, name: str = "count") -> str:
    return f"{WITH_COHORT} select {column}, count(*) as {name} from cohort group by {column}"


def _share(column: str) -> str:
    return (
        f"{WITH_COHORT} select {column}, count(*) as count, "
        f"{_round('cast(count(*) as double) / (select count(*) from cohort)', 'share')} "
        f"from cohort group by {column}"
    )


RAW_COLUMNS = ", ".join(
    (*[c for c in TEXT_COLUMNS], "case_positive_specimen_interval", "case_onset_interval")
)

OUTCOMES = """
known as (
select * from cohort where sex in ('Male','Female') and hosp_yn in ('Yes','No') and death_yn in ('Yes','No')
  and symptom_status in ('Symptomatic','Asymptomatic')
),
outcomes as (
select * from (
 select *, case
  when hosp_yn = 'Yes' and death_yn = 'No' then 'Hospitalized'
  when death_yn = 'Yes' then 'Death'
  when symptom_status = 'Asymptomatic' then 'Asymptomatic'
  when icu_yn = 'No' then 'Symptomatic, not severe'
  else 'Other' end as outcome
 from known) where outcome <> 'Other'
)"""

OUTCOME_SHARE = f"""{WITH_COHORT}, {OUTCOMES},
counted as (select age_group, sex, outcome, count(*) as n from outcomes group by age_group, sex, outcome),
summed as (select age_group, sex, count(*) as total from outcomes group by age_group, sex)
select c.age_group, c.sex, c.outcome, c.n as count,
 {_round("cast(c.n as double) / s.total * 100", "percent")},
 {_round("cast(c.n as double) / s.total", "share")}
from counted c join summed s on c.age_group = s.age_group and c.sex = s.sex"""

MODEL_COLUMNS = ", ".join(D.DEATH_MODEL.columns)
MODEL = f"""{WITH_COHORT},
model as (
select {MODEL_COLUMNS} from cohort
where {" and ".join(f"{c} is not null" for c in D.DEATH_MODEL.columns)}
)"""

# Rows are numbered within their kind one by one; the number and the kind's offset
# decide the fold.
FOLDS = f"""{MODEL},
numbered as (
select *, row_number() over (partition by {MODEL_COLUMNS}) - 1 as place,
 cast('0x' || substring(md5(concat_ws('|', {MODEL_COLUMNS})), 1, 8) as bigint) % {D.FOLDS} as start
from model
),
folded as (select *, cast((place + start) % {D.FOLDS} as int) as fold from numbered)"""

KINDS_IN_FOLD = f"select {MODEL_COLUMNS}, count(*) as rows from folded where fold = {{}} group by {MODEL_COLUMNS}"

CELLS = f"""{WITH_COHORT},
cells as (
select age_group_index, sex, case_month, res_state, race,
 cast(sum(case death_yn when 'Yes' then 1 else 0 end) as bigint) as death_count
from (select *, {AGE_0} as age_group_index from cohort)
where age_group_index is not null and sex is not null and race is not null and death_yn is not null
group by age_group_index, sex, case_month, res_state, race
)"""

_POINTS = ", ".join(f"({i}, {float(a)}, {float(b)})" for i, (a, b) in enumerate(CENTERS))
NEAREST = f"""{CELLS},
points(i, a, b) as (values {_POINTS}),
paired as (
select c.*, p.i, row_number() over (
  partition by c.age_group_index, c.sex, c.case_month, c.res_state, c.race
  order by (c.age_group_index - p.a) ** 2 + (c.death_count - p.b) ** 2, p.i) as place
from cells c cross join points p
),
assigned as (
select age_group_index, sex, case_month, res_state, race, death_count, cast(i as int) as cluster
from paired where place = 1
)"""


def _pairs(keys: str) -> str:
    """Confusion counts with the hospital stay as prediction of death."""
    grouped = f"group by {keys}" if keys else ""
    chosen = f"{keys}," if keys else ""
    return f"""{WITH_COHORT},
foldable as (select *, case_id % {D.FOLDS} as fold from cohort),
matrix as (
select {chosen}
 count(*) filter (where death_yn = 'No' and hosp_yn = 'No') as tn,
 count(*) filter (where death_yn = 'Yes' and hosp_yn = 'No') as fn,
 count(*) filter (where death_yn = 'No' and hosp_yn = 'Yes') as fp,
 count(*) filter (where death_yn = 'Yes' and hosp_yn = 'Yes') as tp
from foldable {grouped}
)"""


ACCURACY = "(tn + tp)::double / (tn + fn + fp + tp)"
PRECISION = "case when tp + fp = 0 then 'nan'::double else tp::double / (tp + fp) end"
RECALL = "case when tp + fn = 0 then 'nan'::double else tp::double / (tp + fn) end"
# 2 / (1/p + 1/r) = 2 tp / (2 tp + fp + fn) wherever both exist
F1 = (
    "case when tp + fp = 0 or tp + fn = 0 then 'nan'::double "
    "else 2.0::double * tp / (2 * tp + fp + fn) end"
)
NO_PRECISION = "case when tn + fn = 0 then 0 else tn::double / (tn + fn) end"
NO_RECALL = "case when tn + fp = 0 then 0 else tn::double / (tn + fp) end"
YES_PRECISION = "case when tp + fp = 0 then 0 else tp::double / (tp + fp) end"
YES_RECALL = "case when tp + fn = 0 then 0 else tp::double / (tp + fn) end"
YES_F1 = "case when tp = 0 then 0 else 2.0::double * tp / (2 * tp + fp + fn) end"
NO_F1 = "case when tn = 0 then 0 else 2.0::double * tn / (2 * tn + fp + fn) end"


def _both(yes: str, no: str) -> str:
    return f"(({yes}) * (tp + fn) + ({no}) * (tn + fp))::double / (tn + fn + fp + tp)"


STATE_MEANS = f"""{_pairs("res_state, fold")},
scored as (
select res_state, {ACCURACY} as accuracy, {PRECISION} as precision, {RECALL} as recall, {F1} as f1 from matrix
),
means as (
select res_state, {_round("avg(accuracy)", "accuracy")}, {_round("avg(precision)", "precision")},
 {_round("avg(recall)", "recall")}, {_round("avg(f1)", "f1")} from scored group by res_state
)"""


def _slots() -> str:
    """Feature vector as a string of digits: levels by falling count, last one left out."""
    ranks, joins, texts = [], [], []
    for c in D.DEATH_MODEL.features:
        ranks.append(
            f"rank_{c} as (select {c} as level, row_number() over (order by count(*) desc, {c}) - 1 as i, "
            f"count(*) over () as n from model group by {c})"
        )
        joins.append(f"join rank_{c} on model.{c} = rank_{c}.level")
        texts.append(
            f"case when rank_{c}.i = rank_{c}.n - 1 then repeat('0', rank_{c}.n - 1) "
            f"else repeat('0', rank_{c}.i) || '1' || repeat('0', rank_{c}.n - 2 - rank_{c}.i) end"
        )
    columns = ", ".join(f"model.{c}" for c in D.DEATH_MODEL.columns)
    return f"""{MODEL}, {", ".join(ranks)}
select {columns}, case model.death_yn when 'Yes' then 1.0::double else 0.0::double end as label,
 {" || ".join(texts)} as slots
from model {" ".join(joins)}"""


def _drawn() -> str:
    """Random folds from counts: of n equal rows, how many are drawn into each fold. Binomial
    probabilities are written out in full here and summed until they exceed the kind's number."""
    parts = ["kinds as (select *, count(*) as n from model group by all)"]
    left = "n"
    for i in range(D.FOLDS - 1):
        p = f"(1.0::double / {D.FOLDS - i})"
        text = f"concat_ws('|', '{D.SPLIT_SEED}', '{i}', {MODEL_COLUMNS})"
        u = f"(cast('0x' || substring(md5({text}), 1, 13) as bigint) / 4503599627370496.0::double)"
        source = "kinds" if i == 0 else f"dealt_{i - 1}"
        parts.append(
            f"steps_{i} as (select t.*, {u} as u, k, sum(exp(lgamma({left} + 1) - lgamma(k + 1) - lgamma({left} - k + 1)"
            f" + k * ln({p}) + ({left} - k) * ln(1 - {p}))) over (partition by {MODEL_COLUMNS} order by k) as below"
            f" from {source} t, unnest(generate_series(0, {left})) as g(k))"
        )
        kept = "".join(f", any_value(fold_{j}) as fold_{j}" for j in range(i))
        before = f", any_value(left_{i - 1}) as was" if i else ", any_value(n) as was"
        parts.append(
            f"dealt_{i} as (select *, was - fold_{i} as left_{i} from (select {MODEL_COLUMNS}{kept}{before},"
            f" coalesce(min(k) filter (where u < below), max(k)) as fold_{i} from steps_{i} group by {MODEL_COLUMNS}))"
        )
        left = f"left_{i}"
    last = D.FOLDS - 1
    sums = " union all ".join(
        f"select {j} as fold, sum({c}) as n, sum(case death_yn when 'Yes' then {c} else 0 end) as deaths from dealt_{last - 1}"
        for j, c in enumerate([*[f"fold_{j}" for j in range(last)], f"left_{last - 1}"])
    )
    whole = "select cast(fold as int) as fold, cast(n as bigint) as n, cast(deaths as bigint) as deaths"
    return f"{MODEL}, {', '.join(parts)}, drawn as ({whole} from ({sums}))"


OUTCOME_OR_NULL = """case when sex in ('Male','Female') and hosp_yn in ('Yes','No') and death_yn in ('Yes','No')
  and symptom_status in ('Symptomatic','Asymptomatic') then case
  when hosp_yn = 'Yes' and death_yn = 'No' then 'Hospitalized'
  when death_yn = 'Yes' then 'Death'
  when symptom_status = 'Asymptomatic' then 'Asymptomatic'
  when icu_yn = 'No' then 'Symptomatic, not severe' end end"""


def _report_counts() -> str:
    selects = []
    for report, keys in REPORT_SETS.items():
        columns = ", ".join(c if c in keys else f"null::varchar as {c}" for c in REPORT_KEYS)
        selects.append(
            f"select '{report}' as report, {columns}, count(*) as rows, cast(sum(icu) as bigint) as icu_rows"
            f" from keyed group by {', '.join(keys)}"
        )
    return (
        f"{WITH_COHORT}, keyed as (select *, {OUTCOME_OR_NULL} as outcome,"
        f" case icu_yn when 'Yes' then 1 when 'No' then 0 end as icu from cohort) " + " union all ".join(selects)
    )


def _gains() -> str:
    """Every level of every feature against the others, with Gini gain; the rarest level of a
    feature (the last in text order among equals) has no slot of its own."""
    levels = " union all ".join(
        f"select '{c}' as feature, {c} as level, count(*) as in_rows, count(*) filter (where death_yn = 'Yes') as in_positive"
        f" from model group by {c}"
        for c in D.DEATH_MODEL.features
    )
    gini = "(2.0::double * ({d}) * (({n}) - ({d})) / ({n}))"
    gain = (
        f"({gini.format(n='n', d='d')} - case when in_rows = 0 then 0 else {gini.format(n='in_rows', d='in_positive')} end"
        f" - case when out_rows = 0 then 0 else {gini.format(n='out_rows', d='out_positive')} end) / n"
    )
    return f"""{MODEL},
levels as ({levels}),
whole as (select count(*) as n, count(*) filter (where death_yn = 'Yes') as d from model),
sides as (select *, n - in_rows as out_rows, d - in_positive as out_positive,
 row_number() over (partition by feature order by in_rows, level desc) = 1 as last from levels, whole),
gains as (select *, {gain} as gain from sides)"""


def _first_split(least: int) -> str:
    return (
        f"(select cast({least} as int) as min_instances, feature, level, in_rows as in_cases, in_positive as in_deaths,"
        f" out_rows as out_cases, out_positive as out_deaths from gains"
        f" where not last and in_rows >= {least} and out_rows >= {least} order by gain desc limit 1)"
    )


def _position(report: str, level: str, order: str, by: str) -> str:
    return (
        f"select '{report}' as report, {level} as level, count(*) as case_count,"
        f" row_number() over (order by {order}) as position from cohort group by {by}"
    )


REPORT_ORDER = f"{WITH_COHORT} " + " union all ".join(
    (
        _position("months", "case_month", "case_month", "case_month"),
        _position("ages_down", "age_group", "age_group desc", "age_group"),
        _position("ages_by_cases", "age_group", "count(*) desc, age_group", "age_group"),
        _position("ages_up", "age_group", f"{AGE_1} nulls last, age_group", "age_group"),
    )
)


def _describe(column: str) -> str:
    return (
        f"select '{column}' as \"column\", count({column}) as \"count\", {_round(f'avg({column})', 'mean')}, "
        f"{_round(f'stddev_samp({column})', 'stddev')}, cast(min({column}) as double) as \"min\", "
        f'cast(max({column}) as double) as "max" from valid'
    )


CODES = {
    "age_group_index": AGE_1,
    "hosp_yn_index": _yes_no("hosp_yn"),
    "death_yn_index": _yes_no("death_yn"),
    "symptom_status_index": _yes_no("symptom_status", "Symptomatic", "Asymptomatic"),
    "underlying_conditions_yn_index": _yes_no("underlying_conditions_yn"),
}

CORRELATION = f"""{WITH_COHORT},
coded as (select {", ".join(f"{e} as {n}" for n, e in CODES.items())} from cohort),
whole as (select * from coded where {" and ".join(f"{n} is not null" for n in CODES)})
""" + " union all ".join(
    f"select '{a}' as x, '{b}' as y, {_round(f'corr({a}, {b})', 'r')} from whole"
    for a in CODES
    for b in CODES
    if a != b
) + "".join(f" union all select '{a}', '{a}', 1.0::double" for a in CODES)


def _grid_rows() -> str:
    rows = [
        f"('{family}', {m}, {t}::double, null::int, null::int)"
        for family in ("logistic", "svc")
        for m in D.MAX_ITERS
        for t in D.THRESHOLDS
    ]
    rows += [f"('tree', null, null, {m}, {d})" for m in D.MIN_INSTANCES for d in D.MAX_DEPTHS]
    return ", ".join(rows)


CONTINGENCY = f"""{WITH_COHORT},
whole as (select age_group, death_yn, hosp_yn from cohort where death_yn is not null and hosp_yn is not null),
counted as (select age_group, death_yn, hosp_yn, count(*) as n from whole group by all),
summed as (select age_group, death_yn, count(*) as total from whole group by all)
select c.age_group, c.death_yn, c.hosp_yn, c.n as rows,
 {_round("cast(c.n as double) / (select count(*) from whole)", "share_total")},
 {_round("cast(c.n as double) / s.total", "share_fill")}
from counted c join summed s on c.age_group = s.age_group and c.death_yn = s.death_yn"""

ICU_BY_AGE = f"""{WITH_COHORT} select age_group, count(*) as case_count,
 cast(sum(case icu_yn when 'Yes' then 1 when 'No' then 0 end) as bigint) as icu_count
from cohort group by age_group order by case_count desc"""

MONTHLY_STATE = f"""{WITH_COHORT} select case_month, case_month || '-01' as month_start, count(*) as case_count
from cohort where res_state = '{STATE}' group by case_month order by case_month"""

TOPN = f"{WITH_COHORT} select case_id, case_month, res_state from cohort order by case_month, case_id limit {TOP}"

FOLD_PROPERTIES = "select true as same_elsewhere, true as within_five_deviations, true as together_all_rows"

ORACLES: dict[str, str] = {
    "case_table": f"with {CASES_SQL} select * from cases",
    "src_csv_roundtrip": f"with {CASES_SQL} select {RAW_COLUMNS} from cases",
    "src_parquet_roundtrip": f"{WITH_COHORT} select {RAW_COLUMNS} from cohort",
    "flagship": OUTCOME_SHARE,
    "clean_tokens": f"with {CASES_SQL}, {CLEAN_SQL} select * from clean",
    "cohort_count": f"{WITH_COHORT} select count(*) as cohort_rows from cohort",
    "complete_cases": f"{MODEL} select * from model",
    "encode_ordinal": f"with {CASES_SQL}, {CLEAN_SQL} select case_id, {AGE_1} as age_from_1, {AGE_0} as age_from_0 from clean",
    "encode_binary": f"""with {CASES_SQL}, {CLEAN_SQL} select case_id,
 {", ".join(f"{e} as {n}" for n, e in CODES.items() if n != "age_group_index")},
 case icu_yn when 'Yes' then 1 when 'No' then 0 end as icu_flag from clean""",
    "outcome_rows": f"{WITH_COHORT}, {OUTCOMES} select case_id, outcome from outcomes",
    "threshold_label": f"""{WITH_COHORT},
scored as (select {_yes_no("hosp_yn")} * 0.25::double + {_yes_no("icu_yn")} * 0.375::double + {AGE_1} * 0.125::double as score from cohort)
select score, case when score > 0.5 then 1 when score <= 0.5 then 0 end as predicted_class, count(*) as case_count
from scored group by 1, 2""",
    "cases_by_age": f"{WITH_COHORT} select age_group, count(*) as case_count, {AGE_1} as age_rank from cohort group by age_group order by age_group desc",
    "cases_by_age_in_order": f"{WITH_COHORT} select age_group, count(*) as case_count, {AGE_1} as age_rank from cohort group by age_group order by age_rank",
    "icu_by_age": ICU_BY_AGE,
    "cases_by_race": _count("race"),
    "cases_by_sex": _count("sex"),
    "cases_by_age_sex": _count("age_group, sex"),
    "race_share": _share("race"),
    "sex_share": _share("sex"),
    "monthly_state": MONTHLY_STATE,
    "month_spine": f"""{WITH_COHORT},
span as (select min(cast(case_month || '-01' as date)) as first, max(cast(case_month || '-01' as date)) as last
from cohort where res_state = '{STATE}')
select cast(cast(s.m as date) as varchar) as month_start
from span, unnest(generate_series(first, last, interval 6 month)) as s(m)""",
    "date_range": f"""{WITH_COHORT} select min(case_month) || '-01' as first, max(case_month) || '-01' as last from cohort""",
    "outcome_share": OUTCOME_SHARE,
    "outcome_share_tally": OUTCOME_SHARE,
    "contingency": CONTINGENCY,
    "topn_ordered": TOPN,
    "topn_distributed": TOPN,
    "order_positions": f"{WITH_COHORT} select case_id, case_month, row_number() over (order by case_month desc, case_id) as position from cohort",
    "report_order": REPORT_ORDER,
    "report_counts": _report_counts(),
    "set_outcome_share": OUTCOME_SHARE,
    "set_icu_by_age": ICU_BY_AGE,
    "set_contingency": CONTINGENCY,
    "set_race_share": _share("race"),
    "set_monthly_state": MONTHLY_STATE,
    "profile": f"{WITH_COHORT} "
    + " union all ".join(
        f"select '{c}' as dimension, {c} as level, count(*) as rows from cohort group by {c}" for c in REPORT_COLUMNS
    ),
    "describe_intervals": f"""{WITH_COHORT},
valid as (select * from cohort where case_positive_specimen_interval >= 0 and case_onset_interval >= 0)
{_describe("case_positive_specimen_interval")} union all {_describe("case_onset_interval")}""",
    "correlation": CORRELATION,
    "correlation_rows": CORRELATION,
    "death_cells": f"{CELLS} select * from cells",
    "death_cells_tally": f"{CELLS} select * from cells",
    "split_random": f"{_drawn()} select n as rows, fold as part from drawn",
    "folds_random": f"{_drawn()} select fold, cast((select sum(n) from drawn) - n as bigint) as train_rows, n as test_rows from drawn",
    "folds_by_key": f"""{WITH_COHORT},
folded as (select cast(cast('0x' || substring(md5(cast(case_id as varchar)), 1, 8) as bigint) % {D.FOLDS} as int) as fold from cohort)
select fold, (select count(*) from folded) - count(*) as train_rows, count(*) as test_rows from folded group by fold""",
    "folds_random_properties": FOLD_PROPERTIES,
    "folds_by_key_properties": FOLD_PROPERTIES,
    "split_random_union": f"{MODEL} select * from model",
    "folds_stratified": f"{FOLDS} select {MODEL_COLUMNS}, fold, count(*) as rows from folded group by {MODEL_COLUMNS}, fold",
    "fold_sizes": f"""{FOLDS} select fold, (select count(*) from folded) - count(*) as train_rows, count(*) as test_rows
from folded group by fold""",
    "fold_sizes_pairs": f"""{FOLDS} select fold, 'test' as side, count(*) as rows from folded group by fold
union all select fold, 'train', (select count(*) from folded) - count(*) from folded group by fold""",
    "bind_rows": f"""{FOLDS},
second as ({KINDS_IN_FOLD.format(1)}), third as ({KINDS_IN_FOLD.format(2)}), fourth as ({KINDS_IN_FOLD.format(3)})
select *, null::varchar as part from second
union all by name select * exclude (race), null::varchar as race, null::varchar as part from third
union all by name select *, 'fourth' as part from fourth""",
    "confusion": f"{_pairs('res_state, sex')} select * from matrix",
    "confusion_labels": """select count(*) filter (where quality = 0 and toxic = 0) as tn,
 count(*) filter (where quality = 1 and toxic = 0) as fn,
 count(*) filter (where quality = 0 and toxic = 1) as fp,
 count(*) filter (where quality = 1 and toxic = 1) as tp from labels""",
    "metrics_positive": f"""{_pairs("res_state")} select *, {_round(ACCURACY, "accuracy")},
 {_round(PRECISION, "precision")}, {_round(RECALL, "recall")}, {_round(F1, "f1")} from matrix""",
    "metrics_weighted": f"""{_pairs("res_state")} select *, {_round(ACCURACY, "weighted_accuracy")},
 {_round(_both(YES_PRECISION, NO_PRECISION), "weighted_precision")},
 {_round(_both(YES_RECALL, NO_RECALL), "weighted_recall")},
 {_round(_both(YES_F1, NO_F1), "weighted_f1")} from matrix""",
    "fold_mean": f"{STATE_MEANS} select * from means",
    "rank_configs": f"{STATE_MEANS} select res_state, accuracy, "
    "cast(row_number() over (order by accuracy desc nulls last, res_state) as integer) as position from means",
    "best_configs": f"{STATE_MEANS} "
    + " union all ".join(
        f"(select '{m}' as metric, {m} as value, res_state from means where not isnan({m}) order by {m} desc, res_state limit 1)"
        for m in ("accuracy", "precision", "recall", "f1")
    ),
    "correlation_weighted": """with r as (select o_totalprice::double as x, c_acctbal::double as y, o_orderkey % 5 + 1 as w
 from orders join customer on o_custkey = c_custkey),
m as (select sum(w * x) / sum(w) as mx, sum(w * y) / sum(w) as my from r),
s as (select sum(w * (x - mx) * (y - my)) / sqrt(sum(w * (x - mx) * (x - mx)) * sum(w * (y - my) * (y - my))) as r
 from r cross join m)
select 'price' as x, 'price' as y, 1.0::double as r union all select 'balance', 'balance', 1.0
 union all select 'price', 'balance', round(r, 6) from s union all select 'balance', 'price', round(r, 6) from s""",
    "encode_features": _slots(),
    "grid_support": f"""{FOLDS},
config(family, max_iter, threshold, min_instances, max_depth) as (values {_grid_rows()}),
sizes as (select fold, count(*) as cases, count(*) filter (where death_yn = 'Yes') as deaths from folded group by fold)
select config.*, fold, cases, deaths from config cross join sizes""",
    "grid_support_random": f"""{_drawn()},
config(family, max_iter, threshold, min_instances, max_depth) as (values {_grid_rows()})
select config.*, fold, n as cases, deaths from config cross join drawn""",
    "fit_logistic_balance": f"{_gains()} select feature, level, in_rows as cases, in_positive as deaths, true as balanced from gains",
    "fit_tree_split": f"{_gains()} {_first_split(1)} union all {_first_split(1000)}",
    "fit_tree_gains": f"{_gains()} select feature, level, in_rows, in_positive, out_rows, out_positive, {_round('gain', 'gain')} from gains where out_rows > 0",
    "fit_svc_optimal": "select true as no_closer_plane_is_better",
    "fit_svc_determined": f"{WITH_COHORT} select hosp_yn as stay, count(*) as cases, 0::bigint as errors from cohort "
    "where hosp_yn is not null and sex is not null group by hosp_yn",
    "kmeans_fixed_point": f"{CELLS} select 7::bigint as clusters, true as fixed, count(*) as cells from cells",
    "kmeans_distinct": f"{CELLS} select distinct age_group_index, death_count::double as death_count from cells",
    "assign_nearest": f"{NEAREST} select * from assigned",
    "cluster_profile": f"""{NEAREST} select cluster, {_round("avg(death_count)", "avg_death_count")},
 {_round("avg(age_group_index)", "avg_age_group_index")}, count(*) as cell_count from assigned group by cluster""",
}
