"""A case table derived from the order tables, as a DataFrame and as SQL.

Both are written out separately so that one checks the other. ``case_id`` exists for
tests only; a real case table has no key.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pyspark.sql import types as T

from caseloom.domain import CASE_SCHEMA
from caseloom.operators.clean import clean_cohort
from caseloom.sources.sinks import save_table, shared_folder

CASES_SCHEMA = T.StructType([T.StructField("case_id", T.LongType()), *CASE_SCHEMA.fields])

# Stands in for the state that is looked at by month.
STATE = "NATION_3"


def derive_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    customer = spark.read.parquet(f"{sf_dir}/customer.parquet")
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet")
    joined = orders.join(customer, orders.o_custkey == customer.c_custkey).join(
        nation, customer.c_nationkey == nation.n_nationkey
    )
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    quarter = cust % 4
    risk = quarter + key % 5
    return joined.select(
        key.alias("case_id"),
        F.when(key % 97 == 0, "NA").otherwise(F.substring(F.col("o_orderdate").cast("string"), 1, 7)).alias("case_month"),
        F.when(F.col("c_nationkey") == 24, "Unknown").otherwise(F.col("n_name")).alias("res_state"),
        F.when(key % 53 == 0, "Missing")
        .when(quarter == 0, "0 - 17 years")
        .when(quarter == 1, "18 to 49 years")
        .when(quarter == 2, "50 to 64 years")
        .otherwise("65+ years")
        .alias("age_group"),
        F.when(key % 11 == 0, "Unknown").when(cust % 8 >= 4, "Female").otherwise("Male").alias("sex"),
        F.when(key % 41 == 0, "Missing").otherwise(F.col("c_mktsegment")).alias("race"),
        ((key % 13).cast("int") - 2).alias("case_positive_specimen_interval"),
        F.when(key % 7 == 0, F.lit(None)).otherwise((key % 5).cast("int") - 1).alias("case_onset_interval"),
        F.when((F.col("o_orderstatus") == "P") & (key % 3 == 0), "Probable Case")
        .otherwise("Laboratory-confirmed case")
        .alias("current_status"),
        F.when(key % 19 == 0, "Missing")
        .when(F.col("o_orderpriority").isin("4-NOT SPECIFIED", "5-LOW"), "Asymptomatic")
        .otherwise("Symptomatic")
        .alias("symptom_status"),
        F.when(key % 17 == 0, "Unknown").when(risk >= 5, "Yes").otherwise("No").alias("hosp_yn"),
        F.when(key % 23 == 0, "NA").when(risk >= 6, "Yes").otherwise("No").alias("icu_yn"),
        F.when(key % 29 == 0, "Missing")
        .when((risk >= 6) & (key % 7 < 5), "Yes")
        .when((risk == 5) & (key % 7 == 0), "Yes")
        .otherwise("No")
        .alias("death_yn"),
        F.when(F.col("c_acctbal") < 0, "NA").when(F.col("c_acctbal") > 5000, "Yes").otherwise("No").alias(
            "underlying_conditions_yn"
        ),
    )


# Application, shared folder and source directory -> where the derived table was written.
_WRITTEN: dict[tuple[str, str, str], str] = {}


def cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The derived table, written once per application: the analyses start from a
    stored case table, so their filters and columns reach a real scan. It serves later queries
    too, so no one who is writing stages at the time owns it."""
    folder = shared_folder(spark)
    key = (spark.sparkContext.applicationId, folder, sf_dir)
    if key not in _WRITTEN:
        path = f"{folder}/caseloom/cases-{uuid.uuid4().hex}"
        save_table(derive_cases(spark, sf_dir), path)
        _WRITTEN[key] = path
    return spark.read.schema(CASES_SCHEMA).parquet(_WRITTEN[key])


def cohort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean_cohort(cases(spark, sf_dir))


CASES_SQL = """
cases as (
select o_orderkey as case_id,
 case when o_orderkey % 97 = 0 then 'NA' else substring(cast(o_orderdate as varchar),1,7) end as case_month,
 case when c_nationkey = 24 then 'Unknown' else n_name end as res_state,
 case when o_orderkey % 53 = 0 then 'Missing' when o_custkey % 4 = 0 then '0 - 17 years'
      when o_custkey % 4 = 1 then '18 to 49 years' when o_custkey % 4 = 2 then '50 to 64 years'
      else '65+ years' end as age_group,
 case when o_orderkey % 11 = 0 then 'Unknown' when o_custkey % 8 >= 4 then 'Female' else 'Male' end as sex,
 case when o_orderkey % 41 = 0 then 'Missing' else c_mktsegment end as race,
 cast(o_orderkey % 13 as int) - 2 as case_positive_specimen_interval,
 case when o_orderkey % 7 = 0 then null else cast(o_orderkey % 5 as int) - 1 end as case_onset_interval,
 case when o_orderstatus = 'P' and o_orderkey % 3 = 0 then 'Probable Case'
      else 'Laboratory-confirmed case' end as current_status,
 case when o_orderkey % 19 = 0 then 'Missing' when o_orderpriority in ('4-NOT SPECIFIED','5-LOW')
      then 'Asymptomatic' else 'Symptomatic' end as symptom_status,
 case when o_orderkey % 17 = 0 then 'Unknown' when o_custkey % 4 + o_orderkey % 5 >= 5 then 'Yes' else 'No' end as hosp_yn,
 case when o_orderkey % 23 = 0 then 'NA' when o_custkey % 4 + o_orderkey % 5 >= 6 then 'Yes' else 'No' end as icu_yn,
 case when o_orderkey % 29 = 0 then 'Missing' when o_custkey % 4 + o_orderkey % 5 >= 6 and o_orderkey % 7 < 5 then 'Yes'
      when o_custkey % 4 + o_orderkey % 5 = 5 and o_orderkey % 7 = 0 then 'Yes' else 'No' end as death_yn,
 case when c_acctbal < 0 then 'NA' when c_acctbal > 5000 then 'Yes' else 'No' end as underlying_conditions_yn
from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey
)"""

TEXT_COLUMNS = (
    "case_month",
    "res_state",
    "age_group",
    "sex",
    "race",
    "current_status",
    "symptom_status",
    "hosp_yn",
    "icu_yn",
    "death_yn",
    "underlying_conditions_yn",
)

_CLEARED = ",\n ".join(f"case when {c} in ('Unknown','Missing','NA') then null else {c} end as {c}" for c in TEXT_COLUMNS)

CLEAN_SQL = f"""
clean as (
select case_id, case_positive_specimen_interval, case_onset_interval,
 {_CLEARED}
from cases
)"""

COHORT_SQL = """
cohort as (
select * from clean
where case_month is not null and age_group is not null and res_state is not null
  and current_status = 'Laboratory-confirmed case'
)"""

WITH_COHORT = f"with {CASES_SQL}, {CLEAN_SQL}, {COHORT_SQL}"
