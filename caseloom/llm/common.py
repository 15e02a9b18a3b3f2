"""Helpers of the text operators."""

from __future__ import annotations

import sys
import tempfile
from collections.abc import Callable

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from caseloom.sources.sinks import CHECKPOINT_CONF

# Python functions travel with their job, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules["caseloom.llm"])

#: Rows of a small side that are sent to all tasks (of some hundred bytes each), at most.
BROADCAST_ROWS = 100_000
#: Rows that share a key from which on they no longer meet it in one place.
HOT_ROWS = 1000
#: Places per key beyond these bounds.
SALTS = 32

SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def prepare(spark: SparkSession) -> None:
    """Give a session without ``spark.checkpoint.dir`` a folder of its own, as in tests."""
    if spark.conf.get(CHECKPOINT_CONF, None) or spark.sparkContext.getCheckpointDir():
        return
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError(f"set {CHECKPOINT_CONF} to a folder that every executor can reach")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="caseloom-"))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def whole(text: str | Column = "text") -> Column:
    """The text, with NULL as the empty text."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like the given ones that the table doesn't have yet."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once, whatever the optimizer merges."""
    return F.transform(F.array(value), body)[0]


def word_list(text: Column) -> Column:
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("bigint")


def held_out(doc_id: str | Column = "doc_id") -> Column:
    """Rows that no model learns from: the checksum of the id leaves 2 when divided by 4.
    A NULL id is never held out."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(col.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def attach(rows: DataFrame, plan: DataFrame, key: str, plan_key: str, limit: int = BROADCAST_ROWS, how: str = "inner") -> DataFrame:
    """The rows with the columns of the one row of ``plan`` (a written table) that has their key;
    NULL is a key. A plan of at most ``limit`` rows is sent to all tasks, so that rows of a hot key
    stay where they are; of a longer one each row stands in ``SALTS`` places."""
    same = rows[key].eqNullSafe(plan[plan_key])
    if plan.count() <= limit:
        return rows.join(F.broadcast(plan), same, how)
    mine, its = fresh(rows, "salt", "plan_salt")
    salted = rows.withColumn(mine, F.floor(F.rand(1) * SALTS).cast("int"))
    spread = plan.withColumn(its, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    on = salted[key].eqNullSafe(spread[plan_key]) & (salted[mine] == spread[its])
    return salted.join(spread, on, how).drop(mine, its)


def join_heads(rows: DataFrame, heads: DataFrame, keys: list[str], members: str, hot: int = HOT_ROWS, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``rows`` left-joined with the one row of ``heads`` that has their ``keys`` (never NULL); both
    are written tables, and ``members`` says how many rows a head has. Rows of heads with more
    than ``hot`` members do not meet in one place. Such heads are few: up to ``limit`` of them are
    sent to all tasks, and beyond it each stands in ``SALTS`` places."""
    crowded = heads.filter(F.col(members) > hot)
    n = crowded.count()
    if n == 0:
        return rows.join(heads.drop(members), keys, "left")
    if n <= limit:
        [flag] = fresh(rows, "crowded")
        names = F.broadcast(crowded.select(*keys, F.lit(True).alias(flag)))
        marked = rows.join(names, keys, "left")
        found = marked.filter(F.col(flag)).drop(flag).join(F.broadcast(crowded.drop(members)), keys, "left")
        rest = marked.filter(F.col(flag).isNull()).drop(flag)
        return found.unionByName(rest.join(heads.filter(F.col(members) <= hot).drop(members), keys, "left"))
    [salt] = fresh(rows, "salt")
    salted = rows.withColumn(salt, F.floor(F.rand(1) * SALTS).cast("int"))
    spread = heads.drop(members).withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(spread, [*keys, salt], "left").drop(salt)
