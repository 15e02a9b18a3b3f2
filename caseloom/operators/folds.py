"""Random splits and cross-validation folds for a table without a key."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caseloom import domain as D


def deal(rows: Column, hands: Column, hand: Column) -> Column:
    """How many of ``rows`` items hand number ``hand`` gets when they are dealt out
    in turn. Dealing identical rows needs their number only, not the rows."""
    return F.call_function("div", rows + hands - F.lit(1) - hand, hands)


def uniform(columns: Sequence[str | Column], *salt: int) -> Column:
    """A number in [0, 1) from the values of a row and the salt: the same wherever the row lies."""
    parts = [F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit("<null>")) for c in columns]
    text = F.concat_ws("|", *[F.lit(str(x)) for x in salt], *parts)
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("bigint") / F.lit(float(1 << 52))


def _log_binomial(n: Column, k: Column, mean: Column, rest_mean: Column) -> Column:
    """Logarithm of the probability of k of n, for k and n - k of 16 at least. The terms of
    Stirling's series and the two deviances stay small where factorials would lose all digits."""

    def series(x: Column) -> Column:
        return (1 / 12 - (1 / 360 - 1 / (1260 * x * x)) / (x * x)) / x

    def deviance(x: Column, m: Column) -> Column:
        return x * F.log1p((x - m) / m) - (x - m)

    rest = n - k
    size = 0.5 * F.log(n / (2 * math.pi * k * rest))
    return series(n) - series(k) - series(rest) - deviance(k, mean) - deviance(rest, rest_mean) + size


def binomial_draw(n: Column, p: Column, u: Column) -> Column:
    """How many of ``n`` trials succeed: the inverse of the binomial distribution at ``u``. For
    ``p`` above a half the failures are drawn. The sum runs over ten deviations and 30 on both
    sides of the mean; what lies beyond has less probability than a double resolves. So a draw
    for n identical rows takes some sqrt(n) steps and not n."""
    r = F.least(p, 1 - p)
    mean, sd = n * r, F.sqrt(n * r * (1 - r))
    low = F.greatest(F.lit(0.0), F.floor(mean - 10 * sd - 30).cast("double"))
    low = F.when(low < 16, 0.0).otherwise(low)
    high = F.least(n.cast("double"), F.ceil(mean + 10 * sd + 30).cast("double"))
    first = F.when(low == 0, n * F.log1p(-r)).otherwise(_log_binomial(n.cast("double"), low, mean, n * (1 - r)))
    odds = r / (1 - r)

    def step(acc: Column, k: Column) -> Column:
        below = acc["below"] + acc["here"]
        found = F.when(acc["found"] >= 0, acc["found"]).when(u < below, k).otherwise(F.lit(-1).cast("bigint"))
        return F.struct((acc["here"] * (n - k) / (k + 1) * odds).alias("here"), below.alias("below"), found.alias("found"))

    start = F.struct(F.exp(first).alias("here"), F.lit(0.0).alias("below"), F.lit(-1).cast("bigint").alias("found"))
    ks = F.sequence(low.cast("bigint"), high.cast("bigint"))
    drawn = F.aggregate(ks, start, step, lambda acc: F.when(acc["found"] >= 0, acc["found"]).otherwise(high.cast("bigint")))
    return F.when(p > 0.5, n - drawn).otherwise(drawn)


def multinomial_parts(rows: Column, weights: Sequence[float], draws: Sequence[Column]) -> Column:
    """How many of ``rows`` identical rows fall into each part when every row is drawn on its own:
    an array with a number per weight, from one uniform draw per weight but the last."""
    total = list(accumulate(reversed(weights)))[::-1]
    if not total or total[-1] <= 0 or min(weights) < 0:
        raise ValueError("weights are not negative, and the last one is positive")
    chances = F.array(*[F.struct(F.lit(w / t).alias("p"), u.alias("u")) for w, t, u in zip(weights, total, draws, strict=False)])
    start = F.struct(rows.cast("bigint").alias("left"), F.array().cast("array<bigint>").alias("dealt"))

    def step(acc: Column, chance: Column) -> Column:
        drawn = F.array(binomial_draw(acc["left"], chance["p"], chance["u"]))
        return F.transform(drawn, lambda d: F.struct((acc["left"] - d).alias("left"), F.concat(acc["dealt"], F.array(d)).alias("dealt")))[0]

    if len(weights) == 1:
        return F.array(rows.cast("bigint"))
    return F.aggregate(chances, start, step, lambda acc: F.concat(acc["dealt"], F.array(acc["left"])))


def drawn_parts(tallied: DataFrame, weights: Sequence[float], seed: int = D.SPLIT_SEED, rows: str = "rows", name: str = "parts") -> DataFrame:
    """Add the array ``name``: how many rows of each kind of a :func:`tally` fall into each part.

    A row's part is a random draw, and identical rows are interchangeable, so the numbers of a kind
    are a multinomial draw. It is taken from a hash of the kind and the seed: no row is drawn, the
    partitioning does not matter, and the same parts come out when the plan is run again.
    """
    kinds = [c for c in tallied.columns if c != rows]
    draws = [uniform(kinds, seed, i) for i in range(len(weights) - 1)]
    return tallied.withColumn(name, multinomial_parts(F.col(rows), weights, draws))


def unfold(tallied: DataFrame, rows: str = "rows", heaviest: int = 1_000_000) -> DataFrame:
    """Rows in place of their numbers. A kind of many rows is first cut into pieces that are
    spread over the tasks, so that none of them makes all rows of it."""
    # The number is stated, else pieces would be put together again for being small.
    tasks = int(tallied.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pieces = split_heavy(tallied, rows, heaviest).repartition(tasks)
    return pieces.withColumn(rows, F.explode(F.sequence(F.lit(1).cast("bigint"), rows))).drop(rows)


def split_random(
    df: DataFrame, weights: Sequence[float] = (0.25,) * D.FOLDS, seed: int = D.SPLIT_SEED
) -> list[DataFrame]:
    """Disjoint random parts that together are ``df``, as rows. Each part is made from the counts
    of its kinds of rows; nothing is written, and a part is the same whenever it is read."""
    rows, parts = _free(df, "rows"), _free(df, "parts")
    drawn = drawn_parts(df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias(rows)), weights, seed, rows, parts)
    return [
        unfold(drawn.withColumn(rows, F.col(parts)[i]).drop(parts).filter(F.col(rows) > 0), rows).select(*df.columns)
        for i in range(len(weights))
    ]


def _free(df: DataFrame, name: str) -> str:
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def random_folds(tallied: DataFrame, k: int = D.FOLDS, seed: int = D.SPLIT_SEED, rows: str = "rows") -> DataFrame:
    """Kinds of rows by ``fold`` with their number in it, every row being drawn on its own."""
    drawn = drawn_parts(tallied, [1.0] * k, seed, rows, "_parts")
    columns = [c for c in tallied.columns if c != rows]
    dealt = drawn.select(*columns, F.posexplode("_parts").alias("fold", rows))
    return dealt.filter(F.col(rows) > 0).select(*columns, rows, "fold")


def content_offset(columns: Sequence[str], k: int) -> Column:
    """A number below ``k`` that depends on the values of a row only."""
    text = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("<null>")) for c in columns])
    head = F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")
    return F.pmod(head, F.lit(k))


def key_folds(df: DataFrame, keys: Sequence[str], k: int = D.FOLDS) -> DataFrame:
    """For tables that do have a key: ``fold`` from its checksum, stable, local, and the same in any
    engine."""
    return df.withColumn("fold", content_offset(keys, k).cast("int"))


def stratified_folds(tallied: DataFrame, k: int = D.FOLDS, rows: str = "rows") -> DataFrame:
    """Deal each kind of row of a :func:`tally` over ``k`` folds as evenly as can be.

    Rows of one kind are interchangeable, so this is the same as numbering them and
    taking the number modulo ``k``, without ever bringing a large kind together.
    Kinds start at different folds, else every remainder would go to fold 0. The
    result does not depend on partitioning.
    """
    kinds = [c for c in tallied.columns if c != rows]
    seat = F.pmod(F.col("fold").cast("bigint") - content_offset(kinds, k), F.lit(k))
    return (
        tallied.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
        .withColumn(rows, deal(F.col(rows), F.lit(k), seat))
        .filter(F.col(rows) > 0)
    )


def fold_pairs(df: DataFrame, k: int = D.FOLDS) -> Iterator[tuple[int, DataFrame, DataFrame]]:
    """``(i, train, test)`` for every fold: the other folds, and fold ``i``."""
    for i in range(k):
        yield i, df.filter(F.col("fold") != i), df.filter(F.col("fold") == i)


def fold_sizes(df: DataFrame, rows: str | None = None, k: int | None = None) -> DataFrame:
    """Training and test rows of every fold, from one count per fold. With ``k``, folds that
    got no rows are listed too."""
    test = df.groupBy("fold").agg((F.count(F.lit(1)) if rows is None else F.sum(rows)).alias("test_rows"))
    if k is not None:
        every = df.sparkSession.range(k).select(F.col("id").cast(df.schema["fold"].dataType).alias("fold"))
        test = every.join(test, "fold", "left").select("fold", F.coalesce("test_rows", F.lit(0)).alias("test_rows"))
    everything = Window.partitionBy()  # k rows
    train = F.sum("test_rows").over(everything) - F.col("test_rows")
    return test.select("fold", train.alias("train_rows"), "test_rows")


def split_heavy(df: DataFrame, rows: str, heaviest: int) -> DataFrame:
    """Replace each row that stands for more than ``heaviest`` by several that stand
    for at most that many each; their sum is unchanged."""
    parts = F.call_function("div", F.col(rows) + F.lit(heaviest - 1), F.lit(heaviest))
    return (
        df.withColumn("_parts", parts)
        .withColumn("_part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_parts") - 1)))
        .withColumn(rows, deal(F.col(rows), F.col("_parts"), F.col("_part")))
        .drop("_parts", "_part")
    )
