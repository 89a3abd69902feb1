"""Reliability of sources and of signals, by expectation-maximisation.

A row is sound or bad, which nobody sees; what is seen are its source and a few
yes/no signals. A source has a share of bad rows, a signal marks bad rows with its
``hit`` rate and sound ones with its ``false_alarm`` rate, independently given the
row's state. Rows are counted once per source and pattern of signals, so one round
is an aggregation over one short row a source: its size follows the number of
sources, not of rows. A source with a third of all rows is one row like any other
(its counts combine before the shuffle).

Every share is drawn towards its start by pseudo-rows, so a source without marks
or a signal that marks nothing has a defined value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelsift.session import stored

ROUNDS = 20
START_BAD, START_HIT, START_FALSE = 0.2, 0.6, 0.1
PSEUDO = 5.0  # pseudo-rows of a source's share and of a signal's rates
MAX_SIGNALS = 10


def pattern_counts(df: DataFrame, source: str, signals: list[str]) -> DataFrame:
    """``(source, counts)``: rows per source (null is a source) for each of the
    2^n patterns; bit j of a pattern is signal j, null counting as not marked."""
    if not 0 < len(signals) <= MAX_SIGNALS:
        raise ValueError(f"one to {MAX_SIGNALS} signals")
    bits = [F.when(F.coalesce(F.col(s).cast("boolean"), F.lit(False)), 1 << j).otherwise(0)
            for j, s in enumerate(signals)]
    pattern = sum(bits[1:], bits[0])
    rows = df.select(F.col(source).alias("source"), pattern.alias("pattern"))
    return rows.groupBy("source").agg(F.array(*[F.count_if(F.col("pattern") == p)
                                                for p in range(1 << len(signals))]).alias("counts"))


def likelihoods(hit: list[float], false_alarm: list[float]) -> list[tuple[float, float]]:
    """For each pattern its probability in a bad and in a sound row."""
    out = []
    for p in range(1 << len(hit)):
        bad = sound = 1.0
        for j, (a, b) in enumerate(zip(hit, false_alarm)):
            bad *= a if p >> j & 1 else 1 - a
            sound *= b if p >> j & 1 else 1 - b
        out.append((bad, sound))
    return out


def posterior(share: Column, bad: float, sound: float) -> Column:
    """Probability that a row of this pattern and source is bad."""
    up = share * F.lit(bad)
    return up / (up + (1 - share) * F.lit(sound))


def reliability(df: DataFrame, source: str, signals: list[str], rounds: int = ROUNDS) -> tuple[DataFrame, list[dict]]:
    """``(source, n_rows, expected_bad, bad_share, reliability)`` for each source and
    one dict ``{signal, hit, false_alarm}`` a signal after ``rounds`` rounds.

    ``expected_bad`` sums the posteriors of the last round, ``bad_share`` is that
    sum drawn towards ``START_BAD``, ``reliability`` is ``1 - bad_share``. An empty
    table gives no sources and the drawn start values of the signals."""
    if rounds < 1:
        raise ValueError("one round at least")
    m = len(signals)
    patterns = range(1 << m)
    table = stored(pattern_counts(df, source, signals).withColumn("n_rows", F.aggregate(
        "counts", F.lit(0).cast("bigint"), lambda a, x: a + x)), "patterns")
    hit, false_alarm = [START_HIT] * m, [START_FALSE] * m
    past: list[list[float]] = []  # the likelihoods of the rounds so far

    def share_after(total: Column) -> Column:
        return (total + PSEUDO * START_BAD) / (F.col("n_rows") + PSEUDO)

    def expected(share: Column, like: Column, p: int) -> Column:
        return F.col("counts")[p] * posterior(share, like[2 * p], like[2 * p + 1])

    for _ in range(rounds):
        # a source's share follows from its counts and the past likelihoods: no
        # round writes a table, and a lost task repeats a fold over its few rows
        like = [x for pair in likelihoods(hit, false_alarm) for x in pair]
        now = F.lit(like)
        share = F.lit(START_BAD)
        if past:
            share = F.aggregate(F.array(*[F.lit(x) for x in past]), share, lambda s, like: share_after(
                sum([expected(s, like, p) for p in patterns[1:]], expected(s, like, 0))))
        state = table.withColumn("share", share).withColumn("bad", F.array(
            *[expected(F.col("share"), now, p) for p in patterns]))
        sums = state.agg(*[F.coalesce(F.sum(F.col(c)[p]), F.lit(0)).cast("double").alias(f"{c}{p}")
                           for c in ("bad", "counts") for p in patterns]).first()
        b = [sums[f"bad{p}"] for p in patterns]
        s = [sums[f"counts{p}"] - b[p] for p in patterns]
        hit = [(sum(b[p] for p in patterns if p >> j & 1) + PSEUDO * START_HIT) / (sum(b) + PSEUDO) for j in range(m)]
        false_alarm = [(sum(s[p] for p in patterns if p >> j & 1) + PSEUDO * START_FALSE) / (sum(s) + PSEUDO)
                       for j in range(m)]
        past.append(like)
    table = state.withColumn("expected_bad", F.aggregate("bad", F.lit(0.0), lambda a, x: a + x)).withColumn(
        "bad_share", share_after(F.col("expected_bad")))
    table = table.select("source", "n_rows", "expected_bad", "bad_share", (1 - F.col("bad_share")).alias("reliability"))
    return table, [{"signal": s, "hit": a, "false_alarm": f} for s, a, f in zip(signals, hit, false_alarm)]
