"""Signals of label noise beyond the isolation forest, and what is done with
them: out-of-fold loss, confident joint, weights, source reliability.

Folds are hashes of the key, so a row's fold depends on nothing else; a fold's
model and vocabulary are fitted on the other folds only. Flips leave text
unchanged, so all folds share one stored table of term counts, and their fits
run side by side."""

from __future__ import annotations

from functools import reduce

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelsift.functions.columns import hash60
from labelsift.operators import logreg as LR
from labelsift.operators import tfidf as T
from labelsift.operators.quantile import kth_values
from labelsift.plans.common import SEED
from labelsift.plans.experiment import _frame, _vocabulary
from labelsift.session import materialize, spread, stored

FOLDS = 3
# A loss is a signal of one row, not a mean over many: the fit goes on until the
# objective moves by less than this share of itself (losses then agree with an
# exact solver to about 1e-5).
TIGHT = 1e-12


def fold(key: str, folds: int = FOLDS, seed: int = SEED) -> Column:
    return F.pmod(hash60(f"fold:{seed}", key), F.lit(folds)).cast("int")


def log_loss(label: Column, margin: Column) -> Column:
    """-log of the probability of the row's own label."""
    toward = F.when(label == 1, margin).otherwise(-margin)
    # log(1 + exp(-t)) without overflow
    return F.greatest(-toward, F.lit(0.0)) + F.log1p(F.exp(-F.abs(toward)))


def fold_doc_freq(counted: DataFrame, folds: int) -> DataFrame:
    """``(term, df_0, ctf_0, df_1, ...)``: a term's document and corpus counts in the
    rows outside each fold, from one pass over the counts for all folds. A row of a
    null fold (a null key) is outside none."""
    tc = counted.select("fold", F.explode("counts").alias("c")).select("fold", "c.term", "c.tf")
    return tc.groupBy("term").agg(*[x for k in range(folds) for x in (
        F.count_if(F.col("fold") != k).alias(f"df_{k}"),
        F.sum(F.when(F.col("fold") != k, F.col("tf"))).alias(f"ctf_{k}"))])


def out_of_fold(labelled: DataFrame, key: str = "row_id", text: str = "text", label: str = "label",
                folds: int = FOLDS, seed: int = SEED, cfg: T.TfidfConfig = T.EXPERIMENT,
                carry: tuple[str, ...] = ()) -> DataFrame:
    """``(key, *carry, fold, label, margin, probability, loss)``: every row judged
    by the model of the other folds. Rows of one fold never train their own judge;
    a key that repeats is in one fold as a whole."""
    counted = T.counts(spread(labelled), key, text, cfg, [label, *carry]).withColumn("fold", fold(key, folds, seed))
    counted = stored(counted, "counts")
    freq = stored(fold_doc_freq(counted, folds), "freq")

    def one(k: int) -> DataFrame:
        train = counted.where(F.col("fold") != k)
        n = train.count()
        vocab = T.fit_doc_freq(freq.where(F.col(f"df_{k}") > 0).select(
            "term", F.col(f"df_{k}").alias("df"), F.col(f"ctf_{k}").alias("ctf")), cfg, n)
        vocab.table = materialize(vocab.table)
        vocab.size = vocab.table.count()
        frame = LR.training_frame(materialize(_frame(train, vocab, key, {"label": label})), n)
        model = LR.fit_logreg(frame, n, tol=TIGHT)
        frame.unpersist()
        held = T.vectorize(counted.where(F.col("fold") == k), key, vocab, carry=["fold", label, *carry],
                           as_vector=int(vocab.size))
        margin = vector_to_array(F.col("rawPrediction"))[1]
        return stored(model.transform(held).select(
            key, *carry, "fold", F.col(label).cast("int").alias("label"), margin.alias("margin"),
            vector_to_array(F.col("probability"))[1].alias("probability")), "fold")

    rows = reduce(DataFrame.unionByName, LR.fit_concurrently([(one, k) for k in range(folds)]))
    return rows.withColumn("loss", log_loss(F.col("label"), F.col("margin")))


def own_probability() -> Column:
    """The probability of the label that a judged row carries."""
    return F.when(F.col("label") == 1, F.col("probability")).otherwise(1 - F.col("probability"))


def confident_joint(judged: DataFrame) -> tuple[DataFrame, dict]:
    """``(given, likely, n)`` for all four cells and the two class thresholds.

    A class's threshold is the mean probability of that class over the rows that
    carry it; a row is counted for the class of which it reaches the threshold
    (the more probable one if both), and for none if it reaches neither. Two
    aggregations of a few numbers; the thresholds are two scalars."""
    means = {r["label"]: r["t"] for r in judged.groupBy("label").agg(F.avg(own_probability()).alias("t")).collect()}
    marked = likely_class(judged, means)
    cells = marked.where("likely IS NOT NULL").groupBy(F.col("label").alias("given"), "likely").agg(
        F.count("*").alias("n"))
    grid = judged.sparkSession.createDataFrame([(i, j) for i in (0, 1) for j in (0, 1)], "given int, likely int")
    return grid.join(F.broadcast(cells), ["given", "likely"], "left").select("given", "likely", F.coalesce("n", F.lit(0)).alias("n")), means


def likely_class(judged: DataFrame, means: dict) -> DataFrame:
    p = F.col("probability")
    one = (p >= means[1]) if 1 in means else F.lit(False)
    zero = (1 - p >= means[0]) if 0 in means else F.lit(False)
    likely = F.when(one & zero, F.when(p > 0.5, 1).otherwise(0)).when(one, 1).when(zero, 0)
    return judged.withColumn("likely", likely.cast("int"))


def noise_to_prune(joint: DataFrame, judged: DataFrame) -> dict[int, int]:
    """Rows to take from each given class: its off-diagonal share of the joint,
    times the rows that carry the label, rounded half up."""
    rows = {r["label"]: r["n"] for r in judged.groupBy("label").agg(F.count("*").alias("n")).collect()}
    cells = {(r["given"], r["likely"]): r["n"] for r in joint.collect()}  # four numbers
    out = {}
    for g in (0, 1):
        total = cells[g, 0] + cells[g, 1]
        out[g] = (2 * cells[g, 1 - g] * rows.get(g, 0) + total) // (2 * total) if total else 0
    return out


def relabel(judged: DataFrame, key: str = "row_id") -> DataFrame:
    """``(key, label, likely, suspect, new_label)``: from each given class as many
    rows as the confident joint estimates to be wrong, the least probable ones
    first (to 4 decimals, ties by key), get the other label. The cut is an exact order statistic,
    found without a sort of the table."""
    joint, means = confident_joint(judged)
    take = noise_to_prune(joint, judged)
    marked = stored(likely_class(judged, means).withColumn("own", F.round(own_probability(), 4)), "judged")
    suspect = F.lit(False)
    for g, k in take.items():
        if k:
            v, tie = kth_values(marked.where(F.col("label") == g), "own", [k - 1], tiebreak=key)[k - 1]
            first = (F.col("own") < F.lit(v)) | ((F.col("own") == F.lit(v)) & (F.col(key) <= F.lit(tie)))
            suspect = suspect | ((F.col("label") == g) & first)
    return marked.select(key, "label", "likely", suspect.alias("suspect"),
                         F.when(suspect, 1 - F.col("label")).otherwise(F.col("label")).alias("new_label"))


LEAST_WEIGHT = 0.05


def loss_weight(least: float = LEAST_WEIGHT) -> Column:
    """A row's weight in training: the out-of-fold probability of its label,
    never under ``least`` (no row is dropped)."""
    return F.greatest(own_probability(), F.lit(least))


def fit_weighted(train: DataFrame, test: DataFrame, weight: str, key: str = "row_id", text: str = "text",
                 label: str = "label", cfg: T.TfidfConfig = T.EXPERIMENT):
    """A model fitted on ``train`` with the column ``weight`` (summed weighted
    losses plus the usual penalty), and the frame of ``test`` in its vocabulary.
    Returns ``(model, frame, total weight, rows)``."""
    counted = stored(T.counts(spread(train), key, text, cfg, [label, weight]), "counts")
    n, total = counted.agg(F.count("*"), F.sum(weight)).first()
    vocab = _vocabulary(counted, key, cfg, n)
    frame = LR.training_frame(materialize(_frame(counted, vocab, key, {"label": label, "weight": weight})), n)
    model = LR.fit_logreg(frame, n, tol=TIGHT, weight_col="weight", total_weight=total)
    frame.unpersist()
    held = _frame(T.counts(spread(test), key, text, cfg, [label]), vocab, key, {"label": label})
    return model, held, total, n
