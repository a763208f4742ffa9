"""The detector as one plan: scale, two scorers, their ensemble, calibration, quality on held-out windows, report.

Everything is fitted on normal training windows alone. Models are passed in as functions of scaled windows, so an arm is a
choice of features and of scorers, and a study groups by ``arm``.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators import calibrate as C
from tidemark.operators import metrics as E
from tidemark.operators import sampling as J
from tidemark.operators import scaling as N
from tidemark.operators import scorers as M
from tidemark.sources.tables import written

#: Adds a score to all scaled windows, fitted on the training ones: (all, training) -> all with its column.
Scorer = Callable[[DataFrame, DataFrame], DataFrame]
#: Decimals of a score: windows that are alike tie, whatever order their parts were added up in.
DIGITS = 9


def linear(k: int = 6) -> Scorer:
    """Column recon: the error of the k principal directions."""
    return lambda rows, train: M.linear_error(rows, "scaled", M.fit_linear(train, "scaled", k))


def variational(**how) -> Scorer:
    """Column recon: the error of a variational autoencoder."""
    return lambda rows, train: M.vae_error(rows, "scaled", M.fit_vae(train, "scaled", **how))


def isolation(id_col: str, **how) -> Scorer:
    """Column isolation: the score of a forest."""
    return lambda rows, train: M.isolation_score(rows, "scaled", M.fit_isolation(train, id_col, "scaled", **how))


def score_windows(windows: DataFrame, vector: str, train: Column, recon: Scorer, isolate: Scorer, alpha: float = M.ALPHA) -> DataFrame:
    """Add ``score``: alpha of the standardised reconstruction error and the rest of the standardised isolation score.

    Rows where ``train`` holds fit the scaling, both scorers and the standardisation of their scores. A score depends on the
    vector alone, and windows of few symbols have few vectors: each distinct one is scaled and scored once, stands for
    ``_n`` training rows, and is joined back. ``windows`` are read three times.
    """
    d = windows.withColumn("_train", train)
    kinds = written(d.groupBy(vector).agg(F.sum(F.when(F.col("_train"), 1).otherwise(0)).alias("_n")))
    seen = F.col("_n") > 0
    scaled = written(N.robust_scale(kinds, vector, N.fit_robust(kinds.where(seen), vector, weight="_n"), "scaled"))
    training = written(d.where("_train").join(scaled.select(vector, "scaled"), vector))
    both = written(isolate(recon(scaled, training), training))
    z = written(N.component_z(both, ["recon", "isolation"], both.where(seen), "_n"))
    score = F.round(M.ensemble("z_recon", "z_isolation", alpha), DIGITS)
    return d.join(z.select(vector, "recon", "isolation", score.alias("score")), vector)


def held_out(scored: DataFrame, id_col: str, seed: str, by: Sequence[str] = ()) -> DataFrame:
    """The windows that fitted nothing, half of each label for calibration and half for the test."""
    group = F.concat_ws("|", *by, "label")
    return written(J.split_half(scored.where("NOT _train").drop("_train").withColumn("_group", group), "_group", id_col, seed).drop("_group"))


def report(scores: DataFrame, by: Sequence[str] = ("arm",)) -> DataFrame:
    """(by, the calibration quantiles, n_cal, n_test, n_attack, auc, ap, recall_t0, fpr_t0): thresholds from benign
    calibration scores, quality on the test half."""
    by = list(by)
    params = written(C.calibrate(scores.where("label = 'benign' AND split = 'CAL'"), tuple(by)))
    test, attack = scores.where("split = 'TEST'").join(params, by), F.col("label") == "attack"
    curve = written(E.curve(test.select(*by, "label", "score"), "score", attack, by))
    above = F.col("score") > F.col("T0")
    rates = test.groupBy(*by).agg(
        F.count("*").alias("n_test"), F.sum(attack.cast("long")).alias("n_attack"), E.rate(F.when(attack, above)).alias("recall_t0"), E.rate(F.when(~attack, above)).alias("fpr_t0")
    )
    n_cal = scores.where("split = 'CAL'").groupBy(*by).agg(F.count("*").alias("n_cal"))
    out = params
    for part in (n_cal, rates, E.auc(curve, by), E.average_precision(curve, by)):
        out = out.join(part, by)
    return out


def nested(report_: DataFrame, by: Sequence[str] = ("arm",)) -> DataFrame:
    """The report as the nested object that ``sources.tables.write_report`` writes."""
    return report_.select(
        *by, F.struct("n_cal", "n_test", "n_attack").alias("windows"), F.struct(*C.POINTS).alias("calibration"),
        F.struct("auc", "ap", "recall_t0", "fpr_t0").alias("test_quality"),
    )
