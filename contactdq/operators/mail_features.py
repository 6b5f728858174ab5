"""Numbers that describe an address, and a second opinion by a score made from them."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contactdq.functions.similarity import jaro_winkler_of
from contactdq.operators.mails import Lists
from contactdq.session import stored

DISAGREES_BELOW, DISAGREES_ABOVE = 0.20, 0.80


def features(rows: DataFrame, column: str, lists: Lists = Lists()) -> DataFrame:
    """Adds thirteen numbers; all zero where there is no user or no domain. The likeness to known domains is worked out by distinct domain."""
    mail = F.lower(F.trim(F.coalesce(F.col(column), F.lit(""))))
    at = F.instr(mail, "@")
    step = rows.withColumns({"_m": mail, "_u": F.when(at > 1, F.substring_index(mail, "@", 1)), "_d": F.when((at > 1) & (at < F.length(mail)), F.substr(mail, at + 1))})

    @F.pandas_udf("double")
    def likeness(d: pd.Series) -> pd.Series:
        return d.map(lambda x: max((jaro_winkler_of(x, v) for v in lists.valid), default=0.0))

    book = step.select("_d").filter("_d IS NOT NULL").distinct().withColumn("_like", likeness("_d"))
    step = step.join(book, "_d", "left")
    runs = F.transform(F.regexp_extract_all("_u", F.lit("[a-zñ]+"), F.lit(0)), lambda x: F.length(x))
    digits = F.regexp_count("_u", F.lit("[0-9]"))
    usable = F.col("_d").isNotNull()
    values = {
        "longitud_total": F.length("_m"),
        "longitud_usuario": F.length("_u"),
        "longitud_dominio": F.length("_d"),
        "racha_max_letras_usuario": F.array_max(runs),
        "total_letras_usuario": F.aggregate(runs, F.lit(0), lambda a, x: a + x),
        "total_digitos_usuario": digits,
        "ratio_digitos_usuario": digits / F.length("_u"),
        "cantidad_puntos_usuario": F.regexp_count("_u", F.lit(r"\.")),
        "cantidad_segmentos_dominio": F.size(F.split("_d", r"\.")),
        "dominio_conocido": F.col("_d").isin(*lists.valid).cast("int"),
        "similitud_max_dominio_conocido": F.round("_like", 6),
        "tld_final_reconocido": F.substring_index("_d", ".", -1).isin(*lists.final_tlds).cast("int"),
        "tiene_doble_punto": F.col("_m").contains("..").cast("int"),
    }
    return step.withColumns({k: F.when(usable, F.coalesce(v, F.lit(0))).otherwise(F.lit(0)) for k, v in values.items()}).drop("_m", "_u", "_d", "_like")


FEATURES = (
    "longitud_total", "longitud_usuario", "longitud_dominio", "racha_max_letras_usuario", "total_letras_usuario", "total_digitos_usuario", "ratio_digitos_usuario", "cantidad_puntos_usuario",
    "cantidad_segmentos_dominio", "dominio_conocido", "similitud_max_dominio_conocido", "tld_final_reconocido", "tiene_doble_punto",
)


@dataclass(frozen=True)
class Opinion:
    """A logistic model of the thirteen numbers, each less its mean and over its spread."""

    bias: float
    weights: tuple[float, ...]
    means: tuple[float, ...]
    spreads: tuple[float, ...]


def _numbers() -> list[Column]:
    return [F.col(c).cast("double") for c in FEATURES]


def _curvature(weights: np.ndarray):
    """Slope and curvature of the log-likelihood over the rows of a task."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = len(weights)
        total = np.zeros(n + n * n)
        for batch in batches:
            y = batch.column(0).to_numpy(zero_copy_only=False)
            x = np.column_stack((np.ones(len(y)), batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(y), n - 1)))
            p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
            total += np.concatenate((x.T @ (y - p), (x.T @ (x * (p * (1 - p))[:, None])).ravel()))
        yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], ["m"])

    return add


def fitted(judged: DataFrame, column: str, lists: Lists = Lists(), rounds: int = 12, penalty: float = 1.0) -> Opinion | None:
    """The model that fits the verdicts of the rules (ESTADO) best; reviews teach nothing. Every row given is learned from, each distinct mail once.

    Rounds of Newton's method: every task sums slope and curvature (14 and 14 x 14 numbers) over its rows, Spark adds them up and the driver takes the step.
    With one kind of verdict only there is nothing to learn: None.
    """
    told = judged.filter(~F.col("ESTADO").isin("REVISION", "REVISION MANUAL")).select(F.coalesce(F.col(column), F.lit("")).alias("_mail"), (~F.col("ESTADO").isin("INVALIDO", "BAJA")).cast("double").alias("_y"))
    told = features(told.groupBy("_mail").agg(F.min("_y").alias("_y")), "_mail", lists)
    told = stored(told.select("_y", *[c.alias(n) for c, n in zip(_numbers(), FEATURES)]), "numbers")
    row = told.agg(F.min("_y").alias("lo"), F.max("_y").alias("hi"), *[f(n).alias(f"{f.__name__}_{n}") for n in FEATURES for f in (F.avg, F.stddev_pop)]).first()
    if row["lo"] is None or row["lo"] == row["hi"]:
        return None
    means, spreads = [row[f"avg_{n}"] for n in FEATURES], [row[f"stddev_pop_{n}"] or 1.0 for n in FEATURES]
    rows = told.select("_y", F.array(*[(F.col(n) - m) / s for n, m, s in zip(FEATURES, means, spreads)]).alias("_x"))
    weights, held = np.zeros(len(FEATURES) + 1), np.diag([0.0] + [penalty] * len(FEATURES))
    for _ in range(rounds):
        sums = rows.mapInArrow(_curvature(weights), "m array<double>").select(F.posexplode("m").alias("at", "m")).groupBy("at").agg(F.sum("m").alias("m")).orderBy("at").collect()
        m = np.array([r["m"] for r in sums])
        step = np.linalg.solve(m[len(weights) :].reshape(len(weights), -1) + held + 1e-9 * np.eye(len(weights)), m[: len(weights)] - held @ weights)
        weights = weights + step
        if np.abs(step).max() < 1e-8:
            break
    return Opinion(float(weights[0]), tuple(weights[1:].tolist()), tuple(means), tuple(spreads))


def scored(rows: DataFrame, column: str, model: Opinion | None, score: str = "PUNTAJE", lists: Lists = Lists()) -> DataFrame:
    """Adds the model's probability that a mail is valid; null where there is no model. Each distinct mail is scored once; a null mail as an empty one."""
    if model is None:
        return rows.withColumn(score, F.lit(None).cast("double"))
    keyed = rows.withColumn("_mail", F.coalesce(F.col(column), F.lit("")))
    logit = F.lit(model.bias)
    for x, w, m, s in zip(_numbers(), model.weights, model.means, model.spreads):
        logit = logit + (x - m) * (w / s)
    told = features(keyed.select("_mail").distinct(), "_mail", lists).select("_mail", (1 / (1 + F.exp(-logit))).alias(score))
    return keyed.join(told, "_mail").drop("_mail")


def second_opinion(judged: DataFrame, score: str) -> DataFrame:
    """A strong disagreement between verdict and score (0 bad, 1 good) makes a review; rows without a score stay."""
    bad = F.col("ESTADO").isin("BAJA", "INVALIDO")
    against = (~bad & (F.col(score) < DISAGREES_BELOW)) | (bad & (F.col(score) > DISAGREES_ABOVE))
    asks = F.coalesce(against, F.lit(False)) & ~F.col("ESTADO").isin("REVISION MANUAL", "REVISION")
    note = F.concat(F.col("MOTIVO"), F.lit("; desacuerdo entre regla y modelo (score="), F.format_string("%.2f", F.col(score)), F.lit(") - requiere revisión manual"))
    return judged.withColumns({"MOTIVO": F.when(asks, note).otherwise(F.col("MOTIVO")), "ESTADO": F.when(asks, "REVISION MANUAL").otherwise(F.col("ESTADO"))})


def with_mx(rows: DataFrame, domains: DataFrame, domain: str) -> DataFrame:
    """Adds MX_OK (true, false or unknown) from a table ``domain, mx_ok``; nothing is looked up over a network."""
    known = domains.groupBy(F.col("domain").alias(domain)).agg(F.bool_or("mx_ok").alias("MX_OK"))
    return rows.join(known, domain, "left")
