"""Mixing sources to target weights by iterative proportional fitting.

Token weights of the cells source x language x topic are raked until their marginals meet the targets; each document is then kept with a
probability in proportion to its cell's factor. The draw is a hash of doc_id and text, so it repeats.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

MAX_CELLS = 1_000_000
DIMENSIONS = ("source", "lang", "topic")


def words(text: Column) -> Column:
    """Words between ASCII white space, the token count used for weights."""
    t = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"[ \t\n\x0B\f\r]+", " "))
    return F.when(t == "", 0).otherwise(F.length(t) - F.length(F.replace(t, F.lit(" "), F.lit(""))) + 1).cast("long")


def topic(text: Column) -> Column:
    """A coarse topic by form: table, listing, article, note or none."""
    t = F.coalesce(text, F.lit(""))
    return F.when(t == "", "none").when(t.contains(" | "), "table").when(t.rlike(r"(?m)^\s*[-*#] "), "listing").when(F.length(t) >= 2000, "article").otherwise("note")


def rake(cells: pd.DataFrame, targets: dict[str, dict], rounds: int = 200, tolerance: float = 1e-9) -> np.ndarray:
    """Factor of each cell (dimension columns and ``tokens``) so that factor x tokens meets every target share. Target values that no
    cell holds are left out and the rest scaled up; values without a target keep their share of what is left."""
    weight, total = cells["tokens"].to_numpy(float).copy(), float(cells["tokens"].sum())
    codes = {}
    for d, want in targets.items():
        code, names = pd.factorize(cells[d], use_na_sentinel=False)
        names = [None if pd.isna(x) else x for x in names]
        now = np.bincount(code, weight, len(names))
        given = np.array([want.get(x, np.nan) for x in names], float)
        free = np.isnan(given)
        rest = max(0.0, 1 - np.nansum(given))
        share = np.where(free, rest * now / max(now[free].sum(), 1e-300), given)
        share = np.where(now > 0, share, 0)
        codes[d] = code, share / max(share.sum(), 1e-300) * total
    for _ in range(rounds):
        worst = 0.0
        for code, want in codes.values():
            now = np.bincount(code, weight, len(want))
            ratio = np.divide(want, now, out=np.ones(len(want)), where=now > 0)
            weight *= ratio[code]
            worst = max(worst, float(np.abs(ratio[want > 0] - 1).max(initial=0)))
        if worst < tolerance:
            break
    return np.divide(weight, cells["tokens"].to_numpy(float), out=np.zeros(len(cells)), where=cells["tokens"].to_numpy() > 0)


def rates(cells: pd.DataFrame, factor: np.ndarray, budget: float) -> np.ndarray:
    """c x factor with the c at which the cells' expected tokens are ``budget`` of all tokens; a rate over 1 asks for repeats."""
    tokens = cells["tokens"].to_numpy(float)
    return budget * tokens.sum() / max(float((tokens * factor).sum()), 1e-300) * factor


def without_repeats(rate: np.ndarray) -> np.ndarray:
    """The rates scaled down together until none is over 1, so that the shares stay as they are."""
    return rate / max(1.0, float(rate.max(initial=0)))


def tempered(cells: pd.DataFrame, power: float) -> dict[str, dict]:
    """Targets that raise each marginal share to ``power`` and scale the shares to 1."""
    out = {}
    for d in DIMENSIONS:
        share = cells.groupby(d, dropna=False)["tokens"].sum() ** power
        out[d] = {None if pd.isna(k) else k: float(v) for k, v in (share / max(share.sum(), 1e-300)).items()}
    return out


def mix(df: DataFrame, targets: dict[str, dict] | None = None, power: float = 0.7, budget: float = 0.9, seed: int = 6) -> DataFrame:
    """All rows and columns of ``df`` with ``n_tokens``, ``topic``, ``rate`` and ``sampled``. Needs doc_id, text, lang and source.

    Without ``targets`` each marginal is tempered to ``power``. The sample holds ``budget`` of the tokens at most: no document is drawn
    twice, so where the cell to be raised most would need it, all rates are lower in the same proportion. Documents without words count one token, so that they have a
    cell weight too. Null values are values. The cells (source x lang x topic) go to the driver; above 1,000,000 of them
    this is refused. Columns of ``df`` named like the new ones are replaced.
    """
    df = df.withColumns({"n_tokens": words(F.col("text")), "topic": topic(F.col("text"))})
    cells = df.groupBy(*DIMENSIONS).agg(F.sum(F.greatest("n_tokens", F.lit(1))).alias("tokens")).limit(MAX_CELLS + 1).toPandas()
    if len(cells) > MAX_CELLS:
        raise ValueError(f"more than {MAX_CELLS} cells of {DIMENSIONS}")
    cells = cells.sort_values(list(DIMENSIONS), kind="stable").reset_index(drop=True)
    factor = rake(cells, targets or tempered(cells, power))
    cells["rate"] = without_repeats(rates(cells, factor, budget))
    known = df.sparkSession.createDataFrame([tuple(None if pd.isna(x) else x for x in r[:3]) + (float(r[3]),) for r in cells[[*DIMENSIONS, "rate"]].itertuples(index=False)], "s string, l string, t string, rate double")
    df = df.drop("rate", "sampled")
    on = reduce(lambda a, b: a & b, [df[c].eqNullSafe(known[k]) for c, k in zip(DIMENSIONS, "slt", strict=True)])
    draw = (F.pmod(F.xxhash64(F.lit(seed), "doc_id", F.xxhash64("text")), F.lit(1 << 52)) / float(1 << 52))
    return df.join(F.broadcast(known), on, "left").drop("s", "l", "t").withColumn("sampled", draw < F.col("rate"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return mix(docs).select("doc_id", "source", "lang", "topic", "n_tokens", F.round("rate", 9).alias("rate"), "sampled")
