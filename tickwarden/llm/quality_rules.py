"""Quality rules: base rules, then robust multivariate outliers.

Statistics of a whole text (words as in :mod:`common`): n_words,
word_chars (code points in words), n_symbols, n_dup_lines (lines with a
word that equal an earlier line), n_repeat_words (words inside a 3-word
window found twice or more), and n_lines (lines with a word).

Base rules reject texts of fewer than ``MIN_WORDS`` words, or with over
half of their words in repeated windows.

Method: the statistics become a vector of four transformed ratios (mean
word length on a log scale, symbols per word on a log scale, repeated lines per
line with ``FEW_LINES`` lines added, so that one repeat among few lines is
no large share, repeated words per word).  Per language and source a
minimum-covariance-determinant estimate is made of the vectors of all
documents that pass the base rules: from two deterministic starts
(medians with interquartile scales, medians with the floor scales),
concentration steps keep the ``core`` fraction of smallest Mahalanobis
distance and recompute centre and covariance; the start with the smaller
determinant wins.  The covariance is scaled to be consistent at the
normal distribution.  Where the core is degenerate, its variance is raised
to the square of ``FLOORS``; a wider variance stays as it is, so the word
length is judged by the group's own spread (a floor of a hundredth decides
only where all words are equally long).  Most texts have no symbol and no
repeated line or word at all, whatever the group; there the core has no
spread and the floors decide.  A document is rejected if its squared
distance exceeds the ``tail`` quantile of the chi-square distribution,
widened by ``1 + SMALL / rows`` as an estimate from few rows is rough.
The tail is a far one, as the ratios of short texts spread wider than
those of long ones: about 7.8 standard deviations in one direction; where
the core has none at all, some 0.04 symbols a word, a quarter of repeated
lines, or a third of repeated words.

Scale: a concentration step is one grouped aggregation.  Rows are put in
logarithmic bins of distance, and the moments summed per bin; the core
is then a run of bins.  So a source that holds a third of all rows is
combined before the shuffle, and no task sees a group's rows.  Vectors
are integers (thousandths), so sums are exact and reruns agree.

Groups below ``min_rows`` documents use an estimate of the language's
small groups together; where those are fewer as well, one of all
documents.  Below ``min_rows`` documents in all, only the base rules
apply.

Defined cases: a null or empty text has zeros and fails the base rules;
null lang and null source are values of their own; repeated rows each
get the same verdict; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickwarden.llm.common import prepare, stored, whole_row, words, worker_task

SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\x0c\r"
MIN_WORDS = 50
CORE = 0.75
TAIL = 1 - 1e-12
STEPS = 4
MIN_ROWS = 40
SMALL = 32
FEW_LINES = 3
# smallest standard deviation of each component, in its own unit
FLOORS = (0.01, 0.005, 0.03, 0.04)
UNIT = 1000
DIMS = len(FLOORS)
BIN_STEPS = 8  # bins per doubling of the squared distance

STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"]


def text_statistics(text: str | None) -> tuple[int, ...]:
    """The statistics named in ``STATS``."""
    ws = words(text)
    n = len(ws)
    if not n:
        return 0, 0, 0, 0, 0, 0
    chars = len(text) - sum(text.count(c) for c in BLANKS)
    symbols = sum(text.count(c) for c in SYMBOLS)
    lines = [s for s in text.split("\n") if s and s.strip(BLANKS)]
    return n, chars, symbols, len(lines) - len(set(lines)), _repeated_words(ws), len(lines)


def _repeated_words(ws: list[bytes]) -> int:
    n = len(ws)
    if n < 4:
        return 0
    numbers: dict[bytes, int] = {}
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in ws), np.int64, n)
    k = len(numbers)
    if k == n:
        return 0
    pairs = ids[:-1] * k + ids[1:]
    if k >= 1 << 20:  # three words no longer fit in 63 bits: number the pairs
        _, pairs = np.unique(pairs, return_inverse=True)
    windows = pairs[:-1] * k + ids[2:]
    order = np.argsort(windows)
    same = windows[order[1:]] == windows[order[:-1]]
    if not same.any():
        return 0
    covered = np.zeros(n, bool)
    for at in (order[1:][same], order[:-1][same]):
        for shift in range(3):
            covered[at + shift] = True
    return int(covered.sum())


def with_statistics(docs: DataFrame, name: str = "_q") -> DataFrame:
    """``docs`` with a struct column of the statistics of ``text``."""
    prepare(docs.sparkSession)

    def count(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for text in texts:
            yield pd.DataFrame([text_statistics(t) for t in text], columns=STATS, dtype="int64")

    @F.pandas_udf(", ".join(f"{s} bigint" for s in STATS))
    def stats(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        yield from worker_task(count)(texts)

    return docs.select("*", stats(docs["text"].cast("string")).alias(name))


def base_failed(q: str = "_q"):
    return (F.col(f"{q}.n_words") < MIN_WORDS) | (100 * F.col(f"{q}.n_repeat_words") > 50 * F.col(f"{q}.n_words"))


def vector(q: str = "_q") -> list:
    """The transformed statistics in thousandths."""
    n = F.greatest(F.col(f"{q}.n_words"), F.lit(1))
    parts = [
        F.log(F.greatest(F.col(f"{q}.word_chars"), F.lit(1)) / n),
        F.log1p(F.col(f"{q}.n_symbols") / n),
        F.col(f"{q}.n_dup_lines") / (F.col(f"{q}.n_lines") + FEW_LINES),
        F.col(f"{q}.n_repeat_words") / n,
    ]
    return [F.round(p * UNIT).cast("bigint") for p in parts]


def chi_square_quantile(p: float, dims: int = DIMS) -> float:
    """By the Wilson-Hilferty approximation."""
    z, a = NormalDist().inv_cdf(p), 2 / (9 * dims)
    return dims * (1 - a + z * math.sqrt(a)) ** 3


PAIRS = [(i, j) for i in range(DIMS) for j in range(i, DIMS)]
MODEL_DDL = "grp string, start int, mean array<double>, inverse array<double>, logdet double, rows bigint"


def _shape(mean: np.ndarray, cov: np.ndarray) -> tuple[list, list, float]:
    # in units of the floors: no direction has a variance below 1, none above 1 is changed
    floors = np.array(FLOORS)
    values, axes = np.linalg.eigh(cov / np.outer(floors, floors))
    cov = (axes * np.maximum(values, 1.0)) @ axes.T * np.outer(floors, floors)
    return mean.tolist(), np.linalg.inv(cov).ravel().tolist(), float(np.linalg.slogdet(cov)[1])


def _starts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        out = []
        for r in pdf.itertuples():
            quart = np.array([getattr(r, f"m{i}") for i in range(DIMS)], float) / UNIT
            for start, spread in enumerate(((quart[:, 2] - quart[:, 0]) / 1.349, np.zeros(DIMS))):
                out.append((r.grp, start, *_shape(quart[:, 1], np.diag(spread**2)), r.rows))
        yield pd.DataFrame(out, columns=["grp", "start", "mean", "inverse", "logdet", "rows"])


def _concentrate(core: float):
    """Bins of one step to centre and covariance of the core."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("bin")
        total = int(pdf["n"].sum())
        upto = int(np.searchsorted(pdf["n"].cumsum().to_numpy(), math.ceil(core * total))) + 1
        part = pdf.iloc[:upto]
        n = int(part["n"].sum())
        mean = np.array([int(part[f"s{i}"].sum()) / n for i in range(DIMS)]) / UNIT
        cov = np.zeros((DIMS, DIMS))
        for i, j in PAIRS:
            cov[i, j] = cov[j, i] = int(part[f"s{i}{j}"].sum()) / n / UNIT**2 - mean[i] * mean[j]
        # consistent at the normal distribution: the core's largest distance
        # should be the chi-square quantile of its share
        share = min(n / total, 0.999)
        edge = 2.0 ** ((int(part["bin"].iloc[-1]) + 1) / BIN_STEPS)
        factor = max(1.0, min(4.0, edge / chi_square_quantile(share)))
        return pd.DataFrame(
            [(*key, *_shape(mean, cov * factor), total)],
            columns=["grp", "start", "mean", "inverse", "logdet", "rows"],
        )

    return run


def _distance(x: list):
    """Squared Mahalanobis distance of the vector ``x`` (thousandths)."""
    diff = [c / float(UNIT) - F.element_at("mean", i + 1) for i, c in enumerate(x)]
    total = None
    for i, j in PAIRS:
        term = diff[i] * diff[j] * F.element_at("inverse", DIMS * i + j + 1) * (1.0 if i == j else 2.0)
        total = term if total is None else total + term
    return total


def _label(*parts):
    """A group's name; null and any text are told apart."""
    return F.to_json(F.array(*[F.coalesce(F.concat(F.lit("="), p.cast("string")), F.lit("-")) for p in parts]))


def estimate(stats: DataFrame, core: float = CORE, steps: int = STEPS, min_rows: int = MIN_ROWS):
    """(groups, model) of a table with lang, source and the struct ``_q``.

    ``groups``: lang, source, grp (the estimate they use).  ``model``: grp,
    mean, inverse (of the covariance), one row per estimate.
    """
    xs = [f"x{i}" for i in range(DIMS)]
    passing = stats.where(~base_failed()).select(
        F.col("lang").alias("lang"), F.col("source").alias("source"), *[v.alias(x) for v, x in zip(vector(), xs)]
    )
    passing = stored(passing, "mcd-vectors")
    fine, middle, top = _label(F.col("lang"), F.col("source")), _label(F.col("lang")), F.lit("[]")
    counts = passing.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"))
    counts = stored(counts.withColumn("small", F.col("n") < min_rows), "mcd-groups")
    by_lang = counts.where("small").groupBy("lang").agg(F.sum("n").alias("m")).withColumnRenamed("lang", "l")
    groups = counts.join(by_lang, F.col("lang").eqNullSafe(F.col("l")), "left").select(
        "lang", "source",
        F.when(~F.col("small"), fine).when(F.col("m") >= min_rows, middle).otherwise(top).alias("grp"),
    )
    groups = stored(groups, "mcd-groups")
    rows = _with_group(passing, groups).select("grp", *xs).where(F.col("grp") != top)
    if not groups.where(F.col("grp") == top).isEmpty():
        rows = rows.unionByName(passing.select(top.alias("grp"), *xs))
    rows = stored(rows, "mcd-rows")

    quartiles = [F.percentile(x, F.array(*[F.lit(p) for p in (0.25, 0.5, 0.75)])).alias(f"m{i}") for i, x in enumerate(xs)]
    first = rows.groupBy("grp").agg(F.count(F.lit(1)).alias("rows"), *quartiles).where(F.col("rows") >= min_rows)
    model = stored(first.mapInPandas(_starts, MODEL_DDL), "mcd-model")
    d2 = _distance([F.col(x) for x in xs])
    bin_no = F.floor(F.log2(F.greatest(d2, F.lit(1e-6))) * BIN_STEPS).cast("int")
    for _ in range(steps):
        binned = rows.join(model, "grp").select("grp", "start", bin_no.alias("bin"), *xs)
        sums = binned.groupBy("grp", "start", "bin").agg(
            F.count(F.lit(1)).alias("n"), *[F.sum(x).alias(f"s{i}") for i, x in enumerate(xs)],
            *[F.sum(F.col(xs[i]) * F.col(xs[j])).alias(f"s{i}{j}") for i, j in PAIRS],
        )
        model = stored(sums.groupBy("grp", "start").applyInPandas(_concentrate(core), MODEL_DDL), "mcd-model")
    best = model.groupBy("grp").agg(
        F.min_by(F.struct("mean", "inverse", "logdet", "rows"), F.struct("logdet", "start")).alias("best")
    )
    return groups, stored(best.select("grp", "best.*"), "mcd-model")


def _with_group(df: DataFrame, groups: DataFrame, how: str = "inner") -> DataFrame:
    """Join on lang and source, null for null; ``groups`` is one row per pair."""
    g = groups.select(F.col("lang").alias("_mcd_lang"), F.col("source").alias("_mcd_source"), "grp")
    on = df["lang"].eqNullSafe(g["_mcd_lang"]) & df["source"].eqNullSafe(g["_mcd_source"])
    return df.join(g, on, how)


def verdicts(stats: DataFrame, groups: DataFrame, model: DataFrame, tail: float = TAIL) -> DataFrame:
    """``stats`` rows with base_failed, distance (squared, null without an
    estimate) and kept, as a struct column ``_v``."""
    by_group = groups.join(model, "grp", "left").select(
        F.col("lang").alias("_mcd_lang"), F.col("source").alias("_mcd_source"), F.struct("mean", "inverse", "rows").alias("_mcd")
    )
    by_group = stored(by_group, "mcd-by-group")
    on = stats["lang"].eqNullSafe(by_group["_mcd_lang"]) & stats["source"].eqNullSafe(by_group["_mcd_source"])
    joined = stats.join(by_group, on, "left")
    diff = [c / float(UNIT) - F.element_at("_mcd.mean", i + 1) for i, c in enumerate(vector())]
    total = None
    for i, j in PAIRS:
        term = diff[i] * diff[j] * F.element_at("_mcd.inverse", DIMS * i + j + 1) * (1.0 if i == j else 2.0)
        total = term if total is None else total + term
    limit = (F.lit(float(SMALL)) / F.col("_mcd.rows") + 1.0) * chi_square_quantile(tail)
    far = F.coalesce(total > limit, F.lit(False))
    return joined.select(
        *[stats[c] for c in stats.columns],
        F.struct(base_failed().alias("base_failed"), total.alias("distance"), (~base_failed() & ~far).alias("kept")).alias("_v"),
    )


def judge(docs: DataFrame, tail: float = TAIL) -> DataFrame:
    """Per row: doc_id, the statistics, base_failed, distance, kept."""
    own = docs.select("doc_id", "lang", "source", "text")
    stats = stored(with_statistics(own).drop("text"), "quality-stats")
    out = verdicts(stats, *estimate(stats), tail)
    return out.select("doc_id", *[f"_q.{s}" for s in STATS], "_v.base_failed", "_v.distance", "_v.kept")


def keep(docs: DataFrame, tail: float = TAIL) -> DataFrame:
    """The rows of ``docs`` that are kept, with its columns.

    The texts are read twice (statistics for the estimates, then the
    verdicts) rather than shuffled to meet a table of verdicts.
    """
    own = docs.select("lang", "source", "text")
    stats = stored(with_statistics(own).drop("text"), "quality-stats")
    groups, model = estimate(stats)
    # the rows travel in one struct, so that their names cannot clash with ours
    row = docs.select(whole_row(docs).alias("_row"), "text", "lang", "source")
    judged = verdicts(with_statistics(row), groups, model, tail)
    return judged.where("_v.kept").select("_row.*")
