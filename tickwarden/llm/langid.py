"""Language identification by multilingual mixture inference.

Features: hashed byte trigrams of the lower-cased letters of the whole
text (other ASCII characters count as blanks).  Training sums trigram
counts per language over all labelled training rows, smoothed by
``SMOOTH``.

Prediction: a document's trigrams are draws from a mixture of the
languages' trigram distributions.  Expectation-maximisation estimates
the proportions over all learned languages; the language set is then
selected by penalised likelihood: starting from the likeliest single
language, the language with the next largest proportion joins while the
log-likelihood (proportions refitted on the set) rises by more than
``PENALTY`` times the logarithm of the number of trigrams.  The
prediction is the set's largest proportion and that proportion its score.

Distribution: each task counts its rows in dense arrays, at most ``HELD``
of them at a time, and emits one row per (language, trigram); the sums are
packed to one row per language.  At most ``max_langs`` languages are
learned, those with the most training rows (ties: the smaller code), so the
model is at most ``max_langs`` x 65,536 numbers of eight bytes (67 MB at
the default) wherever it goes.  Prediction is a pass over the rows.

Defined cases: a null text, or one without a letter, is ``und`` with
score 0; so is every text if nothing was learned.  A null lang is not
learned from, nor are labels beyond the ``max_langs`` most frequent; a row with a null doc_id is neither learned from nor held
out (held_out is null).  Ties go to the smaller language code.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickwarden.llm.common import column, id_remainder, prepare, stored, whole_row, worker_task

CODES = 1 << 16
SMOOTH = 0.5
PENALTY = 3.0
STEPS = 12
MAX_LANGS = 128
HELD = 64
UNDETERMINED = "und"
MIN_SCORE = 0.34

COUNTS = pa.schema([("lang", pa.string()), ("code", pa.int32()), ("n", pa.int64())])

# ASCII characters that are not letters become blanks
_LETTERS = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))


def trigram_codes(text: str) -> np.ndarray:
    """Hashed trigrams of a text, in order, without those around a blank run."""
    raw = np.frombuffer(b" " + text.lower().encode("utf-8", "replace").translate(_LETTERS) + b" ", np.uint8)
    a = raw.astype(np.uint32)
    grams = (a[:-2] << 16) | (a[1:-1] << 8) | a[2:]
    grams = grams[raw[1:-1] != 32]
    return (grams * np.uint32(2654435761)) >> np.uint32(16)


def _counted(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if len(codes) > 8192:
        dense = np.bincount(codes, minlength=CODES)
        found = np.flatnonzero(dense)
        return found, dense[found]
    return np.unique(codes, return_counts=True)


def train(rows: DataFrame, max_langs: int = MAX_LANGS) -> DataFrame:
    """(text, lang) rows to trigram counts (lang, code, n), over all rows of
    the ``max_langs`` most frequent labels."""
    prepare(rows.sparkSession)

    def counts(sums: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        for lang, dense in sums.items():
            found = np.flatnonzero(dense).astype(np.int32)
            for i in range(0, len(found), 16384):
                part = found[i : i + 16384]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(part)), pa.array(part), pa.array(dense[part])], schema=COUNTS
                )

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in parts:
            for text, lang in zip(column(batch, "text"), column(batch, "lang")):
                if lang not in sums:
                    if len(sums) >= HELD:
                        yield from counts(sums)
                        sums = {}
                    sums[lang] = np.zeros(CODES, np.int64)
                codes, n = _counted(trigram_codes(text))
                sums[lang][codes] += n
        yield from counts(sums)

    usable = rows.select("text", F.col("lang").cast("string").alias("lang")).where("text is not null and lang is not null")
    frequent = usable.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(max_langs)
    usable = usable.where(F.col("lang").isin([r["lang"] for r in frequent.collect()]))
    partial = usable.mapInArrow(worker_task(run), "lang string, code int, n bigint")
    return partial.groupBy("lang", "code").agg(F.sum("n").alias("n"))


class Model:
    """Languages (sorted) and the logarithm of their trigram probabilities."""

    def __init__(self, langs: list[str], codes: np.ndarray, which: np.ndarray, n: np.ndarray) -> None:
        self.langs = langs
        dense = np.full((len(langs), CODES), SMOOTH)
        dense[which, codes] += n
        self.prob = (dense / dense.sum(axis=1, keepdims=True)) if langs else dense
        self.log = np.log(self.prob)

    def __reduce__(self):
        return _restored, (self.langs, self.prob)

    @classmethod
    def of(cls, counts: DataFrame) -> Model:
        """From a counts table: one row of CODES numbers per language."""

        def pack(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
            dense = np.zeros(CODES, np.int64)
            dense[rows["code"].to_numpy()] = rows["n"].to_numpy()
            return pd.DataFrame([(key[0], dense.tobytes())], columns=["lang", "dense"])

        packed = stored(counts.groupBy("lang").applyInPandas(pack, "lang string, dense binary"), "lang-counts")
        rows = sorted((r["lang"], bytes(r["dense"])) for r in packed.collect())
        dense = [np.frombuffer(d, np.int64) for _, d in rows]
        which = np.repeat(np.arange(len(rows)), CODES)
        codes = np.tile(np.arange(CODES), len(rows))
        return cls([lang for lang, _ in rows], codes, which, np.concatenate(dense) if rows else np.zeros(0))

    def mixture(self, codes: np.ndarray, n: np.ndarray, members: list[int], steps: int = STEPS):
        """Proportions of the member languages and the log-likelihood, by EM."""
        p = self.prob[np.ix_(members, codes)]
        share = np.full(len(members), 1.0 / len(members))
        total = n.sum()
        for _ in range(steps):
            joint = share[:, None] * p
            share = (joint * (n / joint.sum(axis=0))).sum(axis=1) / total
        return share, float(np.log(share @ p) @ n)

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not self.langs or not any(map(str.isalpha, text)):
            return UNDETERMINED, 0.0
        codes, n = _counted(trigram_codes(text))
        if not len(codes):
            return UNDETERMINED, 0.0
        n = n.astype(float)
        single = self.log[:, codes] @ n
        chosen, best = [int(np.argmax(single))], float(single.max())
        share = np.ones(1)
        if len(self.langs) > 1:
            everything = range(len(self.langs))
            whole, _ = self.mixture(codes, n, list(everything))
            need = PENALTY * np.log(max(2.0, n.sum()))
            for lang in sorted(everything, key=lambda i: (-whole[i], i)):
                if lang in chosen:
                    continue
                trial, fit = self.mixture(codes, n, [*chosen, lang])
                if fit - best <= need:
                    break
                chosen, best, share = [*chosen, lang], fit, trial
        top = min(range(len(chosen)), key=lambda i: (-share[i], self.langs[chosen[i]]))
        return self.langs[chosen[top]], float(min(1.0, share[top]))


def _restored(langs: list[str], prob: np.ndarray) -> Model:
    """A model on a worker: the logarithms are not sent."""
    model = Model.__new__(Model)
    model.langs, model.prob, model.log = langs, prob, np.log(prob)
    return model


def predict(rows: DataFrame, model: Model, row: str, text: str = "text") -> DataFrame:
    """(row struct, lang_pred, score) of every row; the struct is carried along."""
    spark = rows.sparkSession
    prepare(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            found = [shared.value.predict(t) for t in column(batch, text)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(batch.schema.get_field_index(row)),
                    pa.array([f[0] for f in found], pa.string()),
                    pa.array([f[1] for f in found], pa.float64()),
                ],
                names=[row, "lang_pred", "score"],
            )

    from pyspark.sql import types as T

    schema = T.StructType([
        rows.schema[row], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())
    ])
    return rows.select(row, F.col(text).cast("string").alias(text)).mapInArrow(worker_task(run), schema)


def training_rows(docs: DataFrame) -> DataFrame:
    """Rows that may be learned from."""
    return docs.where((id_remainder(F.col("doc_id"), 4) != 2) & F.col("lang").isNotNull())


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row."""
    model = Model.of(train(training_rows(docs)))
    slim = docs.select(F.struct("doc_id").alias("_row"), "text")
    return predict(slim, model, "_row").select(
        "_row.doc_id", (id_remainder(F.col("_row.doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score"
    )


def keep(docs: DataFrame, min_score: float = MIN_SCORE) -> DataFrame:
    """The rows of ``docs`` whose language is determined: those without a
    letter, and those whose largest proportion is below ``min_score``, go."""
    model = Model.of(train(training_rows(docs)))
    rows = docs.select(whole_row(docs).alias("_row"), docs["text"].alias("text"))
    return predict(rows, model, "_row").where(
        (F.col("lang_pred") != UNDETERMINED) & (F.col("score") >= min_score)
    ).select("_row.*")
