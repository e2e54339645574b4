"""Verdicts by the estimated spread, ids and rows that repeat or are null, odd column names."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from llm_rows import PROSE, documents, rows_of
from tickwarden.llm import classifier, langid, mixing, packing, quality_rules, simhash

LETTERS = "abcdefghijklmnopqrstuvwxyz"


def text_of(rng, n, length):
    """n words of about the given length."""
    return " ".join("".join(rng.choice(LETTERS) for _ in range(max(1, round(length())))) for _ in range(n))


def test_the_sources_own_spread_decides(spark):
    rng = random.Random(1)
    rows, probes = [], []
    for s, spread in (("narrow", 0.15), ("wide", 1.2)):
        for i in range(300):
            mean = 7 + rng.gauss(0, spread)
            rows.append((len(rows), text_of(rng, 120, lambda: mean), "en", s, 0))
        probes.append((10_000 + len(probes), text_of(rng, 120, lambda: 10), "en", s, 0))
    got = {r.doc_id: r.kept for r in quality_rules.judge(documents(spark, rows + probes)).collect()}
    # ten letters a word: far out in the narrow source, within the wide one
    assert (got[10_000], got[10_001]) == (False, True)
    assert sum(not got[i] for i in range(600)) <= 3


def test_words_of_one_length_leave_no_room_for_longer_ones(spark):
    rng = random.Random(2)
    rows = [(i, text_of(rng, 80, lambda: 6), "en", "six", 0) for i in range(300)]
    rows.append((999, text_of(rng, 80, lambda: 8), "en", "six", 0))
    got = {r.doc_id: r.kept for r in quality_rules.judge(documents(spark, rows)).collect()}
    assert not got[999] and all(got[i] for i in range(300))


def test_small_sources_have_estimates_of_their_own(spark):
    rng = random.Random(3)
    rows = [(1000 * s + i, text_of(rng, 80, lambda: 5 + 2 * s + rng.gauss(0, 0.3)), "en", f"s{s}", 0)
            for s in range(3) for i in range(45)]
    # the usual length of another source is an outlier in this one
    rows += [(5000 + s, text_of(rng, 80, lambda: 5 + 2 * ((s + 1) % 3)), "en", f"s{s}", 0) for s in range(3)]
    got = {r.doc_id: r.kept for r in quality_rules.judge(documents(spark, rows)).collect()}
    assert [got[5000 + s] for s in range(3)] == [False] * 3
    assert sum(not v for d, v in got.items() if d < 5000) <= 3


def _plain_mcd(x, core, starts=60):
    """The core of least determinant, from random starts to a fixed point."""
    rng, h, best = np.random.default_rng(0), math.ceil(core * len(x)), None
    floors = np.array(quality_rules.FLOORS)

    def shape(cov):
        values, axes = np.linalg.eigh(cov / np.outer(floors, floors))
        return (axes * np.maximum(values, 1.0)) @ axes.T * np.outer(floors, floors)

    for _ in range(starts):
        at = rng.choice(len(x), 8, replace=False)
        for _ in range(30):
            mean, cov = x[at].mean(axis=0), shape(np.cov(x[at].T, bias=True))
            d2 = np.einsum("ij,jk,ik->i", x - mean, np.linalg.inv(cov), x - mean)
            at = np.argsort(d2, kind="stable")[:h]
        size = np.linalg.slogdet(shape(np.cov(x[at].T, bias=True)))[1]
        if best is None or size < best[0]:
            best = size, at
    at = best[1]
    mean, cov = x[at].mean(axis=0), np.cov(x[at].T, bias=True)
    d2 = np.einsum("ij,jk,ik->i", x - mean, np.linalg.inv(shape(cov)), x - mean)
    factor = max(1.0, min(4.0, np.sort(d2)[h - 1] / quality_rules.chi_square_quantile(core)))
    return mean, shape(cov * factor)


def test_verdicts_match_a_plain_estimate(spark):
    rng = random.Random(4)
    rows = []
    for i in range(400):
        mean = 6 + rng.gauss(0, 0.4) + (7 if i % 9 == 0 else 0)  # a ninth is far off
        rows.append((i, text_of(rng, rng.randrange(60, 300), lambda: rng.gauss(mean, 1.5)), "en", "a", 0))
    out = quality_rules.judge(documents(spark, rows)).orderBy("doc_id").collect()
    vectors = np.array([[math.log(r.word_chars / r.n_words), math.log1p(r.n_symbols / r.n_words),
                         r.n_dup_lines / (r.n_lines + quality_rules.FEW_LINES), r.n_repeat_words / r.n_words] for r in out])
    mean, cov = _plain_mcd(vectors, quality_rules.CORE)
    d2 = np.einsum("ij,jk,ik->i", vectors - mean, np.linalg.inv(cov), vectors - mean)
    limit = quality_rules.chi_square_quantile(quality_rules.TAIL) * (1 + quality_rules.SMALL / len(rows))
    want = [not r.base_failed and d <= limit for r, d in zip(out, d2)]
    # binned cores differ from exact ones by a bin
    assert np.allclose([r.distance for r in out], d2, rtol=0.3, atol=0.5)
    assert 340 < sum(want) < 400 and min(d for d, w in zip(d2, want) if not w) > 1.3 * limit
    assert [r.kept for r in out] == want


# ------------------------------------------------ one row of each component


def other_prose(k):
    return " ".join(f"{w}{k}{i}" for i, w in enumerate(PROSE.split())) + f" tail{k}"


def test_an_id_with_unrelated_texts_loses_none(spark):
    rows = [(1, other_prose("x"), "en", "a", 0), (1, other_prose("y"), "en", "a", 0), (2, other_prose("x"), "en", "b", 0)]
    kept = simhash.keep_one(documents(spark, rows, clash=True))
    assert rows_of(kept, "doc_id", "text") == sorted([(1, other_prose("x")), (1, other_prose("y"))], key=str)


def test_rows_without_an_id_are_compared_too(spark):
    rows = [(None, other_prose("x"), "en", "a", 0)] * 2 + [(None, other_prose("y"), "en", "a", 0), (9, other_prose("z"), "en", "a", 0),
                                                          (None, other_prose("z"), "en", "a", 0), (None, None, None, None, None), (3, "", "en", "a", 0)]
    kept = simhash.keep_one(documents(spark, rows))
    assert rows_of(kept, "doc_id", "text") == sorted(
        [(None, other_prose("x")), (None, other_prose("y")), (9, other_prose("z")), (3, "")], key=str)


# ------------------------------------------------------------------- mixing


@pytest.mark.parametrize("rows", [
    [(None, f"w{i} " * 10, "en", s, 0) for s in "abc" for i in range(60)],  # no ids
    [(7, f"w{i} " * 10, "en", s, 0) for s in "abc" for i in range(60)],  # one id
    [(7, "same text here and now again ok yes", "en", s, 0) for s in "abc" for _ in range(60)],  # equal rows
])
def test_sources_come_near_their_target_whatever_the_ids(spark, rows):
    docs = documents(spark, rows).repartition(4)
    plan = mixing.mix_plan(docs)
    # per target, as a plan row does not name its source
    got = plan.groupBy("target").agg(F.sum("taken").alias("taken"), F.sum("size").alias("size"), F.max(F.col("taken") / F.col("size")).alias("most"))
    for r in got.collect():
        sources = round(r["size"] / (60 * (10 if len(rows[0][1]) > 36 or "w" in rows[0][1] else 8)))
        assert abs(r["taken"] - r["target"] * max(1, sources)) <= 0.25 * r["size"] and r["most"] <= 2
    assert rows_of(plan, "taken") == rows_of(mixing.mix_plan(documents(spark, rows).repartition(2)), "taken")
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    words = mixed.agg(F.sum(mixing.word_count(F.col("text")))).first()[0]
    assert words == plan.agg(F.sum("taken")).first()[0]


def test_equal_rows_are_numbered_across_partitions(spark):
    df = spark.range(100).selectExpr("id % 2 AS k").repartition(5)
    got = mixing._numbered(df, ["k"]).select("k", "_number").collect()
    assert sorted(map(tuple, got)) == sorted(itertools.product((0, 1), range(1, 51)))


def test_targets_when_every_source_is_capped_or_empty(spark):
    sizes = spark.createDataFrame([("a", 0), ("b", 0)], "source string, source_size bigint")
    assert rows_of(mixing.source_targets(sizes), "target", "rate") == [(0.0, 0.0), (0.0, 0.0)]
    sizes = spark.createDataFrame([("a", 10)], "source string, source_size bigint")
    assert rows_of(mixing.source_targets(sizes), "target") == [(15.0,)]
    assert rows_of(mixing.source_targets(sizes, budget=3.0), "target") == [(20.0,)]


# ----------------------------------------------------------------- language


def test_more_labels_than_are_learned(spark):
    rng = random.Random(5)
    rows = [(4 * i + 3, other_prose(rng.choice("abc")), f"dirty-{i}", "a", 0) for i in range(700)]
    rows += [(10_000 + i, PROSE * 3, "en", "a", 0) for i in range(40)]
    out = langid.identify(documents(spark, rows))
    got = {r.doc_id: r.lang_pred for r in out.collect()}
    assert got[10_000] == "en" and len(got) == 740
    learned = langid.train(langid.training_rows(documents(spark, rows)), max_langs=5).select("lang").distinct()
    assert learned.count() == 5 and learned.where("lang = 'en'").count() == 1


def test_mixture_proportions_match_a_plain_em(spark):
    rng = np.random.default_rng(6)
    prob = rng.dirichlet(np.full(40, 0.3), size=3)
    model = langid._restored(["a", "b", "c"], np.pad(prob, ((0, 0), (0, langid.CODES - 40)), constant_values=1e-12))
    draws = np.concatenate([rng.choice(40, 600, p=prob[0]), rng.choice(40, 300, p=prob[2])])
    codes, n = np.unique(draws, return_counts=True)
    share, fit = model.mixture(codes, n.astype(float), [0, 1, 2])
    plain = [1 / 3] * 3
    for _ in range(langid.STEPS):
        total = [0.0] * 3
        for d in draws:
            joint = [plain[k] * model.prob[k][d] for k in range(3)]
            total = [t + j / sum(joint) for t, j in zip(total, joint)]
        plain = [t / len(draws) for t in total]
    assert np.allclose(share, plain)
    assert np.isclose(fit, sum(math.log(sum(s * model.prob[k][d] for k, s in enumerate(plain))) for d in draws))


# ------------------------------------------------------------- column names


def test_stages_carry_columns_with_dots(spark):
    docs = documents(spark, [(i, other_prose(chr(97 + i % 20)) + f" n{i}", "en", "a", 0) for i in range(60)])
    docs = docs.select("*", F.lit(1).alias("a.b"), F.lit("x").alias("`tick`"), F.lit(2).alias("_row"), F.lit(3).alias("row"))
    for stage in (quality_rules.keep, langid.keep, simhash.keep_one, mixing.mix):
        out = stage(docs)
        assert out.columns == docs.columns, stage
        out.count()
    assert packing.pack_documents(docs).count() >= 60


# --------------------------------------------------------------- classifier


def test_dual_descent_matches_a_plain_solver():
    rng = np.random.default_rng(3)
    ratio = rng.normal(size=30)
    rows = [np.sort(rng.choice(30, rng.integers(3, 12), replace=False)).astype(np.int32) for _ in range(60)]
    y = np.where([ratio[f].sum() + rng.normal() > 0 for f in rows], 1.0, -1.0)
    w, bias = classifier.dual_descent(rows, y, ratio, epochs=2000)
    # the dual problem by projected gradient steps over the whole kernel
    x = np.zeros((60, 31))
    for i, f in enumerate(rows):
        x[i, f] = ratio[f] / np.sqrt(np.square(ratio[f]).sum())
        x[i, 30] = 1.0
    kernel = (x * y[:, None]) @ (x * y[:, None]).T
    upper = np.where(y > 0, 60 / (2 * (y > 0).sum()), 60 / (2 * (y < 0).sum()))
    dual, step = np.zeros(60), 1 / np.linalg.eigvalsh(kernel).max()
    for _ in range(60_000):
        dual = np.clip(dual - step * (kernel @ dual - 1), 0, upper)
    plain = (dual * y) @ x
    assert np.allclose(w, plain[:30], atol=2e-3) and abs(bias - plain[30]) < 2e-3


def test_the_fit_is_bounded_by_bytes_and_takes_very_long_texts(spark):
    rng = random.Random(8)
    good = lambda n: " ".join(rng.choice(PROSE.split()) for _ in range(n))
    bad = lambda n: " ".join(rng.choice(["x1", "##", "zz9", "qq"]) for _ in range(n))
    rows = [(i, good(60) if i % 2 else bad(60), "en", "a", 0) for i in range(400)]
    rows += [(400, text_of(rng, 60_000, lambda: 7), "en", "a", 0), (401, good(100_000), "en", "a", 0), (402, None, "en", "a", 0)]
    docs = documents(spark, rows)
    labels = spark.createDataFrame([(i, i % 2) for i in range(403)], "doc_id bigint, label int")
    whole = classifier.train(docs, labels)
    small = classifier.train(docs, labels, fit_bytes=60_000)
    for model in (whole, small):
        assert model.score(good(50)) > 0.5 > model.score(bad(50))
    assert small.bias != whole.bias
