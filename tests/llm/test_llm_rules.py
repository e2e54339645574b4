"""Quality rules, mixing, language, classifier, pipeline."""

import random
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from llm_rows import PROSE, documents, odd_documents, rows_of
from tickwarden.llm import classifier, langid, mixing, packing, quality_rules, simhash
from tickwarden.llm.oracle import ORACLE

SMALL, MEDIUM = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _plain_statistics(text):
    ws = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    seen, covered = {}, set()
    for i in range(len(ws) - 2):
        seen.setdefault(tuple(ws[i : i + 3]), []).append(i)
    for at in seen.values():
        if len(at) > 1:
            covered |= {i + k for i in at for k in range(3)}
    dup = sum(x in lines[:i] for i, x in enumerate(lines))
    return len(ws), sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(covered), len(lines)


@pytest.mark.parametrize("text", [
    None, "", " \n", "a", "a b c", "a a a a a", "a b c a b c", "x\ny\nx\n \nx", "é # b c * <|>\n\x1c\n", "ab " * 9 + "c d",
    "p q r s p q t r s p q r",
])
def test_statistics_match_the_definition(text):
    assert quality_rules.text_statistics(text) == _plain_statistics(text)


def test_statistics_of_random_texts():
    rng = random.Random(1)
    for _ in range(200):
        text = "".join(rng.choice(["a", "b", "c", " ", " ", "\n", "#"]) for _ in range(rng.randrange(60)))
        assert quality_rules.text_statistics(text) == _plain_statistics(text)


def test_quality_rules_separate_labelled_rows(spark):
    docs = spark.read.parquet(f"{MEDIUM}/documents.parquet")
    labels = spark.read.parquet(f"{MEDIUM}/labels.parquet")
    out = quality_rules.judge(docs)
    joined = out.join(labels, "doc_id").groupBy("quality", "base_failed", "kept").count().collect()
    n = {(r.quality, r.base_failed, r.kept): r["count"] for r in joined}
    assert n.get((0, False, True), 0) <= 0.02 * sum(v for k, v in n.items() if k[0] == 0)
    assert n.get((1, False, False), 0) <= 0.01 * sum(v for k, v in n.items() if k[0] == 1)
    kept = quality_rules.keep(docs)
    assert kept.columns == docs.columns
    assert rows_of(kept, "doc_id") == rows_of(out.where("kept"), "doc_id")


def test_quality_rules_resist_a_contaminated_source(spark):
    """A fifth of a source is junk; the core estimate is not drawn to it."""
    rng = random.Random(3)
    clean = lambda: " ".join(rng.choice(PROSE.split()) + rng.choice(["", "s", "ing", "er"]) + str(rng.randrange(99)) for _ in range(80))
    junk = lambda: " ".join(rng.choice(PROSE.split()) * 2 + "###" + str(rng.randrange(999)) for _ in range(80))
    rows = [(i, junk() if i % 5 == 0 else clean(), "en", "a", 0) for i in range(400)]
    got = {r.doc_id: r.kept for r in quality_rules.judge(documents(spark, rows)).collect()}
    assert not any(got[i] for i in range(0, 400, 5)) and all(got[i] for i in range(400) if i % 5)


def test_quality_rules_reject_repetition_and_symbols_in_a_clean_source(spark):
    rng = random.Random(9)
    line = lambda: " ".join(rng.choice(PROSE.split()) + str(rng.randrange(10_000)) for _ in range(8))
    mixed = lambda n, menus: "\n".join(x for i in range(n) for x in ([line(), "menu"] if i < menus else [line()]))

    def repeated(share):  # a passage twice, across lines that differ
        words_ = [w for _ in range(15) for w in line().split()][: 120 - int(share * 60)]
        return " ".join(words_ + words_[: int(share * 60)])

    rows = [(i, "\n".join(line() for _ in range(15)), "en", "a", 0) for i in range(400)]
    bad = [mixed(13, 7), mixed(12, 8), mixed(9, 9), repeated(0.35), repeated(0.45), mixed(12, 4) + "\n" + "# " * 14]
    rows += [(1000 + i, t, "en", "a", 0) for i, t in enumerate(bad)]
    got = {r.doc_id: r for r in quality_rules.judge(documents(spark, rows)).collect()}
    assert not any(got[1000 + i].base_failed for i in range(len(bad)))
    assert [i for i in range(len(bad)) if got[1000 + i].kept] == []
    assert all(got[i].kept for i in range(400))


def test_covariance_floors_leave_wide_directions_alone():
    floors = np.array(quality_rules.FLOORS)
    wide = np.diag(np.square(2 * floors))
    _, inverse, _ = quality_rules._shape(np.zeros(4), wide)
    assert np.allclose(np.linalg.inv(np.reshape(inverse, (4, 4))), wide)
    _, inverse, _ = quality_rules._shape(np.zeros(4), np.zeros((4, 4)))
    assert np.allclose(np.linalg.inv(np.reshape(inverse, (4, 4))), np.diag(np.square(floors)))


def test_quality_rules_odd_documents(spark):
    docs = documents(spark, clash=True)
    got = rows_of(quality_rules.judge(docs), "doc_id", *quality_rules.STATS, "base_failed", "kept")
    want = []
    for d, t, *_ in odd_documents():
        s = _plain_statistics(t)
        failed = s[0] < 50 or 100 * s[4] > 50 * s[0]
        want.append((d, *s, failed, not failed))
    assert got == sorted(want, key=str)
    kept = quality_rules.keep(docs)
    assert kept.columns == docs.columns and kept.count() == sum(w[-1] for w in want)
    assert quality_rules.judge(documents(spark, [])).count() == quality_rules.keep(documents(spark, [])).count() == 0


# ------------------------------------------------------------------- mixing


def _plain_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(names)}
    target, full = dict.fromkeys(names, 0.0), {s for s in names if not sizes[s]}
    left = 1.5 * sum(sizes.values())
    while len(full) < len(names):
        share = sum(weight[s] for s in names if s not in full)
        room = left - sum(2.0 * sizes[s] for s in full)
        over = {s for s in names if s not in full and weight[s] * room / share > 2 * sizes[s]}
        if not over:
            target.update({s: weight[s] * room / share for s in names if s not in full})
            break
        full |= over
    target.update({s: 2.0 * sizes[s] for s in full})
    return target


def test_targets_and_copies(spark):
    rng = random.Random(8)
    rows = [(i, "w " * rng.randrange(30), "en", rng.choice(["a", "b", "B", "é", None, "zz", "a", "a", "a"]), 0) for i in range(800)]
    docs = documents(spark, rows, clash=True)
    plan = mixing.mix_plan(docs).toPandas()
    plan["source"] = plan["doc_id"].map({r[0]: r[3] for r in rows})
    sizes = {}
    for r in rows:
        sizes[r[3]] = sizes.get(r[3], 0) + len(WORD.findall(r[1]))
    want = _plain_targets(sizes)
    for source, part in plan.groupby("source", dropna=False):
        source = source if isinstance(source, str) else None
        assert part["target"].iloc[0] == pytest.approx(want[source]) and part["source_size"].iloc[0] == sizes[source]
        assert part["taken"].sum() == pytest.approx(want[source], rel=0.25)
    assert (plan["taken"] <= 2 * plan["size"]).all() and sum(want.values()) == pytest.approx(1.5 * sum(sizes.values()))
    again = mixing.mix_plan(docs.repartition(3))
    assert rows_of(again, "doc_id", "taken") == sorted(zip(plan["doc_id"], plan["taken"]), key=str)
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    n = {r.doc_id: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    assert n == {d: c for d, c in zip(plan["doc_id"], plan["copies"]) if c}


def test_mixing_odd_documents(spark):
    docs = documents(spark, clash=True)
    plan = mixing.mix_plan(docs).collect()
    assert len(plan) == len(odd_documents()) and all(r.taken <= 2 * r["size"] for r in plan)
    assert {r.target for r in plan if r.doc_id == 12} == {0.0}
    assert mixing.mix(docs).count() == sum(r.copies for r in plan)
    assert mixing.mix_plan(documents(spark, [])).count() == mixing.mix(documents(spark, [])).count() == 0
    blank = documents(spark, [(1, "", "en", "a", 0), (2, None, "en", None, 0)])
    assert rows_of(mixing.mix_plan(blank), "doc_id", "target", "taken") == [(1, 0.0, 0), (2, 0.0, 0)]


# ----------------------------------------------------------------- language


def test_language_of_held_out_rows(spark):
    docs = spark.read.parquet(f"{MEDIUM}/documents.parquet")
    got = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(got) > 100 and np.mean([r.lang == r.lang_pred for r in got]) > 0.97
    assert all(0 <= r.score <= 1 for r in got)


def test_mixture_selects_the_languages_of_a_text(spark):
    docs = spark.read.parquet(f"{MEDIUM}/documents.parquet").where("n_chars > 1500")
    model = langid.Model.of(langid.train(langid.training_rows(docs)))
    text = {r.lang: r.text for r in docs.groupBy("lang").agg(F.min("text").alias("text")).collect()}
    mixed = text["de"][:900] + " " + text["es"][:500]
    lang, score = model.predict(mixed)
    assert lang == "de" and 0.5 < score < 0.8
    pure, one = model.predict(text["de"])
    assert pure == "de" and one > 0.9


def test_language_odd_documents(spark):
    docs = documents(spark, clash=True)
    got = {r.doc_id: r for r in langid.identify(docs).collect() if r.doc_id is not None}
    for d in (1, 2, 3, 7):
        assert (got[d].lang_pred, got[d].score) == ("und", 0.0)
    assert got[4].lang_pred == "en"
    assert [r.held_out for r in langid.identify(docs).where("doc_id is null").collect()] == [None, None]
    kept = langid.keep(docs)
    assert kept.columns == docs.columns and {1, 2, 3, 7}.isdisjoint({r.doc_id for r in kept.collect()})
    assert langid.identify(documents(spark, [])).count() == langid.keep(documents(spark, [])).count() == 0
    unlabelled = documents(spark, [(1, "some text", None, "a", 0)])
    assert [tuple(r) for r in langid.identify(unlabelled).select("lang_pred", "score").collect()] == [("und", 0.0)]


# --------------------------------------------------------------- classifier


def test_classifier_on_held_out_rows(spark):
    docs = spark.read.parquet(f"{MEDIUM}/documents.parquet")
    labels = spark.read.parquet(f"{MEDIUM}/labels.parquet")
    out = classifier.score(docs, labels)
    assert out.count() == docs.count()
    got = out.join(labels, "doc_id").where("held_out").collect()
    assert np.mean([r.predicted == r.quality for r in got]) > 0.95
    good = [r.score for r in got if r.quality == 1]
    bad = [r.score for r in got if r.quality == 0]
    assert np.mean([g > b for g in good for b in bad]) > 0.98


def test_dual_descent_separates_and_respects_its_bounds():
    rows = [np.array([0, 1]), np.array([0, 2]), np.array([3, 1]), np.array([3, 2])] * 5
    y = np.array([1.0, 1.0, -1.0, -1.0] * 5)
    w, bias = classifier.dual_descent(rows, y, np.ones(4))
    assert all(np.sign(w[f].sum() / np.sqrt(2) + bias) == t for f, t in zip(rows, y))
    ratio = classifier.log_ratios(np.array([[0, 5.0], [5.0, 0]]), np.array([5.0, 5.0]))
    assert ratio[0] > 0 > ratio[1]


def test_classifier_odd_rows(spark):
    docs = documents(spark, clash=True)
    labels = spark.createDataFrame(
        [(4, 1, 0), (4, 1, 0), (5, 0, 0), (6, None, 0), (8, 0, 1), (9, 1, 0), (None, 1, 0), (99, 0, 0), (10, 1, 0), (1, 0, 0)],
        "doc_id bigint, quality int, toxic int")
    out = classifier.score(docs, labels).collect()
    assert len(out) == len(odd_documents()) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in out)
    none = classifier.score(docs, labels.limit(0)).select("score").distinct().collect()
    assert [r.score for r in none] == [0.5]
    one = classifier.score(docs, labels.where("quality = 1")).select("predicted").distinct().collect()
    assert [r.predicted for r in one] == [1]
    assert classifier.score(documents(spark, []), labels).count() == 0


# ----------------------------------------------------------------- pipeline


def test_pipeline_stages_take_effect(spark):
    docs = spark.read.parquet(f"{MEDIUM}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality_rules", "language_id", "simhash_near_dedup", "source_mixing", "best_fit_packing"]
    one = stages["quality_rules"](spark, docs, MEDIUM).cache()
    texts = {r.doc_id: r.text for r in one.collect()}
    passing = {r.doc_id for r in docs.collect()
               if (s := _plain_statistics(r.text))[0] >= 50 and 100 * s[4] <= 50 * s[0]}
    assert set(texts) <= passing and len(texts) > 0.9 * len(passing)
    two = stages["language_id"](spark, one, MEDIUM).cache()
    assert two.count() > 0.98 * one.count()
    three = stages["simhash_near_dedup"](spark, two, MEDIUM).cache()
    prints = sorted((r.doc_id, simhash.fingerprint(r.text)) for r in two.collect())
    groups = {}
    for d, f in prints:  # all pairs, smallest id first
        near = [g for g in groups if any((f ^ x).bit_count() <= 3 for x in groups[g])]
        groups.setdefault(near[0] if near else d, []).append(f)
        for g in near[1:]:
            groups[near[0]] += groups.pop(g)
    assert sorted(r.doc_id for r in three.collect()) == sorted(groups)
    four = stages["source_mixing"](spark, three, MEDIUM).cache()
    copies = {r.doc_id: r.copies for r in mixing.mix_plan(three).collect()}
    assert four.count() == sum(copies.values())
    for df in (one, two, three, four):
        assert df.columns == docs.columns
    five = stages["best_fit_packing"](spark, four, MEDIUM)
    assert five.where("piece = 0").count() == four.count()
    assert five.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 1024").count() == 0


def test_pipeline_of_odd_and_of_no_documents(spark):
    for docs in (documents(spark, clash=True), documents(spark, [])):
        names = docs.columns
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, "")
            assert docs.columns == names
        corpus_pipeline.pack(spark, docs, "").collect()


# ------------------------------------------------------------------ oracles


@pytest.mark.parametrize("key", sorted(ORACLE))
def test_queries_match_sql(spark, key):
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings", "labels", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMALL}/{t}.parquet')")
    df = entry.queries()[key](spark, SMALL)
    rel = con.sql(entry.oracle_sql()[key])
    assert sorted(df.columns) == sorted(rel.columns)
    names = sorted(df.columns)
    assert rows_of(df, *names) == sorted((tuple(r) for r in rel.select(*names).fetchall()), key=str)


def test_every_operator_is_registered():
    names = [k for k in entry.queries() if k.startswith("op")]
    assert [int(k[2:].split("_")[0]) for k in names] == list(range(1, 14)) and "pipeline" in entry.queries()
