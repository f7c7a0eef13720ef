"""URL filter, decontamination, toxicity, mixing and the pipeline."""

import re
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.conftest import SMALL
from tests.llm.test_neardup import slow_groups
from usagelens.llm import decontamination, mixing, toxicity, urls
from usagelens.llm.shared import stored, table


def slow_rule(url):
    match = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (match[1], match[2]) if match else ("", "")
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(len(r), r, v) for r, v in urls.RULES if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith(r[r.index("/") :])]
    return host, path, *(max(fits)[1:] if fits else (None, None))


def test_rules_and_trees(spark):
    given = [None, "", "no scheme/en/", "HTTP://WWW.Example.COM/en/1?x=://a/", "https://a.example.com/en/", "https://xexample.com/en/9", "http://É.net/fr/é#", "a://b.net/es", "x://c.com", "://d.com/", "http://e.org/en/" + "q" * 100_000, "s://www.example.com/en/x\ny"]
    given += [f"https://h{i}.example.{t}/{lang}/{i}" for i in range(30) for t in ("com", "net") for lang in ("en", "fr")] + ["http://h.example.net/es/1"] * 50
    pages = spark.createDataFrame(list(enumerate(given)) + [(None, None)], "page_id long, url string").selectExpr("*", "1 AS host", "2 AS label", "3 AS score")
    got = {r.page_id: r for r in urls.judge(pages).collect()}
    for i, url in enumerate(given):
        host, path, rule, verdict = slow_rule(url)
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule)
        assert got[i].verdict == (verdict or got[i].verdict) and got[i].verdict in ("allow", "block")
        assert (got[i].block_score is None) == (rule is not None)
    assert got[None].host == ""
    assert urls.judge(pages.limit(0)).count() == 0
    alone = urls.judge(pages.where("page_id = 0")).collect()
    assert [(r.verdict, r.block_score) for r in alone] == [("allow", 0.0)]


def test_trees_learn_the_rules(spark):
    """Held-out accuracy: trees trained on some labelled URLs judge others whose rule is hidden."""
    pages = table(spark, "/root/testdata/sf0.01", "pages").withColumn("hidden", F.pmod(F.xxhash64("url"), F.lit(4)) == 0)
    shown = pages.withColumn("url", F.when(F.col("hidden"), F.regexp_replace("url", r"example\.(com|net)", "example.$1x")).otherwise(F.col("url")))
    truth = {r.page_id: slow_rule(r.url)[3] for r in pages.collect() if r.hidden}
    got = {r.page_id: r for r in urls.judge(shown).collect()}
    judged = [(got[i].verdict, v) for i, v in truth.items() if v]
    assert all(got[i].rule is None for i in truth)
    assert sum(a == b for a, b in judged) >= 0.6 * len(judged)


def slow_contaminated(docs, items):
    """Plain five-word containment, for texts without numbers or names in the items."""
    words = lambda t: re.findall(r"\w+", t.lower())
    windows = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())
    of_item = {i: windows(words(t)) for i, t in items}
    return {(d, i) for d, t in docs for i, w in of_item.items() if w and len(w & windows(words(t or ""))) >= 0.8 * len(w)}


def test_leaks_of_the_table(spark):
    docs, items = (pd.read_parquet(f"/root/testdata/sf0.01/{n}.parquet") for n in ("documents", "benchmark"))
    got = {(r.doc_id, r.item_id) for r in decontamination.op8_decontamination(spark, "/root/testdata/sf0.01").collect()}
    assert got == slow_contaminated(zip(docs.doc_id, docs.text), zip(items.item_id, items.text)) and got


def test_templates_and_slots(spark, docs):
    items = spark.createDataFrame(
        [(1, "a train leaves at 30 km and then Bob pays 30 dollars for the 12 apples that he eats"), (2, None), (3, ""), (4, "too short"), (5, "1,250.50 usd")],
        "item_id long, text string",
    ).selectExpr("*", "1 AS hash", "2 AS values")
    rows = [
        (1, "intro words. A train leaves at 45 km and then Eve pays 45 dollars for the 7 apples that he eats, indeed"),
        (2, "a train leaves at 45 km and then Eve pays 99 dollars for the 7 apples that he eats"),  # 30 became both 45 and 99
        (3, "a train leaves at 30 km and then Bob pays 30 dollars for the 12 apples that he eats"),
        (4, "trains leave at noon and Bob pays for apples that he likes"),
        (5, None), (6, ""), (7, "Too, short!"), (8, "so too short it is"), (9, "7.5 eur"), (None, "x " * 60_000), (3, "clean text of the same id that shall stay"),
        (None, "a train leaves at 30 km and then Bob pays 30 dollars for the 12 apples that he eats"),
    ]
    got = {(r.doc_id, r.item_id): r for r in decontamination.contamination(docs(*rows), items).collect()}
    assert set(got) == {(1, 1), (3, 1), (None, 1), (7, 4), (9, 5)}
    assert got[3, 1].verbatim and not got[1, 1].verbatim and got[1, 1].containment == 1.0
    assert decontamination.contamination(docs(*rows).limit(0), items).count() == 0
    assert decontamination.contamination(docs(*rows), items.limit(0)).count() == 0


def test_names_at_sentence_starts_and_wrapped_lines(spark, docs):
    text = "a train leaves at 30 km. Bob pays then for the apples. He and Bob eat: (Carl) sees it with joy"
    items = spark.createDataFrame([(1, text), (2, "Yes sir")], "item_id long, text string")
    rows = [
        (1, "words. " + text.replace("Bob", "Eve").replace("Carl", "Otto")), (2, text.replace(" ", "\n")), (3, text.replace(". ", ".\n\n").replace("then", "\tthen")),
        (4, text.lower()), (5, "A" + text[1:]), (6, text.replace("Bob pays", "Eve pays")), (7, text.replace("30 km", "45  mi").replace("Bob", "Eve")),
        (8, "No sir"), (9, "yes sir"), (10, "Yes Sir"), (11, "The bird sings at 30 km. Bob pays none of the pears. He and Bob eat"),
    ]
    got = {(r.doc_id, r.item_id): r for r in decontamination.contamination(docs(*rows), items).collect()}
    assert set(got) - {(6, 1)} == {(1, 1), (2, 1), (3, 1), (4, 1), (5, 1), (7, 1), (9, 2), (10, 2)}
    assert all(got[i, 1].containment == 1.0 for i in (1, 2, 3, 4, 5, 7)) and got[4, 1].verbatim and not got[1, 1].verbatim


def test_benchmark_in_blocks(spark, monkeypatch):
    whole = sorted(map(tuple, decontamination.op8_decontamination(spark, SMALL).collect()))
    monkeypatch.setattr(decontamination, "MAX_WINDOWS", 300)
    assert sorted(map(tuple, decontamination.op8_decontamination(spark, SMALL).collect())) == whole


def test_nearest_examples_are_exact():
    rng = np.random.default_rng(5)

    def vector():
        terms = np.unique(rng.integers(0, 60, rng.integers(1, 9)))
        weights = rng.random(len(terms))
        return terms, weights / np.sqrt((weights**2).sum())

    vectors = [vector() for _ in range(900)]
    vectors += vectors[:40]  # ties
    index = toxicity.BlockMaxIndex(vectors, 60)
    dense = np.zeros((len(vectors), 60))
    for i, (t, w) in enumerate(vectors):
        dense[i, t] = w
    for t, w in [vector() for _ in range(60)] + vectors[:5]:
        scores = dense[:, t] @ w
        order = [i for i in np.lexsort((np.arange(len(scores)), -scores.round(12))) if scores[i] > 0][:25]
        found, cosines = index.nearest(t, w, 25)
        assert np.allclose(cosines, scores[order]) and len(found) == len(order)


def test_monotone_fit():
    x, y = np.array([0.1, 0.2, 0.2, 0.5, 0.9]), np.array([0, 1, 0, 0, 1.0])
    centres, means = toxicity.monotone_fit(x, y)
    assert (np.diff(means) > 0).all() and np.isclose(np.interp(x, centres, means).mean(), y.mean(), atol=0.1)


def test_held_out_toxicity(spark):
    folder = "/root/testdata/sf0.1"
    got = toxicity.op3_toxicity(spark, folder).toPandas()
    assert len(got) == 10_000 and got.score.between(0, 1).all() and ((got.score >= 0.5) == got.predicted).all()
    rows = got.merge(pd.read_parquet(f"{folder}/labels.parquet"), on="doc_id")
    rows = rows[rows.held_out]
    hits = Counter(zip(rows.toxic, rows.predicted))
    assert hits[1, 1] >= 0.85 * (hits[1, 0] + hits[1, 1]) and hits[0, 1] <= 0.02 * (hits[0, 0] + hits[0, 1])


@pytest.mark.parametrize("sf, least, without", [("sf0.001", 1.0, 0), ("sf0.01", 0.8, 3)])
def test_held_out_toxicity_of_few_labels(spark, sf, least, without):
    folder = f"/root/testdata/{sf}"
    rows = toxicity.op3_toxicity(spark, folder).toPandas().merge(pd.read_parquet(f"{folder}/labels.parquet"), on="doc_id")
    toxic = rows[rows.toxic == 1]
    assert (toxic.evidence.map(len) == 0).sum() <= without
    assert toxic[toxic.held_out].predicted.mean() >= least
    assert rows[rows.held_out & (rows.toxic == 0)].predicted.mean() <= 0.12


def test_toxicity_edge_cases(spark, docs):
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(200)] + [(1, None), (None, 1), (5000, 1), (7, 1), (7, 0)], "doc_id long, toxic int")
    rows = [(i, ("foul " if i % 3 == 0 or i == 7 else "kind ") + f"word{i} text") for i in range(220)] + [(None, None), (300, ""), (301, "foul " * 50_000), (301, "foul " * 50_000)]
    got = toxicity.toxicity(docs(*rows), labels).collect()
    by_id = {r.doc_id: r for r in got}
    assert len(got) == len(rows) and by_id[301].predicted == 1 and by_id[210].predicted == 1 and by_id[211].predicted == 0
    assert by_id[None].held_out and 0 <= by_id[300].score <= 1
    frame = docs(*rows)
    kept = toxicity.without_toxic(frame, toxicity.fit(frame, labels))
    assert kept.columns == frame.columns and {r.doc_id for r in kept.collect()} == {r.doc_id for r in got if not r.predicted}
    assert toxicity.toxicity(frame.limit(0), labels).count() == 0
    assert {r.score for r in toxicity.toxicity(frame, labels.limit(0)).collect()} == {0.0}


def test_rates_meet_the_targets(spark):
    rng = np.random.default_rng(4)
    soft = rng.dirichlet([0.3, 0.2, 0.1], 500)
    tokens = rng.integers(1, 900, 500)
    frame = spark.createDataFrame([(int(t), [float(x) for x in p]) for t, p in zip(tokens, soft)], "tokens long, posterior array<double>")
    gram = np.einsum("i,ij,ij->j", tokens, soft, soft)
    for lower, total in ((1.0, None), (0.0, 0.5 * tokens.sum())):
        fit = mixing.fit_rates(frame, [0.4, 0.35, 0.25], lower, total, steps=12)
        rates = np.array([r.rate for r in frame.withColumn("rate", fit.rate()).collect()])
        reached, target = (rates * tokens) @ soft, np.array(fit.target)
        assert rates.min() >= lower and np.allclose(reached, fit.reached, rtol=1e-9)
        best = np.ones(500)  # many small steps of the same descent
        for _ in range(4000):
            best = np.maximum(lower, best - 0.3 * soft @ (((best * tokens) @ soft - target) / gram))
        loss = lambda s: (((s - target) ** 2) / gram).sum()  # noqa: B023, E731
        assert loss(reached) <= 1.05 * loss((best * tokens) @ soft) + 0.02 * loss(tokens @ soft)


def test_mixing_edge_cases(spark, docs):
    rows = [(i, "the of and to in " * 5 if i % 4 else "der die das und ein " * 5) for i in range(80)] + [(None, None), (90, ""), (91, "the of " * 50_000), (5, "the of and to in")]
    frame = docs(*rows).withColumn("lang", F.when(F.col("doc_id") % 4 == 0, "de").otherwise("en"))
    labels = spark.range(80).selectExpr("id AS doc_id", "1 AS quality").union(spark.createDataFrame([(None, 1)], "doc_id long, quality int"))
    goal = {"en": 0.5, "de": 0.5}
    got = mixing.mixing(frame, labels, goal).collect()
    assert len(got) == len(rows) and {r.domain for r in got if r.doc_id is not None and r.doc_id % 4 == 0 and r.doc_id < 80} == {"de"}
    assert all(r.rate >= 1 and r.copies >= 1 and abs(sum(r.posterior) - 1) < 1e-6 for r in got)
    out = mixing.mixed(frame, labels, goal)
    assert out.columns == frame.columns and out.count() == sum(r.copies for r in got)
    assert mixing.mixing(frame.limit(0), labels, goal).count() == 0
    assert {tuple(r.posterior) for r in mixing.mixing(frame, labels.limit(0), goal).collect()} == {(0.5, 0.5)}


def test_pipeline_stages(spark):
    """Every stage's decisions take effect: its output against its operator's rows on its own input."""
    docs = table(spark, SMALL, "documents")
    names = docs.columns
    from usagelens.llm.shared import stored

    for name, stage in corpus_pipeline.STAGES:
        before, out = docs, stored(stage(spark, docs, SMALL), name)
        ids = Counter(r.doc_id for r in out.select("doc_id").collect())
        if name == "toxicity":
            model = toxicity.fit(before, table(spark, SMALL, "labels"))
            assert set(ids) == {r.doc_id for r in toxicity.scored(before, model).where("predicted = 0").collect()}
        if name == "near_dedup":
            rows = before.select("doc_id", "text").collect()
            assert set(ids) == set(slow_groups(rows).values())
        if name == "decontamination":
            bad = {r.doc_id for r in decontamination.contamination(before, table(spark, SMALL, "benchmark")).collect()}
            assert set(ids) == {r.doc_id for r in before.select("doc_id").collect()} - bad
        if name == "mixing":
            assert ids == Counter({r.doc_id: r.copies for r in mixing.mixing(before, table(spark, SMALL, "labels")).collect()})
        if name == "tokens":
            assert sum(ids.values()) == before.count()
        else:
            assert out.columns == names
        docs = out


@pytest.mark.parametrize("case", ["empty", "null texts", "extra columns"])
def test_pipeline_stages_on_awkward_tables(spark, docs, case):
    known = table(spark, SMALL, "documents")
    frame = {
        "empty": known.limit(0), "null texts": known.withColumn("text", F.lit(None).cast("string")).limit(30),
        "extra columns": docs((1, "some plain words of a text"), (None, None), (3, "x " * 4000), (3, ""), (4, "\t")),
    }[case]
    before = frame
    for name, stage in corpus_pipeline.STAGES:
        out = stored(stage(spark, before, SMALL), name)
        assert name == "tokens" or out.columns == frame.columns
        ids = {r.doc_id for r in out.select("doc_id").collect()}
        assert ids <= {r.doc_id for r in before.select("doc_id").collect()} and (case == "empty" or ids)
        before = out


@pytest.mark.parametrize("name", ["op1_pii", "op2_sharding", "op3_toxicity", "op4_tokens", "op5_urls", "op6_warc", "op7_mixing", "op8_decontamination", "op9_simhash", "op10_topk", "op11_repeats", "op12_resampling", "op13_fim", "pipeline"])
def test_registered(name):
    import __spark_entry__ as entry

    assert name in entry.queries()
