"""Evaluation, clauses, placed chunks, sources, diagnoses and samples against values worked out by hand."""

import math
import random

import pytest
from pyspark.sql import functions as F

from barloom.functions.windows import ordered
from barloom.functions import shared
from barloom.operators import chunks, evaluation, inverted, metrics, retrieval, text
from barloom.sources import bars, samples


def test_retrieval_by_overlap(spark):
    hits = spark.createDataFrame(
        [(1, 1, "cooking pasta at home"), (1, 2, "Financial risk management"), (1, 3, "risk of rain"), (2, 1, "nothing alike"), (3, 1, "x")], "query_id long, rank int, content string"
    )
    expected = spark.createDataFrame([(1, "financial risk management is important"), (1, "风险 rain"), (2, "gold price"), (4, "never asked")], "query_id long, content string")
    marked = {(r.query_id, r["rank"]): r.relevant for r in evaluation.mark_relevant(hits, expected).collect()}
    assert marked == {(1, 1): False, (1, 2): True, (1, 3): True, (2, 1): False, (3, 1): False}
    row = evaluation.evaluate_retrieval(hits, expected, 2).first()
    # Query 1 has one relevant hit of two at rank 2 and two expected; queries 2 and 4 have none.
    assert (row.precision_at_k, row.recall_at_k, row.mrr, row.num_queries) == (round(0.5 / 3, 4), round(0.5 / 3, 4), round(0.5 / 3, 4), 3)


def test_answers_and_keywords(spark):
    cases = spark.createDataFrame([(1, "abab", "abab", "abab cd", ["AB", "zz"]), (2, "", "x y", "", []), (3, "rate", "Rate", "rate", ["Rate"])], "id long, question string, answer string, context string, keywords array<string>")
    got = {r.id: r for r in evaluation.evaluate_answers(cases).collect()}
    assert (got[1].faithfulness, round(got[1].relevancy, 9), round(got[1].overall, 9)) == (0.5, 1.0, 0.75)
    assert (got[2].faithfulness, got[2].relevancy) == (0.0, 0.0)
    by_word = {r.id: r.relevancy for r in evaluation.evaluate_answers(cases, keywords="keywords").collect()}
    assert by_word == {1: 0.5, 2: 0.0, 3: 0.0}  # the answer's own case counts


def test_run_evaluation(spark):
    cases = spark.createDataFrame([(1, "what is risk", "risk is a thing", ["risk"]), (2, "q", "a", [])], "query_id long, question string, answer string, keywords array<string>")
    hits = spark.createDataFrame([(1, 1, "other"), (1, 2, "risk is a thing")], "query_id long, rank int, content string")
    expected = spark.createDataFrame([(1, "risk is a thing")], "query_id long, content string")
    each, summary = evaluation.run_evaluation(cases, hits, expected, k=2)
    got = {r.query_id: r for r in each.collect()}
    assert (got[1].context, got[1].precision, got[1].recall, got[1].mrr, got[1].faithfulness, got[1].relevancy) == ("other risk is a thing", 0.5, 1.0, 0.5, 0.8, 1.0)
    assert (got[2].precision, got[2].recall, got[2].mrr, got[2].num_retrieved, got[2].context) == (0.0, 0.0, 0.0, 0, "")
    row = summary.first()
    assert (row.total_cases, row.precision_at_k, row.mrr, row.faithfulness, row.relevancy, row.overall) == (2, 0.25, 0.25, 0.4, 0.5, 0.45)


def test_unknown_names_raise(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    with pytest.raises(ValueError):
        chunks.split_documents(docs, "nosuch")
    with pytest.raises(ValueError):
        retrieval.reranker("cross_encoder")
    assert retrieval.reranker(" BM25 ") is retrieval.rerank


def test_context_and_sources(spark):
    hits = spark.createDataFrame([("q", 2, "b" * 120, "f.md", None, ""), ("q", 1, "short", "g.md", "7", "T")], "query string, rank int, content string, source string, page string, title string")
    assert text.context(hits, "query", "rank", page="page", title="title").first().context == "[1] (来源: g.md, 页码: 7, 标题: T)\nshort\n\n[2] (来源: f.md)\n" + "b" * 120
    listed = text.source_list(hits, "query", "rank", page="page", title="title").first().sources
    assert listed == "来源列表:\n" + "=" * 50 + "\n\n[1]\n  来源: g.md\n  页码: 7\n  标题: T\n  内容: short\n\n[2]\n  来源: f.md\n  内容: " + "b" * 100 + "..."


def test_diagnoses(spark):
    rows = [("good", 1.6, 21.0, 9.0, 51.0, 30, 10), ("bad", -0.1, -1.0, -35.0, 39.0, 5, 200), ("even", 0.5, 5.0, 20.0, 40.0, 30, 180)]
    df = spark.createDataFrame(rows, "symbol string, sharpe_ratio double, annual_return double, max_drawdown double, win_rate double, total_trades long, max_drawdown_bars long")
    got = {r.symbol: r for r in metrics.diagnosed(df).collect()}
    assert [got["good"][f"second_{m}"] for m in metrics.SECOND] == ["good"] * 4 + ["acceptable"] and got["good"].suggestions == [metrics.SOLID]
    assert [got["bad"][f"second_{m}"] for m in metrics.SECOND] == ["critical", "critical", "critical", "poor", "poor"] and len(got["bad"].suggestions) == 7
    assert got["bad"].weaknesses[2] == "Excessive drawdown (35.0%)" and got["bad"].suggestions[-1].startswith("Long drawdown recovery (200 days)")
    assert [got["even"][f"second_{m}"] for m in metrics.SECOND] == ["poor", "poor", "poor", "poor", "acceptable"]
    assert got["good"].score == round(1.6 / 2 * 30 + 21 / 30 * 25 + (1 - 9 / 50) * 25 + 51 / 100 * 20, 1)


def test_trade_metrics(spark):
    df = spark.createDataFrame([("a", 300.0), ("a", -100.0), ("a", -50.0), ("b", 10.0), ("c", -5.0)], "symbol string, pnl double")
    got = {r.symbol: r for r in metrics.trade_metrics(df, 1000.0).collect()}
    r = [0.3, -0.1, -0.05]
    mean = sum(r) / 3
    assert (got["a"].total_trades, got["a"].won_trades, got["a"].lost_trades, got["a"].profit_factor) == (3, 1, 2, 4.0)
    assert math.isclose(got["a"].volatility, math.sqrt(sum((x - mean) ** 2 for x in r) / 2)) and math.isclose(got["a"].sortino_ratio, mean / math.sqrt(2 * 0.025**2))
    assert got["b"].profit_factor == math.inf and math.isclose(got["b"].sortino_ratio, 0.01 / 0.0001) and got["c"].profit_factor == 0.0 and got["c"].sortino_ratio == 0.0


def test_engine_metrics_of_few_bars_and_open_positions(spark):
    made = samples.sample_bars(spark, ["LONG"], 60).unionByName(samples.sample_bars(spark, ["TINY"], 10))
    n = F.row_number().over(ordered())
    signalled = made.withColumn("__n", n).withColumn("signal", F.when(F.col("__n").isin(3, 20, 55), 1).when(F.col("__n").isin(10, 30), -1).otherwise(0)).drop("__n")
    got = {r.symbol: r for r in metrics.engine_metrics(signalled).collect()}
    assert got["TINY"].total_trades == 0 and got["TINY"].total_return == 0.0 and got["TINY"].n_bars == 10
    close = [r.close for r in made.where("symbol = 'LONG'").orderBy("bar_ts").collect()]
    cash, pnl = 100_000.0, []
    for a, b in ((2, 9), (19, 29)):
        after = cash * (1 - 0.0003) ** 2 * close[b] / close[a]
        pnl.append(after - cash)
        cash = after
    held = cash * (1 - 0.0003) * close[-1] / close[54]
    row = got["LONG"]
    assert row.total_trades == 2 and row.won_trades == sum(p > 0 for p in pnl) and math.isclose(row.total_return, held / 100_000 - 1, rel_tol=1e-9)


def test_a_total_loss_is_no_gap(spark):
    df = spark.createDataFrame([("a", i, r) for i, r in enumerate([0.1, -1.0, 0.2])], "symbol string, bar_ts int, ret double")
    row = metrics.return_metrics(df).first()
    assert row.total_return == -1.0 and row.max_drawdown == -1.0 and row.annual_return == -1.0


def test_overfit_warnings(spark):
    names = ("total_return", "sharpe_ratio", "max_drawdown", "win_rate", "profit_factor")
    inside, outside = ({n: F.lit(v) for n, v in zip(names, values)} for values in ((0.5, 3.5, 0.1, 0.7, 2.5), (-0.2, 0.2, 0.3, 0.3, 0.5)))
    found = metrics.overfit_warnings(inside, outside, F.lit(8))
    row = spark.range(1).select(found.alias("w"), metrics.overfit_advice(found, inside["sharpe_ratio"]).alias("a")).first()
    assert row.w == list(metrics.WARNINGS) and len(row.a) == 11
    calm = metrics.overfit_warnings(inside | {"sharpe_ratio": F.lit(1.0), "win_rate": F.lit(0.5), "profit_factor": F.lit(1.0)}, inside, F.lit(2))
    assert spark.range(1).select(metrics.overfit_advice(calm, F.lit(1.0)).alias("a")).first().a == [metrics.STEADY]


def test_samples(spark):
    made = samples.sample_bars(spark, list(samples.symbols_of("美股", 3)), 30)
    assert made.groupBy("symbol").count().collect()[0]["count"] == 30 and made.select("symbol").distinct().count() == 3
    assert made.where("high < greatest(open, close) or low > least(open, close) or low <= 0").count() == 0
    assert sorted(map(tuple, made.collect())) == sorted(map(tuple, samples.sample_bars(spark, ["MSFT", "GOOGL", "AAPL"], 30).collect()))
    assert made.where("weekday(bar_ts) >= 5").count() == 0 and str(made.agg(F.max("bar_ts")).first()[0])[:10] == "2024-06-28"
    alike = samples.sample_bars(spark, ["A", "B"], 5, seed="x").drop("symbol").distinct()
    assert alike.count() == 5 and made.select("close").distinct().count() > 60
    assert samples.symbols_of("nowhere") == samples.SYMBOLS["A股"] and set(made.columns) == set(bars.COLUMNS)


def test_bm25_top_is_bm25(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(["the cat sat", "the dog", "", None, "cat cat dog the 猫", "the the the", "birds"] * 3)], "doc_id long, text string").repartition(3)
    asked = spark.createDataFrame([(1, "the cat"), (2, "dog dog 猫"), (3, "nothing here"), (4, None)], "item_id long, text string")
    whole = {(r.item_id, r.doc_id): round(r.score, 9) for r in retrieval.bm25(docs, asked).collect()}
    expect = []
    for q in (1, 2, 3, 4):
        best = sorted((-s, d) for (i, d), s in whole.items() if i == q)[:4]
        expect += [(q, n + 1, d, -s) for n, (s, d) in enumerate(best)]
    assert sorted(map(tuple, retrieval.bm25_top(docs, asked, 4).collect())) == expect
    index = inverted.index_of(docs)
    assert sorted(map(tuple, inverted.search(index, asked, 4, at_once=0).collect())) == expect
    assert retrieval.bm25_top(docs.limit(0), asked).count() == 0 and retrieval.bm25_top(docs, asked.limit(0)).count() == 0


def test_skipping_blocks_loses_nothing(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(inverted, "BLOCK_DOCS", 5)
    monkeypatch.setattr(inverted, "BUCKET_TOKENS", 1000)
    monkeypatch.setattr(inverted, "FIRST_POSTINGS", 20)
    rng = random.Random(2)
    words = [f"w{'abcdefghij'[k % 10]}{'xyz'[k % 3]}" * (1 + k // 30) for k in range(90)]
    rows = [(i, " ".join(rng.choice(words[: rng.choice((3, 90))]) for _ in range(rng.randrange(0, 40)))) for i in range(400)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    asked = spark.createDataFrame([(k, " ".join(rng.choice(words) for _ in range(6))) for k in range(15)], "item_id long, text string")
    index = inverted.index_of(docs)
    assert index.buckets > 1 and inverted.index_of(spark.read.parquet(str(tmp_path / "d"))) == index  # found again
    skipped = sorted(map(tuple, inverted.search(index, asked, 5, at_once=0).collect()))
    best = {}
    for r in retrieval.bm25(docs, asked).collect():
        best.setdefault(r.item_id, []).append((-round(r.score, 9), r.doc_id))
    expect = sorted((q, n + 1, d, -s) for q, found in best.items() for n, (s, d) in enumerate(sorted(found)[:5]))
    assert [r[:3] for r in skipped] == [r[:3] for r in expect] and skipped == sorted(map(tuple, inverted.search(index, asked, 5).collect()))
    docs.limit(10).union(docs).write.parquet(str(tmp_path / "e"))
    assert inverted.index_of(spark.read.parquet(str(tmp_path / "e"))).n == 410
    assert inverted.index_of(docs.where("doc_id < 50")).n == 50  # a part of the files isn't the files


def test_bm25_postings_stay_with_their_blocks(spark, tmp_path):
    docs = [(i, " ".join("abcdefg"[: i % 7]) + " b b" * (i % 3)) for i in range(300)]
    spark.createDataFrame([*docs, (300, None), (301, "...")], "doc_id long, text string").write.parquet(str(tmp_path / "d"))
    index = inverted.index_of(spark.read.parquet(str(tmp_path / "d")))
    want = {(i, w, t.split().count(w), len(t.split())) for i, t in docs for w in t.split()}
    assert {(r.id, r.token, r.tf, r.len) for r in index.postings(spark).collect()} == want  # counted in each row
    found = inverted.search(index, spark.createDataFrame([(1, "b d"), (2, "f")], "item_id long, text string"), 4)
    plan = found._jdf.queryExecution().executedPlan().toString()
    dealt = [x for x in plan.splitlines() if "Exchange hashpartitioning" in x]
    # Postings by block once, then the best of each query; no join or sum shuffles (query, document).
    assert sum("hashpartitioning(q#" in x for x in dealt) == 1 and sum("hashpartitioning(block#" in x for x in dealt) == 1 and "SortMergeJoin" not in plan and not any("id#" in x for x in dealt)


def test_hits_are_sent_to_the_documents(spark):
    hits = spark.range(20).withColumnRenamed("id", "doc_id").repartition(3)
    assert "BroadcastHashJoin" in shared.sent_if_few(hits).join(spark.range(10**7).withColumnRenamed("id", "doc_id"), "doc_id")._jdf.queryExecution().executedPlan().toString()
