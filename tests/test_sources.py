import json

import pytest
from pyspark.sql import functions as F

from barloom.functions import prompts
from barloom.operators import metrics, reports
from barloom.sources import datasets, documents


def test_documents(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.md").write_text("# One\nx\n## Two\ny")
    (tmp_path / "sub" / "b.txt").write_text("p\n\nq")
    (tmp_path / "c.bin").write_text("no")
    got = documents.read(spark, str(tmp_path)).orderBy("source", "pos").collect()
    assert [(r.source, r.title, r.doc_type) for r in got] == [("a", "One", "markdown"), ("a", "Two", "markdown"), ("b", "b_para_0", "text"), ("b", "b_para_1", "text")]


def test_vector_collection(spark, tmp_path):
    store = documents.VectorCollection(spark, str(tmp_path / "v"))
    rows = spark.createDataFrame([(i, f"c{i}", {"k": None}, [float(i), 1.0]) for i in range(5)], store.SCHEMA)
    store.add(rows)
    assert store.count() == 5 and store.rows().first().metadata == {"k": ""}
    got = store.search(rows.where("vec_id = 3").select("vec_id", "embedding"), 2).orderBy("rank").collect()
    assert [r.vec_id for r in got] == [3, 4] and got[0].query_id == 3 and got[0].distance == pytest.approx(0)
    store.clear()
    assert store.count() == 0


def test_datasets(spark, tmp_path):
    rows = [{"instruction": "i", "input": "x", "output": "bullish", "category": c} for c in ("sentiment", "qa", "other")]
    (tmp_path / "a.jsonl").write_text("\n".join(map(json.dumps, rows)) + "\n\n")
    (tmp_path / "a.json").write_text(json.dumps(rows))
    assert datasets.load(spark, str(tmp_path / "a.jsonl")).count() == datasets.load(spark, str(tmp_path / "a.json")).count() == 2
    with pytest.raises(ValueError):
        datasets.load(spark, "a.csv")
    made = datasets.generate(spark, 10)
    assert made.count() == 10 and {r.category for r in made.collect()} == set(datasets.CATEGORIES)
    datasets.save(made, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 10
    assert datasets.formatted(made, "alpaca").columns == ["instruction", "input", "output"]
    assert [m.role for m in datasets.formatted(made, "chatml").first().messages] == ["system", "user", "assistant"]
    with pytest.raises(ValueError):
        datasets.formatted(made, "csv")
    got = {r.category: r for r in datasets.evaluate(made.withColumn("prediction", F.col("output"))).collect()}
    assert got["sentiment"].accuracy == 1 and got["qa"].bleu1 == pytest.approx(1) and got["qa"].rouge_l == pytest.approx(1)


def test_reports(spark):
    df = spark.createDataFrame([("A", 0.15, 0.08, 0.6, 0.35, 0.42, 8)], "symbol string, total_return double, annual_return double, sharpe_ratio double, max_drawdown double, win_rate double, total_trades long")
    rated = metrics.rated(df)
    said = reports.report(rated).first().report
    assert "Max Drawdown: 0.3500 (critical)" in said and "Warnings:\n  Max Drawdown" in said
    assert "| Win Rate | 0.4200 | acceptable |" in reports.report(rated, form="markdown").first().report
    assert json.loads(reports.report(rated, form="json").first().report)["metrics"]["win_rate"]["rating"] == "acceptable"
    with pytest.raises(ValueError):
        reports.report(rated, form="pdf")
    bands = spark.range(1).select(reports.risk_band("sharpe", F.lit(1.0)).alias("a"), reports.risk_band("drawdown", F.lit(0.15)).alias("b"), reports.risk_band("win_rate", F.lit(0.1)).alias("c")).first()
    assert tuple(bands) == ("good", "medium", "low")


def test_prompts(spark):
    df = spark.createDataFrame([("why?", None)], "q string, n string")
    assert df.select(prompts.fill("rewrite", question=F.col("q")).alias("p")).first().p.endswith(": why?")
    assert df.select(prompts.fill("rewrite", question=F.col("n")).alias("p")).first().p.endswith(": $question")
    assert prompts.names() == sorted(prompts.TEMPLATES)
    with pytest.raises(ValueError):
        prompts.add("answer", "x")
