"""The registered queries: each takes (spark, sf_dir) and returns a DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.functions.shared import cut_lineage, sent_if_few
from barloom.functions.windows import ordered
from barloom.operators import backtest, chunks, evaluation, indicators as ind, metrics, optimise, patterns, retrieval, search, signals, sizing, text
from barloom.plans import screen
from barloom.sources import bars

C = screen.Condition
Query = Callable[[SparkSession, str], DataFrame]
GRID = optimise.grid(fast=[5, 10], slow=[20, 30])
TRIED = [
    *[("ema_cross", p) for p in optimise.grid(fast=[5, 10], slow=[20])],
    *[("rsi", p) for p in optimise.grid(n=[14], low=[40.0, 45.0], high=[60.0])],
    *[("bands", p) for p in optimise.grid(n=[20], k=[1.0, 1.5])],
]
RANDOM = optimise.random_combinations({"fast": [3, 15], "slow": [20, 30, 40]}, 4)


def _six(name: str, df: DataFrame) -> Column:
    return (F.round(F.col(name), 6) + F.lit(0.0)).alias(name) if df.schema[name].dataType.typeName() == "double" else F.col(name)


def show(df: DataFrame, *columns: str, keys: tuple[str, ...] = ("symbol", "bar_ts")) -> DataFrame:
    """Keys and columns; floats at six places, without negative zero."""
    return df.select(*keys, *[_six(c, df) for c in columns])


def over_hours(build: Callable[[DataFrame], DataFrame], *columns: str) -> Query:
    return lambda spark, sf_dir: show(build(bars.hourly(spark, sf_dir)), *columns)


def rsi_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A strategy that trades often: smoothed hourly bars, limits near the middle."""
    return signals.rsi_extreme(trend(spark, sf_dir), oversold=45.0, overbought=60.0)


def trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars.smoothed(bars.hourly(spark, sf_dir))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assistant turns with the user turn before them."""
    t = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    asked = t.where("role = 'user'").select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("question"))
    return t.where("role = 'assistant'").select("conv_id", "turn", F.col("text").alias("answer")).join(asked, ["conv_id", "turn"])


def shortened(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signals over the first bars of each symbol, 25 and 5 for each letter of its name, so that some have fewer than fifty."""
    first = bars.hourly(spark, sf_dir).withColumn("n", F.row_number().over(ordered())).where(F.col("n") <= 25 + 5 * F.length("symbol")).drop("n")
    return signals.rsi_extreme(first, oversold=45.0, overbought=60.0)


def _metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.backtest_metrics(rsi_signals(spark, sf_dir))


BT = ("total_return", "annual_return", "sharpe_ratio", "max_drawdown", "win_rate", "profit_factor")
BY = ("symbol",)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbols judged by closing above their 20-bar mean and RSI below 70, with the latest values."""
    plan = screen.Screen((screen.Condition("SMA", "above", params={"period": 20}), screen.Condition("RSI", "below", 70.0)), days=365)
    found = screen.run(plan, bars.hourly_by_group(spark, sf_dir))
    values = [F.col("indicators")[k].alias(n) for k, n in (("close", "close"), ("sma_20.sma", "sma"), ("rsi_14.rsi", "rsi"))]
    return found.select("symbol", "matched", "explanation", *values)


def _screened(*conditions: screen.Condition, days: int = 365) -> Query:
    return lambda spark, sf_dir: screen.run(screen.Screen(conditions, days), bars.hourly_by_group(spark, sf_dir)).select("symbol", "matched", "explanation")


def diagnoses(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = metrics.diagnosed(metrics.in_percent(_metrics(spark, sf_dir)))
    listed = [F.array_join(c, "|").alias(c) for c in ("strengths", "weaknesses", "suggestions")]
    return made.select("symbol", *[f"second_{m}" for m in metrics.SECOND], "score", *listed)


def engine(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = metrics.engine_metrics(rsi_signals(spark, sf_dir))
    whole = ("n_bars", "total_trades", "won_trades", "lost_trades", "max_drawdown_bars")
    return show(made, *whole, "total_return", "annual_return", "sharpe_ratio", "max_drawdown", "win_rate", "profit_factor", "sortino_ratio", "volatility", "calmar_ratio", keys=BY)


def overfit_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = optimise.overfit(trend(spark, sf_dir), 5, 20, 0.5, report=True)
    return made.select("symbol", F.array_join("warnings", ",").alias("warnings"), F.array_join("recommendations", "|").alias("recommendations"))


def side_by_side(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = [r.symbol for r in bars.symbols(bars.hourly(spark, sf_dir)).orderBy("symbol").limit(2).collect()]  # two names
    made = metrics.side_by_side(_metrics(spark, sf_dir), names)
    return show(made.toDF("metric", "first", "second"), "first", "second", keys=("metric",))


def _bm25_hits(spark: SparkSession, sf_dir: str, k: int = 5) -> tuple[DataFrame, DataFrame]:
    """(hits with content, expected): each benchmark item looks for documents and expects its own text."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    hits = sent_if_few(bm25_topk(spark, sf_dir).where(F.col("rank") <= k)).join(documents(spark, sf_dir).select("doc_id", F.col("text").alias("content")), "doc_id")
    return cut_lineage(hits.select(F.col("item_id").alias("query_id"), "rank", "content")), items.select(F.col("item_id").alias("query_id"), F.col("text").alias("content"))


def retrieval_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.evaluate_retrieval(*_bm25_hits(spark, sf_dir))


def relevant_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.mark_relevant(*_bm25_hits(spark, sf_dir)).select("query_id", "rank", "relevant")


def answer_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers held against their questions and, as context, question and answer's first half."""
    cases = turns(spark, sf_dir).withColumn("context", F.concat("question", F.lit(" "), F.expr("substring(answer, 1, length(answer) div 2)")))
    return show(evaluation.evaluate_answers(cases), "faithfulness", "relevancy", "overall", keys=("conv_id", "turn"))


def full_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items as questions; the best hit stands for the answer, and the item's first two words are expected in it."""
    hits, expected = _bm25_hits(spark, sf_dir)
    answers = hits.where("rank = 1").select("query_id", F.col("content").alias("answer"))
    cases = expected.select("query_id", F.col("content").alias("question")).join(answers, "query_id").withColumn("keywords", F.slice(F.split("question", " "), 1, 2))
    return evaluation.run_evaluation(cases, hits, expected)[1]


def clause_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as documents with an article for each turn, so that headings occur; clauses below the limit of a second cut."""
    t = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    part = F.concat(F.when(F.col("turn") % 3 == 0, F.concat(F.lit("第"), (F.col("turn") + 1).cast("string"), F.lit("條 "))).otherwise(F.concat(F.lit("ARTICLE "), (F.col("turn") + 1).cast("string"), F.lit("\n"))), F.substring("text", 1, 300))
    docs = t.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", part.alias("p")))), lambda x: x["p"]), "\n").alias("text"))
    made = chunks.split_documents(docs, "financial", "conv_id")
    return made.select("conv_id", "pos", F.md5("chunk").alias("digest"), "start_idx", "end_idx", "chunk_id")


def labels_matched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Made predictions and expectations, by document number, through the label rules."""
    d = documents(spark, sf_dir).select("doc_id")
    names = F.array(*map(F.lit, ("bullish", "bearish", "neutral")))
    pick = lambda n: F.get(names, n.cast("int"))
    said = F.concat(F.lit("It looks "), F.initcap(pick(F.col("doc_id") % 3)), F.when(F.col("doc_id") % 5 == 0, F.lit(", not Bullish")).otherwise(F.lit("")))
    said = F.when(F.col("doc_id") % 11 == 0, F.lit("no view")).otherwise(said)
    made = d.select("doc_id", text.label_found(said).alias("label"), text.label_correct(said, F.concat(F.lit("Sentiment: "), pick(F.col("doc_id") % 2))).alias("correct"))
    return made


def cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return retrieval.vector_top(v, v.where("vec_id % 50 = 0"))


def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = retrieval.bm25_top(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("item_id", "rank", "doc_id", F.round("score", 6).alias("score"))


def ir_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    label = v.select("vec_id", "label")
    asked = label.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("label").alias("wanted"))
    ranked = cosine_topk(spark, sf_dir).join(label, "vec_id").join(asked, "query_id").select("query_id", "rank", (F.col("label") == F.col("wanted")).alias("relevant"))
    sizes = label.groupBy("label").agg((F.count(F.lit(1)) - 1).alias("n_expected"))
    return retrieval.ir_metrics(ranked, asked.join(sizes, asked["wanted"] == sizes["label"]).select("query_id", "n_expected"))


def rerank_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    asked = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.col("item_id").alias("query_id"), F.col("text").alias("query_text"))
    hits = sent_if_few(bm25_topk(spark, sf_dir).select(F.col("item_id").alias("query_id"), "doc_id", (F.col("score") / 100).alias("score"), F.col("rank").alias("pos")))
    return show(retrieval.reranker("bm25")(cut_lineage(hits.join(docs, "doc_id")).join(asked, "query_id")), "score", keys=("query_id", "rank", "doc_id"))


def hybrid_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vector hits of the documents that share an id with an embedding, three times as many as are kept, blended with token overlap."""
    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    docs = documents(spark, sf_dir).select("doc_id", "text")
    hits = retrieval.vector_top(v, v.where("vec_id % 50 = 0"), k=30).select("query_id", F.col("vec_id").alias("doc_id"), (1 - F.col("score")).alias("distance"))
    return show(retrieval.hybrid(hits, docs, docs.withColumnRenamed("doc_id", "query_id")), "score", keys=("query_id", "rank", "doc_id"))


def mmr_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    pool = retrieval.vector_top(v, v.where("vec_id % 50 = 0"), k=20)
    made = retrieval.mmr(pool.join(v.select("vec_id", F.col("embedding").cast("array<double>").alias("v")), "vec_id").withColumnRenamed("score", "relevance"))
    return show(made, "distance", keys=("query_id", "rank", "vec_id"))


def hard_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", F.posexplode(chunks.hard_cut(F.col("text"))).alias("pos", "chunk")).select("doc_id", "pos", F.md5("chunk").alias("digest"))


def cited(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    n = lambda c: c.cast("string")
    said = F.concat(F.lit("see ["), n(F.col("turn") + 1), F.lit("] and ["), n(F.col("conv_id") % 5), F.lit("] then ["), n(F.col("turn") + 1), F.lit("]"))
    return t.select("conv_id", "turn", F.array_join(text.citations(said), ",").alias("cites"), text.citations_valid(said, F.lit(4)).alias("valid"))


def queries() -> dict[str, Query]:
    found: dict[str, Query] = {
        "bars_hourly": bars.hourly,
        "bars_orders_daily": bars.daily_orders,
        "last_bars": lambda s, d: bars.last_bars(bars.hourly(s, d), 30).select("symbol", "bar_ts", "close"),
        "symbols": lambda s, d: bars.symbols(bars.hourly(s, d)),
        "sma20": over_hours(ind.sma, "sma"),
        "sma20_partial": over_hours(lambda b: ind.sma(b, partial=True), "sma"),
        "wma10": over_hours(lambda b: ind.wma(b, 10), "wma"),
        "bollinger20": over_hours(ind.bollinger, "boll_mid", "boll_upper", "boll_lower"),
        "bollinger_bandwidth": over_hours(lambda b: ind.bandwidth(ind.bollinger(b)), "boll_bandwidth"),
        "bollinger_pct_b": over_hours(lambda b: ind.percent_b(ind.bollinger(b)), "boll_pct_b"),
        "stochastic14": over_hours(ind.stochastic, "stoch_k", "stoch_d"),
        "williams_r14": over_hours(ind.williams_r, "williams_r"),
        "atr_sma14": over_hours(ind.atr_sma, "atr"),
        "donchian": over_hours(ind.donchian, "don_upper", "don_lower", "don_mid"),
        "breakout": over_hours(ind.breakout, "breakout_up", "breakout_down"),
        "zscore20": over_hours(ind.zscore, "zscore"),
        "rsi_sma14": over_hours(ind.rsi_sma, "rsi"),
        "ema20": over_hours(ind.ema, "ema"),
        "macd": over_hours(ind.macd, "macd", "macd_signal", "macd_hist"),
        "rsi_wilder14": over_hours(ind.rsi_wilder, "rsi"),
        "rsi_span14": over_hours(ind.rsi_span, "rsi"),
        "kdj": over_hours(ind.kdj, "k", "d", "j"),
        "atr_ema14": over_hours(ind.atr_ema, "atr"),
        "keltner": over_hours(ind.keltner, "kelt_mid", "kelt_upper", "kelt_lower"),
        "returns": over_hours(ind.returns, "ret"),
        "cross_sma": over_hours(lambda b: ind.crossunder(ind.crossover(ind.sma(b), "close", "sma"), "close", "sma"), "crossover", "crossunder"),
        "patterns": over_hours(patterns.scan, *patterns.NAMES),
        "pattern_summary": lambda s, d: patterns.summary(patterns.scan(bars.hourly(s, d))),
        "trades": lambda s, d: show(backtest.trades(rsi_signals(s, d)), "entry_price", "exit_price", "return_pct", "bars_held", keys=("symbol", "entry_ts", "exit_ts")),
        "sized_trades": lambda s, d: show(sizing.sized_trades(rsi_signals(s, d), cash=1_000.0), "shares", "entry_price", "exit_price", "pnl", "cash_after", keys=("symbol", "entry_ts", "exit_ts")),
        "sized_results": lambda s, d: show(sizing.sized_results(rsi_signals(s, d), cash=1_000.0), "n_bars", "total_trades", "cash", "shares", "value", "total_return", "win_rate", keys=BY),
        "strategy_results": lambda s, d: metrics.strategy_results(shortened(s, d)),
        "equity_log": lambda s, d: show(backtest.drawdown(backtest.equity(rsi_signals(s, d))), "log_equity", "drawdown"),
        "drawdown_duration": lambda s, d: backtest.drawdown_runs(backtest.drawdown(backtest.equity(rsi_signals(s, d)))),
        "backtest_metrics": lambda s, d: show(_metrics(s, d), "total_trades", "max_drawdown_bars", *BT, keys=BY),
        "ratings": lambda s, d: metrics.rated(_metrics(s, d)).select("symbol", *[f"rating_{m}" for m in metrics.LIMITS], "overall_score", "few_trades"),
        "compare_best": lambda s, d: metrics.compare_best(metrics.rated(_metrics(s, d))),
        "percent_scores": lambda s, d: _metrics(s, d).select(
            "symbol", metrics.percent_score(F.col("sharpe_ratio"), F.col("annual_return") * 100, F.col("max_drawdown") * 100, F.col("win_rate") * 100).alias("score")
        ),
        "return_metrics": lambda s, d: show(
            metrics.return_metrics(ind.returns(bars.daily_orders(s, d))),
            "n_returns", "total_return", "annual_return", "volatility", "sharpe_ratio", "sortino_ratio", "calmar_ratio", "max_drawdown", "win_rate", "profit_factor", keys=BY,
        ),
        "grid_search": lambda s, d: show(optimise.grid_search(trend(s, d), GRID), "score", keys=("symbol", "param_id")),
        "grid_search_best": lambda s, d: show(optimise.best_of(optimise.grid_search(trend(s, d), GRID)), "score", keys=("symbol", "param_id")),
        "random_search": lambda s, d: show(optimise.grid_search(trend(s, d), RANDOM), "score", keys=("symbol", "param_id")),
        "search_templates": lambda s, d: show(search.search(trend(s, d), TRIED), "score", keys=("symbol", "param_id", "template")),
        "search_best": lambda s, d: show(optimise.best_of(search.search(trend(s, d), TRIED)), "score", keys=("symbol", "param_id")),
        "overfit_report": overfit_report,
        "walk_forward_folds": lambda s, d: show(optimise.walk_forward(trend(s, d)), "train_return", "test_return", keys=("symbol", "fold")),
        "walk_forward_summary": lambda s, d: show(optimise.walk_forward_summary(optimise.walk_forward(trend(s, d))), "n_folds", "mean_train", "mean_test", "degradation_ratio", "robust", keys=BY),
        "overfit_score": lambda s, d: show(optimise.overfit(trend(s, d), 5, 20, 0.5), "overfit_score", keys=BY),
        "screen_flagship": flagship,
        "screen_rsi": _screened(C("RSI", "below", 50.0)),
        "screen_rsi_level": _screened(C("RSI", "crossover"), C("RSI", "above", 50.0)),
        "screen_macd": _screened(C("MACD", "above")),
        "screen_macd_crosses": _screened(C("MACD", "crossover"), C("EMA", "above")),
        "screen_ma_boll_and": _screened(C("MA", "below", params={"period": 20}), C("BOLL", "below")),
        "screen_ma_crossunder": _screened(C("SMA", "crossunder", params={"period": 20})),
        "screen_kdj": _screened(C("KDJ", "above", 50.0)),
        "screen_kdj_crosses": _screened(C("KDJ", "crossunder")),
        "screen_price": _screened(C("PRICE", "above", 20.0)),
        "screen_unknown": _screened(C("NOSUCH", "above", 1.0), C("PRICE", "above", 0.0)),
        "screen_few_bars": _screened(C("PRICE", "above", 0.0), days=4),
        "screen_phrase": _screened(*screen.parse("RSI below 60 and price above 5").conditions, days=60),
        "document_frequency": lambda s, d: retrieval.document_frequency(documents(s, d)),
        "bm25_topk": bm25_topk,
        "rerank_topk": rerank_topk,
        "jaccard_overlap": lambda s, d: turns(s, d).select("conv_id", "turn", F.round(text.jaccard(text.token_set(F.col("question")), text.token_set(F.col("answer"))), 6).alias("overlap")),
        "bigram_cosine": lambda s, d: show(text.bigram_cosine(turns(s, d), ["conv_id", "turn"], "question", "answer"), "similarity", keys=("conv_id", "turn")),
        "cosine_topk": lambda s, d: show(cosine_topk(s, d), "score", keys=("query_id", "rank", "vec_id")),
        "hybrid_topk": hybrid_topk,
        "mmr_topk": mmr_topk,
        "ir_metrics": ir_metrics,
        "bleu1": lambda s, d: show(text.bleu1(turns(s, d), ["conv_id", "turn"], "question", "answer"), "bleu1", keys=("conv_id", "turn")),
        "rouge_l": lambda s, d: text.rouge_l(turns(s, d), "question", "answer").select("conv_id", "turn", "rouge_l"),
        "chunk_hard_cut": hard_cut,
        "chunk_recursive": lambda s, d: chunks.chunk_ids(chunks.recursive_split(documents(s, d)), "doc_id", "chunk", "pos"),
        "chunk_semantic": lambda s, d: chunks.semantic_split(documents(s, d)),
        "chunk_ids": lambda s, d: chunks.chunk_ids(documents(s, d).select("doc_id", F.posexplode(chunks.hard_cut(F.col("text"), 1000, 0)).alias("pos", "chunk")), "doc_id", "chunk", "pos").select("chunk_id"),
        "bigram_vectors": lambda s, d: show(chunks.bigram_vectors(s.read.parquet(f"{d}/conversations.parquet"), ["conv_id", "turn"]), "weight", keys=("conv_id", "turn", "bucket")),
        "sentences": lambda s, d: documents(s, d).select("doc_id", F.size(chunks.sentences(F.col("text"))).alias("n_sentences")),
        "chatml": lambda s, d: text.chatml(s.read.parquet(f"{d}/conversations.parquet")).select(
            "conv_id", F.size("messages").cast("long").alias("n_messages"), F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit(":"), F.md5(m["content"]))), ",").alias("digest")
        ),
        "alpaca": lambda s, d: turns(s, d).select("conv_id", "turn", text.alpaca(F.lit("Answer the question."), F.col("question"), F.col("answer")).alias("r")).select(
            "conv_id", "turn", F.md5(F.concat_ws("|", "r.instruction", "r.input", "r.output")).alias("digest")
        ),
        "train_test_split": lambda s, d: text.train_test(documents(s, d), "doc_id").select("doc_id", "part"),
        "labels_matched": labels_matched,
        "diagnoses": diagnoses,
        "engine_metrics": engine,
        "side_by_side": side_by_side,
        "relevant_hits": relevant_hits,
        "retrieval_evaluation": retrieval_evaluation,
        "answer_evaluation": answer_evaluation,
        "full_evaluation": full_evaluation,
        "chunk_clauses": clause_chunks,
        "context": lambda s, d: text.context(_bm25_hits(s, d)[0].withColumn("source", F.concat(F.lit("doc"), F.col("rank").cast("string"))), "query_id", "rank", page="rank").select("query_id", F.md5("context").alias("digest")),
        "source_list": lambda s, d: text.source_list(_bm25_hits(s, d)[0].withColumn("source", F.lit("corpus")), "query_id", "rank", title="source").select("query_id", F.md5("sources").alias("digest")),
        "citations": cited,
    }
    for name, build in signals.TEMPLATES.items():
        found[f"signals_{name}"] = over_hours(build, "signal")
    return found
