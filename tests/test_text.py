import pytest
from pyspark.sql import functions as F

from barloom.operators import retrieval, text


def one(spark, col, **values):
    row = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return row.select(col.alias("x")).first().x


def test_tokens(spark):
    assert one(spark, text.tokens(F.col("t")), t="RSI低位 14 épée") == ["rsi", "低", "位", "14", "p", "e"]
    assert sorted(one(spark, text.token_set(F.col("t")), t="低位 低 a A")) == sorted(["低位", "低", "a", "位"])
    assert one(spark, text.jaccard(text.tokens(F.col("a")), text.tokens(F.col("b"))), a="a b", b="b c") == pytest.approx(1 / 3)
    assert one(spark, text.jaccard(text.tokens(F.col("a")), text.tokens(F.col("b"))), a="", b="b c") == 0.0


def test_similarity(spark):
    pairs = spark.createDataFrame([(1, "abc", "abc"), (2, "abab", "ab"), (3, "", "ab"), (4, "AB", "ab"), (5, "xy", "ab")], "k int, a string, b string")
    got = {r.k: r.s for r in text.bigram_cosine(pairs, ["k"], "a", "b", "s").collect()}
    assert got[1] == pytest.approx(1) and got[2] == pytest.approx(2 / 5**0.5) and got[3] == 0 and got[4] == pytest.approx(1) and got[5] == 0
    v = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0], [0.0, 0.0])], "a array<float>, b array<double>, z array<double>")
    r = v.select(text.cosine(F.col("a"), F.col("b")).alias("c"), text.cosine(F.col("a"), F.col("z")).alias("z")).first()
    assert r.c == pytest.approx(0.5**0.5) and r.z == 0


def test_sections_and_paragraphs(spark):
    docs = spark.createDataFrame([("d", "# One\ntext a\n## Two\ntext b"), ("e", "plain")], "source string, text string")
    assert [(r.source, r.pos, r.title) for r in text.markdown_sections(docs).orderBy("source", "pos").collect()] == [("d", 0, "One"), ("d", 1, "Two"), ("e", 0, "e")]
    docs = spark.createDataFrame([("d", "a\n\nb\n\n \n\nc"), ("e", "x")], "source string, text string")
    assert [r.title for r in text.paragraphs(docs).orderBy("source", "pos").collect()] == ["d_para_0", "d_para_1", "d_para_2", "e"]


def test_citations(spark):
    a = F.col("a")
    assert one(spark, text.citations(a), a="x [2] y [1][2]") == ["2", "1"]
    valid = lambda s, n: one(spark, text.citations_valid(a, F.lit(n)), a=s)
    assert valid("none", 0) and not valid("[1]", 0) and valid("[1] [3]", 3) and not valid("[4]", 3) and not valid("[0]", 3)
    assert one(spark, text.cited(a, F.array(F.lit("s1"), F.lit("s2"))), a="[2] [9] [0]") == ["s2"]
    assert one(spark, text.confidence(F.array(F.lit(0.05), F.lit(0.13)), a), a="[1] [2]") == pytest.approx(0.5 * 0.91 + 0.25 * 2 / 3 + 0.25 * 0.5, abs=0.006)


def test_scores(spark):
    pairs = spark.createDataFrame([(1, "a b c", "a b d"), (2, "a", ""), (3, "a b c d", "a"), (4, None, "a")], "k int, r string, h string")
    got = {r.k: r.bleu1 for r in text.bleu1(pairs.na.fill(""), ["k"], "r", "h").collect()}
    assert got[1] == pytest.approx(2 / 3) and got[2] == 0 and got[3] == pytest.approx(0.25) and got[4] == 0
    rouge = {r.k: r.rouge_l for r in text.rouge_l(pairs, "r", "h").collect()}
    assert rouge[1] == pytest.approx(2 / 3) and rouge[2] == 0 and rouge[3] == pytest.approx(0.4)
    assert text.lcs_length("a b c b d a b".split(), "b d c a b a".split()) == 4
    assert one(spark, text.label_correct(F.col("p"), F.col("e")), p="It is Bearish", e="bearish outlook") is True
    assert one(spark, text.label_correct(F.col("p"), F.col("e")), p="no idea", e="bearish") is False


def test_retrieval(spark):
    docs = spark.createDataFrame([(1, "rsi oversold signal"), (2, "moving average"), (3, None)], "doc_id long, text string")
    asked = spark.createDataFrame([(0, "rsi signal"), (1, "nothing")], "item_id long, text string")
    got = retrieval.bm25(docs, asked).collect()
    assert [(r.item_id, r.doc_id) for r in got] == [(0, 1)] and got[0].score > 0
    assert retrieval.bm25(docs.limit(0), asked).count() == 0
    v = spark.createDataFrame([(i, [float(i == 0 or i == 3), float(i)]) for i in range(4)], "vec_id long, embedding array<double>")
    near = retrieval.vector_top(v, v.where("vec_id = 1"), 2).orderBy("rank").collect()
    assert [(r.vec_id, r.rank) for r in near] == [(2, 1), (3, 2)]
    pool = retrieval.vector_top(v, v.where("vec_id = 1"), 3).join(v.withColumnRenamed("embedding", "v"), "vec_id").withColumnRenamed("score", "relevance")
    assert [r.vec_id for r in retrieval.mmr(pool, 3).orderBy("rank").collect()] == [2, 0, 3]
    ranked = spark.createDataFrame([(1, 1, False), (1, 2, True)], "query_id long, rank int, relevant boolean")
    m = retrieval.ir_metrics(ranked, spark.createDataFrame([(1, 2), (2, 1)], "query_id long, n_expected long")).first()
    assert (m.precision_at_k, m.recall_at_k, m.mrr) == (0.1, 0.25, 0.25)
    hits = spark.createDataFrame([(1, 5, 0.2), (1, 6, 0.4), (1, 7, 0.3)], "query_id long, doc_id long, distance double")
    texts = spark.createDataFrame([(5, "rsi"), (6, "macd rsi"), (7, "rsi")], "doc_id long, text string")
    mixed = retrieval.hybrid(hits, texts, spark.createDataFrame([(1, "macd rsi")], "query_id long, text string")).orderBy("rank").collect()
    assert [r.doc_id for r in mixed] == [5, 6] and mixed[0].score == pytest.approx(0.7 * 0.5 + 0.3 * 0.5)


def test_formats(spark):
    t = spark.createDataFrame([(1, 1, "user", "q"), (1, 0, "system", "s"), (1, 2, "assistant", "a")], "conv_id long, turn long, role string, text string")
    (row,) = text.chatml(t).collect()
    assert [(m.role, m.content) for m in row.messages] == [("system", "s"), ("user", "q"), ("assistant", "a")]
    hits = spark.createDataFrame([(1, 2, "b", "src"), (1, 1, "a", "src")], "q long, rank int, content string, source string")
    assert text.context(hits, "q", "rank").first().context == "[1] (来源: src)\na\n\n[2] (来源: src)\nb"
    assert one(spark, text.preview(F.lit("x" * 101))) == "x" * 100 + "..."
