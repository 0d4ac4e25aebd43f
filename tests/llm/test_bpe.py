import hashlib

from barloom.llm import bpe, tokens

TEXTS = ["", None, "Hello world  it's\tDON'T", "é ́a İ ﬁ <|endoftext|>x", "日本 語１２\x1cx", "\x85\xa0 \n", "a b " * 3000, "x" * 3000, "Hello world  it's\tDON'T"]


def library(text):
    t = tokens.library_tokenizer(tokens.default_vocabulary())
    ids = t.encode(text or "", add_special_tokens=False).ids
    return ids, t.decode(ids, skip_special_tokens=False)


def make(spark):
    rows = [(i, t, 1, "w") for i, t in enumerate(TEXTS)] + [(None, "lost", 1, "w"), (2, TEXTS[2], 1, "w")]
    return spark.createDataFrame(rows, "doc_id long, text string, block int, words string").repartition(3)


def test_report_is_the_library(spark, monkeypatch):
    monkeypatch.setattr(bpe, "BLOCK_DOCS", 2)
    rows = bpe.round_trip_report(make(spark)).collect()
    assert len(rows) == len(TEXTS) + 2
    got = {r.doc_id: r for r in rows}
    for i, t in enumerate(TEXTS):
        ids, decoded = library(t)
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(decoded.encode()).hexdigest()


def test_encode_and_decode(spark):
    encoded = bpe.encode(make(spark))
    got = {r.doc_id: r.ids for r in encoded.collect()}
    back = {r.doc_id: r.text for r in bpe.decode(encoded).collect()}
    for i, t in enumerate(TEXTS):
        ids, decoded = library(t)
        assert got[i] == ids and back[i] == decoded


def test_empty(spark):
    assert bpe.round_trip_report(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_the_join_is_in_the_plan_and_keeps_order(spark, monkeypatch):
    """By broadcast or, beyond its bound, by a shuffle; documents lie across batches and tasks."""
    rows = [(i, list(range(i * 7 % 23)) * (1 + i % 3) + [None, 10**6, -1] * (i % 2)) for i in range(60)] + [(100, None), (101, []), (None, [5, 6])]
    encoded = spark.createDataFrame(rows, "doc_id long, ids array<int>").repartition(3)
    known = bpe.pieces(tokens.default_vocabulary())
    expect = sorted((str(i), " ".join(known[x] if x is not None and 0 <= x < len(known) else "" for x in ids or [])) for i, ids in rows)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        for most in (bpe.BROADCAST_BYTES, 0):
            monkeypatch.setattr(bpe, "BROADCAST_BYTES", most)
            made = bpe.decode(encoded)
            plan = made._jdf.queryExecution().optimizedPlan().toString()
            assert "Join LeftOuter" in plan and ("broadcast" in plan.lower()) == bool(most)
            assert sorted((str(r.doc_id), r.text) for r in made.collect()) == expect
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_very_long_text_and_no_tables_left(spark):
    text = "The quick brown fox, 1234! " * 8000
    before = {t.name for t in spark.catalog.listTables()}
    r = bpe.round_trip_report(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    ids, decoded = library(text)
    assert (r.n_tokens, r.decoded_sha256) == (len(ids), hashlib.sha256(decoded.encode()).hexdigest())
    assert {t.name for t in spark.catalog.listTables()} == before


def test_report_joins_distinct_ids_and_not_every_id(spark, monkeypatch):
    """By broadcast or by a shuffle, with blocks of few documents and batches of few rows; before, each id of each document was a row."""
    docs, results = make(spark), []
    monkeypatch.setattr(bpe, "BLOCK_DOCS", 3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        for most in (bpe.BROADCAST_BYTES, 0):
            monkeypatch.setattr(bpe, "BROADCAST_BYTES", most)
            made = bpe.round_trip_report(docs)
            plan = made._jdf.queryExecution().optimizedPlan().toString()
            assert "Join LeftOuter" in plan and "Generate" not in plan
            results.append(sorted(map(tuple, made.collect()), key=str))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert results[0] == results[1]
    got = {r[0]: r[1:] for r in results[0]}
    for i, t in enumerate(TEXTS):
        ids, decoded = library(t)
        assert got[i] == (len(ids), *(hashlib.sha256(x.encode()).hexdigest() for x in (" ".join(map(str, ids)), decoded)))
