import struct
import zlib

import numpy as np
import pytest

from barloom.llm import packing, tokens

TEXTS = ["", None, "Hello world", "a b c " * 4000, "it's <|endoftext|>x İ ﬁ\x1cy é", "Ünï  foo!!bar\n ok", "x" * 5000, "a b c " * 4000]


def library_ids(text):
    t = tokens.library_tokenizer(tokens.default_vocabulary())
    return t.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("text", [*TEXTS, "a\x85b\xa0c d  e　f", "<|startoftext|>Aé <|endoftext|>", "é ́a", "日本 語１２", "\x1c \x1d", "ÀÉ THE <|ENDOFTEXT|> İS", "ÀÉÞ THE The the µ ÿ", "ΑΣ ΟΔΟΣ Ω K"])
def test_memo_is_the_library(text):
    made = tokens.Memo(tokens.default_vocabulary(), most=3).encode(text or "")
    assert list(struct.unpack(f"<{len(made) // 4}I", made)) == library_ids(text)


def test_memo_of_two_generations():
    memo = tokens.Memo(tokens.default_vocabulary(), most=4)
    for text in ("a b c", "a d e", "a b f g h i", "a b", "c d e f g h i"):
        made = memo.encode(text)
        assert list(struct.unpack(f"<{len(made) // 4}I", made)) == library_ids(text)


def test_best_fit_decreasing_is_the_plain_rule():
    rng = np.random.default_rng(1)
    for size in (7, 64, 100):
        lengths = rng.integers(1, size + 1, 300)
        window, offset = packing.best_fit_decreasing(lengths, size)
        room, expect = [], 0
        for i in np.argsort(-lengths, kind="stable"):
            fits = [r for r in room if r >= lengths[i]]
            if fits:
                room.remove(min(fits))
                room.append(min(fits) - lengths[i])
            else:
                room.append(size - lengths[i])
                expect += 1
        assert window.max() + 1 == expect
        for w in range(expect):
            mine = sorted(zip(offset[window == w], lengths[window == w]))
            at = 0
            for o, n in mine:
                assert o == at
                at += n
            assert at <= size


def test_pack(spark):
    docs = spark.createDataFrame([(i, t, "x", 0) for i, t in enumerate(TEXTS)] + [(None, "lost", "x", 0), (2, "Hello world", "x", 0)], "doc_id long, text string, grp string, start int")
    rows = packing.pack(docs).collect()
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    assert len(by_doc[2]) == 2
    for i, t in enumerate(TEXTS):
        ids = [*library_ids(t), packing.END_ID]
        got = sorted(by_doc[i], key=lambda r: r.start)
        if i != 2:
            assert sum(r.length for r in got) == len(ids)
        for r in got:
            part = ids[r.start : r.start + r.length]
            assert r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(struct.pack(f"<{len(part)}I", *part))
    for rs in by_sequence.values():
        at = 0
        for r in sorted(rs, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= packing.WINDOW


def test_large_ids_beside_a_null(spark):
    ids = [2**60 + 1, 2**60 + 3, -(2**62) - 1, None]
    rows = packing.pack(spark.createDataFrame([(i, "hello world") for i in ids], "doc_id long, text string")).collect()
    assert sorted((r.doc_id for r in rows), key=str) == sorted(ids, key=str)


def test_rows_alike_are_spread(spark):
    """A third of the rows have no id and the same text; they don't meet in one group."""
    docs = spark.range(3000).selectExpr("if(id % 3 = 0, null, id) doc_id", "if(id % 3 = 0, 'same text', concat('text ', id)) text").repartition(4)
    rows = packing.pack(docs, docs_per_group=100).collect()
    groups = {}
    for r in rows:
        if r.doc_id is None:
            groups[r.sequence_id >> 32] = groups.get(r.sequence_id >> 32, 0) + 1
    assert len(rows) == 3000 and sum(groups.values()) == 1000 and len(groups) > 20 and max(groups.values()) < 100


def test_registered_query_keeps_every_id_once(spark):
    """Over the whole smallest table: pieces cover each document, offsets have no gaps, and little is padded."""
    from barloom.llm import queries

    sf_dir = "/root/testdata/sf0.001"
    rows = queries.queries()["op2_packing"](spark, sf_dir).toPandas()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").toPandas()
    pieces = {d: g.sort_values("start") for d, g in rows.groupby("doc_id")}
    assert sorted(pieces) == sorted(docs.doc_id)
    for doc, text in zip(docs.doc_id, docs.text, strict=True):
        ids = [*library_ids(text), packing.END_ID]
        at = 0
        for r in pieces[doc].itertuples():
            part = ids[r.start : r.start + r.length]
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(struct.pack(f"<{len(part)}I", *part))
            at += r.length
        assert at == len(ids)
    used = 0
    for _, g in rows.sort_values("offset").groupby("sequence_id"):
        assert (g.offset.to_numpy() == np.r_[0, g.length.cumsum()[:-1]]).all()
        used += 1
        assert g.length.sum() <= packing.WINDOW
    assert rows.length.sum() / (used * packing.WINDOW) > 0.9


def test_empty(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string")).count() == 0
