"""Chunks against values worked out by hand and against plain versions; numbers and exact cuts over all rows."""

import hashlib
import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from barloom.functions import shared
from barloom.operators import chunks, text


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)).select(column.alias("r")).first().r


def recursive(spark, t, size=500, overlap=50, separators=chunks.SEPARATORS):
    return one(spark, chunks.recursive_cut(F.col("t"), size, overlap, separators), t=t)


def plain_recursive(t, size=500, overlap=50, separators=chunks.SEPARATORS):
    if len(t) <= size:
        return [t.strip()] if t.strip() else []
    level = next((k for k, s in enumerate(separators) if s == "" or s in t), None)
    if level is None or separators[level] == "":
        return [p for p in (t[i : i + size].strip() for i in range(0, len(t), size - overlap)) if p]
    sep, given, held = separators[level], [], None
    for part in [*t.split(sep), None]:
        if part is not None and (held is None or len(held + sep + part) <= size):
            held = part if held is None else held + sep + part
            continue
        mine = plain_recursive(held.strip(), size, overlap, separators[level + 1 :])
        given += mine
        if part is not None:
            held = mine[-1][-overlap:] + sep + part if mine and overlap and len(mine[-1]) > overlap else part
    return given


def plain_semantic(t, threshold=0.5, least=50, most=1000):
    found = [s.strip() for s in re.split(r"(?<=[.!?。！？；\n])\s*", t) if s.strip()]
    if len(found) <= 1:
        return [t.strip()] if t.strip() else []
    counts = [Counter(zip(s.lower(), s.lower()[1:])) for s in found]
    groups = [found[0]]
    for a, b, s in zip(counts, counts[1:], found[1:]):
        norm = math.sqrt(sum(n * n for n in a.values()) * sum(n * n for n in b.values()))
        if norm and sum(n * b[k] for k, n in a.items()) / norm >= threshold:
            groups[-1] += " " + s
        else:
            groups.append(s)
    out = []
    for g in groups:
        if len(g) > most:
            out += plain_recursive(g, most, 0)
        elif len(g) < least and out and len(out[-1]) + 1 + len(g) <= most:
            out[-1] += " " + g
        else:
            out.append(g)
    return out


def made_texts(n=150):
    rng = random.Random(4)
    words = "rate risk bond yield 市场 résumé Zinsen a of".split()
    gaps = [" "] * 12 + [". ", "! ", "\n", "\n\n", "。", "，", ".", "  ", "\n\n\n"]
    return ["".join(rng.choice(words) * rng.choice((1, 1, 1, 9)) + rng.choice(gaps) for _ in range(rng.randrange(0, 400))) for _ in range(n)] + ["", " \n ", "x" * 1700, " " * 900, None]


def test_sentences_and_windows(spark):
    assert one(spark, chunks.sentences(F.col("t")), t="One. Two!  三。四？\n\nfive") == ["One.", "Two!", "三。", "四？", "five"]
    assert one(spark, chunks.hard_cut(F.col("t"), 4, 1), t="abcdefg") == ["abcd", "defg", "g"]
    assert one(spark, chunks.hard_cut(F.col("t"), 4, 1), t="") == []


def test_recursive_by_hand(spark):
    assert recursive(spark, "A" * 300, 100, 0) == ["A" * 100] * 3
    assert recursive(spark, "Short text", 100, 0) == ["Short text"] and recursive(spark, "\n\n", 100) == [] and recursive(spark, None) == []
    assert recursive(spark, "Section1::Section2::Section3", 12, 0, ("::",)) == ["Section1", "Section2", "Section3"]
    assert recursive(spark, "one two three four", 9, 0) == ["one two", "three", "four"]
    assert recursive(spark, "x" * 1000, 300, 50) == ["x" * 300] * 3 + ["x" * 250]
    made = recursive(spark, "abcde" * 40, 60, 10)
    assert all(any(a[-k:] == b[:k] for k in range(1, 61)) for a, b in zip(made, made[1:]))


def test_a_short_piece_is_not_carried_over(spark):
    """Only a piece longer than the overlap starts the next one."""
    made = recursive(spark, "short one here\n\n" + "word " * 110)
    assert made[0] == "short one here" and sum("short one here" in p for p in made) == 1
    # The end of the first piece is carried over and, with what follows, cut again; blank parts give nothing.
    assert recursive(spark, "a" * 25 + "\n\n\n\n" + "b" * 25, 30, 10) == ["a" * 25, "a" * 10, "b" * 25]
    # The overlap comes from the last piece of a nested cut.
    assert recursive(spark, "cc dd ee ff\nzz yy", 6, 2) == ["cc dd", "dd ee", "ee ff", "ff\nzz", "zz yy"]


def test_cuts_against_plain_versions(spark):
    texts = made_texts()
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(4)
    c = F.col("text")
    for r in docs.select("text", chunks.recursive_cut(c).alias("a"), chunks.recursive_cut(c, 60, 7).alias("b"), chunks.semantic_cut(c).alias("s"), chunks.semantic_cut(c, 0.3, 20, 90).alias("z")).collect():
        t = r.text or ""
        assert r.a == plain_recursive(t) and r.b == plain_recursive(t, 60, 7)
        assert r.s == plain_semantic(t) and r.z == plain_semantic(t, 0.3, 20, 90)


def test_semantic_by_hand(spark):
    alike = "The market rose today and closed higher. The market rose today and closed lower. "
    docs = spark.createDataFrame([(1, alike + "Zebras jump quickly over very big fences near my old house. Ok."), (2, None), (3, "x" * 1200 + ".")], "doc_id long, text string")
    got = {}
    for r in chunks.semantic_split(docs).orderBy("doc_id", "pos").collect():
        got.setdefault(r.doc_id, []).append(r.chunk)
    assert got[1] == [alike.strip(), "Zebras jump quickly over very big fences near my old house. Ok."]
    assert 2 not in got and [len(c) for c in got[3]] == [1201]  # one sentence is given whole
    long = "Zebra " + "q" * 980 + ". Ok."
    assert one(spark, chunks.semantic_cut(F.col("t")), t=long) == [long]
    longer = "Zebra " + "q" * 990 + ". Ok."
    assert one(spark, chunks.semantic_cut(F.col("t")), t=longer) == [longer[:-4], "Ok."]


CLAUSES = [
    (1, "第1條 這是第一條的內容。\n第2條 這是第二條的內容。\n第3條 這是第三條的內容。"),
    (2, "article 1 Introduction.\nARTICLE 2 Requirements.\nSection 3 End."),
    (3, "1. First point.\n2. Second point.\n3. Third point."),
    (4, "段落一的內容。\n\n段落二的內容。\n \n段落三的內容。"),
    (5, "第1條 " + "內容" * 600 + "\n第2款 短內容。"),
    (6, "   "),
    (7, None),
    (8, "a plain line"),
]


def test_clauses(spark):
    docs = spark.createDataFrame(CLAUSES, "doc_id long, text string")
    got = {}
    for r in chunks.clause_split(docs).orderBy("doc_id", "pos").collect():
        got.setdefault(r.doc_id, []).append(r.chunk)
    assert [len(got.get(i, [])) for i in (1, 2, 3, 4, 6, 7, 8)] == [3, 3, 3, 3, 0, 0, 1]
    assert got[1][1] == "第2條 這是第二條的內容。" and got[2][1] == "ARTICLE 2 Requirements." and got[4][2] == "段落三的內容。"
    assert len(got[5]) >= 4 and all(len(c) <= 500 for c in got[5]) and got[5][-1] == "第2款 短內容。"


@pytest.mark.parametrize("strategy", ["recursive", "semantic", "financial"])
def test_split_documents_places_and_numbers_chunks(spark, strategy):
    rows = [*CLAUSES, (9, "A " * 400), (10, "One sentence here. Another one there! " * 20), (11, "same same same " * 60)]
    docs = spark.createDataFrame([(i, t, "s.txt", 1) for i, t in rows], "doc_id long, text string, source string, pos int").repartition(3)
    texts = dict(rows)
    got = {}
    whole = chunks.split_documents(docs, strategy).orderBy("doc_id", "pos").collect()
    for n, r in enumerate(whole):
        got.setdefault(r.doc_id, []).append(r)
        assert r.chunk_id == f"{r.doc_id}::chunk_{n}_{hashlib.md5(r.chunk.encode()).hexdigest()[:8]}"
    assert not {6, 7} & set(got) and {9, 10, 11} <= set(got)
    for i, found in got.items():
        at = 0
        for n, r in enumerate(found):
            here = texts[i].find(r.chunk, at)
            assert r.start_idx == (at if here < 0 else here) and r.end_idx == r.start_idx + len(r.chunk) and r.pos == n
            at = at if here < 0 else r.end_idx


def test_numbers_over_all_rows(spark):
    rows = [(k % 7, k * 37 % 1000, "x") for k in range(1000)] + [(None, 1, "y"), (3, 999, "z"), (3, 999, "z")]
    made = shared.numbered(spark.createDataFrame(rows, "a int, b int, number string").repartition(6), "a", "b", out="n").collect()
    ordered = sorted(made, key=lambda r: r.n)
    assert [r.n for r in ordered] == list(range(len(rows)))
    assert [(r.a is not None, r.a, r.b) for r in ordered] == sorted((a is not None, a, b) for a, b, _ in rows)
    assert shared.numbered(spark.createDataFrame([], "a int"), "a").count() == 0


def test_exact_split(spark):
    for n, ratio in ((2000, 0.1), (17, 0.33), (1, 0.5), (3, 0.99), (9000, 0.2)):
        ids = [str(k) for k in range(n)]
        got = {str(r.id): r.part for r in text.train_test(spark.range(n), "id", ratio).collect()}
        wanted = max(1, int(n * (1 - ratio)))
        train = sorted(ids, key=lambda k: hashlib.md5(k.encode()).hexdigest())[:wanted]
        assert {k for k, p in got.items() if p == "train"} == set(train)
    copies = spark.createDataFrame([(1,)] * 50 + [(None,)] * 50, "id int")
    assert copies.transform(text.train_test, "id", 0.25).where("part = 'train'").count() == 75
    assert text.train_test(spark.range(0), "id").count() == 0


def test_digests_are_counted_to_the_end(spark, monkeypatch):
    monkeypatch.setattr(shared, "FEW", 0)
    digests = sorted(hashlib.md5(str(k % 40).encode()).hexdigest() for k in range(120))
    table = spark.createDataFrame([(d,) for d in digests], "digest string")
    for n in (1, 2, 60, 118, 120):
        assert shared.nth_digest(table, n) == (digests[n - 1], (n - 1) // 3 * 3)
    assert shared.nth_digest(table, 121)[0] is None


def test_bigram_vectors(spark):
    docs = spark.createDataFrame([(1, "abab"), (2, "a"), (3, None), (4, "ÀÀà")], "k int, text string")
    got = {}
    for r in chunks.bigram_vectors(docs, ["k"]).collect():
        got.setdefault(r.k, {})[r.bucket] = r.weight
    place = lambda b: int(hashlib.md5(b.encode()).hexdigest()[:8], 16) % 64
    assert got[1] == pytest.approx({place("ab"): 2 / 5**0.5, place("ba"): 1 / 5**0.5}) and got[4] == {place("àà"): 1.0} and set(got) == {1, 4}


def test_likeness_by_squared_counts(spark):
    """Counts are squared once for each text, and once for each two neighbours together."""
    texts = [("", "ab"), ("a", "ab"), ("abab abab", "bab aba"), ("Hello hello", "hello there"), ("aaaa", "aaaaaaa"), ("xyz", "abc")]
    df = spark.createDataFrame(texts, "a string, b string")
    for r in df.select("a", "b", chunks._squares(chunks._codes(F.col("a"))).alias("n"), chunks._likeness(chunks._counted(F.col("a")), chunks._counted(F.col("b"))).alias("s")).collect():
        p, q = (Counter(zip(x.lower(), x.lower()[1:])) for x in (r.a, r.b))
        aa, bb = (sum(n * n for n in c.values()) for c in (p, q))
        assert r.n == aa and r.s == (sum(n * q[g] for g, n in p.items()) / math.sqrt(aa * bb) if aa and bb else 0.0)
