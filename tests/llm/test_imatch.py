import hashlib
import math
import re
from collections import Counter

from pyspark.sql import functions as F

from barloom.llm import imatch


def plain_fingerprint(text, kept):
    """By the rules alone: two levels of subsets by the number of lexicon terms."""
    mine = sorted({t for t in re.findall(r"[^\W_]+", text.lower()) if t in kept})
    level, slots = len(mine).bit_length(), {}
    for t in mine:
        raw = hashlib.blake2b(t.encode(), digest_size=64).digest()
        for n in (level, level + 1):
            for i in range(16):
                at = 2 * (16 * (n % 2) + i)
                if (int.from_bytes(raw[at : at + 2], "little") + 1) * 2**n <= 65536:
                    slots.setdefault((n, i), []).append(t)
    return {k: " ".join(v) for k, v in slots.items()}, level


def plain_likeness(a, b, kept):
    (x, m), (y, n) = plain_fingerprint(a, kept), plain_fingerprint(b, kept)
    if a == b or (x and x == y and m == n):
        return 1.0
    common = {m, m + 1} & {n, n + 1}
    keys = {k for k in (*x, *y) if k[0] in common}
    return sum(x.get(k) == y.get(k) for k in keys) / len(keys) if x and y and keys else 0.0


def test_report_against_brute_force(spark):
    words = [f"w{i}" for i in range(300)]
    texts = [" ".join(words[(i * k) % 300] for k in range(1, 40 + i % 7)) for i in range(120)] + ["", "a", "é€𝄞x " * 5]
    rows = [(3 * i + 1, t, "x") for i, t in enumerate(texts)] + [(1, texts[5], "x"), (None, None, "x"), (None, "zz yy", "x"), (None, "zz yy", "x"), (2**60 + 1, "zz", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, bucket string").repartition(5)
    got = imatch.imatch_report(docs)
    ordered = sorted(((imatch.LAST if d is None else d, t or "") for d, t, _ in rows))
    df = Counter(w for _, t in ordered for w in set(re.findall(r"[^\W_]+", t.lower())))
    n = len(ordered)
    kept = {w for w, c in df.items() if n * math.exp(-imatch.IDF_BAND[1]) <= c <= n * math.exp(-imatch.IDF_BAND[0])}
    expect = []
    for k, (d, t) in enumerate(ordered):
        after = ordered[(k + 1) % len(ordered)][1]
        half = len(t) // 2
        e = t[: len(t) - half] + after[:half]
        expect.append((d, len(t), hashlib.sha256(e.encode()).hexdigest(), plain_likeness(t, e, kept), plain_likeness(t, after, kept)))
    made = [(imatch.LAST if r.doc_id is None else r.doc_id, r.n_chars, r.edited_sha256, r.near_edited, r.near_next) for r in got.collect()]
    assert sorted(made) == sorted(expect)
    prints = {}
    for r in got.collect():
        prints.setdefault(r.doc_id, set()).add(r.fingerprint)
    assert len(prints[None]) == 2 and len(set().union(*prints.values())) > 100
    by_bucket = imatch.in_order(docs, 10).groupBy("bucket").agg(F.sum("tail").alias("tails")).collect()
    assert len(by_bucket) > 5 and all(r.tails >= 1 for r in by_bucket)


def test_edited_rule():
    assert imatch.edited("abcde", "xyz") == "abcxy" and imatch.edited("abcdefgh", "x") == "abcdx" and imatch.edited("a", "x") == "a"


def test_likeness_follows_shared_terms():
    kept = {f"t{i}" for i in range(2000)}
    of = imatch.Fingerprinter(kept)
    text = " ".join(f"t{i}" for i in range(200))
    one = " ".join(f"t{i}" for i in range(199)) + " t999"
    half = " ".join(f"t{i}" for i in range(100, 300))
    other = " ".join(f"t{i}" for i in range(1000, 1200))
    assert imatch.likeness(of(text), of(text.upper())) == 1.0
    assert imatch.likeness(of(text), of(one)) > imatch.likeness(of(text), of(half)) > imatch.likeness(of(text), of(other))


def test_texts_without_a_lexicon_term_are_alike_only_if_equal():
    of = imatch.Fingerprinter({"rare"})
    assert imatch.likeness(of("common words here alpha"), of("common words here beta")) == 0.0
    assert of("") == of("") and imatch.likeness(of(""), of("x")) == 0.0 and imatch.likeness(of("x"), of("x")) == 1.0


def test_unspaced_scripts_have_terms():
    assert {"日本", "本語", "日本語"} <= imatch.terms("日本語 text") and "text" in imatch.terms("日本語 text")


def test_single_and_empty(spark):
    schema = "doc_id long, text string"
    (row,) = imatch.imatch_report(spark.createDataFrame([(4, "abcd")], schema)).collect()
    assert row.near_next == 1.0 and row.edited_sha256 == hashlib.sha256(b"abab").hexdigest()
    assert imatch.imatch_report(spark.createDataFrame([], schema)).count() == 0


def test_very_long_texts(spark):
    long = " ".join(f"t{i}" for i in range(200_000))
    rows = [(1, long), (2, long + " more"), (3, "short"), (4, long)]
    got = {r.doc_id: r for r in imatch.imatch_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1].fingerprint == got[4].fingerprint and got[1].n_chars == len(long) and got[3].near_next == 0.0
    half = len(long) // 2
    assert got[1].edited_sha256 == hashlib.sha256((long[: len(long) - half] + (long + " more")[:half]).encode()).hexdigest()
