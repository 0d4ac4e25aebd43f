import hashlib
import random
import zlib
from fractions import Fraction

from barloom.llm import repetition


def plain_runs(words):
    """Runs by comparing every period at every place."""
    n, found = len(words), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and words[j] == words[j + q]:
                j += 1
            if j > i and j - i + q >= max(6, 4 * q):
                found.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted((s, length, q) for (s, length), q in found.items())


def plain_row(doc_id, text, tail=True):
    words = [w for w in "".join(" " if c in " \t\n\v\f\r" else c for c in text or "").split(" ") if w]
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if tail and doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(words)
    kept = [w for i, w in enumerate(words) if not any(s + q <= i < s + length for s, length, q in runs)]
    top = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else (None, None, None)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc_id, len(runs), *top, top[1] * 1000 // top[2] if runs else None, sha("".join(f"{s},{n},{q}\n" for s, n, q in sorted(runs, key=lambda r: (r[0], r[2])))), sha(" ".join(kept)))


def texts():
    rng = random.Random(5)
    word = lambda k: rng.choice("abcdefgh"[:k])
    made = [" ".join(word(k) for _ in range(rng.randrange(0, 120))) for k in (1, 2, 2, 3, 5, 8) for _ in range(25)]
    for _ in range(80):  # planted runs of all periods, one after another and one within another
        parts = []
        for _ in range(rng.randrange(1, 4)):
            unit = [word(8) for _ in range(rng.randrange(1, 40))]
            inner = unit * rng.randrange(1, 9)
            parts += inner[: len(inner) - rng.randrange(0, len(unit))] + [word(8) for _ in range(rng.randrange(0, 5))]
        made.append(rng.choice([" ", "\n", " \t"]).join(parts))
    return made


def test_report_against_brute_force(spark):
    rows = [(i, t, "x") for i, t in enumerate(texts())]
    rows += [(None, "a a a a a a a", "x"), (None, "a a a a a a a", "x"), (None, None, "x"), (9000, "", "x"), (9001, None, None), (9001, "b", "x"), (9002, "a a " * 30, "x"), rows[3]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, words string").repartition(5)
    got = sorted((tuple(r) for r in repetition.runs_report(docs).collect()), key=repr)
    expect = sorted((plain_row(i, t) for i, t, _ in rows), key=repr)
    assert got == expect
    assert sum(r[1] > 0 for r in got) > 80 and max(r[4] or 0 for r in got) > 20


def test_very_long_texts_and_empty_table(spark):
    unit = [f"w{i}" for i in range(9000)]
    rows = [(1, " ".join(unit * 5 + unit[:77])), (3, "x " * 60_000), (5, " ".join(unit) + " " + "x y " * 5000)]
    got = {r.doc_id: r for r in repetition.runs_report(spark.createDataFrame(rows, "doc_id long, text string"), tail=False).collect()}
    assert (got[1].n_runs, got[1].start, got[1].length, got[1].period) == (1, 0, 45_077, 9000)
    assert got[1].collapsed_sha256 == hashlib.sha256(" ".join(unit).encode()).hexdigest()
    assert (got[3].n_runs, got[3].length, got[3].exponent_milli) == (1, 60_000, 60_000_000)
    assert got[3].collapsed_sha256 == hashlib.sha256(b"x").hexdigest()
    assert (got[5].n_runs, got[5].start, got[5].period) == (1, 9000, 2)
    assert repetition.runs_report(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_text_ids(spark):
    got = repetition.runs_report(spark.createDataFrame([("k", "a b a b a b a b")], "doc_id string, text string"), tail=False).first()
    assert (got.doc_id, got.n_runs, got.start, got.length, got.period, got.exponent_milli) == ("k", 1, 0, 8, 2, 4000)
