import itertools
import random
import re
import zlib
from collections import Counter

from barloom.llm import spelling


def plain_near(a, b):
    """Whether one code point is inserted, deleted or replaced, by trying all of them."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return len(long) - len(short) == 1 and any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def plain_report(rows, every=31):
    counts = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % every == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1 :]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}
    near = {w: [v for v in words if plain_near(w, v)] for w in words}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 10 * words[w] else None
    out = []
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), words.get(form[w])))
    return sorted(out)


def corpus():
    rng = random.Random(3)
    base = ["".join(rng.choice("abdeéÀinßr×") for _ in range(rng.randrange(6, 12))) for _ in range(60)]
    base += ["listening", "enlistings", "silentingl", "xyxyxyxyxy", "yxyxyxyxyx"]
    rows = []
    for i in range(1500):
        words = []
        for _ in range(rng.randrange(0, 25)):
            w = base[min(int(rng.paretovariate(0.7)) - 1, len(base) - 1)]
            if rng.random() < 0.15:
                k = rng.randrange(len(w))
                w = rng.choice([w[:k] + w[k + 1 :], w[:k] + "e" + w[k:], w[:k] + "z" + w[k + 1 :], w.upper(), w[:k] + "Ā" + w[k:]])
            words.append(w)
        rows.append((i, rng.choice([" ", ", ", "7", "\n"]).join(words)))
    return rows


def test_report_against_brute_force(spark):
    rows = corpus() + [(None, "listening listening"), (None, None), (7, ""), (8, "listenin listenin"), (8, "listenin listenin"), (9, "q" * 3000 + " " + "q" * 3001 + " " + "q" * 3000 + " " + "q" * 3001)]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, word string").repartition(5)
    got = sorted((tuple(r) for r in spelling.spelling_report(docs).collect()), key=lambda r: r[0])
    assert got == plain_report(rows)
    assert sum(r[1] is not None for r in got) > 30
    assert spelling.spelling_report(docs.limit(0)).count() == 0


def test_chains_of_forms(spark):
    made = spark.createDataFrame([("aaaaaaa", "aaaaaab"), ("aaaaaab", "aaaaabb"), ("aaaaabb", "aaaabbb"), ("aaaabbb", None), ("zzzzzzz", None)], "word string, form string")
    assert {r.word: r.root for r in spelling.with_roots(made).collect()} == {"aaaaaaa": "aaaabbb", "aaaaaab": "aaaabbb", "aaaaabb": "aaaabbb", "aaaabbb": "aaaabbb", "zzzzzzz": "zzzzzzz"}


def test_large_blocks_are_cut_without_loss(spark):
    rng = random.Random(9)
    words = sorted({"".join(rng.choice("ab") for _ in range(rng.randrange(7, 11))) for _ in range(700)})
    table = spark.createDataFrame([(w, k + 2) for k, w in enumerate(words)], "word string, n long").repartition(3)
    expect = sorted(p for p in itertools.combinations(words, 2) if plain_near(*p))
    for size in (8, 64, 4096):
        assert sorted(tuple(sorted((r.a, r.b))) for r in spelling.near_pairs(table, size).collect()) == expect
