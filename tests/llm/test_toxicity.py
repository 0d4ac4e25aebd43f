import itertools
import random
import zlib

import numpy as np
import pytest

from barloom.llm import language, toxicity

CLEAN = "river stone listen morning paper window garden simple people moment letter winter market street teacher".split()
BAD = ["moronic", "scumbag", "loser"]


def document(rng, bad, disguise=False, n=None):
    words = [rng.choice(CLEAN) for _ in range(n or rng.randrange(3, 60))]
    for _ in range(bad):
        w = rng.choice(BAD)
        if disguise:
            w = rng.choice([w.replace("o", "0").replace("s", "$"), " ".join(w), w.replace("o", "oooo").replace("u", "uuu"), ".".join(w)])
        words.insert(rng.randrange(len(words) + 1), w)
    return " ".join(words)


@pytest.fixture(scope="module")
def letters(spark):
    rng = random.Random(1)
    docs = spark.createDataFrame([(document(rng, k % 3),) for k in range(300)], "text string").repartition(4)
    return toxicity.Letters.of(toxicity.trigram_counts(docs))


def test_trigram_counts_cover_all_texts(spark):
    texts = ["ab, cd", "", "Straße 42", "ab"] * 3
    got = toxicity.trigram_counts(spark.createDataFrame([(t,) for t in texts] + [(None,)], "text string").coalesce(1))
    assert np.array_equal(got, np.bincount(language.trigrams(" ".join([*texts, ""])), minlength=language.GRAMS))


def test_restores_disguised_words(letters):
    for shown, meant in (("m0r0nic", "moronic"), ("$cumb@g", "scumbag"), ("l o s e r", "loser"), ("l.o.s.e.r", "loser"), ("loooooser", "loser"), ("5 c u m b 4 g", "scumbag"), ("m-0-r-0-n-1-c", "moronic")):
        assert meant in toxicity.restore(shown, letters).split(), shown


def test_viterbi_finds_the_best_path(letters):
    """Against all paths through short lattices."""
    table = language.slot_table()
    slot = lambda c: 0 if c == " " else int(table[ord(c)])

    def total(path):
        score, said = 0.0, []
        for letter, cost in path:
            score += cost
            if letter == "" or letter == " " and (not said or said[-1] == " "):
                continue
            a, b = ([" ", " "] + said)[-2:]
            score += float(letters.logs[slot(a), slot(b), slot(letter)])
            said.append(letter)
        return score, "".join(said).strip()

    for span in ("l0s3r", "sc.um", "o oo", "1!|", "a-b-c", "st00ne", "x_1"):
        paths = itertools.product(*toxicity.lattice(span), [(" ", 0.0)])
        best = max(map(total, paths), key=lambda p: p[0])
        got = toxicity.restore(span, letters)
        assert got == best[1] or abs(max(s for s, t in map(total, itertools.product(*toxicity.lattice(span), [(" ", 0.0)])) if t == got) - best[0]) < 1e-4


def test_held_out_documents_and_rules(spark):
    rng = random.Random(2)
    rows = [(i, document(rng, (i % 4 == 0) * rng.randrange(1, 4)), "x") for i in range(800)]
    labels = [(i, int(i % 4 == 0), 1) for i in range(600)]
    odd = [(2000, document(rng, 2, True, 20), "x") for _ in range(40)] + [(2001, None, "x"), (2002, "", None), (None, "river loser", "x"), (None, "river loser", "x"), (2003, "loser " + "river " * 60_000, "x"), (2004, "a " * 5000, "x"), rows[1]]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string, score string").repartition(5)
    table = spark.createDataFrame(labels + [(0, 1, 1), (None, 1, 1), (5, None, 1), (6, 7, 1)], "doc_id long, toxic int, quality int")
    made = toxicity.toxicity_report(docs, table).collect()
    assert len(made) == len(rows) + len(odd)
    for r in made:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
    got = {r.doc_id: r.predicted for r in made}
    held = [i for i, *_ in rows if zlib.crc32(str(i).encode()) % 5 == 0 or i >= 600]
    assert sum(got[i] == (i % 4 == 0) for i in held) >= 0.98 * len(held)
    assert np.mean([r.predicted for r in made if r.doc_id == 2000]) >= 0.9
    assert got[2001] == got[2002] == got[2004] == 0 and got[None] == got[2003] == 1


def test_without_labels(spark):
    docs = spark.createDataFrame([(1, "loser"), (2, "river")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [r.score for r in toxicity.toxicity_report(docs, none).collect()] == [0.0, 0.0]
    assert toxicity.toxicity_report(docs.limit(0), none).count() == 0
