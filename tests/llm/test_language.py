import zlib

import numpy as np

from barloom.llm import language

VOCAB = {"en": "the and of thing that with was are for", "de": "der die und ein zu ich nicht auf für über", "ru": "и в не на что он как это"}


def corpus(n=300):
    rng = np.random.default_rng(3)
    names = sorted(VOCAB)
    return [(i, " ".join(rng.choice(VOCAB[names[i % 3]].split(), int(rng.integers(8, 60)))), names[i % 3], "x") for i in range(n)]


def test_held_out_accuracy_and_rules(spark):
    rows = corpus()
    odd = [(1000, None, "en", "x"), (1001, "123 456 !", "en", "x"), (1002, "the and that", None, "x"), (None, "der die das und", "de", "x"), rows[0], (1003, "", "de", "x"), (1004, "the " * 50000, "en", "x")]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string, score string").repartition(4)
    made = language.language_report(docs).collect()
    assert len(made) == len(rows) + len(odd)
    got = {r.doc_id: r for r in made}
    for i, *_ in rows:
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2)
    held = [r for r in rows if got[r[0]].held_out]
    assert len(held) > 50 and sum(got[i].lang_pred == lang for i, _, lang, _ in held) >= 0.97 * len(held)
    assert got[1000].lang_pred == got[1001].lang_pred == got[1003].lang_pred == "und"
    assert got[1002].lang_pred == "en" and got[1004].lang_pred == "en" and got[None].held_out is False
    assert all(0 <= r.score <= 1 for r in made)


def test_bundle_is_the_sum_of_bound_letters():
    letters = language.letter_vectors(64)
    text = "Ab, cdé"
    s = [0] + [1, 2, 0, 3, 4, 27 + ord("é") % 37] + [0]
    expect = sum(np.roll(letters[a], 2) * np.roll(letters[b], 1) * letters[c] for a, b, c in zip(s, s[1:], s[2:]))
    assert np.array_equal(language.bundle([text], 64)[0], expect.astype(np.float32))


def test_empty(spark):
    assert language.language_report(spark.createDataFrame([], "doc_id long, text string, lang string")).count() == 0
    only = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    assert [(r.lang_pred, r.score) for r in language.language_report(only).collect()] == [("und", 0.0)]


def plain_vector(text, letters):
    """Sum of the bound vectors of a text's trigrams, letter by letter."""
    number = lambda c: 0 if not c.isalpha() else ord(c) - 96 if "a" <= c <= "z" else 27 + ord(c) % 37
    s = [0]
    for c in text:
        low = c.lower()[:1]
        n = number(low if ord(c) < 0x3000 else c)
        if n or s[-1]:
            s.append(n)
    if s[-1]:
        s.append(0)
    total = np.zeros(letters.shape[1])
    for a, b, c in zip(s, s[1:], s[2:]):
        total += np.roll(letters[a], 2) * np.roll(letters[b], 1) * letters[c]
    return total


def test_report_against_brute_force(spark):
    rows = [(i, t + " Straße, 42", lang) for i, t, lang, _ in corpus(90)] + [(200, "Что это? ДА", "ru"), (201, "x", "en")]
    letters = language.letter_vectors().astype(np.int64)
    unit = lambda v: v / max(np.linalg.norm(v), 1e-9)
    sums = {}
    for i, t, lang in rows:
        if zlib.crc32(str(i).encode()) % 4 != 2:
            sums[lang] = sums.get(lang, 0) + plain_vector(t, letters)
    names = sorted(sums)
    profiles = [unit(sums[n]) for n in names]
    centre = np.mean(profiles, axis=0)
    profiles = [unit(p - centre) for p in profiles]
    got = {r.doc_id: r for r in language.language_report(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    for i, t, _ in rows:
        cosines = [float(unit(unit(plain_vector(t, letters)) - centre) @ p) for p in profiles]
        assert got[i].lang_pred == names[int(np.argmax(cosines))] and abs(got[i].score - min(1, max(0, max(cosines)))) < 1e-4
