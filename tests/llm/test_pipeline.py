import struct
import zlib

import numpy as np

import corpus_pipeline
from barloom.llm import packing, quality, secrets, simhash, tokens


def make(folder):
    import pyarrow as pa
    import pyarrow.parquet as pq

    rng = np.random.default_rng(8)
    words = [f"{a}{b}{c}" for a in "bdfgk" for b in ("an", "or", "it") for c in ("ta", "no", "lle")]
    docs = []
    for i in range(120):
        text = "\n".join(" ".join(rng.choice(words, 12)) for _ in range(4))
        docs.append([i, text, "en", "src1", len(text)])
    shared = " ".join(rng.choice(words, 60))
    for i in (3, 9, 40):
        docs[i][1] += "\n" + shared
    for i in range(10, 120, 10):
        docs[i][1] = docs[i][1].upper().replace(" ", "!! ")
    docs[50 + 1][1] = docs[2][1]
    near = [*docs[73][1].split()[:-1], "ending"]  # other lines, nearly the same words
    docs[74][1] = "\n".join(" ".join(near[i : i + 17]) for i in range(0, len(near), 17))
    docs[61][1] += "\npassword=b7db7aa4a5fcc78305"
    for d in docs:
        d[4] = len(d[1])
    pq.write_table(pa.table(dict(zip(["doc_id", "text", "lang", "source", "n_chars"], map(list, zip(*docs))))), f"{folder}/documents.parquet")
    pq.write_table(pa.table({"doc_id": list(range(120)), "quality": [int(not (i >= 10 and i % 10 == 0)) for i in range(120)], "toxic": [0] * 120}), f"{folder}/labels.parquet")
    return docs


def test_against_a_plain_version(spark, tmp_path):
    make(tmp_path)
    sf = str(tmp_path)
    documents = spark.read.parquet(f"{sf}/documents.parquet")
    # Stage 1 by its own report.
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    good = {r.doc_id for r in quality.quality_report(documents, labels).where("keep").collect()}
    rows = {r.doc_id: r.text for r in documents.collect() if r.doc_id in good}
    assert len(good) == 109 and not {10, 20, 110} & good
    # Stage 2: lines match on their first or last tokens, behind two leading ones; half of the tokens beyond eight may differ.
    first = {}
    lines = {i: t.split("\n") for i, t in rows.items()}

    def keys(line):
        k = ["<*>" if any(c.isdigit() for c in w) else w for w in line.split()]
        free = max(0, (len(k) - 8) // 2)
        return [(len(k), "first", *k[: len(k) - free])] * bool(k) + [(len(k), "last", *k[:2], *k[2 + free :])] * (free > 0)

    for i in sorted(lines):
        for line in lines[i]:
            for k in keys(line):
                first.setdefault(k, i)
    rows = {i: "\n".join(line for line in ls if all(first[k] == i for k in keys(line))) for i, ls in lines.items()}
    assert rows[51] == "" and rows[9].count("\n") == 3 and rows[3].count("\n") == 4
    # Stage 3 by the similarity of all pairs, stage 4 text by text.
    ids = sorted(rows)
    root = {i: i for i in ids}
    grams = {i: plain_shingles(rows[i]) for i in ids}
    for n, i in enumerate(ids):
        for j in ids[:n]:
            if root[i] != root[j] and 10 * len(grams[i] & grams[j]) >= 8 * len(grams[i] | grams[j]):
                low, high = sorted((root[i], root[j]))
                root = {k: low if v == high else v for k, v in root.items()}
    assert any((simhash.fingerprint(rows[root[i]]) ^ simhash.fingerprint(rows[i])).bit_count() > 3 for i in ids)  # not op10's rule
    rows = {i: rows[i] for i in ids if root[i] == i}
    masked = {}
    for i, t in rows.items():
        for s, _, e in reversed(secrets.scan(t, secrets.default_vocabulary())):
            t = t[:s] + "[SECRET]" + t[e:]
        masked[i] = t
    assert "[SECRET]" in masked[61]
    # Stage 5: pieces are what the library makes of each text.
    library = tokens.library_tokenizer(tokens.default_vocabulary())
    expect = set()
    for i, t in masked.items():
        made = [*library.encode(t, add_special_tokens=False).ids, packing.END_ID]
        expect.add((i, 0, len(made), zlib.crc32(struct.pack(f"<{len(made)}I", *made)), len(made)))
    got = corpus_pipeline.run(spark, sf).collect()
    assert {(r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in got} == expect and len(got) == len(expect)


def plain_shingles(text, width=5):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text).split()
    return {" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))}


def test_stages_keep_the_columns(spark, tmp_path):
    make(tmp_path)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.schema.simpleString() == docs.schema.simpleString()
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
