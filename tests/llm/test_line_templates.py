import duckdb

from barloom.llm import line_templates

PASSAGE = " ".join(f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60))
CHANGED = PASSAGE.replace("wordhc", "other")
ROWS = [
    (5, "own line of five\n" + PASSAGE + "\nlast own words here"),
    (2, PASSAGE + "\nunique text in two\n\n"),
    (9, CHANGED),
    (7, "job 17 took 3 s\nfine"),
    (8, "job 9 took 44 s\nfine"),
    (3, "a b\na b"),
    (4, "a b"),
    (6, None),
    (1, ""),
    (7, "job 17 took 3 s\nfine"),
    (10, "same words again\nsame words again"),
    (None, PASSAGE),
]


def plain(spark):
    return spark.createDataFrame([(i, t, 1, "k") for i, t in ROWS], "doc_id long, text string, pos int, k1 string")


def test_drops(spark):
    out = line_templates.drop_recurring_lines(plain(spark))
    assert out.columns == ["doc_id", "text", "pos", "k1"]
    got = {r.doc_id: r.text for r in out.collect()}
    assert got[2] == ROWS[1][1] and got[5] == "own line of five\nlast own words here" and got[9] == ""
    assert got[7] == ROWS[3][1] and got[8] == "" and got[3] == "a b\na b" and got[4] == ""
    assert got[6] is None and got[1] == "" and got[10] == ROWS[10][1] and got[None] == PASSAGE
    assert out.count() == len(ROWS)


def test_report_is_the_sql(spark):
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar)")
    rows = [r for r in dict.fromkeys(ROWS) if r[0] is not None]
    con.executemany("insert into documents values (?, ?)", rows)
    made = con.execute(line_templates.sql_for())
    names = [d[0] for d in made.description]
    expect = sorted(tuple(r[names.index(c)] for c in sorted(names)) for r in made.fetchall())
    report = line_templates.line_report(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(tuple(r[c] for c in sorted(names)) for r in report.collect()) == expect


def test_where_lines_may_differ_and_long_texts(spark):
    """Half of the tokens beyond eight may differ, at the end or behind the leading tokens; not in the middle, nor in short lines."""
    words = PASSAGE.split()
    turned = lambda *at: " ".join("zz" if i in at else w for i, w in enumerate(words))
    short = "one two three four five six seven eight nine"
    long = "\n".join(f"{w} {i} thing{chr(97 + i % 26)}" for i, w in enumerate(words * 500))
    rows = [
        (1, PASSAGE + "\n" + short + "\n" + short + " ten"), (2, turned(*range(34, 60))), (3, turned(*range(2, 28))), (4, turned(33)), (5, turned(28)), (6, turned(1)), (7, turned(2, 59)),
        (8, short.replace("nine", "zz") + "\n" + short), (9, short + " eleven"), (20, long), (21, long + "\nlast"), (22, " ".join(words * 500)),
    ]
    got = {r.doc_id: r.text for r in line_templates.drop_recurring_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [i for i in range(2, 8) if got[i] == ""] == [2, 3]
    assert got[8] == short.replace("nine", "zz") and got[9] == "" and got[21] == "last" and got[20] == long and got[22] == rows[-1][1]


def test_empty(spark):
    assert line_templates.line_report(spark.createDataFrame([], "doc_id long, text string")).count() == 0
