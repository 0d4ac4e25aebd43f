"""Line dedup with a log-template tree of fixed depth, in DataFrame functions only.

A line's tokens lead down the tree: first their number, then the leading tokens,
where a token with a digit counts as the variable field ``<*>``. The leaf keeps
templates in which a run of further tokens is variable: half of what a line has
beyond ``FIXED`` tokens, once at its end and once right behind the leading tokens.
So two lines match if they agree on their first or last tokens, on ``FIXED`` and
half of the rest at least; lines of up to ``FIXED`` + 1 tokens match as a whole.
A line without a token has no template.

A template that occurs in more than one document recurs. Its lines are dropped
from every document but the one with the smallest id, so one copy of each
passage stays. Templates are told apart by 96 bits of hashes; what is shuffled
are hashes, ids and line numbers, and each text once, to drop its lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import cut_lineage, text_or_empty

LEADING = 2
#: Tokens of a line that no template leaves variable.
FIXED = 8
VARIABLE = "<*>"
BLANKS = r"[ \t\r\x0B\f]+"


def _masked(line: Column) -> Column:
    tokens = F.filter(F.split(line, BLANKS), lambda t: t != "")
    return F.when(line.rlike("[0-9]"), F.transform(tokens, lambda t: F.when(t.rlike("[0-9]"), F.lit(VARIABLE)).otherwise(t))).otherwise(tokens)


def _key(*parts: Column) -> Column:
    return F.struct(F.xxhash64(*parts).alias("k1"), F.hash(*parts).alias("k2"))


def _template_keys(tokens: Column) -> Column:
    n = F.size(tokens)
    free = F.greatest(F.lit(0), F.floor((n - FIXED) / 2)).cast("int")
    lead, fixed = F.slice(tokens, 1, LEADING), F.greatest(F.lit(0), n - LEADING - free)
    first = _key(n, lead, F.lit("first"), F.slice(tokens, F.lit(LEADING + 1), fixed))
    last = _key(n, lead, F.lit("last"), F.slice(tokens, F.lit(LEADING + 1) + free, fixed))
    return F.when(free > 0, F.array(first, last)).otherwise(F.array(first))


def recurring_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Lines to drop: (id, h, dropped), with h the text's hash and dropped an array of line numbers from 0."""
    base = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("t"))
    # Hashed before lines are told apart, else every line would carry its text and hash it again.
    lines = base.withColumn("h", F.xxhash64("t")).select("id", "h", F.posexplode(F.split("t", "\n")).alias("pos", "line"))
    tokens = lines.select("id", "h", "pos", _masked(F.col("line")).alias("tokens")).where(F.size("tokens") > 0)
    keys = cut_lineage(tokens.select("id", "h", "pos", F.explode(_template_keys(F.col("tokens"))).alias("k")).select("id", "h", "pos", "k.k1", "k.k2"))
    # Written first, so that the join reads two plain shuffles and Spark can split a hot template's lines.
    recurring = cut_lineage(keys.groupBy("k1", "k2").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first < last").select("k1", "k2", "first"))
    met = keys.join(recurring, ["k1", "k2"]).where(F.col("id") > F.col("first"))
    return met.groupBy("id", "h").agg(F.collect_set("pos").alias("dropped"))


def drop_recurring_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", report: bool = False) -> DataFrame:
    """``docs`` without the lines whose template an earlier document has.

    Rows and columns stay; only texts change. With ``report`` the columns
    n_lines, n_dropped and dropped (line numbers, ascending) are added.

    Ids are compared as they are; rows that share an id are one document. Rows
    with a null id pass unchanged and count for nobody. Null text stays null and
    empty text empty. A document whose every line is dropped keeps its row with
    empty text. Repeated rows are treated alike; an empty table gives an empty
    result; names of other columns may clash with nothing here.
    """
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("r"))
    text = F.coalesce(F.col(f"r.{text_col}").cast("string"), F.lit(""))
    keyed = row.select("r", F.col(f"r.{id_col}").alias("id1"), F.xxhash64(text).alias("h1"))
    joined = keyed.join(recurring_lines(docs, id_col, text_col), (F.col("id1") == F.col("id")) & (F.col("h1") == F.col("h")), "left")
    lines = F.split(text, "\n")
    kept = lambda of: F.array_except(F.sequence(F.lit(0), F.size(of) - 1), F.col("dropped"))
    # Within the outer function the lines are a value; written out in the inner one, each line would split the text anew.
    cut = F.transform(F.array(lines), lambda of: F.array_join(F.transform(kept(of), lambda i: F.get(of, i)), "\n"))[0]
    new_text = F.when(F.col("dropped").isNull(), F.col(f"r.{text_col}")).otherwise(cut)
    out = [new_text.alias(c) if c == text_col else F.col(f"r.`{c}`").alias(c) for c in docs.columns]
    if report:
        gone = F.coalesce(F.array_sort("dropped"), F.array().cast("array<int>"))
        out += [F.size(lines).cast("long").alias("n_lines"), F.size(gone).cast("long").alias("n_dropped"), gone.alias("dropped")]
    return joined.select(*out)


def line_report(docs: DataFrame) -> DataFrame:
    """One row per document: how many lines it has, which ones go, and a digest of what stays."""
    done = drop_recurring_lines(docs.select("doc_id", "text"), report=True)
    return done.select(
        "doc_id",
        "n_lines",
        "n_dropped",
        F.array_join(F.col("dropped").cast("array<string>"), ",").alias("dropped"),
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"),
    )


def sql_for(table: str = "documents") -> str:
    blanks = "[ \\t\\r\\x0B\\f]+"
    n, free = "len(k)", f"greatest(0, cast(floor((len(k) - {FIXED}) / 2) as bigint))"
    part = lambda name, rest, where: f"select doc_id, t, pos, {{'n': {n}, 'lead': k[1:{LEADING}], 'part': '{name}', 'rest': {rest}}} key from tokens where {where}"
    return f"""with docs as (select doc_id, coalesce(text, '') t from {table}),
lines as (select doc_id, t, unnest(string_split(t, chr(10))) line, generate_subscripts(string_split(t, chr(10)), 1) - 1 pos from docs where doc_id is not null),
tokens as (select doc_id, t, pos, list_transform(list_filter(string_split_regex(line, '{blanks}'), lambda x: x <> ''),
  lambda x: case when regexp_matches(x, '[0-9]') then '{VARIABLE}' else x end) k from lines),
keys as ({part("first", f"k[{LEADING + 1}:{n} - {free}]", f"{n} > 0")} union all {part("last", f"k[{LEADING + 1} + {free}:]", f"{free} > 0")}),
recurring as (select key, min(doc_id) first from keys group by 1 having min(doc_id) < max(doc_id)),
drops as (select distinct k.doc_id, k.t, k.pos from keys k join recurring r on k.key = r.key where k.doc_id > r.first),
gone as (select doc_id, t, list(pos order by pos) dropped from drops group by 1, 2)
select d.doc_id, len(string_split(d.t, chr(10)))::bigint n_lines, coalesce(len(dropped), 0)::bigint n_dropped,
  coalesce(array_to_string(dropped, ','), '') dropped,
  sha256(case when dropped is null then d.t else coalesce(array_to_string(list_transform(list_filter(range(len(string_split(d.t, chr(10)))),
    lambda i: not list_contains(dropped, i)), lambda i: string_split(d.t, chr(10))[i + 1]), chr(10)), '') end) kept_sha256
from docs d left join gone g on d.doc_id = g.doc_id and d.t = g.t"""
