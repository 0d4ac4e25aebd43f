"""Personal data: patterns propose spans, checksums confirm them, context scores them.

Everything is built from Spark SQL functions; no text leaves the JVM and nothing
is shuffled. A span's offsets are code points, end exclusive.

The patterns below are anchored forms of simple ones: a lookbehind (or ``\\G``,
the end of the previous match) starts a match only where the leftmost match can
start, and possessive quantifiers never step back. Both keep matching linear on
very long runs of word characters or digits and change no match.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import text_or_empty

PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    # A whole run of single-spaced or dashed digits, if it has 16 to 19 of them.
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}(?![A-Za-z0-9])",
}
#: Kinds in reporting order; iban is an addition to the four base kinds.
BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "iban")

_OCTET = "0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
#: Cheap substring without which a pattern cannot match.
NEEDS = {"email": "@", "phone": "+", "ip": "."}
PRIOR = {"email": 0.7, "ip": 0.5, "card": 0.8, "phone": 0.5, "iban": 0.9}
CONTEXT_WORDS = {
    "email": "e-?mail|mail|contact|write|reach",
    "ip": "ip|host|server|address|client|login",
    "card": "card|visa|credit|debit|payment|account",
    "phone": "phone|tel|call|mobile|fax|contact",
    "iban": "iban|bank|account|transfer|konto",
}
CONTEXT_CHARS = 40
CONTEXT_BONUS = 0.2


def luhn_ok(digits: Column) -> Column:
    """Luhn checksum over a string of decimal digits."""
    backwards = F.reverse(digits)
    total = F.aggregate(
        F.sequence(F.lit(1), F.length(digits)),
        F.lit(0),
        lambda acc, i: acc
        + F.when(i % 2 == 1, F.substring(backwards, i, F.lit(1)).cast("int")).otherwise(
            F.element_at(F.array(*[F.lit(x) for x in (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)]), F.substring(backwards, i, F.lit(1)).cast("int") + 1)
        ),
    )
    return total % 10 == 0


def mod97_ok(iban: Column) -> Column:
    """The account number's remainder by 97 is 1 after its first four characters move to the end."""
    moved = F.concat(F.substring(iban, F.lit(5), F.length(iban)), F.substring(iban, 1, 4))
    rest = F.aggregate(
        F.split(moved, ""),
        F.lit(0),
        lambda acc, c: F.when(c == "", acc)
        .when(F.ascii(c) >= 65, (acc * 100 + F.ascii(c) - 55) % 97)
        .otherwise((acc * 10 + F.ascii(c) - 48) % 97),
    )
    return rest == 1


def _confirmed(kind: str, hit: Column) -> Column:
    digits = F.regexp_replace(hit, "[^0-9]", "")
    if kind == "ip":
        return hit.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$")
    if kind == "card":
        return luhn_ok(digits)
    if kind == "phone":
        return F.length(digits).between(8, 15)
    if kind == "iban":
        return mod97_ok(hit)
    return F.lit(True)


def _spans(text: Column, kind: str) -> Column:
    """Confirmed spans of one kind: array of (kind, start, end, score).

    ``split`` gives the gaps around the matches of ``regexp_extract_all``; the
    running sum of both lengths gives each match's place.
    """
    pattern = PATTERNS[kind]
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    starts = F.aggregate(
        F.arrays_zip(gaps.alias("gap"), hits.alias("hit")),
        F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<bigint>").alias("starts")),
        lambda acc, x: F.struct(
            (acc["at"] + F.length(x["gap"]) + F.coalesce(F.length(x["hit"]), F.lit(0))).alias("at"),
            F.concat(acc["starts"], F.array(acc["at"] + F.length(x["gap"]))).alias("starts"),
        ),
        lambda acc: acc["starts"],
    )
    rows = F.arrays_zip(hits.alias("hit"), F.slice(starts, F.lit(1), F.size(hits)).alias("start"), F.slice(gaps, F.lit(1), F.size(hits)).alias("gap"))
    made = F.transform(
        F.filter(rows, lambda r: _confirmed(kind, r["hit"])),
        lambda r: F.struct(
            F.lit(kind).alias("kind"),
            r["start"].alias("start"),
            (r["start"] + F.length(r["hit"])).alias("end"),
            F.round(
                F.lit(PRIOR[kind])
                + F.when(F.lower(F.right(r["gap"], F.lit(CONTEXT_CHARS))).rlike(rf"\b(?:{CONTEXT_WORDS[kind]})\b"), F.lit(CONTEXT_BONUS)).otherwise(F.lit(0.0)),
                2,
            ).alias("score"),
        ),
    )
    none = F.array().cast("array<struct<kind:string,start:bigint,end:bigint,score:double>>")
    maybe = text.contains(NEEDS[kind]) if kind in NEEDS else F.lit(True)
    # A first look for any match at all is far cheaper than building the arrays.
    return F.when(maybe & text.rlike(pattern), made).otherwise(none)


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Spans of personal data in each document.

    Returns ``id_col`` and ``spans``, an array of (kind, start, end, score) by
    kind in ``KINDS`` order, then start. Scores run from 0 to 1: a kind's prior,
    raised where a context word stands in the 40 characters before the span.

    Null text counts as empty and gives an empty array; a null id stays null;
    repeated rows give repeated results; an empty table gives an empty result;
    other columns are ignored, whatever their names.
    """
    base = docs.select(F.col(id_col), text_or_empty(text_col).alias("__text"))
    each = base.select(id_col, *[_spans(F.col("__text"), k).alias(f"__{k}") for k in KINDS])
    return each.select(id_col, F.concat(*[F.col(f"__{k}") for k in KINDS]).alias("spans"))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _count(kind: str) -> Column:
    return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")


def pii_report(docs: DataFrame) -> DataFrame:
    """One row per document: counts of the base kinds, a digest of the base spans, and all spans."""
    found = find_pii(docs)
    base = F.filter(F.col("spans"), lambda s: s["kind"].isin(*BASE_KINDS))
    return found.select(
        "doc_id",
        *[_count(k).alias(f"n_{k}") for k in BASE_KINDS],
        F.sha2(_joined(base), 256).alias("base_sha256"),
        _joined(F.col("spans")).alias("spans"),
        F.coalesce(F.array_max(F.transform("spans", lambda s: s["score"])), F.lit(0.0)).alias("top_score"),
    )


def sql_for(table: str = "documents") -> str:
    """The report in DuckDB SQL, written with the plain patterns."""
    plain = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
        "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([ -]?[0-9])+",
        "phone": r"\+[0-9][ ().0-9-]+[0-9]",
        "iban": r"[A-Za-z0-9]+",
    }
    digits = "regexp_replace(h, '[^0-9]', '', 'g')"
    backwards = f"[cast(x as int) for x in string_split(reverse({digits}), '')]"
    moved = "h[5:] || h[1:4]"
    ok = {
        "email": "true",
        "ip": "len(list_filter(string_split(h, '.'), lambda p: length(ltrim(p, '0')) > 3 or (length(ltrim(p, '0')) = 3 and ltrim(p, '0') > '255'))) = 0",
        "card": f"length({digits}) between 16 and 19 and list_sum(list_transform({backwards}, lambda d, i: case when i % 2 = 1 then d when d > 4 then 2 * d - 9 else 2 * d end)) % 10 = 0",
        "phone": f"length({digits}) between 8 and 15",
        "iban": "regexp_full_match(h, '[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}') and list_reduce(list_prepend(0::bigint, "
        f"list_transform(string_split({moved}, ''), lambda c: case when c >= 'A' then ascii(c) - 55 else ascii(c) - 48 end::bigint)), "
        "lambda a, v: case when v > 9 then (a * 100 + v) % 97 else (a * 10 + v) % 97 end) = 1",
    }
    parts = ["docs as (select doc_id, coalesce(text, '') t from " + table + ")"]
    for kind in KINDS:
        parts.append(f"{kind}_raw as (select doc_id, regexp_extract_all(t, '{plain[kind]}') hits, string_split_regex(t, '{plain[kind]}') gaps from docs)")
        parts.append(f"{kind}_at as (select doc_id, unnest(hits) h, generate_subscripts(hits, 1) i, hits, gaps from {kind}_raw where len(hits) > 0)")
        parts.append(f"{kind}_ok as (select doc_id, h, i, hits, gaps from {kind}_at where {ok[kind]})")
        context = f"case when regexp_matches(lower(right(gaps[i], {CONTEXT_CHARS})), '\\b(?:{CONTEXT_WORDS[kind]})\\b') then {CONTEXT_BONUS} else 0 end"
        parts.append(
            f"{kind} as (select doc_id, {KINDS.index(kind)} k, '{kind}' kind, list_sum(list_transform(gaps[1:i], lambda g: length(g)))"
            f" + coalesce(list_sum(list_transform(hits[1:i - 1], lambda g: length(g))), 0) s, length(h) n, round({PRIOR[kind]}::double + {context}, 2) score from {kind}_ok)"
        )
    parts.append("spans as (" + " union all ".join(f"select * from {k}" for k in KINDS) + ")")
    said = "kind || ':' || cast(s as bigint) || ':' || cast(s + n as bigint)"
    counts = ", ".join(f"count(*) filter (kind = '{k}') n_{k}" for k in BASE_KINDS)
    parts.append(
        f"per as (select doc_id, {counts}, string_agg({said}, ',' order by k, s) filter (kind <> 'iban') base, string_agg({said}, ',' order by k, s) spans, max(score) top_score from spans group by 1)"
    )
    zeros = ", ".join(f"coalesce(n_{k}, 0)::bigint n_{k}" for k in BASE_KINDS)
    return (
        "with " + ",\n".join(parts) + f"\nselect d.doc_id, {zeros}, sha256(coalesce(base, '')) base_sha256, coalesce(spans, '') spans, "
        "coalesce(top_score, 0)::double top_score from docs d left join per p on d.doc_id = p.doc_id"
    )
