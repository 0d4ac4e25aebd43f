"""Secret scans: shaped patterns plus a token-efficiency test.

A tokenizer's vocabulary covers what people write, so ordinary words and names
take few tokens for their length while random keys take many. A run of key
characters whose characters-per-token ratio under a byte-level BPE vocabulary is
low is reported, unless it is a known digest or identifier (hex digests of the
usual lengths, UUIDs, plain numbers, and words and numbers joined by ``_``, ``-``
or ``/``). Where a whole run passes, its segments between separators, and its
stretches of segments that are no plain words or numbers, are tested alone.
"""

from __future__ import annotations

import base64
import functools
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import text_or_empty

#: Kinds in the order that breaks ties of start; random is found by token efficiency.
KINDS = ("assign", "access", "hex", "random")

ASSIGN = re.compile(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
ASSIGN_MIN, ACCESS_MIN, HEX_MIN = 6, 20, 24

RUN = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
DIGEST_LENGTHS = (32, 40, 56, 64, 96, 128)
HEX_ONLY = re.compile(r"[0-9a-fA-F]+")
UUID = re.compile(r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")
WORD_OR_NUMBER = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")

SEPARATORS = "/=_+-"
SEGMENT = re.compile(r"[^/=_+-]+")
PLAIN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]{1,8}")
SHORTEST = 20

PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
MAX_CHARS_PER_TOKEN = 2.0


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


@functools.cache
def encoder(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("secrets", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def is_known(run: str) -> bool:
    """Digests, UUIDs, plain numbers and joined words: regular, not secret. Linear in the run's length."""
    if HEX_ONLY.fullmatch(run) and len(run) in DIGEST_LENGTHS:
        return True
    if UUID.fullmatch(run) or not re.search("[A-Za-z]", run):
        return True
    if not re.search("[0-9]", run):
        return False
    # Words and numbers, with few changes of kind.
    return len(run.strip(SEPARATORS)) >= 4 * len(WORD_OR_NUMBER.findall(run))


def chars_per_token(run: str, path: str) -> float:
    return len(run) / len(encoder(path).encode_ordinary(run))


def _parts(run: str) -> list[tuple[int, int]]:
    """Spans inside a run, long enough to test: segments, and stretches of segments that aren't plain."""
    found, at = [], None
    segments = [m.span() for m in SEGMENT.finditer(run)]
    for s, e in [*segments, (len(run), len(run))]:
        if s < e and not PLAIN.fullmatch(run, s, e):
            at = (s if at is None else at[0], e)
        elif at is not None:
            found.append(at)
            at = None
    return [x for x in dict.fromkeys([*found, *segments]) if x[1] - x[0] >= SHORTEST and x != (0, len(run))]


def _random_spans(run: str, path: str, limit: float) -> list[tuple[int, int]]:
    """The whole run if it is random, else its random parts, those that overlap as one."""
    random = lambda part: not is_known(part) and chars_per_token(part, path) < limit
    if random(run):
        return [(0, len(run))]
    joined: list[tuple[int, int]] = []
    for s, e in sorted(x for x in _parts(run) if random(run[x[0] : x[1]])):
        if joined and s < joined[-1][1]:
            joined[-1] = (joined[-1][0], max(e, joined[-1][1]))
        else:
            joined.append((s, e))
    return joined


def scan(text: str, path: str, limit: float = MAX_CHARS_PER_TOKEN) -> list[tuple[int, int, int]]:
    """Spans (start, kind index, end) of one text, by start, then kind."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[1]) >= ASSIGN_MIN]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_MIN]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    shaped = sorted((s, e) for s, _, e in found)
    at = 0
    for m in RUN.finditer(text):
        s, last = m.span()
        while at < len(shaped) and shaped[at][0] < last:  # what lies between shaped spans is tested
            found += _random_in(text, s, min(shaped[at][0], last), path, limit)
            s = max(s, shaped[at][1])
            at += 1
        found += _random_in(text, s, last, path, limit)
    return sorted(found)


def _random_in(text: str, s: int, e: int, path: str, limit: float) -> list[tuple[int, int, int]]:
    return [(s + a, 3, s + b) for a, b in _random_spans(text[s:e], path, limit)] if e - s >= SHORTEST else []


def find_secrets(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, limit: float = MAX_CHARS_PER_TOKEN
) -> DataFrame:
    """Secret spans of every whole text: ``id_col`` and ``spans``, an array of (kind, start, end).

    Offsets are code points, end exclusive. Null text counts as empty; null ids
    stay null; repeated rows give repeated results; an empty table gives an empty
    result; other columns are ignored, whatever their names.
    """
    path = vocabulary or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = [[{"kind": KINDS[k], "start": s, "end": e} for s, k, e in scan(t, path, limit)] for t in batch.column(1).to_pylist()]
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, kind)], names=["id", "spans"])

    base = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    kind = base.schema["id"].dataType.simpleString()
    return base.mapInArrow(run, f"id {kind}, spans array<struct<kind:string,start:bigint,end:bigint>>").withColumnRenamed("id", id_col)


def secrets_report(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """One row per document: counts of the base kinds, a digest of the base spans, all spans."""
    spans = F.col("spans")
    said = lambda col: F.array_join(F.transform(col, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return find_secrets(docs, vocabulary=vocabulary).select(
        "doc_id",
        *[count(k) for k in KINDS[:3]],
        F.sha2(said(F.filter(spans, lambda s: s["kind"] != KINDS[3])), 256).alias("base_sha256"),
        said(spans).alias("spans"),
    )


def redact_secrets(docs: DataFrame, text_col: str = "text", vocabulary: str | None = None, limit: float = MAX_CHARS_PER_TOKEN, mask: str = "[SECRET]") -> DataFrame:
    """The same rows with every secret span masked; overlapping spans become one mask.

    Columns, their order and all other values stay, whatever their names; null
    text stays null, empty text empty; repeated rows are masked alike; an empty
    table gives an empty result.
    """
    path = vocabulary or default_vocabulary()
    place = docs.columns.index(text_col)

    def clean(text: str | None) -> str | None:
        if text is None:
            return None
        out, at = [], 0
        for s, _, e in scan(text, path, limit):
            if s >= at:
                out += [text[at:s], mask]
            at = max(at, e)
        return text if not out else "".join(out) + text[at:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kind = batch.schema.field(place).type
            yield batch.set_column(place, batch.schema.field(place), pa.array([clean(t) for t in batch.column(place).to_pylist()], kind))

    return docs.mapInArrow(run, docs.schema)

