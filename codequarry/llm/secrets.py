"""Operator 3: secrets by patterns and by sliding-window entropy.

Patterns give the base spans. The method reads every run of secret-like characters, sorts it into
a character class (hexadecimal, or letters with digits; and where a run has no digits or no letters, its stretches of letters
alone or of digits alone) and slides a window over it: counts of the
characters in the window change by two per step, and with them sum(c * log2 c), so each step costs
a constant. Windows at or above the class's entropy are merged into spans; windows that overlap an
allow-listed string (UUIDs, placeholders) give none, nor do whole runs that are checksums with a
named algorithm or given strings. A span inside a base span is not reported twice.

Nulls: null text is the empty text, with no spans; redact() leaves it null. Very long texts are scanned whole, in time
linear in their length. Rows with null or repeated doc_id are scanned
like any other, equal rows alike; spans of one start stand in the order of KINDS. Empty tables give empty results. Columns of docs other than doc_id and text are ignored by scan() and kept by
redact(), whatever their names.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections.abc import Collection, Iterator, Sequence
from string import ascii_letters

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codequarry.llm._common import documents, texts_of

KINDS = ("assign", "access", "hex", "entropy_hex", "entropy_mixed", "entropy_letters", "entropy_digits")
WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII)
#: The letters of group 2 stand in both cases already, so IGNORECASE changes group 1 alone.
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
IS_HEX = re.compile(r"[0-9a-f]+|[0-9A-F]+")
#: In runs without digits, and in runs without letters.
ALONE = {"entropy_letters": re.compile(r"[A-Za-z]{20,}"), "entropy_digits": re.compile(r"[0-9]{20,}")}
UUID = re.compile(r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")
CHECKSUM = re.compile(r"(?<![A-Za-z0-9])(md5|sha\d*|crc\d*|integrity|checksum)[^A-Za-z0-9]{0,3}$", re.IGNORECASE)
PLACEHOLDER = re.compile(r"example|placeholder|changeme|xxxx|0000000|1234567", re.IGNORECASE)
WINDOW = 20
#: Least entropy in bits of a window of 20 characters. Long words have up to 3.8.
ENTROPY = {"entropy_hex": 2.9, "entropy_mixed": 3.6, "entropy_letters": 3.85, "entropy_digits": 2.9}
SPANS = "array<struct<kind:string,start:int,end:int>>"


def entropy_spans(text: str, kind: str, window: int = WINDOW, least: dict[str, float] = ENTROPY, barred: Sequence[tuple[int, int]] = ()) -> list[tuple[int, int]]:
    """(start, end) of merged windows whose entropy is at least the class's bound and that overlap no barred place; barred: in order of their starts."""
    if len(text) < window:
        return []
    # entropy = log2(window) - sum(c * log2(c)) / window
    most = (math.log2(window) - least[kind]) * window + 1e-9
    weight = [0.0, *(c * math.log2(c) for c in range(1, window + 2))]
    counts: dict[str, int] = {}
    total, spans, next_bar, clear = 0.0, [], 0, 0  # windows that begin before `clear` overlap a barred place
    for i, c in enumerate(text):
        n = counts.get(c, 0)
        counts[c], total = n + 1, total + weight[n + 1] - weight[n]
        if i >= window:
            n = counts[gone := text[i - window]]
            counts[gone], total = n - 1, total + weight[n - 1] - weight[n]
        while next_bar < len(barred) and barred[next_bar][0] <= i:
            clear = max(clear, barred[next_bar][1])
            next_bar += 1
        a = i - window + 1
        if a >= clear and total <= most:
            if spans and a <= spans[-1][1]:
                spans[-1] = spans[-1][0], i + 1
            else:
                spans.append((a, i + 1))
    return spans


def allowed(text: str, match: re.Match, allow: Collection[str]) -> bool:
    """Whether the run is a given string, or a checksum behind its algorithm's name."""
    return match[0] in allow or bool(CHECKSUM.search(text, max(0, match.start() - 12), match.start()))


def harmless(run: str) -> list[tuple[int, int]]:
    """(start, end) of the UUIDs and placeholders in a run, in order."""
    return sorted(m.span() for pattern in (UUID, PLACEHOLDER) for m in pattern.finditer(run))


def classed(run: str) -> Iterator[tuple[str, int, int]]:
    """(class, start, end) of the parts of a run that are scored, in order."""
    digits, letters = any(c in run for c in "0123456789"), any(c in run for c in ascii_letters)
    if digits and letters:
        yield "entropy_hex" if IS_HEX.fullmatch(run) else "entropy_mixed", 0, len(run)
    else:
        kind = "entropy_letters" if letters else "entropy_digits"
        yield from ((kind, *m.span()) for m in ALONE[kind].finditer(run))


def find(text: str, allow: Collection[str] = ()) -> list[tuple[str, int, int]]:
    """(kind, start, end) of every span by start, then by kind as KINDS lists them; code points."""
    spans = []
    low = text.lower()
    if any(w in low for w in WORDS):
        spans += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        spans += [("access", *m.span()) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    spans += [("hex", *m.span()) for m in HEX.finditer(text)]
    base, at, covered = sorted((x, y) for _, x, y in spans), 0, 0  # covered: where base spans that begin so far end
    for m in CANDIDATE.finditer(text):
        if allowed(text, m, allow):
            continue
        barred = harmless(m[0])
        for kind, x, y in classed(m[0]):
            near = [(p - x, q - x) for p, q in barred[bisect_left(barred, (x - 36, 0)) : bisect_left(barred, (y, 0))]]  # a UUID's length
            for a, b in entropy_spans(m[0][x:y], kind, barred=near):
                a, b = a + x + m.start(), b + x + m.start()
                while at < len(base) and base[at][0] <= a:
                    covered, at = max(covered, base[at][1]), at + 1
                if b > covered:
                    spans.append((kind, a, b))
    return sorted(spans, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def masked(text: str, spans: list[tuple[str, int, int]], mask: str = "[SECRET]") -> str:
    """Text with each run of overlapping spans replaced by mask."""
    out, at, end = [], 0, -1
    for _, a, b in spans:
        if a >= end:
            if end >= 0:
                out.append(mask)
                at = end
            out.append(text[at:a])
        end = max(end, b)
    return "".join(out) + (mask + text[end:] if end >= 0 else text)


def scan(docs: DataFrame, allow: Collection[str] = ()) -> DataFrame:
    """doc_id and spans (kind, start, end) of every row; no shuffle."""
    allow = frozenset(allow)
    kinds = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = [[dict(zip(("kind", "start", "end"), s, strict=True)) for s in find(t, allow)] for t in texts_of(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(spans, kinds)], ["doc_id", "spans"])

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return own.mapInArrow(found, f"doc_id long, spans {SPANS}")


def redact(docs: DataFrame, allow: Collection[str] = ()) -> DataFrame:
    """docs with every span of text masked, and n_chars (where there is one) of the new text."""
    allow = frozenset(allow)

    @F.pandas_udf("string")
    def clean(texts):
        return texts.map(lambda t: t if t is None else masked(t, find(t, allow)))

    out = docs.withColumn("text", clean("text"))
    return out.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"])) if "n_chars" in docs.columns else out


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(documents(spark, sf_dir))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"].isin("assign", "access", "hex"))
    return found.select("doc_id", *map(count, KINDS[:3]), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


QUERIES = {"op3_secrets": op3_secrets}
ORACLE_SQL: dict[str, str] = {}
