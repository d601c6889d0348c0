"""Secret scan: fixed patterns plus a guess-cost test of values in credential context.

A value that follows a credential word ("password: ...", "login = ...") is a
secret if guessing it is expensive. The cost is the cheapest way to cut the
value into dictionary words, dates, repeats, keyboard walks and brute-force
characters; it is found by dynamic programming over the value's positions, in
time proportional to its length (times the longest dictionary word).

Defined results: a NULL or empty text has no spans; a NULL id stays NULL; rows
are independent, so repeated rows give repeated results; only the id and text
columns are read, so extra columns (whatever their names) change nothing.
"""

from __future__ import annotations

import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import map_batches

# The three base patterns. Matches are leftmost and do not overlap within a kind.
ASSIGN = r"(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
ASSIGN_MIN = 12
KINDS = ["assign", "access", "hex", "password"]  # also the order of spans that start together

# Credential context of the guess-cost test: a credential word, a link, a value. After "is", values of letters alone
# read as prose ("the password is wrong") and are left to the base patterns; after a sign the cost decides.
CONTEXT = (r"(?<![A-Za-z0-9])(?:password|passwd|passphrase|passcode|pwd|secret|token|api[_ -]?key|credentials?|login)"
           r"[\"']?(?:\x20*(?:=>|[:=])\x20*|\x20+is:\x20+|\x20+(is)\x20+)[\"']?([!#-&(-~]+)")

# Words that people use in passwords or as placeholders, most common first (the rank is the cost).
WORDS = ["password", "the", "admin", "welcome", "love", "monkey", "dragon", "login", "master", "hello", "secret",
         "letmein", "shadow", "sunshine", "princess", "football", "baseball", "flower", "hunter", "ninja", "summer",
         "winter", "spring", "autumn", "user", "guest", "root", "test", "change", "me", "your", "my", "here", "token",
         "key", "api", "pass", "word", "example", "sample", "default", "none", "null", "true", "false", "and", "is",
         "not", "for", "this", "that", "with", "from", "value", "string", "name", "insert", "enter", "code", "access",
         "private", "public", "company", "family", "freedom", "killer", "soccer", "hockey", "ranger", "tiger",
         "pepper", "cookie", "cheese", "coffee", "computer", "internet", "server", "database", "system", "super",
         "magic", "star", "blue", "green", "black", "white", "red", "silver", "gold", "one", "two", "three",
         "required", "optional", "invalid", "incorrect", "wrong", "expired", "missing", "unknown", "forgotten", "forgot",
         "changed", "protected", "hidden", "removed", "redacted", "masked", "encrypted", "empty", "undefined", "anonymous",
         "administrator", "username", "account", "security", "settings", "management", "manager", "authentication",
         "authorization", "failed", "failure", "success", "successful", "successfully", "please", "should", "must",
         "never", "always", "cannot", "contains", "number", "letters", "characters", "numeric", "placeholder",
         "generated", "generator", "refresh", "bearer", "request", "response", "function", "variable", "parameter",
         "environment", "configuration", "strong", "basic", "reset", "available", "disabled", "enabled"]
RANK = {word: rank for rank, word in enumerate(WORDS, 1)}
LONGEST = max(map(len, WORDS))
WALKS = ["qwertyuiop", "asdfghjkl", "zxcvbnm", "1234567890", "abcdefghijklmnopqrstuvwxyz"]
LEET = str.maketrans("@430$517", "aaeossit")
DATE = re.compile(r"(?:19|20)\d\d[-/.]?(?:0\d|1[0-2])[-/.]?(?:[0-2]\d|3[01])"
                  r"|(?:[0-2]\d|3[01])[-/.]?(?:0\d|1[0-2])[-/.]?(?:19|20)\d\d|(?:19|20)\d\d")
_NEXT = {(a, b) for row in WALKS for a, b in zip(row, row[1:], strict=False)}
_NEXT |= {(b, a) for a, b in _NEXT}
_PIECE = math.log10(2)  # each further piece of a cut doubles the attacker's work


def _char_cost(c: str) -> float:
    if c.isdigit():
        return 1.0
    if c.islower() or c.isupper():
        return math.log10(26)
    return math.log10(33)


def guess_cost(value: str) -> float:
    """log10 of the guesses for ``value``: the minimum over all its cuts into pieces."""
    n = len(value)
    low = value.lower()
    plain = low.translate(LEET)
    dates: dict[int, list[int]] = {}
    for m in (DATE.match(value, i) for i in range(n)):
        if m:
            dates.setdefault(m.end(), []).append(m.start())
    best = [0.0] * (n + 1)
    repeat = walk = 0  # where the current run of one character, or of keyboard neighbours, began
    for end in range(1, n + 1):
        i = end - 1
        if i and low[i] != low[i - 1]:
            repeat = i
        if i and (low[i - 1], low[i]) not in _NEXT:
            walk = i
        cost = best[i] + _char_cost(value[i])
        if end - repeat >= 3:
            cost = min(cost, best[repeat] + _PIECE + _char_cost(value[repeat]) + math.log10(end - repeat))
        if end - walk >= 3:
            cost = min(cost, best[walk] + _PIECE + math.log10(2 * sum(map(len, WALKS)) * (end - walk)))
        for start in dates.get(end, ()):
            cost = min(cost, best[start] + _PIECE + math.log10(365 * (120 if end - start > 4 else 1)))
        for start in range(max(0, end - LONGEST), end - 1):
            rank = RANK.get(plain[start:end]) or RANK.get(low[start:end])
            if rank:
                extra = _PIECE * (value[start:end] != low[start:end]) + _PIECE * (plain[start:end] not in low)
                cost = min(cost, best[start] + _PIECE + math.log10(rank + 1) + extra)
        best[end] = cost
    return best[n]


_assign, _access, _hex = re.compile(ASSIGN, re.I | re.A), re.compile(ACCESS), re.compile(HEX)
_context = re.compile(CONTEXT, re.I | re.A)
_ASSIGN_WORDS = ("passw", "secret", "token", "api")
_CONTEXT_WORDS = ("pass", "pwd", "secret", "token", "api", "credential", "login")


def find_spans(text: str, min_cost: float, min_length: int) -> list[tuple[int, int, int, float | None]]:
    """(start, kind number, end, log10 guesses) of every secret, by start, then kind."""
    found: list[tuple[int, int, int, float | None]] = []
    low = text.lower()
    if any(w in low for w in _ASSIGN_WORDS):
        found += [(m.start(), 0, m.end(), None) for m in _assign.finditer(text) if len(m[1]) >= ASSIGN_MIN]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end(), None) for m in _access.finditer(text)]
    found += [(m.start(), 2, m.end(), None) for m in _hex.finditer(text)]
    if any(w in low for w in _CONTEXT_WORDS):
        for m in _context.finditer(text):
            value = m[2].rstrip(".,;:!?)>]}")
            if m[1] and value.isalpha():
                continue
            if len(value) >= min_length and (cost := guess_cost(value)) >= min_cost:
                found.append((m.start(2), 3, m.start(2) + len(value), cost))
    return sorted(found)


def scan_secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_cost: float = 8.0,
                 min_length: int = 6) -> DataFrame:
    """One row per input row: id, ``spans`` array of (kind, start, end, log10_guesses) in code points.

    ``min_cost``: a context value is a secret from 10**min_cost guesses on.
    """
    schema = f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, " \
             "spans array<struct<kind:string,start:int,end:int,log10_guesses:double>>"

    def scan(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [[{"kind": KINDS[k], "start": a, "end": b, "log10_guesses": c}
                 for a, k, b, c in find_spans(text or "", min_cost, min_length)] for text in batch[1].to_pylist()]
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()),
                                   ("log10_guesses", pa.float64())]))
        return pa.RecordBatch.from_arrays([batch[0], pa.array(rows, kind)], names=[id_col, "spans"])

    return map_batches(df.select(id_col, text_col), scan, schema)


def secret_digest(scanned: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts and digests of ``scan_secrets`` output (see the contract of the query)."""
    def listed(spans):
        return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(
            ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))

    def count(kind):
        return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    spans = F.col("spans")
    return scanned.select(
        id_col, *(count(k) for k in KINDS[:3]),
        F.sha2(listed(F.filter(spans, lambda s: s["kind"] != "password")), 256).alias("base_sha256"),
        listed(spans).alias("spans"), count("password"))
