"""Secret scan: three fixed patterns, and strings that a primed compressor finds new in a sensitive context.

A candidate is a long mixed string shortly behind a sensitive word, be it the value of ``name=value``. Its novelty is the number of bytes that it adds to a
zstandard frame primed with a dictionary of identifiers and with the text around it, as a share of what a random string of its
length over its own characters adds. What is written in code or repeats its surroundings compresses away; keys do not. A
candidate that ends its line extends over the lines that wrap it.
"""

from __future__ import annotations

import hashlib
import random
import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mediacast.session import bounded_batches

# Fixed values of the three base kinds.
ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
ASSIGN_LENGTH, ACCESS_LENGTH, HEX_LENGTH = 6, 20, 24
KINDS = ("assign", "access", "hex", "novel")

_ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
SENSITIVE = ("key", "pass", "pwd", "secret", "token", "auth", "bearer", "credential", "private", "session", "signature", "cookie")
SHORTEST = 16
_RUN = re.compile(r"[A-Za-z0-9+/_=-]+")
_NAME = re.compile(r"[A-Za-z0-9_-]+")
# Where a candidate can begin: a run of its characters, and in a run every value behind "=".
_START = re.compile(r"(?:(?<![A-Za-z0-9+/_=-])|(?<==))(?!=)(?=[A-Za-z0-9+/_=-]{%d})" % SHORTEST)
# What is judged of a run with several values: the shortest part that ends behind a value and is long enough.
_PIECE = re.compile(r".{%d}[^=]*=*" % SHORTEST)
# The next line of a wrapped value, also where its line break is written as an escape, and the usual widths of such lines.
_LINE = re.compile(r"(?:[ \t]*\r?\n[ \t]*|(?:\\r)?\\n)([A-Za-z0-9+/_=-]+)(?=[ \t]*(?:\r?\n|\Z)|\\[rn]|[\"'])")
_LAST = re.compile(r"(?:[ \t]*\r?\n[ \t]*|(?:\\r)?\\n)-----END ")
WIDTHS = (64, 70, 76)
REACH = 40
AROUND = 512
NOVEL = 0.7
#: The same for letters alone in lower case, where random ones reach 0.9 and words of identifiers less.
NOVEL_LETTERS = 0.85
IDENTIFIERS = " ".join(
    """
    abstract access_token account_id api_version application async authorization await base64 boolean bucket_name callback
    class client_id client_secret config connection const container content_type continue cookie credential_provider database
    default delete encoding encrypt environment export extends false finally function github_token headers host hostname
    http https identifier implements import include instance interface json key_id keystore lambda localhost login method
    module namespace null object oauth2 output package parameter passphrase permission private_key process protected public
    public_key query redirect_uri refresh_token region request response return secret_access_key secret_manager security self
    service_account session_id signature static string struct switch template timeout true undefined user_agent username utf-8
    value variable version virtual void volatile while www_authenticate yield 0123456789 abcdefghijklmnopqrstuvwxyz
    ABCDEFGHIJKLMNOPQRSTUVWXYZ 00000000 11111111 1234567890 deadbeef
    """.split()
)

_IS_HEX = np.zeros(256, bool)
_IS_HEX[[*range(0x30, 0x3A), *range(0x61, 0x67)]] = True


Span = tuple[int, int, int]  # start, kind, end


def _has_hex_run(data: bytes) -> bool:
    """Whether a run of ``HEX_LENGTH`` is possible: it would cover one aligned block of half its length."""
    half = HEX_LENGTH // 2
    whole = np.frombuffer(data, np.uint8, len(data) // half * half)
    return bool(_IS_HEX[whole].reshape(-1, half).all(axis=1).any())


def base_spans(text: str, data: bytes, lower: str) -> list[Span]:
    """Matches of the three base kinds, in code points, sorted by start and kind."""
    spans = []
    if any(w in lower for w in _ASSIGN_WORDS):
        spans.extend((m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LENGTH)
    if "AKIA" in text:
        spans.extend((m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LENGTH)
    if _has_hex_run(data):
        spans.extend((m.start(), 2, m.end()) for m in HEX.finditer(text) if m.end() - m.start() >= HEX_LENGTH)
    return sorted(spans)


def novelty(candidate: str, around: str) -> float:
    """Compressed bytes that the candidate adds after identifiers and its surroundings, as a share of those of a random string."""
    primed = zstandard.ZstdCompressionDict((IDENTIFIERS + "\n" + around).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    level = zstandard.ZstdCompressor(level=9, dict_data=primed, write_content_size=False, write_dict_id=False)
    other = "".join(random.Random(candidate).choices(sorted(set(candidate)), k=len(candidate)))
    empty = len(level.compress(b""))
    return (len(level.compress(candidate.encode())) - empty) / max(1, len(level.compress(other.encode())) - empty)


def is_novel(text: str, start: int, end: int) -> bool:
    """Whether this part of the text is mixed and does not compress, nor, without a digit, its letters in lower case."""
    own = text[start:end]
    if sum(bool(re.search(p, own)) for p in ("[0-9]", "[a-z]", "[A-Z]")) < 2:
        return False
    around = text[max(0, start - AROUND) : start] + " " + text[end : end + AROUND]
    if novelty(own, around) < NOVEL:
        return False
    return bool(re.search("[0-9]", own)) or novelty(own.lower(), around.lower()) >= NOVEL_LETTERS


def wrapped_end(text: str, start: int, end: int) -> int:
    """The end of the lines that go on behind a found value.

    These are lines of nothing but characters of candidates that are as long as the line before or novel by themselves, and a
    shorter one behind lines of one length, behind a line of a usual width, or before an end mark.
    """
    before, last = 0, end - start
    while line := _LINE.match(text, end):
        if _LAST.match(text, end):
            break
        width = line.end() - line.start(1)
        if width != last and not (width >= SHORTEST and is_novel(text, line.start(1), line.end())):
            if width < last and (before == last or last in WIDTHS or _LAST.match(text, line.end())):
                end = line.end()
            break
        before, last, end = last, width, line.end()
    return end


def novel_spans(text: str, lower: str, taken: list[Span]) -> list[Span]:
    """Candidates behind a sensitive word that do not touch a base span and do not compress."""
    words = [w for w in SENSITIVE if w in lower]
    if not words or len(lower) != len(text):
        lower = text.lower() if len(text.lower()) == len(text) else text
        words = [w for w in SENSITIVE if w in lower]
    if not words:
        return []
    starts, reached = [s for s, _, _ in taken], list(accumulate((e for _, _, e in taken), max))
    # the window holds the first characters of every candidate that begins within reach, and of no other
    windows = ((w.end(), min(len(text), w.end() + REACH + SHORTEST)) for w in re.finditer("|".join(words), lower))
    firsts = sorted({m.start() for window in windows for m in _START.finditer(text, *window)})
    spans, done, end = [], 0, 0
    for start, following in zip(firsts, [*firsts[1:], len(text)]):
        if start < done or (start and text[start - 1].isalnum()):
            continue
        if start and text[start - 1] == "\\" and text[start] in "nrt":  # behind an escape
            start += 1
        end = end if start < end else _RUN.match(text, start).end()
        # a name with its value behind it is tried by itself, and the value later
        named = following < end and _NAME.fullmatch(text, start, text.index("=", start, following))
        own = named[0] if named else _PIECE.match(text, start, end)[0]
        if len(own) < SHORTEST:
            continue
        before = bisect_left(starts, end)
        if before and reached[before - 1] > start:
            continue
        if is_novel(text, start, start + len(own)):
            done = wrapped_end(text, start, end)
            if before < len(starts):
                done = min(done, max(end, starts[before]))
            spans.append((start, 3, done))
    return sorted(spans)


def found_spans(text: str | None) -> tuple[list[Span], list[Span]]:
    """``(base, all)`` spans of a text; null is empty."""
    text = text or ""
    data, lower = text.encode(), text.lower()
    base = base_spans(text, data, lower)
    return base, sorted(base + novel_spans(text, lower, base))


def listed(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def secrets(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, n_assign, n_access, n_hex, n_novel, base_sha256, spans)`` for every row.

    Spans are ``kind:start:end`` in code points, end exclusive, by start and kind. Null and empty texts have none. Rows are
    independent, so repeated rows and keys stay as they are; other columns are not read. There is no shuffle.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: list[list[int]] = [[], [], [], []]
            digests, spans = [], []
            for value in batch.column(1):
                base, every = found_spans(value.as_py())
                for kind in range(4):
                    counts[kind].append(sum(s[1] == kind for s in every))
                digests.append(hashlib.sha256(listed(base).encode()).hexdigest())
                spans.append(listed(every))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(digests, pa.string()), pa.array(spans, pa.string())],
                names=["key", "n_assign", "n_access", "n_hex", "n_novel", "base_sha256", "spans"],
            )

    kind = docs.schema[key].dataType.simpleString()
    return (
        docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
        .mapInArrow(scan, f"key {kind}, n_assign long, n_access long, n_hex long, n_novel long, base_sha256 string, spans string")
        .withColumnRenamed("key", key)
    )


def masked(docs: DataFrame, text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every found span of the text replaced by ``mark``; texts without one are unchanged."""
    place = docs.columns.index(text)

    def mask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for value in batch.column(place):
                whole = value.as_py()
                pieces, at = [], 0
                for start, _, end in found_spans(whole)[1]:
                    if end > at:
                        pieces += [whole[at:start], mark] if start >= at else []
                        at = end
                out.append(whole if not pieces else "".join([*pieces, whole[at:]]))
            columns = list(batch.columns)
            columns[place] = pa.array(out, batch.schema.field(place).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return bounded_batches(docs).mapInArrow(mask, docs.schema)
