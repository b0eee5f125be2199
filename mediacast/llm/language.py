"""Language identification by prediction by partial matching.

Every language has a tree of byte contexts of order 0 to 3 with escape probabilities (method C: a context with ``t``
symbols of ``q`` kinds gives ``n / (t + q)`` to a symbol and ``q / (t + q)`` to the escape to the next shorter context).
Trees are frozen after training, so the code length of a byte after its three predecessors is a fixed number; a text's code
length is their sum over all its bytes, exact and independent of how the text is batched. The shortest code wins.

Training keeps the 62 most frequent bytes, A-Z counted as a-z; the others share one symbol and one marks the start of a text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mediacast.llm.word_hashes import text_chunks
from mediacast.session import bounded_batches

UNKNOWN = "und"
#: Bounds of the training sample per language, by the smallest hashes of the keys; texts are taken whole.
TEXTS_PER_LANGUAGE = 400
BYTES_PER_LANGUAGE = 4 << 20
#: Texts are foreign to a language beyond this many times its typical code length and so many bits more.
FOREIGN_TIMES = 2.5
FOREIGN_BITS = 96.0

_SYMBOLS = 64
_OTHER, _START = 62, 63


def held_out(key: str) -> Column:
    """Whether the CRC-32 of the key as text leaves no remainder by 5; a null key is not held out."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 5 == 0, F.lit(False))


@dataclass(frozen=True)
class ContextTrees:
    """Code lengths in bits under all languages, ready for look-up."""

    languages: tuple[str, ...]
    symbols: np.ndarray  # symbol of each byte
    grams: np.ndarray  # sorted codes of four symbols that any language has seen
    seen: np.ndarray  # [gram, language] code length of the last symbol
    escapes: np.ndarray  # [context of three, language] code length of its escape
    shorter: np.ndarray  # [gram of three, language] code length at order 2 and below
    typical: np.ndarray  # [language] mean bits a byte of the training texts


def sample_texts(docs: DataFrame, key: str, text: str, lang: str) -> DataFrame:
    """The bounded training sample ``(lang, text)``: labelled rows that are not held out."""
    rows = docs.where(~held_out(key) & F.col(lang).isNotNull() & (F.length(text) > 0)).select(
        F.col(lang).alias("lang"), F.xxhash64(F.col(key).cast("string")).alias("place"), F.col(text).cast("binary").alias("text")
    )
    ordered = Window.partitionBy("lang").orderBy("place")
    few = rows.withColumn("number", F.row_number().over(ordered)).where(F.col("number") <= TEXTS_PER_LANGUAGE)
    before = F.coalesce(F.sum(F.octet_length("text")).over(ordered.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return few.withColumn("before", before).where((F.col("number") == 1) | (F.col("before") < BYTES_PER_LANGUAGE)).select("lang", "text")


def _symbols_of(counts: np.ndarray) -> np.ndarray:
    folded = counts.copy()
    folded[97:123] += folded[65:91]
    folded[65:91] = 0
    kept = [b for b in np.argsort(-folded, kind="stable")[:_OTHER] if folded[b]]
    table = np.full(256, _OTHER, np.uint8)
    table[kept] = np.arange(len(kept))
    table[65:91] = table[97:123]
    return table


def _grams(data: np.ndarray, offsets: np.ndarray, symbols: np.ndarray) -> np.ndarray:
    """The code of every byte with its three predecessors, 6 bits each."""
    starts = offsets[:-1][offsets[:-1] < offsets[1:]]
    last = symbols[data]
    code, previous = last.astype(np.uint32), last
    for shift in (6, 12, 18):
        moved = np.empty_like(previous)
        moved[1:] = previous[:-1]
        moved[starts] = _START
        code |= moved.astype(np.uint32) << np.uint32(shift)
        previous = moved
    return code


def _trained(codes: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(grams, bits, escape bits of every context)`` of one language at one order."""
    grams, counts = np.unique(codes & np.uint32((1 << 6 * (order + 1)) - 1), return_counts=True)
    contexts = grams >> np.uint32(6)
    size = 1 << 6 * order
    totals = np.bincount(contexts, counts, size)
    kinds = np.bincount(contexts, minlength=size)
    with np.errstate(divide="ignore"):
        escapes = np.where(kinds > 0, -np.log2(np.maximum(kinds, 1) / np.maximum(totals + kinds, 1)), 0.0)
    return grams, -np.log2(counts / (totals + kinds)[contexts]), escapes


def train(texts: dict[str, list[bytes]]) -> ContextTrees:
    """Context trees of the given texts by language."""
    languages = tuple(sorted(texts))
    counts = np.zeros(256, np.int64)
    for own in texts.values():
        for x in own:
            counts += np.bincount(np.frombuffer(x, np.uint8), minlength=256)
    symbols = _symbols_of(counts)
    codes = {}
    for language in languages:
        data = np.frombuffer(b"".join(texts[language]), np.uint8)
        offsets = np.cumsum([0, *map(len, texts[language])])
        codes[language] = _grams(data, offsets, symbols)
    grams = np.unique(np.concatenate([np.zeros(0, np.uint32), *codes.values()]))
    seen = np.zeros((len(grams), len(languages)), np.float32)
    escapes = np.zeros((_SYMBOLS**3, len(languages)), np.float32)
    shorter = np.zeros((_SYMBOLS**3, len(languages)), np.float32)
    for i, language in enumerate(languages):
        dense = np.full(_SYMBOLS, np.log2(_SYMBOLS))
        for order in range(3):
            found, bits, escape = _trained(codes[language], order)
            dense = (escape[:, None] + dense.reshape(-1, _SYMBOLS)[np.arange(len(escape)) % max(len(dense) // _SYMBOLS, 1)]).ravel()
            dense[found] = bits
        shorter[:, i] = dense
        found, bits, escape = _trained(codes[language], 3)
        escapes[:, i] = escape
        seen[:, i] = escape[grams >> np.uint32(6)] + dense[grams & np.uint32(_SYMBOLS**3 - 1)]
        seen[np.searchsorted(grams, found), i] = bits
    typical = np.array([seen[np.searchsorted(grams, codes[x]), i].mean(dtype=np.float64) if len(codes[x]) else 0.0 for i, x in enumerate(languages)])
    return ContextTrees(languages, symbols, grams, seen, escapes, shorter, typical)


def gram_places(trees: ContextTrees) -> tuple[np.ndarray, np.ndarray]:
    """By context of three: the row in ``seen`` of its first gram, and the symbols seen behind it as bits. That is 3 MB, where a row
    number for every possible gram would be 64 MB in every running task."""
    contexts = trees.grams >> np.uint32(6)
    behind = np.zeros(_SYMBOLS**3, np.uint64)
    np.bitwise_or.at(behind, contexts, np.uint64(1) << (trees.grams & np.uint32(_SYMBOLS - 1)).astype(np.uint64))
    return np.searchsorted(contexts, np.arange(_SYMBOLS**3)).astype(np.int32), behind


def code_lengths(trees: ContextTrees, texts: pa.Array, place: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """``[row, language]`` bits of the whole texts."""
    out, (start, behind) = np.zeros((len(texts), len(trees.languages))), place
    for first, data, offsets in text_chunks(texts):
        if not len(data):
            continue
        code = _grams(data, offsets, trees.symbols)
        contexts = code >> np.uint32(6)
        symbols, own = behind[contexts], np.uint64(1) << (code & np.uint32(_SYMBOLS - 1)).astype(np.uint64)
        at = start[contexts] + np.bitwise_count(symbols & (own - np.uint64(1)))
        bits = trees.seen[np.minimum(at, len(trees.seen) - 1)] if len(trees.seen) else np.zeros((len(code), len(trees.languages)), np.float32)
        missing = np.flatnonzero((symbols & own) == 0)
        if len(missing):
            new = code[missing]
            bits[missing] = trees.escapes[new >> np.uint32(6)] + trees.shorter[new & np.uint32(_SYMBOLS**3 - 1)]
        filled = np.flatnonzero(offsets[:-1] < offsets[1:])
        out[first + filled] = np.add.reduceat(bits, offsets[filled], axis=0, dtype=np.float64)
    return out


def predicted(docs: DataFrame, trees: ContextTrees, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, lang_pred, score, bits, typical_bits)``: the language of the shortest code, the share ``2^-bits`` it has among all,
    the length of that code and what training texts of that language would have taken at the text's length.

    Null texts, texts without a letter and, if nothing was learned, all texts are ``und`` with score 0. Ties go to the first
    language by name.
    """
    shared = docs.sparkSession.sparkContext.broadcast(trees)

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = shared.value
        place = gram_places(trees)
        for batch in batches:
            letters = batch.column(2).to_numpy(zero_copy_only=False)
            bits = code_lengths(trees, batch.column(1), place)
            best = bits.argmin(axis=1)
            share = 1 / np.exp2(np.maximum(bits.min(axis=1, keepdims=True) - bits, -1000)).sum(axis=1)
            names = np.array(trees.languages, dtype=object)[best]
            names[~letters] = UNKNOWN
            expected = trees.typical[best] * pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)
            columns = [batch.column(0), pa.array(names, pa.string()), pa.array(np.where(letters, share, 0.0)), pa.array(bits.min(axis=1)), pa.array(expected)]
            yield pa.RecordBatch.from_arrays(columns, names=["key", "lang_pred", "score", "bits", "typical_bits"])

    letter = F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), letter.alias("letter"))
    if not trees.languages:
        return rows.select(F.col("key").alias(key), F.lit(UNKNOWN).alias("lang_pred"), *[F.lit(0.0).alias(c) for c in ("score", "bits", "typical_bits")])
    kind = docs.schema[key].dataType.simpleString()
    return rows.mapInArrow(scores, f"key {kind}, lang_pred string, score double, bits double, typical_bits double").withColumnRenamed("key", key)


def familiar(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", times: float = FOREIGN_TIMES, bits: float = FOREIGN_BITS) -> DataFrame:
    """The rows of ``docs`` that a learned language explains, as they are.

    Null texts, texts without a letter, and texts whose code is longer than ``times`` what is typical of the predicted language and
    ``bits`` more, which is room for short texts, are left out. If nothing was learned, all texts with a letter stay. A row is
    decided where it is read: nothing is joined or shuffled, whatever its key is.
    """
    docs = bounded_batches(docs)
    trees = learned(docs, key, text, lang)
    rows = docs.where(F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)))
    if not trees.languages:
        return rows
    shared, at = docs.sparkSession.sparkContext.broadcast(trees), docs.columns.index(text)

    def explained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = shared.value
        place = gram_places(trees)
        for batch in batches:
            if batch.num_rows:
                lengths = code_lengths(trees, batch.column(at), place)
                typical = trees.typical[lengths.argmin(axis=1)] * pc.binary_length(batch.column(at)).to_numpy(zero_copy_only=False)
                yield batch.filter(pa.array(lengths.min(axis=1) <= times * typical + bits))

    return rows.mapInArrow(explained, docs.schema)


def learned(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> ContextTrees:
    """Trees of the languages of ``docs``, from the bounded sample."""
    texts: dict[str, list[bytes]] = {}
    for row in sample_texts(docs, key, text, lang).toLocalIterator():
        texts.setdefault(row["lang"], []).append(bytes(row["text"]))
    return train(texts)


def languages(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """``(key, held_out, lang_pred, score, bits)`` for every row, learned from the rows that are not held out.

    Repeated rows are predicted alike; other columns are not read. An empty table gives an empty table.
    """
    rows = predicted(docs, learned(docs, key, text, lang), key, text)
    return rows.select(key, held_out(key).alias("held_out"), "lang_pred", "score", "bits")
