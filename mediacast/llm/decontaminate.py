"""Benchmark decontamination: a BM25 index of test items asked with every passage of the corpus.

An index has items of similar length. Passages are two neighbouring segments of a text, each as long as an item of the index can be, so that every item lies whole
in one passage. The index is posting lists of (block, highest impact) per term over blocks of ``BLOCK`` items, next to the postings of
the items themselves. Terms whose highest impacts in a block stay together below a share of the least threshold there are left out of the lists,
as WAND leaves lists that cannot decide alone; a passage skips all blocks in which its listed terms and those left out cannot reach
the threshold, and is scored exactly against the items of the others. Whatever reaches the threshold, a share of an item's own score, is verified: shingles of
the item's question and of its answer must both stand in the passage. For a part of few words, in which one edit breaks most
shingles, shingles of the whole item count instead. Quotes, brackets and sentence marks do not belong to words.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mediacast.llm.word_hashes import shingles, text_chunks, words
from mediacast.session import bounded_batches, stage

K1, B = 1.2, 0.75
SHARE = 0.6
OVERLAP = 0.5
WORD_OVERLAP = 0.75
WORDS = 5
#: A part of fewer words is verified by the whole item.
FEW = 10
BLOCK = 8
#: Share of a block's least threshold that the terms left out of the lists may reach together.
LEFT_OUT = 0.1
#: Bytes of the indexes of one broadcast, by an estimate of ``POSTING_BYTES`` for every word of an item; more items are more passes.
INDEX_BYTES = 16 << 20
#: List entries that are added up at a time.
ENTRIES = 1 << 20
POSTING_BYTES = 40

Part = tuple[int, int, np.ndarray]  # words, words of a shingle, shingles


@dataclass(frozen=True)
class Index:
    """Items of similar length, in blocks; ragged arrays have their offsets beside them."""

    items: np.ndarray
    length: int  # most words that an item of this index can have, so passages do not depend on the items of a pass
    terms: np.ndarray  # sorted word hashes
    lists: np.ndarray  # offsets of the posting lists by term
    blocks: np.ndarray  # block of a list entry
    highest: np.ndarray  # highest impact of the term in that block
    left_out: np.ndarray  # by block, what its terms outside the lists can add up to
    least: np.ndarray  # least needed score of each block
    held: np.ndarray  # offsets of the postings by block
    posted: np.ndarray  # term of a posting
    places: np.ndarray  # item of a posting, by its place in the block
    impacts: np.ndarray
    needed: np.ndarray  # score that an item asks for
    questions: list[Part]
    answers: list[Part]
    wholes: list[Part]

    def size(self) -> int:
        """Bytes of all arrays."""
        parts = [p[2] for parts in (self.questions, self.answers, self.wholes) for p in parts]
        return sum(x.nbytes for x in [*(v for v in vars(self).values() if isinstance(v, np.ndarray)), *parts])


@dataclass(frozen=True)
class Statistics:
    """What BM25 asks of all items, also of those in other passes."""

    items: int
    mean: float  # words of an item
    terms: np.ndarray  # sorted word hashes, at least those of the items to be indexed
    counts: np.ndarray  # items that hold the term


_MARKS = np.arange(256, dtype=np.uint8)
_MARKS[list(b"\"'`()[]{}<>.,;:!?")] = 0x20


def plain_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(hashes, word offsets of the rows)`` with quotes, brackets and sentence marks read as blanks; a row of nothing else keeps its words."""
    plain = _MARKS[data]
    # general punctuation of quotes, dots and dashes (E2 80 90-AF), guillemets (C2 AB, C2 BB), inverted marks (C2 A1, C2 BF)
    for at in (np.flatnonzero(data[:-2] == 0xE2),) if len(data) > 2 else ():
        at = at[(data[at + 1] == 0x80) & (data[at + 2] >= 0x90) & (data[at + 2] <= 0xAF)]
        plain[at] = plain[at + 1] = plain[at + 2] = 0x20
    for at in (np.flatnonzero(data[:-1] == 0xC2),) if len(data) > 1 else ():
        at = at[np.isin(data[at + 1], np.array([0xA1, 0xAB, 0xBB, 0xBF], np.uint8))]
        plain[at] = plain[at + 1] = 0x20
    _, _, hashes, rows = words(plain, offsets)
    bare = np.flatnonzero(np.diff(rows) == 0)
    bare = bare[offsets[bare] < offsets[bare + 1]]
    if len(bare):
        for row in bare:
            own = slice(offsets[row], offsets[row + 1])
            plain[own] = data[own]
        _, _, hashes, rows = words(plain, offsets)
    return hashes, rows


def question_and_answer(text: str) -> tuple[str, str]:
    """Up to the first question mark and the rest; else all but the last sentence and that; else two halves."""
    mark = text.find("?")
    if 0 <= mark and text[mark + 1 :].strip():
        return text[: mark + 1], text[mark + 1 :]
    sentences = [m.end() for m in re.finditer(r"[.!?](?=\s+\S)", text)]
    if sentences:
        return text[: sentences[-1]], text[sentences[-1] :]
    pieces = text.split()
    return " ".join(pieces[: len(pieces) // 2]), " ".join(pieces[len(pieces) // 2 :])


def _hashes_of(text: str) -> np.ndarray:
    for _, data, offsets in text_chunks(pa.array([text])):
        return plain_words(data, offsets)[0]
    return np.zeros(0, np.uint64)


def _part_of(text: str) -> Part:
    """A part of an item; the shingles of a short one are so short that one edited word breaks half of them at most."""
    hashes = _hashes_of(text)
    size = max(1, min(WORDS, (len(hashes) + 1) // 3))
    return len(hashes), size, np.unique(shingles(hashes, np.array([0, len(hashes)]), size)[0])


def build_indexes(items: list[tuple[int, str]], statistics: Statistics | None = None) -> list[Index]:
    """One index per doubling of the length in words, with the statistics given or else those of the items. Items without words are left out."""
    found = []
    for item, text in items:
        hashes = _hashes_of(text)
        if len(hashes):
            found.append((len(hashes), item, text, *np.unique(hashes, return_counts=True)))
    found.sort(key=lambda x: (x[0], x[1]))
    if not found:
        return []
    if statistics is None:
        statistics = Statistics(len(found), float(np.mean([f[0] for f in found])), *np.unique(np.concatenate([f[3] for f in found]), return_counts=True))
    idf = np.log(1 + (statistics.items - statistics.counts + 0.5) / (statistics.counts + 0.5))
    by_class: dict[int, list] = {}
    for f in found:
        by_class.setdefault(f[0].bit_length(), []).append(f)
    return [_index(some, statistics, idf) for some in by_class.values()]


def _index(some: list, statistics: Statistics, idf: np.ndarray) -> Index:
    terms, posted = np.unique(np.concatenate([f[3] for f in some]), return_inverse=True)
    counts = np.concatenate([f[4] for f in some])
    item = np.repeat(np.arange(len(some)), [len(f[3]) for f in some])
    length = np.array([f[0] for f in some], np.float64)
    weight = idf[np.searchsorted(statistics.terms, terms)]
    impacts = (weight[posted] * counts * (K1 + 1) / (counts + K1 * (1 - B + B * length[item] / statistics.mean))).astype(np.float32)
    needed = SHARE * np.bincount(item, impacts.astype(np.float64), len(some))
    block = item // BLOCK
    blocks = -(-len(some) // BLOCK)
    least = np.array([needed[b * BLOCK : (b + 1) * BLOCK].min() for b in range(blocks)])
    # the highest impact of every term in every block that has it
    order = np.lexsort((posted, block))
    held = np.searchsorted(block[order], np.arange(blocks + 1))
    key = block[order] * len(terms) + posted[order]
    starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    highest, of_block, of_term = np.maximum.reduceat(impacts[order], starts), key[starts] // len(terms), key[starts] % len(terms)
    # of every block its weakest terms, as long as they stay below the share
    weak = np.lexsort((highest, of_block))
    sums = np.cumsum(highest[weak], dtype=np.float64)
    first = np.searchsorted(of_block[weak], np.arange(blocks))
    before = np.where(first > 0, sums[first - 1], 0.0)
    out = np.zeros(len(highest), bool)
    out[weak] = sums - before[of_block[weak]] <= LEFT_OUT * least[of_block[weak]]
    left_out = np.bincount(of_block[out], highest[out].astype(np.float64), blocks)
    by_term = np.lexsort((of_block[~out], of_term[~out]))
    parts = [question_and_answer(f[2]) for f in some]
    return Index(
        np.array([f[1] for f in some], np.int64), (1 << some[0][0].bit_length()) - 1, terms,
        np.searchsorted(of_term[~out][by_term], np.arange(len(terms) + 1)).astype(np.int32),
        of_block[~out][by_term].astype(np.int32), highest[~out][by_term], left_out, least,
        held.astype(np.int32), posted[order].astype(np.int32), (item[order] % BLOCK).astype(np.int8), impacts[order], needed,
        [_part_of(q) for q, _ in parts], [_part_of(a) for _, a in parts], [_part_of(f[2]) for f in some],
    )


def _contained(part: Part, hashes: np.ndarray) -> float:
    """The share of the part's shingles that the passage holds."""
    _, size, wanted = part
    return float(np.isin(wanted, shingles(hashes, np.array([0, len(hashes)]), size)[0]).mean()) if len(wanted) else 1.0


def _holds(part: Part, share: float) -> bool:
    """Whether this share of the part is enough; single words stand anywhere in a passage and have to be more."""
    return share >= (OVERLAP if part[1] > 1 else WORD_OVERLAP)


def _reached(index: Index, passage_of: np.ndarray, terms: np.ndarray, starts: np.ndarray) -> Iterator[tuple[int, int]]:
    """``(number of the passage, block)`` where the listed terms of the passage and those left out may reach the least threshold."""
    lengths = index.lists[terms + 1] - index.lists[terms]
    ends = np.cumsum(lengths)
    number = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(terms))))
    blocks = len(index.least)
    done = 0
    while done < len(terms):
        # whole passages of a bounded number of list entries, or one passage
        base = ends[done] - lengths[done]
        stop = int(np.searchsorted(ends, base + ENTRIES, "right"))
        stop = int(starts[np.searchsorted(starts, stop, "right") - 1]) if stop < len(terms) else stop
        if stop <= done:
            following = np.searchsorted(starts, done, "right")
            stop = int(starts[following]) if following < len(starts) else len(terms)
        some = slice(done, stop)
        count = lengths[some]
        entry = np.arange(count.sum()) + np.repeat(index.lists[terms[some]] - (np.cumsum(count) - count), count)
        key = np.repeat(number[some].astype(np.int64), count) * blocks + index.blocks[entry]
        order = np.argsort(key, kind="stable")
        key = key[order]
        if len(key):
            first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            bound = np.add.reduceat(index.highest[entry[order]], first, dtype=np.float64)
            block = key[first] % blocks
            hit = np.flatnonzero(bound + index.left_out[block] >= index.least[block] * (1 - 1e-4))
            yield from zip((key[first[hit]] // blocks).tolist(), block[hit].tolist())
        done = stop


def matches(index: Index, hashes: np.ndarray, rows: np.ndarray) -> Iterator[tuple[int, int, float, float, float]]:
    """``(row, item, share of the item's score, question overlap, answer overlap)`` of the verified passages of a chunk."""
    at = np.minimum(np.searchsorted(index.terms, hashes), len(index.terms) - 1)
    known = np.flatnonzero(index.terms[at] == hashes)
    if not len(known):
        return
    per_row = -(-np.diff(rows) // index.length)
    first_segment = np.concatenate([[0], np.cumsum(per_row)])
    row = np.searchsorted(rows, known, "right") - 1
    segment = first_segment[row] + (known - rows[row]) // index.length
    # the distinct terms of every passage: a segment is in the passage that it begins and in the one that it ends
    width = len(index.terms)
    begins = segment * width + at[known]
    ends_too = begins[segment > first_segment[row]] - width
    pairs = np.sort(np.concatenate([begins, ends_too]))
    pairs = pairs[np.concatenate([[True], pairs[1:] != pairs[:-1]])]
    passage_of, terms = pairs // width, pairs % width
    starts = np.flatnonzero(np.concatenate([[True], passage_of[1:] != passage_of[:-1]]))
    ends = np.append(starts[1:], len(pairs))
    for place, block in _reached(index, passage_of, terms, starts):
        own = terms[starts[place] : ends[place]]
        postings = slice(index.held[block], index.held[block + 1])
        posted = index.posted[postings]
        found = np.minimum(np.searchsorted(own, posted), len(own) - 1)
        present = own[found] == posted
        scores = np.bincount(index.places[postings][present], index.impacts[postings][present].astype(np.float64), BLOCK)
        items = slice(block * BLOCK, (block + 1) * BLOCK)
        for i in np.flatnonzero(scores[: len(index.needed[items])] >= index.needed[items] * (1 - 1e-6)):
            item, passage = block * BLOCK + i, passage_of[starts[place]]
            row = int(np.searchsorted(first_segment, passage, "right")) - 1
            start = rows[row] + (passage - first_segment[row]) * index.length
            own_words = hashes[start : min(rows[row + 1], start + 2 * index.length)]
            question, answer = _contained(index.questions[item], own_words), _contained(index.answers[item], own_words)
            parts = [(index.questions[item], question), (index.answers[item], answer)]
            held = [_holds(*p) for p in parts]
            if not all(held) and all(h or p[0] < FEW for h, (p, _) in zip(held, parts)):
                held = [_holds(index.wholes[item], _contained(index.wholes[item], own_words))]
            if all(held):
                yield row, item, float(scores[i] / index.needed[item] * SHARE), question, answer


def _counts(items: DataFrame) -> DataFrame:
    """``(term, items, words)`` of all items: those that hold the term, and for the null term all items with words and their words."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, data, offsets in text_chunks(batch.column(0)):
                hashes, rows = plain_words(data, offsets)
                own = [np.unique(hashes[a:b]) for a, b in zip(rows[:-1], rows[1:])]
                terms, counts = np.unique(np.concatenate([*own, np.zeros(0, np.uint64)]), return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.concat_arrays([pa.array(terms.view(np.int64), pa.int64()), pa.nulls(1, pa.int64())]),
                        pa.array([*counts.tolist(), int((np.diff(rows) > 0).sum())], pa.int64()),
                        pa.array([*[0] * len(counts), len(hashes)], pa.int64()),
                    ],
                    names=["term", "items", "words"],
                )

    counted = items.select("text").mapInArrow(count, "term long, items long, words long")
    return counted.groupBy("term").agg(F.sum("items").alias("items"), F.sum("words").alias("words"))


def _statistics(counts: DataFrame, items: list[tuple[int, str]]) -> Statistics:
    """The statistics over all items for the terms of these."""
    every = counts.where("term is null").first()
    terms = np.unique(np.concatenate([_hashes_of(text) for _, text in items]))
    own = counts.sparkSession.createDataFrame(pa.table({"term": pa.array(terms.view(np.int64))}))
    found = counts.join(own, "term").select("term", "items").toArrow()
    known = found["term"].to_numpy().astype(np.int64).view(np.uint64)
    order = np.argsort(known)
    return Statistics(every["items"], every["words"] / max(1, every["items"]), known[order], found["items"].to_numpy()[order])


def _passes(items: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """The items ``(id, text)`` in lists of a bounded size, each to be broadcast by itself.

    Texts without an id get -1, -2 and so on in their order, below all ids that there are.
    """
    surrogate = min(0, items.agg(F.min("id")).first()[0] or 0)
    held, size, last = [], 0, None
    for row in items.orderBy("id", "text").toLocalIterator():
        if row["id"] is None and row["text"] != last:
            surrogate, last = surrogate - 1, row["text"]
        own = POSTING_BYTES * (1 + len(row["text"].split()))
        if held and size + own > INDEX_BYTES:
            yield held
            held, size = [], 0
        held.append((surrogate if row["id"] is None else row["id"], row["text"]))
        size += own
    if held:
        yield held


def contaminated(
    docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text"
) -> DataFrame:
    """``(key, item, score, question_overlap, answer_overlap)``: one row per text and test item found in it, at its best.

    Null and empty texts and items match nothing. Rows that repeat a key count as one document. Items that repeat an id are
    told apart by their text and reported once under that id; items
    without one are reported under -1, -2 and so on, by text, below all ids. Other columns are not read. Without items the result is empty.
    """
    docs = bounded_batches(docs)
    spark = docs.sparkSession
    kind = docs.schema[key].dataType.simpleString()
    schema = f"key {kind}, item long, score double, question_overlap double, answer_overlap double"
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    found = spark.createDataFrame([], schema)
    tests = benchmark.where(F.col(item_text).isNotNull()).select(F.col(item).cast("long").alias("id"), F.col(item_text).alias("text"))
    counts = stage(_counts(tests), "item-terms")
    for items in _passes(tests):
        shared = spark.sparkContext.broadcast(build_indexes(items, _statistics(counts, items)))

        def scan(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out = []
                for first, data, offsets in text_chunks(batch.column(1)):
                    hashes, bounds = plain_words(data, offsets)
                    for index in shared.value:
                        out.extend((first + row, int(index.items[i]), *rest) for row, i, *rest in matches(index, hashes, bounds))
                take = pa.array([x[0] for x in out], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(take), pa.array([x[1] for x in out], pa.int64()), *(pa.array([x[k] for x in out], pa.float64()) for k in (2, 3, 4))],
                    names=["key", "item", "score", "question_overlap", "answer_overlap"],
                )

        found = found.unionByName(rows.mapInArrow(scan, schema))
    best = [F.max(c).alias(c) for c in ("score", "question_overlap", "answer_overlap")]
    return found.groupBy(F.col("key").alias(key), F.col("item").alias(item)).agg(*best)
