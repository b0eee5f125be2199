"""Best-fit packing of token pieces into sequences, planned on the histogram of their lengths.

The plan needs only how many pieces there are of each length. Lengths are taken from the longest down; every piece goes to
the fullest sequence it fits in. Sequences with the same content are one group with a multiplicity, so a step moves whole
groups: the plan's size follows the number of lengths, not of documents. The pieces then take the planned slots: pieces of one length
are ranked, in buckets of bounded size, and joined with the rank ranges of the plan.

Texts are cut before single spaces and line breaks and at other places where the byte-level pre-tokeniser always cuts as well, and every
distinct cut is encoded once for a while; the ids of a text are those of its cuts in a row.
"""

from __future__ import annotations

import bisect
import re
import zlib
from collections import ChainMap
from collections.abc import Iterable, Iterator, Mapping
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mediacast.llm.token_counts import encoder
from mediacast.session import stage

VOCABULARY = "byte_bpe_50k.json"
END = 2
LENGTH = 1024
#: Pieces of one length that are ranked in one bucket, on average.
BUCKET_ROWS = 1 << 11

_KEPT_BYTES = 192 << 20
_KEPT_CUT = 64
_ENCODE = 20_000
_JOINED = 200
# no apostrophe, which may start a token of letters, and no mark of a special token
_CLOSING = ".,;:!?$%&#*)]}\""
# closing marks at the end of a cut, behind a letter or digit
_ENDS = re.compile(r"[.,;:!?$%&#*)\]}\"](?<=[0-9A-Za-zÀ-ÖØ-öø-ɏ].)[.,;:!?$%&#*)\]}\"]*(?![^ ])")
# a space before something that is no white space starts a token of its own, whatever stands before it
_SPACE = re.compile(r" (?=\S)")
_DOUBTFUL = re.compile(r" (?!\S)")
# inside long cuts: before white space, and between an ASCII letter and a digit
_INSIDE = re.compile(r"(?<=\S)(?=\s)|(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])")
_LONG = 1 << 12
# what follows a space that is cut is no white space, so this tells the cuts without a space before them
_BARE = "\t"


class TextIds:
    """Ids of whole texts as little-endian 32-bit numbers, from the ids of their cuts.

    Memory is bounded by what is kept: at half the bound all cuts grow old, and old ones that are not met again by the next time are forgotten.
    """

    def __init__(self, vocabulary: str) -> None:
        self.encoder = encoder(vocabulary)
        self.spaced: dict[str, bytes] = {}  # what follows a space, which counts to it; other cuts behind ``_BARE``
        self.old: list[dict[str, bytes]] = [{}]  # one generation
        self.held = 0
        size = self.encoder.get_vocab_size(with_added_tokens=True) + 1
        self.starts_word, self.breaks_line = np.zeros(size, bool), np.zeros(size, bool)
        self.starts_word[[i for token, i in self.encoder.get_vocab().items() if token.startswith("Ġ")]] = True
        self.breaks_line[self.encoder.encode("\n", add_special_tokens=False).ids] = True

    def ids(self, texts: list[str]) -> list[bytes]:
        if self.held > _KEPT_BYTES // 2:
            self.old, self.spaced, self.held = [self.spaced], {}, 0
        cut = [[_BARE + first, *rest] if first else rest for first, rest in (_cuts(text, ends=True) for text in texts)]
        found = [list(map(self.spaced.get, own)) for own in cut]
        missing = [[i for i, x in enumerate(own) if x is None] if None in own else () for own in found]
        ids = self._learned({own[i] for own, at in zip(cut, missing) for i in at})
        for own, ready, at in zip(cut, found, missing):
            for i in at:
                ready[i] = ids[own[i]]
        return [b"".join(ready) for ready in found]

    def _learned(self, new: set[str]) -> Mapping[str, bytes]:
        """Keep the ids of these cuts but of those too long to keep, and return all that is known now."""
        passing: dict[str, bytes] = {}
        new = self._remembered(new)
        words = {c for c in new if c.isalpha()}
        parts = {c: _parts(c) for c in new.difference(words)}
        words.update(self._remembered({x for own in parts.values() for x in own}))
        self._keep(passing, self._encoded(words))
        ids = ChainMap(passing, self.spaced) if passing else self.spaced
        composed = {c: b"".join([ids[x] for x in own]) for c, own in parts.items() if len(own) > 1}
        self._keep(passing, [(list(composed), list(composed.values()))])
        return ChainMap(passing, self.spaced) if passing else self.spaced

    def _remembered(self, wanted: set[str]) -> set[str]:
        """Those of the wanted cuts that are neither kept nor old; the old ones are kept from now on."""
        wanted = wanted.difference(self.spaced)  # this looks up the smaller side, an update would go over all that is kept
        old = self.old[0]
        again = [c for c in wanted if c in old] if old else []
        self._keep({}, [(again, [old[c] for c in again])])
        return wanted.difference(again)

    def _keep(self, passing: dict[str, bytes], found: Iterable[tuple[list[str], list[bytes]]]) -> None:
        for pieces, ids in found:
            if pieces and max(map(len, pieces)) > _KEPT_CUT:
                passing.update((p, own) for p, own in zip(pieces, ids) if len(p) > _KEPT_CUT)
                pieces, ids = zip(*[(p, own) for p, own in zip(pieces, ids) if len(p) <= _KEPT_CUT] or [("", b"")])
            self.spaced.update(zip(pieces, ids))
            self.held += sum(map(len, pieces)) + sum(map(len, ids)) + 160 * len(pieces)

    def _encoded(self, cuts: set[str]) -> Iterator[tuple[list[str], list[bytes]]]:
        """Cuts with their ids. Words of letters are encoded many to a text and told apart by the tokens that begin with the space or
        line break before each of them."""
        spaced, bare = [c for c in cuts if c.isalpha()], [c for c in cuts if c[0] == _BARE and c[1:].isalpha()]
        alone = list(cuts.difference(spaced, bare))
        for words, before, firsts in ((spaced, " ", self.starts_word), ([c[1:] for c in bare], "\n", self.breaks_line)):
            mark, own = ("", 0) if before == " " else (_BARE, 1)  # a space belongs to the first token of its word
            groups = [words[i : i + _JOINED] for i in range(0, len(words), _JOINED)]
            for some in (groups[i : i + 64] for i in range(0, len(groups), 64)):
                for group, result in zip(some, self.encoder.encode_batch_fast([before + before.join(g) for g in some], add_special_tokens=False)):
                    ids = np.array(result.ids, "<u4")
                    starts = np.flatnonzero(firsts[ids])
                    keys = [mark + w for w in group] if mark else group
                    if len(starts) == len(group) and starts[0] == 0:  # every word has such a token, so each has exactly one
                        data, bounds = ids.tobytes(), [*(4 * starts).tolist(), 4 * len(ids)]
                        yield keys, [data[i + 4 * own : j] for i, j in pairwise(bounds)]
                    else:
                        alone.extend(keys)
        for start in range(0, len(alone), _ENCODE):
            some = alone[start : start + _ENCODE]
            texts = [c[1:] if c[0] == _BARE else " " + c for c in some]
            yield some, [np.array(r.ids, "<u4").tobytes() for r in self.encoder.encode_batch_fast(texts, add_special_tokens=False)]


#: One per vocabulary and worker, so that the tasks of a worker share what it knows.
_known: dict[str, TextIds] = {}


def _cuts(text: str, ends: bool = False) -> tuple[str, list[str]]:
    """What stands before the first cut, and what follows the space of every cut, or begins with its line break.

    With ``ends``, closing marks at the end of a cut and these line breaks are cuts of their own, behind ``_BARE``.
    """
    if not text:
        return "", []
    if text[-1] == " " or _DOUBTFUL.search(text):
        first, *rest = _SPACE.split(text)
    else:
        text = _broken(text)
        if ends:
            text = _ENDS.sub(rf" {_BARE}\g<0>", text).replace(" \n", f" {_BARE}\n {_BARE}")
        first, *rest = text.split(" ")
    return first, rest


def _broken(text: str) -> str:
    """The text with a space before its line breaks, if all of them are between two characters that are no white space.

    No other cut begins with a line break, as what follows a space that is cut is no white space.
    """
    lines = text.split("\n")
    if len(lines) == 1 or any(not x or x[0].isspace() or x[-1].isspace() for x in lines):
        return text
    return " \n".join(lines)


def _parts(cut: str) -> tuple[str, ...]:
    """The cuts that a cut is made of, only the first of which may count a space."""
    bare = cut[0] == _BARE
    first, *rest = _atoms(cut[bare:])
    return (_BARE + first if bare else first, *[_BARE + x for x in rest])


def _atoms(cut: str) -> tuple[str, ...]:
    """The cut at a single line break, and before closing marks behind a letter; tokens never reach over these places.

    Long cuts are taken apart at white space and between letters and digits as well.
    """
    if len(cut) > _LONG:
        return tuple(part for part in _INSIDE.split(cut) if part)
    before, line, after = cut.partition("\n")
    if line:
        whole = before and after and not before[-1].isspace() and not after[0].isspace()
        return (*_atoms(before), line, *_atoms(after)) if whole else (cut,)
    core = cut.rstrip(_CLOSING)
    if core and core != cut and core[-1].isalpha() and core[-1] < "\u0250":
        return core, cut[len(core) :]
    return (cut,)


def piece_bounds(count: int, length: int = LENGTH) -> list[tuple[int, int]]:
    """``(start, length)`` of the pieces of a document of ``count`` ids: whole, or a shorter first piece and full ones."""
    if count <= length:
        return [(0, count)]
    first = count % length or length
    return [(0, first), *[(start, length) for start in range(first, count, length)]]


def token_pieces(
    docs: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY, end: int = END, length: int = LENGTH, with_ids: bool = False
) -> DataFrame:
    """``(id, piece, start, length, ids_crc32)``, and ``ids`` if wanted, of all documents; each is at least its end mark."""
    fields = f"id {docs.schema[key].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if vocabulary not in _known:
            _known[vocabulary] = TextIds(vocabulary)
        texts, closing = _known[vocabulary], np.array([end], "<u4").tobytes()
        for batch in batches:
            places, rows = [], []
            for first, some in _by_length(batch.column(1)):
                for i, own in enumerate(texts.ids(some), first):
                    own += closing
                    for number, (start, size) in enumerate(piece_bounds(len(own) // 4, length)):
                        ids = own[4 * start : 4 * (start + size)]
                        places.append(i)
                        rows.append((number, start, size, zlib.crc32(ids), np.frombuffer(ids, "<i4") if with_ids else None))
            columns = list(zip(*rows)) or [()] * 5
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), *[pa.list_(pa.int32())] * with_ids]
            arrays = [batch.column(0).take(pa.array(places, pa.int64())), *[pa.array(c, t) for c, t in zip(columns, kinds)]]
            yield pa.RecordBatch.from_arrays(arrays, names=["id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids])

    return docs.select(F.col(key).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text")).mapInArrow(pieces, fields)


def _by_length(texts: pa.Array, limit: int = 1 << 19) -> Iterator[tuple[int, list[str]]]:
    """Consecutive texts, about ``limit`` characters at a time; a longer one stands alone."""
    first, batch, held = 0, [], 0
    for i, value in enumerate(texts):
        own = value.as_py()
        if batch and held + len(own) > limit:
            yield first, batch
            first, batch, held = i, [], 0
        batch.append(own)
        held += len(own)
    if batch:
        yield first, batch


@dataclass
class _Group:
    """Sequences of the same content: ``(length, pieces each)`` in order of place."""

    count: int
    content: tuple[tuple[int, int], ...]
    room: int


def plan(histogram: Mapping[int, int], length: int = LENGTH) -> list[tuple[int, int, int, int, int, int]]:
    """Slots ``(piece length, first rank, ranks, pieces a sequence, first sequence, offset)``, best fit over counts.

    The number of groups grows with the number of lengths: a step uses up a group or ends a length.
    """
    by_room: dict[int, list[_Group]] = {}
    rooms: list[int] = []  # sorted, those with groups

    def add(count: int, content: tuple[tuple[int, int], ...], room: int) -> None:
        if count:
            if room not in by_room:
                by_room[room] = []
                bisect.insort(rooms, room)
            by_room[room].append(_Group(count, content, room))

    for size in sorted(histogram, reverse=True):
        left = histogram[size]
        while left:
            at = bisect.bisect_left(rooms, size)
            if at == len(rooms):
                each = min(length // size, left)
                full, over = divmod(left, each)
                add(full, ((size, each),), length - each * size)
                add(1 if over else 0, ((size, over),), length - over * size)
                break
            room = rooms[at]
            groups = by_room[room]
            group = groups.pop()
            if not groups:
                del by_room[room]
                rooms.pop(at)
            each = room // size
            full = min(group.count, left // each)
            over = left - full * each if full < group.count else 0
            add(full, (*group.content, (size, each)), room - each * size)
            add(1 if over else 0, (*group.content, (size, over)), room - over * size)
            add(group.count - full - (1 if over else 0), group.content, room)
            left -= full * each + over
    slots, ranks, sequence = [], dict.fromkeys(histogram, 0), 0
    for group in sorted((g for groups in by_room.values() for g in groups), key=lambda g: (g.content, g.count)):
        offset = 0
        for size, each in group.content:
            slots.append((size, ranks[size], group.count * each, each, sequence, offset))
            ranks[size] += group.count * each
            offset += size * each
        sequence += group.count
    return slots


def packed_pieces(pieces: DataFrame, length: int = LENGTH) -> DataFrame:
    """``pieces``, a table with a ``length`` of 1 to ``length``, with ``sequence_id`` and ``offset``.

    The driver sees one count per length. Ranks within a length come from windows over buckets of about ``BUCKET_ROWS`` rows of
    a length, dealt by a number that every row gets when it is written, so that no length and no key is one task.
    """
    spark = pieces.sparkSession
    rows = stage(pieces.withColumn("row", F.monotonically_increasing_id()), "pieces")
    histogram = {r["length"]: r["count"] for r in rows.groupBy("length").count().collect()}
    # one row per length
    buckets = spark.createDataFrame([(size, max(1, count // BUCKET_ROWS)) for size, count in histogram.items()], "length long, buckets long")
    dealt = rows.join(F.broadcast(buckets), "length").withColumn("bucket", F.pmod(F.xxhash64("row"), F.col("buckets"))).drop("buckets")
    earlier = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = dealt.groupBy("length", "bucket").count().select("length", "bucket", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("before"))
    inside = Window.partitionBy("length", "bucket").orderBy("row")
    ranked = dealt.withColumn("inside", F.row_number().over(inside) - 1).join(before, ["length", "bucket"]).withColumn("rank", F.col("before") + F.col("inside"))
    slots = spark.createDataFrame(plan(histogram, length), "size long, first long, ranks long, each long, sequence long, place long")
    fits = (F.col("length") == F.col("size")) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("first") + F.col("ranks"))
    number = F.col("rank") - F.col("first")
    # the plan is bounded by the number of lengths
    return ranked.join(F.broadcast(slots), fits).select(
        *pieces.columns,
        (F.col("sequence") + F.expr("(rank - first) div each")).alias("sequence_id"),
        (F.col("place") + F.pmod(number, F.col("each")) * F.col("length")).alias("offset"),
    )


def packed(docs: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY, end: int = END, length: int = LENGTH, with_ids: bool = False) -> DataFrame:
    """``(key, piece, start, length, ids_crc32, sequence_id, offset)``, and ``ids`` if wanted, of every piece.

    A document is its ids and the end mark; null and empty texts are the end mark alone. Documents above ``length`` are cut
    into pieces of that length behind a first piece of what is left over; others stay whole. Repeated rows and keys are documents
    of their own; keys may be null; other columns are not read. An empty table gives no rows.
    """
    return packed_pieces(token_pieces(docs, key, text, vocabulary, end, length, with_ids), length).withColumnRenamed("id", key)


def sequences(pieces: DataFrame) -> DataFrame:
    """``(sequence_id, ids)``: the sequences themselves, from packed pieces with ids. A group is one sequence."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return pieces.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda p: p["ids"])).alias("ids"))
