"""Packing, filter audit and whitening against the tokenizer library, item-by-item best fit, plain Python and NumPy."""

from __future__ import annotations

import bisect
import itertools
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from mediacast.llm import filter_audit, packing, whitening

FOLDER = "/root/testdata/sf0.01"
CLASHES = ("key", "id", "n", "row", "bucket", "length", "mask", "digest", "docs", "step", "letter", "component", "label", "x", "place")


def clashing(df):
    return df.withColumns({c: F.lit("x") for c in CLASHES})


def library_ids(texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return [library.encode(t or "", add_special_tokens=False).ids for t in texts]


def item_by_item(lengths, length):
    """Sequences that best fit decreasing opens when it places one item after the other."""
    rooms, opened = [], 0
    for size in sorted(lengths, reverse=True):
        at = bisect.bisect_left(rooms, size)
        room = rooms.pop(at) if at < len(rooms) else length
        opened += room == length
        if room > size:
            bisect.insort(rooms, room - size)
    return opened


def check_packing(rows, lengths_by_key, length):
    """Pieces as the contract cuts them, and sequences without gaps; the number of sequences."""
    by_document, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_document[r.doc_id].append((r.piece, r.start, r.length))
        by_sequence[r.sequence_id].append((r.offset, r.length))
    expected = defaultdict(list)
    for key, counts in lengths_by_key.items():
        for count in counts:
            first = count if count <= length else count % length or length
            bounds = [(0, first), *((s, length) for s in range(first, count, length))]
            expected[key] += [(i, s, n) for i, (s, n) in enumerate(bounds)]
    assert {k: sorted(v) for k, v in by_document.items()} == {k: sorted(v) for k, v in expected.items()}
    for parts in by_sequence.values():
        at = 0
        for offset, size in sorted(parts):
            assert offset == at
            at += size
        assert at <= length
    return len(by_sequence)


def test_plan_is_best_fit_over_counts():
    rng = random.Random(5)
    for _ in range(60):
        length = rng.choice([10, 37, 100, 1024])
        lengths = [rng.randint(1, length if rng.random() < 0.6 else max(1, length // 6)) for _ in range(rng.randint(0, 1500))]
        slots, ranks, held = packing.plan(Counter(lengths), length), Counter(), defaultdict(int)
        for size, first, count, each, sequence, _ in slots:
            assert first == ranks[size]
            ranks[size] += count
            for i in range(count):
                held[sequence + i // each] += size
        assert ranks == Counter(lengths) and max(held.values(), default=0) <= length
        assert len(held) == item_by_item(lengths, length)
    many = packing.plan({size: 10**9 + size for size in range(1, 1025)})
    assert len(many) < 4 * 1024


def test_ids_of_cuts_are_ids_of_texts(monkeypatch):
    rng = random.Random(3)
    parts = [" ", "  ", "\n", " \n", "\t", "a", "Bc", "1", "23", "'s", "'t", "é", "中文", "<|endoftext|>", "<|endof", "|>", ".", "!!", "\x1c", "\x85", "\r\n",
             "\U0001f600", "-", "_", "x" * 50, "٣", "​", "﻿", "é", ",", ".)", "w%$"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(5000)]
    expected = [np.array(ids, "<u4").tobytes() for ids in library_ids(texts)]
    ids = packing.TextIds(packing.VOCABULARY)
    assert ids.ids(texts) == expected
    monkeypatch.setattr(packing, "_LONG", 8)
    monkeypatch.setattr(packing, "_KEPT_BYTES", 1000)
    assert ids.ids(texts) == ids.ids(texts) == expected


def test_line_breaks_begin_cuts():
    assert packing._cuts("one two.\nThree four") == ("one", ["two.", "\nThree", "four"])
    assert packing._cuts("one\n two") == ("one\n", ["two"])
    rng = random.Random(4)
    parts = [" ", "\n", "a", "Bc", "1", "'s", "é", "中文", "<|endoftext|>", ".", "!!", "\x1c", "\x85", "\u2028", "-", ",", "x" * 50]
    texts = ["".join(rng.choice(parts) + rng.choice(("a", ".", "'t", "9", "Ü")) for _ in range(rng.randint(1, 12))) for _ in range(3000)]
    assert sum(t != packing._broken(t) for t in texts) > 500
    ids = packing.TextIds(packing.VOCABULARY)
    assert ids.ids(texts) == [np.array(own, "<u4").tobytes() for own in library_ids(texts)]


def test_cuts_that_are_met_again_are_encoded_once(monkeypatch):
    monkeypatch.setattr(packing, "_KEPT_BYTES", 40_000)
    ids, rng, seen = packing.TextIds(packing.VOCABULARY), random.Random(6), Counter()

    class Counting:
        def __init__(self, own):
            self.own = own

        def encode_batch_fast(self, texts, **options):
            seen.update(word for text in texts for word in text.split())
            return self.own.encode_batch_fast(texts, **options)

    ids.encoder, most = Counting(ids.encoder), 0
    for _ in range(40):
        texts = ["often " + " ".join("".join(rng.choices("abcdefgh", k=8)) for _ in range(30)) + " usual words"]
        assert ids.ids(texts) == [np.array(own, "<u4").tobytes() for own in library_ids(texts)]
        most = max(most, len(ids.spaced) + len(ids.old[0]))
    assert sum(seen.values()) > 1000 and most < 400
    assert seen["usual"] == seen["words"] == 1


def test_packing_of_edge_cases(spark):
    texts = [None, "", " ", "one two", "one two", "a" * 3000, "word " * 1023, "word " * 1022 + "word", "1a" * 40_000, "x y " * 2048, "\n\n", "<|endoftext|>"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, "again"), (None, "no key"), (None, "no key")]
    docs = clashing(spark.createDataFrame(rows, "doc_id long, text string"))
    found = packing.packed(docs, with_ids=True).cache()
    ids = library_ids([t for _, t in rows])
    lengths = defaultdict(list)
    for (key, _), own in zip(rows, ids):
        lengths[key].append(len(own) + 1)
    collected = found.collect()
    opened = check_packing(collected, lengths, 1024)
    assert opened == item_by_item([r.length for r in collected], 1024)
    whole = {}
    for r in sorted(collected, key=lambda r: (r.doc_id is None, r.doc_id, r.piece)):
        assert zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32
        whole.setdefault(r.doc_id, []).extend(r.ids)
    for key in (0, 1, 5, 6, 7, 8, 9, 11):
        assert whole[key] == ids[key] + [2]
    packed = {r.sequence_id: r.ids for r in packing.sequences(found).collect()}
    for r in collected:
        assert packed[r.sequence_id][r.offset : r.offset + r.length] == r.ids
    empty = packing.packed(docs.limit(0))
    assert empty.count() == 0 and "sequence_id" in empty.columns


def test_packing_of_sample_table(spark, monkeypatch):
    monkeypatch.setattr(packing, "BUCKET_ROWS", 7)  # several buckets a length
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    rows = packing.packed(docs).collect()
    ids = {r.doc_id: own + [2] for r, own in zip(docs.collect(), library_ids([r.text for r in docs.collect()]))}
    opened = check_packing(rows, {k: [len(v)] for k, v in ids.items()}, 1024)
    assert opened == item_by_item([r.length for r in rows], 1024)
    for r in rows:
        assert r.ids_crc32 == zlib.crc32(np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4").tobytes())


def brute_audit(docs, labels):
    texts = [(k, t or "", p or "") for k, t, p in docs]
    fails = []
    for key, text, part in texts:
        words = text.encode().split()
        mark = [
            len(words) < 50,
            100 * len(set(words)) < 65 * len(words),
            100 * sum("A" <= c <= "Z" for c in text) > 5 * len(text),
            any(c in "#$%&*|" for c in text),
            key is not None and any(k is not None and k < key and t == text for k, t, _ in texts),
        ]
        good = any(k == key and q == 1 for k, q, _ in labels if key is not None)
        toxic = any(k == key and x == 1 for k, _, x in labels if key is not None)
        fails.append((part, dict(zip("ABCDE", mark)), good, toxic))
    rows, shapley = {}, Counter()
    for part in {p for _, _, p in texts}:
        own = [f for f in fails if f[0] == part]
        for order in map("".join, itertools.permutations("ABCDE")):
            left = own
            for step, letter in enumerate(order, 1):
                out = [f for f in left if f[1][letter]]
                left = [f for f in left if not f[1][letter]]
                failing = sum(f[1][letter] for f in own)
                only = sum(f[1][letter] and sum(f[1].values()) == 1 for f in own)
                rows[part, order, step] = (len(left), len(out), failing - len(out), only, sum(f[2] for f in out), sum(f[3] for f in out))
                shapley[part, letter] += len(out)
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in rows.items()}


def audited(rows):
    return {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in rows}


def test_filter_audit_of_edge_cases(spark):
    fine = " ".join(f"w{i}" for i in range(60))
    rows = [
        (1, None, "a"), (2, "", "a"), (3, "", None), (None, "", ""), (None, fine, "b"), (4, fine, "b"), (4, fine, "b"), (5, fine, "a"), (6, fine.upper(), "a"),
        (7, "same " * 80, "b"), (8, "é " * 30 + "$", "b"), (9, "Ab", None), (9, "other Ab", None), (10, "x" * 300_000, "b"), (11, "a\x1cb " * 70, "c"), (12, fine + " |", "c"),
    ]
    labels = [(1, 1, 0), (5, 0, 1), (5, 1, None), (7, None, 1), (None, 1, 1), (9, 1, 1), (99, 1, 1)]
    docs = clashing(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    marks = clashing(spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    found = filter_audit.audit(docs, marks).collect()
    assert len(found) == 4 * 600 and audited(found) == brute_audit(rows, labels)
    assert filter_audit.audit(docs.limit(0), marks).count() == 0
    assert all(r.good_lost == 0 for r in filter_audit.audit(docs, marks.limit(0)).collect())


def test_filter_audit_of_sample_table(spark):
    docs, labels = (spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("documents", "labels"))
    found = audited(filter_audit.audit(docs, labels).collect())
    assert found == brute_audit(docs.select("doc_id", "text", "source").collect(), labels.select("doc_id", "quality", "toxic").collect())


@pytest.mark.parametrize("width, spread", [(64, "flat"), (300, "falling"), (300, "flat"), (10, "falling"), (1, "flat"), (64, "rank5"), (40, "equal")])
def test_leading_pairs(width, spread):
    rng = np.random.default_rng(1)
    rows = rng.normal(size=(2000, width))
    if spread == "falling":
        rows *= np.exp(-np.arange(width) / 8)
    if spread == "rank5":
        rows = rng.normal(size=(2000, 5)) @ rng.normal(size=(5, width))
    rows -= rows.mean(axis=0)
    matrix = np.eye(width) * 3 if spread == "equal" else rows.T @ rows / len(rows)
    values, vectors = whitening.leading_pairs(lambda block: matrix @ block, width, 16, float(np.trace(matrix)))
    assert len(values) == (5 if spread == "rank5" else min(16, width))
    assert np.allclose(values, np.linalg.eigvalsh(matrix)[::-1][: len(values)], rtol=1e-12)
    assert np.linalg.norm(matrix @ vectors - vectors * values, axis=0).max() < 1e-13 * values[0] * np.sqrt(width)
    assert np.abs(vectors.T @ vectors - np.eye(len(values))).max() < 1e-13


def check_whitening(rows, vectors):
    """Rows against a covariance formed in NumPy from exact integers."""
    integers = {k: np.floor(np.array(v, np.float64) * 64).astype(np.int64) + 1_000_000 for k, v in vectors}
    fit = np.unique(np.array(list(integers.values())), axis=0)
    n, sums = len(fit), fit.sum(axis=0)
    centred = (n * fit - sums) / n
    covariance = centred.T @ centred / n
    values, turn = np.linalg.eigh(covariance)
    values, turn = values[::-1], turn[:, ::-1]
    by_key = defaultdict(dict)
    for r in rows:
        by_key[r.vec_id][r.component] = r
    assert set(by_key) == set(integers)
    count = min(16, len(sums))
    for key, x in integers.items():
        own = by_key[key]
        assert sorted(own) == list(range(1, count + 1))
        deviation = sum(int(d) ** 2 for d in (n * x - sums).tolist())
        for c, r in own.items():
            assert (r.n, r.deviation) == (n, deviation)
            assert abs(r.explained / (values[c - 1] / covariance.trace()) - 1) < 1e-10 and r.identity_error < 1e-10
            assert abs(abs(r.whitened) - abs(((n * x - sums) / n) @ turn[:, c - 1]) / np.sqrt(values[c - 1])) < 1e-6


def test_whitening(spark):
    rng = np.random.default_rng(4)
    vectors = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(300, 20)) * np.exp(-np.arange(20) / 9))]
    vectors += [(1000 + i, vectors[i % 3][1]) for i in range(50)]  # copies count once
    odd = [(2000, None), (2001, [float("nan")] * 20), (2002, [1.0] * 19 + [None]), (2003, [float("inf")] + [0.0] * 19), (2004, []), (2005, [1.0, 2.0])]
    df = clashing(spark.createDataFrame(vectors + odd, "vec_id long, embedding array<float>"))
    rounded = [(k, np.array(v, np.float32)) for k, v in vectors]
    check_whitening(whitening.whitened(df).collect(), rounded)
    repeated = spark.createDataFrame([(7, v) for _, v in vectors[:30]] + [(None, vectors[0][1])], "vec_id long, embedding array<float>")
    assert whitening.whitened(repeated).count() == 31 * 16
    for rows in ([], [(1, None)], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])]):
        assert whitening.whitened(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).count() == 0
    two = whitening.whitened(spark.createDataFrame([(1, [0.0, 1.0]), (2, [1.0, 1.0])], "vec_id long, embedding array<float>")).collect()
    assert [(r.component, r.n, r.deviation, abs(round(r.whitened, 9)), r.explained) for r in two] == [(1, 2, 64 * 64, 1.0, 1.0)] * 2


def test_whitening_of_sample_table(spark):
    df = spark.read.parquet(f"{FOLDER}/embeddings.parquet")
    check_whitening(whitening.whitened(df).collect(), [(r.vec_id, np.array(r.embedding, np.float32)) for r in df.collect()])


def test_exact_numbers_of_whitening():
    centre = whitening.Centre(1 << 40, np.array([1 << 50, -(1 << 50)]))
    x = np.array([[1_000_000 + (1 << 30), 1_000_000]])
    assert centre.deviations(x).tolist() == [[(1 << 70) - (1 << 50), 1 << 50]]
    assert whitening._exact_squares(np.array([[1 << 31, 3]])) == [(1 << 62) + 9]
    assert whitening._exact_squares(np.array([[1 << 40, 3]])) == [(1 << 80) + 9]
