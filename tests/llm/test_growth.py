"""Candidate pairs and the prefixes they come from, which grow faster than the texts."""

import random

import numpy as np

from mediacast.llm import ngram_join


def test_prefixes_meet_once_in_parts_of_the_shingles(spark):
    rng = random.Random(6)
    nodes = [(i, 20, i % 5, 15, [rng.randrange(-60, 60) for _ in range(20)]) for i in range(40)]
    nodes = spark.createDataFrame([(i, n, r, h, [*dict.fromkeys(p)]) for i, n, r, h, p in nodes], "node long, n long, rare int, hot int, prefix array<long>")
    whole = sorted(map(str, ngram_join.shared_prefixes(nodes).collect()))
    parts = [sorted(map(str, ngram_join.shared_prefixes(nodes, part, 4).collect())) for part in range(4)]
    assert sorted(sum(parts, [])) == whole and all(0 < len(p) < len(whole) / 2 for p in parts)


def test_parities_bound_the_overlap(spark):
    rng, nodes, sets = np.random.default_rng(4), [], {}
    for family in range(12):
        base = rng.integers(0, 2**63, rng.integers(1, 400), dtype=np.uint64)
        for share in (1.0, 0.97, 0.9, 0.85, 0.8, 0.0):
            own = np.unique(np.where(rng.random(len(base)) < share, base, rng.integers(0, 2**63, len(base), dtype=np.uint64)))
            sets[len(nodes)] = own
            nodes.append((len(nodes), ngram_join._parities(own).tolist()))
    pairs = [(a, b, len(sets[a]), len(sets[b])) for a in sets for b in sets if a < b and 5 * min(len(sets[a]), len(sets[b])) >= 4 * max(len(sets[a]), len(sets[b]))]
    found = ngram_join.bounded(spark.createDataFrame(pairs, "a long, b long, an long, bn long"), spark.createDataFrame(nodes, "node long, parities array<long>")).collect()
    assert len(found) == len(pairs)
    assert any(len(nodes[r.a][1]) != len(nodes[r.b][1]) for r in found)
    for r in found:
        assert len(np.intersect1d(sets[r.a], sets[r.b])) <= r.most <= min(r.an, r.bn) + 32
    unrelated = [r for r in found if min(r.an, r.bn) >= 100 and not len(np.intersect1d(sets[r.a], sets[r.b]))]
    assert unrelated and not any(r.most * 100 >= (r.an + r.bn - r.most) * 80 for r in unrelated)


def test_texts_that_share_a_phrase_are_not_counted(spark, monkeypatch):
    rng = random.Random(8)
    words = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    phrases = [words(8) for _ in range(30)]
    texts = [" ".join(sum(rng.sample(phrases, 15), words(40))) for _ in range(30)]
    copy = texts[0].split()
    texts.append(" ".join([*copy[:-1], "other"]))
    counted = []
    overlaps = ngram_join.overlaps
    monkeypatch.setattr(ngram_join, "overlaps", lambda docs, key, text, pairs, *rest: counted.append(pairs.select("a", "b").distinct().count()) or overlaps(docs, key, text, pairs, *rest))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: r.component_id for r in ngram_join.near_duplicates(docs).collect()}
    assert found == {i: 0 if i == 30 else i for i in range(31)}
    assert sum(counted) < 10  # every pair that shares a phrase, before
