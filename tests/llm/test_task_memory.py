"""What a running task holds while it scores texts."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa

from mediacast.llm import language


def test_language_tables_and_chunks_are_small():
    rng = random.Random(2)
    words = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyzé", k=rng.randint(1, 9))) for _ in range(2000)]
    trees = language.train({x: [" ".join(rng.choices(words[i::3], k=2000)).encode()] for i, x in enumerate("abc")})
    texts = pa.array([" ".join(rng.choices(words, k=1000)) for _ in range(500)])  # about 3 MB
    tracemalloc.start()
    place = language.gram_places(trees)
    whole = language.code_lengths(trees, texts, place)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40 << 20  # 64 MB of row numbers alone, before
    alone = [language.code_lengths(trees, texts.slice(i, 1), place)[0] for i in range(0, 500, 50)]
    assert np.array_equal(whole[::50], alone)
