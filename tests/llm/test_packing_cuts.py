"""Cuts that the packing keeps."""

import random

import numpy as np
from tokenizers import Tokenizer

import public_tokenizers
from mediacast.llm import packing


def test_closing_marks_and_line_breaks_are_not_kept_with_their_words():
    rng = random.Random(7)
    words = sorted({"".join(rng.choices("abcdefghé", k=6)) for _ in range(500)})
    texts = [f"{before}{word}{mark} {word}" for word in words for before in ("", "A ", "A\n") for mark in (",", ".", "!?", "")]
    texts += ["1990, 12) a_. x", "it's. 's, ×. ß. ª! 中文, é. ǅ; a.\n\nb, c.", "\t, a.\n\tb.", "a\n.b,\n,", ", .", "a, ", "a, b."]
    ids = packing.TextIds(packing.VOCABULARY)
    library = Tokenizer.from_file(public_tokenizers.path(packing.VOCABULARY))
    assert ids.ids(texts) == [np.array(library.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert len(ids.spaced) < 2.2 * len(words)  # a word behind a space and one without; with each mark and line break, before
