"""Token counts: batch encoding inside Arrow functions that returns lengths only.

Texts are cut at ASCII white space. The normaliser of the vocabulary drops white space, its pre-tokeniser never
joins what white space separates, no canonical composition reaches over a space and no special token holds one,
so the count of a text is the sum of the counts of its pieces. Pieces repeat far more often than texts do: each
distinct piece of a batch is encoded once and its length kept for the following batches of the task.
"""

from __future__ import annotations

import os
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BATCH_BYTES = 4 << 20
ENCODE_PIECES = 50_000
KEPT_PIECES = 1_000_000
KEPT_LENGTH = 64
CLOSING = b".,"
WORD_END = "</w>"
JOINED = 200

_encoders: dict[str, object] = {}


def encoder(name: str):
    """The tokenizer of this worker process; ``name`` is a public vocabulary file or a path to one."""
    if name not in _encoders:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one core a task
        from tokenizers import Tokenizer

        if os.path.isabs(name):
            path = name
        else:
            import public_tokenizers

            path = public_tokenizers.path(name)
        _encoders[name] = Tokenizer.from_file(path)
    return _encoders[name]


class PieceLengths:
    """Token counts of texts through the lengths of their pieces; memory is bounded by the kept pieces."""

    def __init__(self, name: str) -> None:
        self.encoder = encoder(name)
        self.known: dict[bytes, int] = {}
        vocabulary = self.encoder.get_vocab()
        self.closes_word = np.zeros(max(vocabulary.values()) + 1, bool)
        self.closes_word[[i for token, i in vocabulary.items() if token.endswith(WORD_END)]] = True

    def counts(self, texts: list[bytes]) -> list[int]:
        pieces = [text.split() for text in texts]
        new = set()
        for words in pieces:
            new.update(words)
        if len(self.known) + 2 * len(new) > KEPT_PIECES:
            self.known = {}
        known = self.known
        new.difference_update(known)
        cores = {piece: _core(piece) for piece in new}
        missing = list({core for core, _ in cores.values() if core not in known})
        passing: dict[bytes, int] = {}
        for core, length in zip(missing, self._encoded([x.decode("utf-8") for x in missing])):
            (known if len(core) <= KEPT_LENGTH else passing)[core] = length
        for piece, (core, closing) in cores.items():
            length = (known[core] if core in known else passing[core]) + closing
            (known if len(piece) <= KEPT_LENGTH else passing)[piece] = length
        look = (lambda x: known[x] if x in known else passing[x]) if passing else known.__getitem__
        return [sum(map(look, words)) for words in pieces]


    def _encoded(self, cores: list[str]) -> list[int]:
        """Token counts of the cores. Those of letters only are encoded many to a text, told apart by word ends."""
        lengths = [0] * len(cores)
        words = [i for i, core in enumerate(cores) if core.isalpha()]
        alone = [i for i, core in enumerate(cores) if not core.isalpha()]
        groups = [words[i : i + JOINED] for i in range(0, len(words), JOINED)]
        for some in (groups[i : i + 64] for i in range(0, len(groups), 64)):
            texts = [" ".join(map(cores.__getitem__, group)) for group in some]
            for group, result in zip(some, self.encoder.encode_batch_fast(texts, add_special_tokens=False)):
                ends = np.flatnonzero(self.closes_word[np.array(result.ids)])
                if len(ends) == len(group):  # every core has one word end at least, so each has exactly one
                    for i, length in zip(group, np.diff(ends, prepend=-1).tolist()):
                        lengths[i] = length
                else:
                    alone.extend(group)
        for start in range(0, len(alone), ENCODE_PIECES):
            some = alone[start : start + ENCODE_PIECES]
            encoded = self.encoder.encode_batch_fast([cores[i] for i in some], add_special_tokens=False)
            for i, result in zip(some, encoded):
                lengths[i] = len(result)
        return lengths


def _core(piece: bytes) -> tuple[bytes, int]:
    """The piece without one closing mark after an ASCII letter, which is a token of its own, and their number.

    All-letter ASCII cores are lower-cased, as the vocabulary does with every text.
    """
    closing = int(piece[-1] in CLOSING and piece[-2:-1].isalpha())
    core = piece[:-1] if closing else piece
    return (core.lower() if core.isalpha() else core), closing


def by_bytes(values: Iterable[bytes | None], limit: int) -> Iterator[list[bytes]]:
    """Consecutive texts, about ``limit`` bytes at a time; a longer text stands alone. Null is empty."""
    batch, held = [], 0
    for value in values:
        value = value or b""
        if batch and held + len(value) > limit:
            yield batch
            batch, held = [], 0
        batch.append(value)
        held += len(value)
    if batch:
        yield batch


def token_counts(
    docs: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = "word_bpe_49k.json", limit: int = 2048
) -> DataFrame:
    """One row per row of ``docs``: the key, ``n_bytes``, ``n_tokens`` and ``over_limit`` (more than ``limit`` tokens).

    Null and empty texts have no bytes and no tokens; keys may be null or repeat, rows are kept as they are. Other
    columns are not read. There is no shuffle: a lost task is computed again from its split.
    """

    def lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = PieceLengths(vocabulary)
        for batch in batches:
            texts, sizes, tokens = batch.column(1), [], []
            for some in by_bytes((x.as_buffer().to_pybytes() if x.is_valid else None for x in texts), BATCH_BYTES):
                sizes.extend(map(len, some))
                tokens.extend(count.counts(some))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(tokens, pa.int64())], names=["key", "n_bytes", "n_tokens"]
            )

    pair = docs.select(F.col(key).alias("key"), F.col(text).cast("binary").alias("text"))
    counted = pair.mapInArrow(lengths, f"key {docs.schema[key].dataType.simpleString()}, n_bytes long, n_tokens long")
    return counted.select(F.col("key").alias(key), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
