"""Token ids of whole texts, with the tokenizer's work done once per distinct word."""

from __future__ import annotations

import os
from collections.abc import Iterator
from itertools import chain
from string import punctuation

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Text that is held as words at one time, in bytes.
SLICE_BYTES = 4 << 20
# Letters that are composed already and whose lower case is one letter.
LETTERS = "".join(c for c in map(chr, range(0x180)) if c.isalpha() and c != "\u0130")
# Byte-level vocabularies spell a byte as its Latin-1 character, but for the bytes that are no printable
# character there; those above 127 follow one another from U+0122. Stems hold no byte below 128 that is none.
BYTE_SIGNS = np.arange(256, dtype="<u4")
BYTE_SIGNS[[*range(0x80, 0xA1), 0xAD]] = 0x122 + np.arange(34)


class WordTokenizer:
    """Encodes Arrow columns of texts with a tokenizer that drops white space.

    No token of such a tokenizer spans white space, and its normalizer looks at
    no character beyond it, so a text's ids are those of its words in a row.
    Words repeat, so every distinct word of a slice is encoded once. A word of
    ``LETTERS`` is composed already; it is lowered, spelled in the byte signs
    and handed to the tokenizer's model alone, and so is the run of punctuation
    behind it, which is remembered. All other words take all steps of the
    tokenizer.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tails: dict[str, list[int]] = {}

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and where each text's ids begin and end; null counts as empty."""
        listed = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        coded = listed.flatten().dictionary_encode()
        flat, sizes = self._words(coded.dictionary)
        codes = np.asarray(coded.indices)
        ids, ends = gathered(flat, sizes, codes)
        bounds = np.concatenate(([0], ends))[np.asarray(listed.offsets) - listed.offsets[0].as_py()]
        return ids, bounds

    def _words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words in a row, and how many each one has."""
        stems = pc.utf8_rtrim(words, characters=punctuation)
        plain = pc.and_(pc.equal(pc.utf8_ltrim(stems, characters=LETTERS), ""), pc.not_equal(stems, ""))
        stems = pc.utf8_lower(stems.filter(plain)).dictionary_encode()
        tails = pc.utf8_ltrim(words.filter(plain), characters=LETTERS).dictionary_encode()
        hard = self.tokenizer.encode_batch_fast(words.filter(pc.invert(plain)).to_pylist(), add_special_tokens=False)
        # Every word is a stem and a tail; of the others the tail is empty.
        pieces = [*self._stems(stems.dictionary), *map(self._tail, tails.dictionary.to_pylist()), *(x.ids for x in hard), []]
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        flat = np.fromiter(chain.from_iterable(pieces), "<u4", int(sizes.sum()))
        easy = plain.to_numpy(zero_copy_only=False)
        parts = np.full((len(words), 2), len(pieces) - 1, np.int64)
        parts[easy, 0] = stems.indices
        parts[easy, 1] = np.asarray(tails.indices) + len(stems.dictionary)
        parts[~easy, 0] = np.arange(len(hard)) + len(stems.dictionary) + len(tails.dictionary)
        return gathered(flat, sizes, parts.ravel())[0], sizes[parts].sum(axis=1)

    def _stems(self, stems: pa.Array) -> list[list[int]]:
        if not len(stems):
            return []
        tokenize = self.tokenizer.model.tokenize
        joined = pc.binary_join(pa.ListArray.from_arrays([0, len(stems)], stems), " ")[0].as_buffer()
        signs = BYTE_SIGNS[np.frombuffer(joined, np.uint8)].tobytes().decode("utf-32-le")
        return [[t.id for t in tokenize(stem)] for stem in signs.split(" ")]

    def _tail(self, tail: str) -> list[int]:
        if len(self.tails) > 100_000:
            self.tails.clear()
        if tail not in self.tails:
            self.tails[tail] = self.tokenizer.encode(tail, add_special_tokens=False).ids
        return self.tails[tail]


def gathered(flat: np.ndarray, sizes: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of ``flat``, which are ``sizes`` long, in the order of ``codes``, and where each one ends."""
    begins = np.cumsum(sizes) - sizes
    sizes = sizes[codes]
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    return flat[np.repeat(begins[codes] - (ends - sizes), sizes) + np.arange(total)], ends


def text_slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows with about ``most`` bytes of text; a longer text stands alone."""
    size = pc.fill_null(pc.binary_length(batch[column]), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    group = (np.cumsum(size) - size) // most
    edges = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(size)]
    for a, b in zip(edges, edges[1:]):
        if b > a:
            yield batch.slice(a, b - a)
