"""Token counts and token ids of whole texts, equal to those of the tokenizer library.

Two facts about byte-level BPE with a splitting pattern carry this module. (1) A blank after a visible character always
starts a new piece of the pattern, so the parts between such blanks can be encoded on their own, each distinct one once.
(2) The pattern has no memory: once two encodings of overlapping chunks have a common piece start, they agree from there
to near the end of the earlier one. Huge texts are encoded in overlapping chunks and spliced at such starts.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratemill.llm import words

VOCABULARY = "byte_bpe_50k.json"
CHUNK, OVERLAP, GUARD = 32_768, 512, 32
_MOST_UNITS, _TOGETHER = 1_500_000, 4096
_loaded: dict[str, tuple] = {}


def vocabulary_path(name: str) -> str:
    """A path as it is; a bare file name is looked up among the public tokenizers."""
    if "/" in name:
        return name
    import public_tokenizers

    return str(public_tokenizers.path(name))


def _encoder(path: str):
    """The tokenizer of this worker and its store of encoded units."""
    if path not in _loaded:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        _loaded[path] = (tokenizer, Units(tokenizer))
    return _loaded[path]


class Units:
    """Ids of units seen so far, by hash; emptied when it grows too large."""

    def __init__(self, tokenizer) -> None:
        self.tokenizer = tokenizer
        entries = tokenizer.get_vocab(with_added_tokens=True)
        self.width = np.zeros(max(entries.values()) + 1, np.int64)  # bytes of each token: one character stands for one byte
        self.width[list(entries.values())] = [len(t) for t in entries]
        self._clear()

    def _clear(self) -> None:
        self.keys, self.slot = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.bounds, self.ids = np.zeros(1, np.int64), np.zeros(0, np.uint32)

    def slots(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        hashes = words.word_hashes(data, start, end)
        distinct, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.keys) + len(distinct) > _MOST_UNITS:
            self._clear()
        spot = np.searchsorted(self.keys, distinct)
        known = np.zeros(len(distinct), bool)
        inside = spot < len(self.keys)
        known[inside] = self.keys[spot[inside]] == distinct[inside]
        new = first[~known]
        if len(new):
            sizes, ids = self._encoded(data, start[new], end[new])
            slots = np.arange(len(self.bounds) - 1, len(self.bounds) - 1 + len(new))
            self.ids = np.concatenate((self.ids, ids))
            self.bounds = np.concatenate((self.bounds, self.bounds[-1] + np.cumsum(sizes)))
            keys, slot = np.concatenate((self.keys, distinct[~known])), np.concatenate((self.slot, slots))
            order = np.argsort(keys, kind="stable")
            self.keys, self.slot = keys[order], slot[order]
        return self.slot[np.searchsorted(self.keys, distinct)][inverse]


    def _encoded(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of tokens of each unit, and all ids. Units with a blank before and a visible end go through together."""
        plain = (data[start] == 32) & _visible(data)[end - 1]
        order = np.concatenate((np.flatnonzero(plain), np.flatnonzero(~plain)))
        start, end, together = start[order], end[order], int(plain.sum())
        size = end - start
        total = np.concatenate(([0], np.cumsum(size)))
        raw = data[np.repeat(start - total[:-1], size) + np.arange(total[-1])].tobytes()
        cuts = [*range(0, together, _TOGETHER), *range(together, len(start) + 1)]
        texts = [raw[s:e].decode() for s, e in zip(total[cuts[:-1]].tolist(), total[cuts[1:]].tolist(), strict=True)]
        made = [np.array(x.ids, np.uint32) for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        ids = np.concatenate(made)
        found = np.searchsorted(np.cumsum(self.width[ids]), total[1:], "left") + 1  # tokens up to each unit's end
        first = np.concatenate(([0], found[:-1]))
        sizes = np.empty(len(order), np.int64)
        sizes[order] = found - first
        firsts = np.empty(len(order), np.int64)
        firsts[order] = first
        ends = np.cumsum(sizes)
        return sizes, ids[np.repeat(firsts - (ends - sizes), sizes) + np.arange(ends[-1])]


def _visible(data: np.ndarray) -> np.ndarray:
    """Bytes that end a visible ASCII or Latin-1 character."""
    seen = (data > 32) & (data < 127)
    seen[1:] |= (data[1:] >= 128) & (data[:-1] == 0xC3)
    return seen


def _unit_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text of each unit: cut before a blank that follows a visible ASCII or Latin-1 character."""
    cut = np.zeros(len(data), bool)
    cut[1:] = (data[1:] == 32) & _visible(data)[:-1]
    cut[offsets[:-1][offsets[:-1] < offsets[1:]]] = True
    start = np.flatnonzero(cut)
    end = np.append(start[1:], len(data)) if len(start) else start
    return start, end, np.searchsorted(offsets, start, "right") - 1


def text_ids(tokenizer_units: Units, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Token ids of each text, one after the other, and their bounds."""
    start, end, text = _unit_bounds(data, offsets)
    slot = tokenizer_units.slots(data, start, end)
    low, size = tokenizer_units.bounds[slot], np.diff(tokenizer_units.bounds)[slot]
    total = np.concatenate(([0], np.cumsum(size)))
    ids = tokenizer_units.ids[np.repeat(low - total[:-1], size) + np.arange(total[-1])]
    return ids, total[words.spans_of(text, len(offsets) - 1)]


class _Chunk:
    """An encoded stretch of a text: where pieces of the pattern start, and how many tokens stand before each."""

    def __init__(self, tokenizer, text: str, start: int, end: int) -> None:
        made = tokenizer.encode(text[start:end], add_special_tokens=False)
        pieces = made.word_ids
        first = [j for j in range(len(pieces)) if j == 0 or pieces[j] is None or pieces[j - 1] is None or pieces[j] != pieces[j - 1]]
        offsets = made.offsets
        self.start, self.end, self.total = start, end, len(pieces)
        self.before = {start + offsets[j][0]: j for j in reversed(first)}  # of tokens that share a start, the first


def count_by_chunks(tokenizer, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
    """Tokens of one text from overlapping chunks, spliced at proven common piece starts.

    A common start must lie `GUARD` characters before the earlier chunk's end, so that neither the pattern's look-ahead
    nor a cut special string reaches it. Without one the overlap doubles to the left, and if it then covers all that is
    not settled yet, the earlier chunk grows to the right.
    """
    count, settled = 0, 0
    now = _Chunk(tokenizer, text, 0, min(chunk, len(text)))
    while now.end < len(text):
        width, splice = overlap, None
        while splice is None:
            start = max(settled, now.end - width)
            after = _Chunk(tokenizer, text, start, min(len(text), now.end - min(width, now.end - start) + max(chunk, 2 * width)))
            common = (p for p in now.before if settled < p <= now.end - GUARD and p in after.before)
            splice = next(common, None) if after.end > now.end else None
            if splice is None and start == settled:
                break
            width *= 2
        if splice is None:  # nothing in common down to the settled place: take more text at once
            now = _Chunk(tokenizer, text, settled, min(len(text), now.end + max(chunk, now.end - settled)))
            continue
        count += now.before[splice] - now.before[settled]
        settled, now = splice, after
    return count + now.total - now.before.get(settled, 0)


def _counted(path: str, chunk: int, overlap: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokenizer, units = _encoder(path)
            for part in words.slices(batch, "text"):
                data, offsets = words.text_bytes(part.column("text"))
                size = np.diff(offsets)
                huge = np.flatnonzero(size > chunk)
                mask = np.repeat(size <= chunk, size)
                rest = np.concatenate(([0], np.cumsum(np.where(size > chunk, 0, size))))
                _, bounds = text_ids(units, data[mask], rest)
                counts = np.diff(bounds)
                for i in huge.tolist():
                    counts[i] = count_by_chunks(tokenizer, data[offsets[i] : offsets[i + 1]].tobytes().decode(), chunk, overlap)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(size, pa.int64()), pa.array(counts, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    return run


def token_counts(docs: DataFrame, vocabulary: str = VOCABULARY, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens of `docs` (doc_id, text), as the tokenizer library counts them.

    No begin, end or added tokens; special strings inside a text are handled as the library's default. Null and empty
    texts have 0 bytes and 0 tokens. Repeated rows and doc_ids are counted row by row; other columns are ignored.
    Texts of more than `chunk` bytes are encoded in overlapping chunks, so memory is bounded by the text, not by its
    tokens' objects.
    """
    path = vocabulary_path(vocabulary)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_counted(path, chunk, overlap), "doc_id long, n_bytes long, n_tokens long")
