"""Token ids of texts by a public byte-level BPE vocabulary, as unsigned 32-bit integers.

Texts are cut into chunks where the vocabulary's split pattern always starts a new piece, so the ids of
a text are those of its chunks. A chunk that occurs again is not encoded again: Arrow numbers the
distinct chunks of a batch, and the tokenizer sees only those that a worker does not remember.
"""

from __future__ import annotations

import os
from collections.abc import Iterable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc

VOCABULARY = "byte_bpe_50k.json"
#: Chunks whose ids are remembered in a worker, at most, and the bytes of one.
REMEMBERED, LONGEST = 400_000, 64
#: Bytes of texts that are cut and numbered together, and that a task encodes at a time, about; one longer
#: text goes alone. They bound what a worker holds beside its batch.
TOGETHER, SLICE = 2_000_000, 4_000_000


def _marked(*parts: Iterable[int]) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    for p in parts:
        out[list(p)] = True
    return out


#: ASCII white space; visible ASCII; punctuation that no piece shares with a letter before it.
_WHITE, _VISIBLE, _POINT = _marked(range(9, 14), [32]), _marked(range(33, 127)), _marked(b",.;:!?")
_LETTER = _marked(range(65, 91), range(97, 123))
#: First bytes of characters that are no white space (the others may be).
_SURE = _marked(range(33, 256)) & ~_marked([0x7F, 0xC2, 0xE1, 0xE2, 0xE3])
_MAYBE = _WHITE | _POINT
#: The character that a byte-level vocabulary writes for each byte: visible Latin-1 as it is, the others from U+0100.
_AS_IS = _VISIBLE | _marked(range(0xA1, 0x100)) & ~_marked([0xAD])
_WRITTEN = np.where(_AS_IS, np.arange(256), 255 + np.cumsum(~_AS_IS)).astype("<u2")


def edges(raw: np.ndarray, offsets: np.ndarray, sure: np.ndarray = _SURE) -> np.ndarray:
    """Where chunks of texts begin, and the end: at every text, before a space that a visible character
    (by its first byte, of those in sure) follows, before white space after visible ASCII, and before a
    point after a letter."""
    cut = np.zeros(len(raw) + 1, dtype=bool)
    at = np.flatnonzero(_MAYBE[raw])
    if len(at):
        this, last = raw[at], len(raw) - 1
        after, before, second = raw[np.minimum(at + 1, last)], raw[np.maximum(at - 1, 0)], raw[np.maximum(at - 2, 0)]
        ends = np.zeros(len(raw) + 1, dtype=bool)
        ends[offsets] = True
        inner = ~ends[at + 1]  # what follows is of the same text
        # letters of two bytes: U+00C0 to U+00FF but for two signs, and Cyrillic
        wide = (before >= 0x80) & (before < 0xC0) & (((second == 0xC3) & (before != 0x97) & (before != 0xB7)) | (second == 0xD0) | (second == 0xD1))
        cut[at] = ((this == 32) & inner & sure[after]) | (_WHITE[this] & _VISIBLE[before]) | (_POINT[this] & (_LETTER[before] | wide))
    cut[offsets] = True
    cut[len(raw)] = True
    return np.flatnonzero(cut)


def taken(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The places of runs, one after another."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)


class Encoder:
    """Encodes whole texts; ids are those of the tokenizers library with add_special_tokens=False.

    As in the library, a text that spells a special token gets that token's id; with specials_as_text it
    is encoded like other text. Special tokens must not hold white space or points.
    """

    def __init__(self, path: str, specials_as_text: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = specials_as_text
        # a token of a byte-level vocabulary is written with one character a byte, an added one as it is
        own, every = self.tokenizer.get_vocab(with_added_tokens=False), self.tokenizer.get_vocab()
        self.n_bytes = np.zeros(max(every.values()) + 1, dtype=np.int64)
        for token, i in every.items():
            self.n_bytes[i] = len(token) if token in own else len(token.encode())
        # a special token ends the text before it, and so a run of white space that no cut may part
        self.words = self.tokenizer.model.tokenize
        self.spelled = not any(t.content.isalpha() for t in self.tokenizer.get_added_tokens_decoder().values())
        self.sure = _SURE & ~_marked([t.content.encode()[0] for t in self.tokenizer.get_added_tokens_decoder().values()])
        self.forget()

    def forget(self) -> None:
        self.known, self.starts, self.lengths, self.ids, self.n_ids = pa.array([], pa.binary()), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(1 << 20, np.uint32), 0

    def _encoded(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, dtype=np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _words(self, raw: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Which chunks are a word alone, or one after a single white byte: ASCII letters and U+00C0 to U+00FF
        but for two signs."""
        lead = raw == 0xC3
        lead[:-1] &= (raw[1:] != 0x97) & (raw[1:] != 0xB7)
        letter = _LETTER[raw] | lead
        letter[1:] |= lead[:-1]
        other = np.concatenate([[0], np.cumsum(~letter, dtype=np.int32)])
        first = off[:-1]
        size = np.diff(off)
        return (size > 0) & (other[off[1:]] - other[np.minimum(first + 1, off[1:])] == 0) & (letter[first] | _WHITE[raw[first]] & (size > 1))

    def _spelled(self, raw: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids and their number for words, which are one piece each (a white byte but a space is a piece of its
        own), so that they need no search for pieces and go to the vocabulary's model as they are."""
        text, ends = _WRITTEN[raw].tobytes().decode("utf-16-le"), np.cumsum(size)
        starts = ends - size
        apart = starts[_WHITE[raw[starts]] & (raw[starts] != 32)] + 1
        cut = np.sort(np.concatenate([starts, apart]))
        words, ids, n = self.words, [], []
        for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(text)], strict=True):
            own = words(text[a:b])
            ids += [t.id for t in own]
            n.append(len(own))
        return np.array(ids, dtype=np.uint32), np.add.reduceat(np.array(n, dtype=np.int64), np.searchsorted(cut, starts))

    def _learned(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids and their number for each chunk. Words are spelled. Other chunks of a space and visible ASCII go to
        the tokenizer in one text, since pieces begin where they do; its ids are cut where the chunks' bytes end."""
        raw, off = np.frombuffer(chunks.buffers()[2] or b"", dtype=np.uint8), np.frombuffer(chunks.buffers()[1], dtype=np.int32)[chunks.offset : chunks.offset + len(chunks) + 1].astype(np.int64)
        size = np.diff(off)
        short = (size > 1) & (size <= LONGEST)
        whole, word = short.copy(), np.zeros(len(chunks), dtype=bool)
        if self.spelled and short.any():
            word = short & self._words(raw[off[0] : off[-1]], off - off[0])
        whole[whole] = (raw[off[:-1][whole]] == 32) & _VISIBLE[raw[off[:-1][whole] + 1]] & ~_WHITE[raw[off[1:][whole] - 1]]
        whole &= ~word
        counts, parts = np.zeros(len(chunks), dtype=np.int64), [np.zeros(0, np.uint32)]
        spelled, joined, single = np.flatnonzero(word), np.flatnonzero(whole), np.flatnonzero(~(whole | word))
        if len(spelled):
            ids, counts[spelled] = self._spelled(raw[taken(off[spelled], size[spelled])], size[spelled])
            parts.append(ids)
        if len(joined):
            text = raw[taken(off[joined], size[joined])].tobytes().decode()
            ids = self._encoded([text])[0]
            ends = np.searchsorted(np.cumsum(self.n_bytes[ids]), np.cumsum(size[joined])) + 1
            counts[joined] = np.diff(ends, prepend=0)
            parts.append(ids)
        if len(single):
            found = self._encoded([c.decode() for c in chunks.take(pa.array(single)).to_pylist()])
            counts[single] = [len(x) for x in found]
            parts.extend(found)
        ids, order = np.concatenate(parts), np.concatenate([spelled, joined, single])
        starts = np.zeros(len(chunks), dtype=np.int64)
        starts[order] = np.cumsum(counts[order]) - counts[order]
        return ids[taken(starts, counts)], counts

    def _remember(self, chunks: pa.Array, ids: np.ndarray, counts: np.ndarray) -> None:
        if self.n_ids + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids[: self.n_ids], np.zeros(max(len(ids), self.n_ids), np.uint32)])
        self.ids[self.n_ids : self.n_ids + len(ids)] = ids
        self.starts = np.concatenate([self.starts, self.n_ids + np.cumsum(counts) - counts])
        self.lengths = np.concatenate([self.lengths, counts])
        self.known = pa.concat_arrays([self.known, chunks])
        self.n_ids += len(ids)

    def _places(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, and where in them those of each distinct chunk start and how many they are."""
        if len(self.known) > REMEMBERED:
            self.forget()
        place = pc.index_in(chunks, value_set=self.known).fill_null(-1).to_numpy().astype(np.int64)
        new = np.flatnonzero(place < 0)
        chunks = chunks.take(pa.array(new))
        short = pc.less_equal(pc.binary_length(chunks), LONGEST).to_numpy(zero_copy_only=False)
        fresh = chunks.filter(pa.array(short))
        if len(fresh):
            ids, counts = self._learned(fresh)
            place[new[short]] = np.arange(len(self.starts), len(self.starts) + len(counts))
            self._remember(fresh, ids, counts)
        flat, starts, lengths = self.ids, self.starts, self.lengths
        if len(fresh) < len(chunks):  # long chunks are not remembered
            ids, counts = self._learned(chunks.filter(pa.array(~short)))
            place[new[~short]] = np.arange(len(starts), len(starts) + len(counts))
            flat = np.concatenate([flat[: self.n_ids], ids])
            starts, lengths = np.concatenate([starts, self.n_ids + np.cumsum(counts) - counts]), np.concatenate([lengths, counts])
        return flat, starts[place], lengths[place]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and the number of ids of each; null texts have none."""
        cut, firsts = [], []
        for raw, offsets in _groups(texts.fill_null("")):
            at = edges(raw, offsets, self.sure)
            cut.append(pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(raw)]).dictionary_encode())
            firsts.append(np.searchsorted(at, offsets).astype(np.int32))
        if not cut:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        # the groups' distinct chunks are made one list, so that what is known is looked up once
        every = pa.concat_arrays([c.dictionary for c in cut]).dictionary_encode()
        flat, starts, lengths = self._places(every.dictionary)
        own = np.split(every.indices.to_numpy(), np.cumsum([len(c.dictionary) for c in cut])[:-1])
        ids, counts = [], []
        for c, first, place in zip(cut, firsts, own, strict=True):
            row = place[c.indices.to_numpy()]
            n = lengths[row]
            ends = np.concatenate([[0], np.cumsum(n)])
            ids.append(flat[taken(starts[row], n)])
            counts.append(np.diff(ends[first]))
        return np.concatenate(ids), np.concatenate(counts)


def _groups(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Bytes and offsets of runs of texts of about TOGETHER bytes."""
    raw, off = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8), _offsets(texts)
    for at, end in _bounds(off, TOGETHER):
        yield raw[off[at] : off[end]], off[at : end + 1] - off[at]


def _offsets(texts: pa.Array) -> np.ndarray:
    wide = pa.types.is_large_string(texts.type)
    return np.frombuffer(texts.buffers()[1], dtype=np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)


def _bounds(offsets: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    at, n = 0, len(offsets) - 1
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1)
        yield at, end
        at = end


def slices(batches: Iterable[pa.RecordBatch], column: str = "text") -> Iterator[pa.RecordBatch]:
    """Batches cut into runs of rows with about SLICE bytes of text each."""
    for b in batches:
        if b.num_rows:
            for at, end in _bounds(_offsets(b.column(column)), SLICE):
                yield b.slice(at, end - at)
        pa.default_memory_pool().release_unused()


def with_end(ids: np.ndarray, counts: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The same with one more id at the end of each text."""
    return np.insert(ids, np.cumsum(counts), end).astype(np.uint32, copy=False), counts + 1


_encoders: dict[tuple, Encoder] = {}


def encoder(path: str | None = None, specials_as_text: bool = False) -> Encoder:
    """One encoder a worker process and vocabulary."""
    key = (path or public_tokenizers.path(VOCABULARY), specials_as_text)
    if key not in _encoders:
        _encoders[key] = Encoder(*key)
    return _encoders[key]
