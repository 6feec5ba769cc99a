"""Transliteration of whole Arrow batches: texts are cut into the kernel's chunks by tables of characters, without a Python object for a word.

A batch's chunks are few different ones, as they are syllables and signs; only these go through the kernel, and the texts are taken together from their results.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from lipika.functions import kernel

#: Bytes that make a text odd (``Transliterator.__call__``), and those between words.
ODD, SPACES = b"<#\0", " \t\r\n"


class Batches:
    """One direction over batches; the same texts as ``kernel.Transliterator`` gives, which must be known."""

    def __init__(self, source: str, target: str, mask: int):
        self.one = one = kernel.transliterator(source, target, mask)
        reader = one.reader
        both = (lambda c: {c, c.upper()} if reader.fold and "a" <= c <= "z" else {c})
        chars = sorted({x for c in {*reader.after, *reader.held}.union(*reader.after.values()) for x in both(c)})
        number = {c: n for n, c in enumerate(chars, 1)}
        self.top = max(map(ord, chars + [*SPACES])) + 1  # characters from here on are none of them, like 0
        self.numbers = np.zeros(self.top + 1, np.int32)
        self.numbers[[ord(c) for c in chars]] = range(1, len(chars) + 1)
        self.joined = np.zeros((len(chars) + 1, len(chars) + 1), bool)
        for c, ys in reader.after.items():
            for x in both(c):
                self.joined[number[x], [number[y] for z in ys for y in both(z)]] = True
        for c in reader.held:
            self.joined[[number[x] for x in both(c)]] = True
        self.tamil = self._places(reader.tamil)
        self.nasals = self._places(reader.nasals) if one.writer.looks_ahead else None
        self.spaces = np.zeros(self.top + 1, bool)
        self.spaces[[ord(c) for c in SPACES]] = True

    def _places(self, pattern) -> np.ndarray | None:
        return pattern and np.array([bool(pattern.search(chr(n))) for n in range(self.top)] + [False])

    def __call__(self, texts: pa.StringArray) -> pa.StringArray:
        """The texts in the target script, null for null."""
        texts = texts.cast(pa.string())
        if self.one.to_tamil or not len(texts):
            return pa.array(map(self.one, texts.to_pylist()), pa.string())
        starts, data, points = self._read(texts)
        odd = self._texts_with(np.isin(data, np.frombuffer(ODD, np.uint8)), starts)
        tamil = np.zeros_like(odd) if self.tamil is None else self._texts_with(self.tamil[points], self._at(data)[1][starts])
        if not (odd | tamil).any():
            return self._plain(texts, starts, data, points)
        mask = pa.array(odd | tamil)
        rest = pc.if_else(mask, "", texts)
        return pc.replace_with_mask(self._plain(rest, *self._read(rest)), mask, pa.array(self._special(texts.filter(mask).to_pylist()), pa.string()))

    def _special(self, texts: list[str]) -> list[str]:
        """Odd texts by their plain parts, and those with Tamil letters by the kernel."""
        cut = [None if self.one.tamil and self.one.tamil.search(t) else kernel.parts(t) for t in texts]
        plain = pa.array([p for parts in cut for p, _ in parts or ()], pa.string())
        found = iter(self._plain(plain, *self._read(plain)).to_pylist() if len(plain) else ())
        out = []
        for text, parts in zip(texts, cut):
            if parts is None:
                out.append(self.one(text))
                continue
            written = [(next(found), literal) for _, literal in parts]
            ends = next((n for n, (_, literal) in enumerate(written) if not literal), len(written))  # an empty one ends the text
            out.append("".join([x for p, literal in written[: ends + 1] for x in (p, self.one.writer.strip(literal or ""))]))
        return out

    def _read(self, texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where texts start (and the last one ends) in their bytes, the bytes, and their characters, those beyond the tables as one."""
        starts = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[starts[0] : starts[-1]]
        points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
        return starts - starts[0], data, np.minimum(points, self.top)

    @staticmethod
    def _at(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The byte of each character, and how many characters start before each byte and the end."""
        first = (data & 0xC0) != 0x80
        return np.flatnonzero(first), np.concatenate(([0], np.cumsum(first)))

    @staticmethod
    def _texts_with(found: np.ndarray, starts: np.ndarray) -> np.ndarray:
        out = np.zeros(len(starts) - 1, bool)
        out[np.searchsorted(starts, np.flatnonzero(found), "right") - 1] = True
        return out

    def _plain(self, texts: pa.StringArray, starts: np.ndarray, data: np.ndarray, points: np.ndarray) -> pa.StringArray:
        """Texts that are not odd and have no Tamil letter."""
        if not len(data):
            return texts
        at, before = self._at(data)
        numbers, first = self.numbers[points], np.ones(len(points), bool)
        first[1:] = ~self.joined[numbers[:-1], numbers[1:]]
        begin = before[starts[:-1]]
        begin = begin[begin < len(points)]
        if self.nasals is not None:  # words with a nasal are whole: it is written by what follows
            space = self.spaces[points]
            edge = np.ones(len(points), bool)
            edge[1:] = space[1:] | space[:-1]
            edge[begin] = True
            words = np.cumsum(edge) - 1
            whole = np.zeros(words[-1] + 1, bool)
            whole[words[self.nasals[points]]] = True
            first = np.where(whole[words], edge, first)
        first[begin] = True
        chunks = at[first]
        cut = pa.StringArray.from_buffers(len(chunks), pa.py_buffer(np.append(chunks, len(data)).astype(np.int32)), pa.py_buffer(data)).dictionary_encode()
        found = pa.array(map(self.one.pieces.__getitem__, cut.dictionary.to_pylist()), pa.string()).take(cut.indices)
        ends = np.frombuffer(found.buffers()[1], np.int32)[: len(found) + 1]
        bounds = ends[np.searchsorted(chunks, starts)].astype(np.int32)
        out = pa.StringArray.from_buffers(len(texts), pa.py_buffer(bounds), found.buffers()[2])
        return pc.if_else(texts.is_valid(), out, pa.scalar(None, pa.string())) if texts.null_count else out


@lru_cache(maxsize=16)
def batches(source: str, target: str, mask: int = 0) -> Batches:
    return Batches(source, target, mask)
