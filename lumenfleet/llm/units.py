"""Tokenizing by self-contained units: every distinct unit of text is worked out once per Python worker.

Both public tokenizers cut a text at white space before they merge bytes, so a text falls into units (white space with the
word behind it, or a word alone) whose token ids don't depend on their neighbours. Units get integer codes, new ones are
worked out in bulk, and whole batches of texts are then assembled from arrays.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Callable, Iterable, Iterator
from itertools import chain, compress

import numpy as np
import pyarrow as pa

#: Unicode White_Space, as the tokenizers' patterns read it (fixed value).
WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
SPACED_UNIT = re.compile(f"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+")
WORD_UNIT = re.compile(f"[^{WHITE}]+")
#: Python takes these for white space too, the tokenizers don't.
NOT_WHITE = re.compile("[\\x1c-\\x1f]")
SEPARATOR = "<|endoftext|>"
#: The two pre-tokenizers' patterns (fixed values).
BYTE_PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
WORD_PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def words_only(text: str) -> list[str]:
    return WORD_UNIT.findall(text) if NOT_WHITE.search(text) else text.split()


class _Codes(dict):
    def __init__(self):
        self.new: list[str] = []

    def __missing__(self, unit: str) -> int:
        self[unit] = code = len(self)
        self.new.append(unit)
        return code


class UnitTable:
    """Rows of integers for text units. compute(units) gives the rows of new units as (flat values, lengths).

    max_units bounds the memory of a worker: beyond it, units that were met once are forgotten, or all, where the others are more than
    half of the bound. Results don't depend on it.
    """

    def __init__(self, split: Callable[[str], list[str]], compute: Callable, max_units: int = 800_000):
        self.split, self.compute, self.max_units = split, compute, max_units
        self._reset()

    def _reset(self) -> None:
        self.codes, self.flat = _Codes(), np.zeros(0, np.int32)
        self.lengths, self.starts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.met = np.zeros(0, np.int32)

    def _forget(self) -> None:
        """Drop what was met once; the others count half from here on, so that what is met no more goes in time."""
        kept = np.flatnonzero(self.met > 1)
        if len(kept) > self.max_units // 2:
            self._reset()
            return
        units = list(compress(self.codes, (self.met > 1).tolist()))
        self.flat, self.lengths, self.met = self.values(kept), self.lengths[kept], self.met[kept] // 2
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.codes.clear()
        self.codes.update(zip(units, range(len(units)), strict=True))

    def batch(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Codes of all units of the texts, one after another, and the number of units of each text."""
        if len(self.codes) > self.max_units:
            self._forget()
        units = [self.split(t) for t in texts]
        sizes = np.fromiter(map(len, units), np.int64, len(units))
        codes = np.fromiter(map(self.codes.__getitem__, chain.from_iterable(units)), np.int64, int(sizes.sum()))
        if self.codes.new:
            flat, lengths = self.compute(self.codes.new)
            self.flat = np.concatenate([self.flat, flat])
            self.lengths = np.concatenate([self.lengths, lengths])
            self.starts = np.cumsum(self.lengths) - self.lengths
            self.codes.new = []
        met = np.bincount(codes, minlength=len(self.codes)).astype(np.int32)
        met[: len(self.met)] += self.met
        self.met = met
        return codes, sizes

    def values(self, codes: np.ndarray) -> np.ndarray:
        lengths = self.lengths[codes]
        at = np.repeat(self.starts[codes] - (np.cumsum(lengths) - lengths), lengths)
        return self.flat[at + np.arange(len(at))]


def by_text(numbers: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sum of each text's numbers; sizes has how many each text has."""
    sums = np.concatenate([[0], np.cumsum(numbers, dtype=np.int64)])
    ends = np.cumsum(sizes)
    return sums[ends] - sums[ends - sizes]


def loaded(path: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def library_ids(tokenizer) -> Callable:
    """compute() for UnitTable: ids as the tokenizers library gives them, many units to a call.

    Units are handed over with a special token between them; the library cuts there before anything else.
    """
    stop = tokenizer.token_to_id(SEPARATOR)

    def ids_of(text: str) -> list[int]:
        return tokenizer.encode(text, add_special_tokens=False).ids

    def compute(units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        rows: dict[int, np.ndarray] = {}
        plain = [i for i, u in enumerate(units) if "<|" not in u]
        lengths = np.zeros(len(units), np.int64)
        parts = []
        for at in range(0, len(plain), 1000):
            some = plain[at : at + 1000]
            ids = np.array(ids_of(SEPARATOR.join([units[i] for i in some]) + SEPARATOR), np.int32)
            ends = np.flatnonzero(ids == stop)
            if len(ends) != len(some):  # can't happen while units don't hold the separator
                raise ValueError("the tokenizer did not cut at its special token")
            lengths[some] = np.diff(ends, prepend=-1) - 1
            parts.append(ids[ids != stop])
        if len(plain) == len(units):
            return np.concatenate(parts) if parts else np.zeros(0, np.int32), lengths
        flat, cut = np.concatenate([*parts, np.zeros(0, np.int32)]), np.cumsum(lengths[plain])
        rows = dict(zip(plain, np.split(flat, cut[:-1]) if plain else [], strict=True))
        for i, u in enumerate(units):
            if i not in rows:
                rows[i] = np.array(ids_of(u), np.int32)
                lengths[i] = len(rows[i])
        return np.concatenate([rows[i] for i in range(len(units))]), lengths

    return compute


def byte_alphabet() -> dict[str, int]:
    """Byte-level vocabularies write bytes as printable characters: those that print stand for themselves, the others follow from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


#: Units of plain Latin text: no normal form changes them, and every Unicode version tells their letters and digits alike.
PLAIN = re.compile("[ ]?[!-~\\xa1-\u024f]+")


class PieceIds:
    """compute() for UnitTable: plain Latin units are cut by the tokenizer's pattern and each distinct piece goes to the library's
    model once; all other units, and those that may hold special tokens, go through the whole library.

    Ids are kept as bytes (32-bit numbers), not as lists: Python's garbage collector has none of them to go through.
    """

    def __init__(self, tokenizer, pattern: str, lower: bool, most: int = 100_000):
        import regex

        self.model, self.library = tokenizer.model, library_ids(tokenizer)
        self.cut, self.lower, self.most = regex.compile(pattern).findall, lower, most
        self.printed = {b: c for c, b in byte_alphabet().items()}
        self.known: dict[str, bytes] = {}

    def _piece(self, piece: str) -> bytes:
        ids = self.known[piece] = array("i", [t.id for t in self.model.tokenize(piece.encode().decode("latin-1").translate(self.printed))]).tobytes()
        return ids

    def __call__(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if len(self.known) > self.most:
            self.known.clear()
        out: list[bytes] = []
        sizes = np.zeros(len(units), np.int64)
        others: list[int] = []
        known, tokenize, lower = self.known, self.model.tokenize, self.lower
        for i, unit in enumerate(units):
            word = unit[1:] if unit[0] == " " else unit
            if word.isascii() and word.isalpha():  # one piece, written as it stands
                ids = array("i", [t.id for t in tokenize(("\u0120" if len(word) < len(unit) else "") + (word.lower() if lower else word))]).tobytes()
            elif "<|" in unit or not PLAIN.fullmatch(unit):
                others.append(i)
                continue
            else:
                ids = b"".join([known.get(piece) or self._piece(piece) for piece in self.cut(unit.lower() if lower else unit)])
            sizes[i] = len(ids) // 4
            out.append(ids)
        plain = np.frombuffer(b"".join(out), np.int32)
        if not others:
            return plain, sizes
        flat, lengths = self.library([units[i] for i in others])
        sizes[others] = lengths
        other = np.zeros(len(units), bool)
        other[others] = True
        whole = np.empty(len(plain) + len(flat), np.int32)
        theirs = np.repeat(other, sizes)
        whole[theirs], whole[~theirs] = flat, plain
        return whole, sizes


_KEPT: dict[tuple, UnitTable] = {}


def kept_table(kind: str, path: str, make: Callable[[str], UnitTable]) -> UnitTable:
    """The worker's table of this kind, kept from task to task where Spark keeps the worker."""
    if (kind, path) not in _KEPT:
        _KEPT[kind, path] = make(path)
    return _KEPT[kind, path]


def forget_tables() -> None:
    """Drop the worker's tables: for steps that need none, in a worker that earlier steps have used. They are made anew when asked for."""
    _KEPT.clear()


def byte_level_ids(path: str) -> UnitTable:
    return kept_table("byte ids", path, lambda p: UnitTable(SPACED_UNIT.findall, PieceIds(loaded(p), BYTE_PIECES, lower=False)))


def word_level_ids(path: str) -> UnitTable:
    return kept_table("word ids", path, lambda p: UnitTable(words_only, PieceIds(loaded(p), WORD_PIECES, lower=True)))


def in_chunks(texts: Iterable[str | None], most_chars: int = 2_000_000) -> Iterator[tuple[int, list[str]]]:
    """(index of the first, texts) in runs of bounded size, at least one text each; null reads as empty."""
    first, chunk, size = 0, [], 0
    for t in texts:
        t = t or ""
        if chunk and size + len(t) > most_chars:
            yield first, chunk
            pa.default_memory_pool().release_unused()
            first, chunk, size = first + len(chunk), [], 0
        chunk.append(t)
        size += len(t)
    if chunk:
        yield first, chunk


def document_ids(table: UnitTable, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Token ids of all texts, one after another, and the number of each text's ids."""
    codes, sizes = table.batch(texts)
    return table.values(codes), by_text(table.lengths[codes], sizes)
