"""Token counts by prefix dynamic programming over a byte-pair vocabulary.

For every prefix of a piece of text the table holds the exact number of tokens. The last token of a prefix's encoding is the
one vocabulary entry that ends the prefix and, next to the last token of what stands before it, survives merging as a pair;
so count(prefix) = count(prefix without that token) + 1, and no prefix is ever encoded. Budget and truncation questions are
then lookups.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from os.path import commonprefix

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import key_first
from .units import BYTE_PIECES, SEPARATOR, SPACED_UNIT, WHITE, UnitTable, by_text, byte_alphabet, in_chunks, kept_table


class PrefixCounter:
    """Exact token counts at every prefix for a byte-level BPE vocabulary file of the tokenizers library."""

    def __init__(self, path: str):
        import regex

        model = json.load(open(path, encoding="utf-8"))["model"]
        letters = byte_alphabet()
        as_bytes = lambda s: bytes(letters[c] for c in s)
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.rank = {(as_bytes(a), as_bytes(b)): i for i, (a, b) in reversed(list(enumerate(merges)))}
        self.vocabulary = {as_bytes(s) for s in model["vocab"] if all(c in letters for c in s)}
        self.longest = max(map(len, self.vocabulary))
        self.pieces, self.white = regex.compile(BYTE_PIECES), regex.compile(f"[{WHITE}]*")
        self.path = path
        self.pairs: dict[tuple[bytes, bytes], bool] = {}
        self.alone: dict[bytes, bool] = {}
        self.known: dict[bytes, list[int]] = {}

    def _merged(self, text: bytes) -> list[bytes]:
        """Merging by rank, for the few bytes of one or two tokens."""
        parts = [text[i : i + 1] for i in range(len(text))]
        while len(parts) > 1:
            ranked = [self.rank.get(p, 1 << 60) for p in zip(parts, parts[1:], strict=False)]
            if (best := min(ranked)) == 1 << 60:
                break
            i = ranked.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def _pair(self, a: bytes, b: bytes) -> bool:
        if (found := self.pairs.get((a, b))) is None:
            found = self.pairs[a, b] = self._merged(a + b) == [a, b]
        return found

    def _alone(self, a: bytes) -> bool:
        if (found := self.alone.get(a)) is None:
            found = self.alone[a] = self._merged(a) == [a]
        return found

    def piece(self, piece: bytes) -> list[int]:
        """counts[j]: tokens of piece[:j], for all j from 0 on."""
        if (found := self.known.get(piece)) is None:
            found = self.known[piece] = self._extended(piece, [0], [b""])
        return found

    def _extended(self, piece: bytes, counts: list[int], last: list[bytes]) -> list[int]:
        """counts of the whole piece from those of a prefix; last[j] ends the encoding of piece[:j]. Both lists grow in place."""
        vocabulary, longest, pairs = self.vocabulary, self.longest, self.pairs
        for j in range(len(counts), len(piece) + 1):
            for i in range(max(0, j - longest), j):
                token = piece[i:j]
                if token in vocabulary:
                    if i:
                        survives = pairs.get((last[i], token))
                        if survives is None:
                            survives = self._pair(last[i], token)
                    else:
                        survives = self._alone(token)
                    if survives:
                        break
            else:
                raise ValueError("a byte without a token")
            counts.append(counts[i] + 1)
            last.append(token)
        return counts

    def learn(self, pieces: Iterable[bytes]) -> None:
        """Work out new pieces in sorted order: each goes on from the prefix that it shares with the one before."""
        counts, last, before = [0], [b""], b""
        for piece in sorted(p for p in set(pieces) if p not in self.known):
            shared = len(commonprefix((before, piece)))
            counts, last, before = counts[: shared + 1], last[: shared + 1], piece
            self.known[piece] = self._extended(piece, counts, last)

    def unit(self, unit: str) -> list[int]:
        """Tokens of unit[:i] for i = 1..len(unit); the unit is white space with a word, as SPACED_UNIT cuts it."""
        if SEPARATOR in unit:  # the library cuts it out first: what is before it is a text of its own, and so is a part of it at the end
            counts: list[int] = []
            while (at := unit.find(SEPARATOR)) >= 0:
                base, own = (counts[-1] if counts else 0), self.unit(unit[:at] + SEPARATOR[:-1])
                counts += [base + n for n in own]
                counts.append(base + (own[at - 1] if at else 0) + 1)
                unit = unit[at + len(SEPARATOR) :]
            return counts + [counts[-1] + n for n in self.unit(unit)] if unit else counts
        out: list[int] = []
        for piece in self.pieces.findall(unit):
            base, raw = (out[-1] if out else 0), piece.encode("utf-8", "surrogatepass")
            counts = self.piece(raw)
            if len(raw) == len(piece):
                out += [base + c for c in counts[1:]]
            else:
                at = 0
                for c in piece:
                    at += len(c.encode("utf-8", "surrogatepass"))
                    out.append(base + counts[at])
            if piece in ("'re", "'ve", "'ll"):  # cut after the second character it is no contraction
                out[-2] = base + 2
        if (blank := self.white.match(unit).end()) > 1:  # white space at the end of a text is one piece
            full = unit[:blank].encode()
            out[blank - 1] = self.piece(full)[-1]
        return out

    def compute(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if len(self.pairs) > 2_000_000:
            self.pairs.clear()
        if len(self.known) > 150_000:
            self.known.clear()
        self.learn(piece.encode("utf-8", "surrogatepass") for u in units if SEPARATOR not in u for piece in self.pieces.findall(u))
        rows = [self.unit(u) for u in units]
        flat = np.fromiter((c for r in rows for c in r), np.int32, sum(map(len, rows)))
        return flat, np.fromiter(map(len, rows), np.int64, len(rows))

    def prefix_counts(self, text: str) -> np.ndarray:
        """Tokens of text[:i] for i = 0..len(text)."""
        out, base = [np.zeros(1, np.int64)], 0
        for unit in SPACED_UNIT.findall(text):
            row = np.array(self.unit(unit), np.int64) + base
            out.append(row)
            base = int(row[-1])
        return np.concatenate(out)


def prefix_table(path: str) -> UnitTable:
    return kept_table("prefix counts", path, lambda p: UnitTable(SPACED_UNIT.findall, PrefixCounter(p).compute))


def token_counts(docs: DataFrame, path: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit), fit_chars: the characters of the longest
    prefix of at most limit tokens. All come from the table of prefix counts; whole texts, no shuffle.

    Null and empty texts have 0 bytes and tokens. Repeated rows and null ids stay as they are. Other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = prefix_table(path)
        for batch in batches:
            texts, ids = batch.column(1), batch.column(0)
            size = pc.fill_null(pc.binary_length(texts), 0).cast(pa.int64())
            n, fit = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64)
            for first, chunk in in_chunks(texts.to_pylist()):
                codes, sizes = table.batch(chunk)
                lengths = table.lengths[codes]
                totals = table.flat[table.starts[codes] + lengths - 1]
                n[first : first + len(chunk)] = by_text(totals, sizes)
                ends = np.cumsum(sizes)
                for k, text in enumerate(chunk):
                    if n[first + k] <= limit:
                        fit[first + k] = len(text)
                        continue
                    own = slice(ends[k] - sizes[k], ends[k])
                    reached = np.cumsum(totals[own], dtype=np.int64)
                    u = int(np.searchsorted(reached, limit, "right"))  # the unit within which the limit is passed
                    code, base = codes[own][u], int(reached[u - 1]) if u else 0
                    row = table.flat[table.starts[code] : table.starts[code] + table.lengths[code]]
                    inside = np.flatnonzero(row + base <= limit)
                    fit[first + k] = lengths[own][:u].sum() + (inside[-1] + 1 if len(inside) else 0)
            yield pa.RecordBatch.from_arrays([ids, size, pa.array(n), pa.array(n > limit), pa.array(fit)], names=[id_col, "n_bytes", "n_tokens", "over_limit", "fit_chars"])

    kind = dict(docs.dtypes)[id_col]
    return key_first(docs, id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_bytes long, n_tokens long, over_limit boolean, fit_chars long")
