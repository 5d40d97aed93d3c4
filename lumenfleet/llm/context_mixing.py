"""Log-probabilities of texts by online logistic mixing of context predictors, bit by bit.

A text is its lower-cased words, each closed by a blank, and an end mark. Every word is coded from left to right, byte by byte and bit by
bit. Predictors of a bit are (1) the count of all training words that begin
with the same bits, an exact tree as large as the vocabulary, and (2 to 5) counts in hashed tables whose contexts are the last two, three
and five bytes, and all of the word so far; before its first byte stands one of eight classes of the last byte of the word before it.
Their log-odds are added with weights which a gate chooses by how often the tree has seen the place and by the
place in the word; the weights are learned online, and the sum is refined by an adaptive table from summed to observed odds.

The tree is a table of words, sorted by range: a place in it is a run of neighbours, and what runs over the edge of a block is found from
each block's first and last word. So all that grows with the corpus stays in Spark; the driver sees a few numbers for each block of
words. A word's bits depend on the word and that class alone: each distinct pair is scored once and joined back to its texts by blocks, and
those that begin alike share the work on their beginning. While weights are learned, an occurrence is predicted from all others without itself, as an online coder would.
"""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, staged

#: Longer words are coded in pieces of so many bytes.
PIECE = 32
BLANK, END, ON, LAST = b" ", b"\n", b"\t", b"\r"  # what closes a word, a text, a piece, the last piece of a long word
#: Texts of about so many bytes, or so many distinct keys, make a block, which lists its keys once; long texts go by so many keys.
TEXT_BLOCK, LIST_BLOCK, PART = 32 << 20, 300_000, 1 << 17
#: Words to a block of the tree.
WORD_BLOCK = 1 << 16
WIDE = PIECE + 1
ORDERS = (2, 3, 5, WIDE + 1)
SLOT_BITS = 18
#: Tasks that count into the tables: each sends its slots once.
TABLE_TASKS = 256
GATE_SEEN, GATE_PLACE = (1, 2, 3, 8, 64), (1, 2, 3, 5, 9)
GATES = (len(GATE_SEEN) + 1) * (len(GATE_PLACE) + 1)
BUCKETS = 33
SMALL = 0.4
#: Classes of the byte before a word: its lowest three bits.
CLASSES = 8
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def is_training(doc_id):
    """crc32 of the id as text, modulo 7, is not 2; a null id does not train."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 7 != 2, F.lit(False))


def keys_of(text: bytes) -> Iterator[tuple[bytes, int]]:
    """A text's words, each with the last byte before it. Long words come in pieces, with a close of their own, and once more as END with a
    digest, which stands for the whole word in counts."""
    before = END[0]
    for found in _WORD.finditer(text):
        word = found.group()
        if len(word) <= PIECE:
            yield word, before
        else:
            yield END + hashlib.blake2b(word, digest_size=16).digest(), before
            for at in range(0, len(word), PIECE):
                piece = word[at : at + PIECE]
                yield piece + (ON if at + PIECE < len(word) else LAST), before
                before = piece[-1]
        before = word[-1]
    yield END, before


def closed(word: bytes) -> bytes:
    """A word with its close; ends, pieces and what stands for a long word have their own."""
    return word if word[:1] == END or word[-1:] in (ON, LAST) else word + BLANK


def listed(docs: DataFrame) -> DataFrame:
    """Blocks of texts. kind 0: row (a number for the row of docs), doc_id, train and, in payload, the text's distinct keys (a word's place
    in the block's list, times CLASSES, plus the class) and their counts; a long text may have several, in several blocks. kind 1: a
    word of the block's list: place, word (with its close), n0 to n7 (occurrences in training texts by class, null for a class that no
    text of the block has)."""
    numbers = [f"n{i}" for i in range(CLASSES)]
    schema = "block long, kind int, row long, doc_id long, train boolean, payload binary, place int, word binary, " + ", ".join(f"{k} long" for k in numbers)
    kinds = pa.schema([("block", pa.int64()), ("kind", pa.int32()), ("row", pa.int64()), ("doc_id", pa.int64()), ("train", pa.bool_()), ("payload", pa.binary()), ("place", pa.int32()), ("word", pa.binary()), *[(k, pa.int64()) for k in numbers]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = row = TaskContext.get().partitionId() << 32
        held, places, parts = 0, growing(), []

        def made(kind: int, size: int, **columns) -> pa.RecordBatch:
            columns |= {"block": [block] * size, "kind": [kind] * size}
            return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(size, f.type) for f in kinds], schema=kinds)

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal block, held, places, parts
            n, there = np.zeros(len(places) * CLASSES, np.int64), np.zeros(len(places) * CLASSES, bool)
            for _, _, train, own, count in parts:
                there[own] = True
                if train:
                    n[own] += count
            for at in range(0, len(parts), 1000):
                rows, ids, trains, owns, counts = zip(*parts[at : at + 1000], strict=True)
                yield made(0, len(rows), row=rows, doc_id=ids, train=trains, payload=[as_payload(*x) for x in zip(owns, counts, strict=True)])
            words, n, there = [closed(w) for w in places], n.reshape(-1, CLASSES), there.reshape(-1, CLASSES)
            for at in range(0, len(words), 50_000):
                some = slice(at, at + 50_000)
                of_class = {k: pa.array(n[some, i], mask=~there[some, i]) for i, k in enumerate(numbers)}
                yield made(1, len(words[some]), place=range(at, at + len(words[some])), word=words[some], **of_class)
            block, held, places, parts = block + 1, 0, growing(), []
            pa.default_memory_pool().release_unused()

        for batch in batches:
            for doc_id, text, train in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), batch.column(2).to_pylist(), strict=True):
                raw = (text.as_py() or b"").translate(_LOWER)
                row += 1
                for words, before in key_lists(raw):
                    place = np.fromiter(map(places.__getitem__, words), np.int64, len(words))
                    own, count = np.unique(place * CLASSES + before % CLASSES, return_counts=True)
                    parts.append((row, doc_id, train, own, count))
                    held += 8 * len(words)
                    if held >= TEXT_BLOCK or len(places) >= LIST_BLOCK:
                        yield from flush()
        if parts:
            yield from flush()

    return docs.mapInArrow(run, schema)


def growing() -> defaultdict[bytes, int]:
    """Words to places; a word that is not there gets the next place."""
    places: defaultdict[bytes, int] = defaultdict()
    places.default_factory = places.__len__
    return places


def as_payload(own: np.ndarray, count: np.ndarray) -> bytes:
    """Places and counts, four bytes each, all first bytes first: this packs well."""
    return b"".join(x.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes() for x in (own, count))


def from_payload(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(raw, np.uint8).reshape(2, 4, -1)
    return both[0].T.copy().view("<u4").ravel(), both[1].T.copy().view("<u4").ravel()


def key_lists(raw: bytes) -> Iterator[tuple[list[bytes], np.ndarray]]:
    """A text's words and the bytes before them, in one list, or for long texts in lists of PART."""
    if len(raw) < 1 << 20:
        words = raw.split()  # at the same six characters
        if not words or max(map(len, words)) <= PIECE:  # the usual text
            before = [END[0], *[w[-1] for w in words]]
            words.append(END)
            yield words, np.array(before)
            return
    source = keys_of(raw)
    while some := list(islice(source, PART)):
        words, before = zip(*some, strict=True)
        yield words, np.array(before)


# The tree of words -----------------------------------------------------------------------------------------------------------------

def as_matrix(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Words as rows of WIDE bytes, filled with zeros, and their lengths; those that stand for long words have length 0."""
    lengths = np.array([0 if w[:1] == END and len(w) > 1 else len(w) for w in words], np.int64)
    flat = b"".join((w if n else b"").ljust(WIDE, b"\0") for w, n in zip(words, lengths, strict=True))
    return np.frombuffer(flat, np.uint8).reshape(-1, WIDE), lengths


def path(word: bytes) -> np.ndarray:
    """Its bits, the highest of each byte first."""
    return np.unpackbits(np.frombuffer(word, np.uint8))


def shared_bits(a: bytes, b: bytes) -> int:
    x, y = path(a), path(b)
    n = min(len(x), len(y))
    differ = np.flatnonzero(x[:n] != y[:n])
    return int(differ[0]) if len(differ) else n


def counts_as_token(words: list[bytes]) -> np.ndarray:
    """Words, ends and what stands for long words; pieces don't."""
    return np.array([w[-1:] in (BLANK, END) or w[:1] == END for w in words], bool)


def word_numbers(words: list[bytes]) -> np.ndarray:
    """Sorted words numbered, equal ones alike."""
    return np.cumsum([i > 0 and w != words[i - 1] for i, w in enumerate(words)])


def sorted_blocks(words: DataFrame, size: int = WORD_BLOCK) -> DataFrame:
    """Words with n0 to n7, sorted, as blocks of rows (a word and a class of before) in binary columns, with first and last word and, for the bits of both, how many
    training occurrences of the block begin with them."""
    schema = "block long, first binary, last binary, from_first binary, from_last binary, before binary, words binary, ends binary, n binary, tokens long, distinct long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held, n = TaskContext.get().partitionId() << 32, [], np.zeros((0, CLASSES))

        def one(distinct_words: list[bytes], numbers: np.ndarray) -> pa.RecordBatch:
            nonlocal block
            at, before = np.nonzero(~np.isnan(numbers))
            words, n = [distinct_words[i] for i in at], numbers[at, before].astype(np.int64)
            m, lengths = as_matrix(words)
            real = np.flatnonzero(lengths)
            edge = lambda w: along(m, lengths, n, w) if w else np.zeros(1, np.int64)
            first, last = (words[real[0]], words[real[-1]]) if len(real) else (b"", b"")
            counted = n * counts_as_token(words)
            distinct = int((np.bincount(word_numbers(words), counted) > 0).sum())
            out = [block, first, last, edge(first).tobytes(), edge(last).tobytes(), before.astype(np.uint8).tobytes(), b"".join(words), np.cumsum([len(w) for w in words]).astype(np.int64).tobytes(), n.tobytes(), int(counted.sum()), distinct]
            block += 1
            return pa.RecordBatch.from_arrays([pa.array([v], pa.int64() if isinstance(v, int) else pa.binary()) for v in out], names=names)

        for batch in batches:
            held += batch.column(0).to_pylist()
            n = np.vstack([n, np.column_stack([batch.column(i + 1).cast(pa.float64()).to_numpy(zero_copy_only=False) for i in range(CLASSES)])])
            while len(held) >= 2 * size:
                yield one(held[:size], n[:size])
                held, n = held[size:], n[size:]
        if held:
            yield one(held, n)

    names = [part.split()[0] for part in schema.split(", ")]
    return words.repartitionByRange("word").sortWithinPartitions("word").mapInArrow(run, schema)


def along(m: np.ndarray, lengths: np.ndarray, n: np.ndarray, word: bytes) -> np.ndarray:
    """For 0, 1, 2 ... bits of the word: how many occurrences in the block begin with them."""
    alive, out = np.flatnonzero(lengths), []
    for j, byte in enumerate(word):
        here = m[alive, j]
        out += [n[alive[here >> (8 - k) == byte >> (8 - k)]].sum() for k in range(8)]
        alive = alive[(here == byte) & (lengths[alive] > j)]
    return np.array([*out, n[alive].sum()], np.int64)


def edges(summaries: list) -> dict[int, tuple[bytes, np.ndarray, bytes, np.ndarray]]:
    """By block: (first word, what blocks before hold of its bits, last word, what blocks after hold of its bits)."""
    order = [r for r in sorted(summaries, key=lambda r: r["block"]) if r["first"]]

    def carried(blocks: list, near: str, far: str) -> dict[int, np.ndarray]:
        """What the blocks that went by hold of each block's near word, by bits."""
        found, went, held = {}, b"", np.zeros(1, np.int64)
        for r in blocks:
            common = shared_bits(went, r[near]) if went else 0
            extra = np.zeros(8 * len(r[near]) + 1, np.int64)
            extra[: common + 1] = held[: common + 1]
            found[r["block"]] = np.trim_zeros(extra, "b")
            own = np.frombuffer(r[f"from_{far}"], np.int64).copy()
            both = shared_bits(r["first"], r["last"]) + 1
            own[:both] += extra[:both]
            went, held = r[far], own
        return found

    left, right = carried(order, "first", "last"), carried(order[::-1], "last", "first")
    return {r["block"]: (r["first"], left[r["block"]], r["last"], right[r["block"]]) for r in order}


def rows_of(batch: pa.RecordBatch) -> Iterator[dict]:
    """One row of binary columns at a time."""
    for r in range(len(batch)):
        yield batch.slice(r, 1).to_pylist()[0]


class Block:
    """A block's words, and for the bits of each in turn the counts that predictors have there."""

    def __init__(self, row: dict, edge: tuple | None):
        ends = np.frombuffer(row["ends"], np.int64)
        raw = row["words"]
        self.words = [raw[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]
        self.before, self.n = np.frombuffer(row["before"], np.uint8), np.frombuffer(row["n"], np.int64)
        self.m, self.lengths = as_matrix(self.words)
        self.edge = edge or (b"", np.zeros(0, np.int64), b"", np.zeros(0, np.int64))

    def beyond(self, j: int, k: int, rows: np.ndarray) -> np.ndarray | int:
        """What other blocks hold of the first 8 j + k bits of the rows."""
        out = 0
        for word, extra in ((self.edge[0], self.edge[1]), (self.edge[2], self.edge[3])):
            if 8 * j + k < len(extra):
                same = np.ones(len(rows), bool)
                for i in range(j):
                    same &= self.m[rows, i] == word[i]
                if k:
                    same &= self.m[rows, j] >> (8 - k) == word[j] >> (8 - k)
                out = out + same * extra[8 * j + k]
        return out

    def bytes_in_turn(self) -> Iterator[tuple]:
        """For each place in words, the beginnings that end there, by class, each once: (place, a row of each, the place before's beginning of
        each, training occurrences in the block, what the tree counts for 0 to 8 bits of the last byte: 9 by beginnings, rows that have
        a byte there and the beginning of each). Rows are sorted: words that begin alike are neighbours."""
        alive = np.flatnonzero(self.lengths)
        run = np.zeros(len(alive), np.int64)
        _, own = np.unique(self.before[alive], return_inverse=True)
        total = np.array([self.n[alive].sum()]) + self.beyond(0, 0, alive[:1])
        for j in range(WIDE):
            have = self.lengths[alive] > j
            alive, run, own = alive[have], run[have], own[have]
            if not len(alive):
                return
            byte, n = self.m[alive, j], self.n[alive]
            starts = np.flatnonzero(np.append(True, (run[1:] != run[:-1]) | (byte[1:] != byte[:-1])))
            rows, before = alive[starts], run[starts]
            mine = np.add.reduceat(n, starts)
            counts = np.empty((9, len(rows)), np.int64)
            counts[0], counts[8] = total[before], mine + self.beyond(j, 8, rows)
            parted, last = before[1:] != before[:-1], byte[starts]
            for k in range(1, 8):
                bits = last >> (8 - k)
                first = np.flatnonzero(np.append(True, parted | (bits[1:] != bits[:-1])))
                counts[k] = np.repeat(np.add.reduceat(mine, first), np.diff(np.append(first, len(rows)))) + self.beyond(j, k, rows)
            run = np.repeat(np.arange(len(rows)), np.diff(np.append(starts, len(alive))))
            total = counts[8]
            code = run * CLASSES + self.before[alive]
            first = np.full(len(rows) * CLASSES, -1)
            first[code[::-1]] = np.arange(len(code) - 1, -1, -1)
            at, mixed_own = first[first >= 0], (np.cumsum(first >= 0) - 1)[code]
            yield j, alive[at], own[at], np.bincount(mixed_own, n).astype(np.int64), counts[:, run[at]], alive, mixed_own
            own = mixed_own


def contexts(block: Block, j: int, rows: np.ndarray) -> np.ndarray:
    """Hashes of the last bytes before the place, as many as each order says: by order and row. Before a word's first byte stands the
    class, and zeros before it."""
    out = np.empty((len(ORDERS), len(rows)), np.uint64)
    h = np.zeros(len(rows), np.uint64)
    for i in range(1, j + 2):
        byte = block.m[rows, j - i] if j >= i else block.before[rows]
        h = (h * np.uint64(0x9E3779B97F4A7C15) + byte + np.uint64(i)) ^ (h >> np.uint64(29))
        for o in range(len(ORDERS)):
            if i == min(ORDERS[o], j + 1):
                out[o] = (h ^ (h >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15) * np.uint64(2 * o + 1)
    return out


def slots(context: np.ndarray, byte: np.ndarray, k: int) -> np.ndarray:
    """The slot of the first k bits of the byte in each order's table."""
    node = (np.uint64(1 << k) | (byte >> (8 - k)).astype(np.uint64)) if k else np.uint64(1)
    return ((context + node * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


def table_counts(blocks: DataFrame) -> np.ndarray:
    """How often training words pass each slot: orders x slots. Its size is fixed; counts are added up by slot in Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(ORDERS), 1 << SLOT_BITS), np.int64)
        for batch in batches:
            for row in rows_of(batch):
                block = Block(row, None)
                for j, rows, _, n, *_ in block.bytes_in_turn():
                    rows, n = rows[n > 0], n[n > 0]
                    context, byte = contexts(block, j, rows), block.m[rows, j]
                    for k in range(9):
                        at = slots(context, byte, k)
                        for o in range(len(ORDERS)):
                            np.add.at(total[o], at[o], n)
        flat = total.ravel()
        used = np.flatnonzero(flat)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(flat[used])], names=["slot", "n"])

    got = blocks.select("before", "words", "ends", "n").coalesce(TABLE_TASKS).mapInArrow(run, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n"))
    found = np.zeros(len(ORDERS) << SLOT_BITS, np.float32)
    for r in got.toLocalIterator():
        found[r["slot"]] = r["n"]
    return found.reshape(len(ORDERS), -1)


# Mixing ----------------------------------------------------------------------------------------------------------------------------


def bits_of(block: Block, tables: np.ndarray, leave_out: bool) -> Iterator[tuple]:
    """For each place, (rows, before, occurrences, alive, run) of bytes_in_turn and, for each of 8 bits: the bit, log-odds of the true bit by
    predictor, gate. With leave_out, only training occurrences come, and one is taken from all counts."""
    less, flat, orders = np.float32(leave_out), tables.ravel(), np.arange(len(ORDERS))[:, None] << SLOT_BITS
    for j, rows, before, n, tree, alive, run in block.bytes_in_turn():
        if leave_out:
            have = n > 0
            rows, before, n, tree = rows[have], before[have], n[have], tree[:, have]
            if not len(rows):
                continue
        context, byte, tree = contexts(block, j, rows), block.m[rows, j], tree.astype(np.float32)
        place = int(np.searchsorted(GATE_PLACE, j, "right"))
        seen = np.vstack([tree[:1], flat.take(slots(context, byte, 0) + orders)]) - less
        bits = []
        for k in range(8):
            right = np.vstack([tree[k + 1][None], flat.take(slots(context, byte, k + 1) + orders)]) - less
            odds = np.log((np.maximum(right, 0) + np.float32(SMALL)) / (np.maximum(seen - right, 0) + np.float32(SMALL)))
            bits.append((byte >> (7 - k) & 1, odds, sum((seen[0] >= least).astype(np.int64) for least in GATE_SEEN) * (len(GATE_PLACE) + 1) + place))
            seen = right
        yield (rows, before, n, alive, run), bits


def learned(blocks: DataFrame, tables, known, weights: np.ndarray, rate: float) -> np.ndarray:
    """One pass over all training words: each task goes on online from the same weights, its results are averaged by bits seen."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, seen, power = weights.copy(), np.zeros(GATES), np.full(GATES, 1e-9)
        for batch in batches:
            for row in rows_of(batch):
                block = Block(row, known.value.get(row["block"]))
                for (_, _, n, _, _), bits in bits_of(block, tables.value, True):
                    for _, st, g in bits:
                        right = 1 / (1 + np.exp(-np.clip(np.einsum("ij,ji->i", w[g], st), -30, 30)))
                        wrong, norm = n * (1 - right), n * (st * st).sum(0)
                        # A gate's step is scaled by the recent power of its inputs, so that its size follows neither counts nor block sizes.
                        power = 0.98 * power + np.bincount(g, norm, GATES)
                        w += 4 * rate * np.column_stack([np.bincount(g, wrong * x, GATES) for x in st]) / power[:, None]
                        seen += np.bincount(g, n, GATES)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(GATES), pa.int32()), pa.array(seen), pa.array(list(w * seen[:, None]), pa.list_(pa.float64()))], names=["gate", "seen", "w"])

    parts = blocks.mapInArrow(run, "gate int, seen double, w array<double>")
    sums = parts.groupBy("gate").agg(F.sum("seen").alias("seen"), *[F.sum(F.col("w")[i]).alias(f"w{i}") for i in range(weights.shape[1])]).collect()
    out = weights.copy()
    for r in sums:
        if r["seen"] > 0:
            out[r["gate"]] = [r[f"w{i}"] / r["seen"] for i in range(weights.shape[1])]
    return out


def bucket(odds_of_one: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(odds_of_one * 2), -(BUCKETS // 2), BUCKETS // 2).astype(np.int64) + BUCKETS // 2


def mixed(odds: np.ndarray, gate: np.ndarray, bit: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log-odds of the true bit, and the place of the odds of a one in the refining table."""
    st = np.clip(np.einsum("ij,ji->i", weights[gate], odds), -20, 20)
    return st, bucket(np.where(bit == 1, st, -st)) * GATES + gate


def refined(st: np.ndarray, at: np.ndarray, bit: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Natural logarithm of the probability of the true bit: the mean, in log-odds, of the mixed and the refined prediction."""
    one = table[at]
    st = (st + np.where(bit == 1, one, -one)) / 2
    return -np.logaddexp(0, -st)


def refining(blocks: DataFrame, tables, known, weights: np.ndarray) -> np.ndarray:
    """Observed log-odds of a one by mixed log-odds and gate, over all training words; drawn to the mixed odds where little was seen."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, BUCKETS * GATES))
        for batch in batches:
            for row in rows_of(batch):
                block = Block(row, known.value.get(row["block"]))
                for (_, _, n, _, _), bits in bits_of(block, tables.value, True):
                    for bit, odds, gate in bits:
                        _, at = mixed(odds, gate, bit, weights)
                        total[0] += np.bincount(at, n * (bit == 1), BUCKETS * GATES)
                        total[1] += np.bincount(at, n, BUCKETS * GATES)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(BUCKETS * GATES), pa.int32()), pa.array(total[0]), pa.array(total[1])], names=["at", "ones", "all"])

    middle = np.repeat((np.arange(BUCKETS) - BUCKETS // 2) / 2, GATES)
    p, ones, every = 1 / (1 + np.exp(-middle)), np.zeros(len(middle)), np.zeros(len(middle))
    for r in blocks.mapInArrow(run, "at int, ones double, all double").groupBy("at").agg(F.sum("ones").alias("ones"), F.sum("all").alias("all")).collect():
        ones[r["at"]], every[r["at"]] = r["ones"], r["all"]
    drawn = 50.0
    return np.log((ones + drawn * p) / (every - ones + drawn * (1 - p)))


def scored(blocks: DataFrame, tables, known, weights: np.ndarray, table: np.ndarray) -> DataFrame:
    """key (a 64-bit hash of the word), scores (log10 of its probability, after each class of before that turned up, as floats), c (its
    occurrences; null for pieces), kind (a bit for each of those classes, and above them the bytes coded). What stands for a long word scores 0, its pieces
    have no count."""
    schema = "word binary, scores binary, c long, kind int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in rows_of(batch):
                block = Block(row, known.value.get(row["block"]))
                score, total = np.zeros(len(block.words)), np.zeros(CLASSES)
                for (_, before, _, alive, runs), bits in bits_of(block, tables.value, False):
                    total = total[before]
                    for bit, odds, gate in bits:
                        total += refined(*mixed(odds, gate, bit, weights), bit, table)
                    score[alive] = total[runs]
                which = word_numbers(block.words)
                first = np.flatnonzero(np.diff(which, prepend=-1))
                words = [block.words[i] for i in first]
                ends = np.append(first, len(which))
                score = (score / np.log(10)).astype(np.float32)
                scores = [score[a:b].tobytes() for a, b in zip(ends, ends[1:], strict=False)]
                classes = np.add.reduceat(1 << block.before.astype(np.int32), first)
                c = pa.array(np.add.reduceat(block.n, first), mask=~counts_as_token(words))
                yield pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array(scores, pa.binary()), c, pa.array(classes | block.lengths[first] << CLASSES, pa.int32())], names=["word", "scores", "c", "kind"])

    return blocks.mapInArrow(run, schema).select(F.xxhash64("word").alias("key"), "scores", "c", "kind")


def language_model_scores(docs: DataFrame, rounds: int = 2, id_col: str = "doc_id", text_col: str = "text", word_block: int = WORD_BLOCK) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes and bits_per_byte of every row.

    Null texts count as empty: an end mark alone. White space only parts words. Rows with a null id are scored, count as held out and
    don't train; repeated rows train and are scored each for itself. A table without training rows scores all by the same rules with
    no counts. An empty table gives an empty result. Words of more than 32 bytes are coded in pieces; in base counts they are known by
    a 128-bit digest; scores find their way back to texts by 64-bit hashes of words. n_bytes are those of the coded words with a blank after each and one for the end. Further columns are ignored.
    """
    spark = docs.sparkSession
    own = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"), is_training(docs[id_col].cast("long")).alias("train"))
    lists = staged(listed(own), "lists", compression="zstd")
    entries = lists.filter("kind = 1").select("block", "place", "word", *[f"n{i}" for i in range(CLASSES)])
    words = entries.groupBy("word").agg(*[F.sum(f"n{i}").alias(f"n{i}") for i in range(CLASSES)])
    blocks = staged(sorted_blocks(words, word_block), "words")
    summaries = blocks.select("block", "first", "last", "from_first", "from_last", "tokens", "distinct").collect()
    tokens, distinct = (sum(r[k] for r in summaries) for k in ("tokens", "distinct"))
    known = spark.sparkContext.broadcast(edges(summaries))
    tables = spark.sparkContext.broadcast(table_counts(blocks))
    weights = np.full((GATES, 1 + len(ORDERS)), 0.3)
    for i in range(rounds):
        weights = learned(blocks, tables, known, weights, 1 / (1 + i))
    table = refining(blocks, tables, known, weights)
    words_scored = staged(scored(blocks, tables, known, weights, table), "scored")
    dropped(blocks)
    found = entries.select(F.col("block").alias("in_block"), "place", F.xxhash64("word").alias("key")).join(words_scored, "key")
    found = found.select("in_block", (F.shiftleft(F.col("place").cast("long"), 16) + F.col("kind")).alias("place_kind"), "scores", "c")
    texts = lists.filter("kind = 0").select("block", "row", "doc_id", "train", "payload")
    schema = "row long, doc_id long, train boolean, n_tokens long, n_known long, base_score double, score double, n_bytes long"
    names = [part.split()[0] for part in schema.split(", ")]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        place_kind, c = right.column("place_kind").to_numpy(), right.column("c").fill_null(-1).to_numpy()
        place, token = place_kind >> 16, c >= 0
        m = int(place.max(initial=-1)) + 1
        at, own_class = np.nonzero(place_kind[:, None] >> np.arange(CLASSES) & 1)
        of_pair, of_word = np.zeros(m * CLASSES, np.float32), np.zeros((4, m))
        of_pair[place[at] * CLASSES + own_class] = np.frombuffer(b"".join(right.column("scores").to_pylist()), np.float32)
        of_word[:, place] = [np.where(token, np.log10((np.maximum(c, 0) + 1) / (tokens + distinct + 1)), 0), token, c > 0, place_kind >> CLASSES & 0xFF]
        sums = []
        for payload in left.column("payload"):
            own, count = from_payload(payload.as_py())
            sums.append([of_pair[own] @ count.astype(np.float64), *(of_word[:, own // CLASSES] @ count)])
        score, base, token, known, size = np.array(sums).reshape(-1, 5).T
        whole = lambda v: pa.array(np.rint(v).astype(np.int64))
        return pa.table([left.column("row"), left.column("doc_id"), left.column("train"), whole(token), whole(known), pa.array(base), pa.array(score), whole(size)], names=names)

    got = texts.groupBy("block").cogroup(found.groupBy("in_block")).applyInArrow(run, schema)
    # A long text's parts come together again; all others have one.
    got = got.groupBy("row").agg(*[F.first(k).alias(k) for k in ("doc_id", "train")], *[F.sum(k).alias(k) for k in ("n_tokens", "n_known", "base_score", "score", "n_bytes")])
    return got.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), "base_score", "score", "n_bytes", (-F.col("score") / F.lit(np.log10(2)) / F.col("n_bytes")).alias("bits_per_byte"))
