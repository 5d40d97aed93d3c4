"""N-gram Jaccard join: links between documents whose sets of five-word shingles are similar, and their components.

Sets are arrays of 64-bit hashes. Work goes in four steps, each exact about what it leaves out:

1. Sieve. Shingles are ordered by hash; a set's first n - ceil(0.75 n) + l of them, l = a share of n, must meet another set's in at
   least 0.75 l places. Hashes are dealt by bucket in binary blocks, and sets that share too few are done.
2. Groups. The others form groups: each set meets one set with the same minimal hash, the pair is verified, and verified links are
   contracted. A group is connected, so links inside it need no search.
3. Token-group matrix. For each token it is known whether two groups hold it. A set of which too few tokens lie in other groups'
   unions can have no link across groups; those that may form groups again from other hashes, as long as that merges many.
4. Open. What is left is cut into blocks of neighbours, the groups of the last matrix, whose rows are 64-bit masks over blocks. A set's
   overlap with each block's union is counted from them, and it is compared with the members of those blocks alone that hold 0.75 of
   it and a set of another group.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from .common import delete, dropped, key_first, scratch, staged
from .components import components
from .units import forget_tables, in_chunks

WORDS = 5
#: Similarity in hundredths.
SIMILAR = 75
SIEVE_SHARE = 0.1
#: Rounds of grouping go on while one merges at least a tenth of the groups, and end after so many.
STAR_ROUNDS = 6
#: Sets to a block of the last step.
BLOCK = 256
#: Ids to a broadcast at most (16 bytes each); with more, the join shuffles.
MOST_BROADCAST = 1_000_000
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3], np.uint64)
NO_ROW = 0xFFFF
#: Hashes to a chunk of the sieve: large, so that a chunk's blocks stay large where there are many buckets.
CHUNK_HASHES = 1_000_000
#: Blocks to a mask of the last matrix.
MASK = 64
#: Sets to a share of the counts that are added up in one task.
SHARE_SETS = 20_000
#: Tokens of one set that are looked up at once.
SLICE = 16_384
#: Sets that meet a block at once, on average; a block travels once for so many.
ASKING = 4096


def mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * _ODD[5]
    x = x ^ (x >> np.uint64(29))
    x = x * _ODD[6]
    return x ^ (x >> np.uint64(32))


def shingle_sets(texts: list[str]) -> list[np.ndarray]:
    """Each text's distinct shingles as ascending 64-bit hashes: five words each, or all words of a text with fewer; A-Z lower-cased."""
    import xxhash

    words = [t.encode("utf-8", "surrogatepass").lower().split() for t in texts]
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, chain.from_iterable(words)), np.uint64, int(sizes.sum()))
    rolled = np.zeros(0, np.uint64)
    if len(h) >= WORDS:
        rolled = h[: len(h) - WORDS + 1] * _ODD[0]
        for k in range(1, WORDS):
            rolled = rolled + h[k : len(h) - WORDS + 1 + k] * _ODD[k]
        rolled = mixed(rolled)
    out, at = [], 0
    for own, n in zip(words, sizes.tolist(), strict=True):
        if n >= WORDS:
            out.append(np.unique(rolled[at : at + n - WORDS + 1]))
        elif n:
            out.append(np.array([xxhash.xxh3_64_intdigest(b" ".join(own), seed=n)], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
        at += n
    return out


def set_id(hashes: np.ndarray) -> int:
    import xxhash

    return int(np.array(xxhash.xxh3_64_intdigest(hashes.tobytes(), seed=len(hashes)), np.uint64).view(np.int64))


def prefix_size(n, share: float):
    """How many of a set's first hashes are looked at: n - ceil(0.75 n) + ceil(share n)."""
    return np.minimum(n, n - -(-SIMILAR * n // 100) + np.ceil(share * n).astype(np.int64))


def must_share(n, share: float):
    """How many of them every similar set shares: it has 0.75 n hashes at least, and so 0.75 share n in its own first ones."""
    return np.maximum(1, np.floor(share * SIMILAR / 100 * n - 1e-6).astype(np.int64))


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    both = np.concatenate([a, b])
    both.sort()
    common = int((both[1:] == both[:-1]).sum())
    return 100 * common >= SIMILAR * (len(a) + len(b) - common)


SIEVE = "kind int, {key}n long, set_id long, chunk long, row int, bucket int, blob binary"


def counted(rows: np.ndarray) -> bytes:
    """How often each 16-bit row occurs, as sparse pairs: the rows, then their numbers."""
    own, n = np.unique(rows, return_counts=True)
    return own.astype(np.uint16).tobytes() + n.astype(np.uint32).tobytes()


def _dealt(keys: np.ndarray, rows: np.ndarray, buckets: int) -> Iterator[tuple[int, bytes]]:
    """(bucket, block): 32 bits of each hash and the 16-bit row that it counts for."""
    b = (keys % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(b, kind="stable")
    short = (keys >> np.uint64(16)).astype(np.uint32)[order]
    rows = rows.astype(np.uint16)[order]
    cuts = np.searchsorted(b[order], np.arange(buckets + 1))
    for k in range(buckets):
        if cuts[k] < cuts[k + 1]:
            own = slice(cuts[k], cuts[k + 1])
            yield k, short[own].tobytes() + rows[own].tobytes()


def sieve(docs: DataFrame, buckets: int, id_col: str, text_col: str) -> DataFrame:
    """One row per document: id, n, set_id and may_link: whether enough of its first hashes occur in other documents."""
    kind = dict(docs.dtypes)[id_col]
    spark = docs.sparkSession

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_tables()
        part, count = TaskContext.get().partitionId(), 0
        ids, n, names, rows, keys, of = [], [], [], [], [], []
        known: dict[int, int] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            number = (part << 32) + count
            whole = pa.concat_arrays(ids)
            yield table(0, whole, n, names, [number] * len(n), rows, [None] * len(n), [None] * len(n))
            if keys:
                flat, owner = np.concatenate(keys), np.concatenate(of)
                order = np.argsort(flat, kind="stable")
                flat, owner = flat[order], owner[order]
                new = np.concatenate([[True], flat[1:] != flat[:-1]])
                many = ~new | np.concatenate([~new[1:], [False]])  # shared within this chunk already
                yield table(2, pa.nulls(1, whole.type), [0], [0], [number], [0], [None], [counted(owner[many])])
                blocks = list(_dealt(flat[new], np.where(many, NO_ROW, owner)[new], buckets))
                m = len(blocks)
                yield table(1, pa.nulls(m, whole.type), [0] * m, [0] * m, [number] * m, [0] * m, [k for k, _ in blocks], [x for _, x in blocks])
            for held in (ids, n, names, rows, keys, of):
                held.clear()
            known.clear()

        hashes = 0
        for batch in batches:
            for first, texts in in_chunks(batch.column(1).to_pylist()):
                for cut in range(0, len(texts), 4096):
                    sets = shingle_sets(texts[cut : cut + 4096])
                    if len(n) + len(sets) >= NO_ROW or hashes > CHUNK_HASHES:
                        yield from flush()
                        count, hashes = count + 1, 0
                    ids.append(batch.column(0).slice(first + cut, len(sets)))
                    for x in sets:
                        name, row = (set_id(x), len(n)) if len(x) else (0, -1)
                        if len(x):
                            row = known.setdefault(name, row)
                            if row == len(n):
                                size = int(prefix_size(len(x), SIEVE_SHARE))
                                keys.append(x[:size].copy())
                                of.append(np.full(size, row, np.uint16))
                                hashes += size
                        n.append(len(x))
                        names.append(name)
                        rows.append(row)
        if n:
            yield from flush()

    def table(kind_: int, ids, n, names, chunks, rows, bucket, blobs) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([kind_] * len(n), pa.int32()), ids, pa.array(n, pa.int64()), pa.array(names, pa.int64()), pa.array(chunks, pa.int64()), pa.array(rows, pa.int32()), pa.array(bucket, pa.int32()), pa.array(blobs, pa.binary())],
            names=["kind", id_col, "n", "set_id", "chunk", "row", "bucket", "blob"],
        )

    path = scratch(spark, "sieve")
    key_first(docs, id_col, text_col).mapInArrow(read, SIEVE.format(key=f"`{id_col}` {kind}, ")).write.partitionBy("kind").parquet(path)
    found = spark.read.schema(SIEVE.format(key=f"`{id_col}` {kind}, ")).parquet(path)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, of, chunks = [], [], []
        for batch in batches:
            for b, c, raw in zip(*[batch.column(i).to_pylist() for i in range(3)], strict=True):
                m = len(raw) // 6
                keys.append(np.frombuffer(raw, np.uint32, m).astype(np.uint64) | np.uint64(b) << np.uint64(32))
                of.append(np.frombuffer(raw, np.uint16, m, 4 * m))
                chunks.append((c, m))
        if not keys:
            return
        flat = np.concatenate(keys)
        order = np.argsort(flat, kind="stable")
        flat = flat[order]
        same = np.concatenate([[False], flat[1:] == flat[:-1]])
        many = np.zeros(len(flat), bool)
        many[order] = same | np.concatenate([same[1:], [False]])
        at = 0
        own: dict[int, list[np.ndarray]] = {}
        for (c, m), rows in zip(chunks, of, strict=True):
            hit = rows[many[at : at + m]]
            own.setdefault(c, []).append(hit[hit != NO_ROW])
            at += m
        blobs = [(c, counted(np.concatenate(v))) for c, v in own.items()]
        yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in blobs], pa.int64()), pa.array([x for _, x in blobs], pa.binary())], names=["chunk", "blob"])

    def add(rows: pa.Table) -> pa.Table:
        total = np.zeros(NO_ROW + 1, np.int64)
        for raw in rows.column("blob").to_pylist():
            m = len(raw) // 6
            total[np.frombuffer(raw, np.uint16, m)] += np.frombuffer(raw[2 * m :], np.uint32)
        hit = np.flatnonzero(total)
        return pa.table({"chunk": pa.array(np.full(len(hit), rows.column("chunk")[0].as_py()), pa.int64()), "row": pa.array(hit, pa.int32()), "shared": pa.array(total[hit], pa.int64())})

    met = found.filter("kind = 1").select("bucket", "chunk", "blob").repartition(buckets, "bucket").mapInArrow(meet, "chunk long, blob binary")
    vectors = met.unionByName(found.filter("kind = 2").select("chunk", "blob"))
    shared = staged(vectors.groupBy("chunk").applyInArrow(add, "chunk long, row int, shared long"), "shared")
    need = F.greatest(F.lit(1), F.floor(F.lit(SIEVE_SHARE * SIMILAR / 100) * F.col("n") - 1e-6))
    rows = found.filter("kind = 0").select(id_col, "n", "set_id", "chunk", "row")
    judged = rows.join(shared, ["chunk", "row"], "left").select(id_col, "n", "set_id", (F.coalesce("shared", F.lit(0)) >= need).alias("may_link"))
    judged = staged(judged, "sieved")
    dropped(shared)
    delete(spark, path)
    return judged


def sets_of(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """set_id, n, hashes (binary) of the wanted documents (id, set_id), one row for each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            expected = batch.column(1).to_pylist()
            for first, texts in in_chunks(batch.column(0).to_pylist()):
                sets = shingle_sets(texts)
                kept = [(e, s) for e, s in zip(expected[first : first + len(texts)], sets, strict=True) if len(s) and e in (None, set_id(s))]
                kept = [(set_id(s) if e is None else e, s) for e, s in kept]
                yield pa.RecordBatch.from_arrays([pa.array([e for e, _ in kept], pa.int64()), pa.array([len(s) for _, s in kept], pa.int64()), pa.array([s.tobytes() for _, s in kept], pa.binary())], names=["set_id", "n", "hashes"])

    rows = key_first(docs, id_col, text_col)
    own = wanted.filter(F.col(id_col).isNotNull()).select(F.col(id_col).alias("w_id"), F.col("set_id").alias("w_set"))
    side = F.broadcast(own) if own.count() <= MOST_BROADCAST else own
    known = rows.join(side, F.col(id_col) == F.col("w_id")).select(text_col, "w_set")
    # Rows without an id can't be asked for by id: all their sets are made, and the wanted ones kept.
    nameless = rows.filter(F.col(id_col).isNull()).select(text_col, F.lit(None).cast("long").alias("w_set"))
    shape = "set_id long, n long, hashes binary"
    sets = known.mapInArrow(run, shape)
    more = nameless.mapInArrow(run, shape).join(wanted.filter(F.col(id_col).isNull()).select("set_id"), "set_id", "left_semi")
    return staged(sets.unionByName(more), "sets")


def with_set_ids(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with set_id, as ngram_components has it; 0 for texts without words."""
    where = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in in_chunks(batch.column(where).to_pylist()):
                names = pa.array([set_id(s) if len(s) else 0 for s in shingle_sets(texts)], pa.int64())
                rows = batch.slice(first, len(texts))
                yield pa.RecordBatch.from_arrays([*rows.columns, names], names=[*batch.schema.names, "set_id"])

    return docs.mapInArrow(run, ", ".join(f"`{name}` {kind}" for name, kind in docs.dtypes) + ", set_id long")


def verified(sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) of set ids that are similar. Few pairs go to the sets, so that only the first sets of pairs travel, and the second ones once."""
    few = pairs.count() <= MOST_BROADCAST
    firsts, seconds = (pairs, pairs.select("b").distinct())
    x = sets.select(F.col("set_id").alias("a"), F.col("hashes").alias("h_a")).join(F.broadcast(firsts) if few else firsts, "a")
    y = sets.select(F.col("set_id").alias("b"), F.col("hashes").alias("h_b")).join(F.broadcast(seconds) if few else seconds, "b")
    rows = x.join(y, "b").select("a", "b", "h_a", "h_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (batch.column(i).to_pylist() for i in (0, 1))
            last, right = None, None
            kept = []
            for i in range(len(a)):
                if b[i] != last:
                    last, right = b[i], np.frombuffer(batch.column(3)[i].as_py(), np.uint64)
                if similar(np.frombuffer(batch.column(2)[i].as_py(), np.uint64), right):
                    kept.append(i)
            yield pa.RecordBatch.from_arrays([pa.array([a[i] for i in kept], pa.int64()), pa.array([b[i] for i in kept], pa.int64())], names=["a", "b"])

    return staged(rows.mapInArrow(run, "a long, b long"), "links")


def star_pairs(sets: DataFrame, seed: int) -> DataFrame:
    """(a, b): each set with the first set, in an order of the round's own, among those with the same minimal hash of the round;
    only pairs whose sizes let them be similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salt = mixed(_ODD[:1] + np.uint64(seed))
        for batch in batches:
            keys = [int(mixed(np.frombuffer(raw, np.uint64) ^ salt).min()) for raw in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.array(keys, np.uint64).view(np.int64))], names=["a", "n", "key"])

    keyed = staged(sets.select("set_id", "n", "hashes").mapInArrow(run, "a long, n long, key long"), "stars")
    leaders = keyed.groupBy("key").agg(F.min_by(F.struct("a", "n"), F.xxhash64("a", F.lit(seed))).alias("b"), F.count(F.lit(1)).alias("m")).filter("m > 1")
    leaders = staged(leaders.select("key", F.col("b.a").alias("b"), F.col("b.n").alias("n_b")), "leaders")
    near = 100 * F.least("n", "n_b") >= SIMILAR * F.greatest("n", "n_b")
    pairs = staged(keyed.join(leaders, "key").filter((F.col("a") != F.col("b")) & near).select("a", "b"), "pairs")
    dropped(keyed, leaders)
    return pairs


def across_groups(grouped: DataFrame, buckets: int, share: float | None) -> DataFrame:
    """The token-group matrix at work: ids of those sets (set_id, n, hashes, label) of whose hashes enough lie in the unions of other groups.

    With share, the first hashes of each set are looked at as in the sieve; without, all are, and 0.75 of them must lie there.
    """
    shares = max(1, -(-grouped.count() // SHARE_SETS))
    looked_at = (lambda n: n) if share is None else (lambda n: prefix_size(n, share))

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Matrix cells (token, group, set) of a batch of sets, dealt by token: 32 bits of each token beside its bucket."""
        for batch in batches:
            size = looked_at(np.array(batch.column(1).to_pylist(), np.int64))
            sets = [np.frombuffer(raw, np.uint64)[:m] for raw, m in zip(batch.column(2).to_pylist(), size, strict=True)]
            if not sets:
                continue
            keys = np.concatenate(sets)
            b = (keys % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(b, kind="stable")
            short = (keys >> np.uint64(16)).astype(np.uint32)[order]
            name, group = (np.repeat(np.array(batch.column(i).to_pylist(), np.int64), size)[order] for i in (0, 3))
            cuts = np.searchsorted(b[order], np.arange(buckets + 1))
            spans = [(k, slice(cuts[k], cuts[k + 1])) for k in range(buckets) if cuts[k] < cuts[k + 1]]
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in spans], pa.int32()), *[pa.array([x[s].tobytes() for _, s in spans], pa.binary()) for x in (short, group, name)]], names=["bucket", "tokens", "groups", "sets"])

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For each set, how many of these buckets' tokens another group holds too: one row of sparse numbers for each share of the sets."""
        keys, group, name = [], [], []
        for batch in batches:
            for b, t, g, s in zip(*[batch.column(i).to_pylist() for i in range(4)], strict=True):
                keys.append(np.frombuffer(t, np.uint32).astype(np.uint64) | np.uint64(b) << np.uint64(32))
                group.append(np.frombuffer(g, np.int64))
                name.append(np.frombuffer(s, np.int64))
        if not keys:
            return
        keys, group, name = np.concatenate(keys), np.concatenate(group), np.concatenate(name)
        order = np.argsort(keys, kind="stable")
        keys, group, name = keys[order], group[order], name[order]
        starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        open_ = np.minimum.reduceat(group, starts) != np.maximum.reduceat(group, starts)
        hit, n = np.unique(name[np.repeat(open_, np.diff(starts, append=len(keys)))], return_counts=True)
        share_of = (hit.view(np.uint64) % np.uint64(shares)).astype(np.int64)
        for k in np.unique(share_of):
            own = share_of == k
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([hit[own].tobytes() + n[own].astype(np.uint32).tobytes()], pa.binary())], names=["share", "blob"])

    def add(rows: pa.Table) -> pa.Table:
        raw = [(b, len(b) // 12) for b in rows.column("blob").to_pylist()]
        name, at = np.unique(np.concatenate([np.frombuffer(b, np.int64, m) for b, m in raw]), return_inverse=True)
        total = np.bincount(at, np.concatenate([np.frombuffer(b[8 * m :], np.uint32) for b, m in raw]))
        return pa.table({"set_id": pa.array(name), "shared": pa.array(total.astype(np.int64))})

    matrix = grouped.select("set_id", "n", "hashes", "label").mapInArrow(cells, "bucket int, tokens binary, groups binary, sets binary")
    hits = matrix.repartition(buckets, "bucket").mapInArrow(shared, "share long, blob binary").groupBy("share").applyInArrow(add, "set_id long, shared long")
    rate = SIMILAR / 100 if share is None else share * SIMILAR / 100
    need = F.greatest(F.lit(1), F.ceil(F.lit(rate) * F.col("n") - 1e-6) if share is None else F.floor(F.lit(rate) * F.col("n") - 1e-6))
    return staged(grouped.select("set_id", "n").join(hits, "set_id").filter(F.col("shared") >= need).select("set_id"), "passed")


def only(sets: DataFrame, ids: DataFrame) -> DataFrame:
    """The sets with these ids."""
    return sets.join(F.broadcast(ids) if ids.count() <= MOST_BROADCAST else ids, "set_id", "left_semi")


def labelled(sets: DataFrame, labels: DataFrame) -> DataFrame:
    """The sets with the label of their component; sets without links are their own."""
    groups = labels.select(F.col("node").alias("set_id"), "label")
    return sets.join(F.broadcast(groups) if groups.count() <= MOST_BROADCAST else groups, "set_id", "left").withColumn("label", F.coalesce("label", "set_id"))


def spanning(pairs: list[tuple[int, int]]) -> list[int]:
    """Which of the pairs of labels connect something new, in turn."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := root.setdefault(x, x)) != x:
            root[x] = x = root[up]
        return x

    kept = []
    for i, (a, b) in enumerate(pairs):
        a, b = find(a), find(b)
        if a != b:
            root[max(a, b)] = min(a, b)
            kept.append(i)
    return kept


def placed_in_blocks(left: DataFrame, n: int) -> DataFrame:
    """q, g: the number of each set's block. Blocks hold BLOCK sets, however the table is partitioned; sets of one label stand together, and
    labels stand by a minimal hash of their members."""

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [int(mixed(np.frombuffer(raw, np.uint64)).min()) for raw in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.array(keys, np.uint64).view(np.int64))], names=["q", "label", "key"])

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), 0
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.full(len(batch), part, np.int64)), pa.array(seen + np.arange(len(batch)))], names=["q", "part", "i"])
            seen += len(batch)

    keys = staged(left.select("set_id", "label", "hashes").mapInArrow(keyed, "q long, label long, key long"), "keys")
    first = keys.groupBy("label").agg(F.min("key").alias("first"))
    order = ["first", "label", "key", "q"]
    near = keys.join(first, "label").repartitionByRange(-(-n // 100_000), *order).sortWithinPartitions(*order)
    rows = staged(near.select("q").mapInArrow(numbered, "q long, part long, i long"), "numbered")
    sizes = rows.groupBy("part").agg(F.count(F.lit(1)).alias("m"))  # one row per partition
    before = sizes.withColumn("before", F.sum("m").over(Window.orderBy("part")) - F.col("m")).select("part", "before")
    blocks = staged(rows.join(before, "part").select("q", F.floor((F.col("before") + F.col("i")) / BLOCK).alias("g")), "numbers")
    dropped(keys, rows)
    return blocks


def in_shares(open_: DataFrame) -> DataFrame:
    """q, g and share: the sets that meet a block, in shares of about ASKING. How many shares a block has, and so how often it is sent, goes by the
    sets that ask for it, not by all sets."""
    shares = open_.groupBy("g").agg(F.ceil(F.count(F.lit(1)) / ASKING).alias("shares"))  # one row per block
    return open_.join(shares, "g").select("q", "g", F.pmod(F.xxhash64("q"), F.col("shares")).alias("share"))


def opened(left: DataFrame) -> DataFrame:
    """Links across labels among the sets of left (set_id, n, hashes, label).

    Here the matrix's groups are blocks of BLOCK sets. A row of it is a token's mask over MASK blocks, so a set meets one row for each
    of its tokens and MASK * BLOCK sets that hold it. A set is compared with all members of those blocks whose union holds 0.75 of it,
    unless they have its own label. Links are given as far as they connect labels within one task's comparisons.
    """

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.frombuffer(raw, np.int64) for raw in batch.column(3).to_pylist()]
            if sets:
                n = [len(s) for s in sets]
                yield pa.RecordBatch.from_arrays([*[pa.array(np.repeat(np.array(batch.column(i).to_pylist(), np.int64), n)) for i in range(3)], pa.array(np.concatenate(sets))], names=["q", "n", "g", "token"])

    def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(q, g) where the union of g holds enough of q, from rows (q, n, top, mask) in order of q and top."""
        shift = np.arange(MASK, dtype=np.uint64)
        held = None
        for batch in batches:
            q, n, top = (batch.column(i).to_numpy() for i in range(3))
            if not len(q):
                continue
            bits = (batch.column(3).to_numpy().view(np.uint64)[:, None] >> shift & np.uint64(1)).astype(np.uint8)
            starts = np.flatnonzero(np.concatenate([[True], (q[1:] != q[:-1]) | (top[1:] != top[:-1])]))
            sums = np.add.reduceat(bits, starts, 0, dtype=np.int64)
            keys = np.column_stack([q[starts], n[starts], top[starts]])
            if held is not None:
                if (held[0] == keys[0]).all():
                    sums[0] += held[1]
                else:
                    keys, sums = np.vstack([held[0], keys]), np.vstack([held[1], sums])
            held = keys[-1], sums[-1]
            yield enough(keys[:-1], sums[:-1])
        if held is not None:
            yield enough(held[0][None], held[1][None])

    def enough(keys: np.ndarray, sums: np.ndarray) -> pa.RecordBatch:
        row, bit = np.nonzero(100 * sums >= SIMILAR * keys[:, 1:2])
        return pa.RecordBatch.from_arrays([pa.array(keys[row, 0]), pa.array(keys[row, 2] * MASK + bit)], names=["q", "g"])

    n_left = left.count()
    blocks = placed_in_blocks(left, n_left)
    placed = left.join(F.broadcast(blocks) if n_left <= MOST_BROADCAST else blocks, F.col("set_id") == F.col("q")).select("q", "n", "hashes", "label", "g")
    placed = staged(placed, "blocks")
    tokens = staged(placed.select("q", "n", "g", "hashes").mapInArrow(explode, "q long, n long, g long, token long"), "open")
    top, bit = F.floor(F.col("g") / MASK).alias("top"), F.expr(f"shiftleft(1L, CAST(g % {MASK} AS INT))")
    matrix = tokens.groupBy("token", top).agg(F.bit_or(bit).alias("mask"))
    met = tokens.select("token", "q", "n").join(matrix, "token").select("q", "n", "top", "mask")
    wanted = met.repartition("q", "top").sortWithinPartitions("q", "top").mapInArrow(bounded, "q long, g long")
    labels = placed.groupBy("g").agg(F.min("label").alias("low"), F.max("label").alias("high"))
    pure = labels.filter("low = high").select("g", F.col("low").alias("label"))  # none of its sets is new to that label
    named = wanted.join(placed.select("q", "label"), "q").join(pure, ["g", "label"], "left_anti")
    found = staged(named.select("q", "g"), "opens")
    dropped(tokens, blocks)
    open_ = staged(in_shares(found), "shares")
    dropped(found)
    asking = open_.join(placed.select("q", "n", "hashes", "label"), "q").select("g", "share", "q", "hashes", "label")
    need = open_.select(F.col("g").alias("g_b"), F.col("share").alias("share_b")).distinct()
    asked = need.join(placed.select(F.col("q").alias("b"), F.col("hashes").alias("h"), F.col("label").alias("l"), F.col("g").alias("g_b")), "g_b")

    def compare(a: pa.Table, b: pa.Table) -> pa.Table:
        members = [np.frombuffer(raw, np.uint64) for raw in b.column("h").to_pylist()]
        sizes = np.array([len(m) for m in members], np.int64)
        flat, of = np.concatenate([*members, np.zeros(0, np.uint64)]), np.repeat(np.arange(len(members)), sizes)
        order = np.argsort(flat, kind="stable")
        flat, of = flat[order], of[order]
        names, labels = b.column("b").to_pylist(), np.array(b.column("l").to_pylist(), np.int64)
        pairs, links = [], []
        for q, raw, label in zip(*[a.column(k).to_pylist() for k in ("q", "hashes", "label")], strict=True):
            whole = np.frombuffer(raw, np.uint64)
            common = np.zeros(len(members), np.int64)
            for cut in range(0, len(whole), SLICE):
                own = whole[cut : cut + SLICE]
                low, high = np.searchsorted(flat, own, "left"), np.searchsorted(flat, own, "right")
                n = high - low
                at = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
                common += np.bincount(of[at], minlength=len(members))
            hit = np.flatnonzero((100 * common >= SIMILAR * (len(whole) + sizes - common)) & (labels != label))
            for i in hit:
                pairs.append((label, int(labels[i])))
                links.append((q, names[i]))
        kept = [links[i] for i in spanning(pairs)]
        return pa.table({"a": pa.array([x for x, _ in kept], pa.int64()), "b": pa.array([y for _, y in kept], pa.int64())})

    links = staged(asking.groupBy("g", "share").cogroup(asked.groupBy("g_b", "share_b")).applyInArrow(compare, "a long, b long"), "links")
    dropped(placed, open_)
    return links


def ngram_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_shingles, set_id, component_id: the smallest id that links lead to, its own included; label names
    the component itself, as components of rows that repeat an id may share their component_id (null for empty sets).

    Null texts and texts without words have an empty set and only themselves. Documents with equal sets are linked; repeated rows
    stay rows. A null id never is the smallest unless all are null. Other columns are ignored. Sets and tokens are known by 64-bit
    hashes; all bounds err on the side of comparing.
    """
    parts = docs.rdd.getNumPartitions()  # follows the size of the input, and so does the number of buckets
    buckets = 1 << max(4, (2 * parts - 1).bit_length())
    judged = sieve(docs, buckets, id_col, text_col)
    wanted = judged.filter("may_link and n > 0").groupBy("set_id").agg(F.min(id_col).alias(id_col)).filter(F.col(id_col).isNotNull())
    nulls = judged.filter("may_link and n > 0").groupBy("set_id").agg(F.count(id_col).alias("m")).filter("m = 0").select("set_id", F.lit(None).cast(docs.schema[id_col].dataType).alias(id_col))
    wanted = staged(wanted.unionByName(nulls), "wanted")
    links = None
    if not wanted.isEmpty():
        sets = sets_of(docs, wanted, id_col, text_col)
        if sets.count() > sets.select("set_id").distinct().count():  # rows that repeat an id
            before, sets = sets, staged(sets.dropDuplicates(["set_id"]), "sets")
            dropped(before)
        links, labels = linked(sets, buckets)
    rows = judged
    if links is None:
        rows = rows.withColumn("label", F.col("set_id"))
    else:
        rows = rows.join(labels.withColumnRenamed("node", "set_id"), "set_id", "left").withColumn("label", F.coalesce("label", "set_id"))
    rows = staged(rows.select(id_col, "n", "set_id", "label"), "labelled")
    first = staged(rows.filter("n > 0").groupBy("label").agg(F.min(id_col).alias("component_id")), "firsts")
    full = rows.filter("n > 0").join(first, "label").select(id_col, F.col("n").alias("n_shingles"), "set_id", "component_id", "label")
    empty = rows.filter("n = 0").select(id_col, F.col("n").alias("n_shingles"), "set_id", F.col(id_col).alias("component_id"), F.lit(None).cast("long").alias("label"))
    found = staged(full.unionByName(empty), "components")
    dropped(judged, wanted, links, rows, first)
    return found


def linked(sets: DataFrame, buckets: int) -> tuple[DataFrame, DataFrame]:
    """Links among the sets (set_id, n, hashes) that connect all that is similar, and their components (node, label)."""
    left, links, labels, groups_before = sets, None, None, None
    for seed in range(STAR_ROUNDS):
        pairs = star_pairs(left, seed)
        new = verified(left, pairs)
        dropped(pairs)
        before, links = links, new if links is None else staged(links.unionByName(new), "links")
        if before is not None:
            dropped(before, new)
        dropped(labels)
        labels = components(links)
        for share in (SIEVE_SHARE, None):
            passed = across_groups(labelled(left, labels), buckets, share)
            before, left = left, staged(only(left, passed), "across")
            dropped(before, passed)
        groups = labelled(left.select("set_id"), labels).select("label").distinct().count()
        if not groups:
            dropped(left)
            return links, labels
        if groups_before and groups > 0.9 * groups_before:
            break
        groups_before = groups
    before, last = links, opened(labelled(left, labels))
    links = staged(links.unionByName(last), "links")
    dropped(before, last, left, labels)
    return links, components(links)
