"""Clustering, whitening and language-model scores against brute force, with nulls, repeats, ties, empty tables and clashing columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from lumenfleet.llm import clustering, context_mixing, whitening

VECTORS = "vec_id long, embedding array<float>, cluster string, n string, x string"


def vectors_of(spark, rows):
    return spark.createDataFrame([(i, v, "clash", "clash", "clash") for i, v in rows], VECTORS)


@pytest.fixture(scope="module")
def odd_rows():
    r = random.Random(4)
    some = [(i, [round(r.uniform(-0.6, 0.6), 3) for _ in range(6)]) for i in range(60)]
    same = [(100 + i, [0.25] * 6) for i in range(30)]  # a third of all rows is one vector
    odd = [(200, None), (201, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (202, [float("nan")] * 6), (203, [float("inf")] + [0.0] * 5), (204, [0.5] * 5), (205, []), (None, [0.1] * 6), (7, some[7][1]), (7, [9.0] * 6), (300, [3e9] + [0.0] * 5)]
    return some + same + odd


def brute_clusters(rows, k, rounds, dims=6):
    kept = [(i, [max(-clustering.LARGEST, min(clustering.LARGEST, math.floor(1024 * float(np.float32(x))))) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted((hashlib.sha256(f"3:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)[:k]
    centroids = [v for _, v in first]
    far = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c, strict=True))
    near = lambda v: min((far(v, c), j) for j, c in enumerate(centroids))
    for _ in range(rounds):
        own = [near(v)[1] for _, v in kept]
        centroids = [[sum(col) // len(col) for col in zip(*m, strict=True)] if (m := [v for (_, v), o in zip(kept, own, strict=True) if o == j]) else c for j, c in enumerate(centroids)]
    last = [near(v) for _, v in kept]
    sums = Counter()
    for d, j in last:
        sums[j] += d
    return sorted(((i, j, d, sums[j], sum(sums.values()), hashlib.sha256(",".join(map(str, centroids[j])).encode()).hexdigest()) for (i, _), (d, j) in zip(kept, last, strict=True)), key=str)


@pytest.mark.parametrize(("k", "rounds"), [(8, 10), (3, 0), (200, 2)])
def test_clusters_equal_brute_force(spark, odd_rows, k, rounds):
    got = clustering.cluster(vectors_of(spark, odd_rows), k=k, rounds=rounds, dims=6).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute_clusters(odd_rows, k, rounds)


def test_clusters_of_nothing(spark):
    assert clustering.cluster(vectors_of(spark, []), dims=6).count() == 0
    assert clustering.cluster(vectors_of(spark, [(1, None), (2, [1.0])]), dims=6).count() == 0
    assert clustering.cluster(vectors_of(spark, [(5, [1.0] * 6)]), dims=6).collect()[0]["inertia"] == 0


@pytest.mark.parametrize("weights", ["count", "one"])
def test_whitening_equals_numpy(spark, odd_rows, weights):
    rows = [(i, v) for i, v in odd_rows if i != 300]
    got = whitening.whiten(vectors_of(spark, rows), components=4, weights=weights).collect()
    kept = [(i, (v + [0.0] * 6)[:6]) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    x = np.array([[math.floor(1024 * float(np.float32(c))) + 100000 for c in v] for _, v in kept])
    fit = x if weights == "count" else np.unique(x, axis=0)
    n, s = len(fit), fit.sum(0)
    cov = np.cov(fit.T, bias=True)
    e, axes = np.linalg.eigh(cov)
    e, axes = e[::-1], axes[:, ::-1]
    assert len(got) == 4 * len(kept) and {r["n"] for r in got} == {n} and max(r["identity_error"] for r in got) < 1e-9
    white = (x - s / n) @ axes / np.sqrt(e)
    for c in range(4):
        mine = sorted((str(r["vec_id"]), r["deviation"], r["whitened"]) for r in got if r["component"] == c + 1)
        for sign in (1, -1):
            want = sorted((str(i), sum((n * int(a) - int(b)) ** 2 for a, b in zip(v, s, strict=True)), sign * z) for (i, _), v, z in zip(kept, x, white[:, c], strict=True))
            if np.allclose([m[2] for m in mine], [w[2] for w in want], atol=1e-8):
                assert [m[:2] for m in mine] == [w[:2] for w in want]
                break
        else:
            raise AssertionError(c)
        assert {r["explained"] for r in got if r["component"] == c + 1}.pop() == pytest.approx(e[c] / np.trace(cov))


def test_whitening_of_little(spark):
    assert whitening.whiten(vectors_of(spark, [])).count() == 0
    assert whitening.whiten(vectors_of(spark, [(1, None), (2, [float("nan")])])).count() == 0
    alike = whitening.whiten(vectors_of(spark, [(1, [0.5, 0.25])] * 3 + [(None, [0.5, 0.25])])).collect()
    assert len(alike) == 8 and {(r["whitened"], r["explained"], r["deviation"]) for r in alike} == {(None, None, 0)}
    large = whitening.whiten(vectors_of(spark, [(i, [float(3e38 if i else 1), float(i)]) for i in range(4)])).collect()
    assert len(large) == 8 and {r["component"] for r in large} == {1, 2}


# Language model --------------------------------------------------------------------------------------------------------------------

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def texts():
    r = random.Random(8)
    vocabulary = ["".join(r.choices("etaoin shrdlu".replace(" ", ""), k=r.randint(1, 9))) for _ in range(300)]
    prose = lambda n: " ".join(r.choices(vocabulary, weights=[1 / (i + 1) for i in range(300)], k=n))
    return ["", None, " \n", "ONE word", "x" * 500 + " y " + "x" * 500, "nul\0 é 漢字 \x85 Eİ", prose(5000), *[prose(r.randint(1, 200)) for _ in range(60)]] + ["twice the same"] * 3


def docs_of(spark, texts):
    rows = [(None if i == 9 else 3 if i in (20, 21) else i, t, "clash", 1) for i, t in enumerate(texts)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, n string, block int").repartition(3)


def test_language_model_base_and_blocks(spark, texts):
    rows, docs = docs_of(spark, texts)
    got = context_mixing.language_model_scores(docs, rounds=0).collect()
    train = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 != 2
    tokens = lambda t: [*WORD.findall((t or "").translate(LOW)), "\n"]
    c = Counter(w for i, t, *_ in rows if train(i) for w in tokens(t))
    n, v = sum(c.values()), len(c)
    coded = lambda t: sum(len(x.encode()) + 1 + (len(x.encode()) - 1) // context_mixing.PIECE for x in tokens(t)[:-1]) + 1
    want = sorted((*w[:6], b) for w, b in zip(((str(i), not train(i), len(w), sum(c[x] > 0 for x in w), n, round(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w), 6)) for i, w in ((i, tokens(t)) for i, t, *_ in rows)), (coded(t) for _, t, *_ in rows), strict=True))
    assert sorted((str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6), r["n_bytes"]) for r in got) == want
    assert all(r["score"] < 0 and math.isfinite(r["score"]) for r in got)
    # However the words are dealt to blocks, the tree counts alike.
    small = context_mixing.language_model_scores(docs, rounds=0, word_block=7).collect()
    key = lambda r: (str(r["doc_id"]), r["n_bytes"], r["score"])
    for a, b in zip(sorted(got, key=key), sorted(small, key=key), strict=True):
        assert a["score"] == pytest.approx(b["score"], abs=1e-9)


def test_language_model_learns(spark, texts):
    _, docs = docs_of(spark, texts)
    plain = context_mixing.language_model_scores(docs, rounds=0).filter("held_out").agg({"score": "sum"}).first()[0]
    assert context_mixing.language_model_scores(docs).filter("held_out").agg({"score": "sum"}).first()[0] > plain
    prose = context_mixing.language_model_scores(spark.read.parquet("/root/testdata/sf0.001/documents.parquet")).filter("held_out").agg({"score": "sum", "base_score": "sum"}).first()
    assert prose["sum(score)"] > prose["sum(base_score)"], prose
    assert context_mixing.language_model_scores(docs.limit(0)).count() == 0
    alone = context_mixing.language_model_scores(docs.filter("doc_id is null")).collect()
    assert [(r["held_out"], r["train_tokens"], r["base_score"]) for r in alone] == [(True, 0, 0.0)] and alone[0]["score"] < 0


def test_predictions_of_a_bit_sum_to_one():
    r = np.random.default_rng(2)
    odds, gate = r.normal(0, 3, (5, 400)), r.integers(0, context_mixing.GATES, 400)
    weights, table = r.normal(0.3, 0.2, (context_mixing.GATES, 5)), r.normal(0, 2, context_mixing.BUCKETS * context_mixing.GATES)
    total = np.zeros(400)
    for bit, sign in ((1, 1), (0, -1)):
        bits = np.full(400, bit)
        total += np.exp(context_mixing.refined(*context_mixing.mixed(sign * odds, gate, bits, weights), bits, table))
    assert np.allclose(total, 1)


def test_tree_counts_equal_brute_force():
    words = sorted({bytes(random.Random(i).choices(b"ab\xff\x00", k=random.Random(-i).randint(0, 5))) + b" " for i in range(1, 200)})
    n = [i % 4 for i in range(len(words))]
    row = {"ends": np.cumsum([len(w) for w in words]).astype(np.int64).tobytes(), "words": b"".join(words), "before": bytes(i % 3 for i in range(len(words))), "n": np.array(n, np.int64).tobytes()}
    bits = ["".join(f"{b:08b}" for b in w) for w in words]
    for j, rows, _, _, counts, alive, run in context_mixing.Block(row, None).bytes_in_turn():
        assert sorted(alive) == [i for i, w in enumerate(words) if len(w) > j]
        assert all(words[a][: j + 1] == words[rows[r]][: j + 1] and a % 3 == rows[r] % 3 for a, r in zip(alive, run, strict=True))
        for i, at in enumerate(rows):
            for k in range(9):
                assert counts[k, i] == sum(m for b, m in zip(bits, n, strict=True) if b.startswith(bits[at][: 8 * j + k]))


def test_long_texts_go_in_parts():
    text = b"ab " * 400_000 + b"z" * 100
    lists = list(context_mixing.key_lists(text))
    assert max(len(words) for words, _ in lists) <= context_mixing.PART and sum(len(words) for words, _ in lists) == 400_000 + 1 + 4 + 1
    assert lists[0][1][:3].tolist() == [10, 98, 98] and lists[-1][0][-1] == b"\n" and all(len(words) == len(before) for words, before in lists)
    own, count = np.array([0, 7, 70_000]), np.array([1, 300, 2])
    back = context_mixing.from_payload(context_mixing.as_payload(own, count))
    assert back[0].tolist() == own.tolist() and back[1].tolist() == count.tolist()
