"""No text, however long or odd, takes memory or time out of proportion; and the base patterns against plain ones."""

import hashlib
import random
import re
import time

import numpy as np
import pytest

from lumenfleet.llm import crf, private, queries, toxicity
from lumenfleet.llm.queries import tokenizer_path
from lumenfleet.llm.token_counts import PrefixCounter
from lumenfleet.llm.units import SEPARATOR, loaded


@pytest.fixture(scope="module")
def model():
    return private.fit()


@pytest.mark.parametrize("run", [crf.viterbi, crf.marginals])
def test_rectangles_equal_the_whole(run, monkeypatch):
    r = np.random.default_rng(3)
    lengths = np.array([1, 7, 0, 300, 2, 2, 45, 0, 900])
    e, moves = r.normal(0, 2, (int(lengths.sum()), 4)), r.normal(0, 1, (4, 4))
    want = run(e, lengths[lengths > 0], moves)
    assert np.array_equal(crf.in_rectangles(run, e, lengths, moves), want)
    monkeypatch.setattr(crf, "CELLS", 2000)
    assert np.allclose(crf.in_rectangles(run, e, lengths, moves), want)
    monkeypatch.setattr(crf, "LONGEST", 100)  # windows with context decide alike
    assert np.allclose(crf.in_rectangles(run, e, lengths, moves), want, atol=1e-6)
    assert len(crf.in_rectangles(run, e[:0], np.zeros(0, int), moves)) == 0


def test_rectangles_are_bounded():
    largest = []

    def run(e, lengths, moves):
        largest.append(int(lengths.max()) * len(lengths) * e.shape[1])
        return np.zeros(len(e), np.int64)

    crf.in_rectangles(run, np.zeros((400_000 + 4095 * 2, 11)), np.array([400_000, *[2] * 4095]), np.zeros((11, 11)))
    assert max(largest) <= crf.CELLS


def test_many_addresses_and_long_rows(model):
    for text, n_base, most in ((" ".join(f"u{i}@mail{i % 100}.example.org" for i in range(200_000)), 200_000, 30), (" ".join(str(i * 7919) for i in range(100_000)), 0, 30), ("key " + "aB3dE5fG" * 130_000 + "= end", 0, 10), ("a" * 1_000_000 + "1", 0, 10), ("+1" * 300_000, 0, 10)):
        began = time.time()
        base = private.base_spans(text)
        private.field_spans(model, [text], [base])
        assert len(base) == n_base and time.time() - began < most


def test_segments_of_a_chain_go_on(model, monkeypatch):
    """Spans of a long chain are those of the whole, wherever it is parted."""
    text = " ".join(["call 07700 900123 now", "12 34 56", "555-0199-2231"] * 60).replace(" call", "").replace(" now", "")
    whole = private.field_spans(model, [text], [private.base_spans(text)])
    for words in (70, 101):
        monkeypatch.setattr(private, "WORDS", words)
        assert private.field_spans(model, [text], [private.base_spans(text)]) == whole


def test_linear_searches_equal_plain_ones():
    r = random.Random(1)
    mixed = re.compile(r"[A-Za-z]\D*[0-9]+[A-Za-z_]+[0-9]")
    secret = re.compile(r"[0-9A-Za-z/+_-]{12,}(?=[\"',;:.!?)}\]]*$)")
    for _ in range(5000):
        v = "".join(r.choice("a1_é2B") for _ in range(r.randint(0, 10)))
        assert private.mixed_up(v) == (mixed.search(v) is not None)
        v = "".join(r.choice('a1_=."') for _ in range(r.randint(0, 30))) + r.choice(["", "abcdef012345678", "abcdef012345678."])
        m = secret.search(v)
        assert private.trimmed(v, 0, len(v), "secret") == ((m.start(), m.end()) if m and private.MARK.search(m.group()) else None)


def plain_spans(text):
    luhn = lambda d: sum(int(c) if i % 2 == 0 else sum(map(int, str(2 * int(c)))) for i, c in enumerate(d[::-1])) % 10 == 0
    digits = lambda s: re.sub("[^0-9]", "", s)
    kinds = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda s: 14 <= len(digits(s)) <= 19 and luhn(digits(s))),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 10 <= len(digits(s)) <= 15),
    }
    return sorted((m.start(), rank, m.end(), kind) for rank, (kind, (pattern, holds)) in enumerate(kinds.items()) for m in re.finditer(pattern, text) if holds(m.group()))


def test_base_spans_equal_plain_patterns():
    r = random.Random(6)
    parts = ["a.b@c.de", "@", "x@y", "1.2.3.4", "300.1.1.1", "1.2.3.4.5.6.7.8", "4111 1111 1111 1111", "4111-1111-1111-1112", "378282246310005", "+49 30 901820", "+1 (303) 555-9001", "+12", " ", ".", "-", "7", "é", "mail@10.0.0.1"]
    for _ in range(3000):
        text = "".join(r.choice(parts) + r.choice(["", " "]) for _ in range(r.randint(0, 8)))
        assert sorted((a, k, b, private.KINDS[k]) for a, b, k in private.base_spans(text)) == plain_spans(text), text


def test_the_query_equals_plain_patterns(spark):
    got = {r["doc_id"]: r for r in queries.op9_private(spark, "/root/testdata/sf0.001").collect()}
    for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect():
        spans, own = plain_spans(r["text"] or ""), got[r["doc_id"]]
        assert [own[f"n_{k}"] for k in private.KINDS[:4]] == [sum(s[3] == k for s in spans) for k in private.KINDS[:4]]
        assert own["base_sha256"] == hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, _, b, k in spans).encode()).hexdigest()
        assert {f"{k}:{a}:{b}" for a, _, b, k in spans} <= set(own["spans"].split(","))


def test_toxicity_of_long_lines():
    model = {"words": {"vile": 1}, "emissions": np.array([[0.0, -3.0], [0.0, 4.0]]), "moves": np.array([[0.5, -0.5], [-0.5, 0.5]]), "score": np.array([-4.0, 3.0, 1.0])}
    scorer = toxicity.Scorer(model)
    long = " ".join(["word"] * 125_000)
    began = time.time()
    score, spans = scorer.scores([long, "", "vile", long + " vile", *["two words"] * 600])
    assert time.time() - began < 20 and score[2] > score[1] and [len(s) for s in spans[:4]] == [0, 0, 1, 1]
    assert spans[3] == [(len(long) + 1, len(long) + 5)]


def test_special_strings_without_asking_the_library():
    path = tokenizer_path("byte_bpe_50k.json")
    library, counter, r = loaded(path), PrefixCounter(path), random.Random(5)
    for _ in range(150):
        text = "".join(r.choice([SEPARATOR, SEPARATOR[:5], "a", " b", "\n", "é", "<|", "x1", " ", SEPARATOR[3:]]) for _ in range(r.randint(0, 8)))
        assert counter.prefix_counts(text).tolist() == [len(library.encode(text[:k], add_special_tokens=False).ids) for k in range(len(text) + 1)]
    began = time.time()
    counts = counter.unit(("ab" * 20 + SEPARATOR) * 20_000)
    assert counts[-1] == 20_000 * (len(library.encode("ab" * 20, add_special_tokens=False).ids) + 1) and time.time() - began < 20


def test_ids_are_counted_by_batches(spark, monkeypatch):
    """Documents of both widths, counted together: so many calls as batches have widths, not as there are documents."""
    from lumenfleet.llm.token_files import id_counts

    r = np.random.default_rng(2)
    docs = [(2 if i % 3 else 4, r.integers(0, 300 if i % 3 else 70_000, 1 + i % 5)) for i in range(200)]
    rows = spark.createDataFrame([(w, v.astype(f"<u{w}").tobytes()) for w, v in docs], "width int, ids binary").coalesce(1)
    want = np.bincount(np.concatenate([v for _, v in docs]))
    assert id_counts(rows.select("ids", "width")).tolist() == want.tolist()
    calls, inner = [], np.bincount
    step = lambda v: (calls.append(len(v)), inner(v))[1]
    monkeypatch.setattr(np, "bincount", step)

    class Encoded:
        def select(self, *_):
            return self

        def mapInArrow(self, run, _):
            import pyarrow as pa

            self.made = list(run([pa.RecordBatch.from_arrays([pa.array([v.astype(f"<u{w}").tobytes() for w, v in docs]), pa.array([w for w, _ in docs])], names=["ids", "width"])]))
            raise StopIteration

    encoded = Encoded()
    with pytest.raises(StopIteration):
        id_counts(encoded)
    assert len(calls) == 2 and encoded.made[0].column(1).to_pylist() == want[want > 0].tolist()


def test_a_full_table_keeps_what_is_met_often():
    """op2: beyond its bound a table forgets units met once, not those that come again; values stay right, and the bound holds."""
    import numpy as np

    from lumenfleet.llm.units import UnitTable, document_ids

    asked: list[str] = []

    def compute(units):
        asked.extend(units)
        return np.array([int(u) for u in units for _ in range(int(u) % 3)], np.int32), np.array([int(u) % 3 for u in units], np.int64)

    table = UnitTable(str.split, compute, max_units=40)
    for i in range(30):
        words = ["7", "8", *map(str, range(100 + 10 * i, 110 + 10 * i)), "7", "8"]
        ids, sizes = document_ids(table, [" ".join(words), ""])
        assert ids.tolist() == [int(w) for w in words for _ in range(int(w) % 3)] and sizes.tolist() == [len(ids), 0]
        assert len(table.codes) <= 40 + 12
    assert asked.count("7") == asked.count("8") == 1
    for _ in range(3):  # more come again than half the bound holds: all are forgotten
        every = " ".join(str(v) for v in range(60))
        ids, _ = document_ids(table, [every + " " + every])
        assert ids.tolist() == 2 * [v for v in range(60) for _ in range(v % 3)] and len(table.codes) <= 60 + 52
