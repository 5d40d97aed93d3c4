"""The pipeline against brute force on a small table."""

import hashlib
import random
import re
from collections import Counter

import corpus_pipeline
from lumenfleet.llm.queries import tokenizer_path
from lumenfleet.llm.units import loaded
from tests.llm.test_operators import brute_components

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(r, n=90):
    """Words without repeats, of letters alone, with some stop words: passes the quality rules."""
    return " ".join(["the", "of", "and", "to", *["".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=7)) for _ in range(n)]])


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t)) for i, t, s in rows], DOCS)


def test_rows_that_repeat_an_id_are_told_apart(spark):
    r = random.Random(5)
    one, other, third = prose(r), prose(r), prose(r)
    rows = [(1, one, "a"), (1, other, "a"), (1, one, "a"), (2, one + " end", "a"), (3, third, "a"), (4, "", "a"), (4, third + " end", "a"), (None, other, "a")]
    got = corpus_pipeline.near_duplicates(spark, table(spark, rows), "")
    want = [(1, one), (1, other), (3, third), (4, ""), (None, other)]
    assert Counter((x["doc_id"], x["text"]) for x in got.collect()) == Counter(want)


def test_quality_writes_no_copy_and_stages_go(spark, tmp_path, monkeypatch):
    """Verdicts are made once, below the filter, and nothing is written for them; a stage's table goes when its successor is there."""
    r = random.Random(9)
    rows = [(i, prose(r) if i % 3 else "too short", "ab"[i % 2]) for i in range(12)] + [(None, None, "a"), (1, prose(r), "b")]
    docs = spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], DOCS)
    with monkeypatch.context() as m:
        m.setattr(corpus_pipeline, "staged", None)
        good = corpus_pipeline.quality(spark, docs, "")
    assert Counter(x["text"] for x in good.collect()) == Counter(t for _, t, _ in rows if t and t != "too short")
    plan = good._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Filter") == 1 and plan.index("Filter (kept") < plan.index("regexp_extract_all")
    monkeypatch.setattr(corpus_pipeline, "scratch", lambda spark, name: f"file://{tmp_path}/{name}")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count()
    assert [p.name for p in tmp_path.iterdir() if p.name.startswith("pipeline-")] == ["pipeline-packing"]


def test_run_equals_brute_force(spark, tmp_path):
    r = random.Random(6)
    rows = []
    for i in range(24):
        rows.append((i, prose(r, r.randint(80, 140)) + f" mail{i}@example.com", "ab"[i % 3 == 0]))
        if i % 4 == 0:
            rows.append((100 + i, rows[-1][1] + " again", "a"))  # a near copy
        if i % 6 == 0:
            rows.append((i, prose(r), "b"))  # the id again, another text
    rows += [(200, "too short", "a"), (201, "Of " * 90, "b"), (202, " ".join(f"w{j}$$$" for j in range(90)), "a")]  # rejected
    table(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    good = [x for x in rows if x[0] < 200]
    roots = [root for _, root in brute_components([t for _, t, _ in good])]
    kept = [min((x for x, b in zip(good, roots, strict=True) if b == a), key=lambda x: x[0]) for a in sorted(set(roots))]
    clean = [(i, re.sub(r"\S+@\S+[.]com", "<EMAIL>", t), s) for i, t, s in kept]
    size = {s: sum(len(t.split()) for _, t, x in clean if x == s) for s in "ab"}
    total = sum(size.values())
    target = {s: min(w * total / 3, 3 * size[s]) for s, w in (("a", 1), ("b", 2))}
    full = [s for s, w in (("a", 1), ("b", 2)) if w * total / 3 > 3 * size[s]]
    for s in full:
        target["ab"[s == "a"]] = total - target[s]
    library, want = loaded(tokenizer_path("word_bpe_49k.json")), Counter()
    for s in "ab":
        own = sorted((hashlib.md5(f"{i}:mix".encode()).hexdigest(), len(t.split()), i, t) for i, t, x in clean if x == s) * 3
        left = int(target[s] + 1e-9)
        for _, n, i, t in own:
            if left > 0:
                text = t if n <= left else " ".join(t.split()[:left])
                want[i] += len(library.encode(text, add_special_tokens=False).ids) + 1
                left -= n
    got = Counter()
    for x in corpus_pipeline.run(spark, str(tmp_path)).collect():
        got[x["doc_id"]] += x["length"]
    assert got == want
