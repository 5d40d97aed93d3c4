"""Toxicity by a linear-chain conditional random field over words.

Learning: from a bounded sample of labelled documents a cover of telling words and
stems is chosen, which labels the tokens of toxic documents;
on these labelled tokens the field is trained. Scoring: forward-backward gives every word's probability of being toxic; the
highest and the sum of a document feed a logistic score, and words at 0.5 or more are the offending spans. Chains are lines.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import crf
from .common import key_first
from .units import in_chunks

EDGES = ".,;:!?\"'()[]{}<>«»„“”…*_-"
TOKEN = re.compile(r"\S+")
#: Labelled rows of each class that the model is fitted on at most.
MAX_ROWS = 1500


def held_out(doc_id: str = "doc_id"):
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0


def labelled_sample(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> list[tuple[str, int]]:
    """(text, toxic) of at most max_rows labelled documents of each class outside the held-out fifth, by a repeatable shuffle."""
    open_ = labels.filter("toxic in (0, 1)").filter(~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    some = [open_.filter(F.col("toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows) for c in (0, 1)]
    chosen = F.broadcast(some[0].unionByName(some[1]))  # 2 * max_rows rows of two numbers
    rows = docs.select("doc_id", "text").filter("text is not null").join(chosen, "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"))
    return [(r["text"], r["toxic"]) for r in rows.orderBy("doc_id").toLocalIterator()]


def words_of(line: str) -> list[str]:
    return [w.strip(EDGES) for w in line.lower().split()]


def signs_of(word: str) -> list[str]:
    """What a word can be told by: itself, and its first letters (languages that compound words share stems)."""
    return [word, *[word[:n] + "-" for n in (6, 5, 4) if len(word) > n]] if word else []


def telling_signs(sample: list[tuple[str, int]], times: int = 2) -> list[str]:
    """Signs that cover the toxic documents, each so many times: again and again the sign in most toxic documents still short of it, among
    those at least 20 times likelier in toxic documents than in others. Copies of one document can't bring in their other
    words, as they are covered already."""
    counted = Counter(), Counter()
    for text, y in sample:
        counted[y].update({s for w in set(words_of(text)) for s in signs_of(w)})
    (ok, total), n_bad = counted, sum(y for _, y in sample)
    n_ok = max(1, len(sample) - n_bad)
    least = max(3, n_bad // 100)
    usable = {s for s, n in total.items() if n >= least and n / n_bad >= 20 * ok[s] / n_ok}
    found: list[str] = []
    left = [[times, {s for w in set(words_of(text)) for s in signs_of(w) if s in usable}] for text, y in sample if y]
    while left:
        counts = Counter(s for _, d in left for s in d)
        if not counts:
            break
        sign = max(counts, key=lambda s: (counts[s], total[s], len(s), s))
        if counts[sign] < least:
            break
        found.append(sign)
        stem = sign.rstrip("-")
        for x in left:
            if sign in x[1]:
                x[0] -= 1
                x[1] = {s for s in x[1] if not s.startswith(stem) and not stem.startswith(s.rstrip("-"))}
        left = [x for x in left if x[0] > 0]
    return found


def number_of(word: str, numbers: dict[str, int]) -> int:
    """The number of the word's longest telling sign, 0 if it has none."""
    return next((numbers[s] for s in signs_of(word) if s in numbers), 0)


def fit(sample: list[tuple[str, int]], max_chains: int = 1000, chain_words: int = 40) -> dict:
    """The field is trained on at most about 2 * max_chains pieces of lines of at most chain_words words, with and without telling words.

    The model: words (telling signs and their number), emissions (number by label), moves, and the document score's coefficients."""
    numbers = {s: i + 1 for i, s in enumerate(telling_signs(sample))}  # 0: any other word
    hot, cold = [], []
    for text, y in sample:
        for line in map(words_of, text.split("\n")):
            for at in range(0, len(line), chain_words):
                row = [number_of(w, numbers) for w in line[at : at + chain_words]]
                (hot if y and any(row) else cold).append((row, y))
    lines = hot[:: -(-len(hot) // max_chains) or 1] + cold[:: -(-len(cold) // max_chains) or 1]
    if not hot:
        return {"words": {}, "emissions": np.zeros((1, 2)), "moves": np.zeros((2, 2)), "score": np.array([-4.0, 0.0, 0.0])}
    flat = [np.array([i]) for row, _ in lines for i in row]
    labels = np.array([int(i > 0 and y) for row, y in lines for i in row])
    weights, moves = crf.train(flat, len(numbers) + 1, labels, np.array([len(r) for r, _ in lines]), 2, steps=80, l2=0.5)
    model = {"words": numbers, "emissions": weights - weights[:, :1], "moves": moves, "score": np.zeros(3)}
    x = np.array([summary for summary, _ in Scorer(model).documents([t for t, _ in sample])])
    x = np.column_stack([np.ones(len(x)), x])
    y, b = np.array([y for _, y in sample], float), np.zeros(3)
    for _ in range(50):  # Newton steps of a penalized logistic regression
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        b += np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(3), x.T @ (y - p) - 0.1 * b)
    return model | {"score": b}


class _Numbers(dict):
    """Word as it stands -> number; bounded by clearing."""

    def __init__(self, words: dict[str, int]):
        self.words = words

    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        self[word] = n = number_of(word.strip(EDGES), self.words)
        return n


class Scorer:
    def __init__(self, model: dict):
        self.model, self.numbers = model, _Numbers(model["words"])
        self.plain: dict[int, tuple[float, float]] = {}

    def _plain(self, n: int) -> tuple[float, float]:
        """Highest and summed probability of a line of n words none of which is in the lexicon."""
        if n not in self.plain:
            m = self.model
            p = crf.in_rectangles(crf.marginals, np.repeat(m["emissions"][:1], n, 0), np.array([n]), m["moves"])[:, 1]
            if len(self.plain) > 10_000:
                self.plain.clear()
            self.plain[n] = (float(p.max()), float(p.sum()))
        return self.plain[n]

    def documents(self, texts: list[str]) -> list[tuple[tuple[float, float], list[tuple[int, int]]]]:
        """((highest, log of 1 + sum), [(line, word) of offending words]) of each text."""
        numbers = self.numbers.__getitem__
        best, total = np.zeros(len(texts)), np.zeros(len(texts))
        found: list[list] = [[] for _ in texts]
        chains, where = [], []
        for d, text in enumerate(texts):
            for k, line in enumerate(text.lower().split("\n")):
                row = list(map(numbers, line.split()))
                if not row:
                    continue
                if any(row):
                    chains.append(row)
                    where.append((d, k))
                else:
                    high, s = self._plain(len(row))
                    best[d] = max(best[d], high)
                    total[d] += s
        if chains:
            sizes = np.array([len(c) for c in chains])
            p = crf.in_rectangles(crf.marginals, self.model["emissions"][np.concatenate(chains)], sizes, self.model["moves"])[:, 1]
            for (d, k), own in zip(where, np.split(p, np.cumsum(sizes)[:-1]), strict=True):
                best[d] = max(best[d], own.max())
                total[d] += own.sum()
                found[d] += [(k, int(j)) for j in np.flatnonzero(own >= 0.5)]
        return [((float(b), float(np.log1p(t))), sorted(f)) for b, t, f in zip(best, total, found, strict=True)]

    def scores(self, texts: list[str]) -> tuple[np.ndarray, list[list[tuple[int, int]]]]:
        """Score and offending spans (start, end in code points) of each text."""
        rows = self.documents(texts)
        b = self.model["score"]
        score = 1 / (1 + np.exp(-np.clip(b[0] + np.array([x for x, _ in rows]).reshape(-1, 2) @ b[1:], -30, 30)))
        return score, [self._spans(t, f) if f else [] for t, (_, f) in zip(texts, rows, strict=True)]

    def _spans(self, text: str, found: list[tuple[int, int]]) -> list[tuple[int, int]]:
        out, at = [], 0
        wanted: dict[int, set[int]] = {}
        for k, j in found:
            wanted.setdefault(k, set()).add(j)
        for k, line in enumerate(text.split("\n")):
            for j, m in enumerate(TOKEN.finditer(line) if k in wanted else ()):
                if j in wanted[k]:
                    out.append((at + m.start(), at + m.end()))
            at += len(line) + 1
        return out


def toxicity(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, score (0 to 1), predicted (1 from 0.5 on), spans: array of (start, end) of offending words, in code points.

    Whole texts; null reads as empty and gets the score of a text without words. Repeated rows and null ids stay as they are; columns
    besides id and text are never read. The model (some dozen numbers and words) goes with the task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        pair = pa.struct([("start", pa.int64()), ("end", pa.int64())])
        for batch in batches:
            for first, chunk in in_chunks(batch.column(1).to_pylist()):
                score, spans = scorer.scores(chunk)
                rows = [[{"start": a, "end": b} for a, b in s] for s in spans]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(chunk)), pa.array(score), pa.array((score >= 0.5).astype(np.int32)), pa.array(rows, pa.list_(pair))], names=[id_col, "score", "predicted", "spans"])

    return key_first(docs, id_col, text_col).mapInArrow(run, f"`{id_col}` {dict(docs.dtypes)[id_col]}, score double, predicted int, spans array<struct<start: long, end: long>>")
