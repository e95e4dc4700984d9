"""Toxicity: a factorization machine over hashed terms.

Terms are words and their prefixes, hashed to 32 bits. Terms associated with the label in the training sample are
the machine's inputs; it learns a weight for each and, through factors, a weight for each pair, so that two terms
which mean little alone (an insult word and a group mention) can count together.

Defined results: null and empty texts have no terms and get the bias as score; repeated rows are each scored, and count
once in the sample; terms of one hash (ties) are one term; a text of any length is read whole; an empty table gives an
empty result; without labels of both kinds the score is the training share of label 1. Columns other than doc_id and text
are ignored (in scores) or kept (in cleaning), whatever their names.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from graindeck.llm.common import arrow_map, fold, labelled_sample

#: Labelled documents that the model is fitted on at most.
MAX_TRAIN = 12_000

#: The model's size: hashed terms that it takes as inputs at most, those of the largest association with the label; the
#: chi-square and the documents from which a term is one; and the lengths of the prefixes that are terms too.
MAX_TERMS, LEAST_CHI, LEAST_DOCS = 4_000, 12, 3
PREFIXES = (3, 4, 5, 6)

_WORD = re.compile(r"[^\W_]+")
_CACHE = 400_000


def word_terms(word: str) -> list[int]:
    """Hashes of the word and of its proper prefixes."""
    return [zlib.crc32(word.encode("utf-8", "surrogatepass"))] + [
        zlib.crc32(b"^" + word[:k].encode("utf-8", "surrogatepass")) for k in PREFIXES if len(word) > k
    ]


def words_of(text: str | None) -> set[str]:
    return set(_WORD.findall((text or "").lower()))


def text_terms(text: str | None) -> np.ndarray:
    return np.array(sorted({t for w in words_of(text) for t in word_terms(w)}), dtype=np.uint32)


@dataclass
class FactorizationMachine:
    terms: np.ndarray  # sorted hashes
    bias: float
    weights: np.ndarray
    factors: np.ndarray

    @classmethod
    def fit(
        cls, docs: list[np.ndarray], y: np.ndarray, k: int = 6, epochs: int = 250, rate: float = 0.05, prior: float = 0.03, weight: float = 2.0, seed: int = 5
    ) -> FactorizationMachine:
        """docs: sorted hashes of each document's terms. Rows of label 1 count ``weight`` times, as they are the rarer.

        ``prior`` is the penalty against the summed loss, so its part of the mean loss shrinks as rows are added.
        """
        n, pos = len(y), float(y.sum()) if len(y) else 0.0
        if not n or not 0 < pos < n:
            p = min(max(pos / n if n else 0.5, 0.001), 0.999)
            return cls(np.zeros(0, np.uint32), float(np.log(p / (1 - p))), np.zeros(0), np.zeros((0, k)))
        terms, total = np.unique(np.concatenate(docs), return_counts=True)
        found, count = np.unique(np.concatenate([d for d, on in zip(docs, y, strict=True) if on]), return_counts=True)
        with_y = np.zeros(len(terms))
        with_y[np.searchsorted(terms, found)] = count
        # chi-square of term against label
        expect, rest = total * pos / n, n - total
        chi = (with_y - expect) ** 2 * n / np.maximum(total * rest * (pos / n) * (1 - pos / n), 1e-9)
        order = np.lexsort((terms, -chi))[:MAX_TERMS]
        chosen = np.sort(order[(chi[order] > LEAST_CHI) & (total[order] >= LEAST_DOCS)])
        inputs = terms[chosen]
        del terms, total, with_y, expect, rest, chi, order
        own = [np.flatnonzero(np.isin(inputs, d, assume_unique=True)) for d in docs]
        col, row = np.concatenate(own), np.repeat(np.arange(n), [len(x) for x in own])
        d = len(chosen)
        rng = np.random.default_rng(seed)
        w, v, b = np.zeros(d), rng.normal(0, 0.02, (d, k)), float(np.log(pos / (n - pos)))
        state = [np.zeros_like(a) for a in (w, w, v, v)]
        sb = [0.0, 0.0]

        def summed(values: np.ndarray, index: np.ndarray, size: int) -> np.ndarray:
            if values.ndim == 1:
                return np.bincount(index, weights=values, minlength=size)
            return np.stack([np.bincount(index, weights=values[:, j], minlength=size) for j in range(values.shape[1])], axis=1)

        cost, l2 = np.where(y > 0, weight, 1.0) / n, prior / n
        for t in range(1, epochs + 1):
            vc = v[col]
            s = summed(vc, row, n)
            out = b + summed(w[col], row, n) + 0.5 * (s**2 - summed(vc**2, row, n)).sum(axis=1)
            g = (1 / (1 + np.exp(-np.clip(out, -40, 40))) - y) * cost
            gw = summed(g[row], col, d) + l2 * w
            gv = summed(g[row, None] * (s[row] - vc), col, d) + l2 * v
            gb = g.sum()
            for a, grad, m, q in ((w, gw, state[0], state[1]), (v, gv, state[2], state[3])):
                m += 0.1 * (grad - m)
                q += 0.001 * (grad**2 - q)
                a -= rate * (m / (1 - 0.9**t)) / (np.sqrt(q / (1 - 0.999**t)) + 1e-8)
            sb[0] += 0.1 * (gb - sb[0])
            sb[1] += 0.001 * (gb**2 - sb[1])
            b -= rate * (sb[0] / (1 - 0.9**t)) / (np.sqrt(sb[1] / (1 - 0.999**t)) + 1e-8)
        return cls(inputs, b, w, v)

    def score_terms(self, present: list[int]) -> float:
        """Score of a document with these inputs (positions in ``terms``)."""
        out = self.bias
        if present:
            f = self.factors[present]
            out += self.weights[present].sum() + 0.5 * float((f.sum(axis=0) ** 2 - (f**2).sum(axis=0)).sum())
        return float(1 / (1 + np.exp(-min(max(out, -40.0), 40.0))))

    def scorer(self):
        """A function from text to score that remembers words already hashed."""
        place = {int(t): i for i, t in enumerate(self.terms)}
        cache: dict[str, tuple[int, ...]] = {}

        def of(text: str | None) -> float:
            if len(cache) > _CACHE:
                cache.clear()
            present: set[int] = set()
            for w in words_of(text):
                hit = cache.get(w)
                if hit is None:
                    hit = cache[w] = tuple(place[t] for t in word_terms(w) if t in place)
                if hit:
                    present.update(hit)
            return self.score_terms(sorted(present))

        return of


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", folds: int = 3, held_out: int = 1, bound: int = MAX_TRAIN) -> FactorizationMachine:
    """Fit on at most ``bound`` labelled documents outside the held-out fold; only their hashed terms reach the driver."""
    sample = labelled_sample(docs, labels, label, fold("doc_id", folds) != held_out, bound).select("label", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([text_terms(t.as_py()).tobytes() for t in b.column(1)], type=pa.binary())], names=["label", "terms"]
            )

    rows = arrow_map(sample, run, "label int, terms binary").collect()
    return FactorizationMachine.fit([np.frombuffer(r[1], dtype=np.uint32) for r in rows], np.array([r[0] for r in rows], dtype=np.float64))


def score(docs: DataFrame, model: FactorizationMachine) -> DataFrame:
    """doc_id and score of every document. The model, at most MAX_TERMS inputs, is broadcast."""
    kind = dict(docs.dtypes)["doc_id"]
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = held.value.scorer()
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([of(t.as_py()) for t in b.column(1)], type=pa.float64())], names=["doc_id", "score"])

    return arrow_map(docs.select("doc_id", "text"), run, f"doc_id {kind}, score double")


def clean(docs: DataFrame, model: FactorizationMachine, reject: float = 0.7) -> DataFrame:
    """The documents, with all their columns, whose score is below ``reject``."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = held.value.scorer()
        for b in batches:
            yield b.filter(pa.array([of(t.as_py()) < reject for t in b.column(at)], type=pa.bool_()))

    return arrow_map(docs, run, docs.schema)
