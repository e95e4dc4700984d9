"""Language identification of words and texts by a linear-chain conditional random field.

Each word's label scores come from its affixes, its character n-grams and lexicons of frequent words; learned
transitions link neighbours, so a word that could belong to two languages takes the language of its
surroundings, also where a text switches. Forward-backward gives every word's label probabilities; a text's
language is the label with the highest mean probability over its words, and the words' own labels tell where it
switches. A run of letters longer than PIECE, as in scripts without spaces, is several positions of the chain, so that
all of it is read.

The field is learned from words of labelled texts, chained into sequences that switch between languages.

Defined results: a text that is null or has no letters is ``und`` with score 0; so is every text if nothing could be
learned. Repeated rows are each labelled; a text of any length is read whole; an empty table gives an empty result.
Ties go to the smaller label. Columns other than doc_id, text and (in learning) lang are ignored, whatever their names.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graindeck.llm.common import arrow_map, fold

#: Labelled texts that the field is learned from at most, over all languages, and words taken of each.
MAX_TRAIN, TRAIN_WORDS = 3_000, 80
#: Languages that are learned at most: the most frequent ones (a bound of the model's size; others cannot be predicted).
MAX_LABELS = 256

UNKNOWN = "und"
BITS = 15
#: Characters of the longest position of a chain.
PIECE = 16
_WORD = regex.compile(rf"\p{{L}}[\p{{L}}\p{{M}}]{{0,{PIECE - 1}}}")
_CACHE = 300_000


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def word_features(words: list[str]) -> np.ndarray:
    """Hashed features, a row a word; 0 stands for none."""
    n, mask = len(words), np.uint64((1 << BITS) - 1)
    size = np.array([len(w) for w in words])
    head = np.array(words, dtype=f"U{PIECE}").view(np.uint32).reshape(n, PIECE).astype(np.uint64)
    tail = np.array([w[-4:][::-1] for w in words], dtype="U4").view(np.uint32).reshape(n, 4).astype(np.uint64)

    def hashed(kind: int, chars: list[np.ndarray], there: np.ndarray) -> np.ndarray:
        h = np.full(n, 1469598103 + kind * 7919, dtype=np.uint64)
        for c in chars:
            h = (h ^ c) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        return np.where(there, (h & mask) | np.uint64(1), np.uint64(0))

    out = []
    for k in range(1, 5):
        out.append(hashed(k, [head[:, i] for i in range(k)], size >= k))
        out.append(hashed(10 + k, [tail[:, i] for i in range(k)], size >= k))
    for k in (2, 3):
        for i in range(PIECE - k + 1):
            out.append(hashed(20 + k, [head[:, i + j] for j in range(k)], size >= i + k))
    return np.stack(out, axis=1).astype(np.int32)


def emissions(features: np.ndarray, lexicon: np.ndarray, weights: np.ndarray, lexicon_weights: np.ndarray) -> np.ndarray:
    out = lexicon_weights[lexicon]
    for j in range(features.shape[1]):
        out = out + weights[features[:, j]]
    return out


def marginals(e: np.ndarray, trans: np.ndarray, first: np.ndarray, starts: np.ndarray, block: int = 128) -> np.ndarray:
    """Label probabilities of each position of chained sequences, by forward-backward.

    e: positive label potentials (n, k); trans: potentials (k, k); first: potentials of a sequence's first label;
    starts: where a sequence begins. Blocks of positions are summarised by matrices, so that the passes run over all
    blocks at once; the result is the exact one.
    """
    n, k = e.shape
    blocks = -(-n // block)
    pad = blocks * block - n
    e = np.concatenate([e, np.ones((pad, k))]).reshape(blocks, block, k)
    s = np.concatenate([starts, np.ones(pad, dtype=bool)]).reshape(blocks, block)
    across = np.broadcast_to(np.eye(k), (blocks, k, k)).copy()
    for t in range(block):
        step = (across.reshape(-1, k) @ trans).reshape(blocks, k, k)
        if s[:, t].any():
            step = np.where(s[:, t, None, None], across.sum(axis=2, keepdims=True) * first, step)
        across = step * e[:, t, None, :]
        across /= across.max(axis=(1, 2), keepdims=True)
    into, out, a, b = np.empty((blocks, k)), np.empty((blocks, k)), np.ones(k), np.ones(k)
    for c in range(blocks):
        into[c] = a
        a = a @ across[c]
        a /= a.sum()
    for c in range(blocks - 1, -1, -1):
        out[c] = b
        b = across[c] @ b
        b /= b.sum()
    forward, a = np.empty((blocks, block, k)), into
    for t in range(block):
        step = a @ trans
        if s[:, t].any():
            step = np.where(s[:, t, None], a.sum(axis=1, keepdims=True) * first, step)
        a = step * e[:, t]
        a /= a.sum(axis=1, keepdims=True)
        forward[:, t] = a
    b = out
    for t in range(block - 1, -1, -1):
        forward[:, t] *= b
        v = e[:, t] * b
        b = v @ trans.T
        if s[:, t].any():
            b = np.where(s[:, t, None], (v @ first)[:, None], b)
        b /= b.sum(axis=1, keepdims=True)
    out = forward.reshape(-1, k)[:n]
    return out / out.sum(axis=1, keepdims=True)


@dataclass
class LanguageField:
    labels: list[str]
    weights: np.ndarray
    lexicon: dict[str, int]
    lexicon_weights: np.ndarray
    trans: np.ndarray
    first: np.ndarray

    @classmethod
    def fit(
        cls, texts: list[tuple[str, list[str]]], epochs: int = 60, rate: float = 0.08, l2: float = 1e-6, sequences: int = 2500, length: int = 40,
        seed: int = 3
    ) -> LanguageField:
        """texts: label and words of each."""
        labels = sorted({y for y, w in texts if w})
        k, rng = len(labels), np.random.default_rng(seed)
        if k < 2:
            return cls(labels, np.zeros((1 << BITS, k)), {}, np.zeros((1, k)), np.zeros((k, k)), np.zeros(k))
        by = {y: [w for z, w in texts if z == y and w] for y in labels}
        counts = {y: Counter(w for ws in by[y] for w in ws) for y in labels}
        share = {y: sum(c.values()) for y, c in counts.items()}
        lexicon: dict[str, int] = {}
        for j, y in enumerate(labels):  # frequent words that are likelier in this language than in any other
            for w, c in counts[y].most_common(300):
                if c >= 3 and c / share[y] > max(counts[z][w] / share[z] for z in labels if z != y):
                    lexicon[w] = j + 1
        words: list[str] = []
        truth = np.empty((sequences, length), dtype=np.int64)
        for q in range(sequences):
            done = 0
            while done < length:
                j = int(rng.integers(k))
                text = by[labels[j]][int(rng.integers(len(by[labels[j]])))]
                at = int(rng.integers(len(text)))
                part = text[at : at + min(int(rng.integers(4, 30)), length - done)]
                truth[q, done : done + len(part)] = j
                words += part
                done += len(part)
        distinct, which = np.unique(np.array(words, dtype=object), return_inverse=True)
        which = which.reshape(sequences, length)
        feats = word_features(list(distinct))
        lex = np.array([lexicon.get(w, 0) for w in distinct])
        par = [np.zeros((1 << BITS, k)), np.zeros((k + 1, k)), np.eye(k) * 2.0, np.zeros(k)]
        state = [(np.zeros_like(p), np.zeros_like(p)) for p in par]
        columns = [np.ascontiguousarray(feats[:, j]) for j in range(feats.shape[1])]
        hot = np.eye(k)[truth]
        pairs = np.bincount((truth[:, :-1] * k + truth[:, 1:]).ravel(), minlength=k * k).reshape(k, k)
        total = sequences * length
        for step in range(1, epochs + 1):
            w, wl, tr, st = par
            em = emissions(feats, lex, w, wl)[which]
            e = np.exp(em - em.max(axis=2, keepdims=True))
            m = np.exp(tr)
            alpha, beta = np.empty_like(e), np.ones_like(e)
            alpha[:, 0] = e[:, 0] * np.exp(st)
            alpha[:, 0] /= alpha[:, 0].sum(axis=1, keepdims=True)
            for t in range(1, length):
                alpha[:, t] = (alpha[:, t - 1] @ m) * e[:, t]
                alpha[:, t] /= alpha[:, t].sum(axis=1, keepdims=True)
            expected = np.zeros((k, k))
            for t in range(length - 2, -1, -1):
                v = e[:, t + 1] * beta[:, t + 1]
                beta[:, t] = v @ m.T
                z = (alpha[:, t] * beta[:, t]).sum(axis=1, keepdims=True)
                expected += m * ((alpha[:, t] / z).T @ v)
                beta[:, t] /= beta[:, t].sum(axis=1, keepdims=True)
            gamma = alpha * beta
            gamma /= gamma.sum(axis=2, keepdims=True)
            diff = (gamma - hot) / total
            per_word = np.stack([np.bincount(which.ravel(), weights=diff[:, :, j].ravel(), minlength=len(distinct)) for j in range(k)], axis=1)
            gw = np.zeros_like(w)
            for j in range(k):
                for c in columns:
                    gw[:, j] += np.bincount(c, weights=per_word[:, j], minlength=1 << BITS)
            gl = np.stack([np.bincount(lex, weights=per_word[:, j], minlength=k + 1) for j in range(k)], axis=1)
            gw[0] = 0
            gl[0] = 0
            grads = [gw + l2 * w, gl + l2 * wl, (expected - pairs) / total + l2 * tr, diff[:, 0].sum(axis=0)]
            for p, g, (a, b) in zip(par, grads, state, strict=True):
                a += 0.1 * (g - a)
                b += 0.01 * (g**2 - b)
                p -= rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-8)
        return cls(labels, par[0].astype(np.float32), lexicon, par[1], par[2], par[3])

    def potentials(self, words: list[str]) -> np.ndarray:
        em = emissions(word_features(words), np.array([self.lexicon.get(w, 0) for w in words]), self.weights, self.lexicon_weights)
        return np.exp(em - em.max(axis=1, keepdims=True))

    def tagger(self):
        """A function from texts to the word label probabilities of all of them and their word counts."""
        cache: dict[str, int] = {}
        known = np.zeros((0, len(self.labels)))
        m, first = np.exp(self.trans), np.exp(self.first)

        def of(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
            nonlocal known
            split = [words_of(t) for t in texts]
            flat = [w for ws in split for w in ws]
            sizes = np.array([len(ws) for ws in split], dtype=np.int64)
            if len(cache) > _CACHE:
                cache.clear()
                known = known[:0]
            new = [w for w in dict.fromkeys(flat) if w not in cache]
            for i in range(0, len(new), 50_000):
                part = new[i : i + 50_000]
                known = np.concatenate([known, self.potentials(part)])
                cache.update(zip(part, range(len(cache), len(cache) + len(part)), strict=True))
            if not flat:
                return np.zeros((0, len(self.labels))), sizes
            starts = np.zeros(len(flat), dtype=bool)
            starts[(np.cumsum(sizes) - sizes)[sizes > 0]] = True
            return marginals(known[[cache[w] for w in flat]], m, first, starts), sizes

        return of

    def predictor(self):
        """A function from texts to (label, score, words, switches, shares): a switch is a word whose own label is not the
        one before it; shares are the words' labels by name, for those that occur."""
        tag = self.tagger()

        def of(texts: list[str | None]) -> list[tuple[str, float, int, int, dict[str, float]]]:
            if len(self.labels) < 2:  # nothing to tell apart
                words = [len(words_of(t)) for t in texts]
                only = self.labels[0] if self.labels else UNKNOWN
                return [(only, float(only != UNKNOWN), n, 0, {only: 1.0} if only != UNKNOWN else {}) if n else (UNKNOWN, 0.0, 0, 0, {}) for n in words]
            p, sizes = tag(texts)
            ends, out = np.cumsum(sizes), []
            for n, end in zip(sizes.tolist(), ends.tolist(), strict=True):
                if not n:
                    out.append((UNKNOWN, 0.0, 0, 0, {}))
                    continue
                own = p[end - n : end]
                mean, each = own.mean(axis=0), own.argmax(axis=1)
                counts = np.bincount(each, minlength=len(self.labels))
                j = int(mean.argmax())
                shares = {self.labels[i]: float(counts[i] / n) for i in np.flatnonzero(counts)}
                out.append((self.labels[j], min(1.0, float(mean[j])), n, int((each[1:] != each[:-1]).sum()), shares))
            return out

        return of


def fit(docs: DataFrame, folds: int = 4, held_out: int = 2, bound: int = MAX_TRAIN) -> LanguageField:
    """Learn from at most ``bound`` texts with a language, outside the held-out fold.

    Each language gives as many as any other, those whose ids come first by hash; of each text up to TRAIN_WORDS
    words in a row reach the driver, from a place set by the id's hash.
    """
    train = docs.where((fold("doc_id", folds) != held_out) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = {r[0]: r[1] for r in train.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MAX_LABELS).collect()}
    if not sizes:
        return LanguageField.fit([])
    each = max(1, bound // len(sizes))
    h = F.xxhash64("doc_id", F.lit(29))
    share = F.coalesce(*[F.when(F.col("lang") == y, F.lit(min(1.0, 2.0 * each / n))) for y, n in sizes.items()])
    picked = train.where((F.pmod(h, F.lit(1 << 30)) / F.lit(float(1 << 30))) < share)
    # repeated ids count once, so there are no more rows than ids
    sample = picked.groupBy("doc_id").agg(
        F.min_by("lang", F.struct("text", "lang")).alias("lang"), F.min("text").alias("text")
    ).select("lang", "text", h.alias("h"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for t, x in zip(b.column(1), b.column(2), strict=True):
                ws = words_of(t.as_py())
                at = x.as_py() % max(1, len(ws) - TRAIN_WORDS + 1)
                out.append(" ".join(ws[at : at + TRAIN_WORDS]))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(out, type=pa.string())], names=["lang", "h", "words"])

    rows = sorted(arrow_map(sample, run, "lang string, h bigint, words string").collect(), key=lambda r: (r[1], r[0], r[2]))
    taken, texts = Counter(), []
    for y, _, words in rows:
        if words and taken[y] < each:
            taken[y] += 1
            texts.append((y, words.split(" ")))
    return LanguageField.fit(texts)


def predict(docs: DataFrame, model: LanguageField) -> DataFrame:
    """doc_id, lang_pred, score, n_words, n_switches and shares (of the words' labels) of every document. The model, whose
    size BITS and MAX_LABELS bound, is broadcast."""
    kind = dict(docs.dtypes)["doc_id"]
    held = docs.sparkSession.sparkContext.broadcast(model)
    kinds = (pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.map_(pa.string(), pa.float64()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = held.value.predictor()
        for b in batches:
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                rows = of(part.column(1).to_pylist())
                columns = [pa.array([list(r[j].items()) if j == 4 else r[j] for r in rows], type=k) for j, k in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], names=["doc_id", "lang_pred", "score", "n_words", "n_switches", "shares"])

    return (
        arrow_map(
            docs.select("doc_id", "text"), run, f"doc_id {kind}, lang_pred string, score double, n_words bigint, n_switches bigint, shares map<string,double>"
        )
    )


def label_words(docs: DataFrame, model: LanguageField) -> DataFrame:
    """doc_id and words (word, label, p) of every document, in the order of the text."""
    kind = dict(docs.dtypes)["doc_id"]
    held = docs.sparkSession.sparkContext.broadcast(model)
    words = pa.list_(pa.struct([("word", pa.string()), ("label", pa.string()), ("p", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labels, tag = held.value.labels, held.value.tagger()
        for b in batches:
            out = []
            for t in b.column(1):
                own = words_of(t.as_py())
                p = tag([t.as_py()])[0] if len(labels) > 1 else np.ones((len(own), len(labels)))
                out.append(
                    [
                        {"word": w, "label": labels[int(x.argmax())] if labels else UNKNOWN, "p": float(x.max(initial=0.0))} for w,
                        x in zip(own, p, strict=True)
                    ]
                )
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, type=words)], names=["doc_id", "words"])

    return arrow_map(docs.select("doc_id", "text"), run, f"doc_id {kind}, words array<struct<word: string, label: string, p: double>>")
