"""Quality classifier: a sparse rule ensemble.

Shallow boosted trees over text statistics propose conjunctive rules (every path from a root to a node), a lasso
logistic regression keeps few of them, and what is kept is compiled to one Spark column expression.

Defined results: a null or empty text has all statistics 0 and is scored like any other; repeated rows are each
scored, and count once in the sample; a value equal to a threshold (a tie) is not above it; a text of any length is read
whole; an empty table gives an empty result; without labels of both kinds the score is the training share of label 1
(0.5 without any label). Columns other than doc_id and text are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graindeck.llm.common import arrow_map, fold, labelled_sample

#: Labelled documents that the model is fitted on at most.
MAX_TRAIN = 20_000

STATS = ("n_words", "word_len", "symbols", "marks", "upper", "digits", "letters", "distinct", "top_word", "dup_lines", "line_words", "repeats")

_DELETE = {
    "symbols": b"#*$%&|<>",
    "marks": bytes(c for c in range(33, 127) if not chr(c).isalnum()),
    "upper": bytes(range(65, 91)),
    "digits": b"0123456789",
    "letters": bytes([*range(65, 91), *range(97, 123), *range(128, 256)]),
}


def statistics(text: str | None) -> list[float]:
    """The statistics in the order of STATS; shares are taken of the UTF-8 bytes or of the words."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    n, size = len(words), max(len(raw), 1)
    share = {k: (len(raw) - len(raw.translate(None, d))) / size for k, d in _DELETE.items()}
    counts: dict[bytes, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    lines = [x for x in raw.split(b"\n") if x.strip()]
    same = sum(map(bytes.__eq__, words, words[1:]))
    return [
        float(n), sum(map(len, words)) / max(n, 1), share["symbols"], share["marks"], share["upper"], share["digits"], share["letters"],
        len(counts) / max(n, 1), max(
            counts.values(), default=0
        ) / max(n, 1), 1 - len(set(lines)) / max(len(lines), 1), n / max(len(lines), 1), same / max(n, 1),
    ]


def with_statistics(df: DataFrame) -> DataFrame:
    """Replace the column text, the last one, by the statistics; the columns before it are kept."""
    keep = df.columns[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = np.array([statistics(t.as_py()) for t in b.column(len(keep))], dtype=np.float64).reshape(-1, len(STATS))
            yield pa.RecordBatch.from_arrays([b.column(i) for i in range(len(keep))] + [pa.array(rows[:, i]) for i in range(len(STATS))], names=[*keep, *STATS])

    kinds = dict(df.dtypes)
    return arrow_map(df, run, ", ".join([f"`{c}` {kinds[c]}" for c in keep] + [f"{s} double" for s in STATS]))


Rule = tuple[tuple[int, bool, float], ...]  # conditions: feature, whether above, threshold


def covers(rule: Rule, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), dtype=bool)
    for j, above, t in rule:
        out &= (x[:, j] > t) if above else (x[:, j] <= t)
    return out


def _split(x: np.ndarray, r: np.ndarray, cuts: list[np.ndarray], features: np.ndarray, least: int) -> tuple[int, float] | None:
    """The feature and threshold that lower the squared error of ``r`` most."""
    best, found, total, n = 1e-9, None, r.sum(), len(r)
    for j in features:
        if not len(cuts[j]):
            continue
        at = np.searchsorted(cuts[j], x[:, j], side="left")  # values up to cuts[k] fall at k or below
        count = np.bincount(at, minlength=len(cuts[j]) + 1).cumsum()[:-1]
        left = np.bincount(at, weights=r, minlength=len(cuts[j]) + 1).cumsum()[:-1]
        ok = (count >= least) & (n - count >= least)
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = np.where(ok, left**2 / count + (total - left) ** 2 / (n - count) - total**2 / n, -1)
        if gain.max() > best:
            best, found = gain.max(), (int(j), float(cuts[j][gain.argmax()]))
    return found


def grow_rules(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 3, rate: float = 0.3, seed: int = 11) -> list[Rule]:
    """Boosted regression trees on logistic residuals; the paths to all their nodes, without repeats."""
    rng, rules = np.random.default_rng(seed), {}
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0.01, 0.99, 50)))[:-1] for j in range(x.shape[1])]
    cuts = [np.unique(np.r_[c, u[:-1][: 60]]) if len(u := np.unique(x[:, j])) <= 60 else c for j, c in enumerate(cuts)]
    score = np.full(len(y), np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
    for _ in range(trees):
        residual = y - 1 / (1 + np.exp(-score))
        rows = rng.random(len(y)) < 0.7
        features = rng.permutation(x.shape[1])[: max(2, x.shape[1] * 2 // 3)]
        open_nodes: list[tuple[Rule, np.ndarray]] = [((), np.ones(len(y), dtype=bool))]
        for level in range(depth):
            following = []
            for rule, inside in open_nodes:
                own = inside & rows
                cut = _split(x[own], residual[own], cuts, features, 5) if own.sum() >= 10 else None
                if cut is None:
                    score[inside] += rate * 4 * residual[inside].mean() if inside.any() else 0
                    continue
                for above in (False, True):
                    child = (*rule, (cut[0], above, cut[1]))
                    rules[tuple(sorted(child))] = None
                    following.append((child, inside & ((x[:, cut[0]] > cut[1]) == above)))
            open_nodes = following
        for _, inside in open_nodes:
            if inside.any():
                score[inside] += rate * 4 * residual[inside].mean()
    return list(rules)


def lasso_logistic(z: np.ndarray, y: np.ndarray, penalty: float, steps: int = 600) -> tuple[np.ndarray, float]:
    """Accelerated proximal gradient for the mean logistic loss plus ``penalty`` times the weights' absolute sum."""
    n, d = z.shape
    w, b = np.zeros(d), float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
    v, c, t = w.copy(), b, 1.0
    probe = np.ones(d) / np.sqrt(d)
    for _ in range(20):  # the largest eigenvalue of z'z / n
        probe = z.T @ (z @ probe) / n
        norm = np.linalg.norm(probe) or 1.0
        probe /= norm
    rate = 4 / (norm * 1.05 + 1)
    for _ in range(steps):
        g = 1 / (1 + np.exp(-(z @ v + c))) - y
        w2 = v - rate * (z.T @ g) / n
        w2 = np.sign(w2) * np.maximum(np.abs(w2) - rate * penalty, 0)
        b2 = c - rate * g.mean()
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, c = w2 + (t - 1) / t2 * (w2 - w), b2 + (t - 1) / t2 * (b2 - b)
        w, b, t = w2, b2, t2
    return w, b


@dataclass
class RuleEnsemble:
    bias: float
    rules: list[tuple[Rule, float]]

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, penalty: float = 1e-3) -> RuleEnsemble:
        if not len(y) or y.min() == y.max():
            p = min(max(float(y.mean()) if len(y) else 0.5, 0.001), 0.999)
            return cls(float(np.log(p / (1 - p))), [])
        kept, seen = [], set()
        for rule in grow_rules(x, y):
            on = covers(rule, x)
            key = on.tobytes() if on.mean() <= 0.5 else (~on).tobytes()
            if 0 < on.sum() < len(y) and key not in seen:
                seen.add(key)
                kept.append((rule, on))
        z = np.array([on for _, on in kept], dtype=np.float64).T
        spread = np.maximum(z.std(axis=0), 0.02)
        w, b = lasso_logistic((z - z.mean(axis=0)) / spread, y, penalty)
        w = w / spread
        return cls(b - float(w @ z.mean(axis=0)), [(rule, float(a)) for (rule, _), a in zip(kept, w, strict=True) if a])

    def column(self) -> Column:
        """The score, 0 to 1, as an expression over the columns of STATS."""
        total = F.lit(self.bias)
        for rule, weight in self.rules:
            on = F.lit(True)
            for j, above, t in rule:
                on = on & ((F.col(STATS[j]) > F.lit(t)) if above else (F.col(STATS[j]) <= F.lit(t)))
            total = total + F.when(on, F.lit(weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))

    def predict(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.bias)
        for rule, weight in self.rules:
            total += weight * covers(rule, x)
        return 1 / (1 + np.exp(-total))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", folds: int = 5, held_out: int = 0, bound: int = MAX_TRAIN) -> RuleEnsemble:
    """Fit on at most ``bound`` labelled documents outside the held-out fold; only their statistics reach the driver."""
    sample = labelled_sample(docs, labels, label, fold("doc_id", folds) != held_out, bound)
    rows = with_statistics(sample.select("label", "text")).collect()
    x = np.array([r[1:] for r in rows], dtype=np.float64).reshape(-1, len(STATS))
    return RuleEnsemble.fit(x, np.array([r[0] for r in rows], dtype=np.float64))


def score(docs: DataFrame, model: RuleEnsemble) -> DataFrame:
    """doc_id, score and the statistics of every document."""
    return with_statistics(docs.select("doc_id", "text")).select("doc_id", model.column().alias("score"), *STATS)
