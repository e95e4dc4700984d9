"""Secret scans: patterns, and character Markov models of random strings and of ordinary identifiers.

Two second-order models over characters, one of random strings and one of ordinary tokens, give log-likelihoods of a
candidate token; where their mean ratio a character passes a cutoff, the token is a secret that no pattern names. A
transition after two characters falls back on the one after the last, and that on the shares of the characters. Every
maximal token of LEAST or more characters is judged, with or without digits; shorter ones are not told apart from
ordinary words and left alone, unless a pattern names them.

Defined results: a null text is empty and has no spans; repeated rows are each scanned; an empty table gives an
empty result; of spans that start together the kind listed first in KINDS comes first (ties); a text of any length is
scanned whole, in time linear in it; columns other than doc_id and text are ignored or kept, whatever their names.
Offsets are code points.
"""

from __future__ import annotations

import hashlib
import random
import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graindeck.llm.common import arrow_map, one_text_each

#: Documents that the models are trained on at most, and the words and secrets that each of them gives at most.
MAX_TRAIN, WORDS_EACH, SECRETS_EACH = 2_000, 40, 20

#: Characters of the shortest token that the models judge, and the lengths from which a cutoff of its own holds.
LEAST = 16
BANDS = (LEAST, 18, 20, 24, 32)

KINDS = ("assign", "access", "hex", "markov")

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_TOKEN = re.compile(rf"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{{{LEAST},}}={{0,2}}")

Span = tuple[int, int, int]  # start, place in KINDS, end


def base_spans(text: str) -> list[Span]:
    """Spans of the three patterns, leftmost and non-overlapping within a kind, those that fail their length dropped."""
    out = [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(out)


#: Characters of tokens; all others share the last place.
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_-="
_PLACE = {c: i for i, c in enumerate(ALPHABET)}
_N = len(ALPHABET) + 1


def codes(token: str) -> np.ndarray:
    return np.array([_PLACE.get(c, _N - 1) for c in token], dtype=np.int64)


def transition_model(tokens: list[str], smooth: float = 0.5, floor: float = 0.05) -> np.ndarray:
    """Log probabilities (before last, last, next) of a character; _N stands for the start.

    Counts after two characters are smoothed by those after one, these by the characters' own shares, and all are mixed
    with a ``floor`` of equal shares, so that one unseen transition does not decide a token.
    """
    size = _N + 1
    counts = np.zeros((size, size, _N))
    for t in tokens:
        c = np.r_[_N, _N, codes(t)]
        np.add.at(counts, (c[:-2], c[1:-1], c[2:]), 1)
    once = counts.sum(axis=0)
    share = (once.sum(axis=0) + smooth) / (once.sum() + smooth * _N)
    once += 4 * share
    once /= once.sum(axis=1, keepdims=True)
    counts += 8 * once
    counts /= counts.sum(axis=2, keepdims=True)
    return np.log((1 - floor) * counts + floor / _N)


def random_strings(n: int, seed: int = 7) -> list[str]:
    """Labelled samples of random strings: hexadecimal, alphanumeric and base64 alphabets."""
    rng = random.Random(seed)
    kinds = ("0123456789abcdef", ALPHABET[:62], ALPHABET[:64], ALPHABET[26:62], ALPHABET[:26] + ALPHABET[52:62])
    return ["".join(rng.choice(kinds[i % len(kinds)]) for _ in range(rng.randint(16, 48))) for i in range(n)]


#: Words of names in code, ordinary in any corpus.
COMMON = (
    "access account action address application argument array attribute block buffer build button cache channel character check class client code "
    "collection color column command "
    "comment component config configuration connection content context control count current database date default definition description detail "
    "directory document element error event "
    "example exception expression factory field file filter format from function global group handler header height helper identifier image index "
    "information input instance interface "
    "international internal item label language layout length level library list local location manager message method model module name network number "
    "object operation option order "
    "output package page parameter parent password path pattern position process property provider query range record reference region register relation "
    "request resource response result "
    "section security selection sequence server service session setting source state status storage string structure style system table target template "
    "text thread time transaction "
    "transform translation type update user utility validation value variable version view width window worker"
).split()


def joined_words(words: list[str], n: int, seed: int = 8) -> list[str]:
    """Labelled samples of identifiers: words joined as names in code and addresses are."""
    rng = random.Random(seed)
    words = words or COMMON
    out = []
    for i in range(n):
        parts = [rng.choice(words) for _ in range(rng.randint(1, 4))]
        if i % 4 == 0:
            out.append("_".join(parts))
        elif i % 4 == 1:
            out.append("".join(p.capitalize() for p in parts))
        elif i % 4 == 2:
            out.append("-".join(parts) + str(rng.randint(0, 2030)))
        else:
            out.append("/".join(parts))
    return out


def plain_strings(words: list[str], n: int, seed: int = 10) -> list[str]:
    """Labelled samples of other ordinary tokens: names of constants, paths with numbers, times, numbers, and rules."""
    rng = random.Random(seed)
    words = words or COMMON
    digits = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    out = []
    for i in range(n):
        parts = [rng.choice(words) for _ in range(rng.randint(2, 4))]
        day = (str(rng.randint(1900, 2099)), f"{rng.randint(1, 12):02d}", f"{rng.randint(1, 31):02d}")
        clock = tuple(f"{rng.randint(0, 59):02d}" for _ in range(3))
        if i % 6 == 0:
            out.append("_".join(parts).upper())
        elif i % 6 == 1:
            out.append("/".join(x for p in parts for x in (p, digits(rng.randint(1, 4)))))
        elif i % 6 == 2:
            out.append("-".join((*day, *clock)) if i % 12 == 2 else "".join(day) + "T" + "".join(clock) + "Z")
        elif i % 6 == 3:
            out.append(digits(rng.randint(16, 30)) if i % 12 == 3 else "-".join(digits(rng.randint(2, 5)) for _ in range(rng.randint(4, 6))))
        elif i % 6 == 4:
            out.append(rng.choice("-_/+") * rng.randint(16, 60))
        else:
            out.append(rng.choice(ALPHABET[:-1]) * rng.randint(16, 40) if i % 12 == 5 else ("+" + "-" * rng.randint(2, 12)) * rng.randint(2, 4) + "+")
    return out


@dataclass
class MarkovScanner:
    random_log: np.ndarray
    ordinary_log: np.ndarray
    cutoffs: tuple[float, ...]  # by BANDS

    @classmethod
    def fit(cls, secrets: list[str], words: list[str], least: float = 0.25, false_rate: float = 0.001) -> MarkovScanner:
        """The cutoff of each of BANDS is passed by a share ``false_rate`` of other ordinary samples of its lengths, and
        not below ``least``."""
        ordinary = lambda n, seed: [
            *joined_words(words, n, seed), *joined_words(COMMON, n // 2, seed + 1), *plain_strings(words, n // 4, seed + 2),
            *plain_strings(COMMON, n // 4, seed + 3)
        ]
        out = cls(transition_model(random_strings(4000) + secrets), transition_model(ordinary(8000, 8) + words), ())
        others: list[list[float]] = [[] for _ in BANDS]
        for x in ordinary(20000, 11):
            if len(x) >= LEAST:
                others[bisect_right(BANDS, len(x)) - 1].append(out.ratio(x))
        return cls(out.random_log, out.ordinary_log, tuple(max([least, *sorted(o)[-1 - int(false_rate * len(o)) :][:1]]) for o in others))

    @property
    def cutoff(self) -> float:
        """The largest cutoff: beyond it a token of any length is a secret."""
        return max(self.cutoffs)

    def judged(self, token: str) -> bool:
        """Whether a token of LEAST or more characters is a random string."""
        return self.ratio(token) >= self.cutoffs[bisect_right(BANDS, len(token)) - 1]

    def ratio(self, token: str) -> float:
        """Mean log-likelihood ratio a character, random against ordinary; the third and later of equal characters in
        a row, as in a rule or filler, never speak for random."""
        c = codes(token)
        if not len(c):
            return 0.0
        last = np.r_[_N, c[:-1]]
        before = np.r_[_N, last[:-1]]
        each = self.random_log[before, last, c] - self.ordinary_log[before, last, c]
        again = np.r_[False, c[1:] == c[:-1]]
        return float(np.where(again & np.r_[False, again[:-1]], np.minimum(each, 0), each).mean())

    def spans(self, text: str) -> tuple[list[Span], list[Span]]:
        """Base spans, and all spans: the base ones and tokens beyond the cutoff that overlap none of them."""
        base = base_spans(text)
        taken = merged(base)
        more, at = [], 0
        for m in _TOKEN.finditer(text):
            while at < len(taken) and taken[at][1] <= m.start():
                at += 1
            if (at == len(taken) or taken[at][0] >= m.end()) and self.judged(m.group()):
                more.append((m.start(), 3, m.end()))
        return base, sorted(base + more)


def written(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def merged(spans: list[Span]) -> list[tuple[int, int]]:
    """The union of the spans as stretches that do not overlap, in order; spans that only touch stay apart."""
    out: list[tuple[int, int]] = []
    for s, _, e in sorted(spans):
        if out and s < out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], e))
        else:
            out.append((s, e))
    return out


def redacted(text: str, spans: list[Span], mark: str = "[REDACTED]") -> str:
    """The text with the union of the spans replaced, each stretch by one mark."""
    out, at = [], 0
    for s, e in merged(spans):
        out += [text[at:s], mark]
        at = e
    return "".join([*out, text[at:]])


def fit(docs: DataFrame, bound: int = MAX_TRAIN) -> MarkovScanner:
    """Train on samples labelled by the patterns: their secrets are random strings, other words ordinary.

    At most ``bound`` documents, those whose ids come first by hash (repeated ids count once), give up to WORDS_EACH words
    and SECRETS_EACH secrets each. What is scanned is bounded by nothing.
    """
    picked = docs.where("doc_id is not null").groupBy("doc_id").agg(F.lit(1).alias("one")).orderBy(F.xxhash64("doc_id", F.lit(31)), "doc_id").limit(bound)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            secrets, words = [], []
            for t in b.column(0):
                text = t.as_py() or ""
                found = base_spans(text)
                secrets.append([_ASSIGN.match(text[s:e])[2] if k == 0 else text[s:e] for s, k, e in found][:SECRETS_EACH])
                plain = re.findall(r"[A-Za-z]{3,20}", redacted(text, found, " "))
                words.append(plain[:: max(1, len(plain) // WORDS_EACH)][:WORDS_EACH])
            kind = pa.list_(pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(secrets, type=kind), pa.array(words, type=kind)], names=["secrets", "words"])

    rows = arrow_map(one_text_each(docs, picked).select("text"), run, "secrets array<string>, words array<string>").collect()
    secrets = sorted(x for r in rows for x in r[0] if re.search("[0-9]", x) and len(x) >= 12)
    return MarkovScanner.fit(secrets, sorted(x for r in rows for x in r[1]))


def scan(docs: DataFrame, model: MarkovScanner) -> DataFrame:
    """doc_id, counts by base kind, the digest of the base spans and all spans of every document."""
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, digest, spans = [[], [], [], []], [], []
            for t in b.column(1):
                base, every = model.spans(t.as_py() or "")
                for i in range(4):
                    n[i].append(sum(k == i for _, k, _ in every))
                digest.append(hashlib.sha256(written(base).encode()).hexdigest())
                spans.append(written(every))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *[pa.array(x, type=pa.int64()) for x in n], pa.array(digest, type=pa.string()), pa.array(spans, type=pa.string())],
                names=["doc_id", "n_assign", "n_access", "n_hex", "n_markov", "base_sha256", "spans"]
            )

    return (
        arrow_map(
            docs.select("doc_id", "text"), run,
            f"doc_id {kind}, n_assign bigint, n_access bigint, n_hex bigint, n_markov bigint, base_sha256 string, spans string"
        )
    )


def redact(docs: DataFrame, model: MarkovScanner) -> DataFrame:
    """The documents with every span replaced by a mark; a null text stays null. All columns are kept."""
    names = docs.columns
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [None if (x := t.as_py()) is None else redacted(x, model.spans(x)[1]) for t in b.column(at)]
            columns = [b.column(i) for i in range(len(names))]
            columns[at] = pa.array(texts, type=pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=names)

    out = arrow_map(docs, run, docs.schema)
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in names else out
