"""Quality rules with risk-controlled thresholds, in DataFrame functions only.

Each rule rejects a document whose statistic is above a cutoff. Labelled documents set the cutoffs: in a stratum
(a language), a cutoff is admissible if the exact binomial upper bound of its false rejections, of documents labelled
good, is at most the rule's share of ``risk``; the level is corrected for the number of strata, rules and cutoffs
tried (Bonferroni), so with probability 1 - ``level`` no stratum loses more than ``risk`` of its good documents. Of
the admissible cutoffs the one is taken that separates the labels best, a lost share of good documents weighing LOSS
times a caught share of bad ones; without one, the rule is off there, as it is in a stratum without labels.

Copies are no independent trials: a text counts once in its stratum. Labels of the documents that ``held_out`` marks
set no cutoff, so the false rejections among them measure what is promised. There are as many strata as languages,
worked out side by side; nothing is collected.

Defined results: a null text has no words, so its counts are 0 and it fails the base rule; an empty text likewise;
repeated rows are each judged; documents without a label take part in no bound; a text labelled more than once counts
as good if any of its labels says so; a null language is the stratum ""; of cutoffs that separate equally well the
largest is taken; a text of any length is judged whole; columns other than doc_id, lang and text are ignored, whatever
their names; an empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graindeck.llm.common import SPACE_WORD, Run

WINDOW = 8

RULES = ("symbol_rate", "dup_line_rate", "repeat_rate", "upper_rate")

#: Cutoffs tried for each rule.
GRID = tuple(x / 200 for x in (1, 2, 4, 6, 10, 15, 20, 30, 40, 50, 60, 80, 100, 120, 140, 160, 180))

#: Weight of the share of good documents lost, against that of bad ones caught.
LOSS = 5

#: First digits of the SHA-256 of a doc_id whose labels set no cutoff: three of sixteen.
TEST_DIGITS = ("0", "1", "2")


def with_counts(docs: DataFrame, keep: list[str]) -> DataFrame:
    """``keep``, a hash of the text and its counts: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_upper."""
    long = lambda c: c.cast("long")
    t = docs.select(*keep, F.coalesce("text", F.lit("")).alias("_t"))
    t = t.withColumn("_w", F.filter(F.split("_t", r"[\x20\x09-\x0D]+"), lambda w: w != ""))
    t = t.withColumn("_lines", F.filter(F.split("_t", "\n"), lambda x: x.rlike(SPACE_WORD)))
    t = t.select(
        *keep, F.xxhash64("_t").alias("text_hash"), "_w", F.transform("_w", lambda w: F.xxhash64(w)).alias("_h"), long(F.size("_w")).alias("n_words"),
        long(F.aggregate("_w", F.lit(0), lambda a, w: a + F.char_length(w))).alias("word_chars"),
        long(F.regexp_count("_t", F.lit("[#*$%&|<>]"))).alias("n_symbols"),
        long(F.size("_lines") - F.size(F.array_distinct("_lines"))).alias("n_dup_lines"),
        long(F.regexp_count("_t", F.lit(r"\p{Lu}"))).alias("n_upper"),
    )
    counts = ["text_hash", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_upper"]
    at = lambda i, k: F.element_at("_h", i + k)
    windows = F.transform(F.sequence(F.lit(1), F.size("_h") - WINDOW + 1), lambda i: F.xxhash64(*[at(i, k) for k in range(WINDOW)]))
    t = t.select(*keep, *counts, F.when(F.size("_h") > WINDOW, windows).alias("_win"))
    # only texts in which a window occurs twice are sorted: their windows by hash, then the places by position
    twice = F.size(F.array_distinct("_win")) < F.size("_win")
    t = t.withColumn("_s", F.when(twice, F.sort_array(F.transform("_win", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    item = lambda i: F.element_at("_s", i)
    same = lambda i, j: item(i)["h"] == item(j)["h"]
    repeated = F.filter(
        F.sequence(F.lit(1), F.size("_s")),
        lambda i: F.when(i > 1, same(i, i - 1)).otherwise(F.lit(False)) | F.when(i < F.size("_s"), same(i, i + 1)).otherwise(F.lit(False))
    )
    t = t.withColumn("_p", F.when(F.col("_s").isNotNull(), F.sort_array(F.transform(repeated, lambda i: item(i)["i"]))))
    start = F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("p"))
    covered = F.aggregate("_p", start, lambda a, p: F.struct((a["n"] + F.least(F.lit(WINDOW), p - a["p"])).alias("n"), p.alias("p")))["n"]
    return t.select(*keep, *counts, long(F.coalesce(covered, F.lit(0))).alias("n_repeat_words"))


def rule_columns() -> dict[str, Column]:
    per = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    return {
        "symbol_rate": per("n_symbols", "word_chars"), "dup_line_rate": per("n_dup_lines", "n_words"), "repeat_rate": per("n_repeat_words", "n_words"),
        "upper_rate": per("n_upper", "word_chars")
    }


def log_gamma(x: Column) -> Column:
    """Of x >= 1, to about 1e-12, by Stirling's series at x + 8."""
    z = x + 8.0
    shift = F.lit(0.0)
    for i in range(8):
        shift = shift + F.log(x + float(i))
    series = 1 / (12 * z) - 1 / (360 * F.pow(z, F.lit(3))) + 1 / (1260 * F.pow(z, F.lit(5))) - 1 / (1680 * F.pow(z, F.lit(7)))
    return (z - 0.5) * F.log(z) - z + 0.5 * math.log(2 * math.pi) + series - shift


def binomial_cdf(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) of n trials of probability p, for k below n p, summed down from k as long as terms matter."""
    x, m = k.cast("double"), n.cast("double")
    term = log_gamma(m + 1) - log_gamma(x + 1) - log_gamma(m - x + 1) + x * math.log(p) + (m - x) * math.log1p(-p)
    steps = F.least(k, F.ceil(12 * F.sqrt(x) + 60)).cast("int")
    places = F.when(steps > 0, F.sequence(F.lit(0), steps - 1)).otherwise(F.array().cast("array<int>"))

    def add(a: Column, i: Column) -> Column:
        ratio = a["ratio"] * (x - i) * (1 - p) / ((m - x + i + 1) * p)
        return F.struct((a["total"] + ratio).alias("total"), ratio.alias("ratio"))

    start = F.struct(F.lit(1.0).alias("total"), F.lit(1.0).alias("ratio"))
    return F.least(F.lit(1.0), F.exp(term + F.log(F.aggregate(places, start, add)["total"])))


def admissible(k: Column, n: Column, risk: float, level: Column) -> Column:
    """Whether the exact (Clopper-Pearson) upper bound, at this level, of a rate seen as k of n is at most ``risk``."""
    return F.when(k < n * risk, binomial_cdf(k, n, risk) <= level).otherwise(False)


def held_out() -> Column:
    """Documents whose labels set no cutoff."""
    return F.substring(F.sha2(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"), 256), 1, 1).isin(*TEST_DIGITS)


def cutoffs(run: Run, counts: DataFrame, labels: DataFrame, label: str = "quality", risk: float = 0.05, level: float = 0.05) -> DataFrame:
    """A row for each stratum with a rule that is on: stratum, and the cutoff of each rule, null where it is off."""
    one = labels.select(
        "doc_id", F.col(label).cast("int").alias("y")
    ).where("doc_id is not null and y is not null").groupBy("doc_id").agg(F.max("y").alias("y"))
    held = counts.where(~base_failed() & ~held_out()).join(one, "doc_id").select(stratum(), "text_hash", "y", *[c.alias(r) for r, c in rule_columns().items()])
    texts = held.groupBy("stratum", "text_hash").agg(F.max("y").alias("y"), *[F.first(r).alias(r) for r in RULES])
    value = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.col(r).alias("x")) for r in RULES])).alias("v")
    good, bad = F.col("y") != 0, F.col("y") == 0
    over = lambda side, g: F.count_if(side & (F.col("v.x") > g))
    tried = F.array(*[F.struct(F.lit(g).alias("g"), over(good, g).alias("lost"), over(bad, g).alias("caught")) for g in GRID])
    table = texts.select("stratum", "y", value).groupBy("stratum", F.col("v.rule").alias("rule")).agg(
        F.count_if(good).alias("good"), F.count_if(bad).alias("bad"), tried.alias("tried")
    )
    table = run.stored(table, "tried")
    tests = table.agg(F.greatest(F.lit(1), F.count("*") * len(GRID))).scalar()
    each = table.select("stratum", "rule", "good", "bad", F.explode("tried").alias("t")).select("*", "t.*")
    gain = F.col("caught") / F.greatest(F.lit(1), F.col("bad")) - LOSS * F.col("lost") / F.col("good")
    each = each.where("good > 0").withColumn("gain", gain).where(
        (F.col("gain") > 0) & admissible(F.col("lost"), F.col("good"), risk / len(RULES), level / tests)
    )
    best = each.groupBy("stratum", "rule").agg(F.max_by("g", F.struct("gain", "g")).alias("g"))
    return best.groupBy("stratum").agg(*[F.max(F.when(F.col("rule") == r, F.col("g"))).alias(f"cut_{r}") for r in RULES])


def stratum() -> Column:
    return F.coalesce(F.col("lang"), F.lit("")).alias("stratum")


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def judge(docs: DataFrame, labels: DataFrame, label: str = "quality", risk: float = 0.05, level: float = 0.05) -> DataFrame:
    """doc_id, the counts, base_failed and kept of every document."""
    with Run(docs.sparkSession) as run:
        counts = run.result(with_counts(docs, ["doc_id", "lang"]), "counts")
        found = run.result(cutoffs(run, counts, labels, label, risk, level), "cutoffs")
    rejected = F.lit(False)
    for r, c in rule_columns().items():
        rejected = rejected | F.coalesce(c > F.col(f"cut_{r}"), F.lit(False))
    out = counts.withColumn("stratum", stratum()).join(found, "stratum", "left")
    return out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed().alias("base_failed"),
        (~base_failed() & ~rejected).alias("kept")
    )
