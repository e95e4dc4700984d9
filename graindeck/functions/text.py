
from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from graindeck.schema import IMAGE_SUFFIXES

#: Unicode whitespace as Python's split() has it; Java's \s lacks the separators 1C to 1F.
SPACE = r"(?U)[\s\x1c-\x1f]+"


def collapsed(text: Column) -> Column:
    """Whitespace runs become one space, ends are trimmed, case stays."""
    return F.trim(F.regexp_replace(text, SPACE, " "))


def normalized(text: Column) -> Column:
    """Collapsed and case-folded. Folding is lower case and ß as ss, which is full folding for Latin text."""
    return F.replace(F.lower(collapsed(text)), F.lit("ß"), F.lit("ss"))


@F.pandas_udf(StringType())
def casefold_key(text: pd.Series) -> pd.Series:
    """S1 for arbitrary scripts: Python's own split and casefold."""
    return text.map(lambda x: None if x is None else " ".join(x.split()).casefold())


def words(text: Column) -> Column:
    return F.filter(F.split(collapsed(text), " "), lambda w: w != "")


def word_count(text: Column) -> Column:
    """S6."""
    return F.size(words(text)).cast("long")


def stripped(text: Column) -> Column:
    """Without whitespace at the ends, as Python's strip()."""
    return F.regexp_replace(text, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def first_sentence(text: Column) -> Column:
    """Up to the first whitespace that follows a full stop, exclamation or question mark; whitespace of any script."""
    return F.element_at(F.split(stripped(text), r"(?U)(?<=[.!?])[\s\x1c-\x1f]+", 2), 1)


def token_count(text: Column, special: int = 2) -> Column:
    """S9 with a whitespace tokenizer: words plus start and end marks."""
    return word_count(text) + special


def fit_words(text: Column, most: int) -> Column:
    """S8 with a whitespace tokenizer: whole words that fit ``most`` tokens, trailing " ,;:" taken off when cut. A text of
    which nothing is left is an error."""
    w = words(text)
    cut = F.regexp_replace(F.array_join(F.slice(w, 1, max(0, most - 2)), " "), r"[ ,;:]+$", "")
    nothing = F.raise_error(F.concat(F.lit(f"no word fits {most} tokens: "), F.substring(text, 1, 40))).cast("string")
    return F.when(F.size(w) + 2 <= most, F.array_join(w, " ")).when(cut == "", nothing).otherwise(cut)


def fit_words_with(encode_length: Callable[[str], int], most: int):
    """S8 with any tokenizer: an Arrow function that drops the last word until the text fits."""

    @F.pandas_udf(StringType())
    def fit(text: pd.Series) -> pd.Series:
        def one(x: str | None) -> str | None:
            if x is None:
                return None
            x = " ".join(x.split())
            while encode_length(x) > most:
                head = x.rpartition(" ")[0].rstrip(" ,;:")
                if not head:
                    raise ValueError(f"one word is longer than {most} tokens: {x[:40]!r}")
                x = head
            return x

        return text.map(one)

    return fit


#: Fixed pattern: country and zoom at the end of a file's name.
COUNTRY_ZOOM = r"_([A-Z]{2})_(\d+)?$"

#: Fixed pattern: the mark before a caption's summary, and the text that the summary follows in a context.
SUMMARY_MARK = r"(?i)(?:^|\s)It\s+shows\s*:\s*(.+?)\s*$"
CONTEXT = "An aerial image. It shows: "


def caption_from(field: Column, mode: str = "auto") -> Column:
    """S3: the collapsed caption (full), what follows the first mark (summary), that in a context (contextual-summary),
    or auto: the summary in a context if there is a mark, else the whole. Null where the mode finds nothing."""
    text = collapsed(field)
    summary = F.nullif(collapsed(F.regexp_extract(text, SUMMARY_MARK, 1)), F.lit(""))
    whole = F.nullif(text, F.lit(""))
    context = F.concat(F.lit(CONTEXT), summary)
    if mode == "full":
        return whole
    if mode == "summary":
        return summary
    if mode == "contextual-summary":
        return context
    return F.coalesce(context, whole)


def country(stem: Column) -> Column:
    """Two capital letters before the zoom at a name's end."""
    return F.coalesce(F.nullif(F.regexp_extract(stem, COUNTRY_ZOOM, 1), F.lit("")), F.lit("unknown"))


def zoom(stem: Column) -> Column:
    """S4."""
    return F.coalesce(F.nullif(F.regexp_extract(stem, COUNTRY_ZOOM, 2), F.lit("")), F.lit("unknown"))


def stem(path: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")


def object_key(path: Column) -> Column:
    """The first part of a file's name if it is a kind letter and a number, else null."""
    key = F.element_at(F.split(stem(path), "_"), 1)
    return F.when(key.rlike(r"^[anwr]\d+$"), key)


def plain_path(path: Column) -> Column:
    """Forward slashes, no leading "./"."""
    return F.regexp_replace(F.regexp_replace(F.trim(path), r"\\", "/"), r"^(\./)+", "")


def safe_path(path: Column, suffixes: tuple[str, ...] = IMAGE_SUFFIXES) -> Column:
    """relative, without parent steps, with an image suffix; a name that is only a suffix has none."""
    tail = F.lower(F.regexp_extract(path, r"[^/](\.[A-Za-z0-9]+)$", 1))
    return path.isNotNull() & (path != "") & ~path.rlike(r"^([A-Za-z]:)?/") & ~path.rlike(r"(^|/)\.\.(/|$)") & tail.isin(list(suffixes))


def record_id(source: Column, path: Column) -> Column:
    """S11."""
    return F.concat(source, F.lit(":"), path)


def caption_id(image: Column, number: Column) -> Column:
    """S11."""
    return F.concat(image, F.lit(":caption"), F.format_string("%02d", number))


def prompt(template: Column, name: Column) -> Column:
    """S12."""
    return F.replace(template, F.lit("{}"), name)


def first_filled(*columns: Column) -> Column:
    """The first value that is not blank."""
    return F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in columns])


def name_paths(text: Column) -> Column:
    """S15: "name=path,name=path" as a map."""
    return F.str_to_map(text, F.lit(","), F.lit("="))


#: Words that do not count as a difference between captions, and punctuation at a word's ends.
STOP_WORDS = ("a", "an", "the", "of", "with", "and", "or", "by", "in", "on", "for", "to", "from", "near", "around", "is", "are", "at", "as", "its")
PUNCTUATION = ".,;:!?()[]{}\"'"


def meaningfully_differs(short: Column, detail: Column, least: int = 3) -> Column:
    """the detail has at least ``least`` words that the short caption has not, stop words left out.

    Punctuation is taken off after the difference, so "lake." counts as new beside "lake".
    """
    a, b = normalized(short), normalized(detail)
    added = F.array_except(F.split(b, " "), F.split(a, " "))
    bare = F.array_distinct(F.transform(added, lambda w: F.btrim(w, F.lit(PUNCTUATION))))
    return (a != b) & (F.size(F.filter(bare, lambda w: ~w.isin(list(STOP_WORDS)))) >= least)
