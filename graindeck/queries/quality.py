"""Text and data-quality queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graindeck.functions import text as T
from graindeck.functions.hashing import content_crc32
from graindeck.operators import quality, select
from graindeck.queries import query, rounded
from graindeck.schema import table

#: The normalised key (S1) in DuckDB.
NORM = r"replace(lower(trim(regexp_replace({}, '[\s\x0b\x1c-\x1f\x{{85}}\x{{a0}}]+', ' ', 'g'))), 'ß', 'ss')"
COLLAPSE = r"trim(regexp_replace({}, '[\s\x0b\x1c-\x1f\x{{85}}\x{{a0}}]+', ' ', 'g'))"
N, C = NORM.format("text"), COLLAPSE.format("text")
WORDS = f"list_filter(string_split({C}, ' '), lambda w: w <> '')"


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents")


@query(f"select {N} as value, count(*) as n, min(doc_id) as first from documents group by 1 order by n desc, first limit 20")
def caption_norm_dups(spark: SparkSession, d: str) -> DataFrame:
    """AG1, AG3, S1: the 20 most frequent normalised texts."""
    return quality.most_common(_docs(spark, d), T.normalized(F.col("text")), "doc_id")


@query(
    f"select count(*) as n_rows, count(distinct {N}) as n_distinct, count(*) - count(distinct {N}) as n_duplicates, round((count(*) - count(distinct {N})) "
    f"/ count(*), 6) as rate from documents"
)
def duplicate_rate(spark: SparkSession, d: str) -> DataFrame:
    """AG2."""
    return rounded(quality.duplicate_rate(_docs(spark, d), T.normalized(F.col("text"))))


@query(
    f"select source, count(*) as n_rows, count(distinct {N}) as n_distinct, count(*) - count(distinct {N}) as n_duplicates, round((count(*) - "
    f"count(distinct {N})) / count(*), 6) as rate from documents group by source"
)
def duplicate_rate_by_source(spark: SparkSession, d: str) -> DataFrame:
    """AG2 by source."""
    return rounded(quality.duplicate_rate(_docs(spark, d), T.normalized(F.col("text")), "source"))


@query(f"""with w as (select lang, len({WORDS}) as n from documents),
 r as (select lang, n, row_number() over (partition by lang order by n) - 1 as i, count(*) over (partition by lang) as c from w)
 select lang, max(case when i = cast(round_even((c - 1) * 0.5, 0) as bigint) then n end) as p50, max(case when i = cast(round_even((c - 1) * 0.95, 0)
  as bigint) then n end) as p95,
 max(case when i = cast(round_even((c - 1) * 0.99, 0) as bigint) then n end) as p99 from r group by lang""")
def length_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """AG6, S6: word counts at rounded-index percentiles."""
    df = _docs(spark, d).select("lang", T.word_count(F.col("text")).alias("n_words"))
    return quality.rounded_percentiles(df, "n_words", {"p50": 0.5, "p95": 0.95, "p99": 0.99}, "lang")


@query(f"""with g as (select count(*) as size from documents group by {N}), r as (select size, row_number() over (order by size) - 1 as i, count(*)
  over () as c from g)
 select count(*) as n_groups, count(*) filter (size = 1) as n_singletons, max(size) as largest, max(case when i = cast(round_even((c - 1) * 0.5, 0) as
  bigint) then size end) as p50,
 max(case when i = cast(round_even((c - 1) * 0.95, 0) as bigint) then size end) as p95 from r""")
def group_size_stats(spark: SparkSession, d: str) -> DataFrame:
    """AG9."""
    return quality.group_sizes(_docs(spark, d), T.normalized(F.col("text")))


@query(f"select size, count(*) as n_groups from (select count(*) as size from documents group by {N}) group by size")
def group_size_histogram(spark: SparkSession, d: str) -> DataFrame:
    """AG10."""
    return quality.size_histogram(_docs(spark, d), T.normalized(F.col("text")))


def _sides(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    df = _docs(spark, d).select("doc_id", "source", F.sha2(F.encode(T.normalized(F.col("text")), "UTF-8"), 256).alias("key"))
    even = F.regexp_extract("source", r"(\d+)$", 1).cast("int") % 2
    return df.where(even == 0), df.where(even == 1)


_SIDES = (
    f"with k as (select doc_id, sha256({N}) as key, cast(regexp_extract(source, '(\\d+)$', 1) as int) % 2 as side from documents), l as (select * from k "
    f"where side = 0), r as (select * from k where side = 1) "
)


@query(
    _SIDES
    + "select l.key, count(distinct l.doc_id) as n_left, count(distinct r.doc_id) as n_right, count(*) as n_pairs from l join r using (key) group by l.key"
)
def overlap_between_sources(spark: SparkSession, d: str) -> DataFrame:
    """J1 as counts: texts that sources of even and of odd number share."""
    return quality.overlap_counts(*_sides(spark, d), "key")


@query(_SIDES + "select key, l.doc_id as left_id, r.doc_id as right_id from l join r using (key)")
def overlap_pairs(spark: SparkSession, d: str) -> DataFrame:
    """J1 with all pairs, as an overlap report lists them."""
    left, right = _sides(spark, d)
    return quality.overlap(left, right, "key", "doc_id", "doc_id")


@query(f"""with l as (select sha256(text) as raw, sha256({N}) as norm from documents), r as (select sha256(text) as raw, sha256({N}) as norm from benchmark),
 c as (select 'raw' as key, count(*) as n_pairs from l join r using (raw) union all select 'norm', count(*) from l join r using (norm))
 select key, n_pairs, case when n_pairs > 0 then 'overlap' else 'clear' end as status from c""")
def overlap_documents_benchmark(spark: SparkSession, d: str) -> DataFrame:
    """J2 over two keys, the raw and the normalised text; H5."""
    keys = lambda df: df.select(
        F.sha2(F.encode("text", "UTF-8"), 256).alias("raw"), F.sha2(F.encode(T.normalized(F.col("text")), "UTF-8"), 256).alias("norm")
    )
    return quality.audit_overlap(keys(_docs(spark, d)), keys(table(spark, d, "benchmark")), ("raw", "norm"))


@query(_SIDES + "select key from l intersect select key from r")
def leak_semi(spark: SparkSession, d: str) -> DataFrame:
    """J10, SO1."""
    return quality.leak(*_sides(spark, d), "key")


@query(_SIDES + "select doc_id, key from l where key not in (select key from r)")
def leak_anti(spark: SparkSession, d: str) -> DataFrame:
    """Rows of one side whose key the other has not."""
    left, right = _sides(spark, d)
    return left.join(right.select("key").distinct(), "key", "left_anti").select("doc_id", "key")


@query(f"select md5({N}) as removed, count(*) as n from documents where {N} in (select {N} from documents group by 1 having count(*) > 3) group by 1")
def digest_exclusion_counts(spark: SparkSession, d: str) -> DataFrame:
    """removals by digest, the digests being those of texts that occur more than three times."""
    df = _docs(spark, d).select("doc_id", F.md5(F.encode(T.normalized(F.col("text")), "UTF-8")).alias("removed"))
    listed = df.groupBy("removed").count().where("count > 3").select("removed")
    _, removed = quality.without_digests(df, listed, "removed")
    return removed.withColumnRenamed("count", "n")


@query(f"""with r as (select page_id, regexp_extract(url, '([^/]+)$', 1) as name from pages), f as (select name, count(*) as n from (select distinct
  url, regexp_extract(url, '([^/]+)$', 1) as name from pages where page_id % 3 <> 0) group by name)
 select case when n = 1 then 'resolved' when n > 1 then 'ambiguous' else 'missing' end as status, count(*) as n from r left join f using (name) group by 1""")
def reference_resolution(spark: SparkSession, d: str) -> DataFrame:
    """Pages referred to by their last path part, files being the pages of other ids than multiples of 3."""
    pages = table(spark, d, "pages")
    refs = pages.select("page_id", F.regexp_extract("url", "([^/]+)$", 1).alias("ref"))
    return quality.resolve_references(refs, pages.where("page_id % 3 <> 0").select("url"), "ref", "url").groupBy("status").agg(F.count("*").alias("n"))


@query(f"select lang, count(*) as n, count(*) filter (len({WORDS}) + 2 > 77) as n_overflow, max(len({WORDS}) + 2) as longest from documents group by lang")
def token_overflow(spark: SparkSession, d: str) -> DataFrame:
    """Texts beyond a context of 77 by a whitespace tokenizer."""
    n = T.token_count(F.col("text"))
    return _docs(spark, d).groupBy("lang").agg(F.count("*").alias("n"), F.count_if(n > 77).alias("n_overflow"), F.max(n).alias("longest"))


@query(f"""with w as (select doc_id, {WORDS} as w from documents)
 select doc_id, case when len(w) + 2 <= 20 then array_to_string(w, ' ') else regexp_replace(array_to_string(w[1:18], ' '), '[ ,;:]+$', '') end as
  fitted from w""")
def fit_words(spark: SparkSession, d: str) -> DataFrame:
    """Whole words within a context of 20."""
    return _docs(spark, d).select("doc_id", T.fit_words(F.col("text"), 20).alias("fitted"))


@query(
    r"select doc_id, trim(regexp_extract(trim(text, e' \t\n\r'), '^((?s:.*?)[.!?])(\s|$)', 1)) as sentence from documents where regexp_matches(trim(text, "
    r"e' \t\n\r'), '[.!?](\s|$)')"
)
def first_sentence(spark: SparkSession, d: str) -> DataFrame:
    """S7, of texts with a sentence's end."""
    df = _docs(spark, d).where(F.col("text").rlike(r"[.!?](\s|$)"))
    return df.select("doc_id", T.first_sentence(F.regexp_replace("text", r"^\s+|\s+$", "")).alias("sentence"))


@query(rf"""with w as (select doc_id, lang, {C} as t, {WORDS} as w from documents)
 select coalesce(case when len(w) < 12 then 'short' when len(w) > 2000 then 'long' when not regexp_matches(t, '[.!?]') then 'no_sentence' when
  regexp_matches(t, '[#$%&*]') then 'symbols' end, 'kept') as reason, count(*) as n from w group by 1""")
def filter_reason_counts(spark: SparkSession, d: str) -> DataFrame:
    """rows by the first rule that rejects them."""
    df = _docs(spark, d).select(T.word_count(F.col("text")).alias("n"), F.col("text").alias("t"))
    reason = select.first_reason(
        ("short", F.col("n") < 12), ("long", F.col("n") > 2000), ("no_sentence", ~F.col("t").rlike("[.!?]")), ("symbols", F.col("t").rlike("[#$%&*]"))
    )
    return df.groupBy(F.coalesce(reason, F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


@query(f"""with k as (select doc_id, {N} as key, case when doc_id % 10 = 0 then 'val' else 'train' end as split from documents)
 select doc_id, split from k where key not in (select key from k group by key having count(distinct split) > 1)""")
def cross_split_object_exclusion(spark: SparkSession, d: str) -> DataFrame:
    """F8: texts that occur in one split only."""
    df = _docs(spark, d).select("doc_id", quality.digest(T.normalized(F.col("text"))).alias("key"), F.when(F.col("doc_id") % 10 == 0, "val").otherwise("train").alias("split"))
    return select.one_split_only(df, "key", "split").select("doc_id", "split")


_STOPS = ", ".join(f"'{w}'" for w in T.STOP_WORDS)
_MARKS = T.PUNCTUATION.replace("'", "''")


def added_words(a: str, b: str) -> str:
    """Bare words of b that a has not, without stop words, in DuckDB."""
    new = f"list_filter(string_split({b}, ' '), lambda w: not list_contains(string_split({a}, ' '), w))"
    return f"list_filter(list_distinct(list_transform({new}, lambda w: trim(w, '{_MARKS}'))), lambda w: w not in ({_STOPS}))"


@query(
    "with t as (select c.conv_id, c.turn, "
    + NORM.format("c.text")
    + " as a, "
    + NORM.format("n.text")
    + " as b from conversations c join conversations n on n.conv_id = c.conv_id and n.turn = c.turn + 1) select conv_id, turn, a <> b and len("
    + added_words("a", "b")
    + ") >= 3 as differs from t"
)
def meaningful_difference(spark: SparkSession, d: str) -> DataFrame:
    """each turn against the next."""
    c = table(spark, d, "conversations")
    n = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("next"))
    return c.join(n, ["conv_id", "turn"]).select("conv_id", "turn", T.meaningfully_differs(F.col("text"), F.col("next")).alias("differs"))


@query(r"""select page_id, regexp_replace(regexp_replace(trim(url), '\\', '/', 'g'), '^(\./)+', '') as path, 'pages:' || url as id, regexp_replace(regexp_extract(url, '([^/]+)$', 1), '\.[^.]*$', '') as stem from pages""")
def path_functions(spark: SparkSession, d: str) -> DataFrame:
    """Paths and ids of pages."""
    url = F.col("url")
    return table(spark, d, "pages").select(
        "page_id", T.plain_path(url).alias("path"), T.record_id(F.lit("pages"), url).alias("id"),
        F.regexp_replace(F.regexp_extract(url, "([^/]+)$", 1), r"\.[^.]*$", "").alias("stem")
    )


@query(f"select doc_id, sha256(text) as digest, len(sha256(text)) = 64 as valid from documents")
def content_digests(spark: SparkSession, d: str) -> DataFrame:
    """H5, F11."""
    digest = F.sha2(F.encode("text", "UTF-8"), 256)
    return _docs(spark, d).select("doc_id", digest.alias("digest"), digest.rlike("^[0-9a-f]{64}$").alias("valid"))


@query()
def content_checksums(spark: SparkSession, d: str) -> DataFrame:
    """H5: CRC-32, for which the comparison engine has no function; tested against zlib."""
    return _docs(spark, d).select("doc_id", content_crc32(F.encode("text", "UTF-8")).alias("crc"))


@query(r"""with t as (select doc_id, """ + C + r""" || ' It shows: item ' || doc_id as t from documents)
 select doc_id, trim(regexp_extract(t, '(?i)(?:^|\s)It\s+shows\s*:\s*(.+?)\s*$', 1)) as summary, 'An aerial image. It shows: ' ||
  trim(regexp_extract(t, '(?i)(?:^|\s)It\s+shows\s*:\s*(.+?)\s*$', 1)) as context from t""")
def caption_modes(spark: SparkSession, d: str) -> DataFrame:
    """S3: summary and its context, of texts with a mark put on."""
    t = F.concat(T.collapsed(F.col("text")), F.lit(" It shows: item "), F.col("doc_id").cast("string"))
    return _docs(spark, d).select("doc_id", T.caption_from(t, "summary").alias("summary"), T.caption_from(t, "auto").alias("context"))


@query(r"""select coalesce(nullif(regexp_extract(upper(lang) || '_' || upper(lang) || '_' || (doc_id % 5), '_([A-Z]{2})_(\d+)?$', 1), ''), 'unknown') as country, coalesce(nullif(regexp_extract(upper(lang) || '_' || upper(lang) || '_' || (doc_id % 5), '_([A-Z]{2})_(\d+)?$', 2), ''), 'unknown') as zoom, count(*) as n from documents group by 1, 2""")
def country_zoom_counts(spark: SparkSession, d: str) -> DataFrame:
    """S4, AG1: counts by two parts of a name."""
    name = F.concat_ws("_", F.upper("lang"), F.upper("lang"), (F.col("doc_id") % 5).cast("string"))
    return _docs(spark, d).groupBy(T.country(name).alias("country"), T.zoom(name).alias("zoom")).agg(F.count("*").alias("n"))


@query("select k as field, count(*) as n from (select unnest(json_keys(props)) as k from events) group by k")
def field_inventory(spark: SparkSession, d: str) -> DataFrame:
    """AG28: records by field of a JSON column."""
    return quality.field_counts(table(spark, d, "events"), F.from_json("props", "map<string,string>"))


@query("select event_type, min(user_id % 7) = max(user_id % 7) and count(user_id) = count(*) as consistent from events group by event_type")
def cross_run_consistency(spark: SparkSession, d: str) -> DataFrame:
    """AG26."""
    return quality.consistent(table(spark, d, "events").withColumn("v", F.col("user_id") % 7), "v", "event_type")


@query("select l.doc_id from documents l anti join labels using (doc_id)")
def missing_labels(spark: SparkSession, d: str) -> DataFrame:
    """F5 as a table: documents without a label."""
    return _docs(spark, d).select("doc_id").join(table(spark, d, "labels").select("doc_id"), "doc_id", "left_anti")
