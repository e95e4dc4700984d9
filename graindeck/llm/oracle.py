"""DuckDB SQL for the corpus operators that SQL can express, over whole tables."""

from __future__ import annotations

from graindeck.llm.mixing import LEVELS
from graindeck.llm.queries import MIX_EPOCHS, MIX_SEED, MIX_SHARE, MIX_WEIGHTS
from graindeck.llm.risk_rules import GRID, LOSS, RULES, TEST_DIGITS

#: Words of the decontamination contract and of the other contracts.
LETTER_WORDS = (
    r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
)
SPACE_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

WU_MANBER = f"""
with d as (select doc_id, {LETTER_WORDS} as w from documents),
b as (select item_id, w, least(13, len(w)) as n from (select item_id, {LETTER_WORDS} as w from benchmark) where len(w) > 0),
pat as (select distinct item_id, n, array_to_string(w[i:i + n - 1], ' ') as win from (select *, unnest(range(1, len(w) - n + 2)) as i from b)),
dw as (select doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') as win from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as i from d,
  (select distinct n from pat) where len(w) >= n)),
hit as (select doc_id, i, dw.n, item_id from dw join pat using (n, win)),
words as (select doc_id, count(distinct i + k) as n_hit from (select doc_id, i, unnest(range(0, n)) as k from hit) group by doc_id),
items as (select doc_id, count(*) as n_items, string_agg(item_id, ',' order by item_id) as ids from (select distinct doc_id, cast(item_id as varchar)
  as item_id from hit) group by doc_id)
select doc_id, len(w) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(ids, '')) as items_sha256,
  coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
from d left join words using (doc_id) left join items using (doc_id)"""

JACCARD = f"""
with recursive d as (select doc_id, {LETTER_WORDS} as w from documents),
sh as (select distinct doc_id, array_to_string(w[i:i + least(5, len(w)) - 1], ' ') as s from (select doc_id, w, unnest(range(1, len(w) - least(5,
  len(w)) + 2)) as i from d where len(w) > 0)),
sets as (select doc_id, md5(string_agg(s, '|' order by s)) as id, count(*) as size from sh group by doc_id),
reps as (select id, min(doc_id) as rid, count(*) as n_copies, any_value(size) as size from sets group by id),
rs as (select rid, size, s from reps join sh on sh.doc_id = reps.rid),
pairs as (select x.rid as a, y.rid as b, count(*) as shared, any_value(x.size) as na, any_value(y.size) as nb from rs x join rs y on x.s = y.s and
  x.rid < y.rid group by x.rid, y.rid),
links as (select a, b from pairs where shared * 5 >= 4 * (na + nb - shared)),
edges as (select a, b from links union all select b, a from links),
reach as (select rid as a, rid as b from reps union select reach.a, edges.b from reach join edges on reach.b = edges.a),
classes as (select a as rid, min(b) as class_id from reach group by a),
n as (select a as rid, count(*) as n_links from edges group by a)
select d.doc_id, coalesce(class_id, d.doc_id) as class_id, coalesce(reps.rid, d.doc_id) as copy_id, coalesce(n_copies, 1) as n_copies,
  coalesce(n_links, 0) as n_links
from d left join sets using (doc_id) left join reps using (id) left join classes using (rid) left join n using (rid)"""

_NUMBER = r"cast('0' || regexp_extract(coalesce(source, ''), '([0-9]{1,9})$', 1) as int)"
_DOMAIN = rf"'d' || (case when regexp_matches(coalesce(source, ''), '[0-9]$') then {_NUMBER} else 999999999 end % 4)"


def _weight(level: str) -> str:
    return "case " + " ".join(f"when {level} = '{n}' then {float(x)}::double" for n, x in MIX_WEIGHTS.get(level, {}).items()) + " else 1.0::double end"


def _level(depth: int) -> str:
    """Water-filling among the nodes of one level: nN (nodes), sN (shares by path)."""
    path, above = ", ".join(LEVELS[: depth + 1]), ", ".join(LEVELS[:depth])
    name, by = LEVELS[depth], f"partition by {', '.join(LEVELS[:depth])}" if depth else ""
    budget = f"join s{depth - 1} using ({above})" if depth else "cross join (select round(sum(n_tokens) * {}) as budget from leaf)".format(
        f"{MIX_SHARE}::double"
    )
    return f"""n{depth} as (select *, case when w > 0 then cap / w else 'infinity'::double end as fill from (select {path}, sum(cap)::bigint as cap,
  {_weight(name)} as w from leaf group by {path}) {budget}),
f{depth} as (select *, case when sum(w) over rest > 0 then (budget - coalesce(sum(cap) over ahead, 0)) / sum(w) over rest end as level from n{depth}
  window ahead as ({by} order by fill, {name} rows between unbounded preceding and 1 preceding), rest as ({by} order by fill, {name} rows between
  current row and unbounded following)),
g{depth} as (select *, row_number() over ({by} order by (level <= fill and w > 0) desc nulls last, fill, {name}) as rn from f{depth}),
l{depth} as (select *, first_value(case when level <= fill and w > 0 then level else 'infinity'::double end) over ({by} order by rn) as line from g{depth}),
s{depth} as (select {path}, case when w > 0 then least(cap::double, line * w) else 0 end as budget from l{depth})"""


MIX = f"""
with t as (select doc_id, {_DOMAIN} as domain, coalesce(lang, '') as lang, coalesce(source, '') as source, len({SPACE_WORDS}) as n_tokens from documents),
leaf as (select domain, lang, source, sum(n_tokens)::bigint as n_tokens, sum(n_tokens)::bigint * {MIX_EPOCHS} as cap from t where n_tokens > 0 group by all),
{_level(0)},
{_level(1)},
{_level(2)},
e as (select t.*, floor(budget / leaf.n_tokens) as whole, budget - floor(budget / leaf.n_tokens) * leaf.n_tokens as rest from t join s2 using (domain,
  lang, source) join leaf using (domain, lang, source) where t.n_tokens > 0),
o as (select *, coalesce(sum(n_tokens) over (partition by domain, lang, source order by substr(sha256('{MIX_SEED}|' || cast(whole + 1 as bigint) ||
  '|' || doc_id), 1, 16), doc_id rows between unbounded preceding and 1 preceding), 0) as begins from e)
select doc_id, domain, lang, source, n_tokens, cast(whole + case when begins < rest then 1 else 0 end as bigint) as copies from o where whole + case
  when begins < rest then 1 else 0 end > 0"""

_GRID = ", ".join(f"{g}::double" for g in GRID)

_P = f"(0.05::double / {len(RULES)})"
_CDF = (
    f"list_sum(list_transform(range(0, lost + 1), lambda j: exp(lgamma(good + 1) - lgamma(j + 1) - lgamma(good - j + 1) + j * ln({_P}) + (good - j) * ln(1 "
    f"- {_P}))))"
)
_TEST = ", ".join(f"'{x}'" for x in TEST_DIGITS)

RULES_SQL = rf"""
with d as (select doc_id, coalesce(lang, '') as lang, coalesce(text, '') as text, {SPACE_WORDS} as w,
  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines from documents),
win as (select doc_id, i, array_to_string(w[i:i + 7], ' ') as s from (select doc_id, w, unnest(range(1, len(w) - 6)) as i from d where len(w) >= 8)),
again as (select doc_id, count(distinct i + k) as n_repeat_words
  from (select doc_id, i, unnest(range(0, 8)) as k from (select *, count(*) over (partition by doc_id, s) as c from win) where c > 1) group by doc_id),
c as (select doc_id, lang, text, len(w) as n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::bigint as word_chars,
  len(regexp_extract_all(text, '[#*$%&|<>]')) as n_symbols, len(lines) - len(list_distinct(lines)) as n_dup_lines,
  coalesce(n_repeat_words, 0) as n_repeat_words, len(regexp_extract_all(text, '\p{{Lu}}')) as n_upper from d left join again using (doc_id)),
b as (select *, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed from c),
v as (select doc_id, lang, text, base_failed, unnest({list(RULES)!r}) as rule, unnest([n_symbols / greatest(word_chars, 1), n_dup_lines /
  greatest(n_words, 1),
  n_repeat_words / greatest(n_words, 1), n_upper / greatest(word_chars, 1)]) as x from b),
y as (select doc_id, max(quality) as y from labels where doc_id is not null and quality is not null group by doc_id),
h as (select lang, rule, text, any_value(x) as x, max(y) as y from v join y using (doc_id)
  where not base_failed and substr(sha256(doc_id::varchar), 1, 1) not in ({_TEST}) group by lang, rule, text),
g as (select unnest([{_GRID}]) as g),
k as (select lang, rule, g, count(*) filter (y <> 0) as good, count(*) filter (y <> 0 and x > g) as lost, count(*) filter (y = 0) as bad,
  count(*) filter (y = 0 and x > g) as caught from h, g group by all),
m as (select count(distinct (lang, rule)) * {len(GRID)} as tests from h),
a as (select *, caught / greatest(1, bad) - {LOSS} * lost / good as gain from k, m where good > 0 and lost < good * {_P} and {_CDF} <= 0.05::double / tests),
cut as (select lang, rule, arg_max(g, (gain, g)) as g from a where gain > 0 group by lang, rule),
rejected as (select distinct doc_id from v join cut using (lang, rule) where x > g)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and doc_id not in (select doc_id from
  rejected) as kept from b"""


def oracle_sql() -> dict[str, str]:
    return {"op2_hierarchical_mix": MIX, "op3_chosen_path_join": JACCARD, "op6_risk_rules": RULES_SQL, "op8_wu_manber": WU_MANBER}
