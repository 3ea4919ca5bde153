"""DuckDB twins of the queries of this subpackage that SQL can express.

Not expressible: trained models (op2, op7), hundreds of ordered regexes with containment (op1),
best-fit bins (op4), a tokenizer (op8, op13), markup with a suffix array (op10), exact components
(op12). Those are tested
against brute force, round trips and held-out labels.
"""

from __future__ import annotations

from seriesprep.llm import quality, urls
from seriesprep.llm.decontaminate import WINDOW
from seriesprep.llm.shared import LOWER, UPPER

PLAIN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SPACED = r"[^\x20\x09-\x0D]+"


def lowered(text: str) -> str:
    return f"translate(coalesce({text}, ''), '{UPPER}', '{LOWER}')"


DECONTAMINATION = f"""with d as (
  select row_number() over () as r, doc_id, regexp_extract_all({lowered("text")}, '{PLAIN}') as w from documents),
i as (select item_id, regexp_extract_all({lowered("text")}, '{PLAIN}') as w from benchmark),
wanted as (
  select distinct item_id, least({WINDOW}, len(w)) as n,
    array_to_string(w[s : s + least({WINDOW}, len(w)) - 1], ' ') as g
  from (select *, unnest(range(1, len(w) - least({WINDOW}, len(w)) + 2)) as s from i where len(w) > 0)),
places as (
  select r, n, s, array_to_string(w[s : s + n - 1], ' ') as g
  from (select r, n, w, unnest(range(1, len(w) - n + 2)) as s from d, (select distinct n from wanted) where len(w) >= n)),
hits as (select r, s, p.n, item_id from places p join wanted v on p.g = v.g and p.n = v.n),
words as (select r, count(distinct k) as n_hit from (select r, unnest(range(s, s + n)) as k from hits) group by r),
items as (
  select r, count(*) as n_items, string_agg(item_id::varchar, ',' order by item_id::varchar) as names
  from (select distinct r, item_id from hits where item_id is not null) group by r)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
  sha256(coalesce(names, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join words using (r) left join items using (r)"""

NEAR_DEDUP = f"""with recursive d as (
  select row_number() over () as r, doc_id, regexp_extract_all({lowered("text")}, '{SPACED}') as w from documents),
sets as (
  select r, doc_id, list_distinct(case when len(w) = 1 then w
    else list_transform(range(1, len(w)), lambda k: w[k] || ' ' || w[k + 1]) end) as s from d),
items as (select r, len(s) as n, unnest(s) as g from sets),
links as (
  select a.r as x, b.r as y from items a join items b on a.g = b.g and a.r < b.r
  and 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
  group by a.r, b.r having 100 * count(*) >= 80 * (any_value(a.n) + any_value(b.n) - count(*))),
both_ways as (select x, y from links union all select y, x from links),
reach as (
  select r as x, r as y from sets union select reach.x, both_ways.y from reach join both_ways on reach.y = both_ways.x),
names as (select x as r, min(doc_id) as component_id from reach join sets on sets.r = reach.y group by x)
select doc_id, len(s)::bigint as n_shingles, component_id, doc_id = component_id as kept from sets join names using (r)"""


def _js(p: str, q: str) -> str:
    part = lambda a, b: f"case when {a}[k] > 0 then {a}[k] * log2(2 * {a}[k] / ({a}[k] + {b}[k])) else 0 end"
    return f"sqrt(greatest(0, list_sum(list_transform(range(1, len({p}) + 1), lambda k: ({part(p, q)} + {part(q, p)}) / 2))))"


def _rounded(value: str, name: str) -> str:
    return f"round({value} + 1e-9, 6) + 0.0 as {name}"


_LISTS = " ".join(
    f"when '{code}' then [{', '.join(repr(w) for w in listed)}]" for code, listed in quality.COMMON.items()
)
_LIMITS = quality.QualityLimits()
_MEANS = lambda name, n: "[" + ", ".join(f"avg({name}[{k}])" for k in range(1, n + 1)) + "]"

QUALITY = f"""with d as (
  select row_number() over () as r, doc_id, coalesce(text, '') as t, coalesce(lang, '') as lang,
    regexp_extract_all(coalesce(text, ''), '{SPACED}') as w,
    case coalesce(lang, '') {_LISTS} else [] end as common from documents),
grams as (
  select r, s, count(*) over (partition by r, g) as times from (
    select r, s, array_to_string(w[s : s + 4], ' ') as g
    from (select r, w, unnest(range(1, len(w) - 3)) as s from d where len(w) >= 5))),
repeats as (
  select r, count(distinct k) as n_repeat_words
  from (select r, unnest(range(s, s + 5)) as k from grams where times > 1) group by r),
counted as (
  select d.*, len(w)::bigint as n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::bigint as word_chars,
    len(regexp_extract_all(t, '[#*$%&|<>]'))::bigint as n_symbols,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) as lines,
    coalesce(n_repeat_words, 0)::bigint as n_repeat_words
  from d left join repeats using (r)),
parts as (
  select *, [len(regexp_extract_all(t, '[A-Z]')) / greatest(length(t), 1), len(regexp_extract_all(t, '[0-9]')) / greatest(length(t), 1),
    n_symbols / greatest(length(t), 1), (length(t) - word_chars) / greatest(length(t), 1)] as c,
    list_transform(common, lambda x: len(list_filter(w, lambda y: y = x)) / greatest(n_words, 1)) as v from counted),
shares as (
  select *, list_append(c, 1 - list_sum(c)) as classes, list_append(v, 1 - coalesce(list_sum(v), 0)) as words from parts),
refs as (
  select lang, {_MEANS("classes", quality.N_CLASSES)} as rc, list_filter({_MEANS("words", quality.N_COMMON + 1)}, lambda x: x is not null) as rw
  from shares where n_words >= {_LIMITS.judged_words} group by lang),
judged as (
  select s.*, case when n_words >= {_LIMITS.judged_words} then {_js("classes", "rc")} end as dc,
    case when n_words >= {_LIMITS.judged_words} then {_js("words", "rw")} end as dw,
    n_words < {_LIMITS.least_words} or 100 * n_repeat_words > {_LIMITS.repeat_percent} * n_words as base_failed
  from shares s left join refs using (lang))
select doc_id, n_words, word_chars, n_symbols, (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines, n_repeat_words,
  base_failed, not base_failed and coalesce(dc, 0) <= {_LIMITS.class_distance} and coalesce(dw, 0) <= {_LIMITS.word_distance} as kept,
  {_rounded("dc", "class_distance")}, {_rounded("dw", "word_distance")} from judged"""


def _url_filter(bad_share: float = 0.5, z: float = 1.645) -> str:
    fits = " ".join(
        f"when (host = '{r.host}' or suffix(host, '.{r.host}')) and prefix(path, '{r.path}') then '{r.name}'"
        for r in sorted(urls.RULES, key=lambda r: -len(r.name))
    )
    said = " ".join(f"when '{r.name}' then '{r.verdict}'" for r in urls.RULES)
    two = ", ".join(f"'{s}'" for s in urls.TWO_LABEL_SUFFIXES)
    last = lambda k: f"array_to_string(list_slice(string_split(name, '.'), -{k}, -1), '.')"
    levels, known, upper = [], "", "1"
    for level in urls.LEVELS:
        keys = f"{level}{', ' + known if known else ''}"
        prior = f"any_value({known}_post.mean)" if known else "(select (coalesce(sum(k), 0) + 1) / (coalesce(sum(n), 0) + 2) from hosts)"
        source = f"hosts join {known}_post using ({known})" if known else "hosts"
        levels.append(
            f"""{level}_sum as (select {keys}, sum(hosts.n) as n, sum(hosts.k) as k, {prior} as prior from {source} group by {keys}),
{level}_rho as (select (sum(n * pow(k / n - prior, 2) / (prior * (1 - prior))) - count(*)) / nullif(sum(n - 1), 0) as rho
  from {level}_sum where n > 0),
{level}_post as (select *, a / (a + b) as mean from (select s.*, prior * wt + k as a, (1 - prior) * wt + n - k as b
  from {level}_sum s, (select case when rho > 0 then least(1000.0, greatest(1.0, 1 / rho - 1)) else 1000.0 end as wt from {level}_rho)))"""
        )
        known = level
    return f"""with outcomes as (
  select doc_id as page_id, max(greatest((quality = 0)::int, (toxic = 1)::int)) as bad from labels
  where doc_id is not null group by 1 having bad is not null),
parts as (
  select page_id, regexp_extract(coalesce(url, ''), '(?s)^.*?://(.*)$', 1) as rest from pages),
urls as (
  select page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}') as host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from parts),
hosts as (
  select host, case when wide then {last(2)} else {last(1)} end as suffix, case when wide then {last(3)} else {last(2)} end as domain, n, k
  from (select *, {last(2)} in ({two}) as wide from (
    select host, regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', '') as name, count(bad) as n, coalesce(sum(bad), 0) as k
    from urls left join outcomes using (page_id) group by host))),
{",".join(levels)},
judged as (
  select page_id, host, path, case {fits} end as rule, h.mean, h.mean - {z} * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) as low
  from urls join host_post h using (host))
select page_id, host, path, rule, coalesce(case rule {said} end, case when low > {bad_share} then 'block' else 'allow' end) as verdict,
  {_rounded("mean", "bad_mean")}, {_rounded("low", "bad_low")} from judged"""


COLLOCATIONS = f"""with p as (
  select row_number() over () as r, lang, regexp_extract_all(piece, '[^\x20\x09]+') as w
  from (select coalesce(lang, 'und') as lang,
    unnest(regexp_split_to_array({lowered("text")}, '[.,;:!?\x0A-\x0D]')) as piece from documents)),
total as (select lang, sum(len(w)) as n from p group by lang),
counts as (
  select lang, m, array_to_string(w[s : s + m - 1], ' ') as phrase, count(*) as a
  from (select lang, w, m, unnest(range(1, len(w) - m + 2)) as s from p, range(1, 6) as lengths(m) where len(w) >= m)
  group by all),
frequent as (select * from counts where a >= 100),
candidates as (select * from frequent where m > 1),
cuts as (
  select c.lang, c.phrase, c.a, x.a as l, y.a as r, k, n, 1000::hugeint * c.a * n // (x.a::hugeint * y.a) as score
  from (select *, unnest(range(1, m)) as k, string_split(phrase, ' ') as w from candidates) c
  join frequent x on x.lang = c.lang and x.phrase = array_to_string(c.w[1 : k], ' ')
  join frequent y on y.lang = c.lang and y.phrase = array_to_string(c.w[k + 1 :], ' ')
  join total on total.lang = c.lang),
weakest as (select * from cuts qualify row_number() over (partition by lang, phrase order by score, k) = 1),
parts as (
  select lang, a as longer, array_to_string(w[s : s + j - 1], ' ') as phrase
  from (select *, unnest(range(1, m - j + 2)) as s
    from (select lang, a, m, string_split(phrase, ' ') as w, unnest(range(2, m)) as j from candidates where m > 2))),
inside as (select lang, phrase, max(longer) as longer from parts group by all),
kept as (
  select weakest.* from weakest left join inside using (lang, phrase) where longer is null or 100 * longer < 100 * a)
select lang, row_number() over (partition by lang order by score desc, a desc, phrase) as rank, phrase, a, l, r,
  n::bigint as n, score::bigint as score
from kept qualify rank <= 2000"""


ORACLES: dict[str, str] = {
    "op3_decontamination": DECONTAMINATION,
    "op5_url_filter": _url_filter(),
    "op6_near_dedup": NEAR_DEDUP,
    "op9_quality_rules": QUALITY,
    "op11_collocations": COLLOCATIONS,
}
