"""SQL twins of the posting queries."""

from __future__ import annotations

from oracle import exprs as X
from oracle.registry import sql
from oracle.text_sql import category, lines_cte
from termloom import fixed_values as fv
from termloom.functions.text import quote
from termloom.plans import corpus as D

_cue = "case when " + X.any_word("text", D.CUES["noise"]) + " then 'noise' " + " ".join(
    f"when {X.any_word('text', D.CUES[b])} then '{b}'" for b in ("required", "preferred", "responsibilities", "qualifications", "tools")) + " end"
PL = f"""posts as (select item_id as posting_id, text from benchmark), {lines_cte('posts', 'posting_id', 'text', 'bl')},
b1 as (select *, {_cue} as cue from bl),
b2 as (select *, last_value(case when cue <> 'noise' then cue end ignore nulls) over (partition by posting_id order by line_no rows unbounded preceding) as mode from b1),
pl as (select posting_id, line_no, text, coalesce(cue, case when {X.rm('text', r'^[\x{2022}*-]')} or {X.rm('text', r'^\(?\d{1,2}[.)]\s')} then coalesce(mode, 'general') end, 'general') as bucket from b2)"""
sql("bucket_lines", f"with {PL} select posting_id, line_no::bigint as line_no, text, bucket from pl")
sql("sticky_mode", f"""with {lines_cte()}, c as (select *, case when {X.any_word('text', ['with'])} then 'a' when {X.any_word('text', ['from', 'que'])} then 'b' end as cue from lines)
select doc_id, line_no::bigint as line_no, last_value(cue ignore nulls) over (partition by doc_id order by line_no rows unbounded preceding) as mode from c""")
sql("bucket_counts", f"with {PL} select posting_id, bucket, count(*)::bigint as n from pl group by 1, 2")
sql("posting_excerpts", f"""with {PL}, r as (select *, row_number() over (partition by posting_id, bucket order by line_no) as rank from pl)
select posting_id, bucket, rank::bigint as rank, text from r where rank <= case bucket when 'qualifications' then 12 when 'responsibilities' then 24 when 'general' then 2 else 0 end""")
_tl = "list_filter(list_transform(string_split(text, chr(10)), lambda x: " + X.rr("x", f"^{fv.WS}+|{fv.WS}+$", "") + "), lambda x: regexp_matches(x, '^[A-Z].{4,70}$'))[1]"
_named = X.rx("text", r"(?i)(?:job title|position|role|title)\s*[:-]\s*([^\n]{2,80})")
_raw = f"coalesce(nullif({_named}, ''), {_tl}, '')"
_head = X.collapse(f"regexp_split_to_array({_raw}, {X.lit(r'\s+[-\x{2013}\x{2014}|]\s+|\s*[-(]')})[1]")
TITLES = f"titles as (select posting_id, trim({X.rr(_head, '[.,;]$', '')}) as title from posts)"
sql("posting_title", f"with posts as (select item_id as posting_id, text from benchmark), {TITLES} select posting_id, title from titles")


def gram_ctes(src: str, keys: str, text: str, max_n: int, name: str) -> str:
    """Candidate grams with count, size n and first position."""
    clean = X.rr(f"lower({X.collapse(text)})", r"[^a-z0-9+#/\s-]", " ")
    leads = "".join(f", lead(w, {k}) over (partition by {keys} order by pos) as w{k}" for k in range(1, max_n))
    sel = []
    for n in range(1, max_n + 1):
        cols = ["w"] + [f"w{k}" for k in range(1, n)]
        ok = " and ".join(f"{c} is not null and {c} not in {X.words_in(D.STOPS)}" for c in cols)
        sel.append(f"select {keys}, {' || chr(32) || '.join(cols)} as term, {n} as n, pos from {name}_l where {ok} and length(w) >= 2")
    return f"""{name}_w as (select {keys}, unnest(ws) as w, generate_subscripts(ws, 1) as pos from (
  select {keys}, list_filter(regexp_split_to_array({clean}, '\\s+'), lambda w: w <> '') as ws from {src})),
{name}_l as (select {keys}, pos, w{leads} from {name}_w),
{name} as (select {keys}, term, count(*) as cnt, min(n) as n, min(pos) as pos from ({' union all '.join(sel)}) where term not in {X.words_in(D.BANNED)} group by all)"""


sql("ngrams", f"""with {gram_ctes('documents', 'doc_id', 'text', 3, 'g')}, r as (select *, row_number() over (partition by doc_id order by cnt desc, length(term) desc, term) as rank from g)
select doc_id, term, cnt::bigint as cnt, rank::bigint as rank from r where rank <= 40""")
_s = X.rr("text", r"^[\s\x{2022}*\d.)\]-]+", "")
_s = X.rr(X.rr(_s, r"\s{2,}", " ; "), " ", "  ")
_s = X.rr(_s, rf"(?i)(^|[^a-z0-9_])({'|'.join(fv.GAP_WORDS)})([^a-z0-9_]|$)", r"\1;\3")
_s = X.rr(X.collapse(_s), "[.;:]+$", "")
_parts = f"list_filter(list_transform(regexp_split_to_array({_s}, {X.lit(r'\s*[,;]\s*|\s+/\s+')}), lambda p: trim(p)), lambda p: p <> '')"
CANDS = f"""{PL}, parts as (select posting_id, line_no, bucket, unnest(ps) as part, generate_subscripts(ps, 1) - 1 as part_no from (select *, {_parts} as ps from pl)),
{gram_ctes('parts', 'posting_id, line_no, bucket, part_no', 'part', 3, 'cg')},
cr as (select *, row_number() over (partition by posting_id, line_no, part_no order by cnt desc, length(term) desc, n, pos) as r from cg),
cb as (select *, row_number() over (partition by posting_id, line_no, part_no order by length(term) desc, cnt desc, r) as b from cr ),
cands as (select posting_id, line_no, bucket, part_no, term, cnt from cb where b = 1)"""
sql("line_candidates", f"with {CANDS} select posting_id, line_no::bigint as line_no, part_no::bigint as part_no, term, cnt::bigint as cnt from cands")
_alt = "|".join(quote(w) for w in D.FILLER)


def trim_filler(x: str) -> str:
    return X.rr(X.rr(x, f"^(?:(?:{_alt}) )+", ""), f"(?: (?:{_alt}))+$", "")


def keep(t: str) -> str:
    lists = " and ".join(f"{t} not in {X.words_in(w)}" for w in (D.BANNED, D.STOPS, D.FILLER))
    return (f"(length({t}) >= 2 and {lists} and not contains({t}, ' - ') and {t} not like '-%' and {t} not like '%-' "
            f"and not (contains({t}, ' ') and regexp_matches({t}, '[0-9]')) "
            f"and len(list_filter(string_split({t}, ' '), lambda w: w not in {X.words_in(D.AD_WORDS)})) > 0)")


sql("trim_filler", f"with {lines_cte()}, v as (select distinct lower(text) as term from lines) select term, {trim_filler('term')} as core from v")
sql("noise_terms", f"with {X.grams_cte('documents', 'doc_id', 'text', 2)}, t as (select distinct gram as term from grams) select term from t where {keep('term')}")
FRAGS = f"frags as (select distinct posting_id, unnest(ws) as term from (select posting_id, string_split({X.soft('title')}, ' ') as ws from titles) where len(ws) > 2)"
sql("title_fragment_filter", f"""with {CANDS}, {TITLES}, {FRAGS} select distinct posting_id, term from cands where (posting_id, term) not in (select posting_id, term from frags)""")


def padded(x: str) -> str:
    return f"' ' || trim({X.rr(f'lower({x})', '[^a-z0-9+#/&-]+', ' ')}) || ' '"


def phrase_rows(src: str, key: str, phrases, extra: str = "") -> str:
    vals = ", ".join(f"({X.lit(p)})" for p in phrases)
    return f"select distinct {key}, phrase from {src}, (values {vals}) d(phrase) where contains({padded('text')}, ' ' || phrase || ' ') {extra}"


_creds = "map {" + ", ".join(f"{X.lit(a)}: {X.lit(b)}" for a, b in D.CREDENTIALS.items()) + "}"
_expl = "regexp_extract_all(text, '(?:^|[^A-Za-z0-9_])([A-Z]{2,6}\\s+(?:certification|certified))', 1)"
CERTS = f"""certs as (select posting_id, ({_creds})[phrase] as term from ({phrase_rows('posts', 'posting_id', D.CREDENTIALS)})
 union select posting_id, lower(unnest({_expl})) from posts)"""
SOFT = f"soft as ({phrase_rows('pl', 'posting_id', D.SOFT).replace('phrase from', 'phrase as term from')})"
_w = "case bucket " + " ".join(f"when '{b}' then {w}" for b, w in fv.BUCKET_WEIGHT_C.items()) + " end"
TERMS = f"""{CANDS}, {TITLES}, {FRAGS}, {CERTS}, {SOFT},
tl as (select posting_id, title, {X.soft('title')} as nt from titles where title <> ''),
{gram_ctes('(select posting_id, title from tl where len(string_split(nt, chr(32))) > 4)', 'posting_id', 'title', 3, 'tg')},
tr as (select *, row_number() over (partition by posting_id order by cnt desc, length(term) desc, n, pos) as r from tg),
cu as (select posting_id, term, cnt, {_w} as weight_c, bucket = 'required' as required, bucket = 'preferred' as preferred, bucket = 'tools' as tool from cands where bucket <> 'noise'
 union all select posting_id, nt, 1, {fv.TITLE_WEIGHT_C}, false, false, false from tl where len(string_split(nt, ' ')) <= 4
 union all select posting_id, term, cnt, {fv.TITLE_WEIGHT_C}, false, false, false from tr
 union all select posting_id, term, 1, {fv.CERT_WEIGHT_C}, true, false, false from certs
 union all select posting_id, term, 1, {fv.SOFT_WEIGHT_C}, false, true, false from soft),
cc as (select * replace ({trim_filler(X.soft('term'))} as term) from cu),
weighed as (select posting_id, term, sum(cnt) as cnt, sum(weight_c) as weight_c, bool_or(required) as required, bool_or(preferred) as preferred, bool_or(tool) as tool
 from cc where {keep('term')} and (posting_id, term) not in (select posting_id, term from frags) group by 1, 2),
sc0 as (select *, {category('term')} as category, term in {X.words_in(D.SYNONYMS)} or {X.rr('term', 's$', '')} in {X.words_in(D.SYNONYMS)} as syn from weighed),
sc1 as (select *, weight_c + cnt * {fv.COUNT_WEIGHT_C} + case when syn then {fv.SYNONYM_BONUS_C} else 0 end +
 case when category in ('technology', 'domain-skill', 'qualification') then {fv.CATEGORY_BONUS_C} else 0 end as score_c from sc0),
sc2 as (select *, case when score_c >= {fv.HIGH_SCORE_C} then 'HIGH' when score_c >= {fv.MEDIUM_SCORE_C} then 'MEDIUM' else 'LOW' end as priority,
 row_number() over (partition by posting_id order by score_c desc, term) as rank from sc1),
terms as (select * from sc2)"""
sql("weigh_terms", f"with {TERMS} select posting_id, term, cnt::bigint as cnt, weight_c::double / 100.0::double as weight, required, preferred, tool from weighed")
sql("prioritize_terms", f"with {TERMS} select posting_id, term, category, score_c::double / 100.0::double as score, priority, rank::bigint as rank from terms")
VIEW_SQL = {
    "hard": "required", "required": "required and category <> 'soft-skill'", "preferred": "preferred or (priority = 'MEDIUM' and not required)",
    "tools": "tool or category = 'technology'", "technologies": "category in ('technology', 'domain-skill')", "domain": "category in ('domain', 'domain-skill')"}
sql("term_views", f"with {TERMS} " + " union all ".join(f"select posting_id, term, '{n}' as view from terms where {c}" for n, c in VIEW_SQL.items()))
sql("years_required", """with y as (select o_orderkey as posting_id, o_orderkey % 50 as years, '' as context from orders
 union select o_orderkey, least(o_orderkey % 7, o_orderkey % 5), '' from orders union select o_orderkey, o_orderkey % 9, '' from orders
 union select o_orderkey, o_orderkey % 11, lower(o_orderstatus) || ' trade desks' from orders
 union select o_orderkey, o_orderkey % 5, 'proven experience and' from orders)
select posting_id, years::bigint as years, context from y where years between 1 and 45""")
sql("cert_mentions", f"with {PL}, {CERTS} select distinct posting_id, term from certs")
sql("soft_skill_mentions", f"with {PL}, {SOFT} select distinct posting_id, term from soft")
_ind = phrase_rows("pl", "posting_id", D.INDUSTRIES, "and bucket in ('required', 'responsibilities', 'qualifications', 'general')")
sql("industry_mentions", f"with {PL} select posting_id, string_agg(phrase, ',' order by phrase) as industries from ({_ind}) group by 1")
_vw = "regexp_split_to_array(lower(regexp_replace(text, '[^A-Za-z ]', ' ', 'g')), '\\s+')"
sql("action_verbs", f"""with {PL}, v as (select distinct posting_id, unnest({_vw}) as v from pl where bucket in ('responsibilities', 'required', 'preferred', 'general'))
select posting_id, string_agg(v, ',' order by v) as verbs from v where v in {X.words_in(D.VERBS)} group by 1""")
sql("top_terms", f"with {TERMS} select posting_id, rank::bigint as rank, term from terms where rank <= 10")
