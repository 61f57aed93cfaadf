"""SQL twins of the matching queries."""

from __future__ import annotations

from oracle import exprs as X
from oracle.posting_sql import TERMS, VIEW_SQL
from oracle.registry import sql
from oracle.structure_sql import SEGMENTED
from oracle.text_sql import VOCAB
from termloom import fixed_values as fv
from termloom.functions.text import PIECE_SPLIT, WORD_EDGE
from termloom.plans import corpus as D

MAX_WORDS = 4  # no term of the stored tables is longer

_kw = list({k.lower(): k for k in reversed(D.USER_KEYWORDS)}.values())
_vals = ", ".join(f"({X.lit(k)})" for k in _kw)
POOL = f"""{TERMS}, pu as (select posting_id, term as display, 'jd' as source, priority, case priority when 'HIGH' then 0 when 'MEDIUM' then 1 else 2 end as sr, rank as pos from terms
 union all select posting_id, k, 'user', 'HIGH', 4, 0 from posts, (values {_vals}) u(k)),
pn as (select *, {X.soft('display')} as term from pu),
pr as (select *, row_number() over (partition by posting_id, term order by sr, pos) as r from pn where term <> ''),
pool as (select posting_id, term, display, source, priority from pr where r = 1)"""
sql("target_pool", f"with {POOL} select posting_id, term, display, source, priority from pool")
_syn = ", ".join(f"({X.lit(t)}, {X.lit(s)}, {i})" for t, ss in D.SYNONYMS.items() for i, s in enumerate(ss))
_cred = ", ".join(f"({X.lit(a)}, {X.lit(b)}), ({X.lit(b)}, {X.lit(a)})" for a, b in D.CREDENTIALS.items())


def expand(src: str) -> str:
    """CTEs ending in ex(term, variant, ord) over the distinct terms of ``src``."""
    return f"""syn(t, s, i) as (values {_syn}), cred0(c, tw) as (values {_cred}), cred as (select c, min(tw) as tw from cred0 group by c),
eb as (select distinct term, regexp_replace(term, 's$', '') as one, case when contains(term, ' ') then string_split(term, ' ')[-1] end as head,
 {X.rr('term', fv.CREDENTIAL_SUFFIX, '')} as cr from {src}),
ek as (select *, case when term in (select t from syn) then term else one end as k, case when head in (select t from syn) then head else regexp_replace(head, 's$', '') end as hk,
 case when term in (select c from cred) then term else cr end as ck from eb),
ex0 as (select term, term as variant, 0 as ord from ek union all select term, s, 100 + i from ek join syn on t = k
 union all select term, s, 10000 + i from ek join syn on t = hk union all select term, tw, 1000000 from ek join cred on c = ck),
ex as (select term, variant, min(ord) as ord from ex0 group by 1, 2)"""


sql("expand_terms", f"with {TERMS}, {VOCAB}, vt as (select term from terms union select word from vocab), {expand('vt')} select term, variant, ord::bigint as ord from ex")


def term_key(x: str) -> str:
    s = X.soft(x)
    words = f"flatten(list_transform(regexp_split_to_array({s}, {X.lit(PIECE_SPLIT)}), lambda p: list_filter(list_transform(string_split(p, ' '), lambda w: {X.rr('w', WORD_EDGE, '')}), lambda w: w <> '')))"
    return f"array_to_string({words}, ' ')"


def forms(src: str, word_mode: bool = True) -> str:
    k = term_key("f") if word_mode else "f"
    return f"""f0 as (select distinct term from {src}), f1 as (select term, term as f, true as literal from f0 union all select term, {X.singular('term')}, false from f0 union all select term, {X.plural('term')}, false from f0),
forms as (select term, form, bool_or(literal) as literal from (select term, {k} as form, literal from f1) where form <> '' group by 1, 2)"""


def word_hits(docs: str, key: str, src: str) -> str:
    return f"""{X.grams_cte(docs, key, 'text', MAX_WORDS)}, {forms(src)},
hits as (select {key}, term, case when sum(literal::int) > 0 then sum(literal::int) else count(*) end as mentions from grams join forms on gram = form group by all)"""


def unordered(docs: str, src: str, key: str = "doc_id") -> str:
    return f"""dw as (select distinct {key}, w from grams_w where w <> ''),
ut as (select term, tok, len(toks) as n from (select term, toks, unnest(toks) as tok from (select term, list_distinct(list_filter(string_split(term, ' '), lambda t: length(t) > 1 and t not in {X.words_in(D.STOPS)})) as toks
 from (select distinct term from {src}) q) where len(toks) > 1)),
uf as (select distinct term, tok, n, unnest([tok, {X.singular('tok')}]) as w from ut),
uh as (select {key}, term from dw join uf using (w) group by {key}, term, n having count(distinct tok) = n)"""


T0 = f"{TERMS}, dt as (select distinct term from terms)"
sql("term_hits", f"with {T0}, {word_hits('documents', 'doc_id', 'dt')} select doc_id, term, mentions::bigint as mentions from hits")
sql("term_hits_substring", f"""with {T0}, {forms('dt', False)}, hay as (select doc_id, {X.soft('text')} as hay from documents),
c as (select doc_id, term, literal, {X.occ('hay', 'form')} as n from hay join forms on contains(hay, form))
select doc_id, term, (case when sum(n) filter (where literal) > 0 then sum(n) filter (where literal) else sum(n) end)::bigint as mentions from c group by 1, 2""")
sql("term_hits_unordered", f"with {T0}, {X.grams_cte('documents', 'doc_id', 'text', 1)}, {unordered('documents', 'dt')} select doc_id, term from uh")


def evidence(src: str, docs: str = "documents") -> str:
    """CTEs ending in ev(doc_id, term, status, mentions, resume_term)."""
    return f"""{expand(src)}, vs as (select distinct variant as term from ex), {word_hits(docs, 'doc_id', 'vs')}, {unordered(docs, 'vs')},
ah as (select doc_id, variant, max(mentions) as mentions from (select doc_id, term as variant, mentions from hits union all select doc_id, term, 0 from uh) group by 1, 2),
ev0 as (select doc_id, term, coalesce(max(mentions) filter (where ord = 0), 0) as lit, arg_min(variant, ord) as fv, arg_min(mentions, ord) as fm from ah join ex using (variant) group by 1, 2),
ev as (select doc_id, term, case when lit > 0 then 'MATCHED' else 'SYNONYM' end as status, case when lit > 0 then lit else fm end as mentions, case when lit > 0 then term else fv end as resume_term from ev0)"""


MATCH = f"""{POOL}, {evidence('pool')}, pairs as (select distinct posting_id, doc_id from pool join ev using (term)),
matches as (select posting_id, doc_id, term, source, priority, coalesce(status, 'MISSING') as status, coalesce(mentions, 0) as mentions, resume_term
 from pairs join pool using (posting_id) left join ev using (doc_id, term))"""
sql("match_status", f"with {MATCH} select posting_id, doc_id, term, source, priority, status, mentions::bigint as mentions, resume_term from matches")
sql("missing_terms", f"""with {MATCH} select m.posting_id, doc_id, m.term, coalesce(t.category, 'other') as category from matches m
 left join terms t on t.posting_id = m.posting_id and t.term = m.term where status = 'MISSING'""")
sql("evidence_docs", f"with {TERMS}, {evidence('terms')} select doc_id, source from documents where doc_id in (select doc_id from ev where term in (select term from terms where {VIEW_SQL['tools']}))")
_sec = "sdocs as (select doc_id, section_id, string_agg(text, chr(10) order by line_no) as text from seg where section_id is not null and in_body group by 1, 2)"
sql("match_locations", f"""with {TERMS}, {SEGMENTED}, {_sec}, {expand('terms')}, vs as (select distinct variant as term from ex), {word_hits('sdocs', 'doc_id, section_id', 'vs')}, {unordered('sdocs', 'vs', 'doc_id, section_id')},
both_hits as (select doc_id, section_id, term from hits union select doc_id, section_id, term from uh)
select doc_id, ex.term, bool_or(section_id = 'summary') as in_summary, bool_or(section_id = 'skills') as in_skills, bool_or(section_id = 'experience') as in_experience
from both_hits h join ex on ex.variant = h.term group by 1, 2""")
sql("can_substitute", f"""with {VOCAB}, vt as (select word as term from vocab), {expand('vt')},
p as (select variant as source, term as target from ex union select term, variant from ex),
rules as (select s as src, t as tgt from syn union select 'thing', 'edth' union select 'thti', 'hation')
select source, target, source = target or (source, target) in (select src, tgt from rules) as allowed from p""")
sql("match_summary", f"""with {MATCH}, rules as (select s as src, t as tgt from syn union select 'thing', 'edth' union select 'thti', 'hation') select posting_id, doc_id, count(*)::bigint as targets, count(*) filter (where status <> 'MISSING')::bigint as matched,
 count(*) filter (where status = 'MATCHED')::bigint as literal, count(*) filter (where status = 'SYNONYM')::bigint as via_synonym, count(*) filter (where status = 'MISSING')::bigint as missing,
 floor(count(*) filter (where status <> 'MISSING') * 100.0::double / count(*) + 0.5)::bigint as coverage,
 count(*) filter (where status = 'SYNONYM' and (resume_term = term or (resume_term, term) in (select src, tgt from rules)))::bigint as insertable from matches group by 1, 2""")
sql("repeated_terms", f"with {TERMS}, {evidence('terms')} select doc_id, term, mentions::bigint as mentions, case when mentions >= 6 then 'high' else 'moderate' end as level from ev where status = 'MATCHED' and mentions >= 3")
sql("term_demand", f"""with {POOL}, {evidence('pool')}, w as (select term, count(distinct posting_id) as n_postings from pool group by 1), h as (select term, count(*) as n from ev group by 1)
select term, n_postings::bigint as n_postings, coalesce(n, 0)::bigint as n_docs, ((select count(*) from documents) - coalesce(n, 0))::bigint as n_missing from w left join h using (term)""")
