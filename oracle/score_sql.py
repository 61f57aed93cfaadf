"""SQL twins of the score queries."""

from __future__ import annotations

from oracle import exprs as X
from oracle.match_sql import MATCH, POOL, evidence
from oracle.registry import sql
from oracle.structure_sql import SECTIONS, SEGMENTED, _bt, split_list
from oracle.text_sql import DATED, lines_cte
from termloom import fixed_values as fv
from termloom.functions.text import WORD_EDGE
from termloom.operators import entries as E
from termloom.operators.scores import VERDICTS
from termloom.plans import corpus as D

_pw = "case priority " + " ".join(f"when '{p}' then {w}" for p, w in D.PRIORITY_WEIGHTS.items()) + " end"
_c = {"dom": "category in ('domain', 'domain-skill')", "tech": "category in ('technology', 'domain-skill')",
      "req": "(required and category <> 'soft-skill')", "hard": "required"}
_win = ", ".join(f"sum(({c})::int) over (partition by posting_id order by rank rows unbounded preceding) as r_{n}, sum(({c})::int) over (partition by posting_id) as n_{n}, {c} as b_{n}" for n, c in _c.items())
_e = lambda a, b: f"case when n_{a} > 0 then b_{a} else b_{b} end"
FLAGS = f"""{POOL}, tw as (select posting_id, term, {_win} from terms),
tf as (select posting_id, term, b_req or b_hard as must, b_tech, {_e('dom', 'tech')} as in_dom, {_e('req', 'tech')} as in_req, {_e('req', 'hard')} as in_req_job from tw),
flags as (select p.posting_id, p.term, case when source = 'jd' then {_pw} else 0 end as w_ats,
 case when source = 'jd' and priority in ('HIGH', 'MEDIUM') then {_pw} when coalesce(must, false) then 3 when source <> 'jd' then 2 else {_pw} end as w_job,
 (source <> 'jd')::int as is_user, coalesce(in_dom, false)::int as in_dom, coalesce(in_req, false)::int as in_req, coalesce(in_req_job, false)::int as in_req_job,
 (priority = 'HIGH')::int as is_high, coalesce(b_tech, false)::int as is_tech from pool p left join tf on tf.posting_id = p.posting_id and tf.term = p.term)"""
_cols = ["w_ats", "w_job", "is_user", "in_dom", "in_req", "in_req_job", "is_high", "is_tech"]
HITS = f"""{FLAGS}, {evidence('pool')}, tot as (select posting_id, {', '.join(f'sum({c}) as t_{c}' for c in _cols)} from flags group by 1),
ph as (select posting_id, doc_id, {', '.join(f'sum({c}) as h_{c}' for c in _cols)} from flags join ev using (term) group by 1, 2)"""
_dw = X.rr("w", WORD_EDGE, "")
DUTY = f"""du0 as (select posting_id, {_dw} as word from (select posting_id, unnest(regexp_split_to_array(lower(text), '[^a-z0-9+#/.-]+')) as w from pl where bucket = 'responsibilities')),
du as (select posting_id, word, count(*) as n from du0 where length(word) > 5 group by 1, 2), dt0 as (select posting_id, sum(n) as t_duty from du group by 1),
dh as (select posting_id, doc_id, sum(n) as h_duty from du join (select distinct doc_id, w from grams_w) g on g.w = du.word group by 1, 2)"""


def mentions(h: str, n: str) -> str:
    toks = f"list_filter(string_split({n}, ' '), lambda tk: length(tk) > 1 and tk not in {X.words_in(D.STOPS)})"
    ws = f"string_split({h}, ' ')"
    return (f"({n} <> '' and (contains({h}, {n}) or contains({h}, {X.singular(n)}) or contains({h}, {X.plural(n)}) or (len({toks}) > 1 and "
            f"len(list_filter({toks}, lambda tk: list_contains({ws}, tk) or list_contains({ws}, {X.singular('tk')}))) = len({toks}))))")


TITLE = f"""roles as (select doc_id, {X.soft('text')} as r from lines where length(text) <= 40),
ti as (select posting_id, {X.soft('title')} as t from titles),
tj as (select ph.posting_id, ph.doc_id, t, r from ph left join ti using (posting_id) left join (select * from roles where r <> '') ro on ro.doc_id = ph.doc_id),
tn as (select *, {mentions('r', 't')} or {mentions('t', 'r')} as near, {X.similarity('r', 't')} as sim from tj),
ta as (select posting_id, doc_id, max(case when r = t then 100.0::double when near then 88.0::double else sim * 70 end) as a,
 max(case when r = t then 100.0::double when near then 86.0::double else sim * 72 end) as j, max(t) as t, count(r) as n from tn group by 1, 2),
tl2 as (select posting_id, doc_id, case when t = '' then 50 when n = 0 then 30 else {X.clamp('a')} end as title_ats,
 case when t = '' and n > 0 then 60 when t = '' then 50 when n = 0 then 25 else {X.clamp('j')} end as title_job from ta)"""
_nw = X.count_words("text")
_over = "regexp_split_to_array(lower(text), '[^a-z0-9+#/.-]+')"
OVER = f"""ow as (select doc_id, w as word, count(*) as n from (select doc_id, unnest({_over}) as w from lines) where length(w) > 3 group by 1, 2 having count(*) >= 4),
over25 as (select * from (select *, row_number() over (partition by doc_id order by n desc, word) as r from ow))"""
DUPS = f"dups as (select doc_id, k as bullet_key, min(line_no) as first_no, count(*) - 1 as n_extra from (select doc_id, line_no, {X.soft('text')} as k from lines) where k <> '' group by 1, 2 having count(*) > 1)"
_order = "list_position([" + ", ".join(X.lit(s) for s in fv.SECTION_ORDER) + "], section_id)"
PRESENT = f"""{SECTIONS}, pres0 as (select doc_id, section_id, min(section_no) as fs from secs where section_id <> 'contact' and line_count > 0 group by 1, 2),
pres as (select doc_id, section_id, row_number() over (partition by doc_id order by fs) as position, {_order} as cp from pres0),
pl2 as (select *, lag(cp) over (partition by doc_id order by position) as prev from pres),
ordr as (select doc_id, case when count(*) < 2 then 60 else {X.clamp("(100.0::double - count(*) filter (where cp < prev) * 100.0::double / greatest(count(*) - 1, 1))")} end as order_score from pl2 group by 1)"""
FEATURES = f"""{PRESENT}, {OVER}, {DUPS},
bf as (select doc_id, count(*) as n_bullets, count(*) filter (where {X.starts_with_verb('text', D.VERBS)}) as n_verb, count(*) filter (where {_nw} between 8 and 28) as n_ideal,
 count(*) filter (where {_nw} > 34) as n_long, count(*) filter (where {_nw} between 1 and 4) as n_short, count(*) filter (where {X.rm('text', fv.PASSIVE)}) as n_passive,
 count(*) filter (where {X.rm('text', fv.METRIC)}) as n_metric, sum({_nw}) as sum_words from lines group by 1),
sk0 as (select doc_id, line_no, t from (select doc_id, line_no, section_id, in_body, {_bt} as t from seg) where section_id = 'skills' and in_body),
sk as (select doc_id, sum(len(items)) as n_skills from (select doc_id, {split_list(f"case when {X.rm('t', E.SKILL_LABEL)} and len(string_split(trim({X.rx('t', E.SKILL_LABEL, 1)}), ' ')) <= 4 and trim({X.rx('t', E.SKILL_LABEL, 2)}) <> '' and trim({X.rx('t', E.SKILL_LABEL, 1)}) <> '' then trim({X.rx('t', E.SKILL_LABEL, 2)}) else t end")} as items from sk0) group by 1),
feat as (select d.doc_id, {X.count_words('d.text')} as doc_words, bf.* exclude (doc_id), n_over, n_dups, n_core, n_sections, order_score, n_skills from documents d left join bf using (doc_id)
 left join (select doc_id, count(*) filter (where n >= 5) as n_over from over25 group by 1) o using (doc_id) left join (select doc_id, sum(n_extra) as n_dups from dups group by 1) du using (doc_id)
 left join (select doc_id, count(*) filter (where section_id in {X.words_in(fv.CORE_SECTIONS)}) as n_core, count(*) as n_sections from pres group by 1) co using (doc_id)
 left join ordr using (doc_id) left join sk using (doc_id))"""
_sh = lambda c: f"({c} * 1.0::double / n_bullets)"
VERB = f"case when coalesce(n_bullets, 0) > 0 then {X.pct('n_verb', 'n_bullets')} else 50 end"
_read = f"({_sh('n_ideal')} * 60 + (1 - {_sh('n_long')}) * 20 + (1 - {_sh('n_short')}) * 10 + (1 - {_sh('n_passive')}) * 10)"
READ = f"case when coalesce(n_bullets, 0) > 0 then {X.clamp(_read)} else 60 end"
STRUCT = X.clamp(f"({X.pct('coalesce(n_core, 0)', '4')} * 0.65::double + coalesce(order_score, 60) * 0.35::double - case when coalesce(n_bullets, 0) > 45 then 8 when coalesce(n_bullets, 0) > 30 then 4 else 0 end)")
DUPSC = X.clamp("(100 - coalesce(n_dups, 0) * 12 - coalesce(n_over, 0) * 4)::double")
_breadth = X.clamp("(least(100.0::double, coalesce(n_skills, 0) / 14.0::double * 100))")
_fit = f"case when coalesce(n_bullets, 0) > 0 then {X.clamp('(100 - least(100.0::double, abs(sum_words * 1.0::double / n_bullets - 18) * 5))')} else 40 end"
EVID = X.clamp(f"(case when coalesce(n_bullets, 0) > 0 then n_metric * 1.0::double / n_bullets else 0.0::double end * 40 + coalesce(n_core, 0) / 4.0::double * 30 + {_breadth} * 0.15::double + {_fit} * 0.15::double)")
_r = lambda c: f"(h_{c} * 1.0::double / t_{c})"
_duty = f"case when t_duty > 0 then {_r('duty')} * 30 else 30.0::double end"
_lang = lambda other: f"case when t_in_dom > 0 then {X.clamp('(' + _r('in_dom') + ' * 70 + ' + _duty + ')')} else {other} end"
ATS = {
    "keywordCoverage": f"case when t_w_ats > 0 then {X.clamp('(' + _r('w_ats') + ' * 80 + case when t_is_user > 0 then ' + _r('is_user') + ' * 20 else 20.0::double end)')} when t_is_user > 0 then {X.pct('h_is_user', 't_is_user')} else 55 end",
    "jdRelevance": _lang("60"),
    "skillAlignment": f"case when t_in_req > 0 then {X.pct('h_in_req', 't_in_req')} else 60 end",
    "titleAlignment": "coalesce(title_ats, 50)", "actionVerbs": VERB, "readability": READ, "sectionStructure": STRUCT, "duplicateContent": DUPSC,
    "missingKeywords": f"case when t_is_high - h_is_high > 0 then {X.clamp('(100 - least(100, (t_is_high - h_is_high) * 12))::double')} when t_is_high > 0 then 100 else 92 end",
    "unsupportedKeywords": "100 - case when t_is_tech - h_is_tech > 0 then 4 else 0 end",
}
JOB = {
    "keywordCoverage": f"case when t_w_job > 0 then {X.pct('h_w_job', 't_w_job')} else 50 end",
    "requiredSkills": f"case when t_in_req_job > 0 then {X.pct('h_in_req_job', 't_in_req_job')} else 60 end",
    "roleAlignment": "coalesce(title_job, 50)",
    "jdLanguage": _lang(f"case when t_duty > 0 then {X.clamp('(' + _r('duty') + ' * 100)')} else 55 end"), "evidenceStrength": EVID,
}
WIDE = f"""{HITS}, {DUTY}, {FEATURES}, {TITLE},
wide as (select ph.*, tot.* exclude (posting_id), coalesce(t_duty, 0) as t_duty, coalesce(h_duty, 0) as h_duty, title_ats, title_job, feat.* exclude (doc_id)
 from ph join tot using (posting_id) left join dt0 using (posting_id) left join dh on dh.posting_id = ph.posting_id and dh.doc_id = ph.doc_id
 left join tl2 on tl2.posting_id = ph.posting_id and tl2.doc_id = ph.doc_id left join feat on feat.doc_id = ph.doc_id)"""


def comp(name: str, text: str, value: str) -> None:
    sql(name, f"with {text}, v as (select posting_id, doc_id, {value} as value from wide) select posting_id, doc_id, value::bigint as value from v")


def doc(name: str, value: str) -> None:
    sql(name, f"with {FEATURES} select doc_id, ({value})::bigint as value from feat")


def banded(x: str, bands, lowest: str) -> str:
    return "case " + " ".join(f"when {x} >= {lo} then '{n}'" for lo, n in bands) + f" else '{lowest}' end"


sql("weighted_coverage", f"""with {FLAGS}, {evidence('pool')}, t as (select posting_id, sum(w_ats) as t from flags where w_ats > 0 group by 1),
h as (select posting_id, doc_id, sum(w_ats) as h from flags join ev using (term) where w_ats > 0 group by 1, 2) select posting_id, doc_id, ({X.pct('h', 't')})::bigint as coverage from h join t using (posting_id)""")
RANKED = f"""{FLAGS}, {evidence('pool')}, t as (select posting_id, sum(w_job) as t from flags where w_job > 0 group by 1),
h as (select posting_id, doc_id, sum(w_job) as h from flags join ev using (term) where w_job > 0 group by 1, 2), cv as (select posting_id, doc_id, {X.pct('h', 't')} as score from h join t using (posting_id)),
rk as (select *, row_number() over (partition by posting_id order by score desc, doc_id) as rank from cv)"""
sql("rank_docs", f"with {RANKED} select posting_id, rank::bigint as rank, doc_id, score::bigint as score from rk where rank <= 5")
comp("required_coverage", WIDE, ATS["skillAlignment"])
comp("posting_language", WIDE, ATS["jdRelevance"])
sql("title_alignment", f"with {WIDE} select posting_id, doc_id, title_ats::bigint as title_ats, title_job::bigint as title_job from wide")
doc("verb_share", VERB)
doc("readability", READ)
sql("section_order", f"with {PRESENT} select doc_id, order_score::bigint as order_score from ordr")
doc("structure_score", STRUCT)
sql("overused_words", f"with {lines_cte()}, {OVER} select doc_id, 'body' as section, word, n::bigint as n, case when n >= 6 then 'high' else 'moderate' end as severity from over25")
sql("duplicate_bullets", f"with {lines_cte()}, {DUPS} select doc_id, bullet_key, first_no::bigint as first_no, n_extra::bigint as n_extra from dups")
doc("duplicate_score", DUPSC)
comp("missing_score", WIDE, ATS["missingKeywords"])
comp("unsupported_score", WIDE, ATS["unsupportedKeywords"])
doc("evidence_strength", EVID)
_ats = " + ".join(f"({v}) * {fv.ATS_WEIGHTS[n]}" for n, v in ATS.items())
_job = " + ".join(f"({v}) * {fv.JOB_WEIGHTS[n]}" for n, v in JOB.items())
ATS_SC = f"{WIDE}, sc as (select posting_id, doc_id, {X.clamp(f'(({_ats}) / 100.0::double)')} as score from wide)"
JOB_SC = f"{WIDE}, sc as (select posting_id, doc_id, {X.clamp(f'(({_job}) / 100.0::double)')} as score from wide)"
sql("ats_score", f"with {ATS_SC} select posting_id, doc_id, score::bigint as score, {banded('score', fv.ATS_BANDS, 'weak')} as band from sc")
_b = banded("score", fv.JOB_BANDS, "low")
_v = "case band " + " ".join(f"when '{k}' then {X.lit(v)}" for k, v in VERDICTS.items()) + " end"
sql("job_match_score", f"with {JOB_SC}, b as (select *, {_b} as band from sc) select posting_id, doc_id, score::bigint as score, band, {_v} as verdict from b")
sql("doc_metrics", f"""with {FEATURES} select doc_id, coalesce(n_bullets, 0)::bigint as n_bullets, coalesce(n_skills, 0)::bigint as n_skills, coalesce(n_sections, 0)::bigint as n_sections,
 (case when coalesce(n_bullets, 0) > 0 then floor(sum_words * 1.0::double / n_bullets + 0.5) else 0 end)::bigint as mean_words, coalesce(n_metric, 0)::bigint as n_metric, doc_words::bigint as n_words from feat""")
sql("corpus_rollup", f"""with {JOB_SC}, f as (select posting_id::varchar as posting_id, lang, source, coalesce(quality::varchar, 'none') as quality, score from sc join documents using (doc_id) left join labels using (doc_id)),
c as (select posting_id, lang, source, quality, grouping(posting_id, lang, source, quality) as level, count(*) as n, sum(score) as s, quantile_cont(score::double, 0.5) as p50, quantile_cont(score::double, 0.9) as p90
 from f group by cube (posting_id, lang, source, quality))
select coalesce(posting_id, 'ALL') as posting_id, coalesce(lang, 'ALL') as lang, coalesce(source, 'ALL') as source, coalesce(quality, 'ALL') as quality, level::bigint as level, n::bigint as n,
 floor(s * 10000.0::double / n + 0.5) / 10000.0::double as mean_score, p50 as median, floor(p90 * 10000.0::double + 0.5) / 10000.0::double as p90 from c""")
_un = " union all ".join(f"select posting_id, doc_id, {i} as ord, '{n}' as component, {v} as value from wide" for i, (n, v) in enumerate(ATS.items()))
sql("weakest_component", f"with {WIDE}, u as ({_un}) select posting_id, doc_id, arg_min(component, value * 100 + ord) as component, min(value)::bigint as value from u group by 1, 2")
sql("top_gaps", f"""with {MATCH}, r as (select posting_id, doc_id, term, row_number() over (partition by posting_id, doc_id order by priority, term) as rank from matches where status = 'MISSING' and priority in ('HIGH', 'MEDIUM'))
select posting_id, doc_id, rank::bigint as rank, term from r where rank <= 20""")
sql("metric_first", f"with {lines_cte()} select doc_id, line_no::bigint as bullet_no, row_number() over (partition by doc_id order by {X.rm('text', fv.METRIC)} desc, line_no)::bigint as position from lines")
_f = X.any_word("text", ["from"])
sql("lookahead_header", f"""with {lines_cte()}, b as (select *, {_f} as d, {X.bullet('text', 'marker')} is not null as is_bullet from lines)
select doc_id, line_no::bigint as line_no, coalesce(lead(d, 1) over w, false) or coalesce(lead(d, 2) over w, false) as soon_date,
 coalesce(length(lead(text) over w) <= 90 and not regexp_matches(lead(text) over w, '[.!?]$'), false) or coalesce(lead(is_bullet) over w, false) as next_short from b window w as (partition by doc_id order by line_no)""")
sql("first_seen_dedupe", "select min(event_id) as event_id, user_id, event_type from events group by user_id, event_type")
ENTRIES = f"""{DATED}, ent as (select o_custkey as doc_id, o_orderkey as entry_no, regexp_extract_all(dates, '(?:19|20)[0-9]{{2}}')[1]::int as sy, regexp_extract_all(dates, '(?:19|20)[0-9]{{2}}')[-1]::int as ey, {X.rm('dates', fv.PRESENT_MARKER)} as cur from dated)"""
sql("experience_span", f"""with {ENTRIES} select doc_id, (case when count(sy) + count(*) filter (where ey <> sy) >= 2 then max(coalesce(ey, sy)) - min(sy) end)::bigint as span,
 (case when 2024 - min(sy) between 0 and 45 then 2024 - min(sy) end)::bigint as years from ent group by 1""")
sql("current_role", f"with {ENTRIES} select doc_id, 'Role ' || arg_min(entry_no, (not cur)::int * 1000000000 + entry_no) as role from ent group by 1")
sql("keep_last_12", """select doc_id, version_id, age::bigint as age, age = 1 as is_current from (select user_id as doc_id, event_id as version_id,
 row_number() over (partition by user_id order by ts desc, event_id desc) as age from events) where age <= 12""")
