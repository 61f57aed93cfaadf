"""SQL twins of the version queries."""

from __future__ import annotations

from oracle import exprs as X
from oracle.match_sql import word_hits
from oracle.posting_sql import TERMS
from oracle.registry import sql
from oracle.score_sql import DUPSC, FEATURES, READ, VERB
from oracle.text_sql import lines_cte
from termloom import fixed_values as fv
from termloom.operators import versions as V
from termloom.plans import corpus as D

TURNS = "turns as (select a.conv_id, a.turn, a.text as before, b.text as after from conversations a join conversations b on b.conv_id = a.conv_id and b.turn = a.turn + 1)"


def numbers(x: str) -> str:
    n, u = (f"regexp_extract_all({x}, {X.lit(V.NUMBER)}, {g})" for g in (1, 2))
    return (f"list_distinct(list_transform(list_zip({n}, {u}), lambda z: {X.rr('z[1]', '[.,]+$', '')} || "
            f"case when lower(trim(z[2])) in {X.words_in(fv.NUMBER_UNITS)} then lower(z[2]) else '' end))")


def entities(x: str) -> str:
    return f"list_distinct(list_transform(regexp_extract_all({x}, {X.lit(V.ENTITY)}, 1), lambda e: {X.soft('e')}))"


def new(f, name: str, src: str = "turns") -> str:
    return f"{name} as (select conv_id, turn, unnest(list_filter({f('after')}, lambda v: not list_contains({f('before')}, v))) as term from {src})"


ALL = f"{TURNS}, versions as (select * from turns union all select a.doc_id, -1, a.text, b.text from documents a join documents b on b.doc_id = a.doc_id + 1)"


sql("new_numbers", f"with {ALL}, {new(numbers, 'n', 'versions')} select conv_id, turn, 'new-number' as rule, 'critical' as severity, term from n")
sql("new_entities", f"with {ALL}, {new(entities, 'n', 'versions')} select conv_id, turn, 'new-term' as rule, 'warning' as severity, term from n")
_hits = word_hits("conversations", "conv_id, turn", "dt")
LEAK = f"""{TERMS}, dt as (select distinct term from terms), {TURNS}, {_hits},
leak as (select h.conv_id, h.turn - 1 as turn, h.term from hits h join turns t on t.conv_id = h.conv_id and t.turn = h.turn - 1
 where not exists (select 1 from hits b where b.conv_id = h.conv_id and b.turn = h.turn - 1 and b.term = h.term))"""
sql("leaked_terms", f"with {LEAK} select conv_id, turn, term, 'critical' as severity from leak")
sql("guard_verdict", f"""with {LEAK}, {new(numbers, 'nn')}, {new(entities, 'ne')},
i as (select conv_id, turn, 1 as c from nn union all select conv_id, turn, 0 from ne union all select conv_id, turn, 1 from leak),
g as (select conv_id, turn, sum(c) as n_critical, count(*) as n_issues from i group by 1, 2)
select conv_id, turn, coalesce(n_critical, 0) = 0 as passed, coalesce(n_critical, 0)::bigint as n_critical, coalesce(n_issues, 0)::bigint as n_issues from turns left join g using (conv_id, turn)""")
HV = """hb as (select o_custkey as doc_id, o_orderkey as entry_no, o_orderpriority as role, o_orderstatus as company from orders),
ha as (select doc_id, entry_no, case when entry_no % 10 = 0 then 'Senior ' || role else upper(role) end as role, case when entry_no % 15 = 0 then 'X' else company end as company from hb)"""
sql("changed_header", f"""with {HV} select doc_id, entry_no, 'role-changed' as rule, a.role as term from ha a join hb b using (doc_id, entry_no) where {X.soft('a.role')} <> {X.soft('b.role')}
union all select doc_id, entry_no, 'company-changed', a.company from ha a join hb b using (doc_id, entry_no) where {X.soft('a.company')} <> {X.soft('b.company')}""")
for _name, _col, _rule in (("added_certs", "role", "certification-added"), ("added_education", "company", "education-added")):
    sql(_name, f"with {HV} select distinct doc_id, '{_rule}' as rule, {_col} as term from ha where (doc_id, {X.soft(_col)}) not in (select doc_id, {X.soft(_col)} from hb)")
sql("added_skills", f"""with {TURNS}, s as (select distinct conv_id, turn, w as item from (select conv_id, turn, unnest(regexp_split_to_array(lower(after), '[^a-z]+')) as w from turns) where w <> ''),
dt as (select distinct item as term from s), {word_hits('conversations', 'conv_id, turn', 'dt')}
select conv_id, turn, item as term from s where item <> 'the' and not exists (select 1 from hits h where h.conv_id = s.conv_id and h.turn = s.turn and h.term = s.item)""")
_words = lambda c: f"list_filter(string_split({X.collapse(c)}, ' '), lambda w: w <> '')"
WD = f"""{TURNS}, wx as (select conv_id, turn, unnest({_words('before')}) as w, -1 as d from turns union all select conv_id, turn, unnest({_words('after')}), 1 from turns),
wg as (select conv_id, turn, w, sum(d) as d from wx group by 1, 2, 3), ws0 as (select conv_id, turn, sum(greatest(d, 0)) as added, sum(greatest(-d, 0)) as removed from wg group by 1, 2),
wd as (select conv_id, turn, coalesce(added, 0) as added, coalesce(removed, 0) as removed from turns left join ws0 using (conv_id, turn))"""
sql("word_diff_stats", f"with {WD} select conv_id, turn, added::bigint as added, removed::bigint as removed from wd")
sql("diff_totals", f"with {WD} select conv_id, sum(added)::bigint as added, sum(removed)::bigint as removed, count(*) filter (where added > 0 or removed > 0)::bigint as changed from wd group by 1")
sql("field_diff", f"""with {HV} select doc_id, entry_no, 'role' as field, b.role as "from", a.role as "to" from ha a join hb b using (doc_id, entry_no) where a.role <> b.role
union all select doc_id, entry_no, 'company', b.company, a.company from ha a join hb b using (doc_id, entry_no) where a.company <> b.company""")
_nw = X.count_words("text")
TC = f"""{lines_cte('conversations', 'conv_id, turn', 'text', 'cl')},
tf0 as (select conv_id, turn, count(*) as n_bullets, count(*) filter (where {X.starts_with_verb('text', D.VERBS)}) as n_verb, count(*) filter (where {_nw} between 8 and 28) as n_ideal,
 count(*) filter (where {_nw} > 34) as n_long, count(*) filter (where {_nw} between 1 and 4) as n_short, count(*) filter (where {X.rm('text', fv.PASSIVE)}) as n_passive from cl group by 1, 2),
tc as (select conv_id, turn, 'actionVerbs' as component, {VERB} as value from tf0 union all select conv_id, turn, 'readability', {READ} from tf0)"""
sql("score_delta", f"""with {TC} select a.conv_id, a.turn, a.component, a.value::bigint as before, b.value::bigint as after, (b.value - a.value)::bigint as delta, b.value = a.value and b.value < 100 as unmoved
from tc a join tc b on b.conv_id = a.conv_id and b.turn = a.turn + 1 and a.component = b.component""")
_dup0 = X.clamp("(100 - coalesce(n_over, 0) * 4)::double")
sql("version_pair", f"""with {FEATURES}, c as (select doc_id, 'duplicateContent' as component, {DUPSC} as before, {_dup0} as after from feat union all select doc_id, 'readability', {READ}, {READ} from feat)
select doc_id, component, before::bigint as before, after::bigint as after, (after - before)::bigint as delta from c""")
_l = lambda c: f"list_filter(list_transform(string_split({c}, chr(10)), lambda x: {X.collapse('x')}), lambda x: x <> '')"
sql("pair_bullets", f"""with {TURNS}, b as (select conv_id, turn, unnest(l) as t, generate_subscripts(l, 1) - 1 as no from (select conv_id, turn, {_l('before')} as l from turns)),
a as (select conv_id, turn, unnest(l) as t, generate_subscripts(l, 1) - 1 as no from (select conv_id, turn, {_l('after')} as l from turns)),
m as (select conv_id, turn, b.no as f, a.no as o, b.t = a.t as same, case when {X.soft('b.t')} = {X.soft('a.t')} then 1.0::double else {X.similarity('b.t', 'a.t')} end as sim from b join a using (conv_id, turn)),
r as (select *, row_number() over (partition by conv_id, turn, o order by sim desc, f) as ra, row_number() over (partition by conv_id, turn, f order by sim desc, o) as rb from m),
p as (select * from r where ra = 1 and rb = 1 and sim > 0.34)
select conv_id, turn, case when same then 'unchanged' else 'rewritten' end as kind, f::bigint as from_no, o::bigint as to_no, floor(sim * 100 + 0.5) / 100.0::double as sim from p
union all select conv_id, turn, 'added', null, no::bigint, null from a where (conv_id, turn, no) not in (select conv_id, turn, o from p)
union all select conv_id, turn, 'removed', no::bigint, null, null from b where (conv_id, turn, no) not in (select conv_id, turn, f from p)""")
sql("near_dup_bullets", f"""with {lines_cte()}, k as (select doc_id, line_no, text, {X.soft('text')} as k, length(text) as n from lines),
p as (select x.doc_id, x.line_no from k x join k y on x.doc_id = y.doc_id and x.line_no <> y.line_no and (y.n > x.n or (y.n = x.n and y.line_no < x.line_no))
 where (x.k <> '' and x.k = y.k) or (x.n > 0.8 * y.n and {X.similarity('x.text', 'y.text')} > 0.9)) select distinct doc_id, line_no::bigint as bullet_no from p""")
