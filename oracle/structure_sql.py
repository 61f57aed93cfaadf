"""SQL twins of the structuring queries."""

from __future__ import annotations

from oracle import exprs as X
from oracle.registry import sql
from oracle.text_sql import BULLET, DATED, SQL_BLOCKS, lines_cte
from termloom import dims
from termloom import fixed_values as fv
from termloom.operators import entries as E
from termloom.plans import corpus as D


def heading_key(x: str) -> str:
    return f"lower({X.collapse(X.rr(x, r'[:._|*#\x{2022}\x{2013}\x{2014}-]+', ' '))})"


IDS = "[" + ", ".join(X.lit(s) for s in fv.SECTION_ORDER) + "]"
LINES = f"{lines_cte()}, al as (select *, {heading_key('text')} as hk, {BULLET} as is_bullet from lines)"
ALIASES = f"""{LINES}, aliases as (select hk as alias, ({IDS})[length(hk) % {len(fv.SECTION_ORDER)} + 1] as section_id, -length(hk) as alias_order
 from al where length(text) <= 64 and len(string_split(text, ' ')) <= 3 and not is_bullet and hk <> ''
 group by hk having count(distinct doc_id) >= 2)"""
FLAGGED = f"""{ALIASES}, hl as (select al.*, (length(text) <= 64 and len(string_split(text, ' ')) <= 6 and not is_bullet and a.alias is not null) as is_heading,
 a.section_id as head_sid from al left join aliases a on a.alias = al.hk)"""
_weak = f"hk in {X.words_in(D.WEAK_HEADINGS)}"
SEGMENTED = f"""{FLAGGED}, s0 as (select *, case when is_heading then head_sid end as head_id from hl),
s1 as (select *, sum(case when head_id is null then 1 else 0 end) over (partition by doc_id order by line_no rows unbounded preceding) as body from s0),
s2 as (select *, last_value(case when head_id is not null then body end ignore nulls) over (partition by doc_id order by line_no rows between unbounded preceding and 1 preceding) as prev_body from s1),
s3 as (select *, head_id is not null and {_weak} and coalesce(body > prev_body, false) as weak from s2),
s4 as (select *, last_value(case when head_id is not null and not weak then head_id end ignore nulls) over (partition by doc_id order by line_no rows between unbounded preceding and 1 preceding) as prev_id from s3),
s5 as (select *, head_id is not null and not weak and head_id is distinct from prev_id as turn from s4),
s6 as (select *, last_value(case when turn then body end ignore nulls) over (partition by doc_id order by line_no rows unbounded preceding) as turn_body from s5),
s7 as (select *, coalesce(head_id is not null and not weak and (turn or body = turn_body), false) as st from s6),
s8 as (select *, sum(st::int) over (partition by doc_id order by line_no rows unbounded preceding) as section_no,
 last_value(case when st then head_id end ignore nulls) over (partition by doc_id order by line_no rows unbounded preceding) as sid from s7),
s9 as (select *, max(section_no) over (partition by doc_id) = 0 as none from s8),
seg as (select doc_id, line_no, text, section_no, st, case when none then 'other' else sid end as section_id, head_id is null or none as in_body from s9)"""
SECTIONS = f"""{SEGMENTED}, secs as (select doc_id, section_no, section_id, coalesce(max(case when st then {X.rr('text', '[:\\s]+$', '')} end), '') as title,
 min(line_no) as first_line, count(*) filter (where in_body) as line_count from seg where section_id is not null group by all)"""

sql("to_lines", f"with {lines_cte()} select doc_id, line_no::bigint as line_no, text, {BULLET} as is_bullet, {X.bullet('text', 'numbered')} as numbered from lines")
sql("heading_flag", f"with {FLAGGED} select doc_id, line_no::bigint as line_no, hk as heading_key from hl where is_heading")
_strip = X.collapse(X.rr("hk", r"(^|[^a-z0-9_])(19|20)\d{2}($|[^a-z0-9_])", r"\1\3"))
sql("section_lookup", f"""with {ALIASES}, k as (select distinct hk, {_strip} as st from al where length(text) <= 64 and hk <> ''),
c as (select k.hk, section_id, case when a.alias = k.hk then 0 when a.alias = k.st then 1 else 2 end as kind, alias_order
 from k join aliases a on a.alias = k.hk or a.alias = k.st or (length(a.alias) >= 4 and starts_with(k.st, a.alias))),
b as (select hk, arg_min(section_id, kind * 1000 + alias_order) as section_id from c group by hk)
select k.hk as heading_key, section_id from k left join b using (hk)""")
sql("segment_sections", f"with {SEGMENTED} select doc_id, line_no::bigint as line_no, section_no::bigint as section_no, section_id, in_body from seg")
sql("section_table", f"with {SECTIONS} select doc_id, section_no::bigint as section_no, section_id, title, first_line::bigint as first_line, line_count::bigint as line_count from secs")
PAGE_LINES = f"pl as (select page_id as doc_id, block_no as line_no, kind, text, heading_level, kind = 'bullet' as is_bullet from ({SQL_BLOCKS}))"
sql("join_wrapped_bullets", f"""with {PAGE_LINES}, n as (select *, sum(is_bullet::int) over (partition by doc_id order by line_no rows unbounded preceding) as bullet_no from pl)
select doc_id, bullet_no::bigint as bullet_no, string_agg(text, ' ' order by line_no) as text, count(*)::bigint as n_lines from n where bullet_no > 0 group by 1, 2""")


def split_list(x: str) -> str:
    return (f"list_filter(list_transform(regexp_split_to_array({x}, {X.lit(E.LIST_SPLIT)}), lambda s: trim({X.rr('s', r'^[-*\x{2022}\x{2013}\x{2014}]\s*', '')})), "
            "lambda s: length(s) >= 1)")


_bt = f"case when {BULLET} then {X.collapse(X.bullet('text', 'rest'))} else text end"
_lab, _rest = f"trim({X.rx('t', E.SKILL_LABEL, 1)})", f"trim({X.rx('t', E.SKILL_LABEL, 2)})"
sql("split_skills", f"""with {lines_cte()}, t as (select doc_id, line_no, {_bt} as t from lines),
l as (select *, {X.rm('t', E.SKILL_LABEL)} and len(string_split({_lab}, ' ')) <= 4 and {_rest} <> '' and {_lab} <> '' as ok from t),
i as (select doc_id, line_no, case when ok then {_lab} else '' end as label, {split_list(f"case when ok then {_rest} else t end")} as items from l)
select doc_id, line_no::bigint as group_no, label, (generate_subscripts(items, 1) - 1)::bigint as item_no, unnest(items) as item from i""")
sql("split_certs", """with o as (select o_custkey as doc_id, o_orderkey, 'Course ' || o_orderkey as name,
 case when o_orderkey % 2 = 0 then case o_orderkey % 5 when 0 then 'sent' when 1 then (year(o_orderdate) + 2)::varchar
 when 3 then (year(o_orderdate) + 1)::varchar else year(o_orderdate)::varchar end end as extra from orders),
i as (select doc_id, o_orderkey, 0 as pos, name, case when regexp_matches(extra, '^(19|20)[0-9]{2}$') then extra end as year from o
 union all select doc_id, o_orderkey, 1, extra, '' from o where extra = 'sent')
select doc_id, row_number() over (partition by doc_id order by o_orderkey, pos)::bigint as item_no, name,
 coalesce(year, case when regexp_matches(name, '^Course (19|20)[0-9]{2}$') then right(name, 4) end, '') as year from
 (select doc_id, o_orderkey, pos, name, case when regexp_matches(name, '^Course (19|20)[0-9]{2}$') then right(name, 4) else year end as year from i)""")
sql("split_languages", """select o_orderkey as doc_id, 0::bigint as item_no, 'Lang' || o_custkey as name, o_orderpriority as level from orders
union all select o_orderkey, 1, 'plain', '' from orders""")
sql("parse_education", f"""with {DATED} select o_orderkey as doc_id, 'BSc Trade' as degree, 'University ' || o_custkey || case when o_orderkey % 5 = 2 then '' else '' end as institution,
 {X.extract_date("'BSc Trade | University ' || o_custkey || ' | ' || dates")} as dates from dated""")
sql("parse_projects", f"""with {PAGE_LINES}, o as (select *, lag(line_no) over w is null or (not is_bullet and lag(is_bullet) over w) as op from pl window w as (partition by doc_id order by line_no)),
n as (select *, sum(op::int) over (partition by doc_id order by line_no rows unbounded preceding) as project_no from o),
h as (select doc_id, project_no, line_no, case when {X.extract_date('text')} <> '' then {X.collapse(f"replace(text, {X.extract_date('text')}, ' ')")} else text end as b from n where not is_bullet),
s as (select doc_id, project_no, line_no, unnest(ss) as s, generate_subscripts(ss, 1) as i from (select *, list_filter(list_transform(regexp_split_to_array(b, '\\s*[|\\x{{2022}}\\x{{00B7}}]\\s*|\\s{{3,}}'), lambda p: trim(p)), lambda p: p <> '') as ss from h)),
f as (select doc_id, project_no, arg_min(s, line_no * 100000 + i) as name from s group by 1, 2)
select doc_id, project_no::bigint as project_no, coalesce(name, '') as name from (select distinct doc_id, project_no from n) left join f using (doc_id, project_no)""")
sql("dedupe_parsed", f"with {lines_cte()} select doc_id, min(line_no)::bigint as line_no, arg_min(text, line_no) as text from lines group by doc_id, lower(text)")
_names = "[" + ", ".join(X.lit(s) for s in fv.SECTION_ORDER if s != "contact") + "]"
sql("section_diagnostics", f"""with {SECTIONS}, f as (select doc_id, list(distinct section_id) as found from secs group by 1),
m as (select d.doc_id, list_filter({_names}, lambda n: not list_contains(coalesce(found, []::varchar[]), n)) as m from documents d left join f using (doc_id))
select doc_id, array_to_string(m, ',') as missing, len(m)::bigint as n_missing from m""")
sql("present_sections", f"""with {SECTIONS}, f as (select doc_id, section_id, min(section_no) as fs from secs where section_id <> 'contact' and line_count > 0 group by 1, 2)
select doc_id, section_id, row_number() over (partition by doc_id order by fs)::bigint as position from f""")
sql("empty_docs", f"with {SEGMENTED} select doc_id, source from documents where doc_id not in (select doc_id from seg where section_id in ('summary', 'experience', 'education', 'skills'))")
sql("flatten_doc", f"""with {lines_cte()}, k as (select doc_id, min(line_no) as line_no, trim(arg_min(text, line_no)) as text from lines group by doc_id, lower(text))
select doc_id, string_agg(text, chr(10) order by line_no) as text from k group by doc_id""")
sql("layout_profile", f"""with {PAGE_LINES}, b as (select doc_id, line_no, kind, case when kind = 'heading' then 24.0 - heading_level else 10.0 + length(text) % 3 end::double as s,
 case when length(text) % 2 = 0 then 'left' else 'center' end as align from pl),
z as (select doc_id, list(s order by s) as ss, list(s order by line_no) as so, count(*) filter (where kind = 'table') as n_tables from b group by 1),
y as (select *, ss[len(ss) // 2 + 1] as base from z),
x as (select *, list_sort(list_filter(ss, lambda v: v > base * 1.12)) as hs, list_filter(so, lambda v: v > base * 1.45)[1:3] as ns from y),
a as (select doc_id, arg_max(align, n * 1000000 - p) as align from (select doc_id, align, count(*) as n, min(line_no) as p from b group by 1, 2) group by 1)
select doc_id, base as base_size, coalesce(hs[len(hs) // 2 + 1], base * 1.14::double) as heading_size, coalesce(list_max(ns), base * 2.1::double) as name_size,
 align, n_tables::bigint as n_tables, 1::bigint as columns from x join a using (doc_id)""")
