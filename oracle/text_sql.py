"""SQL twins of the source and scalar queries."""

from __future__ import annotations

from oracle import exprs as X
from oracle.registry import sql
from termloom import fixed_values as fv
from termloom.functions import text as T
from termloom.plans import corpus as D
from termloom.plans.text_jobs import MENTION_TERMS
from termloom.sources import readers as R


def lines_cte(src="documents", key="doc_id", text="text", name="lines") -> str:
    c = X.collapse("raw")
    return f"""{name}_r as (select {key}, unnest(string_split({text}, chr(10))) as raw,
  generate_subscripts(string_split({text}, chr(10)), 1) - 1 as line_no from {src}),
{name} as (select {key}, line_no, {c} as text from {name}_r where {c} <> '')"""


BULLET = f"({X.bullet('text', 'marker')} is not null)"
VOCAB = "vocab as (select distinct w as word from (select unnest(regexp_split_to_array(lower(text), '[^a-z0-9]+')) as w from documents) where w <> '')"

sql("read_docs", "select doc_id, lang, source, n_chars, length(text)::bigint as text_len from documents")
TRIM_LEN = f"length({X.rr('text', f'^{fv.WS}+|{fv.WS}+$', '')})"
sql("triage_postings", f"""select kind, case when n = 0 then 'empty' when n < {fv.MIN_POSTING_CHARS} then 'short'
  when n > {fv.MAX_POSTING_CHARS} then 'too-long' else 'ok' end as code, count(*)::bigint as n
from (select 'document' as kind, {TRIM_LEN} as n from documents union all select 'posting', {TRIM_LEN} from benchmark)
group by all""".replace("count(*)::bigint as n\nfrom", "count(*)::bigint as n\nfrom"))
sql("flag_no_text", f"select doc_id, source from documents where length({X.rr('text', '[^a-zA-Z0-9]', '')}) < {fv.MIN_TEXT_CHARS}")

_h = X.rr("html", "[\x01\x02]", "")
for _p, _t in ((R.HTML_DROP, ""), (R.HTML_CELL, " | "), (R.HTML_OPEN, "\x01\\1\x02"), (R.HTML_CLOSE, "\x01")):
    _h = X.rr(_h, _p, _t)
_t = X.rr("string_split(p, '\x02')[-1]", "<[^>]*>", "")
for _n, _c in R.ENTITIES:
    _t = f"replace({_t}, {X.lit(_n)}, {X.lit(_c)})"
SQL_BLOCKS = (f"""with p as (select page_id, unnest(ps) as p, generate_subscripts(ps, 1) as i
  from (select page_id, string_split({_h}, '\x01') as ps from pages)),
b as (select page_id, i, lower(string_split(p, '\x02')[1]) as tag, {X.collapse(_t)} as text from p where contains(p, '\x02'))
select page_id, (row_number() over (partition by page_id order by i) - 1)::bigint as block_no,
  case when tag like 'h%' then 'heading' when tag = 'li' then 'bullet' when tag = 'tr' then 'table' else 'paragraph' end as kind,
  case when tag like 'h%' then substr(tag, 2, 1)::bigint else 0 end as heading_level, text
from b where text <> ''""")
sql("html_blocks", SQL_BLOCKS)
_kw = X.collapse(X.rr("trim(part)", r"^[-*\x{2022}]\s*", ""))
sql("read_keywords", f"""with p as (select doc_id, unnest(ps) as part, generate_subscripts(ps, 1) - 1 as pos
  from (select doc_id, regexp_split_to_array(text, '[,;|\\n\\r\\t]+') as ps from documents)),
k as (select doc_id, pos, {_kw} as keyword from p)
select doc_id, arg_min(keyword, pos) as keyword, min(pos)::bigint as pos from k
where length(keyword) >= 1 group by doc_id, lower(keyword)""")
sql("normalize_text", f"select doc_id, {X.normalize_text('text')} as norm from documents")
sql("soft_normalize", f"select conv_id, turn, {X.collapse('text')} as collapsed, {X.soft('text')} as soft from conversations")
sql("singularize", f"with {VOCAB} select word, {X.singular('word')} as singular, {X.plural('word')} as plural from vocab")
_lo = "lower(text)"
sql("count_words", f"select doc_id, {X.count_words('text')}::bigint as n_words, {X.occ(_lo, X.lit('the'))}::bigint as n_the from documents")
_terms = "(values " + ", ".join(f"({X.lit(t)})" for t in MENTION_TERMS) + ") t(term)"
_base = f"b as (select doc_id, term, {X.soft('text')} as hay, {X.soft('term')} as needle from documents, {_terms}), v as (select *, {X.singular('needle')} as sg, {X.plural('needle')} as pl from b)"
sql("count_mentions", f"""with {_base}
select doc_id, term, (case when {X.occ('hay', 'needle')} > 0 then {X.occ('hay', 'needle')} else
  (case when sg = needle then 0 else {X.occ('hay', 'sg')} end) + (case when pl = needle then 0 else {X.occ('hay', 'pl')} end) end)::bigint as mentions from v""")
_tok = f"list_filter(string_split(needle, ' '), lambda t: length(t) > 1 and t not in {X.words_in(D.STOPS)})"
sql("text_mentions", f"""with {_base}, w as (select *, string_split(hay, ' ') as ws, {_tok} as toks from v)
select doc_id, term, (contains(hay, needle) or contains(hay, sg) or contains(hay, pl) or
 (len(toks) > 1 and len(list_filter(toks, lambda t: list_contains(ws, t) or list_contains(ws, {X.singular('t')}))) = len(toks))) as mentioned from w""")
sql("similarity", f"""with {lines_cte()}, p as (select doc_id, line_no, text, lag(text) over (partition by doc_id order by line_no) as prev from lines)
select doc_id, line_no::bigint as line_no, round({X.similarity('prev', 'text')}, 6) as sim from p where prev is not null""")
sql("clamp_pct", f"select value, count(*)::bigint as n from (select {X.clamp('(l_extendedprice::double / 400.0::double - 20.25::double)')}::bigint as value from lineitem) group by 1")
sql("bullet_prefix", f"""with {lines_cte()} select doc_id, line_no::bigint as line_no, {X.bullet('text', 'marker')} as marker,
 {X.collapse(X.bullet('text', 'rest'))} as bullet_text, {X.bullet('text', 'numbered')} as numbered from lines where {BULLET}""")
DATED = """dated as (select o_orderkey, o_custkey, dates, 'Analyst | ' || o_orderpriority || ' | ' || dates as line from (
 select *, case o_orderkey % 5 when 0 then strftime(o_orderdate, '%B') || ' ' || year(o_orderdate) || ' - Present'
 when 1 then year(o_orderdate) || ' – ' || (year(o_orderdate) + 2) when 2 then strftime(o_orderdate, '%m') || '/' || year(o_orderdate)
 when 3 then strftime(o_orderdate, '%b') || '. ' || year(o_orderdate) || '-' || strftime(o_orderdate, '%b') || ' ' || (year(o_orderdate) + 1)
 else year(o_orderdate)::varchar end as dates from orders))"""
sql("extract_date", f"""with {DATED}, {lines_cte()}
select o_orderkey, {X.extract_date('line')} as dates, {X.rm('line', fv.PRESENT_MARKER)} as is_current from dated
union all select doc_id, {X.extract_date('text')}, {X.rm('text', fv.PRESENT_MARKER)} from lines where {X.extract_date('text')} <> ''""")
sql("is_current_flag", f"with {DATED} select {X.rm('dates', fv.PRESENT_MARKER)} as is_current, count(*)::bigint as n from dated group by 1")
sql("normalize_dates", """select o_orderkey, case o_orderkey % 5 when 0 then strftime(o_orderdate, '%b %Y') || ' - Present'
 when 1 then year(o_orderdate) || ' - ' || (year(o_orderdate) + 2) when 2 then strftime(o_orderdate, '%b %Y')
 when 3 then strftime(o_orderdate, '%b %Y') || ' - ' || strftime(o_orderdate, '%b ') || (year(o_orderdate) + 1)
 else year(o_orderdate)::varchar end as dates from orders""")
sql("has_metric", f"with {lines_cte()} select doc_id, line_no::bigint as line_no from lines where {X.rm('text', fv.METRIC)}")
sql("starts_with_verb", f"with {lines_cte()} select doc_id, line_no::bigint as line_no from lines where {X.starts_with_verb('text', D.VERBS)}")
sql("passive_flag", "select o_orderkey, o_orderkey % 4 in (0, 1) as passive from orders")
_ws = "regexp_split_to_array(lower(text), '[^a-z0-9_]+')"
_past = f"len(list_filter({_ws}, lambda w: {X.rm('w', '^.+ed$')})) + len(list_distinct(list_filter({_ws}, lambda w: w in {X.words_in(D.PAST_WORDS)})))"
_pres = f"len(list_filter({_ws}, lambda w: {X.rm('w', '^(' + '|'.join(D.PRESENT_STEMS) + ')')}))"
sql("detect_tense", f"""with {lines_cte()}, s as (select doc_id, line_no, {_past} as a, {_pres} as b from lines)
select doc_id, line_no::bigint as line_no, case when a > b then 'past' when b > a then 'present' else 'unknown' end as tense from s""")


def role(x): return X.any_word(x, D.ROLE_WORDS)
def company(x): return X.any_word(x, D.COMPANY_WORDS)


def location(x):
    t = f"trim({x})"
    places = "(?i)(" + "|".join(T.quote(p) for p in D.PLACES) + ")"
    return (f"({t} <> '' and length({t}) <= 48 and ({X.rm(t, places)} or {X.rm(t, '(?i)remote|hybrid|on-?site')} "
            f"or {X.rm(t, '^[^,]{2,28},\\s*[A-Z]{2,3}$')}))")


sql("role_company_location_flags", f"with {lines_cte()} select doc_id, line_no::bigint as line_no, {role('text')} as is_role, {company('text')} as is_company, {location('text')} as is_location from lines")


def category(t):
    syn = X.words_in(D.SYNONYMS)
    part = "(?i)(" + "|".join(T.quote(p) for p in D.DOMAIN) + ")"
    return (f"case when {t} = '' then 'other' when {t} in {X.words_in(D.SOFT)} then 'soft-skill' "
            f"when {t} in {syn} or {X.rr(t, 's$', '')} in {syn} then 'domain-skill' when {X.any_word(t, D.TECH)} then 'technology' "
            f"when {X.any_word(t, D.QUAL)} then 'qualification' when {X.rm(t, part)} then 'domain' "
            f"when {X.any_word(t, D.SOFT_WORDS)} then 'soft-skill' else 'other' end")


sql("categorize_term", f"with {VOCAB} select word as term, {category('word')} as category from vocab")
_n = {k: X.occ("text", X.lit(c)) for k, c in (("dot", "$"), ("square", "%"), ("disc", "#"))}
sql("bullet_style", f"""select doc_id, case when dot + disc + square > 0 and disc > square and disc >= dot then 'disc'
 when dot + disc + square > 0 and square > dot then 'square' when dot + disc + square > 0 then 'dot' when dash > 12 then 'dash' else 'dot' end as style
from (select doc_id, {_n['dot']} + {X.occ('text', X.lit('•'))} as dot, {_n['disc']} + {X.occ('text', X.lit('●'))} as disc,
 {_n['square']} + {X.occ('text', X.lit('▪'))} as square, {X.occ('text', X.lit('–'))} as dash from documents)""")
_up = "list_transform(regexp_extract_all(lower(text), '([a-z0-9_]+|[^a-z0-9_]+)', 1), lambda t: case when regexp_matches(t, '^[a-z]') then upper(t[1]) || substr(t, 2) else t end)"
_cap = "upper(text[1]) || substr(text, 2)"
sql("name_case", f"""with {lines_cte()} select doc_id, line_no::bigint as line_no, array_to_string({_up}, '') as title,
 case when {X.rm('text', '^[A-Z]{2,}')} then text else lower(text[1]) || substr(text, 2) end as sentence,
 case when {X.rm('text', '[.!?:;]$')} then {_cap} else {_cap} || '.' end as closed from lines""")
# contacts
_seg = X.rr("s", r"^[|\x{2022}\x{2013}\x{2014}\s-]+|[|\x{2022}\x{2013}\x{2014}\s-]+$", "")
_split = r"\s*[|\x{2022}\x{00B7}]\s*|\s{3,}"
_em = f"nullif({X.rr(f'nullif({X.rx(chr(115)+chr(101)+chr(103), fv.EMAIL, 0)}, {X.lit(str())})', '[.,;]+$', '')}, '')"
_ph = f"trim(nullif({X.rx('seg', fv.PHONE, 0)}, ''))"
_head = f"lower(trim({X.rr('text', '[:._|*#-]+', ' ')}))"
_isname = (f"seg_no = 0 and not {BULLET} and not {X.rm('text', fv.EMAIL)} and not {X.rm('text', fv.LINKEDIN)} and not {X.rm('text', fv.PORTFOLIO)} "
           f"and not ({X.rm('text', fv.PHONE)} and length({X.rr('text', '[^0-9]', '')}) >= 8) and {_head} not in {X.words_in(D.WEAK_HEADINGS)} "
           f"and len(string_split(text, ' ')) <= 6 and not {X.rm('text', '(?i)resume|curriculum vitae|(^|[^a-z0-9_])cv([^a-z0-9_]|$)')} "
           f"and length({X.rr('text', '[^A-Za-z]', '')}) >= 3")
sql("extract_contacts", f"""with {lines_cte()},
sg as (select doc_id, line_no, text, unnest(ss) as seg, generate_subscripts(ss, 1) - 1 as seg_no from (
  select *, list_concat([text], list_transform(list_filter(list_transform(regexp_split_to_array(text, {X.lit(_split)}), lambda s: trim(s)), lambda s: s <> ''), lambda s: {_seg})) as ss from lines)),
f as (select doc_id, line_no * 100000 + seg_no as o, case when {_isname} then text end as name, {_em} as email,
  case when length({X.rr(_ph, '[^0-9]', '')}) between 8 and 15 then {_ph} end as phone,
  {X.rr(f"nullif({X.rx('seg', fv.LINKEDIN, 0)}, '')", '[.,;)]+$', '')} as linkedin,
  case when {_em} is null and not contains(lower({X.rx('seg', fv.PORTFOLIO, 0)}), 'linkedin') then {X.rr(f"nullif({X.rx('seg', fv.PORTFOLIO, 0)}, '')", '[.,;)]+$', '')} end as portfolio,
  case when length(seg) <= 40 and {location('seg')} then seg end as location from sg)
select doc_id, {', '.join(f"coalesce(arg_min({c}, o) filter (where {c} is not null), '') as {c}" for c in ('name', 'email', 'phone', 'linkedin', 'portfolio', 'location'))}
from f group by doc_id""")
_ext = "['.pdf', '.docx', '.PDF', '.txt', ''][page_id % 5 + 1]"
_head = f"[{X.lit(fv.PDF_MAGIC_HEX)}, {X.lit(fv.ZIP_MAGIC_HEX)}, {X.lit(fv.OLE_MAGIC_HEX)}, '3C21'][page_id % 4 + 1]"
sql("triage_files", f"""with f as (select 'in/' || page_id || {_ext} as path, lower(replace({_ext}, '.', '')) as ext, {_head} as head,
 case when page_id % 11 = 0 then 0 when page_id % 13 = 0 then length({_head}) // 2 else length({_head}) // 2 + octet_length(encode(html)) end as n from pages),
g as (select * from f)
select path, ext, n::bigint as length, case when ext not in ('pdf', 'docx') then 'unsupported-format' when n = 0 then 'empty-file'
 when n < {fv.MIN_FILE_BYTES} then 'file-too-small' when n > {fv.MAX_FILE_BYTES} then 'file-too-large'
 when ext = 'pdf' and head = {X.lit(fv.PDF_MAGIC_HEX)} then 'ok' when ext = 'pdf' and head = {X.lit(fv.ZIP_MAGIC_HEX)} then 'wrong-format' when ext = 'pdf' then 'corrupt-pdf'
 when head = {X.lit(fv.PDF_MAGIC_HEX)} then 'wrong-format' when head = {X.lit(fv.OLE_MAGIC_HEX)} then 'legacy-doc' when head = {X.lit(fv.ZIP_MAGIC_HEX)} then 'ok' else 'corrupt-docx' end as code from g""")
