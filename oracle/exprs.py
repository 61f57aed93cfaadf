"""The scalar functions again, as DuckDB expressions (strings)."""

from __future__ import annotations

from termloom import fixed_values as fv
from termloom.functions.text import PIECE_SPLIT, WORD_EDGE, quote


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def words_in(words) -> str:
    return "(" + ", ".join(lit(w) for w in words) + ")"


def rr(x: str, pattern: str, to: str, opts: str = "g") -> str:
    return f"regexp_replace({x}, {lit(pattern)}, {lit(to)}, {lit(opts)})"


def rm(x: str, pattern: str) -> str:
    return f"regexp_matches({x}, {lit(pattern)})"


def rx(x: str, pattern: str, g: int = 1) -> str:
    return f"regexp_extract({x}, {lit(pattern)}, {g})"


def normalize_text(x: str) -> str:
    x = rr(x, r"\r\n?", "\n")
    x = f"translate({x}, ' ‘’‛“”–—', ' ''''''\"\"--')"
    x = f"replace({x}, '…', '...')"
    x = rr(x, fv.WS_NOT_NEWLINE + "+", " ")
    x = rr(x, " \n", "\n")
    x = rr(x, "\n{3,}", "\n\n")
    return rr(x, r"\A[ \n]+|[ \n]+\z", "")


def collapse(x: str) -> str:
    return f"trim({rr(x, fv.WS + '+', ' ')})"


def soft(x: str) -> str:
    return collapse(rr(f"lower({x})", "[’']s([^a-z0-9_]|$)", r"\1"))


def singular(x: str) -> str:
    w = f"lower({x})"
    cut = lambda n: f"left({w}, length({w}) - {n})"
    return (
        f"case when {w} like '%ies' and length({w}) > 4 then {cut(3)} || 'y' "
        f"when {rm(w, '(ses|xes|zes|ches|shes)$')} then {cut(2)} "
        f"when {w} like '%s' and {w} not like '%ss' then {cut(1)} else {w} end"
    )


def plural(x: str) -> str:
    return (
        f"case when {x} = '' then {x} when {rm(x, '(?i)(s|x|z|ch|sh)$')} then {x} || 'es' "
        f"when {rm(x, '(?i)[^aeiou]y$')} then left({x}, length({x}) - 1) || 'ies' else {x} || 's' end"
    )


def count_words(x: str) -> str:
    s = collapse(x)
    return f"(case when {s} = '' then 0 else len(string_split({s}, ' ')) end)"


def occ(h: str, n: str) -> str:
    return f"(case when length({n}) > 0 then (length({h}) - length(replace({h}, {n}, ''))) // length({n}) else 0 end)"


ACCENTS = "éèêëáàâäãåíìîïóòôöõúùûüñçßæœÿ"
SINGLE = "".join(chr(c) for c in (*range(1, 9), *range(14, 32), 127, 94, 95, 96, 126))[: len(ACCENTS)]


def one_byte(x: str) -> str:
    """levenshtein counts bytes there; give each accented letter a byte of its own."""
    return f"translate({x}, {lit(ACCENTS)}, {lit(SINGLE)})"


def similarity(a: str, b: str) -> str:
    x, y = one_byte(f"trim(lower({a}))"), one_byte(f"trim(lower({b}))")
    return (
        f"(case when {x} = '' or {y} = '' then 0.0 when {x} = {y} then 1.0 "
        f"else 1.0::double - levenshtein({x}, {y})::double / greatest(length({x}), length({y})) end)"
    )


def clamp(x: str) -> str:
    return f"least(100, greatest(0, floor({x} + 0.5)))"


def pct(n: str, d: str) -> str:
    return f"(case when {d} > 0 then {clamp(f'{n} * 100.0::double / {d}')} else 0 end)"


def bullet(x: str, part: str) -> str:
    g = {"marker": 1, "rest": 2}
    if part == "numbered":
        return f"(not {rm(x, fv.GLYPH_BULLET)} and not {rm(x, fv.DASH_BULLET)} and {rm(x, fv.NUMBERED_BULLET)})"
    return (
        "(case " + " ".join(f"when {rm(x, p)} then {rx(x, p, g[part])}"
                             for p in (fv.GLYPH_BULLET, fv.DASH_BULLET, fv.NUMBERED_BULLET)) + " end)"
    )


def extract_date(x: str) -> str:
    hits = ", ".join(f"nullif({rx(x, p)}, '')" for p in (fv.DATE_RANGE_MONTHS, fv.DATE_RANGE_YEARS, fv.DATE_SINGLE))
    return collapse(f"coalesce({hits}, '')")


def first_word(x: str) -> str:
    return rr(f"regexp_split_to_array({x}, '\\s+')[1]", "[^A-Za-z-]", "")


def starts_with_verb(x: str, verbs) -> str:
    w = first_word(x)
    return (
        f"({w} <> '' and (lower({w}) in {words_in(verbs)} or {rm(w, '(?i)^[a-z]+ed$')} "
        f"or ({rm(w, '(?i)^[a-z]+s$')} and length({w}) > 5)))"
    )


def any_word(x: str, phrases) -> str:
    alt = "|".join(quote(p) for p in phrases)
    return rm(x, f"(?i){fv.EDGE_L}({alt}){fv.EDGE_R}")


def grams_cte(source: str, key: str, text: str, max_n: int = 3, name: str = "grams") -> str:
    """CTEs ending in ``name``(key, gram, n): word grams built with window functions."""
    s = soft(text)
    p, lead = name, []
    for k in range(1, max_n):
        lead.append(f"lead(w, {k}) over (partition by {key}, piece order by pos) as w{k}")
    unions = [f"select {key}, w as gram, 1 as n from {p}_l"]
    for n in range(2, max_n + 1):
        cat = " || ' ' || ".join(["w"] + [f"w{k}" for k in range(1, n)])
        unions.append(f"select {key}, {cat} as gram, {n} as n from {p}_l where w{n - 1} is not null")
    lead_sql = (", " + ", ".join(lead)) if lead else ""
    return f"""
{p}_p as (select {key}, unnest(pieces) as p, generate_subscripts(pieces, 1) as piece
  from (select {key}, regexp_split_to_array({s}, {lit(PIECE_SPLIT)}) as pieces from {source})),
{p}_w0 as (select {key}, piece, unnest(ws) as w, generate_subscripts(ws, 1) as pos
  from (select {key}, piece, string_split(p, ' ') as ws from {p}_p)),
{p}_w as (select {key}, piece, pos, {rr('w', WORD_EDGE, '')} as w from {p}_w0),
{p}_l as (select {key}, w{lead_sql} from {p}_w where w <> ''),
{name} as ({' union all '.join(unions)})"""
