"""The same queries in DuckDB's SQL, written apart from the Column functions: relational, one row for a line."""

from __future__ import annotations

from veriframe.functions import vocab as V
from veriframe.plans import corpus as K
from veriframe.plans.corpus import STUB_ANSWER


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def ws(x: str) -> str:
    return f"trim(regexp_replace(coalesce({x}, ''), '[\\s\\x{{A0}}]+', ' ', 'g'))"


def strip(x: str) -> str:
    return f"trim({x}, ' ' || chr(9) || chr(10) || chr(13) || chr(160))"


def sub(x: str, pattern: str, new: str) -> str:
    return f"regexp_replace({x}, {q(pattern)}, {q(new)}, 'g')"


def warning_fold(x: str) -> str:
    t = f"lower({ws(x)})"
    for p, n in ((r"\s+:", ":"), (r"\(\s*1\s*\)", "(1)"), (r"\(\s*2\s*\)", "(2)"), (r"\s+([,.])", r"\1"), (r"\.+$", "")):
        t = sub(t, p, n)
    return t


def brand_fold(x: str) -> str:
    return ws(sub(f"upper({ws(x)})", "[^A-Z0-9' ]+", ""))


def letters(x: str) -> str:
    return sub(f"translate({brand_fold(x)}, '015738', 'OISTEB')", "[^A-Z]", "")


def tokens(x: str) -> str:
    return f"list_distinct(regexp_extract_all(lower({ws(x)}), {q("[a-z0-9']+")}))"


def jaccard(a: str, b: str) -> str:
    n = f"len(list_intersect({tokens(a)}, {tokens(b)}))"
    return f"case when len({tokens(a)}) = 0 or len({tokens(b)}) = 0 then 0.0 else {n}::double / (len({tokens(a)}) + len({tokens(b)}) - {n}) end"


def same_set(a: str, b: str) -> str:
    return f"(len({tokens(a)}) > 0 and list_sort({tokens(a)}) = list_sort({tokens(b)}))"


def number(x: str, p: str) -> str:
    return f"try_cast(nullif(regexp_extract({x}, {q(p)}, 1), '') as double)"


def abv(x: str) -> str:
    return f"coalesce({number(x, V.ABV_PERCENT_ALC)}, {number(x, V.ABV_PROOF)} / 2.0, {number(x, V.ABV_PERCENT)})"


def ml(x: str) -> str:
    return number(x, V.MILLILITRES)


def like(x: str, p: str) -> str:
    return f"regexp_matches({x}, {q(p)})"


def batch_lot(x: str) -> str:
    t = f"lower({strip(x)})"
    return f"({like(t, V.BATCH_LOT)} or ({like(t, V.BATCH)} and {like(t, V.LOT)}))"


def noise(x: str) -> str:
    return f"({batch_lot(x)} or {like(f'lower({ws(x)})', V.any_of(V.NOISE))})"


def discard(x: str) -> str:
    return f"({strip(x)} = '' or {batch_lot(x)} or {like(f'lower({strip(x)})', V.any_of(V.NOISE))})"


def noun(x: str) -> str:
    return like(f"lower({x})", V.any_of(V.CLASS_NOUNS))


def body(x: str) -> str:
    return f"(contains(lower({x}), 'government warning') or {abv(x)} is not null or {ml(x)} is not null or {noun(x)})"


def fragment(x: str) -> str:
    known = ", ".join(q(w) for w in dict.fromkeys([*V.GEO_WORDS, *(w for p in V.CLASS_PREFIXES for w in p.split())]))
    words = f"string_split(lower({ws(x)}), ' ')"
    return f"(not {noun(x)} and {ws(x)} <> '' and len(list_intersect(list_distinct({words}), [{known}])) = len(list_distinct({words})))"


def warn(x: str) -> str:
    t = f"lower({ws(x)})"
    return f"(contains({t}, 'government warning') or {like(t, r'^\(\s*2\s*\)')} or {like(t, V.any_of(V.WARNING_FRAGMENTS))})"


def distillery(x: str) -> str:
    return like(f"lower({x})", V.any_of(V.DISTILLERY))


def class_prefix(x: str) -> str:
    t = f"lower({ws(x)})"
    return f"({t} = '' or (not {distillery(t)} and ({t} = 'small batch' or {fragment(x)})))"


def count(x: str, keep: str) -> str:
    return f"length({sub(x, f'[^{keep}]', '')})"


def garbled(x: str) -> str:
    t = brand_fold(x)
    return (
        f"({t} = '' or {count(t, '0-9')} >= 2 or ({count(t, '0-9')} = 1 and length({t}) < 14) or {like(ws(x), "[^A-Za-z0-9' .-]")}"
        f" or ({count(t, 'A-Z')} >= 8 and {count(t, 'AEIOU')}::double / greatest({count(t, 'A-Z')}, 1) < 0.15))"
    )


def unannotated(x: str) -> str:
    return strip(f"regexp_replace({strip(x)}, {q(V.ANNOTATION)}, '')")


def lines_of(x: str) -> str:
    """The lines of a text, stripped, without the empty ones."""
    return f"list_filter(list_transform(string_split({x}, chr(10)), lambda y: {strip('y')}), lambda y: y <> '')"


def repaired(name: str, source: str, column: str) -> str:
    """A table of source's columns with its column repaired, in steps."""
    t = column
    for old, new in V.REPAIRED_WORDS:
        t = f"replace({t}, {q(old)}, {q(new)})"
    for pattern, new in V.REPAIRED_PATTERNS:
        t = sub(t, pattern, new)
    for pattern, new, most in V.REPAIRED_AT_MOST:
        for _ in range(most):
            t = f"regexp_replace({t}, {q(pattern)}, {q(new)})"
    fixed = "body"
    for pattern, new in V.REPAIRED_WARNING:
        fixed = sub(fixed, pattern, new)
    return (
        f"{name}_1 as (select *, {t} as t from {source}), "
        f"{name}_2 as (select *, {ws(f'regexp_extract(t, {q(f"(?is)({V.HEADER_COLON}.*)")}, 1)')} as body, {lines_of(f'regexp_replace(t, {q(f"(?is){V.HEADER_COLON}.*")}, {q("")})')} as head from {name}_1), "
        f"{name}_3 as (select *, {fixed} as fixed from {name}_2), "
        f"{name} as (select * replace (case when body = '' then {strip('t')} else array_to_string(list_append(head, case when fixed like '%.' then fixed else regexp_replace(fixed, '_+$', '') || '.' end), chr(10)) end as {column}) "
        f"from {name}_3)"
    )


def merged_warning(full: str, warning: str) -> str:
    body = strip(f"regexp_extract({warning}, {q(f'(?is)({V.HEADER_COLON}.*)')}, 1)")
    head = lines_of(f"regexp_replace({full}, {q(f'(?is){V.HEADER_COLON}.*')}, '')")
    return f"case when {body} = '' then {full} else array_to_string(list_append({head}, {body}), chr(10)) end"


def warning_block(gap: float) -> str:
    """Tables that end in blocks (record_id, warning): line after line from the first header on."""
    ends = like(f"lower({ws('joined')})", V.any_of(V.WARNING_END))
    skip = f"({like('lower(o.text)', V.any_of(V.NOISE))} and not contains(lower(o.text), 'warning'))"
    return f""", placed as materialized (select *, row_number() over (partition by record_id order by y_center, x_min, line_id) as rn from lines),
begins as (select record_id, min(rn) as rn from placed where {like('text', '(?i)' + V.HEADER)} group by 1),
walk as (
  select p.record_id, p.rn, {strip('p.text')} as t, p.y_max as low, false as done from placed p join begins using (record_id, rn)
  union all
  select record_id, rn, case when far or skip then t else joined end, case when far or skip then low else y_max end, far or (not skip and {ends})
  from (select w.record_id, o.rn, w.t, w.low, o.y_max, greatest(o.y_min - w.low, 0.0) > {gap} as far, {skip} as skip, w.t || ' ' || {strip('o.text')} as joined
        from walk w join placed o on o.record_id = w.record_id and o.rn = w.rn + 1 where not w.done)),
blocks as (select c.record_id, coalesce(any_value({trim_warning('w.t')}), '') as warning from claims c left join (select record_id, arg_max(t, rn) as t from walk group by 1) w using (record_id) group by 1)"""


def trim_warning(x: str) -> str:
    return f"coalesce(nullif({ws(f'regexp_extract({ws(x)}, {q(V.WARNING_BLOCK)}, 1)')}, ''), {ws(x)})"


def missing(x: str) -> str:
    t, parts = warning_fold(x), []
    for p in (*V.WARNING_MARKERS, *V.WARNING_PHRASES):
        has = " or ".join(f"contains({t}, {q(w)})" for w in (p, *V.WARNING_ALIASES.get(p, ())))
        parts.append(f"case when not ({has}) then {q(p)} end")
    return f"list_filter([{', '.join(parts)}], lambda z: z is not null)"


def readability(x: str) -> str:
    t = f"lower({ws(x)})"
    parts = [f"case when contains({t}, {q(p)}) then {w}::double else 0.0::double end" for p, w in V.READABILITY]
    parts.append(f"case when {like(t, r'\d+\s*%\s*alc')} then 0.1::double when {like(t, r'\d+\s*%')} then 0.05::double else 0.0::double end")
    parts.append(f"case when {like(t, r'\d+\s*ml')} then 0.08::double else 0.0::double end")
    parts.append(f"0.12::double * (length({sub(t, r'[^\pL]', '')})::double / greatest(length({t}), 1))")
    return f"case when {t} = '' then 0.0 else least({' + '.join(parts)}, 1.0) end"


def status(s: str) -> str:
    return f"case {s} when 2 then 'FAIL' when 1 then 'REVIEW' else 'PASS' end"


def rule(steps: list[tuple[str, int, str]], other: tuple[int, str]) -> tuple[str, str]:
    """(severity, reason) as two CASE expressions."""
    pick = lambda i: "case " + " ".join(f"when {s[0]} then {s[i] if i == 1 else q(s[2])}" for s in steps) + f" else {other[0] if i == 1 else q(other[1])} end"
    return pick(1), pick(2)


def text_rule(c: str, r: str) -> tuple[str, str]:
    clear = lambda x: f"({ml(x)} is not null or not {garbled(x)})"
    return rule([(f"{ws(r)} = ''", 1, "not_read"), (f"lower({ws(c)}) = lower({ws(r)})", 0, "equal"), (same_set(c, r), 0, "same_words"), (f"({clear(c)} and {clear(r)})", 2, "different"), (f"({jaccard(c, r)}) >= {V.CLASS_REVIEW}", 1, "near")], (2, "different_garbled"))


def number_rule(c: str, r: str, value, tolerance: float) -> tuple[str, str]:
    a, b = value(c), value(r)
    return rule([(f"({a} is null or {b} is null)", 1, "not_read"), (f"abs({a} - {b}) < {tolerance}", 0, "equal")], (2, "different"))


def warning_rule(c: str, r: str) -> tuple[str, str]:
    m = missing(r)
    return rule([
        (f"{ws(r)} = ''", 1, "not_read"), (f"not {like(ws(r), '^' + V.HEADER_COLON)}", 2, "header"), (f"{ws(c)} = {ws(r)}", 0, "equal"), (f"{warning_fold(c)} = {warning_fold(r)}", 0, "equal_folded"),
        (f"(list_contains({m}, '(2)') or list_contains({m}, 'may cause health problems'))", 2, "missing_end"), (f"len({m}) > 0", 2, "missing_part"), (f"({jaccard(c, r)}) >= {V.WARNING_REVIEW}", 1, "near"),
    ], (2, "different"))


def brand_rule(c: str, r: str) -> tuple[str, str]:
    return rule([(f"{brand_fold(r)} = ''", 1, "not_read"), (f"{brand_fold(c)} = {brand_fold(r)}", 0, "equal"), (same_set(c, r), 0, "same_words"), (f"{letters(c)} = {letters(r)}", 0, "same_letters"), (f"not {garbled(r)}", 2, "different")], (1, "garbled"))


def ratios(name: str, pairs: str) -> str:
    """A table (a, b, ratio) of distinct pairs of texts: pieces left and right of the longest common run, again and again."""
    longest = "len(list_filter(range(1, len(x) - i::int + 2), lambda n: contains(y, substr(x, i::int, n::int))))"
    return f"""{name}_pairs as materialized (select distinct a, b from ({pairs})),
{name}_work as (
  select a, b, a as x, b as y from {name}_pairs where a <> '' and b <> ''
  union all
  select a, b, p.x, p.y from (
    select a, b, unnest([{{'x': substr(x, 1, k - 1), 'y': substr(y, 1, j - 1)}}, {{'x': substr(x, k + n), 'y': substr(y, j + n)}}]) as p
    from (select *, strpos(y, substr(x, k, n))::int as j from (select *, n * 100000 - best as k from (select *, ((best + 99999) // 100000)::int as n
      from (select *, list_max(list_transform(range(1, len(x) + 1), lambda i: {longest} * 100000 - i))::int as best from {name}_work)) where n > 0)))
  where p.x <> '' and p.y <> ''),
{name}_sums as (
  select a, b, sum((best + 99999) // 100000) as n
  from (select *, list_max(list_transform(range(1, len(x) + 1), lambda i: {longest} * 100000 - i))::int as best from {name}_work) group by a, b),
{name} as materialized (select a, b, case when a = '' or b = '' then 0.0 when a = b then 1.0 else 2 * n::double / (len(a) + len(b)) end as ratio from {name}_pairs left join {name}_sums using (a, b))"""


#: Tables that queries build on.
BASE = f"""claims as materialized ({K.CLAIMS}), lines as materialized ({K.LINES_DUCKDB}),
reads as (select record_id, string_agg(text, chr(10) order by line_id) as text from lines group by record_id),
numbered as materialized (select record_id, row_number() over (partition by record_id order by line_id) as line_no, {strip('text')} as line from lines where {strip('text')} <> ''),
flagged as materialized (
  select *, {ws('line')} as x, {noise('line')} as noise, {warn('line')} as warn, {body('line')} as body, {fragment('line')} as frag, {noun('line')} as noun,
    {abv('line')} as abv, regexp_extract(line, {q(V.MILLILITRES)}, 0) as volume,
    {unannotated('line')} as u, case when not {noise('line')} and not {warn('line')} and {distillery('line')} then {unannotated('line')} else '' end as named from numbered),
stops as (select record_id, coalesce(min(line_no) filter (warn and not noise), 1000) as stop from flagged group by record_id),
brands as (
  select record_id, coalesce(nullif({ws("string_agg(u, ' ' order by line_no) filter (line_no < stop and not noise and not body and not frag)")}, ''),
    nullif({ws("arg_max(named, length(named) * 1000 - line_no) filter (named <> '')")}, ''), arg_min(u, line_no) filter (not noise and not body and not frag and not warn), '') as brand,
    coalesce(nullif({ws("string_agg(u, ' ' order by line_no) filter (line_no < stop and not noise and not body and not frag)")}, ''), arg_min(u, line_no) filter (not noise and not body and not frag and not warn), '') as brand_of_run
  from flagged join stops using (record_id) group by record_id),
around as (
  select *, lag(x) over w as prev, lag(body) over w as prev_body, lead(x) over w as nxt, lead(body) over w as nxt_body from flagged window w as (partition by record_id order by line_no)),
nouns as (select * from around where noun qualify row_number() over (partition by record_id order by line_no) = 1),
merged as (
  select record_id, case when regexp_extract(coalesce(prev, ''), '(?i)\\bsmall\\s+batch\\b', 0) <> '' and not contains(lower(x), lower(regexp_extract(prev, '(?i)\\bsmall\\s+batch\\b', 0)))
    then regexp_extract(prev, '(?i)\\bsmall\\s+batch\\b', 0) || ' ' || x
    else (select string_agg(p, ' ' order by pre desc, pos) from (select p, max({like('lower(p)', V.any_of(V.CLASS_PREFIXES))}) as pre, min(pos) as pos from (values
        (case when not prev_body and {like('lower(prev)', V.any_of(V.CLASS_PREFIXES))} and not contains(lower(x), lower(prev)) then prev end, 1), (x, 2),
        (case when not nxt_body and {like('lower(nxt)', V.any_of(V.CLASS_PREFIXES))} then nxt end, 3)) v(p, pos) where p is not null group by p)) end as m from nouns),
classes as (
  select record_id, case when lower(string_split(m, ' ')[1]) in ('kentucky', 'indiana', 'tennessee') then m
    else array_to_string(list_concat(list_filter(string_split(m, ' '), lambda w: lower(w) in ('kentucky', 'indiana', 'tennessee')), list_filter(string_split(m, ' '), lambda w: lower(w) not in ('kentucky', 'indiana', 'tennessee'))), ' ') end as class_type from merged),
heads as (select record_id, arg_min(x, line_no) as head, string_agg(x, chr(10) order by line_no) as whole,
    arg_min(x, line_no) filter ({like('lower(x)', 'alc|proof|%')}) as alcohol, arg_min(volume, line_no) filter (volume <> '') as volume from flagged group by record_id),
parsed as materialized (
  select record_id, case when brand <> '' then brand when not {class_prefix('head')} then head else '' end as brand_name, coalesce(class_type, '') as class_type,
    coalesce(alcohol, '') as alcohol_content, coalesce(volume, '') as net_contents,
    case when regexp_extract(whole, {q(V.WARNING_BLOCK)}, 1) = '' then '' else {trim_warning(f"regexp_extract(whole, {q(V.WARNING_BLOCK)}, 1)")} end as government_warning
  from heads join brands using (record_id) left join classes using (record_id))"""


def base(sql: str) -> str:
    return f"with recursive {BASE} {sql}"


def grants(order: str) -> str:
    """A table f of requests with what is granted of them, one after the other."""
    return f"""with recursive r as (select user_id as tenant, event_id as seq, 1 + event_id % 4 as n, row_number() over (partition by user_id order by {order}) as k from events),
f as (select tenant, seq, n, k, n <= 10 as granted, case when n <= 10 then n else 0 end as used from r where k = 1
  union all select r.tenant, r.seq, r.n, r.k, f.used + r.n <= 10, case when f.used + r.n <= 10 then f.used + r.n else f.used end from f join r on r.tenant = f.tenant and r.k = f.k + 1)"""


#: Claims beside every line of their read.
BESIDE = "(select c.*, l.line_id, l.text from claims c join lines l using (record_id))"


def _long(reads: str = "parsed", name: str = "long", fuzzy: bool = False) -> str:
    """Five rows for each record, as in the flow of all rules; fuzzy: garbled brands by their similarity."""
    shown = f"case when {class_prefix('r.brand_name')} then '' else r.brand_name end"
    fields = "c.record_id, c.brand_name cb, c.class_type cc, c.alcohol_content ca, c.net_contents cn, c.government_warning cw, r.class_type rc, r.alcohol_content ra, r.net_contents rn, r.government_warning rw"
    joined = f"(select {fields}, {shown} rb from claims c join {reads} r using (record_id))"
    brand, alike, more = brand_rule("cb", "rb"), "'same_words', 'same_letters'", ""
    if fuzzy:
        more = f", {ratios(f'{name}_like', f'select {letters('cb')} as a, {letters('rb')} as b from {joined} where {garbled('rb')}')}"
        joined = f"(select j.*, ratio from (select *, {letters('cb')} as lc, {letters('rb')} as lr from {joined}) j left join {name}_like on lc = a and lr = b)"
        garbled_ones = {1: f"case when ratio >= {V.BRAND_PASS} then 0 when ratio >= {V.BRAND_REVIEW} then 1 else 2 end", 2: f"case when ratio >= {V.BRAND_PASS} then 'similar' when ratio >= {V.BRAND_REVIEW} then 'likely' else 'garbled_different' end"}
        brand = tuple(f"case when ({brand[1]}) = 'garbled' then {garbled_ones[i + 1]} else {b} end" for i, b in enumerate(brand))
        alike += ", 'similar'"
    rules = (("rb", brand), ("rc", text_rule("cc", "rc")), ("ra", number_rule("ca", "ra", abv, V.ABV_TOLERANCE)), ("rn", number_rule("cn", "rn", ml, V.ML_TOLERANCE)), ("rw", warning_rule("cw", "rw")))
    shown_as = lambda i, r, why: f"case when {why} in ({alike}) then {('cb', 'cc')[i]} else {r} end" if i < 2 else r
    each = " union all ".join(
        f"select record_id, {i} as field_pos, {q(V.FIELDS[i])} as field_key, {('cb', 'cc', 'ca', 'cn', 'cw')[i]} as claim, {r} as read, {shown_as(i, r, why)} as shown, {s} as severity, {why} as reason from {name}_j"
        for i, (r, (s, why)) in enumerate(rules)
    )
    return f"{more}, {name}_j as materialized (select * from {joined}), {name} as materialized ({each})"


#: Verdict and keys of each record of a table as _long makes it.
ROLLUP = (
    f"select record_id, {status('max(severity)')} as overall_status, coalesce(string_agg(field_key, ',' order by field_pos) filter (severity = 2), '') as failed_keys, "
    "coalesce(string_agg(field_key, ',' order by field_pos) filter (severity > 0), '') as rescue_keys from {} group by record_id"
)


def _named(x: str) -> str:
    """The brand that a line with a distillery word gives."""
    u = unannotated(x)
    return f"case when {distillery(u)} and {u} <> '' and not {noise(u)} and not {warn(u)} then {u} else '' end"


def _heads() -> str:
    """brand_of (the brand read, else the first line) and the lines of each read."""
    return f""", heads_of as materialized (select record_id, list(text order by line_id) as l, arg_min({strip('text')}, line_id) as head from lines where {strip('text')} <> '' group by 1),
told as materialized (select record_id, brand, head, l, coalesce(nullif(brand, ''), head) as raw, c.brand_name as claim, text from reads join claims c using (record_id) join heads_of using (record_id) join brands using (record_id))"""


def _clarified() -> str:
    remark = f"claim || {q(V.REMARK[0])} || raw || {q(V.REMARK[1])}"
    pairs = f"select {letters('claim')} as a, {letters('raw')} as b from told"
    return base(f"""{_heads()}, {ratios('alike', pairs)}
select record_id, case when {brand_fold('raw')} = {brand_fold('claim')} then text when {garbled('raw')} and ratio >= {V.BRAND_REVIEW} then array_to_string(list_prepend({remark}, l[2:]), chr(10)) else array_to_string(l, chr(10)) end as text
from told join alike on {letters('claim')} = a and {letters('raw')} = b""")


def _improved() -> str:
    """Candidates are all lines of a second reading, whose first line is another brand in odd records."""
    bad = f"({ml('line')} is not null or {abv('line')} is not null or contains(lower(line), 'government warning') or {batch_lot('line')} or {class_prefix('line')})"
    return base(f"""{_heads()},
again as materialized (select record_id, line_id as pos, line, case when {_named('line')} <> '' then {_named('line')} else line end as candidate
  from (select record_id, line_id, {strip("case when line_id = 1 and record_id % 2 = 1 then 'Old Lantern Distillery' else text end")} as line from lines)
  where line <> '' qualify row_number() over (partition by record_id, lower(line) order by line_id) = 1 and not {bad}),
now as materialized (select *, case when {class_prefix('raw')} then '' else raw end as current from told),
{ratios('alike', f"select {letters('claim')} as a, {letters('current')} as b from now union all select {letters('claim')}, {letters('candidate')} from now join again using (record_id) union all select {letters('claim')}, {letters('line')} from now join numbered using (record_id)")},
scored as (select record_id, pos, candidate, case when {distillery('candidate')} then least(ratio + 0.08::double, 1.0) else ratio end as s from again join now using (record_id) join alike on {letters('claim')} = a and {letters('candidate')} = b),
best as (select record_id, arg_max(candidate, {{'s': s, 'p': -pos}}) as candidate, max(s) as s from scored group by 1),
weighed as (select now.*, candidate, coalesce(s, -1) as s, case when current = '' then 0.0 else ratio end as own from now join alike on {letters('claim')} = a and {letters('current')} = b left join best using (record_id)),
picked as materialized (select *, case when s > own then candidate else current end as pick, greatest(s, own) as score from weighed),
changes as materialized (select * from picked where pick <> '' and score >= 0.45 and (pick <> current or current = '')),
places as (select record_id, min(line_no) as spot from changes join numbered using (record_id) join alike on {letters('claim')} = a and {letters('line')} = b where ratio >= score * 0.85::double group by 1)
select p.record_id, case when c.record_id is null then p.text when spot is not null then array_to_string(list_concat(p.l[1:spot - 1], [p.pick], p.l[spot + 1:]), chr(10))
  when p.current <> '' and {class_prefix('p.head')} then array_to_string(list_prepend(p.pick, p.l[2:]), chr(10)) else array_to_string(list_prepend(p.pick, p.l), chr(10)) end as text
from picked p left join changes c using (record_id) left join places using (record_id)""")


def oracle_sql() -> dict[str, str]:
    a, n = number_rule("alcohol_content", "t4.text", abv, V.ABV_TOLERANCE)[0], number_rule("net_contents", "t5.text", ml, V.ML_TOLERANCE)[0]
    t3, t1 = text_rule("class_type", "text"), brand_rule("brand_name", "shown")
    w = warning_rule("c.government_warning", "p.government_warning")
    split = r"string_split(text, chr(10))"
    top = f"(select *, row_number() over (partition by record_id order by x0, box_id) as place, count(*) over (partition by record_id) as n from (select * from b qualify row_number() over (partition by record_id order by (x1 - x0) * (y1 - y0) desc, box_id) <= 2))"
    shape = "case when ((x1 - x0)::double / greatest(y1 - y0, 1) >= 2.2 and (x0 + x1) / 2.0 > img_w * 0.45) or ((x1 - x0)::double / greatest(y1 - y0, 1) >= 1.8 and y1 - y0 < img_h * 0.45) then 'warning' else 'brand' end"
    best = "select record_id, angle, score from (select *, max(case when angle = 0 then score end) over (partition by record_id) as base from a) where angle = 0 or (score > base and score - base >= 0.10 and not (base > 0 and (score - base) / (case when base > 0 then base else 1 end) < 0.06)) qualify row_number() over (partition by record_id order by score desc, angle) = 1"
    words = "(select record_id, (line_id // 4)::int as block, (line_id % 4)::int as paragraph, case when line_id % 3 = 0 or (p - 1) % 5 = 4 then 0.0 else confidence end as confidence, x_min + (p - 1) * 50 as x0, y_min as y0, x_min + (p - 1) * 50 + 45 as x1, y_max as y1, p, string_split(text, ' ')[p] as t from (select *, unnest(range(1, len(string_split(text, ' ')) + 1)) as p from lines))"
    score = "(record_id % 250)::double"
    low = f"lower({ws('text')})"
    alias = " ".join(f"when {q(x)} then {q(y)}" for x, y in [*V.BIN_ALIASES.items(), *((f, f) for f in (*V.FIELDS, "ignore"))])
    value = "regexp_replace((payload -> ('$.\"' || k || '\"'))::varchar, '([0-9])[.]0+([],]|$)', '\\1\\2', 'g')"
    named = f"p as ({K.BINS}), named as materialized (select record_id, field_key, refs from (select record_id, case regexp_replace(lower(k), '[^a-z0-9_]', '', 'g') {alias} end as field_key, k, {value} as refs, pos from (select record_id, payload, unnest(json_keys(payload)) as k, unnest(range(0, len(json_keys(payload)))) as pos from (select * from p where json_valid(payload)))) where field_key is not null qualify row_number() over (partition by record_id, field_key order by pos desc) = 1)"
    tokens_of = """regexp_extract_all(refs, '"(?:[^"\\\\]|\\\\.)*"|[^\\s\\[\\],]+')"""
    token = f"unnest({tokens_of}) as t, unnest(range(0, len({tokens_of}))) as i"
    numbers = f"(select i, case when regexp_matches(t, '^\"[0-9]+\"$') then try_cast(trim(t, '\"') as int) when regexp_matches(t, '^[0-9]+([.]0+)?$') then nullif(try_cast(t as double)::int, 0) end as n from (select {token})) where n is not null"
    strings = """case when refs like '"%' then [refs::json ->> '$'] when refs like '[%' then list_transform(list_filter(json_extract(refs, '$[*]'), lambda x: json_type(x) = 'VARCHAR'), lambda x: x ->> '$') else [] end"""
    flat = lambda x: f"lower(regexp_replace({x}, '\\s+', '', 'g'))"
    own = f"case field_key when 'government_warning' then min(line_no) filter ({like('line', '(?i)' + V.HEADER)}) when 'alcohol_content' then min(line_no) filter (abv is not null) when 'net_contents' then min(line_no) filter (volume <> '') else min(line_no) filter (line = claim or contains({flat('line')}, {flat('claim')}) or contains({flat('claim')}, {flat('line')})) end"
    refs = f""", {named}, keyed as (select record_id, unnest({list(V.FIELDS)}) as field_key, unnest([{', '.join(V.FIELDS)}]) as claim from claims),
given as (select record_id, field_key, n, i from named, lateral (select i, n from {numbers}) where field_key <> 'ignore'), ignored as (select record_id, n from named, lateral (select i, n from {numbers}) where field_key = 'ignore'),
said as (select record_id, field_key, i, v from (select record_id, field_key, {strip('v')} as v, i from (select record_id, field_key, unnest({strings}) as v, unnest(range(0, len({strings}))) as i from named where field_key <> 'ignore')) where v <> '' and not regexp_matches(v, '^[0-9]+$')),
texted as (select s.record_id, s.field_key, s.i, coalesce(min(line_no) filter (line = v or contains({flat('line')}, {flat('v')}) or contains({flat('v')}, {flat('line')})), min(line_no) filter (contains({flat('line')}, {flat('claim')}) or contains({flat('claim')}, {flat('line')}))) as n
  from said s join keyed using (record_id, field_key) join flagged using (record_id) anti join given using (record_id, field_key) group by 1, 2, 3),
spoken as (select record_id, field_key, n, i from texted where n is not null),
found as (select record_id, field_key, {own} as n, 0 as i from keyed join flagged using (record_id) anti join given using (record_id, field_key) anti join spoken using (record_id, field_key) group by record_id, field_key),
sizes as (select record_id, max(line_no) as size from numbered group by 1),
chosen as (select record_id, field_key, n, min(i) as i from (select * from given union all select * from spoken union all select record_id, field_key, n, i from found) anti join ignored using (record_id, n) join sizes using (record_id) where n between 1 and size group by 1, 2, 3)"""
    answers = f"select p_partkey as record_id, {q(STUB_ANSWER)} as payload from part"
    ok = f"case field_key when 'brand_name' then {strip('v')} <> '' and {ml('v')} is null and not {warn('v')} when 'government_warning' then {like('v', '(?i)' + V.HEADER)} else true end"
    # the fields that a re-mapping saves, and the reads with them; given: what else has to hold
    rescued = lambda given: f"""own as (select record_id, unnest({list(V.FIELDS)}) as field_key, unnest([{', '.join(V.FIELDS)}]) as v from binned),
asked as (select record_id, max(severity) as overall, any_value(contains(text, 'www.')) as failed from long join reads using (record_id) group by 1),
fit as (select record_id, field_key, case when severity > 0 and ({ok}) {given} then {strip('v')} else '' end as v from own join long using (record_id, field_key)),
saved as (select record_id, {', '.join(f"max(v) filter (field_key = {q(k)}) as s_{k}" for k in V.FIELDS)} from fit group by 1),
again as materialized (select p.record_id, {', '.join(f"coalesce(nullif(s_{k}, ''), {k}) as {k}" for k in V.FIELDS)} from parsed p left join saved using (record_id))"""  # noqa: E731
    assembled = f"""{warning_block(V.GAP_FULL)}, firsts as (select record_id, arg_min(line, line_no) filter (abv is not null) as alcohol, arg_min(volume, line_no) filter (volume <> '') as volume from flagged group by 1)
select record_id, concat_ws(chr(10), nullif(brand_of_run, ''), nullif(class_type, ''), alcohol, volume, nullif(warning, '')) as text from brands join firsts using (record_id) join blocks using (record_id) left join classes using (record_id)"""
    kept = f"not (case field_key when 'government_warning' then not {like('line', '(?i)' + V.HEADER)} and {discard('line')} and not warn when 'brand_name' then named = '' and ({discard('line')} or {garbled('line')}) else {discard('line')} end)"
    binned = f""", picked as (select record_id, field_key, i, case when field_key = 'brand_name' and named <> '' then named else line end as v from chosen join flagged on chosen.record_id = flagged.record_id and chosen.n = flagged.line_no where {kept}),
whole as (select record_id, field_key, case when count(*) = 1 and field_key <> 'government_warning' then any_value(v) else {ws("string_agg(v, ' ' order by i)")} end as v from picked group by 1, 2),
binned as (select record_id, {', '.join(f"coalesce(max(v) filter (field_key = {q(k)}), '') as {k}" for k in V.FIELDS)} from claims left join whole using (record_id) group by record_id)""".replace("select record_id, field_key, i, case", "select chosen.record_id, field_key, i, case")
    complete = ", complete as (select b.record_id, " + ", ".join(f"coalesce(nullif(b.{k}, ''), p.{k}, '') as {k}" for k in V.FIELDS) + " from binned b left join parsed p using (record_id))"
    absent = ", ".join(f"case when trim({k}) = '' then {q(k)} end" for k in V.FIELDS)
    brand_ok = f"(brand_name = '' or ({ml('brand_name')} is null and not {warn('brand_name')}))"
    upright = lambda x, s: f"({readability(x)} >= 0.55 or ({readability(x)} >= 0.40 and {like(x, '(?i)government warning')}) or ({readability(x)} >= 0.35 and ({s} / greatest(length({ws(x)}), 1) >= 0.55 or {s} >= 180)))"
    turned = f"a as ({K.ANGLES_DUCKDB}), turned as (select record_id, angle, case when angle = (record_id % 4) * 90 then r.text else substr(r.text, 1, 12) end as text, score as raw from a join reads r using (record_id)), worths as materialized (select record_id, angle, s * (0.25::double + 0.75::double * ({readability('text')})) as score, angle = 0 and {upright('text', 's')} as up from (select *, raw * length(text) / 3.0::double as s from turned))"
    worth_it = "angle = 0 or (score > base and score - base >= 0.10 and not (base > 0 and (score - base) / (case when base > 0 then base else 1 end) < 0.06))"
    turns = f"""a as ({K.ANGLES_DUCKDB}), kept as (select *, max(case when angle = 0 then score end) over (partition by record_id) as base from a where record_id % 3 <> 1 or angle = 0),
whole as (select record_id, angle from kept where {worth_it} qualify row_number() over (partition by record_id order by score desc, angle) = 1),
scored as (select w.record_id, w.angle, w.record_id % 5 = 0 as upright, z.score as brand_upright, h.score as brand_score, case when w.record_id % 4 = 0 then 0 when w.record_id % 4 = 1 then 90 else 180 end as brand_angle,
  case when w.record_id % 6 < 3 then 0 when w.record_id % 6 = 3 then null else 180 end as warning_angle, case when w.record_id % 7 = 0 then 3 else 0 end as skew, w.record_id % 11 <> 0 as sweeps
  from whole w join a z on w.record_id = z.record_id and z.angle = 0 join a h on w.record_id = h.record_id and h.angle = 180),
decided as (select *, case when not sweeps then 'direct' when angle = 0 and coalesce(warning_angle = 0 and brand_angle in (90, 180, 270) and brand_score > brand_upright + 0.05, false) then 'per_region'
  when angle = 0 and coalesce(not upright and brand_angle = warning_angle and brand_angle <> 0, false) then 'uniform' else 'whole' end as decision from scored),
turned_by as (select *, case decision when 'uniform' then brand_angle when 'whole' then angle else 0 end::int as rotation_deg, case when decision in ('uniform', 'whole') then skew else 0 end::int as skew_deg from decided),
rotations as materialized (select record_id, decision, rotation_deg, skew_deg, decision = 'direct' or (decision <> 'per_region' and rotation_deg = 0 and skew_deg = 0) as was_upright,
  decision = 'per_region' and brand_angle = 180 and coalesce(warning_angle = 0, false) as brand_inverted, decision = 'per_region' as per_region,
  case when decision = 'per_region' then brand_angle else rotation_deg end::int as brand_deg, case when decision = 'per_region' then warning_angle else rotation_deg end::int as warning_deg from turned_by),
reasons as materialized (select record_id, case when per_region then 'per_region' when brand_inverted and rotation_deg = 0 and skew_deg = 0 then 'brand_inverted' when was_upright then '' when rotation_deg in (90, 180, 270) and skew_deg <> 0 then 'turned_and_tilted'
  when rotation_deg in (90, 180, 270) then 'turned' when skew_deg <> 0 then 'tilted' else 'adjusted' end as reason from rotations)"""
    area = "(x1 - x0) * (y1 - y0)"
    cover = "greatest(0, least(e.x1, b.x1) - greatest(e.x0, b.x0)) * greatest(0, least(e.y1, b.y1) - greatest(e.y0, b.y0))::double / greatest((b.x1 - b.x0) * (b.y1 - b.y0), 1) >= 0.35"
    grown = "{'x0': least(e.x0, b.x0), 'y0': least(e.y0, b.y0), 'x1': greatest(e.x1, b.x1), 'y1': greatest(e.y1, b.y1)}"
    merge = lambda source: f"""sized as materialized (select record_id, x0::int as x0, y0::int as y0, x1::int as x1, y1::int as y1, row_number() over (partition by record_id order by {area} desc, box_id) as k from {source}),
fold as (select record_id, k, [{{'x0': x0, 'y0': y0, 'x1': x1, 'y1': y1}}] as acc from sized where k = 1
  union all select record_id, k, case when spot is null then list_append(acc, {{'x0': b.x0, 'y0': b.y0, 'x1': b.x1, 'y1': b.y1}}) else list_concat(acc[1:spot - 1], list_transform(acc[spot:spot], lambda e: {grown}), acc[spot + 1:]) end
  from (select f.record_id, b.k, f.acc, b, list_position(list_transform(f.acc, lambda e: {cover}), true) as spot from fold f join sized b on b.record_id = f.record_id and b.k = f.k + 1)),
folded as (select record_id, arg_max(acc, k) as acc from fold group by 1),
merged_boxes as materialized (select record_id, unnest(range(0, len(acc)))::int as place, unnest(acc) as m from folded)"""  # noqa: E731
    region = f"""{merge('(select * from b where ' + area + ' >= img_w * img_h * 0.02 and x1 - x0 >= img_w * 0.08 and y1 - y0 >= img_h * 0.08)')},
flat as (select record_id, place as box_id, m.x0 as x0, m.y0 as y0, m.x1 as x1, m.y1 as y1, 1800 as img_w, 950 as img_h from merged_boxes)"""
    word = "(select record_id, (x_min + (p - 1) * 50 + x_min + (p - 1) * 50 + 45) / 2.0 as cx, (y_min + y_max) / 2.0 as cy, (line_id // 4)::int * 1000 + (line_id % 4)::int * 100 + p - 1 as word_id, string_split(text, ' ')[p] as t, case when line_id % 3 = 0 or (p - 1) % 5 = 4 then 0.0 else confidence end as confidence, x_min + (p - 1) * 50 as x0, y_min as y0, x_min + (p - 1) * 50 + 45 as x1, y_max as y1 from (select *, unnest(range(1, len(string_split(text, ' ')) + 1)) as p from lines))"
    images = "select p_partkey as record_id, (800 + (p_partkey * 7) % 3000)::int as img_w, (500 + (p_partkey * 3) % 1900)::int as img_h, (p_partkey % 31 - 15)::double as degrees from part"
    return {
        "abv_net_verdict": base(f"select {status(f'greatest({a}, {n})')} as status, count(*) as n from claims c join lines t4 on c.record_id = t4.record_id and t4.line_id = 4 join lines t5 on c.record_id = t5.record_id and t5.line_id = 5 group by 1"),
        "ws_normalize": f"select doc_id, md5({ws('text')}) as folded from documents",
        "brand_normalize": base(f"select record_id, line_id, {brand_fold('text')} as folded from lines"),
        "ocr_fold": base(f"select record_id, line_id, {letters('text')} as folded from lines"),
        "warning_fold": base(f"select record_id, line_id, {warning_fold('text')} as folded from lines"),
        "token_sets": f"select doc_id, len(t)::int as n, md5(array_to_string(list_sort(t), ' ')) as words from (select doc_id, {tokens('text')} as t from documents)",
        "token_jaccard": base(f"select record_id, line_id, round({jaccard('class_type', 'text')}, 6) as overlap from {BESIDE}"),
        "token_set_equal": base(f"select record_id, line_id, {same_set('brand_name', 'text')} as same from {BESIDE}"),
        "garbled_flags": base(f"select record_id, line_id, {garbled('text')} as garbled, ({ml('text')} is null and {garbled('text')}) as garbled_prose from lines"),
        "line_kinds": base(f"select record_id, line_no, line, {batch_lot('line')} as is_batch_lot, {discard('line')} as is_discard, noise as is_noise, {like('lower(line)', V.any_of(V.NOISE))} as is_noise_words, body as is_body, frag as is_class_fragment, warn as is_warning, {class_prefix('line')} as is_class_prefix from flagged"),
        "noise_by_kind": base(f"select {batch_lot('line')} as is_batch_lot, noise as is_noise, {discard('line')} as is_discard, count(*) as n from flagged group by 1, 2, 3"),
        "document_lines": f"select record_id, count(*) as n_lines, max(length(l)) as longest from (select doc_id as record_id, trim(unnest({split})) as l from documents) where l <> '' group by 1",
        "reading_order": base("select record_id, line_id, row_number() over (partition by record_id order by y_center, x_min, line_id) as line_no from lines"),
        "line_gaps": base("select record_id, row_number() over w as line_no, coalesce(greatest(y_min - lag(y_max) over w, 0.0), 0.0) as gap from lines window w as (partition by record_id order by y_center, x_min, line_id)"),
        "raw_lines": base(f"select record_id, string_agg({ws('text')}, '|' order by y_center, x_min, line_id) as raw_lines from lines where {ws('text')} <> '' group by 1"),
        "brand_read": base("select record_id, brand from brands"),
        "class_read": base("select record_id, coalesce(class_type, '') as class_type from brands left join classes using (record_id)"),
        "parsed_fields": base("select * from parsed"),
        "text_field_verdict": base(f"select record_id, line_id, {t3[0]} as severity, {t3[1]} as reason from {BESIDE}"),
        "warning_verdict": base(f"select record_id, {w[0]} as severity, {w[1]} as reason from claims c join parsed p using (record_id)"),
        "brand_verdict_norm": base(f"select record_id, line_id, {t1[0]} as severity, {t1[1]} as reason from (select *, case when {class_prefix('text')} then '' else text end as shown from {BESIDE})"),
        "all_fields_long": base(f"{_long()} select record_id, field_pos, field_key, read, shown, severity, reason, {status('severity')} as status from long"),
        "record_rollup": base(f"{_long()} {ROLLUP.format('long')}"),
        "brand_verdict_fuzzy": base(f"{_long(fuzzy=True)} select record_id, field_pos, field_key, claim, read, shown, severity, reason, {status('severity')} as status from long where field_pos = 0"),
        "clarified_text": _clarified(),
        "improved_brand": _improved(),
        "missing_parts": base(f"select record_id, array_to_string({missing('government_warning')}, '|') as missing from parsed"),
        "trimmed_warning": base(f"select record_id, {trim_warning('text')} as warning from reads"),
        "payload_fields": f"with {named} select record_id, field_key, refs from named",
        "ref_flatten": f"with {named} select record_id, field_key, coalesce((select string_agg(n, ',' order by i) from {numbers}), '') as line_nos from named",
        "bin_refs": base(f"{refs} select record_id, field_key, coalesce(string_agg(n, ',' order by i), '') as line_nos from keyed left join chosen using (record_id, field_key) group by 1, 2"),
        "bin_fields": base(f"{refs}{binned} select * from binned"),
        "bin_complete": base(f"{refs}{binned}{complete} select * from complete"),
        "bin_validity": base(f"{refs}{binned}{complete} select record_id, concat_ws(',', {absent}) as missing, {brand_ok} as brand_ok, ({brand_ok} and (government_warning = '' or {like('government_warning', '(?i)' + V.HEADER)}) and concat_ws(',', {absent}) = '') as valid from complete"),
        "line_dedupe_union": base("select record_id, row_number() over (partition by record_id order by part, line_no) as line_no, line from (select * from (select record_id, line_no, line, 0 as part from numbered union all select record_id, line_no, case when line_no % 2 = 0 then upper(line) else line || ' again' end, 1 from numbered) qualify part = 0 or row_number() over (partition by record_id, lower(line) order by part, line_no) = 1)"),
        "positional_pair": "with p as (select p_partkey, p_partkey // 50 as batch_id, p_partkey % 50 as pos, p_name from part), g as (select batch_id, count(*) filter (p_partkey % 97 != 5) as n, count(*) as m from p group by 1) select batch_id, pos, p_name, p_partkey as record_id, n, pos + 1 as k from p join g using (batch_id) where n = m and p_partkey % 97 != 5",
        "hash_pair": base("select c.record_id, c.net_contents, p.net_contents as read from claims c join parsed p using (record_id)"),
        "text_containment_join": base("select c.record_id, coalesce(min(n.line_no) filter (n.line = c.class_type or contains(a, b) or contains(b, a)), 0)::int as line_no from claims c join (select *, lower(regexp_replace(line, '\\s+', '', 'g')) as a from numbered) n using (record_id), lateral (select lower(regexp_replace(c.class_type, '\\s+', '', 'g')) as b) group by 1"),
        "doc_score": base("select record_id, round(case when record_id % 2 = 0 then avg(confidence) else 0.75 end * length(any_value(r.text)), 6) as score from reads r join lines l using (record_id) group by record_id"),
        "readability": base(f"select record_id, floor(({readability('text')}) * 1e6::double + 0.5::double)::bigint as millionths from reads"),
        "upright": base(f"select record_id, line_id, (r >= 0.55 or (r >= 0.40 and {like('text', '(?i)government warning')}) or (r >= 0.35 and ({score} / greatest(length({ws('text')}), 1) >= 0.55 or {score} >= 180))) as upright from (select *, {readability('text')} as r from lines)"),
        "warning_checks": base("select record_id, (" + " and ".join(f"contains({low}, {q(w)})" for w in ("government warning:", "surgeon general", "pregnancy", "birth defects", "impairs your ability", "health", "problem")) + ") as complete, (contains(lower(text), 'government warning') and contains(lower(text), 'surgeon general') and contains(lower(text), 'health problem')) as ok from reads"),
        "image_sizes": f"with i as ({images}) select record_id, case when img_w <= 1600 then img_w else 1600 end as w, case when img_w <= 1600 then img_h else trunc(img_h * (1600.0::double / img_w))::int end as h from i",
        "rotated_sizes": f"with i as ({images}) select record_id, case when abs(degrees) >= 0.01 then trunc(img_h * abs(sin(radians(degrees))) + img_w * abs(cos(radians(degrees))))::int else img_w end as w, case when abs(degrees) >= 0.01 then trunc(img_h * abs(cos(radians(degrees))) + img_w * abs(sin(radians(degrees))))::int else img_h end as h from i",
        "field_matches": base(f"select record_id, list_sort({tokens('c.brand_name')}) = list_sort({tokens('p.brand_name')}) as brand, list_sort({tokens('c.class_type')}) = list_sort({tokens('p.class_type')}) as class, {abv('c.alcohol_content')} is not distinct from {abv('p.alcohol_content')} as alcohol, {ml('c.net_contents')} is not distinct from {ml('p.net_contents')} as net from claims c join parsed p using (record_id)"),
        "rotation_pick": f"with a as ({K.ANGLES_DUCKDB}) {best}",
        "skew_gate": f"with a as ({K.ANGLES_DUCKDB}) select record_id, angle, case when abs(record_id % 19 - 9) <= 3 then false when abs(record_id % 19 - 9) >= 6 then score - 1.0 >= 0.03 else score - 1.0 >= 0.05 end as worth from a",
        "orientation_conflict": f"with a as ({K.ANGLES_DUCKDB}), best as ({best}) select b.record_id, b.angle as brand_angle, (b.record_id % 2 = 0 and b.angle in (90, 180, 270) and b.score > z.score + 0.05) as conflict from best b join a z on b.record_id = z.record_id and z.angle = 0",
        "box_filter": f"with b as ({K.BOXES_DUCKDB}) select record_id, box_id from b where (x1 - x0) * (y1 - y0) >= img_w * img_h * 0.02 and x1 - x0 >= img_w * 0.08 and y1 - y0 >= img_h * 0.08",
        "box_padding": f"with b as ({K.BOXES_DUCKDB}) select record_id, box_id, greatest(x0 - 30, 0) as x0, greatest(y0 - 30, 0) as y0, least(x1 + 30, img_w) as x1, least(y1 + 30, img_h) as y1 from b",
        "top_two_boxes": f"with b as ({K.BOXES_DUCKDB}) select record_id, place, box_id from {top}",
        "box_roles": f"with b as ({K.BOXES_DUCKDB}), t as (select *, {shape} as shape from {top}), g as (select record_id, count(distinct shape) as kinds from t group by 1) select record_id, unnest(case when n = 1 then (case when shape = 'brand' then ['brand'] else ['brand', 'warning'] end) when kinds = 2 then [shape] when place = 1 then ['brand'] else ['warning'] end) as role, box_id from t join g using (record_id)",
        "box_halves": "with i as (select p_partkey as record_id, (800 + p_partkey % 1000)::int as img_w from part) select record_id, 'brand' as role, 0 as x0, 0 as y0, floor(img_w * 0.48)::int as x1, 950 as y1 from i union all select record_id, 'warning', floor(img_w * 0.48)::int, 0, img_w, 950 from i",
        "paragraph_fold": base(f"select record_id, block, paragraph, string_agg(t, ' ' order by p) as text, round(coalesce(avg(confidence) filter (confidence <> 0), 0.9), 6) as confidence, min(x0) as x_min, min(y0) as y_min, max(x1) as x_max, max(y1) as y_max from {words} group by 1, 2, 3"),
        "text_preview": f"select doc_id, md5(case when length(text) > {V.PREVIEW} then substr(text, 1, {V.PREVIEW}) || '...' else text end) as preview from documents",
        "quota_greedy": f"{grants('event_id')} select tenant, seq, n, granted, used from f",
        "quota_remaining": "select user_id as tenant, sum(1 + event_id % 4)::bigint as used, 50::bigint as max_tests, greatest(50 - sum(1 + event_id % 4), 0)::bigint as remaining from events group by 1",
        "upper_median": "select event_type, round(list_sort(list(value))[count(value) // 2 + 1], 3) as median from events group by 1",
        "score_report": "select case when quality = 1 then 'PASS' else 'FAIL' end as expected, count(*) as n, count(*) filter (doc_id % 7 != 0 and (case when doc_id % 5 = 0 then 'REVIEW' when toxic = 1 then 'FAIL' else 'PASS' end) = (case when quality = 1 then 'PASS' else 'FAIL' end)) as correct, count(*) filter (doc_id % 7 != 0 and doc_id % 5 = 0) as review from labels group by 1",
        "reader_report": """with e as (select doc_id, toxic, case when quality = 1 then 'PASS' else 'FAIL' end as expected, unnest([0, 1, 2]) as r from labels),
v as (select *, case when (doc_id + r) % 5 = 0 then 'REVIEW' when toxic = 1 then 'FAIL' else 'PASS' end as verdict, (doc_id * (r + 3) % 97)::double / 8.0::double as seconds from e)
select 'reader ' || r as reader, count(*) as n, count(*) filter (expected = 'PASS' and verdict = 'PASS') as correct_pass, count(*) filter (expected = 'FAIL' and verdict = 'FAIL') as correct_fail,
  count(*) filter (verdict = 'REVIEW') as review, round(list_sort(list(seconds))[count(*) // 2 + 1], 3) as median_seconds from v group by 1""",
        "sample_names": "with a as (select distinct p_brand as name from part where p_size % 2 = 0), b as (select distinct p_brand as name from part where p_size % 3 = 0) select name, name in (select name from a) and name in (select name from b) as in_both from (select * from a union select * from b)",
        "claims_from_json": base("select record_id // 20 as batch_id, count(*) as n, (count(*) - 1)::int as last_pos, count(*) filter (net_contents = '1.5 L') as litres from claims group by 1"),
        "detection_tuples": base("select record_id, line_id, text, case when record_id % 2 = 0 then 0.5 else 0.85 end::double as confidence from lines"),
        "order_totals_verdict": "select case when total is null then 'REVIEW' when abs(total - o_totalprice) < 50000 then 'PASS' else 'FAIL' end as status, count(*) as n from orders left join (select l_orderkey, sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)) as total from lineitem group by 1) on o_orderkey = l_orderkey group by 1",
        "repaired_text": base(f", put as (select record_id, replace(text, 'Alc./Vol.', 'Alc NVol.') as text from reads), {repaired('done', 'put', 'text')} select record_id, text from done"),
        "merged_warning": base(f"""select r.record_id, s.line_id, {merged_warning('r.text', 's.text')} as text from reads r
join (select record_id, line_id, 'noise ' || text as text from lines union all select record_id, 0, 'noise ' || text from reads) s using (record_id)"""),
        "merged_reads": base(f""", second as (select record_id, string_agg(text, chr(10) order by line_id) as text from lines where line_id >= 5 group by 1), {repaired('b', 'reads', 'text')}, {repaired('w', 'second', 'text')},
put as (select b.record_id, w.text as second, b.text as first, {merged_warning('b.text', 'w.text')} as text from b join w using (record_id)), {repaired('done', 'put', 'text')},
firsts as (select record_id, line, line_no as n, 0 as part from numbered),
nexts as (select record_id, case when i % 2 = 1 then upper(x) else x || ' again' end as line, i as n, 1 as part from (select record_id, unnest(l) as x, unnest(range(1, len(l) + 1)) as i from (select record_id, {lines_of('text')} as l from second))),
news as (select * from nexts n where not exists (select 1 from firsts f where f.record_id = n.record_id and lower(f.line) = lower(n.line)) qualify row_number() over (partition by record_id, lower(line) order by n) = 1),
joined as (select record_id, string_agg(line, '|' order by part, n) as raw_lines from (select * from firsts union all select * from news) group by 1)
select record_id, case when second = '' then first else done.text end as text, raw_lines from done join joined using (record_id)"""),
        "warning_block": base(f"{warning_block(V.GAP_FULL)} select record_id, warning from blocks"),
        "warning_block_region": base(f"{warning_block(V.GAP_REGION)} select record_id, warning from blocks"),
        "assembled_text": base(f"{assembled}"),
        "assembled_documents": base(f"{assembled} union all select record_id + 1000000, brand_name from claims union all select record_id + 2000000, class_type from claims"),
        "line_group_fold": base(f""", words as materialized (select *, row_number() over (partition by record_id order by cy, cx, word_id) as k from {word}),
tols as (select record_id, greatest(list_sort(list((y1 - y0)::double))[count(*) // 2 + 1] * 0.65, 8.0) as tol from words group by 1),
walk as (select record_id, k, cy as c, 1 as line_no from words where k = 1
  union all select w.record_id, w.k, case when abs(w.cy - f.c) <= tol then (f.c + w.cy) / 2.0 else w.cy end, f.line_no + (abs(w.cy - f.c) > tol)::int from walk f join words w on w.record_id = f.record_id and w.k = f.k + 1 join tols on tols.record_id = w.record_id)
select record_id, line_no, string_agg(t, ' ' order by cx, word_id) as text, round(avg(confidence), 6) as confidence, min(x0) as x_min, min(y0) as y_min, max(x1) as x_max, max(y1) as y_max from walk join words using (record_id, k) group by 1, 2"""),
        "box_merge": f"with recursive b as ({K.BOXES_DUCKDB}), {merge('b')} select record_id, place, m.x0 as x0, m.y0 as y0, m.x1 as x1, m.y1 as y1 from merged_boxes",
        "region_roles": f"""with recursive b as ({K.BOXES_DUCKDB}), {region}, two as (select *, row_number() over (partition by record_id order by x0, box_id) as place, count(*) over (partition by record_id) as n from (select * from flat qualify row_number() over (partition by record_id order by {area} desc, box_id) <= 2)),
t as (select *, {shape} as shape from two), g as (select record_id, count(distinct shape) as kinds from t group by 1),
r as (select record_id, unnest(case when n = 1 then (case when shape = 'brand' then ['brand'] else ['brand', 'warning'] end) when kinds = 2 then [shape] when place = 1 then ['brand'] else ['warning'] end) as role, x0, y0, x1, y1 from t join g using (record_id)),
i as (select p_partkey as record_id, (800 + p_partkey % 1000)::int as img_w from part), n as (select * from i anti join r using (record_id))
select record_id, role, greatest(x0 - 8, 0) as x0, greatest(y0 - 8, 0) as y0, least(x1 + 8, 1800) as x1, least(y1 + 8, 950) as y1 from r
union all select record_id, 'brand', 0, 0, floor(img_w * 0.48)::int, 950 from n union all select record_id, 'warning', floor(img_w * 0.48)::int, 0, img_w, 950 from n""",
        "rotation_read": base(f", {turned}, gated as (select *, max(up) over (partition by record_id) as upright from worths), kept as (select *, max(case when angle = 0 then score end) over (partition by record_id) as base from gated where not upright or angle = 0) select record_id, angle, upright, floor(score * 1e6::double + 0.3::double)::bigint as score from kept where {worth_it} qualify row_number() over (partition by record_id order by score desc, angle) = 1"),
        "turn_search": base(f""", {turned}, gated as (select *, max(up) over (partition by record_id) as upright from worths),
kept as (select *, max(case when angle = 0 then score end) over (partition by record_id) as base from gated where not upright or angle = 0),
coarse as (select record_id, angle, score as base from kept where {worth_it} qualify row_number() over (partition by record_id order by score desc, angle) = 1),
fine as (select record_id, angle, base, text, raw * length(text) / 3.0::double as s, unnest(case when angle = 0 then {list(V.SKEWS)} else {list(V.SKEWS_TURNED)} end) as skew from coarse join turned using (record_id, angle)),
w as (select *, s * (1.0::double + ((record_id + angle + skew + 15) % 7 - 2) / 20.0::double) * (0.25::double + 0.75::double * ({readability('text')})) as worth from fine),
z as (select record_id, angle, base, arg_max({{'worth': worth, 'skew': skew}}, {{'worth': worth, 'k': -skew}}) as best from w group by 1, 2, 3),
g as (select *, best.worth > base and case when abs(best.skew) <= 3 then false when abs(best.skew) >= 6 then best.worth - base >= 0.03 else best.worth - base >= 0.05 end as good from z)
select record_id, angle, case when good then best.skew else 0 end::int as skew, floor((case when good then best.worth else base end) * 1e6::double + 0.3::double)::bigint as score from g"""),
        "skew_pick": base(f""", a as ({K.ANGLES_DUCKDB}), w as (select record_id, angle as pos, case when angle = 90 then 0 else angle // 30 - 3 end as skew, (1.0::double + score / 10) * (0.25::double + 0.75::double * ({readability('text')})) as worth from a join reads using (record_id)),
z as (select record_id, max(worth) filter (skew = 0) as base, arg_max({{'worth': worth, 'skew': skew}}, {{'worth': worth, 'k': -pos}}) filter (skew <> 0) as best from w group by 1),
g as (select *, best.worth > base and case when abs(best.skew) <= 3 then false when abs(best.skew) >= 6 then best.worth - base >= 0.03 else best.worth - base >= 0.05 end as good from z)
select record_id, case when good then best.skew else 0 end::int as skew, floor((case when good then best.worth else base end) * 1e6::double + 0.3::double)::bigint as score from g"""),
        "orientation_decision": f"with {turns} select * from rotations",
        "rotation_reasons": f"with {turns} select * from reasons",
        "verification_json": base(f"""{_long()}, {turns}, f as (select record_id, {status('max(severity)')} as overall_status, list({{'field_pos': field_pos, 'field_key': field_key, 'claim': claim, 'shown': shown, 'status': {status('severity')}, 'reason': reason}} order by field_pos) as fields from long group by 1),
v as (select f.*, case when length(text) > {V.PREVIEW} then substr(text, 1, {V.PREVIEW}) || '...' else text end as preview from f join reads using (record_id))
select v.record_id, overall_status, case when v.record_id % 2 = 0 then to_json({{'record_id': v.record_id, 'overall_status': overall_status, 'fields': fields, 'preview': preview, 'rotation': {{'rotation_deg': rotation_deg, 'skew_deg': skew_deg, 'was_upright': was_upright, 'brand_inverted': brand_inverted, 'per_region': per_region, 'brand_deg': brand_deg, 'warning_deg': warning_deg, 'reason': reason}}}})
  else to_json({{'record_id': v.record_id, 'overall_status': overall_status, 'fields': fields, 'preview': preview}}) end::varchar as result from v join rotations using (record_id) join reasons using (record_id)"""),
        "mapping_outcomes": base(f"{refs}{binned}{complete}, valid as (select record_id, concat_ws(',', {absent}) as missing, ({brand_ok} and (government_warning = '' or {like('government_warning', '(?i)' + V.HEADER)}) and concat_ws(',', {absent}) = '') as valid from complete) select v.record_id, case when not json_valid(payload) then 'bad_payload' when not valid then 'invalid' else 'mapped' end as outcome, case when json_valid(payload) and not valid then missing else '' end as missing from valid v join p using (record_id)"),
        "rescue_recompare": base(f"{refs}{binned}{_long(fuzzy=True)}, {rescued('')}{_long('again', 'second', True)} {ROLLUP.format('second')}"),
        "reads_source": base("select text, count(*) as n, 0.85::double as confidence from lines group by 1"),
        "usage_snapshot": f"{grants('event_id')} select tenant, (sum(n) * any_value(case when tenant % 2 = 0 then 2 else 1 end))::bigint as used from f where granted group by tenant",
        "quota_stream": f"{grants('ts, event_id')} select tenant, seq, n, granted, used from f",
        "event_log": base(f"""{_long()}, verdicts as (select record_id, {status('max(severity)')} as status from long group by 1),
told as (select record_id // 50 as batch_id, (record_id % 50 + 1)::int as k, 50::int as n, record_id, status from verdicts)
select 'log' as type, batch_id, k, n, record_id, '[' || lpad(k::varchar, 3, '0') || '/050] ' || record_id as message from told union all select 'result', batch_id, k, n, record_id, status from told
union all select 'done', null, null, count(*)::int, null, '{{"used": ' || count(*) || ', "remaining": ' || (1000000 - count(*)) || '}}' from told"""),
        "model_rescue": base(f"""{refs.replace(K.BINS, answers)}{binned}{_long(fuzzy=True)}, {rescued('and record_id in (select record_id from asked where not failed)')}
{_long('again', 'second', True)}, rolled as ({ROLLUP.format('second')}), fits as (select record_id, bool_or(v <> '') as kept_any from fit group by 1)
select rolled.*, case when overall = 0 then 'no_targets' when failed then 'call_failed' when not kept_any then 'nothing_valid' else 'rescued' end as reason from rolled join asked using (record_id) join fits using (record_id)"""),
        "rescue_outcomes": base(f"""{refs}{binned}{_long()}, sev as (select record_id, field_key, severity from long), own as (select record_id, unnest({list(V.FIELDS)}) as field_key, unnest([{', '.join(V.FIELDS)}]) as v from binned),
fit as (select record_id, field_key, severity, case field_key when 'brand_name' then {strip('v')} <> '' and {ml('v')} is null and not {warn('v')} when 'government_warning' then {like('v', '(?i)' + V.HEADER)} else {strip('v')} <> '' end as ok from own join sev using (record_id, field_key)),
s as (select record_id, max(severity) as severity, bool_or(severity > 0 and ok) as any_ok from fit group by 1)
select record_id, case when severity = 0 then 'no_targets' when record_id % 41 = 0 then 'no_lines' when not json_valid(payload) then 'bad_payload' when not any_ok then 'nothing_valid' else 'rescued' end as outcome from s join p using (record_id)"""),
    }
