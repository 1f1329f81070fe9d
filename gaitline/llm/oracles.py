"""DuckDB SQL for the queries of this subpackage that SQL can express; tests hold the others against brute force."""

from __future__ import annotations

from . import sharding

OP2 = r"""
with recursive d as (
    select doc_id, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size, source is null as no_source, coalesce(source, '') as src,
           md5('mix:' || coalesce(doc_id::varchar, '')) as ord
    from documents
), s as (
    select no_source, src, sum(size)::double as total, [5.0, 2.0, 1.0][(row_number() over (order by no_source, src) - 1) % 3 + 1]::double as w from d group by 1, 2
), r as (
    select *, 3 * total / w as ratio from s
), v as (
    select *, (sum(total) over () - coalesce(sum(3 * total) over before, 0)) / (sum(w) over () - coalesce(sum(w) over before, 0)) as level
    from r window before as (order by ratio, no_source, src rows between unbounded preceding and 1 preceding)
), t as (
    select no_source, src, total, w, least(3 * total, w * (select coalesce(arg_min(level, ratio), 0) from v where level <= ratio)) as target,
           case w when 5 then 7.5 when 2 then 2.0 else 0.5 end as a, case w when 5 then -5.0 when 2 then 0.0 else 1.0 end as slope
    from v
), m as (
    select doc_id, size, total, target, w, a, slope, coalesce(sum(size) over (partition by d.no_source, d.src order by ord, size rows between unbounded preceding and 1 preceding), 0)::double + size / 2.0 as middle
    from d join t on d.no_source = t.no_source and d.src = t.src
), u as (
    select *, (middle < target)::int + (total + middle < target)::int + (2 * total + middle < target)::int as copies from m
)
select doc_id, size, total::bigint as source_size, round(target, 6) as target, (copies * size)::bigint as taken, copies::int as copies,
       case when copies > 0 then round(case when slope = 0 then middle / target else (sqrt(greatest(a * a + 2 * slope * w * middle / target, 0)) - a) / slope end, 6) end as position
from u
"""

OP4 = f"""
with recursive names as (
    select i, 'shard-' || lpad(i::varchar, 2, '0') as name from range({len(sharding.SHARDS)}) t(i)
), prefs as (
    select i, list_transform(range({sharding.SLOTS}), lambda j: (('0x' || substr(md5('offset:' || name), 1, 15))::bigint % {sharding.SLOTS} + j * (('0x' || substr(md5('skip:' || name), 1, 15))::bigint % {sharding.SLOTS - 1} + 1)) % {sharding.SLOTS}) as pref
    from names
), turns(turn, slot_of) as (
    select 0, list_transform(range({sharding.SLOTS}), lambda x: -1)
    union all
    select turn + 1, list_concat(list_concat(slot_of[1:free], [i::int]), slot_of[free + 2:])
    from (select turn, slot_of, i, list_filter(pref, lambda x: slot_of[x + 1] = -1)[1] as free from turns join prefs on i = turn % {len(sharding.SHARDS)} where turn < {sharding.SLOTS})
), filled as (
    select slot_of from turns where turn = {sharding.SLOTS}
)
select doc_id, source, n_chars, slot::int as slot, (select slot_of from filled)[slot + 1]::int as shard
from (select doc_id, source, n_chars, ('0x' || substr(md5(coalesce(doc_id::varchar, '')), 1, 15))::bigint % {sharding.SLOTS} as slot from documents)
"""

OP8 = r"""
with recursive w as (
    select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as words from documents
), g as (
    select distinct doc_id, case when len(words) < 5 then array_to_string(words, ' ') else array_to_string(words[i + 1 : i + 5], ' ') end as gram
    from w, range(greatest(len(words) - 4, 1)) t(i) where len(words) > 0 and i < greatest(len(words) - 4, 1)
), n as (
    select doc_id, count(*) as n from g group by 1
), p as (
    select a.doc_id as a, b.doc_id as b, count(*) as common from g a join g b on a.gram = b.gram and a.doc_id < b.doc_id group by 1, 2
), l as (
    select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * common >= 75 * (x.n + y.n - common)
), e as (
    select a, b from l union all select b, a from l
), reach(a, b) as (
    select doc_id, doc_id from documents union select r.a, e.b from reach r join e on r.b = e.a
)
select doc_id, coalesce(n, 0)::bigint as n_shingles, component_id
from (select a as doc_id, min(b) as component_id from reach group by 1) left join n using (doc_id)
"""


#: CRC-32 of a decimal number, bit by bit: the reversed polynomial 0xEDB88320.
_CRC = """xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split({0}::varchar, ''), lambda c: ord(c)::bigint)),
    lambda r, b: list_reduce(list_prepend(xor(r, b), range(8)), lambda v, i: case when v % 2 = 1 then xor(v >> 1, 3988292384::bigint) else v >> 1 end)), 4294967295::bigint)"""

OP12 = f"""
with recursive t as (
    select conv_id as c, coalesce(role, '') as role, coalesce(text, '') as text, row_number() over (partition by conv_id order by turn nulls first) as pos from conversations where conv_id is not null
), v as (
    select c, count(*) as n, {_CRC.format('c')} % 6 as h, c - c % 100 as base from t group by c
), b as (
    select v.c, v.h, v.n, (select count(*) from t where t.c = v.base and t.pos <= v.h) as b from v
), r as (
    select v.c, t.pos as depth, t.role, t.text from v join t on t.c = v.base and t.pos <= v.h
    union all
    select b.c, b.b + t.pos - b.h, t.role, t.text from b join t on t.c = b.c and t.pos > b.h
), m as (
    select c, depth, text, sha256(string_agg(length(role)::varchar || ':' || length(text)::varchar || ':' || role || text, '') over (partition by c order by depth)) as key, depth = max(depth) over (partition by c) as ends from r
    union all
    select c, 0, '', '', not exists (select 1 from r where r.c = v.c) from v
), nodes as (
    select depth, key, min(c) as conv_id, count(*) as n_convs, max(length(text)) as size, coalesce(string_agg(c::varchar, ',' order by c) filter (ends), '') as ids from m group by 1, 2
), up as (
    select n.*, p.conv_id as parent_conv_id, p.key as parent_key from nodes n join m on m.c = n.conv_id and m.depth = n.depth - 1 join nodes p on p.depth = m.depth and p.key = m.key
    union all
    select nodes.*, null, null from nodes where depth = 0
), kids as (
    select depth - 1 as depth, parent_key as key, count(*) as n_children from up where depth > 0 group by 1, 2
), sums as (
    select m.depth, m.key, sum((k.n_children is null)::bigint)::bigint as n_leaves, sum((n.n_convs - 1) * n.size)::bigint as saved_tokens
    from nodes n left join kids k on k.depth = n.depth and k.key = n.key join m on m.c = n.conv_id and m.depth <= n.depth group by 1, 2
)
select conv_id, depth::bigint as depth, parent_conv_id, n_convs, coalesce(n_children, 0)::bigint as n_children, n_leaves, saved_tokens, sha256(ids) as ends_sha256
from up left join kids using (depth, key) join sums using (depth, key)
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_mixing": OP2, "op4_sharding": OP4, "op8_jaccard": OP8, "op12_prefixtrie": OP12}
