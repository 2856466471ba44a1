"""The queries that SQL can express."""

OP1 = """
with sized as (
  select doc_id, source, coalesce(source, '') || (source is null)::varchar as name,
    len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::bigint as size,
    md5('mix:' || coalesce(doc_id::varchar, '')) as key
  from documents),
sums as (select source, name, sum(size)::bigint as source_size from sized group by all),
weighted as (select *, [3, 1, 2][(row_number() over (order by source nulls last) - 1) % 3 + 1] as weight from sums),
leveled as (
  select *, (sum(source_size) over () * 1.5::double - coalesce(sum(2 * source_size) over (w rows between unbounded preceding and 1 preceding), 0))
    / sum(weight) over (w rows between current row and unbounded following) as level
  from weighted window w as (order by (2 * source_size)::double / weight, source nulls last)),
marked as (select *, weight * level >= 2 * source_size as capped from leveled),
targets as (
  select source, name, source_size,
    case when capped then (2 * source_size)::double else weight * max(case when not capped then level end) over () end as target
  from marked),
dealt as (
  select s.*, t.source_size, t.target,
    ('0x' || substr(key, 1, 8))::bigint % greatest(1, least(65536, ceil(t.source_size / 131072.0)))::bigint as shard
  from sized s join targets t on s.name = t.name),
shards as (
  select name, any_value(source) as source, shard, sum(size)::bigint as length, any_value(target) as target, floor(sum(size) * 2 / 8.0)::bigint as most
  from dealt group by name, shard),
parties as (select name, any_value(source) as source, any_value(target) as votes, sum(most)::bigint as most from shards group by name),
source_seats as (
  select name, votes / (2 * seat + 1) as quotient, source, seat
  from parties, unnest(range(0, least(most, (votes / 8)::bigint + 100))) as u(seat)),
source_quota as (
  select name, count(*) as seats
  from (select *, row_number() over (order by quotient desc, source nulls last, seat) as r from source_seats)
  where r <= (select round(sum(votes) / 8) from parties) group by name),
shard_seats as (
  select s.name, s.shard, s.length::double / (2 * seat + 1) as quotient, seat, q.seats
  from shards s join source_quota q on s.name = q.name, unnest(range(0, s.most)) as u(seat)),
quota as (
  select name, shard, count(*) as quota
  from (select *, row_number() over (partition by name order by quotient desc, shard, seat) as r from shard_seats)
  where r <= seats group by name, shard),
laid as (
  select d.*, s.length, greatest(s.length, 1) as ring, coalesce(q.quota, 0) * 8 as words,
    (sum(size) over (partition by d.name, d.shard order by key, doc_id, size rows unbounded preceding))::bigint as stop,
    ('0x' || substr(md5('mix:' || case when d.source is null then '-' else '=' || d.source end || ':' || d.shard::varchar), 1, 8))::bigint
      % ceil(greatest(s.length, 1) / 8.0)::bigint * 8 as ring_from
  from dealt d join shards s on d.name = s.name and d.shard = s.shard left join quota q on d.name = q.name and d.shard = q.shard)
select doc_id, size, source_size, target,
  (words // ring * size
   + greatest(0, least(stop, ring_from + words % ring) - greatest(stop - size, ring_from))
   + greatest(0, least(stop, ring_from + words % ring - length) - (stop - size)))::bigint as taken
from laid
"""

OP5 = """
with docs as (select coalesce(doc_id, -9223372036854775808) as id, doc_id, string_split(coalesce(text, ''), chr(10)) as ls from documents),
lines as (select id, doc_id, i, ls[i] as line from docs, unnest(range(1, len(ls) + 1)) as u(i)),
keyed as (
  select *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key
  from lines),
repeated as (
  select key, max(id) as last from keyed where length(key) >= 20 group by key having count(distinct id) >= 3),
judged as (select k.*, r.key is not null and r.last <> k.id as gone from keyed k left join repeated r on k.key = r.key)
select doc_id, count(*)::bigint as n_lines, sum(gone::int)::bigint as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by i) filter (where not gone), '')) as kept_sha256
from judged group by doc_id
"""

OP7 = """
select doc_id, max(doc_id) over w as keep_id, count(*) over w as group_size, doc_id = max(doc_id) over w as kept,
  sha256(coalesce(text, '')) as text_sha256
from documents window w as (partition by coalesce(text, ''))
"""

#: CRC-32 by the table of its polynomial; ``crcs`` is the table as a list.
CRC_TABLE = """bits as (
  select n::bigint as n, n::bigint as v, 0 as k from range(256) as t(n)
  union all
  select n, case when v % 2 = 1 then xor(v // 2, 3988292384) else v // 2 end, k + 1 from bits where k < 8),
crc_table as (select list(v order by n) as crcs from bits where k = 8)"""


def crc32(text: str) -> str:
    """SQL for the unsigned CRC-32 of a text, where ``crcs`` is in scope."""
    return f"""xor(4294967295, list_reduce(
      list_prepend(4294967295::bigint, list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda h: ('0x' || h)::bigint)),
      lambda c, b: xor(c // 256, crcs[(xor(c, b) % 256) + 1])))::bigint"""


OP12 = f"""
with recursive {CRC_TABLE},
rows as (
  select doc_id, octet_length(encode(coalesce(text, '')))::bigint + 1 as size, {crc32("coalesce(text, '')")} as text_crc32,
    md5(coalesce(doc_id::varchar, '')) as digest
  from documents, crc_table),
jumps as (
  select digest, ('0x' || substr(digest, 1, 16))::hugeint as seed, 0::bigint as place, 0 as step from (select distinct digest from rows)
  union all
  select digest, next, floor((place + 1) * (2147483648::double / ((next // 8589934592)::double + 1)))::bigint, step + 1
  from (select *, (seed * 2862933555777941757 + 1) % 18446744073709551616 as next from jumps where place <= 8)),
shards as (
  select digest, max(place) filter (where place < 8)::integer as shard, max(place) filter (where place < 9)::integer as grown_shard
  from jumps group by digest),
blocked as (
  select *, (('0x' || substr(digest, 9, 8))::bigint + text_crc32) % (1 + (select count(*) from documents) // 65536) as block
  from rows join shards using (digest))
select doc_id, size, text_crc32, 'key' as law, shard,
  row_number() over (partition by shard order by block, doc_id nulls first, size, text_crc32) - 1 as slot, grown_shard
from blocked
"""

OP11 = f"""
with recursive {CRC_TABLE},
turns as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text,
    md5('0:' || length(coalesce(role, ''))::varchar || ':' || coalesce(role, '') || coalesce(text, '')) as digest
  from conversations),
own as (
  select conv_id, list(length(role)::varchar || ':' || role || text order by turn nulls first, digest) as turns,
    list(octet_length(encode(text)) order by turn nulls first, digest) as bytes
  from turns group by conv_id),
lengths as (select own.*, {crc32("coalesce(conv_id::varchar, '')")} % 9 as h, conv_id - conv_id % 5 as base_id from own, crc_table),
whole as (
  select c.conv_id, list_concat(coalesce(b.turns, [])[1:c.h], c.turns[c.h + 1:]) as path,
    list_concat(coalesce(b.bytes, [])[1:c.h], c.bytes[c.h + 1:]) as bytes
  from lengths c left join own b on c.base_id = b.conv_id),
members as (
  select conv_id, d, path[1:d] as prefix, len(path) as n, case when d > 0 then bytes[d] else 0 end as bytes
  from whole, unnest(range(0, len(path) + 1)) as u(d)),
nodes as (
  select d, prefix, min(conv_id) as conv_id, count(*) as n_convs, (count(*) - 1) * any_value(bytes) as saved, max(n) = d as leaf,
    coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (where n = d), '') as ends
  from members group by d, prefix),
above as (select prefix[1:a] as prefix, a as d, leaf, saved from nodes, unnest(range(0, d + 1)) as u(a)),
sums as (select d, prefix, sum(leaf::int)::bigint as n_leaves, sum(saved)::bigint as saved_tokens from above group by d, prefix),
children as (select d - 1 as d, prefix[1:d - 1] as prefix, count(*) as n_children from nodes where d > 0 group by all)
select n.conv_id, n.d::bigint as depth, p.conv_id as parent_conv_id, n.n_convs, coalesce(c.n_children, 0)::bigint as n_children,
  s.n_leaves, s.saved_tokens, sha256(n.ends) as ends_sha256
from nodes n join sums s on n.d = s.d and n.prefix = s.prefix
left join children c on n.d = c.d and n.prefix = c.prefix
left join nodes p on n.d - 1 = p.d and n.prefix[1:n.d - 1] = p.prefix
"""

#: A conversation's edits as the best cost and audit by the state reached (nothing, s, u, a), turn by turn.
OP13 = f"""
with recursive {CRC_TABLE},
coded as (
  select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
    {crc32("coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ')")} % 20 as code
  from conversations, crc_table),
damaged as (
  select conv_id, turn, case when code = 4 then 'user' else role end as role,
    case code when 1 then '' when 2 then translate(text, '.!?', '') else text end as text
  from coded, unnest(case code when 0 then [] when 3 then [1, 2] else [1] end) as u(copy)),
identified as (select *, sha256(length(role)::varchar || ':' || role || text) as identity from damaged),
met as (select *, row_number() over (partition by conv_id, identity order by turn nulls first) > 1 as seen from identified),
placed as (
  select *, row_number() over (partition by conv_id order by turn nulls first, identity, seen) as i,
    right(rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1) as last
  from met),
judged as (
  select *, left(role, 1) as initial,
    case when last = '' then 'blank' when seen then 'duplicate' when last not in ('.', '!', '?') then 'truncated' else '' end as fault
  from placed),
counts as (
  select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0)::bigint as gaps,
    count(*) filter (where fault = 'blank') as blank, count(*) filter (where fault = 'duplicate') as duplicate,
    count(*) filter (where fault = 'truncated') as truncated, count(*) as n
  from judged group by conv_id),
neighbours as (select *, lag(initial) over (partition by conv_id order by i) || initial as pair from judged),
illegals as (select conv_id, count(*) filter (where pair not in ('su', 'ua', 'au')) as illegal from neighbours group by conv_id),
inserts as (select * from (values
  ('', '', '', 0), ('', 'I', 'u', 2), ('', 'II', 'a', 4), ('s', '', 's', 0), ('s', 'I', 'u', 2), ('s', 'II', 'a', 4),
  ('u', '', 'u', 0), ('u', 'I', 'a', 2), ('a', '', 'a', 0), ('a', 'I', 'u', 2)) as t(was, added, now, price)),
edits as (
  select conv_id, i, was, edit, now, price + case when fault = 'truncated' and edit <> 'D' then 1 else 0 end as price
  from judged, (values
    ('', 'R', 'u', 2), ('s', 'R', 'u', 2), ('u', 'R', 'a', 2), ('a', 'R', 'u', 2), ('', 'D', '', 3), ('s', 'D', 's', 3),
    ('u', 'D', 'u', 3), ('a', 'D', 'a', 3), ('', 'K', 's', 0), ('', 'K', 'u', 0), ('s', 'K', 'u', 0), ('u', 'K', 'a', 0), ('a', 'K', 'u', 0))
    as t(was, edit, now, price)
  where case edit when 'K' then initial = now and fault not in ('blank', 'duplicate')
    when 'R' then fault not in ('blank', 'duplicate') else true end),
steps as (
  select e.conv_id, e.i, n.was, n.added || e.edit as letters, e.now, n.price + e.price as price from edits e join inserts n on n.now = e.was),
best as (
  select conv_id, 0::bigint as i, '' as state, 0 as cost, '' as audit from counts
  union all
  select conv_id, i, state, found.cost, found.audit
  from (
    select b.conv_id, b.i + 1 as i, s.now as state, min({{'cost': b.cost + s.price, 'audit': b.audit || s.letters}}) as found
    from best b join steps s on s.conv_id is not distinct from b.conv_id and s.i = b.i + 1 and s.was = b.state
    group by b.conv_id, b.i, s.now)),
ended as (
  select b.conv_id, min({{'cost': b.cost + n.price, 'audit': b.audit || n.added}}) as found
  from best b join counts c on c.conv_id is not distinct from b.conv_id and c.n = b.i
  join inserts n on n.was = b.state where n.now in ('', 'a') group by b.conv_id),
walk as (
  select conv_id, found.audit as audit, 0 as spot, 0::bigint as i, '' as state, null::varchar as line from ended
  union all
  select w.conv_id, w.audit, w.spot + 1, w.i + case substr(w.audit, w.spot + 1, 1) when 'I' then 0 else 1 end,
    case substr(w.audit, w.spot + 1, 1) when 'D' then w.state when 'K' then j.initial else case w.state when 'u' then 'a' else 'u' end end,
    case substr(w.audit, w.spot + 1, 1) when 'D' then null when 'K' then j.role || ':' || j.text
      when 'I' then case w.state when 'u' then 'assistant:' else 'user:' end
      else case w.state when 'u' then 'assistant:' else 'user:' end || j.text end
  from walk w left join judged j on j.conv_id is not distinct from w.conv_id and j.i = w.i + 1
  where w.spot < length(w.audit)),
texts as (select conv_id, string_agg(line, chr(10) order by spot) as repaired from walk group by conv_id)
select c.conv_id, coalesce(n.gaps, 0)::bigint as gaps, coalesce(n.blank, 0)::bigint as blank,
  coalesce(n.duplicate, 0)::bigint as duplicate, coalesce(n.truncated, 0)::bigint as truncated, coalesce(l.illegal, 0)::bigint as illegal,
  coalesce(e.found.cost, 0)::bigint as cost, coalesce(e.found.audit, '') as audit, sha256(coalesce(t.repaired, '')) as repaired_sha256
from (select distinct conv_id from conversations) c
left join counts n on n.conv_id is not distinct from c.conv_id
left join illegals l on l.conv_id is not distinct from c.conv_id
left join ended e on e.conv_id is not distinct from c.conv_id
left join texts t on t.conv_id is not distinct from c.conv_id
"""

ORACLE = {"op1_mix_sources": OP1, "op5_dedup_lines": OP5, "op7_exact_duplicates": OP7, "op11_prefix_trie": OP11, "op12_jump_shards": OP12, "op13_repair_chats": OP13}
