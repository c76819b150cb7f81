"""SQL for the queries whose rows it can express, over whole tables whose doc_id is a key.

Each goes a plain way of its own: no buckets, sketches or prefix hashes. The other queries have trained, tokenized or
hashed columns.
"""

#: Lists of turns are compared themselves; every inner prefix of every conversation is a row.
OP6_CHAT_FORMAT = r"""
with turns as (
  select conv_id, role, text, row_number() over (partition by conv_id order by turn nulls first, role nulls first, text nulls first) as n
  from conversations where conv_id is not null
), whole as (
  select conv_id, count(*) as size, list([coalesce('=' || role, ''), coalesce('=' || text, '')] order by n) as said from turns group by conv_id
), inner_prefixes as (
  select distinct said[1:k] as said from (select said, unnest(range(1, size)) as k from whole)
), stay as (
  select min(conv_id) as conv_id from whole anti join inner_prefixes using (said) group by said
)
select conv_id, (n - 1) // 256 as segment, count(*) as n_turns,
  string_agg('<|im_start|>' || coalesce(role, 'user') || chr(10) || regexp_replace(coalesce(text, ''), '<\|(im_start|im_end)\|>', '< |\1| >', 'g') || '<|im_end|>' || chr(10), '' order by n) as rendered
from turns join stay using (conv_id) group by conv_id, segment
"""

#: Two lines are one edit apart when the same code point taken from both, or one taken from either, makes them equal.
OP7_LINE_DEDUP = r"""
with parts as (
  select doc_id, string_split(text, chr(10)) as lines from documents
), numbered as (
  select doc_id, no, lines[no] as line, regexp_matches(lines[no], '[^\x20\x09-\x0D]') as worded
  from (select doc_id, lines, unnest(range(1, len(lines) + 1)) as no from parts)
), placed as (
  select *, row_number() over (order by doc_id nulls first, no) as place from numbered where worded
), firsts as (
  select line, min(place) as place from placed group by line
), shortened as (
  select place, 0 as without, md5_number(line) as rest from firsts where length(line) >= 16
  union all
  select place, k, md5_number(left(line, k - 1) || substr(line, k + 1)) from (select place, line, unnest(range(1, length(line) + 1)) as k from firsts where length(line) >= 16)
), near as (
  select distinct b.place from shortened a join shortened b using (rest)
  where a.place < b.place and (a.without = b.without or a.without = 0 or b.without = 0)
), stay as (
  select place from firsts anti join near using (place)
), kept as (
  select n.doc_id, count(*) filter (n.worded) as n_lines, count(*) filter (n.worded and s.place is null) as n_removed,
    coalesce(string_agg(n.line, chr(10) order by n.no) filter (not n.worded or s.place is not null), '') as text
  from numbered n left join placed p on n.doc_id is not distinct from p.doc_id and n.no = p.no left join stay s on p.place = s.place
  group by n.doc_id
)
select d.doc_id, coalesce(n_lines, 0) as n_lines, coalesce(n_removed, 0) as n_removed, case when d.text is not null then sha256(k.text) end as kept_sha256
from documents d left join kept k on d.doc_id is not distinct from k.doc_id
"""

#: All shingles of all documents are joined with each other, and links followed to their end.
OP9_MINHASH = r"""
with recursive said as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents
), shingles as (
  select distinct doc_id, array_to_string(w[k : k + 4], ' ') as s from (select doc_id, w, unnest(range(1, greatest(len(w) - 4, least(len(w), 1)) + 1)) as k from said)
), sizes as (
  select doc_id, count(*) as n from shingles group by doc_id
), common as (
  select a.doc_id as u, b.doc_id as v, count(*) as c from shingles a join shingles b using (s) where a.doc_id <> b.doc_id group by u, v
), links as (
  select u, v from common join sizes x on x.doc_id = u join sizes y on y.doc_id = v where 100 * c >= 85 * (x.n + y.n - c)
), reached as (
  select doc_id as a, doc_id as b from documents
  union
  select a, v from reached join links on u = b
), components as (
  select a, min(b) as component_id from reached group by a
)
select d.doc_id, coalesce(n, 0) as n_shingles, component_id, d.doc_id is null or d.doc_id = component_id as kept
from documents d left join sizes on sizes.doc_id = d.doc_id left join components on a = d.doc_id
"""

#: Levels by recursion over whole tables; CRC-32 bit by bit; roots folded step by step.
OP11_MERKLE = r"""
with recursive shown as (
  select *, case when list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(doc_id::varchar, ''), lambda c: ascii(c)::bigint)),
      lambda crc, b: list_reduce(list_prepend(xor(crc, b), range(8)), lambda x, i: case when x & 1 = 1 then xor(x >> 1, 3988292384) else x >> 1 end)) & 1 = 1
    then replace(text, chr(10), '') else text end as seen,
    dense_rank() over (order by source nulls first) - 1 as tree
  from documents
), leaves as (
  select doc_id, tree, head, sha256(head || coalesce(strlen(text) || ':' || text, '-')) as leaf, sha256(head || coalesce(strlen(seen) || ':' || seen, '-')) as seen
  from (select *, coalesce(strlen(doc_id::varchar) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::varchar) || ':' || n_chars, '-') as head from shown)
), placed as (
  select *, row_number() over (partition by tree order by doc_id nulls first, leaf) - 1 as pos, count(*) over (partition by tree) as n from leaves
), nodes as (
  select 0 as level, tree, pos, n, leaf as hash from placed
  union all
  select level + 1, tree, pos // 3, (n + 2) // 3, sha256(string_agg(hash, '' order by pos)) from nodes where n > 1 group by level, tree, pos // 3, n
), subroots as (
  select tree, level as height, hash as subroot from nodes where n = 1
), tops as (
  select 0 as level, tree as pos, (select count(*) from subroots) as n, subroot as hash from subroots
  union all
  select level + 1, pos // 3, (n + 2) // 3, sha256(string_agg(hash, '' order by pos)) from tops where n > 1 group by level, pos // 3, n
), steps as (
  select p.tree, p.pos, x.level as step,
    coalesce(string_agg(x.hash, '' order by x.pos) filter (x.pos < p.pos // (3 ** x.level)::bigint), '') as before,
    coalesce(string_agg(x.hash, '' order by x.pos) filter (x.pos > p.pos // (3 ** x.level)::bigint), '') as after
  from placed p join nodes x on x.tree = p.tree and x.n > 1 and x.pos // 3 = p.pos // (3 ** (x.level + 1))::bigint group by p.tree, p.pos, x.level
  union all
  select p.tree, p.pos, s.height + x.level,
    coalesce(string_agg(x.hash, '' order by x.pos) filter (x.pos < p.tree // (3 ** x.level)::bigint), ''),
    coalesce(string_agg(x.hash, '' order by x.pos) filter (x.pos > p.tree // (3 ** x.level)::bigint), '')
  from placed p join subroots s using (tree) join tops x on x.n > 1 and x.pos // 3 = p.tree // (3 ** (x.level + 1))::bigint group by p.tree, p.pos, s.height, x.level
), folded as (
  select tree, pos, 0 as step, seen as hash from placed
  union all
  select f.tree, f.pos, f.step + 1, sha256(before || hash || after) from folded f join steps s on s.tree = f.tree and s.pos = f.pos and s.step = f.step
), ways as (
  select tree, pos, string_agg(before || after, '' order by step) as siblings from steps group by tree, pos
), ends as (
  select tree, pos, arg_max(hash, step) as folded_root from folded group by tree, pos
), whole as (
  select hash as root from tops where n = 1
)
select doc_id, leaf, subroot, root, sha256(coalesce(siblings, '')) as proof_sha256, folded_root, folded_root = root as verified
from placed join subroots using (tree) cross join whole join ends using (tree, pos) left join ways using (tree, pos)
"""

#: Every term of a language with every source of it, and all pairs of sources term by term.
OP12_DIVERGENCE = r"""
with docs as (
  select coalesce(lang, '') as lang, coalesce(source, '') as source, coalesce(text, '') as text, row_number() over () as d from documents
), words as (
  select lang, source, d, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) as term from docs
), kept as (
  select lang, term, count(*)::hugeint as n from words group by lang, term having count(distinct d) >= 10
), langs as (
  select lang, count(*)::hugeint as v, sum(n)::hugeint as total from kept group by lang
), places as (
  select distinct lang, source from docs
), counts as (
  select lang, source, term, count(*)::hugeint as c from words semi join kept using (lang, term) group by lang, source, term
), sizes as (
  select lang, source, sum(c)::hugeint as size from counts group by lang, source
), grid as (
  select lang, source, term, coalesce(c, 0) as c, 1 + (1000000000::hugeint * (coalesce(c, 0) + 2)) // (coalesce(size, 0) + 2 * v) as p,
    1 + (1000000000::hugeint * (k.n + 2)) // (total + 2 * v) as q
  from places join kept k using (lang) join langs using (lang) left join sizes using (lang, source) left join counts using (lang, source, term)
), sums as (
  select a.lang, a.source, b.source as item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) as value
  from grid a join grid b using (lang, term) where a.source <> b.source group by a.lang, a.source, b.source
), both_parts as (
  select a.lang, a.source, 'pair' as part, b.source as item, coalesce(value, 0)::bigint as value
  from places a join places b on a.lang = b.lang and a.source <> b.source left join sums s on s.lang = a.lang and s.source = a.source and s.item = b.source
  union all
  select lang, source, 'term', term, (((p - q) * (p - q)) // (p + q))::bigint from grid where c > 0 and p > q
)
select *, row_number() over (partition by lang, source, part order by value desc, item)::int as rank from both_parts qualify part = 'pair' or rank <= 10
"""

ORACLE_SQL: dict[str, str] = {"op6_chat_format": OP6_CHAT_FORMAT, "op7_line_dedup": OP7_LINE_DEDUP, "op9_minhash": OP9_MINHASH, "op11_merkle": OP11_MERKLE, "op12_divergence": OP12_DIVERGENCE}
