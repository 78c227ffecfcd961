"""DuckDB SQL of the queries that SQL can say whole."""

from placeweave.llm import credentials, decontaminate

SPACES = r"[\x20\x09-\x0D]+"
SOLID = r"[^\x20\x09-\x0D]"

QUALITY = rf"""
with d as (
  select row_number() over () as r, doc_id, source, coalesce(text, '') as t,
         list_filter(string_split_regex(coalesce(text, ''), '{SPACES}'), lambda x: x <> '') as w
  from documents),
windows as (
  select r, i, array_to_string(w[i:i + 4], ' ') as x
  from (select r, w, unnest(range(1, len(w) - 3)) as i from d)),
twice as (select r, x from windows group by all having count(*) > 1),
repeated as (
  select r, count(distinct p) as n
  from (select r, unnest(range(i, i + 5)) as p from windows join twice using (r, x)) group by r),
lines as (
  select r, doc_id, source, trim(regexp_replace(regexp_replace(lower(l), '[0-9]+', '0', 'g'), '{SPACES}', ' ', 'g')) as line
  from (select r, doc_id, source, unnest(string_split(t, chr(10))) as l from d)),
common as (
  select source, line from lines where line <> '' group by all
  having count(distinct coalesce(cast(doc_id as varchar), '')) > 25),
lost as (
  select r, sum(len(string_split(line, ' '))) as n
  from lines l where line <> '' and exists (select 1 from common c where c.line = l.line and c.source is not distinct from l.source)
  group by r),
counts as (
  select d.r, doc_id, cast(len(w) as bigint) as n_words,
    cast(length(regexp_replace(t, '{SPACES}', '', 'g')) as bigint) as word_chars,
    cast(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) as bigint) as n_symbols,
    cast(len(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{SOLID}')))
      - len(list_distinct(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{SOLID}')))) as bigint) as n_dup_lines,
    cast(coalesce(repeated.n, 0) as bigint) as n_repeat_words,
    cast(coalesce(lost.n, 0) as bigint) as n_common_words
  from d left join repeated using (r) left join lost using (r))
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, n_common_words, n_left_words,
       not base_failed and n_left_words >= 10 and n_left_words >= 0.5 * n_words as kept
from (select * exclude (r), n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed,
             n_words - n_common_words as n_left_words from counts)
"""


def _spans(kind, pattern, keep, group=0):
    quoted = pattern.replace("'", "''")
    rank = credentials.KINDS.index(kind)
    return rf"""
  select r, source, lang, '{kind}' as kind, {rank} as rank, hit, part,
         cast(coalesce(list_sum(list_transform(pieces[1:k], lambda x: length(x))), 0)
           + coalesce(list_sum(list_transform(hits[1:k - 1], lambda x: length(x))), 0) as bigint) as start
  from (select *, hits[k] as hit, parts[k] as part
        from (select *, unnest(range(1, len(hits) + 1)) as k
              from (select r, source, lang, string_split_regex(t, '{quoted}') as pieces,
                           regexp_extract_all(t, '{quoted}') as hits,
                           regexp_extract_all(t, '{quoted}', {group}) as parts
                    from d where regexp_matches(t, '{quoted}'))))
  where {keep}"""


SECRETS = f"""
with d as (select row_number() over () as r, doc_id, source, lang, coalesce(text, '') as t from documents),
base as ({' union all '.join([
    _spans('assign', credentials.ASSIGN, 'length(part) >= 12', 2),
    _spans('access', credentials.ACCESS, 'true'),
    _spans('hex', credentials.HEX, 'true')])}),
tokens as ({_spans('token', credentials.TOKEN, "regexp_matches(hit, '[0-9]') and regexp_matches(hit, '[a-z]') and regexp_matches(hit, '[A-Z]')")}),
found as (
  select * from base union all
  select * from tokens t where not exists (
    select 1 from base b where b.r = t.r and b.start < t.start + length(t.hit) and t.start < b.start + length(b.hit))),
owners as (
  select part, count(distinct coalesce(source, chr(1))) as owners,
         count(distinct coalesce(source, chr(1)) || chr(2) || coalesce(lang, chr(1))) as repos
  from found group by part),
told as (
  select f.*, owners <= 2 and repos <= 5 and not regexp_matches(part, '{credentials.PLACEHOLDER}') as live
  from found f join owners using (part)),
reported as (
  select *, kind || ':' || start || ':' || (start + length(hit)) as span from told where rank < 3 or live)
select doc_id,
  count(*) filter (rank = 0) as n_assign, count(*) filter (rank = 1) as n_access, count(*) filter (rank = 2) as n_hex,
  sha256(coalesce(string_agg(span, ',' order by start, rank) filter (rank < 3), '')) as base_sha256,
  coalesce(string_agg(span, ',' order by start, rank) filter (rank is not null), '') as spans,
  count(*) filter (live) as n_live, count(*) filter (not live) as n_examples
from d left join reported using (r) group by d.r, doc_id
"""

_WORDS = (
    "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
    r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
)

LEAKS = f"""
with d as (select row_number() over () as r, doc_id, {_WORDS} as w from documents),
items as (select item_id, w, least({decontaminate.WINDOW}, len(w)) as k
          from (select item_id, {_WORDS} as w from benchmark) where len(w) > 0),
known as (select distinct item_id, k, array_to_string(w[i:i + k - 1], ' ') as x
          from (select *, unnest(range(1, len(w) - k + 2)) as i from items)),
sizes as (select distinct k from known),
placed as (select r, i, k, array_to_string(w[i:i + k - 1], ' ') as x
           from (select r, w, k, unnest(range(1, cast(len(w) - k + 2 as bigint))) as i from d, sizes)),
met as (select r, i, k, item_id from placed join known using (k, x)),
hit as (select r, count(distinct p) as n from (select r, unnest(range(i, i + k)) as p from met) group by r),
names as (select r, string_agg(name, ',' order by name) as names, count(*) as n
          from (select distinct r, cast(item_id as varchar) as name from met where item_id is not null) group by r)
select doc_id, cast(len(w) as bigint) as n_words, coalesce(hit.n, 0) as n_hit, coalesce(names.n, 0) as n_items,
       sha256(coalesce(names.names, '')) as items_sha256, coalesce(hit.n, 0) > 0 as contaminated
from d left join hit using (r) left join names using (r)
"""

NEGATIVES = """
with given as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
         list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as v
  from embeddings
  where vec_id is not null and label is not null and len(embedding) > 0
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
size as (select len(v) as n from given group by 1 order by count(*) desc, 1 limit 1),
rows as (select * from given where len(v) = (select n from size)),
scored as (
  select a.vec_id as anchor_id, b.vec_id, a.label = b.label as same,
         list_sum(list_transform(range(1, len(a.v) + 1), lambda i: a.v[i] * b.v[i])) as score
  from rows a join rows b on a.vec_id <> b.vec_id where a.vec_id % 50 = 0),
positives as (
  select anchor_id, vec_id as positive_id, score as positive_score from scored where same
  qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5)
select anchor_id, positive_id, cast(row_number() over w as integer) as rank, vec_id as negative_id,
       cast(positive_score as bigint) as positive_score, cast(score as bigint) as negative_score
from positives join scored using (anchor_id)
where not same and 50 * positive_score <= 100 * score and 100 * score <= 95 * positive_score
window w as (partition by anchor_id, positive_id order by score desc, vec_id)
qualify row_number() over w <= 3
"""


def _crc32(text):
    """crc32 of an ASCII text; ``crc`` must hold the table of its 256 remainders."""
    codes = f"list_transform(string_split({text}, ''), lambda c: cast(ascii(c) as bigint))"
    step = "lambda crc, b: xor(t[(xor(crc, b) & 255) + 1], crc >> 8)"
    return f"xor(list_reduce(list_concat([4294967295], {codes}), {step}), 4294967295)"


def _least(*ways):
    """The cheapest of (condition, cost so far and edit, letter, repaired text); ties by the letters."""
    each = ", ".join(
        f"case when {when} and {old} is not null then {{'c': {old}.c + {price}, 'a': {old}.a || '{letter}', "
        f"'r': {old}.r" + (f" || '\n' || {text}" if text else "") + "} end"
        for when, old, price, letter, text in ways
    )
    return f"list_min(list_filter([{each}], lambda x: x is not null))"


_STAYS = "case when fault = 'truncated' then 5 else 0 end"
_MAY = "coalesce(fault, '') not in ('blank', 'duplicate')"
_KEPT = "role || ':' || text"
_TO_USER = [(f"{_MAY} and role[1] = 'u'", q, _STAYS, "K", _KEPT) for q in ("p", "s", "a")] + [
    (_MAY, q, f"1 + {_STAYS}", "R", "'user:' || text") for q in ("p", "s", "a")
]
_TO_ASSISTANT = [
    (f"{_MAY} and role[1] = 'a'", "u", _STAYS, "K", _KEPT), (_MAY, "u", f"1 + {_STAYS}", "R", "'assistant:' || text"),
]
#: States: p nothing yet, s a system turn, u a user's turn, a an assistant's turn; each {cost, letters, repaired}.
REPAIRS = f"""
with recursive crc as (
  select list_transform(range(256), lambda n: list_reduce(list_concat([n], [0, 0, 0, 0, 0, 0, 0, 0]),
         lambda c, z: case when c % 2 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)) as t),
given as (
  select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
         {_crc32("coalesce(cast(conv_id as varchar), ' ') || ':' || coalesce(cast(turn as varchar), ' ')")} % 20 as fate
  from conversations, crc),
left_over as (
  select conv_id, turn, case when fate = 4 then 'user' else role end as role,
         case fate when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text,
         unnest(case when fate = 3 then [0, 1] else [0] end) as copy
  from given where fate <> 0),
numbered as (
  select *, row_number() over (partition by conv_id order by turn nulls first, role, text, copy) as i from left_over),
faulty as (
  select *, lag(role[1]) over (partition by conv_id order by i) || role[1] as pair,
         case when not regexp_matches(text, '{SOLID}') then 'blank'
              when row_number() over (partition by conv_id, role, text order by i) > 1 then 'duplicate'
              when not regexp_matches(text, '[.!?]{SPACES[:-1]}*$') then 'truncated' end as fault
  from numbered),
steps as (
  select conv_id, cast(0 as bigint) as i, {{'c': 0, 'a': '', 'r': ''}} as p, cast(null as struct(c integer, a varchar, r varchar)) as s,
         {{'c': 5, 'a': 'I', 'r': chr(10) || 'user:'}} as u,
         {{'c': 10, 'a': 'II', 'r': chr(10) || 'user:' || chr(10) || 'assistant:'}} as a
  from (select distinct conv_id from numbered)
  union all
  select conv_id, i, p, s, u, {_least(("true", "a", 0, "", ""), ("true", "u", 5, "I", "'assistant:'"))} as a
  from (
    select conv_id, i, p, s, a, {_least(("true", "u", 0, "", ""), *[("true", q, 5, "I", "'user:'") for q in ("p", "s", "a")])} as u
    from (
      select f.conv_id, f.i, {_least(("true", "p", 2, "D", ""))} as p,
             {_least(("true", "s", 2, "D", ""), (f"{_MAY} and role[1] = 's'", "p", _STAYS, "K", _KEPT))} as s,
             {_least(("true", "u", 2, "D", ""), *_TO_USER)} as u,
             {_least(("true", "a", 2, "D", ""), *_TO_ASSISTANT)} as a
      from steps join faulty f on f.conv_id is not distinct from steps.conv_id and f.i = steps.i + 1))),
ends as (
  select conv_id, {_least(("true", "p", 0, "", ""), ("true", "a", 0, "", ""))} as best
  from steps qualify row_number() over (partition by conv_id order by i desc) = 1),
counts as (
  select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps,
         count(*) filter (fault = 'blank') as blank, count(*) filter (fault = 'duplicate') as duplicate,
         count(*) filter (fault = 'truncated') as truncated,
         count(*) filter (i > 1 and coalesce(pair, '') not in ('su', 'ua', 'au')) as illegal
  from faulty group by conv_id)
select d.conv_id, coalesce(gaps, 0) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate,
       coalesce(truncated, 0) as truncated, coalesce(illegal, 0) as illegal, cast(coalesce(best.c, 0) as bigint) as cost,
       coalesce(best.a, '') as audit, sha256(substr(coalesce(best.r, ''), 2)) as repaired_sha256
from (select distinct conv_id from conversations) d
left join counts on counts.conv_id is not distinct from d.conv_id
left join ends on ends.conv_id is not distinct from d.conv_id
"""
