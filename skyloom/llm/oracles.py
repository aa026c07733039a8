"""DuckDB SQL of the corpus queries that SQL can express."""

from __future__ import annotations

from . import infill, mixing, variants
from .licenses import COMMENT_LINE, COPYRIGHT_LINE, EDGES, KNOWN, LIST_MARKER, LONG, MARKERS, NOTHING, PARAGRAPHS, SIGNS, SLOTS, SPELLINGS, entitled


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _canonical(text: str) -> str:
    out = f"regexp_replace(lower({text}), {_quoted(COPYRIGHT_LINE)}, chr(10), 'g')"
    out = f"regexp_replace({out}, {_quoted(LIST_MARKER)}, ' ', 'g')"
    for old, new in SPELLINGS:
        out = f"replace({out}, {_quoted(old)}, {_quoted(new)})"
    out = f"trim(regexp_replace({out}, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"
    for named, same in SLOTS:
        out = f"regexp_replace({out}, {_quoted(named)}, {_quoted(same)}, 'g')"
    return out


def _comment_blocks(text: str) -> str:
    lines = f"string_split(regexp_replace({text}, {_quoted(EDGES)}, chr(10) || chr(10), 'g'), chr(10))"
    bare = f"regexp_replace(l, {_quoted(SIGNS)}, '')"
    edge = f"regexp_matches(l, {_quoted(COMMENT_LINE)}) <> regexp_matches(coalesce(ls[i - 1], ''), {_quoted(COMMENT_LINE)})"
    return f"(select array_to_string(list_transform(ls, lambda l, i: case when {edge} then chr(10) || {bare} else {bare} end), chr(10)) from (select {lines} as ls))"


def _marked(text: str) -> str:
    return "(" + " or ".join(f"contains(lower({text}), '{w}')" for w in MARKERS) + ")"


def _paragraphs(text: str) -> str:
    """List of the digests of a text's paragraphs, without empty ones."""
    return f"list_filter(list_transform(string_split_regex({text}, {_quoted(PARAGRAPHS)}), lambda u: sha256({_canonical('u')})), lambda d: d <> '{NOTHING}')"


def licenses_sql() -> str:
    known = ", ".join(f"({_quoted(name)}, {_quoted(text)})" for name, text in entitled(KNOWN))
    long = ", ".join(f"({_quoted(name)}, '{text}', 0), ({_quoted(name)}, '{run}', {n})" for name, n, text, run in LONG)
    return f"""
with texts as (select license_id, text, {_paragraphs("text")} as ps from (values {known}) t(license_id, text)),
registry as (
  select distinct license_id, digest, n from (
    select license_id, sha256({_canonical("text")}) as digest, 0 as n from texts
    union all select license_id, sha256(array_to_string(ps, '')), len(ps) from texts where len(ps) > 1
    union all select * from (values {long}) l(license_id, digest, n))),
rows as (select row_number() over () as r, doc_id, text from documents),
seen as (select r, text, {_comment_blocks("text")} as bare from rows where {_marked("text")}),
runs as (
  select r, {_paragraphs("text")} as ps, 1 as other from seen
  union all select r, {_paragraphs("bare")}, case when sha256({_canonical("bare")}) = sha256({_canonical("text")}) then 1 else 0 end from seen),
units as (
  select r, true as entire, sha256({_canonical("text")}) as digest from seen
  union
  select r, false, digest from (
    select r, sha256({_canonical("u")}) as digest, sha256({_canonical("text")}) as whole from (
      select r, text, unnest(string_split_regex(text, {_quoted(PARAGRAPHS)}) || string_split_regex(bare, {_quoted(PARAGRAPHS)}) || string_split(text, chr(10))) as u from seen) where {_marked("u")})
  where digest <> whole
  union
  select r, false, sha256(array_to_string(ps[i:i + n - 1], '')) from (
    select r, ps, n, unnest(range(1, len(ps) - n + 2)) as i from runs, (select distinct n from registry where n > 1) where len(ps) - other >= n)),
hits as (select r, entire, license_id from units join registry using (digest))
select doc_id, max(license_id) filter (where entire) as whole_license, count(license_id) filter (where not entire) as n_units,
  coalesce(string_agg(distinct license_id, ',' order by license_id), '') as licenses
from rows left join hits using (r) group by r, doc_id
"""


#: The formatted string adds a head of 15 code points and the role, and an end of 9, to each turn, and a backslash to each escaped place.
CHAT_SQL = r"""
with rows as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '\### Assistant: </turn> ok'
  union all select -7, 1, 'assistant', '\### Assistant: </turn> ok')
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  cast(coalesce(sum(length(text)) filter (where role = 'assistant'), 0) as bigint) as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (where role = 'assistant'), '')) as loss_sha256,
  cast(sum(24 + length(regexp_replace(role, '(\\|</?turn|")', '\\\1', 'g')) + length(regexp_replace(text, '(\\|</?turn)', '\\\1', 'g'))) as bigint) as formatted_chars
from rows group by conv_id
"""


TOPK_SQL = """
with v as (
  select row_number() over () as uid, vec_id, list_transform(embedding, lambda x: floor(1024 * cast(x as double))) as w from embeddings
  where embedding is not null and len(embedding) > 0 and vec_id is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
pairs as (
  select q.uid as q, q.vec_id as query_id, c.vec_id, c.uid, cast(list_dot_product(q.w, c.w) as bigint) as score
  from v q join v c on q.uid <> c.uid where q.vec_id % 100 = 0)
select query_id, cast(row_number() over (partition by q order by score desc, vec_id, uid) as integer) as rank, vec_id, score
from pairs qualify rank <= 10
"""


def mix_sql() -> str:
    """The closed form: the words taken of a source are the first floor(target) words of its repeated line."""
    weights = "case " + " ".join(f"when i % {len(mixing.WEIGHTS)} = {k} then {w}" for k, w in enumerate(mixing.WEIGHTS)) + " end"
    return f"""
with recursive d as (
  select row_number() over () as r, doc_id, source, text, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) as size from documents),
s as (select source, cast(sum(size) as bigint) as n, row_number() over (order by source nulls last) - 1 as i from d group by source),
w as (select source, n, {weights} as weight from s),
-- one row per round: the level of the free sources, until none of them is above its stop
rounds as (
  select 0 as k, (select sum(n) from w)::double / (select sum(weight) from w) as unit
  union all
  select k + 1, (
    (select sum(n) from w) - {mixing.MAX_EPOCHS} * coalesce((select sum(n) from w where weight * unit > {mixing.MAX_EPOCHS} * n), 0))::double
    / (select sum(weight) from w where not weight * unit > {mixing.MAX_EPOCHS} * n)
  from rounds where k < 40),
level as (select unit from rounds order by k desc limit 1),
t as (select source, n, case when weight * unit > {mixing.MAX_EPOCHS} * n then cast({mixing.MAX_EPOCHS} * n as double) else weight * unit end as target from w, level),
p as (
  select r, d.source, d.doc_id, d.size, t.n as source_size, t.target, cast(floor(t.target) as bigint) as take,
    sum(d.size) over (partition by d.source order by md5('mix:' || d.doc_id), r) - d.size as place
  from d join t on d.source is not distinct from t.source),
-- the schedule: golden-ratio points mapped through the cumulative quotas, ranked within each source
b as (select greatest(1, least({mixing.MOST_WORDS}, cast(sum(n) // {mixing.BLOCKS} as bigint))) as block from w),
q as (
  select source, quota, sum(quota) over (order by source nulls last) - quota as begin_, sum(quota) over () as needed
  from (select source, cast(ceil(floor(target) / block) as bigint) as quota from t, b)),
lines as (select source, quota, begin_::double / needed as low, case when begin_ + quota < needed then (begin_ + quota)::double / needed else 2.0e0 end as high from q where quota > 0),
points as (select slot, (slot + 1) * {mixing.GOLDEN!r}e0 - floor((slot + 1) * {mixing.GOLDEN!r}e0) as point from (select unnest(range(0, 3 * (select cast(max(needed) as bigint) from q) + 3)) as slot)),
slots as (select slot, source, row_number() over (partition by source order by slot) - 1 as rank from points join lines on point >= low and point < high),
firsts as (
  select p.r, min(slot) as first_slot
  from p, b, (select unnest(range(0, {mixing.MAX_EPOCHS})) as epoch) e, slots
  where size > 0 and place + epoch * source_size < take and slots.source is not distinct from p.source and slots.rank = (place + epoch * source_size) // block
  group by p.r)
select doc_id, size, source_size, target, first_slot,
  cast(case when source_size = 0 then 0 else (take // source_size) * size + greatest(0, least(place + size, take % source_size) - place) end as bigint) as taken
from p left join firsts using (r)
"""


def _hash32(text: str) -> tuple[str, str]:
    """Unsigned crc32 of a string: its hexadecimal digits, two for each byte, the lower half first, through a table of 16."""
    table = []
    for k in range(16):
        for _ in range(4):
            k = k >> 1 ^ (0xEDB88320 if k & 1 else 0)
        table.append(k)
    halves = f"list_transform(range(0, octet_length(encode({text}))), lambda i: [instr('123456789ABCDEF', hx[2*i+2]), instr('123456789ABCDEF', hx[2*i+1])])"
    return halves, f"xor(list_reduce(list_prepend(4294967295::bigint, nibbles), lambda c, b: xor(({table}::bigint[])[1 + (xor(c, b) & 15)], c >> 4)), 4294967295)"


def variants_sql() -> str:
    """Near words by other means: equal after a character is left out at one place (replaced), or one is the other without a character."""
    halves, crc = _hash32("s")
    letters = variants.LETTERS.replace("\\u00C0-\\u00FF", "\u00C0-\u00FF")
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return f"""
with recursive runs as (
  select doc_id, translate(run, '{upper}', '{upper.lower()}') as run, count(*) as times
  from (select doc_id, unnest(regexp_extract_all(text, '[{letters}]+')) as run from documents) where length(run) >= {variants.LEAST_LENGTH} group by 1, 2),
keyed as (select run, times, s, hex(encode(s)) as hx from (select *, coalesce(cast(doc_id as varchar), '') || ':' || run as s from runs)),
parts as (select run, times, flatten({halves})::bigint[] as nibbles from keyed),
hashed as (select run, times, {crc} as h from parts),
spoilt as (select case when h % {variants.SPOILT} = 0 then run[:h % length(run)] || run[h % length(run) + 2:] else run end as word, times from hashed),
known as (select word, cast(sum(times) as bigint) as n from spoilt where length(word) >= {variants.LEAST_LENGTH} group by 1 having sum(times) >= 2),
less as (select word, i, word[:i - 1] || word[i + 1:] as rest from (select word, unnest(range(1, length(word) + 1)) as i from known)),
near as (
  select distinct a.word, b.word as other from less a join less b on a.i = b.i and a.rest = b.rest and a.word <> b.word
  union select a.word, b.word from less a join known b on a.rest = b.word
  union select b.word, a.word from less a join known b on a.rest = b.word),
best as (
  select near.word, count(*) as n_near, arg_max(other, n) as any_form, max(n) as top from near join known on other = known.word group by 1),
forms as (
  select known.word, known.n, coalesce(n_near, 0) as n_near, case when top >= {variants.TIMES} * known.n then top end as form_n,
    (select min(other) from near join known k on k.word = other where near.word = known.word and k.n = top) as near_form
  from known left join best on best.word = known.word),
named as (select word, n, n_near, form_n, case when form_n is not null then near_form end as form from forms),
chain as (
  select word, form as last_ from named where form is not null
  union all
  select chain.word, named.form from chain join named on named.word = chain.last_ where named.form is not null),
roots as (select word, arg_max(last_, n) as root from (select chain.word, last_, known.n from chain join known on known.word = last_) group by 1)
select word, form, coalesce(root, word) as root, n, n_near, form_n from named left join roots using (word)
"""


def infill_sql(seed: int = 42, rate: int = 50, spm_rate: int = 80) -> str:
    hashes = ", ".join(f"cast(cast('0x' || digest[{8 * k + 1}:{8 * k + 8}] as ubigint) as bigint) as h{k + 1}" for k in range(4))
    plain = " or ".join(f"contains(text, '{m}')" for m in (infill.PREFIX, infill.SUFFIX, infill.MIDDLE))
    part = lambda a, b: f"array_to_string(t[{a} + 1:{b}], '')"
    return f"""
with rows as (
  select doc_id, coalesce(text, '') as text, sha256('{seed}:' || coalesce(cast(doc_id as varchar), '')) as digest,
    regexp_extract_all(coalesce(text, ''), '[{infill.SPACE}]*[^{infill.SPACE}]+|[{infill.SPACE}]+') as t from documents),
cut as (select doc_id, text, t, cast(len(t) as bigint) as n, {hashes} from rows),
placed as (
  select *, least(h1 % (n + 1), h2 % (n + 1)) as one, greatest(h1 % (n + 1), h2 % (n + 1)) as two,
    case when text = '' or {plain} or h3 % 100 >= {rate} then 'plain' when h4 % 100 < {spm_rate} then 'spm' else 'psm' end as form from cut),
parts as (select *, {part("0", "one")} as p, {part("one", "two")} as m, {part("two", "n")} as s from placed)
select doc_id, n, form, case when form <> 'plain' then length(p) end as prefix_chars, case when form <> 'plain' then length(m) end as middle_chars,
  sha256(case form when 'plain' then text when 'psm' then '<P>' || p || '<S>' || s || '<M>' || m else '<S>' || s || '<P>' || p || '<M>' || m end) as output_sha256,
  sha256(text) as restored_sha256
from parts
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_licenses": licenses_sql(), "op2_chat": CHAT_SQL, "op4_topk": TOPK_SQL, "op10_mix": mix_sql(), "op12_variants": variants_sql(), "op13_infill": infill_sql()}
