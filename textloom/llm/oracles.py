"""SQL for those queries of this subpackage that SQL can say: by plain counting and joining, not by the operators' methods."""

from __future__ import annotations

# Words of texts and of items, joined on every word; the matches of a shift are judged together.
OP1 = r"""with d as (select doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') as w from documents where doc_id is not null),
b as (select item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') as w from benchmark where item_id is not null),
dw as (select doc_id, len(w) as doc_words, unnest(w) as word, unnest(range(len(w))) as at from d), bw as (select item_id, len(w) as item_words, unnest(w) as word, unnest(range(len(w))) as i from b),
m as (select doc_id, item_id, dw.at - bw.i as shift, any_value(doc_words) as doc_words, any_value(item_words) as item_words, count(*) as matched, list(i order by i) as hits from dw join bw using (word) group by all having count(*) >= least(16, any_value(item_words) * 0.8)),
n as (select *, least(item_words, doc_words - shift) - greatest(-shift, 0) as n, list_max(list_transform(hits, lambda s: len(list_filter(hits, lambda x: x >= s and x < s + 20)))) as best from m),
k as (select * from n where (n >= 20 and best >= 16) or (item_words < 20 and n = item_words and case when item_words < 10 then matched = item_words else matched * 20 >= item_words * 16 end))
select doc_id, item_id, arg_max(shift, (matched, -shift))::bigint as shift, max(matched) as matched, any_value(item_words)::bigint as item_words from k group by doc_id, item_id"""

_PATTERNS = {
    "assign": r"""(?i)(password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)""",
    "access": "AKIA[A-Z0-9]{14,}",
    "hex": "[0-9a-f]{16,}",
    "token": "[A-Za-z0-9+/_=-]{20,}",
    "endpoint": r"""https?://[^\s"''<>]{4,}""",
}


def _found(kind: str) -> str:
    """r, no, kind, s, e of a kind's matches that count; places come from the lengths of matches and of what stands between."""
    p = _PATTERNS[kind]
    good = {"assign": f"list_transform(regexp_extract_all(t, '{p}', 2), lambda x: length(x) >= 12)", "token": "list_transform(m, lambda x: regexp_matches(x, '[0-9]') and regexp_matches(x, '[A-Za-z]'))"}
    split = f"select r, t, regexp_extract_all(t, '{p}') as m, string_split_regex(t, '{p}') as gaps from d"
    each = f"select r, m, gaps, {good.get(kind, 'list_transform(m, lambda x: true)')} as good, unnest(range(1, len(m) + 1)) as i from ({split})"
    ends = f"select r, m, good, i, list_sum(list_transform(gaps[1:i], lambda x: length(x))) + list_sum(list_transform(m[1:i], lambda x: length(x))) as e from ({each})"
    return f"select r, {list(_PATTERNS).index(kind)} as no, '{kind}' as kind, e - length(m[i]) as s, e from ({ends}) where good[i]"


# Every pair of finds in a text is looked at.
OP5 = f"""with d as (select row_number() over () as r, doc_id, coalesce(text, '') as t from documents),
p as ({' union all '.join(map(_found, _PATTERNS))}),
n as (select w.r, w.no, w.kind, w.s, w.e, bool_or(q.kind = 'access') as access, bool_or(q.kind = 'assign') as assign, bool_or(q.kind = 'endpoint') as endpoint, bool_or(q.no < 3 and q.s < w.e and q.e > w.s) as touches
from p w join p q on w.r = q.r and w.no >= 3 and q.kind <> 'token' and q.s <= w.e + 256 and q.e >= w.s - 256 group by all),
a as (select r, no, kind, s, e from p where no < 3 union all select r, no, kind, s, e from n where case kind when 'token' then (access or (endpoint and assign)) and not touches else access or assign end),
g as (select r, count(*) filter (no = 0) as n_assign, count(*) filter (no = 1) as n_access, count(*) filter (no = 2) as n_hex, string_agg(kind || ':' || s::bigint || ':' || e::bigint, ',' order by s, no) filter (no < 3) as base, string_agg(kind || ':' || s::bigint || ':' || e::bigint, ',' order by s, no) as spans from a group by r)
select doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex, sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans from d left join g using (r)"""


def _little(number: str) -> str:
    """Hex digits of a 32-bit number, lowest byte first."""
    return " || ".join(f"printf('%02X', (({number}) >> {8 * k}) & 255)" for k in range(4))


# Bytes one by one; texts with media of their own in them, of which the tables have none, would need the validators.
OP6 = f"""select * exclude (c), xor(c, 4294967295) as tail_crc32 from (with r as (select doc_id, encode(coalesce(text, '')) as raw from documents),
p as (select doc_id, raw, octet_length(raw)::bigint as n, (greatest(1, (octet_length(raw) + 191) // 192) * 192)::bigint as m from r),
x as (select doc_id, n, m, hex(raw) || repeat('20', (m - n)::int) as h from p),
v as (select *, list_transform(regexp_extract_all(h, '..'), lambda x: (strpos('0123456789ABCDEF', x[1]) - 1) * 16 + strpos('0123456789ABCDEF', x[2]) - 1) as v from x),
w as (select *, '52494646' || {_little('m + 36')} || '57415645666D7420100000000100010040' || '1F0000401F000001000800' || '64617461' || {_little('m')} || h as wav from v)
select doc_id, n as n_bytes, m as payload_bytes, sha256(unhex(h)) as payload_sha256,
list_reduce(list_concat([4294967295::bigint], v[m - 15:m]), lambda c, b: list_reduce(list_concat([xor(c, b)], range(8)), lambda a, _: xor(a >> 1, 3988292384 * (a & 1)))) as c,
m + 44 as media_bytes, sha256(unhex(wav)) as media_sha256,
'wav;rate=8000;samples=' || m || ';rms=' || printf('%.3f', sqrt(list_sum(list_transform(v, lambda b: (b - 128) * (b - 128))) / m)) || ';crossings=' || len(list_filter(range(2, m + 1), lambda k: (v[k] > 127) <> (v[k - 1] > 127))) || ';embedded=0' as feature from w)"""

# Every string of 400 bytes, by its digest.
OP9 = """with d as (select doc_id, encode(coalesce(text, '')) as b from documents),
p as (select doc_id, b, unnest(range(1, octet_length(b) - 398)) as i from d where octet_length(b) >= 400),
h as (select doc_id, i, md5(b[i:i + 399]) as h from p),
r as (select doc_id, i from h qualify count(*) over (partition by h) > 1),
g as (select doc_id, i, coalesce((i - lag(i) over (partition by doc_id order by i) > 400)::int, 1) as fresh from r),
u as (select doc_id, min(i) as lo, max(i) + 399 as hi from (select *, sum(fresh) over (partition by doc_id order by i) as k from g) group by doc_id, k),
a as (select doc_id, sum(hi - lo + 1)::bigint as n_removed, count(*) as n_spans, list(lo order by lo) as los, list(hi order by lo) as his from u group by doc_id),
k as (select doc_id, octet_length(b)::bigint as n_bytes, coalesce(n_removed, 0)::bigint as n_removed, coalesce(n_spans, 0) as n_spans, hex(b) as x, list_concat([0], coalesce(his, [])) as f, list_append(coalesce(los, []), octet_length(b) + 1) as t from d left join a using (doc_id))
select doc_id, n_bytes, n_removed, n_spans, sha256(unhex(array_to_string(list_transform(range(1, len(f) + 1), lambda j: substr(x, 2 * f[j] + 1, 2 * (t[j] - f[j] - 1))), ''))) as kept_sha256 from k"""

# Every stretch of one to three words of a piece is grouped and counted.
OP13 = r"""with t as (select row_number() over () as r, coalesce(lang, 'und') as lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from documents),
p as (select lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') as w from (select lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) as piece from t)),
n as (select lang, sum(len(w))::bigint as n from p group by lang),
g as (select lang, unnest(list_concat(list_transform(range(1, len(w) + 1), lambda i: w[i:i]), list_transform(range(1, len(w)), lambda i: w[i:i + 1]), list_transform(range(1, len(w) - 1), lambda i: w[i:i + 2]))) as w from p),
f as (select lang, w, count(*) as f from g group by all having count(*) >= 10),
c as (select lang, w, f as a, unnest(range(1, len(w))) as k from f where len(w) > 1),
s as (select c.lang, c.w, a, k, x.f as l, y.f as r, (1000000 * a::hugeint * a) // (x.f::hugeint * y.f) as score from c join f x on x.lang = c.lang and x.w = c.w[1:k] join f y on y.lang = c.lang and y.w = c.w[k + 1:]),
b as (select * from s qualify row_number() over (partition by lang, w order by score, k) = 1),
m as (select lang, w, max(f) as most from (select lang, w[1:2] as w, f from f where len(w) = 3 union all select lang, w[2:3], f from f where len(w) = 3) group by all),
k as (select lang, array_to_string(w, ' ') as phrase, a, l, r, score::bigint as score from b left join m using (lang, w) where most is null or 100 * most < 50 * a)
select lang, row_number() over (partition by lang order by score desc, a desc, phrase) as rank, phrase, a, l, r, n, score from k join n using (lang) qualify rank <= 2000"""

ORACLE_SQL = {"op1_decontamination": OP1, "op5_secret_links": OP5, "op6_media_columns": OP6, "op9_suffix_dedup": OP9, "op13_phrase_collocations": OP13}
