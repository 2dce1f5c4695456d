"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations

_CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _lower(text: str) -> str:
    return f"translate({text}, '{_CAPITALS}', '{_CAPITALS.lower()}')"


#: CRC-32 of a word: the table of the reflected polynomial from its rule, then byte by byte over the UTF-8 bytes.
_CRC = """
steps as (
  select 0 as k, i, i::bigint as c from range(256) t(i)
  union all
  select k + 1, i, case when c % 2 = 1 then xor(c >> 1, 3988292384) else c >> 1 end from steps where k < 8),
crcs as (select list(c order by i) as t from steps where k = 8),
codes as (
  select word, xor(4294967295, list_reduce(
    list_prepend(4294967295::bigint, list_transform(range(strlen(word)), lambda i: ('0x' || substr(hex(word), 2 * i + 1, 2))::bigint)),
    lambda c, b: xor(c >> 8, t[xor(c, b) % 256 + 1]))) % 10000 as bucket
  from (select distinct word from words), crcs)"""

OP11 = rf"""
with recursive
docs as (select row_number() over () as r, doc_id, regexp_extract_all({_lower("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as cut from documents),
target as (select regexp_extract_all({_lower("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as cut from benchmark),
doc_words as (select r, unnest(cut) as word from docs),
target_words as (select unnest(cut) as word from target),
words as (select word from doc_words union select word from target_words),
{_CRC},
source_hist as (select bucket, count(*) as s from doc_words join codes using (word) group by bucket),
target_hist as (select bucket, count(*) as t from target_words join codes using (word) group by bucket),
sums as (select (select coalesce(sum(s), 0) from source_hist)::double as s_all, (select coalesce(sum(t), 0) from target_hist)::double as t_all),
gains as (
  select bucket, floor(1000 * ln((coalesce(t, 0) + 1)::double * (s_all + 10000) / ((s + 1)::double * (t_all + 10000))))::bigint as gain
  from source_hist left join target_hist using (bucket), sums),
weights as (select r, sum(gain) as weight from doc_words join codes using (word) join gains using (bucket) group by r),
scored as (
  select r, doc_id, len(cut)::bigint as n_features, coalesce(weight, 0)::bigint as weight,
    coalesce(weight, 0)::bigint + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || coalesce(doc_id::varchar, '')), 1, 8))::bigint + 0.5::double) / 4294967296)))::bigint as score
  from docs left join weights using (r)),
placed as (select r, row_number() over (order by score desc, doc_id nulls last, r) as place from scored where n_features >= 20)
select doc_id, n_features, weight, score,
  case when place <= (select count(*) from placed) * 10 // 100 then place end::bigint as rank
from scored left join placed using (r)
"""

OP13 = rf"""
with
docs as (select row_number() over () as r, coalesce(lang, '') as lang, coalesce(source, '') as source, coalesce(text, '') as text from documents),
words as (select r, lang, source, unnest(regexp_extract_all({_lower("text")}, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) as term from docs),
kept as (select lang, term, count(*)::hugeint as lang_n from words group by lang, term having count(distinct r) >= 30),
counts as (select lang, source, term, count(*)::hugeint as n from words semi join kept using (lang, term) group by lang, source, term),
groups as (select distinct lang, source from docs),
langs as (select lang, count(*)::hugeint as v, sum(lang_n)::hugeint as lang_total from kept group by lang),
totals as (select lang, source, sum(n)::hugeint as total from counts group by lang, source),
shares as (
  select g.lang, g.source, k.term, coalesce(n, 0) as n,
    1 + 1000000000::hugeint * (coalesce(n, 0) + 5) // (coalesce(total, 0) + 5 * v) as p,
    1 + 1000000000::hugeint * (lang_n + 5) // (lang_total + 5 * v) as q
  from groups g join kept k using (lang) join langs using (lang) left join totals using (lang, source)
  left join counts c on c.lang = g.lang and c.source = g.source and c.term = k.term),
apart as (
  select a.lang, a.source, b.source as item, sum(abs(a.p - b.p)) as value
  from shares a join shares b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all),
pairs as (
  select a.lang, a.source, b.source as item, coalesce(value, 0)::bigint as value
  from groups a join groups b on a.lang = b.lang and a.source <> b.source
  left join apart on apart.lang = a.lang and apart.source = a.source and apart.item = b.source),
parts as (
  select lang, source, 'pair' as part, item, value from pairs
  union all
  select lang, source, 'term', term, (p - q)::bigint from shares where n > 0 and p > q),
ranked as (select *, row_number() over (partition by lang, source, part order by value desc, item)::integer as rank from parts)
select * from ranked where part = 'pair' or rank <= 50
"""

ORACLE_SQL: dict[str, str] = {"op11_importance_resampling": OP11, "op13_source_divergence": OP13}
