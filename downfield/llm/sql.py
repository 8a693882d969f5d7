"""DuckDB SQL for the registered queries that SQL can express on whole tables."""

from __future__ import annotations

SQL: dict[str, str] = {}

SQL["op1_decontamination"] = r"""
with item as (
  select item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') w from benchmark),
doc as (
  select row_number() over () r, doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+'), []) w from documents),
iw as (
  select item_id, least(len(w), 10) n, array_to_string(w[k:k + least(len(w), 10) - 1], ' ') key
  from (select item_id, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) k from item where len(w) > 0)),
lens as (select distinct n from iw),
dw as (
  select r, k, n, array_to_string(w[k:k + n - 1], ' ') key
  from (select r, w, n, unnest(range(1, len(w) - n + 2)) k from doc, lens where len(w) >= n)),
hit as (select r, k, n, item_id from dw join iw using (n, key)),
places as (select r, count(distinct p) n_hit from (select r, unnest(range(k, k + n)) p from hit) group by r),
items as (select r, count(distinct item_id) n_items, string_agg(distinct item_id::varchar, ',' order by item_id::varchar) ids from hit group by r)
select doc_id, len(w) n_words, coalesce(n_hit, 0) n_hit, coalesce(n_items, 0) n_items, sha256(coalesce(ids, '')) items_sha256, coalesce(n_hit, 0) > 0 contaminated
from doc left join places using (r) left join items using (r)
"""

#: kind -> pattern, the group whose length counts, the least length; as the secret scan has them.
_SECRETS = {
    "assign": (r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)""", 1, 8),
    "access": (r"AKIA[A-Z0-9]+", 0, 16),
    "hex": (r"[0-9a-f]+", 0, 32),
    "private_key": (r"-----BEGIN (?:[A-Z0-9]{1,20} ){0,3}PRIVATE KEY-----", 0, 0),
    "jwt": (r"eyJ[A-Za-z0-9_-]{8,1000}\.[A-Za-z0-9_-]{8,1000}\.[A-Za-z0-9_-]{8,1000}", 0, 0),
    "vendor_token": (r"(?:gh[pousr]_[A-Za-z0-9]{36}|xox[abprs]-[A-Za-z0-9-]{10,72}|sk_live_[0-9A-Za-z]{24}|AIza[0-9A-Za-z_-]{35})", 0, 0),
    "url_password": (r"[a-z][a-z0-9+.-]{1,15}://[^\s:/@]{1,64}:([^\s:/@]{3,64})@", 0, 0),
}


def _secret_spans(rank: int, kind: str) -> str:
    pattern, group, least = _SECRETS[kind]
    return f"""select r, {rank} rank, '{kind}' kind, s, s + length(v) e from (
      select r, v, g, list_sum(list_transform(p[:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[:i - 1], lambda x: length(x))), 0) s
      from (select r, p, m, unnest(m) v, unnest(g) g, unnest(range(1, len(m) + 1)) i from (
        select r, string_split_regex(text, '{pattern}') p, regexp_extract_all(text, '{pattern}') m, regexp_extract_all(text, '{pattern}', {group}) g from doc)))
      where length(g) >= {least}"""


SQL["op3_secret_scans"] = f"""
with doc as (select row_number() over () r, doc_id, coalesce(text, '') as text from documents),
span as ({" union all ".join(_secret_spans(i, k) for i, k in enumerate(_SECRETS))}),
found as (select r, count(*) filter (kind = 'assign') n_assign, count(*) filter (kind = 'access') n_access, count(*) filter (kind = 'hex') n_hex,
  string_agg(concat(kind, ':', s, ':', e), ',' order by s, rank) filter (rank < 3) base, string_agg(concat(kind, ':', s, ':', e), ',' order by s, rank) spans from span group by r)
select doc_id, coalesce(n_assign, 0) n_assign, coalesce(n_access, 0) n_access, coalesce(n_hex, 0) n_hex, sha256(coalesce(base, '')) base_sha256, coalesce(spans, '') spans
from doc left join found using (r)
"""

SQL["op7_ngram_join"] = r"""
with recursive doc as (
  select row_number() over () r, doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) w from documents),
shingle as (
  select distinct r, array_to_string(w[k:k + 4], ' ') || chr(10) || least(len(w), 5) g
  from (select r, w, unnest(range(1, greatest(len(w) - 5, 0) + 2)) k from doc where len(w) > 0)),
size as (select r, count(*) n from shingle group by r),
link as (
  select a, b from (select x.r a, y.r b, count(*) c from shingle x join shingle y using (g) where x.r <> y.r group by all)
  join size s on s.r = a join size t on t.r = b where 100 * c >= 75 * (s.n + t.n - c)),
reach as (select r a, r b from doc union select reach.a, link.b from reach join link on reach.b = link.a)
select any_value(d.doc_id) doc_id, any_value(coalesce(n, 0)) n_shingles, min(o.doc_id) component_id
from reach join doc d on d.r = a join doc o on o.r = b left join size s on s.r = a group by a
"""

#: rule -> (condition of failure, limit of a host's shrunk rate), as the operator has them.
_RULES = {
    "base": ("base_failed", 0.5),
    "symbols": ("n_words > 0 and n_symbols > n_words", 0.8),
    "lines": ("n_lines > 0 and 2 * n_dup_lines > n_lines", 0.8),
    "length": ("n_words > 0 and (word_chars < 2 * n_words or word_chars > 20 * n_words)", 0.8),
}
#: Correlation within hosts by the moments of the beta-binomial, null where they say nothing.
_ALIKE = "case when room > 1e-9 and sum_{0} > 0 and sum_{0} < total then ((between_{0} - sum_{0} * (sum_{0} / total)) / ((sum_{0} / total) * (1 - sum_{0} / total)) - (h - 1)) / room end"
_RATE = "case when a_{0} > 0 then (f_{0} + sum_{0} / total * greatest((1 - a_{0}) / a_{0}, 0)) / (n + greatest((1 - a_{0}) / a_{0}, 0)) else sum_{0} / total end"

SQL["op9_quality_rules"] = rf"""
with doc as (select row_number() over () r, doc_id, source, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') w from documents),
win as (select r, k, array_to_string(w[k:k + 4], ' ') g from (select r, w, unnest(range(1, len(w) - 3)) k from doc where len(w) >= 5)),
again as (select r, count(distinct p) n from (select r, unnest(range(k, k + 5)) p from (select r, k, count(*) over (partition by r, g) c from win) where c > 1) group by r),
line as (select r, count(*) n, count(distinct l) d from (select r, unnest(string_split(text, chr(10))) l from doc) where regexp_matches(l, '[^\x20\x09-\x0D]') group by r),
counts as (
  select r, doc_id, source, len(w) n_words, length(array_to_string(w, '')) word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) n_symbols,
    coalesce(line.n, 0) n_lines, coalesce(line.n - line.d, 0) n_dup_lines, coalesce(again.n, 0) n_repeat_words
  from doc left join line using (r) left join again using (r)),
measured as (select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words base_failed from counts),
host as (select source, count(*) n, {", ".join(f"sum(({c})::int) f_{k}" for k, (c, _) in _RULES.items())} from measured group by source),
moment as (select count(*) h, sum(n)::double total, sum(n) - sum(n::double * n) / sum(n) - (count(*) - 1) room, {", ".join(f"sum(f_{k})::double sum_{k}, sum(f_{k}::double * f_{k} / n) between_{k}" for k in _RULES)} from host),
prior as (select *, {", ".join(f"{_ALIKE.format(k)} a_{k}" for k in _RULES)} from moment),
verdict as (select source s, ({" or ".join(f"{_RATE.format(k)} > {limit}" for k, (_, limit) in _RULES.items())}) rejected from host, prior)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and not rejected kept
from measured join verdict on source is not distinct from s
"""
