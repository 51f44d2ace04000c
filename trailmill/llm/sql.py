"""DuckDB SQL of the queries that SQL can express, written from their definitions alone."""

from __future__ import annotations

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


#: Sentences of a text for the license scan: wrapped lines put together, then cut at marks before a blank and at line ends.
_WRAPPED = r"""regexp_replace(regexp_replace({}, '\r?\n[ \t]*(//+|[*#;]+|--)?[ \t]*([a-z("]|(Licenses?|General|Lesser|Affero|Public|Foundation|Free Software)\b)', ' \2', 'g'), '([A-Z,)"])[ \t]*\r?\n[ \t]*(//+|[*#;]+|--)?[ \t]*([A-Z][A-Z])', '\1 \3', 'g')"""
_PARTS = "string_split(regexp_replace(regexp_replace(" + _LOWER.format(_WRAPPED.format("coalesce(text, '')")) + r", '[.!?;:]+[ \t]+|[\r\n]+', chr(10), 'g'), '[^a-z0-9.+\n]+', ' ', 'g'), chr(10))"
#: The licenses that phrases in the documents name.
_SAID = """
said(name, license) as (values ('mit', 'MIT'), ('apache license version 2.0', 'Apache-2.0'), ('gnu general public license version 3', 'GPL-3.0-only'), ('cc by nc 4.0', 'CC-BY-NC-4.0'), ('bsd 3 clause', 'BSD-3-Clause'), ('mozilla public license version 2.0', 'MPL-2.0'), ('cc by 4.0', 'CC-BY-4.0')),
parts as (select doc_id, trim(part, ' .') part, pos from (select doc_id, unnest({parts}) part, generate_subscripts({parts}, 1) pos from {docs})),
ids as (select doc_id, pos, case when part = 'all rights reserved' then 'Rights.reserved' else 'Says.' || license end id, license from parts left join said
  on regexp_extract(part, '^(this (project|work|software) is )?(released|licensed|distributed) under (a |the )?(.+?)( licen[sc]e)?$', 5) = name where license is not null or part = 'all rights reserved'),
lists as (select doc_id, count(*) n, string_agg(id, ',' order by pos) sentences, coalesce(string_agg(distinct license, ',' order by license), 'Proprietary') licenses, list(distinct license) filter (license is not null) l from ids group by doc_id)"""

LICENSES = f"""with {_SAID.format(parts=_PARTS, docs="documents")}
select d.doc_id, coalesce(n, 0) n_sentences, coalesce(sentences, '') sentences, coalesce(licenses, '') licenses, '' expressions from documents d left join lists using (doc_id)
"""
#: Which licenses the headers of ``op1_headers`` tell, in their order, written down by hand.
HEADERS_TELL = ("", "MIT", "BSD-3-Clause", "Apache-2.0", "MIT,Apache-2.0", "GPL-2.0-only,BSD-3-Clause", "GPL-2.0-only WITH Linux-syscall-note", "MIT", "LGPL-3.0-only", "GPL-3.0-or-later", "BSD-2-Clause", "Proprietary", "LGPL-2.1-or-later,MIT", "ISC")
LICENSE_HEADERS = f"""with {_SAID.format(parts=_PARTS, docs="documents")},
told(variant, names) as (values {', '.join(f"({k}, {[x for x in names.split(',') if x and x != 'Proprietary']}::varchar[])" for k, names in enumerate(HEADERS_TELL))}),
joined as (select d.doc_id, variant, list_sort(list_distinct(list_concat(names, coalesce(l, []::varchar[])))) names, n is not null and l is null or variant = 11 reserved
  from documents d join told on variant = doc_id % 14 left join lists using (doc_id))
select doc_id, cast(variant as bigint) variant, case when len(names) = 0 and reserved then 'Proprietary' else array_to_string(names, ',') end licenses from joined
"""


_WORDS = "list_filter(regexp_split_to_array({}, '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"

DECONTAMINATION = f"""
with d as (select doc_id, {_WORDS.format(_LOWER.format("coalesce(text, '')"))} w from documents),
i as (select cast(item_id as varchar) item, {_WORDS.format(_LOWER.format("coalesce(text, '')"))} w from benchmark),
sizes as (select distinct least(10, len(w)) n from i where len(w) > 0),
windows as (select distinct item, n, list_slice(w, s, s + n - 1) g from (select item, w, least(10, len(w)) n, unnest(range(1, len(w) - least(10, len(w)) + 2)) s from i where len(w) > 0)),
places as (select doc_id, n, s, list_slice(w, s, s + n - 1) g from (select doc_id, w, n, unnest(range(1, greatest(len(w) - n + 2, 1))) s from d, sizes)),
found as (select distinct doc_id, item, p.n, s from places p join windows using (n, g)),
hits as (select doc_id, count(distinct s + o) n_hit from (select doc_id, s, unnest(range(n)) o from found) group by doc_id),
items as (select doc_id, count(*) n_items, string_agg(item, ',' order by item) items from (select distinct doc_id, item from found) group by doc_id)
select d.doc_id, cast(len(w) as bigint) n_words, coalesce(n_hit, 0) n_hit, coalesce(n_items, 0) n_items, sha256(coalesce(items, '')) items_sha256, coalesce(n_hit, 0) > 0 contaminated
from d left join hits using (doc_id) left join items using (doc_id)
"""

PROXIMITY = f"""
with d as (select doc_id, {_WORDS.format(_LOWER.format("coalesce(text, '')"))} w from documents),
i as (select cast(item_id as varchar) item_id, list_distinct({_WORDS.format(_LOWER.format("coalesce(text, '')"))}) w from benchmark),
sought as (select item_id, unnest(w) word, len(w) k from i where len(w) <= 60),
flat as (select doc_id, unnest(w) word, generate_subscripts(w, 1) - 1 p from d),
met as (select doc_id, item_id, k, p, word from flat join sought using (word)),
enough as (select doc_id, item_id from met group by all having count(distinct word) = any_value(k)),
next as (select *, count(distinct word) over (partition by doc_id, item_id order by p range between current row and 59 following) c from met semi join enough using (doc_id, item_id)),
firsts as (select doc_id, item_id, min(p) first_word from next where c = k group by all),
lasts as (select doc_id, item_id, first_word, word, min(p) p from firsts join met using (doc_id, item_id) where p between first_word and first_word + 59 group by all)
select doc_id, item_id, first_word, max(p) last_word from lasts group by all
"""

SUBSTRING_DEDUP = """
with d as (select doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') w from documents),
windows as (select doc_id, s, list_slice(w, s, s + 19) g from (select doc_id, w, unnest(range(1, len(w) - 18)) s from d where len(w) >= 20)),
ranked as (select doc_id, s, row_number() over (partition by g order by doc_id, s) k from windows),
gone as (select distinct doc_id, s + o p from (select doc_id, s, unnest(range(20)) o from ranked where k > 1)),
words as (select doc_id, unnest(w) word, generate_subscripts(w, 1) p from d),
kept as (select doc_id, string_agg(word, ' ' order by p) t from words anti join gone using (doc_id, p) group by doc_id),
lost as (select doc_id, count(*) n from gone group by doc_id)
select d.doc_id, cast(len(w) as bigint) n_words, coalesce(n, 0) n_removed, sha256(coalesce(t, '')) kept_sha256 from d left join kept using (doc_id) left join lost using (doc_id)
"""

LINE_DEDUP = f"""
with d as (select doc_id, string_split(coalesce(text, ''), chr(10)) l from documents),
lines as (select doc_id, unnest(l) line, generate_subscripts(l, 1) p from d),
keyed as (select *, {_LOWER.format("trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))")} k from lines),
common as (select k, max(doc_id) keeper from keyed where length(k) >= 20 group by k having count(distinct doc_id) >= 3),
marked as (select doc_id, line, p, keeper is not null and keeper <> doc_id gone from keyed left join common using (k))
select doc_id, count(*) n_lines, count(*) filter (gone) n_dropped, sha256(coalesce(string_agg(line, chr(10) order by p) filter (not gone), '')) kept_sha256 from marked group by doc_id
"""

CHAT = """
with t as (select conv_id, row_number() over (partition by conv_id order by turn nulls first, role nulls first, text nulls first) n,
  '<|im_start|>' || coalesce(role, '') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10) line from conversations where conv_id is not null),
p as (select conv_id, n, string_agg(line, '') over (partition by conv_id order by n) so_far, count(*) over (partition by conv_id) size from t),
whole as (select n n_turns, so_far, min(conv_id) conv_id, count(*) n_copies from p where n = size group by all),
begun as (select distinct n n_turns, so_far from p where n < size)
select conv_id, n_turns, n_copies, cast(octet_length(encode(so_far)) as bigint) n_bytes, sha256(so_far) rendered_sha256 from whole anti join begun using (n_turns, so_far)
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_licenses": LICENSES, "op1_headers": LICENSE_HEADERS, "op3_decontamination": DECONTAMINATION, "op3_proximity": PROXIMITY, "op5_substring_dedup": SUBSTRING_DEDUP, "op8_line_dedup": LINE_DEDUP, "op9_chat": CHAT}
