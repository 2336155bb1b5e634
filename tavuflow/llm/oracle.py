"""DuckDB statements that give the same rows as the queries."""

from __future__ import annotations

from tavuflow.llm.bytebpe import _byte_names, vocabulary_path
from tavuflow.llm.langnames import NAMES
from tavuflow.llm.lookalike import ALIKE
from tavuflow.llm.quality import TERMINAL
from tavuflow.plans.tokens import SQL_SPACE as _TRIM

TERMINAL_SQL = TERMINAL.replace("'", "''")
_SPACES = r"[\x09-\x0d\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"

_TERMS = rf"""
with recs as (
  select 'text' as scope, article_id as rec, list_filter(regexp_split_to_array(Cleaned_Text, '{_SPACES}'), lambda x: x <> '') as terms
  from articles where Cleaned_Text is not null
  union all
  select strategy, line_id, first(tokens order by tokenized_at) from tokenized where tokens is not null group by strategy, line_id),
sizes as (select scope, count(*) as scope_records from recs group by scope),
flat as (select scope, rec, unnest(terms) as term from recs),
counts as (select scope, term, sum(c)::bigint as n, count(*) as records
           from (select scope, term, rec, count(*) as c from flat where term is not null group by all) group by all),
marked as (select scope, term, n, records, case when records <= 2 then 'rare' when records * 10 >= scope_records then 'common' end as mark
           from counts join sizes using (scope))
"""


def form(column: str) -> str:
    """The consistent form in SQL, for the characters of the project's tables: widths by translation, ligatures by replacement,
    invisible characters by a pattern, look-alikes by translation, then composition."""
    wide, narrow = "".join(chr(c) for c in range(0xFF01, 0xFF5F)), "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F))
    spaces = "".join(map(chr, [0xA0, 0x1680, *range(0x2000, 0x200B), 0x202F, 0x205F, 0x3000]))
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    out = rf"regexp_replace({column}, '[\p{{Cf}}\x{{34f}}\x{{fe00}}-\x{{fe0f}}]', '', 'g')"
    for ligature, letters in (("ﬀ", "ff"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬃ", "ffi"), ("ﬄ", "ffl")):
        out = f"replace({out}, '{ligature}', '{letters}')"
    pairs = [(wide + spaces, narrow + " " * len(spaces)), *ALIKE.items()]
    for before, after in pairs:
        out = f"translate({out}, {quote(before)}, {quote(after)})"
    return f"nfc_normalize({out})"


_P3 = f"""
with g as (select entry_id, word, {form('word')} as form from gazetteer where word is not null),
t as (select token_id, word, {form('word')} as form from ner_tokens where word is not null),
a as (select article_id, Cleaned_Text as text, md5({form('Cleaned_Text')}) as form from articles where Cleaned_Text is not null)
select distinct 'word' as kind, token_id as id_a, entry_id as id_b from t join g using (form) where t.word <> g.word
union all select 'text', x.article_id, y.article_id from a x join a y on x.form = y.form and x.article_id < y.article_id and x.text <> y.text
"""

_P6 = f"""
with recursive w as (select article_id, list_filter(regexp_split_to_array(lower({form('Cleaned_Text')}), '{_SPACES}'), lambda x: x <> '') as ws from articles where Cleaned_Text is not null),
s as (select article_id, list_distinct(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) as sh from w where len(ws) >= 20),
e as (select article_id, len(sh) as n, unnest(sh) as k from s),
met as (select x.article_id as a, y.article_id as b, x.n as na, y.n as nb, count(*) as c from e x join e y on x.k = y.k and x.article_id < y.article_id group by all),
near as (select a, b from met where c * 2 >= na + nb - c)
"""

_P6_GROUPS = (
    _P6
    + """
, ways as (select a, b from near union all select b, a from near),
names as (select article_id as id, article_id as least from s union select r.id, b.b from names r join ways b on b.a = r.least),
groups as (select id, min(least) as least from names group by id),
text as (select article_id, array_to_string(ws, ' ') as t from w where len(ws) >= 20),
degree as (select x.article_id as id, count(distinct y.t) as n from ways join text x on x.article_id = a join text y on y.article_id = b where x.t <> y.t group by all)
select g.id as article_id, g.least as group_id, coalesce(n, 0) as n_links from groups g left join degree d on d.id = g.id"""
)

_LINES = rf"""
with f as (select article_id, lower(replace({form('Cleaned_Text')}, 'İ', 'i̇')) as x from articles),
l as (select article_id, unnest(str_split(x, chr(10))) as line from f),
q as (select article_id, line, regexp_extract_all(line, '[\p{{L}}\p{{M}}]+') as ws, regexp_replace(line, '[{_SPACES[1:-2]}]+$', '') as trimmed from l where regexp_matches(line, '[^{_SPACES[1:-2]}]')),
c as (select article_id, sum(length(line))::bigint as n_chars, count(*) as n_lines, sum(len(ws))::bigint as n_words, sum(list_sum(list_transform(ws, lambda w: length(w)))) as letters,
        sum(length(regexp_replace(line, '[^\p{{Nd}}]', '', 'g'))) as digits, count(*) filter (where contains('{TERMINAL_SQL}', right(trimmed, 1))) as ends from q group by article_id),
t as (select article_id, regexp_replace(Title, '^{_TRIM}|{_TRIM}$', '', 'g') as t, regexp_replace(Cleaned_Text, '^{_TRIM}|{_TRIM}$', '', 'g') as x from articles)
select a.article_id, coalesce(n_chars, 0) as n_chars, coalesce(n_lines, 0) as n_lines, coalesce(n_words, 0) as n_words, round(coalesce(letters, 0) / greatest(coalesce(n_words, 0), 1), 6) as mean_word_length,
  round(coalesce(digits, 0) / greatest(coalesce(n_chars, 0), 1), 6) as digit_ratio, round(coalesce(ends, 0) / greatest(coalesce(n_lines, 0), 1), 6) as ending_share,
  coalesce(len(list_filter(regexp_split_to_array(t, '{_TRIM}'), lambda w: w <> '')), 0) as title_words, coalesce(length(t), 0) as title_chars,
  coalesce(t <> '' and starts_with(x, t), false) as title_first, coalesce(t <> '' and contains(x, t), false) as title_in_text
from articles a left join c using (article_id) join t using (article_id)
"""



def _encoded(rows: str) -> str:
    """Common table expressions: pieces (key, place, p) of rows (key, t), and encoded (p, ids) of the distinct pieces, by byte-pair
    merges in a recursive statement: a symbol stands between two marks, so that a pair is merged by replacing a string."""
    space = _SPACES[1:-2]
    names = ", ".join("'" + n.replace("'", "''") + "'" for n, _ in sorted(_byte_names().items(), key=lambda x: x[1]))
    # White space before a word keeps its last character apart; the pattern itself looks ahead at nothing.
    pattern = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{space}\p{{L}}\p{{N}}\x03]+|[{space}]+".replace("'", "''")
    return rf"""
recursive model as (select json_extract(content, '$.model') as m from read_text('{vocabulary_path()}')),
merges as (select unnest(range(len(ms))) as rank, unnest(ms) as pair from (select from_json(json_extract(m, '$.merges'), '[["VARCHAR"]]') as ms from model)),
vocab as (select v.key as name, v.value as id from (select unnest(map_entries(from_json(json_extract(m, '$.vocab'), '"MAP(VARCHAR, INTEGER)"'))) as v from model)),
rows_ as ({rows}),
split as (select key, regexp_extract_all(regexp_replace(t, '([{space}]+)([{space}][^{space}])', '\1' || chr(3) || '\2', 'g'), '{pattern}') as ps from rows_ where t is not null),
pieces as (select key, unnest(range(len(ps))) as place, unnest(ps) as p from split),
begun as (select p, array_to_string(list_transform(regexp_extract_all(hex(encode(p)), '..'), lambda h: chr(1) || ([{names}])[('0x' || h)::int + 1] || chr(2)), '') as s from (select distinct p from pieces)),
steps as (select p, s, 0 as n from begun union all
  select p, replace(s, chr(1) || pair[1] || chr(2) || chr(1) || pair[2] || chr(2), chr(1) || pair[1] || pair[2] || chr(2)), n + 1 from (
    select p, s, n, min_by(merges.pair, merges.rank) as pair
    from (select p, s, n, unnest(list_transform(list_zip(y[:-2], y[2:]), lambda z: [z[1], z[2]])) as pair from (select p, s, n, regexp_extract_all(s, chr(1) || '([^' || chr(2) || ']*)' || chr(2), 1) as y from steps) where len(y) > 1) x
    join merges on merges.pair = x.pair group by p, s, n)),
ended as (select p, regexp_extract_all(arg_max(s, n), chr(1) || '([^' || chr(2) || ']*)' || chr(2), 1) as y from steps group by p),
encoded as (select p, list(id order by i) as ids from (select p, unnest(range(len(y))) as i, unnest(y) as name from ended) join vocab using (name) group by p)"""


_LANGUAGE = f"(map {{{', '.join(f'{chr(39)}{k}{chr(39)}: {chr(39)}{code}{chr(39)}' for code, name in NAMES.items() for k in (code, name))}}})[lower(regexp_replace(lang, '^{_SPACES}|{_SPACES}$', '', 'g'))]"
_P8 = f"""with {_encoded('select doc_id as key, text as t from documents')},
found as (select key, flatten(list(ids order by place)) as ids from pieces join encoded using (p) group by key)
select doc_id, coalesce(ids, []) as ids from documents left join found on key = doc_id
"""
_P7 = f"""with {_encoded('select article_id as key, Cleaned_Text as t from articles')},
found as (select key, sum(len(ids)) as n from pieces join encoded using (p) group by key),
counted as (select article_id, source, {_LANGUAGE} as language, topic, coalesce(n, 0)::bigint as n from articles left join found on key = article_id)
select 'document' as level, article_id, source, language, topic, 1::bigint as documents, n as tokens from counted
union all select 'source', null, source, null, null, count(*), sum(n)::bigint from counted group by source
union all select 'language', null, null, language, null, count(*), sum(n)::bigint from counted group by language
union all select 'topic', null, null, null, topic, count(*), sum(n)::bigint from counted group by topic
union all select 'all', null, source, language, topic, count(*), sum(n)::bigint from counted group by source, language, topic
"""

SQL = {
    "p7_token_budget": _P7,
    "p8_ids": _P8,
    "p3_found": _P3,
    "p5_found": _TERMS + "select scope, term, mark from marked where mark is not null",
    "p5_term_counts": _TERMS + "select scope, term, n, records, mark from marked",
    "p6_found": _P6 + " select a as article_id_a, b as article_id_b from near",
    "p6_groups": _P6_GROUPS,
    "p1_text_counts": _LINES,
    "p3_text_classes": f"""with a as (select article_id, Cleaned_Text as t, {form('Cleaned_Text')} as f from articles where Cleaned_Text is not null),
        g as (select f, min(article_id) as class_id, count(distinct t) as spellings from a group by f) select article_id, class_id, spellings from a join g using (f)""",
    "p3_consistent_text": f"select article_id, {form('Cleaned_Text')} as consistent from articles",
    "p3_consistent_words": f"select distinct token_id, word, {form('word')} as consistent from ner_tokens",
}
