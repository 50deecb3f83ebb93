"""Plain SQL for the queries of ``queries.py``, written for DuckDB over the same tables.

The SQL states what each query means without using the package: it is the other side of the
correctness check.
"""

from __future__ import annotations

import re

# Fixed values shared with the text functions: white space that trimming removes.
_W = r"[\s\x0b\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def _normalise(x: str) -> str:
    line = rf"regexp_replace(l, '\A{_W}+|{_W}+\z', '', 'g')"
    lines = f"string_split(replace({x}, chr(13), ''), chr(10))"
    return (
        f"array_to_string(list_filter(list_transform({lines}, lambda l: {line}),"
        " lambda l: l <> ''), chr(10))"
    )


def _decode(x: str) -> str:
    for entity, char in (
        ("&lt;", "'<'"), ("&gt;", "'>'"), ("&quot;", "'\"'"), ("&#39;", "chr(39)"),
        ("&nbsp;", "chr(160)"), ("&middot;", "'·'"), ("&copy;", "'©'"), ("&amp;", "'&'"),
    ):
        x = f"replace({x}, '{entity}', {char})"
    return x


def _markup(x: str) -> str:
    x = f"regexp_replace({x}, '(?s)<!--.*?-->', '', 'g')"
    x = rf"regexp_replace({x}, '(?is)<script(?:\s[^>]*)?>.*?</script\s*>', '', 'g')"
    return rf"regexp_replace({x}, '(?is)<style(?:\s[^>]*)?>.*?</style\s*>', '', 'g')"


def _clean(x: str) -> str:
    return _decode(_normalise(f"regexp_replace({x}, '(?s)<[^>]*>', '', 'g')"))


def _body(x: str) -> str:
    """Inside of the body element; no body, no text."""
    inner = rf"regexp_replace({_markup(x)}, '(?is)\A.*?<body(?:\s[^>]*)?>', '')"
    inner = rf"regexp_replace({inner}, '(?is)\A(.*)</body\s*>.*\z', '\1')"
    return rf"CASE WHEN regexp_matches({x}, '(?is)<body(?:\s[^>]*)?>') THEN {inner} END"


def _texts(x: str, tag: str) -> str:
    found = rf"regexp_extract_all({_markup(x)}, '(?is)<{tag}(?:\s[^>]*)?>(.*?)</{tag}\s*>', 1)"
    return f"list_transform({found}, lambda t: {_clean('t')})"


def _attr(x: str, tag: str, attr: str) -> str:
    opening = rf"regexp_extract({_markup(x)}, '(?is)<{tag}(?:\s[^>]*)?>', 0)"
    return _decode(
        rf"""nullif(regexp_extract({opening}, '(?is)\s{attr}\s*=\s*"([^"]*)"', 1), '')"""
    )


def _tokens(x: str) -> str:
    return (
        rf"list_filter(regexp_split_to_array(lower({x}), '[^\p{{L}}\p{{N}}]+'), lambda t: t <> '')"
    )


def _part(x: str, pattern: str) -> str:
    return f"nullif(regexp_extract({x}, '{pattern}', 1), '')"


_HOST = r"^[^:/?#]+://([^/?#:]*)"
_PATH = r"^[^:/?#]+://[^/?#]*([^?#]*)"
_QUERY = r"\?([^#]*)"

_EXT = (
    "CASE doc_id % 4 WHEN 0 THEN 'html' WHEN 1 THEN 'pdf' WHEN 2 THEN 'docx' ELSE 'xlsx' END"
)

_FILES = f"""
labelled AS (SELECT d.*, l.quality, l.toxic FROM documents d LEFT JOIN labels l USING (doc_id)),
filed AS (
  SELECT *, concat('/', source, '/', lang) AS dir, {_EXT} AS ext,
         concat('/', source, '/', lang, '/', doc_id, '.', {_EXT}) AS path FROM labelled),
listing AS (
  SELECT path, dir, ext, doc_id, n_chars + CASE WHEN quality = 0 THEN 1 ELSE 0 END AS version
  FROM filed WHERE coalesce(toxic, 0) = 0),
idx AS (SELECT path, dir, ext, doc_id, n_chars AS version FROM filed WHERE quality IS NOT NULL)"""

_OUTSIDE = """NOT (dir = '/src3' OR starts_with(dir, '/src3/')
              OR dir = '/src1/en' OR starts_with(dir, '/src1/en/'))"""
_TYPES = "(VALUES ('page', 'html'), ('pdf', 'pdf'), ('office', 'docx')) AS t(file_type, ext)"
_DISPATCH = """(VALUES ('page', 'created', 'index_page'), ('page', 'changed', 'index_page'),
  ('page', 'deleted', 'remove'), ('pdf', 'created', 'index_pdf'), ('pdf', 'deleted', 'remove'),
  ('office', 'changed', 'index_office')) AS h(file_type, action, handler)"""

_CLASSIFIED = f"""
classified AS (
  SELECT coalesce(l.path, i.path) AS path, coalesce(l.version, i.version) AS version,
    CASE WHEN l.path IS NULL THEN 'deleted' WHEN i.path IS NULL THEN 'created'
         WHEN l.ext IN ('html', 'pdf', 'docx') AND {_OUTSIDE.replace('dir', 'l.dir')}
              AND l.version <> i.version THEN 'changed' ELSE 'unchanged' END AS action
  FROM listing l FULL OUTER JOIN idx i ON l.path = i.path
  WHERE i.path IS NOT NULL
     OR (l.ext IN ('html', 'pdf', 'docx') AND {_OUTSIDE.replace('dir', 'l.dir')}))"""

# The folders are two levels deep: the rules of the first level, then those of the second.
_ROLES = """
conf(dir, allow, deny) AS (VALUES ('/src1', 'A,B', NULL), ('/src1/en', NULL, 'B'),
  ('/src2', 'C', 'C'), ('/src3/de', 'D, E', 'A')),
top_roles AS (
  SELECT DISTINCT '/' || f.source AS top,
    list_filter(coalesce(string_split(c.allow, ','), ['ROOT', 'A']),
                lambda r: NOT coalesce(list_contains(string_split(c.deny, ','), r), false)) AS roles
  FROM documents f LEFT JOIN conf c ON c.dir = '/' || f.source),
roles AS (
  SELECT DISTINCT f.dir,
    list_filter(coalesce(string_split(c.allow, ','), t.roles),
                lambda r: NOT coalesce(list_contains(string_split(c.deny, ','), r), false)) AS roles
  FROM filed f JOIN top_roles t ON t.top = '/' || f.source LEFT JOIN conf c ON c.dir = f.dir)"""

_DOCS = _FILES + "," + _ROLES + """,
docs AS (
  SELECT f.path, f.dir, f.lang, r.roles, split_part(f.text, chr(10), 1) AS title, f.text AS content,
    CASE WHEN f.ext = 'html' THEN 'Page' ELSE 'Document' END AS doc_type,
    coalesce(f.quality, 1) AS active
  FROM filed f JOIN roles r ON r.dir = f.dir)"""

_CONTENT = """
old_docs AS (SELECT i.path, i.ext, i.version, d.text AS content FROM idx i JOIN documents d USING (doc_id)),
new_docs AS (SELECT l.path, l.ext, l.version, d.text AS content FROM listing l JOIN documents d USING (doc_id))"""

_ACL = """
acl AS (
  SELECT path, 'g' || (doc_id % 5) AS account, doc_id % 4 AS rights,
         CASE WHEN toxic = 1 THEN 'deny' ELSE 'allow' END AS entry_type FROM filed
  UNION ALL
  SELECT path, 'g9', 1, CASE WHEN toxic = 1 THEN 'deny' ELSE 'allow' END FROM filed)"""

_TERMS = f"""
fields AS (
  SELECT path, 'title' AS field, {_tokens("split_part(text, chr(10), 1)")} AS terms FROM filed
  UNION ALL SELECT path, 'content', {_tokens("text")} FROM filed),
terms AS (
  SELECT path AS doc_key, field, unnest(terms) AS term,
         generate_subscripts(terms, 1) - 1 AS pos FROM fields)"""

_POSTINGS = _TERMS + """,
lengths AS (SELECT path AS doc_key, field, len(terms) AS n FROM fields WHERE len(terms) > 0),
postings AS (
  SELECT field, term, doc_key, count(*) AS tf, string_agg(pos, ' ' ORDER BY pos) AS positions
  FROM terms GROUP BY ALL),
stats AS (SELECT field, term, count(*) AS df FROM postings GROUP BY ALL)"""

_CLAUSES = """
clauses(clause_id, field, term, occur, boost) AS (VALUES
  ('c1', 'content', 'the', 'must', 1.0), ('c2', 'content', 'of', 'must', 1.0),
  ('c3', 'content', 'and', 'should', 1.0), ('c4', 'title', 'the', 'should', 2.0))"""

_WEIGHT = """sqrt(p.tf) * power(1 + ln((SELECT count(*) FROM documents)::DOUBLE / (s.df + 1)), 2)
  * c.boost / sqrt(n.n)"""

_SCORED = f"""
scored AS (
  SELECT p.doc_key, round(sum({_WEIGHT}) * count(*) / 4, 6) AS score
  FROM postings p JOIN clauses c USING (field, term) JOIN stats s USING (field, term)
    JOIN lengths n ON n.doc_key = p.doc_key AND n.field = p.field
  GROUP BY p.doc_key HAVING count(*) FILTER (c.occur = 'must') = 2)"""

_RANKING = "WITH " + _FILES + "," + _POSTINGS + "," + _CLAUSES + "," + _SCORED

_EVENTS = """
change_events AS (
  SELECT event_id, ts, CASE user_id % 2 WHEN 0 THEN 'intranet' ELSE 'shop' END AS web,
    concat('/src', user_id % 20, '/', user_id, '.html') AS path,
    CASE event_type WHEN 'signup' THEN 'Created' WHEN 'view' THEN 'Changed' WHEN 'click' THEN 'Changed'
         WHEN 'error' THEN 'Deleted' ELSE 'Other' END AS change_type FROM events),
routed AS (
  SELECT event_id, ts, web, path, 'page' AS file_type,
    CASE web WHEN 'intranet' THEN 'https://intranet.example.com' ELSE 'https://shop.example.com/s' END || path AS url,
    lower(change_type) AS action,
    CASE WHEN change_type = 'Deleted' THEN 'remove' ELSE 'index_page' END AS handler
  FROM change_events WHERE change_type <> 'Other')"""

_FOLDER_EVENTS = """
folder_changes AS (
  SELECT event_id, ts, 'intranet' AS web, concat('/src', user_id % 20,
      ['', '/en', '/fr', '/de', '/es'][event_id % 5 + 1]) AS path,
    CASE event_type WHEN 'signup' THEN 'Created' WHEN 'view' THEN 'Changed' WHEN 'click' THEN 'Changed'
         WHEN 'error' THEN 'Deleted' ELSE 'Other' END AS change_type FROM events)"""

_MAPPED = rf"""
mapped AS (
  SELECT 'Page' AS doc_type, url, length(html) AS length,
    regexp_replace(coalesce({_part("url", _PATH)}, ''), '/(en|fr|de|es)/', '', 'g') AS section,
    {_part("url", _QUERY)} AS query,
    {_attr("html", "html", "lang")} AS lang,
    CASE WHEN regexp_matches({_part("url", _HOST)}, '^m\.') THEN 'mobile'
         ELSE {_attr("html", "meta", "charset")} END AS mobile,
    {_texts("html", "title")}[1] AS title,
    {_texts("html", "p")} AS paragraph,
    {_clean(_body("html"))} AS content
  FROM pages)"""

_RIGHTS = r"""
masks AS (
  SELECT doc_id, (n_chars * 2) | CASE lang WHEN 'fr' THEN 2147483648 WHEN 'de' THEN 1073741824
         WHEN 'es' THEN 536870912 ELSE 0 END AS rights FROM documents),
expanded AS (
  SELECT *, CASE WHEN (rights & 4026531840) = 0 THEN rights ELSE
      CASE WHEN (rights & 536870912) <> 0 THEN 32 | 131072 | 128 | 1048576 ELSE 0 END
    | CASE WHEN (rights & 2147483648) <> 0 THEN 128 | 1 | 8 | 131072 | 1048576 ELSE 0 END
    | CASE WHEN (rights & 1073741824) <> 0 THEN 4 | 256 | 2 | 16 | 131072 | 1048576 ELSE 0 END
    | CASE WHEN (rights & 268435456) <> 0 THEN 2032127 ELSE 0 END END AS specific
  FROM masks)"""


def _score_words(words: list[str]) -> str:
    """The user query: both words in one field, ranked over all matched words."""
    quoted = ", ".join(f"'{w}'" for w in words)
    return f"""
hits AS (
  SELECT p.doc_key, p.field, {_WEIGHT.replace('c.boost', "CASE p.field WHEN 'title' THEN 2.0 ELSE 1.0 END")} AS w
  FROM postings p JOIN stats s USING (field, term)
    JOIN lengths n ON n.doc_key = p.doc_key AND n.field = p.field
  WHERE p.term IN ({quoted})),
scored AS (
  SELECT doc_key, round(sum(w) * count(*) / {2 * len(words)}, 6) AS score FROM hits GROUP BY doc_key
  HAVING count(*) FILTER (field = 'title') = {len(words)}
      OR count(*) FILTER (field = 'content') = {len(words)})"""


def _stop(words: str) -> str:
    """Postings of the stored index: the content without stop words."""
    kept = f"list_filter({_tokens('text')}, lambda t: t NOT IN ({words}))"
    return _POSTINGS.replace(f"'content', {_tokens('text')}", f"'content', {kept}")


def _ranked(clauses: str, having: str, n: int) -> str:
    """Ranking over the given (field, term) pairs."""
    weight = _WEIGHT.replace("c.boost", "CASE p.field WHEN 'title' THEN 2.0 ELSE 1.0 END")
    return f"""
hits AS (
  SELECT p.doc_key, p.field, {weight} AS w
  FROM postings p JOIN stats s USING (field, term)
    JOIN lengths n ON n.doc_key = p.doc_key AND n.field = p.field
  WHERE (p.field, p.term) IN ({clauses})),
scored AS (
  SELECT doc_key, round(sum(w) * count(*) / {n}, 6) AS score FROM hits GROUP BY doc_key HAVING {having})"""


def _after_changes(sql: str) -> str:
    """A query over the documents as three batches of changes leave them."""
    final = """final_docs AS (
  SELECT d.* REPLACE (CASE WHEN l.quality = 0 THEN d.text || ' the and edited'
    WHEN l.quality IS NULL AND d.lang = 'es' THEN split_part(d.text, chr(10), 1) ELSE d.text END AS text)
  FROM documents d LEFT JOIN labels l USING (doc_id) WHERE coalesce(l.toxic, 0) = 0),"""
    sql = re.sub(r"\bdocuments\b", "final_docs", sql)
    return sql.replace("WITH", "WITH " + final, 1)


_AS_ASKED = "('title', 'the'), ('title', 'and'), ('content', 'and')"

ORACLES: dict[str, str] = {
    "compact": f"""
WITH {_FILES}, {_CONTENT}
SELECT n.path, CASE WHEN i.version = n.version THEN 0 ELSE n.version END AS version,
  CASE WHEN i.version = n.version THEN 'late' ELSE n.content END AS content,
  CASE WHEN i.version = n.version THEN NULL ELSE 'edited' END AS note
FROM new_docs n LEFT JOIN idx i USING (path)""",
    "sweep": rf"""
WITH {_FILES}, {_ROLES}, {_CLASSIFIED}, located AS (
  SELECT *, regexp_replace(path, '/[^/]*$', '') AS dir, regexp_extract(path, '\.([^.]+)$', 1) AS ext
  FROM classified WHERE starts_with(path, '/src1/') AND action <> 'unchanged')
SELECT c.path, c.version, c.action, t.file_type, h.handler, 'first' AS web,
  'https://first.example.com' || substr(c.path, 6) AS url, array_to_string(r.roles, '|') AS roles
FROM located c JOIN {_TYPES} USING (ext) JOIN {_DISPATCH} USING (file_type, action) LEFT JOIN roles r USING (dir)""",
    "forced_sweep": f"""
WITH {_FILES}, here AS (SELECT * FROM listing WHERE starts_with(path, '/src1/')),
seen AS (
  SELECT coalesce(l.path, i.path) AS path, coalesce(l.ext, i.ext) AS ext, l.path IS NULL AS gone, i.path IS NULL AS new,
    l.version IS NOT DISTINCT FROM i.version AS same
  FROM here l FULL OUTER JOIN (SELECT * FROM idx WHERE starts_with(path, '/src1/')) i ON l.path = i.path),
acted AS (
  SELECT day, path, ext, CASE WHEN gone THEN 'deleted' WHEN new THEN 'created'
      WHEN day = 1 OR NOT same THEN 'changed' ELSE 'unchanged' END AS action
  FROM seen CROSS JOIN (VALUES (1), (2)) d(day))
SELECT a.day, a.path, a.action, h.handler
FROM acted a JOIN {_TYPES} USING (ext) JOIN {_DISPATCH} USING (file_type, action)""",
    "map_fields_where": rf"""
SELECT page_id, {_clean(rf"""nullif(regexp_extract({_markup("html")}, '(?is)<div\s+class="ad"[^>]*>(.*?)</div\s*>', 1), '')""")} AS ad,
  {_attr("html", "meta", "charset")} AS charset, NULL::VARCHAR AS other,
  concat_ws('|', {_texts("html", "title")}[1], {_texts("html", "h1")}[1]) AS title,
  CASE WHEN url LIKE '%#%' THEN NULL WHEN url LIKE '%?%' THEN 'query' ELSE 'Page' END AS kind
FROM pages""",
    "search_stored_index": f"""
WITH {_DOCS}, {_stop("'the'")}, {_ranked(_AS_ASKED, """count(*) FILTER (field = 'title') = 2
    OR count(*) FILTER (field = 'content') = 1""", 3)}
SELECT s.doc_key, d.title, d.lang, s.score FROM scored s JOIN docs d ON d.path = s.doc_key
WHERE d.active = 1 AND list_has_any(d.roles, ['A', 'D']) ORDER BY s.score DESC, s.doc_key LIMIT 20""",
    "search_after_delta": _after_changes(f"""
WITH {_DOCS}, {_stop("'the'")}, {_ranked(_AS_ASKED, """count(*) FILTER (field = 'title') = 2
    OR count(*) FILTER (field = 'content') = 1""", 3)}
SELECT s.doc_key, d.title, d.lang, s.score FROM scored s JOIN docs d ON d.path = s.doc_key
ORDER BY s.score DESC, s.doc_key LIMIT 50"""),
    "search_by_roles": _after_changes(f"""
WITH {_DOCS}, {_stop("'the'")}, {_ranked(_AS_ASKED + ", ('title', 'edited'), ('content', 'edited')", "count(*) > 0", 5)}
SELECT s.doc_key, d.title, s.score FROM scored s JOIN docs d ON d.path = s.doc_key
WHERE d.active = 1 AND list_has_any(d.roles, ['A', 'B']) ORDER BY s.score DESC, s.doc_key LIMIT 40"""),
    "segment_stats": _after_changes(f"""
WITH {_FILES}, {_stop("'the'")}, valued AS (
  SELECT field, term, df FROM stats
  UNION ALL SELECT 'lang', lang, count(*) FROM filed GROUP BY lang)
SELECT field, term, df FROM valued"""),
    "search_any_word": f"""
WITH {_DOCS}, {_stop("'the'")}, {_ranked(_AS_ASKED, "count(*) > 0", 3)}
SELECT s.doc_key, d.title, s.score FROM scored s JOIN docs d ON d.path = s.doc_key
ORDER BY s.score DESC, s.doc_key LIMIT 50""",
    "search_keyword_field": f"""
WITH {_DOCS}
SELECT path AS doc_key, lang, round(power(1 + ln((SELECT count(*) FROM documents)::DOUBLE
    / ((SELECT count(*) FROM documents WHERE lang = 'fr') + 1)), 2), 6) AS score
FROM docs WHERE lang = 'fr' AND active = 1""",
    "list_files": """
SELECT DISTINCT concat('/source=', source, '/lang=', lang, '/rest=', doc_id % 7) AS dir, 'parquet' AS ext,
  1::BIGINT AS n_files, true AS has_content, true AS has_time FROM documents""",
    "exclude_subtrees": f"WITH {_FILES} SELECT * FROM listing WHERE {_OUTSIDE}",
    "route_by_extension": f"WITH {_FILES} SELECT l.*, t.file_type FROM listing l JOIN {_TYPES} USING (ext)",
    "derive_url": f"""
WITH named AS (
  SELECT doc_id, concat('/', source, '/', lang, '/', split_part(text, chr(10), 1), '~*.', {_EXT}) AS path
  FROM documents)
SELECT doc_id, path, 'https://www.example.com/docs/' || replace(url_encode(path[2:]), '%2F', '/') AS url
FROM named""",
    "split_url": rf"""
SELECT page_id, url, {_part("url", "^([^:/?#]+):")} AS url_scheme, {_part("url", _HOST)} AS url_host,
  regexp_extract(url, '{_PATH}', 1) AS url_path, {_part("url", _QUERY)} AS url_query,
  {_part("url", "#(.*)$")} AS url_fragment, {_part("url", "^[^:/?#]+://([^/?#]*)")} AS url_authority
FROM pages""",
    "write_snapshot": f"""
WITH {_DOCS} SELECT doc_type, count(*) AS n_docs, sum(length(content))::BIGINT AS n_chars
FROM docs GROUP BY doc_type""",
    "read_snapshot": f"""
WITH {_FILES}, {_CONTENT}
SELECT path, version, content FROM new_docs""",
    "quarantine": rf"""
WITH fetched AS (SELECT page_id, CASE WHEN url NOT LIKE '%#%' THEN html END AS html FROM pages),
checked AS (
  SELECT page_id, html IS NULL AS no_html,
    coalesce(len(regexp_extract_all({_markup("html")}, '(?is)<p(?:\s[^>]*)?>(.*?)</p\s*>', 1)) < 5, false) AS few
  FROM fetched)
SELECT page_id, 'fetch' AS stage, 'page was not fetched' AS message FROM checked WHERE no_html
UNION ALL SELECT page_id, 'content', 'fewer than five paragraphs' FROM checked WHERE few
UNION ALL SELECT page_id, 'ok', '' FROM checked WHERE NOT no_html AND NOT few""",
    "map_fields": f"""
WITH {_MAPPED} SELECT * REPLACE (array_to_string(paragraph, '|') AS paragraph) FROM mapped""",
    "job_fields": f"""
WITH {_FILES}, {_ROLES}
SELECT l.path, 'https://intranet.example.com' || l.path AS url,
  CASE WHEN l.ext = 'html' THEN 'Page' ELSE 'Document' END AS doc_type, true AS searchable,
  array_to_string(r.roles, '|') AS roles FROM listing l JOIN roles r USING (dir)""",
    "with_variables": rf"""
SELECT page_id, CASE WHEN url LIKE 'https:%' THEN 'encrypted' ELSE {_part("url", _HOST)} END AS access,
  CASE WHEN {_part("url", _QUERY)} IS NOT NULL THEN regexp_extract(url, '{_PATH}', 1) END AS place
FROM pages""",
    "conditional_value": f"""
WITH {_FILES} SELECT doc_id, CASE WHEN lang = 'en' THEN 'english' ELSE source END AS set_eq,
  CASE WHEN lang = 'en' THEN source END AS clear_ne,
  CASE WHEN contains(text, 'the') THEN 'has the' ELSE source END AS set_contains,
  CASE WHEN regexp_matches(text, '[0-9]{{3}}') THEN replace(source, 'src', 's') ELSE source END AS replace_matches,
  CASE WHEN quality IS NULL THEN 'unlabelled' ELSE source END AS set_null FROM labelled""",
    "join_values": f"""
WITH {_FILES} SELECT doc_id, nullif(concat_ws(', ', CASE WHEN lang <> 'en' THEN lang END,
  CASE WHEN quality = 1 THEN 'good' END, CASE WHEN toxic = 1 THEN 'toxic' END), '') AS keywords
FROM labelled""",
    "info_fields": """
SELECT event_id, json_extract_string(props, '$.k') AS k, json_extract_string(props, '$.author') AS author
FROM events""",
    "to_field_rows": f"""
WITH {_MAPPED}
SELECT url AS doc_key, field, 0 AS pos, value, CASE field WHEN 'title' THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS boost
FROM (SELECT url, unnest([
  {{'field': 'doc_type', 'value': doc_type}}, {{'field': 'url', 'value': url}},
  {{'field': 'length', 'value': length::VARCHAR}}, {{'field': 'section', 'value': section}},
  {{'field': 'query', 'value': query}}, {{'field': 'lang', 'value': lang}},
  {{'field': 'mobile', 'value': mobile}}, {{'field': 'title', 'value': title}},
  {{'field': 'content', 'value': content}}], recursive := true) FROM mapped) WHERE value IS NOT NULL
UNION ALL
SELECT url, 'paragraph', (generate_subscripts(paragraph, 1) - 1)::INTEGER, unnest(paragraph), 1.0 FROM mapped""",
    "identity_key": rf"""
SELECT {_part("url", _HOST)} AS host, {_part("url", _QUERY)} AS query FROM pages
WHERE {_part("url", _HOST)} IS NOT NULL AND {_part("url", _QUERY)} IS NOT NULL""",
    "first_attribute": f"""
SELECT page_id, {_attr("html", "html", "lang")} AS lang, {_attr("html", "meta", "charset")} AS charset,
  {_attr("html", "a", "href")} AS link, {_attr("html", "div", "id")} AS div_id FROM pages""",
    "node_texts": f"""
WITH t AS (SELECT page_id, {_texts("html", "p")} AS texts FROM pages)
SELECT page_id, (generate_subscripts(texts, 1) - 1)::INTEGER AS pos, unnest(texts) AS text FROM t""",
    "normalise_lines": f"SELECT doc_id, {_normalise('text')} AS text FROM documents",
    "decode_entities": f"SELECT page_id, {_decode('html')} AS html FROM pages",
    "page_text": f"SELECT page_id, {_clean(_markup('html'))} AS text FROM pages",
    "assemble_text": rf"""
SELECT conv_id AS doc_key, regexp_replace(string_agg(text, ' ' ORDER BY turn), '\A{_W}+|{_W}+\z', '', 'g') AS content
FROM conversations WHERE text IS NOT NULL GROUP BY conv_id""",
    "resolve_shared_strings": rf"""
WITH cells AS (
  SELECT conv_id AS workbook_id, turn AS pos, role = 'user' AS is_shared, turn + 2 AS idx, text AS literal
  FROM conversations),
resolved AS (
  SELECT c.*, s.text AS string FROM cells c
  LEFT JOIN conversations s ON c.is_shared AND s.conv_id = c.workbook_id AND s.turn = c.idx)
SELECT workbook_id, pos,
  CASE WHEN is_shared AND string IS NULL THEN NULL
       ELSE regexp_replace(CASE WHEN is_shared THEN string ELSE literal END, '\A{_W}+|{_W}+\z', '', 'g') END AS text,
  CASE WHEN is_shared AND string IS NULL THEN 'no shared string ' || idx END AS message FROM resolved""",
    "deleted_files": f"WITH {_FILES} SELECT * FROM idx WHERE path NOT IN (SELECT path FROM listing)",
    "created_files": f"WITH {_FILES} SELECT * FROM listing WHERE path NOT IN (SELECT path FROM idx)",
    "changed_files": f"""
WITH {_FILES} SELECT l.* FROM listing l JOIN idx i USING (path) WHERE l.version <> i.version""",
    "classify_changes": f"WITH {_FILES}, {_CLASSIFIED} SELECT * FROM classified",
    "removed_subtree": f"""
WITH {_FILES}, {_FOLDER_EVENTS},
last AS (SELECT path, arg_max(change_type, (ts, event_id)) AS change_type FROM folder_changes
         WHERE change_type <> 'Other' GROUP BY path)
SELECT DISTINCT i.path, i.dir FROM idx i JOIN last r ON r.change_type = 'Deleted'
  AND (i.dir = r.path OR starts_with(i.dir, r.path || '/'))""",
    "version_ticks": """
SELECT event_id, epoch_us(ts) * 10 + 621355968000000000 AS version_ticks FROM events""",
    "config_changed": f"""
WITH {_FILES}, now AS (SELECT concat(source, '-', lang) AS index, max(n_chars) AS stamp FROM labelled GROUP BY ALL),
was AS (SELECT concat(source, '-', lang) AS index, max(n_chars) AS stamp FROM labelled
        WHERE quality IS NOT NULL GROUP BY ALL)
SELECT now.index, now.stamp IS DISTINCT FROM was.stamp AS changed FROM now LEFT JOIN was ON now.index = was.index""",
    "dispatch_actions": f"""
WITH {_FILES}, {_CLASSIFIED}
SELECT c.path, c.action, t.file_type, h.handler FROM classified c
JOIN {_TYPES} ON t.ext = split_part(c.path, '.', 2)
JOIN {_DISPATCH} ON h.file_type = t.file_type AND h.action = c.action""",
    "dedup_work": f"WITH {_EVENTS} SELECT DISTINCT handler, web, path FROM routed",
    "upsert_docs": f"""
WITH {_FILES}, {_CONTENT}
SELECT * FROM old_docs WHERE path NOT IN (SELECT path FROM listing) UNION ALL SELECT * FROM new_docs""",
    "delete_docs": f"""
WITH {_FILES}, {_CONTENT} SELECT * FROM old_docs WHERE path NOT IN (SELECT path FROM listing)""",
    "exists_docs": f"WITH {_FILES} SELECT * FROM listing WHERE path IN (SELECT path FROM idx)",
    "latest_per_identity": f"""
WITH {_EVENTS} SELECT path, event_id, change_type FROM change_events
QUALIFY row_number() OVER (PARTITION BY path ORDER BY ts DESC, event_id DESC) = 1""",
    "apply_changes": f"""
WITH {_FILES}, {_CONTENT}, {_CLASSIFIED}
SELECT o.* FROM old_docs o JOIN classified c USING (path) WHERE c.action = 'unchanged'
UNION ALL
SELECT n.* FROM new_docs n JOIN classified c USING (path) WHERE c.action IN ('created', 'changed')""",
    "inherit_roles": f"WITH {_FILES}, {_ROLES} SELECT dir, array_to_string(roles, '|') AS roles FROM roles",
    "read_rights": f"""
WITH {_FILES}, {_ACL} SELECT path, account,
  bool_or(entry_type = 'allow' AND rights & 1 = 1) AND NOT bool_or(entry_type = 'deny' AND rights & 1 = 1) AS can_read
FROM acl GROUP BY path, account""",
    "read_rights_untyped": f"""
WITH {_FILES}, {_ACL} SELECT path, account, bool_or(rights & 1 = 1) AS can_read
FROM acl GROUP BY path, account""",
    "has_read_permission": f"""
WITH {_RIGHTS} SELECT doc_id, rights, len(list_filter(
  [1, 131209, 197055, 131241, 8, 524288, 262144, 2032127, 64, 65536],
  lambda m: (specific & m) = m)) > 0 AS can_read FROM expanded""",
    "authorized_groups": f"""
WITH {_FILES}, {_ACL}
SELECT path, string_agg(account, '|' ORDER BY account) AS groups FROM (
  SELECT path, account FROM acl WHERE account IN ('g1', 'g3', 'g9') GROUP BY path, account
  HAVING bool_or(entry_type = 'allow' AND rights & 1 = 1)
     AND NOT bool_or(entry_type = 'deny' AND rights & 1 = 1)) GROUP BY path""",
    "visible_to": f"""
WITH {_DOCS} SELECT path, array_to_string(roles, '|') AS roles FROM docs
WHERE list_has_any(roles, ['B', ' E', 'ROOT'])""",
    "tokenize": f"""
WITH t AS (SELECT doc_id, {_tokens("text")} AS terms FROM documents)
SELECT doc_id, (generate_subscripts(terms, 1) - 1)::INTEGER AS pos, unnest(terms) AS term FROM t""",
    "analyze_fields": f"""
WITH {_FILES}, analysed AS (
  SELECT path, 'lang' AS field, [lang] AS terms FROM filed
  UNION ALL SELECT path, 'title', {_tokens("split_part(text, chr(10), 1)")} FROM filed
  UNION ALL SELECT path, 'content', list_filter({_tokens("text")},
    lambda t: t NOT IN ('the', 'of', 'and', 'le', 'la', 'de', 'der', 'und')) FROM filed)
SELECT path AS doc_key, field, (generate_subscripts(terms, 1) - 1)::INTEGER AS pos, unnest(terms) AS term
FROM analysed""",
    "build_postings": f"""
WITH {_FILES}, {_POSTINGS}
SELECT p.field, p.term, p.doc_key, p.tf, n.n AS field_len, p.positions
FROM postings p JOIN lengths n ON n.doc_key = p.doc_key AND n.field = p.field""",
    "term_stats": f"WITH {_FILES}, {_POSTINGS} SELECT * FROM stats",
    "field_lengths": f"WITH {_FILES}, {_POSTINGS} SELECT * FROM lengths",
    "term_query": f"WITH {_DOCS} SELECT path, title FROM docs WHERE active = 1 AND dir = '/src1/en'",
    "bool_query": f"""
WITH {_FILES}, {_POSTINGS}, {_CLAUSES}
SELECT doc_key, count(*) FILTER (occur = 'must') AS n_must, count(*) FILTER (occur = 'should') AS n_should
FROM postings JOIN clauses USING (field, term) GROUP BY doc_key HAVING count(*) FILTER (occur = 'must') = 2""",
    "multi_field_query": f"""
WITH {_FILES}, {_POSTINGS}
SELECT DISTINCT doc_key FROM (SELECT doc_key, field FROM postings WHERE term IN ('the', 'and')
  GROUP BY doc_key, field HAVING count(*) = 2)""",
    "score": f"{_RANKING} SELECT * FROM scored",
    "top_k": f"{_RANKING} SELECT * FROM scored ORDER BY score DESC, doc_key LIMIT 20",
    "total_hits": f"{_RANKING} SELECT count(*) AS total_hits FROM scored",
    "fetch_fields": f"""{_RANKING}
SELECT h.doc_key, split_part(f.text, chr(10), 1) AS title, f.lang, h.score
FROM (SELECT * FROM scored ORDER BY score DESC, doc_key LIMIT 20) h JOIN filed f ON f.path = h.doc_key""",
    "search": f"""
WITH {_DOCS}, {_POSTINGS}, {_score_words(["the", "and"])}
SELECT s.doc_key, d.title, d.lang, s.score FROM scored s JOIN docs d ON d.path = s.doc_key
WHERE d.active = 1 AND list_has_any(d.roles, ['A', 'D']) ORDER BY s.score DESC, s.doc_key LIMIT 20""",
    "read_change_events": f"""
WITH {_EVENTS} SELECT event_id, web, path, false AS is_dir, change_type, epoch_us(ts) AS micros
FROM change_events WHERE change_type <> 'Other'""",
    "route_events": f"WITH {_EVENTS} SELECT * EXCLUDE (ts) FROM routed",
    "latest_event": f"""
WITH {_EVENTS} SELECT web, path, event_id, action FROM routed
QUALIFY row_number() OVER (PARTITION BY web, path ORDER BY ts DESC, event_id DESC) = 1""",
    "debounce_events": f"""
WITH RECURSIVE {_EVENTS}, timed AS (SELECT handler, web, path, event_id, epoch_us(ts) AS t FROM routed),
opened(handler, web, path, t) AS (
  SELECT handler, web, path, min(t) FROM timed GROUP BY ALL
  UNION ALL
  SELECT o.handler, o.web, o.path, min(e.t) FROM opened o JOIN timed e
    ON e.handler = o.handler AND e.web = o.web AND e.path = o.path AND e.t >= o.t + 86400000000
  GROUP BY o.handler, o.web, o.path)
SELECT o.handler, o.web, o.path, o.t AS opened, o.t + 86400000000 AS due, count(*) AS n_events,
  arg_max(e.event_id, (e.t, e.event_id)) AS last_event
FROM opened o JOIN timed e ON e.handler = o.handler AND e.web = o.web AND e.path = o.path
  AND e.t >= o.t AND e.t < o.t + 86400000000 GROUP BY o.handler, o.web, o.path, o.t""",
    "debounce_hot": f"""
WITH RECURSIVE {_EVENTS}, timed AS (SELECT handler, event_id, epoch_us(ts) AS t FROM routed),
opened(handler, t) AS (
  SELECT handler, min(t) FROM timed GROUP BY handler
  UNION ALL
  SELECT o.handler, (SELECT min(e.t) FROM timed e WHERE e.handler = o.handler AND e.t >= o.t + 3600000000)
  FROM opened o WHERE o.t IS NOT NULL)
SELECT o.handler, o.t AS opened, o.t + 3600000000 AS due, count(*) AS n_events,
  arg_max(e.event_id, (e.t, e.event_id)) AS last_event
FROM opened o JOIN timed e ON e.handler = o.handler AND e.t >= o.t AND e.t < o.t + 3600000000
GROUP BY o.handler, o.t""",
    "folder_events": f"""
WITH {_FILES}, {_FOLDER_EVENTS}, found AS (
  SELECT l.path, c.* EXCLUDE (path) FROM listing l JOIN folder_changes c
    ON c.change_type = 'Created' AND (l.dir = c.path OR starts_with(l.dir, c.path || '/'))
  UNION ALL
  SELECT i.path, c.* EXCLUDE (path) FROM idx i JOIN folder_changes c
    ON c.change_type = 'Deleted' AND (i.dir = c.path OR starts_with(i.dir, c.path || '/')))
SELECT event_id, web, path, false AS is_dir, change_type FROM found
QUALIFY row_number() OVER (PARTITION BY web, path, change_type ORDER BY ts DESC, event_id DESC) = 1""",
    "sync_folders": f"""
WITH {_FILES}, {_ROLES}, {_EVENTS.replace("user_id, '.html')", "user_id, CASE user_id % 3 WHEN 0 THEN '.pdf' ELSE '.html' END)")},
kinds AS (
  SELECT * FROM routed WHERE path LIKE '%.html' OR (web = 'intranet' AND action IN ('created', 'deleted'))),
last AS (SELECT path, arg_max(action, (ts, event_id)) AS action, any_value(url) AS url FROM kinds GROUP BY path)
SELECT l.path, l.url, d.lang, coalesce(array_to_string(list_filter(coalesce(string_split(c.allow, ','), ['ROOT', 'A']),
    lambda r: NOT coalesce(list_contains(string_split(c.deny, ','), r), false)), '|'), '') AS roles,
  CASE WHEN l.path LIKE '%.pdf' THEN split_part(d.text, chr(10), 1) ELSE d.text END AS content
FROM last l JOIN documents d ON l.path = concat('/src', d.doc_id % 20, '/', d.doc_id, CASE d.doc_id % 3 WHEN 0 THEN '.pdf' ELSE '.html' END)
LEFT JOIN conf c ON c.dir = '/src' || (d.doc_id % 20) WHERE l.action <> 'deleted'""",
    "reconcile": f"""
WITH {_FILES}, {_CLASSIFIED}, work AS (
  SELECT c.path, c.action, h.handler, 'https://intranet.example.com' || c.path AS url, d.lang, d.n_chars,
    NOT (d.ext = 'docx' AND coalesce(d.quality, 1) = 0) AS had, d.lang = 'es' AND d.ext = 'html' AS failed
  FROM classified c JOIN filed d USING (path) JOIN {_TYPES} USING (ext) JOIN {_DISPATCH} USING (file_type, action)
  WHERE c.action <> 'unchanged')
SELECT path, n_chars AS version_ticks, handler AS state, url FROM work WHERE action <> 'deleted' AND had AND NOT failed
UNION ALL
SELECT path, version, 'before', NULL FROM idx WHERE path NOT IN (
  SELECT path FROM work WHERE action = 'deleted' OR (had AND NOT failed))
UNION ALL
SELECT path, -1, CASE WHEN had THEN 'language: not read' ELSE 'mapping: no document' END, NULL
FROM work WHERE action <> 'deleted' AND (failed OR NOT had)""",
    "sync_stream": f"""
WITH {_EVENTS}, last AS (
  SELECT path, arg_max(action, (ts, event_id)) AS action, any_value(url) AS url FROM routed GROUP BY path)
SELECT l.path, l.url, d.lang, d.text AS content FROM last l
JOIN documents d ON l.path = concat('/src', d.doc_id % 20, '/', d.doc_id, '.html')
WHERE l.action <> 'deleted'""",
}
ORACLES["search_merged_segments"] = ORACLES["search_after_delta"]
ORACLES["expire_versions"] = ORACLES["compact"]
