"""The queries once more as SQL for an independent engine.

Written from the meaning of each operator, not from its Spark plan: dedup and
numbering are window functions here, searches are unions, ingest starts from
the content rows and not from JSON.
"""

from __future__ import annotations

from presswork.operators.enrich import (
    ARTICLE_PROMPT, IMAGE_PROMPT, TAG_PROMPT, TRANSLATION_PROMPT,
)
from presswork.operators.filters import ALL
from presswork.operators.ordering import SORT_COLUMNS
from presswork.plans.queries import (
    HOST_KINDS, LIST_REQUEST, MANY_PAIRS, ONE_URL, PAIRS, SITE, TITLE_PATTERN,
)

AS_OF = "TIMESTAMP '2024-01-15 00:00:00'"

_LINE = "split_part(d.text, chr(10), 1)"
_SECOND = "(d.lang <> 'en' OR d.doc_id % 3 = 0)"

CTES = {
    "content": f"""content AS (
  SELECT d.doc_id AS id,
    CASE WHEN d.lang = 'en' THEN {_LINE} END AS title,
    CASE WHEN {_SECOND} THEN {_LINE} END AS title_persian,
    CASE WHEN d.doc_id % 97 <> 0 THEN e.ts END AS date,
    coalesce(p.html, d.text) AS content,
    CASE WHEN {_SECOND} THEN d.text WHEN d.doc_id % 7 = 0 THEN '' END AS content_persian,
    p.url AS url,
    c.c_name AS author,
    CAST(floor(e.value) AS INTEGER) AS views,
    CASE WHEN d.doc_id % 101 <> 0 THEN d.source END AS source,
    CASE WHEN d.lang = 'en' THEN d.text END AS summary,
    CASE WHEN d.lang <> 'en' THEN d.text END AS summary_persian,
    CASE WHEN d.doc_id % 89 <> 0 THEN e.value END AS final_score,
    e.event_type AS type
  FROM documents d
  LEFT JOIN events e ON e.event_id = d.doc_id * 5
  LEFT JOIN pages p ON p.page_id = d.doc_id
  LEFT JOIN customer c ON c.c_custkey = d.doc_id)""",
    "tag_lists": """tag_lists AS (
  SELECT doc_id AS content_id, lang, regexp_extract_all(lower(text), '[a-z]{12,}') AS tags
  FROM documents)""",
    "wanted": """wanted AS (
  SELECT content_id, lang, unnest(range(len(tags))) AS pos, unnest(tags) AS tag
  FROM tag_lists)""",
    "all_tags": """all_tags AS (
  SELECT row_number() OVER (ORDER BY tag) AS id, tag
  FROM (SELECT DISTINCT tag FROM wanted))""",
    "links": """links AS (
  SELECT DISTINCT w.content_id, t.id AS tag_id, w.tag, w.lang
  FROM wanted w JOIN all_tags t ON t.tag = w.tag)""",
    # Tags of two languages are there already, the others follow them.
    "old_tags": """old_tags AS (
  SELECT row_number() OVER (ORDER BY tag) AS id, tag
  FROM (SELECT DISTINCT tag FROM wanted WHERE lang IN ('en', 'de')))""",
    "replies": """replies AS (
  SELECT conv_id AS content_id, turn AS seq,
    CASE WHEN conv_id % 5 <> 0 THEN text END AS text
  FROM conversations WHERE role = 'assistant')""",
    "images": """images AS (
  SELECT page_id AS content_id, 'img' || page_id || '.png' AS image_url,
    CASE WHEN page_id % 4 = 0 THEN ''
      ELSE html END AS image
  FROM pages)""",
    "items": """items AS (
  SELECT id AS seq, id % 2 = 0 AS is_full,
    CASE WHEN id % 13 = 0 THEN rpad(coalesce(title, ''), 256, 'x') ELSE title END AS title,
    title_persian, date, id % 19 = 0 AS bad_date, content, url, author,
    CASE WHEN id % 2 = 0 THEN views ELSE 0 END AS views,
    source, summary, summary_persian, final_score, type, t.tags
  FROM content JOIN tag_lists t ON t.content_id = content.id
  UNION ALL
  SELECT page_id + 1000000000000, false, NULL, NULL, TIMESTAMP '2024-01-20 08:00:00', false,
    NULL, url, 'desk', 0, 'wire', NULL, NULL, NULL, NULL, NULL
  FROM pages)""",
    # Of the even records every key is there; of the odd ones those with a value.
    "judged": """judged AS (
  SELECT *, CASE
    WHEN NOT is_full AND NOT bad_date AND date IS NULL THEN 'missing_date'
    WHEN NOT is_full AND url IS NULL THEN 'missing_url'
    WHEN NOT is_full AND author IS NULL THEN 'missing_author'
    WHEN NOT is_full AND source IS NULL THEN 'missing_source'
    WHEN bad_date THEN 'bad_date'
    WHEN length(title) > 255 THEN 'title_too_long'
    WHEN length(title_persian) > 255 THEN 'title_persian_too_long'
  END AS reject_reason FROM items)""",
    "fresh": """fresh AS (
  SELECT * EXCLUDE (copy) FROM (
    SELECT *, row_number() OVER (PARTITION BY url ORDER BY seq) AS copy
    FROM judged WHERE reject_reason IS NULL)
  WHERE url IS NULL OR (copy = 1 AND url NOT IN (
    SELECT url FROM content WHERE type = 'view' AND url IS NOT NULL)))""",
    "added": """added AS (
  SELECT (SELECT max(id) FROM content WHERE type = 'view') + row_number() OVER (ORDER BY seq)
    AS id, * FROM fresh)""",
    "added_wanted": "added_wanted AS (SELECT id, unnest(tags) AS tag FROM added)",
    "added_tags": """added_tags AS (
  SELECT (SELECT max(id) FROM old_tags) + row_number() OVER (ORDER BY tag) AS id, tag
  FROM (SELECT DISTINCT tag FROM added_wanted WHERE tag NOT IN (SELECT tag FROM old_tags)))""",
}

# Which other views a view reads.
_NEEDS = {
    "wanted": ("tag_lists",),
    "all_tags": ("wanted",),
    "links": ("all_tags",),
    "old_tags": ("wanted",),
    "items": ("content", "tag_lists"),
    "judged": ("items",),
    "fresh": ("judged",),
    "added": ("fresh",),
    "added_wanted": ("added",),
    "added_tags": ("added_wanted", "old_tags"),
}


def using(names: str, select: str) -> str:
    """A query over some of the views above and those they need."""
    ordered: dict[str, None] = {}

    def need(name: str) -> None:
        for other in _NEEDS.get(name, ()):
            need(other)
        ordered[name] = None

    for name in names.split():
        need(name)
    return "WITH " + ",\n".join(CTES[name] for name in ordered) + "\n" + select.strip()


def text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


# All white space but the plain space, and all of it.
_SPACES = "".join(f"\\x{{{code:x}}}" for code in (
    *range(9, 14), *range(28, 32), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029,
    0x202F, 0x205F, 0x3000, 0x20))
_STRIP = "concat({})".format(", ".join(f"chr({code})" for code in (
    *range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029,
    0x202F, 0x205F, 0x3000)))


def html_text(column: str) -> str:
    """Markup taken out kind by kind, then the entities the pages use.

    An entity that a tag cuts off before its semicolon counts as complete.
    """
    out = f"regexp_replace({column}, '&(quot|middot|copy|lt|gt|nbsp|amp)<', '&\\1;<', 'g')"
    for pattern in (
        r"(?s)<!--.*?-->",
        r"(?is)<script\b[^>]*>.*?(</script\s*>|$)",
        r"(?is)<style\b[^>]*>.*?(</style\s*>|$)",
        r"(?is)<template\b[^>]*>.*?(</template\s*>|$)",
        r"(?s)<![^>]*>",
        r"(?s)</?[A-Za-z][^>]*>",
    ):
        out = f"regexp_replace({out}, '{pattern}', '', 'g')"
    for entity, char in (("&quot;", '"'), ("&middot;", "·"), ("&copy;", "©"), ("&lt;", "<"),
                         ("&gt;", ">"), ("&nbsp;", " "), ("&amp;", "&")):
        out = f"replace({out}, '{entity}', '{char}')"
    return out


_SHOWN = "html"
for _pattern in (r"(?s)<!--.*?-->", r"(?is)<script\b[^>]*>.*?(</script\s*>|$)",
                 r"(?is)<style\b[^>]*>.*?(</style\s*>|$)",
                 r"(?is)<template\b[^>]*>.*?(</template\s*>|$)"):
    _SHOWN = f"regexp_replace({_SHOWN}, '{_pattern}', '', 'g')"



def clean(column: str) -> str:
    return f"trim(regexp_replace({html_text(column)}, '[{_SPACES}]+', ' ', 'g'))"


def count(haystack: str, needle: str) -> str:
    if not needle:
        return f"(length({haystack}) + 1)"
    word = text(needle.lower())
    return f"((length({haystack}) - length(replace({haystack}, {word}, ''))) // {len(needle)})"


def matched(haystack: str, pairs) -> str:
    """The list of keywords met, in pair order."""
    cases = ", ".join(
        f"CASE WHEN {count(haystack, k)} >= {w} THEN {text(k)} END" for k, w in pairs)
    return f"[x FOR x IN [{cases}] IF x IS NOT NULL]"


_TAG = r"(?is)<(/?[a-z][a-z0-9]*)(?:[\s/][^>]*)?>"
_VOID = "area|base|br|col|embed|hr|img|input|link|meta|param|source|track|wbr"


#: The items of a list, where each has a closing tag.
_CLOSED_ITEMS = """listed AS (
  SELECT page_id, pos, regexp_extract_all(block, '(?is)<li(?:\\s[^>]*)?>(.*?)</li\\s*>', 1) AS parts
  FROM whole WHERE tag = 'ul'),"""

#: The same where none has one: an item ends at the next one, if no list begins before it, or with the block.
_OPEN_ITEMS = """marks AS (
  SELECT k.page_id, k.pos, e.i, e.name, k.ended,
    lead(e.i) OVER w AS next, lead(e.name) OVER w AS next_name
  FROM kinds k JOIN elements b ON b.page_id = k.page_id AND b.i = k.begun AND b.name = 'ul'
  JOIN elements e ON e.page_id = k.page_id AND e.i > k.begun AND e.i <= k.ended AND e.name IN ('ul', 'li')
  WINDOW w AS (PARTITION BY k.page_id, k.pos ORDER BY e.i)),
runs AS (SELECT page_id, pos, i, ended, if(next_name = 'li', next - 1, ended) AS last FROM marks WHERE name = 'li'),
texts AS (
  SELECT r.page_id, r.pos, r.i, string_agg(
    if(e.i = r.i, '', e.tag) || if(e.i = r.ended, '', e.gap), '' ORDER BY e.i) AS part
  FROM runs r JOIN elements e ON e.page_id = r.page_id AND e.i BETWEEN r.i AND r.last GROUP BY ALL),
listed AS (SELECT page_id, pos, list(part ORDER BY i) AS parts FROM texts GROUP BY ALL),"""


def blocks(body: str, items: str = _CLOSED_ITEMS) -> str:
    """Rows of the outermost blocks, by a walk over the tags with the open elements as a stack."""
    return f"""
WITH RECURSIVE bodies AS (SELECT page_id, {body} AS body FROM pages),
tokens AS (
  SELECT page_id, regexp_extract_all(body, '{_TAG}') AS tags, regexp_extract_all(body, '{_TAG}', 1) AS names,
    regexp_split_to_array(body, '{_TAG}') AS gaps FROM bodies),
numbered AS (SELECT *, unnest(range(1, len(tags) + 1)) AS i FROM tokens),
elements AS (
  SELECT page_id, i, lower(names[i]) AS name, tags[i] AS tag, gaps[i + 1] AS gap,
    regexp_full_match(lower(names[i]), '{_VOID}') OR tags[i] LIKE '%/>' AS void FROM numbered),
walk AS (
  SELECT page_id, 0 AS i, '/' AS stack, 0 AS depth, 0 AS first, 0 AS begun, 0 AS ended FROM bodies
  UNION ALL
  SELECT page_id, i, stack, if(stays, depth, 0), first,
    CASE WHEN lone THEN i WHEN depth > 0 AND NOT stays THEN first ELSE 0 END,
    if(lone OR (depth > 0 AND NOT stays), i, 0)
  FROM (
    SELECT *, void AND depth = 0 AND name IN ('img', 'p', 'ul', 'blockquote') AS lone,
      length(stack) > depth AS stays
    FROM (
      SELECT w.page_id, e.i, e.name, e.void,
        CASE WHEN void THEN stack WHEN name NOT LIKE '/%' THEN stack || name || '/'
          WHEN position(name || '/' IN stack) = 0 THEN stack
          ELSE left(stack, length(stack) - position(reverse(name || '/') IN reverse(stack)) - length(name) + 1)
          END AS stack,
        CASE WHEN depth = 0 AND NOT void AND name IN ('p', 'ul', 'blockquote') THEN length(stack)
          ELSE depth END AS depth,
        if(depth = 0, e.i, first) AS first
      FROM walk w JOIN elements e ON e.page_id = w.page_id AND e.i = w.i + 1))),
ends AS (
  SELECT page_id, begun, ended FROM walk WHERE begun > 0
  UNION ALL
  SELECT page_id, first, i + 1
  FROM (SELECT *, max(i) OVER (PARTITION BY page_id) AS n FROM walk) WHERE i = n AND depth > 0),
kinds AS (
  SELECT page_id, begun, ended, row_number() OVER (PARTITION BY page_id ORDER BY begun) - 1 AS pos FROM ends),
whole AS (
  SELECT k.page_id, pos, any_value(name) FILTER (i = begun) AS tag,
    string_agg(if(i < ended, e.tag || gap, e.tag), '' ORDER BY i) AS block
  FROM kinds k JOIN elements e ON e.page_id = k.page_id AND e.i BETWEEN begun AND ended GROUP BY ALL),
{items}
pieces AS (
  SELECT page_id, pos, tag AS kind, [block] AS parts FROM whole WHERE tag <> 'ul'
  UNION ALL SELECT page_id, pos, 'li', parts FROM listed),
items AS (
  SELECT page_id, pos, kind, unnest(range(len(parts))) AS item, unnest(parts) AS part FROM pieces)
SELECT page_id, pos, item, kind,
  CASE WHEN kind <> 'img' THEN {html_text('part')} END AS text,
  CASE WHEN kind = 'img' THEN regexp_extract(part, '(?i)\\ssrc="([^"]*)"', 1) END AS src,
  CASE WHEN kind = 'img' THEN regexp_extract(part, '(?i)\\salt="([^"]*)"', 1) END AS alt,
  CASE WHEN kind = 'img' THEN regexp_matches(part, '(?i)\\ssrc="[^"]*\\.svg"') END AS is_svg
FROM items""".replace("\\\\", "\\")


def keyword_rows(columns: str, pairs) -> str:
    """Rows of the content view that meet a keyword, with the list of those met."""
    return f"""(
  SELECT {columns}, keywords FROM (
    SELECT *, {matched('cleaned', pairs)} AS keywords
    FROM (SELECT *, lower({clean('content')}) AS cleaned FROM content))
  WHERE len(keywords) > 0)"""


def found(column: str, pattern: str) -> str:
    return f"coalesce(regexp_matches({column}, {text('(?i)' + pattern)}), false)"


def moment(column: str = "date") -> str:
    return f"strftime({column}, '%Y-%m-%d %H:%M:%S.%f') AS {column}"


_HOST = "regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1)"


def domain(url: str = "url") -> str:
    """All test hosts are under three plain suffixes."""
    return f"regexp_extract({_HOST.replace('url', url)}, '[^.]+[.](com|net|org)$')"


def filled(template: str, *values: str) -> str:
    parts = template.replace("%%", "%").split("%s")
    out = [text(parts[0])]
    for value, part in zip(values, parts[1:], strict=True):
        out += [f"coalesce(CAST({value} AS VARCHAR), 'None')", text(part)]
    return " || ".join(out)


def facet(column: str, source: str = "content") -> str:
    return f"""SELECT 0 AS rank, '{ALL}' AS value
UNION ALL
SELECT 1, {column} FROM (SELECT DISTINCT {column} FROM {source} WHERE {column} IS NOT NULL)"""


_BODY = "coalesce(nullif(content, ''), content_persian)"
_SUMMARY = "coalesce(nullif(summary, ''), summary_persian)"
_CARD_SUMMARY = ("substr(coalesce(nullif(summary_persian, ''), summary, ''), 1, 200) || '...'")
_CARD_TITLE = "coalesce(nullif(title_persian, ''), title)"
_DOMAIN = f"CASE WHEN url IS NOT NULL THEN {domain()} END"
_CONTENT_COLUMNS = (
    "id, title, title_persian, {}, content, content_persian, url, author, views, source, "
    "summary, summary_persian, final_score, type").format(moment())

_EXISTING = """existing AS (
  SELECT content_id, count(*) AS n, list_sort(list(tag)) AS tags FROM links GROUP BY content_id)"""

_LAST_REPLY = """last_reply AS (
  SELECT content_id, text FROM replies
  QUALIFY row_number() OVER (PARTITION BY content_id ORDER BY seq DESC) = 1)"""


def _list_sql() -> str:
    req = LIST_REQUEST
    sources = ", ".join(text(s) for s in req.sources)
    hits = "\nUNION ALL\n".join(
        f"SELECT * FROM kept WHERE {found(c, req.title)}" for c in ("title_persian", "title"))
    return using("content", f"""
, matching AS {keyword_rows('*', req.pairs)},
kept AS (
  SELECT * FROM matching WHERE source IN ({sources})
    AND date BETWEEN TIMESTAMP '{req.start} 00:00:00' AND TIMESTAMP '{req.end} 00:00:00'),
hits AS ({hits})
SELECT id, {_CARD_TITLE} AS title, {moment()}, source, {_DOMAIN} AS domain, views,
  {_CARD_SUMMARY} AS summary, array_to_string(keywords, ', ') AS keywords
FROM hits""")


ORACLE: dict[str, str] = {
    "content_scan": using("content", f"SELECT {_CONTENT_COLUMNS} FROM content"),
    "schema_evolution": using("content", """
SELECT id, title, title_persian, summary_persian, views, type FROM content
UNION ALL SELECT id, title, NULL, NULL, views, type FROM content"""),
    "recent_articles": using(
        "content", f"SELECT id FROM content WHERE date >= {AS_OF} - INTERVAL 7 DAY"),
    "source_counts_last_week": using("content", f"""
SELECT source, count(*) AS articles FROM content
WHERE date >= {AS_OF} - INTERVAL 7 DAY AND source IS NOT NULL GROUP BY source"""),
    "daily_counts": using("content", """
SELECT CAST(CAST(date AS DATE) AS VARCHAR) AS day, count(*) AS articles
FROM content WHERE date IS NOT NULL GROUP BY 1"""),
    "facet_source": using("content", facet("source")),
    "facet_type": using("content", facet("type")),
    "facet_domain": using(
        "content", facet("domain", f"(SELECT {_DOMAIN} AS domain FROM content)")),
    "url_count": using("content", f"SELECT count(*) AS n FROM content WHERE url = {text(ONE_URL)}"),
    "article_by_url": using(
        "content", f"SELECT id, url FROM content WHERE url = {text(ONE_URL)} ORDER BY id LIMIT 1"),
    "url_stored": using(
        "content", f"SELECT count(*) > 0 AS stored FROM content WHERE url = {text(ONE_URL)}"),
    "title_search_bag": using("content", "\nUNION ALL\n".join(
        f"SELECT id, title, title_persian FROM content WHERE {found(c, TITLE_PATTERN)}"
        for c in ("title_persian", "title"))),
    "title_search_any": using("content", f"""
SELECT id, title, title_persian FROM content
WHERE {found('title_persian', TITLE_PATTERN)} OR {found('title', TITLE_PATTERN)}"""),
    "content_search_bag": using("content", "\nUNION ALL\n".join(
        f"SELECT id FROM content WHERE {found(c, 'heitung|ntthe|éreaux')}"
        for c in ("content_persian", "content"))),
    "source_filter": using(
        "content", "SELECT id, source FROM content WHERE source IN ('src1', 'src7', 'src19')"),
    "date_range": using("content", """
SELECT id FROM content
WHERE date >= TIMESTAMP '2024-01-05 00:00:00' AND date <= TIMESTAMP '2024-01-10 00:00:00'"""),
    "date_range_whole_day": using("content", """
SELECT id FROM content
WHERE date >= TIMESTAMP '2024-01-05 00:00:00' AND date < TIMESTAMP '2024-01-11 00:00:00'"""),
    "domain_filter": using("content", f"""
SELECT id, url, {_DOMAIN} AS domain FROM content WHERE {_DOMAIN} = 'example.net'"""),
    "type_filter": using("content", "SELECT id, type FROM content WHERE type = 'purchase'"),
    "article_by_id": using("content", "SELECT id, title, url, author FROM content WHERE id = 42"),
    "translation_backlog": using(
        "content", "SELECT id FROM content WHERE content_persian IS NULL OR content_persian = ''"),
    **{f"sort_{column}_{way}": using("content", f"""
SELECT id, {moment()}, title_persian, source, final_score FROM content
ORDER BY {column} {way} NULLS LAST, id""") for column in SORT_COLUMNS for way in ("asc", "desc")},
    "html_clean_text": using("content", f"SELECT id, {clean('content')} AS text FROM content"),
    "keyword_counts": using("content", f"""
SELECT id, {count('t', 'the')} AS n_the, {count('t', 'èr')} AS n_accented,
  {count('t', '')} AS n_empty,
  CASE WHEN t = '' THEN 1 ELSE
    (length(t) - length(replace(t, substr(t, 1, 2), ''))) // greatest(length(substr(t, 1, 2)), 1)
  END AS n_own_start
FROM (SELECT id, lower({clean('content')}) AS t FROM content)"""),
    "keyword_match": using("content", f"""
SELECT id, array_to_string(keywords, ', ') AS keywords FROM {keyword_rows('id', PAIRS)}"""),
    "keyword_match_default": using("content", f"""
SELECT id, array_to_string(keywords, ', ') AS keywords FROM {keyword_rows('id', [('', 1)])}"""),
    "keyword_match_many": using("content", f"""
SELECT id, array_to_string(keywords, ', ') AS keywords FROM {keyword_rows('id', MANY_PAIRS)}"""),
    "html_blocks": blocks(_SHOWN),
    "html_blocks_unclosed": blocks(
        f"regexp_replace({_SHOWN}, '(?i)</(p|ul|blockquote|li)\\s*>', '', 'g')", _OPEN_ITEMS),
    "registered_domain": f"SELECT page_id, url, {domain()} AS domain FROM pages",
    "registered_domain_table": f"SELECT page_id, url, {domain()} AS domain FROM pages",
    "registered_domain_kinds": "WITH kinds AS (SELECT * FROM (VALUES "
        + ", ".join(f"({i}, '{name}', '{found}')" for i, (name, found) in enumerate(HOST_KINDS))
        + f""") k(k, name, domain))
SELECT page_id, 'https://' || name || '/' || page_id AS url, domain
FROM pages JOIN kinds ON page_id % {len(HOST_KINDS)} = k""",
    "url_host": f"SELECT page_id, {_HOST} AS host FROM pages",
    "content_tag_rows": using("links", "SELECT content_id, tag FROM links"),
    "tag_lines": using("links", """
SELECT content_id, array_to_string(list_sort(list(tag)), ' ,') AS tag_line
FROM links GROUP BY content_id"""),
    "tag_get_or_create": using("old_tags", """
, known AS (
  SELECT * FROM old_tags UNION ALL
  SELECT (SELECT max(id) FROM old_tags) + row_number() OVER (ORDER BY tag), tag
  FROM (SELECT DISTINCT tag FROM wanted WHERE tag NOT IN (SELECT tag FROM old_tags)))
SELECT content_id, pos, w.tag, k.id AS tag_id FROM wanted w JOIN known k ON k.tag = w.tag"""),
    "content_tag_links": using(
        "links", "SELECT content_id, tag_id FROM links WHERE lang NOT IN ('en', 'de')"),
    "surrogate_ids": using("content", """
SELECT id AS doc, 1000 + row_number() OVER (ORDER BY date DESC NULLS LAST, id) AS id
FROM content"""),
    "orphan_images": using("content images", """
SELECT content_id, image_url FROM images i
WHERE NOT EXISTS (SELECT 1 FROM content c WHERE c.id = i.content_id AND c.type <> 'error')"""),
    "cascade_delete": using("content images", """
SELECT content_id, image_url FROM images
WHERE content_id NOT IN (SELECT id FROM content WHERE type = 'error')"""),
    "translations_applied": using("content", """
, latest AS (
  SELECT conv_id, text FROM conversations WHERE role = 'assistant'
  QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) = 1)
SELECT id, title, CASE WHEN conv_id IS NOT NULL THEN text ELSE content_persian END
  AS content_persian, views
FROM content LEFT JOIN latest ON conv_id = id"""),
    "translations_stored": using("content", """
, latest AS (
  SELECT conv_id, arg_max(text, turn) AS text FROM conversations WHERE role = 'assistant' GROUP BY conv_id)
SELECT id, title, CASE WHEN id IN (SELECT conv_id FROM latest) THEN (SELECT text FROM latest WHERE conv_id = id)
  ELSE content_persian END AS content_persian, views FROM content"""),
    "generated_tags_stored": using("content old_tags replies", f"""
, {_LAST_REPLY},
old_links AS (SELECT DISTINCT w.content_id, w.tag FROM wanted w WHERE w.tag IN (SELECT tag FROM old_tags)),
items AS (
  SELECT c.id, (SELECT count(*) FROM old_links o WHERE o.content_id = c.id) AS n, r.text
  FROM content c JOIN last_reply r ON r.content_id = c.id WHERE c.type = 'view'),
generated AS (
  SELECT id AS content_id, unnest(list_slice([trim(x, {_STRIP}) FOR x IN string_split(coalesce(text, ''), ',')
    IF trim(x, {_STRIP}) <> ''], 1, 7 - n)) AS tag FROM items WHERE n < 7)
SELECT DISTINCT content_id, tag FROM generated WHERE length(tag) <= 255
EXCEPT SELECT content_id, tag FROM old_links"""),
    "under_tagged": using("content links", """
SELECT id, n AS n_tags, 7 - n AS to_generate FROM (
  SELECT c.id, count(l.tag_id) AS n FROM content c LEFT JOIN links l ON l.content_id = c.id
  GROUP BY c.id) WHERE n < 7"""),
    "tag_quota": using(
        "tag_lists", "SELECT content_id, greatest(7 - len(tags), 0) AS quota FROM tag_lists"),
    "ingest_content": using("added", f"""
SELECT id,
  CASE WHEN is_full THEN title ELSE coalesce(title, '') END AS title,
  CASE WHEN is_full THEN title_persian ELSE coalesce(title_persian, '') END AS title_persian,
  {moment()},
  CASE WHEN is_full THEN content ELSE coalesce(content, '') END AS content,
  '' AS content_persian, url, author, views, source,
  CASE WHEN is_full THEN summary ELSE coalesce(summary, '') END AS summary,
  CASE WHEN is_full THEN summary_persian ELSE coalesce(summary_persian, '') END AS summary_persian,
  CASE WHEN is_full THEN final_score ELSE coalesce(final_score, 0) END AS final_score,
  coalesce(type, 'News') AS type
FROM added"""),
    "ingest_tags": using("added_tags", "SELECT id, tag FROM added_tags"),
    "ingest_links": using("added_tags", """
, old_links AS (
  SELECT DISTINCT w.content_id, t.id AS tag_id FROM wanted w JOIN old_tags t ON t.tag = w.tag),
known AS (SELECT * FROM old_tags UNION ALL SELECT * FROM added_tags)
SELECT a.id AS content_id, k.id AS tag_id FROM added_wanted a JOIN known k ON k.tag = a.tag
EXCEPT SELECT content_id, tag_id FROM old_links"""),
    "ingest_rejects": using(
        "judged", "SELECT seq, reject_reason FROM judged WHERE reject_reason IS NOT NULL"),
    "ingest_tag_rejects": using("added", """
SELECT id AS content_id, len(tags) AS pos,
  CASE WHEN seq % 17 = 0 THEN 'tag_missing' ELSE 'tag_too_long' END AS reject_reason,
  CASE WHEN seq % 17 <> 0 THEN 256 END AS n_chars
FROM added WHERE tags IS NOT NULL AND (seq % 17 = 0 OR seq % 23 = 0)"""),
    "ingest_counts": using("added_tags", """
, old_links AS (
  SELECT DISTINCT w.content_id, t.id AS tag_id FROM wanted w JOIN old_tags t ON t.tag = w.tag),
known AS (SELECT * FROM old_tags UNION ALL SELECT * FROM added_tags),
new_links AS (
  SELECT a.id AS content_id, k.id AS tag_id FROM added_wanted a JOIN known k ON k.tag = a.tag
  EXCEPT SELECT content_id, tag_id FROM old_links)
SELECT 'content' AS name, NULL AS reason, count(*) AS rows, max(id) AS highest FROM added
UNION ALL SELECT 'tags', NULL, count(*), max(id) FROM added_tags
UNION ALL SELECT 'content_tags', NULL, count(*), NULL FROM new_links
UNION ALL SELECT 'rejected', reject_reason, count(*), NULL FROM judged
  WHERE reject_reason IS NOT NULL GROUP BY reject_reason
UNION ALL SELECT 'content', 'url_repeated', n, NULL FROM (
  SELECT (SELECT count(*) FROM judged WHERE reject_reason IS NULL) - (SELECT count(*) FROM added) AS n) WHERE n > 0
UNION ALL SELECT 'rejected_tags', CASE WHEN seq % 17 = 0 THEN 'tag_missing' ELSE 'tag_too_long' END, count(*), NULL
  FROM added WHERE tags IS NOT NULL AND (seq % 17 = 0 OR seq % 23 = 0) GROUP BY ALL"""),
    "url_new": using("fresh", "SELECT seq, url FROM fresh"),
    "url_new_any_case": using("judged", """
, mixed AS (
  SELECT seq, CASE WHEN seq % 3 = 0 THEN upper(url) ELSE url END AS url FROM judged WHERE reject_reason IS NULL),
firsts AS (SELECT *, row_number() OVER (PARTITION BY lower(url) ORDER BY seq) AS copy FROM mixed)
SELECT seq, url FROM firsts WHERE url IS NULL OR (copy = 1 AND lower(url) NOT IN (
  SELECT lower(url) FROM content WHERE type = 'view' AND url IS NOT NULL))"""),
    "tag_get_or_create_any_case": using("old_tags", """
, mixed AS (
  SELECT content_id, pos, CASE WHEN content_id % 3 = 0 THEN upper(tag) ELSE tag END AS tag FROM wanted),
spelled AS (
  SELECT lower(tag) AS low, min(encode(tag)) AS spelling FROM mixed
  WHERE lower(tag) NOT IN (SELECT tag FROM old_tags) GROUP BY lower(tag)),
known AS (
  SELECT id, tag FROM old_tags UNION ALL
  SELECT (SELECT max(id) FROM old_tags) + row_number() OVER (ORDER BY spelling), low FROM spelled)
SELECT content_id, pos, m.tag, k.id AS tag_id FROM mixed m JOIN known k ON k.tag = lower(m.tag)"""),
    "url_seen": using("judged", """
SELECT seq, url FROM judged WHERE reject_reason IS NULL
  AND url IN (SELECT url FROM content WHERE type = 'view' AND url IS NOT NULL)"""),
    "tag_prompts": using("content links", f"""
, {_EXISTING}
SELECT id AS content_id, quota,
  {filled(TAG_PROMPT, 'quota', 'body', "array_to_string(tags, ', ')").replace(
      "'None'", "''")} AS prompt
FROM (
  SELECT id, 7 - coalesce(n, 0) AS quota, {_BODY} AS body, tags
  FROM content LEFT JOIN existing ON content_id = id)
WHERE quota > 0 AND body <> ''"""),
    "tag_results": using("tag_lists replies", f"""
, {_LAST_REPLY}
SELECT t.content_id, array_to_string(list_concat(t.tags, list_slice(
    [trim(x, {_STRIP}) FOR x IN string_split(coalesce(r.text, ''), ',')
      IF trim(x, {_STRIP}) <> ''], 1, greatest(7 - len(t.tags), 0))), '|') AS tags
FROM tag_lists t LEFT JOIN last_reply r ON r.content_id = t.content_id"""),
    "translation_prompts": using("content", f"""
SELECT id AS content_id, {filled(TRANSLATION_PROMPT, "'en'", "'fa'", _BODY)} AS prompt
FROM content WHERE (content_persian IS NULL OR content_persian = '') AND {_BODY} <> ''"""),
    "translation_updates": using("replies", f"""
SELECT content_id, seq, trim(text, {_STRIP}) AS translation FROM replies
WHERE trim(text, {_STRIP}) <> ''"""),
    "article_prompts": using("content", f"""
, matching AS {keyword_rows('*', PAIRS)}
SELECT id AS content_id, {filled(
    ARTICLE_PROMPT, text(SITE), "array_to_string(keywords, ', ')", 'title_persian', 'source',
    'url', '''CASE WHEN date IS NULL THEN 'NaT'
      WHEN date_trunc('second', date) = date THEN strftime(date, '%Y-%m-%d %H:%M:%S')
      ELSE strftime(date, '%Y-%m-%d %H:%M:%S.%f') END''', _BODY)} AS prompt
FROM matching"""),
    "generated_articles": using("replies", f"""
SELECT content_id, seq, trim(text, {_STRIP}) AS article FROM replies
WHERE trim(text, {_STRIP}) <> '' AND trim(text, {_STRIP}) <> 'No Article'"""),
    "image_prompts": using("content", f"""
SELECT content_id, image_no, {filled(IMAGE_PROMPT, 'body')} AS prompt FROM (
  SELECT id AS content_id, unnest([1, 2]) AS image_no,
    coalesce(nullif({_SUMMARY}, ''), nullif(title_persian, ''), {_BODY}) AS body FROM content)
WHERE body <> ''"""),
    "image_urls": """SELECT page_id AS content_id, 0 AS seq, url FROM pages
WHERE page_id % 11 <> 0 AND page_id % 7 <> 0 AND page_id % 5 <> 0 AND url <> ''""",
    "string_urls": using("content", """
SELECT id, len(urls) AS n_urls, array_to_string(urls, ' ') AS urls
FROM (SELECT id, [x FOR x IN [url, source, url] IF x IS NOT NULL] AS urls FROM content)"""),
    "image_insert": using("images", """
SELECT 500 + row_number() OVER (ORDER BY content_id, image_url) AS id, content_id, image_url,
  octet_length(encode(image)) AS n_bytes
FROM images WHERE image <> ''"""),
    "image_files": """
SELECT page AS content_id, sha256(bytes) AS digest, octet_length(encode(bytes)) AS n_bytes FROM (
  SELECT page_id // 50 AS page, string_agg(html, chr(10) ORDER BY page_id) || chr(10) AS bytes
  FROM pages WHERE html IS NOT NULL GROUP BY ALL)""",
    "images_of_item": using("images", "SELECT image FROM images WHERE content_id = 7 AND image <> ''"),
    "images_by_item": using("content images", """
SELECT id, image FROM content
LEFT JOIN (SELECT * FROM images WHERE image <> '') ON content_id = id"""),
    "split_lists": f"""
SELECT doc_id,
  array_to_string([trim(x, {_STRIP}) FOR x IN string_split(text, ',')
    IF trim(x, {_STRIP}) <> ''], '|') AS entries,
  len(string_split(text, ',')) AS n_all
FROM documents""",
    "stripped_text": f"""
SELECT doc_id, trim(text, {_STRIP}) AS text FROM documents""",
    "text_fallbacks": using("content", f"""
SELECT id, {_CARD_TITLE} AS title, substr(coalesce(summary, ''), 1, 200) || '...' AS summary,
  coalesce(nullif(content_persian, ''), nullif(summary_persian, ''), title) AS three_way
FROM content"""),
    "article_cards": using("content", f"""
SELECT id, {_CARD_TITLE} AS title, {moment()}, source, {_DOMAIN} AS domain, views,
  {_CARD_SUMMARY} AS summary FROM content"""),
    "article_details": using("content", f"""
SELECT id, {_CARD_TITLE} AS title, coalesce(nullif(summary_persian, ''), summary) AS summary,
  {_BODY} AS content, title_persian AS title_api, {_SUMMARY} AS summary_api, {moment()}, source,
  {_DOMAIN} AS domain, author, views, final_score, type FROM content"""),
    "news_list": _list_sql(),
    "news_list_site": using("content", f"""
SELECT id, {_CARD_TITLE} AS title, {moment()}, source, {_DOMAIN} AS domain, views,
  {_CARD_SUMMARY} AS summary
FROM content WHERE {_DOMAIN} = 'example.com' AND type = 'click'"""),
}
