"""Queries of page heads: tags of whole pages, sanitised heads, JSON-LD, head entries, imported snippets."""

from __future__ import annotations

from pyspark.sql import functions as F

from dealforge.functions import head
from dealforge.plans.registry import query
from dealforge.sources.catalogue import base_table


def _over(columns: str):
    """(the query's input, its SQL as `t`) of one SELECT over pages, in the common subset of both."""
    parts = [c.rstrip(",") for c in columns.splitlines()]
    return (lambda spark, d: base_table(spark, d, "pages").selectExpr(*parts)), lambda rest: f"with t as (select {columns} from pages) {rest}"


_TITLE = "regexp_extract(html, '<title>([^<]*)</title>', 1)"
_SCRIPT = "regexp_extract(html, '<script>[^<]*</p>[^<]*</script>', 0)"
# What is pasted: a title as meta, scripts with an address, a page's own script and menu, a link, text, and faulty tags.
_PASTED = f"""page_id,
url,
{_TITLE} as title,
{_SCRIPT} as script,
case page_id % 9 when 0 then concat(' <meta name="title" content="', {_TITLE}, '"> ') when 1 then concat('<script async src=https://cdn.example/', cast(page_id as string), '.js></script>') when 2 then {_SCRIPT} when 3 then regexp_extract(html, '<nav>.*</nav>', 0) when 4 then concat('<LINK Rel=canonical href="', url, '">') when 5 then concat('x', {_TITLE}, 'x') when 6 then concat('<!-- ', cast(page_id as string), ' --><meta property="og:url" content="', url, '"/><script>go()</script>') when 7 then concat('<script>open(', cast(page_id as string), ')') else '  ' end as pasted,
case when page_id % 2 = 0 then 'verification' else 'analytics' end as section,
case when page_id % 5 = 0 then concat(' P', cast(page_id as string), ' ') end as provider"""
_pages, _sql = _over(_PASTED)
_WHOLE, _WHOLE_SQL = _over("page_id,\nhtml")


@query(_WHOLE_SQL(r""", u as (select page_id, regexp_replace(html, '(?is)<script[^>]*>.*?</script>', '<script>', 'g') as rest, regexp_extract_all(html, '(?is)<script[^>]*>(.*?)</script>', 1) as inner_ from t)
 select page_id, len(regexp_extract_all(rest, '<[a-zA-Z][^>]*>'))::int as tags, len(inner_)::int as scripts, list_sum([length(x) for x in inner_])::bigint as script_chars,
 len(list_distinct(regexp_extract_all(rest, '<([a-zA-Z][a-zA-Z0-9]*)', 1)))::int as names, len(regexp_extract_all(rest, ' href="[^"]*"'))::int as links from u"""))
def page_tags(spark, d):
    """X42's tokens over the whole HTML of every page."""
    found = _WHOLE(spark, d).select("page_id", head.tokens(F.col("html"), head.HEAD_TOKENS, True).alias("all")).withColumn("all", F.filter("all", lambda t: t["tag"] != ""))
    inner = F.transform(F.filter("all", lambda t: t["closed"]), lambda t: F.length(t["children"]))
    links = F.filter(F.flatten("all.pairs"), lambda p: p["key"] == "href")
    return found.select(
        "page_id", F.size("all").alias("tags"), F.size(inner).alias("scripts"), F.aggregate(inner, F.lit(0).cast("long"), lambda a, x: a + x).alias("script_chars"),
        F.size(F.array_distinct("all.tag")).alias("names"), F.size(links).alias("links"),
    )


_ESCAPED = "replace(replace(replace(replace({}, '&', '&amp;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;')"


@query(_sql(f"""select page_id, page_id % 9 in (0, 1, 4, 6) as ok,
 case page_id % 9 when 2 then 'Malformed HTML: unexpected closing tag.' when 3 then 'Tag <nav> is not allowed in the head. Allowed: meta, link, script.' when 5 then 'Malformed HTML: stray content after the last tag.'
 when 7 then 'Malformed HTML: unclosed <script> tag.' when 8 then 'HTML content is empty.' end as error,
 case page_id % 9 when 0 then '<meta name="title" content="' || {_ESCAPED.format('title')} || '">' when 1 then '<script async src="https://cdn.example/' || page_id || '.js"></script>'
 when 4 then '<link rel="canonical" href="' || {_ESCAPED.format('url')} || '">' when 6 then '<meta property="og:url" content="' || {_ESCAPED.format('url')} || '">' || chr(10) || '<script>go()</script>' end as html from t"""))
def head_sanitized(spark, d):
    """What may go into a head, rendered, or why not."""
    r = _pages(spark, d).select("page_id", head.sanitize_head(F.col("pasted")).alias("r"))
    return r.select("page_id", "r.ok", "r.error", F.array_join(F.transform("r.tags", head.serialize_tag), "\n").alias("html"))


@query(_sql("""select page_id, page_id % 9 <> 8 and page_id % 9 <> 5 and page_id % 9 <> 7 as ok,
 case page_id % 9 when 5 then 'No HTML tags found in the snippet.' when 7 then 'No HTML tags found in the snippet.' when 8 then 'Paste a snippet first.' end as error,
 case when page_id % 9 in (0, 1, 4) and not (page_id % 9 = 1 and page_id % 2 = 0) and not (page_id % 9 = 4 and page_id % 2 = 1) then 'structured' when page_id % 9 not in (5, 7, 8) then 'raw' end as mode,
 case page_id % 9 when 0 then case when page_id % 2 = 0 then 'Parsed as a verification meta tag.' else 'Parsed as an analytics meta tag.' end
 when 1 then case when page_id % 2 = 1 then 'Parsed as an external analytics script entry.' else 'Script tag carries attributes the structured renderer would alter — stored raw to preserve them exactly.' end
 when 2 then 'Snippet contains inline JavaScript — stored raw so it is preserved byte-for-byte.' when 3 then '<nav> is stored raw.'
 when 4 then case when page_id % 2 = 0 then 'Parsed as a verification link tag.' else 'Link tag stored raw so every attribute is preserved.' end
 when 6 then 'Snippet contains multiple tags — stored raw.' end as reason,
 case when page_id % 9 not in (5, 7, 8) then case when page_id % 5 = 0 then 'P' || page_id when page_id % 9 = 0 or page_id % 18 = 1 or page_id % 18 = 4 then 'Custom'
 when page_id % 9 = 1 or page_id % 9 = 2 then 'script' when page_id % 9 = 3 then 'nav' when page_id % 9 = 4 then 'link' else 'meta' end end as provider,
 case when page_id % 9 = 0 then 'title' when page_id % 18 = 4 then 'canonical' when page_id % 9 not in (5, 7, 8) then '' end as name,
 case when page_id % 9 = 0 then title when page_id % 18 = 1 then 'https://cdn.example/' || page_id || '.js' when page_id % 18 = 4 then url end as value,
 case when page_id % 9 not in (0, 5, 7, 8) and page_id % 18 not in (1, 4) then trim(pasted) end as content,
 case when page_id % 9 not in (5, 7, 8) then trim(pasted) end as original from t"""))
def head_snippets(spark, d):
    """Pasted snippets as payloads of head entries; the snippet comes back from the notes."""
    r = _pages(spark, d).select("page_id", head.parse_snippet(F.col("pasted"), F.col("section"), F.col("provider"), F.lit("note")).alias("r"))
    p = F.col("r.payload")
    return r.select("page_id", "r.ok", "r.error", "r.mode", "r.reason", *[p[k].alias(k) for k in ("provider", "name", "value", "content")], head.original_snippet(p["notes"]).alias("original"))


# JSON texts around a page's address: an object, a list, an object without a type, no object inside, no JSON, two values, nothing.
_json, _json_sql = _over(
    """page_id,
url,
case page_id % 8 when 0 then concat(' { "@type" : "Page", "url": "', url, '" } ') when 1 then concat('[{"@context": null, "a b": [1, 2.50]}, {"@type":"<b>", "n": ', cast(page_id as string), '}]') when 2 then concat('{"url": "', url, '"}') when 3 then '[{"@type":"A"}, 7]' when 4 then concat('{"@type": ', url) when 5 then '{"@type":"A"} {"@type":"B"}' when 6 then cast(page_id as string) else '  ' end as raw""",
)


@query(_json_sql(r"""select page_id, page_id % 8 < 2 as ok, case page_id % 8 when 2 then 'JSON-LD must include @context or @type.' when 3 then 'Each JSON-LD item must be an object.' when 4 then 'Invalid JSON: it cannot be parsed.'
 when 5 then 'Invalid JSON: it cannot be parsed.' when 6 then 'JSON-LD must be an object or an array of objects.' when 7 then 'JSON-LD content is empty.' end as error,
 case page_id % 8 when 0 then '{"@type":"Page","url":"' || url || '"}' when 1 then '[{"@context":null,"a b":[1,2.50]},{"@type":"\u003cb>","n":' || page_id || '}]' end as json from t"""))
def json_ld(spark, d):
    """X41."""
    r = _json(spark, d).select("page_id", head.validate_json_ld(F.col("raw")).alias("r"))
    return r.select("page_id", "r.ok", "r.error", "r.json")


# Head entries of all sections; names and providers repeat, every seventh entry is off.
_entries, _entries_sql = _over(
    """page_id as seq,
url,
case page_id % 4 when 0 then 'verification' when 1 then 'analytics' when 2 then 'structured_data' else 'custom_html' end as section,
case when page_id % 4 = 1 then concat('Net', cast(page_id % 37 as string)) end as provider,
'meta' as type,
case when page_id % 4 = 0 then concat('n', cast(page_id % 31 as string)) when page_id % 4 = 1 then 'k' end as name,
case when page_id % 4 < 2 then url end as value,
case page_id % 4 when 2 then concat('{"@type": "P", "n": ', cast(page_id as string), '}') when 3 then case when page_id % 3 = 0 then '<p>' else concat('<link rel=x href="/', cast(page_id % 50 as string), '">') end end as content,
page_id % 7 <> 3 as enabled""",
)
_MARKED = """, m as (select *, row_number() over (partition by section, case when enabled then coalesce(provider, name) else 'off ' || seq end order by seq) as nth from t),
 r as (select *, case when not enabled then 'Disabled' when section = 'verification' and nth > 1 then 'Duplicate verification tag "' || name || '".' when section = 'analytics' and nth > 1 then 'Duplicate analytics provider "' || provider || '".'
 when content = '<p>' then 'Tag <p> is not allowed in the head. Allowed: meta, link, script.' end as reason from m)"""


@query(_entries_sql(_MARKED + f""", k as (select *, row_number() over (partition by case when section = 'analytics' then 'k' when section = 'custom_html' then content else section || seq end order by seq) as again from r where reason is null)
 select seq, reason as outcome from r where reason is not null union all
 select seq, case section when 'structured_data' then '<script type="application/ld+json">{{"@type":"P","n":' || seq || '}}</script>' when 'custom_html' then '<link rel="x" href="/' || seq % 50 || '">'
 else '<meta name="' || name || '" content="' || {_ESCAPED.format('url')} || '">' end from k where again = 1"""))
def head_entries(spark, d):
    """The tag each entry renders, or why it is skipped."""
    tags, skipped = head.render_entries(_entries(spark, d).drop("url"), "seq")
    return skipped.select("seq", F.col("reason").alias("outcome")).unionByName(tags.select("seq", F.col("html").alias("outcome")))
