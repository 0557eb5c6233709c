"""Checking SQL: the same tables written a second time, in DuckDB SQL over the raw inputs.

`TABLES` holds named CTEs; a query's SQL is its own select plus the CTEs it reaches. The texts of
findings come from the shared catalog of fixed values; every condition is written here again.
"""

from __future__ import annotations

import re

from pagelens.functions.jsonld import REQUIREMENTS
from pagelens.functions.text import HARDEST_BAND, READABILITY_BANDS
from pagelens.operators import advanced, guides, keywords, reporting, structured, visibility
from pagelens.operators.catalog import ISSUES, JS, JS_NOTE, RULE_NUMBER, RULE_STRIDE
from pagelens.operators.extract import (
    GENERIC_ANCHORS, IMAGE_FORMATS, JS_INDICATORS, MIXED_PATTERNS, NEXT_GEN_FORMATS, SOFT_404_PATTERNS, SPA_MARKERS,
)
from pagelens.plans import derived
from pagelens.plans.dom_sql import DOM_ORACLES, DOM_TABLES
from pagelens.plans.snapshot import TARGET_STATUS

TAG_REST = r"""[^>"']*(?:(?:"[^"]*"|'[^']*')[^>"']*)*"""
ATTR = r"""([^\s"'<>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?"""
BLANKS = "' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12)"


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def qs(texts) -> str:
    return ", ".join(q(t) for t in texts)


def strip(e: str) -> str:
    return f"trim({e}, {BLANKS})"


# The character references that the derived pages hold; an ampersand is put in last.
_REFERENCES = [("&amp;", "\x01"), ("&#38;", "\x01"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&eacute;", "é"), ("&times;", "×"),
               ("&#xE9;", "é"), ("&#233;", "é"), ("&iacute;", "í"), ("&copy ", "© "), ("\x01", "&")]


def unescape(e: str) -> str:
    out = e
    for reference, char in _REFERENCES:
        out = f"replace({out}, {q(reference)}, {q(char)})"
    return f"CASE WHEN contains({e}, '&') THEN {out} ELSE {e} END"


def quoted_word(word: str) -> str:
    return "".join("\\" + ch if ch in r"\.^$|?*+()[]{}" else ch for ch in word)


def words(texts) -> str:
    return q("|".join(quoted_word(t) for t in texts))


def attr(name: str) -> str:
    """Decoded value of an attribute, from columns `names` and `vals` (raw, with quotes)."""
    raw = f"vals[list_position(names, {q(name)})]"
    bare = f"CASE WHEN {raw}[1] IN ('\"', '''') THEN {raw}[2:-2] ELSE {raw} END"
    return f"({unescape('(' + bare + ')')})"


def fill(template: str, *exprs: str) -> str:
    parts = template.split("{}")
    assert len(parts) == len(exprs) + 1, template
    out = [q(parts[0])]
    for e, tail in zip(exprs, parts[1:]):
        out += [f"coalesce(CAST({e} AS VARCHAR), '')", q(tail)]
    return "(" + " || ".join(out) + ")"


def tag_table(name: str, source: str = "clean") -> str:
    pattern = q(rf"(?is)<{name}\b({TAG_REST})>")
    return f"""
        SELECT ord, n, body, list_transform(regexp_extract_all(body, {q(ATTR)}, 1), lambda x: lower(x)) AS names,
               regexp_extract_all(body, {q(ATTR)}, 2) AS vals, '<{name}' || body || '>' AS raw
        FROM (SELECT ord, unnest(b) AS body, generate_subscripts(b, 1) AS n
              FROM (SELECT ord, regexp_extract_all({source}, {pattern}, 1) AS b FROM doc))"""


def url_part(url: str, n: int) -> str:
    return f"regexp_extract({url}, {q(r'^(([A-Za-z][A-Za-z0-9+.-]*):)?(//([^/?#]*))?([^?#]*)([?]([^#]*))?(#(.*))?')}, {n})"


def absolute(base: str, ref: str) -> str:
    """Reference resolution for the reference forms that the derived pages use."""
    scheme, host, path = url_part(base, 2), url_part(base, 4), url_part(base, 5)
    root = f"{scheme} || '://' || {host}"
    folder = f"coalesce(nullif(regexp_replace({path}, '[^/]*$', ''), ''), '/')"
    parent = f"coalesce(nullif(regexp_replace({folder}, '[^/]*/$', ''), ''), '/')"
    return f"""CASE WHEN {ref} IS NULL THEN NULL WHEN regexp_matches({ref}, '^[a-z]+://') THEN {ref}
        WHEN starts_with({ref}, '//') THEN {scheme} || ':' || {ref} WHEN starts_with({ref}, '/') THEN {root} || {ref}
        WHEN starts_with({ref}, '?') THEN {root} || {path} || {ref}
        WHEN starts_with({ref}, '#') THEN {root} || {path} || {url_part(base, 6)} || {ref}
        WHEN regexp_matches({ref}, '^[a-z]+:') THEN {ref}
        WHEN starts_with({ref}, '../') THEN {root} || {parent} || substr({ref}, 4)
        WHEN {ref} = '../up' THEN {root} || {parent} || 'up'
        WHEN starts_with({ref}, './') THEN {root} || {folder} || substr({ref}, 3)
        ELSE {root} || {folder} || {ref} END"""


def same_site(host: str, base: str) -> str:
    return f"({host} = {base} OR ends_with({host}, '.' || {base}))"


def normalized(url: str) -> str:
    path = f"regexp_replace({url_part(url, 5)}, ';[^/]*$', '')"
    key = f"{url_part(url, 2)} || '://' || {url_part(url, 4)} || coalesce(nullif(rtrim({path}, '/'), ''), '/')"
    return f"regexp_replace({key}, '(?i)(?:index[.]html|index[.]htm|index[.]php|default[.]html)$', '')"


TABLES: dict[str, str] = {}

TABLES["crawl"] = f"SELECT {', '.join(derived.derived_select())} FROM pages"
TABLES["doc"] = r"""
    SELECT *, regexp_replace(html, '(?s)<!--.*?-->', '', 'g') AS uncommented,
        regexp_replace(html, '(?is)<!--.*?-->|<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>', '', 'g') AS clean,
        strlen(html) AS html_size_bytes, CASE WHEN ord % 3 <> 0 THEN strlen(html) // 4 END AS compressed_size
    FROM crawl"""
TABLES["meta"] = f"SELECT *, {attr('name')} AS name, {attr('property')} AS property, {attr('content')} AS content, {attr('http-equiv')} AS equiv FROM ({tag_table('meta')})"
TABLES["linktag"] = f"SELECT *, lower({attr('rel')}) AS rel, {attr('href')} AS href, {attr('hreflang')} AS hreflang FROM ({tag_table('link')})"
TABLES["og"] = f"""
    SELECT ord, key, arg_max(value, n) AS value FROM (
        SELECT ord, n, lower(coalesce(nullif(property, ''), name)) AS key, {strip('content')} AS value FROM meta WHERE coalesce(content, '') <> '')
    WHERE starts_with(key, 'og:') GROUP BY ord, key"""
TABLES["tw"] = f"""
    SELECT ord, key, arg_max(value, n) AS value FROM (
        SELECT ord, n, lower(coalesce(nullif(name, ''), property)) AS key, {strip('content')} AS value FROM meta WHERE coalesce(content, '') <> '')
    WHERE starts_with(key, 'twitter:') GROUP BY ord, key"""
TABLES["equiv"] = f"""
    SELECT ord, lower({strip('equiv')}) AS key, arg_max({strip('content')}, n) AS value FROM meta
    WHERE coalesce({strip('equiv')}, '') <> '' AND coalesce({strip('content')}, '') <> '' GROUP BY ord, key"""


def first_meta(name: str) -> str:
    return f"(SELECT ord, n, raw, nullif({strip('content')}, '') AS content FROM meta WHERE lower(name) = {q(name)} QUALIFY row_number() OVER (PARTITION BY ord ORDER BY n) = 1)"


def first_link(cond: str) -> str:
    return f"(SELECT ord, nullif({strip('href')}, '') AS href FROM linktag WHERE {cond} QUALIFY row_number() OVER (PARTITION BY ord ORDER BY n) = 1)"


TABLES["heading_raw"] = rf"""
    SELECT ord, n, level, {strip(unescape('bare'))} AS text FROM (
        SELECT ord, n, CAST(l AS INTEGER) AS level, regexp_replace(b, '<[^>]*>', '', 'g') AS bare FROM (
            SELECT ord, unnest(ls) AS l, unnest(bs) AS b, generate_subscripts(ls, 1) AS n FROM (
                SELECT ord, regexp_extract_all(clean, {q(rf'(?is)<h([1-6])\b{TAG_REST}>(.*?)</h[1-6]\s*>')}, 1) AS ls,
                       regexp_extract_all(clean, {q(rf'(?is)<h([1-6])\b{TAG_REST}>(.*?)</h[1-6]\s*>')}, 2) AS bs FROM doc)))"""
TABLES["heading"] = "SELECT ord, CAST(row_number() OVER (PARTITION BY ord ORDER BY n) AS INTEGER) AS n, level, text FROM heading_raw WHERE text <> ''"
TABLES["script"] = rf"""
    SELECT ord, n, {strip('b')} AS data, '<script' || a || '>' || b || '</script>' AS raw,
           list_transform(regexp_extract_all(a, {q(ATTR)}, 1), lambda x: lower(x)) AS names, regexp_extract_all(a, {q(ATTR)}, 2) AS vals FROM (
        SELECT ord, unnest(ats) AS a, unnest(bs) AS b, generate_subscripts(ats, 1) AS n FROM (
            SELECT ord, regexp_extract_all(uncommented, {q(rf'(?is)<script\b({TAG_REST})>(.*?)</script\s*>')}, 1) AS ats,
                   regexp_extract_all(uncommented, {q(rf'(?is)<script\b({TAG_REST})>(.*?)</script\s*>')}, 2) AS bs FROM doc))"""
_REQ = " ".join(f"WHEN contains(lower(ty), {q(k)}) THEN [{qs(r)}]::VARCHAR[]" for k, r, _ in REQUIREMENTS)
_REC = " ".join(f"WHEN contains(lower(ty), {q(k)}) THEN [{qs(r)}]::VARCHAR[]" for k, _, r in REQUIREMENTS)
_KNOWN = " OR ".join(f"contains(lower(ty), {q(k)})" for k, _, _ in REQUIREMENTS)
TABLES["json_ld"] = f"""
    SELECT *, coalesce(list_filter(CASE {_REQ} END, lambda p: NOT list_contains(keys, p)), []) AS missing,
              coalesce(list_filter(CASE {_REC} END, lambda p: NOT list_contains(keys, p)), []) AS recommended,
              coalesce({_KNOWN}, false) AS known FROM (
        SELECT ord, n, raw, data, json_valid(data) AS valid,
            CASE WHEN json_valid(data) AND data[1] = '{{' THEN nullif(json_extract_string(data, '$."@type"'), '') END AS ty,
            CASE WHEN json_valid(data) AND data[1] = '{{' THEN json_extract_string(data, '$."@context"') END AS context,
            CASE WHEN json_valid(data) AND data[1] = '{{' THEN json_extract_string(data, '$."@id"') END AS schema_id,
            CASE WHEN json_valid(data) AND data[1] = '{{' THEN json_keys(data) END AS keys,
            CASE WHEN json_valid(data) AND data[1] = '[' THEN list_filter(json_extract_string(data, '$[*]."@type"'), lambda t: t IS NOT NULL) END AS list_types
        FROM script WHERE {attr('type')} = 'application/ld+json' AND data <> '')"""
TABLES["anchor"] = rf"""
    SELECT ord, n, regexp_extract(p, {q(rf'(?is)^({TAG_REST})>(.*?)(?:</a\s*>|\z)')}, 1) AS body,
           regexp_extract(p, {q(rf'(?is)^({TAG_REST})>(.*?)(?:</a\s*>|\z)')}, 2) AS inner_html FROM (
        SELECT ord, unnest(ps) AS p, generate_subscripts(ps, 1) AS n FROM (
            SELECT ord, string_split_regex(clean, '(?i)<a\b')[2:] AS ps FROM doc))"""
TABLES["anchor_at"] = f"""
    SELECT ord, n, inner_html, {strip(attr('href'))} AS href, {attr('rel')} AS rel_raw, {attr('target')} AS target FROM (
        SELECT *, list_transform(regexp_extract_all(body, {q(ATTR)}, 1), lambda x: lower(x)) AS names, regexp_extract_all(body, {q(ATTR)}, 2) AS vals FROM anchor)"""
_IMG_IN_A = rf"(?is)<img\b({TAG_REST})>"
TABLES["link_all"] = f"""
    SELECT ord, n, link_url, split_part(link_url, '#', 1) AS key, inner_html, rel_raw, target, base_url FROM (
        SELECT a.*, c.url AS base_url, {absolute('c.url', 'a.href')} AS link_url
        FROM anchor_at a JOIN crawl c USING (ord)
        WHERE coalesce(a.href, '') <> '' AND NOT starts_with(a.href, '#') AND NOT regexp_matches(a.href, '(?i)^(javascript:|mailto:|tel:|sms:|data:)'))"""
TABLES["link_named"] = f"""
    SELECT ord, CAST(n AS INTEGER) AS n, link_url, key, target, base_url, {url_part('base_url', 4)} AS base_host,
        coalesce(nullif({strip(unescape("bare"))}, ''), nullif({strip(attr('alt'))}, ''), '[Empty Anchor Text]') AS text,
        nullif(regexp_replace({strip('rel_raw')}, '\\s+', ' ', 'g'), '') AS rel FROM (
        SELECT *, regexp_replace(inner_html, '<[^>]*>', '', 'g') AS bare,
            list_transform(regexp_extract_all(regexp_extract(inner_html, {q(_IMG_IN_A)}, 1), {q(ATTR)}, 1), lambda x: lower(x)) AS names,
            regexp_extract_all(regexp_extract(inner_html, {q(_IMG_IN_A)}, 1), {q(ATTR)}, 2) AS vals
        FROM link_all QUALIFY row_number() OVER (PARTITION BY ord, key ORDER BY n) = 1)"""
TABLES["link"] = f"""
    SELECT l.ord, c.site, n, link_url, text, {same_site(url_part('link_url', 4), 'base_host')} AS is_internal, rel,
        coalesce(contains(lower(rel), 'nofollow'), false) AS is_nofollow, coalesce(contains(lower(rel), 'sponsored'), false) AS is_sponsored,
        coalesce(contains(lower(rel), 'ugc'), false) AS is_ugc, target, rtrim(key, '/') = rtrim(base_url, '/') AS is_self_referencing,
        CASE WHEN lower({strip('text')}) IN ('[empty anchor text]', '') THEN 'empty' WHEN lower({strip('text')}) IN ({qs(GENERIC_ANCHORS)}) THEN 'generic'
            WHEN regexp_matches(lower({strip('text')}), '^(http://|https://|www[.])') THEN 'naked-url'
            WHEN NOT regexp_matches(text, '\\s') AND lower(text) = upper(lower(text)) THEN 'brand' ELSE 'partial-match' END AS anchor_text_type
    FROM link_named l JOIN crawl c USING (ord)"""
TABLES["image_at"] = f"""
    SELECT i.ord, CAST(n AS INTEGER) AS n, raw, {strip("coalesce(nullif(" + attr('src') + ", ''), nullif(" + attr('data-src') + ", ''), nullif(" + attr('data-lazy-src') + ", ''), nullif(" + attr('data-original') + ", ''))")} AS ref,
        nullif({strip(attr('alt'))}, '') AS alt, {attr('width')} AS width, {attr('height')} AS height, {attr('loading')} AS loading, {attr('fetchpriority')} AS fetchpriority,
        coalesce({attr('data-src')}, '') <> '' OR coalesce({attr('data-lazy-src')}, '') <> '' AS lazy_attr FROM ({tag_table('img')}) i"""
_FMT = " ".join(f"WHEN ends_with(stem, {q(e)}) THEN {q(f)}" for e, f in IMAGE_FORMATS)
TABLES["image"] = f"""
    SELECT ord, site, n, src, alt, alt IS NULL AS is_missing_alt, CAST(coalesce(length(alt), 0) AS INTEGER) AS alt_text_length, width, height, loading,
        coalesce(loading = 'lazy', false) OR lazy_attr AS is_lazy_loaded, fetchpriority, format,
        coalesce(format IN ({qs(NEXT_GEN_FORMATS)}), false) AS is_next_gen_format, raw FROM (
        SELECT *, CASE {_FMT} END AS format FROM (
            SELECT *, lower(split_part(split_part(src, '?', 1), '#', 1)) AS stem FROM (
                SELECT i.*, c.site, {absolute('c.url', 'i.ref')} AS src FROM image_at i JOIN crawl c USING (ord) WHERE ref IS NOT NULL)))"""
TABLES["hreflang"] = f"""
    SELECT l.ord, c.site, c.url AS source_url, CAST(row_number() OVER (PARTITION BY l.ord ORDER BY l.n) - 1 AS INTEGER) AS n, {absolute('c.url', strip('l.href'))} AS target_url,
        split_part({strip('lower(l.hreflang)')}, '-', 1) AS language_code, nullif(split_part({strip('lower(l.hreflang)')}, '-', 2), '') AS country_code,
        {strip('lower(l.hreflang)')} = 'x-default' AS is_x_default
    FROM linktag l JOIN crawl c USING (ord) WHERE contains(l.rel, 'alternate') AND coalesce(l.hreflang, '') <> '' AND coalesce(l.href, '') <> ''"""


def directives(content: str, source: str, frm: str) -> str:
    return f"""
    SELECT ord, CAST(row_number() OVER (PARTITION BY ord ORDER BY i) - 1 AS INTEGER) AS n, lower({strip("split_part(d, ':', 1)")}) AS directive,
        CASE WHEN contains(d, ':') THEN {strip("regexp_replace(d, '^[^:]*:', '')")} END AS value, {q(source)} AS source FROM (
        SELECT ord, {strip('unnest(ps)')} AS d, generate_subscripts(ps, 1) AS i FROM (SELECT ord, string_split({content}, ',') AS ps FROM {frm})) WHERE d <> ''"""


TABLES["robots_meta"] = directives("content", "meta-robots", first_meta("robots"))
TABLES["robots_header"] = directives("h_robots", "x-robots-tag", "crawl")
TABLES["directive"] = "SELECT *, 0 AS src FROM robots_meta UNION ALL SELECT *, 1 AS src FROM robots_header"
TABLES["indexed"] = """
    SELECT ord, bool_or(directive = 'noindex') AS noindex, arg_min(source, src * 1000 + n) FILTER (directive = 'noindex') AS noindex_source,
        bool_or(directive = 'nofollow') AS nofollow, bool_or(directive = 'nosnippet') AS nosnippet,
        arg_max(TRY_CAST(value AS INTEGER), src * 1000 + n) FILTER (directive = 'max-snippet' AND TRY_CAST(value AS INTEGER) IS NOT NULL) AS max_snippet,
        arg_max(value, src * 1000 + n) FILTER (directive = 'max-image-preview' AND coalesce(value, '') <> '') AS max_image_preview
    FROM directive GROUP BY ord"""
TABLES["texts"] = f"""
    SELECT ord, CAST(len(ws) AS INTEGER) AS word_count, CAST(length(t) AS INTEGER) AS character_count,
        CAST(greatest(1, len(list_filter(string_split_regex(t, '[.!?]+'), lambda s: {strip('s')} <> ''))) AS INTEGER) AS sentence_count,
        CAST(coalesce(list_sum(list_transform(ws, lambda w: greatest(1, len(regexp_extract_all(lower(w), '[aeiouy]+'))))), 0) AS BIGINT) AS syllable_count FROM (
        SELECT ord, t, list_filter(string_split_regex(t, '\\s+'), lambda w: w <> '') AS ws FROM (
            SELECT ord, {strip("regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g')")} AS t FROM doc))"""
_MIXED = " || ".join(
    f"list_transform(regexp_extract_all(html, {q(p)}, 1), lambda m: {{'u': 'http://' || m, 't': {q(t)}}})" for p, t in MIXED_PATTERNS
)
TABLES["mixed"] = f"""
    SELECT ord, site, url AS page_url, CAST(generate_subscripts(ms, 1) AS INTEGER) AS n, unnest(ms).u AS resource_url, unnest(ms).t AS resource_type
    FROM (SELECT ord, site, url, ({_MIXED}) AS ms FROM doc WHERE starts_with(url, 'https://'))"""
_REL = {"icon": "contains(rel, 'icon')", "next": "contains(rel, 'next')", "prev": "contains(rel, 'prev')", "amp": "contains(rel, 'amphtml')"}
TABLES["page"] = f"""
    SELECT d.ord, d.site, d.url, d.status_code, d.crawl_depth, d.total_ms, d.ttfb_ms, d.html_size_bytes, d.compressed_size, d.h_hsts, d.h_csp, d.h_nosniff,
        d.h_frame, d.h_referrer, starts_with(d.url, 'https://') AS is_https,
        coalesce(nullif({strip(unescape(r"regexp_extract(d.clean, '(?is)<title\b[^>]*>(.*?)</title\s*>', 1)"))}, ''), ogt.value,
            json_extract_string(nullif(regexp_extract(d.html, '(?s)__NEXT_DATA__\\s*=\\s*(\\{{.*?\\}})\\s*(?:;|</script>)', 1), ''), '$.props.pageProps.title'),
            json_extract_string(nullif(regexp_extract(d.html, '(?s)__NUXT__\\s*=\\s*(\\{{.*?\\}})\\s*(?:;|</script>)', 1), ''), '$.head.title')) AS title,
        nullif(regexp_extract(d.clean, '(?is)<title\\b[^>]*>(.*?)</title\\s*>', 0), '') AS title_html,
        coalesce(md.content, ogd.value, json_extract_string(nullif(regexp_extract(d.html, '(?s)__NEXT_DATA__\\s*=\\s*(\\{{.*?\\}})\\s*(?:;|</script>)', 1), ''), '$.props.pageProps.description')) AS meta_description,
        md.raw AS meta_desc_html, mr.content AS meta_robots, mv.content AS viewport,
        coalesce(contains(lower(mv.content), 'width=device-width'), false) AS viewport_has_device_width,
        coalesce(NOT regexp_matches(lower(mv.content), 'user-scalable=no|maximum-scale=1|maximum-scale=0'), true) AS viewport_allows_scaling,
        nullif({strip('lang.lang')}, '') AS lang, coalesce(canon.n_tags, 0) > 1 AS multiple_canonicals, {absolute('d.url', 'canon.href')} AS canonical_url,
        CASE WHEN canon.href IS NOT NULL THEN NOT regexp_matches(canon.href, '^https?://') END AS canonical_is_relative,
        CASE WHEN canon.href IS NOT NULL THEN canon.raw END AS canonical_html,
        {absolute('d.url', 'icon.href')} AS favicon_url, {absolute('d.url', 'nx.href')} AS pagination_next, {absolute('d.url', 'pv.href')} AS pagination_prev,
        {absolute('d.url', 'am.href')} AS amp_url,
        regexp_matches(lower(d.html), {words(JS_INDICATORS)}) AS is_js_rendered,
        d.status_code = 200 AND regexp_matches(d.html, {q('(?i)' + '|'.join(SOFT_404_PATTERNS))}) AS is_soft_404,
        length(d.html) < 2000 OR regexp_matches(d.html, {words(SPA_MARKERS)}) AS is_spa_shell,
        coalesce(string_split(d.hist, '|'), []) AS history, coalesce(string_split(d.hist_codes, '|'), []) AS history_codes,
        coalesce(ix.noindex, false) AS noindex, ix.noindex_source, coalesce(ix.nofollow, false) AS nofollow, coalesce(ix.nosnippet, false) AS nosnippet,
        ix.max_snippet, ix.max_image_preview, ogt.value AS og_title, ogd.value AS og_description, ogi.value AS og_image, ogu.value AS og_url,
        twc.value AS tw_card, twt.value AS tw_title,
        coalesce((SELECT count(*) FROM og WHERE og.ord = d.ord), 0) AS n_og, coalesce((SELECT count(*) FROM tw WHERE tw.ord = d.ord), 0) AS n_tw,
        coalesce((SELECT count(*) FROM heading h WHERE h.ord = d.ord), 0) AS n_headings,
        coalesce((SELECT count(*) FROM heading h WHERE h.ord = d.ord AND level = 1), 0) AS h1_count,
        (SELECT arg_min(text, n) FROM heading h WHERE h.ord = d.ord AND level = 1) AS first_h1,
        t.word_count, t.character_count, t.sentence_count, t.syllable_count
    FROM doc d LEFT JOIN texts t USING (ord) LEFT JOIN indexed ix USING (ord)
    LEFT JOIN {first_meta('description')} md USING (ord) LEFT JOIN {first_meta('robots')} mr USING (ord) LEFT JOIN {first_meta('viewport')} mv USING (ord)
    LEFT JOIN (SELECT ord, {attr('lang')} AS lang FROM ({tag_table('html')}) WHERE n = 1) lang USING (ord)
    LEFT JOIN (SELECT ord, count(*) AS n_tags, arg_min(nullif({strip('href')}, ''), n) AS href, arg_min(raw, n) AS raw FROM linktag
               WHERE list_contains(string_split_regex(rel, '\\s+'), 'canonical') GROUP BY ord) canon USING (ord)
    LEFT JOIN {first_link(_REL['icon'])} icon USING (ord) LEFT JOIN {first_link(_REL['next'])} nx USING (ord)
    LEFT JOIN {first_link(_REL['prev'])} pv USING (ord) LEFT JOIN {first_link(_REL['amp'])} am USING (ord)
    LEFT JOIN og ogt ON ogt.ord = d.ord AND ogt.key = 'og:title' LEFT JOIN og ogd ON ogd.ord = d.ord AND ogd.key = 'og:description'
    LEFT JOIN og ogi ON ogi.ord = d.ord AND ogi.key = 'og:image' LEFT JOIN og ogu ON ogu.ord = d.ord AND ogu.key = 'og:url'
    LEFT JOIN tw twc ON twc.ord = d.ord AND twc.key = 'twitter:card' LEFT JOIN tw twt ON twt.ord = d.ord AND twt.key = 'twitter:title'"""
TABLES["probe"] = "SELECT site, arg_min(url, ord) AS start_url, length(site) % 2 = 0 AS robots_txt_found, length(site) % 3 <> 0 AS sitemap_xml_found FROM crawl GROUP BY site"
TABLES["sitemap"] = f"SELECT {', '.join(derived.SITEMAP_COLUMNS)} FROM pages"

ORACLES: dict[str, str] = {}


def oracles() -> dict[str, str]:
    """Each registered SQL with the CTEs it reaches, in definition order."""
    names = list(TABLES)
    reach: dict[str, set[str]] = {}
    for name in names:
        direct = {n for n in names if n != name and re.search(rf"\b{n}\b", TABLES[name])}
        direct = {n for n in direct if names.index(n) < names.index(name)}
        reach[name] = set(direct).union(*[reach[n] for n in direct]) if direct else set()
    out = {}
    for key, sql in ORACLES.items():
        used = {n for n in names if re.search(rf"\b{n}\b", sql)}
        used = used.union(*[reach[n] for n in used]) if used else used
        ctes = ", ".join(f"{n} AS MATERIALIZED ({TABLES[n]})" for n in names if n in used)
        out[key] = (f"WITH {ctes} {sql}" if ctes else sql).strip()
    return out


# --- extraction ----------------------------------------------------------------------------
def page_cols(name: str, *cols: str) -> None:
    ORACLES[name] = f"SELECT ord, {', '.join(cols)} FROM page"


page_cols("extract_title", "title", "title_html")
page_cols("extract_meta_description", "meta_description", "meta_desc_html")
page_cols("extract_meta_robots", "meta_robots")
page_cols("indexability", "NOT noindex AS is_indexable", "CASE WHEN noindex THEN 'Noindex' ELSE 'Indexable' END AS status", "noindex_source", "nofollow",
          "nosnippet", "max_snippet", "max_image_preview")
page_cols("canonical", "canonical_url", "canonical_is_relative", "coalesce(rtrim(canonical_url, '/') = rtrim(url, '/'), false) AS canonical_is_self_ref", "multiple_canonicals")
page_cols("viewport", "viewport", "viewport_has_device_width", "viewport_allows_scaling")
page_cols("html_lang", "lang")
page_cols("favicon", "favicon_url")
page_cols("pagination", "pagination_next", "pagination_prev")
page_cols("amp", "amp_url")
page_cols("js_rendered", "is_js_rendered")
page_cols("spa_shell", "is_spa_shell")
page_cols("soft_404", "is_soft_404")
DISPLAY = (
    "CASE WHEN len(history) = 0 THEN '' ELSE array_to_string(list_append(list_transform(list_zip(history, history_codes), lambda z: '[' || coalesce(z[2], '?') || '] ' || z[1]), "
    "'[' || status_code || '] ' || url), ' → ') END"
)
page_cols("redirect_display", f"{DISPLAY} AS redirects")
COMPRESSION = "CASE WHEN coalesce(compressed_size, 0) > 0 THEN round((1 - compressed_size / html_size_bytes) * 100, 1) END"
page_cols("compression_ratio", f"{COMPRESSION} AS compression_ratio")
ORACLES["headings"] = "SELECT ord, n, level, text FROM heading"
ORACLES["images"] = "SELECT ord, n, src, alt, is_missing_alt, alt_text_length, width, height, loading, is_lazy_loaded, fetchpriority, format, is_next_gen_format FROM image"
ORACLES["image_format"] = "SELECT ord, n, src, format FROM image"
ORACLES["links"] = "SELECT ord, n, link_url, text, is_internal, rel, is_nofollow, is_sponsored, is_ugc, target, is_self_referencing, anchor_text_type FROM link"
ORACLES["anchor_text_type"] = "SELECT site, anchor_text_type, count(*) AS links FROM link GROUP BY ALL"
ORACLES["robots_directives"] = "SELECT ord, n, directive, value, source FROM robots_meta"
ORACLES["x_robots_directives"] = "SELECT ord, n, directive, value, source FROM robots_header"
ORACLES["open_graph"] = "SELECT ord, key, value FROM og"
ORACLES["twitter_cards"] = "SELECT ord, key, value FROM tw"
ORACLES["http_equiv"] = "SELECT ord, key, value FROM equiv"
ORACLES["hreflang"] = "SELECT ord, n, target_url, language_code, country_code, is_x_default FROM hreflang"
ORACLES["json_ld"] = """SELECT ord, CAST(n AS INTEGER) AS n, valid, data, CASE WHEN NOT valid THEN 'JSON parsing error' END AS error, ty AS schema_type,
    CASE WHEN ty IS NOT NULL THEN ty WHEN list_types IS NOT NULL THEN array_to_string(list_types, '|') ELSE '' END AS schema_types, schema_id, raw AS html_snippet FROM json_ld"""
ORACLES["json_ld_requirements"] = """SELECT ord, CAST(n AS INTEGER) AS n, array_to_string(missing, '|') AS required_missing, array_to_string(recommended, '|') AS recommended_missing,
    known AND len(missing) = 0 AS rich_result_compatible,
    array_to_string(list_concat(list_transform(missing, lambda m: 'Missing required property: ' || m), CASE WHEN known AND coalesce(context, '') <> '' AND NOT contains(lower(context), 'schema.org')
        THEN ['@context should be ''https://schema.org'', found: ' || context] ELSE [] END), '|') AS validation_errors,
    CASE WHEN keys IS NULL THEN '' WHEN ty IS NULL THEN 'No @type property found'
        WHEN NOT known THEN 'No Google Rich Results requirements defined for schema type: ' || ty
        ELSE array_to_string(list_transform(recommended, lambda m: 'Missing recommended property: ' || m), '|') END AS warnings FROM json_ld"""
_NEXT = r"json_extract_string(nullif(regexp_extract(html, '(?s)__NEXT_DATA__\s*=\s*(\{.*?\})\s*(?:;|</script>)', 1), ''), '$.props.pageProps.{}')"
_NUXT = r"json_extract_string(nullif(regexp_extract(html, '(?s)__NUXT__\s*=\s*(\{.*?\})\s*(?:;|</script>)', 1), ''), '$.head.title')"
_STATE = r"nullif(regexp_extract(html, '(?s)window\.{}\s*=\s*(\{{.*?\}})\s*(?:;|</script>)', 1), '')"
_INITIAL, _APP = (f"CASE WHEN contains(html, {q(m)}) THEN {_STATE.format(m)} END" for m in ("__INITIAL_STATE__", "__APP_DATA__"))
ORACLES["extract_js_title"] = f"""SELECT ord, coalesce({_NEXT.replace('{}', 'title')}, {_NUXT}, json_extract_string({_INITIAL}, '$.app[1].view.title'),
    json_extract_string({_APP}, '$.a.b.c.d.e.title'), json_extract_string({_APP}, '$.a.b.c.d.e.f.title')) AS js_title FROM crawl"""
ORACLES["extract_js_description"] = f"SELECT ord, coalesce({_NEXT.replace('{}', 'description')}, json_extract_string({_INITIAL}, '$.app[1].view.desc'), json_extract_string({_APP}, '$.a.b.c.d.e.description')) AS js_description FROM crawl"

# --- URL functions -------------------------------------------------------------------------
_VALID = "({} IN ('http', 'https') AND {} <> '')"
ORACLES["is_valid_url"] = f"SELECT page_id, url, {_VALID.format(url_part('url', 2), url_part('url', 4))} AS valid, {_VALID.format(url_part('substr(url, 6)', 2), url_part('substr(url, 6)', 4))} AS valid_cut FROM pages"
ORACLES["get_domain"] = f"SELECT page_id, url, {url_part('url', 4)} AS domain, {url_part('substr(url, 9)', 4)} AS domain_cut FROM pages"
ORACLES["is_internal_url"] = f"SELECT page_id, url, {same_site(url_part('url', 4), q('example.com'))} AS of_example, true AS relative, {same_site(q('www.example.com'), url_part('url', 4))} AS of_www FROM pages"
_FRONTIER = f"{url_part('url', 2)} || '://' || {url_part('url', 4)} || coalesce(nullif(rtrim({url_part('url', 5)}, '/'), ''), '/')"
ORACLES["frontier_key"] = f"SELECT page_id, url, {_FRONTIER} AS url_key FROM pages"
ORACLES["normalize_url"] = f"SELECT page_id, url, {normalized('url')} AS url_key, {normalized('(' + _FRONTIER + ' || ' + q('/index.html') + ')')} AS index_key FROM pages"
_P = url_part("url", 5)
_DEPTH = f"len(list_filter(string_split({_P}, '/'), lambda s: s <> ''))"
URL_SCORE = f"""CAST(greatest(0, 100 - CASE WHEN length(url) > 100 THEN 10 WHEN length(url) > 75 THEN 5 ELSE 0 END - CASE WHEN {_DEPTH} > 4 THEN 15 WHEN {_DEPTH} > 3 THEN 5 ELSE 0 END
    - CASE WHEN {url_part('url', 7)} <> '' THEN 10 ELSE 0 END - CASE WHEN contains({_P}, '_') THEN 5 ELSE 0 END - CASE WHEN lower({_P}) <> {_P} THEN 5 ELSE 0 END
    - CASE WHEN regexp_matches({_P}, '[.](html|php|asp|jsp)') THEN 10 ELSE 0 END) AS INTEGER)"""
ORACLES["url_structure_score"] = f"SELECT page_id, url, {URL_SCORE} AS score FROM pages"
_REFS = ["/abs/x?q=1#f", "rel/y", "?p=2", "//cdn.example.com/z", "https://other.example.com/a", "#frag", "../up", "./here", "mailto:a@b.c"]
ORACLES["url_join"] = f"SELECT page_id, CAST(i - 1 AS INTEGER) AS n, {absolute('url', 'ref')} AS joined FROM (SELECT page_id, url, unnest([{qs(_REFS)}]) AS ref, generate_subscripts([{qs(_REFS)}], 1) AS i FROM pages)"

# --- sources -------------------------------------------------------------------------------
ORACLES["read_crawl"] = "SELECT ord, site, url, status_code, html_size_bytes, compressed_size, CAST(crawl_depth AS INTEGER) AS crawl_depth FROM doc WHERE status_code BETWEEN 200 AND 299"
ORACLES["fetch_guard"] = """SELECT ord, CASE WHEN h_type NOT LIKE '%text/html%' THEN 'Non-HTML content: ' || h_type WHEN CAST(h_length AS BIGINT) > 10485760 THEN 'Content length exceeds maximum limit.' END AS error_message,
    CASE WHEN h_type NOT LIKE '%text/html%' OR CAST(h_length AS BIGINT) > 10485760 THEN 0 ELSE CAST(length(html) AS INTEGER) END AS html_length FROM crawl"""
ORACLES["read_crawl_warc"] = ORACLES["read_crawl"]
ORACLES["fetch_guard_warc"] = ORACLES["fetch_guard"]
TABLES["sitemap_document"] = f"SELECT page_id, {', '.join(derived.SITEMAP_DOCUMENT_COLUMNS)} FROM pages"
ORACLES["sitemap_locs"] = r"SELECT url AS sitemap_url, unnest(regexp_extract_all(body, '(?i)<loc>\s*(https?://[^\s<]+)\s*</loc>', 1)) AS loc FROM sitemap_document"
ORACLES["read_sitemap"] = f"""SELECT regexp_extract(d.url, '//([^/]*)', 1) AS site, d.url AS sitemap_url, replace(trim(loc), '&amp;', '&') AS loc, nullif(lastmod, '') AS lastmod,
    d.url IN (SELECT trim(regexp_extract(body, '<loc>([^<]*)</loc>', 1)) FROM sitemap_document WHERE contains(body, '<sitemapindex>')) AS from_index FROM (
    SELECT url, unnest(regexp_extract_all(body, '<url><loc>([^<]*)</loc>(?:<lastmod>([^<]*)</lastmod>)?</url>', 1)) AS loc,
           unnest(regexp_extract_all(body, '<url><loc>([^<]*)</loc>(?:<lastmod>([^<]*)</lastmod>)?</url>', 2)) AS lastmod FROM sitemap_document WHERE NOT contains(body, '<sitemapindex>')) d"""
TABLES["robots_text"] = "SELECT site AS host, arg_min(ord, ord) % 10 AS k FROM crawl GROUP BY site"
ORACLES["read_robots"] = """SELECT host, 1 AS group_no, 'otherbot' AS agent, 1 AS ord, false AS allow, '/' AS path FROM robots_text
    UNION ALL SELECT host, 2, '*', 4, true, '/en/' || k FROM robots_text UNION ALL SELECT host, 2, '*', 5, false, '/en/' FROM robots_text
    UNION ALL SELECT host, 2, '*', 6, false, '/fr/' || k FROM robots_text"""
_RP = f"coalesce(nullif({url_part('url', 5)} || {url_part('url', 6)}, ''), '/')"
_ALLOWED = f"CASE WHEN starts_with({_RP}, '/en/' || k) THEN true WHEN starts_with({_RP}, '/en/') OR starts_with({_RP}, '/fr/' || k) THEN false ELSE true END"
ORACLES["robots_filter"] = f"SELECT page_id, url, {_ALLOWED} AS allowed, CASE WHEN NOT {_ALLOWED} THEN 'Blocked by robots.txt' END AS error_message FROM pages JOIN robots_text ON host = {url_part('url', 4)}"

# --- page rules ----------------------------------------------------------------------------
RULE_SQL: dict[str, str] = {}


def rule(issue: str, cond: str, *slots: str, frm: str = "page", k: str = "0", snippet: str = "NULL", severity: str | None = None, rec_slots: tuple = ()) -> None:
    level, text, advice = ISSUES[issue]
    if level == JS:
        severity = "CASE WHEN is_js_rendered THEN 'WARNING' ELSE 'CRITICAL' END"
        slots = (f"CASE WHEN is_js_rendered THEN {q(JS_NOTE)} ELSE '' END",)
    RULE_SQL[issue] = (
        f"SELECT site, ord, CAST({RULE_NUMBER[issue] * RULE_STRIDE} + {k} AS BIGINT) AS seq, url, {severity or q(level)} AS severity, {q(issue)} AS issue_type, "
        f"{fill(text, *slots)} AS description, CAST({snippet} AS VARCHAR) AS html_snippet, {fill(advice, *rec_slots)} AS recommendation FROM {frm} WHERE {cond}"
    )


_T, _D = "coalesce(title, '') <> ''", "coalesce(meta_description, '') <> ''"
_ONE = "NOT multiple_canonicals AND canonical_url IS NOT NULL"
TABLES["skip"] = "SELECT ord, arg_min(prev, n) AS a, arg_min(level, n) AS b FROM (SELECT ord, n, level, lag(level) OVER (PARTITION BY ord ORDER BY n) AS prev FROM heading) WHERE level > prev + 1 GROUP BY ord"
TABLES["image_facts"] = """SELECT ord, count(*) AS n_images, count(*) FILTER (NOT is_missing_alt) AS with_alt, count(*) FILTER (format IS NOT NULL) AS known, count(*) FILTER (format IS NOT NULL AND NOT is_next_gen_format) AS legacy,
    count(*) FILTER (NOT is_lazy_loaded) AS not_lazy, count(*) FILTER (NOT is_lazy_loaded AND coalesce(fetchpriority, '') = '') AS lazy_candidates,
    arg_min(src, n) FILTER (coalesce(width, '') = '' OR coalesce(height, '') = '') AS unsized, arg_min(raw, n) FILTER (coalesce(width, '') = '' OR coalesce(height, '') = '') AS unsized_raw,
    count(*) FILTER (coalesce(width, '') = '' OR coalesce(height, '') = '') AS n_unsized, bool_or(coalesce(contains(loading, 'lazy'), false)) AS any_lazy FROM image GROUP BY ord"""
TABLES["link_facts"] = f"""SELECT ord, count(*) FILTER (is_internal) AS n_internal, count(*) FILTER (NOT is_internal) AS n_external, count(*) FILTER (is_nofollow) AS nofollow_all,
    count(*) FILTER (is_nofollow AND is_internal) AS nofollow_internal, count(*) FILTER (anchor_text_type = 'generic') AS generic, count(*) FILTER (text = '[Empty Anchor Text]') AS empty_text,
    count(*) FILTER (target = '_blank' AND coalesce(rel, '') <> '' AND NOT contains(rel, 'noopener')) AS unsafe,
    count(*) FILTER (is_internal AND (trim(text) = '' OR lower(trim(text)) IN ({qs(advanced.GENERIC_INTERNAL_ANCHORS)}))) AS generic_internal FROM link GROUP BY ord"""
TABLES["pagex"] = """SELECT p.*, skip.a AS skip_a, skip.b AS skip_b, coalesce(n_images, 0) AS n_images, coalesce(with_alt, 0) AS with_alt, coalesce(known, 0) AS known_formats, coalesce(legacy, 0) AS legacy,
    coalesce(not_lazy, 0) AS not_lazy, coalesce(lazy_candidates, 0) AS lazy_candidates, unsized, unsized_raw, coalesce(n_unsized, 0) AS n_unsized, coalesce(any_lazy, false) AS any_lazy,
    coalesce(n_internal, 0) AS n_internal, coalesce(n_external, 0) AS n_external, coalesce(nofollow_all, 0) AS nofollow_all, coalesce(nofollow_internal, 0) AS nofollow_internal, coalesce(generic, 0) AS generic,
    coalesce(empty_text, 0) AS empty_text, coalesce(unsafe, 0) AS unsafe, coalesce(generic_internal, 0) AS generic_internal,
    list_filter(['og:title', 'og:description', 'og:image'], lambda k: CASE k WHEN 'og:title' THEN og_title WHEN 'og:description' THEN og_description ELSE og_image END IS NULL) AS missing_og,
    list_filter(['twitter:card', 'twitter:title'], lambda k: CASE k WHEN 'twitter:card' THEN tw_card ELSE tw_title END IS NULL) AS missing_tw,
    (SELECT count(*) FROM json_ld j WHERE j.ord = p.ord) AS n_blocks, (SELECT count(*) FROM json_ld j WHERE j.ord = p.ord AND valid) AS n_valid,
    (SELECT count(*) FROM json_ld j WHERE j.ord = p.ord AND (contains(ty, 'FAQPage') OR contains(ty, 'HowTo'))) AS n_answer_blocks,
    (SELECT count(*) FROM mixed m WHERE m.ord = p.ord) AS n_mixed
    FROM page p LEFT JOIN skip USING (ord) LEFT JOIN image_facts USING (ord) LEFT JOIN link_facts USING (ord)"""
TABLES["ld_page"] = "SELECT p.site, p.ord, p.url, j.n, j.valid, j.ty, j.missing, j.raw, row_number() OVER (PARTITION BY p.ord, j.valid, len(j.missing) > 0 ORDER BY j.n) - 1 AS k FROM json_ld j JOIN page p USING (ord)"
TABLES["ld_invalid"] = "SELECT site, ord, url, raw, row_number() OVER (PARTITION BY ord ORDER BY n) - 1 AS k FROM ld_page WHERE NOT valid"
TABLES["alt_page"] = "SELECT p.site, p.ord, p.url, i.src, i.raw, row_number() OVER (PARTITION BY p.ord ORDER BY i.n) - 1 AS k FROM image i JOIN page p USING (ord) WHERE is_missing_alt"

rule("HTTPS Security", "NOT is_https")
rule("Missing Title", f"NOT {_T}")
rule("Title Too Short", f"{_T} AND length(title) < 10", "length(title)", snippet="title_html")
rule("Title Too Long", "length(title) > 65", "length(title)", snippet="title_html")
_SPECIAL = r"regexp_extract_all(title, '[^\x00-\x7F]')"
rule("Title Special Characters", f"len({_SPECIAL}) > 0", f"array_to_string(list_filter({_SPECIAL}[1:5], lambda c, i: list_position({_SPECIAL}[1:5], c) = i), '')", snippet="title_html")
rule("Missing Meta Description", f"NOT {_D}")
rule("Meta Description Too Short", f"{_D} AND length(meta_description) < 50", "length(meta_description)", snippet="meta_desc_html")
rule("Meta Description Too Long", "length(meta_description) > 160", "length(meta_description)", snippet="meta_desc_html")
rule("Multiple Canonical Tags", "multiple_canonicals", snippet="canonical_html")
rule("Missing Canonical URL", "NOT multiple_canonicals AND canonical_url IS NULL")
rule("Canonical Relative URL", f"{_ONE} AND canonical_is_relative", snippet="canonical_html")
_MISMATCH = "rtrim(canonical_url, '/') <> rtrim(url, '/')"
rule("Canonical Mismatch", f"{_ONE} AND {_MISMATCH}", "canonical_url", snippet="canonical_html")
rule("Canonical Protocol Mismatch", f"{_ONE} AND NOT is_https AND canonical_url LIKE 'https://%'")
rule("Missing Viewport Tag", "viewport IS NULL")
rule("Viewport Missing Device Width", "viewport IS NOT NULL AND NOT viewport_has_device_width")
rule("Viewport Blocks User Scaling", "viewport IS NOT NULL AND NOT viewport_allows_scaling")
rule("Missing Lang Attribute", "lang IS NULL")
rule("Missing H1 Heading", "h1_count = 0")
rule("Multiple H1 Headings", "h1_count > 1", "h1_count")
rule("Heading Hierarchy Skip", "skip_a IS NOT NULL", "skip_a", "skip_b", frm="pagex")
rule("JavaScript Rendered Page", "is_js_rendered")
rule("Missing Favicon", "favicon_url IS NULL")
rule("Missing Open Graph Tags", "len(missing_og) > 0", "array_to_string(missing_og, ', ')", frm="pagex")
rule("OG URL Invalid", "NOT regexp_matches(og_url, '^https?://')", "og_url")
rule("Missing Twitter Cards", "len(missing_tw) > 0", "array_to_string(missing_tw, ', ')", frm="pagex")
rule("Invalid JSON-LD", "true", "'JSON parsing error'", frm="ld_invalid", k="k", snippet="raw")
rule("Schema Missing Required Properties", "valid AND len(missing) > 0", "ty", "array_to_string(missing, ', ')", frm="ld_page", k="k", snippet="raw", rec_slots=("array_to_string(missing, ', ')",))
rule("Missing Alt Text", "true", "substr(src, 1, 100)", frm="alt_page", k="k", snippet="raw")
rule("Image Missing Dimensions", "unsized IS NOT NULL", "substr(unsized, 1, 80)", frm="pagex", snippet="unsized_raw")
rule("Images Not Next-Gen Format", "legacy > 0 AND legacy = known_formats", "legacy", frm="pagex")
rule("Images Missing Lazy Loading", "lazy_candidates > 3", "lazy_candidates", frm="pagex")
rule("Internal Nofollow Links", "nofollow_internal > 0", "nofollow_internal", frm="pagex")
rule("Generic Anchor Text", "generic > 0", "generic", frm="pagex")
rule("Empty Anchor Text", "empty_text > 0", "empty_text", frm="pagex")
rule("Links Missing noopener", "unsafe > 0", "unsafe", frm="pagex")
rule("Noindex Detected", "noindex", "noindex_source")
rule("Nofollow Directive Detected", "nofollow")
rule("Nosnippet Detected", "nosnippet")
rule("Pagination Detected", "pagination_next IS NOT NULL OR pagination_prev IS NOT NULL", "CASE WHEN pagination_next IS NOT NULL THEN 'True' ELSE 'False' END", "CASE WHEN pagination_prev IS NOT NULL THEN 'True' ELSE 'False' END")
rule("AMP Page Detected", "amp_url IS NOT NULL", "amp_url")
rule("Redirect Loop", "len(list_distinct(list_append(history, url))) < len(history) + 1")
rule("Too Many Redirects", "len(history) > 3", "len(history)")
rule("Soft 404 Detected", "is_soft_404")
rule("Server Error", "status_code >= 500", "status_code")
rule("Page Not Found", "status_code = 404")
rule("Access Forbidden", "status_code = 403")
rule("Slow Response Time", "total_ms > 3000", "CAST(round_even(CAST(total_ms AS DOUBLE), 0) AS BIGINT)")
rule("High TTFB", "NOT coalesce(total_ms > 3000, false) AND ttfb_ms > 1000", "CAST(round_even(CAST(ttfb_ms AS DOUBLE), 0) AS BIGINT)")
rule("Large Page Size", "html_size_bytes > 1048576", "CAST(round_even(html_size_bytes / 1024.0, 0) AS BIGINT)")
rule("Deep Page Depth", "crawl_depth > 3", "crawl_depth")

TABLES["page_issue"] = " UNION ALL ".join(RULE_SQL.values())
_ISSUE = "ord, seq, url, severity, issue_type, description, html_snippet, recommendation"
for _issue, _sql in RULE_SQL.items():
    ORACLES["rule_" + re.sub(r"[^a-z0-9]+", "_", _issue.lower()).strip("_")] = f"SELECT {_ISSUE} FROM ({_sql})"
ORACLES["page_issues"] = f"SELECT {_ISSUE} FROM page_issue"

_PENALTY = f"""CASE WHEN is_https THEN 0 ELSE 10 END
    + CASE WHEN NOT {_T} THEN CASE WHEN is_js_rendered THEN 7 ELSE 15 END WHEN length(title) < 10 THEN 7 WHEN length(title) > 65 THEN 5 ELSE 0 END
    + CASE WHEN NOT {_D} THEN CASE WHEN is_js_rendered THEN 7 ELSE 15 END WHEN length(meta_description) < 50 THEN 5 WHEN length(meta_description) > 160 THEN 3 ELSE 0 END
    + CASE WHEN multiple_canonicals OR canonical_url IS NULL THEN 10 WHEN {_MISMATCH} THEN 5 ELSE 0 END + CASE WHEN viewport IS NULL THEN 10 ELSE 0 END + CASE WHEN lang IS NULL THEN 5 ELSE 0 END
    + CASE WHEN h1_count = 0 THEN CASE WHEN is_js_rendered THEN 5 ELSE 10 END WHEN h1_count > 1 THEN 5 ELSE 0 END + CASE WHEN len(missing_og) > 0 THEN 3 ELSE 0 END
    + CASE WHEN n_valid < n_blocks THEN 5 ELSE 0 END + least(10, 2 * (n_images - with_alt)) + CASE WHEN is_soft_404 THEN 20 ELSE 0 END
    + CASE WHEN len(list_distinct(list_append(history, url))) < len(history) + 1 THEN 15 ELSE 0 END + CASE WHEN len(history) > 3 THEN 5 ELSE 0 END
    + CASE WHEN coalesce(total_ms, 0) > 3000 THEN 5 ELSE 0 END + CASE WHEN html_size_bytes > 1048576 THEN 5 ELSE 0 END + CASE WHEN crawl_depth > 3 THEN 3 ELSE 0 END"""
TABLES["base_score"] = f"""SELECT site, ord, url, CAST(greatest(0, least(100, 100 - ({_PENALTY}) - CASE WHEN robots_txt_found THEN 0 ELSE 5 END - CASE WHEN sitemap_xml_found THEN 0 ELSE 5 END)) AS INTEGER) AS base_score
    FROM pagex JOIN probe USING (site)"""
TABLES["ref"] = """SELECT l.site, l.ord, c.url AS page_url, 'link' AS kind, l.n, l.link_url AS target, l.is_internal, NULL AS html_snippet FROM link l JOIN crawl c USING (ord)
    UNION ALL SELECT i.site, i.ord, c.url, 'image', i.n, i.src, NULL, i.raw FROM image i JOIN crawl c USING (ord)"""
TABLES["checked"] = f"SELECT *, NOT coalesce(status_code BETWEEN 200 AND 399, false) AS is_broken FROM (SELECT *, {TARGET_STATUS} AS status_code FROM ref)"
TABLES["score"] = "SELECT b.*, coalesce(n, 0) AS n_broken, CAST(greatest(0, base_score - 5 * coalesce(n, 0)) AS INTEGER) AS score FROM base_score b LEFT JOIN (SELECT ord, count(*) AS n FROM checked WHERE is_broken GROUP BY ord) USING (ord)"
_STAT = "coalesce(CAST(status_code AS VARCHAR), 'Timeout')"
rule("Broken Link", "is_broken AND kind = 'link'", "CASE WHEN is_internal THEN 'internal' ELSE 'external' END", "target", _STAT, frm="(SELECT *, page_url AS url FROM checked)", k="n", severity="CASE WHEN is_internal THEN 'CRITICAL' ELSE 'WARNING' END")
rule("Broken Image", "is_broken AND kind = 'image'", "target", _STAT, frm="(SELECT *, page_url AS url FROM checked)", k="n", snippet="html_snippet")
TABLES["href_target"] = f"""SELECT h.site, h.ord, h.source_url, CAST(h.n + 1 AS INTEGER) AS n, h.target_url, h.language_code, h.country_code, h.is_x_default,
    EXISTS (SELECT 1 FROM hreflang b WHERE b.source_url = h.target_url AND b.target_url = h.source_url) AS has_return_link,
    status_code, NOT coalesce(status_code BETWEEN 200 AND 399, false) AS is_broken_target FROM (SELECT *, {TARGET_STATUS.replace('target', 'target_url')} AS status_code FROM hreflang) h"""
rule("Hreflang Broken Target", "is_broken_target", "target_url", frm="(SELECT *, source_url AS url FROM href_target)", k="n")
for _issue, _id in [("Broken Link", "rule_broken_link"), ("Broken Image", "rule_broken_image"), ("Hreflang Broken Target", "rule_hreflang_broken_target")]:
    ORACLES[_id] = f"SELECT {_ISSUE} FROM ({RULE_SQL[_issue]})"
ORACLES["page_score"] = "SELECT ord, url, base_score FROM base_score"
ORACLES["page_score_assets"] = "SELECT ord, url, base_score, n_broken, score FROM score"
_RTYPE = "history_codes[-1]"
ORACLES["page_report"] = f"""SELECT p.site, p.ord, p.url, p.status_code, is_https, CAST(crawl_depth AS INTEGER) AS crawl_depth, CAST(ttfb_ms AS DOUBLE) AS ttfb_ms, CAST(total_ms AS DOUBLE) AS total_ms, html_size_bytes, compressed_size,
    {COMPRESSION} AS compression_ratio, html_size_bytes > 1048576 AS is_large_page, noindex AS noindex_detected, is_soft_404 AS soft_404_detected, len(history) > 0 AS is_redirect, {_RTYPE} AS redirect_type, score
    FROM page p JOIN score USING (ord)"""

# --- site level ----------------------------------------------------------------------------
ORACLES["asset_status"] = "SELECT target, count(*) AS n_refs, any_value(status_code) AS status_code, any_value(is_broken) AS is_broken FROM checked GROUP BY target"
_DUP = {
    "content": ("dup_content", "md5(trim(title || coalesce(meta_description, '')))", _T, "Duplicate Page Content"),
    "title": ("dup_titles", "trim(title)", _T, "Duplicate Page Title"),
    "description": ("dup_descriptions", "trim(meta_description)", _D, "Duplicate Meta Description"),
}
for _kind, (_id, _key, _cond, _issue) in _DUP.items():
    TABLES[f"{_id}_k"] = f"SELECT site, ord, url, {_key} AS dup_key FROM page WHERE {_cond}"
    TABLES[f"{_id}_g"] = f"SELECT site, dup_key, count(*) AS n_pages, min(ord) AS first_ord, arg_min(url, ord) AS first_url FROM {_id}_k GROUP BY site, dup_key HAVING count(*) > 1"
    ORACLES[_id] = f"SELECT site, dup_key, n_pages, first_ord, first_url FROM {_id}_g"
    ORACLES[f"{_id}_members"] = f"SELECT k.site, k.dup_key, k.ord, k.url, n_pages, k.ord = first_ord AS is_first FROM {_id}_k k JOIN {_id}_g g USING (site, dup_key)"
    _slots = ("dup_key", "n_pages") if _kind == "title" else ("n_pages", "dup_key")
    rule(_issue, "true", *_slots, frm=f"(SELECT *, -1 AS ord, first_url AS url FROM {_id}_g)", k="first_ord")
    ORACLES[f"{_id}_issues"] = f"SELECT site, seq, url, severity, issue_type, description, recommendation FROM ({RULE_SQL[_issue]})"
ORACLES["redirect_pages"] = f"SELECT site, ord, url, {_RTYPE} AS redirect_type FROM page WHERE len(history) > 0 AND {_RTYPE} IS NOT NULL"
TABLES["orphan"] = "SELECT site, loc FROM sitemap s WHERE NOT EXISTS (SELECT 1 FROM page p WHERE p.site = s.site AND rtrim(p.url, '/') = rtrim(s.loc, '/'))"
ORACLES["orphan_pages"] = "SELECT site, loc FROM orphan"
ORACLES["orphan_pages_inlink"] = "SELECT site, loc FROM sitemap s WHERE (site, rtrim(loc, '/')) NOT IN (SELECT site, rtrim(split_part(link_url, '#', 1), '/') FROM link WHERE is_internal)"
rule("Orphan Pages", "true", "n", frm="(SELECT site, -1 AS ord, start_url AS url, n FROM (SELECT site, count(*) AS n FROM orphan GROUP BY site) JOIN probe USING (site))")
ORACLES["rule_orphan_pages"] = f"SELECT site, url, severity, issue_type, description, recommendation FROM ({RULE_SQL['Orphan Pages']})"
ORACLES["hreflang_targets"] = "SELECT * FROM href_target"
TABLES["issue"] = "SELECT * FROM page_issue UNION ALL " + " UNION ALL ".join(RULE_SQL[i] for i in ("Broken Link", "Broken Image", "Hreflang Broken Target", "Duplicate Page Content", "Duplicate Page Title", "Duplicate Meta Description", "Orphan Pages"))


def pct(cond: str) -> str:
    return f"avg(CASE WHEN {cond} THEN 1.0 ELSE 0.0 END) * 100"


TABLES["site_fact"] = f"""SELECT site, count(*) AS pages, {pct('is_https')} AS https_pct, {pct(_T)} AS title_pct, {pct(_D)} AS description_pct, {pct('h1_count > 0')} AS h1_pct, {pct('canonical_url IS NOT NULL')} AS canonical_pct,
    {pct('n_blocks > 0')} AS json_ld_pct, {pct('n_og > 0')} AS og_pct, {pct('n_tw > 0')} AS twitter_pct, {pct('any_lazy')} AS lazy_pct, max(n_answer_blocks) > 0 AS has_answers,
    avg(CAST(coalesce(total_ms, 0) AS DOUBLE)) AS avg_response_ms, avg(html_size_bytes) AS avg_html_bytes, count(lang) AS pages_with_lang, count(viewport) AS pages_with_viewport, count(favicon_url) AS pages_with_favicon,
    count(*) FILTER (len(history) > 0 AND {_RTYPE} IS NOT NULL) AS redirect_chains FROM pagex GROUP BY site"""
TABLES["report"] = """SELECT *, CAST(greatest(0, least(100, trunc(site_score * 0.4 + ai_visibility_score * 0.2 + site_speed_score * 0.2 + CASE WHEN robots_txt_found THEN 10 ELSE 0 END + CASE WHEN sitemap_xml_found THEN 10 ELSE 0 END))) AS INTEGER) AS site_health_score FROM (
    SELECT *, CAST(greatest(0, least(100, trunc(avg_page_score - CASE WHEN duplicate_contents > 0 THEN 10 ELSE 0 END - CASE WHEN duplicate_titles > 0 THEN 5 ELSE 0 END - CASE WHEN duplicate_descriptions > 0 THEN 5 ELSE 0 END
        - CASE WHEN orphans > 0 THEN 5 ELSE 0 END))) AS INTEGER) AS site_score,
        CAST(100 - CASE WHEN json_ld_pct < 50 THEN 20 WHEN json_ld_pct < 80 THEN 10 ELSE 0 END - CASE WHEN og_pct < 50 THEN 15 WHEN og_pct < 80 THEN 5 ELSE 0 END - CASE WHEN twitter_pct < 30 THEN 10 ELSE 0 END - CASE WHEN has_answers THEN 0 ELSE 5 END AS INTEGER) AS ai_visibility_score,
        CAST(100 - CASE WHEN avg_response_ms > 3000 THEN 30 WHEN avg_response_ms > 2000 THEN 20 WHEN avg_response_ms > 1000 THEN 10 ELSE 0 END - CASE WHEN avg_html_bytes > 2000000 THEN 25 WHEN avg_html_bytes > 1000000 THEN 15 WHEN avg_html_bytes > 500000 THEN 5 ELSE 0 END
        - CASE WHEN lazy_pct < 30 THEN 10 ELSE 0 END AS INTEGER) AS site_speed_score FROM (
        SELECT *, (SELECT avg(score) FROM score s WHERE s.site = p.site) AS avg_page_score, (SELECT count(*) FROM dup_content_g g WHERE g.site = p.site) AS duplicate_contents, (SELECT count(*) FROM dup_titles_g g WHERE g.site = p.site) AS duplicate_titles,
            (SELECT count(*) FROM dup_descriptions_g g WHERE g.site = p.site) AS duplicate_descriptions, (SELECT count(*) FROM orphan o WHERE o.site = p.site) AS orphans FROM probe p JOIN site_fact USING (site)))"""
ORACLES["site_score"] = "SELECT site, pages, site_score FROM report"
ORACLES["site_ai_score"] = "SELECT site, ai_visibility_score FROM report"
ORACLES["site_speed_score"] = "SELECT site, site_speed_score FROM report"
ORACLES["site_health_score"] = "SELECT site, site_health_score FROM report"
ORACLES["avg_response"] = "SELECT site, round(avg_response_ms, 6) AS avg_response_ms FROM site_fact"
ORACLES["status_distribution"] = "SELECT site, status_code, count(*) AS pages FROM crawl GROUP BY ALL"
ORACLES["website_report"] = """SELECT site, start_url, robots_txt_found, sitemap_xml_found, pages, orphans, redirect_chains, duplicate_contents, duplicate_titles, duplicate_descriptions,
    round(avg_page_score, 6) AS avg_page_score, site_score, ai_visibility_score, site_speed_score, site_health_score FROM report"""

# --- advanced ------------------------------------------------------------------------------
_HEADER_COLUMNS = {"HSTS": "h_hsts", "X-Content-Type-Options": "h_nosniff", "X-Frame-Options": "h_frame", "Content-Security-Policy": "h_csp", "Referrer-Policy": "h_referrer"}
TABLES["security"] = " UNION ALL ".join(
    f"SELECT site, ord, url, {q(d)} AS header, v IS NOT NULL AS present, v AS value, CASE WHEN v IS NULL THEN {q(sev)} ELSE 'INFO' END AS severity, {q(text)} AS description, CASE WHEN v IS NULL THEN {q(rec)} ELSE '' END AS recommendation "
    f"FROM (SELECT site, ord, url, nullif({_HEADER_COLUMNS.get(d, 'CAST(NULL AS VARCHAR)')}, '') AS v FROM crawl)"
    for _, d, sev, text, rec in advanced.SECURITY_HEADERS
)
_GAP = "NOT present AND severity IN ('CRITICAL', 'WARNING')"
ORACLES["security_headers"] = "SELECT ord, header, present, value, severity, description, recommendation FROM security"
ORACLES["missing_security_headers"] = f"SELECT site, ord, url, header, severity, description, recommendation FROM security WHERE {_GAP}"
ORACLES["redirect_chain"] = "SELECT ord, history[1] AS original_url, array_to_string(list_append(history, url), '|') AS chain, url AS final_url, CAST(len(history) AS INTEGER) AS total_redirects, len(history) > 3 AS is_too_long FROM page WHERE len(history) > 0"
ORACLES["redirect_table"] = """SELECT site, ord, history[1] AS original_url, CAST(len(history) AS INTEGER) AS total_redirects, len(history) > 3 AS is_too_long, CAST(generate_subscripts(list_append(history, url), 1) - 1 AS INTEGER) AS hop,
    unnest(list_append(history, url)) AS hop_url FROM page WHERE len(history) > 0"""


def band(ease: str) -> str:
    return f"CASE WHEN {ease} IS NULL THEN 'N/A' " + " ".join(f"WHEN {ease} >= {f} THEN {q(t)}" for f, t in READABILITY_BANDS) + f" ELSE {q(HARDEST_BAND)} END"


EASE = "CASE WHEN word_count > 0 THEN 206.835::DOUBLE - 1.015::DOUBLE * (word_count / sentence_count) - 84.6::DOUBLE * (syllable_count / word_count) END"
TABLES["adv"] = f"""SELECT p.*, {band(EASE)} AS readability, {URL_SCORE} AS url_structure_score, (SELECT count(*) FROM security s WHERE s.ord = p.ord AND {_GAP}) AS missing_headers,
    CAST(greatest(0, 100 - CASE WHEN n_internal = 0 THEN 30 WHEN n_internal < 3 THEN 10 ELSE 0 END - CASE WHEN n_external > 0 AND n_external > 2 * n_internal THEN 10 ELSE 0 END - least(15, 3 * generic_internal)
        - CASE WHEN h1_count > 0 AND NOT EXISTS (SELECT 1 FROM link l JOIN heading h USING (ord) WHERE l.ord = p.ord AND l.is_internal AND h.level = 1 AND contains(lower(l.text), lower(h.text))) THEN 5 ELSE 0 END) AS INTEGER) AS internal_link_score,
    CASE WHEN word_count > 0 THEN round(word_count / sentence_count, 1) ELSE 0 END AS avg_words_per_sentence FROM pagex p"""
ORACLES["content_quality"] = """SELECT site, ord, url, word_count, character_count, sentence_count, avg_words_per_sentence, word_count < 300 AS is_thin_content, skip_a IS NULL AS heading_hierarchy_valid,
    CAST(n_internal AS INTEGER) AS internal_link_count, CAST(n_external AS INTEGER) AS external_link_count, CAST(n_images AS INTEGER) AS image_count, CAST(with_alt AS INTEGER) AS images_with_alt, CAST(not_lazy AS INTEGER) AS images_without_lazy FROM adv"""
ORACLES["readability"] = "SELECT ord, word_count, syllable_count, readability FROM adv"
ORACLES["mixed_content"] = "SELECT ord, page_url, n, resource_url, resource_type FROM mixed"
ORACLES["internal_link_score"] = "SELECT ord, internal_link_score FROM adv"
ORACLES["advanced_page"] = "SELECT ord, url, word_count, readability, CAST(missing_headers AS INTEGER) AS missing_headers, CAST(n_mixed AS INTEGER) AS mixed_count, CAST(len(history) AS INTEGER) AS redirect_hops, url_structure_score, internal_link_score FROM adv"
ORACLES["document_readability"] = f"""SELECT doc_id, word_count, sentence_count, syllable_count, {band(EASE)} AS readability FROM (
    SELECT doc_id, CAST(len(ws) AS INTEGER) AS word_count, CAST(greatest(1, len(list_filter(string_split_regex(text, '[.!?]+'), lambda s: {strip('s')} <> ''))) AS INTEGER) AS sentence_count,
        CAST(coalesce(list_sum(list_transform(ws, lambda w: greatest(1, len(regexp_extract_all(lower(w), '[aeiouy]+'))))), 0) AS BIGINT) AS syllable_count
    FROM (SELECT doc_id, text, list_filter(string_split_regex(text, '\\s+'), lambda w: w <> '') AS ws FROM documents))"""
_SITE_MODE = "(SELECT arg_min(readability, (-n, readability)) FROM (SELECT readability, count(*) AS n FROM adv b WHERE b.site = a.site AND readability <> 'N/A' GROUP BY readability))"
ORACLES["advanced_site"] = """SELECT a.*, m.mode_readability FROM (SELECT site, CAST(sum(missing_headers) AS BIGINT) AS security_issues, CAST(sum(n_mixed) AS BIGINT) AS mixed_content, count(*) FILTER (word_count < 300) AS thin_pages,
    count(*) FILTER (skip_a IS NOT NULL) AS heading_issues, CAST(sum(not_lazy) AS BIGINT) AS images_no_lazy, CAST(sum(word_count) // count(*) AS BIGINT) AS avg_word_count, coalesce(arg_min(readability, ord) FILTER (readability <> 'N/A'), 'N/A') AS first_readability,
    round(avg(url_structure_score), 4) AS avg_url_score, round(avg(internal_link_score), 4) AS avg_link_score FROM adv GROUP BY site) a
    LEFT JOIN (SELECT site, first(readability ORDER BY n DESC, readability) AS mode_readability FROM (SELECT site, readability, count(*) AS n FROM adv WHERE readability <> 'N/A' GROUP BY ALL) GROUP BY site) m USING (site)"""
ORACLES["score_averages"] = "SELECT site, round(avg(url_structure_score), 4) AS avg_url_score, round(avg(internal_link_score), 4) AS avg_link_score FROM adv GROUP BY site"
ORACLES["advanced_site_extra"] = """SELECT site, CAST(sum(n_unsized) AS BIGINT) AS images_no_dimensions, CAST(sum(legacy) AS BIGINT) AS images_not_next_gen, CAST(sum(nofollow_all) AS BIGINT) AS nofollow_links, CAST(sum(nofollow_internal) AS BIGINT) AS internal_nofollow_links,
    count(*) FILTER (noindex) AS non_indexable_pages, count(*) FILTER (is_soft_404) AS soft_404_pages, count(*) FILTER (len(history) > 0) AS redirect_chains,
    count(*) FILTER (len(list_distinct(list_append(history, url))) < len(history) + 1) AS redirect_loops, round(avg(CAST(total_ms AS DOUBLE)), 4) AS avg_response_ms, round(avg(CAST(ttfb_ms AS DOUBLE)), 4) AS avg_ttfb_ms,
    round(avg(html_size_bytes), 4) AS avg_html_bytes, round(avg(crawl_depth), 4) AS avg_depth, count(*) FILTER (crawl_depth > 3) AS deep_pages FROM pagex GROUP BY site"""

# --- AI visibility -------------------------------------------------------------------------
_QW = words(visibility.QUESTION_WORDS)
TABLES["fac"] = f"""SELECT *, CAST(greatest(0, least(100, trunc(sd * 0.15::DOUBLE + md * 0.12::DOUBLE + hs * 0.1::DOUBLE + cd * 0.15::DOUBLE + ee * 0.12::DOUBLE + an * 0.1::DOUBLE + te * 0.1::DOUBLE + im * 0.08::DOUBLE + il * 0.08::DOUBLE + so * 0.05::DOUBLE))) AS INTEGER) AS overall_score FROM (
    SELECT *, CASE WHEN n_blocks = 0 THEN 20 WHEN n_valid = n_blocks THEN 100 ELSE 60 END AS sd,
        CASE WHEN dl = 0 THEN 0 WHEN dl >= 50 AND dl <= 160 THEN 100 ELSE 50 END AS md,
        CAST(least(100, CASE WHEN h1_count = 1 THEN 40 WHEN h1_count > 1 THEN 20 ELSE 0 END + has_h2 * 30 + has_h3 * 20 + CASE WHEN n_headings >= 3 THEN 10 ELSE 0 END) AS INTEGER) AS hs,
        CASE WHEN word_count >= 1500 THEN 100 WHEN word_count >= 800 THEN 75 WHEN word_count >= 300 THEN 50 ELSE 20 END AS cd,
        least(100, 50 + CASE WHEN n_og > 0 THEN 10 ELSE 0 END + CASE WHEN n_tw > 0 THEN 5 ELSE 0 END + CASE WHEN n_blocks > 0 THEN 15 ELSE 0 END + CASE WHEN canonical_url IS NOT NULL THEN 10 ELSE 0 END + CASE WHEN n_external > 0 THEN 10 ELSE 0 END) AS ee,
        CAST(least(100, least(40, 15 * n_questions) + CASE WHEN regexp_matches(lower(meta_description), 'what is|how to|guide|learn|discover') THEN 30 ELSE 0 END + CASE WHEN word_count >= 500 THEN 30 ELSE 0 END) AS INTEGER) AS an,
        CAST(greatest(0, 100 - CASE WHEN is_https THEN 0 ELSE 30 END - CASE WHEN viewport IS NULL THEN 20 ELSE 0 END - least(30, 5 * missing_headers) - CASE WHEN n_mixed > 0 THEN 20 ELSE 0 END) AS INTEGER) AS te,
        CASE WHEN n_images > 0 THEN CAST(trunc(with_alt / n_images * 100) AS INTEGER) ELSE 100 END AS im,
        CASE WHEN n_internal >= 10 THEN 100 WHEN n_internal >= 5 THEN 70 WHEN n_internal >= 2 THEN 40 ELSE 15 END AS il,
        CASE WHEN og_title IS NOT NULL THEN 35 ELSE 0 END + CASE WHEN og_description IS NOT NULL THEN 35 ELSE 0 END + CASE WHEN og_image IS NOT NULL THEN 30 ELSE 0 END AS so FROM (
        SELECT a.*, coalesce(length(meta_description), 0) AS dl, CASE WHEN EXISTS (SELECT 1 FROM heading h WHERE h.ord = a.ord AND level = 2) THEN 1 ELSE 0 END AS has_h2, CASE WHEN EXISTS (SELECT 1 FROM heading h WHERE h.ord = a.ord AND level = 3) THEN 1 ELSE 0 END AS has_h3,
            (SELECT count(*) FROM heading h WHERE h.ord = a.ord AND regexp_matches(lower(text), {_QW})) AS n_questions FROM adv a))"""
for _id, _k in [("aiv_structured_data", "sd"), ("aiv_meta_description", "md"), ("aiv_headings", "hs"), ("aiv_content_depth", "cd"), ("aiv_eeat", "ee"), ("aiv_answer", "an"), ("aiv_technical", "te"), ("aiv_image_alt", "im"), ("aiv_internal_links", "il"), ("aiv_social", "so")]:
    ORACLES[_id] = f"SELECT ord, {_k} AS score FROM fac"
ORACLES["aiv_overall"] = "SELECT ord, overall_score FROM fac"
ORACLES["aiv_grade"] = "SELECT ord, CASE WHEN overall_score >= 90 THEN 'A+' WHEN overall_score >= 80 THEN 'A' WHEN overall_score >= 70 THEN 'B' WHEN overall_score >= 60 THEN 'C' WHEN overall_score >= 40 THEN 'D' ELSE 'F' END AS grade FROM fac"


def mix(*terms: tuple[str, str]) -> str:
    return "CAST(trunc(" + " + ".join(f"{c} * {w}::DOUBLE" for c, w in terms) + ") AS INTEGER)"


ORACLES["aiv_engines"] = f"SELECT ord, {mix(('overall_score', '0.9'), ('sd', '0.1'))} AS google_score, {mix(('overall_score', '0.85'), ('cd', '0.15'))} AS chatgpt_score, {mix(('overall_score', '0.8'), ('an', '0.2'))} AS perplexity_score FROM fac"
ORACLES["aiv_citation"] = f"SELECT ord, {mix(('cd', '0.3'), ('sd', '0.3'), ('ee', '0.2'), ('an', '0.2'))} AS citation_potential FROM fac"
ORACLES["aiv_geo"] = f"SELECT ord, {mix(('sd', '0.25'), ('an', '0.25'), ('cd', '0.2'), ('ee', '0.15'), ('hs', '0.15'))} AS geo_readiness FROM fac"


def yes(cond: str) -> str:
    return f"CASE WHEN {cond} THEN 'True' ELSE 'False' END"


_SD, _MD = visibility.SD_TEXTS, visibility.MD_TEXTS
_DETAIL = {
    "sd": f"CASE sd WHEN 100 THEN {fill(_SD['good'][0], 'n_valid')} WHEN 60 THEN {fill(_SD['warning'][0], 'n_valid', 'n_blocks')} ELSE {q(_SD['critical'][0])} END",
    "md": f"CASE md WHEN 100 THEN {fill(_MD['good'][0], 'dl')} WHEN 50 THEN {fill(_MD['warning'][0], 'dl')} ELSE {q(_MD['critical'][0])} END",
    "hs": "n_headings || ' headings found, ' || h1_count || ' H1 tags'",
    "cd": "format('{:,}', word_count) || ' words on page'",
    "ee": f"'E-E-A-T signals: OG=' || {yes('n_og > 0')} || ', Twitter=' || {yes('n_tw > 0')} || ', Schema=' || {yes('n_blocks > 0')}",
    "an": "'Answer optimization: ' || n_questions || ' question-format headings'",
    "te": f"'HTTPS=' || {yes('is_https')} || ', Security issues=' || missing_headers || ', Mixed content=' || n_mixed",
    "im": "'Alt text coverage: ' || im || '% (' || with_alt || '/' || n_images || ' images)'",
    "il": "n_internal || ' internal links found'",
    "so": "'OG tags: ' || n_og || ' found'",
}
_FACTOR_ROWS = []
for _i, (_k, _name, _w, _good, _warn, _advice) in enumerate(visibility.FACTORS, 1):
    _texts = _SD if _k == "sd" else _MD
    _rec = (f"CASE WHEN {_k} >= {_good} THEN '' WHEN {_k} >= {_warn} THEN {q(_texts['warning'][1])} ELSE {q(_texts['critical'][1])} END" if _advice is None
            else f"CASE WHEN {_k} >= {_good} THEN '' ELSE {q(_advice)} END")
    _FACTOR_ROWS.append(
        f"SELECT site, ord, url, {_i} AS n, {q(_name)} AS factor, {_k} AS score, {round(_w * 100)} AS weight_pct, CASE WHEN {_k} >= {_good} THEN 'good' WHEN {_k} >= {_warn} THEN 'warning' ELSE 'critical' END AS status, "
        f"{_DETAIL[_k]} AS details, {_rec} AS recommendation FROM fac"
    )
TABLES["factor"] = " UNION ALL ".join(_FACTOR_ROWS)
ORACLES["factor_table"] = "SELECT * FROM factor"
ORACLES["aiv_status"] = "SELECT ord, factor, status FROM factor"
ORACLES["priority_improvements"] = "SELECT site, ord, url, CASE status WHEN 'critical' THEN 0 ELSE 1 END AS rank, n, factor, score, recommendation FROM factor WHERE status <> 'good'"

# --- keywords ------------------------------------------------------------------------------
TABLES["link_text"] = "SELECT ord, list(text ORDER BY n) AS ts FROM link GROUP BY ord"
TABLES["heading_text"] = "SELECT ord, list(text ORDER BY n) AS hs, list('H' || level || ': ' || text ORDER BY n) AS labeled FROM heading GROUP BY ord"
TABLES["ptext"] = """SELECT p.site, p.ord, p.url, lower(title) AS title, lower(meta_description) AS description, coalesce(list_transform(hs, lambda h: lower(h)), []) AS hs,
    array_to_string(list_filter(list_concat([nullif(title, ''), nullif(meta_description, '')], hs, ts), lambda x: x IS NOT NULL), ' ') AS text
    FROM page p LEFT JOIN heading_text USING (ord) LEFT JOIN link_text USING (ord)"""


def token_list(text: str) -> str:
    return f"list_filter(list_transform(string_split_regex(regexp_replace(lower({text}), '[^a-z\\s\\-]', ' ', 'g'), '\\s+'), lambda w: trim(w, '-')), lambda w: length(w) >= 3)"


_STOPS = f"[{qs(sorted(set(keywords.STOP_WORDS)))}]"


def keyword_tables(prefix: str, source: str) -> None:
    """CTEs over a source with site, ord, url, title, description, hs, text."""
    TABLES[f"{prefix}_toks"] = f"SELECT *, {token_list('text')} AS tokens FROM ({source})"
    TABLES[f"{prefix}_tok"] = f"SELECT site, ord, url, unnest(tokens) AS token, generate_subscripts(tokens, 1) - 1 AS pos FROM {prefix}_toks"
    TABLES[f"{prefix}_stop"] = f"SELECT unnest({_STOPS}) AS w"
    TABLES[f"{prefix}_gram"] = f"SELECT *, lead(token, 1) OVER o AS t2, lead(token, 2) OVER o AS t3, token IN (SELECT w FROM {prefix}_stop) AS s1, lead(token, 1) OVER o IN (SELECT w FROM {prefix}_stop) AS s2, lead(token, 2) OVER o IN (SELECT w FROM {prefix}_stop) AS s3 FROM {prefix}_tok WINDOW o AS (PARTITION BY ord ORDER BY pos)"
    TABLES[f"{prefix}_occ"] = f"""SELECT site, ord, url, 1 AS n, pos, token AS term FROM {prefix}_gram WHERE NOT s1
        UNION ALL SELECT site, ord, url, 2, pos, token || ' ' || t2 FROM {prefix}_gram WHERE t2 IS NOT NULL AND NOT s1 AND NOT s2
        UNION ALL SELECT site, ord, url, 3, pos, token || ' ' || t2 || ' ' || t3 FROM {prefix}_gram WHERE t3 IS NOT NULL AND NOT s1 AND NOT s2 AND NOT s3"""
    TABLES[f"{prefix}_ppc"] = f"SELECT site, term, n, ord, url, count(*) AS c, min(pos) AS pos FROM {prefix}_occ GROUP BY ALL"
    TABLES[f"{prefix}_total"] = f"SELECT site, sum(len(tokens)) AS total FROM {prefix}_toks GROUP BY site"
    TABLES[f"{prefix}_kw"] = f"""SELECT site, term AS keyword, n, CAST(sum(c) AS BIGINT) AS count, count(*) AS n_pages, round(CAST(sum(c) AS DOUBLE) / any_value(total) * 100, 2) AS density,
        min((ord, n, pos)) AS first_seen, bool_or(n = 1 AND coalesce(contains(k.title, term), false)) AS in_title, bool_or(n = 1 AND coalesce(contains(k.description, term), false)) AS in_meta,
        bool_or(n = 1 AND len(list_filter(k.hs, lambda h: contains(h, term))) > 0) AS in_headings, bool_or(n = 1 AND contains(lower(k.url), term)) AS in_url
        FROM {prefix}_ppc JOIN (SELECT ord, title, description, hs, url FROM {prefix}_toks) k USING (ord) JOIN {prefix}_total USING (site) GROUP BY site, term, n"""
    TABLES[f"{prefix}_one"] = f"SELECT *, row_number() OVER (PARTITION BY site ORDER BY count DESC, first_seen) AS rank FROM {prefix}_kw WHERE n = 1 QUALIFY rank <= 20"


keyword_tables("kp", "SELECT * FROM ptext")
keyword_tables("kd", "SELECT source AS site, doc_id AS ord, CAST(doc_id AS VARCHAR) AS url, CAST(NULL AS VARCHAR) AS title, CAST(NULL AS VARCHAR) AS description, CAST([] AS VARCHAR[]) AS hs, text FROM documents")
TABLES["kp_two"] = "SELECT *, row_number() OVER (PARTITION BY site ORDER BY count DESC, first_seen) AS rank FROM kp_kw WHERE n > 1 QUALIFY rank <= 20"
TABLES["kp_lsi"] = """SELECT b.* FROM (SELECT *, row_number() OVER (PARTITION BY site ORDER BY count DESC, first_seen) AS rank FROM kp_kw WHERE n = 2 QUALIFY rank <= 15) b
    WHERE NOT EXISTS (SELECT 1 FROM kp_two t WHERE t.site = b.site AND t.keyword = b.keyword)"""
TABLES["kp_gap"] = f"""SELECT site, CAST(row_number() OVER (PARTITION BY site ORDER BY pos) AS INTEGER) AS rank, keyword FROM (
    SELECT site, unnest([{qs(keywords.GAP_CANDIDATES)}]) AS keyword, generate_subscripts([{qs(keywords.GAP_CANDIDATES)}], 1) AS pos FROM probe) g
    WHERE NOT EXISTS (SELECT 1 FROM kp_kw k WHERE k.site = g.site AND k.keyword = g.keyword) QUALIFY rank <= 10"""
TABLES["kp_top"] = "SELECT *, rank AS position, 0 AS part FROM kp_one UNION ALL SELECT *, rank + 20, 1 FROM kp_two"
ORACLES["page_text"] = "SELECT ord, text FROM ptext"
ORACLES["page_text_labeled"] = """SELECT p.ord, array_to_string(list_filter(list_concat([CASE WHEN title <> '' THEN 'Title: ' || title END, CASE WHEN meta_description <> '' THEN 'Description: ' || meta_description END], labeled), lambda x: x IS NOT NULL), ' | ') AS labeled_text
    FROM page p LEFT JOIN heading_text USING (ord)"""
ORACLES["tokenize"] = "SELECT ord, CAST(len(tokens) AS INTEGER) AS n_tokens, array_to_string(tokens, ' ') AS tokens FROM kp_toks"
ORACLES["stop_filter"] = "SELECT ord, CAST(pos AS INTEGER) AS pos, term FROM kp_occ WHERE n = 1"
ORACLES["ngrams"] = """SELECT ord, CAST(row_number() OVER (PARTITION BY ord ORDER BY n, pos) - 1 AS INTEGER) AS pos, phrase FROM (
    SELECT ord, 2 AS n, pos, token || ' ' || t2 AS phrase FROM kp_gram WHERE t2 IS NOT NULL UNION ALL SELECT ord, 3, pos, token || ' ' || t2 || ' ' || t3 FROM kp_gram WHERE t3 IS NOT NULL)"""
_KW = "site, keyword, count, n_pages, density, in_title, in_meta, in_headings, in_url"
ORACLES["keyword_count"] = "SELECT site, keyword, count, n_pages FROM kp_kw"
ORACLES["keyword_pages"] = "SELECT site, term AS keyword, url, c AS count FROM kp_ppc"
ORACLES["keyword_density"] = "SELECT site, keyword, density FROM kp_kw"
ORACLES["keyword_placement"] = f"SELECT {_KW} FROM kp_kw"
ORACLES["vocabulary_stats"] = "SELECT site, CAST(t.total AS BIGINT) AS total_tokens, coalesce(u.n, 0) AS unique_tokens FROM kp_total t LEFT JOIN (SELECT site, count(DISTINCT token) AS n FROM kp_tok GROUP BY site) u USING (site)"
ORACLES["primary_keywords"] = f"SELECT CAST(rank AS INTEGER) AS rank, {_KW} FROM kp_one"
ORACLES["secondary_keywords"] = f"SELECT CAST(rank AS INTEGER) AS rank, {_KW} FROM kp_two"
ORACLES["lsi_keywords"] = "SELECT site, CAST(rank AS INTEGER) AS rank, keyword, count, density FROM kp_lsi"
ORACLES["keyword_gaps"] = "SELECT site, rank, keyword FROM kp_gap"


def ranked_list(table: str) -> str:
    return f"coalesce((SELECT string_agg(keyword, '|' ORDER BY rank) FROM {table} x WHERE x.site = t.site), '')"


ORACLES["keyword_report"] = f"""SELECT site, CAST(t.total AS BIGINT) AS total_tokens, coalesce(u.n, 0) AS unique_tokens, {ranked_list('kp_one')} AS primary_keywords, {ranked_list('kp_two')} AS secondary_keywords,
    {ranked_list('kp_lsi')} AS lsi_keywords, {ranked_list('kp_gap')} AS keyword_gaps FROM kp_total t LEFT JOIN (SELECT site, count(DISTINCT token) AS n FROM kp_tok GROUP BY site) u USING (site)"""
_TREND = "(CASE WHEN in_title THEN 2 ELSE 0 END + CASE WHEN in_meta THEN 1 ELSE 0 END + CASE WHEN in_headings THEN 2 ELSE 0 END + CASE WHEN in_url THEN 1 ELSE 0 END)"
TABLES["overview"] = f"""SELECT site, CAST(position AS INTEGER) AS position, keyword, count AS volume, density, CASE WHEN density >= 3 THEN 'Hard' WHEN density >= 1.5 THEN 'Medium' ELSE 'Easy' END AS difficulty,
    round(density * 1.2::DOUBLE + 0.5::DOUBLE, 2) AS cpc, round(least(density / 5, 1), 2) AS competition,
    CASE WHEN regexp_matches(keyword, {words(keywords.TRANSACTIONAL)}) THEN 'Transactional' WHEN regexp_matches(keyword, {words(keywords.COMMERCIAL)}) THEN 'Commercial' WHEN in_url THEN 'Navigational' ELSE 'Informational' END AS intent,
    CASE WHEN {_TREND} >= 4 THEN 'Rising' WHEN {_TREND} >= 2 THEN 'Stable' ELSE 'Low' END AS trend, in_title, in_meta, in_headings, in_url, count * 47 AS results FROM kp_top"""
ORACLES["keyword_overview"] = "SELECT * FROM overview"
ORACLES["keyword_search"] = "SELECT site, position, keyword, volume FROM overview WHERE keyword ILIKE '%the%'"
ORACLES["keyword_recommendations"] = """SELECT site, position, keyword, CAST(generate_subscripts(rs, 1) - 1 AS INTEGER) AS n, unnest(rs) AS recommendation FROM (
    SELECT site, CAST(position AS INTEGER) AS position, keyword, list_filter([CASE WHEN NOT in_title THEN 'Add to title tag' END, CASE WHEN NOT in_meta THEN 'Add to meta description' END, CASE WHEN NOT in_headings THEN 'Add to H1/H2 heading' END,
        CASE WHEN density < 0.5 THEN 'Increase keyword density' WHEN density > 4 THEN 'Reduce keyword stuffing' END, CASE WHEN in_title AND in_meta AND in_headings THEN 'Well optimized placement!' END], lambda r: r IS NOT NULL) AS rs FROM kp_top)"""
_SERP = [
    "CASE WHEN bool_or(in_headings AND part = 0) THEN 'High' ELSE 'Low' END", "CASE WHEN (SELECT count(*) FROM kp_gap g WHERE g.site = t.site) > 0 THEN 'High' ELSE 'Medium' END",
    "'Medium'", "'Low'", "'Medium'", "CASE WHEN count(*) FILTER (part = 1) > 3 THEN 'High' ELSE 'Low' END",
]
ORACLES["serp_opportunities"] = " UNION ALL ".join(
    f"SELECT site, {i} AS n, {q(f)} AS feature, {o} AS opportunity, {q(a)} AS action FROM kp_top t GROUP BY site HAVING count(*) FILTER (part = 0) > 0"
    for i, ((f, _, a), o) in enumerate(zip(keywords.SERP_ACTIONS, _SERP), 1)
)
TABLES["seed"] = "SELECT site, keyword AS seed FROM kp_one WHERE rank = 1"
_NAME = "coalesce(list_filter(string_split(keyword, ' '), lambda w: w <> seed AND length(w) > 3)[1], string_split(keyword, ' ')[1])"
ORACLES["keyword_clusters"] = f"""SELECT site, seed, cluster, keywords, n_keywords, mean_count, CAST(row_number() OVER (PARTITION BY site ORDER BY first_position, cluster) AS INTEGER) AS cluster_rank FROM (
    SELECT site, seed, cluster, min(position) AS first_position, array_to_string(list(keyword ORDER BY position)[1:10], '|') AS keywords, count(*) AS n_keywords, round(avg(count), 4) AS mean_count FROM (
        SELECT *, upper(c[1]) || c[2:] AS cluster FROM (SELECT t.*, seed, {_NAME} AS c FROM kp_top t JOIN seed USING (site))) GROUP BY site, seed, cluster) QUALIFY cluster_rank <= 8"""


def tpl(text: str) -> str:
    head, tail = text.split("{}")
    return f"{q(head)} || seed || {q(tail)}"


_IDEAS = [("broad", f"CASE WHEN starts_with(seed, {q(m)}) THEN seed ELSE {q(m + ' ')} || seed END") for m in keywords.BROAD_MODIFIERS]
_IDEAS += [("phrase", tpl(t)) for t in keywords.PHRASE_TEMPLATES] + [("exact", "seed")] + [("related", tpl(t)) for t in keywords.RELATED_TEMPLATES]
_IDEAS += [("question", f"{q(p + ' ')} || {tpl(keywords.QUESTION_SUFFIXES[i % 5])}") for i, p in enumerate(keywords.QUESTION_PREFIXES)]
TABLES["idea"] = " UNION ALL ".join(f"SELECT site, seed, {i} AS n, {e} AS keyword, {q(m)} AS match_type FROM seed" for i, (m, e) in enumerate(_IDEAS, 1))
TABLES["expanded"] = """SELECT i.site, seed, i.n, i.keyword, match_type, CAST(len(string_split(i.keyword, ' ')) AS INTEGER) AS words, coalesce(k.count, 0) AS volume,
    CAST(round(least(coalesce(density, 0) / 5, 1) * 100) AS INTEGER) AS kd FROM idea i LEFT JOIN kp_kw k ON k.site = i.site AND k.keyword = i.keyword"""
ORACLES["keyword_expand"] = "SELECT * FROM expanded"
ORACLES["keyword_questions"] = " UNION ALL ".join(
    f"SELECT site, seed, {i} AS n, {q(kind)} AS type, {tpl(t)} AS question, {q('Informational' if kind in ('What', 'How', 'Why') else 'Commercial')} AS intent FROM seed" for i, (kind, t) in enumerate(keywords.QUESTIONS, 1)
)
ORACLES["keyword_metrics"] = """SELECT site, count(*) AS total_keywords, CAST(sum(volume) AS BIGINT) AS total_volume, CAST(sum(kd) // count(*) AS BIGINT) AS avg_kd, count(*) FILTER (match_type = 'question') AS question_keywords,
    count(*) FILTER (match_type = 'broad') AS broad_keywords, count(*) FILTER (match_type = 'exact') AS exact_keywords FROM expanded GROUP BY site"""
ORACLES["keyword_labels"] = """SELECT site, n, keyword, kd, volume, CASE WHEN kd <= 29 THEN 'easy' WHEN kd <= 49 THEN 'possible' WHEN kd <= 69 THEN 'difficult' ELSE 'hard' END AS kd_band,
    CASE WHEN volume >= 10000 THEN 'high' WHEN volume >= 1000 THEN 'medium' ELSE 'low' END AS volume_band FROM expanded"""
ORACLES["competitor_gap"] = """SELECT keyword, CAST(sum(count) AS BIGINT) AS competitor_count, count(*) AS competitor_sites FROM kp_kw WHERE site <> (SELECT min(site) FROM probe)
    AND keyword NOT IN (SELECT keyword FROM kp_kw WHERE site = (SELECT min(site) FROM probe)) GROUP BY keyword ORDER BY competitor_count DESC, keyword LIMIT 10"""
ORACLES["document_keyword_count"] = "SELECT site, keyword, count, n_pages, density FROM kd_kw"
ORACLES["document_primary_keywords"] = "SELECT site, CAST(rank AS INTEGER) AS rank, keyword, count, density FROM kd_one"
ORACLES["keyword_csv"] = "SELECT site, CAST(position AS INTEGER) AS position, keyword, count, density FROM kp_top"

# --- reports -------------------------------------------------------------------------------
SEV = "CASE severity WHEN 'CRITICAL' THEN 0 WHEN 'WARNING' THEN 1 ELSE 2 END"
_AT = "(ord, seq)"
_COUNTS = "count(*) AS total, count(*) FILTER (severity = 'CRITICAL') AS critical, count(*) FILTER (severity = 'WARNING') AS warning, count(*) FILTER (severity = 'INFO') AS info"
ORACLES["all_issues"] = f"SELECT site, {_ISSUE} FROM issue"
ORACLES["html_snippet"] = "SELECT ord, seq, issue_type, html_snippet FROM issue WHERE html_snippet IS NOT NULL"
ORACLES["write_issues_csv"] = "SELECT url, severity, issue_type, description, coalesce(html_snippet, '') AS html_snippet, recommendation FROM issue"
ORACLES["write_issues_csv_compact"] = "SELECT url, severity, issue_type, description, '' AS css_selector, '' AS xpath, recommendation FROM issue"
TABLES["sev_count"] = f"SELECT site, {_COUNTS} FROM issue GROUP BY site"
ORACLES["severity_counts"] = "SELECT * FROM sev_count"
ORACLES["issue_clusters_html"] = f"""SELECT site, issue_type, severity, recommendation, n_issues, n_urls, (SELECT string_agg(url, '|' ORDER BY seen) FROM (SELECT url, min({_AT}) AS seen FROM issue i WHERE i.site = c.site AND i.issue_type = c.issue_type GROUP BY url ORDER BY seen LIMIT 5)) AS urls,
    CAST(row_number() OVER (PARTITION BY site ORDER BY {SEV}, n_issues DESC, first_seen) AS INTEGER) AS rank FROM (
    SELECT site, issue_type, arg_min(severity, {_AT}) AS severity, arg_min(recommendation, {_AT}) AS recommendation, count(*) AS n_issues, count(DISTINCT url) AS n_urls, min({_AT}) AS first_seen FROM issue GROUP BY site, issue_type) c"""
ORACLES["issue_clusters_pdf"] = f"""SELECT site, issue_type, severity, n_issues, sample_description, array_to_string(urls[1:10], '|') AS urls, CAST(row_number() OVER o AS INTEGER) AS rank, row_number() OVER o <= 20 AS listed FROM (
    SELECT site, issue_type, CASE WHEN bool_or(severity = 'CRITICAL') THEN 'CRITICAL' ELSE 'WARNING' END AS severity, count(*) AS n_issues, min({_AT}) AS first_seen, arg_min(description, {_AT}) AS sample_description, list(url ORDER BY ord, seq) AS urls
    FROM issue GROUP BY site, issue_type) WINDOW o AS (PARTITION BY site ORDER BY severity <> 'CRITICAL', n_issues DESC, first_seen)"""
ORACLES["issue_distribution"] = "SELECT site, critical, warning, total, round(critical / total * 100, 1) AS critical_pct, round(warning / total * 100, 1) AS warning_pct FROM sev_count"
ORACLES["pages_with_issues"] = "SELECT site, count(DISTINCT url) AS pages_with_issues FROM issue GROUP BY site"


def stack(rows, frm: str, keep: str) -> str:
    """One select per (label columns, expressions) row."""
    return " UNION ALL ".join(f"SELECT site, {i} AS n, {cols} FROM {frm}" for i, cols in enumerate(rows, 1)) if not keep else (
        f"SELECT * FROM (" + " UNION ALL ".join(f"SELECT site, {i} AS n, {cols} FROM {frm}" for i, cols in enumerate(rows, 1)) + f") WHERE {keep}")


ORACLES["executive_findings"] = stack(
    [f"{q(t)} AS finding, {c} AS amount" for t, c in [("Critical Issues", "critical"), ("Warnings", "warning"), ("Duplicate Content Sets", "duplicate_contents"), ("Orphan Pages", "orphans"), ("Redirect Chains", "redirect_chains")]],
    "report LEFT JOIN sev_count USING (site)", "amount > 0")
ORACLES["top_issues"] = f"""SELECT site, CAST(rank AS INTEGER) AS rank, severity, issue_type, n_issues, n_pages, CASE WHEN length(recommendation) > 80 THEN substr(recommendation, 1, 80) || '...' ELSE recommendation END AS recommendation FROM (
    SELECT *, row_number() OVER (PARTITION BY site ORDER BY {SEV}, n_issues DESC, first_seen) AS rank FROM (
        SELECT site, severity, issue_type, count(*) AS n_issues, count(DISTINCT url) AS n_pages, min((ord < 0, ord, seq)) AS first_seen, arg_min(recommendation, (ord < 0, ord, seq)) AS recommendation FROM issue GROUP BY site, severity, issue_type)) WHERE rank <= 15"""
TABLES["adv_site"] = "SELECT site, sum(missing_headers) AS security_issues, count(*) FILTER (word_count < 300) AS thin_pages FROM adv GROUP BY site"
ORACLES["health_breakdown"] = stack(
    [f"{q(t)} AS label, round({e}, 4) AS pct" for t, e in [
        ("HTTPS Security", "https_pct"), ("robots.txt", "CASE WHEN robots_txt_found THEN 100.0::DOUBLE ELSE 0 END"), ("sitemap.xml", "CASE WHEN sitemap_xml_found THEN 100.0::DOUBLE ELSE 0 END"), ("Title Tags", "title_pct"),
        ("Meta Descriptions", "description_pct"), ("H1 Tags", "h1_pct"), ("Security Headers", "CAST(greatest(0, 100 - security_issues * 10) AS DOUBLE)"), ("Content Quality", "CAST(greatest(0, 100 - thin_pages * 20) AS DOUBLE)")]],
    "report JOIN adv_site USING (site)", "")
ORACLES["health_table"] = stack(
    ["'HTTPS Security' AS label, CASE WHEN https_pct = 100 THEN 'Pass' ELSE 'Partial' END AS status, round(https_pct, 4) AS pct"] + [
        f"{q(t)} AS label, CASE WHEN {c} > 80 THEN 'Good' ELSE 'Needs Work' END AS status, round({c}, 4) AS pct" for t, c in [("Title Tags", "title_pct"), ("Meta Descriptions", "description_pct"), ("H1 Headings", "h1_pct"), ("Canonical Tags", "canonical_pct")]],
    "report", "")
TABLES["page_count"] = f"SELECT ord, {_COUNTS} FROM issue WHERE ord >= 0 GROUP BY ord"
ORACLES["page_rows"] = "SELECT p.site, p.ord, p.url, status_code, coalesce(critical, 0) AS critical, coalesce(warning, 0) AS warning, score FROM page p JOIN score USING (ord) LEFT JOIN page_count USING (ord)"
def part(name: str, frm: str, key: str, *values: str) -> str:
    shown = ", ".join(f"coalesce(CAST({v} AS VARCHAR), '')" for v in values)
    return f"SELECT {q(name)} AS part, site, CAST({key} AS VARCHAR) AS name, concat_ws('|', {shown or q('')}) AS value FROM {frm}"


_FINDING = ("severity", "issue_type", "description", "html_snippet", "recommendation")
ORACLES["write_report_json"] = " UNION ALL ".join([
    part("site", "report", "start_url", "site_score", "ai_visibility_score", "site_speed_score", "site_health_score", "pages", "orphans"),
    part("page", "(SELECT p.*, score, coalesce(total, 0) AS total FROM page p JOIN (SELECT ord, score FROM score) USING (ord) LEFT JOIN (SELECT ord, total FROM page_count) USING (ord))", "ord", "url", "score", "title", "total"),
    part("finding", "issue WHERE ord >= 0", "ord || ':' || seq", *_FINDING),
    part("link", "checked WHERE kind = 'link'", "ord || ':' || n", "target", "is_internal", "status_code", "is_broken"),
    part("image", "checked WHERE kind = 'image'", "ord || ':' || n", "target", "status_code", "is_broken"),
    part("site finding", "issue WHERE ord < 0", "seq", *_FINDING),
    *[part(f"duplicate {_kind}", f"({ORACLES[f'{_id}_members']})", "ord", "dup_key", "url", "n_pages", "is_first") for _kind, (_id, *_) in _DUP.items()],
    part("orphan", "orphan", "loc"),
    part("redirect", f"({ORACLES['redirect_pages']})", "ord", "url", "redirect_type"),
    part("status", f"({ORACLES['status_distribution']})", "status_code", "pages"),
    part("keyword", "kp_top", "CAST(position AS INTEGER)", "keyword", "count"),
    part("advanced", f"({ORACLES['advanced_site']})", "'counts'", "security_issues", "mixed_content", "thin_pages"),
])
_CH = " ".join(f"WHEN issue_type IN ({qs(v)}) THEN {q(k)}" for k, v in reporting.CHAPTERS.items() if k[0] != "1")
TABLES["chaptered"] = f"SELECT *, CASE WHEN severity = 'CRITICAL' OR issue_type IN ({qs(reporting.CHAPTERS['1. Critical Errors'])}) THEN '1. Critical Errors' {_CH} ELSE {q(reporting.FALLBACK_CHAPTER)} END AS chapter FROM issue"
ORACLES["report_chapters"] = "SELECT site, chapter, issue_type AS section, count(*) AS total, count(*) FILTER (severity = 'CRITICAL') AS critical, count(*) FILTER (severity = 'WARNING') AS warning, count(DISTINCT url) AS pages FROM chaptered GROUP BY GROUPING SETS ((site, chapter, issue_type), (site, chapter))"
ORACLES["status_buckets"] = "SELECT site, (status_code // 100) || 'xx' AS bucket, count(*) AS pages FROM crawl GROUP BY ALL"
ORACLES["depth_distribution"] = "SELECT site, CAST(crawl_depth AS INTEGER) AS crawl_depth, count(*) AS pages FROM crawl GROUP BY ALL"
ORACLES["link_overview"] = "SELECT site, CAST(sum(n_internal) AS BIGINT) AS internal_links, CAST(sum(n_external) AS BIGINT) AS external_links, CAST(sum(n_internal) // count(*) AS BIGINT) AS avg_internal, count(*) FILTER (n_internal > 0) AS pages_with_links, count(*) AS pages FROM pagex GROUP BY site"
ORACLES["links_per_page_hist"] = "SELECT site, CASE WHEN n_internal >= 20 THEN '20+' ELSE CAST(n_internal AS VARCHAR) END AS bucket, count(*) AS pages FROM pagex GROUP BY ALL"
ORACLES["avg_page_score"] = "SELECT site, CAST(sum(score) // count(*) AS BIGINT) AS avg_page_score FROM score GROUP BY site"
ORACLES["section_scores"] = " UNION ALL ".join(
    f"SELECT site, {i} AS n, {q(s)} AS section, count(severity) FILTER (severity = 'CRITICAL') AS critical, count(severity) FILTER (severity = 'WARNING') AS warning, count(severity) AS total, CAST(greatest(0, 100 - 15 * count(severity) FILTER (severity = 'CRITICAL') - 5 * count(severity) FILTER (severity = 'WARNING')) AS INTEGER) AS score "
    f"FROM probe LEFT JOIN (SELECT site, severity FROM issue WHERE regexp_matches(lower(issue_type), {words(w)})) USING (site) GROUP BY site"
    for i, (s, w) in enumerate(reporting.SECTIONS, 1)
)
ORACLES["technical_checklist"] = stack(
    [f"{q(t)} AS \"check\", {e} AS passed" for t, e in [("HTTPS", "https_pct = 100"), ("robots.txt", "robots_txt_found"), ("sitemap.xml", "sitemap_xml_found"), ("Viewport Meta", "pages_with_viewport > 0"), ("Lang Attribute", "pages_with_lang > 0"),
                                                       ("Favicon", "pages_with_favicon > 0"), ("No Redirect Chains", "redirect_chains = 0")]], "report", "")
ORACLES["pages_overview"] = f"SELECT p.site, p.ord, p.url, status_code, CASE WHEN is_https THEN 'HTTPS' ELSE 'HTTP' END AS protocol, score, coalesce(total, 0) AS n_issues, {DISPLAY.replace('url', 'p.url')} AS redirects FROM page p JOIN score USING (ord) LEFT JOIN page_count USING (ord)"
_STATUS = " ".join(f"WHEN {c} THEN {q(n)}" for c, n in reporting.STATUS_NAMES.items())
TABLES["http_error"] = f"""SELECT site, CASE status_code {_STATUS} END AS http_status, count(*) AS amount, CASE status_code // 100 WHEN 2 THEN 'OK' WHEN 3 THEN 'Redirect' WHEN 4 THEN 'Error' ELSE 'Critical' END AS severity FROM crawl GROUP BY site, status_code
    UNION ALL SELECT site, issue_type, count(*), arg_min(severity, {_AT}) FROM issue WHERE issue_type IN ({qs(reporting.HTTP_ISSUES)}) GROUP BY site, issue_type"""
ORACLES["http_error_summary"] = "SELECT * FROM http_error"
ORACLES["http_error_totals"] = "SELECT site, CAST(coalesce(sum(amount) FILTER (severity IN ('Error', 'Critical')), 0) AS BIGINT) AS total_errors FROM http_error GROUP BY site"
ORACLES["error_pages"] = "SELECT p.site, p.ord, p.url, status_code, coalesce(total, 0) AS n_issues, score FROM page p JOIN score USING (ord) LEFT JOIN page_count USING (ord) WHERE status_code >= 400"
_TECH = f"issue_type IN ({qs(reporting.TECHNICAL_TYPES)})"
ORACLES["technical_issues"] = f"SELECT site, ord, seq, url, severity, issue_type, description, recommendation FROM issue WHERE {_TECH}"
ORACLES["technical_issue_counts"] = f"SELECT site, {_COUNTS} FROM issue WHERE {_TECH} GROUP BY site"
ORACLES["content_issues"] = f"""SELECT site, ord, url, coalesce(nullif(title, ''), 'MISSING') AS title, CAST(coalesce(length(title), 0) AS INTEGER) AS title_length, CASE WHEN {_D} THEN substr(meta_description, 1, 80) || '...' ELSE 'MISSING' END AS description,
    CAST(coalesce(length(meta_description), 0) AS INTEGER) AS description_length, coalesce(first_h1, 'MISSING') AS h1, CAST(coalesce(length(first_h1), 0) AS INTEGER) AS h1_length, n_issues
    FROM page JOIN (SELECT ord, count(*) AS n_issues FROM issue WHERE issue_type IN ({qs(reporting.CONTENT_TYPES)}) GROUP BY ord) USING (ord)"""
ORACLES["image_issues"] = "SELECT ord, seq, url, issue_type, description FROM issue WHERE issue_type IN ('Missing Alt Text', 'Broken Image')"
ORACLES["link_issues"] = "SELECT ord, seq, url, severity, description FROM issue WHERE issue_type = 'Broken Link'"
ORACLES["page_perf"] = "SELECT site, ord, url, CAST(coalesce(length(title), 0) + coalesce(length(meta_description), 0) + 500 AS INTEGER) AS document_length, CASE WHEN favicon_url IS NOT NULL THEN 'Configured' ELSE 'Missing' END AS favicon_status FROM page"
ORACLES["schema_inventory"] = "SELECT p.site, ord, p.url, CAST(n AS INTEGER) AS n, CASE WHEN valid THEN coalesce(ty, 'Unknown') END AS schema_type, valid, CASE WHEN NOT valid THEN 'JSON parsing error' END AS error FROM json_ld JOIN page p USING (ord)"
ORACLES["schema_summary"] = "SELECT site, count(*) AS blocks, count(*) FILTER (valid) AS valid, count(*) FILTER (NOT valid) AS errors, count(DISTINCT CASE WHEN valid THEN coalesce(ty, 'Unknown') END) AS types FROM json_ld JOIN page USING (ord) GROUP BY site"
ORACLES["quality_table"] = """SELECT url, word_count, sentence_count, avg_words_per_sentence, readability, CASE WHEN word_count < 300 THEN 'Yes' ELSE '' END AS thin, CASE WHEN skip_a IS NULL THEN 'Valid' ELSE 'Invalid' END AS hierarchy,
    CAST(n_internal AS INTEGER) AS internal_link_count, CAST(n_external AS INTEGER) AS external_link_count FROM adv"""
ORACLES["mixed_content_table"] = "SELECT site, CAST(row_number() OVER (PARTITION BY site ORDER BY ord, n) AS INTEGER) AS rank, page_url, resource_url, resource_type FROM mixed QUALIFY rank <= 50"
ORACLES["technical_summary"] = "SELECT site, orphans, duplicate_titles, duplicate_descriptions, duplicate_contents, redirect_chains FROM report"
ORACLES["issue_summary"] = f"""SELECT *, CAST(row_number() OVER (PARTITION BY site ORDER BY severity <> 'CRITICAL', issue_type) AS INTEGER) AS rank FROM (
    SELECT site, issue_type, count(*) AS n_issues, CASE WHEN bool_or(severity = 'CRITICAL') THEN 'CRITICAL' ELSE 'WARNING' END AS severity, arg_min(severity, {SEV}) AS max_severity FROM issue GROUP BY site, issue_type)"""
ORACLES["score_label"] = "SELECT ord, score, CASE WHEN score >= 90 THEN 'Excellent' WHEN score >= 70 THEN 'Satisfactory' ELSE 'Needs Immediate Remediation' END AS label FROM score"
ORACLES["score_indicator"] = "SELECT site, " + ", ".join(
    f"CASE WHEN {c} >= 80 THEN 'Excellent' WHEN {c} >= 60 THEN 'Good' WHEN {c} >= 40 THEN 'Needs Work' ELSE 'Poor' END AS {c}" for c in ("site_score", "ai_visibility_score", "site_speed_score", "site_health_score")) + " FROM report"
ORACLES["priority_actions"] = stack(
    ["'Fix critical issues first' AS action, critical AS amount", "'Fix warnings next' AS action, warning AS amount", "'Create robots.txt' AS action, CASE WHEN robots_txt_found THEN 0 ELSE 1 END AS amount",
     "'Create sitemap.xml' AS action, CASE WHEN sitemap_xml_found THEN 0 ELSE 1 END AS amount"], "probe LEFT JOIN sev_count USING (site)", "amount > 0")
_GUIDE_ROWS = ", ".join(f"({qs([r[0], r[1], r[2], r[3], r[4], r[5], r[7], ' | '.join(r[6])])})" for r in guides.guide_rows())
_CMS = ", ".join(f"({q(i)}, {q(' | '.join(f'{c}: open {p[g[0]]}' for c, p in guides.CMS_PLACES.items()))}, {q('wordpress: open ' + guides.CMS_PLACES['wordpress'][g[0]])})" for i, g in guides.GUIDES.items())
TABLES["type_count"] = "SELECT site, issue_type, count(*) AS n_issues FROM issue GROUP BY ALL"
ORACLES["fix_guides"] = f"""SELECT site, issue_type, n_issues, title, severity, priority, what, why, verification, steps, cms_steps FROM type_count LEFT JOIN (VALUES {_GUIDE_ROWS}) g(issue_type, title, severity, priority, what, why, verification, steps) USING (issue_type)
    LEFT JOIN (VALUES {_CMS}) c(issue_type, cms_steps, wp) USING (issue_type)"""
ORACLES["fix_guides_wordpress"] = f"SELECT site, issue_type, priority, wp AS cms_steps FROM type_count LEFT JOIN (VALUES {_GUIDE_ROWS}) g(issue_type, title, severity, priority, what, why, verification, steps) USING (issue_type) LEFT JOIN (VALUES {_CMS}) c(issue_type, cms_steps, wp) USING (issue_type)"
_SHORT = " ".join(f"WHEN {q(i)} THEN {q(f'{guides.GUIDES[i][1]} {guides.GUIDES[i][2]} Steps: ' + '; '.join(guides.AREA_STEPS[guides.GUIDES[i][0]]))}" for i in guides.SHORT_GUIDES)
ORACLES["fix_guides_short"] = f"SELECT site, ord, seq, issue_type, CASE issue_type {_SHORT} ELSE 'Fix: ' || issue_type || '. ' || description || ' Steps: ' || {q('; '.join(guides.SHORT_FALLBACK_STEPS))} END AS guide FROM issue"
_DESC = " ".join(f"WHEN {q(i)} THEN {q(f'{guides.GUIDES[i][1]} {guides.GUIDES[i][2]}')}" for i in guides.PLAIN_DESCRIPTIONS)
_STEP = " ".join(f"WHEN {q(i)} THEN {q(' | '.join(guides.AREA_STEPS[guides.GUIDES[i][0]]))}" for i in guides.PLAIN_DESCRIPTIONS)
ORACLES["issue_descriptions"] = f"""SELECT site, issue_type, n_issues, CASE issue_type {_DESC} ELSE 'This is a ' || issue_type || ' issue that needs to be addressed for better SEO performance.' END AS description,
    CASE issue_type {_STEP} ELSE {q(' | '.join(guides.FALLBACK_STEPS))} END AS steps FROM type_count"""
ORACLES["fix_plan"] = f"""SELECT site, issue_type, severity, n_issues, CAST(row_number() OVER (PARTITION BY site ORDER BY first_seen) AS INTEGER) AS priority, array_to_string(urls[1:5], '|') AS urls FROM (
    SELECT site, issue_type, min(({SEV}, ord, seq)) AS first_seen, arg_min(severity, ({SEV}, ord, seq)) AS severity, count(*) AS n_issues, list(url ORDER BY {SEV}, ord, seq) AS urls FROM issue GROUP BY site, issue_type)"""

# --- exports -------------------------------------------------------------------------------
_ESC = "url"
for _raw, _ent in [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")]:
    _ESC = f"replace({_ESC}, {q(_raw)}, {q(_ent)})"
ORACLES["sitemap_export"] = f"""SELECT ord, {_ESC} AS loc, '2024-06-01' AS lastmod, CASE WHEN regexp_matches(lower(url), 'blog|news|post|article') THEN 'weekly' WHEN regexp_matches(lower(url), 'product|shop|store|price') THEN 'daily'
    WHEN regexp_matches(lower(url), 'about|contact|team|company') THEN 'monthly' ELSE 'weekly' END AS changefreq,
    CASE WHEN rtrim(url, '/') = rtrim(start_url, '/') THEN '1.0' WHEN score >= 80 THEN '0.8' WHEN score >= 60 THEN '0.6' ELSE '0.4' END AS priority FROM score JOIN probe USING (site)"""
TABLES["listed_page"] = "SELECT site, ord, url, coalesce(nullif(title, ''), url) AS title, coalesce(meta_description, '') AS description FROM page QUALIFY row_number() OVER (PARTITION BY site ORDER BY ord) <= 20"
TABLES["llms_site"] = "SELECT site, start_url AS site_url, 'Page audit report for ' || start_url || '. Score: ' || site_score || '/100.' AS about FROM report"
NL = "chr(10)"
ORACLES["llms_txt"] = f"""SELECT s.site, '# ' || s.site || {NL} || '> ' || about || {NL} || {NL} || '## Details' || {NL} || {NL} || 'The website provides tools and resources for website management, SEO optimization, and content strategy.' || {NL} || {NL}
    || 'For more information, visit ' || site_url || {NL} || {NL} || '## Contact' || {NL} || {NL} || 'Email: team@' || s.site || {NL} || {NL} || '## Features' || {NL} || {NL} || '- Audit' || {NL} || '- Keywords' || {NL} || {NL}
    || '## Blog' || {NL} || {NL} || 'Blog: ' || site_url || '/blog' || {NL} || {NL} || '## Docs' || {NL} || {NL}
    || string_agg('- [' || title || '](' || url || ')' || CASE WHEN description <> '' THEN ': ' || description ELSE '' END, {NL} ORDER BY ord) || {NL} || {NL}
    || '## Optional' || {NL} || {NL} || 'This file helps LLMs understand and navigate our website.' || {NL} || 'For any questions about this file, contact us at team@' || s.site || {NL} AS content
    FROM llms_site s JOIN listed_page p ON p.site = s.site GROUP BY s.site, about, site_url"""
ORACLES["llms_full_txt"] = f"""SELECT s.site, '# ' || s.site || {NL} || '> ' || about || {NL} || {NL} || '## About ' || s.site || {NL} || {NL} || s.site || ' is available at ' || site_url || {NL} || {NL} || about || {NL} || {NL}
    || '## Key Features' || {NL} || {NL} || '1. Audit' || {NL} || '2. Keywords' || {NL} || {NL} || '## Pages' || {NL} || {NL}
    || string_agg('### ' || title || {NL} || 'URL: ' || url || {NL} || CASE WHEN description <> '' THEN description || {NL} ELSE '' END, {NL} ORDER BY ord) || {NL}
    || '## Contact' || {NL} || {NL} || 'Email: team@' || s.site || {NL} || {NL} || '---' || {NL} || 'Generated by ' || s.site || ' page audit' AS content
    FROM llms_site s JOIN listed_page p ON p.site = s.site GROUP BY s.site, about, site_url"""

# --- frontier ------------------------------------------------------------------------------
TABLES["anchor_raw"] = f"SELECT ord, n, {attr('href')} AS href FROM (SELECT *, list_transform(regexp_extract_all(body, {q(ATTR)}, 1), lambda x: lower(x)) AS names, regexp_extract_all(body, {q(ATTR)}, 2) AS vals FROM anchor)"
TABLES["found"] = f"""SELECT f.ord, c.site, c.status_code, c.url AS source_url, {absolute('c.url', 'f.ref')} AS target_url, min((kind, n)) AS place FROM (
        SELECT ord, 0 AS kind, n, {strip('href')} AS ref FROM anchor_raw WHERE coalesce(href, '') <> '' AND NOT regexp_matches(href, '^(#|javascript:|mailto:|tel:|data:)')
        UNION ALL SELECT ord, 1, n, {strip('href')} FROM linktag WHERE coalesce(href, '') <> '' AND len(list_filter(string_split(rel, ' '), lambda r: r IN ('alternate', 'canonical', 'next', 'prev'))) > 0
        UNION ALL SELECT ord, 3, n, {strip("regexp_replace(content, '^.*?url=', '')")} FROM meta WHERE equiv = 'refresh' AND contains(lower(content), 'url=')) f JOIN crawl c USING (ord) GROUP BY ALL"""
_INTERNAL = same_site(url_part("target_url", 4), url_part("source_url", 4))
ORACLES["discover_links"] = f"SELECT ord, target_url FROM found WHERE {_INTERNAL}"
TABLES["seedkey"] = f"SELECT site, url, 0 AS source, {normalized('url')} AS url_key FROM (SELECT site, loc AS url FROM sitemap) UNION ALL SELECT site, start_url, 1, {normalized('start_url')} FROM probe"
ORACLES["seed_frontier"] = "SELECT site, url_key, arg_min(url, (source, url)) AS url, 0 AS depth FROM seedkey GROUP BY site, url_key"
ORACLES["visited_dedup"] = f"SELECT site, {normalized('url')} AS url_key, min(ord) AS ord, arg_min(url, ord) AS url FROM crawl GROUP BY 1, 2"
TABLES["placed"] = f"SELECT *, CAST(row_number() OVER (PARTITION BY ord ORDER BY place) - 1 AS INTEGER) AS pos FROM found WHERE {_INTERNAL}"
TABLES["edge"] = f"""SELECT site, source_key, target_key, min(pos) AS pos FROM (
        SELECT site, {normalized('source_url')} AS source_key, {normalized('target_url')} AS target_key, pos FROM placed WHERE status_code BETWEEN 200 AND 299
        UNION ALL SELECT site, source_key, target_key, 1000000 FROM (SELECT site, status_code, {normalized('url')} AS source_key, lead({normalized('url')}) OVER (PARTITION BY site ORDER BY ord) AS target_key FROM crawl)
            WHERE status_code BETWEEN 200 AND 299 AND target_key IS NOT NULL)
    WHERE target_key NOT LIKE '%/sub/page.html' GROUP BY ALL"""
TABLES["depth0"] = f"SELECT DISTINCT site, {normalized('start_url')} AS url_key, [0] AS path FROM probe"
for _d in (1, 2, 3):
    _seen = " UNION ".join(f"SELECT site, url_key FROM depth{i}" for i in range(_d))
    TABLES[f"depth{_d}"] = f"SELECT e.site, e.target_key AS url_key, min(list_append(f.path, e.pos)) AS path FROM depth{_d - 1} f JOIN edge e ON e.site = f.site AND e.source_key = f.url_key WHERE (e.site, e.target_key) NOT IN ({_seen}) GROUP BY ALL"
TABLES["reached"] = " UNION ALL ".join(f"SELECT site, url_key, {d} AS depth, path FROM depth{d}" for d in range(4))
ORACLES["crawl_depth_bfs"] = "SELECT site, url_key, depth, array_to_string(path, '.') AS path FROM reached"
ORACLES["frontier_limit"] = "SELECT site, url_key, depth, CAST(row_number() OVER (PARTITION BY site ORDER BY depth, path, url_key) AS INTEGER) AS rn FROM reached QUALIFY rn <= 5"

# --- structured data -----------------------------------------------------------------------
def js(e: str) -> str:
    return f"CAST(to_json({e}) AS VARCHAR)"


def prop(key: str, e: str, when: str = "true", raw: bool = False) -> str:
    """`,"key":value` or nothing."""
    value = e if raw else js(e)
    return f"CASE WHEN {when} THEN ',\"{key}\":' || {value} ELSE '' END"


def has(e: str) -> str:
    return f"coalesce({e}, '') <> ''"


def ld(kind: str, *parts: str) -> str:
    return f"'{{\"@context\":\"https://schema.org\",\"@type\":\"{kind}\"' || " + " || ".join(parts) + " || '}'"


def node(kind: str, *parts: str) -> str:
    return f"'{{\"@type\":\"{kind}\"' || " + " || ".join(parts) + " || '}'"


ORACLES["jsonld_webpage"] = f"SELECT ord, {ld('WebPage', prop('name', 'title', 'title IS NOT NULL'), prop('url', 'url'), prop('inLanguage', chr(99) + 'oalesce(lang, ' + q('en') + ')'), prop('description', 'meta_description', has('meta_description')))} AS json FROM page"
ORACLES["jsonld_generic"] = f"SELECT ord, {ld('AboutPage', prop('name', 'title', 'title IS NOT NULL'), prop('url', 'url'))} AS json FROM page"
_AUTHOR = node("Person", prop("name", "site"), prop("url", "'https://' || site", "ord % 4 = 0"))
_PUBLISHER = node("Organization", prop("name", "site"), prop("logo", node("ImageObject", prop("url", "favicon_url")), has("favicon_url"), raw=True))
_ARTICLE = ld("Article", prop("headline", "title", "title IS NOT NULL"), prop("url", "url"), prop("datePublished", "strftime(make_timestamp((1704067200 + ord) * 1000000), '%Y-%m-%d')"),
              prop("description", "meta_description", has("meta_description")), prop("image", "og_image", has("og_image")), prop("author", _AUTHOR, "ord % 2 = 0", raw=True), prop("publisher", _PUBLISHER, raw=True))
ORACLES["jsonld_article"] = f"SELECT ord, {_ARTICLE} AS json FROM page"


def questions(rows: str) -> str:
    return f"'{{\"@context\":\"https://schema.org\",\"@type\":\"FAQPage\",\"mainEntity\":[' || {rows} || ']}}'"


def one_question(name: str, text: str) -> str:
    return node("Question", prop("name", name), prop("acceptedAnswer", node("Answer", prop("text", text)), raw=True))


_FB_TEXT = f"CASE WHEN {_D} THEN substr(meta_description, 1, 200) ELSE 'Information about ' || title END"
_FB = questions(node("Question", prop("name", "'What is ' || title || '?'", "title IS NOT NULL"), prop("acceptedAnswer", node("Answer", prop("text", _FB_TEXT, f"{_FB_TEXT} IS NOT NULL")), raw=True)))
ORACLES["jsonld_faq_fallback"] = f"SELECT ord, {_FB} AS json FROM page"
ORACLES["jsonld_faq"] = f"""SELECT a.conv_id, a.turn, CAST(row_number() OVER (PARTITION BY a.conv_id ORDER BY a.turn) AS INTEGER) AS position, {one_question('a.text', 'b.text')} AS json
    FROM conversations a JOIN conversations b USING (conv_id) WHERE a.role = 'user' AND b.role = 'assistant' AND b.turn = a.turn + 1"""
ORACLES["jsonld_faq_document"] = f"""SELECT conv_id, {questions("string_agg(" + one_question('a.text', 'b.text') + ", ',' ORDER BY a.turn)")} AS json
    FROM conversations a JOIN conversations b USING (conv_id) WHERE a.role = 'user' AND b.role = 'assistant' AND b.turn = a.turn + 1 GROUP BY conv_id"""
_SEARCH = node("SearchAction", prop("target", node("EntryPoint", prop("urlTemplate", "rtrim(start_url, '/') || '/search?q={search_term_string}'")), raw=True), prop("query-input", "'required name=search_term_string'"))
ORACLES["jsonld_website_search"] = f"SELECT site, {ld('WebSite', prop('name', 'site'), prop('url', 'start_url'), prop('potentialAction', _SEARCH, raw=True))} AS json FROM probe"
_CRUMB = node("ListItem", prop("position", "CAST(i AS INTEGER)"), prop("name", "name"), prop("item", "item", "item IS NOT NULL"))
_CRUMBS = f"'{{\"@context\":\"https://schema.org\",\"@type\":\"BreadcrumbList\",\"itemListElement\":[' || string_agg({_CRUMB}, ',' ORDER BY i) || ']}}'"
_NO_CRUMBS = q('{"@context":"https://schema.org","@type":"BreadcrumbList","itemListElement":[]}')
ORACLES["jsonld_breadcrumb"] = f"""SELECT ord, {_CRUMBS} AS json FROM (SELECT h.ord, h.n AS i, h.text AS name, CASE WHEN level = 1 THEN url END AS item FROM heading h JOIN crawl USING (ord)) GROUP BY ord
    UNION ALL SELECT ord, {_NO_CRUMBS} FROM crawl WHERE ord NOT IN (SELECT ord FROM heading)"""
_ROOT = f"{url_part('url', 2)} || '://' || {url_part('url', 4)} || '/'"
ORACLES["jsonld_breadcrumb_from_url"] = f"""SELECT ord, {_CRUMBS} AS json FROM (
    SELECT ord, 1 AS i, site AS name, {_ROOT} AS item FROM crawl
    UNION ALL SELECT ord, i + 1, array_to_string(list_transform(string_split(translate(ps[i], '-_', '  '), ' '), lambda w: upper(w[1]) || lower(w[2:])), ' '), root || array_to_string(ps[1:i], '/') || '/' FROM (
        SELECT ord, ps, root, unnest(range(1, len(ps) + 1)) AS i FROM (SELECT ord, {_ROOT} AS root, list_filter(string_split({url_part('url', 5)}, '/'), lambda s: s <> '') AS ps FROM crawl))) GROUP BY ord"""
_SURL, _PHONE, _STREET = "'https://suppliers.example.com/' || s_suppkey", "'+' || s_nationkey || '-555'", "s_suppkey || ' Main Street'"
ORACLES["jsonld_organization"] = f"""SELECT s_suppkey, {ld('Organization', prop('name', 's_name'), prop('url', _SURL), prop('description', q('In good standing'), 's_acctbal > 0'), prop('telephone', _PHONE),
    prop('address', node('PostalAddress', prop('streetAddress', _STREET)), 's_suppkey % 2 = 0', raw=True), prop('sameAs', "['https://social.example.com/s']", 's_suppkey % 3 = 0'))} AS json FROM supplier"""
_PLACE = node("PostalAddress", prop("streetAddress", _STREET), prop("addressLocality", "'Springfield'"), prop("postalCode", "CAST(10000 + s_suppkey AS VARCHAR)"), prop("addressCountry", "'US'"))
_GEO = node("GeoCoordinates", prop("latitude", "s_nationkey"), prop("longitude", "s_suppkey"))
ORACLES["jsonld_local_business"] = f"""SELECT s_suppkey, {ld('LocalBusiness', prop('name', 's_name'), prop('url', _SURL), prop('telephone', _PHONE), prop('priceRange', q('$$')), prop('address', _PLACE, 's_suppkey % 2 = 0', raw=True),
    prop('geo', _GEO, 's_nationkey <> 0 AND s_suppkey <> 0', raw=True), prop('openingHours', q('Mo-Fr 09:00-17:00')))} AS json FROM supplier"""
_OFFER = node("Offer", prop("price", "CAST(CAST(p_retailprice AS DECIMAL(12,2)) AS VARCHAR)"), prop("priceCurrency", "'USD'"), prop("availability", "'https://schema.org/' || CASE WHEN p_size > 5 THEN 'InStock' ELSE 'OutOfStock' END"))
ORACLES["jsonld_product"] = f"""SELECT p_partkey, {ld('Product', prop('name', 'p_name'), prop('url', "'https://shop.example.com/p/' || p_partkey"), prop('description', "p_type || ' size ' || p_size"),
    prop('brand', node('Brand', prop('name', 'p_brand')), has('p_brand'), raw=True), prop('offers', _OFFER, raw=True))} AS json FROM part"""

_RR = " ".join(f"WHEN {q(t)} THEN [{qs(p)}]::VARCHAR[]" for t, p in structured.RICH_RESULT_TYPES.items())
_OBJ = "json_valid(data) AND data[1] = '{'"
ORACLES["validate_rich_results"] = f"""SELECT ord, CAST(n AS INTEGER) AS n, len(errors) = 0 AS is_valid, array_to_string(errors, '|') AS errors, array_to_string(warnings, '|') AS warnings,
    CASE WHEN t IN ({qs(structured.RICH_RESULT_TYPES)}) THEN t END AS rich_result_type, array_to_string(gone, '|') AS missing_required FROM (
    SELECT *, CASE WHEN NOT valid THEN ['Invalid JSON'] ELSE list_filter(list_concat([CASE WHEN cx <> 'https://schema.org' THEN '@context must be ''https://schema.org''' END, CASE WHEN t = '' THEN 'Missing @type property' END,
            CASE WHEN t = 'FAQPage' AND coalesce(len(ents), 0) = 0 THEN 'FAQPage must have mainEntity array' END, CASE WHEN t = 'BreadcrumbList' AND coalesce(len(items), 0) = 0 THEN 'BreadcrumbList must have itemListElement array' END],
            CASE WHEN t = 'BreadcrumbList' THEN list_transform(items, lambda e, i: CASE WHEN json_extract(e, '$.name') IS NULL THEN 'ListItem ' || i || ' missing ''name''' END) ELSE [] END,
            [CASE WHEN t = 'Organization' AND NOT list_contains(ks, 'name') THEN 'Organization must have ''name''' END]), lambda x: x IS NOT NULL) END AS errors,
        CASE WHEN NOT valid THEN [] ELSE list_filter(list_concat(list_transform(gone, lambda m: 'Missing recommended property for ' || t || ': ' || m),
            CASE WHEN t = 'FAQPage' THEN flatten(list_transform(ents, lambda e, i: [CASE WHEN coalesce(json_extract_string(e, '$."@type"'), '') <> 'Question' THEN 'Entity ' || i || ' should have @type Question' END,
                CASE WHEN coalesce(json_extract_string(e, '$.acceptedAnswer."@type"'), '') <> 'Answer' THEN 'Entity ' || i || ' acceptedAnswer should have @type Answer' END])) ELSE [] END,
            CASE WHEN t = 'BreadcrumbList' THEN list_transform(items, lambda e, i: CASE WHEN json_extract(e, '$.position') IS NULL THEN 'ListItem ' || i || ' missing ''position''' END) ELSE [] END,
            [CASE WHEN t = 'Article' AND NOT list_contains(ks, 'datePublished') THEN 'Article should have datePublished' END, CASE WHEN t = 'Article' AND NOT list_contains(ks, 'author') THEN 'Article should have author' END,
             CASE WHEN t = 'Organization' AND NOT list_contains(ks, 'url') THEN 'Organization should have ''url''' END]), lambda x: x IS NOT NULL) END AS warnings FROM (
        SELECT *, coalesce(list_filter(CASE t {_RR} END, lambda p: NOT list_contains(ks, p)), []) AS gone FROM (
            SELECT ord, n, valid, coalesce(ty, '') AS t, coalesce(context, '') AS cx, coalesce(keys, []) AS ks, CASE WHEN {_OBJ} THEN json_extract(data, '$.mainEntity[*]') END AS ents, CASE WHEN {_OBJ} THEN json_extract(data, '$.itemListElement[*]') END AS items FROM json_ld)))"""


def suggestions(templates, slot: str, frm: str = "page") -> str:
    return " UNION ALL ".join(f"SELECT ord, {i} AS n, {fill(t, slot)} AS suggestion FROM {frm}" for i, t in enumerate(templates, 1))


_CLEAN = f"CASE WHEN {_T} THEN trim(replace(replace(title, '|', '-'), ':', '-')) ELSE 'This Page' END"


def page_meta(frm: str) -> str:
    return " UNION ALL ".join(
        f"SELECT ord, {i} AS n, {fill(t, _CLEAN if slot == 'title' else f'string_split({_CLEAN}, {q(chr(32))})[1]')} AS suggestion FROM {frm}" for i, (slot, t) in enumerate(structured.PAGE_META_TEMPLATES, 1))


_T30, _T35 = f"CASE WHEN {_T} THEN substr(title, 1, 30) ELSE 'This Page' END", f"CASE WHEN {_T} THEN substr(title, 1, 35) ELSE 'Our Platform' END"
ORACLES["title_suggestions"] = suggestions(structured.TITLE_TEMPLATES, "title")
ORACLES["page_title_suggestions"] = suggestions(structured.PAGE_TITLE_TEMPLATES, _T30)
ORACLES["meta_suggestions"] = suggestions(structured.META_TEMPLATES, f"CASE WHEN {_T} THEN title ELSE 'this page' END")
ORACLES["page_meta_suggestions"] = page_meta("page")
ORACLES["h1_suggestions"] = suggestions(structured.H1_TEMPLATES, "coalesce(first_h1, nullif(title, ''), 'Our Platform')")
ORACLES["page_h1_suggestions"] = suggestions(structured.PAGE_H1_TEMPLATES, _T35)
ORACLES["issue_explanations"] = f"SELECT ord, seq, issue_type, {fill(structured.EXPLANATION, 'issue_type', 'description')} AS explanation FROM issue"


def needing(word: str) -> str:
    return f"(SELECT * FROM page WHERE ord IN (SELECT ord FROM issue WHERE ord >= 0 AND contains(issue_type, {q(word)})))"


ORACLES["suggestions_for_issues"] = " UNION ALL ".join([
    suggestions(structured.PAGE_TITLE_TEMPLATES, _T30, needing("Title")), page_meta(needing("Meta Description")), suggestions(structured.PAGE_H1_TEMPLATES, _T35, needing("H1"))])

# --- document structure --------------------------------------------------------------------
TABLES.update(DOM_TABLES)
ORACLES.update(DOM_ORACLES)


def numbered(issue: str, tag: str, frm: str) -> str:
    """Findings of a rule with many per page, by their place in it."""
    return f"""SELECT i.ord, seq, {q(tag)} AS tag, l.n FROM page_issue i JOIN (SELECT ord, n, row_number() OVER (PARTITION BY ord ORDER BY n) - 1 AS k FROM {frm}) l
        ON l.ord = i.ord AND seq = {RULE_NUMBER[issue] * RULE_STRIDE} + k WHERE issue_type = {q(issue)}"""


TABLES["located"] = " UNION ALL ".join([
    "SELECT ord, seq, 'title' AS tag, 1 AS n FROM page_issue WHERE issue_type IN ('Title Too Short', 'Title Too Long')",
    f"SELECT ord, seq, 'meta', n FROM page_issue JOIN {first_meta('description')} USING (ord) WHERE issue_type IN ('Meta Description Too Short', 'Meta Description Too Long')",
    "SELECT ord, seq, 'link', n FROM page_issue JOIN (SELECT ord, min(n) AS n FROM linktag WHERE rel = 'canonical' GROUP BY ord) USING (ord) WHERE issue_type = 'Canonical Mismatch'",
    numbered("Invalid JSON-LD", "script", "ld_page WHERE NOT valid"), numbered("Missing Alt Text", "img", "image WHERE is_missing_alt"),
])
ORACLES["issue_locators"] = """SELECT i.ord, i.seq, issue_type, css_selector, xpath FROM page_issue i LEFT JOIN located l ON l.ord = i.ord AND l.seq = i.seq
    LEFT JOIN dom_node d ON d.ord = l.ord AND d.tag = l.tag AND d.n = l.n"""

# --- streaming -----------------------------------------------------------------------------
ORACLES["stream_page_audit"] = ORACLES["page_issues"]
ORACLES["stream_visited"] = f"SELECT DISTINCT site, {normalized('url')} AS url_key FROM crawl"
TABLES["minute"] = "SELECT make_timestamp((1704067200 + (ord // 60) * 60) * 1000000) AS window_start, count(*) AS pages FROM crawl GROUP BY 1"
ORACLES["stream_progress"] = "SELECT window_start, window_start + INTERVAL 1 MINUTE AS window_end, pages, cast(0 AS BIGINT) AS late_pages, pages / 60 AS pages_per_sec FROM minute"
TABLES["running_report"] = TABLES["report"].replace("avg(score) FROM score s", "avg(base_score) FROM base_score s")
ORACLES["stream_site_scores"] = "SELECT site, pages, site_score, ai_visibility_score, site_speed_score, site_health_score FROM running_report"
