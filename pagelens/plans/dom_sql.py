"""Checking SQL for document structure: element places, selectors, paths and link positions.

Tags are read in order by a recursive query whose state is the list of open elements; places among
siblings are counted from the parents afterwards, and paths are joined from each element upwards.
"""

from __future__ import annotations

from pagelens.operators.dom import CLOSED_BY_SIBLING, NODE_TAGS, VOID_TAGS


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _list(texts) -> str:
    return ", ".join(_q(t) for t in sorted(texts))


_TAG = _q(r"""<(/?)([a-zA-Z][a-zA-Z0-9-]*)((?:[^>"']|"[^"]*"|'[^']*')*)>""")
_EMPTIED = "uncommented"
for _kind in ("script", "style"):
    _EMPTIED = f"regexp_replace({_EMPTIED}, {_q(rf'(?is)(<{_kind}\b[^>]*>).*?(</{_kind}\s*>)')}, {_q(chr(92) + '1' + chr(92) + '2')}, 'g')"
_CLOSES = "CASE o " + " ".join(f"WHEN {_q(t)} THEN t.tag IN ({_list(by)})" for t, by in CLOSED_BY_SIBLING.items()) + " ELSE false END"


def _attribute(name: str) -> str:
    pattern = _q(rf"""(?i)(?:^|\s){name}\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""")
    return f"trim(regexp_extract(rest, {pattern}, 1), {_q(chr(34) + chr(39))})"


def _css(e: str) -> str:
    return f"CASE WHEN {e}.id <> '' THEN {e}.tag || '#' || {e}.id WHEN {e}.n_same > 1 THEN {e}.tag || ':nth-of-type(' || {e}.nth || ')' ELSE {e}.tag END"


def _step(e: str) -> str:
    return f"CASE WHEN {e}.n_same > 1 THEN {e}.tag || '[' || {e}.nth || ']' ELSE {e}.tag END"


_PLACE = """CASE WHEN p.tag IN ('nav', 'header') THEN 'navigation' WHEN p.tag = 'footer' THEN 'footer' WHEN p.tag = 'aside' THEN 'sidebar'
    WHEN p.tag IN ('article', 'main', 'section', 'div') THEN CASE WHEN regexp_matches(p.class, 'sidebar|side-bar|widget') THEN 'sidebar'
        WHEN regexp_matches(p.class, 'nav|menu|header') THEN 'navigation' WHEN regexp_matches(p.class, 'footer|bottom') THEN 'footer' END END"""

DOM_TABLES = {
    "tag_token": f"""
        SELECT ord, i, lower(names[i]) AS tag, ends[i] = '/' AS is_end, rests[i] AS rest
        FROM (SELECT *, unnest(range(1, len(names) + 1)) AS i FROM (
            SELECT ord, regexp_extract_all(h, {_TAG}, 2) AS names, regexp_extract_all(h, {_TAG}, 1) AS ends, regexp_extract_all(h, {_TAG}, 3) AS rests
            FROM (SELECT ord, {_EMPTIED} AS h FROM doc)))""",
    "tag_walk": f"""
        WITH RECURSIVE walk(ord, i, parent, places, tags) AS (
            SELECT DISTINCT ord, CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST([] AS BIGINT[]), CAST([] AS VARCHAR[]) FROM tag_token
            UNION ALL
            SELECT ord, i, CASE WHEN is_end THEN -1 WHEN keep = 0 THEN 0 ELSE places[keep] END,
                CASE WHEN is_end OR leaf THEN places[1:keep] ELSE list_append(places[1:keep], i) END,
                CASE WHEN is_end OR leaf THEN tags[1:keep] ELSE list_append(tags[1:keep], tag) END
            FROM (SELECT t.ord, t.i, t.tag, t.is_end, w.places, w.tags, t.tag IN ({_list(VOID_TAGS)}) OR ends_with(t.rest, '/') AS leaf,
                    CASE WHEN NOT t.is_end THEN len(w.tags) - coalesce(list_position(list_transform(list_reverse(w.tags), lambda o: {_CLOSES}), false) - 1, len(w.tags))
                        WHEN list_contains(w.tags, t.tag) THEN len(w.tags) - list_position(list_reverse(w.tags), t.tag) ELSE len(w.tags) END AS keep
                FROM walk w JOIN tag_token t ON t.ord = w.ord AND t.i = w.i + 1))
        SELECT ord, i, parent FROM walk WHERE i > 0 AND parent >= 0""",
    "element": f"""
        SELECT ord, i, parent, tag, row_number() OVER (PARTITION BY ord, tag ORDER BY i) AS n, row_number() OVER (PARTITION BY ord, parent, tag ORDER BY i) AS nth,
            count(*) OVER (PARTITION BY ord, parent, tag) AS n_same, {_attribute('id')} AS id, lower({_attribute('class')}) AS class
        FROM tag_walk JOIN tag_token USING (ord, i)""",
    "dom_node": f"""
        WITH RECURSIVE up(ord, i, tag, n, above, css, rooted, xpath, depth, place) AS (
            SELECT ord, i, tag, n, parent, {_css('e')}, e.id <> '', '/' || {_step('e')}, 1, CAST(NULL AS VARCHAR) FROM element e WHERE tag IN ({_list(NODE_TAGS)})
            UNION ALL
            SELECT u.ord, u.i, u.tag, u.n, p.parent, CASE WHEN rooted THEN css ELSE {_css('p')} || ' > ' || css END, rooted OR p.id <> '', '/' || {_step('p')} || xpath, depth + 1,
                coalesce(place, {_PLACE})
            FROM up u JOIN element p ON p.ord = u.ord AND p.i = u.above)
        SELECT ord, url, tag, CAST(n AS INTEGER) AS n, CAST(depth AS INTEGER) AS depth, css AS css_selector, xpath, coalesce(place, 'content') AS link_position
        FROM up JOIN crawl USING (ord) WHERE above = 0""",
}
DOM_ORACLES = {
    "dom_nodes": "SELECT ord, url, tag, n, depth, css_selector, xpath, link_position FROM dom_node",
    "css_selector": "SELECT ord, url, tag, n, css_selector FROM dom_node",
    "xpath": "SELECT ord, url, tag, n, xpath FROM dom_node",
    "link_position": "SELECT l.ord, l.n, link_url, d.link_position FROM link l LEFT JOIN dom_node d ON d.ord = l.ord AND d.n = l.n AND d.tag = 'a'",
}
