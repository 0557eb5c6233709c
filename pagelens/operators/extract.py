"""The extraction job: one narrow `page` row per crawled page, with no shuffle.

Stages are separate projections so that each page body is scanned once per tag kind; the body
itself is dropped here and never carried into a join or an aggregate.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from pagelens.functions import urls as U
from pagelens.functions.arrays import (
    STRINGS, contains_any, count_where, first_where, let, lit, lits, map_last_wins, nonempty, present, strip,
)
from pagelens.functions.html import (
    COMMENT, OPAQUE, TAG_REST, attribute, canonical_references, inner_text, parse_attributes, tags, unescape,
)
from pagelens.functions.jsonld import blocks
from pagelens.functions.jsstate import js_description, js_title, states
from pagelens.functions.text import content_metrics, visible_text

# Fixed values.
JS_INDICATORS = [
    "react", "vue", "angular", "next", "nuxt", "gatsby", "remix",
    "__next_data__", "__nuxt__", "__app_data__", "__initial_state__",
    'id="__next"', 'id="__nuxt"', 'id="root"', 'id="app"',
    "data-reactroot", "data-v-", "ng-app", "ng-controller",
]
SPA_MARKERS = ['<div id="root">', '<div id="app">', '<div id="__next">', "__NEXT_DATA__", "__NUXT__"]
SOFT_404_PATTERNS = [
    r"page\s+not\s+found", r"404\s+error", r"does\s+not\s+exist", r"doesn.t\s+exist",
    r"cannot\s+be\s+found", r"no\s+longer\s+available", r"this\s+page\s+has\s+been\s+moved",
    r"the\s+page\s+you\s+were\s+looking\s+for", r"oops.*page\s+not\s+found", r"error\s+404",
    r"not\s+found", r"we\s+couldn.t\s+find", r"something\s+went\s+wrong",
    r"this\s+url\s+does\s+not\s+exist",
]
SOFT_404_HINTS = ["found", "404", "exist", "available", "moved", "looking", "find", "wrong"]
IMAGE_FORMATS = [
    (".webp", "webp"), (".avif", "avif"), (".png", "png"), (".jpg", "jpeg"), (".jpeg", "jpeg"),
    (".gif", "gif"), (".svg", "svg"), (".bmp", "bmp"), (".tiff", "tiff"), (".tif", "tiff"),
]
NEXT_GEN_FORMATS = ["webp", "avif"]
GENERIC_ANCHORS = [
    "click here", "here", "read more", "more", "learn more", "this link", "link", "go", "continue",
    "see more", "click here to", "find out more", "discover more",
]
SKIPPED_HREF = r"(?i)^(javascript:|mailto:|tel:|sms:|data:)"
EMPTY_ANCHOR = "[Empty Anchor Text]"
MIXED_PATTERNS = [
    (r"""src=["']http://([^"']+)["']""", "script/img"),
    (r"""href=["']http://([^"']+)["']""", "link"),
    (r"""action=["']http://([^"']+)["']""", "form"),
    (r"""url\(["']?http://([^"')]+)["']?""", "css"),
]
SPA_MIN_LENGTH = 2000

_ANCHOR = rf"(?is)^({TAG_REST})>(.*?)(?:</a\s*>|\z)"
_HEADING = rf"(?is)<h([1-6])(?=[\s>]){TAG_REST}>(.*?)</h[1-6]\s*>"
_TITLE = r"(?is)<title(?=[\s>])[^>]*>(.*?)</title\s*>"
_SCRIPT = rf"(?is)<script(?=[\s>])({TAG_REST})>(.*?)</script\s*>"


def is_js_rendered(html: str, window: int | None = None) -> str:
    """Whether the page names a script framework, anywhere or in its first `window` characters (50,000 is usual for live pages)."""
    sample = html if window is None else f"left({html}, {int(window)})"
    return let("sample", f"lower({sample})", contains_any("sample", JS_INDICATORS))


def is_spa_shell(html: str) -> str:
    return f"(not {present(html)} or length({html}) < {SPA_MIN_LENGTH} or {contains_any(html, SPA_MARKERS)})"


def is_soft_404(status: str, html: str, window: int | None = None) -> str:
    """Whether a page with status 200 says that it does not exist, anywhere or in its first `window` characters (5,000 is usual)."""
    pattern = lit("(?i)" + "|".join(SOFT_404_PATTERNS))
    sample = html if window is None else f"left({html}, {int(window)})"
    # Every pattern holds one of these words, so most pages never reach the expression.
    hinted = let("sample", f"lower({sample})", contains_any("sample", SOFT_404_HINTS))
    return f"coalesce({status} = 200 and {hinted} and {sample} rlike {pattern}, false)"


def image_format(url: str) -> str:
    stem = f"lower(substring_index(substring_index({url}, '?', 1), '#', 1))"
    cases = " ".join(f"when endswith({stem}, {lit(ext)}) then {lit(fmt)}" for ext, fmt in IMAGE_FORMATS)
    return f"case {cases} end"


def anchor_text_type(text: str) -> str:
    """A one-word text is a brand only when it holds no cased letter."""
    low = strip(f"lower({text})")
    return (
        f"case when not {present(text)} or {low} in ({lit(EMPTY_ANCHOR.lower())}, '') then 'empty' "
        f"when {low} in ({lits(GENERIC_ANCHORS)}) then 'generic' "
        f"when {low} rlike {lit(r'^(http://|https://|www[.])')} then 'naked-url' "
        f"when not {text} rlike {lit(chr(92) + 's')} and {low} = upper({low}) then 'brand' else 'partial-match' end"
    )


def robots_directives(content: str, source: str) -> str:
    parts = f"filter(transform(split({content}, ','), d -> {strip('d')}), d -> d <> '')"
    value = strip("regexp_replace(d, '(?s)^[^:]*:', '')")
    name = "lower(" + strip("substring_index(d, ':', 1)") + ")"
    return (
        f"coalesce(transform({parts}, d -> named_struct('directive', {name}, "
        f"'value', if(contains(d, ':'), {value}, null), 'source', {lit(source)})), "
        "cast(array() as array<struct<directive:string,value:string,source:string>>))"
    )


def header(headers: str, name: str) -> str:
    """Case-insensitive header lookup; the first entry of that name wins."""
    return first_where(f"map_entries({headers})", f"lower(x.key) = {lit(name.lower())}") + ".value"


def social_map(metas: str, prefix: str, first: str, second: str) -> str:
    entries = (
        f"transform({metas}, m -> named_struct('key', lower(coalesce({nonempty(attribute('m', first))}, "
        f"{attribute('m', second)})), 'value', {attribute('m', 'content')}))"
    )
    kept = f"filter({entries}, e -> startswith(e.key, {lit(prefix)}) and {present('e.value')})"
    return map_last_wins(f"transform({kept}, e -> named_struct('key', e.key, 'value', {strip('e.value')}))")


def _named_meta(name: str) -> str:
    return first_where("metas", f"lower({attribute('x', 'name')}) = {lit(name)}")


def _content(meta: str) -> str:
    return nonempty(strip(attribute(meta, "content")))


def _rel_href(word: str) -> str:
    tag = first_where("link_tags", f"contains(lower({attribute('x', 'rel')}), {lit(word)})")
    return let("t", tag, strip(nonempty(attribute("t", "href"))))


PASSED = [
    "site", "ord", "status_code", "crawl_depth", "ttfb_ms", "total_ms", "html_size_bytes", "compressed_size",
    "error_message", "redirect_history", "redirect_status_codes", "headers", "fetched_at",
]


def quotes_neutral(html: str) -> str:
    """`<` inside a quoted attribute value becomes `&lt;`, so that only real tags start with it.

    Only pages that have such a value are cut into tags for this; attribute decoding undoes it.
    """
    piece = rf"(?s)[^<]+|<[a-zA-Z](?:{TAG_REST})>|<"
    inner = "if(length(p) > 1 and left(p, 1) = '<', concat('<', replace(substring(p, 2), '<', '&lt;')), p)"
    found = lit(r"""(?s)<[a-zA-Z][^<>]*=\s*(?:"[^"]*<|'[^']*<)""")
    return f"if({html} rlike {found}, array_join(transform(regexp_extract_all({html}, {lit(piece)}, 0), p -> {inner}), ''), {html})"


def tag_arrays(crawl: DataFrame) -> DataFrame:
    """The page body reduced to parsed tags of the kinds used later."""
    bodies = crawl.selectExpr(
        *PASSED,
        "coalesce(nullif(final_url, ''), url) as url",
        "coalesce(html, '') as html",
        f"regexp_replace(coalesce(html, ''), {lit(COMMENT)}, '') as uncommented",
        f"regexp_replace(coalesce(html, ''), {lit(OPAQUE)}, '') as opened",
    ).selectExpr(*PASSED, "url", "html", "uncommented", f"{quotes_neutral('opened')} as neutral").selectExpr(
        *PASSED, "url", "html", "uncommented", f"{canonical_references('neutral')} as clean"
    )
    pieces = f"split(clean, {lit(r'(?i)<a(?=[\s/>])')})"
    anchors = (
        f"transform(filter({pieces}, (p, i) -> i > 0), (p, i) -> named_struct('n', i + 1, "
        f"'at', {parse_attributes(f'regexp_extract(p, {lit(_ANCHOR)}, 1)')}, 'inner', regexp_extract(p, {lit(_ANCHOR)}, 2)))"
    )
    headings = (
        f"filter(transform(regexp_extract_all(clean, {lit(_HEADING)}, 0), m -> named_struct('level', cast(substring(m, 3, 1) as int), "
        f"'text', {inner_text(f'regexp_extract(m, {lit(_HEADING)}, 2)')})), h -> h.text <> '')"
    )
    scripts = (
        f"transform(transform(regexp_extract_all(uncommented, {lit(_SCRIPT)}, 0), m -> named_struct("
        f"'at', regexp_extract(m, {lit(_SCRIPT)}, 1), 'body', regexp_extract(m, {lit(_SCRIPT)}, 2))), "
        f"(s, i) -> named_struct('n', i + 1, 'at', {parse_attributes('s.at')}, 'body', {strip('s.body')}, "
        "'raw', concat('<script', s.at, '>', s.body, '</script>')))"
    )
    return bodies.selectExpr(
        *PASSED, "url", "html",
        f"{U.split_url('url')} as base",
        f"regexp_extract(clean, {lit(_TITLE)}, 0) as title_html",
        f"{nonempty(strip(unescape(f'regexp_extract(clean, {lit(_TITLE)}, 1)')))} as own_title",
        f"{tags('clean', 'meta')} as metas",
        f"{tags('clean', 'link')} as link_tags",
        f"{tags('clean', 'html')} as html_tags",
        f"{tags('clean', 'area')} as areas",
        f"{tags('clean', 'img')} as imgs",
        f"{headings} as headings",
        f"{anchors} as anchors",
        f"filter({scripts}, s -> {attribute('s', 'type')} = 'application/ld+json' and s.body <> '') as ld_scripts",
    )


def _images(imgs: str) -> str:
    ref = ", ".join(nonempty(attribute("t", n)) for n in ("src", "data-src", "data-lazy-src", "data-original"))
    sourced = f"filter(transform({imgs}, t -> named_struct('t', t, 'ref', coalesce({ref}))), s -> s.ref is not null)"
    split = f"transform({sourced}, s -> named_struct('t', s.t, 'r', {U.split_url(strip('s.ref'))}))"
    resolved = (
        f"transform({split}, s -> named_struct('t', s.t, 'src', {U.resolve('base', 's.r')}, "
        f"'alt', {nonempty(strip(attribute('s.t', 'alt')))}))"
    )
    named = f"transform({resolved}, s -> named_struct('t', s.t, 'src', s.src, 'alt', s.alt, 'format', {image_format('s.src')}))"
    plain = ", ".join(
        f"'{n}', {attribute('g.t', n)}" for n in ("width", "height", "loading", "decoding", "srcset", "sizes", "fetchpriority")
    )
    lazy = (
        f"coalesce({attribute('g.t', 'loading')} = 'lazy', false) or {present(attribute('g.t', 'data-src'))} "
        f"or {present(attribute('g.t', 'data-lazy-src'))}"
    )
    return (
        f"transform({named}, g -> named_struct('n', g.t.n, 'src', g.src, 'alt', g.alt, 'is_missing_alt', g.alt is null, "
        f"'alt_text_length', coalesce(length(g.alt), 0), {plain}, 'is_lazy_loaded', {lazy}, 'format', g.format, "
        f"'is_next_gen_format', coalesce(g.format in ({lits(NEXT_GEN_FORMATS)}), false), 'html_snippet', g.t.raw))"
    )


def _link_candidates(anchors: str) -> str:
    """Anchors with a usable href, resolved, each with the key used for deduplication."""
    with_href = f"transform({anchors}, a -> named_struct('a', a, 'href', {strip(attribute('a', 'href'))}))"
    usable = (
        f"filter({with_href}, h -> {present('h.href')} and not startswith(h.href, '#') "
        f"and not h.href rlike {lit(SKIPPED_HREF)})"
    )
    split = f"transform({usable}, h -> named_struct('a', h.a, 'r', {U.split_url('h.href')}))"
    resolved = f"transform({split}, h -> named_struct('a', h.a, 'url', {U.resolve('base', 'h.r')}))"
    return f"transform({resolved}, h -> named_struct('a', h.a, 'url', h.url, 'key', substring_index(h.url, '#', 1)))"


def _links() -> str:
    img_alt = let("ts", tags("c.a.inner", "img"), nonempty(strip(attribute("get(ts, 0)", "alt"))))
    texts = (
        "transform(transform(link_positions, p -> get(candidates, p)), c -> named_struct('c', c, "
        f"'text', coalesce({nonempty(inner_text('c.a.inner'))}, "
        f"if(c.a.inner rlike '(?i)<img', {img_alt}, null), {lit(EMPTY_ANCHOR)}), "
        f"'host', {U.netloc('c.url')}, 'rel', regexp_replace({strip(attribute('c.a', 'rel'))}, {lit(chr(92) + 's+')}, ' ')))"
    )
    rel = "coalesce(lower(k.rel), '')"
    return (
        f"transform({texts}, k -> named_struct('n', k.c.a.n, 'url', k.c.url, 'text', k.text, "
        f"'is_internal', {U.same_site('k.host', 'base.netloc')}, 'rel', nullif(k.rel, ''), "
        f"'is_nofollow', contains({rel}, 'nofollow'), 'is_sponsored', contains({rel}, 'sponsored'), "
        f"'is_ugc', contains({rel}, 'ugc'), 'target', {attribute('k.c.a', 'target')}, "
        f"'is_self_referencing', {U.strip_slashes('k.c.key')} = {U.strip_slashes('base.url')}, "
        f"'anchor_text_type', {anchor_text_type('k.text')}))"
    )


def _hreflang() -> str:
    kept = (
        f"filter(link_tags, t -> contains(lower({attribute('t', 'rel')}), 'alternate') "
        f"and {present(attribute('t', 'hreflang'))} and {present(attribute('t', 'href'))})"
    )
    code = strip("lower(" + attribute("t", "hreflang") + ")")
    split = (
        f"transform({kept}, t -> named_struct('code', {code}, "
        f"'r', {U.split_url(strip(attribute('t', 'href')))}))"
    )
    return (
        f"transform({split}, s -> named_struct('target_url', {U.resolve('base', 's.r')}, "
        "'language_code', split(s.code, '-')[0], 'country_code', get(split(s.code, '-'), 1), "
        "'is_x_default', s.code = 'x-default'))"
    )


def _indexability(directives: str) -> str:
    snippets = (
        "filter(transform(filter(ds, d -> d.directive = 'max-snippet'), d -> try_cast(regexp_extract(d.value, "
        f"{lit(r'^([+-]?[0-9]+)$')}, 1) as int)), v -> v is not null)"
    )
    previews = f"filter(ds, d -> d.directive = 'max-image-preview' and {present('d.value')})"
    noindex = first_where("ds", "x.directive = 'noindex'")
    return let(
        "ds", directives,
        f"named_struct('is_indexable', {noindex} is null, 'status', if({noindex} is null, 'Indexable', 'Noindex'), "
        f"'noindex_source', {noindex}.source, 'nofollow', exists(ds, d -> d.directive = 'nofollow'), "
        "'nosnippet', exists(ds, d -> d.directive = 'nosnippet'), "
        f"'max_snippet', try_element_at({snippets}, -1), 'max_image_preview', try_element_at({previews}, -1).value)",
    )


def mixed_resources(html: str) -> str:
    """All insecure resources named on a page, by kind and then by position."""
    found = ", ".join(
        f"transform(regexp_extract_all({html}, {lit(pattern)}, 1), "
        f"m -> named_struct('resource_url', concat('http://', m), 'resource_type', {lit(kind)}))"
        for pattern, kind in MIXED_PATTERNS
    )
    return f"concat({found})"


def http_equiv_map() -> str:
    entries = (
        f"transform(metas, m -> named_struct('key', lower({strip(attribute('m', 'http-equiv'))}), "
        f"'value', {strip(attribute('m', 'content'))}))"
    )
    return map_last_wins(f"filter({entries}, e -> {present('e.key')} and {present('e.value')})")


def page(crawl: DataFrame, js_window: int | None = None, soft_404_window: int | None = None) -> DataFrame:
    """The `page` table: every extracted field of every fetched page."""
    rel_tokens = f"split(lower({attribute('x', 'rel')}), {lit(chr(92) + 's+')})"
    icon_rels = ["icon", "shortcut icon", "apple-touch-icon"]
    refs = [
        strip(attribute("get(canonicals, 0)", "href")), *[_rel_href(r) for r in icon_rels],
        _rel_href("next"), _rel_href("prev"), _rel_href("amphtml"),
    ]
    staged = (
        tag_arrays(crawl)
        .selectExpr(
            *PASSED, "url", "html", "base", "title_html", "own_title", "metas", "link_tags", "html_tags", "imgs",
            "ld_scripts", "headings",
            f"{social_map('metas', 'og:', 'property', 'name')} as open_graph",
            f"{social_map('metas', 'twitter:', 'name', 'property')} as twitter_cards",
            f"{_named_meta('description')} as desc_tag",
            f"{_named_meta('robots')} as robots_tag",
            f"{_named_meta('viewport')} as viewport_tag",
            f"filter(link_tags, x -> array_contains({rel_tokens}, 'canonical')) as canonicals",
            f"{_link_candidates('anchors')} as candidates",
            f"{states('html')} as page_states",
        )
        .selectExpr(
            "*",
            f"{_content('robots_tag')} as meta_robots",
            f"{_content('viewport_tag')} as viewport",
            f"{header('headers', 'X-Robots-Tag')} as robots_header",
            "sort_array(transform(candidates, (c, i) -> named_struct('key', c.key, 'at', i))) as link_keys",
            f"transform(array({', '.join(refs)}), u -> nullif(u, '')) as refs",
        )
        .selectExpr(
            "*",
            # Array positions of the first link of each key: link_keys is sorted by (key, position).
            "sort_array(transform(filter(link_keys, (e, i) -> i = 0 or get(link_keys, i - 1).key <> e.key), e -> e.at)) "
            "as link_positions",
            f"{robots_directives('meta_robots', 'meta-robots')} as robots_directives",
            f"{robots_directives('robots_header', 'x-robots-tag')} as x_robots_directives",
            f"{U.url_join_all('base', 'refs')} as targets",
        )
    )
    width = lit("width=device-width")
    fixed_scale = lit("user-scalable=no|maximum-scale=1|maximum-scale=0")
    all_urls = "concat(redirect_history, array(url))"
    return staged.selectExpr(
        *PASSED, "url", "open_graph", "twitter_cards", "meta_robots", "viewport", "headings", "robots_directives",
        "x_robots_directives",
        "base.scheme = 'https' as is_https",
        f"coalesce(own_title, open_graph['og:title'], {js_title('page_states')}) as title",
        "nullif(title_html, '') as title_html",
        f"coalesce({_content('desc_tag')}, open_graph['og:description'], {js_description('page_states')}) as meta_description",
        "desc_tag.raw as meta_desc_html",
        "desc_tag.n as meta_desc_n",
        "size(canonicals) > 1 as multiple_canonicals",
        "targets[0] as canonical_url",
        "not refs[0] rlike '^https?://' as canonical_is_relative",
        "if(refs[0] is null, null, get(canonicals, 0).raw) as canonical_html",
        "if(refs[0] is null, null, get(canonicals, 0).n) as canonical_n",
        f"coalesce({U.strip_slashes('targets[0]')} = {U.strip_slashes('url')}, false) as canonical_is_self_ref",
        "coalesce(targets[1], targets[2], targets[3]) as favicon_url",
        "targets[4] as pagination_next",
        "targets[5] as pagination_prev",
        "targets[6] as amp_url",
        f"coalesce(contains(lower(viewport), {width}), false) as viewport_has_device_width",
        f"coalesce(not lower(viewport) rlike {fixed_scale}, true) as viewport_allows_scaling",
        f"{nonempty(strip(attribute('get(html_tags, 0)', 'lang')))} as lang",
        f"{http_equiv_map()} as http_equiv",
        f"{_hreflang()} as hreflang",
        f"{blocks('ld_scripts')} as json_ld",
        f"{_images('imgs')} as images",
        f"{_links()} as links",
        f"{_indexability('concat(robots_directives, x_robots_directives)')} as indexability",
        f"{is_js_rendered('html', js_window)} as is_js_rendered",
        f"{is_soft_404('status_code', 'html', soft_404_window)} as is_soft_404",
        f"{is_spa_shell('html')} as is_spa_shell",
        f"size(array_distinct({all_urls})) <> size({all_urls}) as has_redirect_loop",
        f"{count_where('headings', 'x.level = 1')} as h1_count",
        f"{content_metrics(visible_text('html'))} as text_metrics",
        f"if(base.scheme = 'https', {mixed_resources('html')}, "
        "cast(array() as array<struct<resource_url:string,resource_type:string>>)) as mixed_content",
    )
