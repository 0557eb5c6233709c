"""URL functions, all on the RFC 3986 appendix B split."""

from __future__ import annotations

from pagelens.functions.arrays import any_word, lit, present

SPLIT = r"^(([A-Za-z][A-Za-z0-9+.\-]*):)?(//([^/?#]*))?([^?#]*)(\?([^#]*))?(#([\s\S]*))?"

# Fixed values.
INDEX_FILES = ["index.html", "index.htm", "index.php", "default.html"]
DYNAMIC_EXTENSIONS = [".html", ".php", ".asp", ".jsp"]
HIERARCHICAL_SCHEMES = ["", "http", "https", "ftp", "file"]


def _group(url: str, n: int) -> str:
    return f"regexp_extract({url}, {lit(SPLIT)}, {n})"


def scheme(url: str) -> str:
    return f"lower({_group(url, 2)})"


def netloc(url: str) -> str:
    return _group(url, 4)


def path(url: str) -> str:
    """Path without a trailing `;params`."""
    return f"regexp_replace({_group(url, 5)}, ';[^/]*$', '')"


def query(url: str) -> str:
    return _group(url, 7)


def is_valid_url(url: str) -> str:
    return f"coalesce({scheme(url)} in ('http', 'https') and {netloc(url)} <> '', false)"


def get_domain(url: str) -> str:
    return f"coalesce({netloc(url)}, '')"


def same_site(target_netloc: str, base_netloc: str) -> str:
    return f"({target_netloc} = {base_netloc} or endswith({target_netloc}, concat('.', {base_netloc})))"


def is_internal_url(url: str, base: str) -> str:
    relative = f"({url} rlike {lit(r'^(/|[.]/|[.][.]/)')} or {scheme(url)} = '')"
    return f"case when not {present(url)} then false when {relative} then true else {same_site(netloc(url), netloc(base))} end"


def strip_slashes(url: str) -> str:
    """Drop trailing `/` characters."""
    return f"rtrim('/', {url})"


def remove_dots(p: str, merged: str) -> str:
    """Resolve `.` and `..` segments; empty middle segments go only where `merged` holds."""
    kept = f"if({merged}, filter(sg, (s, i) -> i = 0 or i = size(sg) - 1 or s <> ''), sg)"
    walked = (
        f"aggregate({kept}, cast(array() as array<string>), (acc, s) -> case "
        "when s = '..' then slice(acc, 1, greatest(size(acc) - 1, 0)) when s = '.' then acc else concat(acc, array(s)) end)"
    )
    joined = f"array_join(if(element_at(sg, -1) in ('.', '..'), concat({walked}, array('')), {walked}), '/')"
    return f"get(transform(array(split({p}, '/', -1)), sg -> get(transform(array({joined}), o -> if(startswith(o, '/'), o, concat('/', o))), 0)), 0)"


def split_url(url: str) -> str:
    """The URL and its parts as one struct, so that a reference is split once."""
    return (
        f"named_struct('url', {url}, 'scheme', {scheme(url)}, 'netloc', {netloc(url)}, 'path', {_group(url, 5)}, "
        f"'query', {query(url)}, 'fragment', {_group(url, 9)})"
    )


def resolve(base: str, r: str) -> str:
    """Resolve a split reference against a split absolute base."""

    def prefixed(mark: str, part: str) -> str:
        return f"if({part} <> '', concat('{mark}', {part}), '')"

    suffix = f"{prefixed('?', f'{r}.query')}, {prefixed('#', f'{r}.fragment')}"
    root = f"{base}.scheme, '://', {base}.netloc"
    merged = f"concat(regexp_replace({base}.path, '[^/]*$', ''), {r}.path)"
    rooted = f"if(startswith({r}.path, '/'), {r}.path, if(startswith({merged}, '/'), {merged}, concat('/', {merged})))"
    absent = f"not startswith({r}.path, '/')"
    dotted = lit(r"(^|/)[.]{1,2}(/|$)")
    resolved = f"if(startswith({r}.path, '/') and not {r}.path rlike {dotted}, {r}.path, {remove_dots(rooted, absent)})"
    foreign = (
        f"(({r}.scheme <> '' and {r}.scheme <> {base}.scheme) or not {r}.scheme in "
        f"({', '.join(lit(s) for s in HIERARCHICAL_SCHEMES)}))"
    )
    return (
        f"case when {r}.url is null then null when {r}.url = '' then {base}.url "
        f"when {r}.netloc = '' and {foreign} then {r}.url "
        f"when {r}.netloc <> '' then concat(if({r}.scheme <> '', {r}.scheme, {base}.scheme), '://', {r}.netloc, {r}.path, {suffix}) "
        f"when {r}.path = '' then concat({root}, {base}.path, if({r}.query <> '', concat('?', {r}.query), "
        f"{prefixed('?', f'{base}.query')}), {prefixed('#', f'{r}.fragment')}) "
        f"else concat({root}, {resolved}, {suffix}) end"
    )


def url_join(base: str, ref: str) -> str:
    return (
        f"get(transform(array(named_struct('b', {split_url(base)}, 'r', {split_url(ref)})), "
        f"j -> {resolve('j.b', 'j.r')}), 0)"
    )


def url_join_all(split_base: str, refs: str) -> str:
    """Resolve an array of references against one split base."""
    return f"transform(transform({refs}, u -> {split_url('u')}), r -> {resolve(split_base, 'r')})"


def frontier_key(url: str) -> str:
    """scheme://host/path without query, fragment and trailing slash."""
    return f"concat({scheme(url)}, '://', {netloc(url)}, coalesce(nullif({strip_slashes(path(url))}, ''), '/'))"


def normalize_url(url: str) -> str:
    """frontier_key with one trailing index file name removed."""
    return f"regexp_replace({frontier_key(url)}, {lit('(?i)(?:' + any_word(INDEX_FILES) + ')$')}, '')"


def url_structure_score(url: str) -> str:
    p = path(url)
    depth = f"size(filter(split({p}, '/'), s -> s <> ''))"
    return (
        "greatest(0, 100"
        f" - case when length({url}) > 100 then 10 when length({url}) > 75 then 5 else 0 end"
        f" - case when {depth} > 4 then 15 when {depth} > 3 then 5 else 0 end"
        f" - if({query(url)} <> '', 10, 0) - if(contains({p}, '_'), 5, 0)"
        f" - if({p} rlike {lit(r'[\p{Lu}]')}, 5, 0) - if({p} rlike {lit(any_word(DYNAMIC_EXTENSIONS))}, 10, 0))"
    )
