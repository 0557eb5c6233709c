"""Title and description kept only in page-state JSON of script-rendered pages."""

from __future__ import annotations

from pagelens.functions.arrays import STRINGS, contains_any, lit

# Where page state is found, in the order it is looked up.
STATE_MARKERS = ["__NEXT_DATA__", "__NUXT__", r"window\.__INITIAL_STATE__", r"window\.__APP_DATA__"]
DESCRIPTION_KEYS = ["description", "metaDescription", "meta_description", "desc"]
MIN_TITLE = 4
MIN_DESCRIPTION = 21

_STRING = r'"(?:[^"\\]|\\.)*+"'
_BRACKET = r'[{}\[\]]'
_NODES = "array<struct<at:string,text:string>>"
_NO_NODES = f"cast(array() as {_NODES})"


def states(html: str) -> str:
    """array<string>: the state JSON under each marker, null where there is none or it is broken."""
    def of(marker: str) -> str:
        pattern = lit(rf"(?s){marker}\s*=\s*(\{{.*?\}})\s*(?:;|</script>)")
        return f"nullif(regexp_extract({html}, {pattern}, 1), '')"

    found = ", ".join(of(m) for m in STATE_MARKERS)
    valid = f"transform(array({found}), j -> if(try_parse_json(j) is not null, j, null))"
    none = ", ".join(["cast(null as string)"] * len(STATE_MARKERS))
    marked = contains_any(html, [m.replace("\\", "") for m in STATE_MARKERS])
    return f"if({marked}, {valid}, array({none}))"


def nesting(text: str) -> str:
    """How deep objects and lists lie in a JSON text: brackets are counted after strings are cut."""
    brackets = f"regexp_extract_all(regexp_replace({text}, {lit(_STRING)}, ''), {lit(_BRACKET)}, 0)"
    step = "if(c in ('{', '['), named_struct('d', a.d + 1, 'm', greatest(a.m, a.d + 1)), named_struct('d', a.d - 1, 'm', a.m))"
    return f"aggregate({brackets}, named_struct('d', 0, 'm', 0), (a, c) -> {step}).m"


def find_first(text: str, keys: list[str], min_length: int, depth: int | None = None, items: int | None = None) -> str:
    """First string under one of the keys in depth-first order, at any depth and place.

    `depth` limits the levels below the top and `items` the entries of each list (5 and 10 are usual for live pages). Nodes carry their position path; among the hits of all levels the smallest path is the one a
    depth-first walk meets first, because a parent's path is a prefix of its children's.
    """
    def string_at(key: str) -> str:
        kind = f"schema_of_variant(try_variant_get(try_parse_json(n.text), '$.{key}', 'variant'))"
        value = f"get_json_object(n.text, '$.{key}')"
        return f"if(length({value}) >= {min_length} and {kind} = 'STRING', {value}, null)"

    def hits(nodes: str) -> str:
        found = f"coalesce({', '.join(string_at(k) for k in keys)}, cast(null as string))"
        objects = f"filter({nodes}, n -> startswith(n.text, '{{'))"
        return f"filter(transform({objects}, n -> named_struct('at', n.at, 'text', {found})), h -> h.text is not null)"

    listed = "from_json(n.text, 'array<string>')" if items is None else f"slice(from_json(n.text, 'array<string>'), 1, {int(items)})"
    inner = (
        "coalesce(if(startswith(n.text, '{'), map_values(from_json(n.text, 'map<string,string>')), null), "
        f"if(startswith(n.text, '['), {listed}, null), {STRINGS})"
    )
    children = (
        f"filter(transform({inner}, (v, i) -> named_struct('at', concat(n.at, lpad(cast(i as string), 9, '0')), 'text', v)), "
        "m -> left(m.text, 1) in ('{', '['))"
    )
    level = f"cast(flatten(transform(acc.level, n -> {children})) as {_NODES})"
    descend = (
        f"get(transform(array({level}), lv -> named_struct('level', lv, "
        f"'found', cast(concat(acc.found, {hits('lv')}) as {_NODES}))), 0)"
    )
    root = f"cast(array(named_struct('at', '', 'text', {text})) as {_NODES})"
    start = f"named_struct('level', {root}, 'found', cast({hits(root)} as {_NODES}))"
    levels = f"greatest(1, {nesting(text)} - 1)" if depth is None else str(int(depth))
    return f"get(sort_array(aggregate(sequence(1, {levels}), {start}, (acc, d) -> {descend}).found), 0).text"


def js_title(found: str, depth: int | None = None, items: int | None = None) -> str:
    """Title from array<string> of states: the fixed places of the first two, then wherever a title stands."""
    fixed = (
        "coalesce(if(i = 0, coalesce(get_json_object(j, '$.props.pageProps.title'), get_json_object(j, '$.props.pageProps.meta.title')), null), "
        "if(i = 1, get_json_object(j, '$.head.title'), null), "
    )
    return f"get(filter(transform({found}, (j, i) -> if(j is null, null, {fixed}{find_first('j', ['title'], MIN_TITLE, depth, items)}))), v -> v <> ''), 0)"


def js_description(found: str, depth: int | None = None, items: int | None = None) -> str:
    return f"get(filter(transform({found}, j -> if(j is null, null, {find_first('j', DESCRIPTION_KEYS, MIN_DESCRIPTION, depth, items)})), v -> v <> ''), 0)"
