"""HTML as SQL expressions: tags, attributes, entity decoding, text.

Semantics are defined on the tags as written. Quoted attribute values may hold `>`; the
quantifier around them is possessive, so a broken quote neither backtracks nor overflows the
stack on a multi-megabyte page.
"""

from __future__ import annotations

from html.entities import html5

from pagelens.functions.arrays import lit, strip

TAG_REST = r"""[^>"']*(?:(?:"[^"]*"|'[^']*')[^>"']*)*+"""
ATTRIBUTE = r"""([^\s"'<>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?"""
COMMENT = r"(?s)<!--.*?-->"
# The leading `<` is factored out: the search then skips to it instead of trying every branch.
OPAQUE = r"(?is)<(?:!--.*?-->|script\b[^>]*>.*?</script\s*>|style\b[^>]*>.*?</style\s*>)"

# The standard table of named character references, with and without the closing semicolon.
NAMED = {f"&{name}": char for name, char in html5.items()}
# Numeric references to C1 controls mean the Windows-1252 character of that byte, if there is one.
_WINDOWS = {c: bytes([c]).decode("cp1252", "ignore") for c in range(0x80, 0xA0)}
# The five characters that matter to markup keep one written form until a value is read.
MARKUP = {"<": "&lt;", ">": "&gt;", '"': "&quot;", "'": "&#39;", "&": "&amp;"}

_REFERENCE = r"(?s)[^&]+|&(?:#[0-9]++;?|#[xX][0-9a-fA-F]++;?|[A-Za-z][A-Za-z0-9]*+(?:;|(?!=)))|&"


def _map(entries: dict) -> str:
    return "map(" + ", ".join(f"{lit(k) if isinstance(k, str) else k}, {lit(v)}" for k, v in entries.items()) + ")"


def canonical_references(html: str) -> str:
    """`html` with every character reference read once, from left to right.

    Text characters are put in directly; markup characters become one of the forms in MARKUP, so that a
    tag scan still sees text as text. A reference without its semicolon counts only if it is a whole
    name of the standard table and no `=` follows. The table stands in the plan once for each call.
    """
    digits = "regexp_extract(p, '^&#[xX]?([0-9a-fA-F]+)', 1)"
    number = f"try_cast(conv(right({digits}, 12), if(lower(substring(p, 3, 1)) = 'x', 16, 10), 10) as bigint)"
    known = f"element_at({_map(_WINDOWS)}, cast({number} as int))"
    numeric = (
        f"case when {number} is null or length(ltrim('0', {digits})) > 8 or {number} = 0 or {number} > 1114111 or {number} between 55296 and 57343 then '\ufffd' "
        f"when {number} between 128 and 159 then {known} "
        f"else decode(unhex(lpad(hex({number}), 8, '0')), 'UTF-32') end"
    )
    # A map is searched entry by entry, so each first letter has its own.
    by_letter = {c: {k: v for k, v in NAMED.items() if k[1] == c} for c in sorted({k[1] for k in NAMED})}
    maps = " ".join(f"when {lit(c)} then try_element_at({_map(found)}, p)" for c, found in by_letter.items())
    named = f"coalesce(case substring(p, 2, 1) {maps} end, p)"
    common = "case p when '&amp;' then '&' when '&lt;' then '<' when '&gt;' then '>' when '&quot;' then '\"' when '&nbsp;' then '\u00a0' else null end"
    char = f"if(left(p, 2) = '&#', {numeric}, coalesce({common}, {named}))"
    kept = " ".join(f"when {lit(c)} then {lit(ref)}" for c, ref in MARKUP.items())
    read = f"if(left(p, 1) <> '&', p, get(transform(array({char}), c -> if(c = p, p, case c {kept} else c end)), 0))"
    return f"if(contains({html}, '&'), array_join(transform(regexp_extract_all({html}, {lit(_REFERENCE)}, 0), p -> {read}), ''), {html})"


def unescape(e: str) -> str:
    """The value of text or an attribute whose references are canonical; `&amp;` comes last, so nothing is read twice."""
    out = e
    for char, ref in MARKUP.items():
        out = f"replace({out}, {lit(ref)}, {lit(char)})"
    return f"if(contains({e}, '&'), {out}, {e})"


def parse_attributes(body: str) -> str:
    """struct<names,vals> of the text between a tag's name and its `>`."""
    pattern = lit(ATTRIBUTE)
    bare = "if(left(v, 1) in ('\"', '\\''), substring(v, 2, length(v) - 2), v)"
    return (
        f"named_struct('names', transform(regexp_extract_all({body}, {pattern}, 1), v -> lower(v)), "
        f"'vals', transform(transform(regexp_extract_all({body}, {pattern}, 2), v -> {bare}), u -> {unescape('u')}))"
    )


def attribute(tag: str, name: str) -> str:
    """Value of an attribute of a parsed tag; the first wins when repeated, null when absent."""
    return f"get({tag}.at.vals, cast(array_position({tag}.at.names, {lit(name)}) - 1 as int))"


def tags(html: str, name: str) -> str:
    """array<struct<n,raw,at>>: every start tag of a kind, numbered from 1 in document order."""
    pattern = lit(rf"(?is)<{name}(?=[\s/>])({TAG_REST})>")
    return (
        f"transform(regexp_extract_all({html}, {pattern}, 1), (b, i) -> "
        f"named_struct('n', i + 1, 'raw', concat('<{name}', b, '>'), 'at', {parse_attributes('b')}))"
    )


def inner_text(fragment: str) -> str:
    bare = f"regexp_replace({fragment}, '<[^>]*>', '')"
    return f"get(transform(array({bare}), w -> {strip(unescape('w'))}), 0)"
