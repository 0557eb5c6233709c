"""JSON-LD blocks as structs: validity, types, and property requirements."""

from __future__ import annotations

from pagelens.functions.arrays import STRINGS, lit, present, strings

# Fixed values: (type fragment, required, recommended), matched in this order.
REQUIREMENTS = [
    ("article", ["headline", "image"], ["author", "datePublished", "description"]),
    ("newsarticle", ["headline", "image"], ["author", "datePublished", "dateModified"]),
    ("blogposting", ["headline", "image"], ["author", "datePublished", "dateModified"]),
    ("product", ["name", "image"], ["description", "offers", "brand"]),
    ("organization", ["name"], ["url", "logo", "contactPoint"]),
    ("localbusiness", ["name", "address"], ["telephone", "url", "openingHours"]),
    ("breadcrumblist", ["itemListElement"], []),
    ("faqpage", ["mainEntity"], []),
    ("howto", ["name", "step"], ["image", "totalTime"]),
    ("event", ["name", "startDate", "location"], ["endDate", "description", "image"]),
    ("recipe", ["name", "image"], ["author", "cookTime", "nutrition"]),
    ("videoobject", ["name", "description", "thumbnailUrl"], ["uploadDate", "duration", "contentUrl"]),
    ("webpage", ["name"], ["description", "datePublished"]),
    ("softwareapplication", ["name", "operatingSystem"], ["applicationCategory", "offers"]),
    ("book", ["name"], ["author", "isbn", "bookFormat"]),
    ("jobposting", ["title", "description", "datePosted", "hiringOrganization"], ["validThrough", "employmentType"]),
]
JSON_ERROR = "JSON parsing error"

def requirement_table() -> str:
    rows = [
        f"named_struct('key', {lit(k)}, 'required', {strings(req)}, 'recommended', {strings(rec)})"
        for k, req, rec in REQUIREMENTS
    ]
    return f"array({', '.join(rows)})"


def is_valid_json(text: str) -> str:
    return f"(try_parse_json({text}) is not null)"


def json_text(obj: str, key: str) -> str:
    """A property of a JSON object as text: strings bare, objects and lists as JSON."""
    return f"get_json_object({obj}, '$[\\'{key}\\']')"


def types_of(obj: str) -> str:
    """All types named by one JSON object, whether a string or a list."""
    return (
        f"get(transform(array({json_text(obj, '@type')}), ty -> case when ty is null then {STRINGS} "
        f"when startswith(ty, '[') then from_json(ty, 'array<string>') else array(ty) end), 0)"
    )


def blocks(scripts: str) -> str:
    """array of JSON-LD structs from array<struct<n,body,raw>> of script bodies."""
    parsed = (
        f"transform({scripts}, s -> named_struct('n', s.n, 'snippet', s.raw, 'data', s.body, "
        f"'valid', {is_valid_json('s.body')}, "
        f"'obj', if(startswith(s.body, '{{') and {is_valid_json('s.body')}, s.body, null), "
        f"'list', if(startswith(s.body, '[') and {is_valid_json('s.body')}, from_json(s.body, 'array<string>'), null)))"
    )
    typed = (
        f"transform({parsed}, p -> named_struct('p', p, 'ty', nullif({json_text('p.obj', '@type')}, ''), "
        f"'keys', json_object_keys(p.obj), 'context', {json_text('p.obj', '@context')}))"
    )
    ruled = (
        f"transform({typed}, t -> named_struct('t', t, 'rule', "
        f"get(filter({requirement_table()}, r -> not startswith(t.ty, '[') and contains(lower(t.ty), r.key)), 0)))"
    )
    checked = (
        f"transform({ruled}, c -> named_struct('c', c, "
        f"'missing', coalesce(array_except(c.rule.required, c.t.keys), {STRINGS}), "
        f"'recommended', coalesce(array_except(c.rule.recommended, c.t.keys), {STRINGS})))"
    )
    context_error = lit("@context should be 'https://schema.org', found: ")
    no_rule = lit("No Google Rich Results requirements defined for schema type: ")
    return (
        f"transform({checked}, k -> named_struct("
        "'n', k.c.t.p.n, 'valid', k.c.t.p.valid, 'data', k.c.t.p.data, "
        f"'error', if(k.c.t.p.valid, null, {lit(JSON_ERROR)}), "
        "'schema_type', if(startswith(k.c.t.ty, '['), get(from_json(k.c.t.ty, 'array<string>'), 0), k.c.t.ty), "
        f"'schema_types', case when k.c.t.p.obj is not null then {types_of('k.c.t.p.obj')} "
        f"when k.c.t.p.list is not null then flatten(transform(k.c.t.p.list, o -> {types_of('o')})) else {STRINGS} end, "
        "'required_missing', k.missing, 'recommended_missing', k.recommended, "
        "'rich_result_compatible', k.c.rule is not null and size(k.missing) = 0, "
        "'validation_errors', concat(transform(k.missing, m -> concat('Missing required property: ', m)), "
        f"if(k.c.rule is not null and {present('k.c.t.context')} and not contains(lower(k.c.t.context), 'schema.org'), "
        f"array(concat({context_error}, k.c.t.context)), {STRINGS})), "
        "'warnings', case when k.c.t.p.obj is null then cast(array() as array<string>) "
        "when k.c.t.ty is null then array('No @type property found') "
        f"when k.c.rule is null then array(concat({no_rule}, k.c.t.ty)) "
        "else transform(k.recommended, m -> concat('Missing recommended property: ', m)) end, "
        f"'schema_id', {json_text('k.c.t.p.obj', '@id')}, 'html_snippet', k.c.t.p.snippet))"
    )
