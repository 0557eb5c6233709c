"""SQL expression builders shared by the extraction functions.

Every function in `pagelens.functions` takes and returns Spark SQL expression text, for use in
`selectExpr`, `F.expr` and `filter`. One text is parsed in the JVM in one call, where the same
tree built node by node from Python costs a round trip per node.
"""

from __future__ import annotations

BLANKS = r"' \t\n\r\u000b\u000c'"
STRINGS = "cast(array() as array<string>)"


def lit(text: str) -> str:
    """A string literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n") + "'"


def lits(texts: list[str]) -> str:
    return ", ".join(lit(t) for t in texts)


def strings(texts: list[str]) -> str:
    """An array<string> literal."""
    return f"array({lits(texts)})" if texts else STRINGS


def strip(e: str) -> str:
    return f"btrim({e}, {BLANKS})"


def present(e: str) -> str:
    """True for a non-empty string: null and "" count the same in every rule."""
    return f"(coalesce({e}, '') <> '')"


def nonempty(e: str) -> str:
    return f"nullif({e}, '')"


def first_where(arr: str, cond: str) -> str:
    """First element for which `cond` (over x) holds, or null."""
    return f"get(filter({arr}, x -> {cond}), 0)"


def count_where(arr: str, cond: str) -> str:
    return f"size(filter({arr}, x -> {cond}))"


def contains_any(e: str, words: list[str]) -> str:
    """Substring test against a fixed list; plain searches, far cheaper than one alternation."""
    return "(" + " or ".join(f"contains({e}, {lit(w)})" for w in words) + ")"


def any_word(words: list[str]) -> str:
    """A regular expression matching any word of a fixed list as a substring."""
    return "|".join("".join("\\" + ch if ch in r"\.^$|?*+()[]{}" else ch for ch in w) for w in words)


def let(name: str, value: str, body: str) -> str:
    """Evaluate `value` once and use it as `name` inside `body`."""
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def map_last_wins(entries: str) -> str:
    """map from array<struct<key,value>> where a repeated key keeps its last value."""
    return let(
        "es", entries,
        "map_from_arrays(array_distinct(transform(es, e -> e.key)), "
        "transform(array_distinct(transform(es, e -> e.key)), k -> element_at(filter(es, e -> e.key = k), -1).value))",
    )


def fill(template: str, *exprs: str) -> str:
    """Fill the `{}` slots of a fixed text; a null slot becomes an empty string."""
    parts = template.split("{}")
    assert len(parts) == len(exprs) + 1, template
    out = [lit(parts[0])]
    for e, tail in zip(exprs, parts[1:]):
        out += [f"coalesce(cast({e} as string), '')", lit(tail)]
    return "concat(" + ", ".join(out) + ")"
