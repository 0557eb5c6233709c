"""AI-visibility score: ten weighted factors per page, pure arithmetic over `advanced_page`."""

from __future__ import annotations

from pyspark.sql import DataFrame

from pagelens.functions.arrays import any_word, count_where, fill, lit, present

# Fixed values.
QUESTION_WORDS = ["what", "why", "how", "when", "where", "who", "which"]
ANSWER_PHRASES = ["what is", "how to", "guide", "learn", "discover"]
GRADES = [(90, "A+"), (80, "A"), (70, "B"), (60, "C"), (40, "D")]
# (id, name, weight, good from, warning from, recommendation below good)
FACTORS = [
    ("sd", "Structured Data", 0.15, 100, 60, None),
    ("md", "Meta Description", 0.12, 100, 50, None),
    ("hs", "Heading Structure", 0.10, 70, 40, "Use semantic heading hierarchy (H1 > H2 > H3) for better AI content parsing"),
    ("cd", "Content Depth", 0.15, 75, 50, "AI engines prefer comprehensive content. Aim for 800+ words with detailed coverage."),
    ("ee", "E-E-A-T Signals", 0.12, 70, 40, "Add author info, external citations, and social proof to strengthen E-E-A-T"),
    ("an", "Answer Snippet Ready", 0.10, 60, 30, "Add question-format headings (What is..., How to...) and direct answer paragraphs"),
    ("te", "Technical Health", 0.10, 70, 40, "Fix security headers, mixed content, and ensure HTTPS"),
    ("im", "Image Alt Text", 0.08, 80, 50, "Add descriptive alt text to all images - AI engines use this for image understanding"),
    ("il", "Internal Links", 0.08, 70, 40, "Add more internal links to help AI engines discover and connect content"),
    ("so", "Social Meta Tags", 0.05, 70, 35, "Add og:title, og:description, og:image for better social and AI visibility"),
]
SD_TEXTS = {
    "good": ("{} valid JSON-LD blocks found", ""),
    "warning": ("{}/{} JSON-LD blocks are valid", "Fix invalid JSON-LD blocks to improve AI structured data understanding"),
    "critical": ("No structured data (JSON-LD) found", "Add JSON-LD structured data (Article, FAQPage, Organization, etc.)"),
}
MD_TEXTS = {
    "good": ("Meta description is {} chars (optimal: 50-160)", ""),
    "warning": ("Meta description is {} chars (should be 50-160)", "Adjust meta description to 50-160 characters for better AI snippet extraction"),
    "critical": ("No meta description found", "Add a descriptive meta description (50-160 chars) - AI engines use this for summaries"),
}

SCORES = {
    "sd": "case when n_valid = n_blocks and n_blocks > 0 then 100 when n_blocks > 0 then 60 else 20 end",
    "md": "case when description_length between 50 and 160 then 100 when description_length > 0 then 50 else 0 end",
    "hs": "least(100, case when h1_count = 1 then 40 when h1_count > 1 then 20 else 0 end + if(has_h2, 30, 0) + if(has_h3, 20, 0) + if(n_headings >= 3, 10, 0))",
    "cd": "case when word_count >= 1500 then 100 when word_count >= 800 then 75 when word_count >= 300 then 50 else 20 end",
    "ee": "least(100, 50 + if(n_og > 0, 10, 0) + if(n_twitter > 0, 5, 0) + if(n_blocks > 0, 15, 0) + if(has_canonical, 10, 0) + if(external_link_count > 0, 10, 0))",
    "an": "least(100, least(40, 15 * n_questions) + if(description_answers, 30, 0) + if(word_count >= 500, 30, 0))",
    "te": "greatest(0, 100 - if(is_https, 0, 30) - if(has_viewport, 0, 20) - least(30, 5 * missing_headers) - if(mixed_count > 0, 20, 0))",
    "im": "if(image_count > 0, cast(images_with_alt / image_count * 100 as int), 100)",
    "il": "case when internal_link_count >= 10 then 100 when internal_link_count >= 5 then 70 when internal_link_count >= 2 then 40 else 15 end",
    "so": "if(og_title, 35, 0) + if(og_description, 35, 0) + if(og_image, 30, 0)",
}


def truth(e: str) -> str:
    return f"if({e}, 'True', 'False')"


DETAILS = {
    "sd": f"case when sd = 100 then {fill(SD_TEXTS['good'][0], 'n_valid')} when sd = 60 then {fill(SD_TEXTS['warning'][0], 'n_valid', 'n_blocks')} else {lit(SD_TEXTS['critical'][0])} end",
    "md": f"case when md = 100 then {fill(MD_TEXTS['good'][0], 'description_length')} when md = 50 then {fill(MD_TEXTS['warning'][0], 'description_length')} else {lit(MD_TEXTS['critical'][0])} end",
    "hs": fill("{} headings found, {} H1 tags", "n_headings", "h1_count"),
    "cd": fill("{} words on page", "format_number(word_count, 0)"),
    "ee": fill("E-E-A-T signals: OG={}, Twitter={}, Schema={}", truth("n_og > 0"), truth("n_twitter > 0"), truth("n_blocks > 0")),
    "an": fill("Answer optimization: {} question-format headings", "n_questions"),
    "te": fill("HTTPS={}, Security issues={}, Mixed content={}", truth("is_https"), "missing_headers", "mixed_count"),
    "im": fill("Alt text coverage: {}% ({}/{} images)", "im", "images_with_alt", "image_count"),
    "il": fill("{} internal links found", "internal_link_count"),
    "so": fill("OG tags: {} found", "n_og"),
}


def _three(texts: dict, col: str, good: int, warning: int, at: int) -> str:
    return f"case when {col} >= {good} then {lit(texts['good'][at])} when {col} >= {warning} then {lit(texts['warning'][at])} else {lit(texts['critical'][at])} end"


def factor_scores(advanced: DataFrame) -> DataFrame:
    """Wide row per page: the ten factor scores and everything computed from them."""
    inputs = advanced.selectExpr(
        "site", "ord", "url", "is_https", "h1_count", "word_count", "missing_headers", "mixed_count", "image_count",
        "images_with_alt", "internal_link_count", "external_link_count",
        "size(json_ld) as n_blocks",
        f"{count_where('json_ld', 'x.valid')} as n_valid",
        "coalesce(length(meta_description), 0) as description_length",
        f"coalesce(lower(meta_description) rlike {lit(any_word(ANSWER_PHRASES))}, false) as description_answers",
        "size(headings) as n_headings",
        "exists(headings, h -> h.level = 2) as has_h2",
        "exists(headings, h -> h.level = 3) as has_h3",
        count_where("headings", f"lower(x.text) rlike {lit(any_word(QUESTION_WORDS))}") + " as n_questions",
        "size(open_graph) as n_og",
        "size(twitter_cards) as n_twitter",
        "open_graph['og:title'] is not null as og_title",
        "open_graph['og:description'] is not null as og_description",
        "open_graph['og:image'] is not null as og_image",
        f"{present('canonical_url')} as has_canonical",
        f"{present('viewport')} as has_viewport",
    )
    scored = inputs.selectExpr("*", *[f"cast({e} as int) as {k}" for k, e in SCORES.items()])
    weighted = " + ".join(f"{k} * {w}D" for k, _, w, *_ in FACTORS)
    total = scored.selectExpr("*", f"greatest(0, least(100, cast({weighted} as int))) as overall_score")
    grade = " ".join(f"when overall_score >= {floor} then {lit(g)}" for floor, g in GRADES)
    return total.selectExpr(
        "*",
        f"case {grade} else 'F' end as grade",
        "cast(overall_score * 0.9D + sd * 0.1D as int) as google_score",
        "cast(overall_score * 0.85D + cd * 0.15D as int) as chatgpt_score",
        "cast(overall_score * 0.8D + an * 0.2D as int) as perplexity_score",
        "cast(cd * 0.3D + sd * 0.3D + ee * 0.2D + an * 0.2D as int) as citation_potential",
        "cast(sd * 0.25D + an * 0.25D + cd * 0.2D + ee * 0.15D + hs * 0.15D as int) as geo_readiness",
    )


def factor_table(factors: DataFrame) -> DataFrame:
    """Long form: one row per page and factor."""
    rows = []
    for i, (k, name, weight, good, warning, advice) in enumerate(FACTORS, 1):
        status = f"case when {k} >= {good} then 'good' when {k} >= {warning} then 'warning' else 'critical' end"
        if k in ("sd", "md"):
            advice_sql = _three(SD_TEXTS if k == "sd" else MD_TEXTS, k, good, warning, 1)
        else:
            advice_sql = f"if({k} >= {good}, '', {lit(advice)})"
        rows.append(
            f"named_struct('n', {i}, 'factor', {lit(name)}, 'score', {k}, 'weight_pct', {round(weight * 100)}, "
            f"'status', {status}, 'details', {DETAILS[k]}, 'recommendation', {advice_sql})"
        )
    return factors.selectExpr("site", "ord", "url", f"inline(array({', '.join(rows)}))")


def priority_improvements(table: DataFrame) -> DataFrame:
    """Critical factors of a page first, then warnings."""
    return table.where("status <> 'good'").selectExpr(
        "site", "ord", "url", "if(status = 'critical', 0, 1) as rank", "n", "factor", "score", "recommendation"
    )
