"""Word, sentence and readability measures, and the keyword tokenizer."""

from __future__ import annotations

from pagelens.functions.arrays import STRINGS, let, lit, strip

# Fixed values.
READABILITY_BANDS = [
    (90, "Very Easy (5th grade)"), (80, "Easy (6th grade)"), (70, "Fairly Easy (7th grade)"),
    (60, "Standard (8th-9th grade)"), (50, "Fairly Difficult (10th-12th grade)"),
    (30, "Difficult (College level)"),
]
HARDEST_BAND = "Very Difficult (Graduate level)"
THIN_WORDS = 300
MIN_TOKEN_LENGTH = 3


def visible_text(html: str) -> str:
    """Tags replaced by blanks and runs of whitespace collapsed; script text stays."""
    return strip(f"regexp_replace(regexp_replace({html}, '<[^>]+>', ' '), {lit(chr(92) + 's+')}, ' ')")


def content_metrics(text: str) -> str:
    """Counts over a visible text: words, characters, sentences, syllables."""
    words = f"regexp_count(tx, {lit(chr(92) + 'S+')})"
    sentences = f"size(filter(split(tx, '[.!?]+'), s -> {strip('s')} <> ''))"
    # Vowel runs never cross a blank, so the sum over words of max(1, runs) is all runs of the text
    # plus the words without one; a word with a vowel is one match from its first vowel on.
    with_vowel = f"regexp_count(low, {lit('[aeiouy]' + chr(92) + 'S*')})"
    syllables = f"cast(regexp_count(low, '[aeiouy]+') + n - {with_vowel} as bigint)"
    counts = (
        f"named_struct('word_count', n, 'character_count', length(tx), 'sentence_count', greatest(1, {sentences}), "
        f"'syllable_count', {let('low', 'lower(tx)', syllables)})"
    )
    return let("tx", text, let("n", words, counts))


def reading_ease(words: str, sentences: str, syllables: str) -> str:
    return f"if({words} > 0, 206.835D - 1.015D * ({words} / {sentences}) - 84.6D * ({syllables} / {words}), null)"


def readability_band(ease: str) -> str:
    bands = " ".join(f"when {ease} >= {floor} then {lit(label)}" for floor, label in READABILITY_BANDS)
    return f"case when {ease} is null then 'N/A' {bands} else {lit(HARDEST_BAND)} end"


def tokenize(text: str) -> str:
    """Lower-case ASCII words of three or more characters, hyphens kept inside."""
    letters = f"regexp_replace(lower({text}), {lit(r'[^a-z\s\-]')}, ' ')"
    return (
        f"filter(transform(split({letters}, {lit(chr(92) + 's+')}), w -> btrim(w, '-')), "
        f"w -> length(w) >= {MIN_TOKEN_LENGTH})"
    )


def ngrams(tokens: str, n: int) -> str:
    """Contiguous n-token phrases in order; empty when there are fewer than n tokens."""
    return (
        f"if(size({tokens}) >= {n}, transform(sequence(1, size({tokens}) - {n - 1}), "
        f"i -> array_join(slice({tokens}, i, {n}), ' ')), {STRINGS})"
    )
