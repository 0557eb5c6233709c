"""Keyword operators: tokens, phrases, counts, density, placement, and the tables built on them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagelens.functions.arrays import STRINGS, any_word, lit, lits
from pagelens.functions.text import MIN_TOKEN_LENGTH, tokenize
from pagelens.operators.skew import sized_join
from pagelens.session import stored

# Fixed values.
STOP_WORDS = """
a an the and or but in on at to for of with by from as is was are were be been being
have has had do does did will would could should may might shall can need dare ought used
this that these those i me my myself we our ours ourselves you your yours yourself yourselves
he him his himself she her hers herself it its itself they them their theirs themselves
what which who whom when where why how all each every both few more most other some such
no nor not only own same so than too very s t just don now here there then also about up
out if into through during before after above below between under again further once because
until while although since unless however thus therefore moreover furthermore otherwise instead
never always often sometimes still already yet even much many well back over down off against
along among around behind beside beyond within without upon toward towards via per
etc eg ie cf www com org net http https
get set go make use find see look come take know think want give say tell ask try keep let
begin show put mean call run move live believe feel leave bring write provide hold turn follow
appear wait serve send expect allow add change work read learn help start open close build
create delete remove edit update save load
page site website web new one two first last next previous click home main menu
copyright reserved rights privacy policy terms
""".split()
GAP_CANDIDATES = [
    "guide", "tutorial", "best", "top", "review", "comparison", "how to", "what is", "benefits", "features", "pricing",
    "solution", "services", "professional", "expert", "trusted", "affordable", "quality", "premium", "custom", "free",
]
TRANSACTIONAL = ["buy", "price", "cost", "cheap", "deal", "discount", "order"]
COMMERCIAL = ["best", "top", "review", "comparison", "vs", "alternative"]
SERP_ACTIONS = [
    ("Featured Snippet", "if(any_in_headings, 'High', 'Low')", "Add concise answer paragraphs under H2/H3 headings"),
    ("People Also Ask", "if(n_gaps > 0, 'High', 'Medium')", "Create FAQ sections targeting question keywords"),
    ("Image Pack", "'Medium'", "Add descriptive alt text to images with target keywords"),
    ("Video Carousel", "'Low'", "Create video content for target keywords"),
    ("Knowledge Panel", "'Medium'", "Add Organization schema markup"),
    ("Sitelinks", "if(n_secondary > 3, 'High', 'Low')", "Improve site navigation and internal linking"),
]
# `{}` stands for the seed.
BROAD_MODIFIERS = ["best", "top", "free", "online", "tool", "tools", "guide", "check"]
PHRASE_TEMPLATES = [
    "{} for beginners", "{} for small business", "{} online free", "{} 2026", "{} tips", "how to use {}", "{} tutorial",
]
RELATED_TEMPLATES = [
    "{} alternative", "{} vs competitors", "best {} platform", "{} pricing", "{} reviews", "free {} tool", "{} comparison",
]
QUESTION_PREFIXES = ["how to", "what is", "why", "where can i", "when should", "which", "can"]
QUESTION_SUFFIXES = ["{} work", "use {}", "improve with {}", "best {}", "fix {} issues"]
QUESTIONS = [
    ("What", "what is {}"), ("What", "what does {} do"), ("What", "what are the best {}"),
    ("How", "how to use {}"), ("How", "how does {} work"), ("How", "how to improve {}"), ("How", "how to choose {}"),
    ("Why", "why is {} important"), ("Why", "why use {}"),
    ("Where", "where to find {}"), ("Where", "where can i get {}"),
    ("Can", "can {} help my business"), ("Can", "can i use {} for free"),
    ("Is", "is {} worth it"), ("Is", "is {} better than alternatives"),
]
TOP_KEYWORDS = 20
TOP_LSI = 15
TOP_GAPS = 10
MAX_CLUSTERS = 8
CLUSTER_SIZE = 10
RESULTS_PER_COUNT = 47

_NOT_STOP = f"not {{}} in ({lits(STOP_WORDS)})"


def page_text(page: DataFrame) -> DataFrame:
    """Text the keyword operators read: title, description, headings and link texts, not the body."""
    return page.selectExpr(
        "site", "ord", "url", "lower(title) as title", "lower(meta_description) as description",
        "transform(headings, h -> lower(h.text)) as headings",
        "concat_ws(' ', nullif(title, ''), nullif(meta_description, ''), transform(headings, h -> h.text), "
        "transform(links, l -> l.text)) as text",
    )


def document_text(documents: DataFrame) -> DataFrame:
    """The same shape over a table of plain documents, grouped by source."""
    return documents.selectExpr(
        "source as site", "doc_id as ord", "cast(doc_id as string) as url", "cast(null as string) as title",
        "cast(null as string) as description", f"{STRINGS} as headings", "text",
    )


def page_text_labeled(page: DataFrame) -> DataFrame:
    parts = (
        "concat_ws(' | ', if(title <> '', concat('Title: ', title), null), "
        "if(meta_description <> '', concat('Description: ', meta_description), null), "
        "transform(headings, h -> concat('H', h.level, ': ', h.text)))"
    )
    return page.selectExpr("site", "ord", "url", f"{parts} as labeled_text")


def tokens(texts: DataFrame) -> DataFrame:
    return texts.withColumn("tokens", F.expr(tokenize("text")))


def occurrences(tokenized: DataFrame) -> DataFrame:
    """One row per keyword occurrence: `is_first` marks the first of its keyword on its page.

    Stop words are looked up once per token. A page's occurrences are sorted inside its own row, so
    pages per keyword can be counted without grouping by page first. Placement flags are set for
    single words only.
    """
    words = tokenized.selectExpr(
        "site", "ord", "url", "title", "description", "headings",
        f"transform(tokens, t -> named_struct('w', t, 'ok', {_NOT_STOP.format('t')})) as words",
    )

    def grams(n: int) -> str:
        at = ["x"] + [f"get(words, i + {k})" for k in range(1, n)]
        keep = " and ".join(f"{a}.ok" for a in at)
        text = f"concat_ws(' ', {', '.join(f'{a}.w' for a in at)})" if n > 1 else "x.w"
        made = f"transform(words, (x, i) -> if({keep}, named_struct('term', {text}, 'n', {n}, 'pos', i), null))"
        return f"filter({made}, g -> g is not null)"

    sorted_terms = words.selectExpr(
        "site", "ord", "url", "title", "description", "headings", f"sort_array(concat({grams(1)}, {grams(2)}, {grams(3)})) as terms"
    )

    def placed(cond: str) -> str:
        return f"g.n = 1 and (i = 0 or get(terms, i - 1).term <> g.term) and coalesce({cond}, false)"

    marked = (
        "transform(terms, (g, i) -> named_struct('term', g.term, 'n', g.n, 'pos', g.pos, 'is_first', i = 0 or get(terms, i - 1).term <> g.term, "
        f"'in_title', {placed('contains(title, g.term)')}, 'in_meta', {placed('contains(description, g.term)')}, "
        f"'in_headings', {placed('exists(headings, h -> contains(h, g.term))')}, 'in_url', {placed('contains(lower(url), g.term)')}))"
    )
    return sorted_terms.selectExpr("site", "ord", "url", f"inline({marked})")


# Page order and position as one decimal: a minimum over a number stays in the hash aggregate, while
# one over a struct sorts every row. Ten digits hold any position in an array, 28 any page order, and
# an overflow would fail the cast instead of passing unseen.
FIRST_SEEN = "cast(ord as decimal(28, 10)) + cast(pos as decimal(10, 0)) * 0.0000000001BD"
FLAGS = ["in_title", "in_meta", "in_headings", "in_url"]


def keyword_pages(tokenized: DataFrame) -> DataFrame:
    """Every page of every keyword, as rows."""
    return occurrences(tokenized).groupBy("site", F.col("term").alias("keyword"), "ord", "url").agg(F.count(F.lit(1)).alias("count")).drop("ord")


def vocabulary(tokenized: DataFrame) -> DataFrame:
    """Total and unique tokens per site, stop words included."""
    totals = tokenized.groupBy("site").agg(F.expr("sum(cast(size(tokens) as bigint))").alias("total_tokens"))
    unique = (
        tokenized.selectExpr("site", "explode(array_distinct(tokens)) as token").distinct()
        .groupBy("site").agg(F.count(F.lit(1)).alias("unique_tokens"))
    )
    return totals.join(unique, "site", "left").na.fill(0, ["unique_tokens"])


# Bytes of text that are counted together before rows are made of them; a longer page is taken whole.
CHUNK_BYTES = 6 << 20
# Bytes of text whose phrases meet in one bucket, and the shares of it that are merged one after another.
BUCKET_BYTES = 32 << 20
SHARES = 16
# Words with a smaller part of a chunk's tokens are not counted where common words are looked for.
LEAST_COMMON = 1 << 14
# Stored bytes of a task: enough for whole chunks, so that a phrase is not sent more often than needed.
TASK_BYTES = 16 << 20
_LETTER = np.zeros(256, bool)
_LETTER[97:123] = True


def raw_strings(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Edges and bytes of strings, nulls as empty ones."""
    strings = pa.concat_arrays([pc.fill_null(strings, "").cast(pa.large_string())])
    if not len(strings):
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    edges = np.frombuffer(strings.buffers()[1], np.int64)[strings.offset : strings.offset + len(strings) + 1]
    return edges - edges[0], np.frombuffer(strings.buffers()[2] or b"", np.uint8)[edges[0] : edges[-1]]


def text_tokens(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The tokens of lower-cased texts as `tokenize` defines them, one after another, and how many each text has."""
    edges, raw = raw_strings(texts)
    letter = _LETTER[raw]
    inside = letter | (raw == 45)
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    cut = edges[(edges > 0) & (edges < len(raw))]
    begins[cut], ends[cut - 1] = inside[cut], inside[cut - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    del letter, inside, begins, ends
    hyphen = np.flatnonzero(raw == 45)
    if len(hyphen):  # those at the ends go; without a letter nothing stays
        new = np.append(True, np.diff(hyphen) > 1)
        run = np.cumsum(new) - 1
        left, right = hyphen[new][run], hyphen[np.append(new[1:], True)][run] + 1
        some = np.flatnonzero(raw[start] == 45)
        start[some] = np.minimum(right[np.searchsorted(hyphen, start[some])], end[some])
        some = np.flatnonzero(raw[end - 1] == 45)
        end[some] = np.maximum(left[np.searchsorted(hyphen, end[some] - 1)], start[some])
    long = end - start >= MIN_TOKEN_LENGTH
    start, end = start[long], end[long]
    mine = np.zeros(len(raw) + 1, np.int8)
    mine[start] = 1
    mine[end] -= 1
    letters = raw[np.cumsum(mine[:-1], dtype=np.int8).view(bool)]
    to = np.append(0, np.cumsum(end - start))
    tokens = pa.Array.from_buffers(pa.large_string(), len(start), [None, pa.py_buffer(to), pa.py_buffer(letters)])
    return tokens, np.diff(np.searchsorted(start, edges))


def chunks(rb: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Rows in runs of at most CHUNK_BYTES of text, or of one row."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(rb.column("text")), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    start = 0
    while start < rb.num_rows:
        end = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + CHUNK_BYTES, "right")))
        yield rb.slice(start, end - start)
        start = end


def full_chunks(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of all batches in runs of about CHUNK_BYTES of text, whatever the size of the batches."""
    held, size = [], 0
    for rows in (rows for rb in it for rows in chunks(rb)):
        mine = pc.sum(pc.binary_length(rows.column("text"))).as_py() or 0
        if held and size + mine > CHUNK_BYTES:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, size = [], 0
        held.append(rows)
        size += mine
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


# Of each phrase: up to three words, by number from 1 on, its site, its occurrences and pages; and where placement is asked
# for, marks (a bit for each of FLAGS, the next one without page order) and the page order and position of the first.
COUNTED = ["w1", "w2", "w3", "site", "count", "n_pages"]
PLACED = ["marks", "ord", "pos"]
STEPS = ("w1", "ord")
Columns = dict[str, np.ndarray]


def next_key(key: np.ndarray, size: int, digit: np.ndarray) -> np.ndarray:
    """Numbers of (key, digit) in their order, where digits are less than `size`: no two pairs share one."""
    if len(key) and (int(key.max()) + 1) * size >= 1 << 62:
        key = np.unique(key, return_inverse=True)[1]
    return key * size + digit


def first_seen(order: pa.Array, page: np.ndarray, pos: np.ndarray, head: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The least page order and position of each run that begins at `head`, and whether it has none."""
    known = pc.is_valid(order).to_numpy(zero_copy_only=False)
    values, rank = np.unique(pc.fill_null(order, 0).to_numpy(zero_copy_only=False), return_inverse=True)
    seen = np.minimum.reduceat(np.where(known, rank, len(values))[page] << 32 | pos, head)
    return values[np.minimum(seen >> 32, len(values) - 1)], seen & 0xFFFFFFFF, seen >> 32 == len(values)


def placement(rows: pa.RecordBatch, words: list[str], page: np.ndarray, once: np.ndarray, head: np.ndarray) -> np.ndarray:
    """FLAGS of single words as bits. `once` are the first occurrences of a page, of `words`."""
    marks = np.zeros(len(head), np.int64)
    pairs = [*zip(words, page[once].tolist())]
    for k, name in enumerate(("title", "description", "headings", "url")):
        held = [[x for x in (v if isinstance(v, list) else [v]) if x] for v in rows.column(name).to_pylist()]
        if any(held):
            found = np.zeros(len(page), bool)
            found[once] = [any(w in x for x in held[p]) for w, p in pairs]
            marks |= np.logical_or.reduceat(found, head).astype(np.int64) << k
    return marks


def chunk_phrases(rows: pa.RecordBatch, lengths: tuple[int, ...], placed: bool) -> tuple[pa.Array, pa.Array, Columns]:
    """The phrases of some pages: their words in order, their sites, and the columns, a number for each site and phrase.

    Words and phrases are numbered, so that phrases are told apart by numbers without a collision.
    """
    tokens, size = text_tokens(rows.column("text"))
    site, words = rows.column("site").dictionary_encode("encode"), tokens.dictionary_encode()
    order = pc.sort_indices(words.dictionary).to_numpy()
    rank = np.empty(len(order), np.int32)
    rank[order] = np.arange(len(order))
    word, words = rank[words.indices.to_numpy()], words.dictionary.take(pa.array(order))
    own = site.indices.to_numpy().astype(np.int64)
    del tokens
    page = np.repeat(np.arange(len(size), dtype=np.int32), size)
    pos = np.arange(len(page), dtype=np.int64) - np.repeat(np.cumsum(size) - size, size) if placed else None
    kept = ~pc.is_in(words, pa.array(STOP_WORDS, pa.large_string())).to_numpy(zero_copy_only=False)[word]
    names = [*COUNTED, *(PLACED if placed else [])]
    found = []
    for n in lengths:
        whole = kept[: max(0, len(page) - n + 1)].copy()
        for k in range(1, n):
            whole &= kept[k : len(whole) + k] & (page[k : len(whole) + k] == page[: len(whole)])
        at = np.flatnonzero(whole)
        if not len(at):
            continue
        key = word[at].astype(np.int64)
        for k in range(1, n):
            key = next_key(key, len(words), word[at + k])
        key = next_key(key, len(site.dictionary), own[page[at]])
        by_key = np.argsort(key, kind="stable")
        at, key = at[by_key], key[by_key]
        del by_key
        new = np.append(True, key[1:] != key[:-1])
        first = np.append(True, np.diff(page[at]) != 0) | new
        head = np.flatnonzero(new)
        del key, new
        numbers = [word[at[head] + k] + 1 if k < n else np.zeros(len(head), np.int32) for k in range(3)]
        numbers += [own[page[at[head]]].astype(np.int32), np.diff(np.append(head, len(at))).astype(np.int32), np.add.reduceat(first, head, dtype=np.int32)]
        if placed:
            once = np.flatnonzero(first)
            marks = placement(rows, words.take(pa.array(word[at[once]])).to_pylist(), page[at], once, head) if n == 1 else np.zeros(len(head), np.int64)
            ords, where, none = first_seen(rows.column("ord"), page[at], pos[at], head)
            numbers += [marks | none.astype(np.int64) << len(FLAGS), np.where(none, 0, ords), where]
        found.append(numbers)
    return words, site.dictionary, {name: np.concatenate([x[k] for x in found] or [np.zeros(0, np.int32)]) for k, name in enumerate(names)}


def mixed(x: np.ndarray) -> np.ndarray:
    """64-bit numbers whose upper bits depend on all bits of x."""
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def string_mix(strings: pa.Array) -> np.ndarray:
    """A 64-bit mix of each string, the same in every task; it only deals phrases out and never tells them apart."""
    edges, raw = raw_strings(strings)
    size = np.diff(edges)
    power = np.cumprod(np.full(int(size.max(initial=0)), 0x9E3779B97F4A7C15, np.uint64))
    sums = np.append(np.uint64(0), np.cumsum((raw + np.uint64(1)) * power[np.arange(len(raw)) - np.repeat(edges[:-1], size)], dtype=np.uint64))
    return mixed(sums[edges[1:]] - sums[edges[:-1]])


def share_of(words: pa.Array, sites: pa.Array, found: Columns, shares: int, common: list[str]) -> np.ndarray:
    """The share of each phrase of a site, the same in every chunk: that of its first word, or of all it has if that is a common one."""
    word, site = np.append(np.uint64(0), string_mix(words)), string_mix(sites)
    key = mixed(word[found["w1"]])
    at = np.flatnonzero(np.append(False, pc.is_in(words, pa.array(common, pa.large_string())).to_numpy(zero_copy_only=False))[found["w1"]])
    for more in (word[found["w2"][at]], word[found["w3"][at]], site[found["site"][at]]):
        key[at] = mixed(key[at] * np.uint64(0x9E3779B97F4A7C15) + more)
    return ((key >> np.uint64(32)) * np.uint64(shares) >> np.uint64(32)).astype(np.int32)


def number_bytes(x: np.ndarray) -> bytes:
    """Numbers from 0 on byte by byte, the lowest ones of all first, as many as the largest needs, behind how many that are."""
    x = x.astype("<u8")
    width = (int(x.max(initial=0)).bit_length() + 7) // 8
    return bytes([width]) + x.view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def bytes_numbers(body: memoryview, at: int, n: int) -> tuple[np.ndarray, int]:
    """The n numbers that `number_bytes` has put at this place, and the place behind them."""
    width = body[at]
    end, wide = at + 1 + width * n, 4 if width < 4 else 8
    x = np.zeros((n, wide), np.uint8)
    x[:, :width] = np.frombuffer(body[at + 1 : end], np.uint8).reshape(width, n).T
    return x.view(f"<i{wide}")[:, 0], end


_ZSTD = pa.Codec("zstd", compression_level=3)


def packed(frames: list[bytes]) -> bytes:
    small = [_ZSTD.compress(f, asbytes=True) if f else b"" for f in frames]
    return np.array([[len(x), len(f)] for x, f in zip(small, frames)], "<u4").tobytes() + b"".join(small)


# Words, sites, widths of the columns, and the shares.
FRAMES = 3 + SHARES


def frame(body: memoryview, k: int) -> memoryview:
    """Frame k of a body that `packed` has made."""
    sizes = np.frombuffer(body[: 8 * FRAMES], "<u4").reshape(-1, 2).astype(np.int64)
    start = 8 * FRAMES + int(sizes[:k, 0].sum())
    return memoryview(_ZSTD.decompress(body[start : start + int(sizes[k, 0])], int(sizes[k, 1]))) if sizes[k, 1] else memoryview(b"")


def string_bytes(strings: pa.Array) -> bytes:
    edges, raw = raw_strings(strings)
    return np.int64(len(strings)).tobytes() + number_bytes(np.diff(edges)) + raw.tobytes()


def bytes_strings(body: memoryview) -> pa.Array:
    n = int(np.frombuffer(body[:8], np.int64)[0])
    size, at = bytes_numbers(body, 8, n)
    return pa.Array.from_buffers(pa.large_string(), n, [None, pa.py_buffer(np.append(0, np.cumsum(size, dtype=np.int64))), pa.py_buffer(body[at:])])


def column_frames(found: Columns, cuts: np.ndarray) -> list[bytes]:
    """How many bytes the numbers of each column have, and the phrases between the cuts byte by byte.

    First words, which mostly ascend, and page orders are differences with the sign in the lowest bit.
    """
    planes = []
    for name, x in found.items():
        if name in STEPS:
            x = x.astype(np.int64)
            step, begin = np.diff(x, prepend=0), cuts[:-1][cuts[:-1] < len(x)]
            step[begin] = x[begin]
            x = step << 1 ^ step >> 63
        width = (int(x.view(f"<u{x.itemsize}").max()).bit_length() + 7) // 8
        planes.append(np.ascontiguousarray(x).view(np.uint8).reshape(len(x), -1)[:, :width].T)
    every = np.concatenate(planes)
    return [bytes(map(len, planes)), *(every[:, a:b].tobytes() for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()))]


def frame_columns(widths: memoryview, body: memoryview, names: list[str]) -> Columns:
    """The phrases of one frame."""
    every, at, found = np.frombuffer(body, np.uint8).reshape(sum(widths), -1), 0, {}
    for name, width in zip(names, widths):
        x = np.zeros((every.shape[1], 4 if width < 4 else 8), np.uint8)
        x[:, :width] = every[at : at + width].T
        found[name] = x.view(f"<i{x.shape[1]}")[:, 0]
        if name in STEPS:
            x = found[name].astype(np.int64).view(np.uint64)
            found[name] = np.cumsum((x >> np.uint64(1)).view(np.int64) ^ -(x & np.uint64(1)).view(np.int64))
        at += width
    return found


def part_counts(it: Iterator[pa.RecordBatch], buckets: list[int], common: list[str], lengths: tuple[int, ...], placed: bool) -> Iterator[pa.RecordBatch]:
    """(bucket, body): the phrases of each chunk that belong to a bucket, with the words and sites they use, share by share."""
    shares = len(buckets) * SHARES
    for rows in full_chunks(it):
        words, sites, found = chunk_phrases(rows, lengths, placed)
        share = share_of(words, sites, found, shares, common)
        known = pc.is_valid(sites).to_numpy(zero_copy_only=False)
        # From here on numbers of sites begin at 1, too; 0 stands for no word, and for a site that is null.
        found["site"], sites = (np.cumsum(known, dtype=np.int32) * known)[found["site"]], sites.drop_null()
        order = np.argsort(share, kind="stable")
        share = share[order]
        for k in found:
            found[k] = found[k][order]
        edges = np.searchsorted(share, np.arange(shares + 1))
        mine, lists = {}, [(x, names, np.zeros(len(x) + 1, bool), np.zeros(len(x) + 1, np.int32)) for x, names in ((words, ("w1", "w2", "w3")), (sites, ("site",)))]
        sent = {"bucket": [], "body": []}
        for b in np.unique(share // SHARES).tolist():
            cuts = edges[b * SHARES : (b + 1) * SHARES + 1]
            mine = {k: x[cuts[0] : cuts[-1]] for k, x in found.items()}
            frames = []
            for strings, names, used, number in lists:
                for name in names:
                    used[mine[name]] = True
                used[0] = False
                own = np.flatnonzero(used)
                used[own], number[own] = False, np.arange(1, len(own) + 1)
                mine |= {name: number[mine[name]] for name in names}
                frames.append(string_bytes(strings.take(pa.array(own - 1))))
            sent["bucket"].append(buckets[b])
            sent["body"].append(packed(frames + column_frames(mine, cuts - cuts[0])))
        del rows, share, order, found, lists, mine
        pa.default_memory_pool().release_unused()
        if sent["bucket"]:
            yield pa.RecordBatch.from_arrays([pa.array(sent["bucket"], pa.int64()), pa.array(sent["body"], pa.binary())], ["bucket", "body"])


MERGED_SCHEMA = "site string, term string, n int, count long, n_pages long"
PLACED_SCHEMA = f"{MERGED_SCHEMA}, ord long, pos int, " + ", ".join(f"{f} boolean" for f in FLAGS)


def renumbered(lists: list[pa.Array]) -> tuple[pa.Array, list[np.ndarray]]:
    """One list of the distinct strings of all, and the numbers of each one's strings in it: 0 stays, others begin at 1."""
    every = pa.concat_arrays(lists).dictionary_encode()
    ends = np.cumsum([len(x) for x in lists])
    return every.dictionary, [np.append(0, x + 1) for x in np.split(every.indices.to_numpy().astype(np.int32), ends[:-1])]


def merged_share(words: pa.Array, sites: pa.Array, found: Columns, placed: bool) -> Iterator[pa.RecordBatch]:
    """One row for each site and phrase of a share."""
    upper = found["w1"].astype(np.int64) * (len(words) + 1) + found["w2"]
    lower = found["w3"].astype(np.int64) * (len(sites) + 1) + found["site"]
    if (len(words) + 1) ** 3 * (len(sites) + 1) < 1 << 62:
        upper, lower = upper * ((len(words) + 1) * (len(sites) + 1)) + lower, np.zeros(1, np.int64)
    several = [lower] if len(lower) == len(upper) else []
    if placed:
        order = np.lexsort((found["pos"], found["ord"], found["marks"] >> len(FLAGS), *several, upper))
    else:
        order = np.lexsort((*several, upper)) if several else np.argsort(upper)
    upper, *several = [x[order] for x in (upper, *several)]
    new = np.ones(len(order), bool)
    new[1:] = upper[1:] != upper[:-1]
    for x in several:
        new[1:] |= x[1:] != x[:-1]
    head = np.flatnonzero(new)
    first = order[head]
    sums = {k: np.add.reduceat(found[k][order], head, dtype=np.int64) for k in ("count", "n_pages")}
    marks = np.bitwise_or.reduceat(found["marks"][order], head) if placed else None
    length = (found["w2"][first] > 0).astype(np.int64) + (found["w3"][first] > 0) + 1
    for n in (1, 2, 3):
        mine = np.flatnonzero(length == n)
        for k in range(0, len(mine), 50_000):
            some = mine[k : k + 50_000]
            at = first[some]
            term = pc.binary_join_element_wise(*[words.take(pa.array(found[w][at] - 1)) for w in ("w1", "w2", "w3")[:n]], pa.scalar(" ", pa.large_string())).cast(pa.string())
            site = found["site"][at]
            columns = [sites.take(pa.array(site - 1, mask=site == 0)).cast(pa.string()), term, pa.array(np.full(len(some), n, np.int32)), pa.array(sums["count"][some]), pa.array(sums["n_pages"][some])]
            names = ["site", "term", "n", "count", "n_pages"]
            if placed:
                columns += [pa.array(found["ord"][at], mask=found["marks"][at] >> len(FLAGS) > 0), pa.array(found["pos"][at].astype(np.int32)), *[pa.array(marks[some] >> f & 1 > 0) for f in range(len(FLAGS))]]
                names += ["ord", "pos", *FLAGS]
            yield pa.RecordBatch.from_arrays(columns, names)


def merged(bodies: Iterator[pa.RecordBatch], placed: bool) -> Iterator[pa.RecordBatch]:
    """The phrases of a bucket, counted over all chunks. Bodies stay packed but for the share that is merged."""
    held = [memoryview(x.as_buffer()) for rb in bodies for x in rb.column("body")]
    words, word = renumbered([bytes_strings(frame(x, 0)) for x in held])
    sites, site = renumbered([bytes_strings(frame(x, 1)) for x in held])
    names = [*COUNTED, *(PLACED if placed else [])]
    for k in range(3, FRAMES):
        parts = []
        for body, by_word, by_site in zip(held, word, site):
            share = frame(body, k)
            if share:
                found = frame_columns(frame(body, 2), share, names)
                parts.append(found | {w: by_word[found[w]] for w in ("w1", "w2", "w3")} | {"site": by_site[found["site"]]})
        if parts:
            yield from merged_share(words, sites, {name: np.concatenate([p.pop(name) for p in parts]) for name in names}, placed)
            pa.default_memory_pool().release_unused()


def token_numbers(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(site, word, whether the text is null, number of tokens, bytes): a row for each text, and one for each frequent word of a chunk."""
    names = ["site", "word", "lacks", "n", "bytes"]
    for rows in full_chunks(it):
        tokens, size = text_tokens(rows.column("text"))
        length = pc.fill_null(pc.binary_length(rows.column("text")), 0).cast(pa.int64())
        yield pa.RecordBatch.from_arrays([rows.column("site"), pa.nulls(rows.num_rows, pa.string()), pc.is_null(rows.column("text")), pa.array(size.astype(np.int64)), length], names)
        words = tokens.dictionary_encode()
        n = np.bincount(words.indices.to_numpy(), minlength=len(words.dictionary))
        often = np.flatnonzero(n * LEAST_COMMON >= len(tokens))
        none = pa.array(np.zeros(len(often), np.int64))
        yield pa.RecordBatch.from_arrays([pa.nulls(len(often), pa.string()), words.dictionary.take(pa.array(often)).cast(pa.string()), none.cast(pa.bool_()), pa.array(n[often].astype(np.int64)), none], names)


def even_keys(spark: SparkSession, n: int) -> list[int]:
    """n numbers that a repartition by them puts on n partitions, one on each (but for rare luck)."""
    found = {r.p: r.id for r in spark.range(20 * n + 100).selectExpr("id", f"pmod(hash(id), {n}) as p").collect()}
    return [found.get(p, -1 - p) for p in range(n)]


def keyword_table(tokenized: DataFrame, dealt: DataFrame | None = None, lengths: tuple[int, ...] = (1, 2, 3), placed: bool = True) -> DataFrame:
    """One row per site and keyword: count, pages, density; if `placed`, placement and first occurrence, too.

    Each task counts the phrases of its pages on numbered words, chunk by chunk, which gives the same as grouping
    the rows of `occurrences`, and sends each bucket its phrases as numbers in one packed row, with the words they use.
    There is a bucket for each BUCKET_BYTES of text, so what a task holds does not grow with the table. Phrases are dealt
    out by their first word, which keeps these rows small; those with a common first word by all their words and the site,
    so that no word or phrase fills a bucket. Tokens and bytes of the sites are stored before. The site total is broadcast
    when the sites are few, else sites with a large share of the pages are salted. `dealt` has the rows of `tokenized` in
    tasks of bounded size, where these are not so anyway; phrases of `lengths` words are counted.
    """
    spark = tokenized.sparkSession
    numbers = tokenized.selectExpr("site", "lower(text) as text").mapInArrow(token_numbers, "site string, word string, lacks boolean, n long, bytes long")
    known = stored(numbers.groupBy("site", "word").agg(
        F.expr("sum(if(lacks, cast(size(cast(null as array<string>)) as bigint), n))").alias("total_tokens"), F.sum("bytes").alias("bytes")
    ), "site-tokens")
    totals = known.where("word is null").select("site", "total_tokens")
    every = known.where("word is null").agg(F.sum("total_tokens").alias("n"), F.sum("bytes").alias("bytes")).first()
    buckets = even_keys(spark, max(spark.sparkContext.defaultParallelism, -(-(every.bytes or 0) // BUCKET_BYTES)))
    # A word that is not common has about half of a share of the phrases at most.
    common = [r.word for r in known.where(F.expr(f"word is not null and total_tokens * {2 * SHARES * len(buckets)}L >= {every.n or 0}L")).collect()]
    columns = "site", "cast(ord as bigint) as ord", "title", "description", "headings", "lower(url) as url", "lower(text) as text"

    def send(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return part_counts(it, buckets, common, lengths, placed)

    def merge(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return merged(it, placed)

    parts = (tokenized if dealt is None else dealt).selectExpr(*(columns if placed else [columns[0], columns[-1]])).mapInArrow(send, "bucket long, body binary")
    counted = parts.repartition(len(buckets), "bucket").groupBy("bucket").applyInArrow(merge, PLACED_SCHEMA if placed else MERGED_SCHEMA)
    joined = sized_join(counted, totals, ["site"], ["term"], totals)
    table = ["site", "term as keyword", "n", "count", "n_pages", "if(total_tokens = 0, 0.0D, round(count / total_tokens * 100, 2)) as density"]
    if not placed:
        return joined.selectExpr(*table)
    return joined.withColumn("seen", F.expr(FIRST_SEEN)).selectExpr(
        *table, *FLAGS, "named_struct('ord', cast(seen as bigint), 'n', n, 'pos', cast((seen - floor(seen)) * 10000000000 as int)) as first_seen",
    )


def _ranked(df: DataFrame, k: int) -> DataFrame:
    """First k keywords per site by count; ties keep first-seen order."""
    order = Window.partitionBy("site").orderBy(F.desc("count"), "first_seen")
    return df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def primary_keywords(table: DataFrame) -> DataFrame:
    return _ranked(table.where("n = 1"), TOP_KEYWORDS)


def secondary_keywords(table: DataFrame) -> DataFrame:
    return _ranked(table.where("n > 1"), TOP_KEYWORDS)


def lsi_keywords(table: DataFrame) -> DataFrame:
    """Top bigrams that are not already secondary keywords."""
    top = _ranked(table.where("n = 2"), TOP_LSI)
    return top.join(secondary_keywords(table).select("site", "keyword"), ["site", "keyword"], "left_anti")


def keyword_gaps(table: DataFrame, sites: DataFrame) -> DataFrame:
    """Candidate terms a site does not use, first ten in listed order."""
    terms = ", ".join(lit(g) for g in GAP_CANDIDATES)
    wanted = sites.select("site").distinct().selectExpr("site", f"posexplode(array({terms})) as (pos, keyword)")
    absent = wanted.join(table.where(F.col("keyword").isin(GAP_CANDIDATES)).select("site", "keyword"), ["site", "keyword"], "left_anti")
    order = Window.partitionBy("site").orderBy("pos")
    return absent.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= TOP_GAPS).select("site", "rank", "keyword")


def top_keywords(table: DataFrame) -> DataFrame:
    """Primary then secondary keywords of each site: at most 40 rows per site, in one ranking pass."""
    kind = F.when(F.col("n") == 1, 0).otherwise(1)
    order = Window.partitionBy("site", "part").orderBy(F.desc("count"), "first_seen")
    return (
        table.withColumn("part", kind).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= TOP_KEYWORDS)
        .withColumn("position", F.col("part") * TOP_KEYWORDS + F.col("rank"))
    )


def keyword_report(tokenized: DataFrame, table: DataFrame) -> DataFrame:
    """One row per site with the ranked lists, the gaps and the vocabulary size.

    `table` is the stored keyword table, which the four lists rank without counting again.
    """

    def listed(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("site").agg(F.expr("array_join(transform(sort_array(collect_list(struct(rank, keyword))), r -> r.keyword), '|')").alias(name))

    report = vocabulary(tokenized)
    for df, name in [
        (primary_keywords(table), "primary_keywords"), (secondary_keywords(table), "secondary_keywords"),
        (lsi_keywords(table), "lsi_keywords"), (keyword_gaps(table, tokenized), "keyword_gaps"),
    ]:
        report = report.join(listed(df, name), "site", "left")
    return report.na.fill("", ["primary_keywords", "secondary_keywords", "lsi_keywords", "keyword_gaps"])


TREND = "if(in_title, 2, 0) + if(in_meta, 1, 0) + if(in_headings, 2, 0) + if(in_url, 1, 0)"


def keyword_overview(top: DataFrame) -> DataFrame:
    return top.selectExpr(
        "site", "position", "keyword", "count as volume", "density",
        "case when density >= 3.0 then 'Hard' when density >= 1.5 then 'Medium' else 'Easy' end as difficulty",
        "round(density * 1.2D + 0.5D, 2) as cpc",
        "round(least(density / 5.0D, 1.0D), 2) as competition",
        f"case when keyword rlike {lit(any_word(TRANSACTIONAL))} then 'Transactional' "
        f"when keyword rlike {lit(any_word(COMMERCIAL))} then 'Commercial' "
        "when in_url then 'Navigational' else 'Informational' end as intent",
        f"case when {TREND} >= 4 then 'Rising' when {TREND} >= 2 then 'Stable' else 'Low' end as trend",
        *FLAGS, f"count * {RESULTS_PER_COUNT} as results",
    )


def keyword_search(overview: DataFrame, needle: str) -> DataFrame:
    return overview.where(F.lower("keyword").contains(needle.lower()))


def keyword_recommendations(top: DataFrame) -> DataFrame:
    advice = (
        "array_compact(array(if(in_title, null, 'Add to title tag'), if(in_meta, null, 'Add to meta description'), "
        "if(in_headings, null, 'Add to H1/H2 heading'), "
        "case when density < 0.5 then 'Increase keyword density' when density > 4.0 then 'Reduce keyword stuffing' end, "
        "if(in_title and in_meta and in_headings, 'Well optimized placement!', null)))"
    )
    return top.selectExpr("site", "position", "keyword", f"posexplode({advice}) as (n, recommendation)")


def serp_opportunities(top: DataFrame, gaps: DataFrame) -> DataFrame:
    facts = top.groupBy("site").agg(
        F.expr("coalesce(max(in_headings) filter (where part = 0), false)").alias("any_in_headings"),
        F.expr("count_if(part = 0)").alias("n_primary"),
        F.expr("count_if(part = 1)").alias("n_secondary"),
    ).where("n_primary > 0")
    n_gaps = gaps.groupBy("site").agg(F.count(F.lit(1)).alias("n_gaps"))
    rows = ", ".join(
        f"named_struct('n', {i}, 'feature', {lit(f)}, 'opportunity', {o}, 'action', {lit(a)})"
        for i, (f, o, a) in enumerate(SERP_ACTIONS, 1)
    )
    return facts.join(n_gaps, "site", "left").na.fill(0, ["n_gaps"]).selectExpr("site", f"inline(array({rows}))")


def site_seeds(table: DataFrame) -> DataFrame:
    """The most frequent single keyword of each site, used as its seed."""
    return table.where("n = 1").groupBy("site").agg(
        F.expr("max_by(keyword, struct(count, -first_seen.ord, -first_seen.pos))").alias("seed")
    )


def keyword_clusters(top: DataFrame, seeds: DataFrame) -> DataFrame:
    """Keywords grouped by their most distinctive word; groups in order of first appearance."""
    words = "split(keyword, ' ')"
    name = f"initcap(coalesce(get(filter({words}, w -> not array_contains(split(seed, ' '), w) and length(w) > 3), 0), {words}[0]))"
    named = top.join(seeds, "site").selectExpr("site", "seed", "position", "keyword", "count", f"{name} as cluster")
    inside = Window.partitionBy("site", "cluster").orderBy("position")
    across = Window.partitionBy("site").orderBy("first_position", "cluster")
    grouped = (
        named.withColumn("rank", F.row_number().over(inside))
        .withColumn("first_position", F.min("position").over(Window.partitionBy("site", "cluster")))
        .groupBy("site", "seed", "cluster", "first_position")
        .agg(
            F.expr(f"array_join(transform(filter(sort_array(collect_list(struct(rank, keyword))), r -> r.rank <= {CLUSTER_SIZE}), r -> r.keyword), '|')").alias("keywords"),
            F.count(F.lit(1)).alias("n_keywords"),
            F.round(F.avg("count"), 4).alias("mean_count"),
        )
    )
    return grouped.withColumn("cluster_rank", F.row_number().over(across)).where(F.col("cluster_rank") <= MAX_CLUSTERS).drop("first_position")


def _template(text: str) -> str:
    head, tail = text.split("{}")
    return f"concat({lit(head)}, seed, {lit(tail)})"


def expansion_templates() -> list[tuple[str, str]]:
    """(match type, SQL text over `seed`) of every expansion, in order."""
    broad = [("broad", f"if(startswith(seed, {lit(m)}), seed, concat({lit(m + ' ')}, seed))") for m in BROAD_MODIFIERS]
    phrase = [("phrase", _template(t)) for t in PHRASE_TEMPLATES]
    related = [("related", _template(t)) for t in RELATED_TEMPLATES]
    question = [
        ("question", f"concat({lit(p + ' ')}, {_template(QUESTION_SUFFIXES[i % len(QUESTION_SUFFIXES)])})")
        for i, p in enumerate(QUESTION_PREFIXES)
    ]
    return [*broad, *phrase, ("exact", "seed"), *related, *question]


def keyword_expand(seeds: DataFrame, table: DataFrame, match_type: str = "all") -> DataFrame:
    """Keyword ideas around each seed with the counts measured on the site itself."""
    rows = ", ".join(
        f"named_struct('n', {i}, 'match_type', {lit(m)}, 'keyword', btrim({t}))"
        for i, (m, t) in enumerate(expansion_templates(), 1) if match_type in ("all", m)
    )
    ideas = seeds.selectExpr("site", "seed", f"inline(array({rows}))")
    measured = table.selectExpr("site", "keyword", "count", "density")
    return ideas.join(measured, ["site", "keyword"], "left").selectExpr(
        "site", "seed", "n", "keyword", "match_type", "size(split(keyword, ' ')) as words",
        "coalesce(count, 0) as volume", "cast(round(least(coalesce(density, 0.0D) / 5.0D, 1.0D) * 100) as int) as kd",
    )


def keyword_questions(seeds: DataFrame) -> DataFrame:
    rows = ", ".join(
        f"named_struct('n', {i}, 'type', {lit(kind)}, 'question', {_template(t)}, "
        f"'intent', {lit('Informational' if kind in ('What', 'How', 'Why') else 'Commercial')})"
        for i, (kind, t) in enumerate(QUESTIONS, 1)
    )
    return seeds.selectExpr("site", "seed", f"inline(array({rows}))")


def keyword_metrics(expanded: DataFrame) -> DataFrame:
    def of(kind: str) -> Column:
        return F.expr(f"count_if(match_type = '{kind}')").alias(f"{kind}_keywords")

    return expanded.groupBy("site").agg(
        F.count(F.lit(1)).alias("total_keywords"),
        F.sum("volume").alias("total_volume"),
        F.expr("cast(floor(sum(cast(kd as bigint)) / count(1)) as bigint)").alias("avg_kd"),
        of("question"), of("broad"), of("exact"),
    )


def keyword_labels(expanded: DataFrame) -> DataFrame:
    return expanded.selectExpr(
        "site", "n", "keyword", "kd", "volume",
        "case when kd <= 29 then 'easy' when kd <= 49 then 'possible' when kd <= 69 then 'difficult' else 'hard' end as kd_band",
        "case when volume >= 10000 then 'high' when volume >= 1000 then 'medium' else 'low' end as volume_band",
    )


def competitor_gap(table: DataFrame, ours: DataFrame, k: int = 10) -> DataFrame:
    """Keywords other sites use and `ours` (one row: site) does not, most used first."""
    own = F.col("site") == ours.agg(F.min("site")).scalar()
    totals = table.withColumn("own", own).groupBy("keyword").agg(
        F.sum(F.expr("if(own, 0L, count)")).alias("competitor_count"), F.expr("count_if(not own)").alias("competitor_sites"), F.max("own").alias("used")
    )
    return (
        totals.where("not used and competitor_sites > 0").drop("used").orderBy(F.desc("competitor_count"), "keyword").limit(k)
    )
