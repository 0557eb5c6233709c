"""Registered queries of the training-data operators and their checking SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_discriminant(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pagelens.llm.quality import quality_scores

    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), folds=5, held_out=0, threshold=0.3)


def op3_kd_tree_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pagelens.llm.shards import kd_shards

    return kd_shards(table(spark, sf_dir, "documents"), shards=24)


def op4_latent_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pagelens.llm.decontaminate import leaks

    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from pagelens.llm.tokens import token_ids

    return token_ids(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op6_minhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pagelens.llm.minhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), size=3, percent=85)


def op7_toxicity_counterfactual(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pagelens.llm.toxicity import toxicity_scores

    return toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), folds=3, held_out=1, threshold=0.7)


def op2_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pagelens.llm.warc import warc_round_trip

    return warc_round_trip(table(spark, sf_dir, "pages"), least_bytes=100)


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pagelens.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"))


def op8_metric_range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pagelens.llm.vectors import near_vectors

    return near_vectors(table(spark, sf_dir, "embeddings"), cosine=0.98)


def op9_repeated_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pagelens.llm.substrings import repeat_report

    return repeat_report(table(spark, sf_dir, "documents"), length=50)


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pagelens.llm.trie import conversation_trie

    return conversation_trie(table(spark, sf_dir, "conversations"))


def op12_prefix_target_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pagelens.llm.chat import chat_report, with_probe

    return chat_report(with_probe(table(spark, sf_dir, "conversations")))


def op13_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pagelens.llm.collocations import collocations

    return collocations(table(spark, sf_dir, "documents"), least=10, inside_percent=50, most=2000)


QUERIES = {f.__name__: f for f in (op1_quality_discriminant, op2_warc_round_trip, op3_kd_tree_shards, op4_latent_decontamination, op5_token_files, op6_minhash_near_duplicates, op7_toxicity_counterfactual, op8_metric_range_join, op9_repeated_substrings, op10_best_fit_packing, op11_conversation_trie, op12_prefix_target_examples, op13_phrase_collocations)}
ORACLES: dict[str, str] = {
    "op8_metric_range_join": """
        with recursive v as (select vec_id, label, list_transform(embedding, lambda x: cast(x as double)) as e from embeddings where label is not null and embedding is not null),
        links as (select a.vec_id as x, b.vec_id as y from v a join v b on a.label = b.label and a.vec_id <> b.vec_id and len(a.e) = len(b.e)
            where isfinite(list_cosine_similarity(a.e, b.e)) and list_cosine_similarity(a.e, b.e) >= 0.98),
        reach(x, y) as (select x, y from links union select r.x, l.y from reach r join links l on l.x = r.y)
        select vec_id, cast((select count(*) from links l where l.x = e.vec_id) as bigint) as n_links,
               least(vec_id, coalesce((select min(y) from reach r where r.x = e.vec_id), vec_id)) as component_id,
               least(vec_id, coalesce((select min(y) from reach r where r.x = e.vec_id), vec_id)) = vec_id as kept
        from embeddings e""",
    "op2_warc_round_trip": """
        with p as (select page_id, coalesce(html, '') as body from pages),
        d as (select page_id, cast(strlen(body) as bigint) as payload_bytes, sha256(body) as payload_digest from p),
        f as (select payload_digest, min(page_id) as first_page from d where payload_bytes >= 100 group by 1)
        select page_id, payload_bytes, d.payload_digest,
               case when first_page is not null and first_page <> page_id then 'revisit' else 'response' end as record_type,
               case when first_page <> page_id then first_page end as refers_to
        from d left join f on d.payload_bytes >= 100 and f.payload_digest = d.payload_digest""",
    "op11_conversation_trie": r"""
        with recursive bits(b, v, k) as (select b, b, 0 from range(256) t(b) union all select b, xor(v >> 1, case when v & 1 = 1 then 3988292384 else 0 end), k + 1 from bits where k < 8),
        crc(c, rest, v) as (select distinct conv_id, cast(conv_id as varchar), 4294967295 from conversations where conv_id is not null
            union all select c, rest[2:], xor(crc.v >> 8, bits.v) from crc join bits on bits.k = 8 and bits.b = xor(crc.v, ascii(rest)) & 255 where rest <> ''),
        heads as (select c, xor(v, 4294967295) % 6 as h, c - c % 100 as base from crc where rest = ''),
        own as (select conv_id as c, row_number() over (partition by conv_id order by turn nulls first, role, text) as i, role, text
            from (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations where conv_id is not null)),
        built as (select h.c, o.i as d, role, text from heads h join own o on o.c = h.base and o.i <= h.h
            union all select h.c, least(h.h, (select count(*) from own b where b.c = h.base)) + o.i - h.h, role, text from heads h join own o on o.c = h.c and o.i > h.h),
        path as (select c, d, text, string_agg(md5(length(role) || ':' || role || text), '' order by d) over (partition by c order by d rows unbounded preceding) as key from built
            union all select c, 0, '', '' from heads),
        last as (select c, max(d) as size from path group by c),
        node as (select d, key, min(p.c) as conv_id, count(*) as n, any_value(length(text)) as chars, string_agg(cast(p.c as varchar), ',' order by p.c) filter (d = size) as ends from path p join last using (c) group by d, key),
        up as (select n.*, p.conv_id as parent, p.key as parent_key from node n left join node p on p.d = n.d - 1 and p.key = left(n.key, cast(32 * p.d as bigint))),
        kids as (select d - 1 as d, parent_key as key, count(*) as children from up where d > 0 group by all),
        below as (select distinct a.d, a.key, b.d as bd, b.key as bkey from path a join path b on a.c = b.c and b.d >= a.d),
        sums as (select s.d, s.key, count(*) filter (k.children is null) as leaves, sum((n.n - 1) * n.chars) as saved
            from below s join node n on n.d = s.bd and n.key = s.bkey left join kids k on k.d = s.bd and k.key = s.bkey group by s.d, s.key)
        select conv_id, cast(u.d as bigint) as depth, parent as parent_conv_id, n as n_convs, coalesce(children, 0) as n_children, leaves as n_leaves, cast(saved as bigint) as saved_tokens, sha256(coalesce(ends, '')) as ends_sha256
        from up u join sums s on s.d = u.d and s.key = u.key left join kids k on k.d = u.d and k.key = u.key""",
    "op12_prefix_target_examples": r"""
        with c as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from (select conv_id, turn, role, text from conversations
                union all select -7, 0, 'user', '\### Assistant: </turn> ok' union all select -7, 1, 'assistant', '\### Assistant: </turn> ok')),
        l as (select *, 14 + length(replace(replace(replace(replace(role, '\', '\b'), '###', '\h'), '</turn>', '\t'), ':', '\c'))
            + length(replace(replace(replace(text, '\', '\b'), '###', '\h'), '</turn>', '\t')) as size from c),
        s as (select *, sum(size) over (partition by conv_id order by turn nulls first, role, text rows unbounded preceding) as upto from l)
        select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
            cast(coalesce(sum(length(text)) filter (role = 'assistant'), 0) as bigint) as loss_chars,
            sha256(coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (role = 'assistant'), '')) as loss_sha256,
            cast(coalesce(sum(upto) filter (role = 'assistant'), 0) as bigint) as formatted_chars
        from s group by conv_id""",
    "op13_phrase_collocations": r"""
        with p as (select lang, row_number() over () as piece, regexp_extract_all(s, '[^\x20\x09]+') as ws from
            (select coalesce(lang, 'und') as lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as s from documents)),
        w as (select lang, piece, unnest(ws) as a, generate_subscripts(ws, 1) as i from p),
        t as (select lang, a, lead(a) over o as b, lead(a, 2) over o as c from w window o as (partition by piece order by i)),
        f1 as (select lang, a, count(*) as f from t group by all),
        f2 as (select lang, a, b, count(*) as f from t where b is not null group by all having count(*) >= 10),
        f3 as (select lang, a, b, c, count(*) as f from t where c is not null group by all having count(*) >= 10),
        cuts as (
            select lang, a || ' ' || b as phrase, 2 as k, a, b, f2.f as f, 1 as cut, x.f as l, y.f as r from f2 join f1 x using (lang, a) join (select lang, a as b, f from f1) y using (lang, b)
            union all
            select lang, a || ' ' || b || ' ' || c, 3, a, b, f3.f, 1, x.f, y.f from f3 join f1 x using (lang, a) join (select lang, a as b, b as c, f from f2) y using (lang, b, c)
            union all
            select lang, a || ' ' || b || ' ' || c, 3, a, b, f3.f, 2, x.f, y.f from f3 join f2 x using (lang, a, b) join (select lang, a as c, f from f1) y using (lang, c)),
        worst as (select *, cast((1000000::hugeint * f * f) // (l::hugeint * r) as bigint) as score from cuts qualify row_number() over (partition by lang, phrase order by score, cut) = 1),
        inside as (select lang, a, b, max(f) as longer from (select lang, a, b, f from f3 union all select lang, b, c, f from f3) group by all),
        best as (select lang, row_number() over (partition by lang order by score desc, f desc, encode(phrase)) as rank, phrase, f as a, l, r, score
            from worst left join inside using (lang, a, b) where k = 3 or longer is null or 100 * longer < 50 * f)
        select lang, rank, phrase, a, l, r, cast(n as bigint) as n, score from best join (select lang, sum(f) as n from f1 group by lang) using (lang) where rank <= 2000""",
}
