"""The registered queries of the numbered operators, and DuckDB twins where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers

from tessera.llm import chat, decontam, divergence, imatch, kneser_ney, packing, simhash, suffix_dedup, token_counts, topk, toxicity, urls, vector_codes

BPE = "byte_bpe_50k.json"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path(BPE))


def op3_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kneser_ney.scored(_table(spark, sf_dir, "documents"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.verdicts(_table(spark, sf_dir, "pages"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op7_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.quantized(_table(spark, sf_dir, "embeddings"))
    return topk.top_k(vectors, vectors.where(F.col("vec_id") % topk.EVERY == 0))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(_table(spark, sf_dir, "documents"), public_tokenizers.path(BPE))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digest(suffix_dedup.deduplicated(_table(spark, sf_dir, "documents").select("doc_id", "text")))


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = "</s>[INST] ok [/INST]"
    extra = spark.sql(f"select -1L as conv_id, t as turn, r as role, '{own}' as text from values (0L, 'user'), (1L, 'assistant') as x(t, r)")
    conversations = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat.digest(chat.render(chat.fold_events(chat.events_of(conversations))))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compressed(_table(spark, sf_dir, "embeddings"))


def op12_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imatch.fingerprints(_table(spark, sf_dir, "documents"))


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(_table(spark, sf_dir, "documents"))


LLM_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontamination": op1_decontamination,
    "op2_packing": op2_packing,
    "op3_kneser_ney": op3_kneser_ney,
    "op4_token_counts": op4_token_counts,
    "op5_url_filter": op5_url_filter,
    "op6_toxicity": op6_toxicity,
    "op7_top_k": op7_top_k,
    "op8_simhash": op8_simhash,
    "op9_chat": op9_chat,
    "op10_suffix_dedup": op10_suffix_dedup,
    "op11_vector_codes": op11_vector_codes,
    "op12_imatch": op12_imatch,
    "op13_divergence": op13_divergence,
}

_WORDS = "case when trim(regexp_replace(lower(text), '[^\\p{L}\\p{M}\\p{N}]+', ' ', 'g')) = '' then [] else string_split(trim(regexp_replace(lower(text), '[^\\p{L}\\p{M}\\p{N}]+', ' ', 'g')), ' ') end"
_SHINGLES = "select distinct {0}, array_to_string(w[i:i + 4], ' ') as s from {1}, unnest(range(1, len(w) - 3)) as u(i)"



def _vector_codes(rounds: int) -> str:
    """Codebooks round by round: x and c0, c1, .. have a row for each component."""
    near = "select x.vec_id, x.part, c.entry, sum((x.v - c.v) * (x.v - c.v))::bigint as d from x join c{0} c on x.part = c.part and x.pos = c.pos group by x.vec_id, x.part, c.entry"
    best = "select vec_id, part, arg_min(entry, d * 16 + entry) as entry, min(d) as d from ({0}) group by vec_id, part"
    ctes = [
        "e as materialized (select vec_id, label, list_transform(embedding, lambda a: floor(4096 * a::double)::bigint) as q from embeddings where embedding is not null and len(list_filter(embedding, lambda a: a is null or not isfinite(a))) = 0)",
        "x as materialized (select vec_id, (i * 8) // len(q) as part, i % (len(q) // 8) as pos, q[i + 1] as v from e, unnest(range(len(q))) as u(i))",
        "f as (select vec_id, row_number() over (order by vec_id) - 1 as entry from e qualify entry < 16)",
        "c0 as materialized (select part, entry, pos, v from x join f on x.vec_id = f.vec_id)",
    ]
    for r in range(1, rounds + 1):
        ctes.append(f"a{r} as materialized ({best.format(near.format(r - 1))})")
        ctes.append(f"s{r} as (select a.part, a.entry, x.pos, sum(x.v)::bigint as s, count(*) as n from a{r} a join x on a.vec_id = x.vec_id and a.part = x.part group by a.part, a.entry, x.pos)")
        ctes.append(f"c{r} as materialized (select c.part, c.entry, c.pos, coalesce((s.s - ((s.s % s.n) + s.n) % s.n) // s.n, c.v) as v from c{r - 1} c left join s{r} s on c.part = s.part and c.entry = s.entry and c.pos = s.pos)")
    ctes.append(f"a as (select vec_id, string_agg(printf('%02x', entry), '' order by part) as code, sum(d)::bigint as error from ({best.format(near.format(rounds))}) group by vec_id)")
    ctes.append(f"h as (select sha256(string_agg(v::varchar, ',' order by part, entry, pos)) as h from c{rounds})")
    return f"with {', '.join(ctes)} select a.vec_id, code, error, sum(error) over (partition by label)::bigint as label_error, h as codebooks_sha256 from a join e on a.vec_id = e.vec_id, h"


_SHARE = "1 + (1000000000::hugeint * ({0} + 5)) // ({1} + 5 * {2})"
_DIVERGENCE = (
    "with d as (select row_number() over () as id, coalesce(lang, '') as lang, coalesce(source, '') as source, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') as t from documents),"
    " w as (select id, lang, source, unnest(t) as term from d), k as materialized (select lang, term, count(*) as c from w group by lang, term having count(distinct id) >= 30),"
    " l as materialized (select lang, sum(c)::bigint as n, count(*) as v from k group by lang), g as materialized (select distinct lang, source from d),"
    " o as materialized (select w.lang, w.source, w.term, count(*) as c from w join k on w.lang = k.lang and w.term = k.term group by all), n as (select lang, source, sum(c)::bigint as n from o group by all),"
    f" p as materialized (select g.lang, g.source, k.term, coalesce(o.c, 0) as c, ({_SHARE.format('coalesce(o.c, 0)', 'coalesce(n.n, 0)', 'l.v')})::bigint as p, ({_SHARE.format('k.c', 'l.n', 'l.v')})::bigint as q"
    " from g join k on g.lang = k.lang join l on l.lang = g.lang left join n on n.lang = g.lang and n.source = g.source left join o on o.lang = g.lang and o.source = g.source and o.term = k.term),"
    " s as (select a.lang, a.source, b.source as item, sum(abs(a.p - b.p))::bigint as value from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all),"
    " u as (select g.lang, g.source, 'pair' as part, h.source as item, coalesce(s.value, 0) as value from g join g h on g.lang = h.lang and g.source <> h.source left join s on s.lang = g.lang and s.source = g.source and s.item = h.source"
    " union all select lang, source, 'term', term, p - q from p where c > 0 and p > q)"
    " select lang, source, part, item, value, row_number() over (partition by lang, source, part order by value desc, item)::int as rank from u qualify part = 'pair' or rank <= 50"
)

LLM_ORACLE: dict[str, str] = {
    "op11_vector_codes": _vector_codes(6),
    "op13_divergence": _DIVERGENCE,
    "op7_top_k": "with v as (select vec_id, list_transform(embedding, lambda x: floor(64 * x::double)::bigint) as q from embeddings where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0), s as (select a.vec_id as query_id, b.vec_id, list_sum(list_transform(range(1, len(a.q) + 1), lambda i: a.q[i] * b.q[i]))::bigint as score from v a join v b on a.vec_id % 20 = 0 and a.vec_id <> b.vec_id and len(a.q) = len(b.q)) select query_id, row_number() over (partition by query_id order by score desc, vec_id)::int as rank, vec_id, score from s qualify rank <= 20",
    "op1_decontamination": (
        f"with d as (select doc_id, {_WORDS} as w from documents), b as (select row_number() over () as i, item_id, w from (select distinct item_id, {_WORDS} as w from benchmark)),"
        f" ds as ({_SHINGLES.format('doc_id', 'd')}), bs as ({_SHINGLES.format('i', 'b')}), n as (select i, count(*) as n_shingles from bs group by i),"
        " x as (select doc_id, i, count(*) as n_shared from ds join bs on ds.s = bs.s group by doc_id, i)"
        " select doc_id, b.item_id, n_shared, n_shingles, n_shared::double / n_shingles as containment from x join n on x.i = n.i join b on b.i = n.i where n_shared >= n_shingles * 0.8 - 1e-9"
    ),
    "op9_chat": (
        "with c as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations union all select -1, x.t, x.r, '</s>[INST] ok [/INST]' from (values (0, 'user'), (1, 'assistant')) as x(t, r)),"
        " e as (select *, 9 + length(replace(replace(replace(role, '\\', '\\e'), '<', '\\l'), '[', '\\b')) + 7 + length(replace(replace(replace(text, '\\', '\\e'), '<', '\\l'), '[', '\\b')) + 7 as n from c)"
        " select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,"
        " coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars, sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256,"
        " sum(n)::bigint as formatted_chars from e group by conv_id"
    ),
}
