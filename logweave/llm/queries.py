"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table


def op3_quality_perplexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_perplexity import judge

    return judge(read_table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("bits_per_char", 6).alias("bits_per_char")
    )


def op5_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash_dedup import simhash_groups

    return simhash_groups(read_table(spark, sf_dir, "documents"))


def op1_poisson_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix

    return mix(read_table(spark, sf_dir, "documents"))


def op2_hamming_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .hamming_topk import sign_codes, top_k

    codes = sign_codes(read_table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return top_k(codes, codes.where("id % 50 = 0"), k=10).select("query_id", "rank", F.col("id").alias("vec_id"), "distance")


def op4_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chat_format import conversation_digests, format_windows

    text = "</s>[INST] ok [/INST]"
    own = spark.range(2).select(F.lit(-7).cast("bigint").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(text).alias("text"))
    turns = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    return conversation_digests(format_windows(turns))


def op6_secret_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secret_scan import secret_report

    return secret_report(read_table(spark, sf_dir, "documents"))


def op7_sentencepiece_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .sp_sampling import sample_segmentations

    return sample_segmentations(read_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import language_report

    return language_report(read_table(spark, sf_dir, "documents"))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import uuid

    import public_tokenizers

    from .common import cut, shared_dir
    from .token_files import read_shards, remove_files, write_token_files

    folder = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    shards = write_token_files(read_table(spark, sf_dir, "documents"), folder, public_tokenizers.path("byte_bpe_50k.json"))
    out = cut(read_shards(shards, folder).withColumnRenamed("id", "doc_id"))
    remove_files(shards, folder)
    return out


def op10_paragraph_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .paragraph_dedup import repeated_text

    return repeated_text(read_table(spark, sf_dir, "documents"))


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .whitening import whiten

    return whiten(read_table(spark, sf_dir, "embeddings")).withColumn("deviation", F.col("deviation").cast("bigint"))


def op12_reversed_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .reversed_search import search

    return search(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op13_toxicity_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import toxicity_report

    return toxicity_report(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_poisson_mixing": op1_poisson_mixing,
        "op2_hamming_topk": op2_hamming_topk,
        "op3_quality_perplexity": op3_quality_perplexity,
        "op4_chat_windows": op4_chat_windows,
        "op5_simhash_dedup": op5_simhash_dedup,
        "op6_secret_ownership": op6_secret_ownership,
        "op7_sentencepiece_samples": op7_sentencepiece_samples,
        "op8_language_id": op8_language_id,
        "op9_token_files": op9_token_files,
        "op10_paragraph_dedup": op10_paragraph_dedup,
        "op11_embedding_whitening": op11_embedding_whitening,
        "op12_reversed_search": op12_reversed_search,
        "op13_toxicity_grammar": op13_toxicity_grammar,
    }


OP1_SQL = """
with sized as (
  select source, greatest(sum(coalesce(length(text), 0)), 1)::double as size from documents group by source
), weighted as (
  select source, size, pow(size, 0.5) as weight from sized
), rates as (
  select source, (weight / (select sum(weight) from weighted)) * (select sum(size) from weighted) / size as rate from weighted
), drawn as (
  select d.*, r.rate, ('0x' || substr(md5('count:7:' || coalesce(cast(doc_id as varchar), '')), 1, 13))::bigint / 4503599627370496.0 as u
  from documents d join rates r on d.source is not distinct from r.source
), pmf as (
  select source, j, exp(-rate + sum(case when j = 0 then 0.0 else ln(rate / greatest(j, 1)) end) over (partition by source order by j)) as p
  from rates, lateral (select unnest(generate_series(0, cast(ceil(rate + 12 * sqrt(rate) + 24) as bigint))) as j)
), steps as (
  select source, sum(p) over (partition by source order by j) as c from pmf
), counted as (
  select d.*, (select count(*) from steps s where s.source is not distinct from d.source and s.c <= d.u)::bigint as n_copies from drawn d
)
select doc_id, text, lang, source, n_chars, n_copies, unnest(generate_series(0::bigint, n_copies - 1))::bigint as copy
from counted where n_copies > 0
"""

OP2_SQL = """
with codes as (
  select vec_id, list_sum([case when embedding[i] > 0 then (1::hugeint << (i - 1)) else 0::hugeint end for i in generate_series(1, 64)])::hugeint as code
  from embeddings where embedding is not null and vec_id is not null
), scored as (
  select q.vec_id as query_id, b.vec_id, bit_count(xor(q.code, b.code))::bigint as distance
  from codes q, codes b where q.vec_id % 50 = 0
)
select query_id, row_number() over (partition by query_id order by distance, vec_id) as rank, vec_id, distance
from scored qualify rank <= 10
"""


#: The windows of op4 (budget 512, history 128), turn by turn; roles of the tables need no URL encoding.
OP4_SQL = r"""
with turns as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select * from (values (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]'))
), escaped as (
  select *, regexp_replace(regexp_replace(replace(text, '\', '\\'), '([<\[])(/?s>|/?INST\]|<?/?SYS>>|\|im_start\||\|im_end\|)', '\1\\\2', 'g'),
    '([<\[])(/?s>|/?INST\]|<?/?SYS>>|\|im_start\||\|im_end\|)', '\1\\\2', 'g') as e from turns
), formatted as (
  select conv_id, role, text, '<s>' || role || chr(10) || e || '</s>' || chr(10) as t, row_number() over (partition by conv_id order by turn nulls first, role, text) as pos from escaped
), counted as (
  select *, len(regexp_extract_all(t, '[A-Za-z0-9_]+|[^A-Za-z0-9_\x09-\x0D\x20]')) as tokens from formatted
), placed as (
  select *, tokens > 96 as alone, sum(tokens) over w - tokens as lo, count(*) filter (tokens > 96) over w - (tokens > 96)::int as before from counted
  window w as (partition by conv_id order by pos)
), per as (
  select conv_id, case when s > 0 and 2 * s <= 384 then first_other else 0 end as first_other, case when s > 0 and 2 * s <= 384 then s else 0 end as s, m from (
    select conv_id, min(pos) filter (role <> 'system') as first_other, min(lo) filter (role <> 'system') as s, coalesce(max(tokens) filter (not alone), 0) as m from placed group by conv_id)
), heads as (
  select *, case when s + new <= 512 then s else 0 end as held, least(128, greatest(512 - new - case when s + new <= 512 then s else 0 end, 0)) as past from (
    select p.conv_id, before, alone, case when alone then 0 else floor(lo / (384 - s - m)) end as cell, any_value(s) as s, any_value(first_other) as first_other,
      min(lo) as w_lo, min(pos) as w_pos, sum(tokens) as new, sum(length(t)) as chars
    from placed p join per using (conv_id) group by 1, 2, 3, 4)
), repeated as (
  select h.conv_id, sum(length(t)) as chars from heads h join placed p on p.conv_id = h.conv_id and p.pos < h.w_pos
    and ((h.held > 0 and p.role = 'system' and p.pos < h.first_other) or (h.past > 0 and p.lo >= h.w_lo - h.past and p.tokens <= 128)) group by h.conv_id
), sizes as (
  select conv_id, sum(chars) as chars, count(*) as n_windows from heads group by conv_id
), digests as (
  select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by pos)) as turns_sha256,
    coalesce(string_agg(text, '' order by pos) filter (role = 'assistant'), '') as loss from placed group by conv_id
)
select conv_id, n_turns, turns_sha256, length(loss) as loss_chars, sha256(loss) as loss_sha256, (s.chars + coalesce(r.chars, 0))::bigint as formatted_chars, n_windows
from digests join sizes s using (conv_id) left join repeated r using (conv_id)
"""


OP12_SQL = r"""
with words as (
  select row_number() over () as r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') as t
  from documents where text is not null
), docs as (
  select r, doc_id, t, len(t) as n from words where len(t) > 0
), totals as (
  select count(*)::bigint as nd, sum(n)::bigint as l from docs
), tf as (
  select r, t, count(*)::bigint as f from (select r, unnest(t) as t from docs) group by r, t
), weight as (
  select t, floor(1000 * ln((2 * (select nd from totals) + 2)::double / (2 * count(*) + 1)))::bigint as w from tf group by t
), items as (
  select row_number() over () as i, item_id, list_distinct(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+')) as ts
  from benchmark
), asked as (
  select i, item_id, unnest(ts) as t from items
), scored as (
  select i, item_id, r, doc_id, sum(w * ((1000000000 * f) // (1000 * f + 8 * (10 + (90 * n * nd) // l))))::bigint as score
  from asked join tf using (t) join weight using (t) join docs using (r), totals group by i, item_id, r, doc_id
)
select item_id, row_number() over (partition by i order by score desc, doc_id)::int as rank, doc_id, score from scored where score > 0 qualify rank <= 10
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_poisson_mixing": OP1_SQL, "op2_hamming_topk": OP2_SQL, "op4_chat_windows": OP4_SQL, "op12_reversed_search": OP12_SQL}
