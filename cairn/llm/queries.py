"""The thin queries opN_<name>: each applies its operator, with production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cairn.llm import ann, langid, mixing, pii, quality, sentences, simhash, sst, topk, warc


#: For tables that hold no real person's data, where no key is configured: with it anyone can go back.
OPEN_KEY = b"a key that everyone knows"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op2_threshold_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.exact_top_k(table(spark, sf_dir, "embeddings"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = warc.archive(table(spark, sf_dir, "pages"))
    return rows.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_feistel_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.pseudonymise_docs(docs, pii.key_of(spark, OPEN_KEY), count="n_values")


def op5_sentencepiece(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    return sentences.round_trip(table(spark, sf_dir, "documents"), sentences.Model.load(path or tokenizer_path("piece_bpe_32k.model")))


def op6_collision_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.scores(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op9_token_shards(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    with open(path or tokenizer_path("byte_bpe_50k.json"), encoding="utf-8") as f:
        return sst.token_shards(table(spark, sf_dir, "documents"), f.read())


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.predict(docs, langid.train(docs))


def queries() -> dict:
    return {k: f for k, f in globals().items() if k.startswith("op") and k[2].isdigit()}


def oracle_sql() -> dict[str, str]:
    return ORACLES


#: Base32 of a SHA-1: five hexadecimal digits are four letters.
_BASE32 = """array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + cast(
  (cast('0x' || substr(sha, 1 + 5 * (i // 4), 5) as bigint) >> (15 - 5 * (i % 4))) & 31 as integer), 1)), '')"""

ORACLES = {
    "op2_threshold_top_k": """
with v as (select vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) e from embeddings
  where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.vec_id query_id, c.vec_id, cast(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) as bigint) score
  from v q join v c on q.vec_id % 50 = 0 and q.vec_id <> c.vec_id)
select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank, vec_id, score
from s qualify rank <= 5""",
    "op3_warc": f"""
with p as (select page_id, coalesce(html, '') t, sha1(coalesce(html, '')) sha from pages),
m as (select page_id, cast(strlen(t) as bigint) n, sha, max(page_id) over (partition by sha) top from p)
select page_id, n as payload_bytes, {_BASE32} as payload_digest,
  case when page_id is not distinct from top then 'response' else 'revisit' end as record_type,
  case when page_id is not distinct from top then null else top end as refers_to
from m""",
}
