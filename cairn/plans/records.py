"""A linkage problem derived from the documents table: S1 entities, their noisy copies as S2 and S3, and unowned rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.functions.columns import eid
from cairn.stages import Keep, lazy


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: At most nine words from a text's begin; possessive, so that nothing behind them is read.
NINE = r"^[ \n\t\r]*+((?:[^ \n\t\r]++[ \n\t\r]++){0,8}[^ \n\t\r]*+)"


def words(docs: DataFrame, whole: bool = False) -> DataFrame:
    """(doc_id, lang, g, ws): the group key of a document, its first 60 characters' letters, and its first nine words, or all."""
    text = F.regexp_replace("text", "[ \n\t\r]+", " ") if whole else F.regexp_replace(F.regexp_extract("text", NINE, 1), "[ \n\t\r]+", " ")
    g = F.regexp_replace(F.lower(F.left("text", F.lit(60))), "[^a-z]+", "")
    return docs.select("doc_id", "lang", g.alias("g"), F.filter(F.split(text, " "), lambda x: x != "").alias("ws"))


def records(spark: SparkSession, sf_dir: str, whole: bool = False, keep: Keep = lazy) -> DataFrame:
    """entity_id, business_name, business_address, country, owner.

    A name is the text's first four words and an address the next five; whole: the whole text, and all from the fifth word.
    With keep documents are scanned once; groups of one key are joined as written tables, so that adaptive plans can split them."""
    w = keep(words(table(spark, sf_dir, "documents"), whole), "words")
    first = keep(w.groupBy(F.col("lang").alias("l"), F.col("g").alias("h")).agg(F.min("doc_id").alias("m"), F.count("*").alias("n")), "groups")
    r = w.join(first, F.col("lang").eqNullSafe(F.col("l")) & F.col("g").eqNullSafe(F.col("h")))
    size = lambda i: F.length(F.coalesce(F.try_element_at("ws", F.lit(i)), F.lit("")))
    name, rest = (F.col("ws"), F.slice("ws", F.lit(5), F.greatest(F.size("ws"), F.lit(0)))) if whole else (F.slice("ws", 1, 4), F.slice("ws", 5, 5))
    own = F.when((F.col("doc_id") == F.col("m")) & ~((F.col("n") == 1) & (F.col("doc_id") % 5 == 0)), "S1-").when(F.col("doc_id") % 2 == 0, "S2-").otherwise("S3-")
    return r.select(
        F.concat(own, F.col("doc_id").cast("string")).alias("entity_id"),
        F.array_join(name, " ").alias("business_name"),
        F.concat(((size(5) * 37 + size(6)) % 500 + 1).cast("string"), F.lit(" "), F.array_join(rest, " ")).alias("business_address"),
        F.col("lang").alias("country"),
        F.when(F.col("n") > 1, F.concat(F.lit("S1-"), F.col("m").cast("string"))).alias("owner"),
    )


def ascii_keys(rec: DataFrame) -> DataFrame:
    """Keys that SQL can make too: lower-case ASCII names and addresses; a three-digit number stands for the postcode."""
    plain = lambda c: F.nullif(F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " ")), F.lit(""))
    name, addr = plain("business_name"), plain("business_address")
    pc = F.nullif(F.regexp_extract(addr, "([0-9]{3})", 1), F.lit(""))
    return rec.select("entity_id", F.lower("country").alias("country_key"), name.alias("name_v2"), name.alias("name_core"), addr.alias("addr_v2"), pc.alias("postcode"), "owner", "business_name", "business_address", "country")


def split(keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    s1 = F.col("entity_id").startswith("S1-")
    return keys.where(s1), keys.where(~s1)


def truth(rec: DataFrame) -> DataFrame:
    """(s1_id, tgt_id) of owned targets."""
    return rec.where(F.col("owner").isNotNull() & ~F.col("entity_id").startswith("S1-")).select(eid("owner").alias("s1_id"), eid("entity_id").alias("tgt_id"))
