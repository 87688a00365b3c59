"""Reranking: features of a candidate pair, a probability, and the adaptive cut."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.functions.columns import all_numbers, compact, eid, raw_jaccard, src_of
from cairn.functions.similarity import jw

# Names that the reranker's features must have.
FEATURES = ["src", "rk", "score", "n_keys", "score_rel", "name_jw", "cmp_jw", "cmp_contains", "name_jacc", "addr_jacc", "num_shared", "s_nums", "t_nums", "t_addr_null", "pc_match"]


def sides(cand: DataFrame, s1: DataFrame, targets: DataFrame) -> DataFrame:
    """Candidates with both records' columns, as s_* and t_*."""
    cols = ["name_v2", "name_core", "addr_v2", "postcode"]
    s = s1.select(eid("entity_id").alias("s1_id"), "country_key", *[F.col(c).alias(f"s_{c}") for c in cols])
    t = targets.select(eid("entity_id").alias("tgt_id"), *[F.col(c).alias(f"t_{c}") for c in cols])
    return cand.join(s, "s1_id").join(t, "tgt_id")


def contains_either(a: Column, b: Column) -> Column:
    x, y = compact(a), compact(b)
    return ((F.length(a) > 2) & (F.length(b) > 2) & (F.contains(x, y) | F.contains(y, x))).cast("int")


def postcode_match(a: Column | str, b: Column | str) -> Column:
    x, y = (F.col(c) if isinstance(c, str) else c for c in (a, b))
    return F.when(x.isNull() | y.isNull(), -1).when(x == y, 1).otherwise(0)


def features(cand: DataFrame, s1: DataFrame, targets: DataFrame) -> DataFrame:
    """(s1_id, tgt_id) and FEATURES. Missing texts are empty; score_rel is relative to the S1's best of the source."""
    r = sides(cand, s1, targets).withColumn("src", src_of("tgt_id"))
    r = r.withColumns({f"{x}_core": F.coalesce(f"{x}_name_core", F.lit("")) for x in "st"})
    r = r.withColumns({"name_jw": jw(F.col("s_core"), F.col("t_core")), "cmp_jw": jw(compact("s_core"), compact("t_core"))})
    s_num, t_num = all_numbers("s_addr_v2"), all_numbers("t_addr_v2")
    return r.select(
        "s1_id", "tgt_id", "src", "rk", "score", "n_keys",
        (F.col("score") / F.max("score").over(Window.partitionBy("s1_id", "src"))).alias("score_rel"),
        "name_jw", "cmp_jw",
        contains_either(F.col("s_core"), F.col("t_core")).alias("cmp_contains"),
        raw_jaccard("s_name_core", "t_name_core").alias("name_jacc"),
        raw_jaccard("s_addr_v2", "t_addr_v2").alias("addr_jacc"),
        F.size(F.array_intersect(s_num, t_num)).alias("num_shared"),
        F.size(s_num).alias("s_nums"), F.size(t_num).alias("t_nums"),
        F.col("t_addr_v2").isNull().cast("int").alias("t_addr_null"),
        postcode_match("s_postcode", "t_postcode").alias("pc_match"),
    )


def fixed_score(f: DataFrame) -> DataFrame:
    """A stand-in for a trained model: p is a fixed weighting of four features, rounded at 6 places."""
    p = 0.4 * F.col("name_jw") + 0.3 * F.col("addr_jacc") + 0.2 * F.col("score_rel") + 0.1 * (F.col("num_shared") > 0).cast("double")
    return f.withColumn("p", F.round(p, 6))


def cut(scored: DataFrame, tau: float = 0.01, cap: int = 5) -> DataFrame:
    """(s1_id, tgt_id, src, p, rk2): at most cap per S1 and source, p >= tau; ties of p to smaller targets."""
    rank = F.row_number().over(Window.partitionBy("s1_id", "src").orderBy(F.col("p").desc(), "tgt_id"))
    r = scored.withColumn("rk2", rank.cast("long")).where((F.col("rk2") <= cap) & (F.col("p") >= tau))
    return r.select("s1_id", "tgt_id", "src", "p", "rk2")
