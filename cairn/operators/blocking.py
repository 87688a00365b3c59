"""Candidate generation: combined keys of rare tokens, exact and affix keys, capped blocks, top candidates per source.

Keys tables have entity_id, country_key, name_v2, name_core, addr_v2, postcode. All joins hold within a country, which
is an ordinary key column; block sizes are counted, with partial sums, before any block is joined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.functions.columns import compact, eid, first_number, key_tokens, src_of, tagged, tokens
from cairn.stages import Keep, lazy


def token_stream(keys: DataFrame) -> DataFrame:
    """(country_key, id, f, tok): name tokens n and address tokens a, from one scan."""
    pairs = [tagged("f", f, F.coalesce(key_tokens(c), F.array().cast("array<string>"))) for f, c in (("n", "name_core"), ("a", "addr_v2"))]
    return keys.select("country_key", eid("entity_id").alias("id"), F.inline(F.concat(*pairs)))


def vocabulary(s1: DataFrame) -> DataFrame:
    return token_stream(s1).select("country_key", "f", "tok").distinct()


def token_df(targets: DataFrame, s1: DataFrame) -> DataFrame:
    """Of tokens that S1 has: in how many targets."""
    on = ["country_key", "f", "tok"]
    return token_stream(targets).join(vocabulary(s1), on, "left_semi").groupBy(*on).agg(F.count("*").alias("df"))


def rare_tokens(keys: DataFrame, df: DataFrame, name_top: int = 3, addr_top: int = 4) -> DataFrame:
    """(country_key, id, ns, ad): each record's rarest name and address tokens, by (df, token)."""
    rank = F.row_number().over(Window.partitionBy("country_key", "id", "f").orderBy("df", "tok"))
    top = token_stream(keys).join(df, ["country_key", "f", "tok"]).withColumn("n", rank)
    top = top.where(F.col("n") <= F.when(F.col("f") == "n", name_top).otherwise(addr_top))

    def of(f: str) -> Column:
        both = F.array_sort(F.collect_list(F.when(F.col("f") == f, F.struct("n", "tok"))))
        return F.transform(both, lambda x: x["tok"])

    return top.groupBy("country_key", "id").agg(of("n").alias("ns"), of("a").alias("ad"))


def _pairs(tag: str, a: str, b: str) -> Column:
    def row(x: Column) -> Column:
        other = F.col(b) if a != b else F.filter(F.col(b), lambda y: x < y)
        return F.transform(other, lambda y: F.concat_ws("|", F.lit(tag), x, y))

    return F.flatten(F.transform(F.col(a), row))


def record_keys(keys: DataFrame, rare: DataFrame) -> DataFrame:
    """(country_key, id, key): all distinct keys of a record; one array, exploded once."""
    base = keys.select("country_key", eid("entity_id").alias("id"), "name_core", "addr_v2", compact("name_core").alias("cmp"))
    r = base.join(rare, ["country_key", "id"], "left")
    num, none = first_number("addr_v2"), F.array().cast("array<string>")
    size = F.length("cmp")

    def key(tag: str, *parts: Column) -> Column:
        return F.concat_ws("|", F.lit(tag), *parts)

    exact = F.array(key("core", F.col("name_core")), key("cmp", F.col("cmp")), key("srt", F.array_join(F.array_sort(tokens("name_core")), " ")))
    six = F.array(key("p6", F.left("cmp", F.lit(6)), num), key("s6", F.right("cmp", F.lit(6)), num))
    eight = F.array(key("p8", F.left("cmp", F.lit(8))), key("s8", F.right("cmp", F.lit(8))))
    named = F.col("name_core").isNotNull()
    every = F.concat(
        *[F.coalesce(_pairs(t, a, b), none) for t, a, b in (("na", "ns", "ad"), ("nn", "ns", "ns"), ("aa", "ad", "ad"))],
        *[F.when(cond, a).otherwise(none) for cond, a in ((named, exact), (named & (size >= 6), six), (named & (size >= 10), eight))],
    )
    return r.select("country_key", "id", F.explode(F.array_distinct(every)).alias("key"))


def block_sizes(target_keys: DataFrame, key_cap: int = 300) -> DataFrame:
    """(country_key, key, df) of blocks that are not over the cap; S2 and S3 count together."""
    return target_keys.groupBy("country_key", "key").agg(F.count("*").alias("df")).where(F.col("df") <= key_cap)


def keys_of(s1: DataFrame, targets: DataFrame, s1_ids: DataFrame | None = None, name_top: int = 3, addr_top: int = 4, keep: Keep = lazy) -> tuple[DataFrame, DataFrame]:
    """Keys of S1 (of all or of s1_ids.s1_id) and of targets, the latter only where S1 has the key.

    keep writes the token counts and both key tables."""
    df = keep(token_df(targets, s1), "token-df")
    some = s1 if s1_ids is None else s1.join(s1_ids.select(F.col("s1_id").alias("__id")).distinct(), eid("entity_id") == F.col("__id"), "left_semi")
    s = keep(record_keys(some, rare_tokens(some, df, name_top, addr_top)), "s1-keys")
    t = record_keys(targets, rare_tokens(targets, df, name_top, addr_top))
    return s, keep(t.join(s.select("country_key", "key").distinct(), ["country_key", "key"], "left_semi"), "target-keys")


def score_candidates(s_keys: DataFrame, t_keys: DataFrame, key_cap: int = 300, k_max: int = 50) -> DataFrame:
    """(s1_id, tgt_id, score, n_keys, rk): sums of ln(10^7 / block size) over shared keys, rounded at 9 places so that
    ties don't hang on the order of sums; the k_max best per S1 and source, ties to smaller targets."""
    w = block_sizes(t_keys, key_cap)
    s = s_keys.withColumnRenamed("id", "s1_id")
    t = t_keys.withColumnRenamed("id", "tgt_id").join(w, ["country_key", "key"])
    both = s.join(t, ["country_key", "key"]).groupBy("s1_id", "tgt_id")
    c = both.agg(F.round(F.sum(F.log(F.lit(1e7) / F.col("df"))), 9).alias("score"), F.count("*").alias("n_keys"))
    rank = F.row_number().over(Window.partitionBy("s1_id", src_of("tgt_id")).orderBy(F.col("score").desc(), "tgt_id"))
    return c.withColumn("rk", rank.cast("long")).where(F.col("rk") <= k_max)


def run_blocking(s1: DataFrame, targets: list[DataFrame], s1_ids: DataFrame | None = None, name_top: int = 3, addr_top: int = 4, key_cap: int = 300, k_max: int = 50, keep: Keep = lazy) -> DataFrame:
    every = targets[0]
    for t in targets[1:]:
        every = every.unionByName(t)
    return keep(score_candidates(*keys_of(s1, every, s1_ids, name_top, addr_top, keep), key_cap, k_max), "candidates")


def exact_key_blocking(s1: DataFrame, targets: DataFrame, cap: int = 200) -> DataFrame:
    """Baseline: pairs that share a whole name or address; blocks over the cap are left out."""
    parts = []
    for c in ("name_v2", "addr_v2"):
        t = targets.where(F.col(c).isNotNull()).select("country_key", F.col(c).alias("k"), eid("entity_id").alias("tgt_id"))
        big = t.groupBy("country_key", "k").count().where(F.col("count") > cap)
        s = s1.where(F.col(c).isNotNull()).select("country_key", F.col(c).alias("k"), eid("entity_id").alias("s1_id"))
        parts.append(s.join(t.join(big, ["country_key", "k"], "left_anti"), ["country_key", "k"]).select("s1_id", "tgt_id"))
    return parts[0].union(parts[1]).distinct()


def token_idf_blocking(s1: DataFrame, targets: DataFrame, df_cap: int = 1000, k_max: int = 50) -> DataFrame:
    """Baseline: pairs that share a name token of at most df_cap targets, scored by summed idf."""
    tok = lambda d, i: d.select("country_key", eid("entity_id").alias(i), F.explode(tokens("name_core")).alias("tok"))
    n = targets.groupBy("country_key").agg(F.count("*").alias("n"))
    t = tok(targets, "tgt_id")
    w = t.groupBy("country_key", "tok").agg(F.count("*").alias("df")).where(F.col("df") <= df_cap)
    w = w.join(n, "country_key").select("country_key", "tok", F.log(F.col("n") / F.col("df")).alias("idf"))
    c = tok(s1, "s1_id").join(t.join(w, ["country_key", "tok"]), ["country_key", "tok"])
    c = c.groupBy("s1_id", "tgt_id").agg(F.round(F.sum("idf"), 9).alias("score"), F.count("*").alias("n_tokens"))
    rank = F.row_number().over(Window.partitionBy("s1_id", src_of("tgt_id")).orderBy(F.col("score").desc(), "tgt_id"))
    return c.withColumn("rk", rank.cast("long")).where(F.col("rk") <= k_max)


def evaluate(cand: DataFrame, s1: DataFrame, pairs: DataFrame) -> DataFrame:
    """Pair recall, S1 coverage, the ceiling of F0.5 and candidates per S1 (mean, median, 99th percentile, largest).

    s1 has s1_id, pairs s1_id and tgt_id."""
    nt = pairs.groupBy("s1_id").agg(F.count("*").alias("nt"))
    h = pairs.join(cand.select("s1_id", "tgt_id"), ["s1_id", "tgt_id"], "left_semi").groupBy("s1_id").agg(F.count("*").alias("h"))
    nc = cand.groupBy("s1_id").agg(F.count("*").alias("nc"))
    e = s1.select("s1_id").join(nt, "s1_id", "left").join(h, "s1_id", "left").join(nc, "s1_id", "left").na.fill(0)
    r = F.col("h") / F.col("nt")
    top = F.when(F.col("nt") == 0, 1.0).when(F.col("h") == 0, 0.0).otherwise(1.25 * r / (0.25 + r))
    six = lambda x: F.round(x, 6)
    return e.agg(
        F.count("*").alias("n_s1"),
        six(F.try_divide(F.sum("h"), F.sum("nt"))).alias("pair_recall"),
        six(F.avg((F.col("nc") > 0).cast("double"))).alias("s1_coverage"),
        six(F.avg(top)).alias("ceiling_f05"),
        six(F.avg("nc")).alias("avg_cand"),
        F.median("nc").alias("median_cand"),
        six(F.percentile("nc", F.lit(0.99))).alias("p99_cand"),
        F.max("nc").alias("max_cand"),
    )
