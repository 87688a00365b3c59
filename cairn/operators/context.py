"""Tables around the candidates: competition for a target, token idf, raw names, token log-odds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairn.functions.columns import eid, tagged, tokens


def competition(cut: DataFrame) -> DataFrame:
    """cut with rev_rk (rank of the S1 for its target), n_claim, tgt_max_p, tgt_second_p (0 if there is no second).

    cut must hold every S1's candidates."""
    w = Window.partitionBy("tgt_id")
    order = w.orderBy(F.col("p").desc(), "s1_id")
    return cut.select(
        "*",
        F.row_number().over(order).cast("long").alias("rev_rk"),
        F.count("*").over(w).alias("n_claim"),
        F.max("p").over(w).alias("tgt_max_p"),
        F.coalesce(F.nth_value("p", 2).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)), F.lit(0.0)).alias("tgt_second_p"),
    )


def idf(keys: DataFrame, column: str) -> DataFrame:
    """(c, tok, idf): ln(records of the country / records with the token)."""
    n = keys.groupBy(F.col("country_key").alias("c")).agg(F.count("*").alias("n"))
    t = keys.select(F.col("country_key").alias("c"), F.explode(tokens(column)).alias("tok")).groupBy("c", "tok").agg(F.count("*").alias("df"))
    return t.join(n, "c").select("c", "tok", F.log(F.col("n") / F.col("df")).alias("idf"))


def raw_names(raw: DataFrame) -> DataFrame:
    return raw.select(eid("entity_id").alias("id"), F.col("business_name").alias("raw"))


def token_odds(labelled: DataFrame, min_p: float = 0.3, alpha: float = 1.0, least: int = 5) -> DataFrame:
    """(kind, tok, lo, n): log-odds that a name token which the target adds (or drops) goes with a true pair.

    labelled: s_name_v2, t_name_v2, p, y; rows of true pairs or p >= min_p count; tokens of fewer than least rows go."""
    ev = labelled.where((F.col("y") == 1) | (F.col("p") >= min_p))
    s, t = (F.coalesce(tokens(c), F.array().cast("array<string>")) for c in ("s_name_v2", "t_name_v2"))
    kinds = [tagged("kind", k, F.array_except(a, b)) for k, a, b in (("add", t, s), ("drop", s, t))]
    rows = ev.select("y", F.inline(F.concat(*kinds)))
    tot = ev.agg(F.sum("y").alias("n1"), F.sum(1 - F.col("y")).alias("n0"))
    g = rows.groupBy("kind", "tok").agg(F.sum("y").alias("a"), F.sum(1 - F.col("y")).alias("b"), F.count("*").alias("n")).where(F.col("n") >= least)
    lo = F.log((F.col("a") + alpha) / (F.col("n1") + alpha)) - F.log((F.col("b") + alpha) / (F.col("n0") + alpha))
    return g.join(F.broadcast(tot)).select("kind", "tok", lo.alias("lo"), "n")  # tot is one row
