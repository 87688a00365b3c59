"""Audits of records, candidates and matches: small analytic tables that say where pairs are lost or won.

Pairs frames have s1_id and tgt_id; keys frames are those of blocking. Shares are averages of 0 and 1, not percents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.functions.columns import SOURCE_UNIT, compact, eid, jaccard, key_tokens, src_of, tokens
from cairn.functions.similarity import jw

ID = ["s1_id", "tgt_id"]


def share(condition: Column) -> Column:
    """How often a condition holds; null counts as no."""
    return F.avg(F.coalesce(condition, F.lit(False)).cast("double"))


def with_sides(pairs: DataFrame, keys: DataFrame, *columns: str) -> DataFrame:
    """pairs with columns of both records as s_* and t_*."""
    for side, on in (("s", "s1_id"), ("t", "tgt_id")):
        pairs = pairs.join(keys.select(eid("entity_id").alias(on), *[F.col(c).alias(f"{side}_{c}") for c in columns]), on)
    return pairs


def exact_rates(pairs: DataFrame, keys: DataFrame) -> DataFrame:
    """How often both names, and addresses, of a true pair are the same as written, without case and blanks, and as keys."""
    p = with_sides(pairs, keys, "business_name", "business_address", "name_v2", "addr_v2")
    fold = lambda c: F.lower(F.trim(c))
    out = []
    for what, raw, key in (("name", "business_name", "name_v2"), ("address", "business_address", "addr_v2")):
        s, t = F.col(f"s_{raw}"), F.col(f"t_{raw}")
        out += [share(s == t).alias(f"raw_{what}"), share(fold(s) == fold(t)).alias(f"folded_{what}"), share(F.col(f"s_{key}") == F.col(f"t_{key}")).alias(f"key_{what}")]
    return p.agg(F.count("*").alias("pairs"), *out)


def repeated_names(raw: DataFrame, n: int = 20) -> DataFrame:
    """The n most repeated names, without case; a report."""
    names = raw.select(F.lower(F.trim("business_name")).alias("name")).where("name <> ''").groupBy("name").agg(F.count("*").alias("records"))
    return names.where("records > 1").orderBy(F.col("records").desc(), "name").limit(n)


def corpus_profile(keys: DataFrame) -> DataFrame:
    """Of each source and country: what is missing, beyond ASCII, a placeholder, or has a postcode."""
    beyond = lambda c: share(F.col(c).rlike(r"[^\x00-\x7F]"))
    return keys.groupBy(src_of(eid("entity_id")).alias("src"), "country_key").agg(
        F.count("*").alias("n"), beyond("business_name").alias("name_beyond_ascii"), beyond("business_address").alias("addr_beyond_ascii"),
        share(F.col("name_v2").isNull()).alias("name_null"), share(F.col("addr_v2").isNull()).alias("addr_null"),
        share(F.col("postcode").isNotNull()).alias("postcode"), share(F.lower("business_address").rlike(r"<\s*null\s*>")).alias("addr_placeholder"),
    )


def token_sharing(pairs: DataFrame, keys: DataFrame) -> DataFrame:
    """What true pairs share, by source of the target and country: bounds on what any key of that kind can find."""
    p = with_sides(pairs, keys, "country_key", "name_core", "addr_v2", "postcode")
    common = {c: F.coalesce(F.arrays_overlap(key_tokens(f"s_{c}"), key_tokens(f"t_{c}")), F.lit(False)) for c in ("name_core", "addr_v2")}
    both = F.col("s_postcode").isNotNull() & F.col("t_postcode").isNotNull()
    return p.groupBy(src_of("tgt_id").alias("src"), F.col("s_country_key").alias("country")).agg(
        F.count("*").alias("pairs"), share(F.col("s_name_core") == F.col("t_name_core")).alias("name_exact"),
        share(common["name_core"]).alias("name_token"), share(common["addr_v2"]).alias("addr_token"),
        share(~common["name_core"] & ~common["addr_v2"]).alias("nothing"),
        F.avg(F.when(both, (F.col("s_postcode") == F.col("t_postcode")).cast("double"))).alias("postcode_when_both"),
    )


def recall_at(pairs: DataFrame, cand: DataFrame, keys: DataFrame, ks: tuple[int, ...] = (5, 20, 50)) -> DataFrame:
    """Share of the true pairs among an S1's k best candidates, by country and source."""
    land = keys.select(eid("entity_id").alias("s1_id"), F.col("country_key").alias("country"))
    p = pairs.join(cand.select(*ID, "rk"), ID, "left").join(land, "s1_id")
    return p.groupBy("country", src_of("tgt_id").alias("src")).agg(F.count("*").alias("pairs"), *[share(F.col("rk") <= k).alias(f"at_{k}") for k in ks])


def missed(pairs: DataFrame, cand: DataFrame, k: int = 5) -> DataFrame:
    """True pairs that are no candidates or rank below k, with kind."""
    m = pairs.join(cand.select(*ID, "rk"), ID, "left").where(F.col("rk").isNull() | (F.col("rk") > k))
    return m.withColumn("kind", F.when(F.col("rk").isNull(), "not retrieved").otherwise("ranked low")).drop("rk")


def miss_taxonomy(misses: DataFrame, keys: DataFrame) -> DataFrame:
    """Of missed pairs by kind: which simple keys both records have."""
    p = with_sides(misses, keys, "name_core")
    s, t = (F.coalesce(f"{x}_name_core", F.lit("")) for x in "st")
    a, b = compact(s), compact(t)
    bag = lambda c: F.array_join(F.array_sort(tokens(c)), " ")
    long = (F.length(a) >= 10) & (F.length(b) >= 10)
    same = {"core": s == t, "cmp": a == b, "srt": bag(s) == bag(t), "p8": long & (F.left(a, F.lit(8)) == F.left(b, F.lit(8))), "s8": long & (F.right(a, F.lit(8)) == F.right(b, F.lit(8)))}
    return p.groupBy("kind").agg(F.count("*").alias("n"), *[share(c).alias(k) for k, c in same.items()], share(same["core"] | same["cmp"] | same["srt"] | same["p8"] | same["s8"]).alias("any_key"))


def matches_per_source(pairs: DataFrame, s1: DataFrame) -> DataFrame:
    """(n_s2, n_s3, n_s1): how many S1 have that many true targets in each source."""
    n = pairs.groupBy("s1_id").agg(*[F.count_if(src_of("tgt_id") == k).alias(f"n_s{k}") for k in (2, 3)])
    return s1.select("s1_id").join(n, "s1_id", "left").na.fill(0).groupBy("n_s2", "n_s3").agg(F.count("*").alias("n_s1"))


def unowned_claimed(targets: DataFrame, pairs: DataFrame, cut: DataFrame, least: float = 0.5) -> DataFrame:
    """Targets that nobody owns, and the share of them that an S1 claims with at least that probability."""
    free = targets.select(eid("entity_id").alias("tgt_id")).join(pairs.select("tgt_id"), "tgt_id", "left_anti")
    claimed = cut.where(F.col("p") >= least).select("tgt_id", F.lit(True).alias("c")).distinct()
    return free.join(claimed, "tgt_id", "left").agg(F.count("*").alias("unowned"), share(F.col("c")).alias("claimed"))


def kinds(cut: DataFrame, pairs: DataFrame) -> DataFrame:
    """cut with kind (true, owned by another, unowned) and owner_id of the target."""
    own = pairs.select(F.col("s1_id").alias("owner_id"), "tgt_id")
    kind = F.when(F.col("owner_id") == F.col("s1_id"), "true").when(F.col("owner_id").isNull(), "unowned").otherwise("owned by another")
    return cut.join(own, "tgt_id", "left").withColumn("kind", kind)


def legal_crosstab(moves: DataFrame) -> DataFrame:
    """moves (kind, lf_*: a legal-form transition, one hot) -> per kind the share of each transition."""
    names = ("same", "dropped", "added", "subset", "changed")
    none = sum((F.col(f"lf_{n}") for n in names), F.lit(0)) == 0
    return moves.groupBy("kind").agg(F.count("*").alias("n"), share(none).alias("none"), *[share(F.col(f"lf_{n}") == 1).alias(n) for n in names])


def added_tokens(pairs: DataFrame, least: int = 15) -> DataFrame:
    """pairs (kind, s_name, t_name) -> tokens that only targets have: their rates in true and in unowned pairs, and the ratio.

    Tokens of fewer than least such pairs go."""
    own = pairs.where(F.col("kind").isin("true", "unowned"))
    size = own.agg(*[F.count_if(F.col("kind") == k).alias(k) for k in ("true", "unowned")])
    none = F.array().cast("array<string>")
    t = own.select("kind", F.explode(F.array_except(F.coalesce(tokens("t_name"), none), F.coalesce(tokens("s_name"), none))).alias("tok"))
    n = t.groupBy("tok").agg(F.count("*").alias("n"), *[F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in ("true", "unowned")]).where(F.col("n") >= least)
    rate = lambda k: F.coalesce(F.try_divide(f"n_{k}", k), F.lit(0.0))
    return n.join(F.broadcast(size)).select("tok", "n", rate("true").alias("rate_true"), rate("unowned").alias("rate_unowned"), ((rate("unowned") + 1e-4) / (rate("true") + 1e-4)).alias("ratio"))  # size is one row


def contested(owned: DataFrame, keys: DataFrame) -> DataFrame:
    """owned: kinds() of pairs whose target another S1 owns. Who is nearer to the target, the candidate or the owner?"""
    p = with_sides(owned.select(*ID, "owner_id"), keys, "name_core", "addr_v2")
    p = p.join(keys.select(eid("entity_id").alias("owner_id"), F.col("name_core").alias("o_name_core"), F.col("addr_v2").alias("o_addr_v2")), "owner_id")
    text = lambda c: F.coalesce(c, F.lit(""))
    p = p.withColumns({"cn": jw(text("t_name_core"), text("s_name_core")), "on": jw(text("t_name_core"), text("o_name_core"))})
    p = p.withColumns({"ca": F.coalesce(jaccard("t_addr_v2", "s_addr_v2"), F.lit(0.0)), "oa": F.coalesce(jaccard("t_addr_v2", "o_addr_v2"), F.lit(0.0))})
    nearer = {"owner_name": F.col("on") > F.col("cn") + 0.01, "cand_name": F.col("cn") > F.col("on") + 0.01, "owner_addr": F.col("oa") > F.col("ca") + 0.05, "cand_addr": F.col("ca") > F.col("oa") + 0.05}
    signal = nearer["owner_name"] | nearer["owner_addr"]
    return p.agg(
        F.count("*").alias("pairs"), share(text("s_name_core") == text("o_name_core")).alias("same_core"), *[share(c).alias(k) for k, c in nearer.items()],
        share(signal).alias("for_owner"), share(~(signal | nearer["cand_name"] | nearer["cand_addr"])).alias("no_signal"),
    )


def singletons(rev: DataFrame, pairs: DataFrame, s1: DataFrame) -> DataFrame:
    """Of S1 with and without true targets: the best candidate's probability, and whether another S1 claims it more."""
    best = F.row_number().over(Window.partitionBy("s1_id").orderBy(F.col("p").desc(), "tgt_id"))
    has = pairs.select("s1_id", F.lit(False).alias("singleton")).distinct()
    top = rev.withColumn("n", best).where("n = 1").join(s1.select("s1_id"), "s1_id").join(has, "s1_id", "left")
    return top.groupBy(F.coalesce("singleton", F.lit(True)).alias("singleton")).agg(
        F.count("*").alias("n"), F.avg("p").alias("top_p"), share(F.col("rev_rk") > 1).alias("owned_by_other"), F.avg(F.col("tgt_max_p") - F.col("p")).alias("gap")
    )


def country_health(s1: DataFrame, cut: DataFrame, matches: DataFrame) -> DataFrame:
    """Per country: candidates, matches, empty answers, and how sure the best candidate is."""
    c = cut.groupBy("s1_id").agg(F.count("*").alias("nc"), F.max("p").alias("best"), F.count_if(F.col("p") >= 0.5).alias("hi"))
    m = matches.groupBy("s1_id").agg(F.count("*").alias("nm"))
    e = s1.select(eid("entity_id").alias("s1_id"), F.col("country_key").alias("country")).join(c, "s1_id", "left").join(m, "s1_id", "left")
    zero = lambda x: F.coalesce(x, F.lit(0))
    return e.groupBy("country").agg(
        F.count("*").alias("n_s1"), F.avg(zero("nc")).alias("candidates"), F.avg(zero("nm")).alias("matches"), share(F.col("nm").isNull()).alias("empty"),
        F.avg(F.coalesce("best", F.lit(0.0))).alias("best"), share(F.col("best").between(0.3, 0.7)).alias("uncertain"), F.avg(zero("hi")).alias("over_half"),
    )


def outcome_profile(features: DataFrame, matches: DataFrame, pairs: DataFrame) -> DataFrame:
    """Candidate pairs with features, by outcome (TP, FN, FP): shares of what makes a pair hard."""
    f = features.join(pairs.withColumn("y", F.lit(True)), ID, "left").join(matches.select(*ID, F.lit(True).alias("m")), ID, "left")
    kind = F.when(F.col("y") & F.col("m"), "TP").when(F.col("y"), "FN").when(F.col("m"), "FP")
    hard = {
        "addr_missing": F.col("t_addr_null") == 1, "name_far": F.col("name_jw") < 0.7, "addr_far": F.coalesce("addr_jacc", F.lit(0.0)) < 0.3, "number_conflict": F.col("first_num_cmp") == 0,
        "contested": F.col("n_claim") > 1, "not_top": F.col("rev_rk") > 1, "from_s3": F.col("src") == 3, "unlikely": F.col("p") < 0.5,
    }
    return f.withColumn("outcome", kind).where(F.col("outcome").isNotNull()).groupBy("outcome").agg(F.count("*").alias("n"), *[share(c).alias(k) for k, c in hard.items()])


def sibling_proximity(misses: DataFrame, found: DataFrame, keys: DataFrame) -> DataFrame:
    """Of missed pairs by kind: how near they are to their S1, and how often near to a target that was found for it."""
    p = with_sides(misses, keys, "name_core", "addr_v2")
    text = lambda c: F.coalesce(c, F.lit(""))
    t = keys.select(eid("entity_id").alias("f_id"), F.col("name_core").alias("f_core"), F.col("addr_v2").alias("f_addr"))
    sib = p.join(found.select("s1_id", F.col("tgt_id").alias("f_id")), "s1_id").join(t, "f_id")
    sib = sib.withColumn("w", jw(text("t_name_core"), text("f_core"))).groupBy(*ID).agg(F.max("w").alias("w"), F.max(jaccard("t_addr_v2", "f_addr")).alias("a"))
    p = p.withColumn("own", jw(text("s_name_core"), text("t_name_core"))).join(sib, ID, "left")
    return p.groupBy("kind").agg(
        F.count("*").alias("n"), share(F.col("t_addr_v2").isNull()).alias("addr_missing"), share(F.col("s_name_core") == F.col("t_name_core")).alias("exact_core"), F.avg("own").alias("name_jw"),
        F.avg(F.coalesce(jaccard("s_addr_v2", "t_addr_v2"), F.lit(0.0))).alias("addr_jacc"), share((F.col("w") >= 0.92) | (F.col("a") >= 0.5)).alias("near_sibling"),
    )


def competitor_proximity(misses: DataFrame, rev: DataFrame, keys: DataFrame, sure: float = 0.9, margin: float = 0.02) -> DataFrame:
    """Of missed pairs whose target another S1 claims: is the target nearer to the sure targets of its S1 or of the strongest
    competitor?"""
    name = keys.select(eid("entity_id").alias("id"), F.coalesce("name_v2", F.lit("")).alias("name"))
    rival = rev.select("tgt_id", F.col("s1_id").alias("rival"), F.col("p").alias("rival_p")).join(misses.select(*ID), "tgt_id").where("rival <> s1_id")
    rival = rival.withColumn("n", F.row_number().over(Window.partitionBy("tgt_id").orderBy(F.col("rival_p").desc(), "rival"))).where("n = 1").select("tgt_id", "rival")
    p = misses.select(*ID).join(rival, "tgt_id")
    sure_of = rev.where(F.col("p") >= sure).select(F.col("s1_id").alias("who"), F.col("tgt_id").alias("other"))
    near = p.select(*ID, F.explode(F.array(F.struct(F.lit("own").alias("side"), F.col("s1_id").alias("who")), F.struct(F.lit("rival").alias("side"), F.col("rival").alias("who")))).alias("x"))
    near = near.select(*ID, "x.side", "x.who").join(sure_of, "who").where("other <> tgt_id")
    near = near.join(name.toDF("tgt_id", "a"), "tgt_id").join(name.toDF("other", "b"), "other").withColumn("w", jw(F.col("a"), F.col("b")))
    best = near.groupBy(*ID).agg(*[F.max(F.when(F.col("side") == s, F.col("w"))).alias(s) for s in ("own", "rival")])
    p = p.drop("rival").join(best, ID, "left").na.fill(0.0, ["own", "rival"])
    gap = F.col("own") - F.col("rival")
    return p.agg(F.count("*").alias("n"), share(gap > margin).alias("own_nearer"), share(gap < -margin).alias("rival_nearer"), share(F.abs(gap) <= margin).alias("tie"))


def leakage(pairs: DataFrame, keys: DataFrame) -> DataFrame:
    """Does an id or a place in its file give a pair away? Correlation of id numbers and of relative places, and how often two
    places agree to a thousandth."""
    place = keys.select(eid("entity_id").alias("id")).withColumn("src", src_of("id"))
    w = Window.partitionBy("src")
    place = place.select("id", (F.row_number().over(w.orderBy("id")) / F.count("*").over(w)).alias("at"))
    p = pairs.join(place.toDF("s1_id", "s_at"), "s1_id").join(place.toDF("tgt_id", "t_at"), "tgt_id")
    number = lambda c: F.col(c) % F.lit(SOURCE_UNIT)
    return p.agg(F.corr(number("s1_id"), number("tgt_id")).alias("number_corr"), F.corr("s_at", "t_at").alias("place_corr"), share(F.abs(F.col("s_at") - F.col("t_at")) < 0.001).alias("same_place"))


def rule_sweep(scored: DataFrame, s1: DataFrame, rules: list[tuple[float, float]], countries: list[str]) -> DataFrame:
    """Per rule (threshold, threshold of further matches) and country: matches per S1 and share of empty answers, one column
    each; all rules in one plan."""
    rule = F.array(*[F.struct(F.lit(f"{a}/{b}").alias("rule"), F.lit(a).alias("tau"), F.lit(b).alias("more")) for a, b in rules])
    d = scored.withColumn("r", F.explode(rule)).select("s1_id", "tgt_id", "q", "r.*").where(F.col("q") >= F.col("tau"))
    d = d.withColumn("n", F.row_number().over(Window.partitionBy("rule", "tgt_id").orderBy(F.col("q").desc(), "s1_id"))).where("n = 1")
    d = d.withColumn("n", F.row_number().over(Window.partitionBy("rule", "s1_id").orderBy(F.col("q").desc(), "tgt_id"))).where((F.col("n") == 1) | (F.col("q") >= F.col("more")))
    m = d.groupBy("rule", "s1_id").agg(F.count("*").alias("m"))
    every = s1.select(eid("entity_id").alias("s1_id"), F.col("country_key").alias("country")).withColumn("r", F.explode(rule)).select("s1_id", "country", "r.rule")
    e = every.join(m, ["rule", "s1_id"], "left").na.fill(0, ["m"])
    return e.groupBy("rule").pivot("country", countries).agg(F.avg("m").alias("matches"), F.avg((F.col("m") == 0).cast("double")).alias("empty"))
