"""Pair features for the matcher: 85 columns in four generations, all from candidates with their competition."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.functions import similarity as sim
from cairn.functions.columns import compact, compare3, first_number, jaccard, numbers, tagged, tokens
from cairn.functions.text import LEGAL_FORMS, skeleton
from cairn.operators.rerank import contains_either, postcode_match, sides
from cairn.stages import Keep, lazy

UNSEEN_IDF = 15.0
LEGAL = sorted(LEGAL_FORMS - {"and"})

# The words that announce another name, and the names of the features by generation.
ALIAS = r"\b(?:d/b/a|dba|doing business as|a/k/a|aka|also known as|f/k/a|fka|formerly known as|formerly|t/a|trading as|nee)\b"
V1 = [
    "src", "p", "rk2", "own_max_p", "own_sum_p", "own_n", "own_n_hi", "p_gap_own", "rev_rk", "n_claim", "tgt_max_p", "tgt_second_p", "other_best_p", "p_margin",
    "xs_name_jw", "xs_addr_jacc", "name_jw", "cmp_jw", "cmp_contains", "name_jacc", "first_tok_eq", "s_len", "t_len", "len_ratio", "tsort", "tset", "cmp_partial", "skel_ratio",
    "legal_cmp", "name_num_cmp", "addr_jacc", "addr_tset", "num_shared", "s_nums", "t_nums", "s_addr_null", "t_addr_null", "pc_match",
]
V2 = V1 + ["name_idf_jacc", "idf_shared", "idf_unshared_max", "name_n_unshared", "wratio", "cmp_lev", "cmp_prefix", "first_num_cmp", "addr_last_eq", "addr_jw", "addr_alpha_jacc"]
V3 = V2 + ["num_absdiff_log", "num_lev", "num_trunc", "xs_num_eq", "n_twins", "addr_rank", "name_rank", "t_dup_toks", "s_dup_toks"]
V4 = V3 + [
    "add_lo_max", "add_lo_min", "add_lo_sum", "n_added", "drop_lo_max", "drop_lo_min", "drop_lo_sum", "n_dropped", "lf_same", "lf_dropped", "lf_added", "lf_subset",
    "lf_changed", "addr_idf_shared", "addr_idf_jacc", "addr_idf_unshared_max", "t_all_caps", "t_mixed_case", "t_lower", "t_symbols", "s_all_caps", "raw_name_eq_ci",
    "raw_len_diff", "t_has_alias", "s_has_alias", "alias_best_tset", "alias_best_jw",
]

ID = ["s1_id", "tgt_id"]


def _text(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(""))


def base(rev: DataFrame, s1: DataFrame, targets: DataFrame) -> DataFrame:
    """rev with both records: s_core, t_core (cores), s_addr, t_addr (addresses), s_name, t_name, s_first, t_first (first numbers), ..."""
    j = sides(rev, s1, targets)
    return j.select(
        *rev.columns, F.col("country_key").alias("land"),
        _text("s_name_v2").alias("s_name"), _text("t_name_v2").alias("t_name"), _text("s_name_core").alias("s_core"), _text("t_name_core").alias("t_core"),
        _text("s_addr_v2").alias("s_addr"), _text("t_addr_v2").alias("t_addr"), first_number("s_addr_v2").alias("s_first"), first_number("t_addr_v2").alias("t_first"),
        F.col("s_addr_v2").isNull().cast("int").alias("s_addr_null"), F.col("t_addr_v2").isNull().cast("int").alias("t_addr_null"),
        F.col("s_postcode").alias("s_post"), F.col("t_postcode").alias("t_post"),
    )


def own_context(j: DataFrame) -> DataFrame:
    w = Window.partitionBy("s1_id")
    rival = F.when(F.col("rev_rk") == 1, F.col("tgt_second_p")).otherwise(F.col("tgt_max_p"))
    j = j.withColumns({"own_max_p": F.max("p").over(w), "own_sum_p": F.sum("p").over(w), "own_n": F.count("*").over(w), "own_n_hi": F.count_if(F.col("p") >= 0.5).over(w)})
    return j.withColumns({"p_gap_own": F.col("p") - F.col("own_max_p"), "other_best_p": rival, "p_margin": F.col("p") - rival})


def cluster(j: DataFrame) -> DataFrame:
    """(s1_id, tgt_id, xs_name_jw, xs_addr_jacc, xs_num_eq, n_twins): an S1's other candidates; one self-join."""
    a = j.select("s1_id", "tgt_id", F.col("t_core").alias("a_n"), F.nullif("t_addr", F.lit("")).alias("a_a"), F.col("t_first").alias("a_1"))
    b = j.select("s1_id", F.col("tgt_id").alias("b_id"), F.col("p").alias("b_p"), F.col("t_core").alias("b_n"), F.nullif("t_addr", F.lit("")).alias("b_a"), F.col("t_first").alias("b_1"))
    x = a.join(b, "s1_id").where("tgt_id <> b_id").withColumn("w", sim.jw(F.col("a_n"), F.col("b_n")))
    hi = F.col("b_p") >= 0.5
    same = ((F.col("a_1") != "") & (F.col("a_1") == F.col("b_1"))).cast("int")
    return x.groupBy(*ID).agg(
        F.max(F.when(hi, F.col("w"))).alias("xs_name_jw"), F.max(F.when(hi, jaccard("a_a", "b_a"))).alias("xs_addr_jacc"),
        F.coalesce(F.max(F.when(hi, same)), F.lit(-1)).alias("xs_num_eq"), F.count_if(F.col("w") >= 0.95).alias("n_twins"),
    )


def name_features(j: DataFrame) -> DataFrame:
    big, small = F.greatest(F.length("s_core"), F.length("t_core")), F.least(F.length("s_core"), F.length("t_core"))
    j = j.withColumns({"name_jw": sim.jw(F.col("s_core"), F.col("t_core")), "cmp_jw": sim.jw(compact("s_core"), compact("t_core"))})
    longest = F.greatest(F.length(compact("s_core")), F.length(compact("t_core")))
    return j.withColumns({
        "cmp_contains": contains_either(F.col("s_core"), F.col("t_core")), "name_jacc": jaccard("s_core", "t_core"),
        "first_tok_eq": (F.split_part("s_core", F.lit(" "), F.lit(1)) == F.split_part("t_core", F.lit(" "), F.lit(1))).cast("int"),
        "s_len": F.length("s_core"), "t_len": F.length("t_core"), "len_ratio": F.when(big > 0, small / big).otherwise(0.0),
        "cmp_lev": F.when(longest > 0, 1 - F.levenshtein(compact("s_core"), compact("t_core")) / longest).otherwise(1.0),
        "name_rank": F.rank().over(Window.partitionBy("s1_id").orderBy(F.col("name_jw").desc())).cast("long"),
        "t_dup_toks": _repeats("t_name"), "s_dup_toks": _repeats("s_name"),
        "name_num_cmp": compare3(numbers("s_name"), numbers("t_name")), "legal_cmp": compare3(_legal("s_name"), _legal("t_name")),
    })


def _repeats(c: str) -> Column:
    return F.when(F.col(c) == "", 0).otherwise(F.size(F.split(c, " ")) - F.size(tokens(c)))


def _legal(c: str) -> Column:
    return F.filter(F.split(c, " "), lambda t: t.isin(LEGAL))


def legal_transition(j: DataFrame) -> DataFrame:
    """lf_*: one of same, dropped, added, subset, changed, for the legal forms in order; none if neither has one."""
    a, b = _legal("s_name"), _legal("t_name")
    x, y = F.array_distinct(a), F.array_distinct(b)
    inside = lambda p, q: (F.size(F.array_except(p, q)) == 0) & (F.size(p) < F.size(q))
    kind = F.when((F.size(a) == 0) & (F.size(b) == 0), "none").when(a == b, "same").when(F.size(b) == 0, "dropped").when(F.size(a) == 0, "added")
    j = j.withColumn("lf", kind.when(inside(x, y) | inside(y, x), "subset").otherwise("changed"))
    return j.withColumns({f"lf_{k}": (F.col("lf") == k).cast("int") for k in ("same", "dropped", "added", "subset", "changed")}).drop("lf")


def address_features(j: DataFrame) -> DataFrame:
    alpha = lambda c: F.regexp_replace(c, "[0-9]+", "")
    last = lambda c: F.element_at(F.split(c, " "), -1)
    j = j.withColumn("addr_jw", sim.jw(F.col("s_addr"), F.col("t_addr")))
    return j.withColumns({
        "addr_jacc": jaccard("s_addr", "t_addr"), "addr_alpha_jacc": jaccard(alpha("s_addr"), alpha("t_addr")),
        "addr_last_eq": F.when((F.col("s_addr") == "") | (F.col("t_addr") == ""), -1).when(last("s_addr") == last("t_addr"), 1).otherwise(0),
        "addr_rank": F.rank().over(Window.partitionBy("s1_id").orderBy(F.col("addr_jw").desc())).cast("long"),
        "pc_match": postcode_match("s_post", "t_post"),
    })


def number_features(j: DataFrame) -> DataFrame:
    s, t = F.col("s_first"), F.col("t_first")
    none = (s == "") | (t == "")
    part = (s != t) & (s.startswith(t) | t.startswith(s) | s.endswith(t) | t.endswith(s))
    gap = F.abs(F.expr("try_cast(s_first AS double)") - F.expr("try_cast(t_first AS double)"))
    return j.withColumns({
        "num_shared": F.size(F.array_intersect(numbers("s_addr"), numbers("t_addr"))), "s_nums": F.size(numbers("s_addr")), "t_nums": F.size(numbers("t_addr")),
        "first_num_cmp": F.when(none, -1).when(s == t, 1).otherwise(0), "num_absdiff_log": F.when(~none, F.log(1 + gap)),
        "num_lev": F.when(~none, F.levenshtein(s, t)), "num_trunc": F.when(none, -1).when(part, 1).otherwise(0),
    })


def idf_overlap(j: DataFrame, table: DataFrame, s: str, t: str, prefix: str) -> DataFrame:
    """(s1_id, tgt_id, shared, jacc, unshared_max, n_unshared): idf mass of tokens on both sides and on one."""
    x, y = tokens(s), tokens(t)
    tk = j.select(*ID, F.col("land").alias("c"), F.explode(F.array_union(x, y)).alias("tok"), x.alias("x"), y.alias("y"))
    tk = tk.withColumn("shared", F.array_contains("x", F.col("tok")) & F.array_contains("y", F.col("tok"))).drop("x", "y")
    v = F.coalesce("idf", F.lit(UNSEEN_IDF))
    g = tk.join(table, ["c", "tok"], "left").groupBy(*ID).agg(
        F.coalesce(F.sum(F.when(F.col("shared"), v)), F.lit(0.0)).alias("a"), F.sum(v).alias("b"),
        F.coalesce(F.max(F.when(~F.col("shared"), v)), F.lit(0.0)).alias("m"), F.count_if(~F.col("shared")).alias("n"),
    )
    p = {"name": ("idf_shared", "name_idf_jacc", "idf_unshared_max", "name_n_unshared"), "addr": ("addr_idf_shared", "addr_idf_jacc", "addr_idf_unshared_max", "addr_n_unshared")}[prefix]
    return g.select(*ID, F.col("a").alias(p[0]), F.try_divide("a", "b").alias(p[1]), F.col("m").alias(p[2]), F.col("n").alias(p[3]))


def odds_features(j: DataFrame, odds: DataFrame) -> DataFrame:
    """(s1_id, tgt_id, add_lo_*, n_added, drop_lo_*, n_dropped): log-odds of name tokens on one side only."""
    kinds = [tagged("kind", k, F.array_except(tokens(a), tokens(b))) for k, a, b in (("add", "t_name", "s_name"), ("drop", "s_name", "t_name"))]
    rows = j.select(*ID, F.inline(F.concat(*kinds))).join(odds.select("kind", "tok", "lo"), ["kind", "tok"], "left").na.fill(0.0, ["lo"])
    cols = []
    for k, n in (("add", "n_added"), ("drop", "n_dropped")):
        lo = F.when(F.col("kind") == k, F.col("lo"))
        cols += [f(lo).alias(f"{k}_lo_{m}") for m, f in (("max", F.max), ("min", F.min), ("sum", F.sum))] + [F.count_if(F.col("kind") == k).alias(n)]
    return rows.groupBy(*ID).agg(*cols).na.fill(0)


def format_features(j: DataFrame, raw: DataFrame) -> DataFrame:
    """Of the raw names (id, raw): capitals, mixed, lower, signs; equality but for case; difference of lengths."""
    j = j.join(raw.select(F.col("id").alias("s1_id"), F.col("raw").alias("s_raw")), "s1_id", "left")
    j = j.join(raw.select(F.col("id").alias("tgt_id"), F.col("raw").alias("t_raw")), "tgt_id", "left")
    j = j.withColumns({"s_raw": _text("s_raw"), "t_raw": _text("t_raw")})
    caps = lambda c: ((F.col(c) == F.upper(c)) & (F.col(c) != F.lower(c))).cast("int")
    t = F.col("t_raw")
    return j.withColumns({
        "t_all_caps": caps("t_raw"), "s_all_caps": caps("s_raw"), "t_mixed_case": ((t != F.upper(t)) & (t != F.lower(t))).cast("int"),
        "t_lower": ((t == F.lower(t)) & (t != F.upper(t))).cast("int"), "t_symbols": t.rlike(r"[()\[\]#*]").cast("int"),
        "raw_name_eq_ci": (F.lower("s_raw") == F.lower("t_raw")).cast("int"), "raw_len_diff": F.length("t_raw") - F.length("s_raw"),
    }).drop("s_raw", "t_raw")


FUZZY = ["tsort", "tset", "wratio", "cmp_partial", "cmp_prefix", "addr_tset", "skel_ratio", "alias_best_tset", "alias_best_jw"]


def other_names(name: str) -> list[str]:
    """The names that a name gives, cut at the words that announce another one."""
    return [*filter(None, map(str.strip, re.split(ALIAS, name)))] or [name]


def fuzzy_one(s_core: str, t_core: str, s_addr: str, t_addr: str, s_name: str, t_name: str) -> tuple[float, ...]:
    """FUZZY of one pair. With an alias on either side the best of all its names counts, else the whole names."""
    core_set = sim.token_set_ratio(s_core, t_core)
    names = [(a, b) for a in other_names(s_name) for b in other_names(t_name)]
    aliased = any(re.search(ALIAS, n) for n in (s_name, t_name))
    solid = [c.replace(" ", "") for c in (s_core, t_core)]
    values = {
        "tsort": sim.token_sort_ratio(s_core, t_core), "tset": core_set, "wratio": sim.weighted_ratio(s_core, t_core),
        "cmp_partial": sim.partial_ratio(*solid), "cmp_prefix": sim.prefix_share(*solid), "addr_tset": sim.token_set_ratio(s_addr, t_addr),
        "skel_ratio": sim.ratio(skeleton(s_core) or "", skeleton(t_core) or ""),
        "alias_best_tset": max(sim.token_set_ratio(a, b) for a, b in names) if aliased else core_set,
        "alias_best_jw": max(sim.jaro_winkler(a, b) for a, b in names) if aliased else sim.jaro_winkler(s_name, t_name),
    }
    return tuple(values[f] for f in FUZZY)


def fuzzy_features(j: DataFrame) -> DataFrame:
    """FUZZY in one Arrow UDF, and the alias flags."""

    @F.arrow_udf(", ".join(f"{c} double" for c in FUZZY))
    def run(a: pa.Array, b: pa.Array, c: pa.Array, d: pa.Array, e: pa.Array, f: pa.Array) -> pa.Array:
        rows = [fuzzy_one(*r) for r in zip(*(x.to_pylist() for x in (a, b, c, d, e, f)))]
        return pa.StructArray.from_arrays([pa.array([r[i] for r in rows], pa.float64()) for i in range(len(FUZZY))], names=FUZZY)

    j = j.withColumn("fz", run("s_core", "t_core", "s_addr", "t_addr", "s_name", "t_name"))
    j = j.withColumns({c: F.col(f"fz.{c}") for c in FUZZY}).drop("fz")
    return j.withColumns({"s_has_alias": F.col("s_name").rlike(ALIAS).cast("int"), "t_has_alias": F.col("t_name").rlike(ALIAS).cast("int")})


def build(rev: DataFrame, s1: DataFrame, targets: DataFrame, name_idf: DataFrame, addr_idf: DataFrame, odds: DataFrame, raw: DataFrame, features: list[str] = V4, extra: tuple[str, ...] = ("y",), keep: Keep = lazy) -> DataFrame:
    """s1_id, tgt_id, the asked features as floats, and extra columns that rev has. rev: competition() of all candidates
    of every S1 that it contains. Branches that no asked feature needs are not computed. keep writes the pairs with both
    records, which all branches read, and the tables that branches aggregate."""
    j = keep(base(rev, s1, targets), "pairs")
    asked = set(features)
    out = own_context(j)
    for need, step in ((set(FUZZY) | {"s_has_alias", "t_has_alias"}, fuzzy_features), ({f for f in V4 if f.startswith("lf_")}, legal_transition)):
        out = step(out) if asked & need else out
    out = number_features(address_features(name_features(out)))
    out = out.join(keep(cluster(j), "pair-cluster"), ID, "left").na.fill({"xs_num_eq": -1, "n_twins": 0})
    if asked & {"t_all_caps", "s_all_caps", "t_mixed_case", "t_lower", "t_symbols", "raw_name_eq_ci", "raw_len_diff"}:
        out = format_features(out, raw)
    out = out.join(keep(idf_overlap(j, name_idf, "s_core", "t_core", "name"), "pair-name-idf"), ID, "left").na.fill(0, ["idf_shared", "idf_unshared_max", "name_n_unshared"])
    if any(f.startswith("addr_idf") for f in asked):
        out = out.join(keep(idf_overlap(j, addr_idf, "s_addr", "t_addr", "addr"), "pair-addr-idf"), ID, "left").na.fill(0, ["addr_idf_shared", "addr_idf_unshared_max"])
    if any("_lo_" in f or f in ("n_added", "n_dropped") for f in asked):
        out = out.join(keep(odds_features(j, odds), "pair-odds"), ID, "left").na.fill(0, [c for c in V4 if "_lo_" in c] + ["n_added", "n_dropped"])
    return out.select(*ID, *[F.col(f).cast("float").alias(f) for f in features], *[e for e in extra if e in rev.columns])
