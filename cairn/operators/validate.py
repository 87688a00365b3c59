"""Checks of a submission: one row per violated rule, from the raw lines of the file."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def problems(lines: DataFrame, required: DataFrame, known: DataFrame | None = None, candidates: DataFrame | None = None, list_column: str = "matched_entity_ids") -> DataFrame:
    """lines (line_no from 0, line) against required S1 ids (entity_id), optionally known targets (entity_id) and a
    candidates file of the same form -> (rule, severity, n, example). Ids are compared as they stand, blanks too."""
    head = f"source1_entity_id\t{list_column}"
    header = lines.where(F.col("line_no") == 0).select("line")
    body = lines.where((F.col("line_no") > 0) & (F.col("line") != ""))
    parts = F.split("line", "\t")
    rows = body.select("line", F.element_at(parts, 1).alias("s"), F.when(F.size(parts) > 1, F.element_at(parts, 2)).alias("l"), F.size(parts).alias("n"))
    good = rows.where("n = 2")
    ids = good.select("s", F.explode(F.split("l", ",")).alias("t")).where("t <> ''")
    target = F.col("t").rlike("^S[23]-")
    req = required.select(F.col("entity_id").alias("s")).distinct()

    def rule(name: str, bad: DataFrame, what: str, severity: str = "error") -> DataFrame:
        got = bad.agg(F.count("*").alias("n"), F.min(what).alias("example")).where("n > 0")
        return got.select(F.lit(name).alias("rule"), F.lit(severity).alias("severity"), "n", "example")

    out = [
        rule("empty_file", lines.agg(F.count("*").alias("c")).where("c = 0").select(F.lit("").alias("x")), "x"),
        rule("wrong_header", header.where(F.col("line") != head), "line"),
        rule("not_two_columns", rows.where("n <> 2"), "line"),
        rule("duplicate_s1", good.groupBy("s").count().where("count > 1"), "s"),
        rule("repeated_id", ids.groupBy("s", "t").count().where("count > 1"), "t"),
        rule("s1_in_list", ids.where(F.col("t").startswith("S1-")), "t"),
        rule("wrong_prefix", ids.where(~target & ~F.col("t").startswith("S1-")), "t"),
        rule("missing_s1", req.join(good, "s", "left_anti"), "s"),
        rule("extra_s1", good.select("s").distinct().join(req, "s", "left_anti"), "s"),
    ]
    if known is not None:
        out.append(rule("unknown_id", ids.where(target).join(known.select(F.col("entity_id").alias("t")), "t", "left_anti"), "t"))
    if candidates is not None:
        c = candidates.where("line_no > 0").select(F.split_part("line", F.lit("\t"), F.lit(1)).alias("s"), F.explode(F.split(F.split_part("line", F.lit("\t"), F.lit(2)), ",")).alias("t"))
        out.append(rule("not_a_candidate", ids.join(c, ["s", "t"], "left_anti"), "t", "warning"))
    whole = out[0]
    for x in out[1:]:
        whole = whole.unionByName(x)
    return whole
