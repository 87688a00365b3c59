import math

import pytest
from pyspark.sql import functions as F

from cairn.functions.columns import eid, src_of
from cairn.functions.text import build_keys
from cairn.operators import blocking, context, decide, evaluate, pairs, validate
from cairn.plans import catalogue
from cairn.plans.records import ascii_keys, records, split
from cairn.sources import tables

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["records_profile", "rare_tokens", "candidates_topk", "blocking_eval", "adaptive_cut", "pair_feat_number", "decide_one_to_many", "macro_f05", "submission"])
def test_query_is_its_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SMALL}/documents.parquet'")
    cur = con.execute(catalogue.ORACLES[name])
    cols = sorted(c[0] for c in cur.description)
    want = [dict(zip([c[0] for c in cur.description], r)) for r in cur.fetchall()]
    got = [r.asDict() for r in catalogue.QUERIES[name](spark, SMALL).collect()]
    key = lambda r: [str(round(r[c], 6) if isinstance(r[c], float) else r[c]) for c in cols]
    assert sorted(map(key, got)) == sorted(map(key, want))


def test_blocking_a_subset_is_the_whole_restricted(spark):
    s1, t = split(ascii_keys(records(spark, SMALL)))
    whole = blocking.run_blocking(s1, [t])
    some = s1.where(eid("entity_id") % 3 == 0).select(eid("entity_id").alias("s1_id"))
    part = {(r.s1_id, r.tgt_id) for r in blocking.run_blocking(s1, [t], some).collect()}
    assert part == {(r.s1_id, r.tgt_id) for r in whole.collect() if r.s1_id % 3 == 0} and part


def test_null_names_and_empty_tables(spark):
    schema = "entity_id string, business_name string, business_address string, country string"
    raw = spark.createDataFrame([("S1-1", None, None, "US"), ("S1-2", "Acme Tools", "1 Main St", "US"), ("S2-3", "ACME tools", "1 main street", "us"), ("S3-4", None, "", None)], schema)
    k = build_keys(raw)
    s1, t = split(k.withColumn("business_name", F.lit(None).cast("string")))
    c = blocking.run_blocking(s1, [t]).collect()
    assert [(r.s1_id, r.tgt_id) for r in c] == [(100000000002, 200000000003)]
    assert blocking.run_blocking(s1.limit(0), [t]).count() == 0


def test_all_features_and_ids(spark):
    assert [len(x) for x in (pairs.V1, pairs.V2, pairs.V3, pairs.V4)] == [38, 49, 58, 85]
    r = catalogue.QUERIES["pair_features_all"](spark, SMALL)
    assert set(pairs.V4) <= set(r.columns) and r.count() > 0
    x = spark.createDataFrame([("S2-123",)], "e string").select(eid("e").alias("i")).withColumn("s", src_of("i")).first()
    assert tuple(x) == (200000000123, 2)


def test_f05_goldens():
    want = [(set(), set(), 1), (set(), {"S2-1"}, 0), ({"S2-1"}, set(), 0), ({"S2-1"}, {"S2-1"}, 1), ({"S2-1"}, {"S2-1", "S2-2"}, 0.8333333333), ({"a", "b", "c"}, {"a", "b"}, 0.7142857143)]
    for p, a, f in want:
        assert math.isclose(evaluate.f05(p, a), f, abs_tol=1e-9)
    assert evaluate.parse_ids(" S2-1, ,S3-2") == {"S2-1", "S3-2"} and evaluate.macro_f05({}, {"x": set()}) == 1


def test_decisions_keep_one_owner(spark):
    q = spark.createDataFrame([(1, 10, 0.9), (2, 10, 0.9), (1, 11, 0.5), (2, 12, 0.7), (3, 13, 0.1)], "s1_id long, tgt_id long, q double")
    assert {(r.s1_id, r.tgt_id) for r in decide.decide(q, 0.4).collect()} == {(1, 10), (1, 11), (2, 12)}
    assert {(r.s1_id, r.tgt_id) for r in decide.extra_match(decide.decide(q, 0.4)).collect()} == {(1, 10), (2, 12)}
    assert 13 not in {r.tgt_id for r in decide.expected_f05(q).collect()}
    assert context.competition(q.selectExpr("s1_id", "tgt_id", "2L src", "q p", "1L rk2")).where("tgt_id = 10 and rev_rk = 1").first().s1_id == 1


@pytest.mark.parametrize("line, rule", [("S1-1", "not_two_columns"), ("S1-1\tS2-1,S2-1", "repeated_id"), ("S1-1\tS1-2", "s1_in_list"), ("S1-1\tS2-1, S2-2", "wrong_prefix"), ("S1-9\t", "extra_s1"), ("S1-1\tS2-99", "unknown_id"), ("S1-1\tS2-2", "not_a_candidate")])
def test_validator(spark, line, rule):
    lines = lambda rows: spark.createDataFrame(list(enumerate(rows)), "line_no long, line string")
    head = "source1_entity_id\tmatched_entity_ids"
    req, known = (spark.createDataFrame([(x,) for x in ids], "entity_id string") for ids in (["S1-1"], ["S2-1", "S2-2"]))
    out = {r.rule for r in validate.problems(lines([head, line]), req, known, lines(["h", "S1-1\tS2-1"])).collect()}
    assert rule in out
    assert validate.problems(lines([head, "S1-1\tS2-1"]), req, known).count() == 0
    assert {r.rule for r in validate.problems(lines(["a,b"]), req).collect()} == {"wrong_header", "missing_s1"}
    assert {r.rule for r in validate.problems(lines(["x"]).limit(0), req).collect()} == {"empty_file", "missing_s1"}


def test_tsv_keeps_quotes(spark, tmp_path):
    (tmp_path / "a.tsv").write_text('entity_id\tbusiness_name\tbusiness_address\tcountry\nS1-1\tA "B\t\tUS\n')
    df = tables.read_tsv(spark, str(tmp_path / "a.tsv"))
    assert tuple(df.first()) == ("S1-1", 'A "B', None, "US")
    assert tables.reconcile(spark, str(tmp_path / "a.tsv"), df).first().agree
    tables.write_parquet(df, str(tmp_path / "p"))
    assert tables.read_parquet(spark, str(tmp_path / "p"), row_number=True).first().file_row_number == 0
    tables.write_submission(spark.createDataFrame([("S1-2", ""), ("S1-1", "S2-1")], "source1_entity_id string, matched_entity_ids string"), str(tmp_path / "s"))
    text = next((tmp_path / "s").glob("part-*")).read_text()
    assert text == "source1_entity_id\tmatched_entity_ids\nS1-1\tS2-1\nS1-2\t\n"


def test_incremental_stream(spark, tmp_path):
    from cairn.streaming.incremental import link

    schema = "entity_id string, business_name string, business_address string, country string"
    s1 = build_keys(spark.createDataFrame([("S1-2", "Acme Tools", "1 Main St", "US")], schema))
    spark.createDataFrame([("S2-3", "ACME tools", "1 main street", "us")], schema).write.parquet(str(tmp_path / "in"))
    got = []
    q = link(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), s1, lambda df, n: got.extend(df.collect()))
    q.option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination(120)
    assert [r.tgt_id for r in got] == [200000000003]


def test_whole_queries_keep_groups_of_copies(spark, tmp_path):
    text = "velmora tasik brenholt ospira 12 quendal mirov strane pilcot harnova drelim"
    rows = [(i, text, "en", "a", len(text)) for i in range(1, 13)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    q = {n: catalogue.QUERIES[n](spark, str(tmp_path)) for n in ("candidates_topk", "candidates_topk_whole", "exact_key_blocking_whole", "token_idf_blocking_whole", "adaptive_cut_whole", "pair_features_all")}
    assert {n: df.count() for n, df in q.items()} == {"candidates_topk": 0, "candidates_topk_whole": 11, "exact_key_blocking_whole": 11, "token_idf_blocking_whole": 11, "adaptive_cut_whole": 10, "pair_features_all": 10}


def test_text_queries_read_whole_texts(spark, tmp_path):
    rows = [(1, " ".join(f"velm{chr(97 + i)}" for i in range(20)) + " आदित्य lastword", "en", "a", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    q = {n: catalogue.QUERIES[n](spark, str(tmp_path)).first() for n in ("normalize_text", "skeletons", "scripts")}
    assert "lastword" in q["normalize_text"].name_v2 and "lastword" in q["normalize_text"].addr_v2
    assert len(q["skeletons"].skeleton) > 40 and q["scripts"].scripts == "DEVANAGARI"


def test_null_texts_stay_as_in_sql(spark, tmp_path):
    import duckdb

    path = str(tmp_path / "documents.parquet")
    spark.createDataFrame([(1, None, "en"), (2, None, "en"), (3, "one two three four five six", "en")], "doc_id long, text string, lang string").write.parquet(path)
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{path}/*.parquet'")
    want = sorted(con.execute(catalogue.ORACLES["entity_ids"]).fetchall())
    assert sorted(map(tuple, catalogue.QUERIES["entity_ids"](spark, str(tmp_path)).collect())) == want and len(want) == 3


def plans(df):
    """Scans and exchanges of the plan as written, and as executed."""
    df.write.format("noop").mode("overwrite").save()
    text = df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple"))
    return text.count("FileScan parquet"), text.count("Exchange hashpartitioning")


def test_documents_are_scanned_once(spark, tmp_path, monkeypatch):
    from cairn.plans import records as view

    path = str(tmp_path / "documents.parquet")
    spark.read.parquet(f"{SMALL}/documents.parquet").write.parquet(path)
    asked = []
    monkeypatch.setattr(view, "table", lambda s, d, n: asked.append(n) or s.read.parquet(f"{d}/{n}.parquet"))
    out = {n: catalogue.QUERIES[n](spark, str(tmp_path)) for n in ("submission", "candidates_topk", "candidates_topk_whole", "pair_features_all", "pair_feat_cluster", "audit_loss_stage", "macro_f05")}
    assert asked == ["documents"] and not any(path in f for df in out.values() for f in df.inputFiles())
    assert plans(out["candidates_topk"]) == (1, 0) and plans(out["candidates_topk_whole"]) == (1, 0)
    assert plans(out["pair_feat_cluster"])[0] <= 2 and plans(out["pair_features_all"])[0] <= 8
    words = view.words(spark.read.parquet(path))
    assert plans(words) == (1, 0)
    spark.createDataFrame([(1, "a b c d e f", "en")], "doc_id long, text string, lang string").write.mode("overwrite").parquet(path)
    assert catalogue.QUERIES["submission"](spark, str(tmp_path)).count() == 1 and asked == ["documents"] * 2


def test_first_words_are_those_of_the_whole_text(spark):
    from cairn.plans.records import words

    rows = [(i, t, "en") for i, t in enumerate(["", " ", "a", " a\n\tb ", "one two  three\r\nfour five six seven eight nine ten eleven", "x" * 100_000 + " y", "\n\n" * 50_000 + "z", None, "a b c d e f g h i", "a b c d e f g h i "])]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    first = {r.doc_id: r.ws for r in words(d).collect()}
    whole = {r.doc_id: r.ws for r in words(d, whole=True).collect()}
    assert {k: v[:9] if v is not None else None for k, v in whole.items()} == first


def test_stages_need_a_shared_folder(spark, monkeypatch):
    from cairn.stages import Stages, shared_dir

    st = Stages(spark)
    assert st.write(spark.range(3), "x").count() == 3 and st.table("y", lambda: spark.range(2)).count() == st.table("y", lambda: 1 / 0).count() == 2

    class Far:
        sparkContext = type("C", (), {"master": "spark://far", "getConf": lambda self: type("F", (), {"get": lambda self, k: None})()})()

    with pytest.raises(ValueError):
        shared_dir(Far())
