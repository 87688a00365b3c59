"""All linkage queries by name: a function of (spark, sf_dir) and, where SQL can say it, the same in DuckDB SQL.

Queries on candidates come twice: under their name with caps small enough to bind on little data (key_cap 5, k_max 5, a cut of
3 per source), which loses groups of copies, and as NAME_whole with the operators' own defaults. Those without SQL run the
defaults under their own names. Integers are longs and doubles are rounded at 6 places on both sides.
"""

from __future__ import annotations

from collections.abc import Callable
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairn.functions import text as tx
from cairn.functions.columns import eid, first_number, src_of
from cairn.operators import blocking, context, decide, evaluate, mining, models, pairs, rerank, validate
from cairn.plans.oracles import SMALL, WHOLE, bound, sql
from cairn.plans.records import ascii_keys, records, split, table, truth
from cairn.sources.tables import sizes
from cairn.stages import Keep, Stages, open_stages

#: The small caps of the SQL by step; a step that is not there has its operator's defaults.
SQL_CAPS = {"blocking": {"key_cap": 5, "k_max": 5}, "cut": {"tau": 0.3, "cap": 3}, "sizes": {"key_cap": 5}, "exact": {"cap": 3}, "tokens": {"df_cap": 20, "k_max": 5}}
_caps: ContextVar[dict] = ContextVar("caps", default=SQL_CAPS)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
_SQL: dict[str, str] = {}  # with caps by name


def tidy(df: DataFrame) -> DataFrame:
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.round(c.cast("double"), 6)
        elif isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("long")
        out.append(c.alias(f.name))
    return df.select(*out)


def query(oracle: str | None = None, upto: str | None = None):
    """Register a query under its function's name."""

    def add(f):
        QUERIES[f.__name__] = lambda spark, d: tidy(f(spark, d))
        if oracle is not None:
            _SQL[f.__name__] = sql(upto, oracle) if upto else oracle
            ORACLES[f.__name__] = bound(_SQL[f.__name__], SMALL)
        return f

    return add


def caps(step: str) -> dict:
    return _caps.get().get(step, {})


def whole(f):
    """f with the operators' own defaults."""

    def run(spark, d):
        was = _caps.set({})
        try:
            return f(spark, d)
        finally:
            _caps.reset(was)

    return run


#: Rows that the data lack, added by query and SQL alike: owned pairs, customers, names of true pairs, pairs with legal forms.
OWNED = [(100000000001, 200000000009), (100000000002, 200000000009), (100000000003, 200000000008)]
IDLE = [(-1, "Customer without orders"), (-2, "Another one")]
NAME_PAIRS = [("sunrise bakery", "sunrise bakry"), ("green market hall", "green markt hal"), ("old market", "old markt"), ("blue bakery 12", "blue bakry 13"), ("alpha beta gamma", "alpha"), ("alpha beta", "alpha delta")]
WORD_PAIRS = [("aditya stores", "आदित्य स्टोर्स"), ("aditya tea", "आदित्य टी"), ("ram stores", "राम स्टोर्स"), ("ram", "राम"), ("sita", "राम"), ("one", "राम राम")]
FORMS = [(-1, -1, "acme private limited", "acme private limited"), (-2, -1, "acme limited", "acme"), (-3, -1, "acme", "acme llc"), (-4, -1, "zen llc", "zen private llc"), (-5, -1, "zen llc", "zen limited west"), (-6, -1, "zen sas sas", "zen sas"), (-7, -1, "zen", "acme")]


def literals(rows: list[tuple]) -> str:
    """Rows as a SQL list of values."""
    return "(values " + ", ".join("(" + ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in r) + ")" for r in rows) + ")"


# --- what queries share -----------------------------------------------------------------------------------------


def stages(spark, d) -> Stages:
    return open_stages(spark, f"{d}/documents.parquet")


def stage(spark, d, name: str, make: Callable[[Keep], DataFrame], step: str = "") -> DataFrame:
    """A written table, made once for all queries over the same documents; step: whose caps it depends on."""
    st, full = stages(spark, d), f"{name}-{step}" if step and _caps.get() else name
    return st.table(full, lambda: make(st.write))


def keys(spark, d):
    """Records with their keys: business_name, business_address, country and owner too."""
    return stage(spark, d, "records", lambda keep: ascii_keys(records(spark, d, keep=keep)))


def blocked(spark, d):
    """Keys of S1 and of targets; the token counts they were made with."""
    st, (s1, t) = stages(spark, d), split(keys(spark, d))
    if "target-keys" not in st.made:
        blocking.keys_of(s1, t, keep=lambda df, name: st.table(name, lambda: df))
    return st.made["s1-keys"], st.made["target-keys"], st.made["token-df"]


def candidates(spark, d):
    k = keys(spark, d)
    s1, t = split(k)
    s_keys, t_keys, _ = blocked(spark, d)
    return stage(spark, d, "candidates", lambda keep: blocking.score_candidates(s_keys, t_keys, **caps("blocking")), "sql"), k, s1, t


def reranked(spark, d):
    c, k, s1, t = candidates(spark, d)
    return stage(spark, d, "rerank", lambda keep: rerank.fixed_score(rerank.features(c, s1, t)), "sql"), k, s1, t


def cut(spark, d):
    r, k, s1, t = reranked(spark, d)
    return stage(spark, d, "cut", lambda keep: rerank.cut(r, **caps("cut")), "sql"), k, s1, t


def competed(spark, d):
    c, k, s1, t = cut(spark, d)
    return stage(spark, d, "competition", lambda keep: context.competition(c), "sql"), k, s1, t


def joined(spark, d):
    c, k, s1, t = competed(spark, d)
    return stage(spark, d, "pairs", lambda keep: pairs.base(c, s1, t), "sql"), k, s1, t


def labelled(spark, d):
    c, k, s1, t = cut(spark, d)
    y = truth(k).withColumn("y", F.lit(1))
    return rerank.sides(c, s1, t).join(y, ["s1_id", "tgt_id"], "left").na.fill(0, ["y"])


def odds(spark, d):
    return stage(spark, d, "odds", lambda keep: context.token_odds(labelled(spark, d), least=2), "sql")


def decided(spark, d):
    c, k, s1, t = cut(spark, d)
    return stage(spark, d, "decided", lambda keep: decide.decide(c.select("s1_id", "tgt_id", F.col("p").alias("q")), 0.4), "sql"), s1, t


# --- records ----------------------------------------------------------------------------------------------------


@query("""select cast(src as bigint) as src, country_key, cast(count(*) as bigint) as n, cast(sum((name is null)::int) as bigint) as no_name,
 cast(sum((trim(coalesce(raw,''))='')::int) as bigint) as blank_name, cast(sum((addr is null)::int) as bigint) as no_address from (select *, c as country_key from k) group by all""", "k")  # fmt: skip
def records_profile(spark, d):
    n = lambda c: F.count_if(c)
    k = keys(spark, d).withColumn("src", src_of(eid("entity_id")))
    return k.groupBy("src", "country_key").agg(F.count("*").alias("n"), n(F.col("name_v2").isNull()).alias("no_name"), n(F.trim(F.coalesce("business_name", F.lit(""))) == "").alias("blank_name"), n(F.col("addr_v2").isNull()).alias("no_address"))


@query("select entity_id, cast(id as bigint) as id, cast(src as bigint) as src, cast(count(*) over (partition by id) as bigint) as same_id from k", "k")
def entity_ids(spark, d):
    k = keys(spark, d).select("entity_id", eid("entity_id").alias("id"))
    return k.withColumn("src", src_of("id")).withColumn("same_id", F.count("*").over(Window.partitionBy("id")))


LISTS = "select owner as s1, string_agg(entity_id, ',' order by entity_id) as matched from k where owner is not null and src > 1 group by owner"


def id_lists(spark, d):
    own = keys(spark, d).where(F.col("owner").isNotNull() & ~F.col("entity_id").startswith("S1-"))
    return own.groupBy(F.col("owner").alias("s1")).agg(F.array_join(F.sort_array(F.collect_list("entity_id")), ",").alias("matched"))


@query(f"select s1, trim(x) as t from (select s1, unnest(string_split(matched, ',')) as x from ({LISTS})) where trim(x) <> ''", "k")
def gt_pairs(spark, d):
    return id_lists(spark, d).select("s1", F.explode(F.split("matched", ",")).alias("x")).select("s1", F.trim("x").alias("t")).where("t <> ''")


@query("select cast(n as bigint) as n_matches, cast(count(*) as bigint) as n_s1 from (select id, (select count(*) from truth t where t.s1_id = k.id) as n from k where src = 1) group by n", "truth")
def match_count_dist(spark, d):
    r = keys(spark, d)
    n = truth(r).groupBy("s1_id").agg(F.count("*").alias("n_matches"))
    s = r.where(F.col("entity_id").startswith("S1-")).select(eid("entity_id").alias("s1_id"))
    return s.join(n, "s1_id", "left").na.fill(0).groupBy("n_matches").agg(F.count("*").alias("n_s1"))


@query("select cast(tgt_id as bigint) as tgt_id, cast(count(distinct s1_id) as bigint) as owners from (select s1_id, tgt_id from truth union all select * from " + literals(OWNED) + ") group by tgt_id having count(distinct s1_id) <> 1", "truth")
def owner_uniqueness(spark, d):
    t = truth(keys(spark, d)).unionByName(spark.createDataFrame(OWNED, "s1_id long, tgt_id long"))
    return t.groupBy("tgt_id").agg(F.count_distinct("s1_id").alias("owners")).where("owners <> 1")


@query("select cast(count(*) as bigint) as pairs, cast(sum((a.c = b.c)::int) as bigint) as same_country from truth t join k a on a.id = t.s1_id join k b on b.id = t.tgt_id", "truth")
def country_agreement(spark, d):
    r = keys(spark, d)
    c = r.select(eid("entity_id").alias("id"), F.lower("country").alias("c"))
    p = truth(r).join(c.select(F.col("id").alias("s1_id"), F.col("c").alias("a")), "s1_id").join(c.select(F.col("id").alias("tgt_id"), F.col("c").alias("b")), "tgt_id")
    return p.agg(F.count("*").alias("pairs"), F.count_if(F.col("a") == F.col("b")).alias("same_country"))


@query("select src, cast(count(*) as bigint) as n from (select 'S1' as src from k where src=1 union all select 'T' from k where src>1) group by src", "k")
def union_all_sources(spark, d):
    s1, t = split(keys(spark, d))
    return s1.select(F.lit("S1").alias("src")).unionByName(t.select(F.lit("T").alias("src"))).groupBy("src").agg(F.count("*").alias("n"))


@query("""select cast(s1_id as bigint) as s1_id, cast(tgt_id as bigint) as tgt_id from (select s.id as s1_id, t.id as tgt_id from k s join k t on s.c=t.c and s.name=t.name and s.src=1 and t.src>1
 union select s.id, t.id from k s join k t on s.c=t.c and s.addr=t.addr and s.src=1 and t.src>1)""", "k")  # fmt: skip
def union_distinct_pairs(spark, d):
    s1, t = split(keys(spark, d))
    return blocking.exact_key_blocking(s1, t, 10**9)


@query("""select (select count(*) from documents) as documents, (select count(*) from labels) as labels, cast((select count(*) from labels where quality=1) as bigint) as good""")
def scalar_subqueries(spark, d):
    for n in ("documents", "labels"):
        table(spark, d, n).createOrReplaceTempView(f"cairn_{n}")
    return spark.sql("select (select count(*) from cairn_documents) as documents, (select count(*) from cairn_labels) as labels, (select count(*) from cairn_labels where quality = 1) as good")


@query("select table_name as name, cast(n as bigint) as rows from (select 'orders' as table_name, count(*) as n from orders union all select 'lineitem', count(*) from lineitem union all select 'nation', count(*) from nation)")
def dataset_sizes(spark, d):
    return sizes({n: table(spark, d, n) for n in ("orders", "lineitem", "nation")}).select("name", "rows")


# --- relational shapes ------------------------------------------------------------------------------------------


@query("""select l_returnflag, cast(count(*) filter (where l_quantity > 25) as bigint) as big, cast(count(distinct l_suppkey) as bigint) as suppliers,
 round(max(l_extendedprice) filter (where l_discount = 0), 6) as max_full, round(avg((l_tax > 0.04)::int), 6) as taxed from lineitem group by all having count(*) > 1""")  # fmt: skip
def count_distinct_filter(spark, d):
    g = table(spark, d, "lineitem").groupBy("l_returnflag").agg(
        F.count_if(F.col("l_quantity") > 25).alias("big"), F.count_distinct("l_suppkey").alias("suppliers"),
        F.max(F.when(F.col("l_discount") == 0, F.col("l_extendedprice"))).alias("max_full"), F.avg((F.col("l_tax") > 0.04).cast("int")).alias("taxed"), F.count("*").alias("n"),
    )
    return g.where("n > 1").drop("n")


@query("select c_custkey, c_name from customer where c_custkey in (select o_custkey from orders where o_totalprice > 300000)")
def semi_join_ids(spark, d):
    o = table(spark, d, "orders").where("o_totalprice > 300000")
    return table(spark, d, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey", "c_name")


@query("select c_custkey, c_name from (select c_custkey, c_name from customer union all select * from " + literals(IDLE) + ") anti join orders on c_custkey = o_custkey")
def anti_join_ids(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_name").unionByName(spark.createDataFrame(IDLE, "c_custkey long, c_name string"))
    return c.join(table(spark, d, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey", "c_name")


@query("""select l_partkey, l_suppkey, cast(count(*) as bigint) as n from lineitem l where not exists (select 1 from (select l_partkey as bp, l_suppkey as bs from lineitem group by all having count(*) > 2) b
 where b.bp = l.l_partkey and b.bs = l.l_suppkey) group by all""")  # fmt: skip
def not_exists_big_blocks(spark, d):
    li = table(spark, d, "lineitem").select("l_partkey", "l_suppkey")
    n = li.groupBy("l_partkey", "l_suppkey").agg(F.count("*").alias("n"))
    return li.join(n.where("n > 2"), ["l_partkey", "l_suppkey"], "left_anti").groupBy("l_partkey", "l_suppkey").agg(F.count("*").alias("n"))


@query("""select c_custkey, n_name, cast(coalesce(n, 0) as bigint) as n_orders from customer left join nation on c_nationkey = n_nationkey
 left join (select o_custkey, count(*) as n from orders group by 1) on o_custkey = c_custkey""")  # fmt: skip
def left_multi_join(spark, d):
    n = table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    c = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left")
    return c.join(n, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "n_name", F.coalesce("n", F.lit(0)).alias("n_orders"))


@query("""select a.l_orderkey, cast(a.l_linenumber as bigint) as line, cast(count(*) as bigint) as siblings, round(max(b.l_quantity), 6) as max_q from lineitem a join lineitem b
 on a.l_orderkey = b.l_orderkey and a.l_linenumber <> b.l_linenumber and b.l_quantity >= 25 group by all""")  # fmt: skip
def self_join_siblings(spark, d):
    li = table(spark, d, "lineitem")
    b = li.select(F.col("l_orderkey"), F.col("l_linenumber").alias("b_line"), F.col("l_quantity").alias("q")).where("q >= 25")
    a = li.select("l_orderkey", F.col("l_linenumber").alias("line")).join(b, "l_orderkey").where("line <> b_line")
    return a.groupBy("l_orderkey", "line").agg(F.count("*").alias("siblings"), F.max("q").alias("max_q"))


@query("select o_custkey, o_orderkey, cast(rk as bigint) as rk from (select *, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) as rk from orders) where rk <= 3")
def topk_per_group(spark, d):
    rk = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.col("o_totalprice").desc(), "o_orderkey"))
    return table(spark, d, "orders").withColumn("rk", rk).where("rk <= 3").select("o_custkey", "o_orderkey", "rk")


@query("""select l_partkey, l_orderkey, cast(l_linenumber as bigint) as line, cast(row_number() over w as bigint) as rn, cast(count(*) over (partition by l_partkey) as bigint) as n, round(max(l_extendedprice) over (partition by l_partkey), 6) as mx,
 round(coalesce(nth_value(l_extendedprice, 2) over (partition by l_partkey order by l_extendedprice desc, l_orderkey, l_linenumber rows between unbounded preceding and unbounded following), 0), 6) as second
 from lineitem window w as (partition by l_partkey order by l_extendedprice desc, l_orderkey, l_linenumber)""")  # fmt: skip
def competition_window(spark, d):
    p = Window.partitionBy("l_partkey")
    w = p.orderBy(F.col("l_extendedprice").desc(), "l_orderkey", "l_linenumber")
    full = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return table(spark, d, "lineitem").select(
        "l_partkey", "l_orderkey", F.col("l_linenumber").alias("line"), F.row_number().over(w).alias("rn"), F.count("*").over(p).alias("n"),
        F.max("l_extendedprice").over(p).alias("mx"), F.coalesce(F.nth_value("l_extendedprice", 2).over(full), F.lit(0.0)).alias("second"),
    )


@query("select p_partkey, cast(rank() over (partition by p_brand order by p_size desc) as bigint) as rk from part")
def rank_ties(spark, d):
    return table(spark, d, "part").select("p_partkey", F.rank().over(Window.partitionBy("p_brand").orderBy(F.col("p_size").desc())).alias("rk"))


@query("select event_type, cast(count(*) as bigint) as n, round(count(*) / sum(count(*)) over (), 6) as share from events group by event_type")
def share_of_total(spark, d):
    n = table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))  # one row per type


@query("select round(median(n), 6) as med, round(quantile_cont(n, 0.99), 6) as p99 from (select count(*) as n from lineitem group by l_orderkey)")
def median_p99(spark, d):
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n")).agg(F.median("n").alias("med"), F.percentile("n", F.lit(0.99)).alias("p99"))


@query("select round(corr(o_orderkey, o_totalprice), 6) as r from orders")
def corr_ids(spark, d):
    return table(spark, d, "orders").agg(F.corr("o_orderkey", "o_totalprice").alias("r"))


@query("select r_name, string_agg(n_name, ',' order by n_name) as nations from nation join region on n_regionkey = r_regionkey group by r_name")
def string_agg_ordered(spark, d):
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return n.groupBy("r_name").agg(F.array_join(F.sort_array(F.collect_list("n_name")), ",").alias("nations"))


@query("""select event_type, cast(count(*) filter (where b='low') as bigint) as low, cast(count(*) filter (where b='mid') as bigint) as mid, cast(count(*) filter (where b='high') as bigint) as high
 from (select event_type, case when value < 30 then 'low' when value between 30 and 70 then 'mid' else 'high' end as b from events) group by event_type""")  # fmt: skip
def pivot_counts(spark, d):
    b = F.when(F.col("value") < 30, "low").when(F.col("value").between(30, 70), "mid").otherwise("high")
    return table(spark, d, "events").withColumn("b", b).groupBy("event_type").pivot("b", ["low", "mid", "high"]).count().na.fill(0)


@query("select o_orderkey, o_orderpriority from orders where o_orderpriority like '1-%' and regexp_matches(o_orderstatus, '^[FO]$') order by o_totalprice desc nulls last, o_orderkey limit 50")
def like_regex_limit(spark, d):
    o = table(spark, d, "orders").where(F.col("o_orderpriority").like("1-%") & F.col("o_orderstatus").rlike("^[FO]$"))
    return o.orderBy(F.col("o_totalprice").desc_nulls_last(), "o_orderkey").limit(50).select("o_orderkey", "o_orderpriority")


@query("""select o_custkey, o_orderkey, round(sum(o_totalprice) over (partition by o_custkey order by o_orderkey rows between unbounded preceding and current row), 2) as running from orders""")
def running_sum(spark, d):
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey").rowsBetween(Window.unboundedPreceding, 0)
    return table(spark, d, "orders").select("o_custkey", "o_orderkey", F.round(F.sum("o_totalprice").over(w), 2).alias("running"))


# --- blocking ---------------------------------------------------------------------------------------------------


@query("select c as country_key, cast(id as bigint) as id, f, tok from stream", "stream")
def token_stream(spark, d):
    return blocking.token_stream(keys(spark, d))


@query("select c as country_key, f, tok from vocab", "vocab")
def s1_vocab_df(spark, d):
    return blocking.vocabulary(split(keys(spark, d))[0])


@query("select c as country_key, f, tok, cast(df as bigint) as df from df", "df")
def token_df(spark, d):
    return blocked(spark, d)[2]


@query("select c as country_key, cast(id as bigint) as id, string_agg(tok, ' ' order by n) filter (where f='n') as ns, string_agg(tok, ' ' order by n) filter (where f='a') as ad from rare group by c, id", "rare")
def rare_tokens(spark, d):
    k = keys(spark, d)
    s1, t = split(k)
    r = blocking.rare_tokens(k, blocked(spark, d)[2])
    s = lambda c: F.nullif(F.array_join(c, " "), F.lit(""))
    return r.select("country_key", "id", s("ns").alias("ns"), s("ad").alias("ad"))


def _record_keys(spark, d, tags):
    k = keys(spark, d)
    s1, t = split(k)
    return blocking.record_keys(k, blocking.rare_tokens(k, blocked(spark, d)[2])).where(F.split_part("key", F.lit("|"), F.lit(1)).isin(tags))


@query("select distinct c as country_key, cast(id as bigint) as id, key from kk where split_part(key,'|',1) in ('na','nn','aa')", "kk")
def pair_keys(spark, d):
    return _record_keys(spark, d, ["na", "nn", "aa"])


@query("select distinct c as country_key, cast(id as bigint) as id, key from kk where split_part(key,'|',1) not in ('na','nn','aa')", "kk")
def affix_keys(spark, d):
    return _record_keys(spark, d, ["core", "cmp", "srt", "p6", "s6", "p8", "s8"])


@query("select c as country_key, key, cast(df as bigint) as df from w", "w")
def key_blocks_capped(spark, d):
    return blocking.block_sizes(blocked(spark, d)[1], **caps("sizes"))


@query("select cast(s1_id as bigint) as s1_id, cast(tgt_id as bigint) as tgt_id, round(score,6) as score, cast(n_keys as bigint) as n_keys, cast(rk as bigint) as rk from cand", "cand")
def candidates_topk(spark, d):
    return candidates(spark, d)[0]


@query("""select cast(count(*) as bigint) as n_s1, round(sum(h)/sum(nt),6) as pair_recall, round(avg((nc>0)::int),6) as s1_coverage,
 round(avg(case when nt=0 then 1 when h=0 then 0 else 1.25*(h/nt)/(0.25+h/nt) end),6) as ceiling_f05, round(avg(nc),6) as avg_cand, round(median(nc),6) as median_cand, round(quantile_cont(nc,0.99),6) as p99_cand, cast(max(nc) as bigint) as max_cand
 from (select id, (select count(*) from truth where s1_id=id) as nt, (select count(*) from truth semi join cand using (s1_id,tgt_id) where s1_id=id) as h, (select count(*) from cand where s1_id=id) as nc from k where src=1)""", "cand")  # fmt: skip
def blocking_eval(spark, d):
    c, k, s1, t = candidates(spark, d)
    return blocking.evaluate(c, s1.select(eid("entity_id").alias("s1_id")), truth(keys(spark, d)))


@query("""select distinct cast(s1_id as bigint) as s1_id, cast(tgt_id as bigint) as tgt_id from (
 select s.id as s1_id, t.id as tgt_id from k s join k t on s.c=t.c and s.name=t.name and s.src=1 and t.src>1 where not exists (select 1 from (select c, name from k where src>1 group by all having count(*)>:exact_cap) b where b.c=t.c and b.name=t.name)
 union all select s.id, t.id from k s join k t on s.c=t.c and s.addr=t.addr and s.src=1 and t.src>1 where not exists (select 1 from (select c, addr from k where src>1 group by all having count(*)>:exact_cap) b where b.c=t.c and b.addr=t.addr))""", "k")  # fmt: skip
def exact_key_blocking(spark, d):
    return blocking.exact_key_blocking(*split(keys(spark, d)), **caps("exact"))


@query("""select cast(s1_id as bigint) as s1_id, cast(tgt_id as bigint) as tgt_id, round(score,6) as score, cast(n_tokens as bigint) as n_tokens, cast(rk as bigint) as rk from (select *, row_number() over (partition by s1_id, tgt_id//100000000000 order by score desc, tgt_id) as rk from (
 select a.id as s1_id, b.id as tgt_id, round(sum(ln(n/df)),9) as score, count(*) as n_tokens from (select c, id, unnest(nt) as tok from tl join k using (id) where src=1) a
 join (select c, id, unnest(nt) as tok from tl join k using (id) where src>1) b using (c,tok)
 join (select c, tok, count(*) as df from (select c, unnest(nt) as tok from tl join k using (id) where src>1) group by all having count(*)<=:df_cap) w using (c,tok)
 join (select c, count(*) as n from k where src>1 group by c) n using (c) group by a.id, b.id)) where rk<=:tok_max""", "tl")  # fmt: skip
def token_idf_blocking(spark, d):
    return blocking.token_idf_blocking(*split(keys(spark, d)), **caps("tokens"))


# --- rerank, competition, tables --------------------------------------------------------------------------------

FEAT = "cast(s1_id as bigint) as s1_id, cast(tgt_id as bigint) as tgt_id, "


@query(f"""select {FEAT} cast(src as bigint) as src, cast(rk as bigint) as rk, round(score,6) as score, cast(n_keys as bigint) as n_keys, round(score_rel,6) as score_rel, round(name_jw,6) as name_jw, round(cmp_jw,6) as cmp_jw,
 cast(cmp_contains as bigint) as cmp_contains, round(name_jacc,6) as name_jacc, round(addr_jacc,6) as addr_jacc, cast(num_shared as bigint) as num_shared, cast(s_nums as bigint) as s_nums, cast(t_nums as bigint) as t_nums,
 cast(t_addr_null as bigint) as t_addr_null, cast(pc_match as bigint) as pc_match from feat""", "feat")  # fmt: skip
def rerank_features(spark, d):
    return reranked(spark, d)[0].drop("p")


CUT = f"{FEAT} cast(src as bigint) as src, p, cast(rk2 as bigint) as rk2"


@query(f"select {CUT} from cut", "cut")
def adaptive_cut(spark, d):
    return cut(spark, d)[0]


@query(f"select {CUT}, cast(rev_rk as bigint) as rev_rk, cast(n_claim as bigint) as n_claim, tgt_max_p, cast(tgt_second_p as double) as tgt_second_p from rev", "rev")
def competition_context(spark, d):
    return competed(spark, d)[0]


@query("select c, tok, round(idf,6) as idf from nidf", "nidf")
def name_idf(spark, d):
    return context.idf(keys(spark, d), "name_core")


@query("select c, tok, round(idf,6) as idf from aidf", "aidf")
def addr_idf(spark, d):
    return context.idf(keys(spark, d), "addr_v2")


@query("select kind, tok, round(lo,6) as lo, cast(n as bigint) as n from odds", "odds")
def token_log_odds(spark, d):
    return odds(spark, d)


# --- pair features ----------------------------------------------------------------------------------------------


@query(f"""select {FEAT} round(max(p) over w,6) as own_max_p, round(sum(p) over w,6) as own_sum_p, cast(count(*) over w as bigint) as own_n, cast(count(*) filter (where p>=0.5) over w as bigint) as own_n_hi, round(p-max(p) over w,6) as p_gap_own,
 round(case when rev_rk=1 then tgt_second_p else tgt_max_p end,6) as other_best_p, round(p-case when rev_rk=1 then tgt_second_p else tgt_max_p end,6) as p_margin from j window w as (partition by s1_id)""", "j")  # fmt: skip
def pair_feat_context(spark, d):
    return pairs.own_context(joined(spark, d)[0]).select(*pairs.ID, "own_max_p", "own_sum_p", "own_n", "own_n_hi", "p_gap_own", "other_best_p", "p_margin")


JAC = "case when len({0})>0 and len({1})>0 then len(list_intersect({0},{1}))/len(list_distinct(list_concat({0},{1}))) end"


@query(f"""select cast(a.s1_id as bigint) as s1_id, cast(a.tgt_id as bigint) as tgt_id, round(max(case when b.p>=0.5 then jaro_winkler_similarity(a.t.core,b.t.core) end),6) as xs_name_jw, round(max(case when b.p>=0.5 then {JAC.format('a.tat', 'b.tat')} end),6) as xs_addr_jacc,
 cast(coalesce(max(case when b.p>=0.5 then (a.t.head<>'' and a.t.head=b.t.head)::int end),-1) as bigint) as xs_num_eq, cast(count(*) filter (where jaro_winkler_similarity(a.t.core,b.t.core)>=0.95) as bigint) as n_twins from j a join j b on a.s1_id=b.s1_id and a.tgt_id<>b.tgt_id group by a.s1_id, a.tgt_id""", "j")  # fmt: skip
def pair_feat_cluster(spark, d):
    return pairs.cluster(joined(spark, d)[0])


@query(f"""select {FEAT} round(jaro_winkler_similarity(s.core,t.core),6) as name_jw, round(jaro_winkler_similarity(s.solid,t.solid),6) as cmp_jw, round({JAC.format('snt', 'tnt')},6) as name_jacc,
 cast((split_part(s.core,' ',1)=split_part(t.core,' ',1))::int as bigint) as first_tok_eq, cast(length(s.core) as bigint) as s_len, cast(length(t.core) as bigint) as t_len, round(coalesce(least(length(s.core),length(t.core))/nullif(greatest(length(s.core),length(t.core)),0),0),6) as len_ratio,
 round(coalesce(1-levenshtein(s.solid,t.solid)/nullif(greatest(length(s.solid),length(t.solid)),0),1),6) as cmp_lev,
 cast(rank() over (partition by s1_id order by jaro_winkler_similarity(s.core,t.core) desc) as bigint) as name_rank, cast(if(t.core='',0,len(string_split(t.core,' '))-len(tnt)) as bigint) as t_dup_toks, cast(if(s.core='',0,len(string_split(s.core,' '))-len(snt)) as bigint) as s_dup_toks from j""", "j")  # fmt: skip
def pair_feat_name(spark, d):
    return pairs.name_features(joined(spark, d)[0]).select(*pairs.ID, "name_jw", "cmp_jw", "name_jacc", "first_tok_eq", "s_len", "t_len", "len_ratio", "cmp_lev", "name_rank", "t_dup_toks", "s_dup_toks")


ALPHA = "list_filter(list_distinct(string_split(regexp_replace({0},'[0-9]+','','g'),' ')), lambda x: x<>'')"


@query(f"""select {FEAT} round(jaro_winkler_similarity(s.addr,t.addr),6) as addr_jw, round({JAC.format('sat', 'tat')},6) as addr_jacc, round({JAC.format(ALPHA.format('s.addr'), ALPHA.format('t.addr'))},6) as addr_alpha_jacc,
 cast(if('' in (s.addr, t.addr), -1, (string_split(s.addr,' ')[-1]=string_split(t.addr,' ')[-1])::int) as bigint) as addr_last_eq, cast(rank() over (partition by s1_id order by jaro_winkler_similarity(s.addr,t.addr) desc) as bigint) as addr_rank,
 cast(coalesce((s.post = t.post)::int, -1) as bigint) as pc_match from j""", "j")  # fmt: skip
def pair_feat_addr(spark, d):
    return pairs.address_features(joined(spark, d)[0]).select(*pairs.ID, "addr_jw", "addr_jacc", "addr_alpha_jacc", "addr_last_eq", "addr_rank", "pc_match")


@query(f"""select {FEAT} cast(len(list_filter(sn, lambda x: list_contains(tn, x))) as bigint) as num_shared, cast(len(sn) as bigint) as s_nums, cast(len(tn) as bigint) as t_nums,
 cast(if(gone, -1, (s.head=t.head)::int) as bigint) as first_num_cmp, round(if(gone, null, ln(1+abs(try_cast(s.head as double)-try_cast(t.head as double)))),6) as num_absdiff_log, cast(if(gone, null, levenshtein(s.head,t.head)) as bigint) as num_lev,
 cast(if(gone, -1, (s.head<>t.head and (prefix(s.head,t.head) or prefix(t.head,s.head) or suffix(s.head,t.head) or suffix(t.head,s.head)))::int) as bigint) as num_trunc
 from (select *, list_distinct(s.nums) as sn, list_distinct(t.nums) as tn, '' in (s.head, t.head) as gone from j)""", "j")  # fmt: skip
def pair_feat_number(spark, d):
    return pairs.number_features(joined(spark, d)[0]).select(*pairs.ID, "num_shared", "s_nums", "t_nums", "first_num_cmp", "num_absdiff_log", "num_lev", "num_trunc")


@query(f"""select {FEAT} round(coalesce(sum(v) filter (where sh),0),6) as idf_shared, round(coalesce(sum(v) filter (where sh),0)/nullif(sum(v),0),6) as name_idf_jacc, round(coalesce(max(v) filter (where not sh),0),6) as idf_unshared_max, cast(count(*) filter (where not sh) as bigint) as name_n_unshared
 from (select s1_id, tgt_id, coalesce(idf,15.0)::double as v, sh from (select s1_id, tgt_id, land, tok, list_contains(snt,tok) and list_contains(tnt,tok) as sh from (select s1_id, tgt_id, t.land as land, snt, tnt, unnest(list_distinct(list_concat(snt,tnt))) as tok from j)) x left join nidf n on n.c=x.land and n.tok=x.tok) group by s1_id, tgt_id""", "nidf")  # fmt: skip
def pair_feat_idf(spark, d):
    j, k, s1, t = joined(spark, d)
    return pairs.idf_overlap(j, context.idf(k, "name_core"), "s_core", "t_core", "name")


@query(f"""select {FEAT} round(coalesce(max(lo) filter (where kind='add'),0),6) as add_lo_max, round(coalesce(min(lo) filter (where kind='add'),0),6) as add_lo_min, round(coalesce(sum(lo) filter (where kind='add'),0),6) as add_lo_sum, cast(count(*) filter (where kind='add') as bigint) as n_added,
 round(coalesce(max(lo) filter (where kind='drop'),0),6) as drop_lo_max, round(coalesce(min(lo) filter (where kind='drop'),0),6) as drop_lo_min, round(coalesce(sum(lo) filter (where kind='drop'),0),6) as drop_lo_sum, cast(count(*) filter (where kind='drop') as bigint) as n_dropped
 from (select s1_id, tgt_id, x.kind, coalesce(o.lo,0) as lo from (select s1_id, tgt_id, 'add' as kind, unnest(list_filter(tnt, lambda t: not list_contains(snt,t))) as tok from j union all select s1_id, tgt_id, 'drop', unnest(list_filter(snt, lambda t: not list_contains(tnt,t))) from j) x left join odds o on o.kind=x.kind and o.tok=x.tok) group by s1_id, tgt_id""", "odds")  # fmt: skip
def pair_feat_odds(spark, d):
    return pairs.odds_features(joined(spark, d)[0], odds(spark, d))


@query(f"""select {FEAT} cast((b_up and not b_low)::int as bigint) as t_all_caps, cast((a_up and not a_low)::int as bigint) as s_all_caps, cast((b_up and b_low)::int as bigint) as t_mixed_case, cast((b_low and not b_up)::int as bigint) as t_lower,
 cast(regexp_matches(b,'[()\\[\\]#*]')::int as bigint) as t_symbols, cast((lower(a)=lower(b))::int as bigint) as raw_name_eq_ci, cast(length(b)-length(a) as bigint) as raw_len_diff
 from (select *, a<>upper(a) as a_low, a<>lower(a) as a_up, b<>upper(b) as b_low, b<>lower(b) as b_up from (select s1_id, tgt_id, regexp_replace(coalesce(s.raw,''),'[^ -~]','?','g') as a, regexp_replace(coalesce(t.raw,''),'[^ -~]','?','g') as b from j))""", "j")  # fmt: skip
def pair_feat_format(spark, d):
    j, k, s1, t = joined(spark, d)
    raw = context.raw_names(k).withColumn("raw", F.regexp_replace("raw", "[^ -~]", "?"))  # engines differ in other cases
    return pairs.format_features(j, raw).select(*pairs.ID, "t_all_caps", "s_all_caps", "t_mixed_case", "t_lower", "t_symbols", "raw_name_eq_ci", "raw_len_diff")


LF = "list_filter(string_split({0},' '), lambda x: list_contains([" + ",".join(f"'{x}'" for x in pairs.LEGAL) + "], x))"


@query(f"""select {FEAT} cast((k='same')::int as bigint) as lf_same, cast((k='dropped')::int as bigint) as lf_dropped, cast((k='added')::int as bigint) as lf_added, cast((k='subset')::int as bigint) as lf_subset, cast((k='changed')::int as bigint) as lf_changed from (
 select s1_id, tgt_id, case when len(a)+len(b)=0 then 'none' when a=b then 'same' when len(b)=0 then 'dropped' when len(a)=0 then 'added' when len(list_distinct(a))<>len(list_distinct(b)) and (list_has_all(a,b) or list_has_all(b,a)) then 'subset' else 'changed' end as k
 from (select s1_id, tgt_id, {LF.format('x')} as a, {LF.format('y')} as b from (select s1_id, tgt_id, s.core as x, t.core as y from j union all select * from {literals(FORMS)})))""", "j")  # fmt: skip
def pair_feat_legal(spark, d):
    j = joined(spark, d)[0].select(*pairs.ID, "s_name", "t_name").unionByName(spark.createDataFrame(FORMS, "s1_id long, tgt_id long, s_name string, t_name string"))
    return pairs.legal_transition(j).select(*pairs.ID, "lf_same", "lf_dropped", "lf_added", "lf_subset", "lf_changed")


@query()
def pair_feat_fuzzy(spark, d):
    return pairs.fuzzy_features(joined(spark, d)[0]).select(*pairs.ID, *pairs.FUZZY)


@query()
def pair_features_all(spark, d):
    rev, k, s1, t = competed(spark, d)
    return pairs.build(rev, s1, t, context.idf(k, "name_core"), context.idf(k, "addr_v2"), odds(spark, d), context.raw_names(k), keep=stages(spark, d).write)


# --- decisions and output ---------------------------------------------------------------------------------------


@query("select cast(s1_id as bigint) as s1_id, cast(tgt_id as bigint) as tgt_id, q from decided", "decided")
def decide_one_to_many(spark, d):
    return decided(spark, d)[0]


@query("select cast(s1_id as bigint) as s1_id, cast(tgt_id as bigint) as tgt_id, q from (select *, row_number() over (partition by s1_id order by q desc, tgt_id) as n from decided) where n=1 or q>=0.8", "decided")
def extra_match_rule(spark, d):
    return decide.extra_match(decided(spark, d)[0])


@query("select cast(s1_id as bigint) as s1_id, cast(tgt_id as bigint) as tgt_id, q from (select *, row_number() over (partition by s1_id order by q desc, tgt_id) as n from q) where q >= case when n=1 then 0.4 else 0.7 end", "q")
def rule_top_and_rest(spark, d):
    return decide.rule_a(cut(spark, d)[0].select("s1_id", "tgt_id", F.col("p").alias("q")), 0.4, 0.7)


@query("select cast(s1_id as bigint) as s1_id, cast(tgt_id as bigint) as tgt_id, q from (select *, max(q) over (partition by s1_id) as b from q) where q >= 0.4 and q >= 0.75*b", "q")
def rule_relative(spark, d):
    return decide.rule_b(cut(spark, d)[0].select("s1_id", "tgt_id", F.col("p").alias("q")), 0.4, 0.75)


@query("""select cast(s1_id as bigint) as s1_id, cast(tgt_id as bigint) as tgt_id, q, cast(k as bigint) as k from (select *, min(case when ef=top then k end) over (partition by s1_id) as kb from (select *, max(ef) over (partition by s1_id) as top from (
 select *, row_number() over o as k, round(1.25*sum(a) over (partition by s1_id order by q desc, tgt_id rows unbounded preceding)/(0.25*(sum(a) over (partition by s1_id))+row_number() over o),9) as ef, exp(sum(ln(1-a)) over (partition by s1_id)) as e0
 from (select *, least(q,1-1e-12) as a from q) window o as (partition by s1_id order by q desc, tgt_id)))) where k<=kb and top>e0""", "q")  # fmt: skip
def expected_f05(spark, d):
    return decide.expected_f05(cut(spark, d)[0].select("s1_id", "tgt_id", F.col("p").alias("q")))


@query("""select cast(count(*) as bigint) as n_s1, round(avg(f),6) as macro_f05, round(avg(f) filter (where nt=0),6) as singleton_f05, round(avg(f) filter (where nt>0),6) as matched_f05, round(sum(tp)/nullif(sum(np),0),6) as micro_precision, round(sum(tp)/nullif(sum(nt),0),6) as micro_recall, round(avg(np),6) as avg_pred
 from (select *, case when nt=0 and np=0 then 1 when tp=0 then 0 else 1.25*tp/(np+0.25*nt) end as f from ents)""", "ents")  # fmt: skip
def macro_f05(spark, d):
    m, s1, t = decided(spark, d)
    return evaluate.summary(evaluate.per_entity(s1.select(eid("entity_id").alias("s1_id")), truth(keys(spark, d)), m))


SUBMISSION = "select s.entity_id as source1_entity_id, coalesce(l,'') as matched_entity_ids from k s left join (select s1_id, string_agg(entity_id, ',' order by entity_id) as l from decided join k on k.id=tgt_id group by s1_id) on s1_id=s.id where s.src=1"


@query(SUBMISSION, "decided")
def submission(spark, d):
    m, s1, t = decided(spark, d)
    return decide.submission(s1, m, t.select(eid("entity_id").alias("tgt_id"), "entity_id"))


@query("""select * from (values ('duplicate_s1','error',cast(1 as bigint),'S1-x'), ('extra_s1','error',1,'S1-x'), ('wrong_prefix','error',1,'bad')) v(rule, severity, n, example)
 union all select 'missing_s1', 'error', cast(count(*) as bigint), min(entity_id) from k where src=1 and id%7=0""", "decided")  # fmt: skip
def validate_submission(spark, d):
    m, s1, t = decided(spark, d)
    sub = decide.submission(s1, m, t.select(eid("entity_id").alias("tgt_id"), "entity_id")).where(eid("source1_entity_id") % 7 != 0)
    rows = sub.select(F.lit(1).cast("long").alias("line_no"), F.concat_ws("\t", *sub.columns).alias("line"))
    odd = spark.createDataFrame([(0, "source1_entity_id\tmatched_entity_ids"), (2, "S1-x\tbad"), (3, "S1-x\t")], "line_no long, line string")
    return validate.problems(rows.unionByName(odd), s1)


# --- text, mining, models, audits -------------------------------------------------------------------------------


@query()
def normalize_text(spark, d):
    return tx.build_keys(records(spark, d, whole=True))


@query(r"select entity_id, addr, nullif(regexp_extract(addr,'\d+'),'') as num from k", "k")
def address_numbers(spark, d):
    return keys(spark, d).select("entity_id", F.col("addr_v2").alias("addr"), F.nullif(first_number("addr_v2"), F.lit("")).alias("num"))


@query()
def skeletons(spark, d):
    return tx.build_keys(records(spark, d, whole=True)).select("entity_id", tx.text_udf(tx.skeleton)("name_core").alias("skeleton"))


@query()
def scripts(spark, d):
    return records(spark, d, whole=True).select("entity_id", F.array_join(tx.text_udf(tx.scripts_of, "array<string>")("business_name"), ",").alias("scripts"))


def known_pairs(spark, d):
    r = keys(spark, d).select(eid("entity_id").alias("id"), "business_name", "name_v2")
    p = truth(keys(spark, d))
    s = r.select(F.col("id").alias("s1_id"), F.col("business_name").alias("s_raw"), F.col("name_v2").alias("s_name"))
    t = r.select(F.col("id").alias("tgt_id"), F.col("business_name").alias("t_raw"), F.col("name_v2").alias("t_name"))
    return p.join(s, "s1_id").join(t, "tgt_id")


def true_names(spark, d):
    """Names of true pairs, and NAME_PAIRS."""
    p = known_pairs(spark, d).select(F.col("s_name").alias("s"), F.col("t_name").alias("t"))
    return p.unionByName(spark.createDataFrame(NAME_PAIRS, "s string, t string"))


PAIRS = "truth p join k s on s.id=s1_id join k t on t.id=tgt_id"
NAMED_PAIRS = f"(select s.name as x, t.name as y from {PAIRS} union all select * from {literals(NAME_PAIRS)})"
WORDS = r"list_filter(regexp_split_to_array({0},'[\s.,;:()\[\]/\\\-|''\"]+'), lambda x: x<>'')"


@query(f"""select w, e, cast(n as bigint) as n, round(conf,6) as conf from (select *, row_number() over (partition by w order by n desc, e) as r from (select w, e, count(*) as n, count(*)/sum(count(*)) over (partition by w) as conf from (
 select unnest(a) as e, unnest(b) as w from (select {WORDS.format('x')} as a, {WORDS.format('y')} as b from (select s.raw as x, t.raw as y from {PAIRS} union all select * from {literals(WORD_PAIRS)})) where len(a)=len(b)) where regexp_matches(w,'[^\\x00-\\x7F]') group by w, e) where n>=2 and conf>=0.5 and length(w)>=2) where r=1""", "truth")  # fmt: skip
def mine_aligned_tokens(spark, d):
    p = known_pairs(spark, d).select(F.col("s_raw").alias("s"), F.col("t_raw").alias("t"))
    return mining.aligned_tokens(p.unionByName(spark.createDataFrame(WORD_PAIRS, "s string, t string")), 2, 0.5)


@query(f"""select variant, canonical, cast(n as bigint) as n, round(conf,6) as conf from (select *, row_number() over (partition by variant order by n desc, canonical) as r from (select variant, canonical, count(*) as n, count(*)/sum(count(*)) over (partition by variant) as conf from (
 select unnest(a) as canonical, unnest(b) as variant from (select list_filter(x, lambda t: not list_contains(y,t)) as a, list_filter(y, lambda t: not list_contains(x,t)) as b from (select string_split(x,' ') as x, string_split(y,' ') as y from {NAMED_PAIRS})) where len(a)=len(b) and len(a) between 1 and 3)
 where variant[1]=canonical[1] and not regexp_matches(variant||canonical,'[0-9]') group by variant, canonical) where n>=1 and conf>=0.3) where r=1 and canonical not in (select variant from (select unnest(b) as variant from (select list_filter(y, lambda t: not list_contains(x,t)) as b, list_filter(x, lambda t: not list_contains(y,t)) as a from (select string_split(x,' ') as x, string_split(y,' ') as y from {NAMED_PAIRS})) where len(a)=len(b) and len(a) between 1 and 3))""", "truth")  # fmt: skip
def mine_variants(spark, d):
    return mining.variants(true_names(spark, d), 1, 0.3)


@query()
def entity_split(spark, d):
    return mining.entity_split(split(keys(spark, d))[0].select(eid("entity_id").alias("s1_id")))


@query()
def exact_n_sample(spark, d):
    return mining.exact_sample(split(keys(spark, d))[0].select(eid("entity_id").alias("s1_id")), 50, "s1_id")


@query()
def gbt_matcher(spark, d):
    """Fitted on one part of the entities, scored on all; rows-only."""
    f = reranked(spark, d)[0].drop("p").join(truth(keys(spark, d)).withColumn("y", F.lit(1.0)), ["s1_id", "tgt_id"], "left").na.fill(0.0, ["y"])
    f, names = models.prepared(f, rerank.FEATURES)
    f = stages(spark, d).write(mining.entity_split(f).withColumn("valid", F.col("split") == "valid"), "matcher")
    return models.score([models.fit(f, names, trees=8, depth=3, valid="valid")], f).select("s1_id", "tgt_id", "y", "q")


@query("""select stage, cast(count(*) as bigint) as n from (select case when not exists (select 1 from cand c where c.s1_id=t.s1_id and c.tgt_id=t.tgt_id) then 'blocking' when not exists (select 1 from cut c where c.s1_id=t.s1_id and c.tgt_id=t.tgt_id) then 'cut'
 when not exists (select 1 from decided c where c.s1_id=t.s1_id and c.tgt_id=t.tgt_id) then 'decision' else 'found' end as stage from truth t) group by stage""", "decided")  # fmt: skip
def audit_loss_stage(spark, d):
    c, k, s1, t = candidates(spark, d)
    u = cut(spark, d)[0]
    x = truth(keys(spark, d))
    for n, f in (("a", c), ("b", u), ("c", decided(spark, d)[0])):
        x = x.join(f.select(*pairs.ID, F.lit(True).alias(n)), pairs.ID, "left")
    stage = F.when(F.col("a").isNull(), "blocking").when(F.col("b").isNull(), "cut").when(F.col("c").isNull(), "decision").otherwise("found")
    return x.groupBy(stage.alias("stage")).agg(F.count("*").alias("n"))


@query("""select kind, cast(count(*) as bigint) as n, round(avg(p),6) as avg_p from (select p, case when y then 'true' when t.owner is null then 'unowned' else 'owned by another' end as kind from cut join matched using (s1_id,tgt_id)) group by kind""", "cut")
def audit_distractors(spark, d):
    c, k, s1, t = cut(spark, d)
    o = t.select(eid("entity_id").alias("tgt_id"), eid("owner").alias("own"))
    kind = F.when(F.col("own") == F.col("s1_id"), "true").when(F.col("own").isNull(), "unowned").otherwise("owned by another")
    return c.join(o, "tgt_id").groupBy(kind.alias("kind")).agg(F.count("*").alias("n"), F.avg("p").alias("avg_p"))


@query("""select shape, cast(count(*) as bigint) as n from (select case when '' in (s.head, t.head) then 'missing' when s.head=t.head then 'equal' when abs(cast(s.head as double)-cast(t.head as double)) between 1 and 10 then 'near' when length(s.head)=length(t.head) then 'same length' else 'far' end as shape from j) group by shape""", "j")
def audit_number_shape(spark, d):
    s, t = F.col("s_first"), F.col("t_first")
    gap = F.abs(s.try_cast("double") - t.try_cast("double"))
    shape = F.when((s == "") | (t == ""), "missing").when(s == t, "equal").when(gap.between(1, 10), "near").when(F.length(s) == F.length(t), "same length").otherwise("far")
    return joined(spark, d)[0].groupBy(shape.alias("shape")).agg(F.count("*").alias("n"))


@query("""select cast(src as bigint) as src, cast(count(*) as bigint) as targets, cast(sum((id in (select tgt_id from cand))::int) as bigint) as in_candidates, cast(sum((id in (select tgt_id from decided))::int) as bigint) as matched from k where src>1 group by src""", "decided")
def audit_target_coverage(spark, d):
    c, k, s1, t = candidates(spark, d)
    x = t.select(eid("entity_id").alias("tgt_id"))
    for n, f in (("a", c), ("b", decided(spark, d)[0])):
        x = x.join(f.select("tgt_id", F.lit(1).alias(n)).distinct(), "tgt_id", "left")
    return x.groupBy(src_of("tgt_id").alias("src")).agg(F.count("*").alias("targets"), F.count("a").alias("in_candidates"), F.count("b").alias("matched"))


@query(f"select tok, cast(count(*) as bigint) as n from (select unnest(list_filter(list_distinct(string_split(x,' ')), lambda t: t <> '' and not list_contains(string_split(y,' '),t))) as tok from {NAMED_PAIRS}) group by tok", "truth")
def audit_missing_tokens(spark, d):
    tok = lambda c: F.filter(F.array_distinct(F.split(c, " ")), lambda t: t != "")
    return true_names(spark, d).select(F.explode(F.array_except(tok("s"), tok("t"))).alias("tok")).groupBy("tok").agg(F.count("*").alias("n"))


@query("select round(cast(tau as double),6) as tau, country, cast(n as bigint) as n from (select tau, c as country, count(*) as n from cut join k on k.id=s1_id, (values (0.4),(0.6),(0.8)) v(tau) where p>=tau group by all)", "cut")
def threshold_sweep(spark, d):
    c, k, s1, t = cut(spark, d)
    x = c.join(s1.select(eid("entity_id").alias("s1_id"), F.col("country_key").alias("country")), "s1_id")
    taus = F.filter(F.array(*[F.lit(v) for v in (0.4, 0.6, 0.8)]), lambda v: F.col("p") >= v)
    return x.select("country", F.explode(taus).alias("tau")).groupBy("tau", "country").agg(F.count("*").alias("n"))


# --- the whole job ----------------------------------------------------------------------------------------------

CAPPED = [
    "key_blocks_capped", "candidates_topk", "blocking_eval", "exact_key_blocking", "token_idf_blocking", "rerank_features", "adaptive_cut", "competition_context", "token_log_odds", "pair_feat_context", "pair_feat_cluster",
    "pair_feat_name", "pair_feat_addr", "pair_feat_number", "pair_feat_idf", "pair_feat_odds", "pair_feat_format", "pair_feat_legal", "pair_feat_fuzzy", "pair_features_all", "decide_one_to_many", "extra_match_rule", "rule_top_and_rest",
    "rule_relative", "expected_f05", "macro_f05", "submission", "validate_submission", "gbt_matcher", "audit_loss_stage", "audit_distractors", "audit_number_shape", "audit_target_coverage", "threshold_sweep",
]
QUERIES |= {f"{n}_whole" if n in ORACLES else n: whole(QUERIES[n]) for n in CAPPED}
ORACLES |= {f"{n}_whole": bound(_SQL[n], WHOLE) for n in CAPPED if n in _SQL}
