"""Audit and normalization queries, each with its SQL twin; importing this module registers them in the catalogue.

Audits of candidates run at the operators' own caps. Where the data hold nothing of a kind - legal forms, variants,
placeholders - query and SQL add the same few rows.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from cairn.functions import columns
from cairn.functions.columns import eid
from cairn.operators import audits, mining, pairs
from cairn.plans import catalogue as cat
from cairn.plans import chain
from cairn.plans.catalogue import JAC, LF, ORACLES, QUERIES, query
from cairn.plans.oracles import WHOLE, bound
from cairn.plans.records import table, truth
from cairn.sources.tables import file_bytes

COUNTRIES = ["de", "en", "es", "fr"]
RULES = [(0.4, 0.5), (0.5, 0.6), (0.6, 0.7)]
#: Rows that the data lack: kind, name of S1, name of the target.
LEGAL_PAIRS = [
    ("true", "acme private limited", "acme private limited"), ("true", "acme limited", "acme"), ("true", "acme", "acme llc"), ("true", "zen llc", "zen llc west"),
    ("unowned", "acme private limited", "acme limited"), ("unowned", "acme llc", "acme limited"), ("unowned", "zen llc", "zen limited west"), ("owned by another", "zen sarl", "zen sas west"),
]
WORDS = ["hea1th", "6reat", "21b", "101a", "1st", "a1", "3m", "5ch00l", "b00k", "x7yz", "hotels", "lotus", "genesis", "glass", "bus", "partners", "taxis", "axes"]
NUMBERS = ["0012 main 007 road", "10 0 00 000", "no zeros 120", "a01 01a 0x1"]
SCRIPT_PAIRS = [("Aditya Private Limited", "आदित्य प्राइवेट लिमिटेड"), ("Aditya Stores", "आदित्य स्टोर्स"), ("Ram", "राम and sons"), ("Zen Tea", "Zen ティー")]
SCRIPT_DICTIONARY = [("आदित्य", "aditya"), ("लिमिटेड", "limited"), ("स्टोर्स", "store"), ("राम", "ram")]


def values(rows: list) -> str:
    """Rows as SQL literals."""
    lit = lambda v: "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)
    return ", ".join("(" + ", ".join(map(lit, r if isinstance(r, tuple) else (r,))) + ")" for r in rows)


def audit(oracle: str, upto: str):
    """Register under the function's name, at whole caps on both sides."""

    def add(f):
        query(oracle, upto)(f)
        QUERIES[f.__name__] = cat.whole(QUERIES[f.__name__])
        ORACLES[f.__name__] = bound(cat._SQL[f.__name__], WHOLE)
        return f

    return add


def avg(condition: str, name: str) -> str:
    return f"round(avg(coalesce({condition}, false)::int), 6) as {name}"


N = "cast(count(*) as bigint) as"
RAW = "(select k.*, business_name as bn, business_address as ba, country from k join rec using (entity_id))"
BOTH = "truth p join k s on s.id = p.s1_id join k t on t.id = p.tgt_id"
TOKS = "list_filter(string_split({0},' '), lambda x: length(x) >= 2 or regexp_full_match(x,'[0-9]+'))"


@audit(f"""select {N} pairs, {avg('s.bn = t.bn', 'raw_name')}, {avg('lower(trim(s.bn)) = lower(trim(t.bn))', 'folded_name')}, {avg('s.name = t.name', 'key_name')},
 {avg('s.ba = t.ba', 'raw_address')}, {avg('lower(trim(s.ba)) = lower(trim(t.ba))', 'folded_address')}, {avg('s.addr = t.addr', 'key_address')}
 from truth p join {RAW} s on s.id = p.s1_id join {RAW} t on t.id = p.tgt_id""", "truth")  # fmt: skip
def audit_exact_rates(spark, d):
    k = cat.keys(spark, d)
    return audits.exact_rates(truth(k), k)


@audit(f"select lower(trim(business_name)) as name, {N} records from rec where lower(trim(business_name)) <> '' group by 1 having count(*) > 1 order by records desc, name limit 20", "rec")
def audit_repeated_names(spark, d):
    return audits.repeated_names(cat.keys(spark, d))


@audit(f"""select cast(src as bigint) as src, c as country_key, {N} n, {avg("regexp_matches(bn,'[^ -~]') and regexp_matches(bn,'[^' || chr(1) || '-' || chr(127) || ']')", 'name_beyond_ascii')},
 {avg("regexp_matches(ba,'[^' || chr(1) || '-' || chr(127) || ']')", 'addr_beyond_ascii')}, {avg('name is null', 'name_null')}, {avg('addr is null', 'addr_null')}, {avg('pc is not null', 'postcode')},
 {avg("contains(replace(lower(ba),' ',''),'<null>')", 'addr_placeholder')} from {RAW} group by src, c""", "k")  # fmt: skip
def audit_corpus_profile(spark, d):
    return audits.corpus_profile(cat.keys(spark, d))


@audit(f"""select cast(t.src as bigint) as src, s.c as country, {N} pairs, {avg('s.name = t.name', 'name_exact')}, {avg(f"list_has_any({TOKS.format('s.name')}, {TOKS.format('t.name')})", 'name_token')},
 {avg(f"list_has_any({TOKS.format('s.addr')}, {TOKS.format('t.addr')})", 'addr_token')}, {avg(f"not list_has_any({TOKS.format('s.name')}, {TOKS.format('t.name')}) and not list_has_any({TOKS.format('s.addr')}, {TOKS.format('t.addr')})", 'nothing')},
 round(avg((s.pc = t.pc)::int), 6) as postcode_when_both from {BOTH} group by 1, 2""", "truth")  # fmt: skip
def audit_token_sharing(spark, d):
    k = cat.keys(spark, d)
    return audits.token_sharing(truth(k), k)


@audit(f"select s.c as country, cast(t.src as bigint) as src, {N} pairs, {avg('rk <= 5', 'at_5')}, {avg('rk <= 20', 'at_20')}, {avg('rk <= 50', 'at_50')} from {BOTH} left join cand using (s1_id, tgt_id) group by 1, 2", "cand")
def audit_recall_at(spark, d):
    c, k, s1, t = cat.candidates(spark, d)
    return audits.recall_at(truth(k), c, k)


MISS = "(select p.*, case when rk is null then 'not retrieved' else 'ranked low' end as kind from truth p left join cand using (s1_id, tgt_id) where coalesce(rk, 99) > 1)"
SIDE = "(select id, coalesce(name,'') as core, replace(coalesce(name,''),' ','') as solid, array_to_string(list_sort(list_filter(list_distinct(string_split(coalesce(name,''),' ')), lambda x: x <> '')),' ') as bag, c, addr, name from k)"


@audit(f"""select kind, {N} n, {avg('core', 'core')}, {avg('cmp', 'cmp')}, {avg('srt', 'srt')}, {avg('p8', 'p8')}, {avg('s8', 's8')}, {avg('core or cmp or srt or p8 or s8', 'any_key')}
 from (select kind, s.core = t.core as core, s.solid = t.solid as cmp, s.bag = t.bag as srt, least(length(s.solid),length(t.solid)) >= 10 and s.solid[:8] = t.solid[:8] as p8, least(length(s.solid),length(t.solid)) >= 10 and right(s.solid,8) = right(t.solid,8) as s8
 from {MISS} m join {SIDE} s on s.id = s1_id join {SIDE} t on t.id = tgt_id) group by kind""", "cand")  # fmt: skip
def audit_miss_taxonomy(spark, d):
    c, k, s1, t = cat.candidates(spark, d)
    return audits.miss_taxonomy(audits.missed(truth(k), c, 1), k)


@audit(f"select cast(a as bigint) as n_s2, cast(b as bigint) as n_s3, {N} n_s1 from (select k.id, count(tgt_id) filter (where tgt_id//100000000000 = 2) as a, count(tgt_id) filter (where tgt_id//100000000000 = 3) as b from k left join truth on s1_id = k.id where src = 1 group by k.id) group by a, b", "truth")
def audit_matches_per_source(spark, d):
    k = cat.keys(spark, d)
    return audits.matches_per_source(truth(k), cat.split(k)[0].select(eid("entity_id").alias("s1_id")))


@audit(f"select {N} unowned, {avg('id in (select tgt_id from cut where p >= 0.5)', 'claimed')} from k where src > 1 and id not in (select tgt_id from truth)", "cut")
def audit_unowned_claimed(spark, d):
    c, k, s1, t = cat.cut(spark, d)
    return audits.unowned_claimed(t, truth(k), c)


def named_pairs(spark, d):
    """Pairs of the cut by kind, with both names, and LEGAL_PAIRS."""
    c, k, s1, t = cat.cut(spark, d)
    p = audits.with_sides(audits.kinds(c, truth(k)).select(*pairs.ID, "kind"), k, "name_v2")
    text = lambda x: F.coalesce(f"{x}_name_v2", F.lit("")).alias(f"{x}_name")
    return p.select("kind", text("s"), text("t")).unionByName(spark.createDataFrame(LEGAL_PAIRS, "kind string, s_name string, t_name string"))


NAMED = f"(select case when y then 'true' when t.owner is null then 'unowned' else 'owned by another' end as kind, s.core as a, t.core as b from cut join matched using (s1_id, tgt_id) union all select * from (values {values(LEGAL_PAIRS)}))"
MOVE = f"""(select kind, a = b as same, len(a) > 0 and len(b) = 0 as dropped, len(a) = 0 and len(b) > 0 as added, len(a) > 0 and len(b) > 0 and a <> b and (list_has_all(a, b) or list_has_all(b, a)) and len(list_distinct(a)) <> len(list_distinct(b)) as subset, len(a) + len(b) = 0 as none
 from (select kind, {LF.format('a')} as a, {LF.format('b')} as b from {NAMED}))"""


@audit(f"""select kind, {N} n, {avg('none', 'none')}, {avg('same and not none', 'same')}, {avg('dropped', 'dropped')}, {avg('added', 'added')}, {avg('subset', 'subset')}, {avg('not (same or dropped or added or subset)', 'changed')} from {MOVE} group by kind""", "cut")
def audit_legal_crosstab(spark, d):
    return audits.legal_crosstab(pairs.legal_transition(named_pairs(spark, d)))


@audit(f"""select tok, cast(n as bigint) as n, round(a, 6) as rate_true, round(b, 6) as rate_unowned, round((b + 1e-4) / (a + 1e-4), 6) as ratio from (select tok, count(*) as n, count(*) filter (where kind = 'true') / max(nt) as a, count(*) filter (where kind = 'unowned') / max(nu) as b
 from (select kind, nt, nu, unnest(list_filter(list_distinct(string_split(b,' ')), lambda x: x <> '' and not list_contains(string_split(a,' '), x))) as tok from {NAMED}, (select count(*) filter (where kind = 'true') as nt, count(*) filter (where kind = 'unowned') as nu from {NAMED}) where kind in ('true', 'unowned')) group by tok having count(*) >= 2)""", "cut")  # fmt: skip
def audit_added_tokens(spark, d):
    return audits.added_tokens(named_pairs(spark, d), 2)


@audit(f"""select {N} pairs, {avg('cc = oc', 'same_core')}, {avg('jo > jc + 0.01', 'owner_name')}, {avg('jc > jo + 0.01', 'cand_name')}, {avg('ao > ac + 0.05', 'owner_addr')}, {avg('ac > ao + 0.05', 'cand_addr')}, {avg('jo > jc + 0.01 or ao > ac + 0.05', 'for_owner')},
 {avg('abs(jo - jc) <= 0.01 and abs(ao - ac) <= 0.05', 'no_signal')} from (select coalesce(s.name,'') as cc, coalesce(o.name,'') as oc, jaro_winkler_similarity(coalesce(t.name,''),coalesce(o.name,'')) as jo, jaro_winkler_similarity(coalesce(t.name,''),coalesce(s.name,'')) as jc,
 coalesce({JAC.format('v.adt', 'w.adt')}, 0) as ao, coalesce({JAC.format('v.adt', 'u.adt')}, 0) as ac from cut join truth g on g.tgt_id = cut.tgt_id and g.s1_id <> cut.s1_id
 join k s on s.id = cut.s1_id join k t on t.id = cut.tgt_id join k o on o.id = g.s1_id join tl u on u.id = s.id join tl v on v.id = t.id join tl w on w.id = o.id)""", "tl")  # fmt: skip
def audit_contested(spark, d):
    c, k, s1, t = cat.cut(spark, d)
    return audits.contested(audits.kinds(c, truth(k)).where("kind = 'owned by another'"), k)


@audit(f"""select s1_id not in (select s1_id from truth) as singleton, {N} n, round(avg(p), 6) as top_p, {avg('rev_rk > 1', 'owned_by_other')}, round(avg(tgt_max_p - p), 6) as gap
 from (select * from rev qualify row_number() over (partition by s1_id order by p desc, tgt_id) = 1) group by 1""", "rev")  # fmt: skip
def audit_singletons(spark, d):
    r, k, s1, t = cat.competed(spark, d)
    return audits.singletons(r, truth(k), s1.select(eid("entity_id").alias("s1_id")))


@audit(f"""select c as country, {N} n_s1, round(avg(coalesce(nc, 0)), 6) as candidates, round(avg(coalesce(nm, 0)), 6) as matches, {avg('nm is null', 'empty')}, round(avg(coalesce(best, 0)), 6) as best, {avg('best between 0.3 and 0.7', 'uncertain')}, round(avg(coalesce(hi, 0)), 6) as over_half
 from (select id, c from k where src = 1) left join (select s1_id as id, count(*) as nc, max(p) as best, count(*) filter (where p >= 0.5) as hi from cut group by 1) using (id) left join (select s1_id as id, count(*) as nm from decided group by 1) using (id) group by c""", "decided")  # fmt: skip
def audit_country_health(spark, d):
    c, k, s1, t = cat.cut(spark, d)
    return audits.country_health(s1, c, cat.decided(spark, d)[0])


@audit(f"""select outcome, {N} n, {avg('t.lost', 'addr_missing')}, {avg('jaro_winkler_similarity(s.core,t.core) < 0.7', 'name_far')}, {avg(f"coalesce({JAC.format('sat', 'tat')}, 0) < 0.3", 'addr_far')}, {avg("'' not in (s.head, t.head) and s.head <> t.head", 'number_conflict')}, {avg('n_claim > 1', 'contested')},
 {avg('rev_rk > 1', 'not_top')}, {avg('src = 3', 'from_s3')}, {avg('p < 0.5', 'unlikely')} from (select j.*, case when y and m.s1_id is not null then 'TP' when y then 'FN' when m.s1_id is not null then 'FP' end as outcome from j left join decided m on m.s1_id = j.s1_id and m.tgt_id = j.tgt_id) where outcome is not null group by outcome""", "decided")  # fmt: skip
def audit_outcome_profile(spark, d):
    j, k, s1, t = cat.joined(spark, d)
    f = pairs.name_features(pairs.number_features(pairs.address_features(j)))
    return audits.outcome_profile(f, cat.decided(spark, d)[0], truth(k))


JWC = "jaro_winkler_similarity(coalesce({0},''),coalesce({1},''))"


@audit(f"""select kind, {N} n, {avg('t.addr is null', 'addr_missing')}, {avg('s.name = t.name', 'exact_core')}, round(avg({JWC.format('s.name', 't.name')}), 6) as name_jw, round(avg(coalesce({JAC.format('u.adt', 'v.adt')}, 0)), 6) as addr_jacc, {avg('w >= 0.92 or a >= 0.5', 'near_sibling')}
 from {MISS} m join k s on s.id = m.s1_id join k t on t.id = m.tgt_id join tl u on u.id = s.id join tl v on v.id = t.id left join (select m.s1_id, m.tgt_id, max({JWC.format('x.name', 'y.name')}) as w, max({JAC.format('xt.adt', 'yt.adt')}) as a
 from {MISS} m join (select d.* from decided d semi join truth using (s1_id, tgt_id)) f on f.s1_id = m.s1_id join k x on x.id = m.tgt_id join k y on y.id = f.tgt_id join tl xt on xt.id = x.id join tl yt on yt.id = y.id group by 1, 2) b on b.s1_id = m.s1_id and b.tgt_id = m.tgt_id group by kind""", "decided")  # fmt: skip
def audit_sibling_proximity(spark, d):
    c, k, s1, t = cat.candidates(spark, d)
    found = cat.decided(spark, d)[0].join(truth(k), pairs.ID, "left_semi")
    return audits.sibling_proximity(audits.missed(truth(k), c, 1), found, k)


RIVAL = "(select r.tgt_id, r.s1_id as rival from rev r join (select p.* from truth p anti join decided using (s1_id, tgt_id)) f on f.tgt_id = r.tgt_id and f.s1_id <> r.s1_id qualify row_number() over (partition by r.tgt_id order by r.p desc, r.s1_id) = 1)"


@audit(f"""select {N} n, {avg('own - riv > 0.02', 'own_nearer')}, {avg('own - riv < -0.02', 'rival_nearer')}, {avg('abs(own - riv) <= 0.02', 'tie')} from (select
 coalesce((select max({JWC.format('a.name', 'b.name')}) from cut x join k a on a.id = f.tgt_id join k b on b.id = x.tgt_id where x.s1_id = f.s1_id and x.tgt_id <> f.tgt_id and x.p >= 0.6), 0) as own,
 coalesce((select max({JWC.format('a.name', 'b.name')}) from cut x join k a on a.id = f.tgt_id join k b on b.id = x.tgt_id where x.s1_id = f.rival and x.tgt_id <> f.tgt_id and x.p >= 0.6), 0) as riv
 from (select * from truth anti join decided using (s1_id, tgt_id) join {RIVAL} using (tgt_id)) f)""", "decided")  # fmt: skip
def audit_competitor_proximity(spark, d):
    r, k, s1, t = cat.competed(spark, d)
    misses = truth(k).join(cat.decided(spark, d)[0], pairs.ID, "left_anti")
    return audits.competitor_proximity(misses, r, k, sure=0.6)


@audit(f"""select round(corr(s1_id % 100000000000, tgt_id % 100000000000), 6) as number_corr, round(corr(a.at, b.at), 6) as place_corr, {avg('abs(a.at - b.at) < 0.001', 'same_place')}
 from truth join (select id, row_number() over (partition by src order by id) / count(*) over (partition by src) as at from k) a on a.id = s1_id join (select id, row_number() over (partition by src order by id) / count(*) over (partition by src) as at from k) b on b.id = tgt_id""", "truth")  # fmt: skip
def audit_leakage(spark, d):
    k = cat.keys(spark, d)
    return audits.leakage(truth(k), k)


RULE_ROWS = ", ".join(f"('{a}/{b}', {a}, {b})" for a, b in RULES)
WON = f"(select rule, more, s1_id, tgt_id, q from q, (values {RULE_ROWS}) v(rule, tau, more) where q >= tau qualify row_number() over (partition by rule, tgt_id order by q desc, s1_id) = 1)"


@audit(f"""select rule, {', '.join(f"round(avg(m) filter (where c = '{c}'), 6) as {c}_matches, round(avg((m = 0)::int) filter (where c = '{c}'), 6) as {c}_empty" for c in COUNTRIES)}
 from (select r.rule, k.c, coalesce(m, 0) as m from (select id, c from k where src = 1) k cross join (values {RULE_ROWS}) r(rule, tau, more)
 left join (select rule, s1_id, count(*) as m from (select *, row_number() over (partition by rule, s1_id order by q desc, tgt_id) as n from {WON}) where n = 1 or q >= more group by all) m on m.rule = r.rule and m.s1_id = k.id) group by rule""", "q")  # fmt: skip
def audit_rule_sweep(spark, d):
    c, k, s1, t = cat.cut(spark, d)
    return audits.rule_sweep(c.select("s1_id", "tgt_id", F.col("p").alias("q")), s1, RULES, COUNTRIES)


# --- normalization that SQL can say, sources and samples -----------------------------------------------------------


def words_of(spark, d):
    """Distinct address tokens and WORDS."""
    t = cat.keys(spark, d).select(F.explode(columns.tokens("addr_v2")).alias("t"))
    return t.unionByName(spark.createDataFrame([(w,) for w in WORDS], "t string")).distinct()


TOKEN_ROWS = f"(select distinct t from (select unnest(string_split(addr,' ')) as t from k union all select * from (values {values(WORDS)})) where t <> '')"


@query(f"""select t, case when regexp_full_match(t,'[a-z0134568]+') and regexp_matches(t,'[0-9]') and length(regexp_replace(t,'[0-9]+','','g')) >= 3 then translate(t,'0134568','oleasgb') else t end as word from {TOKEN_ROWS}""", "k")
def norm_leet(spark, d):
    return words_of(spark, d).select("t", columns.unleet("t").alias("word"))


@query(f"select t, case when length(t) > 4 and t[-1] = 's' and t[-2] not in ('s', 'u', 'i') then t[:-2] else t end as word from {TOKEN_ROWS}", "k")
def norm_stem(spark, d):
    return words_of(spark, d).select("t", columns.stem("t").alias("word"))


@query(f"select addr, array_to_string(list_transform(string_split(addr,' '), lambda x: case when regexp_full_match(x,'[0-9]+') then coalesce(nullif(ltrim(x,'0'),''),'0') else x end),' ') as plain from (select distinct addr from (select addr from k where addr is not null union all select * from (values {values(NUMBERS)})))", "k")
def norm_numbers(spark, d):
    a = cat.keys(spark, d).select(F.col("addr_v2").alias("addr")).where("addr is not null").unionByName(spark.createDataFrame([(x,) for x in NUMBERS], "addr string"))
    return a.distinct().select("addr", columns.plain_numbers("addr").alias("plain"))


@query("select column_name as name, cast(ordinal_position as bigint) as place from information_schema.columns where table_name = 'documents'")
def describe_documents(spark, d):
    table(spark, d, "documents").createOrReplaceTempView("cairn_described")
    found = spark.sql("DESCRIBE QUERY SELECT * FROM cairn_described").select(F.col("col_name").alias("name"))
    order = {c: i + 1 for i, c in enumerate(table(spark, d, "documents").columns)}
    return found.select("name", F.create_map(*[F.lit(x) for kv in order.items() for x in kv])[F.col("name")].alias("place"))


@query()
def dataset_bytes(spark, d):
    return file_bytes(spark, {n: table(spark, d, n) for n in ("orders", "lineitem", "nation")})


@query()
def setting_values(spark, d):
    """Settings as the session has them."""
    names = ["spark.sql.session.timeZone", "spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions"]
    return spark.createDataFrame([(n, str(spark.conf.get(n))) for n in names], "name string, value string")


@query()
def random_rows(spark, d):
    return mining.random_rows(table(spark, d, "orders").select("o_orderkey"), 50, 7)


@query()
def disjoint_samples(spark, d):
    return mining.disjoint_samples(cat.split(cat.keys(spark, d))[0].select(eid("entity_id").alias("s1_id")), {"rerank": 30, "matcher": 60})


@query()
def dictionary_report(spark, d):
    """Of the true pairs and SCRIPT_PAIRS, with the mined dictionary and SCRIPT_DICTIONARY."""
    p = cat.known_pairs(spark, d).select(F.col("s_raw").alias("s"), F.col("t_raw").alias("t")).unionByName(spark.createDataFrame(SCRIPT_PAIRS, "s string, t string"))
    given = spark.createDataFrame(SCRIPT_DICTIONARY, "w string, e string")
    mined = mining.aligned_tokens(p, 2, 0.5).select("w", F.lower("e").alias("e")).join(given, "w", "left_anti")
    return mining.dictionary_report(p, mined.unionByName(given))


# --- the job with trained models -------------------------------------------------------------------------------------


@query()
def linkage_trained(spark, d):
    """Quality of the whole job with real normalization, a trained reranker and a trained matcher, on S1 that neither saw."""
    k = cat.keys(spark, d)
    return chain.link(k.select("entity_id", "business_name", "business_address", "country"), truth(k), cat.stages(spark, d).write, seeds=(1,))["quality"]
