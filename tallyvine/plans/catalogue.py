"""The registered queries over the driver's tables, and their DuckDB equivalents."""

from __future__ import annotations

import functools
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import grade, text
from ..operators import audit, corpus, dedup, metrics, rules, select, split
from ..sources import files, schemas
from ..sources.scratch import fresh_path
from ..streaming.work import append_once, latest, upsert

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str = "") -> Callable:
    """Registers a function by its name, with its SQL where there is one."""

    def keep(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _round(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


# traces: events stand in for graded generations


def _traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("value")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("id"), F.when(F.col("event_type") != "click", F.col("event_type")).alias("category"), (v > 60).alias("correct"), F.floor(v).cast("long").alias("out_tokens"), F.when(v > 250, "throttled").alias("error"))


_T = "t AS (SELECT user_id AS id, CASE WHEN event_type <> 'click' THEN event_type END AS category, value > 60 AS ok, CAST(floor(value) AS BIGINT) AS tok, value > 250 AS err FROM events)"


@query(f"""WITH {_T},
per AS (SELECT category, id, count(*) FILTER (WHERE NOT err) AS gens, count(*) FILTER (WHERE NOT err AND ok) AS hits, count(*) AS calls FROM t GROUP BY 1, 2),
mid AS (SELECT category, list_sort(list(tok))[len(list(tok)) // 2 + 1] AS p50 FROM t WHERE NOT err AND tok <> 0 GROUP BY 1)
SELECT per.category, count(*) FILTER (WHERE gens > 0) AS n_prob, CAST(sum(gens) AS BIGINT) AS n_gen, round(sum(hits) / sum(gens), 6) AS pass1,
       round(count(*) FILTER (WHERE hits > 0) / count(*) FILTER (WHERE gens > 0), 6) AS pass_any, CAST(sum(calls) AS BIGINT) AS calls,
       CAST(sum(calls) - sum(gens) AS BIGINT) AS errors, coalesce(any_value(mid.p50), 0) AS tok_p50
FROM per LEFT JOIN mid ON mid.category IS NOT DISTINCT FROM per.category GROUP BY 1""")
def yield_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(metrics.yield_table(_traces(spark, sf_dir), ["category"]), "pass1", "pass_any")


_DEC = "CAST(CAST(floor(l_extendedprice) AS BIGINT) AS VARCHAR)"
_TEXT = f"""CASE l_linenumber % 6 WHEN 0 THEN 'it is ' || {_DEC} || ' or so'
WHEN 1 THEN 'so \\boxed{{' || {_DEC} || '}}' WHEN 2 THEN '\\boxed{{1}} then \\boxed{{ ' || {_DEC} || ' }}.'
WHEN 3 THEN 'about ' || {_DEC} || ' \\boxed{{}}' WHEN 4 THEN '\\boxed{{\\frac{{{{{{{{{{' || {_DEC} || '}}}}}}}}}}{{2}}}}' ELSE '\\boxed{{' || {_DEC} || '}} and \\boxed{{7' END"""


def _box_sql() -> str:
    return text.box_pattern(7).removeprefix("(?s)")


@query(f"""WITH t AS (SELECT l_orderkey, l_linenumber, {_TEXT} AS txt FROM lineitem),
b AS (SELECT *, nullif(regexp_replace(regexp_extract(txt, '{_box_sql()}', 1, 's'), '^\\s+|\\s+$', '', 'g'), '') AS box FROM t)
SELECT l_orderkey, l_linenumber, coalesce(box, regexp_extract_all(txt, '{text.NUMBER}')[-1]) AS answer, contains(txt, '\\boxed{{') AS boxed FROM b""")
def extract_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _boxed_texts(spark, sf_dir)
    return rows.select("l_orderkey", "l_linenumber", text.extract_answer(F.col("txt")).alias("answer"), text.has_box(F.col("txt")).alias("boxed"))


def _boxed_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    dec = F.floor("l_extendedprice").cast("long").cast("string")
    kind = F.col("l_linenumber") % 6
    txt = (
        F.when(kind == 0, F.concat(F.lit("it is "), dec, F.lit(" or so"))).when(kind == 1, F.concat(F.lit("so \\boxed{"), dec, F.lit("}"))).when(kind == 2, F.concat(F.lit("\\boxed{1} then \\boxed{ "), dec, F.lit(" }.")))
        .when(kind == 3, F.concat(F.lit("about "), dec, F.lit(" \\boxed{}"))).when(kind == 4, F.concat(F.lit("\\boxed{\\frac{{{{{"), dec, F.lit("}}}}}{2}}"))).otherwise(F.concat(F.lit("\\boxed{"), dec, F.lit("} and \\boxed{7")))
    )
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", txt.alias("txt"))


@query("""WITH t AS (SELECT l_returnflag, l_linenumber % 2 = 0 AS stored, CAST(floor(l_extendedprice) AS BIGINT) AS v, l_partkey % 5 AS k FROM lineitem),
p AS (SELECT l_returnflag, stored, v, CAST(v AS VARCHAR) AS truth, CASE k WHEN 0 THEN CAST(v AS VARCHAR) WHEN 1 THEN CAST(v + v // 200 AS VARCHAR) WHEN 2 THEN CAST(v + v // 10 AS VARCHAR) WHEN 3 THEN v || '.0' ELSE 'n/a' END AS pred FROM t),
g AS (SELECT *, TRY_CAST(pred AS DOUBLE) AS a, TRY_CAST(truth AS DOUBLE) AS b FROM p),
h AS (SELECT *, pred = truth OR coalesce(a = b, false) AS exact,
      CASE WHEN regexp_full_match(truth, '[01]+') THEN pred = truth WHEN a IS NOT NULL THEN abs(a - b) <= greatest(0.01 * greatest(abs(a), abs(b)), 1e-5) ELSE lower(pred) = lower(truth) END AS tol FROM g)
SELECT l_returnflag, count(*) AS rows, count(*) FILTER (WHERE stored) AS stored, count(*) FILTER (WHERE stored AND exact) AS exact, count(*) FILTER (WHERE stored AND tol AND NOT exact) AS tolerance_only,
       count(*) FILTER (WHERE stored AND NOT tol) AS wrong, count(*) FILTER (WHERE NOT stored AND exact) AS missed, round_even((count(*) FILTER (WHERE stored) - count(*) FILTER (WHERE stored AND exact)) * 100.0::DOUBLE / nullif(count(*) FILTER (WHERE stored), 0), 1) AS inflation_pct FROM h GROUP BY 1""")
def grade_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, k = F.floor("l_extendedprice").cast("long"), F.col("l_partkey") % 5
    s = lambda c: c.cast("string")
    pred = F.when(k == 0, s(v)).when(k == 1, s(v + F.expr("cast(floor(l_extendedprice) as bigint) div 200"))).when(k == 2, s(v + F.expr("cast(floor(l_extendedprice) as bigint) div 10"))).when(k == 3, F.concat(s(v), F.lit(".0"))).otherwise("n/a")
    rows = table(spark, sf_dir, "lineitem").select("l_returnflag", (F.col("l_linenumber") % 2 == 0).alias("stored"), pred.alias("pred"), s(v).alias("truth"))
    return metrics.inflation(rows, ["l_returnflag"], F.col("stored"), grade.num_eq(F.col("pred"), F.col("truth")), grade.is_correct(F.col("pred"), F.col("truth")))


@query("""SELECT CASE WHEN grouping(o_orderpriority) = 1 THEN 'OVERALL' ELSE o_orderpriority END AS o_orderpriority, count(*) FILTER (WHERE o_totalprice > 150000) AS correct, count(*) AS total,
round(count(*) FILTER (WHERE o_totalprice > 150000) / count(*), 6) AS accuracy FROM orders GROUP BY ROLLUP (o_orderpriority)""")
def accuracy_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(metrics.accuracy(table(spark, sf_dir, "orders"), "o_orderpriority", F.col("o_totalprice") > 150000), "accuracy")


_QUOTA = "least(greatest(least(15, n // 2), CAST(round_even(n * 0.15::DOUBLE, 0) AS BIGINT)), n)"


@query(f"WITH c AS (SELECT lang || '/' || source AS stratum, count(*) AS n FROM documents GROUP BY 1) SELECT stratum, n, {_QUOTA} AS held_out FROM c")
def split_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.quotas(table(spark, sf_dir, "documents").select(F.concat_ws("/", "lang", "source").alias("stratum")), "stratum")


@query(f"""WITH c AS (SELECT lang, count(*) AS n FROM documents GROUP BY 1), q AS (SELECT lang, {_QUOTA} AS quota FROM c),
r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5('42:' || doc_id), doc_id) AS k FROM documents)
SELECT doc_id, r.lang, CASE WHEN k <= quota THEN 'heldout' ELSE 'train' END AS split FROM r JOIN q ON q.lang = r.lang""")
def stratified_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.stratified(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id", "lang").select("doc_id", "lang", "split")


@query("SELECT doc_id, 'in both' AS fault FROM documents WHERE false")
def split_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    return split.split_faults(split.stratified(docs, "doc_id", "lang"), docs, "doc_id")


@query("SELECT min(doc_id) AS doc_id, length(text) AS size FROM documents GROUP BY text")
def first_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", dedup.digest(F.col("text")).alias("digest"), F.length("text").cast("long").alias("size"))
    return select.first_per_key(rows, ["digest"], [F.col("doc_id")]).select("doc_id", "size")


@query("""SELECT doc_id, lang, source, n_chars FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY source, n_chars, doc_id) AS k FROM documents) WHERE k <= 4""")
def topk_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.top_per_group(table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars"), ["lang"], [F.col("source"), F.col("n_chars"), F.col("doc_id")], 4)


@query("""SELECT doc_id, quality FROM (SELECT *, row_number() OVER (PARTITION BY quality ORDER BY md5('42:' || doc_id), doc_id) AS k FROM labels) WHERE k <= CASE quality WHEN 0 THEN 20 WHEN 1 THEN 30 ELSE 10 END""")
def capped_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.capped_sample(table(spark, sf_dir, "labels"), "doc_id", "quality", {0: 20, 1: 30}, 10).select("doc_id", "quality")


@query("""SELECT doc_id, toxic FROM (SELECT *, row_number() OVER (PARTITION BY quality ORDER BY CASE WHEN toxic = 1 THEN 0 ELSE 1 END, md5('42:' || doc_id), doc_id) AS k FROM labels) WHERE k <= 40""")
def unsolved_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.unsolved_first(table(spark, sf_dir, "labels"), "doc_id", "quality", F.col("toxic") == 1, {}, 40).select("doc_id", "toxic")


@query("SELECT l.doc_id, CAST(c AS INTEGER) AS copy, d.n_chars FROM labels l JOIN documents d ON d.doc_id = l.doc_id, generate_series(1, 3) g(c) WHERE l.toxic = 1")
def oversample(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "labels").where("toxic = 1").join(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    return select.oversample(rows, 3).select("doc_id", "copy", "n_chars")


@query("""WITH n AS (SELECT CAST(ceil(count(*) / 32.0) AS BIGINT) AS b FROM documents),
r AS (SELECT doc_id, lang, row_number() OVER (ORDER BY lang, md5('42:' || doc_id), doc_id) - 1 AS place FROM documents),
s AS (SELECT i AS slot, row_number() OVER (ORDER BY md5('43:' || i), i) - 1 AS batch FROM n, generate_series(0, b - 1) g(i))
SELECT r.doc_id, r.lang, r.place, s.batch FROM r, n, s WHERE s.slot = r.place % n.b""")
def stratified_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.round_robin(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id", "lang", 32).select("doc_id", "lang", "place", "batch")


@query("""SELECT lang, count(*) FILTER (WHERE doc_id IN (SELECT doc_id FROM labels)) AS labelled, count(*) FILTER (WHERE doc_id NOT IN (SELECT doc_id FROM labels)) AS unlabelled FROM documents GROUP BY 1""")
def semi_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, ids = table(spark, sf_dir, "documents").select("doc_id", "lang"), table(spark, sf_dir, "labels").select("doc_id")
    both = select.members(docs, ids, "doc_id").select("lang", F.lit(1).alias("in")).union(select.others(docs, ids, "doc_id").select("lang", F.lit(0)))
    return both.groupBy("lang").agg(F.count_if(F.col("in") == 1).alias("labelled"), F.count_if(F.col("in") == 0).alias("unlabelled"))


_NORM = "trim(regexp_replace(lower(text), '\\s+', ' ', 'g'))"


@query(f"""WITH d AS (SELECT doc_id, {_NORM} AS t FROM documents), i AS (SELECT item_id, {_NORM} AS t FROM benchmark)
SELECT doc_id, item_id FROM d JOIN i ON contains(d.t, i.t)""")
def benchmark_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), "doc_id", "item_id")


@query(f"SELECT sha256({_NORM}) AS digest, count(*) AS rows, min(doc_id) AS first FROM documents GROUP BY 1 HAVING count(*) > 1")
def norm_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.copies(table(spark, sf_dir, "documents"), "doc_id", text.normalise(F.col("text")))


@query("SELECT sha256(text) AS digest, count(*) AS rows, min(doc_id) AS first FROM documents GROUP BY 1 HAVING count(*) > 1")
def exact_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.copies(table(spark, sf_dir, "documents"), "doc_id", F.col("text"))


_RATIO = "round(2.0 * sum(least(c1.m, c2.m)) / any_value(n), 6)"


@query(f"""WITH d AS (SELECT doc_id, lang, length(text) AS n FROM documents),
c AS (SELECT doc_id, ch, count(*) AS m FROM (SELECT doc_id, unnest(string_split(text, '')) AS ch FROM documents) WHERE ch <> '' GROUP BY 1, 2),
p AS (SELECT x.doc_id AS x, y.doc_id AS y, x.n + y.n AS n FROM d x JOIN d y ON x.lang IS NOT DISTINCT FROM y.lang AND (x.n < y.n OR (x.n = y.n AND x.doc_id < y.doc_id)) AND 2.0 * x.n >= 0.98 * (x.n + y.n))
SELECT x AS a, y AS b, {_RATIO} AS ratio FROM p JOIN c c1 ON c1.doc_id = x JOIN c c2 ON c2.doc_id = y AND c2.ch = c1.ch GROUP BY 1, 2 HAVING 2.0 * sum(least(c1.m, c2.m)) / any_value(n) >= 0.98
UNION ALL SELECT x, y, 1.0 FROM p WHERE n = 0""")
def near_dup_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All texts of one language, null included, whatever their sources."""
    return _round(dedup.likely_copies(table(spark, sf_dir, "documents"), "doc_id", "text", "lang", 0.98), "ratio")


# the clusters' SQL walks through a conversation and keeps the list of representatives
_GREEDY = """c AS (SELECT conv_id, turn, ch, count(*) AS m FROM (SELECT conv_id, turn, unnest(string_split(text, '')) AS ch FROM conversations) WHERE ch <> '' GROUP BY 1, 2, 3),
q AS (SELECT c1.conv_id, c1.turn AS t, c2.turn AS u, sum(least(c1.m, c2.m)) AS shared FROM c c1 JOIN c c2 ON c2.conv_id = c1.conv_id AND c2.ch = c1.ch AND c2.turn < c1.turn GROUP BY 1, 2, 3),
k AS (SELECT x.conv_id, x.turn AS t, list(y.turn) FILTER (WHERE y.turn IS NOT NULL AND CASE WHEN length(x.text) + length(y.text) = 0 THEN true ELSE 2.0 * coalesce(q.shared, 0) / (length(x.text) + length(y.text)) >= 0.55 END) AS alike, row_number() OVER (PARTITION BY x.conv_id ORDER BY x.turn) AS i
  FROM conversations x LEFT JOIN conversations y ON y.conv_id = x.conv_id AND y.turn < x.turn LEFT JOIN q ON q.conv_id = x.conv_id AND q.t = x.turn AND q.u = y.turn GROUP BY x.conv_id, x.turn),
g AS (SELECT conv_id, t, i, t AS r, [t] AS reps FROM k WHERE i = 1
  UNION ALL SELECT k.conv_id, k.t, k.i, coalesce(list_filter(g.reps, lambda z: list_contains(k.alike, z))[1], k.t), CASE WHEN len(list_filter(g.reps, lambda z: list_contains(k.alike, z))) > 0 THEN g.reps ELSE list_append(g.reps, k.t) END FROM g JOIN k ON k.conv_id = g.conv_id AND k.i = g.i + 1)"""


@query(f"WITH RECURSIVE {_GREEDY} SELECT conv_id, t AS turn, r AS representative, r = t AS is_first FROM g")
def greedy_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.greedy_clusters(table(spark, sf_dir, "conversations"), "conv_id", "turn", "text")


@query(f"WITH RECURSIVE {_GREEDY}, n AS (SELECT conv_id, count(*) FILTER (WHERE r = t) AS nrep FROM g GROUP BY 1) SELECT CAST(least(nrep, 3) AS BIGINT) AS nrep, count(*) AS problems FROM n GROUP BY 1")
def cluster_diversity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.diversity(greedy_clusters(spark, sf_dir), "conv_id")[1].withColumn("nrep", F.col("nrep").cast("long"))


@query(f"WITH RECURSIVE {_GREEDY}, n AS (SELECT conv_id, count(*) FILTER (WHERE r = t) AS nrep FROM g GROUP BY 1), s AS (SELECT conv_id, min_by(role, turn) AS status FROM conversations GROUP BY 1) SELECT status, count(*) AS problems, count(*) FILTER (WHERE nrep >= 2) AS diverse FROM n JOIN s ON s.conv_id = n.conv_id GROUP BY 1")
def diversity_by_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations by the role that opens them, and how many have two clusters or more."""
    status = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.min_by("role", "turn").alias("status"))
    return dedup.diversity(greedy_clusters(spark, sf_dir), "conv_id", status=status)[1]


@query("""SELECT conv_id, md5(string_agg('<|' || role || '|>' || chr(10) || text || chr(10), '' ORDER BY turn)) AS digest, count(*) AS turns FROM conversations GROUP BY 1""")
def chat_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))).alias("m"))
    return rows.select("conv_id", F.md5(text.render_chat(F.col("m")).cast("binary")).alias("digest"), F.size("m").cast("long").alias("turns"))


_GUESS = " OR ".join(f"contains(lower(text), '{w}')" for w in text.GUESS_WORDS)


@query(f"""SELECT lang, count(*) AS rows, count(*) FILTER (WHERE regexp_replace(text, '^\\s+|\\s+$', '', 'g') <> 'nan' AND length(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) >= 5) AS usable, count(*) FILTER (WHERE length(text) < 300) AS stubs,
count(*) FILTER (WHERE {_GUESS}) AS guessing, count(*) FILTER (WHERE regexp_full_match(text, '0+')) AS degenerate, count(*) FILTER (WHERE contains(text, '\\boxed{{')) AS boxed FROM documents GROUP BY 1""")
def usable_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("text")
    return table(spark, sf_dir, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("rows"), F.count_if(text.usable_cot(c)).alias("usable"), F.count_if(F.length(c) < audit.STUB_CHARS).alias("stubs"), F.count_if(text.lexicon_hit(c)).alias("guessing"), F.count_if(audit.degenerate(c)).alias("degenerate"), F.count_if(text.has_box(c)).alias("boxed"))


@query("""SELECT lang, min(n_chars) AS least, list_sort(list(n_chars))[len(list(n_chars)) // 2 + 1] AS median, max(n_chars) AS most, round(avg(n_chars), 6) AS mean, round(quantile_cont(n_chars, 0.9), 6) AS p90, round(count(*) FILTER (WHERE n_chars > 5000) / count(*), 6) AS over FROM documents GROUP BY 1""")
def length_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(metrics.lengths(table(spark, sf_dir, "documents"), ["lang"], "n_chars", 5000), "mean", "p90", "over")


@query("""WITH a AS (SELECT user_id, count(DISTINCT event_type) AS s, count(DISTINCT CAST(floor(value / 100) AS BIGINT)) AS n FROM events WHERE value > 60 GROUP BY 1)
SELECT count(*) AS solved, count(*) FILTER (WHERE s = 5) AS by_all, count(*) FILTER (WHERE s = 1) AS by_one, count(*) FILTER (WHERE s >= 2) AS by_two, count(*) FILTER (WHERE n > 1) AS conflicting FROM a""")
def source_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").where("value > 60").withColumn("answer", F.floor(F.col("value") / 100).cast("long"))
    return metrics.agreement_report(metrics.agreement(rows, "user_id", "event_type", "answer"), 5)


@query(f"""WITH d AS (SELECT DISTINCT doc_id FROM (SELECT doc_id, {_NORM} AS t FROM documents) d JOIN (SELECT {_NORM} AS t FROM benchmark) i ON contains(d.t, i.t)), l AS (SELECT DISTINCT doc_id FROM labels)
SELECT (SELECT count(*) FROM l) AS a, (SELECT count(*) FROM d) AS b, (SELECT count(*) FROM l WHERE doc_id NOT IN (SELECT doc_id FROM d)) AS only_a, (SELECT count(*) FROM d WHERE doc_id NOT IN (SELECT doc_id FROM l)) AS only_b,
(SELECT count(*) FROM l WHERE doc_id IN (SELECT doc_id FROM d)) AS both, (SELECT count(*) FROM (SELECT doc_id FROM l UNION SELECT doc_id FROM d)) AS either""")
def set_complement(spark: SparkSession, sf_dir: str) -> DataFrame:
    hit = audit.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), "doc_id", "item_id")
    return metrics.complement(table(spark, sf_dir, "labels"), hit, "doc_id")


@query("""WITH a AS (SELECT user_id, CAST(floor(value / 20) AS BIGINT) AS ans, event_id FROM events), c AS (SELECT user_id, ans, count(*) AS n, min(event_id) AS f FROM a GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, f) AS k, count(*) OVER (PARTITION BY user_id) AS answers FROM c)
SELECT user_id, ans AS majority, n AS votes, answers, CASE WHEN answers = 1 THEN ans END AS unanimous FROM r WHERE k = 1""")
def majority_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("user_id", F.floor(F.col("value") / 20).cast("long").alias("ans"), "event_id")
    return metrics.majority(rows, ["user_id"], "ans", "event_id")


@query("""WITH t AS (SELECT p_size, CAST(p_partkey % 256 AS BIGINT) AS x, CAST(p_size % 8 AS BIGINT) AS k FROM part),
e AS (SELECT p_size, x, CASE WHEN p_size % 3 = 0 THEN xor(((x << k) | (x >> (8 - k))) & 255, 255) ELSE ((x << k) | (x >> (8 - k))) & 255 END AS y FROM t),
r AS (SELECT i AS k, n FROM generate_series(0, 7) g(i), (VALUES (0), (255)) v(n))
SELECT p_size AS id, count(*) AS rules, min(rule) AS first_rule FROM (SELECT p_size, CASE WHEN n = 0 THEN '' ELSE '~' END || CASE WHEN k = 0 THEN 'x' ELSE 'ROL' || k END AS rule FROM e, r GROUP BY p_size, k, n HAVING bool_and(xor(((x << k) | (x >> (8 - k))) & 255, n) = y)) GROUP BY 1""")
def rule_search_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = (F.col("p_partkey") % 256).cast("int")
    turned = x
    for k in range(1, 8):
        turned = F.when(F.col("p_size") % 8 == k, text.rotl(x, k)).otherwise(turned)
    y = F.when(F.col("p_size") % 3 == 0, text.not8(turned)).otherwise(turned)
    # a problem has 256 different examples at most
    problems = table(spark, sf_dir, "part").groupBy(F.col("p_size").alias("id")).agg(F.collect_set(F.struct(x.alias("x"), y.alias("y"))).alias("examples"))
    grammar = [(n, i) for n, i in rules.verifier_rules() if n.lstrip("~").startswith("ROL") or n.lstrip("~") == "x"]
    grammar = [(n, i) for n, i in grammar if " " not in n]
    return rules.consistent(problems, rules.rule_table(spark, grammar)).groupBy("id").agg(F.count(F.lit(1)).alias("rules"), F.min("rule").alias("first_rule"))


def _bit_images(v: str, names: tuple[str, ...]) -> str:
    """DuckDB list of (name, value) of bit terms of an expression."""
    turn = lambda k: f"((({v} << {k}) | ({v} >> {8 - k})) & 255)"
    left, right = turn(1), turn(7)
    made = {"x": v, "id": v, "NOT": f"xor({v}, 255)", "not": f"xor({v}, 255)", "REV": f"CAST(concat('0b', reverse(lpad(bin({v}), 8, '0'))) AS BIGINT)"}
    for k in range(1, 8):
        made |= {f"ROL{k}": turn(k), f"ROR{k}": turn(8 - k), f"SHL{k}": f"(({v} << {k}) & 255)", f"SHR{k}": f"({v} >> {k})"}
    made |= {"NB_XOR": f"xor({left}, {right})", "NB_XOR3": f"xor(xor({left}, {right}), {v})", "NB_MAJ": f"(({left} & {right}) | ({left} & {v}) | ({right} & {v}))"}
    return "[" + ", ".join(f"{{'o': {i}, 'n': '{n}', 'v': CAST({made[n]} AS BIGINT)}}" for i, n in enumerate(names)) + "]"


_PUZZLE = """t AS (SELECT p_partkey // 9 AS id, p_partkey % 9 AS k, (p_partkey * 37) % 256 AS x FROM part),
e AS (SELECT *, xor(((x << 3) | (x >> 5)) & 255, x >> 2) AS y FROM t WHERE id IN (SELECT id FROM t WHERE k = 8)),
need AS (SELECT id, count(*) FILTER (WHERE k < 8) AS n FROM e GROUP BY 1)"""
_OPERATORS = "(VALUES (0, 'AND'), (1, 'OR'), (2, 'XOR')) o(q, op), (VALUES (0), (255)) s(neg)"


@query(f"""WITH {_PUZZLE}, m AS (SELECT id, k, x, y, unnest({_bit_images('x', tuple(rules.bit_terms()))}) AS b FROM e),
f AS (SELECT id, k, y, b.n AS n, b.v AS v FROM m),
r AS (SELECT id, k, y, n || neg AS rule, xor(v, neg) AS p FROM f, (VALUES (0), (255)) s(neg)
  UNION ALL SELECT a.id, a.k, a.y, a.n || op || b.n || neg, xor(CASE q WHEN 0 THEN a.v & b.v WHEN 1 THEN a.v | b.v ELSE xor(a.v, b.v) END, neg) FROM f a JOIN f b ON a.id = b.id AND a.k = b.k, {_OPERATORS}),
h AS (SELECT r.id, rule, max(p) FILTER (WHERE k = 8) AS guess, max(y) FILTER (WHERE k = 8) AS truth FROM r JOIN need ON need.id = r.id GROUP BY r.id, rule, n HAVING count(*) FILTER (WHERE k < 8 AND p = y) = n AND n > 0),
g AS (SELECT id, count(*) AS rules, count(DISTINCT guess) AS n_predictions, bool_or(guess = truth) AS truth_predicted FROM h GROUP BY 1)
SELECT need.id, coalesce(rules, 0) AS rules, coalesce(n_predictions, 0) AS n_predictions, coalesce(truth_predicted, false) AS truth_predicted FROM need LEFT JOIN g ON g.id = need.id""")
def rule_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole grammar of the verifier over problems of eight examples each, made of part keys."""
    at = F.col("p_partkey")
    x = F.pmod(at * 37, F.lit(256)).cast("int")
    rows = table(spark, sf_dir, "part").select(F.floor(at / 9).alias("id"), (at % 9).alias("k"), x.alias("x"), text.rotl(x, 3).bitwiseXOR(F.shiftright(x, 2)).alias("y"))
    problems = rows.groupBy("id").agg(F.collect_list(F.when(F.col("k") < 8, F.struct("x", "y"))).alias("examples"), F.max(F.when(F.col("k") == 8, F.col("x"))).alias("query"), F.max(F.when(F.col("k") == 8, F.col("y"))).alias("truth"))
    found = rules.verify(problems.where("query is not null"), rules.rule_table(spark, rules.verifier_rules()))
    return found.withColumn("n_predictions", F.col("n_predictions").cast("long"))


_FIT = "(VALUES ('add'), ('sub'), ('mul'), ('concat')) o(operation)"


@query(f"""WITH t AS (SELECT CAST(l_quantity AS BIGINT) AS a, CAST(l_linenumber AS BIGINT) AS b, l_orderkey % 2 AS k FROM lineitem),
e AS (SELECT *, CASE WHEN k = 0 THEN a + b ELSE a * b END AS y FROM t)
SELECT operation, count(*) FILTER (WHERE y = CASE operation WHEN 'add' THEN a + b WHEN 'sub' THEN a - b WHEN 'mul' THEN a * b ELSE a * 10 + b END) AS matches, count(*) AS parseable,
round(count(*) FILTER (WHERE y = CASE operation WHEN 'add' THEN a + b WHEN 'sub' THEN a - b WHEN 'mul' THEN a * b ELSE a * 10 + b END) / count(*), 6) AS share FROM e, {_FIT} GROUP BY 1""")
def operator_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = F.col("l_quantity").cast("long"), F.col("l_linenumber").cast("long")
    truth = F.when(F.col("l_orderkey") % 2 == 0, a + b).otherwise(a * b)
    return _round(metrics.candidate_fit(table(spark, sf_dir, "lineitem"), {"add": a + b, "sub": a - b, "mul": a * b, "concat": a * 10 + b}, truth), "share")


@query(f"""WITH t AS (SELECT l_returnflag, CAST(l_quantity AS BIGINT) AS a, CAST(l_linenumber AS BIGINT) AS b, l_orderkey % 2 AS k FROM lineitem),
e AS (SELECT *, CASE WHEN k = 0 THEN a + b ELSE a * b END AS y FROM t),
c AS (SELECT l_returnflag, operation, count(*) AS rows, count(*) FILTER (WHERE y = CASE operation WHEN 'add' THEN a + b WHEN 'sub' THEN a - b WHEN 'mul' THEN a * b ELSE a * 10 + b END) AS matches FROM e, {_FIT} GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY matches DESC, operation) AS k FROM c) SELECT l_returnflag, rows, matches, operation FROM r WHERE k = 1""")
def argmax_oracle(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = F.col("l_quantity").cast("long"), F.col("l_linenumber").cast("long")
    truth = F.when(F.col("l_orderkey") % 2 == 0, a + b).otherwise(a * b)
    return metrics.best_per_symbol(table(spark, sf_dir, "lineitem"), "l_returnflag", {"add": a + b, "sub": a - b, "mul": a * b, "concat": a * 10 + b}, truth)


@query("""WITH t AS (SELECT l_orderkey, l_linenumber, CAST(l_quantity AS BIGINT) AS a, CAST(l_suppkey AS BIGINT) AS b FROM lineitem)
SELECT l_orderkey, l_linenumber, CASE l_linenumber % 4 WHEN 0 THEN CAST(a - b AS VARCHAR) WHEN 1 THEN CAST(b AS VARCHAR) || CAST(a AS VARCHAR) WHEN 2 THEN CAST(a * b AS VARCHAR) ELSE CAST(abs(a - b) AS VARCHAR) END AS answer FROM t""")
def typographic_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("l_linenumber") % 4
    op = F.when(k == 0, "-").when(k == 1, "*").when(k == 2, "/").otherwise("#")
    prompt = F.concat(F.lit("Now, determine the result for: "), F.col("l_quantity").cast("long").cast("string"), op, F.col("l_suppkey").cast("string"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", prompt.alias("prompt")).select("l_orderkey", "l_linenumber", rules.typographic_answer(F.col("prompt")).alias("answer"))


@query("""WITH done AS (SELECT DISTINCT user_id AS id, CAST(event_id % 3 AS INTEGER) AS gen FROM events WHERE value > 100 AND value <= 250)
SELECT p.id, p.gen FROM (SELECT DISTINCT user_id AS id, CAST(g AS INTEGER) AS gen FROM events, generate_series(0, 2) s(g)) p LEFT JOIN done d ON d.id = p.id AND d.gen = p.gen WHERE d.id IS NULL""")
def resume_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    done = events.where("value > 100").select(F.col("user_id").alias("id"), (F.col("event_id") % 3).alias("gen"), F.when(F.col("value") > 250, "throttled").alias("error"))
    return select.grid(events.select(F.col("user_id").alias("id")).distinct(), 3, done)


@query("""WITH u AS (SELECT regexp_extract(url, '^https?://([^/?#]+)', 1) AS host, regexp_extract(url, '^https?://[^/]+/([a-z]{2})/', 1) AS lang FROM pages)
SELECT regexp_replace(regexp_replace(host, '^(www|m|blog)\\.', ''), '\\.(com|net|org)$', '') AS label, lang, count(*) AS pages FROM u GROUP BY 1, 2""")
def page_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    host, lang = F.regexp_extract("url", r"^https?://([^/?#]+)", 1), F.regexp_extract("url", r"^https?://[^/]+/([a-z]{2})/", 1)
    label = F.regexp_replace(F.regexp_replace(host, r"^(www|m|blog)\.", ""), r"\.(com|net|org)$", "")
    return table(spark, sf_dir, "pages").groupBy(label.alias("label"), lang.alias("lang")).agg(F.count(F.lit(1)).alias("pages"))


@query("""SELECT event_type, count(*) AS rows, CAST(sum(CAST(props->>'$.k' AS BIGINT)) AS BIGINT) AS total, count(DISTINCT props->>'$.k') AS kinds FROM events GROUP BY 1""")
def props_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k")
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("rows"), F.sum(k.cast("long")).alias("total"), F.count_distinct(k).alias("kinds"))


@query("""SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1""")
def state_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest(table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type", "value"), "user_id", "ts").select("user_id", "event_id", "event_type", "value")


@query("SELECT bit_count(xor(CAST(p_partkey % 256 AS BIGINT), CAST(p_size % 256 AS BIGINT))) AS distance, count(*) AS rows FROM part GROUP BY 1")
def hamming_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.distance_histogram(table(spark, sf_dir, "part"), F.col("p_partkey") % 256, F.col("p_size").cast("long") % 256)


@query("SELECT source, count(*) AS n FROM documents GROUP BY 1")
def value_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.value_counts(table(spark, sf_dir, "documents"), "source")


@query("SELECT least(n, 3) AS turns, count(*) AS n FROM (SELECT conv_id, count(*) AS n FROM conversations GROUP BY 1) GROUP BY 1")
def capped_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.capped_histogram(table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("turns")), "turns").withColumn("turns", F.col("turns").cast("long"))


@query("""SELECT event_type AS status, count(*) AS total, count(*) FILTER (WHERE value > 60 AND value <= 200) AS ok, count(*) FILTER (WHERE value <= 60) AS wrong, count(*) FILTER (WHERE value > 200 AND value <= 250) AS error, count(*) FILTER (WHERE value > 250) AS timeout FROM events GROUP BY 1""")
def outcome_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("value")
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("status"), F.when(v <= 60, "wrong").when(v <= 200, "ok").when(v <= 250, "error").otherwise("timeout").alias("outcome"))
    return metrics.outcomes(rows)


@query("""SELECT lang, count(*) AS total, count(*) FILTER (WHERE n_chars > 1000) AS correct, count(*) FILTER (WHERE n_chars > 1000 AND length(text) > 0) AS with_trace, round_even(count(*) FILTER (WHERE n_chars > 1000) * 100.0::DOUBLE / count(*), 1) AS pct FROM documents GROUP BY 1""")
def conditional_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.summary(table(spark, sf_dir, "documents"), ["lang"], F.col("n_chars") > 1000, text.has_text(F.col("text")))


@query("SELECT vec_id, round(CAST(list_min(embedding) AS DOUBLE), 6) AS least_logprob, list_min(embedding) < -0.69::FLOAT AS doubtful FROM embeddings")
def logprob_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = metrics.least_logprob(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), "embedding")
    low = F.col("least_logprob")
    return rows.select("vec_id", F.round(low.cast("double"), 6).alias("least_logprob"), (low < F.lit(-0.69).cast("float")).alias("doubtful"))


@query("SELECT count(DISTINCT event_type) AS event_type, count(DISTINCT user_id) AS user_id FROM events")
def distinct_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.distinct_values(table(spark, sf_dir, "events"), ["event_type", "user_id"])


@query("""SELECT event_id, user_id, event_type FROM events WHERE regexp_matches(event_type, '(?i)UR|ick') AND value > 60""")
def dynamic_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", F.col("event_type").alias("category"), (F.col("value") > 60).alias("correct"))
    return select.matching(rows, category="UR|ick", correct=True).select("event_id", "user_id", F.col("category").alias("event_type"))


_HEAD_TAIL = "CASE WHEN length(text) <= 2000 THEN text ELSE left(text, 1000) || chr(10) || '...' || chr(10) || right(text, 1000) END"


@query(f"SELECT doc_id, length({_HEAD_TAIL}) AS chars, md5({_HEAD_TAIL}) AS digest FROM documents")
def head_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", text.head_tail(F.col("text")).alias("x"))
    return rows.select("doc_id", F.length("x").cast("long").alias("chars"), F.md5(F.col("x").cast("binary")).alias("digest"))


def _equation_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three examples and a question for every four part numbers, by one of eight rules that need both orders of the
    operands, operations on digits, reversed results and results with the operator in front."""
    two = lambda c: F.lpad(F.pmod(c, F.lit(100)).cast("string"), 2, "0")
    k = F.col("p_partkey")
    a, b, rule = F.pmod(k * 7, F.lit(100)), F.pmod(k * 3, F.lit(100)), F.pmod(F.floor(k / 4), F.lit(8))
    digits = F.concat(F.pmod(F.floor(b / 10) - F.floor(a / 10), F.lit(10)), F.pmod(b - a, F.lit(10)))  # of the operands in the other order
    results = ((a + b).cast("string"), (a * b).cast("string"), (b - a).cast("string"), F.concat(two(b), two(a)), digits, text.signed_reverse((a - b).cast("string")), F.concat(F.lit("+"), (b - a).cast("string")), F.concat(F.lit("+"), F.reverse((a * b).cast("string"))))
    rows = table(spark, sf_dir, "part").select(F.floor(k / 4).alias("id"), F.pmod(k, F.lit(4)).alias("i"), two(k * 7).alias("a"), two(k * 3).alias("b"), F.element_at(F.array(*results), (rule + 1).cast("int")).alias("out"))
    line = F.concat("a", F.lit("+"), "b", F.lit(" = "), "out", F.lit("\n"))
    per = rows.groupBy("id").agg(F.sort_array(F.collect_list(F.when(F.col("i") < 3, F.struct("i", line.alias("t"))))).alias("e"), F.max(F.when(F.col("i") == 3, F.concat("a", F.lit("+"), "b"))).alias("q"))
    return per.where("q is not null").select("id", F.concat(F.lit("Examples:\n"), F.array_join(F.transform("e", lambda s: s["t"]), ""), F.lit("Now, determine the result for: "), "q").alias("prompt"))


_PRIMS = tuple(rules.bit_primitives())


@query(f"""WITH {_PUZZLE}, m AS (SELECT id, k, y, unnest({_bit_images('x', _PRIMS)}) AS b FROM e), f AS (SELECT id, k, y, b.o AS o, b.v AS v FROM m),
c AS (SELECT id, k, y, o, unnest({_bit_images('v', _PRIMS)}) AS b FROM f),
r AS (SELECT id, k, y, o AS rule, v AS p FROM f UNION ALL SELECT id, k, y, 30 + o * 30 + b.o, b.v FROM c
  UNION ALL SELECT a.id, a.k, a.y, 1000 + q * 1000 + a.o * 30 + b.o, CASE q WHEN 0 THEN xor(a.v, b.v) WHEN 1 THEN a.v | b.v ELSE a.v & b.v END FROM f a JOIN f b ON a.id = b.id AND a.k = b.k AND a.o <= b.o, (VALUES (0), (1), (2)) w(q)),
h AS (SELECT r.id, rule, max(p) FILTER (WHERE k = 8) AS guess FROM r JOIN need ON need.id = r.id GROUP BY r.id, rule, n HAVING count(*) FILTER (WHERE k < 8 AND p = y) = n AND n > 0),
v AS (SELECT id, guess, row_number() OVER (PARTITION BY id ORDER BY count(*) DESC, min(rule)) AS place FROM h GROUP BY 1, 2)
SELECT need.id, lpad(bin(guess), 8, '0') AS answer FROM need LEFT JOIN v ON v.id = need.id AND place = 1""")
def bit_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompts of eight examples of eight-bit words from part numbers, solved by the word search. Its first tier holds a
    rule for all of them, which is what the SQL searches."""
    return rules.bit_search(_bit_prompts(spark, sf_dir)).select("id", "answer")


def _bit_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.pmod(F.col("p_partkey") * 37, F.lit(256)).cast("int")
    return _word_prompts(spark, sf_dir, text.rotl(x, 3).bitwiseXOR(F.shiftright(x, 2)))


def _word_prompts(spark: SparkSession, sf_dir: str, y: Column) -> DataFrame:
    """Eight examples and a question for every nine part numbers."""
    k = F.col("p_partkey")
    x = F.pmod(k * 37, F.lit(256)).cast("int")
    rows = table(spark, sf_dir, "part").select(F.floor(k / 9).alias("id"), F.pmod(k, F.lit(9)).alias("i"), x.alias("x"), y.alias("y"))
    line = F.concat(text.to_bits(F.col("x")), F.lit(" -> "), text.to_bits(F.col("y")))
    per = rows.groupBy("id").agg(F.sort_array(F.collect_list(F.when(F.col("i") < 8, F.struct("i", line.alias("t"))))).alias("e"), F.max(F.when(F.col("i") == 8, text.to_bits(F.col("x")))).alias("q"))
    return per.where("q is not null").select("id", F.concat(F.lit("input -> output:\n"), F.array_join(F.transform("e", lambda s: s["t"]), "\n"), F.lit("\nNow, determine the output for: "), "q").alias("prompt"))


_PAIRS = [(f, k, k // 8, k % 8) for f in ("XOR", "AND", "OR", "XOR-NOT", "AND-NOT", "OR-NOT") for k in range(64)]
_CANDIDATES = ", ".join(f"('{f}', {k}, {a}, {b})" for f, k, a, b in [*_PAIRS, *((f, k, k, 0) for f in ("NOT", "I") for k in range(8)), ("0", 0, 0, 0), ("1", 0, 0, 0)])
_TURN = "((({0} << {1}) | ({0} >> (8 - {1}))) & 255)"


# the SQL tries every rule on every example, one row each
@query(f"""WITH t AS (SELECT p_partkey // 9 AS id, p_partkey % 9 AS k, (p_partkey * 37) % 256 AS x FROM part),
e AS (SELECT *, CASE id % 5 WHEN 0 THEN xor({_TURN.format('x', 3)}, x >> 2) WHEN 1 THEN xor({_TURN.format('x', 1)}, {_TURN.format('x', 5)}) WHEN 2 THEN {_TURN.format('x', 2)} & (255 - {_TURN.format('x', 7)}) WHEN 3 THEN (x * x + id) % 256 ELSE 255 - {_TURN.format('x', 4)} END AS y FROM t WHERE id IN (SELECT id FROM t WHERE k = 8)),
c(f, n, a, b) AS (VALUES {_CANDIDATES}), o(f, first, second) AS (VALUES {", ".join(f"('{f}', {i}, {rules.TIE_ORDER.index(f)})" for i, f in enumerate(rules.FAMILIES))}),
w AS (SELECT id, k, y, f, n, (x >> (7 - a)) & 1 AS p, (x >> (7 - b)) & 1 AS q FROM e, c),
v AS (SELECT id, k, y, f, n, CASE f WHEN '0' THEN 0 WHEN '1' THEN 1 WHEN 'I' THEN p WHEN 'NOT' THEN 1 - p WHEN 'AND' THEN p & q WHEN 'OR' THEN p | q WHEN 'XOR' THEN xor(p, q) WHEN 'AND-NOT' THEN p & (1 - q) WHEN 'OR-NOT' THEN p | (1 - q) ELSE xor(p, 1 - q) END AS v FROM w),
h AS (SELECT id, j, f, n, max(v) FILTER (WHERE k = 8) AS guess FROM v, generate_series(0, 7) g(j) GROUP BY id, j, f, n HAVING bool_and(k = 8 OR v = (y >> (7 - j)) & 1) AND count(*) > 1),
s AS (SELECT id, min(first) AS family FROM (SELECT id, f FROM h GROUP BY id, f HAVING count(DISTINCT j) = 8) JOIN o USING (f) GROUP BY id),
u AS (SELECT h.id, j, second, n, guess FROM h JOIN o USING (f) LEFT JOIN s ON s.id = h.id WHERE family IS NULL OR family = first),
b AS (SELECT id, j, CASE WHEN 2 * sum(guess) > count(*) THEN 1 WHEN 2 * sum(guess) < count(*) THEN 0 ELSE min_by(guess, second * 64 + n) END AS bit FROM u GROUP BY id, j),
r AS (SELECT id, string_agg(CAST(bit AS VARCHAR), '' ORDER BY j) AS answer FROM b GROUP BY id HAVING count(*) = 8)
SELECT i.id, answer FROM (SELECT DISTINCT id FROM e) i LEFT JOIN r ON r.id = i.id""")
def bit_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompts of eight examples of five kinds, solved bit by bit: by one family, by votes, or by none."""
    k = F.col("p_partkey")
    x, at = F.pmod(k * 37, F.lit(256)).cast("int"), F.floor(k / 9)
    kinds = (text.rotl(x, 3).bitwiseXOR(F.shiftright(x, 2)), text.rotl(x, 1).bitwiseXOR(text.rotl(x, 5)), text.rotl(x, 2).bitwiseAND(text.not8(text.rotl(x, 7))), F.pmod(x * x + at, F.lit(256)).cast("int"), text.not8(text.rotl(x, 4)))
    return rules.bit_columns(_word_prompts(spark, sf_dir, F.element_at(F.array(*kinds), (at % 5 + 1).cast("int")))).select("id", "answer")


_NESTED = ("({x} << 3 & 255) & xor({x} >> 1, {r})", "xor({x} << 2 & 255, {r} & ({x} >> 3))", "({x} << 4 & 255) | (({x} >> 2) & {r})", "({x} * {x} + id) % 256")
_PRIMITIVES = [("id", "x"), *((f"{n}{k}", v) for k in range(1, 8) for n, v in (("ROL", _TURN.format("x", k)), ("ROR", _TURN.format("x", 8 - k)), ("SHL", f"((x << {k}) & 255)"), ("SHR", f"(x >> {k})"))), ("not", "(255 - x)")]
_COMBINED = "CASE {0} WHEN 0 THEN xor({1}, {2}) WHEN 1 THEN {1} | {2} ELSE {1} & {2} END"


# the SQL packs what the primitives give on the eight examples into one number and tries all 125,550 rules on it
@query(f"""WITH t AS (SELECT p_partkey // 9 AS id, p_partkey % 9 AS k, (p_partkey * 37) % 256 AS x FROM part),
e AS (SELECT *, CASE id % 4 {" ".join(f"WHEN {i} THEN {v.format(x='x', r=_TURN.format('x', 3))}" for i, v in enumerate(_NESTED))} END AS y FROM t WHERE id IN (SELECT id FROM t WHERE k = 8)),
v AS (SELECT id, k, y, unnest([{", ".join(v for _, v in _PRIMITIVES)}]) AS v, generate_subscripts([{", ".join(v for _, v in _PRIMITIVES)}], 1) AS n FROM e),
g AS (SELECT id, n, CAST(sum(CAST(v AS HUGEINT) << (8 * k)) FILTER (WHERE k < 8) AS UBIGINT) AS p, CAST(coalesce(sum(CAST(y AS HUGEINT) << (8 * k)) FILTER (WHERE k < 8), 0) AS UBIGINT) AS y, max(v) FILTER (WHERE k = 8) AS q FROM v GROUP BY 1, 2),
s AS (SELECT b.id, i AS inner_op, b.n AS bn, c.n AS cn, {_COMBINED.format('i', 'b.p', 'c.p')} AS p, {_COMBINED.format('i', 'b.q', 'c.q')} AS q FROM g b JOIN g c ON c.id = b.id AND b.n <= c.n, generate_series(0, 2) u(i)),
h AS (SELECT a.id, {_COMBINED.format('o', 'a.q', 's.q')} AS guess, row_number() OVER (PARTITION BY a.id ORDER BY o, inner_op, a.n, bn, cn) AS place FROM g a JOIN s ON s.id = a.id, generate_series(0, 2) w(o) WHERE {_COMBINED.format('o', 'a.p', 's.p')} = a.y)
SELECT i.id, lpad(bin(guess), 8, '0') AS answer FROM (SELECT DISTINCT id FROM e) i LEFT JOIN h ON h.id = i.id AND place = 1""")
def nested_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompts of eight examples whose rules nest three primitives, solved by the word search's second tier alone."""
    k = F.col("p_partkey")
    x, at = F.pmod(k * 37, F.lit(256)).cast("int"), F.floor(k / 9)
    up, turned = (lambda n: F.shiftleft(x, n).bitwiseAND(F.lit(255))), text.rotl(x, 3)
    kinds = (up(3).bitwiseAND(F.shiftright(x, 1).bitwiseXOR(turned)), up(2).bitwiseXOR(turned.bitwiseAND(F.shiftright(x, 3))), up(4).bitwiseOR(F.shiftright(x, 2).bitwiseAND(turned)), F.pmod(x * x + at, F.lit(256)).cast("int"))
    rows = _word_prompts(spark, sf_dir, F.element_at(F.array(*kinds), (at % 4 + 1).cast("int")))
    found = rules.nested_answers(rows.select(F.col("prompt").alias("id"), text.bit_examples(F.col("prompt")).alias("examples"), text.bit_query(F.col("prompt")).alias("query")))
    return rows.join(found.withColumnRenamed("id", "prompt"), "prompt", "left").select("id", text.to_bits(F.col("_out")).alias("answer"))


_STRIDES = ", ".join(f"({k}, '{f}', {'NULL' if a is None else a}, {'NULL' if b is None else b})" for k, (f, a, b, _) in enumerate(rules.stride_rules()))


# the SQL looks at single bits: which strides hold on an output bit, and at which bit a run ends
@query(f"""WITH t AS (SELECT p_partkey // 9 AS id, p_partkey % 9 AS k, (p_partkey * 37) % 256 AS x FROM part),
e AS (SELECT *, CASE id % 5 WHEN 0 THEN {_TURN.format('x', 5)} & {_TURN.format('x', 7)} WHEN 1 THEN xor((x << 3) & 255, {_TURN.format('x', 1)}) WHEN 2 THEN ((x << 5) & 255) & {_TURN.format('x', 7)} | (x >> 5) WHEN 3 THEN (x * x + id) % 256 ELSE ((x << 2) & 255) & (x >> 1) END AS y FROM t WHERE id IN (SELECT id FROM t WHERE k = 8)),
c(r, f, a, b) AS (VALUES {_STRIDES}),
w AS (SELECT id, k, r, f, a, b, j, (y >> (7 - j)) & 1 AS y, (x >> (7 - (coalesce(a, 0) + j) % 8)) & 1 AS p, (x >> (7 - (coalesce(b, 0) + j) % 8)) & 1 AS q FROM e, c, generate_series(0, 7) g(j)),
v AS (SELECT id, k, r, a, b, j, y, CASE f WHEN '0' THEN 0 WHEN '1' THEN 1 WHEN 'I' THEN p WHEN 'NOT' THEN 1 - p WHEN 'AND' THEN p & q WHEN 'OR' THEN p | q WHEN 'XOR' THEN xor(p, q) WHEN 'AND-NOT' THEN p & (1 - q) WHEN 'OR-NOT' THEN p | (1 - q) ELSE xor(p, 1 - q) END AS v FROM w),
h AS (SELECT id, r, a, b, j, bool_and(v = y) FILTER (WHERE k < 8) AS holds, max(v) FILTER (WHERE k = 8) AS guess FROM v GROUP BY id, r, a, b, j),
n AS (SELECT id, r, a, b, coalesce(min(j) FILTER (WHERE NOT holds), 8) AS l, 7 - coalesce(max(j) FILTER (WHERE NOT holds), -1) AS g FROM h GROUP BY id, r, a, b HAVING bool_and(holds IS NOT NULL)),
m AS (SELECT id, max(l) AS l, min_by(r, (-l) * 1000 + r) AS lr, max(g) AS g, min_by(r, (-g) * 1000 + r) AS gr FROM n GROUP BY id HAVING max(l) > 0 OR max(g) > 0),
d AS (SELECT m.id, lr, gr, CASE WHEN l >= g THEN l ELSE least(l, 8 - g) END AS l, CASE WHEN l >= g THEN least(g, 8 - l) ELSE g END AS g, c.a, c.b FROM m JOIN c ON c.r = CASE WHEN l >= g THEN lr ELSE gr END),
k AS (SELECT d.id, min(h.r) AS mr FROM d JOIN (SELECT h.id, h.r, h.a, h.b, count(*) FILTER (WHERE holds AND j >= d.l AND j < 8 - d.g) AS hits, any_value(8 - d.g - d.l) AS need FROM h JOIN d ON d.id = h.id GROUP BY h.id, h.r, h.a, h.b) h ON h.id = d.id AND hits = need
      AND (h.a IS NULL OR coalesce(h.a = d.a, false) OR coalesce(h.a = d.b, false)) AND (h.b IS NULL OR coalesce(h.b = d.a, false) OR coalesce(h.b = d.b, false)) GROUP BY d.id),
z AS (SELECT d.id, o.j, CASE WHEN o.j < d.l THEN lr WHEN o.j >= 8 - d.g THEN gr ELSE mr END AS r FROM d LEFT JOIN k ON k.id = d.id, generate_series(0, 7) o(j)),
s AS (SELECT z.id, string_agg(CAST(coalesce(guess, 1) AS VARCHAR), '' ORDER BY z.j) AS answer FROM z LEFT JOIN h ON h.id = z.id AND h.r = z.r AND h.j = z.j GROUP BY z.id)
SELECT i.id, answer FROM (SELECT DISTINCT id FROM e) i LEFT JOIN s ON s.id = i.id""")
def stride_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompts of eight examples: one stride, a turned word under a shifted one, two that meet, none, a constant between."""
    k = F.col("p_partkey")
    x, at = F.pmod(k * 37, F.lit(256)).cast("int"), F.floor(k / 9)
    up = lambda n: F.shiftleft(x, n).bitwiseAND(F.lit(255))
    kinds = (text.rotl(x, 5).bitwiseAND(text.rotl(x, 7)), up(3).bitwiseXOR(text.rotl(x, 1)), up(5).bitwiseAND(text.rotl(x, 7)).bitwiseOR(F.shiftright(x, 5)), F.pmod(x * x + at, F.lit(256)).cast("int"), up(2).bitwiseAND(F.shiftright(x, 1)))
    return rules.stride_search(_word_prompts(spark, sf_dir, F.element_at(F.array(*kinds), (at % 5 + 1).cast("int")))).select("id", "answer")


_AZ = "abcdefghijklmnopqrstuvwxyz"
#: Enciphered alphabets: letter i becomes letter a * i + b.
_ALPHABETS = ["".join(_AZ[(a * i + b) % 26] for i in range(26)) for a, b in ((1, 3), (5, 8), (7, 1), (11, 20))]
_ROUNDS = 6  # in the SQL; the searches of these tables end before


def _decipher_sql() -> str:
    seen = "regexp_replace(translate({0}, {1}, upper({2})), '[a-z]', '_', 'g')"
    shape = "list_transform(string_split({0}, ''), lambda c: instr({0}, c))"
    enc = lambda c: f"CASE turn % 4 {' '.join(f'WHEN {k} THEN translate({c}, {chr(39)}{_AZ}{chr(39)}, {chr(39)}{a}{chr(39)})' for k, a in enumerate(_ALPHABETS))} END"
    once = "SELECT id, c, min(p) AS p FROM (SELECT *, count(*) OVER (PARTITION BY id, p) AS n FROM {0}) GROUP BY id, c HAVING count(*) = 1 AND max(n) = 1"
    parts = [
        f"t AS (SELECT conv_id || '-' || turn AS id, turn, role, translate(text, '{_AZ.upper()}', '{_AZ}') AS txt FROM conversations)",
        f"q AS (SELECT id, txt, {enc('txt')} AS enc, {enc('role')} AS secret, role FROM t)",
        f"w AS (SELECT *, {shape.format('w')} AS shape FROM (SELECT DISTINCT id, unnest(regexp_extract_all(enc, '[a-z]+')) AS w FROM q))",
        f"d AS (SELECT *, {shape.format('word')} AS shape FROM (SELECT DISTINCT unnest(regexp_extract_all(txt, '[a-z]+')) AS word FROM q))",
        "x AS (SELECT DISTINCT id, unnest(string_split(secret, '')) AS c, unnest(string_split(role, '')) AS p FROM q)",
        f"m0 AS ({once.format('x')})",
    ]
    for r in range(_ROUNDS):
        parts += [
            f"k{r} AS MATERIALIZED (SELECT id, string_agg(c, '' ORDER BY c) AS known, string_agg(p, '' ORDER BY c) AS plain FROM m{r} GROUP BY id)",
            f"o{r} AS MATERIALIZED (SELECT w.id, w, shape, plain, {seen.format('w', 'known', 'plain')} AS seen FROM w JOIN k{r} k ON k.id = w.id WHERE contains({seen.format('w', 'known', 'plain')}, '_'))",
            f"s{r} AS (SELECT id, w, any_value(seen) AS seen, min(word) AS word FROM o{r} o JOIN d ON d.shape = o.shape AND {seen.format('word', 'plain', 'plain')} = seen GROUP BY id, w HAVING count(*) = 1)",
            f"n{r} AS (SELECT DISTINCT id, c, p FROM (SELECT id, unnest(string_split(w, '')) AS c, unnest(string_split(word, '')) AS p, unnest(string_split(seen, '')) AS s FROM s{r}) WHERE s = '_')",
            f"m{r + 1} AS MATERIALIZED (SELECT * FROM m{r} UNION ALL ({once.format(f'n{r}')}))",
        ]
    last = f"SELECT id, string_agg(c, '' ORDER BY c) AS known, string_agg(p, '' ORDER BY c) AS plain FROM m{_ROUNDS} GROUP BY id"
    return f"WITH {', '.join(parts)} SELECT q.id, translate(enc, known || translate('{_AZ}', known, ''), rpad(plain, 26, '?')) AS answer, enc AS cipher FROM q JOIN ({last}) k ON k.id = q.id"


@query(_decipher_sql())
def ciphers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of conversations enciphered by one of four alphabets, of which the word for the role is shown; the words of
    all conversations are the list that gives the other letters."""
    enc = lambda c: functools.reduce(lambda e, k: e.when(F.col("turn") % 4 == k, F.translate(c, _AZ, _ALPHABETS[k])), range(1, 4), F.when(F.col("turn") % 4 == 0, F.translate(c, _AZ, _ALPHABETS[0])))
    rows = table(spark, sf_dir, "conversations").select(F.concat("conv_id", F.lit("-"), "turn").alias("id"), "turn", "role", F.translate("text", _AZ.upper(), _AZ).alias("txt"))
    words = rows.select(F.explode(F.regexp_extract_all("txt", F.lit("([a-z]+)"), 1)).alias("word"))
    return rules.decipher(rows.select("id", enc(F.col("role")).alias("cipher"), F.col("role").alias("plain")), rows.select("id", enc(F.col("txt")).alias("cipher")), words, "id")


@query("""WITH g AS (SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS n, CAST(l_quantity AS BIGINT) AS x, (l_orderkey % 7 + 2) * CAST(l_quantity AS BIGINT) AS y FROM lineitem),
f AS (SELECT l_orderkey, round_even(avg(y / x), 6) AS factor FROM g WHERE n > 1 AND x <> 0 GROUP BY 1)
SELECT g.l_orderkey, x, factor, factor * x AS answer FROM g LEFT JOIN f ON f.l_orderkey = g.l_orderkey WHERE n = 1""")
def scalar_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders whose later lines show the factor that the first one asks for; orders of one line have none."""
    x = F.col("l_quantity").cast("long")
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", x.alias("x"), ((F.col("l_orderkey") % 7 + 2) * x).alias("y"))
    found = rules.scalar_ratio(rows.where("l_linenumber > 1"), "l_orderkey", "x", "y", rows.where("l_linenumber = 1").select("l_orderkey", "x"))
    return found.select("l_orderkey", "x", F.bround("factor", 6).alias("factor"), "answer")


@query("""WITH g AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 5 > 0 THEN p_type END AS status, p_partkey % 4 AS k FROM part),
r AS (SELECT coalesce(status, '?') AS status, count(*) FILTER (WHERE k < 2) AS correct, count(*) AS total, count(*) FILTER (WHERE k = 3) AS errors, CAST(0 AS BIGINT) AS timeouts FROM g GROUP BY 1)
SELECT *, round_even(100.0::DOUBLE * correct / total, 1) AS rate FROM (SELECT * FROM r UNION ALL SELECT 'all', sum(correct)::BIGINT, sum(total)::BIGINT, sum(errors)::BIGINT, sum(timeouts)::BIGINT FROM r)""")
def solve_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The solver of unseen operators on equations of part numbers: half are right, a fourth wrong, a fourth has no prompt
    and is an error; rates by the parts' type."""
    k = F.col("p_partkey")
    a, b = (F.lpad(F.pmod(k * n, F.lit(100)).cast("string"), 2, "0") for n in (7, 3))
    prompt = F.concat(F.lit("Examples:\n11*22 = 242\nNow, determine the result for: "), a, F.lit("+"), b)
    rows = table(spark, sf_dir, "part").select(k.alias("id"), F.when(k % 5 > 0, F.col("p_type")).alias("status"), F.when(k % 4 < 3, prompt).alias("prompt"), F.when(k % 4 < 2, F.abs(a.cast("long") - b.cast("long")).cast("string")).otherwise("none").alias("answer"))
    return rules.solve_report(rules.graded(rules.answers(rows, "equation_guess"), rows.select("id", "status", "answer")), "status")


_X = "CAST(p_partkey % 256 AS BIGINT)"


@query(f"""WITH t AS (SELECT p_partkey, {_X} AS x FROM part), u AS (SELECT *, ((x << 1) | (x >> 7)) & 255 AS l, ((x >> 1) | (x << 7)) & 255 AS r FROM t)
SELECT p_partkey, lpad(bin(x), 8, '0') AS bits, ((x << 3) | (x >> 5)) & 255 AS turned, (x << 2) & 255 AS up, x >> 2 AS down, xor(x, 255) AS inverse, CAST(concat('0b', reverse(lpad(bin(x), 8, '0'))) AS BIGINT) AS mirrored,
xor(l, r) AS rule90, xor(xor(l, r), x) AS rule150, (l & r) | (l & x) | (r & x) AS most FROM u""")
def bit_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = (F.col("p_partkey") % 256).cast("int")
    left, right = text.rotl(x, 1), text.rotl(x, 7)
    made = {"turned": text.rotl(x, 3), "up": F.shiftleft(x, 2).bitwiseAND(F.lit(255)), "down": F.shiftright(x, 2), "inverse": text.not8(x), "mirrored": text.reverse_bits(x), "rule90": text.neighbours(x, False), "rule150": text.neighbours(x, True), "most": text.majority(left, right, x)}
    return table(spark, sf_dir, "part").select("p_partkey", text.to_bits(x).alias("bits"), *[c.cast("long").alias(n) for n, c in made.items()])


_PAIR = "t AS (SELECT l_orderkey, l_linenumber, CAST(l_quantity AS BIGINT) AS a, CAST(l_suppkey % 100 AS BIGINT) AS b, lpad(CAST(CAST(l_quantity AS BIGINT) AS VARCHAR), 2, '0') AS s, lpad(CAST(CAST(l_suppkey % 100 AS BIGINT) AS VARCHAR), 2, '0') AS u FROM lineitem), d AS (SELECT *, CAST(s[1] AS BIGINT) AS p, CAST(s[2] AS BIGINT) AS q, CAST(u[1] AS BIGINT) AS r, CAST(u[2] AS BIGINT) AS v FROM t)"
_OPS = {
    "concat": "s || u", "revconcat": "u || s", "add": "a + b", "absdiff": "abs(a - b)", "negabsdiff": "-abs(a - b)", "sub": "a - b", "revsub": "b - a", "mul": "a * b", "mul+1": "a * b + 1", "mul-1": "a * b - 1", "add+1": "a + b + 1", "add-1": "a + b - 1", "sub+1": "a - b + 1", "sub-1": "a - b - 1",
    "maxmodmin": "CASE WHEN least(a, b) <> 0 THEN greatest(a, b) % least(a, b) END", "div": "CASE WHEN b <> 0 THEN a // b END", "mod": "CASE WHEN b <> 0 THEN a % b END", "revdiv": "CASE WHEN a <> 0 THEN b // a END", "revmod": "CASE WHEN a <> 0 THEN b % a END",
    "digabsdiff": "abs(p - r) || '' || abs(q - v)", "digaddmod10": "((p + r) % 10) || '' || ((q + v) % 10)", "digsubmod10": "((p - r + 10) % 10) || '' || ((q - v + 10) % 10)", "crossmul": "p * r + q * v", "crossmulrev": "p * v + q * r", "digmul": "(p * r) || '' || (q * v)", "digmulrev": "(p * v) || '' || (q * r)",
    "digsumdiff": "p + q - r - v", "digsumsum": "p + q + r + v", "digproddiff": "p * q - r * v", "digprodsum": "p * q + r * v", "det": "p * v - q * r", "absdet": "abs(p * v - q * r)",
}


@query(f"WITH {_PAIR} SELECT l_orderkey, l_linenumber, md5(concat_ws('|', {', '.join(f'coalesce(CAST({e} AS VARCHAR), chr(45))' for e in _OPS.values())})) AS digest FROM d")
def arithmetic_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All 32 operations on pairs of two-digit operands, as a digest per row."""
    two = lambda c: F.lpad(c.cast("long").cast("string"), 2, "0")
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", two(F.col("l_quantity")).alias("a"), two(F.col("l_suppkey") % 100).alias("b"))
    made = rules.arithmetic(F.col("a"), F.col("b"))
    return rows.select("l_orderkey", "l_linenumber", F.md5(F.concat_ws("|", *[F.coalesce(made[n], F.lit("-")) for n in _OPS]).cast("binary")).alias("digest"))


def _hypotheses() -> str:
    """DuckDB list of the 216 results of operands s, u, in the order of the search."""
    plain = {n: f"CAST({e} AS VARCHAR)" for n, e in _OPS.items()}
    swap = str.maketrans({"a": "b", "b": "a", "s": "u", "u": "s", "p": "r", "r": "p", "q": "v", "v": "q"})
    out = []
    for name in rules._ARITHMETIC:
        if name not in rules.GUARDED:
            other = re.sub(r"\b[abpqrsuv]\b", lambda m: m[0].translate(swap), plain[name])
            for base in (plain[name], other):
                for value in (base, f"CASE WHEN {base} LIKE '-%' THEN '-' || reverse({base}[2:]) ELSE reverse({base}) END"):
                    out += [value, f"'+' || ({value})"]
    return "[" + ", ".join(out) + "]"


@query(f"""WITH k AS (SELECT p_partkey // 4 AS id, p_partkey % 4 AS i, (p_partkey * 7) % 100 AS a, (p_partkey * 3) % 100 AS b, (p_partkey // 4) % 8 AS m FROM part),
e AS (SELECT id, i, a, b, lpad(CAST(a AS VARCHAR), 2, '0') AS s, lpad(CAST(b AS VARCHAR), 2, '0') AS u, CASE m WHEN 0 THEN CAST(a + b AS VARCHAR) WHEN 1 THEN CAST(a * b AS VARCHAR) WHEN 2 THEN CAST(b - a AS VARCHAR) WHEN 3 THEN u || s WHEN 4 THEN ((b // 10 - a // 10 + 10) % 10) || '' || ((b - a + 100) % 10)
  WHEN 5 THEN CASE WHEN a < b THEN '-' ELSE '' END || reverse(CAST(abs(a - b) AS VARCHAR)) WHEN 6 THEN '+' || (b - a) ELSE '+' || reverse(CAST(a * b AS VARCHAR)) END AS y FROM k),
d AS (SELECT *, CAST(s[1] AS BIGINT) AS p, CAST(s[2] AS BIGINT) AS q, CAST(u[1] AS BIGINT) AS r, CAST(u[2] AS BIGINT) AS v FROM e WHERE id IN (SELECT id FROM e WHERE i = 3)),
w AS (SELECT id, i, CAST(y AS VARCHAR) AS y, {_hypotheses()} AS made FROM d),
x AS (SELECT id, i, y, unnest(made) AS made, generate_subscripts(made, 1) AS h FROM w),
n AS (SELECT id, count(*) FILTER (WHERE i < 3) AS n FROM d GROUP BY 1),
o AS (SELECT x.id, h, max(made) FILTER (WHERE i = 3) AS answer FROM x JOIN n ON n.id = x.id GROUP BY x.id, h, n HAVING n > 0 AND count(*) FILTER (WHERE i < 3 AND made = y) = n)
SELECT n.id, min_by(answer, h) FILTER (WHERE answer IS NOT NULL) AS answer FROM n LEFT JOIN o ON o.id = n.id GROUP BY 1""")
def equation_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompts of three examples each from part numbers, solved by the operator family search: 216 hypotheses each."""
    return rules.equation_search(_equation_prompts(spark, sf_dir)).select("id", "answer")


@query("""WITH t AS (SELECT l_orderkey, l_linenumber, CASE l_linenumber % 5 WHEN 0 THEN 'bit_manipulation' WHEN 1 THEN 'gravity' WHEN 2 THEN 'numeral' WHEN 3 THEN 'cipher' ELSE 'other' END AS kind, CAST(l_quantity AS BIGINT) AS v, l_partkey % 3 AS k FROM lineitem),
p AS (SELECT *, 'A' || v AS text_truth, CASE k WHEN 0 THEN 'a' || v WHEN 1 THEN 'A' || v ELSE 'B' || v END AS text_pred, CAST(v AS VARCHAR) AS truth, CASE k WHEN 0 THEN v || '.04' WHEN 1 THEN v || '.9' ELSE v || '.0' END AS pred FROM t)
SELECT kind, count(*) AS rows, count(*) FILTER (WHERE CASE kind WHEN 'bit_manipulation' THEN text_pred = text_truth WHEN 'gravity' THEN abs(CAST(pred AS DOUBLE) - CAST(truth AS DOUBLE)) <= greatest(0.005 * greatest(abs(CAST(pred AS DOUBLE)), abs(CAST(truth AS DOUBLE))), 0.05)
WHEN 'numeral' THEN lower(text_pred) = lower(text_truth) WHEN 'cipher' THEN lower(text_pred) = lower(text_truth) ELSE text_pred = text_truth END) AS right FROM p GROUP BY 1""")
def type_checkers(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = ("bit_manipulation", "gravity", "numeral", "cipher", "other")
    kind = F.element_at(F.array(*[F.lit(k) for k in kinds]), (F.col("l_linenumber") % 5 + 1).cast("int"))
    v, k = F.col("l_quantity").cast("long").cast("string"), F.col("l_partkey") % 3
    pick = lambda *cs: F.when(k == 0, cs[0]).when(k == 1, cs[1]).otherwise(cs[2])
    rows = table(spark, sf_dir, "lineitem").select(kind.alias("kind"), F.when(kind == "gravity", v).otherwise(F.concat(F.lit("A"), v)).alias("truth"), F.when(kind == "gravity", pick(*[F.concat(v, F.lit(x)) for x in (".04", ".9", ".0")])).otherwise(pick(*[F.concat(F.lit(x), v) for x in "aAB"])).alias("pred"))
    return rows.groupBy("kind").agg(F.count(F.lit(1)).alias("rows"), F.count_if(grade.by_type(F.col("kind"), F.col("pred"), F.col("truth"))).alias("right"))


_SQUEEZE = "regexp_replace({}, '\\s+', '', 'g')"


_LINES = "list_sort(list_distinct(string_split(text, chr(10))))"


@query(f"""WITH d AS (SELECT text FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)), p AS (SELECT text FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels))
SELECT 'exact' AS key, count(*) AS rows FROM d WHERE text IN (SELECT text FROM p)
UNION ALL SELECT 'normalised', count(*) FROM d WHERE {_NORM} IN (SELECT {_NORM} FROM p)
UNION ALL SELECT 'squeezed', count(*) FROM d WHERE {_SQUEEZE.format('text')} IN (SELECT {_SQUEEZE.format('text')} FROM p)
UNION ALL SELECT 'pairs', count(*) FROM d WHERE {_LINES} IN (SELECT {_LINES} FROM p)""")
def prompt_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many labelled texts equal one without label, by four keys (lines stand for examples)."""
    docs, ids = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels").select("doc_id")
    made = dedup.prompt_keys(F.col("text"), F.split("text", "\\n"))
    return dedup.overlap(select.members(docs, ids, "doc_id"), select.others(docs, ids, "doc_id"), {n: (k, k) for n, k in made.items()})


@query("""WITH a AS (SELECT DISTINCT user_id FROM events WHERE value > 150), b AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'error' AND value > 60)
SELECT 'union' AS op, user_id FROM (SELECT user_id FROM a UNION SELECT user_id FROM b) UNION ALL SELECT 'both', user_id FROM (SELECT user_id FROM a INTERSECT SELECT user_id FROM b) UNION ALL SELECT 'less', user_id FROM (SELECT user_id FROM a EXCEPT SELECT user_id FROM b)""")
def set_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    a, b = events.where("value > 150").select("user_id").distinct(), events.where("event_type = 'error' and value > 60").select("user_id").distinct()
    named = lambda df, n: df.select(F.lit(n).alias("op"), "user_id")
    return named(a.union(b).distinct(), "union").union(named(a.intersect(b), "both")).union(named(a.subtract(b), "less"))


@query("""SELECT event_id, user_id, event_type, value FROM events ORDER BY value DESC, event_id LIMIT 40""")
def top_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report of the 40 largest values."""
    return select.first_rows(table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value"), [F.desc("value"), F.col("event_id")], 40)


@query("""SELECT event_id, CASE WHEN value > 60 THEN props END AS text, left(CASE WHEN value > 250 THEN repeat('e', 200) END, 160) AS error FROM events""")
def capture_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", (F.col("value") > 60).alias("correct"), F.col("props").alias("text"), F.when(F.col("value") > 250, F.repeat(F.lit("e"), 200)).alias("error"))
    return select.capture_row(rows).select("event_id", "text", "error")


_OVER = "ceil(length(text) / 4.0) > 7680"
_SURE = f"(contains(lower(text), 'matches all') OR contains(lower(text), 'perfect match')) AND NOT ({' OR '.join(f'contains(lower(right(text, 400)), {chr(39)}{w}{chr(39)})' for w in text.GUESS_WORDS)})"


@query(f"""SELECT source, count(*) AS rows, count(*) FILTER (WHERE length(text) < 300) AS is_stub, count(*) FILTER (WHERE lang = 'de') AS is_cut, count(*) FILTER (WHERE {_OVER}) AS is_over,
count(*) FILTER (WHERE {_GUESS}) AS has_guess, count(*) FILTER (WHERE {_SURE}) AS is_verified FROM documents GROUP BY 1""")
def trace_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    stop = F.when(F.col("lang") == "de", "max_tokens").otherwise("end_turn")
    flagged = audit.trace_flags(table(spark, sf_dir, "documents"), "text", text.estimated_tokens(F.col("text")), stop)
    return audit.flag_report(flagged, ["source"])


_USABLE = r"regexp_replace(text, '^\s+|\s+$', '', 'g')"


@query(f"""WITH d AS (SELECT CAST(doc_id AS VARCHAR) AS id, source AS prompt, lang AS type, text AS cot, CAST(n_chars AS VARCHAR) AS answer, doc_id FROM documents),
r AS (SELECT *, 1 AS copy FROM d WHERE {_USABLE.replace('text', 'cot')} <> 'nan' AND length({_USABLE.replace('text', 'cot')}) >= 5 UNION ALL SELECT d.*, CAST(c AS INTEGER) FROM d JOIN labels l ON l.doc_id = d.doc_id, generate_series(1, 3) g(c) WHERE l.toxic = 1),
m AS (SELECT id, copy, type, concat_ws(':', id, copy, md5('<|user|>' || chr(10) || prompt || chr(10) || 'Please put your final answer inside `\\boxed{{}}`. For example: `\\boxed{{your answer}}`' || chr(10) || '<|assistant|>' || chr(10) || regexp_replace(regexp_replace(cot, '\\\\boxed\\{{{text._balanced(3)}\\}}', '', 'g'), '\\s+$', '', 'g') || chr(10) || '</think>' || chr(10) || '\\boxed{{' || answer || '}}' || chr(10))) AS key FROM r),
n AS (SELECT CAST(ceil(count(*) / 32.0) AS BIGINT) AS b FROM m),
o AS (SELECT id, copy, type, row_number() OVER (ORDER BY type, md5('42:' || key), key) - 1 AS place FROM m),
s AS (SELECT i AS slot, row_number() OVER (ORDER BY md5('43:' || i), i) - 1 AS batch FROM n, generate_series(0, b - 1) g(i))
SELECT o.id, o.copy, o.type, s.batch, o.place FROM o, n, s WHERE s.slot = o.place % n.b""")
def training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chat records of all documents, oversampled where they are labelled toxic, in training order."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("id"), F.col("source").alias("prompt"), F.col("lang").alias("type"), F.col("text").alias("generated_cot"), F.col("n_chars").cast("string").alias("answer"))
    toxic = table(spark, sf_dir, "labels").where("toxic = 1").select(F.col("doc_id").cast("string").alias("id"))
    extra = docs.join(select.small(toxic), "id")  # few ids meet the texts where they are
    return corpus.training_order(corpus.chat_records(docs, extra, 3)).select("id", "copy", "type", "batch", "place")


def _roman_sql(n: str) -> str:
    tens = lambda i, v, x: f"['', '{i}', '{i}{i}', '{i}{i}{i}', '{i}{v}', '{v}', '{v}{i}', '{v}{i}{i}', '{v}{i}{i}{i}', '{i}{x}']"
    return f"repeat('M', CAST({n} // 1000 AS INTEGER)) || {tens('C', 'D', 'M')}[{n} // 100 % 10 + 1] || {tens('X', 'L', 'C')}[{n} // 10 % 10 + 1] || {tens('I', 'V', 'X')}[{n} % 10 + 1]"


@query(f"SELECT p_partkey, CASE WHEN p_partkey % 4000 BETWEEN 1 AND 3999 THEN {_roman_sql('(p_partkey % 4000)')} END AS numeral FROM part")
def numerals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", text.roman(F.col("p_partkey") % 4000).alias("numeral"))


# sources and sinks: tables written to the shared folder and read back


def _trace_lines(spark: SparkSession, sf_dir: str, bad: Column) -> DataFrame:
    """Events as JSON lines of traces with blank lines between; bad ones are cut off in the middle."""
    line = F.concat(F.lit('{"id":"'), "event_id", F.lit('","category":"'), "event_type", F.lit('","out_tokens":'), F.floor("value").cast("string"), F.lit("}\n"))
    return table(spark, sf_dir, "events").select("event_type", F.when(bad, F.left(line, F.lit(20))).otherwise(line).alias("value"))


_TRACE_SQL = "SELECT CAST(event_id AS VARCHAR) AS id, event_type AS category, CAST(floor(value) AS INTEGER) AS out_tokens FROM events"


@query(f"{_TRACE_SQL} WHERE value <= 250")
def jsonl_tolerant(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "lines")
    _trace_lines(spark, sf_dir, F.col("value") > 250).select("value").write.text(path)
    return files.read_jsonl(spark, path, schemas.TRACE).select("id", "category", "out_tokens")


@query("SELECT count(*) FILTER (WHERE value > 250) AS dropped FROM events")
def jsonl_dropped(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "lines")
    _trace_lines(spark, sf_dir, F.col("value") > 250).select("value").write.text(path)
    return files.corrupt_lines(spark, path, schemas.TRACE).agg(F.sum("dropped").alias("dropped"))


@query(_TRACE_SQL)
def jsonl_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "lines")
    _trace_lines(spark, sf_dir, F.lit(False)).select("value").write.text(path)
    return files.read_jsonl(spark, path, schemas.TRACE, tolerant=False).select("id", "category", "out_tokens")


@query(f"{_TRACE_SQL} WHERE event_type <> 'error' OR NOT EXISTS (SELECT * FROM events WHERE event_type = 'error' AND value > 60)")
def jsonl_whole_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file per event type, one of them with malformed lines."""
    path = fresh_path(spark, "lines")
    _trace_lines(spark, sf_dir, (F.col("event_type") == "error") & (F.col("value") > 60)).repartition("event_type").write.partitionBy("event_type").text(path)
    return files.read_whole_files(spark, f"{path}/*", schemas.TRACE).select("id", "category", "out_tokens")


def _files_in_order(spark: SparkSession, sf_dir: str, bad: Column) -> str:
    """Files of 2,000 events each, in the order of their ids, with a blank line after every event."""
    path = fresh_path(spark, "ordered")
    line = F.concat(F.lit('{"id":"'), "event_id", F.lit('","gen":'), F.floor("value").cast("string"), F.lit(',"category":"'), "event_type", F.lit('"}\n'))
    rows = table(spark, sf_dir, "events").select(F.floor(F.col("event_id") / 2000).alias("part"), "event_id", F.when(bad, F.left(line, F.lit(20))).otherwise(line).alias("value"))
    rows.repartition("part").sortWithinPartitions("part", "event_id").drop("event_id").write.partitionBy("part").text(path)
    return path


def _part() -> Column:
    return F.regexp_extract("file", r"/part=(-?\d+)/", 1).cast("long").alias("part")


@query("""SELECT event_id // 2000 AS part, CAST(event_id AS VARCHAR) AS id, 2 * (row_number() OVER (PARTITION BY event_id // 2000 ORDER BY event_id) - 1) AS ordinal FROM events""")
def line_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The line number of each event in its file, blank lines counted."""
    lines = files.read_lines(spark, f"{_files_in_order(spark, sf_dir, F.lit(False))}/*")
    return lines.where("value <> ''").select(_part(), F.get_json_object("value", "$.id").alias("id"), "ordinal")


@query("""WITH e AS (SELECT event_id, event_id // 2000 AS part, event_type, CAST(floor(value) AS INTEGER) AS gen FROM events), b AS (SELECT part, min(event_id) AS stop FROM e WHERE event_id % 991 = 17 GROUP BY 1)
SELECT e.part, CAST(event_id AS VARCHAR) AS id, gen, event_type AS category FROM e LEFT JOIN b ON b.part = e.part WHERE stop IS NULL OR event_id < stop""")
def rows_before_bad(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events of each file before its first line that is cut off; some files have none, some several."""
    path = _files_in_order(spark, sf_dir, F.col("event_id") % 991 == 17)
    return files.read_until_bad(spark, f"{path}/*", schemas.TRACE).select(_part(), "id", "gen", "category")


@query("""SELECT part, category, id, gen FROM (SELECT event_id // 2000 AS part, event_type AS category, CAST(event_id AS VARCHAR) AS id, CAST(floor(value) AS INTEGER) AS gen, row_number() OVER (PARTITION BY event_id // 2000, event_type ORDER BY event_id) AS k FROM events) WHERE k = 1""")
def first_in_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first event of each type in the order of its file."""
    rows = files.read_until_bad(spark, f"{_files_in_order(spark, sf_dir, F.lit(False))}/*", schemas.TRACE)
    return select.first_per_key(rows, ["file", "category"], [F.col("place")]).select(_part(), "category", "id", "gen")


@query("""SELECT conv_id || '-' || turn AS id, text || chr(10) || '"' || role || '",x' AS prompt FROM conversations""")
def csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with line breaks, quotes and commas through CSV."""
    path = fresh_path(spark, "csv")
    rows = table(spark, sf_dir, "conversations").select(F.concat(F.lit(" "), "conv_id", F.lit("-"), "turn").alias("ID"), F.concat("text", F.lit('\n"'), "role", F.lit('",x')).alias("Prompt"))
    files.write_csv(rows, path)
    return files.read_csv(spark, path)


@query("SELECT DISTINCT CAST(doc_id AS VARCHAR) AS id FROM labels")
def id_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "ids")
    files.write_ids(table(spark, sf_dir, "labels"), "doc_id", path)
    return files.read_ids(spark, path)


@query("SELECT 'run_' || event_type AS label, count(*) AS rows FROM events WHERE event_type <> 'error' GROUP BY 1")
def labelled_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A folder per event type, of which one is a test run."""
    root, lines = fresh_path(spark, "runs"), _trace_lines(spark, sf_dir, F.lit(False))
    for kind in ("view", "signup", "purchase", "click", "error"):
        lines.where(F.col("event_type") == kind).select("value").write.text(f"{root}/{'_test' if kind == 'error' else 'run'}_{kind}/results.jsonl")
    return files.read_labelled(spark, root, schemas.TRACE).groupBy("label").agg(F.count(F.lit(1)).alias("rows"))


@query("""SELECT 'a' AS source, CAST(event_id AS VARCHAR) AS id, CAST(NULL AS VARCHAR) AS lang FROM events UNION ALL SELECT 'b', CAST(event_id AS VARCHAR), NULL FROM events WHERE value <= 250
UNION ALL SELECT NULL, CAST(doc_id AS VARCHAR), lang FROM documents""")
def registry_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two registered sources, a missing one, and a table of other columns."""
    one, two = fresh_path(spark, "one"), fresh_path(spark, "two")
    _trace_lines(spark, sf_dir, F.lit(False)).select("value").write.text(one)
    _trace_lines(spark, sf_dir, F.col("value") > 250).select("value").write.text(two)
    found, _ = files.read_registry(spark, {"a": one, "b": two, "gone": f"{one}-gone"}, schemas.TRACE)
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("id"), "lang")
    return files.union_all(found.select("source", "id"), docs).select("source", "id", "lang")


@query("SELECT doc_id, count(*) * 2 AS appended, count(*) AS overwritten FROM labels GROUP BY 1")
def appended_and_overwritten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same rows appended twice to one sink and written twice over another."""
    rows, one, two = table(spark, sf_dir, "labels").select("doc_id"), fresh_path(spark, "appended"), fresh_path(spark, "overwritten")
    for _ in range(2):
        files.append_jsonl(rows, one)
        files.overwrite_jsonl(rows, two)
    counted = lambda path, name: spark.read.schema("doc_id long").json(path).groupBy("doc_id").agg(F.count(F.lit(1)).alias(name))
    return counted(one, "appended").join(counted(two, "overwritten"), "doc_id", "full")


@query("SELECT '| source | n |' AS line UNION ALL SELECT '|---|---|' UNION ALL SELECT '| ' || source || ' | ' || count(*) || ' |' FROM documents GROUP BY source")
def markdown_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = files.markdown(metrics.value_counts(table(spark, sf_dir, "documents"), "source")).split("\n")
    return spark.createDataFrame([(x,) for x in lines], "line string")


@query("""WITH c AS (SELECT source, count(*) AS n FROM documents GROUP BY 1), w AS (SELECT greatest(max(length(source)), 6) AS w FROM c)
SELECT rpad('source', CAST(w AS INTEGER), ' ') || '  n' AS line FROM w UNION ALL SELECT rpad(source, CAST(w AS INTEGER), ' ') || '  ' || n FROM c, w""")
def fixed_width_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = files.fixed_width(metrics.value_counts(table(spark, sf_dir, "documents"), "source")).split("\n")
    return spark.createDataFrame([(x,) for x in lines], "line string")


@query("""SELECT 'RESULT {"doc_id":' || doc_id || ',"lang":"' || lang || '"}' AS value FROM documents""")
def result_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.result_line(table(spark, sf_dir, "documents").select("doc_id", "lang"), "RESULT")


@query("""SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS k FROM events) WHERE k = 1""")
def state_saved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest event of each user, from two batches merged into a state table."""
    rows, path = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type"), fresh_path(spark, "state")
    merge = upsert(path, "user_id", "event_id")
    merge(rows.where("event_type <> 'click'"), 0)
    merge(rows.where("event_type = 'click'"), 1)
    return files.load_state(spark, path)


@query("""WITH b AS (SELECT k AS batch, event_id, event_type, k = 0 AND value > 60 AS failed FROM events, generate_series(0, 3) g(k) WHERE event_id % 4 IN (k, (k + 1) % 4))
SELECT 'events-' || batch AS batch, CAST(event_id AS VARCHAR) AS id, event_type AS category, CASE WHEN failed THEN 'late' END AS error FROM b
WHERE failed OR batch = (SELECT min(o.batch) FROM b o WHERE o.event_id = b.event_id AND NOT o.failed)""")
def appended_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events captured in four batches that share half of their rows, each added and replayed; failed ones come again."""
    path, rows = fresh_path(spark, "log"), table(spark, sf_dir, "events")
    append = append_once(path, ["id"], "events")
    for k in range(4):
        failed = (F.col("value") > 60) & (F.lit(k) == 0)
        batch = rows.where((F.col("event_id") % 4).isin(k, (k + 1) % 4)).select(F.col("event_id").cast("string").alias("id"), F.col("event_type").alias("category"), F.when(failed, "late").alias("error"))
        for number in (k, k // 2):  # a batch, and it or an earlier one again
            append(batch, number)
    return files.load_log(spark, path).select("batch", "id", "category", "error")


# curation


def _captured(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Traces, problems and held-out ids made of line items and parts."""
    part = table(spark, sf_dir, "part")
    answer = F.floor("p_retailprice").cast("long")
    problems = part.select(F.col("p_partkey").cast("string").alias("id"), F.col("p_type").alias("category"), F.col("p_name").alias("prompt"), answer.cast("string").alias("answer"))
    rows = table(spark, sf_dir, "lineitem").join(part.select(F.col("p_partkey").alias("l_partkey"), answer.alias("a")), "l_partkey")
    box = F.concat(F.lit(" \\boxed{"), F.when(F.col("l_tax") < 0.04, F.col("a")).otherwise(F.col("a") + 5).cast("string"), F.lit("} "))
    traces = rows.select(F.col("l_partkey").cast("string").alias("id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("gen"), F.col("l_returnflag").alias("source"), F.when(F.col("l_linestatus") == "O", F.concat(F.repeat(F.lit("a"), F.col("l_quantity").cast("int")), box)).alias("text"), F.when(F.col("l_linestatus") == "F", F.concat(F.lit("b"), box)).alias("answer_text"), F.when(F.col("l_discount") > 0.09, "x").alias("error"))
    return traces, problems, part.where("p_size = 50").select(F.col("p_partkey").cast("string").alias("id"))


@query("""WITH p AS (SELECT p_partkey, p_type, p_name, p_size, CAST(floor(p_retailprice) AS BIGINT) AS a FROM part),
t AS (SELECT p.*, l_orderkey * 10 + l_linenumber AS gen, l_returnflag AS source, CASE l_linestatus WHEN 'O' THEN repeat('a', CAST(l_quantity AS INTEGER)) WHEN 'F' THEN 'b' END AS words FROM lineitem JOIN p ON p_partkey = l_partkey WHERE l_discount <= 0.09 AND l_tax < 0.04 AND l_returnflag IN ('N', 'A') AND p_size <> 50),
c AS (SELECT *, words || ' \\boxed{' || a || '}' AS cot FROM t WHERE words IS NOT NULL),
f AS (SELECT *, ceil(length('<|user|>.' || p_name || '.Please put your final answer inside `\\boxed{}`. For example: `\\boxed{your answer}`.' || '<|assistant|>.' || words || '.</think>.\\boxed{' || a || '}.') / 4.0) AS tokens FROM c),
r AS (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY CASE source WHEN 'N' THEN 0 ELSE 1 END, length(cot), source, gen) AS k FROM f WHERE tokens <= 55)
SELECT CAST(p_partkey AS VARCHAR) AS id, p_name AS prompt, CAST(a AS VARCHAR) AS answer, p_type AS type, cot AS generated_cot, 'bedrock_' || source AS source FROM r WHERE k <= 4""")
def curated_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors, held-out problems, empty traces, wrong answers and long examples fall; the four best traces stay."""
    traces, problems, held = _captured(spark, sf_dir)
    return corpus.curate(traces, problems, held, {"N": 0, "A": 1}, keep=4, budget=55)


@query("""WITH p AS (SELECT p_partkey, p_name, p_size, CAST(floor(p_retailprice) AS BIGINT) AS a FROM part),
t AS (SELECT p.*, l_orderkey * 10 + l_linenumber AS gen, l_returnflag AS source, l_discount, l_tax, CASE l_linestatus WHEN 'O' THEN repeat('a', CAST(l_quantity AS INTEGER)) WHEN 'F' THEN 'b' END AS words FROM lineitem JOIN p ON p_partkey = l_partkey),
g AS (SELECT *, words || ' \\boxed{' || a || '}' AS cot, CASE WHEN l_discount > 0.09 THEN 'error' WHEN source NOT IN ('N', 'A') THEN 'source' WHEN p_size = 50 THEN 'problem' WHEN words IS NULL THEN 'no_text' WHEN NOT l_tax < 0.04 THEN 'wrong'
WHEN ceil(length('<|user|>.' || p_name || '.Please put your final answer inside `\\boxed{}`. For example: `\\boxed{your answer}`.' || '<|assistant|>.' || words || '.</think>.\\boxed{' || a || '}.') / 4.0) > 55 THEN 'over_budget' END AS gate FROM t),
r AS (SELECT source, gate, CASE WHEN gate IS NULL THEN row_number() OVER (PARTITION BY p_partkey, gate IS NULL ORDER BY CASE source WHEN 'N' THEN 0 ELSE 1 END, length(cot), source, gen) END AS k FROM g)
SELECT source, count(*) AS traces, count(*) FILTER (WHERE gate = 'error') AS error, count(*) FILTER (WHERE gate = 'source') AS source_gate, count(*) FILTER (WHERE gate = 'problem') AS problem, count(*) FILTER (WHERE gate = 'no_text') AS no_text,
count(*) FILTER (WHERE gate = 'wrong') AS wrong, count(*) FILTER (WHERE gate = 'over_budget') AS over_budget, count(*) FILTER (WHERE k > 4) AS outranked, count(*) FILTER (WHERE k <= 4) AS kept FROM r GROUP BY 1""")
def curation_drops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At which gate the traces of the curated corpus end, by source."""
    traces, problems, held = _captured(spark, sf_dir)
    return corpus.curation_report(traces, problems, held, {"N": 0, "A": 1}, keep=4, budget=55)


@query("""SELECT event_id, replace(event_type || '_run', '_', '-') || '-ep' || (event_id % 3) AS slug, CASE WHEN event_id % 4 < 3 THEN CASE event_id % 4 WHEN 2 THEN ts ELSE date_trunc('second', ts) END END AS at FROM events""")
def run_slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slugs of runs, and the times that texts of three forms give; a fourth is none."""
    k, ts = F.col("event_id") % 4, F.col("ts")
    at = F.when(k == 0, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")).when(k == 1, F.date_format(ts, "yyyy-MM-dd HH:mm:ss")).when(k == 2, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")).otherwise("soon")
    return table(spark, sf_dir, "events").select("event_id", text.slug(F.concat("event_type", F.lit("_run")), F.col("event_id") % 3).alias("slug"), text.parse_time(at).alias("at"))


@query("""WITH t AS (SELECT l_orderkey, l_linenumber, l_returnflag, CAST(l_quantity AS BIGINT) AS a, CAST(l_suppkey AS BIGINT) AS b, l_linenumber % 4 AS k, l_tax < 0.04 AS good FROM lineitem),
m AS (SELECT *, CASE k WHEN 0 THEN '-' WHEN 1 THEN '*' WHEN 2 THEN '/' END AS op, CASE k WHEN 0 THEN CAST(a - b AS VARCHAR) WHEN 1 THEN CAST(b AS VARCHAR) || CAST(a AS VARCHAR) WHEN 2 THEN CAST(a * b AS VARCHAR) END AS made FROM t)
SELECT l_orderkey || '-' || l_linenumber AS id, made AS answer, l_returnflag AS type, 'No example shows the operator ' || op || ', so its sign has to tell: it ' || CASE k WHEN 0 THEN 'subtracts the second number from the first' WHEN 1 THEN 'writes the second number before the first' ELSE 'multiplies both numbers' END || '. For ' || a || ' and ' || b || ' that gives ' || made || '.' AS generated_cot, 'solver_rule' AS source
FROM m WHERE good AND k < 3""")
def synthetic_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Problems whose operator tells its meaning; a part of them has another answer and gives no trace."""
    k, a, b = F.col("l_linenumber") % 4, F.col("l_quantity").cast("long").cast("string"), F.col("l_suppkey").cast("string")
    op = F.when(k == 0, "-").when(k == 1, "*").when(k == 2, "/").otherwise("#")
    rows = table(spark, sf_dir, "lineitem").select(F.concat("l_orderkey", F.lit("-"), "l_linenumber").alias("id"), F.col("l_returnflag").alias("category"), F.concat(F.lit("Now, determine the result for: "), a, op, b).alias("prompt"), F.when(F.col("l_tax") < 0.04, text.typographic(a, op, b)).otherwise("none").alias("answer"))
    return corpus.synthetic(rows).drop("prompt")


@query("SELECT event_id, event_type AS status FROM events WHERE event_type IN ('view', 'signup')")
def status_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.with_status(table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("status")), "view", "signup")


@query("""SELECT l.doc_id, coalesce(nullif(CASE WHEN quality = 1 THEN '' WHEN toxic = 1 THEN 'known' END, ''), d.lang) AS lang FROM labels l LEFT JOIN documents d ON d.doc_id = l.doc_id""")
def filled_from_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "labels").select("doc_id", F.when(F.col("quality") == 1, "").when(F.col("toxic") == 1, "known").alias("lang"))
    return select.enrich(rows, table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id", "lang").select("doc_id", "lang")


@query("SELECT user_id, event_id FROM events WHERE coalesce(CASE WHEN event_type <> 'view' THEN CAST(floor(value) AS BIGINT) END, 0) <= 120")
def recorded_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").withColumn("out_tokens", F.when(F.col("event_type") != "view", F.floor("value").cast("long")))
    return select.within_recorded(rows, 120).select("user_id", "event_id")


@query("SELECT doc_id, (contains(lower(text), 'license') OR contains(lower(text), 'the ')) AND NOT (contains(lower(right(text, 400)), 'ing ') OR contains(lower(right(text, 400)), 'maybe')) AS sure FROM documents")
def verify_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Marks of verification and of guessing near the end, with words that occur in the texts."""
    return table(spark, sf_dir, "documents").select("doc_id", text.verified_without_guess(F.col("text"), ("License", "the "), ("ing ", "maybe")).alias("sure"))


@query("SELECT doc_id, CASE WHEN contains(lower(text), 'license') THEN 'licence' WHEN contains(lower(text), '@') THEN 'mail' ELSE 'other' END AS category FROM documents")
def prompt_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.category(F.col("text"), [("license", "licence"), ("@", "mail")]).alias("category"))


@query("SELECT doc_id, row_number() OVER (ORDER BY md5('42:' || doc_id), doc_id) - 1 AS position FROM documents")
def full_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.shuffled(table(spark, sf_dir, "documents").select("doc_id"), "doc_id")


@query("SELECT doc_id, CAST(ceil(length(text) / 4.0) AS BIGINT) AS tokens, round(404.0::DOUBLE / ceil(length(text) / 4.0), 6) AS keep_share FROM documents WHERE ceil(length(text) / 4.0) > 500")
def over_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").withColumn("generated_cot", F.col("text"))
    return _round(corpus.over_length(rows, 500, 96).select("doc_id", "tokens", "keep_share"), "keep_share")


@query("SELECT DISTINCT event_type FROM events")
def value_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.value_list(table(spark, sf_dir, "events"), "event_type")


@query(f"""WITH t AS (SELECT l_returnflag, CAST(l_quantity AS BIGINT) AS a, CAST(l_linenumber AS BIGINT) AS b, l_orderkey % 2 AS k FROM lineitem),
e AS (SELECT *, CASE WHEN k = 0 THEN a + b ELSE a * b END AS y FROM t),
c AS (SELECT l_returnflag, operation, count(*) AS n, count(*) FILTER (WHERE y = CASE operation WHEN 'add' THEN a + b WHEN 'sub' THEN a - b WHEN 'mul' THEN a * b ELSE a * 10 + b END) AS m FROM e, {_FIT} GROUP BY 1, 2),
s AS (SELECT l_returnflag, max(n) AS n, max(m) AS m FROM c GROUP BY 1), o AS (SELECT operation, sum(m) AS m FROM c GROUP BY 1)
SELECT CAST((SELECT sum(n) FROM s) AS BIGINT) AS rows, CAST((SELECT sum(m) FROM s) AS BIGINT) AS by_symbol, CAST(m AS BIGINT) AS fixed, operation FROM o ORDER BY m DESC, operation LIMIT 1""")
def best_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches with the best operation of each flag, and with the best one for all: a report of one row."""
    a, b = F.col("l_quantity").cast("long"), F.col("l_linenumber").cast("long")
    truth = F.when(F.col("l_orderkey") % 2 == 0, a + b).otherwise(a * b)
    return metrics.best_rules(table(spark, sf_dir, "lineitem"), "l_returnflag", {"add": a + b, "sub": a - b, "mul": a * b, "concat": a * 10 + b}, truth)


@query("""WITH t AS (SELECT l_orderkey, l_linenumber, CAST(l_quantity AS BIGINT) AS a, CAST(l_suppkey AS BIGINT) AS b, l_linenumber % 4 AS k FROM lineitem)
SELECT l_orderkey, l_linenumber, CASE k WHEN 0 THEN a WHEN 1 THEN a * 100000000 + a WHEN 2 THEN a END AS a, CASE k WHEN 0 THEN -b WHEN 1 THEN b WHEN 2 THEN b END AS b FROM t""")
def prompt_operands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signs, long numbers, numbers apart from each other, and none."""
    k, a, b = F.col("l_linenumber") % 4, F.col("l_quantity").cast("long"), F.col("l_suppkey").cast("string")
    prompt = F.when(k == 0, F.concat(F.lit("take "), a, F.lit(" + -"), b)).when(k == 1, F.concat(a * 100000000 + a, F.lit("÷"), b, F.lit("?"))).when(k == 2, F.concat(F.lit("from "), a, F.lit(" to "), b)).otherwise(F.concat(a, F.lit("x"), b))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", text.operands(prompt).alias("o")).select("l_orderkey", "l_linenumber", "o.a", "o.b")


@query(f"""WITH t AS (SELECT l_orderkey, l_linenumber, {_TEXT} AS txt FROM lineitem) SELECT l_orderkey, l_linenumber, regexp_replace(regexp_replace(txt, '\\\\boxed\\{{{text._balanced(8)}\\}}', '', 'g'), '\\s+$', '') AS rest,
regexp_replace(regexp_replace(txt, '\\\\boxed\\{{[^}}]*\\}}', '', 'g'), '\\s+$', '') AS rest_compat FROM t""")
def boxes_stripped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes of any depth removed as a whole, and up to their first closing brace."""
    txt = F.col("txt")
    return _boxed_texts(spark, sf_dir).select("l_orderkey", "l_linenumber", text.strip_boxed(txt).alias("rest"), text.strip_boxed(txt, compat=True).alias("rest_compat"))


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN l_suppkey > l_quantity THEN '-' ELSE '' END || reverse(CAST(abs(CAST(l_quantity AS BIGINT) - l_suppkey) AS VARCHAR)) AS turned FROM lineitem""")
def signed_reverses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", text.signed_reverse((F.col("l_quantity").cast("long") - F.col("l_suppkey")).cast("string")).alias("turned"))


@query()
def symbol_puzzles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums of two-digit part numbers in letters, four examples each, solved under the harness."""
    k = F.col("p_partkey")
    two = lambda c: F.lpad(F.pmod(c, F.lit(100)).cast("string"), 2, "0")
    coded = lambda c: F.translate(c, "0123456789", "qwertyuiop")
    a, b = k * 7, k * 13
    line = F.concat(coded(two(a)), F.lit("+"), coded(two(b)))
    rows = table(spark, sf_dir, "part").select(F.floor(k / 5).alias("id"), F.pmod(k, F.lit(5)).alias("i"), line.alias("left"), coded((F.pmod(a, F.lit(100)) + F.pmod(b, F.lit(100))).cast("string")).alias("right"))
    per = rows.groupBy("id").agg(F.sort_array(F.collect_list(F.when(F.col("i") < 4, F.struct("i", F.concat("left", F.lit(" = "), "right").alias("t"))))).alias("e"), F.max(F.when(F.col("i") == 4, F.col("left"))).alias("q"))
    prompts = per.where("q is not null").select("id", F.concat(F.lit("examples:\n"), F.array_join(F.transform("e", lambda s: s["t"]), "\n"), F.lit("\nNow, determine the result for: "), "q").alias("prompt"))
    return rules.answers(prompts, "symbols")
