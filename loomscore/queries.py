"""Registered queries of the engine: each a Spark query over the driver's tables with the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import events, parsing, text
from .operators import agreement as ag
from .operators import baselines, dialogue, joins, metrics, pairs, resample, rules
from .plans import flows, runner, runs, views
from .plans.views import table
from .sources import schemas

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

# -- the views in SQL --------------------------------------------------------

SCORED = """
k AS (SELECT event_id, user_id, event_type, ts, CAST(props->>'$.k' AS INT) AS k FROM events),
scored AS (
  SELECT event_id AS item_id, user_id AS conversation_id, event_type AS condition, 'm' || (event_id % 2) AS model_label, ts, k,
    CASE WHEN event_id % 97 <> 0 THEN 'E' || (user_id % 4 + 1) END AS gold, CASE WHEN k % 10 > 3 AND k % 23 <> 0 THEN 'E' || (k % 4 + 1) END AS pred,
    CASE k % 10 WHEN 0 THEN 'invalid' WHEN 1 THEN 'abstain' WHEN 2 THEN 'missing' WHEN 3 THEN 'unmapped' ELSE 'ok' END AS status,
    2 + event_id % 3 AS n_candidates, CASE WHEN event_id % 2 = 0 THEN 'E' || ((k + 1) % 4 + 1) END AS distractor, 'E' || ((k + 2) % 4 + 1) AS recent,
    k % 2 = 0 AS distractor_present, CASE WHEN k % 7 <> 6 THEN k % 7 END AS turn_distance, CASE WHEN k % 3 <> 2 THEN k % 3 = 1 END AS referent_changed,
    CASE WHEN k % 13 <> 0 THEN k * 10 END AS input_tokens, k % 4 AS output_tokens,
    CASE WHEN k % 5 <> 4 THEN k % 5 = 1 END AS speaker_changed, CASE WHEN k % 11 <> 3 THEN k % 11 = 1 END AS referent_role_changed, CASE WHEN event_id % 3 = 0 THEN 'controlled' ELSE 'naturalistic' END AS dataset,
    CASE WHEN event_id % 5 = 0 THEN 'llm' ELSE 'human' END AS creation_method, CASE k % 6 WHEN 0 THEN 'locally_recoverable' WHEN 1 THEN 'discourse_dependent' WHEN 2 THEN 'conflict' END AS context_need
  FROM k),
s AS (
  SELECT *, status = 'ok' AND pred IS NOT DISTINCT FROM gold AS hit,
    CASE gold WHEN 'E1' THEN 'speaker' WHEN 'E2' THEN 'addressee' WHEN 'E3' THEN 'third_party' END AS gold_role,
    CASE pred WHEN 'E1' THEN 'speaker' WHEN 'E2' THEN 'addressee' WHEN 'E3' THEN 'third_party' END AS pred_role FROM scored)
"""
PAIRED = SCORED + """,
p AS (
  SELECT *, condition AS version, conversation_id || '-' || strftime(ts, '%Y-%m-%d') AS scenario, CASE WHEN conversation_id % 5 <> 0 THEN CAST(conversation_id % 7 AS VARCHAR) END AS family_id FROM s)
"""
VOTES = """
lab AS (SELECT doc_id AS d, max(quality) AS q, max(toxic) AS t FROM labels GROUP BY 1),
who AS (SELECT d, unnest([{'a': 'quality', 'c': 'full', 'v': q, 's': 0}, {'a': 'toxic', 'c': 'full', 'v': t, 's': 0}, {'a': 'third', 'c': 'full', 'v': q, 's': 3},
  {'a': 'quality', 'c': 'local', 'v': q, 's': 1}, {'a': 'toxic', 'c': 'local', 'v': t, 's': 2}]) AS x FROM lab),
votes AS (
  SELECT CAST(d AS VARCHAR) AS sample_id, x.a AS annotator, x.c AS condition, CASE WHEN (d + x.s) % 11 = 0 THEN '' ELSE 'E' || (x.v + 1) END AS referent_id,
    CASE WHEN x.v = 1 THEN 'E2' ELSE '' END AS addressee_id, CASE WHEN x.v = 1 THEN 'yes' ELSE 'no' END AS context_sufficient,
    CASE WHEN (d + x.s) % 7 = 0 THEN 'ambiguous' WHEN (d + x.s) % 13 = 0 THEN '' WHEN (d + x.s) % 29 = 0 THEN 'odd' ELSE 'unambiguous' END AS ambiguity,
    CASE WHEN (d + x.s) % 31 = 0 THEN CASE WHEN x.c = 'local' THEN 'x' ELSE '' END ELSE CAST(1 + (d + x.s * x.v) % 5 AS VARCHAR) END AS naturalness
  FROM who),
both_ AS (
  SELECT a.condition, a.sample_id, a.annotator || '~' || b.annotator AS pair, a.referent_id AS ra, b.referent_id AS rb, a.addressee_id AS da, b.addressee_id AS db,
    a.context_sufficient AS ca, b.context_sufficient AS cb, a.ambiguity AS ma, b.ambiguity AS mb, a.naturalness AS na, b.naturalness AS nb
  FROM votes a JOIN votes b ON a.condition = b.condition AND a.sample_id = b.sample_id AND a.annotator < b.annotator)
"""
TURNS = """
t AS (SELECT conv_id, CAST(turn + 1 AS INT) AS turn_index, role, text FROM conversations),
fit AS (SELECT conv_id, count(*) AS n FROM t WHERE conv_id IS NOT NULL GROUP BY 1),
tt AS (SELECT t.*, n FROM t JOIN fit USING (conv_id))
"""


def rounded(df: DataFrame) -> DataFrame:
    return df.select(*(F.round(c, 6).alias(c) if k == "double" else F.col(c) for c, k in df.dtypes))


def query(sql: str | None = None, with_: str = "") -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = lambda spark, sf_dir: rounded(f(spark, sf_dir))
        if sql is not None:
            SQL[f.__name__] = (f"WITH {with_.strip()} " if with_ else "") + sql
        return f

    return add


def ratio_sql(numerator: str, denominator: str = "count(*)", p: str = "") -> str:
    return f"round(CAST({numerator} AS DOUBLE) / nullif({denominator}, 0), 6) AS {p}value, CAST({numerator} AS BIGINT) AS {p}numerator, CAST({denominator} AS BIGINT) AS {p}denominator"


ACC = ratio_sql("count(*) FILTER (hit)")

# -- metrics -----------------------------------------------------------------


@query(f"SELECT condition, {ACC} FROM s GROUP BY 1", SCORED)
def accuracy_by_condition(spark, sf):
    return metrics.table(views.scored(spark, sf), ["condition"], metrics.entity_accuracy())


@query(f"SELECT condition, {ratio_sql('count(*) FILTER (status = $$ok$$ AND gold_role = pred_role)')} FROM s GROUP BY 1", SCORED)
def role_accuracy(spark, sf):
    return metrics.table(views.scored(spark, sf), ["condition"], metrics.role_accuracy())


@query(f"SELECT condition, {ratio_sql('count(*) FILTER (status = $$ok$$ AND NOT hit AND gold_role = pred_role)')} FROM s GROUP BY 1", SCORED)
def same_role_wrong_entity(spark, sf):
    return metrics.table(views.scored(spark, sf), ["condition"], metrics.same_role_wrong_entity())


STATUS_SQL = ", ".join(f"count(*) FILTER (status = '{x}') AS {x}" for x in metrics.STATUSES)


@query(f"SELECT model_label, condition, {STATUS_SQL} FROM s GROUP BY 1, 2", SCORED)
def status_counts(spark, sf):
    return views.scored(spark, sf).groupBy("model_label", "condition").agg(*metrics.status_columns())


@query(f"SELECT condition, {ratio_sql('count(*) FILTER (status = $$ok$$ AND distractor = pred)')} FROM s GROUP BY 1", SCORED)
def distractor_rate(spark, sf):
    return metrics.table(views.scored(spark, sf), ["condition"], metrics.distractor_rate())


DISTRACTOR_ERROR = ratio_sql("count(*) FILTER (distractor_present AND status = 'ok' AND pred = coalesce(distractor, recent) AND coalesce(distractor, recent) IS DISTINCT FROM gold)", "count(*) FILTER (distractor_present)", "{}")


@query(f"SELECT condition, {DISTRACTOR_ERROR.format('', '', '')} FROM s GROUP BY 1", SCORED)
def distractor_error_rate(spark, sf):
    return metrics.table(views.scored(spark, sf), ["condition"], metrics.distractor_error_rate())


@query("SELECT condition, round(avg(1.0::DOUBLE / n_candidates), 6) AS value, count(*) AS numerator, count(*) AS denominator FROM s GROUP BY 1", SCORED)
def chance_level(spark, sf):
    return metrics.table(views.scored(spark, sf), ["condition"], metrics.chance_level())


@query(f"SELECT coalesce(CAST(turn_distance AS VARCHAR), 'None') AS grp, {ACC} FROM s GROUP BY 1", SCORED)
def metric_table_nullable_dim(spark, sf):
    return metrics.metric_table(views.scored(spark, sf), F.col("turn_distance"), metrics.entity_accuracy())


@query("SELECT model_label, coalesce(gold_role, 'None') AS gold, CASE WHEN status = 'ok' THEN coalesce(pred_role, 'None') ELSE status END AS predicted, count(*) AS n FROM s GROUP BY 1, 2, 3", SCORED)
def role_confusion(spark, sf):
    return metrics.confusion(views.scored(spark, sf), metrics.role_of("gold_entity_id"), metrics.role_of("predicted_entity_id"), ["model_label"])


@query("SELECT coalesce(gold, 'None') AS gold, CASE WHEN status = 'ok' THEN coalesce(pred, 'None') ELSE status END AS predicted, count(*) AS n FROM s GROUP BY 1, 2", SCORED)
def entity_confusion(spark, sf):
    return metrics.confusion(views.scored(spark, sf), F.col("gold_entity_id"), F.col("predicted_entity_id"))


@query(f"""SELECT cue, {ACC} FROM (SELECT hit, unnest(CASE k % 5 WHEN 0 THEN ['none'] WHEN 1 THEN ['honorific'] WHEN 2 THEN ['honorific', 'zero'] ELSE ['zero'] END) AS cue FROM s) GROUP BY 1""", SCORED)
def by_multivalue_cue(spark, sf):
    return metrics.table(views.scored(spark, sf).select("*", metrics.cues()), ["cue"], metrics.entity_accuracy())


DIMS = {
    "by_referent_type": "gold_role", "by_referent_changed": "referent_changed", "by_speaker_changed": "speaker_changed", "by_role_changed": "referent_role_changed", "by_distractor_present": "distractor_present", "by_turn_distance": "CAST(turn_distance AS VARCHAR)", "by_dataset": "dataset",
    "by_creation_method": "creation_method", "by_context_need": "context_need",
}
FLAGS = ("referent_changed", "speaker_changed", "referent_role_changed", "distractor_present")


def level_sql(c: str) -> str:
    return f"CASE WHEN {c} THEN 'True' WHEN NOT {c} THEN 'False' ELSE 'None' END" if c in FLAGS else f"coalesce({c}, 'None')"


CUES_SQL = "CASE k % 5 WHEN 0 THEN ['none'] WHEN 1 THEN ['honorific'] WHEN 2 THEN ['honorific', 'zero'] ELSE ['zero'] END"
SINGLE_SQL = ", ".join(f"{{'dimension': '{n}', 'level': {level_sql(c)}}}" for n, c in DIMS.items())


@query(f"""SELECT model_label, condition, d.dimension AS dimension, d.level AS level, {ACC}
  FROM (SELECT *, unnest(list_concat([{SINGLE_SQL}], list_transform({CUES_SQL}, lambda c: {{'dimension': 'by_linguistic_cue', 'level': c}}))) AS d FROM s) GROUP BY ALL""", SCORED)
def benchmark_summary_long(spark, sf):
    return metrics.benchmark_tables(views.scored(spark, sf))


@query(f"""SELECT d.dimension AS dimension, d.level AS level, {ACC} FROM (SELECT hit, unnest([{{'dimension': 'by_role', 'level': coalesce(gold_role, 'None')}}, {{'dimension': 'by_candidate_count', 'level': CAST(n_candidates AS VARCHAR)}}]) AS d FROM s) GROUP BY ALL""", SCORED)
def natural_tables(spark, sf):
    return metrics.natural_tables(views.scored(spark, sf))


@query(f"""SELECT model_label, condition, {ratio_sql('count(*) FILTER (hit)', p='accuracy_')}, {ratio_sql('count(*) FILTER (status = $$ok$$ AND gold_role = pred_role)', p='role_')},
  round(avg(1.0::DOUBLE / n_candidates), 6) AS chance_value, count(*) AS chance_numerator, count(*) AS chance_denominator, {DISTRACTOR_ERROR.format(*['distractor_error_'] * 3)}, {STATUS_SQL},
  count(*) AS n_rows, count(DISTINCT conversation_id) AS n_clusters FROM s GROUP BY 1, 2""", SCORED)
def benchmark_summary(spark, sf):
    return metrics.benchmark_summary(views.scored(spark, sf))


@query("SELECT model_label, CAST(sum(coalesce(input_tokens, 0)) AS BIGINT) AS input_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens, count(input_tokens) AS n_with_usage, round((CAST(sum(coalesce(input_tokens, 0)) AS DOUBLE) * 3 + CAST(sum(output_tokens) AS DOUBLE) * 15) / 1000000, 6) AS cost FROM s GROUP BY 1", SCORED)
def token_cost(spark, sf):
    return metrics.cost(views.scored(spark, sf), ["model_label"], 3.0, 15.0)


@query(f"SELECT condition, {ratio_sql('count(*) FILTER (status <> $$ok$$)')} FROM s GROUP BY 1", SCORED)
def mapping_failure(spark, sf):
    return metrics.table(views.scored(spark, sf), ["condition"], metrics.mapping_failure_rate())


@query("SELECT gold_role AS role, count(*) AS n FROM s WHERE gold_role IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1", SCORED)
def majority_role(spark, sf):
    return metrics.majority_role(views.scored(spark, sf))


@query(f"""SELECT {ratio_sql('count(*) FILTER (hit)', p='accuracy_')}, {ratio_sql('count(*) FILTER (status = $$ok$$ AND gold_role = pred_role)', p='role_')}, {ratio_sql('count(*) FILTER (status = $$ok$$ AND NOT hit AND gold_role = pred_role)', p='same_role_')},
  round(avg(1.0::DOUBLE / n_candidates), 6) AS chance_value, count(*) AS chance_numerator, count(*) AS chance_denominator, {STATUS_SQL}, count(DISTINCT conversation_id) AS n_conversations FROM s""", SCORED)
def natural_summary(spark, sf):
    return metrics.natural_summary(views.scored(spark, sf))


# -- pairs -------------------------------------------------------------------

PAIR_CTE = PAIRED + """,
v AS (SELECT scenario || ':view~click' AS pair_id, version, hit, family_id, row_number() OVER (PARTITION BY scenario, version ORDER BY item_id DESC) AS r FROM p WHERE version IN ('view', 'click')),
pr AS (SELECT pair_id, max(CASE WHEN version = 'view' THEN CAST(hit AS INT) END) AS c1, max(CASE WHEN version = 'click' THEN CAST(hit AS INT) END) AS c2, max(CASE WHEN version = 'view' THEN family_id END) AS family_id FROM v WHERE r = 1 GROUP BY 1)
"""


def three(c: str) -> str:
    return ", ".join(ratio_sql(f"count(*) FILTER ({w})", p=n) for n, w in (("pair_", "c1 = 1 AND c2 = 1"), ("harm_", "c1 = 1 AND c2 = 0"), ("recovery_", "c1 = 0 AND c2 = 1"))) + c


def moves(names: dict) -> str:
    return ", " + ", ".join(f"count(*) FILTER (c1 = {a} AND c2 = {b}) AS {n}" for n, (a, b) in names.items())


MOVES = moves(pairs.TRANSITIONS)


@query(f"SELECT {three(MOVES)}, count(*) AS n_pairs, count(DISTINCT family_id) + max(CASE WHEN family_id IS NULL THEN 1 ELSE 0 END) AS n_families FROM pr WHERE c1 IS NOT NULL AND c2 IS NOT NULL", PAIR_CTE)
def pair_accuracy(spark, sf):
    return pairs.pair_summary(pairs.build_pairs(views.paired(spark, sf), "view", "click", "item_id"))


@query("SELECT pair_id FROM pr WHERE c1 IS NULL OR c2 IS NULL", PAIR_CTE)
def dropped_pairs(spark, sf):
    return pairs.dropped(pairs.build_pairs(views.paired(spark, sf), "view", "click", "item_id"))


@query(f"""SELECT {three(MOVES)}, count(*) AS n_pairs, count(DISTINCT family_id) + max(CASE WHEN family_id IS NULL THEN 1 ELSE 0 END) AS n_families,
  (SELECT count(*) FROM pr WHERE c1 IS NULL OR c2 IS NULL) AS n_dropped, {', '.join(f"(SELECT count(*) FROM p WHERE status = '{x}') AS {x}" for x in metrics.STATUSES)}
  FROM pr WHERE c1 IS NOT NULL AND c2 IS NOT NULL""", PAIR_CTE)
def controlled_summary(spark, sf):
    return pairs.controlled_summary(views.paired(spark, sf), "view", "click", "item_id")["summary"]


@query(f"SELECT version, {ratio_sql('count(*) FILTER (status = $$ok$$ AND distractor = pred)')} FROM p GROUP BY 1", PAIRED)
def controlled_distractor_rate(spark, sf):
    return metrics.table(views.paired(spark, sf), ["version"], metrics.distractor_rate())


CONSISTENCY = PAIRED + """,
e AS (SELECT scenario || x.n AS pair_id, version, hit, x.a AS a, x.b AS b FROM p, (SELECT unnest([{'n': ':view~click', 'a': 'view', 'b': 'click'}, {'n': ':click~view', 'a': 'click', 'b': 'view'}]) AS x)),
sides AS (SELECT pair_id, count(*) FILTER (version = a) AS na, count(*) FILTER (version = b) AS nb, max(CASE WHEN version = a THEN CAST(hit AS INT) END) AS ha, max(CASE WHEN version = b THEN CAST(hit AS INT) END) AS hb FROM e GROUP BY 1),
pr AS (SELECT pair_id, CASE WHEN na = 1 AND nb = 1 THEN ha END AS c1, CASE WHEN na = 1 AND nb = 1 THEN hb END AS c2 FROM sides)
"""


@query(f"SELECT {three(moves(pairs.CONSISTENCY))}, count(*) AS n_pairs, CAST(max(1) AS BIGINT) AS n_families FROM pr WHERE c1 IS NOT NULL AND c2 IS NOT NULL", CONSISTENCY)
def pair_consistency(spark, sf):
    return pairs.pair_summary(pairs.pair_consistency(views.paired(spark, sf)), names=pairs.CONSISTENCY)


@query("SELECT count(*) AS n FROM pr WHERE c1 IS NULL OR c2 IS NULL", CONSISTENCY)
def inconsistent_pairs(spark, sf):
    return pairs.dropped(pairs.pair_consistency(views.paired(spark, sf))).agg(F.count("*").alias("n"))


USER_PAIRS = PAIRED + """,
i AS (SELECT conversation_id, condition, max_by(CAST(hit AS INT), item_id) AS h FROM s WHERE condition IN ('view', 'click') GROUP BY 1, 2),
d AS (SELECT a.conversation_id, a.h - b.h AS diff FROM i a JOIN i b ON a.conversation_id = b.conversation_id AND a.condition = 'view' AND b.condition = 'click')
"""


def by_user(rows: DataFrame) -> DataFrame:
    return rows.withColumn("item", F.col("item_id")).withColumn("item_id", F.col("conversation_id"))


@query("SELECT round(avg(diff), 6) AS value, CAST(sum(diff) AS BIGINT) AS numerator, count(*) AS denominator FROM d", USER_PAIRS)
def condition_difference(spark, sf):
    return pairs.condition_difference(by_user(views.scored(spark, sf)), "view", "click", "item")


@query("SELECT model_label, round(avg(diff), 6) AS value, CAST(sum(diff) AS BIGINT) AS numerator, count(*) AS denominator FROM d GROUP BY 1", PAIRED + """,
i AS (SELECT model_label, conversation_id, condition, max_by(CAST(hit AS INT), item_id) AS h FROM s WHERE condition IN ('view', 'click') GROUP BY 1, 2, 3),
d AS (SELECT a.model_label, a.h - b.h AS diff FROM i a JOIN i b ON a.model_label = b.model_label AND a.conversation_id = b.conversation_id AND a.condition = 'view' AND b.condition = 'click')
""")
def context_benefit(spark, sf):
    return pairs.condition_benefit(by_user(views.scored(spark, sf)), "view", "click", "item")


# -- resampling --------------------------------------------------------------


@query("SELECT event_type, round(quantile_cont(value, 0.025), 6) AS lo, round(quantile_cont(value, 0.975), 6) AS hi FROM events GROUP BY 1")
def percentile_ci(spark, sf):
    v = F.col("value")
    return table(spark, sf, "events").groupBy("event_type").agg(resample.percentile(v, 0.025).alias("lo"), resample.percentile(v, 0.975).alias("hi"))


N_BOOT = 2000


def stir_sql(x: str, name: str, source: str) -> str:
    """A CTE that adds ``name``: 32 mixed bits of ``x``."""
    return f"""(SELECT *, xor(b_, b_ >> 16) AS {name} FROM (SELECT *, (xor(a_, a_ >> 13) * 3266489909) & 4294967295 AS b_ FROM (
  SELECT *, (xor(x_, x_ >> 16) * 2246822507) & 4294967295 AS a_ FROM (SELECT * EXCLUDE (x_, a_, b_), CAST(({x}) & 4294967295 AS UBIGINT) AS x_ FROM {source}))))"""


def draws_sql(clusters: str = "n") -> str:
    """``drawn``: (boot, i) of all draws where the clusters are one part."""
    first = stir_sql("7 + boot * 2654435761", "h1", f"(SELECT 0 AS x_, 0 AS a_, 0 AS b_, boot FROM range({N_BOOT}) r(boot))")
    last = stir_sql("h2 + nth * 3266489917", "h3", f"(SELECT d2.*, t.nth, n_clusters FROM d2, (SELECT i AS nth, (SELECT count(*) FROM {clusters}) AS n_clusters FROM {clusters}) t)")
    return f"d1 AS {first}, d2 AS {stir_sql('h1', 'h2', 'd1')}, drawn AS (SELECT boot, (h3 * n_clusters) >> 32 AS i FROM {last})"


ENDS = "round(quantile_cont(v, 0.025), 6) AS ci_low, round(quantile_cont(v, 0.975), 6) AS ci_high, (SELECT n_rows FROM total) AS n_rows, (SELECT n_clusters FROM total) AS n_clusters, count(*) AS n_boot, count(*) FILTER (v IS NULL) AS n_undefined"


def boot_sql(sums: str, value: str, source: str = "s", whole: str | None = None, cluster: str = "conversation_id") -> str:
    """``sums`` over ``source`` in each cluster of s; the point from those over ``whole``."""
    names = [x.rsplit(" AS ", 1)[1].strip() for x in sums.split(";")]
    total = ", ".join(f"sum({n}) AS {n}" for n in names)
    return f"""
own AS (SELECT CAST({cluster} AS VARCHAR) AS c, {sums.replace(';', ',')} FROM {source} GROUP BY 1),
base AS (SELECT CAST({cluster} AS VARCHAR) AS c, count(*) AS rows_ FROM s GROUP BY 1),
n AS (SELECT c, rows_, {', '.join(f'coalesce({n}, 0) AS {n}' for n in names)}, row_number() OVER (ORDER BY c) - 1 AS i FROM base LEFT JOIN own USING (c)),
total AS (SELECT CAST(sum(rows_) AS BIGINT) AS n_rows, count(*) AS n_clusters FROM n),
{draws_sql()},
rep AS (SELECT boot, {value} AS v FROM (SELECT boot, {total} FROM drawn JOIN n USING (i) GROUP BY boot))
SELECT (SELECT round({value}, 6) FROM (SELECT {sums.replace(';', ',')} FROM {whole or source})) AS point, {ENDS} FROM rep"""


def register_boot(name: str, rows: Callable[[SparkSession, str], DataFrame], statistic: Callable[[], resample.Statistic], with_: str, sql: str, cluster: str = "conversation_id") -> None:
    QUERIES[name] = lambda spark, sf: rounded(resample.bootstrap(rows(spark, sf), cluster, statistic(), n_boot=N_BOOT, seed=7))
    SQL[name] = f"WITH {with_.strip()}, {sql.strip()}"


def differ_sql(by: str, a: str, b: str) -> str:
    sums = "; ".join(f"count(*) FILTER ({by} = '{v}'{' AND hit' if h == 'h' else ''}) AS {s}{h}" for s, v in (("a", a), ("b", b)) for h in "hr")
    return boot_sql(sums, "CAST(ah AS DOUBLE) / nullif(ar, 0) - CAST(bh AS DOUBLE) / nullif(br, 0)")


#: Pairs within a cluster, of which a resample's copies keep their own, and pairs over all rows.
OWN_PAIRS = PAIRED.strip() + """,
e AS (SELECT {c} AS c, scenario || x.n AS pair_id, version, hit, x.a AS a, x.b AS b FROM p, (SELECT unnest([{{'n': ':view~click', 'a': 'view', 'b': 'click'}}, {{'n': ':click~view', 'a': 'click', 'b': 'view'}}]) AS x)),
own_sides AS (SELECT c, pair_id, count(*) FILTER (version = a) AS na, count(*) FILTER (version = b) AS nb, count(*) FILTER (version = a AND hit) AS ha, count(*) FILTER (version = b AND hit) AS hb FROM e GROUP BY 1, 2),
own_pairs AS (SELECT c AS {c}, ha, hb FROM own_sides WHERE na = 1 AND nb = 1),
all_sides AS (SELECT pair_id, count(*) FILTER (version = a) AS na, count(*) FILTER (version = b) AS nb, count(*) FILTER (version = a AND hit) AS ha, count(*) FILTER (version = b AND hit) AS hb FROM e GROUP BY 1),
all_pairs AS (SELECT ha, hb FROM all_sides WHERE na = 1 AND nb = 1)
"""
MACRO_SQL = f"""
own AS (SELECT CAST(conversation_id AS VARCHAR) AS c, gold, count(*) FILTER (hit) AS h, count(*) AS r FROM s GROUP BY 1, 2),
n AS (SELECT CAST(conversation_id AS VARCHAR) AS c, count(*) AS rows_, row_number() OVER (ORDER BY CAST(conversation_id AS VARCHAR)) - 1 AS i FROM s GROUP BY 1),
total AS (SELECT CAST(sum(rows_) AS BIGINT) AS n_rows, count(*) AS n_clusters FROM n),
{draws_sql()},
rep AS (SELECT boot, avg(v) AS v FROM (SELECT boot, gold, sum(h) / sum(r) AS v FROM drawn JOIN n USING (i) JOIN own USING (c) GROUP BY boot, gold) GROUP BY boot)
SELECT (SELECT round(avg(v), 6) FROM (SELECT sum(h) / sum(r) AS v FROM own GROUP BY gold)) AS point, {ENDS} FROM rep"""

register_boot("cluster_bootstrap_accuracy", views.scored, lambda: resample.accuracy(), SCORED, boot_sql("count(*) FILTER (hit) AS h; count(*) AS r", "CAST(h AS DOUBLE) / nullif(r, 0)"))
register_boot("bootstrap_condition_diff", views.scored, lambda: resample.difference("view", "click"), SCORED, differ_sql("condition", "view", "click"))
register_boot("bootstrap_model_diff", views.scored, lambda: resample.model_difference("m0", "m1"), SCORED, differ_sql("model_label", "m0", "m1"))
register_boot("bootstrap_paired_diff", lambda spark, sf: by_user(views.scored(spark, sf)), lambda: resample.paired_items("view", "click", "item"), USER_PAIRS, boot_sql("sum(diff) AS t; count(diff) AS q", "CAST(t AS DOUBLE) / nullif(q, 0)", "d"))
PAIR_SUMS = ("count(*) FILTER (ha = 1 AND hb = 1) AS t; count(*) AS q", "CAST(t AS DOUBLE) / nullif(q, 0)", "own_pairs", "all_pairs")
register_boot("bootstrap_pair_consistency", views.paired, lambda: resample.consistency(), OWN_PAIRS.format(c="conversation_id"), boot_sql(*PAIR_SUMS))
register_boot("bootstrap_pairs_across_clusters", views.paired, lambda: resample.consistency(), OWN_PAIRS.format(c="k"), boot_sql(*PAIR_SUMS, cluster="k"), "k")
register_boot("bootstrap_macro_accuracy", views.scored, lambda: resample.macro_accuracy("gold_entity_id"), SCORED, MACRO_SQL)

# -- logs, joins, duplicates -------------------------------------------------


@query("SELECT user_id AS item_id, event_type AS condition, CAST(max_by(event_id, (ts, event_id)) AS BIGINT) AS ordinal FROM events GROUP BY 1, 2")
def dedupe_last_write(spark, sf):
    return joins.last_write(views.responses(spark, sf), ("item_id", "condition"), ("at", "ordinal")).select("item_id", "condition", "ordinal")


@query("SELECT l_orderkey, l_linenumber, o_orderpriority, o_orderdate::VARCHAR AS day FROM (SELECT * FROM lineitem) JOIN (SELECT o_orderkey, o_orderpriority, strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate FROM orders) ON l_orderkey = o_orderkey")
def strict_gold_join(spark, sf):
    gold = table(spark, sf, "orders").select(F.col("o_orderkey").alias("item"), "o_orderpriority", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"))
    rows = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("item"), "l_linenumber")
    return joins.strict_join(rows, gold, "item").withColumnRenamed("item", "l_orderkey")


@query("""SELECT doc_id, unnest(list_filter([CASE WHEN a > 1 THEN 'duplicate record' END, CASE WHEN b > 1 THEN 'duplicate label' END, CASE WHEN b IS NULL THEN 'missing label' END, CASE WHEN a IS NULL THEN 'label without record' END], lambda x: x IS NOT NULL)) AS problem
  FROM (SELECT doc_id, count(*) AS a FROM documents GROUP BY 1) FULL JOIN (SELECT doc_id, count(*) AS b FROM labels GROUP BY 1) USING (doc_id)""")
def missing_and_orphan_labels(spark, sf):
    return joins.match_problems(table(spark, sf, "documents").select("doc_id"), table(spark, sf, "labels").select("doc_id"), "doc_id")


@query("""SELECT item_id, unnest(list_filter([CASE WHEN ni > 1 THEN 'duplicate item' END, CASE WHEN ng > 1 THEN 'duplicate gold' END, CASE WHEN ng IS NULL THEN 'item without gold' END, CASE WHEN ni IS NULL THEN 'gold without item' END,
    CASE WHEN ni > 0 AND ng > 0 AND NOT coalesce(list_contains(c, e), false) THEN 'gold not a candidate' END, CASE WHEN ng > 0 AND s IS DISTINCT FROM 'accepted' THEN 'not accepted' END], lambda x: x IS NOT NULL)) AS problem
  FROM (SELECT CASE WHEN o_orderkey % 9 = 0 THEN -o_orderkey ELSE o_orderkey END AS item_id, count(*) AS ni, ['F', 'O'] AS c FROM orders GROUP BY 1)
  FULL JOIN (SELECT CASE WHEN o_orderkey % 7 = 0 THEN -o_orderkey ELSE o_orderkey END AS item_id, count(*) AS ng, any_value(o_orderstatus) AS e, any_value(CASE WHEN o_orderkey % 5 = 0 THEN 'in_review' ELSE 'accepted' END) AS s FROM orders GROUP BY 1) USING (item_id)""")
def alignment_problems(spark, sf):
    o, k = table(spark, sf, "orders"), F.col("o_orderkey")
    items = o.select(F.when(k % 9 == 0, -k).otherwise(k).alias("item_id"), F.array(F.lit("F"), F.lit("O")).alias("candidate_ids"))
    gold = o.select(F.when(k % 7 == 0, -k).otherwise(k).alias("item_id"), F.col("o_orderstatus").alias("gold_entity_id"), F.when(k % 5 == 0, "in_review").otherwise("accepted").alias("annotation_status"))
    return joins.alignment_problems(items, gold)


@query("""SELECT CASE WHEN doc_id <> ft THEN 'error' ELSE 'warning' END AS level, CAST(doc_id AS VARCHAR) AS sample_id, CASE WHEN doc_id <> ft THEN 'DUPLICATE_SAMPLE' ELSE 'DUPLICATE_DIALOGUE' END AS code,
    CASE WHEN doc_id <> ft THEN 'identical dialogue and target as ' || ft ELSE 'identical dialogue text as ' || fb || ' (different target)' END AS message
  FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY text, source) AS ft, min(doc_id) OVER (PARTITION BY text) AS fb FROM documents) WHERE doc_id <> ft OR doc_id <> fb""")
def duplicate_documents(spark, sf):
    return rules.duplicates(table(spark, sf, "documents"), "doc_id", "doc_id", F.col("text"), F.col("source"))


@query("""SELECT 'error' AS level, 'PART_UNKNOWN' AS code, count(*) AS n FROM lineitem l ANTI JOIN (SELECT CASE WHEN p_size > 5 THEN p_partkey ELSE -p_partkey END AS p_partkey FROM part) p ON l_partkey = p_partkey
  UNION ALL SELECT 'warning', 'ORDER_SIZE', count(*) FROM (SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING count(*) <> 2)""")
def referential_issues(spark, sf):
    line = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey")
    unknown = line.join(table(spark, sf, "part").selectExpr("IF(p_size > 5, p_partkey, -p_partkey) AS l_partkey"), "l_partkey", "left_anti").agg(F.count("*").alias("n"))
    sizes = line.groupBy("l_orderkey").agg(F.count("*").alias("m")).filter("m <> 2").agg(F.count("*").alias("n"))
    return unknown.select(F.lit("error").alias("level"), F.lit("PART_UNKNOWN").alias("code"), "n").unionByName(sizes.select(F.lit("warning").alias("level"), F.lit("ORDER_SIZE").alias("code"), "n"))


@query("SELECT d.doc_id, b.item_id FROM documents d JOIN benchmark b ON b.text <> '' AND contains(d.text, b.text)")
def contamination_scan(spark, sf):
    docs, bench = table(spark, sf, "documents").select("doc_id", "text"), table(spark, sf, "benchmark").select("item_id", F.col("text").alias("passage"))
    return joins.containing(docs, "text", bench, "passage").select("doc_id", "item_id")


@query("""SELECT doc_id, array_to_string(list_filter(['the', 'und', 'les', 'token'], lambda w: contains(lower(text), w)), ',') AS hits FROM documents""")
def forbidden_words(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.array_join(rules.word_hits(F.col("text"), ("the", "und", "les", "token")), ",").alias("hits"))


@query("""SELECT count(*) FILTER (c IS NOT NULL) AS hits, count(*) FILTER (c IS NULL) AS misses FROM (SELECT sha256(o_orderstatus || '|' || o_orderpriority || '|' || o_custkey) AS h FROM orders) LEFT JOIN
  (SELECT DISTINCT sha256(o_orderstatus || '|' || o_orderpriority || '|' || o_custkey) AS c FROM orders WHERE o_orderkey % 3 = 0) ON h = c""")
def payload_hash_cache(spark, sf):
    o = table(spark, sf, "orders").withColumn("payload_hash", F.sha2(F.concat_ws("|", "o_orderstatus", "o_orderpriority", F.col("o_custkey").cast("string")), 256))
    hits, misses = joins.with_cache(o.select("payload_hash"), o.filter("o_orderkey % 3 = 0").select("payload_hash").distinct())
    return hits.select(F.lit(1).alias("h")).unionByName(misses.select(F.lit(0).alias("h"))).agg(F.sum("h").alias("hits"), F.sum(1 - F.col("h")).alias("misses"))


NAMES = ("id_map", "gold_role", "note")


@query("""SELECT event_id, array_to_string(list_sort(list_filter([CASE WHEN k % 10 = 0 THEN 'x.turns.[1].id_map' WHEN k % 10 = 1 THEN 'x.turns.[1].gold_role' END, CASE WHEN k % 7 = 0 THEN 'tail.anchor_turn' END], lambda p: p IS NOT NULL)), ',') AS paths
  FROM (SELECT event_id, CAST(props->>'$.k' AS INT) AS k FROM events) WHERE k % 10 < 2 OR k % 7 = 0""")
def forbidden_keys(spark, sf):
    """Events as JSON in which some have a forbidden key, at two depths, and all name one in a text."""
    k = F.get_json_object("props", "$.k").cast("int")
    name = F.when(k % 10 == 0, "id_map").when(k % 10 == 1, "gold_role").otherwise("note")
    tail = F.when(k % 7 == 0, ',"tail":{"anchor_turn":1}').otherwise("")
    body = F.concat(F.lit('{"x":{"turns":[{"text":"say \\"id_map\\": no"},{"'), name, F.lit('":'), k.cast("string"), F.lit("}]}"), tail, F.lit("}"))
    found = rules.key_paths(table(spark, sf, "events").select("event_id", body.alias("body")), "event_id", F.col("body"), dialogue.FORBIDDEN_ITEM_KEYS)
    return found.select("event_id", F.array_join("paths", ",").alias("paths"))


@query("""SELECT user_id, run, CASE WHEN text IS NOT NULL THEN 'answered' WHEN error IS NULL OR error = 'Rate limit' THEN 'transient' ELSE 'permanent' END AS outcome, text AS raw_text,
    CASE WHEN text IS NOT NULL THEN tokens END AS input_tokens, CASE WHEN text IS NOT NULL THEN thread END AS request_id, CASE WHEN text IS NULL THEN coalesce(error, 'no message') END AS error
  FROM (SELECT user_id, event_id % 40 AS run, max_by('E' || (k % 4), event_id) FILTER (m = 1) AS text, CAST(max_by(k, event_id) FILTER (m = 2) AS BIGINT) AS tokens, CAST(max(event_id) FILTER (m = 0) AS VARCHAR) AS thread,
    max_by(CASE WHEN k % 4 = 1 THEN 'Rate limit' ELSE 'invalid' END, event_id) FILTER (m = 3) AS error FROM (SELECT *, k % 6 AS m FROM (SELECT event_id, user_id, CAST(props->>'$.k' AS INT) AS k FROM events)) GROUP BY 1, 2)""")
def event_answers(spark, sf):
    """A service's answers as lines of events, folded: messages, usage, threads, errors, and lines that aren't JSON."""
    e = table(spark, sf, "events").select("event_id", "user_id", F.get_json_object("props", "$.k").cast("int").alias("k"))
    k, n = F.col("k"), F.col("k").cast("string")
    line = (
        F.when(k % 6 == 0, F.concat(F.lit('{"type":"thread.started","thread_id":"'), F.col("event_id").cast("string"), F.lit('"}')))
        .when(k % 6 == 1, F.concat(F.lit('  {"type":"item.completed","item":{"type":"agent_message","text":"E'), (k % 4).cast("string"), F.lit('"}}')))
        .when(k % 6 == 2, F.concat(F.lit('{"type":"turn.completed","usage":{"input_tokens":'), n, F.lit("}}")))
        .when(k % 6 == 3, F.concat(F.lit('{"type":"error","message":"'), F.when(k % 4 == 1, "Rate limit").otherwise("invalid"), F.lit('"}')))
        .when(k % 6 == 4, "{oops").otherwise('{"type":"item.completed","item":{"type":"reasoning","text":"hm"}}')
    )
    logs = e.groupBy("user_id", (F.col("event_id") % 40).alias("run")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_id", line.alias("line")))), lambda x: x["line"]), "\n").alias("log"))
    said = logs.select("user_id", "run", events.event_lines("log").alias("r")).select("user_id", "run", "r.*")
    return said.select("user_id", "run", "outcome", "raw_text", "input_tokens", "request_id", F.when(F.col("error").startswith("no message"), "no message").otherwise(F.col("error")).alias("error"))


# -- dialogues ---------------------------------------------------------------


@query("""SELECT CAST(conv_id AS VARCHAR) AS sample_id, string_agg(upper(role[1]) || role[2:] || ': ' || text, chr(10) ORDER BY turn_index) AS full_text FROM tt GROUP BY 1""", TURNS)
def render_dialogue(spark, sf):
    return views.records(spark, sf).select("sample_id", dialogue.render().alias("full_text"))


@query("SELECT conv_id, count(*) AS n, CAST(min(turn) AS BIGINT) AS lo, CAST(max(turn) AS BIGINT) AS hi, count(DISTINCT turn) AS d FROM (SELECT conv_id, turn + CASE WHEN conv_id % 5 = 0 AND turn > 0 THEN 1 ELSE 0 END AS turn FROM conversations) GROUP BY 1 HAVING lo <> 0 OR hi <> n - 1 OR d <> n")
def turn_contiguity(spark, sf):
    return dialogue.turn_gaps(table(spark, sf, "conversations").selectExpr("conv_id", "turn + IF(conv_id % 5 = 0 AND turn > 0, 1, 0) AS turn"), "conv_id", "turn", 0)


@query("""SELECT conv_id, turn_index, role, (SELECT max_by(b.role, b.turn_index) FROM t b WHERE b.conv_id = a.conv_id AND b.turn_index < a.turn_index AND b.role <> a.role) AS previous_other FROM t a""", TURNS)
def previous_speaker(spark, sf):
    t = views.turns(spark, sf)
    return dialogue.previous_speaker(t, "conv_id", "turn_index", "speaker_id").select("conv_id", "turn_index", F.col("speaker_id").alias("role"), "previous_other")


NEUTRAL = TURNS + """,
ids AS (
  SELECT conv_id, p, 'E' || row_number() OVER (PARTITION BY conv_id ORDER BY md5('0|' || CASE WHEN conv_id % 3 = 0 THEN 'F' || (conv_id % 4) ELSE 'S' || (conv_id % 10) END || '|' || p), p) AS e
  FROM fit, (SELECT unnest(['user', 'assistant', 'system']) AS p))
"""


@query("SELECT CAST(conv_id AS VARCHAR) AS sample_id, string_agg(p || '=' || e, ',' ORDER BY p) AS ids FROM ids GROUP BY 1", NEUTRAL)
def neutral_ids(spark, sf):
    r = dialogue.neutral_ids(views.records(spark, sf))
    entries = F.array_sort(F.transform(F.map_entries("id_map"), lambda e: F.concat(e["key"], F.lit("="), e["value"])))
    return r.select("sample_id", F.array_join(entries, ",").alias("ids"))


def derived(spark: SparkSession, sf: str) -> DataFrame:
    return dialogue.derive(views.records(spark, sf))


DERIVED = TURNS + """,
rec AS (
  SELECT conv_id, CAST(max(n) AS INT) AS n, max_by(role, turn_index) AS speaker, min_by(role, turn_index) AS first_speaker, ['user', 'assistant', 'system'] AS who,
    CASE WHEN conv_id % 7 <> 0 THEN ['user', 'assistant', 'system'][conv_id % 3 + 1] END AS gold, CASE WHEN conv_id % 4 = 0 THEN ['user', 'assistant', 'system'][(conv_id + 1) % 3 + 1] END AS declared,
    CASE WHEN conv_id % 5 <> 0 AND max(n) > 1 THEN ['user', 'assistant', 'system'][(conv_id + 2) % 3 + 1] END AS anchor, CASE WHEN conv_id % 6 = 1 THEN ['user', 'assistant', 'system'][(conv_id + 1) % 3 + 1] END AS distractor
  FROM tt GROUP BY conv_id),
adr AS (
  SELECT *, coalesce(declared, CASE speaker WHEN 'user' THEN 'assistant' WHEN 'assistant' THEN 'user' END) AS addressee, CASE first_speaker WHEN 'user' THEN 'assistant' WHEN 'assistant' THEN 'user' END AS anchor_addressee FROM rec),
roles AS (
  SELECT *, CASE WHEN gold IS NULL THEN NULL WHEN gold = speaker THEN 'speaker' WHEN addressee IS NOT NULL THEN CASE WHEN gold = addressee THEN 'addressee' ELSE 'third_party' END WHEN gold = 'system' THEN 'third_party' END AS gold_role,
    CASE WHEN anchor IS NULL THEN NULL WHEN anchor = first_speaker THEN 'speaker' WHEN anchor_addressee IS NOT NULL THEN CASE WHEN anchor = anchor_addressee THEN 'addressee' ELSE 'third_party' END WHEN anchor = 'system' THEN 'third_party' END AS anchor_role FROM adr)
"""


@query("""SELECT CAST(conv_id AS VARCHAR) AS sample_id, gold_role AS gold_referent_role, anchor_role AS anchor_referent_role, CASE WHEN anchor IS NOT NULL THEN first_speaker <> speaker END AS speaker_changed,
  CASE WHEN anchor IS NOT NULL AND gold IS NOT NULL THEN anchor <> gold END AS referent_changed, CASE WHEN anchor IS NOT NULL AND gold IS NOT NULL THEN anchor_role <> gold_role END AS referent_role_changed, n AS n_turns FROM roles""", DERIVED)
def shift_variables(spark, sf):
    return derived(spark, sf).select("sample_id", "gold_referent_role", "anchor_referent_role", "speaker_changed", "referent_changed", "referent_role_changed", "n_turns")


@query("""SELECT coalesce(reason, 'kept') AS reason, count(*) AS n FROM (SELECT CASE WHEN gold IS NULL THEN 'no gold (ambiguity=unreviewed)' WHEN conv_id % 3 = 1 THEN 'annotation_status=in_review' END AS reason FROM rec) GROUP BY 1""", DERIVED)
def evaluation_split(spark, sf):
    kept, skipped = dialogue.evaluation_split(views.records(spark, sf))
    return kept.select(F.lit("kept").alias("reason")).unionByName(skipped.select("reason")).groupBy("reason").agg(F.count("*").alias("n"))


@query("""SELECT CAST(rec.conv_id AS VARCHAR) AS item_id, (SELECT e FROM ids WHERE ids.conv_id = rec.conv_id AND p = gold) AS gold_entity_id, (SELECT e FROM ids WHERE ids.conv_id = rec.conv_id AND p = speaker) AS target_speaker_id,
    upper(speaker[1]) || speaker[2:] AS target_speaker_label, (SELECT string_agg(e || ': ' || upper(p[1]) || p[2:], chr(10) ORDER BY e) FROM ids WHERE ids.conv_id = rec.conv_id) AS candidates
  FROM rec WHERE gold IS NOT NULL AND conv_id % 3 <> 1""", NEUTRAL.strip() + "," + DERIVED.replace(TURNS, "").strip().lstrip(","))
def items_gold_payload(spark, sf):
    kept, _ = dialogue.evaluation_split(dialogue.neutral_ids(derived(spark, sf)))
    items, gold = dialogue.items(kept), dialogue.gold(kept)
    return items.join(gold.select("item_id", "gold_entity_id"), "item_id").select("item_id", "gold_entity_id", "target_speaker_id", "target_speaker_label", text.format_candidates("candidates").alias("candidates"))


def evaluation_items(spark: SparkSession, sf: str) -> DataFrame:
    kept, _ = dialogue.evaluation_split(dialogue.neutral_ids(derived(spark, sf)))
    return dialogue.items(kept)


@query("""SELECT CAST(rec.conv_id AS VARCHAR) AS item_id, c AS condition, (CASE WHEN c = 'full_mcq' THEN body ELSE last_line END) || chr(10) || 'Who does "' || regexp_extract(last_text, '(\\S+)\\s*$', 1) || '" of ' || upper(speaker[1]) || speaker[2:] || ' speak of?' || chr(10) ||
    (SELECT string_agg(e || ': ' || upper(p[1]) || p[2:], chr(10) ORDER BY e) FROM ids WHERE ids.conv_id = rec.conv_id) AS asked
  FROM rec JOIN (SELECT conv_id, string_agg(upper(role[1]) || role[2:] || ': ' || text, chr(10) ORDER BY turn_index) AS body, max_by(upper(role[1]) || role[2:] || ': ' || text, turn_index) AS last_line, max_by(text, turn_index) AS last_text FROM tt GROUP BY 1) USING (conv_id), (SELECT unnest(['full_mcq', 'target_only_mcq']) AS c)
  WHERE gold IS NOT NULL AND conv_id % 3 <> 1""", NEUTRAL.strip() + "," + DERIVED.replace(TURNS, "").strip().lstrip(","))
def requests_cross_conditions(spark, sf):
    r = runner.requests(evaluation_items(spark, sf), ("full_mcq", "target_only_mcq"), views.PROMPT, views.CONFIG)
    return r.select("item_id", "condition", F.col("user").alias("asked"))


def mention_rows(spark: SparkSession, sf: str) -> DataFrame:
    people = F.array(*(F.struct(F.lit(e).alias("entity_id"), F.lit(n).alias("name"), F.array(*map(F.lit, a)).alias("aliases")) for e, n, a in (("T1", "the", ("then",)), ("T2", "and", ("an",)))))
    return table(spark, sf, "conversations").select("conv_id", "turn", text.find_mentions("text", text.surface_forms(people)).alias("m"))


@query("""SELECT conv_id, turn, count(*) AS n FROM (SELECT conv_id, turn, unnest(regexp_extract_all(text, 'then|the|and|an')) AS m FROM conversations) GROUP BY 1, 2""")
def mention_extraction(spark, sf):
    return mention_rows(spark, sf).filter(F.size("m") > 0).select("conv_id", "turn", F.size("m").cast("long").alias("n"))


@query("""SELECT CAST(conv_id AS VARCHAR) AS item_id, model_label, CASE WHEN model_label = 'current_speaker' THEN speaker ELSE a END AS who
  FROM (SELECT r.conv_id, speaker, coalesce(CASE speaker WHEN 'user' THEN 'assistant' WHEN 'assistant' THEN 'user' END, (SELECT max_by(role, turn_index) FROM tt WHERE tt.conv_id = r.conv_id AND role <> speaker)) AS a FROM rec r WHERE gold IS NOT NULL AND conv_id % 3 <> 1), (SELECT unnest(['current_speaker', 'current_addressee']) AS model_label)""", DERIVED)
def baseline_predictions(spark, sf):
    kept, _ = dialogue.evaluation_split(dialogue.neutral_ids(derived(spark, sf)))
    found = baselines.run(dialogue.items(kept), ("current_speaker", "current_addressee"))
    back = dialogue.gold(kept).select("item_id", F.col("id_map").alias("back"))
    return found.join(back, "item_id").select("item_id", "model_label", F.try_element_at("back", F.col("predicted_entity_id")).alias("who"))


@query()
def most_recent_entity(spark, sf):
    return evaluation_items(spark, sf).withColumn("r", baselines.most_recent_entity()).select("item_id", "r.*")


@query()
def most_recent_explicit_np(spark, sf):
    return evaluation_items(spark, sf).withColumn("r", baselines.most_recent_explicit_np()).select("item_id", "r.*")


@query("""SELECT item_id, CASE WHEN e IS NULL THEN 'unmapped' ELSE 'ok' END AS parse_status, e AS predicted_entity_id FROM (SELECT o_orderkey AS item_id, (SELECT max_by('E' || l_suppkey, (CAST(l_linenumber AS BIGINT), 'E' || l_suppkey)) FROM lineitem WHERE l_orderkey = o_orderkey AND l_linenumber < 3) AS e FROM orders)""")
def most_recent_oracle(spark, sf):
    m = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("item_id")).agg(F.collect_list(F.struct(F.col("l_linenumber").cast("long").alias("position"), F.concat(F.lit("E"), F.col("l_suppkey").cast("string")).alias("entity_id"))).alias("mentions"))
    items = table(spark, sf, "orders").select(F.col("o_orderkey").alias("item_id"), F.lit(3).alias("target_position")).join(m, "item_id", "left")
    return items.withColumn("mentions", F.coalesce("mentions", F.array().cast("array<struct<position:bigint,entity_id:string>>"))).withColumn("r", baselines.most_recent_entity_oracle()).select("item_id", "r.parse_status", "r.predicted_entity_id")


@query()
def majority_role_prior(spark, sf):
    kept, _ = dialogue.evaluation_split(dialogue.neutral_ids(derived(spark, sf)))
    items, gold = dialogue.items(kept), dialogue.gold(kept)
    both = items.join(gold.select("item_id", "entity_roles", "gold_entity_id"), "item_id")
    both = both.withColumn("candidates", F.transform("candidates", lambda c: F.struct(c["entity_id"].alias("entity_id"), c["label"].alias("label"), c["aliases"].alias("aliases"), F.try_element_at("entity_roles", c["entity_id"]).alias("role"))))
    top = metrics.majority_role(both).select("role").scalar()
    return both.withColumn("top", top).withColumn("r", baselines.majority_role_prior(F.col("top"))).select("item_id", "r.*")


# -- rules -------------------------------------------------------------------


@query()
def rule_issues(spark, sf):
    return rules.issues(derived(spark, sf), rules.structure_rules()).select("level", "sample_id", "code")


#: Rules that look at mentions.
BY_MENTIONS = ("HUMAN_REVIEW", "DISTRACTOR_NOT_RECENT")


@query("""SELECT level, sample_id, code FROM (SELECT CAST(conv_id AS VARCHAR) AS sample_id, unnest(list_filter([
    CASE WHEN gold IS NOT NULL AND gold_role IS NULL THEN {'level': 'error', 'code': 'ROLE_UNDETERMINED'} END,
    CASE WHEN declared IS NOT NULL AND (declared = 'system' OR declared = speaker) THEN {'level': 'error', 'code': 'ADDRESSEE_INVALID'} END,
    CASE WHEN distractor = gold THEN {'level': 'error', 'code': 'DISTRACTOR_IS_GOLD'} END,
    CASE WHEN gold IS NULL THEN {'level': 'warning', 'code': 'NO_GOLD_UNREVIEWED'} END,
    CASE WHEN conv_id % 5 <> 0 AND n < 2 THEN {'level': 'error', 'code': 'ANCHOR_OUT_OF_RANGE'} END,
    CASE WHEN conv_id % 5 = 0 AND conv_id % 2 = 0 THEN {'level': 'warning', 'code': 'ANCHOR_MISSING'} END,
    CASE WHEN conv_id % 6 = 0 THEN {'level': 'error', 'code': 'GEN_MODEL_MISSING'} END,
    CASE WHEN conv_id % 8 = 0 THEN {'level': 'warning', 'code': 'CREATED_MISSING'} END], lambda x: x IS NOT NULL), recursive := true) FROM roles)""", DERIVED)
def rule_issues_without_mentions(spark, sf):
    """Of the rules that don't look at mentions."""
    return rules.issues(derived(spark, sf), [r for r in rules.structure_rules() if r.code not in BY_MENTIONS]).select("level", "sample_id", "code")


@query()
def issue_counts(spark, sf):
    d = derived(spark, sf)
    body = F.array_join(F.transform("dialogue", lambda t: F.concat(t["speaker_id"], F.lit("\t"), t["text"])), "\n")
    found = rules.issues(d, [*rules.record_rules(), *rules.label_rules(), *rules.structure_rules()]).unionByName(rules.duplicates(d, "sample_id", "sample_id", body, F.concat_ws(":", "target_turn", "target_predicate")))
    return rules.level_counts(found)


AXES = {"segment": "c_mktsegment", "nation": "CAST(c_nationkey AS VARCHAR)", "rich": "CASE WHEN c_acctbal > 0 THEN 'True' ELSE 'False' END"}


@query(f"SELECT h.axis AS axis, h.level AS level, count(*) AS n FROM (SELECT unnest([{', '.join(f'''{{'axis': 'by_{a}', 'level': coalesce({c}, 'None')}}''' for a, c in AXES.items())}]) AS h FROM customer) GROUP BY 1, 2")
def balance_histograms(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").alias("nation"), (F.col("c_acctbal") > 0).alias("rich"))
    return rules.histograms(c, {"by_segment": "segment", "by_nation": "nation", "by_rich": "rich"})


@query("SELECT 'warning' AS level, 'no sample with ' || axis || ' ' || lv AS message FROM (SELECT unnest([{'axis': 'by_segment', 'lv': 'SPACE'}, {'axis': 'by_segment', 'lv': 'BUILDING'}, {'axis': 'by_rich', 'lv': 'None'}], recursive := true)) WHERE axis = 'by_rich' OR lv NOT IN (SELECT c_mktsegment FROM customer)")
def empty_cells(spark, sf):
    counts = QUERIES["balance_histograms"](spark, sf)
    return rules.empty_cells(counts, {"by_segment": ["SPACE", "BUILDING"], "by_rich": ["None"]}).select("level", "message")


@query("""SELECT level, code, count(*) AS n FROM (
    SELECT 'error' AS level, 'SCENARIO_UNKNOWN' AS code FROM customer WHERE c_nationkey % 5 = 0
    UNION ALL SELECT 'warning', 'ROSTER_MISMATCH' FROM customer WHERE c_nationkey % 5 <> 0 AND c_nationkey % 3 <> 0
    UNION ALL SELECT 'warning', 'VARIANT_UNKNOWN' FROM customer WHERE c_nationkey % 5 <> 0 AND c_custkey % 3 = 2
    UNION ALL SELECT 'error', CASE WHEN m <> 2 THEN 'PAIR_SIZE' ELSE 'PAIR_SCENARIO' END FROM (SELECT c_custkey // 2 AS p, count(*) AS m, count(DISTINCT c_nationkey) AS d FROM customer WHERE c_custkey % 7 <> 0 GROUP BY 1) WHERE m <> 2 OR d > 1) GROUP BY 1, 2""")
def link_issues(spark, sf):
    c = F.col("c_custkey")
    variant = F.element_at(F.array(F.lit("base"), F.lit("v1"), F.lit("v2")), (c % 3 + 1).cast("int"))
    pair = F.when(c % 7 != 0, F.array(F.floor(c / 2).cast("string"))).otherwise(F.array().cast("array<string>"))
    samples = table(spark, sf, "customer").select(c.alias("sample_id"), F.col("c_nationkey").cast("string").alias("scenario_id"), variant.alias("variant"), F.array(F.lit("A"), F.lit("B")).alias("candidates"), pair.alias("pair_ids"))
    n = F.col("n_nationkey")
    scenarios = table(spark, sf, "nation").select(F.when(n % 5 == 0, -n - 1).otherwise(n).cast("string").alias("scenario_id"), F.when(n % 3 == 0, F.array(F.lit("B"), F.lit("A"))).otherwise(F.array(F.lit("A"))).alias("candidates"), F.array(F.lit("v1")).alias("variants"))
    return rules.links(samples, scenarios).groupBy("level", "code").agg(F.count("*").alias("n"))


WORDS_SQL = "[" + ", ".join(f"'{w}'" for w in rules.ROLE_WORDS) + "]"
ASKED = NEUTRAL.strip() + "," + DERIVED.replace(TURNS, "").strip().lstrip(",") + """,
dia AS (SELECT conv_id, string_agg(upper(role[1]) || role[2:] || ': ' || text, chr(10) ORDER BY turn_index) AS body, max_by(upper(role[1]) || role[2:] || ': ' || text, turn_index) AS last_line, max_by(text, turn_index) AS last_text FROM tt GROUP BY 1),
asked AS (
  SELECT rec.*, body, c AS condition, lower(chr(10) || (CASE WHEN c = 'full_mcq' THEN body ELSE last_line END) || chr(10) || 'Who does "' || regexp_extract(last_text, '(\\S+)\\s*$', 1) || '" of ' || upper(speaker[1]) || speaker[2:] || ' speak of?' || chr(10) ||
    (SELECT string_agg(e || ': ' || upper(p[1]) || p[2:], chr(10) ORDER BY e) FROM ids WHERE ids.conv_id = rec.conv_id)) AS low, (SELECT e FROM ids WHERE ids.conv_id = rec.conv_id AND p = gold) AS gold_e
  FROM rec JOIN dia USING (conv_id), (SELECT unnest(['full_mcq', 'target_only_mcq']) AS c)),
future AS (SELECT DISTINCT conv_id, gold, 'error' AS level, CAST(conv_id AS VARCHAR) AS sample_id, 'FUTURE_CONTEXT' AS code, 'full_text must end at the target turn' AS message FROM asked WHERE length(body) - length(replace(body, chr(10), '')) + 1 <> n)
"""
HITS_SQL = f"array_to_string(list_filter({WORDS_SQL}, lambda w: contains(low, w)), ',')"


@query(f"""SELECT 'error' AS level, CAST(conv_id AS VARCHAR) AS sample_id, 'PROMPT_ROLE_WORD' AS code, condition || ': prompt contains ' || {HITS_SQL} AS message FROM asked WHERE gold IS NOT NULL AND {HITS_SQL} <> ''
  UNION ALL SELECT 'error', CAST(conv_id AS VARCHAR), 'PROMPT_ROLE_FIELD', condition || ': prompt contains ' || chr(39) || 'role' || chr(39) FROM asked WHERE gold IS NOT NULL AND contains(low, 'role')
  UNION ALL SELECT level, sample_id, code, message FROM future""", ASKED)
def leak_issues(spark, sf):
    return flows.sample_leaks(dialogue.neutral_ids(derived(spark, sf)), views.PROMPT)


ROLE_HITS_SQL = HITS_SQL.replace("']", "', 'role']")


@query(f"""SELECT 'error' AS level, CAST(conv_id AS VARCHAR) AS sample_id, 'PROMPT_ROLE_WORD' AS code, condition || ': ' || {ROLE_HITS_SQL} AS message FROM asked WHERE gold IS NOT NULL AND conv_id % 3 <> 1 AND {ROLE_HITS_SQL} <> ''
  UNION ALL SELECT 'error', CAST(conv_id AS VARCHAR), 'PROMPT_GOLD_ID', condition || ': gold id string outside candidate list' FROM asked
    WHERE gold IS NOT NULL AND conv_id % 3 <> 1 AND condition = 'target_only_mcq' AND contains(low, '"' || lower(gold_e) || '"')
  UNION ALL SELECT level, sample_id, code, message FROM future WHERE gold IS NOT NULL AND conv_id % 3 <> 1""", ASKED)
def payload_leaks(spark, sf):
    kept, _ = dialogue.evaluation_split(dialogue.neutral_ids(derived(spark, sf)))
    items = dialogue.items(kept)
    return flows.payload_leaks(items, dialogue.gold(kept), views.PROMPT, views.CONFIG)


@query()
def dataset_balance(spark, sf):
    return rules.balance(derived(spark, sf))


@query("""SELECT 'info' AS level, 'NO_ACCEPTED' AS code, 'no accepted samples yet; evaluation payload will be empty without --include-unreviewed' AS message
  UNION ALL SELECT 'warning', 'CONDITION_CELL_EMPTY', 'referent shift does not have both True and False cells' FROM (SELECT count(*) FILTER (anchor <> gold) AS a, count(*) FILTER (anchor = gold) AS b FROM roles) WHERE a = 0 OR b = 0
  UNION ALL SELECT 'warning', 'ROLE_CELL_EMPTY', 'no sample with gold role ' || r FROM (SELECT unnest(['speaker', 'addressee', 'third_party']) AS r) WHERE r NOT IN (SELECT gold_role FROM roles WHERE gold_role IS NOT NULL)""", DERIVED)
def balance_issues(spark, sf):
    """Of the balance with nothing accepted, and a distractor in every other sample."""
    d = derived(spark, sf).withColumns({"annotation_status": F.lit("in_review"), "distractor_present": F.col("sample_id").cast("long") % 2 == 0})
    return rules.balance_issues(rules.balance(d)).select("level", "code", "message")


@query()
def pair_manifest(spark, sf):
    d = derived(spark, sf).withColumns({"candidates": rules.ids(), "target_text": F.try_element_at("dialogue", F.lit(-1))["text"], "turns": F.map_from_entries(F.transform("dialogue", lambda t: F.struct(t["turn_index"], F.concat_ws("\t", t["speaker_id"], t["text"]))))})
    fields = ("sample_id", "scenario_id", "variant", "pair_ids", "pair_claims", "pair_expected_gold_change", "manipulated_variables", "expected_gold_change", "candidates", "target_text", "turns", *pairs.CONTROLLED_VARIABLES)
    two = pairs.members(d.select(*dict.fromkeys(fields)))
    every = pairs.pair_diff(two)
    diff = pairs.manifest(every)
    problems = pairs.pair_problems(two, every).groupBy("pair_id").agg(F.count("*").alias("n_problems"))
    return two.select("pair_id").join(diff, "pair_id", "left").join(problems, "pair_id", "left").select("pair_id", "a_id", "b_id", F.array_join("differing_variables", ",").alias("differing"), F.array_join("unclaimed_differences", ",").alias("unclaimed"), "observed_gold_change", "gold_change_matches_expectation", "is_single_variable_pair", F.coalesce("n_problems", F.lit(0)).alias("n_problems"))


# -- annotation --------------------------------------------------------------

FIELD_LIST = "[{'field': 'referent_id', 'x': ra, 'y': rb}, {'field': 'addressee_id', 'x': da, 'y': db}, {'field': 'context_sufficient', 'x': ca, 'y': cb}, {'field': 'ambiguity', 'x': ma, 'y': mb}, {'field': 'determinable', 'x': CASE ma WHEN '' THEN '' WHEN 'unambiguous' THEN 'True' ELSE 'False' END, 'y': CASE mb WHEN '' THEN '' WHEN 'unambiguous' THEN 'True' ELSE 'False' END}]"


@query("""SELECT condition, pair, field, CAST(n AS BIGINT) AS n, CAST(n_missing AS BIGINT) AS n_missing, CASE WHEN n > 0 THEN round(same / n, 6) END AS percent_agreement,
  CASE WHEN n > 0 AND e < n * n THEN round((same / n - e / (n * n)) / (1 - e / (n * n)), 6) END AS cohen_kappa, CASE WHEN n > 0 AND NOT e < n * n THEN 'undefined: single category' END AS kappa_note
  FROM base LEFT JOIN chance USING (condition, pair, field)""", VOTES + f""",
f AS (SELECT condition, pair, x.field AS field, x.x AS x, x.y AS y FROM (SELECT condition, pair, unnest({FIELD_LIST}) AS x FROM both_)),
base AS (SELECT condition, pair, field, CAST(count(*) FILTER (x <> '' AND y <> '') AS DOUBLE) AS n, count(*) FILTER (x = '' OR y = '') AS n_missing, CAST(count(*) FILTER (x <> '' AND x = y) AS DOUBLE) AS same FROM f GROUP BY 1, 2, 3),
cx AS (SELECT condition, pair, field, x AS v, count(*) AS nx FROM f WHERE x <> '' AND y <> '' GROUP BY ALL), cy AS (SELECT condition, pair, field, y AS v, count(*) AS ny FROM f WHERE x <> '' AND y <> '' GROUP BY ALL),
chance AS (SELECT condition, pair, field, CAST(sum(nx * coalesce(ny, 0)) AS DOUBLE) AS e FROM cx LEFT JOIN cy USING (condition, pair, field, v) GROUP BY 1, 2, 3)""")
def agreement(spark, sf):
    return ag.agreement(views.votes(spark, sf))


@query("""SELECT condition, pair, count(*) AS n, CASE WHEN NOT bool_or(bad) THEN round(avg(d), 6) END AS mean_abs_diff, CASE WHEN NOT bool_or(bad) THEN round(avg(CASE WHEN d <= 1 THEN 1.0 ELSE 0.0 END), 6) END AS within_1, CASE WHEN bool_or(bad) THEN 'non-integer naturalness' END AS error
  FROM (SELECT condition, pair, abs(try_cast(na AS INT) - try_cast(nb AS INT)) AS d, try_cast(na AS INT) IS NULL OR try_cast(nb AS INT) IS NULL AS bad FROM both_ WHERE na <> '' AND nb <> '') GROUP BY 1, 2""", VOTES)
def naturalness_diff(spark, sf):
    return ag.naturalness(views.votes(spark, sf))


@query("SELECT condition, pair, count(*) AS n FROM both_ WHERE ra <> rb OR ma <> mb GROUP BY 1, 2", VOTES)
def annotator_disagreements(spark, sf):
    return ag.disagreements(views.votes(spark, sf)).groupBy("condition", "pair").agg(F.count("*").alias("n"))


@query("SELECT condition, pair, count(*) AS n FROM both_ GROUP BY 1, 2", VOTES)
def annotator_pairs(spark, sf):
    p = ag.annotator_pairs(views.votes(spark, sf))
    return p.groupBy("condition", F.concat("a.annotator", F.lit("~"), "b.annotator").alias("pair")).agg(F.count("*").alias("n"))


@query("""SELECT annotator, sample_id, unnest(list_filter(CASE WHEN CAST(sample_id AS BIGINT) % 9 = 0 THEN ['unknown sample'] ELSE [CASE WHEN referent_id NOT IN ('', 'E1') THEN 'referent_id not a candidate' END, CASE WHEN addressee_id NOT IN ('', 'E1') THEN 'addressee_id not a candidate' END,
    CASE WHEN ambiguity NOT IN ('', 'unambiguous', 'ambiguous', 'uncertain') THEN 'ambiguity invalid' END] END, lambda x: x IS NOT NULL)) AS problem FROM votes""", VOTES)
def vote_problems(spark, sf):
    known = table(spark, sf, "labels").select("doc_id").distinct().filter("doc_id % 9 <> 0").select(F.col("doc_id").cast("string").alias("sample_id"), F.array(F.lit("E1")).alias("ids"))
    return ag.vote_problems(views.votes(spark, sf), known)


@query("""SELECT context_need, count(*) AS n FROM (SELECT sample_id, CASE WHEN bool_and(ambiguity = 'unambiguous' AND referent_id = 'E2') THEN 'locally_recoverable' WHEN bool_and(ambiguity IN ('ambiguous', 'uncertain') OR referent_id = '') THEN 'discourse_dependent' ELSE 'conflict' END AS context_need
  FROM votes WHERE condition = 'local' AND CAST(sample_id AS BIGINT) % 3 <> 0 GROUP BY 1) GROUP BY 1""", VOTES)
def context_need(spark, sf):
    gold = views.votes(spark, sf).select("sample_id").distinct().withColumn("final_gold", F.when(F.col("sample_id").cast("long") % 3 != 0, "E2"))
    return ag.context_need(views.votes(spark, sf), gold).groupBy("context_need").agg(F.count("*").alias("n"))


@query("""SELECT outcome, annotation_status, final_gold, final_ambiguity, final_addressee, addressee_disputed, count(*) AS n FROM (
  SELECT outcome, CASE WHEN outcome LIKE 'accepted%' THEN 'accepted' WHEN outcome LIKE 'rejected%' THEN 'rejected' ELSE 'in_review' END AS annotation_status,
    CASE WHEN outcome = 'accepted_unanimous' THEN r WHEN outcome = 'accepted_adjudicated' THEN 'E3' WHEN outcome LIKE 'rejected%' THEN NULL ELSE 'E1' END AS final_gold,
    CASE WHEN outcome LIKE 'accepted%' THEN 'unambiguous' WHEN outcome = 'rejected_unanimous_ambiguous' THEN a WHEN outcome = 'rejected' THEN 'uncertain' ELSE 'unreviewed' END AS final_ambiguity,
    CASE WHEN k % 4 = 1 THEN 'E4' WHEN d <> '' THEN d ELSE 'E1' END AS final_addressee, k % 4 <> 1 AND d IS NULL AND any_d AS addressee_disputed
  FROM (SELECT *, CASE WHEN r <> '' AND a = 'unambiguous' THEN 'accepted_unanimous' WHEN r = '' AND a IN ('ambiguous', 'uncertain') THEN 'rejected_unanimous_ambiguous' WHEN k % 4 = 1 THEN 'accepted_adjudicated' WHEN k % 4 = 2 THEN 'rejected' ELSE 'pending' END AS outcome
    FROM (SELECT CAST(sample_id AS BIGINT) AS k, CASE WHEN min(referent_id) = max(referent_id) THEN max(referent_id) END AS r, CASE WHEN min(ambiguity) = max(ambiguity) THEN max(ambiguity) END AS a, CASE WHEN min(addressee_id) = max(addressee_id) THEN max(addressee_id) END AS d, bool_or(addressee_id <> '') AS any_d
      FROM votes WHERE condition = 'full' GROUP BY 1))) GROUP BY ALL""", VOTES)
def adjudicate_votes(spark, sf):
    v = views.votes(spark, sf)
    samples = v.select("sample_id").distinct().select("sample_id", F.lit("E1").alias("gold_referent_id"), F.lit("E1").alias("addressee_id"), F.lit("unreviewed").alias("ambiguity_status"))
    k = F.col("sample_id").cast("long") % 4
    decisions = samples.filter(k.isin(1, 2)).select("sample_id", F.when(k == 1, "accept").otherwise("reject").alias("decision"), F.when(k == 1, "E3").otherwise("").alias("final_referent_id"), F.when(k == 2, "unambiguous").otherwise("").alias("final_ambiguity"), F.when(k == 1, "E4").otherwise("").alias("final_addressee_id"))
    keys = ["outcome", "annotation_status", "final_gold", "final_ambiguity", "final_addressee", "addressee_disputed"]
    return ag.adjudicate(samples, v, decisions).groupBy(*keys).agg(F.count("*").alias("n"))


# -- parsing and runs --------------------------------------------------------

RAW = """
r AS (
  SELECT event_id AS ordinal, k, 'E' || (k % 4 + 1) AS e, k % 8 AS m FROM (SELECT event_id, CAST(props->>'$.k' AS INT) AS k FROM events))
"""


@query("""SELECT ordinal, CASE WHEN m IN (0, 1, 7) OR (m = 2 AND e = 'E1') THEN CASE WHEN m = 7 OR m = 2 THEN 'E1' ELSE e END END AS predicted_entity_id,
  CASE WHEN m IN (0, 1, 7) OR (m = 2 AND e = 'E1') THEN 'ok' WHEN m = 4 THEN 'missing' WHEN m = 5 THEN 'abstain' ELSE 'invalid' END AS parse_status,
  CASE WHEN m IN (0, 1, 7) OR (m = 2 AND e = 'E1') THEN '' WHEN m = 2 THEN 'multiple ids' WHEN m = 3 THEN 'empty' WHEN m = 4 THEN 'no response' WHEN m = 5 THEN 'abstain pattern' ELSE 'no candidate id' END AS note FROM r""", RAW)
def parse_mcq(spark, sf):
    ids = F.array(*(F.lit(f"E{i}") for i in range(1, 5)))
    return views.responses(spark, sf).withColumn("p", parsing.parse_free("raw_text", ids)).select("ordinal", "p.*")


@query("""SELECT ordinal, CASE WHEN m = 1 THEN e END AS predicted_entity_id, CASE WHEN m = 1 THEN 'ok' WHEN m = 4 THEN 'missing' WHEN m = 6 AND k % 3 = 0 THEN 'abstain' ELSE 'invalid' END AS parse_status,
  CASE WHEN m = 1 THEN '' WHEN m = 4 THEN 'no response' WHEN m = 3 THEN 'empty' WHEN m = 6 AND k % 3 = 0 THEN 'abstain value' WHEN m = 6 THEN 'id not in candidates' WHEN m = 7 THEN 'multiple ids' ELSE 'json error' END AS note FROM r""", RAW)
def parse_mcq_json(spark, sf):
    ids = F.array(*(F.lit(f"E{i}") for i in range(1, 5)))
    return views.responses(spark, sf).withColumn("p", parsing.parse_structured("raw_text", ids)).select("ordinal", "p.*")


def answered_by_alias(spark, sf):
    """Responses with ``p``, their entity by the roster's aliases, which are worked out once for all rows."""
    entries = spark.range(1).select(parsing.alias_entries(views.roster(), F.lit("A"), F.lit("B")).alias("entries"))
    rows = views.responses(spark, sf).crossJoin(F.broadcast(entries))
    return rows.withColumn("p", parsing.parse_by_alias("raw_text", F.col("entries"))).drop("entries")


@query()
def parse_qa_alias(spark, sf):
    return answered_by_alias(spark, sf).select("ordinal", "p.*")


@query()
def review_queue(spark, sf):
    return runner.review_queue(answered_by_alias(spark, sf).select("*", "p.parse_status").withColumn("target_speaker_label", F.lit("A")))


@query("""SELECT item_id, condition, CASE WHEN f > 2 THEN 'missing' ELSE 'ok' END AS status, least(f, 2) AS retries, CASE WHEN f > 2 THEN 'transient: busy' END AS error,
    CASE WHEN f <= 2 THEN '{"entity_id": "E' || (CAST('0x' || substr(md5(item_id), 1, 8) AS BIGINT) % 3 + 1) || '"}' END AS raw_text
  FROM (SELECT item_id, condition, CAST('0x' || substr(md5(item_id || '|' || condition), 1, 8) AS BIGINT) % 4 AS f
    FROM (SELECT DISTINCT CAST(conv_id AS VARCHAR) AS item_id FROM rec WHERE gold IS NOT NULL AND conv_id % 3 <> 1), (SELECT unnest(['full_mcq', 'target_only_mcq']) AS condition))""", NEUTRAL.strip() + "," + DERIVED.replace(TURNS, "").strip().lstrip(","))
def run_passes(spark, sf):
    """A run in a folder against a service that is busy up to three times for each request."""
    kept, _ = dialogue.evaluation_split(dialogue.neutral_ids(derived(spark, sf)))
    out = runs.work_folder(spark)
    runs.run_folder(spark, dialogue.items(kept), ("full_mcq", "target_only_mcq"), runner.Unsteady(runner.Mock()), views.PROMPT, views.CONFIG, out, wait=lambda s: None, clock=lambda: float("inf"))
    lines = spark.read.schema(schemas.RESPONSES).json(f"{out}/responses")
    return lines.select("item_id", "condition", "status", F.col("retries").cast("long").alias("retries"), "error", "raw_text")


@query()
def mock_run_end_to_end(spark, sf):
    """Items, requests, answers, normalisation, gold join and accuracy in one query."""
    kept, _ = dialogue.evaluation_split(dialogue.neutral_ids(derived(spark, sf)))
    items, gold = dialogue.items(kept), dialogue.gold(kept)
    log = runner.run(runner.requests(items, ("full_mcq", "target_only_mcq"), views.PROMPT, views.CONFIG), runner.get_adapter("mock")).withColumn("ordinal", F.lit(0))
    rows = runner.normalise(log, items.withColumn("addressee_label", F.lit(None).cast("string")))
    return joins.strict_join(rows, gold, "item_id").groupBy("model_label", "condition").agg(*metrics.entity_accuracy().columns(), *metrics.status_columns())


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["mock_run_end_to_end"](spark, sf_dir)


