"""Metric tables, persona reports, records and pairs: queries and their DuckDB oracles.

Generations are documents that have an embedding: the label's remainder by three is the
method (m0 is the base), the source the prompt, the lang the persona (es stands for none).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from loomline.functions import dims
from loomline.functions import vectors as V
from loomline.operators import bootstrap, cascade, coauthor, corpus, metrics, pairs, persona_report, records, stats
from loomline.plans.registry import REPS, query, read

_TOK = r"regexp_extract_all(lower(coalesce(output, '')), '[\p{L}\p{N}_]+')"
_WORDS = lambda c: rf"len(regexp_extract_all(coalesce({c}, ''), '\S+'))"

GEN = """gen AS (SELECT 'm' || (e.label % 3) AS method, d.source AS prompt, CASE WHEN d.lang <> 'es' THEN d.lang END AS persona, d.doc_id AS output_id, d.text AS output,
  e.embedding::double[] AS v, sqrt(list_dot_product(e.embedding::double[], e.embedding::double[])) AS norm FROM embeddings AS e JOIN documents AS d ON d.doc_id = e.vec_id)"""


def generations(spark, d):
    docs = read(spark, d, "documents").select(F.col("doc_id").alias("output_id"), F.col("source").alias("prompt"), F.when(F.col("lang") != "es", F.col("lang")).alias("persona"), F.col("text").alias("output"))
    e = read(spark, d, "embeddings").select("vec_id", F.concat(F.lit("m"), F.col("label") % 3).alias("method"), "embedding")
    dim = V.dimension(read(spark, d, "embeddings"), "embedding")
    gen = docs.join(e, F.col("output_id") == F.col("vec_id")).withColumn("v", F.transform("embedding", lambda x: x.cast("double")))
    return V.with_unit(gen).drop("embedding", "vec_id"), dim


def _automated_sql(by: str, source: str = "gen") -> str:
    """CTEs that end in auto(by, n, self_bleu, distinct_1, distinct_2, sbert_cosine)."""
    on = lambda a, b: " AND ".join(f"{a}.{c.strip()} = {b}.{c.strip()}" for c in by.split(","))
    return rf"""
t AS (SELECT {by}, output_id, {_TOK} AS w FROM {source}),
gr AS (SELECT {by}, output_id, o.n AS n, array_to_string(w[i : i + o.n - 1], ' ') AS g FROM t, unnest([1, 2, 3, 4]) AS o(n), unnest(range(1, len(w) - o.n + 2)) AS u(i)),
dn AS (SELECT {by}, max(CASE WHEN n = 1 THEN d END) AS d1, max(CASE WHEN n = 2 THEN d END) AS d2 FROM (SELECT {by}, n, count(DISTINCT g) / count(*) AS d FROM gr WHERE n <= 2 GROUP BY ALL) GROUP BY ALL),
gc AS (SELECT {by}, output_id, n, g, count(*) AS c FROM gr GROUP BY ALL),
gm AS (SELECT *, row_number() OVER (PARTITION BY {by}, n, g ORDER BY c DESC, output_id) AS rn FROM gc),
gt AS (SELECT {by}, n, g, max(CASE WHEN rn = 1 THEN output_id END) AS k1, max(CASE WHEN rn = 1 THEN c END) AS m1, coalesce(max(CASE WHEN rn = 2 THEN c END), 0) AS m2 FROM gm WHERE rn <= 2 GROUP BY ALL),
gh AS (SELECT {by}, output_id, n, sum(least(c, CASE WHEN output_id = k1 THEN m2 ELSE m1 END)) AS hit, sum(c) AS total FROM gc JOIN gt USING ({by}, n, g) GROUP BY ALL),
ge AS (SELECT t.*, len(t.w) AS l, o.n, coalesce(gh.hit, 0) AS hit, coalesce(gh.total, 0) AS total FROM t CROSS JOIN unnest([1, 2, 3, 4]) AS o(n) LEFT JOIN gh ON gh.output_id = t.output_id AND gh.n = o.n AND {on("gh", "t")}),
gz AS (SELECT *, sum(CASE WHEN hit = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY output_id ORDER BY n) AS k FROM ge),
gp AS (SELECT {by}, output_id, l, sum(CASE WHEN hit > 0 THEN ln(hit / total) ELSE -k * ln(2.0) - ln(CASE WHEN total = 0 THEN greatest(l, 1) ELSE total END) END) / 4 AS s FROM gz GROUP BY ALL),
gl AS (SELECT a.output_id, arg_min(len(b.w), struct_pack(x := abs(len(b.w) - len(a.w)), y := len(b.w))) AS r FROM t AS a JOIN t AS b ON {on("a", "b")} AND a.output_id <> b.output_id GROUP BY 1),
gb AS (SELECT {by}, avg(CASE WHEN l = 0 THEN 0 ELSE exp(s) * CASE WHEN l > r THEN 1 ELSE exp(1 - r / l) END END) AS sb FROM gp JOIN gl USING (output_id) GROUP BY ALL),
gv AS (SELECT {", ".join(f"a.{c.strip()}" for c in by.split(","))}, avg(list_dot_product(a.v, b.v) / a.norm / b.norm) AS cs FROM {source} AS a JOIN {source} AS b ON {on("a", "b")} AND a.output_id < b.output_id GROUP BY ALL),
auto AS (SELECT {by}, n, coalesce(sb, 0) AS self_bleu, coalesce(d1, 0) AS distinct_1, coalesce(d2, 0) AS distinct_2, coalesce(cs, 0) AS sbert_cosine
  FROM (SELECT {by}, count(*) AS n FROM {source} GROUP BY ALL) LEFT JOIN gb USING ({by}) LEFT JOIN dn USING ({by}) LEFT JOIN gv USING ({by}))"""


@query(f"""
WITH {GEN}, {_automated_sql("method, prompt")},
nov AS (SELECT 'm' || (label % 3) AS method, source AS prompt, avg(n_chars) / 1000.0 AS nv FROM embeddings JOIN documents ON doc_id = vec_id WHERE doc_id % 2 = 0 GROUP BY ALL)
SELECT method, prompt, metric, round(value, 6) AS value FROM (
  SELECT method, prompt, unnest(['self_bleu', 'distinct_1', 'distinct_2', 'sbert_cosine', 'corpus_novelty']) AS metric, unnest([self_bleu, distinct_1, distinct_2, sbert_cosine, nv]) AS value
  FROM auto LEFT JOIN nov USING (method, prompt) WHERE n >= 2) WHERE value IS NOT NULL
""")
def per_prompt_metrics(spark, d):
    gen, dim = generations(spark, d)
    chars = read(spark, d, "documents").where("doc_id % 2 = 0").select(F.col("doc_id").alias("output_id"), "n_chars")
    novelty = gen.join(chars, "output_id").groupBy("method", "prompt").agg((F.avg("n_chars") / 1000).alias("corpus_novelty"))
    return metrics.per_prompt_automated(gen, dim, novelty).withColumn("value", F.round("value", 6))


#: Judgements of events: quality has two numbers and a text, utility is null for odd ids.
_K = "(props::json->>'$.k')::double"
_JUDGED = f"""jd AS (SELECT event_id, event_type AS method, user_id AS prompt, ({_K} + value) / 2 AS quality, {_K} AS novelty, CASE WHEN event_id % 2 = 0 THEN value END AS utility FROM events)"""


def _judged(spark, d):
    e = read(spark, d, "events")
    k = F.get_json_object("props", "$.k").cast("double")
    block = lambda **m: F.to_json(F.struct(*[v.alias(n) for n, v in m.items()]))
    return e.select(
        "event_id",
        F.col("event_type").alias("method"),
        F.col("user_id").alias("prompt"),
        block(relevance=k, coherence=F.col("value"), substance=F.lit("no number")).alias("quality"),
        block(novelty=k).alias("novelty"),
        F.when(F.col("event_id") % 2 == 0, block(prewriting_utility=F.col("value"))).alias("utility"),
        F.lit(None).cast("string").alias("persona_fidelity"),
    )


@query(f"""
WITH {_JUDGED}, m AS (SELECT method, prompt, unnest(['quality', 'novelty', 'utility']) AS metric, unnest([quality, novelty, utility]) AS value FROM jd)
SELECT method, prompt, metric, round(avg(value), 9) AS value FROM m WHERE value IS NOT NULL GROUP BY 1, 2, 3
""")
def judge_means_by_prompt(spark, d):
    return metrics.per_prompt_judged(_judged(spark, d)).withColumn("value", F.round("value", 9))


@query(f"""
WITH {_JUDGED}, m AS (SELECT method, prompt, unnest(['quality', 'novelty', 'utility']) AS metric, unnest([quality, novelty, utility]) AS value FROM jd),
p AS (SELECT method, prompt, metric, avg(value) AS value FROM m WHERE value IS NOT NULL GROUP BY 1, 2, 3),
s AS (SELECT method, metric, avg(value) AS mean, coalesce(stddev_samp(value), 0) AS std, count(*) AS n FROM p GROUP BY 1, 2)
SELECT method, metric, round(mean, 6) AS mean, round(std, 6) AS std, coalesce(n, 0) AS n
FROM (SELECT DISTINCT method FROM jd) CROSS JOIN (SELECT unnest(['quality', 'novelty', 'utility', 'persona_fidelity']) AS metric) LEFT JOIN s USING (method, metric)
""")
def metric_summary_with_empty(spark, d):
    judged = _judged(spark, d)
    s = stats.summarise(metrics.per_prompt_judged(judged), ["method", "metric"])
    dimension = judged.select("method").distinct().withColumn("metric", F.explode(F.array(*map(F.lit, metrics.RUBRIC_KEYS))))
    out = stats.with_empty(s, dimension, ["method", "metric"])
    return out.select("method", "metric", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"), "n")


@query("SELECT event_type AS method, round(avg(value), 4) AS mean, round(stddev_samp(value), 4) AS std, count(value) AS n FROM events WHERE event_type IN ('click', 'error', 'purchase', 'view') GROUP BY 1")
def score_table(spark, d):
    return stats.score_table(read(spark, d, "events").withColumnRenamed("event_type", "method"), ["purchase", "view", "click", "error"], "value")


@query(f"""
WITH {GEN}, own AS (SELECT * FROM gen WHERE persona IS NOT NULL), {_automated_sql("method, persona", "own")},
jl AS (SELECT user_id AS output_id, arg_max({_K}, event_id) AS novelty, arg_max(value, event_id) AS v, max(event_id) AS e FROM events GROUP BY 1),
js AS (SELECT output_id, (novelty + v) / 2 AS quality, novelty, CASE WHEN e % 2 = 0 THEN v END AS utility FROM jl),
jm AS (SELECT method, persona, avg(quality) AS quality, avg(novelty) AS novelty, avg(utility) AS utility, count(quality) AS quality_n, count(novelty) AS novelty_n, count(utility) AS utility_n FROM own LEFT JOIN js USING (output_id) GROUP BY 1, 2)
SELECT 'run1' AS run, method, persona, n AS n_outputs, round(self_bleu, 6) AS self_bleu, round(distinct_1, 6) AS distinct_1, round(distinct_2, 6) AS distinct_2, round(sbert_cosine, 6) AS sbert_cosine, round(1 - sbert_cosine, 6) AS sbert_distance,
  round(quality, 6) AS quality, round(novelty, 6) AS novelty, round(utility, 6) AS utility, NULL::double AS persona_fidelity, quality_n, novelty_n, utility_n, 0::bigint AS persona_fidelity_n
FROM auto JOIN jm USING (method, persona)
""")
def persona_breakdown_full(spark, d):
    gen, dim = generations(spark, d)
    judged = _judged(spark, d).drop("method").withColumnRenamed("prompt", "output_id")  # users repeat: the last row counts
    rows = metrics.breakdown(gen, judged, "event_id", dim, "run1")
    rounded = {"self_bleu", "distinct_1", "distinct_2", "sbert_cosine", "sbert_distance", "quality", "novelty", "utility", "persona_fidelity"}
    return rows.select(*[F.round(c, 6).alias(c) if c in rounded else F.col(c) for c in rows.columns])


_ORDER = "CASE persona " + " ".join(f"WHEN '{p}' THEN {k}" for k, p in enumerate(dims.PERSONAS)) + " ELSE 99 END"
_SIM = "list_dot_product(a.v, b.v) / a.norm / b.norm"
_REPORT = f"""{GEN},
cen AS (SELECT method, prompt, persona, list(s ORDER BY p) AS s FROM (SELECT method, prompt, persona, p, sum(v[p]) AS s FROM gen, unnest(range(1, len(v) + 1)) AS u(p) WHERE persona IS NOT NULL GROUP BY ALL) GROUP BY ALL),
ip AS (SELECT a.method, a.prompt, a.persona AS a, b.persona AS b, 1 - list_dot_product(a.s, b.s) / sqrt(list_dot_product(a.s, a.s)) / sqrt(list_dot_product(b.s, b.s)) AS x
  FROM cen AS a JOIN cen AS b ON a.method = b.method AND a.prompt = b.prompt AND a.persona < b.persona),
ii AS (SELECT method, prompt, avg(x) AS x FROM ip GROUP BY 1, 2),
ia AS (SELECT a.method, a.prompt, coalesce(a.persona, 'none') AS persona, 1 - avg({_SIM}) AS x FROM gen AS a JOIN gen AS b ON a.method = b.method AND a.prompt = b.prompt AND a.persona IS NOT DISTINCT FROM b.persona AND a.output_id < b.output_id GROUP BY 1, 2, 3),
cp AS (SELECT a.method, a.persona, 1 - avg({_SIM}) AS x FROM gen AS a JOIN gen AS b ON a.method = b.method AND a.persona = b.persona AND a.output_id < b.output_id GROUP BY 1, 2),
bs AS (SELECT prompt, arg_max(x, persona) AS y FROM ia WHERE method = 'm0' GROUP BY 1 HAVING arg_max(x, persona) > 1e-9),
mt AS (SELECT method, x, y FROM ii JOIN bs USING (prompt)),
sm AS (SELECT a.method, a.persona, a.output_id, b.persona AS other, avg(1 - {_SIM}) AS dist FROM gen AS a JOIN gen AS b ON a.method = b.method AND a.output_id <> b.output_id WHERE a.persona IS NOT NULL AND b.persona IS NOT NULL GROUP BY 1, 2, 3, 4),
sn AS (SELECT method, persona, output_id, max(CASE WHEN other = persona THEN dist END) AS a, min(CASE WHEN other <> persona THEN dist END) AS b FROM sm GROUP BY 1, 2, 3),
si AS (SELECT method, persona, (b - a) / greatest(a, b) AS x FROM sn WHERE a IS NOT NULL AND b IS NOT NULL AND greatest(a, b) > 1e-9),
sections AS (
  SELECT method, 'inter' AS section, NULL AS key, x FROM ii UNION ALL SELECT method, 'intra', NULL, x FROM ia UNION ALL SELECT method, 'cross_prompt', NULL, x FROM cp
  UNION ALL SELECT method, 'paired_ratio', NULL, x / y FROM mt UNION ALL SELECT method, 'difference', NULL, x - y FROM mt UNION ALL SELECT method, 'silhouette', NULL, x FROM si
  UNION ALL SELECT method, 'inter_pair', a || '__' || b, x FROM ip UNION ALL SELECT method, 'intra_persona', persona, x FROM ia
  UNION ALL SELECT method, 'cross_prompt_persona', persona, x FROM cp UNION ALL SELECT method, 'silhouette_persona', persona, x FROM si),
st AS (SELECT method, section, key, avg(x) AS mean, coalesce(stddev_samp(x), 0) AS std, count(*) AS n FROM sections GROUP BY 1, 2, 3
  UNION ALL SELECT method, 'ratio', NULL, avg(x) / avg(y), 0, count(*) FROM mt GROUP BY 1),
rep AS (SELECT method, section, key, mean, std, n FROM st WHERE key IS NOT NULL
  UNION ALL SELECT method, section, NULL, mean, std, coalesce(n, 0) FROM (SELECT DISTINCT method FROM gen) CROSS JOIN (SELECT unnest(['inter', 'intra', 'cross_prompt', 'ratio', 'paired_ratio', 'difference', 'silhouette']) AS section)
    LEFT JOIN (SELECT * FROM st WHERE key IS NULL) USING (method, section))"""


def _report(spark, d):
    gen, dim = generations(spark, d)
    return persona_report.persona_diversity(gen, dim, "output_id", "m0")


def _rounded(df):
    return df.select("method", "section", "key", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"), F.col("n").cast("long").alias("n"))


@query(f"WITH {_REPORT} SELECT method, section, key, round(mean, 6) AS mean, round(std, 6) AS std, n FROM rep")
def persona_diversity_report(spark, d):
    return _rounded(_report(spark, d))


@query(f"WITH {_REPORT} SELECT method, a, b, round(avg(x), 6) AS mean, round(coalesce(stddev_samp(x), 0), 6) AS std, count(*) AS n FROM ip GROUP BY 1, 2, 3")
def inter_persona_pairs(spark, d):
    gen, dim = generations(spark, d)
    s = stats.summarise(persona_report.inter_pairs(gen, dim), ["method", "a", "b"], "distance")
    return s.select("method", "a", "b", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"), "n")


@query(f"WITH {_REPORT} SELECT method, round(avg(x), 6) AS mean, round(coalesce(stddev_samp(x), 0), 6) AS std, count(*) AS n FROM si GROUP BY 1")
def silhouette_overall(spark, d):
    r = _rounded(_report(spark, d)).where("section = 'silhouette'")
    return r.select("method", "mean", "std", "n")


_AT = lambda section, s: f"max(CASE WHEN section = '{section}' AND key IS NULL THEN {s} END)"
_WIDE = ", ".join(f"round({_AT(section, s)}, 6) AS {name}" if s != "n" else f"{_AT(section, s)} AS {name}" for name, section, s in persona_report.CSV_COLUMNS)


@query(f"WITH {_REPORT} SELECT method, {_WIDE}, {_AT('intra', 'n')} > 0 AS available FROM rep GROUP BY 1")
def persona_diversity_wide(spark, d):
    w = persona_report.wide(_report(spark, d))
    return w.select("method", *[F.round(n, 6).alias(n) if s != "n" else F.col(n).cast("long").alias(n) for n, _, s in persona_report.CSV_COLUMNS], "available")


_MATRIX = f"""{GEN},
each AS (SELECT a.persona AS a, b.persona AS b, a.prompt, avg({_SIM}) AS c FROM gen AS a JOIN gen AS b ON a.prompt = b.prompt AND a.persona <> b.persona GROUP BY 1, 2, 3),
names AS (SELECT DISTINCT persona FROM gen WHERE persona IS NOT NULL),
mat AS (SELECT x.persona AS a, y.persona AS b, CASE WHEN x.persona = y.persona THEN 1.0 ELSE coalesce(round(avg(c), 4), 0) END AS cosine FROM names AS x CROSS JOIN names AS y LEFT JOIN each ON each.a = x.persona AND each.b = y.persona GROUP BY 1, 2)"""


@query(f"WITH {_MATRIX} SELECT a, b, cosine, CASE WHEN a < b THEN CASE WHEN cosine < 0.5 THEN 'distinct' WHEN cosine < 0.7 THEN 'borderline' ELSE 'mode-collapsed' END END AS verdict FROM mat")
def distinctness_matrix(spark, d):
    gen, dim = generations(spark, d)
    return persona_report.distinctness(gen, "persona", ["prompt"], dim)


@query(f"""
WITH {_MATRIX}, v AS (SELECT count(*) AS n_pairs, count(*) FILTER (cosine < 0.5) AS n_distinct, count(*) FILTER (cosine > 0.7) AS n_collapsed FROM mat WHERE a < b)
SELECT *, CASE WHEN n_distinct >= 1 AND n_collapsed = 0 THEN 'pass' ELSE 'review' END AS verdict, n_pairs > 0 AND n_distinct = n_pairs AS all_distinct FROM v
""")
def distinctness_verdict(spark, d):
    return persona_report.distinctness_verdict(distinctness_matrix(spark, d))


#: Conversations: the question is a user turn, the answer the assistant's turn after it.
_QA = "SELECT q.conv_id * 100000 + q.turn AS id, q.text AS question, a.text AS answer FROM conversations AS q JOIN conversations AS a ON a.conv_id = q.conv_id AND a.turn = q.turn + 1 WHERE q.role = 'user' AND a.role = 'assistant'"
_QA_REASON = rf"""CASE WHEN coalesce(NOT regexp_matches(question, '\S'), true) THEN 'empty_input' WHEN coalesce(NOT regexp_matches(answer, '\S'), true) THEN 'empty_response'
  WHEN {_WORDS("question")} < 20 THEN 'question_too_short' WHEN {_WORDS("question")} > 500 THEN 'question_too_long' WHEN {_WORDS("answer")} < 40 THEN 'answer_too_short' WHEN {_WORDS("answer")} > 300 THEN 'answer_too_long' END"""
LIMIT = 20


def _answers(spark, d):
    qa = records.question_answers(read(spark, d, "conversations")).withColumn("id", F.col("conv_id").cast("long") * 100000 + F.col("turn"))
    rules = [r for r in cascade.answer_rules(F.col("question"), F.col("answer")) if not r[0].startswith("mostly")]
    return cascade.with_reason(qa, rules).select("id", "reason")


@query(f"""
WITH r AS (SELECT {_QA_REASON} AS reason FROM ({_QA}))
SELECT count(*) AS total_seen, count(*) FILTER (reason IS NULL) AS total_kept, count(*) FILTER (reason IS NOT NULL) AS total_filtered,
  (SELECT string_agg(reason || '=' || n, ',' ORDER BY reason) FROM (SELECT reason, count(*) AS n FROM r WHERE reason IS NOT NULL GROUP BY 1)) AS counts FROM r
""")
def filter_totals_answers(spark, d):
    t = cascade.totals(_answers(spark, d))
    each = F.transform(F.array_sort(F.map_keys("filter_counts")), lambda k: F.concat(k, F.lit("="), F.element_at("filter_counts", k).cast("string")))
    return t.select("total_seen", "total_kept", "total_filtered", F.nullif(F.array_join(each, ","), F.lit("")).alias("counts"))


@query(f"""
WITH r AS (SELECT id, {_QA_REASON} AS reason FROM ({_QA})), s AS (SELECT *, count(*) FILTER (reason IS NULL) OVER (ORDER BY id) - CASE WHEN reason IS NULL THEN 1 ELSE 0 END AS seen FROM r)
SELECT coalesce(reason, 'kept') AS reason, count(*) AS n FROM s WHERE seen < {LIMIT} GROUP BY 1
""")
def limited_keep_answers(spark, d):
    return cascade.reason_counts(cascade.keep_limited(_answers(spark, d), "id", LIMIT))


_ARGUMENT = rf"""SELECT doc_id, CASE WHEN n < 8 THEN 'argument_too_short' WHEN n > 60 THEN 'argument_too_long' WHEN coalesce(quality < 0.65, false) THEN 'low_quality' END AS reason
  FROM (SELECT doc_id, quality, {_WORDS("text")} AS n FROM documents LEFT JOIN labels USING (doc_id) WHERE regexp_matches(text, '\S'))"""


@query(f"""
WITH r AS ({_ARGUMENT}), s AS (SELECT *, count(*) FILTER (reason IS NULL) OVER (ORDER BY doc_id) - CASE WHEN reason IS NULL THEN 1 ELSE 0 END AS seen FROM r)
SELECT coalesce(reason, 'kept') AS reason, count(*) AS n FROM s WHERE seen < {LIMIT} GROUP BY 1
""")
def limited_keep_arguments(spark, d):
    rows = read(spark, d, "documents").where(F.col("text").rlike(r"(?U)\S")).join(read(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left")
    rules = [r for r in cascade.argument_rules(F.lit("a topic of words"), F.col("text"), F.col("quality")) if "topic" not in r[0]]
    return cascade.reason_counts(cascade.keep_limited(cascade.with_reason(rows, rules).select("doc_id", "reason"), "doc_id", LIMIT))


#: Relevance of a generation: the cosine with the vector of its prompt, which is that of the
#: prompt's first output.
_V1 = rf"""{GEN}, {REPS}, first AS (SELECT prompt, arg_min(v, output_id) AS pv FROM gen GROUP BY 1),
ql AS (SELECT gen.*, greatest(0, 1 - 0.25 * coalesce(reps, 0)) AS coh, {_WORDS("output")} AS nw, greatest(0, list_dot_product(v, pv) / norm / sqrt(list_dot_product(pv, pv))) AS rel FROM gen JOIN first USING (prompt) LEFT JOIN reps ON doc_id = output_id),
qv AS (SELECT *, CASE WHEN nw < 10 OR nw > 400 THEN 0 ELSE 0.5 * rel + 0.3 * coh + 0.2 * CASE WHEN nw <= 100 THEN nw / 100 ELSE 100 / nw END END AS quality FROM ql),
ra AS (SELECT a.output_id, greatest(0, 1 - coalesce(avg({_SIM}), 0)) AS rarity FROM gen AS a LEFT JOIN gen AS b ON a.prompt = b.prompt AND a.method = b.method AND a.output_id <> b.output_id GROUP BY 1),
k AS (SELECT qv.*, rarity, round(0.4 * quality + 0.6 * rarity, 9) AS combined FROM qv JOIN ra USING (output_id)),
f AS (SELECT * FROM k WHERE quality >= 0.35),
o AS (SELECT *, count(*) OVER w AS m, row_number() OVER (w ORDER BY combined DESC, output_id) AS hi, row_number() OVER (w ORDER BY combined, output_id) AS lo FROM f WINDOW w AS (PARTITION BY prompt, method)),
pr AS (SELECT c.prompt, c.method, c.m, c.output AS ctext, r.output AS rtext, c.persona, c.output_id AS chosen, r.output_id AS rejected, c.quality AS cq, c.rarity AS cr, r.quality AS rq, r.rarity AS rr FROM o AS c JOIN o AS r ON c.prompt = r.prompt AND c.method = r.method AND c.hi = 1 AND r.lo = 1 WHERE c.m >= 2)"""


def _scored_v1(spark, d):
    gen, dim = generations(spark, d)
    pv = gen.groupBy("prompt").agg(F.min_by("u", "output_id").alias("pu"))
    rows = gen.join(pv, "prompt").withColumn("relevance", V.dot(F.col("u"), F.col("pu"))).drop("u", "pu").withColumnRenamed("output", "text")
    return pairs.with_rarity(rows, ["prompt", "method"], "v").withColumn("quality", pairs.quality(F.col("text"), F.col("relevance")))


@query(f"WITH {_V1} SELECT output_id, round(quality, 6) AS quality FROM qv")
def quality_v1(spark, d):
    return _scored_v1(spark, d).select("output_id", F.round("quality", 6).alias("quality"))


_MARGIN = "round(cr - rr, 9) >= 0 AND ctext <> rtext"


@query(f"""
WITH {_V1} SELECT prompt, method, md5(ctext) AS chosen, md5(rtext) AS rejected, persona, round(cq, 4) AS chosen_quality, round(cr, 4) AS chosen_rarity, round(rq, 4) AS rejected_quality, round(rr, 4) AS rejected_rarity, m AS candidates FROM pr WHERE {_MARGIN}
""")
def pair_records_v1(spark, d):
    scored = _scored_v1(spark, d)
    chosen = pairs.select_pairs(scored, ["prompt", "method"], "output_id", 0.35, 0.4, 0.6)
    persona = scored.select(F.col("output_id").alias("_o"), "persona")
    rows = chosen.join(persona, F.col("chosen.output_id") == F.col("_o"))
    p = pairs.pair_records(rows, F.struct("prompt", "method"), F.col("persona"), (0.4, 0.6), 0.35, 0.0, F.col("n"), False)
    m = F.col("metadata")
    return p.select("prompt.prompt", "prompt.method", F.md5("chosen").alias("chosen"), F.md5("rejected").alias("rejected"), m["persona"].alias("persona"), *[m[c].alias(c) for c in ("chosen_quality", "chosen_rarity", "rejected_quality", "rejected_rarity")], m["candidates_per_prompt"].cast("long").alias("candidates"))


@query(f"""
WITH {_V1}, gg AS (SELECT prompt, method, count(*) FILTER (quality >= 0.35) AS fit FROM k GROUP BY 1, 2)
SELECT prompt, method, CASE WHEN fit < 2 THEN 'few_eligible' WHEN ctext = rtext THEN 'identical_text' WHEN round(cr - rr, 9) < 0 THEN 'rarity_margin' END AS reason FROM gg LEFT JOIN pr USING (prompt, method)
""")
def pair_skip_reasons(spark, d):
    return pairs.skip_reason(_scored_v1(spark, d), ["prompt", "method"], 0.35, 0.4, 0.6, "output_id")


@query("""
SELECT doc_id, CASE WHEN persona IN ('en', 'de') THEN persona END AS persona, CASE WHEN doc_id % 3 = 0 THEN 'web' ELSE 'column' END AS source, doc_id::varchar AS source_id FROM (SELECT doc_id, lang AS persona FROM documents)
""")
def normalised_metadata(spark, d):
    docs = read(spark, d, "documents")
    raw = F.create_map(F.lit("source"), F.lit(" web "), F.lit("source_id"), F.lit("never"), F.lit("empty"), F.lit(" "))
    persona = F.when(F.col("lang").isin("en", "de"), F.col("lang"))
    m = records.metadata(raw, persona, F.when(F.col("doc_id") % 3 != 0, F.lit("column")), F.lit(None).cast("string"), F.col("doc_id"))
    return docs.select("doc_id", m.alias("m")).select("doc_id", F.col("m")["persona"].alias("persona"), F.col("m")["source"].alias("source"), F.col("m")["source_id"].alias("source_id"))


_PERSONA_OF = "CASE doc_id % 4 " + " ".join(f"WHEN {k} THEN '{p}'" for k, p in enumerate(dims.PERSONAS)) + " END"
_PROMPT_OF = "CASE doc_id % 4 " + " ".join(f"WHEN {k} THEN '{len(dims.SYSTEM_PROMPTS[p])}'" for k, p in enumerate(dims.PERSONAS)) + " END"


@query(rf"""
SELECT doc_id, {_PERSONA_OF} AS persona, ({_PROMPT_OF})::bigint AS system_length, md5(regexp_replace(text, '^\s+|\s+$', '', 'g')) AS user FROM documents WHERE regexp_matches(text, '\S')
""")
def lifted_records(spark, d):
    docs = read(spark, d, "documents").where(F.col("text").rlike(r"(?U)\S"))
    persona = F.element_at(F.array(*map(F.lit, dims.PERSONAS)), (F.col("doc_id") % 4 + 1).cast("int"))
    msgs = records.lift_legacy(F.lit(None).cast(records.MESSAGE), persona, F.col("text"), F.lit("an answer"))
    return docs.select("doc_id", persona.alias("persona"), msgs.alias("m")).select("doc_id", "persona", F.length(F.col("m")[0]["content"]).cast("long").alias("system_length"), F.md5(F.col("m")[1]["content"]).alias("user"))


@query("""
SELECT user_id AS output_id, round(max(value), 6) AS best, count(*) AS n_references FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS r FROM events) WHERE r < 3 GROUP BY 1
""")
def best_of_references(spark, d):
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1
    scores = read(spark, d, "events").select(F.col("user_id").alias("output_id"), rank.alias("ref_rank"), F.col("value").alias("score"))
    return metrics.best_reference(scores, 3).withColumn("best", F.round("best", 6))


@query(f"""
SELECT doc_id FROM documents WHERE {_WORDS("text")} BETWEEN 20 AND 300 AND (regexp_matches(text, '[Δ∆]|[dD][eE][lL][tT][aA]') OR lang = 'fr')
""")
def delta_by_metadata(spark, d):
    docs = read(spark, d, "documents").withColumn("meta", F.create_map(F.lit("flair"), F.when(F.col("lang") == "fr", F.lit("1 Delta")).otherwise(F.lit("none"))))
    return corpus.delta_references(docs.withColumn("score", F.lit(0)), "text", "score", "meta", enough=0).select("doc_id")


@query(f"WITH {GEN}, {_automated_sql('method')} SELECT a.method, round(a.self_bleu, 6) AS self_bleu, round(a.distinct_1, 6) AS distinct_1, round(a.sbert_cosine, 6) AS sbert_cosine, round(b.self_bleu, 6) AS base_self_bleu FROM auto AS a, auto AS b WHERE b.method = 'm0'")
def flat_evaluation(spark, d):
    gen, dim = generations(spark, d)
    return metrics.flat_evaluation(gen, dim, "m0").select("method", *[F.round(c, 6).alias(c) for c in ("self_bleu", "distinct_1", "sbert_cosine", "base_self_bleu")])


@query("""
SELECT item_id, variant, 'Topic: ' || item_id || chr(10) || 'Writer goal: Find a sharper thesis' || chr(10) || 'Audience: general readers' || CASE WHEN item_id % 2 = 0 THEN chr(10) || 'Constraints: short; plain' ELSE '' END AS brief
FROM benchmark, (SELECT unnest(['thesis', 'angle', 'outline', 'evidence', 'audience', 'revision', 'comparison', 'next_move']) AS variant)
""")
def seed_briefs(spark, d):
    limits = F.when(F.col("item_id") % 2 == 0, F.array(F.lit("short"), F.lit("plain")))
    brief = coauthor.brief_text(F.col("item_id").cast("string"), F.lit("Find a sharper thesis"), F.lit(None).cast("string"), limits)
    return coauthor.seed_variants(read(spark, d, "benchmark").select("item_id", brief.alias("brief"))).select("item_id", "variant", "brief")


@query("""
SELECT item_id, persona, operation, md5(text) AS source FROM benchmark, (SELECT * FROM (VALUES ('contrarian', 'challenge_thesis'), ('cross_domain_analogist', 'transfer_analogy'), ('systems_thinker', 'map_system'), ('minimalist', 'distill_core')) AS t(persona, operation))
""")
def external_cards(spark, d):
    rows = coauthor.external_rows(read(spark, d, "benchmark").withColumn("topic", F.col("item_id").cast("string")), "item_id", "topic", "text")
    text = F.expr("substring(card.idea, locate(': ', card.idea) + 2)")
    return rows.select("item_id", "persona", "card.operation", F.md5(text).alias("source"))


@query("""
SELECT conv_id, turn, md5('Challenge this assumption for pre-writing ideation: ' || text) AS thread, md5('Analyze this question through causes, constraints, and feedback loops: ' || text) AS question FROM conversations WHERE role = 'user'
""")
def older_prompts(spark, d):
    t = read(spark, d, "conversations").where(F.col("role") == "user")
    return t.select("conv_id", "turn", F.md5(coauthor.thread_prompt(F.col("text"))).alias("thread"), F.md5(coauthor.question_prompt(F.col("text"))).alias("question"))


_AGREE = """
p AS (SELECT lang, 'quality' AS rubric, n_chars AS x, quality AS y FROM documents JOIN labels USING (doc_id) UNION ALL SELECT lang, 'utility', n_chars, toxic FROM documents JOIN labels USING (doc_id)),
k AS (SELECT lang, rubric, rank() OVER (PARTITION BY lang, rubric ORDER BY x) + (count(*) OVER (PARTITION BY lang, rubric, x) - 1) / 2 AS a, rank() OVER (PARTITION BY lang, rubric ORDER BY y) + (count(*) OVER (PARTITION BY lang, rubric, y) - 1) / 2 AS b FROM p WHERE x IS NOT NULL AND y IS NOT NULL),
s AS (SELECT lang, rubric, count(*) AS n, CASE WHEN count(*) >= 3 AND stddev_pop(a) > 0 AND stddev_pop(b) > 0 THEN corr(a, b) END AS rho FROM k GROUP BY 1, 2)"""


@query(f"""
WITH {_AGREE} SELECT lang, rubric, n, round(rho, 4) AS rho, CASE WHEN n < 3 THEN 'insufficient' WHEN rho >= 0.8 THEN 'strong' WHEN rho >= 0.7 THEN 'good' WHEN rho >= 0.6 THEN 'moderate' ELSE 'weak' END AS interpretation FROM s
""")
def judge_agreement_rho(spark, d):
    """judge_agreement without p, which has no SQL form."""
    return judge_agreement(spark, d).drop("p")


@query(f"""
WITH {GEN}, {_automated_sql("method")},
u AS (SELECT vec_id, label, embedding::double[] AS v, sqrt(list_dot_product(embedding::double[], embedding::double[])) AS norm FROM embeddings),
nov AS (SELECT g.method, g.output_id, 1 - max(round(list_dot_product(g.v, r.v) / g.norm / r.norm, 9)) AS nov FROM gen AS g, u AS r WHERE r.label = 0 GROUP BY 1, 2),
nv AS (SELECT method, avg(nov) AS a, min(nov) AS b FROM nov GROUP BY 1),
pv AS (SELECT prompt, arg_min(v, output_id) AS v, arg_min(norm, output_id) AS norm FROM gen GROUP BY 1),
px AS (SELECT g.method, avg(list_dot_product(g.v, pv.v) / g.norm / pv.norm) AS q FROM gen AS g JOIN pv USING (prompt) GROUP BY 1)
SELECT method, n, round(self_bleu, 6) AS self_bleu, round(distinct_1, 6) AS distinct_1, round(distinct_2, 6) AS distinct_2, round(sbert_cosine, 6) AS sbert_pairwise_mean, round(a, 6) AS corpus_novelty_mean, round(b, 6) AS corpus_novelty_min, round(q, 6) AS quality_proxy
FROM auto LEFT JOIN nv USING (method) LEFT JOIN px USING (method)
""")
def evaluation_suite(spark, d):
    """All seven metrics of each method's outputs; vectors of label 0 are the corpus, and a
    prompt's first output stands for its vector."""
    gen, dim = generations(spark, d)
    refs = V.with_unit(read(spark, d, "embeddings").where("label = 0")).select(F.col("vec_id").alias("ref_id"), F.col("u").alias("ru"))
    prompts = gen.groupBy("prompt").agg(F.min_by("u", "output_id").alias("pu"))
    e = metrics.evaluate_outputs(gen, dim, refs, prompts, ["method"])
    names = ["self_bleu", "distinct_1", "distinct_2", "sbert_pairwise_mean", "corpus_novelty_mean", "corpus_novelty_min", "quality_proxy"]
    return e.select("method", "n", *[F.round(c, 6).alias(c) for c in names])


@query("""
SELECT method, persona, output_id, rank FROM (SELECT 'm' AS method, lang AS persona, doc_id AS output_id, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS rank FROM documents) WHERE rank <= 5
""")
def longest_by_persona(spark, d):
    """The five longest outputs of each persona, for reading."""
    docs = read(spark, d, "documents").select(F.lit("m").alias("method"), F.col("lang").alias("persona"), F.col("doc_id").alias("output_id"), "n_chars")
    return metrics.top_by_persona(docs, "n_chars", "output_id", 5).select("method", "persona", "output_id", F.col("rank").cast("long").alias("rank"))


@query("""
SELECT conv_id, sha256(string_agg('[' || upper(role) || ']' || chr(10) || text, chr(10) ORDER BY turn, role)) AS sha FROM conversations WHERE text IS NOT NULL GROUP BY 1
""")
def training_texts(spark, d):
    """Conversations as the text that a trainer reads."""
    c = read(spark, d, "conversations").where("text is not null")
    msgs = F.transform(F.sort_array(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))), lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content")))
    return c.groupBy("conv_id").agg(msgs.alias("m")).select("conv_id", F.sha2(records.as_training_text(F.col("m")), 256).alias("sha"))


@query()
def bootstrap_by_split(spark, d):
    """Paired bootstrap of order lines' prices by return flag, part by part, for groups of any
    size: draws by recursive splitting, which SQL can't make; the tests make the same ones."""
    lines = read(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("method"), F.col("l_partkey").alias("prompt")).agg(F.avg(F.col("l_extendedprice").cast("double")).alias("value")).withColumn("metric", F.lit("price"))
    specs = spark.createDataFrame([("price", False)], "metric string, lower_is_better boolean")
    return bootstrap.bootstrap_split(stats.paired_differences(lines, "N", specs), 1000)


@query()
def judge_agreement(spark, d):
    """Spearman's rho and p by rubric; p has no SQL form."""
    j = read(spark, d, "documents").join(read(spark, d, "labels").select("doc_id", "quality", "toxic"), "doc_id")
    return stats.spearman_by(j, {"quality": ("n_chars", "quality"), "utility": ("n_chars", "toxic")}, ["lang"])
