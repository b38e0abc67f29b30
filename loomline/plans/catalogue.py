"""Registry of the analytics queries and their DuckDB oracles.

The driver's tables stand in for the engine's entities: a document's source is its prompt
and its lang its persona; embeddings are text vectors; conversations hold threads.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from loomline.functions import dims
from loomline.functions import text as T
from loomline.functions import vectors as V
from loomline.operators import cascade, diversity, judge, pairs, records, reports, stats
from loomline.plans import extended, reporting  # noqa: F401  (register their queries)
from loomline.plans.registry import QUERIES, REPS, SQL, query, read

KEEP_LIMIT = 200
REFERENCE_LABEL = 0
RUBRIC = "Rate this answer from 1 to 5.\nQuestion: {prompt}\nAnswer: {output}\nOthers:\n{peers}"


_TOK = r"regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+')"
_WORDS = lambda c: rf"len(regexp_extract_all(coalesce({c}, ''), '\S+'))"


@query(rf"""
WITH t AS (SELECT source, lang, {_TOK} AS w FROM documents),
g AS (
  SELECT source, lang, 1 AS n, unnest(w) AS g FROM t
  UNION ALL SELECT source, lang, 2, w[i] || ' ' || w[i + 1] FROM t, unnest(range(1, len(w))) AS u(i)
),
r AS (SELECT source, lang, n, count(DISTINCT g) / count(*) AS d FROM g GROUP BY ALL)
SELECT source, lang, round(coalesce(max(CASE WHEN n = 1 THEN d END), 0), 6) AS distinct_1, round(coalesce(max(CASE WHEN n = 2 THEN d END), 0), 6) AS distinct_2
FROM (SELECT DISTINCT source, lang FROM t) LEFT JOIN r USING (source, lang) GROUP BY ALL
""")
def distinct_n_by_group(spark, d):
    out = diversity.distinct_n(read(spark, d, "documents"), ["source", "lang"], "text")
    return out.select("source", "lang", F.round("distinct_1", 6).alias("distinct_1"), F.round("distinct_2", 6).alias("distinct_2"))


@query(rf"""
WITH t AS (SELECT source, lang, doc_id, {_TOK} AS w FROM documents),
g AS (
  SELECT source, lang, doc_id, n, array_to_string(w[i : i + n - 1], ' ') AS g FROM t, unnest([1, 2, 3, 4]) AS o(n), unnest(range(1, len(w) - n + 2)) AS u(i)
),
c AS (SELECT source, lang, doc_id, n, g, count(*) AS c FROM g GROUP BY ALL),
m AS (SELECT *, row_number() OVER (PARTITION BY source, lang, n, g ORDER BY c DESC, doc_id) AS rn FROM c),
top AS (SELECT source, lang, n, g, max(CASE WHEN rn = 1 THEN doc_id END) AS k1, max(CASE WHEN rn = 1 THEN c END) AS m1, coalesce(max(CASE WHEN rn = 2 THEN c END), 0) AS m2 FROM m WHERE rn <= 2 GROUP BY ALL),
h AS (SELECT source, lang, doc_id, n, sum(least(c, CASE WHEN doc_id = k1 THEN m2 ELSE m1 END)) AS hit, sum(c) AS total FROM c JOIN top USING (source, lang, n, g) GROUP BY ALL),
e AS (SELECT t.source, t.lang, t.doc_id, len(t.w) AS l, o.n, coalesce(h.hit, 0) AS hit, coalesce(h.total, 0) AS total FROM t CROSS JOIN unnest([1, 2, 3, 4]) AS o(n) LEFT JOIN h ON h.doc_id = t.doc_id AND h.n = o.n),
z AS (SELECT *, sum(CASE WHEN hit = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY n) AS k FROM e),
p AS (SELECT source, lang, doc_id, l, sum(CASE WHEN hit > 0 THEN ln(hit / total) ELSE -k * ln(2.0) - ln(CASE WHEN total = 0 THEN greatest(l, 1) ELSE total END) END) / 4 AS s FROM z GROUP BY ALL),
r AS (SELECT a.doc_id, arg_min(len(b.w), struct_pack(x := abs(len(b.w) - len(a.w)), y := len(b.w))) AS r FROM t AS a JOIN t AS b ON a.source = b.source AND a.lang = b.lang AND a.doc_id <> b.doc_id GROUP BY 1),
b AS (SELECT source, lang, CASE WHEN l = 0 THEN 0 ELSE exp(s) * CASE WHEN l > r THEN 1 ELSE exp(1 - r / l) END END AS b FROM p JOIN r USING (doc_id))
SELECT source, lang, round(coalesce(avg(b), 0), 6) AS self_bleu FROM (SELECT DISTINCT source, lang FROM t) LEFT JOIN b USING (source, lang) GROUP BY ALL
""")
def self_bleu_by_group(spark, d):
    out = diversity.self_bleu(read(spark, d, "documents"), ["source", "lang"], "text", "doc_id")
    return out.select("source", "lang", F.round("self_bleu", 6).alias("self_bleu"))


_TITLE = r"regexp_extract(text, '^[^\n]*')"
_BODY = r"regexp_replace(text, '^[^\n]*\n?', '')"


def _titled(spark, d):
    t = F.col("text")
    return read(spark, d, "documents").withColumn("title", F.regexp_extract(t, r"^[^\n]*", 0)).withColumn("body", F.regexp_replace(t, r"^[^\n]*\n?", ""))


def _lengths(name, col, low, high):
    return f"WHEN {_WORDS(col)} < {low} THEN '{name}_too_short' WHEN {_WORDS(col)} > {high} THEN '{name}_too_long'"


_MATH = r"(length(body) - length(translate(body, '$\{}^_=', ''))) / greatest(length(body), 1) > 0.12"
_EMPTY = lambda c: rf"coalesce(NOT regexp_matches({c}, '\S'), true)"
_SHARE = lambda c, p: f"list_sum(list_transform(regexp_extract_all({c}, '{p}'), lambda x: length(x))) / greatest(length({c}), 1)"
_ABSTRACT = f"""
  SELECT doc_id, CASE WHEN {_EMPTY("title")} THEN 'empty_input' WHEN {_EMPTY("body")} THEN 'empty_response' {_lengths("title", "title", 4, 40)}
    {_lengths("abstract", "body", 80, 250)} WHEN {_MATH} THEN 'formula_heavy' END AS reason
  FROM (SELECT doc_id, {_TITLE} AS title, {_BODY} AS body FROM documents)"""


@query(f"SELECT coalesce(reason, 'kept') AS reason, count(*) AS n FROM ({_ABSTRACT}) GROUP BY 1")
def filter_stats_abstract(spark, d):
    return cascade.reason_counts(cascade.with_reason(_titled(spark, d), cascade.abstract_rules(F.col("title"), F.col("body"))))


@query(f"""
WITH a AS ({_ABSTRACT}),
b AS (SELECT *, sum(CASE WHEN reason IS NULL THEN 1 ELSE 0 END) OVER (ORDER BY doc_id) - CASE WHEN reason IS NULL THEN 1 ELSE 0 END AS seen FROM a)
SELECT coalesce(reason, 'kept') AS reason, count(*) AS n FROM b WHERE seen < {KEEP_LIMIT} GROUP BY 1
""")
def limited_keep_stats(spark, d):
    rows = cascade.with_reason(_titled(spark, d), cascade.abstract_rules(F.col("title"), F.col("body"))).select("doc_id", "reason")
    return cascade.reason_counts(cascade.keep_limited(rows, "doc_id", KEEP_LIMIT))


@query(f"""
SELECT coalesce(reason, 'kept') AS reason, count(*) AS n FROM (
  SELECT CASE WHEN {_EMPTY("title")} THEN 'empty_input' WHEN {_EMPTY("body")} THEN 'empty_response' {_lengths("topic", "title", 3, 40)}
    {_lengths("argument", "body", 8, 60)} WHEN coalesce(quality < 0.65, false) THEN 'low_quality' END AS reason
  FROM (SELECT doc_id, {_TITLE} AS title, {_BODY} AS body FROM documents) LEFT JOIN labels USING (doc_id)) GROUP BY 1
""")
def filter_stats_argument(spark, d):
    rows = _titled(spark, d).join(read(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left")
    return cascade.reason_counts(cascade.with_reason(rows, cascade.argument_rules(F.col("title"), F.col("body"), F.col("quality"))))


_ROOT = """
  SELECT conv_id, root_turn, claim, c.turn, c.text AS reply FROM conversations AS c JOIN
    (SELECT conv_id, min(turn) AS root_turn, arg_min(text, turn) AS claim FROM conversations WHERE role = 'user' GROUP BY 1) USING (conv_id)
  WHERE c.role = 'assistant' AND c.turn > root_turn"""


@query(f"SELECT conv_id, root_turn, turn, md5(claim) AS claim, md5(reply) AS reply FROM ({_ROOT})")
def root_reply_pairs(spark, d):
    r = records.root_replies(read(spark, d, "conversations"))
    return r.select("conv_id", "root_turn", "turn", F.md5("claim").alias("claim"), F.md5("reply").alias("reply"))


@query(rf"""
SELECT coalesce(reason, 'kept') AS reason, count(*) AS n FROM (
  SELECT CASE WHEN {_EMPTY("reply")} THEN 'empty_response' WHEN contains(reply, '[deleted]') OR contains(reply, '[removed]') THEN 'deleted_marker'
    {_lengths("response", "reply", 30, 250)} WHEN {_SHARE("reply", r"https?://\S+|www\.\S+")} > 0.4 THEN 'mostly_links' END AS reason
  FROM ({_ROOT}) WHERE {_WORDS("claim")} BETWEEN 20 AND 300 AND NOT contains(claim, '[deleted]') AND NOT contains(claim, '[removed]')) GROUP BY 1
""")
def filter_stats_reply(spark, d):
    rows = records.root_replies(read(spark, d, "conversations")).where(cascade.claim_holds(F.col("claim")))
    return cascade.reason_counts(cascade.with_reason(rows, cascade.reply_rules(F.col("reply"))))


_QA = """
  SELECT q.conv_id, q.turn, q.text AS question, a.text AS answer FROM conversations AS q JOIN conversations AS a ON a.conv_id = q.conv_id AND a.turn = q.turn + 1
  WHERE q.role = 'user' AND a.role = 'assistant'"""
_CODE_SQL = r"```[\s\S]*?```|`[^`\n]+`"


@query(rf"""
SELECT coalesce(reason, 'kept') AS reason, count(*) AS n FROM (
  SELECT CASE WHEN {_EMPTY("question")} THEN 'empty_input' WHEN {_EMPTY("answer")} THEN 'empty_response' {_lengths("question", "question", 20, 500)}
    {_lengths("answer", "answer", 40, 300)} WHEN {_SHARE("answer", _CODE_SQL)} > 0.4 THEN 'mostly_code'
    WHEN {_SHARE("answer", r"https?://\S+|www\.\S+")} > 0.4 THEN 'mostly_links' END AS reason FROM ({_QA})) GROUP BY 1
""")
def filter_stats_answer(spark, d):
    rows = records.question_answers(read(spark, d, "conversations"))
    return cascade.reason_counts(cascade.with_reason(rows, cascade.answer_rules(F.col("question"), F.col("answer"))))


@query(f"""
SELECT conv_id, turn, 3 AS n_messages, sha256('Generate a counter-argument to this claim:' || chr(10) || chr(10) || question) AS user_sha, sha256(answer) AS answer_sha, conv_id::varchar AS source_id FROM ({_QA})
""")
def chat_records(spark, d):
    qa = records.question_answers(read(spark, d, "conversations"))
    persona = F.lit("contrarian")
    cols = records.chat_record(persona, F.lit("You argue the other side."), records.user_prompt(persona, F.col("question")), F.col("answer"), F.lit("conversations"), F.col("conv_id").cast("string"))
    m = F.col("messages")
    return qa.select("conv_id", "turn", *cols).select(
        "conv_id", "turn", F.size(m).alias("n_messages"), F.sha2(records.first_content(m, "user"), 256).alias("user_sha"), F.sha2(records.first_content(m, "assistant"), 256).alias("answer_sha"), F.col("metadata")["source_id"].alias("source_id")
    )


@query(rf"SELECT page_id, round(coalesce({_SHARE('html', r'https?://[^\s]+|www\.[^\s]+')}, 0), 6) AS link_ratio FROM pages")
def link_ratio_pages(spark, d):
    return read(spark, d, "pages").select("page_id", F.round(F.coalesce(T.link_ratio(F.col("html")), F.lit(0.0)), 6).alias("link_ratio"))


@query(rf"""
SELECT doc_id, round(coalesce({_SHARE('text', _CODE_SQL)}, 0), 6) AS code_ratio,
  round((length(text) - length(translate(text, '$\{{}}^_=', ''))) / greatest(length(text), 1), 6) AS formula_ratio FROM documents
""")
def code_formula_ratio(spark, d):
    t = F.col("text")
    return read(spark, d, "documents").select("doc_id", F.round(T.code_ratio(t), 6).alias("code_ratio"), F.round(T.formula_ratio(t), 6).alias("formula_ratio"))


@query(r"""
SELECT doc_id, 'base__' || left(trim(regexp_replace(lower(text), '[^a-z0-9]+', '_', 'g'), '_'), 40) || '__' || doc_id AS output_id FROM documents
""")
def slug_ids(spark, d):
    return read(spark, d, "documents").select("doc_id", F.concat_ws("__", F.lit("base"), T.slug(F.col("text")), F.col("doc_id").cast("string")).alias("output_id"))


@query(r"""
SELECT doc_id, md5('Generate a counter-argument to this claim:' || chr(10) || chr(10) ||
  array_to_string(string_split(regexp_replace(regexp_replace(text, '^\s+|\s+$', '', 'g'), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))[1:2], ' ')) AS claim FROM documents
""")
def truncate_claim(spark, d):
    claim = F.concat(F.lit(T.CLAIM_PREFIX), F.col("text"))
    return read(spark, d, "documents").select("doc_id", F.md5(T.truncate_claim(claim, 2)).alias("claim"))


_E = "e AS (SELECT vec_id, label, embedding::double[] AS v, sqrt(list_dot_product(embedding::double[], embedding::double[])) AS norm FROM embeddings)"


def _units(spark, d):
    e = read(spark, d, "embeddings")
    return V.with_unit(e), V.dimension(e, "embedding")


@query(f"""
WITH {_E} SELECT a.label, count(*) AS n_pairs, round(avg(list_dot_product(a.v, b.v) / a.norm / b.norm), 6) AS cosine
FROM e AS a JOIN e AS b ON a.label = b.label AND a.vec_id < b.vec_id GROUP BY 1
""")
def mean_pairwise_cosine(spark, d):
    u, dim = _units(spark, d)
    g = V.group_sums(u, ["label"], dim).where("n > 1")
    return g.select("label", (F.col("n") * (F.col("n") - 1) / 2).cast("long").alias("n_pairs"), F.round(V.mean_pairwise(F.col("n"), F.col("S"), F.col("q")), 6).alias("cosine"))


@query(f"""
WITH {_E} SELECT a.label AS a, b.label AS b, round(avg(list_dot_product(a.v, b.v) / a.norm / b.norm), 6) AS cosine, 'distinct' AS verdict
FROM e AS a JOIN e AS b ON a.label < b.label GROUP BY 1, 2
""")
def cross_group_cosine_matrix(spark, d):
    u, dim = _units(spark, d)
    m = reports.cross_group_matrix(u, "label", dim)
    return m.select("a", "b", F.round("cosine", 6).alias("cosine"), reports.classify(F.col("cosine")).alias("verdict"))


_EL = """x AS (SELECT e.vec_id, d.source, d.lang, e.embedding::double[] AS v, sqrt(list_dot_product(e.embedding::double[], e.embedding::double[])) AS norm
  FROM embeddings AS e JOIN documents AS d ON d.doc_id = e.vec_id)"""
_CENTROID = """c AS (SELECT source, lang, list(s ORDER BY p) AS s FROM (SELECT source, lang, p, sum(v[p]) AS s FROM x, unnest(range(1, len(v) + 1)) AS u(p) GROUP BY ALL) GROUP BY ALL)"""


def _embedded(spark, d):
    e = read(spark, d, "embeddings").join(read(spark, d, "documents").select("doc_id", "source", "lang"), F.col("vec_id") == F.col("doc_id"))
    return V.with_unit(e).withColumn("v", F.transform("embedding", lambda x: x.cast("double"))), V.dimension(read(spark, d, "embeddings"), "embedding")


@query(f"""
WITH {_EL}, {_CENTROID}
SELECT a.source, count(*) AS n_pairs, round(avg(1 - list_dot_product(a.s, b.s) / sqrt(list_dot_product(a.s, a.s)) / sqrt(list_dot_product(b.s, b.s))), 6) AS distance
FROM c AS a JOIN c AS b ON a.source = b.source AND a.lang < b.lang GROUP BY 1
""")
def centroid_distance(spark, d):
    x, dim = _embedded(spark, d)
    return reports.inter_group_distance(x, ["source"], "lang", dim).select("source", "n_pairs", F.round("distance", 6).alias("distance"))


_INTRA = """(SELECT a.source, a.lang, 1 - avg(list_dot_product(a.v, b.v) / a.norm / b.norm) AS distance FROM x AS a JOIN x AS b ON a.source = b.source AND a.lang = b.lang AND a.vec_id < b.vec_id GROUP BY 1, 2)"""


@query(f"""
WITH {_EL} SELECT lang, count(*) AS n, round(avg(distance), 6) AS mean, round(coalesce(stddev_samp(distance), 0), 6) AS std FROM {_INTRA} GROUP BY 1
""")
def intra_group_dispersion(spark, d):
    x, dim = _embedded(spark, d)
    s = stats.summarise(reports.intra_group_distance(x, ["source", "lang"], dim), ["lang"], "distance")
    return s.select("lang", "n", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


@query(f"""
WITH {_EL}, {_CENTROID},
i AS (SELECT a.source, avg(1 - list_dot_product(a.s, b.s) / sqrt(list_dot_product(a.s, a.s)) / sqrt(list_dot_product(b.s, b.s))) AS x FROM c AS a JOIN c AS b ON a.source = b.source AND a.lang < b.lang GROUP BY 1),
y AS (SELECT source, distance AS y FROM {_INTRA} WHERE lang = 'en')
SELECT count(*) AS n, round(avg(x) / avg(y), 6) AS ratio_of_means, round(avg(x / y), 6) AS mean_of_ratios, round(avg(x - y), 6) AS mean_difference FROM i JOIN y USING (source) WHERE y > 1e-9
""")
def dispersion_ratio(spark, d):
    x, dim = _embedded(spark, d)
    inter = reports.inter_group_distance(x, ["source"], "lang", dim).select("source", F.col("distance").alias("x"))
    base = reports.intra_group_distance(x.where(F.col("lang") == "en"), ["source"], dim).select("source", F.col("distance").alias("y")).where("y > 1e-9")
    j = inter.join(base, "source")
    return j.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("x") / F.avg("y"), 6).alias("ratio_of_means"), F.round(F.avg(F.col("x") / F.col("y")), 6).alias("mean_of_ratios"), F.round(F.avg(F.col("x") - F.col("y")), 6).alias("mean_difference"))


@query(f"""
WITH {_E},
m AS (SELECT a.vec_id, a.label, b.label AS other, sum(1 - list_dot_product(a.v, b.v) / a.norm / b.norm) / count(*) AS dist FROM e AS a JOIN e AS b ON a.vec_id <> b.vec_id GROUP BY 1, 2, 3),
s AS (SELECT vec_id, label, max(CASE WHEN other = label THEN dist END) AS a, min(CASE WHEN other <> label THEN dist END) AS b FROM m GROUP BY 1, 2)
SELECT label, count(*) AS n, round(avg((b - a) / greatest(a, b)), 6) AS silhouette FROM s WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY 1
""")
def silhouette_by_label(spark, d):
    u, dim = _units(spark, d)
    return reports.silhouette(u, "label", dim).groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("silhouette"), 6).alias("silhouette"))


_RARE = lambda on: f"""SELECT a.vec_id, round(greatest(0, 1 - coalesce(avg(list_dot_product(a.v, b.v) / a.norm / b.norm), 0)), 6) AS rarity
FROM x AS a LEFT JOIN x AS b ON {on} AND a.vec_id <> b.vec_id GROUP BY a.vec_id"""  # noqa: E731


@query(f"WITH {_EL} {_RARE('a.source = b.source AND a.lang = b.lang')}")
def rarity_within(spark, d):
    return pairs.with_rarity(_embedded(spark, d)[0].drop("u"), ["source", "lang"]).select("vec_id", F.round("rarity", 6).alias("rarity"))


@query(f"WITH {_EL} {_RARE('a.source = b.source')}")
def rarity_cross(spark, d):
    return pairs.with_rarity(_embedded(spark, d)[0].drop("u"), ["source"]).select("vec_id", F.round("rarity", 6).alias("rarity"))


_QUALITY = rf"""{REPS},
q AS (SELECT doc_id, source, lang, text, {_WORDS("text")} AS n, greatest(0, 1 - 0.25 * coalesce(reps, 0)) AS c FROM documents LEFT JOIN reps USING (doc_id)),
ql AS (SELECT *, CASE WHEN n < 10 OR n > 400 THEN 0 ELSE 0.6 * c + 0.4 * CASE WHEN n <= 100 THEN n / 100 ELSE 100 / n END END AS quality FROM q)"""


@query(f"WITH {_QUALITY} SELECT doc_id, round(quality, 6) AS quality FROM ql")
def quality_v2(spark, d):
    return read(spark, d, "documents").select("doc_id", F.round(pairs.quality(F.col("text")), 6).alias("quality"))


@query("""
SELECT doc_id, round(CASE WHEN count(*) OVER w < 2 OR max(n_chars) OVER w - min(n_chars) OVER w < 1e-9 THEN 1
  ELSE (n_chars - min(n_chars) OVER w) / (max(n_chars) OVER w - min(n_chars) OVER w) END, 6) AS score FROM documents WINDOW w AS (PARTITION BY source, lang)
""")
def pool_minmax(spark, d):
    return pairs.with_minmax(read(spark, d, "documents"), "n_chars", ["source", "lang"]).select("doc_id", F.round("score", 6).alias("score"))


def _pairs_sql(pool, floor, wq, wr):
    return f"""
WITH {_EL}, {_QUALITY},
ra AS (SELECT a.vec_id, greatest(0, 1 - coalesce(avg(list_dot_product(a.v, b.v) / a.norm / b.norm), 0)) AS rarity FROM x AS a LEFT JOIN x AS b ON {pool} AND a.vec_id <> b.vec_id GROUP BY 1),
k AS (SELECT ql.*, rarity, round({wq} * quality + {wr} * rarity, 9) AS combined FROM ql JOIN ra ON vec_id = doc_id WHERE quality >= {floor}),
o AS (SELECT *, count(*) OVER (PARTITION BY source, lang) AS m, row_number() OVER (PARTITION BY source, lang ORDER BY combined DESC, doc_id) AS hi, row_number() OVER (PARTITION BY source, lang ORDER BY combined, doc_id) AS lo FROM k)
SELECT c.source, c.lang, c.doc_id AS chosen, r.doc_id AS rejected, round(c.combined, 6) AS chosen_score, round(r.combined, 6) AS rejected_score
FROM o AS c JOIN o AS r ON c.source = r.source AND c.lang = r.lang AND c.hi = 1 AND r.lo = 1
WHERE c.m >= 2 AND c.text <> r.text AND round(c.rarity - r.rarity, 9) >= 0"""


def _preference(spark, d, pool, floor, wq, wr):
    x = _embedded(spark, d)[0].drop("u", "v").join(read(spark, d, "documents").select("doc_id", "text"), "doc_id")
    scored = pairs.with_rarity(x, pool).withColumn("quality", pairs.quality(F.col("text")))
    p = pairs.select_pairs(scored, ["source", "lang"], "doc_id", floor, wq, wr)
    return p.select("source", "lang", F.col("chosen.doc_id").alias("chosen"), F.col("rejected.doc_id").alias("rejected"), F.round("chosen.combined", 6).alias("chosen_score"), F.round("rejected.combined", 6).alias("rejected_score"))


@query(_pairs_sql("a.source = b.source AND a.lang = b.lang", 0.35, 0.4, 0.6))
def preference_pairs_v1(spark, d):
    return _preference(spark, d, ["source", "lang"], 0.35, 0.4, 0.6)


@query(_pairs_sql("a.source = b.source", 0.40, 0.5, 0.5))
def preference_pairs_v2(spark, d):
    return _preference(spark, d, ["source"], 0.40, 0.5, 0.5)


@query(f"""
WITH {_E}, s AS (SELECT a.vec_id AS id, b.vec_id AS ref_id, round(list_dot_product(a.v, b.v) / a.norm / b.norm, 9) AS sim FROM e AS a JOIN e AS b ON a.label <> {REFERENCE_LABEL} AND b.label = {REFERENCE_LABEL})
SELECT id, rank, ref_id, round(sim, 6) AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY sim DESC, ref_id) AS rank FROM s) WHERE rank <= 3
""")
def topk_references(spark, d):
    return _nearest(spark, d, 3).select("id", F.col("rank").cast("long").alias("rank"), "ref_id", F.round("similarity", 6).alias("similarity"))


def _nearest(spark, d, k):
    u, _ = _units(spark, d)
    left = u.where(F.col("label") != REFERENCE_LABEL).select(F.col("vec_id").alias("id"), "u")
    return reports.nearest(left, u.where(F.col("label") == REFERENCE_LABEL).select(F.col("vec_id").alias("ref_id"), F.col("u").alias("ru")), k)


@query(f"""
WITH {_E}, s AS (SELECT a.label, a.vec_id, 1 - max(list_dot_product(a.v, b.v) / a.norm / b.norm) AS nov FROM e AS a JOIN e AS b ON a.label <> {REFERENCE_LABEL} AND b.label = {REFERENCE_LABEL} GROUP BY 1, 2)
SELECT label, round(avg(nov), 6) AS mean_novelty, round(min(nov), 6) AS min_novelty FROM s GROUP BY 1
""")
def corpus_novelty(spark, d):
    n = _nearest(spark, d, 1).join(read(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label"), "id").withColumn("nov", 1 - F.col("similarity"))
    return n.groupBy("label").agg(F.round(F.avg("nov"), 6).alias("mean_novelty"), F.round(F.min("nov"), 6).alias("min_novelty"))


@query("SELECT event_id, (props::json->>'$.k')::double AS k FROM events")
def judge_parse(spark, d):
    wrapped = F.concat(F.lit("Here it is:\n```json\n"), F.col("props"), F.lit("\n```"))
    return read(spark, d, "events").select("event_id", judge.number(judge.parse_object(wrapped), "k").alias("k"))


@query("""
SELECT event_type, round(avg(((props::json->>'$.k')::double + value) / 2), 6) AS quality, count(*) AS n FROM events GROUP BY 1
""")
def judge_means(spark, d):
    e = read(spark, d, "events").withColumn("q", judge.mean_of(judge.number(judge.parse_object(F.col("props")), "k"), F.col("value"), judge.number(judge.parse_object(F.col("props")), "absent")))
    return e.where("q is not null").groupBy("event_type").agg(F.round(F.avg("q"), 6).alias("quality"), F.count(F.lit(1)).alias("n"))


_PEERS = """SELECT a.doc_id, coalesce(list(b.doc_id ORDER BY b.doc_id) FILTER (b.doc_id IS NOT NULL), []) [1:3] AS peers FROM documents AS a LEFT JOIN documents AS b ON a.source = b.source AND a.lang = b.lang AND a.doc_id <> b.doc_id GROUP BY 1"""


@query(f"SELECT doc_id, array_to_string(peers, ',') AS peers FROM ({_PEERS})")
def peers_first3(spark, d):
    p = records.peers(read(spark, d, "documents").select("doc_id", "source", "lang", F.col("doc_id").cast("string").alias("s")), ["source", "lang"], "doc_id", "s")
    return p.select("doc_id", F.array_join("peers", ",").alias("peers"))


@query("""
SELECT item_id, sha256('Rate this answer from 1 to 5.' || chr(10) || 'Question: ' || text || chr(10) || 'Answer: ' || text || chr(10) || 'Others:' || chr(10) || '1. ' || text || chr(10) || '2. second') AS sha FROM benchmark
""")
def rubric_render_hash(spark, d):
    t = F.col("text")
    text = judge.render(RUBRIC, prompt=t, output=t, peers=judge.numbered_peers(F.array(t, F.lit("second"))))
    return read(spark, d, "benchmark").select("item_id", F.sha2(text, 256).alias("sha"))


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)")
def cache_misses(spark, d):
    return judge.cache_misses(read(spark, d, "documents").select("doc_id"), read(spark, d, "labels"), ["doc_id"])


_SIGNAL = " OR ".join("contains(lower(text), '{}')".format(s.replace("'", "''")) for s in dims.COUNTER_SIGNALS)


@query(rf"""
SELECT doc_id, n AS word_count, sig AS has_counter_signal, n >= 10 AS is_long_enough, fin AS is_not_truncated, n >= 10 AND sig AND fin AND full_ AS passes_gate
FROM (SELECT doc_id, {_WORDS("text")} AS n, {_SIGNAL} AS sig, regexp_matches(text, '[.!?"'']\s*$') AS fin, regexp_matches(text, '\S') AS full_ FROM documents)
""")
def counter_gate(spark, d):
    cols = judge.gate(F.col("text"))
    return read(spark, d, "documents").select("doc_id", cols[0].cast("long").alias("word_count"), *cols[1:-1])


@query("""
SELECT event_type, count(value) AS n, round(avg(value), 6) AS mean, round(coalesce(stddev_samp(value), 0), 6) AS std FROM events GROUP BY 1
""")
def summarise_metrics(spark, d):
    s = stats.summarise(read(spark, d, "events"), ["event_type"])
    return s.select("event_type", "n", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


RESAMPLES = 1000
_DIFF = """
o AS (SELECT event_type AS method, user_id AS prompt, avg(value) AS value FROM events GROUP BY 1, 2),
ref AS (SELECT min(event_type) AS m FROM events),
dd AS (SELECT b.method, a.prompt, a.value - b.value AS diff FROM o AS a JOIN ref ON a.method = ref.m JOIN o AS b ON a.prompt = b.prompt AND b.method <> a.method)"""
_BOOT = rf"""
{_DIFF},
packed AS (SELECT method, list(diff ORDER BY prompt) AS d FROM dd GROUP BY 1),
res AS (SELECT method, r, round(sum(d[(('0x' || substr(md5(r || ':' || k), 1, 8))::ubigint % len(d) + 1)::int]) / len(any_value(d)), 9) AS m
  FROM packed, unnest(range(0, {RESAMPLES})) AS a(r), unnest(range(0, len(d))) AS b(k) GROUP BY 1, 2),
boot AS (SELECT method, 1 - avg(CASE WHEN m > 0 THEN 1.0 ELSE 0 END) AS p_value, 1 - avg(CASE WHEN m < 0 THEN 1.0 ELSE 0 END) AS p_loss FROM res GROUP BY 1),
base AS (SELECT method, avg(diff) AS mean_diff, CASE WHEN stddev_samp(diff) <= 1e-9 THEN 0 ELSE avg(diff) / stddev_samp(diff) END AS effect_size, count(*) AS n FROM dd GROUP BY 1)"""


def _bootstrap(spark, d):
    e = read(spark, d, "events")
    obs = e.groupBy(F.col("event_type").alias("method"), F.col("user_id").alias("prompt")).agg(F.avg("value").alias("value")).withColumn("metric", F.lit("value"))
    reference = e.agg(F.min("event_type")).first()[0]
    specs = spark.createDataFrame([("value", False)], "metric string, lower_is_better boolean")
    return stats.bootstrap(stats.paired_differences(obs, reference, specs), RESAMPLES)


@query(f"""
WITH {_BOOT} SELECT method, n, round(mean_diff, 6) AS mean_diff, round(p_value, 6) AS p_value, round(p_loss, 6) AS p_loss, round(effect_size, 6) AS effect_size FROM base JOIN boot USING (method)
""")
def paired_bootstrap(spark, d):
    b = _bootstrap(spark, d)
    return b.select("method", "n", *[F.round(c, 6).alias(c) for c in ("mean_diff", "p_value", "p_loss", "effect_size")])


@query(f"""
WITH {_BOOT} SELECT method, CASE WHEN mean_diff > 0 AND p_value < 0.05 THEN 'value' ELSE '' END AS better,
  CASE WHEN mean_diff < 0 AND p_value < 0.05 THEN 'value' ELSE '' END AS worse_reference, CASE WHEN mean_diff < 0 AND p_loss < 0.05 THEN 'value' ELSE '' END AS worse FROM base JOIN boot USING (method)
""")
def significance_verdicts(spark, d):
    return reports.verdicts(_bootstrap(spark, d))


@query("""
WITH r AS (SELECT lang, rank() OVER (PARTITION BY lang ORDER BY n_chars) + (count(*) OVER (PARTITION BY lang, n_chars) - 1) / 2 AS x,
  rank() OVER (PARTITION BY lang ORDER BY quality) + (count(*) OVER (PARTITION BY lang, quality) - 1) / 2 AS y FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL),
s AS (SELECT lang, count(*) AS n, CASE WHEN stddev_pop(x) > 0 AND stddev_pop(y) > 0 THEN corr(x, y) END AS rho FROM r GROUP BY 1)
SELECT lang, n, round(rho, 6) AS rho, CASE WHEN n < 3 THEN 'insufficient' WHEN rho >= 0.8 THEN 'strong' WHEN rho >= 0.7 THEN 'good' WHEN rho >= 0.6 THEN 'moderate' ELSE 'weak' END AS interpretation FROM s
""")
def spearman(spark, d):
    j = read(spark, d, "documents").join(read(spark, d, "labels").select("doc_id", "quality"), "doc_id")
    return stats.spearman(j, "n_chars", "quality", ["lang"]).select("lang", "n", F.round("rho", 6).alias("rho"), "interpretation")


@query(rf"""
WITH {_EL}, i AS (SELECT a.lang, 1 - avg(list_dot_product(a.v, b.v) / a.norm / b.norm) AS distance FROM x AS a JOIN x AS b ON a.lang = b.lang AND a.vec_id < b.vec_id GROUP BY 1),
t AS (SELECT lang, {_TOK} AS w FROM documents),
g AS (SELECT lang, count(DISTINCT g) / count(*) AS d1 FROM (SELECT lang, unnest(w) AS g FROM t) GROUP BY 1),
q AS (SELECT lang, count(*) AS n, round(avg(quality), 6) AS quality, count(quality) AS n_quality FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1)
SELECT lang, n, round(d1, 6) AS distinct_1, round(1 - distance, 6) AS cosine, round(distance, 6) AS distance, quality, n_quality FROM q LEFT JOIN g USING (lang) LEFT JOIN i USING (lang)
""")
def persona_breakdown(spark, d):
    docs = read(spark, d, "documents")
    x, dim = _embedded(spark, d)
    intra = reports.intra_group_distance(x, ["lang"], dim).select("lang", F.round(1 - F.col("distance"), 6).alias("cosine"), F.round("distance", 6).alias("distance"))
    grams = diversity.distinct_n(docs, ["lang"], "text", (1,)).select("lang", F.round("distinct_1", 6).alias("distinct_1"))
    q = docs.join(read(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left").groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("quality"), 6).alias("quality"), F.count("quality").alias("n_quality"))
    return q.join(grams, "lang", "left").join(intra, "lang", "left")


@query("""
SELECT event_type AS method, round(avg(value), 6) AS quality, round(avg(user_id), 6) AS novelty FROM events GROUP BY 1
""")
def baseline_table_pivot(spark, d):
    e = read(spark, d, "events").select(F.col("event_type").alias("method"), F.explode(F.create_map(F.lit("quality"), F.col("value"), F.lit("novelty"), F.col("user_id").cast("double"))).alias("metric", "value"))
    p = reports.pivot_metrics(stats.summarise(e, ["method", "metric"]), ["quality", "novelty"])
    return p.select("method", F.round("quality", 6).alias("quality"), F.round("novelty", 6).alias("novelty"))


@query(f"""
WITH m AS (SELECT unnest({dims.METHODS}) AS method), p AS (SELECT unnest({dims.PERSONAS}) AS persona)
SELECT method, item_id, persona, 0 AS sample FROM m, p, benchmark WHERE method NOT IN ('base', 'single_lora')
UNION ALL SELECT method, item_id, NULL, s::int FROM m, benchmark, unnest(range(0, 4)) AS u(s) WHERE method IN ('base', 'single_lora')
""")
def work_plan(spark, d):
    each = [F.struct(F.lit(m).alias("method"), F.lit(p).cast("string").alias("persona"), F.lit(s).cast("int").alias("sample")) for m in dims.METHODS for p, s in ([(None, k) for k in range(4)] if m in ("base", "single_lora") else [(p, 0) for p in dims.PERSONAS])]
    return read(spark, d, "benchmark").select("item_id", F.explode(F.array(*each)).alias("w")).select("w.method", "item_id", "w.persona", "w.sample")


_KEYWORDS = {"contrarian": ["the", "not", "but"], "systems_thinker": ["of", "in", "que"], "cross_domain_analogist": ["der", "die", "und"], "minimalist": ["le", "de", "a"]}


@query(f"""
WITH k AS (SELECT * FROM (VALUES {", ".join(f"('{p}', {w})" for p, w in _KEYWORDS.items())}) AS t(persona, words)),
h AS (SELECT doc_id, persona, len(list_filter({_TOK}, lambda x: list_contains(words, x))) AS hits FROM documents, k)
SELECT doc_id, persona, hits FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY hits DESC, persona) AS rn FROM h) WHERE rn <= 2
""")
def keyword_gate_topk(spark, d):
    def _hits(words):
        return F.size(F.filter("_t", lambda x: x.isin(words)))

    tok = T.tokens(F.col("text"))
    hits = F.array(*[F.struct((-_hits(w)).alias("h"), F.lit(p).alias("persona")) for p, w in _KEYWORDS.items()])
    top = read(spark, d, "documents").withColumn("_t", tok).select("doc_id", F.explode(F.slice(F.array_sort(hits), 1, 2)).alias("x"))
    return top.select("doc_id", F.col("x.persona").alias("persona"), (-F.col("x.h")).cast("long").alias("hits"))


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
