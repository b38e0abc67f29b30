"""More queries: lexical rarity, routing, corpus reports and selections.

Routing, lexical rarity, word overlap, the older pair rule, passages and parse flags are
known from descriptions only; their ties and edges are ours, and their docstrings say so.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from loomline.functions import dims
from loomline.functions import text as T
from loomline.functions import vectors as V
from loomline.operators import cascade, corpus, embedding, judge, lexical, pairs, records, routing, stats
from loomline.plans.registry import query, read
from loomline.sources.scratch import files_of

_TOK = r"regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+')"
_WORDS = lambda c: rf"len(regexp_extract_all(coalesce({c}, ''), '\S+'))"
_SHARED = r"""
t AS (SELECT doc_id, source, lang, regexp_extract_all(lower(coalesce(text, '')), '\S+') AS w FROM documents),
tw AS (SELECT doc_id, source, lang, w, count(*) AS tf FROM (SELECT doc_id, source, lang, unnest(w) AS w FROM t) GROUP BY ALL),
m AS (SELECT source, lang, w, count(*) AS m FROM tw GROUP BY ALL),
sh AS (SELECT doc_id, avg(CASE WHEN m > 1 THEN 1.0 ELSE 0 END) AS distinct_share, sum(CASE WHEN m > 1 THEN tf ELSE 0 END) / sum(tf) AS word_share FROM tw JOIN m USING (source, lang, w) GROUP BY 1)"""


@query(rf"""
WITH {_SHARED}, d AS (SELECT doc_id, source, lang, coalesce(len(list_distinct({_TOK})) / nullif(len({_TOK}), 0), 0) AS d1 FROM documents),
r AS (SELECT doc_id, source, lang, greatest(0, d1 - coalesce(distinct_share, 0)) AS raw FROM d LEFT JOIN sh USING (doc_id))
SELECT doc_id, round(CASE WHEN max(raw) OVER (PARTITION BY source, lang) > 0 THEN raw / max(raw) OVER (PARTITION BY source, lang) ELSE 0 END, 6) AS rarity FROM r
""")
def lexical_rarity(spark, d):
    return lexical.lexical_rarity(read(spark, d, "documents"), ["source", "lang"], "text", "doc_id").select("doc_id", F.round("rarity", 6).alias("rarity"))


@query(f"WITH {_SHARED} SELECT source, lang, round(avg(coalesce(word_share, 0)), 6) AS overlap FROM t LEFT JOIN sh USING (doc_id) GROUP BY 1, 2")
def overlap_self_bleu(spark, d):
    o = lexical.overlap_self_bleu(read(spark, d, "documents"), ["source", "lang"], "text", "doc_id")
    return o.select("source", "lang", F.round("overlap", 6).alias("overlap"))


@query(rf"""
WITH g AS (SELECT lang, w[i] || ' ' || w[i + 1] AS gram, count(*) AS n FROM (SELECT lang, {_TOK} AS w FROM documents), unnest(range(1, len(w))) AS u(i) GROUP BY 1, 2)
SELECT lang, gram, n FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, gram) AS rn FROM g) WHERE rn <= 20
""")
def ngram_top_counts(spark, d):
    from pyspark.sql import Window

    docs = read(spark, d, "documents").select("lang", T.tokens(F.coalesce("text", F.lit(""))).alias("_t"))
    g = docs.select("lang", F.explode(T.ngrams(F.col("_t"), 2)).alias("gram")).groupBy("lang", "gram").agg(F.count(F.lit(1)).alias("n"))
    rn = F.row_number().over(Window.partitionBy("lang").orderBy(F.col("n").desc(), "gram"))
    return g.withColumn("rn", rn).where("rn <= 20").drop("rn")


@query("SELECT count(*) AS n_rows, count(DISTINCT conv_id) AS conversations, count(DISTINCT role) AS speakers FROM conversations")
def corpus_profile(spark, d):
    return corpus.profile(read(spark, d, "conversations"), conversations="conv_id", speakers="role")


@query(rf"""
WITH u AS (SELECT q.conv_id, q.text AS question, a.text AS answer FROM conversations AS q JOIN conversations AS a ON q.conv_id = a.conv_id AND q.role = 'user' AND a.role = 'assistant' AND a.turn = q.turn + 1)
SELECT count(*) AS total_records, round(coalesce(avg({_WORDS("question")}), 0), 1) AS avg_prompt_words, round(coalesce(avg({_WORDS("answer")}), 0), 1) AS avg_response_words FROM u
""")
def dataset_summary(spark, d):
    s = corpus.dataset_summary(records.question_answers(read(spark, d, "conversations")), [], "question", "answer")
    return s.select("total_records", "avg_prompt_words", "avg_response_words")


def _candidates(spark, d):
    """Documents with a quality from their labels and a rarity from their length."""
    docs = read(spark, d, "documents").join(read(spark, d, "labels").select("doc_id", F.col("quality").cast("double").alias("quality")), "doc_id")
    return docs.select("doc_id", "source", "lang", "text", F.coalesce("quality", F.lit(0.0)).alias("quality"), ((F.coalesce("n_chars", F.lit(0)) % 97) / 97.0).alias("rarity"))


_CAND = """c AS (SELECT doc_id, source, lang, text, coalesce(quality, 0)::double AS quality, (coalesce(n_chars, 0) % 97) / 97.0::double AS rarity FROM documents JOIN labels USING (doc_id)),
s AS (SELECT *, round(0.4 * quality + 0.6 * rarity, 9) AS combined, quality >= 0.35 AS fit FROM c)"""


@query(f"""
WITH {_CAND},
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source, lang ORDER BY combined DESC, doc_id) AS rn FROM s WHERE fit) WHERE rn = 1),
r AS (SELECT s.*, b.doc_id AS chosen, row_number() OVER (PARTITION BY s.source, s.lang ORDER BY s.fit, s.combined, s.doc_id) AS lo FROM s JOIN b ON s.source = b.source AND s.lang = b.lang AND s.doc_id <> b.doc_id)
SELECT source, lang, chosen, doc_id AS rejected FROM r WHERE lo = 1
""")
def preference_pairs_older_rule(spark, d):
    p = pairs.select_pairs_any(_candidates(spark, d), ["source", "lang"], "doc_id", 0.35, 0.4, 0.6)
    return p.select("source", "lang", F.col("chosen.doc_id").alias("chosen"), F.col("rejected.doc_id").alias("rejected"))


@query(f"""
WITH {_CAND},
k AS (SELECT *, count(*) OVER (PARTITION BY source, lang) AS m, row_number() OVER (PARTITION BY source, lang ORDER BY combined DESC, doc_id) AS hi, row_number() OVER (PARTITION BY source, lang ORDER BY combined, doc_id) AS lo FROM s WHERE fit),
p AS (SELECT c.source, c.lang, round(c.quality, 4) AS q, round(c.rarity, 4) AS r FROM k AS c JOIN k AS j ON c.source = j.source AND c.lang = j.lang AND c.hi = 1 AND j.lo = 1 WHERE c.m >= 2 AND c.text <> j.text AND round(c.rarity - j.rarity, 9) >= 0),
g AS (SELECT DISTINCT source, lang FROM c)
SELECT lang, count(q) AS total_pairs, count(*) FILTER (q IS NULL) AS total_skipped, round(coalesce(avg(q), 0), 6) AS avg_chosen_quality, round(coalesce(avg(r), 0), 6) AS avg_chosen_rarity FROM g LEFT JOIN p USING (source, lang) GROUP BY 1
""")
def pair_summary(spark, d):
    c = _candidates(spark, d)
    p = pairs.select_pairs(c, ["source", "lang"], "doc_id", 0.35, 0.4, 0.6).select("source", "lang", "chosen.quality", "chosen.rarity")
    s = corpus.pair_summary(c, p, ["source", "lang"], ["lang"])
    return s.select("lang", "total_pairs", F.col("total_skipped").cast("long").alias("total_skipped"), *[F.round(x, 6).alias(x) for x in ("avg_chosen_quality", "avg_chosen_rarity")])


@query(rf"""
WITH f AS (SELECT doc_id, toxic * 10 AS score, regexp_matches(text, '(?i)[Δ∆]|delta') AS mark FROM documents LEFT JOIN labels USING (doc_id) WHERE {_WORDS("text")} BETWEEN 20 AND 300),
a AS (SELECT doc_id FROM f WHERE coalesce(mark, false) OR coalesce(score > 0, false))
SELECT doc_id FROM a UNION ALL SELECT doc_id FROM f WHERE score > 5 AND (SELECT count(*) FROM a) < 100
""")
def delta_references(spark, d):
    docs = read(spark, d, "documents").join(read(spark, d, "labels").select("doc_id", (F.col("toxic") * 10).alias("score")), "doc_id", "left")
    return corpus.delta_references(docs.select("doc_id", "text", "score"), "text", "score").select("doc_id")


@query("SELECT item_id, md5(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) AS question FROM benchmark")
def question_extract(spark, d):
    wrapped = F.concat(F.lit("Here.\nQuestion:\n"), F.col("text"), F.lit("\n\nNow provide an answer."))
    return read(spark, d, "benchmark").select("item_id", F.md5(corpus.question_of(wrapped)).alias("question"))


@query("SELECT doc_id, source FROM documents WHERE source IN (SELECT DISTINCT source FROM documents ORDER BY 1 LIMIT 5)")
def selected_prompts(spark, d):
    return corpus.first_prompts(read(spark, d, "documents"), "source", 5).select("doc_id", "source")


@query("""
SELECT source, lang FROM (SELECT DISTINCT source FROM documents), (SELECT DISTINCT lang FROM documents)
EXCEPT SELECT source, lang FROM documents JOIN labels USING (doc_id) WHERE toxic = 1
""")
def missing_combinations(spark, d):
    docs = read(spark, d, "documents").select("doc_id", "source", "lang")
    langs = docs.select("lang").distinct()  # a dimension: languages
    have = docs.join(read(spark, d, "labels").where("toxic = 1").select("doc_id"), "doc_id", "left_semi")
    required = docs.select("source").distinct().join(F.broadcast(langs), how="cross")
    return corpus.missing(required, have, ["source", "lang"])


@query("""
SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY md5('0:' || doc_id), doc_id) AS rn, count(*) OVER () AS n FROM labels) WHERE rn <= greatest(10, floor(n * 0.1))
""")
def calibration_sample(spark, d):
    return corpus.calibration_sample(read(spark, d, "labels").select("doc_id"), "doc_id")


@query("SELECT event_type, first, row_number() OVER (ORDER BY first) AS rank FROM (SELECT event_type, min(event_id) AS first FROM events GROUP BY 1)")
def method_order(spark, d):
    f = corpus.first_appearance(read(spark, d, "events"), "event_type", "event_id")
    return f.withColumn("rank", F.col("rank").cast("long"))


@query("""
WITH a AS (SELECT lang AS method, 'quality' AS metric, avg(n_chars) AS mean FROM documents GROUP BY 1 UNION ALL SELECT lang, 'length', avg(n_chars) FROM documents GROUP BY 1),
j AS (SELECT lang AS method, 'quality' AS metric, avg(quality) AS mean FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL GROUP BY 1)
SELECT method, metric, round(coalesce(j.mean, a.mean), 6) AS mean FROM a FULL JOIN j USING (method, metric)
""")
def merged_metrics(spark, d):
    docs = read(spark, d, "documents")
    obs = docs.select(F.col("lang").alias("method"), F.explode(F.array(F.lit("quality"), F.lit("length"))).alias("metric"), F.col("n_chars").cast("double").alias("value"))
    marks = docs.select("doc_id", F.col("lang").alias("method")).join(read(spark, d, "labels").select("doc_id", F.col("quality").cast("double").alias("value")), "doc_id")
    judged = stats.summarise(marks.withColumn("metric", F.lit("quality")), ["method", "metric"])
    return corpus.merge_metrics(stats.summarise(obs, ["method", "metric"]), judged).withColumn("mean", F.round("mean", 6))


@query(r"""
WITH g AS (SELECT lang, len(regexp_extract_all(text, '\S+')) >= 10 AS ok, regexp_matches(text, '[.!?"'']\s*$') AS fin, {signal} AS sig FROM documents)
SELECT lang, count(*) AS n, count(*) FILTER (ok AND fin AND sig) AS n_pass, round(count(*) FILTER (ok AND fin AND sig) / count(*), 6) AS pass_rate FROM g GROUP BY 1
""".replace("{signal}", "(" + " OR ".join("contains(lower(text), '{}')".format(s.replace("'", "''")) for s in dims.COUNTER_SIGNALS) + ")"))
def gate_pass_rate(spark, d):
    g = read(spark, d, "documents").select("lang", *judge.gate(F.col("text")))
    ok = F.count(F.when(F.col("passes_gate"), 1))
    return g.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), ok.alias("n_pass"), F.round(ok / F.count(F.lit(1)), 6).alias("pass_rate"))


_VEC = "e AS (SELECT vec_id, label, embedding::double[] AS v, sqrt(list_dot_product(embedding::double[], embedding::double[])) AS norm FROM embeddings)"


@query(f"""
WITH {_VEC}, p AS (SELECT label, arg_min(v, vec_id) AS pv, arg_min(norm, vec_id) AS pn FROM e GROUP BY 1)
SELECT e.label, round(avg(list_dot_product(v, pv) / norm / pn), 6) AS proxy FROM e JOIN p USING (label) GROUP BY 1
""")
def quality_proxy(spark, d):
    """Mean cosine of outputs with their prompt; a label's first vector is its prompt."""
    u = V.with_unit(read(spark, d, "embeddings"))
    p = u.groupBy("label").agg(F.min_by("u", "vec_id").alias("pu"))
    return u.join(p, "label").groupBy("label").agg(F.round(F.avg(V.dot(F.col("u"), F.col("pu"))), 6).alias("proxy"))


_GATE_LABELS = 4


@query(f"""
WITH {_VEC}, p AS (SELECT label::varchar AS persona, arg_min(v, vec_id) AS pv, arg_min(norm, vec_id) AS pn FROM e WHERE label < {_GATE_LABELS} GROUP BY 1),
s AS (SELECT vec_id, persona, round(list_dot_product(v, pv) / norm / pn, 9) AS score FROM e, p)
SELECT vec_id, persona, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, persona) AS rn FROM s) WHERE rn <= 2
""")
def embedding_gate_topk(spark, d):
    """A label's first vector describes one of four personas."""
    e = read(spark, d, "embeddings")
    first = e.where(F.col("label") < _GATE_LABELS).groupBy("label").agg(F.min_by("embedding", "vec_id").alias("v"))
    described = {str(r["label"]): list(r["v"]) for r in first.collect()}  # four rows
    ranked = routing.top(routing.vector_scores(F.col("u"), described), 2)
    return V.with_unit(e).select("vec_id", F.explode(ranked).alias("x")).select("vec_id", "x.persona", F.round("x.score", 6).alias("score"))


@query(f"""
WITH s AS (SELECT doc_id, persona, round(('0x' || substr(md5('0:' || doc_id || ':' || persona), 1, 8))::ubigint / 4294967296, 9) AS score FROM documents, (SELECT unnest({dims.PERSONAS}) AS persona))
SELECT doc_id, persona, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, persona) AS rn FROM s) WHERE rn <= 2
""")
def random_gate_topk(spark, d):
    ranked = routing.top(routing.random_scores(F.col("doc_id"), dims.PERSONAS), 2)
    return read(spark, d, "documents").select("doc_id", F.explode(ranked).alias("x")).select("doc_id", "x.persona", F.round("x.score", 6).alias("score"))


_KEYS = {"contrarian": ["the", "but"], "minimalist": ["of", "le"], "systems_thinker": ["in", "der"]}
_MARGIN = 0.05


@query(rf"""
WITH RECURSIVE t AS (SELECT conv_id, turn, {_TOK} AS w, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn FROM conversations),
s AS (SELECT conv_id, turn, rn, [{", ".join(f"round(coalesce(len(list_filter(w, lambda x: list_contains({k}, x))) / nullif(len(w), 0), 0), 9)" for k in _KEYS.values())}] AS sc FROM t),
b AS (SELECT *, list_position(sc, list_max(sc)) AS best FROM s),
r AS (SELECT conv_id, turn, rn, best AS now FROM b WHERE rn = 1
  UNION ALL SELECT b.conv_id, b.turn, b.rn, CASE WHEN round(b.sc[b.best] - b.sc[r.now], 9) > {_MARGIN} THEN b.best ELSE r.now END FROM r JOIN b ON b.conv_id = r.conv_id AND b.rn = r.rn + 1)
SELECT conv_id, turn, ({list(_KEYS)})[now] AS persona FROM r
""")
def hysteresis_route(spark, d):
    c = read(spark, d, "conversations").select("conv_id", "turn", "text")
    n = F.nullif(F.size(T.tokens(F.coalesce("text", F.lit("")))), F.lit(0))
    scores = {p: h / n for p, h in routing.keyword_scores(F.col("text"), _KEYS).items()}
    return routing.hysteresis(c, "conv_id", "turn", scores, _MARGIN)


@query("""
WITH p AS (SELECT item_id, text FROM benchmark WHERE length(text) >= 80)
SELECT item_id, persona, md5(prompt || text) AS prompt FROM p, (VALUES {values}) AS v(persona, prompt)
""".replace("{values}", ", ".join(f"('{p}', '{dims.USER_TEMPLATES[p]}')" for p in ("systems_thinker", "cross_domain_analogist"))))
def passage_records(spark, d):
    """Passages of 80 characters or more, each a record for two personas."""
    each = F.array(*[F.struct(F.lit(p).alias("persona"), F.md5(F.concat(F.lit(dims.USER_TEMPLATES[p]), F.col("text"))).alias("prompt")) for p in ("systems_thinker", "cross_domain_analogist")])
    return read(spark, d, "benchmark").where(F.length("text") >= 80).select("item_id", F.explode(each).alias("x")).select("item_id", "x.*")


@query("SELECT event_type, count(*) AS n, count(*) FILTER (event_id % 3 > 0 AND json_valid(props)) AS n_parsed FROM events GROUP BY 1")
def parse_success(spark, d):
    """Of every three outputs one is cut after its first character, and doesn't parse."""
    raw = F.when(F.col("event_id") % 3 == 0, F.left("props", F.lit(1))).otherwise(F.col("props"))
    e = read(spark, d, "events").select("event_type", judge.parse_object(raw).isNotNull().alias("parse_success"))
    return e.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("parse_success"), 1)).alias("n_parsed"))


_DIM = 8


@query(f"""
WITH h AS (SELECT doc_id, lang, text, range(0, {_DIM}) AS ks FROM documents),
v AS (SELECT doc_id, lang, CASE WHEN text IS NOT NULL THEN list_transform(ks, lambda k: ('0x' || substr(md5(k || ':' || text), 1, 8))::ubigint / 2147483648.0::double - 1) END AS v FROM h)
SELECT doc_id, round(v[1], 6) AS first, round(v[{_DIM}], 6) AS last, round(sqrt(list_dot_product(v, v)), 6) AS norm FROM v
""")
def embedded_texts(spark, d):
    """Vectors of whole texts by the hook, with an embedder that any engine can follow."""
    e = embedding.embed(read(spark, d, "documents").select("doc_id", "text"), embedding.hash_embedder(_DIM), _DIM)
    v = F.col("embedding")
    return e.select("doc_id", F.round(v[0], 6).alias("first"), F.round(v[_DIM - 1], 6).alias("last"), F.round(F.sqrt(V.dot(v, v)), 6).alias("norm"))


@query(f"""
WITH c AS (SELECT DISTINCT source, lang, doc_id, text FROM documents WHERE text IS NOT NULL AND length(text) < 600),
e AS (SELECT source, lang, doc_id, list_transform(range(0, {_DIM}), lambda k: ('0x' || substr(md5(k || ':' || text), 1, 8))::ubigint / 2147483648.0::double - 1) AS v FROM c),
p AS (SELECT a.source, a.lang, avg(list_dot_product(a.v, b.v) / sqrt(list_dot_product(a.v, a.v)) / sqrt(list_dot_product(b.v, b.v))) AS cosine FROM e AS a JOIN e AS b ON a.source = b.source AND a.lang = b.lang AND a.doc_id <> b.doc_id GROUP BY 1, 2)
SELECT source, lang, count(*) AS n, round(coalesce(any_value(cosine), 0), 6) AS cosine FROM e LEFT JOIN p USING (source, lang) GROUP BY 1, 2
""")
def embedded_cosine(spark, d):
    """Raw texts to mean pairwise cosines of groups: the hook, then the closed form."""
    short = read(spark, d, "documents").where("text is not null and length(text) < 600").select("source", "lang", "doc_id", "text").distinct()
    u = V.with_unit(embedding.embed(short, embedding.hash_embedder(_DIM), _DIM))
    g = V.group_sums(u, ["source", "lang"], _DIM)
    return g.select("source", "lang", "n", F.round(V.mean_pairwise(F.col("n"), F.col("S"), F.col("q")), 6).alias("cosine"))


_EARLY = 200


@query(f"""
WITH a AS (SELECT doc_id, row_number() OVER () AS place, CASE WHEN {_WORDS("text")} < 80 THEN 'text_too_short' WHEN {_WORDS("text")} > 250 THEN 'text_too_long' END AS reason FROM documents),
b AS (SELECT *, sum((reason IS NULL)::int) OVER (ORDER BY place) - (reason IS NULL)::int AS seen FROM a)
SELECT doc_id, reason FROM b WHERE seen < {_EARLY}
""")
def early_stop_rows(spark, d):
    """Documents in file order up to the 200th of 80 to 250 words; later files aren't read."""
    n = T.n_words(F.col("text"))
    rules = [("text_too_short", n < 80), ("text_too_long", n > 250)]
    files = files_of(spark, f"{d}/documents.parquet", ".parquet")
    rows, _ = cascade.keep_first(spark, files, lambda some: spark.read.parquet(*some), rules, _EARLY)
    return rows.select("doc_id", "reason")
