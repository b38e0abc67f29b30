"""Persona diversity of generations, as one long table, and its markdown and CSV forms.

Generations: method, prompt, persona (may be null), u (unit vector), v (vector), and a key.
The table: method, section, key, mean, std, n; a section's summary has a null key.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomline.functions import dims
from loomline.functions import vectors as V
from loomline.operators import reports
from loomline.operators.metrics import persona_order

#: Key of rows whose persona is null.
NO_PERSONA = "none"


def inter_pairs(gen: DataFrame, dim: int) -> DataFrame:
    """method, prompt, a, b, distance: centroids of two personas under one prompt; a stands
    before b in the canonical order."""
    by = ["method", "prompt"]
    s = gen.where(F.col("persona").isNotNull()).groupBy(*by, "persona").agg(V.vector_sum("v", dim).alias("S"))
    s = s.withColumn("o", F.struct(persona_order(F.col("persona")), F.col("persona")))
    a, b = (s.select(*by, F.col("persona").alias(x), F.col("o").alias(f"o{x}"), F.col("S").alias(f"S{x}")) for x in "ab")
    return a.join(b, by).where("oa < ob").select(*by, "a", "b", V.centroid_distance(F.col("Sa"), F.col("Sb")).alias("distance"))


def _distances(gen: DataFrame, by: list[str], dim: int) -> DataFrame:
    """1 - mean pairwise cosine of groups of two at least; a null persona is a group."""
    named = gen.withColumn("persona", F.coalesce("persona", F.lit(NO_PERSONA)))
    return reports.intra_group_distance(named, by, dim)


def _stat(df: DataFrame, section: str, by: list[str], value: str, key: Column) -> DataFrame:
    v = F.col(value)
    g = df.where(v.isNotNull()).groupBy(*by).agg(F.avg(v).alias("mean"), F.coalesce(F.stddev_samp(v), F.lit(0.0)).alias("std"), F.count(v).alias("n"))
    return g.select("method", F.lit(section).alias("section"), key.cast("string").alias("key"), "mean", "std", "n")


def persona_diversity(gen: DataFrame, dim: int, key: str, base: str = "base") -> DataFrame:
    """All sections. A method of which a section has nothing gets (null, null, 0) there."""
    none, method = F.lit(None), ["method"]
    methods = gen.select("method").distinct()
    pair = inter_pairs(gen, dim)
    inter = pair.groupBy("method", "prompt").agg(F.avg("distance").alias("distance"))
    intra = _distances(gen, ["method", "prompt", "persona"], dim)
    cross = _distances(gen.where(F.col("persona").isNotNull()), ["method", "persona"], dim)
    sampled = intra.where(F.col("method") == base).groupBy("prompt").agg(F.max_by("distance", "persona").alias("y")).where("y > 1e-9")
    matched = inter.join(sampled, "prompt").select("method", F.col("distance").alias("x"), "y")
    matched = matched.withColumn("ratio", F.col("x") / F.col("y")).withColumn("difference", F.col("x") - F.col("y"))
    ratio = matched.groupBy("method").agg((F.avg("x") / F.avg("y")).alias("mean"), F.lit(0.0).alias("std"), F.count(F.lit(1)).alias("n"))
    near = reports.silhouette(gen.where(F.col("persona").isNotNull()), "persona", dim, by=("method",), key=key)
    summaries = {
        "inter": _stat(inter, "inter", method, "distance", none),
        "intra": _stat(intra, "intra", method, "distance", none),
        "cross_prompt": _stat(cross, "cross_prompt", method, "distance", none),
        "ratio": ratio.select("method", F.lit("ratio").alias("section"), none.cast("string").alias("key"), "mean", "std", "n"),
        "paired_ratio": _stat(matched, "paired_ratio", method, "ratio", none),
        "difference": _stat(matched, "difference", method, "difference", none),
        "silhouette": _stat(near, "silhouette", method, "silhouette", none),
    }
    full = methods.crossJoin(F.broadcast(gen.sparkSession.createDataFrame([(x,) for x in summaries], "section string")))  # seven rows a method
    summary = full.join(reduce(DataFrame.unionByName, summaries.values()), ["method", "section"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return reduce(
        DataFrame.unionByName,
        [
            summary.select("method", "section", "key", "mean", "std", "n"),
            _stat(pair, "inter_pair", ["method", "a", "b"], "distance", F.concat_ws("__", "a", "b")),
            _stat(intra, "intra_persona", ["method", "persona"], "distance", F.col("persona")),
            _stat(cross, "cross_prompt_persona", ["method", "persona"], "distance", F.col("persona")),
            _stat(near, "silhouette_persona", ["method", "persona"], "silhouette", F.col("persona")),
        ],
    )


#: Columns of the CSV forms after run and method, by section and statistic.
CSV_COLUMNS = [
    ("inter_mean", "inter", "mean"), ("inter_std", "inter", "std"), ("inter_n", "inter", "n"), ("base_ratio_mean", "ratio", "mean"), ("base_diff_mean", "difference", "mean"),
    ("same_prompt_intra_mean", "intra", "mean"), ("same_prompt_intra_n", "intra", "n"), ("cross_prompt_dispersion_mean", "cross_prompt", "mean"), ("silhouette_mean", "silhouette", "mean"), ("silhouette_n", "silhouette", "n"),
]
COMPARED = ["inter_mean", "base_ratio_mean", "same_prompt_intra_mean", "cross_prompt_dispersion_mean", "silhouette_mean"]


def wide(report: DataFrame) -> DataFrame:
    """One row a method: the CSV's columns, and whether same-prompt figures are available."""
    at = lambda section, s: F.max(F.when((F.col("section") == section) & F.col("key").isNull(), F.col(s)))
    out = report.groupBy("method").agg(*[at(section, s).alias(name) for name, section, s in CSV_COLUMNS], at("intra", "std").alias("same_prompt_intra_std"), at("cross_prompt", "std").alias("cross_prompt_dispersion_std"), at("cross_prompt", "n").alias("cross_prompt_dispersion_n"), at("silhouette", "std").alias("silhouette_std"))
    return out.withColumn("available", F.col("same_prompt_intra_n") > 0)


def _cell(value, digits: int) -> str:
    if value is None:
        return "" if digits == 6 else "—"
    return f"{value:.{digits}f}" if isinstance(value, float) else str(value)


def report_csv(rows: DataFrame, run: str, compare: bool = False) -> str:
    """rows: wide(). Means with six decimals, empty where there is none."""
    names = COMPARED if compare else [c for c, _, _ in CSV_COLUMNS]
    lines = [",".join(["run", "method", *names])]
    lines += [",".join([r["run"] if "run" in r else run, r["method"], *[_cell(r[c], 6) for c in names]]) for r in rows.orderBy(*(["run"] if "run" in rows.columns else []), "method").collect()]
    return "\n".join(lines) + "\n"


def _table(head: list[str], rows: list[list[str]]) -> list[str]:
    return ["| " + " | ".join(head) + " |", "|" + "---|" * len(head), *["| " + " | ".join(r) + " |" for r in rows], ""]


#: What a reader of the report must know.
CAVEAT = "Groups of one output have no distance, and persona comparisons are only controlled for the prompt in the first two tables."


def report_markdown(rows: DataFrame, run: str) -> str:
    """Four tables, a row a method. rows: wide()."""
    got = rows.orderBy("method").collect()
    cells = lambda *names: [[r["method"], *[_cell(r[c], 3) for c in names]] for r in got]
    out = [f"# Persona diversity: {run}", "", "Distances are 1 - cosine.", "", f"**Caveat:** {CAVEAT}", "", "## Between personas, same prompt", ""]
    out += _table(["Method", "Mean ↑", "Std", "Prompts", "Over base sampling ↑", "Minus base sampling ↑"], cells("inter_mean", "inter_std", "inter_n", "base_ratio_mean", "base_diff_mean"))
    out += ["## Within a persona, same prompt", ""]
    out += _table(["Method", "Mean ↑", "Std", "Groups", "Available"], [[*c, "yes" if r["available"] else "no"] for c, r in zip(cells("same_prompt_intra_mean", "same_prompt_intra_std", "same_prompt_intra_n"), got, strict=True)])
    out += ["## Within a persona, across prompts (confounded by prompts)", ""]
    out += _table(["Method", "Mean ↑", "Std", "Personas"], cells("cross_prompt_dispersion_mean", "cross_prompt_dispersion_std", "cross_prompt_dispersion_n"))
    out += ["## Silhouette by persona (not prompt-controlled)", ""]
    return "\n".join(out + _table(["Method", "Mean ↑", "Std", "Outputs"], cells("silhouette_mean", "silhouette_std", "silhouette_n")))


def comparison_markdown(rows: DataFrame) -> str:
    """Several runs (column run) in one table."""
    got = rows.orderBy("run", "method").collect()
    head = ["Run", "Method", "Between personas ↑", "Over base sampling ↑", "Same prompt ↑", "Across prompts ↑", "Silhouette ↑"]
    return "\n".join(["# Persona diversity of runs", "", *_table(head, [[r["run"], r["method"], *[_cell(r[c], 3) for c in COMPARED]] for r in got])])


def distinctness(df: DataFrame, group: str, prompt: list[str], dim: int) -> DataFrame:
    """a, b, cosine, verdict of all ordered pairs of groups: mean over prompts of the mean cosine
    of their cross pairs under the same prompt; 0 where no prompt has both; 1 of a group with
    itself; rounded to 4. df has u."""
    s = V.group_sums(df.where(F.col(group).isNotNull()), [*prompt, group], dim)
    a, b = (s.select(*prompt, F.col(group).alias(x), F.col("n").alias(f"n{x}"), F.col("S").alias(f"S{x}")) for x in "ab")
    each = a.join(b, prompt).where("a <> b").select("a", "b", (V.dot(F.col("Sa"), F.col("Sb")) / (F.col("na") * F.col("nb"))).alias("c"))
    names = s.select(F.col(group).alias("a")).distinct()
    pairs = names.join(names.select(F.col("a").alias("b")), how="cross")  # groups by groups: the matrix itself
    value = F.when(F.col("a") == F.col("b"), F.lit(1.0)).otherwise(F.coalesce(F.round("cosine", 4), F.lit(0.0)))
    out = pairs.join(each.groupBy("a", "b").agg(F.avg("c").alias("cosine")), ["a", "b"], "left").select("a", "b", value.alias("cosine"))
    return out.withColumn("verdict", F.when(F.col("a") < F.col("b"), reports.classify(F.col("cosine"))))


def distinctness_verdict(matrix: DataFrame) -> DataFrame:
    """One row: pairs, how many are under the bound of distinct ones, and over that of
    collapsed ones; "pass" if some are distinct and none has collapsed, else "review"; and the
    stricter rule, all_distinct: there are pairs and all are under the bound of distinct ones."""
    own = matrix.where("a < b")
    count = lambda c: F.coalesce(F.sum(c.cast("int")), F.lit(0))
    g = own.agg(F.count(F.lit(1)).alias("n_pairs"), count(F.col("cosine") < dims.DISTINCT_BELOW).alias("n_distinct"), count(F.col("cosine") > dims.BORDERLINE_BELOW).alias("n_collapsed"))
    return g.select("*", F.when((F.col("n_distinct") >= 1) & (F.col("n_collapsed") == 0), "pass").otherwise("review").alias("verdict"), ((F.col("n_pairs") > 0) & (F.col("n_distinct") == F.col("n_pairs"))).alias("all_distinct"))


def pair_findings(matrix: DataFrame) -> DataFrame:
    """The pairs (a < b), the most alike first; ties by name."""
    return matrix.where("a < b").orderBy(F.col("cosine").desc(), "a", "b")


def distinctness_json(matrix: DataFrame, records: DataFrame | None = None, most: int = 10_000) -> str:
    """The matrix, its findings and their verdict as one document (groups are few), with the
    records it was made from, if given; more than `most` records are an error."""
    cells: dict[str, dict[str, float]] = {}
    for r in matrix.orderBy("a", "b").collect():
        cells.setdefault(r["a"], {})[r["b"]] = r["cosine"]
    found = [{"pair": [r["a"], r["b"]], "cosine": r["cosine"], "label": r["verdict"]} for r in pair_findings(matrix).collect()]
    out = {"matrix": cells, "pair_findings": found, **distinctness_verdict(matrix).first().asDict()}
    if records is not None:
        got = [r.asDict(recursive=True) for r in records.limit(most + 1).collect()]
        if len(got) > most:
            raise ValueError(f"more than {most} records; write them as a table")
        out |= {"total_outputs": len(got), "records": got}
    return json.dumps(out, ensure_ascii=False, indent=2, default=str)
