"""Reports: diversity by persona, metric tables, matrices, verdict lists."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomline.functions import dims
from loomline.functions import vectors as V
from loomline.functions.joins import null_join
from loomline.operators import metrics, neighbours, stats


def cross_group_matrix(df: DataFrame, group: str, dim: int) -> DataFrame:
    """Mean cosine of all cross pairs of two groups (a < b), from group sums. df has u."""
    s = V.group_sums(df, [group], dim)
    a, b = (s.select(F.col(group).alias(x), F.col("n").alias(f"n{x}"), F.col("S").alias(f"S{x}")) for x in "ab")
    return a.join(b, F.col("a") < F.col("b")).select("a", "b", (V.dot(F.col("Sa"), F.col("Sb")) / (F.col("na") * F.col("nb"))).alias("cosine"))


def inter_group_distance(df: DataFrame, prompt: list[str], group: str, dim: int) -> DataFrame:
    """Per prompt the mean centroid distance over pairs of groups. df has v (raw vectors)."""
    s = df.groupBy(*prompt, group).agg(V.vector_sum("v", dim).alias("S"))
    a, b = (s.select(*prompt, F.col(group).alias(x), F.col("S").alias(f"S{x}")) for x in "ab")
    pairs = a.join(b, prompt).where("a < b")
    return pairs.groupBy(*prompt).agg(F.avg(V.centroid_distance(F.col("Sa"), F.col("Sb"))).alias("distance"), F.count(F.lit(1)).alias("n_pairs"))


def intra_group_distance(df: DataFrame, by: list[str], dim: int) -> DataFrame:
    """1 - mean pairwise cosine of groups of at least two. df has u."""
    g = V.group_sums(df, by, dim).where("n >= 2")
    return g.select(*by, "n", (1 - V.mean_pairwise(F.col("n"), F.col("S"), F.col("q"))).alias("distance"))


def silhouette(df: DataFrame, label: str, dim: int, by: tuple[str, ...] = (), key: str = "vec_id") -> DataFrame:
    """Cosine silhouette of each point from label sums, within `by`; singletons are left out, and
    so are null labels. Columns: by, label, key, silhouette. df has u and a unique key.

    A point's mean distance to a label is one less its product with the label's mean vector, so
    its nearest other label is one of its two nearest mean vectors: an exact search, in which a
    point meets only the blocks of labels that can be nearest, however many labels there are.
    """
    df = df.where(F.col(label).isNotNull())
    g = F.to_json(F.struct(*by)) if by else F.lit("")
    s = V.group_sums(df, [*by, label], dim)
    means = s.select(g.alias("g"), F.col(label).alias("ref_id"), F.transform("S", lambda x: x / F.col("n")).alias("ru"))
    near, _ = neighbours.search(df.select(F.col(key).alias("id"), "u", g.alias("g")), means, 2, by=True)
    own = F.col("u")
    points = null_join(df.select(*by, label, key, "u"), s.select(*by, label, "n", "S"), [*by, label])
    a = 1 - (V.dot(own, F.col("S")) - V.dot(own, own)) / F.nullif(F.col("n") - 1, F.lit(0))
    rows = points.select(*by, label, key, a.alias("_a")).join(near.select(F.col("id").alias(key), "ref_id", "similarity"), key)
    other = F.min(F.when(F.col("ref_id") != F.col(label), 1 - F.col("similarity")))
    g = rows.groupBy(*by, label, key).agg(F.max("_a").alias("_a"), other.alias("_n")).where("_a is not null and _n is not null and greatest(_a, _n) > 1e-9")
    return g.select(*by, label, key, ((F.col("_n") - F.col("_a")) / F.greatest("_a", "_n")).alias("silhouette"))


def nearest(left: DataFrame, right: DataFrame, k: int) -> DataFrame:
    """The k rows of `right` (ref_id, ru) most similar to each of `left` (id, u): id, rank,
    ref_id, similarity; equal ones by ref_id. Edges and bounds as neighbours.search() says."""
    return neighbours.search(left, right, k)[0]


def classify(value: Column) -> Column:
    return F.when(value < dims.DISTINCT_BELOW, "distinct").when(value < dims.BORDERLINE_BELOW, "borderline").otherwise("mode-collapsed")


def pivot_metrics(summary: DataFrame, metrics: list[str]) -> DataFrame:
    """One row a method, one column a metric's mean."""
    return summary.groupBy("method").pivot("metric", metrics).agg(F.first("mean"))


def markdown_table(summary: DataFrame, methods: list[str]) -> str:
    """Metric table: metrics that any method has, an arrow by direction, 3 decimals."""
    rows = {(r["method"], r["metric"]): r["mean"] for r in summary.collect()}
    shown = [(m, name, low) for m, name, low in dims.METRICS if any((x, m) in rows for x in methods)]
    head = "| Method | " + " | ".join(f"{name} {'↓' if low else '↑'}" for _, name, low in shown) + " |"
    lines = [head, "|---" * (len(shown) + 1) + "|"]
    for x in methods:
        cells = [f"{rows[x, m]:.3f}" if rows.get((x, m)) is not None else "—" for m, _, _ in shown]
        lines.append(f"| {x} | " + " | ".join(cells) + " |")
    return "\n".join(lines)


def csv_table(summary: DataFrame, methods: list[str]) -> str:
    rows = {(r["method"], r["metric"]): r["mean"] for r in summary.collect()}
    shown = [m for m, _, _ in dims.METRICS if any((x, m) in rows for x in methods)]
    lines = [",".join(["method", *shown])]
    lines += [",".join([x, *[f"{rows[x, m]:.4f}" if rows.get((x, m)) is not None else "" for m in shown]]) for x in methods]
    return "\n".join(lines)


def verdicts(tests: DataFrame, alpha: float = 0.05) -> DataFrame:
    """By method the metrics on which the reference is significantly better, or worse.

    worse_reference asks for a negative difference and a small one-sided p, which a clear
    loss never has; worse uses the p of the other side.
    """
    pick = lambda c: F.array_join(F.array_sort(F.collect_list(F.when(c, F.col("metric")))), ",")
    better = (F.col("mean_diff") > 0) & (F.col("p_value") < alpha)
    return tests.groupBy("method").agg(
        pick(better).alias("better"),
        pick((F.col("mean_diff") < 0) & (F.col("p_value") < alpha)).alias("worse_reference"),
        pick((F.col("mean_diff") < 0) & (F.col("p_loss") < alpha)).alias("worse"),
    )


def significance_markdown(tests: DataFrame, reference: str) -> str:
    """Reference against each method: difference, stars by p, and a line of verdicts.

    tests: metric, method, mean_diff, p_value; as many rows as methods times metrics.
    """
    rows = {(r["method"], r["metric"]): r for r in tests.collect()}
    shown = [(m, name, low) for m, name, low in dims.METRICS if any(k[1] == m for k in rows)]
    lines = ["| Comparison | " + " | ".join(f"{name}{'↓' if low else '↑'}" for _, name, low in shown) + " |", "|" + "---|" * (len(shown) + 1)]
    told = []
    for x in sorted({k[0] for k in rows}):
        got = [(name, rows.get((x, m))) for m, name, _ in shown]
        stars = lambda p: "**" if p < 0.01 else "*" if p < 0.05 else ""
        cells = [f"{r['mean_diff']:+.3f}{stars(r['p_value'])} (p={r['p_value']:.3f})" if r else "—" for _, r in got]
        lines.append(f"| {reference} vs {x} | " + " | ".join(cells) + " |")
        good, bad = ([name for name, r in got if r and s * r["mean_diff"] > 0 and r["p_value"] < 0.05] for s in (1, -1))
        told.append(f"- **vs {x}**: better on {len(good)} ({', '.join(good) or 'none'}); worse on {len(bad)} ({', '.join(bad) or 'none'})")
    return "\n".join([*lines, "", *told])


def breakdown_csv(rows: DataFrame) -> str:
    """rows: metrics.breakdown(), of one run or several; 17 columns, in the report's order."""
    names = ["run", "method", "persona", "n_outputs", "self_bleu", "distinct_1", "distinct_2", "sbert_cosine", "sbert_distance", "quality", "novelty", "utility", "persona_fidelity", "quality_n", "novelty_n", "utility_n", "persona_fidelity_n"]
    lines = [",".join(names)]
    lines += [",".join("" if r[c] is None else str(r[c]) for c in names) for r in rows.orderBy(*metrics.report_order()).collect()]
    return "\n".join(lines) + "\n"


def breakdown_markdown(rows: DataFrame) -> str:
    head = ["Run", "Method", "Persona", "n", "Self-BLEU↓", "Distinct-1↑", "Distinct-2↑", "SBERT-cos↓", "Quality↑", "Novelty↑", "Utility↑", "Fidelity↑"]
    names = ["self_bleu", "distinct_1", "distinct_2", "sbert_cosine", "quality", "novelty", "utility", "persona_fidelity"]
    lines = ["# Diversity and quality by persona", "", "| " + " | ".join(head) + " |", "|" + "---|" * len(head)]
    for r in rows.orderBy(*metrics.report_order()).collect():
        lines.append("| " + " | ".join([r["run"], r["method"], r["persona"], str(r["n_outputs"]), *["—" if r[c] is None else f"{r[c]:.3f}" for c in names]]) + " |")
    return "\n".join(lines) + "\n"


def score_markdown(scores: DataFrame, methods: list[str], value: str = "score") -> str:
    """A method a row, in the methods' order, 4 decimals."""
    got = {r["method"]: r for r in stats.score_table(scores, methods, value).collect()}
    cell = lambda x: "—" if x is None else f"{x:.4f}"
    return "\n".join(["| Method | Mean | Std | n |", "|---|---|---|---|", *[f"| {m} | {cell(got[m]['mean'])} | {cell(got[m]['std'])} | {got[m]['n']} |" for m in methods if m in got]]) + "\n"


def significance_json(tests: DataFrame, reference: str, resamples: int | None = None, summary: DataFrame | None = None) -> str:
    """The comparisons as one document, with n_resamples and, by method and metric, the summary
    (method, metric, mean, std, n), if given."""
    out = {"reference": reference, "comparisons": [r.asDict() for r in tests.orderBy("method", "metric").collect()]}
    if resamples is not None:
        out["n_resamples"] = resamples
    if summary is not None:
        cells: dict[str, dict] = {}
        for r in summary.orderBy("method", "metric").collect():
            cells.setdefault(r["method"], {})[r["metric"]] = {c: r[c] for c in ("mean", "std", "n")}
        out["summary"] = cells
    return json.dumps(out, ensure_ascii=False, indent=2)


def append_pair_examples(records: DataFrame, order: str, title: str, path: str, n: int = 3) -> None:
    """The first n pair records (prompt, chosen, rejected, metadata), as markdown, appended."""
    parts = [f"\n# {title}\n"]
    for k, r in enumerate(records.orderBy(order).limit(n).collect(), 1):
        m = r["metadata"]
        parts += [f"\n## {k}\n\n**prompt:**\n```\n{r['prompt']}\n```\n"]
        parts += [f"\n**{s}** (quality {m[f'{s}_quality']:.4f}, rarity {m[f'{s}_rarity']:.4f}):\n```\n{r[s]}\n```\n" for s in ("chosen", "rejected")]
    with open(path, "a", encoding="utf-8") as f:
        f.write("".join(parts))


def append_examples(rows: DataFrame, order: str, title: str, path: str, n: int = 3) -> None:
    """The first n records' messages, as markdown at the end of a file on the driver."""
    parts = [f"\n# {title}\n"]
    for k, r in enumerate(rows.orderBy(order).limit(n).collect(), 1):
        parts += [f"\n## {k}\n", *[f"\n**{m['role']}:**\n```\n{m['content']}\n```\n" for m in r["messages"]]]
    with open(path, "a", encoding="utf-8") as f:
        f.write("".join(parts))
