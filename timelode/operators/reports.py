"""Result tables: means, missing combinations, pivots, buckets, intervals, curves."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from timelode.operators.ranks import ranked

#: Task groups and their tasks.
TASK_GROUPS = {
    "operational_outcomes": ["guo_los", "guo_readmission", "guo_icu", "mimic4_los", "mimic4_mortality", "mimic4_readmission"],
    "lab_values": ["lab_thrombocytopenia", "lab_hyperkalemia", "lab_hypoglycemia", "lab_hyponatremia", "lab_anemia"],
    "new_diagnoses": ["new_hypertension", "new_hyperlipidemia", "new_pancan", "new_celiac", "new_lupus", "new_acutemi"],
    "chexpert": ["chexpert"],
}

#: Names of tasks and task groups in print.
PAPER_NAMES = {
    "guo_los": "Long LOS",
    "guo_readmission": "30-day Readmission",
    "guo_icu": "ICU Admission",
    "new_pancan": "Pancreatic Cancer",
    "new_celiac": "Celiac",
    "new_lupus": "Lupus",
    "new_acutemi": "Acute MI",
    "new_hypertension": "Hypertension",
    "new_hyperlipidemia": "Hyperlipidemia",
    "lab_thrombocytopenia": "Thrombocytopenia",
    "lab_hyperkalemia": "Hyperkalemia",
    "lab_hypoglycemia": "Hypoglycemia",
    "lab_hyponatremia": "Hyponatremia",
    "lab_anemia": "Anemia",
    "chexpert": "Chest X-ray Findings",
    "mimic4_los": "Long LOS (MIMIC-IV)",
    "mimic4_readmission": "30-day Readmission (MIMIC-IV)",
    "mimic4_mortality": "Inpatient Mortality (MIMIC-IV)",
}
GROUP_NAMES = {
    "operational_outcomes": "Operational Outcomes",
    "lab_values": "Anticipating Lab Test Results",
    "new_diagnoses": "Assignment of New Diagnoses",
    "chexpert": "Anticipating Chest X-ray Findings",
}


def looked_up(names: dict[str, str], key: Column) -> Column:
    """The name of a key, or the key itself where there is none."""
    return F.coalesce(F.create_map(*(F.lit(x) for pair in names.items() for x in pair))[key], key)


def in_print(df: DataFrame, task: str = "labeling_function", groups: dict[str, list[str]] = TASK_GROUPS) -> DataFrame:
    """df with task_name, task_group, group_name, and task_order: the place of a task in the order of the groups; tasks of no group come last."""
    of_group = {t: g for g, tasks in groups.items() for t in tasks}
    place = {t: i for i, t in enumerate(of_group)}
    group = F.create_map(*(F.lit(x) for pair in of_group.items() for x in pair))[F.col(task)]
    order = F.coalesce(F.create_map(*(F.lit(x) for pair in place.items() for x in pair))[F.col(task)], F.lit(len(place)))
    return df.withColumns({"task_name": looked_up(PAPER_NAMES, F.col(task)), "task_group": group, "group_name": looked_up(GROUP_NAMES, group), "task_order": order})


def matching(df: DataFrame, score: str | None = None, labeling_function: str | None = None, task_group: str | None = None, sub_tasks: list[str] | None = None, model_heads: list[tuple[str, str]] | None = None, groups: dict[str, list[str]] = TASK_GROUPS, ks: list[int] | None = None) -> DataFrame:
    """Rows that meet all filters given; groups names the tasks of each task group."""
    tests: list[Column] = []
    if score is not None:
        tests.append(F.col("score") == score)
    if labeling_function is not None:
        tests.append(F.col("labeling_function") == labeling_function)
    if task_group is not None:
        tests.append(F.col("labeling_function").isin(groups[task_group]))
    if sub_tasks is not None:
        tests.append(F.col("sub_task").isin(sub_tasks))
    if ks is not None:
        tests.append(F.col("k").isin(ks))
    if model_heads is not None:
        tests.append(reduce(lambda a, b: a | b, ((F.col("model") == m) & (F.col("head") == h) for m, h in model_heads), F.lit(False)))
    return reduce(lambda d, t: d.filter(t), tests, df)


def mean_std(results: DataFrame, keys: tuple[str, ...] = ("labeling_function", "sub_task", "model", "head", "score", "k")) -> DataFrame:
    """Mean and sample deviation of value over replicates; a lone replicate has deviation 0."""
    return results.groupBy(*keys).agg(F.avg("value").alias("mean_value"), F.coalesce(F.stddev_samp("value"), F.lit(0.0)).alias("std_value"))


def mean_over_tasks(means: DataFrame) -> DataFrame:
    """Mean of task means by model, head, score and k."""
    return means.groupBy("model", "head", "score", "k").agg(F.avg("mean_value").alias("mean_value"))


def pivoted(means: DataFrame, ks: list[int]) -> DataFrame:
    """One row for each task, model and head, one column for each k, as `mean ± std`."""
    cell = F.format_string("%.3f ± %.3f", "mean_value", "std_value")
    out = means.withColumn("cell", cell).groupBy("sub_task", "model", "head", "score").pivot("k", ks).agg(F.first("cell"))
    return out.select("sub_task", "model", "head", "score", *(F.col(f"`{k}`").alias("k_all" if k == -1 else f"k_{k}") for k in ks))


def missing_combinations(results: DataFrame, model_heads: DataFrame | None = None) -> DataFrame:
    """(labeling_function, sub_task, model, head, k) that some rows of the axes call for and no result has."""
    tasks = results.select("labeling_function", "sub_task").distinct()
    pairs = (results if model_heads is None else model_heads).select("model", "head").distinct()
    every = tasks.crossJoin(pairs).crossJoin(results.select("k").distinct())
    return every.join(results, every.columns, "left_anti")


def counts_by_prefix(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Row counts by each prefix of columns; what a prefix leaves out is null, and level tells its length."""
    level = F.length(F.regexp_replace(F.bin(F.lit(2 ** len(columns) - 1) - F.grouping_id()), "0", "")).cast("int")
    return rows.rollup(*columns).agg(F.count(F.lit(1)).alias("n"), level.alias("level")).filter("level > 0")


def grouped_interval(scores: DataFrame, chars: int = 4) -> DataFrame:
    """Mean score with a 95 % interval by the first letters of the task: the deviation of a mean of independent scores."""
    rows = scores.groupBy(F.substring("sub_task", 1, chars).alias("task_prefix"), "model", "head", "score")
    deviation = F.sqrt(F.sum(F.col("std") * F.col("std"))) / F.count(F.lit(1))
    out = rows.agg(F.avg("value").alias("estimate"), deviation.alias("deviation"))
    return out.withColumns({"low": F.col("estimate") - 1.96 * F.col("deviation"), "high": F.col("estimate") + 1.96 * F.col("deviation")})


def last_by(results: DataFrame, order: str, keys: tuple[str, ...] = ("score", "sub_task", "model", "head")) -> DataFrame:
    """The last row of each key at k = -1."""
    row = F.max_by(F.struct("value", "std"), order)
    return results.filter("k = -1").groupBy(*keys).agg(row.alias("r")).select(*keys, "r.value", "r.std")


def best_replicate(results: DataFrame, keys: list[str]) -> DataFrame:
    """The replicate of the greatest value for each key, the first of equals."""
    best = F.max_by(F.struct("replicate", "value"), F.struct(F.col("value"), -F.col("replicate")))
    return results.groupBy(*keys).agg(best.alias("b")).select(*keys, "b.replicate", "b.value")


def buckets(rows: DataFrame, metric: str, n: int, ident: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """rows with bucket 0..n-1 of their rank by metric: quantile edges on ranks 1..count, so that each rank is cut as linear interpolation cuts it."""
    rank, count = F.col("_rn"), F.col("_all")
    bucket = F.when(count > 1, F.greatest(F.lit(0), F.ceil(rank * n / (count - 1)) - 1)).otherwise(F.lit(0))
    return ranked(rows, [metric, ident], keys, "_rn", "_all").withColumn("bucket", bucket.cast("int")).drop("_rn", "_all")


def brier_by_bucket(rows: DataFrame) -> DataFrame:
    return rows.groupBy("bucket").agg(F.avg(F.pow(F.col("pred") - F.col("y"), 2)).alias("brier"), F.count(F.lit(1)).alias("n"))


def ema(rows: DataFrame, keys: list[str], order: str, value: str, span: int = 10) -> DataFrame:
    """Exponential moving average along order, of weight 2 / (span + 1), started at the first value; linear in a run's steps, one run a group."""
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}

    def run(pdf):
        pdf = pdf.sort_values([order, value])
        return pdf[[*keys, order]].assign(ema=pdf[value].ewm(span=span, adjust=False).mean())

    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in (*keys, order)), "ema double"])
    return rows.select(*keys, order, F.col(value).cast("double").alias(value)).groupBy(*keys).applyInPandas(run, schema)


def best_step(rows: DataFrame, keys: list[str], metric: str, split: str = "split") -> DataFrame:
    """Rows of the run (uuid) whose validation metric is its key's greatest; of runs that tie, all; best_run() keeps one."""
    top = F.max(metric).over(Window.partitionBy(*keys))
    winners = rows.filter(F.col(split) == "val").withColumn("_top", top).filter(F.col(metric) == F.col("_top")).select(*keys, "uuid")
    return rows.join(winners.distinct(), [*keys, "uuid"], "left_semi")


def best_run(rows: DataFrame, keys: list[str], metric: str, split: str = "split") -> DataFrame:
    """Rows of one run of each key: the one of the greatest validation metric, of runs that tie the one of the least uuid."""
    scored = rows.filter((F.col(split) == "val") & F.col(metric).isNotNull()).groupBy(*keys, "uuid").agg(F.max(metric).alias("_m"))
    best = Window.partitionBy(*keys).orderBy(F.desc("_m"), "uuid")
    winners = scored.withColumn("_n", F.row_number().over(best)).filter("_n = 1").select(*keys, "uuid")
    return rows.join(winners, [*keys, "uuid"], "left_semi")


def histogram(rows: DataFrame, column: str, most: float, bins: int) -> DataFrame:
    """Counts in equal bins from 0 to most; what lies above counts in the last."""
    at = F.least(F.lit(bins - 1), F.floor(F.least(F.col(column), F.lit(most)) * bins / most)).cast("int")
    return rows.filter(F.col(column).isNotNull()).groupBy(at.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


#: The largest k that is drawn of tasks with few training rows.
MOST_SHOTS = {"new_celiac": 64}


def curve(means: DataFrame, most: dict[str, int] = MOST_SHOTS) -> DataFrame:
    """Few-shot curves: all rows (k = -1) are drawn at twice the largest k. most bounds the k of some tasks, by default that of tasks with few training rows."""
    for task, k in most.items():
        means = means.filter((F.col("labeling_function") != task) | (F.col("k") <= k))
    top = F.max(F.when(F.col("k") > 0, F.col("k"))).over(Window.partitionBy("labeling_function"))
    return means.withColumn("x", F.when(F.col("k") == -1, 2 * F.coalesce(top, F.lit(1))).otherwise(F.col("k")))


def against_full(means: DataFrame) -> DataFrame:
    """Each k's mean less that of all rows (k = -1), of the same task, model, head and score."""
    keys = ["sub_task", "model", "head", "score"]
    full = means.filter("k = -1").select(*keys, F.col("mean_value").alias("_full"))
    return means.filter("k <> -1").join(full, keys).withColumn("difference", F.col("mean_value") - F.col("_full")).drop("_full")


def stratified(preds: DataFrame, strata: DataFrame, keys: tuple[str, ...] = ("patient_id", "prediction_time")) -> DataFrame:
    """preds with the columns of strata: one row of strata for each key, the least, so that repeats there multiply nothing; predictions without one are left out."""
    others = [c for c in strata.columns if c not in keys]
    one = strata.groupBy(*keys).agg(F.min(F.struct(*others)).alias("_s")).select(*keys, *(F.col(f"_s.{c}").alias(c) for c in others))
    return preds.join(one, list(keys))


#: Rows that a rendered table may have.
MOST_ROWS = 10_000


def _report_rows(df: DataFrame) -> list:
    rows = df.limit(MOST_ROWS + 1).collect()
    if len(rows) > MOST_ROWS:
        raise ValueError(f"a rendered table has at most {MOST_ROWS} rows")
    return rows


def markdown(df: DataFrame) -> str:
    """A report table as Markdown; refused beyond MOST_ROWS, as are the other two."""
    rows = [[("" if v is None else str(v)) for v in r] for r in _report_rows(df)]
    line = lambda cells: "| " + " | ".join(cells) + " |"
    return "\n".join([line(df.columns), line(["---"] * len(df.columns)), *map(line, rows)])


def latex(df: DataFrame) -> str:
    """A report table as LaTeX."""
    esc = lambda v: ("" if v is None else str(v)).replace("_", r"\_").replace("%", r"\%").replace("±", r"$\pm$")
    body = [" & ".join(map(esc, r)) + r" \\" for r in _report_rows(df)]
    return "\n".join([r"\begin{tabular}{" + "l" * len(df.columns) + "}", " & ".join(map(esc, df.columns)) + r" \\ \hline", *body, r"\end{tabular}"])


def html(df: DataFrame) -> str:
    """A report table as HTML."""
    from html import escape

    row = lambda cells, tag: "<tr>" + "".join(f"<{tag}>{escape('' if c is None else str(c))}</{tag}>" for c in cells) + "</tr>"
    return "<table>\n" + "\n".join([row(df.columns, "th"), *(row(r, "td") for r in _report_rows(df))]) + "\n</table>"


def csv_lines(df: DataFrame) -> str:
    """A report table as CSV."""
    import csv
    import io

    out = io.StringIO()
    writer = csv.writer(out, lineterminator="\n")
    writer.writerow(df.columns)
    writer.writerows(_report_rows(df))
    return out.getvalue()


FORMS = {"md": (markdown, "# {}\n{}\n\n"), "html": (html, "<h5>{}</h5>\n{}\n\n"), "tex": (latex, "% {}\n{}\n\n"), "csv": (csv_lines, "# {}\n{}\n")}


def merged_tables(df: DataFrame, form: str, task: str = "sub_task") -> str:
    """The tables of all tasks of a report one below the other, in the order of the task groups, each under its name in print."""
    show, frame = FORMS[form]
    # One row for each task.
    tasks = in_print(df.select(task).distinct(), task).orderBy("task_order", task).select(task, "task_name")
    return "".join(frame.format(r[1], show(df.filter(F.col(task).eqNullSafe(r[0])).drop(task))) for r in _report_rows(tasks))
