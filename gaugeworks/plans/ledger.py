"""A tiered ledger of runs: one line a run, its cells, and a partitioned copy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeworks.operators import scoring


def tier_one(reports: DataFrame) -> DataFrame:
    """One line per run: bucket_mean, accuracies, n; best first, runs without a mean last."""
    def of(dist: str):
        return F.max(F.when((F.col("slice") == "dist") & (F.col("dist") == dist), F.col("accuracy")))

    done = reports.groupBy("experiment", "run").agg(
        F.avg(F.when(F.col("in_mean"), F.col("accuracy"))).alias("bucket_mean"),
        of("ID").alias("acc_id"),
        of("OOD").alias("acc_ood"),
        F.max(F.when(F.col("slice") == "overall", F.col("n"))).alias("n_total"),
    )
    return done.orderBy(F.desc_nulls_last("bucket_mean"), "experiment", "run")


def tier_two(reports: DataFrame) -> DataFrame:
    """The bucket cells of every run."""
    return reports.filter("slice = 'bucket'").select("experiment", "run", "grp", "dist", "accuracy", "n", "floor", "margin")


def write(reports: DataFrame, path: str) -> None:
    """summary and detailed as CSV, and every cell partitioned by experiment and run."""
    tier_one(reports).coalesce(1).write.mode("overwrite").csv(f"{path}/summary", header=True)
    tier_two(reports).write.mode("overwrite").csv(f"{path}/detailed", header=True)
    reports.write.mode("overwrite").partitionBy("experiment", "run").parquet(f"{path}/by_run")


def add_fallback(tier: DataFrame, older: DataFrame) -> DataFrame:
    """Older lines for runs that the tier doesn't have yet."""
    return tier.unionByName(older.join(tier, ["experiment", "run"], "left_anti"), allowMissingColumns=True)


def report_of(rows: DataFrame, experiment: str, run: str) -> DataFrame:
    return scoring.stratified_report(rows).withColumns({"experiment": F.lit(experiment), "run": F.lit(run)})


def markdown(tier: DataFrame, columns: list[str]) -> str:
    """The tier as a Markdown table; one line a run, so it is small enough for the driver."""
    def cell(x) -> str:
        return "" if x is None else f"{x:.4f}" if isinstance(x, float) else str(x).lower() if isinstance(x, bool) else str(x)

    lines = ["| " + " | ".join(columns) + " |", "|" + " --- |" * len(columns)]
    lines += ["| " + " | ".join(cell(r[c]) for c in columns) + " |" for r in tier.toLocalIterator()]
    return "\n".join(lines) + "\n"


def run_of_path(path: Column) -> tuple[Column, Column]:
    """Experiment and run of a path such as ``experiments/<e>/runs/<r>/...``; NULL where it has none."""
    part = lambda k: F.nullif(F.regexp_extract(path, r"experiments/([^/]+)/runs/([^/]+)", k), F.lit(""))
    return part(1), part(2)


def clean(value: Column) -> Column:
    """NULL for NaN and the infinities."""
    return F.when(~F.isnan(value) & (F.abs(value) != F.lit(float("inf"))), value)


def report_json(cells: DataFrame, meta: dict[str, str]) -> DataFrame:
    """One row, column ``report``: the cells of a report (a row for each bucket) as JSON, with its totals and ``_meta``."""
    doubles = {f.name for f in cells.schema if f.dataType.simpleString() in ("double", "float")}
    row = F.struct(*((clean(F.col(c)) if c in doubles else F.col(c)).alias(c) for c in cells.columns))
    whole = cells.agg(F.sum("n").alias("n_total"), F.array_sort(F.collect_list(row)).alias("by_bucket"))
    named = F.struct(*(F.lit(v).alias(k) for k, v in meta.items()))
    return whole.select(F.to_json(F.struct(named.alias("_meta"), "n_total", "by_bucket"), {"ignoreNullFields": "false"}).alias("report"))


def cell(rows: DataFrame, name: str) -> Column:
    """A column as a table cell: true and false, four places, nothing for NULL."""
    kind = rows.schema[name].dataType.simpleString()
    text = F.format_string("%.4f", F.col(name)) if kind in ("double", "float") else F.col(name).cast("string")
    return F.when(F.col(name).isNull(), "").otherwise(text)


def markdown_line(rows: DataFrame, columns: list[str]) -> Column:
    return F.concat(F.lit("| "), F.concat_ws(" | ", *(cell(rows, c) for c in columns)), F.lit(" |"))


def sections(tables: dict[str, DataFrame]) -> DataFrame:
    """All tables under each other, with a column ``section``; what a table has not is NULL."""
    out = None
    for name, table in tables.items():
        part = table.withColumn("section", F.lit(name))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    if out is None:
        raise ValueError("no sections")
    return out
