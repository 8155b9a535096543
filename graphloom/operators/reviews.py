"""Test cases, their runs, the runs' reviews."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: what stands for no verdict yet.
NO_VERDICT = "未判定"


def verdict(column: str = "verdict"):
    return F.coalesce(F.nullif(F.trim(F.col(column)), F.lit("")), F.lit(NO_VERDICT))


def filter_cases(cases: DataFrame, domain: str | None = None, scenario: str | None = None, q: str | None = None) -> DataFrame:
    found = F.lit(True)
    for name, value in (("domain", domain), ("scenario", scenario)):
        if value:
            found &= F.col(name) == value
    if q and q.strip():
        needle = q.strip().lower()
        found &= F.lower("id").contains(needle) | F.coalesce(F.lower("name").contains(needle), F.lit(False))
    return cases.where(found).orderBy("domain", "scenario", "id")


def latest_verdicts(reviews: DataFrame) -> DataFrame:
    """(run_id, n_reviews, latest_verdict): the review that is last by id decides."""
    return reviews.groupBy("run_id").agg(F.count("*").alias("n_reviews"), F.max_by(verdict(), "id").alias("latest_verdict"))


def runs_with_reviews(runs: DataFrame, reviews: DataFrame) -> DataFrame:
    """Runs, newest first, with the number of their reviews and the latest verdict."""
    joined = runs.join(latest_verdicts(reviews).withColumnRenamed("run_id", "id"), "id", "left")
    filled = joined.withColumns({"n_reviews": F.coalesce("n_reviews", F.lit(0)), "latest_verdict": F.coalesce("latest_verdict", F.lit(NO_VERDICT))})
    return filled.orderBy(F.desc("run_at"), F.desc("id"))


def case_rollup(cases: DataFrame, runs: DataFrame, reviews: DataFrame) -> DataFrame:
    """Cases with n_runs, n_reviews and the latest run's latest verdict; cases without runs have none."""
    per_run = runs.join(latest_verdicts(reviews).withColumnRenamed("run_id", "id"), "id", "left")
    per_case = per_run.groupBy(F.col("case_id").alias("id")).agg(
        F.count("*").alias("n_runs"),
        F.sum(F.coalesce("n_reviews", F.lit(0))).alias("n_reviews"),
        F.max_by(F.coalesce("latest_verdict", F.lit(NO_VERDICT)), "id").alias("latest_verdict"),
    )
    zero = {"n_runs": F.coalesce("n_runs", F.lit(0)), "n_reviews": F.coalesce("n_reviews", F.lit(0))}
    return cases.join(per_case, "id", "left").withColumns(zero)


def orphan_runs(cases: DataFrame, runs: DataFrame) -> DataFrame:
    """Runs whose case does not exist."""
    return runs.join(cases.select(F.col("id").alias("case_id")), "case_id", "left_anti")


def verdict_distribution(reviews: DataFrame) -> DataFrame:
    return reviews.groupBy(verdict().alias("verdict")).agg(F.count("*").alias("n"))


def cases_by_domain(cases: DataFrame) -> DataFrame:
    """(level, domain, scenario, n) for domains and for domains and scenarios."""
    rolled = cases.groupingSets([("domain",), ("domain", "scenario")], "domain", "scenario").agg(F.count("*").alias("n"), F.grouping_id().alias("g"))
    return rolled.withColumn("level", F.when(F.col("g") == 1, "domain").otherwise("scenario")).drop("g")


def next_review_id(runs: DataFrame, reviews: DataFrame) -> DataFrame:
    """(run_id, next_id): the number after the existing reviews, three digits."""
    counts = runs.select(F.col("id").alias("run_id")).join(reviews.groupBy("run_id").agg(F.count("*").alias("n")), "run_id", "left")
    number = (F.coalesce("n", F.lit(0)) + 1).cast("string")
    return counts.select("run_id", F.concat(F.lit("R"), F.when(F.length(number) < 3, F.lpad(number, 3, "0")).otherwise(number)).alias("next_id"))


def problem_rows(reviews: DataFrame) -> DataFrame:
    """One row for each problem of ``reviews.problems array<struct<description, attribution, objects>>``."""
    return reviews.select(F.col("id").alias("review_id"), F.posexplode("problems").alias("idx", "p")).select("review_id", "idx", "p.*")


def render_review(reviews: DataFrame) -> DataFrame:
    """(id, md): a review as Markdown, its problems under numbered headings."""

    def one(p, i):
        head = F.concat(F.lit("### 问题 "), (i + 1).cast("string"), F.lit("\n"), F.coalesce(p["description"], F.lit("")))
        return F.concat(head, F.lit("\n- 归因: "), F.array_join(p["attribution"], "、"), F.lit("\n- 对象: "), F.array_join(p["objects"], "、"))

    body = F.array_join(F.transform("problems", one), "\n\n")
    return reviews.select("id", F.concat(F.lit("# 评审 "), "id", F.lit("\n\n结论: "), verdict(), F.lit("\n\n"), body).alias("md"))


def runs_of_case(runs: DataFrame, reviews: DataFrame, case_id: str) -> DataFrame:
    """The runs of a case, newest first, with the number of their reviews and the latest verdict."""
    return runs_with_reviews(runs.where(F.col("case_id") == case_id), reviews)


def reviews_of_run(reviews: DataFrame, run_id: str | None = None) -> DataFrame:
    """Reviews (of one run, or all) by the time they were made; a blank verdict is none yet."""
    found = reviews if run_id is None else reviews.where(F.col("run_id") == run_id)
    return found.withColumn("verdict", verdict()).orderBy("reviewed_at", "id")


def regrouped(tables: dict[str, DataFrame]) -> DataFrame:
    """Cases with ``runs array<struct<id, run_at, files array, reviews array<struct<id, verdict, reviewed_at>>>>``, all in order of their ids."""
    reviews = tables["reviews"].groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct("id", verdict().alias("verdict"), "reviewed_at"))).alias("reviews"))
    files = tables["artifacts"].groupBy("run_id").agg(F.array_sort(F.collect_list("path")).alias("files"))
    runs = tables["runs"].join(reviews.withColumnRenamed("run_id", "id"), "id", "left").join(files.withColumnRenamed("run_id", "id"), "id", "left")
    runs = runs.groupBy("case_id").agg(F.array_sort(F.collect_list(F.struct("id", "run_at", "files", "reviews"))).alias("runs"))
    return tables["cases"].join(runs.withColumnRenamed("case_id", "id"), "id", "left")


def put(tables: dict[str, DataFrame], name: str, rows: DataFrame) -> dict[str, DataFrame]:
    """The tables with rows of one of them added, or replaced where their id is there."""
    return tables | {name: tables[name].join(rows.select("id").distinct(), "id", "left_anti").unionByName(rows, allowMissingColumns=True)}


def delete_reviews(tables: dict[str, DataFrame], ids: DataFrame) -> dict[str, DataFrame]:
    return tables | {"reviews": tables["reviews"].join(ids.select("id").distinct(), "id", "left_anti")}


def delete_runs(tables: dict[str, DataFrame], ids: DataFrame) -> dict[str, DataFrame]:
    """The tables without some runs, their reviews and their files."""
    ids = ids.select("id").distinct()
    own = ids.select(F.col("id").alias("run_id"))
    return tables | {
        "runs": tables["runs"].join(ids, "id", "left_anti"),
        "reviews": tables["reviews"].join(own, "run_id", "left_anti"),
        "artifacts": tables["artifacts"].join(own, "run_id", "left_anti"),
    }


def delete_cases(tables: dict[str, DataFrame], ids: DataFrame) -> dict[str, DataFrame]:
    """The tables without some cases and all that hangs on them."""
    ids = ids.select("id").distinct()
    runs = tables["runs"].join(ids.select(F.col("id").alias("case_id")), "case_id", "left_semi").select("id")
    return delete_runs(tables, runs) | {"cases": tables["cases"].join(ids, "id", "left_anti")}


def move_cases(tables: dict[str, DataFrame], moves: DataFrame) -> dict[str, DataFrame]:
    """The tables with cases in other domains and scenarios: ``moves`` is (id, domain, scenario)."""
    new = moves.select("id", F.col("domain").alias("_d"), F.col("scenario").alias("_s"))
    cases = tables["cases"].join(new, "id", "left")
    return tables | {"cases": cases.withColumns({"domain": F.coalesce("_d", "domain"), "scenario": F.coalesce("_s", "scenario")}).drop("_d", "_s")}


def pick_lists(cases: DataFrame) -> DataFrame:
    """(kind, value): the domains and scenarios to choose from, each once, in order."""
    rows = cases.select(F.explode(F.array(F.struct(F.lit("domain").alias("kind"), F.col("domain").alias("value")), F.struct(F.lit("scenario").alias("kind"), F.col("scenario").alias("value")))).alias("x"))
    return rows.select("x.*").where("value <> ''").distinct().orderBy("kind", "value")


def suggestions(objects: DataFrame, q: str, most: int = 20) -> DataFrame:
    """(id, name) of at most ``most`` objects whose id or name holds the text, whatever the case, those that begin with it first."""
    needle = q.strip().lower()
    low = F.lower("id")
    found = objects.where(low.contains(needle) | F.coalesce(F.lower("name").contains(needle), F.lit(False))).groupBy("id").agg(F.max("name").alias("name"))
    return found.orderBy(~F.coalesce(F.lower("name").startswith(needle), F.lit(False)), "id").limit(most)
