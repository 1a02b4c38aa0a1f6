"""Quality gates, coverage, review queues and export decisions over wide item rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Points of the parts of a result's score, and of what makes a row worth a review.
BASE, WEIGHTS = 35, {"attribute": 25, "document": 18, "section": 12}
REVIEW_POINTS = {"failed": 100, "partial": 70, "error": 60, "gate": 45, "required": 35, "coverage": 30, "confidence": 20, "attributes": 15, "documents": 12, "url": 10, "datasheet": 8, "image": 5}
#: Least scores of the tiers, and caps of confidence.
TIERS = [(0.9, "Complete"), (0.75, "Good"), (0.6, "Usable")]
FOUND_SCORE, PARTIAL_CAP, DISTRIBUTOR_CAP = 70, 0.74, 0.45


def coverage_points(total: Column, missing: Column, weight: int) -> Column:
    """The share of ``weight`` for what is there; all of it where nothing is asked for."""
    return F.when(total == 0, weight).otherwise(F.floor((total - missing) / total * weight + 0.5)).cast("int")


def missing_requirements(items: DataFrame, found: DataFrame, required: DataFrame) -> DataFrame:
    """item, missing: the names (``kind:name``) that ``required`` asks of every one of ``items`` and ``found`` (item, kind, name) lacks, in order of text.

    All relations may repeat rows; an item that ``found`` doesn't know lacks everything. Requirements are a table of names and are collected
    behind a check of their number.
    """
    wanted = required.select(F.concat_ws(":", "kind", "name").alias("need")).distinct().limit(1001).collect()
    if len(wanted) > 1000:
        raise ValueError("more than 1000 requirements")
    needs = F.sort_array(F.array(*[F.lit(r["need"]) for r in wanted]).cast("array<string>"))
    name = F.concat_ws(":", "kind", "name")
    have = found.groupBy("item").agg(F.collect_set(F.when(name.isin(*[r["need"] for r in wanted]), name)).alias("have"))
    return items.select("item").distinct().join(have, "item", "left").select("item", F.array_except(needs, F.coalesce("have", F.array().cast("array<string>"))).alias("missing"))


#: Points for what an item has besides the parts in WEIGHTS, and for what speaks against it.
TERMS = {"enough_attributes": 6, "enough_documents": 4, "official": 8, "template_stage": 3, "telling_document": 4, "normalized_missing": -10, "distributor_only": -18, "reader": -2, "browser": -4, "short": -12}


def score_results(items: DataFrame) -> DataFrame:
    """item, score (0 to 100), missing, grade and capped confidence of each item.

    ``items``: item, identity (boolean), confidence, n_attributes, n_documents, min_attributes, official and distributor_only (booleans),
    n_required (map of kind to number) and missing (array of ``kind:name``); where given also min_documents (else 0), and the booleans
    template_stage, telling_document (a document that is held, or a datasheet or certificate), reader and browser (else false). Without
    identity the score is 0 and the grade failed; found needs 70 points and nothing missing. Partial results and those of distributors
    alone have a capped confidence.
    """
    given = lambda name, otherwise: F.coalesce(F.col(name), F.lit(otherwise)) if name in items.columns else F.lit(otherwise)
    none = F.array().cast("array<string>")
    lacks = {"minAttributes": ("n_attributes", given("min_attributes", 1)), "minDocuments": ("n_documents", given("min_documents", 0))}
    short = {name: F.coalesce(F.col(have), F.lit(0)) < least for name, (have, least) in lacks.items()}
    too_few = [F.when(short[name], F.array(F.concat(F.lit(f"{name}:"), least.cast("string")))).otherwise(none) for name, (_, least) in lacks.items()]
    holds = {
        "enough_attributes": ~short["minAttributes"], "enough_documents": ~short["minDocuments"], "short": short["minAttributes"] | short["minDocuments"], "normalized_missing": F.exists("missing", lambda m: m.startswith("normalized:")),
        **{name: given(name, False) for name in ("official", "template_stage", "telling_document", "distributor_only", "reader", "browser")},
    }
    score = F.lit(BASE)
    for kind, weight in WEIGHTS.items():
        lacking = F.size(F.filter("missing", lambda m: m.startswith(f"{kind}:")))
        score = score + coverage_points(F.coalesce(F.try_element_at("n_required", F.lit(kind)), F.lit(0)), lacking, weight)
    for name, points in TERMS.items():
        score = score + F.when(holds[name], points).otherwise(0)
    score = F.when(F.col("identity"), F.greatest(F.lit(0), F.least(F.lit(100), score))).otherwise(0)
    missing = F.concat(F.when(F.col("identity"), none).otherwise(F.array(F.lit("identity"))), F.col("missing"), *too_few)
    rows = items.withColumns({"score": score.cast("int"), "missing": missing})
    passed = F.col("identity") & (F.size("missing") == 0) & (F.col("score") >= FOUND_SCORE)
    grade = F.when(passed, "found").when(F.col("identity"), "partial").otherwise("failed")
    capped = F.when(grade == "found", F.col("confidence")).when(grade == "failed", 0.0).otherwise(F.least("confidence", F.when(holds["distributor_only"], DISTRIBUTOR_CAP).otherwise(PARTIAL_CAP)))
    return rows.select("item", "score", F.array_join("missing", "; ").alias("missing"), grade.alias("grade"), F.greatest(F.lit(0.0), F.least(F.lit(0.99), capped)).alias("confidence"))


def coverage_of(checks: dict[str, Column]) -> tuple[Column, Column]:
    """The share of checks that hold, to four places, and the names of those that don't, in order, joined."""
    holds = {n: F.coalesce(c, F.lit(False)) for n, c in checks.items()}
    present = sum((h.cast("int") for h in holds.values()), F.lit(0))
    missing = F.array_join(F.filter(F.array(*[F.when(~h, n) for n, h in holds.items()]), lambda x: x.isNotNull()), "; ")
    return F.round(present / len(holds), 4), missing


def quality_tier(score: Column) -> Column:
    out = F.when(F.lit(False), "")
    for least, name in TIERS:
        out = out.when(score >= least, name)
    return out.when(score > 0, "Sparse").otherwise("No data")


def review_score(row: dict[str, Column]) -> Column:
    """Points of the conditions in ``row`` (keys of REVIEW_POINTS) that hold."""
    return sum((F.when(c, REVIEW_POINTS[n]).otherwise(0) for n, c in row.items()), F.lit(0)).cast("int")


def priority_label(score: Column) -> Column:
    return F.when(score >= 70, "High").when(score >= 30, "Medium").otherwise("Low")


def review_rows(items: DataFrame) -> DataFrame:
    """Items with coverage, tier, review points, label, reasons and export decision.

    ``items``: item, status, confidence, coverage, gate_passed, n_attributes, n_documents, url. A null url is missing; a confidence of 0 isn't low.
    """
    low = (F.col("confidence") > 0) & (F.col("confidence") < 0.65)
    tests = {
        "failed": (F.col("status") == "failed", F.lit("Failed scrape")), "partial": (F.col("status") == "partial", F.lit("Partial scrape")), "confidence": (low, F.lit("Low confidence")),
        "coverage": (F.col("coverage") < 0.6, F.concat(F.lit("Low coverage: "), F.floor(F.col("coverage") * 100 + 0.5).cast("string"), F.lit("%"))), "gate": (~F.col("gate_passed"), F.lit("Quality gate failed")),
        "attributes": (F.col("n_attributes") == 0, F.lit("No attributes")), "documents": (F.col("n_documents") == 0, F.lit("No documents")), "url": (F.coalesce(F.col("url"), F.lit("")) == "", F.lit("Missing product URL")),
    }
    reasons = F.array_join(F.filter(F.array(*[F.when(t, said) for t, said in tests.values()]), lambda x: x.isNotNull()), "; ")
    score = review_score({n: t for n, (t, _) in tests.items()})
    decision = F.when(F.col("status").isin("failed", "cancelled"), "Exclude").when(reasons != "", "Review").otherwise("Import")
    return items.select("item", quality_tier(F.col("coverage")).alias("tier"), score.alias("review_points"), priority_label(score).alias("priority"), reasons.alias("reasons"), decision.alias("decision"))


def issue_rows(reviewed: DataFrame, named: int = 25) -> DataFrame:
    """Each reason with its rows, those of each priority, its severity and its smallest items: ``named`` of them, then how many more there are.

    issue, severity, n, high, medium, low, items. Only the named items of an issue meet in one place.
    """
    rows = reviewed.filter("reasons <> ''").select("item", "priority", F.explode(F.array_distinct(F.split("reasons", "; "))).alias("issue")).withColumn("issue", F.regexp_replace("issue", ":.*$", ""))
    counts = rows.groupBy("issue").agg(F.count(F.lit(1)).alias("n"), *[F.count(F.when(F.col("priority") == p, 1)).alias(p.lower()) for p in ("High", "Medium", "Low")])
    first = rows.withColumn("at", F.row_number().over(Window.partitionBy("issue").orderBy("item"))).filter(F.col("at") <= named)
    names = first.groupBy("issue").agg(F.array_sort(F.collect_list(F.struct("at", F.col("item").cast("string").alias("item")))).alias("first"))
    listed = F.array_join(F.transform("first", lambda x: x["item"]), "; ")
    more = F.when(F.col("n") > named, F.concat(F.lit("; +"), (F.col("n") - named).cast("string"), F.lit(" more"))).otherwise("")
    severity = F.when(F.col("high") > 0, "High").when(F.col("medium") > 0, "Medium").when(F.col("low") > 0, "Low").otherwise("Info")
    return counts.join(names, "issue").select("issue", severity.alias("severity"), "n", "high", "medium", "low", F.concat(listed, more).alias("items"))


def readiness(reviewed: DataFrame) -> DataFrame:
    """One row: rows, rows ready to import, rows of each priority under review, and the state that follows from them."""
    open_ = F.col("decision") != "Import"
    counts = reviewed.agg(F.count(F.lit(1)).alias("total"), F.count(F.when(~open_, 1)).alias("ready"), *[F.count(F.when(open_ & (F.col("priority") == p), 1)).alias(p.lower()) for p in ("High", "Medium", "Low")])
    state = F.when(F.col("total") == 0, "No rows exported").when(F.col("high") > 0, "Needs review before import").when(F.col("medium") + F.col("low") > 0, "Review recommended").otherwise("Ready to import")
    return counts.select("total", "ready", "high", "medium", "low", state.alias("state"))
