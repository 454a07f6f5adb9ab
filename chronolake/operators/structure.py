"""Legal structure: headings, spans over pages, the provision tree and when each provision takes effect."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronolake.operators.parsing import part_offsets

HEADING = r"^\s*(?:#{1,6}\s*)?(?:\*\*)?\s*Điều\s+([0-9]+[a-zđ]?)\."


def page_offsets(pages: DataFrame) -> DataFrame:
    """Where each page's text starts in its document, pages two characters apart; windows run within a part only."""
    within = Window.partitionBy("logical_doc_id", "part_no").orderBy("physical_page").rowsBetween(Window.unboundedPreceding, -1)
    rows = pages.select("logical_doc_id", "part_no", "physical_page", F.length(F.coalesce("raw_text", F.lit(""))).alias("n"))
    rows = rows.withColumn("in_part", F.coalesce(F.sum(F.col("n") + 2).over(within), F.lit(0)))
    joined = rows.join(part_offsets(rows, F.col("n") + 2), ["logical_doc_id", "part_no"])
    return joined.select("logical_doc_id", "part_no", "physical_page", "n", (F.col("part_start") + F.col("in_part")).alias("page_start"))


def headings(pages: DataFrame) -> DataFrame:
    """The first heading of each article number of a document: document, number, page, line; ordered spans end at the next.

    What follows the last heading of a part is the first of the next part that has one, so windows over headings run within parts."""
    line = pages.select("logical_doc_id", "part_no", "physical_page", F.posexplode(F.split("raw_text", "\n")).alias("line_no", "line"))
    found = line.filter(F.col("line").rlike(HEADING)).withColumn("number", F.regexp_extract("line", HEADING, 1))
    at = F.struct("part_no", "physical_page", "line_no")
    kept = found.groupBy("logical_doc_id", "number").agg(F.min(at).alias("at")).select("logical_doc_id", "at.*", "number")
    here = F.struct("physical_page", "number")
    inside = Window.partitionBy("logical_doc_id", "part_no").orderBy("physical_page", "line_no")
    first = kept.groupBy("logical_doc_id", "part_no").agg(F.min_by(here, F.struct("physical_page", "line_no")).alias("first"))
    following = first.select("logical_doc_id", "part_no", F.lead("first").over(Window.partitionBy("logical_doc_id").orderBy("part_no")).alias("beyond"))
    rows = kept.withColumn("next", F.lead(here).over(inside)).join(following, ["logical_doc_id", "part_no"])
    after = F.coalesce("next", "beyond")
    return rows.select("logical_doc_id", "part_no", "physical_page", "line_no", "number", after["physical_page"].alias("next_page"), after["number"].alias("next_number"))


def overlap(spans: DataFrame, pages: DataFrame, key: str, width: int = 64) -> DataFrame:
    """Spans and pages that overlap by half-open intervals, clipped to what they share.

    They meet by key and stretch of `width`, so a key that holds a tenth of all rows is no single task's; a pair that shares several
    stretches comes from the first of them."""
    bucket = lambda c: F.floor(F.col(c) / width)
    last = lambda c: F.floor((F.col(c) - 1) / width)
    a = spans.filter("span_start < span_end").withColumn("_at", F.explode(F.sequence(bucket("span_start"), last("span_end"))))
    b = pages.filter("page_start < page_end").withColumn("_at", F.explode(F.sequence(bucket("page_start"), last("page_end"))))
    joined = a.join(b, [key, "_at"]).filter((F.col("page_end") > F.col("span_start")) & (F.col("page_start") < F.col("span_end")))
    joined = joined.filter(F.col("_at") == F.greatest(bucket("span_start"), bucket("page_start"))).drop("_at")
    return joined.withColumn("from_", F.greatest("span_start", "page_start")).withColumn("to_", F.least("span_end", "page_end"))


def tree_issues(provisions: DataFrame) -> DataFrame:
    """provision_id, logical_doc_id, provision_path and the codes of what is wrong with a provision's place in the tree.

    Rows that differ are told apart: an id or a document's path that several different rows have is an issue; exact copies of a row
    are one row."""
    mode = F.col("effectivity_mode") if "effectivity_mode" in provisions.columns else F.lit("unknown").alias("effectivity_mode")
    rows = provisions.select("provision_id", "logical_doc_id", "parent_provision_id", "level", "provision_path", "provision_number", mode).distinct()
    ids = rows.groupBy("provision_id").agg(F.count("*").alias("same_id"))
    paths = rows.groupBy("logical_doc_id", "provision_path").agg(F.count("*").alias("same_path"))
    parent = rows.select(F.col("provision_id").alias("parent_id"), F.col("level").alias("parent_level"), F.col("provision_path").alias("parent_path"))
    parent = parent.groupBy("parent_id").agg(F.min("parent_level").alias("parent_level"), F.min("parent_path").alias("parent_path"))
    joined = rows.join(parent, F.col("parent_provision_id") == F.col("parent_id"), "left").join(ids, "provision_id", "left")
    joined = joined.join(paths, ["logical_doc_id", "provision_path"], "left")
    level, above = F.col("level"), F.coalesce("parent_level", F.lit(""))
    right_path = F.coalesce(F.col("provision_path") == F.concat_ws(".", "parent_path", "provision_number"), F.lit(False))
    codes = F.array(
        F.when(F.col("provision_id").isNull(), "ID_MISSING"),
        F.when(F.col("same_id") > 1, "ID_NOT_UNIQUE"),
        F.when(F.col("same_path") > 1, "PATH_NOT_UNIQUE"),
        F.when(~F.coalesce(level.isin("article", "clause", "point"), F.lit(False)), "LEVEL_UNKNOWN"),
        F.when(F.col("parent_provision_id").isNotNull() & F.col("parent_id").isNull(), "PARENT_MISSING"),
        F.when((level == "article") & (F.col("parent_id").isNotNull() | ~F.coalesce(F.col("provision_path") == F.col("provision_number"), F.lit(False))), "ROOT_INVALID"),
        F.when(
            (F.col("parent_provision_id").isNull() | F.col("parent_id").isNotNull()) & ((level == "clause") & (above != "article") | (level == "point") & (above != "clause")),
            "PARENT_LEVEL_INVALID",
        ),
        F.when(level.isin("clause", "point") & F.col("parent_id").isNotNull() & ~right_path, "PATH_INVALID"),
        F.when(~F.coalesce(F.col("effectivity_mode").isin("inherit", "explicit_date", "external_trigger", "unknown"), F.lit(False)), "MODE_UNKNOWN"),
    )
    return joined.select("provision_id", "logical_doc_id", "provision_path", F.sort_array(F.array_compact(codes)).alias("codes")).filter(F.size("codes") > 0).distinct()


def ancestors(provisions: DataFrame) -> DataFrame:
    """Each provision's root title and depth by self joins level by level; the tree has three levels."""
    one = provisions.select("provision_id", "parent_provision_id", "level", "title").dropDuplicates(["provision_id"])
    p = one.select(F.col("provision_id").alias("p_id"), F.col("parent_provision_id").alias("pp_id"))
    g = one.select(F.col("provision_id").alias("g_id"))
    joined = one.join(p, F.col("parent_provision_id") == F.col("p_id"), "left").join(g, F.col("pp_id") == F.col("g_id"), "left")
    return joined.select(
        "provision_id", F.coalesce("g_id", "p_id", "provision_id").alias("root_id"),
        (F.lit(1) + F.col("p_id").isNotNull().cast("int") + F.col("g_id").isNotNull().cast("int")).alias("depth"),
    )


def _state(own: Column, parent: Column, name: str) -> Column:
    return F.when(own.isNotNull(), own[name]).otherwise(parent[name])


def resolve_effectivity(provisions: DataFrame, rules: DataFrame) -> DataFrame:
    """When each provision takes effect: its own rule, else its parent's state, else (roots) the document's rule, else unknown.

    Three ordered passes, one for each level. Of several rules on one target the one with the greatest rule_id holds.
    """
    state = F.struct(F.col("mode"), F.col("effective_from").alias("start"), F.col("effective_to").alias("end"), F.col("trigger_reference").alias("trigger"))
    one = rules.groupBy("logical_doc_id", "target_path").agg(F.max_by(state, "rule_id").alias("rule"))
    own = one.filter("target_path <> '*'").withColumnRenamed("target_path", "provision_path")
    whole = one.filter("target_path = '*'").select("logical_doc_id", F.col("rule").alias("doc_rule"))
    base = provisions.select("provision_id", "logical_doc_id", "parent_provision_id", "level", "provision_path").dropDuplicates(["provision_id"])
    base = base.join(own, ["logical_doc_id", "provision_path"], "left")
    unknown = F.struct(F.lit("unknown").alias("mode"), F.lit(None).cast("date").alias("start"), F.lit(None).cast("date").alias("end"), F.lit(None).cast("string").alias("trigger"))

    def inherited(p: Column) -> Column:
        dated = p["mode"].isin("explicit_date", "inherit") & p["start"].isNotNull()
        return (
            F.when(dated, F.struct(F.lit("inherit").alias("mode"), p["start"].alias("start"), p["end"].alias("end"), F.lit(None).cast("string").alias("trigger")))
            .when(p["mode"] == "external_trigger", F.struct(F.lit("external_trigger").alias("mode"), F.lit(None).cast("date").alias("start"), F.lit(None).cast("date").alias("end"), p["trigger"].alias("trigger")))
            .otherwise(unknown)
        )

    roots = base.filter("level = 'article'").join(whole, "logical_doc_id", "left")
    roots = roots.select("provision_id", "level", F.coalesce("rule", inherited(F.col("doc_rule")), unknown).alias("state"))
    done, above = roots, roots
    for level in ("clause", "point"):
        up = above.select(F.col("provision_id").alias("parent_provision_id"), F.col("state").alias("parent_state"))
        rows = base.filter(F.col("level") == level).join(up, "parent_provision_id", "left")
        above = rows.select("provision_id", "level", F.coalesce("rule", inherited(F.col("parent_state"))).alias("state"))
        done = done.unionByName(above)
    return done.select("provision_id", "level", "state.mode", F.col("state.start").alias("effective_from"), F.col("state.end").alias("effective_to"), F.col("state.trigger").alias("trigger_reference"))


def rule_issues(rules: DataFrame, provisions: DataFrame) -> DataFrame:
    """rule_id and codes: unknown target, a mode without its field, a target with conflicting rules."""
    one = rules.dropDuplicates(["rule_id"])
    targets = provisions.select("logical_doc_id", F.col("provision_path").alias("target_path"), F.lit(True).alias("known")).distinct()
    said = F.struct(*(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("mode", "effective_from", "effective_to", "trigger_reference")))
    conflict = one.groupBy("logical_doc_id", "target_path").agg(F.count_distinct(said).alias("said"))
    joined = one.join(targets, ["logical_doc_id", "target_path"], "left").join(conflict, ["logical_doc_id", "target_path"], "left")
    codes = F.array(
        F.when((F.col("target_path") != "*") & F.col("known").isNull(), "TARGET_UNKNOWN"),
        F.when(
            (F.col("mode") == "explicit_date") & F.col("effective_from").isNull() | (F.col("mode") == "external_trigger") & F.col("trigger_reference").isNull(),
            "FIELD_MISSING",
        ),
        F.when(F.col("said") > 1, "RULES_CONFLICT"),
    )
    return joined.select("rule_id", F.filter(codes, lambda c: c.isNotNull()).alias("codes")).filter(F.size("codes") > 0)
