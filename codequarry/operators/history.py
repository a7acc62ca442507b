"""Versions, changes, commits and merges over time."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from codequarry.operators.screens import first_match
from codequarry.plans.registry import query

col = F.col
BREAKING = ("ParameterRemoved", "ReturnTypeChanged", "BlockDeleted")


def newest(key: str = "block_id"):
    return Window.partitionBy(key).orderBy(F.desc("version_number"))


@query("""SELECT id, block_id, semantic_hash, SUM(CASE WHEN breaking_change THEN 10 WHEN change_type IN ('major', 'breaking') THEN 5 WHEN change_type IN ('minor', 'feature') THEN 3 ELSE 1 END) OVER (PARTITION BY block_id ORDER BY version_number ROWS UNBOUNDED PRECEDING) AS number FROM f_versions""")
def w01_version_numbers(c):
    step = F.when(col("breaking_change"), 10).when(col("change_type").isin("major", "breaking"), 5).when(col("change_type").isin("minor", "feature"), 3).otherwise(1)
    upto = Window.partitionBy("block_id").orderBy("version_number").rowsBetween(Window.unboundedPreceding, 0)
    return c.versions.select("id", "block_id", "semantic_hash", F.sum(step).over(upto).alias("number"))


@query("""SELECT a.block_id, a.version_number AS from_version, b.version_number AS to_version, a.semantic_hash <> b.semantic_hash AS behavioral, b.breaking_change AND NOT a.breaking_change AS newly_breaking FROM f_versions a JOIN f_versions b ON a.block_id = b.block_id AND b.version_number = a.version_number + 1""")
def w02_version_diffs(c):
    """Every version against the one before, in one pass over a block's versions."""
    order = Window.partitionBy("block_id").orderBy("version_number")
    before = lambda x: F.lag(x).over(order)
    out = c.versions.select("block_id", before("version_number").alias("from_version"), col("version_number").alias("to_version"), (before("semantic_hash") != col("semantic_hash")).alias("behavioral"), (col("breaking_change") & ~before("breaking_change")).alias("newly_breaking"))
    return out.where("from_version IS NOT NULL")


@query("SELECT v.block_id, m.latest + 1 AS version_number, v.semantic_hash, 'rollback' AS change_type FROM f_versions v JOIN (SELECT block_id, MAX(version_number) AS latest FROM f_versions GROUP BY block_id) m ON m.block_id = v.block_id AND v.version_number = GREATEST(m.latest - 1, 1)")
def w03_rollbacks(c):
    """What rolling each block back to its version before the last (or to its only one) appends."""
    latest = F.max("version_number").over(Window.partitionBy("block_id"))
    own = c.versions.withColumn("latest", latest).where(col("version_number") == F.greatest(col("latest") - 1, F.lit(1)))
    return own.select("block_id", (col("latest") + 1).alias("version_number"), "semantic_hash", F.lit("rollback").alias("change_type"))


def affected(c):
    return c.relationships.where(col("relationship_type").isin("calls", "depends_on", "imports")).groupBy(col("target_block_id").alias("block_id")).agg(F.countDistinct("source_block_id").alias("n"))


@query("""SELECT b.id AS block_id, k.change_type, k.change_type IN ('ParameterRemoved', 'ReturnTypeChanged', 'BlockDeleted') AS breaking_change, COALESCE(a.n, 0) AS n_affected,
CASE WHEN k.change_type = 'SecurityVulnerabilityFixed' THEN 'Critical' WHEN COALESCE(a.n, 0) <= 2 THEN 'Low' WHEN a.n <= 10 THEN 'Medium' WHEN a.n <= 50 THEN 'High' ELSE 'Critical' END AS risk_level,
CASE WHEN k.change_type IN ('ParameterRemoved', 'ReturnTypeChanged', 'BlockDeleted') THEN 8.0::DOUBLE ELSE 2.0::DOUBLE END AS hours FROM (SELECT id, CASE id % 4 WHEN 0 THEN 'ParameterRemoved' WHEN 1 THEN 'SecurityVulnerabilityFixed' WHEN 2 THEN 'BugFixed' ELSE 'BlockDeleted' END AS change_type FROM f_blocks) k
JOIN f_blocks b ON b.id = k.id LEFT JOIN (SELECT target_block_id AS t, COUNT(DISTINCT source_block_id) AS n FROM f_relationships WHERE relationship_type IN ('calls', 'depends_on', 'imports') GROUP BY 1) a ON a.t = b.id""")
def w04_impact(c):
    """Impact of a change of every block, of a kind dealt by its id."""
    from codequarry.sources.code import pick

    changed = c.blocks.select(col("id").alias("block_id"), pick(col("id") % 4, ("ParameterRemoved", "SecurityVulnerabilityFixed", "BugFixed", "BlockDeleted")).alias("change_type"))
    return impact(changed, c)


def impact(changed, c):
    """Of changes (block_id, change_type): whether they break, how many blocks they affect, risk and hours."""
    breaks = col("change_type").isin(*BREAKING)
    n = F.coalesce("n", F.lit(0))
    risk = first_match((col("change_type") == "SecurityVulnerabilityFixed", "Critical"), (n <= 2, "Low"), (n <= 10, "Medium"), (n <= 50, "High"), other="Critical")
    return changed.join(affected(c), "block_id", "left").select("block_id", "change_type", breaks.alias("breaking_change"), n.alias("n_affected"), risk.alias("risk_level"), F.when(breaks, 8.0).otherwise(2.0).alias("hours"))


def like(part: str) -> Column:
    return F.count_if(col("change_type").like(f"%{part}%"))


@query("""SELECT author, COUNT(*) AS total_changes, COUNT(CASE WHEN change_type LIKE '%Added%' THEN 1 END) AS additions, COUNT(CASE WHEN change_type LIKE '%Fixed%' THEN 1 END) AS fixes, COUNT(CASE WHEN change_type LIKE '%Introduced%' THEN 1 END) AS introductions FROM f_changes GROUP BY author""")
def w05_diff_summary(c):
    return c.changes.groupBy("author").agg(F.count("*").alias("total_changes"), like("Added").alias("additions"), like("Fixed").alias("fixes"), like("Introduced").alias("introductions"))


@query("""WITH a AS (SELECT semantic_name, cc FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY semantic_name ORDER BY id) AS k FROM f_blocks WHERE migration_id = 0 AND semantic_name IS NOT NULL) WHERE k = 1), b AS (SELECT semantic_name, cc FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY semantic_name ORDER BY id) AS k FROM f_blocks WHERE migration_id = 1 AND semantic_name IS NOT NULL) WHERE k = 1)
SELECT COALESCE(a.semantic_name, b.semantic_name) AS semantic_name, CASE WHEN a.semantic_name IS NULL THEN 'added' WHEN b.semantic_name IS NULL THEN 'removed' WHEN a.cc IS DISTINCT FROM b.cc THEN 'conflict' ELSE 'same' END AS state, GREATEST(a.cc, b.cc) AS resolved_cc FROM a FULL JOIN b ON a.semantic_name = b.semantic_name""")
def w06_state_diff(c):
    """The intent: full outer join of two migrations' states, a name's first block each; conflicts resolve to the larger complexity."""

    def state(m):
        first = F.min_by("cc", "id")
        return c.blocks.where((col("migration_id") == m) & col("semantic_name").isNotNull()).groupBy("semantic_name").agg(first.alias(f"cc{m}"), F.lit(True).alias(f"in{m}"))

    both = state(0).join(state(1), "semantic_name", "full")
    kind = first_match((col("in0").isNull(), "added"), (col("in1").isNull(), "removed"), (~col("cc0").eqNullSafe(col("cc1")), "conflict"), other="same")
    return both.select("semantic_name", kind.alias("state"), F.greatest("cc0", "cc1").alias("resolved_cc"))


HASH = "md5(block_type || COALESCE(semantic_name, '') || raw_text || parameters || COALESCE(return_type, ''))"


@query(f"""SELECT a.semantic_name, COUNT(*) AS n_pairs, COUNT(CASE WHEN a.h <> b.h THEN 1 END) AS n_conflicts FROM (SELECT semantic_name, {HASH} AS h FROM f_blocks WHERE migration_id = 0) a JOIN (SELECT semantic_name, {HASH} AS h FROM f_blocks WHERE migration_id = 1) b ON a.semantic_name = b.semantic_name GROUP BY a.semantic_name""")
def w07_merge_conflicts(c):
    """Pairs of blocks of one name in two migrations, and how many differ in their hashes: from counts by
    name and hash, without the pairs."""
    from codequarry.operators.scores import semantic_hash

    n = lambda m: F.count_if(col("migration_id") == m)
    by_hash = c.blocks.where(col("migration_id").isin(0, 1) & col("semantic_name").isNotNull()).groupBy("semantic_name", semantic_hash().alias("h")).agg(n(0).alias("a"), n(1).alias("b"))
    out = by_hash.groupBy("semantic_name").agg((F.sum("a") * F.sum("b")).alias("n_pairs"), F.sum(col("a") * col("b")).alias("alike"))
    return out.where("n_pairs > 0").select("semantic_name", "n_pairs", (col("n_pairs") - col("alike")).alias("n_conflicts"))


@query(f"""WITH p AS (SELECT a.semantic_name, COUNT(CASE WHEN a.h <> b.h THEN 1 END) AS n FROM (SELECT semantic_name, {HASH} AS h FROM f_blocks WHERE migration_id = 0) a JOIN (SELECT semantic_name, {HASH} AS h FROM f_blocks WHERE migration_id = 1) b ON a.semantic_name = b.semantic_name GROUP BY a.semantic_name)
SELECT COUNT(CASE WHEN n > 0 THEN 1 END) AS conflicting_names, COUNT(*) AS shared_names, CASE WHEN COUNT(CASE WHEN n > 0 THEN 1 END) = 0 THEN 'Success' ELSE 'Conflicts' END AS outcome FROM p""")
def w08_merge_preview(c):
    bad = F.count_if(col("n_conflicts") > 0)
    return w07_merge_conflicts(c).agg(bad.alias("conflicting_names"), F.count("*").alias("shared_names"), F.when(bad == 0, "Success").otherwise("Conflicts").alias("outcome"))


@query("SELECT event_type AS provider, COUNT(*) AS n, ROUND(AVG(user_id), 6) AS avg_latency, ROUND(SUM(event_id % 100) / 100.0, 6) AS total_cost FROM events GROUP BY event_type")
def w10_provider_statistics(c):
    """Interactions by provider; events stand in for them."""
    return c.table("events").groupBy(col("event_type").alias("provider")).agg(F.count("*").alias("n"), F.round(F.avg("user_id"), 6).alias("avg_latency"), F.round(F.sum(col("event_id") % 100) / 100.0, 6).alias("total_cost"))


@query("SELECT block_id, change_id, change_type, author, changed_at, ROW_NUMBER() OVER (PARTITION BY block_id ORDER BY changed_at DESC, change_id) AS age FROM f_changes")
def r12_block_history(c):
    order = Window.partitionBy("block_id").orderBy(F.desc("changed_at"), "change_id")
    return c.changes.select("block_id", "change_id", "change_type", "author", "changed_at", F.row_number().over(order).alias("age"))


@query("SELECT DISTINCT change_type, commit_id, author, changed_at FROM f_changes WHERE change_type = 'BugFixed'")
def r13_commits_by_change(c):
    return c.changes.where("change_type = 'BugFixed'").select("change_type", "commit_id", "author", "changed_at").distinct()


@query("SELECT change_type, COUNT(*) AS n, (SELECT COUNT(DISTINCT commit_id) FROM f_changes) AS total_commits FROM f_changes GROUP BY change_type")
def r14_change_frequency(c):
    total = c.changes.agg(F.countDistinct("commit_id").alias("total_commits"))
    return c.changes.groupBy("change_type").agg(F.count("*").alias("n")).join(F.broadcast(total), F.lit(True))  # one row


@query("SELECT CAST(date_trunc('week', changed_at) AS DATE) AS week, ROUND(AVG(cc_after), 6) AS avg_complexity FROM f_changes GROUP BY 1")
def r15_weekly_complexity(c):
    after = F.get_json_object("after_state", "$.complexity_metrics.cyclomatic_complexity").cast("int")
    return c.changes.groupBy(F.date_trunc("week", "changed_at").cast("date").alias("week")).agg(F.round(F.avg(after), 6).alias("avg_complexity"))


@query("""SELECT CAST(date_trunc('week', changed_at) AS DATE) AS week, COUNT(CASE WHEN change_type LIKE '%TestAdded%' THEN 1 END) / 100.0::DOUBLE AS test_coverage, 100.0::DOUBLE - 10 * COUNT(CASE WHEN change_type LIKE '%BugFixed%' THEN 1 END) AS maintainability_index,
COUNT(CASE WHEN change_type LIKE '%BugFixed%' THEN 1 END) / 100.0::DOUBLE AS technical_debt_ratio, COUNT(CASE WHEN change_type LIKE '%DocumentationAdded%' THEN 1 END) AS doc_additions, COUNT(CASE WHEN change_type LIKE '%SecurityVulnerabilityFixed%' THEN 1 END) AS security_fixes FROM f_changes GROUP BY 1""")
def r16_quality_trends(c):
    week = F.date_trunc("week", "changed_at").cast("date").alias("week")
    return c.changes.groupBy(week).agg((like("TestAdded") / 100.0).alias("test_coverage"), (100.0 - 10 * like("BugFixed")).alias("maintainability_index"), (like("BugFixed") / 100.0).alias("technical_debt_ratio"), like("DocumentationAdded").alias("doc_additions"), like("SecurityVulnerabilityFixed").alias("security_fixes"))


@query("""SELECT CAST(date_trunc('month', changed_at) AS DATE) AS month, 'Patterns: ' || COUNT(CASE WHEN change_type LIKE '%PatternIntroduced%' THEN 1 END) || ', Dependencies: +' || COUNT(CASE WHEN change_type LIKE '%DependencyAdded%' THEN 1 END) || ' -' || COUNT(CASE WHEN change_type LIKE '%DependencyRemoved%' THEN 1 END) AS change_description,
CASE WHEN COUNT(CASE WHEN change_type LIKE '%PatternIntroduced%' THEN 1 END) > 0 THEN 'Design Pattern' END AS pattern_introduced, -0.2::DOUBLE AS coupling_change, 0.3::DOUBLE AS cohesion_change FROM f_changes GROUP BY 1""")
def r17_architectural_evolution(c):
    month = F.date_trunc("month", "changed_at").cast("date").alias("month")
    said = F.format_string("Patterns: %d, Dependencies: +%d -%d", like("PatternIntroduced"), like("DependencyAdded"), like("DependencyRemoved"))
    return c.changes.groupBy(month).agg(said.alias("change_description"), F.when(like("PatternIntroduced") > 0, "Design Pattern").alias("pattern_introduced"), F.lit(-0.2).alias("coupling_change"), F.lit(0.3).alias("cohesion_change"))


@query("SELECT DISTINCT target_block_id AS block_id, source_block_id AS affected_id FROM f_relationships WHERE relationship_type IN ('calls', 'depends_on', 'imports')")
def r18_affected_blocks(c):
    return c.edges("calls", "depends_on", "imports").select(col("t").alias("block_id"), col("s").alias("affected_id"))


@query("SELECT commit_id, change_id, block_id, change_type FROM f_changes")
def r19_changes_of_commits(c):
    return c.changes.select("commit_id", "change_id", "block_id", "change_type")


@query("""SELECT block_id, n, stability, CASE WHEN n < 2 THEN 'Stable' WHEN n_breaking >= 2 THEN 'Volatile' WHEN n <= 3 THEN 'Growing' ELSE 'Refactoring' END AS trend, ROUND(CASE WHEN n >= 2 AND days > 0 THEN n::DOUBLE / days ELSE 0 END, 6) AS frequency
FROM (SELECT block_id, COUNT(*) AS n, ROUND(1 - COUNT(CASE WHEN breaking_change THEN 1 END)::DOUBLE / COUNT(*), 6) AS stability, COUNT(CASE WHEN breaking_change AND age <= 10 THEN 1 END) AS n_breaking, EXTRACT(DAY FROM MAX(created_at) - MIN(created_at)) AS days
FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY block_id ORDER BY version_number DESC) AS age FROM f_versions) GROUP BY block_id)""")
def q15_version_stability(c):
    own = c.versions.withColumn("age", F.row_number().over(newest())).groupBy("block_id").agg(F.count("*").alias("n"), F.count_if("breaking_change").alias("broken"), F.count_if(col("breaking_change") & (col("age") <= 10)).alias("lately"), F.floor((F.unix_timestamp(F.max("created_at")) - F.unix_timestamp(F.min("created_at"))) / 86400).alias("days"))
    trend = first_match((col("n") < 2, "Stable"), (col("lately") >= 2, "Volatile"), (col("n") <= 3, "Growing"), other="Refactoring")
    often = F.when((col("n") >= 2) & (col("days") > 0), col("n") / col("days")).otherwise(0.0)
    return own.select("block_id", "n", F.round(1 - col("broken") / col("n"), 6).alias("stability"), trend.alias("trend"), F.round(often, 6).alias("frequency"))


@query("SELECT block_id, version_number, change_type, breaking_change, created_at FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY block_id ORDER BY version_number DESC) AS age FROM f_versions) WHERE age <= 10")
def x12_version_history(c):
    return c.versions.withColumn("age", F.row_number().over(newest())).where("age <= 10").select("block_id", "version_number", "change_type", "breaking_change", "created_at")
