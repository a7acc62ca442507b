"""Diffs and merges of texts, and merges of branches in a version tree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codequarry.functions import merging
from codequarry.operators.graph import union
from codequarry.operators.scores import L, P, lines, pairs
from codequarry.plans.lineage import written
from codequarry.plans.registry import query

col = F.col


@query(f"""WITH {P}, l AS (SELECT id, {L.format('a')} AS x, {L.format('b')} AS y FROM p), d AS (SELECT id, x, y, list_reduce(list_prepend(list_transform(range(len(y) + 1), lambda j: 0), list_transform(x, lambda z: list_prepend(-1, list_transform(y, lambda w: CAST(w = z AS INT))))),
lambda prev, eq: list_reduce(list_prepend([0], list_transform(range(1, len(eq)), lambda j: [j])), lambda acc, j: list_append(acc, CASE WHEN eq[j[1] + 1] = 1 THEN prev[j[1]] + 1 ELSE GREATEST(prev[j[1] + 1], acc[j[1]]) END))) AS row FROM l)
SELECT id, row[-1] AS n_same, len(x) - row[-1] AS n_deleted, len(y) - row[-1] AS n_inserted, TRUE AS replays FROM d""")
def w11_document_diffs(c):
    """A least edit script from every document to the next, line by line."""
    return merging.diffs(pairs(c).select("id", lines("a").alias("a"), lines("b").alias("b"))).drop("edits")


def numbered(text: str) -> Column:
    """Lines, each behind its number."""
    return F.transform(lines(text), lambda x, i: F.concat(i.cast("string"), F.lit(": "), x))


@query(f"""WITH t AS (SELECT doc_id AS id, list_transform({L.format('t')}, lambda x, i: (i - 1) || ': ' || x) AS base FROM (SELECT doc_id, COALESCE(text, '') AS t FROM documents)), l AS (SELECT id, unnest(range(len(base))) AS k, unnest(base) AS line FROM t),
x AS (SELECT *, k % 7 = 3 AS changed, k % 5 = 2 AS dropped FROM l), g AS (SELECT *, k - ROW_NUMBER() OVER (PARTITION BY id ORDER BY k) AS run FROM x WHERE changed OR dropped), r AS (SELECT id, run, bool_or(changed) AND bool_or(dropped) AS conflict FROM g GROUP BY id, run),
m AS (SELECT x.id, x.k, CASE WHEN r.conflict IS NULL OR r.conflict THEN x.line WHEN x.changed THEN 'ours ' || x.line END AS line FROM x LEFT JOIN g ON g.id = x.id AND g.k = x.k LEFT JOIN r ON r.id = g.id AND r.run = g.run)
SELECT t.id, COALESCE((SELECT string_agg(line, chr(10) ORDER BY k) FROM m WHERE m.id = t.id AND line IS NOT NULL), '') AS merged, (SELECT COUNT(*) FROM r WHERE r.id = t.id AND conflict) AS n_conflicts FROM t""")
def w11_three_way_merges(c):
    """Of every document (its lines numbered): the merge of a copy in which some lines are changed and one in which some are dropped; where both meet there is a conflict."""
    base = c.table("documents").select(col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("text")).select("id", numbered("text").alias("base"))
    ours = F.transform("base", lambda x, i: F.when(i % 7 == 3, F.concat(F.lit("ours "), x)).otherwise(x))
    theirs = F.filter("base", lambda x, i: i % 5 != 2)
    return merging.merges(base.select("id", "base", ours.alias("ours"), theirs.alias("theirs"))).select("id", F.array_join("merged", "\n").alias("merged"), F.size("conflicts").cast("long").alias("n_conflicts"))


def ancestors(tree: DataFrame) -> list[DataFrame]:
    """Tables (id, up) of the ancestors 1, 2, 4, 8, ... steps above, while there are any; of tree (id, parent)."""
    table = written(tree.where("parent IS NOT NULL").select("id", col("parent").alias("up")), "up")
    out = []
    while not table.isEmpty():
        out.append(table)
        table = written(table.join(table.select(col("id").alias("up"), col("up").alias("further")), "up").select("id", col("further").alias("up")), "up")
    return out


def depths(tree: DataFrame, tables: list[DataFrame]) -> DataFrame:
    """id and depth: the edges up to the root, put together from the largest steps down."""
    own = tree.select("id", col("id").alias("at"), F.lit(0).cast("long").alias("depth"))
    for k in reversed(range(len(tables))):
        step = tables[k].select(col("id").alias("at"), "up")
        own = written(own.join(step, "at", "left").select("id", F.coalesce("up", "at").alias("at"), (col("depth") + F.when(col("up").isNotNull(), 1 << k).otherwise(0)).alias("depth")), "depth")
    return own.select("id", "depth")


def merge_bases(tree: DataFrame, pairs: DataFrame) -> DataFrame:
    """ours, theirs and base: the lowest common ancestor (either of them if it is above the other; null in different trees) of pairs of versions; as many joins as the depth has binary digits."""
    tables = ancestors(tree)
    depth = written(depths(tree, tables), "depths")
    level = lambda x: depth.select(col("id").alias(x), col("depth").alias(f"{x}_depth"))
    at = pairs.select("ours", "theirs").distinct().join(level("ours"), "ours").join(level("theirs"), "theirs")
    deep = col("ours_depth") > col("theirs_depth")
    at = at.select("ours", "theirs", F.when(deep, col("ours")).otherwise(col("theirs")).alias("x"), F.when(deep, col("theirs")).otherwise(col("ours")).alias("y"), F.abs(col("ours_depth") - col("theirs_depth")).alias("left"))
    for k in reversed(range(len(tables))):  # the deeper one up to the other's depth
        at = written(at.join(tables[k].select(col("id").alias("x"), "up"), "x", "left").select("ours", "theirs", F.when(col("left") >= (1 << k), col("up")).otherwise(col("x")).alias("x"), "y", F.when(col("left") >= (1 << k), col("left") - (1 << k)).otherwise(col("left")).alias("left")), "level")
    for k in reversed(range(len(tables))):  # both up, while they stay apart
        up = lambda x, k=k: tables[k].select(col("id").alias(x), col("up").alias(f"{x}_up"))
        apart = F.coalesce(col("x_up") != col("y_up"), F.lit(False)) & (col("x") != col("y"))
        at = written(at.join(up("x"), "x", "left").join(up("y"), "y", "left").select("ours", "theirs", F.when(apart, col("x_up")).otherwise(col("x")).alias("x"), F.when(apart, col("y_up")).otherwise(col("y")).alias("y")), "apart")
    if not tables:
        return at.select("ours", "theirs", F.when(col("x") == col("y"), col("x")).alias("base"))
    up = lambda x: tables[0].select(col("id").alias(x), col("up").alias(f"{x}_up"))
    base = F.when(col("x") == col("y"), col("x")).when(col("x_up") == col("y_up"), col("x_up"))
    return at.join(up("x"), "x", "left").join(up("y"), "y", "left").select("ours", "theirs", base.alias("base"))


def changes_since(tree: DataFrame, ends: DataFrame) -> DataFrame:
    """key, block_id and change_type of the versions from below base up to id; of ends (key, id, base). One round a step of the longest branch."""
    edges = written(tree.select("id", "parent", "block_id", "change_type"), "tree")
    out, at = [], ends.where("id <> base")
    while True:
        at = written(at.join(edges, "id").select("key", "id", "base", "parent", "block_id", "change_type"), "branch")
        out.append(at.select("key", "block_id", "change_type"))
        at = at.where("parent <> base").select("key", col("parent").alias("id"), "base")
        if at.isEmpty():
            return union(out).distinct()


BRANCHES = """WITH RECURSIVE pair AS (SELECT id AS ours, id + 7 AS theirs FROM f_tree WHERE id % 10 = 1 AND id + 7 IN (SELECT id FROM f_tree)), up AS (SELECT id, id AS above, 0 AS d FROM f_tree UNION ALL SELECT up.id, t.parent, d + 1 FROM up JOIN f_tree t ON t.id = up.above WHERE t.parent IS NOT NULL),
base AS (SELECT p.ours, p.theirs, arg_min(a.above, a.d) AS base FROM pair p JOIN up a ON a.id = p.ours JOIN up b ON b.id = p.theirs AND b.above = a.above GROUP BY p.ours, p.theirs),
mine AS (SELECT DISTINCT b.ours, t.block_id, t.change_type FROM base b JOIN up u ON u.id = b.ours JOIN f_tree t ON t.id = u.above WHERE u.d < (SELECT d FROM up z WHERE z.id = b.ours AND z.above = b.base)),
other AS (SELECT DISTINCT b.ours, t.block_id, t.change_type FROM base b JOIN up u ON u.id = b.theirs JOIN f_tree t ON t.id = u.above WHERE u.d < (SELECT d FROM up z WHERE z.id = b.theirs AND z.above = b.base))"""


def branch_pairs(c) -> DataFrame:
    """Every tenth version and the one seven later."""
    ids = c.version_tree.select("id")
    ours = ids.where("id % 10 = 1").select(col("id").alias("ours"), (col("id") + 7).alias("theirs"))
    return ours.join(ids.select(col("id").alias("theirs")), "theirs", "left_semi")


@query(BRANCHES + """ SELECT b.ours, b.theirs, b.base, (SELECT COUNT(*) FROM (SELECT DISTINCT m.block_id FROM mine m JOIN other o ON o.ours = m.ours AND o.block_id = m.block_id AND o.change_type <> m.change_type WHERE m.ours = b.ours)) AS n_conflicts, 'rollback/' || b.theirs AS rollback_branch, b.base AS rollback_to FROM base b""")
def x14_branch_merges(c):
    """The base of every pair of branches, the blocks that both have changed since in different ways, and the branch that takes the merge back."""
    found = written(merge_bases(c.version_tree, branch_pairs(c)), "bases")
    side = lambda x: changes_since(c.version_tree, found.select(col("ours").alias("key"), col(x).alias("id"), "base"))
    mine, other = side("ours"), side("theirs").withColumnRenamed("change_type", "other_type")
    both = mine.join(other, ["key", "block_id"]).where("change_type <> other_type").groupBy(col("key").alias("ours")).agg(F.countDistinct("block_id").alias("n_conflicts"))
    return found.join(both, "ours", "left").fillna(0, ["n_conflicts"]).select("ours", "theirs", "base", "n_conflicts", F.concat(F.lit("rollback/"), col("theirs").cast("string")).alias("rollback_branch"), col("base").alias("rollback_to"))
