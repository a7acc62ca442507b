"""Similarity of texts, completeness and quality scores.

Pairs of an original and a regenerated text are neighbours by id (documents i and i + 1), found by
one join on the id.
"""

from __future__ import annotations

from functools import reduce
from operator import add, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codequarry.functions import python_source
from codequarry.operators.graph import modifiers
from codequarry.operators.screens import first_match
from codequarry.plans.registry import query
from codequarry.sources.code import Code

col = F.col
WHITE = r"[\x20\x09-\x0D]+"


def words(text: str | Column) -> Column:
    return F.array_remove(F.split(text, WHITE), "")


def lines(text: str) -> Column:
    """As a reader of lines sees them: a last line end begins none."""
    own = F.split(text, "\n")
    return F.when(col(text).endswith("\n") | (col(text) == ""), F.slice(own, 1, F.size(own) - 1)).otherwise(own)


def pairs(c: Code) -> DataFrame:
    """id, a and b: every document's text and its follower's."""
    docs = c.table("documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return docs.select(col("doc_id").alias("id"), col("text").alias("a")).join(docs.select((col("doc_id") - 1).alias("id"), col("text").alias("b")), "id")


def ratio(part: Column, whole: Column, none: float | Column = 0.0) -> Column:
    return F.round(F.when(whole == 0, none).otherwise(part / whole), 6)


def solid(text: str) -> Column:
    """Characters that are not white."""
    return F.length(F.regexp_replace(text, WHITE, ""))


P = "p AS (SELECT x.doc_id AS id, COALESCE(x.text, '') AS a, COALESCE(y.text, '') AS b FROM documents x JOIN documents y ON y.doc_id = x.doc_id + 1)"
W = r"list_filter(regexp_split_to_array({}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"
L = "CASE WHEN {0} = '' OR ends_with({0}, chr(10)) THEN string_split({0}, chr(10))[:-2] ELSE string_split({0}, chr(10)) END"
TRIM = r"regexp_replace({}, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g')"
S = r"length(regexp_replace({}, '[\x20\x09-\x0D]+', '', 'g'))"


@query(f"""WITH {P}, w AS (SELECT id, list_distinct({W.format('a')}) AS x, list_distinct({W.format('b')}) AS y FROM p)
SELECT id, ROUND(CASE WHEN len(x) = 0 AND len(y) = 0 THEN 1 WHEN len(x) = 0 OR len(y) = 0 THEN 0 ELSE len(list_intersect(x, y))::DOUBLE / len(list_distinct(list_concat(x, y))) END, 6) AS fidelity FROM w""")
def q01_fidelity(c):
    own = pairs(c).select("id", F.array_distinct(words("a")).alias("x"), F.array_distinct(words("b")).alias("y"))
    return own.select("id", ratio(F.size(F.array_intersect("x", "y")), F.size(F.array_union("x", "y")), 1.0).alias("fidelity"))


@query(f"WITH {P} SELECT id, ROUND(CASE WHEN a = '' THEN CASE WHEN b = '' THEN 1 ELSE 0 END WHEN {S.format('a')} = 0 THEN 1 ELSE LEAST(1, {S.format('b')}::DOUBLE / {S.format('a')}) END, 6) AS coverage FROM p")
def q02_coverage(c):
    share = F.when(col("a") == "", (col("b") == "").cast("double")).when(solid("a") == 0, 1.0).otherwise(F.least(F.lit(1.0), solid("b") / solid("a")))
    return pairs(c).select("id", F.round(share, 6).alias("coverage"))


def trimmed(x: Column) -> Column:
    return F.regexp_replace(x, r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "")


def line_match(x: str, y: str) -> Column:
    same = F.size(F.filter(F.zip_with(x, y, lambda p, q: p == q), lambda z: F.coalesce(z, F.lit(False))))
    longest = F.greatest(F.size(x), F.size(y))
    return F.round(F.when(F.least(F.size(x), F.size(y)) == 0, (longest == 0).cast("double")).otherwise(same / longest), 6)


MATCH = "ROUND(CASE WHEN LEAST(len(x), len(y)) = 0 THEN CASE WHEN len(x) = len(y) THEN 1 ELSE 0 END ELSE len(list_filter(range(1, LEAST(len(x), len(y)) + 1), lambda i: x[i] = y[i]))::DOUBLE / GREATEST(len(x), len(y)) END, 6)"


@query(f"WITH {P}, l AS (SELECT id, list_transform({L.format('a')}, lambda z: {TRIM.format('z')}) AS x, list_transform({L.format('b')}, lambda z: {TRIM.format('z')}) AS y FROM p) SELECT id, {MATCH} AS line_similarity FROM l")
def q03_line_similarity(c):
    own = pairs(c).select("id", *(F.transform(lines(k), trimmed).alias(v) for k, v in (("a", "x"), ("b", "y"))))
    return own.select("id", line_match("x", "y").alias("line_similarity"))


@query(f"WITH {P}, l AS (SELECT id, list_filter(list_transform({L.format('a')}, lambda z: {TRIM.format('z')}), lambda z: z <> '') AS x, list_filter(list_transform({L.format('b')}, lambda z: {TRIM.format('z')}), lambda z: z <> '') AS y FROM p) SELECT id, {MATCH} AS line_similarity FROM l")
def q04_solid_line_similarity(c):
    own = pairs(c).select("id", *(F.array_remove(F.transform(lines(k), trimmed), "").alias(v) for k, v in (("a", "x"), ("b", "y"))))
    return own.select("id", line_match("x", "y").alias("line_similarity"))


#: Quality of b as a regenerated a, from p (id, a, b).
QUALITY = f"""l AS (SELECT id, len(list_filter({L.format('a')}, lambda z: {TRIM.format('z')} <> '')) AS n, len(list_filter({L.format('b')}, lambda z: {TRIM.format('z')} <> '')) AS m, {W.format('a')} AS x, {W.format('b')} AS y FROM p),
q AS (SELECT id, ROUND(CASE WHEN n = 0 THEN CASE WHEN m = 0 THEN 1 ELSE 0 END ELSE 0.3 * LEAST(m::DOUBLE / n, CASE WHEN m = 0 THEN 0 ELSE n::DOUBLE / m END) + 0.7 * len(list_filter(x, lambda w: list_contains(y, w)))::DOUBLE / len(x) END, 6) AS quality FROM l)"""


def counted() -> list[Column]:
    """n and m, the lines of a and b that are not blank, and tokens, those of a."""
    full = lambda k: F.size(F.array_remove(F.transform(lines(k), trimmed), ""))
    return [full("a").alias("n"), full("b").alias("m"), F.size(words("a")).alias("tokens")]


def rated(found: Column) -> Column:
    """Quality from what counted() counts and the number of a's tokens found in b."""
    by_line = F.when(col("m") == 0, 0.0).otherwise(F.least(col("m") / col("n"), col("n") / col("m")))
    return F.round(F.when(col("n") == 0, (col("m") == 0).cast("double")).otherwise(0.3 * by_line + 0.7 * found / col("tokens")), 6)


def quality(both: DataFrame) -> DataFrame:
    """id and quality of b as a regenerated a. Tokens are dealt once, with how many times each side has them; texts are not."""
    own = both.select("id", *counted())
    sides = both.select("id", F.explode(F.concat(F.transform(words("a"), lambda w: F.struct(w.alias("token"), F.lit(1).alias("x"), F.lit(0).alias("y"))), F.transform(F.array_distinct(words("b")), lambda w: F.struct(w.alias("token"), F.lit(0).alias("x"), F.lit(1).alias("y"))))).alias("w"))
    found = sides.groupBy("id", "w.token").agg(F.sum("w.x").alias("x"), F.max("w.y").alias("y")).groupBy("id").agg(F.sum(col("x") * col("y")).alias("found"))
    return own.join(found, "id", "left").select("id", rated(F.coalesce("found", F.lit(0))).alias("quality"))


@query(f"WITH {P}, {QUALITY} SELECT id, quality FROM q")
def q05_reconstruction_quality(c):
    return quality(pairs(c))


VARIANCE = f"CASE WHEN GREATEST({S.format('a')}, {S.format('b')}) = 0 THEN 0 ELSE ABS({S.format('a')} - {S.format('b')})::DOUBLE / GREATEST({S.format('a')}, {S.format('b')}) END"


def variance() -> Column:
    """By how much the visible characters of a and b differ in number."""
    return ratio(F.abs(solid("a") - solid("b")), F.greatest(solid("a"), solid("b")))


@query(f"WITH {P} SELECT id, ROUND({VARIANCE}, 6) AS variance FROM p")
def q06_formatting_variance(c):
    return pairs(c).select("id", variance().alias("variance"))


def round_trips(c: Code, *figures: Column) -> DataFrame:
    """path, migration_id, parses and same of python_source.rebuilt, and figures of a (a Python file's text), b (the text generated from its blocks) and kept (a's tokens that stand in b);
    a and b themselves, if no figures are given.

    Files are rebuilt once and the figures taken in a file's own row, so that no text meets a shuffle after that."""
    made = python_source.rebuilt(c.files.where("language = 'python'").select("path", "content")).withColumnsRenamed({"original": "a", "generated": "b"})
    home = c.containers.select(col("id").cast("string").alias("path"), "migration_id")
    return made.select("path", "parses", "same", *(figures or (col("a"), col("b")))).join(home, "path")


@query(f"""WITH p AS (SELECT path AS id, a, b FROM f_rebuilt), {QUALITY}, f AS (SELECT r.migration_id AS id, 100.0 * AVG(CASE WHEN n = 0 AND d = 0 THEN 1 ELSE 0 END) AS accuracy, AVG(CASE WHEN quality >= 0.7 THEN 1 ELSE 0 END) >= 0.5 AS rebuilt, AVG(ROUND({VARIANCE}, 6)) <= 0.3 AS formatted FROM f_rebuilt r JOIN q ON q.id = r.path GROUP BY r.migration_id)
SELECT id, ROUND(0.4 * accuracy + CASE WHEN rebuilt THEN 20 ELSE 0 END + CASE WHEN formatted THEN 15 ELSE 0 END + CASE WHEN (SELECT COUNT(source_code) FROM f_containers k WHERE k.migration_id = f.id) = 0 THEN 15 ELSE 0 END
+ CASE WHEN (SELECT AVG(cc) FROM f_blocks b WHERE b.migration_id = f.id) <= (SELECT AVG(cc) FROM f_blocks) THEN 10 ELSE 0 END, 6)::DOUBLE AS score FROM f""")
def q07_success_score(c):
    """Of every migration: 0.4 of its round-trip accuracy; 20 if half of its files are rebuilt at a quality of 0.7, 15 if their formatting varies by 0.3 at most on average,
    15 if no source is left, 10 if its blocks are no more complex than all blocks on average."""
    trips = round_trips(c, *counted(), col("kept"), variance().alias("variance")).withColumn("quality", rated(col("kept")))
    f = trips.groupBy(col("migration_id").alias("id")).agg((100.0 * F.avg(col("same").cast("int"))).alias("accuracy"), (F.avg((col("quality") >= 0.7).cast("int")) >= 0.5).alias("rebuilt"), (F.avg("variance") <= 0.3).alias("formatted"))
    left = c.containers.groupBy(col("migration_id").alias("id")).agg(F.count("source_code").alias("sources"))
    each = c.own_blocks.groupBy("container_id").agg(F.sum("cc").alias("cc"), F.count("cc").alias("n"))
    cost = each.join(c.containers.select(col("id").alias("container_id"), col("migration_id").alias("id")), "container_id").groupBy("id").agg(F.sum("cc").alias("cc"), F.sum("n").alias("n"))
    base = F.broadcast(cost.agg(F.try_divide(F.sum("cc"), F.sum("n")).alias("base")))  # one row
    cost = cost.join(base, F.lit(True)).select("id", (F.try_divide("cc", "n") <= col("base")).alias("no_regression"))
    flags = (("rebuilt", 20), ("formatted", 15), ("no_regression", 10))
    score = 0.4 * col("accuracy") + reduce(add, (F.when(col(k), n).otherwise(0) for k, n in flags)) + F.when(col("sources") == 0, 15).otherwise(0)
    return f.join(left, "id").join(cost, "id").select("id", F.round(score, 6).alias("score"))


def syntax_problems(text: Column, language: Column) -> tuple[Column, Column]:
    """Numbers of errors and of warnings by the rules of a language."""
    has = text.contains
    lacks = lambda word, mark: (has(word) & ~has(mark)).cast("int")
    own = F.split(text, "\n")
    loose = F.size(F.filter(F.transform(own, F.trim), lambda x: (x.startswith("let ") | x.startswith("const ") | x.startswith("var ")) & ~x.endswith(";") & ~x.endswith("{")))
    follows = F.transform(own, lambda x, i: F.struct(F.ltrim(x).alias("x"), F.get(own, i + 1).alias("y")))
    flat = F.size(F.filter(follows, lambda p: (p["x"].startswith("def ") | p["x"].startswith("class ")) & p["y"].isNotNull() & ~p["y"].startswith("    ") & (F.trim(p["y"]) != "")))
    js = language.isin("javascript", "typescript")
    empty = (F.trim(text) == "").cast("int")
    errors = F.when(language == "rust", lacks("fn ", "{") + lacks("struct ", "{")).when(language == "python", lacks("def ", ":") + lacks("class ", ":")).when(js, lacks("function ", "{") + lacks("class ", "{")).otherwise(0)
    warnings = F.when(language == "rust", lacks("let ", ";")).when(language == "python", flat).when(js, loose).otherwise(1)
    return errors + empty, warnings


LACKS = "(CASE WHEN contains(raw_text, '{}') AND NOT contains(raw_text, '{}') THEN 1 ELSE 0 END)".format


@query(f"""SELECT id, CASE language WHEN 'rust' THEN {LACKS('fn ', '{')} + {LACKS('struct ', '{')} WHEN 'python' THEN {LACKS('def ', ':')} + {LACKS('class ', ':')} WHEN 'javascript' THEN {LACKS('function ', '{')} + {LACKS('class ', '{')} WHEN 'typescript' THEN {LACKS('function ', '{')} + {LACKS('class ', '{')} ELSE 0 END AS n_errors,
CASE WHEN language = 'rust' THEN {LACKS('let ', ';')} WHEN language IN ('python', 'javascript', 'typescript') THEN 0 ELSE 1 END AS n_warnings FROM f_blocks""")
def q08_syntax(c):
    """The adapter's texts are single lines, so that the rules over neighbouring lines are tested apart."""
    errors, warnings = syntax_problems(col("raw_text"), F.coalesce("language", F.lit("")))
    return c.blocks.select("id", errors.alias("n_errors"), warnings.alias("n_warnings"))


@query(f"WITH {P}, w AS (SELECT id, list_distinct({W.format('a')}) AS x, list_distinct({W.format('b')}) AS y FROM p), f AS (SELECT id, CASE WHEN len(x) = 0 AND len(y) = 0 THEN 1 WHEN len(x) = 0 OR len(y) = 0 THEN 0 ELSE ROUND(len(list_intersect(x, y))::DOUBLE / len(list_distinct(list_concat(x, y))), 6) END AS f FROM w) SELECT COUNT(*) AS n, ROUND(AVG(f), 5) AS mean_fidelity, bool_and(f > 0) AS all_alike, COUNT(CASE WHEN f >= 0.8 THEN 1 END) AS n_faithful FROM f")
def q09_aggregate_validations(c):
    f = col("fidelity")
    return q01_fidelity(c).agg(F.count("*").alias("n"), F.round(F.avg(f), 5).alias("mean_fidelity"), F.bool_and(f > 0).alias("all_alike"), F.count_if(f >= 0.8).alias("n_faithful"))


@query("SELECT container_id, ROUND(AVG(CASE WHEN semantic_name IS NOT NULL AND body_ast IS NOT NULL THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS enhancement, AVG(CASE WHEN cc IS NULL THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END) >= 0.7 AND COUNT(semantic_name)::DOUBLE / COUNT(*) >= 0.8 AS passes FROM f_blocks GROUP BY container_id")
def q10_q11_gates(c):
    """Share of named blocks with an AST, and the gate: 0.7 of blocks measured and 0.8 named."""
    both = (col("semantic_name").isNotNull() & col("body_ast").isNotNull()).cast("double")
    return c.blocks.groupBy("container_id").agg(F.round(F.avg(both), 6).alias("enhancement"), ((F.count("cc") / F.count("*") >= 0.7) & (F.count("semantic_name") / F.count("*") >= 0.8)).alias("passes"))


@query("SELECT container_id, block_type, COUNT(*) AS n, ROUND(1.2 * COUNT(*), 6)::DOUBLE AS complexity FROM f_blocks GROUP BY container_id, block_type")
def q12_block_histogram(c):
    return c.blocks.groupBy("container_id", "block_type").agg(F.count("*").alias("n"), F.round(1.2 * F.count("*"), 6).alias("complexity"))


@query(f"""WITH t AS (SELECT id, source_code AS s, len({L.format('source_code')}) AS n, (length(source_code) - length(replace(source_code, 'return', ''))) / 6 AS todo FROM f_containers WHERE source_code IS NOT NULL)
SELECT id, ROUND(CASE WHEN todo = 0 THEN 1 ELSE 1 - LEAST(1, todo::DOUBLE / n) END, 6) AS completeness, CASE WHEN contains(s, 'todo!()') OR contains(s, 'pass') THEN 0.5::DOUBLE ELSE 0.8::DOUBLE END AS correctness, CASE WHEN n > 100 THEN 0.6::DOUBLE ELSE 0.8::DOUBLE END AS maintainability, 0.7::DOUBLE AS performance FROM t""")
def q13_synthesis_metrics(c):
    return c.containers.where("source_code IS NOT NULL").select("id", *synthesis_metrics("source_code", "return"))


def synthesis_metrics(code: str, mark: str = "TODO") -> list[Column]:
    """Scores of generated code; mark: what stands for work left open."""
    n, left = F.size(lines(code)), F.regexp_count(code, F.lit(mark))
    return [
        F.round(F.when(left == 0, 1.0).otherwise(1 - F.least(F.lit(1.0), left / n)), 6).alias("completeness"),
        F.when(col(code).contains("todo!()") | col(code).contains("pass"), 0.5).otherwise(0.8).alias("correctness"),
        F.when(n > 100, 0.6).otherwise(0.8).alias("maintainability"),
        F.lit(0.7).alias("performance"),
    ]


@query("SELECT id, ROUND(1 + 0.1 * n_params + 0.05 * CASE WHEN starts_with(lower(raw_text), 'async ') THEN 1 ELSE 0 END + 0.1 * indent + 0.2 * COALESCE(cc, 0), 6)::DOUBLE AS score FROM f_blocks")
def q14_context_complexity(c):
    return c.blocks.select("id", F.round(1 + 0.1 * col("n_params") + 0.05 * modifiers() + 0.1 * col("indent") + 0.2 * F.coalesce("cc", F.lit(0)), 6).alias("score"))


def contains_any(text: Column, *parts: str) -> Column:
    return reduce(or_, (text.contains(p) for p in parts))


def patterns(text: Column, name: Column) -> Column:
    """Architectural patterns of a block as an array of (pattern, confidence)."""
    has = lambda *x: contains_any(text, *x)
    single = has("private") & has("constructor", "__init__") & has("static") & has("instance", "_instance") & has("getInstance", "get_instance")
    made = has("create", "make", "build") | F.coalesce(F.lower(name).contains("factory"), F.lit(False))
    factory = made & (has("return new") | (has("return ") & (F.regexp_count(text, F.lit("return")) > 1)))
    observer = has("addObserver", "removeObserver", "notifyObservers", "subscribe", "unsubscribe", "notify") & (has("observers", "listeners", "subscribers") | has("update", "onNotify", "handleEvent"))
    hit = lambda cond, kind, sure: F.when(cond, F.struct(F.lit(kind).alias("pattern"), F.lit(sure).alias("confidence")))
    return F.array_compact(F.array(hit(single, "Singleton", 0.8), hit(factory, "Factory", 0.7), hit(observer, "Observer", 0.75)))


@query("""SELECT id, 'Singleton' AS pattern, 0.8::DOUBLE AS confidence FROM f_samples WHERE contains(t, 'private') AND (contains(t, 'constructor') OR contains(t, '__init__')) AND contains(t, 'static') AND contains(t, 'instance') AND (contains(t, 'getInstance') OR contains(t, 'get_instance'))
UNION ALL SELECT id, 'Factory', 0.7 FROM f_samples WHERE (contains(t, 'create') OR contains(t, 'make') OR contains(t, 'build') OR contains(lower(name), 'factory')) AND (contains(t, 'return new') OR contains(t, 'return ') AND length(t) - length(replace(t, 'return', '')) > 6)
UNION ALL SELECT id, 'Observer', 0.75 FROM f_samples WHERE (contains(t, 'addObserver') OR contains(t, 'removeObserver') OR contains(t, 'subscribe') OR contains(t, 'notify')) AND (contains(t, 'observers') OR contains(t, 'listeners') OR contains(t, 'subscribers') OR contains(t, 'update') OR contains(t, 'onNotify') OR contains(t, 'handleEvent'))""")
def q16_patterns(c):
    return c.samples.select("id", F.inline(patterns(col("text"), col("name"))))


def solid_violation(text: Column) -> Column:
    """The first of two principles that a text violates, or null."""
    n = lambda *x: reduce(add, (F.regexp_count(text, F.lit(w)) for w in x))
    return F.when((n("def ", "function ", "fn ") > 15) & text.contains("class "), "Single Responsibility Principle").when(n("if ", "switch ", "match ") > 10, "Open/Closed Principle")


COUNT = "((length(t) - length(replace(t, '{0}', ''))) // {1})".format


@query(f"""SELECT * FROM (SELECT id, CASE WHEN {COUNT('def ', 4)} + {COUNT('function ', 9)} + {COUNT('fn ', 3)} > 15 AND contains(t, 'class ') THEN 'Single Responsibility Principle' WHEN {COUNT('if ', 3)} + {COUNT('switch ', 7)} + {COUNT('match ', 6)} > 10 THEN 'Open/Closed Principle' END AS violation FROM f_samples) WHERE violation IS NOT NULL""")
def q17_solid(c):
    return c.samples.select("id", solid_violation(col("text")).alias("violation")).where("violation IS NOT NULL")


@query("""SELECT id, CASE WHEN contains(semantic_name, 'User') OR contains(semantic_name, 'Account') THEN 'User Management' WHEN contains(semantic_name, 'Order') OR contains(semantic_name, 'Payment') THEN 'E-commerce' WHEN contains(semantic_name, 'Auth') OR contains(semantic_name, 'Security') THEN 'Security' ELSE 'General' END AS domain,
array_to_string(list_filter([CASE WHEN contains(lower(semantic_name), 'user') THEN 'User' END, CASE WHEN contains(lower(semantic_name), 'order') THEN 'Order' END, CASE WHEN contains(lower(semantic_name), 'payment') THEN 'Payment' END, CASE WHEN contains(lower(semantic_name), 'product') THEN 'Product' END], lambda x: x IS NOT NULL), ',') AS concepts,
CASE WHEN contains(original_path, '/user/') THEN 'User Context' WHEN contains(original_path, '/order/') THEN 'Order Context' END AS bounded_context FROM f_blocks""")
def q19_domains(c):
    name = col("semantic_name")
    has = lambda *x: F.coalesce(contains_any(name, *x), F.lit(False))
    concepts = F.array_compact(F.array(*(F.when(F.lower(name).contains(x.lower()), x) for x in ("User", "Order", "Payment", "Product"))))
    context = F.when(col("original_path").contains("/user/"), "User Context").when(col("original_path").contains("/order/"), "Order Context")
    return c.blocks.select("id", first_match((has("User", "Account"), "User Management"), (has("Order", "Payment"), "E-commerce"), (has("Auth", "Security"), "Security"), other="General").alias("domain"), F.array_join(concepts, ",").alias("concepts"), context.alias("bounded_context"))


@query("""SELECT id, n, CASE WHEN n <= 2 THEN 'Simple' WHEN n <= 5 THEN 'Moderate' WHEN n <= 8 THEN 'Complex' ELSE 'VeryComplex' END AS level FROM (SELECT id, CASE WHEN n_params > 5 THEN 2 ELSE 0 END + CASE WHEN cc > 10 THEN 3 ELSE 0 END + CASE WHEN indent >= 3 THEN 2 ELSE 0 END + CASE WHEN starts_with(lower(raw_text), 'async ') THEN 1 ELSE 0 END AS n FROM f_blocks)""")
def q20_abstraction_complexity(c):
    """Complexity stands in for the number of behaviours, indentation for invariants."""
    point = lambda cond, n: F.when(cond, n).otherwise(0)
    n = point(col("n_params") > 5, 2) + point(col("cc") > 10, 3) + point(col("indent") >= 3, 2) + modifiers()
    return c.blocks.select("id", n.alias("n")).select("id", "n", first_match((col("n") <= 2, "Simple"), (col("n") <= 5, "Moderate"), (col("n") <= 8, "Complex"), other="VeryComplex").alias("level"))


@query("SELECT language, ROUND(AVG(cc) / (SELECT AVG(cc) FROM f_blocks), 6) AS ratio, AVG(cc) / (SELECT AVG(cc) FROM f_blocks) <= 2 AS within FROM f_blocks GROUP BY language")
def q22_ratio_to_baseline(c):
    """Mean complexity of every language against that of all blocks, at most twice."""
    base = c.blocks.agg(F.avg("cc").alias("base"))
    own = c.blocks.groupBy("language").agg(F.avg("cc").alias("own")).join(F.broadcast(base), F.lit(True))  # one row
    return own.select("language", F.round(col("own") / col("base"), 6).alias("ratio"), (col("own") / col("base") <= 2).alias("within"))


def semantic_hash() -> Column:
    """Without separators, so that ambiguous joins collide as in the definition."""
    return F.md5(F.concat("block_type", F.coalesce("semantic_name", F.lit("")), "raw_text", "parameters", F.coalesce("return_type", F.lit(""))).cast("binary"))


@query("SELECT id, md5(block_type || COALESCE(semantic_name, '') || raw_text || parameters || COALESCE(return_type, '')) AS semantic_hash, md5(raw_text || COALESCE(body_ast, '')) AS syntax_hash FROM f_blocks")
def q24_hashes(c):
    return c.blocks.select("id", semantic_hash().alias("semantic_hash"), F.md5(F.concat("raw_text", F.coalesce("body_ast", F.lit(""))).cast("binary")).alias("syntax_hash"))
