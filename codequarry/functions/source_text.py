"""What columns of Spark's own functions tell about source texts: side effects, uses, languages, kinds of containers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

col = F.col
EXTENSIONS = {"py": "python", "js": "javascript", "mjs": "javascript", "jsx": "javascript", "ts": "typescript", "mts": "typescript", "tsx": "tsx", "rs": "rust"}
NAMED = {"Dockerfile": "dockerfile", "Makefile": "makefile", "Rakefile": "ruby", "Gemfile": "ruby", "Cargo.toml": "toml", "package.json": "json", "tsconfig.json": "json", "pyproject.toml": "toml"}
EFFECTS = (("ConsoleIO", "Low", ("println!", "eprintln!")), ("FileIO", "Medium", ("std::fs::", "File::")), ("NetworkIO", "High", ("reqwest::", "hyper::")), ("AsyncOperation", "Medium", ("std::thread::", "tokio::")), ("ExceptionThrowing", "High", ("panic!", "unwrap()")))


def mapped(key: Column, values: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for kv in values.items() for x in kv))[key]


def language_of(path: Column) -> Column:
    """By extension, else by the name of a special file; null if unknown."""
    name = F.element_at(F.split(path, "/"), -1)
    extension = F.when(name.contains("."), F.element_at(F.split(name, r"\."), -1)).otherwise("")
    return F.coalesce(mapped(extension, EXTENSIONS), mapped(name, NAMED))


def any_of(text: Column, parts) -> Column:
    return reduce(lambda a, b: a | b, (text.contains(p) for p in parts))


def side_effects(text: Column) -> Column:
    """Of a function's text behind its first brace: (effect, severity, confidence) of every rule that holds."""
    at = F.locate("{", text)
    body = F.when(at > 0, F.substr(text, at + 1)).otherwise("")
    return F.array_compact(F.array(*(F.when(any_of(body, parts), F.struct(F.lit(kind).alias("effect"), F.lit(level).alias("severity"), F.lit(0.9).alias("confidence"))) for kind, level, parts in EFFECTS)))


def purity(effects: Column) -> Column:
    return F.when(F.size(effects) == 0, "Pure").when(F.exists(effects, lambda e: e["effect"].isin("FileIO", "NetworkIO")), "Impure").otherwise("MostlyPure")


def uses(text: Column) -> Column:
    """Paths of use lines."""
    return F.array_remove(F.transform(F.regexp_extract_all(text, F.lit(r"(?m)^\s*use ([^;\n]*);")), lambda x: F.trim(x)), "")


def mutability(text: Column) -> Column:
    has = text.contains
    return F.struct((has("mut ") | has("&mut")).alias("is_mutable"), has("&mut self").alias("mutates_self"), (has("mut ") & ~has("mut self")).alias("mutates_parameters"), has("static mut").alias("mutates_globals"))


def maintainability(cc: Column, cognitive: Column, loc: Column) -> Column:
    """171 - 5.2 ln cc - 0.23 ln cognitive - 16.2 ln loc, within 0 and 100; 100 where a logarithm is that of 0."""
    value = 171 - 5.2 * F.ln(cc) - 0.23 * F.ln(cognitive) - 16.2 * F.ln(loc)
    return F.when(F.least(cc, cognitive, loc) <= 0, 100.0).otherwise(F.least(F.lit(100.0), F.greatest(F.lit(0.0), value)))


def container_type(path: Column) -> Column:
    low = F.lower(path)
    return F.when(low.contains("test") | low.contains("spec"), "test").when(low.contains("config"), "config").when(low.contains("doc"), "documentation").otherwise("code")
