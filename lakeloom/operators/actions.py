"""A registry of named table functions with checked arguments, and the steps around answers: votes, retrieval, examples.

An action is a function of a session and arguments to a DataFrame. Its specification says what arguments it takes;
arguments are checked against that schema before the function runs.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Names of types in a schema and what they accept.
TYPES = {"string": str, "integer": int, "number": (int, float), "boolean": bool, "array": list, "object": dict, "null": type(None)}


def schema_errors(schema: dict, value, path: str = "$") -> list[str]:
    """What is wrong with a value: type, enum, required, properties, additionalProperties, items, bounds and lengths."""
    out: list[str] = []
    kinds = schema.get("type")
    if kinds:
        kinds = kinds if isinstance(kinds, list) else [kinds]
        fits = any(isinstance(value, TYPES[k]) and not (isinstance(value, bool) and k in ("integer", "number")) for k in kinds if k in TYPES)
        if not fits:
            return [f"{path}: not of type {'|'.join(kinds)}"]
    if "enum" in schema and value not in schema["enum"]:
        out.append(f"{path}: not one of the listed values")
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        if "minimum" in schema and value < schema["minimum"]:
            out.append(f"{path}: under {schema['minimum']}")
        if "maximum" in schema and value > schema["maximum"]:
            out.append(f"{path}: over {schema['maximum']}")
    for name, size in (("Length", len(value) if isinstance(value, str) else None), ("Items", len(value) if isinstance(value, list) else None)):
        if size is not None and size < schema.get(f"min{name}", 0):
            out.append(f"{path}: too short")
        if size is not None and size > schema.get(f"max{name}", size):
            out.append(f"{path}: too long")
    if isinstance(value, dict):
        known = schema.get("properties", {})
        out += [f"{path}.{k}: missing" for k in schema.get("required", []) if k not in value]
        extra = schema.get("additionalProperties", True)
        for k, v in value.items():
            if k in known:
                out += schema_errors(known[k], v, f"{path}.{k}")
            elif extra is False:
                out.append(f"{path}.{k}: not allowed")
            elif isinstance(extra, dict):
                out += schema_errors(extra, v, f"{path}.{k}")
    if isinstance(value, list) and isinstance(schema.get("items"), dict):
        for k, v in enumerate(value):
            out += schema_errors(schema["items"], v, f"{path}[{k}]")
    return out


def json_errors(text: Column, schema: dict) -> Column:
    """The errors of JSON texts against a schema, by a pandas UDF; text that is no JSON has one error."""
    import pandas as pd

    def check(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            try:
                out.append(schema_errors(schema, json.loads(t)))
            except (TypeError, ValueError):
                out.append(["$: not JSON"])
        return pd.Series(out, dtype=object)

    check.__annotations__ = {"texts": pd.Series, "return": pd.Series}
    return F.pandas_udf(check, "array<string>")(text)


class Actions:
    """Actions by name. Names are letters, digits and ``_``; a name is taken once."""

    def __init__(self) -> None:
        self._known: dict[str, tuple[Callable[..., DataFrame], dict, str]] = {}

    def register(self, name: str, run: Callable[..., DataFrame], schema: dict | None = None, description: str = "") -> None:
        if not name.replace("_", "a").isalnum():
            raise ValueError(f"no name for an action: {name!r}")
        if name in self._known:
            raise ValueError(f"taken: {name}")
        self._known[name] = (run, schema or {"type": "object"}, description)

    def alias(self, name: str, of: str, **fixed) -> None:
        """Another name for an action, with some arguments fixed; a fixed argument can still be given."""
        run, schema, description = self._known[of]
        self.register(name, lambda spark, **given: run(spark, **(fixed | given)), {**schema, "required": [r for r in schema.get("required", []) if r not in fixed]}, description)

    def register_sql(self, name: str, statement: str, schema: dict | None = None, description: str = "") -> None:
        """An action that is a parametrised SQL statement: arguments are bound as ``:name``."""
        self.register(name, lambda spark, **given: spark.sql(statement, args=given), schema, description)

    def run(self, name: str, spark: SparkSession, **given) -> DataFrame:
        if name not in self._known:
            raise KeyError(f"unknown action: {name}")
        call, schema, _ = self._known[name]
        errors = schema_errors(schema, given)
        if errors:
            raise ValueError("; ".join(errors))
        return call(spark, **given)

    def listing(self, spark: SparkSession) -> DataFrame:
        """``name, description, parameters`` of all actions."""
        rows = [(n, d, sorted(s.get("properties", {}))) for n, (_, s, d) in sorted(self._known.items())]
        return spark.createDataFrame(rows, "name string, description string, parameters array<string>")


#: What a specification of an action must be.
SPEC = {
    "type": "object",
    "required": ["name", "description", "parameters", "sql"],
    "properties": {"name": {"type": "string", "minLength": 1}, "description": {"type": "string"}, "parameters": {"type": "object"}, "sql": {"type": "string", "minLength": 1}, "permission": {"enum": ["ask", "always", "never"]}},
}


def load_specs(specs: DataFrame, into: Actions) -> list[tuple[str, str]]:
    """Register the SQL actions that JSON texts (``path, text``) specify; returns ``(path, error)`` of those that are none.

    A registry is small by nature; at most 10,000 specifications are taken and more are an error.
    """
    rows = specs.select("path", "text").orderBy("path").limit(10_001).collect()
    if len(rows) > 10_000:
        raise ValueError("more than 10000 specifications")
    bad = []
    for r in rows:
        try:
            spec = json.loads(r.text)
            errors = schema_errors(SPEC, spec)
            if not errors and spec.get("permission") != "never":
                into.register_sql(spec["name"], spec["sql"], spec["parameters"], spec["description"])
        except (TypeError, ValueError) as e:
            errors = [str(e) if str(e).startswith(("taken", "no name")) else "not JSON"]
        if errors:
            bad.append((r.path, errors[0]))
    return bad


def rule_errors(rules: DataFrame) -> DataFrame:
    """``tag, error`` of rules (``tag, kind, pattern``) that cannot be applied: no tag, no pattern, an unknown kind, or no regular expression."""
    import pandas as pd

    def compiles(patterns: pd.Series) -> pd.Series:
        import re

        def ok(p):
            try:
                re.compile(p or "")
                return True
            except re.error:
                return False

        return pd.Series([ok(p) for p in patterns], dtype=bool)

    compiles.__annotations__ = {"patterns": pd.Series, "return": pd.Series}
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    error = (
        F.when(blank("tag"), "no tag")
        .when(blank("pattern"), "no pattern")
        .when(~F.coalesce(F.col("kind").isin("contains", "prefix", "suffix", "regex"), F.lit(False)), "unknown kind")
        .when((F.col("kind") == "regex") & ~F.pandas_udf(compiles, "boolean")(F.col("pattern")), "not a regular expression")
    )
    return rules.select("tag", error.alias("error")).where("error is not null")


def best_answers(answers: DataFrame) -> DataFrame:
    """One answer (``question, pass, errors, answer``) a question: the fewest errors, then the longest, then the first pass."""
    order = F.struct((-F.col("errors")).alias("e"), F.length("answer").alias("l"), (-F.col("pass")).alias("p"))
    rest = [c for c in answers.columns if c != "question"]
    return answers.groupBy("question").agg(F.max_by(F.struct(*rest), order).alias("x")).select("question", "x.*")


def research_sources(hits: DataFrame, most: int) -> DataFrame:
    """Hits (``seen, source, chunk, content, score``) once each, the first seen stays, at most ``most`` of these; best scores first, those without one last."""
    rest = [c for c in hits.columns if c not in ("source", "chunk", "content")]
    once = hits.groupBy("source", "chunk", "content").agg(F.min_by(F.struct(*rest), "seen").alias("x")).select("source", "chunk", "content", "x.*")
    return once.orderBy("seen").limit(most).orderBy(F.desc_nulls_last("score"), "seen")


def chosen_examples(examples: DataFrame, mode: str, most: int, score: str | None = None) -> DataFrame:
    """Examples (``pos, output``) with an output: all, the ``most`` first, or (``semantic``) the ``most`` best by ``score``."""
    kept = examples.where(F.trim(F.coalesce("output", F.lit(""))) != "")
    if mode == "all":
        return kept
    return kept.orderBy("pos").limit(most) if mode == "first" else kept.orderBy(F.desc(score), "pos").limit(most)


def appended(rows: DataFrame, path: str) -> DataFrame:
    """Append records to a table in a folder and return the whole table; ``saved`` numbers the call's records by the order of their key."""
    rows.write.mode("append").parquet(path)
    return rows.sparkSession.read.parquet(path)


def numbered(rows: DataFrame, by: list[str], order: str) -> DataFrame:
    return rows.withColumn("saved", F.row_number().over(Window.partitionBy(*by).orderBy(order)))
