"""Texts of code, headings and formulas made of a table's columns: one list of lines gives the text to Spark and its lines to SQL.

The conditions and lines are SQL that Spark and DuckDB read alike. What the SQL of a query expects
(kinds, names, nesting) is said beside each line; line numbers follow from which lines are there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import table

#: A class name for each brand and size.
BASE = "replace(p_brand, '#', '') || '_' || p_size"
TAGS = {"kind": "VARCHAR", "name": "VARCHAR", "block": "INTEGER", "depth": "INTEGER"}


class Lines:
    """Lines as (condition, text, tags): ``kind`` and ``name`` of what a line declares, ``block`` it belongs to, ``depth``."""

    def __init__(self, *lines: tuple):
        self.lines = [(c, t, tags[0] if tags else {}) for c, t, *tags in lines]

    def text(self) -> Column:
        return F.expr("concat_ws(chr(10), " + ", ".join(f"CASE WHEN {c} THEN {t} END" for c, t, _ in self.lines) + ")")

    def sources(self, spark, d: str) -> DataFrame:
        return table(spark, d, "part").select(F.col("p_partkey").alias("id"), self.text().alias("text"))

    def sql(self) -> str:
        """``id, line, pos, t`` and the tags of the lines that are there."""
        one = lambda k, c, t, tags: "{" + ", ".join([f"'pos': {k}", f"'there': ({c})", f"'t': {t}", *(f"'{n}': CAST({tags.get(n, 'NULL')} AS {kind})" for n, kind in TAGS.items())]) + "}"
        rows = ", ".join(one(k + 1, *line) for k, line in enumerate(self.lines))
        return f"(SELECT id, CAST(row_number() OVER (PARTITION BY id ORDER BY l.pos) AS INTEGER) AS line, l.* FROM (SELECT p_partkey AS id, unnest([{rows}]) AS l FROM part) WHERE l.there)"


def declares(kind: str, name: str, block: int | None = None) -> dict:
    return {"kind": f"'{kind}'", "name": name} | ({} if block is None else {"block": str(block)})


IN = lambda block: {"block": str(block)}
FOR, WHILE, CHILD = "p_partkey % 2 = 0", "p_partkey % 5 < 2", "p_size % 2 = 0"

PYTHON = Lines(
    ("true", "'import m' || p_size", declares("import", "'m' || p_size")),
    ("p_size % 3 = 0", "'from pkg.x' || p_partkey || ' import y'", declares("import", "'pkg.x' || p_partkey")),
    ("true", "''"),
    ("true", "'TOP_' || p_size || ' = 1'"),
    ("true", "''"),
    ("true", f"'class ' || {BASE} || ':'", declares("class", BASE, 1)),
    ("true", "'    kind_a = 3'", IN(1)),
    ("true", "''"),
    ("true", "'    def run_' || p_size || '(self, n):'", declares("function", "'run_' || p_size", 1)),
    ("true", "'        total = 0'", IN(1)),
    (FOR, "'        for i in range(n):'", declares("for", "NULL", 1)),
    (FOR, "'            total = total + step_' || p_size", IN(1)),
    (WHILE, "'        while total < n:'", declares("while", "NULL", 1)),
    (WHILE, "'            total = total + shift(total)'", IN(1)),
    ("true", "'        self.last_' || p_size || ' = total'", IN(1)),
    ("true", "'        return total'", IN(1)),
    ("true", "''"),
    (CHILD, f"'class Child_' || p_size || '(' || {BASE} || ', object):'", declares("class", "'Child_' || p_size", 2)),
    (CHILD, "'    pass'", IN(2)),
    ("true", "''"),
    ("true", "'class Last_' || p_size || '(m.Child_' || p_size || '):'", declares("class", "'Last_' || p_size", 3)),
    ("true", "'    pass'", IN(3)),
    ("true", "''"),
    ("true", "'def helper_' || p_partkey || '(x):'", declares("function", "'helper_' || p_partkey", 4)),
    ("true", "'    return x'", IN(4)),
)

#: ``pos, condition, scope, depth, kind, name`` of the variables in PYTHON.
VARIABLES = [
    (4, "true", "''", 0, "global", "'TOP_' || p_size"),
    (7, "true", BASE, 1, "field", "'kind_a'"),
    (9, "true", f"{BASE} || '.run_' || p_size", 2, "parameter", "'self'"),
    (9, "true", f"{BASE} || '.run_' || p_size", 2, "parameter", "'n'"),
    (10, "true", f"{BASE} || '.run_' || p_size", 2, "local", "'total'"),
    (11, FOR, f"{BASE} || '.run_' || p_size", 2, "local", "'i'"),
    (15, "true", f"{BASE} || '.run_' || p_size", 2, "field", "'last_' || p_size"),
    (24, "true", "'helper_' || p_partkey", 1, "parameter", "'x'"),
]


def variable_rows(found: list[tuple], lines: Lines) -> str:
    """SQL for ``id, scope, depth, kind, name, line`` of variables that are said with the place of their line."""
    each = ", ".join(f"{{'pos': {p}, 'there': ({c}), 'scope': {s}, 'depth': {d}, 'kind': '{k}', 'name': {n}}}" for p, c, s, d, k, n in found)
    return f"SELECT v.id, v.scope, v.depth, v.kind, v.name, l.line FROM (SELECT p_partkey AS id, unnest([{each}], recursive := true) FROM part) v JOIN {lines.sql()} l ON l.id = v.id AND l.pos = v.pos WHERE v.there"


JAVA, GO, SCRIPT, C = (f"p_partkey % 4 = {k}" for k in range(4))
LOOP = " AND p_size % 3 <> 0"


def loop(kind: str, *names: str) -> dict:
    """A loop and the names that it reads, joined by commas."""
    return {"kind": f"'{kind}'", "name": " || ',' || ".join(names)}


#: One source of four languages, by the key.
BRACED = Lines(
    (JAVA, "'class Box_' || p_size || ' {'"),
    (JAVA, "'  int size_' || p_partkey || ' = 3; // for (int q = 0;;) {}'"),
    (JAVA, "'  int run(int n) {'"),
    (JAVA + LOOP, "'    for (int i = 0; i < n; i++) {'", loop("for", "'i'", "'n'", "'step_' || p_size", "'total'")),
    (JAVA + LOOP, "'      total = total + step_' || p_size || '(i); }'"),
    (JAVA, "'    return n; } }'"),
    (GO, "'func Sum_' || p_size || '(xs []int, most int) int {'"),
    (GO + LOOP, "'  for i := 0; i < most; i++ {'", loop("for", "'i'", "'most'", "'use_' || p_partkey", "'xs'")),
    (GO + LOOP, "'    use_' || p_partkey || '(xs[i]) }'"),
    (GO, "'  return most }'"),
    (SCRIPT, "'const top_' || p_partkey || ' = `while (x) {`;'"),
    (SCRIPT, "'function walk_' || p_size || '(node, depth = 1) {'"),
    (SCRIPT + LOOP, "'  while (ready_' || p_partkey || ') go();'", loop("while", "'go'", "'ready_' || p_partkey")),
    (SCRIPT, "'  return node; }'"),
    (C, "'int count_' || p_size || '(char *s, int n) {'"),
    (C, "'  int k = 0; /* while (k) { */'"),
    (C + LOOP, "'  for (int i = 0; i < n; i++)'", loop("for", "'i'", "'k'", "'n'", "'s'")),
    (C + LOOP, "'    if (s[i] == 7) k++;'"),
    (C, "'  return k; }'"),
)
BRACED_VARIABLES = [
    (2, JAVA, "'Box_' || p_size", 1, "field", "'size_' || p_partkey"),
    (3, JAVA, "'Box_' || p_size || '.run'", 2, "parameter", "'n'"),
    (4, JAVA + LOOP, "'Box_' || p_size || '.run'", 2, "local", "'i'"),
    (7, GO, "'Sum_' || p_size", 1, "parameter", "'xs'"),
    (7, GO, "'Sum_' || p_size", 1, "parameter", "'most'"),
    (8, GO + LOOP, "'Sum_' || p_size", 1, "local", "'i'"),
    (11, SCRIPT, "''", 0, "global", "'top_' || p_partkey"),
    (12, SCRIPT, "'walk_' || p_size", 1, "parameter", "'node'"),
    (12, SCRIPT, "'walk_' || p_size", 1, "parameter", "'depth'"),
    (15, C, "'count_' || p_size", 1, "parameter", "'s'"),
    (15, C, "'count_' || p_size", 1, "parameter", "'n'"),
    (16, C, "'count_' || p_size", 1, "local", "'k'"),
    (17, C + LOOP, "'count_' || p_size", 1, "local", "'i'"),
]

EVEN = "p_size % 2 = 0"
#: Chunks of three lines that end where nothing is open; without the third line the function's head joins the first chunk.
CODE = Lines(
    ("true", "'a' || p_partkey || ' = (1,'", IN("0")),
    ("true", "'     2)'", IN("0")),
    (EVEN, "'b' || p_size || ' = 3'", IN("0")),
    ("true", "'def f' || p_size || '():'", IN(f"CASE WHEN {EVEN} THEN 1 ELSE 0 END")),
    ("true", "'    return ['", IN(f"CASE WHEN {EVEN} THEN 2 ELSE 1 END")),
    ("true", "'        1,'", IN(f"CASE WHEN {EVEN} THEN 2 ELSE 1 END")),
    ("true", "'    ]'", IN(f"CASE WHEN {EVEN} THEN 2 ELSE 1 END")),
    ("true", "'c = ' || p_size", IN(f"CASE WHEN {EVEN} THEN 3 ELSE 2 END")),
)

INNER, OPEN = "p_partkey % 2 = 0", "p_size % 3 = 0"
BRACES = Lines(
    ("true", "'class Out_' || p_size || ' {'", IN(2)),
    ("true", "'  int a; // class No {'", IN(2)),
    (INNER, "'  class In_' || p_partkey || ' { void f() {} }'", {"block": "1", "name": "'In_' || p_partkey"}),
    ("true", "'  String s = \"class X {\";'", IN(2)),
    ("true", "'}'", {"block": "2", "name": "'Out_' || p_size"}),
    ("true", "'class Gone;'"),
    (OPEN, "'class Open_' || p_size || ' {'", IN(3)),
    (OPEN, "'  int b;'", {"block": "3", "name": "'Open_' || p_size"}),
)

HEADED = Lines(
    ("true", "'# ' || p_name", {"depth": "1", "name": "p_name"}),
    ("true", "'text'"),
    ("true", "p_brand", {"depth": "1", "name": "p_brand"}),
    ("true", "'==='"),
    ("true", "'```'"),
    ("true", "'# no heading'"),
    ("true", "'```'"),
    ("true", "'2.1 ' || p_type", {"depth": "2", "name": "p_type"}),
    ("p_size % 2 = 0", "'more'"),
    ("true", "'Four ' || p_size", {"depth": "2", "name": "'Four ' || p_size"}),
    ("true", "'---'"),
    ("p_size % 3 = 0", "'### Five ' || p_brand", {"depth": "3", "name": "'Five ' || p_brand"}),
)

WALKS, TURNS = "p_partkey % 2 = 0", "p_size % 3 <> 0"
RECURSIVE = Lines(
    ("true", "'def walk_' || p_size || '(n):'"),
    ("true", "'    for i in range(n):'", {"kind": "'for'"}),
    (WALKS, "'        walk_' || p_size || '(i)'"),
    ("true", "'        self.turn_' || p_size || '(i)'"),
    ("true", "''"),
    ("true", "'def turn_' || p_size || '(n):'"),
    ("true", "'    while n:'", {"kind": "'while'"}),
    ("true", "'        n = step(n)'"),
    (TURNS, "'    return turn_' || p_size || '(n - 1)'"),
)

SLASH = "chr(92)"
FORMULAS = Lines(
    ("true", f"'cost ' || {SLASH} || '$5 $x_{{' || p_size || '}}$ % not $z$'", {"kind": "'dollar'", "name": "'$x_{' || p_size || '}$'"}),
    ("p_partkey % 2 = 0", f"{SLASH} || 'begin{{align}}a_' || p_partkey || '&=$b$' || {SLASH} || 'end{{align}} text'", {"kind": "'environment'", "name": f"{SLASH} || 'begin{{align}}a_' || p_partkey || '&=$b$' || {SLASH} || 'end{{align}}'"}),
    ("p_size % 3 = 0", f"{SLASH} || '[y_' || p_size || {SLASH} || '] end'", {"kind": "'bracket'", "name": f"{SLASH} || '[y_' || p_size || {SLASH} || ']'"}),
)

#: Lines of a page, and whether each looks like code.
PAGE = [
    ("'v' || p_partkey || ' = f(' || p_size || ')'", "true"),
    ("'Some ' || p_name || ' here.'", "false"),
    ("'for i' || p_size || ' in y:'", "true"),
    ("CASE WHEN p_size % 2 = 0 THEN 'end ' || p_partkey || ' }' ELSE 'word ' || p_partkey END", "p_size % 2 = 0"),
    ("'print(x' || p_size || ')'", "true"),
    ("'for the ' || p_type", "false"),
    ("'// ' || p_brand", "true"),
    ("''", "false"),
]
