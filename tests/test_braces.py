"""Loops and variables of sources in four languages with odd layout."""

import pytest

from lakeloom.operators.braces import brace_loops, brace_variables, scan

JAVA = """class Box {
  int size = 3; // for (int q = 0;;) {}
  String s = "while (x) {";
  int run(int n, String who) {
    int total = 0;
    for (int i = 0; i < n; i++) {
      while (total < limit) total += step(i);
      total = total + this.size;
    }
    return total;
  }
}
"""
GO = """package main
func Sum(xs []int, most int) int {
  total := 0
  for i := 0; i < most; i++ {
    total += xs[i]
  }
  for total > most { total-- }
  return total
}
"""
SCRIPT = """const top = `for (a) {`;
function walk(node, depth = 1) {
  let seen = 0;
  for (const kid of node.kids) { seen += walk(kid, depth + 1); }
  do { seen--; } while (seen > top);
  while (ready) go();
  return seen;
}
"""
C = """#include <for.h>
int count(char *s, int n) {
  int k = 0;
  for (int i = 0; i < n; i++)
    if (s[i] == 'x') k++;
  /* while (k) {
  */
  while (k > max)
    k = k - 1;
  return k;
}
"""


def test_loops_in_four_languages():
    assert scan(JAVA)[0] == [(6, "for", ["i", "limit", "n", "step", "total"]), (7, "while", ["i", "limit", "step", "total"])]
    assert scan(GO)[0] == [(4, "for", ["i", "most", "total", "xs"]), (7, "for", ["most", "total"])]
    assert scan(SCRIPT)[0] == [(4, "for", ["depth", "kid", "node", "seen", "walk"]), (5, "do", ["seen"]), (6, "while", ["go", "ready"])]
    assert scan(C)[0] == [(4, "for", ["i", "k", "n", "s"]), (8, "while", ["k", "max"])]


def test_variables_in_four_languages():
    assert scan(JAVA)[1] == [("Box", 1, "field", "size", 2), ("Box", 1, "field", "s", 3), ("Box.run", 2, "parameter", "n", 4), ("Box.run", 2, "parameter", "who", 4), ("Box.run", 2, "local", "total", 5), ("Box.run", 2, "local", "i", 6)]
    assert scan(GO)[1] == [("Sum", 1, "parameter", "most", 2), ("Sum", 1, "parameter", "xs", 2), ("Sum", 1, "local", "total", 3), ("Sum", 1, "local", "i", 4)]
    assert scan(SCRIPT)[1] == [("", 0, "global", "top", 1), ("walk", 1, "parameter", "depth", 2), ("walk", 1, "parameter", "node", 2), ("walk", 1, "local", "seen", 3), ("walk", 1, "local", "kid", 4)]
    assert scan(C)[1] == [("count", 1, "parameter", "n", 2), ("count", 1, "parameter", "s", 2), ("count", 1, "local", "k", 3), ("count", 1, "local", "i", 4)]


@pytest.mark.parametrize("text", ["", "{", "}}}}", "for", "for (", "while (a", "do", 'x = "', "/* ", "class", "class {", "func (", "int f(", "for (;;) {", "((((", "))))", "for x {" * 50, "é {} ; for(ü;;) ;"])
def test_broken_sources_end(text):
    scan(text)


def test_columns(spark):
    df = spark.createDataFrame([(1, GO), (2, None), (3, "")], "id long, text string")
    assert brace_loops(df).count() == 2 and brace_variables(df).count() == 4
