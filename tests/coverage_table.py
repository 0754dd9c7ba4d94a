"""Write COVERAGE.md: every inventory id -> operator functions, registered queries and tests that call them.

A function stands for the ids that its docstring starts with (before the first colon, full stop or line end).
Queries and tests are credited only with functions that they call, directly or through other functions of the
package (read from the syntax trees; no Spark job runs).

Usage: python tests/coverage_table.py
"""

from __future__ import annotations

import ast
import glob
import os
import re

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

GROUPS = [("S", 1, 14, "Sources and sinks"), ("P", 1, 13, "Projections, filters, predicates"),
          ("J", 1, 11, "Joins"), ("A", 1, 22, "Aggregations"), ("W", 1, 12, "Window functions"),
          ("O", 1, 12, "Sorts, limits, top-k"), ("U", 1, 4, "Set operations"), ("F", 1, 26, "Scalar functions"),
          ("R", 0, 7, "Scoring, rules, alerts"), ("Q", 1, 5, "Data quality"), ("G", 1, 5, "Model registry"),
          ("M", 1, 17, "ML operators"), ("T", 1, 12, "Streaming")]
ID = r"[SPJAWOUFRQGMT]\d+"


def ids_at_start(doc: str) -> set[str]:
    """The ids before the first colon, full stop or line end of a docstring that starts with one."""
    head = re.split(r"[:.\n]", doc.strip(), maxsplit=1)[0]
    if not re.match(ID, head):
        return set()
    found = {m.group(0) for m in re.finditer(rf"\b{ID}\b", head)}
    for m in re.finditer(r"\b([SPJAWOUFRQGMT])(\d+)\s*-\s*\1?(\d+)\b", head):
        found |= {f"{m.group(1)}{i}" for i in range(int(m.group(2)), int(m.group(3)) + 1)}
    return found


def calls(node: ast.AST) -> set[str]:
    """Names of everything a function mentions: calls, and functions handed on."""
    return {n.id for n in ast.walk(node) if isinstance(n, ast.Name)} | {n.attr for n in ast.walk(node) if isinstance(n, ast.Attribute)}


def functions(pattern: str) -> dict[str, tuple[str, ast.FunctionDef]]:
    """name -> (module, syntax tree) of the top-level functions of some files."""
    out = {}
    for path in sorted(glob.glob(os.path.join(ROOT, pattern), recursive=True)):
        module = os.path.relpath(path, ROOT)[:-3].replace(os.sep, ".")
        if ".llm." in module:
            continue
        for node in ast.parse(open(path).read()).body:
            if isinstance(node, ast.FunctionDef):
                out.setdefault(node.name, (module, node))
    return out


def main() -> None:
    package = functions("txrisk/**/*.py")
    operators = {n: v for n, v in package.items() if ".plans" not in v[0]}
    stands = {n: ids_at_start(ast.get_docstring(node) or "") for n, (_, node) in operators.items()}
    direct = {n: calls(node) & set(package) for n, (_, node) in package.items()}

    def reach(names: set[str]) -> set[str]:
        seen, todo = set(), list(names)
        while todo:
            n = todo.pop()
            if n not in seen:
                seen.add(n)
                todo += direct.get(n, ())
        return seen

    queries, tests = {}, {}
    for path in sorted(glob.glob(os.path.join(ROOT, "txrisk/plans/*.py"))):
        for node in ast.parse(open(path).read()).body:
            if isinstance(node, ast.FunctionDef):
                for d in node.decorator_list:
                    if isinstance(d, ast.Call) and getattr(d.func, "id", "") == "query":
                        queries[d.args[0].value] = (reach(calls(node) & set(package)), len(d.args) > 1)
    for name, (module, node) in functions("tests/test_*.py").items():
        if name.startswith("test_"):
            tests[f"{module.split('.')[-1]}::{name}"] = reach(calls(node) & set(package))

    def few(names: list[str], n: int = 4) -> str:
        return ", ".join(names[:n]) + (f" and {len(names) - n} more" if len(names) > n else "") or "—"

    lines = ["# COVERAGE — SURVEY §2 inventory -> code", "",
             "Generated by `python tests/coverage_table.py` from the calls in the code. Functions are in `txrisk/`;",
             "queries are registered in `__spark_entry__.queries()` (DuckDB oracle SQL unless marked).", ""]
    missing, uncalled = [], []
    for letter, lo, hi, title in GROUPS:
        lines += [f"## {title}", "", "| id | functions | queries that call them | tests that call them |", "|---|---|---|---|"]
        for i in range(lo, hi + 1):
            k = f"{letter}{i}"
            own = sorted(n for n, ids in stands.items() if k in ids)
            f = few([f"`{operators[n][0].removeprefix('txrisk.')}.{n}`" for n in own], 6)
            q = few([f"`{name}`" + ("" if sql else " (no SQL)") for name, (r, sql) in queries.items() if r & set(own)])
            t = few([f"`{name}`" for name, r in tests.items() if r & set(own)], 3)
            missing += [k] if f == "—" else []
            uncalled += [k] if q == t == "—" else []
            lines.append(f"| {k} | {f} | {q} | {t} |")
        lines.append("")
    with open(os.path.join(ROOT, "COVERAGE.md"), "w") as fh:
        fh.write("\n".join(lines))
    print("ids without function:", missing, "; without query or test:", uncalled)


if __name__ == "__main__":
    main()
