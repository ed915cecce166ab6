"""Call graphs: taint sources, reachability and paths."""

from __future__ import annotations

import bisect
import functools
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import bucketed, checkpointed, discard

#: Tables of a search that are read side by side before they are written as one.
COMPACT = 8

#: Names whose use marks a function as a source of untrusted input.
TAINT_SOURCES = {
    "Python": ["request", "os"],
    "JavaScript": ["process", "fetch", "axios", "request", "got", "superagent", "http", "https"],
}


def python_functions(files: DataFrame) -> DataFrame:
    """(file_path, kind, name, line, def_line) of definitions, calls and name uses, by the syntax tree."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import ast

        for b in batches:
            rows = []
            for path, text in zip(b["file_path"], b["text"]):
                try:
                    tree = ast.parse(text or "")
                except (SyntaxError, ValueError, RecursionError, MemoryError):  # the last: nested too deeply for the parser
                    continue
                for node in ast.walk(tree):
                    if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
                        rows.append((path, "def", node.name, node.lineno))
                    elif isinstance(node, ast.Call) and isinstance(node.func, ast.Name):
                        rows.append((path, "call", node.func.id, node.lineno))
                    elif isinstance(node, ast.Name):
                        rows.append((path, "use", node.id, node.lineno))
            yield pd.DataFrame(rows, columns=["file_path", "kind", "name", "line"])

    return files.select("file_path", "text").mapInPandas(run, "file_path string, kind string, name string, line int")


#: How functions are defined in languages that are read by their words: the name is the group that matched.
DEFINITIONS = {
    "JavaScript": r"\bfunction\s*\*?\s*([\w$]+)\s*\(|\b(?:const|let|var)\s+([\w$]+)\s*=\s*(?:async\s*)?(?:function\b|\([^()]*\)\s*=>|[\w$]+\s*=>)|^\s*(?:async\s+|static\s+)*(?!(?:if|for|while|switch|catch|function|return)\b)([\w$]+)\s*\([^()]*\)\s*\{",
    "Go": r"\bfunc\s*(?:\([^()]*\)\s*)?(\w+)\s*\(",
    "Rust": r"\bfn\s+(\w+)",
    "Java": r"^\s*(?:(?:public|protected|private|static|final|synchronized|abstract)\s+)*[\w<>\[\],.?]+\s+(?!(?:if|for|while|switch|catch|new|return)\b)(\w+)\s*\([^()]*\)\s*(?:throws\s+[\w,.\s]+)?\{",
}
DEFINITIONS["TypeScript"] = DEFINITIONS["JavaScript"].replace(r"\([^()]*\)\s*=>", r"\([^()]*\)\s*(?::[^={}]+)?=>").replace(r"\([^()]*\)\s*\{", r"\([^()]*\)\s*(?::[^={}]+)?\{")
_QUIET = [r"//[^\n]*", r"/\*.*?\*/", r'"(?:\\.|[^"\\\n])*"', r"`(?:\\.|[^`\\])*`", r"'(?:\\.|[^'\\\n])*'"]
_KEYWORDS = {"if", "for", "while", "switch", "catch", "function", "return", "func", "fn", "match", "new", "super", "sizeof", "typeof", "await"}


def word_functions(language: str, text: str) -> list[tuple[str, str, int]]:
    """(kind, name, line) of definitions, calls and name uses, by words, with comments and strings blanked."""
    # a single quote of Rust may begin a lifetime
    quiet = [*_QUIET[:-1], r"'(?:\\.|[^'\\])'"] if language == "Rust" else _QUIET
    plain = re.sub("|".join(quiet), lambda m: re.sub(r"[^\n]", " ", m[0]), text, flags=re.S)
    starts = [0, *(m.end() for m in re.finditer("\n", plain))]
    line = lambda at: bisect.bisect_right(starts, at)
    rows, named = [], set()
    for m in re.finditer(DEFINITIONS[language], plain, re.M):
        k = m.lastindex
        named.add(m.start(k))
        rows.append(("def", m[k], line(m.start(k))))
    for m in re.finditer(r"[A-Za-z_$][\w$]*(\s*\()?", plain):
        name = m[0].rstrip("(").rstrip()
        if m.start() not in named and name not in _KEYWORDS:
            rows.append(("call" if m[1] else "use", name, line(m.start())))
    return rows


def source_functions(files: DataFrame) -> DataFrame:
    """(file_path, kind, name, line) of (file_path, language, text): Python by its tree, the other languages by their words."""
    from ..sources.files import spread

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(path, *r) for path, language, text in zip(b["file_path"], b["language"], b["text"]) for r in word_functions(language, text or "")]
            yield pd.DataFrame(rows, columns=["file_path", "kind", "name", "line"])

    files = spread(files.select("file_path", "language", "text"))
    others = files.where(F.col("language").isin(*DEFINITIONS))
    words = others.mapInPandas(run, "file_path string, kind string, name string, line int")
    return python_functions(files.where("language = 'Python'")).unionByName(words)


def function_definitions(nodes: DataFrame) -> DataFrame:
    """(file_path, name, def_line): the first definition of each name in a file."""
    return nodes.where("kind = 'def'").groupBy("file_path", "name").agg(F.min("line").alias("def_line"))


def call_graph(nodes: DataFrame) -> DataFrame:
    """(src_path, src, dst_path, dst): calls from the enclosing function to the one they name, without self loops."""
    from .joins import enclosing_function, resolve_callees

    defs = function_definitions(nodes)
    calls = nodes.where("kind = 'call'").select(F.concat_ws(":", "file_path", "line", "name").alias("call_id"), "file_path", "line", F.col("name").alias("callee")).distinct()
    callers = enclosing_function(calls.select(F.col("call_id").alias("finding_id"), "file_path", "line"), defs)
    targets = resolve_callees(calls.select("call_id", "file_path", "callee"), defs).where("def_path is not null")
    both = callers.where("name is not null").join(targets.select("call_id", "callee", "def_path"), F.col("finding_id") == F.col("call_id"))
    edges = both.select(F.col("file_path").alias("src_path"), F.col("name").alias("src"), F.col("def_path").alias("dst_path"), F.col("callee").alias("dst"))
    return edges.where("not (src_path = dst_path and src = dst)").distinct()


def tainted_functions(nodes: DataFrame) -> DataFrame:
    """(file_path, name) of the functions that use a taint source of their file's language."""
    from ..sources.files import language_of
    from .joins import enclosing_function

    own = F.when(language_of("file_path") == "Python", F.col("name").isin(TAINT_SOURCES["Python"]))
    own = own.when(language_of("file_path").isin("JavaScript", "TypeScript"), F.col("name").isin(TAINT_SOURCES["JavaScript"]))
    uses = nodes.where((F.col("kind") != "def") & own)
    uses = uses.select(F.concat_ws(":", "file_path", "line").alias("finding_id"), "file_path", "line").distinct()
    return enclosing_function(uses, function_definitions(nodes)).where("name is not null").select("file_path", "name").distinct()


def _expand(first: DataFrame, step: Callable[[DataFrame, DataFrame, int], DataFrame]) -> DataFrame:
    """All rows of a breadth-first search: step(frontier, seen, round) gives the next frontier, (node, ..).

    It ends when a frontier is empty, however many rounds that takes. A round writes its frontier only; the tables of
    earlier rounds are written together now and then, and deleted.
    """
    parts, k = [checkpointed(first, "search")], 0
    while True:
        k += 1
        seen = functools.reduce(DataFrame.unionByName, parts)
        frontier = checkpointed(step(parts[-1], seen, k), "search")
        if frontier.isEmpty():
            discard(frontier)
            return seen
        parts.append(frontier)
        if len(parts) > COMPACT:
            # the frontier stays apart, as the next round begins with it
            one = checkpointed(functools.reduce(DataFrame.unionByName, parts[:-1]), "search")
            discard(*parts[:-1])
            parts = [one, frontier]


def _by_source(edges: DataFrame) -> DataFrame:
    """Edges without repeats or loops, written once and bucketed by src: no round shuffles or makes them anew."""
    return bucketed(edges.where("src is not null and dst is not null and src <> dst").select("src", "dst").distinct(), ["src"], "edges")


def reachable(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(node): all nodes that a path from a seed reaches, the seeds included. Each round joins only new nodes with the edges."""
    out = _by_source(edges)

    def step(frontier: DataFrame, seen: DataFrame, _: int) -> DataFrame:
        found = frontier.join(out, frontier.node == out.src).select(F.col("dst").alias("node")).distinct()
        return found.join(seen, "node", "left_anti")

    found = _expand(seeds.where("node is not null").select("node").distinct(), step)
    discard(out)
    return found


def shortest_tree(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(node, hops, pred): steps of a shortest path from any seed, and the node before on it, of several the smallest.

    Seeds have 0 and null. A row a node, whatever the lengths of the paths.
    """
    out = _by_source(edges)

    def step(frontier: DataFrame, seen: DataFrame, k: int) -> DataFrame:
        found = frontier.join(out, frontier.node == out.src).groupBy(F.col("dst").alias("node")).agg(F.min("src").alias("pred"))
        return found.join(seen.select("node"), "node", "left_anti").select("node", F.lit(k).alias("hops"), "pred")

    kind = seeds.schema["node"].dataType
    found = _expand(seeds.where("node is not null").select("node", F.lit(0).alias("hops"), F.lit(None).cast(kind).alias("pred")).distinct(), step)
    discard(out)
    return found


def tree_steps(tree: DataFrame, targets: DataFrame | None = None) -> DataFrame:
    """(node, at, step): the path from a seed to each node (of targets, (node)), one row a step; ``at`` counts from 0.

    Pointer doubling: round k knows the ancestor 2^k steps up, so a path of n steps takes log2(n) rounds; rows
    climb by the binary digits of their distance.
    """
    up = checkpointed(tree.where("pred is not null").select("node", F.col("pred").alias("up")), "tree-up")
    ups = []
    while not up.isEmpty():
        ups.append(up)
        far = up.select(F.col("node").alias("up"), F.col("up").alias("far"))
        up = checkpointed(up.join(far, "up").select("node", F.col("far").alias("up")), "tree-up")
    ends = tree if targets is None else tree.join(targets.select("node").distinct(), "node", "left_semi")
    rows = ends.select("node", "hops", F.col("node").alias("step"))
    for k in range(len(ups) - 1, -1, -1):
        climb = rows.join(ups[k].select(F.col("node").alias("step"), "up"), "step").select("node", (F.col("hops") - 2**k).alias("hops"), F.col("up").alias("step"))
        rows = checkpointed(rows.unionByName(climb), "tree-rows")
    discard(up, *ups)
    return rows.select("node", F.col("hops").alias("at"), "step")


def shortest_paths(edges: DataFrame, seeds: DataFrame, targets: DataFrame | None = None) -> DataFrame:
    """(node, hops, path array): the shortest path from any seed, of several the one of the smallest predecessors."""
    steps = tree_steps(shortest_tree(edges, seeds), targets)
    whole = steps.groupBy("node").agg(F.max("at").alias("hops"), F.array_sort(F.collect_list(F.struct("at", "step"))).alias("s"))
    return whole.select("node", "hops", F.col("s.step").alias("path"))


def is_reachable(findings: DataFrame, reached: DataFrame) -> DataFrame:
    """Findings (.., node) with ``reachable``; without an enclosing function they count as reachable."""
    hit = reached.select("node").distinct().withColumn("__sw_hit", F.lit(True))
    out = findings.join(hit, "node", "left")
    return out.withColumn("reachable", F.when(F.col("node").isNull(), True).otherwise(F.coalesce("__sw_hit", F.lit(False)))).drop("__sw_hit")


def dependency_reachable(deps: DataFrame, call_sites: DataFrame, reached: DataFrame) -> DataFrame:
    """(dep_id, reachable): is any call site of the dependency in a reached node? None is no."""
    sites = call_sites.join(reached.select("node").distinct().withColumn("__sw_hit", F.lit(True)), "node", "left")
    per = sites.groupBy("dep_id").agg(F.bool_or(F.coalesce("__sw_hit", F.lit(False))).alias("r"))
    return deps.select("dep_id").join(per, "dep_id", "left").select("dep_id", F.coalesce("r", F.lit(False)).alias("reachable"))
