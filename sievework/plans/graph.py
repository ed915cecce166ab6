"""Queries over call graphs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import graph as G
from ..registry import query
from .standins import call_edges, read

SEEDS = "SELECT p_partkey AS node FROM part WHERE p_partkey % 20 = 0"


def seeds(spark, d):
    return read(spark, d, "part").where("p_partkey % 20 = 0").select(F.col("p_partkey").alias("node"))


REACH = f"reached AS (SELECT node FROM ({SEEDS}) UNION SELECT e.dst FROM reached r JOIN call_edges e ON e.src = r.node)"


@query("gra4_reachable", f"WITH {REACH} SELECT node FROM reached", recursive=True)
def gra4(spark, d):
    return G.reachable(call_edges(spark, d), seeds(spark, d))


@query(
    "gra5_is_reachable",
    f"""WITH {REACH} SELECT finding_id, column_num % 5 = 0 OR CAST(regexp_extract(snippet, '(\\d+)', 1) AS BIGINT) IN (SELECT node FROM reached) AS reachable FROM stored_findings""",
    recursive=True,
)
def gra5(spark, d):
    from .standins import stored_findings

    node = F.when(F.col("column_num") % 5 != 0, F.regexp_extract("snippet", r"(\d+)", 1).cast("long"))
    rows = stored_findings(spark, d).select("finding_id", node.alias("node"), "column_num")
    return G.is_reachable(rows, gra4(spark, d)).select("finding_id", "reachable")


PATHS = f"""hops AS (SELECT node, 0 AS h FROM ({SEEDS}) UNION SELECT e.dst, h + 1 FROM hops JOIN call_edges e ON e.src = hops.node WHERE h < 30),
    least_ AS (SELECT node, min(h) AS hops FROM hops GROUP BY 1),
    preds AS (SELECT b.node, min(e.src) AS pred FROM least_ b JOIN call_edges e ON e.dst = b.node JOIN least_ a ON a.node = e.src AND a.hops = b.hops - 1 GROUP BY 1),
    paths AS (SELECT node, CAST(node AS VARCHAR) AS path FROM ({SEEDS}) UNION ALL SELECT p.node, concat(paths.path, '>', p.node) FROM paths JOIN preds p ON p.pred = paths.node)"""


@query("gra6_shortest_paths", f"WITH {PATHS} SELECT node, hops, path FROM least_ JOIN paths USING (node)", recursive=True)
def gra6(spark, d):
    return G.shortest_paths(call_edges(spark, d), seeds(spark, d)).select("node", "hops", F.array_join("path", ">").alias("path"))


@query(
    "gra6_long_chains",
    """SELECT l_orderkey * 10 + l_linenumber AS node, CAST(row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber) - 1 AS INT) AS hops
    FROM (SELECT DISTINCT l_orderkey, l_linenumber, first_value(l_suppkey) OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_suppkey) AS l_suppkey FROM lineitem) WHERE l_linenumber = 1 AND l_orderkey % 16 = l_suppkey % 16""",
)
def gra6_chains(spark, d):
    """One chain of calls a supplier, in order of its lines: many steps, which no bound of rounds ends."""
    lines = read(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_suppkey").alias("chain")).where("l_linenumber = 1 and l_orderkey % 16 = chain % 16")
    lines = lines.select("chain", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("dst"))
    w = Window.partitionBy("chain").orderBy("dst")
    edges = lines.withColumn("src", F.lag("dst").over(w))
    return G.shortest_tree(edges.where("src is not null"), edges.where("src is null").select(F.col("dst").alias("node"))).select("node", "hops")


@query(
    "gra7_dependency_reachable",
    f"""WITH {REACH} SELECT s_suppkey AS dep_id, coalesce(bool_or(l_partkey IN (SELECT node FROM reached)), false) AS reachable
    FROM supplier LEFT JOIN (SELECT l_suppkey, l_partkey FROM lineitem) ON l_suppkey = s_suppkey GROUP BY 1""",
    recursive=True,
)
def gra7(spark, d):
    sites = read(spark, d, "lineitem").select(F.col("l_suppkey").alias("dep_id"), F.col("l_partkey").alias("node"))
    return G.dependency_reachable(read(spark, d, "supplier").select(F.col("s_suppkey").alias("dep_id")), sites, gra4(spark, d))


CODE = {
    "a.py": "import os\ndef main():\n    helper()\n    util(1)\n\ndef helper():\n    return os.getenv('X')\n\ndef lonely():\n    lonely()\n",
    "b.py": "def util(x):\n    return eval(x)\n\ndef view(request):\n    util(request.args)\n",
    "c.py": "def broken(:\n",
    "d.js": "function load(u) {\n  // save(u)\n  return fetch(u);\n}\nconst show = (x) => {\n  load(x); 'load(y)';\n};\nclass A {\n  draw(z) {\n    show(z);\n  }\n}\n",
    "e.ts": "export async function read(p: string): Promise<string> {\n  return clean(p);\n}\nconst clean = (p: string): string => {\n  return p;\n};\n",
    "f.go": "package f\n\nfunc Serve(w int) {\n\tsend(w)\n}\n\nfunc (s *S) send(w int) {\n}\n",
    "g.rs": "fn run<'a>(x: &'a str) {\n    parse(x);\n}\n\npub fn parse(x: &str) {}\n",
    "H.java": "class H {\n  public static void start(String[] a) throws E {\n    if (a.length > 0) { stop(); }\n  }\n  private void stop() {\n  }\n}\n",
}


def nodes(spark):
    from ..sources.files import language_of

    files = spark.createDataFrame(list(CODE.items()), "file_path string, text string")
    return G.source_functions(files.withColumn("language", language_of("file_path")))


@query(
    "gra1_definitions",
    """SELECT * FROM (VALUES ('a.py', 'main', 2), ('a.py', 'helper', 6), ('a.py', 'lonely', 9), ('b.py', 'util', 1), ('b.py', 'view', 4), ('d.js', 'load', 1), ('d.js', 'show', 5), ('d.js', 'draw', 9),
    ('e.ts', 'read', 1), ('e.ts', 'clean', 4), ('f.go', 'Serve', 3), ('f.go', 'send', 7), ('g.rs', 'run', 1), ('g.rs', 'parse', 5), ('H.java', 'start', 2), ('H.java', 'stop', 5)) t(file_path, name, def_line)""",
)
def gra1(spark, d):
    return G.function_definitions(nodes(spark))


@query(
    "gra2_call_graph",
    """SELECT * FROM (VALUES ('a.py', 'main', 'a.py', 'helper'), ('a.py', 'main', 'b.py', 'util'), ('b.py', 'view', 'b.py', 'util'), ('d.js', 'show', 'd.js', 'load'), ('d.js', 'draw', 'd.js', 'show'),
    ('e.ts', 'read', 'e.ts', 'clean'), ('f.go', 'Serve', 'f.go', 'send'), ('g.rs', 'run', 'g.rs', 'parse'), ('H.java', 'start', 'H.java', 'stop')) t(src_path, src, dst_path, dst)""",
)
def gra2(spark, d):
    return G.call_graph(nodes(spark))


@query("gra3_tainted", "SELECT * FROM (VALUES ('a.py', 'helper'), ('b.py', 'view'), ('d.js', 'load')) t(file_path, name)")
def gra3(spark, d):
    return G.tainted_functions(nodes(spark))
