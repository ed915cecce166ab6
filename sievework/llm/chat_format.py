r"""Chat formatting of reply trees, with DataFrame operations only.

``root_to_leaf_paths`` enumerates every root-to-leaf path by iterative self-joins with doubling: round k
joins the pointers to the 2^k-th ancestor with themselves, so a thread of n replies takes log2(n) rounds;
leaves then climb by the binary digits of the distance, and the rows made are just those of the paths.
``ranked_paths`` orders the branches of a tree by mean score, and ``format_paths`` turns each chosen path
into one conversation with a loss mask.

Template: a turn is ``<|role|>`` newline, text, ``<|end|>`` newline. Inside roles and texts ``\`` is
written ``\\`` and ``<|`` is written ``<\|``, and inside roles ``|>`` is written ``|\>``, so neither can hold the
control string that would end it, and ``unescape`` gives both back exactly.

Row rules: null text and null role are empty strings. A parent that is null or absent makes a root. Rows
that repeat (tree, node) count once, the smallest (role, text) wins. Rows whose tree or node is null are
left out, as are nodes on a cycle. Turns with equal numbers are ordered by role and text, and repeated
turns are all kept; null turns come first. Texts may have any length. Branches of equal mean score rank by leaf. Empty tables give empty results. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize

OPEN, END = "<|", "<|end|>\n"
LEARNED_ROLE = "assistant"


def escape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def escape_role(c: Column) -> Column:
    return F.replace(escape(c), F.lit("|>"), F.lit("|\\>"))


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, r"(?s)\\(.)", "$1")


def clean_nodes(nodes: DataFrame) -> DataFrame:
    """(tree, node, parent, role, text, score), one row per (tree, node), parents that exist or null."""
    one = (
        nodes.where("tree is not null and node is not null")
        .select(
            "tree",
            "node",
            F.struct(
                F.coalesce("role", F.lit("")).alias("role"),
                F.coalesce("text", F.lit("")).alias("text"),
                "parent",
                F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"),
            ).alias("v"),
        )
        .groupBy("tree", "node")
        .agg(F.min("v").alias("v"))
        .select("tree", "node", "v.*")
    )
    known = one.select(F.col("tree").alias("t"), F.col("node").alias("n"))
    return one.join(known, (one.tree == known.t) & (one.parent == known.n), "left").select(
        "tree", "node", F.col("n").alias("parent"), "role", "text", "score"
    )


def root_to_leaf_paths(nodes: DataFrame) -> DataFrame:
    """(tree, leaf, node, dist) of every root-to-leaf path of clean nodes; dist counts up from the leaf."""
    up = nodes.where("parent is not null").select("tree", "node", F.col("parent").alias("anc"))
    up = materialize(up, "chat-up0")
    parents = up.select("tree", F.col("anc").alias("node")).distinct()
    leaves = nodes.select("tree", "node").join(parents, ["tree", "node"], "left_anti")
    # on a cycle pointers never end; no path is longer than the largest tree
    most = nodes.groupBy("tree").count().agg(F.max("count")).first()[0] or 0
    ups = []
    while not up.isEmpty():
        if 2 ** len(ups) > most:
            break
        ups.append(up)
        right = up.select("tree", F.col("node").alias("anc"), F.col("anc").alias("far"))
        up = materialize(
            up.join(right, ["tree", "anc"]).select("tree", "node", F.col("far").alias("anc")),
            f"chat-up{len(ups)}",
        )
    paths = leaves.select("tree", F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("dist"))
    for k in range(len(ups) - 1, -1, -1):
        climbed = paths.join(ups[k], ["tree", "node"]).select(
            "tree", "leaf", F.col("anc").alias("node"), (F.col("dist") + 2**k).alias("dist")
        )
        paths = materialize(paths.union(climbed), f"chat-paths{k}")
    return paths


def ranked_paths(nodes: DataFrame, paths: DataFrame) -> DataFrame:
    """The rows of paths with role, text and the branch's rank in its tree: mean score, then leaf."""
    full = paths.join(nodes.drop("parent"), ["tree", "node"])
    scored = full.groupBy("tree", "leaf").agg(F.avg("score").alias("branch_score"))
    rank = F.row_number().over(Window.partitionBy("tree").orderBy(F.desc("branch_score"), "leaf"))
    return full.join(scored.withColumn("rank", rank), ["tree", "leaf"])


def format_paths(ranked: DataFrame, learned_role: str = LEARNED_ROLE, keep_rank: int | None = None) -> DataFrame:
    """(tree, leaf, rank, branch_score, formatted, loss_mask): one conversation per path.

    loss_mask is array<struct<start,length>> over the code points of formatted, in order: the escaped
    text of every turn of learned_role. keep_rank keeps the best branches of each tree only.
    """
    if keep_rank is not None:
        ranked = ranked.where(F.col("rank") <= keep_rank)
    head = F.concat(F.lit(OPEN), escape_role(F.col("role")), F.lit("|>\n"))
    turns = ranked.select(
        "tree",
        "leaf",
        "rank",
        "branch_score",
        (-F.col("dist")).alias("at"),
        (F.col("role") == learned_role).alias("learn"),
        head.alias("head"),
        escape(F.col("text")).alias("body"),
    ).withColumn("piece", F.concat("head", "body", F.lit(END)))
    before = Window.partitionBy("tree", "leaf").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    turns = turns.withColumn("begin", F.coalesce(F.sum(F.char_length("piece")).over(before), F.lit(0)))
    span = F.when(
        F.col("learn"),
        F.struct(
            (F.col("begin") + F.char_length("head")).alias("start"),
            F.char_length("body").cast("long").alias("length"),
        ),
    )
    grouped = turns.groupBy("tree", "leaf").agg(
        F.first("rank").alias("rank"),
        F.first("branch_score").alias("branch_score"),
        F.array_sort(F.collect_list(F.struct("at", "piece"))).alias("pieces"),
        F.array_sort(F.collect_list(span)).alias("loss_mask"),
    )
    return grouped.select(
        "tree",
        "leaf",
        "rank",
        "branch_score",
        F.array_join(F.transform("pieces", lambda p: p["piece"]), "").alias("formatted"),
        "loss_mask",
    )


def parsed_turns(formatted: str = "formatted") -> Column:
    """array<struct<role,text>> read back from formatted conversations."""
    parts = F.split(F.col(formatted), r"<\|end\|>\n", -1)
    parts = F.slice(parts, F.lit(1), F.size(parts) - 1)
    return F.transform(
        parts,
        lambda p: F.struct(
            unescape(F.regexp_extract(p, r"(?s)^<\|(.*?)\|>\n", 1)).alias("role"),
            unescape(F.regexp_replace(p, r"(?s)^<\|.*?\|>\n", "")).alias("text"),
        ),
    )


def loss_text(formatted: str = "formatted", mask: str = "loss_mask") -> Column:
    return F.array_join(
        F.transform(
            F.col(mask),
            lambda s: unescape(
                F.substring(F.col(formatted), (s["start"] + 1).cast("int"), s["length"].cast("int"))
            ),
        ),
        "",
    )


def conversation_nodes(conversations: DataFrame) -> DataFrame:
    """conversations (conv_id, turn, role, text) as trees: each turn answers the one before it."""
    order = Window.partitionBy("conv_id").orderBy("turn", F.coalesce("role", F.lit("")), F.coalesce("text", F.lit("")))
    rows = conversations.where("conv_id is not null").select("conv_id", "turn", "role", "text")
    rows = rows.withColumn("node", F.row_number().over(order).cast("long"))
    return rows.select(
        F.col("conv_id").cast("long").alias("tree"),
        "node",
        F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"),
        "role",
        "text",
        F.lit(0.0).alias("score"),
    )


def format_trees(nodes: DataFrame, learned_role: str = LEARNED_ROLE, keep_rank: int | None = None) -> DataFrame:
    clean = materialize(clean_nodes(nodes), "chat-nodes")
    return format_paths(ranked_paths(clean, root_to_leaf_paths(clean)), learned_role, keep_rank)


def digest(spark: SparkSession, conversations: DataFrame) -> DataFrame:
    extra = spark.sql(
        "select -7L as conv_id, cast(turn as bigint) as turn, role, :said as text "
        "from values (0, 'user'), (1, 'assistant') as t(turn, role)",
        args={"said": r"\### Assistant: </turn> ok"},
    )
    # turns are numbered after the union: the table may hold a conversation of this id as well
    said = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    out = format_trees(conversation_nodes(said.unionByName(extra)))
    out = out.select(
        F.col("tree").alias("conv_id"), "formatted", parsed_turns().alias("turns"), loss_text().alias("loss")
    )
    said_all = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said_all, 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), e AS (
  SELECT *, length('<|' || replace(replace(replace(role, '\', '\\'), '<|', '<\|'), '|>', '|\>') || '|>' || chr(10)
      || replace(replace(text, '\', '\\'), '<|', '<\|') || '<|end|>' || chr(10)) AS n_piece FROM c
)
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       sum(n_piece)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""
