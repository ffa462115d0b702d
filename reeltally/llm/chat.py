"""Reply trees to formatted conversations, with built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from reeltally.llm.registry import query, table
from reeltally.plans.blocks import numbered
from reeltally.plans.session import discard, shared_dir

# The template: <s>[role] newline text </s> newline.  Inside role and text the characters that begin a mark
# are written as references, "&" first, so every string is restored exactly.
OPEN, HEAD, CLOSE = "<s>[", "]\n", "</s>\n"
ESCAPES = (("&", "&amp;"), ("<", "&lt;"), ("[", "&#91;"), ("\n", "&#10;"))


def escape(text: Column, line: bool = False) -> Column:
    """``line`` also escapes line ends, for roles."""
    for plain, coded in ESCAPES if line else ESCAPES[:3]:
        text = F.replace(text, F.lit(plain), F.lit(coded))
    return text


def unescape(text: Column) -> Column:
    for plain, coded in reversed(ESCAPES):
        text = F.replace(text, F.lit(coded), F.lit(plain))
    return text


def _ancestors(spark: SparkSession, nodes: DataFrame) -> tuple[DataFrame, int]:
    """Self-joins that double the distance: ``ups[k]`` is the ancestor 2**k above, null beyond the root.

    After k rounds a node knows 2**k of its ancestors, so a tree of depth d takes log2(d) rounds.  A node
    that still has an ancestor after as many rounds as its tree has nodes hangs below a cycle: ``up`` stays set.
    """
    state = nodes.select("tree", "node", F.col("parent").alias("up"), F.array("parent").alias("ups"), F.lit(1).cast("long").alias("depth"), "score")
    most = nodes.groupBy("tree").count().agg(F.max("count")).first()[0] or 0
    path, k = None, 0
    while True:
        new = shared_dir(spark)
        state.write.parquet(new)
        if path:
            discard(spark, path)
        path, k = new, k + 1
        state = spark.read.parquet(path)
        if 2 ** (k - 1) > most or state.where("up is not null").isEmpty():
            return state, k
        above = state.select("tree", F.col("node").alias("up"), F.col("up").alias("up2"), F.col("depth").alias("d2"), F.col("score").alias("s2"))
        # Nodes that have reached their root take no part in later rounds.
        rising = state.where("up is not null").join(above, ["tree", "up"], "left").select(
            "tree",
            "node",
            F.col("up2").alias("up"),
            F.concat("ups", F.array("up2")).alias("ups"),
            (F.col("depth") + F.coalesce("d2", F.lit(0))).alias("depth"),
            (F.col("score") + F.coalesce("s2", F.lit(0.0))).alias("score"),
        )
        state = state.where("up is null").unionByName(rising)


def format_conversations(
    messages: DataFrame,
    *,
    tree: str = "tree_id",
    node: str = "node_id",
    parent: str = "parent_id",
    role: str = "role",
    text: str = "text",
    score: str | None = None,
    branches: int = 1,
    learn: str = "assistant",
) -> DataFrame:
    """Formats the ``branches`` best root-to-leaf paths of every reply tree.

    A path's score is the sum of its messages' scores (null: 0); ties go to the smaller leaf.  Only the chosen
    leaves are expanded to paths.  Returns ``tree``, ``leaf``, ``rank`` (from 1), ``n_turns``, ``formatted`` and
    ``loss_runs``: for each turn (skip, take) in code points of its formatted piece; the taken text is what
    training looks at, the texts of role ``learn``.

    Null role and text are empty.  A parent that is null or missing makes a root.  Rows that repeat a node count
    once, the smallest by (parent, score, role, text).  A null tree is a tree of its own.  Messages with a null node,
    and those on or below a cycle, have no path.  Other columns are ignored; no messages give no rows.  A path is one
    string: it may be as long as Spark's strings (2 GB).
    """
    spark = messages.sparkSession
    points = F.col(score).cast("double") if score else F.lit(0.0)
    said = messages.select(
        F.coalesce(F.concat(F.lit("="), F.col(tree).cast("string")), F.lit("null")).alias("tree"),
        F.col(node).cast("long").alias("node"),
        F.col(parent).cast("long").alias("parent"),
        F.coalesce(points, F.lit(0.0)).alias("score"),
        F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"),
        F.col(tree).alias("tree_value"),
    ).where("node is not null")
    said = said.groupBy("tree", "node").agg(F.min(F.struct("parent", "score", "role", "text", "tree_value")).alias("m")).select("tree", "node", "m.*")
    state, rounds = _ancestors(spark, said.select("tree", "node", "parent", "score"))

    parents = state.select("tree", F.col("ups")[0].alias("node")).where("node is not null").distinct()
    leaves = state.where("up is null").join(parents, ["tree", "node"], "left_anti")
    best = W.partitionBy("tree").orderBy(F.desc("score"), "node")
    chosen = leaves.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= branches)

    steps = chosen.select("tree", F.col("node").alias("leaf"), "rank", "depth", "node", F.lit(0).cast("long").alias("up_by"))
    ups = state.select("tree", "node", "ups")
    for k in reversed(range(rounds)):
        above = F.struct(F.get("ups", F.lit(k)).alias("node"), (F.col("up_by") + 2**k).alias("up_by"))
        further = F.explode(F.array(F.struct("node", "up_by"), above)).alias("s")
        steps = steps.join(ups, ["tree", "node"]).select("tree", "leaf", "rank", "depth", further)
        steps = steps.select("tree", "leaf", "rank", "depth", "s.*").where("node is not null")

    head = F.concat(F.lit(OPEN), escape(F.col("role"), line=True), F.lit(HEAD))
    body = escape(F.col("text"))
    take = F.when(F.col("role") == learn, F.length("body")).otherwise(F.lit(0)).cast("long")
    turns = steps.join(said, ["tree", "node"]).select(
        "tree", "tree_value", "leaf", "rank", (F.col("depth") - F.col("up_by")).alias("pos"), "role", head.alias("head"), body.alias("body")
    )
    piece = F.concat("head", "body", F.lit(CLOSE)).alias("piece")
    turns = turns.withColumn("turn", F.struct("pos", piece, F.length("head").cast("long").alias("skip"), take.alias("take")))
    whole = turns.groupBy("tree", "leaf", "rank").agg(F.sort_array(F.collect_list("turn")).alias("turns"), F.min("tree_value").alias("tree_value"))
    return whole.select(
        F.col("tree_value").alias("tree"),
        "leaf",
        "rank",
        F.size("turns").cast("long").alias("n_turns"),
        F.array_join("turns.piece", "").alias("formatted"),
        F.arrays_zip(F.col("turns.skip").alias("skip"), F.col("turns.take").alias("take")).alias("loss_runs"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """Adds ``turns`` (role, text, learned: the text under the loss mask) parsed from the formatted string."""
    pieces = F.split("formatted", CLOSE, -1)
    pieces = F.slice(pieces, 1, F.size(pieces) - 1)

    def turn(piece: Column, run: Column) -> Column:
        head = F.substring_index(piece, "\n", 1)
        name = F.substring(head, F.lit(len(OPEN) + 1), F.length(head) - (len(OPEN) + 1))
        rest = F.substring(piece, F.length(head) + 2, F.length(piece))
        taken = F.substring(piece, (run["skip"] + 1).cast("int"), run["take"].cast("int"))
        return F.struct(unescape(name).alias("role"), unescape(rest).alias("text"), unescape(taken).alias("learned"))

    return formatted.withColumn("turns", F.zip_with(pieces, "loss_runs", turn))


@query(
    "op1_chat_format",
    r"""
    WITH c AS (
        SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
        UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
        UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
    ), e AS (
        SELECT *, length('<s>[' || replace(replace(replace(replace(role, '&', '&amp;'), '<', '&lt;'), '[', '&#91;'), chr(10), '&#10;') || ']' || chr(10)
            || replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '[', '&#91;') || '</s>' || chr(10)) AS n
        FROM c
    )
    SELECT conv_id, count(*) AS n_turns,
           sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
           cast(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
           sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn, role, text)) AS loss_sha256,
           cast(sum(n) AS BIGINT) AS formatted_chars
    FROM e GROUP BY conv_id
    """,
)
def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation is a tree with one branch: each row replies to the row before it."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    own = spark.sql("SELECT -7L conv_id, t turn, r role, '</s>[INST] ok [/INST]' text FROM VALUES (0L, 'user'), (1L, 'assistant') v(t, r)")
    rows = rows.unionByName(own).withColumn("__key", F.coalesce(F.col("conv_id").cast("string"), F.lit("null")))
    rows = numbered(rows, keys=["__key"], order=["turn", "role", "text"], name="node", block=F.expr("coalesce(turn, -9223372036854775808L) div 64"))
    rows = rows.withColumn("parent", F.when(F.col("node") > 0, F.col("node") - 1))
    out = read_back(format_conversations(rows, tree="conv_id", node="node", parent="parent"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    learned = F.array_join("turns.learned", "")
    return out.select(
        F.col("tree").alias("conv_id"),
        "n_turns",
        F.sha2(said, 256).alias("turns_sha256"),
        F.length(learned).cast("long").alias("loss_chars"),
        F.sha2(learned, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
