"""Chat formatting of reply trees, with DataFrame functions alone.

Iterative self-joins double the reach of every node's pointer towards its root, adding up depths and scores: a reply chain of d turns takes
log2(d) joins. Each conversation's leaves, that is its branches, are ranked by mean score (ties: the smaller leaf). The same pointers then
enumerate the chosen root-to-leaf paths, the longest jumps first, and every path is formatted as one conversation. Texts are joined to the
chosen paths only. Every round's pointers are written to the shared folder, so lineage stays short and a lost executor costs one round.

Template, per turn: ``<|im_start|>role``, a line feed, the text, ``<|im_end|>`` and a line feed. Inside texts ``\\`` is doubled and
``<|`` becomes ``<\\|``, so no control string can occur in one, and back again; in roles ``%``, line feeds and ``<|`` are percent-coded.
The loss mask is an array of spans (start, length, in characters of the formatted string; first_byte, bytes, the same in UTF-8) that cover
the assistant texts and nothing else.

Edge cases: null texts and roles are empty ones; a node whose parent is null or absent is a root; rows on or below a cycle hang below no
root and are in no path; of rows that repeat a node of a conversation the smallest (by parent, role, text, score) counts; null conversation ids are one conversation; no rows
give no rows; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tesserae.session import keep

START, END = "<|im_start|>", "<|im_end|>"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("<\\|"), F.lit("<|")), F.lit("\\\\"), F.lit("\\"))


def escape_role(role: Column) -> Column:
    return F.replace(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")), F.lit("<|"), F.lit("%3C|"))


def unescape_role(role: Column) -> Column:
    return F.replace(F.replace(F.replace(role, F.lit("%3C|"), F.lit("<|")), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def pointers(nodes: DataFrame) -> list[DataFrame]:
    """Round by round: conv_id, node, up, dist, total. nodes: conv_id, node, parent, score; a node once.

    In round k ``up`` is the ancestor 2^k steps above, or null where the root is nearer; dist and total are the number and the scores of
    the nodes from the node to below ``up``, to the root where it is null. In the last round every node below a root has no ``up``.
    """
    ids = nodes.select(F.col("conv_id").alias("c"), F.col("node").alias("up"))
    first = nodes.join(ids, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("parent") == F.col("up")), "left")
    rounds = [keep(first.select("conv_id", "node", "up", F.lit(1).alias("dist"), F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("total")), "pointers")]
    most = nodes.groupBy("conv_id").count().agg(F.max("count")).first()[0] or 0
    while not rounds[-1].where("up is not null").isEmpty() and 1 << len(rounds) - 1 <= most:
        now = rounds[-1]
        above = now.select(F.col("conv_id").alias("c"), F.col("node").alias("n"), F.col("up").alias("next"), F.col("dist").alias("more"), F.col("total").alias("plus"))
        jump = now.join(above, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("up") == F.col("n")), "left")
        rounds.append(keep(jump.select("conv_id", "node", F.col("next").alias("up"), (F.col("dist") + F.coalesce("more", F.lit(0))).alias("dist"), (F.col("total") + F.coalesce("plus", F.lit(0.0))).alias("total")), "pointers"))
    return rounds


def paths(nodes: DataFrame, keep_branches: int = 1) -> DataFrame:
    """conv_id, branch, score, node, place (from 1, the root's) of every node of each conversation's best branches."""
    rounds = pointers(nodes)
    rooted = rounds[-1].where("up is null")
    parents = nodes.where("parent is not null").select(F.col("conv_id").alias("c"), F.col("parent").alias("n"))
    leaves = rooted.join(parents, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("node") == F.col("n")), "left_anti").withColumn("score", F.col("total") / F.col("dist"))
    order = Window.partitionBy("conv_id").orderBy(F.desc("score"), "node")
    best = leaves.withColumn("branch", F.row_number().over(order)).where(F.col("branch") <= keep_branches)
    steps = best.select("conv_id", "branch", "score", "node")
    for jumps in reversed(rounds[:-1]):
        above = jumps.where("up is not null").select(F.col("conv_id").alias("c"), F.col("node").alias("n"), "up")
        met = steps.join(above, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("node") == F.col("n")), "left")
        steps = met.select("conv_id", "branch", "score", F.explode(F.array_compact(F.array("node", "up"))).alias("node"))
    depth = rooted.select(F.col("conv_id").alias("c"), F.col("node").alias("n"), F.col("dist").alias("place"))
    return steps.join(depth, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("node") == F.col("n"))).select("conv_id", "branch", "score", "node", "place")


def format_turns(turns: Column) -> Column:
    """The formatted string of an array of struct(role, text)."""
    piece = lambda t: F.concat(F.lit(START), escape_role(t["role"]), F.lit("\n"), escape(t["text"]), F.lit(END + "\n"))
    return F.array_join(F.transform(turns, piece), "")


def placed_turns(turns: DataFrame) -> DataFrame:
    """Adds to rows (conv_id, branch, place, role, text) where the text stands in ``format_turns``'s string: ``span`` (start, length in
    characters, first_byte, bytes). Running sums over a branch, so a turn costs the same wherever it stands."""
    before = Window.partitionBy("conv_id", "branch").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    fields = []
    for size, start, length in ((F.length, "start", "length"), (F.octet_length, "first_byte", "bytes")):
        head = F.lit(len(START) + 1) + size(escape_role(F.col("role")))
        text = size(escape(F.col("text")))
        at = F.coalesce(F.sum(head + text + F.lit(len(END) + 1)).over(before), F.lit(0))
        fields += [(at + head).cast("int").alias(start), text.alias(length)]
    return turns.withColumn("span", F.struct(*fields))


def conversations(nodes: DataFrame, keep_branches: int = 1, role: str = "assistant") -> DataFrame:
    """conv_id, branch (from 1), score, formatted, loss: the best branches of each conversation. nodes: conv_id, node, parent, role, text, score.

    loss: the spans of the texts of ``role`` in formatted.
    """
    row = F.struct("parent", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), "score")
    nodes = keep(nodes.groupBy("conv_id", "node").agg(F.min(row).alias("r")).select("conv_id", "node", "r.*"), "replies")
    steps = paths(nodes.select("conv_id", "node", "parent", "score"), keep_branches)
    texts = nodes.select(F.col("conv_id").alias("c"), F.col("node").alias("n"), "role", "text")
    placed = steps.join(texts, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("node") == F.col("n")))
    each = F.array_sort(F.collect_list(F.struct("place", "role", "text", "span")))
    turns = placed_turns(placed).groupBy("conv_id", "branch").agg(F.first("score").alias("score"), each.alias("turns"))
    said = F.filter("turns", lambda t: t["role"] == role)
    return turns.select("conv_id", "branch", "score", format_turns(F.col("turns")).alias("formatted"), F.transform(said, lambda t: t["span"]).alias("loss"))


def read_back(formatted: Column) -> Column:
    """The array of struct(role, text) that a formatted string was made of."""
    pieces = F.split(formatted, r"<\|im_end\|>\n", -1)
    head = lambda p: F.substring_index(p, "\n", 1)
    turn = lambda p: F.struct(unescape_role(F.substr(head(p), F.lit(len(START) + 1))).alias("role"), unescape(F.substr(p, F.length(head(p)) + 2)).alias("text"))
    return F.transform(F.slice(pieces, 1, F.size(pieces) - 1), turn)


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, one span after the other. Cut by bytes: finding a character takes all those before it."""
    data = formatted.cast("binary")
    return F.array_join(F.transform(spans, lambda s: unescape(F.substr(data, s["first_byte"] + 1, s["bytes"]).cast("string"))), "")


def chains(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) as reply trees of one branch each: every turn replies to the one before it."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    node = rows.select("conv_id", F.row_number().over(order).alias("node"), "role", "text")
    return node.select("conv_id", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def digest(formatted: DataFrame) -> DataFrame:
    """What the formatted strings say when read back: counts, lengths and SHA-256."""
    turns = formatted.select("conv_id", "formatted", "loss", read_back(F.col("formatted")).alias("turns"), loss_text(F.col("formatted"), F.col("loss")).alias("under"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return turns.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("under").cast("long").alias("loss_chars"),
        F.sha2(F.col("under"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
