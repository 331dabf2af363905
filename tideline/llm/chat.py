"""Chat formatting of reply trees, in DataFrame functions only.

Every message points to the one it answers. Root-to-leaf paths are found by self-joins
that double the distance covered, paths are ranked by the mean score of their messages,
and each chosen one becomes one conversation in a marked-up text with a loss mask.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.llm.common import written

BEGIN, END = "<|im_start|>", "<|im_end|>\n"
LOSS_ROLE = "assistant"


def escaped(c: Column) -> Column:
    r"""Text without control strings: ``<``, any backslashes and ``|`` get one backslash more."""
    return F.regexp_replace(c, r"<(\\*)\|", r"<\\$1|")


def unescaped(c: Column) -> Column:
    return F.regexp_replace(c, r"<\\(\\*)\|", r"<$1|")


def role_escaped(c: Column) -> Column:
    """As :func:`escaped`, and on one line."""
    return escaped(F.replace(F.replace(c, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")))


def role_unescaped(c: Column) -> Column:
    return F.replace(F.replace(unescaped(c), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def turns_of(formatted: Column) -> Column:
    """Reads a formatted text back: an array of (role, text)."""
    pieces = F.split(formatted, r"<\|im_end\|>\n")
    pieces = F.slice(pieces, 1, F.size(pieces) - 1)

    def turn(piece: Column) -> Column:
        line = F.instr(piece, "\n")
        role = F.substring(piece, F.lit(len(BEGIN) + 1), line - len(BEGIN) - 1)
        text = F.substring(piece, line + 1, F.length(piece))
        return F.struct(role_unescaped(role).alias("role"), unescaped(text).alias("text"))

    return F.transform(pieces, turn)


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped."""
    parts = F.transform(
        spans, lambda s: unescaped(F.substring(formatted, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))
    )
    return F.array_join(parts, "")


def _named(c: Column, missing: Column | None = None) -> Column:
    """A key that is never null, and differs for null and all values."""
    return F.coalesce(F.concat(F.lit("k"), c.cast("string")), missing if missing is not None else F.lit("n"))


def _doubled(messages: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """Ancestor tables and path totals.

    Table k has (tree, node, up) with the ancestor 2^k messages above. The totals
    (tree, node, n, total) cover a node's whole path; nodes on or below a circle of
    replies have no root, and so no path.
    """
    known = messages.select("tree", F.col("node").alias("at"))
    state = messages.join(known.withColumnRenamed("tree", "t"), (F.col("tree") == F.col("t")) & (F.col("parent") == F.col("at")), "left")
    state = written(
        state.select("tree", "node", F.col("at").alias("up"), F.lit(1).cast("bigint").alias("n"), F.col("score").alias("total")), "paths"
    )
    settled, climbing = state.where("up is null"), state.where("up is not null")
    levels, open_before = [], None
    while True:
        still = climbing.count()
        if not still or still == open_before:
            return levels, settled.select("tree", "node", "n", "total")
        open_before = still
        levels.append(climbing.select("tree", "node", "up"))
        above = settled.unionByName(climbing).select(
            F.col("tree").alias("t"), F.col("node").alias("at"), F.col("up").alias("next"), F.col("n").alias("m"), F.col("total").alias("more")
        )
        # Only paths that have not come to their root are joined and written again.
        step = written(
            climbing.join(above, (F.col("tree") == F.col("t")) & (F.col("up") == F.col("at"))).select(
                "tree", "node", F.col("next").alias("up"),
                (F.col("n") + F.col("m")).alias("n"), (F.col("total") + F.col("more")).alias("total"),
            ),
            "paths",
        )
        settled, climbing = settled.unionByName(step.where("up is null")), step.where("up is not null")


def conversations(
    df: DataFrame,
    tree: str,
    node: str,
    parent: str,
    role: str = "role",
    text: str = "text",
    score: str | None = None,
    best: int | None = 1,
    loss_role: str = LOSS_ROLE,
) -> DataFrame:
    """A row for each of the ``best`` paths (all, if None) of each tree.

    Columns: ``tree``, ``leaf`` (the last message's id as text), ``rank``, ``score``
    (mean of the path, a null counts as 0), ``n_turns``, ``formatted`` and
    ``loss_spans``, the [start, end) character spans of the texts of ``loss_role``.
    Equal scores are ranked by the longer path, then the leaf.

    Null texts and roles are empty. A parent that does not exist makes a root. Null
    trees form one tree; a message without an id gets one of its contents. Of
    messages that repeat an id the smallest (role, text) counts. Messages on or below
    a circle of replies belong to no path.
    """
    kind = df.select(F.col(tree).alias("t")).schema["t"].dataType
    content = (F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    own = F.concat(F.lit("n"), F.xxhash64(F.col(parent), F.col(role), F.col(text)).cast("string"))
    messages = df.select(
        _named(F.col(tree)).alias("tree"), F.col(tree).alias("name"), _named(F.col(node), own).alias("node"),
        F.concat(F.lit("k"), F.col(parent).cast("string")).alias("parent"), *content,
        (F.coalesce(F.col(score).cast("double"), F.lit(0.0)) if score else F.lit(0.0)).alias("score"),
    )
    one = F.min(F.struct("role", "text", "parent", "score", "name")).alias("m")
    messages = written(messages.groupBy("tree", "node").agg(one).select("tree", "node", "m.*"), "messages")

    levels, totals = _doubled(messages.select("tree", "node", "parent", "score"))
    answered = messages.where("parent is not null").select("tree", F.col("parent").alias("node")).distinct()
    paths = totals.join(answered, ["tree", "node"], "left_anti").withColumn("path_score", F.col("total") / F.col("n"))
    order = Window.partitionBy("tree").orderBy(F.desc("path_score"), F.desc("n"), "node")
    if best is None:
        chosen = paths.withColumn("rank", F.row_number().over(order))
    else:  # the best of each task are picked before the shuffle
        chosen = paths.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= best)
    chosen = written(chosen.select("tree", F.col("node").alias("leaf"), "rank", "path_score"), "chosen")

    on_path = chosen.select("tree", "leaf", F.col("leaf").alias("node"), F.lit(0).cast("bigint").alias("above"))
    for k in reversed(range(len(levels))):
        higher = on_path.join(levels[k], ["tree", "node"]).select("tree", "leaf", F.col("up").alias("node"), (F.col("above") + (1 << k)).alias("above"))
        on_path = written(on_path.unionByName(higher), "on_path")

    turns = on_path.join(messages.select("tree", "node", "name", "role", "text"), ["tree", "node"])
    head = F.concat(F.lit(BEGIN), role_escaped(F.col("role")), F.lit("\n"))
    turns = turns.select(
        "tree", "leaf", "name", "above", head.alias("head"), escaped(F.col("text")).alias("body"), (F.col("role") == loss_role).alias("loss")
    ).withColumn("size", F.length("head") + F.length("body") + len(END))
    path = Window.partitionBy("tree", "leaf").orderBy(F.desc("above"))
    before = F.coalesce(F.sum("size").over(path.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    turns = turns.withColumn("start", before + F.length("head")).withColumn("end", F.col("start") + F.length("body"))
    piece = F.struct("start", "end", "loss", F.concat("head", "body", F.lit(END)).alias("piece"), "name")
    made = turns.groupBy("tree", "leaf").agg(F.sort_array(F.collect_list(piece)).alias("turns"))
    spans = F.transform(F.filter("turns", lambda t: t["loss"]), lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end")))
    return made.join(chosen, ["tree", "leaf"]).select(
        F.col("turns")[0]["name"].cast(kind).alias("tree"),
        F.expr("substring(leaf, 2)").alias("leaf"), "rank", F.col("path_score").alias("score"),
        F.size("turns").cast("bigint").alias("n_turns"),
        F.array_join(F.transform("turns", lambda t: t["piece"]), "").alias("formatted"), spans.alias("loss_spans"),
    )


def from_turns(
    df: DataFrame, key: str = "conv_id", turn: str = "turn", node: str = "node", parent: str = "parent"
) -> DataFrame:
    """Rows of linear conversations as a reply tree: each row answers the one before.

    Adds the columns ``node`` and ``parent``, in place of columns of these names; choose
    others to keep those. Rows are ordered by turn, then role and text.
    """
    order = Window.partitionBy(key).orderBy(turn, "role", "text")
    at = F.row_number().over(order)
    return df.withColumns({node: at, parent: at - 1})
