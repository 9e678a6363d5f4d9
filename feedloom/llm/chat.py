"""Reply trees to conversations: paths by self-joins, branches ranked by score, reversible template."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedloom.operators.latest import latest_per_key, top_n_per_key
from feedloom.operators.skew import distinct_keys, left_join_unique
from feedloom.operators.stage import compute_once
from feedloom.session import materialize

# The marks of a turn, and strings of chat templates that a text must not hold as they are.
START, BETWEEN, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
CONTROLS = ["<|", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"]
ESCAPE = "\\"
TRAINED = "assistant"


def escaped(text: Column) -> Column:
    """The text with escapes doubled and one put behind the first character of each control string."""
    out = F.replace(text, F.lit(ESCAPE), F.lit(ESCAPE * 2))
    for control in CONTROLS:
        out = F.replace(out, F.lit(control), F.lit(control[0] + ESCAPE + control[1:]))
    return out


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def linear_messages(rows: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """(conv, node, parent, role, text, score): each row answers the one before it in its conversation.

    Rows stand by turn, null first, then role and text.
    """
    plain = rows.select(
        F.col(conv).alias("conv"),
        F.col(turn).alias("turn"),
        F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"),
    )
    place = F.row_number().over(Window.partitionBy("conv").orderBy("turn", "role", "text")).cast("long")
    parent = F.when(F.col("node") > 1, F.col("node") - 1)
    return plain.withColumn("node", place).select(
        "conv", "node", parent.alias("parent"), "role", "text", F.lit(0.0).alias("score")
    )


def tree_messages(
    rows: DataFrame, conv: str, node: str, parent: str, role: str, text: str, score: str | None
) -> DataFrame:
    """(conv, node, parent, role, text, score) with one row per message id of a tree."""
    plain = rows.filter(F.col(node).isNotNull()).select(
        F.col(conv).alias("conv"),
        F.col(node).alias("node"),
        F.col(parent).cast(rows.schema[node].dataType).alias("parent"),
        F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"),
        (F.lit(0.0) if score is None else F.coalesce(F.col(score).cast("double"), F.lit(0.0))).alias("score"),
    )
    return latest_per_key(plain, ["conv", "node"], [F.col(c) for c in ("parent", "role", "text", "score")])


def _key(node: str) -> Column:
    return F.when(F.col(node).isNotNull(), F.struct("conv", F.col(node).alias("node")))


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def ancestors(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """Tables (key, jump) of the ancestors 1, 2, 4, ... replies above, and (conv, key, total, depth).

    ``nodes`` has conv, key, up and score. Each round joins the messages that are open with what
    their ancestor knows, which doubles the distance, so a path of n messages takes log2(n) rounds.
    A message whose parent does not exist is a root. One
    that is open after more replies than there are messages is on or below a cycle and has no total.
    """
    n_messages = nodes.count()
    state = nodes.select(
        "conv", "key", F.col("up").alias("jump"), F.col("score").alias("total"), F.lit(1).cast("long").alias("depth")
    )
    jumps: list[DataFrame] = []
    settled: list[DataFrame] = []
    reached = 1
    while True:
        waiting = state.filter(F.col("jump").isNotNull())
        if reached > n_messages or waiting.isEmpty():
            break
        wanted = distinct_keys(waiting, "jump").withColumnRenamed("jump", "__wanted")
        # few are wanted in late rounds, so that what is known is scanned in place
        known = _union([state, *settled]).join(wanted, F.col("key") == F.col("__wanted"), "left_semi").select(
            F.col("key").alias("__key"),
            F.col("jump").alias("__jump"),
            F.col("total").alias("__total"),
            F.col("depth").alias("__depth"),
        )
        settled.append(state.filter(F.col("jump").isNull()))
        found = materialize(left_join_unique(waiting, known, "jump", "__key"))
        jumps.append(found.filter("__depth IS NOT NULL").select("key", "jump"))
        state = found.select(
            "conv",
            "key",
            F.col("__jump").alias("jump"),
            (F.col("total") + F.coalesce("__total", F.lit(0.0))).alias("total"),
            (F.col("depth") + F.coalesce("__depth", F.lit(0))).alias("depth"),
        )
        reached *= 2
    ended = _union([*settled, state.filter(F.col("jump").isNull())])
    return jumps, ended.select("conv", "key", "total", "depth")


def best_paths(nodes: DataFrame, keep: int) -> DataFrame:
    """(leaf, path_rank, total, key, above): the messages of the ``keep`` best branches of each tree.

    A branch runs from the root to a message without answers; the one with the larger sum of scores
    is better, then the longer, then the one with the smaller last id. ``above`` is the distance from
    the leaf. Chosen leaves climb by the tables of ``ancestors``: what is within 2^k replies of them
    joins the ancestors 2^k above, so only messages of chosen paths are listed, each once per path.
    """
    jumps, ended = ancestors(nodes)
    answered = distinct_keys(nodes, "up").withColumnRenamed("up", "__up")
    leaves = ended.join(answered, F.col("key") == F.col("__up"), "left_anti")
    order = [F.col("total").desc(), F.col("depth").desc(), F.col("key")]
    best = top_n_per_key(leaves, ["conv"], order, keep, "path_rank")
    parts = [
        materialize(best.select(F.col("key").alias("leaf"), "path_rank", "total", "key", F.lit(0).cast("long").alias("above")))
    ]
    for k, jump in enumerate(jumps):
        higher = _union(parts).join(jump, "key").select(
            "leaf", "path_rank", "total", F.col("jump").alias("key"), (F.col("above") + (1 << k)).alias("above")
        )
        parts.append(materialize(higher))
    return _union(parts)


def format_messages(messages: DataFrame, keep: int = 1, trained: str = TRAINED) -> DataFrame:
    """(conv, leaf, path_rank, score, n_turns, formatted, loss_spans) from messages with unique ids."""
    nodes = materialize(messages.select("conv", _key("node").alias("key"), _key("parent").alias("up"), "score"))
    paths = best_paths(nodes, keep)
    turns = paths.join(messages.select(_key("node").alias("key"), "role", "text"), "key")
    head = F.concat(F.lit(START), escaped(F.col("role")), F.lit(BETWEEN))
    turns = turns.select(
        "leaf", "path_rank", "total", "above", F.col("role").eqNullSafe(trained).alias("trained"),
        head.alias("head"), escaped(F.col("text")).alias("body"),
    )
    place = Window.partitionBy("leaf", "path_rank", "total").orderBy(F.col("above").desc())
    size = F.octet_length("head") + F.octet_length("body") + len(END)
    before = F.sum(size).over(place.rowsBetween(Window.unboundedPreceding, -1))
    start = F.coalesce(before, F.lit(0)) + F.octet_length("head")
    span = F.struct(start.alias("start"), (start + F.octet_length("body")).alias("stop"))
    turn = F.struct((-F.col("above")).alias("at"), F.concat("head", "body", F.lit(END)).alias("text"), "span")
    whole = (
        turns.withColumn("span", F.when(F.col("trained"), span))
        .groupBy("leaf", "path_rank", "total")
        .agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    )
    return whole.select(
        F.col("leaf.conv").alias("conv"),
        F.col("leaf.node").alias("leaf"),
        "path_rank",
        F.col("total").alias("score"),
        F.size("turns").cast("long").alias("n_turns"),
        F.array_join("turns.text", "").alias("formatted"),
        F.array_compact("turns.span").alias("loss_spans"),
    )


def format_trees(
    rows: DataFrame,
    conv: str = "conv_id",
    node: str = "node",
    parent: str = "parent",
    role: str = "role",
    text: str = "text",
    score: str | None = None,
    keep: int = 1,
) -> DataFrame:
    """(conv, leaf, path_rank, score, n_turns, formatted, loss_spans): the best paths of reply trees.

    Each tree gives its ``keep`` best branches, root to leaf, as one conversation each. A turn is
    written between marks; control strings inside roles and texts are escaped, which ``read_back``
    undoes. ``loss_spans`` are the UTF-8 byte ranges of the assistant's texts, the parts to train on.

    A null conversation is one tree. Null roles, texts and scores are '', '' and 0; rows without an id
    are left out. A message whose parent is null or missing is a root, so a tree may have several.
    Messages on or below a cycle belong to no path. Of rows with one id the first by parent, role,
    text and score counts. Equal branches are ranked by their last id. A path is one row, however
    long its texts. Other columns are not read, whatever their names. An empty table gives no rows.
    """
    return format_messages(materialize(tree_messages(rows, conv, node, parent, role, text, score)), keep)


def format_conversations(
    rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """``format_trees`` for tables in which each row answers the one before it.

    Rows stand by turn, null first, then role and text; every row is a turn, repeated ones as often
    as they come. All else is as in ``format_trees``.
    """
    return format_messages(materialize(linear_messages(rows, conv, turn, role, text)))


def read_back(formatted: DataFrame) -> DataFrame:
    """Adds ``turns`` (role, text) and ``loss_texts``, read from ``formatted`` and ``loss_spans`` alone."""
    ended = F.split("formatted", END.replace("|", r"\|"))
    pieces = F.slice(ended, 1, F.size(ended) - 1)

    def turn(piece: Column) -> Column:
        role = F.substring(F.split_part(piece, F.lit(BETWEEN), F.lit(1)), len(START) + 1, 2147483647)
        said = F.split_part(piece, F.lit(BETWEEN), F.lit(2))
        return F.struct(unescaped(role).alias("role"), unescaped(said).alias("text"))

    def part(span: Column) -> Column:
        start, stop = span["start"].cast("int"), span["stop"].cast("int")
        return unescaped(F.decode(F.substring(F.col("__bytes"), start + 1, stop - start), "UTF-8"))

    # once per row, not once per span
    staged = compute_once(formatted, {"__bytes": F.encode("formatted", "UTF-8"), "__pieces": pieces})
    return staged.withColumns(
        {"turns": F.transform("__pieces", turn), "loss_texts": F.transform("loss_spans", part)}
    ).drop("__bytes", "__pieces")


def conversation_digests(
    rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars), read back from the output.

    The table is formatted together with conversation -7, whose texts are control strings. Special
    cases are those of ``format_conversations``; an empty table gives conversation -7 alone.
    """
    plain = rows.select(
        F.col(conv).cast("long").alias("conv_id"),
        F.col(turn).cast("long").alias("turn"),
        F.col(role).cast("string").alias("role"),
        F.col(text).cast("string").alias("text"),
    )
    said = "</s>[INST] ok [/INST]"
    planted = rows.sparkSession.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], plain.schema)
    back = read_back(format_conversations(plain.unionByName(planted)))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    trained = F.array_join("loss_texts", "")
    return back.select(
        F.col("conv").alias("conv_id"),
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(told, 256).alias("turns_sha256"),
        F.length(trained).cast("long").alias("loss_chars"),
        F.sha2(trained, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
