"""Operator 9: reply trees to formatted conversations.

Messages are nodes of trees: (tree, node, parent, role, text, score). Root-to-leaf paths are enumerated
by iterative self-joins that double: the table of 2**k-th ancestors joined with itself gives that of
2**(k+1), and the pairs (leaf, ancestor at distance d) for d < 2**k, moved up by 2**k, give those
below 2**(k+1). So a path of n messages takes log2(n) rounds and no list is carried on the way.
Leaves of a tree are ranked by the sum of their path's scores, ties by the smaller leaf id, and the
best ``keep`` paths are formatted, each as one conversation with the character spans that
count for the loss (the assistant's texts).

The template is ``<|im_start|>role NEWLINE text<|im_end|> NEWLINE`` for each turn. Inside a role or text a backslash
is doubled and ``<|`` becomes ``<\\|``, so no control string can stand there and the change can be undone; in
a role a line break becomes ``\\n``.

A conversation is one row of the result, so it has to fit into one; nothing else of a tree is gathered.

Defined results: null roles and texts are empty; the rows without a conversation id are one conversation, whose id reads back as null (within
the trees it is ``NO_ID``, which is no other conversation's); null turns come first; a parent that
is absent, or a node's own id, makes a root; equal (tree, node) rows are rejected by callers' numbering
(``chain`` numbers rows by turn, role and text, so ties and repeated rows stay separate turns); empty
tables give an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.workspace import Workspace

BEGIN, END = "<|im_start|>", "<|im_end|>"
MAX_DOUBLINGS = 40
#: The tree of rows without an id.
NO_ID = -(1 << 63)


def escaped(c: Column, role: bool = False) -> Column:
    c = F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))
    return F.replace(c, F.lit("\n"), F.lit("\\n")) if role else c


def unescaped(s: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], s, flags=re.S)


def chain(rows: DataFrame, tree: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Nodes of unbranched conversations: every row replies to the one before it."""
    w = Window.partitionBy("tree").orderBy("turn", "role", "text")
    d = rows.select(
        F.coalesce(rows[tree].cast("long"), F.lit(NO_ID)).alias("tree"), rows[turn].alias("turn"), F.coalesce(rows[role].cast("string"), F.lit("")).alias("role"), F.coalesce(rows[text].cast("string"), F.lit("")).alias("text")
    )
    d = d.withColumn("node", F.row_number().over(w).cast("long"))
    return d.select("tree", "node", (F.col("node") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def paths(nodes: DataFrame, work: Workspace) -> DataFrame:
    """(tree, leaf, node, up): every node of every root-to-leaf path and its distance from the leaf."""
    key = nodes.select("tree", "node", "parent")
    up = key.where("parent <> node").join(key.select("tree", F.col("node").alias("parent")), ["tree", "parent"]).select("tree", "node", F.col("parent").alias("above"))
    up = work.save(up, "up-0")
    leaves = key.select("tree", "node").join(up.select("tree", F.col("above").alias("node")).distinct(), ["tree", "node"], "left_anti")
    out = work.save(leaves.select("tree", F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("up")), "paths-0")
    k = 0
    while not up.isEmpty():
        if k > MAX_DOUBLINGS:
            raise ValueError("replies form a cycle")
        higher = out.join(up, ["tree", "node"]).select("tree", "leaf", F.col("above").alias("node"), (F.col("up") + (1 << k)).alias("up"))
        out = work.save(out.union(higher), f"paths-{k + 1}")
        up = work.save(up.join(up.select("tree", F.col("node").alias("above"), F.col("above").alias("next")), ["tree", "above"]).select("tree", "node", F.col("next").alias("above")), f"up-{k + 1}")
        work.drop(f"paths-{k}")
        work.drop(f"up-{k}")
        k += 1
    return out


def chosen_paths(nodes: DataFrame, on_path: DataFrame, keep: int) -> DataFrame:
    """(tree, leaf, rank): the best leaves of each tree by the sum of the scores on their paths."""
    s = on_path.join(nodes.select("tree", "node", "score"), ["tree", "node"]).groupBy("tree", "leaf").agg(F.sum("score").alias("s"))
    if keep == 1:
        best = s.groupBy("tree").agg(F.max(F.struct("s", (-F.col("leaf")).alias("l"))).alias("x"))
        return best.select("tree", (-F.col("x.l")).alias("leaf"), F.lit(1).alias("rank"))
    w = Window.partitionBy("tree").orderBy(F.desc("s"), "leaf")
    return s.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= keep).select("tree", "leaf", "rank")


def format_trees(spark: SparkSession, nodes: DataFrame, keep: int = 1) -> DataFrame:
    """(tree, rank, formatted, loss): loss holds [start, end) character spans of the assistant's texts."""
    work = Workspace(spark, "chat")
    nodes = work.save(nodes, "nodes")
    on_path = paths(nodes, work)
    best = chosen_paths(nodes, on_path, keep)
    turn = on_path.join(best, ["tree", "leaf"]).join(nodes, ["tree", "node"])
    head = F.concat(F.lit(BEGIN), escaped(F.col("role"), role=True), F.lit("\n"))
    turn = turn.select("tree", "rank", F.struct((-F.col("up")).alias("at"), head.alias("head"), escaped(F.col("text")).alias("body"), (F.col("role") == "assistant").alias("own")).alias("t"))
    g = turn.groupBy("tree", "rank").agg(F.array_sort(F.collect_list("t")).alias("t"))
    whole = F.array_join(F.transform("t", lambda t: F.concat(t.head, t.body, F.lit(END + "\n"))), "")
    empty = F.array().cast("array<struct<s:int,e:int>>")
    spans = F.aggregate(
        "t", F.struct(F.lit(0).alias("n"), empty.alias("x")),
        lambda a, t: F.struct(
            (a.n + F.length(t.head) + F.length(t.body) + len(END) + 1).alias("n"),
            F.when(t.own, F.concat(a.x, F.array(F.struct((a.n + F.length(t.head)).alias("s"), (a.n + F.length(t.head) + F.length(t.body)).alias("e"))))).otherwise(a.x).alias("x"),
        ),
        lambda a: a.x,
    )
    out = work.save(g.select("tree", "rank", whole.alias("formatted"), spans.alias("loss")), "formatted")
    work.drop("nodes", *(f"{x}-{k}" for x in ("paths", "up") for k in range(MAX_DOUBLINGS + 2)))
    return out


def read_back(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted conversation."""
    out = []
    for part in formatted.split(END + "\n")[:-1]:
        if not part.startswith(BEGIN):
            raise ValueError("a turn begins with " + BEGIN)
        role, _, text = part[len(BEGIN) :].partition("\n")
        out.append((unescaped(role), unescaped(text)))
    return out


def digests(formatted: DataFrame, id_name: str = "conv_id") -> DataFrame:
    """Counts and digests of what stands in the formatted conversations."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            rows = []
            for text, loss in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                turns = read_back(text)
                under = "".join(unescaped(text[x["s"] : x["e"]]) for x in loss)
                rows.append((len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), len(under), hashlib.sha256(under.encode()).hexdigest(), len(text)))
            cols = list(zip(*rows, strict=True)) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *[pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()), strict=True)]],
                names=["tree", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"],
            )

    schema = "tree long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return formatted.select("tree", "formatted", "loss").mapInArrow(run, schema).withColumn("tree", F.nullif("tree", F.lit(NO_ID))).withColumnRenamed("tree", id_name)
