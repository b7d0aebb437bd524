"""Reply trees and their branches as formatted conversations.

Messages answer messages; each way from a tree's first message to one without answers is
a branch. Iterative self-joins double how far each message sees towards its root, so that
a branch of n messages takes log2 n joins, first upwards for the branches' scores and
then, for the branches that are chosen, for their messages. No text takes part before
the chosen messages get theirs.

A template marks the turns of a branch and escapes what could be taken for its marks, so
that turns and the text that training learns from can be read back exactly.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadenza.llm.store import keep, shared_folder

#: Trees of more messages are joined in SALTS places and dealt out by message and branch.
TREE_ROWS, SALTS = 100_000, 8
#: Code points after which a formatted branch goes on in a further part.
PART_CHARS = 1 << 24


@dataclass(frozen=True)
class Template:
    """Marks of turns, and the control strings that texts must not hold.

    A control string's first character stands in none of them but at its start; so they
    cannot overlap, and a backslash after that character (one more, if there are some) breaks
    them in a way that can be undone.
    """

    begin: str = "<|im_start|>"
    end: str = "<|im_end|>"
    learned: tuple[str, ...] = ("assistant",)
    controls: tuple[str, ...] = ("<|im_start|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]")

    def __post_init__(self):
        heads = {c[0] for c in self.controls}
        if not {self.begin, self.end} <= set(self.controls) or any(h in c[1:] for h in heads for c in self.controls) or "\\" in "".join(self.controls):
            raise ValueError("control strings must hold the marks, no backslash, and their first characters only at the start")

    def _rest(self) -> str:
        heads = sorted({c[0] for c in self.controls})
        rests = ("|".join(re.escape(c[1:]) for c in self.controls if c[0] == h) for h in heads)
        return "|".join(rf"(?<={re.escape(h)}){{}}(?=\\*(?:{r}))" for h, r in zip(heads, rests, strict=True))

    def escape(self, text: Column) -> Column:
        return F.regexp_replace(text, self._rest().replace("{}", ""), r"\\")

    def unescape(self, text: str) -> str:
        return re.sub(self._rest().replace("{}", r"\\"), "", text)

    def head(self, role: Column) -> Column:
        """What stands before a turn's text."""
        line = F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n"))
        return F.concat(F.lit(self.begin), self.escape(line), F.lit("\n"))

    def tail(self) -> str:
        return f"{self.end}\n"

    def turns(self, formatted: str) -> Iterator[tuple[str, int, int]]:
        """(role, start of its text, end) of each turn of a formatted text; anything else in it is an error."""
        at = 0
        while at < len(formatted):
            line = formatted.find("\n", at)
            close = formatted.find(self.tail(), line + 1)
            if not formatted.startswith(self.begin, at) or line < 0 or close < 0:
                raise ValueError(f"no turn at {at}")
            role = self.unescape(formatted[at + len(self.begin) : line])
            yield re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], role), line + 1, close
            at = close + len(self.tail())


CHAT = Template()


def _tree(of: str) -> Column:
    return F.struct(F.col(of).alias("of"))  # a struct, so that null names a tree too


def chain(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn") -> DataFrame:
    """(tree, node, up, leaf, score, size): conversations as trees in which each turn answers the one before it.

    Nodes are turns with a number among equals, which is their order by role and text. A
    null turn comes first; rows without a conversation make one together. One task sorts the
    turn numbers, without texts, of a conversation.
    """
    equals = conversations.select(_tree(conv_col).alias("tree"), F.col(turn_col).alias("id")).groupBy("tree", "id").agg(F.count(F.lit(1)).alias("n"))
    rows = equals.select("tree", "id", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("copy")).select("tree", F.struct("id", "copy").alias("node"))
    order = Window.partitionBy("tree").orderBy("node")
    return rows.select("tree", "node", F.lag("node").over(order).alias("up"), F.lead("node").over(order).isNull().alias("leaf"), F.lit(None).cast("double").alias("score"), F.count(F.lit(1)).over(Window.partitionBy("tree")).alias("size"))


def _salted(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """left joined with right, which has a row for each key; rows of large trees (size) meet theirs in SALTS places."""
    large = F.col("size") > TREE_ROWS
    left = left.withColumn("salt", F.when(large, F.pmod(F.xxhash64("node"), F.lit(SALTS))).otherwise(F.lit(0)).cast("int"))
    right = right.withColumn("salt", F.explode(F.when(large, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0))))).drop("size")
    return left.join(right, [*on, "salt"], how).drop("salt")


def reply_trees(messages: DataFrame, tree_col: str, id_col: str, parent_col: str, score_col: str) -> DataFrame:
    """chain's columns for messages that name what they answer.

    A message whose parent is null or unknown begins a branch of its own tree. Of rows with
    one id in one tree the least by parent and score stands for them.
    """
    node = lambda c: F.struct(F.col(c).alias("id"), F.lit(1).cast("long").alias("copy"))
    rows = messages.select(_tree(tree_col).alias("tree"), node(id_col).alias("node"), F.when(F.col(parent_col).isNotNull(), node(parent_col)).alias("up"), F.col(score_col).cast("double").alias("score"))
    rows = rows.groupBy("tree", "node").agg(F.min(F.struct("up", "score")).alias("x")).select("tree", "node", "x.up", "x.score")
    sizes = rows.groupBy("tree").agg(F.count(F.lit(1)).alias("size")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int")).join(sizes, ["tree", "salt"]).drop("salt")
    answered = rows.select("tree", F.col("up").alias("node")).distinct()
    rows = rows.join(answered.withColumn("answered", F.lit(True)), ["tree", "node"], "left").withColumn("leaf", F.col("answered").isNull()).drop("answered")
    known = rows.select("tree", F.col("node").alias("up"), "size", F.lit(True).alias("known"))
    rows = _salted(rows, known, ["tree", "up"], "left")
    return rows.select("tree", "node", F.when(F.col("known"), F.col("up")).alias("up"), "leaf", "score", "size")


def branches(trees: DataFrame, most: int | None = 1) -> DataFrame:
    """(tree, branch, pos, node, score, size): the messages, in order, of the ``most`` best branches of each tree, of all if None.

    A branch's score is the mean, to nine places, of those that its messages have; branches
    without any come last, then longer ones come first, then lesser last messages. Messages that answer each
    other in a ring belong to no branch. No messages, no branches.
    """
    folder = shared_folder(trees.sparkSession)
    level = keep(trees.select("tree", "node", "up", "leaf", "size", F.coalesce("score", F.lit(0.0)).alias("s"), F.col("score").isNotNull().cast("long").alias("c"), F.lit(1).cast("long").alias("d"), F.lit(True).alias("fresh")), folder)
    steps, ends, seen = [], [], -1
    while True:
        ends.append(level.where("leaf and fresh and up is null").select("tree", "node", "size", "s", "c", "d"))
        active = level.where("up is not null")
        left = active.count()
        if left in (0, seen):  # what does not grow less goes round in rings
            break
        steps.append(active.select("tree", "node", F.col("up").alias("to"), "size"))
        seen, reach = left, 1 << len(steps) - 1
        # a tree of no more messages than a step reaches has no further one
        far = level.where(F.col("size") > reach)
        beyond = far.select("tree", F.col("node").alias("up"), "size", F.col("up").alias("up2"), *(F.col(x).alias(f"{x}2") for x in "scd"))
        joined = _salted(active, beyond, ["tree", "up"]).select("tree", "node", F.col("up2").alias("up"), "leaf", "size", *((F.col(x) + F.col(f"{x}2")).alias(x) for x in "scd"), F.lit(True).alias("fresh"))
        still = far.where("up is null").withColumn("fresh", F.lit(False))
        level = keep(joined.unionByName(still), folder)
    found = ends[0]
    for more in ends[1:]:
        found = found.unionByName(more)
    order = Window.partitionBy("tree").orderBy(F.desc_nulls_last("score"), F.desc("d"), "node")
    found = found.withColumn("score", F.when(F.col("c") > 0, F.round(F.col("s") / F.col("c"), 9))).withColumn("branch", F.row_number().over(order))
    if most is not None:
        found = found.where(F.col("branch") <= most)
    members = found.select("tree", "branch", "node", "score", "size", F.col("d").alias("pos"))
    for k in reversed(range(len(steps))):  # a message's distance from the end is a sum of steps, the largest first
        step = _salted(members.where((F.col("size") > 1 << k) & (F.col("pos") > 1 << k)), steps[k], ["tree", "node"])
        step = step.select("tree", "branch", F.col("to").alias("node"), "score", "size", (F.col("pos") - (1 << k)).alias("pos"))
        members = keep(members.unionByName(step), folder)
    return members


def _attached(members: DataFrame, texts: DataFrame, spread: bool) -> DataFrame:
    """members with role and text, the messages of a branch in one partition and in order.

    Trees go whole to a partition, or, if spread, by message first and then by branch; a
    branch's texts pass a task one by one.
    """
    blank = [F.lit(None).cast("string").alias(c) for c in ("role", "text")]
    own = members.select("tree", "node.id", F.col("node.copy").alias("copy"), F.lit(1).alias("kind"), *blank, "branch", "pos", "score")
    told = texts.select("tree", "id", F.lit(None).cast("long").alias("copy"), F.lit(0).alias("kind"), "role", "text", *(F.lit(None).cast(own.schema[c].dataType).alias(c) for c in ("branch", "pos", "score")))
    both = own.unionByName(told).repartition(*(("tree", "id") if spread else ("tree",)))
    number = F.row_number().over(Window.partitionBy("tree", "id", "kind").orderBy("role", "text"))
    both = both.withColumn("copy", F.when(F.col("kind") == 0, number.cast("long")).otherwise(F.col("copy")))
    of = Window.partitionBy("tree", "id", "copy").orderBy("kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    met = both.select("tree", "branch", "pos", "score", "kind", *(F.first(c).over(of).alias(c) for c in ("role", "text"))).where("kind = 1").drop("kind")
    return (met.repartition("tree", "branch") if spread else met).sortWithinPartitions("tree", "branch", "pos")


def formatted(members: DataFrame, messages: DataFrame, tree_col: str, id_col: str, role_col: str = "role", text_col: str = "text", template: Template = CHAT) -> DataFrame:
    """(tree, branch, score, part, last, text, loss): each branch as one conversation.

    loss holds the code points [start, end) of text that training learns from. A branch of
    more than PART_CHARS goes on in further parts, each of whole turns with offsets of its
    own; of parts ``last`` ends the branch. Null roles and texts count as empty.
    """
    texts = messages.select(_tree(tree_col).alias("tree"), F.col(id_col).alias("id"), F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"), F.coalesce(text_col, F.lit("")).alias("text"))
    large = keep(members.where(F.col("size") > TREE_ROWS).select("tree").distinct())
    if large.isEmpty():
        rows = [_attached(members, texts, False)]
    else:
        rows = [_attached(members.join(large, "tree", how), texts.join(large, "tree", how), spread) for how, spread in (("left_anti", False), ("left_semi", True))]
    kind = members.schema["tree"].dataType.fields[0].dataType.simpleString()
    schema = f"tree {kind}, branch int, score double, part int, last boolean, text string, loss array<struct<start:int,end:int>>"
    tail, part_chars = template.tail(), PART_CHARS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list = [[] for _ in range(7)]
        key, part, size, pieces, loss = None, 0, 0, [], []

        def put(last: bool) -> None:
            for column, x in zip(out, (*key, part, last, "".join(pieces), loss), strict=True):
                column.append(x)

        def batch() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], names=names)
            for c in out:
                c.clear()
            return made

        names = ["tree", "branch", "score", "part", "last", "text", "loss"]
        kinds = None
        held = 0
        for rows in batches:
            kinds = kinds or [rows.schema.field(0).type, pa.int32(), pa.float64(), pa.int32(), pa.bool_(), pa.string(), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))]
            for tree, branch, score, head, text, learned in zip(*(c.to_pylist() for c in rows.columns), strict=True):
                if key is None or key[:2] != (tree, branch):
                    if key is not None:
                        put(True)
                        held += size
                    key, part, size, pieces, loss = (tree, branch, score), 0, 0, [], []
                elif size > part_chars:
                    put(False)
                    held += size
                    part, size, pieces, loss = part + 1, 0, [], []
                if held > part_chars:
                    yield batch()
                    held = 0
                if learned:
                    loss.append({"start": size + len(head), "end": size + len(head) + len(text)})
                pieces += (head, text, tail)
                size += len(head) + len(text) + len(tail)
        if key is not None:
            put(True)
            yield batch()

    made = [r.select("tree.of", "branch", "score", template.head(F.col("role")), template.escape(F.col("text")), F.col("role").isin(*template.learned)).mapInArrow(run, schema) for r in rows]
    return made[0] if len(made) == 1 else made[0].unionByName(made[1])


def read_back(conversations: DataFrame, template: Template = CHAT) -> DataFrame:
    """(tree, branch, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars) of formatted's rows, parsed anew.

    A conversation of one part is read where it lies; the parts of others are brought
    together in order and pass one by one.
    """
    kind = conversations.schema["tree"].dataType.simpleString()
    schema = f"tree {kind}, branch int, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turns = n = loss = learned = chars = None
        for rows in batches:
            out = []
            for tree, branch, part, last, text, spans in zip(*(c.to_pylist() for c in rows.columns), strict=True):
                if not part:
                    turns, loss, n, learned, chars = hashlib.sha256(), hashlib.sha256(), 0, 0, 0
                for role, start, end in template.turns(text):
                    turns.update(f"{role}\n{template.unescape(text[start:end])}\n".encode())
                    n += 1
                for span in spans:
                    told = template.unescape(text[span["start"] : span["end"]])
                    loss.update(told.encode())
                    learned += len(told)
                chars += len(text)
                if last:
                    out.append((tree, branch, n, turns.hexdigest(), learned, loss.hexdigest(), chars))
            cols = list(zip(*out, strict=True)) if out else [()] * 7
            kinds = [rows.schema.field(0).type, pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=[x.split(" ")[0] for x in schema.split(", ")])

    columns = ["tree", "branch", "part", "last", "text", "loss"]
    whole = conversations.where("part = 0 and last").select(*columns).mapInArrow(run, schema)
    parts = conversations.where("not (part = 0 and last)").select(*columns)
    if parts.isEmpty():
        return whole
    return whole.unionByName(parts.repartition("tree", "branch").sortWithinPartitions("tree", "branch", "part").mapInArrow(run, schema))


def chat_digests(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", template: Template = CHAT) -> DataFrame:
    """Per conversation: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, read back from its formatted file.

    Turns stand in their order, equal ones by role and text; repeated rows are turns of
    their own, rows without a conversation make one together, null texts and roles are empty.
    Texts of any length count whole; one turn at a time must fit a task. Other columns are
    ignored, and an empty table gives no rows.
    """
    members = branches(chain(conversations, conv_col, turn_col))
    written = keep(formatted(members, conversations, conv_col, turn_col, role_col, text_col, template))
    rows = read_back(written, template)
    return rows.select(F.col("tree").alias("conv_id"), "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")
