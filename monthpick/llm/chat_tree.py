"""Chat formatting as a prefix tree of conversations (operator 10).

Every turn becomes a formatted piece: control strings mark its role and end, and
control strings inside a text are escaped by a backslash, reversibly.  Conversations
that share their first turns share nodes: a node is a turn after a given path.  Each
node's tokens are emitted once, in depth-first order of its tree.  With a node go its
place in the tree's sequence, the position ids (those of the plain conversation), the
token range under the loss (assistant texts) and the intervals of the sequence that
its tokens attend to: its ancestors, merged where they touch.

Depth-first order is the lexical order of the paths: paths are ranked by a distributed
sort, a node belongs to the first path that has it, and nodes follow each other by
(rank of that path, depth).  Offsets are running sums within blocks of ranks plus the
sums of the blocks before, so a first turn that a third of all conversations share is
spread over all tasks.

Edge cases: a null text or role is an empty one; rows of one conversation with the same
turn are all kept, ordered by role and text; a null conv_id is a conversation like any
other; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from monthpick.llm.common import Scratch

#: What stands before and after a turn's text, by role; other roles are named.
TEMPLATE = {"system": ("<<SYS>>\n", "\n<</SYS>>\n\n"), "user": ("[INST] ", " [/INST]"), "assistant": (" ", " </s>")}
NAMED = ("[ROLE] ", " [/ROLE] ", " [/TURN]")
CONTROL = ("<<SYS>>", "<</SYS>>", "[INST]", "[/INST]", "<s>", "</s>", "[ROLE]", "[/ROLE]", "[/TURN]")
_ESCAPE = re.compile("|".join(map(re.escape, ("\\", *CONTROL))))
_UNESCAPE = re.compile(r"\\(.)", re.S)
DEFAULT_TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the split pattern that belongs to the byte-level vocabulary.
SPLIT = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_ROW = "conv_id bigint, idx int, node string, parent string, root string, position bigint, tokens array<int>, loss_from int, loss_to int, path string"


def escape(text: str) -> str:
    return _ESCAPE.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1", text)


def pieces(role: str, text: str) -> tuple[str, str, str]:
    """What stands before the text, the escaped text, and what stands after it."""
    before, after = TEMPLATE.get(role) or (NAMED[0] + escape(role) + NAMED[1], NAMED[2])
    return before, escape(text), after


def read_piece(piece: str) -> tuple[str, str]:
    """Role and text of a formatted turn."""
    for role, (before, after) in TEMPLATE.items():
        if piece.startswith(before) and piece.endswith(after) and len(piece) >= len(before) + len(after):
            return role, unescape(piece[len(before) : len(piece) - len(after)])
    role, _, text = piece.removeprefix(NAMED[0]).removesuffix(NAMED[2]).partition(NAMED[1])
    return unescape(role), unescape(text)


def vocabulary(path: str) -> bytes:
    """A vocabulary file's bytes (fixed size), which travel to the tasks: executors need not have the file."""
    with open(path, "rb") as f:
        return f.read()


def load_tokenizer(data: bytes):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines())}
    return tiktoken.Encoding("chat", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})


def _chains(conversations: DataFrame, tokenizer: str) -> DataFrame:
    """A row for each turn, and after a conversation's last turn one with idx -1 and the path.

    Conversations pass in order, a row at a time: memory holds the node ids of one.
    """
    data = vocabulary(tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = load_tokenizer(data).encode_ordinary
        current, path, root, position = None, [], "", 0
        kinds = [pa.int64(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.list_(pa.int32()), pa.int32(), pa.int32(), pa.string()]
        names = [x.split()[0] for x in _ROW.split(", ")]
        make = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)
        for batch in batches:
            rows = []
            for conv, role, text in zip(*(batch.column(k).to_pylist() for k in (0, 2, 3))):
                if not path or conv != current:
                    if path:
                        rows.append((current, -1, path[-1], None, root, position, None, None, None, "".join(path)))
                    current, path, position = conv, [], 0
                before, body, after = pieces(role, text)
                parent = path[-1] if path else ""
                node = hashlib.sha256(f"{parent}:{len(role)}:{role}{text}".encode()).hexdigest()[:32]
                path.append(node)
                root = path[0]
                a, b, c = encode(before), encode(body), encode(after)
                rows.append((conv, len(path) - 1, node, parent or None, root, position, a + b + c, len(a) if role == "assistant" else 0, len(a) + len(b) if role == "assistant" else 0, None))
                position += len(a) + len(b) + len(c)
                if len(rows) >= 1000:
                    yield make(rows)
                    rows = []
            if rows:
                yield make(rows)
        if path:
            yield make([(current, -1, path[-1], None, root, position, None, None, None, "".join(path))])

    tidy = conversations.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return tidy.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(run, _ROW)


def format_tree(conversations: DataFrame, tokenizer: str = DEFAULT_TOKENIZER) -> tuple[DataFrame, DataFrame]:
    """Nodes and paths.

    nodes: tree (its first node), node, parent, depth, start, end (places in the tree's sequence),
    position (of the first token), tokens, loss_from, loss_to, attends (array of start, end).
    paths: conv_id, idx, node.
    """
    scratch = Scratch(conversations.sparkSession, "chat-tree")
    rows = scratch.stage(_chains(conversations, tokenizer))
    turns = rows.where("idx >= 0")
    # one conversation stands for each path; its rank is the path's place in lexical order
    leaves = rows.where("idx < 0").groupBy("node").agg(F.min(F.struct("conv_id", "path")).alias("x")).select("x.conv_id", "x.path")
    ranked = scratch.stage(leaves.orderBy("path").select("conv_id", F.monotonically_increasing_id().alias("rank")))
    steps = turns.join(ranked, turns["conv_id"].eqNullSafe(ranked["conv_id"])).select("rank", "idx", "node")
    owner = steps.groupBy("node").agg(F.min("rank").alias("rank"))
    # the representatives' own rows have every node's tokens
    own = turns.join(ranked.withColumnRenamed("conv_id", "_conv"), turns["conv_id"].eqNullSafe(F.col("_conv"))).join(owner, ["node", "rank"])
    own = own.select("rank", "root", "node", "parent", F.col("idx").alias("depth"), "position", "tokens", "loss_from", "loss_to", F.size("tokens").cast("bigint").alias("n"))
    own = scratch.stage(own)
    block = F.shiftright("rank", 33)  # the sort's partition
    by_rank = own.groupBy("root", "rank").agg(F.sum("n").alias("n")).withColumn("block", block)
    by_block = by_rank.groupBy("root", "block").agg(F.sum("n").alias("n"))
    before_block = by_block.select("root", "block", (F.sum("n").over(Window.partitionBy("root").orderBy("block")) - F.col("n")).alias("b"))
    in_block = by_rank.select("root", "rank", "block", (F.sum("n").over(Window.partitionBy("root", "block").orderBy("rank")) - F.col("n")).alias("r"))
    base = in_block.join(before_block, ["root", "block"]).select("rank", (F.col("b") + F.col("r")).alias("base"))
    along = Window.partitionBy("rank").orderBy("depth")
    placed = own.join(base, "rank").withColumn("start", F.col("base") + F.sum("n").over(along) - F.col("n")).withColumn("end", F.col("start") + F.col("n"))
    placed = scratch.stage(placed)
    # what a path has of each other path's nodes is one interval; touching ones merge
    foreign = steps.join(placed.select("node", F.col("rank").alias("of"), "start", "end"), "node").where("of <> rank")
    spans = foreign.groupBy("rank", "of").agg(F.min("start").alias("start"), F.max("end").alias("end")).groupBy("rank").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("spans"))
    empty = F.array().cast("array<struct<start:bigint,end:bigint>>")

    def merge(acc, s):
        last = F.element_at(acc, -1)
        joined = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(last["start"].alias("start"), s["end"].alias("end"))))
        return F.when((F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1))["end"] == s["start"]), joined).otherwise(F.concat(acc, F.array(s)))

    own_part = F.when(F.col("start") > F.col("base"), F.array(F.struct(F.col("base").alias("start"), F.col("start").alias("end")))).otherwise(empty)
    attends = F.aggregate(F.concat(F.coalesce("spans", empty), own_part), empty, merge)
    nodes = placed.join(spans, "rank", "left").select(F.col("root").alias("tree"), "node", "parent", "depth", "start", "end", "position", "tokens", "loss_from", "loss_to", attends.alias("attends"))
    return nodes, turns.select("conv_id", "idx", "node")


def read_back(nodes: DataFrame, paths: DataFrame, tokenizer: str = DEFAULT_TOKENIZER) -> DataFrame:
    """Per conversation, from the formatted output alone: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""
    schema = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"
    data = vocabulary(tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = load_tokenizer(data).decode_bytes
        names = [x.split()[0] for x in schema.split(", ")]
        state, done = None, []

        def finish():
            conv, n, turns, chars, loss, formatted = state
            done.append((conv, n, turns.hexdigest(), chars, loss.hexdigest(), formatted))

        def flush():
            out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()))], names=names)
            done.clear()
            return out

        for batch in batches:
            for conv, tokens, a, b in zip(*(batch.column(k).to_pylist() for k in (0, 2, 3, 4))):
                if state is None or state[0] != conv:
                    if state:
                        finish()
                    state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                piece = decode(tokens).decode()
                role, text = read_piece(piece)
                loss = unescape(decode(tokens[a:b]).decode())
                state[1] += 1
                state[2].update(f"{role}\n{text}\n".encode())
                state[3] += len(loss)
                state[4].update(loss.encode())
                state[5] += len(piece)
            if done:
                yield flush()
        if state:
            finish()
        if done:
            yield flush()

    joined = paths.join(nodes.select("node", "tokens", "loss_from", "loss_to"), "node").select("conv_id", "idx", "tokens", "loss_from", "loss_to")
    return joined.repartition("conv_id").sortWithinPartitions("conv_id", "idx").mapInArrow(run, schema)
