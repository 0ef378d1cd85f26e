"""Chat formatting on prefix trees.

Conversations that share their initial turns share the nodes of a tree: a turn's node is named by a digest over all
turns up to it. The nodes of a tree are laid out depth-first in one sequence, each once, as tokens with position ids
that go on from the parent's and with the intervals of the sequence that hold its ancestors, which is what a token
may attend to besides its own node. The loss mask is an interval of each assistant's node: its text alone.

A turn is written ``### role: text </turn>`` and a line feed. Inside roles and texts a backslash is doubled, three
number signs in a row are written with a backslash each, and ``</turn>`` gets one behind its first character, so
that no text can open or end a turn and reading takes every backslash away.

Trees may be as large as a third of all conversations. A node under which more than ``most`` characters lie deals
its children by their digests to ranges of about that size, each laid out as a sequence of its own which begins with
the turns up to that node; so a turn stands once in each sequence, and what one task holds is bounded.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zephyrlake.llm.pretokens import vocabulary_path
from zephyrlake.llm.storage import cut

OPEN, MIDDLE, CLOSE = "### ", ": ", " </turn>\n"
HEADER = re.compile(r"### ((?:\\.|[^\\:])*): ", re.DOTALL)
ESCAPE = re.compile(r"\\(.)", re.DOTALL)
TURNS = "array<struct<role:string,text:string>>"
NODES = "sequence string, node int, parent int, depth int, role string, tokens array<int>, loss_from int, loss_to int, start bigint, position bigint, ancestors array<struct<from:bigint,to:bigint>>, leaf binary"
#: Characters of turns that one sequence holds, about, unless one conversation has more.
MOST = 1 << 17


def escaped(text: str) -> str:
    """A text without anything that could be read as a mark."""
    return text.replace("\\", "\\\\").replace("###", "\\#\\#\\#").replace("</turn>", "<\\/turn>")


def unescaped(text: str) -> str:
    """What was escaped."""
    return ESCAPE.sub(r"\1", text)


def marked(role: str, text: str) -> tuple[str, str, str]:
    """A turn's opening with its role, its text, and its end, as they are written."""
    return OPEN + escaped(role).replace(":", "\\:") + MIDDLE, escaped(text), CLOSE


def parsed(written: str) -> list[tuple[str, str]]:
    """(role, text) of every turn of a written conversation."""
    out, at = [], 0
    while at < len(written):
        head = HEADER.match(written, at)
        end = written.index(CLOSE, head.end())
        out.append((unescaped(head[1]), unescaped(written[head.end() : end])))
        at = end + len(CLOSE)
    return out


@lru_cache(maxsize=2)
def library(path: str | None):
    """The worker's tokenizer; special strings inside texts are ordinary text."""
    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are the parallelism
    out = Tokenizer.from_file(vocabulary_path(path))
    out.encode_special_tokens = True
    return out


def with_paths(rows: DataFrame) -> DataFrame:
    """conv_id, turns in order, path (the digest of every prefix), chars: one row per conversation."""
    order = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    turns = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(order)).alias("t"))
    turns = turns.select("conv_id", F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))).alias("turns"))
    kind = turns.schema["conv_id"].dataType.simpleString()

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths, chars = [], []
            for conversation in batch.column("turns").to_pylist():
                digest, path = b"", []
                for t in conversation:
                    role = t["role"].encode()
                    digest = hashlib.blake2b(b"%b%d:%b%b" % (digest, len(role), role, t["text"].encode()), digest_size=16).digest()
                    path.append(digest)
                paths.append(path)
                chars.append(sum(len(t["role"]) + len(t["text"]) + 16 for t in conversation))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(paths, pa.list_(pa.binary())), pa.array(chars, pa.int64())], [*batch.schema.names, "path", "chars"])

    return turns.mapInArrow(named, f"conv_id {kind}, turns {TURNS}, path array<binary>, chars bigint")


def with_sequences(trees: DataFrame, most: int) -> DataFrame:
    """Adds sequence to distinct conversations: the tree's name, or that of a range of the children of the deepest node that holds too much."""
    # Cut off, so that the join deals both sides anew and a node that many conversations pass can be split between tasks.
    heavy = cut(trees.select(F.explode("path").alias("at"), "chars").groupBy("at").agg(F.sum("chars").alias("held")).where(F.col("held") > most))
    at = trees.select("leaf", F.posexplode("path").alias("depth", "at")).join(heavy, "at")
    deepest = at.groupBy("leaf").agg(F.max(F.struct("depth", "held", "at")).alias("heavy"))
    rows = trees.join(deepest, "leaf", "left")
    child = F.try_element_at("path", F.col("heavy.depth") + 2)
    place = F.conv(F.hex(F.substring(child, 1, 4)), 16, 10).cast("double") / 2.0**32
    part = F.floor(place * F.ceil(F.col("heavy.held") / most)).cast("string")
    own = F.when(child.isNull(), "end").otherwise(part)
    name = F.when(F.col("heavy").isNull(), F.lower(F.hex(F.col("path")[0]))).otherwise(F.concat_ws("-", F.lower(F.hex("heavy.at")), own))
    return rows.select("leaf", "path", "turns", name.alias("sequence"))


def laid_out(rows: DataFrame, path: str | None) -> DataFrame:
    """Nodes of the sequences, depth-first, from conversations sorted by sequence and path."""

    def lay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = lambda texts: [e.ids for e in library(path).encode_batch(texts, add_special_tokens=False)]
        sequence, offset, count = None, 0, 0
        stack: list[tuple] = []  # digest, node, end of its position ids, intervals of itself and its ancestors
        for batch in batches:
            for i in range(0, len(batch), 64):
                out = []
                for x in batch.slice(i, 64).to_pylist():
                    if x["sequence"] != sequence:
                        sequence, offset, count, stack = x["sequence"], 0, 0, []
                    shared = next((k for k, (a, b) in enumerate(zip(stack, x["path"], strict=False)) if a[0] != b), min(len(stack), len(x["path"])))
                    del stack[shared:]
                    ids = encode([s for t in x["turns"][shared:] for s in marked(t["role"], t["text"])])
                    for k in range(shared, len(x["path"])):
                        head, text, end = ids[3 * (k - shared) : 3 * (k - shared) + 3]
                        tokens, role = head + text + end, x["turns"][k]["role"]
                        parent, position, above = stack[-1][1:] if stack else (None, 0, [])
                        loss = (len(head), len(head) + len(text)) if role == "assistant" else (0, 0)
                        # Where the parent ends at this node, one interval holds both.
                        own = (*above[:-1], (above[-1][0], offset + len(tokens))) if above and above[-1][1] == offset else (*above, (offset, offset + len(tokens)))
                        stack.append((x["path"][k], count, position + len(tokens), own))
                        leaf = x["path"][k] if k == len(x["path"]) - 1 else None
                        out.append((sequence, count, parent, k, role, tokens, *loss, offset, position, [{"from": a, "to": z} for a, z in above], leaf))
                        offset, count = offset + len(tokens), count + 1
                    if shared == len(x["path"]):  # a conversation that sorts behind the one it begins has nodes already; sorting rules it out
                        raise ValueError("conversations are not in the order of their paths")
                interval = pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())]))
                kinds = [pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.list_(pa.int32()), pa.int32(), pa.int32(), pa.int64(), pa.int64(), interval, pa.binary()]
                names = [c.split()[0] for c in re.sub(r"<.*?>+", "", NODES).split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*out, strict=True), kinds, strict=True)], names)

    return rows.repartition("sequence").sortWithinPartitions("sequence", "path").mapInArrow(lay, NODES)


def formatted(conversations: DataFrame, path: str | None = None, most: int = MOST) -> tuple[DataFrame, DataFrame]:
    """(nodes, members) of conversations (conv_id, turn, role, text).

    nodes: sequence, node (its number in the sequence, depth-first), parent, depth, role, tokens, loss_from and loss_to
    (places within its tokens), start (its first token's place in the sequence), position (that token's position id),
    ancestors (intervals of the sequence), and leaf, the digest of the conversation that ends there. members: conv_id,
    leaf; equal conversations share a leaf.

    Turns are ordered by turn (null first), role and text, repeated rows staying; null roles and texts are empty; rows
    whose conv_id is null make one conversation; other columns are left out; an empty table gives empty ones. A
    conversation is never cut, so it may exceed ``most`` by itself. path: a byte-level vocabulary, None for the default.
    """
    rows = cut(with_paths(conversations.select("conv_id", "turn", "role", "text")).withColumn("leaf", F.element_at("path", -1)))
    trees = rows.groupBy("leaf").agg(F.first("path").alias("path"), F.first("turns").alias("turns"), F.first("chars").alias("chars"))
    return laid_out(with_sequences(cut(trees), most), path), rows.select("conv_id", "leaf")


def read_back(nodes: DataFrame, path: str | None = None) -> DataFrame:
    """leaf, turns, loss (all text under the mask, unescaped), written: what the tokens of each conversation say, gathered by the attention intervals alone."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = lambda ids: library(path).decode(ids, skip_special_tokens=False)
        sequence, tokens, mask = None, [], bytearray()
        for batch in batches:
            out = []
            for x in batch.to_pylist():
                if x["sequence"] != sequence:
                    sequence, tokens, mask = x["sequence"], [], bytearray()
                if x["start"] != len(tokens):
                    raise ValueError(f"sequence {sequence} has a gap at {len(tokens)}")
                a, z = x["loss_from"], x["loss_to"]
                tokens += x["tokens"]
                mask += bytes(a) + b"\x01" * (z - a) + bytes(len(x["tokens"]) - z)
                if x["leaf"] is not None:
                    seen = [(s["from"], s["to"]) for s in x["ancestors"]] + [(x["start"], len(tokens))]
                    ids = [t for f, to in seen for t in tokens[f:to]]
                    taught = [t for f, to in seen for t, m in zip(tokens[f:to], mask[f:to], strict=True) if m]
                    written = decode(ids)
                    out.append((x["leaf"], [{"role": r, "text": t} for r, t in parsed(written)], unescaped(decode(taught)), written))
            kinds = [pa.binary(), pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())])), pa.string(), pa.string()]
            columns = zip(*out, strict=True) if out else ([], [], [], [])
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True)], ["leaf", "turns", "loss", "written"])

    rows = nodes.repartition("sequence").sortWithinPartitions("sequence", "start")
    return rows.mapInArrow(read, f"leaf binary, turns {TURNS}, loss string, written string")
