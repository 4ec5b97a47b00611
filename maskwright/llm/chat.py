"""Chat formatting over a prefix tree of conversations.

Conversations that share initial turns are merged: after whole conversations are made distinct, they are sorted by their
turns over a range partitioning, so that each task meets them depth-first and shared turns adjoin. A task writes packs of
bounded size; inside a pack each shared turn stands once, with the position id of its first character (the length of its
ancestors) and the intervals of the packed text that it may attend to (its ancestors). A path cut by a pack's end is
written again in the next pack, which bounds a pack without any cap on the conversations below a turn.

Template: "### " role ":\n" text "</turn>\n". Inside roles and texts, "\\", "#" and "</turn>" get a "\\" before them, inside
roles ":" too; that is reversible and leaves no bare control string. The loss mask of a turn is the interval of its escaped
text alone: neither role nor control strings are under it. Positions and intervals count characters; tokenised() gives the
same packs in token ids, with all of them counted in tokens.

Defined results: null role or text counts as empty; turns go by turn, role, text with null turns first; repeated rows
are turns of their own; rows with a null conv_id form one conversation. Only assistant turns are under the loss mask.
Extra columns are not looked at.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe
from .common import map_rows, table

#: Characters after which a pack is closed.
PACK_CHARS = 65_536

TEXT_CONTROL, ROLE_CONTROL = re.compile(r"[\\#]|</turn>"), re.compile(r"[\\#:]|</turn>")
TURN = re.compile(r"### ((?:\\.|[^\\:])*):\n((?:\\.|[^\\<]|<(?!/turn>))*)</turn>\n", re.DOTALL)
ESCAPED = re.compile(r"\\([\\#:]|</turn>)")


def escape(text: str, control: re.Pattern = TEXT_CONTROL) -> str:
    return control.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return ESCAPED.sub(r"\1", text)


def parts_of_turn(role: str, text: str) -> tuple[str, str, str]:
    """What stands before a turn's escaped text, that text, and what stands after it."""
    return f"### {escape(role, ROLE_CONTROL)}:\n", escape(text), "</turn>\n"


def format_turn(role: str, text: str) -> str:
    return "".join(parts_of_turn(role, text))


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """Roles and texts of a formatted conversation; ValueError if it isn't one."""
    out, at = [], 0
    while at < len(formatted):
        if not (m := TURN.match(formatted, at)):
            raise ValueError(f"no turn at {at}")
        out.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    return out


SPAN = pa.struct([("start", pa.int32()), ("end", pa.int32())])
NODE = pa.struct([("parent", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("position", pa.int32()), ("attends", pa.list_(SPAN)), ("loss", SPAN)])
LEAF = pa.struct([("conv_key", pa.string()), ("node", pa.int32())])
PACKS = pa.schema([("text", pa.string()), ("nodes", pa.list_(NODE)), ("leaves", pa.list_(LEAF))])
PACKS_DDL = "text string, nodes array<struct<parent: int, start: int, end: int, position: int, attends: array<struct<start: int, end: int>>, loss: struct<start: int, end: int>>>, leaves array<struct<conv_key: string, node: int>>"


def ancestors(above: dict | None) -> list[dict]:
    """Intervals of a node's ancestors: its parent's, and the parent itself; adjoining ones are one."""
    if above is None:
        return []
    before, last = above["attends"], {"start": above["start"], "end": above["end"]}
    if before and before[-1]["end"] == last["start"]:
        return [*before[:-1], {"start": before[-1]["start"], "end": last["end"]}]
    return [*before, last]


def pack(pack_chars: int):
    """Arrow function over sorted (conv_key, turns): packs with the tree of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, nodes, leaves, path, size = [], [], [], [], 0

        def close() -> pa.RecordBatch:
            row = {"text": "".join(parts), "nodes": nodes.copy(), "leaves": leaves.copy()}
            for x in (parts, nodes, leaves, path):
                x.clear()
            return pa.RecordBatch.from_pylist([row], schema=PACKS)

        for b in batches:
            for k in range(b.num_rows):
                key, turns = b.column(0)[k].as_py(), [(t["role"], t["text"]) for t in b.column(1)[k].as_py()]
                if size > pack_chars:
                    yield close()
                    size = 0
                shared = 0
                while shared < min(len(path), len(turns)) and path[shared][0] == turns[shared]:
                    shared += 1
                del path[shared:]
                for turn in turns[shared:]:
                    parent = path[-1][1] if path else -1
                    head, body, tail = parts_of_turn(*turn)
                    written = head + body + tail
                    above = nodes[parent] if path else None
                    nodes.append({"parent": parent, "start": size, "end": size + len(written), "position": above["position"] + above["end"] - above["start"] if above else 0, "attends": ancestors(above), "loss": {"start": size + len(head), "end": size + len(head) + len(body)} if turn[0] == "assistant" else None})
                    path.append((turn, len(nodes) - 1))
                    parts.append(written)
                    size += len(written)
                leaves.append({"conv_key": key, "node": path[-1][1]})
        if leaves:
            yield close()

    return run


def conversations(rows: DataFrame) -> DataFrame:
    """(conv_id, turns array<struct<role, text>>, conv_key) of rows (conv_id, turn, role, text)."""
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    turns = F.transform(F.sort_array(F.collect_list(turn)), lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    return rows.groupBy("conv_id").agg(turns.alias("turns")).withColumn("conv_key", F.sha2(F.to_json("turns"), 256))


def prefix_packs(convs: DataFrame, pack_chars: int = PACK_CHARS) -> DataFrame:
    """Packs of the distinct conversations of convs(turns, conv_key)."""
    distinct = convs.groupBy("conv_key").agg(F.first("turns").alias("turns"))
    return distinct.repartitionByRange("turns", "conv_key").sortWithinPartitions("turns", "conv_key").select("conv_key", "turns").mapInArrow(pack(pack_chars), PACKS_DDL)


TOKENS = pa.schema([("ids", pa.list_(pa.int32())), ("nodes", pa.list_(NODE)), ("leaves", pa.list_(LEAF))])
TOKENS_DDL = PACKS_DDL.replace("text string", "ids array<int>")


def in_tokens(encode: Callable[[str], list[int]], text: str, nodes: list[dict], leaves: list[dict]) -> tuple:
    """A pack with token ids for its text: each node's tokens once, all places and intervals counted in tokens.

    What stands before, in and after a masked text is encoded by itself, so the mask falls between tokens.
    """
    ids: list[int] = []
    out: list[dict] = []
    for n in nodes:
        start, mask = len(ids), n["loss"]
        cuts = [n["start"], mask["start"], mask["end"], n["end"]] if mask else [n["start"], n["end"]]
        ends = []
        for a, b in zip(cuts, cuts[1:]):
            ids += encode(text[a:b])
            ends.append(len(ids))
        above = out[n["parent"]] if n["parent"] >= 0 else None
        out.append({"parent": n["parent"], "start": start, "end": len(ids), "position": above["position"] + above["end"] - above["start"] if above else 0, "attends": ancestors(above), "loss": {"start": ends[0], "end": ends[1]} if mask else None})
    return ids, out, leaves


def tokenised(packs: DataFrame, vocabulary: str) -> DataFrame:
    """(ids, nodes, leaves) of packs by the BPE vocabulary at a path; shared turns are encoded once, as they stand once."""

    def setup():
        encode = bpe.load(vocabulary).encode
        return lambda text, nodes, leaves: [in_tokens(encode, text, nodes, leaves)]

    return map_rows(packs, ["text", "nodes", "leaves"], TOKENS, TOKENS_DDL, setup, 16)


def unpack(packs: DataFrame, of, schema: pa.Schema, ddl: str) -> DataFrame:
    """Each conversation of packs, its formatted text gathered along its path: of(conv_key, formatted, intervals of it under the loss mask) -> row."""

    def setup():
        def rows(text, nodes, leaves):
            for leaf in leaves:
                path, at = [], leaf["node"]
                while at >= 0:
                    path.append(nodes[at])
                    at = nodes[at]["parent"]
                path.reverse()
                yield of(leaf["conv_key"], "".join(text[n["start"] : n["end"]] for n in path), [(n["position"] + n["loss"]["start"] - n["start"], n["position"] + n["loss"]["end"] - n["start"]) for n in path if n["loss"]])

        return rows

    return map_rows(packs, ["text", "nodes", "leaves"], schema, ddl, setup)


def digest_row(key: str, formatted: str, loss: list[tuple[int, int]]) -> tuple:
    turns = read_turns(formatted)
    masked = "".join(unescape(formatted[a:b]) for a, b in loss)
    whole = "".join(f"{role}\n{text}\n" for role, text in turns)
    return key, len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(masked), hashlib.sha256(masked.encode()).hexdigest(), len(formatted)


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = "\\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", text), (-7, 1, "assistant", text)], "conv_id long, turn long, role string, text string")
    convs = conversations(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra))
    schema = pa.schema([("conv_key", pa.string()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])
    back = unpack(prefix_packs(convs), digest_row, schema, "conv_key string, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")
    return convs.select("conv_id", "conv_key").join(back, "conv_key").drop("conv_key")


OP4_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (
  SELECT *, replace(replace(replace(text, '\', '\\'), '#', '\#'), '</turn>', '\</turn>') AS et,
         replace(replace(replace(replace(role, '\', '\\'), '#', '\#'), ':', '\:'), '</turn>', '\</turn>') AS er FROM c)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(length(er) + length(et) + 4 + 2 + 8)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""
