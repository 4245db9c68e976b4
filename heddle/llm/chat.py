"""Chat formatting: reply trees to training conversations.

Messages form trees by (tree_id, node_id, parent_id). `root_paths` lists every root-to-leaf path by
self-joins that double the reach of the ancestor table and of the paths each time, so that a tree of
depth d takes log2(d) joins. `ranked_branches` orders a tree's paths by score, and `formatted` writes
each chosen path as one conversation.

The template is `[SYS] text [/SYS]`, `[INST] text [/INST]`, `<s>text</s>` for system, user and
assistant, `[ROLE:name] text [/ROLE]` for any other role. Inside texts a backslash is doubled, and the
first character of a control string is written as backslash and a letter; `parse` undoes both.

Defined results: null text and null role are empty; a parent that is missing makes its message a root;
messages on a cycle have no root and no path, and are left out; equal scores go by the smallest leaf. Rows
without a tree_id (conv_id) are one tree, as SQL groups them.
"""

from __future__ import annotations

import hashlib
import re
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from heddle.llm.support import forget, load, map_rows, stored

# The control strings of the template.
CONTROLS = ["<s>", "</s>", "[INST]", "[/INST]", "[SYS]", "[/SYS]", "[ROLE:", "[/ROLE]"]
MARKS = {"system": ("[SYS] ", " [/SYS]"), "user": ("[INST] ", " [/INST]"), "assistant": ("<s>", "</s>")}
#: What a control string's first character becomes.
LETTERS = {"<": "\\l", "[": "\\b"}

_ESCAPE = re.compile(r"\\|" + "|".join(re.escape(c) for c in CONTROLS))
_UNESCAPE = re.compile(r"\\(.)", re.S)
_BACK = {"\\": "\\", "l": "<", "b": "[", "r": "]"}
_TURN = re.compile(r"\[SYS\] (?P<system>.*?) \[/SYS\]|\[INST\] (?P<user>.*?) \[/INST\]|<s>(?P<assistant>.*?)</s>|\[ROLE:(?P<role>.*?)\] (?P<other>.*?) \[/ROLE\]", re.S)


def escape(text: str | None) -> str:
    return _ESCAPE.sub(lambda m: "\\\\" if m[0] == "\\" else LETTERS[m[0][0]] + m[0][1:], text or "")


def unescape(text: str) -> str:
    return _UNESCAPE.sub(lambda m: _BACK[m[1]], text)


def render(turns: list[tuple[str | None, str | None]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation and the spans (code points) that the loss covers: the assistant's texts."""
    out, spans, at = [], [], 0
    for role, text in turns:
        role, body = role or "", escape(text)
        before, after = MARKS.get(role) or (f"[ROLE:{escape(role).replace(']', chr(92) + 'r')}] ", " [/ROLE]")
        if role == "assistant":
            spans.append((at + len(before), at + len(before) + len(body)))
        out += [before, body, after]
        at += len(before) + len(body) + len(after)
    return "".join(out), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns that `render` was given."""
    turns, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if not m:
            raise ValueError(f"no turn at code point {at}")
        if m["role"] is not None:
            turns.append((unescape(m["role"]), unescape(m["other"])))
        else:
            kind = m.lastgroup
            turns.append((kind, unescape(m[kind])))
        at = m.end()
    return turns


def _tied(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Joins on the keys; a null tree_id is a tree like any other."""
    right = right.withColumnsRenamed({k: f"{k}_tied" for k in keys})
    same = [F.col(k).eqNullSafe(F.col(f"{k}_tied")) if k == "tree_id" else F.col(k) == F.col(f"{k}_tied") for k in keys]
    return left.join(right, reduce(Column.__and__, same), how).drop(*(f"{k}_tied" for k in keys))


def root_paths(messages: DataFrame) -> DataFrame:
    """(tree_id, leaf_id, node_id, depth) for each message on each root-to-leaf path; depth 0 is the root.

    messages: tree_id (rows without one are one tree), node_id, parent_id (null, or of no message, at a root).
    Only ids are joined, never texts. A message without a node_id is on no path but its own. Messages that lead into a cycle reach no root and are on no path.
    """
    m = messages.select("tree_id", "node_id", "parent_id").distinct()
    known = m.select("tree_id", F.col("node_id").alias("parent_id"), F.lit(True).alias("known"))
    m = _tied(m, known, ["tree_id", "parent_id"], "left").select("tree_id", "node_id", F.when(F.col("known"), F.col("parent_id")).alias("up"))
    parents = m.where("up is not null").select("tree_id", F.col("up").alias("node_id")).distinct()
    # paths holds (leaf, node, steps above the leaf); up reaches 2**k messages at once
    up = stored(m.where("up is not null"), "up")
    left = up.count()
    paths = stored(_tied(m, parents, ["tree_id", "node_id"], "left_anti").select("tree_id", F.col("node_id").alias("leaf_id"), "node_id", F.lit(0).alias("back")), "paths")
    reach = 1
    while left:
        old = paths, up
        higher = _tied(paths, up, ["tree_id", "node_id"]).select("tree_id", "leaf_id", F.col("up").alias("node_id"), (F.col("back") + reach).alias("back"))
        paths = stored(paths.unionByName(higher), "paths")
        twice = up.select("tree_id", F.col("node_id").alias("up"), F.col("up").alias("up2"))
        up = stored(_tied(up, twice, ["tree_id", "up"]).select("tree_id", "node_id", F.col("up2").alias("up")), "up")
        reach *= 2
        # a tree with messages deeper than this has some at each depth before it, which have dropped out by now
        before, left = left, up.count()
        forget(*old)
        if left == before:
            lost = up.select("tree_id", F.col("node_id").alias("leaf_id"))
            paths = stored(_tied(paths, lost, ["tree_id", "leaf_id"], "left_anti"), "paths")
            break
    depth = F.max("back").over(W.partitionBy("tree_id", "leaf_id"))
    return paths.select("tree_id", "leaf_id", "node_id", (depth - F.col("back")).alias("depth"))


def ranked_branches(paths: DataFrame, scores: DataFrame, keep: int | None = None) -> DataFrame:
    """paths with branch_score (mean of the messages' scores) and branch_rank in the tree; only the first `keep` ranks, if given.

    scores: tree_id, node_id, score (null counts as 0).
    """
    each = _tied(paths, scores.select("tree_id", "node_id", "score"), ["tree_id", "node_id"]).groupBy("tree_id", "leaf_id")
    branches = each.agg(F.avg(F.coalesce("score", F.lit(0.0))).alias("branch_score"))
    order = W.partitionBy("tree_id").orderBy(F.desc("branch_score"), "leaf_id")
    branches = branches.withColumn("branch_rank", F.row_number().over(order))
    if keep is not None:
        branches = branches.where(F.col("branch_rank") <= keep)
    return _tied(paths, branches, ["tree_id", "leaf_id"])


_OUT = pa.schema([("tree_id", pa.int64()), ("leaf_id", pa.int64()), ("formatted", pa.string()), ("loss", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])


def formatted(branches: DataFrame, texts: DataFrame) -> DataFrame:
    """One row for each branch: tree_id, leaf_id, formatted, loss (spans). texts: tree_id, node_id, role, text."""
    turns = _tied(branches, texts.select("tree_id", "node_id", "role", "text"), ["tree_id", "node_id"])
    turns = turns.groupBy("tree_id", "leaf_id").agg(F.sort_array(F.collect_list(F.struct("depth", "role", "text"))).alias("turns"))

    def one(tree, leaf, turns):
        text, spans = render([(t["role"], t["text"]) for t in turns])
        return tree, leaf, text, [{"start": a, "end": b} for a, b in spans]

    return map_rows(turns, one, _OUT, "tree_id bigint, leaf_id bigint, formatted string, loss array<struct<start bigint, end bigint>>")


def as_replies(rows: DataFrame) -> DataFrame:
    """Linear conversations (conv_id, turn, role, text) as reply trees: each row answers the one before it; equal turns go by role, then text."""
    w = W.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = rows.select(F.col("conv_id").cast("long").alias("tree_id"), F.row_number().over(w).cast("long").alias("node_id"), "role", "text")
    return rows.withColumn("parent_id", F.when(F.col("node_id") > 1, F.col("node_id") - 1)).withColumn("score", F.length(F.coalesce("text", F.lit(""))).cast("double"))


_READ = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])


def _read_back(tree, _leaf, text, loss):
    turns = parse(text)
    whole = "".join(f"{r}\n{t}\n" for r, t in turns)
    learnt = "".join(unescape(text[s["start"] : s["end"]]) for s in loss)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return tree, len(turns), sha(whole), len(learnt), sha(learnt), len(text)


def op4_reply_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and conversation -7, formatted and read back."""
    rows = load(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    extra = spark.createDataFrame([(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")], "conv_id bigint, turn bigint, role string, text string")
    messages = stored(as_replies(rows.unionByName(extra)), "messages")
    branches = ranked_branches(root_paths(messages), messages, keep=1)
    return map_rows(formatted(branches, messages), _read_back, _READ, "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")


def _sql_escaped(column: str) -> str:
    first = f"replace(coalesce({column}, ''), '\\', '\\\\')"
    return reduce(lambda e, c: f"replace({e}, '{c}', '{LETTERS[c[0]] + c[1:]}')", CONTROLS, first)


ORACLE = f"""
WITH rows_ AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]'))
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length({_sql_escaped("text")}) + CASE role WHEN 'system' THEN 13 WHEN 'user' THEN 15 WHEN 'assistant' THEN 7 ELSE 16 + length(role) END) AS BIGINT) AS formatted_chars
FROM rows_ GROUP BY conv_id
"""

QUERIES = {"op4_reply_trees": op4_reply_trees}
ORACLES = {"op4_reply_trees": ORACLE}
