"""Chat formatting in budgeted windows, with DataFrame functions only.

Turns become pieces ``### Role: text</turn>`` and a line feed; control strings inside texts
are escaped reversibly. The prefix sums of a conversation's turn tokens choose spans of whole
turns that fit a budget. Every window after the first repeats the system turn and the last
turns before it, as far as they fit a limited history. The loss mask covers the text of
assistant turns in the window that owns them, never a repeated one.

Turns are numbered over slices of their full order, so neither a conversation that holds a
third of all rows nor one turn number that many rows share meets in one task, and what numbers the turns carry
does not matter. A conversation is laid out in blocks of `GROUP` turns by position, and only a
block is ever an array; a block learns about the one before it from a row per block, and only
conversations of several blocks take part in that. A window also ends where its block
ends. A turn that alone passes the budget is a window of its own and is flagged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from accordance.llm import common
from accordance.operators.ordered import within_groups

BUDGET, HISTORY, GROUP = 2048, 256, 256
#: Characters of a text by which slices are cut; the order itself is that of whole texts.
_BEGINNING = 64
#: Control strings and what stands for them inside texts. The escape sign comes first.
ESCAPES = (("\\", "\\b"), ("###", "\\h"), ("</turn>", "\\t"))
OPEN, CLOSE = "### ", "</turn>\n"
SHOWN = {"system": "System", "user": "User", "assistant": "Assistant"}
#: What precedes a role that is not one of these.
OTHER = "\\="


def escape(c: Column) -> Column:
    for plain, sign in ESCAPES:
        c = F.replace(c, F.lit(plain), F.lit(sign))
    return c


def unescape(c: Column) -> Column:
    """The inverse: after escaping, the escape sign only stands before a letter of `ESCAPES`."""
    for plain, sign in reversed(ESCAPES):
        c = F.replace(c, F.lit(sign), F.lit(plain))
    return c


def shown_role(role: Column) -> Column:
    out = F.concat(F.lit(OTHER), F.replace(escape(role), F.lit(":"), F.lit("\\c")))
    for plain, name in SHOWN.items():
        out = F.when(role == plain, name).otherwise(out)
    return out


def plain_role(shown: Column) -> Column:
    rest = unescape(F.replace(F.substr(shown, F.lit(len(OTHER) + 1)), F.lit("\\c"), F.lit(":")))
    out = rest
    for plain, name in SHOWN.items():
        out = F.when(shown == name, plain).otherwise(out)
    return out


def byte_tokens(piece: Column) -> Column:
    """A token count without a vocabulary: four UTF-8 bytes are a token."""
    return F.floor((F.octet_length(piece) + 3) / 4).cast("long")


def _piece(role: Column, text: Column) -> Column:
    return F.concat(F.lit(OPEN), shown_role(role), F.lit(": "), escape(text), F.lit(CLOSE))


def _tail(turns: Column, history: int) -> Column:
    """The last turns of an array whose tokens fit the history, the system turn left out."""
    state = F.struct(F.lit(0).cast("long").alias("sum"), F.lit(0).alias("n"))

    def step(acc, x):
        total = acc["sum"] + x["tokens"]
        return F.struct(total.alias("sum"), (acc["n"] + F.when(total <= history, 1).otherwise(0)).alias("n"))

    n = F.aggregate(F.reverse(turns), state, step)["n"]
    last = F.slice(turns, F.size(turns) - n + 1, n)
    return F.transform(F.filter(last, lambda x: ~x["is_system"]), lambda x: x["piece"])


def _starts(turns: Column, capacity: Column) -> Column:
    """Where windows start (from 1): a turn opens one if its prefix sum leaves the capacity."""
    state = F.struct(
        F.array().cast("array<int>").alias("starts"), F.lit(0).cast("long").alias("base"),
        F.lit(0).cast("long").alias("before"), F.lit(1).alias("i"),
    )

    def step(acc, x):
        after = acc["before"] + x["tokens"]
        opens = (acc["i"] == 1) | (after - acc["base"] > capacity)
        return F.struct(
            F.when(opens, F.array_append(acc["starts"], acc["i"])).otherwise(acc["starts"]).alias("starts"),
            F.when(opens, acc["before"]).otherwise(acc["base"]).alias("base"),
            after.alias("before"), (acc["i"] + 1).alias("i"),
        )

    return F.aggregate(turns, state, step)["starts"]


def _spans(context: Column, turns: Column) -> Column:
    """(start, end) of the assistant texts of the own turns, in code points of the window."""
    first = F.length(F.array_join(context, ""))
    state = F.struct(first.alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

    def step(acc, x):
        start = acc["at"] + F.lit(len(OPEN) + len(SHOWN["assistant"]) + 2)
        end = acc["at"] + F.length(x["piece"]) - len(CLOSE)
        span = F.struct(start.alias("start"), end.alias("end"))
        return F.struct(
            (acc["at"] + F.length(x["piece"])).alias("at"),
            F.when(x["is_target"], F.array_append(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"),
        )

    return F.aggregate(turns, state, step)["spans"]


def slice_order() -> list:
    """The order of turns by beginnings of texts, so that the cuts stay small however long texts are."""
    # a role that is cut off says nothing about the texts behind it
    text = F.when(F.length("role") < _BEGINNING, F.left("text", F.lit(_BEGINNING))).otherwise("")
    return ["turn", F.left("role", F.lit(_BEGINNING)), text]


def _blocks(conversations: DataFrame, tokens) -> DataFrame:
    """``conv_id``, ``block`` and ``turns``: `GROUP` turns each, by their position, as a written table."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"))
    placed = within_groups(rows, "conv_id", ["turn", "role", "text"], seq="rn", cut=slice_order())
    turn = F.struct(
        "rn", "piece", tokens(F.col("piece")).alias("tokens"), (F.col("role") == "system").alias("is_system"),
        (F.col("role") == "assistant").alias("is_target"),
    )
    block = F.floor((F.col("rn") - 1) / GROUP).cast("long").alias("block")
    shown = placed.select("conv_id", block, "rn", "role", _piece(F.col("role"), F.col("text")).alias("piece"))
    return common.written(shown.groupBy("conv_id", "block").agg(F.sort_array(F.collect_list(turn)).alias("turns")))


def format_windows(
    conversations: DataFrame, budget: int = BUDGET, history: int = HISTORY, tokens=byte_tokens
) -> DataFrame:
    """Windows: ``conv_id``, ``block``, ``window`` (their order), ``n_turns``, ``n_repeated``
    (turns at the head that are only context), ``text``, ``loss_spans``, ``n_tokens``, ``over_budget``.

    Turns are ordered by turn (null first), then role, then text; repeated rows are repeated
    turns. A null text or role is empty; a null conv_id is one conversation. The system turn is
    the first turn if its role is ``system``; where it leaves no room, every window holds
    one turn. Other columns are not read. An empty table gives no windows.
    """
    blocks = _blocks(conversations, tokens)
    # only the first turn is the system turn; the same role further on is an ordinary turn
    first = F.get("turns", F.lit(0))
    head = F.when((F.col("block") == 0) & first["is_system"], first["piece"])
    lone = (F.col("block") == 0) & (F.size("turns") < GROUP)
    several = blocks.where(~lone)

    def same(right: DataFrame) -> Column:
        return F.col("conv_id").eqNullSafe(right["_conv"]) & (F.col("block") == right["_block"])

    def with_starts(rows: DataFrame) -> DataFrame:
        capacity = F.lit(budget - history) - F.coalesce(tokens(F.col("system")), F.lit(0))
        return rows.withColumn("starts", _starts(F.col("turns"), capacity))

    heads = several.select(F.col("conv_id").alias("_of"), head.alias("system")).where("system is not null")
    told = several.select(F.col("conv_id").alias("_conv"), F.col("block").alias("_block"))
    told = told.join(heads, F.col("_conv").eqNullSafe(F.col("_of"))).drop("_of")
    sized = with_starts(several.join(told, same(told), "left").drop("_conv", "_block"))
    last = F.slice("turns", F.element_at("starts", -1), F.size("turns"))
    before = sized.select(
        F.col("conv_id").alias("_conv"), (F.col("block") + 1).alias("_block"), _tail(last, history).alias("before")
    )
    joined = sized.join(before, same(before), "left").drop("_conv", "_block")
    alone = with_starts(blocks.where(lone).withColumn("system", head)).withColumn("before", F.lit(None).cast("array<string>"))
    ends = F.concat(F.slice("starts", 2, F.size("starts")), F.array(F.size("turns") + 1))
    spans = F.transform(F.arrays_zip(F.col("starts").alias("i"), ends.alias("j")), lambda s: F.slice("turns", s["i"], s["j"] - s["i"]))
    windows = joined.unionByName(alone).withColumn("spans", spans).select(
        "conv_id", "block", "system", "before", "spans", F.posexplode("spans").alias("window", "own"),
    )
    past = F.when(F.col("window") == 0, F.coalesce("before", F.array().cast("array<string>"))).otherwise(
        _tail(F.element_at("spans", F.greatest("window", F.lit(1))), history)
    )
    whole = (F.col("block") == 0) & (F.col("window") == 0)
    context = F.when(whole, F.array().cast("array<string>")).otherwise(
        F.concat(F.when(F.col("system").isNull(), F.array().cast("array<string>")).otherwise(F.array("system")), past)
    )
    shaped = windows.withColumn("context", context)
    text = F.concat(F.array_join("context", ""), F.array_join(F.transform("own", lambda x: x["piece"]), ""))
    out = shaped.select(
        "conv_id", "block", "window", F.size("own").alias("n_turns"), F.size("context").alias("n_repeated"),
        text.alias("text"), _spans(F.col("context"), F.col("own")).alias("loss_spans"),
    )
    return out.withColumn("n_tokens", tokens(F.col("text"))).withColumn("over_budget", F.col("n_tokens") > budget)


def read_turns(text: Column, n_repeated: Column) -> Column:
    """(role, text) of a window's own turns, unescaped."""
    pieces = F.split(text, "</turn>\n", -1)
    own = F.slice(pieces, n_repeated + 1, F.size(pieces) - 1 - n_repeated)

    def one(p):
        colon = F.instr(p, ":")
        return F.struct(
            plain_role(F.substr(p, F.lit(len(OPEN) + 1), colon - len(OPEN) - 1)).alias("role"),
            unescape(F.substr(p, colon + 2)).alias("text"),
        )

    return F.transform(own, one)


def read_targets(text: Column, spans: Column) -> Column:
    """The texts under the loss mask, unescaped."""
    return F.transform(spans, lambda s: unescape(F.substr(text, s["start"] + 1, s["end"] - s["start"])))


def digests(conversations: DataFrame) -> DataFrame:
    """Per conversation what its windows hold, read back from them.

    A digest of a whole conversation needs its texts in one place; nothing else does. They travel
    as windows and are read where they meet. Nulls, repeats and empty tables are as in `format_windows`.
    """
    rows = format_windows(conversations).select("conv_id", F.struct("block", "window", "n_repeated", "text", "loss_spans").alias("w"))
    gathered = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("w")).alias("w"))
    lines = F.flatten(F.transform("w", lambda x: read_turns(x["text"], x["n_repeated"])))
    loss = F.array_join(F.flatten(F.transform("w", lambda x: read_targets(x["text"], x["loss_spans"]))), "")
    read = gathered.select(
        "conv_id", F.transform(lines, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))).alias("lines"),
        loss.alias("loss"), F.aggregate("w", F.lit(0).cast("long"), lambda n, x: n + F.length(x["text"])).alias("formatted_chars"),
    )
    return read.select(
        "conv_id", F.size("lines").cast("long").alias("n_turns"), F.sha2(F.array_join("lines", ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars",
    )


CONTROL = "\\### Assistant: </turn> ok"


def op1_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and one that is full of control strings, formatted and read back."""
    given = common.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(CONTROL).alias("text"),
    )
    return digests(given.unionByName(extra))


_SQL = rf"""
WITH RECURSIVE given AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{CONTROL}' UNION ALL SELECT -7, 1, 'assistant', '{CONTROL}'),
shaped AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS place,
         '### ' || CASE role WHEN 'system' THEN 'System' WHEN 'user' THEN 'User' WHEN 'assistant' THEN 'Assistant'
           ELSE '\=' || replace(replace(replace(replace(role, '\', '\b'), '###', '\h'), '</turn>', '\t'), ':', '\c') END
         || ': ' || replace(replace(replace(text, '\', '\b'), '###', '\h'), '</turn>', '\t') || '</turn>' || chr(10) AS piece
  FROM given),
head AS (
  SELECT conv_id, piece AS system FROM shaped WHERE place = 1 AND role = 'system'),
sized AS (
  SELECT s.conv_id, (place - 1) // {GROUP} AS block, place, (place - 1) % {GROUP} + 1 AS i, s.role, s.piece,
         length(s.piece) AS chars, (strlen(s.piece) + 3) // 4 AS tokens,
         {BUDGET - HISTORY} - coalesce((strlen(h.system) + 3) // 4, 0) AS capacity, coalesce(length(h.system), 0) AS system_chars
  FROM shaped s LEFT JOIN head h USING (conv_id)),
summed AS (
  SELECT *, sum(tokens) OVER (PARTITION BY conv_id, block ORDER BY i) AS after FROM sized),
starts AS (
  SELECT conv_id, block, 1::BIGINT AS i, 0::HUGEINT AS base, capacity FROM summed WHERE i = 1
  UNION ALL
  SELECT n.conv_id, n.block, n.i, s.after - s.tokens, n.capacity FROM (
    SELECT t.conv_id, t.block, min(s.i) AS i, any_value(t.capacity) AS capacity
    FROM starts t JOIN summed s ON s.conv_id = t.conv_id AND s.block = t.block
     AND s.i > t.i AND s.after - t.base > t.capacity
    GROUP BY t.conv_id, t.block, t.i) n
  JOIN summed s ON s.conv_id = n.conv_id AND s.block = n.block AND s.i = n.i),
windows AS (
  SELECT s.*, max(t.i) AS w FROM summed s JOIN starts t
    ON s.conv_id = t.conv_id AND s.block = t.block AND t.i <= s.i
  GROUP BY ALL),
tails AS (
  SELECT *, sum(tokens) OVER (PARTITION BY conv_id, block, w ORDER BY i DESC) AS behind FROM windows),
sums AS (
  SELECT conv_id, block, w, sum(chars) AS own, any_value(system_chars) AS system_chars,
         coalesce(sum(chars) FILTER (WHERE behind <= {HISTORY} AND role <> 'system'), 0) AS tail
  FROM tails GROUP BY conv_id, block, w),
seen AS (
  SELECT conv_id, own + coalesce(lag(tail + system_chars) OVER (PARTITION BY conv_id ORDER BY block, w), 0) AS chars FROM sums),
formatted AS (SELECT conv_id, sum(chars)::BIGINT AS formatted_chars FROM seen GROUP BY conv_id),
plain AS (
  SELECT conv_id, count(*) AS n_turns,
         sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
         coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
         sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256
  FROM given GROUP BY conv_id)
SELECT conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars FROM plain JOIN formatted USING (conv_id)"""

QUERIES = {"op1_chat_windows": (op1_chat_windows, _SQL)}
