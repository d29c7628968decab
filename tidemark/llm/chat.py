"""Chat formatting in budgeted windows, with DataFrame functions only.

A turn is rendered as ``[TURN]role[TEXT]text</s>`` and a window as ``<s>`` and its turns. In roles and texts a
backslash is doubled and one is put after every ``<`` and ``[``, so no control string can occur inside them;
:func:`unescape` undoes it.

The prefix sum of a conversation's turn tokens (turns in order) over the span budget numbers the windows, so
spans are aligned with turns: a window takes the turns that begin within its span. A span is the budget less what
is kept for system turns and history; a turn longer than that makes its window longer, as turns are never cut.
Windows after the first repeat the leading system turns and then the last turns of the window before, as many as
fit the history budget. The loss mask holds the text (not the marks) of each assistant turn in the one window
where it isn't repeated.

Prefix sums are taken within blocks of turns and then over block totals, so that a long conversation is not
summed by one task.

Defined cases: null text and null role count as empty; null turns come first; turns with equal numbers are
ordered by role and text; repeated rows are repeated turns; rows with a null conv_id form a conversation; an
empty table gives no windows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import materialize

TURN, TEXT, END, BEGIN = "[TURN]", "[TEXT]", "</s>", "<s>"
#: Characters a token is taken to have, and tokens of a window, of it kept for system turns and for history.
CHARS_A_TOKEN, BUDGET, SYSTEM_BUDGET, HISTORY_BUDGET = 4, 2048, 512, 256
#: Turn numbers of a block of prefix sums.
BLOCK = 256


def escape(text: Column) -> Column:
    for old, new in (("\\", "\\\\"), ("<", "<\\"), ("[", "[\\")):
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def unescape(text: Column) -> Column:
    for old, new in (("[\\", "["), ("<\\", "<"), ("\\\\", "\\")):
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def tokens(text: Column) -> Column:
    return F.ceil(F.length(text) / CHARS_A_TOKEN).cast("long") + 1


def _spans(turns: DataFrame, span: int) -> DataFrame:
    """Adds before (tokens of the turns before it) and win to turns with conv, pos order columns."""
    key, order = ["conv_id", "block"], [F.asc_nulls_first("turn"), F.asc("role"), F.asc("text")]
    blocks = turns.withColumn("block", F.coalesce(F.floor(F.col("turn") / BLOCK), F.lit(-(2**40))))
    totals = blocks.groupBy(*key).agg(F.sum("n").alias("total"), F.count("*").alias("rows"))
    earlier = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("conv_id", "block", F.coalesce(F.sum("total").over(earlier), F.lit(0)).alias("tokens0"), F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("rows0"))
    inside = Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    joined = blocks.withColumns({"upto": F.sum("n").over(inside), "at": F.count("*").over(inside)}).alias("b").join(totals.alias("t"), F.col("b.conv_id").eqNullSafe(F.col("t.conv_id")) & (F.col("b.block") == F.col("t.block")))
    return joined.select("b.conv_id", "b.role", "b.text", "b.n", (F.col("rows0") + F.col("at") - 1).alias("pos"), (F.col("tokens0") + F.col("upto") - F.col("n")).alias("before")).withColumn("win", F.floor(F.col("before") / span))


def windows(conversations: DataFrame, budget: int = BUDGET, system_budget: int = SYSTEM_BUDGET, history_budget: int = HISTORY_BUDGET) -> DataFrame:
    """One row for each window: conv_id, win, n_repeated, formatted, loss (array of [start, stop) code points)."""
    span = budget - system_budget - history_budget
    if span <= 0 or history_budget > span:
        raise ValueError("the budgets leave no span that is as long as the history")
    turns = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).withColumn("n", tokens(F.col("text")))
    # Several branches read the placed turns and the windows' bounds: both are written once.
    placed = materialize(_spans(turns, span), "chat-turns")
    by_conv = Window.partitionBy("conv_id").orderBy("win")
    starts = placed.groupBy("conv_id", "win").agg(F.min("before").alias("start"), F.min(F.when(F.col("role") != "system", F.col("pos"))).alias("other"))
    first_other = F.min("other").over(Window.partitionBy("conv_id")).alias("first_other")
    bounds = materialize(starts.select("conv_id", "win", F.lead("win").over(by_conv).alias("next_win"), F.lead("start").over(by_conv).alias("next_start"), first_other), "chat-windows")
    same = F.col("p.conv_id").eqNullSafe(F.col("b.conv_id")) & (F.col("p.win") == F.col("b.win"))
    known = placed.alias("p").join(bounds.alias("b"), same).select("p.*", "next_win", "next_start", "first_other")
    small_system = (F.col("role") == "system") & (F.col("before") + F.col("n") <= system_budget)
    # A turn is in its own window (kind 2) and, if it is near its end, in the history of the next (kind 1).
    near = F.col("next_win").isNotNull() & (F.col("next_start") - F.col("before") <= history_budget) & ~small_system
    own = F.struct(F.col("win"), F.lit(2).alias("kind"))
    uses = F.when(near, F.array(own, F.struct(F.col("next_win").alias("win"), F.lit(1).alias("kind")))).otherwise(F.array(own))
    said = known.select("conv_id", "pos", "role", "text", F.explode(uses).alias("use")).select("conv_id", "use.win", "pos", "role", "text", "use.kind")
    # The system prompt: the turns before the first that isn't a system turn, as far as they fit their budget. It is in
    # every later window (kind 0).
    system = known.where(small_system & (F.col("first_other").isNull() | (F.col("pos") < F.col("first_other")))).select(F.col("conv_id").alias("c"), "pos", "role", "text", F.col("win").alias("w"))
    later = bounds.where("next_win is not null").select("conv_id", F.col("next_win").alias("win"))
    kept = later.join(system, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("win") > F.col("w"))).select("conv_id", "win", "pos", "role", "text", F.lit(0).alias("kind"))
    pieces = said.unionByName(kept).select("conv_id", "win", "pos", "kind", "role", F.concat(F.lit(TURN), escape(F.col("role")), F.lit(TEXT)).alias("head"), escape(F.col("text")).alias("body"))
    listed = pieces.groupBy("conv_id", "win").agg(F.array_sort(F.collect_list(F.struct("kind", "pos", "role", "head", "body"))).alias("turns"))
    grow = F.aggregate(
        "turns",
        F.struct(F.lit(len(BEGIN)).alias("at"), F.array().cast("array<struct<start:int,stop:int>>").alias("loss")),
        lambda a, t: F.struct(
            (a["at"] + F.length(t["head"]) + F.length(t["body"]) + len(END)).alias("at"),
            F.when((t["kind"] == 2) & (t["role"] == "assistant"), F.array_append(a["loss"], F.struct((a["at"] + F.length(t["head"])).alias("start"), (a["at"] + F.length(t["head"]) + F.length(t["body"])).alias("stop")))).otherwise(a["loss"]).alias("loss"),
        ),
    )
    return listed.select("conv_id", "win", F.size(F.filter("turns", lambda t: t["kind"] < 2)).alias("n_repeated"), F.concat(F.lit(BEGIN), F.array_join(F.transform("turns", lambda t: F.concat(t["head"], t["body"], F.lit(END))), "")).alias("formatted"), grow["loss"].alias("loss"))


def read_windows(formatted: DataFrame) -> DataFrame:
    """What the windows say of each conversation: conv_id, turns (array of role, text in order), loss_texts,
    formatted_chars. Needs nothing but win, n_repeated, formatted and loss."""
    inner = F.substring(F.col("formatted"), len(BEGIN) + 1, F.length("formatted"))
    split = F.split(inner, END)  # the last part is what follows the last mark: nothing
    parts = F.slice(split, F.col("n_repeated") + 1, F.size(split) - 1 - F.col("n_repeated"))
    turn = lambda p: F.struct(unescape(F.substring_index(F.substring(p, F.lit(len(TURN) + 1), F.length(p)), TEXT, 1)).alias("role"), unescape(F.substring(p, F.instr(p, TEXT) + len(TEXT), F.length(p))).alias("text"))
    read = formatted.select("conv_id", "win", F.transform(parts, turn).alias("turns"), F.transform("loss", lambda s: unescape(F.substring(F.col("formatted"), s["start"] + 1, s["stop"] - s["start"]))).alias("loss_texts"), F.length("formatted").cast("long").alias("chars"))
    return read.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("win", "turns", "loss_texts"))).alias("w"), F.sum("chars").alias("formatted_chars")).select("conv_id", F.flatten(F.col("w.turns")).alias("turns"), F.flatten(F.col("w.loss_texts")).alias("loss_texts"), "formatted_chars")


def digest(formatted: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, read back from the windows."""
    read = read_windows(formatted)
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("loss_texts", "")
    return read.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said.cast("binary"), 256).alias("turns_sha256"), F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss.cast("binary"), 256).alias("loss_sha256"), "formatted_chars")


#: DuckDB: the same digests from the conversations themselves, and formatted_chars from the window rules.
DIGEST_SQL = f"""
with turns as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -1, 0, 'user', '</s>[INST] ok [/INST]' union all select -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), sized as (
  select *, cast(ceil(length(text) / {CHARS_A_TOKEN}.0) as bigint) + 1 as n,
    length('{TURN}{TEXT}{END}') + length(role) + length(text)
      + length(regexp_replace(role || text, '[^\\\\<\\[]', '', 'g')) as chars
  from turns
), placed as (
  select *, row_number() over o as pos, sum(n) over o - n as before from sized
  window o as (partition by conv_id order by turn nulls first, role, text rows unbounded preceding)
), won as (select *, floor(before / {BUDGET - SYSTEM_BUDGET - HISTORY_BUDGET}) as win from placed
), bounds as (
  select conv_id, win, lead(win) over (partition by conv_id order by win) as next_win,
    lead(start) over (partition by conv_id order by win) as next_start
  from (select conv_id, win, min(before) as start from won group by conv_id, win)
), others as (select conv_id, min(pos) as first_other from won where role <> 'system' group by conv_id
), system as (
  select w.* from won w left join others o on w.conv_id is not distinct from o.conv_id
  where w.role = 'system' and w.before + w.n <= {SYSTEM_BUDGET} and (o.first_other is null or w.pos < o.first_other)
), pieces as (
  select conv_id, chars from won
  union all select w.conv_id, w.chars from won w join bounds b on w.conv_id is not distinct from b.conv_id and w.win = b.win
    where b.next_win is not null and b.next_start - w.before <= {HISTORY_BUDGET} and not (w.role = 'system' and w.before + w.n <= {SYSTEM_BUDGET})
  union all select s.conv_id, s.chars from system s join bounds b on s.conv_id is not distinct from b.conv_id and b.next_win > s.win
    where b.next_win is not null
), sums as (select conv_id, sum(chars) as chars from pieces group by conv_id
), counted as (select conv_id, count(*) as wins from bounds group by conv_id)
select p.conv_id, count(*) as n_turns,
  sha256(string_agg(p.role || chr(10) || p.text || chr(10), '' order by p.pos)) as turns_sha256,
  cast(coalesce(sum(length(p.text)) filter (where p.role = 'assistant'), 0) as bigint) as loss_chars,
  sha256(coalesce(string_agg(p.text, '' order by p.pos) filter (where p.role = 'assistant'), '')) as loss_sha256,
  cast(any_value(s.chars) + {len(BEGIN)} * any_value(c.wins) as bigint) as formatted_chars
from placed p join sums s on p.conv_id is not distinct from s.conv_id join counted c on p.conv_id is not distinct from c.conv_id
group by p.conv_id
"""
