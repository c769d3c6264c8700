"""Chat formatting by quotation linking.

A message's lines are parsed into quote levels (leading ``>`` signs, spaces between them allowed). What stands at a level, and
what a message says itself, is cut into passages: runs of lines, their paragraphs, sentences, and lines, each normalised
(lower case, one space between words, line breaks as spaces) and hashed. So a quote is found however it was wrapped, and a
part of a message too. Quoted passages are joined to the messages of the same conversation that said them.

Of each quoted passage the nearest earlier message that said it is a candidate, one row for each passage, however many said
it. The message quoted at a level is the candidate with most passages that it alone has said, then with the most in all,
each passage counting for as much less as more messages said it, then the nearest: so signatures and greetings pull no
quote to another message. Level one names the message replied to; following replies to their start gives thread and depth.
The text is what remains without quotes and the lines that announce them.

Passages are aggregated by (conversation, hash, turn) before they meet. The nearest earlier turn is looked for within a block of
BLOCK turns and then over blocks, so a line that most messages of a hot conversation say is spread over its blocks. Threads
are followed by pointer doubling over the links. Conversations are ordered by a range sort, which splits a long one over
tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heddle.llm.common import broadcast_if_small, materialise

#: Turns of a block.
BLOCK = 1024

_QUOTED = r"^[ \t]*>"
_MARKS = r"^[ \t]*(?:>[ \t]*)+"
#: A line that announces a quote, where it stands before one.
_ANNOUNCES = r"^[ \t]*(?:On\b.*\bwrote|Am\b.*\bschrieb.*|Le\b.*a écrit|El\b.*escribió)[ \t]*:[ \t]*$"


def quote_level(line: Column) -> Column:
    """How many quote marks lead a line."""
    return F.length(F.regexp_replace(F.regexp_extract(line, _MARKS, 0), r"[^>]", ""))


def _bare(line: Column) -> Column:
    return F.trim(F.regexp_replace(line, _MARKS, ""))


def _plain(passage: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(passage), r"\s+", " "))


def _hash(plain: Column) -> Column:
    """Two 64-bit halves, so that equal hashes mean equal passages."""
    return F.struct(F.xxhash64(plain).alias("a"), F.xxhash64(F.lit("passage"), plain).alias("b"))


def unquoted(text: Column) -> Column:
    """A text without quoted lines and the lines that announce them."""
    lines = F.split(text, "\r?\n")
    after = F.concat(F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0))), F.array(F.lit("")))
    pairs = F.arrays_zip(lines.alias("line"), after.alias("next"))
    kept = F.filter(pairs, lambda x: ~x["line"].rlike(_QUOTED) & ~(x["line"].rlike(_ANNOUNCES) & x["next"].rlike(_QUOTED)))
    joined = F.array_join(F.transform(kept, lambda x: x["line"]), "\n")
    return F.when(text.rlike(r"(?m)" + _QUOTED), F.regexp_replace(joined, r"^\s+|\s+$", "")).otherwise(text)


def passages(messages: DataFrame) -> DataFrame:
    """``(conv, turn, level, h, is_line)`` of messages ``(conv, turn, text)``: the distinct passages of each quote level, 0 for
    what a message says itself, with the lines that announce a quote left out."""
    told = messages.distinct().withColumn("m", F.xxhash64("text"))
    lines = told.select("conv", "turn", "m", F.posexplode(F.split("text", "\r?\n")).alias("pos", "raw"))
    lines = lines.withColumn("level", quote_level(F.col("raw"))).withColumn("line", F.when(F.col("level") > 0, _bare(F.col("raw"))).otherwise(F.trim("raw")))
    # A message is at most a task's window here; its runs are lines of one level side by side, its paragraphs end at blanks.
    message = Window.partitionBy("conv", "turn", "m").orderBy("pos")
    nth = F.row_number().over(Window.partitionBy("conv", "turn", "m", "level").orderBy("pos"))
    announced = F.col("raw").rlike(_ANNOUNCES) & (F.coalesce(F.lead("level").over(message), F.lit(0)) > 0)
    lines = lines.withColumns({"run": F.col("pos") - nth, "para": F.sum((F.col("line") == "").cast("int")).over(message), "out": announced})
    kept = lines.where(~F.col("out") & (F.col("line") != "")).select("conv", "turn", "m", "level", "run", "para", "pos", "line")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), " ")
    of = ["conv", "turn", "level"]
    runs = kept.groupBy(*of, "m", "run").agg(_plain(joined).alias("plain"))
    paragraphs = kept.groupBy(*of, "m", "run", "para").agg(_plain(joined).alias("plain"))
    sentences = paragraphs.select(*of, F.explode(F.split("plain", "(?<=[.!?]) ")).alias("plain"))
    single = kept.select(*of, _plain(F.col("line")).alias("plain"), F.lit(1).alias("is_line"))
    longer = runs.select(*of, "plain").unionByName(paragraphs.select(*of, "plain")).unionByName(sentences).withColumn("is_line", F.lit(0))
    return longer.unionByName(single).where("plain <> ''").groupBy(*of, _hash(F.col("plain")).alias("h")).agg(F.max("is_line").alias("is_line"))


def _nearest_before(quoted: DataFrame, said: DataFrame) -> DataFrame:
    """``quoted(conv, h, turn)`` with ``near``, the last turn before theirs in ``said(conv, h, turn)``; rows without one go."""
    of, block = ["conv", "h"], F.floor(F.col("turn") / BLOCK).alias("block")
    both = quoted.select(*of, "turn", block, F.lit(None).cast("long").alias("said")).distinct().unionByName(said.select(*of, "turn", block, F.col("turn").alias("said")))
    within = F.max("said").over(Window.partitionBy(*of, "block").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1))
    here = both.withColumn("near", within).where("said is null").drop("said")
    last = said.groupBy(*of, block).agg(F.max("turn").alias("said"))
    asked = quoted.select(*of, block).distinct().withColumn("said", F.lit(None).cast("long")).unionByName(last).groupBy(*of, "block").agg(F.max("said").alias("said"))
    earlier = asked.select(*of, "block", F.max("said").over(Window.partitionBy(*of).orderBy("block").rangeBetween(Window.unboundedPreceding, -1)).alias("earlier"))
    found = here.join(earlier, [*of, "block"], "left")
    return found.select(*of, "turn", F.coalesce("near", "earlier").alias("near")).where("near is not null")


def quotation_links(df: DataFrame, conv: str = "conv_id", turn: str = "turn", text: str = "text") -> DataFrame:
    """``(conv, turn, level, quoted_turn, n_lines)``: for each message and quote level the message it quotes, and how many of the
    distinct quoted lines that message says itself. Turns are whole numbers."""
    kind = df.schema[turn].dataType
    rows = df.select(F.col(conv).alias("conv"), F.col(turn).cast("long").alias("turn"), F.col(text).alias("text")).where("conv is not null and turn is not null and text is not null")
    quoting = rows.where(F.col("text").rlike(r"(?m)" + _QUOTED))
    # Conversations without a quote need no look, if that saves more than it costs.
    spoken = rows.join(broadcast_if_small(quoting.select("conv").distinct(), 100_000), "conv", "left_semi")
    cut = materialise(passages(spoken), "passages")
    quoted = cut.where("level > 0")
    said = materialise(cut.where("level = 0").select("conv", "h", "turn").join(quoted.select("conv", "h").distinct(), ["conv", "h"], "left_semi"), "said")
    sayers = said.groupBy("conv", "h").agg(F.count(F.lit(1)).alias("sayers"))
    near = _nearest_before(quoted.select("conv", "h", "turn"), said).join(sayers, ["conv", "h"])
    met = quoted.select("conv", "turn", "level", "h").join(near, ["conv", "h", "turn"])
    score = met.groupBy("conv", "turn", "level", F.col("near").alias("quoted_turn")).agg(F.count_if(F.col("sayers") == 1).alias("alone"), F.sum(F.floor(F.lit(1 << 20) / F.col("sayers"))).alias("weight"))
    best = score.groupBy("conv", "turn", "level").agg(F.max(F.struct("alone", "weight", "quoted_turn")).alias("best")).select("conv", "turn", "level", F.col("best.quoted_turn").alias("quoted_turn"))
    lines = quoted.where("is_line = 1").join(best, ["conv", "turn", "level"]).join(said.withColumnRenamed("turn", "quoted_turn"), ["conv", "h", "quoted_turn"])
    counted = best.join(lines.groupBy("conv", "turn", "level").agg(F.count(F.lit(1)).alias("n_lines")), ["conv", "turn", "level"], "left")
    return counted.select("conv", F.col("turn").cast(kind).alias("turn"), "level", F.col("quoted_turn").cast(kind).alias("quoted_turn"), F.coalesce("n_lines", F.lit(0)).alias("n_lines"))


def _threads(replies: DataFrame, max_rounds: int = 64) -> DataFrame:
    """``replies(conv, turn, reply_to)`` -> ``(conv, turn, root, depth)`` by pointer doubling."""
    now = materialise(replies.select("conv", "turn", F.col("reply_to").alias("root"), F.lit(1).cast("long").alias("depth")), "threads")
    for _ in range(max_rounds):
        up = now.select("conv", F.col("turn").alias("root"), F.col("root").alias("above"), F.col("depth").alias("more"))
        step = now.join(up, ["conv", "root"], "left")
        step = materialise(step.select("conv", "turn", F.coalesce("above", "root").alias("root"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), F.col("above").isNotNull().alias("moved")), "threads")
        now = step.drop("moved")
        if not step.where("moved").take(1):
            return now
    raise RuntimeError("reply chains did not settle")


def formatted(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``(conv, turn, role, text, reply_to, root, depth, quotes)`` for every message, ordered by conversation and reply.

    reply_to is the message that level one quotes, null where the message quotes none; root is the first message of its
    thread, itself included, and depth its distance; quotes lists ``level:turn``. Rows are sorted by (conv, root, turn,
    depth) over all partitions: a thread's messages stand together, each after the one that it replies to. A null text is
    kept null, an empty one is empty, a null conversation or turn links with nothing, repeated messages come back as often as
    they came in and count as one, a very long message is cut into passages within one task; an empty table gives an empty
    one. Other columns are ignored, whatever their names.
    """
    links = materialise(quotation_links(df, conv, turn, text), "quotes")
    rows = df.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.col(role).alias("role"), unquoted(F.col(text)).alias("text"))
    if not links.take(1):
        none = F.lit(None).cast(df.schema[turn].dataType)
        out = rows.select("*", none.alias("reply_to"), F.col("turn").alias("root"), F.lit(0).cast("long").alias("depth"), F.lit("").alias("quotes"))
    else:
        replies = links.where("level = 1").select("conv", "turn", F.col("quoted_turn").alias("reply_to"))
        # A message has few quote levels; the list is bounded by them, not by the conversation.
        listed = links.groupBy("conv", "turn").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("level", "quoted_turn"))), lambda x: F.concat_ws(":", x["level"].cast("string"), x["quoted_turn"].cast("string"))), ",").alias("quotes"))
        out = rows.join(replies, ["conv", "turn"], "left").join(_threads(replies), ["conv", "turn"], "left").join(listed, ["conv", "turn"], "left")
        out = out.select("conv", "turn", "role", "text", "reply_to", F.coalesce("root", "turn").alias("root"), F.coalesce("depth", F.lit(0)).alias("depth"), F.coalesce("quotes", F.lit("")).alias("quotes"))
    order = ["conv", "root", "turn", "depth"]
    return out.repartitionByRange(*order).sortWithinPartitions(*order)
