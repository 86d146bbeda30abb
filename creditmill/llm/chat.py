"""Conversations ordered by replies, found by linking quoted passages to the messages they come from."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from creditmill.llm.common import kept_alone, numbered, spread_join, text_of, written

#: Positions of a conversation that are walked together; a longer conversation is walked in such blocks.
BLOCK = 1024
#: A conversation: its id, and whether it is that of the messages without one.
CONV = ["conv", "nul"]
TEMPLATE = ("<|", "|>\n", "\n<|end|>\n")
_PREFIX = re.compile(r"(?:[ \t]*>)+[ \t]?")
#: A line that introduces a quotation (English, German, French, Spanish).
_INTRODUCES = re.compile(r"(?:wrote|schrieb|a écrit|escribió)[^\n]{0,80}:\s*$")


def parse(text: str) -> tuple[str, list[tuple[int, str]]]:
    """The text without quotations, and the quoted passages in order as (level, passage)."""
    own, passages, level_before = [], [], 0
    for line in text.split("\n"):
        prefix = _PREFIX.match(line)
        level = prefix.group().count(">") if prefix else 0
        if level == 0:
            own.append(line)
        else:
            if level_before == 0 and own and _INTRODUCES.search(own[-1]):
                own.pop()
            body = line[prefix.end():]
            if level == level_before:
                passages[-1][1].append(body)
            else:
                passages.append((level, [body]))
        level_before = level
    return "\n".join(own).strip("\n"), [(level, "\n".join(lines)) for level, lines in passages]


def _units(text: Column) -> Column:
    """Hashes of the normalised text, of its paragraphs and of its lines, those without a letter or digit left out."""
    every = F.concat(F.array(text), F.split(text, r"\n[ \t]*\n"), F.split(text, "\n"))
    plain = F.transform(every, lambda x: F.trim(F.regexp_replace(F.lower(x), r"[^\p{L}\p{N}]+", " ")))
    return F.transform(F.array_distinct(F.filter(plain, lambda x: x != "")), lambda x: F.sha2(x, 256))


def _numbered(messages: DataFrame) -> DataFrame:
    """Adds pos, the message's number in its conversation by turn, then by hash of role and text; a missing turn comes first.

    All messages are numbered by range partitions, so a conversation, or the messages without one, may hold any share of them.
    """
    ordered = numbered(messages.select(*CONV, "turn", "tie", "mid"), [*CONV, "turn", "tie", "mid"], "nr")
    groups = written(ordered.groupBy(*CONV).agg(F.min("nr").alias("first"), F.count("*").alias("n")), "conversations")
    places = spread_join(ordered, groups, CONV, "n", ["nr"]).select("mid", (F.col("nr") - F.col("first") + 1).alias("pos"))
    return messages.join(places.hint("merge"), "mid").drop("tie", "mid")


def link(parsed: DataFrame) -> DataFrame:
    """(conv, pos, level, source): for each quoted passage the last earlier message of its conversation that has it.

    A passage is looked up as a whole, else by its paragraphs and lines. Each (conversation, hash) group is walked in
    order of blocks of positions, so that even one that is quoted everywhere meets in no single place.
    """
    key = [*CONV, "unit", "part"]
    quotes = parsed.select(*CONV, "pos", F.posexplode("quotes").alias("nth", "q")).select(
        *CONV, "pos", "nth", F.col("q.level").alias("level"), F.posexplode(_units(F.col("q.passage"))).alias("rank", "unit"))
    quotes = written(quotes, "quotes")
    asked = quotes.select(*CONV, "unit").distinct()
    originals = parsed.select(*CONV, "pos", F.explode(_units(F.col("own"))).alias("unit")).join(
        asked, [*CONV, "unit"], "left_semi")
    part = F.floor(F.col("pos") / F.lit(BLOCK))
    events = originals.select(*CONV, "unit", "pos", F.col("pos").alias("source"), F.lit(None).cast("int").alias("nth"),
                              F.lit(None).cast("int").alias("level"), F.lit(None).cast("int").alias("rank")).unionByName(
        quotes.withColumn("source", F.lit(None).cast("long"))).withColumn("part", part)
    events = written(events, "events")
    tops = events.groupBy(*key).agg(F.max("source").alias("top"))
    carried = tops.withColumn("carried", F.max("top").over(Window.partitionBy(*CONV, "unit").orderBy("part")
                                                             .rowsBetween(Window.unboundedPreceding, -1))).drop("top")
    earlier = F.max("source").over(Window.partitionBy(*key).orderBy("pos").rangeBetween(Window.unboundedPreceding, -1))
    found = events.withColumn("near", earlier).where("nth IS NOT NULL").join(carried, key).withColumn(
        "source", F.coalesce("near", "carried")).where("source IS NOT NULL")
    return found.groupBy(*CONV, "pos", "nth", "level").agg(F.min(F.struct("rank", -F.col("source"))).alias("m")).select(
        *CONV, "pos", "level", (-F.col("m.col2")).alias("source"))


def _answered(parsed: DataFrame) -> DataFrame:
    """(conv, pos, reply_to, starts): the message each one answers, and whether that is not the message before."""
    best = link(parsed).groupBy(*CONV, "pos").agg(F.min(F.struct("level", -F.col("source"))).alias("m")).select(
        *CONV, "pos", (-F.col("m.col2")).alias("quoted"))
    answered = parsed.select(*CONV, "pos").join(written(best, "answers"), [*CONV, "pos"], "left").select(
        *CONV, "pos", F.coalesce("quoted", F.when(F.col("pos") > 1, F.col("pos") - 1)).alias("reply_to"))
    return answered.withColumn("starts", (F.col("pos") == 1) | (F.col("reply_to") != F.col("pos") - 1))


def _with_branches(answered: DataFrame) -> DataFrame:
    """Adds branch, the start of the run of messages, each answering the one before, that holds the message.

    Blocks of positions are walked, with the last start of earlier blocks carried over.
    """
    marked = answered.withColumns({"part": F.floor(F.col("pos") / F.lit(BLOCK)), "start": F.when(F.col("starts"), F.col("pos"))})
    tops = marked.groupBy(*CONV, "part").agg(F.max("start").alias("top"))
    carried = tops.withColumn("carried", F.max("top").over(Window.partitionBy(*CONV).orderBy("part").rowsBetween(
        Window.unboundedPreceding, -1))).drop("top")
    near = F.max("start").over(Window.partitionBy(*CONV, "part").orderBy("pos").rowsBetween(
        Window.unboundedPreceding, Window.currentRow))
    return marked.withColumn("near", near).join(carried, [*CONV, "part"]).select(
        *CONV, "pos", "reply_to", "starts", F.coalesce("near", "carried").alias("branch"))


def _parents(owned: DataFrame) -> DataFrame:
    """(conv, branch, reply_to, parent): the branch of the message that a branch hangs on, missing for the first."""
    starts = owned.where("starts").select(*CONV, "branch", "reply_to")
    asked = starts.where("reply_to IS NOT NULL").groupBy(*CONV, "reply_to").agg(F.count("*").alias("n"))
    holder = owned.select(*CONV, F.col("pos").alias("reply_to"), F.col("branch").alias("parent"))
    held = written(asked.join(holder, [*CONV, "reply_to"]), "parents")
    # a message that very many answer is one key of very many branches
    hung = spread_join(starts.where("reply_to IS NOT NULL"), held, [*CONV, "reply_to"], "n", ["branch"])
    return hung.select(*CONV, "branch", "reply_to", "parent").unionByName(
        starts.where("reply_to IS NULL").withColumn("parent", F.lit(None).cast("long")))


def _tour(branches: DataFrame) -> DataFrame:
    """(conv, node, next, behind): the walk around the tree of each conversation's branches as a linked list.

    A branch is entered (node 2 x branch) and left (one more); from entering it the walk goes to its first child, from
    leaving it to its next sibling, else it leaves the parent. Children come from the last message answered to the
    first, then by their own start. behind is what the node adds, the messages of a branch at its entry.
    """
    children = written(branches.where("parent IS NOT NULL").select(
        *CONV, "parent", (-F.col("reply_to")).alias("back"), "branch"), "children")
    ordered = numbered(children, [*CONV, "parent", "back", "branch"], "nr")
    # neighbours in the order of all children, not windows per parent: one message may have any number of answers
    after = ordered.select((F.col("nr") - 1).alias("nr"), *[F.col(k).alias(f"{k}_") for k in (*CONV, "parent", "branch")])
    same = (F.col("conv") == F.col("conv_")) & (F.col("nul") == F.col("nul_")) & (F.col("parent") == F.col("parent_"))
    siblings = ordered.join(after, "nr", "left").select(*CONV, "branch", F.when(same, F.col("branch_")).alias("sibling"))
    firsts = ordered.groupBy(*CONV, "parent").agg(F.min_by("branch", "nr").alias("child")).withColumnRenamed("parent", "branch")
    full = branches.join(siblings, [*CONV, "branch"], "left").join(firsts, [*CONV, "branch"], "left")
    enter, leave = F.col("branch") * 2, F.col("branch") * 2 + 1
    return full.select(*CONV, F.explode(F.array(
        F.struct(enter.alias("node"), F.coalesce(F.col("child") * 2, leave).alias("next"), F.col("n").alias("behind")),
        F.struct(leave.alias("node"), F.coalesce(F.col("sibling") * 2, F.col("parent") * 2 + 1).alias("next"),
                 F.lit(0).cast("long").alias("behind")))).alias("e")).select(*CONV, "e.*")


def _before(branches: DataFrame) -> DataFrame:
    """Adds before, the messages of a branch's conversation that are placed before the branch.

    The lists of ``_tour`` are summed from each node to the end by pointer doubling: a node adds the sum of the node it
    points to and takes over its pointer. Every node is pointed to once, so no key is hot, and the rows stay
    two a branch; the number of rounds is the logarithm of the longest list.
    """
    totals = written(branches.groupBy(*CONV).agg(F.sum("n").alias("total"), F.count("*").alias("branches")), "totals")
    known = written(spread_join(branches, totals.withColumn("several", F.col("branches") > 1), CONV, "branches", ["branch"]),
                    "branches")
    alone = known.where("NOT several").select(*CONV, "branch", "n", F.lit(0).cast("long").alias("before"))
    several = known.where("several")
    if several.isEmpty():
        return alone
    state = written(_tour(several), "tour")
    while not state.where("next IS NOT NULL").isEmpty():
        ahead = state.select(*CONV, F.col("node").alias("next"), F.col("next").alias("next_"), F.col("behind").alias("behind_"))
        moved = state.where("next IS NOT NULL").join(ahead, [*CONV, "next"]).select(
            *CONV, "node", F.col("next_").alias("next"), (F.col("behind") + F.col("behind_")).alias("behind"))
        state = written(state.where("next IS NULL").unionByName(moved), "tour")
    entered = state.where("node % 2 = 0").select(*CONV, F.expr("node DIV 2").alias("branch"), "behind")
    return alone.unionByName(several.join(entered, [*CONV, "branch"]).select(
        *CONV, "branch", "n", (F.col("total") - F.col("behind")).alias("before")))


def conversations(messages: DataFrame) -> DataFrame:
    """conv_id, turn, role, text (without quotations), reply_to, place, n_quotes, rendered; one row per message.

    reply_to is the pos of the message answered: the last message that an outermost quotation comes from, else the
    message before; missing for the first. pos numbers messages by turn, place numbers them in reply order, in which
    every message follows the one it answers. Missing texts are empty, a missing role is ``user``; messages with a
    missing conv_id form one conversation; repeated rows stay. An empty table gives no rows.
    """
    @F.pandas_udf("own string, quotes array<struct<level:int,passage:string>>")
    def parts(text: pd.Series) -> pd.DataFrame:
        found = [parse(t) for t in text]
        return pd.DataFrame({"own": [own for own, _ in found],
                             "quotes": [[{"level": n, "passage": p} for n, p in q] for _, q in found]})

    conv = F.col("conv_id").cast("long")
    base = messages.select(F.coalesce(conv, F.lit(0).cast("long")).alias("conv"), conv.isNull().alias("nul"),
                           F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("user")).alias("role"),
                           text_of().alias("t"))
    base = base.withColumns({"p": parts("t"), "tie": F.xxhash64("role", "t")})
    base = base.select(*CONV, "turn", "role", "tie", F.col("p.own").alias("own"), F.col("p.quotes").alias("quotes"),
                       F.monotonically_increasing_id().alias("mid"))
    spark = messages.sparkSession
    parsed = kept_alone(spark, "messages", lambda: _numbered(written(base, "parsed")))
    owned = kept_alone(spark, "owners", lambda: _with_branches(_answered(parsed)))
    lengths = owned.groupBy(*CONV, "branch").agg(F.count("*").alias("n"))
    first = kept_alone(spark, "before", lambda: _before(
        written(_parents(owned).join(lengths, [*CONV, "branch"]), "lengths")))
    placed = spread_join(owned, first, [*CONV, "branch"], "n", ["pos"]).select(
        *CONV, "pos", "reply_to", (F.col("before") + F.col("pos") - F.col("branch") + 1).alias("place"))
    start, middle, end = TEMPLATE
    return parsed.join(placed, [*CONV, "pos"]).select(
        F.when(~F.col("nul"), F.col("conv")).alias("conv_id"), "turn", "pos", "place", "reply_to", "role",
        F.col("own").alias("text"), F.size("quotes").cast("long").alias("n_quotes"),
        F.concat(F.lit(start), "role", F.lit(middle), "own", F.lit(end)).alias("rendered"))


def digest(messages: DataFrame) -> DataFrame:
    return conversations(messages)
