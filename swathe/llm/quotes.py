"""Conversations in reply order, without quotes.

Lines that begin with quote marks are parsed into passages of one nesting
level. Normalised passages are hashed and joined to the earliest message of the same
conversation that holds them as a whole, a paragraph or a line. A message
replies to the latest message that its outermost quotes link to, otherwise to
the message before it. Replies make a tree, which is read depth first:
after a message comes the next message of its own run, then the
replies that branched off, by turn.

The order is found on runs of unbranched turns: their places follow from the
list ranking of an Euler tour, by pointer doubling, and a run's messages from
their rank within it. A conversation of any length is never gathered in one row,
and windows run over blocks of turns.

Column expressions only; no Python runs on the executors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import cut

MARKS = "^(?:[ \\t]{0,3}>)+[ \\t]?"
#: Shorter lines of a longer passage count only where neither it nor a longer line is found.
SHORTEST = 8
BLOCK = 256
c = F.col


def parsed(messages: DataFrame) -> DataFrame:
    """``messages`` with ``lines`` (level, content) taken apart: ``body``, the text without quotes, and ``passages`` (level, lines)."""
    level = lambda x: F.char_length(F.regexp_replace(F.regexp_extract(x, MARKS, 0), "[^>]", ""))
    lines = F.transform(F.split(F.coalesce("text", F.lit("")), "\\r?\\n", -1), lambda x: F.struct(level(x).alias("level"), F.regexp_replace(x, MARKS, "").alias("content")))
    # A line that only announces a quote goes with it. One-element arrays bind what lambdas use again and again.
    said = "(x, i) -> x.level = 0 AND NOT (x.content RLIKE '(?i)^\\\\s*(on\\\\b.*\\\\bwrote|.{1,80} (wrote|writes)):\\\\s*$' AND coalesce(get(l, i + 1).level, 0) > 0)"
    heads = "filter(transform(l, (x, i) -> CASE WHEN i = 0 OR get(l, i - 1).level <> x.level THEN i END), i -> i IS NOT NULL)"
    cutting = "filter(transform(h, (s, j) -> struct(l[s].level AS level, transform(slice(l, s + 1, coalesce(get(h, j + 1), size(l)) - s), x -> x.content) AS lines)), p -> p.level > 0)"
    taken = f"transform(array(__lines), l -> struct(exists(l, x -> x.level > 0) AS quotes, array_join(transform(filter(l, {said}), x -> x.content), '\\n') AS body, transform(array({heads}), h -> {cutting})[0] AS passages))[0]"
    rows = messages.withColumn("__lines", lines).withColumn("__taken", F.expr(taken))
    body = F.when(c("__taken.quotes"), F.regexp_replace("__taken.body", "^\\s+|\\s+$", "")).otherwise(F.coalesce("text", F.lit("")))
    return rows.withColumn("body", body).withColumn("passages", c("__taken.passages")).drop("__lines", "__taken")


def _normal(x):
    return F.lower(F.trim(F.regexp_replace(x, "\\s+", " ")))


def _digests(texts):
    """Digests of the normalised texts that aren't blank."""
    return F.array_distinct(F.transform(F.filter(F.transform(texts, _normal), lambda x: x != ""), lambda x: F.md5(x.cast("binary"))))


def links(messages: DataFrame) -> DataFrame:
    """Quoted passages (conv, turn, level, passage, outermost: no passage of the message has a lower level) with ``origin``, the turn of the
    earliest message that holds them; only those that have one.

    A passage that isn't found whole takes the latest origin among its lines, the longer ones first.
    """
    rows = parsed(messages.select("conv", "turn", "text"))
    quoting = rows.where("size(passages) > 0").select("conv", "turn", F.array_min("passages.level").alias("least"), F.posexplode("passages").alias("passage", "p"))
    long = F.filter(c("p.lines"), lambda x: F.char_length(_normal(x)) >= SHORTEST)
    short = F.filter(c("p.lines"), lambda x: F.char_length(_normal(x)) < SHORTEST)
    keys = F.concat(
        F.transform(_digests(F.array(F.array_join("p.lines", "\n"))), lambda x: F.struct(F.lit(2).alias("whole"), x.alias("digest"))),
        F.transform(_digests(long), lambda x: F.struct(F.lit(1).alias("whole"), x.alias("digest"))),
        F.transform(_digests(short), lambda x: F.struct(F.lit(0).alias("whole"), x.alias("digest"))),
    )
    wanted = quoting.select("conv", "turn", "passage", "p.level", (c("p.level") == c("least")).alias("outermost"), F.explode(keys).alias("k")).select("conv", "turn", "passage", "level", "outermost", "k.*")
    units = F.concat(F.array("body"), F.split("body", "\\n\\s*\\n"), F.split("body", "\\n"))
    talks = rows.select("conv", "turn", "body").join(quoting.select("conv").distinct(), "conv", "left_semi")
    origins = talks.select("conv", "turn", F.explode(_digests(units)).alias("digest")).groupBy("conv", "digest").agg(F.min("turn").alias("origin"))
    met = wanted.join(origins, ["conv", "digest"]).where("origin < turn")
    return met.groupBy("conv", "turn", "level", "passage").agg(F.bool_or("outermost").alias("outermost"), F.max(F.struct("whole", "origin")).alias("m")).select("conv", "turn", "level", "passage", "outermost", c("m.origin").alias("origin"))


def _carried(nodes: DataFrame, value, fold, name: str) -> DataFrame:
    """``nodes`` (conv, turn) with ``name``: ``fold`` of ``value`` over the rows up to each row, in blocks of turns."""
    at = nodes.withColumn("__block", F.floor(c("turn") / BLOCK)).withColumn("__value", value)
    inner = Window.partitionBy("conv", "__block").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    blocks = at.groupBy("conv", "__block").agg(fold("__value").alias("__sum"))
    outer = Window.partitionBy("conv").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("conv", "__block", fold("__sum").over(outer).alias("__before"))
    own = at.withColumn("__own", fold("__value").over(inner)).join(blocks, ["conv", "__block"])
    both = F.coalesce(c("__own") + c("__before"), "__own", "__before") if fold is F.sum else F.greatest("__own", "__before")
    return own.withColumn(name, both).drop("__block", "__value", "__own", "__before")


def _previous(nodes: DataFrame) -> DataFrame:
    """``nodes`` with ``previous``: the turn before in the conversation, null for the first."""
    at = nodes.withColumn("__block", F.floor(c("turn") / BLOCK))
    blocks = at.groupBy("conv", "__block").agg(F.max("turn").alias("__last"))
    blocks = blocks.select("conv", "__block", F.lag("__last").over(Window.partitionBy("conv").orderBy("__block")).alias("__before"))
    inner = F.lag("turn").over(Window.partitionBy("conv", "__block").orderBy("turn"))
    return at.withColumn("__own", inner).join(blocks, ["conv", "__block"]).select(*nodes.columns, F.coalesce("__own", "__before").alias("previous"))


def _run_starts(runs: DataFrame) -> DataFrame:
    """(conv, head, before) of runs (conv, head, size, parent: head of the run it hangs on or null, hook: turn it hangs on): how many messages come before the run.

    Rounds are logarithmic in the number of runs of the longest conversation.
    """
    siblings = Window.partitionBy("conv", "parent").orderBy(F.desc("hook"), "head")
    told = runs.withColumn("sibling", F.lead("head").over(siblings))
    eldest = runs.where("parent is not null").groupBy("conv", c("parent").alias("head")).agg(F.max(F.struct("hook", -c("head"))).alias("e")).select("conv", "head", (-c("e.col2")).alias("child"))
    told = told.join(eldest, ["conv", "head"], "left")
    place = lambda head, leaving: F.struct(head.cast("long").alias("head"), F.lit(leaving).alias("leaving"))
    enter = told.select("conv", place(c("head"), False).alias("at"), F.when(c("child").isNotNull(), place(c("child"), False)).otherwise(place(c("head"), True)).alias("to"), c("size").alias("weight"))
    after = F.when(c("parent").isNull(), F.lit(None)).when(c("sibling").isNotNull(), place(c("sibling"), False)).otherwise(place(c("parent"), True))
    leave = told.select("conv", place(c("head"), True).alias("at"), after.alias("to"), F.lit(0).cast("long").alias("weight"))
    tour = cut(enter.unionByName(leave), "tour")
    while not tour.where("to is not null").isEmpty():
        ahead = tour.select("conv", c("at").alias("to"), c("to").alias("next"), c("weight").alias("more"))
        tour = cut(tour.join(ahead, ["conv", "to"], "left").select("conv", "at", c("next").alias("to"), (c("weight") + F.coalesce("more", F.lit(0))).alias("weight")), "tour")
    whole = runs.groupBy("conv").agg(F.sum("size").alias("whole"))
    return tour.where("not at.leaving").join(whole, "conv").select("conv", c("at.head").alias("head"), (c("whole") - c("weight")).alias("before"))


def threads(messages: DataFrame) -> DataFrame:
    """One row per row of ``messages`` (conv_id, turn, role, text): the message without quotes, and its place in reply order.

    Returns conv_id, turn, role, ``position`` (from 0 within the conversation),
    ``reply_to`` (turn, null for the first), ``quoted`` and ``linked`` (numbers of
    quoted passages, and of those with an origin), ``body`` and ``formatted``
    (role and body in chat markup). Rows that share conv_id and turn are one place
    in the order: they have equal positions, and a link to it names their
    turn. A quote of a later message, or of none, links to nothing. Rows without conv_id or turn have
    neither position nor reply. Null texts are empty.
    """
    rows = messages.select(c("conv_id").cast("string").alias("conv"), c("turn").cast("long").alias("turn"), "conv_id", "role", "text")
    ok = rows.where("conv is not null and turn is not null").select("conv", "turn", "text")
    found = cut(links(ok), "links")
    nodes = _previous(ok.select("conv", "turn").distinct())
    explicit = found.where("outermost").groupBy("conv", "turn").agg(F.max("origin").alias("origin"))
    linked = found.groupBy("conv", "turn").agg(F.count(F.lit(1)).alias("linked"))
    nodes = nodes.join(explicit, ["conv", "turn"], "left").join(linked, ["conv", "turn"], "left")
    nodes = nodes.withColumn("reply_to", F.coalesce("origin", "previous"))
    opens = F.when(c("previous").isNull() | (c("reply_to") != c("previous")), c("turn"))
    nodes = _carried(nodes, opens, F.max, "head")
    nodes = cut(_carried(nodes, F.lit(1).cast("long"), F.sum, "nth"), "nodes")  # nth by turn, from 1
    first = nodes.where("turn = head").select("conv", "head", "reply_to", c("nth").alias("first"))
    # Of a run's messages only the head's own rows say where it hangs.
    hooks = first.join(nodes.select("conv", c("turn").alias("reply_to"), c("head").alias("parent")), ["conv", "reply_to"], "left")
    sizes = nodes.groupBy("conv", "head").agg(F.count(F.lit(1)).alias("size"))
    runs = hooks.join(sizes, ["conv", "head"]).select("conv", "head", "size", "parent", c("reply_to").alias("hook"))
    branched = runs.where("parent is not null").select("conv").distinct()
    starts = _run_starts(runs.join(branched, "conv", "left_semi"))
    placed = nodes.join(first.select("conv", "head", "first"), ["conv", "head"]).join(starts, ["conv", "head"], "left")
    position = F.coalesce("before", F.lit(0)) + c("nth") - F.when(c("before").isNull(), 1).otherwise(c("first"))
    placed = placed.select("conv", "turn", position.cast("long").alias("position"), "reply_to", F.coalesce("linked", F.lit(0)).cast("long").alias("linked"))
    plain = parsed(rows).join(placed, ["conv", "turn"], "left")
    formatted = F.concat(F.lit("<|"), F.coalesce("role", F.lit("")), F.lit("|>\n"), c("body"))
    return plain.select("conv_id", "turn", "role", "position", "reply_to", F.size("passages").cast("long").alias("quoted"), F.coalesce("linked", F.lit(0)).cast("long").alias("linked"), "body", formatted.alias("formatted"))
