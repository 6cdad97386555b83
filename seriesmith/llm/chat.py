"""Chat formatting by quotation linking.

A message's lines have a quote level: the number of ``>`` in front. A run of lines of one
level is a passage. Passages are normalised (lower case, single spaces for any white space,
so that wrapping does not matter), hashed and joined, within their conversation, to the
unquoted text of earlier messages in three ways: the whole passage, each of its lines that
is not empty (in any script and of any length), and each run of ``WINDOW`` consecutive
words. Each hash finds the last earlier message that holds it; a passage links to the
message with the most evidence: a whole passage first, then by the characters of the longest
line found or of the words found, whichever is more; of those alike the latest. A level-1
passage's message is the parent. Following parents gives threads. The result holds every
message without its quotes, in the order of conversation, thread and turn; a thread is named
by its first message's turn.

The join is an as-of lookup of distinct turns, in buckets of ``BUCKET`` turns with what the
buckets before hold, so a line said and quoted any number of times in one conversation is
dealt to many tasks, and a passage quoted n times and said m times costs n + m rows. Words
are looked up only in conversations that quote. No conversation is gathered into one row or
task: threads are found by pointer jumping over messages, and the order is a range sort.

Defined results: null text counts as empty; messages that are equal in conversation, turn,
role and text are one; messages of a null conversation or turn are never linked and keep
their text without quotes; of messages of one turn that say the same, the one with the
greatest hash of role and text is the original; a quote that matches nothing, or only later
messages, is removed and links nothing, and so does a quote of less than a line and of fewer
words than ``WINDOW``; texts of any length are parsed whole; an empty table gives an empty
result; other columns are dropped.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import NULL_ID, spread_join, stage, text_or_empty

QUOTE = r"^((?:[ \t]*>)+)"
QUOTING = r"(?:^|\n)[ \t]*>"
BLANK = r"[ \t\n\x0B\f\r]"
ATTRIBUTION = rf"(?i)^{BLANK}*on [^\n]+ wrote:{BLANK}*\z"
WINDOW = 5
#: Evidence of a whole passage, beyond that of any line or words.
WHOLE = 2**31 - 1
BUCKET = 1024
KEYS = ["conv_id", "turn", "role", "mid"]


def normalised(text: Column) -> Column:
    return F.lower(F.btrim(F.regexp_replace(text, f"{BLANK}+", " "), F.lit(" ")))


def message_number(role: Column, text: Column) -> Column:
    """60 bits that tell messages of one turn apart."""
    digest = F.md5(F.concat(F.coalesce(role, F.lit("\x00")), F.lit("\x1f"), text).cast("binary"))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def parsed_lines(messages: DataFrame) -> DataFrame:
    """KEYS, pos, level, body, run: a line of each message; run numbers the passages of a message."""
    cut = messages.select(*KEYS, F.posexplode(F.split("text", "\n", -1)).alias("pos", "raw"))
    marks = F.regexp_extract("raw", QUOTE, 1)
    level = F.length(F.regexp_replace(marks, "[^>]", ""))
    body = F.when(level > 0, F.regexp_replace("raw", QUOTE + r"[ \t]?", "")).otherwise(F.col("raw"))
    lines = cut.withColumn("level", level).withColumn("body", body)
    w = Window.partitionBy("conv_id", "turn", "mid").orderBy("pos")  # the lines of one message
    lines = lines.withColumn("next", F.lead("level").over(w)).where(~F.coalesce(F.col("raw").rlike(ATTRIBUTION) & (F.col("next") > F.col("level")), F.lit(False)))
    new = F.coalesce((F.col("level") != F.lag("level").over(w)).cast("int"), F.lit(0))
    return lines.withColumn("new", new).withColumn("run", F.sum("new").over(w)).drop("new", "next", "raw")


def keys_of(df: DataFrame, text: str) -> DataFrame:
    """df with its passages' lookups instead of their text: kind (0 whole, 1 line, 2 words), hash, weight (evidence)."""
    whole = normalised(F.col(text))
    lines = F.filter(F.transform(F.split(text, "\n", -1), normalised), lambda x: x != "")
    words = F.split(whole, " ")
    runs = F.when(F.size(words) >= WINDOW, F.transform(F.sequence(F.lit(1), F.size(words) - (WINDOW - 1)), lambda i: F.slice(words, i, WINDOW))).otherwise(F.array().cast("array<array<string>>"))
    key = lambda kind, x, weight: F.struct(F.lit(kind).alias("kind"), F.xxhash64(F.lit(kind // 2), x).alias("hash"), weight.cast("long").alias("weight"))
    every = F.concat(
        F.when(whole != "", F.array(key(0, whole, F.lit(WHOLE)))).otherwise(F.array().cast("array<struct<kind:int,hash:bigint,weight:bigint>>")),
        F.transform(lines, lambda x: key(1, x, F.length(x))),
        F.transform(runs, lambda x: key(2, F.array_join(x, " "), F.length(x[0]) + 1)),
    )
    return df.withColumn("key", F.explode(every)).select(*[c for c in df.columns if c != text], "key.*")


def last_before(asked: DataFrame, said: DataFrame) -> DataFrame:
    """asked (conv_id, hash, turn) and said (conv_id, hash, turn, mid) -> conv_id, hash, turn, of: the last message before the turn that says it."""
    key = ["conv_id", "hash"]
    said = said.join(asked.select(*key).distinct(), key, "left_semi").groupBy(*key, "turn").agg(F.max(F.struct("turn", "mid")).alias("of"))
    none = F.lit(None).cast("struct<turn:bigint,mid:bigint>")
    events = said.unionByName(asked.select(*key, "turn").distinct().withColumn("of", none)).withColumn("bucket", F.floor(F.col("turn") / BUCKET))
    events = stage(events, "chat-events")
    of_bucket = events.groupBy(*key, "bucket").agg(F.max("of").alias("of"))
    earlier = F.max("of").over(Window.partitionBy(*key).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    inside = Window.partitionBy(*key, "bucket").orderBy("turn", F.col("of").isNotNull()).rowsBetween(Window.unboundedPreceding, -1)
    found = events.withColumn("last", F.last("of", ignorenulls=True).over(inside)).where("of IS NULL").drop("of")
    found = found.join(of_bucket.withColumn("earlier", earlier).drop("of"), [*key, "bucket"])
    return found.select(*key, "turn", F.coalesce("last", "earlier").alias("of")).where("of IS NOT NULL")


def link_quotes(messages: DataFrame) -> DataFrame:
    """messages (conv_id, turn, role, text) -> conv_id, turn, role, text, thread, parent_turn, depth, n_quotes, n_linked."""
    # Nulls are named by a number, so that such messages find their own parts; they are kept out of the linking.
    named = [F.coalesce(F.col(c).cast("long"), F.lit(NULL_ID)).alias(c) for c in ("conv_id", "turn")]
    own = messages.select(*named, "role", text_or_empty().alias("text"))
    linkable = (F.col("conv_id") != NULL_ID) & (F.col("turn") != NULL_ID)
    own = own.groupBy("conv_id", "turn", "role", "text").agg(F.count("*").alias("n")).drop("n").withColumn("mid", message_number(F.col("role"), F.col("text")))
    quoting = F.col("text").rlike(QUOTING)
    plain = own.where(~quoting)
    quoters = stage(parsed_lines(own.where(quoting)), "chat-lines")
    in_order = F.array_sort(F.collect_list(F.struct("pos", "body")))
    joined = F.array_join(F.transform(in_order, lambda x: x["body"]), "\n")
    passages = quoters.groupBy(*KEYS, "run", "level").agg(joined.alias("said"))
    unquoted = quoters.where("level = 0").groupBy(*KEYS).agg(joined.alias("said"))
    quotes = passages.where("level > 0").drop("role")
    asked = stage(keys_of(quotes.where(linkable), "said"), "chat-asked")
    # Originals: whole messages, passages and lines that are not quotes, in conversations that quote.
    originals = plain.withColumnRenamed("text", "said").unionByName(unquoted).unionByName(passages.where("level = 0").drop("run", "level")).drop("role")
    originals = originals.where(linkable).join(asked.select("conv_id").distinct(), "conv_id", "left_semi")
    found = last_before(asked, keys_of(originals, "said").select("conv_id", "hash", "turn", "mid").distinct())
    met = spread_join(asked, found, ["conv_id", "hash", "turn"], "chat-hot")
    quote = ["conv_id", "turn", "mid", "run", "level"]
    votes = met.groupBy(*quote, "of").agg(F.max(F.when(F.col("kind") < 2, F.col("weight"))).alias("one"), F.sum(F.when(F.col("kind") == 2, F.col("weight"))).alias("words"))
    evidence = F.greatest(F.coalesce("one", F.lit(0)), F.coalesce("words", F.lit(0)))
    order = F.struct(-F.col("evidence"), -F.col("of.turn"), "of.mid")
    best = votes.withColumn("evidence", evidence).groupBy(*quote).agg(F.min_by("of", order).alias("of"), F.max("evidence").alias("evidence"))
    same = ["conv_id", "turn", "mid"]
    counts = best.groupBy(*same).agg(F.count("*").alias("n_linked"))
    parents = best.where("level = 1").groupBy(*same).agg(F.min_by("of", order).alias("of"))
    parents = stage(parents.select(*same, F.col("of.turn").alias("up_turn"), F.col("of.mid").alias("up_mid")), "chat-parents")
    roots = follow(parents)
    n_quotes = quotes.groupBy(*same).agg(F.count("*").alias("n_quotes"))
    clean = own.where(quoting).join(unquoted.drop("role"), same, "left").withColumn("text", F.coalesce("said", F.lit(""))).drop("said")
    told = plain.unionByName(clean)
    for part in (n_quotes, counts, parents.withColumnRenamed("up_turn", "parent_turn").drop("up_mid"), roots):
        told = told.join(part, same, "left")
    zero = F.lit(0).cast("long")
    told = told.withColumn("root_turn", F.coalesce("root_turn", "turn"))
    unnamed = {c: F.when(F.col(c) != NULL_ID, F.col(c)) for c in ("conv_id", "turn", "root_turn")}
    return told.withColumns(unnamed).select(
        "conv_id", "turn", "role", F.btrim("text", F.lit(" \t\r\n")).alias("text"), F.col("root_turn").alias("thread"), "parent_turn",
        F.coalesce("depth", zero).alias("depth"), F.coalesce("n_quotes", zero).alias("n_quotes"), F.coalesce("n_linked", zero).alias("n_linked"),
    )


def follow(parents: DataFrame) -> DataFrame:
    """conv_id, turn, mid, root_turn, depth of messages that have a parent, by pointer jumping; parents are earlier, so it ends."""
    at = parents.withColumn("depth", F.lit(1).cast("long"))
    for i in count():
        step = at.select("conv_id", F.col("turn").alias("up_turn"), F.col("mid").alias("up_mid"), F.col("up_turn").alias("next_turn"), F.col("up_mid").alias("next_mid"), F.col("depth").alias("more"))
        jumped = spread_join(at, step, ["conv_id", "up_turn", "up_mid"], f"chat-hot-{i}", "left")
        moved = stage(
            jumped.select(
                "conv_id", "turn", "mid", F.coalesce("next_turn", "up_turn").alias("up_turn"), F.coalesce("next_mid", "up_mid").alias("up_mid"),
                (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), F.col("next_turn").isNotNull().alias("moved"),
            ), f"chat-jump-{i}",
        )
        at = moved.drop("moved")
        if not moved.where("moved").limit(1).count():
            return at.select("conv_id", "turn", "mid", F.col("up_turn").alias("root_turn"), "depth")


def in_reply_order(linked: DataFrame) -> DataFrame:
    """Sorted by conversation, thread and turn over all partitions, with each message rendered as a chat turn."""
    keys = ["conv_id", "thread", "turn", "role", "text"]
    rendered = F.concat(F.lit("<|"), F.coalesce("role", F.lit("unknown")), F.lit("|>\n"), F.col("text"), F.lit("\n"))
    return linked.withColumn("rendered", rendered).repartitionByRange(*keys).sortWithinPartitions(*keys)


def format_chat(messages: DataFrame) -> DataFrame:
    return in_reply_order(link_quotes(messages))
