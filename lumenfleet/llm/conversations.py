"""Quotation linking for chat formatting, in DataFrame functions alone.

Quoted passages (runs of lines with one quote level) are normalised to words. They come from the earliest message of the conversation
that has these words in one piece from the start of a line or sentence to the end of one; else, from the earliest that has them in
one piece anywhere; else, from the earliest that has the passage's lines and sentences in sequence, with gaps. Hashes of a passage's
first words find the places, hashes of all its words decide. A message replies to the source of its outermost quotes, or else to the
message before it, and a path of these replies orders the conversation without its quotes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import staged

#: Lengths in words of the heads that find the places where a passage may begin.
HEADS = (1, 2, 4, 8)
#: A unit of text ends with its line or its sentence.
UNIT_END = r"\n|[.!?\u2026]+[\"'\u201d\u2019\u00bb)\]]*(?:\s+|\z)|[\u3002\uff01\uff1f]+"
#: Turns to a bucket of the two-level running values; bounds what one task sorts of one conversation.
BUCKET = 1000


def plain_marks(text: Column) -> Column:
    """Quote marks at line starts without the blanks between them: "> > x" becomes ">> x"."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"(?m)(?:^|(?!^)\G)[ \t]*>", ">")


def without_quotes(text: Column) -> Column:
    """The text's own lines: quoted lines go, and a line that ends in a colon and names a writer just before them."""
    named = F.regexp_replace(text, r"(?mi)^[^\n>]*\b(?:wrote|writes|schrieb|escribió|a écrit)[ \t]*:[ \t]*\n(?=>)", "")
    return F.trim(F.regexp_replace(F.regexp_replace(named, r"(?m)^>[^\n]*(?:\n|\z)", ""), r"^\s+|\s+$", ""))


def normal(text: Column) -> Column:
    """Letters and digits in lower case, single blanks between."""
    return F.trim(F.regexp_replace(F.lower(F.regexp_replace(text, r"(?m)^>+", "")), r"[^\p{L}\p{N}]+", " "))


def key_of(text: Column) -> Column:
    return F.md5(normal(text))


def messages_of(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, marked, own, seq: rows of one turn are told apart by their content."""
    marked = rows.select("conv_id", "turn", "role", plain_marks(F.col("text")).alias("marked"))
    return marked.withColumn("own", without_quotes(F.col("marked")))


def quoted_passages(messages: DataFrame) -> DataFrame:
    """conv_id, turn, level, passage, key: runs of lines with the same number of marks; passages without a letter or digit are left out."""
    runs = F.regexp_extract_all("marked", F.lit(r"(?m)^(>+)(?!>)[^\n]*(?:\n\1(?!>)[^\n]*)*"), 0)
    rows = messages.filter(F.col("marked").rlike(r"(?m)^>")).select("conv_id", "turn", F.explode(runs).alias("passage"))
    rows = rows.withColumn("level", F.length(F.regexp_extract("passage", "^>+", 0))).withColumn("key", key_of(F.col("passage")))
    return rows.filter(normal(F.col("passage")) != "")


def units_of(text: Column) -> Column:
    """The text's lines and sentences, each an array of its normal words; those without words are left out."""
    units = F.transform(F.split(F.regexp_replace(text, r"(?m)^>+", ""), UNIT_END), normal)
    return F.transform(F.filter(units, lambda u: u != ""), lambda u: F.split(u, " "))


def keyed(words: Column) -> list[Column]:
    """key, m, k, head: hash and number of the words; number and hash of the first ones, by which places are found."""
    m = F.size(words)
    k = F.greatest(*[F.when(m >= k, F.lit(k)) for k in HEADS])
    return [F.md5(F.array_join(words, " ")).alias("key"), m.alias("m"), k.alias("k"), F.xxhash64(F.slice(words, F.lit(1), k)).alias("head")]


def said_words(messages: DataFrame, quoting: DataFrame) -> DataFrame:
    """row, conv_id, turn, words, first: what each message of the quoting conversations says itself; first tells where a unit begins."""
    rows = messages.join(quoting.select("conv_id").distinct(), "conv_id", "left_semi").select("conv_id", "turn", units_of(F.col("own")).alias("units"))
    first = F.flatten(F.transform("units", lambda u: F.transform(u, lambda _, i: i == 0)))
    rows = rows.select("conv_id", "turn", F.flatten("units").alias("words"), first.alias("first")).filter("size(words) > 0")
    return staged(rows.withColumn("row", F.monotonically_increasing_id()), "said")


def places(said: DataFrame, wanted: DataFrame) -> DataFrame:
    """row, conv_id, turn, key, at, m, aligned: every place where the words of a wanted key (conv_id, key, m, k, head) stand.

    Heads are joined to lengths, not to keys: many passages with one beginning make a place only once for each length.
    """
    head = lambda at, k: F.struct(at.alias("at"), F.lit(k).alias("k"), F.when(at + k <= F.size("words"), F.xxhash64(F.slice("words", at + 1, F.lit(k)))).alias("head"))
    heads = F.flatten(F.transform(F.sequence(F.lit(0), F.size("words") - 1), lambda at: F.array(*[head(at, k) for k in HEADS])))
    heads = said.select("row", "conv_id", F.explode(heads).alias("h")).select("row", "conv_id", "h.*").filter("head is not null")
    begun = heads.join(wanted.select("conv_id", "k", "head", "m").distinct(), ["conv_id", "k", "head"]).select("row", "at", "m")
    end = F.col("at") + F.col("m")
    found = begun.join(said, "row").filter(end <= F.size("words"))
    aligned = F.expr("first[at]") & F.coalesce(F.get("first", end), F.lit(True))
    found = found.select("row", "conv_id", "turn", F.md5(F.array_join(F.slice("words", F.col("at") + 1, F.col("m")), " ")).alias("key"), "at", "m", aligned.alias("aligned"))
    return staged(found.join(wanted.select("conv_id", "key").distinct(), ["conv_id", "key"], "left_semi"), "places")


def said_apart(said: DataFrame, passages: DataFrame) -> DataFrame:
    """conv_id, key, apart: the first turn that has all units of the passage in sequence, with gaps; passages of one unit are left out.

    Only messages that have the passage's longest unit are looked at.
    """
    whole = passages.dropDuplicates(["conv_id", "key"]).select("conv_id", F.col("key").alias("whole"), units_of(F.col("passage")).alias("units")).filter("size(units) > 1")
    parts = whole.select("conv_id", "whole", F.size("units").alias("n"), F.posexplode("units").alias("i", "unit"))
    parts = staged(parts.select("conv_id", "whole", "n", "i", *keyed(F.col("unit"))), "parts")
    at = places(said, parts)
    longest = parts.groupBy("conv_id", "whole").agg(F.max_by("key", F.struct("m", "i")).alias("key"))
    able = longest.join(at, ["conv_id", "key"]).select("conv_id", "whole", "row").distinct()
    each = able.join(parts.select("conv_id", "whole", "n", "i", "key"), ["conv_id", "whole"]).join(at, ["conv_id", "row", "key"])
    lined = each.groupBy("conv_id", "whole", "row", "turn", "n").agg(F.sort_array(F.collect_list(F.struct("i", "at", "m"))).alias("found"))
    start = F.struct(F.lit(0).alias("i"), F.lit(0).alias("end"))
    took = F.aggregate("found", start, lambda done, x: F.when((x["i"] == done["i"]) & (x["at"] >= done["end"]), F.struct((done["i"] + 1).alias("i"), (x["at"] + x["m"]).alias("end"))).otherwise(done))
    return lined.filter(took["i"] == F.col("n")).groupBy("conv_id", F.col("whole").alias("key")).agg(F.min("turn").alias("apart"))


def linked_quotes(messages: DataFrame) -> DataFrame:
    """Quoted passages with source, the earlier turn they come from (null: none found)."""
    passages = staged(quoted_passages(messages), "passages")
    said = said_words(messages, passages)
    at = places(said, passages.select("conv_id", *keyed(F.split(normal(F.col("passage")), " "))))
    sources = at.groupBy("conv_id", "key").agg(F.min(F.when(F.col("aligned"), F.col("turn"))).alias("unit"), F.min("turn").alias("within"))
    earlier = lambda name: F.when(F.col(name) < F.col("turn"), F.col(name))
    found = passages.join(sources, ["conv_id", "key"], "left").withColumn("source", F.coalesce(earlier("unit"), earlier("within"))).drop("unit", "within")
    found = staged(found, "found")
    apart = said_apart(said, found.filter("source is null"))
    return found.join(apart, ["conv_id", "key"], "left").withColumn("source", F.coalesce("source", earlier("apart"))).drop("apart")


def running_last(rows: DataFrame, value: str, out: str) -> DataFrame:
    """The last value that isn't null up to and including each turn, by conversation: within buckets of turns, and over the buckets."""
    rows = rows.withColumn("bucket", F.floor(F.col("turn") / BUCKET))
    own = Window.partitionBy("conv_id", "bucket").orderBy("turn").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    over = Window.partitionBy("conv_id").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    ends = rows.groupBy("conv_id", "bucket").agg(F.max_by(value, F.when(F.col(value).isNotNull(), F.col("turn"))).alias("end"))
    before = ends.select("conv_id", "bucket", F.last("end", ignorenulls=True).over(over).alias("before"))
    rows = rows.withColumn(out, F.last(value, ignorenulls=True).over(own))
    return rows.join(before, ["conv_id", "bucket"], "left").withColumn(out, F.coalesce(out, "before")).drop("before", "bucket")


def reply_ordered(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text (without quotes), n_quotes, n_linked, reply_to, jump, path, in the order of replies.

    reply_to is the source of the level-1 quotes (the latest, if several), or the turn before; null for a conversation's first turn. path
    orders a conversation: the messages of a run of replies by turn, then what answers its later messages before what answers
    its earlier ones; jump is the turn where the run begins. Null texts read as empty; rows with a null conv_id or turn stand
    alone, with null reply_to and the path "". Rows with the same turn share quotes and replies. Other columns are ignored.
    """
    known = rows.filter("conv_id is not null and turn is not null")
    messages = staged(messages_of(known), "messages")
    quotes = staged(linked_quotes(messages), "quotes")
    per = quotes.groupBy("conv_id", "turn").agg(F.count(F.lit(1)).alias("n_quotes"), F.count("source").alias("n_linked"), F.max(F.when(F.col("level") == 1, F.col("source"))).alias("quoted"))
    turns = messages.select("conv_id", "turn").distinct().join(per, ["conv_id", "turn"], "left")
    # The turn before, in two levels as running_last: shifted by one.
    turns = turns.withColumn("bucket", F.floor(F.col("turn") / BUCKET))
    own = Window.partitionBy("conv_id", "bucket").orderBy("turn")
    over = Window.partitionBy("conv_id").orderBy("bucket")
    last = turns.groupBy("conv_id", "bucket").agg(F.max("turn").alias("end")).select("conv_id", "bucket", F.lag("end").over(over).alias("before"))
    turns = turns.withColumn("previous", F.lag("turn").over(own)).join(last, ["conv_id", "bucket"], "left")
    turns = turns.withColumn("previous", F.coalesce("previous", "before")).drop("before", "bucket")
    turns = turns.withColumn("reply_to", F.coalesce("quoted", "previous"))
    turns = turns.withColumn("start", F.when(F.col("previous").isNull() | (F.col("reply_to") != F.col("previous")), F.col("turn")))
    turns = staged(running_last(turns, "start", "jump"), "turns")
    # Runs of replies: their paths follow from the run that holds the turn they answer, level by level.
    runs = turns.filter("start is not null").select("conv_id", F.col("turn").alias("jump"), F.when(F.col("previous").isNotNull(), F.col("reply_to")).alias("answers"))
    holds = turns.select("conv_id", F.col("turn").alias("answers"), F.col("jump").alias("parent"))
    runs = staged(runs.join(holds, ["conv_id", "answers"], "left").select("conv_id", "jump", "answers", "parent"), "runs")
    step = F.concat(F.lit("/"), F.format_string("%019d", F.lit(10**18) - F.col("answers")), F.lit("."), F.format_string("%019d", F.col("jump")))
    level = staged(runs.filter("answers is null").select("conv_id", "jump", F.lit("").alias("path")), "paths")
    paths = level
    while True:
        above = level.select("conv_id", F.col("jump").alias("parent"), F.col("path").alias("above"))
        level = staged(runs.join(above, ["conv_id", "parent"]).select("conv_id", "jump", F.concat("above", step).alias("path")), "paths")
        if level.isEmpty():
            break
        paths = paths.unionByName(level)
    placed = turns.join(paths, ["conv_id", "jump"]).select("conv_id", "turn", "reply_to", "jump", "path", F.coalesce("n_quotes", F.lit(0)).alias("n_quotes"), F.coalesce("n_linked", F.lit(0)).alias("n_linked"))
    full = messages.select("conv_id", "turn", "role", F.col("own").alias("text")).join(placed, ["conv_id", "turn"])
    alone = messages_of(rows.filter("conv_id is null or turn is null")).select("conv_id", "turn", "role", F.col("own").alias("text"), F.lit(None).cast("long").alias("reply_to"), F.col("turn").alias("jump"), F.lit("").alias("path"), F.lit(0).cast("long").alias("n_quotes"), F.lit(0).cast("long").alias("n_linked"))
    columns = ["conv_id", "turn", "role", "text", "n_quotes", "n_linked", "reply_to", "jump", "path"]
    return full.select(columns).unionByName(alone.select(columns)).orderBy("conv_id", "path", "turn")
