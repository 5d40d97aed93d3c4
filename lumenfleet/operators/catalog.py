"""File catalogues: natural order, numbered stacks, name filters, format candidates and the memory of formats."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.semantics import c
from .ranking import placed

#: Full-width digits read as ASCII digits.
WIDE_DIGITS, DIGITS = "０１２３４５６７８９", "0123456789"


def natural_key(name: Column) -> Column:
    """A sort key: text in upper case, digit runs by value (their length before them)."""
    parts = F.regexp_extract_all(F.upper(F.translate(name, WIDE_DIGITS, DIGITS)), F.lit("[0-9]+|[^0-9]+"), 0)
    bare = lambda p: F.regexp_replace(p, "^0+(?=[0-9])", "")
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike("^[0-9]"), F.concat(F.lit("0"), F.format_string("%05d", F.length(bare(p))), bare(p))).otherwise(p)), "\x01")


def numbering(name: Column) -> tuple[Column, Column, Column]:
    """(prefix, number, suffix) of a file name by its last run of digits; number null without one."""
    plain = F.translate(name, WIDE_DIGITS, DIGITS)
    part = lambda i: F.regexp_extract(plain, r"^(.*?)([0-9]+)([^0-9]*)$", i)
    return part(1), F.when(part(2) != "", part(2).try_cast("long")), part(3)


def numbered_stacks(files: DataFrame) -> DataFrame:
    """files (folder, name, ext, length) with prefix, suffix, number, index (from 0) and size of their stack; lone files have size 1."""
    prefix, number, suffix = numbering(F.regexp_replace("name", r"\.[^.]*$", ""))
    rows = files.withColumn("prefix", F.lower(prefix)).withColumn("number", number).withColumn("suffix", F.lower(suffix))
    rows = rows.withColumn("alone", F.when(c("number").isNull(), c("name")))  # names without a number, or with one beyond 64 bits
    key = ["folder", "ext", "prefix", "suffix", "alone"]
    return placed(rows, key, ["number", "name"], size="stack_size").withColumn("index", c("index").cast("int")).drop("alone")


def same_size_stacks(files: DataFrame) -> DataFrame:
    return files.groupBy("folder", "ext", "length").agg(F.count(F.lit(1)).alias("files"), F.min(F.struct(natural_key(c("name")).alias("k"), c("name").alias("name")))["name"].alias("first_name"))


def name_filter(terms: str) -> Column:
    """A condition on name: any of the terms (extension ".raw", wildcard "dark*", part of the name), or all as /regex/; case doesn't count.

    White space of any kind, semicolons and commas, full-width ones too, stand between terms. "//" and a pattern that can't be read match
    every name; a lone "." is a part of the name; an extension is compared as a whole.
    """
    text = terms.strip()
    if len(text) >= 2 and text[0] == text[-1] == "/":
        pattern = text[1:-1]
        return F.col("name").rlike("(?i)" + pattern) if pattern and readable(pattern) else F.lit(True)
    parts = re.split(r"[\s;,\uFF1B\uFF0C]+", text)
    out = None
    for t in filter(None, parts):
        if "*" in t or "?" in t:
            one = F.col("name").rlike("(?is)^" + "".join(".*" if ch == "*" else "." if ch == "?" else re.escape(ch) for ch in t) + "$")
        elif t.startswith(".") and len(t) > 1:
            one = F.lower(F.regexp_extract("name", r"\.[^.]*$", 0)) == t.lower()
        else:
            one = F.lower("name").contains(t.lower())
        out = one if out is None else out | one
    return F.lit(True) if out is None else out


def readable(pattern: str) -> bool:
    """Whether Spark's pattern engine can read it."""
    from py4j.protocol import Py4JJavaError
    from pyspark.sql import SparkSession

    try:
        SparkSession.getActiveSession()._jvm.java.util.regex.Pattern.compile(pattern)
    except Py4JJavaError:
        return False
    return True


def name_dimensions(name: Column) -> Column:
    """"1920x1080" pairs of 2 to 5 digits that don't stand inside longer digit runs, as [width, height] arrays, each once."""
    plain = F.translate(name, WIDE_DIGITS, DIGITS)
    found = F.regexp_extract_all(plain, F.lit(r"(?<![0-9])[0-9]{2,5}\s*[xX×]\s*[0-9]{2,5}(?![0-9])"), 0)
    return F.array_distinct(F.transform(found, lambda m: F.transform(F.split(F.lower(F.translate(m, "×", "x")), r"\s*x\s*"), lambda d: d.cast("int"))))


def format_candidates(files: DataFrame, dimensions: DataFrame, header: int = 0, most: int = 10) -> DataFrame:
    """Formats that fit a file exactly: header + width * height * bytes * frames = length. files: path, length, name; dimensions: width, height.

    The theta join is an equi join on the pixel count for each choice of bytes and frames. Dimensions in the name come first.
    """
    choices = F.explode(F.array(*[F.struct(F.lit(b).alias("bytes"), F.lit(n).alias("frames")) for b in (1, 2) for n in (1, 2, 4)])).alias("o")
    opt = files.select("path", "name", "length", choices).select("*", "o.*").drop("o")
    opt = opt.filter((c("length") - header) % (c("bytes") * c("frames")) == 0).withColumn("pixels", F.expr(f"(length - {header}) div (bytes * frames)"))
    listed = opt.join(dimensions.withColumn("pixels", c("width").cast("long") * c("height")), "pixels").select("path", "width", "height", "bytes", "frames", F.lit(2).alias("priority"))
    named = opt.withColumn("d", F.explode(name_dimensions(c("name")))).filter(F.get("d", F.lit(0)).cast("long") * F.get("d", F.lit(1)) == c("pixels"))
    named = named.select("path", F.get("d", F.lit(0)).alias("width"), F.get("d", F.lit(1)).alias("height"), "bytes", "frames", F.lit(1).alias("priority"))
    once = named.unionByName(listed).groupBy("path", "width", "height", "bytes", "frames").agg(F.min("priority").alias("priority"))
    rank = Window.partitionBy("path").orderBy("priority", "frames", "bytes", F.desc("width"), F.desc("height"))
    return once.withColumn("rank", F.row_number().over(rank)).filter(c("rank") <= most)


def history_recency(entries: DataFrame, most: int = 200) -> DataFrame:
    """Format memory: the newest entry for each (length, ext, format), the newest first, at most so many in all."""
    newest = entries.filter("length is not null and ext is not null").groupBy("length", "ext", "format").agg(F.max("used").alias("used"))
    return newest.orderBy(F.desc("used"), "length", "ext", "format").limit(most)


def validation_reasons(width, height, depth, length) -> Column:
    """Every rule that a frame descriptor breaks."""
    needed = F.try_multiply(F.try_multiply(c(width).cast("long"), c(height).cast("long")), F.when(c(depth) <= 8, 1).otherwise(2).cast("long"))
    rules = [("width", c(width) <= 0), ("height", c(height) <= 0), ("depth", ~c(depth).isin(8, 10, 12, 14, 16)), ("short", needed.isNull() | (needed > c(length)))]
    return F.array_compact(F.array(*[F.when(bad, F.lit(name)) for name, bad in rules]))
