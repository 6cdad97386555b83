"""Near-duplicate lines by a deletion-neighbourhood join.

Lines are compared trimmed of spaces, tabs and carriage returns. A line goes if an earlier
line (in the order of document id and position) is equal to it, or, for lines of
``min_chars`` characters or more, differs from it by at most one inserted, deleted or
replaced character. The earliest stays; empty lines always stay. The edit bound is one,
since that keeps a group's variants in proportion to its characters.

Equal variants are joined as follows. Two lines within one edit share the variant that
leaves out the edited character: both leave it out at the same place (replacement), or one
line is the other's variant (insertion). All variants of a line would be as many as its
characters, so two exact steps keep them few:

* A line is cut into ``PARTS`` parts; one edit lies in one part, and the rest is equal. Keys
  of "all but one part" that two distinct lines share leave only lines that can have a
  partner, and only the part in which their edit must lie.
* Variants of that part are emitted as hashes. They are built from hashes of blocks of
  ``BLOCK`` characters before and after the edit, so a long line costs time in proportion
  to its length.

No text is shuffled with keys or variants: rows of two or three numbers are joined first,
and the texts of the few lines that can have a partner are fetched from their documents.
In a group of equal variants every line is paired with the earliest only, which decides
"an earlier one exists", so a group of n lines makes n pairs. Pairs are verified with the
edit distance of their texts. Everything is built of DataFrame functions.

Defined results: a null text stays null and has no lines; rows with the same id and text
are one occurrence (all stay alike); null ids sort first; ties of the id are ordered by
the text's hash; texts and lines of any length are compared whole; an empty table gives an
empty result; other columns are carried along whatever their names, but ``text``,
``n_lines`` and ``n_dropped`` are replaced.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import NULL_ID, from_row, in_row, joined, others, stage

PARTS = 3
BLOCK = 256
MIN_CHARS = 16
#: Bits of a key row's number that name the line; the others say which part is left out.
LINE_BITS = 61


def trimmed(raw: Column) -> Column:
    """The line without spaces, tabs and carriage returns around it; most have none, which costs less to see than to trim."""
    ends = [f(raw, F.lit(c)) for c in " \t\r" for f in (F.startswith, F.endswith)]
    return F.when(reduce(Column.__or__, ends), F.btrim(raw, F.lit(" \t\r"))).otherwise(raw)


def lines_of(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """id, tie, pos, line (trimmed, not empty), h1, h2."""
    own = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("id"), F.xxhash64("text").alias("tie"), F.col("text"))
    cut = own.select("id", "tie", F.posexplode(F.split("text", "\n", -1)).alias("pos", "raw"))
    lines = cut.select("id", "tie", "pos", trimmed(F.col("raw")).alias("line")).where("line <> ''")
    return lines.select("*", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"))


def bounds(q: Column) -> list[Column]:
    """Places at which a line of q characters is cut into parts."""
    return [F.floor(q * j / PARTS).cast("int") for j in range(PARTS + 1)]


def with_keys(lines: DataFrame, min_chars: int) -> DataFrame:
    """lines with ``keys``: hashes of all but one part, the line as the shorter of two (one for each part), then as the longer; null for short lines.

    Lengths, cuts and hashes of parts are columns of their own, so each is computed once. Parts
    are cut from UTF-32, where a character's place is known without a walk.
    """
    columns, n = lines.columns, F.col("n")
    ends = {f"{kind}{j}": x for kind, q in (("short", n), ("long", n - 1)) for j, x in enumerate(bounds(q))}
    wide = lines.withColumn("wide", F.encode("line", "UTF-32"))
    cut = wide.withColumn("n", (F.octet_length("wide") / 4).cast("int")).withColumns(ends)

    def part(kind: str, j: int, shift: int) -> Column:
        a, b = F.col(f"{kind}{j}"), F.col(f"{kind}{j + 1}")
        return F.xxhash64(F.substring("wide", (a + shift) * 4 + 1, (b - a) * 4))

    # Behind the edit, the longer line's characters are one further.
    parts = {f"p{j}": part("short", j, 0) for j in range(PARTS)}
    parts |= {f"l{j}": part("long", j, 0) for j in range(PARTS - 1)} | {f"r{j}": part("long", j, 1) for j in range(1, PARTS)}
    short = [F.xxhash64(n, F.lit(j), *[f"p{i}" for i in range(PARTS) if i != j]) for j in range(PARTS)]
    long = [F.xxhash64(n - 1, F.lit(j), *[f"l{i}" for i in range(j)], *[f"r{i}" for i in range(j + 1, PARTS)]) for j in range(PARTS)]
    return cut.withColumns(parts).select(*columns, F.when(n >= min_chars, F.array(*short, *long)).alias("keys"))


def spans(flags: Column, n: Column) -> Column:
    """Per part of a line of n characters the places at which its edit may lie; flags: bit j for part j as the shorter line, PARTS + j as the longer."""

    def hull(j: int) -> Column:
        short, long = bounds(n), bounds(n - 1)
        as_short, as_long = F.getbit(flags, F.lit(j)) == 1, F.getbit(flags, F.lit(PARTS + j)) == 1
        lo = F.least(F.when(as_short, short[j]), F.when(as_long, long[j]))
        hi = F.greatest(F.when(as_short, short[j + 1] - 1), F.when(as_long, long[j + 1]))
        return F.struct(lo.alias("lo"), hi.alias("hi"))

    return F.array(*[hull(j) for j in range(PARTS)])


def xor_all(hashes: Column) -> Column:
    return F.aggregate(hashes, F.lit(0).cast("long"), lambda a, x: a.bitwiseXOR(x))


def block_hashes(line: Column, last: Column, shift: int) -> Column:
    """Hash of each block of the line up to the block ``last``, the line taken from character ``shift`` on."""
    return F.transform(F.sequence(F.lit(0), last), lambda k: F.xxhash64(k, F.substring(line, k * BLOCK + 1 + shift, F.lit(BLOCK))))


def base_hash(line: Column) -> Column:
    """Hash of a text by its blocks; the empty block past the end, if any, is left out."""
    n = F.length(line)
    return F.xxhash64(n, xor_all(block_hashes(line, F.greatest(F.floor((n - 1) / BLOCK).cast("int"), F.lit(0)), 0)))


def variants(rows: DataFrame) -> DataFrame:
    """rows (h1, line, spans) -> h1, variant, place: the line without the character at place, for places in spans. A place may come twice."""
    n = F.length("line")
    blocks = F.floor((n - 2) / BLOCK).cast("int")  # the last block of a variant
    line = F.col("line")
    held = rows.where(n >= 2).select("h1", "line", "spans", n.alias("n"), blocks.alias("last"), block_hashes(line, blocks, 0).alias("before"), block_hashes(line, blocks, 1).alias("after"))
    each = held.withColumn("span", F.explode("spans")).where("span.hi >= span.lo")
    # One row for each block that a span touches.
    first = F.floor(F.col("span.lo") / BLOCK).cast("int")
    final = F.least(F.floor(F.col("span.hi") / BLOCK).cast("int"), F.col("last"))
    touched = each.withColumn("b", F.explode(F.sequence(F.least(first, F.col("last")), final)))
    lo = F.greatest(F.col("span.lo"), F.col("b") * BLOCK)
    # The place after a variant's last block belongs to that block.
    hi = F.least(F.col("span.hi"), F.col("n") - 1, F.when(F.col("b") == F.col("last"), F.col("n") - 1).otherwise(F.col("b") * BLOCK + BLOCK - 1))
    outside = xor_all(F.slice("before", F.lit(1), F.col("b"))).bitwiseXOR(xor_all(F.slice("after", F.col("b") + 2, F.greatest(F.col("last") - F.col("b"), F.lit(0)))))
    window = F.substring("line", F.col("b") * BLOCK + 1, F.lit(BLOCK + 1))
    ready = touched.select("h1", (F.col("n") - 1).alias("m"), "b", lo.alias("lo"), hi.alias("hi"), outside.alias("outside"), window.alias("w")).where("hi >= lo")
    cut = ready.withColumn("place", F.explode(F.sequence("lo", "hi")))
    inside = F.col("place") - F.col("b") * BLOCK
    text = F.concat(F.substring("w", F.lit(1), inside), F.substring("w", inside + 2, F.lit(BLOCK + 1)))
    variant = F.xxhash64("m", F.col("outside").bitwiseXOR(F.xxhash64("b", text)))
    return cut.select("h1", variant.alias("variant"), "place")


def distinct_lines(docs: DataFrame, min_chars: int = MIN_CHARS, id_col: str = "doc_id") -> DataFrame:
    """h1, h2, first (id, tie, pos of the first occurrence), n (occurrences), keys (null for short lines)."""
    keyed = with_keys(lines_of(docs, id_col).select("h1", "h2", F.struct("id", "tie", "pos").alias("at"), "line"), min_chars)
    return keyed.groupBy("h1", "h2").agg(F.min("at").alias("first"), F.count("*").alias("n"), F.any_value("keys").alias("keys"))


def able_lines(docs: DataFrame, distinct: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """h1, h2, first, flags, line of the distinct lines that share a key with another."""
    number, code = F.shiftrightunsigned("h1", 64 - LINE_BITS), F.col("part")
    # Rows as the shorter line are negative, so the least number of a key tells whether there is one.
    top = F.shiftleft(F.when(code < PARTS, code + 4).otherwise(code - PARTS).cast("long"), LINE_BITS)
    keyed = distinct.where("keys IS NOT NULL").select(number.alias("number"), F.posexplode("keys").alias("part", "key"))
    keyed = keyed.select("key", top.bitwiseOR(F.col("number")).alias("v"))
    shared = keyed.groupBy("key").agg(F.min("v").alias("lo"), F.max("v").alias("hi")).where("lo <> hi AND lo < 0").select("key")
    met = joined(keyed, stage(shared, "lines-shared"), ["key"], "left_semi")
    bit = F.when(F.col("v") < 0, F.shiftrightunsigned("v", LINE_BITS) - 4).otherwise(F.shiftrightunsigned("v", LINE_BITS) + PARTS)
    flags = F.bit_or(F.call_function("shiftleft", F.lit(1), bit.cast("int")))
    # Lines whose numbers clash only share their flags.
    able = met.groupBy(F.col("v").bitwiseAND(F.lit(2**LINE_BITS - 1)).alias("number")).agg(flags.alias("flags"))
    able = stage(able, "lines-numbers")
    held = joined(distinct.select(number.alias("number"), "h1", "h2", "first"), able, ["number"], "inner").drop("number")
    held = stage(held, "lines-held")
    # A document's able lines meet its text.
    asked = held.groupBy(F.col("first.id").alias("id"), F.col("first.tie").alias("tie")).agg(F.collect_list(F.struct("h1", "h2", "first", "flags")).alias("lines"))
    own = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("id"), F.xxhash64("text").alias("tie"), "text")
    found = joined(own, asked, ["id", "tie"], "inner", held).select(F.split("text", "\n", -1).alias("cut"), F.explode("lines").alias("l"))
    found = found.select("l.*", trimmed(F.element_at("cut", F.col("l.first.pos") + 1)).alias("line"))
    # Repeated rows of a document give its lines again.
    return found.groupBy("h1", "h2").agg(F.min("first").alias("first"), F.max("flags").alias("flags"), F.min("line").alias("line"))


def near_lines(docs: DataFrame, distinct: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """h1, h2 of the distinct lines for which an earlier line within one edit exists."""
    able = stage(able_lines(docs, distinct, id_col), "lines-able")
    left_out = variants(able.select("h1", "line", spans(F.col("flags"), F.length("line")).alias("spans")))
    whole = able.select("h1", base_hash(F.col("line")).alias("variant"), F.lit(-1).alias("place"))
    every = stage(left_out.unionByName(whole), "lines-variants")
    shared = every.groupBy("variant").agg(F.min("h1").alias("lo"), F.max("h1").alias("hi")).where("lo <> hi").select("variant")
    every = joined(every, stage(shared, "lines-shared-variants"), ["variant"], "left_semi")
    member = F.struct("first", "h1", "h2")
    every = stage(every.join(able.select("h1", member.alias("who")), "h1").select("variant", "place", "who"), "lines-members")
    left_out, whole = every.where("place >= 0"), every.where("place < 0").drop("place")
    # Replacement: the same variant at the same place.
    earliest = left_out.groupBy("variant", "place").agg(F.min("who").alias("to"))
    replaced = left_out.join(earliest, ["variant", "place"]).select("who", "to")
    # Insertion: the variant is another line.
    inserted = left_out.join(whole.withColumnRenamed("who", "to"), "variant").select("who", "to")
    of_whole = left_out.groupBy("variant").agg(F.min("who").alias("to"))
    deleted = whole.join(of_whole, "variant").select("who", "to")
    pairs = replaced.unionByName(inserted).unionByName(deleted).where("to.first < who.first")
    pairs = pairs.select("who.h1", "who.h2", F.col("to.h1").alias("g1"), F.col("to.h2").alias("g2")).distinct()
    texts = able.select("h1", "h2", "line")
    both = pairs.join(texts, ["h1", "h2"]).join(texts.toDF("g1", "g2", "other"), ["g1", "g2"])
    return both.where(F.levenshtein("line", "other", 1) >= 0).select("h1", "h2").distinct()


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, id_col: str = "doc_id") -> DataFrame:
    """docs with the lines that stay as ``text``, and ``n_lines`` and ``n_dropped``."""
    distinct = stage(distinct_lines(docs, min_chars, id_col), "lines-distinct")
    near = stage(near_lines(docs, distinct, id_col), "lines-near").withColumn("near", F.lit(True))
    doomed = joined(distinct.select("h1", "h2", "first", "n"), near, ["h1", "h2"], "left").where("near OR n > 1").select("h1", "h2", "first", "near")
    doomed = stage(doomed, "lines-doomed")
    lines = lines_of(docs, id_col).select("h1", "h2", F.struct("id", "tie", "pos").alias("at"))
    gone = joined(lines, doomed, ["h1", "h2"], "inner").where(F.col("near") | (F.col("at") > F.col("first")))
    gone = gone.groupBy("at.id", "at.tie").agg(F.collect_set("at.pos").alias("gone"))
    own = in_row(docs, id=F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)), tie=F.xxhash64("text"))
    cut = own.join(gone, ["id", "tie"], "left").select("row", "gone", F.split("row.text", "\n", -1).alias("cut"))
    stay = F.transform(F.array_except(F.sequence(F.lit(0), F.size("cut") - 1), F.col("gone")), lambda i: F.element_at(F.col("cut"), i + 1))
    text = F.when(F.col("gone").isNull(), F.col("row.text")).otherwise(F.array_join(stay, "\n"))
    n_lines = F.when(F.col("row.text").isNull(), 0).otherwise(F.size("cut")).cast("long")
    added = {"text": text, "n_lines": n_lines, "n_dropped": F.coalesce(F.size("gone"), F.lit(0)).cast("long")}
    done = cut.select("row", *[c.alias(n) for n, c in added.items()])
    return done.select(*from_row(others(docs.columns, list(added))), *added)
