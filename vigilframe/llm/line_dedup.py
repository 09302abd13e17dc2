"""Line dedup by content-defined chunks of lines.

A rolling hash over the hashes of neighbouring lines sets chunk boundaries, so that inserted or
removed lines shift no boundary but those beside them. Chunks of several lines whose hash occurs
again are compared byte by byte, and all occurrences but the first go. Alternatively the pieces
that are compared are all pairs of neighbouring lines and all long lines: those overlap, so that
no boundary hides a part of a repeated passage. A piece only goes if its first occurrence stays
whole, whatever else is removed around it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilframe.llm.common import discard, materialize, word_count

#: Lines that the rolling hash covers, and one boundary in so many lines on average.
SPAN, EVERY = 2, 3
#: A line of more words than this is a passage of its own.
LONG_LINE = 50
#: What names a piece: a hash, and a number that tells apart pieces of one hash.
KEY = ["key", "variant"]


def _rotated(h: Column, by: int) -> Column:
    return h if not by else F.shiftleft(h, by).bitwiseOR(F.shiftrightunsigned(h, 64 - by))


def chunks_of(text: Column, span: int = SPAN, every: int = EVERY) -> Column:
    """array<struct<first, lines, key>>: the chunks of a text; first counts lines from 0.

    A chunk ends after a line where the rotated hashes of the last `span` lines, combined by
    exclusive or, are a multiple of `every`.
    """
    lines = F.split(text, "\n", -1)
    hashes = F.transform(lines, lambda x: F.xxhash64(x))

    def ends(a: Column) -> Column:
        def roll(i: Column) -> Column:
            out = F.get(a, i)
            for j in range(1, span):
                out = out.bitwiseXOR(_rotated(F.coalesce(F.get(a, i - j), F.lit(0)), j))
            return out

        return F.filter(F.sequence(F.lit(0), F.size(a) - 1), lambda i: (F.pmod(roll(i), F.lit(every)) == 0) | (i == F.size(a) - 1))

    def cut(e: Column) -> Column:
        return F.transform(e, lambda x, k: F.struct(F.when(k > 0, F.get(e, k - 1) + 1).otherwise(0).alias("first"), (x - F.when(k > 0, F.get(e, k - 1)).otherwise(-1)).alias("lines")))

    def keyed(pair: Column) -> Column:
        return F.transform(pair["c"], lambda c: F.struct(c["first"].alias("first"), c["lines"].alias("lines"), F.xxhash64(F.slice(pair["h"], c["first"] + 1, c["lines"])).alias("key")))

    let = lambda value, use: F.transform(F.array(value), use)[0]
    return let(let(hashes, lambda h: F.struct(h.alias("h"), let(ends(h), cut).alias("c"))), keyed)


def passages_of(text: Column) -> Column:
    """array<struct<first, lines, key>>: every two neighbouring lines and every long line of a text.

    Every repeated passage of two or more lines is made up of such pairs. Two blank lines are no passage.
    """
    lines = F.split(text, "\n", -1)

    def keyed(a: Column) -> Column:
        two = F.transform(F.slice(a, 1, F.size(a) - 1), lambda x, i: F.struct(i.alias("first"), F.lit(2).alias("lines"), F.xxhash64(x["h"], F.get(a, i + 1)["h"]).alias("key"), (x["blank"] & F.get(a, i + 1)["blank"]).alias("blank")))
        one = F.transform(a, lambda x, i: F.struct(i.alias("first"), F.lit(1).alias("lines"), x["h"].alias("key"), (~x["long"]).alias("blank")))
        return F.transform(F.filter(F.concat(two, one), lambda p: ~p["blank"]), lambda p: F.struct(p["first"].alias("first"), p["lines"].alias("lines"), p["key"].alias("key")))

    # A line of that many words has at least twice as many characters.
    long = lambda x: F.when(F.length(x) > 2 * LONG_LINE, word_count(x) > LONG_LINE).otherwise(F.lit(False))
    seen = F.transform(lines, lambda x: F.struct(F.xxhash64(x).alias("h"), (F.trim(x) == "").alias("blank"), long(x).alias("long")))
    return F.transform(F.array(seen), keyed)[0]


def _place() -> Column:
    return F.struct(F.col("id").isNull().alias("no_id"), "id", "row", "first")


def _repeats(found: DataFrame) -> DataFrame:
    """(id, row, first, lines, key, gone): the pieces that occur again; gone if an earlier one stays whole.

    Lines that any later piece holds may go. Where that touches the first occurrence of a key, its
    other occurrences stay. A piece that overlaps its own first occurrence isn't a later one.
    """
    again = found.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n"), F.min(_place()).alias("one")).where("n > 1").select(*KEY, "one")
    # Written, so that the join shares no exchange with the aggregate and a very common key can be split.
    again = materialize(again, "line-again")
    one = F.col("one")
    over = F.col("id").eqNullSafe(one["id"]) & (F.col("row") == one["row"]) & (F.col("first") < one["first"] + F.col("lines"))
    rows = materialize(found.join(again, KEY).select("id", "row", "first", "lines", *KEY, (_place() == one).alias("own"), (~over).alias("gone")), "line-repeats")
    line = F.explode(F.sequence("first", F.col("first") + F.col("lines") - 1)).alias("line")
    may_go = rows.where("gone").select(F.col("id").isNull().alias("no_id"), F.coalesce("id", F.lit(0)).alias("id"), "row", line).distinct()
    firsts = rows.where("own").select(F.col("id").isNull().alias("no_id"), F.coalesce("id", F.lit(0)).alias("id"), "row", line, *KEY)
    unsure = materialize(firsts.join(may_go, ["no_id", "id", "row", "line"], "left_semi").select(*KEY).distinct(), "line-unsure-keys")
    discard(again)
    return rows.join(unsure.withColumn("unsure", F.lit(True)), KEY, "left").select("id", "row", "first", "lines", *KEY, (F.col("gone") & F.col("unsure").isNull()).alias("gone"))


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_lines: int = 2, detail_col: str | None = None, key_bits: int = 64, pieces: Callable[[Column], Column] = chunks_of) -> DataFrame:
    """All rows and columns of docs, the text without chunks of min_lines lines or more seen before.

    The first occurrence is that of the smallest id (null ids last), then the earliest in the
    text. It stays whole: pieces whose first occurrence would lose a line to other pieces stay,
    all of them. Null and empty texts stay as they are; a text that loses all chunks becomes
    empty. Rows that agree in id and text are one document: they keep the same chunks. An empty
    table gives no rows. Columns of any name pass through, save names that start with "__line",
    which raise a ValueError. detail_col adds struct<lines, removed_lines, removed_chunks>.
    key_bits shortens the hash by which chunks find each other; what is removed does not depend on
    it. pieces may overlap (passages_of, with min_lines=1): a line goes if any piece goes that
    holds it.
    """
    if taken := [c for c in docs.columns if c.startswith("__line")]:
        raise ValueError(f"names that start with __line are taken: {taken}")
    text, row = F.col(text_col), F.xxhash64(F.col(id_col), F.col(text_col))
    base = docs.where(text.isNotNull()).select(F.col(id_col).cast("long").alias("id"), row.alias("row"), F.explode(pieces(text)).alias("c"))
    key = F.shiftrightunsigned(F.col("c.key"), 64 - key_bits) if key_bits < 64 else F.col("c.key")
    found = base.where(F.col("c.lines") >= min_lines).select("id", "row", F.col("c.first").alias("first"), F.col("c.lines").alias("lines"), key.alias("key"), F.lit(0).cast("long").alias("variant"))
    found = materialize(found.distinct(), "line-chunks")

    keyed = docs.withColumns({"__line_key_id": F.col(id_col).cast("long"), "__line_key": row})
    lines, marked = F.split(text, "\n", -1), F.col("__line_marks")
    chunk = lambda a, m: F.array_join(F.slice(a, m["first"] + 1, m["lines"]), "\n")
    # Bound by a lambda, so that a text is split once and not for each mark.
    cut = lambda of: F.transform(F.array(lines), lambda a: F.transform(of, lambda m: F.struct(*[m[c].alias(c) for c in ("first", "lines")], chunk(a, m).alias("chunk"))))[0]
    while True:
        marks = _repeats(found).select("id", "row", F.struct("first", "lines", *KEY, "gone").alias("m"))
        marks = marks.groupBy("id", "row").agg(F.collect_list("m").alias("__line_marks")).withColumnsRenamed({"id": "__line_id", "row": "__line_row"})
        joined = keyed.join(marks.hint("shuffle_hash"), (keyed["__line_key"] == marks["__line_row"]) & keyed["__line_key_id"].eqNullSafe(marks["__line_id"]), "left")
        joined = materialize(joined.drop("__line_id", "__line_row"), "line-docs")
        # Byte comparison: all texts of a key are equal if the smallest and the largest are.
        shown = joined.where(marked.isNotNull()).select(F.explode(F.arrays_zip(marked.alias("m"), cut(marked).alias("c"))).alias("x")).select(*[F.col(f"x.m.{c}").alias(c) for c in KEY], F.col("x.c.chunk").alias("chunk"))
        clash = materialize(shown.groupBy(*KEY).agg(F.min("chunk").alias("low"), F.max("chunk").alias("high")).where("low <> high").select(*KEY), "line-clash")
        if clash.isEmpty():
            break
        # Different chunks share a key: a number tells them apart, and all is looked at again.
        texts = keyed.where(text.isNotNull()).select(F.col("__line_key_id").alias("id"), F.col("__line_key").alias("row"), cut(pieces(text)).alias("p")).distinct()
        texts = texts.select("id", "row", F.explode("p").alias("p")).select(F.coalesce("id", F.lit(0)).alias("of"), F.col("id").isNull().alias("no_id"), "row", "p.*")
        twins = found.join(clash, KEY).withColumns({"of": F.coalesce("id", F.lit(0)), "no_id": F.col("id").isNull()})
        twins = materialize(twins.join(texts, ["of", "no_id", "row", "first", "lines"]).select("id", "row", "first", "lines", *KEY, "chunk"), "line-texts")
        numbers = materialize(twins.select("key", "chunk").distinct().withColumn("number", 1 + F.monotonically_increasing_id()), "line-numbers")
        twins = twins.join(numbers, ["key", "chunk"]).select("id", "row", "first", "lines", "key", F.col("number").alias("variant"))
        found = materialize(found.join(clash, KEY, "left_anti").select(*twins.columns).unionByName(twins), "line-chunks")
    discard(found)

    joined = joined.withColumn("__line_gone", F.filter(F.coalesce(marked, F.array().cast("array<struct<first:int,lines:int,key:bigint,variant:bigint,gone:boolean>>")), lambda m: m["gone"]))
    gone = F.col("__line_gone")
    at = F.array_distinct(F.flatten(F.transform(gone, lambda m: F.sequence(m["first"], m["first"] + m["lines"] - 1))))
    # A set difference and bound arrays: the work grows with the lines, not with lines times marks.
    both = F.struct(lines.alias("all"), at.alias("gone"))
    left = F.transform(F.array(both), lambda b: F.transform(F.array_except(F.sequence(F.lit(0), F.size(b["all"]) - 1), b["gone"]), lambda i: F.get(b["all"], i)))[0]
    new = F.when(F.size(gone) > 0, F.array_join(left, "\n")).otherwise(text)
    out = [new.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns]
    if detail_col:
        removed = F.size(at)
        out.append(F.struct(F.when(text.isNull(), 0).otherwise(F.size(F.split(text, "\n", -1))).alias("lines"), removed.alias("removed_lines"), F.size(gone).alias("removed_chunks")).alias(detail_col))
    return joined.select(*out)
