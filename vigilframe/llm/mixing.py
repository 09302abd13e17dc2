"""Mixing sources to target weights by pivotal dependent rounding.

Each source gets a target in words; its documents share the same fractional number of copies.
Fractions are rounded in pairs: words move between two documents, at random and fair in
expectation, until one of them is taken wholly or not at all; the other meets the next one.
Blocks of documents do this at once; what each block leaves over meets in the next level of a
reduction tree, so no task holds a whole source and every transfer keeps the sum of words.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigilframe.llm.common import materialize, row_hash, uniform, word_count

#: Documents in a block on average, and blocks that a block of the next level joins.
FAN_IN = 64
#: Documents of each source that wait for the last level: in a long list from large to small the
#: one that stays fractional is nearly always among the small ones, so the last rounding is slight.
HELD_BACK = 256

ITEM = "struct<order:bigint,h:bigint,id:bigint,size:bigint,base:bigint,mass:double>"
DONE = "array<struct<id:bigint,h:bigint,size:bigint,base:bigint,up:bigint>>"


def source_targets(sizes: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """(source, n, source_size, target) from (source, size).

    Sources in code-point order, null last, take the weights in turn. They share `share` times
    all words by weight; a target stops at `most` times its source, and what is above goes to
    the others by weight until none is above.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    in_order = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.array(*[F.lit(float(w)) for w in weights])
    per = per.withColumn("weight", F.element_at(turn, (F.pmod(F.row_number().over(in_order) - 1, F.lit(len(weights))) + 1).cast("int")))
    per = per.withColumn("cap", F.lit(float(most)) * F.col("source_size"))
    # In order of cap per weight the capped sources come first, so running sums find them all.
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    everyone = Window.partitionBy(F.lit(1))
    per = per.withColumn("budget", F.lit(float(share)) * F.sum("source_size").over(everyone))
    left = F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    from_here = F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing))
    per = per.withColumn("capped", F.col("cap") * from_here <= left * F.col("weight"))
    free = F.col("budget") - F.coalesce(F.sum(F.when(F.col("capped"), F.col("cap"))).over(everyone), F.lit(0.0))
    rest = F.sum(F.when(~F.col("capped"), F.col("weight"))).over(everyone)
    target = F.when(F.col("capped"), F.col("cap")).otherwise(F.least("cap", free * F.col("weight") / rest))
    return per.select("source", "n", "source_size", target.alias("target"))


def _let(value: Column, use) -> Column:
    """use(value) with value computed once."""
    return F.transform(F.array(value), use)[0]


def _item(e: Column, mass: Column) -> Column:
    return F.struct(e["order"].alias("order"), e["h"].alias("h"), e["id"].alias("id"), e["size"].alias("size"), e["base"].alias("base"), mass.alias("mass"))


def _settled(e: Column) -> Column:
    up = (e["mass"] == e["size"]).cast("long")
    return F.struct(e["id"].alias("id"), e["h"].alias("h"), e["size"].alias("size"), e["base"].alias("base"), up.alias("up"))


def _pivot(a: Column, b: Column, seed: int) -> Column:
    """The two items after one transfer; at least one of them is whole or empty."""
    room_a, room_b = a["size"] - a["mass"], b["size"] - b["mass"]
    to_a, to_b = F.least(room_a, b["mass"]), F.least(a["mass"], room_b)
    a_gains = uniform(a["h"], b["h"], F.lit(seed)) * (to_a + to_b) < to_b
    up, down = F.lit(0.0), F.lit(0.0)
    a_mass = F.when(a_gains, F.when(room_a <= b["mass"], a["size"].cast("double")).otherwise(a["mass"] + to_a)).otherwise(F.when(a["mass"] <= room_b, down).otherwise(a["mass"] - to_b))
    b_mass = F.when(a_gains, F.when(b["mass"] <= room_a, up).otherwise(b["mass"] - to_a)).otherwise(F.when(room_b <= a["mass"], b["size"].cast("double")).otherwise(b["mass"] + to_b))
    return F.array(_item(a, a_mass), _item(b, b_mass))


def _fold(items: Column, seed: int) -> Column:
    """struct(cur, done): the one fractional item left of the list, and all that are decided."""

    def open_(e: Column) -> Column:
        return (e["mass"] > 0) & (e["mass"] < e["size"])

    def step(acc: Column, e: Column) -> Column:
        def met(pair: Column) -> Column:
            settled = F.transform(F.filter(pair, lambda x: ~open_(x)), _settled)
            return F.struct(F.get(F.filter(pair, open_), F.lit(0)).cast(ITEM).alias("cur"), F.concat(acc["done"], settled).cast(DONE).alias("done"))

        return F.when(acc["cur"].isNull(), F.struct(e.cast(ITEM).alias("cur"), acc["done"].alias("done"))).otherwise(_let(_pivot(acc["cur"], e, seed), met))

    start = F.struct(F.lit(None).cast(ITEM).alias("cur"), F.array().cast(DONE).alias("done"))
    return F.aggregate(items, start, step)


def mix_sources(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most: float = 2.0, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per document: id, size, source_size, target, taken, source, copies, row_hash.

    taken is copies times size; the sum over a source differs from its target by less than the
    size of one document, usually a small one. Reruns agree, as chance comes from hashes.
    Null text has no words; a document without words, or of a source that takes nothing, has
    taken 0. A null source is a source of its own, the last. Repeated rows are drawn one by one;
    of equal sizes the hash decides which meet first. A very long text counts whole, so a source
    that has little else may miss its target by up to that text. An empty table gives no rows.
    most must be a whole number or share must keep targets below it. Other columns are ignored.
    """
    size = word_count(F.col(text_col))
    rows = docs.select(
        F.col(id_col).cast("long").alias("id"), F.col(source_col).alias("source"), size.alias("size"),
        row_hash(F.col(id_col), F.col(source_col), F.col(text_col), F.lit(seed)).alias("h"),
    )
    rows = materialize(rows, "mix-rows")
    plan = source_targets(rows.select("source", "size"), weights, share, most)
    plan = materialize(plan, "mix-plan")
    levels, blocks = 1, -(-(plan.agg(F.max("n")).first()[0] or 1) // FAN_IN)
    while blocks > FAN_IN:
        levels, blocks = levels + 1, -(-blocks // FAN_IN)

    ratio = F.coalesce(F.col("target") / F.nullif(F.col("source_size").cast("double"), F.lit(0.0)), F.lit(0.0))
    on = plan.select(F.col("source").alias("plan_source"), "n", "source_size", "target")
    placed = (
        rows.join(on, rows["source"].eqNullSafe(on["plan_source"]), "inner")
        .withColumn("base", F.floor(ratio)).withColumn("mass", (ratio - F.floor(ratio)) * F.col("size"))
    )
    fractional = (F.col("mass") > 0) & (F.col("mass") < F.col("size"))
    whole = placed.where(~fractional).select("source", "id", "h", "size", "base", F.lit(0).cast("long").alias("up"))

    # Large documents meet first, so that the last one standing is small.
    item = F.struct((-F.col("size")).alias("order"), "h", "id", "size", "base", "mass").cast(ITEM)
    block = F.pmod(F.xxhash64("h"), F.ceil(F.col("n") / FAN_IN))
    waits = uniform(F.col("h"), F.lit("wait")) * F.col("n") < HELD_BACK
    level = placed.where(fractional & ~waits).select("source", block.alias("block"), item.alias("item"))
    held = placed.where(fractional & waits).select("source", F.lit(0).cast("long").alias("block"), item.alias("item"))
    done = [whole]
    for k in range(levels + 1):
        if k == levels:
            level = level.withColumn("block", F.lit(0).cast("long")).union(held)
        folded = level.groupBy("source", "block").agg(_fold(F.array_sort(F.collect_list("item")), seed + k).alias("out"))
        if k == 0:
            folded = materialize(folded, "mix-level")
        done.append(folded.select("source", F.explode("out.done").alias("d")).select("source", "d.id", "d.h", "d.size", "d.base", "d.up"))
        level = folded.where("out.cur is not null").select("source", F.floor(F.col("block") / FAN_IN).alias("block"), F.col("out.cur").alias("item"))
    i = F.col("item")
    up = (uniform(i["h"], F.lit(seed), F.lit("last")) * i["size"] < i["mass"]).cast("long")
    done.append(level.select("source", i["id"], i["h"], i["size"], i["base"], up.alias("up")))
    all_done = done[0]
    for d in done[1:]:
        all_done = all_done.union(d)
    out = all_done.join(on, all_done["source"].eqNullSafe(on["plan_source"]), "inner")
    copies = F.col("base") + F.col("up")
    return out.select(
        F.col("id").alias(id_col), "size", "source_size", "target", (copies * F.col("size")).alias("taken"),
        F.col("source").alias(source_col), copies.alias("copies"), F.col("h").alias("row_hash"),
    )


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 7, **mix) -> DataFrame:
    """The documents of the mix with all their columns, each as often as it was drawn.

    Documents without words, null texts included, add nothing to the mix and go. Very long texts
    are taken whole. Repeated rows are drawn one by one. An empty table gives no rows. Columns of
    any name pass through, save names that start with "__mix".
    """
    drawn = mix_sources(docs, id_col=id_col, text_col=text_col, source_col=source_col, seed=seed, **mix)
    # Plain equality on three columns, which the window is dealt by too: whole texts are shuffled once.
    key = {"__mix_null": F.col(id_col).isNull(), "__mix_id": F.coalesce(F.col(id_col).cast("long"), F.lit(0))}
    drawn = drawn.groupBy(*[c.alias(n) for n, c in key.items()], F.col("row_hash").alias("__mix_row")).agg(F.sum("copies").alias("__mix_copies"), F.max("size").alias("__mix_size")).where("__mix_copies > 0 and __mix_size > 0")
    # Rows that agree in id, source and text are one draw with the copies of all.
    row = row_hash(F.col(id_col), F.col(source_col), F.col(text_col), F.lit(seed))
    names = [*key, "__mix_row"]
    first = F.row_number().over(Window.partitionBy(*names).orderBy(F.lit(1)))
    keyed = docs.withColumns({**key, "__mix_row": row}).withColumn("__mix_first", first).where("__mix_first = 1")
    return keyed.join(drawn, names).withColumn("__mix_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__mix_copies")))).select(*[f"`{c}`" for c in docs.columns])
