"""Mixing of sources to target weights by pivotal dependent rounding, with DataFrame and SQL functions alone.

A source's rate is its target over its size; each document is taken floor(rate) times, and once more with the
fractional probability that is left. Fractional units are paired: words move at random from one to the other, so that
the words expected from the pair stay the same, until one unit is whole; the other goes on to the next pair. Units
are dealt into chunks of about CHUNK by a hash, each chunk is folded to one fractional unit at most, which goes up with
a spread of its documents, JOIN chunks meeting in one: a reduction tree of log(units) levels. The root's last unit is
drawn alone; whole units of the root are then turned, large before small, where that brings the source's words nearer
to its target (inclusion probabilities hold but for those turns). All draws come from hashes: reruns agree.

Targets: sources in order of code points, null last, weigh 5, 2, 1 in turn and share all words; a target stops at
MOST times the size and the excess goes to the others by weight. That is a level of water per weight; it is found in
closed form by ordering sources by the level at which they are full. One task sees one row for each source.

Defined results: null text has size 0; a document of size 0 is taken 0 words; sources without words have target 0; a
null source is a source; repeated rows are units of their own; extra columns are ignored; an empty table gives none.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import WORD, table, written

WEIGHTS = (5, 2, 1)
MOST = 3
CHUNK = 64
SPREAD = 8
JOIN = 7  # chunks that meet in one of the next level: each sends up CHUNK / SPREAD units and one
WHOLE = 1e-9  # a probability nearer than this to 0 or 1 is whole


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) from a hash."""
    return F.xxhash64(*parts).bitwiseAND(F.lit((1 << 53) - 1)) / F.lit(float(1 << 53))


def let(value: Column, then) -> Column:
    """then(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), then), 1)


def source_targets(sized: DataFrame) -> DataFrame:
    """source, source_size, target and n (rows) of each source of sized(source, size)."""
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    by_name = Window.orderBy(F.asc_nulls_last("source"))
    place = F.row_number().over(by_name)
    weights = F.array(*[F.lit(w) for w in WEIGHTS])
    sums = sums.withColumn("place", place).withColumn("weight", F.element_at(weights, (F.col("place") - 1) % len(WEIGHTS) + 1).cast("double"))
    full = F.col("source_size") * F.lit(float(MOST))
    sums = sums.withColumn("full", full).withColumn("full_at", full / F.col("weight"))
    by_level = Window.orderBy("full_at", "place")
    before = F.coalesce(F.sum("full").over(by_level.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    open_weight = F.sum("weight").over(by_level.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    everything = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    sums = sums.withColumn("level", (F.sum("source_size").over(everything) - before) / open_weight).withColumn("row", F.row_number().over(by_level))
    fits = F.when(F.col("level") <= F.col("full_at"), F.struct("row", "level"))
    sums = sums.withColumn("at", F.min(fits).over(everything))
    target = F.when(F.col("at").isNull() | (F.col("row") < F.col("at.row")), F.col("full")).otherwise(F.col("at.level") * F.col("weight"))
    return sums.select("source", "source_size", target.alias("target"), "n")


def _pair(state: Column, unit: Column, salt: str) -> Column:
    """Move words between the unit carried on and the next one until one of them is whole."""
    a, b = state["carry"], unit
    x, y = a["p"], b["p"]
    ratio = b["size"] / a["size"]

    def chosen(draw: Column) -> Column:
        up, down = draw["up"], draw["down"]
        rise = draw["u"] * (up + down) < down
        new_x = F.when(rise, F.least(x + up, F.lit(1.0))).otherwise(F.greatest(x - down, F.lit(0.0)))
        new_y = F.when(rise, y - up / ratio).otherwise(y + down / ratio)
        return let(F.struct(_snap(new_x).alias("x"), _snap(new_y).alias("y")), after)

    def after(p: Column) -> Column:
        first, second = a.withField("p", p["x"]), b.withField("p", p["y"])
        whole_x, whole_y = p["x"].isin(0.0, 1.0), p["y"].isin(0.0, 1.0)
        done = F.when(whole_x & whole_y, F.array(first, second)).when(whole_x, F.array(first)).otherwise(F.array(second))
        carry = F.when(whole_x & whole_y, F.lit(None)).when(whole_x, second).otherwise(first)
        return F.struct(carry.alias("carry"), F.concat(state["done"], done).alias("done"))

    draw = F.struct(
        F.least(1.0 - x, y * ratio).alias("up"),
        F.least(x, (1.0 - y) * ratio).alias("down"),
        uniform(F.lit(salt), a["doc_id"], a["copy"], b["doc_id"], b["copy"]).alias("u"),
    )
    return F.when(a.isNull(), F.struct(b.alias("carry"), state["done"].alias("done"))).otherwise(let(draw, chosen))


def _snap(p: Column) -> Column:
    return F.when(p < WHOLE, 0.0).when(p > 1 - WHOLE, 1.0).otherwise(p)


UNIT = "struct<larger:bigint,order:bigint,doc_id:bigint,copy:bigint,size:bigint,p:double>"


def _fold(units: DataFrame, keys: list[str], salt: str) -> DataFrame:
    """Each chunk's units as `done` (whole) and `up` (for the next level): a root chunk sends nothing up.

    Other chunks send up the unit that stays fractional and every SPREAD-th by size, so that the root has documents of
    all sizes to make up for the unit that it draws alone.
    """
    order = F.xxhash64(F.lit(salt), "unit.doc_id", "unit.copy").alias("order")
    larger = (-F.col("unit.size")).alias("larger")
    lists = units.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(larger, order, "unit.doc_id", "unit.copy", "unit.size", "unit.p"))).alias("units"))
    none = F.array().cast(f"array<{UNIT}>")
    root = F.col("chunks") == 1
    held = F.when(root, none).otherwise(F.filter("units", lambda u, i: i % SPREAD == 0))
    paired = F.when(root, F.col("units")).otherwise(F.filter("units", lambda u, i: i % SPREAD != 0))
    start = F.struct(F.lit(None).cast(UNIT).alias("carry"), none.alias("done"))
    lists = lists.select(*keys, held.alias("held"), F.aggregate(paired, start, lambda s, u: _pair(s, u, salt)).alias("fold"))
    carry = F.col("fold.carry")
    up = F.when(carry.isNull() | root, F.col("held")).otherwise(F.concat("held", F.array(carry)))
    done = F.when(root & carry.isNotNull(), _settled(F.col("fold.done"), carry, salt)).otherwise(F.col("fold.done"))
    return lists.select(*keys, up.alias("up"), done.alias("done"))


def _settled(done: Column, carry: Column, salt: str) -> Column:
    """The root: draw the last unit alone, then turn whole units, large ones first, where that takes the words nearer to their sum."""
    drawn = F.when(uniform(F.lit(f"{salt} root"), carry["doc_id"], carry["copy"]) < carry["p"], 1.0).otherwise(0.0)
    none = F.array().cast(f"array<{UNIT}>")
    start = F.struct((carry["size"] * (carry["p"] - drawn)).cast("double").alias("short"), none.alias("done"))

    def turn(state: Column, u: Column) -> Column:
        short, half = state["short"], u["size"] / 2
        p = F.when((u["p"] == 0) & (short > half), 1.0).when((u["p"] == 1) & (short < -half), 0.0).otherwise(u["p"])
        return let(p, lambda x: F.struct((short - u["size"] * (x - u["p"])).alias("short"), F.concat(state["done"], F.array(u.withField("p", x))).alias("done")))

    return F.concat(F.aggregate(F.array_sort(done), start, turn)["done"], F.array(carry.withField("p", drawn)))


def mix_sources(docs: DataFrame, seed: str = "mix") -> DataFrame:
    """doc_id, source, size, source_size, target, copies and taken for each row of docs(doc_id, text, source)."""
    sized = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"))
    sized = written(sized, "mix-sizes")
    targets = written(source_targets(sized), "mix-targets")
    rows = sized.groupBy("doc_id", "source", "size").count().select("doc_id", "source", "size", F.explode(F.sequence(F.lit(1).cast("long"), "count")).alias("copy"))
    rows = rows.join(targets, rows["source"].eqNullSafe(targets["source"])).drop(targets["source"])
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    base = F.floor(rate + WHOLE)
    rows = rows.withColumn("base", base.cast("long")).withColumn("p", F.when(F.col("size") > 0, _snap(F.greatest(rate - base, F.lit(0.0)))).otherwise(0.0))
    rows = written(rows, "mix-rows")
    key = ["source", "source_size", "target", "base"]
    plain = rows.filter(F.col("p") == 0).select(*key, "doc_id", "size", F.lit(0.0).alias("p"))
    chunks = F.ceil(F.col("n") / F.lit(CHUNK)).cast("long")
    chunk = F.pmod(F.xxhash64(F.lit(seed), "doc_id", "copy"), chunks)
    units = rows.filter(F.col("p") > 0).select(*key, chunks.alias("chunks"), chunk.alias("chunk"), F.struct("doc_id", "copy", "size", "p").alias("unit"))
    most, level, done = -(-(targets.agg(F.max("n")).first()[0] or 0) // CHUNK), 0, [plain]
    while most:
        folded = written(_fold(units, [*key, "chunks", "chunk"], f"{seed} {level}"), f"mix-level{level}")
        done.append(folded.select(*key, F.explode("done").alias("u")).select(*key, "u.doc_id", "u.size", "u.p"))
        fewer, chunk = F.ceil(F.col("chunks") / F.lit(JOIN)).cast("long"), F.floor(F.col("chunk") / F.lit(JOIN)).cast("long")
        units = folded.select(*key, fewer.alias("chunks"), chunk.alias("chunk"), F.explode("up").alias("unit"))
        most, level = 0 if most == 1 else -(-most // JOIN), level + 1
    out = reduce(DataFrame.unionByName, done)
    copies = F.when(F.col("size") > 0, F.col("base") + F.col("p").cast("long")).otherwise(F.lit(0).cast("long"))
    return out.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (F.col("size") * copies).alias("taken"))


def repeat_documents(docs: DataFrame) -> DataFrame:
    """docs with each row as many times as the mix takes it; rows of one doc_id, source and size share their copies by a hash of the text."""
    taken = mix_sources(docs).groupBy("doc_id", "source", "size").agg(F.sort_array(F.collect_list("copies")).alias("copies"))
    # Names that no table of ours has.
    taken = taken.select([F.col(k).alias(f"mix {k}") for k in ("doc_id", "source", "size", "copies")])
    sized = docs.withColumn("mix words", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long"))
    same = F.col("doc_id").eqNullSafe(F.col("mix doc_id")) & F.col("source").eqNullSafe(F.col("mix source")) & (F.col("mix words") == F.col("mix size"))
    times = F.element_at("mix copies", (F.pmod(F.xxhash64("text"), F.size("mix copies")) + 1).cast("int"))
    out = sized.join(taken, same).withColumn("mix times", times).filter("`mix times` > 0")
    return out.withColumn("mix at", F.explode(F.sequence(F.lit(1), F.col("mix times").cast("int")))).select(*docs.columns)


def op5_pivotal_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")
