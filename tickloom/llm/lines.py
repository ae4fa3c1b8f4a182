"""Operator 4: fuzzy line deduplication, in DataFrame functions only.

Similarity: the Jaccard similarity of two lines' sets of shingles of ``SHINGLE``
characters (a shorter line is one shingle). Signatures: shingles are hashed and
sorted. A line that has THIN different shingles that begin with a character of
_SOME, about every fourth, is signed by these (layer 1): they depend on nothing
but the shingles themselves, so that similar lines choose alike. A line with up to
DENSE of them is signed by all its shingles (layer 0), so that similar lines have a
layer in common. Banding: ``BANDS`` marks stand on the circle of hashes; the ROWS
hashes that follow a mark are a band. They are the least of a random order, as
minhash values are, so that two lines agree in a band with the power ROWS of their
sets' Jaccard similarity. Lines that agree in one are candidates; those that sizes
or a sketch, the SKETCH least hashes, rule out go. Verification: exact Jaccard
similarity of the sets of all shingles (by 64-bit hashes). Union-find over the
confirmed links (see components) makes classes, of which the first line stays.

A band's lines meet one of them, its leader, which settles groups of near copies
with one link for each line. Bands that a sample of lines shows to be large are
split by salts: lines meet their salt's leader, salt leaders meet the band's.
Bands whose lines are then still in several classes are compared whole, in blocks,
and only pairs that the screen lets through are made (see _whole).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import drop, free_name, written

SHINGLE = 5
ROWS, BANDS, SKETCH = 5, 14, 32
#: Small sets have few different bands: up to SMALL shingles they get bands of FEW hashes as well. (A set of 40 is only
#: similar to sets of up to 50, so that two similar lines have wide bands in common or both have these.)
FEW, SMALL = 3, 50
#: Chosen shingles from which on they sign a line, and up to which all shingles do.
THIN, DENSE = 40, 60
#: The layout sample is one line in SAMPLE; a salt takes about SALT_ROWS lines of a large band.
SAMPLE, SALT_ROWS = 64, 2048
#: A band that is compared whole is dealt out in blocks of about so many lines.
BLOCK = 256
#: Rows of one or two numbers up to which a side is broadcast (16 MB); beyond, Spark shuffles.
BROADCAST = 500_000
#: A class of more than HOT lines is hot: its first line reaches the others by broadcast.
HOT = 2048
_WORD = r"[^\x20\x09-\x0D]"
_REST = ".{%d}" % (SHINGLE - 1)
#: A shingle of code points begins anywhere but within a surrogate pair.
_ALL = rf"(?s)(?=([^\x{{DC00}}-\x{{DFFF}}]{_REST}))"
_SOME = rf"(?s)(?=([adgkmpruwyzADGKMPRUWYZ0369\x{{430}}-\x{{433}}\x{{440}}-\x{{443}}\x{{4E00}}-\x{{5FFF}}]{_REST}))"
_MARKS = [-(1 << 63) + (c << 64) // BANDS for c in range(BANDS)]


def _hashed(line: str, pattern: str) -> Column:
    """Hashes of the line's shingles that a pattern finds, different ones."""
    return F.array_distinct(F.transform(F.regexp_extract_all(line, F.lit(pattern), F.lit(1)), lambda x: F.xxhash64(x)))


def _shingles(line: str) -> Column:
    return F.when(F.length(line) < SHINGLE, F.array(F.xxhash64(line))).otherwise(_hashed(line, _ALL))


def lines(docs: DataFrame) -> DataFrame:
    """The columns but text, line_no (from 0), line and key of every line with a word."""
    others = [c for c in docs.columns if c != "text"]
    out = docs.select(*others, F.posexplode(F.split("text", "\n")).alias("line_no", "line")).where(F.col("line").rlike(_WORD))
    return out.withColumn("key", F.xxhash64("line"))


def signed(docs: DataFrame) -> DataFrame:
    """key, layer, part (the task), n (the set's size), sketch (16 bits of each hash) and bands of every line with a word, for one layer or both."""
    rows = lines(docs.select("text")).select("key", "line", _hashed("line", _SOME).alias("some"))
    m = F.size("some")
    every = F.when(m <= DENSE, F.struct(F.lit(0).alias("layer"), F.sort_array(_shingles("line")).alias("s")))
    chosen = F.when(m >= THIN, F.struct(F.lit(1).alias("layer"), F.sort_array("some").alias("s")))
    rows = rows.select("key", F.explode(F.array_compact(F.array(every, chosen))).alias("set")).select("key", "set.layer", "set.s")
    marks = F.array(*map(F.lit, _MARKS))
    rows = rows.select("key", "layer", "s", F.sort_array(F.concat("s", marks)).alias("marked"), F.concat("s", F.slice("s", 1, ROWS)).alias("circle"))

    def bands(width: int, kind: int) -> Column:
        after = [F.array_position("marked", F.lit(x)).cast("int") - c for c, x in enumerate(_MARKS)]
        return F.array(*(F.xxhash64(F.slice("circle", at, width), F.col("layer"), F.lit(kind)) for at in after))

    few = F.when(F.size("s") <= SMALL, bands(FEW, 1)).otherwise(F.array().cast("array<bigint>"))
    sketch = F.transform(F.slice("s", 1, SKETCH), lambda x: x.bitwiseAND(F.lit(0xFFFF)).cast("int"))
    part = F.spark_partition_id().alias("part")
    return rows.select("key", "layer", part, F.size("s").alias("n"), sketch.alias("sketch"), F.array_distinct(F.concat(bands(ROWS, 0), few)).alias("bands"))


def candidates(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, list[str]]:
    """Pairs (layer, a < b) of line keys, a line and a leader; the bands' lines (band, layer, key); sketches by layer and key; the tables' paths."""
    spark = docs.sparkSession
    made, made_path = written(signed(docs), "signed")
    rows = made.select("key", "layer", "part", F.explode("bands").alias("band"))
    # Where the sample sees a band often it is dealt out; this moves rows, it changes no band.
    seen, seen_path = written(rows.where(F.pmod("key", F.lit(SAMPLE)) == 0).groupBy("band").count(), "seen")
    least = max(SALT_ROWS // SAMPLE, (seen.agg(F.sum("count")).first()[0] or 0) // BROADCAST)
    large = seen.where(F.col("count") > least).select(F.col("band").alias("hot"), F.ceil(F.col("count") * SAMPLE / SALT_ROWS).alias("salts"))
    large, large_path = written(large, "bands")  # BROADCAST rows at most: each stands for more than count / BROADCAST
    salt = F.when(F.col("salts").isNotNull(), F.pmod(F.xxhash64("key", "part"), "salts")).otherwise(-1).cast("int")
    dealt = rows.join(F.broadcast(large), F.col("band") == F.col("hot"), "left")
    dealt = dealt.select("band", salt.alias("salt"), "layer", "key").repartition("band", "salt")
    leaders = dealt.groupBy("band", "salt").agg(F.min("key").alias("a"), F.max("key").alias("z")).where("a <> z OR salt >= 0").drop("z")
    led, led_path = written(dealt.join(leaders.hint("shuffle_hash"), ["band", "salt"]).distinct(), "led")
    heads = led.where("salt >= 0 AND key = a").select("band", "layer", "key")
    heads = heads.join(heads.groupBy("band").agg(F.min("key").alias("a")), "band").select("layer", "key", "a")
    pairs = led.select("layer", "key", "a").unionByName(heads).where("a <> key")
    pairs, pairs_path = written(pairs.select("layer", F.least("a", "key").alias("a"), F.greatest("a", "key").alias("b")).distinct(), "pairs")
    held = made.join(led.select("layer", "key").distinct(), ["layer", "key"], "left_semi").groupBy("layer", "key")
    sketches, sketches_path = written(held.agg(F.first("n").alias("n"), F.first("sketch").alias("sketch")), "sketches")  # equal for a key
    drop(spark, made_path, seen_path, large_path)
    return pairs, led.select("band", "layer", "key"), sketches, [pairs_path, led_path, sketches_path]


def _side(table: DataFrame, x: str, on: tuple[str, ...] = ()) -> DataFrame:
    """The table with ``x`` behind its columns' names, its key named ``x``; columns ``on`` keep theirs."""
    return table.select(*(F.col(c).alias(c if c in on else x if c == "key" else c + x) for c in table.columns))


def _alike(similarity: float) -> Column:
    """Whether sizes and sketches of a pair allow its similarity; chosen shingles and sketches get four standard deviations."""
    shared = F.size(F.array_intersect("sketcha", "sketchb"))
    drawn = F.least(F.lit(SKETCH), "na", "nb")
    enough = shared >= drawn * similarity - 4 * F.sqrt(drawn * similarity * (1 - similarity))
    return (F.least("na", "nb") >= F.when(F.col("layer") == 0, similarity).otherwise(0.7 * similarity) * F.greatest("na", "nb")) & enough


def _meet(big: DataFrame, small: DataFrame, on, how: str, rows: int) -> DataFrame:
    return big.join(F.broadcast(small) if rows <= BROADCAST else small, on, how)


def _near(pairs: DataFrame, docs: DataFrame, similarity: float) -> tuple[DataFrame, str]:
    """The pairs (a, b) of a written table whose lines are similar by all their shingles, and the path."""
    wanted, wanted_path = written(pairs.select(F.col("a").alias("key")).unionByName(pairs.select(F.col("b").alias("key"))).distinct(), "wanted")
    found = _meet(lines(docs.select("text")).select("key", "line"), wanted, "key", "left_semi", wanted.count())
    texts, texts_path = written(found.groupBy("key").agg(F.first("line").alias("l")), "texts")
    sides = pairs.join(_side(texts, "a"), "a").join(_side(texts, "b"), "b")
    sides = sides.select("a", "b", _shingles("la").alias("x"), _shingles("lb").alias("y"))
    same = F.size(F.array_intersect("x", "y")) * (1 + similarity) >= (F.size("x") + F.size("y")) * similarity - 1e-9
    near, near_path = written(sides.select("a", "b", same.alias("same")), "near")  # a filter here would hash the shingles twice
    drop(docs.sparkSession, wanted_path, texts_path)
    return near.where("same").select("a", "b"), near_path


def _whole(placed: DataFrame, sketches: DataFrame, checked: DataFrame, docs: DataFrame, similarity: float) -> tuple[DataFrame, str]:
    """Links between the classes (roots) of bands that hold several, from all their pairs of lines but the ``checked``, and the path.

    A band is dealt out in blocks of about BLOCK lines, of which every two are a
    task; a class that fills blocks of its own isn't compared with itself. A task's
    join makes only those pairs of two classes that the screen lets through.
    """
    apart = placed.groupBy("band").agg(F.min("root").alias("x"), F.max("root").alias("y"), F.count("*").alias("m")).where("x <> y AND m > 2").select("band")
    apart, apart_path = written(apart, "apart")
    rows, rows_path = written(_meet(placed, apart, "band", "left_semi", apart.count()), "rows")
    large = rows.groupBy("band", "root").count().where(F.col("count") > BLOCK).select("band", "root", F.col("root").alias("own"))
    large, large_path = written(large, "large")
    own = _meet(rows, large, ["band", "root"], "left", 2 * large.count())
    cells = own.groupBy("band", "own").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("salts"))
    cells, cells_path = written(cells, "cells")
    block = F.xxhash64("band", F.coalesce("own", F.lit(0)), F.col("own").isNull(), "salt").alias("block")
    blocks = cells.select("band", "own", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt")).select("band", "own", block)
    meets = blocks.join(blocks.toDF("band", "own2", "block2"), "band").where("block <= block2 AND (own IS NULL OR own2 IS NULL OR own <> own2)")
    meets = meets.select("block", "block2", F.xxhash64("block", "block2").alias("task"))
    # A block with itself is side 0 of its task, where each pair is met once, by key.
    sides = meets.select("block", "task", F.when(F.col("block") < F.col("block2"), 1).otherwise(0).alias("side"))
    sides = sides.unionByName(meets.where("block < block2").select(F.col("block2").alias("block"), "task", F.lit(2).alias("side")))
    sides, sides_path = written(sides, "sides")
    of = cells.toDF("of_band", "of_own", "salts")
    dealt = _meet(own, of, (F.col("band") == F.col("of_band")) & F.col("own").eqNullSafe(F.col("of_own")), "inner", 2 * of.count())
    dealt = dealt.withColumn("salt", F.pmod(F.xxhash64("key", "band"), "salts").cast("int")).select("layer", "key", "root", block)
    dealt = _meet(dealt, sides, "block", "inner", 2 * sides.count()).drop("block")
    ready, ready_path = written(dealt.join(sketches, ["layer", "key"]), "ready")
    # A band is of one layer, and so is a task.
    x, y = (_side(ready, i, ("task", "layer")) for i in "ab")
    once = ((F.col("sidea") == 1) & (F.col("sideb") == 2)) | ((F.col("sidea") == 0) & (F.col("a") < F.col("b")))
    met = x.join(y.hint("shuffle_hash"), ["task", "layer"]).where(once & (F.col("roota") != F.col("rootb")) & _alike(similarity))
    met = met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().join(checked, ["a", "b"], "left_anti")
    met, met_path = written(met, "met")
    links, links_path = _near(met, docs, similarity)
    drop(docs.sparkSession, apart_path, rows_path, large_path, cells_path, sides_path, ready_path, met_path)
    return links, links_path


def classes(docs: DataFrame, similarity: float) -> tuple[DataFrame, str]:
    """(node, root) of the line keys that have a similar line."""
    spark = docs.sparkSession
    pairs, members, sketches, paths = candidates(docs)
    alike = pairs.join(_side(sketches, "a", ("layer",)), ["layer", "a"]).join(_side(sketches, "b", ("layer",)), ["layer", "b"])
    alike, alike_path = written(alike.where(_alike(similarity)).select("a", "b").distinct(), "alike")
    near, near_path = _near(alike, docs, similarity)
    roots, roots_path = components(near)
    placed = members.join(roots.withColumnRenamed("node", "key"), "key", "left")
    placed, placed_path = written(placed.select("band", "layer", "key", F.coalesce("root", "key").alias("root")), "placed")
    more, more_path = _whole(placed, sketches, alike, docs, similarity)
    out = components(more.unionByName(roots.select(F.col("node").alias("a"), F.col("root").alias("b"))))
    drop(spark, *paths, alike_path, near_path, placed_path, roots_path, more_path)
    return out


def deduplicate(docs: DataFrame, similarity: float = 0.8) -> DataFrame:
    """Every row of ``docs`` with the lines of its text that repeat an earlier one taken out.

    Adds n_lines (lines with a word), removed (numbers of the lines taken out,
    from 0) and n_removed. Two lines are linked if the Jaccard similarity of
    their character shingles is at least ``similarity`` (equal lines are), and
    of each class that links make the first line stays: least doc_id (null
    first), then text hash, then line number. Lines without a word stay where
    they are. A null text stays null with no lines; a text may become empty.
    Rows that agree in doc_id and text are one document and keep the same lines.
    An empty table gives no rows; columns that clash with the three get replaced.
    """
    spark = docs.sparkSession
    docs = docs.drop("n_lines", "removed", "n_removed")
    tid, split, gone, lost_id, lost_tid = (free_name(docs, c) for c in ("tid", "split", "gone", "lost_id", "lost_tid"))
    d = docs.select("doc_id", "text", F.xxhash64("text").alias("tid"))
    roots, roots_path = classes(d, similarity)
    own = _meet(lines(d).drop("line"), roots, F.col("key") == F.col("node"), "left", roots.count())
    own, own_path = written(own.select("doc_id", "tid", "line_no", F.coalesce("root", "key").alias("root")), "lines")
    counts, counts_path = written(own.groupBy("root").count().where("count > 1"), "counts")
    n_own, n_many = own.count(), counts.count()
    # A hot class (BROADCAST of them at most) is settled by broadcast, the others are joined.
    hot, hot_path = written(counts.where(F.col("count") > max(HOT, n_own // BROADCAST)).select("root"), "hot")
    light = own.join(F.broadcast(hot), "root", "left_anti")
    repeated = own.join(F.broadcast(hot), "root").unionByName(_meet(light, counts.select("root"), "root", "left_semi", n_many))
    repeated, repeated_path = written(repeated, "repeated")
    first = repeated.groupBy("root").agg(F.min(F.struct("doc_id", "tid", "line_no")).alias("first"))
    first, first_path = written(first, "first")
    placed = repeated.join(F.broadcast(first.join(F.broadcast(hot), "root")), "root")
    placed = placed.unionByName(_meet(repeated.join(F.broadcast(hot), "root", "left_anti"), first, "root", "inner", 4 * n_many))
    lost = placed.where(~F.struct("doc_id", "tid", "line_no").eqNullSafe(F.col("first"))).groupBy("doc_id", "tid").agg(F.collect_set("line_no").alias("gone"))
    lost, _ = written(lost, "lost")
    drop(spark, roots_path, own_path, counts_path, hot_path, repeated_path, first_path)
    lost = lost.toDF(lost_id, lost_tid, gone)
    rows = docs.withColumn(tid, F.xxhash64("text"))
    # Lists have no bound by rows: whether they are broadcast is left to Spark's threshold.
    rows = rows.join(lost, F.col("doc_id").eqNullSafe(F.col(lost_id)) & F.col(tid).eqNullSafe(F.col(lost_tid)), "left")
    rows = rows.withColumn(split, F.split("text", "\n"))
    s, g = F.col(split), F.coalesce(F.col(gone), F.array().cast("array<int>"))
    stay = F.array_except(F.sequence(F.lit(0), F.size(s) - 1), g)
    text = F.when(F.col(gone).isNull(), F.col("text")).otherwise(F.array_join(F.transform(stay, lambda i: F.get(s, i)), "\n"))
    n_lines = F.coalesce(F.size(F.filter(s, lambda t: t.rlike(_WORD))), F.lit(0))
    rows = rows.withColumns({"n_lines": F.greatest(n_lines, F.lit(0)).cast("long"), "removed": F.array_sort(g), "n_removed": F.size(g).cast("long"), "text": text})
    return rows.select(*docs.columns, "n_lines", "removed", "n_removed")
