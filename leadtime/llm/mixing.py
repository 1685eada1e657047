"""Mixing sources to target weights: fixed-length blocks, drawn per output shard, joined by permuted index."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadtime.llm.common import WORD, n_words, number_rows, stepped, unfolded, written
from leadtime.session import cut_lineage

#: Slots that one row unfolds into at a time.
CHUNK = 20_000
ROUNDS = 24


@dataclass(frozen=True)
class Mix:
    """``sources``: one row per source. ``rows``: one per document. ``parts``: what of a document lies
    in which block. ``plan``: one row per slot of the mix, with its shard and the block it takes."""

    sources: DataFrame
    rows: DataFrame
    parts: DataFrame
    plan: DataFrame


def source_targets(sizes: DataFrame, *, weights: Sequence[float] = (5, 2, 1), cap: float = 3.0) -> DataFrame:
    """``source``, ``rank``, ``source_size`` and ``target`` for rows of ``source`` and ``size``.

    Sources in code-point order, null last, weigh ``weights`` in turn and share the whole size by
    weight. No target exceeds ``cap`` times its source's size; what that leaves over is shared anew
    by weight: all others get the same multiple of their weight, the one at which sums agree. The
    windows run over one row per source.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = totals.withColumn("rank", F.row_number().over(order))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") - 1) % len(weights) + 1)
    bounded = ranked.withColumn("w", weight).withColumn("most", F.col("source_size") * float(cap))
    # In the order in which sources reach their bound as the multiple rises.
    rising = Window.orderBy(F.col("most") / F.col("w"), "rank")
    everything = Window.partitionBy(F.lit(0))
    before = F.coalesce(F.sum("most").over(rising.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    multiple = (F.sum("source_size").over(everything) - before) / F.sum("w").over(
        rising.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    )
    tried = bounded.withColumn("place", F.row_number().over(rising)).withColumn("multiple", multiple)
    free = F.when(F.col("most") > F.col("w") * F.col("multiple"), F.col("place"))
    return tried.withColumn("free", F.min_by("multiple", free).over(everything)).select(
        "source",
        "rank",
        "source_size",
        F.coalesce(F.least("most", F.col("w") * F.col("free")), F.col("most")).alias("target"),
    )


def permuted(index: Column, n: Column, *seeds: Column) -> Column:
    """Place of ``index`` in a pseudorandom permutation of 0 .. n-1 named by ``seeds``.

    Each round mirrors the index at a keyed point, and swaps it with its mirror image if a keyed bit
    of the pair says so; both ends of a pair read the same bit, so every round is a permutation for
    any n, and nothing is stored.
    """

    def one_round(x: Column, r: Column) -> Column:
        mirror = F.pmod(F.pmod(F.xxhash64(F.lit("point"), *seeds, r), n) - x, n)
        return F.when(F.xxhash64(F.lit("bit"), *seeds, r, F.greatest(x, mirror)) > 0, mirror).otherwise(x)

    return F.aggregate(F.array(*[F.lit(r) for r in range(ROUNDS)]), index, one_round)


def mix(
    docs: DataFrame,
    *,
    weights: Sequence[float] = (5, 2, 1),
    cap: int = 3,
    block_words: int = 64,
    shards: int = 64,
    seed: int = 0,
) -> Mix:
    """Mix the words of ``docs`` (``doc_id``, ``text``, ``source``) so that every source comes near its target.

    A source's documents, in a hashed order, form one stream of words cut into blocks of
    ``block_words``; the last block may be short. A source gets as many slots as blocks make up its
    target, and every slot draws its output shard, so the counts of a source in the shards are
    multinomial and their sum is exact. A source's slots run through its blocks in one pseudorandom
    permutation after the other, ``cap`` of them at most: a block, so a document too, is taken ``cap``
    times at most. Blocks meet their slots in a join by source and index.

    Null and empty texts have no words: they lie in no block, and their row has ``taken`` 0. Null is
    a source of its own. Equal rows are folded, placed in steps and told apart by a running ``copy``.
    Nothing but hashes of the rows decides, so reruns agree. Other columns are ignored.
    """
    told = docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), F.xxhash64("text").alias("text_hash"))
    counted = told.groupBy("doc_id", "source", "size", "text_hash").agg(F.count("*").alias("copies"))
    rows = written(stepped(counted).withColumn("total", F.col("size") * F.col("n")))
    sources = cut_lineage(source_targets(rows.select("source", F.col("total").alias("size")), weights=weights, cap=cap))
    size, target = F.col("source_size"), F.col("target")
    whole = F.when(size > 0, F.floor(target / size)).otherwise(0)
    blocks = F.ceil(size / F.lit(block_words)).cast("long")
    slots = F.least(whole * blocks + F.round((target - whole * size) / block_words).cast("long"), blocks * cap)
    shares = sources.select("source", "rank", "source_size", "target", blocks.alias("blocks"), slots.cast("long").alias("slots"))

    known = rows.alias("l").join(shares.alias("r"), F.col("l.source").eqNullSafe(F.col("r.source"))).select("l.*", "r.rank")
    numbered = number_rows(known, ["rank"], ["doc_id", "text_hash", "from", "size"], copies="total")
    each = numbered.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("i"))
    placed = written(
        each.select(
            "doc_id", "source", "size", "text_hash", "rank", (F.col("from") + F.col("i") + 1).alias("copy"), (F.col("first") + F.col("i") * F.col("size")).alias("start")
        )
    )
    first, last = F.floor(F.col("start") / block_words), F.floor((F.col("start") + F.col("size") - 1) / block_words)
    cut = placed.where("size > 0").select("rank", "start", "size", F.explode(F.sequence(first, last)).alias("index"))
    low = F.greatest(F.col("index") * block_words, F.col("start"))
    high = F.least((F.col("index") + 1) * block_words, F.col("start") + F.col("size"))
    parts = cut.select("rank", "start", "index", (low - F.col("start")).alias("offset"), (high - low).alias("words"))

    chunks = shares.where("slots > 0").select("rank", "blocks", "slots", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slots") - 1, F.lit(CHUNK).cast("long"))).alias("from"))
    # So many rows come of so few that their number, not their size, says how many tasks they need.
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    filled = chunks.repartition(tasks, "rank", "from").select(
        "rank", "blocks", F.explode(F.sequence(F.col("from"), F.least(F.col("from") + CHUNK, F.col("slots")) - 1)).alias("slot")
    )
    key = F.lit(seed)
    epoch = F.floor(F.col("slot") / F.col("blocks"))
    plan = filled.select(
        "rank",
        "slot",
        F.pmod(F.xxhash64(key, F.lit("shard"), "rank", "slot"), F.lit(shards)).cast("int").alias("shard"),
        epoch.alias("epoch"),
        permuted(F.col("slot") % F.col("blocks"), F.col("blocks"), key, F.col("rank"), epoch).alias("index"),
    )
    return Mix(sources, placed, parts, plan)


def taken(mixed: Mix) -> DataFrame:
    """Every document of the mix with ``size``, its source's ``source_size`` and ``target``, and ``taken`` words.

    ``shards`` lists the output shards that take any of it, by number, with the words that each takes.
    """
    takes = mixed.plan.groupBy("rank", "index", "shard").agg(F.count("*").alias("takes"))
    of_shard = mixed.parts.join(unfolded(takes), ["rank", "index"]).groupBy("rank", "start", "shard").agg(F.sum(F.col("words") * F.col("takes")).alias("words"))
    words = of_shard.groupBy("rank", "start").agg(
        F.sum("words").alias("taken"), F.sort_array(F.collect_list(F.struct("shard", "words"))).alias("shards")
    )
    # Documents without words may share a start with the next one; they take nothing.
    rows = mixed.rows.join(mixed.sources.select("rank", "source_size", "target"), "rank")
    has = (F.col("size") > 0) & F.col("taken").isNotNull()
    return rows.join(unfolded(words), ["rank", "start"], "left").withColumns(
        {"shards": F.when(has, F.col("shards")).otherwise(F.array()), "taken": F.when(has, F.col("taken")).otherwise(0).cast("long")}
    )


def mixed_documents(docs: DataFrame, *, cap: int = 3, **options) -> DataFrame:
    """The mix as documents, with the columns of ``docs``: one row per document and pass that takes any of it.

    In pass p a document holds the words of its blocks taken at least p times: its own text where that
    is all of it, else those words joined by blanks. ``n_chars``, if there, follows the text.
    """
    mixed = mix(docs, cap=cap, **options)
    takes = mixed.plan.groupBy("rank", "index").agg(F.count("*").cast("int").alias("takes"))
    spans = (
        mixed.parts.join(unfolded(takes), ["rank", "index"])
        .groupBy("rank", "start")
        .agg(F.sort_array(F.collect_list(F.struct("offset", "words", "takes"))).alias("spans"))
    )
    rows = mixed.rows.where("size > 0").join(unfolded(spans), ["rank", "start"])
    passes = rows.select(
        *[F.col(c).alias(f"__{c}") for c in ("doc_id", "source", "text_hash", "size")],
        F.col("spans").alias("__spans"),
        F.explode(F.sequence(F.lit(1), F.array_max(F.transform("spans", lambda s: s["takes"])))).alias("__pass"),
    ).withColumn("__spans", F.filter("__spans", lambda s: s["takes"] >= F.col("__pass")))
    texts = docs.withColumn("__hash", F.xxhash64("text")).dropDuplicates(["doc_id", "source", "__hash"])
    joined = texts.join(
        unfolded(passes),
        texts["doc_id"].eqNullSafe(passes["__doc_id"])
        & texts["source"].eqNullSafe(passes["__source"])
        & (texts["__hash"] == passes["__text_hash"]),
    )
    all_words = F.regexp_extract_all("text", F.lit(f"({WORD})"), F.lit(1))
    some = F.array_join(
        F.flatten(F.transform("__spans", lambda s: F.slice(F.col("__words"), (s["offset"] + 1).cast("int"), s["words"].cast("int")))), " "
    )
    held = F.aggregate("__spans", F.lit(0).cast("long"), lambda n, s: n + s["words"])
    result = joined.withColumn("__words", F.when(held < F.col("__size"), all_words)).withColumn(
        "text", F.when(held < F.col("__size"), some).otherwise(F.col("text"))
    )
    if "n_chars" in docs.columns:
        result = result.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return result.select(*docs.columns)
