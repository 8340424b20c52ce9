"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

DataFrame functions only.

1. **Targets.** Sources, by code point and null last, weigh ``weights``, repeating.  They
   share the words of all documents; no target exceeds ``most`` times its source, and the
   excess is shared again by weight: target = min(cap, level * weight), with the level
   found from the sources in the order of cap / weight.
2. **Permutation.** A source's documents, in the order of a hash of their ids, lie end to
   end on a tape of words that starts again at its end.  The mix takes the first
   ``target`` words of the tape.  Places on the tape are two prefix sums: over buckets of
   the hash, and within a bucket of about the square root of the source's rows (256 at
   least), so that a source with a third of all rows is many small groups.
3. **Blocks.** The taken words of a source are cut into blocks, ``blocks`` for all sources
   in proportion to their targets.
4. **Splitting tree.** The root holds the number of blocks of each source.  A node gives
   its left child half of its blocks, how many of each source being a draw from the
   multivariate hypergeometric distribution, by an urn; the right child has the rest.  The
   leaves are the output shards: each has the mix's shares but for chance, and no block is
   drawn twice.  Sources enter in cohorts of ``COHORT``, so a node is a short row.
5. **Shards.** A source's blocks, permuted by hash, go to the shards by these counts;
   within a shard, pieces are ordered by hash (``layout``).

Draws are hashes of the seed and of what they are for, so reruns agree.  Null and empty
texts have no words and are never taken; a null doc_id takes part; repeated rows are
documents of their own; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapeframe.session import cut_lineage

COHORT = 256
WORD = r"[^\\x20\\x09-\\x0D]+"


def uniform(*parts: str) -> str:
    """A number in [0, 1) from the hash of the parts."""
    return f"shiftrightunsigned(xxhash64({', '.join(parts)}), 11) / 9007199254740992D"


def targets(sizes: DataFrame, weights: tuple[int, ...], most: int) -> DataFrame:
    """One row for each source: rank, rows, size and target in words."""
    sums = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_rows"))
    everything = Window.partitionBy()
    ranked = sums.withColumn("rank", F.row_number().over(everything.orderBy(F.col("source").asc_nulls_last())) - 1)
    listed = ", ".join(f"{w}D" for w in weights)
    capped = ranked.withColumn("weight", F.expr(f"element_at(array({listed}), CAST(pmod(rank, {len(weights)}) AS INT) + 1)")).withColumn("cap", F.col("source_size") * F.lit(most))
    by_ratio = everything.orderBy(F.col("cap") / F.col("weight"), "rank")
    before = F.coalesce(F.sum("cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    after = F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing))
    levels = capped.withColumn("level", (F.sum("source_size").over(everything) - before) / after)
    levels = levels.withColumn("turn", F.row_number().over(by_ratio))
    first = F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct("turn", "level"))
    level = levels.withColumn("level", F.coalesce(F.min(first).over(everything)["level"], F.lit(0.0)))
    return level.select("source", "rank", "n_rows", "source_size", F.least(F.col("cap").cast("double"), F.col("level") * F.col("weight")).alias("target"))


def split(counts: DataFrame, shards: int, seed: int) -> DataFrame:
    """Leaves of the tree: from (cohort, counts), rows (cohort, shard, counts) with the blocks of each source in the shard."""
    left = f"""
        aggregate(
          sequence(0, size(counts) - 1),
          named_struct('pool', total, 'room', total div 2, 'taken', array_repeat(0L, 0)),
          (s, i) -> aggregate(
            sequence(1L, greatest(counts[i], 1L)),
            named_struct('pool', s.pool, 'room', s.room, 'taken', s.taken, 'own', 0L),
            (u, j) -> IF(j <= counts[i] AND {uniform(str(seed), 'cohort', 'node', 'i', 'j')} * u.pool < u.room,
              named_struct('pool', u.pool - 1, 'room', u.room - 1, 'taken', u.taken, 'own', u.own + 1),
              named_struct('pool', u.pool - IF(j <= counts[i], 1, 0), 'room', u.room, 'taken', u.taken, 'own', u.own)),
            u -> named_struct('pool', u.pool, 'room', u.room, 'taken', concat(u.taken, array(u.own)))),
          s -> s.taken)"""
    nodes = counts.withColumn("node", F.lit(1))
    for _ in range(shards.bit_length() - 1):
        totals = nodes.withColumn("total", F.expr("aggregate(counts, 0L, (a, x) -> a + x)"))
        halves = totals.withColumn("left", F.expr(left))
        children = "array(named_struct('node', node * 2, 'counts', left), named_struct('node', node * 2 + 1, 'counts', zip_with(counts, left, (a, b) -> a - b)))"
        nodes = halves.select("cohort", F.explode(F.expr(children)).alias("child")).select("cohort", "child.*")
    return nodes.select("cohort", (F.col("node") - shards).alias("shard"), "counts")


def sources(sizes: DataFrame, weights: tuple[int, ...], most: int, blocks: int, shards: int, seed: int) -> DataFrame:
    """One row for each source, with the shard of each of its blocks."""
    if shards & (shards - 1):
        raise ValueError("the number of shards must be a power of two")
    quota = targets(sizes, weights, most).withColumn("take", F.floor(F.col("target") + 0.5))
    share = F.col("take") / F.sum("take").over(Window.partitionBy())
    quota = quota.withColumn("n_blocks", F.when(F.col("take") > 0, F.least("take", F.greatest(F.lit(1), F.round(share * blocks)).cast("long"))).otherwise(F.lit(0).cast("long")))
    quota = cut_lineage(quota.withColumn("cohort", F.expr(f"rank div {COHORT}")).withColumn("place", F.expr(f"CAST(rank % {COHORT} AS INT)")), "mix-sources")
    vectors = quota.groupBy("cohort").agg(F.expr("transform(array_sort(collect_list(struct(place, n_blocks))), x -> x.n_blocks)").alias("counts"))
    leaves = split(vectors, shards, seed).select("cohort", "shard", F.posexplode("counts").alias("place", "n"))
    drawn = leaves.groupBy("cohort", "place").agg(F.expr("flatten(transform(array_sort(collect_list(struct(shard, n))), x -> array_repeat(x.shard, CAST(x.n AS INT))))").alias("shards"))
    permuted = f"transform(array_sort(transform(sequence(0, size(shards) - 1), j -> struct(xxhash64({seed}, rank, j) AS h, j))), x -> x.j)"
    by_block = f"IF(n_blocks = 0, array_repeat(0, 0), transform(array_sort(zip_with({permuted}, shards, (j, s) -> struct(j, s))), x -> x.s))"
    return quota.join(drawn, ["cohort", "place"]).select("source", "rank", "n_rows", "source_size", "target", "take", "n_blocks", F.expr(by_block).alias("shard_of"))


def mix(
    docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: int = 3, blocks: int = 4096, shards: int = 64, seed: int = 42
) -> DataFrame:
    """doc_id, source, size, source_size, target and ``pieces`` of every row of ``docs``.

    A piece is (epoch, block, shard, first, words): ``words`` words of the document from
    ``first`` on.  ``docs`` needs doc_id, text and source.
    """
    count = F.expr(f"CAST(regexp_count(text, '{WORD}') AS BIGINT)")
    sizes = cut_lineage(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", F.coalesce(count, F.lit(0)).alias("size")), "mix-sizes")
    table = cut_lineage(sources(sizes, weights, most, blocks, shards, seed), "mix-shards")
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))).cast("binary"))
    facts = table.select(F.col("source").alias("own"), "rank", "source_size", "n_rows")
    placed = sizes.withColumn("key", key).join(facts, F.col("source").eqNullSafe(F.col("own"))).drop("own")
    part = "CAST(conv(substr(key, 1, 13), 16, 10) AS BIGINT) / 4503599627370496D"
    placed = placed.withColumn("bucket", F.expr(f"CAST(floor({part} * ceil(n_rows / greatest(256D, sqrt(n_rows)))) AS BIGINT)"))
    sums = placed.groupBy("rank", "bucket").agg(F.sum("size").alias("words"))
    ahead = sums.select("rank", "bucket", (F.sum("words").over(Window.partitionBy("rank").orderBy("bucket")) - F.col("words")).alias("ahead"))
    within = Window.partitionBy("rank", "bucket").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    tape = placed.join(ahead, ["rank", "bucket"]).withColumn("start", F.col("ahead") + F.sum("size").over(within) - F.col("size"))
    tape = tape.join(table.select("rank", "target", "take", "n_blocks", "shard_of"), "rank")
    lo, edge = "(start + e * source_size)", "(b * take div n_blocks)"
    pieces = f"""
        flatten(transform(
          filter(sequence(0, {most - 1}), e -> size > 0 AND {lo} < take),
          e -> transform(
            sequence((({lo} + 1) * n_blocks - 1) div take, (least({lo} + size, take) * n_blocks - 1) div take),
            b -> named_struct('epoch', e, 'block', b, 'shard', shard_of[CAST(b AS INT)],
              'first', greatest({edge}, {lo}) - {lo},
              'words', least({edge.replace('b *', '(b + 1) *')}, {lo} + size, take) - greatest({edge}, {lo})))))"""
    return tape.select("doc_id", "source", "size", "source_size", "target", F.expr(pieces).alias("pieces"))


def mix_report(docs: DataFrame, **options) -> DataFrame:
    """Size, target and taken words of every row; taken words are those of its pieces in the shards."""
    taken = F.expr("aggregate(filter(pieces, p -> p.shard IS NOT NULL), 0L, (a, p) -> a + p.words)")
    return mix(docs, **options).select("doc_id", "size", "source_size", "target", taken.alias("taken"))


def layout(docs: DataFrame, seed: int = 42, **options) -> DataFrame:
    """The mixed corpus as (shard, doc_id, source, epoch, first, words), each shard in a random order of its own."""
    pieces = mix(docs, seed=seed, **options).select("doc_id", "source", F.explode("pieces").alias("piece")).select("piece.shard", "doc_id", "source", "piece.epoch", "piece.first", "piece.words")
    order = F.xxhash64(F.lit(seed), "shard", "doc_id", "epoch", "first")
    return pieces.withColumn("mix_order", order).repartitionByRange("shard", "mix_order").sortWithinPartitions("shard", "mix_order").drop("mix_order")
