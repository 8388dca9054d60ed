"""Mixing sources to target weights by a low-discrepancy schedule.

Slot t of the schedule takes the golden-ratio point frac(t * phi), in 32-bit integers, to the source whose interval of
cumulative weights holds it. The k-th slot of a source gets the source's k-th block: its documents in hashed order,
cut where their running tokens pass multiples of block_tokens. The schedule ends before the first slot whose source
has run out, so nothing is repeated, any stretch of it has the target weights, and the source that is scarcest for
its weight is used up. With exhaust the same schedule goes on until all are used up, so that nothing is left out: points of a
source that has run out are passed over, slots number the points that are taken, and up to where the schedule would have
ended the mixture is the same. It goes on in stretches, each of at most STRETCH points for a block that is left; after a
stretch the sources that are left share the whole interval by their weights, so that one of tiny weight gets its points too.

Running sums are made in two levels (totals of hash buckets, then rows within a bucket), so that a hot source is
spread over many tasks. Text is shuffled once, by (source, bucket); a bucket's slots come with it in an array.

Defined cases: a null source counts as ''; a document counts ceil(characters / 4) tokens, 1 at least, null and empty
texts too; one longer than a block has the block that it begins in to itself, but for what comes before; a null id hashes
as ''; equal rows are interchangeable; without rows the result is empty. Without given
weights a source weighs tokens ** temperature. A source whose given weight is missing or 0 is left out. Input columns
named `slot` or `block` are replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm.common import col, cut, fresh, hash_duck, hash_sql, without

BLOCK_TOKENS = 16384
TEMPERATURE = 0.7
GOLDEN = 2654435769  # 2 ** 32 / phi
FULL = 1 << 32
#: Points of a stretch for each block that is left, at most; blocks that a source may lag behind its share of a stretch.
STRETCH, LAG = 4, 4
#: Rows of a bucket, about; slots of a chunk of the schedule.
BUCKET_ROWS, CHUNK = 4096, 1 << 16


def schedule(sources: DataFrame, n_slots: int, start: int = 0) -> DataFrame:
    """Slots start .. start + n_slots - 1 as (slot, skey, block), blocks from 0. sources: (skey, weight), weights of any scale."""
    spark = sources.sparkSession
    by_name = Window.orderBy("skey").rowsBetween(Window.unboundedPreceding, 0)
    everyone = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    cum = F.floor(F.round(F.sum("weight").over(by_name) / F.sum("weight").over(everyone), 9) * FULL).cast("bigint")
    spans = (
        sources.filter("weight > 0")
        .withColumn("hi", cum)
        .withColumn("lo", F.lag("hi", 1, 0).over(Window.orderBy("skey")))
        .filter("hi > lo")
        .select("skey", "lo", "hi", F.explode(F.expr("sequence(shiftright(lo, 20), shiftright(hi - 1, 20))")).alias("cell"))
    )
    # The multiplier less 2 ** 32 gives the same points, and no id overflows.
    u = F.expr(f"pmod(id % {FULL}L * {GOLDEN - FULL}L, {FULL}L)")
    points = spark.range(start, start + n_slots).select(F.col("id").alias("slot"), u.alias("u"), F.expr(f"id div {CHUNK}").alias("chunk"))
    hit = (
        points.withColumn("cell", F.expr("shiftright(u, 20)")).join(spans, "cell").filter("u >= lo and u < hi").select("slot", "chunk", "skey")
    )
    before = (
        hit.groupBy("skey", "chunk")
        .count()
        .select("skey", "chunk", (F.sum("count").over(Window.partitionBy("skey").orderBy("chunk")) - F.col("count")).alias("before"))
    )
    within = F.row_number().over(Window.partitionBy("skey", "chunk").orderBy("slot")) - 1
    return hit.join(before, ["skey", "chunk"]).select("slot", "skey", (F.col("before") + within).alias("block"))


def whole_schedule(sources: DataFrame) -> DataFrame:
    """The slots of all blocks, as (slot, skey, block). sources: (skey, weight, blocks), weights of any scale."""
    left = cut(sources.filter("weight > 0 and blocks > 0").select("skey", "weight", "blocks", F.lit(0).cast("bigint").alias("done")))
    taken, start = left.select(F.col("done").alias("at"), "skey", F.col("done").alias("block")).limit(0), 0
    while True:
        need = F.max((F.col("blocks") - F.col("done") + LAG) / F.col("weight")) * F.sum("weight")
        n, enough = left.agg(F.sum(F.col("blocks") - F.col("done")), need).first()
        if not n:
            break
        # More points than blocks, so that a source runs out in each stretch.
        length = max(n + 1, int(min(STRETCH * n, enough)))
        hits = schedule(left.select("skey", "weight"), length, start).join(left.select("skey", "blocks", "done"), "skey")
        got = cut(hits.withColumn("block", F.col("block") + F.col("done")).filter("block < blocks").select(F.col("slot").alias("at"), "skey", "block"))
        taken, start = taken.unionByName(got), start + length
        counts = got.groupBy("skey").agg(F.count("*").alias("n"))
        done = F.col("done") + F.coalesce("n", F.lit(0))
        left = cut(left.join(counts, "skey", "left").select("skey", "weight", "blocks", done.alias("done")).filter("done < blocks"))
    placed = taken.withColumn("chunk", F.expr(f"at div {CHUNK}"))
    before = (
        placed.groupBy("chunk").count().select("chunk", (F.sum("count").over(Window.orderBy("chunk")) - F.col("count")).alias("before"))
    )
    within = F.row_number().over(Window.partitionBy("chunk").orderBy("at")) - 1
    return placed.join(before, "chunk").select((F.col("before") + within).alias("slot"), "skey", "block")


def mix(
    df: DataFrame,
    weights: dict[str, float] | None = None,
    block_tokens: int = BLOCK_TOKENS,
    temperature: float = TEMPERATURE,
    exhaust: bool = False,
) -> DataFrame:
    """The documents of the mixture, with `block` BIGINT, its number in the source, and `slot` BIGINT, its place in the schedule.

    exhaust: go on until every source with a weight is used up.
    """
    spark = df.sparkSession
    df = without(df, "slot", "block")
    skey, tok, h, bucket, start = fresh(df, "_skey", "_tokens", "_hash", "_bucket", "_start")
    rows = df.withColumns(
        {
            skey: F.coalesce(col("source").cast("string"), F.lit("")),
            tok: F.greatest(F.lit(1), F.coalesce(F.ceil(F.length(col("text")) / 4), F.lit(1))).cast("bigint"),
        }
    )
    stats = cut(rows.groupBy(F.col(skey).alias("skey")).agg(F.count("*").alias("n"), F.sum(tok).alias("tokens")))
    stats = stats.withColumn("blocks", F.expr(f"(tokens - 1) div {block_tokens} + 1"))
    if weights is None:
        stats = stats.withColumn("weight", F.pow(F.col("tokens").cast("double"), F.lit(temperature)))
    else:
        given = spark.createDataFrame([(str(k), float(v)) for k, v in weights.items()], "skey string, weight double")
        stats = stats.join(given, "skey")
    total = stats.agg(F.sum("n"), F.sum("blocks")).first()
    n_rows, n_blocks = total[0] or 0, total[1] or 0
    if exhaust:
        slots = cut(whole_schedule(stats)).select("skey", "block", "slot")
    else:
        slots = cut(schedule(stats.select("skey", "weight"), n_blocks + 1).join(stats.select("skey", "blocks"), "skey"))
        end = slots.filter("block >= blocks").agg(F.min("slot")).first()[0]
        slots = slots.filter(F.col("slot") < (end if end is not None else 0)).select("skey", "block", "slot")

    bits = min(24, max(0, (n_rows // BUCKET_ROWS).bit_length()))
    key = "coalesce(cast(`doc_id` as string), '')"
    rows = rows.withColumn(h, F.expr(hash_sql(key))).withColumn(bucket, F.shiftright(F.col(h), 32 - bits))
    sums = rows.groupBy(F.col(skey).alias("skey"), F.col(bucket).alias("bucket")).agg(F.sum(tok).alias("t"))
    upto = F.sum("t").over(Window.partitionBy("skey").orderBy("bucket"))
    spans = sums.select("skey", "bucket", (upto - F.col("t")).alias("offset"), upto.alias("upto")).withColumn(
        "first", F.expr(f"offset div {block_tokens}")
    )
    spans = cut(spans)
    taken = (
        spans.select("skey", "bucket", F.explode(F.expr(f"sequence(first, (upto - 1) div {block_tokens})")).alias("block"))
        .join(slots, ["skey", "block"])
        .groupBy("skey", "bucket")
        .agg(F.sort_array(F.collect_list(F.struct("block", "slot"))).alias("taken"))
    )
    # The blocks that are taken are the first of their source: they are a run from the bucket's first block on.
    meta = spans.join(taken, ["skey", "bucket"]).select(
        F.col("skey").alias(skey), F.col("bucket").alias(bucket), "offset", "first", F.col("taken.slot").alias("taken")
    )
    off, first, got = fresh(rows, "_offset", "_first", "_taken")
    meta = meta.toDF(skey, bucket, off, first, got)
    running = F.sum(tok).over(
        Window.partitionBy(skey, bucket)
        .orderBy(F.col(h), col("doc_id"), F.md5(F.coalesce(col("text"), F.lit(""))))
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    placed = (
        rows.join(meta, [skey, bucket])
        .withColumn(start, F.col(off) + running - F.col(tok))
        .withColumn("block", F.expr(f"`{start}` div {block_tokens}"))
        .withColumn("slot", F.try_element_at(F.col(got), (F.col("block") - F.col(first) + 1).cast("int")))
        .filter("slot is not null")
    )
    return placed.select(*[col(c) for c in df.columns], "block", "slot")


def arrange(mixed: DataFrame, slots_per_partition: int = 1024) -> DataFrame:
    """The mixture in the order of its schedule: each partition a run of slots, sorted."""
    n = int((mixed.agg(F.max("slot")).first()[0] or 0) // slots_per_partition) + 1
    return mixed.repartitionByRange(n, "slot").sortWithinPartitions("slot")


def oracle(columns: str = "doc_id, lang, source, n_chars, text", block_tokens: int = BLOCK_TOKENS, temperature: float = TEMPERATURE) -> str:
    h = hash_duck("coalesce(doc_id::VARCHAR, '')")
    return f"""
WITH d AS (
  SELECT *, coalesce(source, '') AS skey, {h} AS h, greatest(1, coalesce(ceil(length(text) / 4.0), 1))::BIGINT AS tok FROM documents
), placed AS (
  SELECT *, (sum(tok) OVER (PARTITION BY skey ORDER BY h, doc_id, md5(coalesce(text, '')) ROWS UNBOUNDED PRECEDING) - tok)::BIGINT // {block_tokens} AS block FROM d
), stats AS (
  SELECT skey, pow(sum(tok)::DOUBLE, {temperature}) AS w, ((sum(tok) - 1)::BIGINT // {block_tokens} + 1) AS blocks FROM d GROUP BY skey
), spans AS (
  SELECT *, lag(hi, 1, 0) OVER (ORDER BY skey) AS lo FROM (
    SELECT skey, blocks, floor(round(sum(w) OVER (ORDER BY skey ROWS UNBOUNDED PRECEDING) / sum(w) OVER (), 9) * {FULL})::BIGINT AS hi FROM stats)
), slots AS (
  SELECT slot, skey, blocks, row_number() OVER (PARTITION BY skey ORDER BY slot) - 1 AS block
  FROM (SELECT range AS slot, (range * {GOLDEN}) % {FULL} AS u FROM range((SELECT sum(blocks)::BIGINT + 1 FROM stats))) p
  JOIN spans ON u >= lo AND u < hi
)
SELECT {columns}, placed.block, slots.slot FROM placed JOIN slots ON placed.skey = slots.skey AND placed.block = slots.block
WHERE slots.slot < (SELECT min(slot) FROM slots WHERE block >= blocks)"""
