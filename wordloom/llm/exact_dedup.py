"""Exact dedup by an extendible-hash index on shared files, in DataFrame operations only.

1. Every text's 64-bit hash is counted: one row per distinct hash (``keys``).
2. The directory is laid out from those counts: the leading bits of a hash
   choose a slot; as long as a bucket holds more distinct hashes than it may,
   it is split on its next bit, and the directory doubles when a bucket needs
   more bits than it has.
3. Owner tasks each get one bucket, that is one range of hashes.  Inside, texts
   of equal hash form a chain, and are told apart by comparing their bytes.
4. The index (bucket, hash, place in the chain, digest, kept id, group size) is
   written to the shared folder by bucket, and documents look themselves up.

Hashes with very many rows are combined on the map side before their text
moves, so a text that a third of all rows share reaches its owner as one row
per task; there are at most ``HOT_KEYS`` such hashes, which bounds the list of
them that is broadcast.

Defined cases: null text counts as empty, and empty texts are one group.  A null
id is smaller than any other.  Of rows equal in id and text exactly one is kept.
An empty table gives an empty result.  Columns other than id and text are not
read by ``classes``; ``survivors`` returns rows as they came, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordloom.llm.tables import small_table
from wordloom.operators.ranking import materialize
from wordloom.session import scratch_path

BUCKET_KEYS = 32_768    # distinct hashes that a bucket may hold ...
MAX_BUCKETS = 1 << 17   # ... or more, so that there are about so many buckets at most
HOT_ROWS = 1_000        # from here on a hash's rows are combined before they move
HOT_KEYS = 100_000      # no more than so many hashes count as hot
SLOTS = 20              # a directory of at most 2**SLOTS slots is broadcast


def _leading(h: Column, bits: int) -> Column:
    """The first ``bits`` bits of a 64-bit hash as a long."""
    return F.shiftrightunsigned(h, 64 - bits) if bits else F.lit(0).cast("long")


def directory(keys: DataFrame, capacity: int = BUCKET_KEYS) -> tuple[int, list[tuple[int, int, int]]]:
    """(depth, [(bucket, its leading bits, its local depth)]) for distinct hashes ``keys.h``.

    Buckets cover all hashes.  The counts that decide a split come from all
    keys; one row per candidate bucket reaches the driver, at most about four
    times ``MAX_BUCKETS``.
    """
    total = keys.count()
    capacity = max(capacity, total // MAX_BUCKETS)
    depth = max(0, (2 * total // capacity).bit_length())
    counts: dict[tuple[int, int], int] = {}
    for p, n in keys.groupBy(_leading(F.col("h"), depth)).count().collect():
        for bits in range(depth + 1):
            at = (bits, p >> (depth - bits))
            counts[at] = counts.get(at, 0) + n
    leaves, level, bits = [], [0], 0
    while level:
        over = [p for p in level if counts.get((bits, p), 0) > capacity and bits < 60]
        full = set(over)
        leaves += [(bits, p) for p in level if p not in full]
        if over and bits == depth:  # the directory doubles: overfull buckets are counted one bit deeper
            depth += 1
            split = keys.filter(_leading(F.col("h"), bits).isin(over))
            for p, n in split.groupBy(_leading(F.col("h"), depth)).count().collect():
                counts[(depth, p)] = n
        level, bits = [2 * p + k for p in over for k in (0, 1)], bits + 1
    deepest = max(d for d, _ in leaves)
    leaves.sort(key=lambda at: at[1] << (deepest - at[0]))
    return deepest, [(i, p, d) for i, (d, p) in enumerate(leaves)]


def slots(keys: DataFrame, depth: int, buckets: list[tuple[int, int, int]]) -> DataFrame:
    """The directory as a table (slot, bucket) of 2**depth rows."""
    leaf = small_table(keys.sparkSession, buckets, "bucket int, prefix long, bits int")
    span = F.pow(F.lit(2.0), F.lit(depth) - F.col("bits")).cast("long")
    return leaf.select("bucket", F.explode(F.sequence(F.col("prefix") * span, (F.col("prefix") + 1) * span - 1))
                       .alias("slot"))


def chains(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None,
           capacity: int = BUCKET_KEYS, hot_rows: int = HOT_ROWS) -> DataFrame:
    """One row per distinct text: bucket, h, text, group_size and ``keep``.

    ``keep`` is the largest id or, with ``carry``, the largest row: a struct of
    the id, whether the text is present, and the carried columns.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    row = F.col(id_col) if carry is None else F.struct(
        F.col(id_col).alias("id"), F.col(text_col).isNotNull().alias("present"),
        *[F.col(c).alias(f"c{i}") for i, c in enumerate(carry)])
    base = docs.select(F.xxhash64(text).alias("h"), text.alias("text"), F.lit(1).cast("long").alias("n"), row.alias("keep"))
    keys = materialize(base.groupBy("h").agg(F.count(F.lit(1)).alias("n")), "dedup-keys")
    depth, buckets = directory(keys, capacity)
    rows = keys.agg(F.sum("n")).first()[0] or 0
    hot = F.broadcast(keys.filter(F.col("n") > max(hot_rows, rows // HOT_KEYS)).select("h"))
    combined = (base.join(hot, "h", "left_semi").groupBy("h", "text")
                .agg(F.sum("n").alias("n"), F.max("keep").alias("keep")))
    entries = base.join(hot, "h", "left_anti").unionByName(combined)
    table = slots(keys, depth, buckets)
    owned = entries.withColumn("slot", _leading(F.col("h"), depth)).join(
        F.broadcast(table) if depth <= SLOTS else table, "slot").drop("slot")
    return (owned.repartitionById(len(buckets), F.col("bucket")).groupBy("bucket", "h", "text")
            .agg(F.sum("n").alias("group_size"), F.max("keep").alias("keep")))


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """Write the index by bucket to the shared folder and read it back."""
    chain = F.row_number().over(_chain_window())
    index = (chains(docs, id_col, text_col, **how)
             .select("bucket", "h", F.sha2("text", 256).alias("text_sha256"), F.col("keep").alias("keep_id"), "group_size")
             .withColumn("chain", chain))
    path = scratch_path(docs.sparkSession, "dedup-index")
    index.write.partitionBy("bucket").parquet(path)
    return docs.sparkSession.read.schema(index.schema).parquet(path)


def _chain_window():
    from pyspark.sql import Window
    return Window.partitionBy("bucket", "h").orderBy("text_sha256")


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """One row per document: id, keep_id, group_size, kept, text_sha256."""
    index = build_index(docs, id_col, text_col, **how)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = (docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("h"), F.sha2(text, 256).alias("text_sha256"))
            .groupBy("doc_id", "h", "text_sha256").agg(F.count(F.lit(1)).cast("int").alias("times")))
    found = rows.join(index.select("h", "text_sha256", "keep_id", "group_size"), ["h", "text_sha256"])
    each = found.select("*", F.explode(F.sequence(F.lit(1), F.col("times"))).alias("time"))
    return each.select("doc_id", "keep_id", "group_size",
                       (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("time") == 1)).alias("kept"), "text_sha256")


def survivors(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows that stay, one per distinct text, with all their columns."""
    rest = [c for c in docs.columns if c not in (id_col, text_col)]
    found = chains(docs, id_col, text_col, carry=rest, **how)
    back = {id_col: F.col("keep.id"), text_col: F.when(F.col("keep.present"), F.col("text"))}
    back |= {c: F.col(f"keep.c{i}") for i, c in enumerate(rest)}
    return found.select(*[back[c].alias(c) for c in docs.columns])
