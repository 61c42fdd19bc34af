"""Ledger merge: batches of drafts, of any family and in any order, into the stored entries.

Entries are ``chain_id, wallet, tx, id, group_id, action_type, entry_type, direction, asset,
quantity, occurred_at, transfer``; an action group is there as long as an entry names it.  A
transaction has one fee, which belongs to the action of highest priority: a stored fee moves
to a better group, and the group that it leaves is gone if it held nothing else.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ..sources.staging import met, path_of, stored
from .ledger import action_rank

PARTITION = ["chain_id", "wallet"]
#: Up to so many keys are sent to all tasks.
FEW = 100_000
#: A wallet's entries lie in this many folders, by transaction: what few transactions change is a part of their wallets.
SLICES = 8
FOLDER = [*PARTITION, "slice"]
ENTRY = ["chain_id", "wallet", "tx", "id", "group_id", "action_type", "entry_type", "direction", "asset", "quantity", "occurred_at", "transfer"]


def merged(old: DataFrame, drafts: DataFrame, used: DataFrame | None = None) -> DataFrame:
    """The stored entries with a batch merged in.

    Of entries with one id the stored one stays, else the first by group and type.  Of a
    transaction's fees, stored or new, the one of the best action stays, among equals that of
    the smallest group; if a stored fee is there, it keeps its id and content and takes the group.
    ``used`` holds transfers that recorded evidence has consumed: entries of plain transfers
    that stem from them go, stored ones too; entries of a group that also has others stay.
    The result does not depend on the order of batches or on how families are dealt to them.
    Both are read three times: store what is costly to make.  Entries travel only if another one
    may have their id.
    """
    both = old.select(*ENTRY, F.lit(0).alias("new")).unionByName(drafts.select(*ENTRY, F.lit(1).alias("new")))
    is_fee = F.col("entry_type") == "FEE"
    rest = [c for c in ENTRY if c not in ("chain_id", "wallet", "id")]
    first = F.min(F.struct("new", "group_id", "entry_type", *(c for c in rest if c not in ("group_id", "entry_type")))).alias("e")
    of_one_id = lambda rows: rows.groupBy("chain_id", "wallet", "id").agg(first).select("chain_id", "wallet", "id", *(F.col(f"e.{c}").alias(c) for c in rest))
    legs = both.where(~is_fee).withColumn("_id", F.xxhash64("chain_id", "wallet", "id"))
    again = stored(legs.groupBy("_id").count().where("count > 1").select("_id"), "repeated")
    if again.limit(FEW + 1).count() <= FEW:  # two ids of one hash are only compared once more
        again = F.broadcast(again)
        plain = legs.join(again, "_id", "left_anti").select(*ENTRY).unionByName(of_one_id(legs.join(again, "_id", "left_semi")).select(*ENTRY))
    else:
        plain = of_one_id(legs)
    tx = ["chain_id", "wallet", F.lower("tx").alias("_tx")]
    owner = F.min(F.struct(action_rank(F.col("action_type")).alias("rank"), "group_id", "action_type")).alias("owner")
    kept = F.min(F.struct("new", "id", *(c for c in rest if c not in ("group_id", "action_type")))).alias("e")
    fees = both.where(is_fee).groupBy(*tx).agg(owner, kept)
    fees = fees.select("chain_id", "wallet", "e.id", *(F.col(f"owner.{c}" if c in ("group_id", "action_type") else f"e.{c}").alias(c) for c in rest))
    whole = plain.select(*ENTRY).unionByName(fees.select(*ENTRY))
    return whole if used is None else without_shadows(stored(whole, "unshadowed"), used)


def merged_by_tx(old: DataFrame, drafts: DataFrame, used: DataFrame | None = None) -> DataFrame:
    """As :func:`merged`, of entries whose ids and groups are hashes of their lower-case transaction among others, as drafts' are.

    What has one id lies in one transaction then, so rows that were dealt by it stay where they
    are, and each is read once.  ``used`` is ``tx, transfer``.
    """
    both = old.select(*ENTRY, F.lit(0).alias("new")).unionByName(drafts.select(*ENTRY, F.lit(1).alias("new"))).where("entry_type is not null")
    is_fee, tx = F.col("entry_type") == "FEE", [*PARTITION, "tx"]
    rest = [c for c in ENTRY if c not in (*tx, "id")]
    of = lambda kind, *first: F.min(F.when(kind, F.struct(*first, *(c for c in rest if c not in first))))
    owner = F.min(F.when(is_fee, F.struct(action_rank(F.col("action_type")).alias("rank"), "group_id", "action_type"))).alias("owner")
    rows = both.groupBy(*tx, is_fee.alias("is_fee"), F.when(~is_fee, F.col("id")).alias("leg")).agg(of(~is_fee, "new", "group_id", "entry_type").alias("e"), of(is_fee, "new", "id").alias("fee"), owner)

    def value(c: str) -> Column:
        of_fee = F.col(f"owner.{c}" if c in ("group_id", "action_type") else f"fee.{c}")
        return F.when(F.col("is_fee"), of_fee).otherwise(F.col("leg" if c == "id" else f"e.{c}")).alias(c)

    whole = rows.select(*tx, *(value(c) for c in ("id", *rest))).select(*ENTRY)
    if used is None:
        return whole
    marked = met(whole, used.select("tx", "transfer").distinct().withColumn("hit", F.lit(True)), ["tx", "transfer"], "left")
    plain, hit = F.coalesce(F.col("action_type") == "TRANSFER", F.lit(False)), F.coalesce("hit", F.lit(False))
    every = F.bool_and(F.when(plain, hit)).over(Window.partitionBy(*tx, "group_id"))
    return marked.withColumn("gone", plain & hit & every).where("not gone").select(*ENTRY)


def without_shadows(entries: DataFrame, used: DataFrame) -> DataFrame:
    """Entries without those plain transfers of which evidence has consumed all; only plain transfers travel."""
    transfer = F.coalesce(F.col("action_type") == "TRANSFER", F.lit(False))
    mine = entries.where(transfer)
    marked = mine.join(used.select("transfer").distinct().withColumn("hit", F.lit(True)), "transfer", "left")
    groups = marked.groupBy(*PARTITION, "group_id").agg(F.bool_and(F.coalesce("hit", F.lit(False))).alias("all")).where("all")
    gone = marked.join(groups.select(*PARTITION, "group_id"), [*PARTITION, "group_id"], "left_semi").where("hit").select(*PARTITION, "id")
    return entries.where(~transfer).unionByName(mine.join(gone, [*PARTITION, "id"], "left_anti").select(*entries.columns))


def groups_of(entries: DataFrame) -> DataFrame:
    """The action groups that entries name."""
    return entries.groupBy(*PARTITION, "group_id").agg(F.min("action_type").alias("action_type"), F.min("tx").alias("tx"), F.min("occurred_at").alias("occurred_at"), F.count("*").alias("entries"))


def sliced(rows: DataFrame) -> DataFrame:
    """Rows with the slice of their transaction."""
    return rows.withColumn("slice", F.coalesce(F.pmod(F.crc32(F.lower("tx").cast("binary")), F.lit(SLICES)), F.lit(0)).cast("int"))


def dealt_to_folders(rows: DataFrame) -> DataFrame:
    """Rows with their slice, a few tasks for each folder; what is derived from them is better derived after it."""
    return sliced(rows).hint("rebalance", *FOLDER)


def read_entries(spark: SparkSession, path: str, like: DataFrame, more: tuple[str, ...] = ()) -> DataFrame:
    """The stored entries, and their ``slice`` if ``more`` names it; none if nothing was ever written.  A row without an id stands for an emptied folder."""
    hadoop, files = path_of(spark, path)
    schema = StructType([*like.select(*ENTRY).schema.fields, StructField("slice", IntegerType())])
    found = spark.read.schema(schema).parquet(path).where("id is not null") if files.exists(hadoop) else spark.createDataFrame([], schema)
    return found.select(*ENTRY, *more)


def apply(spark: SparkSession, path: str, drafts: DataFrame, used: DataFrame | None = None) -> None:
    """Merge a batch into the table at ``path``; reads and rewrites the partitions of its wallets and chains alone.

    ``used`` removes shadows in these partitions; wallets that the evidence names and the batch does not are merged with their own batch.
    """
    drafts = stored(drafts.select(*ENTRY), "drafts")
    touched = drafts.select(*PARTITION).distinct()
    mine = read_entries(spark, path, drafts, ("slice",)).join(F.broadcast(touched) if touched.limit(FEW + 1).count() <= FEW else touched, PARTITION, "left_semi")
    held = stored(mine.select(*FOLDER).distinct(), "folders")
    replace(stored(merged(mine, drafts, used), "merged"), path, held)


def replace(entries: DataFrame, path: str, scope: DataFrame | None = None) -> None:
    """Write entries over the folders that they have, a few files for each; those of a hot wallet are split.

    Entries that have their slice were dealt to folders before.  A folder of ``scope`` that has
    no entry left keeps a row without an id.
    """
    rows = (entries if "slice" in entries.columns else dealt_to_folders(entries)).select(*ENTRY, "slice")
    if scope is not None:
        rows = rows.unionByName(scope.select(*FOLDER).join(rows.select(*FOLDER), FOLDER, "left_anti"), allowMissingColumns=True)
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy(*FOLDER).parquet(path)
