"""What uses an item, and what may therefore be deleted, deactivated or undone."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("RFQ", "QUOTE", "COMPARISON", "AWARD")


def _sku(c: str):
    return F.nullif(F.upper(F.trim(c)), F.lit(""))


def dependencies(items: DataFrame, uses: DataFrame) -> DataFrame:
    """items (internal_item_id, internal_sku) with the number of owners of each kind, and of all, that use them. uses (kind,
    owner, internal_item_id, sku) name an item by id or by SKU, in any case; an owner counts once an item."""
    uses = uses.select("kind", "owner", "internal_item_id", _sku("sku").alias("sku")).distinct()
    by_id = items.select("internal_item_id").join(uses.select("internal_item_id", "kind", "owner"), "internal_item_id")
    by_sku = items.select("internal_item_id", _sku("internal_sku").alias("sku")).join(uses.select("sku", "kind", "owner"), "sku").drop("sku")
    found = by_id.unionByName(by_sku).distinct().groupBy("internal_item_id").agg(*[F.count_if(F.col("kind") == k).alias(f"n_{k.lower()}") for k in KINDS], F.count("*").alias("n_references"))
    names = [f"n_{k.lower()}" for k in KINDS] + ["n_references"]
    return items.select("internal_item_id", "internal_sku").join(found, "internal_item_id", "left").fillna(0, names)


def preview_undo(items: DataFrame, used: DataFrame) -> DataFrame:
    """What undoing its import does to each imported item: DEACTIVATE where anything uses it, else DELETE."""
    rows = items.where("import_batch_id IS NOT NULL").select("import_batch_id", "internal_item_id").join(used, "internal_item_id")
    return rows.withColumn("action", F.when(F.col("n_references") > 0, "DEACTIVATE").otherwise("DELETE"))


def undo_counts(preview: DataFrame) -> DataFrame:
    return preview.groupBy("import_batch_id").agg(F.count("*").alias("total_items"), F.count_if(F.col("action") == "DELETE").alias("can_delete"), F.count_if(F.col("action") == "DEACTIVATE").alias("must_deactivate"))


def undone(items: DataFrame, preview: DataFrame, batches: DataFrame) -> DataFrame:
    """items after batches (import_batch_id) are undone: unused ones are gone, used ones INACTIVE, the others as they were."""
    acts = preview.join(batches.select("import_batch_id").distinct(), "import_batch_id", "left_semi").select("internal_item_id", "action")
    rows = items.join(acts, "internal_item_id", "left").where("action IS NULL OR action = 'DEACTIVATE'")
    return rows.withColumn("status", F.when(F.col("action").isNotNull(), "INACTIVE").otherwise(F.col("status"))).drop("action")


def guarded_delete(items: DataFrame, used: DataFrame, asked: DataFrame) -> DataFrame:
    """Each item that asked (key) names by id or SKU, in any case: BLOCKED while anything uses it, else DELETED; a key that
    names none is NOT_FOUND."""
    keys = asked.select("key", _sku("key").alias("_k")).distinct()
    names = items.select("internal_item_id", F.explode(F.array_distinct(F.array(_sku("internal_item_id"), _sku("internal_sku")))).alias("_k"))
    rows = keys.join(names, "_k", "left").join(used.select("internal_item_id", "n_references"), "internal_item_id", "left")
    outcome = F.when(F.col("internal_item_id").isNull(), "NOT_FOUND").when(F.col("n_references") > 0, "BLOCKED").otherwise("DELETED")
    return rows.select("key", "internal_item_id", outcome.alias("outcome"), "n_references")
