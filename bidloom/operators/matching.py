"""Quote lines to the item master and RFQ lines: exact codes first, then scored descriptions."""

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from bidloom.functions import text

HIGH, REVIEW, MARGIN = 0.88, 0.70, 0.08
#: What each signal counts in a score; a score is capped where specifications conflict.
TOKEN_SORT, JACCARD, SPEC, BRAND, CONFLICT_CAP = 0.40, 0.25, 0.20, 0.15, 0.65


def item_codes(items: DataFrame) -> DataFrame:
    """(code, kind, master_pos, internal_item_id) of the active items; codes without letters or digits do not count."""
    kinds = [("supplier_part_number", "SUPPLIER_SKU_EXACT"), ("manufacturer_part_number", "MANUFACTURER_PN_EXACT"), ("internal_sku", "INTERNAL_SKU_EXACT")]
    codes = F.array(*[F.struct(text.norm_code(F.col(c)).alias("code"), F.lit(i).alias("kind_rank"), F.lit(k).alias("kind")) for i, (c, k) in enumerate(kinds)])
    return items.where("status = 'ACTIVE'").select("internal_item_id", "master_pos", F.inline(codes)).where("code <> ''")


def exact_match(lines: DataFrame, items: DataFrame) -> DataFrame:
    """lines with the item whose code equals the line's: the first in master order, and of its codes the first kind."""
    best = item_codes(items).groupBy("code").agg(F.min(F.struct("master_pos", "kind_rank", "internal_item_id", "kind")).alias("m"))
    coded = lines.withColumn("code", text.norm_code(F.col("part_number")))
    return coded.join(best, "code", "left").withColumns({"matched_item": F.col("m.internal_item_id"), "match_method": F.coalesce("m.kind", F.lit("NO_MATCH"))}).drop("m")


def bind_rfq_line(matched: DataFrame, rfq_lines: DataFrame) -> DataFrame:
    """The first RFQ line, in order, whose item or whose SKU is the matched line's; a union of equi-joins, no OR join."""
    asked = rfq_lines.select("rfq_id", "rfq_line_id", "line_pos", "internal_item_id", text.norm_code(F.col("sku")).alias("sku_code"))
    keys = matched.select("quote_id", "line_index", "rfq_id", "matched_item", "code")
    by_item = keys.join(asked.drop("sku_code").withColumnRenamed("internal_item_id", "matched_item"), ["rfq_id", "matched_item"])
    by_sku = keys.join(asked.drop("internal_item_id").withColumnRenamed("sku_code", "code"), ["rfq_id", "code"])
    cols = ["quote_id", "line_index", "line_pos", "rfq_line_id"]
    found = by_item.select(cols).union(by_sku.select(cols))
    return found.groupBy("quote_id", "line_index").agg(F.min_by("rfq_line_id", F.struct("line_pos", "rfq_line_id")).alias("rfq_line_id"))


def lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence, with a bit for each character of a."""
    masks: dict[str, int] = {}
    for i, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << i
    row = (1 << len(a)) - 1
    for c in b:
        hit = row & masks.get(c, 0)
        row = (row + hit | row - hit) & (1 << len(a)) - 1
    return len(a) - row.bit_count()


@F.pandas_udf(T.DoubleType())
def indel_ratio(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """2 * common subsequence / both lengths; 1 for two empty strings."""
    for a, b in batches:
        yield pd.Series([2 * lcs(x, y) / (len(x) + len(y)) if x or y else 1.0 for x, y in zip(a, b, strict=True)], dtype=float)


def sorted_tokens(s: Column) -> Column:
    return F.array_join(F.array_sort(F.filter(F.split(text.norm_desc(s), r"\s+"), lambda x: x != "")), " ")


def signals(pairs: DataFrame, quoted: str, known: str, brand: str) -> DataFrame:
    """pairs with jaccard, spec_score and brand_score of two descriptions."""
    q, c = text.word_tokens(text.norm_desc(F.col(quoted))), text.word_tokens(text.norm_desc(F.col(known)))
    out = pairs.withColumns({"_q": q, "_c": c, "_qs": text.spec_tokens(F.col(quoted)), "_cs": text.spec_tokens(F.col(known))})
    return compared(out, F.col(quoted), F.col(brand))


def compared(pairs: DataFrame, quoted: Column, brand: Column) -> DataFrame:
    """The signals of pairs whose words (_q, _c) and specifications (_qs, _cs) are there already."""
    union = F.size(F.array_union("_q", "_c"))
    jaccard = F.when(union > 0, F.size(F.array_intersect("_q", "_c")) / union).otherwise(0.0)
    covers = (F.size(F.array_except("_qs", "_cs")) == 0) | (F.size(F.array_except("_cs", "_qs")) == 0)
    partly = F.forall("_qs", lambda a: F.exists("_cs", lambda b: a.contains(b) | b.contains(a)))
    spec = F.when((F.size("_qs") == 0) | (F.size("_cs") == 0), 0.5).when(covers, 1.0).when(partly, 0.85).otherwise(0.0)
    named = (brand != "") & F.lower(quoted).contains(F.lower(brand))
    return pairs.withColumns({"jaccard": jaccard, "spec_score": spec, "brand_score": F.when(named, 1.0).otherwise(0.5)}).drop("_q", "_c", "_qs", "_cs")


def composite(scored: DataFrame, quoted: str, known: str) -> DataFrame:
    """scored with token_sort and the weighted score, capped where specifications conflict."""
    return weighted(scored.withColumn("token_sort", indel_ratio(sorted_tokens(F.col(quoted)), sorted_tokens(F.col(known)))))


def weighted(signalled: DataFrame) -> DataFrame:
    """The weighted score of pairs with all four signals."""
    score = TOKEN_SORT * F.col("token_sort") + JACCARD * F.col("jaccard") + SPEC * F.col("spec_score") + BRAND * F.col("brand_score")
    return signalled.withColumn("score", F.round(F.when(F.col("spec_score") == 0.0, F.least(score, F.lit(CONFLICT_CAP))).otherwise(score), 3))


def top_candidates(scored: DataFrame, by: list[str], order: str, k: int = 5) -> DataFrame:
    """The k best candidates of each line, with the status that their scores give and whether the best is ambiguous."""
    w = Window.partitionBy(*by).orderBy(F.desc("score"), order)
    out = scored.withColumns({"place": F.row_number().over(w), "next_score": F.lead("score").over(w)}).where(F.col("place") <= k)
    close = (F.col("place") == 1) & (F.col("score") >= REVIEW) & (F.round(F.col("score") - F.col("next_score"), 3) < MARGIN)
    status = F.when(close, "REVIEW_REQUIRED").when(F.col("score") >= HIGH, "HIGH_CONFIDENCE_MATCH").when(F.col("score") >= REVIEW, "REVIEW_REQUIRED").otherwise("UNMATCHED")
    return out.withColumn("ambiguous", F.coalesce(close, F.lit(False))).withColumn("status", F.coalesce(status, F.lit("UNMATCHED"))).drop("next_score")
