"""Validation and pricing of nested order requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.money import apply_percent
from ..functions.text import quoted
from .lookup import coupon_outcomes

#: Limits of an order.
MAX_ITEMS, MAX_QUANTITY = 100, 100


def shape_problems(items: Column, max_items: int = MAX_ITEMS, max_quantity: int = MAX_QUANTITY) -> Column:
    """The problems that an order's items show by themselves, in order of item."""
    none = F.array().cast("array<string>")

    def of_item(item: Column, i: Column) -> Column:
        at = F.concat(F.lit("items["), i.cast("string"), F.lit("]."))
        quantity = F.coalesce(item["quantity"], F.lit(0))
        return F.concat(
            F.when(F.coalesce(item["productId"], F.lit("")) == "", F.array(F.concat(at, F.lit("productId: is required")))).otherwise(none),
            F.when((quantity < 1) | (quantity > max_quantity), F.array(F.concat(at, F.lit(f"quantity: must be between 1 and {max_quantity}")))).otherwise(none),
        )

    n = F.coalesce(F.size(items), F.lit(0))
    return (
        F.when(n < 1, F.array(F.lit("items: must contain at least one item")))
        .when(n > max_items, F.array(F.lit(f"items: must contain at most {max_items} items")))
        .otherwise(F.flatten(F.transform(items, of_item)))
    )


def place_orders(
    requests: DataFrame, products: DataFrame, valid: DataFrame, percent: int = 10, ready: bool = True, max_items: int = MAX_ITEMS, max_quantity: int = MAX_QUANTITY
) -> DataFrame:
    """Outcome of every request ``(order_id, couponCode, items array<struct<productId, quantity>>)``.

    ``products`` has ``(id, price)`` in cents, ``valid`` has ``code``.  The checks are
    staged: shape, then products, then coupon; only the first stage that fails is
    reported.  Returns ``order_id, status, problems, subtotal, discounts, total,
    products``: status 200, 422 or 503, amounts in cents, distinct products in the
    order of their first item.
    """
    base = requests.select("order_id", F.coalesce("couponCode", F.lit("")).alias("code"), "items", shape_problems(F.col("items"), max_items, max_quantity).alias("shape"))
    # only orders of sound shape are looked up, so no order contributes more than max_items rows
    looked_up = F.when(F.size("shape") == 0, F.col("items"))
    lines = base.select("order_id", "code", "shape", F.posexplode_outer(looked_up).alias("i", "item"))
    lines = lines.select("order_id", "code", "shape", "i", F.col("item.productId").alias("pid"), F.col("item.quantity").cast("long").alias("quantity"))
    priced = lines.join(products.select(F.col("id").alias("pid"), F.col("price").cast("long").alias("price")), "pid", "left")
    missing = F.concat(F.lit("items["), F.col("i").cast("string"), F.lit("].productId: product "), quoted(F.col("pid")), F.lit(" not found"))
    # an order's rows come together again with all that is known of it; its id is unique
    by_order = priced.groupBy("order_id").agg(
        F.first("code").alias("code"),
        F.first("shape").alias("shape"),
        F.sum(F.col("price") * F.col("quantity")).alias("subtotal"),
        F.sort_array(F.collect_list(F.when(F.col("i").isNotNull(), F.struct("i", "pid", F.when(F.col("price").isNull(), missing).alias("missing"))))).alias("all"),
    )
    looked = F.size("shape") == 0
    by_order = by_order.select(
        "order_id", "code", "shape", "subtotal",
        F.when(looked, F.transform(F.filter("all", lambda a: a["missing"].isNotNull()), lambda a: a["missing"])).alias("unknown"),
        F.when(looked, F.array_distinct(F.transform("all", lambda a: a["pid"]))).alias("products"),
    )
    joined = coupon_outcomes(by_order, valid, "code", percent, ready)
    found = (F.col("code") != "") & F.col("unknown").isNotNull()
    stage = (
        F.when(F.size("shape") > 0, F.lit("shape"))
        .when(F.size("unknown") > 0, F.lit("products"))
        .when(found & (F.col("status") == "invalid"), F.lit("coupon"))
        .when(found & (F.col("status") == "unavailable"), F.lit("unavailable"))
        .otherwise(F.lit("placed"))
    )
    out = joined.withColumn("stage", stage)
    problems = F.when(F.col("stage") == "shape", F.col("shape")).when(F.col("stage") == "products", F.col("unknown")).when(F.col("stage") == "coupon", F.array(F.lit("couponCode: is not a valid coupon")))
    placed = F.col("stage") == "placed"
    discount = F.when(F.col("code") != "", apply_percent(F.col("subtotal"), percent)).otherwise(F.lit(0).cast("long"))
    return out.select(
        "order_id",
        F.when(placed, F.lit(200)).when(F.col("stage") == "unavailable", F.lit(503)).otherwise(F.lit(422)).alias("status"),
        "stage",
        F.array_join(problems, "; ").alias("problems"),
        F.when(placed, F.col("subtotal")).alias("subtotal"),
        F.when(placed, discount).alias("discounts"),
        F.when(placed, F.col("subtotal") - discount).alias("total"),
        F.when(placed, F.col("products")).alias("products"),
    )


def unknown_products(lines: DataFrame, products: DataFrame, product: str = "product_id") -> DataFrame:
    """Order lines whose product doesn't exist."""
    return lines.join(products.select(F.col("id").alias("_id")), F.col(product) == F.col("_id"), "left_anti")
