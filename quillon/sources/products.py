"""The product dimension."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

IMAGES = "https://orderfoodonline.deno.dev/public/images/"
#: The demo catalogue: id, name, category, price in cents, image name.
DEMO = [
    ("1", "Waffle with Berries", "Waffle", 650, "waffle"),
    ("2", "Vanilla Bean Crème Brûlée", "Crème Brûlée", 700, "creme-brulee"),
    ("3", "Macaron Mix of Five", "Macaron", 800, "macaron"),
    ("4", "Classic Tiramisu", "Tiramisu", 550, "tiramisu"),
    ("5", "Pistachio Baklava", "Baklava", 400, "baklava"),
    ("6", "Lemon Meringue Pie", "Pie", 500, "meringue"),
    ("7", "Red Velvet Cake", "Cake", 450, "cake"),
    ("8", "Salted Caramel Brownie", "Brownie", 550, "brownie"),
    ("9", "Vanilla Panna Cotta", "Panna Cotta", 650, "panna-cotta"),
]
SIZES = ("thumbnail", "mobile", "tablet", "desktop")


def demo_products(spark: SparkSession) -> DataFrame:
    """``(id, name, price, category, image)`` in catalogue order."""
    rows = spark.createDataFrame([(i, *r) for i, r in enumerate(DEMO)], "n int, id string, name string, category string, price long, file string")
    image = F.struct(*[F.concat(F.lit(IMAGES + "image-"), F.col("file"), F.lit(f"-{s}.jpg")).alias(s) for s in SIZES])
    return rows.orderBy("n").select("id", "name", "price", "category", image.alias("image"))


def product_list(products: DataFrame) -> DataFrame:
    """All products, by ordinal if the table has one."""
    return products.orderBy("n").drop("n") if "n" in products.columns else products


def latest(products: DataFrame, ordinal: str = "n") -> DataFrame:
    """One row per id, the last one listed."""
    rest = [c for c in products.columns if c != "id"]
    return products.groupBy("id").agg(F.max_by(F.struct(*rest), ordinal).alias("r")).select("id", "r.*")
