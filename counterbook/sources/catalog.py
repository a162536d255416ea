"""Prepaid load catalog seed (``load_catalog``)."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

SOURCE_SMART = "https://smart.com.ph/prepaid/load"
SOURCE_DITO = "https://dito.ph/prepaid"

# The seed catalog that must match the reference row for row.
# (carrier, product_code, product_name, load_type, face_value, validity_days, source_url)
SEED_PRODUCTS = [
    ("smart", "SMART_REG_50", "Smart Regular Load 50", "regular", 50, 365, SOURCE_SMART),
    ("smart", "SMART_REG_75", "Smart Regular Load 75", "regular", 75, 365, SOURCE_SMART),
    ("smart", "SMART_REG_100", "Smart Regular Load 100", "regular", 100, 365, SOURCE_SMART),
    ("smart", "SMART_REG_200", "Smart Regular Load 200", "regular", 200, 365, SOURCE_SMART),
    ("smart", "SMART_REG_300", "Smart Regular Load 300", "regular", 300, 365, SOURCE_SMART),
    ("smart", "SMART_REG_500", "Smart Regular Load 500", "regular", 500, 365, SOURCE_SMART),
    ("smart", "SMART_REG_1000", "Smart Regular Load 1000", "regular", 1000, 365, SOURCE_SMART),
    ("smart", "SMART_PROMO_200P22", "Smart Promo Load 200 + 22", "promo", 200, 30, SOURCE_SMART),
    ("smart", "SMART_PROMO_300P33", "Smart Promo Load 300 + 33", "promo", 300, 30, SOURCE_SMART),
    ("smart", "SMART_PROMO_500P55", "Smart Promo Load 500 + 55", "promo", 500, 30, SOURCE_SMART),
    ("smart", "SMART_PROMO_1000P150", "Smart Promo Load 1000 + 150", "promo", 1000, 60, SOURCE_SMART),
    ("tnt", "TNT_REG_50", "TNT Regular Load 50", "regular", 50, 365, SOURCE_SMART),
    ("tnt", "TNT_REG_75", "TNT Regular Load 75", "regular", 75, 365, SOURCE_SMART),
    ("tnt", "TNT_REG_100", "TNT Regular Load 100", "regular", 100, 365, SOURCE_SMART),
    ("tnt", "TNT_REG_200", "TNT Regular Load 200", "regular", 200, 365, SOURCE_SMART),
    ("tnt", "TNT_REG_300", "TNT Regular Load 300", "regular", 300, 365, SOURCE_SMART),
    ("tnt", "TNT_REG_500", "TNT Regular Load 500", "regular", 500, 365, SOURCE_SMART),
    ("tnt", "TNT_REG_1000", "TNT Regular Load 1000", "regular", 1000, 365, SOURCE_SMART),
    ("dito", "DITO_LEVELUP_99_15D", "DITO NEW LEVEL-UP 99", "promo", 99, 15, SOURCE_DITO),
    ("dito", "DITO_LEVELUP_99_30D", "DITO LEVEL-UP 99", "promo", 99, 30, SOURCE_DITO),
    ("dito", "DITO_LEVELUP_109", "DITO LEVEL-UP 109", "promo", 109, 30, SOURCE_DITO),
    ("dito", "DITO_LEVELUP_129", "DITO LEVEL-UP 129", "promo", 129, 30, SOURCE_DITO),
    ("dito", "DITO_LEVELUP_169", "DITO LEVEL-UP 169", "promo", 169, 30, SOURCE_DITO),
    ("dito", "DITO_LEVELUP_199", "DITO LEVEL-UP 199", "promo", 199, 30, SOURCE_DITO),
    ("dito", "DITO_LEVELUP_299", "DITO LEVEL-UP 299", "promo", 299, 30, SOURCE_DITO),
    ("dito", "DITO_LEVELUP_499", "DITO LEVEL-UP 499", "promo", 499, 30, SOURCE_DITO),
    ("dito", "DITO_LEVELUP_999", "DITO LEVEL-UP 999", "promo", 999, 30, SOURCE_DITO),
    ("dito", "DITO_SOCIALS_20", "DITO LEVEL-UP SOCIALS 20", "data", 20, 1, SOURCE_DITO),
    ("dito", "DITO_SOCIALS_50", "DITO LEVEL-UP SOCIALS 50", "data", 50, 3, SOURCE_DITO),
    ("dito", "DITO_SOCIALS_70", "DITO LEVEL-UP SOCIALS 70", "data", 70, 7, SOURCE_DITO),
    ("dito", "DITO_SOCIALS_299", "DITO LEVEL-UP SOCIALS 299", "data", 299, 30, SOURCE_DITO),
    ("dito", "DITO_SOCIALS_399", "DITO LEVEL-UP SOCIALS 399", "data", 399, 30, SOURCE_DITO),
    ("dito", "DITO_SOCIALS_499", "DITO LEVEL-UP SOCIALS 499", "data", 499, 30, SOURCE_DITO),
    ("dito", "DITO_SOCIALS_599", "DITO LEVEL-UP SOCIALS 599", "data", 599, 30, SOURCE_DITO),
    ("dito", "DITO_DATA_10", "DITO DATA 10", "data", 10, 1, SOURCE_DITO),
    ("dito", "DITO_DATA_20", "DITO DATA 20", "data", 20, 1, SOURCE_DITO),
    ("dito", "DITO_DATA_30", "DITO DATA 30", "data", 30, 3, SOURCE_DITO),
    ("dito", "DITO_DATA_50", "DITO DATA 50", "data", 50, 7, SOURCE_DITO),
    ("dito", "DITO_UNLI5G_299", "DITO UNLI 5G 299", "unli", 299, 7, SOURCE_DITO),
    ("dito", "DITO_UNLI5G_499", "DITO UNLI 5G 499", "unli", 499, 15, SOURCE_DITO),
    ("dito", "DITO_UNLI5G_999", "DITO UNLI 5G 999", "unli", 999, 30, SOURCE_DITO),
]

CATALOG_INPUT_SCHEMA = T.StructType([
    T.StructField("carrier", T.StringType(), False),
    T.StructField("product_code", T.StringType(), False),
    T.StructField("product_name", T.StringType(), False),
    T.StructField("load_type", T.StringType(), False),
    T.StructField("face_value", T.DecimalType(12, 2), False),
    T.StructField("markup_amount", T.DecimalType(12, 2), False),
    T.StructField("validity_days", T.IntegerType(), True),
    T.StructField("is_active", T.BooleanType(), False),
    T.StructField("source_url", T.StringType(), True),
])


def load_catalog(spark: SparkSession) -> DataFrame:
    """The seed as incoming rows for ``upsert_catalog``: markup 0, active,
    load_type defaulting to 'regular', validity 0 read as unknown."""
    rows = [
        (carrier, code, name, load_type or "regular", Decimal(face).quantize(Decimal("0.01")),
         Decimal("0.00"), validity or None, True, url)
        for carrier, code, name, load_type, face, validity, url in SEED_PRODUCTS
    ]
    return spark.createDataFrame(rows, CATALOG_INPUT_SCHEMA)
