"""Boxes: a resource's JSON object maps its copies' barcodes to the barcode of the box that holds them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfspark.functions.copies import exploded
from shelfspark.functions.text import falsy


def entries(media: DataFrame) -> DataFrame:
    """id, barcode, boxBarcode: entries with a non-blank string value; text that is no JSON object has none.

    An object's last entry wins where a key repeats.
    """
    m = media.select("id", "resourceBox").where("resourceBox is not null and resourceBox <> ''")
    m = m.withColumn("m", F.expr("from_json(resourceBox, 'map<string,variant>')")).where("m is not null")
    last = "filter(map_entries(m), (e, i) -> i = size(m) - array_position(reverse(map_keys(m)), e.key))"
    e = m.selectExpr("id", f"inline({last})")
    return e.where("schema_of_variant(value) = 'STRING'").selectExpr("id", "key as barcode", "cast(value as string) as boxBarcode").where("boxBarcode <> ''")


def containing(media: DataFrame, catalogue: DataFrame | None = None, ordinal: str = "title") -> DataFrame:
    """id, barcode, boxBarcode, boxTitle; the title of the catalogue's first resource with that copy, or the barcode if there is none.

    catalogue: where boxes are looked up, if not in media itself. ordinal: its column by which rows of one id are in order.
    """
    own = exploded(media if catalogue is None else catalogue, "K2", "id", "title", F.col(ordinal).alias("nth")).groupBy("copy").agg(F.min_by("title", F.when(F.col("id").isNotNull(), F.struct("id", "nth"))).alias("found"))
    e = entries(media)
    return e.join(own, F.col("copy") == F.col("boxBarcode"), "left").select("id", "barcode", "boxBarcode", falsy("found", F.col("boxBarcode")).alias("boxTitle"))
