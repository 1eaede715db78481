"""Names of the functions for use in SQL."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import text


def register(spark: SparkSession) -> list[str]:
    """Registers the Arrow functions and the page-splitting table function; returns their names."""
    from ..operators import nlp

    for name, f in (("normalise_text", text.normalise), ("extract_entities", nlp.extract_entities), ("extract_relations", nlp.extract_relations)):
        spark.udf.register(name, f)
    spark.udtf.register("split_double_page", _page_splitter())
    return ["normalise_text", "extract_entities", "extract_relations", "split_double_page"]


def _page_splitter():
    schema = T.StructType([T.StructField("side", T.StringType()), T.StructField("height", T.IntegerType()), T.StructField("width", T.IntegerType()), T.StructField("pixels", T.BinaryType())])

    class SplitDoublePage:
        """Two rows of a double page, one of any other: (side, height, width, pixels)."""

        def eval(self, height: int, width: int, pixels: bytes):
            import numpy as np

            from scriptorium.operators import image

            page = np.frombuffer(pixels, np.uint8).reshape(height, width)
            parts = zip(("left", "right"), image.split_double(page), strict=True) if image.is_double(height, width) else [("whole", page)]
            for side, x in parts:
                yield side, x.shape[0], x.shape[1], x.tobytes()

    return F.udtf(SplitDoublePage, returnType=schema)
