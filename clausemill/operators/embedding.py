"""Text vectors by hashed term frequencies; a hook takes another encoder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausemill.functions.text import tokens


def embed(df: DataFrame, dims: int = 256, encoder=None) -> DataFrame:
    """Adds ``embedding`` (array of double, length one), by HashingTF and IDF unless ``encoder(df)`` is given."""
    if encoder is not None:
        return encoder(df)
    from pyspark.ml.feature import IDF, HashingTF, Normalizer
    from pyspark.ml.functions import vector_to_array

    rows = HashingTF(inputCol="_t", outputCol="_tf", numFeatures=dims).transform(df.withColumn("_t", tokens("text")))
    rows = Normalizer(inputCol="_x", outputCol="_v").transform(IDF(inputCol="_tf", outputCol="_x").fit(rows).transform(rows))
    return rows.withColumn("embedding", vector_to_array("_v")).drop("_t", "_tf", "_x", "_v")
