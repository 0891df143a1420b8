"""Text to vector: hashed word features by default, any encoder on request."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
from pyspark.ml.feature import CountVectorizerModel, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gatelens import settings as cfg


def embed(
    df: DataFrame,
    text: str = "text",
    encoder: Callable[[], Callable[[list[str]], object]] | None = None,
    dim: int = cfg.EMBEDDING_DIM,
    out: str = "vector",
) -> DataFrame:
    """Add a unit vector per text.

    Without an encoder, words and word pairs are hashed into ``dim`` counters
    inside the JVM, by the first 32 bits of their MD5.  ``encoder`` is a factory,
    called once per Python worker,
    for a function from a list of texts to a (rows, dim) array.
    """
    if encoder is not None:
        return _encode(df, text, encoder, out)
    words = F.regexp_extract_all(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1))
    pairs = F.zip_with(
        F.slice("__w", 1, F.greatest(F.size("__w") - 1, F.lit(0))),
        F.slice("__w", 2, F.size("__w")),
        lambda a, b: F.concat(a, F.lit(" "), b),
    )
    features = df.withColumn("__w", words).withColumn("__f", F.concat("__w", pairs))
    bucket = F.transform(
        "__f", lambda f: (F.conv(F.substring(F.md5(f), 1, 8), 16, 10).cast("long") % dim).cast("string")
    )
    counter = CountVectorizerModel.from_vocabulary([str(b) for b in range(dim)], inputCol="__f", outputCol="__tf")
    hashed = counter.transform(features.withColumn("__f", bucket))
    unit = Normalizer(inputCol="__tf", outputCol="__unit", p=2.0).transform(hashed)
    return unit.withColumn(out, vector_to_array("__unit", "float32")).drop(
        "__w", "__f", "__tf", "__unit"
    )


def _encode(df: DataFrame, text: str, encoder, out: str) -> DataFrame:
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.ArrayType(T.FloatType()))])

    def run(batches: Iterator):
        encode = encoder()
        for batch in batches:
            vectors = np.asarray(encode(batch[text].fillna("").tolist()), np.float32)
            yield batch.assign(**{out: list(vectors)})

    return df.mapInPandas(run, schema)
