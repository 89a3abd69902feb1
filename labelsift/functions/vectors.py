"""Sparse feature vectors for Spark ML.

Spark SQL has no expression that builds an ML ``SparseVector``; ``with_vectors``
builds the vector column's storage (type, size, indices, values) from the
arrays of the TF-IDF operators in whole Arrow batches -- no Python object per
row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import DataFrame
from pyspark.sql import types as T


def with_vectors(df: DataFrame, size: int, out: str = "features") -> DataFrame:
    """``df`` with its ``indices`` and ``values`` arrays replaced by one vector
    column of ``size``; null arrays are empty vectors."""
    cols = [c for c in df.columns if c not in ("indices", "values")]

    def run(batches):
        for b in batches:
            m = b.num_rows
            ind, val = (b.column(c).fill_null([]) if b.column(c).null_count else b.column(c)
                        for c in ("indices", "values"))
            vec = pa.StructArray.from_arrays(
                [pa.array(np.zeros(m, np.int8)), pa.array(np.full(m, size, np.int32)), ind, val],
                names=["type", "size", "indices", "values"])
            yield pa.record_batch([b.column(c) for c in cols] + [vec], names=[*cols, out])

    schema = T.StructType([df.schema[c] for c in cols]).add(out, VectorUDT())
    return df.select(*cols, "indices", "values").mapInArrow(run, schema)
