"""Running totals inside an array, for offsets."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.arrow_udf(T.ArrayType(T.IntegerType()))
def running_total(lengths: pa.Array) -> pa.Array:
    """Cumulative sum within every row of a list column, on the flat values of the batch."""
    lengths = lengths.cast(pa.list_(pa.int32()))
    offsets = np.asarray(lengths.offsets).astype(np.int64)
    values = np.asarray(lengths.values).astype(np.int64)
    summed = np.concatenate([[0], np.cumsum(values)])
    starts = np.repeat(summed[offsets[:-1]], np.diff(offsets))
    inside = summed[offsets[0] + 1 : offsets[-1] + 1] - starts
    return pa.ListArray.from_arrays(pa.array(offsets - offsets[0], pa.int32()), pa.array(inside, pa.int32()))
