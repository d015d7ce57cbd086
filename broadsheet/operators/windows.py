"""Greedy windows that hang on an anchor. They are not session windows: gaps do not chain.

Sorted rows are taken in order; the first opens a window, all rows within ``span`` of it belong to it, and the first
row beyond opens the next. One key's rows are folded together in a grouped task that reads them in order in
Arrow batches and holds only the anchor, so a key with very many rows needs no more memory than others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

NULL = np.iinfo(np.int64).min


def anchored_windows(rows: DataFrame, key: str, at: str, span: int, tie: str, newest: bool = True) -> DataFrame:
    """``rows`` with ``anchor`` (the time that opens its window) and ``window_no`` (from 0) within ``key``.

    ``newest``: windows hang on their newest row and reach back; else on their oldest and reach on. Both ends are
    inclusive. Rows without a time are left out, as they belong to no window.
    """
    known = rows.where(F.col(at).isNotNull() & F.col(key).isNotNull())
    order = [F.col(key), F.desc(at) if newest else F.asc(at), F.col(tie)]

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, anchor, number = None, 0, -1
        for pdf in batches:
            keys, times = pdf[key].to_numpy(), pdf[at].to_numpy(np.int64)
            sign = -1 if newest else 1
            anchors, numbers = np.empty(len(pdf), np.int64), np.empty(len(pdf), np.int64)
            cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(pdf)] if len(pdf) else []
            for begin, end in zip(cuts[:-1], cuts[1:], strict=True):
                if now is None or keys[begin] != now:
                    now, anchor, number = keys[begin], times[begin], 0
                ordered = sign * times[begin:end]  # ascending; a step for each window, not for each row
                i = 0
                while i < len(ordered):
                    j = int(np.searchsorted(ordered, sign * anchor + span, "right"))
                    if j <= i:
                        anchor, number = times[begin + i], number + 1
                        continue
                    anchors[begin + i : begin + j], numbers[begin + i : begin + j] = anchor, number
                    i = j
            yield pdf.assign(anchor=anchors, window_no=numbers)

    schema = StructType([*known.schema.fields, StructField("anchor", LongType()), StructField("window_no", LongType())])
    return known.repartition(key).sortWithinPartitions(*order).mapInPandas(fold, schema)
