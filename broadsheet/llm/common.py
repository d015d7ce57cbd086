"""What the corpus operators share: the shared folder, written tables and safe column names."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: The characters that end a word in most contracts: U+0020 and U+0009 to U+000D.
BLANKS = "\x20\x09\x0a\x0b\x0c\x0d"
WORD = re.compile(r"[^\x20\x09-\x0D]+")

#: Bytes that one cache of a Python worker may take, and rows of text that are sent to one at once.
CACHE_BYTES, TEXT_ROWS = 48_000_000, 1_000

_own_dir: dict[str, str] = {}
#: Tables saved within ``passing``; the last list is the innermost's.
_made: list[list[DataFrame]] = []


class BoundedCache(dict):
    """What ``make`` says of a string or bytes, within about ``most`` bytes.

    It has two generations: when the younger has taken half, it becomes the elder and the elder goes; what is asked
    for again comes over from there. So what is frequent stays.
    """

    def __init__(self, make: Callable, most: int = CACHE_BYTES):
        super().__init__()
        self.make, self.most, self.held, self.elder = make, most // 2, 0, {}

    def __missing__(self, key):
        value = self.elder.get(key)
        if value is None:
            value = self.make(key)
        if len(key) <= 256:
            # a slot, the key's and the value's objects, and what they hold
            self.held += 200 + len(key) + (len(value) if isinstance(value, bytes) else 0)
            if self.held > self.most:
                self.elder, self.held = dict(self), 0
                self.clear()
            self[key] = value
        return value


def text_batches(df: DataFrame) -> DataFrame:
    """``df``, whose texts go to Python workers in batches of at most TEXT_ROWS rows: a text may be long, and a batch stands in memory several times."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(name)) <= TEXT_ROWS:
        conf.set(name, str(TEXT_ROWS))
    return df


def task_over(*built) -> None:
    """Give back what a task's end leaves unused: a worker lives on and its next task may be another operator's. ``built``: functions with an lru_cache."""
    for f in built:
        f.cache_clear()
    gc.collect()
    pa.default_memory_pool().release_unused()


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: ``spark.checkpoint.dir``.

    Only where that is unset in a local session, as in tests, a temporary folder of this machine serves; on a
    cluster that is an error, as executors would write to disks of their own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not re.match(r"local(\[[^,\]]*(,[^\]]*)?\])?$", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if "dir" not in _own_dir:
        _own_dir["dir"] = "file://" + tempfile.mkdtemp(prefix="broadsheet-")
    return _own_dir["dir"]


def new_path(spark: SparkSession, kind: str) -> str:
    return f"{shared_dir(spark)}/broadsheet-{kind}-{uuid.uuid4().hex}"


def saved(df: DataFrame, kind: str = "table") -> DataFrame:
    """Write ``df`` to the shared folder and read it again: it cuts the lineage and outlives executors."""
    spark = df.sparkSession
    path = new_path(spark, kind)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._broadsheet_path = path  # type: ignore[attr-defined]
    if _made:
        _made[-1].append(out)
    return out


@contextmanager
def passing(*kept: str) -> Iterator[None]:
    """Tables saved inside go at the end, all but those of the named kinds: what is computed there must be saved or collected there, too."""
    _made.append([])
    try:
        yield
    finally:
        for df in _made.pop():
            if not any(f"/broadsheet-{kind}-" in df._broadsheet_path for kind in kept):
                dropped(df)


def dropped(df: DataFrame) -> None:
    """Delete the files of a table made by ``saved`` that nothing reads any more."""
    path = getattr(df, "_broadsheet_path", None)
    if path:
        spark = df.sparkSession
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def fresh(columns: Iterable[str], name: str) -> str:
    """A column name that clashes with none of ``columns`` (names are compared without case)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name
