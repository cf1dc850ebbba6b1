"""A history of resume states that only grows: every save is an entry of its own, and none replaces another.

An entry is written aside and becomes one by a single rename, so that a crash leaves the entries there were. The
newest complete entry counts. Entries are numbered; of two that are committed at once, one gets the number and the
other takes the next.
"""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packloom.sources.state import STATE_SCHEMA, ResumeState, _state, save_state

_ENTRY = "entry-"
# Digits of an entry's number: names sort as the numbers do.
_DIGITS = 12


def _files(spark: SparkSession, path: str):
    """The file system of a log, and a maker of paths in it."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    system = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return system, lambda name: jvm.org.apache.hadoop.fs.Path(root, name)


def entries(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the complete entries, ascending. One directory listing; nothing is opened."""
    system, place = _files(spark, path)
    root = place(".")
    if not system.exists(root):
        return []
    names = [status.getPath().getName() for status in system.listStatus(root)]
    return sorted(int(n.removeprefix(_ENTRY)) for n in names if n.startswith(_ENTRY) and n.removeprefix(_ENTRY).isdigit())


def write_aside(spark: SparkSession, state: ResumeState, path: str) -> str:
    """First half of ``append``: the state under a name that no reader looks at; that name."""
    name = f"_writing-{uuid.uuid4().hex}"
    save_state(spark, state, f"{path.rstrip('/')}/{name}")
    return name


def rename_once(spark: SparkSession, path: str, name: str, to: str) -> bool:
    """Rename ``name`` in the folder ``path`` to ``to``; False, and nothing changed, if that is there already."""
    system, place = _files(spark, path)
    context = spark.sparkContext
    source, target = (system.makeQualified(place(n)) for n in (name, to))
    # A rename that fails where the target exists; FileSystem's own would move into it.
    files = context._jvm.org.apache.hadoop.fs.FileContext.getFileContext(source.toUri(), context._jsc.hadoopConfiguration())
    kinds = getattr(context._jvm.org.apache.hadoop.fs, "Options$Rename")
    options = context._gateway.new_array(kinds, 1)
    options[0] = kinds.NONE
    try:
        files.rename(source, target, options)
    except Py4JJavaError:
        if not system.exists(target):
            raise
        return False
    return True


def commit(spark: SparkSession, name: str, path: str) -> int:
    """Second half of ``append``: what ``write_aside`` wrote becomes the next entry; its number."""
    system, place = _files(spark, path)
    if not system.exists(place(name)):
        raise FileNotFoundError(f"{name} is not in {path}")
    while True:
        number = max(entries(spark, path), default=-1) + 1
        if rename_once(spark, path, name, f"{_ENTRY}{number:0{_DIGITS}d}"):
            return number


def append(spark: SparkSession, state: ResumeState, path: str) -> int:
    """Save a state at the end of the log at ``path``; its number."""
    return commit(spark, write_aside(spark, state, path), path)


def history(spark: SparkSession, path: str) -> DataFrame:
    """All entries: ``entry`` and the fields of the states."""
    found = entries(spark, path)
    if not found:
        return spark.createDataFrame([], f"entry long, {STATE_SCHEMA}")
    # The entries there are now, so that one written meanwhile is in the result whole or not at all.
    paths = [f"{path.rstrip('/')}/{_ENTRY}{n:0{_DIGITS}d}" for n in found]
    number = F.regexp_extract(F.col("_metadata.file_path"), rf"{_ENTRY}(\d+)/[^/]*$", 1).cast("long").alias("entry")
    return spark.read.schema(STATE_SCHEMA).json(paths).select(number, "*")


def latest(spark: SparkSession, path: str, step: int | None = None) -> ResumeState | None:
    """The newest state, or the newest of a training step; ``None`` if there is none."""
    if step is None:
        newest = max(entries(spark, path), default=None)
        if newest is None:
            return None
        row = spark.read.schema(STATE_SCHEMA).json(f"{path.rstrip('/')}/{_ENTRY}{newest:0{_DIGITS}d}").first()
    else:
        row = history(spark, path).where(F.col("step") == step).orderBy(F.desc("entry")).first()
    return None if row is None else _state(row)


def clear_aside(spark: SparkSession, path: str) -> int:
    """Delete what saves that never committed have left; how many. Not while a save is going on."""
    system, place = _files(spark, path)
    root = place(".")
    names = [s.getPath().getName() for s in system.listStatus(root)] if system.exists(root) else []
    aside = [n for n in names if n.startswith("_writing-")]
    for name in aside:
        system.delete(place(name), True)
    return len(aside)
