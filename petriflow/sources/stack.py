"""Cubes of images: a data source of file stacks with coordinates (n, c, t, z, y), planned by file names.

Files are named <exp>_<well>_D#<day>_T<step>_<channel>.tif or .npy. The driver lists names and sizes only; wells, channels,
days, steps and places n, c, t asked for choose files before any is opened, and files go to tasks in bundles of about BUNDLE bytes, so a task holds one file at
a time. What is asked for is an argument of the read and not taken from where(): Spark 4.1 keeps the filters pushed to a Python source with the
table, so a later query of the same DataFrame without them would miss files.
"""

from __future__ import annotations

import io
import json
import re
from collections.abc import Collection, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from petriflow.sources.files import decode_tiff

SCHEMA = "n int, c int, t int, z int, y int, well string, channel string, day int, step int, v array<double>"
NAME = re.compile(r"_(?P<well>[A-H]\d\d)_.*?D#(?P<day>\d+)_T(?P<step>\d+)_(?P<channel>C\d+)\.(?:tiff?|npy)$")
BUNDLE = 64 << 20
_ARROW = pa.schema([*[(c, pa.int32()) for c in ("n", "c", "t", "z", "y")], ("well", pa.string()), ("channel", pa.string()), ("day", pa.int32()), ("step", pa.int32()), ("v", pa.list_(pa.float64()))])


@dataclass
class Bundle(InputPartition):
    files: list[dict]


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path else "file://" + path)


def listed(path: str) -> list[dict]:
    """Named files below a folder with their coordinates: n, c and t number the wells, the channels and the (day, step) of all of them, in order."""
    system, root = opened(path)
    found = []
    for info in system.get_file_info(fs.FileSelector(root, recursive=True)):
        name = NAME.search(info.base_name) if info.type == fs.FileType.File else None
        if name:
            g = name.groupdict()
            found.append({"path": info.path, "size": info.size, "well": g["well"], "channel": g["channel"], "day": int(g["day"]), "step": int(g["step"])})
    for axis, of in (("n", lambda f: f["well"]), ("c", lambda f: f["channel"]), ("t", lambda f: (f["day"], f["step"]))):
        place = {v: k for k, v in enumerate(sorted({of(f) for f in found}))}
        for f in found:
            f[axis] = place[of(f)]
    found.sort(key=lambda f: (f["n"], f["c"], f["t"], f["path"]))
    for before, f in zip(found, found[1:]):
        if (before["n"], before["c"], before["t"]) == (f["n"], f["c"], f["t"]):
            raise ValueError(f"two files for one place of the cube: {before['path']}, {f['path']}")
    return found


class StackReader(DataSourceReader):
    def __init__(self, path: str, bundle: int, only: dict[str, list]):
        self.path, self.bundle, self.only = path, bundle, {c: set(v) for c, v in only.items()}

    def partitions(self) -> list[Bundle]:
        out, size = [], 0
        for f in listed(self.path):
            if any(f[c] not in values for c, values in self.only.items()):
                continue
            if not out or size + f["size"] > self.bundle:
                out.append(Bundle([]))
                size = 0
            out[-1].files.append(f)
            size += f["size"]
        return out

    def read(self, partition: Bundle | None) -> Iterator[pa.RecordBatch]:
        system, _ = opened(self.path)
        for f in partition.files if partition else []:
            with system.open_input_stream(f["path"]) as stream:
                raw = stream.read()
            image = np.load(io.BytesIO(raw), allow_pickle=False) if f["path"].endswith(".npy") else decode_tiff(raw)
            for z, page in enumerate(image if image.ndim == 3 else image[None]):
                h, w = page.shape
                rows = pa.ListArray.from_arrays(pa.array(np.arange(h + 1, dtype=np.int32) * w), pa.array(page.astype(np.float64).ravel()))
                same = [pa.array(np.full(h, v, np.int32)) for v in (f["n"], f["c"], f["t"], z)]
                names = [pa.array([f[c]] * h, pa.string()) for c in ("well", "channel")]
                when = [pa.array(np.full(h, f[c], np.int32)) for c in ("day", "step")]
                yield pa.RecordBatch.from_arrays([*same, pa.array(np.arange(h, dtype=np.int32)), *names, *when, rows], schema=_ARROW)


class StackSource(DataSource):
    """Options: path, a folder that driver and executors share; bundle, bytes of files for a task; only, a JSON object of columns and their values."""

    @classmethod
    def name(cls) -> str:
        return "image_stack"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> StackReader:
        return StackReader(self.options["path"], int(self.options.get("bundle", BUNDLE)), json.loads(self.options.get("only", "{}")))


def read_stack(spark: SparkSession, path: str, bundle: int = BUNDLE, **only: Collection) -> DataFrame:
    """A row for each line y of each page z of each file, `v` its numbers along x. A cube may lack files; a place with two raises ValueError.

    only: values of well, channel, day, step, n, c or t; other files are not opened, and places are those among all files all the same."""
    if unknown := only.keys() - {"well", "channel", "day", "step", "n", "c", "t"}:
        raise ValueError(f"files can't be chosen by {sorted(unknown)}")
    spark.dataSource.register(StackSource)
    asked = json.dumps({c: list(v) for c, v in only.items()})
    return spark.read.format("image_stack").option("path", path).option("bundle", bundle).option("only", asked).load()


def stack_stats(stack: DataFrame) -> DataFrame:
    """(n, c, mean, std): of all numbers of a well and channel (std of the population); lines are summed up before anything is shuffled."""
    total = lambda f: F.aggregate("v", F.lit(0.0), f)
    lines = stack.select("n", "c", F.size("v").alias("m"), total(lambda a, x: a + x).alias("s"))
    mean = lines.groupBy("n", "c").agg((F.sum("s") / F.sum("m")).alias("mean"))
    away = stack.join(mean, ["n", "c"]).select("n", "c", "mean", F.size("v").alias("m"), F.aggregate("v", F.lit(0.0), lambda a, x: a + (x - F.col("mean")) ** 2).alias("q"))
    return away.groupBy("n", "c", "mean").agg(F.sqrt(F.sum("q") / F.sum("m")).alias("std"))


def standardize_stack(stack: DataFrame) -> DataFrame:
    """The stack with `v` less the mean, over the standard deviation of its well and channel; 0 where that is 0."""
    v = F.transform("v", lambda x: F.when(F.col("std") > 0, (x - F.col("mean")) / F.col("std")).otherwise(0.0))
    return stack.join(stack_stats(stack), ["n", "c"]).withColumn("v", v).select(stack.columns)
