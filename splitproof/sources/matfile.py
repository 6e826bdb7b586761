"""A Python data source for HDF5 .mat slices, one partition a file. Needs h5py, which is optional."""

from __future__ import annotations

import glob
import os

try:
    from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
except ImportError:  # an older Spark
    DataSource = DataSourceReader = InputPartition = object

SCHEMA = "file string, label int, pid string, height int, width int, pixels array<int>"


class MatReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self):
        return [InputPartition(f) for f in sorted(glob.glob(os.path.join(self.path, "*.mat")))]

    def read(self, partition):
        import h5py
        import numpy as np

        with h5py.File(partition.value, "r") as f:
            g = f["cjdata"]
            image = np.array(g["image"]).T
            pid = "".join(chr(int(c)) for c in np.array(g["PID"]).ravel()).strip()
            yield (os.path.basename(partition.value), int(np.array(g["label"]).ravel()[0]), pid, *map(int, image.shape), image.ravel().astype(int).tolist())


class MatSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "matslices"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema):
        return MatReader(self.options["path"])
