"""Versioned, multimodal tables on Spark: a thin, lazy layer over DataFrames and Parquet."""

from versalake.dataset import Dataset, Tensor, dataset, delete, empty, exists, get_col_info, like, load
from versalake.operators.transform import Pipeline, compose, compute
from versalake.sources.imports import tiled


def read(path: str, spark=None):
    """A media file's bytes as a lazy row (path, content)."""
    from versalake.dataset import _session
    from versalake.sources.imports import read_media

    return read_media(_session(spark), path)


def from_csv(csv_path: str, path: str, schema=None, path_columns=None, spark=None, **_) -> Dataset:
    """A new dataset from a CSV file."""
    ds = empty(path, spark=spark)
    ds.add_data_from_csv(csv_path, schema, path_columns)
    return ds


def from_file(ori_path: str, path: str, schema=None, spark=None, **_) -> Dataset:
    """A new dataset from JSON lines."""
    ds = empty(path, spark=spark)
    ds.add_data_from_file(ori_path, schema)
    return ds


def from_dataframes(dataframes, path: str, schema=None, spark=None, **_) -> Dataset:
    """A new dataset from records."""
    ds = empty(path, spark=spark)
    ds.add_data(dataframes, schema)
    return ds


__all__ = ["Dataset", "Pipeline", "Tensor", "compose", "compute", "dataset", "delete", "empty", "exists", "from_csv", "from_dataframes", "from_file", "get_col_info", "like", "load", "read", "tiled"]
__version__ = "0.1.0"
