"""Kinds of columns (text, image, class_label, ...) as Spark fields with metadata, with their checks and casts."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import types as T

from versalake.errors import TypeMismatch

#: Unsigned integers have no type of their own in Spark: the next wider one holds them, metadata keep the name.
DTYPES = {
    "bool": T.BooleanType(), "int8": T.ByteType(), "int16": T.ShortType(), "int32": T.IntegerType(), "int64": T.LongType(),
    "uint8": T.ShortType(), "uint16": T.IntegerType(), "uint32": T.LongType(), "uint64": T.DecimalType(20, 0),
    "float16": T.FloatType(), "float32": T.FloatType(), "float64": T.DoubleType(), "str": T.StringType(),
    "bytes": T.BinaryType(), "date": T.DateType(), "timestamp": T.TimestampType(),
}
ALIASES = {"int": "int64", "long": "int64", "float": "float64", "double": "float64", "str_": "str", "string": "str", "boolean": "bool", "bool_": "bool"}
BOUNDS = {"uint8": (0, 2**8 - 1), "uint16": (0, 2**16 - 1), "uint32": (0, 2**32 - 1), "uint64": (0, 2**64 - 1)}


def nested(element: T.DataType, levels: int) -> T.DataType:
    for _ in range(levels):
        element = T.ArrayType(element)
    return element


@dataclass(frozen=True)
class Kind:
    """dtype: the default element type; levels: array levels around it; None: follows the data."""

    dtype: str | None = None
    levels: int | None = 0
    spark: T.DataType | None = None
    keys: tuple[str, ...] = ()
    ndim: tuple[int, ...] = ()
    last: tuple[int, ...] = ()
    fixed_dtype: bool = False
    compressions: tuple[str, ...] = ()


_MEDIA = T.BinaryType()
IMAGES = ("bmp", "dib", "gif", "ico", "jpeg", "jpg", "jpeg2000", "pcx", "png", "ppm", "sgi", "tga", "tiff", "webp", "wmf", "xbm", "dcm", "mpo", "fli")
KINDS: dict[str, Kind] = {
    "generic": Kind(None, None),
    "image": Kind("uint8", spark=_MEDIA, ndim=(2, 3), compressions=IMAGES),
    "image.rgb": Kind("uint8", spark=_MEDIA, ndim=(2, 3), compressions=IMAGES),
    "image.gray": Kind("uint8", spark=_MEDIA, ndim=(2, 3), compressions=IMAGES),
    "class_label": Kind("int32", 0, keys=("class_names",)),
    "bbox": Kind("float32", 2, keys=("coords",), last=(4,)),
    "bbox.3d": Kind("float32", 2, keys=("coords",), last=(8,)),
    "audio": Kind("float64", spark=_MEDIA, compressions=("mp3", "flac", "wav")),
    "video": Kind("uint8", spark=_MEDIA, compressions=("mp4", "mkv", "avi")),
    "embedding": Kind("float32", 1, fixed_dtype=True),
    "vector": Kind("float32", 1, keys=("dimension",)),
    "binary_mask": Kind("bool", 2, ndim=(2, 3)),
    "segment_mask": Kind("uint32", 2, keys=("class_names",), ndim=(2, 3)),
    "instance_label": Kind("uint32", 2),
    "keypoints_coco": Kind("int32", 2, keys=("keypoints", "connections")),
    "point": Kind("int32", 2, last=(2, 3)),
    "polygon": Kind("float32", 3),
    "point_cloud": Kind("float32", 2),
    "intrinsics": Kind("float32", 2),
    "json": Kind(None, spark=T.StringType()),
    "list": Kind("str", 1),
    "text": Kind("str", 0),
    "dicom": Kind("uint8", spark=_MEDIA, compressions=("dcm",)),
    "nifti": Kind("uint8", spark=_MEDIA, compressions=("nii", "nii.gz")),
    "mesh": Kind(None, spark=_MEDIA, compressions=("ply",)),
}


@dataclass
class Column:
    """A column's definition as the commit log keeps it."""

    name: str
    htype: str = "generic"
    dtype: str | None = None
    levels: int | None = None
    info: dict = field(default_factory=dict)
    compression: str | None = None
    hidden: bool = False
    key: str | None = None  # the name in the files; stays when the column is renamed

    def __post_init__(self):
        self.key = self.key or self.name
        if self.htype not in KINDS:
            raise TypeMismatch(f"unknown htype {self.htype!r}")
        kind = KINDS[self.htype]
        self.dtype = ALIASES.get(self.dtype, self.dtype) or kind.dtype
        self.levels = kind.levels if self.levels is None else self.levels
        if kind.fixed_dtype and self.dtype != kind.dtype:
            raise TypeMismatch(f"{self.htype} must have dtype {kind.dtype}, not {self.dtype}")
        if self.dtype is not None and self.dtype not in DTYPES:
            raise TypeMismatch(f"unknown dtype {self.dtype!r}")
        if self.compression and kind.compressions and self.compression not in kind.compressions:
            raise TypeMismatch(f"{self.htype} has no compression {self.compression!r}")

    @property
    def known(self) -> bool:
        """False until the first data or an explicit dtype decide."""
        return KINDS[self.htype].spark is not None or (self.dtype is not None and self.levels is not None)

    def spark_type(self) -> T.DataType:
        kind = KINDS[self.htype]
        if kind.spark is not None:
            return kind.spark
        return nested(DTYPES[self.dtype or "str"], self.levels or 0)

    def field(self) -> T.StructField:
        meta = {"htype": self.htype, "dtype": self.dtype or "", "hidden": self.hidden, "compression": self.compression or ""}
        return T.StructField(self.name, self.spark_type(), True, meta | {k: json.dumps(v) for k, v in self.info.items()})

    def learn(self, value) -> None:
        """Fixes the type by the first value that isn't None."""
        if self.known or value is None:
            return
        found = infer(value)
        if self.htype == "generic" and found[0] in ("text", "json", "list"):
            self.htype = found[0]
            self.dtype, self.levels = KINDS[found[0]].dtype, KINDS[found[0]].levels
        else:
            self.dtype, self.levels = self.dtype or found[1], found[2]

    def check(self, value):
        """The value as it is stored, or TypeMismatch. None stays None: an empty sample."""
        if value is None:
            return None
        kind = KINDS[self.htype]
        if self.htype == "json":
            return value if isinstance(value, str) and _is_json(value) else json.dumps(value, ensure_ascii=False)
        if kind.spark == _MEDIA:
            if isinstance(value, (bytes, bytearray, memoryview)):
                return bytes(value)
            array = np.asarray(value)
            if kind.ndim and array.ndim not in kind.ndim:
                raise TypeMismatch(f"{self.name}: {self.htype} has {kind.ndim} dimensions, not {array.ndim}")
            return array.tobytes()
        if self.htype == "text":
            if not isinstance(value, str):
                raise TypeMismatch(f"{self.name}: text, not {type(value).__name__}")
            return value
        if self.htype == "list":
            return [str(v) for v in value]
        if self.htype == "class_label" and isinstance(value, str):
            names = self.info.setdefault("class_names", [])
            if value not in names:
                names.append(value)
            return names.index(value)
        if kind.last or kind.ndim:
            array = np.asarray(value)
            if kind.last and array.size and array.shape[-1] not in kind.last:
                raise TypeMismatch(f"{self.name}: the last axis of {self.htype} is {kind.last}, not {array.shape[-1]}")
            if kind.ndim and array.ndim not in kind.ndim:
                raise TypeMismatch(f"{self.name}: {self.htype} has {kind.ndim} dimensions, not {array.ndim}")
        if self.htype == "vector" and "dimension" in self.info and len(value) != self.info["dimension"]:
            raise TypeMismatch(f"{self.name}: dimension {self.info['dimension']}, not {len(value)}")
        return _cast(value, self.dtype, self.levels, self.name)


def _is_json(text: str) -> bool:
    try:
        json.loads(text)
        return True
    except ValueError:
        return False


def _cast(value, dtype: str | None, levels: int | None, name: str):
    if isinstance(value, np.ndarray):
        value = value.tolist()
    if isinstance(value, np.generic):
        value = value.item()
    if levels:
        if isinstance(value, (str, bytes)) or not isinstance(value, Sequence):
            raise TypeMismatch(f"{name}: an array, not {type(value).__name__}")
        return [_cast(v, dtype, levels - 1, name) for v in value]
    if value is None:
        return None
    if isinstance(value, (list, tuple)):
        if len(value) == 1:
            return _cast(value[0], dtype, 0, name)
        raise TypeMismatch(f"{name}: one value, not {len(value)}")
    try:
        if dtype == "str":
            if not isinstance(value, str):
                raise TypeMismatch(f"{name}: text, not {type(value).__name__}")
            return value
        if dtype == "bool":
            if not isinstance(value, (bool, int)) or int(value) not in (0, 1):
                raise TypeMismatch(f"{name}: true or false, not {value!r}")
            return bool(value)
        if dtype and dtype.startswith(("int", "uint")):
            if isinstance(value, str) or float(value) != int(value):
                raise TypeMismatch(f"{name}: {dtype}, not {value!r}")
            bits = int(dtype.lstrip("uint"))
            low, high = BOUNDS.get(dtype, (-(2 ** (bits - 1)), 2 ** (bits - 1) - 1))
            if not low <= int(value) <= high:
                raise TypeMismatch(f"{name}: {value!r} is outside {dtype}")
            return int(value)
        if dtype and dtype.startswith("float"):
            if isinstance(value, str):
                raise TypeMismatch(f"{name}: {dtype}, not text")
            return float(value)
    except (TypeError, ValueError, OverflowError) as error:
        raise TypeMismatch(f"{name}: {value!r} is no {dtype}") from error
    return value


def infer(value) -> tuple[str, str | None, int]:
    """(htype, dtype, levels) of a value."""
    if isinstance(value, dict):
        return "json", None, 0
    if isinstance(value, str):
        return "text", "str", 0
    if isinstance(value, (bytes, bytearray)):
        return "generic", "bytes", 0
    if isinstance(value, (np.ndarray, np.generic)):
        if value.dtype.kind in "US":
            return ("text", "str", 0) if value.ndim == 0 else ("list", "str", 1)
        if value.dtype.kind == "O":
            return "json", None, 0
        return "generic", value.dtype.name, value.ndim
    if isinstance(value, (list, tuple)):
        if any(isinstance(v, dict) for v in value):
            return "json", None, 0
        inner = infer(value[0]) if value else ("generic", "float64", 0)
        if inner[0] == "text":
            return "list", "str", 1
        if inner[1] == "int64" and any(isinstance(v, float) for v in value):
            inner = (inner[0], "float64", inner[2])
        return inner[0], inner[1], inner[2] + 1
    if isinstance(value, bool):
        return "generic", "bool", 0
    if isinstance(value, int):
        return "generic", "int64", 0
    if isinstance(value, float):
        return "generic", "float64", 0
    if hasattr(value, "hour"):
        return "generic", "timestamp", 0
    if hasattr(value, "year"):
        return "generic", "date", 0
    raise TypeMismatch(f"no type for {type(value).__name__}")


def of_spark(field: T.StructField) -> Column:
    """The definition of a DataFrame's column; metadata of ours win."""
    meta = field.metadata or {}
    names = {v.simpleString(): k for k, v in reversed(DTYPES.items())}
    inner, levels = field.dataType, 0
    while isinstance(inner, T.ArrayType):
        inner, levels = inner.elementType, levels + 1
    info = {k: json.loads(v) for k, v in meta.items() if k not in ("htype", "dtype", "hidden", "compression") and isinstance(v, str)}
    if meta.get("htype"):
        return Column(field.name, meta["htype"], meta.get("dtype") or None, levels, info, meta.get("compression") or None, bool(meta.get("hidden")))
    if isinstance(inner, T.StringType):
        return Column(field.name, "list" if levels == 1 else "text", "str", levels)
    if isinstance(inner, (T.StructType, T.MapType, T.VariantType)):
        return Column(field.name, "json")
    if isinstance(inner, T.DecimalType):
        return Column(field.name, "generic", "float64", levels)
    return Column(field.name, "generic", names.get(inner.simpleString(), "str"), levels)
