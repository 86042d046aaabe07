"""MAT files of level 5, read and written: the public format of tagged elements, each in a zlib stream or plain.

A file is a row: `stem` and `variables`, an array of (name, kind, shape, values). Values stand row by row, whatever the file's
order of columns. Reading goes through Spark's binary files, so it reaches every store that Spark reaches; writing is a
data source whose tasks write a file a row.
"""

from __future__ import annotations

import posixpath
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from labelloom.functions.scalar import stem

#: Fixed values of the format: element types and array classes, as numpy kinds.
ELEMENTS = {1: "i1", 2: "u1", 3: "i2", 4: "u2", 5: "i4", 6: "u4", 7: "f4", 9: "f8", 12: "i8", 13: "u8"}
CLASSES = {6: "f8", 7: "f4", 8: "i1", 9: "u1", 10: "i2", 11: "u2", 12: "i4", 13: "u4", 14: "i8", 15: "u8"}
MATRIX, COMPRESSED = 14, 15

VARIABLES = "array<struct<name:string,kind:string,shape:array<int>,values:array<double>>>"


def _elements(data: bytes | memoryview, order: str) -> Iterator[tuple[int, memoryview]]:
    """(type, contents) of the elements that stand one after another."""
    data, at = memoryview(data), 0
    while at + 8 <= len(data):
        kind, size = struct.unpack_from(order + "II", data, at)
        if kind >> 16:  # a small one: its size stands beside its type, four bytes of contents behind them
            kind, size, start, after = kind & 0xFFFF, kind >> 16, at + 4, at + 8
        else:
            start = at + 8
            # compressed elements alone are not filled up to eight bytes
            after = start + size + (0 if kind == COMPRESSED else -size % 8)
        if start + size > len(data):
            raise ValueError("the file ends within an element")
        yield kind, data[start : start + size]
        at = after


def _array(contents: memoryview, order: str) -> tuple[str, np.ndarray] | None:
    """Name and values of a matrix element; None for what is no array of real numbers."""
    parts = _elements(contents, order)
    (_, flags), (_, dims), (_, name) = (next(parts) for _ in range(3))
    head = struct.unpack_from(order + "I", flags)[0]
    kind, is_complex = head & 0xFF, head & 0x800
    if kind not in CLASSES or is_complex:
        return None
    shape = np.frombuffer(dims, order + "i4")
    stored, real = next(parts, (9, memoryview(b"")))
    values = np.frombuffer(real, order + ELEMENTS[stored]).astype(CLASSES[kind])
    if values.size != int(np.prod(shape)):
        raise ValueError("an array's values do not fill its shape")
    return bytes(name).decode("latin-1"), values.reshape(shape, order="F")


def decode(data: bytes) -> dict[str, np.ndarray]:
    """Arrays of real numbers by name, of either byte order; text, cells, structs and complex arrays are passed over."""
    if len(data) < 128 or data[126:128] not in (b"IM", b"MI"):
        raise ValueError("not a MAT file of level 5")
    order = "<" if data[126:128] == b"IM" else ">"
    if struct.unpack(order + "H", data[124:126])[0] != 0x0100:
        raise ValueError("a MAT file of another level")
    found = {}
    for kind, contents in _elements(memoryview(data)[128:], order):
        inner = _elements(zlib.decompress(contents), order) if kind == COMPRESSED else [(kind, contents)]
        for kind_, contents_ in inner:
            if kind_ == MATRIX and len(contents_) and (one := _array(contents_, order)) is not None:
                found[one[0]] = one[1]
    return found


def _element(kind: int, data: bytes) -> bytes:
    return struct.pack("<II", kind, len(data)) + data + b"\0" * (-len(data) % 8)


def encode(arrays: dict[str, np.ndarray], compress: bool = True) -> bytes:
    """A file of arrays of real numbers; those of under two dimensions become columns."""
    out = [b"MATLAB 5.0 MAT-file".ljust(116) + b"\0" * 8 + struct.pack("<H", 0x0100) + b"IM"]
    classes, elements = ({v: k for k, v in t.items()} for t in (CLASSES, ELEMENTS))
    for name, array in arrays.items():
        array = np.asarray(array)
        array = array.reshape(-1, 1) if array.ndim < 2 else array
        kind = array.dtype.str[1:]
        parts = _element(6, struct.pack("<II", classes[kind], 0)) + _element(5, np.array(array.shape, "<i4").tobytes()) + _element(1, name.encode("latin-1"))
        whole = _element(MATRIX, parts + _element(elements[kind], array.astype("<" + kind).tobytes(order="F")))
        packed = zlib.compress(whole) if compress else whole
        out.append(struct.pack("<II", COMPRESSED, len(packed)) + packed if compress else whole)
    return b"".join(out)


def read_mat(spark: SparkSession, path: str, names: list[str] | None = None) -> DataFrame:
    """stem, path, variables of the files of a folder. names: the only variables wanted. A task holds one file at a time; a file that is none ends the job, and is named."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.mat").load(path).select("path", "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for where, content in zip(rows["path"], rows["content"], strict=True):
                try:
                    found = decode(content)
                except (ValueError, struct.error, zlib.error, KeyError) as wrong:
                    raise ValueError(f"{where}: {wrong}") from wrong
                told = [{"name": n, "kind": a.dtype.str[1:], "shape": list(a.shape), "values": a.ravel().astype(float)} for n, a in found.items() if names is None or n in names]
                yield pd.DataFrame({"path": [where], "variables": [told]})

    # files are dealt one by one: a batch holds a few whole files
    return files.mapInPandas(run, f"path string, variables {VARIABLES}").select(stem(F.col("path")).alias("stem"), "path", "variables")


def _named(name: str) -> Column:
    """One of a file's variables; NULL where the file lacks it."""
    return F.get(F.filter("variables", lambda v: v["name"] == name), F.lit(0))


def mat_maps(spark: SparkSession, path: str, with_type: bool = False) -> DataFrame:
    """The label maps of MAT files as dense rows: image_id (the file's stem), height, width, inst_map, type_map if asked for. A file without one ends the job."""
    names = ["inst_map", *(["type_map"] if with_type else [])]
    files = read_mat(spark, path, names)
    for n in names:
        files = files.withColumn(n, _named(n))
        files = files.withColumn(n, F.when(F.col(n).isNotNull(), F.col(n)).otherwise(F.raise_error(F.concat("path", F.lit(f": no {n}"))).cast(files.schema[n].dataType)))
    shape = [F.col("inst_map.shape")[k].alias(c) for k, c in enumerate(("height", "width"))]
    return files.select(F.col("stem").alias("image_id"), *shape, *(F.col(f"{n}.values").cast("array<int>").alias(n) for n in names))


def mat_objects(spark: SparkSession, path: str) -> DataFrame:
    """What MAT files tell of their objects: image_id, inst_uid, inst_centroid (x, y), and inst_type, NULL where a file has none."""
    files = read_mat(spark, path, ["inst_uid", "inst_type", "inst_centroid"])
    rows = files.select(F.col("stem").alias("image_id"), _named("inst_type")["values"].alias("types"), _named("inst_centroid")["values"].alias("places"), F.posexplode(_named("inst_uid")["values"]).alias("i", "uid"))
    place = F.array(*(F.get("places", F.col("i") * 2 + k) for k in (0, 1)))
    return rows.select("image_id", F.col("uid").cast("int").alias("inst_uid"), place.alias("inst_centroid"), F.get("types", F.col("i")).cast("int").alias("inst_type"))


def as_files(maps: DataFrame, objects: DataFrame | None = None) -> DataFrame:
    """stem, variables of dense maps (image_id, height, width, inst_map, and type_map if there is one) and, if given, their objects
    (image_id, inst_uid, inst_centroid, and inst_type unless there are no types), as columns of the same order. A row holds one image."""
    made = lambda name, kind, shape, values: F.struct(F.lit(name).alias("name"), F.lit(kind).alias("kind"), F.array(*shape).cast("array<int>").alias("shape"), values.cast("array<double>").alias("values"))
    grids = [made(n, "i4", (F.col("height"), F.col("width")), F.col(n)) for n in ("inst_map", "type_map") if n in maps.columns]
    files = maps.select(F.col("image_id").cast("string").alias("stem"), F.array(*grids).alias("variables"))
    if objects is None:
        return files
    typed = ["inst_type"] if "inst_type" in objects.columns else []
    told = objects.groupBy(F.col("image_id").cast("string").alias("stem")).agg(F.sort_array(F.collect_list(F.struct("inst_uid", "inst_centroid", *typed))).alias("o"))
    files = files.join(told, "stem", "left").withColumn("o", F.coalesce("o", F.array().cast(told.schema["o"].dataType)))
    n, one = F.size("o"), F.lit(1)
    columns = [made("inst_uid", "i4", (n, one), F.col("o.inst_uid")), made("inst_centroid", "f8", (n, F.lit(2)), F.flatten("o.inst_centroid")), *(made(c, "i4", (n, one), F.col(f"o.{c}")) for c in typed)]
    return files.select("stem", F.concat("variables", F.array(*columns)).alias("variables"))


class MatSource(DataSource):
    """spark.dataSource.register(MatSource), then df.write.format("mat").mode("append").save(folder): a file `stem`.mat for each row of (stem, variables)."""

    @classmethod
    def name(cls) -> str:
        return "mat"

    def schema(self) -> str:
        return f"stem string, variables {VARIABLES}"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return MatWriter(self.options["path"], overwrite)


class MatWriter(DataSourceWriter):
    """A task writes under a name of its own and then renames, so what stands under a file's name is whole, and a task that runs again replaces it by the same.

    The folder is one that all executors reach: a mounted one, or a store that pyarrow knows.
    """

    def __init__(self, path: str, overwrite: bool):
        self.path = path
        if overwrite:
            fs, folder = self._place()
            fs.delete_dir_contents(folder, missing_dir_ok=True)

    def _place(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.path) if "://" in self.path or self.path.startswith("file:") else (fs.LocalFileSystem(), self.path)

    def write(self, iterator: Iterator[Row]) -> WriterCommitMessage:
        fs, folder = self._place()
        fs.create_dir(folder, recursive=True)
        for row in iterator:
            arrays = {v.name: np.array(v["values"], float).astype(v.kind).reshape(v["shape"]) for v in row.variables}
            part = posixpath.join(folder, f".{row.stem}-{uuid.uuid4().hex}")
            with fs.open_output_stream(part) as out:
                out.write(encode(arrays))
            fs.move(part, posixpath.join(folder, f"{row.stem}.mat"))
        return WriterCommitMessage()


def write_mat(files: DataFrame, path: str, mode: str = "append") -> None:
    """files: stem (once each), variables."""
    files.sparkSession.dataSource.register(MatSource)
    files.select("stem", "variables").write.format("mat").mode(mode).save(path)
