"""MAT files against bytes made by hand, against themselves, and against the reader of Parquet tables."""

import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from labelloom.sources import images, matfiles


def element(kind, data, order="<"):
    return struct.pack(order + "II", kind, len(data)) + data + b"\0" * (-len(data) % 8)


def by_hand(order):
    """A file with a small element as name, values stored in a narrower kind than the array's, one array compressed and a text."""
    head = b"made by hand".ljust(124) + struct.pack(order + "H", 0x0100) + (b"IM" if order == "<" else b"MI")
    small = struct.pack(order + "I", (1 << 16 | 1) if order == "<" else (1 << 16 | 1)) + b"a\0\0\0"
    dims = lambda *n: element(5, np.array(n, order + "i4").tobytes(), order)
    flags = lambda kind: element(6, struct.pack(order + "II", kind, 0), order)
    one = element(14, flags(6) + dims(2, 3) + small + element(2, bytes([1, 4, 2, 5, 3, 6]), order), order)
    two = element(14, flags(12) + dims(1, 2) + element(1, b"second", order) + element(5, np.array([-7, 8], order + "i4").tobytes(), order), order)
    text = element(14, flags(4) + dims(1, 2) + element(1, b"note", order) + element(16, b"hi", order), order)
    packed = zlib.compress(two)
    return head + one + struct.pack(order + "II", 15, len(packed)) + packed + text


@pytest.mark.parametrize("order", ["<", ">"])
def test_bytes_made_by_hand(order):
    got = matfiles.decode(by_hand(order))
    assert list(got) == ["a", "second"] and got["a"].tolist() == [[1, 2, 3], [4, 5, 6]] and got["a"].dtype == np.float64
    assert got["second"].tolist() == [[-7, 8]] and got["second"].dtype == np.int32


@pytest.mark.parametrize("compress", [True, False])
@pytest.mark.parametrize("kind", sorted(matfiles.CLASSES.values()))
def test_arrays_come_back(kind, compress):
    draw = np.random.default_rng(1)
    made = {f"n{k}": (100 * draw.random(shape)).astype(kind) for k, shape in enumerate([(3, 5), (0, 2), (2, 3, 4), (1, 1), (7,)])}
    back = matfiles.decode(matfiles.encode(made, compress))
    assert list(back) == list(made)
    for n, a in made.items():
        a = a.reshape(-1, 1) if a.ndim < 2 else a
        assert back[n].dtype == a.dtype and back[n].shape == a.shape and (back[n] == a).all()


@pytest.mark.parametrize("data, why", [(b"no", "not a MAT file"), (b"MATLAB 7.3 MAT-file".ljust(512, b"\0"), "not a MAT file"), (by_hand("<")[:150], "ends within"), (by_hand("<")[:124] + struct.pack("<H", 0x0200) + b"IM", "another level")])
def test_what_is_no_file_is_named(spark, tmp_path, data, why):
    (tmp_path / "bad.mat").write_bytes(data)
    with pytest.raises(Exception, match=f"bad.mat: .*{why}"):
        matfiles.read_mat(spark, str(tmp_path)).collect()


@pytest.fixture
def maps(spark):
    draw = np.random.default_rng(2)
    rows = []
    for k, (h, w) in enumerate([(4, 7), (9, 3), (1, 1)]):
        inst = draw.integers(0, 5, (h, w))
        rows.append((f"image.{k}" if k else "first", h, w, inst.ravel().tolist(), (inst * 3 % 8).ravel().tolist()))
    return spark.createDataFrame(rows, "image_id string, height int, width int, inst_map array<int>, type_map array<int>")


def test_labels_equal_those_of_the_parquet_reader(spark, tmp_path, maps):
    maps.write.parquet(str(tmp_path / "p"))
    matfiles.write_mat(matfiles.as_files(maps), str(tmp_path / "m"))
    assert sorted(f.name for f in (tmp_path / "m").iterdir()) == ["first.mat", "image.1.mat", "image.2.mat"]
    for name, kinds in (("kumar", False), ("CPM17", False), ("consep", False), ("consep", True)):
        # a stem ends at the first dot, as everywhere here
        want = images.read_labels(spark, name, str(tmp_path / "p"), kinds).withColumn("image_id", F.substring_index("image_id", ".", 1))
        got = images.read_labels(spark, name, str(tmp_path / "m"), kinds, mat=True)
        assert got.count() and sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_objects_round_trip(spark, tmp_path, maps):
    objects = spark.createDataFrame([("first", 1, [1.5, 2.25], 3), ("first", 2, [0.5, 0.0], 1), ("image.1", 9, [4.0, 1.0], 0)], "image_id string, inst_uid int, inst_centroid array<double>, inst_type int")
    matfiles.write_mat(matfiles.as_files(maps.drop("type_map"), objects), str(tmp_path / "m"))
    got = sorted(map(tuple, matfiles.mat_objects(spark, str(tmp_path / "m")).collect()))
    assert got == [("first", 1, [1.5, 2.25], 3), ("first", 2, [0.5, 0.0], 1), ("image", 9, [4.0, 1.0], 0)]
    matfiles.write_mat(matfiles.as_files(maps.where("image_id = 'first'"), objects.drop("inst_type")), str(tmp_path / "m"), "overwrite")
    got = sorted(map(tuple, matfiles.mat_objects(spark, str(tmp_path / "m")).collect()))
    assert got == [("first", 1, [1.5, 2.25], None), ("first", 2, [0.5, 0.0], None)]
    assert images.read_labels(spark, "consep", str(tmp_path / "m"), True, mat=True).count()


def test_a_file_without_a_map_is_named(spark, tmp_path):
    (tmp_path / "x.mat").write_bytes(matfiles.encode({"other": np.ones((2, 2))}))
    with pytest.raises(Exception, match="x.mat: no inst_map"):
        matfiles.mat_maps(spark, str(tmp_path)).collect()
