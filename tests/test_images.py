"""Image kernels by hand-computed values, and folders of small images written here."""

import struct
import zlib

import numpy as np
import pytest

from vectrail.functions import images as k
from vectrail.sources import images as s
from vectrail.streaming import ingest


def write_png(path, rgb):
    height, width, _ = rgb.shape
    raw = b"".join(b"\0" + row.tobytes() for row in rgb.astype(np.uint8))

    def chunk(kind, data):
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


@pytest.fixture()
def folder(tmp_path):
    rng = np.random.default_rng(0)
    where = tmp_path / "hands"
    where.mkdir()
    write_png(where / "a.png", np.full((250, 120, 3), 255))
    write_png(where / "b.png", rng.integers(0, 255, (160, 170, 3)))
    (where / "notes.txt").write_text("not an image")
    return where


def test_white_has_neutral_colour():
    assert k.yuv(np.full((2, 2, 3), 255, dtype=np.uint8))[0, 0].tolist() == [255, 128, 128]


def test_tiles_keep_short_edges():
    assert [t.shape for t in k.tiles(np.zeros((250, 120)))] == [(100, 100), (100, 20), (100, 100), (100, 20), (50, 100), (50, 20)]


def test_moments():
    assert k.moments(np.array([1.0, 1.0])) == (1.0, 0.0, 0.0)
    mean, std, skew = k.moments(np.array([0.0, 0.0, 3.0]))
    assert mean == 1 and std == pytest.approx(2**0.5) and skew == pytest.approx(2 / 2**1.5)


def test_pattern_with_one_neighbour():
    x = np.array([[5, 1, 2, 7, 0, 2]], dtype=np.uint8)
    assert k.local_binary_pattern(x).tolist() == [[1, 0, 1, 0, 1, 0]]


def test_histograms_close_the_last_bin():
    assert k.histogram(np.array([0, 10]), 10)[0] == k.histogram(np.array([0, 10]), 10)[9] == pytest.approx(0.5)
    assert sum(k.histogram(np.array([4, 4]), 10)) == pytest.approx(1)


def test_gradients_of_an_edge():
    x = np.zeros((320, 320, 3), dtype=np.uint8)
    x[:, 155:] = 200
    v = np.array(k.hog(x)).reshape(3, 3, 2, 2, 9)
    assert v.shape[-1] == 9 and v[..., 0].sum() > 0 and v[..., 1:].sum() == 0
    assert len(k.hog(np.zeros((1200, 1600, 3), dtype=np.uint8))) == 9576


def test_folder_features_and_metadata(spark, folder, tmp_path):
    assert s.listing(spark, str(folder), None).count() == 3 and s.listing(spark, str(folder), "*.png").count() == 2
    table = s.features(s.decoded(spark, str(folder), "*.png"))
    rows = {r.image_name: r for r in table.collect()}
    assert len(rows["a.png"].CM) == 3 * 6 * 3 and rows["a.png"].CM[:3] == [255.0, 0.0, 0.0]
    assert len(rows["b.png"].LBP) == 4 * 10
    (tmp_path / "meta.csv").write_text("id,age,gender,accessories,aspectOfHand,imageName\n1,20,male,0,dorsal left,a.png\n2,30,female,1,palmar right,z.png\n")
    meta = s.metadata(spark, str(tmp_path / "meta.csv"))
    assert dict(meta.dtypes)["id"] == "int" and s.in_folder(meta, table).count() == 1
    s.split_metadata(spark, str(folder), str(tmp_path / "meta.csv"), str(tmp_path / "out"))
    assert spark.read.option("header", True).csv(str(tmp_path / "out")).count() == 1
    more = s.extend(table.where("image_name = 'a.png'"), s.decoded(spark, str(folder), "*.png"))
    assert {r.image_name for r in more.collect()} == {"a.png", "b.png"}
    s.log_append(meta.select("id", "gender"), str(tmp_path / "log"))
    s.log_append(meta.select("id", "gender"), str(tmp_path / "log"))
    assert spark.read.option("header", True).csv(str(tmp_path / "log")).count() == 4


def test_whole_image_patterns(spark, folder):
    x = np.random.default_rng(1).integers(0, 255, (150, 150, 3)).astype(np.uint8)
    whole = np.array(k.lbp(x, whole_image=True)).reshape(4, 10)
    assert (whole == whole[0]).all() and not (np.array(k.lbp(x)).reshape(4, 10) == whole[0]).all()
    assert len(k.lbp(x, wide=True)) == 4 and len(k.lbp(x, wide=True)[0]) == 256


def test_ingest_adds_each_image_once(spark, folder, tmp_path):
    table, checkpoint = str(tmp_path / "table"), str(tmp_path / "checkpoint")
    for expected in (2, 2):
        ingest.ingest(spark, str(folder), table, checkpoint, ("CM",), "*.png").awaitTermination()
        assert spark.read.parquet(table).count() == expected
    write_png(folder / "c.png", np.zeros((10, 10, 3)))
    ingest.ingest(spark, str(folder), table, checkpoint, ("CM",), "*.png").awaitTermination()
    assert sorted(r.image_name for r in spark.read.parquet(table).collect()) == ["a.png", "b.png", "c.png"]
