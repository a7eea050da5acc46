"""File scans and image decoding on a tiny PNG, model and report round trips."""

import struct
import zlib

from tintshelf.operators.learn import PairModel
from tintshelf.sources import files as W
from tintshelf.sources import records as R


def _png(path, rows):
    def chunk(kind, body):
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    raw = b"".join(b"\0" + bytes(v for pixel in row for v in pixel) for row in rows)
    head = struct.pack(">IIBBBBB", len(rows[0]), len(rows), 8, 2, 0, 0, 0)
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


def test_scan_and_pixels(spark, tmp_path):
    _png(tmp_path / "AB_000.png", [[(255, 0, 0), (0, 255, 0)], [(0, 0, 255), (10, 20, 30)]])
    _png(tmp_path / "MY-1.PNG", [[(1, 2, 3)]])
    (tmp_path / "n.txt").write_text("")
    folder = str(tmp_path)

    def names(**options):
        return [r["image_name"] for r in W.scan_images(spark, folder, **options).collect()]

    assert names() == ["AB_000.png", "MY-1.PNG"]
    assert names(variant="catalog") == ["AB_000.png"]
    assert names(pattern="zz*") == ["AB_000.png", "MY-1.PNG"]
    assert names(pattern="zz*", variant="import") == []
    pixels = W.to_pixels(W.read_images(spark, f"{folder}/AB_000.png")).orderBy("y", "x").collect()
    assert [tuple(p)[1:] for p in pixels] == [(0, 0, 255, 0, 0), (0, 1, 0, 255, 0), (1, 0, 0, 0, 255), (1, 1, 10, 20, 30)]


def test_model_and_report(spark, tmp_path):
    model = PairModel((1.0,) * 10, 0.5, (0.0,) * 10, (1.0,) * 10)
    R.save_model(spark, model, f"{tmp_path}/model")
    assert R.load_model(spark, f"{tmp_path}/model") == model
    metrics = spark.createDataFrame([(5, 0.5, 0.75)], "samples long, pos_rate double, train_acc double")
    R.write_training_report(metrics, f"{tmp_path}/report", {"seed": 1})
    assert R.read_training_report(spark, f"{tmp_path}/report").first()["metrics"]["train_acc"] == 0.75
