import json

import numpy as np
import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from cinequarry.functions import scalars as S
from cinequarry.functions import udfs
from cinequarry.operators import synthetic
from cinequarry.sources import manifest


def test_manifest_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([(3, "é \n quoted", ["é", "b"], 1.5), (1, None, [], 2.0), (2, "x", None, None)], "item_id long, text string, texts array<string>, duration double")
    rows = rows.select("*", S.clip_name(F.col("item_id")).alias("file_name"))
    path = f"file://{tmp_path}/m"
    manifest.write_manifest(rows, path)
    back = manifest.read_manifest(spark, path)
    assert {f.name for f in back.schema} >= {"clip_similarity", "window", "split"}
    assert [tuple(r) for r in back.orderBy("item_id").select("item_id", "text", "duration", "file_name").collect()] == [(1, None, 2.0, "00001.npz"), (2, "x", None, "00002.npz"), (3, "é \n quoted", 1.5, "00003.npz")]
    with pytest.raises(AnalysisException):
        manifest.write_manifest(rows, path)


def test_caption_file(spark, tmp_path):
    told = {"a": {"audio_visual_captions": [" b ", "a"], "visual_captions": ["b", ""]}, "b": {"GPT_AV_captions": None}, "c": {"unknown": ["x"], "audio_captions": ["only"]}}
    (tmp_path / "train_captions.json").write_text(json.dumps(told))
    fields = manifest.read_captions(spark, f"file://{tmp_path}/train_captions.json")
    from cinequarry.operators.curation import captions_by_clip

    assert {r.stem: r.texts for r in captions_by_clip(fields).collect()} == {"a": ["b", "a"], "c": ["only"]}


def test_arrays_and_listing(spark, tmp_path):
    for i in range(3):
        np.savez_compressed(tmp_path / f"{i:05d}.npz", frames=np.full((5, 2, 2, 3), i, np.uint8), **({"audio": np.arange(4, dtype=np.int16)} if i else {}))
    listed = manifest.list_files(spark, f"file://{tmp_path}")
    assert [r.path[-9:] for r in listed.collect()] == ["00000.npz", "00001.npz", "00002.npz"]
    frames = manifest.read_arrays(spark, f"file://{tmp_path}", "frames").orderBy("path").collect()
    assert [(r.kind, r.shape, r.data[0]) for r in frames] == [("|u1", [5, 2, 2, 3], i) for i in range(3)]
    audio = manifest.read_arrays(spark, f"file://{tmp_path}", "audio")
    assert audio.count() == 2
    pcm = audio.select(udfs.build("codec", "pcm16")("data").alias("x")).first().x
    assert pcm[3] == 3 / 32767


def test_registry(spark):
    with pytest.raises(ValueError, match="hashed"):
        udfs.build("encoder", "none")
    with pytest.raises(ValueError, match="kind"):
        udfs.register("thing", "x")
    udfs.install(spark)
    v = spark.sql("SELECT encoder_hashed('a b c') AS a, encoder_hashed('a b c') AS b, encoder_hashed(NULL) AS n").first()
    assert v.a == v.b and abs(sum(x * x for x in v.a) - 1) < 1e-9 and set(v.n) == {0.0}
    tone = [float(np.sin(2 * np.pi * 440 * i / 8000)) for i in range(4000)]
    hz = spark.createDataFrame([(tone,), (None,), ([1.0],)], "x array<double>").select(udfs.build("heuristic", "dominant_frequency", rate=8000)("x").alias("hz")).collect()
    assert abs(hz[0].hz - 440) < 3 and hz[1].hz is None and hz[2].hz is None
    image = np.zeros((32, 32), np.uint8)
    image[10:20, 5:15], image[0, 31] = 200, 255
    got = spark.createDataFrame([(bytearray(image.tobytes()),), (None,)], "b binary").select(udfs.build("heuristic", "median_mask")("b").alias("m")).collect()
    assert 85 <= got[0].m.pixels <= 100 and got[0].m.x == 9.5 and got[1].m.pixels == 0


def test_synthetic_clips_do_not_depend_on_partitions(spark):
    a = {r.id: bytes(r.frames) for r in synthetic.clips(spark, 12).collect()}
    b = {r.id: bytes(r.frames) for r in synthetic.clips(spark, 12).repartition(5).collect()}
    assert a == b
    assert synthetic.judged(synthetic.clips(spark, 30)).where("color <> pred_color or shape <> pred_shape or move <> pred_move").count() == 0
