import json

import numpy as np
import pytest

from quernworks.image import png
from quernworks.plans import stages
from quernworks.sources import files, manifest
from quernworks.streaming import ingest


@pytest.fixture
def dataset(tmp_path):
    """A manifest with two colliding pairs, a clean row, a malformed line, and missing files."""
    for folder, names in (("real", ["r1.png", "r2.png"]), ("edit", ["1.png", "2.png", "99.png", "lost.png"])):
        (tmp_path / folder).mkdir()
        for i, n in enumerate(names):
            (tmp_path / folder / n).write_bytes(png.encode(np.full((32, 32, 3), 40 * i + 10, np.uint8)))
    row = lambda out, real="real/r1.png", text="add a dog": {"open_image_input_url": "http://x/y.png", "text": text, "output_image": out, "edit_type": "Zoom in", "summarized_text": "s", "local_input_image": real}
    lines = [row("edit/1.png"), row("edit/2.png"), row("other/1.png"), row("edit/99.png"), row("other/2.png"), row("edit/gone.png"), row("edit/lost.png", "real/none.png")]
    text = [json.dumps(x) for x in lines]
    text.insert(3, "{malformed")
    text.insert(1, "   ")
    (tmp_path / "m.jsonl").write_text("\n".join(text))
    return tmp_path


def test_manifest(spark, dataset):
    make = lambda **o: manifest.manifest_triplets(spark, manifest.ManifestConfig(str(dataset / "m.jsonl"), f"file://{dataset}", **o))
    (only,) = make().collect()
    told = {"source_edit_type": "Zoom in", "summarized_text": "s", "open_image_input_url": "http://x/y.png", "manifest_line_no": 6, "source_output_image": "edit/99.png", "source_local_input_image": "real/r1.png"}
    assert only.triplet_id == "picobanana_99" and json.loads(only.metadata) == told
    assert only.real_path == f"{dataset}/real/r1.png" and only.provided_mask_path is None
    first = make(on_collision="keep_first")
    assert sorted(r.triplet_id for r in first.collect()) == ["picobanana_1", "picobanana_2", "picobanana_99"]
    assert [r.triplet_id for r in make(on_collision="keep_first", max_records=1).collect()] == ["picobanana_1"]
    report = manifest.manifest_collisions(spark, str(dataset / "m.jsonl")).first()
    assert (report.n_collisions, report.n_records) == (2, 4)
    lines, bad = manifest.parsed(manifest.numbered_lines(spark, str(dataset / "m.jsonl")))
    assert bad.count() == 1 and lines.count() == 7


def test_missing_real_images_are_fetched_to_the_cache(spark, dataset):
    config = manifest.ManifestConfig(str(dataset / "m.jsonl"), f"file://{dataset}", "keep_first", cache=f"file://{dataset}/cache", download_missing=True)
    (dataset / "cache").mkdir()
    image = png.encode(np.zeros((4, 4, 3), np.uint8))
    found = {r.triplet_id: r.real_path for r in manifest.manifest_triplets(spark, config, lambda url: image).collect()}
    assert set(found) == {"picobanana_1", "picobanana_2", "picobanana_99", "picobanana_lost"} and found["picobanana_lost"].startswith(f"{dataset}/cache/")

    def fail(url):
        raise OSError(url)

    for old in (dataset / "cache").iterdir():
        old.unlink()
    assert "picobanana_lost" not in {r.triplet_id for r in manifest.manifest_triplets(spark, config, fail).collect()}


def test_jpeg_and_png_are_read_as_png(spark, tmp_path):
    jvm = spark._jvm
    picture = jvm.java.awt.image.BufferedImage(16, 8, jvm.java.awt.image.BufferedImage.TYPE_INT_RGB)
    for x in range(16):
        for y in range(8):
            picture.setRGB(x, y, 0xC81E1E if x < 8 else 0x1E1EC8)
    jvm.javax.imageio.ImageIO.write(picture, "jpg", jvm.java.io.File(f"{tmp_path}/a.jpg"))
    (tmp_path / "deep").mkdir()
    (tmp_path / "deep" / "b.png").write_bytes(png.encode(np.full((3, 5, 3), 9, np.uint8)))
    (tmp_path / "broken.jpeg").write_bytes(b"no image")
    (tmp_path / "notes.txt").write_text("no image")
    found = {r.path: png.decode(bytes(r.content)) for r in files.read_images(spark, f"file://{tmp_path}").collect()}
    assert set(found) == {f"{tmp_path}/a.jpg", f"{tmp_path}/deep/b.png"} and (found[f"{tmp_path}/deep/b.png"] == 9).all()
    jpeg = found[f"{tmp_path}/a.jpg"].astype(int)
    assert jpeg.shape == (8, 16, 3) and jpeg[:, :6, 0].mean() > 170 > 60 > jpeg[:, :6, 2].mean() and jpeg[:, 10:, 2].mean() > 170


def test_mask_report(spark, tmp_path):
    rows = [("a", 1.0, 1.0, 0.5, 0.5, "local"), ("b", 0.25, 0.4, 0.1, 0.2, "global"), ("c", None, None, None, None, "global")]
    compared = spark.createDataFrame(rows, "triplet_id string, iou double, dice double, gt_area_frac double, auto_area_frac double, edit_scope string")
    found = stages.mask_report(compared, f"file://{tmp_path}/report.json")
    assert found["all"]["n"] == 2 and found["all"]["mean_iou"] == 0.625 and set(found["by_scope"]) == {"local", "global"} and found["by_scope"]["global"]["bin1"] == 1
    assert spark.read.parquet(f"file://{tmp_path}/report.per_triplet.parquet").count() == 3 and json.loads((tmp_path / "report.json").read_text()) == found


def test_turns(spark):
    image = bytearray(b"x")
    rows = [("7", 1, "add a dog", image, image, None), ("7", 2, "again", image, image, image), ("8", None, "x", image, image, None), ("9", 1, "", image, image, None)]
    turns = spark.createDataFrame(rows, "img_id string, turn_index int, instruction string, source_img binary, target_img binary, mask_img binary")
    got = {r.triplet_id: r for r in manifest.turn_triplets(turns, "dev", "/images").collect()}
    assert set(got) == {"magicbrush_dev_7_t01", "magicbrush_dev_7_t02"}
    assert json.loads(got["magicbrush_dev_7_t01"].metadata)["source_is_authentic"] and got["magicbrush_dev_7_t02"].provided_mask_path == "/images/magicbrush_dev_7_t02__mask.png"
    assert manifest.turn_triplets(turns, "dev", "/images", single_turn_only=True).count() == 1
    with pytest.raises(ValueError):
        manifest.turn_triplets(turns, "test", "/images")


def test_stages_end_to_end(spark, dataset):
    triplets = manifest.manifest_triplets(spark, manifest.ManifestConfig(str(dataset / "m.jsonl"), f"file://{dataset}", "keep_first"))
    masks = stages.masks_stage(triplets, files.read_images(spark, str(dataset))).cache()
    assert masks.count() == 3 and masks.filter("error is not null").count() == 0
    difficulty = stages.difficulty_stage(triplets, masks).cache()
    reasoning = stages.reasoning_stage(triplets, masks, difficulty, stages.category_stage(triplets))
    rows = reasoning.collect()
    assert len(rows) == 3 and all(r.chain.startswith('1. The edit instruction states: "add a dog".') for r in rows)
    assert stages.training_rows(triplets, reasoning, 5, keep_other=True).count() == 3
    judged = stages.evaluate_predictions(reasoning.select("triplet_id", "category", "spatial_descriptor", "difficulty_bin"), reasoning.selectExpr("triplet_id", "chain as generated_text"))
    assert judged.filter("category_match and spatial_match and bin_match").count() == 3
    with pytest.raises(ValueError):
        stages.reasoning_stage(triplets, masks, difficulty.drop("compactness_score").selectExpr("*", "1.0 as locality"), stages.category_stage(triplets))


def test_shards_and_reports(spark, tmp_path):
    folder = str(tmp_path / "t")
    rows = spark.range(25).selectExpr("id", "cast(id % 3 as string) as shard")
    files.append_rows(rows.coalesce(1), folder, 10)
    paths = files.shard_paths(spark, folder)
    assert len(paths) == 3 and files.read_shards(spark, folder, indices=[0]).count() == 10
    with pytest.raises(IndexError):
        files.select_shards(paths, [3])
    with pytest.raises(FileNotFoundError):
        files.shard_paths(spark, str(tmp_path / "none"))
    assert files.read_shards(spark, folder, positions=True).select("_file", "_row").distinct().count() == 25
    out = str(tmp_path / "by")
    assert files.write_by_shard(rows.filter("shard < '2'"), out) == 2 and files.write_by_shard(rows, out) == 1 and files.write_by_shard(rows, out) == 0
    assert spark.read.parquet(out).count() == 25
    files.replace_table(spark.read.parquet(folder).filter("id < 5"), folder)
    assert spark.read.parquet(folder).count() == 5
    report = files.write_report(rows.selectExpr("count(*) as n"), str(tmp_path / "r.json"))
    assert report == json.loads((tmp_path / "r.json").read_text()) == {"n": 25}
    assert files.describe(rows)["rows"] == 25
    (tmp_path / "l.json").write_text('{"a": "easy", "b": "odd"}')
    with pytest.raises(ValueError):
        files.read_labels(spark, str(tmp_path / "l.json"))


def test_images_and_downloads(spark, tmp_path):
    rows = spark.createDataFrame([("a", bytearray(b"123")), ("b", bytearray(b"45"))], "triplet_id string, mask_png binary")
    got = {r.triplet_id: r.mask_path for r in files.write_images(rows, f"file://{tmp_path}/m").collect()}
    assert open(got["a"], "rb").read() == b"123" and not list(tmp_path.glob("m/*.partial"))
    urls = spark.createDataFrame([("http://h/a.png",), ("http://h/bad.png",)], "url string")

    def fetch(url):
        if "bad" in url:
            raise OSError(url)
        return b"image"

    found = {r.url: r.file for r in files.download(urls, f"file://{tmp_path}/c", fetch=fetch).collect()}
    assert open(found["http://h/a.png"], "rb").read() == b"image" and found["http://h/bad.png"] is None


def test_streaming(spark, tmp_path):
    source, target, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    table = "triplet_id string, category string, confidence double, source string, rationale string"
    put = lambda ids: spark.createDataFrame([(i, "other", 1.0, "s", "r") for i in ids], table).write.mode("append").parquet(source)
    put(["a", "b"])
    run = lambda: ingest.run_available(ingest.new_rows(spark, source, "categories"), lambda df: df.select("triplet_id"), target, check)
    run()
    put(["c"])
    run()
    run()
    assert sorted(r[0] for r in spark.read.parquet(target).collect()) == ["a", "b", "c"]
