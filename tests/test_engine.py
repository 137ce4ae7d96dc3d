"""Whole jobs over small files, with stand-ins for models."""

import base64
import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire import engine
from quire.sources import models, sinks
from quire.sources.documents import PlainPages, decoded, encoded, landing, media_type, page_rows, png, read_documents, resized, shrunk
from quire.sources.standins import HEIGHT, WIDTH, HostedService, crop_reader, detector, grounded_reader, page, reader
from quire.streaming.progress import latest


@pytest.fixture()
def folder(tmp_path):
    (tmp_path / "a.pdf").write_bytes(page([40, 100, 160]) + page([40, 100]))
    (tmp_path / "b.png").write_bytes(page([200]))
    return str(tmp_path)


def test_images():
    gray = np.arange(12, dtype=np.uint8).reshape(3, 4)
    assert (decoded(encoded(gray)) == gray).all() and (decoded(png(gray)) == gray).all()
    assert media_type(png(gray)) == "image/png" and media_type(b"\xff\xd8x") == "image/jpeg"
    assert resized(gray, 8, 6).shape == (6, 8) and shrunk(gray, 2).shape == (2, 2) and shrunk(gray, 9) is gray


def test_data_urls_have_no_line_breaks(spark):
    images = [bytes(range(n)) for n in (0, 1, 56, 57, 58, 114, 115, 256)] + [None]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(images)], "i int, image binary")
    found = {r.i: r.url for r in df.select("i", models.data_url(F.col("image")).alias("url")).collect()}
    assert found == {i: None if x is None else "data:image/jpeg;base64," + base64.b64encode(x).decode() for i, x in enumerate(images)}


def test_page_selection_comes_before_rendering(spark, folder):
    docs = read_documents(spark, folder)
    assert {(r.path.rsplit("/")[-1], r.is_image) for r in docs.collect()} == {("a.pdf", False), ("b.png", True)}
    rows = page_rows(docs, PlainPages(), "2-9", most=300).collect()
    assert [(r.page_index, r.n_pages, r.width, r.height) for r in rows] == [(1, 2, 200, 300)]
    assert page_rows(docs, PlainPages()).count() == 3 and page_rows(docs, PlainPages(), "99").count() == 0


def test_hybrid_job(spark, folder):
    docs = read_documents(spark, folder).cache()
    result = engine.hybrid(docs, detector, reader, crop_reader)
    boxes = result.boxes.join(docs.select("doc_id", F.regexp_extract("path", "([a-z])\\.", 1).alias("name")), "doc_id").collect()
    text = {(r.name, r.page_index, r.box_idx): r.text for r in boxes}
    assert text["a", 0, 0] == "line number 0 of the page" and text["a", 0, 2] == "line number 2 of the page" and text["b", 0, 0].startswith("line number 0")
    assert text["a", 0, 3] == ""  # blank, so that it is not read again
    assert sorted({s for s, *_ in result.progress}) == ["convert", "detect", "embed", "ocr", "refine"]
    texts = {r.doc_id: json.loads(r.text) for r in sinks.job_texts(result.lines).collect()}
    assert sorted(len(t) for t in texts.values()) == [1, 2]
    files = engine.output_files(result, docs).cache()
    spans = sinks.layer_rows(files).collect()
    assert files.count() == 2 and {s.text for s in spans} >= {"line number 1 of the page"}
    for s in spans:
        width = 0.98 * (360 - 40)
        assert s.x == pytest.approx(40, abs=0.01) and 0 < s.baseline_y < HEIGHT and (s.page_width, s.page_height) == (WIDTH, HEIGHT)
        assert sum(sinks.WIDTHS[ord(c) - 32] for c in s.text) * s.font_size / 1000 * s.scale_x == pytest.approx(width, rel=1e-3)
    assert all(bytes(r.content).startswith(b"%PDF-1.4") for r in files.collect())


def test_dense_pages_are_read_box_by_box(spark, folder):
    result = engine.hybrid(read_documents(spark, folder), detector, reader, crop_reader, engine.Settings(dense_mode="always", refine=False))
    told = result.boxes.groupBy("text").count().collect()
    assert {r.text: r["count"] for r in told} == {"read again": 6, "": 3}
    with pytest.raises(ValueError):
        engine.Settings(dense_mode="perhaps")


def test_a_failing_reader_ends_a_hybrid_job_but_not_a_grounded_one(spark, folder):
    def down(image):
        raise RuntimeError("model is down")

    with pytest.raises(Exception, match="model is down"):
        engine.hybrid(read_documents(spark, folder), detector, down, crop_reader).boxes.collect()
    docs = read_documents(spark, folder)
    result = engine.grounded(docs, grounded_reader)
    assert sorted(r.text for r in result.boxes.collect()) == ["block 0", "block 0", "block 1", "block 1", "block 2"]
    assert engine.output_files(result, docs).count() == 2


def test_fixtures_round_trip(spark):
    from quire.operators.responses import truth_blocks

    box = "struct<x0:double,y0:double,x1:double,y1:double>"
    blocks = spark.createDataFrame([(1, 0, 0, (0.1, 0.1, 0.9, 0.12), "one", None), (1, 1, 0, (0.1, 0.5, 0.9, 0.52), "two", "title")], f"doc_id bigint, page_index int, block_idx int, box {box}, text string, label string")
    sizes = spark.createDataFrame([(1, 0, 1000, 1000), (1, 1, 1000, 1000), (2, 0, 10, 10)], "doc_id bigint, page_index int, width int, height int")
    made = sinks.fixture(blocks, sizes, F.lit("output_scan.pdf")).collect()
    assert [r.doc_id for r in made] == [1]
    data = json.loads(made[0].json)["data"]
    assert (data["file_name"], data["file_type"], data["data_info"]["num_pages"]) == ("scan.pdf", "pdf", 2)
    assert [b["bbox"] for b in data["layout"]] == [[100, 100, 120, 900], [500, 100, 520, 900]] and [b["block_id"] for b in data["layout"]] == [0, 1]
    back = truth_blocks(spark.createDataFrame([(1, made[0].json)], "doc_id bigint, raw string"), ["doc_id"]).collect()
    assert [(r.text, r.page_index, r.label, round(r.box.x0, 3), round(r.box.y1, 3)) for r in sorted(back, key=lambda r: r.block_idx)] == [("one", 0, "text", 0.1, 0.12), ("two", 1, "title", 0.1, 0.52)]


def test_texts_are_found_by_job(spark, tmp_path):
    path = str(tmp_path / "texts")
    sinks.put_texts(spark.createDataFrame([(7, '{"0": ["a"]}')], "doc_id bigint, text string"), path)
    assert sinks.text_of(spark, path, 7) == '{"0": ["a"]}' and sinks.text_of(spark, path, 8) is None


def test_task_reader():
    calls = iter([{"data": {"task_id": "t"}}, {"data": {"status": "running"}}, {"data": {"status": "completed", "layout": []}}])
    assert json.loads(models.TaskReader(lambda *_: next(calls), sleep=lambda _: None)(b""))["data"]["layout"] == []
    for status, error in (("failed", RuntimeError), ("running", TimeoutError)):
        answers = iter([{"data": {"task_id": "t"}}] + [{"data": {"status": status}}] * 200)
        with pytest.raises(error):
            models.TaskReader(lambda *_, answers=answers: next(answers), timeout=9, sleep=lambda _: None)(b"")
    with pytest.raises(RuntimeError, match="no answer"):
        models.ChatReader("read", base="http://127.0.0.1:9", timeout=1)(b"x")


def test_command_line():
    args = engine.parser().parse_args(["in.pdf", "--pages", "1-3", "--no-refine", "--dense-mode", "never"])
    s = engine.settings_of(args)
    assert (s.pages, s.refine, s.dense_mode, s.dpi, s.max_image_dim, s.dense_threshold) == ("1-3", False, "never", 200, 1024, 60)


def test_service_settings(monkeypatch):
    monkeypatch.delenv("OCR_CONCURRENCY", raising=False)
    assert engine.Settings.of_service().concurrency == 3
    monkeypatch.setenv("OCR_CONCURRENCY", "7")
    assert engine.Settings.of_service().concurrency == 7


def test_fixture_files_are_read_whole(spark, tmp_path):
    from quire.sources.documents import read_fixtures

    (tmp_path / "a.json").write_text('{\n "data": {}\n}')
    assert [r.raw for r in read_fixtures(spark, str(tmp_path)).collect()] == ['{\n "data": {}\n}']


def test_landing_folder_and_progress_as_streams(spark, folder, tmp_path):
    seen = str(tmp_path / "seen")
    query = landing(spark, folder).select("doc_id", "is_image").writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start(seen)
    query.awaitTermination(60)
    assert spark.read.parquet(seen).count() == 2
    rows = [("j", 1, "convert", 1, 1, "a"), ("j", 2, "ocr", 5, 10, "b"), ("k", 1, "embed", 0, 0, "c")]
    events = spark.createDataFrame(rows, "job_id string, seq int, stage string, current int, total int, message string")
    assert {(r.job_id, r.percent) for r in latest(events).collect()} == {("j", 50), ("k", 90)}
    assert os.path.isdir(seen)


def test_unselected_pages_are_in_the_file(spark, tmp_path):
    (tmp_path / "c.pdf").write_bytes(page([40]) + page([100]) + encoded(np.full((300, 200), 255, np.uint8)))
    docs = read_documents(spark, str(tmp_path))
    result = engine.hybrid(docs, detector, reader, crop_reader, engine.Settings(pages="2"))
    assert result.pages.count() == 1
    content = bytes(engine.output_files(result, docs, dpi=144).first().content)
    assert content.count(b"/Type /Page /Parent") == 3
    assert content.count(b"/MediaBox [0 0 400.0000 600.0000]") == 2 and content.count(b"/MediaBox [0 0 200.0000 300.0000]") == 1
    assert content.count(b"/Width 800 /Height 1200") == 2 and content.count(b"/Width 400 /Height 600") == 1
    assert {(s["page_index"], s["text"]) for s in sinks.layer_of(content)} == {(1, "line number 0 of the page")}
    image = tmp_path / "only"
    image.mkdir()
    (image / "d.png").write_bytes(page([40]))
    docs = read_documents(spark, str(image))
    content = bytes(engine.output_files(engine.hybrid(docs, detector, reader, crop_reader), docs, dpi=144).first().content)
    assert b"/Width 400 /Height 600" in content and b"/MediaBox [0 0 400.0000 600.0000]" in content


def test_hosted_job(spark, folder):
    docs = read_documents(spark, folder)
    result = engine.hosted(docs, models.TaskReader(HostedService(), every=0.01))
    boxes = result.boxes.orderBy("doc_id", "page_index", "box_idx").collect()
    assert [r.text for r in boxes] == ["block 0 of 0", "block 1 of 0", "block 2 of 0", "block 0 of 1", "block 1 of 1", "block 0 of 0"]
    assert [round(x, 6) for x in boxes[0].box] == [0.1, round(40 / HEIGHT, 6), 0.9, 0.1]
    spans = sinks.layer_rows(engine.output_files(result, docs)).collect()
    assert len(spans) == 6 and {s.x for s in spans} == {40.0}


def test_words_page_boxes_and_fixtures_of_files(spark, folder):
    from quire.operators.responses import truth_blocks
    from quire.sources import layers

    docs = read_documents(spark, folder)
    files = engine.output_files(engine.hybrid(docs, detector, reader, crop_reader), docs).cache()
    spans = sinks.layer_rows(files).cache()
    found = layers.words(spans).where(F.col("doc_id").contains("a.pdf") & (F.col("page_index") == 0) & (F.col("span_idx") == 1)).orderBy("word_idx").collect()
    assert [w.word for w in found] == ["line", "number", "1", "of", "the", "page"]
    assert found[0].box.x0 == pytest.approx(40, abs=0.01) and found[-1].box.x1 == pytest.approx(40 + 0.98 * 320, rel=1e-3)
    assert all(a.box.x1 < b.box.x0 for a, b in zip(found, found[1:]))
    assert all((w.box.y0, w.box.y1) == (pytest.approx(100, abs=0.1), pytest.approx(120, abs=0.1)) for w in found)
    boxes = layers.page_boxes(files)
    assert sorted((r.page_index, r.rotation, r.media_box, r.page_width, r.page_height) for r in boxes.collect()) == [(n, 0, [0.0, 0.0, WIDTH, HEIGHT], WIDTH, HEIGHT) for n in (0, 0, 1)]
    made = layers.fixtures_of(spans, boxes, F.lit("output_a.pdf"))
    back = truth_blocks(made.withColumnRenamed("json", "raw"), ["doc_id"]).where(F.col("doc_id").contains("a.pdf")).orderBy("block_idx").collect()
    assert [(r.page_index, r.text) for r in back] == [(p, f"line number {k} of the page") for p, k in ((0, 0), (0, 1), (0, 2), (1, 0), (1, 1))]
    assert [round(r.box.y0 * HEIGHT) for r in back] == [40, 100, 160, 40, 100] and {round(r.box.x0 * WIDTH) for r in back} == {40}


def test_page_boxes_are_inherited_and_unpacked(spark):
    import zlib

    from quire.sources.layers import page_boxes

    pages = [b"<< /Type /Page /Parent 2 0 R >>", b"<< /Type /Page /Parent 2 0 R /Rotate 90 /CropBox [10 10 110.5 60] >>"]
    index = b"4 0 5 %d " % (len(pages[0]) + 1)
    packed = zlib.compress(index + b"\n".join(pages))
    plain = b"%PDF-1.5\n1 0 obj << /Type /Catalog /Pages 2 0 R >> endobj\n2 0 obj << /Type /Pages /Kids [5 0 R 4 0 R] /Count 2 /MediaBox [0 0 200 300] >> endobj\n"
    stream = b"3 0 obj << /Type /ObjStm /N 2 /First %d /Filter /FlateDecode /Length %d >> stream\n%s\nendstream endobj\n" % (len(index), len(packed), packed)
    docs = spark.createDataFrame([("a", plain + stream), ("b", b""), ("c", None), ("d", b"no file of this kind")], "doc_id string, content binary")
    rows = page_boxes(docs).orderBy("page_index").collect()
    assert [(r.doc_id, r.rotation, r.media_box, r.crop_box, r.page_width, r.page_height) for r in rows] == [
        ("a", 90, [0, 0, 200, 300], [10, 10, 110.5, 60], 50, 100.5),
        ("a", 0, [0, 0, 200, 300], [0, 0, 200, 300], 200, 300),
    ]


def test_service_answers_uploads(spark, folder, tmp_path):
    from quire.streaming.service import serve

    def job(docs, keep):
        def fails(image):
            if len(detector([image])[0]) == 4:
                raise RuntimeError("model is down")
            return reader(image)

        return engine.hybrid(docs, detector, fails, crop_reader, keep=keep)

    uploads, out = tmp_path / "uploads", str(tmp_path / "out")
    uploads.mkdir()
    for name in ("a.pdf", "b.png"):
        os.rename(os.path.join(folder, name), uploads / name)
    serve(spark, str(uploads), out, job).trigger(availableNow=True).start().awaitTermination(180)
    files = spark.read.parquet(f"{out}/files").collect()
    assert [r.doc_id.rsplit("/")[-1] for r in files] == ["b.png"] and bytes(files[0].content).startswith(b"%PDF")
    assert json.loads(sinks.text_of(spark, f"{out}/texts", files[0].doc_id)) == {"0": ["line number 0 of the page"]}
    told = {r.job_id.rsplit("/")[-1]: (r.percent, r.message) for r in latest(spark.read.parquet(f"{out}/events")).collect()}
    assert told["b.png"][0] == 100 and told["a.pdf"][0] == 0 and "model is down" in told["a.pdf"][1]
    assert not os.listdir(f"{out}/work")
    # uploads go once a later batch ends
    (uploads / "c.png").write_bytes(page([200]))
    serve(spark, str(uploads), out, job).trigger(availableNow=True).start().awaitTermination(180)
    assert spark.read.parquet(f"{out}/files").count() == 2


def test_whole_pages_are_lines_from_the_top(spark):
    box = "struct<x0:double,y0:double,x1:double,y1:double>"
    long = "a very long line " * 30
    boxes = spark.createDataFrame([("d", 0, 0, (0.0, 0.0, 1.0, 1.0), f"one\n\n two \n{long}", 612.0, 792.0)], f"doc_id string, page_index int, box_idx int, box {box}, text string, page_width double, page_height double")
    from quire.operators import layer

    cut = layer.tall_slices(layer.line_slices(boxes).drop("slice_idx"), F.col("page_width"), F.col("page_height"))
    found = sorted(engine.sinks_scaled(layer.drawn(cut, F.col("page_width"), F.col("page_height"))).collect(), key=lambda r: r.line)
    assert [(r.text, r.x, r.font_size) for r in found] == [("one", 10, 6), ("two", 10, 6), (long.strip(), 10, 6)]
    assert [round(r.baseline_y, 3) for r in found] == [16.45, 24.694, 32.938] and [r.scale_x for r in found[:2]] == [1, 1] and found[2].scale_x < 1


def test_crops_are_pictures_that_endpoints_read(spark, folder):
    pages = page_rows(read_documents(spark, folder), PlainPages()).cache()
    cut = models.crops(pages, models.detected(pages, detector)).where("image is not null").collect()
    assert cut and all(media_type(bytes(r.image)) == "image/png" and decoded(bytes(r.image)).size for r in cut)
