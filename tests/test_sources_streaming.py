import json
import struct

import pandas as pd
import pytest
from pyspark.sql import functions as F

from quirelake.sources import readers
from quirelake.streaming import cases


def test_golden_and_manifest(spark, tmp_path):
    (tmp_path / "g.json").write_text(json.dumps({"name": "n", "language": "pt", "pages": ["a", "b"]}, indent=1))
    rows = readers.golden_pages(readers.golden(spark, str(tmp_path))).collect()
    assert [(r.page_no, r.text) for r in rows] == [(1, "a"), (2, "b")]
    (tmp_path / "m.json").write_text('{"status": "odd"}')
    with pytest.raises(Exception, match="may not be"):
        readers.manifest(spark, str(tmp_path / "m.json"), "status string", ["status"], {"status": ["approved"]}).collect()


def test_images_uploads_and_snapshot(spark, tmp_path):
    png = b"\x89PNG\r\n\x1a\n" + struct.pack(">I", 13) + b"IHDR" + struct.pack(">II", 640, 480)
    jpg = b"\xff\xd8" + b"\xff\xe0\x00\x04ab" + b"\xff\xc0\x00\x0b\x08" + struct.pack(">HH", 20, 30) + b"\x01"
    (tmp_path / "a.png").write_bytes(png)
    (tmp_path / "b.jpg").write_bytes(jpg)
    (tmp_path / "c.pdf").write_bytes(b"no")
    sizes = {r.path[-5:]: (r.width, r.height, r.accepted) for r in readers.images(spark, str(tmp_path), 100_000).collect()}
    assert sizes == {"a.png": (640, 480, False), "b.jpg": (30, 20, True), "c.pdf": (None, None, None)}
    assert {r.path[-5:]: r.refused for r in readers.uploads(spark, str(tmp_path)).collect()} == {"a.png": None, "b.jpg": None, "c.pdf": "bad_signature"}
    (tmp_path / "d.html").write_bytes("ação".encode("cp1252"))
    assert readers.snapshot(spark, str(tmp_path / "d.html")).first().text == "ação"
    with pytest.raises(Exception, match="hash differs"):
        readers.snapshot(spark, str(tmp_path / "d.html"), sha256="0" * 64).collect()
    assert readers.snapshot(spark, str(tmp_path), "./d.html").first().text == "ação"
    for name in ("../d.html", "/etc/passwd", "a/../../b", "c:\\x", ""):
        with pytest.raises(ValueError, match="not inside"):
            readers.confined(str(tmp_path), name)
    (tmp_path / "e.html").write_bytes(b"\x81\x8d")
    with pytest.raises(Exception, match="decode"):
        readers.snapshot(spark, str(tmp_path / "e.html")).collect()


def test_labels_are_checked_on_load(spark, tmp_path):
    case = {"case_id": "c1", "relevant": [{"article_id": "a1", "unit_id": None, "grade": 1}, {"article_id": "a1", "unit_id": "u9", "grade": 2}], "hard_negatives": ["a2"]}
    (tmp_path / "g.json").write_text(json.dumps({"dataset_id": "d", "cases": [case]}))
    cases = readers.golden(spark, str(tmp_path), readers.CONSUMER_GOLDEN)
    known = spark.createDataFrame([("a1", "active"), ("a2", "revoked"), ("u9", "active")], "id string, status string")
    with pytest.raises(ValueError, match="c1: a2 is inactive"):
        readers.checked_labels(cases, known)
    with pytest.raises(ValueError, match="c1: u9 is unknown"):
        readers.checked_labels(cases, known.filter("id <> 'u9'"))
    assert readers.checked_labels(cases, known.withColumn("status", F.lit("active"))).count() == 1


def test_ingest(spark, tmp_path):
    (tmp_path / "x.txt").write_bytes(b"a long native page text that is long enough to need no reading\x0c ")
    pages = readers.ingest(spark, str(tmp_path), lambda b: b.decode().split("\x0c"), lambda b, n: "This was read from the picture of page two")
    assert [(r.page_no, r.method) for r in pages.orderBy("page_no").collect()] == [(1, "native"), (2, "ocr")]
    assert readers.documents_of(pages).first().method == "hybrid"


def test_running_totals(spark, tmp_path):
    log, out = str(tmp_path / "log"), []
    for row in (("a", True, None, 0.5, 10, None), ("b", False, None, 0.25, 5, None)):
        readers.append_log(spark.createDataFrame([row], readers.RUN), log)
        writer = cases.log_totals(spark, log).writeStream.outputMode("complete").option("checkpointLocation", str(tmp_path / "state"))
        query = writer.foreachBatch(lambda rows, n: out.append(rows.first())).trigger(availableNow=True).start()
        assert query.awaitTermination(60)
    assert [(r.runs, r.failures, r.total_tokens) for r in out] == [(1, 0, 10), (2, 1, 15)]


class State:
    exists, hasTimedOut, get = False, False, None

    def update(self, value):
        self.exists, self.get = True, value

    def setTimeoutDuration(self, ms):
        self.ms = ms


def test_case_state():
    state = State()
    frame = lambda *rows: pd.DataFrame(rows, columns=["client_message_id", "content", "created_at"])
    next(cases._step(("c",), iter([frame(("1", "Sofri um  golpe", 1))]), state))
    row = next(cases._step(("c",), iter([frame(("3", "Quero estorno", 3), ("2", None, 2))]), state)).iloc[0]
    assert (row.case_id, row.complaint_summary, row.issue_category, row.desired_resolution, row.messages) == ("c", "Sofri um golpe", "fraud", "Quero estorno", 3)


def test_batch_tried_again_is_there_once(spark, tmp_path):
    path = str(tmp_path / "progress")
    rows = spark.createDataFrame([("j", 1), ("j", 2)], "job_id string, stage_no int")
    for batch in (0, 1, 1):
        cases.put_batch(rows, path, batch)
    assert sorted(tuple(r) for r in spark.read.parquet(path).collect()) == [("j", n, b) for n in (1, 2) for b in (0, 1)]
