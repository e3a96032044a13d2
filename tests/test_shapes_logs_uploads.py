import hashlib
import io
import json

import pytest
from pyspark.sql import functions as F

from quirelake.functions.canonical import canonical_json
from quirelake.operators import shapes
from quirelake.sources import logs, uploads
from quirelake.sources.readers import RUN


def test_hits_of_any_shape(spark):
    results = [
        "BR-cdc-art-42-paragrafo-1 ",
        "br-cdc-art-6",
        {"provision_id": "p1", "unit_id": "u1", "score": "0.5", "status": "active"},
        {"metadata": {"provision_id": "p2", "score": 2}, "score": None, "unit_id": None},
        {"chunk": {"chunk_id": "br-x-art-1-caput", "metadata": {"status": "revoked"}}, "metadata": {}},
        {"chunk": {"metadata": {"provision_id": "p3"}}, "status": "active"},
        {"chunk_id": "other"},
        7,
        None,
    ]
    rows = spark.createDataFrame([(1, json.dumps(results)), (2, "no json"), (3, "[]"), (4, None), (5, '{"a": 1}')], "q int, results string")
    got = {(r.q, r.position): (r.provision_id, r.unit_id, r.score, r.status, r.error) for r in shapes.hits(rows, key="q", results="results").collect()}
    assert got[1, 1] == ("br-cdc-art-42", "br-cdc-art-42-paragrafo-1", 0.0, "unknown", None)
    assert got[1, 2] == ("br-cdc-art-6", None, 0.0, "unknown", None)
    assert got[1, 3] == ("p1", "u1", 0.5, "active", None)
    assert got[1, 4] == ("p2", None, 0.0, "unknown", None)  # a field that is there and null is not looked for elsewhere
    assert got[1, 5] == ("br-x-art-1", "br-x-art-1-caput", 0.0, "revoked", None)
    assert got[1, 6] == ("p3", None, 0.0, "active", None)
    assert all(got[1, n][4] == "a hit needs a provision_id" for n in (7, 8, 9))
    assert [got[q, 1][4] for q in (2, 4, 5)] == ["no list of hits"] * 3 and (3, 1) not in got


def test_conclusions_at_any_depth(spark):
    one = lambda n, c=0.5, cited=0: {"statement": n, "confidence": c, "citations": [{"page": 1}] * cited}
    report = {"classification": {"conclusion": one("a", 0.9, 2)}, "main_claims": [{"assessment": one("b")}, {"assessment": one("c", 1)}], "evidence_found": [one("d")], "risk": {"overall": one("e"), "risks": [{"conclusion": {**one("f"), "inner": [one("g")]}}]}, "statement": "no number", "other": {"statement": 5, "confidence": "x"}}
    rows = spark.createDataFrame([(1, json.dumps(report)), (2, json.dumps([one("x")])), (3, None), (4, "broken"), (5, json.dumps(one("y")))], "run int, report string")
    got = {(r.run, r.statement): (r.confidence, r.citations) for r in shapes.conclusions(rows, key="run", document="report").collect()}
    assert got == {(1, "a"): (0.9, 2), (1, "b"): (0.5, 0), (1, "c"): (1.0, 0), (1, "d"): (0.5, 0), (1, "e"): (0.5, 0), (1, "f"): (0.5, 0), (1, "g"): (0.5, 0), (2, "x"): (0.5, 0), (5, "y"): (0.5, 0)}
    deep = json.dumps([[[[one("z")]]]])
    with pytest.raises(Exception, match="more than 2 levels"):
        shapes.conclusions(spark.createDataFrame([(1, deep)], "run int, report string"), key="run", document="report", levels=2).collect()


def test_canonical_json(spark):
    schema = "b struct<z:int,a:array<string>>, a string, d decimal(10,2), t date, f boolean, n long"
    rows = spark.createDataFrame([({"z": 1, "a": ["x\"\\\n\u0001é", None]}, "ç/\t", None, None, True, 5), (None, None, None, None, None, None)], schema)
    row = F.struct(*[F.col(c) for c in rows.columns])
    kind = rows.select(row.alias("r")).schema["r"].dataType
    got = [r[0] for r in rows.select(canonical_json(row, kind)).collect()]
    want = [{"b": {"z": 1, "a": ["x\"\\\n\u0001é", None]}, "a": "ç/\t", "d": None, "t": None, "f": True, "n": 5}, dict.fromkeys("b a d t f n".split())]
    assert got == [json.dumps(w, sort_keys=True, separators=(",", ":"), ensure_ascii=False) for w in want]
    with pytest.raises(TypeError):
        canonical_json(F.lit(1.5), spark.createDataFrame([(1.5,)], "x double").schema["x"].dataType)


def test_newest_lines_and_damaged_ones(spark, tmp_path):
    """Three files written one after the other; lines keep their order in each."""
    import os

    log = tmp_path / "log"
    log.mkdir()
    good = lambda i: json.dumps({"run_id": f"r{i:03d}", "success": True, "tokens": i})
    for n in range(3):
        lines = [good(100 * n + i) for i in range(50)]
        lines[10:10] = ["{broken", '["no object"]', '{"success": true}', "", '{"run_id": "x", "tokens": "many"}']
        path = log / f"{'cab'[n]}.json"  # names are not in the order of time
        path.write_text("\n".join(lines) + "\n")
        os.utime(path, (1_700_000_000 + n, 1_700_000_000 + n))
    spark.conf.set("spark.sql.files.maxPartitionBytes", 700)
    try:
        newest = [r.run_id for r in logs.newest(spark, str(log), RUN, ["run_id"], 60).collect()]
        broken = logs.damaged(spark, str(log), RUN, ["run_id"]).collect()
        plan = logs.newest(spark, str(log), RUN, ["run_id"], 60)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert newest == [f"r{200 + i:03d}" for i in range(49, -1, -1)] + [f"r{100 + i:03d}" for i in range(49, 39, -1)]
    assert sorted((r.reason, r.value) for r in broken) == sorted([("no_json", "{broken"), ("no_json", '["no object"]'), ("invalid", '{"success": true}'), ("invalid", '{"run_id": "x", "tokens": "many"}')] * 3)
    assert "TakeOrderedAndProject" in plan


class Counting(io.BytesIO):
    asked = 0

    def read(self, n=-1):
        part = super().read(n)
        Counting.asked += len(part)
        return part


def test_blocks_stop_at_the_cap():
    data = bytes(range(256)) * 20
    assert uploads.read_in_blocks(io.BytesIO(data), len(data), 1000) == (len(data), data[:16], hashlib.sha256(data).hexdigest())
    Counting.asked = 0
    assert uploads.read_in_blocks(Counting(data), 1500, 1000) == (1501, data[:16], None) and Counting.asked == 1501
    assert uploads.read_in_blocks(io.BytesIO(b""), 10) == (0, b"", hashlib.sha256(b"").hexdigest())


def test_upload_source(spark, tmp_path):
    spark.dataSource.register(uploads.UploadSource)
    (tmp_path / "sub").mkdir()
    files = {"a.pdf": b"%PDF" + b"x" * 3_000_000, "sub/b.bin": b"y" * 5_000_000, "c.txt": b""}
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    got = {r.path[len(str(tmp_path)) + 1 :]: r for r in spark.read.format("uploads").option("mostBytes", 4_000_000).load(str(tmp_path)).collect()}
    assert {n: (r.length, r.sha256, r.too_large) for n, r in got.items()} == {
        "a.pdf": (3_000_004, hashlib.sha256(files["a.pdf"]).hexdigest(), False), "sub/b.bin": (4_000_001, None, True), "c.txt": (0, hashlib.sha256(b"").hexdigest(), False)}
    assert bytes(got["a.pdf"].header) == b"%PDF" + b"x" * 12
