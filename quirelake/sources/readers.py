"""Sources and sinks: paged documents, golden sets, logs, images and statute snapshots."""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import usable_ocr_text
from ..operators.records import label_errors

BUSINESS_GOLDEN = "name STRING, language STRING, pages ARRAY<STRING>, expected STRUCT<lawsuit_type:STRING,case_number:STRING,claim_value_amount:DOUBLE,plaintiff:STRING,defendant:STRING,main_requests_contains:ARRAY<STRING>>, retrieval STRUCT<k:INT,queries:ARRAY<STRUCT<query:STRING,relevant_page_ranges:ARRAY<STRUCT<start:INT,end:INT>>,relevant_passages:ARRAY<STRING>>>>"
CONSUMER_GOLDEN = "dataset_id STRING, version STRING, description STRING, source_url STRING, authoring STRING, review_status STRING, target_corpus_release_id STRING, target_corpus_sha256 STRING, cases ARRAY<STRUCT<case_id:STRING,category:STRING,slices:ARRAY<STRING>,complaint:STRING,desired_resolution:STRING,relevant:ARRAY<STRUCT<article_id:STRING,unit_id:STRING,grade:INT,rationale:STRING>>,hard_negatives:ARRAY<STRING>,no_applicable_ground:BOOLEAN>>"
SIGNATURES = {".pdf": "25504446", ".png": "89504E470D0A1A0A", ".jpg": "FFD8FF", ".jpeg": "FFD8FF"}


def golden(spark: SparkSession, path: str, schema: str = BUSINESS_GOLDEN) -> DataFrame:
    """Golden cases, one JSON object a file."""
    found = spark.read.schema(schema).json(path, multiLine=True)
    if found.isEmpty():
        raise ValueError(f"no golden case in {path}")
    return found


def checked_labels(cases: DataFrame, known: DataFrame) -> DataFrame:
    """Consumer golden cases, or an error that names their labels which the corpus does not have or no longer has.

    ``cases`` has the schema CONSUMER_GOLDEN, ``known``: id, status of articles and units.
    """
    each = cases.select(F.explode("cases").alias("c")).select("c.case_id", F.explode(F.concat(F.flatten(F.array(F.transform("c.relevant", lambda r: F.coalesce(r["unit_id"], r["article_id"])))), "c.hard_negatives")).alias("id"))
    wrong = label_errors(each, known).orderBy("case_id", "id").limit(10).collect()
    if wrong:
        raise ValueError("labels: " + "; ".join(f"{r['case_id']}: {r['id']} is {r['problem']}" for r in wrong))
    return cases


def golden_pages(cases: DataFrame) -> DataFrame:
    return cases.select("name", F.posexplode("pages").alias("n", "text")).select("name", (F.col("n") + 1).alias("page_no"), "text")


def manifest(spark: SparkSession, path: str, schema: str, required: list[str], allowed: dict[str, list[str]]) -> DataFrame:
    """A JSON manifest; a missing field or a value outside its list raises."""
    rows = spark.read.schema(schema).json(path, multiLine=True)
    for name in required:
        rows = rows.withColumn(name, F.when(F.col(name).isNull(), F.raise_error(F.lit(f"{name} is missing")).cast(rows.schema[name].dataType)).otherwise(F.col(name)))
    for name, values in allowed.items():
        rows = rows.withColumn(name, F.when(~F.col(name).isin(values), F.raise_error(F.concat(F.lit(f"{name} may not be "), F.col(name)))).otherwise(F.col(name)))
    return rows


def confined(folder: str, name: str) -> str:
    """The path of a file inside a folder; a name that leads out of it is refused."""
    parts = name.replace("\\", "/").split("/")
    if name.startswith(("/", "\\")) or ":" in parts[0] or ".." in parts or not name:
        raise ValueError(f"{name} is not inside the folder")
    return f"{folder.rstrip('/')}/{'/'.join(p for p in parts if p not in ('', '.'))}"


def snapshot(spark: SparkSession, folder: str, name: str | None = None, sha256: str | None = None, charset: str = "windows-1252") -> DataFrame:
    """Files with their text; content that does not have the given hash, or is not of the charset, raises.

    With ``name`` only that file of the folder is read, and none outside it.
    """
    files = spark.read.format("binaryFile").load(confined(folder, name) if name else folder)

    @F.pandas_udf("string")
    def decoded(content: pd.Series) -> pd.Series:
        return content.map(lambda b: bytes(b).decode(charset))

    content = F.col("content")
    if sha256:
        content = F.when(F.sha2(content, 256) == sha256, content).otherwise(F.raise_error(F.lit("snapshot hash differs")).cast("binary"))
    return files.select("path", F.sha2("content", 256).alias("sha256"), decoded(content).alias("text"))


def signature_ok(path: Column, content: Column) -> Column:
    """Whether the first bytes fit the file's suffix."""
    head, suffix = F.hex(F.substring(content, 1, 8)), F.lower(F.regexp_extract(path, r"(\.[A-Za-z]+)$", 1))
    out = F.lit(False)
    for ending, magic in SIGNATURES.items():
        out = F.when(suffix == ending, F.startswith(head, F.lit(magic))).otherwise(out)
    return out


def uploads(spark: SparkSession, path: str, most: int = 20 * 1024 * 1024) -> DataFrame:
    """Files with hash and the reason of a refusal (null if accepted)."""
    files = spark.read.format("binaryFile").load(path)
    reason = F.when(F.col("length") > most, "too_large").when(~signature_ok(F.col("path"), F.col("content")), "bad_signature")
    return files.select("path", "length", F.sha2("content", 256).alias("sha256"), reason.alias("refused"))


def image_size(data: bytes, most_segments: int = 512) -> tuple[int, int] | None:
    """Width and height from a PNG or JPEG header, without decoding."""
    if data[:8] == b"\x89PNG\r\n\x1a\n" and data[12:16] == b"IHDR" and len(data) >= 24:
        return struct.unpack(">II", data[16:24])
    if data[:2] != b"\xff\xd8":
        return None
    at = 2
    for _ in range(most_segments):
        while at < len(data) and data[at] == 0xFF:
            at += 1
        if at + 3 > len(data):
            return None
        marker = data[at]
        at += 1
        if marker in (0x01, *range(0xD0, 0xD9)):
            continue
        size = int.from_bytes(data[at : at + 2], "big")
        if 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC) and at + 7 <= len(data):
            return int.from_bytes(data[at + 5 : at + 7], "big"), int.from_bytes(data[at + 3 : at + 5], "big")
        if size < 2:
            return None
        at += size
    return None


def images(spark: SparkSession, path: str, most_pixels: int = 40_000_000) -> DataFrame:
    """Width, height and whether the pixel cap is kept."""

    @F.pandas_udf("struct<width:int,height:int>")
    def measured(content: pd.Series) -> pd.DataFrame:
        sizes = [image_size(bytes(b)) or (None, None) for b in content]
        return pd.DataFrame({"width": pd.array([s[0] for s in sizes], "Int32"), "height": pd.array([s[1] for s in sizes], "Int32")})

    rows = spark.read.format("binaryFile").load(path).select("path", measured("content").alias("s"))
    return rows.select("path", "s.width", "s.height", (F.col("s.width").cast("long") * F.col("s.height") <= most_pixels).alias("accepted"))


#: A parser gives the page texts of one file; PDF and OCR engines are plugged in here.
PageParser = Callable[[bytes], list[str]]


def ingest(spark: SparkSession, path: str, parse: PageParser, ocr: Callable[[bytes, int], str | None] | None = None, *, most_pages: int = 250) -> DataFrame:
    """Paged documents: path, page_no, text, method (native or ocr), needs_ocr.

    Pages with fewer than 50 characters go to ``ocr`` if there is one; its text is
    taken if it passes the quality floor.
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for name, content in zip(batch["path"], batch["content"], strict=True):
                pages = parse(bytes(content))
                if len(pages) > most_pages:
                    raise ValueError(f"{name} has more than {most_pages} pages")
                for n, text in enumerate(pages, 1):
                    needs = len(text.strip()) < 50
                    rows.append((name, n, text, ocr(bytes(content), n) if needs and ocr else None, needs))
            yield pd.DataFrame(rows, columns=["path", "page_no", "native", "read", "needs_ocr"])

    rows = spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(read, "path string, page_no int, native string, read string, needs_ocr boolean")
    good = F.coalesce(usable_ocr_text(F.col("read")), F.lit(False))
    return rows.select("path", "page_no", F.when(good, F.col("read")).otherwise(F.col("native")).alias("text"), F.when(good, "ocr").otherwise("native").alias("method"), "needs_ocr")


def documents_of(pages: DataFrame, *, file: str = "path") -> DataFrame:
    """One row for each file: doc_id (first 16 hex digits of the text's hash), full_text, method, warnings."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_no", "text"))), lambda p: p["text"]), "\n\n")
    n, read, open_pages = F.count("*"), F.count_if(F.col("method") == "ocr"), F.count_if(F.col("needs_ocr") & (F.col("method") == "native"))
    rows = pages.groupBy(file).agg(text.alias("full_text"), n.alias("pages"), F.when(read == 0, "native").when(read == n, "ocr").otherwise("hybrid").alias("method"), F.when(open_pages > 0, F.array(F.lit("pages_without_text"))).otherwise(F.array().cast("array<string>")).alias("warnings"))
    return rows.withColumn("doc_id", F.substring(F.sha2("full_text", 256), 1, 16))


#: Frequent short words by language; the offline stand-in for a language detector.
STOP_WORDS = {"pt": "de que não para com uma os por mais como".split(), "en": "the of and to in is that it for was".split(), "es": "que de no los del las por una con para".split(), "fr": "de la le et les des que une pour dans".split(), "de": "der die und das von mit den ist für nicht".split()}


def language(text: Column, default: str = "pt") -> Column:
    """Vote of stop words over the first 5000 characters; the default below 40 characters or without votes."""
    words = F.split(F.lower(F.substring(text, 1, 5000)), r"[^\p{L}]+")

    def vote(own: list[str]) -> Column:
        return F.size(F.filter(words, lambda w: w.isin(own))).alias("n")

    votes = F.array(*[F.struct(vote(own), F.lit(name).alias("name")) for name, own in STOP_WORDS.items()])
    best = F.array_max(F.transform(votes, lambda v: F.struct(v["n"].alias("n"), v["name"].alias("name"))))
    return F.when((F.length(text) < 40) | (best["n"] == 0), F.lit(default)).otherwise(best["name"])


RUN = T.StructType([T.StructField("run_id", T.StringType()), T.StructField("success", T.BooleanType()), T.StructField("outcome", T.StringType()), T.StructField("cost_usd", T.DoubleType()), T.StructField("tokens", T.LongType()), T.StructField("finished_at", T.TimestampType())])


def append_log(runs: DataFrame, path: str) -> None:
    runs.write.mode("append").json(path)
