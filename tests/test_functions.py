import hashlib
import unicodedata
import re

import pytest
from pyspark.sql import functions as F

from quirelake.functions import money, text, vectors


def one(spark, **columns):
    return spark.range(1).select(**{}) if not columns else spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


SAMPLES = ["Ação Civil Pública nº 42_b", "Straße ÇÃO", "", "naïve  café\t x", "ÀÉÎÕÜ ñ 123"]


def plain_tokens(t):
    folded = "".join(c for c in unicodedata.normalize("NFKD", t.casefold()) if not unicodedata.combining(c))
    return re.findall("[a-z0-9]+", folded)


def test_lexical_tokens_and_citation_form(spark):
    rows = spark.createDataFrame([(s,) for s in SAMPLES], "t string").select("t", text.lexical_tokens(F.col("t")).alias("k"), text.citation_form(F.col("t")).alias("c"), text.collapse(F.col("t")).alias("w")).collect()
    for r in rows:
        assert r.k == plain_tokens(r.t)
        folded = "".join(c for c in unicodedata.normalize("NFKD", r.t) if not unicodedata.combining(c)).casefold()
        assert r.c == " ".join(re.sub(r"[^\w\s]", " ", folded).split())
        assert r.w == " ".join(r.t.split())


def test_quotes_match_without_accents_or_case(spark):
    r = one(spark, a=text.quote_in(F.lit("AÇÃO civil"), F.lit("a acao  Civil, publica")), b=text.quote_in(F.lit("absent"), F.lit("text")), c=text.quote_in(F.lit("..."), F.lit("text")))
    assert (r.a, r.b, r.c) == (True, False, False)


def test_headings(spark):
    lines = ["DOS FATOS", "DO DIREITO E DA TUTELA", "O autor alega que.", "", "R$ 10.000,00"]
    got = [r[0] for r in spark.createDataFrame([(s,) for s in lines], "t string").select(text.is_heading(F.col("t"))).collect()]
    assert got == [True, True, False, False, False]


def test_truncation_and_preview(spark):
    r = one(spark, a=text.truncated(F.lit("ab cd ef"), 5), b=text.truncated(F.lit("abcdefgh"), 5), c=text.truncated(F.lit(" a  b "), 9), d=text.preview(F.lit("x " * 200)))
    assert (r.a, r.b, r.c) == ("ab", "abcde", "a b") and r.d.endswith("…") and len(r.d) <= 240


def test_hash_bucket_and_cosine(spark):
    for word, bucket in (("cobranca", 15), ("danos", 0), ("morais", 62)):
        assert one(spark, a=text.hash_bucket(F.lit(word), 128)).a == bucket == int.from_bytes(hashlib.md5(word.encode()).digest()[:4], "big") % 128
    v = lambda *x: F.array(*[F.lit(float(y)) for y in x])
    r = one(spark, a=vectors.cosine(v(1, 0), v(1, 1)), b=vectors.cosine(v(0, 0), v(1, 1)))
    assert r.a == pytest.approx(0.5**0.5) and r.b == 0
    with pytest.raises(Exception, match="length"):
        one(spark, a=vectors.cosine(v(1), v(1, 2)))


def test_money_and_case_numbers(spark):
    want = {"0001234-56.2024.8.26.0100": "tjsp", "0001234-56.2024.8.19.0001": "tjrj", "0001234-56.2024.8.07.0001": "tjdft", "0001234-56.2024.5.15.0001": "trt15", "0001234-56.2024.4.03.0001": "trf3", "0001234-56.2024.9.01.0001": None, "none": None}
    rows = spark.createDataFrame([(k,) for k in want], "t string").select("t", money.tribunal(money.case_number(F.col("t"))).alias("a")).collect()
    assert {r.t: r.a for r in rows} == want
    r = one(spark, a=money.token_cost(F.lit("gpt-4o"), F.lit(1000), F.lit(100)), b=money.token_cost(F.lit("?"), F.lit(1), F.lit(1)), c=money.format_brl(F.lit(1234.5)))
    assert r.a == pytest.approx(0.0035) and r.b is None and r.c == "1.234,50"
