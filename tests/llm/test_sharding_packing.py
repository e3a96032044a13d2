import zlib

import numpy as np
from pyspark.sql import functions as F
import pytest

from quirelake.llm import packing, sharding
from quirelake.llm.bpe import WordIds, word_ids
from quirelake.llm.queries import END_ID, tokenizer_path


def test_shards_are_contiguous_balanced_and_gapless(spark, make_docs, corpus):
    rows = sharding.balanced_shards(make_docs(corpus), 8).collect()
    got = sorted([(r["doc_id"], r[sharding.SIZE], r[sharding.CRC], r[sharding.SHARD], r[sharding.SLOT]) for r in rows])
    encoded = sorted((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in corpus)
    assert [g[:3] for g in got] == encoded
    total, start, seen = sum(e[1] for e in encoded), 0, {}
    for _, size, _, shard, slot in got:  # brute force: the shard of the middle byte
        assert shard == (2 * start + size) * 8 // (2 * total)
        assert slot == seen.get(shard, 0)
        seen[shard] = slot + 1
        start += size


def test_shards_of_nothing_and_of_null_keys(spark, make_docs):
    assert sharding.balanced_shards(make_docs([]), 4).count() == 0
    rows = sharding.balanced_shards(make_docs([(None, "a"), (None, None), (1, "b" * 1000)]), 2).collect()
    assert [r[sharding.SHARD] for r in rows if r["doc_id"] is None] == [0, 0]


def test_written_shards_hold_all_rows(spark, make_docs, corpus, tmp_path):
    sharding.write_shards(make_docs(corpus), str(tmp_path / "out"), 3)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == len(corpus) and back.select("shard").distinct().count() == 3
    # A column of that name keeps its values.
    own = make_docs(corpus).withColumn("shard", F.lit(99))
    sharding.write_shards(own, str(tmp_path / "own"), 3)
    back = spark.read.parquet(str(tmp_path / "own"))
    assert back.select("shard").distinct().collect()[0][0] == 99 and back.select("shard_").distinct().count() == 3


TRICKY = ["", "Hello World's CAN'T don't 'S", "  é É́ éx İstanbul ΣΑΣ 123 a1b2 foo_bar", "<|endoftext|>x", "\x1c a\xa0b   naïve!!!", "a\r\nb\tc", "ẞß ǅ ﬁ Å 𝔘 ..,,!?%$ x%y%%", "aaaaaaaaaaaaaaaaaaaaaaa" * 40, "²³¹¼ ªº µm ÿÀ×÷", "日本語 テスト", "x" * 5000]


def test_ids_equal_the_tokenizers():
    encoder = WordIds(tokenizer_path(), most=50)
    got = encoder.encode(TRICKY) + encoder.encode(TRICKY)
    want = [np.array(encoder.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in TRICKY]
    assert got == want * 2 and encoder.quick


def test_first_fit_decreasing_equals_the_plain_scan():
    rng = np.random.default_rng(3)
    lengths = sorted(rng.integers(1, 101, 300).tolist(), reverse=True)
    rooms, plain = [], []
    for n in lengths:
        i = next((i for i, room in enumerate(rooms) if room >= n), len(rooms))
        if i == len(rooms):
            rooms.append(100)
        plain.append((i, 100 - rooms[i]))
        rooms[i] -= n
    assert packing.first_fit_decreasing(lengths, 100) == plain


@pytest.mark.parametrize("group_docs", [8192, 7])
def test_packed_pieces(spark, make_docs, corpus, group_docs):
    rows = packing.pack(make_docs(corpus), tokenizer_path(), end_id=END_ID, capacity=64, group_docs=group_docs).collect()
    ids = {d: np.frombuffer(word_ids(tokenizer_path()).encode([t or ""])[0], "<u4").tolist() + [END_ID] for d, t in corpus}
    bins, pieces = {}, {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
        pieces.setdefault(r.doc_id, []).append((r.start, r.length, r.ids_crc32))
        part = np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4").tobytes()
        assert zlib.crc32(part) == r.ids_crc32 and r.doc_tokens == len(ids[r.doc_id])
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
    for d, parts in pieces.items():
        times = sum(x == d for x, _ in corpus)
        assert sum(p[1] for p in parts) == times * len(ids[d])
    assert packing.pack(make_docs([]), tokenizer_path(), end_id=END_ID).count() == 0
