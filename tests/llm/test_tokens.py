import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from refrain.llm import packing, records, token_counts
from refrain.llm.tokenization import Encoder, encoder, version_digest

PARTS = [" ", "  ", "   ", "\n", "\t", "\r", "\x1c", "\x85", "\xa0", " ", "a", "B", "é", "é", "̈", "1", "23", "'s", "'LL", "!", "##", ",", ".", "<|endoftext|>", "<|startoftext|>", "İ", "Σ", "ß", "日本", "😀", "‍", "\0"]
LONG = "word " * 30_000
DOCS = [(3, "b two"), (1, "A one."), (None, "no id"), (7, None), (5, ""), (1, "A one."), (9, LONG), (8, "x" * 20_000)]
SCHEMA = "doc_id long, text string, start string, n int"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "clash", 1) for i, t in rows], SCHEMA)


@pytest.mark.parametrize("name", ["words_path", "bytes_path"])
def test_encoder_equals_the_library(request, name):
    path = request.getfixturevalue(name)
    rng = random.Random(3)
    texts = ["".join(rng.choice(PARTS) for _ in range(rng.randrange(15))) for _ in range(6000)] + ["", " ", "  ", "a  ", "\n\n\nb"]
    ids, counts = Encoder(path).encode(pa.array([*texts, None]))
    plain = Tokenizer.from_file(path)
    at = 0
    for t, n in zip([*texts, ""], counts, strict=True):
        assert plain.encode(t, add_special_tokens=False).ids == ids[at : at + n].tolist(), repr(t)
        at += n


def test_frames_detect_damage():
    data = records.frame(b"payload")
    assert records.unframe(data) == b"payload"
    for at in (0, 9, 14, len(data) - 1):
        with pytest.raises(records.CorruptRecord):
            records.unframe(data[:at] + bytes([data[at] ^ 1]) + data[at + 1 :])
    with pytest.raises(records.CorruptRecord):
        records.unframe(data[:-3])


def expected(path, rows, end):
    plain = Tokenizer.from_file(path)
    return [(i, np.array([*plain.encode(t or "", add_special_tokens=False).ids, end], "<u4")) for i, t in rows]


def test_records_round_trip(spark, words_path, shared):
    out = shared("records")
    index = records.write_records(frame(spark, DOCS), out, words_path, end_id=2)
    got = sorted(records.read_records(index, out).collect(), key=lambda r: r.start)
    want = expected(words_path, sorted(DOCS, key=lambda d: (d[0] is not None, d[0] or 0, d[1] or "")), 2)
    start = 0
    for r, (i, ids) in zip(got, want, strict=True):
        assert (r.doc_id, r.start, r.n_tokens, r.ids, r.ids_crc32) == (i, start, len(ids), ids.tolist(), zlib.crc32(ids.tobytes()))
        start += len(ids)
    shuffled = records.read_records(records.read_index(spark, out).orderBy("length", "offset").repartition(3), out, checks_only=True)
    assert shuffled.count() == len(DOCS)


def test_records_that_do_not_fit_are_errors(spark, words_path, shared):
    out = shared("records")
    index = records.write_records(frame(spark, DOCS), out, words_path, end_id=2)
    with pytest.raises(Exception, match="CorruptRecord"):
        records.read_records(index.withColumn("n_tokens", index.n_tokens + 1), out).collect()
    with pytest.raises(Exception, match="outside the vocabulary"):
        records.write_records(frame(spark, DOCS), shared("records"), words_path, end_id=2, vocabulary=100)


def test_records_of_nothing(spark, words_path, shared):
    out = shared("records")
    index = records.write_records(frame(spark, []), out, words_path, end_id=2)
    assert records.read_records(index, out).count() == 0


def test_packing_is_whole_and_gapless(spark, words_path):
    rows = packing.pack(frame(spark, DOCS), words_path, end_id=1).toPandas()
    want = expected(words_path, DOCS, 1)
    assert rows["length"].sum() == sum(len(ids) for _, ids in want)
    ids = dict((i, x) for i, x in want)
    for r in rows.dropna(subset="doc_id").itertuples():
        assert r.ids_crc32 == zlib.crc32(ids[int(r.doc_id)][r.start : r.start + r.length].tobytes())
    for _, seq in rows.groupby("sequence_id"):
        seq = seq.sort_values("offset")
        assert seq["offset"].tolist() == (seq["length"].cumsum() - seq["length"]).tolist() and seq["length"].sum() <= 4096
    assert rows["sequence_id"].nunique() == -(-rows["length"].sum() // 4096)
    assert packing.pack(frame(spark, []), words_path, end_id=1).count() == 0


def test_blocks_meet(spark, monkeypatch):
    rng = random.Random(6)
    for lengths in ([rng.randint(1, 90) for _ in range(3 * 64)], [60] * 150, [rng.randint(30, 45) for _ in range(200)]):
        made = spark.createDataFrame([(i, 0, 0, n, i) for i, n in enumerate(lengths)], packing.PIECE_SCHEMA)
        monkeypatch.setattr(packing, "cut_pieces", lambda *a, made=made: made)
        rows = packing.pack(made, "", 1, capacity=100, block_pieces=64).toPandas()
        assert sorted(rows["length"]) == sorted(lengths) and rows.groupby("sequence_id")["length"].sum().max() <= 100
        for _, seq in rows.groupby("sequence_id"):
            seq = seq.sort_values("offset")
            assert seq["offset"].tolist() == (seq["length"].cumsum() - seq["length"]).tolist()
        assert rows["sequence_id"].nunique() <= len(packing.pack_block(lengths, 100)) + 1


@pytest.mark.parametrize("kind", ["equal", "thirds", "mixed"])
def test_local_search_improves_best_fit(kind):
    rng = random.Random(1)
    lengths = {"equal": [3000] * 500, "thirds": [rng.randint(1200, 1500) for _ in range(600)], "mixed": [rng.randint(1, 4095) for _ in range(900)]}[kind]
    first = packing.best_fit_decreasing(lengths, 4096)
    bins = packing.pack_block(lengths, 4096)
    assert sorted(i for b in bins for i in b) == list(range(len(lengths)))
    assert all(sum(lengths[i] for i in b) <= 4096 for b in bins)
    assert len(bins) <= len(first) and packing.squared_fill(bins, lengths) >= packing.squared_fill(first, lengths)
    if kind == "thirds":
        assert len(bins) < len(first)


def test_local_search_swaps_empty_a_bin():
    # One-for-one and two-for-one exchanges are needed: 6+4 | 5+5 from a poor start.
    search = packing.LocalSearch([[0, 1], [2], [3]], [6, 3, 4, 5, 2][:4], 10)
    bins = search.run()
    assert sorted(i for b in bins for i in b) == [0, 1, 2, 3] and len(bins) == 2


def test_counts_and_cache(spark, bytes_path, shared):
    cache = shared("cache")
    plain = Tokenizer.from_file(bytes_path)
    for rows in (DOCS, [*DOCS, (20, "new text <|endoftext|>"), (21, LONG)]):
        got = token_counts.token_counts(frame(spark, rows), cache, bytes_path).collect()
        want = [(i, len((t or "").encode()), len(plain.encode(t or "", add_special_tokens=False).ids)) for i, t in rows]
        key = lambda r: (r[0] is not None, *map(str, r))
        assert sorted([(r.doc_id, r.n_bytes, r.n_tokens) for r in got], key=key) == sorted(want, key=key)
        assert all(r.over_limit == (r.n_tokens > 1024) for r in got)
        assert spark.read.parquet(cache).count() == len({t or "" for _, t in rows})
    assert spark.read.parquet(cache).select("version").distinct().collect()[0][0] == version_digest(bytes_path)
    assert token_counts.token_counts(frame(spark, []), cache, bytes_path).count() == 0


def test_one_encoder_a_process(words_path):
    assert encoder(words_path) is encoder(words_path)
