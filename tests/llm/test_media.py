"""Matroska: exact round trips, every lacing, unknown sizes, torn and foreign bytes."""

import hashlib
import zlib

import pytest

from casegraph.llm import matroska as M
from casegraph.llm import media

SIZES = (0, 1, 63, 64, 65, 511, 512, 600, 4096, 5000, 70_000, 300_001)


@pytest.mark.parametrize("lacing", [None, "none", "xiph", "fixed", "ebml"])
@pytest.mark.parametrize("size", SIZES)
def test_round_trip(size, lacing):
    data = media.sample_payload("ab\n" * (size // 3) + "x" * (size % 3))
    stored = M.write_samples(data, lacing=lacing)
    found = M.parse(stored)
    assert M.payload(stored, found) == data
    assert [p for _, _, p in found.cues] == found.clusters
    times = [p.timestamp_ns for p in found.packets]
    assert times == sorted(times) and times[0] == 0
    assert all(stored[p.start : p.start + p.length] for p in found.packets)


def test_variable_lengths():
    for value in (0, 1, 126, 127, 128, 16382, 16383, 2**20, 2**40, 2**55):
        assert M.read_size(M.write_size(value), 0)[0] == value
    assert M.read_size(b"\xff", 0) == (None, 1)
    assert M.read_size(b"\x01" + b"\xff" * 7, 0) == (None, 8)
    with pytest.raises(M.Malformed):
        M.read_size(b"\x00", 0)


def written(frames, lacing, group=False):
    block = M._block(frames, 3, lacing)
    if group:
        block = M.element(M.BLOCK_GROUP, M.element(M.BLOCK, block[block.index(b"\x81") :]) + M.number(M.BLOCK_DURATION, 8))
    return block


def test_uneven_laces_and_unknown_sizes():
    frames = [b"a" * 300, b"b" * 5, b"", b"c" * 255, b"d" * 70]
    head = M.element(M.EBML, b"")
    for lacing in ("xiph", "ebml"):
        body = M.number(M.CLUSTER_TIME, 10) + M._block(frames, 3, lacing)
        # Segment and both clusters of unknown size: the second cluster ends the first.
        unknown = M.CLUSTER.to_bytes(4, "big") + b"\xff"
        data = head + M.SEGMENT.to_bytes(4, "big") + b"\xff" + unknown + body + unknown + body
        found = M.parse(data)
        assert [data[p.start : p.start + p.length] for p in found.packets] == frames * 2
        assert [p.cluster for p in found.packets] == [0] * 5 + [1] * 5
        assert found.packets[0].timestamp_ns == 13_000_000
        assert {p.lacing for p in found.packets} == {lacing}


def test_tables(spark):
    good = M.write_samples(media.sample_payload("hello " * 10_000))
    rows = [(1, good), (2, None), (3, b""), (4, b"not a container"), (5, good[: len(good) // 2]), (1, good)]
    df = spark.createDataFrame(rows, "key long, media binary").withColumnRenamed("key", "id")
    packets = media.packet_table(df, "media", "id").collect()
    assert {r["id"] for r in packets} == {1, 5}
    whole = [r for r in packets if r["id"] == 1]
    assert len(whole) == 2 * len(M.parse(good).packets)
    data = b"".join(good[r["start"] : r["start"] + r["length"]] for r in whole[: len(whole) // 2])
    assert data == media.sample_payload("hello " * 10_000)
    assert {r["codec"] for r in whole} == {"A_PCM/INT/LIT"}
    assert {r["id"] for r in media.cue_table(df, "media", "id").collect()} == {1}
    assert media.packet_table(df.where("false"), "media", "id").count() == 0


def test_query_columns(odd, none):
    rows = media.stored_texts(odd).collect()
    assert len(rows) == odd.count()
    texts = sorted((r["text"] or "").encode() for r in odd.collect())
    by_text = sorted(rows, key=lambda r: r["n_bytes"])
    for r, data in zip(by_text, sorted(texts, key=len), strict=True):
        size = max(64, -(-len(data) // 64) * 64)
        assert (r["n_bytes"], r["payload_bytes"]) == (len(data), size)
    one = [r for r in rows if r["doc_id"] in (4, 5)]
    assert len({tuple(r)[1:] for r in one}) == 1
    padded = b"one".ljust(64, b"\0")
    assert one[0]["payload_sha256"] == hashlib.sha256(padded).hexdigest()
    assert one[0]["tail_crc32"] == zlib.crc32(padded)
    stored = M.write_samples(padded)
    assert (one[0]["media_bytes"], one[0]["media_sha256"]) == (len(stored), hashlib.sha256(stored).hexdigest())
    assert media.stored_texts(none).count() == 0
