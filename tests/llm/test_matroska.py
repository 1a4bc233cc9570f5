from __future__ import annotations

import hashlib
import struct
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fieldloom.llm import matroska as M


def payload_of(media):
    read = M.parse(media)
    return b"".join(media[o : o + n] for _, _, o, n, _, _, _ in read["packets"]), read


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=20_000))
def test_roundtrip(data):
    payload, read = payload_of(M.store(data))
    assert payload == data and len(read["cues"]) == read["clusters"]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.binary(max_size=700), min_size=2, max_size=9), st.sampled_from([1, 3]))
def test_lacing_of_any_sizes(frames, lacing):
    body = M._laced(frames, lacing)
    assert [body[a:b] for a, b in M._frames(body, 0, len(body), lacing)] == frames


def test_cues_and_times():
    media = M.store(bytes(range(256)) * 2000)
    read = M.parse(media)
    firsts = {}
    for _, t, o, *_ , cluster, _ in read["packets"]:
        firsts.setdefault(cluster, t)
    assert [t for t, _, _ in read["cues"]] == list(firsts.values())
    for _, track, at in read["cues"]:
        assert track == 1 and media[at : at + 4] == (0x1F43B675).to_bytes(4, "big")
    times = [p[1] for p in read["packets"]]
    assert times == [i * 64_000_000 for i in range(len(times))]
    assert {p[6] for p in read["packets"]} >= {2}


def test_unknown_sizes_block_groups_and_void():
    group = M._element(M.BLOCK_GROUP, M._element(M.BLOCK, b"\x82" + struct.pack(">hB", -3, 0) + b"abc"), M._number(M.DURATION, 5), M._element(M.REFERENCE, b"\xff"))
    cluster = (M.CLUSTER).to_bytes(4, "big") + b"\x01\xff\xff\xff\xff\xff\xff\xff" + M._number(M.CLUSTER_TIME, 10) + group + M._element(0xEC, b"\0\0")
    second = M._element(M.CLUSTER, M._number(M.CLUSTER_TIME, 20), M._element(M.SIMPLE_BLOCK, b"\x81" + struct.pack(">hB", 0, 128) + b"xy"))
    media = M._HEAD + (M.SEGMENT).to_bytes(4, "big") + b"\xff" + M._INFO + M._TRACKS + cluster + second
    packets = M.parse(media)["packets"]
    assert [(p[0], p[1], media[p[2] : p[2] + p[3]], p[4], p[5]) for p in packets] == [(2, 7_000_000, b"abc", False, 0), (1, 20_000_000, b"xy", True, 1)]


@pytest.mark.parametrize("cut", [0, 3, 45, 200, -5])
def test_damaged_files_raise(cut):
    with pytest.raises(ValueError):
        M.parse(M.store(b"x" * 3000)[:cut])


def test_packet_tables(spark):
    df = spark.createDataFrame([(1, bytearray(M.store(b"q" * 1100))), (2, bytearray(b"junk")), (3, None)], "id int, content binary").withColumn("media", F.lit(0))
    got = {r.id: r["media_"] for r in M.packet_tables(df, "content").collect()}
    assert [p["size"] for p in got[1]["packets"]] == [512, 512, 76] and got[1]["error"] is None
    assert got[2]["packets"] == [] and got[2]["error"] and got[3] is None


def test_query_rows(spark, docs, rows, empty):
    got = {(r.doc_id, r.n_bytes, r.payload_sha256): r for r in M.stored_payloads(docs).select("doc_id", "stored.*").collect()}
    for i, t, *_ in rows:
        p = M.padded(t)
        r = got[(i, len((t or "").encode()), hashlib.sha256(p).hexdigest())]
        assert len(p) % 64 == 0 and len(p) >= 64 and r.payload_bytes == len(p) and r.tail_crc32 == zlib.crc32(p[-64:])
        assert r.media_sha256 == hashlib.sha256(M.store(p)).hexdigest()
    assert M.stored_payloads(empty).collect() == []


def test_file_written_by_hand():
    """Bytes set down from the specification, not by the library's writer; the tracks stand behind the cluster."""
    media = bytes.fromhex(
        "1a45dfa3 8b 4282 88 6d6174726f736b61"  # DocType matroska
        "18538067 01ffffffffffffff"  # a segment of unknown size
        "1549a966 87 2ad7b1 83 0f4240"  # a million nanoseconds a tick
        "1f43b675 b9 e7 82 03e8"  # a cluster at tick 1000
        "a3 86 81 0005 80 6869"  # track 1: hi
        "a3 8a 81 0007 82 01 03 78797a 77"  # Xiph: xyz, w
        "a3 8b 81 0009 84 02 3131 3232 3333"  # fixed size: 11, 22, 33
        "a0 92 a1 8d 82 fffe 06 02 82 c0 6162 636465 66 9b 81 1e"  # track 2, EBML: ab, cde, f, in 30 ticks together
        "1654ae6b 9f ae 95 d7 81 01 83 81 02 86 85 565f524157 23e383 84 02625a00 ae 86 d7 81 02 83 81 11"
        "1c53bb6b 8e bb 8c b3 82 03e8 b7 86 f7 81 01 f1 81 0c"
    )
    read = M.parse(media)
    assert [(p[0], p[1] // 10**6, media[p[2] : p[2] + p[3]], p[6]) for p in read["packets"]] == [
        (1, 1005, b"hi", 0), (1, 1007, b"xyz", 1), (1, 1047, b"w", 1), (1, 1009, b"11", 2), (1, 1049, b"22", 2), (1, 1089, b"33", 2),
        (2, 998, b"ab", 3), (2, 1008, b"cde", 3), (2, 1018, b"f", 3),
    ]
    assert read["tracks"] == [{"track": 1, "kind": 2, "codec": "V_RAW", "frame_ns": 40_000_000, "encoding": ""}, {"track": 2, "kind": 17, "codec": "", "frame_ns": 0, "encoding": ""}]
    assert all(p[4] for p in read["packets"])
    ((time, track, at),) = read["cues"]
    assert (time, track, media[at : at + 4].hex()) == (10**9, 1, "1f43b675")


def test_op5_against_plain_bytes(spark, docs, rows, tmp_path):
    from fieldloom.llm.queries import op5_matroska

    long = "longer than a cluster " * 50_000
    docs.union(spark.createDataFrame([(900, long, "en", "s", 0)], docs.schema)).withColumn("stored", F.lit(1)).write.parquet(f"{tmp_path}/documents.parquet")
    got, want = [], []
    for r in op5_matroska(spark, str(tmp_path)).collect():
        got.append((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32))
        assert r.media_bytes > r.payload_bytes and len(r.media_sha256) == 64 and r.feature
    for i, t in [(r[0], r[1]) for r in rows] + [(900, long)]:
        data = (t or "").encode()
        payload = data + bytes((64 - len(data) % 64) % 64 if data else 64)
        want.append((i, len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:])))
    assert sorted(got, key=str) == sorted(want, key=str)


def live(clusters: int) -> bytes:
    """A recording whose segment and clusters have no sizes."""
    unknown = b"\x01" + b"\xff" * 7
    block = M._element(M.SIMPLE_BLOCK, b"\x81\0\0\x80x")
    body = b"".join(b"\x1f\x43\xb6\x75" + unknown + M._number(M.CLUSTER_TIME, i) + block for i in range(clusters))
    return M._HEAD + b"\x18\x53\x80\x67" + unknown + M._INFO + M._TRACKS + body


def test_live_recordings_take_linear_time():
    import time

    took = []
    for n in (10_000, 100_000):
        data, began = live(n), time.process_time()
        got = M.parse(data)
        took.append(time.process_time() - began)
        assert got["clusters"] == len(got["packets"]) == n and got["packets"][-1][1] == (n - 1) * 1_000_000
    assert took[1] < 30 * took[0] + 1


def test_cue_points_with_several_tracks_and_encodings():
    place = lambda track, at: M._element(M.CUE_PLACE, M._number(M.CUE_TRACK, track), M._number(M.CUE_CLUSTER, at))
    stripped = M._element(M.ENCODINGS, M._element(M.ENCODING, M._element(M.COMPRESSION, M._number(M.ALGORITHM, 3), M._element(M.SETTINGS, b"\x00\x01"))))
    tracks = M._element(M.TRACKS, M._element(M.TRACK, M._number(M.TRACK_NUMBER, 1), stripped), M._element(M.TRACK, M._number(M.TRACK_NUMBER, 2)))
    head = M._HEAD + b"\x18\x53\x80\x67" + M._size(len(tracks) + len(cues := M._element(M.CUES, M._element(M.CUE, M._number(M.CUE_TIME, 7), place(1, 5), place(2, 9)))))
    got = M.parse(head + tracks + cues)
    assert got["cues"] == [(7_000_000, 1, len(head) + 5), (7_000_000, 2, len(head) + 9)]
    assert [t["encoding"] for t in got["tracks"]] == ["header 0001", ""]


def test_damaged_files_give_errors_and_no_exception(spark):
    import random

    rng = random.Random(8)
    samples = [M.store(M.padded("some words " * 300)), live(20), M.store(b"\0" * 64), M._HEAD + M._element(M.SEGMENT, M._element(M.CLUSTER, M._element(M.CLUSTER_TIME, b"\xff" * 8)))]
    files, failed = [], 0
    for _ in range(10_000):
        data = bytearray(rng.choice(samples))
        for _ in range(rng.choice((1, 1, 2, 8))):
            at = rng.randrange(len(data))
            what = rng.random()
            if what < 0.6:
                data[at] = rng.choice((0, 1, 0x7F, 0x80, 0xFF, rng.randrange(256)))
            elif what < 0.8:
                del data[at : at + rng.randrange(1, 9)]
            else:
                data[at:at] = rng.randbytes(rng.randrange(1, 9))
        files.append(bytes(data))
        try:
            M.parse(files[-1])
        except ValueError:
            failed += 1
    files += [rng.randbytes(rng.randrange(200)) for _ in range(200)] + [b"", samples[3]]
    made = M.packet_tables(spark.createDataFrame([(f,) for f in files], "content binary"), "content")
    assert made.where("media.error IS NOT NULL").count() >= failed + 2 > 1000
