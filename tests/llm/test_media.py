import hashlib
import random
import zlib

import pytest

from barloom.llm import media
from barloom.llm.queries import op1_transport_stream


@pytest.mark.parametrize("size", [0, 1, 160, 183, 184, 185, 3072, 3073, 30_000])
def test_a_payload_comes_back(size):
    payload = bytes(i * 7 % 251 for i in range(size))
    found = media.demux(media.mux(payload))
    assert found["payload"] == payload
    assert (found["programs"], found["streams"], found["continuity_errors"], found["skipped_bytes"], found["bad_tables"]) == (1, 1, 0, 0, 0)


def test_packets_tables_and_units():
    stream = media.mux(b"x" * media.ACCESS_UNIT * 17)
    assert len(stream) % media.PACKET == 0 and all(stream[at] == media.SYNC for at in range(0, len(stream), media.PACKET))
    units = media.demux(stream)["units"]
    assert [pts for _, pts, _ in units] == [k * media.TICKS for k in range(17)]
    assert [k for k, (_, _, point) in enumerate(units) if point] == [0, 8, 16]
    assert media.section_crc(b"123456789") == 0x0376E6E7  # the published check value of this CRC


def test_broken_streams_are_counted():
    stream = bytearray(media.mux(b"y" * 5000))
    lost = bytes(stream[: 4 * media.PACKET] + stream[5 * media.PACKET :])
    assert media.demux(lost)["continuity_errors"] == 1
    assert media.demux(b"noise" + bytes(stream))["skipped_bytes"] == 5
    assert media.demux(bytes(stream))["payload"] == b"y" * 5000
    assert media.demux(bytes(stream[:-10]))["skipped_bytes"] > 0
    stream[20] ^= 1  # within the first program table
    assert media.demux(bytes(stream))["bad_tables"] == 1
    assert media.demux(b"")["payload"] == b""


PAYLOADS = {
    "G": b"G" * 40_000, "text": b"Good Grief, a GIANT GnU Goes Grazing. " * 1000,
    "mixed": bytes(random.Random(3).choice(b"G\x00\x10\x37ab\xff") for _ in range(40_000)), "plain": b"no such letter here " * 2000,
}


def unit_of(place: int, stream: bytes) -> int:
    """The number of the unit that a byte of a stream belongs to."""
    heads = range(0, place // media.PACKET * media.PACKET + 1, media.PACKET)
    return sum(stream[at + 1] & 0x40 != 0 and (stream[at + 1] & 0x1F) << 8 | stream[at + 2] == media.ES_PID for at in heads if stream[at + 1] & 0x40) - 1


@pytest.mark.parametrize("name", PAYLOADS)
def test_lost_and_added_bytes_hurt_their_units_only(name):
    """Bytes that get lost or come in between cost at most the units that they lie in, whatever the payload holds."""
    payload, pick = PAYLOADS[name], random.Random(1)
    stream = media.mux(payload)
    pieces = [payload[at : at + media.ACCESS_UNIT] for at in range(0, len(payload), media.ACCESS_UNIT)]
    for _ in range(60):
        place, n = pick.randrange(5 * media.PACKET, len(stream) - 300), pick.choice([1, 3, 10, 100, 188, 189, 200])
        for broken in (stream[:place] + stream[place + n :], stream[:place] + bytes(pick.choice(b"G\x40\x10x") for _ in range(n)) + stream[place:]):
            found = media.demux(broken)
            hurt = {k for k in range(len(pieces)) if any(unit_of(p, stream) == k for p in (place, min(place + n, len(stream) - 1), max(0, place - media.PACKET)))}
            back = [found["payload"][a:b] for a, b in zip([u[0] for u in found["units"]], [u[0] for u in found["units"][1:]] + [len(found["payload"])], strict=True)]
            by_time = {pts // media.TICKS: piece for (_, pts, _), piece in zip(found["units"], back, strict=True) if pts is not None}
            lost = [k for k, piece in enumerate(pieces) if by_time.get(k) != piece]
            assert len(lost) <= 2 and all(min(abs(k - h) for h in hurt) <= 1 for k in lost), (place, n, lost, hurt)
            # where whole packets' lengths go or come, the packets stay in step and what is mixed up can't be told
            assert n == media.PACKET or all(pieces[k].startswith(by_time[k][: max(0, len(by_time[k]) - media.PACKET)]) for k in lost if k in by_time)


def test_false_sync_bytes_in_front_and_damaged_ones():
    stream = media.mux(b"Going " * 3000)
    for junk in (b"G", b"GG", b"GGG", b"G\x40\x00\x10" * 3, b"x" * 500 + b"G"):
        found = media.demux(junk + stream)
        assert (found["payload"], found["skipped_bytes"], found["programs"]) == (b"Going " * 3000, len(junk), 1)
    hurt = bytearray(stream)
    hurt[10 * media.PACKET] = 0
    found = media.demux(bytes(hurt))
    assert found["continuity_errors"] == 1 and found["skipped_bytes"] == media.PACKET and len(found["payload"]) >= 6 * 3000 - media.ACCESS_UNIT


def test_a_unit_ends_at_its_gap_and_flagged_packets_are_dropped():
    payload = bytes(range(256)) * 60
    stream = media.mux(payload)
    hurt = bytearray(stream)
    hurt[5 * media.PACKET + 1] |= 0x80  # in the middle of the first unit
    found = media.demux(bytes(hurt))
    assert (found["transport_errors"], found["continuity_errors"]) == (1, 1)
    first = found["units"][1][0]
    assert payload.startswith(found["payload"][:first]) and first < media.ACCESS_UNIT and found["payload"][first:] == payload[media.ACCESS_UNIT :]


def test_repeated_packets_and_announced_gaps():
    stream = media.mux(b"z" * 5000)
    at = 3 * media.PACKET
    twice = stream[: at + media.PACKET] + stream[at:]
    found = media.demux(twice)
    assert (found["repeated_packets"], found["continuity_errors"], found["payload"]) == (1, 0, b"z" * 5000)
    announced = media._packet(media.ES_PID, 9, False, b"\x80", b"more")
    assert media.demux(stream[:at] + announced)["continuity_errors"] == 0


def test_long_tables_and_open_ended_units():
    many = b"".join(media.struct.pack(">BHH", 6, 0xE000 | 0x200 + k, 0xF000) for k in range(60))
    table = media._section(2, media.PROGRAM, media.struct.pack(">HH", 0xE100, 0xF000) + many)
    first, rest = table[: media.PACKET - 4], table[media.PACKET - 4 :]
    pes = b"\0\0\1" + bytes([media.STREAM_ID, 0, 0, 0x84, 0x80, 5]) + media._pts(77) + b"open"
    stream = b"".join([
        media._packet(media.PAT_PID, 0, True, b"", media._PAT), media._packet(media.PMT_PID, 0, True, b"", first), media._packet(media.PMT_PID, 1, False, b"", rest),
        media._packet(0x205, 0, True, b"\x40", pes),
    ])
    found = media.demux(stream)
    assert (found["streams"], found["bad_tables"], found["payload"], found["units"]) == (60, 0, b"open", [(0, 77, True)])


def sliced(stream: bytes) -> tuple[bytes, int, list[int]]:
    """(payload, units, the offsets of random access) of a whole stream, by cutting it at its headers alone."""
    units, points = [], []
    for at in range(0, len(stream), 188):
        packet = stream[at : at + 188]
        assert packet[0] == 0x47
        body = packet[4:]
        if packet[3] & 0x20:
            flags, body = body[1 : 1 + body[0]], body[1 + body[0] :]
        else:
            flags = b""
        if (packet[1] & 0x1F) << 8 | packet[2] != media.ES_PID:
            continue
        if packet[1] & 0x40:
            if flags and flags[0] & 0x40:
                points.append(len(units))
            units.append(b"")
        units[-1] += body
    payloads = [unit[9 + unit[8] :] for unit in units]
    return b"".join(payloads), len(units), [sum(map(len, payloads[:k])) for k in points]


def test_query_against_plain_python(spark, sf_dir):
    texts = {row["doc_id"]: row["text"] for row in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = op1_transport_stream(spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for row in rows:
        data = (texts[row["doc_id"]] or "").encode()
        padded = data + b" " * (max(192, -(-len(data) // 192) * 192) - len(data))
        assert (row["n_bytes"], row["payload_bytes"]) == (len(data), len(padded))
        assert row["payload_sha256"] == hashlib.sha256(padded).hexdigest() and row["tail_crc32"] == zlib.crc32(padded[-16:])
        stream = media.mux(padded)
        assert (row["media_bytes"], row["media_sha256"]) == (len(stream), hashlib.sha256(stream).hexdigest())
        payload, units, points = sliced(stream)
        assert payload == padded
        assert row["feature"] == (
            f"programs=1;streams=1;packets={len(stream) // 188};units={units};pts=0..{(units - 1) * media.TICKS};random_access={','.join(map(str, points))};skipped=0;gaps=0"
        )


def test_odd_documents(odd_documents, no_documents):
    rows = media.media_features(media.document_media(odd_documents)).collect()
    assert len(rows) == odd_documents.count() and all(row["payload_bytes"] % 192 == 0 and row["payload_bytes"] > 0 for row in rows)
    assert {row["n_bytes"] for row in rows if row["doc_id"] in (2, 3, 7)} == {0}
    assert media.media_features(media.document_media(no_documents)).collect() == []


def test_null_media(spark):
    df = spark.createDataFrame([(None,), (b"",)], "media binary")
    rows = df.select(media.read_transport_stream("media").alias("m")).select("m.*").collect()
    assert rows[0]["payload"] is None and bytes(rows[1]["payload"]) == b""
    assert df.select(media.to_transport_stream("media").alias("m")).where("m is null").count() == 1
