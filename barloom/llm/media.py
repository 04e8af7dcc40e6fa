"""Media columns as MPEG transport streams.

``to_transport_stream`` packs a payload into 188-byte packets: a program association table, a
program map table and one private elementary stream whose access units carry presentation
timestamps, a clock reference and, at every ``RANDOM_ACCESS``-th unit, the random-access
flag. ``read_transport_stream`` parses the program tables (checking their CRCs, over several
packets if they are long), follows the continuity counter of every packet identifier,
reassembles the elementary packets and returns the payload with an index of timestamps and
random-access points. Units of several streams follow one another as they begin.

A packet is taken for one if others go on behind it at packet distance, of streams known by then or
``STEPS`` of any: the sync byte alone also occurs in payloads.

Defined cases: a null payload column stays null and a null or empty text is one unit of
blanks; bytes that are not a whole packet in step with others are skipped and counted, up to the
next place from which packets go on; a gap in a continuity counter is counted and the unit that it breaks is
kept up to the gap and no further (announced discontinuities are no gaps); a packet with the transport
error flag is counted and dropped; a packet sent twice is
counted and read once; streams without program tables give an empty payload. Packets are
read one after another, so memory is a small multiple of one value.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.llm.util import fields

PACKET, SYNC = 188, 0x47
#: Packets in a row that reading begins with, and begins anew with after damage.
STEPS = 4
UNIT = 192
#: Payload bytes of an access unit, 90 kHz ticks from one unit to the next, units between random-access points.
ACCESS_UNIT, TICKS, RANDOM_ACCESS = 16 * UNIT, 3600, 8
#: Streams that a worker makes before it hands them on.
ROWS_AT_ONCE = 500
PAT_PID, PMT_PID, ES_PID = 0x0000, 0x1000, 0x0100
PROGRAM, STREAM_TYPE, STREAM_ID = 1, 0x06, 0xBD


@lru_cache(maxsize=64)
def section_crc(data: bytes) -> int:
    """The CRC-32 of program tables (polynomial 0x04C11DB7, high bit first, starting from ones)."""
    crc = 0xFFFFFFFF
    for byte in data:
        crc ^= byte << 24
        for _ in range(8):
            crc = (crc << 1 ^ 0x04C11DB7 if crc & 0x80000000 else crc << 1) & 0xFFFFFFFF
    return crc


def _section(table_id: int, key: int, body: bytes) -> bytes:
    head = struct.pack(">BHHBBB", table_id, 0xB000 | len(body) + 9, key, 0xC1, 0, 0) + body
    return b"\0" + head + struct.pack(">I", section_crc(head))


_PAT = _section(0, 1, struct.pack(">HH", PROGRAM, 0xE000 | PMT_PID))
_PMT = _section(2, PROGRAM, struct.pack(">HHBHH", 0xE000 | ES_PID, 0xF000, STREAM_TYPE, 0xE000 | ES_PID, 0xF000))


def _packet(pid: int, counter: int, start: bool, adaptation: bytes, data: bytes) -> bytes:
    """One packet; a short one is filled up through its adaptation field."""
    room = PACKET - 4 - len(data)
    if room:
        fields = adaptation or (b"\0" if room > 1 else b"")
        adaptation_field = bytes([room - 1]) + fields + b"\xff" * (room - 1 - len(fields))
    else:
        adaptation_field = b""
    flags = (0x30 if room else 0x10) | counter & 15
    return struct.pack(">BHB", SYNC, (0x4000 if start else 0) | pid, flags) + adaptation_field + data


def _pts(ticks: int) -> bytes:
    high, mid, low = ticks >> 30 & 7, ticks >> 15 & 0x7FFF, ticks & 0x7FFF
    return struct.pack(">BHH", 0x21 | high << 1, mid << 1 | 1, low << 1 | 1)


def mux(payload: bytes) -> bytes:
    """The transport stream of one payload; the same payload always gives the same bytes."""
    out, counter, tables = [], 0, 0
    for unit, at in enumerate(range(0, max(len(payload), 1), ACCESS_UNIT)):
        random_access = unit % RANDOM_ACCESS == 0
        if random_access:
            out += [_packet(pid, tables, True, b"", table + b"\xff" * (PACKET - 4 - len(table))) for pid, table in ((PAT_PID, _PAT), (PMT_PID, _PMT))]
            tables += 1
        data, ticks = payload[at : at + ACCESS_UNIT], unit * TICKS & (1 << 33) - 1
        pes = b"\0\0\1" + struct.pack(">BHBBB", STREAM_ID, len(data) + 8, 0x84, 0x80, 5) + _pts(ticks) + data
        clock = struct.pack(">BIH", 0x10 | (0x40 if random_access else 0), ticks >> 1, (ticks & 1) << 15 | 0x7E00)
        first = PACKET - 4 - 1 - len(clock)
        out.append(_packet(ES_PID, counter, True, clock, pes[:first]))
        counter += 1
        for place in range(first, len(pes), PACKET - 4):
            out.append(_packet(ES_PID, counter, False, b"", pes[place : place + PACKET - 4]))
            counter += 1
    return b"".join(out)


def _sections(begun: bytes, data: bytes, start: bool) -> tuple[list[bytes], bytes]:
    """The program tables that a packet completes, and the beginning of one that goes on in the next packet."""
    done = []
    if start:
        pointer = data[0] if data else 0
        if begun:
            done, _ = _sections(begun, data[1 : 1 + pointer], False)
        begun = data[1 + pointer :]
    elif begun:
        begun += data
    while len(begun) >= 3 and begun[0] != 0xFF:
        size = 3 + (int.from_bytes(begun[1:3], "big") & 0x0FFF)
        if len(begun) < size:
            return done, begun
        done.append(begun[:size])
        begun = begun[size:]
    return done, b"" if begun[:1] == b"\xff" else begun


def _body(section: bytes) -> bytes | None:
    """What a program table holds, or None if it is broken."""
    if len(section) < 12 or section_crc(section[:-4]) != int.from_bytes(section[-4:], "big"):
        return None
    return section[8:-4]


def _listed_streams(body: bytes) -> dict[int, int]:
    """Stream types by packet identifier, from a program map table."""
    found, place = {}, 4 + (int.from_bytes(body[2:4], "big") & 0x0FFF)
    while place + 5 <= len(body):
        kind, stream, info = struct.unpack_from(">BHH", body, place)
        found[stream & 0x1FFF] = kind
        place += 5 + (info & 0x0FFF)
    return found


def _unit(pes: bytes) -> tuple[int | None, bytes] | None:
    """(timestamp, data) of a packet of an elementary stream; None if it is no such packet."""
    if pes[:3] != b"\0\0\1" or len(pes) < 9:
        return None
    size, pts = int.from_bytes(pes[4:6], "big"), None
    if pes[7] & 0x80 and len(pes) >= 14:
        high, mid, low = struct.unpack_from(">BHH", pes, 9)
        pts = (high >> 1 & 7) << 30 | mid >> 1 << 15 | low >> 1
    return pts, pes[9 + pes[8] : 6 + size if size else len(pes)]  # size 0: up to the next unit


def _sound(media: bytes, at: int) -> bool:
    """Whether a whole packet may begin here: the sync byte, and a header that has a payload or an adaptation field."""
    return at + PACKET <= len(media) and media[at] == SYNC and bool(media[at + 3] & 0x30)


def _in_step(media: bytes, at: int) -> bool:
    """Whether packets begin here and at the next places, as far as the stream goes."""
    return _sound(media, at) and all(place + PACKET > len(media) or _sound(media, place) for place in range(at + PACKET, at + STEPS * PACKET, PACKET))


def _resynced(media: bytes, at: int) -> int:
    """The next place behind ``at`` from which packets go on, or the end."""
    at = media.find(SYNC, at + 1)
    while at >= 0 and not _in_step(media, at):
        at = media.find(SYNC, at + 1)
    return at if at >= 0 else len(media)


def demux(media: bytes) -> dict:
    """What ``read_transport_stream`` returns of one stream."""
    programs: dict[int, int] = {}
    streams: dict[int, int] = {}
    last: dict[int, tuple[int, int]] = {}
    begun: dict[int, bytes] = {}
    open_units: dict[int, list[bytes]] = {}
    order: list[tuple[bool, list[bytes]]] = []
    packets = skipped = gaps = repeated = errors = bad_tables = at = 0

    def follows(place: int) -> bool:
        """Whether a packet of a known stream, or a row of packets, begins here (or the stream has ended)."""
        if place + PACKET > len(media):
            return True
        pid = (media[place + 1] & 0x1F) << 8 | media[place + 2]
        return _sound(media, place) and (pid in last or pid in streams or pid in programs or _in_step(media, place))

    in_step = False
    while at < len(media):
        # a packet that bytes are missing from or were put into isn't followed by another; one before a single damaged packet is whole
        in_step = _sound(media, at) and (follows(at + PACKET) or _in_step(media, at + 2 * PACKET)) if in_step else _in_step(media, at)
        if not in_step:
            follow = _resynced(media, at)
            skipped, at = skipped + follow - at, follow
            continue
        flags, counter = media[at + 3], media[at + 3] & 15
        pid, start = (media[at + 1] & 0x1F) << 8 | media[at + 2], bool(media[at + 1] & 0x40)
        if media[at + 1] & 0x80:
            errors, at = errors + 1, at + PACKET
            continue
        body, field = at + 4, 0
        if flags & 0x20:
            field = media[at + 5] if media[at + 4] else 0
            body += 1 + media[at + 4]
        here, packets, at = at, packets + 1, at + PACKET
        if not flags & 0x10:
            continue
        if pid in last:
            before, place = last[pid]
            if before == counter and media[place : place + PACKET] == media[here:at]:
                repeated += 1  # a packet may be sent twice
                continue
            if before + 1 & 15 != counter and not field & 0x80:
                gaps += 1
                begun.pop(pid, None)
                open_units.pop(pid, None)
        last[pid] = counter, here
        data = media[body:at]
        if pid == PAT_PID or pid in programs:
            done, begun[pid] = _sections(begun.get(pid, b""), data, start)
            for table in map(_body, done):
                if table is None:
                    bad_tables += 1
                elif pid == PAT_PID:
                    programs |= {p & 0x1FFF: n for n, p in struct.iter_unpack(">HH", table[: len(table) // 4 * 4]) if n}
                else:
                    streams |= _listed_streams(table)
        elif pid in streams:
            if start:
                open_units[pid] = [data]
                order.append((bool(field & 0x40), open_units[pid]))
            elif pid in open_units:
                open_units[pid].append(data)
    payload, index, offset = [], [], 0
    for random_access, parts in order:
        unit = _unit(b"".join(parts))
        if unit is not None:
            index.append((offset, unit[0], random_access))
            payload.append(unit[1])
            offset += len(unit[1])
    return {
        "payload": b"".join(payload), "packets": packets, "programs": len(programs), "streams": len(streams),
        "skipped_bytes": skipped, "continuity_errors": gaps, "repeated_packets": repeated, "transport_errors": errors, "bad_tables": bad_tables, "units": index,
    }


STREAM = fields(
    payload="binary", packets="long", programs="int", streams="int", skipped_bytes="long", continuity_errors="long",
    repeated_packets="long", transport_errors="long", bad_tables="long", units=T.ArrayType(fields(offset="long", pts="long", random_access="boolean")),
)


@F.pandas_udf(T.BinaryType())
def to_transport_stream(payloads: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """The transport stream of each binary payload (null: null)."""
    for batch in payloads:
        yield batch.map(lambda payload: None if payload is None else mux(payload))


@F.pandas_udf(STREAM)
def read_transport_stream(media: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    """The parsed stream of each binary value; all fields are null for a null value."""
    for batch in media:
        yield pd.DataFrame([demux(value) if value is not None else dict.fromkeys(STREAM.names) for value in batch], columns=STREAM.names)


def _padded(text: str | None) -> tuple[int, bytes]:
    data = (text or "").encode("utf-8", "surrogatepass")
    return len(data), data.ljust(max(UNIT, -(-len(data) // UNIT) * UNIT))


@F.pandas_udf(fields(n_bytes="long", media="binary"))
def text_media(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    """Each whole text as media: its UTF-8 bytes, blank-filled to a positive multiple of UNIT, as a stream."""
    for batch in texts:
        for at in range(0, len(batch), ROWS_AT_ONCE):
            made = [(n, mux(payload)) for n, payload in map(_padded, batch.iloc[at : at + ROWS_AT_ONCE])]
            yield pd.DataFrame(made, columns=["n_bytes", "media"])


DIGEST = fields(
    payload_bytes="long", payload_sha256="string", tail_crc32="long", media_bytes="long", media_sha256="string",
    feature="string", continuity_errors="long",
)


def _digest(media: bytes) -> tuple:
    found = demux(media)
    payload, units = found["payload"], found["units"]
    points = [offset for offset, _, random_access in units if random_access]
    feature = (
        f"programs={found['programs']};streams={found['streams']};packets={found['packets']};units={len(units)};"
        f"pts={units[0][1]}..{units[-1][1]};random_access={','.join(map(str, points))};skipped={found['skipped_bytes']};gaps={found['continuity_errors']}"
        if units else "no units"
    )
    return (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature, found["continuity_errors"])


@F.pandas_udf(DIGEST)
def media_digest(media: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    """Digests and the feature of stored streams, from the payload that is read back out of them."""
    for batch in media:
        yield pd.DataFrame([_digest(value) for value in batch], columns=DIGEST.names)


def document_media(docs: DataFrame, doc_id: str = "doc_id", text: str | Column = "text") -> DataFrame:
    """(doc_id, n_bytes, media) of every row of ``docs``."""
    made = text_media(F.col(text) if isinstance(text, str) else text)
    return docs.select(F.col(doc_id).alias("doc_id"), made.alias("made")).select("doc_id", "made.n_bytes", "made.media")


def media_features(media: DataFrame) -> DataFrame:
    """``media`` without the stored bytes, with their digests and features."""
    return media.select("doc_id", "n_bytes", media_digest("media").alias("found")).select("doc_id", "n_bytes", "found.*")
