"""MPEG transport streams as a column: bytes to packets of 188 and back.

``mux`` wraps a payload into a programme: a PAT, a PMT, and one private elementary stream whose access units are PES
packets with a presentation time; each starts at a random-access point. ``demux`` reads such bytes again: it
follows the PAT to the PMT, takes the programme's stream, checks sync bytes and continuity counters, puts the PES
packets together and lists their timestamps. Both work on whole packet arrays in numpy, a document at a time.
"""

from __future__ import annotations

import functools
import hashlib
import zlib
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values of the format (ISO/IEC 13818-1).
PACKET, SYNC, PAT_PID, NULL_PID = 188, 0x47, 0x0000, 0x1FFF
PRIVATE_STREAM, STREAM_ID = 0x06, 0xBD
CRC_POLYNOMIAL = 0x04C11DB7
CLOCK = 90_000

PMT_PID, DATA_PID, PROGRAM = 0x0100, 0x0101, 1
#: Bytes of an access unit, and ticks of the 90 kHz clock between two.
UNIT, UNIT_TICKS = 16_384, 3_600


@functools.lru_cache(maxsize=64)
def section_crc(data: bytes) -> int:
    crc = 0xFFFFFFFF
    for byte in data:
        crc ^= byte << 24
        for _ in range(8):
            crc = ((crc << 1) ^ CRC_POLYNOMIAL if crc & 0x80000000 else crc << 1) & 0xFFFFFFFF
    return crc


def _section(table_id: int, number: int, body: bytes) -> bytes:
    n = len(body) + 9
    head = bytes([table_id, 0xB0 | n >> 8, n & 255]) + number.to_bytes(2, "big") + b"\xc1\x00\x00" + body
    return head + section_crc(head).to_bytes(4, "big")


def _table_packet(pid: int, section: bytes) -> bytes:
    return (bytes([SYNC, 0x40 | pid >> 8, pid & 255, 0x10, 0]) + section).ljust(PACKET, b"\xff")


@functools.lru_cache(maxsize=1)
def program_tables() -> bytes:
    pat = _section(0x00, 1, PROGRAM.to_bytes(2, "big") + (0xE000 | PMT_PID).to_bytes(2, "big"))
    pmt = _section(0x02, PROGRAM, (0xE000 | DATA_PID).to_bytes(2, "big") + b"\xf0\x00" + bytes([PRIVATE_STREAM]) + (0xE000 | DATA_PID).to_bytes(2, "big") + b"\xf0\x00")
    return _table_packet(PAT_PID, pat) + _table_packet(PMT_PID, pmt)


def _pes_header(n: int, pts: int) -> bytes:
    stamp = bytes([0x21 | pts >> 29 & 0x0E, pts >> 22 & 255, pts >> 14 & 254 | 1, pts >> 7 & 255, pts << 1 & 254 | 1])
    return b"\x00\x00\x01" + bytes([STREAM_ID]) + (n + 8).to_bytes(2, "big") + b"\x84\x80\x05" + stamp


def _adaptation(pcr: int) -> bytes:
    """Length, flags (random access, clock reference) and the reference."""
    return bytes([7, 0x50, pcr >> 25 & 255, pcr >> 17 & 255, pcr >> 9 & 255, pcr >> 1 & 255, (pcr & 1) << 7 | 0x7E, 0])


def mux(payload: bytes, unit: int = UNIT) -> bytes:
    """The transport stream of a payload."""
    out, counter = [program_tables()], 0
    for k in range(-(-len(payload) // unit)):
        pts = k * UNIT_TICKS & (1 << 33) - 1
        pes = payload[k * unit : (k + 1) * unit]
        pes = _pes_header(len(pes), pts) + pes
        first, rest = pes[:176], len(pes) - 176
        n = 1 + max(0, -(-rest // 184))
        packets = np.empty((n, PACKET), np.uint8)
        packets[:, 0], packets[:, 1], packets[:, 2] = SYNC, DATA_PID >> 8, DATA_PID & 255
        packets[:, 3] = 0x10 | (counter + np.arange(n)) & 15
        counter += n
        packets[0, 1] |= 0x40
        packets[0, 3] |= 0x20
        head = bytearray(_adaptation(pts))
        spare = 176 - len(first)
        head[0] += spare
        packets[0, 4:] = np.frombuffer(bytes(head) + b"\xff" * spare + first, np.uint8)
        if n > 1:
            body = np.frombuffer(pes, np.uint8, rest, 176)
            full = rest // 184
            packets[1 : 1 + full, 4:] = body[: full * 184].reshape(full, 184)
            if rest % 184:  # the last packet is filled up by stuffing
                spare = 184 - rest % 184
                stuffing = bytes([spare - 1]) + (b"\x00" + b"\xff" * (spare - 2) if spare > 1 else b"")
                packets[-1, 3] |= 0x20
                packets[-1, 4:] = np.frombuffer(stuffing + body[full * 184 :].tobytes(), np.uint8)
        out.append(packets.tobytes())
    return b"".join(out)


@dataclass
class Stream:
    """What a transport stream holds: the elementary bytes and, per access unit, timestamp, place and random access."""

    payload: bytes = b""
    packets: int = 0
    sync_errors: int = 0
    table_errors: int = 0
    counter_errors: int = 0
    pes_errors: int = 0
    stream_type: int = -1
    pts: list[int] = field(default_factory=list)
    offset: list[int] = field(default_factory=list)
    random_access: list[bool] = field(default_factory=list)


def _read_section(packets: np.ndarray, pid: np.ndarray, want: int, table_id: int, found: Stream) -> bytes | None:
    rows = np.flatnonzero((pid == want) & (packets[:, 1] & 0x40 > 0))
    if not len(rows):
        found.table_errors += 1
        return None
    raw = packets[rows[0]].tobytes()
    at = 4 + (1 + raw[4] if raw[3] & 0x20 else 0)
    at += 1 + raw[at] if at < PACKET else 0
    n = (raw[at + 1] & 15) << 8 | raw[at + 2] if at + 3 <= PACKET else 0
    section = raw[at : at + 3 + n]
    if n < 9 or len(section) != n + 3 or section[0] != table_id or section_crc(section[:-4]) != int.from_bytes(section[-4:], "big"):
        found.table_errors += 1
        return None
    return section


def demux(data: bytes) -> Stream:
    """Read a transport stream; faults are counted, and bytes that cannot be placed are left out."""
    found = Stream()
    packets = np.frombuffer(data, np.uint8, len(data) // PACKET * PACKET).reshape(-1, PACKET)
    found.packets, good = len(packets), packets[:, 0] == SYNC
    found.sync_errors = int((~good).sum()) + (len(data) % PACKET > 0)
    packets = packets[good & (packets[:, 1] & 0x80 == 0)]
    pid = (packets[:, 1].astype(np.int32) & 31) << 8 | packets[:, 2]
    pat = _read_section(packets, pid, PAT_PID, 0x00, found)
    if pat is None:
        return found
    programs = [(int.from_bytes(pat[i : i + 2], "big"), int.from_bytes(pat[i + 2 : i + 4], "big") & NULL_PID) for i in range(8, len(pat) - 4, 4)]
    pmt = next((s for number, p in programs if number and (s := _read_section(packets, pid, p, 0x02, found)) is not None), None)
    if pmt is None:
        return found
    at = 12 + ((pmt[10] & 15) << 8 | pmt[11])
    if at + 5 > len(pmt) - 4:
        found.table_errors += 1
        return found
    found.stream_type = pmt[at]
    own = packets[pid == (int.from_bytes(pmt[at + 1 : at + 3], "big") & NULL_PID)]
    own = own[own[:, 3] & 0x10 > 0]
    if not len(own):
        return found
    counter, adapted = own[:, 3] & 15, own[:, 3] & 0x20 > 0
    begin = np.where(adapted, 5 + own[:, 4].astype(np.int32), 4)
    flags = np.where(adapted & (own[:, 4] > 0), own[:, 5], 0)
    found.counter_errors = int((((counter[1:] - counter[:-1]) & 15 != 1) & (flags[1:] & 0x80 == 0)).sum())
    whole = begin <= PACKET
    lengths = np.where(whole, PACKET - begin, 0)
    body = own[(np.arange(PACKET)[None, :] >= begin[:, None]) & whole[:, None]].tobytes()
    ends = np.cumsum(lengths)
    starts = np.flatnonzero(own[:, 1] & 0x40 > 0)
    parts, place = [], 0
    for i, row in enumerate(starts):
        lo, hi = int(ends[row] - lengths[row]), int(ends[starts[i + 1] - 1]) if i + 1 < len(starts) else len(body)
        if hi - lo < 9 or body[lo : lo + 3] != b"\x00\x00\x01":
            found.pes_errors += 1
            continue
        size, head = int.from_bytes(body[lo + 4 : lo + 6], "big"), 9 + body[lo + 8]
        stop = min(hi, lo + 6 + size) if size else hi
        found.pes_errors += stop - lo < 6 + size
        b = body[lo + 9 : lo + 14]
        has = body[lo + 7] & 0x80 and len(b) == 5
        found.pts.append((b[0] >> 1 & 7) << 30 | b[1] << 22 | b[2] >> 1 << 15 | b[3] << 7 | b[4] >> 1 if has else -1)
        found.offset.append(place)
        found.random_access.append(bool(flags[row] & 0x40))
        parts.append(body[lo + head : stop])
        place += len(parts[-1])
    found.payload = b"".join(parts)
    return found


def padded(text: str | None, block: int = 64) -> bytes:
    """UTF-8 bytes of a text (null: none) with bytes 0 up to a positive multiple of block."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + bytes(-len(raw) % block or (block if not raw else 0))


@F.pandas_udf(T.BinaryType())
def text_to_ts(text: pd.Series) -> pd.Series:
    return pd.Series([mux(padded(x)) for x in text], dtype=object)


_FIELDS = {
    **{x: T.LongType() for x in ("payload_bytes", "tail_crc32", "media_bytes", "packets", "sync_errors", "table_errors", "counter_errors", "pes_errors")},
    **{x: T.StringType() for x in ("payload_sha256", "media_sha256")},
    **{x: T.ArrayType(T.LongType()) for x in ("pts", "byte_offset")},
    "random_access": T.ArrayType(T.BooleanType()),
}
INFO = T.StructType([T.StructField(k, v) for k, v in _FIELDS.items()])


@F.pandas_udf(INFO)
def read_ts(media: pd.Series) -> pd.DataFrame:
    rows = []
    for data in media:
        data = bytes(data) if data is not None else b""
        s = demux(data)
        rows.append({
            "payload_bytes": len(s.payload), "payload_sha256": hashlib.sha256(s.payload).hexdigest(), "tail_crc32": zlib.crc32(s.payload[-64:]),
            "media_bytes": len(data), "media_sha256": hashlib.sha256(data).hexdigest(), "packets": s.packets, "sync_errors": s.sync_errors,
            "table_errors": s.table_errors, "counter_errors": s.counter_errors, "pes_errors": s.pes_errors,
            "pts": s.pts, "byte_offset": s.offset, "random_access": s.random_access,
        })
    return pd.DataFrame(rows, columns=list(_FIELDS))


def with_media(df: DataFrame, text_col: str = "text", media_col: str = "media") -> DataFrame:
    """Add the transport stream of each row's text (null: empty) as a binary column."""
    return df.withColumn(media_col, text_to_ts(F.col(text_col).cast("string")))


def media_info(media: Column) -> Column:
    """What a transport stream column holds, read back from its bytes. A null or broken stream gives empty lists and counted faults."""
    return read_ts(media)


def feature_string(info: str = "info") -> Column:
    """Timing and random access in one line: access units, random-access points, last timestamp, faults."""
    c = F.col
    return F.concat_ws(
        ";",
        F.concat(F.lit("units="), F.size(c(f"{info}.pts"))),
        F.concat(F.lit("rap="), F.size(F.filter(c(f"{info}.random_access"), lambda x: x))),
        F.concat(F.lit("pts="), F.coalesce(F.array_min(c(f"{info}.pts")), F.lit(-1)), F.lit("-"), F.coalesce(F.array_max(c(f"{info}.pts")), F.lit(-1))),
        F.concat(F.lit("packets="), c(f"{info}.packets")),
        F.concat(F.lit("faults="), c(f"{info}.sync_errors") + c(f"{info}.table_errors") + c(f"{info}.counter_errors") + c(f"{info}.pes_errors")),
    )
