"""MPEG transport streams as media columns: write a payload as a stream, and read streams back.

``mux`` stores bytes losslessly as a single-program transport stream: a program association table, a program map
table, and elementary packets (PES) of a private stream with presentation timestamps and random-access points.
``demux`` parses any transport stream from its bytes alone: tables with their checksums, also over several packets
and for several programs, continuity counters, reassembly of the elementary packets, timestamps. What is damaged is
counted and passed over; no bytes make it fail. Both work on whole blocks of 188-byte packets as arrays.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesselwork.llm.batches import slices

# Fixed values of the transport stream format.
PACKET, SYNC, NULL_PID, PAT_PID = 188, 0x47, 0x1FFF, 0
PRIVATE_STREAM, PRIVATE_TYPE, CLOCK = 0xBD, 0x06, 90_000
PLAIN_STREAMS = (0xBC, 0xBE, 0xBF, 0xF0, 0xF1, 0xF2, 0xF8, 0xFF)  # stream ids without timestamps

UNIT = 192  # payloads are padded with spaces to a positive multiple of it
PMT_PID, ES_PID, PROGRAM = 0x1000, 0x0100, 1
UNITS_PER_PES = 64  # 12,288 bytes of payload per elementary packet
RANDOM_ACCESS_EVERY = 4  # elementary packets between random-access points
TICKS_PER_PES = CLOCK // 25


def _crc_table() -> list[int]:
    """CRC-32/MPEG-2, most significant bit first."""
    out = []
    for i in range(256):
        c = i << 24
        for _ in range(8):
            c = ((c << 1) ^ 0x04C11DB7) & 0xFFFFFFFF if c & 0x80000000 else (c << 1) & 0xFFFFFFFF
        out.append(c)
    return out


_CRC = _crc_table()


def mpeg_crc(data: bytes) -> int:
    c = 0xFFFFFFFF
    for b in data:
        c = ((c << 8) & 0xFFFFFFFF) ^ _CRC[(c >> 24) ^ b]
    return c


def _section(table: int, extension: int, body: bytes) -> bytes:
    head = bytes([table, 0xB0 | ((len(body) + 9) >> 8), (len(body) + 9) & 0xFF]) + extension.to_bytes(2, "big") + b"\xc1\x00\x00"
    return head + body + mpeg_crc(head + body).to_bytes(4, "big")


def _table_packet(pid: int, section: bytes) -> bytes:
    return (bytes([SYNC, 0x40 | pid >> 8, pid & 0xFF, 0x10, 0]) + section).ljust(PACKET, b"\xff")


_TABLES = _table_packet(PAT_PID, _section(0, 1, PROGRAM.to_bytes(2, "big") + (0xE000 | PMT_PID).to_bytes(2, "big"))) + _table_packet(
    PMT_PID, _section(2, PROGRAM, (0xE000 | ES_PID).to_bytes(2, "big") + b"\xf0\x00" + bytes([PRIVATE_TYPE]) + (0xE000 | ES_PID).to_bytes(2, "big") + b"\xf0\x00")
)


def _stamp(pts: int) -> bytes:
    return bytes([0x21 | (pts >> 29) & 0x0E, (pts >> 22) & 0xFF, (pts >> 14) & 0xFE | 1, (pts >> 7) & 0xFF, (pts << 1) & 0xFE | 1])


def _pes(payload: bytes, pts: int) -> bytes:
    return b"\x00\x00\x01" + bytes([PRIVATE_STREAM]) + (len(payload) + 8).to_bytes(2, "big") + b"\x84\x80\x05" + _stamp(pts) + payload


def _packets(pes: bytes, counter: int, random_access: bool) -> tuple[np.ndarray, int]:
    """The PES in packets of its own: the first carries the random-access flag, the last is stuffed."""
    lead = b"\x01\x40" if random_access else b""  # adaptation field of one byte of flags
    first = pes[: PACKET - 4 - len(lead)]
    whole, rest = divmod(len(pes) - len(first), PACKET - 4)
    n = 1 + whole + (rest > 0)
    out = np.full((n, PACKET), 0xFF, dtype=np.uint8)
    out[:, 0], out[:, 1], out[:, 2] = SYNC, ES_PID >> 8, ES_PID & 0xFF
    out[0, 1] |= 0x40
    out[:, 3] = 0x10 | (counter + np.arange(n)) & 0x0F
    data = np.frombuffer(pes, dtype=np.uint8)

    def stuffed(row: np.ndarray, body: np.ndarray, flags: int) -> None:
        room = PACKET - 4 - len(body)
        row[3] |= 0x20
        row[4] = room - 1
        if room > 1:
            row[5] = flags
        row[PACKET - len(body) :] = body

    if len(lead) or len(first) < PACKET - 4:
        stuffed(out[0], data[: len(first)], 0x40 if random_access else 0)
    else:
        out[0, 4:] = data[: len(first)]
    if whole:
        out[1 : 1 + whole, 4:] = data[len(first) : len(first) + whole * (PACKET - 4)].reshape(whole, PACKET - 4)
    if rest:
        stuffed(out[n - 1], data[len(pes) - rest :], 0)
    return out, counter + n


def padded(text: str | None) -> bytes:
    """UTF-8 bytes of the text (none for null), then spaces up to a positive multiple of UNIT."""
    raw = (text or "").encode()
    return raw.ljust(max(UNIT, -(-len(raw) // UNIT) * UNIT))


def mux_bytes(payload: bytes) -> bytes:
    parts, counter, step = [_TABLES], 0, UNIT * UNITS_PER_PES
    for k, at in enumerate(range(0, len(payload), step)):
        block, counter = _packets(_pes(payload[at : at + step], k * TICKS_PER_PES), counter, k % RANDOM_ACCESS_EVERY == 0)
        parts.append(block.tobytes())
    return b"".join(parts)


def _payload(row: np.ndarray) -> bytes:
    """What a packet carries after its header and adaptation field; nothing where the field fills it."""
    if not row[3] & 0x10:
        return b""
    return row[5 + int(row[4]) :].tobytes() if row[3] & 0x20 else row[4:].tobytes()


def _sections(p: np.ndarray, pid: int, pids: np.ndarray) -> list[bytes]:
    """Sections of one PID, checked by their CRC. A section may run over several packets, and a packet may hold more."""
    out: list[bytes] = []
    held, counter = None, None  # bytes since the start of a section; None before the first

    def cut(data: bytes) -> bytes | None:
        while len(data) >= 3 and data[0] != 0xFF:
            size = 3 + ((data[1] & 0x0F) << 8 | data[2])
            if len(data) < size:
                return data
            if size >= 12 and mpeg_crc(data[:size]) == 0:
                out.append(data[:size])
            data = data[size:]
        return data if 0 < len(data) < 3 and data[0] != 0xFF else None

    for row in p[pids == pid]:
        body, now = _payload(row), int(row[3]) & 0x0F
        if not body or now == counter:  # a packet may be sent twice
            continue
        if counter is not None and now != (counter + 1) & 0x0F:
            held = None  # a lost packet ends the section that it was part of
        counter = now
        if row[1] & 0x40:
            start = 1 + body[0]
            if held is not None:
                cut(held + body[1:start])
            held = cut(body[start:])
        elif held is not None:
            held = cut(held + body)
    return out


def _programs(p: np.ndarray, pids: np.ndarray) -> list[tuple[int, int, int]]:
    """(program, stream type, PID) of all streams, in the order of the tables."""
    out, seen = [], set()
    for section in _sections(p, PAT_PID, pids):
        for at in range(8, len(section) - 7, 4):
            program, map_pid = int.from_bytes(section[at : at + 2], "big"), int.from_bytes(section[at + 2 : at + 4], "big") & 0x1FFF
            if section[0] != 0 or not program or program in seen:  # program 0 names the network's own table
                continue
            for table in _sections(p, map_pid, pids):
                if table[0] != 2 or int.from_bytes(table[3:5], "big") != program or program in seen:
                    continue
                seen.add(program)
                spot = 12 + (int.from_bytes(table[10:12], "big") & 0x0FFF)
                while spot + 5 <= len(table) - 4:
                    out.append((program, table[spot], int.from_bytes(table[spot + 1 : spot + 3], "big") & 0x1FFF))
                    spot += 5 + (int.from_bytes(table[spot + 3 : spot + 5], "big") & 0x0FFF)
    return out


def _elementary(p: np.ndarray) -> tuple[list[bytes], list[bool], int]:
    """Reassembled elementary packets of one PID, whether each is a random-access point, and counter faults."""
    control, counter = p[:, 3] >> 4 & 3, (p[:, 3] & 0x0F).astype(np.int64)
    has = control & 1 > 0
    field = np.where(control & 2 > 0, 1 + p[:, 4].astype(np.int64), 0)
    random = (control & 2 > 0) & (p[:, 4] > 0) & (p[:, 5] & 0x40 > 0)
    jump = (control & 2 > 0) & (p[:, 4] > 0) & (p[:, 5] & 0x80 > 0)
    expected = (counter[:-1] + has[1:]) & 0x0F
    repeat = (counter[1:] == counter[:-1]) & has[1:] & (p[1:, 4:] == p[:-1, 4:]).all(axis=1)  # a packet may be sent twice
    faults = int(((counter[1:] != expected) & ~repeat & ~jump[1:]).sum())
    use = has.copy()
    use[1:] &= ~repeat
    begins = np.flatnonzero((p[:, 1] & 0x40 > 0) & use)
    mask = (np.arange(PACKET)[None, :] >= (4 + field)[:, None]) & use[:, None]
    data, ends = p[mask].tobytes(), np.concatenate([[0], np.cumsum(mask.sum(axis=1))])
    cuts = [*(int(ends[b]) for b in begins), len(data)]
    return [data[a:b] for a, b in zip(cuts, cuts[1:], strict=False)], random[begins].tolist(), faults


def _unit(unit: bytes) -> tuple[bytes, int | None] | None:
    """Payload and timestamp of an elementary packet; None where its head is damaged or cut."""
    if len(unit) < 9 or unit[:3] != b"\x00\x00\x01":
        return None
    size = int.from_bytes(unit[4:6], "big")
    end = min(len(unit), 6 + size) if size else len(unit)
    if unit[3] in PLAIN_STREAMS:
        return unit[6:end], None
    t, pts = unit[9:14], None
    if unit[7] & 0x80 and unit[8] >= 5 and len(t) == 5:
        pts = (t[0] >> 1 & 7) << 30 | t[1] << 22 | (t[2] >> 1) << 15 | t[3] << 7 | t[4] >> 1
    return unit[9 + unit[8] : end], pts


def demux_bytes(media: bytes) -> dict:
    """All streams of all programs, in the order of the tables: pes (bytes, pts, random access), counter faults, lost
    sync bytes and damaged elementary packets; program, pid and stream_type are those of the first stream."""
    n = len(media) // PACKET
    p = np.frombuffer(media, dtype=np.uint8, count=n * PACKET).reshape(n, PACKET)
    bad_sync = int((p[:, 0] != SYNC).sum()) + (len(media) % PACKET > 0)
    p = p[(p[:, 0] == SYNC) & (p[:, 1] & 0x80 == 0)]
    pids = (p[:, 1].astype(np.int64) & 0x1F) << 8 | p[:, 2]
    out = {"packets": n, "bad_sync": bad_sync, "faults": 0, "damaged": 0, "program": None, "pid": None, "stream_type": None, "pes": [], "streams": []}
    for program, kind, pid in _programs(p, pids):
        if any(pid == known for _, _, known in out["streams"]):
            continue  # programs may share a stream
        if not out["streams"]:
            out["program"], out["stream_type"], out["pid"] = program, kind, pid
        out["streams"].append((program, kind, pid))
        units, random, faults = _elementary(p[pids == pid])
        out["faults"] += faults
        for unit, access in zip(units, random, strict=True):
            got = _unit(unit)
            if got is None:
                out["damaged"] += 1
            else:
                out["pes"].append((*got, access))
    return out


def feature(parsed: dict) -> str:
    """What the stream says of itself, in one line."""
    stamps = [t for _, t, _ in parsed["pes"] if t is not None]
    access = [t for _, t, r in parsed["pes"] if r and t is not None]
    digest = zlib.crc32(",".join(map(str, access)).encode())
    return (
        f"program={parsed['program']};pid={parsed['pid']};type={parsed['stream_type']};packets={parsed['packets']};pes={len(parsed['pes'])};"
        f"pts={min(stamps, default=-1)}..{max(stamps, default=-1)};access={len(access)}:{digest:08x};faults={parsed['faults']};sync={parsed['bad_sync']}"
    )


def mux(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Return doc_id, n_bytes and media, the transport stream of the padded text, for every row.

    Null and empty texts are one unit of spaces. Rows with a null id and repeated rows are kept. An empty table
    gives no rows. Other columns of ``docs`` are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            media = pa.array([mux_bytes(padded(t.as_py())) for t in b.column(1)], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), media], ["doc_id", "n_bytes", "media"])

    text = F.col(text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"))
    return rows.mapInArrow(run, "doc_id long, n_bytes long, media binary")


def demux(media: DataFrame, media_col: str = "media") -> DataFrame:
    """Return the rows with what their streams hold: payload digests, timestamps and random-access points.

    Adds payload_bytes, payload_sha256, tail_crc32 (last 16 payload bytes), media_bytes, media_sha256, pts and
    access (arrays, one entry for each elementary packet), faults and feature; the media column goes. A null
    stream reads as an empty one. Columns of these names in the input are replaced.
    """
    made = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, pts array<long>, access array<boolean>, faults long, feature string"
    names = [x.split()[0] for x in made.split(", ")]
    keep = [c for c in media.columns if c != media_col and c not in names]
    types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.int64(), pa.string()]

    def one(stored: bytes) -> tuple:
        got = demux_bytes(stored)
        payload = b"".join(x for x, _, _ in got["pes"])
        return (
            len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(stored), hashlib.sha256(stored).hexdigest(),
            [t for _, t, _ in got["pes"]], [r for _, _, r in got["pes"]], got["faults"], feature(got),
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            rows = [one(x.as_py() or b"") for x in b.column(len(keep))]
            cols = [pa.array([r[i] for r in rows], t) for i, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(keep))), *cols], [*keep, *names])

    kept = media.select(*keep)
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields] + [made])
    return media.select(*keep, media_col).mapInArrow(run, schema)
