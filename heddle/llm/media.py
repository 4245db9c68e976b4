"""Media columns: MPEG transport streams in binary columns.

`mux` writes a payload of 8-bit samples as a single-program transport stream; `demux` parses any
stream's program tables, checks the continuity counter of each PID, puts elementary packets together
again and lists each unit's timestamps with the random-access points.

Defined results: a null payload is an empty one; an empty payload makes a stream with its program
tables and no units; bytes outside packets (before the first sync byte, after the last whole packet, a
packet whose sync byte is damaged) count in `errors` and are passed over, and reading goes on at the next sync
byte that another follows; a packet that repeats the one before it, which the standard allows, counts once (in
`repeats`); tables may span packets; a unit that has lost packets is kept and counted in `gaps`.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from heddle.llm.support import OUT_ROWS, load, map_rows

PACKET = 188
SYNC = 0x47
ES_PID = 0x101
PMT_PID = 0x100
#: Private data in PES packets.
STREAM_TYPE = 0x06
STREAM_ID = 0xBD
UNIT_BYTES = 4096
#: Ticks of the 90 kHz clock from unit to unit, at 25 units a second.
TICKS = 3600
#: Every so many units the tables are sent again and a decoder can start.
RANDOM_ACCESS_EVERY = 8


@lru_cache(maxsize=4096)
def crc32_mpeg(data: bytes) -> int:
    """CRC-32/MPEG-2, of program tables only (a few dozen bytes)."""
    crc = 0xFFFFFFFF
    for byte in data:
        crc ^= byte << 24
        for _ in range(8):
            crc = (crc << 1) ^ (0x104C11DB7 if crc & 0x80000000 else 0)
    return crc


def _section(table: int, ident: int, body: bytes) -> bytes:
    head = bytes([table]) + (0xB000 | (len(body) + 9)).to_bytes(2, "big") + ident.to_bytes(2, "big") + b"\xc1\x00\x00"
    return head + body + crc32_mpeg(head + body).to_bytes(4, "big")


@lru_cache(maxsize=1)
def _tables() -> tuple[bytes, bytes]:
    pat = _section(0, 1, (1).to_bytes(2, "big") + (0xE000 | PMT_PID).to_bytes(2, "big"))
    pmt = _section(2, 1, (0xE000 | ES_PID).to_bytes(2, "big") + b"\xf0\x00" + bytes([STREAM_TYPE]) + (0xE000 | ES_PID).to_bytes(2, "big") + b"\xf0\x00")
    return tuple((b"\x00" + s).ljust(PACKET - 4, b"\xff") for s in (pat, pmt))


def _head(pid: int, start: bool, control: int, cc: int) -> bytes:
    return bytes([SYNC, (0x40 if start else 0) | pid >> 8, pid & 255, control << 4 | cc & 15])


def _stamp(ticks: int) -> bytes:
    t = ticks & (1 << 33) - 1
    return bytes([0x21 | t >> 29 & 0x0E, t >> 22 & 255, 1 | t >> 14 & 0xFE, t >> 7 & 255, 1 | t << 1 & 0xFE])


def _clock(ticks: int) -> bytes:
    return ((ticks & (1 << 33) - 1) << 15 | 0x7E00).to_bytes(6, "big")


def mux(payload: bytes | None, unit_bytes: int = UNIT_BYTES) -> bytes:
    """The payload as a transport stream, a PES packet for every unit_bytes (at most 65,527)."""
    payload, out, cc = payload or b"", [], count()
    pat, pmt = _tables()
    for n, at in enumerate(range(0, max(1, len(payload)), unit_bytes)):
        access, ticks = n % RANDOM_ACCESS_EVERY == 0, n * TICKS
        if access:
            k = n // RANDOM_ACCESS_EVERY
            out += [_head(0, True, 1, k), pat, _head(PMT_PID, True, 1, k), pmt]
        if not (data := payload[at : at + unit_bytes]):
            break
        pes = b"\x00\x00\x01" + bytes([STREAM_ID]) + (len(data) + 8).to_bytes(2, "big") + b"\x80\x80\x05" + _stamp(ticks) + data
        field = b"\x50" + _clock(ticks) if access else b""  # random access and the programme's clock
        i, first = 0, True
        while i < len(pes):
            room = PACKET - 4 - (len(field) + 1 if field else 0)
            part = pes[i : i + room]
            if lack := room - len(part):  # an adaptation field fills the last packet
                if not field:
                    lack, field = lack - 1, b"\x00" if lack > 1 else b""
                    lack -= len(field)
                    filled = bytes([len(field) + lack]) + field + b"\xff" * lack
                else:
                    filled = bytes([len(field) + lack]) + field + b"\xff" * lack
            else:
                filled = bytes([len(field)]) + field if field else b""
            out += [_head(ES_PID, first, 3 if filled else 1, next(cc)), filled, part]
            i, first, field = i + len(part), False, b""
    return b"".join(out)


def _aligned(stream: bytes) -> np.ndarray:
    """The packets of a stream, a row each, from sync byte to sync byte."""
    n = len(stream) // PACKET
    a = np.frombuffer(stream, np.uint8)
    whole = a[: n * PACKET].reshape(n, PACKET)
    if (whole[:, 0] == SYNC).all():
        return whole
    ends = len(a) - PACKET  # the last place that a packet can begin
    sync = np.concatenate((a == SYNC, np.ones(2 * PACKET, bool)))[: len(a) + 2 * PACKET]  # past the end all goes
    firm = np.flatnonzero(sync[: ends + 1] & sync[PACKET : PACKET + ends + 1]) if ends >= 0 else np.zeros(0, np.int64)
    starts, at = [], 0
    while at <= ends:
        k = np.searchsorted(firm, at + 1)
        following = int(firm[k]) if k < len(firm) else ends + 1
        # the last packet before noise: no other begins in it
        if sync[at] and (sync[at + PACKET] or sync[at + 2 * PACKET] or following >= min(at + PACKET, ends + 1)):
            starts.append(at)
        elif not (at + PACKET <= ends and sync[at + PACKET] and sync[at + 2 * PACKET]):
            at = following
            continue
        at += PACKET
    return a[np.array(starts, np.int64)[:, None] + np.arange(PACKET)]


def _sections(a: np.ndarray, at: np.ndarray, start: np.ndarray, cc: np.ndarray, rows: np.ndarray) -> Iterator[bytes]:
    """Table sections in the packets given, over packets where they are long; those whose CRC holds."""

    def whole(held: bytes) -> Iterator[bytes]:
        while len(held) >= 3 and held[0] != 0xFF and len(held) >= (n := 3 + (int.from_bytes(held[1:3], "big") & 0xFFF)):
            if n >= 12 and crc32_mpeg(held[:n]) == 0:
                yield held[:n]
            held = held[n:]

    held, last = b"", -1
    for r in rows.tolist():
        p = a[r, at[r] :].tobytes()
        if last >= 0 and (int(cc[r]) - int(cc[last])) % 16 != 1:
            held = b""  # a packet of the section is lost
        last = r
        if start[r] and p:
            yield from whole(held + p[1 : 1 + p[0]] if held else b"")
            held = p[1 + p[0] :]
        elif held:
            held += p
    yield from whole(held)


def _read_stamp(b: bytes) -> int:
    return (b[0] >> 1 & 7) << 30 | b[1] << 22 | b[2] >> 1 << 15 | b[3] << 7 | b[4] >> 1


def _repeats(a: np.ndarray, at: np.ndarray, pid: np.ndarray, cc: np.ndarray, has_data: np.ndarray) -> np.ndarray:
    """Packets with the counter and the data of the one before them in their PID."""
    out = np.zeros(len(a), bool)
    rows = np.flatnonzero(has_data & (pid != 0x1FFF))
    rows = rows[np.argsort(pid[rows], kind="stable")]
    same = np.flatnonzero((pid[rows[1:]] == pid[rows[:-1]]) & (cc[rows[1:]] == cc[rows[:-1]]))
    for i, j in zip(rows[same].tolist(), rows[same + 1].tolist(), strict=True):
        out[j] = at[i] == at[j] and bool((a[i, at[i] :] == a[j, at[j] :]).all())
    return out


def demux(stream: bytes | None) -> dict:
    """programs: (number, PMT PID); streams: (PID, type); units: (PID, pts, dts, random access, offset in that PID's bytes, size); data: by PID; gaps: breaks of a continuity counter; repeats: packets sent twice; errors: bytes passed over."""
    stream = stream or b""
    a = _aligned(stream)
    a = a[a[:, 1] & 0x80 == 0]
    errors = len(stream) - len(a) * PACKET
    pid = (a[:, 1].astype(np.int32) & 0x1F) << 8 | a[:, 2]
    start, control, cc = a[:, 1] & 0x40 > 0, a[:, 3] >> 4 & 3, a[:, 3] & 15
    has_field, has_data = control & 2 > 0, control & 1 > 0
    at = np.where(has_field, 5 + a[:, 4].astype(np.int32), 4)
    again = _repeats(a, at, pid, cc, has_data)
    repeats, once = int(again.sum()), ~again
    if repeats:
        a, pid, start, control, cc, has_field, has_data, at = (v[once] for v in (a, pid, start, control, cc, has_field, has_data, at))
    flags = np.where(has_field & (a[:, 4] > 0), a[:, 5], 0)
    programs, streams = [], []
    for s in dict.fromkeys(_sections(a, at, start, cc, np.flatnonzero((pid == 0) & has_data))):
        programs += [(int.from_bytes(s[i : i + 2], "big"), int.from_bytes(s[i + 2 : i + 4], "big") & 0x1FFF) for i in range(8, len(s) - 7, 4)]
    programs = sorted({p for p in programs if p[0]})
    for _, where in programs:
        for s in dict.fromkeys(_sections(a, at, start, cc, np.flatnonzero((pid == where) & has_data))):
            i = 12 + (int.from_bytes(s[10:12], "big") & 0xFFF)
            while i + 9 <= len(s):
                streams.append((int.from_bytes(s[i + 1 : i + 3], "big") & 0x1FFF, s[i]))
                i += 5 + (int.from_bytes(s[i + 3 : i + 5], "big") & 0xFFF)
    streams, gaps = sorted(set(streams)), 0
    for p in np.unique(pid):
        mine = np.flatnonzero((pid == p) & has_data) if p != 0x1FFF else []
        if len(mine) > 1:
            step = (cc[mine[1:]].astype(np.int16) - cc[mine[:-1]]) % 16
            gaps += int(((step != 1) & (flags[mine[1:]] & 0x80 == 0)).sum())
    units, data = [], {}
    for p, _ in streams:
        mine = np.flatnonzero((pid == p) & has_data & (at < PACKET))
        sizes = PACKET - at[mine]
        whole = a[mine][np.arange(PACKET) >= at[mine][:, None]].tobytes()
        ends, begins = np.cumsum(sizes), np.flatnonzero(start[mine])
        offs = [*(ends[begins] - sizes[begins]).tolist(), len(whole)]
        parts, size = [], 0
        for k, row in enumerate(begins.tolist()):
            pes = whole[offs[k] : offs[k + 1]]
            if len(pes) < 9 or pes[:3] != b"\x00\x00\x01":
                errors += len(pes)
                continue
            stated = int.from_bytes(pes[4:6], "big")
            body = pes[9 + pes[8] : 6 + stated if stated else len(pes)]
            pts = _read_stamp(pes[9:14]) if pes[7] & 0x80 else None
            dts = _read_stamp(pes[14:19]) if pes[7] & 0xC0 == 0xC0 else pts
            units.append((p, pts, dts, bool(flags[mine[row]] & 0x40), size, len(body)))
            parts.append(body)
            size += len(body)
        data[p] = b"".join(parts)
    return {"programs": programs, "streams": streams, "units": units, "data": data, "gaps": gaps, "repeats": repeats, "errors": errors}


_UNIT = pa.list_(pa.struct([("pid", pa.int32()), ("pts", pa.int64()), ("dts", pa.int64()), ("random_access", pa.bool_()), ("start", pa.int64()), ("size", pa.int64())]))
_NAMES = [f.name for f in _UNIT.value_type]


def _units(d: dict) -> list[dict]:
    return [dict(zip(_NAMES, u, strict=True)) for u in d["units"]]


def write_streams(df: DataFrame, payload: str, media: str = "media") -> DataFrame:
    """All other columns of df, and in place of `payload` (binary or string) the column `media`: transport streams."""
    rest = [c for c in df.columns if c != payload]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, OUT_ROWS):
                part = b.slice(i, OUT_ROWS)
                made = pa.array([mux(p.as_py()) for p in part.column(len(rest))], pa.binary())
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], made], names=[*rest, media])

    rows = df.select(*rest, F.col(payload).cast("binary").alias(payload))
    return rows.mapInArrow(run, T.StructType([*rows.schema.fields[:-1], T.StructField(media, T.BinaryType())]))


_KINDS = {"pid": T.IntegerType(), "random_access": T.BooleanType()}
UNITS = T.ArrayType(T.StructType([T.StructField(n, _KINDS.get(n, T.LongType())) for n in _NAMES]))
READ = T.StructType([T.StructField("data", T.BinaryType()), T.StructField("units", UNITS), *(T.StructField(n, T.LongType()) for n in ("gaps", "repeats", "errors"))])


def read_streams(df: DataFrame, media: str = "media") -> DataFrame:
    """All columns of df; `data` of the stream's first elementary stream, `units` of all (timestamps and random-access points), `gaps`, `repeats` and `errors`."""
    names, at = [*df.columns, *READ.names], df.columns.index(media)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, OUT_ROWS):
                part = b.slice(i, OUT_ROWS)
                found = [demux(m.as_py()) for m in part.column(at)]
                data = pa.array([next(iter(d["data"].values()), b"") for d in found], pa.binary())
                counts = [pa.array([d[k] for d in found], pa.int64()) for k in ("gaps", "repeats", "errors")]
                yield pa.RecordBatch.from_arrays([*part.columns, data, pa.array([_units(d) for d in found], _UNIT), *counts], names=names)

    return df.mapInArrow(run, T.StructType([*df.schema.fields, *READ.fields]))


def features(stamps: list[int], access: int, gaps: int, errors: int, data: bytes) -> str:
    """A short description of a stream that was read: its timing, its access points and its samples' histogram."""
    hist = np.bincount(np.frombuffer(data, np.uint8) >> 4, minlength=16)
    seconds = (stamps[-1] - stamps[0] + TICKS) / 90_000 if stamps else 0.0
    return f"units={len(stamps)};access={access};seconds={seconds:.2f};gaps={gaps};errors={errors};levels=" + ",".join(map(str, hist.tolist()))


_ROW = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()), ("units", pa.int64()), ("access_points", pa.int64())])
ROW = "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string, units bigint, access_points bigint"


def _described(doc_id, n, media, data, stamps, access, gaps, errors):
    sha = lambda b: hashlib.sha256(b).hexdigest()
    return doc_id, n, len(data), sha(data), zlib.crc32(data[-64:]), len(media), sha(media), features(stamps, access, gaps, errors, data), len(stamps), access


def op9_transport_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text as a transport stream in a column, read back (null: empty); narrow maps without a shuffle."""
    text = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    n = F.octet_length(text)
    padding = F.when(n == 0, 64).otherwise(F.pmod(-n, F.lit(64)))
    docs = load(spark, sf_dir, "documents").select(F.col("doc_id").cast("long"), n.cast("long").alias("n"), F.concat(text, F.substring(F.lit(bytes(64)), F.lit(1), padding)).alias("payload"))
    read = read_streams(write_streams(docs, "payload"))
    access = F.size(F.filter("units", lambda u: u["random_access"])).cast("long")
    return map_rows(read.select("doc_id", "n", "media", "data", "units.pts", access.alias("access"), "gaps", "errors"), _described, _ROW, ROW)


QUERIES = {"op9_transport_streams": op9_transport_streams}
ORACLES: dict[str, str] = {}
