"""Tracks as drives see them: MFM sectors, extended track images, flux captures.

Bits are numpy arrays, so decoding and encoding a track take a few array operations; only the flux loop goes step by
step, as each step moves the estimate for the next one.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Sync words, bytes of a sector, of its encoded body and of the gap before it, sectors a track, tracks a disk.
SYNC = b"\x44\x89"
SECTOR, BODY, GAP, PER_TRACK, TRACKS = 512, 1080, 32, 11, 160
#: Where the body's fields begin, in encoded bytes: label, header's checksum, data's checksum, data.
LABEL, HEAD_SUM, DATA_SUM, BODY_DATA = 8, 40, 48, 56
EXTENDED, MOST_TRACKS = b"UAE-1ADF", 1024


@dataclass
class Sector:
    bit: int
    format: int
    track: int
    number: int
    to_gap: int
    label: bytes
    header_ok: bool
    data_ok: bool
    violations: int
    data: bytes

    @property
    def sound(self) -> bool:
        return self.header_ok and self.data_ok


@dataclass
class Decoded:
    sectors: list[Sector]
    stray_syncs: int
    violations: int | None

    def standard(self) -> bool:
        """Exactly eleven sound sectors, numbered 0 to 10."""
        return len(self.sectors) == PER_TRACK and all(s.sound for s in self.sectors) and {s.number for s in self.sectors} == set(range(PER_TRACK))


def clock_violations(bits: np.ndarray) -> int:
    """Clock bits that aren't the complement of (data bit before or data bit)."""
    n = len(bits) // 2 * 2
    clock, data = bits[:n:2], bits[1:n:2]
    return int((clock[1:] != ((data[:-1] | data[1:]) ^ 1)).sum())


#: The sync words at each bit of a byte: the three bytes that they fill whole, and all five with the bits that are theirs.
_SYNCS = [(((mark := int.from_bytes(SYNC + SYNC, "big") << 8 - s).to_bytes(5, "big"))[1 if s else 0 : 4], mark, 0xFFFFFFFF << 8 - s) for s in range(8)]


def syncs(track: bytes) -> list[int]:
    """The bits at which two sync words begin."""
    out = []
    for s, (whole, mark, mask) in enumerate(_SYNCS):
        at = track.find(whole)
        while at >= 0:
            first = at - (1 if s else 0)
            if first >= 0 and int.from_bytes(track[first : first + 5].ljust(5, b"\0"), "big") & mask == mark and 8 * first + s + 32 <= 8 * len(track):
                out.append(8 * first + s)
            at = track.find(whole, at + 1)
    return sorted(out)


def cut(track: bytes, bit: int, n: int) -> bytes:
    """n bytes from a bit on; fewer where the track ends."""
    at, s = divmod(bit, 8)
    if not s:
        return track[at : at + n]
    x = np.frombuffer(track, np.uint8, max(0, min(n + 1, len(track) - at)), at)
    return (x[:-1] << s | x[1:] >> 8 - s).astype(np.uint8).tobytes()


def sector_bodies(track: bytes) -> tuple[list[tuple[int, int, bytes]], int, int | None]:
    """(first bit, body's bit, encoded body) of a track's sectors, found at sync words at any bit; the stray syncs, those whose format isn't
    the system's or that are cut; and the first sync's bit."""
    starts, out, stray, free = syncs(track), [], 0, 0
    for start in starts:
        if start < free:
            continue
        body = start + 32
        while cut(track, body, 2) == SYNC:
            body += 16
        m = cut(track, body, BODY)
        if len(m) < BODY or (m[0] & 0x55) << 1 | m[4] & 0x55 != 0xFF:
            stray += 1
        else:
            out.append((start, body, m))
            free = body + BODY * 8
    return out, stray, starts[0] if starts else None


def decode_track(track: bytes) -> Decoded:
    """Sectors found at sync words at any bit; one whose format isn't the system's, or that is cut, is a stray sync."""
    found, stray, first = sector_bodies(track)
    sectors = decode_sectors([(start, m) for start, _, m in found])
    bits = np.unpackbits(np.frombuffer(track, np.uint8)) if first is not None else None
    for s, (_, body, _) in zip(sectors, found, strict=True):
        s.violations = sum(clock_violations(bits[body + 8 * a : body + 8 * b]) for a, b in ((0, HEAD_SUM), (BODY_DATA, BODY)))
    return Decoded(sectors, stray, clock_violations(bits[first:]) if first is not None else None)


def decode_sectors(found: list[tuple[int, bytes]]) -> list[Sector]:
    """Sectors of (first bit, encoded body), of any number of tracks at once; violations aren't counted here."""
    m = np.frombuffer(b"".join(body for _, body in found), np.uint8).reshape(-1, BODY)
    both = lambda at, n: (m[:, at : at + n] & 0x55) << 1 | m[:, at + n : at + 2 * n] & 0x55
    info, labels, data = both(0, 4).tolist(), both(LABEL, 16), both(BODY_DATA, SECTOR)
    stored = [np.ascontiguousarray(both(at, 4)).view(">u4")[:, 0] for at in (HEAD_SUM, DATA_SUM)]
    own = [track_sums(m[:, :HEAD_SUM]), track_sums(m[:, BODY_DATA:])]
    head, good = (stored[0] == own[0]).tolist(), (stored[1] == own[1]).tolist()
    return [Sector(start, *info[i], labels[i].tobytes(), head[i], good[i], 0, data[i].tobytes()) for i, (start, _) in enumerate(found)]


def track_sums(encoded: np.ndarray) -> np.ndarray:
    """The checksum of each row: its longs, exclusive or, without clock bits."""
    return np.bitwise_xor.reduce(np.ascontiguousarray(encoded).view(">u4"), axis=1).astype(np.uint32) & 0x55555555


def halves(data: np.ndarray) -> np.ndarray:
    """Rows of bytes as their odd bits, then their even bits."""
    return np.concatenate([(data >> 1) & 0x55, data & 0x55], axis=1)


def encode_sectors(heads: np.ndarray, data: np.ndarray) -> np.ndarray:
    """Rows of sectors as drives write them. heads: format, track, number, sectors to the gap; data: 512 bytes."""
    n = len(heads)
    head = np.concatenate([halves(heads), np.zeros((n, 32), np.uint8)], axis=1)
    payload = halves(data)
    sums = [halves(track_sums(x).astype(">u4").view(np.uint8).reshape(n, 4)) for x in (head, payload)]
    own = np.concatenate([head, *sums, payload], axis=1)
    before = np.concatenate([np.ones((n, 1), np.uint8), own[:, :-1] & 1], axis=1)  # the sync word ends in a 1
    clock = ~(own << 1 | own >> 1 | before << 7) & 0xAA
    lead = np.broadcast_to(np.frombuffer(b"\xaa" * 4 + SYNC + SYNC, np.uint8), (n, 8))
    return np.concatenate([lead, own | clock], axis=1)


def encode_sector(track: int, number: int, to_gap: int, data: bytes) -> bytes:
    if len(data) != SECTOR:
        raise ValueError("a sector has 512 bytes")
    return encode_sectors(np.array([[0xFF, track, number, to_gap]], np.uint8), np.frombuffer(data, np.uint8)[None]).tobytes()


def encode_track(track: int, sectors: list[bytes]) -> bytes:
    if any(len(s) != SECTOR for s in sectors):
        raise ValueError("a sector has 512 bytes")
    return encode_tracks([track], len(sectors), b"".join(sectors))[0]


def encode_tracks(numbers: list[int], each: int, data: bytes) -> list[bytes]:
    """Tracks of so many sectors each, all at once."""
    gap = np.full((len(numbers), GAP), 0xAA, np.uint8)
    heads = np.array([[0xFF, t, i, each - i] for t in numbers for i in range(each)], np.uint8).reshape(-1, 4)
    made = encode_sectors(heads, np.frombuffer(data, np.uint8).reshape(-1, SECTOR))
    sectors = np.concatenate([np.full((len(made), GAP), 0xAA, np.uint8), made], axis=1).reshape(len(numbers), -1)
    return [row.tobytes() for row in np.concatenate([sectors, gap], axis=1)]


@dataclass
class Track:
    index: int
    kind: str  # sector, raw, or unknown-N
    space: int
    bits: int
    at: int
    inside: bool


def extended_tracks(data: bytes) -> tuple[list[Track], list[str]]:
    """The tracks of an extended image, and what is wrong with the table. Raises ValueError where there is no whole table."""
    if data[:8] != EXTENDED:
        raise ValueError("not an extended image")
    if len(data) < 12 or (n := int.from_bytes(data[10:12], "big")) * 12 + 12 > len(data):
        raise ValueError("truncated")
    if n > MOST_TRACKS:
        raise ValueError(f"{n} tracks")
    table = np.frombuffer(data, ">u4", 3 * n, 12).reshape(n, 3).astype(np.int64)
    starts = 12 + 12 * n + np.concatenate([[0], np.cumsum(table[:, 1])])
    out, faults = [], []
    for i, (kind, space, bits) in enumerate(table.tolist()):
        kind &= 0xFFFF
        end = int(starts[i + 1])
        if kind > 1:
            faults.append(f"track {i}: unknown track type {kind}")
        if end > len(data) and space:
            faults.append(f"track {i}: the file ends before its data, {end - len(data)} bytes short")
        if -(-bits // 8) > space:
            faults.append(f"track {i}: claims {bits} bits but only {space} bytes are allocated")
        out.append(Track(i, ("sector", "raw")[kind] if kind < 2 else f"unknown-{kind}", space, bits, int(starts[i]), end <= len(data)))
    if starts[-1] < len(data):
        faults.append(f"{len(data) - int(starts[-1])} trailing bytes past the last track")
    return out, faults


def extended_image(tracks: list[tuple[bool, bytes]]) -> bytes:
    """An extended image of (raw, bytes) tracks."""
    if len(tracks) > MOST_TRACKS:
        raise ValueError("too many tracks")
    rows = [np.array([raw, len(x), 8 * len(x)], ">u4").tobytes() for raw, x in tracks]
    return EXTENDED + len(tracks).to_bytes(4, "big") + b"".join(rows) + b"".join(x for _, x in tracks)


@dataclass
class Assembly:
    """A disk put together from tracks: where each track's sectors came from."""

    data: bytes
    placed: int
    total: int
    tracks: list[tuple[int, int, str]]  # track, sectors placed, sector, raw, flux or empty

    @property
    def percent(self) -> int:
        return self.placed * 100 // self.total if self.total else 0


def assemble(data: bytes) -> Assembly:
    """An extended image as plain sectors. Of a raw track's sectors with one number the last sound one stays; missing ones are zeros."""
    tracks, _ = extended_tracks(data)
    out, placed, rows, found = bytearray(TRACKS * PER_TRACK * SECTOR), 0, [], {}
    for t in tracks[:TRACKS]:
        if t.kind == "raw" and t.inside:
            found[t.index] = [(start, m) for start, _, m in sector_bodies(data[t.at : t.at + t.space])[0]]
    decoded = iter(decode_sectors([x for part in found.values() for x in part]))
    by_track = {t: [next(decoded) for _ in part] for t, part in found.items()}
    for t in tracks[:TRACKS]:
        base, own = t.index * PER_TRACK, 0
        if t.kind == "sector":
            body = data[t.at : t.at + t.space] if t.inside else b""
            own = min(len(body) // SECTOR, PER_TRACK)
            out[base * SECTOR : (base + own) * SECTOR] = body[: own * SECTOR]
        elif t.kind == "raw":
            own = _place(out, base, [s for s in by_track.get(t.index, ()) if s.sound and s.track == t.index], False)
        placed += own
        rows.append((t.index, own, t.kind if t.space else "empty"))
    return Assembly(bytes(out), placed, TRACKS * PER_TRACK, rows)


def _place(out: bytearray, base: int, sectors: list[Sector], first_stays: bool, had: set[int] | None = None) -> int:
    had, n = set() if had is None else had, 0
    for s in sectors:
        if s.number < PER_TRACK and not (first_stays and s.number in had):
            at = (base + s.number) * SECTOR
            out[at : at + SECTOR] = s.data
            had.add(s.number)
            n += 1
    return n


# Flux captures

#: Slots of tracks, revolutions at most, ticks of a bit cell (25 ns at 250 kbit/s), ticks that a zero stands for, limits of a good lock in per cent.
SLOTS, REVOLUTIONS, CELL, CARRY, DRIFT, STRAYS = 168, 5, 80, 65536, 20, 5


def flux_table(data: bytes) -> dict:
    """A capture's header, and each track's revolutions as (ticks, count, at)."""
    if len(data) < 16 or data[:3] != b"SCP":
        raise ValueError("not a flux capture")
    if data[5] > REVOLUTIONS:
        raise ValueError(f"{data[5]} revolutions")
    little = lambda at: int.from_bytes(data[at : at + 4], "little") if at + 4 <= len(data) else None
    table, tracks = 0x80 if data[8] & 0x40 else 0x10, {}
    for slot in range(SLOTS):
        head = little(table + 4 * slot)
        if head is None:
            break
        if head and data[head : head + 3] == b"TRK":
            rows = []
            for rev in range(max(1, data[5])):
                ticks, count, offset = (little(head + 4 + 12 * rev + k) for k in (0, 4, 8))
                if offset is None:
                    break
                if count or offset:
                    rows.append((ticks, count, head + offset))
            tracks[slot] = rows
    return {"version": data[3], "disk_type": data[4], "revolutions": data[5], "first": data[6], "last": data[7], "flags": data[8], "cell_width": data[9], "heads": data[10], "resolution": data[11], "checksum": little(12), "tracks": tracks}


def intervals(data: bytes, at: int, count: int) -> np.ndarray | None:
    """Ticks between transitions: a zero carries 65,536 ticks on to the next number."""
    if at + 2 * count > len(data):
        return None
    x = np.frombuffer(data, ">u2", count, at).astype(np.int64)
    ends = np.flatnonzero(x)
    return x[ends] + CARRY * (np.diff(np.concatenate([[-1], ends])) - 1)


def flux_bits(ticks, nominal: int = CELL) -> dict:
    """MFM bits of the intervals by a loop that follows the cell's width by a sixteenth of each error, in 64ths of a tick."""
    cell64, gaps, stray = 64 * (nominal or CELL), [], 0
    for x in (int(t) for t in ticks):
        cell = max(1, cell64 // 64)
        n = (x + cell // 2) // cell
        if 2 <= n <= 4:
            gaps.append(n)
            implied = 64 * x // n
            step = abs(implied - cell64) // 16
            cell64 += step if implied > cell64 else -step
        else:
            stray += 1
            if n > 4:
                gaps.append(min(n, 64))
    bits = np.zeros(sum(gaps), np.uint8)
    if gaps:
        bits[np.cumsum([0, *gaps[:-1]])] = 1
    n, final = len(ticks), cell64 // 64
    locked = abs(final - CELL) * 100 <= CELL * DRIFT and stray * 100 // max(1, n) <= STRAYS
    return {"bits": np.packbits(bits).tobytes(), "out_of_range": stray, "intervals": n, "cell": final, "locked": locked}


def assemble_flux(data: bytes) -> Assembly:
    """A capture as plain sectors: of the sound copies of a sector the first revolution's stays."""
    out, placed, rows = bytearray(TRACKS * PER_TRACK * SECTOR), 0, []
    for slot, revolutions in flux_table(data)["tracks"].items():
        had: set[int] = set()
        if slot >= TRACKS:
            continue
        for _, count, at in revolutions:
            ticks = intervals(data, at, count)
            if ticks is not None and len(had) < PER_TRACK:
                _place(out, slot * PER_TRACK, [s for s in decode_track(flux_bits(ticks)["bits"]).sectors if s.sound and s.track == slot], True, had)
        placed += len(had)
        rows.append((slot, len(had), "flux"))
    return Assembly(bytes(out), placed, TRACKS * PER_TRACK, rows)
