"""What a file's bytes are, and what they say: pictures, sounds, scores, icons, fonts, preferences, catalogues.

decode() gives named fields in groups, and a picture where there is one. A part that is cut or contradicts itself is a field of the
group "fault"; a file of no known kind is a refusal.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from fractions import Fraction

import numpy as np

#: Sides of a picture and of an icon, frames, rows of a module that is played, parts of a quarter note.
SIDE, ICON_SIDE, FRAMES, PLAYED, QUARTER = 4096, 1024, 4096, 131_072, 26_880


@dataclass
class Decoded:
    kind: str
    fields: list[tuple[str, str, str]] = field(default_factory=list)
    picture: tuple[int, int, bytes] | None = None  # width, height, RGB

    def put(self, group: str, name: str, value) -> None:
        self.fields.append((group, name, str(value)))

    def fault(self, text: str) -> None:
        self.fields.append(("fault", "", text))


class Refused(Exception):
    pass


def u16(d: bytes, at: int) -> int:
    return int.from_bytes(d[at : at + 2], "big")


def u32(d: bytes, at: int) -> int:
    return int.from_bytes(d[at : at + 4], "big")


def text(raw: bytes) -> str:
    return raw.split(b"\0", 1)[0].decode("latin-1")


def chunks(d: bytes, at: int = 12, end: int | None = None) -> Iterator[tuple[str, bytes]]:
    """Chunks of a form from `at` on, each padded to an even length; the last one as far as it goes."""
    end = min(len(d), 8 + u32(d, 4) + (u32(d, 4) & 1)) if end is None else end
    while at + 8 <= end:
        n = u32(d, at + 4)
        yield d[at : at + 4].decode("latin-1"), d[at + 8 : min(at + 8 + n, end)]
        at += 8 + n + (n & 1)


def form(d: bytes) -> str | None:
    return d[8:12].decode("latin-1") if d[:4] == b"FORM" and len(d) >= 12 else None


# Pictures


def unrun(src: bytes, size: int) -> bytes:
    """Run-length bytes: n up to 127, n + 1 bytes as they are; from 129, the next byte 257 - n times; 128, nothing."""
    out, i = bytearray(), 0
    while len(out) < size and i < len(src):
        n = src[i]
        if n < 128:
            out += src[i + 1 : i + 2 + n]
            i += 2 + n
        else:
            if n > 128 and i + 1 < len(src):
                out += src[i + 1 : i + 2] * (257 - n)
            i += 2 if n > 128 else 1
    return bytes(out[:size]) + bytes(max(0, size - len(out)))


def run_rows(src: bytes, rows: int, size: int) -> bytes:
    """Rows that are run-length bytes each; runs may go over a row's end, as some writers have them."""
    return unrun(src, rows * size)


@dataclass
class Picture:
    width: int
    height: int
    planes: int
    mode: int
    palette: np.ndarray
    pens: np.ndarray  # rows by columns

    def rgb(self) -> np.ndarray:
        if self.planes == 24:
            return np.stack([self.pens >> 8 * i & 255 for i in range(3)], axis=2).astype(np.uint8)
        table = np.zeros((max(256, len(self.palette)), 3), np.uint8)
        table[: len(self.palette)] = self.palette
        if self.mode & 0x80 and self.planes == 6:  # pens from 32 on are half as bright
            table[32:64] = table[:32] >> 1
        if not (self.mode & 0x800 and self.planes in (6, 8)):
            return table[self.pens]
        low = self.planes - 2
        what, value = self.pens >> low, self.pens & ((1 << low) - 1)
        bright = (value << (8 - low) | value >> max(0, 2 * low - 8)).astype(np.uint8)
        out = np.zeros((*self.pens.shape, 3), np.uint8)
        now = np.broadcast_to(table[0], (len(self.pens), 3)).copy()
        for x in range(self.width):  # every row at once; a row begins with colour 0
            own = what[:, x] == 0
            now[own] = table[value[own, x]]
            for code, channel in ((1, 2), (2, 0), (3, 1)):
                at = what[:, x] == code
                now[at, channel] = bright[at, x]
            out[:, x] = now
        return out


def picture_of(d: bytes, out: Decoded | None = None) -> Picture:
    kind, parts = form(d), {}
    for name, data in chunks(d):
        parts.setdefault(name, data)
    head = parts.get("BMHD", b"")
    if kind not in ("ILBM", "ACBM") or len(head) < 20:
        raise Refused("no picture's header")
    w, h, planes, mask, packed = u16(head, 0), u16(head, 2), head[8], head[9], head[10]
    if not (0 < w <= SIDE and 0 < h <= SIDE and (1 <= planes <= 8 or planes == 24)):
        raise Refused(f"a picture of {w} by {h} in {planes} planes")
    row, each = (w + 15) // 16 * 2, planes + (mask == 1)
    mode, raw = u32(parts.get("CAMG", bytes(4)), 0), parts.get("CMAP", b"")
    palette = np.frombuffer(raw[: len(raw) // 3 * 3], np.uint8).reshape(-1, 3)
    if kind == "ACBM":
        body = parts.get("ABIT", b"")
        bits = np.frombuffer(body[: planes * h * row].ljust(planes * h * row, b"\0"), np.uint8).reshape(planes, h, row)
    else:
        body, each_row = parts.get("BODY", b""), each * row
        if out is not None and not packed and len(body) < h * each_row:
            out.fault(f"the picture's body has {len(body)} bytes of {h * each_row}")
        body = run_rows(body, h * each, row) if packed == 1 else body[: h * each_row].ljust(h * each_row, b"\0")
        bits = np.frombuffer(body, np.uint8).reshape(h, each, row)[:, :planes].transpose(1, 0, 2)
    flat = np.unpackbits(bits, axis=2)[:, :, :w].astype(np.int64)
    pens = (flat << np.arange(planes)[:, None, None]).sum(axis=0)
    return Picture(w, h, planes, mode, palette, pens)


def ilbm(name: str, d: bytes) -> Decoded:
    out = Decoded("picture")
    p = picture_of(d, out)
    modes = [n for n, on in (("half-bright", p.mode & 0x80), ("hold-and-modify", p.mode & 0x800), ("high resolution", p.mode & 0x8000), ("interlaced", p.mode & 4)) if on]
    for k, v in (("width", p.width), ("height", p.height), ("planes", p.planes), ("colours", len(p.palette)), ("mode", ", ".join(modes) or "plain"), ("form", form(d))):
        out.put("picture", k, v)
    out.picture = (p.width, p.height, p.rgb().tobytes())
    return out


def delta5(pens: np.ndarray, planes: int, d: bytes) -> np.ndarray:
    """A frame from the one two before by vertical byte deltas: for each plane and column of bytes, skips, runs and bytes as they are."""
    h, w = pens.shape
    row = (w + 15) // 16 * 2
    wide = np.zeros((h, row * 8), np.int64)
    wide[:, :w] = pens
    for plane in range(min(planes, 8)):
        at = u32(d, 4 * plane)
        if not at:
            continue
        bits = np.packbits((wide >> plane & 1).astype(np.uint8), axis=1)
        for column in range(row):
            if at >= len(d):
                break
            y, n = 0, d[at]
            at += 1
            for _ in range(n):
                op = d[at] if at < len(d) else 0
                if op == 0:  # a run
                    count, value = (d[at + 1], d[at + 2]) if at + 2 < len(d) else (0, 0)
                    bits[y : y + count, column] = value
                    y, at = y + count, at + 3
                elif op < 128:
                    y, at = y + op, at + 1
                else:
                    count = op & 127
                    own = d[at + 1 : at + 1 + count][: max(0, h - y)]
                    bits[y : y + len(own), column] = np.frombuffer(own, np.uint8)
                    y, at = y + count, at + 1 + count
        wide = wide & ~(1 << plane) | np.unpackbits(bits, axis=1).astype(np.int64) << plane
    return wide[:, :w]


def animation(d: bytes) -> Iterator[Picture]:
    """Frames one after another; each delta is of the frame two before."""
    before: list[Picture] = []
    for name, body in chunks(d):
        if name != "FORM" or body[:4] != b"ILBM":
            continue
        frame = b"FORM" + len(body).to_bytes(4, "big") + body
        parts = dict(chunks(frame))
        if "BODY" in parts:
            now = picture_of(frame)
        elif before and "DLTA" in parts and len(parts.get("ANHD", b"")) >= 1:
            if parts["ANHD"][0] != 5:
                raise Refused(f"operation {parts['ANHD'][0]}")
            base = before[-2] if len(before) > 1 else before[-1]
            raw = parts.get("CMAP", b"")
            palette = np.frombuffer(raw[: len(raw) // 3 * 3], np.uint8).reshape(-1, 3) if raw else before[-1].palette
            now = Picture(base.width, base.height, base.planes, base.mode, palette, delta5(base.pens, base.planes, parts["DLTA"]))
        else:
            continue
        before = [*before[-1:], now]
        yield now


def anim(name: str, d: bytes) -> Decoded:
    out, n, first = Decoded("animation"), 0, None
    try:
        for p in animation(d):
            n += 1
            first = first or p
            if n >= FRAMES:
                break
    except Refused as e:
        out.fault(str(e))
    if first is None:
        raise Refused("no frame")
    for k, v in (("frames", n), ("width", first.width), ("height", first.height), ("planes", first.planes)):
        out.put("animation", k, v)
    out.picture = (first.width, first.height, first.rgb().tobytes())
    return out


# Sounds and scores


def sound(name: str, d: bytes) -> Decoded:
    out, parts = Decoded("sound"), {}
    for k, v in chunks(d):
        parts.setdefault(k, v)
    head, body = parts.get("VHDR", b""), parts.get("BODY", b"")
    if len(head) < 20:
        raise Refused("no sound's header")
    once, repeat, cycle, rate, octaves, packed, volume = u32(head, 0), u32(head, 4), u32(head, 8), u16(head, 12), head[14], head[15], u32(head, 16)
    stereo = u32(parts.get("CHAN", bytes(4)), 0) == 6
    for k, v in (("samples a second", rate), ("once", once), ("repeated", repeat), ("samples a cycle", cycle), ("octaves", octaves), ("volume", round(volume / 65536, 4)), ("channels", 1 + stereo), ("compression", packed)):
        out.put("sound", k, v)
    for k in ("NAME", "AUTH", "ANNO", "(c) "):
        if k in parts:
            out.put("text", k.strip(), text(parts[k]))
    want = (once + repeat) * ((1 << min(octaves, 32)) - 1) * (1 + stereo)
    if packed:
        out.fault("a compressed body isn't decoded")
    elif len(body) != want:
        out.fault(f"the body has {len(body)} bytes, its header says {want}")
    if body and not packed:
        out.put("sound", "peak", int(np.abs(np.frombuffer(body, np.int8).astype(np.int16)).max()))
        if rate:
            out.put("sound", "seconds", round((once + repeat) / rate, 3))
    return out


def waveform(body: bytes, columns: int) -> list[tuple[int, int]]:
    """Least and greatest sample of each of so many even parts."""
    x = np.frombuffer(body, np.int8)
    if not len(x):
        return []
    cuts = np.unique(np.linspace(0, len(x), min(columns, len(x)) + 1).astype(int))[:-1]
    return list(zip(np.minimum.reduceat(x, cuts).tolist(), np.maximum.reduceat(x, cuts).tolist(), strict=True))


def module(name: str, d: bytes) -> Decoded:
    out = Decoded("module")
    orders = d[952:1080]
    patterns, length = max(orders) + 1, d[950]
    out.put("module", "title", text(d[:20]))
    out.put("module", "tag", d[1080:1084].decode("latin-1"))
    out.put("module", "positions", length)
    out.put("module", "patterns", patterns)
    if len(d) < 1084 + patterns * 1024:
        out.fault("cut within its patterns")
    total = 0
    for i in range(31):
        s = d[20 + 30 * i : 50 + 30 * i]
        if n := 2 * u16(s, 22):
            total += n
            out.put(f"sample {i + 1}", "bytes", n)
            out.put(f"sample {i + 1}", "volume", s[25])
        if label := text(s[:22]):
            out.put(f"sample {i + 1}", "name", label)
    if len(d) < 1084 + patterns * 1024 + total:
        out.fault(f"{1084 + patterns * 1024 + total - len(d)} bytes of samples are missing")
    out.put("module", "seconds", round(float(play_time(d)), 2))
    return out


def play_time(d: bytes) -> Fraction:
    """Seconds until a row comes again outside of a pattern's loop, by speed and tempo, jumps, breaks, loops and delays."""
    length, time, rows, speed, tempo = max(1, d[950]), Fraction(0), 0, 6, 125
    seen, position, row, loop_row, loops = set(), 0, 0, 0, 0
    while position < length and rows < PLAYED and ((position, row) not in seen or loops):
        seen.add((position, row))
        rows += 1
        at = 1084 + d[952 + position] * 1024 + row * 16
        jump = skip = back = None
        delay = 0
        for c in range(4):
            cell = d[at + 4 * c : at + 4 * c + 4].ljust(4, b"\0")
            effect, value = cell[2] & 15, cell[3]
            if effect == 15 and value:
                speed, tempo = (value, tempo) if value < 32 else (speed, value)
            elif effect == 11:
                jump = value
            elif effect == 13:
                skip = min(63, (value >> 4) * 10 + (value & 15))
            elif effect == 14 and value >> 4 == 6:
                if not value & 15:
                    loop_row = row
                elif loops:
                    loops -= 1
                    back = loop_row if loops else None
                else:
                    loops, back = value & 15, loop_row
            elif effect == 14 and value >> 4 == 14:
                delay = value & 15
        time += Fraction(5, 2) * speed * (1 + delay) / tempo
        if back is not None:
            row = back
        elif jump is not None or skip is not None:
            position, row, loop_row = position + 1 if jump is None else jump, skip or 0, 0
        else:
            row += 1
            if row == 64:
                position, row, loop_row = position + 1, 0, 0
    return time


def score(name: str, d: bytes) -> Decoded:
    out, tracks, head = Decoded("score"), [], b""
    for k, v in chunks(d):
        if k == "SHDR":
            head = v
        elif k == "TRAK":
            tracks.append(v)
        elif k == "INS1" and len(v) >= 4:
            out.put("instrument", str(v[0]), text(v[4:]))
        elif k in ("NAME", "AUTH", "ANNO"):
            out.put("text", k, text(v))
    if len(head) < 4:
        raise Refused("no score's header")
    tempo = u16(head, 0)
    out.put("score", "quarters a minute", round(tempo / 128, 3))
    out.put("score", "tracks", head[3])
    if head[3] != len(tracks):
        out.fault(f"the header says {head[3]} tracks, {len(tracks)} are there")
    longest = 0
    for i, t in enumerate(tracks):
        notes, parts = track_length(t)
        longest = max(longest, parts)
        out.put(f"track {i + 1}", "notes", notes)
        out.put(f"track {i + 1}", "quarters", Fraction(parts, QUARTER))
    if tempo:
        out.put("score", "seconds", round(longest / QUARTER * 60 * 128 / tempo, 2))
    return out


def track_length(t: bytes) -> tuple[int, int]:
    """Notes, and time in parts of a quarter; of a chord only the last note's time counts."""
    notes = parts = 0
    for i in range(0, len(t) - 1, 2):
        code, value = t[i], t[i + 1]
        if code <= 128:
            notes += code < 128
            one = (4 * QUARTER) >> (value & 7)
            one = one * 3 // 2 if value & 8 else one
            one = one * (1, 2, 4, 6)[value >> 4 & 3] // (1, 3, 5, 7)[value >> 4 & 3]
            if not (value & 128 and code < 128):
                parts += one
        elif code == 255:
            break
    return notes, parts


# Icons, fonts, preferences

ICON_KINDS = {1: "disk", 2: "drawer", 3: "tool", 4: "project", 5: "trash", 6: "device", 7: "kickstart", 8: "application"}
#: Colours of icons by revision (fixed values): the older blue, white, black and orange; the newer grey, black, white and blue.
PALETTES = [[(0, 85, 170), (255, 255, 255), (0, 0, 34), (255, 136, 0)], [(170, 170, 170), (0, 0, 0), (255, 255, 255), (102, 136, 187)]]


def icon(name: str, d: bytes) -> Decoded:
    if len(d) < 78:
        raise Refused("cut within its header")
    out, at = Decoded("icon"), 78
    out.put("icon", "kind", ICON_KINDS.get(d[48], d[48]))
    out.put("icon", "size", f"{u16(d, 12)} by {u16(d, 14)}")
    out.put("icon", "stack", u32(d, 74))
    revision = d[47] if len(d) > 47 else 0
    if u32(d, 66):
        at += 56

    def image(at: int, label: str) -> int:
        w, h, depth, there = u16(d, at + 4), u16(d, at + 6), u16(d, at + 8), u32(d, at + 10)
        if not (0 < w <= ICON_SIDE and 0 < h <= ICON_SIDE and 0 < depth <= 8):
            raise Refused(f"an image of {w} by {h} in {depth} planes")
        at, row = at + 20, (w + 15) // 16 * 2
        size = depth * h * row if there else 0
        if there and at + size <= len(d):
            bits = np.unpackbits(np.frombuffer(d, np.uint8, size, at).reshape(depth, h, row), axis=2)[:, :, :w].astype(np.int64)
            pens = (bits << np.arange(depth)[:, None, None]).sum(axis=0)
            if out.picture is None:
                out.picture = (w, h, np.array(PALETTES[revision > 0], np.uint8)[pens & 3].tobytes())
            out.put(label, "size", f"{w} by {h} in {depth} planes")
        elif there:
            out.fault(f"{label} is cut")
        return at + size

    def string(at: int) -> tuple[str, int]:
        n = u32(d, at)
        return text(d[at + 4 : at + 4 + n]), at + 4 + n

    if u32(d, 22):
        at = image(at, "image")
    if u32(d, 26):
        at = image(at, "selected image")
    if u32(d, 50):
        tool, at = string(at)
        out.put("icon", "default tool", tool)
    if u32(d, 54):
        n = max(0, u32(d, at) // 4 - 1)
        at += 4
        for i in range(min(n, len(d) // 4)):
            if at + 4 > len(d):
                out.fault("tool types are cut")
                break
            value, at = string(at)
            out.put("tool types", str(i + 1), value)
    return out


def font(name: str, d: bytes) -> Decoded:
    """A bitmap font within a load file: its header follows the code that returns at once."""
    start = d.find(b"\x70\xff\x4e\x75")
    if start < 0 or len(d) < start + 110:
        raise Refused("no font's header")
    b, out = start + 4, Decoded("font")
    t = b + 54  # name of 32 letters behind node, identifier, revision and segment
    out.put("font", "name", text(d[b + 22 : b + 54]))
    height, style, flags, width, base, first, last = u16(d, t + 20), d[t + 22], d[t + 23], u16(d, t + 24), u16(d, t + 26), d[t + 32], d[t + 33]
    data, modulo, places = u32(d, t + 34), u16(d, t + 38), u32(d, t + 40)
    for k, v in (("height", height), ("width", width), ("baseline", base), ("first", first), ("last", last), ("style", style), ("flags", flags)):
        out.put("font", k, v)
    if 0 < height <= 256 and modulo and first <= last:
        glyphs = []
        for i in range(last - first + 2):
            at = start + places + 4 * i
            glyphs.append((u16(d, at), u16(d, at + 2)))
        out.put("font", "letters", sum(w > 0 for _, w in glyphs))
        out.put("font", "widest", max(w for _, w in glyphs))
        out.picture = specimen(d[start + data :], height, modulo, glyphs[:-1])
    return out


def specimen(data: bytes, height: int, modulo: int, glyphs: list[tuple[int, int]]) -> tuple[int, int, bytes]:
    """All letters in a row; what the table lacks is empty."""
    rows = np.frombuffer(data[: height * modulo].ljust(height * modulo, b"\0"), np.uint8).reshape(height, modulo)
    bits = np.unpackbits(rows, axis=1)
    parts = [np.pad(bits[:, x : x + w], ((0, 0), (0, max(0, w - max(0, bits.shape[1] - x))))) for x, w in glyphs if 0 < w <= 256]
    page = np.concatenate(parts, axis=1) if parts else np.zeros((height, 1), np.uint8)
    shade = np.where(page[:, :SIDE] > 0, 0, 255).astype(np.uint8)
    return shade.shape[1], height, np.repeat(shade[:, :, None], 3, axis=2).tobytes()


def font_contents(name: str, d: bytes) -> Decoded:
    out = Decoded("font contents")
    for i in range(min(u16(d, 2), (len(d) - 4) // 260)):
        e = d[4 + 260 * i : 264 + 260 * i]
        out.put(f"font {i + 1}", "file", text(e[:254]))
        out.put(f"font {i + 1}", "height", u16(e, 256))
    if u16(d, 2) * 260 + 4 > len(d):
        out.fault("the table is cut")
    return out


def preferences(name: str, d: bytes) -> Decoded:
    out = Decoded("preferences")
    for k, at, size in (("font height", 0, 1), ("printer port", 1, 1), ("baud rate", 2, 2), ("pointer ticks", 108, 2), ("printer type", 126, 2), ("pitch", 158, 2), ("quality", 160, 2), ("spacing", 162, 2), ("left margin", 164, 2), ("right margin", 166, 2), ("paper size", 176, 2), ("paper length", 178, 2), ("paper type", 180, 2)):
        out.put("preferences", k, int.from_bytes(d[at : at + size], "big"))
    for k, at in (("key repeat", 4), ("key delay", 12), ("double click", 20)):
        out.put("preferences", k, f"{u32(d, at)}.{u32(d, at + 4):06} s")
    for i, at in enumerate((110, 112, 114, 116, 102, 104, 106)):
        out.put("colours", str(i if i < 4 else i + 13), f"{u16(d, at):03X}")
    out.put("preferences", "printer file", text(d[128:158]))
    newer = not any(d[220:232])
    out.put("preferences", "workbench" if newer else "name", text(d[186:216]))
    return out


def iff_preferences(name: str, d: bytes) -> Decoded:
    """Each chunk with its size and, of those of fixed size, its numbers."""
    out = Decoded("preferences form")
    sizes = {"PRHD": 6, "SCRM": 28, "PNTR": None, "FONT": None, "INPT": 44, "OSCN": 16, "PALT": 16, "PTXT": 70, "PGFX": 54, "SERL": 30, "ICTL": 32, "LCLE": None, "WBNC": None, "SOND": None}
    for k, v in chunks(d):
        want = sizes.get(k)
        if want is not None and len(v) != want:
            out.fault(f"{k} has {len(v)} bytes instead of {want}")
            continue
        out.put(k, "bytes", len(v))
        if want is not None and k != "PRHD":
            out.put(k, "numbers", " ".join(str(u16(v, i)) for i in range(0, len(v) - 1, 2)))
        elif k in ("FONT", "LCLE"):
            words = [text(x) for x in v.split(b"\0") if len(x) > 2 and all(32 <= c < 127 for c in x)]
            out.put(k, "text", ", ".join(words))
    return out


def catalog(name: str, d: bytes) -> Decoded:
    out, n = Decoded("catalog"), 0
    for k, v in chunks(d):
        if k in ("FVER", "LANG"):
            out.put("catalog", {"FVER": "version", "LANG": "language"}[k], text(v))
        elif k == "CSET" and len(v) >= 4:
            out.put("catalog", "code set", u32(v, 0))
        elif k == "STRS":
            at = 0
            while at + 8 <= len(v):
                size = u32(v, at + 4)
                if at + 8 + size > len(v):
                    out.fault("a string is cut")
                    break
                out.put("strings", str(u32(v, at)), text(v[at + 8 : at + 8 + size]))
                n += 1
                at += 8 + -(-(size + size % 2) // 4) * 4
    out.put("catalog", "strings", n)
    return out


def datatype(name: str, d: bytes) -> Decoded:
    out = Decoded("datatype")
    for k, v in chunks(d):
        if k in ("NAME", "VERS"):
            out.put("datatype", k.lower(), text(v))
        elif k == "DTHD" and len(v) >= 32:
            for label, at in (("name", 0), ("base name", 4), ("pattern", 8)):
                if 0 < u32(v, at) < len(v):
                    out.put("datatype", label, text(v[u32(v, at) :]))
            out.put("datatype", "group", v[16:20].decode("latin-1"))
            out.put("datatype", "id", v[20:24].decode("latin-1"))
            n, at = u16(v, 24), u32(v, 12)
            words = [int.from_bytes(v[at + 2 * i : at + 2 * i + 2], "big", signed=True) for i in range(n if at and at + 2 * n <= len(v) else 0)]
            out.put("datatype", "mask", " ".join("any" if w < 0 else f"{w & 255:02X}" for w in words))
    return out


def formatted_text(name: str, d: bytes) -> Decoded:
    """Text without control sequences."""
    import re

    out = Decoded("text form")
    body = b"".join(v for k, v in chunks(d) if k == "CHRS").decode("latin-1")
    plain = re.sub("(?:\x1b\\[|\x9b)[0-9;?]*[ -/]*[@-~]", "", body)
    out.put("text", "characters", len(body))
    out.put("text", "plain", plain)
    return out


# Load files

HUNKS = {0x3E9: "code", 0x3EA: "data", 0x3EB: "bss"}


@dataclass
class Hunk:
    kind: str
    size: int
    data: bytes
    relocations: dict[int, list[int]] = field(default_factory=dict)
    symbols: list[tuple[str, int]] = field(default_factory=list)


def hunks(d: bytes) -> tuple[list[Hunk], str | None]:
    """The hunks of a load file, and the fault that ends them."""
    if u32(d, 0) != 0x3F3:
        return [], "not a load file"
    at = 4
    while at + 4 <= len(d) and (n := u32(d, at)):  # names of resident libraries
        at += 4 + 4 * n
    at += 4
    if at + 12 > len(d):
        return [], "truncated"
    first, last = u32(d, at + 4), u32(d, at + 8)
    at += 12 + 4 * max(0, last - first + 1)
    out: list[Hunk] = []
    while at + 4 <= len(d):
        kind = u32(d, at) & 0x3FFFFFFF
        if kind in HUNKS:
            n = (u32(d, at + 4) & 0x3FFFFFFF) * 4
            body = b"" if kind == 0x3EB else d[at + 8 : at + 8 + n]
            if kind != 0x3EB and len(body) < n:
                return out, "truncated"
            out.append(Hunk(HUNKS[kind], n, body))
            at += 8 + len(body)
        elif kind in (0x3EC, 0x3F7) and out:
            short, at = kind == 0x3F7, at + 4
            size, read = (2, u16) if short else (4, u32)
            while at + size <= len(d) and (n := read(d, at)):
                target = read(d, at + size)
                end = at + 2 * size + n * size
                if end > len(d):
                    return out, "truncated"
                out[-1].relocations.setdefault(target, []).extend(read(d, at + 2 * size + i * size) for i in range(n))
                at = end
            at += size
            at += at % 4 if short else 0
        elif kind == 0x3F0 and out:
            at += 4
            while at + 4 <= len(d) and (n := u32(d, at)):
                out[-1].symbols.append((text(d[at + 4 : at + 4 + 4 * n]), u32(d, at + 4 + 4 * n)))
                at += 8 + 4 * n
            at += 4
        elif kind in (0x3F1, 0x3E8):
            at += 8 + 4 * u32(d, at + 4)
        elif kind == 0x3F2:
            at += 4
        else:
            return out, f"unknown hunk {kind:#x}"
    return out, None if len(out) > last - first else "truncated"


def program(name: str, d: bytes) -> Decoded:
    out = Decoded("program")
    found, fault = hunks(d)
    for i, h in enumerate(found):
        out.put(f"hunk {i}", "kind", h.kind)
        out.put(f"hunk {i}", "bytes", h.size)
        out.put(f"hunk {i}", "relocations", sum(map(len, h.relocations.values())))
        if h.symbols:
            out.put(f"hunk {i}", "symbols", len(h.symbols))
    if fault:
        out.fault(fault)
    return out


def _pointer(h: Hunk, at: int) -> int | None:
    """Where a relocated long within the first hunk points, in the same hunk."""
    return u32(h.data, at) if at in h.relocations.get(0, ()) and u32(h.data, at) < len(h.data) else None


def _first_hunk(d: bytes) -> Hunk | None:
    found = hunks(d)[0] if u32(d, 0) == 0x3F3 else []
    return found[0] if found and found[0].data else None


#: Places of a key map's eight tables, behind its node; bits of a key's type (fixed values).
KEY_TABLES, KEY_BITS = [14 + 4 * i for i in range(8)], {1: "shift", 2: "alt", 4: "control", 8: "down and up", 32: "dead", 64: "string", 128: "none"}


def is_keymap(name: str, d: bytes) -> bool:
    h = _first_hunk(d)
    return h is not None and all(_pointer(h, at) is not None for at in (10, *KEY_TABLES))


def keymap(name: str, d: bytes) -> Decoded:
    """The letters of each key: alone and with shift where its type takes that; dead keys and strings by name."""
    h, out = _first_hunk(d), Decoded("keymap")
    out.put("keymap", "name", text(h.data[_pointer(h, 10) :]))
    count: dict[str, int] = {}
    for first, types, table, keys in ((0, KEY_TABLES[0], KEY_TABLES[1], 64), (64, KEY_TABLES[4], KEY_TABLES[5], 56)):
        t, m = _pointer(h, types), _pointer(h, table)
        for i in range(keys):
            if t + i >= len(h.data) or m + 4 * i + 4 > len(h.data):
                out.fault(f"the table ends before key {first + i:#04x}")
                break
            kind, four = h.data[t + i], h.data[m + 4 * i : m + 4 * i + 4]
            names = [n for bit, n in KEY_BITS.items() if kind & bit]
            for n in names or ["plain"]:
                count[n] = count.get(n, 0) + 1
            if not kind & 0xE0 and any(four):
                shown = [bytes([four[3 - k]]).decode("latin-1") for k in (0, 1) if k == 0 or kind & 1]
                out.put("keys", f"{first + i:02X}", " ".join(c if c.isprintable() else f"<{ord(c)}>" for c in shown))
    for n, k in sorted(count.items()):
        out.put("types", n, k)
    return out


#: Places of a printer driver's pointers: name, start, end, opening, closing (fixed values).
PRINTER = (8, 12, 16, 20, 24)


def is_printer(name: str, d: bytes) -> bool:
    h = _first_hunk(d)
    return h is not None and all(any(at in places for places in h.relocations.values()) for at in PRINTER)


def printer(name: str, d: bytes) -> Decoded:
    h, out = _first_hunk(d), Decoded("printer driver")
    if _pointer(h, 8) is not None:
        out.put("printer", "name", text(h.data[_pointer(h, 8) :]))
    x = h.data
    for k, v in (("version", f"{u16(x, 4)}.{u16(x, 6)}"), ("class", x[28]), ("colours", x[29]), ("columns", x[30]), ("character sets", x[31]), ("rows", u16(x, 32)), ("dots across", u32(x, 34)), ("dots down", u32(x, 38)), ("dots an inch across", u16(x, 42)), ("dots an inch down", u16(x, 44)), ("seconds to wait", u32(x, 58))):
        out.put("printer", k, v)
    return out


# Dispatch: kinds in the order they are tried

KINDS: list[tuple[str, Callable[[str, bytes], bool], Callable[[str, bytes], Decoded]]] = [
    ("icon", lambda n, d: d[:2] == b"\xe3\x10", icon),
    ("picture", lambda n, d: form(d) in ("ILBM", "ACBM"), ilbm),
    ("animation", lambda n, d: form(d) == "ANIM", anim),
    ("sound", lambda n, d: form(d) == "8SVX", sound),
    ("score", lambda n, d: form(d) == "SMUS", score),
    ("preferences form", lambda n, d: form(d) == "PREF", iff_preferences),
    ("catalog", lambda n, d: form(d) == "CTLG", catalog),
    ("datatype", lambda n, d: form(d) == "DTYP", datatype),
    ("text form", lambda n, d: form(d) == "FTXT", formatted_text),
    ("font", lambda n, d: u32(d, 0) == 0x3F3 and b"\x70\xff\x4e\x75" in d[:64] and b"\x0f\x80" in d[:128], font),
    ("font contents", lambda n, d: len(d) >= 4 and u16(d, 0) in (0x0F00, 0x0F02) and len(d) >= 4 + 260 * max(1, u16(d, 2)), font_contents),
    ("module", lambda n, d: len(d) >= 1084 and d[1080:1084] in (b"M.K.", b"M!K!", b"FLT4"), module),
    ("keymap", is_keymap, keymap),
    ("printer driver", is_printer, printer),
    ("program", lambda n, d: u32(d, 0) == 0x3F3, program),
    ("preferences", lambda n, d: len(d) == 232 and n.rpartition("/")[2].lower() == "system-configuration", preferences),
]


def kind_of(name: str, d: bytes) -> str:
    """The file's kind; else text if nine tenths of its first 4,096 bytes are printable and none is NUL, empty, or data."""
    for kind, test, _ in KINDS:
        if test(name, d):
            return kind
    if not d:
        return "empty"
    head = d[:4096]
    printable = sum(32 <= c < 127 or c >= 160 or c in (9, 10, 12, 13) for c in head)
    return "form" if form(d) else "text" if 0 not in head and 10 * printable >= 9 * len(head) else "data"


def decode(name: str, d: bytes) -> Decoded:
    for _, test, read in KINDS:
        if test(name, d):
            try:
                return read(name, d)
            except (IndexError, ValueError) as e:
                raise Refused(f"damaged: {e}") from None
    raise Refused(f"no decoder for {kind_of(name, d)}")
