"""Decoders on files made here."""

import struct

import numpy as np
import pytest

from palimpsest.functions import media as m


def form(kind, *parts):
    b = kind + b"".join(n + struct.pack(">I", len(d)) + d + b"\0" * (len(d) & 1) for n, d in parts)
    return b"FORM" + struct.pack(">I", len(b)) + b


def head(w, h, planes, packed=0):
    return b"BMHD", struct.pack(">HHhhBBBBHBBhh", w, h, 0, 0, planes, 0, packed, 0, 0, 1, 1, w, h)


def planar(pens, planes):
    h, w = pens.shape
    wide = np.zeros((h, (w + 15) // 16 * 16), np.uint8)
    wide[:, :w] = pens
    return b"".join(np.packbits(wide[y] >> p & 1).tobytes() for y in range(h) for p in range(planes))


def fields(d):
    return {(g, n): v for g, n, v in d.fields}


def test_pictures():
    pens = np.random.default_rng(1).integers(0, 32, (5, 37)).astype(np.uint8)
    palette = bytes(range(96))
    for packed in (0, 1):
        body = planar(pens, 5)
        if packed:
            body = b"".join(bytes([len(r) - 1]) + r for r in (body[i : i + 6] for i in range(0, len(body), 6)))
        d = m.decode("p", form(b"ILBM", head(37, 5, 5, packed), (b"CMAP", palette), (b"BODY", body)))
        assert d.kind == "picture" and d.picture == (37, 5, np.frombuffer(palette, np.uint8).reshape(-1, 3)[pens].tobytes())
    assert m.unrun(bytes([254, 7, 128, 1, 5, 6]), 6) == b"\x07\x07\x07\x05\x06\x00"
    half = m.decode("p", form(b"ILBM", head(16, 1, 6), (b"CAMG", struct.pack(">I", 0x80)), (b"CMAP", palette), (b"BODY", planar(np.full((1, 16), 33, np.uint8), 6))))
    assert half.picture[2][:3] == bytes(x >> 1 for x in palette[3:6])
    ham = np.array([[1, 0x10 | 15, 0x20 | 3, 0x30 | 8]], np.uint8)
    d = m.decode("p", form(b"ILBM", head(4, 1, 6), (b"CAMG", struct.pack(">I", 0x800)), (b"CMAP", palette), (b"BODY", planar(ham, 6))))
    assert [tuple(d.picture[2][i : i + 3]) for i in range(0, 12, 3)] == [(3, 4, 5), (3, 4, 255), (51, 4, 255), (51, 136, 255)]
    with pytest.raises(m.Refused):
        m.decode("p", form(b"ILBM", head(9000, 1, 1)))


def test_animation():
    one = np.zeros((4, 16), np.uint8)
    first = (b"FORM", form(b"ILBM", head(16, 4, 1), (b"CMAP", bytes(6)), (b"BODY", planar(one, 1)))[8:])
    delta = struct.pack(">I", 64) + bytes(60) + bytes([2, 1, 0x82, 0xFF, 0x0F]) + bytes([1, 0, 2, 0x80])
    second = (b"FORM", form(b"ILBM", (b"ANHD", bytes([5]) + bytes(39)), (b"DLTA", delta))[8:])
    frames = list(m.animation(form(b"ANIM", first, second)))
    assert len(frames) == 2 and frames[1].pens[1, :8].all() and frames[1].pens[2, 4:8].all() and not frames[1].pens[3, :8].any() and frames[1].pens[:2, 8].all()
    assert fields(m.decode("a", form(b"ANIM", first, second)))["animation", "frames"] == "2"


def test_sounds_and_scores():
    d = m.decode("s", form(b"8SVX", (b"VHDR", struct.pack(">IIIHBBI", 4, 0, 0, 8000, 1, 0, 65536)), (b"NAME", b"beep"), (b"BODY", b"\x01\xff\x7f\x80")))
    assert fields(d)["sound", "peak"] == "128" and fields(d)["text", "NAME"] == "beep" and ("fault", "") not in fields(d)
    assert m.waveform(b"\x01\xff\x7f\x80", 2) == [(-1, 1), (-128, 127)]
    score = form(b"SMUS", (b"SHDR", struct.pack(">HBB", 128 * 120, 100, 1)), (b"TRAK", bytes([60, 2, 62, 2 | 128, 64, 2, 128, 1, 60, 10, 60, 2 | 16])))
    assert m.track_length(bytes([60, 10, 60, 18])) == (2, m.QUARTER * 3 // 2 + m.QUARTER * 2 // 3)
    assert fields(m.decode("k", score))["track 1", "notes"] == "5"
    mod = bytearray(1084 + 2048)
    mod[950], mod[952], mod[953], mod[1080:1084], mod[:4] = 2, 0, 1, b"M.K.", b"song"
    assert m.play_time(bytes(mod)) * 125 == 128 * 15
    mod[1084 + 2 : 1084 + 4] = bytes([0x0D, 0x00])  # a break in the first row
    mod[1084 + 1024 + 2 : 1084 + 1024 + 4] = bytes([0x0B, 0x00])  # a jump back to the beginning
    assert m.play_time(bytes(mod)) * 125 == 2 * 15


def test_system_files():
    icon = bytearray(78)
    icon[:4], icon[12:16], icon[22:26], icon[48], icon[50:54], icon[54:58], icon[74:78] = b"\xe3\x10\0\1", struct.pack(">HH", 16, 2), b"\0\0\0\1", 4, b"\0\0\0\1", b"\0\0\0\1", struct.pack(">I", 4096)
    image = struct.pack(">hhHHHIBBI", 0, 0, 16, 2, 2, 1, 3, 0, 0) + bytes([255, 0, 0, 0, 0, 255, 0, 0])
    tail = struct.pack(">I", 5) + b"Tool\0" + struct.pack(">I", 8) + struct.pack(">I", 4) + b"A=1\0"
    d = m.decode("x.info", bytes(icon) + image + tail)
    assert fields(d)["icon", "kind"] == "project" and fields(d)["icon", "default tool"] == "Tool" and fields(d)["tool types", "1"] == "A=1" and d.picture[:2] == (16, 2)
    strings = b"".join(struct.pack(">II", i, len(s)) + s + bytes(-len(s) % 4) for i, s in enumerate([b"ja\0", b"nein"]))
    assert fields(m.decode("c", form(b"CTLG", (b"LANG", b"deutsch\0"), (b"STRS", strings))))["strings", "1"] == "nein"
    dt = struct.pack(">IIII", 32, 32, 37, 44) + b"pictilbm" + struct.pack(">HHHH", 2, 0, 0, 0) + b"ILBM\0" + b"#?.iff\0" + struct.pack(">hh", 70, -1)
    assert fields(m.decode("d", form(b"DTYP", (b"DTHD", dt))))["datatype", "mask"] == "46 any"
    assert fields(m.decode("t", form(b"FTXT", (b"CHRS", b"a\x9b1mb\x1b[0mc"))))["text", "plain"] == "abc"
    assert fields(m.decode("f", struct.pack(">HH", 0x0F00, 1) + b"topaz/8".ljust(256, b"\0") + struct.pack(">HBB", 8, 0, 0)))["font 1", "height"] == "8"
    assert m.decode("devs/system-configuration", bytes(232)).kind == "preferences"
    with pytest.raises(m.Refused):
        m.decode("devs/other", bytes(232))
    assert [m.kind_of("", x) for x in (b"", b"plain text\n", b"a\0b")] == ["empty", "text", "data"]


def test_load_files():
    code = struct.pack(">I", 0x4E754E75) * 2
    d = struct.pack(">IIIIIII", 0x3F3, 0, 2, 0, 1, 2, 4) + struct.pack(">II", 0x3E9, 2) + code + struct.pack(">IIIII", 0x3EC, 1, 1, 4, 0)
    d += struct.pack(">II", 0x3F0, 1) + b"main" + struct.pack(">II", 4, 0) + struct.pack(">I", 0x3F2) + struct.pack(">III", 0x3EB, 4, 0x3F2)
    found, fault = m.hunks(d)
    assert fault is None and [(h.kind, h.size) for h in found] == [("code", 8), ("bss", 16)] and found[0].relocations == {1: [4]} and found[0].symbols == [("main", 4)]
    assert m.hunks(d[:30])[1] == "truncated" and m.hunks(b"abcd")[1] == "not a load file"


def load_file(data, places):
    return struct.pack(">IIIIII", 0x3F3, 0, 1, 0, 0, len(data) // 4) + struct.pack(">II", 0x3EA, len(data) // 4) + data + struct.pack(f">III{len(places)}I", 0x3EC, len(places), 0, *places) + bytes(4) + struct.pack(">I", 0x3F2)


def test_drivers():
    body = bytearray(700)
    struct.pack_into(">I", body, 10, 600)
    for i, at in enumerate((50, 120, 50, 50, 400, 460, 50, 50)):
        struct.pack_into(">I", body, 14 + 4 * i, at)
    body[50 : 50 + 64] = bytes([1]) * 2 + bytes([128]) * 62
    body[120:128] = bytes([0, 0, ord("Q"), ord("q"), 0, 0, ord("!"), ord("1")])
    body[600:605] = b"gb\0\0\0"
    d = m.decode("keymaps/gb", load_file(bytes(body), [10, *range(14, 46, 4)]))
    assert d.kind == "keymap" and fields(d)["keymap", "name"] == "gb" and fields(d)["keys", "00"] == "q Q" and fields(d)["types", "none"] == "62"
    body = bytearray(120)
    for at in (8, 12, 16, 20, 24):
        struct.pack_into(">I", body, at, 100)
    body[30], body[100:105] = 80, b"laser"
    struct.pack_into(">HH", body, 42, 300, 300)
    d = m.decode("printers/x", load_file(bytes(body), [8, 12, 16, 20, 24]))
    assert d.kind == "printer driver" and fields(d)["printer", "name"] == "laser" and fields(d)["printer", "dots an inch down"] == "300"
    assert m.decode("c/x", load_file(bytes(8), [])).kind == "program"
