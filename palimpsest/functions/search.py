"""Patterns and magics in bytes: every occurrence, overlapping ones included, by the library's linear search."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

#: Names, categories, magics and whether they count at the beginning of a block only (fixed values).
SIGNATURES = [
    ("Amiga hunk executable", "executable", b"\x00\x00\x03\xf3", True),
    ("Amiga hunk object", "executable", b"\x00\x00\x03\xe7", True),
    ("Amiga icon (.info)", "other", b"\xe3\x10\x00\x01", True),
    ("AmigaGuide document", "other", b"@database", True),
    ("IFF", "iff", b"FORM", True),
    ("PowerPacker PP20", "compressed", b"PP20", True),
    ("PowerPacker PP11", "compressed", b"PP11", True),
    ("Imploder", "compressed", b"IMP!", True),
    ("XPK-compressed", "compressed", b"XPKF", True),
    ("RNC ProPack", "compressed", b"RNC\x01", True),
    ("LZX archive", "archive", b"LZX", True),
    ("ZIP archive", "archive", b"PK\x03\x04", True),
    ("gzip", "archive", b"\x1f\x8b", True),
    ("ProTracker module (M.K.)", "audio", b"M.K.", False),
    ("ProTracker module (M!K!)", "audio", b"M!K!", False),
    ("Startrekker module", "audio", b"FLT4", False),
    ("OctaMED module", "audio", b"MMD", True),
    ("AHX / THX module", "audio", b"THX", True),
    ("PNG", "image", b"\x89PNG", True),
    ("JPEG", "image", b"\xff\xd8\xff", True),
    ("GIF", "image", b"GIF8", True),
    ("xDMS unpack failure filler", "other", b"DMS!!ERR", True),
    ("xDMS version filler", "other", b"DMS!1.", True),
    ("DMS archive", "disk-image", b"DMS!", True),
    ("SuperCard Pro flux", "disk-image", b"SCP", True),
    ("extended ADF", "disk-image", b"UAE-1ADF", True),
]


@dataclass(frozen=True)
class Pattern:
    data: bytes
    is_hex: bool
    ignore_case: bool

    @classmethod
    def parse(cls, text: str, force_text: bool = False, ignore_case: bool = False) -> Pattern:
        """Hex where the text has 0x before it, or is nothing but an even number of hex digits, spaces and commas; else Latin-1 text."""
        if not text:
            raise ValueError("an empty pattern")
        bare = re.sub(r"[\s,]", "", text)
        stated = text[:2].lower() == "0x"
        if not force_text and (stated or re.fullmatch("(?:[0-9a-fA-F]{2})+", bare)):
            digits = bare[2:] if stated else bare
            if len(digits) % 2:
                raise ValueError("an odd number of hex digits")
            return cls(bytes.fromhex(digits), True, False)
        return cls(text.encode("latin-1"), False, ignore_case)


def occurrences(data: bytes, needle: bytes) -> Iterator[int]:
    at = data.find(needle) if needle else -1
    while at >= 0:
        yield at
        at = data.find(needle, at + 1)


def search(data: bytes, pattern: Pattern) -> Iterator[int]:
    """Offsets in order. Case is ignored in ASCII letters only."""
    return occurrences(data.lower(), pattern.data.lower()) if pattern.ignore_case else occurrences(data, pattern.data)


@dataclass
class Hit:
    name: str
    category: str
    offset: int
    block: int
    blocks: int = 1


def scan(data: bytes, block_size: int = 512, table=SIGNATURES) -> list[Hit]:
    """Of the magics at one place the longest (then the first by name); the same at the beginnings of neighbouring blocks is one hit of several blocks."""
    best: dict[int, tuple] = {}
    for name, category, magic, aligned in table:
        for at in occurrences(data, magic):
            if not aligned or at % block_size == 0:
                rank = (-len(magic), name)
                if at not in best or rank < best[at][0]:
                    best[at] = (rank, category)
    out: list[Hit] = []
    for at, ((_, name), category) in sorted(best.items()):
        last = out[-1] if out else None
        if last and last.name == name and not last.offset % block_size and not at % block_size and last.block + last.blocks == at // block_size:
            last.blocks += 1
        else:
            out.append(Hit(name, category, at, at // block_size))
    return out
