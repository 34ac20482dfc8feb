"""One volume's structures, read from its bytes: entries, directories, files, bitmap, directory caches.

A volume is a matrix of 32-bit words, a row a block, so tests of all blocks are array operations. Pointers are
followed one by one, as each is only known from the block before. Nothing here raises on damaged
content: what can't be followed is a Fault.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

#: Block types, and secondary types by kind.
HEADER, DATA, LIST, CACHE = 2, 8, 16, 33
KINDS = {1: "root", 2: "directory", 3: "soft link", 4: "directory link", -3: "file", -4: "file link"}
SECONDARY = {name: number for number, name in KINDS.items()}
DIRECTORIES, FILES, LINKS = {"root", "directory", "directory link"}, {"file", "file link"}, {"soft link", "directory link", "file link"}
#: Bytes before the payload of a data block of the older file system; pages a root block names.
PAYLOAD_AT, ROOT_PAGES = 24, 25


@dataclass(frozen=True)
class Fault:
    """kind: malformed, cycle, merge, not found, not a directory, broken link."""

    kind: str
    block: int
    detail: str


class Unreadable(Exception):
    """A structure that can't be followed; its fault says why."""

    def __init__(self, kind: str, block: int, detail: str):
        super().__init__(detail)
        self.fault = Fault(kind, block, detail)


@dataclass(frozen=True)
class Entry:
    block: int
    kind: str
    name: bytes
    size: int
    comment: bytes
    protection: int
    stamp: tuple[int, int, int]
    used: int
    real_entry: int
    next_link: int
    hash_chain: int
    parent: int
    extension: int
    sound: bool

    @property
    def text(self) -> str:
        return self.name.decode("latin-1")


@dataclass
class Listing:
    entries: list[Entry] = field(default_factory=list)
    faults: list[Fault] = field(default_factory=list)
    cycles: list[Fault] = field(default_factory=list)
    merges: list[Fault] = field(default_factory=list)

    @property
    def complete(self) -> bool:
        return not (self.faults or self.cycles)

    @property
    def clean(self) -> bool:
        return self.complete and not self.merges


@dataclass
class Walk:
    """entries: (path, entry) in the walk's order; damaged: (path, block, listing) of directories that aren't clean."""

    entries: list[tuple[str, Entry]] = field(default_factory=list)
    damaged: list[tuple[str, int, Listing]] = field(default_factory=list)
    hit_limit: bool = False


@dataclass
class Contents:
    data: bytes
    declared: int
    faults: list[tuple[str, int, int, int]]  # code, first block, first place in the file, how many
    exceeded: bool
    size: int = -1  # of the data, also where its bytes are left out

    def __post_init__(self):
        if self.size < 0:
            self.size = len(self.data)

    @property
    def short_by(self) -> int:
        return max(0, self.declared - self.size)

    def measured(self) -> Contents:
        return Contents(b"", self.declared, self.faults, self.exceeded, self.size)


@dataclass
class Bitmap:
    allocated: np.ndarray  # a flag for each block
    pages: list[int]
    extensions: list[int]
    bad_checksums: list[int]
    out_of_range: list[int]
    covered: int
    incomplete: bool


@dataclass
class Record:
    """What a directory cache says of an entry."""

    header: int
    size: int
    protection: int
    secondary: int
    stamp: tuple[int, int, int]
    name: bytes
    comment: bytes


def fold(name: bytes, international: bool) -> bytes:
    """Upper case as names are compared: a-z, and with `international` also 224 to 254 without 247."""
    return name.translate(_FOLD[international])


_FOLD = [bytes(c - 32 if 97 <= c <= 122 or wide and 224 <= c <= 254 and c != 247 else c for c in range(256)) for wide in (False, True)]


def name_hash(name: bytes, slots: int, international: bool) -> int:
    h = len(name)
    for c in fold(name, international):
        h = (h * 13 + c) & 0x7FF
    return h % slots


def checksum(words: np.ndarray, at: int) -> int:
    """What the long at this place must be for all longs to sum to zero."""
    return int(-(int(words.sum(dtype=np.uint64)) - int(words[at])) & 0xFFFFFFFF)


def be32(data: bytes, at: int) -> int | None:
    return int.from_bytes(data[at : at + 4], "big") if 0 <= at <= len(data) - 4 else None


class Kept:
    """What was read of a volume and still holds after some of its blocks changed: entries by block, and files by header with what reading them told."""

    def __init__(self):
        self.entries: dict[int, Entry | None] = {}
        self.files: dict[int, tuple[list[int], Contents]] = {}  # the contents' bytes are left out
        self.users: dict[int, list[int]] = {}  # headers of the files that a block was read for
        self.slots = None

    def keep(self, header: int, blocks: list[int], contents: Contents) -> None:
        self.files[header] = blocks, contents
        for b in (header, *blocks):
            self.users.setdefault(b, []).append(header)

    def drop(self, blocks) -> None:
        """Forgets what depends on these blocks; the boot block says how all others are read."""
        if 0 in blocks:
            self.__init__()
        for b in blocks:
            self.entries.pop(b, None)
            for header in self.users.pop(b, ()):
                self.files.pop(header, None)

    def fit(self, slots: int) -> None:
        """Everything is read anew where directories' tables have another size than before."""
        if self.slots != slots:
            self.__init__()
            self.slots = slots


class Volume:
    """A mounted volume. data holds whole blocks; the root block must be one, or NotMounted is raised."""

    #: Given by an editor, which tells it what changes.
    kept: Kept | None = None

    def __init__(self, data: bytes, block_size: int = 512, reserved: int = 2):
        self.size, self.reserved = block_size, reserved
        self.total = len(data) // block_size
        self.data = data
        self.words = np.frombuffer(data, ">u4", self.total * (block_size // 4)).reshape(self.total, block_size // 4)
        self.root = (reserved + self.total - 1) // 2
        if not 0 <= self.root < self.total or self.word(self.root, 0) != HEADER or self.word(self.root, -1) != 1:
            raise NotMounted(f"no root block at block {self.root}")
        self.flags = data[3] if data[:3] == b"DOS" else None
        stated = self.word(self.root, 3)
        most = block_size // 4 - 56
        self.slots = stated if 0 < stated <= most else most
        #: Without a boot block that says so, the newer file system and international names are assumed.
        self.older = self.flags is not None and self.flags % 2 == 0
        self.international = self.flags is None or bool(self.flags & 2) or self.flags >= 4
        self.cached = self.flags in (4, 5)
        self.long_names = self.flags in (6, 7)

    def word(self, block: int, at: int) -> int:
        return int(self.words[block, at])

    def inside(self, block: int) -> bool:
        return 0 <= block < self.total

    def raw(self, block: int) -> bytes:
        return bytes(self.data[block * self.size : (block + 1) * self.size])

    def counted(self, block: int, at: int, most: int) -> bytes:
        """Bytes after a length byte, which lies `at` bytes before the block's end."""
        start = (block + 1) * self.size - at
        return bytes(self.data[start + 1 : start + 1 + min(self.data[start], most)])

    def sums_to_zero(self, block: int) -> bool:
        return int(self.words[block].sum(dtype=np.uint64)) & 0xFFFFFFFF == 0

    # Entries

    def any_entry(self, block: int) -> Entry | None:
        """What the block says if it is read as an entry's header; None unless its types are an entry's."""
        if self.kept is None:
            return self._entry(block)
        if block not in self.kept.entries:
            self.kept.entries[block] = self._entry(block)
        return self.kept.entries[block]

    def _entry(self, block: int) -> Entry | None:
        w = self.words[block]
        kind = KINDS.get(int(w[-1].astype(np.int64)) - (1 << 32 if w[-1] >> 31 else 0))
        if w[0] != HEADER or kind is None:
            return None
        stamp = tuple(int(w[i]) for i in (-23, -22, -21))
        return Entry(
            block, kind, self.counted(block, 80, 30), int(w[-47]), self.counted(block, 184, 79), int(w[-48]), stamp, int(w[2]), int(w[-11]), int(w[-10]), int(w[-4]), int(w[-3]),
            int(w[-2]), self.sums_to_zero(block),
        )

    def entry(self, block: int) -> Entry:
        if not self.inside(block):
            raise Unreadable("malformed", block, "outside the volume")
        found = self.any_entry(block)
        if found is None:
            raise Unreadable("malformed", block, "not a directory entry")
        return found

    def table(self, block: int) -> list[int]:
        """A directory's hash slots, or a file's pointers as they are stored."""
        return [int(x) for x in self.words[block, 6 : 6 + self.slots]]

    def chain(self, first: int) -> tuple[list[Entry], Fault | None, bool]:
        """Entries from a slot's first block on, the fault that ends the chain, and whether it came back to itself."""
        out, seen, at = [], set(), first
        while at:
            if not self.inside(at):
                return out, Fault("malformed", at, "outside the volume"), False
            if at in seen:
                return out, Fault("cycle", at, "the hash chain loops"), True
            seen.add(at)
            found = self.any_entry(at)
            if found is None:
                return out, Fault("malformed", at, "not a directory entry"), False
            out.append(found)
            at = found.hash_chain
        return out, None, False

    def list(self, block: int) -> Listing:
        """A directory's entries, slot by slot. A link to a directory is followed once."""
        if not self.inside(block):
            raise Unreadable("malformed", block, "outside the volume")
        head = self.any_entry(block)
        if block != self.root and (head is None or head.kind not in DIRECTORIES):
            raise Unreadable("not a directory", block, "not a directory")
        if head is not None and head.kind == "directory link":
            target = self.any_entry(head.real_entry) if self.inside(head.real_entry) else None
            if target is None or target.kind != "directory":
                raise Unreadable("not a directory", block, "the link names no directory")
            block = target.block
        out, seen = Listing(), set()
        for slot, first in enumerate(self.table(block)):
            own, at = set(), first
            while at:
                if not self.inside(at):
                    out.faults.append(Fault("malformed", block, f"hash slot {slot} points outside the volume: {at}"))
                elif at in own:
                    out.cycles.append(Fault("cycle", at, "hash chain loops"))
                elif at in seen:
                    out.merges.append(Fault("merge", at, "two hash chains merge"))
                else:
                    own.add(at)
                    seen.add(at)
                    found = self.any_entry(at)
                    if found is None:
                        out.faults.append(Fault("malformed", at, "not a directory entry"))
                    else:
                        out.entries.append(found)
                    at = self.word(at, -4)
                    continue
                break
        return out

    def resolve(self, entry: Entry) -> Entry:
        """What a hard link stands for, over links to links."""
        seen, now = {entry.block}, entry
        while now.kind in LINKS:
            if now.kind == "soft link":
                raise Unreadable("broken link", entry.block, "a soft link names a path, not a block")
            at = now.real_entry
            found = self.any_entry(at) if self.inside(at) and at else None
            if at in seen or found is None:
                why = "names no target" if not at else "loops" if at in seen else f"names block {at}, which is not an entry"
                raise Unreadable("broken link", entry.block, why)
            seen.add(at)
            now = found
        return now

    def walk(self) -> Walk:
        """The whole tree from the root, each directory once; capped at as many entries as there are blocks, and told so."""
        out, visited, stack = Walk(), {self.root}, [("", self.root)]
        while stack:
            prefix, block = stack.pop()
            try:
                listing = self.list(block)
            except Unreadable as e:
                out.damaged.append((prefix, block, Listing(faults=[e.fault])))
                continue
            if not listing.clean:
                out.damaged.append((prefix, block, listing))
            for e in listing.entries:
                if len(out.entries) >= self.total:
                    out.hit_limit = True
                    return out
                path = f"{prefix}/{e.text}" if prefix else e.text
                if e.kind in DIRECTORIES:
                    try:
                        target = self.resolve(e).block
                    except Unreadable:
                        target = self.root
                    if target not in visited:
                        visited.add(target)
                        stack.append((path, target))
                out.entries.append((path, e))
        return out

    def path_of(self, entry: Entry) -> str:
        """The path by the parents that headers name, as far as they can be followed."""
        parts, seen, up = [entry.text], {entry.block}, entry.parent
        while up and up != self.root and up not in seen and self.inside(up):
            seen.add(up)
            found = self.any_entry(up)
            if found is None:
                break
            parts.append(found.text)
            up = found.parent
        return "/".join(reversed(parts))

    def modes(self) -> list[bool]:
        """Hash functions under which names may be filed: both where no boot block tells."""
        return [True, False] if self.flags is None else [self.international]

    def same_name(self, a: bytes, b: bytes) -> bool:
        return fold(a, self.international) == fold(b, self.international)

    def reached(self, block: int, name: bytes) -> Entry | None:
        """The entry that opening by name finds in a directory: by its slot alone, up to the first block that can't be followed."""
        for mode in self.modes():
            found, _, _ = self.chain(self.table(block)[name_hash(name, self.slots, mode)])
            for e in found:
                if self.same_name(e.name, name):
                    return e
        return None

    def lookup(self, path: str) -> tuple[Entry | None, list[str]]:
        """The entry at a path, and the components that only a walk of the whole directory found. The empty path is the root (None)."""
        now, found, walked = self.root, None, []
        for part in path.split("/"):
            if part in ("", "."):
                continue
            try:
                name = part.encode("latin-1")
            except UnicodeEncodeError:
                raise Unreadable("not found", now, part) from None
            listing = self.list(now)
            found = self.reached(now, name)
            if found is None:
                found = next((e for e in listing.entries if self.same_name(e.name, name)), None)
                if found is None:
                    raise Unreadable("not found", now, part)
                walked.append(part)
            now = found.real_entry if found.kind == "directory link" else found.block
        return found, walked

    def placements(self, block: int) -> dict[int, tuple[Entry, list[int]]]:
        """Entries that a directory's chains reach, each with the slots that reach it."""
        out: dict[int, tuple[Entry, list[int]]] = {}
        for slot, first in enumerate(self.table(block)):
            for e in self.chain(first)[0]:
                out.setdefault(e.block, (e, []))[1].append(slot)
        return out

    def misplaced(self, block: int) -> list[tuple[Entry, int, int, bool]]:
        """Entries in no slot that their name hashes to: entry, slot, expected slot, whether the other hash function's slot reaches it."""
        out = []
        for e, slots in self.placements(block).values():
            of = {mode: name_hash(e.name, self.slots, mode) for mode in (True, False)}
            if e.kind != "root" and not any(of[mode] in slots for mode in self.modes()):
                out.append((e, slots[0], of[self.international], of[not self.international] in slots))
        return out

    def slots_of_root(self, block: int) -> list[int]:
        return self.placements(block).get(self.root, (None, []))[1]

    def duplicates(self, block: int) -> list[tuple[bytes, list[int], int | None]]:
        """Names that several entries of a directory share: name, blocks, the block that opening by name finds."""
        groups: dict[bytes, list[Entry]] = {}
        for e in self.list(block).entries:
            if e.kind != "root":
                groups.setdefault(fold(e.name, self.international), []).append(e)
        out = []
        for same in groups.values():
            if len(same) > 1:
                found = self.reached(block, same[0].name)
                out.append((same[0].name, [e.block for e in same], found.block if found else None))
        return out

    # Files

    def pointers(self, block: int) -> list[int]:
        """Data blocks that a header or list block names, in the file's order: the table is filled from its end."""
        used = min(self.word(block, 2), self.slots)
        return self.table(block)[::-1][:used]

    def file_table(self, entry: Entry) -> list[tuple[int, bool]]:
        """(block, whether it holds data) of a file's blocks after its header, as far as its list blocks go; out-of-range pointers are passed over."""
        out, at, seen = [], entry.block, {entry.block}
        while True:
            out += [(p, True) for p in self.pointers(at) if p and self.inside(p)]
            if len(out) >= self.total:
                return out[: self.total]
            at = self.word(at, -2)
            if not at or at in seen or not self.inside(at) or self.word(at, 0) != LIST:
                return out
            seen.add(at)
            out.append((at, False))

    def block_faults(self, block: int, nth: int, owner: int, payload: int) -> list[str]:
        """What is wrong with a data block of the older file system."""
        w = self.words[block]
        if not w.any():
            return ["zeroed"]
        if w[0] != DATA:
            return ["not-a-data-block"]
        found = [("wrong-owner", int(w[1]) != owner), ("out-of-sequence", int(w[2]) != nth), ("oversized-payload", int(w[3]) > payload)]
        return [code for code, wrong in found if wrong]

    def examined(self, entry: Entry) -> tuple[list[int], Contents | Unreadable]:
        """A file's blocks after its header, and its contents or why they can't be read. Where something is kept, the contents are without their bytes."""
        if self.kept is not None and entry.block in self.kept.files:
            return self.kept.files[entry.block]
        blocks = [b for b, _ in self.file_table(entry)]
        try:
            found = self.read(entry)
        except Unreadable as x:
            return blocks, x
        if self.kept is not None and entry.kind == "file" and not found.exceeded and len(blocks) < self.total:
            self.kept.keep(entry.block, blocks, found.measured())
        return blocks, found

    def read(self, entry: Entry) -> Contents:
        """A file's bytes, cut to its declared size; faults of data blocks are gathered by kind."""
        if entry.kind not in FILES:
            raise Unreadable("not a directory", entry.block, "not a file")
        entry = self.resolve(entry)
        if entry.kind not in FILES:
            raise Unreadable("broken link", entry.block, "the link names no file")
        payload = self.size - PAYLOAD_AT if self.older else self.size
        most, parts, got, nth = self.total * self.size, [], 0, 0
        faults: dict[str, list[int]] = {}
        at, seen, exceeded = entry.block, {entry.block}, False
        while True:
            for p in self.pointers(at):
                if not p:
                    continue
                if not self.inside(p):
                    raise Unreadable("malformed", at, f"data pointer outside the volume: {p}")
                nth += 1
                start, n = p * self.size, self.size
                if self.older:
                    for code in self.block_faults(p, nth, entry.block, payload):
                        faults.setdefault(code, [p, nth, 0])[2] += 1
                    start, n = start + PAYLOAD_AT, min(self.word(p, 3), payload)
                parts.append(self.data[start : start + n])
                got += n
                if got >= entry.size:
                    break
                if got >= most:
                    exceeded = True
                    break
            at = self.word(at, -2)
            if not at:
                break
            if at in seen:
                raise Unreadable("cycle", at, "the file's extension chain loops")
            if not self.inside(at):
                raise Unreadable("malformed", at, "extension pointer outside the volume")
            if self.word(at, 0) != LIST:
                raise Unreadable("malformed", at, "not a list block")
            seen.add(at)
        data = b"".join(bytes(x) for x in parts)[: entry.size]
        return Contents(data, entry.size, [(code, *v) for code, v in faults.items()], exceeded)

    # Bitmap

    def bitmap(self) -> Bitmap:
        per_page = (self.size // 4 - 1) * 32
        root = self.words[self.root]
        pages = [int(p) for p in root[-49 : -49 + ROOT_PAGES] if p]
        extensions, bad, at = [], [], int(root[-24])
        while at and at not in extensions:
            if not self.inside(at):
                bad.append(at)
                break
            extensions.append(at)
            pages += [int(p) for p in self.words[at, :-1] if p]
            at = self.word(at, -1)
        there = [p for p in pages if self.inside(p)]
        allocated = np.zeros(self.total, bool)
        if there:
            # A set bit is a free block, the lowest bit of a long comes first.
            little = np.ascontiguousarray(self.words[there, 1:].astype("<u4"))
            used = ~np.unpackbits(little.view(np.uint8), bitorder="little").astype(bool)
            n = min(len(used), max(0, self.total - self.reserved))
            allocated[self.reserved : self.reserved + n] = used[:n]
        covered = max(0, self.total - self.reserved)
        return Bitmap(allocated, pages, extensions, [p for p in there if not self.sums_to_zero(p)], [p for p in pages if not self.inside(p)] + bad, covered, len(there) * per_page < covered)

    # Directory caches

    def cache_start(self, block: int) -> int:
        return self.word(block, -2)

    def cache(self, block: int) -> tuple[list[int], list[Record], list[Fault]]:
        """A directory's cache: its blocks, their records, and the fault that ends the chain."""
        blocks, records, at = [], [], self.cache_start(block)
        while at:
            if not self.inside(at):
                return blocks, records, [Fault("malformed", at, "directory cache pointer is outside the volume")]
            if at in blocks:
                return blocks, records, [Fault("cycle", at, "the directory cache's chain loops")]
            if self.word(at, 0) != CACHE:
                return blocks, records, [Fault("malformed", at, "not a directory cache block")]
            blocks.append(at)
            records += cache_records(self.raw(at), self.word(at, 3))
            at = self.word(at, 4)
        return blocks, records, []


class NotMounted(Exception):
    pass


def cache_records(raw: bytes, declared: int) -> list[Record]:
    """Records of a cache block: header, size, protection, owner, stamp, type, counted name and comment, padded to even places; up to the first that doesn't fit."""
    out, at = [], 24
    while len(out) < declared and at + 25 <= len(raw):
        name_end = at + 24 + raw[at + 23]
        if not 0 < raw[at + 23] <= 30 or name_end >= len(raw):
            break
        end = name_end + 1 + raw[name_end]
        if raw[name_end] > 79 or end > len(raw):
            break
        stamp = tuple(max(0, int.from_bytes(raw[at + k : at + k + 2], "big", signed=True)) for k in (16, 18, 20))
        numbers = [int.from_bytes(raw[at + k : at + k + 4], "big") for k in (0, 4, 8)]
        out.append(Record(*numbers, int.from_bytes(raw[at + 22 : at + 23], "big", signed=True), stamp, raw[at + 24 : name_end], raw[name_end + 1 : end]))
        at = end + end % 2
    return out


def compare_cache(records: list[Record], entries: list[Entry]) -> list[tuple[int, str, str]]:
    """Where a cache and its directory differ: block, what (not-in-directory, not-in-cache or a field), and words for it."""
    live, told = {e.block: e for e in entries}, {r.header for r in records}
    out = []
    for r in records:
        e = live.get(r.header)
        if e is None:
            out.append((r.header, "not-in-directory", f"the cache lists {r.name.decode('latin-1')}, which the directory lacks"))
            continue
        pairs = [("name", r.name, e.name), ("size", r.size, e.size), ("secondary type", r.secondary, SECONDARY[e.kind]), ("protection", r.protection, e.protection), ("comment", r.comment, e.comment)]
        out += [(e.block, what, f"the cache says {what} is {a!r}, the entry says {b!r}") for what, a, b in pairs if a != b]
    return out + [(e.block, "not-in-cache", f"the directory holds {e.text}, which the cache omits") for e in entries if e.block not in told]


def protection_text(bits: int) -> str:
    """hsparwed; the low four bits forbid where they are set."""
    return "".join(c if (bits >> 7 - i & 1) != (i >= 4) else "-" for i, c in enumerate("hsparwed"))


def is_fill(raw: bytes) -> bool:
    """Whether a block of 512 bytes is what formatting leaves: each of 64 longs twice, three letters and a counter that rises by two."""
    if len(raw) != 512 or raw[0] != ord("D") or raw[1] & 0xCF != ord("O") or raw[2] not in (0x53, 0x57, 0x5B) or raw[3] not in (1, 129):
        return False
    return raw == b"".join(bytes([*raw[:3], (raw[3] + 2 * i) & 255]) * 2 for i in range(64))
