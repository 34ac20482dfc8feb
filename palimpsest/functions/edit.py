"""Changes of a volume: every block is planned before one is written, and a refusal leaves the image as it was.

An Editor keeps, for each change, the blocks as they were, so changes can be undone and redone. After a change the
health rules run again, and one that brings more findings of a warning or worse is taken back.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np

from palimpsest.functions import health
from palimpsest.functions.image import Blocks, boot_sum, carve, graded, Image
from palimpsest.functions.volume import CACHE, DATA, HEADER, LIST, PAYLOAD_AT, SECONDARY, Entry, Kept, Unreadable, Volume, checksum, fold, name_hash

#: Letters of a name and a comment, words of the root block.
NAME, COMMENT = 30, 79
UNDO_BYTES = 64 << 20


class Refused(Exception):
    """A change that isn't made, and why."""


def check_name(name: bytes, most: int = NAME) -> None:
    if not 0 < len(name) <= most or any(c < 32 or c in b":/" for c in name):
        raise Refused(f"not a name: {name!r}")


def latin(name: str) -> bytes:
    try:
        return name.encode("latin-1")
    except UnicodeEncodeError:
        raise Refused(f"{name} has letters that names can't have") from None


class Plan:
    """Blocks as they will be; each is copied when it is first asked for."""

    def __init__(self, v: Volume):
        self.v, self.changed = v, {}
        m = v.bitmap()
        self.used, self.pages = m.allocated.copy(), [p for p in m.pages if v.inside(p)]

    def words(self, block: int, clear: bool = False) -> np.ndarray:
        if block not in self.changed:
            self.changed[block] = self.v.words[block].copy()
        if clear:
            self.changed[block][:] = 0
        return self.changed[block]

    def put(self, block: int, at: int, most: int, text: bytes) -> None:
        """Counted bytes that begin `at` bytes before the block's end."""
        raw = self.words(block).view(np.uint8)
        start = len(raw) - at
        raw[start : start + most + 1] = 0
        raw[start] = len(text)
        raw[start + 1 : start + 1 + len(text)] = np.frombuffer(text, np.uint8)

    def seal(self, block: int, at: int = 5) -> None:
        w = self.words(block)
        w[at] = checksum(w, at)

    def take(self, n: int) -> list[int]:
        """Free blocks from the root block upward, then from the volume's beginning."""
        v = self.v
        free = np.flatnonzero(~self.used)
        free = free[free >= v.reserved]
        order = np.concatenate([free[free > v.root], free[free <= v.root]])[:n]
        if len(order) < n:
            raise Refused(f"{n} blocks are needed, {len(order)} are free")
        self.used[order] = True
        return order.tolist()

    def free(self, blocks) -> None:
        self.used[list(blocks)] = False

    def write_bitmap(self) -> None:
        v = self.v
        per_page = (v.size // 4 - 1) * 32
        for i, page in enumerate(self.pages):
            flags = np.ones(per_page, np.uint8)
            part = self.used[v.reserved + i * per_page : v.reserved + (i + 1) * per_page]
            flags[: len(part)] = ~part
            w = self.words(page)
            w[1:] = np.packbits(flags, bitorder="little").view("<u4")
            self.seal(page, 0)

    def header(self, block: int, kind: str, name: bytes, parent: int, stamp, size: int = 0, protection: int = 0, comment: bytes = b"") -> np.ndarray:
        w = self.words(block, clear=True)
        w[0], w[1], w[-1], w[-3], w[-47], w[-48] = HEADER, block, SECONDARY[kind] & 0xFFFFFFFF, parent, size, protection
        w[-23:-20] = stamp
        self.put(block, 80, NAME, name)
        self.put(block, 184, COMMENT, comment)
        return w

    def link(self, parent: int, block: int, name: bytes) -> None:
        """Files a block at the end of its name's chain."""
        v = self.v
        slot = 6 + name_hash(name, v.slots, v.international)
        at, w = int(self.words(parent)[slot]), self.words(parent)
        if not at:
            w[slot] = block
            self.seal(parent)
            return
        while nxt := int(self.words(at)[-4]):
            at = nxt
        self.words(at)[-4] = block
        self.seal(at)

    def unlink(self, parent: int, block: int) -> None:
        """Takes a block out of whatever chain of the directory holds it."""
        after = int(self.words(block)[-4])
        for slot in range(6, 6 + self.v.slots):
            at, before = int(self.words(parent)[slot]), None
            while at:
                if at == block:
                    w = self.words(parent if before is None else before)
                    w[slot if before is None else -4] = after
                    self.seal(parent if before is None else before)
                    self.words(block)[-4] = 0
                    return
                before, at = at, int(self.words(at)[-4])
        raise Refused(f"block {block} is in no chain of its directory")

    def blocks(self) -> dict[int, bytes]:
        return {b: w.tobytes() for b, w in self.changed.items() if not np.array_equal(w, self.v.words[b])}


@dataclass
class Change:
    what: str
    blocks: dict[int, bytes]  # as they were


class Editor:
    """stamp: days since 1978, minutes and ticks that changed entries get."""

    def __init__(self, data: bytes, block_size: int = 512, reserved: int = 2, stamp: tuple[int, int, int] = (1, 0, 0), judged: bool = True):
        self.size, self.reserved, self.stamp, self.judged = block_size, reserved, stamp, judged
        self.data, self.done, self.undone = bytearray(data), [], []
        self._report, self._kept = None, Kept()

    @property
    def volume(self) -> Volume:
        return Volume(bytes(self.data), self.size, self.reserved)

    @property
    def _now(self) -> Volume:
        """The volume over the data themselves, nothing copied: for use up to the next change. What no change touched isn't read again."""
        v = Volume(self.data, self.size, self.reserved)
        self._kept.fit(v.slots)
        v.kept = self._kept
        return v

    @property
    def report(self) -> health.Report:
        """The health of the volume as it is; examined once between two changes."""
        if self._report is None:
            self._report = health.examine(self._now)
        return self._report

    def _swap(self, blocks: dict[int, bytes]) -> dict[int, bytes]:
        was, self._report = {}, None
        self._kept.drop(blocks)
        for b, raw in blocks.items():
            at = slice(b * self.size, (b + 1) * self.size)
            was[b], self.data[at] = bytes(self.data[at]), raw
        return was

    def commit(self, what: str, plan: Plan, allowed: set[str] = frozenset({"free-blocks-hold-data"}), caches: bool = True) -> None:
        """Writes a plan; takes it back and refuses where the volume has more findings of a warning or worse than before."""
        plan.write_bitmap()
        before = Counter(f.code for f in self.report.findings) if self.judged else None
        change = Change(what, self._swap(plan.blocks()))
        if caches and self._now.cached:
            change.blocks = self._rebuild_caches(change.blocks)
        if before is not None:
            after = Counter(f.code for f in self.report.findings if f.severity != "info" and f.code not in allowed)
            if worse := {c for c, n in after.items() if n > before[c]}:
                self._swap(change.blocks)
                raise Refused(f"{what} would bring {', '.join(sorted(worse))}")
        self.done.append(change)
        self.undone.clear()
        while len(self.done) > 1 and sum(len(c.blocks) for c in self.done) * self.size > UNDO_BYTES:
            self.done.pop(0)

    def _rebuild_caches(self, was: dict[int, bytes]) -> dict[int, bytes]:
        """Writes the directory caches anew, in one block or more each."""
        v = self._now
        plan = Plan(v)
        for block in [v.root, *[e.block for _, e in v.walk().entries if e.kind == "directory"]]:
            old = v.cache(block)[0]
            parts, now = [[]], 24
            for e in v.list(block).entries:
                numbers = b"".join(x.to_bytes(4, "big") for x in (e.block, e.size, e.protection)) + bytes(4) + b"".join(min(x, 32767).to_bytes(2, "big") for x in e.stamp)
                row = numbers + (SECONDARY[e.kind] & 0xFF).to_bytes(1, "big") + bytes([len(e.name)]) + e.name + bytes([len(e.comment)]) + e.comment
                row += bytes(len(row) % 2)
                if now + len(row) > v.size:
                    parts.append([])
                    now = 24
                parts[-1].append(row)
                now += len(row)
            blocks = old[: len(parts)] + plan.take(max(0, len(parts) - len(old)))
            plan.free(old[len(parts) :])
            for i, (b, rows) in enumerate(zip(blocks, parts, strict=True)):
                w = plan.words(b, clear=True)
                w[0], w[1], w[2], w[3], w[4] = CACHE, b, block, len(rows), blocks[i + 1] if i + 1 < len(blocks) else 0
                raw = b"".join(rows)
                w.view(np.uint8)[24 : 24 + len(raw)] = np.frombuffer(raw, np.uint8)
                plan.seal(b)
            if int(plan.words(block)[-2]) != blocks[0]:
                plan.words(block)[-2] = blocks[0]
                plan.seal(block)
        plan.write_bitmap()
        return self._swap(plan.blocks()) | was

    def undo(self) -> str:
        if not self.done:
            raise Refused("nothing to undo")
        c = self.done.pop()
        self.undone.append(Change(c.what, self._swap(c.blocks)))
        return c.what

    def redo(self) -> str:
        if not self.undone:
            raise Refused("nothing to redo")
        c = self.undone.pop()
        self.done.append(Change(c.what, self._swap(c.blocks)))
        return c.what

    # Finding what a path names

    def _found(self, path: str) -> Entry:
        try:
            found, _ = self._now.lookup(path)
        except Unreadable as e:
            raise Refused(e.fault.detail) from None
        if found is None:
            raise Refused("the root itself can't be changed so")
        return found

    def _directory(self, path: str) -> int:
        v = self._now
        if not path.strip("/"):
            return v.root
        e = self._found(path)
        if e.kind not in ("directory", "directory link"):
            raise Refused(f"{path} is no directory")
        return v.resolve(e).block

    def _free_name(self, parent: int, name: bytes, but: int | None = None) -> None:
        check_name(name)
        v = self._now
        if any(fold(e.name, v.international) == fold(name, v.international) and e.block != but for e in v.list(parent).entries):
            raise Refused(f"{name.decode('latin-1')} is there already")

    def _guard(self) -> Plan:
        """A volume whose bitmap marks live blocks free takes only repair and format."""
        if self.judged and self.report.at_risk:
            raise Refused("the bitmap marks blocks in use as free; repair it first")
        return Plan(self._now)

    # Changes

    def make_dir(self, path: str) -> int:
        folder, _, name = path.strip("/").rpartition("/")
        parent, name = self._directory(folder), latin(name)
        self._free_name(parent, name)
        plan = self._guard()
        (block,) = plan.take(1)
        plan.header(block, "directory", name, parent, self.stamp)
        plan.seal(block)
        plan.link(parent, block, name)
        self.commit(f"mkdir {path}", plan)
        return block

    def add_file(self, path: str, data: bytes, protection: int = 0, comment: str = "") -> int:
        folder, _, name = path.strip("/").rpartition("/")
        parent, name = self._directory(folder), latin(name)
        self._free_name(parent, name)
        plan = self._guard()
        block = self._file(plan, parent, name, data, protection, latin(comment))
        self.commit(f"put {path}", plan)
        return block

    def add_files(self, files: list[tuple[str, bytes]], folder: str = "") -> list[int]:
        """Many files of one directory as one change."""
        parent, plan = self._directory(folder), self._guard()
        names = [latin(n) for n, _ in files]
        taken = {fold(e.name, plan.v.international) for e in plan.v.list(parent).entries}
        for n in names:
            check_name(n)
            if fold(n, plan.v.international) in taken:
                raise Refused(f"{n.decode('latin-1')} is there already")
            taken.add(fold(n, plan.v.international))
        out = [self._file(plan, parent, n, data) for n, (_, data) in zip(names, files, strict=True)]
        self.commit(f"put {len(files)} files", plan)
        return out

    def _file(self, plan: Plan, parent: int, name: bytes, data: bytes, protection: int = 0, note: bytes = b"") -> int:
        v = plan.v
        if len(note) > COMMENT:
            raise Refused("the comment is too long")
        payload = v.size - PAYLOAD_AT if v.older else v.size
        pieces = [data[i : i + payload] for i in range(0, len(data), payload)]
        tables = max(1, -(-len(pieces) // v.slots))
        block, *others = plan.take(tables + len(pieces))
        lists, own = others[: tables - 1], others[tables - 1 :]
        plan.header(block, "file", name, parent, self.stamp, len(data), protection, note)
        for i, (b, piece) in enumerate(zip(own, pieces, strict=True)):
            raw = np.zeros(v.size, np.uint8)
            raw[v.size - payload :][: len(piece)] = np.frombuffer(piece, np.uint8)
            w = plan.words(b, clear=True)
            w[:] = raw.view(">u4")
            if v.older:
                w[:5] = [DATA, block, i + 1, len(piece), own[i + 1] if i + 1 < len(own) else 0]
                plan.seal(b)
        for i, b in enumerate([block, *lists]):
            mine = own[i * v.slots : (i + 1) * v.slots]
            w = plan.words(b, clear=i > 0)
            if i:
                w[0], w[1], w[-3], w[-1] = LIST, b, block, SECONDARY["file"] & 0xFFFFFFFF
            w[2] = len(mine)
            w[6 : 6 + v.slots][::-1][: len(mine)] = mine
            w[-2] = lists[i] if i < len(lists) else 0
            if not i and own:
                w[4] = own[0]
            plan.seal(b)
        plan.link(parent, block, name)
        return block

    def delete(self, path: str) -> None:
        """Unlinks and frees; nothing is erased. A directory must be empty; of an object with hard links, the links have to go first."""
        e, v = self._found(path), self._now
        if e.kind == "directory" and v.list(e.block).entries:
            raise Refused(f"{path} is not empty")
        if e.kind in ("file", "directory") and e.next_link:
            raise Refused(f"{path} has hard links")
        plan = self._guard()
        plan.unlink(e.parent, e.block)
        if e.kind in ("file link", "directory link"):
            at = v.resolve(e).block
            while (nxt := int(plan.words(at)[-10])) and nxt != e.block:
                at = nxt
            plan.words(at)[-10] = e.next_link
            plan.seal(at)
        own = [e.block]
        if e.kind == "file":
            own += [b for b, _ in v.file_table(e)]
        elif e.kind == "directory" and v.cached:
            own += v.cache(e.block)[0]
        plan.free(own)
        plan.changed.pop(e.block, None)
        self.commit(f"rm {path}", plan)

    def deletion_order(self, path: str) -> list[str]:
        """A subtree's paths, what is inside a directory before it."""
        path = path.strip("/")
        inside = [p for p, _ in self._now.walk().entries if p == path or p.startswith(path + "/")]
        return sorted(inside, key=lambda p: (-p.count("/"), p))

    def delete_tree(self, path: str) -> int:
        order = self.deletion_order(path)
        for p in order:
            self.delete(p)
        return len(order)

    def rename(self, path: str, name: str) -> None:
        self.move(path, path.strip("/").rpartition("/")[0], name)

    def move(self, path: str, folder: str, name: str | None = None) -> None:
        e = self._found(path)
        parent, new = self._directory(folder), latin(name) if name is not None else e.name
        self._free_name(parent, new, e.block)
        v, up = self._now, parent
        while up != v.root:
            if up == e.block:
                raise Refused("a directory can't go into itself")
            up = v.entry(up).parent
        plan = self._guard()
        plan.unlink(e.parent, e.block)
        plan.put(e.block, 80, NAME, new)
        plan.words(e.block)[-3] = parent
        plan.words(e.block)[-23:-20] = self.stamp
        plan.seal(e.block)
        plan.link(parent, e.block, new)
        plan.seal(e.block)
        self.commit(f"mv {path}", plan)

    def make_link(self, path: str, target: str) -> int:
        """A hard link; the newest stands first in its object's chain."""
        object_, (folder, _, name) = self._found(target), path.strip("/").rpartition("/")
        v = self._now
        object_ = v.resolve(object_)
        parent, name = self._directory(folder), latin(name)
        self._free_name(parent, name)
        plan = self._guard()
        (block,) = plan.take(1)
        w = plan.header(block, f"{object_.kind} link", name, parent, self.stamp)
        w[-11], w[-10] = object_.block, object_.next_link
        plan.seal(block)
        plan.words(object_.block)[-10] = block
        plan.seal(object_.block)
        plan.link(parent, block, name)
        self.commit(f"link {path}", plan)
        return block

    def undelete(self, block: int, folder: str = "") -> None:
        """Brings a deleted file back whose every block proves itself and is still free."""
        v = self._now
        e = v.any_entry(block) if v.inside(block) else None
        if e is None or e.kind != "file":
            raise Refused(f"block {block} is no file's header")
        c = graded(Blocks(bytes(self.data), self.size, self.reserved), e)
        if c.evidence == "partial" or v.older and e.size and c.evidence != "self-evident":
            raise Refused(f"its data is {c.evidence}")
        if e.real_entry or e.next_link:
            raise Refused("a hard link is involved")
        plan = self._guard()
        own = [block, *[b for b, _ in v.file_table(e)]]
        if plan.used[own].any():
            raise Refused("a block of it is in use again")
        parent = self._directory(folder) if folder else v.root
        self._free_name(parent, e.name)
        plan.used[own] = True
        plan.words(block)[-4], plan.words(block)[-3] = 0, parent
        plan.seal(block)
        plan.link(parent, block, e.name)
        self.commit(f"undelete {block}", plan)

    def repair(self, free_orphans: bool = False) -> dict[str, list[int]]:
        """Refiles entries in wrong slots and makes the bitmap what the tree reaches; orphaned blocks stay in use unless they are to be freed."""
        v = self._now
        walk = v.walk()
        if walk.hit_limit or any(not listing.complete for _, _, listing in walk.damaged):
            raise Refused("the tree is not fully readable")
        report, plan = self.report, Plan(v)
        for block in [v.root, *[e.block for _, e in walk.entries if e.kind == "directory"]]:
            for e, *_ in v.misplaced(block):
                plan.unlink(block, e.block)
                plan.link(block, e.block, e.name)
                plan.seal(e.block)
        was = plan.used.copy()
        plan.used[report.at_risk] = True
        if free_orphans:
            plan.used[report.orphaned] = False
        if plan.words(v.root)[-50] != 0xFFFFFFFF or not v.sums_to_zero(v.root):
            plan.words(v.root)[-50] = 0xFFFFFFFF
            plan.seal(v.root)
        self.commit("repair", plan)
        return {"now_used": np.flatnonzero(plan.used & ~was).tolist(), "now_free": np.flatnonzero(was & ~plan.used).tolist()}

    def wipe(self, slack: bool = True, free: bool = True) -> int:
        """Zeros the rest of files' last blocks and free blocks; returns how many blocks changed."""
        plan = self._guard()
        v = plan.v
        if free:
            for b in np.flatnonzero(~plan.used & v.words.any(axis=1)).tolist():
                if b >= v.reserved:
                    plan.words(b, clear=True)
        if slack:
            for _, e in v.walk().entries:
                own = [b for b, data in v.file_table(e) if data] if e.kind == "file" else []
                payload = v.size - PAYLOAD_AT if v.older else v.size
                if own and e.size and len(own) == -(-e.size // payload):
                    raw = plan.words(own[-1]).view(np.uint8)
                    raw[v.size - payload + (e.size - 1) % payload + 1 :] = 0
                    if v.older:
                        plan.seal(own[-1])
        n = len(plan.blocks())
        self.commit("wipe", plan)
        return n


# New volumes and devices


def blank(blocks: int = 1760, name: str = "Empty", flags: int = 0, block_size: int = 512, reserved: int = 2, stamp: tuple[int, int, int] = (1, 0, 0), boot: bool = False) -> bytes:
    """A formatted volume without entries; bitmap pages stand behind the root block, over more than 25 in extension blocks."""
    check_name(latin(name))
    if blocks < 16 or not 0 <= flags < 256:
        raise Refused("no such volume")
    words = np.zeros((blocks, block_size // 4), ">u4")
    words[0, 0] = int.from_bytes(b"DOS" + bytes([flags]), "big")
    root, per_page = (reserved + blocks - 1) // 2, (block_size // 4 - 1) * 32
    pages = list(range(root + 1, root + 1 + -(-(blocks - reserved) // per_page)))
    each = block_size // 4 - 1
    extensions = list(range(pages[-1] + 1, pages[-1] + 1 + -(-max(0, len(pages) - 25) // each)))
    used = [root, *pages, *extensions]
    r = words[root]
    r[0], r[3], r[-50], r[-1] = HEADER, block_size // 4 - 56, 0xFFFFFFFF, 1
    r[-49 : -49 + min(25, len(pages))] = pages[:25]
    for i, b in enumerate(extensions):
        part = pages[25 + i * each : 25 + (i + 1) * each]
        words[b, : len(part)] = part
        words[b, -1] = extensions[i + 1] if i + 1 < len(extensions) else 0
    if extensions:
        r[-24] = extensions[0]
    for at in (-23, -10, -7):
        r[at : at + 3] = stamp
    raw = r.view(np.uint8)
    raw[-80], raw[-79 : -79 + len(name)] = len(name), np.frombuffer(latin(name), np.uint8)
    if flags in (4, 5):
        cache = used[-1] + 1
        used.append(cache)
        words[cache, :3] = [CACHE, cache, root]
        words[cache, 5] = checksum(words[cache], 5)
        r[-2] = cache
    r[5] = checksum(r, 5)
    taken = np.zeros(len(pages) * per_page, np.uint8)
    taken[[b - reserved for b in used]] = 1
    bits = np.packbits(1 - taken, bitorder="little").view("<u4").reshape(len(pages), -1)
    for page, row in zip(pages, bits, strict=True):
        words[page, 1:] = row
        words[page, 0] = checksum(words[page], 0)
    out = bytearray(words.tobytes())
    if boot:
        out[4:8] = boot_sum(bytes(out)).to_bytes(4, "big")
    return bytes(out)


@dataclass
class Spec:
    """A partition to make: name, cylinders, file system flags, whether it boots."""

    name: str
    cylinders: int
    flags: int = 1
    bootable: bool = False

    @classmethod
    def parse(cls, text: str) -> Spec:
        """name:cylinders[:flags][:boot]"""
        parts = text.split(":")
        try:
            return cls(parts[0], int(parts[1]), *[int(x) for x in parts[2:3] if x != "boot"], bootable="boot" in parts[2:])
        except (IndexError, ValueError):
            raise Refused(f"not a partition: {text}") from None


def device(specs: list[Spec], heads: int = 2, sectors: int = 11, reserved_cylinders: int = 2, spare: int = 0) -> bytes:
    """A device with its partitions, each with an empty volume."""
    low, each = reserved_cylinders, heads * sectors
    total = low + sum(s.cylinders for s in specs) + spare
    out = bytearray(total * each * 512)
    entries = []
    for s in specs:
        entries.append((s, low, low + s.cylinders - 1))
        volume = blank(s.cylinders * each, s.name, s.flags)
        out[low * each * 512 : low * each * 512 + len(volume)] = volume
        low += s.cylinders
    write_table(out, entries, total, heads, sectors)
    return bytes(out)


def write_table(out: bytearray, entries: list[tuple[Spec, int, int]], cylinders: int, heads: int, sectors: int) -> None:
    end = 0xFFFFFFFF
    rdb = np.zeros(64, ">u4")
    rdb[0], rdb[1], rdb[3], rdb[4] = int.from_bytes(b"RDSK", "big"), 64, 7, 512
    rdb[6:13] = end
    rdb[7] = 1 if entries else end
    rdb[16], rdb[17], rdb[18], rdb[32], rdb[34], rdb[35] = cylinders, sectors, heads, 0, 2, cylinders - 1
    rdb[2] = checksum(rdb, 2)
    out[:256] = rdb.tobytes()
    for i, (s, low, high) in enumerate(entries):
        check_name(latin(s.name))
        p = np.zeros(64, ">u4")
        p[0], p[1], p[3], p[4], p[5] = int.from_bytes(b"PART", "big"), 64, 7, i + 2 if i + 1 < len(entries) else end, int(s.bootable)
        raw = p.view(np.uint8)
        raw[36], raw[37 : 37 + len(s.name)] = len(s.name), np.frombuffer(latin(s.name), np.uint8)
        p[32], p[33], p[35], p[36], p[37], p[38], p[41], p[42] = 16, 128, heads, 1, sectors, 2, low, high
        p[48] = int.from_bytes(b"DOS" + bytes([s.flags]), "big")
        p[2] = checksum(p, 2)
        out[(i + 1) * 512 : (i + 1) * 512 + 256] = p.tobytes()
    for i in range(len(entries), 14):
        out[(i + 1) * 512 : (i + 2) * 512] = bytes(512)


def _table(data: bytes) -> tuple[Image, list[tuple[Spec, int, int]]]:
    image = Image.open(data)
    if image.device is None:
        raise Refused("not a device")
    return image, [(Spec(p.name, p.high - p.low + 1, p.dostype[3], p.bootable), p.low, p.high) for p in image.partitions]


def _rewritten(data: bytes, entries) -> bytes:
    image, _ = _table(data)
    out, d = bytearray(data), image.device
    write_table(out, entries, d["cylinders"], d["heads"], d["sectors"])
    return bytes(out)


def _pick(entries, name: str) -> int:
    found = [i for i, (s, _, _) in enumerate(entries) if s.name.lower() == name.lower()]
    if not found:
        raise Refused(f"no partition {name}")
    return found[0]


def partition_rename(data: bytes, name: str, new: str) -> bytes:
    _, entries = _table(data)
    i = _pick(entries, name)
    if any(s.name.lower() == new.lower() for j, (s, _, _) in enumerate(entries) if j != i):
        raise Refused(f"{new} is there already")
    entries[i][0].name = new
    return _rewritten(data, entries)


def partition_boot(data: bytes, name: str, bootable: bool = True) -> bytes:
    _, entries = _table(data)
    entries[_pick(entries, name)][0].bootable = bootable
    return _rewritten(data, entries)


def partition_delete(data: bytes, name: str) -> bytes:
    _, entries = _table(data)
    entries.pop(_pick(entries, name))
    return _rewritten(data, entries)


def partition_add(data: bytes, spec: Spec) -> bytes:
    """A partition in the first gap between the others that is wide enough."""
    image, entries = _table(data)
    if any(s.name.lower() == spec.name.lower() for s, _, _ in entries):
        raise Refused(f"{spec.name} is there already")
    taken = sorted((low, high) for _, low, high in entries)
    starts = [2, *[high + 1 for _, high in taken]]
    ends = [*[low for low, _ in taken], image.device["cylinders"]]
    at = next((a for a, b in zip(starts, ends, strict=True) if b - a >= spec.cylinders), None)
    if at is None:
        raise Refused("no gap is wide enough")
    entries = sorted([*entries, (spec, at, at + spec.cylinders - 1)], key=lambda e: e[1])
    out = bytearray(_rewritten(data, entries))
    each = image.device["heads"] * image.device["sectors"] * 512
    volume = blank(spec.cylinders * each // 512, spec.name, spec.flags)
    out[at * each : at * each + len(volume)] = volume
    return bytes(out)


def partition_grow(data: bytes, name: str, cylinders: int) -> bytes:
    """More cylinders at a partition's end: its root block moves to the new middle, which must be free, and the bitmap is made anew."""
    image, entries = _table(data)
    i = _pick(entries, name)
    s, low, high = entries[i]
    d, new_high = image.device, high + cylinders
    if new_high >= d["cylinders"] or any(low < other <= new_high for j, (_, other, _) in enumerate(entries) if j != i):
        raise Refused("no room behind it")
    each = d["heads"] * d["sectors"] * 512
    old = Volume(data[low * each : (high + 1) * each])
    report = health.examine(old)
    if report.worst not in (None, "info"):
        raise Refused("the volume isn't sound")
    grown = (new_high - low + 1) * each // 512
    root = (2 + grown - 1) // 2
    m = old.bitmap()
    keep = m.allocated.copy()
    keep[[old.root, *m.pages, *m.extensions]] = False
    body = bytearray(data[low * each : (high + 1) * each] + bytes(grown * 512 - (high + 1 - low) * each))
    fresh = blank(grown, "x", s.flags)
    new = Volume(fresh)
    n = new.bitmap()
    places = [root, *n.pages, *n.extensions]
    if any(b < old.total and keep[b] for b in places):
        raise Refused("the new middle is in use")
    for b in [old.root, *m.pages, *m.extensions]:
        body[b * 512 : (b + 1) * 512] = bytes(512)
    for b in places:
        body[b * 512 : (b + 1) * 512] = new.raw(b)
    plan = Plan(Volume(bytes(body)))
    w, was = plan.words(root), old.words[old.root]
    w[6 : 6 + old.slots], w[-23:] = was[6 : 6 + old.slots], was[-23:]
    plan.seal(root)
    plan.used[: old.total] |= keep
    for _, e in old.walk().entries:
        if e.parent == old.root:
            plan.words(e.block)[-3] = root
            plan.seal(e.block)
    plan.write_bitmap()
    for b, raw in plan.blocks().items():
        body[b * 512 : (b + 1) * 512] = raw
    entries[i] = (Spec(s.name, new_high - low + 1, s.flags, s.bootable), low, new_high)
    out = bytearray(_rewritten(data, entries))
    out[low * each : low * each + len(body)] = body
    return bytes(out)


def recoverable(data: bytes) -> list[int]:
    return [c.entry.block for c in carve(Image.open(data)) if c.recoverable]
