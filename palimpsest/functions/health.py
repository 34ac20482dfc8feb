"""The health of a volume as findings: rules over what a walk, the files, the caches and the bitmap give.

A rule yields (code, severity, block, message). Lists of many like findings are cut to MOST with one more that counts
the rest, as a report wants them; the summary's numbers cover all.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np

from palimpsest.functions.volume import DATA, DIRECTORIES, FILES, HEADER, LINKS, LIST, CACHE, Unreadable, Volume, compare_cache, is_fill

MOST = 20
SEVERITIES = ["info", "warning", "error"]
#: Severity by code (fixed values).
SEVERITY = {
    "bitmap-checksum": "warning", "bitmap-flag-clear": "warning", "bitmap-incomplete": "warning", "bitmap-pointer-invalid": "warning", "container-unsupported": "info",
    "cross-linked-block": "error", "data-block-structure": "warning", "datestamp-day-zero": "info", "datestamp-minutes-range": "info", "datestamp-ticks-range": "info",
    "dircache-chain-broken": "error", "dircache-disagrees": "warning", "directory-damaged": "warning", "dostype-unknown-bits": "warning", "duplicate-name": "warning",
    "entry-checksum": "warning", "entry-wrong-parent": "warning", "entry-wrong-slot": "warning", "file-exceeds-volume": "error", "file-short": "warning", "file-unreadable": "error",
    "free-blocks-hold-data": "warning", "free-blocks-hold-deleted-files": "info", "image-truncated": "error", "link-chain-broken": "warning", "link-target-missing": "warning",
    "lnfs-unsupported": "warning", "name-length-overflow": "warning", "no-partition-table": "error", "no-such-partition": "error", "no-volume": "info", "orphaned-blocks": "warning",
    "partition-out-of-range": "error", "partition-table-broken": "error", "referenced-but-free": "error", "root-in-hash-table": "info", "rootblock-checksum": "error",
    "tree-unreadable": "error", "volume-reconstructed": "info", "walk-capped": "error",
}


@dataclass(frozen=True)
class Finding:
    code: str
    block: int | None
    message: str

    @property
    def severity(self) -> str:
        return SEVERITY[self.code]


@dataclass
class Report:
    findings: list[Finding]
    kind: str
    directories: int = 0
    files: int = 0
    bytes_recovered: int = 0
    marked_used: int = 0
    actually_used: int = 0
    covered: int = 0
    at_risk: list[int] = field(default_factory=list)
    orphaned: list[int] = field(default_factory=list)
    holding: list[int] = field(default_factory=list)
    cache: dict | None = None
    referenced: set[int] = field(default_factory=set)

    @property
    def worst(self) -> str | None:
        return max((f.severity for f in self.findings), key=SEVERITIES.index, default=None)

    @property
    def sound(self) -> bool:
        return self.worst in (None, "info")

    def counts(self) -> dict[str, int]:
        return {s: sum(f.severity == s for f in self.findings) for s in SEVERITIES}


def shown(blocks: list[int], most: int = 6) -> str:
    head = ", ".join(map(str, blocks[:most]))
    return f"{head}, and {len(blocks) - most} more" if len(blocks) > most else head


def capped(found: Iterable[Finding], rest: str) -> list[Finding]:
    found = list(found)
    if len(found) <= MOST:
        return found
    return found[:MOST] + [Finding(found[0].code, None, f"{len(found) - MOST} {rest}")]


def prelude(v: Volume) -> Iterator[Finding]:
    """What the boot and root blocks show."""
    root = v.words[v.root]
    if v.flags is not None and v.flags > 7:
        yield Finding("dostype-unknown-bits", 0, f"file system flags {v.flags:#x}")
    if not v.sums_to_zero(v.root):
        yield Finding("rootblock-checksum", v.root, "the root block's checksum does not match")
    if int(root[-50]) != 0xFFFFFFFF:
        yield Finding("bitmap-flag-clear", v.root, "the root block flags its bitmap as not valid")
    declared = v.raw(v.root)[-80]
    if declared > 30:
        yield Finding("name-length-overflow", v.root, f"the volume's name claims {declared} letters")
    for what, at in (("root altered", -23), ("volume altered", -10), ("created", -7)):
        days, minutes, ticks = (int(x) for x in root[at : at + 3])
        for code, wrong in (("day-zero", days == 0), ("minutes-range", minutes >= 1440), ("ticks-range", ticks >= 3000)):
            if wrong:
                yield Finding(f"datestamp-{code}", v.root, f"{what}: {days} days, {minutes} minutes, {ticks} ticks")
    if v.long_names:
        yield Finding("lnfs-unsupported", None, "names of this layout are read at their classic places and are unreliable")


def damaged(walk) -> Iterator[Finding]:
    for path, block, listing in walk.damaged:
        said = [f"{len(x)} {what} (first: {x[0].detail})" for x, what in ((listing.faults, "pointers lead to no entry"), (listing.cycles, "chains loop"), (listing.merges, "chains merge")) if x]
        yield Finding("directory-damaged", block, f"{path or 'the root directory'}: {'; '.join(said)}")


def in_directories(v: Volume, walk, rule) -> Iterator[Finding]:
    """A rule (prefix, block) over the root and every directory of the tree; one that can't be read is told elsewhere."""
    for path, block in [("", v.root), *[(p, e.block) for p, e in walk.entries if e.kind == "directory"]]:
        try:
            yield from rule(path + "/" if path else "", block)
        except Unreadable:
            pass


def slots(v: Volume, prefix: str, block: int) -> Iterator[Finding]:
    for e, slot, expected, other in v.misplaced(block):
        yield Finding("entry-wrong-slot", e.block, f"{prefix}{e.text}: filed under hash slot {slot}, its name hashes to {expected}{', it fits the other hash function' if other else ''}")


def parents(v: Volume, prefix: str, block: int) -> Iterator[Finding]:
    for e in v.list(block).entries:
        if e.kind != "root" and e.parent != block:
            yield Finding("entry-wrong-parent", e.block, f"{prefix}{e.text}: listed in block {block}, its header names block {e.parent}")


def names(v: Volume, prefix: str, block: int) -> Iterator[Finding]:
    for name, blocks, found in v.duplicates(block):
        opened = f"block {found} is opened by name" if found is not None else "none can be opened by name"
        yield Finding("duplicate-name", blocks[0] if found is None else found, f"{prefix}{name.decode('latin-1')}: {len(blocks)} entries (blocks {shown(blocks)}); {opened}")


def own_root(v: Volume, prefix: str, block: int) -> Iterator[Finding]:
    if hit := v.slots_of_root(block):
        yield Finding("root-in-hash-table", block, f"slots {shown(hit)} of {prefix or 'the root'} lead to the root block")


def links(v: Volume, walk) -> Iterator[Finding]:
    """Hard links whose target is missing or of another kind, and objects whose chain of links isn't the set of links that name them."""
    live = {e.block: e for _, e in walk.entries}
    naming: dict[int, set[int]] = defaultdict(set)
    for path, e in walk.entries:
        if e.kind in ("file link", "directory link"):
            want = e.kind.split()[0]
            target = v.any_entry(e.real_entry) if v.inside(e.real_entry) else None
            if e.real_entry == v.root or target is None or target.kind != want or target.block not in live:
                yield Finding("link-target-missing", e.block, f"{path}: a hard link to block {e.real_entry}, which is no {want} of the tree")
            else:
                naming[e.real_entry].add(e.block)
    for path, e in walk.entries:
        if e.kind not in ("file", "directory"):
            continue
        chain, at, fault = set(), e.next_link, None
        while at and fault is None:
            link = v.any_entry(at) if v.inside(at) else None
            if at in chain:
                fault = f"loops at block {at}"
            elif link is None or link.kind not in LINKS or link.real_entry != e.block:
                fault = f"names block {at}, which is no link to it"
            else:
                chain.add(at)
                at = link.next_link
        if fault is None and chain != naming[e.block]:
            missing = sorted(naming[e.block] - chain)
            fault = f"leaves out {shown(missing)}" if missing else "lists a link that is not in the tree"
        if fault:
            yield Finding("link-chain-broken", e.block, f"{path}: its chain of hard links {fault}")


def files(v: Volume, walk, report: Report) -> Iterator[Finding]:
    """Every file: header, blocks that another file has, contents."""
    owner: dict[int, tuple[int, str]] = {}
    for path, e in walk.entries:
        report.referenced.add(e.block)
        if e.kind in DIRECTORIES:
            report.directories += 1
        if e.kind not in FILES:
            continue
        report.files += 1
        if not e.sound:
            yield Finding("entry-checksum", e.block, f"{path}: the header's checksum does not match")
        blocks, got = v.examined(e)
        report.referenced.update(blocks)
        for b in [e.block, *blocks]:
            first = owner.setdefault(b, (e.block, path))
            if first[0] != e.block:
                yield Finding("cross-linked-block", b, f"block shared by {first[1]} (header {first[0]}) and {path} (header {e.block})")
        if isinstance(got, Unreadable):
            yield Finding("file-unreadable", e.block, f"{path}: {got.fault.detail}")
            continue
        report.bytes_recovered += got.size
        if got.short_by:
            yield Finding("file-short", e.block, f"{path}: recovered {got.size} of {got.declared} declared bytes")
        for code, block, nth, n in got.faults:
            yield Finding("data-block-structure", block, f"{path}: {code}, {n} blocks, first at {nth}")
        if got.exceeded:
            yield Finding("file-exceeds-volume", e.block, f"{path}: reading stopped at the volume's size")


def caches(v: Volume, walk, report: Report) -> Iterator[Finding]:
    if not v.cached:
        return
    report.cache = dict.fromkeys(("directories", "blocks", "records", "disagreements"), 0)
    differ: list[Finding] = []
    for block in [v.root, *[e.block for _, e in walk.entries if e.kind == "directory"]]:
        blocks, records, faults = v.cache(block)
        report.referenced.update(blocks)
        for key, n in (("directories", bool(blocks)), ("blocks", len(blocks)), ("records", len(records))):
            report.cache[key] += n
        yield from (Finding("dircache-chain-broken", f.block, f"directory cache of block {block}: {f.detail}") for f in faults)
        try:
            found = compare_cache(records, v.list(block).entries)
        except Unreadable:
            continue
        report.cache["disagreements"] += len(found)
        differ += [Finding("dircache-disagrees", b, message) for b, _, message in found]
    yield from capped(differ, "more disagreements of directory caches")


def deleted_blocks(v: Volume, header: int) -> set[int]:
    """Blocks that a deleted file's header and its list blocks name."""
    out, at = set(), header
    while at not in out and v.inside(at) and len(out) <= v.total:
        out.add(at)
        out.update(p for p in v.pointers(at) if p)
        at = v.word(at, -2)
        if not at:
            break
    return out


def holding_data(v: Volume, used: np.ndarray) -> tuple[list[int], int]:
    """Free blocks that hold something, and how many of them a deleted file explains."""
    uniform = (v.words == v.words[:, :1]).all(axis=1)
    free = np.flatnonzero(~used & ~uniform)
    holding = [b for b in free.tolist() if b >= v.reserved and not is_fill(v.raw(b))]
    told: set[int] = set()
    for b in holding:
        if v.sums_to_zero(b):
            entry = v.any_entry(b) if v.word(b, 0) == HEADER else None
            if v.word(b, 0) in (LIST, DATA, CACHE) or entry is not None:
                told |= deleted_blocks(v, b) if entry is not None and entry.kind == "file" else {b}
    return holding, sum(b in told for b in holding)


def bitmap(v: Volume, report: Report, empty: bool) -> Iterator[Finding]:
    """The bitmap against what the tree reaches, both ways."""
    m = v.bitmap()
    yield from (Finding("bitmap-checksum", b, "a bitmap block's checksum does not match") for b in m.bad_checksums)
    if m.incomplete:
        yield Finding("bitmap-incomplete", None, "the bitmap does not cover the whole volume")
    used = report.referenced | {b for b in [*m.pages, *m.extensions] if v.inside(b)} | {v.root}
    if m.out_of_range:
        yield Finding("bitmap-pointer-invalid", v.root, f"bitmap blocks outside the volume: {shown(m.out_of_range)}")
    reach = np.zeros(v.total, bool)
    reach[[b for b in used if v.inside(b)]] = True
    report.marked_used, report.actually_used, report.covered = int(m.allocated.sum()), len(used), m.covered
    report.at_risk, report.orphaned = np.flatnonzero(reach & ~m.allocated).tolist(), np.flatnonzero(m.allocated & ~reach).tolist()
    if report.at_risk:
        yield Finding("referenced-but-free", None, f"{len(report.at_risk)} blocks are in use but marked free ({shown(report.at_risk)})")
    if report.orphaned:
        yield Finding("orphaned-blocks", None, f"{len(report.orphaned)} blocks are marked in use but unreachable ({shown(report.orphaned)})")
    if empty:
        report.holding, told = holding_data(v, m.allocated | reach)
        if report.holding:
            code = "free-blocks-hold-deleted-files" if told == len(report.holding) else "free-blocks-hold-data"
            yield Finding(code, None, f"{len(report.holding)} free blocks hold data ({shown(report.holding)}), {told} of them listed by deleted files")


def examine(v: Volume) -> Report:
    """All rules over one volume; findings by severity, the gravest first, else in the rules' order."""
    report = Report([], "files", referenced={v.root})
    found, walk = list(prelude(v)), v.walk()
    if walk.hit_limit:
        found.append(Finding("walk-capped", None, "the walk met as many entries as the volume has blocks"))
    if any(block == v.root and listing.faults and listing.faults[0].kind != "malformed" and not listing.entries for _, block, listing in walk.damaged):
        found.append(Finding("tree-unreadable", v.root, "the root directory can't be listed"))
    found += files(v, walk, report)
    found += capped(damaged(walk), "more directories are damaged")
    found += caches(v, walk, report)
    found += capped(in_directories(v, walk, lambda p, b: slots(v, p, b)), "more entries are filed under the wrong hash slot")
    found += capped(in_directories(v, walk, lambda p, b: parents(v, p, b)), "more entries name another directory than the one that lists them")
    found += capped(in_directories(v, walk, lambda p, b: names(v, p, b)), "more names are shared by several entries")
    found += in_directories(v, walk, lambda p, b: own_root(v, p, b))
    found += links(v, walk)
    empty = len(report.referenced) <= 1
    found += bitmap(v, report, empty)
    report.findings = sorted(found, key=lambda f: -SEVERITIES.index(f.severity))
    if empty:
        codes = {f.code for f in found}
        held = "free-blocks-hold-data" in codes or report.orphaned
        report.kind = "game-behind-empty-root" if held else "emptied" if "free-blocks-hold-deleted-files" in codes else "blank"
    return report


#: Damage by a finding's code, the gravest first (fixed values).
DAMAGE = ["cross-linked", "bad checksum", "damaged", "at risk", "orphaned", "free, holding data"]


def damage(report: Report) -> dict[int, str]:
    """The gravest damage of each block that a report names."""
    out: dict[int, int] = {}

    def put(block: int | None, rank: int) -> None:
        if block is not None:
            out[block] = min(rank, out.get(block, rank))

    for f in report.findings:
        if f.severity != "info":
            put(f.block, 0 if f.code == "cross-linked-block" else 1 if f.code.endswith("-checksum") else 2)
    for rank, blocks in ((3, report.at_risk), (4, report.orphaned), (5, report.holding)):
        for b in blocks:
            put(b, rank)
    return {b: DAMAGE[r] for b, r in sorted(out.items())}
