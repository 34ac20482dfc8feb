"""68000 instructions: decoding by a table of patterns, Motorola's notation, and where control goes.

A pattern is a word of 16 letters: 0 and 1 stand for themselves, other letters name fields. The first that fits and whose operands
are allowed is the instruction; what fits none is data of one word.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np

CONDITIONS = "t f hi ls cc cs ne eq vc vs pl mi ge lt gt le".split()
SIZES = "bwl"
#: Classes of operand places: data, memory, control, alterable; by mode, and for mode 7 by register.
MODES = ["Dn", "An", "(An)", "(An)+", "-(An)", "d(An)", "d(An,Xn)", "abs.w", "abs.l", "d(PC)", "d(PC,Xn)", "#"]
DATA = set(MODES) - {"An"}
MEMORY = DATA - {"Dn"}
CONTROL = {"(An)", "d(An)", "d(An,Xn)", "abs.w", "abs.l", "d(PC)", "d(PC,Xn)"}
ALTERABLE = set(MODES) - {"d(PC)", "d(PC,Xn)", "#"}
DATA_ALTERABLE, MEMORY_ALTERABLE, CONTROL_ALTERABLE = DATA & ALTERABLE, MEMORY & ALTERABLE, CONTROL & ALTERABLE


@dataclass(frozen=True)
class Instruction:
    at: int
    size: int
    name: str
    operands: str
    flow: str  # next, branch, jump, call, return, stop or data
    target: int | None  # where a branch, jump or call goes, if the instruction tells
    reads: tuple[tuple[int, str], ...] = ()  # absolute and PC-relative places it names, with their kind

    @property
    def text(self) -> str:
        return f"{self.name} {self.operands}".rstrip()


class Cut(Exception):
    """The code ends, or the word is no instruction."""


class Reader:
    def __init__(self, data: bytes, at: int):
        self.data, self.start, self.at = data, at, at
        self.places: list[tuple[int, str]] = []
        self.indexed = False  # whether an extension word told if the operand is one

    def word(self) -> int:
        if self.at + 2 > len(self.data):
            raise Cut
        self.at += 2
        return int.from_bytes(self.data[self.at - 2 : self.at], "big")

    def signed(self) -> int:
        x = self.word()
        return x - 65536 if x & 0x8000 else x

    def long(self) -> int:
        return self.word() << 16 | self.word()

    def place(self, mode: int, reg: int, size: str, allowed: set[str]) -> str:
        """An operand's text; its extension words are read."""
        index = mode if mode < 7 else 7 + reg
        if index >= len(MODES) or MODES[index] not in allowed or mode == 1 and size == "b":
            raise Cut
        kind, a = MODES[index], "sp" if reg == 7 else f"a{reg}"
        if kind in ("d(An)", "d(PC)"):
            base = self.at
            d = self.signed()
            if kind == "d(PC)":
                self.places.append((base + d, "relative"))
                return f"${base + d:x}(pc)"
            return f"{d}({a})"
        if kind in ("d(An,Xn)", "d(PC,Xn)"):
            base, self.indexed = self.at, True
            x = self.word()
            if x & 0x700:
                raise Cut
            d = (x & 255) - 256 if x & 128 else x & 255
            register = f"{'da'[x >> 15]}{x >> 12 & 7}.{'wl'[x >> 11 & 1]}"
            return f"${base + d:x}(pc,{register})" if kind == "d(PC,Xn)" else f"{d}({a},{register})"
        if kind in ("abs.w", "abs.l"):
            x = self.signed() if kind == "abs.w" else self.long()
            self.places.append((x, "absolute"))
            return f"${x & 0xFFFFFFFF:x}" + (".w" if kind == "abs.w" else "")
        if kind == "#":
            x = self.long() if size == "l" else self.word() & (255 if size == "b" else 0xFFFF)
            return f"#${x:x}"
        return {"Dn": f"d{reg}", "An": a, "(An)": f"({a})", "(An)+": f"({a})+", "-(An)": f"-({a})"}[kind]

    def immediate(self, size: str) -> str:
        return self.place(7, 4, size, {"#"})


def registers(mask: int, reverse: bool) -> str:
    """A list of registers as ranges: d0-d3/a6."""
    on = [bool(mask >> (15 - i if reverse else i) & 1) for i in range(16)]
    out = []
    for kind, part in (("d", on[:8]), ("a", on[8:])):
        i = 0
        while i < 8:
            j = i
            while j < 8 and part[j]:
                j += 1
            if j > i:
                out.append(f"{kind}{i}" + (f"-{kind}{j - 1}" if j > i + 1 else ""))
            i = max(j, i + 1)
    return "/".join(out)


Made = tuple  # name, operands, flow, target
Handler = Callable[[Reader, dict[str, int]], Made]
TABLE: list[tuple[int, int, list[tuple[str, int, int]], Handler]] = []


def pattern(bits: str):
    bits = bits.replace(" ", "")
    mask = int("".join("1" if c in "01" else "0" for c in bits), 2)
    value = int("".join(c if c in "01" else "0" for c in bits), 2)
    fields = []
    for letter in dict.fromkeys(c for c in bits if c not in "01"):
        n = bits.count(letter)
        fields.append((letter, 15 - bits.rindex(letter), (1 << n) - 1))

    def add(f: Handler) -> Handler:
        TABLE.append((mask, value, fields, f))
        return f

    return add


def size_of(f) -> str:
    if f["s"] == 3:
        raise Cut
    return SIZES[f["s"]]


def simple(bits: str, name: str, flow: str = "next"):
    pattern(bits)(lambda r, f: (name, "", flow, None))


def immediates(bits: str, name: str, allowed=DATA_ALTERABLE):
    def run(r, f):
        s = size_of(f)
        x = r.immediate(s)
        return f"{name}.{s}", f"{x},{r.place(f['m'], f['r'], s, allowed)}", "next", None

    pattern(bits)(run)


for code, status in (("0000", "ori"), ("0010", "andi"), ("1010", "eori")):
    pattern(f"0000 {code} 0011 1100")(lambda r, f, n=status: (f"{n}.b", f"{r.immediate('b')},ccr", "next", None))
    pattern(f"0000 {code} 0111 1100")(lambda r, f, n=status: (f"{n}.w", f"{r.immediate('w')},sr", "next", None))
for code, name in (("0000", "ori"), ("0010", "andi"), ("0100", "subi"), ("0110", "addi"), ("1010", "eori"), ("1100", "cmpi")):
    immediates(f"0000 {code} ssmm mrrr", name)
for code, name in (("00", "btst"), ("01", "bchg"), ("10", "bclr"), ("11", "bset")):
    own = DATA - {"#"} if name == "btst" else DATA_ALTERABLE
    pattern(f"0000 1000 {code}mm mrrr")(lambda r, f, n=name, a=own: (n, f"#{r.word() & 255},{r.place(f['m'], f['r'], 'b', a)}", "next", None))


@pattern("0000 ddd1 os00 1rrr")
def movep(r, f):
    n, d, at = f"movep.{'wl'[f['s']]}", r.signed(), f["r"]
    return (n, f"d{f['d']},{d}(a{at})", "next", None) if f["o"] else (n, f"{d}(a{at}),d{f['d']}", "next", None)


for code, name in (("00", "btst"), ("01", "bchg"), ("10", "bclr"), ("11", "bset")):
    own = DATA if name == "btst" else DATA_ALTERABLE
    pattern(f"0000 ddd1 {code}mm mrrr")(lambda r, f, n=name, a=own: (n, f"d{f['d']},{r.place(f['m'], f['r'], 'b', a)}", "next", None))


def move(size: str, address: bool):
    def run(r, f):
        source = r.place(f["m"], f["r"], size, set(MODES))
        if address:
            return f"movea.{size}", f"{source},{'sp' if f['d'] == 7 else 'a' + str(f['d'])}", "next", None
        return f"move.{size}", f"{source},{r.place(f['e'], f['d'], size, DATA_ALTERABLE)}", "next", None

    return run


for code, size in (("01", "b"), ("11", "w"), ("10", "l")):
    if size != "b":
        pattern(f"00{code} ddd0 01mm mrrr")(move(size, True))
    pattern(f"00{code} ddde eemm mrrr")(move(size, False))

pattern("0100 0000 11mm mrrr")(lambda r, f: ("move.w", f"sr,{r.place(f['m'], f['r'], 'w', DATA_ALTERABLE)}", "next", None))
pattern("0100 0100 11mm mrrr")(lambda r, f: ("move.w", f"{r.place(f['m'], f['r'], 'w', DATA)},ccr", "next", None))
pattern("0100 0110 11mm mrrr")(lambda r, f: ("move.w", f"{r.place(f['m'], f['r'], 'w', DATA)},sr", "next", None))


def unary(bits: str, name: str):
    def run(r, f):
        s = size_of(f)
        return f"{name}.{s}", r.place(f["m"], f["r"], s, DATA_ALTERABLE), "next", None

    pattern(bits)(run)


for code, name in (("0000", "negx"), ("0010", "clr"), ("0100", "neg"), ("0110", "not")):
    unary(f"0100 {code} ssmm mrrr", name)
pattern("0100 1000 0100 0rrr")(lambda r, f: ("swap", f"d{f['r']}", "next", None))
pattern("0100 1000 01mm mrrr")(lambda r, f: ("pea", r.place(f["m"], f["r"], "l", CONTROL), "next", None))
pattern("0100 1000 1s00 0rrr")(lambda r, f: (f"ext.{'wl'[f['s']]}", f"d{f['r']}", "next", None))
pattern("0100 1000 00mm mrrr")(lambda r, f: ("nbcd", r.place(f["m"], f["r"], "b", DATA_ALTERABLE), "next", None))


@pattern("0100 1000 1smm mrrr")
def movem_out(r, f):
    mask, s = r.word(), "wl"[f["s"]]
    return f"movem.{s}", f"{registers(mask, f['m'] == 4)},{r.place(f['m'], f['r'], s, CONTROL_ALTERABLE | {'-(An)'})}", "next", None


@pattern("0100 1100 1smm mrrr")
def movem_in(r, f):
    mask, s = r.word(), "wl"[f["s"]]
    return f"movem.{s}", f"{r.place(f['m'], f['r'], s, CONTROL | {'(An)+'})},{registers(mask, False)}", "next", None


simple("0100 1010 1111 1100", "illegal", "stop")
pattern("0100 1010 11mm mrrr")(lambda r, f: ("tas", r.place(f["m"], f["r"], "b", DATA_ALTERABLE), "next", None))
unary("0100 1010 ssmm mrrr", "tst")
pattern("0100 1110 0100 vvvv")(lambda r, f: ("trap", f"#{f['v']}", "next", None))
pattern("0100 1110 0101 0rrr")(lambda r, f: ("link", f"a{f['r']},#{r.signed()}", "next", None))
pattern("0100 1110 0101 1rrr")(lambda r, f: ("unlk", f"a{f['r']}", "next", None))
pattern("0100 1110 0110 0rrr")(lambda r, f: ("move.l", f"a{f['r']},usp", "next", None))
pattern("0100 1110 0110 1rrr")(lambda r, f: ("move.l", f"usp,a{f['r']}", "next", None))
simple("0100 1110 0111 0000", "reset")
simple("0100 1110 0111 0001", "nop")
pattern("0100 1110 0111 0010")(lambda r, f: ("stop", r.immediate("w"), "stop", None))
simple("0100 1110 0111 0011", "rte", "return")
simple("0100 1110 0111 0101", "rts", "return")
simple("0100 1110 0111 0110", "trapv")
simple("0100 1110 0111 0111", "rtr", "return")


def transfer(name: str, flow: str):
    def run(r, f):
        text = r.place(f["m"], f["r"], "l", CONTROL)
        kind = MODES[f["m"] if f["m"] < 7 else 7 + f["r"]]
        told = kind in ("abs.w", "abs.l", "d(PC)")
        return name, text, flow, r.places[-1][0] if told else None

    return run


pattern("0100 1110 10mm mrrr")(transfer("jsr", "call"))
pattern("0100 1110 11mm mrrr")(transfer("jmp", "jump"))
pattern("0100 ddd1 11mm mrrr")(lambda r, f: ("lea", f"{r.place(f['m'], f['r'], 'l', CONTROL)},{'sp' if f['d'] == 7 else 'a' + str(f['d'])}", "next", None))
pattern("0100 ddd1 10mm mrrr")(lambda r, f: ("chk", f"{r.place(f['m'], f['r'], 'w', DATA)},d{f['d']}", "next", None))


@pattern("0101 cccc 1100 1rrr")
def dbcc(r, f):
    base = r.at
    to = base + r.signed()
    return f"db{'ra' if f['c'] == 1 else CONDITIONS[f['c']]}", f"d{f['r']},${to:x}", "branch", to


pattern("0101 cccc 11mm mrrr")(lambda r, f: (f"s{CONDITIONS[f['c']]}", r.place(f["m"], f["r"], "b", DATA_ALTERABLE), "next", None))


@pattern("0101 dddo ssmm mrrr")
def quick(r, f):
    s = size_of(f)
    return f"{('addq', 'subq')[f['o']]}.{s}", f"#{f['d'] or 8},{r.place(f['m'], f['r'], s, ALTERABLE)}", "next", None


@pattern("0110 cccc dddddddd")
def branch(r, f):
    base, d = r.at, f["d"]
    if d == 0:
        to, s = base + r.signed(), "w"
    else:
        to, s = base + (d - 256 if d & 128 else d), "s"
    name = {0: "bra", 1: "bsr"}.get(f["c"], "b" + CONDITIONS[f["c"]])
    return f"{name}.{s}", f"${to:x}", {0: "jump", 1: "call"}.get(f["c"], "branch"), to


pattern("0111 ddd0 vvvvvvvv")(lambda r, f: ("moveq", f"#{f['v'] - 256 if f['v'] & 128 else f['v']},d{f['d']}", "next", None))


def both_ways(bits: str, name: str, special: str | None = None):
    """Two data registers, or two addresses counted down."""
    pattern(bits)(lambda r, f: (name if special else f"{name}.{size_of(f)}", f"-(a{f['r']}),-(a{f['d']})" if f["o"] else f"d{f['r']},d{f['d']}", "next", None))


def arithmetic(group: str, name: str, sources: set[str]):
    def run(r, f):
        s = size_of(f)
        if f["o"]:
            return f"{name}.{s}", f"d{f['d']},{r.place(f['m'], f['r'], s, MEMORY_ALTERABLE)}", "next", None
        return f"{name}.{s}", f"{r.place(f['m'], f['r'], s, sources)},d{f['d']}", "next", None

    pattern(f"{group} dddo ssmm mrrr")(run)


def wide(bits: str, name: str):
    pattern(bits)(lambda r, f: (name, f"{r.place(f['m'], f['r'], 'w', DATA)},d{f['d']}", "next", None))


def addresses(group: str, name: str):
    pattern(f"{group} ddds 11mm mrrr")(lambda r, f: (f"{name}.{'wl'[f['s']]}", f"{r.place(f['m'], f['r'], 'wl'[f['s']], set(MODES))},{'sp' if f['d'] == 7 else 'a' + str(f['d'])}", "next", None))


wide("1000 ddd0 11mm mrrr", "divu")
wide("1000 ddd1 11mm mrrr", "divs")
both_ways("1000 ddd1 0000 orrr", "sbcd", "b")
arithmetic("1000", "or", DATA)
addresses("1001", "suba")
both_ways("1001 ddd1 ss00 orrr", "subx")
arithmetic("1001", "sub", set(MODES))
addresses("1011", "cmpa")
pattern("1011 ddd1 ss00 1rrr")(lambda r, f: (f"cmpm.{size_of(f)}", f"(a{f['r']})+,(a{f['d']})+", "next", None))
pattern("1011 ddd1 ssmm mrrr")(lambda r, f: (f"eor.{size_of(f)}", f"d{f['d']},{r.place(f['m'], f['r'], size_of(f), DATA_ALTERABLE)}", "next", None))
pattern("1011 ddd0 ssmm mrrr")(lambda r, f: (f"cmp.{size_of(f)}", f"{r.place(f['m'], f['r'], size_of(f), set(MODES))},d{f['d']}", "next", None))
wide("1100 ddd0 11mm mrrr", "mulu")
wide("1100 ddd1 11mm mrrr", "muls")
both_ways("1100 ddd1 0000 orrr", "abcd", "b")
pattern("1100 ddd1 0100 0rrr")(lambda r, f: ("exg", f"d{f['d']},d{f['r']}", "next", None))
pattern("1100 ddd1 0100 1rrr")(lambda r, f: ("exg", f"a{f['d']},a{f['r']}", "next", None))
pattern("1100 ddd1 1000 1rrr")(lambda r, f: ("exg", f"d{f['d']},a{f['r']}", "next", None))
arithmetic("1100", "and", DATA)
addresses("1101", "adda")
both_ways("1101 ddd1 ss00 orrr", "addx")
arithmetic("1101", "add", set(MODES))

SHIFTS = ("as", "ls", "rox", "ro")
pattern("1110 0kko 11mm mrrr")(lambda r, f: (f"{SHIFTS[f['k']]}{'rl'[f['o']]}.w", r.place(f["m"], f["r"], "w", MEMORY_ALTERABLE), "next", None))
pattern("1110 dddo ssik krrr")(lambda r, f: (f"{SHIFTS[f['k']]}{'rl'[f['o']]}.{size_of(f)}", f"{'d' + str(f['d']) if f['i'] else '#' + str(f['d'] or 8)},d{f['r']}", "next", None))

#: Patterns by the first four bits.
BY_GROUP = [[row for row in TABLE if not (g << 12 ^ row[1]) & row[0] & 0xF000] for g in range(16)]


def decode(data: bytes, at: int = 0) -> Instruction:
    """The instruction at an even place; a word that is none is data."""
    return _tried(data, at)[0]


def _tried(data: bytes, at: int) -> tuple[Instruction, int, bool]:
    """The instruction, the end of what any pattern read for it, and whether any read an index word."""
    op, end, indexed = int.from_bytes(data[at : at + 2], "big"), at + 2, False
    for mask, value, fields, handler in BY_GROUP[op >> 12]:
        if op & mask == value:
            r = Reader(data, at + 2)
            r.start, made = at, None
            try:
                made = handler(r, {k: op >> shift & m for k, shift, m in fields})
            except Cut:
                pass
            end, indexed = max(end, r.at), indexed or r.indexed
            if made is not None:
                name, operands, flow, target = made
                return Instruction(at, r.at - at, name, operands, flow, target, tuple(r.places)), end, indexed
    return Instruction(at, min(2, len(data) - at), "dc.w", f"${op:04x}", "data", None), end, indexed


#: Bytes of an instruction at most; the bits of an index word that tell if it is one.
LONGEST, INDEX = 10, 0x700
#: Sizes by first word as far as they were met: 0 not met, or minus the number of words behind it whose index bits have a say; and then by those bits.
SIZES_MET, BY_INDEX, MOST_MET = [0] * 65536, {}, 1 << 20


def _size(data: bytes, words: list[int], i: int) -> int:
    """The size of an instruction that lies LONGEST bytes or more before the data's end: the first word tells it, and where operands have an index word, its index bits."""
    op = words[i]
    n = -SIZES_MET[op]
    known = BY_INDEX.get((op, *[w & INDEX for w in words[i + 1 : i + 1 + n]])) if n else None
    if known is None:
        x, end, indexed = _tried(data, 2 * i)
        known = x.size
        if not indexed:
            SIZES_MET[op] = known
            return known
        if len(BY_INDEX) >= MOST_MET:
            BY_INDEX.clear()
        n = max(n, (end - 2 * i) // 2 - 1)
        SIZES_MET[op] = -n
        BY_INDEX[(op, *[w & INDEX for w in words[i + 1 : i + 1 + n]])] = known
    return known


def tiles(data: bytes, most: int = 1 << 16) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Where the instructions of listing() begin and their sizes, without their text, in runs of at most so many."""
    words, met, i, begins = np.frombuffer(data, ">u2", len(data) // 2).tolist(), SIZES_MET, 0, []
    safe = (len(data) - LONGEST) // 2 + 1
    while i < len(words):
        size = met[words[i]] if i < safe else decode(data, 2 * i).size
        if size <= 0:
            size = _size(data, words, i)
        begins.append(i)
        i += size >> 1
        if len(begins) == most:
            at = np.array([*begins, i], np.int64) * 2
            yield at[:-1], np.diff(at).astype(np.int32)
            begins = []
    if begins:
        at = np.array([*begins, i], np.int64) * 2
        yield at[:-1], np.diff(at).astype(np.int32)


def listing(data: bytes) -> Iterator[Instruction]:
    """One instruction after another from the beginning to the end."""
    at = 0
    while at + 1 < len(data):
        x = decode(data, at)
        yield x
        at += x.size


def reached(data: bytes, starts: list[int]) -> dict[int, Instruction]:
    """Instructions that control reaches from the starts: over branches, jumps and calls that tell where they go, up to returns and data."""
    out: dict[int, Instruction] = {}
    todo = [s for s in starts if 0 <= s < len(data) and s % 2 == 0]
    while todo:
        at = todo.pop()
        while 0 <= at < len(data) - 1 and at % 2 == 0 and at not in out:
            x = out[at] = decode(data, at)
            if x.target is not None and x.target not in out:
                todo.append(x.target)
            if x.flow in ("jump", "return", "stop", "data"):
                break
            at += x.size
    return dict(sorted(out.items()))


def functions(code: dict[int, Instruction], starts: list[int]) -> list[int]:
    """Where functions begin: the starts and the targets of calls."""
    return sorted({s for s in starts if s in code} | {x.target for x in code.values() if x.flow == "call" and x.target in code})


def blocks(code: dict[int, Instruction], start: int) -> list[dict]:
    """A function's basic blocks: begin, end, and edges (kind, to). Calls are passed over; control that leaves the code has no edge."""
    own, todo = set(), [start]
    while todo:
        at = todo.pop()
        if at in code and at not in own:
            own.add(at)
            x = code[at]
            if x.flow in ("branch", "jump") and x.target is not None:
                todo.append(x.target)
            if x.flow in ("next", "branch", "call"):
                todo.append(at + x.size)
    order = sorted(own)
    leaders = {start}
    for at in order:
        x = code[at]
        if x.flow in ("branch", "jump"):
            leaders |= {t for t in (x.target,) if t in own}
        if x.flow in ("branch", "jump", "return", "stop", "data"):
            leaders |= {at + x.size} & own
    out, now = [], None
    for at in order:
        x = code[at]
        if at in leaders or now is None or now["end"] != at:
            now = {"begin": at, "end": at, "edges": []}
            out.append(now)
        now["end"] = at + x.size
        after = now["end"]
        if x.flow == "branch":
            now["edges"] = [("taken", x.target), ("not taken", after)]
        elif x.flow == "jump" and x.target is not None:
            now["edges"] = [("jump", x.target)]
        elif x.flow in ("next", "call") and after in leaders:
            now["edges"] = [("next", after)]
    for b in out:
        b["edges"] = [(kind, to) for kind, to in b["edges"] if to in own]
    return out


def strings(data: bytes, least: int = 4) -> Iterator[tuple[int, str]]:
    """NUL-ended runs of printable letters, at least seven tenths of them letters, digits or spaces."""
    at = 0
    for run in data.split(b"\0"):
        if len(run) >= least and all(32 <= c < 127 or c >= 160 for c in run):
            good = sum(c == 32 or chr(c).isalnum() for c in run)
            if 10 * good >= 7 * len(run):
                yield at, run.decode("latin-1")
        at += len(run) + 1


#: What instructions do, by the name before the size; {0} and {1} are the operands.
MEANINGS = {
    "move": "copy {0} to {1}", "movea": "copy {0} to the address register {1}", "moveq": "set {1} to {0}", "movem": "copy the registers {0} to {1}", "movep": "copy {0} to {1} in every other byte", "lea": "take the address {0} into {1}",
    "pea": "push the address {0}", "clr": "set {0} to zero", "tst": "compare {0} with zero", "add": "add {0} to {1}", "adda": "add {0} to {1}", "addi": "add {0} to {1}", "addq": "add {0} to {1}", "addx": "add {0} and the extend bit to {1}",
    "sub": "subtract {0} from {1}", "suba": "subtract {0} from {1}", "subi": "subtract {0} from {1}", "subq": "subtract {0} from {1}", "subx": "subtract {0} and the extend bit from {1}", "mulu": "multiply {1} by {0}, unsigned",
    "muls": "multiply {1} by {0}, signed", "divu": "divide {1} by {0}, unsigned", "divs": "divide {1} by {0}, signed", "neg": "negate {0}", "negx": "negate {0} with the extend bit", "not": "invert every bit of {0}",
    "and": "keep the bits of {1} that {0} has", "andi": "keep the bits of {1} that {0} has", "or": "set the bits of {0} in {1}", "ori": "set the bits of {0} in {1}", "eor": "flip the bits of {0} in {1}", "eori": "flip the bits of {0} in {1}",
    "cmp": "compare {1} with {0}", "cmpa": "compare {1} with {0}", "cmpi": "compare {1} with {0}", "cmpm": "compare {1} with {0}", "btst": "test bit {0} of {1}", "bset": "test and set bit {0} of {1}", "bclr": "test and clear bit {0} of {1}",
    "bchg": "test and flip bit {0} of {1}", "swap": "swap the halves of {0}", "exg": "exchange {0} and {1}", "ext": "extend the sign of {0}", "jmp": "go to {0}", "jsr": "call {0}", "bra": "go to {0}", "bsr": "call {0}", "rts": "return",
    "rte": "return from an exception", "rtr": "return and restore the flags", "nop": "do nothing", "link": "make a frame on {0} of {1} bytes", "unlk": "take the frame on {0} away", "trap": "enter the system by trap {0}", "trapv": "trap on overflow",
    "chk": "trap unless {1} lies between 0 and {0}", "tas": "test {0} and set its highest bit", "nbcd": "negate {0} in decimal", "abcd": "add {0} to {1} in decimal", "sbcd": "subtract {0} from {1} in decimal", "reset": "reset the devices",
    "stop": "stop and wait for an interrupt with status {0}", "illegal": "raise an illegal instruction", "dc": "data {0}",
}
WHEN = {
    "hi": "higher", "ls": "lower or the same", "cc": "higher or the same, unsigned", "cs": "lower, unsigned", "ne": "not equal", "eq": "equal", "vc": "without overflow", "vs": "with overflow", "pl": "not negative", "mi": "negative",
    "ge": "greater or equal", "lt": "less", "gt": "greater", "le": "less or equal", "t": "always", "f": "never",
}
TURNS = {"as": "shift {1} arithmetically {2} by {0}", "ls": "shift {1} {2} by {0}", "ro": "rotate {1} {2} by {0}", "rox": "rotate {1} with the extend bit {2} by {0}"}


def operands(text: str) -> list[str]:
    """The operands of a list, commas in brackets passed over."""
    out, depth = [""], 0
    for c in text:
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            out.append("")
        else:
            out[-1] += c
    return out


def explain(x: Instruction) -> str:
    """What an instruction does, in words."""
    name, _, size = x.name.partition(".")
    parts = (operands(x.operands) if x.operands else []) + ["", ""]
    width = {"b": " (a byte)", "w": " (a word)", "l": " (a long word)"}.get(size, "") if name not in ("bra", "bsr", "dc") and x.flow != "branch" else ""
    if name in MEANINGS:
        return MEANINGS[name].format(*parts) + width
    if name[-1] in "lr" and name[:-1] in TURNS:
        by, what = (parts[0], parts[1]) if parts[1] else ("1", parts[0])
        return TURNS[name[:-1]].format(by, what, "left" if name[-1] == "l" else "right") + width
    if name.startswith("db"):
        return f"count {parts[0]} down and go to {parts[1]} until it is -1" + ("" if name == "dbra" else f", unless {WHEN[name[2:]]}")
    if name[0] == "b" and name[1:] in WHEN:
        return f"go to {parts[0]} if {WHEN[name[1:]]}"
    return f"set {parts[0]} to all ones if {WHEN[name[1:]]}, else to zero"
