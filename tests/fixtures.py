"""Disk images built byte by byte, without any code of the library."""

import struct


class Disk:
    """A floppy volume of 1,760 blocks; flags: 0 older file system, 1 newer one."""

    def __init__(self, name=b"Fixture", flags=0, blocks=1760):
        self.b = [bytearray(512) for _ in range(blocks)]
        self.flags, self.root, self.next = flags, (2 + blocks - 1) // 2, (2 + blocks - 1) // 2 + 2
        self.b[0][:4] = b"DOS" + bytes([flags])
        r = self.root
        for at, x in ((0, 2), (12, 72), (512 - 200, 0xFFFFFFFF), (512 - 196, r + 1), (512 - 4, 1)):
            self.put(r, at, x)
        for at in (92, 40, 28):
            self.put(r, 512 - at, 5000)
        self.name(r, name)
        self.used = {r, r + 1}

    def put(self, block, at, value):
        struct.pack_into(">I", self.b[block], at, value & 0xFFFFFFFF)

    def get(self, block, at):
        return struct.unpack_from(">I", self.b[block], at)[0]

    def name(self, block, name):
        self.b[block][432] = len(name)
        self.b[block][433 : 433 + len(name)] = name

    def seal(self, block, at=20):
        self.put(block, at, 0)
        self.put(block, at, -sum(struct.unpack(">128I", self.b[block])))

    def slot(self, name):
        h = len(name)
        for c in name.upper():
            h = (h * 13 + c) & 0x7FF
        return 24 + 4 * (h % 72)

    def take(self):
        self.next += 1
        self.used.add(self.next - 1)
        return self.next - 1

    def header(self, name, kind, parent):
        b = self.take()
        for at, x in ((0, 2), (4, b), (512 - 4, kind), (512 - 12, parent), (512 - 92, 5000)):
            self.put(b, at, x)
        self.name(b, name)
        at = self.slot(name)
        self.put(b, 512 - 16, self.get(parent, at))
        self.put(parent, at, b)
        return b

    def add_dir(self, name, parent=None):
        return self.header(name, 2, parent or self.root)

    def add_file(self, name, data, parent=None):
        h = self.header(name, -3, parent or self.root)
        self.put(h, 512 - 188, len(data))
        size = 488 if self.flags % 2 == 0 else 512
        now, n, table = h, 0, []
        for i in range(0, len(data), size):
            if n == 72:
                b = self.take()
                for at, x in ((0, 16), (4, b), (512 - 12, h), (512 - 4, -3)):
                    self.put(b, at, x)
                self.put(now, 512 - 8, b)
                table.append(b)
                now, n = b, 0
            d, piece = self.take(), data[i : i + size]
            if size == 488:
                for at, x in ((0, 8), (4, h), (8, i // size + 1), (12, len(piece))):
                    self.put(d, at, x)
                self.b[d][24 : 24 + len(piece)] = piece
                self.seal(d)
            else:
                self.b[d][: len(piece)] = piece
            n += 1
            self.put(now, 24 + 4 * (72 - n), d)
            self.put(now, 8, n)
        for b in table:
            self.seal(b)
        return h

    def add_link(self, name, target, kind=-4, parent=None):
        b = self.header(name, kind, parent or self.root)
        self.put(b, 512 - 44, target)
        self.put(b, 512 - 40, self.get(target, 512 - 40))
        self.put(target, 512 - 40, b)
        return b

    def build(self):
        """Seals headers that haven't been spoilt on purpose, writes the bitmap."""
        for b in range(2, len(self.b)):
            if self.get(b, 0) == 2 and b not in getattr(self, "spoilt", ()):
                self.seal(b)
        m = self.root + 1
        for w in range(127):
            bits = 0
            for i in range(32):
                bits |= (w * 32 + i + 2 not in self.used) << i
            self.put(m, 4 + 4 * w, bits)
        self.seal(m, 0)
        return b"".join(bytes(x) for x in self.b)
