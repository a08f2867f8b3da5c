"""The standard security handler: keys from passwords, RC4 and AES-CBC. AES is written out because blocks come without padding."""

from __future__ import annotations

import hashlib
import struct
import stringprep
import unicodedata
from functools import lru_cache
from operator import itemgetter

# Fixed value: the padding of passwords in the format.
PADDING = bytes.fromhex("28BF4E5E4E758A4164004E56FFFA01082E2E00B6D0683E802F0CA9FE6453697A")


class PasswordFault(ValueError):
    pass


class CryptFault(ValueError):
    pass


def rc4(key: bytes, data: bytes) -> bytes:
    box, j = list(range(256)), 0
    for i in range(256):
        j = (j + box[i] + key[i % len(key)]) & 255
        box[i], box[j] = box[j], box[i]
    out, i, j = bytearray(len(data)), 0, 0
    for n, c in enumerate(data):
        i = (i + 1) & 255
        j = (j + box[i]) & 255
        box[i], box[j] = box[j], box[i]
        out[n] = c ^ box[(box[i] + box[j]) & 255]
    return bytes(out)


# -- AES, its tables from the field's arithmetic ---------------------------------------------------------------


def _double(x: int) -> int:
    return (x << 1) ^ (0x11B if x & 0x80 else 0)


def _times(a: int, b: int) -> int:
    out = 0
    while b:
        if b & 1:
            out ^= a
        a, b = _double(a), b >> 1
    return out


@lru_cache(1)
def _boxes() -> tuple[bytes, bytes, dict[int, bytes]]:
    inverse = [0] * 256
    for a in range(1, 256):
        if not inverse[a]:
            b = next(b for b in range(1, 256) if _times(a, b) == 1)
            inverse[a], inverse[b] = b, a
    box = bytearray(256)
    for a, v in enumerate(inverse):
        s = 0x63
        for shift in range(5):
            s ^= ((v << shift) | (v >> (8 - shift))) & 255
        box[a] = s
    back = bytes(box.index(i) for i in range(256))
    return bytes(box), back, {k: bytes(_times(x, k) & 255 for x in range(256)) for k in (2, 3, 9, 11, 13, 14)}


@lru_cache(64)
def _schedule(key: bytes) -> list[bytes]:
    box, _, _ = _boxes()
    n = len(key) // 4
    words, round_ = [key[4 * i : 4 * i + 4] for i in range(n)], 1
    for i in range(n, 4 * (n + 7)):
        w = words[-1]
        if i % n == 0:
            w = bytes(box[b] for b in w[1:] + w[:1])
            w = bytes([w[0] ^ round_]) + w[1:]
            round_ = _double(round_) & 255
        elif n > 6 and i % n == 4:
            w = bytes(box[b] for b in w)
        words.append(bytes(a ^ b for a, b in zip(w, words[i - n], strict=True)))
    return [b"".join(words[i : i + 4]) for i in range(0, len(words), 4)]


_FORWARD = [(i + 4 * (i % 4)) % 16 for i in range(16)]
_BACKWARD = itemgetter(*((i - 4 * (i % 4)) % 16 for i in range(16)))


@lru_cache(1)
def _tables() -> tuple[list[list[int]], list[list[int]], list[list[int]], bytes]:
    """What a byte at each place of a block adds to the next state, as 128-bit numbers: in a round of encryption, in its last round, and when columns are unmixed; and the inverse box."""
    box, back, times = _boxes()

    def spread(place: int, value: int, row: tuple[int, ...]) -> int:
        out, column = bytearray(16), place // 4 * 4
        for q in range(4):
            k = row[(place - q) % 4]
            out[column + q] = value if k == 1 else times[k][value] if k else 0
        return int.from_bytes(out, "big")

    to = [_FORWARD.index(i) for i in range(16)]
    return (
        [[spread(to[i], box[x], (2, 3, 1, 1)) for x in range(256)] for i in range(16)],
        [[spread(to[i], box[x], (1, 0, 0, 0)) for x in range(256)] for i in range(16)],
        [[spread(i, x, (14, 11, 13, 9)) for x in range(256)] for i in range(16)],
        back,
    )


def _added(tables: list[list[int]], state: bytes) -> int:
    out = 0
    for table, x in zip(tables, state):
        out ^= table[x]
    return out


def _encrypt_block(keys: list[int], block: int) -> int:
    middle, last, _, _ = _tables()
    state = block ^ keys[0]
    for k in keys[1:-1]:
        state = _added(middle, state.to_bytes(16, "big")) ^ k
    return _added(last, state.to_bytes(16, "big")) ^ keys[-1]


def _decrypt_block(keys: list[int], block: int) -> int:
    _, _, unmix, back = _tables()
    state = block ^ keys[-1]
    for k in keys[-2::-1]:
        state = int.from_bytes(bytes(_BACKWARD(state.to_bytes(16, "big").translate(back))), "big") ^ k
        if k is not keys[0]:
            state = _added(unmix, state.to_bytes(16, "big"))
    return state


def aes_cbc(key: bytes, iv: bytes, data: bytes, encrypting: bool = False) -> bytes:
    """Whole blocks; what is left of a last one is dropped."""
    keys, out, before = [int.from_bytes(k, "big") for k in _schedule(key)], [], int.from_bytes(iv, "big")
    for at in range(0, len(data) // 16 * 16, 16):
        block = int.from_bytes(data[at : at + 16], "big")
        if encrypting:
            before = _encrypt_block(keys, block ^ before)
            out.append(before)
        else:
            out.append(_decrypt_block(keys, block) ^ before)
            before = block
    return b"".join(x.to_bytes(16, "big") for x in out)


def unpad(data: bytes) -> bytes:
    """Without its padding; data whose end is no valid padding stays as it is."""
    n = data[-1] if data else 0
    return data[:-n] if 1 <= n <= min(16, len(data)) and data[-n:] == bytes([n]) * n else data


def prepare_password(text: str) -> str:
    """Normalised as newer handlers ask: mapped, NFKC, prohibited characters refused."""
    mapped = "".join(" " if stringprep.in_table_c12(c) else c for c in text if not stringprep.in_table_b1(c))
    out = unicodedata.normalize("NFKC", mapped)
    banned = (stringprep.in_table_c12, stringprep.in_table_c21_c22, stringprep.in_table_c3, stringprep.in_table_c4, stringprep.in_table_c5, stringprep.in_table_c6, stringprep.in_table_c7, stringprep.in_table_c8, stringprep.in_table_c9, stringprep.in_table_a1)
    if any(f(c) for c in out for f in banned):
        raise PasswordFault("a prohibited character in the password")
    if any(map(stringprep.in_table_d1, out)) and (any(map(stringprep.in_table_d2, out)) or not (stringprep.in_table_d1(out[0]) and stringprep.in_table_d1(out[-1]))):
        raise PasswordFault("mixed directions in the password")
    return out


class Handler:
    """Decrypts strings and streams of a document. ``encrypt`` is its dictionary with plain values, ``first_id`` the first file id."""

    def __init__(self, encrypt: dict, first_id: bytes, password: str = ""):
        if encrypt.get("Filter", "Standard") != "Standard":
            raise CryptFault(f"security handler {encrypt.get('Filter')}")
        self.version, self.revision = encrypt.get("V", 0), encrypt.get("R", 0)
        if self.version not in (1, 2, 4, 5):
            raise CryptFault(f"encryption version {self.version}")
        self.owner, self.user, self.flags = encrypt.get("O", b""), encrypt.get("U", b""), encrypt.get("P", 0) & 0xFFFFFFFF
        self.length = encrypt.get("Length", 40) // 8 if self.version > 1 else 5
        self.clear_metadata = encrypt.get("EncryptMetadata") is False
        self.first_id, self.method = first_id, "V2"
        if self.version >= 4:
            names = [encrypt.get(k, "Identity") for k in ("StmF", "StrF")]
            if names[0] != names[1]:
                raise CryptFault("different filters for strings and streams")
            own = encrypt.get("CF", {}).get(names[0], {})
            self.method = "Identity" if names[0] == "Identity" else own.get("CFM", "V2")
            self.length = 32 if self.version == 5 else 16
        self.key = self._newer_key(encrypt, password) if self.version == 5 else self._older_key(password)
        if self.key is None:
            raise PasswordFault("wrong password")

    printable = property(lambda self: bool(self.flags & 4))
    modifiable = property(lambda self: bool(self.flags & 8))
    extractable = property(lambda self: bool(self.flags & 16))

    # keys of revisions 2 to 4
    def _file_key(self, password: bytes) -> bytes:
        d = hashlib.md5((password + PADDING)[:32] + self.owner + struct.pack("<I", self.flags) + self.first_id + (b"\xff" * 4 if self.revision >= 4 and self.clear_metadata else b"")).digest()
        if self.revision >= 3:
            for _ in range(50):
                d = hashlib.md5(d[: self.length]).digest()
        return d[: self.length if self.revision >= 3 else 5]

    def _opens(self, key: bytes) -> bool:
        if self.revision == 2:
            return rc4(key, PADDING) == self.user
        d = hashlib.md5(PADDING + self.first_id).digest()
        for i in range(20):
            d = rc4(bytes(k ^ i for k in key), d)
        return d == self.user[:16]

    def _older_key(self, text: str) -> bytes | None:
        password = text.encode("latin-1", "replace")
        key = self._file_key(password)
        if self._opens(key):
            return key
        d = hashlib.md5((password + PADDING)[:32]).digest()
        if self.revision >= 3:
            for _ in range(50):
                d = hashlib.md5(d).digest()
        own, user = d[: self.length if self.revision >= 3 else 5], self.owner
        for i in range(19, -1, -1) if self.revision >= 3 else (0,):
            user = rc4(bytes(k ^ i for k in own), user)
        key = self._file_key(user)
        return key if self._opens(key) else None

    # keys of revisions 5 and 6
    def _hash(self, password: bytes, salt: bytes, more: bytes = b"") -> bytes:
        k = hashlib.sha256(password + salt + more).digest()
        if self.revision < 6:
            return k
        i, last = 0, 0
        while i < 64 or last > i - 32:
            e = aes_cbc(k[:16], k[16:32], (password + k + more) * 64, encrypting=True)
            k = hashlib.new(("sha256", "sha384", "sha512")[sum(e[:16]) % 3], e).digest()
            i, last = i + 1, e[-1]
        return k[:32]

    def _newer_key(self, encrypt: dict, text: str) -> bytes | None:
        password = (prepare_password(text) if self.revision >= 6 and text else text).encode()[:127]
        for mine, wrapped, more in ((self.owner, encrypt.get("OE", b""), self.user[:48]), (self.user, encrypt.get("UE", b""), b"")):
            if self._hash(password, mine[32:40], more) == mine[:32]:
                return aes_cbc(self._hash(password, mine[40:48], more), bytes(16), wrapped)
        return None

    def decrypt(self, data: bytes, num: int, gen: int, attrs: dict | None = None) -> bytes:
        if self.method == "Identity" or (self.clear_metadata and attrs and attrs.get("Type") == "Metadata"):
            return data
        if self.method == "AESV3":
            return unpad(aes_cbc(self.key, data[:16], data[16:]))
        salted = self.key[:16] + struct.pack("<I", num)[:3] + struct.pack("<I", gen)[:2] + (b"sAlT" if self.method == "AESV2" else b"")
        key = hashlib.md5(salted).digest()[: min(len(self.key) + 5, 16)]
        return unpad(aes_cbc(key, data[:16], data[16:])) if self.method == "AESV2" else rc4(key, data)
