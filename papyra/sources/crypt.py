"""Ciphers and the standard security handler of PDF files, in plain Python.

AES works on table lookups, RC4 byte by byte: slow beside native code, but a file's strings and streams are small, and
nothing here depends on the platform. Written files use AES-256 (revision 6); files of revisions 2 to 6 are read.
"""

from __future__ import annotations

import hashlib
import os
import struct
from dataclasses import dataclass, field
from typing import Any


class WrongPassword(ValueError):
    """The file asks for a password, or for another one."""


def _boxes() -> tuple[list[int], list[int]]:
    """The AES substitution and its inverse, from inverses in GF(256) and an affine map."""
    p = q = 1
    box = [0x63] * 256
    while True:
        p ^= (p << 1) & 0xFF ^ (0x1B if p & 0x80 else 0)
        q ^= q << 1
        q ^= q << 2
        q ^= q << 4
        q &= 0xFF
        if q & 0x80:
            q ^= 0x09
        x = q
        for k in range(1, 5):
            x ^= (q << k | q >> (8 - k)) & 0xFF
        box[p] = x ^ 0x63
        if p == 1:
            break
    back = [0] * 256
    for k, x in enumerate(box):
        back[x] = k
    return box, back


_BOX, _BACK = _boxes()


def _times(a: int, b: int) -> int:
    out = 0
    while b:
        if b & 1:
            out ^= a
        a = a << 1 ^ (0x11B if a & 0x80 else 0)
        b >>= 1
    return out


def _columns(table: list[int], factors: tuple[int, ...]) -> list[list[int]]:
    """For each of the four rows, a byte's share of the mixed column as one 32-bit word."""
    words = [int.from_bytes(bytes(_times(x, f) for f in factors), "big") for x in table]
    turned = [words]
    for _ in range(3):
        turned.append([w >> 8 | (w & 0xFF) << 24 for w in turned[-1]])
    return turned


_MIX = _columns(_BOX, (2, 1, 1, 3))
_UNMIX = _columns(_BACK, (14, 9, 13, 11))
_UNMIX_KEY = _columns(list(range(256)), (14, 9, 13, 11))


class Aes:
    """AES with a key of 16 or 32 bytes, in CBC."""

    def __init__(self, key: bytes):
        n = len(key) // 4
        self.rounds = n + 6
        words = [int.from_bytes(key[4 * k : 4 * k + 4], "big") for k in range(n)]
        constant = 1
        for k in range(n, 4 * (self.rounds + 1)):
            w = words[-1]
            if k % n == 0:
                w = (w << 8 | w >> 24) & 0xFFFFFFFF
                w = self._substitute(w) ^ constant << 24
                constant = _times(constant, 2)
            elif n > 6 and k % n == 4:
                w = self._substitute(w)
            words.append(words[k - n] ^ w)
        self.keys = [words[k : k + 4] for k in range(0, len(words), 4)]
        middle = [[_UNMIX_KEY[0][w >> 24] ^ _UNMIX_KEY[1][w >> 16 & 255] ^ _UNMIX_KEY[2][w >> 8 & 255] ^ _UNMIX_KEY[3][w & 255] for w in k] for k in self.keys[1:-1]]
        self.back_keys = [self.keys[-1], *reversed(middle), self.keys[0]]

    @staticmethod
    def _substitute(w: int) -> int:
        return _BOX[w >> 24] << 24 | _BOX[w >> 16 & 255] << 16 | _BOX[w >> 8 & 255] << 8 | _BOX[w & 255]

    @staticmethod
    def _block(state: list[int], keys: list[list[int]], mix: list[list[int]], box: list[int], step: int) -> list[int]:
        a, b, c, d = mix
        s = [x ^ k for x, k in zip(state, keys[0])]
        for key in keys[1:-1]:
            s = [a[s[j] >> 24] ^ b[s[(j + step) & 3] >> 16 & 255] ^ c[s[(j + 2) & 3] >> 8 & 255] ^ d[s[(j - step) & 3] & 255] ^ key[j] for j in range(4)]
        last = keys[-1]
        return [
            (box[s[j] >> 24] << 24 | box[s[(j + step) & 3] >> 16 & 255] << 16 | box[s[(j + 2) & 3] >> 8 & 255] << 8 | box[s[(j - step) & 3] & 255]) ^ last[j]
            for j in range(4)
        ]

    def encrypt(self, data: bytes, iv: bytes) -> bytes:
        """Whole blocks, chained."""
        before = list(struct.unpack(">4I", iv))
        out = []
        for at in range(0, len(data), 16):
            before = self._block([x ^ y for x, y in zip(struct.unpack_from(">4I", data, at), before)], self.keys, _MIX, _BOX, 1)
            out.append(struct.pack(">4I", *before))
        return b"".join(out)

    def decrypt(self, data: bytes, iv: bytes) -> bytes:
        """Whole blocks, chained."""
        before = struct.unpack(">4I", iv)
        out = []
        for at in range(0, len(data) - len(data) % 16, 16):
            block = struct.unpack_from(">4I", data, at)
            plain = self._block(list(block), self.back_keys, _UNMIX, _BACK, -1)
            out.append(struct.pack(">4I", *(x ^ y for x, y in zip(plain, before))))
            before = block
        return b"".join(out)


def pad(data: bytes) -> bytes:
    """Padded to whole blocks; the last byte says how much."""
    n = 16 - len(data) % 16
    return data + bytes([n]) * n


def unpad(data: bytes) -> bytes:
    """Without padding; data whose padding makes no sense is left as it is."""
    return data[: -data[-1]] if data and 1 <= data[-1] <= 16 and data[-data[-1] :] == data[-1:] * data[-1] else data


def rc4(key: bytes, data: bytes) -> bytes:
    """The stream cipher of old files; the same both ways."""
    box, j = list(range(256)), 0
    for i in range(256):
        j = (j + box[i] + key[i % len(key)]) & 255
        box[i], box[j] = box[j], box[i]
    out, i, j = bytearray(len(data)), 0, 0
    for k, byte in enumerate(data):
        i = (i + 1) & 255
        j = (j + box[i]) & 255
        box[i], box[j] = box[j], box[i]
        out[k] = byte ^ box[(box[i] + box[j]) & 255]
    return bytes(out)


# Fixed value: what short passwords are filled up with.
FILL = bytes.fromhex("28BF4E5E4E758A4164004E56FFFA01082E2E00B6D0683E802F0CA9FE6453697A")
# Bits of the permissions.
PRINT, MODIFY, COPY, NOTES, FILL_FORMS, ASSEMBLE, PRINT_WELL = 4, 8, 16, 32, 256, 1024, 2048


def _hash6(password: bytes, salt: bytes, user: bytes = b"") -> bytes:
    """The hash of revision 6: rounds of AES and SHA-2 whose choice depends on what came out before."""
    k, n = hashlib.sha256(password + salt + user).digest(), 0
    while True:
        mixed = Aes(k[:16]).encrypt((password + k + user) * 64, k[16:32])
        k = (hashlib.sha256, hashlib.sha384, hashlib.sha512)[sum(mixed[:16]) % 3](mixed).digest()
        n += 1
        if n >= 64 and mixed[-1] <= n - 32:
            return k[:32]


@dataclass
class Security:
    """How a file is encrypted: the key, and what strings and streams use."""

    key: bytes
    revision: int
    string_method: str = "V2"
    stream_method: str = "V2"
    info: dict[str, Any] = field(default_factory=dict)
    encrypt_metadata: bool = True
    is_owner: bool = False

    @classmethod
    def open(cls, info: dict[str, Any], file_id: bytes, password: str) -> Security:
        """From an encryption dictionary whose values are resolved; a wrong password raises."""
        if info.get("Filter") != "Standard":
            raise WrongPassword("encrypted: only the standard security handler is available in this build")
        version, revision = int(info.get("V", 0)), int(info.get("R", 0))
        if version not in (1, 2, 4, 5) or revision not in (2, 3, 4, 5, 6):
            raise WrongPassword(f"encrypted: version {version} is not available in this build")
        methods = []
        for name in ("StrF", "StmF"):
            if version < 4:
                methods.append("V2")
                continue
            chosen = info.get(name, "Identity")
            filters = info.get("CF") or {}
            if chosen != "Identity" and not isinstance(filters.get(chosen), dict):
                raise WrongPassword("encrypted: a crypt filter is named and not defined")
            methods.append("Identity" if chosen == "Identity" else str(filters[chosen].get("CFM", "None")))
        plain = info.get("EncryptMetadata") is not False
        out = cls(b"", revision, methods[0], methods[1], info, plain)
        given = password.encode("utf-8")[:127] if revision >= 5 else password.encode("latin-1", "replace")
        found = out._open_new(given) if revision >= 5 else out._open_old(given, file_id, version)
        if found is None:
            raise WrongPassword("encrypted: wrong password" if password else "encrypted: pass a password")
        out.key = found
        return out

    def _open_old(self, given: bytes, file_id: bytes, version: int) -> bytes | None:
        length = 5 if self.revision == 2 else int(self.info.get("Length", 40)) // 8
        length = 16 if version == 4 else length
        owner, user = self.info["O"][:32], self.info["U"]

        def key_of(password: bytes) -> bytes:
            data = (password + FILL)[:32] + owner + struct.pack("<i", _signed(int(self.info["P"]))) + file_id
            if self.revision >= 4 and not self.encrypt_metadata:
                data += b"\xff\xff\xff\xff"
            k = hashlib.md5(data).digest()
            for _ in range(50 if self.revision >= 3 else 0):
                k = hashlib.md5(k[:length]).digest()
            return k[:length]

        def opens(k: bytes) -> bool:
            if self.revision == 2:
                return rc4(k, FILL) == user[:32]
            x = rc4(k, hashlib.md5(FILL + file_id).digest())
            for n in range(1, 20):
                x = rc4(bytes(b ^ n for b in k), x)
            return x == user[:16]

        if opens(k := key_of(given)):
            return k
        seed = hashlib.md5((given + FILL)[:32]).digest()
        for _ in range(50 if self.revision >= 3 else 0):
            seed = hashlib.md5(seed).digest()
        seed, inner = seed[:length], owner
        for n in reversed(range(20 if self.revision >= 3 else 1)):
            inner = rc4(bytes(b ^ n for b in seed), inner)
        if opens(k := key_of(inner)):
            self.is_owner = True
            return k
        return None

    def _open_new(self, given: bytes) -> bytes | None:
        hashed = _hash6 if self.revision == 6 else lambda p, s, u=b"": hashlib.sha256(p + s + u).digest()
        user, owner = self.info["U"][:48], self.info["O"][:48]
        for kept, sealed, extra in ((owner, self.info.get("OE"), user), (user, self.info.get("UE"), b"")):
            if hashed(given, kept[32:40], extra) == kept[:32]:
                self.is_owner = extra == user
                return Aes(hashed(given, kept[40:48], extra)).decrypt(sealed[:32], bytes(16))
        return None

    @classmethod
    def make(cls, user: str, owner: str, permissions: int, random=os.urandom) -> Security:
        """A new AES-256 protection (revision 6)."""
        key = random(32)
        entries: dict[str, Any] = {}
        made = b""
        for name, password in (("U", user), ("O", owner)):
            given, salts, extra = password.encode("utf-8")[:127], random(16), made if name == "O" else b""
            entries[name] = _hash6(given, salts[:8], extra) + salts
            entries[name + "E"] = Aes(_hash6(given, salts[8:], extra)).encrypt(key, bytes(16))
            made = entries["U"]
        p = _signed(permissions)
        block = struct.pack("<i", p) + b"\xff\xff\xff\xff" + b"T" + b"adb" + random(4)
        info = {"P": p, "Perms": Aes(key).encrypt(block, bytes(16)), **entries}
        return cls(key, 6, "AESV3", "AESV3", info, True, True)

    def _object_key(self, number: int, generation: int, method: str) -> bytes:
        if method == "AESV3":
            return self.key
        data = self.key + struct.pack("<I", number)[:3] + struct.pack("<I", generation)[:2] + (b"sAlT" if method == "AESV2" else b"")
        return hashlib.md5(data).digest()[: min(16, len(self.key) + 5)]

    def decrypt(self, data: bytes, number: int, generation: int, *, stream: bool) -> bytes:
        """The plain bytes of a string or stream of an object."""
        method = self.stream_method if stream else self.string_method
        if method in ("Identity", "None"):
            return data
        key = self._object_key(number, generation, method)
        if method == "V2":
            return rc4(key, data)
        return unpad(Aes(key).decrypt(data[16:], data[:16])) if len(data) >= 32 else b""

    def encrypt(self, data: bytes, number: int, generation: int, *, stream: bool, random=os.urandom) -> bytes:
        """The stored bytes of a string or stream of an object."""
        method = self.stream_method if stream else self.string_method
        if method in ("Identity", "None"):
            return data
        key = self._object_key(number, generation, method)
        if method == "V2":
            return rc4(key, data)
        iv = random(16)
        return iv + Aes(key).encrypt(pad(data), iv)


def _signed(p: int) -> int:
    p &= 0xFFFFFFFF
    return p - (1 << 32) if p >> 31 else p


def permissions(*, deny_print: bool = False, deny_copy: bool = False, deny_modify: bool = False) -> int:
    """Permission bits with all that is not denied."""
    bits = 0xFFFFFFFC
    if deny_print:
        bits &= ~(PRINT | PRINT_WELL)
    if deny_copy:
        bits &= ~COPY
    if deny_modify:
        bits &= ~(MODIFY | NOTES | FILL_FORMS | ASSEMBLE)
    return bits
