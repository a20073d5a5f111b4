"""The standard security handler: RC4 and AES, revisions 2 to 6.

AES decrypts all blocks of a stream at once in numpy; encryption, which chains
block by block, is only needed for key derivation and by the writer.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np

from quire.kernel.cos import Name, Ref, Stream, as_dict, as_int
from quire.kernel.errors import PdfError

#: Fixed value: the padding of passwords.
PAD = bytes.fromhex("28BF4E5E4E758A4164004E56FFFA01082E2E00B6D0683E802F0CA9FE6453697A")


def rc4(key: bytes, data: bytes) -> bytes:
    s, j = list(range(256)), 0
    for i in range(256):
        j = (j + s[i] + key[i % len(key)]) & 255
        s[i], s[j] = s[j], s[i]
    out, i, j = bytearray(len(data)), 0, 0
    for k, c in enumerate(data):
        i = (i + 1) & 255
        a = s[i]
        j = (j + a) & 255
        b = s[j]
        s[i], s[j] = b, a
        out[k] = c ^ s[(a + b) & 255]
    return bytes(out)


def _double(x: int) -> int:
    return (x << 1) ^ (0x11B if x & 0x80 else 0)


def _boxes() -> tuple[bytes, bytes]:
    """The S-box from its definition: inverse in GF(2^8), then the affine map."""
    power, log, x = [0] * 256, [0] * 256, 1
    for i in range(255):
        power[i], log[x] = x, i
        x ^= _double(x)
    box = bytearray(256)
    for v in range(256):
        inv = power[(255 - log[v]) % 255] if v else 0
        r = 0
        for k in range(5):
            r ^= (inv << k | inv >> (8 - k)) & 255
        box[v] = r ^ 0x63
    back = bytearray(256)
    for v, b in enumerate(box):
        back[b] = v
    return bytes(box), bytes(back)


SBOX, INVERSE = _boxes()
SHIFT = [0, 5, 10, 15, 4, 9, 14, 3, 8, 13, 2, 7, 12, 1, 6, 11]
UNSHIFT = np.argsort(SHIFT)


def _times(k: int) -> np.ndarray:
    out = np.zeros(256, np.uint8)
    for v in range(256):
        r, x, n = 0, v, k
        while n:
            r ^= x if n & 1 else 0
            x, n = _double(x), n >> 1
        out[v] = r
    return out


M2, M3, M9, M11, M13, M14 = (_times(k) for k in (2, 3, 9, 11, 13, 14))


@lru_cache(64)
def round_keys(key: bytes) -> list[bytes]:
    n, rounds = len(key) // 4, len(key) // 4 + 6
    words, rcon = [key[i : i + 4] for i in range(0, len(key), 4)], 1
    for i in range(n, 4 * (rounds + 1)):
        t = words[-1]
        if i % n == 0:
            t = bytes(SBOX[b] for b in t[1:] + t[:1])
            t = bytes([t[0] ^ rcon]) + t[1:]
            rcon = _double(rcon)
        elif n > 6 and i % n == 4:
            t = bytes(SBOX[b] for b in t)
        words.append(bytes(a ^ b for a, b in zip(words[i - n], t, strict=True)))
    return [b"".join(words[i : i + 4]) for i in range(0, len(words), 4)]


def aes_decrypt_blocks(key: bytes, data: bytes) -> np.ndarray:
    keys = [np.frombuffer(k, np.uint8) for k in round_keys(key)]
    box = np.frombuffer(INVERSE, np.uint8)
    s = np.frombuffer(data, np.uint8).reshape(-1, 16) ^ keys[-1]
    for k in reversed(keys[1:-1]):
        s = (box[s[:, UNSHIFT]] ^ k).reshape(-1, 4, 4)
        a, b, c, d = (s[:, :, i] for i in range(4))
        s = np.stack([M14[a] ^ M11[b] ^ M13[c] ^ M9[d], M9[a] ^ M14[b] ^ M11[c] ^ M13[d], M13[a] ^ M9[b] ^ M14[c] ^ M11[d], M11[a] ^ M13[b] ^ M9[c] ^ M14[d]], axis=2).reshape(-1, 16)
    return box[s[:, UNSHIFT]] ^ keys[0]


def cbc_decrypt(key: bytes, iv: bytes, data: bytes) -> bytes:
    chain = np.frombuffer(iv + data[:-16], np.uint8).reshape(-1, 16)
    return (aes_decrypt_blocks(key, data) ^ chain).tobytes()


@lru_cache(1)
def _tables() -> list[list[int]]:
    """For each row of the state: the column that a byte contributes after its substitution."""
    out = []
    for r in range(4):
        row = []
        for v in range(256):
            s = SBOX[v]
            col = [int(M2[s]), s, s, int(M3[s])]
            col = col[-r:] + col[:-r] if r else col
            row.append(int.from_bytes(bytes(col), "big"))
        out.append(row)
    return out


def cbc_encrypt(key: bytes, iv: bytes, data: bytes) -> bytes:
    t0, t1, t2, t3 = _tables()
    keys = [[int.from_bytes(k[i : i + 4], "big") for i in range(0, 16, 4)] for k in round_keys(key)]
    first, middle, last = keys[0], keys[1:-1], keys[-1]
    prev, out, box = [int.from_bytes(iv[i : i + 4], "big") for i in range(0, 16, 4)], [], SBOX
    for at in range(0, len(data), 16):
        a, b, c, d = (int.from_bytes(data[at + 4 * i : at + 4 * i + 4], "big") ^ prev[i] ^ first[i] for i in range(4))
        for k in middle:
            a, b, c, d = (
                t0[a >> 24] ^ t1[b >> 16 & 255] ^ t2[c >> 8 & 255] ^ t3[d & 255] ^ k[0],
                t0[b >> 24] ^ t1[c >> 16 & 255] ^ t2[d >> 8 & 255] ^ t3[a & 255] ^ k[1],
                t0[c >> 24] ^ t1[d >> 16 & 255] ^ t2[a >> 8 & 255] ^ t3[b & 255] ^ k[2],
                t0[d >> 24] ^ t1[a >> 16 & 255] ^ t2[b >> 8 & 255] ^ t3[c & 255] ^ k[3],
            )
        prev = [
            (box[w >> 24] << 24 | box[x >> 16 & 255] << 16 | box[y >> 8 & 255] << 8 | box[z & 255]) ^ k
            for (w, x, y, z), k in zip(((a, b, c, d), (b, c, d, a), (c, d, a, b), (d, a, b, c)), last, strict=True)
        ]
        out.append(b"".join(p.to_bytes(4, "big") for p in prev))
    return b"".join(out)


def aes_unwrap(key: bytes, data: bytes) -> bytes:
    """IV in front, PKCS#7 behind; what does not fit is returned as it is."""
    if len(data) < 32 or len(data) % 16:
        return data if len(data) != 16 else b""
    out = cbc_decrypt(key, data[:16], data[16:])
    fill = out[-1]
    return out[:-fill] if 1 <= fill <= 16 and out.endswith(bytes([fill]) * fill) else data


def pad(password: bytes) -> bytes:
    return (password + PAD)[:32]


@lru_cache(256)
def hash_r6(password: bytes, salt: bytes, extra: bytes) -> bytes:
    """At least 64 rounds of SHA-2 over AES; the same inputs are hashed once per worker."""
    k, i = hashlib.sha256(password + salt + extra).digest(), 0
    while True:
        e = cbc_encrypt(k[:16], k[16:32], (password + k + extra) * 64)
        k = (hashlib.sha256, hashlib.sha384, hashlib.sha512)[sum(e[:16]) % 3](e).digest()
        i += 1
        if i >= 64 and e[-1] <= i - 32:
            return k[:32]


def user_key(password: bytes, o: bytes, p: int, file_id: bytes, revision: int, length: int, clear_meta: bool) -> bytes:
    h = hashlib.md5(pad(password) + o[:32] + (p & 0xFFFFFFFF).to_bytes(4, "little") + file_id + (b"\xff" * 4 if revision >= 4 and clear_meta else b"")).digest()
    for _ in range(50 if revision >= 3 else 0):
        h = hashlib.md5(h[:length]).digest()
    return h[:length]


def user_entry(key: bytes, file_id: bytes, revision: int) -> bytes:
    if revision == 2:
        return rc4(key, PAD)
    out = rc4(key, hashlib.md5(PAD + file_id).digest())
    for i in range(1, 20):
        out = rc4(bytes(b ^ i for b in key), out)
    return out


def owner_rounds(password: bytes, revision: int, length: int) -> list[bytes]:
    """The keys that an owner entry is encrypted with, in order."""
    h = hashlib.md5(pad(password)).digest()
    for _ in range(50 if revision >= 3 else 0):
        h = hashlib.md5(h[:length]).digest()
    return [bytes(b ^ i for b in h[:length]) for i in range(20 if revision >= 3 else 1)]


class Decryptor:
    """Decrypts the objects of one document; raises BadPassword if none fits."""

    def __init__(self, encrypt: dict, file_id: bytes, password: bytes):
        if encrypt.get("Filter") != "Standard":
            raise PdfError("Unsupported", "security handler")
        v, self.revision = as_int(encrypt.get("V")) or 0, as_int(encrypt.get("R")) or 0
        self.o, self.u = encrypt.get("O"), encrypt.get("U")
        if not isinstance(self.o, bytes) or not isinstance(self.u, bytes):
            raise PdfError("Unsupported", "encryption dictionary")
        self.method = {5: "AESV3", 4: self._filter_method(encrypt)}.get(v, "V2")
        if v >= 5:
            self.key = self._key_r5(encrypt, password[:127])
        else:
            length = (as_int(encrypt.get("Length")) or (128 if v == 4 else 40)) // 8
            length = 5 if self.revision == 2 else max(5, min(16, length))
            p, clear = as_int(encrypt.get("P")) or 0, encrypt.get("EncryptMetadata") is False
            self.key = self._key_r4(password, p, file_id, length, clear)

    @staticmethod
    def _filter_method(encrypt: dict) -> str:
        crypt = as_dict((as_dict(encrypt.get("CF")) or {}).get("StdCF")) or {}
        return {"AESV2": "AESV2", "AESV3": "AESV3"}.get(crypt.get("CFM"), "V2")

    def _fits(self, key: bytes, file_id: bytes) -> bool:
        want = user_entry(key, file_id, self.revision)
        return self.u[:16] == want[:16]

    def _key_r4(self, password: bytes, p: int, file_id: bytes, length: int, clear: bool) -> bytes:
        key = user_key(password, self.o, p, file_id, self.revision, length, clear)
        if self._fits(key, file_id):
            return key
        user = self.o[:32]
        for k in reversed(owner_rounds(password, self.revision, length)):
            user = rc4(k, user)
        key = user_key(user, self.o, p, file_id, self.revision, length, clear)
        if self._fits(key, file_id):
            return key
        raise PdfError("BadPassword", "no password fits")

    def _key_r5(self, encrypt: dict, password: bytes) -> bytes:
        o, u = self.o[:48], self.u[:48]

        def digest(salt: bytes, extra: bytes) -> bytes:
            return hash_r6(password, salt, extra) if self.revision >= 6 else hashlib.sha256(password + salt + extra).digest()

        for entry, wrapped, extra in ((u, encrypt.get("UE"), b""), (o, encrypt.get("OE"), u)):
            if isinstance(wrapped, bytes) and digest(entry[32:40], extra) == entry[:32]:
                return cbc_decrypt(digest(entry[40:48], extra), bytes(16), wrapped[:32])
        raise PdfError("BadPassword", "no password fits")

    def object_key(self, ref: Ref) -> bytes:
        if self.method == "AESV3":
            return self.key
        salt = b"sAlT" if self.method == "AESV2" else b""
        h = hashlib.md5(self.key + ref.num.to_bytes(4, "little")[:3] + ref.gen.to_bytes(4, "little")[:2] + salt).digest()
        return h[: min(16, len(self.key) + 5)]

    def bytes_of(self, data: bytes, key: bytes) -> bytes:
        return rc4(key, data) if self.method == "V2" else aes_unwrap(key, data)

    def object(self, x, ref: Ref):
        return self._walk(x, self.object_key(ref))

    def _walk(self, x, key: bytes):
        if type(x) is bytes:
            return self.bytes_of(x, key)
        if type(x) is list:
            return [self._walk(y, key) for y in x]
        if type(x) is dict:
            return {k: self._walk(y, key) for k, y in x.items()}
        if isinstance(x, Stream):
            if x.dict.get("Type") == Name("XRef"):
                return x
            return Stream(self._walk(x.dict, key), self.bytes_of(x.data, key))
        return x
