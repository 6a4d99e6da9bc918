"""Binary forms: variable-length integers, block descriptors and footers, checksums. Arrow-batched where Spark has none."""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

# Fixed values of the format.
SIGNATURE = b"ArC\x01"
# Fixed values of the 128-bit hash: its usual seed here, multipliers, and the steps of its rounds and of its end.
MURMUR_SEED = 0x725ACC55DADDCA55
MURMUR_C1, MURMUR_C2 = 0x87C37B91114253D5, 0x4CF5AD432745937F
MURMUR_ADD = (0x52DCE729, 0x38495AB5)
MURMUR_MIX = (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53)


def encode_varint(value: int) -> bytes:
    """The number of trailing ones of the first byte tells how many bytes follow it; nine bytes begin with 0xFF."""
    for size in range(1, 9):
        if value < 1 << (7 * size):
            return (value << size | (1 << (size - 1)) - 1).to_bytes(size, "little")
    return b"\xff" + value.to_bytes(8, "little")


def decode_varint(data: bytes, at: int = 0) -> tuple[int, int]:
    """The value at ``at`` and where the next byte stands. Bytes behind the value never count."""
    first = data[at]
    size = 1
    while size < 9 and first >> (size - 1) & 1:
        size += 1
    raw = data[at : at + size]
    if len(raw) < size:
        raise ValueError("the integer is cut off")
    if size == 9:
        return int.from_bytes(raw[1:], "little"), at + 9
    return int.from_bytes(raw, "little") >> size, at + size


def write_block(kind: int, compressor: str, original: int, compressed: int, crc: int) -> bytes:
    """A block descriptor: signature, kind, compressor as a zero-ended string, sizes, CRC of the data, CRC of itself."""
    body = SIGNATURE + encode_varint(kind) + compressor.encode() + b"\0" + encode_varint(original) + encode_varint(compressed) + struct.pack("<I", crc)
    return body + struct.pack("<I", zlib.crc32(body))


def read_block(data: bytes, at: int = 0) -> tuple[dict, int]:
    """A block descriptor and where the next byte stands; its own CRC is checked."""
    begin = at
    if data[at : at + 4] != SIGNATURE:
        raise ValueError(f"no block signature at {at}")
    kind, at = decode_varint(data, at + 4)
    end = data.index(b"\0", at)
    compressor = data[at:end].decode()
    original, at = decode_varint(data, end + 1)
    compressed, at = decode_varint(data, at)
    crc, own = struct.unpack_from("<II", data, at)
    if zlib.crc32(data[begin : at + 4]) != own:
        raise ValueError("the descriptor's CRC doesn't match")
    return {"kind": kind, "compressor": compressor, "original": original, "compressed": compressed, "crc": crc}, at + 8


def write_footer(blocks: list[tuple[bytes, int]], locked: bool, comment: str, recovery: str) -> bytes:
    """A footer: the number of blocks, each descriptor with its distance back, the lock, comment and recovery texts."""
    out = encode_varint(len(blocks))
    for descriptor, distance in blocks:
        out += descriptor + encode_varint(distance)
    return out + encode_varint(int(locked)) + comment.encode() + b"\0" + recovery.encode() + b"\0"


def read_footer(data: bytes) -> dict:
    n, at = decode_varint(data)
    blocks = []
    for _ in range(n):
        block, at = read_block(data, at)
        block["distance"], at = decode_varint(data, at)
        blocks.append(block)
    locked, at = decode_varint(data, at)
    end = data.index(b"\0", at)
    last = data.index(b"\0", end + 1)
    return {"blocks": blocks, "locked": bool(locked), "comment": data[at:end].decode(), "recovery": data[end + 1 : last].decode()}


def find_signatures(data: bytes, window: int = 4096) -> list[int]:
    """Offsets of all signatures in the last ``window`` bytes."""
    base = max(0, len(data) - window)
    out, at = [], data.find(SIGNATURE, base)
    while at >= 0:
        out.append(at)
        at = data.find(SIGNATURE, at + 1)
    return out


def byte_codes(data: Column) -> Column:
    """The bytes as an array of numbers."""
    raw = F.hex(data)
    codes = F.transform(F.sequence(F.lit(1), F.octet_length(data)), lambda i: F.conv(F.substr(raw, 2 * i - 1, F.lit(2)), 16, 10).cast("long"))
    return F.when(F.octet_length(data) > 0, codes).when(data.isNotNull(), F.array().cast("array<long>"))


def adler_sums(codes: Column) -> tuple[Column, Column]:
    """The sum of the bytes, and that of each byte times the number of bytes from it on."""
    zero, n = F.lit(0).cast("long"), F.size(codes)
    plus = lambda s, x: s + x
    return F.aggregate(codes, zero, plus), F.aggregate(F.transform(codes, lambda x, i: (n - i) * x), zero, plus)


def adler32(data: Column) -> Column:
    total, weighted = adler_sums(byte_codes(data))
    return (F.octet_length(data) + weighted) % 65521 * 65536 + (1 + total) % 65521


def _low_first(raw: Column, size: int) -> Column:
    """Hexadecimal digits of ``size`` bytes in the other order."""
    return F.concat(*(F.substring(raw, 2 * k - 1, 2) for k in range(size, 0, -1)))


def _swap_digits(x: Column) -> Column:
    """A long whose bytes have their two hexadecimal digits in the other order."""
    low = F.lit(0x0F0F0F0F0F0F0F0F)
    return F.shiftleft(x.bitwiseAND(low), 4).bitwiseOR(F.shiftrightunsigned(x, 4).bitwiseAND(low))


def _low_digits(x: Column) -> Column:
    """The 16 hexadecimal digits of a long, the low byte first: all digits in the other order, each byte's two in theirs."""
    return F.reverse(F.lpad(F.hex(_swap_digits(x)), 16, "0"))


def _low_long(digits: Column) -> Column:
    """The long of up to 16 hexadecimal digits, the low byte first."""
    return _swap_digits(F.conv(F.reverse(F.rpad(digits, 16, "0")), 16, -10).cast("long"))


def _first_case(cases: list[tuple[Column, int]], otherwise: int) -> Column:
    out = F
    for condition, value in cases:
        out = out.when(condition, F.lit(value))
    return out.otherwise(F.lit(otherwise))


def varint_hex(value: Column) -> Column:
    """A non-negative integer in the format of ``encode_varint``, as hexadecimal."""
    v = value.cast("long")
    size = _first_case([(v < F.lit(1 << (7 * k)), k) for k in range(1, 9)], 9)
    packed = F.call_function("shiftleft", v, size).bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), size - 1) - 1)
    digits = F.substring(_low_digits(F.when(size == 9, v).otherwise(packed)), F.lit(1), 2 * size)
    return F.concat(F.when(size == 9, "FF").otherwise(""), digits)


def varint_bytes(value: Column) -> Column:
    return F.unhex(varint_hex(value))


def varint_value(data: Column) -> Column:
    """The integer at the start of some bytes; null if they are too few."""
    raw = F.hex(data)
    first = _low_long(F.substring(raw, 1, 16))
    size = _first_case([(first.bitwiseAND((1 << k) - 1) == (1 << (k - 1)) - 1, k) for k in range(1, 9)], 9)
    # the bytes behind the integer go to the left, its own bits for the size to the right
    short = F.call_function("shiftrightunsigned", F.call_function("shiftleft", first, 64 - 8 * size), 64 - 7 * size)
    return F.when(F.octet_length(data) >= size, F.when(size == 9, _low_long(F.substring(raw, 3, 16))).otherwise(short))


def u32_list(values: Column) -> Column:
    """Numbers below 2**32 as four bytes each, the low one first, as hexadecimal."""
    return F.array_join(F.transform(values, lambda v: _low_first(F.lpad(F.hex(v.cast("long")), 8, "0"), 4)), "")


def take_u32_list(raw: Column) -> Column:
    """The numbers that hexadecimal digits of ``u32_list`` hold."""
    at = F.sequence(F.lit(1), F.length(raw), F.lit(8))
    numbers = F.transform(at, lambda i: F.conv(_low_first(F.substr(raw, i, F.lit(8)), 4), 16, 10).cast("long"))
    return F.when(F.length(raw) > 0, numbers).otherwise(F.array().cast("array<long>"))


def cstring_list(values: Column) -> Column:
    """Texts, each ended by a zero byte, as hexadecimal."""
    return F.array_join(F.transform(values, lambda v: F.concat(F.hex(v.cast("binary")), F.lit("00"))), "")


def take_cstring_list(raw: Column) -> Column:
    """The texts that hexadecimal digits of ``cstring_list`` hold."""
    return F.transform(F.regexp_extract_all(raw, F.lit("((?:(?!00)..)*)00"), 1), lambda x: F.unhex(x).cast("string"))


def hmac_sha256(text: Column, key: bytes) -> Column:
    """The keyed digest of a text as hexadecimal; the two pads of the key are literals."""
    short = key if len(key) <= 64 else hashlib.sha256(key).digest()
    inner, outer = (F.lit(bytes(b ^ pad for b in short.ljust(64, b"\0"))) for pad in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, text.cast("binary")), 256))), 256)


def _turn(x: np.ndarray, bits: int) -> np.ndarray:
    return x << np.uint64(bits) | x >> np.uint64(64 - bits)


def murmur3_many(data: list[bytes], seed: int = MURMUR_SEED) -> list[bytes]:
    """128-bit hashes of some byte strings; block after block, each for all strings that are long enough."""
    c1, c2 = np.uint64(MURMUR_C1), np.uint64(MURMUR_C2)
    lengths = np.array([len(b) for b in data], np.int64)
    size = int(lengths.max(initial=0)) // 16 * 16 + 16
    words = np.frombuffer(b"".join(b.ljust(size, b"\0") for b in data), "<u8").reshape(len(data), size // 8)
    h = [np.full(len(data), seed, np.uint64) for _ in range(2)]

    def mixed_in(k: int) -> list[np.ndarray]:
        return [_turn(words[:, 2 * k] * c1, 31) * c2, _turn(words[:, 2 * k + 1] * c2, 33) * c1]

    for k in range(size // 16 - 1):
        a, b = mixed_in(k)
        first = (_turn(h[0] ^ a, 27) + h[1]) * np.uint64(5) + np.uint64(MURMUR_ADD[0])
        second = (_turn(h[1] ^ b, 31) + first) * np.uint64(5) + np.uint64(MURMUR_ADD[1])
        full = lengths // 16 > k
        h = [np.where(full, first, h[0]), np.where(full, second, h[1])]
    rest = np.zeros((len(data), 2), np.uint64)
    for i, b in enumerate(data):
        rest[i] = np.frombuffer(b[len(b) // 16 * 16 :].ljust(16, b"\0"), "<u8")
    n = lengths.astype(np.uint64)
    a, b = h[0] ^ _turn(rest[:, 0] * c1, 31) * c2 ^ n, h[1] ^ _turn(rest[:, 1] * c2, 33) * c1 ^ n
    a = a + b
    b = b + a
    ends = []
    for x in (a, b):
        for m in MURMUR_MIX:
            x = (x ^ x >> np.uint64(33)) * np.uint64(m)
        ends.append(x ^ x >> np.uint64(33))
    a = ends[0] + ends[1]
    return [x.tobytes() for x in np.stack([a, ends[1] + a], axis=1).astype("<u8")]


@F.pandas_udf(BinaryType())
def murmur3_128(data: pd.Series) -> pd.Series:
    there = data.notna()
    out = pd.Series([None] * len(data), index=data.index, dtype=object)
    out[there] = murmur3_many([bytes(b) for b in data[there]])
    return out


def cstring(text: Column) -> Column:
    return F.concat(text.cast("binary"), F.lit(b"\0"))


def u32(value: Column) -> Column:
    """Four bytes of a number below 2**31, the low one first."""
    return F.unhex(F.concat(*(F.lpad(F.hex(F.shiftright(value.cast("long"), 8 * k).bitwiseAND(255)), 2, "0") for k in range(4))))


def flag(value: Column) -> Column:
    return F.when(value, F.lit(b"\x01")).otherwise(F.lit(b"\0"))


def take_cstring(data: Column) -> tuple[Column, Column]:
    """The text before the first zero byte, and what follows that byte."""
    head = "^((?:(?!00)..)*)00"
    return F.unhex(F.regexp_extract(F.hex(data), head, 1)).cast("string"), F.unhex(F.regexp_replace(F.hex(data), head, ""))


def take_u32(data: Column) -> Column:
    """The number in the first four bytes, the low one first."""
    raw = F.hex(data)
    return F.conv(F.concat(*(F.substring(raw, 2 * k + 1, 2) for k in (3, 2, 1, 0))), 16, 10).cast("int")
