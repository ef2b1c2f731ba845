"""Addresses and their hashes as Catalyst expressions: 16-byte keys, 64-bit hashes, register index and rank, sparse codes."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

P_PRIME = 25
_OCTET = r"(25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
IPV4 = rf"^{_OCTET}(\.{_OCTET}){{3}}$"
_MAPPED = "00000000000000000000FFFF"


def is_ipv4(ip: Column) -> Column:
    return F.coalesce(ip.rlike(IPV4), F.lit(False))


def _hex_byte(text: Column) -> Column:
    return F.lpad(F.hex(F.try_to_number(text, F.lit("999")).cast("int")), 2, "0")


def _ipv4_hex(ip: Column) -> Column:
    octets = F.split(ip, r"\.")
    return F.concat(*[_hex_byte(octets[i]) for i in range(4)])


def _groups(ip: Column) -> tuple[Column, Column]:
    """The eight groups of an IPv6 text, and whether it is one; a dotted quad may end it."""
    quad = F.regexp_extract(ip, r"(\d+\.\d+\.\d+\.\d+)$", 1)
    tail = F.when(quad.rlike(IPV4), _ipv4_hex(quad))
    text = F.when(tail.isNotNull(), F.concat(F.regexp_replace(ip, r"\d+\.\d+\.\d+\.\d+$", ""), F.substring(tail, 1, 4), F.lit(":"), F.substring(tail, 5, 4))).otherwise(ip)
    halves = F.split(F.lower(text), "::", -1)
    left, right = (F.filter(F.split(F.coalesce(F.get(halves, F.lit(i)), F.lit("")), ":", -1), lambda x: x != "") for i in (0, 1))
    short = F.size(halves) == 2
    written = F.size(left) + F.size(right)
    groups = F.concat(left, F.array_repeat(F.lit("0"), F.greatest(F.lit(0), 8 - written)), right)
    colons = F.length(text) - F.length(F.replace(text, F.lit(":"), F.lit("")))
    fits = F.when(short, (written <= 7) & (colons == written + F.when(F.get(halves, F.lit(0)) == "", 1).otherwise(0) + F.when(F.get(halves, F.lit(1)) == "", 1).otherwise(0))).otherwise((F.size(halves) == 1) & (written == 8) & (colons == 7))
    return groups, F.coalesce(fits & F.forall(groups, lambda x: x.rlike("^[0-9a-f]{1,4}$")), F.lit(False))


def is_ipv6(ip: Column) -> Column:
    return F.when(F.coalesce(F.contains(ip, F.lit(":")), F.lit(False)), _groups(ip)[1]).otherwise(F.lit(False))


def is_ip(ip: Column) -> Column:
    return is_ipv4(ip) | is_ipv6(ip)


def ip_bytes(ip: Column) -> Column:
    """The 16-byte form of an address, IPv4 mapped into IPv6; null for a text that is no address."""
    groups, ok = _groups(ip)
    six = F.array_join(F.transform(groups, lambda x: F.lpad(x, 4, "0")), "")
    return F.unhex(F.when(is_ipv4(ip), F.concat(F.lit(_MAPPED), _ipv4_hex(ip))).when(F.contains(ip, F.lit(":")) & ok, six))


def sha_hash(raw: Column) -> Column:
    """The first eight bytes of SHA-256, big-endian, as a signed 64-bit number."""
    return F.conv(F.substring(F.sha2(raw, 256), 1, 16), 16, -10).cast("long")


@F.pandas_udf(LongType())
def xx_hash(raw: pd.Series) -> pd.Series:
    """XXH64 with seed 0, in Arrow batches; the built-in xxhash64 has another seed."""
    import numpy as np
    import xxhash

    found = np.array([0 if r is None else xxhash.xxh64_intdigest(r) for r in raw], np.uint64).view(np.int64)
    return pd.Series(pd.arrays.IntegerArray(found, raw.isna().to_numpy()))


HASHES = {"sha256": sha_hash, "xxhash": xx_hash}


def rho(w: Column, bits: int) -> Column:
    """The place of the first one among the low bits of w, counted from 1; bits + 1 if there is none."""
    return F.when(w == 0, bits + 1).otherwise(bits + 1 - F.length(F.bin(w)))


def low_bits(h: Column, bits: int) -> Column:
    return h.bitwiseAND(F.lit((1 << bits) - 1).cast("long"))


def register(h: Column, p: int) -> tuple[Column, Column]:
    """(index, rank): the top p bits and the rank of the rest."""
    return F.shiftrightunsigned(h, 64 - p).cast("int"), rho(low_bits(h, 64 - p), 64 - p).cast("int")


def sparse_slot(h: Column, p: int, p_prime: int = P_PRIME) -> tuple[Column, Column]:
    """(index of p' bits, rank of the rest): the rank is 0 where the index's low bits already give the dense rank."""
    index = F.shiftrightunsigned(h, 64 - p_prime)
    rest = F.least(rho(low_bits(h, 64 - p_prime), 64 - p_prime), F.lit(63))
    return index.cast("int"), F.when(low_bits(index, p_prime - p) == 0, rest).otherwise(0).cast("int")


def encode_slot(index: Column, rank: Column, p: int, p_prime: int = P_PRIME) -> Column:
    """An unsigned 32-bit code in a long: index, rank and 1, or index and 0."""
    index = index.cast("long")
    long_form = F.shiftleft(index, 7).bitwiseOR(F.shiftleft(rank.cast("long"), 1)).bitwiseOR(F.lit(1).cast("long"))
    return F.when(low_bits(index, p_prime - p) == 0, long_form).otherwise(F.shiftleft(index, 1))


def decode_slot(code: Column) -> tuple[Column, Column]:
    """(index of p' bits, rank) of a code; the rank is 0 in the short form."""
    flag = code.bitwiseAND(F.lit(1).cast("long")) == 1
    return F.when(flag, F.shiftright(code, 7)).otherwise(F.shiftright(code, 1)).cast("int"), F.when(flag, low_bits(F.shiftright(code, 1), 6)).otherwise(0).cast("int")


def dense_of(index: Column, rank: Column, p: int, p_prime: int = P_PRIME) -> tuple[Column, Column]:
    """(register, rank) of a sparse slot."""
    index = index.cast("long")
    zone = low_bits(index, p_prime - p)
    return F.shiftright(index, p_prime - p).cast("int"), F.when(zone == 0, rank + (p_prime - p)).otherwise(rho(zone, p_prime - p)).cast("int")


def int_to_ip(number: Column) -> Column:
    """The dotted quad of an unsigned 32-bit number."""
    return F.concat_ws(".", *[F.shiftright(number, s).bitwiseAND(255).cast("string") for s in (24, 16, 8, 0)])


def name_to_ip(name: Column) -> Column:
    """A fixed address for a source that is no address: a polynomial hash of its characters; octets 1 and 4 are odd."""
    codes = F.transform(F.filter(F.split(name, ""), lambda c: c != ""), lambda c: F.conv(F.hex(F.encode(c, "UTF-32")), 16, 10).cast("long"))
    h = F.aggregate(codes, F.lit(0).cast("long"), lambda a, c: low_bits(a * 31 + c, 32))
    octets = [low_bits(F.shiftright(h, s), 8) for s in (24, 16, 8, 0)]
    one = F.lit(1).cast("long")
    return F.concat_ws(".", *[(o.bitwiseOR(one) if i in (0, 3) else o).cast("string") for i, o in enumerate(octets)])


def fnv1a_ipv4(ip: Column) -> Column:
    """32-bit FNV-1a of an IPv4 address's four bytes; null for other texts."""
    octets = F.transform(F.split(ip, r"\."), lambda o: o.cast("long"))
    # FNV's offset and prime.  The product stays below 2^56.
    h = F.aggregate(octets, F.lit(2166136261).cast("long"), lambda a, o: low_bits(a.bitwiseXOR(o) * F.lit(16777619).cast("long"), 32))
    return F.when(is_ipv4(ip), h)


def fnv1a_text(text: Column, row: int) -> Column:
    """32-bit FNV-1a of a row's number (two bytes, low first) and an ASCII text."""
    codes = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))
    start = F.array(F.lit(row & 255).cast("long"), F.lit(row >> 8).cast("long"))
    return F.aggregate(F.concat(start, codes), F.lit(2166136261).cast("long"), lambda a, o: low_bits(a.bitwiseXOR(o) * F.lit(16777619).cast("long"), 32))
