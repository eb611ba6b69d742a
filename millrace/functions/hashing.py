"""FNV-1a hashes and name-based UUIDs as column expressions.

A 64-bit FNV product overflows a long, which ANSI mode forbids, so the state
is two 32-bit halves. With the prime 2^40 + 435:

    t = lo xor byte;  lo' = 435 t mod 2^32;  hi' = 435 hi + 256 t + carry mod 2^32
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_LOW = (1 << 32) - 1


def _bytes(text: Column) -> Column:
    """The UTF-8 bytes as longs, seven read from one number at a time; an empty text has none."""
    size = F.octet_length(text)
    starts = F.sequence(F.lit(0), F.greatest(size - 1, F.lit(0)), F.lit(7))
    seven = lambda h: F.transform(starts, lambda i: F.conv(F.rpad(F.substring(h, i * 2 + 1, F.lit(14)), 14, "0"), 16, 10).cast("long"))
    apart = lambda c: F.array(*(F.shiftright(c, 8 * (6 - j)).bitwiseAND(F.lit(255)) for j in range(7)))
    # in an array of one, so that the digits are made once for all lambdas that read them
    digits = F.transform(F.array(F.hex(F.encode(text, "UTF-8"))), lambda h: F.slice(F.flatten(F.transform(seven(h), apart)), F.lit(1), size))
    return F.get(digits, F.lit(0))


def _fnv(text: Column) -> Column:
    start = F.struct(F.lit(3421674724).cast("long").alias("hi"), F.lit(2216829733).cast("long").alias("lo"))

    def step(s: Column, b: Column) -> Column:
        t = s["lo"].bitwiseXOR(b)
        product = t * 435
        hi = (s["hi"] * 435 + t * 256 + F.shiftright(product, 32)).bitwiseAND(F.lit(_LOW))
        return F.struct(hi.alias("hi"), product.bitwiseAND(F.lit(_LOW)).alias("lo"))

    return F.aggregate(_bytes(text), start, step)


def fnv1a_hex(text: Column) -> Column:
    """16 lower-case hex digits; null for null."""
    s = _fnv(text)
    one = F.transform(F.array(s), lambda x: F.lower(F.concat(F.lpad(F.hex(x["hi"]), 8, "0"), F.lpad(F.hex(x["lo"]), 8, "0"))))
    return F.when(text.isNotNull(), F.get(one, F.lit(0)))


def fnv1a_mod(text: Column, modulus: int) -> Column:
    """The unsigned hash modulo ``modulus`` (under 2^31)."""
    one = F.transform(F.array(_fnv(text)), lambda x: ((x["hi"] % modulus) * ((1 << 32) % modulus) + x["lo"]) % modulus)
    return F.when(text.isNotNull(), F.get(one, F.lit(0)))


def partition_of(key: Column, partitions: int, is_integer: bool = False) -> Column:
    """The partition of a key: integers by value, all else by the hash of its text. A null key goes to any."""
    own = F.pmod(key.cast("long"), F.lit(partitions)) if is_integer else fnv1a_mod(key.cast("string"), partitions)
    return F.coalesce(own, F.floor(F.rand() * partitions).cast("long"))


def name_uuid(text: Column, namespace: str, version: int = 5) -> Column:
    """UUID version 5 (SHA-1) or 3 (MD5) of a name in a namespace."""
    data = F.concat(F.unhex(F.lit(namespace.replace("-", ""))), F.encode(text, "UTF-8"))
    h = F.substring(F.sha1(data) if version == 5 else F.md5(data), 1, 32)
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 1), 16, 10).cast("long").bitwiseAND(F.lit(3)).bitwiseOR(F.lit(8))))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit(str(version)), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))
