"""Content ids, FNV-1a, the tenant bucket, and the generator of pseudo-random numbers."""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

_M = (1 << 64) - 1


def content_id(data: bytes) -> str:
    """The first 16 hex digits of SHA-256."""
    return hashlib.sha256(data).hexdigest()[:16]


def fnv1a64(data: bytes, seed: int = 0) -> int:
    h = 0xCBF29CE484222325 ^ seed
    for b in data:
        h = ((h ^ b) * 0x100000001B3) & _M
    return h


def tenant_bucket(tenant: Column, buckets: int = 16) -> Column:
    """The first four bytes of SHA-256, little-endian, modulo the number of buckets."""
    h = F.sha2(tenant.cast("binary"), 256)
    little = F.concat(*[F.substring(h, i, 2) for i in (7, 5, 3, 1)])
    return (F.conv(little, 16, 10).cast("long") % buckets).cast("int")


def day_window(event_time: Column, width: int = 86_400_000) -> Column:
    """Start of the window that holds an epoch in ms; floors below zero too."""
    return event_time - F.pmod(event_time, F.lit(width).cast("long"))


def content_hash(columns: list[str]) -> Column:
    """SHA-256 of a row's columns, with nulls told apart from texts; only equality and order matter."""
    return F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)


class Random:
    """xoshiro256++ seeded by splitmix64."""

    def __init__(self, seed: int) -> None:
        s, words = seed & _M, []
        for _ in range(4):
            s = (s + 0x9E3779B97F4A7C15) & _M
            z = s
            z = ((z ^ (z >> 30)) * 0xBF58476D1CE4E5B9) & _M
            z = ((z ^ (z >> 27)) * 0x94D049BB133111EB) & _M
            words.append(z ^ (z >> 31))
        self.s = words

    def next(self) -> int:
        s = self.s
        rot = lambda x, k: ((x << k) | (x >> (64 - k))) & _M
        out = (rot((s[0] + s[3]) & _M, 23) + s[0]) & _M
        t = (s[1] << 17) & _M
        s[2] ^= s[0]
        s[3] ^= s[1]
        s[1] ^= s[2]
        s[0] ^= s[3]
        s[2] ^= t
        s[3] = rot(s[3], 45)
        return out

    def float(self) -> float:
        return (self.next() >> 40) / (1 << 24)

    def below(self, n: int) -> int:
        return self.next() % n

    def array(self, n: int) -> np.ndarray:
        return np.array([self.float() for _ in range(n)])
