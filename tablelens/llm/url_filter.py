"""URL filters: a blocked Bloom filter of listed canonical URLs, then an exact hash join.

A list entry is (host, path, verdict) with canonical form host + path, e.g. ``example.net/en/``. It fits a
URL if the URL's host is the entry's or a subdomain of it and the URL's path starts with the entry's. So a
URL's keys are its host's suffixes at dots, each with the path prefixes of the listed lengths. The filter
(256-bit blocks, one bit in each of eight words) drops nearly all keys that aren't listed; those it passes
go to a hash join with the list, which removes false positives. The longest entry wins (ties: the longer
host, then the later in code point order; an entry listed twice has its greater verdict); a URL that none fits gets ``default``.

The filter's size is the list's, and never above ``max_filter_bytes`` (a fuller filter passes more keys to
the join, which stays exact), so what is broadcast is bounded. URLs are judged once per distinct (host,
path), so repeated pages and hot hosts shrink before the join.

Defined results: a null URL or one without ``://`` has an empty host and path and gets ``default``;
repeated rows are judged each; an empty list or table works.
"""

from __future__ import annotations

import string

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_SALTS = np.array([0x47B6137B, 0x44974D91, 0x8824AD5B, 0xA2B7289D, 0x705495C7, 0x2DF1424B, 0x9EFC4947, 0x5C6BFB31],
                  dtype=np.uint64)  # fixed: eight odd multipliers


def host_and_path(url: str = "url"):
    """Columns (host, path) of a URL column."""
    u = F.col(f"`{url}`")
    at = F.instr(u, "://")
    rest = F.when(at > 0, F.expr(f"substring(`{url}`, instr(`{url}`, '://') + 3)")).otherwise("")
    raw = F.regexp_extract(rest, r"^[^/?#]*", 0)
    stem = F.regexp_extract(rest, r"^[^?#]*", 0)
    host = F.translate(raw, string.ascii_uppercase, string.ascii_lowercase)
    return F.coalesce(host, F.lit("")), F.coalesce(F.substring(stem, F.length(raw) + 1, F.length(stem)), F.lit(""))


def _places(hashes: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """The block of each hash and its eight one-bit words."""
    block = ((hashes >> np.uint64(32)) * np.uint64(blocks)) >> np.uint64(32)
    low = hashes & np.uint64(0xFFFFFFFF)
    bit = ((low[:, None] * _SALTS[None, :]) & np.uint64(0xFFFFFFFF)) >> np.uint64(27)
    return block.astype(np.int64), (np.uint64(1) << bit).astype(np.uint32)


def _hashes(keys: list[str]) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(k.encode("utf-8", "replace")) for k in keys], dtype=np.uint64)


def bloom_filter(rules: DataFrame, bits_per_key: int = 16, max_filter_bytes: int = 16 << 20) -> np.ndarray:
    """The filter of the ``rule`` column, (blocks, 8) uint32. Tasks set bits; blocks meet by bitwise OR."""
    n = rules.count()
    blocks = max(1, min(max_filter_bytes // 32, -(-n * bits_per_key // 256)))

    def bits(frames):
        for f in frames:
            if len(f):
                block, words = _places(_hashes(f["rule"].tolist()), blocks)
                own, inv = np.unique(block, return_inverse=True)
                out = np.zeros((len(own), 8), dtype=np.uint32)
                np.bitwise_or.at(out, inv, words)
                yield pd.DataFrame({"block": own, **{f"w{i}": out[:, i].astype(np.int64) for i in range(8)}})

    rows = (rules.select("rule").mapInPandas(bits, "block long, " + ", ".join(f"w{i} long" for i in range(8)))
            .groupBy("block").agg(*[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(8)]).toPandas())
    out = np.zeros((blocks, 8), dtype=np.uint32)
    if len(rows):
        out[rows["block"].to_numpy()] = rows[[f"w{i}" for i in range(8)]].to_numpy().astype(np.uint32)
    return out


def keys_of(host: str, path: str, lengths: list[int]) -> list[tuple[str, int]]:
    """(key, length of its host) of every listed form that could fit."""
    parts = host.split(".") if host else []
    hosts = [".".join(parts[i:]) for i in range(len(parts))]
    return [(h + path[:n], len(h)) for h in hosts for n in lengths if n <= len(path)]


def possible_hits(urls: DataFrame, filter_: np.ndarray, lengths: list[int]) -> DataFrame:
    """(host, path, rule, host_len): the keys of distinct URLs that the filter passes."""
    sent = urls.sparkSession.sparkContext.broadcast(filter_)

    def run(frames):
        table = sent.value
        for f in frames:
            found: list[tuple] = []
            for host, path in zip(f["host"], f["path"]):
                found += [(host, path, k, n) for k, n in keys_of(host, path, lengths)]
            if found:
                block, words = _places(_hashes([x[2] for x in found]), len(table))
                passes = ((table[block] & words) == words).all(axis=1)
                yield pd.DataFrame([x for x, ok in zip(found, passes) if ok], columns=["host", "path", "rule", "host_len"])

    return urls.mapInPandas(run, "host string, path string, rule string, host_len int")


def filter_urls(pages: DataFrame, rules: DataFrame, url_col: str = "url", default: str = "allow",
                bits_per_key: int = 16, max_filter_bytes: int = 16 << 20) -> DataFrame:
    """``pages`` with host, path, rule (null: none) and verdict. ``rules``: (host, path, verdict)."""
    rules = (rules.groupBy(F.concat("host", "path").alias("rule"), F.length("host").alias("host_len"),
                           F.length("path").alias("path_len")).agg(F.max("verdict").alias("rule_verdict")))
    lengths = sorted(r[0] for r in rules.select("path_len").distinct().collect())  # no more than a path has characters
    host, path = host_and_path(url_col)
    judged = pages.drop("host", "path", "rule", "verdict").withColumns({"host": host, "path": path})
    hits = possible_hits(judged.select("host", "path").distinct(), bloom_filter(rules, bits_per_key, max_filter_bytes), lengths)
    best = (hits.join(rules.select("rule", "host_len", "rule_verdict"), ["rule", "host_len"])
            .groupBy("host", "path")
            .agg(F.max(F.struct(F.length("rule").alias("len"), "host_len", "rule", "rule_verdict")).alias("best"))
            .select("host", "path", F.col("best.rule").alias("rule"), F.col("best.rule_verdict").alias("rule_verdict")))
    return (judged.join(best, ["host", "path"], "left")
            .withColumn("verdict", F.coalesce("rule_verdict", F.lit(default))).drop("rule_verdict"))
