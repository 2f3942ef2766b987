"""URL filtering by a sorted digest array.

Rules are ``host/path`` strings with an action. Their 64-bit XXH64 keys are sorted into one array, beside
the full strings. A worker maps the array into memory, forms for each url every string that a rule could
have (a suffix of the host by labels, and a prefix of the path of a length that some rule has), finds
their keys by a vectorised binary search, and confirms the stored string, so that a collision of keys
never decides.

The array is broadcast only while it is under ``MOST_BYTES``; a larger rule set is joined by key instead
(``judge_urls_by_join``), with the same candidates and the same result.

Defined cases: a null url, or one without ``://``, has an empty host and path and fits no rule; equal urls
get equal rows; of several rules that fit, the longest string wins, and among equally long ones the one
with the longer host; with no rule the verdict is ``default`` (a block list allows what it does not hold). Very long urls are read
whole: only prefixes of a length that some rule has are formed. An empty table gives no rows; other columns, whatever
their names, are not read.
"""

from __future__ import annotations

import os
import re
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship, slices

MOST_BYTES = 256 << 20
_URL = re.compile(r"://([^/?#]*)([^?#]*)", re.S)
_LOWER = {c: c + 32 for c in range(65, 91)}


def split_rule(rule: str) -> tuple[str, str]:
    host, slash, path = rule.partition("/")
    return host, slash + path


def split_url(url: str | None) -> tuple[str, str]:
    m = _URL.search(url) if url else None
    return (m[1].translate(_LOWER), m[2]) if m else ("", "")


def _key(text: str) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"))


class DigestArray:
    """Sorted keys, the strings they stand for, and the shapes (labels of the host, length of the path) that occur."""

    def __init__(self, rules: dict[str, str]):
        keyed = sorted((_key(r), r, a) for r, a in rules.items())
        self.keys = np.array([k for k, _, _ in keyed], "<u8")
        self.rules = [r for _, r, _ in keyed]
        self.actions = [a for _, _, a in keyed]
        self.shapes = sorted({(h.count(".") + 1, len(p)) for h, p in map(split_rule, rules)})

    def nbytes(self) -> int:
        return self.keys.nbytes + sum(len(r.encode()) + len(a) + 16 for r, a in zip(self.rules, self.actions))

    def mapped(self) -> np.ndarray:
        """The keys as a read-only map of a file that has no name any more, so that nothing stays behind."""
        if not len(self.keys):
            return self.keys
        fd, name = tempfile.mkstemp(prefix="digests-")
        with os.fdopen(fd, "wb") as f:
            self.keys.tofile(f)
        keys = np.memmap(name, "<u8", "r")
        os.unlink(name)
        return keys

    def candidates(self, host: str, path: str) -> list[str]:
        """Strings that a rule for this url could be, best first."""
        if not host:
            return []
        labels = host.split(".")
        found = [".".join(labels[-n:]) + path[:p] for n, p in self.shapes if n <= len(labels) and p <= len(path)]
        return sorted(found, key=len, reverse=True) if len(found) > 1 else found

    def probe(self, keys: np.ndarray, hosts: list[str], paths: list[str]) -> list[int]:
        """For each url the place of its rule, or -1."""
        owners, strings = [], []
        for i, (h, p) in enumerate(zip(hosts, paths)):
            c = self.candidates(h, p)
            strings += c
            owners += [i] * len(c)
        out = [-1] * len(hosts)
        wanted = np.fromiter(map(_key, strings), "<u8", len(strings))
        first = np.searchsorted(keys, wanted, "left")
        last = np.searchsorted(keys, wanted, "right")
        for c in np.flatnonzero(last > first).tolist():
            for k in range(first[c], last[c]):
                if self.rules[k] == strings[c] and (out[owners[c]] < 0 or self.better(k, out[owners[c]])):
                    out[owners[c]] = k
        return out

    def better(self, a: int, b: int) -> bool:
        x, y = self.rules[a], self.rules[b]
        return (len(x), len(split_rule(x)[0])) > (len(y), len(split_rule(y)[0]))


_SCHEMA = "page_id long, host string, path string, rule string, verdict string"


def judge_urls(pages: DataFrame, rules: dict[str, str], default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule and verdict of every row; rules: string -> action."""
    spark = pages.sparkSession
    ship(spark)
    array = DigestArray(rules)
    if array.nbytes() > MOST_BYTES:
        return judge_urls_by_join(pages, spark.createDataFrame(sorted(rules.items()), "rule string, action string"), default, id_col, url_col)
    sent = spark.sparkContext.broadcast(array)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, keys = sent.value, sent.value.mapped()
        for b in slices(batches, "url"):
            parts = [split_url(u) for u in b.column("url").to_pylist()]
            hosts, paths = [h for h, _ in parts], [p for _, p in parts]
            at = index.probe(keys, hosts, paths)
            rule = [index.rules[k] if k >= 0 else None for k in at]
            verdict = [index.actions[k] if k >= 0 else default for k in at]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), *(pa.array(x, pa.string()) for x in (hosts, paths, rule, verdict))], names=["page_id", "host", "path", "rule", "verdict"])

    return pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url")).mapInArrow(run, _SCHEMA)


def judge_urls_by_join(pages: DataFrame, rules: DataFrame, default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """The same for a rule table (rule, action) of any size: candidates meet the rules in a shuffled join.

    Only distinct (host, path) pairs are expanded, so a host with very many pages is no hot key.
    """
    split = pages.select(
        F.col(id_col).cast("long").alias("page_id"),
        F.coalesce(F.translate(F.regexp_extract(F.col(url_col), r"(?s)://([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit("")).alias("host"),
        F.coalesce(F.regexp_extract(F.col(url_col), r"(?s)://[^/?#]*([^?#]*)", 1), F.lit("")).alias("path"),
    )
    shapes = rules.select((F.size(F.split(F.regexp_extract("rule", "^([^/]*)", 1), r"\.")).alias("labels")), F.length(F.regexp_extract("rule", "(?s)^[^/]*(.*)$", 1)).alias("chars")).distinct()
    shapes = shapes.agg(F.collect_set(F.struct("labels", "chars")).alias("shapes"))
    pairs = split.where("host <> ''").select("host", "path").distinct().join(F.broadcast(shapes))
    tried = pairs.select("host", "path", F.explode("shapes").alias("s")).where(F.col("s.chars") <= F.length("path"))
    labels = F.split("host", r"\.")
    tried = tried.where(F.col("s.labels") <= F.size(labels)).select(
        "host", "path", F.concat(F.array_join(F.slice(labels, F.size(labels) - F.col("s.labels") + 1, F.col("s.labels")), "."), F.substring("path", F.lit(1), F.col("s.chars"))).alias("rule")
    )
    best = tried.join(rules, "rule").groupBy("host", "path").agg(
        F.max(F.struct(F.length("rule").alias("n"), F.length(F.regexp_extract("rule", "^([^/]*)", 1)).alias("h"), "rule", "action")).alias("best")
    )
    return split.join(best, ["host", "path"], "left").select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.action", F.lit(default)).alias("verdict"))
