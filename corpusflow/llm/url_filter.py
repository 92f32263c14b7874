"""URL verdicts: explicit rules first, then a list that is searched as a sorted digest array."""

from __future__ import annotations

import os
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusflow.llm.common import batches, part
from corpusflow.session import shared_folder

#: Bytes of list entries in one array. A longer list is searched array by array.
ARRAY_BYTES = 64_000_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host and path behind the first ``://``; both empty for null and without one."""
    url = F.coalesce(url, F.lit(""))
    pattern = F.lit(r"(?s)\A.*?://([^/?#]*)([^?#]*)")
    host = F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)([^?#]*)", 1)
    path = F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)([^?#]*)", 2)
    known = F.regexp_like(url, pattern)
    return F.when(known, F.translate(host, UPPER, LOWER)).otherwise(""), F.when(known, path).otherwise("")


def fits(host: Column, path: Column, rule: str) -> Column:
    """Whether a rule ``host/path`` fits: its host or a subdomain, and a path that begins so."""
    rule_host, slash, rule_path = rule.partition("/")
    return ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(slash + rule_path)


def digest_array(entries: Sequence[str]) -> bytes:
    """``entries`` as an Arrow file: 64-bit keys in ascending order beside the strings."""
    entries = sorted(set(entries))
    keys = np.array([xxhash.xxh64_intdigest(e) for e in entries], np.uint64)
    order = np.argsort(keys, kind="stable")
    rows = pa.table({"key": pa.array(keys[order]), "entry": pa.array([entries[i] for i in order], pa.string())})
    rows = rows.combine_chunks()
    out = pa.BufferOutputStream()
    with pa.ipc.new_file(out, rows.schema) as writer:
        writer.write_table(rows)
    return out.getvalue().to_pybytes()


def shipped(spark: SparkSession, data: bytes) -> str:
    """Write a file to the shared folder and have every executor fetch it; returns its name."""
    path = shared_folder(spark, "digests") + ".arrow"
    context = spark.sparkContext
    hadoop = context._jvm.org.apache.hadoop.fs.Path(path)
    out = hadoop.getFileSystem(context._jsc.hadoopConfiguration()).create(hadoop)
    out.write(bytearray(data))
    out.close()
    context.addFile(path)
    return os.path.basename(path)


class DigestArray:
    """A memory-mapped array of sorted keys: pages are read as they are probed."""

    def __init__(self, path: str):
        rows = pa.ipc.open_file(pa.memory_map(path)).read_all()
        self.entries = rows["entry"]
        self.keys = rows["key"].chunk(0).to_numpy() if len(rows) else np.zeros(0, np.uint64)

    def found(self, probes: Sequence[str]) -> np.ndarray:
        """Whether each probe is an entry: binary search for its key, then the whole string."""
        keys = np.array([xxhash.xxh64_intdigest(p) for p in probes], np.uint64)
        at = np.searchsorted(self.keys, keys)
        hit = np.zeros(len(keys), bool)
        # Keys may collide: look on while the key is the same.
        look = np.flatnonzero(at < len(self.keys))
        look = look[self.keys[at[look]] == keys[look]]
        while len(look):
            same = np.array(self.entries.take(pa.array(at[look])).to_pylist(), object) == np.array([probes[i] for i in look], object)
            hit[look[same]] = True
            look = look[~same]
            at[look] += 1
            look = look[at[look] < len(self.keys)]
            look = look[self.keys[at[look]] == keys[look]]
        return hit


def probes(host: str, path: str) -> list[str]:
    """What may stand in the list for a URL: host with path, host, and each parent domain."""
    parts = host.split(".") if host else []
    return ([host + path] if host and path else []) + [".".join(parts[k:]) for k in range(len(parts))]


def listed(urls: DataFrame, entries: DataFrame) -> DataFrame:
    """``urls`` (with ``host`` and ``path``) and ``entry``, the longest entry of the list that fits.

    ``entries`` has one string column; nulls and empty strings are left out. The list is cut by
    hash into arrays of at most about ``ARRAY_BYTES``, each of which is shipped to the executors
    as a file; ``urls`` are scanned once and probe each array in turn, without a shuffle.
    """
    spark = urls.sparkSession
    name = entries.columns[0]
    entries = entries.where(F.length(name) > 0).select(F.col(name).alias("entry")).distinct()
    size = entries.agg(F.sum(F.octet_length("entry") + 16)).first()[0] or 0
    parts = -(-size // ARRAY_BYTES)
    rows = urls.withColumn("entry", F.lit(None).cast("string"))
    for k in range(parts):
        block = entries.where(part(F.col("entry"), parts) == k).toArrow()["entry"].to_pylist()
        rows = _probe(rows, shipped(spark, digest_array(block)))
    return rows


def _probe(rows: DataFrame, file: str) -> DataFrame:
    names = rows.columns

    def each(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        array = DigestArray(SparkFiles.get(file))
        for b in batches(it):
            of = {n: b.column(k) for k, n in enumerate(names)}
            asked = [probes(h, p) for h, p in zip(of["host"].to_pylist(), of["path"].to_pylist())]
            flat = [x for xs in asked for x in xs]
            hit = iter(array.found(flat).tolist())
            best = [
                max([e] * (e is not None) + [x for x in xs if next(hit)], key=lambda x: (len(x), x), default=None)
                for e, xs in zip(of["entry"].to_pylist(), asked)
            ]
            of["entry"] = pa.array(best, pa.string())
            yield pa.record_batch(list(of.values()), list(of))

    return rows.mapInArrow(each, rows.schema)


def judge(pages: DataFrame, entries: DataFrame, rules: dict[str, str]) -> DataFrame:
    """``(page_id, host, path, rule, verdict, entry)`` of each row of ``pages``.

    ``rules``: ``host/path`` to ``allow`` or ``block``; the longest that fits decides. Without one,
    a URL with an entry in the list is blocked and any other allowed. A null or broken URL has
    an empty host and path, so no rule and no entry.
    """
    host, path = host_and_path(F.col("url"))
    urls = pages.select("page_id", host.alias("host"), path.alias("path"))
    rows = listed(urls, entries)
    order = sorted(rules, key=lambda r: (-len(r), r))
    rule = F.coalesce(*(F.when(fits(F.col("host"), F.col("path"), r), F.lit(r)) for r in order), F.lit(None).cast("string"))
    verdict = F.coalesce(
        F.element_at(F.create_map(*(F.lit(x) for r in order for x in (r, rules[r]))), rule) if rules else F.lit(None),
        F.when(F.col("entry").isNotNull(), F.lit("block")).otherwise(F.lit("allow")),
    )
    return rows.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("verdict"), "entry")


def hosts_named(pages: DataFrame, names: Sequence[str]) -> DataFrame:
    """A block list from a crawl: the domains below which a listed name is a label, as ``(entry)``."""
    host, _ = host_and_path(F.col("url"))
    domain = F.regexp_extract(host, rf"(?:^|\.)((?:{'|'.join(names)})\..+)$", 1)
    return pages.select(domain.alias("entry")).where("entry != ''").distinct()
