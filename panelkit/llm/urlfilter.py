"""URL rules looked up in a sorted array of digests that workers map into memory.

A rule is (host, path, verdict). It fits a url whose host is the rule's or a subdomain of
it and whose path begins with the rule's; of the rules that fit, the longest decides (then
the one with the longer host), and a url that none fits gets the default verdict.

The rules are kept as one file: their XXH64 digests in ascending order, the place of each
rule's string in the same order, and the strings. So a probe is a binary search in numbers
of eight bytes, vectorised over a batch, and a digest that is found is confirmed against
the stored string, over all rules with that digest: a collision costs a comparison and
never a verdict. Hosts are entries of the same array, each with the path lengths of its
rules, so a url is probed once per subdomain and then once per length that can occur there.

Digests are made by Spark, which sorts the entries by range; the driver passes them on to
the file a partition at a time. Spark copies the file to each executor once, whatever file
system holds it, and the executor's workers share its pages. No url is shuffled. A list
above ``MOST_BYTES`` is not copied: then url keys and rules are joined by digest and string.

Defined cases: a null url, or one without ``://``, has an empty host and path, which no
rule fits; rules with a null or empty host, path or verdict take no part; of equal (host,
path) with different verdicts the block holds; an empty list gives every url the default;
input columns called like an output are replaced, others stay.
"""

from __future__ import annotations

import os
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelkit.llm.common import extended, wrapped
from panelkit.session import shared_dir

#: Bytes of strings of a list that is copied to each executor.
MOST_BYTES = 4_000_000_000
#: Of Spark's and of our XXH64.
SEED = 42
MAGIC = b"urldigst"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The rules of the registered query.
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def url_parts(url: str = "url") -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url."""
    pattern = "(?s)^.*?://([^/?#]*)([^?#]*)"
    host, path = (F.coalesce(F.regexp_extract(F.col(f"`{url}`"), pattern, g), F.lit("")) for g in (1, 2))
    return F.translate(host, UPPER, LOWER), path


def usable_rules(rules: DataFrame) -> DataFrame:
    """(host, path, verdict), one row per host and path; hosts lower-cased."""
    some = rules.select(F.translate("host", UPPER, LOWER).alias("host"), "path", "verdict").filter("host <> '' and path <> '' and verdict <> ''")
    return some.groupBy("host", "path").agg(F.max("verdict").alias("verdict"))


def entries(rules: DataFrame) -> DataFrame:
    """(digest, key, value) in the order of unsigned digests. A rule's key is its host and
    path, which begins with a slash or not, so the two are told apart by a NUL; its value
    the verdict. A host's key is the host, its value the lengths of its paths."""
    keyed = rules.select(F.concat_ws("\0", "host", "path").alias("key"), F.col("verdict").alias("value"))
    lengths = F.array_sort(F.collect_set(F.length("path")))
    hosts = rules.groupBy("host").agg(F.concat_ws(",", F.transform(lengths, lambda n: n.cast("string"))).alias("value"))
    both = keyed.unionByName(hosts.select(F.col("host").alias("key"), "value"))
    # flipping the sign bit of a signed number sorts it as unsigned
    return both.withColumn("digest", F.xxhash64("key")).orderBy(F.col("digest").bitwiseXOR(F.lit(-(2**63)).cast("long")), "key")


def write_digests(sorted_entries: DataFrame, spark: SparkSession) -> str:
    """The array's file in the shared folder, in three streams that are joined at the end:
    digests, string borders, strings. The driver holds a partition's entries at a time."""
    path = f"{shared_dir(spark, 'url-digests')}/rules-{os.urandom(4).hex()}.bin"
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = jvm_path.getFileSystem(spark._jsc.hadoopConfiguration())
    parts = [spark._jvm.org.apache.hadoop.fs.Path(f"{path}.{k}") for k in range(3)]
    streams = [fs.create(p) for p in parts]
    n, at, buffers = 0, 0, [bytearray(), bytearray(), bytearray()]

    def flush(least: int) -> None:
        for s, b in zip(streams, buffers):
            if len(b) >= least:
                s.write(bytes(b))
                b.clear()

    buffers[1] += struct.pack("<q", 0)
    for r in sorted_entries.toLocalIterator(prefetchPartitions=False):
        stored = f"{r.key}\n{r.value}".encode()
        at += len(stored)
        n += 1
        buffers[0] += struct.pack("<q", r.digest)
        buffers[1] += struct.pack("<q", at)
        buffers[2] += stored
        flush(1 << 20)
    flush(0)
    for s in streams:
        s.close()
    out = fs.create(jvm_path)
    out.write(MAGIC + struct.pack("<q", n))
    for p in parts:
        source = fs.open(p)
        spark._jvm.org.apache.hadoop.io.IOUtils.copyBytes(source, out, spark._jsc.hadoopConfiguration(), False)
        source.close()
        fs.delete(p, False)
    out.close()
    return path


class DigestArray:
    """The mapped file in one worker."""

    def __init__(self, path: str):
        whole = np.memmap(path, np.uint8, "r")
        if whole[:8].tobytes() != MAGIC:
            raise ValueError(f"no digest array: {path}")
        n = int(whole[8:16].view("<i8")[0])
        self.digests = whole[16 : 16 + 8 * n].view("<u8")
        self.borders = whole[16 + 8 * n : 24 + 16 * n].view("<i8")
        self.strings = whole[24 + 16 * n :]

    def stored(self, i: int) -> bytes:
        return self.strings[self.borders[i] : self.borders[i + 1]].tobytes()

    def probe(self, keys: list[bytes], digests: np.ndarray | None = None) -> dict[bytes, str]:
        """The values of those keys that are in the array."""
        if digests is None:
            digests = np.fromiter((xxhash.xxh64_intdigest(k, SEED) for k in keys), np.uint64, len(keys))
        at = np.searchsorted(self.digests, digests)
        last = np.searchsorted(self.digests, digests, side="right")
        found = {}
        for j in np.flatnonzero(last > at).tolist():
            for i in range(int(at[j]), int(last[j])):
                stored = self.stored(i)
                if stored.startswith(keys[j] + b"\n"):
                    found[keys[j]] = stored[len(keys[j]) + 1 :].decode()
        return found


@lru_cache(maxsize=4)
def digest_array(name: str) -> DigestArray:
    return DigestArray(SparkFiles.get(name))


def suffixes(host: str) -> list[str]:
    """The host and the domains above it, longest first."""
    labels = host.split(".")
    return [".".join(labels[k:]) for k in range(len(labels))] if host else []


def decide(array: DigestArray, urls: list[tuple[str, str]]) -> list[tuple[str | None, str | None]]:
    """(rule, verdict) of each (host, path); nulls where no rule fits. Two rounds of probes
    for the whole batch: its distinct domains, then domain and path beginnings."""
    domains = {h: suffixes(h) for h, _ in urls}
    hosts = array.probe([s.encode() for s in dict.fromkeys(s for d in domains.values() for s in d)])
    lengths = {h.decode(): [int(x) for x in v.split(",")] for h, v in hosts.items()}
    tried = [[(s, path[:k]) for s in domains[host] if s in lengths for k in lengths[s] if k <= len(path)] for host, path in urls]
    rules = array.probe([f"{s}\0{p}".encode() for s, p in dict.fromkeys(x for t in tried for x in t)])
    out = []
    for t in tried:
        fit = [(len(s) + len(p), len(s), s + p, v) for s, p in t if (v := rules.get(f"{s}\0{p}".encode())) is not None]
        out.append(max(fit)[2:] if fit else (None, None))
    return out


def judged(df: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow", most_bytes: int = MOST_BYTES) -> DataFrame:
    """The input with ``host``, ``path``, ``rule`` (host and path of the rule that decides,
    else null) and ``verdict``. ``rules``: (host, path, verdict)."""
    spark, keep = df.sparkSession, [c for c in df.columns if c not in ("host", "path", "rule", "verdict")]
    host, path = url_parts(url)
    parsed = df.select(*[F.col(f"`{c}`") for c in keep], host.alias("host"), path.alias("path"))
    listed = usable_rules(rules)
    size = listed.agg(F.sum(2 * F.octet_length("host") + F.octet_length("path") + 32)).first()[0] or 0
    if size > most_bytes:
        return joined(parsed, listed, keep, default)
    file = write_digests(entries(listed), spark)
    spark.sparkContext.addFile(file)
    name = os.path.basename(file)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        array = digest_array(name)
        for b in batches:
            got = decide(array, list(zip(b.column(b.num_columns - 2).to_pylist(), b.column(b.num_columns - 1).to_pylist())))
            columns = [pa.array([r for r, _ in got], pa.string()), pa.array([v or default for _, v in got], pa.string())]
            yield pa.RecordBatch.from_arrays([*b.columns, *columns], names=[*b.schema.names, "rule", "verdict"])

    return parsed.mapInArrow(run, extended(parsed, parsed.columns, "rule string, verdict string"))


def joined(parsed: DataFrame, rules: DataFrame, keep: list[str], default: str) -> DataFrame:
    """For lists too large to copy: distinct (host, path) pairs, their possible keys at the
    path lengths of the domain's rules, and a join by digest and string."""
    labels = F.split("host", r"\.")
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    urls = parsed.select("host", "path").distinct().filter("host <> ''")
    spread = urls.select("host", "path", F.explode(domains).alias("domain"))
    lengths = rules.select(F.col("host").alias("domain"), F.length("path").alias("n")).distinct()
    tried = spread.join(lengths, "domain").filter(F.length("path") >= F.col("n")).withColumn("start", F.expr("left(path, n)"))
    stored = rules.select(F.xxhash64("host", "path").alias("digest"), F.col("host").alias("domain"), F.col("path").alias("start"), "verdict")
    fit = tried.withColumn("digest", F.xxhash64("domain", "start")).join(stored, ["digest", "domain", "start"])
    rule = F.concat("domain", "start")
    best = F.max(F.struct(F.length(rule), F.length("domain"), rule.alias("rule"), "verdict"))
    chosen = fit.groupBy("host", "path").agg(best.alias("_b")).select("host", "path", "_b.rule", "_b.verdict")
    row = wrapped(parsed).withColumns({"host": F.col("_row.host"), "path": F.col("_row.path")})
    out = row.join(chosen, ["host", "path"], "left")
    return out.select(*[F.col("_row")[c].alias(c) for c in keep], "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))


def standard_rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(RULES, "host string, path string, verdict string")


JUDGE_SQL = r"""
with parts as (
  select page_id, url, coalesce(position('://' in url), 0) as mark, substr(url, position('://' in url) + 3) as rest from pages
),
split as (
  select page_id,
    case when mark > 0 then translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') else '' end as host,
    case when mark > 0 then regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) else '' end as path
  from parts
),
rules(rule_host, rule_path, rule_verdict) as (values ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
fit as (
  select page_id, host, path, rule_host || rule_path as rule, rule_verdict, row_number() over (partition by split.rid order by length(rule_host || rule_path) desc, length(rule_host) desc) as k, split.rid
  from (select *, row_number() over () as rid from split) split
  left join rules on (host = rule_host or ends_with(host, '.' || rule_host)) and starts_with(path, rule_path)
)
select page_id, host, path, rule, coalesce(rule_verdict, 'allow') as verdict from fit where k = 1
"""
