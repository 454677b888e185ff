"""URL rules from a sorted digest array: memory-mapped 64-bit xxhash keys, binary search, confirmed by the stored strings.

A rule is a host, and a path that the url's path must start with. Two arrays are made of a list of rules: the hosts with the
lengths of their rules' paths, and the rules with their verdicts. An array is sorted by digest and cut by digest ranges into
volumes; Spark tasks sort and build the volumes, the driver only carries one at a time to the shared folder, from where
Spark gives a copy to every machine. There the volumes are memory-mapped, so a list costs disk and page cache but no heap.

Pages need no shuffle. Each task takes the distinct hosts of a batch, probes all their parent domains at once by vectorised
binary search, and for hosts that have rules probes host and path prefix, at the few lengths that these rules have. Whatever
is found is compared with the stored string, entry by entry where digests collide, so a verdict never rests on a digest alone.

Defined cases: the host is what follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case (a port or
user name stays part of it); the path goes on to ``?``, ``#`` or the end; urls that are null or lack ``://`` have neither.
The longest rule wins (UTF-8 bytes), of equally long ones that with the longer host. A rule without ``/`` has an empty path
and fits every path of its host; rules that are null or have an empty host fit nothing; of contradicting equal rules the one
that blocks holds. Pages without a rule get ``default``. Every row gives one row, in the case of repeated or null ids too.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trackspark.session import checkpoint_root

#: The rules of the registered query.
RULES = """
block net/
allow example.net/en/
block example.com/de/
allow org/fr/
"""
#: Entries of a volume, which is what a task builds and the driver carries at a time.
VOLUME = 1 << 20
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def rules_of(spark: SparkSession, text: str) -> DataFrame:
    """``rule, verdict`` from lines of a verdict and a rule."""
    rows = [tuple(reversed(line.split(None, 1))) for line in text.splitlines() if line.strip()]
    return spark.createDataFrame(rows, "rule string, verdict string")


def _lower(column: Column) -> Column:
    return F.translate(column, LETTERS, LETTERS.lower())


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The host of a url in lower case and its path, both empty without ``://``."""
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise("")
    return _lower(F.regexp_extract(rest, "^[^/?#]*", 0)), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def digest(text: bytes) -> int:
    """The 64-bit xxhash, as a signed number."""
    n = xxhash.xxh64_intdigest(text)
    return n - (1 << 64) if n >> 63 else n


# --- volumes ---------------------------------------------------------------------


def _volume(keys: np.ndarray, texts: list[bytes], values: list[bytes]) -> bytes:
    """Entries sorted by key: how many, keys, ends of texts, ends of values, texts, values."""
    order = np.argsort(keys, kind="stable")
    texts, values = [texts[i] for i in order], [values[i] for i in order]
    ends = [np.cumsum([0, *map(len, part)]).astype(np.int64) for part in (texts, values)]
    head = np.array([len(keys)], np.int64)
    return b"".join([head.tobytes(), keys[order].tobytes(), ends[0].tobytes(), ends[1].tobytes(), *texts, *values])


class _Mapped:
    """One volume, mapped into memory."""

    def __init__(self, path: str):
        n = int(np.fromfile(path, np.int64, 1)[0])
        raw = np.memmap(path, np.uint8, "r")
        at = 8 + 8 * n
        self.keys = raw[8:at].view(np.int64)
        self.text_ends = raw[at : at + 8 * (n + 1)].view(np.int64)
        self.value_ends = raw[at + 8 * (n + 1) : at + 16 * (n + 1)].view(np.int64)
        start = at + 16 * (n + 1)
        self.texts = raw[start : start + int(self.text_ends[-1])]
        self.values = raw[start + int(self.text_ends[-1]) :]

    def text(self, i: int) -> bytes:
        return self.texts[self.text_ends[i] : self.text_ends[i + 1]].tobytes()

    def value(self, i: int) -> bytes:
        return self.values[self.value_ends[i] : self.value_ends[i + 1]].tobytes()

    def find(self, keys: np.ndarray, texts: list[bytes]) -> list[bytes | None]:
        """The value of each text, None for those that are not stored."""
        out: list[bytes | None] = [None] * len(texts)
        at = np.searchsorted(self.keys, keys)
        open_ = np.flatnonzero(at < len(self.keys))
        while len(open_ := open_[self.keys[at[open_]] == keys[open_]]):
            for i in open_.tolist():
                if self.text(at[i]) == texts[i]:
                    out[i] = self.value(at[i])
            at[open_] += 1  # other strings with the same digest
            open_ = open_[[out[i] is None and at[i] < len(self.keys) for i in open_.tolist()]]
        return out


class DigestArray:
    """The volumes of one array, opened in a task by the names under which Spark keeps them."""

    def __init__(self, names: list[str], lows: list[int], digest: Callable[[bytes], int]):
        self.names, self.lows, self.digest, self._open = names, np.array(lows, np.int64), digest, {}

    def __reduce__(self):
        return DigestArray, (self.names, self.lows.tolist(), self.digest)

    def find(self, texts: list[bytes]) -> list[bytes | None]:
        """The stored value of each text, None for texts that are not stored."""
        out: list[bytes | None] = [None] * len(texts)
        keys = np.fromiter(map(self.digest, texts), np.int64, len(texts))
        volume = np.searchsorted(self.lows, keys, side="right") - 1
        for v in np.unique(volume[volume >= 0]).tolist():
            if v not in self._open:
                self._open[v] = _Mapped(SparkFiles.get(self.names[v]))
            at = np.flatnonzero(volume == v)
            for i, value in zip(at.tolist(), self._open[v].find(keys[at], [texts[i] for i in at]), strict=True):
                out[i] = value
        return out


def _with_keys(digest: Callable[[bytes], int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = pa.array([digest(t) for t in batch.column(0).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([keys, batch.column(0), batch.column(1)], ["key", "entry", "value"])

    return run


def _built(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    table = pa.Table.from_batches(batches) if (batches := list(batches)) else None
    if table is not None and len(table):
        keys = table["key"].to_numpy()
        data = _volume(keys, table["entry"].to_pylist(), table["value"].to_pylist())
        yield pa.RecordBatch.from_arrays([pa.array([int(keys.min())]), pa.array([data], pa.large_binary())], ["low", "volume"])


def _store(spark: SparkSession, name: str, data: bytes) -> None:
    """Write a file below the shared folder and have Spark give a copy to every machine."""
    path = f"{checkpoint_root(spark).rstrip('/')}/{name}"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out = fs.create(at)
    out.write(bytearray(data))
    out.close()
    spark.sparkContext.addFile(fs.makeQualified(at).toString())


def digest_array(entries: DataFrame, volume: int = VOLUME, digest: Callable[[bytes], int] = digest) -> DigestArray:
    """A digest array of ``entry`` (distinct, binary) and ``value`` (binary)."""
    spark = entries.sparkSession
    keyed = entries.select("entry", "value").mapInArrow(_with_keys(digest), "key long, entry binary, value binary")
    count = keyed.count()
    if not count:
        return DigestArray([], [], digest)
    ranges = keyed.repartitionByRange(-(-count // volume), "key")  # equal digests stay in one volume
    names, lows = [], []
    for row in ranges.mapInArrow(_built, "low long, volume binary").toLocalIterator():
        names.append(f"digests-{uuid.uuid4().hex}")
        lows.append(row.low)
        _store(spark, names[-1], bytes(row.volume))
    order = np.argsort(lows)
    return DigestArray([names[i] for i in order], [lows[i] for i in order], digest)


# --- rules -----------------------------------------------------------------------


def index(rules: DataFrame, **settings) -> tuple[DigestArray, DigestArray]:
    """The arrays of hosts and of rules of a table ``rule, verdict``."""
    cut = F.instr("rule", "/")
    known = rules.where("rule is not null and verdict in ('allow', 'block')").select(
        _lower(F.when(cut > 0, F.expr("substring(rule, 1, instr(rule, '/') - 1)")).otherwise(F.col("rule"))).alias("host"),
        F.when(cut > 0, F.expr("substring(rule, instr(rule, '/'))")).otherwise("").alias("path"),
        "verdict",
    )
    known = known.where("host <> ''").groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    hosts = known.groupBy(F.encode("host", "UTF-8").alias("entry")).agg(
        F.encode(F.array_join(F.sort_array(F.collect_set(F.octet_length("path").cast("string"))), " "), "UTF-8").alias("value")
    )
    whole = known.select(F.encode(F.concat("host", "path"), "UTF-8").alias("entry"), F.encode("verdict", "UTF-8").alias("value"))
    return digest_array(hosts, **settings), digest_array(whole, **settings)


def _parents(host: bytes) -> list[bytes]:
    """The host and its parent domains, the longest first."""
    out = [host] if host else []
    while (cut := host.find(b".")) >= 0:
        host = host[cut + 1 :]
        if host:
            out.append(host)
    return out


def _judged(hosts: DigestArray, rules: DigestArray, default: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            coded = batch.column(1).dictionary_encode()
            distinct = [h.encode() for h in coded.dictionary.to_pylist()]
            parents = [_parents(h) for h in distinct]
            domains = list(dict.fromkeys(d for ds in parents for d in ds))
            lengths = {d: [int(n) for n in v.split()] for d, v in zip(domains, hosts.find(domains), strict=True) if v}
            ruled = [[(d, n) for d in ds if d in lengths for n in lengths[d]] for ds in parents]
            for options in ruled:
                options.sort(key=lambda x: (-len(x[0]) - x[1], -len(x[0])))
            host_of, paths = coded.indices.to_pylist(), batch.column(2).to_pylist()
            asked = []  # by row: what may fit, the longest first
            for host, path in zip(host_of, paths, strict=True):
                options = ruled[host]
                whole = path.encode() if options else b""
                asked.append([d + whole[:n] for d, n in options if n <= len(whole)])
            strings = list(dict.fromkeys(s for row in asked for s in row))
            found = {s: v.decode() for s, v in zip(strings, rules.find(strings), strict=True) if v}
            best = [next((s for s in row if s in found), None) for row in asked]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), batch.column(1), batch.column(2),
                    pa.array([None if s is None else s.decode() for s in best], pa.string()),
                    pa.array([default if s is None else found[s] for s in best], pa.string()),
                ],
                ["page_id", "host", "path", "rule", "verdict"],
            )

    return run


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow", **settings) -> DataFrame:
    """``page_id, host, path, rule, verdict`` of every row of ``pages`` (``page_id, url``)."""
    hosts, whole = index(rules, **settings)
    urls = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"))
    host, path = host_and_path(F.col("url"))
    return urls.select("page_id", host.alias("host"), path.alias("path")).mapInArrow(
        _judged(hosts, whole, default), "page_id long, host string, path string, rule string, verdict string"
    )


def oracle() -> str:
    """DuckDB SQL for :func:`judge` with ``RULES``: every rule compared with every page."""
    rules = ", ".join(f"('{r}', '{v}')" for v, r in (line.split() for line in RULES.split("\n") if line))
    return f"""
    WITH r AS (SELECT rule, verdict, split_part(rule, '/', 1) AS h, substr(rule, strpos(rule, '/')) AS p FROM (VALUES {rules}) AS t(rule, verdict)),
    u AS (SELECT row_number() OVER () AS k, page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
    s AS (SELECT k, page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{LETTERS}', '{LETTERS.lower()}') AS host,
          regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
    b AS (SELECT s.k, max_by(struct_pack(rule := rule, verdict := verdict), 1000 * length(rule) + length(h)) AS best
          FROM s JOIN r ON (s.host = r.h OR ends_with(s.host, '.' || r.h)) AND starts_with(s.path, r.p) GROUP BY s.k)
    SELECT page_id, host, path, best.rule AS rule, coalesce(best.verdict, 'allow') AS verdict FROM s LEFT JOIN b USING (k)"""
