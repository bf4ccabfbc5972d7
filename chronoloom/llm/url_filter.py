"""URL filter by a sort-merge range join of pages and rules.

A host turned round (``com.example.www.``) makes "this host and its subdomains" one interval of sorted
keys, and a path prefix one interval within a host. Both tables are dealt over the same ranges of (turned
host, path, hash of the id), whose bounds come from a bounded sample of pages, so a host or a url with most
pages is dealt over many tasks. A rule goes to every range that its hosts reach into: a range gets the
rules that begin in it and those that are open where it begins. Each task reads its ranges in order of (turned host, rules
first, path) and keeps a stack of the host rules whose intervals it is in, and within a host one of paths.

Rules are a table (or a list, which becomes one) of any size; a task holds the rules of the hosts it is in
at one time, not all.

Of the rules that fit, the one with the longest host plus path wins; of equal lengths the longer host.

Defined cases: a null url or one without ``://`` has an empty host and path, which no rule fits, and gets
the default verdict; repeated rows are judged each; an empty table gives an empty result; without rules
every page gets the default verdict; equal rules count once, and of rules with one host and path but
two verdicts the verdict first in the alphabet holds; a rule without a host is an error; other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Pages sampled for each range, and the most characters of a key and of a path in a bound.
SAMPLED, BOUND = 20, 1000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def text(self) -> str:
        return self.host + self.path


def parse_rule(verdict: str, text: str) -> Rule:
    host, slash, path = text.partition("/")
    return Rule(host, slash + path, verdict)


def turned(host: str) -> str:
    return ".".join(reversed(host.split("."))) + "."


def split_url(url):
    """(host, path) columns."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), _UPPER, _LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


class HostRules:
    """The path rules of one host at rising paths: each knows the next shorter one that it is nested in."""

    def __init__(self):
        self.paths: list[str] = []
        self.rules: list[Rule] = []
        self.outer: list[int] = []

    def around(self, at: int, path: str) -> int:
        """The place of the longest rule that ``path`` starts with, of rule ``at`` and those around it, or -1."""
        while at >= 0 and not path.startswith(self.paths[at]):
            at = self.outer[at]
        return at

    def add(self, rule: Rule) -> None:
        self.outer.append(self.around(len(self.paths) - 1, rule.path))
        self.paths.append(rule.path)
        self.rules.append(rule)


class HostSweep:
    """Active host rules at rising turned hosts; rules come before the pages of their key, by rising paths."""

    def __init__(self):
        self.stack: list[tuple[str, HostRules]] = []

    def rules_at(self, key: str) -> list[HostRules]:
        while self.stack and not key.startswith(self.stack[-1][0]):
            self.stack.pop()
        return [own for _, own in self.stack]

    def add(self, key: str, rule: Rule) -> None:
        while self.stack and not key.startswith(self.stack[-1][0]):
            self.stack.pop()
        if not self.stack or self.stack[-1][0] != key:
            self.stack.append((key, HostRules()))
        self.stack[-1][1].add(rule)


class PathSweep:
    """The winning rule at rising paths of one host. The rules of the hosts around it are shared and never
    copied: the sweep only keeps its place in each of them."""

    def __init__(self, active: list[HostRules]):
        self.active, self.at = active, [0] * len(active)

    def winner(self, path: str) -> Rule | None:
        best = None
        for k, own in enumerate(self.active):
            # what lies between a prefix of the path and the path starts with that prefix
            self.at[k] = bisect_right(own.paths, path, self.at[k])
            place = own.around(self.at[k] - 1, path)
            if place >= 0:
                # longer hosts come later in the stack
                best = max(best, own.rules[place], key=lambda r: (len(r.text), len(r.host)) if r else (-1, -1))
        return best


def rule_table(spark: SparkSession, rules: Sequence[Rule]) -> DataFrame:
    return spark.createDataFrame([(r.host, r.path, r.verdict) for r in rules], "host string, path string, verdict string")


def _key(host):
    return F.concat(F.concat_ws(".", F.reverse(F.split(host, r"\."))), F.lit("."))


def range_bounds(keyed: DataFrame, parts: int) -> list[tuple[str, str, int]]:
    """At most ``parts`` - 1 rising places that cut the pages into ranges of about equal numbers. About SAMPLED
    pages for each range come to the driver, however many pages and tasks there are."""
    most, pages = SAMPLED * parts, keyed.count()
    place = keyed.select(F.substring("key", 1, BOUND).alias("key"), F.substring("path", 1, BOUND).alias("path"), "salt")
    some = place if pages <= most else place.sample(most / pages, seed=1)
    rows = sorted((r["key"], r["path"], r["salt"]) for r in some.collect())
    return [rows[len(rows) * i // parts] for i in range(1, parts)] if rows else []


def filter_urls(pages: DataFrame, rules: Sequence[Rule] | DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """id, host, path, rule, verdict of every row; a table of rules has the columns host, path, verdict."""
    spark = pages.sparkSession
    if not isinstance(rules, DataFrame):
        rules = rule_table(spark, rules)
    host, path = split_url(F.col(f"`{url_col}`"))
    keyed = pages.select(F.col(f"`{id_col}`").alias("id"), host.alias("host"), path.alias("path"))
    keyed = keyed.withColumn("key", _key(F.col("host"))).withColumn("salt", F.xxhash64("id"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    bounds = range_bounds(keyed, parts)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            places = zip(*(b.column(c).to_pylist() for c in ("key", "path", "salt")))
            part = pa.array([bisect_right(bounds, place) for place in places], pa.int32())
            yield pa.RecordBatch.from_arrays([part, *(b.column(c) for c in ("id", "host", "path", "key"))], ["part", "id", "host", "path", "key"])

    def reach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            # a key ends with "."; what starts with it lies before the same with "/", the next character
            ranges = [range(bisect_right(bounds, (k,)), bisect_right(bounds, (k[:-1] + "/",)) + 1) for k in b.column("key").to_pylist()]
            yield b.append_column("part", pa.array([list(r) for r in ranges], pa.list_(pa.int32())))

    id_type = keyed.schema["id"].dataType.simpleString()
    found = keyed.mapInArrow(deal, f"part int, id {id_type}, host string, path string, key string")
    found = found.select("part", "key", F.lit(1).alias("kind"), "path", "id", "host", F.lit(None).cast("string").alias("verdict"))
    given = rules.groupBy(F.col("host"), F.coalesce("path", F.lit("")).alias("path")).agg(F.min("verdict").alias("verdict"))
    given = given.withColumn("key", F.when(F.length("host") > 0, _key(F.col("host"))).otherwise(F.raise_error(F.lit("a rule needs a host"))))
    given = given.mapInArrow(reach, "host string, path string, verdict string, key string, part array<int>")
    given = given.select(F.explode("part").alias("part"), "key", F.lit(0).alias("kind"), "path", F.lit(None).cast(id_type).alias("id"), "host", "verdict")
    ordered = found.unionByName(given).repartitionById(parts, F.col("part")).sortWithinPartitions("part", "key", "kind", "path")

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hosts, paths, last = HostSweep(), None, (None, None)
        for b in batches:
            pages, winners = [], []
            for at, (part, key, kind, path, host, verdict) in enumerate(zip(*(b.column(c).to_pylist() for c in ("part", "key", "kind", "path", "host", "verdict")))):
                if part != last[0]:
                    hosts, last = HostSweep(), (part, None)
                if kind == 0:
                    hosts.add(key, Rule(host, path, verdict))
                    continue
                if key != last[1]:
                    last, paths = (part, key), PathSweep(hosts.rules_at(key))
                pages.append(at)
                winners.append(paths.winner(path))
            some = b.take(pa.array(pages, pa.int64()))
            rule = pa.array([r.text if r else None for r in winners], pa.string())
            verdict = pa.array([r.verdict if r else default for r in winners], pa.string())
            yield pa.RecordBatch.from_arrays([*(some.column(c) for c in ("id", "host", "path")), rule, verdict], ["id", "host", "path", "rule", "verdict"])

    return ordered.mapInArrow(sweep, f"id {id_type}, host string, path string, rule string, verdict string").withColumnRenamed("id", id_col)
