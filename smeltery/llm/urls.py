"""URL rules in a trie over reversed host labels and then path segments."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from smeltery.llm.text import table_of

MAX_RULES = 200_000
"""The trie is broadcast: more rules than this are refused."""

Rule = tuple[str, str, str]


def url_host(url: Column | str) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    found = F.regexp_extract(F.col(url) if isinstance(url, str) else url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(F.coalesce(found, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def url_path(url: Column | str) -> Column:
    """After the host up to ``?``, ``#`` or the end; else empty."""
    found = F.regexp_extract(F.col(url) if isinstance(url, str) else url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)
    return F.coalesce(found, F.lit(""))


class RuleTrie:
    """Longest match: most host labels first, then the longest path.

    A rule fits its host and every subdomain, and paths that start with its path. Whole path segments are
    edges of the trie; what follows a rule's last slash is kept at its node and compared as a prefix.
    Of two rules for the same host and path the first given counts.
    """

    def __init__(self, rules: Iterable[Rule]):
        self.root: dict = {}
        for n, (verdict, host, path) in enumerate(rules):
            if n >= MAX_RULES:
                raise ValueError(f"more than {MAX_RULES} rules")
            if verdict not in ("allow", "block") or not host or not path.startswith("/"):
                raise ValueError(f"not a rule: {(verdict, host, path)}")
            node = self.root
            host = host.lower()
            for label in reversed(host.split(".")):
                node = node.setdefault(label, {})
            *segments, rest = path[1:].split("/")
            node = node.setdefault(None, {"/": {}})["/"]
            for segment in segments:
                node = node.setdefault(segment, {})
            node.setdefault(None, {}).setdefault(rest, (host + path, verdict))

    def match(self, host: str, path: str) -> tuple[str, str] | None:
        """(rule, verdict) of the longest rule that fits, or nothing."""
        nodes, node = [], self.root
        for label in reversed(host.split(".")):
            node = node.get(label)
            if node is None:
                break
            if None in node:
                nodes.append(node[None]["/"])
        if not path.startswith("/"):
            return None
        segments = path[1:].split("/")
        for node in reversed(nodes):
            best = None
            for depth in range(len(segments)):
                rests = node.get(None)
                if rests:
                    fits = [rest for rest in rests if "/".join(segments[depth:]).startswith(rest)] if len(rests) > 1 or "" not in rests else [""]
                    if fits:
                        best = rests[max(fits, key=len)]
                node = node.get(segments[depth])
                if node is None:
                    break
            if best:
                return best
        return None


def judge_urls(pages: DataFrame, rules: Iterable[Rule], default: str = "allow", url: str = "url") -> DataFrame:
    """All rows with host, path, rule and verdict added; columns of these names are replaced.

    ``verdict`` is that of the longest rule that fits, else ``default``; ``rule`` is null then. Null
    URLs and URLs without ``://`` have an empty host and path and get the default.
    """
    pages = pages.drop("host", "path", "rule", "verdict").withColumn("host", url_host(url)).withColumn("path", url_path(url))
    trie = pages.sparkSession.sparkContext.broadcast(RuleTrie(rules))
    names = pages.columns
    schema = T.StructType([*pages.schema.fields, T.StructField("rule", T.StringType()), T.StructField("verdict", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        match = trie.value.match
        for batch in batches:
            found = [match(h, p) for h, p in zip(batch.column("host").to_pylist(), batch.column("path").to_pylist())]
            rule = pa.array([f and f[0] for f in found], pa.string())
            verdict = pa.array([f[1] if f else default for f in found], pa.string())
            yield table_of(batch, names, rule, verdict, more_names=("rule", "verdict"))

    return pages.mapInArrow(run, schema)
