"""URL filters: a trie over reversed host labels and path segments.

A rule is a host and a path.  It fits the host and all its subdomains if the
url's path starts with the rule's.  The rule with the most host labels wins, and
among those the one with the longest path; a rule that is given twice counts with
the verdict that blocks.  The trie is sent to the executors, so its size is
checked against ``max_trie_bytes``.

Rows
    A null url, or one without ``://``, has an empty host and path, which no rule
    fits, and gets the default verdict.  Rows are judged one by one, so repeated rows
    have the same answer each, very long urls are read whole, and an empty table gives
    no rows.  Ties: two rules of one host and path count as one, which blocks.  Columns
    called host, path, rule or verdict are replaced, all others kept.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import quoted

ALLOW, BLOCK = "allow", "block"

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def host_of(url: Column) -> Column:
    """From the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case."""
    after = F.when(F.instr(url, "://") > 0, F.substring_index(_after(url), "/", 1)).otherwise(F.lit(""))
    host = F.substring_index(F.substring_index(after, "?", 1), "#", 1)
    return F.coalesce(F.translate(host, _UPPER, _UPPER.lower()), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    rest = F.substring_index(F.substring_index(_after(url), "?", 1), "#", 1)
    at = F.instr(rest, "/")
    return F.coalesce(F.when((F.instr(url, "://") > 0) & (at > 0), F.substr(rest, at)).otherwise(F.lit("")), F.lit(""))


def _after(url: Column) -> Column:
    return F.substr(url, F.instr(url, "://") + 3)


class Trie:
    """Nodes are dicts: ``labels`` by host label from the right, ``paths`` by path segment.
    A path ends in a part that the url's next segment starts with, empty after a slash."""

    def __init__(self, rules: Iterable[tuple[str, str]]):
        self.root: dict = {}
        for verdict, rule in rules:
            if verdict not in (ALLOW, BLOCK):
                raise ValueError(f"unknown verdict {verdict!r}")
            host, slash, path = rule.partition("/")
            host = host.translate(str.maketrans(_UPPER, _UPPER.lower()))
            node = self.root
            for label in reversed(host.split(".")) if host else ():
                node = node.setdefault("labels", {}).setdefault(label, {})
            node = node.setdefault("paths", {})
            *whole, last = (slash + path).split("/")
            for segment in whole:
                node = node.setdefault("next", {}).setdefault(segment, {})
            ends = node.setdefault("ends", {})
            if ends.get(last, (ALLOW,))[0] != BLOCK:
                ends[last] = (verdict, rule)

    def find(self, host: str, path: str) -> tuple[str, str] | None:
        """(verdict, rule) of the longest rule that fits."""
        segments = path.split("/")
        best, node = None, self.root
        found = self._path(node, segments)
        best = found or best
        if host:
            for label in reversed(host.split(".")):
                node = node.get("labels", {}).get(label)
                if node is None:
                    break
                best = self._path(node, segments) or best
        return best

    @staticmethod
    def _path(node: dict, segments: list[str]) -> tuple[str, str] | None:
        best, node = None, node.get("paths")
        for segment in segments:
            if node is None:
                break
            ends = node.get("ends")
            if ends:
                fits = [end for end in ends if segment.startswith(end)] if len(ends) <= len(segment) else [segment[:n] for n in range(len(segment) + 1) if segment[:n] in ends]
                if fits:
                    best = ends[max(fits, key=len)]
            node = node.get("next", {}).get(segment)
        return best


def judge(pages: DataFrame, rules: Iterable[tuple[str, str]], url: str = "url", default: str = ALLOW, max_trie_bytes: int = 64 << 20) -> DataFrame:
    """Add host, path, rule and verdict to every row; columns of these names are replaced, others are kept, whatever they are called."""
    trie = Trie(rules)
    size = len(pickle.dumps(trie.root))
    if size > max_trie_bytes:
        raise ValueError(f"the rules take {size} bytes, over the {max_trie_bytes} that may be broadcast")
    sent = pages.sparkSession.sparkContext.broadcast(trie)

    @F.pandas_udf("rule string, verdict string")
    def match(host: pd.Series, path: pd.Series) -> pd.DataFrame:
        found = [sent.value.find(h, p) for h, p in zip(host, path, strict=True)]
        return pd.DataFrame({"rule": [f[1] if f else None for f in found], "verdict": [f[0] if f else default for f in found]})

    kept = [c for c in pages.columns if c.lower() not in ("host", "path", "rule", "verdict")]
    text = F.col(quoted(url)).cast("string")
    parts = pages.select(F.struct(*[F.col(quoted(c)) for c in kept]).alias("row"), host_of(text).alias("host"), path_of(text).alias("path"))
    return parts.withColumn("found", match("host", "path")).select(*[F.col("row")[c].alias(c) for c in kept], "host", "path", "found.rule", "found.verdict")
