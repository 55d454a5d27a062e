"""URL filter: a trie over reversed host labels and path segments, broadcast; the longest matching entry decides."""

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import boxed

_LOWER = {i: i + 32 for i in range(65, 91)}


def split_url(url: str | None) -> tuple[str, str]:
    """Host (after the first ://, up to / ? or #, A-Z lower-cased) and path (then up to ? or #); both empty without ://."""
    head, sep, rest = (url or "").partition("://")
    if not sep:
        return "", ""
    rest = rest.partition("#")[0].partition("?")[0]
    cut = rest.find("/")
    return (rest if cut < 0 else rest[:cut]).translate(_LOWER), "" if cut < 0 else rest[cut:]


class Trie:
    """Each node has child nodes by host label, and the path entries that end at its host as a second trie over segments.

    An entry's last path segment, when the entry does not end in /, matches any segment that begins with it."""

    def __init__(self, rules: list[tuple[str, str]]) -> None:
        self.root: dict = {}
        for verdict, entry in rules:
            host, _, path = entry.partition("/")
            node = self.root
            for label in reversed(host.split(".")):
                node = node.setdefault(label, {})
            node = node.setdefault(None, {})  # the entries of this host
            *whole, last = ("/" + path if "/" in entry else "").split("/")
            for segment in whole:
                node = node.setdefault(segment, {})
            node.setdefault(None, []).append((last, verdict, entry))
            node[None].sort(key=lambda x: -len(x[0]))

    def match(self, host: str, path: str) -> tuple[str, str] | None:
        """(entry, verdict) of the longest entry that fits: the most host labels, then the longest path."""
        best, node = None, self.root
        for label in reversed(host.split(".")):
            node = node.get(label)
            if node is None:
                break
            if None in node:
                best = self._path(node[None], path) or best
        return best

    @staticmethod
    def _path(node: dict, path: str) -> tuple[str, str] | None:
        best = None
        for segment in path.split("/"):
            for last, verdict, entry in node.get(None, ()):
                if segment.startswith(last):
                    best = (entry, verdict)
                    break
            node = node.get(segment)
            if node is None:
                break
        return best


#: Entries that the trie may hold; the list is configuration, so its size does not grow with the corpus.
MOST_RULES = 1_000_000


def filter_urls(df: DataFrame, rules: list[tuple[str, str]], url: str = "url", default: str = "allow") -> DataFrame:
    """df with host, path, rule (null if none fits) and verdict (default if none fits).

    Rules are (allow or block, entry) with entry host + path, such as example.org/es/. A null url has an empty host and path.
    Columns of df with these names are replaced; all rows stay."""
    if len(rules) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    trie = df.sparkSession.sparkContext.broadcast(Trie(rules))
    results = ("host", "path", "rule", "verdict")
    shown = boxed(df, results, url=F.col("`" + url.replace("`", "``") + "`"))
    shape = shown.select("row", *(F.lit(None).cast("string").alias(r) for r in results)).schema

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols: list[list] = [[], [], [], []]
            for u in b.column(1).to_pylist():
                host, path = split_url(u)
                found = trie.value.match(host, path)
                for c, v in zip(cols, (host, path, *(found or (None, default))), strict=True):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, pa.string()) for c in cols)], ["row", *results])

    return shown.mapInArrow(judge, shape).select("row.*", *results)
