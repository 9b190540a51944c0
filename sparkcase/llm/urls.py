"""URL filter: one trie over reversed host labels and path segments holds the allow and the block entries."""

from __future__ import annotations

import pickle
import re
from urllib.parse import unquote

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_LIMIT, free_name

#: Production entries: ``(action, host or host/path)``.
ENTRIES = (
    ("block", "casino-win.example.com"), ("block", "cheap-pills.example.com"), ("block", "free-bets.example.com"),
    ("block", "ads-track.example.com"), ("allow", "casino-win.example.com/en"), ("block", "casino-win.example.com/en/1"),
    ("block", "example.org/es"), ("allow", "m.ads-track.example.com"),
)


def parts(url: str) -> tuple[list[str], list[str]]:
    """Reversed host labels and path segments; scheme, user, port, query and fragment are dropped, hosts lower-cased,
    percent-encoded characters of segments decoded. A URL may lack its scheme, or scheme and slashes."""
    rest = re.sub(r"^(?:[^/?#]*:)?//", "", url.strip()).split("#", 1)[0].split("?", 1)[0]
    host, _, path = rest.partition("/")
    host = host.rsplit("@", 1)[-1].split(":", 1)[0].lower().strip(".")
    return [x for x in reversed(host.split(".")) if x], [unquote(x) for x in path.split("/") if x]


def build(entries) -> dict:
    """The trie: nested dicts, host labels keyed by text, path segments by ``/text``, an entry by ``None``.

    A repeated entry keeps ``block`` if any copy blocks.
    """
    root: dict = {}
    for action, entry in entries:
        host, path = parts(entry)
        node = root
        for key in [*host, *("/" + x for x in path)]:
            node = node.setdefault(key, {})
        if node.get(None, ("allow",))[0] != "block":
            node[None] = (action, entry)
    return root


def match(trie: dict, url: str | None) -> tuple[str, str | None]:
    """The longest entry that the URL falls under: more host labels first, then more path segments; else allowed.

    A path is looked up under the whole host first, then under ever shorter suffixes of it, so an entry for
    ``example.org/es`` also holds for ``blog.example.org/es/1``.
    """
    if url is None:
        return "none", None
    host, path = parts(url)
    nodes, node = [trie], trie
    for label in host:
        node = node.get(label)
        if node is None:
            break
        nodes.append(node)
    for node in reversed(nodes):
        best = node.get(None)
        for segment in path:
            node = node.get("/" + segment)
            if node is None:
                break
            best = node.get(None, best)
        if best:
            return best
    return "allow", None


def url_filter(pages: DataFrame, entries=ENTRIES, url: str = "url", action: str = "action", entry: str = "entry") -> DataFrame:
    """``pages`` with the action and the entry that decided it; the trie is the given entries', so its size is fixed.

    A null URL gets action ``none``; an empty one, or one under no entry, ``allow`` with a null entry; a URL may be of
    any length. Every row stays, repeated ones too, and an empty table stays empty. Existing columns of the same names
    are kept: the new ones get underscores. Entries whose trie is over ``BROADCAST_LIMIT`` bytes are an error.
    """
    known = build(entries)
    if len(pickle.dumps(known)) > BROADCAST_LIMIT:
        raise ValueError(f"the entries take more than {BROADCAST_LIMIT} bytes: filter by parts of them")
    trie = pages.sparkSession.sparkContext.broadcast(known)
    action, entry = free_name(pages, action), free_name(pages, entry)
    found = free_name(pages, "found")

    @F.pandas_udf("action string, entry string")
    def look(urls: pd.Series) -> pd.DataFrame:
        known = trie.value
        return pd.DataFrame([match(known, u) for u in urls], columns=["action", "entry"])

    out = pages.withColumn(found, look(F.col(f"`{url}`")))
    return out.select(*(F.col(f"`{c}`") for c in pages.columns), F.col(f"{found}.action").alias(action), F.col(f"{found}.entry").alias(entry))


def oracle(entries=ENTRIES, columns: str = "page_id, url") -> str:
    """DuckDB SQL of ``url_filter`` over ``pages``: every entry compared with every URL, the longest one kept."""
    rows = ", ".join("('{}', '{}', '{}', '{}', {}, {})".format(a, e, ".".join(parts(e)[0]) + ".", "".join("/" + x for x in parts(e)[1]) + "/", len(parts(e)[0]), len(parts(e)[1])) for a, e in entries)
    return f"""
    WITH e(action, entry, host, path, labels, segments) AS (VALUES {rows}),
    u AS (SELECT *, row_number() OVER () AS rn, regexp_replace(regexp_replace(trim(url), '^([^/?#]*:)?//', ''), '[#?].*$', '') AS rest FROM pages),
    v AS (SELECT *, list_aggregate(list_reverse(string_split(lower(split_part(split_part(rest, '/', 1), ':', 1)), '.')), 'string_agg', '.') || '.' AS rev,
        url_decode(regexp_replace(substr(rest, length(split_part(rest, '/', 1)) + 1) || '/', '/+', '/', 'g')) AS path FROM u),
    m AS (SELECT v.rn, e.action, e.entry, row_number() OVER (PARTITION BY v.rn ORDER BY labels DESC, segments DESC) AS k
        FROM v JOIN e ON starts_with(v.rev, e.host) AND starts_with(v.path, e.path))
    SELECT {", ".join("v." + c.strip() for c in columns.split(","))}, CASE WHEN v.url IS NULL THEN 'none' ELSE coalesce(m.action, 'allow') END AS action, m.entry AS entry
    FROM v LEFT JOIN m ON v.rn = m.rn AND m.k = 1"""
