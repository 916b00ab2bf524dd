"""Text functions as column expressions: trimming, tokens, chunks, overlap scores, hashes, ids."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from matchloom.config import DEFAULTS

SPACE = r"[\s\x1c-\x1f]"
_SENTENCE = re.compile(r"(?<=[.!?])\s+")


def strip(text: Column) -> Column:
    """Without white space (of any script) at both ends."""
    return F.regexp_replace(text, rf"(?U)^{SPACE}+|{SPACE}+$", "")


def tokenize(text: Column) -> Column:
    """Lower-case runs of ASCII letters and digits, in order; none for null."""
    return F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("[A-Za-z0-9]+"), F.lit(0)), F.lower)


def token_set(text: Column) -> Column:
    """Distinct tokens."""
    return F.array_distinct(tokenize(text))


def _tail(text: str, overlap: int) -> str:
    """The last characters of a chunk from the first word that begins in them."""
    tail = text[-overlap:] if overlap > 0 else ""
    return tail.partition(" ")[2].strip() if " " in tail else tail.strip()


def chunks_of(text: str | None, most: int, overlap: int) -> list[str]:
    """Paragraph lines, long ones by sentence or hard cuts, packed greedily; a new chunk begins with the last one's tail."""
    if not text or most <= 0:
        return []
    pieces: list[str] = []
    for line in text.replace("\r\n", "\n").replace("\r", "\n").strip().split("\n"):
        line = line.strip()
        for part in [line] if len(line) <= most else _SENTENCE.split(line):
            pieces += [part] if len(part) <= most else [part[i : i + most] for i in range(0, len(part), most)]
    found, now = [], ""
    for piece in filter(None, map(str.strip, pieces)):
        if not now:
            now = piece
        elif len(now) + 1 + len(piece) <= most:
            now = f"{now} {piece}"
        else:
            found.append(now)
            seed = _tail(now, overlap)
            now = f"{seed} {piece}" if seed else piece
    return [*found, now] if now else found


def chunk_text(text: Column, most: int = DEFAULTS.tender_chunk, overlap: int = DEFAULTS.tender_overlap) -> Column:
    """Chunks of a text, in Arrow batches; an array fold in the JVM copies the chunks at each step and is several times slower."""

    @F.pandas_udf("array<string>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(lambda x: chunks_of(x, most, overlap))

    return run(text)


def overlap_score(query: Column, text: Column) -> Column:
    """Share of the query's distinct tokens found in the text; 0 if either has none."""
    q, t = token_set(query), token_set(text)
    return F.when((F.size(q) > 0) & (F.size(t) > 0), F.size(F.array_intersect(q, t)) / F.size(q)).otherwise(F.lit(0.0))


def keyword_boost(keywords: Column, text: Column, most: float = DEFAULTS.most_boost) -> Column:
    """Boost by the share of distinct ``keywords`` among the text's tokens, capped at ``most`` (reached at half of them)."""
    t = token_set(text)
    ratio = F.size(F.array_intersect(keywords, t)) / F.greatest(F.size(keywords), F.lit(1))
    return F.when((F.size(keywords) > 0) & (F.size(t) > 0), F.least(ratio * most * 2, F.lit(most))).otherwise(F.lit(0.0))


def content_hash(content: Column) -> Column:
    """Hexadecimal SHA-256."""
    return F.sha2(content, 256)


def snippet(text: Column, most: int = DEFAULTS.snippet_chars) -> Column:
    """First characters; empty for null."""
    return F.substring(F.coalesce(text, F.lit("")), 1, most)


def chunk_id(kind: str, owner: Column, index: Column) -> Column:
    """``kind:owner:index``."""
    return F.concat_ws(":", F.lit(kind), owner, index.cast("string"))


def parsed_chunk_id(identifier: Column, kind: str = "tender") -> Column:
    """The owner in a chunk id of ``kind``; null for any other text."""
    parts = F.split(identifier, ":")
    return F.when((F.size(parts) >= 3) & (F.get(parts, F.lit(0)) == kind), F.get(parts, F.lit(1)))


def resolved(base: Column, link: Column) -> Column:
    """A link as the URL it means on the page ``base``, by the rules of RFC 3986; an empty link means the page itself."""
    parts = r"^([A-Za-z][A-Za-z0-9+.-]*:)?(//[^/?#]*)?([^?#]*)(\?[^#]*)?(#.*)?$"
    part = lambda text, n: F.regexp_extract(text, parts, n)
    scheme, host, path, query = (part(base, n) for n in (1, 2, 3, 4))
    own_host, own_path, own_query, rest = part(link, 2), part(link, 3), part(link, 4), F.concat(part(link, 4), part(link, 5))
    under = F.when((host != "") & (path == ""), F.concat(F.lit("/"), own_path)).otherwise(F.concat(F.regexp_replace(path, r"[^/]*$", ""), own_path))
    relative = F.when(own_path == "", F.concat(scheme, host, path, F.when(own_query == "", query).otherwise(own_query), part(link, 5)))
    relative = relative.when(own_path.startswith("/"), F.concat(scheme, host, without_dots(own_path), rest)).otherwise(F.concat(scheme, host, without_dots(under), rest))
    return F.when(part(link, 1) != "", link).when(own_host != "", F.concat(scheme, link)).when(link == "", base).otherwise(relative)


def without_dots(path: Column) -> Column:
    """A path whose segments ``.`` and ``..`` are carried out."""
    step = lambda done, x: F.when(x == ".", done).when((x == "..") & (F.size(done) > 1), F.slice(done, 1, F.size(done) - 1)).when(x == "..", done).otherwise(F.array_append(done, x))
    kept = F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step)
    ends = F.element_at(F.split(path, "/"), -1).isin(".", "..")
    return F.when(path.contains("./") | path.endswith("/.") | path.endswith("/..") | path.isin(".", ".."), F.array_join(F.when(ends, F.array_append(kept, F.lit(""))).otherwise(kept), "/")).otherwise(path)


def base_name(path: Column) -> Column:
    """What stands behind the last slash."""
    return F.element_at(F.split(path, "/"), -1)


def filters_pass(filters: dict[str, str | None], first: dict[str, Column], second: dict[str, Column]) -> Column:
    """Every filter's value is found in the first table's column, or the second's; blank filters and missing values pass."""
    kept = F.lit(True)
    for name, value in filters.items():
        if value is None or value == "":
            continue
        sides = [side[name] for side in (first, second) if name in side]
        if sides:
            found = F.coalesce(*sides).cast("string")
            kept = kept & (found.isNull() | F.contains(F.lower(found), F.lower(F.lit(str(value)))))
    return kept
