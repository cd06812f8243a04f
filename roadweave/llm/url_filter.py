"""URL filter with a weighted vocabulary and host/path rules (operator 8).

An Aho-Corasick automaton counts strict and soft terms in the whole url, query and
fragment too (A-Z lower-cased).  A hit counts only if the characters beside it are no ASCII
letters or digits.  One strict term, or ``soft_limit`` *distinct* soft terms,
reject the url.  Rules come first: a rule ``(host, path)`` fits its host and all
subdomains if the url's path starts with the rule's path, and the longest
fitting rule gives the verdict.

Cases: a null url is allowed; one without ``://`` has empty host and path and is
judged by its terms; an empty table gives an empty result; repeated rows are judged one by
one; other columns of the input are carried along unless they are called
host, path, rule, strict_hits, soft_hits or verdict, which are replaced.

Terms and rules are parameters; ``read_vocabulary`` takes terms from a file.  They are shipped to tasks in the closure, so
their size is that of the lists the caller passes, never that of the data.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import UPPER, read

# The default vocabulary and the rules of the registered query.
STRICT_TERMS = ("casino", "cheap-pills", "porn", "spam-farm", "viagra", "xxx")
SOFT_TERMS = ("adult", "bet", "cheap", "click", "deal", "farm", "free", "loan", "pills", "poker", "spam", "win")
SOFT_LIMIT = 2
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)

_ADDED = (
    ("host", T.StringType(), pa.string()),
    ("path", T.StringType(), pa.string()),
    ("rule", T.StringType(), pa.string()),
    ("strict_hits", T.IntegerType(), pa.int32()),
    ("soft_hits", T.IntegerType(), pa.int32()),
    ("verdict", T.StringType(), pa.string()),
)
_LOWER = str.maketrans(UPPER, UPPER.lower())
_WORD = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")


def split_url(url: str | None) -> tuple[str, str]:
    _, found, rest = (url or "").partition("://")
    if not found:
        return "", ""
    end = min((i for i in (rest.find("/"), rest.find("?"), rest.find("#")) if i >= 0), default=len(rest))
    host, rest = rest[:end], rest[end:]
    end = min((i for i in (rest.find("?"), rest.find("#")) if i >= 0), default=len(rest))
    return host.translate(_LOWER), rest[:end]


def _best_rule(host: str, path: str, by_host: dict[str, list[tuple[str, str]]]) -> tuple[str, str] | None:
    """(rule text, verdict) of the longest rule that fits; the host's suffixes are looked up."""
    best = None
    suffix = host
    while suffix:
        for rule_path, verdict in by_host.get(suffix, ()):
            if path.startswith(rule_path) and (best is None or len(suffix + rule_path) > len(best[0])):
                best = (suffix + rule_path, verdict)
        suffix = suffix.partition(".")[2]
    return best


def read_vocabulary(spark: SparkSession, path: str, most: int = 1_000_000) -> tuple[list[str], list[str]]:
    """(strict, soft) terms of a text file with a weight and a term on each line, such as ``strict casino`` or ``soft free``.

    Blank lines and lines that begin with # don't count; more than ``most`` terms, and other weights, are errors.
    """
    lines = F.trim(F.col("value"))
    kept = spark.read.text(path).select(lines.alias("line")).filter((F.col("line") != "") & ~F.col("line").startswith("#"))
    pair = kept.select(F.regexp_extract("line", r"^(strict|soft)\s+(.+)$", 1).alias("weight"), F.regexp_extract("line", r"^(strict|soft)\s+(.+)$", 2).alias("term")).distinct().limit(most + 1)
    rows = sorted(tuple(r) for r in pair.collect())
    if len(rows) > most or any(not w for w, _ in rows):
        raise ValueError(f"{path} has more than {most} terms or lines without a weight")
    return [t for w, t in rows if w == "strict"], [t for w, t in rows if w == "soft"]


def filter_urls(
    pages: DataFrame,
    url: str = "url",
    strict: Sequence[str] = STRICT_TERMS,
    soft: Sequence[str] = SOFT_TERMS,
    soft_limit: int = SOFT_LIMIT,
    rules: Iterable[tuple[str, str, str]] = RULES,
) -> DataFrame:
    """``pages`` with host, path, rule, strict_hits, soft_hits (distinct terms) and verdict added."""
    added = {n for n, _, _ in _ADDED}
    kept = [c for c in pages.columns if c not in added or c == url]
    source = pages.select(*[F.col(f"`{c}`") for c in kept])
    fields = [f for f in source.schema.fields if f.name not in added]
    schema = T.StructType(fields + [T.StructField(n, t, True) for n, t, _ in _ADDED])
    by_host: dict[str, list[tuple[str, str]]] = {}
    for verdict, host, path in rules:
        by_host.setdefault(host, []).append((path, verdict))
    terms = [(t.lower(), True) for t in strict] + [(t.lower(), False) for t in soft]

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        machine = ahocorasick.Automaton()
        for k, (term, is_strict) in enumerate(terms):
            machine.add_word(term, (k, len(term), is_strict))
        if terms:
            machine.make_automaton()
        for batch in batches:
            columns: list[list] = [[] for _ in _ADDED]
            for address in batch.column(batch.schema.get_field_index(url)).to_pylist():
                host, path = split_url(address)
                text = (address or "").translate(_LOWER)
                hits: tuple[set[int], set[int]] = (set(), set())
                for end, (k, size, is_strict) in machine.iter(text) if terms else ():
                    before = text[end - size] if end >= size else ""
                    after = text[end + 1] if end + 1 < len(text) else ""
                    if before not in _WORD and after not in _WORD:
                        hits[is_strict].add(k)
                rule = _best_rule(host, path, by_host)
                by_terms = "block" if hits[True] or len(hits[False]) >= soft_limit else "allow"
                row = (host, path, rule and rule[0], len(hits[True]), len(hits[False]), rule[1] if rule else by_terms)
                for column, value in zip(columns, row, strict=True):
                    column.append(value)
            arrays = [batch.column(i) for i, f in enumerate(batch.schema.names) if f not in added]
            names = [f for f in batch.schema.names if f not in added]
            arrays += [pa.array(c, t) for c, (_, _, t) in zip(columns, _ADDED, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, names + [n for n, _, _ in _ADDED])

    return source.mapInArrow(judge, schema)


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages").select("page_id", "url")
    return filter_urls(pages).select("page_id", "host", "path", "rule", "strict_hits", "soft_hits", "verdict")


def _term_sql(term: str) -> str:
    return f"CAST(regexp_matches(low, '(^|[^a-z0-9]){term}($|[^a-z0-9])') AS INTEGER)"


def oracle_sql() -> str:
    fits = "(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')"
    ordered = sorted(RULES, key=lambda r: -len(r[1] + r[2]))
    rule = " ".join(f"WHEN {fits.format(h=h, p=p)} THEN '{h}{p}'" for _, h, p in ordered)
    verdict = " ".join(f"WHEN rule = '{h}{p}' THEN '{v}'" for v, h, p in ordered)
    lower = f"translate({{}}, '{UPPER}', '{UPPER.lower()}')"
    return f"""
WITH parts AS (
  SELECT page_id, coalesce(url, '') AS url, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
hosts AS (
  SELECT page_id, url, regexp_extract(rest, '^[^/?#]*') AS raw_host, substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1) AS tail FROM parts),
split AS (
  SELECT page_id, url, {lower.format('raw_host')} AS host, regexp_extract(tail, '^[^?#]*') AS path FROM hosts),
counted AS (
  SELECT page_id, host, path, {lower.format('url')} AS low, CASE {rule} END AS rule FROM split),
hits AS (
  SELECT page_id, host, path, rule, {' + '.join(map(_term_sql, STRICT_TERMS))} AS strict_hits,
    {' + '.join(map(_term_sql, SOFT_TERMS))} AS soft_hits FROM counted)
SELECT page_id, host, path, rule, strict_hits, soft_hits,
  CASE {verdict} WHEN strict_hits > 0 OR soft_hits >= {SOFT_LIMIT} THEN 'block' ELSE 'allow' END AS verdict
FROM hits"""
