"""Secrets in texts, weighed by who else holds them.

Patterns propose candidates. The hash of each candidate's value is summed over the whole corpus by distinct documents
(repositories) and distinct owners: a value that many owners hold is a copied example, one that a few owners hold and
that looks random is taken for live.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _store
from ._store import fresh
from ._words import blocks

#: Kind, pattern (on UTF-8 bytes), group of the value, least length of that group, what a text must hold
#: (in lower case) to match, base kind or added.
KINDS: tuple[tuple[str, bytes, int, int, tuple[bytes, ...], bool], ...] = (
    ("assign", rb"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 12, (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key"), True),
    ("access", rb"AKIA[A-Z0-9]+", 0, 18, (b"akia",), True),
    ("hex", rb"[0-9a-f]{16,}", 0, 16, (), True),
    ("github", rb"gh[pousr]_[A-Za-z0-9]{36,}", 0, 40, (b"ghp_", b"gho_", b"ghu_", b"ghs_", b"ghr_"), False),
    ("slack", rb"xox[abprs]-[A-Za-z0-9-]{10,}", 0, 15, (b"xox",), False),
    ("jwt", rb"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 29, (b"eyj",), False),
    ("pem", rb"-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\s]{16,}", 0, 40, (b"private key-----",), False),
    ("url", rb"[a-z][a-z0-9+.-]{1,15}://[^\s:/@]{1,64}:([^\s:/@]{8,64})@", 1, 8, (b"://",), False),
)
_COMPILED = [re.compile(k[1]) for k in KINDS]
_PLACEHOLDER = re.compile(rb"(?i)example|changeme|placeholder|your|dummy|sample|x{6}|\*{4}|0{8}|1234567")
#: Owners that may hold a live value; bits a character that it has at least.
MOST_OWNERS, LEAST_ENTROPY = 2, 2.5
FOUND = "array<struct<start:int,kind:int,end:int,value:binary,random:boolean>>"


def entropy(value: bytes) -> float:
    n = np.bincount(np.frombuffer(value, np.uint8))
    p = n[n > 0] / len(value)
    return float(-(p * np.log2(p)).sum())


def candidates(text: bytes) -> list[tuple[int, int, int, bytes, bool]]:
    """(start, kind, end, value, random-looking) in bytes, ordered by start and then kind."""
    low, out = text.lower(), []
    for k, (_, _, group, least, needs, _) in enumerate(KINDS):
        if needs and not any(x in low for x in needs):
            continue
        for m in _COMPILED[k].finditer(text):
            value = m[group]
            if len(value) >= least:
                out.append((m.start(), k, m.end(), value, entropy(value) >= LEAST_ENTROPY and not _PLACEHOLDER.search(value)))
    return sorted(out)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import xxhash

    kind = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32()), ("value", pa.binary()), ("random", pa.bool_())]))
    for batch in batches:
        for lo, hi, buf, bounds in blocks(batch.column("text")):
            data, rows = buf.tobytes(), []
            for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
                text = data[a:b]
                found = candidates(text)
                if found and not text.isascii():
                    place = np.concatenate([[0], np.cumsum((buf[a:b] & 0xC0) != 0x80)])  # bytes to code points
                    found = [(int(place[s]), k, int(place[e]), v, r) for s, k, e, v, r in found]
                rows.append([(s, k, e, xxhash.xxh3_128_digest(v), r) for s, k, e, v, r in found])
            yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(lo, hi - lo) for c in ("doc_id", "owner", "digest")), pa.array(rows, kind)], ["doc_id", "owner", "digest", "found"])


def find_secrets(docs: DataFrame, owner: str = "source") -> DataFrame:
    """(doc_id, digest, found array<struct<start, kind, end, live, owners, documents>>) for every row of ``docs``.

    ``digest`` is xxhash64 of the text; ``kind`` is a place in KINDS; spans are in code points, end exclusive, by start and then kind. ``owners`` and
    ``documents`` count the distinct owners and doc_ids of the whole corpus that hold the value (null owners are one).
    Base candidates all stay; candidates of the added kinds stay if they are live. Null and empty texts have none, rows that
    repeat come out as often, an empty table gives an empty result.
    """
    named = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"), F.col(owner).cast("string").alias("owner"), F.xxhash64("text").alias("digest"))
    scanned = named.mapInArrow(_scan, f"doc_id {dict(named.dtypes)['doc_id']}, owner string, digest long, found {FOUND}")
    scanned = _store.table(scanned.withColumn("row", F.monotonically_increasing_id()), "candidates")
    each = scanned.where(F.size("found") > 0).select("row", "doc_id", F.coalesce("owner", F.lit("\0")).alias("owner"), F.explode("found").alias("c"))
    # distinct holders first, so that a value that a third of the corpus holds is one row per task and holder
    holders = each.groupBy(F.col("c.value").alias("value"), "owner").agg(F.count_distinct("doc_id").alias("n"))
    spread = _store.table(holders.groupBy("value").agg(F.count("owner").alias("owners"), F.sum("n").alias("documents")), "holders")
    live = F.col("c.random") & (F.col("owners") <= MOST_OWNERS)
    span = F.struct(F.col("c.start").alias("start"), F.col("c.kind").alias("kind"), F.col("c.end").alias("end"), live.alias("live"), "owners", "documents")
    added = [k for k, kind in enumerate(KINDS) if not kind[5]]
    judged = each.join(spread, F.col("c.value") == F.col("value")).where(live | ~F.col("c.kind").isin(added))
    lists = judged.groupBy("row").agg(F.array_sort(F.collect_list(span)).alias("judged"))
    none = F.expr("cast(array() as array<struct<start:int,kind:int,end:int,live:boolean,owners:bigint,documents:bigint>>)")
    return scanned.select("row", "doc_id", "digest").join(lists, "row", "left").select("doc_id", "digest", F.coalesce("judged", none).alias("found"))


def listed(found: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*(F.lit(k[0]) for k in KINDS))
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def masked(text: str, spans: list[dict], mask: str) -> str:
    """``text`` with ``mask`` for its spans (start, end); of spans that overlap, for the first and then the longest."""
    out, at = [], 0
    for start, end in sorted((s["start"], -s["end"]) for s in spans):
        if start >= at:
            out += [text[at:start], mask]
            at = -end
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, owner: str = "source", mask: str = "[SECRET]") -> DataFrame:
    """``docs`` with every live secret replaced by ``mask`` (and n_chars, if there, counted anew); all rows stay, those of null
    doc_id too, whatever their other columns are called.

    Of spans that overlap, the first and then the longest is replaced. Rows of null text stay as they are.
    """
    id_, of, live = (fresh(docs, c) for c in ("id_", "of_", "live_"))
    hit = find_secrets(docs, owner).select(F.col("doc_id").alias(id_), F.col("digest").alias(of), F.filter("found", lambda s: s["live"]).alias(live)).where(F.size(live) > 0)
    hit = _store.table(hit.groupBy(id_, of).agg(F.first(live).alias(live)), "live")  # rows equal in both have equal spans
    both = docs.join(hit, docs["doc_id"].eqNullSafe(F.col(id_)) & (F.xxhash64(docs["text"]) == F.col(of)), "left").select(*docs.columns, live)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = {c: batch.column(c) for c in docs_columns}
            some = np.flatnonzero(batch.column(live).is_valid().to_numpy(zero_copy_only=False))
            if len(some):
                clean = columns["text"].to_pylist()
                for i in some.tolist():
                    clean[i] = masked(clean[i], batch.column(live)[i].as_py(), mask)
                columns["text"] = pa.array(clean, columns["text"].type)
                if "n_chars" in columns:
                    size = columns["n_chars"].to_pylist()
                    for i in some.tolist():
                        size[i] = len(clean[i])
                    columns["n_chars"] = pa.array(size, columns["n_chars"].type)
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    docs_columns = docs.columns
    return both.mapInArrow(run, docs.schema)
