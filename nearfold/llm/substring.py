"""Removal of repeated passages with repeated-phrase automata.

1. Of every WINDOW consecutive words, the phrase of PHRASE words with the least hash is chosen, the first among equals: equal
   windows choose equal phrases at equal places. Phrases chosen more than once in the corpus are confirmed as recurring; a
   window that stands in two places holds one.
2. The recurring phrases of the documents of a block make one shard, compiled to an Aho-Corasick automaton; the block's
   documents stream through it, which gives every occurrence. A shard is as large as its block's documents, whatever the
   corpus holds, and a phrase that everything holds is split over all blocks.
3. Windows around an occurrence with the same chosen phrase make a stretch. Equal stretches are judged together by their
   first; windows of first stretches only one by one, and only where a phrase stands in different stretches.

Words are compared by 64-bit hashes, in windows of 20 by hashes of those.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _store
from ._links import matched, sifted
from ._words import SPACE, U64, blocks, lists, longs, mix, window_hash, words

WINDOW, PHRASE = 20, 6
#: A word is two letters of 32 in an automaton, a phrase 60 bits.
_LETTER_BITS = 5
_WORD_BITS = 2 * _LETTER_BITS
#: The document of null ids in the order of documents.
_LAST = (1 << 63) - 1
#: What tells rows apart: the document's place in the order, and a hash of the text. Rows equal in both are one.
_ROW = ("rank", "of")


def chosen(hashes: np.ndarray, doc: np.ndarray, window: int, phrase: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(codes of the words, key of each phrase, stretches (first window, last window), place of the phrase of each)."""
    code = (hashes & U64((1 << _WORD_BITS) - 1)).astype(np.int64)
    n = len(hashes) - window + 1
    if n <= 0:
        none = np.empty(0, np.int64)
        return code, none, none.reshape(0, 2), none
    m = len(hashes) - phrase + 1
    key = np.zeros(m, np.int64)
    for j in range(phrase):
        key = (key << _WORD_BITS) | code[j : j + m]
    rank = mix(key.astype(U64))
    best, place = rank[:n].copy(), np.arange(n)
    for j in range(1, window - phrase + 1):
        less = rank[j : j + n] < best
        best[less] = rank[j : j + n][less]
        place[less] = np.flatnonzero(less) + j
    whole = doc[:n] == doc[window - 1 :]
    new = np.ones(n, bool)
    new[1:] = (place[1:] != place[:-1]) | ~whole[:-1]
    first = np.flatnonzero(new & whole)
    end = np.ones(n, bool)
    end[:-1] = (place[1:] != place[:-1]) | ~whole[1:]
    last = np.flatnonzero(end & whole)
    return code, key, np.stack([first, last], axis=1), place[first]


def _phrases(window: int, phrase: int):
    """(key, rank, of, n): the chosen phrases of each text, each once, with its number of places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, buf, bounds in blocks(batch.column("text")):
                hashes, _, _, first = words(buf, bounds, SPACE)
                doc = np.repeat(np.arange(hi - lo), np.diff(first))
                _, key, _, place = chosen(hashes, doc, window, phrase)
                if len(place):
                    mine, doc = key[place], doc[place]
                    order = np.lexsort([mine, doc])
                    mine, doc = mine[order], doc[order]
                    start = np.flatnonzero(np.concatenate([[True], (mine[1:] != mine[:-1]) | (doc[1:] != doc[:-1])]))
                    own = [batch.column(c).slice(lo, hi - lo).take(pa.array(doc[start])) for c in _ROW]
                    yield pa.RecordBatch.from_arrays([longs(mine[start]), *own, longs(np.diff(np.append(start, len(mine))))], ["key", *_ROW, "n"])

    return run


def _letters(code: np.ndarray) -> str:
    out = np.empty(2 * len(code), np.uint8)
    out[0::2], out[1::2] = 64 + (code >> _LETTER_BITS), 64 + (code & ((1 << _LETTER_BITS) - 1))
    return out.tobytes().decode("latin-1")


def automaton(keys: np.ndarray, phrase: int):
    """Aho-Corasick automaton of phrases by their keys."""
    import ahocorasick

    code = np.stack([(keys >> (_WORD_BITS * (phrase - 1 - j))) & ((1 << _WORD_BITS) - 1) for j in range(phrase)], axis=1)
    text, width, out = _letters(code.ravel()), 2 * phrase, ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
    for k in range(len(keys)):
        out.add_word(text[k * width : (k + 1) * width])
    out.make_automaton()
    return out


def _stretches(window: int, phrase: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, buf, bounds in blocks(batch.column("text")):
                hashes, _, _, first = words(buf, bounds, SPACE)
                doc = np.repeat(np.arange(hi - lo), np.diff(first))
                code, key, runs, place = chosen(hashes, doc, window, phrase)
                shard = np.unique(batch.column("keys").slice(lo, hi - lo).flatten().to_numpy())
                if not len(place) or not len(shard):
                    continue
                ends = np.fromiter((end for end, _ in automaton(shard, phrase).iter(_letters(code))), np.int64)
                at = np.zeros(len(hashes), bool)
                at[(ends[ends & 1 == 1] >> 1) - phrase + 1] = True  # occurrences, those between letters of one word left out
                keep = at[place]
                runs, place = runs[keep], place[keep]
                if not len(place):
                    continue
                each = window_hash(hashes, window)
                sizes = runs[:, 1] - runs[:, 0] + 1
                owner = np.repeat(np.arange(len(runs)), sizes)
                nth = np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                mine = each[np.repeat(runs[:, 0], sizes) + nth]
                whole = np.add.reduceat(mix(mine + mix(nth.astype(U64))), np.cumsum(sizes) - sizes)
                own = [batch.column(c).slice(lo, hi - lo).take(pa.array(doc[place])) for c in (*_ROW, "tie")]
                yield pa.RecordBatch.from_arrays([*own, longs(runs[:, 0] - first[doc[place]]), longs(key[place]), longs(mix(whole)), lists(mine, sizes)], [*_ROW, "tie", "at", "key", "stretch", "windows"])

    return run


def _cut(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, text = batch.column("doc_id"), batch.column("text").to_pylist()
            ranges = batch.column("ranges").to_pylist() if "ranges" in batch.schema.names else [None] * len(text)
            total, removed, kept = [], [], []
            for t, r in zip(text, ranges):
                w = (t or "").encode().split()  # at ASCII white space, which bytes know alone
                total.append(len(w))
                if r:
                    change = np.zeros(len(w) + 1, np.int32)
                    np.add.at(change, [x["at"] for x in r], 1)
                    np.add.at(change, [x["at"] + x["n"] + window - 1 for x in r], -1)
                    w = list(compress(w, np.cumsum(change[:-1]) == 0))
                removed.append(total[-1] - len(w))
                kept.append(b" ".join(w).decode())
            yield pa.RecordBatch.from_arrays([ids, longs(np.array(total)), longs(np.array(removed)), pa.array(kept, pa.string()), pa.array([hashlib.sha256(k.encode()).hexdigest() for k in kept], pa.string())], ["doc_id", "n_words", "n_removed", "kept", "kept_sha256"])

    return run


def remove_repeats(docs: DataFrame, window: int = WINDOW, phrase: int = PHRASE) -> DataFrame:
    """(doc_id, n_words, n_removed, kept, kept_sha256) for every row of ``docs`` (doc_id, text; more columns are not read).

    Every word is removed that some window of ``window`` words covers whose words also stand at an earlier place: in a document
    of smaller doc_id, or earlier in the same one. Words are split at ASCII white space. ``kept``: the other words, joined by
    one space. Null and empty texts have no words. Each row is judged by the places of its own text: rows that share a doc_id are
    one document, whose equal places are not earlier than each other. Rows of null doc_id are documents of their own, after
    all others, in the order of a hash of their texts; those of equal text are one. An empty table gives an empty result.
    """
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    of = F.xxhash64("text")
    ranked = named.select("doc_id", F.coalesce("doc_id", F.lit(_LAST)).alias("rank"), of.alias("of"), F.when(F.col("doc_id").isNull(), of).otherwise(0).alias("tie"), "text")
    row = "rank long, of long"
    phrases = _store.table(ranked.mapInArrow(_phrases(window, phrase), f"key long, {row}, n long"), "phrases")
    recurring = _store.table(phrases.groupBy("key").agg(F.sum("n").alias("places"), F.count(F.lit(1)).alias("rows")).where("places > 1"), "recurring")
    held = matched(phrases.select("key", *_ROW), recurring.select("key", "rows"), "key").groupBy(*_ROW).agg(F.collect_set("key").alias("keys"))
    held = _store.table(held, "held")
    # in Spark, not in Python: a task then has one Python worker at a time
    some, rest = sifted(ranked, held, {c: F.col(c) for c in _ROW})
    found = some.drop("doc_id").join(held, list(_ROW)).mapInArrow(_stretches(window, phrase), f"{row}, tie long, at long, key long, stretch long, windows array<long>")
    found = _store.table(found, "stretches")

    place = F.struct("rank", "tie", "at")
    firsts = _store.table(found.groupBy("stretch").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("rows")), "firsts")
    judged = matched(found.select(*_ROW, "tie", "at", "key", "stretch", F.size("windows").alias("n")), firsts, "stretch").withColumn("later", place != F.col("first"))
    judged = _store.table(judged.drop("first", "rows"), "judged")
    whole = judged.where("later").select(*_ROW, "at", F.col("n").cast("long").alias("n"))
    # a window's first place lies in a stretch that is the first of its kind
    first = judged.where("not later").select("key", "stretch", *_ROW, "at")
    various = first.groupBy("key").agg(F.min("stretch").alias("x"), F.max("stretch").alias("y"), F.count(F.lit(1)).alias("rows")).where("x < y").select("key", "rows")
    several = matched(first, _store.table(various, "various"), "key").select("stretch", *_ROW, "at")
    heads = found.select("stretch", *_ROW, "tie", "at", "windows").join(several, ["stretch", *_ROW, "at"], "left_semi").dropDuplicates(["stretch", *_ROW, "at"])
    single = _store.table(heads.select(*_ROW, "tie", "at", F.posexplode("windows").alias("nth", "hash")).select(*_ROW, "tie", (F.col("at") + F.col("nth")).alias("at"), "hash"), "windows")
    earliest = _store.table(single.groupBy("hash").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("rows")).where("rows > 1"), "earliest")
    alone = matched(single, earliest, "hash").where(place != F.col("first")).select(*_ROW, "at", F.lit(1).cast("long").alias("n"))
    # written, so that the join can be dealt anew where many rows are equal
    ranges = _store.table(whole.union(alone).groupBy(*_ROW).agg(F.collect_set(F.struct("at", "n")).alias("ranges")), "ranges")

    schema = "doc_id long, n_words long, n_removed long, kept string, kept_sha256 string"
    cut = some.join(ranges, list(_ROW), "left").select("doc_id", "text", "ranges").mapInArrow(_cut(window), schema)
    return cut.union(rest.select("doc_id", "text").mapInArrow(_cut(window), schema))
