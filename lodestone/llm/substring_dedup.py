"""Substring dedup: repeated windows of words found through recompression.

Every token is named by a hash of its bytes, so names agree everywhere without a dictionary. A round first names runs
(a token beside an equal one gets its run's name), then names pairs: a hash bit deals each symbol to the left or right side,
and each left symbol followed by a right one becomes one symbol named after both. What a round does inside a stretch of
words depends on the stretch alone but for two symbols at either end, so after `ROUNDS` rounds, equal windows agree on every
symbol that begins EDGE words or more from their ends. Of the symbols that begin in any SPREAD neighbouring places, the
one with the least name is an anchor; its key names the REACH words from there on. Hence equal windows share an anchor key.

Keys that several documents hold reveal where windows may repeat; there every window is named by 128 bits, the least
id for each name is found by partial minima, and a window that also starts in a document with a smaller id is removed. Documents equal in all words form a class first; only the
least id of a class goes on, the others are wholly removed if they have a window at all.

Defined results: null or empty texts have no words; rows with a null id lose nothing and give nothing; rows that repeat an id are
judged each by its own text, and a window in one of them does not count against another; texts of any length are read whole; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, text_batches

WINDOW = 50
ROUNDS = 3
EDGE = 2 * (2**ROUNDS - 1)  # two symbols a round, of at most 2^round words
REACH = 16
SPREAD = WINDOW - 2 * EDGE + EDGE - REACH + 1  # places in a window where an anchor may begin: EDGE to WINDOW - REACH


def recompress(h, text):
    """(place, name) of the symbols after ROUNDS rounds over words named h, of the texts numbered by text."""
    import numpy as np

    from .tokens import mix

    place, name = np.arange(len(h)), h
    for r in range(ROUNDS):
        if len(name) < 2:
            break
        beside = text[place[1:]] == text[place[:-1]]
        equal = (name[1:] == name[:-1]) & beside
        run = np.concatenate(([False], equal)) | np.concatenate((equal, [False]))
        name = np.where(run, mix(name + np.uint64(0x632BE59BD9B4E019)), name)
        side = (mix(name ^ np.uint64(0xD1B54A32D192ED03 + r)) & np.uint64(1)).astype(bool)
        pair = np.concatenate((~side[:-1] & side[1:] & beside, [False]))
        named = mix(name * np.uint64(0xAEF17502108EF2D9) + np.concatenate((name[1:], name[:1])) * np.uint64(0xC6A4A7935BD1E995) + np.uint64(r))
        name = np.where(pair, named, name)
        stay = np.concatenate(([True], ~pair[:-1]))
        place, name = place[stay], name[stay]
    return place, name


def anchors(h, first):
    """Places of the anchors of each text's words h[first[i]:first[i + 1]], ascending, and their keys."""
    import numpy as np

    from .tokens import sequences

    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    place, name = recompress(h, text)
    last = first[1:][text[place]] - REACH
    place, name = place[place <= last], name[place <= last]
    if not len(place):
        return place, np.zeros(0, np.uint64)
    # Each window of SPREAD places within one text picks its least name, the rightmost of equal ones: a symbol is an
    # anchor if no symbol near enough on either side beats it on both sides at once.
    order = np.argsort(name, kind="stable")
    rank = np.empty(len(name), np.int64)
    rank[order] = np.cumsum(np.concatenate(([0], (name[order][1:] != name[order][:-1]).astype(np.int64))))
    before = np.full(len(place), -SPREAD * 2, np.int64)  # nearest place to the left with a lesser name
    after = np.full(len(place), 1 << 60, np.int64)  # nearest to the right with one not greater
    where = text[place]
    for step in range(1, SPREAD):
        if step >= len(place):
            break
        near = (place[step:] - place[:-step] < SPREAD) & (where[step:] == where[:-step])
        if not near.any():
            break
        lesser = near & (rank[:-step] < rank[step:]) & (before[step:] < 0)
        before[step:][lesser] = place[:-step][lesser]
        bound = near & (rank[step:] <= rank[:-step]) & (after[:-step] == 1 << 60)
        after[:-step][bound] = place[step:][bound]
    begin, end = first[where], first[where + 1] - REACH  # places of the text
    left = np.maximum(np.where(before < 0, begin, before + 1), begin)
    right = np.minimum(np.where(after == 1 << 60, end, after - 1), end)
    chosen = right - left + 1 >= SPREAD
    place = place[chosen]
    return place, sequences(h, REACH)[place]


def _names(w, lo, hi, h):
    """Two hashes of each window of WINDOW words that starts in lo <= place < hi."""
    import numpy as np

    from .tokens import PLACES, mix

    a, b = np.zeros(hi - lo, np.uint64), np.zeros(hi - lo, np.uint64)
    other = mix(h[lo : hi + WINDOW - 1] ^ np.uint64(0x94D049BB133111EB))
    for j in range(WINDOW):
        a += h[lo + j : hi + j] * PLACES[j]
        b += other[j : hi - lo + j] * PLACES[j]
    return mix(a).view(np.int64), mix(b).view(np.int64)


def kept_digest(data, start, end) -> str:
    """SHA-256 of the words joined by one space."""
    import hashlib

    raw = data.tobytes()
    return hashlib.sha256(b" ".join(raw[a:b] for a, b in zip(start.tolist(), end.tolist(), strict=True))).hexdigest()


def _facts(docs: DataFrame) -> DataFrame:
    """doc_id, row, n words, a 128-bit name of the sequence of words (h1, h2)."""

    def work(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        from .tokens import hashes, mix, words

        for whole in batches:
            for batch in text_batches(whole, 1):
                w = words(batch.column(1))
                h = hashes(w)
                size = np.diff(w.first)
                at = (np.arange(len(h)) - np.repeat(w.first[:-1], size)).astype(np.uint64)
                sums = []
                for salt in (0x8CB92BA72F3D8DD7, 0xABC98388FB8FAC03):
                    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(h ^ mix(at + np.uint64(salt))))))
                    sums.append((total[w.first[1:]] - total[w.first[:-1]]).view(np.int64))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(size, pa.int64()), *map(pa.array, sums)], ["doc_id", "row", "n", "h1", "h2"])

    return docs.select("doc_id", "text", "row").mapInArrow(work, "doc_id long, row long, n long, h1 long, h2 long")


def _anchor_keys(docs: DataFrame) -> DataFrame:
    """(key, doc_id), once each, for texts with a window."""

    def work(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        from .tokens import hashes, words

        for whole in batches:
            for batch in text_batches(whole, 1):
                w = words(batch.column(1))
                h = hashes(w)
                place, key = anchors(h, w.first)
                doc = np.searchsorted(w.first, place, "right") - 1
                ok = (np.diff(w.first) >= WINDOW)[doc] & ~np.asarray(batch.column(0).is_null())[doc]
                key, doc = key[ok], doc[ok]
                order = np.lexsort((key, doc))
                key, doc = key[order], doc[order]
                once = np.concatenate(([True], (key[1:] != key[:-1]) | (doc[1:] != doc[:-1]))) if len(key) else np.zeros(0, bool)
                ids = np.asarray(batch.column(0).fill_null(0))
                yield pa.RecordBatch.from_arrays([pa.array(key[once].view(np.int64)), pa.array(ids[doc[once]])], ["key", "doc_id"])

    return docs.mapInArrow(work, "key long, doc_id long")


def _windows(docs: DataFrame) -> DataFrame:
    """Names of the windows that hold an anchor among `keys`, of rows (doc_id, text, keys, row): doc_id, row, place, h1, h2."""

    def work(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        from .tokens import hashes, words

        for whole in batches:
            for batch in text_batches(whole, 1):
                w = words(batch.column(1))
                h = hashes(w)
                place, key = anchors(h, w.first)
                edge = np.searchsorted(place, w.first)
                out = [[], [], [], [], []]
                for i, keys in enumerate(batch.column(2)):
                    begin, end = int(w.first[i]), int(w.first[i + 1])
                    if end - begin < WINDOW:
                        continue
                    own = place[edge[i] : edge[i + 1]]
                    own = own[np.isin(key[edge[i] : edge[i + 1]], keys.values.to_numpy(zero_copy_only=False).view(np.uint64))]
                    if not len(own):
                        continue
                    marks = np.zeros(end - begin - WINDOW + 2, np.int64)
                    lo = np.maximum(own + REACH - WINDOW, begin) - begin
                    hi = np.minimum(own + 1, end - WINDOW + 1) - begin
                    some = lo < hi
                    np.add.at(marks, lo[some], 1)
                    np.add.at(marks, hi[some], -1)
                    starts = np.flatnonzero(np.cumsum(marks)[:-1] > 0)
                    if not len(starts):
                        continue
                    a, b = _names(w, begin, end - WINDOW + 1, h)
                    for o, x in zip(out, (np.full(len(starts), batch.column(0)[i].as_py(), np.int64), np.full(len(starts), batch.column(3)[i].as_py(), np.int64), starts.astype(np.int32), a[starts], b[starts]), strict=True):
                        o.append(x)
                if out[0]:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(o)) for o in out], ["doc_id", "row", "place", "h1", "h2"])

    return docs.mapInArrow(work, "doc_id long, row long, place int, h1 long, h2 long")


def _judged(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, text, n, whole, places) with their removals applied."""

    def work(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        from .tokens import words

        for whole in batches:
            for batch in text_batches(whole, 1):
                w = words(batch.column(1))
                removed, digest, texts = [], [], []
                for i, (copy, places) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3), strict=True)):
                    begin, end = int(w.first[i]), int(w.first[i + 1])
                    keep = np.ones(end - begin, bool)
                    if copy and len(keep) >= WINDOW:
                        keep[:] = False
                    elif places.is_valid and len(keep) >= WINDOW:
                        marks = np.zeros(len(keep) + 1, np.int64)
                        at = places.values.to_numpy(zero_copy_only=False)
                        np.add.at(marks, at, 1)
                        np.add.at(marks, at + WINDOW, -1)
                        keep = np.cumsum(marks)[:-1] <= 0
                    removed.append(int((~keep).sum()))
                    digest.append(kept_digest(w.data[w.offsets[i] : w.offsets[i + 1]], w.start[begin:end][keep] - w.offsets[i], w.end[begin:end][keep] - w.offsets[i]))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(w.first), pa.int64()), pa.array(removed, pa.int64()), pa.array(digest, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    return docs.mapInArrow(work, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def removals(docs: DataFrame) -> DataFrame:
    """(doc_id, row, whole, places): for rows with removed words, whether all of it goes, or where removed windows start."""
    facts = cut(_facts(docs)).filter("doc_id is not null")
    least = facts.filter(F.col("n") >= WINDOW).groupBy("h1", "h2", "n").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).filter("least < most")
    marked = facts.join(least, ["h1", "h2", "n"], "left").select("doc_id", "row", F.coalesce(F.col("doc_id") > F.col("least"), F.lit(False)).alias("copy"))
    marked = cut(marked.distinct())
    copies = marked.filter("copy").select("doc_id", "row")
    gone = marked.groupBy("doc_id").agg(F.min("copy").alias("all")).filter("all").select("doc_id")  # ids of which every row is a copy
    keys = _anchor_keys(docs).join(gone, "doc_id", "left_anti")
    shared = keys.groupBy("key").agg(F.min("doc_id").alias("x"), F.max("doc_id").alias("y")).filter("x < y").select("key")
    holders = keys.join(shared, "key").groupBy("doc_id").agg(F.collect_set("key").alias("keys"))
    windows = cut(_windows(docs.join(holders, "doc_id").select("doc_id", "text", "keys", "row")))
    first = windows.groupBy("h1", "h2").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).filter("least < most").select("h1", "h2", "least")
    later = windows.join(first, ["h1", "h2"]).filter("doc_id > least").groupBy("doc_id", "row").agg(F.collect_set("place").alias("places"))
    later = later.join(copies, ["doc_id", "row"], "left_anti")
    return later.select("doc_id", "row", F.lit(False).alias("whole"), "places").unionByName(copies.select("doc_id", "row", F.lit(True).alias("whole"), F.lit(None).cast("array<int>").alias("places")))


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: doc_id, n_words, n_removed, kept_sha256."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(F.col(text_col)).alias("row"))
    return _judged(docs.join(removals(docs), ["doc_id", "row"], "left").select("doc_id", "text", "whole", "places"))


ORACLE = f"""
WITH w AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents),
v AS (SELECT doc_id, unnest(range(1, len(ws) - {WINDOW - 2})) AS i, ws FROM w WHERE len(ws) >= {WINDOW}),
k AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY array_to_string(ws[i:i + {WINDOW - 1}], ' ')) AS f FROM v),
g AS (SELECT DISTINCT doc_id, unnest(range(i, i + {WINDOW})) AS j FROM k WHERE f < doc_id),
x AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS j FROM w),
h AS (SELECT x.doc_id, string_agg(word, ' ' ORDER BY j) AS kept FROM x ANTI JOIN g USING (doc_id, j) GROUP BY x.doc_id),
c AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(c.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN h USING (doc_id) LEFT JOIN c USING (doc_id)"""
