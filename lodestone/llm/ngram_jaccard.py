"""N-gram Jaccard join by PartEnum signatures.

A document is the set of its distinct n-word shingles. Sizes fall into bands whose ends are a factor 1 / threshold
apart, so a pair that links lies in one band or in two neighbours; a set is enumerated in its own band and, if a partner
may lie there, in the next. Within a band, linked sets differ in at most k elements. The hash domain is cut into n1 first-level
partitions of three second-level ones. Were every first-level partition to differ in two elements or more, the sets would differ in
more than k; so some partition differs in at most one, and two of its three second-level partitions are equal. Each
subset of two is a signature. Subsets without an element are not emitted; a set for which that may hide an equal
partition (few elements) emits its prefix in hash order too, which two linked sets always share a member of. So no link is lost.

The same count says how many signatures of a band a linked pair shares at least: an element that differs spoils two of a partition's
signatures, or the last one. Pairs that share fewer are no candidates. Hot groups (HOT sets or more) are mostly passages that many
documents repeat: a set that must share t signatures leaves the 2 (t - 1) / 3 largest of its hot groups, sizes compared alike
everywhere, so that a linked pair still shares more than a third of t.

Equal sets form a class at once and only the smallest id of each class goes on. A signature travels as 5 bytes with the step from
the id before it, whatever the number of buckets, and meets its like in a bucket of bounded size; a signature that is frequent within a
block of documents goes as lists of ids instead, spread over all buckets. Groups with the same members are merged by a hash of them.
Stars (least member, other) of a quarter of the hot groups, verified on whole sets, give components first; groups that
still span several components then yield their cross pairs, large groups in pairs of blocks. All pairs stand behind exact lower bounds on the
difference (sizes, counts of hash ranges) and on shared signatures. Thus copies never meet in pairs, and no cross pair is skipped.

Defined results: null or empty texts and texts without words have no shingles and link with nothing; a null id takes no
part and gets a null component; rows that repeat an id give a row each and share its links; texts of any length count whole; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, perhaps_among, text_batches
from .components import components

# The threshold as a fraction: 75 of 100.
NUMERATOR, DENOMINATOR = 75, 100
SLACK = 1.25  # more first-level partitions than needed, so that few sets need their prefix too
RECORDS = 2_000_000  # packed records that a task holds before it passes them on
BUCKET = 4_000_000  # signatures a bucket, about
RANGES = 256  # ranges whose counts (up to 15) bound the difference of two sets
OFTEN = 64  # sets of a block that share a signature, from which on it goes as a list of ids
HOT = 16  # members from which on a group counts as hot
BLOCK = 2048  # members of a group in a block
STAR = 4096  # members of a star checked in one run


def max_difference(a: int, b: int) -> int:
    """The largest size of the symmetric difference of linked sets of these sizes."""
    return (a + b) * (DENOMINATOR - NUMERATOR) // (DENOMINATOR + NUMERATOR)


def largest_partner(a: int) -> int:
    return a * DENOMINATOR // NUMERATOR


class Bands:
    """Bands of sizes: (low, high, first-level partitions)."""

    def __init__(self) -> None:
        self.all: list[tuple[int, int, int]] = []
        self.known: dict[int, list[tuple[int, int, int]]] = {}
        self.own: dict[int, int] = {}

    def of(self, size: int) -> list[tuple[int, int, int]]:
        """(band, partitions, largest difference from a partner) for each band in which a set of this size is enumerated."""
        if size not in self.known:
            while not self.all or self.all[-1][0] <= largest_partner(size):
                low = self.all[-1][1] + 1 if self.all else 1
                high = largest_partner(low)
                k = max_difference(high, high)
                self.all.append((low, high, int((k + 1) / 2 * SLACK) + 1 if k else 0))
            own = next(i for i, (_, high, _) in enumerate(self.all) if size <= high)
            self.own[size] = own
            some = [own] + [own + 1] * (largest_partner(size) >= self.all[own + 1][0])
            self.known[size] = [(i, self.all[i][2], max_difference(size, min(self.all[i][1], largest_partner(size)))) for i in some if self.all[i][2]]
        return self.known[size]


def filled_parts(items, n1: int):
    """The second-level partition of each of the sorted hashes, where each one begins, and which have an element (n1 rows of three)."""
    import numpy as np

    part = ((items >> np.uint64(32)) * np.uint64(3 * n1)) >> np.uint64(32)
    begin = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
    full = np.zeros(3 * n1, bool)
    part = part[begin].astype(np.int64)
    full[part] = True
    return part, begin, full.reshape(n1, 3)


def shared_at_least(full, most: int) -> int:
    """How many signatures a set shares at least with one that differs from it in `most` elements: the first element in a partition
    spoils two of its signatures, the second one the last."""
    count = full.sum(1)
    single, several = int((count == 1).sum()), int((count > 1).sum())
    first = min(most, single + several)
    return 2 * single + 3 * several - 2 * first - min(most - first, several)


def bounds_of(items, bands: Bands) -> tuple[int, int, int]:
    """A set's band, and how many signatures of that band and of the next it shares at least with any set that links with it there (0:
    only the prefix is sure)."""
    sure = [0, 0]
    some = bands.of(len(items))
    own = bands.own[len(items)]
    for band, n1, most in some:
        sure[band - own] = shared_at_least(filled_parts(items, n1)[2], most)
    return own, sure[0], sure[1]


def signatures(items, bands: Bands):
    """PartEnum signatures of a set of sorted hashes; none where only equal sets link."""
    import numpy as np

    from .tokens import mix

    out = []
    size = len(items)
    mixed = mix(items ^ np.uint64(0x5851F42D4C957F2D))
    unsafe = False
    for band, n1, most in bands.of(size):
        part, begin, full = filled_parts(items, n1)
        total = np.zeros(3 * n1, np.uint64)
        total[part] = np.add.reduceat(mixed, begin)
        total = total.reshape(n1, 3)
        own = (np.arange(n1, dtype=np.uint64) << np.uint64(2)) + (np.uint64(band) << np.uint64(40))
        for i, (a, b) in enumerate(((0, 1), (0, 2), (1, 2))):
            some = full[:, a] | full[:, b]
            out.append(of_kind(mix(mix(total[some, a] + own[some] + np.uint64(i)) + total[some, b] * np.uint64(0x9FB21C651E98DF25)), band & 1))
        unsafe |= not shared_at_least(full, most)
    if unsafe:
        out.append(of_kind(mix(items[: size - -(-size * NUMERATOR // DENOMINATOR) + 1] ^ np.uint64(0x2545F4914F6CDD1D)), 2))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def of_kind(sig, kind: int):
    """Signatures whose two bits from 24 on say that they are of an even band (0), an odd one (1) or a prefix (2)."""
    import numpy as np

    return (sig & ~np.uint64(3 << 24)) | np.uint64(kind << 24)


def packed_counts(items, ranges: int):
    """Counts of the set's members in equal ranges of hashes, at most 15, two a byte."""
    import numpy as np

    shift = np.uint64(64 - ranges.bit_length() + 1)
    count = np.minimum(np.bincount((items >> shift).astype(np.int64), minlength=ranges), 15).astype(np.uint8)
    return count[::2] | (count[1::2] << 4)


def unpacked_counts(packed):
    """Rows of counts from rows of packed ones."""
    import numpy as np

    return np.stack((packed & 15, packed >> 4), 2).reshape(len(packed), -1)


def _described(docs: DataFrame, n: int) -> DataFrame:
    """doc_id, n_shingles, a 128-bit hash of the set (h1, h2), the counts of its hash ranges, and what bounds_of says."""

    def work(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        from .tokens import mix, shingle_sets

        bands = Bands()
        for whole in batches:
            for batch in text_batches(whole, 1):
                sets = shingle_sets(batch.column(1), n)
                h1 = [int(mix(s).sum().view(np.int64)) for s in sets]
                h2 = [int(mix(s ^ np.uint64(0x9E6C63D0876A9A99)).sum().view(np.int64)) for s in sets]
                ranges = [packed_counts(s, RANGES).tobytes() for s in sets]
                sure = list(zip(*(bounds_of(s, bands) if len(s) else (0, 0, 0) for s in sets), strict=True))
                cols = [batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array(ranges, pa.binary()), *(pa.array(x, pa.int32()) for x in sure)]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n", "h1", "h2", "ranges", "band", "sure", "sure_next"])

    return docs.mapInArrow(work, "doc_id long, n long, h1 long, h2 long, ranges binary, band int, sure int, sure_next int")


def pack_ids(ids) -> tuple[int, int, bytes]:
    """Ascending ids as the first one, the width of a step in bytes, and the steps from each one to the next."""
    import numpy as np

    steps = np.diff(ids.view(np.uint64), prepend=ids[:1].view(np.uint64))
    width = next(w for w in (1, 2, 4, 8) if int(steps.max()) < 1 << 8 * w)
    return int(ids[0]), width, steps.astype(f"<u{width}").tobytes()


def unpack_ids(first: int, width: int, steps: bytes):
    import numpy as np

    return (np.cumsum(np.frombuffer(steps, f"<u{width}"), dtype=np.uint64) + np.array([first], np.int64).view(np.uint64)).view(np.int64)


def _packed(docs: DataFrame, n: int, buckets: int) -> DataFrame:
    """Signatures of blocks of documents by bucket: 5 bytes of each, and packed ids. Those that OFTEN sets of a block share are only
    named to their bucket (`often`); the ids go as a row of their own, with the group's gid, to any bucket."""

    def work(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        from .tokens import mix, shingle_sets

        bands, seen = Bands(), set()
        found: list = []
        ids: list[int] = []
        five = lambda sig: np.ascontiguousarray(sig.view(np.uint8).reshape(-1, 8)[:, 3:]).tobytes()

        def flush():
            by_id = np.argsort(np.array(ids, np.int64), kind="stable")
            sig = np.concatenate([found[i] for i in by_id])
            doc = np.repeat(np.array(ids, np.int64)[by_id], [len(found[i]) for i in by_id])
            found.clear()
            ids.clear()
            rows = []
            ordered = np.sort(sig)
            often = np.unique(ordered[OFTEN - 1 :][ordered[OFTEN - 1 :] == ordered[: len(ordered) - OFTEN + 1]]) if len(sig) >= OFTEN else sig[:0]
            if len(often):
                hot = np.isin(sig, often)
                some, names = sig[hot], doc[hot]
                order = np.argsort(some, kind="stable")
                edge = [*np.searchsorted(some[order], often).tolist(), len(some)]
                names = names[order]
                spread = mix(often + np.uint64(int(names[0]) & (1 << 63) - 1)) % np.uint64(buckets)
                for i, gid in enumerate(gid_of_signature(often >> np.uint64(24), often % np.uint64(buckets)).tolist()):
                    rows.append((int(spread[i]), five(often[i : i + 1]), *pack_ids(names[edge[i] : edge[i + 1]]), b"", gid))
                sig, doc = sig[~hot], doc[~hot]
            bucket = (sig % np.uint64(buckets)).astype(np.uint16 if buckets <= 1 << 16 else np.uint32)
            order = np.argsort(bucket, kind="stable")
            sig, doc, bucket = sig[order], doc[order], bucket[order]
            own = (often % np.uint64(buckets)).astype(np.int64)
            for b in np.union1d(bucket, own).tolist():
                lo, hi = np.searchsorted(bucket, [b, b + 1]).tolist()
                rows.append((b, five(sig[lo:hi]), *(pack_ids(doc[lo:hi]) if hi > lo else (0, 1, b"")), five(often[own == b]), None))
            for at in range(0, len(rows), 16):
                cols = list(zip(*rows[at : at + 16], strict=True))
                kinds = (pa.int32(), pa.binary(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["bucket", "sigs", "first", "width", "steps", "often", "gid"])

        held = 0
        for whole in batches:
            for batch in text_batches(whole, 1):
                for doc, s in zip(batch.column(0).to_pylist(), shingle_sets(batch.column(1), n), strict=True):
                    if doc is None or not len(s):
                        continue
                    key = (len(s), int(s[0]), int(s[-1]), int(s.sum()))
                    if key in seen:  # an equal set of this task has emitted already
                        continue
                    if len(seen) > 500_000:
                        seen.clear()
                    seen.add(key)
                    sig = signatures(s, bands)
                    if len(sig):
                        found.append(sig)
                        ids.append(doc)
                        held += len(sig)
                    if held >= RECORDS:
                        yield from flush()
                        held = 0
        if found:
            yield from flush()

    return docs.mapInArrow(work, "bucket int, sigs binary, first long, width int, steps binary, often binary, gid long")


def gid_of_signature(sig, bucket):
    """The gid of groups that are named by their signature (its 5 bytes and its bucket)."""
    import numpy as np

    from .tokens import mix

    return mix(mix(sig ^ np.uint64(0x8CB92BA72F3D8DD7)) + bucket.astype(np.uint64)).view(np.int64)


def pairs_within(size, limit: int):
    """Index pairs (x < y) inside consecutive groups of these sizes, in portions of about `limit` pairs."""
    import numpy as np

    end = np.repeat(np.cumsum(size), size)
    partners = end - np.arange(len(end)) - 1
    slot = np.cumsum(partners) // limit
    edge = np.concatenate((np.flatnonzero(np.concatenate(([True], slot[1:] != slot[:-1]))), [len(slot)])).tolist() if len(slot) else [0]
    for lo, hi in zip(edge[:-1], edge[1:], strict=True):
        count = partners[lo:hi]
        x = np.repeat(np.arange(lo, hi), count)
        yield x, x + 1 + np.arange(len(x)) - np.repeat(np.cumsum(count) - count, count)


def near_enough(n_a, n_b, counts_a, counts_b):
    """Whether sizes and counts of hash ranges allow a link."""
    import numpy as np

    ok = np.minimum(n_a, n_b) * DENOMINATOR >= np.maximum(n_a, n_b) * NUMERATOR
    far = np.abs(counts_a.astype(np.int16) - counts_b).sum(1)
    return ok & (far * (DENOMINATOR + NUMERATOR) <= (n_a + n_b) * (DENOMINATOR - NUMERATOR))


def _grouped(packed: DataFrame) -> DataFrame:
    """(gid, kind, doc) of each signature that several ids share, by bucket; gid is a hash of the ids, or, where a signature
    comes in lists (named), of the signature."""

    def work(table):
        import numpy as np
        import pyarrow as pa

        from .tokens import mix

        def wide(raw: bytes):
            out = np.zeros((len(raw) // 5, 8), np.uint8)
            out[:, :5] = np.frombuffer(raw, np.uint8).reshape(-1, 5)
            return out.view(np.uint64).ravel()

        sigs, docs, often, out = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)], []
        for s, first, width, steps, o, gid in zip(*(table.column(c).to_pylist() for c in ("sigs", "first", "width", "steps", "often", "gid")), strict=True):
            ids = unpack_ids(first, width, steps)
            if gid is None:
                sigs.append(wide(s))
                docs.append(ids)
                often.append(wide(o))
            else:
                out.append((np.full(len(ids), gid, np.int64), np.full(len(ids), int(wide(s)[0]) & 3, np.int32), ids, np.ones(len(ids), bool)))
        sig, doc, often = np.concatenate(sigs), np.concatenate(docs), np.unique(np.concatenate(often))
        del sigs, docs
        order = np.argsort(sig)
        sig = sig[order]
        same = sig[1:] == sig[:-1]
        shared = np.concatenate((same, [False])) | np.concatenate(([False], same)) if len(sig) else np.zeros(0, bool)
        if len(often):
            shared |= often[np.minimum(np.searchsorted(often, sig), len(often) - 1)] == sig
        sig, doc = sig[shared], doc[order[shared]]
        order = np.lexsort((doc, sig))
        sig, doc = sig[order], doc[order]
        if len(sig):
            once = np.concatenate(([True], (sig[1:] != sig[:-1]) | (doc[1:] != doc[:-1])))
            sig, doc = sig[once], doc[once]
            first = np.flatnonzero(np.concatenate(([True], sig[1:] != sig[:-1])))
            size = np.diff(np.concatenate((first, [len(sig)])))
            kind = (sig & np.uint64(3)).astype(np.int32)
            gid = mix(np.add.reduceat(mix(doc.view(np.uint64) * np.uint64(8) + kind.astype(np.uint64)), first)).view(np.int64)
            named = np.isin(sig[first], often)
            gid[named] = gid_of_signature(sig[first[named]], np.array([table.column("bucket")[0].as_py()]))
            keep = np.repeat((size > 1) | named, size)
            out.append((np.repeat(gid, size)[keep], kind[keep], doc[keep], np.repeat(named, size)[keep]))
        cols = [np.concatenate(c) for c in zip(*out, strict=True)] or [np.zeros(0, t) for t in (np.int64, np.int32, np.int64, bool)]
        return pa.table([pa.array(c) for c in cols], names=["gid", "kind", "doc", "named"])

    return packed.groupBy("bucket").applyInArrow(work, "gid long, kind int, doc long, named boolean")


def _members(groups: DataFrame, known: DataFrame) -> DataFrame:
    """(gid, doc, kind, times, n, sure, size): the classes of each group that has several, by their representatives. times: how many
    signatures have this group; sure: how many of the kind the class shares at least with a linked one."""
    merged = groups.groupBy("gid", "doc").agg(F.max("kind").alias("kind"), F.when(F.max("named"), F.lit(1)).otherwise(F.count("*")).cast("int").alias("times"))
    facts = known.select(F.col("doc_id").alias("doc"), "rep", "n", "band", "sure", "sure_next").dropDuplicates(["doc", "rep"])
    sure = F.when(F.col("kind") == 2, F.lit(1)).otherwise(F.when(F.col("band") % 2 == F.col("kind"), F.col("sure")).otherwise(F.col("sure_next")))
    classes = merged.join(facts, "doc").withColumn("sure", F.greatest(sure, F.lit(1))).groupBy("gid", F.col("rep").alias("doc")).agg(*(F.max(c).alias(c) for c in ("kind", "times", "n", "sure")))
    classes = cut(classes)
    sizes = classes.groupBy("gid").agg(F.count("*").cast("int").alias("size")).filter("size > 1")
    return classes.join(sizes, "gid")


def _stars(members: DataFrame) -> DataFrame:
    """(a, b), a < b, once each: stars of a quarter of the hot groups that seem to share half the signatures a link needs. They are
    only the first pairs to be verified."""
    hot = members.filter((F.col("size") >= HOT) & (F.pmod(F.xxhash64("gid"), F.lit(4)) == 0))
    heads = hot.groupBy("gid").agg(F.min(F.struct("doc", "n", "sure")).alias("head"))
    pairs = hot.join(heads, "gid").filter("doc != head.doc").filter(f"least(n, head.n) * {DENOMINATOR} >= greatest(n, head.n) * {NUMERATOR}")
    summed = pairs.groupBy(F.col("head.doc").alias("a"), F.col("doc").alias("b"), "kind").agg(F.sum("times").alias("times"), F.max(F.greatest("sure", "head.sure")).alias("need"))
    return summed.filter("times * 2 >= need").select("a", "b").distinct()


def _linked(pairs: DataFrame, docs: DataFrame, n: int) -> DataFrame:
    """The pairs (a, b) that link, by their whole sets. A star streams past its least member's set; large stars are split."""

    def work(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        from .tokens import shingle_sets

        key, centres = None, []
        for whole in batches:
            for batch in text_batches(whole, 4):
                a, salt, doc, member = (batch.column(i).to_pylist() for i in range(4))
                out = []
                for k, d, m, s in zip(zip(a, salt, strict=True), doc, member, shingle_sets(batch.column(4), n), strict=True):
                    if k != key:
                        key, centres = k, []
                    if not m:
                        centres.append(s)
                        continue
                    for c in centres:
                        small, big = (s, c) if len(s) < len(c) else (c, s)
                        place = np.searchsorted(big, small)
                        place[place == len(big)] = 0
                        common = int((big[place] == small).sum())
                        if common * DENOMINATOR >= (len(s) + len(c) - common) * NUMERATOR:
                            out.append((k[0], d))
                            break
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64())], ["a", "b"])

    runs = pairs.groupBy("a").agg(F.ceil(F.count("*") / STAR).cast("int").alias("runs"))
    salted = pairs.join(runs, "a").select("a", F.pmod(F.xxhash64("b"), F.col("runs")).cast("int").alias("salt"), "b")
    members = salted.select("a", "salt", F.col("b").alias("doc_id"), F.lit(True).alias("member"))
    centres = salted.select("a", "salt").distinct().select("a", "salt", F.col("a").alias("doc_id"), F.lit(False).alias("member"))
    ids = pairs.select(F.explode(F.array("a", "b")).alias("doc_id"))
    texts = members.unionByName(centres).join(perhaps_among(docs, "doc_id", ids), "doc_id").select("a", "salt", "doc_id", "member", "text")
    return texts.repartition("a", "salt").sortWithinPartitions("a", "salt", "member").mapInArrow(work, "a long, b long").distinct()


def _cross_pairs(members: DataFrame, known: DataFrame, component: DataFrame) -> DataFrame:
    """Pairs (a, b) in different components that share as many groups of a kind as a link needs, behind the range bound. Large groups go in pairs of blocks."""

    def work(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        def pairs_of(t):
            cols = {c: np.asarray(t.column(c)) for c in ("i", "j", "block", "doc", "component", "n", "times", "kind", "sure", "spared")}
            ranges = unpacked_counts(np.frombuffer(b"".join(t.column("ranges").to_pylist()), np.uint8).reshape(-1, RANGES // 2))
            key = np.stack([np.asarray(t.column("gid")), cols["i"].astype(np.int64), cols["j"].astype(np.int64)])
            edge = np.flatnonzero(np.concatenate(([True], (key[:, 1:] != key[:, :-1]).any(0), [True])))
            c = cols
            for x, y in pairs_within(np.diff(edge), 500_000):
                ok = (c["component"][x] != c["component"][y]) & ((c["i"][x] == c["j"][x]) | (c["block"][x] != c["block"][y]))
                x, y = x[ok], y[ok]
                part = [near_enough(c["n"][x[k : k + 100_000]], c["n"][y[k : k + 100_000]], ranges[x[k : k + 100_000]], ranges[y[k : k + 100_000]]) for k in range(0, len(x), 100_000)]
                ok = np.concatenate(part) if part else np.zeros(0, bool)
                x, y = x[ok], y[ok]
                need = np.maximum(np.maximum(c["sure"][x], c["sure"][y]), 1) - np.maximum(c["spared"][x], c["spared"][y])
                a, b = np.minimum(c["doc"][x], c["doc"][y]), np.maximum(c["doc"][x], c["doc"][y])
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(c["kind"][x]), pa.array(c["times"][x].astype(np.int64)), pa.array(need.astype(np.int32))], ["a", "b", "kind", "times", "need"])

        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            t = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            last = [t.column(c)[-1].as_py() for c in ("gid", "i", "j")]
            keys = [np.asarray(t.column(c)) for c in ("gid", "i", "j")]
            inside = np.logical_and.reduce([k == v for k, v in zip(keys, last, strict=True)])
            at = int(len(inside) - np.argmin(inside[::-1])) if not inside.all() else 0
            held = t.slice(at).combine_chunks()
            if at:
                yield from pairs_of(t.slice(0, at).combine_chunks())
        if held is not None and held.num_rows:
            yield from pairs_of(held)

    placed = members.join(component.withColumnRenamed("node", "doc"), "doc", "left").withColumn("component", F.coalesce("component", "doc"))
    wide = placed.groupBy("gid").agg(F.min("component").alias("x"), F.max("component").alias("y")).filter("x != y").select("gid")
    own = Window.partitionBy("doc", "kind")
    spanning = placed.join(wide, "gid").withColumn("hot", F.col("size") >= HOT).withColumn("upto", F.sum("times").over(own.orderBy(F.desc("hot"), F.desc("size"), "gid")))
    spanning = spanning.withColumn("leaves", F.col("hot") & (F.col("kind") < 2) & (F.col("upto") * 3 <= (F.col("sure") - 1) * 2))
    spanning = cut(spanning.withColumn("spared", F.coalesce(F.max(F.when(F.col("leaves"), F.col("upto"))).over(own), F.lit(0)).cast("int")).filter("NOT leaves").drop("leaves", "upto", "hot", "size"))
    blocks = spanning.groupBy("gid").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"), F.count("*").alias("left")).filter("left > 1").drop("left")
    facts = known.filter("doc_id = rep").select(F.col("doc_id").alias("doc"), "ranges").dropDuplicates(["doc"])
    rows = spanning.join(blocks, "gid").join(facts, "doc").withColumn("block", F.pmod(F.xxhash64("doc"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("gid", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "doc", "component", "n", "ranges", "kind", "times", "sure", "spared")
    found = rows.repartition("gid", "i", "j").sortWithinPartitions("gid", "i", "j").mapInArrow(work, "a long, b long, kind int, times long, need int")

    return found.groupBy("a", "b", "kind").agg(F.sum("times").alias("times"), F.max("need").alias("need")).filter("times >= need").select("a", "b").distinct()


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5) -> DataFrame:
    """One row a document: doc_id, n_shingles, class_id (least id with an equal set), component_id (least id reachable by links)."""
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    facts = cut(_described(docs, n))
    classes = facts.filter("n > 0 and doc_id is not null").groupBy("h1", "h2", "n").agg(F.min("doc_id").alias("rep"))
    full = cut(facts.join(classes, ["h1", "h2", "n"], "left").select("doc_id", "n", F.coalesce("rep", "doc_id").alias("rep"), "ranges", "band", "sure", "sure_next"))
    known = full.filter("n > 0 and doc_id is not null")
    total = facts.agg(F.sum("n")).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-int(total * 1.4) // BUCKET))
    members = cut(_members(_grouped(_packed(docs, n, buckets)), known))
    stars = cut(_stars(members))
    links = cut(_linked(stars, docs, n))
    component = cut(components(links.select(F.col("a").alias("u"), F.col("b").alias("v"))))
    cross = cut(_cross_pairs(members, known, component).join(stars, ["a", "b"], "left_anti"))
    more = _linked(cross, docs, n)
    node = lambda x: component.select(F.col("node").alias(x), F.col("component").alias(f"c{x}"))
    bridges = more.join(node("a"), "a", "left").join(node("b"), "b", "left").select(F.coalesce("ca", "a").alias("u"), F.coalesce("cb", "b").alias("v"))
    joined = components(bridges).select(F.col("node").alias("component"), F.col("component").alias("whole"))
    final = component.join(joined, "component", "full").select(F.coalesce("node", "component").alias("rep"), F.coalesce("whole", "component").alias("c"))
    final = final.unionByName(joined.select(F.col("component").alias("rep"), F.col("whole").alias("c"))).groupBy("rep").agg(F.min("c").alias("c"))
    return full.join(final, "rep", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("rep")).otherwise(F.col("doc_id")).alias("class_id"), F.when(F.col("doc_id").isNotNull(), F.when(F.col("n") > 0, F.coalesce("c", "rep")).otherwise(F.col("doc_id"))).alias("component_id"))


ORACLE = """
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')] ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) END AS sh FROM w),
n AS (SELECT doc_id, len(sh) AS n, md5(array_to_string(list_sort(sh), '|')) AS k FROM s),
u AS (SELECT doc_id, unnest(sh) AS g FROM s),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM u a JOIN u b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 75 * (a.n + b.n - c)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT doc_id AS d, doc_id AS c FROM n UNION SELECT e.y, r.c FROM r JOIN e ON r.d = e.x),
c AS (SELECT d, min(c) AS component_id FROM r GROUP BY d)
SELECT n.doc_id, CAST(n.n AS BIGINT) AS n_shingles, CASE WHEN n.n = 0 THEN n.doc_id ELSE min(n.doc_id) OVER (PARTITION BY k) END AS class_id, component_id FROM n JOIN c ON c.d = n.doc_id"""
