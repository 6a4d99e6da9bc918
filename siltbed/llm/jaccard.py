"""Similarity join of shingle sets by PartEnum signatures.

Sets are put in size bands. For two sets of Jaccard similarity s or more, the larger in band b, at most
k = (1 - s) / (1 + s) * 2 * (largest size of b) shingles are in one set only. The shingle domain is cut by a hash into
n1 = k // (k2 + 1) + 1 + e first-level partitions, so at least 1 + e of them hold at most k2 differing shingles. Each of
these is cut into n2 second-level partitions, and the subsets of n2 - k2 of them are enumerated: in a partition with k2
differences the two sets agree on one such subset at least. A signature is the whole content of one subset, under its
band. Here k2 = 1 and n2 = 3.

Agreement on an empty subset says nothing. A partition with an empty subset is weak; a set with w weak ones gives the
signatures of its subsets that aren't empty, as long as w <= e: 1 + e - w partitions are left that agree on one. Of these
every set may ignore its e - w most frequent signatures, in one order for all: the rarest signature that two similar sets
share is never among them. What only shares a frequent passage thus meets no more. A set with more weak partitions gives the empty
subsets too. In bands in which no shingle may differ the whole set is the one signature.

Signatures leave a task in packed arrays, one for each bucket of signatures, and those that several sets have are found
by sorting a bucket's arrays; what only one set has goes no further.

Candidates are verified on the whole sets. Groups of signatures that have the same sets are one group. The sets of a
group are first compared with one of them. The sets of groups that then lie in several components get finer signatures,
their rare shingles (partitions of one shingle each, of which a set may ignore the frequent ones), and some more rounds
compare the sets of these groups with one of them, unless they lie in its
component already; rounds end when they bring little. Then the pairs across components of the groups that are left are compared, so no link is lost.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltbed.llm.graph import components
from siltbed.llm.shared import WORD, Workspace, cache, cut, only, slices

_WORD = re.compile(WORD)
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_KNOWN: dict[str, int] = {}
cache("words", _KNOWN.clear)
#: Bytes of candidates' keys that are broadcast at most; beyond it they are joined.
BROADCAST_BYTES = 32 << 20
#: Documents whose signatures share one bucket, about.
BUCKET_DOCS = 12_000
#: Bits of the parity sketch that rules pairs out before their sets are compared.
SKETCH = 1024
_SETS = "sid long, shingles array<long>, sketch array<long>"


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit values."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def shingle_set(text: str | None, width: int = 5) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles; a text of fewer words is one shingle, without words none."""
    words = _WORD.findall((text or "").translate(_LOWER))
    if not words:
        return np.empty(0, np.uint64)
    known = _KNOWN
    if len(known) > 400_000:
        known.clear()
    for w in set(words).difference(known):
        known[w] = xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass"))
    at = np.array(list(map(known.__getitem__, words)), np.uint64)
    n = max(1, len(words) - width + 1)
    h = np.full(n, min(width, len(words)), np.uint64)
    for i in range(min(width, len(words))):
        h = h * np.uint64(0x2545F4914F6CDD1D) + at[i : i + n]
    return np.unique(mixed(h))


def set_hash(s: np.ndarray) -> int:
    """One signed 64-bit name of a set."""
    return int(np.int64(np.uint64(xxhash.xxh3_64_intdigest(s.tobytes())).astype(np.int64)))


class PartEnum:
    """Signatures for Jaccard similarity ``num / den`` or more; ``differ`` and ``parts`` are k2 and n2."""

    def __init__(self, num: int = 4, den: int = 5, growth: float = 1.5, spare: float = 0.25, differ: int = 1, parts: int = 3):
        self.num, self.den, self.spare, self.differ, self.parts = num, den, spare, differ, parts
        self.tops = [4]
        while self.tops[-1] < 1 << 40:
            self.tops.append(max(self.tops[-1] + 1, int(self.tops[-1] * growth)))
        self._tops = np.array(self.tops)
        self._places: dict[int, np.ndarray] = {}
        chosen = list(combinations(range(parts), parts - differ))
        #: one row for each second-level partition, one column for each subset
        self._subsets = np.array([[int(i in c) for c in chosen] for i in range(parts)], np.uint64)

    def band(self, n: int) -> int:
        return int(np.searchsorted(self._tops, n))

    def split(self, band: int) -> tuple[int, int]:
        """k and e of a band: shingles that may differ, and first-level partitions more than one that agree."""
        k = 2 * self.tops[band] * (self.den - self.num) // (self.den + self.num)
        return k, int(np.ceil(self.spare * (k // (self.differ + 1))))

    def signatures(self, s: np.ndarray) -> list[tuple[int, int, np.ndarray]]:
        """(band, signatures that the set may ignore, signatures) for each band in which a similar larger set may be."""
        n = len(s)
        out = []
        value = mixed(s ^ np.uint64(0xA5A5A5A5A5A5A5A5))
        for band in range(self.band(n), self.band(n * self.den // self.num) + 1):
            k, e = self.split(band)
            if k == 0:  # only equal sets are similar
                out.append((band, 0, mixed(value.sum(keepdims=True) + np.uint64(band << 40))))
                continue
            n1 = k // (self.differ + 1) + 1 + e
            cell = (mixed(s + np.uint64(band * 0x51ED2701 + 1)) % np.uint64(n1 * self.parts)).astype(np.int64)
            # sums of mixed values name the content of a cell or a subset of cells, whatever the order
            total = np.zeros(n1 * self.parts, np.uint64)
            np.add.at(total, cell, value)
            total, count = total.reshape(n1, self.parts), np.bincount(cell, minlength=n1 * self.parts).reshape(n1, self.parts)
            if self.differ == 1:  # a subset is all cells of a partition but one
                total, count = total.sum(axis=1, keepdims=True) - total, count.sum(axis=1, keepdims=True) - count
            else:
                total, count = total @ self._subsets, count @ self._subsets.astype(np.int64)
            if (place := self._places.get(band)) is None:
                place = self._places[band] = mixed(np.arange(total.size, dtype=np.uint64) + np.uint64(band << 40))
            name = mixed(total.reshape(-1) + place)
            weak = int((count == 0).any(axis=1).sum())
            out.append((band, e - weak, name[count.reshape(-1) > 0]) if weak <= e else (band, 0, name))
        return out


_SIGNED = "doc_id long, key long, n_shingles long, sid long, bucket long, sids binary, parts binary, at binary, sigs binary"
_SIGNED_KINDS = pa.schema([("doc_id", pa.int64()), ("key", pa.int64()), ("n_shingles", pa.int64()), ("sid", pa.int64()), ("bucket", pa.int64()), ("sids", pa.binary()), ("parts", pa.binary()), ("at", pa.binary()), ("sigs", pa.binary())])
_MET = "doc_id long, key long, n_shingles long, sid long, sig long, part long, n long"
_MET_KINDS = pa.schema([(x.split(" ")[0], pa.int64()) for x in _MET.split(", ")])


def _filled(kinds: pa.Schema, rows: int, **columns: object) -> pa.RecordBatch:
    """A batch of ``rows`` rows with the columns given, the others null."""
    cols = [pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(rows, f.type) for f in kinds]
    return pa.RecordBatch.from_arrays(cols, schema=kinds)


def _signed(batches: Iterator[pa.RecordBatch], scheme: PartEnum, buckets: int) -> Iterator[pa.RecordBatch]:
    """A row for each document, with its number of shingles and the name of its set, and rows of the sets' signatures
    for each bucket: ``sids`` and ``parts`` (band and how many signatures may be ignored) name sets, ``at`` and ``sigs``
    are the signatures with their places in those. A set that comes again in the same task gives no more."""
    only("words")
    seen: set[int] = set()
    for batch in batches:
        for part in slices(batch, 2, 2 << 20):
            sizes, names, sids, parts, lengths, sigs = [], [], [], [], [], []
            for text in part.column(2).to_pylist():
                s = shingle_set(text)
                sizes.append(len(s))
                names.append(set_hash(s) if len(s) else None)
                if len(s) and names[-1] not in seen:
                    seen.add(names[-1])
                    for band, free, own in scheme.signatures(s):
                        sids.append(names[-1])
                        parts.append(band << 24 | free)
                        lengths.append(len(own))
                        sigs.append(own)
            n = part.num_rows
            yield _filled(_SIGNED_KINDS, n, doc_id=part.column(0), key=part.column(1), n_shingles=sizes, sid=names, bucket=np.arange(n) % buckets)
            if not sigs:
                continue
            sig, at = np.concatenate(sigs), np.repeat(np.arange(len(sids), dtype=np.uint32), lengths)
            bucket = (sig >> np.uint64(40)) % np.uint64(buckets)
            low = np.ascontiguousarray(sig.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :5]  # 40 bits within a bucket
            order = np.argsort(bucket, kind="stable")
            edges = np.flatnonzero(np.concatenate([[True], np.diff(bucket[order]) > 0, [True]]))
            all_sids, all_parts = np.array(sids, np.int64), np.array(parts, np.uint32)
            rows = []
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                here = order[a:b]
                used, where = np.unique(at[here], return_inverse=True)
                small = where.astype("<u2") if len(used) <= 1 << 16 else where.astype("<u4")
                rows.append((int(bucket[here[0]]), all_sids[used].tobytes(), all_parts[used].tobytes(), small.tobytes(), low[here].tobytes()))
            cols = dict(zip(("bucket", "sids", "parts", "at", "sigs"), zip(*rows, strict=True), strict=True))
            yield _filled(_SIGNED_KINDS, len(rows), **cols)


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted by bucket: documents pass, and of signatures those that several sets have, with their number."""
    only()
    held: list[tuple] = []
    number = None

    def out() -> pa.RecordBatch:
        sids, parts, places, low, size = [], [], [], [], 0
        for own, own_parts, at, sigs in held:
            sids.append(np.frombuffer(own, np.int64))
            parts.append(np.frombuffer(own_parts, np.uint32))
            low.append(np.frombuffer(sigs, np.uint8).reshape(-1, 5))
            places.append(np.frombuffer(at, "<u2" if len(at) == 2 * len(low[-1]) else "<u4").astype(np.int64) + size)
            size += len(sids[-1])
        held.clear()
        wide = np.zeros((sum(map(len, low)), 8), np.uint8)
        np.concatenate(low, out=wide[:, :5])
        sig = wide.view("<i8").reshape(-1)
        order = np.argsort(sig)
        sig = sig[order]
        same = sig[1:] == sig[:-1]
        several = np.concatenate([[False], same]) | np.concatenate([same, [False]])
        sig, at = sig[several], np.concatenate(places)[order[several]]
        sid, part = np.concatenate(sids)[at], np.concatenate(parts)[at].astype(np.int64)
        order = np.lexsort((sid, sig))  # a set of two tasks counts once
        sig, sid, part = sig[order], sid[order], part[order]
        once = np.concatenate([[True], (sig[1:] != sig[:-1]) | (sid[1:] != sid[:-1])]) if len(sig) else np.empty(0, bool)
        sig, sid, part = sig[once], sid[once], part[once]
        _, where, counts = np.unique(sig, return_inverse=True, return_counts=True)
        n = counts[where] if len(sig) else np.empty(0, np.int64)
        few = n > 1
        return _filled(_MET_KINDS, int(few.sum()), sid=sid[few], sig=number << 40 | sig[few], part=part[few], n=n[few])

    for batch in batches:
        is_doc = batch.column(5).is_null().to_numpy(zero_copy_only=False)
        docs = batch.filter(pa.array(is_doc))
        yield _filled(_MET_KINDS, docs.num_rows, **{k: docs.column(i) for i, k in enumerate(("doc_id", "key", "n_shingles", "sid"))})
        for i in np.flatnonzero(~is_doc).tolist():
            bucket = batch.column(4)[i].as_py()
            if held and bucket != number:
                yield out()
            number = bucket
            held.append(tuple(batch.column(k)[i].as_py() for k in (5, 6, 7, 8)))
    if held:
        yield out()


def sketch(s: np.ndarray) -> np.ndarray:
    """SKETCH bits as signed 64-bit integers: each is the parity of the shingles that fall on it, so two sketches differ
    in no more bits than their sets in shingles."""
    at = (mixed(s ^ np.uint64(0x3C6EF372FE94F82B)) % np.uint64(SKETCH)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=SKETCH) & 1).astype(np.uint8)).view(np.int64)


def _sets(batches: Iterator[pa.RecordBatch], wanted: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    """The sets of texts whose keys are wanted, each once in a task."""
    only("words")
    seen: set[int] = set()
    for batch in batches:
        for part in slices(batch, 1, 2 << 20):
            keys = part.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            if wanted is not None:
                at = np.minimum(np.searchsorted(wanted, keys), max(0, len(wanted) - 1))
                keep = np.flatnonzero(wanted[at] == keys).tolist() if len(wanted) else []
            else:
                keep = range(len(keys))
            rows = []
            for i in keep:
                if int(keys[i]) in seen:
                    continue
                seen.add(int(keys[i]))
                s = shingle_set(part.column(1)[i].as_py())
                if len(s):
                    rows.append((set_hash(s), s.view(np.int64), sketch(s)))
            cols = [pa.array([r[0] for r in rows], pa.int64()), *(pa.array([r[k] for r in rows], pa.list_(pa.int64())) for k in (1, 2))]
            yield pa.RecordBatch.from_arrays(cols, ["sid", "shingles", "sketch"])


def _verified(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough, by their whole intersections."""
    left = sets.select(F.col("sid").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("sid").alias("b"), F.col("shingles").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    total = F.size("sa") + F.size("sb") - both
    return pairs.join(right, "b").join(left, "a").where(den * both >= num * total).select("a", "b")


def _open(shared: DataFrame, found: DataFrame) -> DataFrame:
    """Rows (sig, sid, component) of the groups that lie in several components."""
    named = shared.join(found.withColumnRenamed("node", "sid"), "sid", "left").withColumn("component", F.coalesce("component", "sid"))
    several = named.groupBy("sig").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo != hi").select("sig")
    return named.join(several, "sig")


def _star(groups: DataFrame, turn: int) -> DataFrame:
    """Pairs of each group's first set, in an order by hash that all groups have in common, with those of the group
    that lie in another component."""
    first = groups.groupBy("sig").agg(F.min_by(F.struct("sid", "component"), F.struct(F.xxhash64("sid", F.lit(turn)), "sid")).alias("p"))
    both = groups.join(first, "sig").where(F.col("component") != F.col("p.component"))
    return both.select(F.least("sid", "p.sid").alias("a"), F.greatest("sid", "p.sid").alias("b")).distinct()


def _distinct_groups(kept: DataFrame) -> DataFrame:
    """Rows (sig, sid), of groups with the same sets only one: similar sets share many signatures."""
    same = kept.groupBy("sig").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("sid", F.lit(1))).alias("x"), F.bit_xor(F.xxhash64("sid", F.lit(2))).alias("y")).where("n > 1")
    one = same.groupBy("n", "x", "y").agg(F.min("sig").alias("sig")).select("sig")
    return kept.join(one, "sig")


def _rare_groups(sets: DataFrame, num: int, den: int) -> DataFrame:
    """Rows (sig, sid) where sig is a shingle: the limit of ever finer partitions. A set's rarest shingles, as many as
    may differ and one more, hold one that each similar set has among its own."""
    each = sets.select("sid", F.size("shingles").alias("size"), F.explode("shingles").alias("sig"))
    # counted with a partial sum in each task; the join's large partitions can be split, which a window's can't
    several = each.groupBy("sig").agg(F.count("*").alias("n")).where("n > 1")
    counted = each.join(several, "sig", "left").withColumn("n", F.coalesce("n", F.lit(1)))
    rank = F.row_number().over(Window.partitionBy("sid").orderBy("n", "sig"))
    least = F.ceil(F.col("size") * num / den)
    return counted.withColumn("rank", rank).where((F.col("rank") <= F.col("size") - least + 1) & (F.col("n") > 1)).select("sig", "sid")


def _named(docs: DataFrame, id_col: str, text_col: str, num: int, den: int, turns: int) -> DataFrame:
    """doc_id, key, n_shingles, sid and component (a set's name) of every document."""
    spark = docs.sparkSession
    scheme = PartEnum(num, den)
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("key"), F.col(text_col).alias("text"))
    buckets = max(1, -(-docs.count() // BUCKET_DOCS))
    dealt = plain.mapInArrow(lambda it: _signed(it, scheme, buckets), _SIGNED).repartitionById(buckets, F.col("bucket").cast("int")).sortWithinPartitions("bucket")
    met = cut(dealt.mapInArrow(_met, _MET), "met")
    narrow = met.where("sig IS NULL").select("doc_id", "key", "n_shingles", "sid")
    counted = met.where("sig IS NOT NULL").select("sig", "sid", "part", "n").withColumn("band", F.shiftright("part", 24))
    rank = F.row_number().over(Window.partitionBy("sid", "band").orderBy(F.desc("n"), "sig"))
    kept = counted.withColumn("rank", rank).where(F.col("rank") > F.col("part").bitwiseAND((1 << 24) - 1))
    kept = cut(kept.select("sig", "sid"), "signatures")
    shared = cut(_distinct_groups(kept), "groups")
    in_groups = shared.select("sid").distinct()
    # one text of each set that is in a group is read again
    chosen = cut(narrow.join(in_groups, "sid", "left_semi").groupBy("sid").agg(F.min("key").alias("key")).select("key"), "chosen")
    texts = plain.select("key", "text")
    if 8 * chosen.count() <= BROADCAST_BYTES:
        sent = spark.sparkContext.broadcast(np.sort(chosen.toArrow().column("key").to_numpy()))
        read = texts.mapInArrow(lambda it: _sets(it, sent.value), _SETS)
    else:
        read = texts.join(chosen, "key", "left_semi").mapInArrow(lambda it: _sets(it, None), _SETS)
    sets = cut(read.dropDuplicates(["sid"]), "shingles")
    sizes = cut(sets.select("sid", F.size("shingles").alias("size"), "sketch"), "sizes")
    found = sizes.select(F.col("sid").alias("node"), F.col("sid").alias("component"))
    pairs = cut(_fitting(_star(_open(shared, found), 0), sizes, num, den), "pairs")
    found = cut(components(cut(_verified(pairs, sets, num, den), "links"), found), "components")
    # what isn't settled by that is signed anew by rare shingles: passages that many sets share bring nobody together
    hot = _open(shared, found).select("sid").distinct()
    groups = cut(_distinct_groups(cut(_rare_groups(sets.join(hot, "sid"), num, den), "rare")), "regrouped")
    tested, before = pairs, None
    for turn in range(1, turns):
        groups = cut(_open(groups, found), "open")
        left = groups.count()
        if not left or before is not None and left > 0.9 * before:
            break
        before = left
        pairs = cut(_fitting(_star(groups, turn), sizes, num, den).join(tested, ["a", "b"], "left_anti"), "pairs")
        tested = tested.unionByName(pairs)
        found = cut(components(cut(_verified(pairs, sets, num, den), "links"), found), "components")
        groups = groups.select("sig", "sid")
    # groups that still lie in several components: their pairs across components that weren't compared yet
    groups = cut(_open(groups.select("sig", "sid"), found).join(sizes, "sid"), "open")
    x, y = groups.alias("x"), groups.alias("y")
    fit = (F.col("x.sid") < F.col("y.sid")) & (F.col("x.component") != F.col("y.component"))
    fit &= _may_be_similar("x", "y", num, den)
    across = x.join(y, F.col("x.sig") == F.col("y.sig")).where(fit).select(F.col("x.sid").alias("a"), F.col("y.sid").alias("b")).distinct()
    across = across.join(tested, ["a", "b"], "left_anti")
    final = components(cut(_verified(cut(across, "across"), sets, num, den), "more"), found)
    named = narrow.join(final.withColumnRenamed("node", "sid"), "sid", "left").withColumn("component", F.coalesce("component", "sid"))
    return cut(named, "named")


def similar_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", num: int = 4, den: int = 5, turns: int = 6) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest id reachable by links), key (a hash of the text) and group (a name
    of the component that null ids have too; null without shingles) of every document.

    Two documents link when den * |intersection| >= num * |union| of their sets of 5-word shingles. Null and empty texts
    and texts without words have no shingles and are linked with nothing: their component is themselves. Equal sets
    are one set, so copies cost nothing and are linked. Sets are named by 64 bits. Rows with a null id take part as any
    other; a component of null ids only has a null component_id. Rows that repeat an id, with one text or several, are documents of
    their own and link by their texts. Other columns are not read. An empty table gives no rows.

    ``turns`` is the most rounds in which a group's sets are compared with one of them; whatever is in different
    components after them is compared pair by pair, so it changes no result.
    """
    own = Workspace()
    with own:
        named = _named(docs, id_col, text_col, num, den, turns)
    own.keep(named)
    own.close()  # whatever led to the components is no longer needed
    least = named.where("component IS NOT NULL").groupBy("component").agg(F.min("doc_id").alias("least"))
    out = named.join(least, "component", "left")
    component = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("least"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), "key", F.col("component").alias("group"))


def _may_be_similar(x: str, y: str, num: int, den: int) -> Column:
    """False only for pairs that can't be similar, by their sizes and sketches."""
    small, large = F.least(f"{x}.size", f"{y}.size"), F.greatest(f"{x}.size", f"{y}.size")
    differ = sum((F.bit_count(F.col(f"{x}.sketch")[i].bitwiseXOR(F.col(f"{y}.sketch")[i])) for i in range(1, SKETCH // 64)), F.bit_count(F.col(f"{x}.sketch")[0].bitwiseXOR(F.col(f"{y}.sketch")[0])))
    return (den * small >= num * large) & ((den + num) * differ <= (den - num) * (small + large))


def _fitting(pairs: DataFrame, sizes: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs that their sizes and sketches don't rule out."""
    joined = pairs.join(sizes.select(F.col("sid").alias("a"), F.struct("size", "sketch").alias("x")), "a")
    return joined.join(sizes.select(F.col("sid").alias("b"), F.struct("size", "sketch").alias("y")), "b").where(_may_be_similar("x", "y", num, den)).select("a", "b")
