"""Exact Jaccard self-join on word n-grams, by signature trees; gives components of linked documents.

Documents of one set of shingles form a class; only classes are joined.

1. Top of the tree. Shingles have one order for all: those a large share of blocks see often come last,
   else by hash. A set's *prefix* is so long that two sets without a common prefix shingle cannot overlap
   enough; so every prefix shingle is a node under the root, and pairs of sets without a common node
   are pruned by their maximum possible overlap. Sets go to nodes packed by bucket. The members of a common
   shingle go to buckets by member too, so that no bucket holds a hot node whole.
2. First traversal. Within a node each set meets the smallest, the next two, and for a common shingle the
   node's centre: a number of pairs linear in its members. Pairs that pass bitmap and size bounds are
   gathered around their centre (in groups of a bounded number) with their whole sets, a signature tree is built
   over each group, and its dual traversal finds exact links; sets already connected are not compared again.
3. Second traversal. Components of the links found so far are formed. Only in larger nodes whose members lie in
   different components can a link be missing: there members outside the node's main component are held against
   all members by dual traversal of signature trees, in pairs of chunks bounded on both sides, and what passes the
   bounds is compared exactly.

Every pair that may reach the threshold is either inside one component already or compared exactly, so no link
between components is lost. Shingles are known by 64-bit hashes.

Null and blank texts have no shingles and no links. Rows without an id are compared as others are; a component is
named by its smallest id, by null if it has none. Repeated rows give a row each.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardline.llm import words as W
from wardline.llm.common import attach, cut_lineage, pieces, prepare, rows_of, text_volume
from wardline.llm.components import components
from wardline.llm.homes import bucket_of, by_bucket
from wardline.llm.signature_tree import bitmaps, candidates, stacked

BLOCK_BYTES = 4 << 20
BUCKET_ENTRIES = 1 << 19
GROUP = 500  # sets gathered around one centre
COVERED = 4  # the pairs of the first traversal are all pairs of a node of so many members
CHUNK = 2000  # members of a node that one task holds in the second traversal
BEFORE = 4  # earlier nodes of a member that go along with it in the second traversal
# A shingle is common if it is in this share of all classes (and in so many): then it comes late in the order.
# At most (mean size of a set / share) shingles can be, however many documents there are.
COMMON_SHARE, COMMON_LEAST = 0.0005, 32

SEEN = pa.schema([("doc_id", pa.int64()), ("key", pa.int64()), ("class", pa.int64()), ("n", pa.int64()), ("map", pa.binary()), ("shingle", pa.int64()), ("seen", pa.int64())])
SEEN_DDL = "doc_id bigint, key bigint, class bigint, n bigint, map binary, shingle bigint, seen bigint"
SENT = pa.schema([("bucket", pa.int32()), ("shingles", pa.binary()), ("classes", pa.binary()), ("sizes", pa.binary())])
SENT_DDL = "bucket int, shingles binary, classes binary, sizes binary"
NODE = pa.schema([("shingle", pa.int64()), ("class", pa.int64()), ("pair", pa.bool_()), ("late", pa.bool_())])
NODE_DDL = "shingle bigint, class bigint, pair boolean, late boolean"
SET = pa.schema([("a", pa.int64()), ("salt", pa.int32()), ("class", pa.int64()), ("shingles", pa.binary())])
SET_DDL = "a bigint, salt int, class bigint, shingles binary"
LINK = pa.schema([("a", pa.int64()), ("b", pa.int64())])
LINK_DDL = "a bigint, b bigint"


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


class _Sets:
    """Distinct shingles of each text of a block: ``shingles[off[i]:off[i+1]]``, ascending."""

    def __init__(self, texts, size: int):
        words = W.Words(texts, lower=True)
        hashes = words.hashes()
        counts = words.counts
        whole = W.window_hashes(hashes, size)[W.window_starts(words.first, size)]
        # Shorter texts: the whole sequence is the one shingle; its length keeps it apart from others.
        n = np.where(counts >= size, counts - size + 1, (counts > 0).astype(np.int64))
        off = np.concatenate(([0], np.cumsum(n)))
        found = np.empty(off[-1], np.uint64)
        short = np.flatnonzero((counts > 0) & (counts < size))
        is_short = np.zeros(len(found), bool)
        is_short[off[short]] = True
        found[~is_short] = whole
        for k in np.unique(counts[short]):
            at = short[counts[short] == k]
            found[off[at]] = W.mix(W.window_hashes(hashes, int(k))[words.first[at]], int(k))
        for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True):
            if b - a > 1:
                found[a:b].sort()
        new = np.ones(len(found), bool)
        new[1:] = found[1:] != found[:-1]
        new[off[:-1][n > 0]] = True
        owner = np.repeat(np.arange(len(n)), n)[new]
        self.shingles = found[new]
        self.n = np.bincount(owner, minlength=len(n))
        self.off = np.concatenate(([0], np.cumsum(self.n)))
        self.owner = owner
        sums = np.zeros(len(n), np.uint64)
        if len(self.shingles):
            np.add.at(sums, owner, W.mix(self.shingles, 5))
        self.classes = _signed(W.mix(sums + self.n.astype(np.uint64), 7))

    def first_rows(self) -> np.ndarray:
        """One row for each class of the block with a set."""
        rows = np.flatnonzero(self.n > 0)
        return rows[np.unique(self.classes[rows], return_index=True)[1]]


def _look(size: int):
    """A row for each document, and rows of shingles that are common within the block."""

    def work(batches):
        for table in W.blocks(batches, "text", BLOCK_BYTES):
            sets = _Sets(table.column("text"), size)
            none = pa.nulls(len(sets.n), pa.int64())
            maps = pa.array(bitmaps(sets.shingles, sets.off), pa.binary())
            own = [table.column(c).combine_chunks() for c in ("doc_id", "key")]
            yield pa.RecordBatch.from_arrays([*own, pa.array(sets.classes), pa.array(sets.n, pa.int64()), maps, none, none], schema=SEEN)
            rows = sets.first_rows()
            at = W.ragged(sets.off[rows], sets.n[rows])
            all_of_them, owner = sets.shingles[at], sets.classes[np.repeat(rows, sets.n[rows])]
            order = np.argsort(all_of_them)
            begin = W.runs(all_of_them[order])
            seen = np.diff(np.append(begin, len(order)))
            often = seen >= max(2, int(len(rows) * COMMON_SHARE))
            if often.any():
                least = np.minimum.reduceat(owner[order], begin)[often]
                none = pa.nulls(len(least), pa.int64())
                yield pa.RecordBatch.from_arrays([none, none, pa.array(least), none, pa.nulls(len(least), pa.binary()),
                                                  pa.array(_signed(all_of_them[order][begin[often]])), pa.array(seen[often], pa.int64())], schema=SEEN)

    return work


def _send(size: int, num: int, den: int, buckets: int, common: np.ndarray):
    """Prefix entries of each block, packed by bucket."""

    def work(batches):
        for table in W.blocks(batches, "text", BLOCK_BYTES):
            sets = _Sets(table.column("text"), size)
            rows = sets.first_rows()
            if not len(rows):
                continue
            n = sets.n[rows].astype(np.int64)
            shingles = sets.shingles[W.ragged(sets.off[rows], n)]
            owner, off = np.repeat(np.arange(len(rows)), n), np.concatenate(([0], np.cumsum(n)))
            length = n - -(-num * n // den) + 1
            late = np.zeros(len(shingles), bool)
            if len(common):
                late = common[np.minimum(np.searchsorted(common, shingles), len(common) - 1)] == shingles
            early_upto = np.concatenate(([0], np.cumsum(~late)))
            rank = early_upto[:-1] - early_upto[off[:-1]][owner]
            early_all = (early_upto[off[1:]] - early_upto[off[:-1]])
            place = np.arange(len(shingles)) - off[:-1][owner]
            rank = np.where(late, early_all[owner] + place - rank, rank)
            taken = rank < length[owner]
            shingles, owner, late = shingles[taken], owner[taken], late[taken]
            key = np.where(late, W.mix(shingles ^ W.mix(sets.classes[rows].view(np.uint64))[owner]), shingles)
            order, bounds = by_bucket(bucket_of(W.mix(key, 3), buckets), buckets)
            out = []
            for b in range(buckets):
                at = order[bounds[b]:bounds[b + 1]]
                if len(at):
                    change = W.runs(owner[at])
                    sizes = np.diff(np.append(change, len(at)))
                    ids = np.stack([sets.classes[rows][owner[at[change]]], n[owner[at[change]]]])
                    out.append((b, shingles[at].tobytes(), ids.tobytes(), sizes.astype(np.int32).tobytes()))
            yield pa.RecordBatch.from_pydict(dict(zip(SENT.names, map(list, zip(*out, strict=True)), strict=True)), SENT)

    return work


def _meet(num: int, den: int, common: np.ndarray, centres: np.ndarray):
    """Nodes of one bucket: pairs to compare first (the smallest member with each, and each with the next two), and
    members of the nodes whose pairs these are not all.

    A pair row holds the two classes in the first two columns.
    """

    def work(table: pa.Table) -> pa.Table:
        shingles, classes, n = [], [], []
        for s, c, k in zip(*[table.column(x).to_pylist() for x in SENT.names[1:]], strict=True):
            sizes = np.frombuffer(k, np.int32)
            ids = np.frombuffer(c, np.int64).reshape(2, -1)
            shingles.append(np.frombuffer(s, np.uint64))
            classes.append(np.repeat(ids[0], sizes))
            n.append(np.repeat(ids[1], sizes))
        shingles, classes, n = np.concatenate(shingles), np.concatenate(classes), np.concatenate(n)
        order = np.argsort(shingles)
        begin = W.runs(shingles[order])
        size = np.diff(np.append(begin, len(order)))
        centre_of = np.zeros(len(begin), np.int64)
        is_common = np.zeros(len(begin), bool)
        if len(common):
            at = np.minimum(np.searchsorted(common, shingles[order[begin]]), len(common) - 1)
            is_common = common[at] == shingles[order[begin]]
            centre_of[is_common] = centres[at[is_common]]
        wanted = (size > 1) | is_common
        if not wanted.any():
            return NODE.empty_table()
        size, centre_of, is_common = size[wanted], centre_of[wanted], is_common[wanted]
        at = order[W.ragged(begin[wanted], size)]
        run = np.repeat(np.arange(len(size)), size)
        by = np.lexsort((classes[at], n[at], run))
        at, run = at[by], run[by]
        s, c, m = shingles[at], classes[at], n[at]
        new = np.ones(len(c), bool)
        new[1:] = (run[1:] != run[:-1]) | (c[1:] != c[:-1])
        s, c, m, run = s[new], c[new], m[new], run[new]
        head = W.runs(run)
        count = np.diff(np.append(head, len(run)))
        first = np.repeat(head, count)
        fits = num * m <= den * m[first]
        pairs = [np.stack([c[first], c])[:, fits & (first != np.arange(len(c)))]]
        for step in (1, 2):
            near = np.flatnonzero(run[step:] == run[:-step])
            near = near[num * m[near + step] <= den * m[near]]
            pairs.append(np.stack([c[near], c[near + step]]))
        held = is_common[run]
        pairs.append(np.stack([centre_of[run], c])[:, held])
        pairs = np.concatenate(pairs, axis=1)
        pairs = pairs[:, pairs[0] != pairs[1]]
        pairs.sort(axis=0)
        pairs = np.unique(pairs, axis=1) if pairs.size else pairs
        several = (count > COVERED)[run] | held
        flag = np.zeros(int(several.sum()) + pairs.shape[1], bool)
        flag[int(several.sum()):] = True
        late = np.concatenate([held[several], np.zeros(pairs.shape[1], bool)])
        return pa.table([np.concatenate([_signed(s[several]), pairs[0]]), np.concatenate([c[several], pairs[1]]), flag, late], schema=NODE)

    return work


def _whole_sets(size: int):
    """The set of each document, once for every group that wants it."""

    def work(batches):
        for table in W.blocks(batches, "text", BLOCK_BYTES // 2):
            sets = _Sets(table.column("text"), size)
            out = []
            for i, keys in enumerate(table.column("keys").to_pylist()):
                raw = sets.shingles[sets.off[i]:sets.off[i + 1]].tobytes()
                out += [(k["a"], k["salt"], int(sets.classes[i]), raw) for k in keys]
                if len(out) >= 256:
                    yield pa.RecordBatch.from_pydict(dict(zip(SET.names, map(list, zip(*out, strict=True)), strict=True)), SET)
                    out = []
            if out:
                yield pa.RecordBatch.from_pydict(dict(zip(SET.names, map(list, zip(*out, strict=True)), strict=True)), SET)

    return work


def _links(num: int, den: int):
    """Exact links within one group: a signature tree over its sets; connected sets are not compared again."""

    def work(table: pa.Table) -> pa.Table:
        classes, at = np.unique(table.column("class").to_numpy(), return_index=True)
        if len(classes) < 2:
            return LINK.empty_table()
        raw = table.column("shingles")
        sets = [np.frombuffer(raw[int(k)].as_py(), np.uint64) for k in at]
        sizes = np.array([len(s) for s in sets])
        i, j = candidates(bitmaps(np.concatenate(sets), np.concatenate(([0], np.cumsum(sizes)))), sizes, num, den)
        centre = np.flatnonzero(classes == table.column("a")[0].as_py())
        i, j = (np.concatenate([x[k], x[~k]]) for x in (i, j) for k in [np.isin(i, centre) | np.isin(j, centre)])
        root = list(range(len(sets)))

        def top(x):
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        found = []
        for x, y in zip(i.tolist(), j.tolist(), strict=True):
            a, b = top(x), top(y)
            if a == b:
                continue
            shared = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
            if (num + den) * shared >= num * (len(sets[x]) + len(sets[y])):
                root[a] = b
                found.append((int(classes[x]), int(classes[y])))
        return pa.table([[x[0] for x in found], [x[1] for x in found]], schema=LINK)

    return work


def _across(num: int, den: int):
    """Pairs of different components, of a probe and a target among a node's members, that may reach the threshold."""

    def work(table: pa.Table) -> pa.Table:
        n, classes, part = (table.column(c).to_numpy() for c in ("n", "class", "component"))
        probe, target = (table.column(c).to_numpy(zero_copy_only=False).astype(bool) for c in ("probe", "target"))
        i, j = candidates(table.column("map").to_pylist(), n, num, den, probe)
        own = target[j]
        i, j = i[own], j[own]
        keep = part[i] != part[j]
        i, j = i[keep], j[keep]
        # Two members that stand in an earlier node together are left to that node.
        before = [table.column(f"before_{k}").to_numpy() for k in range(1, BEFORE + 1)]
        keep = np.ones(len(i), bool)
        for one in before:
            for two in before:
                keep &= (one[i] != two[j]) | (one[i] == 0)
        pairs = np.sort(np.stack([classes[i[keep]], classes[j[keep]]]), axis=0)
        pairs = np.unique(pairs, axis=1) if pairs.size else pairs
        return pa.table([pairs[0], pairs[1]], schema=LINK)

    return work


def _largest(nodes: DataFrame) -> DataFrame:
    """Nodes without those whose members all stand in one earlier node of the order as well.

    Shingles of one passage give a chain of such nodes, each with some of the members of the one before.
    """
    order = Window.partitionBy("class").orderBy("late", F.col("shingle").bitwiseXOR(F.lit(-(2**63))))
    rows = nodes.select("shingle", "class", *[F.lag("shingle", k).over(order).alias(f"before_{k}") for k in (1, 2)])
    sizes = rows.groupBy("shingle").agg(F.count(F.lit(1)).alias("members"))
    met = rows.select("shingle", F.explode(F.array("before_1", "before_2")).alias("before")).where("before IS NOT NULL")
    inside = met.groupBy("shingle", "before").agg(F.count(F.lit(1)).alias("k")).groupBy("shingle").agg(F.max("k").alias("k"))
    inside = cut_lineage(sizes.join(inside, "shingle").where("k = members").select("shingle"))
    return nodes.join(inside, "shingle", "left_anti").select("shingle", "class")


class JaccardJoin:
    """One join over ``docs``; ``num / den`` is the least similarity of a link, ``size`` the words of a shingle."""

    def __init__(self, docs: DataFrame, id: str = "doc_id", text: str = "text", size: int = 5, num: int = 3, den: int = 4):
        prepare(docs.sparkSession)
        self.docs = rows_of(docs, doc_id=id, text=text).select(
            F.col("doc_id").cast("bigint").alias("doc_id"), "text", F.coalesce(F.col("doc_id").cast("bigint"), F.xxhash64("text")).alias("key"))
        self.size, self.num, self.den = size, num, den

    def classes(self) -> DataFrame:
        """class, n, map, rep (key of a row that has the set), least (smallest id): one row for each distinct set."""
        return self.sets.where("n > 0").groupBy("class").agg(
            F.min("n").alias("n"), F.min("map").alias("map"), F.min("key").alias("rep"), F.min("doc_id").alias("least"))

    def _bounds(self, pairs: DataFrame) -> DataFrame:
        """Pairs of classes whose sizes and bitmaps let them reach the threshold."""
        one = self.known.select(F.col("class").alias("a"), F.col("n").alias("_na"), F.col("map").alias("_ma"))
        two = self.known.select(F.col("class").alias("b"), F.col("n").alias("_nb"), F.col("map").alias("_mb"))
        met = pairs.join(one, "a").where("a <> b").join(two, "b")

        def fits(c: Column) -> Column:
            return (self.num + self.den) * c >= self.num * (F.col("_na") + F.col("_nb"))

        near = met.where(fits(F.least("_na", "_nb")))
        return near.mapInArrow(_overlap(self.num, self.den), LINK_DDL)

    def _compare(self, pairs: DataFrame) -> DataFrame:
        """Exact links among ``pairs`` (a written table): whole sets gathered around each ``a``."""
        groups = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / GROUP).cast("int").alias("salts"))
        groups = cut_lineage(groups)
        members = pairs.join(groups, "a").select(F.col("b").alias("class"), F.struct("a", F.pmod(F.xxhash64("b"), F.col("salts")).cast("int").alias("salt")).alias("key"))
        middle = groups.select(F.col("a").alias("class"), F.explode(F.transform(F.sequence(F.lit(0), F.col("salts") - 1), lambda i: F.struct(F.col("a"), i.cast("int").alias("salt")))).alias("key"))
        wanted = members.unionByName(middle).groupBy("class").agg(F.collect_set("key").alias("keys"))
        wanted = wanted.join(self.known.select("class", "rep"), "class")
        wanted = cut_lineage(wanted.groupBy(F.col("rep").alias("key")).agg(F.flatten(F.collect_list("keys")).alias("keys")))
        whole = attach(self.docs, wanted, "key").mapInArrow(_whole_sets(self.size), SET_DDL)
        return whole.groupBy("a", "salt").applyInArrow(_links(self.num, self.den), LINK_DDL)

    def _missing(self, nodes: DataFrame, found: DataFrame) -> DataFrame:
        """Pairs across components that share a node and pass the bounds."""
        part = self.known.join(found.select(F.col("node").alias("class"), "component"), "class", "left")
        part = cut_lineage(part.select("class", F.coalesce("component", "class").alias("component"), "n"))
        members = nodes.join(part.select("class", "component"), "class")
        counts = members.groupBy("shingle", "component").agg(F.count(F.lit(1)).alias("k"), F.bit_xor(F.xxhash64("class")).alias("x"))
        mixed = counts.groupBy("shingle").agg(F.count(F.lit(1)).alias("parts"), F.sum("k").alias("k"), F.bit_xor("x").alias("x"), F.max(F.struct("k", "component")).alias("main"))
        # Nodes of the same members give the same pairs: one of them is enough.
        mixed = mixed.where("parts > 1").groupBy("k", "x").agg(F.min(F.struct("shingle", "main")).alias("node"))
        main = F.col("node.main")
        mixed = cut_lineage(mixed.select("node.shingle", main["component"].alias("main"), F.ceil(F.col("k") / CHUNK).cast("int").alias("chunks"),
                                         F.ceil((F.col("k") - main["k"]) / CHUNK).cast("int").alias("sides")))
        rows = nodes.join(mixed, "shingle").join(part, "class").join(self.known.select("class", "map"), "class")
        rows = rows.withColumns({"own": F.pmod(F.xxhash64("class"), F.col("chunks")).cast("int"), "side": F.pmod(F.xxhash64("class", F.lit(1)), F.col("sides")).cast("int")})
        # All nodes that are traversed have one order. A pair of different components is looked at in each node that
        # holds both, as no more than one of them is of the main component; so the first of these nodes is enough.
        upto = Window.partitionBy("class").orderBy("shingle")
        before = [f"before_{k}" for k in range(1, BEFORE + 1)]
        rows = rows.withColumns({name: F.lag("shingle", k, 0).over(upto) for k, name in enumerate(before, start=1)})
        # A task holds one chunk of all members, the targets, against one side of the members outside the main component, the probes:
        # a number of both that does not grow. A member is a target for each side; one outside is also a probe for each chunk.
        outside = F.col("component") != F.col("main")
        place = lambda chunk, side: F.struct(chunk.cast("int").alias("chunk"), side.cast("int").alias("part"))
        targets = F.transform(F.sequence(F.lit(0), F.col("sides") - 1), lambda s: place(F.col("own"), s))
        probes = F.transform(F.filter(F.sequence(F.lit(0), F.col("chunks") - 1), lambda c: outside & (c != F.col("own"))), lambda c: place(c, F.col("side")))
        sent = rows.select("shingle", F.explode(F.concat(targets, probes)).alias("place"), "own", "side", "class", "component", "n", "map", outside.alias("outside"), *before)
        sent = sent.select("shingle", "place.*", "class", "component", "n", "map", (F.col("own") == F.col("place.chunk")).alias("target"),
                           (F.col("outside") & (F.col("side") == F.col("place.part"))).alias("probe"), *before)
        return sent.groupBy("shingle", "chunk", "part").applyInArrow(_across(self.num, self.den), LINK_DDL).distinct()

    def run(self) -> DataFrame:
        """doc_id, n_shingles, component_id for each row; the component's id is its smallest doc_id."""
        spark = self.docs.sparkSession
        rows, size = text_volume(self.docs)
        seen = cut_lineage(self.docs.mapInArrow(_look(self.size), SEEN_DDL))
        self.sets = seen.where("shingle IS NULL").select("doc_id", "key", "class", "n", "map")
        self.known = cut_lineage(self.classes())
        total = self.known.count()
        often = seen.where("shingle IS NOT NULL").groupBy("shingle").agg(F.sum("seen").alias("seen"), F.min("class").alias("class"))
        often = often.where(F.col("seen") >= max(COMMON_LEAST, int(total * COMMON_SHARE))).select("shingle", "class").toArrow()
        common = often.column("shingle").to_numpy().view(np.uint64)
        order = np.argsort(common)
        common, centres = common[order], often.column("class").to_numpy()[order]

        buckets = pieces(size * (self.den - self.num) // self.den // 5, BUCKET_ENTRIES)
        sent = self.docs.mapInArrow(_send(self.size, self.num, self.den, buckets, common), SENT_DDL)
        met = cut_lineage(sent.groupBy("bucket").applyInArrow(_meet(self.num, self.den, common, centres), NODE_DDL))
        nodes = cut_lineage(_largest(met.where("NOT pair").select("shingle", "class", "late")))
        first = met.where("pair").select(F.col("shingle").alias("a"), F.col("class").alias("b")).distinct()

        links = cut_lineage(self._compare(cut_lineage(self._bounds(first))))
        found = components(links)
        more = cut_lineage(self._missing(nodes, found))
        links = links.unionByName(self._compare(more))
        found = components(links).select(F.col("node").alias("class"), "component")

        part = self.known.select("class", "least").join(found, "class", "left").withColumn("component", F.coalesce("component", "class"))
        part = cut_lineage(part)
        smallest = cut_lineage(part.groupBy("component").agg(F.min("least").alias("component_id")))
        label = cut_lineage(part.select("class", "component").join(smallest, "component").select("class", "component_id"))
        out = self.sets.join(label, "class", "left")
        return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def _overlap(num: int, den: int):
    """Keep pairs whose bitmaps allow the overlap."""

    def work(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            one, two = batch.column("_ma").to_pylist(), batch.column("_mb").to_pylist()
            na, nb = batch.column("_na").to_numpy(), batch.column("_nb").to_numpy()
            shared = np.minimum(na, nb)
            words = np.array([min(len(x), len(y)) // 8 for x, y in zip(one, two, strict=True)])
            for width in np.unique(words).tolist():
                at = np.flatnonzero(words == width)
                a, b = (stacked([m[k] for k in at.tolist()], width) for m in (one, two))
                bits = [np.bitwise_count(x).sum(axis=1, dtype=np.int64) for x in (a & b, a, b)]
                shared[at] = np.minimum(shared[at], bits[0] + np.minimum(na[at] - bits[1], nb[at] - bits[2]))
            keep = pa.array((num + den) * shared >= num * (na + nb))
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], schema=LINK)

    return work


def jaccard_join(docs: DataFrame, id: str = "doc_id", text: str = "text", size: int = 5, num: int = 3, den: int = 4) -> DataFrame:
    """doc_id, n_shingles, component_id."""
    return JaccardJoin(docs, id, text, size, num, den).run()
