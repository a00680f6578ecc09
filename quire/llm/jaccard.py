"""N-gram Jaccard join by PartEnum signatures, and the classes of linked texts.

The set of a text holds its distinct word n-grams (ASCII letters lower-cased, words parted by ASCII white space); a
text with fewer words has the whole sequence as its one element. Sets are banded by size so that a pair that reaches
the threshold lies in one band or two neighbouring ones. For each band that a set may meet partners in, the domain of
hashed n-grams is split into parts, and each part into three subparts. Two sets whose difference is as small as the
threshold demands differ in one subpart at most of some part, so they share the signature of two subparts of it.

Signatures only find candidates. The members of a signature's group are compared by parity sketches, whose distance is
never more than that of the sets: members that stand close to the group's least node are joined with it, and those of
a group that does not stand close as a whole are compared with each other, in blocks. What passes makes classes, all
pairs of which are verified on the sets themselves, again in blocks.

Nulls, empty texts and texts without words have an empty set, which links with nothing; such a text is a class of its
own. Copies are one set throughout and never expanded into pairs. Repeated rows are returned as often as they came;
rows with a null id link like others but name no class, so a class of null ids alone has a null component_id. An empty
table gives an empty table; other columns are ignored. N-grams are compared by 64-bit hashes, texts' sets by a 64-bit
sum of them.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Screen, drop_settled, settle

#: Subparts of a part, and how many of them may differ.
SUBPARTS, KEEP_OUT = 3, 1
#: Expected members of a block, and expected n-grams of all its sets.
BLOCK, ELEMENTS = 2048, 1_000_000
#: Expected members of signatures that one call compares.
COMPARED = 8192
#: Texts whose signatures are made before they are handed on; distinct sets that a task remembers.
PORTION, REMEMBERED = 500, 100_000


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 150_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_hashes = _Hashes()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, n: int) -> np.ndarray:
    """Sorted hashes of the distinct word n-grams."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))
    n = min(n, len(words))
    x = np.full(len(words) - n + 1, n, np.uint64)
    for i in range(n):
        x = x * np.uint64(0x9E3779B97F4A7C15) + h[i : len(h) - n + 1 + i]
    return np.unique(_mix(x))


def fingerprint(s: np.ndarray) -> int:
    total = _mix(s + np.uint64(0x632BE59BD9B4E019)).sum(dtype=np.uint64, keepdims=True)
    return int(_mix(total + np.uint64(len(s))).view(np.int64)[0]) if len(s) else 0


def sketch(s: np.ndarray) -> np.ndarray:
    """One bit for each value of the hash's lowest bits: whether an odd number of elements has that value. There is at
    least one bit an element, their number is a power of two, and a longer sketch folds to a shorter one by exclusive or."""
    bits = max(64, 1 << (len(s) - 1).bit_length()) if len(s) else 64
    odd = np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.uint64)


def fold(sketches: list[np.ndarray]) -> np.ndarray:
    """The sketches, as rows, at the length of the shortest."""
    least = min(map(len, sketches))
    return np.stack([np.bitwise_xor.reduce(x.reshape(-1, least)) if len(x) > least else x for x in sketches])


def allowed(a, b, percent: int):
    """The most elements in which linked sets of these sizes differ."""
    return (a + b) * (100 - percent) // (100 + percent)


class Bands:
    """Size bands and the signatures of a set in them; `percent` is the least similarity."""

    def __init__(self, percent: int):
        self.percent, self.tops = percent, [0]

    def of(self, size: int) -> int:
        while self.tops[-1] < size:
            self.tops.append((self.tops[-1] + 1) * 100 // self.percent)
        return int(np.searchsorted(self.tops, size))

    def signatures(self, s: np.ndarray) -> np.ndarray:
        band = self.of(len(s))
        self.of(self.tops[band] + 1)
        return np.concatenate([self._in(s, b) for b in (band, band + 1)])

    def _in(self, s: np.ndarray, band: int) -> np.ndarray:
        differ = allowed(self.tops[band], self.tops[band], self.percent)
        if not differ:  # only equal sets are linked
            return _mix(s.sum(dtype=np.uint64, keepdims=True) + np.uint64(band))
        # At most differ / (KEEP_OUT + 1) parts differ in more subparts than are kept out. With some parts to spare, a
        # pair agrees on a choice that is not empty, unless a set has as many parts with an empty choice as must agree;
        # only such sets bear the signatures of empty choices, which would bring together all sets of a band.
        need = differ // (KEEP_OUT + 1) + 1
        kept, ways = SUBPARTS - KEEP_OUT, len(_CHOICES)
        each = (self.percent / 100) ** 1.5 * self.tops[band] / (SUBPARTS * need)
        spare = 1 + int(np.ceil(need * min(1.0, ways * np.exp(-kept * each))))
        parts = need + spare
        # s is sorted and uniform, so equal ranges of its upper half are the subparts, and each is one slice.
        place = ((s >> np.uint64(32)) * np.uint64(parts * SUBPARTS)) >> np.uint64(32)
        edge = np.searchsorted(place, np.arange(parts * SUBPARTS + 1, dtype=np.uint64))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(s, dtype=np.uint64)])
        total = (sums[edge[1:]] - sums[edge[:-1]]).reshape(parts, SUBPARTS)
        count = (edge[1:] - edge[:-1]).reshape(parts, SUBPARTS)
        label = _mix(np.arange(parts, dtype=np.uint64)[:, None] + np.uint64(band << 40))
        made = _mix(_mix(np.stack([total[:, c] @ _ODD[c] + np.uint64(i + 1) for i, c in enumerate(_CHOICES)], 1)) ^ label)
        empty = np.stack([count[:, c].sum(1) == 0 for c in _CHOICES], 1)
        return made.reshape(-1) if empty.any(1).sum() > spare else made[~empty]


#: The subparts that a signature covers, each choice of them; each subpart's odd factor.
_CHOICES = [list(c) for c in combinations(range(SUBPARTS), SUBPARTS - KEEP_OUT)]
_ODD = np.arange(3, 3 + 2 * SUBPARTS, 2, dtype=np.uint64)


class _New:
    """Whether a task meets a set for the first time, as far as it remembers."""

    def __init__(self):
        self.seen = set()

    def __call__(self, node: int) -> bool:
        if node in self.seen:
            return False
        if len(self.seen) > REMEMBERED:
            self.seen.clear()
        self.seen.add(node)
        return True


def _batch(columns: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def _sketches(documents: DataFrame, n: int, id_col: str, text_col: str) -> DataFrame:
    """(id, node, n_shingles, text, sketch); node identifies a set and is null for the empty one, text is a hash of it."""

    def rows(it):
        for batch in it:
            for at in range(0, batch.num_rows, PORTION):
                part = batch.slice(at, PORTION)
                sets = [shingles(t, n) for t in part.column(1).to_pylist()]
                nodes = pa.array([fingerprint(s) if len(s) else None for s in sets], pa.int64())
                held = pa.array([sketch(s).tobytes() if len(s) else None for s in sets], pa.binary())
                yield _batch({"id": part.column(0), "node": nodes, "n_shingles": pa.array(map(len, sets), pa.int64()), "text": part.column(2), "sketch": held})

    read = documents.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t"), F.xxhash64(F.col(text_col).cast("string")).alias("text"))
    return read.mapInArrow(rows, "id long, node long, n_shingles long, text long, sketch binary")


def _signatures(documents: DataFrame, n: int, percent: int, text_col: str) -> DataFrame:
    """(signature, node) of every distinct set, once for each task that meets it."""

    def rows(it):
        bands, new = Bands(percent), _New()
        for batch in it:
            texts = batch.column(0).to_pylist()
            for at in range(0, len(texts), PORTION):
                nodes, found = [], []
                for t in texts[at : at + PORTION]:
                    s = shingles(t, n)
                    if len(s) and new(node := fingerprint(s)):
                        found.append(bands.signatures(s).view(np.int64))
                        nodes.append(np.full(len(found[-1]), node, np.int64))
                if found:
                    yield _batch({"signature": pa.array(np.concatenate(found)), "node": pa.array(np.concatenate(nodes))})

    return documents.select(text_col).mapInArrow(rows, "signature long, node long")


def _meetings(signatures: DataFrame) -> DataFrame:
    """(signature, node, hub): each node that shares a signature with a lesser one, and the least such. One pass over
    sorted rows that keeps the last row and the hub of its signature, whatever a signature's rows number."""

    def rows(it):
        last = None
        for batch in it:
            sig, node = (c.to_numpy() for c in batch.columns)
            if not len(sig):
                continue
            before_sig, before_node, hub = last if last else (~sig[0], node[0], node[0])
            same = np.append(before_sig, sig[:-1]) == sig
            again = same & (np.append(before_node, node[:-1]) == node)
            first = ~same
            hubs = np.append(hub, node[first])[np.cumsum(first)]
            out = same & ~again
            yield _batch({"signature": pa.array(sig[out]), "node": pa.array(node[out]), "hub": pa.array(hubs[out])})
            last = sig[-1], node[-1], hubs[-1]

    dealt = signatures.repartition("signature").sortWithinPartitions("signature", "node")
    return dealt.mapInArrow(rows, "signature long, node long, hub long")


def _close(percent: int):
    """Whether two columns of sketches may belong to linked sets."""

    @F.pandas_udf("boolean")
    def close(a: pd.Series, n: pd.Series, b: pd.Series, m: pd.Series) -> pd.Series:
        most = allowed(n, m, percent)
        out = []
        for x, y, d in zip(a, b, most):
            p = fold([np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)])
            out.append(int(np.bitwise_count(p[0] ^ p[1]).sum()) <= d)
        return pd.Series(out, dtype=bool)

    return close


def _labels(link: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least place (rows' places before columns') that each row and column is connected with; one sweep of a link
    matrix at a time."""
    m, n = link.shape
    top, side = np.arange(m, dtype=np.int32), np.arange(m, m + n, dtype=np.int32)
    while True:
        a = np.minimum(top, np.where(link, side[None], m + n).min(1)).astype(np.int32)
        b = np.minimum(side, np.where(link, a[:, None], m + n).min(0)).astype(np.int32)
        if (a == top).all() and (b == side).all():
            return top, side
        top, side = a, b


def _edges(rows: pd.DataFrame, columns: pd.DataFrame, link: np.ndarray, same: bool) -> pd.DataFrame:
    """(a, b, links): each member's node, the node that stands for what it is connected with, and its linked rows.
    With `same`, rows and columns are the same members, each returned once."""
    a, b = rows["node"].to_numpy(), columns["node"].to_numpy()
    if same:
        np.fill_diagonal(link, False)
        links = link @ columns["copies"].to_numpy(np.float64)
        np.fill_diagonal(link, True)  # a member's row and column are one
        return pd.DataFrame({"a": a, "b": a[_labels(link)[0]], "links": links.astype(np.int64)})
    links = np.concatenate([link @ columns["copies"].to_numpy(np.float64), rows["copies"].to_numpy(np.float64) @ link])
    nodes = np.concatenate([a, b])
    return pd.DataFrame({"a": nodes, "b": nodes[np.concatenate(_labels(link))], "links": links.astype(np.int64)})


def _compare(percent: int):
    """Of the members of many signatures, each in one or two blocks, those connected by sketches that may belong to
    linked sets."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        i, j = int(pdf["i"].iloc[0]), int(pdf["j"].iloc[0])
        pdf = pdf.sort_values(["signature", "block", "node"], ignore_index=True)
        node, block, near, size = (pdf[c].to_numpy() for c in ("node", "block", "near", "n_shingles"))
        data = [np.frombuffer(x, np.uint64) for x in pdf["sketch"]]
        edge = np.flatnonzero(np.append(True, np.diff(pdf["signature"].to_numpy()) != 0))
        out = [np.zeros((2, 0), np.int64)]
        for lo, hi in zip(edge.tolist(), [*edge[1:].tolist(), len(pdf)]):
            cut = lo if i == j else lo + int(np.searchsorted(block[lo:hi], max(i, j)))
            rows, columns = (slice(lo, hi), slice(lo, hi)) if i == j else (slice(lo, cut), slice(cut, hi))
            if rows.stop == rows.start or columns.stop == columns.start:
                continue
            bits = fold(data[lo:hi])
            x, y = bits[rows.start - lo : rows.stop - lo], bits[columns.start - lo : columns.stop - lo]
            step = max(1, 4_000_000 // y.size)
            for at in range(0, len(x), step):
                r = slice(rows.start + at, min(rows.start + at + step, rows.stop))
                apart = np.bitwise_count(x[at : at + step, None] ^ y[None]).sum(2, dtype=np.int64)
                # Members near the hub are connected already.
                link = (apart <= allowed(size[r, None], size[None, columns], percent)) & ~(near[r, None] & near[None, columns])
                if link.any():
                    ends = np.concatenate([node[r], node[columns]])
                    out.append(np.stack([ends, ends[np.concatenate(_labels(link))]]))
        made = np.unique(np.concatenate(out, 1), axis=1)
        made = made[:, made[0] != made[1]]
        return pd.DataFrame({"a": made[0], "b": made[1]})

    return one


def _verify(percent: int):
    """Of a class's members in one or two blocks, each one's connected node and its links, counting copies."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        i, j = int(pdf["i"].iloc[0]), int(pdf["j"].iloc[0])
        pdf = pdf.sort_values("node", ignore_index=True)
        rows = pdf[pdf["block"] == i]
        columns = rows if i == j else pdf[pdf["block"] == j]
        if not len(rows) or not len(columns):
            return pd.DataFrame({"a": [], "b": [], "links": [], "blocks": []}).astype("int64")
        sets = [[np.frombuffer(b, np.uint64) for b in f["elements"]] for f in ((rows,) if i == j else (rows, columns))]
        size = [np.array([len(s) for s in x]) for x in sets]
        # Elements of one set only are not shared; the others are numbered.
        value, shared = np.unique(np.concatenate([s for x in sets for s in x]), return_counts=True)
        value = value[shared > 1]
        width = max(256, min(4096, 8_000_000 // (len(rows) + len(columns))))
        where = [(np.repeat(np.arange(len(x)), n), np.searchsorted(value, np.concatenate(x))) for x, n in zip(sets, size)] if len(value) else []
        spots = []
        for (row, col), x in zip(where, sets):
            held = value[np.minimum(col, len(value) - 1)] == np.concatenate(x)
            row, col = row[held], col[held]
            order = np.argsort(col, kind="stable")
            spots.append((row[order], col[order]))
        common = np.zeros((len(rows), len(columns)), np.float32)
        for lo in range(0, len(value), width):
            made = []
            for (row, col), n in zip(spots, size):
                a, b = np.searchsorted(col, [lo, lo + width])
                x = np.zeros((len(n), width), np.float32)
                x[row[a:b], col[a:b] - lo] = 1
                made.append(x)
            common += made[0] @ made[-1].T
        both = size[0].astype(np.float32)[:, None] + size[-1].astype(np.float32)[None]
        link = (100 + percent) * common.astype(np.float64) >= percent * both
        return _edges(rows, columns, link, i == j).assign(blocks=pdf["blocks"].iloc[0])

    return one


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every end of the edges (a, b): root is the least node that it is connected with.

    Large-star and small-star steps in turn (Kiveris et al., 2014), each round written to the shared folder.
    """
    e = edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e, before = settle(e), None
    while True:
        now = e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == before or not now[0]:
            break
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        root = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(root, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        old, e, before = e, settle(small.unionByName(root.select("u", F.col("m").alias("v"))).distinct()), now
        drop_settled(old)
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _in_blocks(members: DataFrame, group: str, need) -> DataFrame:
    """Members (node, ...) of groups, each with its block and once for every pair of blocks (i, j) that it is in."""
    sized = members.groupBy(group).agg(F.ceil(need).cast("int").alias("blocks"))
    at = members.join(sized, group).withColumn("block", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
    other = at.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return other.withColumn("i", F.least("block", "o")).withColumn("j", F.greatest("block", "o")).drop("o")


def candidates(documents: DataFrame, sets: DataFrame, n: int, percent: int, text_col: str) -> DataFrame:
    """(a, b): edges between sets (node, n_shingles, sketch), such that linked sets are always connected."""
    met = settle(_meetings(_signatures(documents, n, percent, text_col)))
    to = sets.select(F.col("node").alias("hub"), F.col("sketch").alias("hub_sketch"), F.col("n_shingles").alias("hub_n"))
    pairs = met.select("node", "hub").distinct().join(sets, "node").join(to, "hub")
    near = settle(pairs.select("node", "hub", _close(percent)("sketch", "n_shingles", "hub_sketch", "hub_n").alias("near")))
    # Groups with more pairs than those with the hub, and a member that is not near it; of groups with equal members, one.
    same = [F.bit_xor(F.xxhash64("node", F.lit(i))).alias(f"same{i}") for i in (1, 2)]
    groups = met.join(near, ["node", "hub"]).groupBy("signature", "hub").agg(F.count("*").alias("n"), F.count_if(~F.col("near")).alias("far"), *same)
    groups = groups.filter("n > 1 and far > 0").groupBy("hub", "n", "same1", "same2").agg(F.min("signature").alias("signature"))
    groups = settle(groups)
    portions = -(-(groups.agg(F.sum("n")).first()[0] or 1) // COMPARED)
    rest = met.join(groups.select("signature"), "signature", "left_semi").join(near, ["node", "hub"]).select("signature", "node", "near")
    members = rest.unionByName(groups.select("signature", F.col("hub").alias("node"), F.lit(True).alias("near"))).join(sets, "node")
    blocks = _in_blocks(members, "signature", F.count("*") / BLOCK).withColumn("portion", F.pmod(F.xxhash64("signature"), F.lit(portions)))
    found = blocks.drop("blocks").groupBy("portion", "i", "j").applyInPandas(_compare(percent), "a long, b long")
    edges = settle(near.filter("near").select(F.col("node").alias("a"), F.col("hub").alias("b")).unionByName(found).distinct())
    for done in (met, near, groups):
        drop_settled(done)
    return edges


def linked(documents: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id_col, n_shingles, component_id (the smallest id that links reach) and n_links (rows
    linked with it directly, its copies among them). Two texts link when the intersection of their sets is at least
    `percent` hundredths of the union."""
    spark = documents.sparkSession
    base = settle(_sketches(documents, n, id_col, text_col))
    reps = base.filter("node is not null").groupBy("node").agg(F.min("id").alias("rep"), F.count("*").alias("copies"), F.max("n_shingles").alias("n_shingles"), F.min("text").alias("text"), F.max("sketch").alias("sketch"))
    edges = candidates(documents, reps.select("node", "n_shingles", "sketch"), n, percent, text_col)
    groups = settle(components(edges).join(reps.drop("sketch"), "node"))
    drop_settled(edges)
    need = F.greatest(F.count("*") / BLOCK, F.sum("n_shingles") / ELEMENTS)
    placed = _in_blocks(groups.select("root", "node", "copies", "n_shingles"), "root", need)

    # Only texts that may be wanted give their sets: a table of fixed size screens texts' hashes, the join on the set
    # itself makes it exact.
    held = spark.sparkContext.broadcast(Screen.of(groups.select(F.col("text").cast("string").alias("text")), "text"))

    def sets(it):
        known, new = held.value, _New()
        for batch in it:
            pick = [t for t, h in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if known.may_hold(str(h))]
            for at in range(0, len(pick), PORTION):
                made = [(s, node) for s in (shingles(t, n) for t in pick[at : at + PORTION]) if len(s) and new(node := fingerprint(s))]
                if made:
                    yield _batch({"node": pa.array([i for _, i in made], pa.int64()), "elements": pa.array([s.tobytes() for s, _ in made], pa.binary())})

    found = documents.select(text_col, F.xxhash64(F.col(text_col).cast("string"))).mapInArrow(sets, "node long, elements binary")
    held_sets = found.join(groups.select("node"), "node", "left_semi").dropDuplicates(["node"])
    pairs = placed.join(held_sets, "node").select("root", "i", "j", "node", "copies", "block", "elements", "blocks")
    checked = settle(pairs.groupBy("root", "i", "j").applyInPandas(_verify(percent), "a long, b long, links long, blocks long"))
    drop_settled(groups)
    alone = checked.filter("blocks = 1").select(F.col("a").alias("node"), F.col("b").alias("root"))
    many = components(checked.filter("blocks > 1 and a <> b").select("a", "b"))
    classes = reps.select("node", "rep", "copies").join(alone.unionByName(many), "node", "left").withColumn("root", F.coalesce("root", "node"))
    names = classes.groupBy("root").agg(F.min("rep").alias("component_id"))
    links = checked.groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    known = classes.join(names, "root").join(links, "node", "left")
    known = known.select("node", "component_id", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    out = base.select("id", "node", "n_shingles").join(known, "node", "left")
    return out.select(F.col("id").alias(id_col), "n_shingles", F.coalesce("component_id", "id").alias("component_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
