"""Near-duplicate documents by a chosen-path set similarity join.

Every document is its set of word shingles.  Documents with equal sets are one
class and take part once.  A class has ``WIDTH`` minwise tokens.  In each of
``trees(percent)`` trees a document starts at the root; a node chooses, by its
own random numbers, a few of the token positions (``BRANCHES`` on average), and the
document goes to the child for each chosen position and the token it has there.  So
two documents share a node after d levels if they agreed on the d tokens that the
nodes on the way chose.  Nodes are looked at ``START`` levels down.

First every node of a random share (1 / ``FIRST``) of them is dealt into blocks of at
most ``SMALL`` documents, a large one with its smallest member in each.  In a block
pairs whose tokens agree often enough are candidates; a spanning forest of them, the
most similar first, is confirmed on the full sets.  That joins nearly every group of
near copies at a cost in proportion to its size.  From then on only nodes that hold
several components count: all of them are dealt like that once more, for forests
between the components.  Then all candidates whose ends are still in different
components are confirmed: those of nodes of up to ``SMALL`` documents, and of larger
ones that are one component but for a few documents, which meet all others.  The other
large nodes are branched again.

Nodes that are still large and not one component ``DEEPEST`` levels down hold
documents that agree nearly everywhere.  Their documents are joined exactly
(``meetings``), whatever their number: two sets of known sizes that reach the
similarity share one of their few rarest shingles, so only documents that share one in
that place meet.  A shingle that many documents have in that place costs rows with the
square of their number; all other steps make a fixed number of rows for each document
at most.

The number of trees follows from the similarity: a pair exactly at it has no node in
common with a probability of ``LOST`` at most (17 trees at 0.85, 20 at 0.80), and more
similar pairs far less often.  All trees choose from the same tokens, so this is a
mean over the number of tokens on which the pair agrees, and over trees (``missed``).

Null or wordless texts have an empty set and stand alone; so does a null doc_id.
Rows that share a doc_id are one document: all their sets take part in the search, and
what any of them is linked with is linked with all of them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.common import Scratch, rows_of, short_batches
from lodestrata.llm.components import components
from lodestrata.llm.shingles import U, alike, mixed, shingle_sets, sketches

#: Tokens that trees branch by, and minwise values that candidates are told by.
WIDTH, CHECKS = 64, 128
BRANCHES, LOST = 1.4, 1 / 8000
START, DEEPEST, SMALL = 2, 4, 48
#: Shingles are counted in so many buckets; sizes of sets that differ by less than STEP are one class.
COUNTED, STEP = 1 << 20, 1.02
#: Of the nodes, the share 1 / FIRST is compared first: it joins most copies.
FIRST = 8
#: Documents named in a broadcast (about 60 bytes each); beyond that the join shuffles.
MOST_BROADCAST = 500_000


def agreement(percent: int) -> int:
    """Of CHECKS values: at this similarity fewer agree about once in 100,000 pairs."""
    p = percent / 100
    return int(CHECKS * p - 4.3 * (CHECKS * p * (1 - p)) ** 0.5)


def missed(percent: int, n: int) -> float:
    """The share of pairs exactly at this similarity that have no node in common DEEPEST levels down n trees."""
    p, out = percent / 100, 0.0
    for k in range(WIDTH + 1):  # tokens on which they agree
        found = 1.0
        for _ in range(DEEPEST):
            found = 1 - (1 - BRANCHES / WIDTH * found) ** k
        out += comb(WIDTH, k) * p**k * (1 - p) ** (WIDTH - k) * (1 - found) ** n
    return out


def trees(percent: int) -> int:
    """As few trees as miss LOST of the pairs at this similarity at most; beyond 1,000 the tokens can't tell such pairs."""
    for n in range(1, 1001):
        if missed(percent, n) <= LOST:
            return n
    raise ValueError(f"no number of trees finds pairs at {percent} %")


def _batch(**columns: tuple) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in columns.values()], list(columns))


def described(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, th (a hash of the text), n_shingles, key (of the set), sketch and its lowest bytes of every row."""
    schema = "doc_id long, th long, n_shingles long, key binary, sketch binary, short binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, hashes, texts in rows_of(batches, "doc_id", "th", "text"):
            sets = shingle_sets(texts, width)
            full = [k for k, s in enumerate(sets) if len(s)]
            keys = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
            sketch: list[bytes | None] = [None] * len(sets)
            short: list[bytes | None] = [None] * len(sets)
            for k, row in zip(full, sketches([sets[k] for k in full], CHECKS)):
                sketch[k], short[k] = row[:WIDTH].tobytes(), row.astype(np.uint8).tobytes()
            yield _batch(
                doc_id=(ids, pa.int64()),
                th=(hashes, pa.int64()),
                n_shingles=([len(s) for s in sets], pa.int64()),
                key=(keys, pa.binary()),
                sketch=(sketch, pa.binary()),
                short=(short, pa.binary()),
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), "text").mapInArrow(run, schema)


def children(nodes: np.ndarray, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and child nodes for documents (rows of tokens) at nodes."""
    least = U(int(2**64 * BRANCHES / WIDTH))
    places = np.arange(1, WIDTH + 1, dtype=U) * U(0x9E3779B97F4A7C15)
    rows, kids = [], []
    for i in range(0, len(nodes), 4096):
        chosen = mixed(nodes[i : i + 4096, None] ^ places[None, :])
        r, c = np.nonzero(chosen < least)
        rows.append(r + i)
        kids.append(mixed(mixed(nodes[r + i] + places[c]) ^ (tokens[r + i, c].astype(U) + U(1))))
    return (np.concatenate(rows), np.concatenate(kids)) if rows else (np.zeros(0, np.int64), np.zeros(0, U))


def _branched(rows: DataFrame, levels: int, roots: int) -> DataFrame:
    """node, id: where the documents of rows (id, sketch; node unless they start at that many roots) are levels further down."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = np.asarray(b.column(b.schema.get_field_index("id")))
            tokens = np.frombuffer(b"".join(b.column(b.schema.get_field_index("sketch")).to_pylist()), np.uint32).reshape(-1, WIDTH)
            if roots:
                of = np.tile(np.arange(len(ids)), roots)
                nodes = np.repeat(mixed(np.arange(1, roots + 1, dtype=U)), len(ids))
            else:
                of, nodes = np.arange(len(ids)), np.asarray(b.column(b.schema.get_field_index("node"))).view(U)
            for _ in range(levels):
                r, nodes = children(nodes, tokens[of])
                of = of[r]
            yield _batch(node=(nodes.view(np.int64), pa.int64()), id=(ids[of], pa.int64()))

    names = ["id", "sketch"] if roots else ["id", "sketch", "node"]
    return rows.select(*names).mapInArrow(run, "node long, id long")


def _groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Tables of whole groups of rows with one key, from batches sorted by it."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        keys = np.asarray(b.column(b.schema.get_field_index(key)))
        cut = int(np.count_nonzero(keys != keys[-1]))  # the last key may go on in the next batch
        if cut:
            yield pa.Table.from_batches([*held, b.slice(0, cut)])
            held = []
        elif held and np.asarray(held[-1].column(held[-1].schema.get_field_index(key)))[-1] != keys[-1]:
            yield pa.Table.from_batches(held)
            held = []
        held.append(b.slice(cut))
    if held:
        yield pa.Table.from_batches(held)


def _forest(pairs: list[tuple[int, int, int]], label: list[int]) -> list[tuple[int, int]]:
    """A spanning forest of (agreement, i, j), largest agreement first, where rows of one label are joined already."""
    up, out = {x: x for x in label}, []
    for _, i, j in sorted(pairs, key=lambda p: -p[0]):
        a, b = label[i], label[j]
        while up[a] != a:
            up[a] = a = up[up[a]]
        while up[b] != b:
            up[b] = b = up[up[b]]
        if a != b:
            up[a] = b
            out.append((i, j))
    return out


def _candidates(leaves: DataFrame, least: int, all_pairs: bool) -> DataFrame:
    """block, a, b: candidates between labels within small nodes: all of them, or a spanning forest of the labels."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _groups(batches, "block"):
            block, ids, label = t.column("block").to_numpy(), t.column("id").to_numpy(), t.column("label").to_numpy()
            short = np.frombuffer(b"".join(t.column("short").to_pylist()), np.uint8).reshape(-1, CHECKS)
            edge = np.append(np.flatnonzero(np.append(True, block[1:] != block[:-1])), len(block))
            size = np.diff(edge)
            out_a, out_b, out_block = [], [], []
            for n in np.unique(size[size > 1]):
                first = edge[:-1][size == n]
                i, j = np.triu_indices(n, 1)
                step = max(1, (1 << 14) // len(i))
                for k in range(0, len(first), step):
                    f = first[k : k + step]
                    x, y = (f[:, None] + i).ravel(), (f[:, None] + j).ravel()
                    apart = np.flatnonzero(label[x] != label[y])
                    x, y = x[apart], y[apart]
                    same = (short[x] == short[y]).sum(1)
                    good = np.flatnonzero((same >= least) & (ids[x] != ids[y]))
                    if not len(good):
                        continue
                    gx, gy = x[good], y[good]
                    if n > 2 and not all_pairs:
                        owner, keep = np.searchsorted(f, gx, "right") - 1, []
                        for o in np.split(np.arange(len(good)), np.flatnonzero(np.diff(owner)) + 1):
                            at = f[owner[o[0]]]
                            keep += [(at + p, at + q) for p, q in _forest(list(zip(same[good[o]].tolist(), (gx[o] - at).tolist(), (gy[o] - at).tolist())), label[at : at + n].tolist())]
                        gx, gy = np.array(keep).T
                    out_a.append(np.minimum(ids[gx], ids[gy]))
                    out_b.append(np.maximum(ids[gx], ids[gy]))
                    out_block.append(block[gx])
            if out_a:
                yield _batch(block=(np.concatenate(out_block), pa.int64()), a=(np.concatenate(out_a), pa.int64()), b=(np.concatenate(out_b), pa.int64()))

    dealt = leaves.select("block", "id", "label", "short").repartition("block").sortWithinPartitions("block", "id")
    return dealt.mapInArrow(run, "block long, a long, b long").groupBy("a", "b").agg(F.min("block").alias("block"))


def _labelled(rows: DataFrame, labels: DataFrame | None) -> DataFrame:
    if labels is None:
        return rows.withColumn("label", F.col("id"))
    return rows.join(labels, "id", "left").withColumn("label", F.coalesce("label", "id"))


def _blocks_of(rows: DataFrame) -> DataFrame:
    """block, id of nodes (node, id, n): a large node in random blocks of about SMALL / 2, each with its smallest member."""
    parts = F.when(F.col("n") <= SMALL, F.lit(1).cast("long")).otherwise(F.ceil(F.col("n") * 2 / SMALL))
    block = F.xxhash64("node", F.col("part"))
    own = rows.select("node", "id", F.pmod(F.xxhash64("id", "node"), parts).alias("part")).select(block.alias("block"), "id")
    large = rows.where(F.col("n") > SMALL).groupBy("node").agg(F.min("id").alias("id"), F.first("n").alias("n"))
    first = large.select("node", "id", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)).alias("part")).select(block.alias("block"), "id")
    return own.union(first)


class Search:
    """The components so far of one search, and its intermediate tables."""

    def __init__(self, docs: DataFrame, classes: DataFrame, scratch: Scratch, width: int, percent: int):
        self.docs, self.classes, self.scratch, self.width, self.percent = docs, classes, scratch, width, percent
        self.short = classes.select("id", "short")
        self.labels: DataFrame | None = None  # id, label: of classes with a link

    def several(self, rows: DataFrame) -> DataFrame:
        """node, id, n of rows (node, id) in nodes that hold several components."""
        told = _labelled(rows, self.labels)
        sizes = told.groupBy("node").agg(F.count("*").alias("n"), F.min("label").alias("lo"), F.max("label").alias("hi"))
        kept = self.scratch.write(sizes.where("lo <> hi").select("node", "n"), "sizes")
        out = self.scratch.write(rows.join(kept, "node").select("node", "id", "n"), "several")
        self.scratch.drop(kept)
        return out

    def parted(self, large: DataFrame) -> tuple[DataFrame, DataFrame]:
        """block, id that meet all pairs of different components in those large nodes that are one component but for SMALL / 2 documents; node, id of the others.

        Each of a node's blocks has a part of its largest component and all its other documents,
        so it makes at most twice its rows.
        """
        told = _labelled(large.select("node", "id", "n"), self.labels)
        sizes = told.groupBy("node", "label").agg(F.count("*").alias("k"), F.min("n").alias("n"))
        most = sizes.groupBy("node").agg(F.max(F.struct("k", "label")).alias("m"), F.min("n").alias("n"))
        most = self.scratch.write(most.select("node", F.col("m.label").alias("main"), (F.col("n") - F.col("m.k")).alias("others")), "main")
        few = told.join(most.where(F.col("others") <= SMALL // 2), "node")
        parts = F.ceil(F.col("n") * 2 / SMALL)
        mass = few.where("label = main").select("node", "id", F.pmod(F.xxhash64("id", "node"), parts).alias("part"))
        others = few.where("label <> main").select("node", "id", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)).alias("part"))
        many = self.scratch.write(told.join(most.where(F.col("others") > SMALL // 2), "node").select("node", "id"), "many")
        return mass.union(others).select(F.xxhash64("node", "part").alias("block"), "id"), many

    def join(self, blocks: DataFrame, all_pairs: bool) -> None:
        """Take in the links among documents of one block (block, id)."""
        told = _labelled(blocks.join(self.short, "id"), self.labels)
        pairs = self.scratch.write(_candidates(told, agreement(self.percent), all_pairs), "pairs")
        links = self.scratch.write(self.confirmed(pairs), "links")
        self.scratch.drop(pairs)
        if links.limit(1).count():
            self.merge(links)
        self.scratch.drop(links)

    def merge(self, links: DataFrame) -> None:
        """Take in links (a, b): only the labels that they join are worked on."""
        if self.labels is None:
            found = components(links, scratch=self.scratch)
            self.labels = self.scratch.write(found, "known")
            return
        ends = links.select(F.col("a").alias("id")).union(links.select("b")).distinct()
        known = self.scratch.write(self.labels.join(ends, "id", "full").select("id", F.coalesce("label", "id").alias("label")), "known")
        a = known.select(F.col("id").alias("a"), F.col("label").alias("la"))
        b = known.select(F.col("id").alias("b"), F.col("label").alias("lb"))
        pairs = links.join(a, "a").join(b, "b").where("la <> lb").select(F.col("la").alias("a"), F.col("lb").alias("b"))
        joined = components(pairs.distinct(), scratch=self.scratch).select(F.col("id").alias("label"), F.col("label").alias("to"))
        after = self.scratch.write(known.join(joined, "label", "left").select("id", F.coalesce("to", "label").alias("label")), "known")
        self.scratch.drop(known, self.labels)
        self.labels = after

    def with_texts(self, rows: DataFrame) -> DataFrame:
        """rows with the text of class id.  A class's text is found by doc_id and a hash of the text."""
        named = self.scratch.write(rows.join(self.classes.select("id", "first", "th"), "id"), "named")
        if named.count() <= MOST_BROADCAST:
            named = F.broadcast(named)
        texts = self.docs.select(F.col("doc_id").cast("long").alias("first"), F.xxhash64("text").alias("th"), "text")
        return texts.join(named, ["first", "th"]).drop("first", "th")

    def confirmed(self, pairs: DataFrame) -> DataFrame:
        """Links a, b: a forest of those pairs that hold on the full sets; every pair is settled by a check or by links around it.

        A pair is checked in its block, where each document comes once.
        """
        width, percent = self.width, self.percent
        one, other = pairs.select("block", F.col("a").alias("id"), F.col("b").alias("with")), pairs.select("block", F.col("b"), F.lit(None).cast("long"))
        members = one.union(other).groupBy("block", "id").agg(F.collect_list("with").alias("with"))

        def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for t in _groups(batches, "block"):
                block, ids, withs = t.column("block").to_numpy(), t.column("id").to_pylist(), t.column("with").to_pylist()
                texts = t.column("text")
                edge = np.append(np.flatnonzero(np.append(True, block[1:] != block[:-1])), len(block))
                a, b = [], []
                for start, stop in zip(edge[:-1].tolist(), edge[1:].tolist()):
                    own = dict(zip(ids[start:stop], shingle_sets(texts[start:stop].to_pylist(), width)))
                    up = {i: i for i in own}

                    def top(i: int) -> int:
                        while up[i] != i:
                            up[i] = i = up[up[i]]
                        return i

                    for k in range(start, stop):
                        for with_ in withs[k]:
                            x, y = top(ids[k]), top(with_)
                            if x != y and alike(own[ids[k]], own[with_], percent):
                                up[x] = y
                                a.append(ids[k])
                                b.append(with_)
                yield _batch(a=(a, pa.int64()), b=(b, pa.int64()))

        dealt = self.with_texts(members).repartition("block").sortWithinPartitions("block", "id")
        return dealt.mapInArrow(check, "a long, b long")


def _classes() -> np.ndarray:
    """The smallest size of each class of set sizes."""
    out = [1]
    while out[-1] < 1 << 31:
        out.append(max(out[-1] + 1, int(out[-1] * STEP)))
    return np.array(out)


def _bit(size_class: int) -> np.uint64:
    """The bit of a class.  Classes 64 apart share one, which only keeps more keys."""
    return U(1) << U(size_class % 64)


def meetings(texts: DataFrame, width: int, percent: int) -> DataFrame:
    """key, side, id: any two of texts (id, text) that reach percent have a key in common, on side 0 both or on sides 1 and 2.

    Sets of x and y shingles at the similarity share at least c = percent (x + y) /
    (100 + percent), so in an order common to all sets, here the rarest first, the first
    x - c + 1 of the one and the first y - c + 1 of the other have one in common.  A
    document has keys for each class of sizes that it can be similar to, and for those
    shingles that another document, one of that class, may have: what each hash bucket of
    shingles is found in is counted, and its classes are kept as bits.
    """
    lows = _classes()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, found = np.zeros(COUNTED, np.int64), np.zeros(COUNTED, U)
        for (some,) in rows_of(batches, "text"):
            for s in shingle_sets(some, width):
                at = (s % U(COUNTED)).astype(np.int64)
                np.add.at(n, at, 1)
                found[at] |= _bit(int(np.searchsorted(lows, len(s), "right")) - 1)
        at = np.flatnonzero(n)
        yield _batch(bucket=(at, pa.int64()), n=(n[at], pa.int64()), classes=(found[at].view(np.int64), pa.int64()))

    counts = texts.mapInArrow(count, "bucket long, n long, classes long").groupBy("bucket")
    several = counts.agg(F.sum("n").alias("n"), F.bit_or("classes").alias("classes")).where("n > 1").toArrow()
    often, within = np.ones(COUNTED, np.int64), np.zeros(COUNTED, U)
    often[several.column("bucket").to_numpy()] = several.column("n").to_numpy()
    within[several.column("bucket").to_numpy()] = several.column("classes").to_numpy().view(U)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, sides, owners, held = [], [], [], 0
        for ids, some in rows_of(batches, "id", "text"):
            for i, s in zip(ids, shingle_sets(some, width)):
                n = len(s)
                if not n:
                    continue
                at = (s % U(COUNTED)).astype(np.int64)
                order = np.lexsort((s, often[at]))
                s, at = s[order], at[order]
                times, classes = often[at], within[at]
                least, most = -(-percent * n // 100), 100 * n // percent
                own, first, last = (int(k) for k in np.searchsorted(lows, (n, least, most), "right") - 1)
                for other in range(first, last + 1):
                    common = -(-percent * (n + max(least, int(lows[other]))) // (100 + percent))
                    head = s[: n - common + 1]
                    size = len(head)
                    head = head[(times[:size] > 1) & ((classes[:size] & _bit(other)) > 0)]  # what no other set of that class has joins nothing
                    if len(head):
                        pair = U(min(own, other) * len(lows) + max(own, other) + 1)
                        keys.append(mixed(head + mixed(np.array([pair], U))))
                        sides.append(np.full(len(head), (other < own) + 1 if other != own else 0))
                        owners.append(np.full(len(head), i))
                        held += len(head)
                if held > 1 << 18:
                    yield _batch(key=(np.concatenate(keys).view(np.int64), pa.int64()), side=(np.concatenate(sides), pa.int32()), id=(np.concatenate(owners), pa.int64()))
                    keys, sides, owners, held = [], [], [], 0
        if held:
            yield _batch(key=(np.concatenate(keys).view(np.int64), pa.int64()), side=(np.concatenate(sides), pa.int32()), id=(np.concatenate(owners), pa.int64()))

    return texts.mapInArrow(run, "key long, side int, id long")


def _able(keys: DataFrame) -> DataFrame:
    """key, side, id, n0, n1, n2 (documents on each side) of keys at which documents can meet."""
    of = [F.count_if(F.col("side") == k).alias(f"n{k}") for k in range(3)]
    return keys.join(keys.groupBy("key").agg(*of).where("n0 > 1 or n1 > 0 and n2 > 0"), "key")


def _met(able: DataFrame, labels: DataFrame | None) -> DataFrame:
    """Those rows of able at whose keys documents of several components meet."""
    sides = _labelled(able.select("key", "id"), labels).groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi"))
    return able.join(sides.where("lo <> hi").select("key"), "key")


def _blocks(met: DataFrame) -> DataFrame:
    """block, id: blocks of about SMALL documents at most, in which all that can meet at a key do."""
    whole = F.col("n0") + F.col("n1") + F.col("n2") <= SMALL
    one = F.lit(1).cast("long")
    parts = [F.when(whole, one).otherwise(F.greatest(one, F.ceil(F.col(f"n{k}") * 2 / SMALL))) for k in range(3)]
    side, part, other = F.col("side"), F.col("part"), F.col("other")
    mine = F.when(side == 0, parts[0]).when(side == 1, parts[1]).otherwise(parts[2])
    theirs = F.when(side == 0, parts[0]).when(side == 1, parts[2]).otherwise(parts[1])
    others = F.explode(F.sequence(F.lit(0).cast("long"), theirs - 1))
    rows = met.select("key", "side", "id", F.pmod(F.xxhash64("id"), mine).alias("part"), others.alias("other"))
    lo = F.when(side == 0, F.least(part, other)).when(side == 1, part).otherwise(other)
    hi = F.when(side == 0, F.greatest(part, other)).when(side == 1, other).otherwise(part)
    return rows.select(F.xxhash64("key", lo, hi).alias("block"), "id")


def class_table(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """id, key, first (the smallest doc_id), th, sketch and short of every distinct set."""
    full = rows.where("key is not null and doc_id is not null")
    least = full.groupBy("key").agg(F.min(F.struct("doc_id", "th", "sketch", "short")).alias("m"))
    named = least.select("key", F.col("m.doc_id").alias("first"), "m.th", "m.sketch", "m.short")
    return scratch.write(named.withColumn("id", F.monotonically_increasing_id()), "classes")


def near_duplicates(docs: DataFrame, width: int = 3, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row of docs (doc_id, text)."""
    short_batches(docs.sparkSession)
    scratch = Scratch(docs.sparkSession, "near-duplicates")
    rows = scratch.write(described(docs, width), "described")
    classes = class_table(rows, scratch)
    search = Search(docs, classes, scratch, width, percent)
    sketch = classes.select("id", "sketch")

    # documents of several sets
    of_doc = rows.where("key is not null and doc_id is not null").select("doc_id", "key").distinct()
    repeated = of_doc.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id")
    sets = of_doc.join(repeated, "doc_id").join(classes.select("key", "id"), "key")
    same = sets.join(sets.groupBy("doc_id").agg(F.min("id").alias("a")), "doc_id").select("a", F.col("id").alias("b")).where("a <> b").distinct()
    same = scratch.write(same, "same")
    if same.limit(1).count():
        search.merge(same)

    # a share of the nodes, in blocks
    nodes = scratch.write(_branched(sketch, START, trees(percent)), "nodes")
    all_nodes = search.several(nodes)
    scratch.drop(nodes)
    search.join(_blocks_of(all_nodes.where(F.pmod(F.xxhash64("node", F.lit("first")), F.lit(FIRST)) == 0)), False)

    # nodes that still hold several components: forests between them
    held = search.several(all_nodes.select("node", "id"))
    scratch.drop(all_nodes)
    search.join(_blocks_of(held), False)

    # then all pairs of different components: in small nodes, in large ones that are nearly one, and in those branched deeper
    level = search.several(held.select("node", "id"))
    scratch.drop(held)
    blocks, tables = [], [level]
    for depth in range(START, DEEPEST + 1):
        blocks.append(level.where(F.col("n") <= SMALL).select(F.col("node").alias("block"), "id"))
        large = level.where(F.col("n") > SMALL)
        few, many = search.parted(large)
        blocks.append(few)
        if depth == DEEPEST:
            break
        dealt = many.join(sketch, "id").repartition("node", "id")  # a large node's rows lie together in few files
        deeper = scratch.write(_branched(dealt, 1, 0), "deeper")
        level = search.several(deeper)
        tables += [many, deeper, level]
    leaves = blocks[0]
    for more in blocks[1:]:
        leaves = leaves.union(more)
    search.join(leaves, True)
    rest = search.several(many)
    scratch.drop(*tables, many)
    if rest.limit(1).count():
        texts = scratch.write(search.with_texts(rest.select("id").distinct()).repartition("id"), "texts")
        every = scratch.write(meetings(texts, width, percent), "keys")
        keys = scratch.write(_able(every), "able")
        scratch.drop(every)
        few = F.col("n0") + F.col("n1") + F.col("n2") <= SMALL
        for size in (few, ~few):  # what the small ones join need not meet at the large ones
            for all_pairs in (False, True):
                met = scratch.write(_blocks(_met(keys, search.labels).where(size)).distinct(), "met")
                search.join(met, all_pairs)
                scratch.drop(met)
        scratch.drop(texts, keys)
    scratch.drop(rest)

    told = _labelled(classes.select("id", "key", "first"), search.labels)
    least = told.groupBy("label").agg(F.min("first").alias("component"))
    of_class = told.join(least, "label").select("key", "component")
    out = rows.select("doc_id", "n_shingles", "key").join(of_class, "key", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    kept = F.coalesce(F.col("doc_id") == component, F.lit(True))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), kept.alias("kept"))
