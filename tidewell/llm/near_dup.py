"""Near duplicates by a chosen-path set similarity join.

Documents with one set of shingles form a class; classes are what is compared.
Every class has 64 minwise tokens and a sketch of four bits of each. A tree puts a
class at the node that two chosen tokens name. A node of which all members are
linked by now is done. A node with few members outside its largest component is
compared exhaustively: those few with all. In any other node members that are like the
most central one are linked to it, so a group of thousands of copies becomes one
component at its first nodes and its pairs are settled. If too many are still apart,
the node branches: each member goes on to the nodes of two more chosen tokens.
Independent trees repeat this until a pair at the threshold is met with the wanted
probability.

Branches hardly part members that are nearly as much alike as linked ones. Nodes of
such members, told by the mean agreement with some of the node, don't branch: they are
joined where they overlap, so that no pair is met twice, and compared exhaustively in
blocks that hold full sets, those outside the largest component with all, which gives a
spanning forest of links instead of pairs. So are nodes at the greatest depth. No path
lists all pairs of a group. All links are confirmed on the full sets.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm.common import discard, give_back, join_checked, materialize, null_safe_key, table, text_batches, text_slices

#: Minwise tokens of a class.
TOKENS = 64
#: Tokens that name a tree's first nodes, branches of a member at a node that is split, and levels of nodes.
ROOT, BRANCHES, MOST_DEPTH = 2, 2, 4
#: A node is compared exhaustively if no more members lie outside its largest component.
FEW = 32
#: Members of a node by which its members' mean agreement is measured.
DRAWN = 8
#: Mean share of tokens in common from which on a node isn't split: below it two branches leave fewer rows than there were.
DENSE = 0.4
#: Sets of a block.
BLOCK = 256
#: Bytes of the longest word that a worker remembers.
LONGEST_KEPT = 64
#: Columns of a sketch.
SKETCH = ("s0", "s1", "s2", "s3")
#: Rows, of a digest and some numbers, that may be broadcast.
FEW_ROWS = 400_000
M64 = np.uint64

_rng = np.random.default_rng(20240101)
_MULTIPLIERS = (_rng.integers(1, 2**32, TOKENS, np.uint64) | M64(1)).astype(np.uint32)
_OFFSETS = _rng.integers(0, 2**32, TOKENS, np.uint64).astype(np.uint32)
_PLACES = _rng.integers(1, 2**63, 64, np.uint64) | M64(1)


def _mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads their bits."""
    h = (h ^ (h >> M64(33))) * M64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> M64(33))) * M64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> M64(33))


class Shingler:
    """Sorted distinct 64-bit hashes of a text's shingles; hashes of words are remembered."""

    def __init__(self, n_words: int) -> None:
        self.n_words, self.known = n_words, {}

    def __call__(self, text: str) -> np.ndarray:
        words = text.encode("utf-8", "surrogatepass").lower().split()  # of bytes: A-Z, and ASCII white space
        known = self.known
        try:
            hashed = [known[w] for w in words]
        except KeyError:
            if len(known) > 200_000:
                known.clear()
            rare: dict[bytes, int] = {}
            for w in words:
                if w not in known:
                    (known if len(w) <= LONGEST_KEPT else rare)[w] = int.from_bytes(hashlib.blake2b(w, digest_size=8).digest(), "little")
            hashed = [known[w] if w in known else rare[w] for w in words]
        h, k = np.array(hashed, M64), self.n_words
        if not len(h):
            return h
        if len(h) < k:
            k = len(h)
        n = len(h) - k + 1
        out = np.full(n, k, M64)
        for i in range(k):
            out += _mixed(h[i : n + i] * _PLACES[i % 64] + M64(i))
        return np.unique(_mixed(out))


def signature(shingles: np.ndarray) -> np.ndarray:
    """The minwise tokens of a non-empty set."""
    base, out = (shingles >> M64(32)).astype(np.uint32), np.full(TOKENS, 2**32 - 1, np.uint32)
    for at in range(0, len(base), 8192):
        part = base[at : at + 8192]
        x = part[None] * _MULTIPLIERS[:, None] + _OFFSETS[:, None]
        x ^= x >> np.uint32(15)
        x *= np.uint32(0x2C1B3C6D)
        x ^= x >> np.uint32(13)
        np.minimum(out, x.min(1), out=out)
    return out


def _sketch(tokens: np.ndarray) -> list[int]:
    """Four bits of each token, in four 64-bit integers."""
    bits = ((tokens * np.uint32(0x9E3779B1)) >> np.uint32(28)).astype(M64).reshape(len(SKETCH), 16)
    return np.bitwise_or.reduce(bits << np.arange(0, 64, 4, dtype=M64), axis=1).view(np.int64).tolist()


def _marks(n_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = Shingler(n_words)
        for part, texts in text_slices(batches, 1):
            counts, digests, tokens, sketches = [], [], [], []
            for text in texts:
                s = shingle(text)
                sig = signature(s) if len(s) else None
                counts.append(len(s))
                digests.append(None if sig is None else hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                tokens.append(None if sig is None else sig.view(np.int32))
                sketches.append([None] * len(SKETCH) if sig is None else _sketch(sig))
            columns = [part.column(0), pa.array(counts, pa.int64()), pa.array(digests, pa.binary()), pa.array(tokens, pa.list_(pa.int32())), *(pa.array(c, pa.int64()) for c in zip(*sketches, strict=True))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_shingles", "digest", "tokens", *SKETCH])

    return run


def _sets(n_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = Shingler(n_words)
        for _, texts in text_slices(batches, 0):
            sets = [s for s in map(shingle, texts) if len(s)]
            yield pa.RecordBatch.from_arrays([pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], ["digest", "shingles"])

    return run


def _linked(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = batch.column(2), batch.column(3)
            hits = []
            for i in range(batch.num_rows):
                x, y = (np.frombuffer(c[i].as_buffer(), M64) for c in (left, right))
                both = np.concatenate([x, y])
                both.sort()
                common = int(np.count_nonzero(both[1:] == both[:-1]))
                if 100 * common >= percent * (len(both) - common):
                    hits.append(i)
            yield batch.select(["a", "b"]).take(pa.array(hits, pa.int64()))

    return run


def _agreeing(x: list[Column], y: list[Column]) -> Column:
    """In how many of the 64 tokens two sketches agree."""
    differ = F.lit(0)
    for a, b in zip(x, y, strict=True):
        z = a.bitwiseXOR(b)
        z = z.bitwiseOR(F.shiftright(z, 1))
        z = z.bitwiseOR(F.shiftright(z, 2))
        differ = differ + F.bit_count(z.bitwiseAND(F.lit(0x1111111111111111)))
    return F.lit(TOKENS) - differ


def _sketch_of(struct: str | None = None) -> list[Column]:
    return [F.col(f"{struct}.{c}" if struct else c) for c in SKETCH]


def least_alike(percent: int) -> int:
    """Tokens of 64 in which four bits agree for linked sets, but for about one pair in a million of those at the threshold."""
    p = percent / 100 + (1 - percent / 100) / 16
    return max(0, math.floor(TOKENS * p - 5 * math.sqrt(TOKENS * p * (1 - p))))


def trees_for(percent: int, missed: float = 1e-5) -> int:
    """Trees in which a pair at the threshold meets at least once, but for the probability missed.

    Trees begin with tokens of their own, so their first nodes are independent; a
    pair that goes on is lost at a node if it shares none of the branches' tokens.
    """
    p, stays = percent / 100, 1.0
    for _ in range(MOST_DEPTH - 1):
        stays = 1 - (1 - p * stays) ** BRANCHES
    return min(TOKENS // ROOT, math.ceil(math.log(missed) / math.log(1 - p**ROOT * stays)))


def _verified(docs: DataFrame, classes: DataFrame, pairs: DataFrame, percent: int, n_words: int, label: str) -> DataFrame:
    """The pairs (a, b) of digests whose full sets are linked. docs: doc_id, text."""
    pairs = materialize(pairs, f"{label}-pairs")
    if pairs.isEmpty():
        return pairs
    sized = classes.select("digest", "n_shingles", "first_id")
    ends = pairs.select(F.col("a").alias("digest")).unionByName(pairs.select(F.col("b").alias("digest"))).distinct()
    wanted = materialize(ends.join(sized, "digest").select(*null_safe_key("first_id")).distinct(), f"{label}-wanted")
    texts = join_checked(docs.select("text", *null_safe_key("doc_id")), wanted, ["_key_null", "_key"], "left_semi")
    sets = materialize(text_batches(texts.select("text")).mapInArrow(_sets(n_words), "digest binary, shingles binary"), f"{label}-sets")
    left = sets.select(F.col("digest").alias("a"), F.col("shingles").alias("x"))
    right = sets.select(F.col("digest").alias("b"), F.col("shingles").alias("y"))
    met = pairs.join(left, "a").join(right, "b")
    links = materialize(met.select("a", "b", "x", "y").mapInArrow(_linked(percent), "a binary, b binary").distinct(), f"{label}-links")
    discard(pairs, wanted, sets)
    return links


def connected(links: DataFrame) -> DataFrame:
    """Rows (node, root) of all nodes in links (a, b): root is the same within a component, and one of its nodes.

    Every node points to its least neighbour if that is less than itself; pointers
    are doubled, links are moved to where their ends point, and that repeats
    until no link is left. Nodes should be digests or other well-mixed keys: then a
    path shrinks by a factor each time, however long it is. A component of any size
    is spread over tasks.
    """
    left = materialize(links.select("a", "b").where(F.col("a") != F.col("b")), "cc-links")
    ends = left.select(F.col("a").alias("node")).unionByName(left.select(F.col("b").alias("node"))).distinct()
    labels = materialize(ends.withColumn("root", F.col("node")), "cc-labels")
    while not left.isEmpty():
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        to = both.groupBy("a").agg(F.min("b").alias("least")).select(F.col("a").alias("node"), F.least("a", "least").alias("to"))
        onward = to.select(F.col("node").alias("to"), F.col("to").alias("next"))
        to = materialize(to.join(onward, "to").select("node", F.col("next").alias("to")), "cc-pointers")

        def moved(rows: DataFrame, column: str, to: DataFrame = to) -> DataFrame:
            met = rows.join(to.select(F.col("node").alias(column), F.col("to").alias("_to")), column, "left")
            return met.withColumn(column, F.coalesce("_to", column)).drop("_to")

        labels = materialize(moved(labels, "root"), "cc-labels")
        before = left
        left = moved(moved(left, "a"), "b").where(F.col("a") != F.col("b"))
        left = materialize(left.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "cc-links")
        discard(before, to)
    return labels.select("node", "root")


def _forest(percent: int):
    """Links of a block: of every pair of documents whose sets are linked, or of different blocks if the block is of two."""

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        seen: dict[bytes, int] = {}
        digests = table.column("digest").to_pylist()
        rows = [i for i, d in enumerate(digests) if seen.setdefault(d, i) == i]
        sets = [np.frombuffer(table.column("shingles")[i].as_buffer(), M64) for i in rows]
        sizes = np.array([len(x) for x in sets], np.int64)
        owner = np.repeat(np.arange(len(sets)), sizes)
        _, column, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        shared = np.cumsum(counts > 1) - 1
        keep = counts[column] > 1
        owner, column = owner[keep], shared[column[keep]]
        order = np.argsort(column, kind="stable")
        owner, column = owner[order], column[order]
        common = np.zeros((len(sets), len(sets)), np.float32)
        for low in range(0, int(column[-1]) + 1 if len(column) else 0, 8192):
            part = slice(*np.searchsorted(column, [low, low + 8192]))
            held = np.zeros((len(sets), 8192), np.float32)
            held[owner[part], column[part] - low] = 1
            common += held @ held.T
        both = common.astype(np.int64)
        linked = 100 * both >= percent * (sizes[:, None] + sizes[None] - both)
        root = np.full(len(sets), -1)
        found: list[tuple[bytes, bytes]] = []
        for start in range(len(sets)):
            if root[start] >= 0:
                continue
            root[start], edge = start, [start]
            while edge:
                i = edge.pop()
                for j in np.flatnonzero(linked[i] & (root < 0)):
                    root[j] = start
                    edge.append(j)
                    found.append((digests[rows[i]], digests[rows[j]]))
        give_back()
        return pa.table({"a": pa.array([x[0] for x in found], pa.binary()), "b": pa.array([x[1] for x in found], pa.binary())})

    return run


def _clustered_sets(n_words: int):
    """Sets of texts (text, digest, then numbers that are kept) whose digest is the one given."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = Shingler(n_words)
        for part, texts in text_slices(batches, 0):
            sets = [shingle(t).tobytes() for t in texts]
            same = [hashlib.blake2b(s, digest_size=16).digest() == d for s, d in zip(sets, part.column(1).to_pylist(), strict=True)]
            rows = pa.RecordBatch.from_arrays([pa.array(sets, pa.binary()), *part.columns[1:]], ["shingles", *part.schema.names[1:]])
            yield rows.filter(pa.array(same))

    return run


def _block_links(docs: DataFrame, classes: DataFrame, rows: DataFrame, size: int, percent: int, n_words: int) -> DataFrame:
    """Links (a, b) that join the linked classes of each part, but for pairs of which neither is outside.

    docs: doc_id, text. rows: digest, part, n, outside (classes of the part, and those
    outside), out (whether the class is one of these). Blocks of classes outside meet
    all blocks; a class may be in several parts.
    """
    out, g = F.ceil(F.col("outside") / size).cast("int"), F.ceil((F.col("n") - F.col("outside")) / size).cast("int")
    mixed = F.xxhash64("digest")
    own = F.when(F.col("out"), F.pmod(mixed, out)).otherwise(out + F.pmod(mixed, g)).cast("int").alias("own")
    met = F.when(F.col("out"), out + g).otherwise(out).alias("met")
    few = FEW_ROWS if rows.count() <= FEW_ROWS else 0
    places = rows.select("digest", F.struct("part", own, met).alias("place")).groupBy("digest").agg(F.collect_list("place").alias("places"))
    wanted = places.join(classes.select("digest", "first_id"), "digest")
    wanted = materialize(wanted.select(*null_safe_key("first_id"), "digest", "places"), "near-wanted")
    texts = join_checked(docs.select("text", *null_safe_key("doc_id")), wanted, ["_key_null", "_key"], "inner", few)
    sets = text_batches(texts.select("text", "digest", "places")).mapInArrow(_clustered_sets(n_words), "shingles binary, digest binary, places array<struct<part: long, own: int, met: int>>")
    placed = sets.select("shingles", "digest", F.explode("places").alias("place")).select("shingles", "digest", "place.*")
    dealt = placed.select("shingles", "digest", "part", "own", F.explode(F.sequence(F.lit(0), F.col("met") - 1)).alias("other"))
    dealt = dealt.select("shingles", "digest", "part", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    links = materialize(dealt.groupBy("part", "i", "j").applyInArrow(_forest(percent), "a binary, b binary"), "near-links")
    discard(wanted)
    return links


MEMBER = ("digest", "node", "size", *SKETCH)


def _first_nodes(classes: DataFrame, n_trees: int) -> DataFrame:
    """Rows MEMBER of the classes that share a tree's first node with another class."""
    paths = F.array(*[F.xxhash64(F.lit(t), *[F.element_at("tokens", ROOT * t + k + 1) for k in range(ROOT)]) for t in range(n_trees)])
    nodes = classes.select(F.explode(paths).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1).select("node")
    nodes = materialize(nodes, "tree-shared")
    rows = classes.select("digest", F.col("n_shingles").cast("int").alias("size"), *SKETCH, F.explode(paths).alias("node"))
    rows = materialize(join_checked(rows, nodes, ["node"], "left_semi").select(*MEMBER), "tree-rows")
    discard(nodes)
    return rows


def _with_nodes(rows: DataFrame, comps: DataFrame | None) -> DataFrame:
    """Rows of nodes with several components, with comp, and n, major and outside of the node: members, largest component, members not in it.

    comps: (digest, comp) of linked classes; any other class is a component of its own.
    """
    own = F.xxhash64("digest")
    rows = rows.withColumn("comp", own) if comps is None else rows.join(comps, ["digest"], "left").withColumn("comp", F.coalesce("comp", own))
    counts = rows.groupBy("node", "comp").agg(F.count(F.lit(1)).alias("n"))
    nodes = counts.groupBy("node").agg(F.sum("n").alias("n"), F.max(F.struct("n", "comp")).alias("top"))
    nodes = nodes.select("node", "n", F.col("top.comp").alias("major"), (F.col("n") - F.col("top.n")).alias("outside")).where(F.col("outside") > 0)
    nodes = materialize(nodes, "tree-nodes")
    # A join alone in its stage, so that a node with a large part of all rows can be split among tasks.
    met = materialize(rows.join(nodes, "node"), "tree-met")
    discard(nodes)
    return met


def _sizes_fit(x: Column, y: Column, percent: int) -> Column:
    """Whether sets of these sizes can be linked at all."""
    return 100 * F.least(x, y) >= percent * F.greatest(x, y)


def _small_pairs(met: DataFrame, least: int, percent: int) -> DataFrame:
    """Pairs (a, b) of small nodes: those outside the largest component with all members of other components whose sketches are alike."""
    small = met.where(F.col("outside") <= FEW)
    others = small.where(F.col("comp") != F.col("major")).groupBy("node").agg(F.collect_list(F.struct("digest", "comp", "size", *SKETCH)).alias("others"))
    others = materialize(others, "tree-others")

    def fits(x: Column) -> Column:
        # Two that are both among the others would meet twice.
        once = (F.col("comp") == F.col("major")) | (F.col("digest") < x["digest"])
        return (x["comp"] != F.col("comp")) & once & _sizes_fit(x["size"], F.col("size"), percent) & (_agreeing(_sketch_of(), [x[c] for c in SKETCH]) >= least)

    pairs = small.join(others, "node").select("digest", F.explode(F.filter("others", fits)).alias("x"))
    return pairs.select(F.least("digest", "x.digest").alias("a"), F.greatest("digest", "x.digest").alias("b"))


def _drawn(met: DataFrame) -> DataFrame:
    """Members of large nodes with density, the node's mean agreement with DRAWN members, and centre, the member whose own mean is highest."""
    large = met.where(F.col("outside") > FEW)
    draws = [F.min(F.struct(F.xxhash64("node", "digest", F.lit(k)), *SKETCH)).alias(f"x{k}") for k in range(DRAWN)]
    hubs = materialize(large.groupBy("node").agg(*draws), "tree-drawn")
    total = sum((_agreeing(_sketch_of(), _sketch_of(f"x{k}")) for k in range(DRAWN)), F.lit(0))
    told = large.join(hubs, "node").withColumn("mean", total / F.lit(float(DRAWN * TOKENS))).drop(*[f"x{k}" for k in range(DRAWN)])
    told = materialize(told, "tree-told")
    centres = materialize(told.groupBy("node").agg(F.max(F.struct("mean", "digest", "comp", "size", *SKETCH)).alias("centre"), F.avg("mean").alias("density")), "tree-centres")
    out = materialize(told.join(centres, "node"), "tree-large")
    discard(hubs, told, centres)
    return out


def _star_pairs(drawn: DataFrame, least: int, percent: int) -> DataFrame:
    """Pairs (a, b): every member with the one centre that it is most like, of the nodes it is in."""
    like = drawn.where((F.col("comp") != F.col("centre.comp")) & _sizes_fit(F.col("size"), F.col("centre.size"), percent))
    like = like.select("digest", F.struct(_agreeing(_sketch_of(), _sketch_of("centre")).alias("agree"), F.col("centre.digest").alias("hub")).alias("best")).where(F.col("best.agree") >= least)
    like = like.groupBy("digest").agg(F.max("best").alias("best"))
    return like.select(F.least("digest", "best.hub").alias("a"), F.greatest("digest", "best.hub").alias("b"))


def _cores(rows: DataFrame, comps: DataFrame | None) -> DataFrame:
    """Parts for _block_links() of rows (digest, node): nodes that share members are one part."""
    edges = rows.select(F.col("digest").alias("a"), F.unhex(F.hex("node")).alias("b"))
    parts = connected(edges).select(F.col("node").alias("digest"), F.xxhash64("root").alias("part"))
    members = rows.select("digest").distinct().join(parts, "digest").withColumnRenamed("part", "node")
    met = _with_nodes(members.select("digest", "node"), comps)
    return met.select("digest", F.col("node").alias("part"), "n", "outside", (F.col("comp") != F.col("major")).alias("out"))


def _branched(large: DataFrame, classes: DataFrame) -> DataFrame:
    """Rows MEMBER of the children: by BRANCHES tokens that the node chooses."""
    tokens = classes.select(F.col("digest").alias("_digest"), "tokens")
    met = large.select(*MEMBER).join(tokens, F.col("digest") == F.col("_digest"))

    def child(j: int) -> Column:
        chosen = (F.pmod(F.xxhash64("node", F.lit(j)), F.lit(TOKENS)) + 1).cast("int")
        return F.xxhash64("node", F.lit(j), F.element_at("tokens", chosen))

    return met.select("digest", "size", *SKETCH, F.explode(F.array(*map(child, range(BRANCHES)))).alias("node")).select(*MEMBER)


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


def _components(links: list[DataFrame]) -> DataFrame:
    """Rows (digest, comp) of all classes with links."""
    return materialize(connected(_union(links)).select(F.col("node").alias("digest"), F.xxhash64("root").alias("comp")), "tree-comps")


def chosen_path_links(docs: DataFrame, classes: DataFrame, percent: int, n_words: int, n_trees: int) -> DataFrame:
    """Links (a, b) of digests that join all classes whose sets are linked. docs: doc_id, text; classes are materialised."""
    least, links, comps, cores = least_alike(percent), [], None, []
    rows = _first_nodes(classes, n_trees)
    for depth in range(MOST_DEPTH + 1):  # after the last, only nodes with few outside are left
        met = _with_nodes(rows, comps)
        crowded = not met.where(F.col("outside") > FEW).isEmpty()
        pairs = _small_pairs(met, least, percent)
        if crowded:
            drawn = _drawn(met)
            pairs = pairs.unionByName(_star_pairs(drawn, least, percent))
        found = _verified(docs, classes, pairs.distinct(), percent, n_words, "tree")
        if not found.isEmpty():
            links.append(found)
            if not depth:  # links only settle pairs, and most are found at once
                comps = _components(links)
        discard(rows, met)
        if not crowded:
            break
        # Links may have settled a node, or left few outside; such nodes aren't split.
        again = drawn if depth or comps is None else _with_nodes(drawn.select(*MEMBER, "density"), comps)
        large, last = again.where(F.col("outside") > FEW), F.lit(depth + 1 >= MOST_DEPTH)
        cores.append(large.where((F.col("density") >= DENSE) | last).select("digest", "node"))
        settling = again.where(F.col("outside") <= FEW).select(*MEMBER)
        rows = materialize(settling.unionByName(_branched(large.where((F.col("density") < DENSE) & ~last), classes)), "tree-rows")
    if cores and not _union(cores).isEmpty():
        links.append(_block_links(docs, classes, materialize(_cores(_union(cores), comps), "tree-parts"), BLOCK, percent, n_words))
    if not links:
        return docs.sparkSession.createDataFrame([], "a binary, b binary")
    return _union(links)


def near_duplicates(docs: DataFrame, percent: int = 75, n_words: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, n_shingles, component_id, kept) of docs linked by similar sets of shingles.

    Two documents are linked if 100 * intersection >= percent * union of their sets of
    distinct shingles of n_words lower-cased words; with fewer words the whole
    sequence is one shingle. component_id is the smallest id reachable by links, the
    document's own included; kept tells whether a row has that id. Null and texts
    without words have no shingle and stand alone. Repeated rows have one set, so they
    are linked, and each gives a row; rows that repeat the smallest id are all kept. A
    null id is never the smallest: it takes part in links, its component is null only
    if no document of it has an id, and then it is kept. An empty table gives an empty
    result. Only the two columns named are read, so other columns never clash.
    """
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    marks = materialize(text_batches(slim).mapInArrow(_marks(n_words), "doc_id long, n_shingles long, digest binary, tokens array<int>, " + ", ".join(f"{c} long" for c in SKETCH)), "near-marks")
    firsts = [F.any_value(c).alias(c) for c in ("n_shingles", "tokens", *SKETCH)]
    classes = materialize(marks.where(F.col("digest").isNotNull()).groupBy("digest").agg(F.min("doc_id").alias("first_id"), *firsts), "near-classes")
    links = chosen_path_links(slim, classes, percent, n_words, trees_for(percent))
    roots = connected(links).select(F.col("node").alias("digest"), "root")
    linked = materialize(classes.select("digest", "first_id").join(roots, "digest"), "near-linked")
    discard(classes)
    least_ids = linked.groupBy("root").agg(F.min("first_id").alias("_least"))
    named = linked.join(least_ids, "root").select("digest", "_least")
    # Only classes of several rows or with links can have another's id.
    repeated = marks.where(F.col("digest").isNotNull()).groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_id")).where(F.col("n") > 1)
    known = repeated.select("digest", "first_id").join(named, "digest", "full").select("digest", F.coalesce("_least", "first_id").alias("_least"))
    out = marks.select("doc_id", "n_shingles", "digest").join(known, "digest", "left")
    out = out.withColumn("component_id", F.coalesce("_least", "doc_id"))
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def op1_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of whole documents, at five words and 75 percent."""
    return near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"))


#: The same rows in DuckDB.
OP1_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), starts AS (
  SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, least(len(w), 1)) + 1)) AS i FROM words
), shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM starts
), sizes AS (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), common AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2
), links AS (
  SELECT x, y FROM common JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * c >= 75 * (p.n + q.n - c)
), both_ways AS (
  SELECT x, y FROM links UNION ALL SELECT y, x FROM links
), reach AS (
  SELECT doc_id AS x, doc_id AS y FROM documents
  UNION
  SELECT reach.x, both_ways.y FROM reach JOIN both_ways ON both_ways.x = reach.y
), least AS (
  SELECT x AS doc_id, min(y) AS component_id FROM reach GROUP BY x
)
SELECT documents.doc_id, coalesce(sizes.n, 0)::BIGINT AS n_shingles, component_id, documents.doc_id = component_id AS kept
FROM documents JOIN least USING (doc_id) LEFT JOIN sizes USING (doc_id)
"""
