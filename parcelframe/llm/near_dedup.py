"""Near-duplicate groups by a chosen-path set similarity join over word shingles.

Documents whose sets of 5-word shingles have a Jaccard similarity of 0.75 or
more are linked; a group is a connected component.

* Sketch: one pass gives each text its set's fingerprint, its size and
  ``TOKENS`` minwise tokens. Equal sets are one class from there on, so copies
  cost a row each and nothing more.
* Trees: a node branches its documents by their tokens at ``BRANCH`` randomly
  chosen positions. A pair of similarity s shares a branch with probability s at
  each; there are ``TREES`` trees. Nodes of at most ``LEAF``
  documents are leaves; larger ones branch again. All trees read the same
  ``TOKENS`` tokens; counted over those, a pair at 0.75 is missed with 6e-8 in
  leaves under a root, 1.2e-5 one level lower, 6.4e-5, 1.6e-4 and 2.9e-4 at levels
  3 to 5 and 4.4e-4 at the last, level 6.
* Partners: in a leaf, only documents with a partner that shares enough tokens
  go on (a common passage brings many documents into a node, few of them close).
* Sets: the texts of those classes are read again (a bounded Bloom filter keeps
  the rest out of the shuffle). Their smallest
  ``LOW`` shingle hashes estimate similarities inside nodes, exactly for sets
  of that size and with a standard error under 0.023 beyond.
* Leaves: documents are compared exhaustively by those estimates; pairs within
  4.5 standard errors of 0.75 are decided on the full sets. As groups are
  wanted, a first round takes a spanning forest of each leaf, best estimates
  first; after those links are checked, a second round takes all pairs between
  different groups. No link between two groups is lost, and a cluster of m
  copies gives about m pairs, not m squared.
* Only classes with ``ENOUGH`` tokens that other classes have too enter the trees;
  the others have no partner.
* Nodes that are large after ``LEVELS`` levels are dealt into sub-blocks that share
  pivots before they branch. Those that then still hold several groups are
  compared block by block, all of the smaller groups' members with all members,
  where that is cheap, and branch again where it isn't. Nodes of one group are
  closed.

Defined results: null and empty texts, and texts of white space, have no
shingles and are their own group; a text of fewer than five words is one
shingle, its whole sequence; repeated rows share a class; null ids never win a
group's smallest id; other columns are ignored. ``keep_one`` leaves one row of
each group also where ids don't tell its documents apart.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import bloom, textarrays as T
from .common import stored

WORDS, TOKENS, LOW = 5, 32, 384
TREES, BRANCH, LEAF, LEVELS, DEPTH, PIVOTS = 6, 2, 512, 1, 6, 4
#: Members of a leaf up to which a hash counts as rare.
FEW = 16
#: Common tokens of TOKENS that a pair at 0.75 has but once in a hundred thousand times.
ENOUGH = 13
#: A large node of several groups is compared by blocks if that takes at most so many comparisons.
CHEAP = 8 * LEAF * LEAF

_rng = np.random.default_rng(97)
_WEIGHTS = _rng.integers(1, 1 << 62, WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MULTIPLY = _rng.integers(1, 1 << 62, TOKENS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(0, 1 << 63, TOKENS, dtype=np.uint64)


def shingles(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(shingle hashes of all texts, sorted and distinct within each; number of each text)."""
    h, count = T.word_hashes(texts, T.NONSPACE)
    n = np.where(count >= WORDS, count - WORDS + 1, np.minimum(count, 1))
    doc = np.repeat(np.arange(len(count)), n)
    first = np.repeat(np.cumsum(count) - count, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    room = count[doc]
    s = np.minimum(room, WORDS).astype(np.uint64)  # a shorter sequence never equals a shingle
    padded = np.concatenate([h, np.zeros(WORDS, np.uint64)])
    for k in range(WORDS):
        s = s + np.where(room > k, padded[first + k] * _WEIGHTS[k], np.uint64(0))
    s = T.mix(s)
    order = np.lexsort((s, doc))
    s, doc = s[order], doc[order]
    fresh = np.ones(len(s), bool)
    fresh[1:] = (s[1:] != s[:-1]) | (doc[1:] != doc[:-1])
    return s[fresh], np.bincount(doc[fresh], minlength=len(count))


def _parts(texts: pa.Array, rows: int = 256) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Shingles of slices of a batch, so that a batch's sets are never held at once."""
    for k in range(0, len(texts), rows):
        s, n = shingles(texts.slice(k, rows))
        yield k, s, n


def fingerprints(s: np.ndarray, n: np.ndarray) -> list[bytes | None]:
    edge = np.concatenate([[0], np.cumsum(n)])
    data = s.astype("<u8").tobytes()
    return [hashlib.blake2b(data[8 * edge[i]:8 * edge[i + 1]], digest_size=16).digest() if n[i] else None for i in range(len(n))]


def sketch(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, n_shingles, set, tokens) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k, s, n in _parts(b.column("text")):
                full = np.flatnonzero(n)
                tokens = np.zeros((len(n), TOKENS), np.int32)
                if len(full):
                    first = (np.cumsum(n) - n)[full]
                    for t in range(TOKENS):
                        least = np.minimum.reduceat(s * _MULTIPLY[t] + _ADD[t], first)
                        tokens[full, t] = (least >> np.uint64(32)).astype(np.uint32).view(np.int32) ^ (least & np.uint64(0xFFFFFFFF)).astype(np.uint32).view(np.int32)
                own = b.slice(k, len(n))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, (len(n) + 1) * TOKENS, TOKENS), pa.int32()), pa.array(tokens.ravel()))
                yield pa.record_batch([own.column("doc_id"), own.column("text_key"), pa.array(n, pa.int64()),
                                       pa.array(fingerprints(s, n), pa.binary()), lists],
                                      ["doc_id", "text_key", "n_shingles", "set", "tokens"])

    rows = docs.select("doc_id", "text", bloom.text_key(F.col("text")).alias("text_key"))
    return rows.mapInArrow(run, "doc_id long, text_key long, n_shingles long, set binary, tokens array<int>")


def sharing(classes: DataFrame) -> DataFrame:
    """The classes with ENOUGH tokens that other classes have too, wherever; the others have no partner."""
    spot = F.transform(F.sequence(F.lit(0), F.lit(TOKENS - 1)), lambda c: F.xxhash64(c, F.element_at("tokens", c + 1)))
    own = classes.select(F.xxhash64("set").alias("who"), F.explode(spot).alias("spot"))
    common = own.groupBy("spot").agg(F.count("*").alias("k")).where("k > 1").select("spot")
    enough = own.join(common, "spot", "left_semi").groupBy("who").agg(F.count("*").alias("k")).where(F.col("k") >= ENOUGH)
    return classes.join(enough, F.xxhash64("set") == F.col("who"), "left_semi")


def _counted(rows: DataFrame) -> DataFrame:
    """Rows of nodes with two members or more, with the node's size; one of several leaves of the same members.

    Large nodes all stay: each branches on positions of its own."""
    who = [F.sum(F.shiftright(F.xxhash64("set"), 20)).alias("who"), F.bit_xor(F.xxhash64("set")).alias("who2")]
    size = rows.groupBy("node").agg(F.count("*").alias("n"), *who)
    own = F.when(F.col("n") > LEAF, F.col("node"))
    one = size.where("n > 1").groupBy("n", "who", "who2", own.alias("own")).agg(F.min("node").alias("node")).select("node", "n")
    return rows.join(one, "node")


def roots(classes: DataFrame) -> DataFrame:
    """(node, n, set, tokens) of the nodes under all trees' roots that hold two classes or more."""
    spot = F.transform(F.sequence(F.lit(0), F.lit(TREES * BRANCH - 1)), lambda c: F.xxhash64(c, F.element_at("tokens", c + 1)))
    rows = _counted(classes.select("set", F.explode(spot).alias("node")))
    return stored(rows.join(classes.select("set", "tokens"), "set"), "nodes")


def branches(large: DataFrame) -> DataFrame:
    """The nodes one level below ``large`` ones, with the same columns."""
    chosen = F.transform(F.sequence(F.lit(0), F.lit(BRANCH - 1)), lambda c: F.xxhash64(
        "node", c, F.element_at("tokens", F.pmod(F.xxhash64("node", c), F.lit(TOKENS)).cast("int") + 1)))
    return _counted(large.drop("n").withColumn("node", F.explode(chosen))).select(*large.columns)


def trees(classes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(leaves, nodes that are still large after LEVELS levels), both (node, n, set, tokens)."""
    rows, leaves = roots(classes), None
    for level in range(1, LEVELS + 1):
        leaf, large = rows.where(F.col("n") <= LEAF), rows.where(F.col("n") > LEAF)
        leaves = leaf if leaves is None else leaves.unionByName(leaf)
        if level == LEVELS or large.isEmpty():
            return leaves, large
        rows = stored(branches(large), "nodes")
    raise AssertionError


def by_node(rows: DataFrame, solve: Callable[[list[tuple]], list[tuple]], schema: pa.Schema, ddl: str) -> DataFrame:
    """Apply ``solve`` to the rows of each node (first column); a task holds one node at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, held = None, []

        def record(found: list[tuple]) -> pa.RecordBatch:
            return pa.record_batch([pa.array([r[k] for r in found], f.type) for k, f in enumerate(schema)], schema=schema)

        for b in batches:
            out: list[tuple] = []
            columns = []
            for c in b.columns:
                if pa.types.is_list(c.type):
                    edge, values = c.offsets.to_numpy(), c.values.to_numpy()
                    columns.append([values[i:j] for i, j in zip(edge[:-1], edge[1:])])
                else:
                    columns.append(c.to_pylist())
            for row in zip(*columns):
                if row[0] != node:
                    out += solve(held) if len(held) > 1 else []
                    node, held = row[0], []
                held.append(row)
            yield record(out)
        yield record(solve(held) if len(held) > 1 else [])

    return rows.repartition("node").sortWithinPartitions("node").mapInArrow(run, ddl)


def partnered(rows: DataFrame) -> DataFrame:
    """The rows (node, set, tokens, label) whose node holds a member of another label with ENOUGH tokens in common."""

    def solve(held: list[tuple]) -> list[tuple]:
        tokens = np.array([r[2] for r in held])
        same = np.zeros((len(held), len(held)), np.int16)
        for t in range(TOKENS):
            same += tokens[:, t, None] == tokens[None, :, t]
        _, label = np.unique([r[3] for r in held], return_inverse=True)
        same[label[:, None] == label[None, :]] = 0
        return [held[i] for i in np.flatnonzero(same.max(1) >= ENOUGH)]

    schema = pa.schema([("node", pa.int64()), ("set", pa.binary()), ("tokens", pa.list_(pa.int32())), ("label", pa.binary())])
    return by_node(rows.select("node", "set", "tokens", "label"), solve, schema, "node long, set binary, tokens array<int>, label binary")


def estimates(low: list[np.ndarray], size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(similarity, least similarity that needs a check) of all pairs, from the sets' smallest hashes.

    All common hashes of two lists lie under the smaller of their maxima; up to
    there both sets are known, so common over united is an unbiased estimate."""
    m = len(low)
    length = np.array([len(x) for x in low])
    flat, member = np.concatenate(low), np.repeat(np.arange(m), length)
    _, token, seen = np.unique(flat, return_inverse=True, return_counts=True)
    common = np.zeros(m * m)
    # hashes that few members hold are counted pair by pair, the others by a matrix product
    few = np.flatnonzero((seen[token] > 1) & (seen[token] <= FEW))
    few = few[np.argsort(token[few], kind="stable")]
    for step in range(1, FEW):  # members come in order within a hash, so each pair is met once
        same = token[few[step:]] == token[few[:-step]] if len(few) > step else np.zeros(0, bool)
        if not same.any():
            break
        common += np.bincount(member[few[:-step]][same] * m + member[few[step:]][same], minlength=m * m)
    common = common.reshape(m, m)
    common = common + common.T
    many = seen[token] > FEW
    _, column = np.unique(token[many], return_inverse=True)
    has = np.zeros((m, int(column.max(initial=-1)) + 1), np.float32)
    has[member[many], column] = 1
    common += np.rint(has @ has.T)
    whole = length >= size  # the whole set is in the list
    top = np.where(whole, np.int64(1) << 40, [int(x[-1]) for x in low])
    under = np.stack([np.searchsorted(x, np.minimum(top, t), "right") for x, t in zip(low, top)])  # [i, j]: of i's up to both tops
    united = under + under.T - common
    s = common / np.maximum(united, 1)
    total = np.maximum(size[:, None] + size[None, :], 1) / 1.75  # of the union, for similar sets
    error = np.sqrt(0.1875 / np.maximum(united, 1) * np.clip(1 - united / total, 0, 1))
    error[whole[:, None] & whole[None, :]] = 0
    return s, 0.75 - 4.5 * error - 2 / np.maximum(united, 1)


def _pairs(low: list[np.ndarray], size: np.ndarray, label: list, every: bool) -> list[tuple[int, int]]:
    """Candidate pairs of one leaf: all between different labels, or a spanning forest of them, best estimates first."""
    s, least = estimates(low, size)
    a, b = np.nonzero(np.triu(s >= least, 1))
    if every:
        return [(i, j) for i, j in zip(a.tolist(), b.tolist()) if label[i] != label[j]]
    order = np.argsort(-s[a, b], kind="stable")
    top, out = list(range(len(low))), []

    def root(x: int) -> int:
        while top[x] != x:
            top[x] = x = top[top[x]]
        return x

    for i, j in zip(a[order].tolist(), b[order].tolist()):
        x, y = root(i), root(j)
        if x != y:
            top[x] = y
            out.append((i, j))
            if len(out) == len(low) - 1:
                break
    return out


def candidates(rows: DataFrame, sets: DataFrame, every: bool) -> DataFrame:
    """Distinct (a, b) of sets, a < b, from rows (node, set, label); nodes are bounded."""

    def solve(held: list[tuple]) -> list[tuple]:
        found = _pairs([r[4] for r in held], np.array([r[3] for r in held]), [r[2] for r in held], every)
        return [(min(held[i][1], held[j][1]), max(held[i][1], held[j][1])) for i, j in found]

    # the upper 32 bits of a set's smallest hashes, moved to signed order (the set is kept in unsigned order)
    low = sets.select("set", F.size("shingles").alias("n_set"),
                      F.transform(F.slice("shingles", 1, LOW), lambda x: (F.shiftrightunsigned(x, 32) - F.lit(1 << 31)).cast("int")).alias("low"))
    full = rows.select("node", "set", "label").join(low, "set").select("node", "set", "label", "n_set", "low")
    schema = pa.schema([("a", pa.binary()), ("b", pa.binary())])
    return by_node(full, solve, schema, "a binary, b binary").where("a != b").distinct()


def sub_blocks(large: DataFrame) -> DataFrame:
    """Large nodes dealt into blocks of about LEAF members that share the node's pivots."""
    blocks = F.ceil(F.col("n") / (LEAF - PIVOTS)).cast("int")
    order = Window.partitionBy("node").orderBy(F.xxhash64("set"))
    pivot = large.withColumn("k", F.row_number().over(order)).where(F.col("k") <= PIVOTS).drop("k")
    spread = pivot.withColumn("block", F.explode(F.sequence(F.lit(0), blocks - 1)))
    own = large.withColumn("block", F.pmod(F.xxhash64("set", F.lit(1)), blocks).cast("int"))
    both = own.unionByName(spread).select(F.xxhash64("node", "block").alias("node"), "set", "tokens")
    return both.dropDuplicates(["node", "set"])


def mixed(rows: DataFrame) -> DataFrame:
    """Rows of nodes that hold several labels, with the most common one and how many members have others."""
    sizes = rows.groupBy("node", "label").agg(F.count("*").alias("k"))
    main = (sizes.groupBy("node").agg(F.max_by("label", F.struct("k", "label")).alias("main"),
                                      (F.sum("k") - F.max("k")).alias("others")).where("others > 0"))
    return rows.join(main, "node")


def cross_blocks(rows: DataFrame) -> DataFrame:
    """Mixed nodes as blocks in which each member outside the node's most common label meets every member."""
    left = F.ceil(F.col("others") / LEAF).cast("int")
    right = F.ceil(F.col("n") / LEAF).cast("int")
    mine = lambda parts: F.pmod(F.xxhash64("set", F.lit(2)), parts).cast("int")
    others = (rows.where("label != main").withColumn("i", mine(left)).withColumn("j", F.explode(F.sequence(F.lit(0), right - 1))))
    members = rows.withColumn("j", mine(right)).withColumn("i", F.explode(F.sequence(F.lit(0), left - 1)))
    both = others.unionByName(members).select(F.xxhash64("node", "i", "j").alias("node"), "set", "tokens", "label")
    return both.dropDuplicates(["node", "set"])


def full_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(set, shingles) of the classes in ``wanted`` (set, doc_id), read from the texts again."""
    n = wanted.count()
    blocks = bloom.blocks_for(n)
    held = bloom.build(wanted.select(bloom.id_key(F.col("doc_id")).alias("k")), "k", blocks)
    ids = wanted.select(F.col("doc_id").alias("_id")).distinct()
    near = bloom.may_hold(docs.select("doc_id", "text"), bloom.id_key(F.col("doc_id")), held, blocks)
    texts = near.join(ids, F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi").select("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k, s, n in _parts(b.column("text"), 64):
                edge = pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32())
                yield pa.record_batch([pa.array(fingerprints(s, n), pa.binary()),
                                       pa.ListArray.from_arrays(edge, pa.array(s.view(np.int64)))], ["set", "shingles"])

    sets = texts.mapInArrow(run, "set binary, shingles array<long>").join(wanted.select("set"), "set", "left_semi")
    return sets.groupBy("set").agg(F.first("shingles").alias("shingles"))


def check(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs whose full sets reach the similarity: 100 * intersection >= 75 * union."""
    both = (pairs.join(sets.select(F.col("set").alias("a"), F.col("shingles").alias("x")), "a")
            .join(sets.select(F.col("set").alias("b"), F.col("shingles").alias("y")), "b"))
    common = F.size(F.array_intersect("x", "y"))
    return stored(both.where(100 * common >= 75 * (F.size("x") + F.size("y") - common)).select("a", "b"), "links")


def components(links: DataFrame) -> DataFrame:
    """(set, root) of every linked set; root is the smallest set of its component.

    Each round every set takes the smallest label among its neighbours' and its
    own, then that label's own label (pointer jumping), so labels cross a long
    chain in a few rounds. A round is one minimum by key and two joins, written
    before the next; it ends when no label changed."""
    both = stored(links.select("a", "b").union(links.select("b", "a")), "edges")
    labels = stored(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("root")).select(F.col("a").alias("set"), "root"), "labels")
    while True:
        seen = both.join(labels.select(F.col("set").alias("b"), "root"), "b").groupBy(F.col("a").alias("set")).agg(F.min("root").alias("near"))
        own = labels.join(seen, "set").select("set", "root", F.least("root", "near").alias("next"))
        jump = labels.select(F.col("set").alias("next"), F.col("root").alias("far"))
        labels = stored(own.join(jump, "next").select("set", F.least("next", "far").alias("root"), (F.least("next", "far") < F.col("root")).alias("moved")), "labels")
        if labels.where("moved").isEmpty():
            return labels.select("set", "root")


def _grouped(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(sketches of all rows, classes with their group: set, least, root)."""
    rows = stored(sketch(docs), "sketches")
    classes = stored(rows.where("set IS NOT NULL").groupBy("set").agg(F.min("doc_id").alias("least"), F.first("tokens").alias("tokens")), "classes")
    leaves, large = trees(stored(sharing(classes.select("set", "tokens")), "sharing"))
    leaves = stored(partnered(leaves.withColumn("label", F.col("set"))).drop("label"), "leaves")
    ids = leaves.select("set").union(large.select("set")).distinct()
    members = stored(ids.join(classes.select("set", F.col("least").alias("doc_id")), "set"), "members")
    sets = stored(full_sets(docs, members), "sets")
    dealt = leaves.unionByName(partnered(sub_blocks(large).withColumn("label", F.col("set"))).drop("label"))
    dealt = dealt.withColumn("label", F.lit(None).cast("binary"))
    first = stored(candidates(dealt, sets, every=False), "pairs")
    links = check(first, sets)
    group = stored(components(links), "groups")
    # round two: pairs between different groups that the first round didn't look at
    named = lambda x: x.join(group, "set", "left").withColumn("label", F.coalesce("root", "set")).drop("root")
    rest = mixed(named(leaves)).select("node", "set", "tokens", "label")
    depth, open_ = LEVELS, stored(mixed(named(large)), "large")
    while not open_.isEmpty():
        last = depth == DEPTH
        dear = F.lit(False) if last else F.col("others") * F.col("n") > CHEAP
        rest = rest.unionByName(cross_blocks(open_.where(~dear)))
        if last:
            break
        child = stored(mixed(branches(open_.where(dear).select("node", "n", "set", "tokens", "label"))), "large")
        rest = rest.unionByName(child.where(F.col("n") <= LEAF).select("node", "set", "tokens", "label"))
        depth, open_ = depth + 1, child.where(F.col("n") > LEAF)
    second = stored(candidates(partnered(rest), sets, every=True).join(first, ["a", "b"], "left_anti"), "pairs")
    if not second.isEmpty():
        more = check(second, sets)
        if not more.isEmpty():
            group = stored(components(links.unionByName(more)), "groups")
    return rows, classes.select("set", "least").join(group, "set", "left").select("set", "least", F.coalesce("root", "set").alias("root"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, text_key of every row."""
    rows, named_classes = _grouped(docs)
    lowest = named_classes.groupBy("root").agg(F.min("least").alias("component"))
    final = named_classes.join(lowest, "root").select("set", "component")
    out = rows.drop("tokens").join(final, "set", "left")
    out = out.withColumn("component_id", F.when(F.col("set").isNull(), F.col("doc_id")).otherwise(F.col("component")))
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"), "text_key")


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each group, with all columns: the one of the smallest (doc_id, text_key), null ids
    last, once if its row repeats."""
    rows, named_classes = _grouped(docs)
    own = stored(rows.groupBy("doc_id", "text_key").agg(F.count("*").alias("n"), F.first("set").alias("set")), "rows")
    first = own.where("set IS NOT NULL").groupBy("set").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")).alias("first"))
    best = first.join(named_classes, "set").groupBy("root").agg(F.min("first").alias("first"))
    best = best.select(F.col("first.doc_id").alias("b_id"), F.col("first.text_key").alias("b_key"))
    # by row, not by group: a large group's rows stay spread
    found = own.join(best, F.col("doc_id").eqNullSafe(F.col("b_id")) & (F.col("text_key") == F.col("b_key")), "left")
    found = found.withColumn("kept", F.col("set").isNull() | F.col("b_key").isNotNull())
    return bloom.without(docs, stored(found.where("NOT kept OR n > 1").select("doc_id", "text_key", F.col("kept").alias("once")), "dropped"))


ORACLE = r"""
WITH RECURSIVE docs AS (SELECT doc_id, row_number() OVER () AS r,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (SELECT doc_id, r, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(generate_series(1, len(w) - 4), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM docs),
items AS (SELECT r, unnest(s) AS x FROM sets),
shared AS (SELECT a.r AS a, b.r AS b, count(*) AS n FROM items a JOIN items b ON a.x = b.x AND a.r < b.r GROUP BY 1, 2),
links AS (SELECT a, b FROM shared JOIN sets s ON s.r = a JOIN sets t ON t.r = b WHERE 100 * n >= 75 * (len(s.s) + len(t.s) - n)),
edges AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach(r, o) AS (SELECT r, r FROM sets UNION SELECT reach.r, edges.b FROM reach JOIN edges ON edges.a = reach.o),
least AS (SELECT reach.r, min(sets.doc_id) AS component_id FROM reach JOIN sets ON sets.r = reach.o GROUP BY reach.r)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept
FROM sets JOIN least USING (r)
"""
