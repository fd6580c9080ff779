"""Near-duplicates by BagMinHash: weighted Jaccard of word shingles, bands, exact verification.

A text is the multiset of its five-word shingles (ASCII letters in lower case).  Weights are
the counts.  BagMinHash gives every shingle a Poisson process of points (time, level, place in
the signature) that all documents share; a document sees the points whose level is below the
shingle's weight, and its signature holds the first time at each place, so two signatures
agree at a place with a probability equal to the weighted Jaccard similarity.  Levels are cut
into dyadic intervals (the hierarchy), each with its own process of the interval's rate, so a
shingle of weight w needs log w processes; and points later than a limit at which nearly all
places are filled are never drawn, so a document costs its shingles plus the signature, not
their product.  Documents with an unfilled place are drawn again with twice the limit.

Equal signatures over a band make a bucket.  Equal multisets are one node from the start.  In
every bucket all nodes are held against one leader (the node that shares the most bucket
places, as the original of a group of copies does); verified links join nodes into classes,
so a large group of near copies costs a star, not all pairs.  What is left are buckets that
hold several classes.  Their nodes are compared by prefix filtering: two multisets can only be
similar if they share one of their rarest shingles, so texts that have a common passage or
boilerplate alone never meet, and no link between nodes of open buckets is lost.
Verification is the exact multiset overlap.

Defined results
* Texts of one to four words are one shingle of all their words; null and empty texts have
  none, and each stays alone.
* Rows with null or repeated ids each get a row; the class id is the smallest doc_id of a
  class (null if it has none); extra columns play no part; an empty table stays empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trenchline.llm.bloom import twice_seen
from trenchline.llm.components import components
from trenchline.llm.tables import as_bytes, discard, stored, text_slices, worker_state

SHINGLE_WORDS, SIMILARITY = 5, 0.8
#: 20 bands of 5: a pair of similarity 0.8 shares a bucket with probability 0.9996.
BANDS, BAND_ROWS = 20, 5
PLACES = BANDS * BAND_ROWS
CACHED_WORDS = 300_000
#: Points that one step of the Poisson processes draws at a time, whatever the texts are like.
DRAWN_POINTS = 1 << 17
#: Bytes of text that are signed at a time.
SIGNED_BYTES = 1_000_000
NODES_TO_BROADCAST = 100_000
U = np.uint64
GOLDEN = U(0x9E3779B97F4A7C15)


class WordHashes(dict):
    """64-bit hashes of words; bounded."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHED_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def shingles(text: bytes, known: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of a text, in order, and their counts."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, U), np.zeros(0, np.int64)
    h = np.fromiter(map(known.__getitem__, words), U, len(words))
    n = max(1, len(h) - SHINGLE_WORDS + 1)
    rolled = np.full(n, U(min(len(h), SHINGLE_WORDS)))
    for i in range(min(len(h), SHINGLE_WORDS)):
        rolled = (rolled ^ h[i:n + i]) * GOLDEN
        rolled ^= rolled >> U(29)
    return np.unique(mixed(rolled), return_counts=True)


def draw(out: np.ndarray, doc: np.ndarray, element: np.ndarray, weight: np.ndarray, limit: np.ndarray, low: int, high: int, block: int) -> None:
    """Put the first times of one level interval's processes into `out` (documents x places).

    `block` points of each process are drawn at a time, until all are past their limit.
    """
    rate, k = PLACES * (high - low), 0
    state = mixed(element + U(int(GOLDEN) * high % (1 << 64)))
    time = np.zeros(len(element))
    flat = out.reshape(-1)
    while len(state):
        steps = np.arange(k + 1, k + block + 1, dtype=U) * GOLDEN
        r = mixed(state[:, None] + steps[None, :])
        gaps = -np.log(((r >> U(11)).astype(np.float64) + 0.5) * 2.0 ** -53) / rate
        times = time[:, None] + np.cumsum(gaps, axis=1)
        row, col = np.nonzero(times <= limit[:, None])
        second = mixed(r[row, col] ^ U(0xD6E8FEB86659FD93))
        seen = np.ones(len(row), bool)
        if high - low > 1 or low:
            level = low + (second & U(0xFFFFFFFF)).astype(np.float64) * 2.0 ** -32 * (high - low)
            seen = level < weight[row]
        place = (second >> U(32)) % U(PLACES)
        np.minimum.at(flat, doc[row[seen]] * PLACES + place[seen].astype(np.int64), times[row, col][seen])
        on = times[:, -1] <= limit
        state, time, doc, weight, limit = state[on], times[on, -1], doc[on], weight[on], limit[on]
        k += block


def signatures(sets: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """BagMinHash signatures of non-empty multisets, one row each."""
    out = np.full((len(sets), PLACES), np.inf)
    element = np.concatenate([e for e, _ in sets])
    weight = np.concatenate([w for _, w in sets])
    doc = np.repeat(np.arange(len(sets)), [len(e) for e, _ in sets])
    total = np.array([w.sum() for _, w in sets], np.float64)
    reach = np.log(PLACES) + 4.0
    todo = np.ones(len(sets), bool)
    while todo.any():
        points = PLACES * reach / total  # expected number of points for each unit of weight
        for least, most, block in ((0, 3, 1), (3, 24, 8), (24, np.inf, 64)):
            own = todo & (points >= least) & (points < most)
            pick = own[doc]
            if not pick.any():
                continue
            d, e, w = doc[pick], element[pick], weight[pick]
            low, high = 0, 1
            while len(d):
                for start in range(0, len(d), run := DRAWN_POINTS // block):
                    own_d = d[start:start + run]
                    draw(out, own_d, e[start:start + run], w[start:start + run], (reach / total)[own_d], low, high, block)
                low, high = high, high * 2
                more = w > low
                d, e, w = d[more], e[more], w[more]
        todo = np.isinf(out).any(axis=1)
        reach *= 2
    return out


def band_hashes(found: np.ndarray) -> np.ndarray:
    """One 64-bit bucket key for each band of each signature."""
    bits = np.ascontiguousarray(found).view(U).reshape(len(found), BANDS, BAND_ROWS)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=U) * GOLDEN, bits.shape[:2]).copy()
    for i in range(BAND_ROWS):
        key = mixed(key ^ bits[:, :, i])
    return key.view(np.int64)


def sign(docs: DataFrame) -> DataFrame:
    """doc_id, content, node (digest of the multiset, null if empty), weight, buckets; docs: doc_id, text, content."""
    def run(batches: Iterator[pa.RecordBatch]):
        known = worker_state("word hashes", WordHashes)
        for part in text_slices(batches, "text", SIGNED_BYTES):
            sets = [shingles(t, known) for t in as_bytes(part["text"])]
            full = [i for i, (e, _) in enumerate(sets) if len(e)]
            node, weight, buckets = [None] * len(sets), [0] * len(sets), [[]] * len(sets)
            if full:
                keys = band_hashes(signatures([sets[i] for i in full]))
                for i, own in zip(full, keys, strict=True):
                    e, w = sets[i]
                    node[i], weight[i], buckets[i] = xxhash.xxh128_digest(e.tobytes() + w.astype("<i8").tobytes()), int(w.sum()), own
            yield pa.RecordBatch.from_arrays(
                [part["doc_id"], part["content"], pa.array(node, pa.binary()), pa.array(weight, pa.int64()), pa.array(buckets, pa.list_(pa.int64()))],
                ["doc_id", "content", "node", "weight", "buckets"])

    return docs.mapInArrow(run, "doc_id long, content long, node binary, weight long, buckets array<long>")


def tokens_of(docs: DataFrame) -> DataFrame:
    """node and tokens of node and text: each shingle with the number of its occurrence, so overlaps of multisets are overlaps of sets."""
    def run(batches: Iterator[pa.RecordBatch]):
        known = worker_state("word hashes", WordHashes)
        for part in text_slices(batches, "text"):
            tokens = []
            for text in as_bytes(part["text"]):
                e, w = shingles(text, known)
                nth = np.arange(w.sum()) - np.repeat(np.cumsum(w) - w, w)
                tokens.append(mixed(np.repeat(e, w) + nth.astype(U) * GOLDEN).view(np.int64))
            yield pa.RecordBatch.from_arrays([part["node"], pa.array(tokens, pa.list_(pa.int64()))], ["node", "tokens"])

    return docs.mapInArrow(run, "node long, tokens array<long>")


def verified(pairs: DataFrame, tokens: DataFrame, similarity: float) -> DataFrame:
    """Those pairs (a, b) whose multisets are similar enough."""
    left = tokens.select(F.col("node").alias("a"), F.col("tokens").alias("a_tokens"))
    right = tokens.select(F.col("node").alias("b"), F.col("tokens").alias("b_tokens"))
    both = pairs.join(left, "a").join(right, "b")
    shared = F.size(F.array_intersect("a_tokens", "b_tokens"))
    union = F.size("a_tokens") + F.size("b_tokens") - shared
    return both.where(shared >= similarity * union).select("a", "b")


def closeness(a: str, b: str, similarity: float) -> F.Column:
    """Multisets whose sizes differ by more than the similarity allows cannot be similar."""
    return F.least(a, b) >= similarity * F.greatest(a, b)


def ordered_pairs(met: DataFrame, a: str, b: str) -> DataFrame:
    return met.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct()


def star_pairs(members: DataFrame, similarity: float) -> DataFrame:
    """Every node of a bucket with the bucket's most central node, unless they are one class.

    The most central one is found by an aggregate, which combines in each task first.
    """
    place = F.struct("ties", "node", "weight", "root")
    leaders = stored(members.groupBy("bucket").agg(F.max(place).alias("leader")).select(
        "bucket", *(F.col(f"leader.{c}").alias(f"l_{c}") for c in ("node", "weight", "root"))), "leaders")
    met = members.join(leaders, "bucket").where((F.col("root") != F.col("l_root")) & closeness("weight", "l_weight", similarity))
    return ordered_pairs(met, "node", "l_node")


def open_members(members: DataFrame) -> DataFrame:
    """The rows of buckets whose nodes are not one class."""
    several = members.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low != high").select("bucket")
    return members.join(several, "bucket", "left_semi")


def prefix_pairs(nodes: DataFrame, tokens: DataFrame, similarity: float) -> DataFrame:
    """All pairs of different classes that can be similar: they share one of their rarest tokens.

    Two multisets of weights v and w are similar if they share at least t = s/(1 + s) (v + w)
    tokens, so one token is among the v - t + 1 rarest of the one and the w - t + 1 rarest of
    the other.  Tokens of one node alone come first and match nothing, so only how many there
    are matters: a text with too many shingles of its own meets none.  For each token, nodes of
    its most frequent class meet the nodes of other classes but not each other.
    """
    small = F.broadcast(nodes) if nodes.count() <= NODES_TO_BROADCAST else nodes  # of checked size
    each = tokens.join(small, "node").select("node", F.xxhash64("root").alias("class"), F.explode("tokens").alias("token"))
    # tokens that only one node has are most; a Bloom filter keeps them from shuffling
    total = nodes.agg(F.sum("weight")).first()[0]
    each = each.where(twice_seen(each.select("token"), total).column(F.col("token")))
    common = each.groupBy("token").agg(F.count("*").alias("df"), (F.min("class") != F.max("class")).alias("mixed")).where("df > 1")
    rare_first = Window.partitionBy("node").orderBy("df", "token")
    shared = each.select("token", "node").join(common, "token").withColumns({"nth": F.row_number().over(rare_first), "n": F.count("*").over(Window.partitionBy("node"))})
    place = F.col("weight") - F.col("n") + F.col("nth")  # among all tokens of the node
    # the other node may be as small as the similarity allows
    reach = F.col("weight") - F.ceil(F.round(similarity * F.col("weight"), 6)) + 1
    rows = shared.where("mixed").join(small, "node").withColumn("place", place).where(F.col("place") <= reach)
    rows = stored(rows.select("token", "node", "root", "weight", "place"), "prefixes")
    largest = rows.groupBy("token", "root").count().groupBy("token").agg(F.max(F.struct("count", "root"))["root"].alias("largest"))
    minor = stored(rows.join(largest, "token").where(F.col("root") != F.col("largest")).select(
        "token", *(F.col(c).alias(f"l_{c}") for c in ("node", "root", "weight", "place"))), "minor")
    least = F.ceil(F.round(similarity / (1 + similarity) * (F.col("weight") + F.col("l_weight")), 6))
    early = (F.col("place") <= F.col("weight") - least + 1) & (F.col("l_place") <= F.col("l_weight") - least + 1)
    met = rows.join(minor, "token").where((F.col("root") != F.col("l_root")) & closeness("weight", "l_weight", similarity) & early)
    return ordered_pairs(met, "node", "l_node")


def merged_roots(roots: DataFrame | None, links: DataFrame) -> DataFrame:
    """node and root after further links; only classes that the links join are worked on."""
    if roots is None:
        return stored(components(links), "roots")
    for side in ("a", "b"):
        own = roots.select(F.col("node").alias(side), F.col("root").alias("_root"))
        links = links.join(own, side, "left").withColumn(side, F.coalesce("_root", side)).drop("_root")
    joined = stored(components(links), "joined").select(F.col("node").alias("root"), F.col("root").alias("_new"))
    old = roots.join(joined, "root", "left").select("node", F.coalesce("_new", "root").alias("root"))
    new = joined.join(roots.select(F.col("node").alias("root")), "root", "left_anti").select(F.col("root").alias("node"), F.col("_new").alias("root"))
    return stored(old.unionByName(new), "roots")


def classes_of(members: DataFrame, tokens_for, similarity: float) -> DataFrame | None:
    """node and root of all nodes with a link; members: bucket, node, weight, ties."""
    tokens = roots = None
    members = members.withColumn("root", F.col("node"))

    def relabelled(rows: DataFrame) -> DataFrame:
        return rows.drop("root").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))

    pairs = stored(star_pairs(members, similarity), "pairs")
    if not pairs.isEmpty():
        tokens = tokens_for(pairs.select(F.col("a").alias("node")).union(pairs.select("b")), tokens)
        links = stored(verified(pairs, tokens, similarity), "pair_links")
        if not links.isEmpty():
            roots = merged_roots(roots, links)
            members = relabelled(members)
    rest = stored(open_members(members).select("node", "root", "weight").distinct(), "open_nodes")
    if rest.isEmpty():
        return roots
    tokens = tokens_for(rest.select("node"), tokens)
    pairs = stored(prefix_pairs(rest, tokens, similarity), "pairs")
    if not pairs.isEmpty():
        links = stored(verified(pairs, tokens, similarity), "pair_links")
        if not links.isEmpty():
            roots = merged_roots(roots, links)
    return roots


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """One row per document: doc_id, content (hash of the text), node, class_root."""
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    docs = docs.withColumn("content", F.xxhash64("text"))
    signed = stored(sign(docs.select("doc_id", "text", "content")), "signatures")
    nodes = signed.where("node is not null").groupBy("node").agg(F.max("weight").alias("weight"), F.max("buckets").alias("buckets"), F.min("content").alias("content"))
    # numbers of their own, fixed as the table is written
    nodes = stored(nodes.withColumn("id", F.monotonically_increasing_id()), "nodes")
    # most buckets hold one node; a Bloom filter keeps them from shuffling, and numbers stand for digests from here on
    rows = nodes.select("id", F.col("weight").cast("int").alias("weight"), F.explode("buckets").alias("bucket"))
    rows = rows.where(twice_seen(rows.select("bucket"), nodes.count() * BANDS).column(F.col("bucket")))
    sizes = rows.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    shared = stored(rows.join(sizes, "bucket"), "shared")
    ties = shared.groupBy("id").agg(F.sum("n").alias("ties"))
    members = stored(shared.join(ties, "id").select("bucket", F.col("id").alias("node"), "weight", "ties"), "members")
    discard(shared)

    def tokens_for(some: DataFrame, have: DataFrame | None) -> DataFrame:
        """The tokens of these nodes; a Bloom filter of their contents spares the other texts."""
        needed = some.distinct()
        if have is not None:
            needed = needed.join(have, "node", "left_anti")
        needed = stored(nodes.select(F.col("id").alias("node"), "content").join(needed, "node"), "needed")
        if needed.isEmpty():
            return have
        wanted = twice_seen(needed.select("content"), needed.count(), times=1)
        texts = docs.select("text", "content").where(wanted.column(F.col("content")))
        # one text for each node, chosen by its content hash
        once = texts.join(needed, "content").groupBy("node").agg(F.min("text").alias("text"))
        new = stored(tokens_of(once), "tokens")
        return new if have is None else have.unionByName(new)

    roots = classes_of(members, tokens_for, similarity)
    discard(members)
    if roots is None:
        return signed.select("doc_id", "content", "node", F.col("node").alias("root"))
    # a class is named by the digest of its root; nodes without links by their own
    linked = nodes.select("node", F.col("id")).join(roots.select(F.col("node").alias("id"), "root"), "id")
    named = linked.join(nodes.select(F.col("id").alias("root"), F.col("node").alias("root_node")), "root").select("node", "root_node")
    labelled = signed.drop("weight", "buckets").join(named, "node", "left")
    return labelled.select("doc_id", "content", "node", F.coalesce("root_node", "node").alias("root"))


def classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """One row per document: doc_id, class_id (its class's smallest doc_id), class_size, kept."""
    found = stored(near_duplicates(docs, doc_id, text, similarity), "classes")
    alone = found.where("root is null").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(1).cast("long").alias("class_size"), F.lit(True).alias("kept"))
    counted = stored(found.where("root is not null").groupBy("root", "doc_id").agg(F.count("*").alias("copies")), "counted")
    sums = stored(counted.groupBy("root").agg(F.min("doc_id").alias("class_id"), F.sum("copies").alias("class_size")), "sums")
    rest = counted.join(sums, "root").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    return alone.unionByName(rest.select("doc_id", "class_id", "class_size", (F.col("doc_id").eqNullSafe(F.col("class_id")) & (F.col("copy") == 1)).alias("kept")))


def drop_near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """The rows of `docs` that stay: of each class the row with the smallest id, all columns as they were."""
    found = stored(near_duplicates(docs, doc_id, text, similarity), "classes")
    first = found.where("root is not null").groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "content")).alias("first"), F.count("*").alias("n"))
    several = first.where("n > 1").select("root", "first")
    # ids of rows that go: those of classes of several rows, but for the first
    classed = stored(found.where("root is not null").join(several, "root"), "classed")
    gone = classed.where(F.struct("doc_id", "content") != F.struct(F.col("first.doc_id"), F.col("first.content"))).select(F.col("doc_id").alias("_id"), F.col("content").alias("_content")).distinct()
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("content"))
    stay = rows.join(gone, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("content") == F.col("_content")), "left_anti")
    # rows that repeat the first one in id and text
    repeats = classed.where(F.struct("doc_id", "content") == F.struct(F.col("first.doc_id"), F.col("first.content"))).groupBy("doc_id", "content").count().where("count > 1")
    if repeats.isEmpty():
        return stay.select("row.*")
    repeats = repeats.select(F.col("doc_id").alias("_id"), F.col("content").alias("_content"))
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("content") == F.col("_content"))
    once = stay.join(repeats, same, "left_semi").groupBy("doc_id", "content").agg(F.min_by("row", F.struct(F.col("row")[text])).alias("row"))
    return stay.join(repeats, same, "left_anti").select("row.*").unionByName(once.select("row.*"))
