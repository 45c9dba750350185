"""Near copies: SimHash fingerprints through covering masks, confirmed by the exact Jaccard similarity.

A text is the set of its shingles (`simhash.shingle_hashes`).  Texts with equal sets fold
into one first.  Each set has a wide SimHash fingerprint (`simhash.wide_fingerprint`): two
words that are compared as a whole, and parts of few bits, each with the covering masks of
`RADIUS`.  Sets that differ in at most so many bits of any part agree on one of its masks
for certain.  A bit of two sets at the similarity differs with a probability known from
the angle between them (`differing`); there are so many parts that such a pair agrees on no
mask with probability `MISSED` or less (`parts_for`, an exact sum), and more alike pairs
less.  Sets of few shingles, whose bits differ more often, have more parts.  The masks get
wider with the number of rows, so that sets which only happen to agree stay few.

What agrees on a mask is a bucket.  In it, sets hang together if the two words and a third
one, of bits of the first parts, differ in no more bits than pairs at the similarity do
(five standard deviations above their mean, or links through others); the rest is alone and
is dropped.  A bucket of very many sets is cut into blocks, each pair of blocks on its own.

Near copies agree on most masks, so the same sets hang together in many buckets.  Buckets with
the same hub, their least set, are one group; groups that share sets are one gathering, in
which each set is held once, however many buckets it is in.

Candidates are confirmed by the similarity itself.  A gathering is searched whole: a search
takes each set from the unvisited ones once, so groups of near copies never become pairs,
in blocks of `ROOM` / `BLOCKS` shingles, each pair of blocks on its own.  That sends a set
`BLOCKS` times at most.  In a gathering above `ROOM` shingles each set is compared with the hubs
of its groups first, which stay in memory while the others stream past them; a group whose
sets then hang together needs no more.  What is still apart after `STARS` such rounds, each
with another hub, is searched group by group, in blocks of `ROOM` shingles.  So every link
between sets of a bucket is kept, whatever the size of a group, and each task holds bounded
bytes.

Null, empty and white-space texts have the same, empty set and are copies of each other.
Texts are taken whole.  Sets are named by a hash of 64 bits.  Rows may repeat or have a null
doc_id; the key may be a struct, and its least value names the group.  Only the named
columns are read.  An empty table gives an empty result.
"""

import functools
import math
from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from datakiln.jobs import scratch
from datakiln.llm import meeting
from datakiln.llm.components import components, joined_names
from datakiln.llm.simhash import covering_masks, mixed, shingle_hashes, wide_fingerprint
from datakiln.operators.row_index import prefix_sums

WORDS, SIMILARITY = 5, 0.8
SEED = 42
#: Bits of a part within which sets agree on a mask for certain, and how probable it may be that a pair at the similarity agrees on no mask of any part.
RADIUS, MISSED = 2, 0.00005
#: Words that are compared as a whole, standard deviations that they may differ beyond their mean, and sets of so few shingles whose bits differ by so much more often.
WHOLE, DEVIATIONS, FEW, MORE = 2, 5, 8, 1.25
#: Bits of a mask at least, and how many less than the bits of the number of rows.
LEAST_BITS, FEWER_BITS = 12, 5
#: Sets that one block of a bucket holds about, the share of sets that says which buckets are cut, and sets up to which all pairs of a bucket are compared at once.
BUCKET, SHARE, ALL_PAIRS = 8192, 16, 256
#: Sets that meet one copy of a hub, rounds before a group is searched whole, and shingles that a block of that search holds about.
SPOKES, STARS, ROOM = 4096, 1, 1 << 21
#: Blocks of a gathering that is searched at once; it has no more than `ROOM` shingles.
BLOCKS = 8
#: Shingles that are compared with a hub at once.
SHINGLES_COMPARED = 1 << 19


def differing(similarity: float) -> float:
    """How often a bit differs between sets of one size at a similarity: their angle as a share of the half circle."""
    return math.acos(min(1.0, 2 * similarity / (1 + similarity))) / math.pi


def agreeing(bits: int, differ: float) -> float:
    """How often two parts of so many bits agree on a covering mask, if each bit differs with the probability ``differ``."""
    size = 2 ** (RADIUS + 1)
    alike = [(1 - differ) ** sum(i % size == v for i in range(bits)) for v in range(size)]
    found = 0.0
    for apart in product((False, True), repeat=size - 1):  # the vectors of the covering code that have a bit that differs
        seen = [v for v, x in enumerate(apart, 1) if x]
        if any(all((v & mask).bit_count() % 2 == 0 for v in seen) for mask in range(1, size)):
            found += math.prod(1 - alike[v] if x else alike[v] for v, x in enumerate(apart, 1))
    return found


def parts_for(bits: int, differ: float) -> int:
    """So many parts that a pair agrees on no mask of any of them with probability `MISSED` or less."""
    found = agreeing(bits, differ)
    return 1 if found >= 1 else math.ceil(math.log(MISSED) / math.log1p(-found))


def bits_for(rows: int) -> int:
    """Bits of a part: masks have half of them, so a bucket holds some 30 sets that only happen to agree, however many rows there are."""
    return 2 * max(LEAST_BITS, rows.bit_length() - FEWER_BITS)


def print_of(shingles: np.ndarray, bits: int, parts: int) -> tuple[list[int], list[int]]:
    """The words of a set that are compared as a whole, and its parts; no parts for an empty set."""
    head = 64 * WHOLE
    on = wide_fingerprint(shingles, -(-(head + bits * parts) // 64))
    whole = np.packbits(on[:head], bitorder="little").view(np.int64).tolist()
    cut = on[head : head + bits * parts].reshape(parts, bits) @ (np.int64(1) << np.arange(bits))
    return whole, cut.tolist() if len(shingles) else []


def shingled(text: Column, words_each: int, similarity: float, bits: int) -> Column:
    """The name of a text's set of shingles, its size and its fingerprint."""
    differ = differing(similarity)
    usual, few = parts_for(bits, differ), parts_for(bits, MORE * differ)

    @F.arrow_udf("struct<id:long,size:long,a:long,b:long,parts:array<long>>")
    def made(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            ids, sizes, whole, parts = np.empty(len(batch), np.uint64), np.empty(len(batch), np.int64), np.empty((len(batch), WHOLE), np.int64), []
            for i, t in enumerate(batch):  # one set at a time
                held = np.unique(shingle_hashes(t.as_py(), words_each))
                ids[i], sizes[i] = xxhash.xxh64_intdigest(held.tobytes(), SEED), len(held)
                whole[i], cut = print_of(held, bits, few if len(held) <= FEW else usual)
                parts.append(cut)
            columns = [pa.array(ids.view(np.int64)), pa.array(sizes), *(pa.array(w) for w in whole.T.copy()), pa.array(parts, pa.list_(pa.int64()))]
            yield pa.StructArray.from_arrays(columns, ["id", "size", "a", "b", "parts"])

    return made(text.cast("binary"))


def apart(words: list[np.ndarray], one: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Bits in which the words differ between rows ``one`` and rows ``other``."""
    return sum(np.bitwise_count(w[one] ^ w[other]) for w in words)


def pair_labels(keys: np.ndarray, words: list[np.ndarray], radius: int) -> np.ndarray:
    """For each row the first row that it hangs together with; all pairs of each bucket are compared, a distance in the order at a time."""
    left, right = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    at, step = np.arange(len(keys)), 1
    while len(at):
        at = at[: np.searchsorted(at, len(keys) - step)]
        at = at[keys[at] == keys[at + step]]
        near = at[apart(words, at, at + step) <= radius]
        left.append(near)
        right.append(near + step)
        step += 1
    one, other = np.concatenate(left), np.concatenate(right)
    labels = np.arange(len(keys))
    while True:
        least = np.minimum(labels[one], labels[other])
        new = labels.copy()
        np.minimum.at(new, one, least)
        np.minimum.at(new, other, least)
        new = new[new]
        if (new == labels).all():
            return labels
        labels = new


def search_labels(words: list[np.ndarray], radius: int) -> np.ndarray:
    """As `pair_labels` for one large bucket: each row is taken from the open ones once."""
    labels = open_ = np.arange(len(words[0]))
    labels = labels.copy()
    while len(open_):
        root, open_ = open_[0], open_[1:]
        waiting = [root]
        while waiting and len(open_):
            near = apart(words, open_, waiting.pop()) <= radius
            found, open_ = open_[near], open_[~near]
            labels[found] = root
            waiting += found.tolist()
    return labels


def close_ones(radius: int):
    """For mapInArrow over rows (k, a, b, c, id) sorted by k: (k, hub, id) of what hangs together in each bucket, with a k of its own and its least set."""

    def found(pieces: list[list[np.ndarray]]) -> pa.RecordBatch:
        keys, *words, ids = (np.concatenate(column) for column in zip(*pieces, strict=True))
        words = [w.view(np.uint64) for w in words]  # bits of signed numbers are counted in their magnitude
        starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        sizes = np.diff(np.append(starts, len(keys)))
        labels, small = np.arange(len(keys)), np.flatnonzero(np.repeat(sizes <= ALL_PAIRS, sizes))
        labels[small] = small[pair_labels(keys[small], [w[small] for w in words], radius)]
        for start, size in zip(starts[sizes > ALL_PAIRS], sizes[sizes > ALL_PAIRS], strict=True):
            labels[start : start + size] = start + search_labels([w[start : start + size] for w in words], radius)
        held = np.bincount(labels, minlength=len(keys))[labels] > 1
        named = mixed(mixed(keys.astype(np.int64).view(np.uint64)) ^ ids[labels].view(np.uint64)).view(np.int64)
        hubs = ids.copy()
        np.minimum.at(hubs, labels, ids)
        return pa.RecordBatch.from_arrays([pa.array(named[held]), pa.array(hubs[labels[held]]), pa.array(ids[held])], ["k", "hub", "id"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [batch.column(n).to_numpy() for n in ("k", "a", "b", "c", "id")]
            keys = columns[0]
            first = np.searchsorted(keys, keys[-1])  # of the last bucket, which may go on
            if held and (first or held[-1][0][-1] != keys[0]):
                yield found([*held, [c[:first] for c in columns]])
                held = []
            elif first:
                yield found([[c[:first] for c in columns]])
            held.append([c[first:] for c in columns])
        if held:
            yield found(held)

    return run


def close_sets(sets: DataFrame, bits: int, similarity: float) -> DataFrame:
    """(id, a, b, parts) to (k, hub, id): sets that agree on a mask and hang together by the three words; the hub is the least of them."""
    first = [F.shiftleft(F.coalesce(F.get("parts", F.lit(i)), F.lit(0)), i * bits) for i in range(-(-64 // bits))]
    third = functools.reduce(Column.bitwiseXOR, first).alias("c")
    keys = F.array(*[F.hash("place", F.lit(m), F.col("part").bitwiseAND(F.lit(m))) for m in covering_masks(RADIUS, bits)])
    rows = sets.select("a", "b", third, "id", F.posexplode("parts").alias("place", "part")).select("a", "b", "c", "id", F.explode(keys).alias("k"))
    some = rows.filter(F.pmod(F.xxhash64("id"), F.lit(SHARE)) == 0).groupBy("k").agg(F.count("*").alias("n")).filter(F.col("n") * SHARE > BUCKET)
    blocks = F.ceil(F.col("n") * SHARE / BUCKET).cast("int")
    large = some.select("k", blocks.alias("blocks"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other"))
    mine = F.pmod(F.xxhash64("id", F.lit(1)), F.col("blocks")).cast("int")
    key = F.when(F.col("other").isNull(), F.col("k")).otherwise(F.hash("k", F.least(mine, "other"), F.greatest(mine, "other")))
    # few buckets are large: their sizes sum up to no more than the masks of all sets
    spread = rows.join(F.broadcast(large), "k", "left").select(key.alias("k"), "a", "b", "c", "id").repartition("k").sortWithinPartitions("k")
    differ = differing(similarity)
    whole = 64 * (WHOLE + 1)
    radius = math.ceil(whole * differ + DEVIATIONS * math.sqrt(whole * differ * (1 - differ)))
    return spread.mapInArrow(close_ones(radius), "k long, hub long, id long")


def shingle_set(text: Column, words_each: int) -> Column:
    """The distinct shingle hashes of a text."""

    @F.arrow_udf("array<long>")
    def made(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            sets = [np.unique(shingle_hashes(t.as_py(), words_each)) for t in batch]
            ends = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
            values = np.concatenate(sets) if sets else np.empty(0, np.uint64)
            yield pa.ListArray.from_arrays(ends, values.view(np.int64))

    return made(text.cast("binary"))


def links_at(nodes: list[int], sets: list[np.ndarray], similarity: float) -> tuple[list[int], list[int]]:
    """Edges that connect exactly what pairs of at least this similarity connect."""
    sizes = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), sizes)
    _, place = np.unique(np.concatenate(sets), return_inverse=True)
    cuts = np.concatenate([[0], np.cumsum(sizes)])
    marks, open_ = np.zeros(len(place), bool), np.ones(len(sets), bool)
    left: list[int] = []
    right: list[int] = []
    for root in range(len(sets)):
        if not open_[root]:
            continue
        open_[root] = False
        waiting = [root]
        while waiting and open_.any():
            at = waiting.pop()
            mine = place[cuts[at] : cuts[at + 1]]
            marks[mine] = True
            shared = np.bincount(owner[marks[place]], minlength=len(sets))
            marks[mine] = False
            found = np.flatnonzero(open_ & (shared / (sizes + sizes[at] - shared) >= similarity)).tolist()
            open_[found] = False
            waiting += found
            left += [nodes[i] for i in found]
            right += [nodes[root]] * len(found)
    return left, right


def group_links(similarity: float):
    """For mapInArrow over rows (k, node, shingles) sorted by k: the edges (a, b) of each group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        held_key = None

        def edges() -> pa.RecordBatch:
            a, b = links_at(list(held), list(held.values()), similarity) if len(held) > 1 else ([], [])
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        for batch in batches:
            for key, node, shingles in zip(*(batch.column(n) for n in ("k", "node", "shingles")), strict=True):
                if key.as_py() != held_key:
                    if len(held) > 1:
                        yield edges()
                    held, held_key = {}, key.as_py()
                held[node.as_py()] = shingles.values.to_numpy()
        yield edges()

    return run


def gatherings(pairs: DataFrame) -> DataFrame:
    """Distinct (hub, id) to (id, g): sets of groups that share sets, directly or through others, have the same g.

    Only hubs are linked, each to the least hub of a set of its group.
    """
    least = F.min("hub").over(Window.partitionBy("id"))  # a set has one hub for each mask at most
    roots = components(pairs.select("hub", least.alias("least")).filter("hub <> least").distinct().toDF("a", "b"))
    held = pairs.groupBy("id").agg(F.min("hub").alias("node"))
    return held.join(roots, "node", "left").select("id", F.coalesce("root", "node").alias("g"))


def marks_of(members: DataFrame) -> DataFrame:
    """(hub, id) to (node, asks: the hubs that a set is to be compared with, copies: how often it is sent as a hub).

    A hub of many sets is sent once for each `SPOKES` of them, so none gathers in one task.
    """
    pairs = members.filter("id <> hub").select(F.col("id").alias("node"), "hub").distinct()
    copies = pairs.groupBy("hub").agg(F.ceil(F.count("*") / SPOKES).cast("int").alias("copies"))
    asks = pairs.join(copies, "hub").groupBy("node").agg(F.collect_list(F.struct("hub", "copies")).alias("asks"))  # one for each mask at most
    return asks.join(copies.withColumnRenamed("hub", "node"), "node", "full")


def similar_to(similarity: float):
    """For `meeting.meet`: the sets of a batch that are at least so similar to a hub."""

    def prepare(table: pa.Table) -> list[tuple[int, np.ndarray]]:
        return [(node.as_py(), shingles.values.to_numpy().view(np.uint64)) for node, shingles in zip(table.column("node"), table.column("shingles"), strict=True)]

    def ask(hubs: list[tuple[int, np.ndarray]], batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        nodes, lists = batch.column("node").to_numpy(), batch.column("shingles")
        ends = np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False), dtype=np.int64)
        start = 0
        while start < len(nodes):  # some sets at a time, at least one
            held = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, held + SHINGLES_COMPARED, "right")))
            values = lists.slice(start, stop - start).flatten().to_numpy().view(np.uint64)
            cuts = np.concatenate([[0], ends[start:stop] - held])
            sizes = np.diff(cuts)
            for hub, mine in hubs:
                at = np.searchsorted(mine, values)
                at[at == len(mine)] = 0
                before = np.concatenate([[0], np.cumsum(mine[at] == values)])[cuts]
                shared = np.diff(before)
                found = nodes[start:stop][shared >= similarity * (sizes + len(mine) - shared)]
                yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(np.full(len(found), hub))], ["a", "b"])
            start = stop

    return prepare, ask


def star_links(marked: DataFrame, similarity: float) -> DataFrame:
    """(node, shingles, asks, copies) to the edges (a, b) of sets and their hubs that are at least so similar."""
    nth = F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("nth")
    hubs = marked.filter("copies is not null").select(F.col("node").alias("hub"), nth, "node", "shingles")
    each = marked.filter("asks is not null").select("node", "shingles", F.explode("asks").alias("ask"))
    sent = each.select(F.col("ask.hub").alias("hub"), F.pmod(F.xxhash64("node"), F.col("ask.copies")).cast("int").alias("nth"), "node", "shingles")
    keyed = [df.select(F.xxhash64("hub", "nth").alias("block"), "node", "shingles") for df in (hubs, sent)]
    return meeting.meet(*keyed, *similar_to(similarity), "a long, b long")


def unsettled(members: DataFrame, roots: DataFrame) -> DataFrame:
    """The groups (k, hub, id) whose sets do not hang together yet, each with another hub than before.

    Of two sets one is the hub, so they have been compared and need no more.
    """
    placed = members.join(roots.select(F.col("node").alias("id"), "root"), "id", "left").withColumn("root", F.coalesce("root", "id"))
    apart = placed.groupBy("k").agg(F.min("root").alias("a"), F.max("root").alias("b"), F.max_by("id", F.xxhash64("id", F.lit(SEED))).alias("next"), F.count("*").alias("n")).filter("a <> b and n > 2")
    return members.join(apart.select("k", "next"), "k").select("k", F.col("next").alias("hub"), "id")


def blocked(members: DataFrame, near: DataFrame, share: int = 1) -> DataFrame:
    """(k, id) to (k, node, size, mine): the sets of each group in blocks of at most `ROOM` / ``share`` shingles and one set."""
    sized = members.join(near.select(F.col("node").alias("id"), F.size("shingles").cast("long").alias("size")), "id")
    placed = prefix_sums(sized.select("k", "id", "size"), ["k"], ["id"], {"upto": F.col("size")})
    return placed.select("k", F.col("id").alias("node"), "size", F.floor((F.col("upto") - F.col("size")) / max(1, ROOM // share)).alias("mine"))


def searched(members: DataFrame, near: DataFrame, similarity: float, share: int = 1) -> DataFrame:
    """Edges (a, b) that connect in each group exactly what pairs of at least this similarity connect.

    Each pair of blocks of a group is searched on its own.
    """
    cut = scratch.save(blocked(members, near, share), "blocks")
    blocks = cut.groupBy("k").agg((F.max("mine") + 1).alias("blocks"))
    met = cut.join(blocks, "k").withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    keyed = met.select("node", F.xxhash64("k", F.least("mine", "other"), F.greatest("mine", "other")).alias("k")).join(near, "node")
    spread = keyed.select("k", "node", "shingles").repartition("k").sortWithinPartitions("k")
    return spread.mapInArrow(group_links(similarity), "a long, b long")


def near_copies(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", words_each: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, component_id) for each row; component_id is the least doc_id reachable over links."""
    hashed = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.xxhash64(F.col(text)).alias("h"))
    bits = bits_for(docs.count())
    made = scratch.save(hashed.select("doc_id", "h", shingled(F.col("text"), words_each, similarity, bits).alias("s")).select("doc_id", "h", "s.*"), "shingled")
    with scratch.cleared(docs.sparkSession):
        same = [F.first(n).alias(n) for n in ("size", "a", "b", "parts")]
        one = made.groupBy("id").agg(F.min(F.struct("doc_id", "h")).alias("one"), *same, F.count("*").alias("held"))
        sets = scratch.save(one.select("id", "size", "a", "b", "parts", "held", F.col("one.doc_id").alias("least"), "one.h"), "sets")
        pairs = scratch.save(close_sets(sets, bits, similarity).select("hub", "id").distinct(), "pairs")
        gathered = gatherings(pairs).join(sets.select("id", "size", "least", "h"), "id")
        gathered = scratch.save(gathered, "gathered")
        large = gathered.groupBy("g").agg(F.sum("size").alias("all")).filter(F.col("all") > ROOM).select("g")
        ids = scratch.save(gathered.join(large, "g", "left_semi").select("id"), "large")
        members = scratch.save(pairs.join(ids, "id", "left_semi").select(F.col("hub").alias("k"), "hub", "id"), "groups")
        maybe = gathered.select(F.col("id").alias("node"), "least", "h").join(marks_of(members), "node", "left")
        there = F.col("doc_id").eqNullSafe(F.col("least")) & (hashed.h == maybe.h)
        marked = hashed.join(maybe, there).select("node", "asks", "copies", shingle_set(F.col("text"), words_each).alias("shingles"))
        marked = scratch.save(marked, "near")
        near = marked.select("node", "shingles")
        links = scratch.save(searched(gathered.join(large, "g", "left_anti").select(F.col("g").alias("k"), "id"), near, similarity, BLOCKS).distinct(), "links")
        if not members.isEmpty():
            links = scratch.save(links.union(star_links(marked, similarity)).distinct(), "links")
        roots = components(links)
        for nth in range(STARS):
            if members.isEmpty():
                break
            members = scratch.save(unsettled(members, roots), "unsettled")
            more = star_links(near.join(marks_of(members), "node"), similarity) if nth < STARS - 1 else searched(members, near, similarity)
            links = scratch.save(links.union(more).distinct(), "links")
            roots = components(links)
        roots = scratch.save(roots, "roots")
        grouped = roots.join(sets.select(F.col("id").alias("node"), "least"), "node")
        joint = grouped.join(grouped.groupBy("root").agg(F.min("least").alias("joint")), "root").select(F.col("node").alias("id"), "joint")
        names = sets.join(joint, "id", "left").select("id", "held", F.coalesce("joint", "least").alias("component_id"))
        names = scratch.save(names, "names", outlives=True)
    return joined_names(made.select("doc_id", "id"), names, "id").select("doc_id", "component_id")
