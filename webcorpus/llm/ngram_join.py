"""Operator 4: n-gram Jaccard join as a blocked sparse product of the document by n-gram incidence matrix.

Equal sets are one class first. Then products of blocks:

1. Classes that agree in a least hash meet in blocks of bounded size. A block multiplies its incidence matrix row by
   row, accumulates overlap counts, drops pairs under the bound that the two sizes imply, and skips pairs that are
   connected already. This finds most links inside groups of copies at a cost linear in the group.
2. What remains is done exactly. In an order of n-grams from rare to frequent, two linked sets share one of their first
   n - ceil(0.85 n) + 1 n-grams, so only that part of the incidence matrix is multiplied, only for n-grams that several
   components share, hot ones in blocks. Overlaps are added up per pair; pairs that cannot reach the bound with
   what lies beyond the parts are discarded, and the rest is verified on whole sets.

Any order of n-grams gives the same links; frequencies only make it fast, so they may be estimates. Tables that grow with the
input are merge joined to texts and first parts at every size, not broadcast while they are small.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, free_memory, narrowed, slices, text_of
from .components import components
from .shingles import fingerprint, least_hashes, shingle_sets

#: Documents, and n-grams of all of them, in a block of step 1.
BLOCK_DOCUMENTS, BLOCK_GRAMS = 1000, 1_500_000
LEAST_HASHES = 4
#: An n-gram counts as frequent from this many occurrences, and from 2^-20 of all (so there are at most 2^20 of them).
FREQUENT, FREQUENT_SHARE = 16, 1 << 20
SLICE = 2 << 20
#: N-grams with more postings than this are multiplied inside tasks; they come in blocks of so many documents.
PAIRED, PRODUCT_DOCUMENTS, PRODUCT_GRAMS = 32, 2000, 500_000
#: Share of documents (one in ...) whose first parts correct the estimated counts, and how often.
SAMPLE, CORRECTIONS = 8, 2
#: Bits of the filter of shared n-grams, and of the number of its parts.
FILTER_BITS, FILTER_PART_BITS = 27, 7


def enough(overlap, a, b, percent: int):
    return 100 * overlap >= percent * (a + b - overlap)


def set_table(documents: DataFrame, n: int) -> DataFrame:
    """doc_id, size of the shingle set, its 128-bit fingerprint (k1, k2) and its least hashes; map-only."""

    def run(batches):
        for batch in slices(batches, "text", SLICE):
            sets = shingle_sets(text_of(batch), n)
            marks = [(*fingerprint(s), least_hashes(s, LEAST_HASHES)) if len(s) else (0, 0, []) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array([m[0] for m in marks], pa.int64()), pa.array([m[1] for m in marks], pa.int64()), pa.array([m[2] for m in marks], pa.list_(pa.int64()))],
                ["doc_id", "size", "k1", "k2", "least"],
            )

    return documents.mapInArrow(run, "doc_id long, size long, k1 long, k2 long, least array<long>")


def block_links(ids: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links that connect what the block's links connect: at most one less than its documents.

    Row by row, overlaps with all later documents are accumulated from the block's postings (n-gram to documents).
    """
    m = len(ids)
    sizes = np.array([len(s) for s in sets], np.int64)
    flat, rows = np.concatenate(sets), np.repeat(np.arange(m), sizes)
    order = np.argsort(flat, kind="stable")
    grams, docs = flat[order], rows[order]
    heads = np.flatnonzero(np.concatenate([[True], grams[1:] != grams[:-1]]))
    counts = np.diff(np.append(heads, len(grams)))
    run_of = np.empty(len(grams), np.int64)
    run_of[order] = np.repeat(np.arange(len(heads)), counts)  # of each entry of ``flat``, its n-gram's run
    bounds, group, links = np.concatenate([[0], np.cumsum(sizes)]), np.arange(m), []
    for i in range(m):
        if (group == group[i]).all():
            break
        runs = run_of[bounds[i] : bounds[i + 1]]
        runs = runs[counts[runs] > 1]
        if not len(runs):
            continue
        spans = counts[runs]
        at = np.arange(spans.sum()) + np.repeat(heads[runs] - (np.cumsum(spans) - spans), spans)
        overlap = np.bincount(docs[at], minlength=m)
        near = np.flatnonzero(enough(overlap, sizes, sizes[i], percent) & (group != group[i]))
        for j in near.tolist():
            if group[j] != group[i]:
                links.append((int(ids[i]), int(ids[j])))
                group[group == group[j]] = group[i]
    return links


def _done_with(table: pa.Table) -> None:
    """Large groups' memory goes back to the system before the next one comes."""
    if table.num_rows >= 200:
        free_memory()


def _blocks(classes: DataFrame) -> DataFrame:
    """doc_id and keys (i, h, b): the blocks of each class that agrees in a least hash with others.

    Near copies mostly agree in several least hashes, so the same classes would meet in several blocks: of single
    blocks with the same members one stays.
    """
    keys = classes.select("rep", "size", F.posexplode("least").alias("i", "h"))
    members = [F.count("*").alias("n"), F.sum("size").alias("grams"), F.bit_xor(F.xxhash64("rep")).alias("m"), F.bit_xor(F.xxhash64("rep", F.lit(1))).alias("m2")]
    counts = keys.groupBy("i", "h").agg(*members).filter("n > 1")
    counts = counts.withColumn("blocks", F.greatest(F.ceil(F.col("n") / BLOCK_DOCUMENTS), F.ceil(F.col("grams") / BLOCK_GRAMS)))
    counts = counts.withColumn("big", F.when(F.col("blocks") > 1, F.struct("i", "h")))
    counts = counts.groupBy("n", "m", "m2", "big", "blocks").agg(F.min(F.struct("i", "h")).alias("key")).select("key.*", "blocks")
    members = keys.join(counts, ["i", "h"]).select("rep", F.struct("i", "h", F.pmod(F.xxhash64("rep", "i"), "blocks").alias("b")).alias("key"))
    wanted = members.groupBy(F.col("rep").alias("doc_id")).agg(F.collect_list("key").alias("keys"))  # at most LEAST_HASHES
    return cut(wanted, "join-blocks")


def _copies(documents: DataFrame, wanted: DataFrame, n: int, percent: int) -> DataFrame:
    """Step 1: links (a, b) inside blocks (``wanted``); every pair of a block is connected by them or is no link."""
    rows = narrowed(documents, "doc_id", wanted).join(wanted.hint("merge"), "doc_id").select("doc_id", "text", F.explode("keys").alias("key")).select("doc_id", "text", "key.*")

    def run(table: pa.Table) -> pa.Table:
        ids, at = np.unique(table["doc_id"].to_numpy(), return_index=True)
        rows = table.select(["text"]).take(pa.array(at)).combine_chunks().to_batches()
        parts = rows if table.nbytes < 2 * SLICE else slices(rows, "text", SLICE)
        links = block_links(ids, [x for part in parts for x in shingle_sets(text_of(part), n)], percent) if len(ids) > 1 else []
        _done_with(table)
        return pa.table({"a": pa.array([x for x, _ in links], pa.int64()), "b": pa.array([y for _, y in links], pa.int64())})

    return rows.groupBy("i", "h", "b").applyInArrow(run, "a long, b long")


def frequent(documents: DataFrame, n: int, total: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted frequent n-grams and their (under)estimated counts: those that repeat within slices of the input.

    At most FREQUENT_SHARE rows reach the driver: an n-gram must have that share of all ``total`` occurrences at least.
    """

    def run(batches):
        for batch in slices(batches, "text", 2 * SLICE):
            grams, counts = np.unique(np.concatenate([np.zeros(0, np.uint64), *shingle_sets(text_of(batch), n)]), return_counts=True)
            some = counts > 2
            yield pa.RecordBatch.from_arrays([pa.array(grams[some].view(np.int64)), pa.array(counts[some])], ["gram", "n"])

    least = max(FREQUENT, -(-total // FREQUENT_SHARE))
    found = documents.select("text").mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)
    rows = found.toPandas()
    grams, counts = rows["gram"].to_numpy(np.int64).view(np.uint64), rows["n"].to_numpy(np.int64)
    order = np.argsort(grams)
    return grams[order], counts[order]


def first_parts(documents: DataFrame, n: int, percent: int, common: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """doc_id and the first n-grams of its set, rare ones first; map-only."""
    shared = documents.sparkSession.sparkContext.broadcast(common)

    def run(batches):
        grams, counts = shared.value
        for batch in slices(batches, "text", SLICE):
            out = []
            for s in shingle_sets(text_of(batch), n):
                k = len(s) - -(-percent * len(s) // 100) + 1 if len(s) else 0
                if len(grams) and k:
                    at = np.minimum(np.searchsorted(grams, s), len(grams) - 1)
                    often = np.where(grams[at] == s, counts[at], 0)
                    s = s[np.lexsort((s, often))]
                out.append(s[:k])
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in out])]).astype(np.int32)
            flat = np.concatenate([np.zeros(0, np.uint64), *out])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.ListArray.from_arrays(offsets, pa.array(flat.view(np.int64)))], ["doc_id", "grams"])

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id long, grams array<long>")


def corrected(documents: DataFrame, labelled: DataFrame, n: int, percent: int, common: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """``common`` and those n-grams that several components of a sample share in their first parts, with their counts.

    ``frequent`` misses n-grams that are spread thinly over its slices; they would stay in the first parts and form pairs
    there. Counts only order n-grams, so a sample of one document in SAMPLE is enough; all links are found with any
    counts. At most FREQUENT_SHARE rows reach the driver: the least count is the least power of two that allows it.
    """
    chosen = F.expr(f"pmod(xxhash64(doc_id, 7), {SAMPLE}) = 0")
    parts = first_parts(documents.filter(chosen), n, percent, common).join(labelled.filter(chosen).select("doc_id", "component").hint("merge"), "doc_id")
    grams = parts.select("component", F.explode("grams").alias("gram")).groupBy("gram").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("n"))
    found = cut(grams.filter("lo != hi").select("gram", "n"), "join-often")
    level = F.floor(F.log2("n")).cast("int")
    least, rows = 0, 0
    for power, here in sorted(found.groupBy(level.alias("level")).count().collect(), reverse=True):
        rows += here
        if rows > FREQUENT_SHARE:
            least = 1 << (power + 1)
            break
    more = found.filter(F.col("n") >= least).toPandas()
    grams = np.concatenate([common[0], more["gram"].to_numpy(np.int64).view(np.uint64)])
    counts = np.concatenate([common[1], more["n"].to_numpy(np.int64) * SAMPLE])
    order = np.lexsort((-counts, grams))  # of one n-gram's estimates the largest comes first
    kept, at = np.unique(grams[order], return_index=True)
    return kept, counts[order][at]


def gram_filter(grams: DataFrame) -> np.ndarray:
    """FILTER_BITS bits, one for each value of an n-gram's first bits, set for those of ``grams`` (gram): 16 MB, whatever their number.

    With many more n-grams than bits it only saves less. It is built in parts, which alone reach the driver."""
    rest = FILTER_BITS - FILTER_PART_BITS

    def run(table: pa.Table) -> pa.Table:
        bits = np.zeros(1 << rest, bool)
        bits[table["place"].to_numpy()] = True
        return pa.table({"part": table["part"].combine_chunks()[:1], "bits": pa.array([zlib.compress(np.packbits(bits).tobytes(), 1)], pa.binary())})

    first = F.shiftrightunsigned("gram", 64 - FILTER_BITS)
    places = grams.select(F.shiftrightunsigned(first, rest).cast("int").alias("part"), first.bitwiseAND(F.lit((1 << rest) - 1)).cast("int").alias("place"))
    out = np.zeros((1 << FILTER_PART_BITS, 1 << rest >> 3), np.uint8)
    for r in places.distinct().groupBy("part").applyInArrow(run, "part int, bits binary").collect():
        out[r["part"]] = np.frombuffer(zlib.decompress(r["bits"]), np.uint8)
    return out.reshape(-1)


def _held(parts: DataFrame, bits: np.ndarray) -> DataFrame:
    """doc_id, place, gram: the postings of ``parts`` whose n-gram may be one of the filter's; map-only."""
    shared = parts.sparkSession.sparkContext.broadcast(bits)

    def run(batches):
        held = shared.value
        for batch in batches:
            lists = batch.column("grams")
            lengths = pc.list_value_length(lists).to_numpy()
            flat = lists.flatten().to_numpy()
            place = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            at = (flat.view(np.uint64) >> np.uint64(64 - FILTER_BITS)).astype(np.int64)
            keep = np.flatnonzero((held[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1)
            docs = np.repeat(batch.column("doc_id").to_numpy(), lengths)
            yield pa.RecordBatch.from_arrays([pa.array(docs[keep]), pa.array(place[keep].astype(np.int32)), pa.array(flat[keep])], ["doc_id", "place", "gram"])
        free_memory()

    return parts.select("doc_id", "grams").mapInArrow(run, "doc_id long, place int, gram long")


def _products(parts: DataFrame, live: DataFrame, marks: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of documents that share a hot n-gram (``live``: gram, doc_id, block, blocks) and may be linked.

    A task multiplies the incidence rows of two blocks of an n-gram's documents, restricted to their first parts, and
    emits only pairs whose overlap can still reach the bound. A pair may come from several n-grams.
    """
    wanted = cut(live.select("doc_id").distinct(), "join-ids")
    rows = narrowed(parts.select("doc_id", "grams"), "doc_id", wanted).join(marks, "doc_id")
    rows = live.select("gram", "doc_id", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")).join(rows, "doc_id")
    rows = rows.select("gram", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "doc_id", "component", "size", "grams", "tags")

    def run(table: pa.Table) -> pa.Table:
        links = product_pairs(table.sort_by("doc_id"), table["i"][0].as_py(), table["j"][0].as_py(), percent)
        _done_with(table)
        return pa.table({"a": pa.array([x for x, _ in links], pa.int64()), "b": pa.array([y for _, y in links], pa.int64())})

    return rows.groupBy("gram", "i", "j").applyInArrow(run, "a long, b long").distinct()


def product_pairs(table: pa.Table, i: int, j: int, percent: int) -> list[tuple[int, int]]:
    """Pairs between blocks i and j of ``table`` that overlaps of their first parts do not rule out."""
    ids, component, sizes, block = (table[c].to_numpy().astype(np.int64) for c in ("doc_id", "component", "size", "block"))
    tags = [set(t) for t in table["tags"].to_pylist()]
    lists = table["grams"].combine_chunks()
    lengths = np.diff(lists.offsets.to_numpy()).astype(np.int64)
    flat, m = lists.flatten().to_numpy(), len(ids)
    bounds = np.concatenate([[0], np.cumsum(lengths)])
    rows, places = np.repeat(np.arange(m), lengths), np.arange(len(flat)) - np.repeat(bounds[:-1], lengths)
    order = np.argsort(flat, kind="stable")
    docs, at_place = rows[order], places[order]
    heads = np.flatnonzero(np.concatenate([[True], flat[order][1:] != flat[order][:-1]]))
    counts = np.diff(np.append(heads, len(flat)))
    run_of = np.empty(len(flat), np.int64)
    run_of[order] = np.repeat(np.arange(len(heads)), counts)
    beyond, out = sizes - lengths, []
    for r in np.flatnonzero(block == i).tolist():
        runs = run_of[bounds[r] : bounds[r + 1]]
        spans = counts[runs]
        at = np.arange(spans.sum()) + np.repeat(heads[runs] - (np.cumsum(spans) - spans), spans)
        overlap = np.bincount(docs[at], minlength=m)
        mine, theirs = np.zeros(m, np.int64), np.zeros(m, np.int64)  # last shared places
        np.maximum.at(mine, docs[at], np.repeat(np.arange(len(runs)), spans))
        np.maximum.at(theirs, docs[at], at_place[at])
        after = np.minimum(sizes[r] - mine - 1, sizes - theirs - 1)
        most = overlap + np.minimum(after, np.maximum(beyond, beyond[r]))
        near = (overlap > 0) & (block == j) & (component != component[r]) & enough(most, sizes, sizes[r], percent)
        if i == j:
            near &= ids > ids[r]
        out += [(int(min(ids[r], ids[k])), int(max(ids[r], ids[k]))) for k in np.flatnonzero(near).tolist() if tags[r].isdisjoint(tags[k])]
    return out


def _rest(documents: DataFrame, classes: DataFrame, blocks: DataFrame, found: DataFrame, n: int, percent: int) -> DataFrame:
    """Step 2: all links (a, b) between classes of different components of step 1 (``found``: id, component)."""
    labelled = classes.join(found.select(F.col("id").alias("rep"), "component"), "rep", "left")
    labelled = cut(labelled.select(F.col("rep").alias("doc_id"), F.coalesce("component", "rep").alias("component"), "size"), "join-labels")
    total = int(classes.agg(F.sum("size")).first()[0] or 0)
    common = frequent(documents, n, total)
    for _ in range(CORRECTIONS):
        common = corrected(documents, labelled, n, percent, common)
    parts = first_parts(documents, n, percent, common).join(labelled.select("doc_id", "component").hint("merge"), "doc_id")
    parts = cut(parts.select("doc_id", "component", "grams"), "join-parts")
    postings = parts.select("doc_id", "component", F.posexplode("grams").alias("place", "gram"))
    per = postings.groupBy("gram").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("n")).filter("lo != hi")
    per = cut(per.select("gram", (F.col("n") > PAIRED).alias("hot")), "join-shared")
    live = cut(_held(parts, gram_filter(per)).join(per, "gram"), "join-live")
    tags = blocks.select("doc_id", F.transform("keys", lambda k: F.xxhash64(k["i"], k["h"], k["b"])).alias("tags"))
    marks = labelled.join(tags, "doc_id", "left").withColumn("tags", F.coalesce("tags", F.array().cast("array<long>")))
    # blocks of a hot n-gram's documents: bounded in documents and in the n-grams of their first parts
    often = live.filter("hot").select("gram", "doc_id")
    length = F.sum((100 - percent) * F.col("size") / 100 + 1)
    blocks_of = often.join(labelled.select("doc_id", "size"), "doc_id").groupBy("gram").agg(
        F.greatest(F.ceil(F.count("*") / PRODUCT_DOCUMENTS), F.ceil(length / PRODUCT_GRAMS)).cast("int").alias("blocks"))
    often = often.join(blocks_of, "gram").withColumn("block", F.pmod(F.xxhash64("doc_id"), "blocks").cast("int"))
    hot = cut(_products(parts, often, marks, percent), "join-pairs")
    live = live.filter("NOT hot").join(marks, "doc_id")
    side = lambda c: live.select("gram", F.col("doc_id").alias(c), F.col("component").alias(f"c{c}"), F.col("size").alias(f"s{c}"), F.col("place").alias(f"p{c}"), F.col("tags").alias(f"t{c}"))
    x, y = side("a"), side("b")
    # pairs that met in a block of step 1 are settled; sizes: 100 * min >= percent * max
    pairs = x.join(y, "gram").filter(
        (F.col("ca") != F.col("cb")) & ~F.arrays_overlap("ta", "tb") & (F.col("a") < F.col("b"))
        & (100 * F.least("sa", "sb") >= percent * F.greatest("sa", "sb"))
        & (F.least("pa", "pb") + 1 + F.least(F.col("sa") - F.col("pa") - 1, F.col("sb") - F.col("pb") - 1) >= F.ceil(percent * (F.col("sa") + F.col("sb")) / F.lit(100 + percent)))
    )
    # overlap of the two parts, and the most that can follow: what lies beyond the last shared place of either set, and
    # beyond the part that ends first (n-grams up to there are counted in full); which part that is, is not known
    beyond = lambda size: F.ceil(percent * F.col(size) / F.lit(100)) - 1
    pairs = pairs.select(
        F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.least(F.col("sa") - F.col("pa") - 1, F.col("sb") - F.col("pb") - 1).alias("after"),
        F.greatest(beyond("sa"), beyond("sb")).alias("beyond"), F.ceil(percent * (F.col("sa") + F.col("sb")) / F.lit(100 + percent)).alias("bound"),
    )
    pairs = pairs.groupBy("a", "b").agg(F.count("*").alias("overlap"), F.min("after").alias("after"), F.max("beyond").alias("beyond"), F.max("bound").alias("bound"))
    # a pair that also shares hot n-grams may be dropped here: the products, which see its whole parts, decide on it
    pairs = cut(pairs.filter("overlap + least(after, beyond) >= bound").select("a", "b").union(hot).distinct(), "join-pairs")
    for bits in (16, 64):  # folded n-grams give a bound on the overlap at a quarter of the bytes
        pairs = _verified(documents, pairs, n, percent, bits)
        pairs = cut(pairs, "join-pairs") if bits < 64 else pairs
    return pairs


def _verified(documents: DataFrame, pairs: DataFrame, n: int, percent: int, bits: int) -> DataFrame:
    """Pairs (a, b) whose sets reach the bound, with n-grams folded to ``bits`` bits (64: exactly).

    Folded sets are compared as multisets, whose overlap is never less than that of the sets.
    """
    kind = {16: np.uint16, 64: np.uint64}[bits]
    wanted = cut(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "join-ids")

    def grams(batches):
        for batch in slices(batches, "text", SLICE):
            sets = shingle_sets(text_of(batch), n)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([np.sort(s.astype(kind)).tobytes() for s in sets], pa.binary())], ["doc_id", "grams"])

    found = narrowed(documents, "doc_id", wanted).join(wanted, "doc_id").mapInArrow(grams, "doc_id long, grams binary")
    found = cut(found, "join-sets")
    both = pairs.join(found.select(F.col("doc_id").alias("a"), F.col("grams").alias("ga")), "a").join(found.select(F.col("doc_id").alias("b"), F.col("grams").alias("gb")), "b")

    def verify(batches):
        for batch in batches:
            keep = []
            for ga, gb in zip(batch.column("ga"), batch.column("gb"), strict=True):
                s, t = np.frombuffer(ga.as_buffer(), kind), np.frombuffer(gb.as_buffer(), kind)
                both = np.sort(np.concatenate([_numbered(s), _numbered(t)])) if bits < 64 else np.sort(np.concatenate([s, t]))
                keep.append(enough(int((both[1:] == both[:-1]).sum()), len(s), len(t), percent))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))
        free_memory()

    return both.select("a", "b", "ga", "gb").mapInArrow(verify, "a long, b long")


def _numbered(values: np.ndarray) -> np.ndarray:
    """Sorted values to numbers that also tell first, second, ... occurrences apart."""
    heads = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.zeros(0, np.int64)
    nth = np.arange(len(values)) - np.repeat(heads, np.diff(np.append(heads, len(values))))
    return values.astype(np.int64) + (nth.astype(np.int64) << 16)


def join(documents: DataFrame, n: int = 4, percent: int = 85) -> DataFrame:
    """One row per document: doc_id, n_shingles, class_id (least doc_id with the same set) and component_id.

    component_id is the least doc_id that links reach. Null, empty and blank texts have empty sets, link with nothing
    and are alone. Rows with a null doc_id get null ids and link with nothing. Repeated rows give a row each; doc_id is
    taken to name one text. Other columns are ignored; an empty table gives no rows. No pair list is returned: groups
    of copies are held together by at most one link per class.
    """
    documents = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sets = cut(set_table(documents, n), "join-sets")
    some = sets.filter("size > 0 AND doc_id IS NOT NULL")
    classes = cut(some.groupBy("size", "k1", "k2").agg(F.min("doc_id").alias("rep"), F.first("least").alias("least")), "join-classes")
    blocks = _blocks(classes)
    first = cut(_copies(documents, blocks, n, percent), "join-links")
    early = cut(components(first), "join-early")
    rest = cut(_rest(documents, classes, blocks, early, n, percent), "join-links")
    # what is left: components of the components that step 2 links
    label = early.select(F.col("id").alias("x"), "component")
    lift = lambda df, c: df.join(label.select(F.col("x").alias(c), F.col("component").alias(f"c{c}")), c, "left").withColumn(c, F.coalesce(f"c{c}", c)).drop(f"c{c}")
    late = components(lift(lift(rest, "a"), "b")).withColumnRenamed("component", "late")
    final = early.join(late.select(F.col("id").alias("component"), "late"), "component", "left").select("id", F.coalesce("late", "component").alias("component"))
    only_late = late.select("id", F.col("late").alias("component")).join(early.select("id"), "id", "left_anti")
    reached = final.union(only_late)
    per_class = classes.join(reached.withColumnRenamed("id", "rep"), "rep", "left").select("size", "k1", "k2", F.col("rep").alias("class_id"), F.coalesce("component", "rep").alias("component_id"))
    named = sets.join(per_class, ["size", "k1", "k2"], "left").withColumn("alone", (F.col("size") == 0) | F.col("doc_id").isNull())
    return named.select(
        "doc_id", F.col("size").alias("n_shingles"), F.when(F.col("alone"), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.when(F.col("alone"), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id")
    )
