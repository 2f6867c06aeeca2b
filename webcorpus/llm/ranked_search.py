"""Operator 13: ranked lexical search by pipelined term partitioning.

Terms belong to STAGES owners, rare ones to the first, common ones to the last, each with about the same mass of postings.
Documents lie in shards. For each shard, a bundle of items passes the owners one after another: at each, a cogroup meets the bundle with that owner's
postings of the shard, and integer contributions are added to the bundle's sparse document accumulators. What the
later owners can add at most is known per shard, so a document that cannot reach the shard's 50th best partial score of an item any more leaves
the accumulators; it could not be among the item's best. The best of every shard are merged at the end.
"""

from __future__ import annotations

import pickle
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, slices, split_words, text_of
from .vectors import part

#: Owners of terms, documents of a shard, items of a bundle, hash buckets of terms.
STAGES, SHARD_DOCS, BUNDLE_ITEMS, BUCKETS = 4, 16384, 256, 1 << 20
#: Bytes of terms, A-Z in lower case; all others are blanks.
_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
_TABLE = np.frombuffer(_BYTES, np.uint8)
PART = 1000


def terms(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Terms of every text in one array, and the row offsets into it (empty strings at the ends of texts are none)."""
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data else np.zeros(0, np.uint8)
    clean = pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer((offsets - offsets[0]).astype(np.int64)), pa.py_buffer(_TABLE[raw]))
    return split_words(clean)


def bucket(term: str) -> int:
    return zlib.crc32(term.encode()) % BUCKETS


def counted(batches, wanted: np.ndarray | None, key: str):
    """Per row: key, n (its terms), and its distinct terms whose bucket is wanted, with their counts."""
    for batch in batches:
        for some in slices([batch], "text"):
            offsets, tokens = terms(text_of(some))
            rows = some.num_rows
            encoded = tokens.dictionary_encode()
            names = encoded.dictionary.to_pylist()
            code = encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            row = np.repeat(np.arange(rows), np.diff(offsets))
            real = np.fromiter((x != "" for x in names), bool, len(names))
            n = np.bincount(row[real[code]], minlength=rows) if len(code) else np.zeros(rows, np.int64)
            keep = real if wanted is None else np.fromiter((x != "" and wanted[bucket(x)] for x in names), bool, len(names))
            held = keep[code] if len(code) else np.zeros(0, bool)
            pair, tf = np.unique(row[held] * max(1, len(names)) + code[held], return_counts=True)
            ends = np.concatenate([[0], np.cumsum(np.bincount(pair // max(1, len(names)), minlength=rows))]).astype(np.int32)
            found = encoded.dictionary.take(pa.array(pair % max(1, len(names)))).cast(pa.string())
            lists = [pa.ListArray.from_arrays(pa.array(ends), v) for v in (found, pa.array(tf.astype(np.int64)))]
            yield pa.RecordBatch.from_arrays([some.column(key), pa.array(n.astype(np.int64)), *lists], [key, "n", "terms", "tfs"])


def owners(postings: dict[int, int]) -> np.ndarray:
    """Owner of each bucket of terms: rising numbers of postings, the same mass for each owner."""
    out = np.zeros(BUCKETS, np.uint8)
    at = np.array(sorted(postings, key=lambda b: (postings[b], b)), np.int64)
    mass = np.cumsum([postings[b] for b in at.tolist()])
    out[at] = np.minimum(STAGES - 1, (mass - 1) * STAGES // max(1, mass[-1])) if len(at) else 0
    return out


def index_shard(table: pa.Table, owner: np.ndarray, n_docs: int, all_terms: int) -> pa.Table:
    """One row per owner: postings of its terms (places of documents and tf parts), and the most that later owners' terms have here."""
    ids = table["doc_id"].combine_chunks()
    m = 50 + np.array([(50 * n * n_docs) // all_terms for n in table["n"].to_pylist()], np.int64)
    lists = table["terms"].combine_chunks()
    doc = np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy())
    tf = table["tfs"].combine_chunks().flatten().to_numpy()
    encoded = lists.flatten().dictionary_encode()
    names, code = encoded.dictionary.to_pylist(), encoded.indices.to_numpy(zero_copy_only=False)
    share = (1_000_000_000 * tf) // (1000 * tf + 20 * m[doc])
    order = np.argsort(code, kind="stable")
    ends = np.cumsum(np.bincount(code, minlength=len(names)))
    starts = ends - np.diff(np.concatenate([[0], ends]))
    most = np.maximum.reduceat(share[order], starts) if len(names) else np.zeros(0, np.int64)
    whose = np.array([owner[bucket(x)] for x in names], np.int64)
    out = []
    for s in range(STAGES):
        held = np.flatnonzero(whose == s).tolist()
        lists_ = {names[k]: (doc[order[starts[k] : ends[k]]].astype(np.int32), share[order[starts[k] : ends[k]]].astype(np.int32)) for k in held}
        later = {names[k]: int(most[k]) for k in np.flatnonzero(whose > s).tolist()}
        out.append(pickle.dumps((lists_, later, ids.to_pylist() if s == STAGES - 1 else None, len(ids)), protocol=5))
    shard = table["shard"].combine_chunks()[:1].to_pylist() * STAGES
    return pa.table({"shard": pa.array(shard, pa.int32()), "stage": pa.array(range(STAGES), pa.int32()), "postings": pa.array(out, pa.binary())})


def visit(plan: bytes, held: bytes | None, postings: bytes, best: int):
    """Accumulators (item, document, score; rising) of a bundle after one owner, those that can still reach the item's ``best``; the owner's documents."""
    plan, (lists, later, ids, n) = pickle.loads(plan), pickle.loads(postings)
    acc = np.zeros((len(plan), n), np.int64)
    if held is not None:
        item, doc, score = pickle.loads(held)
        acc[item, doc] = score
    items, docs, scores = [], [], []
    for k, (_, weights) in enumerate(plan):
        ahead = 0
        for term, w in weights:
            if term in lists:
                doc, share = lists[term]
                acc[k, doc] += w * share.astype(np.int64)
            else:
                ahead += w * later.get(term, 0)
        on = np.flatnonzero(acc[k])
        if len(on) > best:
            values = acc[k, on]
            least = np.partition(values, len(on) - best)[len(on) - best]
            on = on[values + ahead >= least]
        items.append(np.full(len(on), k, np.int32))
        docs.append(on.astype(np.int32))
        scores.append(acc[k, on])
    return plan, [np.concatenate(x) if x else np.zeros(0, np.int64) for x in (items, docs, scores)], ids


def _owner(stage: int, best: int):
    """The cogroup of a stage: a bundle in a shard meets the owner's postings and goes on, from the last owner as its best documents."""
    last = stage == STAGES - 1

    def pass_on(left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["item_id", "doc_id", "place", "score"] if last else ["shard", "bundle", "plan", "held"]
        kinds = [pa.int64()] * 4 if last else [pa.int32(), pa.int32(), pa.binary(), pa.binary()]
        rows: list[list] = [[], [], [], []]
        if left.num_rows and right.num_rows:
            items, (item, doc, score), ids = visit(left["plan"][0].as_py(), left["held"][0].as_py(), right["postings"][0].as_py(), best)
            if last:
                order = np.lexsort((doc, [ids[d] if ids[d] is not None else 1 << 62 for d in doc.tolist()], -score, item))
                first = np.searchsorted(item[order], item[order], "left")
                order = order[np.arange(len(order)) - first < best]
                rows = [[items[k][0] for k in item[order].tolist()], [ids[d] for d in doc[order].tolist()], doc[order].tolist(), score[order].tolist()]
            else:
                rows = [left[c][:1].to_pylist() for c in ("shard", "bundle", "plan")] + [[pickle.dumps((item, doc, score), protocol=5)]]
        return pa.table([pa.array(v, k) for v, k in zip(rows, kinds, strict=True)], names=names)

    return pass_on


def rank(documents: DataFrame, items: DataFrame, best: int = 50) -> DataFrame:
    """item_id, rank (from 1), doc_id, score: of each row of ``items`` (item_id, text) its ``best`` documents (doc_id, text) with score above 0.

    Terms are runs of ASCII digits and letters and of characters beyond ASCII, A-Z lower-cased; null and empty texts have none. A term's weight is
    floor(1000 ln((2N + 2) / (2 df + 1))) over the N documents with a term; a document's score sums, over the item's distinct
    terms, weight * ((10^9 tf) div (1000 tf + 20 m)) with m = 50 + (50 n N) div L. Equal scores: smaller doc_id first, null ids last. All counts are over
    all documents and whole texts; sums are 64-bit. Rows of ``items`` that share an id (or have none) are one item with the terms
    of all; repeated rows of ``documents`` are documents of their own. Items without a match, empty tables: no rows. Other columns are ignored.
    """
    spark = documents.sparkSession
    empty = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    asked = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    asked = asked.mapInArrow(lambda b: counted(b, None, "item_id"), "item_id long, n long, terms array<string>, tfs array<long>")
    asked = cut(asked.select("item_id", F.explode("terms").alias("term")).distinct(), "rank-items")
    hashed = lambda c: (F.crc32(F.encode(c, "UTF-8")) % BUCKETS).cast("int")
    wanted = np.zeros(BUCKETS, bool)
    wanted[[r.b for r in asked.select(hashed("term").alias("b")).distinct().collect()]] = True
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    docs = docs.mapInArrow(lambda b: counted(b, wanted, "doc_id"), "doc_id long, n long, terms array<string>, tfs array<long>")
    docs = cut(docs.filter("n > 0").withColumn("row", F.monotonically_increasing_id()), "rank-documents")
    size = docs.agg(F.count("*").alias("n"), F.sum("n").alias("all"), F.count_if(F.size("terms") > 0).alias("some")).first()
    if not size.n or not size.some:
        return empty
    df = cut(docs.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df")), "rank-terms")
    owner = owners({r.b: r.n for r in df.groupBy(hashed("term").alias("b")).agg(F.sum("df").alias("n")).collect()})
    n_docs, all_terms = size.n, size["all"]
    shards = -(-size.some // SHARD_DOCS)
    index = docs.filter(F.size("terms") > 0).select(part("row", shards).alias("shard"), "doc_id", "n", "terms", "tfs")
    index = cut(index.groupBy("shard").applyInArrow(lambda t: index_shard(t, owner, n_docs, all_terms), "shard int, stage int, postings binary"), "rank-index")

    weight = F.floor(F.lit(1000.0) * F.log((2.0 * n_docs + 2.0) / (2.0 * F.col("df") + 1.0))).cast("long")
    weighed = asked.join(df, "term").select("item_id", "term", weight.alias("w")).filter("w > 0")
    n_items = asked.select("item_id").distinct().count()
    bundles = -(-n_items // BUNDLE_ITEMS)
    bundled = weighed.withColumn("bundle", part("item_id", bundles))

    def plan(table: pa.Table) -> pa.Table:
        found: dict = {}
        for item, term, w in sorted(zip(*[table[c].to_pylist() for c in ("item_id", "term", "w")], strict=True), key=lambda x: (x[0] is None, x)):
            found.setdefault(item, []).append((term, w))
        blob = pickle.dumps(list(found.items()), protocol=5)
        return pa.table({"bundle": table["bundle"].combine_chunks()[:1], "plan": pa.array([blob], pa.binary())})

    bundled = cut(bundled.groupBy("bundle").applyInArrow(plan, "bundle int, plan binary"), "rank-bundles")
    moving = bundled.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), "bundle", "plan", F.lit(None).cast("binary").alias("held"))
    for stage in range(STAGES):
        here = index.filter(F.col("stage") == stage).select("shard", F.explode(F.sequence(F.lit(0), F.lit(bundles - 1))).alias("bundle"), "postings")

        schema = "item_id long, doc_id long, place long, score long" if stage == STAGES - 1 else "shard int, bundle int, plan binary, held binary"
        moving = moving.groupBy("shard", "bundle").cogroup(here.groupBy("shard", "bundle")).applyInArrow(_owner(stage, best), schema)
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"), "place")
    return moving.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= best).select("item_id", "rank", "doc_id", "score")
