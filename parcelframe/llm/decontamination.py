"""Benchmark decontamination by a distributed positional inverted index.

* Index: training texts are dealt into shards of about ``SHARD`` bytes (whole
  documents). A shard's row holds its distinct terms in order, each term's
  number of postings, and the positions of all tokens by term. The index is
  written once; it knows nothing of the benchmark and serves any test set.
* Terms: the distinct windows of the test items (``WINDOW`` consecutive words;
  a shorter item is one window) are taken in blocks of at most
  ``MOST_WINDOWS``. One pass over the terms column counts each test term in the
  whole corpus.
* Search: in every shard, a window's candidates are the positions of its rarest
  term, less the term's offset; the offset-adjusted list of the next rarest
  term is intersected with them, and so on to the most frequent. What remains
  are exact occurrences of the phrase. Proximity: the same anchors, where every
  other term has a posting within ``SLOP`` words of them in the same document.
* Rows: occurrences join the items of their windows; spans of hit words are
  united over blocks.

Terms are 64-bit hashes of words; a false phrase would need ten collisions.

Skew: shards are bounded by bytes, so no term's list is ever gathered; a passage
that many documents share is found in each shard by itself.

Defined results: null and empty texts have no words and no hits; an item
without words has no window, one without an id is left out; repeated rows each
get a row; repeated item ids count once; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bloom, textarrays as T
from .common import scratch_path, stored

WINDOW, SLOP = 10, 20
SHARD, MOST_WINDOWS = 2 << 20, 1 << 16

INDEX = ("shard long, doc_id array<long>, text_key array<long>, n_words array<long>, "
         "terms binary, postings binary, places binary")
HITS = "shard long, ord int, spans array<struct<a:long,b:long>>, windows array<binary>, near array<binary>"


def build_index(docs: DataFrame) -> DataFrame:
    """The positional index of all rows, written to the shared folder and read back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        for b in batches:
            _, off = T.buffers(b.column("text"))
            at = 0
            while at < b.num_rows:
                end = max(at + 1, int(np.searchsorted(off, off[at] + SHARD, "right")) - 1)
                own = b.slice(at, end - at)
                h, n = T.word_hashes(own.column("text"), T.ALNUM)
                order = np.argsort(h, kind="stable")
                terms, count = np.unique(h, return_counts=True)
                one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
                yield pa.record_batch([pa.array([number], pa.int64()), one(own.column("doc_id")), one(own.column("text_key")),
                                       one(pa.array(n, pa.int64())), pa.array([terms.astype("<u8").tobytes()], pa.binary()),
                                       pa.array([count.astype("<u4").tobytes()], pa.binary()),
                                       pa.array([order.astype("<u4").tobytes()], pa.binary())],
                                      ["shard", "doc_id", "text_key", "n_words", "terms", "postings", "places"])
                number, at = number + 1, end

    rows = docs.select("doc_id", bloom.text_key(F.col("text")).alias("text_key"), "text")
    path = scratch_path(docs.sparkSession, "index")
    rows.mapInArrow(run, INDEX).write.option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.schema(INDEX).parquet(path)


def windows_of(items: DataFrame) -> DataFrame:
    """(item_id, window): each item's distinct windows, as the bytes of their terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h, n = T.word_hashes(b.column("text"), T.ALNUM)
            data, edge = h.astype("<u8").tobytes(), np.concatenate([[0], np.cumsum(n)])
            who, found = [], []
            for i, item in enumerate(b.column("item_id")):
                last = edge[i + 1] - min(WINDOW, n[i])
                own = {data[8 * k:8 * min(k + WINDOW, edge[i + 1])] for k in range(edge[i], last + 1)} if n[i] else set()
                who += [item.as_py()] * len(own)
                found += sorted(own)
            yield pa.record_batch([pa.array(who, pa.int64()), pa.array(found, pa.binary())], ["item_id", "window"])

    own = items.where(F.col("item_id").isNotNull()).select(F.col("item_id").cast("long").alias("item_id"), "text")
    return own.mapInArrow(run, "item_id long, window binary").distinct()


def term_counts(index: DataFrame, terms: np.ndarray) -> np.ndarray:
    """Postings of each of ``terms`` (sorted) in the whole index."""
    held = index.sparkSession.sparkContext.broadcast(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(held.value), np.int64)
        for b in batches:
            for t, c in zip(b.column("terms"), b.column("postings")):
                u, n = np.frombuffer(t.as_buffer(), "<u8"), np.frombuffer(c.as_buffer(), "<u4")
                if len(u):
                    at = np.minimum(np.searchsorted(u, held.value), len(u) - 1)
                    total += np.where(u[at] == held.value, n[at], 0)
        some = np.flatnonzero(total)
        yield pa.record_batch([pa.array(some, pa.int64()), pa.array(total[some], pa.int64())], ["k", "n"])

    out = np.zeros(len(terms), np.int64)
    for r in index.select("terms", "postings").mapInArrow(run, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).collect():
        out[r.k] = r.n
    return out


class Block:
    """Windows of one block: terms rarest first, with their offsets (short windows padded by -1)."""

    def __init__(self, windows: list[bytes], terms: np.ndarray, counts: np.ndarray):
        rows = [np.frombuffer(w, "<u8") for w in windows]
        self.length = np.array([len(r) for r in rows])
        wide = int(self.length.max(initial=1))
        self.term = np.zeros((len(rows), wide), np.uint64)
        self.offset = np.full((len(rows), wide), -1, np.int64)
        for i, r in enumerate(rows):
            n = counts[np.searchsorted(terms, r)]
            order = np.lexsort((np.arange(len(r)), n))
            self.term[i, :len(r)], self.offset[i, :len(r)] = r[order], order
        self.possible = np.array([bool(counts[np.searchsorted(terms, r)].min(initial=1)) for r in rows])
        self.windows = windows


class Shard:
    """One row of the index."""

    def __init__(self, terms, postings, places, n_words):
        self.terms = np.frombuffer(terms, "<u8")
        count = np.frombuffer(postings, "<u4").astype(np.int64)
        self.first = np.concatenate([[0], np.cumsum(count)])
        self.places = np.frombuffer(places, "<u4").astype(np.int64)
        self.key = (np.repeat(np.arange(len(count)), count) << 32) | self.places  # sorted by (term, place)
        self.edge = np.concatenate([[0], np.cumsum(n_words)])

    def number(self, terms: np.ndarray) -> np.ndarray:
        """Each term's number in the shard, -1 where it doesn't occur."""
        if not len(self.terms):
            return np.full(terms.shape, -1)
        at = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        return np.where(self.terms[at] == terms, at, -1)

    def search(self, block: Block) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
        """((window, place) of exact phrases, (window, place) of proximity matches)."""
        number = self.number(block.term)
        real = block.offset >= 0
        live = np.flatnonzero(block.possible & ((number >= 0) | ~real).all(1))
        head = number[live, 0]
        n = self.first[head + 1] - self.first[head]
        window = np.repeat(live, n)
        anchor = self.places[np.repeat(self.first[head], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
        doc = np.searchsorted(self.edge, anchor, "right") - 1
        lo, hi = self.edge[doc], self.edge[doc + 1]
        begin = anchor - block.offset[window, 0]
        phrase = (begin >= lo) & (begin + block.length[window] <= hi)
        near = np.ones(len(window), bool)
        for r in range(1, block.term.shape[1]):
            todo = np.flatnonzero(phrase & real[window, r])
            self._meet(phrase, todo, number[window[todo], r], begin[todo] + block.offset[window[todo], r], 0)
            todo = np.flatnonzero(near & real[window, r])
            self._meet(near, todo, number[window[todo], r], np.maximum(anchor[todo] - SLOP, lo[todo]),
                       np.minimum(anchor[todo] + SLOP, hi[todo] - 1))
        return (window[phrase], begin[phrase]), (window[near], anchor[near])

    def _meet(self, keep: np.ndarray, at: np.ndarray, term: np.ndarray, low: np.ndarray, high) -> None:
        """Of the candidates ``at``, keep those whose term has a posting in [low, high] (0: at low)."""
        if not len(at):
            return
        base = term << 32
        k = np.searchsorted(self.key, base | low)
        found = self.key[np.minimum(k, len(self.key) - 1)]
        keep[at] = (k < len(self.key)) & (found <= (base | (low if np.isscalar(high) else high)))


def search(index: DataFrame, block: Block) -> DataFrame:
    """Documents with matches: merged spans of hit words, windows that occur, windows with proximity matches."""
    held = index.sparkSession.sparkContext.broadcast(block)  # at most MOST_WINDOWS windows
    schema = pa.schema([("shard", pa.int64()), ("ord", pa.int32()),
                        ("spans", pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))),
                        ("windows", pa.list_(pa.binary())), ("near", pa.list_(pa.binary()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blk = held.value
        for b in batches:
            out: list[dict] = []
            for i in range(b.num_rows):
                shard = Shard(b.column("terms")[i].as_buffer(), b.column("postings")[i].as_buffer(), b.column("places")[i].as_buffer(),
                              b.column("n_words")[i].values.to_numpy())
                (w, place), (v, anchor) = shard.search(blk)
                doc, other = (np.searchsorted(shard.edge, x, "right") - 1 for x in (place, anchor))
                order = np.lexsort((place, doc))
                w, place, doc = w[order], place[order], doc[order]
                for d in np.union1d(doc, other):
                    own = slice(*np.searchsorted(doc, [d, d + 1]))
                    spans: list[dict] = []
                    for a, e in zip((place[own] - shard.edge[d]).tolist(), (place[own] - shard.edge[d] + blk.length[w[own]]).tolist()):
                        if spans and a <= spans[-1]["b"]:
                            spans[-1]["b"] = max(spans[-1]["b"], e)
                        else:
                            spans.append({"a": a, "b": e})
                    out.append({"shard": b.column("shard")[i].as_py(), "ord": int(d), "spans": spans,
                                "windows": [blk.windows[k] for k in np.unique(w[own])],
                                "near": [blk.windows[k] for k in np.unique(v[other == d])]})
            yield pa.RecordBatch.from_pylist(out, schema)

    return index.select("shard", "n_words", "terms", "postings", "places").mapInArrow(run, HITS)


def _covered(spans):
    """Words under sorted spans that may overlap."""
    step = lambda s, x: F.struct(F.greatest(s["end"], x["b"]).alias("end"),
                                 (s["n"] + F.greatest(F.lit(0).cast("long"), x["b"] - F.greatest(s["end"], x["a"]))).alias("n"))
    return F.aggregate(F.array_sort(spans), F.struct(F.lit(0).cast("long").alias("end"), F.lit(0).cast("long").alias("n")), step)["n"]


def contamination(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, n_near_items, text_key of every row."""
    index = build_index(docs)
    of_items = stored(windows_of(items), "windows")
    distinct = of_items.select("window").distinct()
    n = distinct.count()
    blocks = max(1, -(-n // MOST_WINDOWS))
    hits = None
    for block in range(blocks):
        own = sorted(bytes(r.window) for r in distinct.where(F.pmod(F.xxhash64("window"), F.lit(blocks)) == block).collect())
        if not own:
            continue
        terms = np.unique(np.frombuffer(b"".join(own), "<u8"))
        found = search(index, Block(own, terms, term_counts(index, terms)))
        hits = found if hits is None else hits.unionByName(found)
    rows = index.select("shard", F.posexplode(F.arrays_zip("doc_id", "text_key", "n_words"))).select(
        "shard", F.col("pos").alias("ord"), "col.doc_id", "col.text_key", "col.n_words")
    if hits is None:
        hits = docs.sparkSession.createDataFrame([], HITS)
    hits = stored(hits, "hits")
    words = hits.groupBy("shard", "ord").agg(_covered(F.flatten(F.collect_list("spans"))).alias("n_hit"))  # a row from each block
    matched = (hits.select("shard", "ord", F.explode("windows").alias("window"), F.lit(True).alias("exact"))
               .unionByName(hits.select("shard", "ord", F.explode("near").alias("window"), F.lit(False).alias("exact")))
               .join(of_items, "window").groupBy("shard", "ord", "item_id").agg(F.max("exact").alias("exact")))
    ids = F.array_sort(F.collect_list(F.when(F.col("exact"), F.col("item_id").cast("string"))))
    by_doc = matched.groupBy("shard", "ord").agg(ids.alias("ids"), F.count("*").alias("n_near_items"))
    no = F.array().cast("array<string>")
    out = rows.join(words, ["shard", "ord"], "left").join(by_doc, ["shard", "ord"], "left")
    ids = F.coalesce("ids", no)
    return out.select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.size(ids).cast("long").alias("n_items"),
                      F.sha2(F.array_join(ids, ",").cast("binary"), 256).alias("items_sha256"),
                      (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
                      F.coalesce("n_near_items", F.lit(0).cast("long")).alias("n_near_items"), "text_key")


def drop_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs`` without a hit, with all columns."""
    found = contamination(docs, items).where("contaminated").select("doc_id", "text_key", F.lit(False).alias("once")).distinct()
    return bloom.without(docs, stored(found, "contaminated"))


ORACLE = r"""
WITH docs AS (SELECT doc_id, row_number() OVER () AS r,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
items AS (SELECT item_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
windows AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + 9], ' ') AS x
    FROM (SELECT item_id, w, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS i FROM items WHERE len(w) > 0)),
lengths AS (SELECT DISTINCT n FROM windows),
grams AS (SELECT r, n, i, array_to_string(w[i:i + n - 1], ' ') AS x
    FROM (SELECT r, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM docs JOIN lengths ON len(w) >= n)),
hits AS (SELECT DISTINCT r, i, g.n, item_id FROM grams g JOIN windows v ON g.n = v.n AND g.x = v.x),
covered AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(generate_series(i, i + n - 1)) AS p FROM hits) GROUP BY r),
found AS (SELECT r, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
    FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS id FROM hits) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
    sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN covered USING (r) LEFT JOIN found USING (r)
"""
