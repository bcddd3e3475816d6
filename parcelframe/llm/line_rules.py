"""Quality rules with cross-document line frequency.

* Measures: one pass over the texts gives each document its base counts and, for
  every different line, a key and the words that it holds. A line is normalised
  (A-Z lower-cased, each digit to 0, white space runs to one space) and hashed
  with its host (``source`` here) to 128 bits, so one key stands for a line of
  one host and equal lines of other hosts count apart.
* Frequency: distinct documents of each key, pre-aggregated before both
  shuffles; lines of more than ``MAX_DOCS`` documents of their host are removed.
* Removal: keys above the limit meet the documents' lines again. A key that
  holds more than 1 in ``HEAVY`` of all lines is joined by broadcast (there are
  fewer than ``HEAVY`` of them), the others by a shuffle, so no frequent line
  fills a task.
* Verdict: a document that fails the base rules, or that keeps less than
  ``LEAST_LEFT`` per cent of its words, is rejected.

No text passes a shuffle for the verdict. ``clean_lines`` also returns the texts
without the removed lines.

Defined results: a null or empty text has no words, fails the base rules and
is rejected; null hosts are one host; a null doc_id counts as one document;
rows that repeat are judged each, and count as one document for their lines;
lines are compared over their whole length, however long; lines without a word
are never counted or removed; ties can't arise, as a limit holds for a line or
doesn't; an empty table gives an empty result; other columns are ignored by
``line_verdicts`` and kept by ``clean_lines``, where an input column of one of
the result's names gives way to the result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

MAX_DOCS, LEAST_LEFT, HEAVY = 20, 30, 4096
WORDS_LEAST, REPEAT_MOST = 50, 50
SYMBOLS = b"#*$%&|<>"
_FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ123456789", b"abcdefghijklmnopqrstuvwxyz000000000")
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, hi array<long>, lo array<long>, words array<int>"
VERDICT = [*COUNTS, "n_removed_words", "base_failed", "kept"]


def repeated_words(words: list[bytes]) -> int:
    """Words in 3-word windows that are found twice or more, the first included."""
    n, seen = len(words), {}
    if n < 4:
        return 0
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, n)
    m = len(seen)
    if m == n:
        return 0
    head = ids[:-2] * m + ids[1:-1]
    if m >= 2_000_000:  # else three numbers below m fit one 64-bit code
        head = np.unique(head, return_inverse=True)[1]
    _, at, times = np.unique(head * m + ids[2:], return_inverse=True, return_counts=True)
    twice = times[at] > 1
    held = np.zeros(n, bool)
    for k in range(3):
        held[k:n - 2 + k] |= twice
    return int(held.sum())


def line_key(host: bytes | None, line: bytes) -> bytes:
    """128-bit key of a normalised line of a host."""
    mark = b"-" if host is None else b"%d:%s" % (len(host), host)
    return hashlib.blake2b(mark + b"\n" + line, digest_size=16).digest()


def normalised(line: bytes) -> bytes:
    return b" ".join(line.translate(_FOLD).split())


def measure(text: bytes, host: bytes | None) -> tuple[list[int], dict[bytes, int]]:
    """The five base counts of a text, and the words of each line key."""
    words = text.split()
    solid = text.translate(None, b" \t\n\v\f\r")
    chars = int(np.count_nonzero((np.frombuffer(solid, np.uint8) & 0xC0) != 0x80))
    symbols = len(solid) - len(solid.translate(None, SYMBOLS))
    earlier, again, keys, folded = set(), 0, {}, {}
    for line in text.split(b"\n"):
        own = line.split()
        if not own:
            continue
        again += line in earlier
        earlier.add(line)
        plain = b" ".join(own).translate(_FOLD)
        key = folded.get(plain)
        if key is None:
            key = folded[plain] = line_key(host, plain)
        keys[key] = keys.get(key, 0) + len(own)
    return [len(words), chars, symbols, again, repeated_words(words)], keys


def _bytes(column: pa.Array) -> Iterator[bytes | None]:
    return (x.as_buffer().to_pybytes() if x.is_valid else None for x in column)


def measures(docs: DataFrame, host: str, more: list[str]) -> DataFrame:
    """(row, doc_id, further columns, counts, line keys) of every row, stored. ``row`` numbers the stored rows."""
    rows = docs.select(F.monotonically_increasing_id().alias("_row"), F.col("doc_id").alias("_doc"), F.col("text").alias("_text"),
                       F.col(host).cast("string").alias("_host"), *[F.col(f"`{c}`").alias(f"_more{i}") for i, c in enumerate(more)])
    kept = [f for f in rows.schema.fields if f.name not in ("_text", "_host")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                b = whole.slice(at, 1024)
                counts, sizes, keys, words = [], [0], [], []
                for text, host in zip(_bytes(b.column("_text")), _bytes(b.column("_host"))):
                    own, lines = measure(text or b"", host)
                    counts.append(own)
                    keys += lines
                    words += lines.values()
                    sizes.append(len(keys))
                pair = np.frombuffer(b"".join(keys), "<i8").reshape(-1, 2)
                edge = pa.array(sizes, pa.int32())
                lists = [pa.ListArray.from_arrays(edge, pa.array(x)) for x in (np.ascontiguousarray(pair[:, 0]), np.ascontiguousarray(pair[:, 1]), np.array(words, np.int32))]
                plain = np.array(counts, np.int64).reshape(-1, len(COUNTS))
                yield pa.record_batch([*[b.column(f.name) for f in kept], *[pa.array(plain[:, k]) for k in range(len(COUNTS))], *lists],
                                      [*[f.name for f in kept], *COUNTS, "hi", "lo", "words"])

    ddl = ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in kept] + [MEASURES])
    return stored(rows.mapInArrow(run, ddl), "line-measures")


def lines_of(measured: DataFrame) -> DataFrame:
    """(row, doc, hi, lo, words): every document's different lines."""
    lines = measured.select("_row", "_doc", F.explode(F.arrays_zip("hi", "lo", "words")).alias("x"))
    return lines.select("_row", "_doc", "x.hi", "x.lo", "x.words")


def frequent_lines(lines: DataFrame, max_docs: int) -> DataFrame:
    """(hi, lo, n_docs) of the lines that more than ``max_docs`` documents of their host hold."""
    doc = F.struct(F.col("_doc").isNull(), F.col("_doc"))  # a null id is a document too
    return lines.groupBy("hi", "lo").agg(F.count_distinct(doc).alias("n_docs")).where(F.col("n_docs") > max_docs)


def removed_lines(measured: DataFrame, max_docs: int) -> DataFrame:
    """(row, n_removed_words, hi, lo) of the rows that lose lines; the lists hold a row's own removed lines."""
    lines = lines_of(measured)
    often = stored(frequent_lines(lines, max_docs), "frequent-lines")
    total = measured.agg(F.sum(F.size("hi"))).first()[0] or 0
    heavy = F.col("n_docs") * HEAVY > total
    hit = lines.join(F.broadcast(often.where(heavy)), ["hi", "lo"], "left_semi")  # fewer than HEAVY keys
    hit = hit.unionByName(lines.join(often.where(~heavy), ["hi", "lo"], "left_semi"))
    return hit.groupBy("_row").agg(F.sum("words").alias("n_removed_words"), F.collect_list(F.struct("hi", "lo")).alias("gone"))


def _judged(measured: DataFrame, max_docs: int, least_left: int) -> DataFrame:
    found = measured.drop("hi", "lo", "words").join(removed_lines(measured, max_docs), "_row", "left")
    failed = (F.col("n_words") < WORDS_LEAST) | (100 * F.col("n_repeat_words") > REPEAT_MOST * F.col("n_words"))
    gone: Column = F.coalesce(F.col("n_removed_words"), F.lit(0))
    left = 100 * (F.col("n_words") - gone) >= least_left * F.col("n_words")
    return found.withColumn("n_removed_words", gone).withColumn("base_failed", failed).withColumn("kept", ~failed & left)


def line_verdicts(docs: DataFrame, host: str = "source", max_docs: int = MAX_DOCS, least_left: int = LEAST_LEFT) -> DataFrame:
    """doc_id, the base counts, n_removed_words, base_failed and kept of every row."""
    return _judged(measures(docs, host, []), max_docs, least_left).select(F.col("_doc").alias("doc_id"), *VERDICT)


def clean_lines(docs: DataFrame, host: str = "source", max_docs: int = MAX_DOCS, least_left: int = LEAST_LEFT) -> DataFrame:
    """The rows that stay, with all their columns and the verdict's, and without the removed lines in ``text``."""
    others = [c for c in docs.columns if c not in VERDICT]
    judged = _judged(measures(docs, host, others), max_docs, least_left).where("kept")
    shape = {c: f"_more{i}" for i, c in enumerate(others)}
    rows = judged.select(*[F.col(v).alias(c) for c, v in shape.items()], *VERDICT, F.col(shape[host]).cast("string").alias("_host"), "gone")
    schema = rows.drop("_host", "gone").schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = []
            for text, host, gone in zip(_bytes(b.column("text")), _bytes(b.column("_host")), b.column("gone")):
                if text is not None and gone.is_valid:
                    keys = {np.array([x["hi"].as_py(), x["lo"].as_py()], "<i8").tobytes() for x in gone}
                    text = b"\n".join(x for x in text.split(b"\n") if not x.split() or line_key(host, normalised(x)) not in keys)
                texts.append(text)
            text = pa.array(texts, pa.binary()).cast(b.column("text").type)
            yield pa.record_batch([text if f.name == "text" else b.column(f.name) for f in schema], [f.name for f in schema])

    return rows.mapInArrow(run, schema)


ORACLE = r"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
lines AS (SELECT r, doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM docs),
full_lines AS (SELECT *, array_to_string(regexp_extract_all(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ123456789', 'abcdefghijklmnopqrstuvwxyz000000000'), '[^\x20\x09-\x0D]+'), ' ') AS plain,
    len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
often AS (SELECT source, plain FROM full_lines GROUP BY 1, 2 HAVING count(DISTINCT doc_id) > 20),
gone AS (SELECT r, sum(n) AS removed FROM full_lines JOIN often ON often.plain = full_lines.plain AND often.source IS NOT DISTINCT FROM full_lines.source GROUP BY r),
dup AS (SELECT r, count(*) - count(DISTINCT line) AS n_dup_lines FROM full_lines GROUP BY r),
spots AS (SELECT r, unnest(generate_series(1, len(w) - 2)) AS i, w FROM docs WHERE len(w) > 2),
wins AS (SELECT r, i, count(*) OVER (PARTITION BY r, w[i], w[i + 1], w[i + 2]) AS times FROM spots),
held AS (SELECT r, count(DISTINCT i + k) AS n_repeat_words FROM wins, (VALUES (0), (1), (2)) AS o(k) WHERE times > 1 GROUP BY r),
base AS (SELECT docs.r, doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols, CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed_words
    FROM docs LEFT JOIN dup USING (r) LEFT JOIN held USING (r) LEFT JOIN gone USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_removed_words,
    n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
    NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 100 * (n_words - n_removed_words) >= 30 * n_words AS kept FROM base
"""
