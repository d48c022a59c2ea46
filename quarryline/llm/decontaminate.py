"""Operator 1, benchmark decontamination, in DataFrame operations only.

Benchmark texts become windows of ``width`` words (a shorter item is one window).
Each window's number and a cheap hash of a few of its words are broadcast in blocks of
at most ``block`` windows, at fixed bytes each, so the broadcast has a bound whatever
the benchmark's size. Each document is scanned once a block: the cheap hash at
every position finds candidates in the broadcast hash table. A candidate carries the
document's words in its window; they meet the window itself by its number, and the hit
counts if all words agree. Documents are never shuffled: the hits of those
that have some meet the counts of words by document.

Defined results: null or empty text has no words, no hits and isn't contaminated.
Items without words have no windows; repeated items count once for each item_id.
Each repeated document row gives a row of its own. An empty benchmark gives no
hits. Other columns of either table aren't read; remove_documents and remove_spans keep
them, whatever their names."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarryline.llm.common import free_name, materialize

WIDTH = 13
#: Windows in a broadcast: a number, a width and a hash each, about 25 MB as a hash table.
BLOCK = 250_000
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, all else as it is. lower() is much faster, and does just this to ASCII."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(lower_ascii(text), F.lit("")), BETWEEN), "")


def probes(width: int) -> list[int]:
    """Which words of a window the cheap hash takes: up to four, evenly spread."""
    return sorted({round(i * (width - 1) / 3) for i in range(4)})


def anchor(hashes: Column, at: Column | int, width: int) -> Column:
    return F.xxhash64(F.lit(width), *(hashes[at + F.lit(i)] for i in probes(width)))


def anchors_from(width: int):
    return lambda at: anchor(F.col("hashes"), at, width)


def places(n: Column, width: int) -> Column:
    return F.greatest(n - F.lit(width - 1), F.lit(0))


def windows(benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """Distinct windows: w_words, w_width, w_items (sorted item_ids as strings)."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), words(F.col("text")).alias("words")).where(F.size("words") > 0)
    each = items.select("item", F.least(F.size("words"), F.lit(width)).alias("w_width"), "words").select(
        "item", "w_width", F.explode(F.expr("transform(sequence(1, size(words) - w_width + 1), i -> slice(words, i, w_width))")).alias("w_words")
    )
    return each.groupBy("w_words", "w_width").agg(F.array_sort(F.collect_set(F.coalesce("item", F.lit("")))).alias("w_items"))


def _candidates(prepared: DataFrame, block: DataFrame, widths: list[int]) -> DataFrame:
    """Places at which the cheap hash of a window of this block occurs, with the document's words there.
    What the array of hashes is made of stays out of the generator and the join, so they run as one piece
    of code and a document's words are touched only where a candidate is."""
    before, start = F.lit(0), None
    for w in widths:
        start = F.when(F.col("w_width") == w, before) if start is None else start.when(F.col("w_width") == w, before)
        before = before + places(F.col("n_words"), w)
    spread = prepared.select("doc_id", "k1", "k2", "n_words", "words", F.posexplode("anchors").alias("place", "w_anchor"))
    found = spread.join(F.broadcast(block), "w_anchor").withColumn("at", (F.col("place") - start).cast("int"))
    return found.select("doc_id", "k1", "k2", "at", F.col("w_width").alias("width"), "w_number", F.slice("words", F.col("at") + 1, F.col("w_width")).alias("said"))


def contamination(documents: DataFrame, benchmark: DataFrame, width: int = WIDTH, block: int = BLOCK) -> DataFrame:
    """Per document row: doc_id, n_words, n_hit (words inside any occurrence of a
    window), items (item_ids, sorted as strings), spans (array of (at, width), in
    words, sorted), and k1, k2, which with doc_id identify the text."""
    found = materialize(windows(benchmark, width).withColumn("w_number", F.monotonically_increasing_id()), "windows")
    widths = sorted({r[0] for r in found.groupBy("w_width").count().select("w_width").collect()}, reverse=True)  # at most ``width`` numbers
    blocks = max(1, -(-found.count() // block))
    text = F.col("text")
    # explode() of one array in an array is a barrier: the optimizer would otherwise put the array's expression into each use of it, once a word
    keyed = documents.select("doc_id", F.xxhash64(text).alias("k1"), F.hash(text).alias("k2"), F.explode(F.array(words(text))).alias("words")).withColumn("n_words", F.size("words"))
    if not widths:
        return keyed.select("doc_id", "k1", "k2", F.col("n_words").cast("long"), F.lit(0).cast("long").alias("n_hit"), F.expr("cast(array() as array<string>)").alias("items"), F.expr("cast(array() as array<struct<at:int,width:int>>)").alias("spans"))
    hashed = keyed.select("doc_id", "k1", "k2", "n_words", "words", F.explode(F.array(F.transform("words", lambda x: F.xxhash64(x)))).alias("hashes"))
    arrays, by_width = [], None
    sides = found.withColumn("w_hashes", F.transform("w_words", lambda x: F.xxhash64(x)))
    for w in widths:
        n, value = places(F.col("n_words"), w), anchor(F.col("w_hashes"), 0, w)
        by_width = F.when(F.col("w_width") == w, value) if by_width is None else by_width.when(F.col("w_width") == w, value)
        at = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.expr("array_repeat(0, 0)"))
        arrays.append(F.transform(at, anchors_from(w)))
    prepared = hashed.select("doc_id", "k1", "k2", "n_words", "words", F.explode(F.array(F.concat(*arrays))).alias("anchors"))
    sides = sides.select("w_number", "w_width", by_width.alias("w_anchor"))
    rows = None
    for b in range(blocks):
        part = sides if blocks == 1 else sides.where(F.pmod(F.xxhash64("w_number"), F.lit(blocks)) == b)
        hits = _candidates(prepared, part, widths)
        rows = hits if rows is None else rows.unionByName(hits)
    # a candidate counts if all its words agree
    hits = rows.join(found.select("w_number", "w_words"), "w_number").where("said = w_words").select("doc_id", "k1", "k2", "at", "width", "w_number")
    hits = materialize(hits.distinct(), "hits")
    named = hits.select("doc_id", "k1", "k2", "w_number").distinct().join(found.select("w_number", "w_items"), "w_number")
    key = ["doc_id", "k1", "k2"]
    items = named.select(*key, F.explode("w_items").alias("item")).groupBy(*key).agg(F.array_sort(F.collect_set("item")).alias("items"))
    spans = hits.groupBy(*key).agg(F.array_sort(F.collect_set(F.struct("at", "width"))).alias("spans"))
    covered = F.expr(
        "aggregate(spans, named_struct('n', 0, 'upto', 0), (s, x) -> named_struct("
        "'n', s.n + greatest(0, x.at + x.width - greatest(s.upto, x.at)), 'upto', greatest(s.upto, x.at + x.width))).n"
    )
    named_as = lambda df, mark: df.select(F.struct(*key).alias(mark), *(c for c in df.columns if c not in key))
    both = named_as(spans.withColumn("n_hit", covered.cast("long")), "who").join(named_as(items, "who"), "who")  # its null-safe key is one struct
    counted = keyed.select(*key, F.col("n_words").cast("long").alias("n_words"), F.struct(*key).alias("who"))
    joined = counted.join(both, "who", "left")
    empty = lambda kind: F.expr(f"cast(array() as array<{kind}>)")
    return joined.select(*key, "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("items", empty("string")).alias("items"), F.coalesce("spans", empty("struct<at:int,width:int>")).alias("spans"))


def is_contaminated(parts: int = 20) -> Column:
    """Some words are hit, and at least one in ``parts``."""
    return (F.col("n_hit") > 0) & (F.col("n_hit") * parts >= F.col("n_words"))


def report(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Contamination in digest form, one row per document."""
    found = contamination(documents, benchmark)
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), is_contaminated().alias("contaminated")
    )


def _found_in(documents: DataFrame, benchmark: DataFrame, condition: Column, how: str, *more: str) -> tuple[DataFrame, dict[str, str]]:
    """documents joined with what contamination() says, and the names that the columns ``more`` have in it."""
    taken = documents.columns
    names = {x: free_name(taken, f"found_{x}") for x in ("who", *more)}
    found = contamination(documents, benchmark).where(condition)
    found = found.select(F.struct("doc_id", "k1", "k2").alias(names["who"]), *(F.col(x).alias(names[x]) for x in more)).dropDuplicates([names["who"]])
    keyed = documents.withColumn(names["who"], F.struct("doc_id", F.xxhash64("text").alias("k1"), F.hash("text").alias("k2")))
    return keyed.join(found, names["who"], how), names


def remove_documents(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Documents that aren't contaminated, with all their columns."""
    return _found_in(documents, benchmark, is_contaminated(), "left_anti")[0].select(*documents.columns)


def remove_spans(documents: DataFrame, benchmark: DataFrame, mark: str = " ") -> DataFrame:
    """All documents, with the words of each hit and what is between them replaced by ``mark``."""
    joined, names = _found_in(documents, benchmark, F.col("n_hit") > 0, "left", "spans")
    spans = names["spans"]
    # Words and what is between them alternate: the n-th word is piece 2n of this array (or 2n+1 where the text begins with none).
    cut = (
        "array_join(transform(regexp_extract_all(text, '([^\\\\x00-\\\\x2F\\\\x3A-\\\\x40\\\\x5B-\\\\x60\\\\x7B-\\\\x7F]+[\\\\x00-\\\\x2F\\\\x3A-\\\\x40\\\\x5B-\\\\x60\\\\x7B-\\\\x7F]*)', 1),"
        f" (w, i) -> if(exists({spans}, s -> i >= s.at and i < s.at + s.width), '{mark}', w)), '')"
    )
    lead = F.regexp_extract("text", r"^[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*", 0)
    return joined.withColumn("text", F.when(F.col(spans).isNull(), F.col("text")).otherwise(F.concat(lead, F.expr(cut)))).select(*documents.columns)


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), ''), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(coalesce(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), ''), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS g FROM (SELECT item_id, w, least(len(w), 13) AS k, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS i FROM b WHERE len(w) > 0)),
ks AS (SELECT DISTINCT k FROM bw),
dw AS (SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS g FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, ks WHERE len(w) >= k)),
h AS (SELECT doc_id, item_id, i, dw.k AS k FROM dw JOIN bw ON dw.g = bw.g AND dw.k = bw.k),
c AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)
"""
