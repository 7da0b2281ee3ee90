"""Importance resampling of documents towards a target distribution over hashed word runs.

Every slice of texts compiles its own dictionary: an Aho-Corasick automaton over the slice's distinct words, each with
a delimiter on both sides and carrying its CRC and length. One scan of the slice emits a payload per word; payloads of
neighbours compose into the CRC of a run of words (appending bytes is a linear map of a CRC), so no run is ever built as
a string. Buckets are counted per document, counts of all documents and all target texts give a gain per bucket.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from lynceus.llm.base import ready, stored, text_slices

#: Bytes of normalised text that share one dictionary.
SLICE = 4 << 20
#: Words above this many bytes stay out of the dictionary (a trie node per byte); their CRC is taken directly.
LONG_WORD = 128
BUCKET_TYPE = np.dtype("<u2")

#: Digits, letters and all bytes beyond ASCII make words, A-Z become a-z, the rest delimits.
NORMAL = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
#: Fixed value: the reflected CRC-32 polynomial.
POLYNOMIAL = 0xEDB88320


def _advance_tables() -> list[np.ndarray]:
    """Table k maps a CRC register to the register after 2^k zero bytes, as 4 x 256 partial results joined by xor."""
    unit = [1 << i for i in range(32)]
    rows = []
    for c in unit:  # one zero byte, bit by bit
        for _ in range(8):
            c = (c >> 1) ^ (POLYNOMIAL if c & 1 else 0)
        rows.append(c)
    tables = []
    for _ in range(32):
        base = np.array(rows, np.uint32)
        tab = np.zeros((4, 256), np.uint32)
        for byte in range(4):
            for bit in range(8):
                hit = (np.arange(256) >> bit) & 1 == 1
                tab[byte, hit] ^= base[8 * byte + bit]
        tables.append(tab)
        rows = list(_apply(tab, base))
    return tables


def _apply(tab: np.ndarray, crc: np.ndarray) -> np.ndarray:
    return tab[0, crc & 255] ^ tab[1, (crc >> 8) & 255] ^ tab[2, (crc >> 16) & 255] ^ tab[3, crc >> 24]


ADVANCE = _advance_tables()


def compose(left: np.ndarray, right: np.ndarray, right_bytes: np.ndarray) -> np.ndarray:
    """CRC of each left text followed by its right text, from the two CRCs and the right one's length."""
    out = left.astype(np.uint32)
    for k in range(int(right_bytes.max(initial=0)).bit_length()):
        bit = (right_bytes >> k) & 1 == 1
        out[bit] = _apply(ADVANCE[k], out[bit])
    return out ^ right.astype(np.uint32)


def _scan(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(CRC, bytes) of every word of normalised ``text`` that starts and ends with a blank, in order."""
    import ahocorasick

    words = list(set(text.split()))
    if not words:
        return np.zeros(0, np.uint32), np.zeros(0, np.int64)
    crc = np.array([zlib.crc32(w) for w in words], np.uint32)
    size = np.array([len(w) for w in words], np.int64)
    short = size <= LONG_WORD
    scanner = ahocorasick.Automaton(ahocorasick.STORE_INTS)
    for i in np.flatnonzero(short).tolist():
        scanner.add_word(f" {words[i].decode('latin-1')} ", i)
    if short.any():
        scanner.make_automaton()
        hits = scanner.iter(text.decode("latin-1"))
    else:
        hits = iter(())
    if short.all():
        of = np.fromiter((v for _, v in hits), np.int64)
    else:  # the scan passes over long words: both kinds are put in order by where they end
        pairs = np.array(list(hits), np.int64).reshape(-1, 2)
        number = {words[i]: i for i in np.flatnonzero(~short).tolist()}
        data = np.frombuffer(text, np.uint8) != 32
        begin, end = np.flatnonzero(data[1:] & ~data[:-1]) + 1, np.flatnonzero(data[:-1] & ~data[1:]) + 1
        far = end - begin > LONG_WORD
        rest = np.array([(e, number[text[b:e]]) for b, e in zip(begin[far].tolist(), end[far].tolist())], np.int64).reshape(-1, 2)
        both = np.concatenate((pairs, rest))
        of = both[np.argsort(both[:, 0], kind="stable"), 1]
    return crc[of], size[of]


def _windows(text: bytes, limit: int) -> Iterator[bytes]:
    """``text`` cut behind blanks into parts of about ``limit`` bytes, so that memory follows the dictionary of a part."""
    at = 0
    while len(text) - at > limit:
        cut = text.find(b" ", at + limit)
        if cut < 0:
            break
        yield text[at : cut + 1]
        at = cut  # the blank delimits both parts
    yield text[at:]


def word_payloads(texts: list[str], limit: int = SLICE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(CRC of every word, its bytes, words per text)."""
    parts = [t.encode("utf-8", "replace").translate(NORMAL) for t in texts]
    whole = b" " + b" ".join(parts) + b" "
    data = np.frombuffer(whole, np.uint8) != 32
    begin = np.flatnonzero(data[1:] & ~data[:-1])
    ends = np.cumsum([len(p) + 1 for p in parts])
    counts = np.diff(np.concatenate(([0], np.searchsorted(begin, ends))))
    del data
    scans = [_scan(w) for w in _windows(whole, limit)]
    crc, size = (np.concatenate(x) for x in zip(*scans))
    if len(crc) != len(begin):
        raise RuntimeError(f"the automaton found {len(crc)} of {len(begin)} words")
    return crc, size, counts


def run_features(crc: np.ndarray, size: np.ndarray, counts: np.ndarray, max_run: int) -> tuple[np.ndarray, np.ndarray]:
    """(CRC of every run of 1 to ``max_run`` words joined by one blank, number of its text)."""
    owner = np.repeat(np.arange(len(counts)), counts)
    blank = np.uint32(zlib.crc32(b" "))
    crcs, owners, run = [crc], [owner], crc
    for n in range(2, max_run + 1):
        right, bytes_ = crc[n - 1 :], size[n - 1 :]
        right = compose(np.full(len(right), blank, np.uint32), right, bytes_)
        run = compose(run[: len(right)], right, bytes_ + 1)
        inside = owner[: len(right)] == owner[n - 1 :]
        crcs.append(run[inside])
        owners.append(owner[: len(right)][inside])
    return np.concatenate(crcs), np.concatenate(owners)


def bucket_counts(texts: list[str], buckets: int, max_run: int) -> Iterator[tuple[int, int, bytes, bytes]]:
    """Per text (words, features, distinct buckets ascending, count of each); counts take one byte each or four."""
    crc, size, counts = word_payloads(texts)
    feature, owner = run_features(crc, size, counts, max_run)
    key, n = np.unique(owner * buckets + feature % buckets, return_counts=True)
    cuts = np.searchsorted(key, np.arange(len(texts) + 1) * buckets)
    for i, words in enumerate(counts.tolist()):
        part, times = key[cuts[i] : cuts[i + 1]] - i * buckets, n[cuts[i] : cuts[i + 1]]
        width = np.uint8 if times.max(initial=0) < 256 else np.dtype("<u4")
        yield words, int(times.sum()), part.astype(BUCKET_TYPE).tobytes(), times.astype(width).tobytes()


def _decoded(buckets: bytes, counts: bytes) -> tuple[np.ndarray, np.ndarray]:
    b = np.frombuffer(buckets, BUCKET_TYPE)
    return b, np.frombuffer(counts, np.uint8 if len(counts) == len(b) else np.dtype("<u4")).astype(np.int64)


def hashed_features(docs: DataFrame, buckets: int, max_run: int, id_col: str, text_col: str) -> DataFrame:
    """(id, n_words, n_features, buckets, counts) of every row, stored: later passes read counts, not texts."""
    ready(docs.sparkSession)
    if buckets > 1 << 16:
        raise ValueError("at most 65536 buckets")
    schema = pa.schema([("id", pa.large_string()), ("n_words", pa.int64()), ("n_features", pa.int64()), ("buckets", pa.binary()), ("counts", pa.binary())])

    def hashed(batches):
        for ids, texts in text_slices(batches, SLICE):
            cols = list(zip(*bucket_counts(texts, buckets, max_run)))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip([ids, *cols], schema)], schema=schema)

    # ids travel as text whatever their type is, and get their type back below
    kind = docs.schema[id_col].dataType
    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"))
    out = rows.mapInArrow(hashed, "id string, n_words long, n_features long, buckets binary, counts binary")
    return stored(out.withColumn("id", F.col("id").cast(kind)), "features")


def bucket_totals(features: DataFrame) -> DataFrame:
    """(bucket, n) over all rows: each task sums its rows into one vector first."""
    schema = pa.schema([("bucket", pa.int64()), ("n", pa.int64())])

    def summed(batches):
        total = np.zeros(1 << 16, np.int64)
        for batch in batches:
            for b, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                at, n = _decoded(b, c)
                total[at] += n
        hit = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(hit, pa.int64()), pa.array(total[hit], pa.int64())], schema=schema)

    parts = features.select("buckets", "counts").mapInArrow(summed, "bucket long, n long")
    return parts.groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(source: DataFrame, target: DataFrame, buckets: int) -> np.ndarray:
    """Gain of every bucket: the floored 1000-fold log ratio of its smoothed shares in the target and the source.

    The vector has ``buckets`` entries, which bounds what the driver holds and every task receives.
    """
    spark = source.sparkSession
    s, t = (stored(bucket_totals(x), "totals") for x in (source, target))
    n_s, n_t = (x.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first().n for x in (s, t))
    every = spark.range(buckets).withColumnRenamed("id", "bucket")
    both = every.join(s.withColumnRenamed("n", "s"), "bucket", "left").join(t.withColumnRenamed("n", "t"), "bucket", "left").na.fill(0)
    d = lambda c, plus: F.col(c).cast("double") + F.lit(float(plus)) if isinstance(c, str) else F.lit(float(c + plus))
    ratio = d("t", 1) * d(n_s, buckets) / (d("s", 1) * d(n_t, buckets))
    out = np.zeros(buckets, np.int64)
    for r in both.select("bucket", F.floor(F.lit(1000.0) * F.log(ratio)).alias("gain")).collect():
        out[r.bucket] = r.gain
    return out


def weighted(features: DataFrame, gains: np.ndarray) -> DataFrame:
    """(id, n_words, n_features, weight): weight is the floored mean gain of a row's features, 0 without any."""
    sent = features.sparkSession.sparkContext.broadcast(gains)  # at most 65536 numbers
    schema = pa.schema([("id", pa.large_string()), ("n_words", pa.int64()), ("n_features", pa.int64()), ("weight", pa.int64())])

    def weigh(batches):
        for batch in batches:
            sums = []
            for b, c in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist()):
                at, n = _decoded(b, c)
                sums.append(int(sent.value[at] @ n))
            n_features = batch.column(2).to_pylist()
            weight = [s // n if n else 0 for s, n in zip(sums, n_features)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.large_string()), batch.column(1), batch.column(2), pa.array(weight, pa.int64())], schema=schema)

    kind = features.schema["id"].dataType
    rows = features.withColumn("id", F.col("id").cast("string"))
    out = rows.mapInArrow(weigh, "id string, n_words long, n_features long, weight long")
    return out.withColumn("id", F.col("id").cast(kind))


def draw(rows: DataFrame, percent: int, min_words: int, seed: int) -> DataFrame:
    """Adds ``score`` (weight plus a Gumbel number of the id) and ``rank`` of the highest scores drawn.

    Scores are whole numbers in a range that the logarithms bound (a few ten thousand values), so their counts place
    every score and only rows of one score are sorted together; rows too low to be drawn are not sorted at all.
    """
    text_id = F.coalesce(F.col("id").cast("string"), F.lit(""))
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), text_id), 256), 1, 8), 16, 10).cast("double")
    gumbel = F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))
    scored = stored(rows.withColumn("score", F.col("weight") + gumbel), "scored")
    may = F.col("n_words") >= min_words
    per_score = stored(scored.where(may).groupBy("score").agg(F.count(F.lit(1)).alias("n")), "scores")
    wanted = percent * (per_score.agg(F.sum("n").alias("n")).first().n or 0) // 100
    higher = Window.partitionBy(F.lit(0)).orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_score.select("score", F.coalesce(F.sum("n").over(higher), F.lit(0)).alias("offset")).where(F.col("offset") < wanted)
    marked = scored.join(F.broadcast(offsets), "score", "left")
    inside = Window.partitionBy("score").orderBy(F.col("id").asc_nulls_last())
    high = marked.where(may & F.col("offset").isNotNull())
    high = high.withColumn("rank", (F.col("offset") + F.row_number().over(inside)).cast("long"))
    high = high.withColumn("rank", F.when(F.col("rank") <= wanted, F.col("rank")))
    low = marked.where(~may | F.col("offset").isNull()).withColumn("rank", F.lit(None).cast("long"))
    return high.unionByName(low).drop("offset")


def importance_sample(
    docs: DataFrame, target: DataFrame, buckets: int = 10_000, max_run: int = 1, percent: int = 10, min_words: int = 20,
    seed: int = 2024, id_col: str = "doc_id", text_col: str = "text", target_text: str = "text",
) -> DataFrame:
    """One row per row of ``docs``: (id_col, n_features, weight, score, rank), all but the id long.

    Words are runs of digits, a-z and bytes beyond ASCII after A-Z are lower-cased; features are runs of 1 to
    ``max_run`` words. ``percent`` of the rows with ``min_words`` or more are drawn by the Gumbel trick: rank 1 is the
    highest score, ties go to the smaller id, a null id comes last; rows not drawn have a null rank. A null or empty text
    has no features and weight 0. A null id draws the number of the empty text. Rows that repeat an id draw the same
    number and are ranked one after the other. An empty table gives no rows, an empty target smoothed shares. Other
    columns are not read, whatever their names. Texts of any length are read whole, in windows of one dictionary each.
    """
    found = hashed_features(docs, buckets, max_run, id_col, text_col)
    aim = hashed_features(target.withColumn("__id", F.lit(0)), buckets, max_run, "__id", target_text)
    rows = draw(weighted(found, bucket_gains(found, aim, buckets)), percent, min_words, seed)
    return rows.select(F.col("id").alias(id_col), "n_features", "weight", "score", "rank")
