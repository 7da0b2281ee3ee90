"""Quality by the perplexity of an interpolated modified Kneser-Ney n-gram model of trusted text.

Symbols are the UTF-8 bytes of a text after ORDER - 1 start marks and before one end mark, so the model covers every
language and no symbol is unknown. Counts are grouped tables, sharded by n-gram. Documents are scored in blocks: a block
asks for its distinct n-grams, the requests join the count tables by n-gram, and the answers meet the block's texts.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from lynceus.llm.base import fold_of, ready, stored, text_slices

ORDER = 4
START, END = 2, 3
#: Bytes of text in a block; a longer text is a block of its own.
BLOCK_BYTES = 8 << 20
#: Bytes of text scored at once inside a block.
SCORED_BYTES = 1 << 20
#: Trusted ids up to which they are broadcast (8 bytes each); beyond it the join shuffles.
BROADCAST_IDS = 4_000_000
#: Languages up to which their means and thresholds are broadcast; beyond it the joins shuffle.
BROADCAST_LANGS = 50_000
#: Scores are compared at this resolution (bits per symbol) when quantiles are read off their counts.
BIN = 0.002
#: A text's score counts this many symbols at its language's trusted mean besides its own: few symbols prove little.
PRIOR_SYMBOLS = 256


def packed(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Packed n-grams of the texts' symbols, and where each text's begin; a text has one more n-gram than bytes."""
    head, tail = bytes([START]) * (ORDER - 1), bytes([END])
    parts = [head + t.encode("utf-8", "replace") + tail for t in texts]
    sizes = np.array([len(p) for p in parts])
    data = np.frombuffer(b"".join(parts), np.uint8).astype(np.uint32)
    grams = np.zeros(len(data) - ORDER + 1, np.uint32)
    for i in range(ORDER):
        grams = (grams << np.uint32(8)) | data[i : i + len(grams)]
    ends = np.cumsum(sizes)
    place = np.arange(ORDER - 1, len(data), dtype=np.int32)  # of an n-gram's last symbol
    place -= np.repeat((ends - sizes).astype(np.int32), sizes)[ORDER - 1 :]
    inside = place >= ORDER - 1
    counts = sizes - ORDER + 1
    return grams[inside], np.concatenate(([0], np.cumsum(counts)[:-1]))


def gram_counts(texts: DataFrame) -> DataFrame:
    """(gram, n) over all rows of ``texts`` (any, text); each task adds up its slices before the shuffle."""
    ready(texts.sparkSession)

    def run(batches):
        for _, part in text_slices(batches):
            grams, n = np.unique(packed(part)[0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(grams.astype(np.int64)), pa.array(n.astype(np.int64))], ["gram", "n"])

    return texts.mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def discounts(n1: float, n2: float, n3: float, n4: float) -> tuple[float, float, float]:
    """Discounts of counts 1, 2 and 3 or more; where counts of counts are missing, half a count."""
    if min(n1, n2, n3, n4) <= 0:
        return 0.5, 0.5, 0.5
    y = n1 / (n1 + 2 * n2)
    return tuple(min(max(k - (k + 1) * y * b / a, 0.05), k - 0.05) for k, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4)))


class KneserNey:
    """``probs[k]`` (gram, p) and ``gammas[k]`` (ctx, gamma) of orders 1 to ORDER, stored tables sharded by n-gram."""

    def __init__(self, probs: dict[int, DataFrame], gammas: dict[int, DataFrame], base: float):
        self.probs, self.gammas, self.base = probs, gammas, base

    @classmethod
    def fit(cls, counts: DataFrame) -> KneserNey:
        """From the counts of the highest order; lower orders count distinct left neighbours."""
        spark, level = counts.sparkSession, {ORDER: counts.select("gram", "n")}
        for k in range(ORDER - 1, 0, -1):
            mask = (1 << (8 * k)) - 1
            level[k] = stored(
                level[k + 1].groupBy(F.col("gram").bitwiseAND(F.lit(mask)).alias("gram")).agg(F.count(F.lit(1)).alias("n")), f"counts{k}")
        base = 1.0 / 257
        probs, gammas, lower = {}, {}, None
        for k in range(1, ORDER + 1):
            coc = dict(level[k].where("n <= 4").groupBy("n").count().collect())
            d1, d2, d3 = discounts(*[float(coc.get(i, 0)) for i in (1, 2, 3, 4)])
            cut = F.when(F.col("n") == 1, d1).when(F.col("n") == 2, d2).otherwise(d3)
            rows = level[k].select("gram", F.shiftright("gram", 8).alias("ctx"), "n", cut.alias("cut"))
            ctx = rows.groupBy("ctx").agg(F.sum("n").alias("total"), F.sum("cut").alias("held"))
            gammas[k] = stored(ctx.select("ctx", (F.col("held") / F.col("total")).alias("gamma"), "total"), f"gamma{k}")
            joined = rows.join(gammas[k], "ctx")
            if lower is None:
                below = joined.withColumn("below", F.lit(base))
            else:
                mask = (1 << (8 * (k - 1))) - 1
                below = joined.withColumn("suffix", F.col("gram").bitwiseAND(F.lit(mask))).join(
                    lower.select(F.col("gram").alias("suffix"), F.col("p").alias("below")), "suffix")
            p = (F.col("n") - F.col("cut")) / F.col("total") + F.col("gamma") * F.col("below")
            probs[k] = lower = stored(below.select("gram", p.alias("p")), f"probs{k}")
        return cls(probs, {k: g.select("ctx", "gamma") for k, g in gammas.items()}, base)

    def answer(self, requests: DataFrame) -> DataFrame:
        """(block, gram, logp) for (block, gram): from the longest known suffix, times the weights of contexts above it."""
        asked = requests.join(self.probs[ORDER], "gram", "left")
        known = asked.where("p is not null").select("block", "gram", F.log2("p").alias("logp"))
        missing = asked.where("p is null").select("block", "gram")
        rest = stored(missing.groupBy("gram").agg(F.collect_set("block").alias("blocks")), "unseen")
        state = rest.select("gram", F.lit(0.0).alias("w"), F.lit(None).cast("double").alias("p"))
        for k in range(ORDER, 0, -1):  # weight of the context at k, then the probability one order below
            state = state.withColumn("ctx", F.shiftright(F.col("gram").bitwiseAND(F.lit((1 << (8 * k)) - 1)), 8))
            state = state.join(self.gammas[k], "ctx", "left").withColumn(
                "w", F.when(F.col("p").isNull(), F.col("w") + F.log2(F.coalesce("gamma", F.lit(1.0)))).otherwise(F.col("w"))).drop("gamma", "ctx")
            if k > 1:
                low = self.probs[k - 1].select(F.col("gram").alias("suffix"), F.col("p").alias("q"))
                state = state.withColumn("suffix", F.col("gram").bitwiseAND(F.lit((1 << (8 * (k - 1))) - 1))).join(low, "suffix", "left")
                state = state.withColumn("p", F.coalesce("p", "q")).drop("q", "suffix")
        state = state.select("gram", (F.col("w") + F.log2(F.coalesce("p", F.lit(self.base)))).alias("logp"))
        unseen = rest.join(state, "gram").select(F.explode("blocks").alias("block"), "gram", "logp")
        return known.unionByName(unseen)


def _blocks(batches, pid: int):
    """(block, keys, texts); a block's number tells its task and its place there."""
    number = pid << 32
    for keys, texts in text_slices(batches, BLOCK_BYTES):
        yield number, keys, texts
        number += 1


def _partition() -> int:
    from pyspark import TaskContext

    return TaskContext.get().partitionId()


def bits_per_symbol(docs: DataFrame, model: KneserNey, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    """(id, lang, n_symbols, bits) of every row; ``docs`` must be a stored table, as it is read twice in the same blocks.

    Id and language travel with the text they belong to, so rows that share an id keep their own. A null language is ``und``.
    """
    ready(docs.sparkSession)
    kind = docs.schema[id_col].dataType
    key = F.struct(F.col(id_col).alias("id"), F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"))
    rows = docs.select(key.alias("key"), F.col(text_col).alias("text"))

    def ask(batches):
        for block, _, texts in _blocks(batches, _partition()):
            found = np.zeros(0, np.uint32)
            step = max(1, len(texts) // 8)
            for i in range(0, len(texts), step):
                found = np.union1d(found, np.unique(packed(texts[i : i + step])[0]))
            for i in range(0, len(found), 10_000):
                part = found[i : i + 10_000]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), block, np.int64)), pa.array(part.astype(np.int64))], ["block", "gram"])

    def pack(batches):
        for block, keys, texts in _blocks(batches, _partition()):
            sink = pa.BufferOutputStream()
            body = pa.record_batch({"key": pa.array(keys, key_type), "text": pa.array(texts, pa.large_string())})
            with pa.ipc.new_stream(sink, body.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_batch(body)
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["block", "body"])

    def score(bodies: pa.Table, answers: pa.Table) -> pa.Table:
        grams, logp = answers["gram"].to_numpy(), answers["logp"].to_numpy()
        order = np.argsort(grams)
        grams, logp = grams[order].astype(np.uint32), logp[order]
        keys, sizes, bits = [], [np.zeros(0, np.int64)], [np.zeros(0)]
        for body in bodies["body"]:
            table = pa.ipc.open_stream(body.as_py()).read_all()
            for part, texts in text_slices(table.to_batches(), SCORED_BYTES):
                asked, starts = packed(texts)
                at = np.minimum(np.searchsorted(grams, asked), max(len(grams) - 1, 0))
                if not len(grams) or (grams[at] != asked).any():
                    raise RuntimeError("the documents changed between two reads: store them first")
                keys += part
                sizes.append(np.diff(np.concatenate((starts, [len(asked)]))))
                bits.append(-np.add.reduceat(logp[at], starts))
        return pa.table({
            "id": pa.array([k["id"] for k in keys], key_type.field("id").type), "lang": pa.array([k["lang"] for k in keys], pa.string()),
            "n_symbols": np.concatenate(sizes).astype(np.int64), "bits": np.concatenate(bits)})

    from pyspark.sql.pandas.types import to_arrow_type

    key_type = pa.struct([("id", to_arrow_type(kind)), ("lang", pa.string())])
    answers = model.answer(rows.mapInArrow(ask, "block long, gram long"))
    bodies = rows.mapInArrow(pack, "block long, body binary")
    return bodies.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(score, f"id {kind.simpleString()}, lang string, n_symbols long, bits double")


def quantiles(scores: DataFrame, q: float) -> DataFrame:
    """(lang, threshold): the smallest binned score that at least a share ``q`` of the language's rows reach not."""
    binned = scores.groupBy("lang", F.ceil(F.col("score") / BIN).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    run = Window.partitionBy("lang").orderBy("bin")
    cum = binned.withColumn("upto", F.sum("n").over(run)).withColumn("whole", F.sum("n").over(Window.partitionBy("lang")))
    return cum.where(F.col("upto") >= F.lit(q) * F.col("whole")).groupBy("lang").agg((F.min("bin") * F.lit(BIN)).alias("threshold"))


def quality_scores(docs: DataFrame, trusted: DataFrame, q: float = 0.98, margin: float = 0.05, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(id, lang, n_symbols, bits_per_symbol, perplexity, score, threshold, kept) of every row of ``docs``, a stored table.

    ``trusted`` holds ids (one column) of trusted documents. The model counts the texts of all but every fourth of them,
    by a hash of the id; those left out tell how unseen good text scores: a language's threshold is the ``q`` quantile of
    their scores, times 1 + ``margin``; a score is bits per symbol, drawn to the
    language's trusted mean by PRIOR_SYMBOLS symbols. The threshold of a language without such documents is
    null and nothing in it is rejected: the model has no ground to. Documents above their threshold are not kept. A null language is ``und``; null and empty texts have
    nothing to judge (one end mark), score 0 bits and are kept. Rows that repeat an id are scored row by row. Other
    columns are not read; an empty table gives an empty result.
    """
    ids = stored(trusted.toDF("__trusted").where("__trusted is not null").distinct(), "trusted")
    side = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    apart = fold_of(F.col("__trusted")) == 3
    text = docs.join(side.where(~apart), F.col(id_col) == F.col("__trusted"), "left_semi").where(F.length(text_col) > 0)
    counts = stored(gram_counts(text.select(id_col, text_col)), "counts")
    joined = stored(bits_per_symbol(docs, KneserNey.fit(counts), id_col, text_col, lang_col), "scores")
    good = joined.join(side.where(apart), F.col("id") == F.col("__trusted"), "left_semi").where("n_symbols > 1")
    sums = good.groupBy(F.col("lang").alias("__lang")).agg(F.sum("bits").alias("b"), F.sum("n_symbols").alias("n"))
    mean = F.coalesce(F.col("b") / F.col("n"), F.lit(0.0))
    score = (F.col("bits") + PRIOR_SYMBOLS * mean) / (F.col("n_symbols") + PRIOR_SYMBOLS)
    sums = stored(sums, "languages")
    few = (lambda t: F.broadcast(t)) if sums.count() <= BROADCAST_LANGS else (lambda t: t)
    graded = joined.join(few(sums), F.col("lang") == F.col("__lang"), "left").withColumn("score", score).drop("b", "n", "__lang")
    learned = graded.join(side.where(apart), F.col("id") == F.col("__trusted"), "left_semi").where("n_symbols > 1")
    cuts = quantiles(learned, q).select(F.col("lang").alias("__lang"), F.col("threshold").alias("own_cut"))
    cut = F.col("own_cut") * (1 + margin)
    empty = F.col("n_symbols") <= 1
    out = graded.join(few(cuts), F.col("lang") == F.col("__lang"), "left").withColumns({
        "threshold": cut, "score": F.when(empty, 0.0).otherwise(F.col("score")),
        "own": F.when(empty, 0.0).otherwise(F.col("bits") / F.col("n_symbols"))})
    return out.select(
        F.col("id").alias(id_col), "lang", "n_symbols", F.col("own").alias("bits_per_symbol"), F.pow(F.lit(2.0), "own").alias("perplexity"),
        "score", "threshold", F.coalesce(F.col("score") <= F.col("threshold"), F.lit(True)).alias("kept"))
