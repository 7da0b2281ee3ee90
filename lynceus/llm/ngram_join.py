"""Jaccard join of documents on word shingles with signature trees.

1. Equal sets form a class; only one representative of each goes on.
2. Two sets with Jaccard >= num/den share one of their first n - ceil(num n / den) + 1 shingles in any common order
   (prefix filter). The order puts frequent shingles last, so those of shared passages do not bring documents together.
   The prefixes are shuffled by shingle, packed as binary blocks; shingles with one owner end there. Owners of one
   shingle make a group, equal groups are one.
3. In every group each member is held against two heads, its smallest member and the one in most groups: where bitmaps
   allow, the sets are compared exactly. Groups whose members are then in one component need nothing more.
4. In the others signature trees are built and traversed in pairs; node pairs whose bitmaps and size ranges exclude a link
   are pruned, pairs within a component are passed over, and what is left is compared exactly. Groups above BLOCK members
   are cut into blocks, and every pair of blocks is a task of its own. Links found join components at once, so a task
   returns fewer links than it has members.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lynceus.llm.base import components, ready, stored, text_slices
from lynceus.llm.shingles import digests, mix, shingle_sets
from lynceus.llm.signature_tree import bitmap, can_link, folded, forest, pairs_between

#: Shingles in a counting window, and the documents of one window that make a shingle worth counting everywhere: a
#: shingle in more than LOCAL x windows documents is met often in at least one window.
WINDOW_SHINGLES, LOCAL = 2_000_000, 4
#: A shingle is frequent in more than 1 / RARITY of the documents, so there are at most RARITY x mean set size of them.
RARITY, AT_LEAST = 10_000, 16
#: Packed prefix entries of one bucket, and documents of a frequent shingle in one bucket.
BUCKET, SPREAD = 500_000, 100_000
#: Members of a group compared in one task.
BLOCK = 512
#: Members of a group whose pairs are listed; larger groups are compared where their sets meet.
FEW = 32
#: Rows up to which ids are broadcast (8 bytes each); beyond it the join shuffles.
BROADCAST_IDS = 2_000_000


def as_long(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def sets_of(rows: DataFrame) -> DataFrame:
    """(id, n, d1, d2) of every text, and (token, seen) of shingles met often in a counting window, told apart by nulls."""
    kind = rows.schema["id"].dataType.simpleString()
    names = ["id", "n", "d1", "d2", "token", "seen"]

    def run(batches):
        held, size = [], 0

        def often():
            token, seen = np.unique(np.concatenate(held), return_counts=True)
            token, seen = token[seen >= LOCAL], seen[seen >= LOCAL]
            none = pa.nulls(len(token))
            return pa.RecordBatch.from_arrays(
                [none.cast(id_type), none.cast(pa.int64()), none.cast(pa.int64()), none.cast(pa.int64()), as_long(token), pa.array(seen.astype(np.int64))], names)

        for ids, texts in text_slices(batches):
            tokens, n = shingle_sets(texts)
            d1, d2 = digests(tokens, n)
            none = pa.nulls(len(ids), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(ids, id_type), pa.array(n), as_long(d1), as_long(d2), none, none], names)
            held.append(tokens)
            size += len(tokens)
            if size >= WINDOW_SHINGLES:
                yield often()
                held, size = [], 0
        if held:
            yield often()

    from pyspark.sql.pandas.types import to_arrow_type

    id_type = to_arrow_type(rows.schema["id"].dataType)
    return rows.mapInArrow(run, f"id {kind}, n long, d1 long, d2 long, token long, seen long")


def prefix_length(n: np.ndarray, num: int, den: int) -> np.ndarray:
    return n - (num * n + den - 1) // den + 1


def prefixes(rows: DataFrame, frequent: np.ndarray, copies: np.ndarray, buckets: int, num: int, den: int) -> DataFrame:
    """(bucket, tokens, owners): prefix shingles and the first digests of their sets, packed per slice and bucket.

    ``copies`` says over how many buckets each frequent shingle is spread.
    """
    shared = rows.sparkSession.sparkContext.broadcast((frequent, copies))

    def run(batches):
        often, spread = shared.value
        met: set[int] = set()
        for _, texts in text_slices(batches):
            tokens, n = shingle_sets(texts)
            d1, _ = digests(tokens, n)
            first = np.zeros(len(n), bool)
            for i in np.flatnonzero(n > 0):
                if int(d1[i]) not in met:
                    first[i] = True
                    met.add(int(d1[i]))
            if len(met) > 1_000_000:
                met.clear()
            keep = np.repeat(first, n)
            tokens, n, d1 = tokens[keep], n[first], d1[first]
            doc = np.repeat(np.arange(len(n)), n)
            at = np.minimum(np.searchsorted(often, tokens), max(len(often) - 1, 0))
            is_often = often[at] == tokens if len(often) else np.zeros(len(tokens), bool)
            order = np.lexsort((tokens, is_often, doc))
            rank = np.arange(len(tokens)) - np.repeat(np.cumsum(n) - n, n)
            chosen = order[rank < np.repeat(prefix_length(n, num, den), n)]
            token, owner = tokens[chosen], d1[doc[chosen]]
            with np.errstate(over="ignore"):
                salt = np.where(is_often[chosen], owner % spread[at[chosen]].astype(np.uint64) if len(often) else np.uint64(0), np.uint64(0))
                bucket = (mix(token + salt * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(20)) % np.uint64(buckets)
            by = np.argsort(bucket, kind="stable")
            token, owner, bucket = token[by], owner[by], bucket[by]
            at = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1]))) if len(bucket) else np.zeros(0, np.int64)
            ends = np.append(at[1:], len(bucket))
            yield pa.RecordBatch.from_arrays([
                pa.array(bucket[at].astype(np.int64)), pa.array([token[a:b].tobytes() for a, b in zip(at, ends)], pa.binary()),
                pa.array([owner[a:b].tobytes() for a, b in zip(at, ends)], pa.binary())], ["bucket", "tokens", "owners"])

    return rows.mapInArrow(run, "bucket long, tokens binary, owners binary")


def groups(packed: DataFrame, frequent: np.ndarray, copies: np.ndarray) -> DataFrame:
    """(key, owner) of every shingle with several owners; shingles with the same owners share a key."""
    wide = frequent[copies > 1]  # their owners are in several buckets: keyed by the shingle itself
    shared = packed.sparkSession.sparkContext.broadcast(wide)

    def run(t: pa.Table) -> pa.Table:
        token = np.frombuffer(b"".join(x.as_py() for x in t["tokens"]), np.uint64)
        owner = np.frombuffer(b"".join(x.as_py() for x in t["owners"]), np.uint64)
        order = np.lexsort((owner, token))
        token, owner = token[order], owner[order]
        new = np.ones(len(token), bool)
        new[1:] = (token[1:] != token[:-1]) | (owner[1:] != owner[:-1])
        token, owner = token[new], owner[new]
        start = np.flatnonzero(np.concatenate(([True], token[1:] != token[:-1]))) if len(token) else np.zeros(0, np.int64)
        size = np.diff(np.append(start, len(token)))
        often = shared.value
        at = np.minimum(np.searchsorted(often, token[start]), max(len(often) - 1, 0))
        split = often[at] == token[start] if len(often) else np.zeros(len(start), bool)
        with np.errstate(over="ignore"):
            key = mix(np.add.reduceat(mix(owner), start) + size.astype(np.uint64)) if len(start) else np.zeros(0, np.uint64)
        key = np.where(split, mix(token[start]), key)
        keep = np.zeros(len(start), bool)
        keep[np.unique(key, return_index=True)[1]] = True
        keep &= (size > 1) | split
        rows = np.repeat(keep, size)
        return pa.table({"key": as_long(np.repeat(key[keep], size[keep])), "owner": as_long(owner[rows])})

    return packed.groupBy("bucket").applyInArrow(run, "key long, owner long").distinct()


def fetched(rows: DataFrame, wanted: DataFrame, tokens: bool) -> DataFrame:
    """(id, n, bits) or (id, tokens) of the sets of the ``wanted`` (wanted, d1), stored: bitmaps, or packed sorted hashes.

    The texts are read again, and only those wanted are cut into shingles; a row that repeats an id but not the set's
    digest d1 is passed over.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    side = F.broadcast(wanted) if wanted.count() <= BROADCAST_IDS else wanted
    kind, id_type = rows.schema["id"].dataType.simpleString(), to_arrow_type(rows.schema["id"].dataType)

    def run(batches):
        for batch in batches:
            expected, at = batch.column(2).to_numpy().view(np.uint64), 0
            for ids, texts in text_slices([batch]):
                found, n = shingle_sets(texts)
                ends = np.cumsum(n)
                same = np.flatnonzero(digests(found, n)[0] == expected[at : at + len(ids)])
                at += len(ids)
                parts = [found[ends[i] - n[i] : ends[i]] for i in same]
                out = [pa.array([ids[i] for i in same], id_type)]
                if tokens:
                    out += [pa.array([p.tobytes() for p in parts], pa.binary())]
                else:
                    out += [pa.array(n[same]), pa.array([bitmap(p) for p in parts], pa.binary())]
                yield pa.RecordBatch.from_arrays(out, ["id", "tokens"] if tokens else ["id", "n", "bits"])

    asked = rows.join(side, F.col("id") == F.col("wanted")).select("id", "text", "d1")
    out = asked.mapInArrow(run, f"id {kind}, tokens binary" if tokens else f"id {kind}, n long, bits binary")
    return stored(out, "tokens" if tokens else "signatures")


def allowed(pairs: DataFrame, signatures: DataFrame, num: int, den: int) -> DataFrame:
    """The (a, b) whose bitmaps and sizes do not exclude a link."""
    kind = pairs.schema["a"].dataType.simpleString()
    both = pairs.join(signatures.toDF("a", "na", "bits_a"), "a").join(signatures.toDF("b", "nb", "bits_b"), "b")
    both = both.where((F.col("na") * den >= F.col("nb") * num) & (F.col("nb") * den >= F.col("na") * num))

    def run(batches):
        for batch in batches:
            t = pa.Table.from_batches([batch])
            na, nb = t["na"].to_numpy(), t["nb"].to_numpy()
            keep = np.zeros(len(na), bool)
            words = [(len(x) // 8, len(y) // 8) for x, y in zip(t["bits_a"].to_pylist(), t["bits_b"].to_pylist())]
            w = np.array([min(x) for x in words]) if words else np.zeros(0, int)
            full = {"a": t["bits_a"].to_pylist(), "b": t["bits_b"].to_pylist()}
            for width in np.unique(w):
                at = np.flatnonzero(w == width)
                ma, mb = (np.concatenate([folded(np.frombuffer(full[s][i], np.uint64)[None], int(width)) for i in at]) for s in "ab")
                sa, sb = na[at] - np.bitwise_count(ma).sum(axis=1, dtype=np.int64), nb[at] - np.bitwise_count(mb).sum(axis=1, dtype=np.int64)
                keep[at] = can_link(ma, mb, sa, sb, na[at], na[at], nb[at], nb[at], num, den)
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(pa.array(keep)), batch.column("b").filter(pa.array(keep))], ["a", "b"])

    return both.mapInArrow(run, f"a {kind}, b {kind}")


def verified(pairs: DataFrame, rows: DataFrame, digest_of: DataFrame, num: int, den: int) -> DataFrame:
    """The (a, b) whose sets have den * intersection >= num * union, compared hash by hash."""
    kind = pairs.schema["a"].dataType.simpleString()
    pairs = stored(pairs, "pairs")
    wanted = pairs.select(F.col("a").alias("wanted")).union(pairs.select("b")).distinct().join(digest_of, "wanted")
    light = fetched(rows, stored(wanted, "wanted"), tokens=True)
    both = pairs.join(light.toDF("a", "tokens_a"), "a").join(light.toDF("b", "tokens_b"), "b")

    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("tokens_a"), batch.column("tokens_b")):
                x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                shared = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(den * shared >= num * (len(x) + len(y) - shared))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(mask), batch.column("b").filter(mask)], ["a", "b"])

    return both.mapInArrow(run, f"a {kind}, b {kind}")


def in_blocks(members: DataFrame, *columns: str) -> DataFrame:
    """(key, i, j, rows): the members of each group, or of each pair of its blocks, with their ``columns``."""
    sizes = members.groupBy("key").agg(F.count(F.lit(1)).alias("m"))
    cut = members.join(sizes, "key").withColumn("blocks", F.ceil(F.col("m") / BLOCK))
    cut = cut.withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")))
    cut = cut.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    cut = cut.select(
        "key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), (F.col("block") > F.col("other")).alias("second"), *columns)
    return cut.groupBy("key", "i", "j").agg(F.collect_list(F.struct("second", *columns)).alias("rows"))


def proposed(same: bool, second: np.ndarray, bits: list[bytes], n: np.ndarray, num: int, den: int) -> tuple[list[int], list[int]]:
    """Pairs of positions that the trees of one block, or of two, do not exclude."""

    def grown(mask):
        at = np.flatnonzero(mask)
        return forest([bits[x] for x in at], n[at], at)

    left, right = pairs_between(grown(np.ones(len(n), bool)), None, num, den) if same else pairs_between(grown(~second), grown(second), num, den)
    return left.tolist(), right.tolist()


def tree_members(members: DataFrame, num: int, den: int) -> DataFrame:
    """What the trees of (key, id, component, n, bits) do not exclude between components: distinct pairs (a, b) of groups of
    at most FEW members, and the (key, id) of members with such a partner in larger ones."""
    from pyspark.sql.pandas.types import to_arrow_type

    kind, id_type = members.schema["id"].dataType.simpleString(), to_arrow_type(members.schema["id"].dataType)

    def run(batches):
        for batch in batches:
            keys, found, pairs = [], [], []
            for key, i, j, rows in zip(*(batch.column(k).to_pylist() for k in range(3)), batch.column(3)):
                part = rows.values
                ids, of = part.field("id").to_pylist(), part.field("component").to_pylist()
                left, right = proposed(i == j, part.field("second").to_numpy(zero_copy_only=False), part.field("bits").to_pylist(), part.field("n").to_numpy(), num, den)
                if len(ids) <= FEW and i == j:
                    pairs += [(min(ids[x], ids[y]), max(ids[x], ids[y])) for x, y in zip(left, right) if of[x] != of[y]]
                    continue
                apart = {z for x, y in zip(left, right) if of[x] != of[y] for z in (x, y)}
                keys += [key] * len(apart)
                found += [ids[z] for z in apart]
            low, high = [None] * len(pairs), [None] * len(keys)
            yield pa.RecordBatch.from_arrays([
                pa.array(keys + low, pa.int64()), pa.array(found + low, id_type), pa.array(high + [a for a, _ in pairs], id_type),
                pa.array(high + [b for _, b in pairs], id_type)], ["key", "id", "a", "b"])

    return in_blocks(members, "id", "component", "n", "bits").mapInArrow(run, f"key long, id {kind}, a {kind}, b {kind}").distinct()


def one_of_each(members: DataFrame) -> DataFrame:
    """(key, id) of one group for each set of members, told by two sums of hashes and the size."""
    sums = [F.sum(F.xxhash64(*salt, "id").cast("decimal(38,0)")) for salt in ((), (F.lit(1),))]
    alike = members.groupBy("key").agg(sums[0].alias("h1"), sums[1].alias("h2"), F.count(F.lit(1)).alias("m"))
    return members.join(alike.groupBy("h1", "h2", "m").agg(F.min("key").alias("key")).select("key"), "key", "left_semi")


def tree_links(members: DataFrame, num: int, den: int) -> DataFrame:
    """(a, b): links that join all components which any link joins, within each group of (key, id, component, tokens).

    Trees propose the pairs. A pair whose components are joined by now is passed over, any other is compared hash by hash.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    kind, id_type = members.schema["id"].dataType.simpleString(), to_arrow_type(members.schema["id"].dataType)

    def run(batches):
        for batch in batches:
            out: list[tuple] = []
            for i, j, rows in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3)):
                part = rows.values
                ids, of = part.field("id").to_pylist(), part.field("component").to_pylist()
                sets = [np.frombuffer(x.as_py(), np.uint64) for x in part.field("tokens")]
                left, right = proposed(
                    i == j, part.field("second").to_numpy(zero_copy_only=False), [bitmap(x) for x in sets], np.array([len(x) for x in sets]), num, den)
                up = {c: c for c in of}

                def root(c):
                    while up[c] != c:
                        up[c] = c = up[up[c]]
                    return c

                for x, y in zip(left, right):
                    p, q = root(of[x]), root(of[y])
                    if p == q:
                        continue
                    shared = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
                    if den * shared >= num * (len(sets[x]) + len(sets[y]) - shared):
                        up[p] = q
                        out.append((min(ids[x], ids[y]), max(ids[x], ids[y])))
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], id_type), pa.array([y for _, y in out], id_type)], ["a", "b"])

    return in_blocks(members, "id", "component", "tokens").mapInArrow(run, f"a {kind}, b {kind}").distinct()


def link_counts(members: DataFrame, num: int, den: int) -> DataFrame:
    """(id, n): the weights of all sets that link with each of (key, id, weight, tokens), within a key; every pair meets once.

    Trees propose the pairs of a block or of two, each is compared hash by hash, and a task returns one row a member.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    kind, id_type = members.schema["id"].dataType.simpleString(), to_arrow_type(members.schema["id"].dataType)

    def run(batches):
        for batch in batches:
            out, sums = [], [np.zeros(0, np.int64)]
            for i, j, rows in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3)):
                part = rows.values
                weight, second = part.field("weight").to_numpy(), part.field("second").to_numpy(zero_copy_only=False)
                sets = [np.frombuffer(x.as_py(), np.uint64) for x in part.field("tokens")]
                left, right = proposed(
                    i == j, second, [bitmap(x) for x in sets], np.array([len(x) for x in sets]), num, den)
                n = np.zeros(len(sets), np.int64)
                for x, y in zip(left, right):
                    # a tree of one leaf meets itself, and an empty block leaves the other to meet itself
                    if x == y or i != j and second[x] == second[y]:
                        continue
                    shared = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
                    if den * shared >= num * (len(sets[x]) + len(sets[y]) - shared):
                        n[x] += weight[y]
                        n[y] += weight[x]
                out += part.field("id").to_pylist()
                sums.append(n)
            yield pa.RecordBatch.from_arrays([pa.array(out, id_type), pa.array(np.concatenate(sums))], ["id", "n"])

    found = in_blocks(members, "id", "weight", "tokens").mapInArrow(run, f"id {kind}, n long")
    return found.groupBy("id").agg(F.sum("n").alias("n"))


def jaccard_join(
    docs: DataFrame, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text", count_links: bool = False) -> DataFrame:
    """(id, n_shingles, component_id) of every row: size of its shingle set, and the smallest id that links reach.

    With ``count_links`` also n_links: the other rows with an id whose sets link with the row's own. All pairs within a
    component are compared for it, so its cost follows their number.

    Two rows link when den * intersection >= num * union of their sets of distinct five-word shingles (A-Z lower-cased;
    shorter texts are one shingle as a whole). Null, empty and wordless texts have no shingle and link with nothing. Rows
    with a null id link with nothing and have no component. Rows that repeat an id count as that id; each is returned
    with its own set size and the smallest component of the id's rows. Ids need an order; ``docs`` should be a stored
    table, as it is read five times. Other columns are not read; an empty table gives an empty result.
    """
    spark = ready(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    first = stored(sets_of(rows), "sets")
    sizes = first.where("token is null").select("id", "n", "d1", "d2")
    linkable = sizes.where("n > 0 and id is not null")
    classes = stored(linkable.groupBy("d1", "d2", "n").agg(F.min("id").alias("rep")), "classes")
    n_docs, prefix_rows = first.where("token is null").agg(F.count(F.lit(1)), F.sum(F.col("n") * (den - num) / den + 1)).first()
    floor = max(AT_LEAST, n_docs // RARITY)
    often = first.where("token is not null").groupBy("token").agg(F.sum("seen").alias("seen")).where(F.col("seen") >= floor)
    often = often.toArrow()
    frequent, seen = often["token"].to_numpy().view(np.uint64), often["seen"].to_numpy()
    order = np.argsort(frequent)
    frequent, copies = frequent[order], -(-seen[order] // SPREAD)
    shuffles = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(shuffles, int((prefix_rows or 0) // BUCKET) + 1)

    packed = prefixes(rows.where("id is not null"), frequent, copies, buckets, num, den)
    found = groups(packed, frequent, copies)
    members = stored(found.join(classes.select(F.col("d1").alias("owner"), F.col("rep").alias("id")), "owner").select("key", "id"), "members")

    digest_of = classes.select(F.col("rep").alias("wanted"), "d1")
    wanted = stored(members.select(F.col("id").alias("wanted")).distinct().join(digest_of, "wanted"), "wanted")
    signatures = fetched(rows, wanted, tokens=False)

    degree = members.groupBy("id").agg(F.count(F.lit(1)).alias("degree"))
    heads = members.join(degree, "id").groupBy("key").agg(F.min("id").alias("low"), F.max(F.struct("degree", "id")).alias("hub"))
    heads = heads.select("key", F.explode(F.array_distinct(F.array("low", "hub.id"))).alias("head"))
    star = members.join(heads, "key").where(F.col("head") != F.col("id")).select(F.least("head", "id").alias("a"), F.greatest("head", "id").alias("b")).distinct()
    edges = stored(verified(allowed(star, signatures, num, den), rows, digest_of, num, den), "links")
    label = stored(components(edges), "labels")

    labelled = members.join(label, F.col("id") == F.col("node"), "left").select("key", "id", F.coalesce("component", "id").alias("component"))
    labelled = stored(labelled, "labelled")
    mixed = labelled.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count(F.lit(1)).alias("m"))
    mixed = mixed.where("lo <> hi and m > 2").select("key")  # of two members the star has decided
    left = labelled.join(mixed, "key", "left_semi").join(signatures, "id")
    open_ = stored(tree_members(left, num, den), "undecided")
    few = verified(open_.where("a is not null").select("a", "b"), rows, digest_of, num, den)
    left = stored(one_of_each(open_.where("key is not null").select("key", "id")).join(label, F.col("id") == F.col("node"), "left")
                  .select("key", "id", F.coalesce("component", "id").alias("component")), "undecided")
    wanted = left.select(F.col("id").alias("wanted")).distinct().join(digest_of, "wanted")
    sets = fetched(rows, stored(wanted, "wanted"), tokens=True)
    more = stored(few.unionByName(tree_links(left.join(sets, "id"), num, den)), "links")
    links = label.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more)
    label = components(links)

    own = linkable.join(classes, ["d1", "d2", "n"]).select("id", "rep")
    final = own.join(label, F.col("rep") == F.col("node"), "left").select(F.col("id").alias("__id"), F.coalesce("component", "rep").alias("c"))
    final = final.groupBy("__id").agg(F.min("c").alias("component_id"))
    columns = [F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id")]
    if not count_links:
        return sizes.join(final, F.col("id") == F.col("__id"), "left").select(*columns)
    copies_of = stored(linkable.groupBy("d1", "d2", "n").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("weight")), "copies")
    # links end in one component; a repeated id may stand for several sets, each is a member by its digest
    asked = stored(copies_of.join(label, F.col("rep") == F.col("node")).select(F.col("rep").alias("wanted"), "d1", "component", "weight"), "wanted")
    sets = fetched(rows, asked.select("wanted", "d1"), tokens=True)
    counted = asked.join(sets.groupBy("id").agg(F.first("tokens").alias("tokens")), F.col("wanted") == F.col("id"))
    key = F.xxhash64("component").alias("key")
    counted = stored(link_counts(counted.select(key, F.col("wanted").alias("id"), "weight", "tokens"), num, den).toDF("rep", "linked"), "link counts")
    of_class = copies_of.join(counted, "rep", "left").select("d1", "d2", F.col("n").alias("__n"), (F.coalesce("linked", F.lit(0)) + F.col("weight") - 1).alias("own"))
    same = (sizes["d1"] == of_class["d1"]) & (sizes["d2"] == of_class["d2"]) & (F.col("n") == F.col("__n")) & F.col("id").isNotNull()
    both = sizes.join(of_class, same, "left").join(final, F.col("id") == F.col("__id"), "left")
    return both.select(*columns, F.coalesce("own", F.lit(0)).cast("long").alias("n_links"))
