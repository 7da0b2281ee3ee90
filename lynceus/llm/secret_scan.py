"""Secret scan with corpus-wide ownership frequency. DataFrame functions only.

Candidates are found by patterns, then judged by how the corpus spreads them: hashes of candidate values are aggregated by
distinct repositories and owners. A value on several owners' pages is a widely copied example; one that a single owner has
and that looks like a key is a live credential. Such values also reveal credentials that no keyword or prefix announces:
key-shaped words that only one owner has are added as spans of kind ``owned``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from lynceus.llm.base import stored

#: The patterns of the base kinds. Runs are maximal, so their minimal lengths can stand in the pattern.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
MIN_VALUE = 12
KINDS = ("assign", "access", "hex", "owned")
#: Key-shaped words outside assignments: the first alternative passes over what the base kind has.
LOOSE = ASSIGN + r"|([A-Za-z0-9_-]{20,})"
#: A value that this many owners have is a copied example.
WIDE_OWNERS = 3
LIVE_SYMBOLS = 8


def pieces(text: Column, pattern: str, group: int, kind: int) -> Column:
    """Leftmost non-overlapping matches as structs (kind, pos, gap, n, value), gap: code points since the match before.

    Texts between matches come from a split; where none matches, the text is passed over once.
    """
    long = lambda c: F.length(c).cast("long")
    rx = F.lit(pattern)
    found = F.zip_with(
        F.regexp_extract_all(text, rx, F.lit(0)), F.regexp_extract_all(text, rx, F.lit(group)), lambda m, v: F.struct(long(m).alias("n"), v.alias("value")))
    # the split has one part more, behind the last match
    both = F.zip_with(F.split(text, pattern, -1), found, lambda g, m: F.struct(long(g).alias("gap"), m.n.alias("n"), m.value.alias("value")))
    out = F.transform(both, lambda b, i: F.struct(F.lit(kind).alias("kind"), i.alias("pos"), b.gap.alias("gap"), b.n.alias("n"), b.value.alias("value")))
    none = F.array().cast("array<struct<kind:int,pos:int,gap:bigint,n:bigint,value:string>>")
    return F.when(text.rlike(pattern), F.filter(out, lambda h: h.n.isNotNull())).otherwise(none)


def placed(pieces: DataFrame) -> DataFrame:
    """``at`` and ``end`` of every piece, in code points: running sums along the matches of one row and kind."""
    along = Window.partitionBy("rid", "kind").orderBy("pos")
    before = F.coalesce(F.sum("n").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    at = F.sum("gap").over(along.rowsBetween(Window.unboundedPreceding, 0)) + before
    return pieces.withColumn("at", at).withColumn("end", F.col("at") + F.col("n")).drop("pos", "gap", "n")


def looks_live(value: Column) -> Column:
    """Letters and digits mixed, with a key's variety of symbols."""
    symbols = F.size(F.array_distinct(F.split(value, "")))
    return value.rlike("[0-9]") & value.rlike("[A-Za-z]") & (symbols >= LIVE_SYMBOLS)


def candidates(docs: DataFrame, id_col: str, text_col: str, repo: Column, owner: Column) -> DataFrame:
    """(rid, id, repo, owner, pieces) per row of ``docs``, stored: the number of a row is a column, texts are read once."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    found = F.concat(pieces(text, ASSIGN, 2, 0), pieces(text, ACCESS, 0, 1), pieces(text, HEX, 0, 2), pieces(text, LOOSE, 3, 3))
    rows = docs.select(F.col(id_col).alias("id"), repo.cast("string").alias("repo"), owner.cast("string").alias("owner"), found.alias("pieces"))
    return stored(rows.withColumn("rid", F.monotonically_increasing_id()), "candidates")


def wanted() -> Column:
    """Pieces that count: long assigned values, every access key and hex run, key-shaped loose words without a base kind inside."""
    v, kind = F.col("value"), F.col("kind")
    shaped = v.rlike("[a-z]") & v.rlike("[A-Z]") & v.rlike("[0-9]") & looks_live(v) & ~v.rlike(f"{ACCESS}|{HEX}")
    return F.when(kind == 0, F.length(v) >= MIN_VALUE).when(kind == 3, shaped).otherwise(True)


def ownership(spread: DataFrame) -> DataFrame:
    """(digest, n_rows, n_repos, n_owners, verdict) per candidate value; spread has (digest, live, repo, owner) per occurrence.

    Occurrences are first combined per (value, repository, owner), so a value copied everywhere shuffles as few rows.
    A null repository or owner is not counted as one.
    """
    per_site = spread.groupBy("digest", "live", "repo", "owner").agg(F.count(F.lit(1)).alias("n"))
    per_value = per_site.groupBy("digest", "live").agg(
        F.sum("n").alias("n_rows"), F.count_distinct("repo").alias("n_repos"), F.count_distinct("owner").alias("n_owners"))
    verdict = (
        F.when(F.col("n_owners") >= WIDE_OWNERS, "example").when(~F.col("live"), "plain")
        .when(F.col("n_owners") <= 1, "live").otherwise("shared"))
    return per_value.select("digest", "n_rows", "n_repos", "n_owners", verdict.alias("verdict"))


def owner_of(repo: Column) -> Column:
    """The part of a repository name before the first slash; a name without one is its own owner."""
    return F.substring_index(repo.cast("string"), "/", 1)


def secret_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repo: str | Column = "source", owner: Column | None = None) -> DataFrame:
    """One row per row of ``docs``: (id_col, spans), spans ordered by place, then kind.

    A span is (at, kind, end, digest, n_rows, n_repos, n_owners, verdict): code points, end exclusive, the value's SHA-256,
    and how the corpus spreads the value. Kinds: ``assign``, ``access`` and ``hex`` by pattern whatever the verdict is;
    ``owned`` are other key-shaped words that a single owner has (verdict live). Verdicts: ``example`` on WIDE_OWNERS or
    more owners, ``live`` one owner at most and key-like, ``shared`` two owners, ``plain`` not key-like.

    Null and empty texts have no spans; a null id stays null; rows that repeat an id, or are equal, are scanned each.
    Empty tables give empty results; other columns are not read. Texts count whole; nothing is collected but a row's
    own spans.
    """
    repo = F.col(repo) if isinstance(repo, str) else repo
    rows = candidates(docs, id_col, text_col, repo, owner_of(repo) if owner is None else owner)
    each = placed(rows.where(F.size("pieces") > 0).select("rid", "id", "repo", "owner", F.inline("pieces"))).where(wanted())
    each = each.withColumn("digest", F.sha2(F.col("value"), 256)).withColumn("live", looks_live(F.col("value"))).drop("value")
    values = stored(ownership(each.select("digest", "live", "repo", "owner")), "values")
    name = F.element_at(F.array(*[F.lit(k) for k in KINDS]), F.col("kind") + 1)
    judged = each.drop("repo", "owner", "live").join(values, "digest")
    judged = judged.where((F.col("kind") < 3) | (F.col("verdict") == "live"))
    span = F.struct("at", "kind", "end", name.alias("name"), "digest", "n_rows", "n_repos", "n_owners", "verdict")
    some = judged.groupBy("rid").agg(F.first("id").alias("id"), F.array_sort(F.collect_list(span)).alias("spans"))
    spans = F.transform("spans", lambda s: F.struct(s["at"].alias("at"), s["name"].alias("kind"), *[s[c].alias(c) for c in ("end", "digest", "n_rows", "n_repos", "n_owners", "verdict")]))
    some = some.select("rid", "id", spans.alias("spans"))
    none = F.array().cast(some.schema["spans"].dataType)
    # rows without candidates never meet the shuffle; rows that lost all candidates to a verdict come back by their number
    empty = rows.where(F.size("pieces") == 0).select("rid", "id", none.alias("spans"))
    lost = rows.where(F.size("pieces") > 0).select("rid", "id").join(some.select("rid"), "rid", "left_anti").select("rid", "id", none.alias("spans"))
    return some.unionByName(empty).unionByName(lost).select(F.col("id").alias(id_col), "spans")


def span_digests(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id_col, n_assign, n_access, n_hex, base_sha256, spans) of a scan's rows: counts, and spans as kind:start:end joined by commas."""
    of = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.at, s.end)), ",")
    base = F.filter("spans", lambda s: s.kind != "owned")
    return found.select(
        id_col, of("assign").alias("n_assign"), of("access").alias("n_access"), of("hex").alias("n_hex"),
        F.sha2(text(base), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"))
