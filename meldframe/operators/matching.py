"""Entity matching: edit distance, MinHash and exact joins on normalized text, and what follows from a match.

Each side is reduced to its distinct (blocks, normalized text) before any pair is made, so copies of a
text cost one comparison; the rows' identifiers are joined back to the scored pairs.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meldframe.functions.naming import free_name, quoted
from meldframe.functions.text import char_ngrams, compact, edit_similarity, normalize_text
from meldframe.operators.keyed import as_list

MATCH_COLUMNS = ("left_id", "right_id", "left_value", "right_value", "left_norm", "right_norm", "match_distance", "match_score", "match_rank")
_METHODS = {"ml": "ml", "lsh": "ml", "minhash": "ml", "levenshtein": "levenshtein", "edit_distance": "levenshtein"}


def _col(name: str) -> Column:
    return F.col(quoted(name))


def _require(df: DataFrame, names: Iterable[str], side: str) -> None:
    if missing := [n for n in names if n not in df.columns]:
        raise ValueError(f"{side} has no column {', '.join(missing)}")


def _check(threshold: float, min_chars: int, **positive: int) -> None:
    if not 0 <= threshold <= 1:
        raise ValueError("threshold must be from 0 to 1")
    if min_chars < 1:
        raise ValueError("min_chars must be at least 1")
    for name, value in positive.items():
        if value < 1:
            raise ValueError(f"{name} must be at least 1")


def with_row_id(df: DataFrame, identifier: str | None) -> tuple[DataFrame, str, bool]:
    """``df`` with an identifier column, its name, and whether it was made here.

    A made one is a hash of the row's content and a number among equal rows, so that it is the same wherever
    the plan runs again."""
    if identifier is not None:
        _require(df, [identifier], "the input")
        return df, identifier, False
    name = free_name("_row_id", df.columns)
    content = F.sha2(F.to_json(F.struct(*(_col(c) for c in df.columns)), {"ignoreNullFields": "false"}), 256)
    numbered = df.withColumn(name, content)
    number = F.row_number().over(Window.partitionBy(name).orderBy(name))
    return numbered.withColumn(name, F.concat_ws("-", name, number)), name, True


def _side(df: DataFrame, value: str, identifier: str, blocks: Sequence[str], min_chars: int, side: str) -> DataFrame:
    """``<side>_id, _value, _norm, b0, b1 ...`` of the rows that can match: long enough, no NULL block."""
    out = df.select(
        _col(identifier).alias(f"{side}_id"),
        _col(value).cast("string").alias(f"{side}_value"),
        normalize_text(_col(value)).alias(f"{side}_norm"),
        *(_col(b).alias(f"b{i}") for i, b in enumerate(blocks)),
    ).where(F.length(f"{side}_norm") >= min_chars)
    return out if blocks else out.withColumn("b0", F.substring(f"{side}_norm", 1, 2))


def _block_names(blocks: Sequence[str]) -> list[str]:
    return [f"b{i}" for i in range(max(1, len(blocks)))]


def _ranked(left: DataFrame, right: DataFrame, pairs: DataFrame, keys: Sequence[str], keep_all: bool, distance: str) -> DataFrame:
    """The rows behind scored pairs of distinct texts, ranked for each left row. For best matches only, right rows of
    one text are first reduced to that of the smallest identifier, so copies of a text make no rows."""
    if not keep_all:
        right = right.groupBy(*keys, "right_norm").agg(F.min(F.struct("right_id", "right_value")).alias("r")).select(*keys, "right_norm", "r.*")
    full = left.join(pairs, [*keys, "left_norm"]).join(right, [*keys, "right_norm"])
    order = Window.partitionBy("left_id").orderBy(F.col("match_score").desc(), F.col("match_distance").asc(), F.col("right_id").asc())
    full = full.withColumn("match_rank", F.row_number().over(order)).withColumn("match_distance", F.col("match_distance").cast(distance))
    return (full if keep_all else full.where("match_rank = 1")).select(*MATCH_COLUMNS)


def fuzzy_match(
    left: DataFrame,
    right: DataFrame,
    *,
    left_on: str,
    right_on: str,
    left_id: str | None = None,
    right_id: str | None = None,
    block_on: str | Sequence[str] | None = None,
    threshold: float = 0.8,
    max_distance: int | None = None,
    min_chars: int = 2,
    keep_all_candidates: bool = False,
) -> DataFrame:
    """The best match by edit distance of each left row that has one; every candidate with ``keep_all_candidates``.

    Rows meet if they agree in ``block_on``, or without it in their first two normalized characters; NULL
    never agrees. Texts whose lengths differ by more than ``threshold`` and ``max_distance`` allow are not
    compared. Ties go to the smaller right identifier.
    """
    _check(threshold, min_chars)
    blocks = as_list(block_on)
    _require(left, [left_on, *blocks], "left"), _require(right, [right_on, *blocks], "right")
    left, left_id, _ = with_row_id(left, left_id)
    right, right_id, _ = with_row_id(right, right_id)
    lefts, rights = _side(left, left_on, left_id, blocks, min_chars, "left"), _side(right, right_on, right_id, blocks, min_chars, "right")
    keys = _block_names(blocks)
    longer = F.greatest(F.length("left_norm"), F.length("right_norm"))
    most = F.floor(longer * (1 - threshold) + F.lit(1e-9)).cast("int")
    if max_distance is not None:
        most = F.least(most, F.lit(max_distance))
    met = lefts.select(*keys, "left_norm").distinct().join(rights.select(*keys, "right_norm").distinct(), keys)
    met = met.where(F.abs(F.length("left_norm") - F.length("right_norm")) <= most)
    scored = met.withColumn("match_distance", F.levenshtein("left_norm", "right_norm"))
    scored = scored.withColumn("match_score", edit_similarity(F.col("match_distance"), F.col("left_norm"), F.col("right_norm"))).where(F.col("match_score") >= threshold)
    if max_distance is not None:
        scored = scored.where(F.col("match_distance") <= max_distance)
    return _ranked(lefts, rights, scored, keys, keep_all_candidates, "int")


def _tokens(side: DataFrame, keys: Sequence[str], norm: str, n: int, min_chars: int) -> DataFrame:
    distinct = side.select(*keys, norm).distinct().withColumn("text", compact(norm)).where(F.length("text") >= min_chars)
    return distinct.withColumn("grams", char_ngrams(F.col("text"), n)).drop("text")


def _ml_side(df: DataFrame, value: str, identifier: str, blocks: Sequence[str], side: str) -> DataFrame:
    out = _side(df, value, identifier, blocks, 1, side)
    return out if blocks else out.drop("b0")


def _prepared_ml(left, right, left_on, right_on, left_id, right_id, block_on):
    blocks = as_list(block_on)
    _require(left, [left_on, *blocks], "left"), _require(right, [right_on, *blocks], "right")
    left, left_id, _ = with_row_id(left, left_id)
    right, right_id, _ = with_row_id(right, right_id)
    keys = [f"b{i}" for i in range(len(blocks))]
    return _ml_side(left, left_on, left_id, blocks, "left"), _ml_side(right, right_on, right_id, blocks, "right"), keys


def ml_fuzzy_match(
    left: DataFrame,
    right: DataFrame,
    *,
    left_on: str,
    right_on: str,
    left_id: str | None = None,
    right_id: str | None = None,
    block_on: str | Sequence[str] | None = None,
    threshold: float = 0.8,
    min_chars: int = 2,
    ngram_size: int = 3,
    num_features: int = 1 << 18,
    num_hash_tables: int = 3,
    keep_all_candidates: bool = False,
    seed: int = 42,
) -> DataFrame:
    """Approximate matches by Jaccard similarity of character n-grams, of compacted normalized text.

    Pairs that share one of ``num_hash_tables`` MinHash values, and the blocks, are candidates; their similarity
    is then exact over ``num_features`` hashed n-grams. The block is part of the join key. The hash functions
    follow from ``seed``. A pair exactly at the threshold counts.
    """
    _check(threshold, min_chars, ngram_size=ngram_size, num_features=num_features, num_hash_tables=num_hash_tables)
    lefts, rights, keys = _prepared_ml(left, right, left_on, right_on, left_id, right_id, block_on)

    def hashed(side: DataFrame, norm: str) -> DataFrame:
        tokens = _tokens(side, keys, norm, ngram_size, min_chars)
        features = F.array_distinct(F.transform("grams", lambda g: F.pmod(F.xxhash64(g), F.lit(num_features))))
        tokens = tokens.withColumn("features", features).drop("grams")
        minima = F.transform(F.sequence(F.lit(0), F.lit(num_hash_tables - 1)), lambda t: F.struct(t.alias("t"), F.array_min(F.transform("features", lambda f: F.xxhash64(f, t, F.lit(seed)))).alias("h")))
        return tokens.withColumn("band", F.explode(minima))

    a = hashed(lefts, "left_norm").withColumnRenamed("features", "left_features")
    b = hashed(rights, "right_norm").withColumnRenamed("features", "right_features")
    met = a.join(b, [*keys, "band"]).dropDuplicates([*keys, "left_norm", "right_norm"])
    return _ranked(lefts, rights, _jaccard(met, "left_features", "right_features", threshold), keys, keep_all_candidates, "double")


def _jaccard(pairs: DataFrame, a: str, b: str, threshold: float) -> DataFrame:
    common = F.size(F.array_intersect(a, b))
    share = common / (F.size(a) + F.size(b) - common)
    return pairs.withColumn("match_score", share).withColumn("match_distance", 1.0 - F.col("match_score")).where(F.col("match_score") >= threshold - 1e-12).drop(a, b)


def ngram_match(
    left: DataFrame,
    right: DataFrame,
    *,
    left_on: str,
    right_on: str,
    left_id: str | None = None,
    right_id: str | None = None,
    block_on: str | Sequence[str] | None = None,
    threshold: float = 0.8,
    min_chars: int = 2,
    ngram_size: int = 3,
    keep_all_candidates: bool = False,
) -> DataFrame:
    """Exact matches by Jaccard similarity of character n-grams.

    By the prefix filter, two sets of similarity t share one of the first ``size - ceil(t * size) + 1`` n-grams
    of either in a fixed order, so only those are joined. The threshold must be over 0: below, texts without a
    common n-gram would match too.
    """
    _check(threshold, min_chars, ngram_size=ngram_size)
    if threshold == 0:
        raise ValueError("threshold must be over 0")
    lefts, rights, keys = _prepared_ml(left, right, left_on, right_on, left_id, right_id, block_on)

    def prefixed(side: DataFrame, norm: str) -> DataFrame:
        tokens = _tokens(side, keys, norm, ngram_size, min_chars).withColumn("grams", F.array_sort(F.transform("grams", lambda g: F.struct(F.xxhash64(g).alias("h"), g.alias("g")))))
        first = F.slice("grams", 1, F.size("grams") - F.ceil(F.size("grams") * F.lit(threshold) - 1e-9).cast("int") + 1)
        return tokens.withColumn("gram", F.explode(first)).withColumn("grams", F.transform("grams", lambda x: x["g"]))

    a = prefixed(lefts, "left_norm").withColumnRenamed("grams", "left_grams")
    b = prefixed(rights, "right_norm").withColumnRenamed("grams", "right_grams")
    met = a.join(b, [*keys, "gram"]).dropDuplicates([*keys, "left_norm", "right_norm"])
    return _ranked(lefts, rights, _jaccard(met, "left_grams", "right_grams", threshold), keys, keep_all_candidates, "double")


def exact_match(left: DataFrame, right: DataFrame, *, left_on: str, right_on: str, left_id: str, right_id: str, block_on: str | Sequence[str] | None = None, min_chars: int = 2) -> DataFrame:
    """For each left row the smallest right identifier of equal normalized text and blocks; NULL identifiers never match."""
    blocks = as_list(block_on)
    lefts = _ml_side(left, left_on, left_id, blocks, "left").where(F.length("left_norm") >= min_chars)
    rights = _ml_side(right.where(_col(right_id).isNotNull()), right_on, right_id, blocks, "right").where(F.length("right_norm") >= min_chars)
    keys = [f"b{i}" for i in range(len(blocks))]
    least = rights.groupBy(*keys, "right_norm").agg(F.min(F.struct("right_id", "right_value")).alias("r"))
    cond = F.col("left_norm") == F.col("right_norm")
    for k in keys:
        cond = cond & (lefts[k] == least[k])
    joined = lefts.join(least, cond)
    return joined.select("left_id", F.col("r.right_id").alias("right_id"), "left_value", F.col("r.right_value").alias("right_value"), "left_norm", "right_norm", F.lit(0.0).alias("match_distance"), F.lit(1.0).alias("match_score"), F.lit(1).alias("match_rank"))


def fill_missing_from_match(
    left: DataFrame,
    right: DataFrame,
    *,
    left_on: str,
    right_on: str,
    fill_cols: str | Sequence[str],
    left_id: str | None = None,
    right_id: str | None = None,
    block_on: str | Sequence[str] | None = None,
    threshold: float = 0.8,
    max_distance: int | None = None,
    min_chars: int = 2,
    overwrite: bool = False,
    audit_prefix: str = "_match",
) -> DataFrame:
    """``left`` with NULLs of ``fill_cols`` taken from the best match, and four audit columns of the match.

    All left rows stay, in left's column order. ``overwrite`` takes the match's value in every row, which is
    NULL in rows without a match. Identifiers must be unique where they are given.
    """
    fill = list(dict.fromkeys(as_list(fill_cols)))
    if not fill:
        raise ValueError("fill_cols must name at least one column")
    _require(left, fill, "left"), _require(right, fill, "right")
    names = [f"{audit_prefix}_{n}" for n in ("right_id", "right_text", "score", "distance")]
    if clash := [n for n in names if n in left.columns]:
        raise ValueError(f"left already has {', '.join(clash)}")
    order = left.columns
    left, lid, _ = with_row_id(left, left_id)
    right, rid, _ = with_row_id(right, right_id)
    best = fuzzy_match(left, right, left_on=left_on, right_on=right_on, left_id=lid, right_id=rid, block_on=block_on, threshold=threshold, max_distance=max_distance, min_chars=min_chars)
    found = best.select("left_id", "right_id", "right_value", "match_score", "match_distance")
    values = right.select(_col(rid).alias("_found_id"), *(_col(c).alias(f"_new_{i}") for i, c in enumerate(fill)))
    found = found.join(values, F.col("right_id") == F.col("_found_id"), "left").drop("_found_id")
    joined = left.alias("l").join(found.alias("m"), F.col(f"l.{quoted(lid)}") == F.col("m.left_id"), "left")
    out = []
    for c in order:
        own = F.col(f"l.{quoted(c)}")
        if c in fill:
            new = F.col(f"m._new_{fill.index(c)}")
            own = new if overwrite else F.coalesce(own, new)
        out.append(own.alias(c))
    audit = ("right_id", "right_value", "match_score", "match_distance")
    return joined.select(*out, *(F.col(f"m.{a}").alias(n) for a, n in zip(audit, names, strict=True)))


def infer_key_from_text(
    left: DataFrame,
    reference: DataFrame,
    *,
    key_col: str,
    text_col: str,
    reference_key_col: str | None = None,
    reference_text_col: str | None = None,
    left_id: str | None = None,
    block_on: str | Sequence[str] | None = None,
    exact_first: bool = True,
    method: str = "ml",
    threshold: float = 0.8,
    max_distance: int | None = None,
    min_chars: int = 2,
    ngram_size: int = 3,
    num_features: int = 1 << 18,
    num_hash_tables: int = 3,
    overwrite: bool = False,
    audit_prefix: str = "_match",
) -> DataFrame:
    """``left`` with missing keys inferred from the text of a keyed reference: exact matches first, then similar ones.

    Only rows with a NULL key are matched, or all with ``overwrite``; a left without the key gets it. All rows
    stay. Four audit columns tell the inferred key, the reference's text, the score and the distance.
    """
    kind = _METHODS.get(method.lower())
    if kind is None:
        raise ValueError(f"method must be one of {', '.join(_METHODS)}")
    _check(threshold, min_chars, ngram_size=ngram_size, num_features=num_features, num_hash_tables=num_hash_tables)
    ref_key, ref_text = reference_key_col or key_col, reference_text_col or text_col
    _require(left, [text_col, *as_list(block_on)], "left"), _require(reference, [ref_key, ref_text, *as_list(block_on)], "reference")
    names = [f"{audit_prefix}_inferred_{key_col}", *(f"{audit_prefix}_{n}" for n in ("right_text", "score", "distance"))]
    if clash := [n for n in names if n in left.columns]:
        raise ValueError(f"left already has {', '.join(clash)}")
    key_type = reference.schema[ref_key].dataType
    order = list(left.columns)
    if key_col not in order:
        left, order = left.withColumn(key_col, F.lit(None).cast(key_type)), [*order, key_col]
    left, lid, _ = with_row_id(left, left_id)
    todo = left if overwrite else left.where(_col(key_col).isNull())
    known = reference.where(_col(ref_key).isNotNull())
    sides = {"left_on": text_col, "right_on": ref_text, "left_id": lid, "right_id": ref_key, "block_on": block_on, "min_chars": min_chars}
    found = exact_match(todo, known, **sides) if exact_first else None
    rest = todo.join(found.select(F.col("left_id").alias(lid)), lid, "left_anti") if exact_first else todo
    if kind == "ml":
        near = ml_fuzzy_match(rest, known, threshold=threshold, ngram_size=ngram_size, num_features=num_features, num_hash_tables=num_hash_tables, **sides)
    else:
        near = fuzzy_match(rest, known, threshold=threshold, max_distance=max_distance, **sides)
    near = near.withColumn("match_distance", F.col("match_distance").cast("double"))
    found = near if found is None else found.unionByName(near)
    found = found.select("left_id", "right_id", "right_value", "match_score", "match_distance")
    joined = left.alias("l").join(found.alias("m"), F.col(f"l.{quoted(lid)}") == F.col("m.left_id"), "left")
    out = []
    for c in order:
        own = F.col(f"l.{quoted(c)}")
        if c == key_col:
            own = F.col("m.right_id") if overwrite else F.coalesce(own, F.col("m.right_id"))
        out.append(own.alias(c))
    audit = ("right_id", "right_value", "match_score", "match_distance")
    return joined.select(*out, *(F.col(f"m.{a}").alias(n) for a, n in zip(audit, names, strict=True)))
