"""Exact duplicates by content-defined chunk recipes, in DataFrame functions only.

A text without white space is cut into chunks where its bytes say so. Distinct chunk texts get verified
identifiers: their hash, and a rank as well where different texts share a hash. A document becomes the ordered
list of its chunk identifiers, and documents with equal lists are equal. Chunk text moves once, after duplicates
within each task are gone; all later steps move identifiers only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticktote.llm.common import free_name, shared_table

SPACES = (" ", "\t", "\n", "\x0b", "\f", "\r")
MIN_CHUNK, MAX_CHUNK = 256, 4096


def _byte_class(step: int, rest: int) -> str:
    return "[" + "".join(f"\\x{b:02x}" for b in range(256) if b % step == rest) + "]"


def boundary_pattern(shortest: int = MIN_CHUNK, longest: int = MAX_CHUNK) -> str:
    """A chunk ends after three bytes of three residue classes (about one place in 280), or at the greatest length."""
    end = _byte_class(8, 4) + _byte_class(7, 3) + _byte_class(5, 1)
    return f"(?s).{{{shortest - 3},{longest - 3}}}?{end}|(?s).{{1,{longest}}}"


def strip_spaces(c: Column) -> Column:
    c = F.coalesce(c, F.lit(""))
    for s in SPACES:
        c = F.replace(c, F.lit(s), F.lit(""))
    return c


def chunk_array(norm: Column, shortest: int = MIN_CHUNK, longest: int = MAX_CHUNK) -> Column:
    """Chunks of the UTF-8 bytes of a text, each byte as one Latin-1 character."""
    as_bytes = F.decode(F.encode(norm, "UTF-8"), "ISO-8859-1")
    return F.regexp_extract_all(as_bytes, F.lit(boundary_pattern(shortest, longest)), F.lit(0))


def _hash(c: Column, bits: int) -> Column:
    h = F.xxhash64(c)
    return h if bits >= 64 else h.bitwiseAND(F.lit((1 << bits) - 1))


def chunk_recipes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, hash_bits: int = 64, shortest: int = MIN_CHUNK, longest: int = MAX_CHUNK) -> DataFrame:
    """One light row per input row: row_key, id, n_chars, text_sha256 and recipe (verified chunk identifiers in order).

    Null text counts as empty and has an empty recipe. Repeated rows get a row_key each.
    """
    norm = strip_spaces(F.col(text_col))
    cut = chunk_array(norm, shortest, longest)
    distinct = docs.select(F.explode(cut).alias("c")).select(_hash(F.col("c"), hash_bits).alias("h"), "c").distinct()
    shared = distinct.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h")
    light = docs.select(
        F.monotonically_increasing_id().alias("row_key"), F.col(id_col).alias("id"), F.coalesce(F.length(text_col), F.lit(0)).alias("n_chars"),
        F.sha2(F.encode(norm, "UTF-8"), 256).alias("text_sha256"), cut.alias("cs"))
    if shared.isEmpty():
        ident = F.transform("cs", lambda c: F.struct(_hash(c, hash_bits).alias("h"), F.lit(0).alias("r")))
        return shared_table(light.withColumn("recipe", ident).drop("cs"), "recipes")
    ranks = shared_table(
        distinct.join(shared, "h").groupBy("h").agg(F.sort_array(F.collect_list("c")).alias("cs")).select("h", F.posexplode("cs").alias("r", "c")), "chunk-ranks")
    light = shared_table(light, "chunks")
    parts = light.select("row_key", F.posexplode("cs").alias("i", "c")).withColumn("h", _hash(F.col("c"), hash_bits)).join(ranks, ["h", "c"], "left")
    one = F.struct("i", F.struct("h", F.coalesce("r", F.lit(0)).alias("r")).alias("id"))
    lists = parts.groupBy("row_key").agg(F.sort_array(F.collect_list(one)).alias("l")).select("row_key", F.col("l.id").alias("recipe"))
    none = F.expr("cast(array() as array<struct<h: bigint, r: int>>)")
    return shared_table(light.drop("cs").join(lists, "row_key", "left").withColumn("recipe", F.coalesce("recipe", none)), "recipes")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **chunking: int) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256 and n_chunks.

    Texts are equal when they are identical without white space; null and empty texts are equal. Of equal texts the
    one with the most code points stays, then the smallest id (a null id comes first), then the first of repeated
    rows, so each group keeps exactly one row.
    """
    light = chunk_recipes(docs, id_col, text_col, **chunking)
    best = F.min(F.struct((-F.col("n_chars")).alias("n"), "id", "row_key")).alias("best")
    groups = light.groupBy("recipe").agg(best, F.count("*").alias("group_size"))
    # written first, so that the join has an exchange on both sides and Spark can split a group of very many copies
    groups = shared_table(groups.select("recipe", F.col("best.id").alias("keep_id"), F.col("best.row_key").alias("keep_key"), "group_size"), "copy-groups")
    return light.join(groups, "recipe").select(
        "id", "keep_id", "group_size", (F.col("row_key") == F.col("keep_key")).alias("kept"), "text_sha256", F.size("recipe").alias("n_chunks"))


def keep_distinct(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, with their columns."""
    key = free_name(docs, "sha256")
    stay = exact_groups(docs, id_col, text_col).where("kept").select(F.col("id").alias("__id"), F.col("text_sha256").alias("__sha"))
    marked = docs.withColumn(key, F.sha2(F.encode(strip_spaces(F.col(text_col)), "UTF-8"), 256))
    on = marked[id_col].eqNullSafe(stay["__id"]) & (marked[key] == stay["__sha"])
    return marked.join(stay, on, "left_semi").dropDuplicates([id_col, key]).select(*docs.columns)
