"""Sequence encoding (C1-C3): symbol spacing, vocabulary, fixed-length ids.

The vocabulary is a table.  When it is small (checked by counting it) it is
collected once and inlined as a literal ``MAP`` so encoding is one projection
inside whole-stage codegen; a larger vocabulary is joined instead.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..constants import EOS_ID, MAX_LEN, PAD_ID, UNK_ID
from ..functions.arrays import space_symbols
from ..session import materialized

MAP_LIMIT = 4_096   # largest vocabulary inlined as a literal map (kept small: it becomes code)


def symbols(seq) -> F.Column:
    """The symbols of a string as an array (no empty trailing element)."""
    return F.filter(F.split(seq, ""), lambda s: s != F.lit(""))


def spaced(df: DataFrame, seq: str = "sequence", out: str = "title") -> DataFrame:
    """Adds the blank-separated form of the whole sequence (the title key)."""
    return df.withColumn(out, space_symbols(seq))


def build_vocab(df: DataFrame, seq: str = "sequence", id_col: str = "id", min_count: int = 1,
                first_id: int = 3) -> DataFrame:
    """Symbol table of a corpus: ``symbol, count, share, n_docs, token_id``.

    Counts are first combined per document (map-side: a document sits in one
    task), so only (document, distinct symbol) rows are shuffled.  Ids are
    assigned by (count desc, symbol) from ``first_id`` on (after the specials),
    over the small symbol table.
    """
    per_doc = df.select(id_col, F.explode(symbols(F.col(seq))).alias("symbol")) \
        .groupBy(id_col, "symbol").agg(F.count(F.lit(1)).alias("_c"))
    v = per_doc.groupBy("symbol").agg(F.sum("_c").alias("count"), F.count(F.lit(1)).alias("n_docs")) \
        .filter(F.col("count") >= min_count)
    w_all = Window.partitionBy()
    w = Window.orderBy(F.desc("count"), "symbol")   # over the symbol table only
    return v.select("symbol", "count", (F.col("count") / F.sum("count").over(w_all)).alias("share"), "n_docs",
                    (F.row_number().over(w) + F.lit(first_id - 1)).cast("int").alias("token_id"))


def encode(df: DataFrame, vocab: DataFrame, seq: str = "sequence", id_col: str = "id", max_len: int = MAX_LEN,
           pad_id: int = PAD_ID, eos_id: int = EOS_ID, unk_id: int = UNK_ID) -> DataFrame:
    """Fixed-length encoding.

    Symbols -> ids (unknown -> ``unk_id``), end marker appended, cut to
    ``max_len`` *including* the marker (``max_len - 1`` symbols), right-padded
    with ``pad_id``; ``attention_mask`` is 1 on real tokens.  Adds
    ``n_symbols`` (whole sequence), ``n_tokens`` and ``truncated``.  Rows are
    encoded one by one, whether or not their ids repeat, and a missing sequence
    gives NULL ids; both forms of the lookup (a literal map up to ``MAP_LIMIT``
    symbols, a join beyond) return the same.
    """
    keep = max_len - 1
    # one job both checks the size and fetches a small vocabulary (never more than MAP_LIMIT + 1 rows)
    pairs = vocab.select("symbol", "token_id").limit(MAP_LIMIT + 1).collect()
    if len(pairs) <= MAP_LIMIT:
        m = F.create_map(*[x for r in pairs for x in (F.lit(r["symbol"]), F.lit(int(r["token_id"])))]) if pairs \
            else F.create_map().cast("map<string,int>")
        # only the first max_len-1 symbols are ever encoded: slice the text, not a 100k-element array
        toks = symbols(F.substring(F.col(seq), 1, keep))
        ids = F.transform(toks, lambda s: F.coalesce(F.try_element_at(m, s), F.lit(unk_id)))
        enc = df.withColumn("_ids", ids)
    else:
        # rows are told apart by a number of their own: ids may repeat.  It is written
        # once, so both sides of the join see the same numbers
        df, columns = materialized(df.withColumn("_row", F.monotonically_increasing_id()), "encode-rows"), df.columns
        toks = df.select("_row", F.posexplode(symbols(F.substring(F.col(seq), 1, keep))).alias("_p", "symbol"))
        j = toks.join(vocab.select("symbol", "token_id"), "symbol", "left")
        per = j.groupBy("_row").agg(F.array_sort(F.collect_list(F.struct("_p", F.coalesce("token_id", F.lit(unk_id))
                                                                          .alias("t")))).alias("_s"))
        enc = df.join(per.select("_row", F.transform("_s", lambda s: s["t"]).alias("_ids")), "_row", "left") \
            .withColumn("_ids", F.when(F.col(seq).isNotNull(), F.coalesce("_ids", F.array().cast("array<int>")))).select(*columns, "_ids")
        df = df.select(*columns)
    body = F.concat(F.col("_ids"), F.array(F.lit(eos_id)))
    return enc.withColumn("_body", body).select(
        *[c for c in df.columns],
        F.concat("_body", F.array_repeat(F.lit(pad_id), F.lit(max_len) - F.size("_body"))).alias("input_ids"),
        F.concat(F.array_repeat(F.lit(1), F.size("_body")),
                 F.array_repeat(F.lit(0), F.lit(max_len) - F.size("_body"))).alias("attention_mask"),
        F.size("_body").alias("n_tokens"),
        F.length(seq).cast("bigint").alias("n_symbols"),
        (F.length(seq) > F.lit(keep)).alias("truncated"),
    )
