"""Near copies by five-word shingles: texts of Jaccard likeness 0.8 or more.

SimHash comes first: fingerprints of the shingle sets that share pigeonhole blocks and differ in three bits at most
are candidates, which finds the closest copies cheaply. A likeness of 0.8 is about ten differing bits, so most other
pairs are beyond any block scheme of 64 bits; they are found by signature bands, which miss a pair of that
likeness with a chance of 1e-8. Every link is confirmed on the full sets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from contestry.llm import simhash, superminhash
from contestry.llm.common import components, dropped, fresh, spool

LAW = superminhash.Law(5, (4, 5), 4, 0.6)


def close_prints(nodes: DataFrame) -> DataFrame:
    """Candidate links (a, b) between nodes of equal or close SimHash fingerprints, enough to connect each such class."""
    first = nodes.groupBy("fp").agg(F.min("node").alias("hub"))
    equal = nodes.join(first, "fp").where("node <> hub").select(F.col("hub").alias("a"), F.col("node").alias("b"))
    pairs = simhash.links(nodes, "fp").distinct()
    for c in ("a", "b"):
        pairs = pairs.join(first.select(F.col("fp").alias(c), F.col("hub").alias(f"of_{c}")), c).drop(c)
    return equal.union(pairs.select(F.least("of_a", "of_b").alias("a"), F.greatest("of_a", "of_b").alias("b"))).distinct()


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` without near copies: one row of each class stays.

    Classes are chains of texts whose five-word shingles (lower-cased, as sets) have Jaccard likeness 0.8 or
    more; texts without words are one class, shorter texts are alike where their words are the same. The row
    with the smallest id stays (null ids last, then the smallest text hash; of equal rows any). All columns
    of ``docs`` are returned, whatever their names. An empty table gives no rows.
    """
    rows = spool(superminhash.signed(docs, LAW.width, id_col, text_col), "near")
    nodes = superminhash.node_rows(rows)
    candidates = spool(close_prints(nodes), "prints")
    known = superminhash.confirmed(docs, candidates, nodes, LAW, text_col)
    label = superminhash.links(docs, nodes, LAW, text_col, known)
    order = F.struct(F.col("doc_id").isNull().alias("x"), F.col("doc_id").alias("i"), F.col("h"))
    lows = rows.groupBy("node").agg(F.min(order).alias("r")).join(label, "node", "left")
    kept = lows.groupBy(F.coalesce("label", "node")).agg(F.min("r").alias("r")).select(F.col("r.i").alias("i"), "r.h", F.lit(True).alias("stays"))
    each = rows.groupBy(F.col("doc_id").alias("i"), "h").agg(F.count("*").alias("n")).alias("e")
    each = each.join(kept.alias("k"), F.col("e.i").eqNullSafe(F.col("k.i")) & (F.col("e.h") == F.col("k.h")), "left").select("e.i", "e.h", "n", "stays")
    marks = spool(each.where("stays is null or n > 1").select("i", "h", F.col("stays").isNotNull().alias("once")), "marks")
    ki, kh, ri, rh, once = fresh(docs, "_mark_i", "_mark_h", "_row_i", "_row_h", "_once")
    found = marks.select(F.col("i").alias(ki), F.col("h").alias(kh), F.col("once").alias(once))
    found = F.broadcast(found) if marks.count() <= superminhash.PICKED else found
    marked = docs.withColumns({ri: F.col(f"`{id_col}`"), rh: F.xxhash64(f"`{text_col}`")})
    marked = marked.join(found, F.col(ri).eqNullSafe(F.col(ki)) & (F.col(rh) == F.col(kh)), "left")
    dropped(nodes, candidates)
    out = marked.where(F.col(once).isNull())
    if marks.where("once").count():  # equal rows, of which one stays
        out = out.union(marked.where(F.col(once)).dropDuplicates([ri, rh]))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])
