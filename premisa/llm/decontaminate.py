"""Benchmark decontamination by winnowing, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from premisa.llm.common import BROADCAST_BYTES, fresh, let, look_up, others, quoted
from premisa.sources.staging import settle

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """Words of a text with A-Z in lower case; a NULL text has none."""
    lowered = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    return F.regexp_extract_all(lowered, F.lit(WORD), F.lit(0))


def folded(text: Column) -> Column:
    """All letters lowered, sigma in one form, as the final one depends on what follows the word."""
    return F.replace(F.lower(text), F.lit("ς"), F.lit("σ"))


def folded_words(text: Column) -> Column:
    """As ``words``, but all letters are lowered, which is faster. The bounds are the same, and
    equal words stay equal, so against words that are ``folded`` too it can only add candidates."""
    return F.regexp_extract_all(folded(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def grams(tokens: Column, k: int) -> Column:
    """Hash of the k words from each place on, its lowest four bits the place modulo 16."""
    return let(
        F.transform(tokens, lambda w: F.xxhash64(w)),
        lambda h: F.transform(
            F.sequence(F.lit(0), F.size(h) - k),
            lambda i: F.shiftleft(F.xxhash64(*[F.get(h, i + j) for j in range(k)]), 4).bitwiseOR(
                i.bitwiseAND(15).cast("bigint")
            ),
        ),
    )


def winnowed(tokens: Column, span: int, k: int) -> Column:
    """Places and hashes kept by winnowing: the smallest k-gram of each ``span`` words.

    ``span - k + 1`` neighbouring grams (16 at most) form a window, so any ``span`` words that two
    texts share hold a gram kept in both. The four low bits tell where in its window a minimum is.
    """
    w = span - k + 1
    kept = let(
        grams(tokens, k),
        lambda g: let(
            F.array_distinct(
                F.transform(
                    F.sequence(F.lit(0), F.size(g) - w),
                    lambda i: i
                    + (F.array_min(F.slice(g, i + 1, F.lit(w))) - i)
                    .bitwiseAND(F.lit(15).cast("bigint"))
                    .cast("int"),
                )
            ),
            lambda places: F.transform(
                places, lambda p: F.struct(p.alias("p"), F.shiftright(F.get(g, p), 4).alias("f"))
            ),
        ),
    )
    return F.when(F.size(tokens) >= span, kept)


def _hints(docs: DataFrame, items: DataFrame, span: int, gram: int, limit: int) -> DataFrame:
    """Where items may occur in documents: id, item and the place of the item's first word."""
    k = max(1, min(gram, (span + 1) // 2))
    item_words = F.transform(F.col("_words"), folded)
    all_grams = F.transform(let(item_words, lambda w: grams(w, k)), lambda x: F.shiftright(x, 4))
    known = items.select("_item", F.posexplode(all_grams).alias("q", "f"))
    known = settle(known, "benchmark-grams")
    kept = let(folded_words(F.col("_text")), lambda w: winnowed(w, span, k))
    found = docs.select("_id", F.explode(kept).alias("x")).select("_id", "x.p", "x.f")
    hits = look_up(found.withColumnRenamed("f", "_f"), known, F.expr("_f = f"), limit=limit)
    return hits.select("_id", "_item", (F.col("p") - F.col("q")).alias("shift"))


def _spans(tokens: Column, hint: Column, span: int) -> Column:
    """Occurrences of whole windows of one item, word by word along each hinted shift."""
    size = F.least(F.size(hint["words"]), F.lit(span))

    def along(shift: Column) -> Column:
        same = F.transform(
            hint["words"], lambda x, j: F.coalesce(F.get(tokens, shift + j) == x, F.lit(False))
        )
        starts = let(
            same,
            lambda m: F.filter(
                F.sequence(F.lit(0), F.size(m) - size),
                lambda s: F.forall(F.slice(m, s + 1, size), lambda x: x),
            ),
        )
        return F.transform(
            starts,
            lambda s: F.struct((shift + s).alias("start"), (shift + s + size).alias("end")),
        )

    return F.flatten(F.transform(hint["shifts"], along))


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    doc_id: str = "doc_id",
    item_id: str = "item_id",
    text: str = "text",
    span: int = 13,
    gram: int = 5,
    into: str = "shared",
    limit: int = BROADCAST_BYTES,
) -> DataFrame:
    """Mark what documents share with benchmark items, ``span`` words or more at a time.

    Adds the struct ``into`` of ``n_words``, ``n_hit`` (words inside any shared window) and
    ``items``: each item with a shared window and these windows as word places, end excluded. An item
    shorter than ``span`` words is one window.

    Winnowed word grams of the documents meet all grams of the items. A document gram is kept per
    window of ``span`` words, so no shared window is missed; shared grams are then extended word by
    word on the exact words. Items shorter than ``span`` are searched with the window of the shortest
    of them. Document text is not shuffled while items and hints measure below ``limit``.

    Every row is judged on its own text, also where ids repeat or are NULL. A NULL or empty text has
    no words. Items without an id or without words are skipped, repeated ids count once. A column
    named like ``into`` is replaced; other columns pass through.
    """
    items = benchmark.select(F.col(item_id).alias("_item"), words(F.col(text)).alias("_words"))
    items = settle(items.where("_item is not null and size(_words) > 0").distinct(), "items")
    size = F.size("_words")
    short, long = items.agg(F.min(F.when(size < span, size)), F.max(size >= span)).first()

    key, hinted = fresh(docs, "_id"), fresh(docs, "_hints")
    keyed = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text"))
    parts = []
    if long:
        parts.append(_hints(keyed, items.where(size >= span), span, gram, limit))
    if short is not None:
        parts.append(_hints(keyed, items.where(size < span), short, gram, limit))
    if parts:
        hints = parts[0] if len(parts) == 1 else parts[0].union(parts[1])
        shifts = hints.groupBy("_id", "_item").agg(F.collect_set("shift").alias("shifts"))
        shifts = shifts.withColumnRenamed("_item", "_of")
        named = look_up(shifts, items, F.expr("_of = _item"), limit=limit)
        hint = F.struct("_item", F.col("_words").alias("words"), "shifts")
        named = named.groupBy(F.col("_id").alias(key)).agg(F.collect_list(hint).alias(hinted))
        named = settle(named, "hints")
        rows = look_up(docs, named, F.col(doc_id).eqNullSafe(F.col(key)), "left", limit).drop(key)
    else:
        kind = items.schema["_item"].dataType.simpleString()
        empty = F.lit(None).cast(
            f"array<struct<_item:{kind},words:array<string>,shifts:array<int>>>"
        )
        rows = docs.withColumn(hinted, empty)

    def judged(w: Column) -> Column:
        found = F.transform(
            F.coalesce(F.col(hinted), F.array()),
            lambda h: F.struct(h["_item"].alias("item_id"), _spans(w, h, span).alias("spans")),
        )
        return let(
            F.filter(found, lambda x: F.size(x["spans"]) > 0),
            lambda items: F.struct(
                F.size(w).cast("bigint").alias("n_words"),
                F.size(
                    F.array_distinct(
                        F.flatten(
                            F.transform(
                                F.flatten(F.transform(items, lambda x: x["spans"])),
                                lambda s: F.sequence(s["start"], s["end"] - 1),
                            )
                        )
                    )
                )
                .cast("bigint")
                .alias("n_hit"),
                items.alias("items"),
            ),
        )

    kept = [quoted(f.name) for f in others(docs, into)]
    return rows.select(*kept, let(words(F.col(text)), judged).alias(into))


def contaminated(into: str = "shared") -> Column:
    """At least one word in twenty lies in a shared window."""
    x = F.col(into)
    return (x["n_hit"] > 0) & (20 * x["n_hit"] >= x["n_words"])
