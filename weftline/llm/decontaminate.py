"""Benchmark decontamination by winnowing, in DataFrame functions only.

Of every ``WINNOW`` consecutive ``GRAM``-word hashes the least is kept with its
position, on both sides; a shared run of GRAM + WINNOW - 1 words then shares a
fingerprint.  That sum is the window of the contract, so no shared window is
missed.  A shared fingerprint lines a text up with an item; the hit is extended
to both sides, as far as a window over it can reach, by comparing words there.

Places of an item with one fingerprint and the same words around them, as far as
a window reaches, find the same windows: the item keeps the first of them, so a
repetitive text and a repetitive item meet in rows linear in the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import drop, free_name, is_small, stage

WINDOW = 13
GRAM = 6
WINNOW = WINDOW - GRAM + 1
#: Rows of fingerprints, ids or results that may be broadcast (some 20 to 150 bytes each); beyond it joins are shuffles.
BROADCAST_ROWS = 200_000
#: Words of all items together that may be broadcast.
BROADCAST_WORDS = 2_000_000
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Places of a text that are lined up and compared together; long hits are compared in such blocks.
BLOCK = 256
#: Bits of a packed fingerprint that hold its position; no array is longer.
_PLACE = (1 << 31) - 1


def words_of(text: Column) -> Column:
    """Runs of digits, letters and characters beyond ASCII, A-Z lower-cased; null has none."""
    text = F.coalesce(text, F.lit(""))
    plain = F.octet_length(text) == F.char_length(text)
    folded = F.when(plain, F.lower(text)).otherwise(F.translate(text, _UPPER, _UPPER.lower()))
    return F.regexp_extract_all(folded, F.lit("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"), F.lit(0))


def _starts(n: Column, width: int) -> Column:
    """1 .. n - width + 1, or none."""
    return F.when(n >= width, F.sequence(F.lit(1), n - F.lit(width - 1))).otherwise(F.array().cast("array<int>"))


def _each(array: str, i: Column, n: int) -> list[Column]:
    """Elements i .. i + n - 1, one by one: a slice would copy the whole array each time."""
    return [F.element_at(array, i + F.lit(k)) for k in range(n)]


def _between(array: str, low: Column, n: Column) -> Column:
    return F.transform(F.sequence(low, low + n - 1), lambda i: F.element_at(array, i))


def _short_runs(n: int) -> Column:
    return F.transform(_starts(F.size("h"), n), lambda i: F.struct(F.xxhash64(F.lit(n), *_each("h", i, n)).alias("f"), i.alias("at")))


def _with_fingerprints(df: DataFrame, words: str, lengths: list[int], *keep: str) -> DataFrame:
    """``keep`` and fingerprints, an array of (f, at): winnowed grams, and whole runs of the short lengths."""
    hashes = F.transform(words, lambda w: F.xxhash64(w))
    grams = F.transform(_starts(F.size("h"), GRAM), lambda i: F.xxhash64(*_each("h", i, GRAM)))
    # the place in the low bits: of equal hashes the leftmost is kept, on both sides
    packed = F.transform("g", lambda g, i: g.bitwiseAND(F.lit(~_PLACE)).bitwiseOR(i.cast("long")))
    least = F.array_distinct(F.transform(_starts(F.size("p"), WINNOW), lambda i: F.least(*_each("p", i, WINNOW))))
    at = lambda x: (x.bitwiseAND(F.lit(_PLACE)) + 1).cast("int")
    picked = F.transform(least, lambda x: F.struct(F.element_at("g", at(x)).alias("f"), at(x).alias("at")))
    short = [_short_runs(n) for n in lengths]
    out = df.select(*keep, hashes.alias("h")).select(*keep, "h", grams.alias("g")).select(*keep, "h", "g", packed.alias("p"))
    return out.select(*keep, (F.concat(picked, *short) if short else picked).alias("fingerprints"))


def _around(words: str, at: Column) -> Column:
    """128 bits of the words that windows over the fingerprint at ``at`` can hold, and of how far the text reaches there."""
    low = F.greatest(at - (WINNOW - 1), F.lit(1))
    seen = _between(words, low, F.least(at + (WINDOW - 1), F.size(words)) - low + 1)
    return F.struct((at - low).alias("before"), F.xxhash64(seen).alias("one"), F.xxhash64(F.lit(1), seen).alias("two"))


def item_texts(items: DataFrame, item_col: str, text_col: str) -> DataFrame:
    """(no, words, names): distinct word sequences of the items, and who has them; items without words have none."""
    rows = items.select(F.col(item_col).cast("string").alias("item"), words_of(F.col(text_col)).alias("words")).where(F.size("words") > 0)
    return rows.groupBy("words").agg(F.collect_set("item").alias("names")).select(F.xxhash64("words").alias("no"), "words", "names")


def _matches(same: Column, least: Column) -> Column:
    """(start, end) of the runs of true of at least this length, counted from 0."""
    none = F.array().cast("array<struct<start: int, end: int>>")
    zero = F.struct(F.lit(0).alias("i"), F.lit(0).alias("n"), none.alias("out"))

    def step(a: Column, x: Column) -> Column:
        ended = ~x & (a["n"] >= least)
        run = F.array(F.struct((a["i"] - a["n"]).alias("start"), a["i"].alias("end")))
        return F.struct((a["i"] + 1).alias("i"), F.when(x, a["n"] + 1).otherwise(0).alias("n"), F.when(ended, F.concat(a["out"], run)).otherwise(a["out"]).alias("out"))

    return F.aggregate(F.concat(same, F.array(F.lit(False))), zero, step, lambda a: a["out"])


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(id, n_words, n_hit, n_items, items_sha256, contaminated) of each row.

    A word inside an occurrence of an item's window is hit; a row is
    contaminated when words are hit and 20 * n_hit >= n_words.  Null and empty
    texts have no words and items without words no window.  Hits are found for
    (id, digest of the text), so repeated and null ids keep a row each with its
    own figures; a null item id counts for n_hit but is not listed.  Texts and
    items may be of any length that Spark holds in a row.
    """
    texts = stage(item_texts(items, item_col, item_text_col), "items")
    lengths = sorted(r[0] for r in texts.select(F.size("words")).distinct().where(F.size("words") < WINDOW).collect())  # twelve numbers at most

    key = [F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("digest")]
    words = docs.select(*key, words_of(F.col(text_col)).alias("words")).select("id", "digest", F.size("words").cast("long").alias("n_words"), "words")
    base = stage(_with_fingerprints(words, "words", lengths, "id", "digest", "n_words"), "fingerprints")

    given = texts.select("no", "words", F.size("words").alias("size"))
    # written before they are laid out: a filter on the size of an array would go below what makes it, and make it anew for each element
    grams = stage(_with_fingerprints(given.where(F.size("words") >= WINDOW), "words", [], "no", "size", "words"), "item-fingerprints")
    around = F.transform("fingerprints", lambda x: F.struct(x["f"].alias("f"), x["at"].alias("at"), _around("words", x["at"]).alias("around")))
    # of equal surroundings the first place
    wanted = grams.select("no", "size", F.inline(around)).groupBy("no", "size", "f", "around").agg(F.min("at").alias("at")).drop("around")
    for n in lengths:
        whole = F.xxhash64(F.lit(n), *[F.xxhash64(w) for w in _each("words", F.lit(1), n)]).alias("f")
        wanted = wanted.unionByName(given.where(F.col("size") == n).select("no", "size", whole, F.lit(1).alias("at")))
    wanted = stage(wanted.distinct().withColumnRenamed("at", "item_at"), "wanted")

    # each shared fingerprint lines the text up with the item; a window over it starts WINNOW - 1 words before it at most
    met = base.select("id", "digest", "n_words", F.inline("fingerprints")).join(F.broadcast(wanted) if is_small(wanted, BROADCAST_ROWS) else wanted, "f")
    shift = F.col("at") - F.col("item_at")
    low = F.greatest(F.col("at") - (WINNOW - 1), shift + 1, F.lit(1))
    high = F.least(F.col("at") + (WINDOW - 1), shift + F.col("size"), F.col("n_words").cast("int"))
    hits = met.groupBy("id", "digest", "no", shift.alias("shift"), F.floor(F.col("at") / BLOCK).alias("block")).agg(F.min(low).alias("low"), F.max(high).alias("high"))
    hits = stage(hits.groupBy(F.col("id").alias("i"), F.col("digest").alias("d")).agg(F.collect_list(F.struct("no", "shift", "low", "high")).alias("hits")), "candidates")

    small = is_small(hits, BROADCAST_ROWS)
    rows = docs.select(*key, F.col(text_col).alias("text"))
    again = rows.join(F.broadcast(hits.select("i", "d")) if small else hits.select("i", "d"), F.expr("id <=> i AND digest <=> d"), "left_semi").dropDuplicates(["id", "digest"])
    again = again.select("id", "digest", words_of(F.col("text")).alias("words")).join(F.broadcast(hits) if small else hits, F.expr("id <=> i AND digest <=> d"))
    # of a text only the words around its hits go on
    local = F.transform("hits", lambda x: F.struct(x["no"].alias("no"), x["shift"].alias("shift"), x["low"].alias("low"), _between("words", x["low"], x["high"] - x["low"] + 1).alias("seen")))
    aligned = stage(again.select("id", "digest", local.alias("local")), "aligned")
    placed = aligned.select("id", "digest", F.inline("local"))
    n_item_words = texts.agg(F.coalesce(F.sum(F.size("words")), F.lit(0))).head()[0]
    known = texts.select(F.col("no").alias("n"), F.col("words").alias("own"), "names")
    known = F.broadcast(known) if n_item_words <= BROADCAST_WORDS and is_small(texts, BROADCAST_ROWS) else known
    same = F.zip_with("seen", _between("own", F.col("low") - F.col("shift"), F.size("seen")), lambda x, y: x == y)
    extended = placed.join(known, F.col("no") == F.col("n")).select("id", "digest", "low", "names", _matches(same, F.least(F.size("own"), F.lit(WINDOW))).alias("runs")).where(F.size("runs") > 0)
    found = extended.select("id", "digest", "names", F.transform("runs", lambda r: F.struct((r["start"] + F.col("low")).alias("start"), (r["end"] + F.col("low")).alias("end"))).alias("spans"))

    span = found.groupBy("id", "digest").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("spans")))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("names")))).alias("items"))
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("upto"))
    covered = F.aggregate("spans", zero, lambda a, s: F.struct((a["n"] + F.greatest(F.lit(0), s["end"] - F.greatest(a["upto"], s["start"]))).alias("n"), F.greatest(a["upto"], s["end"]).alias("upto")), lambda a: a["n"])
    found = stage(span.select(F.col("id").alias("i"), F.col("digest").alias("d"), covered.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256")), "hits")
    drop(grams, wanted, hits, aligned, texts)
    out = base.select("id", "digest", "n_words").join(F.broadcast(found) if is_small(found, BROADCAST_ROWS) else found, F.expr("id <=> i AND digest <=> d"), "left")
    n_hit = F.coalesce("n_hit", F.lit(0))
    return out.select(
        F.col("id").alias(id_col), "n_words", n_hit.alias("n_hit"), F.coalesce("n_items", F.lit(0)).alias("n_items"), F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"), ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated")
    )


def drop_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Rows of ``docs`` that are not contaminated, columns as they are."""
    digest = F.xxhash64(F.col(text_col))
    rows = docs.select(F.struct(F.col(id_col).alias("id"), digest.alias("digest")).alias("key"), F.col(text_col).alias("text"))
    judged = contamination(rows, items, "key", "text", item_col, item_text_col)
    i, d = free_name(docs, "_i"), free_name(docs, "_d")
    bad = stage(judged.where("contaminated").select(F.col("key.id").alias(i), F.col("key.digest").alias(d)).distinct(), "contaminated")
    return docs.join(F.broadcast(bad) if is_small(bad, BROADCAST_ROWS) else bad, F.col(id_col).eqNullSafe(F.col(i)) & (digest == F.col(d)), "left_anti")
