"""Benchmark decontamination by template windows; DataFrame functions only.

A text's tokens are its white-space pieces. A piece with a digit becomes the placeholder #num, a unit right after a number
#unit, a piece that doesn't begin a sentence and has a capital of any script, after opening marks or none, #name; the others are lower-cased and lose their punctuation.
Windows of WINDOW template tokens are joined by hash, documents against benchmark items, so a question with other
numbers, names or units meets the item that it was made from. An item without a window of enough literal tokens is one
window as a whole: of its template, or of its very words and numbers if it has few literal tokens at all. Matches of a
document and an item on one diagonal (their places' difference) are one occurrence. Its slots must be consistent: a name
of the item always stands for one name of the document and the other way round. Two numbers, or two units, may be equal by
chance in the item and not in the document, so with these half of the different pairs may break that rule. Slots are
compared as templates are, in lower case and without punctuation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table, without_rows

WINDOW = 8
#: Tokens of a window that are no placeholders, at least; others say nothing.
LITERAL = 4
#: An occurrence counts with this share of the item's windows, or with this many.
COVERAGE = 0.5
RUN = 5
#: Of the different pairs of numbers, or of units, so many at least must be one to one.
AGREEING = 0.5
#: Bytes of benchmark windows that are sent to every task, at most; beyond it both sides are shuffled (a frequent window is then a skewed join, which adaptive execution splits).
BROADCAST_BYTES = 32 << 20
_MARKS = ".,;:!?\"()'«»„“”‘’¿¡"
#: Longer words that are units after a number; a word of up to three letters, of any script, or a sign is one there whatever it is.
UNITS = ("mm", "cm", "m", "km", "g", "mg", "kg", "t", "l", "ml", "s", "ms", "h", "min", "mph", "kmh", "lb", "lbs", "oz", "ft", "mi", "usd", "eur", "dollar", "dollars", "euro", "euros", "cent", "cents", "percent", "inch", "inches", "foot", "feet", "mile", "miles", "meter", "meters", "metre", "metres", "gram", "grams", "liter", "liters", "litre", "litres", "second", "seconds", "minute", "minutes", "hour", "hours", "day", "days", "week", "weeks", "month", "months", "year", "years")


def _template(text: Column) -> Column:
    """The text with placeholders; white space stays where it is, so pieces keep their numbers."""
    out = F.regexp_replace(text, r"(?<!\S)[^\s0-9]*+[0-9]\S*+", "#num")
    out = F.regexp_replace(out, r"(?<=[^\s.!?:]\s)[\"('«„“‘¿¡]*+\p{Lu}\S*+", "#name")
    out = F.regexp_replace(out, rf"(?<=#num\s)(?:{'|'.join(sorted(UNITS, key=len, reverse=True))}|\p{{Ll}}{{1,3}}|[%‰°€$£¥]\p{{L}}?)(?=[\s.,;:!?)]|$)", "#unit")
    return F.translate(F.lower(out), _MARKS, "")


def windows(texts: DataFrame, width: int = WINDOW) -> DataFrame:
    """Adds pieces and template (arrays of equal length, pieces that are punctuation only left out) and hashes, those of all windows; without text or with under `width` tokens there are none."""
    text = F.coalesce("text", F.lit(""))
    # Each array is referred to once here, or the optimizer would copy its expression into what is evaluated per element.
    both = F.arrays_zip(F.split(_template(text), r"\s").alias("t"), F.split(text, r"\s").alias("p"))
    texts = texts.select("*", F.filter(both, lambda x: x["t"] != "").alias("_both"))
    texts = texts.select(*texts.columns[:-1], F.transform("_both", lambda x: x["p"]).alias("pieces"), F.transform("_both", lambda x: x["t"]).alias("template"))
    starts = F.when(F.size("template") >= width, F.sequence(F.lit(1), F.size("template") - width + 1)).otherwise(F.array().cast("array<int>"))
    return texts.withColumn("hashes", F.transform(starts, lambda i: F.xxhash64(F.slice("template", i, width))))


def _whole(ways: DataFrame, usable: DataFrame) -> DataFrame:
    """Items without usable windows as one window each: rows as of items, and the window's length and whether it's exact."""
    plain = F.transform("pieces", lambda x: F.translate(F.lower(x), _MARKS, ""))
    rest = ways.join(usable.select("item_id").distinct(), "item_id", "left_anti").where(F.size("template") > 0)
    rest = rest.withColumn("length", F.size("template")).withColumn("exact", F.size(F.filter("template", lambda x: ~x.startswith("#"))) < LITERAL)
    hash_ = F.when(F.col("exact"), F.xxhash64(F.lit(1), plain)).otherwise(F.xxhash64("template"))
    return rest.select("item_id", F.lit(0).alias("item_at"), hash_.alias("hash"), F.col("pieces").alias("item_pieces"), F.when(F.col("exact"), F.transform("template", lambda x: F.lit(""))).otherwise(F.col("template")).alias("slots"), "length", "exact").dropDuplicates(["item_id", "hash"])


def _windows_of(modes: list[tuple[int, bool]]) -> Column:
    """(at, hash) of a document's windows for the whole items of each (length, exact)."""
    known = F.array(*(F.struct(F.lit(n).alias("n"), F.lit(e).alias("e")) for n, e in modes))
    at = lambda m, i: F.when(m["e"], F.xxhash64(F.lit(1), F.slice("plain", i + 1, m["n"]))).otherwise(F.xxhash64(F.slice("template", i + 1, m["n"])))
    starts = lambda m: F.when(F.size("template") >= m["n"], F.sequence(F.lit(0), F.size("template") - m["n"])).otherwise(F.array().cast("array<int>"))
    return F.flatten(F.transform(known, lambda m: F.transform(starts(m), lambda i: F.struct(i.alias("at"), at(m, i).alias("hash")))))


def matches(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW) -> DataFrame:
    """(row, doc_id, item_id, n_matched, n_windows, coverage, consistent) for every occurrence of window matches; row is the hash of doc_id and text."""
    part = lambda c, at, n=width: F.slice(c, F.col(at) + 1, n)
    plain = lambda x: F.translate(F.lower(x), _MARKS, "")
    known = benchmark.where("text is not null")
    # Within a document an item may follow on other words; its first piece is then no beginning of a sentence.
    read = [(first, windows(known.select("item_id", text.alias("text")), width)) for first, text in ((0, F.col("text")), (1, F.concat(F.lit("a "), "text")))]
    ways = [made.select("item_id", "pieces", "template", F.posexplode_outer("hashes").alias("at", "hash")).where(F.col("at") >= first).withColumn("item_at", F.col("at") - first) for first, made in read]
    items = ways[0].union(ways[1]).select("item_id", "item_at", "hash", part("pieces", "at").alias("item_pieces"), part("template", "at").alias("slots")).dropDuplicates(["item_id", "item_at", "hash"])
    items = items.where(F.size(F.filter("slots", lambda x: ~x.startswith("#"))) >= LITERAL)
    cut = [made.select("item_id", *(F.slice(c, first + 1, F.greatest(F.size(c) - first, F.lit(0))).alias(c) for c in ("pieces", "template"))) for first, made in read]
    whole = _whole(cut[0].union(cut[1]), items)
    modes = [(r[0], r[1]) for r in whole.select("length", "exact").distinct().collect()]  # at most two for each length of an item
    items = items.union(whole.drop("length", "exact")) if modes else items
    # The outer form of posexplode: for the inner one the optimizer adds a filter on the array's size and computes all arrays twice.
    total = items.groupBy("item_id").agg(F.count_distinct("item_at").alias("n_windows"))
    weight = F.octet_length(F.array_join("item_pieces", "")) + F.octet_length(F.array_join("slots", "")) + 16 * (F.size("slots") + 4)
    few = items.agg(F.coalesce(F.sum(weight), F.lit(0))).first()[0] <= BROADCAST_BYTES
    found = windows(docs.select(F.xxhash64("doc_id", "text").alias("row"), "doc_id", "text"), width).drop("text")
    if modes:
        found = found.withColumn("plain", F.transform("pieces", lambda x: F.translate(F.lower(x), _MARKS, "")))
        both = F.concat(F.transform("hashes", lambda h, i: F.struct(i.alias("at"), h.alias("hash"))), _windows_of(modes))
        found = found.select("row", "doc_id", "pieces", F.explode_outer(both).alias("w")).select("row", "doc_id", "pieces", "w.at", "w.hash")
    else:
        found = found.select("row", "doc_id", "pieces", F.posexplode_outer("hashes").alias("at", "hash"))
    met = found.join(F.broadcast(items) if few else items, "hash")
    if modes:
        # Two or three words stand in many texts by chance: such an item counts where it is a sentence or a text of its own.
        ends = lambda at: F.element_at("pieces", at).rlike(r"[.!?:][\"')]*$")
        n = F.size("slots")
        alone = ((F.col("at") == 0) | ends(F.greatest(F.col("at"), F.lit(1)))) & ((F.col("at") + n == F.size("pieces")) | ends(F.col("at") + n))
        met = met.where((n >= LITERAL) | alone)
    size = F.size("slots") if modes else width
    pairs = F.arrays_zip(part("pieces", "at", size).alias("ours"), F.col("item_pieces").alias("theirs"), F.col("slots").alias("slot"))
    pairs = F.filter(pairs, lambda x: x["slot"].startswith("#"))
    met = met.select("row", "doc_id", "item_id", "item_at", (F.col("at") - F.col("item_at")).alias("diagonal"), F.transform(pairs, lambda x: F.struct(x["slot"].alias("slot"), plain(x["ours"]).alias("ours"), plain(x["theirs"]).alias("theirs"))).alias("pairs"))
    out = met.groupBy("row", "doc_id", "item_id", "diagonal").agg(F.count_distinct("item_at").alias("n_matched"), F.array_distinct(F.flatten(F.collect_set("pairs"))).alias("pairs"))

    def one_to_one(share: float, *slots: str) -> Column:
        """Whether such a share of the different pairs of these slots is as many values on either side."""
        own = F.filter("pairs", lambda x: x["slot"].isin(*slots))
        different = lambda side: F.size(F.array_distinct(F.transform(own, lambda x: F.concat_ws(" ", x["slot"], x[side]))))
        return F.least(different("ours"), different("theirs")) >= share * F.size(own)

    consistent = one_to_one(1.0, "#name") & one_to_one(AGREEING, "#num", "#unit")
    out = out.join(F.broadcast(total) if few else total, "item_id")
    return out.select("row", "doc_id", "item_id", "n_matched", "n_windows", (F.col("n_matched") / F.col("n_windows")).alias("coverage"), consistent.alias("consistent"))


def contaminated(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW, coverage: float = COVERAGE, run: int = RUN) -> DataFrame:
    """The matches that count, one row for each document and item: the best occurrence that is consistent."""
    good = matches(docs, benchmark, width).where(F.col("consistent") & ((F.col("coverage") >= coverage) | (F.col("n_matched") >= run)))
    return good.groupBy("row", "doc_id", "item_id").agg(F.max("n_matched").alias("n_matched"), F.max("n_windows").alias("n_windows"), F.max("coverage").alias("coverage"))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, item_id, n_matched, n_windows, coverage): documents with passages of benchmark items, as they stand or with other numbers, names or units.

    Null and empty texts have none. An item without a usable window is found as a whole only, one of under LITERAL tokens
    only where it is a sentence or a text of its own. Documents that repeat doc_id and text are one.
    """
    return contaminated(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark")).drop("row")


def without_benchmark(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the contaminated documents; columns, whatever their names, and repeated rows stay as they are."""
    return without_rows(docs, F.xxhash64("doc_id", "text"), contaminated(docs, benchmark))
