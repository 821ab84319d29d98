"""Benchmark decontamination by template canonicalisation, in DataFrame functions only.

Texts are cut once into tokens (runs of letters or of digits), and each token is classed in place: numbers, names (a
capitalised word after a word or comma, not at a start) and units (after a number) become typed placeholders, so a question
and its re-parameterised copy have the same template, and a token and its placeholder always have the same place.

Windows of W template tokens are hashed and joined; an item of fewer tokens has one window, of its whole length, and is
met by windows of that length. A window of placeholders only says nothing but its values, so these are hashed instead and
must be met unchanged. Documents are first probed with the hashes of all their windows, which meets every shared run of
W tokens and every short item; the documents that were hit are then matched with their tokens. Matches of one document
and item on one diagonal (the same distance between the two positions) are one occurrence, and count only if its slots
are consistent: each value of the item stands for one value of the document throughout. An item leaked into a document if
consistent occurrences cover LEAST of its windows, or if one run of adjoining windows is RUN tokens long, however long the
item is. Such a run is an unbroken one with consistent slots from end to end, or a part of one in which no slot differs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from engram.llm.common import cut, drop

W, LEAST, RUN = 8, 0.5, 13
#: Bytes of an index of windows, and ids of documents, up to which they are broadcast; beyond, the joins shuffle.
BROADCAST_BYTES, BROADCAST_IDS = 64 << 20, 1_000_000
# Spellings of units that may follow a number.
UNITS = [
    "mm", "cm", "m", "km", "in", "ft", "yd", "mi", "mg", "g", "kg", "t", "lb", "oz", "ml", "cl", "l", "gal", "s", "sec", "secs", "second", "seconds",
    "min", "mins", "minute", "minutes", "h", "hr", "hrs", "hour", "hours", "day", "days", "week", "weeks", "month", "months", "year", "years",
    "meter", "meters", "metre", "metres", "kilometer", "kilometers", "kilometre", "kilometres", "mile", "miles", "inch", "inches", "foot", "feet",
    "gram", "grams", "kilogram", "kilograms", "liter", "liters", "litre", "litres", "dollar", "dollars", "cent", "cents", "euro", "euros",
    "pound", "pounds", "percent", "degree", "degrees", "hz", "khz", "mhz", "ghz", "w", "kw", "v", "kb", "mb", "gb", "tb",
]
NUMBER, NAME, UNIT = "§d", "§n", "§u"


def token_array(text: Column) -> Column:
    """Tokens in lower case; a name has § before it."""
    marked = F.regexp_replace(F.translate(F.coalesce(text, F.lit("")), "§", " "), r"(\p{Lu})(?<=[\p{Ll}\p{N}],? .)", "§$1")
    return F.regexp_extract_all(F.lower(marked), F.lit(r"§?\p{L}[\p{L}\p{M}]*|\p{N}+"), F.lit(0))


def values_of(tokens: Column) -> Column:
    return F.transform(tokens, lambda x: F.ltrim(x, F.lit("§")))


def template_of(tokens: Column) -> Column:
    """The template token of each of token_array's tokens."""
    number = lambda x: (x < "a") | (x > "z~") & x.rlike(r"^\p{N}")
    unit = lambda x, i: x.isin(UNITS) & (i > 0) & number(F.get(tokens, i - 1))
    return F.transform(tokens, lambda x, i: F.when(number(x), NUMBER).when(x.startswith("§"), NAME).when(unit(x, i), UNIT).otherwise(x))


def _window_hash(shapes: Column, tokens: Column, at: Column, length: Column) -> Column:
    """The hash of the window at a place: of its template, or of its values if it holds placeholders only."""
    shape = F.slice(shapes, at + 1, length)
    marks = [F.xxhash64(F.lit(x)) for x in (NUMBER, NAME, UNIT)]
    bare = F.get(shapes, at).isin(*marks) & F.forall(shape, lambda h: h.isin(*marks))
    return F.when(bare, F.xxhash64(length, F.lit(1), F.slice(tokens, at + 1, length))).otherwise(F.xxhash64(length, shape))


def _places(shapes: Column, length: Column) -> Column:
    n = F.size(shapes)
    return F.when((length > 0) & (n >= length), F.sequence(F.lit(0), n - length)).otherwise(F.array().cast("array<int>"))


def _long_runs(met: DataFrame) -> DataFrame:
    """(doc_id, item_id, hs, slots) of the unbroken runs of RUN tokens or more among matches of whole windows."""
    diagonal = ["doc_id", "th", "item_id", "ih", "diagonal"]
    runs = met.withColumn("run", F.col("i") - F.dense_rank().over(Window.partitionBy(*diagonal).orderBy("i")))
    runs = runs.groupBy(*diagonal, "run").agg(F.count_distinct("i").alias("n"), F.collect_set("h").alias("hs"), F.array_distinct(F.flatten(F.collect_set("slots"))).alias("slots"))
    return runs.where(F.col("n") >= RUN - W + 1).select("doc_id", "item_id", "hs", "slots")


def leaks(docs: DataFrame, benchmark: DataFrame, least: float = LEAST) -> DataFrame:
    """Pairs of docs(doc_id, text) and benchmark(item_id, text): doc_id, item_id, windows, item_windows, coverage, reparameterised.

    coverage is the share of the item's distinct windows that consistent occurrences and long runs cover;
    reparameterised says that some slot differs. Null ids are in no pair; null and empty texts have no windows and match
    nothing; repeated rows count once, and rows of one id with different texts are matched each, the id's best counting;
    texts of any length are read whole; other columns are ignored, whatever their names; an empty table gives no rows."""
    item_tokens = token_array(F.col("text"))
    items = benchmark.where("item_id is not null").select("item_id", item_tokens.alias("it")).distinct().withColumn("ip", template_of(F.col("it")))
    items = items.withColumn("iv", values_of(F.col("it"))).withColumn("shapes", F.transform("ip", lambda x: F.xxhash64(x))).withColumn("length", F.least(F.size("ip"), F.lit(W)))
    index = items.select("item_id", "iv", "shapes", "length", F.xxhash64("iv").alias("ih"), F.explode(_places(F.col("shapes"), F.col("length"))).alias("j"))
    index = index.select("item_id", "ih", "j", _window_hash(F.col("shapes"), F.col("iv"), F.col("j"), F.col("length")).alias("h"), F.slice("iv", F.col("j") + 1, F.col("length")).alias("iv"))
    short = sorted(r.n for r in items.select(F.size("ip").alias("n")).where((F.col("n") > 0) & (F.col("n") < W)).distinct().collect())  # W - 1 numbers at most
    size = index.agg(F.sum(F.length(F.concat_ws("", "iv")) + 16 * W + 64)).first()[0] or 0
    small = F.broadcast if size <= BROADCAST_BYTES else (lambda df: df)
    totals = index.groupBy("item_id").agg(F.count_distinct("h").alias("item_windows"))
    known = docs.where("doc_id is not null").select("doc_id", "text")

    def shaped(df: DataFrame, *keep: Column | str) -> DataFrame:
        """keep, the values, template and hashed template of every text."""
        tokens = df.select(*keep, token_array(F.col("text")).alias("t"))
        return tokens.select(*keep, values_of(F.col("t")).alias("t"), template_of(F.col("t")).alias("p")).select(*keep, "t", "p", F.transform("p", lambda x: F.xxhash64(x)).alias("shapes"))

    def windows(row) -> Column:
        """row(place, hash, length) of every window that an item may have."""
        each = lambda n: F.transform(_places(F.col("shapes"), F.lit(n)), lambda i: row(i, _window_hash(F.col("shapes"), F.col("t"), i, F.lit(n)), F.lit(n)))
        return F.concat(*(each(n) for n in [W, *short]))

    probes = shaped(known, "doc_id").select("doc_id", F.explode(windows(lambda i, h, n: h)).alias("h"))
    hit = probes.join(small(index.select("h").distinct()), "h", "left_semi").select("doc_id").distinct()
    hit, hit_path = cut(hit, "hit")
    few = F.broadcast if hit.count() <= BROADCAST_IDS else (lambda df: df)
    full = shaped(known.join(few(hit), "doc_id", "left_semi").select("*", F.xxhash64("text").alias("th")), "doc_id", "th")
    full = full.select("doc_id", "th", "t", "p", F.explode(windows(lambda i, h, n: F.struct(i.alias("i"), h.alias("h"), n.alias("n")))).alias("w"))
    full = full.select("doc_id", "th", F.col("w.i").alias("i"), F.col("w.h").alias("h"), F.slice("t", F.col("w.i") + 1, F.col("w.n")).alias("dv"), F.slice("p", F.col("w.i") + 1, F.col("w.n")).alias("pv"))
    met = full.join(small(index), "h").withColumn("diagonal", F.col("i") - F.col("j"))
    slots = F.filter(F.arrays_zip("pv", "iv", "dv"), lambda x: x["pv"].startswith("§"))
    met = met.select("doc_id", "th", "item_id", "ih", "diagonal", "i", "h", (F.size("iv") == W).alias("whole"), (F.col("iv") == F.col("dv")).alias("same"), F.transform(slots, lambda x: F.struct(F.concat(x["pv"], x["iv"]).alias("of"), x["dv"].alias("is"))).alias("slots"))
    met, met_path = cut(met, "met")
    runs = met.groupBy("doc_id", "item_id", "diagonal").agg(F.collect_set("h").alias("hs"), F.array_distinct(F.flatten(F.collect_set("slots"))).alias("slots"))
    consistent = F.size("slots") == F.size(F.array_distinct(F.transform("slots", lambda x: x["of"])))
    changed = F.exists("slots", lambda x: F.substr(x["of"], F.lit(3)) != x["is"])
    whole = met.where("whole")
    long = _long_runs(whole).unionByName(_long_runs(whole.where("same")))
    found = runs.select("doc_id", "item_id", "hs", "slots", F.lit(False).alias("long")).unionByName(long.withColumn("long", F.lit(True))).where(consistent)
    found = found.select("doc_id", "item_id", "hs", "long", changed.alias("changed")).groupBy("doc_id", "item_id").agg(F.size(F.array_distinct(F.flatten(F.collect_list("hs")))).alias("windows"), F.max("long").alias("long"), F.max("changed").alias("reparameterised"))
    share = F.col("windows") / F.col("item_windows")
    found = found.join(totals, "item_id").where((share >= least) | F.col("long")).select("doc_id", "item_id", F.col("windows").cast("long").alias("windows"), "item_windows", F.round(share, 6).alias("coverage"), "reparameterised")
    out, _ = cut(found, "leaks")
    drop(docs.sparkSession, hit_path, met_path)
    return out
