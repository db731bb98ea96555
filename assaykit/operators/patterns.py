"""Patterns of a text column: structures, length patterns, folded constants, edge merges, heads and tails, validation.

Everything is computed on the distinct values and their counts, by aggregations keyed on structure
and lengths, so no column's values come together in one task. Null and empty values are no members.
Values over MAX_CHARS characters or MAX_TOKENS tokens are left out of patterns and counted by ``validate``.
"""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MAX_CHARS, MAX_TOKENS = 64, 32
#: A structure counts with two distinct values, or this share of the distinct values or occurrences.
MATERIAL = 0.05
MAX_FOLD, MERGE_WIDTH, MAX_HEAD = 3, 2, 3
#: Bits that naming a branch costs, and the least share of the bits read that a facet must save.
KAPPA, LEAST_SAVED = 2.0, 0.1
#: Normal quantile of one in a million.
CHANCE = 4.753424308822899
#: A token: digits, a letter run with a non-ASCII letter, capitals, small letters, or one other character repeated.
TOKEN = r"(?s)([0-9]+|[A-Za-z]*[\p{L}&&[^\x00-\x7F]]\p{L}*|[A-Z]+|[a-z]+|(.)\2*)"


def code(token: Column) -> Column:
    """D digits, U capitals, L small letters, X other letters, P and the character for the rest."""
    return (
        F.when(token.rlike("^[0-9]"), "D").when(token.rlike("^[A-Z]+$"), "U").when(token.rlike("^[a-z]+$"), "L").when(token.rlike(r"^\p{L}"), "X")
        .otherwise(F.concat(F.lit("P"), F.substring(token, 1, 1)))
    )


def tokenized(df: DataFrame, column: str) -> DataFrame:
    """value, cnt, state (ok, too_long, too_complex), tokens, structure, lens of every distinct value that is not empty."""
    counts = df.where(F.length(column) > 0).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("cnt"))
    long = F.length("value") > MAX_CHARS
    out = counts.withColumn("tokens", F.when(~long, F.regexp_extract_all("value", F.lit(TOKEN), F.lit(1))))
    out = out.withColumn("state", F.when(long, "too_long").when(F.size("tokens") > MAX_TOKENS, "too_complex").otherwise("ok"))
    ok = F.col("state") == "ok"
    return out.withColumn("structure", F.when(ok, F.array_join(F.transform("tokens", code), ""))).withColumn("lens", F.when(ok, F.transform("tokens", F.length)))


def scored(groups: DataFrame) -> DataFrame:
    """Add score: the larger share of distinct values and of occurrences, to nine places."""
    total = groups.agg(F.sum("distinct_values").alias("_d"), F.sum("occurrences").alias("_o"))
    score = F.round(F.greatest(F.col("distinct_values") / F.col("_d"), F.col("occurrences") / F.col("_o")), 9)
    return groups.join(F.broadcast(total)).withColumn("score", score).drop("_d", "_o")


def structures(df: DataFrame, column: str) -> DataFrame:
    """structure, distinct_values, occurrences, score, material."""
    groups = tokenized(df, column).where("state = 'ok'").groupBy("structure").agg(F.count("*").alias("distinct_values"), F.sum("cnt").alias("occurrences"))
    return scored(groups).withColumn("material", (F.col("distinct_values") >= 2) | (F.col("score") >= MATERIAL))


def shared_start(a: Column, b: Column) -> Column:
    """Characters that two texts, and so all texts that sort between them, have in common at the start."""
    places = F.sequence(F.lit(1), F.greatest(F.length(a), F.lit(1)))
    return F.aggregate(places, F.lit(0), lambda best, i: F.when(F.substring(a, F.lit(1), i) == F.substring(b, F.lit(1), i), i).otherwise(best))


def patterns(df: DataFrame, column: str) -> DataFrame:
    """structure, lens, folds, signature, distinct_values, occurrences, score: one row per vector of token lengths.

    ``folds`` has what all values share at the start of each token: a whole token or up to three
    characters, and nothing where a pattern has one value, which it would give away.
    """
    ok = tokenized(df, column).where("state = 'ok'")
    places = ok.select("structure", "lens", "cnt", F.posexplode("tokens").alias("place", "token"))
    per = places.groupBy("structure", "lens", "place").agg(F.count("*").alias("d"), F.sum("cnt").alias("o"), F.min("token").alias("lo"), F.max("token").alias("hi"))
    shared = shared_start(F.col("lo"), F.col("hi"))
    kind = code(F.col("lo"))
    fold = F.when(kind.startswith("P"), F.col("lo")).when(F.col("d") < 2, "").when(shared == F.length("lo"), F.col("lo")).otherwise(F.substring(F.col("lo"), F.lit(1), F.least(shared, F.lit(MAX_FOLD))))
    part = F.struct("place", fold.alias("fold"), kind.alias("kind"), F.length("lo").alias("width"))
    rows = per.groupBy("structure", "lens").agg(F.array_sort(F.collect_list(part)).alias("parts"), F.max("d").alias("distinct_values"), F.max("o").alias("occurrences"))
    return scored(rows.select("structure", "lens", F.transform("parts", lambda p: p["fold"]).alias("folds"), signature(F.col("parts")).alias("signature"), "distinct_values", "occurrences"))


def signature(parts: Column) -> Column:
    """9 a digit, A a capital, a a small letter, @ any letter; counted beyond six; constants in quotes if they hold letters, digits, spaces or marks of the notation."""

    def step(state: Column, p: Column) -> Column:
        free = p["width"] - F.length(p["fold"])
        symbol = F.when(p["kind"] == "D", "9").when(p["kind"] == "U", "A").when(p["kind"] == "L", "a").otherwise("@")
        text = F.when(free <= 0, "").when(free <= 6, F.repeat(symbol, free)).otherwise(F.concat(symbol, F.lit("{"), free.cast("string"), F.lit("}")))
        run = F.concat(state["run"], p["fold"])
        ends = free > 0
        return F.struct(F.when(ends, F.concat(state["out"], quoted(run), text)).otherwise(state["out"]).alias("out"), F.when(ends, "").otherwise(run).alias("run"))

    start = F.struct(F.lit("").alias("out"), F.lit("").alias("run"))
    return F.aggregate(parts, start, step, lambda s: F.concat(s["out"], quoted(s["run"])))


def quoted(run: Column) -> Column:
    return F.when(run.rlike(r"[\p{L}0-9\s'{}@#?]") & (run != " "), F.concat(F.lit("'"), F.replace(run, F.lit("'"), F.lit("''")), F.lit("'"))).otherwise(run)


def edges(form: Column, width: int) -> Column:
    """place, width, rest, kind of the edges of blocks whose characters are of one class; rest has the edge left out."""
    at = lambda i, n: F.substring(form, i, n)
    inner = lambda c: c.rlike("^[9Aa]$")

    def fits(i: Column) -> Column:
        before = F.when(i > 1, at(i - 1, F.lit(1))).otherwise("")
        return at(i, F.lit(width)).isin("9" * width, "A" * width, "a" * width) & (inner(before) != inner(at(i + width, F.lit(1))))

    def key(i: Column) -> Column:
        rest = F.concat(at(F.lit(1), i - 1), F.lit("\x00" * width), at(i + width, F.lit(MAX_CHARS)))
        return F.struct(i.alias("place"), F.lit(width).alias("width"), rest.alias("rest"), at(i, F.lit(1)).alias("kind"))

    places = F.filter(F.sequence(F.lit(1), F.greatest(F.length(form) - width + 1, F.lit(1))), lambda i: i + width - 1 <= F.length(form))
    return F.transform(F.filter(places, fits), key)


def edge_merges(df: DataFrame, column: str) -> DataFrame:
    """form, into, merged: forms of one character class for each position that differ from a more
    frequent one only in one or two characters at one edge of a block of letters and digits.

    Found by an equi-join on the form with the edge left out; of several larger forms the most
    frequent one, then the first in order, is taken. ``merged`` shows the class of both: X a capital
    or digit, x a small letter or digit, @ a letter.
    """
    form = F.regexp_replace(F.regexp_replace(F.regexp_replace("value", "[0-9]", "9"), "[A-Z]", "A"), "[a-z]", "a")
    forms = tokenized(df, column).where("state = 'ok'").groupBy(form.alias("form")).agg(F.count("*").alias("d"), F.sum("cnt").alias("o")).where("d >= 2")
    keys = [edges(F.col("form"), width) for width in range(1, MERGE_WIDTH + 1)]
    near = forms.select("form", "d", "o", F.explode(F.concat(*keys)).alias("k")).select("form", "d", "o", "k.*")
    # one form of each class for a key: the join gives at most three rows a key
    large = near.select("place", "width", "rest", F.col("kind").alias("kind2"), F.col("form").alias("into"), F.col("d").alias("d2"), F.col("o").alias("o2"))
    pairs = near.join(large, ["place", "width", "rest"]).where((F.col("kind") != F.col("kind2")) & ((F.col("d2") > F.col("d")) | ((F.col("d2") == F.col("d")) & (F.col("into") < F.col("form")))))
    both = F.array_join(F.array_sort(F.array("kind", "kind2")), "")
    symbol = F.when(both == "9A", "X").when(both == "9a", "x").otherwise("@")
    merged = F.concat(F.expr("substring(form, 1, place - 1)"), F.repeat(symbol, F.col("width")), F.expr("substring(form, place + width)"))
    best = F.row_number().over(Window.partitionBy("form").orderBy(F.desc("d2"), F.desc("o2"), "into", "width", "place"))
    return pairs.withColumn("merged", merged).withColumn("_best", best).where("_best = 1").select("form", "into", "merged", F.col("d").alias("distinct_values"), F.col("o").alias("occurrences"))


def heads(df: DataFrame, column: str) -> DataFrame:
    """structure, lens, place, head, distinct_values, occurrences, gain: starts of tokens that save bits
    and whose next character is not chance (G-test); longer kept heads replace shorter ones, and a
    token is listed if its heads save a tenth of the bits they read."""
    return facets(df, column, "head")


def tails(df: DataFrame, column: str) -> DataFrame:
    """As ``heads`` with the ends of tokens: structure, lens, place, tail, distinct_values, occurrences, gain."""
    return facets(df, column, "tail").withColumn("head", F.reverse("head")).withColumnRenamed("head", "tail")


def facets(df: DataFrame, column: str, side: str) -> DataFrame:
    """``heads`` of the tokens, or of the tokens read backwards."""
    ok = tokenized(df, column).where("state = 'ok'")
    tokens = ok.select("structure", "lens", "cnt", F.posexplode("tokens").alias("place", "token")).where(F.col("token").rlike("^([0-9]+|[A-Z]+|[a-z]+)$"))
    group = ["structure", "lens", "place"]
    tokens = tokens.withColumn("token", F.reverse("token")) if side == "tail" else tokens
    starts = F.sequence(F.lit(0), F.least(F.length("token"), F.lit(MAX_HEAD)))
    symbols = F.when(F.col("token").rlike("^[0-9]"), 10).otherwise(26)
    by = tokens.select(*group, "cnt", symbols.alias("symbols"), F.explode(F.transform(starts, lambda n: F.substring(F.col("token"), F.lit(1), n))).alias("head"))
    counts = by.groupBy(*group, "symbols", "head").agg(F.count("*").alias("d"), F.sum("cnt").alias("o"), F.max("cnt").alias("most"))
    total = counts.where("head = ''").select(*group, F.col("d").alias("all_d"), F.col("o").alias("all_o"), (F.col("most") > 0.9 * F.col("o")).alias("one_value"))
    part = counts.where("head <> ''").withColumn("parent", F.expr("left(head, length(head) - 1)"))

    def normal(weight: str) -> Column:
        x = F.col(weight).cast("double")
        statistic = 2 * (F.sum(x * F.log(x)) - F.sum(x) * F.log(F.sum(x) / F.first("symbols")))
        free = F.first("symbols") - 1
        scale = 2 / (9 * free)
        return (F.pow(F.greatest(statistic, F.lit(0.0)) / free, 1 / 3) - (1 - scale)) / F.sqrt(scale)

    test = part.groupBy(*group, "parent").agg(normal("d").alias("z_d"), normal("o").alias("z_o"))
    bits = F.log2("symbols") * F.length("head")
    gain = lambda x, n: F.col(x) * (bits + F.log2(F.col(x) / F.col(n))) - (bits + KAPPA)
    kept = part.join(test, [*group, "parent"]).join(total, group).withColumn("gain_d", gain("d", "all_d")).withColumn("gain_o", gain("o", "all_o"))
    kept = kept.where(((F.col("z_d") > CHANCE) & (F.col("gain_d") > 0)) | (~F.col("one_value") & (F.col("z_o") > CHANCE) & (F.col("gain_o") > 0)))
    inner = kept.select(*group, F.explode(F.transform(F.sequence(F.lit(1), F.length("head")), lambda n: F.when(n < F.length("head"), F.substring(F.col("head"), F.lit(1), n)))).alias("head")).where("head is not null").distinct()
    leaves = kept.join(inner, [*group, "head"], "left_anti")
    plus = lambda c: F.sum(F.greatest(F.col(c), F.lit(0.0)))
    read = F.max(F.length("head")) * F.first(F.log2("symbols"))
    told = leaves.groupBy(*group).agg(F.greatest(plus("gain_d") / (F.first("all_d") * read), plus("gain_o") / (F.first("all_o") * read)).alias("saved")).where(F.col("saved") >= LEAST_SAVED)
    return leaves.join(told.select(*group), group, "left_semi").select(*group, "head", F.col("d").alias("distinct_values"), F.col("o").alias("occurrences"), F.round(F.greatest("gain_d", "gain_o"), 6).alias("gain"))


def validate(df: DataFrame, column: str, learned: DataFrame) -> DataFrame:
    """outcome, distinct_values, occurrences of all values against the patterns of ``patterns``.

    known, new_segment (a constant differs), new_length, unknown_structure, too_long or too_complex.
    """
    read = tokenized(df, column)
    exact = learned.select("structure", "lens", "folds")
    known = learned.select("structure").distinct().withColumn("_known", F.lit(True))
    both = read.join(exact, ["structure", "lens"], "left").join(known, "structure", "left")
    holds = F.forall(F.zip_with("tokens", "folds", lambda t, f: t.startswith(f)), lambda x: x)
    outcome = F.when(F.col("state") != "ok", F.col("state")).when(F.col("_known").isNull(), "unknown_structure").when(F.col("folds").isNull(), "new_length").when(holds, "known").otherwise("new_segment")
    return both.groupBy(outcome.alias("outcome")).agg(F.count("*").alias("distinct_values"), F.sum("cnt").alias("occurrences"))


def eligibility(df: DataFrame, column: str, top: int = 6, least: float = 0.9) -> DataFrame:
    """distinct_values, top_share, eligible: whether the most frequent length patterns cover the column."""
    sizes = tokenized(df, column).groupBy("structure", "lens").agg(F.count("*").alias("d"))
    first = sizes.where("structure is not null").orderBy(F.desc("d"), "structure").limit(top).agg(F.sum("d").alias("top"))
    out = sizes.agg(F.coalesce(F.sum("d"), F.lit(0)).cast("long").alias("distinct_values")).join(F.broadcast(first))
    share = F.coalesce(F.col("top") / F.nullif(F.col("distinct_values"), F.lit(0)), F.lit(0.0))
    return out.select("distinct_values", F.round(share, 6).alias("top_share"), (share >= least).alias("eligible"))


#: Most families of a field, patterns of a family and patterns of a field.
FAMILIES, OF_FAMILY, OF_FIELD = 16, 32, 128


def within_budget(learned: DataFrame, families: int = FAMILIES, of_family: int = OF_FAMILY, of_field: int = OF_FIELD) -> DataFrame:
    """Patterns of ``patterns`` with ``kept``: the largest families, in each its largest patterns, and the largest of all these.

    Order is by distinct values, then occurrences, then name. There is a row for each pattern of a field.
    """
    of = learned.groupBy("structure").agg(F.sum("distinct_values").alias("_d"), F.sum("occurrences").alias("_o"))
    biggest = of.withColumn("_f", F.row_number().over(Window.orderBy(F.desc("_d"), F.desc("_o"), "structure"))).where(F.col("_f") <= families)
    out = learned.join(biggest.select("structure", "_f"), "structure", "left")
    size = [F.desc("distinct_values"), F.desc("occurrences"), "signature"]
    out = out.withColumn("_p", F.when(F.col("_f").isNotNull(), F.row_number().over(Window.partitionBy("structure").orderBy(*size))))
    fits = F.col("_p") <= of_family
    return out.withColumn("_all", F.row_number().over(Window.orderBy(F.when(fits, 0).otherwise(1), *size, "structure"))).withColumn("kept", F.coalesce(fits, F.lit(False)) & (F.col("_all") <= of_field)).drop("_f", "_p", "_all")


def facet_tree(df: DataFrame, column: str, depth: int = 3, single: float = 0.95, least: int = 2) -> DataFrame:
    """structure, lens, path, level, distinct_values: starts of the first letter or digit tokens that tell values apart, as a tree.

    Each level fixes the start (up to MAX_HEAD characters, as long as all values of the node share it) of one more token. A
    child that holds ``single`` of its parent is merged with it; nodes of fewer than ``least`` values are left out.
    Every level is one aggregation over all nodes.
    """
    ok = tokenized(df, column).where("state = 'ok'").withColumn("words", F.filter("tokens", lambda t: t.rlike("^([0-9]+|[A-Za-z]+)$")))
    # a node's key at each level: the first character of each of the first tokens
    keys = [F.transform(F.slice("words", 1, n + 1), lambda t: F.substring(t, F.lit(1), F.lit(1))) for n in range(depth)]
    long = ok.select("structure", "lens", "words", F.explode(F.array(*[F.struct(F.lit(n + 1).alias("level"), F.when(F.size("words") > n, k).alias("key")) for n, k in enumerate(keys)])).alias("x")).where("x.key is not null")
    node = long.groupBy("structure", "lens", "x.level", "x.key").agg(F.count("*").alias("distinct_values"), F.min(F.get("words", F.col("x.level") - 1)).alias("lo"), F.max(F.get("words", F.col("x.level") - 1)).alias("hi"))
    start = F.substring(F.col("lo"), F.lit(1), F.least(shared_start(F.col("lo"), F.col("hi")), F.lit(MAX_HEAD)))
    node = node.where(F.col("distinct_values") >= least).withColumn("start", start)
    up = node.select(F.col("structure").alias("s"), F.col("lens").alias("l"), (F.col("level") + 1).alias("v"), F.col("key").alias("up"), F.col("distinct_values").alias("above"))
    parent = F.when(F.col("level") > 1, F.slice("key", F.lit(1), F.col("level") - 1))
    tree = node.withColumn("_up", parent).join(up, (F.col("structure") == F.col("s")) & (F.col("lens") == F.col("l")) & (F.col("level") == F.col("v")) & (F.col("_up") == F.col("up")), "left")
    apart = F.col("above").isNull() | (F.col("distinct_values") < single * F.col("above"))
    return tree.where(apart).select("structure", "lens", F.array_join("key", "/").alias("path"), "level", "start", "distinct_values")
