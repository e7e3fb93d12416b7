"""Document fingerprints by SpotSigs, with DataFrame operations only.

A spot is an anchor that stands right before content words; its signature is the anchor and the chain of
the next `CHAIN` content words, common words between them left out (fewer where the text ends). Anchors are common words (of
English, French, German and Spanish, below), the text's start and, since lists and tables have hardly any common words, one in about
`DRAWN` of the other words, drawn by their letters. Of several anchors in a row the last counts. A fingerprint
is the set of a text's signatures. Words are runs of letters and digits in lower case. Texts of all lengths follow this one rule.

Sets are compared by Jaccard likeness, pruned by length: two sets of m <= n signatures can't be more
alike than m / n, so a length class only meets itself and its neighbours (`length_class`), and
`likeness` with a threshold answers 0 without an intersection where lengths rule the pair out.

Edits need each document's next one in descending order of ids. Documents are dealt out by ranges of
ids (quantiles of the ids alone) and sorted in them; the first row of each range is copied to the
end of the range above it, so one shuffle of the texts is enough, and no range depends on the hottest source or text.

Defined results: null text is the empty text, whose fingerprint is empty; two empty sets are alike
(1), an empty and another are not (0). A text of common words only has one signature, of all its words;
a text without words has one of itself. Equal ids are ordered by text, null ids come last. Repeated
rows are documents of their own. A single document is its own next. Extra columns are not looked at.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larkspur.llm.common import let, table, written

CHAIN = 2
DRAWN = 12
#: Likeness from which two texts count as near duplicates.
NEAR = 0.8
# Common words of four languages, which serve as anchors.
COMMON = sorted(
    set(
        "a an and are as at be been but by can do for from had has have he her his i if in is it its my no not of on or our she so that the their them then there they this to was we were what when which who will with would you your "
        "au aux avec ce ces cette dans de des du elle en est et eux il ils je la le les leur lui mais ne nous on ou où par pas plus pour qu que qui sa se ses son sur un une vous à "
        "als am an auch auf aus bei bin bis das dass dem den der die du ein eine einem einen einer er es für hat ich im in ist man mit nach nicht noch nur oder sich sie sind so über um und uns von vor war wie wir zu zum zur "
        "al como con de del el ella en era es esta este fue ha la las lo los más me mi muy no o para pero por que se si sin son su sus también un una y ya".split()
    )
)


def _drawn(word: Column) -> Column:
    return (F.ascii(word) + 7 * F.length(word)) % DRAWN == 0


def signatures(text: Column) -> Column:
    """Sorted distinct signatures of a text, 16 hex digits each."""
    digest = lambda s: F.substring(F.md5(s), 1, 16)
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")

    def of_words(w):
        # places of the content words
        places = F.filter(F.transform(w, lambda x, i: F.when(x.isin(COMMON), F.lit(-1)).otherwise(i)), lambda i: i >= 0)
        return let(places, lambda p: spots(w, p))

    def spots(w, p):
        def spot(i, k):
            led = (k == 0) | (F.get(p, k - 1) < i - 1) | _drawn(F.get(w, i - 1))
            # words that aren't there are left out
            return F.when(led, digest(F.concat_ws(" ", F.when(i > 0, F.get(w, i - 1)).otherwise(""), F.get(w, i), *[F.get(w, F.get(p, k + n)) for n in range(1, CHAIN)])))

        found = F.array_sort(F.array_distinct(F.filter(F.transform(p, spot), lambda s: s.isNotNull())))
        whole = F.when(F.size(w) > 0, F.array(digest(F.array_join(w, " "))))
        return F.when(F.size(p) > 0, found).otherwise(whole)

    bare = F.when(F.coalesce(text, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.array(digest(text)))
    return F.coalesce(let(words, of_words), bare)


def length_class(size: Column, least: float) -> Column:
    """Classes of set sizes such that sets of likeness `least` or more are in the same or in neighbouring classes."""
    return F.floor(F.log(F.greatest(size, F.lit(1)).cast("double")) / F.lit(-math.log(least))).cast("int")


def apart(a: Column, b: Column, least: float) -> Column:
    """Whether the sizes of two sets alone keep their likeness under `least`."""
    m, n = F.size(a), F.size(b)
    return (F.abs(length_class(m, least) - length_class(n, least)) > 1) | (F.least(m, n) < F.greatest(m, n) * F.lit(least - 1e-9))


def likeness(a: Column, b: Column, least: float = 0.0) -> Column:
    """Jaccard likeness of two signature sets, or 0 if their sizes alone keep it under `least`."""
    m, n = F.size(a), F.size(b)
    common = F.size(F.array_intersect(a, b))
    far = apart(a, b, least) if least > 0 else F.lit(False)
    return F.when((m == 0) & (n == 0), F.lit(1.0)).when(far | (F.least(m, n) == 0), F.lit(0.0)).otherwise(common / (m + n - common))


def near_pairs(docs: DataFrame, least: float = NEAR, hot_rows: int = 5_000) -> DataFrame:
    """(a, b, likeness): every two different signature sets of likeness `least` or more, by the least doc_id of the texts that have them (null if none has an id).

    Equal sets are folded first; `doc_id`s of a set are its class (see `classes`). Candidates share one of the rarest
    signatures of both sets and neighbouring length classes: sets of n and m signatures that are alike share
    one of the first n - ceil(least * n) + 1 of them in any fixed order, and in the order of rarity frequent ones are hardly ever first."""
    sets = docs.select("doc_id", signatures(F.col("text")).alias("s")).filter(F.size("s") > 0)
    reps = written(sets.groupBy("s").agg(F.min("doc_id").alias("first")).select("first", "s", F.size("s").alias("n"), F.md5(F.array_join("s", " ")).alias("key")), "spot-sets")
    spots = reps.select("key", "n", F.explode("s").alias("x"))
    rare = spots.join(spots.groupBy("x").agg(F.count("*").alias("df")), "x").groupBy("key", "n").agg(F.array_sort(F.collect_list(F.struct("df", "x"))).alias("o"))
    prefix = rare.select("key", "n", F.explode(F.slice("o", F.lit(1), (F.col("n") - F.ceil(F.col("n") * least - 1e-9) + 1).cast("int"))).alias("p"))
    prefix = written(prefix.select("key", "n", F.col("p.x").alias("x"), length_class(F.col("n"), least).alias("c")), "spot-prefixes")
    cells = prefix.groupBy("x", "c").agg(F.ceil(F.count("*") / F.lit(max(1, hot_rows // 10))).cast("int").alias("cells"), F.count("*").alias("rows")).filter(F.col("rows") > hot_rows).drop("rows")
    cells = written(cells, "hot-spots")
    # the smaller set of a pair is in the larger one's class or the one below
    small = prefix.select(F.col("key").alias("k1"), F.col("n").alias("n1"), "x", F.explode(F.array(F.col("c"), F.col("c") + 1)).alias("c"))
    small = small.join(cells, ["x", "c"], "left").withColumn("cell", F.coalesce(F.pmod(F.xxhash64("k1"), F.col("cells")).cast("int"), F.lit(0)))
    large = prefix.select(F.col("key").alias("k2"), F.col("n").alias("n2"), "x", "c").join(cells, ["x", "c"], "left")
    large = large.withColumn("cell", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("cells"), F.lit(1)) - 1)))
    found = small.drop("cells").join(large.drop("cells"), ["x", "c", "cell"]).filter(((F.col("n1") < F.col("n2")) | (F.col("n1") == F.col("n2")) & (F.col("k1") < F.col("k2"))) & (F.col("n1") >= F.col("n2") * least - 1e-9))
    pairs = found.select("k1", "k2").distinct()
    side = lambda k, name: reps.select(F.col("key").alias(k), F.col("first").alias(name), F.col("s").alias(f"s_{k}"))
    whole = pairs.join(side("k1", "p"), "k1").join(side("k2", "q"), "k2").withColumn("likeness", likeness(F.col("s_k1"), F.col("s_k2"), least))
    return whole.filter(F.col("likeness") >= least).select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b"), "likeness")


def classes(docs: DataFrame) -> DataFrame:
    """(doc_id, class_id): the least doc_id among the texts with the same signature set."""
    keyed = docs.select("doc_id", F.md5(F.array_join(signatures(F.col("text")), " ")).alias("key"))
    return keyed.join(keyed.groupBy("key").agg(F.min("doc_id").alias("class_id")), "key").select("doc_id", "class_id")


def _longs(values: list) -> Column:
    return F.expr("array(" + ", ".join("CAST(NULL AS BIGINT)" if v is None else f"{v}L" for v in values) + ")").cast("array<bigint>")


def _place(edges: list[int], step: int = 100) -> Column:
    """How many edges are above doc_id, found among every step-th edge first: a search of two short lists."""
    if not edges:
        return F.lit(0)
    above = lambda es: F.size(F.filter(es, lambda e: e > F.col("doc_id")))
    coarse = (F.lit(len(edges[step - 1 :: step])) - above(_longs(edges[step - 1 :: step]))) * step
    below = coarse + F.size(F.filter(F.slice(_longs(edges), coarse + 1, F.lit(step)), lambda e: e <= F.col("doc_id")))
    return F.when(F.col("doc_id").isNull(), F.lit(len(edges))).otherwise(F.lit(len(edges)) - below).cast("int")


def with_next(docs: DataFrame, range_rows: int = 2_000, most_ranges: int = 10_000, carry: dict[str, Column] | None = None) -> DataFrame:
    """(doc_id, text, next_text): each row with the text of the row after it in descending order of ids, the first's after the last.

    carry: columns made of `text` once a row, after the shuffle; they and the next row's (next_<name>) are returned too. At most `most_ranges` edges come to the driver; beyond range_rows * most_ranges rows the ranges grow, and their sorts spill."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    ids = docs.select("doc_id")
    n = ids.count()
    ranges = max(1, min(most_ranges, -(-n // range_rows)))
    marks = F.expr("array(" + ", ".join(f"{k / ranges:.9f}D" for k in range(1, ranges)) + ")") if ranges > 1 else None
    edges = ids.select(F.percentile_approx("doc_id", marks, F.lit(20 * most_ranges)).alias("e")).first()["e"] if ranges > 1 else []
    # range 0 has the greatest ids; null ids are in the last
    place = _place(edges := sorted(set(edges or [])))
    tops = {r["r"]: r["top"] for r in ids.select(place.alias("r"), "doc_id").groupBy("r").agg(F.max("doc_id").alias("top")).collect()}
    full = sorted(tops)
    # the first row of a range is also the row after the last of the range above; the very first comes after the very last
    after = {r: full[k - 1] for k, r in enumerate(full)}
    own = [tops.get(r) for r in range(len(edges) + 1)]
    to = [after.get(r) for r in range(len(edges) + 1)]
    placed = rows.withColumn("r", place)
    first = F.col("doc_id").eqNullSafe(F.get(_longs(own), F.col("r"))) if full else F.lit(False)
    cell = lambda r, halo: F.struct(r.cast("int").alias("r"), F.lit(halo).alias("halo"))
    cells = F.when(first, F.array(cell(F.col("r"), 0), cell(F.get(_longs(to), F.col("r")), 1))).otherwise(F.array(cell(F.col("r"), 0)))
    dealt = placed.select("doc_id", "text", F.explode(cells).alias("h")).select("doc_id", "text", "h.r", "h.halo")
    order = Window.partitionBy("r").orderBy("halo", F.col("doc_id").desc_nulls_last(), "text")
    names = ["text", *(carry or {})]
    made = dealt.repartition("r").withColumns(carry) if carry else dealt
    return made.withColumns({f"next_{c}": F.lead(c).over(order) for c in names}).filter("halo = 0").select("doc_id", *names, *[f"next_{c}" for c in names])


def edited(text: Column, next_text: Column) -> Column:
    """The last third of a text's code points replaced by the first as many (or all) of the next text."""
    k = F.floor(F.length(text) / 3).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - k), F.substring(next_text, F.lit(1), k))


def fingerprint(sigs: Column) -> Column:
    return F.array_join(sigs, " ")


def op6_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = with_next(table(spark, sf_dir, "documents"), carry={"own": signatures(F.col("text"))})
    changed = pairs.select("doc_id", F.length("text").cast("long").alias("n_chars"), "own", "next_own", edited(F.col("text"), F.col("next_text")).alias("changed"))
    sets = changed.select("doc_id", "n_chars", F.sha2("changed", 256).alias("edited_sha256"), "own", "next_own", signatures(F.col("changed")).alias("edit"))
    near = sets.withColumns({"near_edited": likeness(F.col("own"), F.col("edit")), "near_next": likeness(F.col("own"), F.col("next_own"))})
    return near.select(
        "doc_id", "n_chars", "edited_sha256", fingerprint(F.col("own")).alias("fingerprint"), fingerprint(F.col("edit")).alias("edited_fingerprint"), "near_edited", "near_next",
        (~apart(F.col("own"), F.col("edit"), NEAR) & (F.col("near_edited") >= NEAR)).alias("edited_is_near"), (~apart(F.col("own"), F.col("next_own"), NEAR) & (F.col("near_next") >= NEAR)).alias("next_is_near"),
    )


_IN = "(" + ", ".join(f"'{w}'" for w in COMMON) + ")"
_SIGS = f"""
  CASE WHEN {{t}} = '' THEN CAST([] AS VARCHAR[])
       WHEN len({{w}}) = 0 THEN [substr(md5({{t}}), 1, 16)]
       WHEN len({{p}}) = 0 THEN [substr(md5(array_to_string({{w}}, ' ')), 1, 16)]
       ELSE list_sort({{s}}) END"""


def _oracle() -> str:
    one = lambda c: [
        f"list_filter(regexp_split_to_array(lower({c}), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '') AS {c}_w",
        f"list_filter(list_transform(range(1, len({c}_w) + 1), lambda i: CASE WHEN {c}_w[i] IN {_IN} THEN -1 ELSE i END), lambda i: i > 0) AS {c}_p",
        f"list_distinct(list_filter(list_transform(range(1, len({c}_p) + 1), lambda k: CASE WHEN k = 1 OR {c}_p[k - 1] < {c}_p[k] - 1 OR (ascii({c}_w[{c}_p[k] - 1]) + 7 * length({c}_w[{c}_p[k] - 1])) % {DRAWN} = 0 THEN substr(md5(concat_ws(' ', CASE WHEN {c}_p[k] > 1 THEN {c}_w[{c}_p[k] - 1] ELSE '' END, " + ", ".join(f"{c}_w[{c}_p[k + {n}]]" for n in range(CHAIN)) + f")), 1, 16) END), lambda s: s IS NOT NULL)) AS {c}_s",
        _SIGS.format(t=c, w=f"{c}_w", p=f"{c}_p", s=f"{c}_s") + f" AS {c}_sig",
    ]
    levels = list(zip(one("own"), one("edit"), one("nxt"), strict=True))
    ctes = ", ".join(f"l{k + 1} AS (SELECT *, {', '.join(level)} FROM l{k})" for k, level in enumerate(levels))
    near = lambda a, b: f"CASE WHEN len({a}) = 0 AND len({b}) = 0 THEN 1.0::DOUBLE ELSE len(list_intersect({a}, {b}))::DOUBLE / (len({a}) + len({b}) - len(list_intersect({a}, {b}))) END"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS own FROM documents),
n AS (SELECT *, coalesce(lead(own) OVER o, first_value(own) OVER o) AS nxt FROM d WINDOW o AS (ORDER BY doc_id DESC NULLS LAST, own ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
l0 AS (SELECT *, substr(own, 1, length(own) - length(own) // 3) || substr(nxt, 1, length(own) // 3) AS edit FROM n),
{ctes}
SELECT doc_id, length(own) AS n_chars, sha256(edit) AS edited_sha256, array_to_string(own_sig, ' ') AS fingerprint, array_to_string(edit_sig, ' ') AS edited_fingerprint,
  {near('own_sig', 'edit_sig')} AS near_edited, {near('own_sig', 'nxt_sig')} AS near_next,
  near_edited >= {NEAR} AS edited_is_near, near_next >= {NEAR} AS next_is_near
FROM l4
"""


OP6_SQL = _oracle()
