"""Search for nodes that may be one: pairs of similar terms, found without comparing all."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmesh.functions.text import comparison_key, difflib_ratio
from quillmesh.operators.evidence import large, small, terms
from quillmesh.operators.organise import exact_candidates, neighbour_jaccard, neighbour_signatures
from quillmesh.plans.components import durable

#: How terms, summaries and neighbours share in a merge score.
NAME_SHARE, SUMMARY_SHARE, NEIGHBOUR_SHARE = 0.65, 0.2, 0.15
#: Fixed value: signs of a summary that are compared.
SUMMARY_SIGNS = 800
#: Bars that the search tries before the least score; any values give the same result.
BARS = (0.97, 0.94, 0.91, 0.88)
#: Names with more ways than this to lose the signs they may lose are searched by grams.
WAYS = 1200
#: Names that one task joins on a gram.
GRAM_BLOCK = 1000
#: Pairs of names that the first look scores, per pair asked for, nodes it takes of a name, and signs of the
#: names it takes; any values give the same result.
LOOK_PAIRS, LOOK_NODES, LOOK_SIGNS = 50, 3, 64
#: Signs that two names lose together up to which names meet only where their losses add up; any value gives the same result.
FEW_LOSSES = 2
#: Pairs of nodes that are looked through first for those that score by terms alone, per pair asked for; any value gives the same result.
FIRST_PAIRS = 4


def _lost(length: Column, need: float) -> Column:
    """Signs a name can lose at most beside a similar one, which is a shorter one then."""
    return F.floor(length * ((2 - 2 * need) / (2 - need)) + 1e-9).cast("int")


def _ways(length: Column, lost: Column) -> Column:
    """In how many ways a name can lose up to so many signs."""
    way = F.lit(1.0)
    for i in range(6):
        way = F.when(lost > i, way * (length - i) / (i + 1) + 1.0).otherwise(way)
    return F.when(lost > 6, float("inf")).otherwise(way)


def similar_names(names: DataFrame, need: float) -> DataFrame:
    """``x, y``: pairs x < y of different names that can have a similarity of ``need``, none left out.

    The parts that two names share are a common subsequence of ``need`` times half their signs, so
    each turns into it by losing a few signs.  All that names can turn into so meet by hash: a pair
    is found where it has such a subsequence, and only there, but for hashes that are equal by
    chance.  Long names could lose signs in too many ways; pairs with one of these are
    searched by grams.  The empty name is similar to none.
    """
    held = names.filter("name != ''").select("name", F.length("name").alias("n")).distinct()
    sized = durable(held.withColumn("ways", _ways(F.col("n"), _lost(F.col("n"), need))))
    short, long = sized.filter(F.col("ways") <= WAYS), sized.filter(F.col("ways") > WAYS)
    found = _by_losses(short, need)
    least = long.agg(F.min("n")).first()[0]
    if least is not None:
        # the shorter one of a pair with a long name
        near = sized.filter(F.col("n") * (2 - need) >= least * need - 1e-9)
        found = found.unionByName(_by_grams(near, need, least))
    return found


def _cut(s: Column) -> Column:
    """A text with one of its signs lost, in all ways."""
    return F.transform(F.sequence(F.lit(1), F.length(s)), lambda i: F.concat(F.substring(s, F.lit(1), i - 1), F.substring(s, i + 1, F.length(s))))


def _nearest_names(names: DataFrame, most: int) -> DataFrame:
    """``x, y``: the ``most`` likeliest pairs among names that turn into each other by losing one sign; where there are fewer, also
    among those that each lose one.  Not all.

    Where one name loses a sign to be the other, names meet whole names only; names of one length can have hundreds of others
    that each lose one.
    """
    sized = names.filter((F.col("name") != "") & (F.length("name") <= LOOK_SIGNS)).select("name", F.length("name").alias("n"))
    lost = sized.filter("n > 1").select("name", "n", F.explode(F.array_distinct(_cut(F.col("name")))).alias("v")).select("name", "n", F.xxhash64("v").alias("h"), F.length("v").alias("kept"))
    whole = sized.select(F.col("name").alias("of"), F.xxhash64("name").alias("h"), F.col("n").alias("kept"))
    pair = (F.least("name", "of").alias("x"), F.greatest("name", "of").alias("y"))
    near = lost.join(large(whole), ["h", "kept"]).select(*pair, (F.col("kept") / (F.col("kept") + F.col("n"))).alias("near")).distinct()
    found = durable(near.orderBy(F.desc("near"), "x", "y").limit(most))
    if found.count() < most:
        other = lost.select("h", "kept", F.col("name").alias("of"))
        alike = lost.join(large(other), ["h", "kept"]).filter("name < of").select(*pair, (F.col("kept") / (2 * F.col("n"))).alias("near"))
        near = found.unionByName(alike).groupBy("x", "y").agg(F.max("near").alias("near"))
        found = near.orderBy(F.desc("near"), "x", "y").limit(most)
    return found.select("x", "y")


def _by_losses(sized: DataFrame, need: float) -> DataFrame:
    """Pairs of names that turn into the same by losing signs.

    What two names with ``kept`` signs in common may lose together is known.  Where that is little, they meet by what each
    of them loses: a whole name meets only those that lose all of it, and names that lose too much never meet.
    """
    most = sized.agg(F.max(_lost(F.col("n"), need))).first()[0] or 0
    level, levels = F.array("name"), []
    rows = sized
    for j in range(most + 1):
        rows = rows.withColumn(f"_{j}", F.when(_lost(F.col("n"), need) >= j, level))
        levels.append(F.transform(f"_{j}", lambda s: F.struct(F.xxhash64(s).alias("h"), F.length(s).alias("kept"))))
        level = F.array_distinct(F.flatten(F.transform(f"_{j}", _cut)))
    some = F.array_distinct(F.flatten(F.array(*[F.coalesce(x, F.expr("cast(array() AS array<struct<h:bigint,kept:int>>)")) for x in levels])))
    made = rows.select("name", "n", F.explode(some).alias("v")).select("name", "n", "v.h", "v.kept", (F.col("n") - F.col("v.kept")).alias("lost")).filter("kept > 0")
    made = made.withColumn("room", F.floor(F.col("kept") * (2 / (need - 1e-9) - 2)).cast("int")).filter("room > 0")
    lost, room, none = F.col("lost"), F.col("room"), F.expr("cast(array() AS array<int>)")
    more = F.when(room > FEW_LOSSES, F.array(F.lit(-1))).when(room >= 2 * lost, F.filter(F.sequence(lost, room - lost), lambda i: i > 0)).otherwise(none)
    less = F.when(room > FEW_LOSSES, F.array(F.lit(-1))).when((lost > 0) & (room >= lost), F.sequence(F.lit(0), F.least(lost, room - lost))).otherwise(none)
    own = lambda other: F.when(F.col(other) < 0, -1).otherwise(lost)
    left = made.select("h", "kept", F.col("name").alias("p"), F.col("n").alias("n_p"), "lost", F.explode(more).alias("high")).withColumn("low", own("high")).drop("lost")
    right = made.select("h", "kept", F.col("name").alias("q"), F.col("n").alias("n_q"), "lost", F.explode(less).alias("low")).withColumn("high", own("low")).drop("lost")
    met = large(left).join(large(right), ["h", "kept", "low", "high"]).filter("low < high AND p != q OR p < q")
    fits = 2.0 * F.col("kept") >= (need - 1e-9) * (F.col("n_p") + F.col("n_q"))
    return met.filter(fits).select(F.least("p", "q").alias("x"), F.greatest("p", "q").alias("y")).distinct()


def gram_width(need: float) -> int:
    return 2 if need > 2 / 3 else 1


def _by_grams(sized: DataFrame, need: float, least: int) -> DataFrame:
    """Pairs one of which has ``least`` signs or more, by their rare grams.

    What two similar names don't share has to be deleted from either, and each sign that goes takes two
    of the name's pairs of neighbouring signs with it, or one single sign where ``need`` is too low for
    pairs.  So of the rarest such grams, one more than can be lost, one is shared.  A gram's places in two
    such names lie no further apart than the signs they lose.  Grams of many names are dealt
    to several tasks.
    """
    width = gram_width(need)
    padded = F.concat(F.lit("\u0002"), "name", F.lit("\u0003")) if width == 2 else F.col("name")
    cut = F.transform(F.sequence(F.lit(1), F.length(padded) - (width - 1)), lambda i: F.struct(padded.substr(i, F.lit(width)).alias("gram"), i.alias("at")))
    grams = sized.select("name", "n", F.explode(cut).alias("g")).select("name", "n", "g.gram", "g.at")
    nth = Window.partitionBy("name", "gram").orderBy("at")
    grams = durable(grams.withColumn("nth", F.row_number().over(nth)))
    counted = grams.join(large(grams.groupBy("gram", "nth").agg(F.count("*").alias("names"))), ["gram", "nth"])
    rarest = Window.partitionBy("name").orderBy("names", "gram", "nth")
    ranked = counted.withColumn("place", F.row_number().over(rarest)).filter(F.col("place") <= width * _lost(F.col("n"), need) + 1)
    held = durable(ranked.select("gram", "nth", "name", "n", F.ceil(F.col("names") / GRAM_BLOCK).cast("int").alias("blocks")))
    left = held.select("gram", "nth", F.col("name").alias("x"), F.col("n").alias("n_x"), F.pmod(F.xxhash64("name"), F.col("blocks")).cast("int").alias("block"))
    right = held.select("gram", "nth", F.col("name").alias("y"), F.col("n").alias("n_y"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    both = F.col("n_x") + F.col("n_y")
    sized_alike = 2.0 * F.least("n_x", "n_y") >= (need - 1e-9) * both
    met = left.join(large(right), ["gram", "nth", "block"]).filter((F.col("x") < F.col("y")) & sized_alike & (F.greatest("n_x", "n_y") >= least))
    bound = 1 - F.levenshtein("x", "y") / both
    return met.select("x", "y", "n_x", "n_y").distinct().filter(bound >= need - 1e-9).select("x", "y")


def fuzzy_candidates(nodes: DataFrame, edges: DataFrame, least: float, limit: int = 200, key=comparison_key) -> DataFrame:
    """The ``limit`` best pairs of nodes that share no term: ``a, b, score`` with a < b.

    A pair's lexical similarity is the best of its terms, names and aliases; its score is that, or, where
    more, the terms, summaries and neighbours by their shares.  No pair is lost: a score of T
    needs a lexical similarity of (T - 0.35) / 0.65, for which ``similar_names`` searches all terms.  A first
    look at some near names finds ``limit`` pairs where it can; the last of their scores is a bar that as many pairs
    reach.  Else, and where a higher one may do, the bar T is lowered until ``limit`` pairs reach it.  Two names that many nodes
    bear aren't made into a pair for each two of these: the best by terms alone are the first in order (``_first``), and others
    need common neighbours (``_neighbourly``).  ``edges`` may be raw evidence: what counts is which relations there are.
    ``least`` must exceed 0.35, as below it terms needn't have anything in common.  Order: score, names, ids.
    """
    if not least > SUMMARY_SHARE + NEIGHBOUR_SHARE:
        raise ValueError("the least score must exceed 0.35")
    of = durable(terms(nodes, key))
    named = durable(nodes.select("node_id", "keyword", key(F.col("keyword")).alias("told"), F.substring(key(F.col("summary")), 1, SUMMARY_SIGNS).alias("gist")))
    names = durable(of.select(F.col("term").alias("name")).distinct())
    order = [F.desc("score"), "a_name", "b_name", "a", "b"]
    signatures = lambda some: neighbour_signatures(_touching(edges, some), nodes, key)

    def search(bar: float) -> DataFrame:
        """Of the pairs whose score reaches the bar the first."""
        need = (bar - SUMMARY_SHARE - NEIGHBOUR_SHARE) / NAME_SHARE - 1e-9
        alike = _alike(similar_names(names, need), need)
        if alike.isEmpty():
            return of.sparkSession.createDataFrame([], "a string, b string, a_name string, b_name string, score double")
        # the least part of their neighbours that two nodes share whose score exceeds their terms' and reaches the bar
        share = ((1 - NAME_SHARE) * bar - SUMMARY_SHARE) / NEIGHBOUR_SHARE - 1e-6
        if share > 0:
            first = _first(of, named, alike, bar, limit)
            met = _paired(of, alike, _neighbourly(of, named, edges, alike, share, key))
            every = first.unionByName(_scored(of, named, met, signatures, bar, limit))
            found = every.groupBy("a", "b", "a_name", "b_name").agg(F.max("score").alias("score"))
        else:
            found = _scored(of, named, _paired(of, alike), signatures, bar, limit)
        return durable(found.orderBy(*order).limit(limit))

    floor = _look(of, named, names, signatures, least, limit)
    for bar in (*[x for x in BARS if x > floor + 0.01], floor):
        found = search(bar)
        if found.count() == limit:
            break
    return found.orderBy(*order).select("a", "b", "score")


def _look(of: DataFrame, named: DataFrame, names: DataFrame, signatures: Callable[[DataFrame], DataFrame], least: float, limit: int) -> float:
    """A score that ``limit`` pairs of nodes reach, told by some of the nearest names and some of their nodes; else ``least``."""
    pairs = durable(_nearest_names(names, LOOK_PAIRS * limit))
    asked = pairs.select(F.explode(F.array("x", "y")).alias("term")).distinct()
    order = Window.partitionBy("term").orderBy("node_id")
    some = of.join(asked, "term", "left_semi").withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= LOOK_NODES).drop("_r")
    # all terms of these nodes, so that pairs which share one are told
    few = durable(of.join(some.select("node_id").distinct(), "node_id", "left_semi"))
    need = (least - SUMMARY_SHARE - NEIGHBOUR_SHARE) / NAME_SHARE - 1e-9
    found = _scored(few, named, _paired(few, _alike(pairs, need)), signatures, least, limit).select("score").orderBy(F.desc("score")).limit(limit)
    last = found.agg(F.count("*").alias("n"), F.min("score").alias("score")).first()
    return max(least, last["score"]) if last["n"] == limit else least


def _touching(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """Edges of the pairs' nodes."""
    ends = small(durable(pairs.select(F.explode(F.array("a", "b")).alias("node_id")).distinct()))
    out, back = (edges.join(ends.withColumnRenamed("node_id", c), c, "left_semi") for c in ("source_node_id", "target_node_id"))
    return out.unionByName(back).select("source_node_id", "relation", "target_node_id").distinct()


def _alike(pairs: DataFrame, need: float) -> DataFrame:
    """``x, y, lex`` of pairs of names, both ways: the order of its arguments can change a ratio, and the smaller node's term comes first."""
    both = durable(pairs).transform(lambda p: p.unionByName(p.select(F.col("y").alias("x"), F.col("x").alias("y"))))
    return durable(both.withColumn("lex", difflib_ratio("x", "y")).filter(F.col("lex") >= need - 1e-9))


def _bearers(of: DataFrame, node: str, term: str) -> DataFrame:
    return large(of.select(F.col("node_id").alias(node), F.col("term").alias(term)))


def _paired(of: DataFrame, alike: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """``a, b, lex``: pairs of nodes that bear similar terms, all or those among ``pairs(a, b)``, by their best."""
    if pairs is None:
        met = alike.join(_bearers(of, "a", "x"), "x").join(_bearers(of, "b", "y"), "y").filter("a < b")
    else:
        met = pairs.join(_bearers(of, "a", "x"), "a").join(_bearers(of, "b", "y"), "b").join(large(alike), ["x", "y"])
    return met.groupBy("a", "b").agg(F.max("lex").alias("lex"))


def _strangers(of: DataFrame, met: DataFrame) -> DataFrame:
    """Of pairs of nodes those that share no term."""
    met = durable(met)
    shared = met.join(_bearers(of, "a", "t"), "a").join(_bearers(of, "b", "t"), ["b", "t"]).select("a", "b").distinct()
    return met.join(shared, ["a", "b"], "left_anti")


def _first(of: DataFrame, named: DataFrame, alike: DataFrame, bar: float, limit: int) -> DataFrame:
    """``a, b, a_name, b_name, score``: the first ``limit`` pairs of nodes by their terms alone, as far as these reach the bar.

    All pairs of a node with those of another name follow each other in the order of scores, names and ids, and how many
    they are is known before they are made.  So pairs are made from the first ones on until there are enough that share no term.
    """
    near = durable(alike.filter(F.col("lex") >= bar))
    order = [F.desc("lex"), "a_name", "b_name", "a"]
    name = lambda node: large(named.select(F.col("node_id").alias(node), F.col("keyword").alias(f"{node}_name")))
    bearers = lambda node, term, has: _bearers(of, node, term).join(large(near.select(has).distinct().withColumnRenamed(has, term)), term, "left_semi").join(name(node), node)
    right = durable(bearers("b", "y", "y"))
    counted = right.groupBy("y", "b_name").agg(F.count("*").alias("n"))
    runs = near.join(large(bearers("a", "x", "x")), "x").join(large(counted), "y").groupBy("lex", "a_name", "b_name", "a").agg(F.sum("n").alias("n"))
    runs = durable(runs)
    total, most = runs.count(), FIRST_PAIRS * limit
    while True:
        some = runs.orderBy(*order).limit(most).withColumn("before", F.sum("n").over(Window.orderBy(*order)) - F.col("n")).filter(F.col("before") < most)
        some = durable(some.select("lex", "a_name", "b_name", "a"))
        met = some.join(_bearers(of, "a", "x"), "a").join(large(near), ["x", "lex"]).join(large(right), ["y", "b_name"]).filter("a < b")
        found = durable(_strangers(of, met.groupBy("a", "b", "a_name", "b_name").agg(F.max("lex").alias("score"))).orderBy(F.desc("score"), "a_name", "b_name", "a", "b").limit(limit))
        if some.count() == total or found.count() == limit:
            return found.select("a", "b", "a_name", "b_name", "score")
        most *= 8


def _neighbourly(of: DataFrame, named: DataFrame, edges: DataFrame, alike: DataFrame, share: float, key) -> DataFrame:
    """``a, b``: pairs of nodes with similar terms that can have a Jaccard similarity of neighbours of ``share``, none left out.

    Of two such sets, each in the order of hashes, the first elements, one more than can be missing in the other, have one in common.
    """
    pairs = durable(alike.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct())
    asked = durable(of.join(large(pairs.select(F.explode(F.array("x", "y")).alias("term")).distinct()), "term", "left_semi").select("node_id").distinct())
    held = named.select("node_id", "told").join(large(asked.withColumn("asked", F.lit(True))), "node_id", "left")
    end = lambda c: large(held.select(F.col("node_id").alias(f"{c}_node_id"), F.col("told").alias(c), F.coalesce("asked", F.lit(False)).alias(f"{c}_asked")))
    said = small(durable(edges.select("relation").distinct().select("relation", key(F.col("relation")).alias("said"))))
    both = edges.select("source_node_id", "relation", "target_node_id").join(said, "relation", "left").join(end("source"), "source_node_id").join(end("target"), "target_node_id")
    sign = lambda way, own, other: F.when(F.col(f"{own}_asked"), F.struct(F.col(f"{own}_node_id").alias("node_id"), F.xxhash64(F.concat_ws(":", F.lit(way), "said", other)).alias("sign")))
    told = both.filter("source_asked OR target_asked").select(F.explode(F.array_compact(F.array(sign("out", "source", "target"), sign("in", "target", "source")))).alias("e"))
    of_node = Window.partitionBy("node_id")
    ranked = told.select("e.node_id", "e.sign").repartition("node_id").distinct().withColumn("n", F.count("*").over(of_node)).withColumn("place", F.row_number().over(of_node.orderBy("sign")))
    first = durable(ranked.filter(F.col("place") <= F.col("n") - F.ceil(share * F.col("n")) + 1).select("node_id", "n", "sign"))

    def side(node: str, term: str) -> DataFrame:
        borne = pairs.join(_bearers(of, "node_id", term), term).select("node_id", F.xxhash64("x", "y").alias("p"))
        return borne.join(large(first), "node_id").select(F.xxhash64("p", "sign").alias("h"), F.col("node_id").alias(node), F.col("n").alias(f"n_{node}"))

    met = side("a", "x").join(large(side("b", "y")), "h").filter((F.col("a") != F.col("b")) & (F.least("n_a", "n_b") >= share * F.greatest("n_a", "n_b")))
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _scored(of: DataFrame, named: DataFrame, met: DataFrame, signatures: Callable[[DataFrame], DataFrame], bar: float, limit: int) -> DataFrame:
    """Of pairs of nodes ``met(a, b, lex)`` those that reach the bar and can be among the first: ``a, b, a_name, b_name, score``.

    Costly parts of a score run on pairs only whose best conceivable score isn't below the
    ``limit``-th that is already certain.
    """

    def contenders(rows: DataFrame, sure: Column, best: Column) -> DataFrame:
        certain = rows.select(sure.alias("s")).orderBy(F.desc("s")).limit(limit)
        edge = certain.agg(F.min("s").alias("s"), F.count("*").alias("n")).first()
        return rows.filter(best >= (max(bar, edge["s"]) if edge["n"] == limit else bar) - 1e-9)

    met = durable(_strangers(of, met))
    lex = F.col("lex")
    some = contenders(met, lex, F.greatest(lex, NAME_SHARE * lex + SUMMARY_SHARE + NEIGHBOUR_SHARE))
    gist = lambda x: large(named.select(F.col("node_id").alias(x), F.col("gist").alias(f"{x}_gist"), F.col("keyword").alias(f"{x}_name")))
    told = durable(some.join(gist("a"), "a").join(gist("b"), "b").withColumn("same", F.coalesce("a_gist", F.lit("")) == F.coalesce("b_gist", F.lit(""))))
    differ = told.filter("NOT same").select("a_gist", "b_gist").distinct().withColumn("alike", difflib_ratio("a_gist", "b_gist"))
    marked = told.join(differ, told["a_gist"].eqNullSafe(differ["a_gist"]) & told["b_gist"].eqNullSafe(differ["b_gist"]), "left")
    told = durable(marked.select("a", "b", "a_name", "b_name", "lex", F.when(F.col("same"), 1.0).otherwise(F.col("alike")).alias("alike")))
    mixed = NAME_SHARE * lex + SUMMARY_SHARE * F.col("alike")
    left = durable(contenders(told, F.greatest(lex, mixed), F.greatest(lex, mixed + NEIGHBOUR_SHARE)))
    near = neighbour_jaccard(left.select("a", "b"), durable(signatures(left)))
    score = F.greatest("lex", mixed + NEIGHBOUR_SHARE * F.col("jaccard"))
    return left.join(near, ["a", "b"]).select("a", "b", "a_name", "b_name", score.alias("score")).filter(F.col("score") >= bar)


def merge_candidates(nodes: DataFrame, edges: DataFrame, least: float, limit: int = 200, key=comparison_key) -> DataFrame:
    """The first ``limit`` merge pairs of a review list, ``a, b, score, reason``: those that share a term, then similar ones."""
    exact = exact_candidates(nodes, limit, key).select("a", "b", "score", F.lit("exact_term").alias("reason"))
    fuzzy = fuzzy_candidates(nodes, edges, least, limit, key).withColumn("reason", F.lit("semantic_similarity"))
    name = lambda x: nodes.select(F.col("node_id").alias(x), F.col("keyword").alias(f"{x}_name"))
    every = durable(exact.unionByName(fuzzy)).join(name("a"), "a").join(name("b"), "b")
    return every.orderBy(F.desc("score"), "a_name", "b_name", "a", "b").limit(limit).select("a", "b", "score", "reason")
