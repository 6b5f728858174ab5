"""Linking a list of contacts to a large base: blocking, ranked candidates, verdicts, conflicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from contactdq.functions.barrier import settled
from contactdq.functions.letters import compared_cells
from contactdq.functions.similarity import dice, jaro_winkler
from contactdq.functions.text import name_key, name_tokens, sorted_key
from contactdq.operators.names import classified, cross_scores, first_segment, once
from contactdq.session import stored

BLOCK_LENGTH = 4

#: A token that so many base keys have, or fewer, gives candidates outright; what shares only more frequent ones must pass bounds first.
RARE = 50


def _light_scores(pairs: DataFrame) -> DataFrame:
    """``x, y, score`` of pairs of keys: the better of Jaro-Winkler over sorted words and DICE, as a cross-match ranks them."""
    told = pairs.withColumns({"_tx": name_tokens(F.col("x")), "_ty": name_tokens(F.col("y")), "_jw": jaro_winkler(sorted_key(F.col("x")), sorted_key(F.col("y")))})
    return told.select("x", "y", F.greatest(F.round("_jw", 6), F.round(dice(F.col("_tx"), F.col("_ty")), 6)).alias("score"))


#: The characters of keys. Up to four of each are told apart as bits of three numbers, so that what two keys have in common is counted by a few instructions.
_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789 "
_EACH, _BITS = 4, 50


def _spelled(keys: DataFrame, x: str) -> DataFrame:
    """Distinct keys as ``x``, with words ``w``, sorted key ``s``, letters ``l`` (the first A, the second A and so on are different ones), and the letters as bits: ``m``, a struct of three numbers and how many found no bit."""
    rows = keys.select(F.col("CLAVE").alias(x), F.col("TOKENS").alias(f"w{x}"), sorted_key(F.col("CLAVE")).alias(f"s{x}"))
    rows = settled(rows.withColumn("_c", F.array_sort(F.split(f"s{x}", ""))), f"s{x}", "_c")
    rows = settled(rows.withColumn(f"l{x}", F.expr("transform(_c, (c, i) -> concat(c, cast(i - array_position(_c, c) + 2 AS string)))")).drop("_c"), f"l{x}")
    place = f"transform(filter(l{x}, e -> int(substring(e, 2)) <= {_EACH}), e -> (instr('{_ALPHABET}', left(e, 1)) - 1) * {_EACH} + int(substring(e, 2)) - 1)"
    rows = settled(rows.withColumn("_p", F.expr(place)), "_p")
    words = [f"aggregate(filter(_p, i -> i DIV {_BITS} = {k}), 0L, (a, i) -> a | shiftleft(1L, int(i % {_BITS}))) AS b{k}" for k in range(3)]
    return rows.withColumn(f"m{x}", F.expr(f"struct({', '.join(words)}, size(l{x}) - size(_p) AS more, length(s{x}) AS n, left(s{x}, 4) AS head, size(w{x}) AS words)")).drop("_p")


def _floors(scored: DataFrame, k: int) -> DataFrame:
    """``x, floor``: the k-th best score of each left key that has as many, less what rounding may add."""
    place = F.row_number().over(Window.partitionBy("x").orderBy(F.desc("score")))
    return scored.withColumn("_p", place).filter(F.col("_p") == k).select("x", (F.col("score") - 1e-6).alias("floor"))


def best_pairs(left: DataFrame, right: DataFrame, k: int, least: int = BLOCK_LENGTH, rare: int = RARE) -> DataFrame:
    """``x, y, score`` of distinct keys (``CLAVE, TOKENS``): every pair that shares a long token and can be among the best k of its left key, and some others.

    Pairs that share a rare token are scored, and some that share a frequent one: those with a rare half of a word in common (one slip leaves one half whole) and
    a few whose lengths are alike. So most left keys have a k-th best score. A pair that shares frequent tokens only must reach it: see ``_looked_up``.
    """
    token = lambda d, x: d.withColumn("t", F.explode(F.filter(f"w{x}", lambda t: F.length(t) >= least)))
    left, right = stored(_spelled(left, "x"), "left"), stored(_spelled(right, "y"), "right")
    lx, ry = token(left, "x"), token(right, "y")
    often = ry.groupBy("t").agg(F.count("*").alias("df")).filter(F.col("df") > rare)
    if often.isEmpty():
        return _light_scores(lx.select("x", "t").join(ry.select("y", "t"), "t").select("x", "y").distinct())
    often = stored(often, "often")
    scored = stored(_light_scores(lx.join(often, "t", "left_anti").select("x", "t").join(ry.join(often, "t", "left_anti").select("y", "t"), "t").select("x", "y").distinct()), "scored")
    lx, ry = lx.join(often, "t"), ry.join(often, "t")
    shape = ry.groupBy("t", F.length("sy").alias("n")).agg(F.min("y").alias("a"), F.max("y").alias("b"))
    near = lx.select("x", "t", F.explode(F.sequence(F.length("sx") - 1, F.length("sx") + 1)).alias("n")).join(shape, ["t", "n"])
    seeds = near.select("x", F.explode(F.array("a", "b")).alias("y")).unionByName(_half_alike(left, right, least, rare)).distinct()
    scored = stored(scored.unionByName(_light_scores(seeds)).distinct(), "seeded")
    # Words that both can have where no rare one is shared: the frequent and the short ones.
    held = lx.groupBy("x", "wx", "mx").agg(F.collect_set("t").alias("ts"))
    held = held.select("x", "mx", "ts", (F.size("ts") + F.size(F.filter("wx", lambda t: F.length(t) < least))).alias("open"))
    held = stored(held.join(_floors(scored, k), "x", "left").withColumn("floor", F.coalesce("floor", F.lit(0.0))), "held")
    met = _looked_up(held, ry, k).distinct().join(scored.select("x", "y"), ["x", "y"], "left_anti")
    return scored.unionByName(_light_scores(met))


#: Pairs are told apart by how many first characters they must share at least; Jaro-Winkler adds for as many as stand second.
_HEADS = ((0, 0), (1, 2), (3, 4))

#: Left keys that may lack more letters are compared with all of the token, length and head. Such a comparison counts as so many by rare letters.
_LOOSE, _WEIGHT = 3, 64

#: Most base keys of a cell, comparisons of a cell, and rows of both sides that a task is given at about.
_CELL, _WORK, _BUCKET = 1 << 16, 1 << 30, 1 << 16


def _asked(held: DataFrame, ry: DataFrame) -> DataFrame:
    """For each left key, frequent token, length of base keys and head (``q`` characters): ``misses``, how many of its letters it may lack for the floor to be reached; ``_LOOSE + 1`` stands for more. No rows where it cannot be reached."""
    each = held.withColumn("sx", sorted_key(F.col("x"))).withColumn("t", F.explode("ts")).join(ry.groupBy("t").agg(F.collect_set("my.n").alias("lengths")), "t").withColumn("n", F.explode("lengths"))
    needs = [f"cast(ceil((3 * (floor - {c / 10}) / {1 - c / 10} - 1) / (1D / mx.n + 1D / n) - 1e-6) AS int)" for _, c in _HEADS]
    each = each.withColumn("_m", F.array(*map(F.expr, needs))).withColumn("_all", F.expr("2 * open >= floor * (mx.words + open)"))
    told, earlier = [], F.lit(False)
    for i, (q, _) in enumerate(_HEADS):
        least = F.get("_m", F.lit(i))
        may, loose = F.col("_all") | (least <= F.least("mx.n", "n")), F.col("_all") | (F.col("mx.n") - least > _LOOSE)
        told.append(F.when(may & ~earlier, F.struct(F.lit(q).alias("q"), F.when(loose, _LOOSE + 1).otherwise(F.col("mx.n") - least).alias("misses"))))
        earlier = earlier | (may & loose)
    each = each.withColumn("w", F.explode(F.array_compact(F.array(*told)))).select("x", "sx", "mx", "floor", "open", "t", "n", "w.*")
    return each.withColumn("head", F.expr("left(mx.head, q)"))


def _looked_up(held: DataFrame, ry: DataFrame, k: int = 5) -> DataFrame:
    """``x, y`` of pairs that share a frequent token and may reach the left key's floor, some of them more than once.

    Keys meet in cells: those of one token, length of the base key and head, dealt over so many cells that none holds more than a task can. What is compared within a cell
    is bits of letters, in numpy; no pair is made before it has passed.
    """
    place = ["t", "n", "q", "head"]
    asked = stored(_asked(held, ry), "asked")
    wants = asked.groupBy(*place).agg(F.count("*").alias("asks"), F.sum(F.when(F.col("misses") > _LOOSE, _WEIGHT).otherwise(1)).alias("weight"))
    given = ry.select("t", "y", "sy", "my", F.col("my.n").alias("n"), F.explode(F.array(*[F.lit(q) for q, _ in _HEADS])).alias("q")).withColumn("head", F.expr("left(my.head, q)"))
    parts = wants.join(given.groupBy(*place).agg(F.count("*").alias("base")), place).withColumn("ys", F.ceil(F.col("base") / _CELL))
    parts = parts.withColumn("xs", F.greatest(F.ceil(F.col("asks") / _CELL), F.ceil(F.col("weight") * F.least("base", F.lit(_CELL)) / _WORK)))
    cells = parts.withColumn("yi", F.explode(F.sequence(F.lit(0), F.col("ys") - 1))).withColumn("xi", F.explode(F.sequence(F.lit(0), F.col("xs") - 1)))
    cells = stored(cells.withColumn("cell", F.monotonically_increasing_id()), "cells")
    rows = cells.agg(F.sum(F.expr("asks / xs + base / ys"))).first()[0] or 0
    tasks = max(1, round(rows / _BUCKET))
    dealt = lambda key, n: F.pmod(F.xxhash64(key), n)
    bits = lambda m: [F.col(f"{m}.b0"), F.col(f"{m}.b1"), F.col(f"{m}.b2"), F.col(f"{m}.more"), F.col(f"{m}.words")]
    bucket = F.pmod(F.xxhash64("cell"), F.lit(tasks)).alias("bucket")
    few = asked.join(cells, place).filter(dealt("x", F.col("xs")) == F.col("xi")).select(bucket, "cell", "x", "sx", *bits("mx"), "open", "floor", "misses")
    many = given.join(cells, place).filter(dealt("y", F.col("ys")) == F.col("yi")).select(bucket, F.col("cell").alias("cell"), "y", "sy", *bits("my"))
    both = few.repartition(tasks, "bucket").groupBy("bucket").cogroup(many.repartition(tasks, "bucket").groupBy("bucket"))
    return both.applyInArrow(lambda left, right: compared_cells(left, right, k, _LOOSE), "x string, y string")


def _bound() -> Column:
    """The best score that two keys can have: from all letters that they share, none of them out of order, the first letters that they do share, and as many common words as there may be."""
    common = "(bit_count(mx.b0 & my.b0) + bit_count(mx.b1 & my.b1) + bit_count(mx.b2 & my.b2) + least(mx.more, my.more))"
    jaro = f"(({common} / mx.n + {common} / my.n + 1) / 3)"
    first = "CASE WHEN mx.head = my.head THEN 4 WHEN left(mx.head, 3) = left(my.head, 3) THEN 3 WHEN left(mx.head, 2) = left(my.head, 2) THEN 2 WHEN left(mx.head, 1) = left(my.head, 1) THEN 1 ELSE 0 END"
    return F.expr(f"greatest({jaro} + 0.1 * ({first}) * (1 - {jaro}), 2 * least(open, my.words) / (mx.words + my.words))")


def _half_alike(left: DataFrame, right: DataFrame, least: int, rare: int) -> DataFrame:
    """``x, y`` of keys that share a long word, and the first or the second half of another one that few base keys have."""
    halves = "flatten(transform({0}, t -> array(concat('<', left(t, length(t) DIV 2)), concat('>', right(t, length(t) - length(t) DIV 2)))))"
    parted = lambda d, x: d.select(x, F.filter(f"w{x}", lambda t: F.length(t) >= least).alias(f"w{x}")).withColumn("h", F.explode(F.expr(halves.format(f"filter(w{x}, t -> length(t) >= 6)"))))
    hy = parted(right, "y")
    few = hy.groupBy("h").agg(F.count("*").alias("n")).filter(F.col("n") <= rare).select("h")
    return parted(left, "x").join(hy.join(few, "h"), "h").filter(F.arrays_overlap("wx", "wy")).select("x", "y").distinct()


def cross_match(left: DataFrame, right: DataFrame, k: int = 5, left_id: str = "ID_ARCHIVO", left_name: str = "DENOM", right_id: str = "ID_BASE", right_name: str = "DENOM", extras: list[str] | None = None, document: str | None = None) -> DataFrame:
    """The best ``k`` candidates of every left row with scores and verdict; a row without candidates has RANKING 0 and the verdict NO.

    Ties are broken by the base id. Carried columns never influence a score. Scores depend on the keys alone, so each pair of distinct keys is scored
    once, however many rows have them. Of base rows that share an id one counts: that of the least name, then of the least document.
    """
    # A table of few bytes comes in few tasks, however many rows it has; judging them is what takes long.
    a = classified(left.select(F.col(left_id).cast("string").alias("ID_ARCHIVO"), F.col(left_name).alias("_n"), *[F.col(c) for c in extras or []]).repartition("ID_ARCHIVO"), "_n").drop("_n")
    named = [F.col(right_name).alias("DENOM_BASE"), *([F.col(document).alias("DOC_BASE")] if document else [])]
    once = right.select(F.col(right_id).alias("ID_BASE"), F.struct(F.col(right_name).isNull(), *named).alias("_r")).groupBy("ID_BASE").agg(F.min("_r").alias("_r"))
    b = classified(once.select("ID_BASE", "_r.DENOM_BASE", *(["_r.DOC_BASE"] if document else [])), "DENOM_BASE")
    keys = lambda d: settled(d.select("CLAVE", "TOKENS"), "CLAVE", "TOKENS").filter("CLAVE <> ''").dropDuplicates(["CLAVE"])
    ka, kb = stored(keys(a), "file_keys"), stored(keys(b), "base_keys")
    # Of base rows of one key none but the k smallest ids can be among the best k.
    least = b.withColumn("_n", F.row_number().over(Window.partitionBy("CLAVE").orderBy("ID_BASE"))).filter(F.col("_n") <= k)
    least = least.select(F.col("CLAVE").alias("CLAVE_BASE"), "ID_BASE", "DENOM_BASE", *(["DOC_BASE"] if document else []))
    same_key = ka.join(kb.select("CLAVE"), "CLAVE").select(F.col("CLAVE").alias("x"), F.col("CLAVE").alias("y"), F.lit(1.0).alias("score"))
    pairs = same_key.unionByName(best_pairs(ka.join(kb.select("CLAVE"), "CLAVE", "left_anti"), kb, k)).select(F.col("x").alias("CLAVE_ARCHIVO"), F.col("y").alias("CLAVE_BASE"), "score")
    order = Window.partitionBy("CLAVE_ARCHIVO").orderBy(F.desc("score"), "ID_BASE")
    chosen = pairs.join(least, "CLAVE_BASE").withColumn("RANKING", F.row_number().over(order)).filter(F.col("RANKING") <= k)
    top = cross_scores(chosen.drop("score"), "CLAVE_ARCHIVO", "CLAVE_BASE")
    joined = a.select("ID_ARCHIVO", F.col("DENOMINACION").alias("DENOM_ARCHIVO"), F.col("CLAVE").alias("CLAVE_ARCHIVO"), "TIPO", "MOTIVO_NORM", *(extras or [])).join(top, "CLAVE_ARCHIVO", "left")
    same = F.col("DENOM_ARCHIVO").eqNullSafe(F.col("DENOM_BASE"))
    joined = joined.withColumn("MOTIVO", F.when(same, F.regexp_replace("MOTIVO", "^IDENTICO_NORMALIZADO", "IDENTICO")).otherwise(F.col("MOTIVO")))
    none = F.col("ID_BASE").isNull()
    return joined.withColumns(
        {
            "RANKING": F.coalesce("RANKING", F.lit(0)),
            "COINCIDE": F.coalesce("COINCIDE", F.lit("NO")),
            "MOTIVO": F.when(none, F.coalesce(F.nullif("MOTIVO_NORM", F.lit("")), F.lit("SIN_CANDIDATOS_EN_INDICE"))).otherwise(F.col("MOTIVO")),
        }
    )


def paired_match(rows: DataFrame, left_name: str, right_name: str) -> DataFrame:
    """One to one: two columns of the same row compared, RANKING always 1.

    Each distinct pair of names is compared once. Its keys are made in one stage and compared in the next, so that a task holds one Python worker at a time.
    """
    named = ["DENOM_ARCHIVO", "DENOM_BASE"]
    step = rows.withColumns({"DENOM_ARCHIVO": first_segment(F.col(left_name)), "DENOM_BASE": first_segment(F.col(right_name))})
    keyed = lambda pairs: pairs.withColumns({"CLAVE_ARCHIVO": name_key(F.col("DENOM_ARCHIVO")), "CLAVE_BASE": name_key(F.col("DENOM_BASE"))}).repartition("CLAVE_ARCHIVO", "CLAVE_BASE")
    told = once(step, named, lambda pairs: cross_scores(keyed(pairs), "CLAVE_ARCHIVO", "CLAVE_BASE", *named))
    added = [c for c in told.columns if c not in step.columns and not c.startswith("CLAVE")]
    return told.select(*[f"`{c}`" for c in rows.columns], "DENOM_ARCHIVO", "CLAVE_ARCHIVO", "DENOM_BASE", "CLAVE_BASE", *added).withColumn("RANKING", F.lit(1))


def verdict_counts(matched: DataFrame, best_only: bool = True) -> DataFrame:
    """Rows by verdict, of the best candidate of each row or of all candidates."""
    some = matched.filter("RANKING <= 1") if best_only else matched
    return some.groupBy("COINCIDE").agg(F.count("*").alias("CANTIDAD"))


def _added(reason: Column, tag: Column) -> Column:
    return F.left(F.when(F.coalesce(reason, F.lit("")) == "", tag).otherwise(F.concat(reason, F.lit("; "), tag)), F.lit(200))


def _settled(rows: DataFrame, group: str, tag: str, contested: str, margin: float) -> DataFrame:
    """One pass over the groups of yes rows that compete for ``group``; ``contested`` says by a group's figures whether its rows are at odds.

    A group is told by figures that each task sums up for itself before they meet: its rows, least and greatest user and file id (equal if there is but one), and its two
    best scores, of which a task passes on two. They are joined back to the rows; rows that compete for nothing take no part. So no task holds a group.
    """
    step = rows.withColumns(
        {
            "_score": F.greatest(F.coalesce("JARO_WINKLER_ORD", F.lit(0.0)), F.coalesce("DICE", F.lit(0.0))),
            "_user": F.lower(F.trim(F.coalesce("USERNAME", F.lit("")))),
            "_plays": F.coalesce((F.col("COINCIDE") == "SI") & F.col(group).isNotNull(), F.lit(False)),
        }
    )
    rivals = step.filter("_plays")
    figures = rivals.groupBy(group).agg(
        F.count("*").alias("_n"), F.min("_user").alias("_u1"), F.max("_user").alias("_u2"), F.min("ID_ARCHIVO").alias("_a1"), F.max("ID_ARCHIVO").alias("_a2")
    )
    place = F.row_number().over(Window.partitionBy(group).orderBy(F.desc("_score"), "ID"))
    two = rivals.select(group, "_score", "ID").withColumn("_rank", place).filter("_rank <= 2")
    at = lambda rank, c: F.max(F.when(F.col("_rank") == rank, F.col(c)))
    best = two.groupBy(group).agg(at(1, "ID").alias("_first"), (at(1, "_score") - at(2, "_score")).alias("_gap"))
    told = rivals.join(figures.join(best, group), group)
    same = (F.col("_u1") == F.col("_u2")) & (F.col("_u1") != "")
    wins, first = F.coalesce(F.col("_gap") >= margin, F.lit(False)), F.col("ID") == F.col("_first")
    text = (
        F.when(same, F.lit("MISMA_ENTIDAD_MULTIPLE_PERFIL"))
        .when(wins & first, F.concat(F.lit("GANA_POR_MARGEN("), F.format_string("%.4f", "_gap"), F.lit(")")))
        .when(wins, F.lit(f"{tag}_PIERDE_POR_MARGEN"))
        .otherwise(F.lit(f"{tag}_EMPATE_SIN_EVIDENCIA"))
    )
    odds = F.coalesce(F.expr(contested), F.lit(False))
    told = told.withColumns({"MOTIVO": F.when(odds, _added(F.col("MOTIVO"), text)).otherwise(F.col("MOTIVO")), "COINCIDE": F.when(odds & ~same & ~(wins & first), "RE").otherwise(F.col("COINCIDE"))})
    return told.select(*[f"`{c}`" for c in rows.columns]).unionByName(step.filter("NOT _plays").select(*[f"`{c}`" for c in rows.columns]))


def resolved_conflicts(rows: DataFrame, margin: float = 0.03) -> DataFrame:
    """Settle yes rows that share a base id, then, of those still yes, rows that share a file id. Rows have an ``ID`` of their own, none twice.

    A group of one user keeps its verdicts; else a clear margin makes the best row win and the others reviews; else all are reviews.
    """
    return _settled(_settled(rows, "ID_BASE", "CONFLICTO_N1", "_a1 <> _a2", margin), "ID_ARCHIVO", "CONFLICTO_1N", "_n > 1", margin)


def conflicts(rows: DataFrame, by: str = "ID_BASE", of: str = "ID_ARCHIVO") -> DataFrame:
    """Ids that more than one distinct counterpart claims with a yes."""
    return rows.filter("COINCIDE = 'SI'").groupBy(by).agg(F.count_distinct(of).alias("CANTIDAD")).filter("CANTIDAD > 1")


def comparable_phones(text: Column) -> Column:
    """The last eight digits of every number in a cell that has as many."""
    parts = F.transform(F.split(F.coalesce(text, F.lit("")), "[/;,]"), lambda x: F.regexp_replace(x, "[^0-9]", ""))
    return F.array_distinct(F.transform(F.filter(parts, lambda x: F.length(x) >= 8), lambda x: F.right(x, F.lit(8))))


def comparable_mails(text: Column) -> Column:
    """Lower-cased parts of a cell with an at sign."""
    return F.array_distinct(F.transform(F.filter(F.split(F.coalesce(text, F.lit("")), r"[;,/\s]+"), lambda x: x.contains("@")), lambda x: F.lower(x)))
