"""Fuzzy matching of names against a reference table, over the candidate index of ``candidates``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import similarity as S
from ..functions import text as X
from .candidates import near
from .records import small
from .shared import once, remove, stored

Score = Callable[[Column, Column], Column]
#: What the reference calls a cell that names nothing.
UNKNOWN = "Non identifiée"


def top_k(probes: DataFrame, names: DataFrame, probe: str, name: str, k: int = 5, score: Score = S.weighted_col, least: float = 0.0, pos: str | None = None) -> DataFrame:
    """Each distinct probe's k best names with ``score`` and ``rank``, ties by ``pos``, or by name where there is none."""
    place = F.col(pos).alias("_pos") if pos else F.lit(0).alias("_pos")
    order = names.filter(F.col(name).isNotNull()).select(F.col(name).alias("_name"), place).groupBy("_name").agg(F.min("_pos").alias("_pos"))
    found = near(probes, order, probe, "_name", score, least, k).join(small(order), "_name")
    ranked = found.withColumn("rank", F.row_number().over(W.partitionBy(probe).orderBy(F.desc("_score"), "_pos", "_name")))
    return ranked.filter(F.col("rank") <= k).select(probe, F.col("_name").alias(name), F.col("_score").alias("score"), "rank")


def _shortlist(keys: DataFrame, ref: DataFrame, weighted: Score, sort: Score) -> DataFrame:
    """(_q, _n, _pos, ..., _at): the 15 names of the best weighted score, in order, then those of the 10 best of sorted words; ties by the names' order.
    Names that share a key are candidates of their own. Where both scores are one, the 10 are among the 15.
    """
    first = lambda score, k: near(keys, ref, "_q", "_n", score, 0.0, k).join(small(ref), "_n").withColumn("_at", F.row_number().over(W.partitionBy("_q").orderBy(F.desc("_score"), "_pos"))).filter(F.col("_at") <= k)
    if weighted is sort:
        return first(weighted, 15)
    both = first(weighted, 15).unionByName(first(sort, 10).withColumn("_at", F.col("_at") + 15)).drop("_score")
    return both.groupBy("_q", "_n", "_pos", "official", "code").agg(F.min("_at").alias("_at"))


def _text_matches(texts: DataFrame, names: DataFrame, name: str, code: str | None, name_pos: str | None, weighted: Score, sort: Score, align: Score) -> DataFrame:
    """Each distinct text (brut) with what its matching needs, whatever cell it stands in, as a stored table: short and short_code of a short form (J1); else, unless it is noise,
    the best name (_n, official, code, methode) with its score _sw and the text's informativeness and coherence of lengths (M4).
    """
    from . import communes as C

    ref = names.select(X.match_key(name).alias("_n"), F.col(name).alias("official"), (F.col(code) if code else F.lit("")).cast("string").alias("code"), (F.col(name_pos) if name_pos else F.col(name)).alias("_pos")).filter(F.col("official").isNotNull())
    forms = C.short_forms(names.select(F.col(name).alias("officiel")), "officiel").select("forme", F.col("officiel").alias("short"))
    codes = ref.groupBy(F.col("official").alias("short")).agg(F.min_by("code", "_pos").alias("short_code"))
    keys = stored(texts.distinct().withColumn("_q", C.reading_key("brut")), "keys")
    told = stored(keys.join(small(forms), F.col("_q") == F.col("forme"), "left").join(small(codes), "short", "left").select("brut", "_q", "short", "short_code"), "told")
    clear = told.filter(F.col("short").isNull() & F.col("_q").isNotNull() & ~C.is_noise(F.col("_q")))
    q, n = F.col("_q"), F.col("_n")
    listed = _shortlist(clear.select("_q").distinct(), ref.filter("_n <> ''"), weighted, sort)
    begins, equal = (F.length(q) >= 4) & n.startswith(q), (F.length(q) <= 5) & (q == n)
    raised = lambda on, by, s: F.when(on, F.least(F.lit(100.0), s + by)).otherwise(s)
    aligned = F.col("_score") if align is weighted and weighted is sort else align(q, n)
    listed = listed.withColumn("_sw", aligned).withColumn("_sw", X.bound(X.bound(F.col("_sw"), lambda s: raised(begins, 10.0, s)), lambda s: raised(equal, 20.0, s)))
    listed = listed.withColumn("_k", F.row_number().over(W.partitionBy("_q").orderBy(F.desc("_sw"), "_at"))).filter("_k = 1")
    chosen = listed.select("_q", "_n", "official", "code", "_sw", F.when((begins | equal) & (F.col("_sw") > 0), "prefixe").otherwise("fuzzy").alias("methode"), X.informativeness("_q").alias("_info"), X.length_coherence("_q", "_n").alias("_even"))
    out = stored(told.join(chosen, "_q", "left").drop("_q"), "matches")
    remove(keys, told)
    return out


def match_hypotheses(
    hypotheses: DataFrame, names: DataFrame, cell: str = "cell_id", text: str = "text", prob: str = "prob", name: str = "name", code: str | None = None, pos: str | None = None, name_pos: str | None = None,
    weighted: Score = S.weighted_col, sort: Score = S.token_sort_col, align: Score = S.alignment_col,
) -> DataFrame:
    """One row a cell: official, code, score (int), methode, brut, hypotheses (a line on each reading that was scored).

    A cell's first reading that is a name's short form (J1) gives 100, "abreviation". Else readings that are noise (F5) are passed over; of
    the shortlist of each other one the best alignment (+10, "prefixe", for a name that begins with a reading of four signs or more; +20 for
    an equal reading of five or fewer), ties by the shortlist's order, then 0.7 of it and 30 times the reading's probability, times informativeness
    and length coherence (M4). The first best reading from 45 wins; without one the cell is "Non identifiée" with score 0. ``pos`` orders a
    cell's readings, ``name_pos`` the names; without them texts and names do. All that a text alone decides is made once a distinct text and
    stored; the readings meet it in one join and are gathered by cell once.
    """
    own = hypotheses.select(F.col(cell).alias("_cell"), F.col(text).alias("brut"), F.col(prob).cast("double").alias("_prob"), F.struct((F.col(pos) if pos else -F.col(prob)).alias("p"), F.col(text).alias("t")).alias("_o"))
    rows = own.join(small(_text_matches(own.select("brut"), names, name, code, name_pos, weighted, sort, align)), "brut", "left")
    rows = rows.withColumn("_s", (0.7 * F.col("_sw") + 30.0 * F.col("_prob")) * F.col("_info") * F.col("_even"))
    line = F.format_string("'%s'(%.2f)->%s(%.0f%% %s)", "brut", "_prob", "_n", "_s", "methode")
    best = rows.groupBy("_cell").agg(
        F.min(F.struct("_o", "brut"))["brut"].alias("_first"),
        F.min(F.when(F.col("short").isNotNull(), F.struct("_o", F.struct("short", "short_code", "brut").alias("b"))))["b"].alias("a"),
        F.min(F.when(F.col("_sw").isNotNull(), F.struct((-F.col("_s")).alias("s"), "_o", F.struct("official", "code", "_s", "methode", "brut").alias("b"))))["b"].alias("b"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("_sw").isNotNull(), F.struct("_o", line.alias("l"))))), lambda x: x["l"]), " | ").alias("_lines"),
    )
    short, sure = F.col("a").isNotNull(), F.coalesce(F.col("b._s") >= 45, F.lit(False))
    pick = lambda a, b, c: F.when(short, a).when(sure, b).otherwise(c)
    return best.select(
        F.col("_cell").alias(cell), pick(F.col("a.short"), F.col("b.official"), UNKNOWN).alias("official"), pick(F.col("a.short_code"), F.col("b.code"), "").alias("code"), pick(100, F.col("b._s").cast("int"), 0).alias("score"),
        pick("abreviation", F.col("b.methode"), "aucun").alias("methode"), pick(F.col("a.brut"), F.col("b.brut"), F.col("_first")).alias("brut"),
        F.when(short, F.concat(F.lit("abbrev:'"), "a.brut", F.lit("'->'"), "a.short", F.lit("'"))).otherwise(F.coalesce("_lines", F.lit(""))).alias("hypotheses"),
    )


def label_score(block: Column, label: Column) -> Column:
    """X3 of two columns: 1 if the block's key contains the label, else M7 for labels of six signs or more."""
    return F.when(block.contains(label), 1.0).when(F.length(label) >= 6, S.sequence_col(block, label)).otherwise(0.0)


label_score.batch = "label"


def label_matches(blocks: DataFrame, labels: DataFrame, text: str = "text", label: str = "label", least: float = 0.82) -> DataFrame:
    """Per block the longest label that its key contains, or that it resembles (labels of six signs or more)."""
    own = once(blocks, {"_b": X.label_key(text)}, F.lit(True))
    hit = near(own, labels.select(X.label_key(label).alias("_l")), "_b", "_l", label_score, least)
    best = hit.groupBy("_b").agg(F.max_by("_l", F.struct(F.length("_l"), "_l")).alias("found"))
    return own.join(best, "_b").drop("_b")


def within_edits(words: DataFrame, word: str, label: str, most: int = 2) -> DataFrame:
    """M6."""
    d = F.levenshtein(F.col(word), F.lit(label), most)
    return words.withColumn("distance", d).filter(d.between(0, most))
