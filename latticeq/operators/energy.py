"""Algebra of pairwise energy tables: self_e (pos, aa, e) and pair_e (pos_i, pos_j, aa_i, aa_j, e).

Further key columns (structure ids) go in ``by``. Each undirected edge counts once; tables that hold both directions
are brought to one by ``canonical_pairs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def canonical_pairs(pair_e: DataFrame, by: list[str] = (), how: str = "mean", order: str | None = None) -> DataFrame:
    """Edges with pos_i <= pos_j, swapped with their letters where needed; duplicates by mean or the first by ``order``."""
    swap = F.col("pos_i") > F.col("pos_j")
    pick = lambda a, b: F.when(swap, F.col(b)).otherwise(F.col(a))
    rows = pair_e.select(*by, pick("pos_i", "pos_j").alias("pos_i"), pick("pos_j", "pos_i").alias("pos_j"), pick("aa_i", "aa_j").alias("aa_i"), pick("aa_j", "aa_i").alias("aa_j"), "e", *([order] if order else []))
    return rows.groupBy(*by, "pos_i", "pos_j", "aa_i", "aa_j").agg((F.avg("e") if how == "mean" else F.min_by("e", order)).alias("e"))


def sequence_energy(self_e: DataFrame, pair_e: DataFrame, seq: DataFrame, by: list[str] = ()) -> DataFrame:
    """Energy of sequences (rows name, pos, aa): name, energy; letters without an entry count 0."""
    own = seq.join(self_e, [*by, "pos", "aa"]).select(*by, "name", "e")
    i = seq.select(*by, "name", F.col("pos").alias("pos_i"), F.col("aa").alias("aa_i"))
    j = seq.select(*by, "name", F.col("pos").alias("pos_j"), F.col("aa").alias("aa_j"))
    pairs = pair_e.join(i, [*by, "pos_i", "aa_i"]).join(j, [*by, "name", "pos_j", "aa_j"]).select(*by, "name", "e")
    return own.unionAll(pairs).groupBy(*by, "name").agg(F.sum("e").alias("energy"))


def mutation_deltas(self_e: DataFrame, pair_e: DataFrame, seq: DataFrame) -> DataFrame:
    """Change of energy by each single mutation of one sequence (rows pos, aa): pos, aa, delta."""
    totals = position_energies(self_e, pair_e, seq)
    own = totals.join(seq.select("pos", F.col("aa").alias("native")), "pos").filter("aa = native").select("pos", F.col("e").alias("e0"))
    return totals.join(own, "pos").select("pos", "aa", (F.col("e") - F.col("e0")).alias("delta"))


def position_energies(self_e: DataFrame, pair_e: DataFrame, seq: DataFrame, mode: str = "default", binder: str | None = None) -> DataFrame:
    """Energy of each letter at each position given the other positions' letters: pos, aa, e.

    Modes by a boolean column ``binder`` of ``seq``: ``omit_peptide`` leaves out pairs inside the binder,
    ``omit_target`` pairs between binder and target, ``interface_only`` keeps only pairs between them and no self energies.
    """
    tag = [binder] if binder else []
    one = seq.select(F.col("pos").alias("pos_j"), F.col("aa").alias("aa_j"), *(F.col(t).alias("__bj") for t in tag))
    both = pair_e.filter("pos_i <> pos_j")
    both = both.unionAll(both.select(F.col("pos_j").alias("pos_i"), F.col("pos_i").alias("pos_j"), F.col("aa_j").alias("aa_i"), F.col("aa_i").alias("aa_j"), "e"))
    near = both.join(one, ["pos_j", "aa_j"])
    if binder:
        near = near.join(seq.select(F.col("pos").alias("pos_i"), F.col(binder).alias("__bi")), "pos_i")
        keep = {"default": F.lit(True), "omit_peptide": ~(F.col("__bi") & F.col("__bj")), "omit_target": F.col("__bi") == F.col("__bj"), "interface_only": F.col("__bi") != F.col("__bj")}[mode]
        near = near.filter(keep)
    terms = near.select(F.col("pos_i").alias("pos"), F.col("aa_i").alias("aa"), "e")
    own = self_e.select("pos", "aa", F.lit(0.0).alias("e") if mode == "interface_only" else F.col("e").cast("double"))
    return own.unionAll(terms).groupBy("pos", "aa").agg(F.sum("e").alias("e"))


def letter_probabilities(energies: DataFrame, by: list[str], e: str = "e") -> DataFrame:
    """Softmax of -e in each group, shifted by the least energy."""
    w = Window.partitionBy(*by)
    weight = F.exp(F.min(e).over(w) - F.col(e))
    return energies.withColumn("__w", weight).withColumn("p", F.col("__w") / F.sum("__w").over(w)).drop("__w")


def consensus(energies: DataFrame, by: list[str]) -> DataFrame:
    """Letter of least energy in each group; ties: the smallest letter number."""
    return energies.groupBy(*by).agg(F.min(F.struct("e", "aa")).alias("m")).select(*by, F.col("m.aa").alias("aa"), F.col("m.e").alias("e"))


def condensed(self_e: DataFrame, pair_e: DataFrame, fixed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Self and pair tables with the fixed positions (rows pos, aa) folded into the self energies of the others."""
    f = fixed.select(F.col("pos").alias("__pos"), F.col("aa").alias("__aa"))
    at = fixed.select("pos")
    free_self = self_e.join(at, "pos", "left_anti").select("pos", "aa", "e")
    left = pair_e.join(f, (F.col("pos_j") == F.col("__pos")) & (F.col("aa_j") == F.col("__aa"))).select(F.col("pos_i").alias("pos"), F.col("aa_i").alias("aa"), "e")
    right = pair_e.join(f, (F.col("pos_i") == F.col("__pos")) & (F.col("aa_i") == F.col("__aa"))).select(F.col("pos_j").alias("pos"), F.col("aa_j").alias("aa"), "e")
    folded = left.unionAll(right).join(at, "pos", "left_anti")
    new_self = free_self.unionAll(folded).groupBy("pos", "aa").agg(F.sum("e").alias("e"))
    new_pair = pair_e.join(at.withColumnRenamed("pos", "pos_i"), "pos_i", "left_anti").join(at.withColumnRenamed("pos", "pos_j"), "pos_j", "left_anti").select("pos_i", "pos_j", "aa_i", "aa_j", "e")
    return new_self, new_pair


def binder_scores(bound: DataFrame, unbound: DataFrame, seq: DataFrame) -> DataFrame:
    """-log(p bound / p unbound) of each position's letter; tables (pos, aa, p), seq (pos, aa): pos, aa, score."""
    a, b = bound.select("pos", "aa", F.col("p").alias("pb")), unbound.select("pos", "aa", F.col("p").alias("pu"))
    return seq.select("pos", "aa").join(a, ["pos", "aa"]).join(b, ["pos", "aa"]).select("pos", "aa", (-F.log(F.col("pb") / F.col("pu"))).alias("score"))


def scatter_mean(edges: DataFrame, i: str = "i", j: str = "j", value: str = "value") -> DataFrame:
    """Mean of values that fall on one cell of a matrix."""
    return edges.groupBy(i, j).agg(F.avg(value).alias(value))


def transposed(block: DataFrame, a: str = "aa_i", b: str = "aa_j") -> DataFrame:
    """A block of pair energies with its letters swapped."""
    return block.withColumns({a: F.col(b), b: F.col(a)})


def pseudo_likelihood(self_e: DataFrame, pair_e: DataFrame, seq: DataFrame) -> DataFrame:
    """Mean of -log p of each position's letter given all others': nlpl, n; p by the softmax of -energy."""
    p = letter_probabilities(position_energies(self_e, pair_e, seq), ["pos"])
    native = p.join(seq.select("pos", "aa"), ["pos", "aa"])
    return native.agg(F.avg(-F.log("p")).alias("nlpl"), F.count(F.lit(1)).alias("n"))


def composite_likelihood(self_e: DataFrame, pair_e: DataFrame, seq: DataFrame) -> DataFrame:
    """Mean over edges (in both directions) of -log p of both letters given all others': nlcpl, n.

    The energy of letters a and b at an edge's ends is their self energies, their pair energy, and those of each with the
    letters of its other neighbours.
    """
    both = pair_e.filter("pos_i <> pos_j").select("pos_i", "pos_j", "aa_i", "aa_j", "e")
    both = both.unionAll(both.select("pos_j", "pos_i", "aa_j", "aa_i", "e"))
    given = both.join(seq.select(F.col("pos").alias("pos_j"), F.col("aa").alias("aa_j")), ["pos_j", "aa_j"])
    given = given.groupBy("pos_i", "aa_i", "pos_j").agg(F.sum("e").alias("e"))  # of a letter with one neighbour's
    alone = position_energies(self_e, pair_e, seq)
    at = lambda x, y: alone.select(F.col("pos").alias(f"pos_{x}"), F.col("aa").alias(f"aa_{x}"), F.col("e").alias(f"e_{x}"))
    less = lambda x, y: given.select(F.col("pos_i").alias(f"pos_{x}"), F.col("aa_i").alias(f"aa_{x}"), F.col("pos_j").alias(f"pos_{y}"), F.col("e").alias(f"less_{x}"))
    edges = both.join(at("i", "j"), ["pos_i", "aa_i"]).join(at("j", "i"), ["pos_j", "aa_j"])
    edges = edges.join(less("i", "j"), ["pos_i", "aa_i", "pos_j"], "left").join(less("j", "i"), ["pos_j", "aa_j", "pos_i"], "left")
    total = F.col("e") + F.col("e_i") + F.col("e_j") - F.coalesce("less_i", F.lit(0.0)) - F.coalesce("less_j", F.lit(0.0))
    p = letter_probabilities(edges.select("pos_i", "pos_j", "aa_i", "aa_j", total.alias("e")), ["pos_i", "pos_j"])
    native = p.join(seq.select(F.col("pos").alias("pos_i"), F.col("aa").alias("aa_i")), ["pos_i", "aa_i"]).join(seq.select(F.col("pos").alias("pos_j"), F.col("aa").alias("aa_j")), ["pos_j", "aa_j"])
    return native.agg(F.avg(-F.log("p")).alias("nlcpl"), F.count(F.lit(1)).alias("n"))


def total_difference(bound: DataFrame, unbound: DataFrame, by: list[str] = ()) -> DataFrame:
    """Energy of a complex less that of its target alone; tables (energy) of one row for each ``by``: by, energy."""
    a, b = bound.select(*by, F.col("energy").alias("__a")), unbound.select(*by, F.col("energy").alias("__b"))
    both = a.join(b, list(by)) if by else a.crossJoin(b)
    return both.select(*by, (F.col("__a") - F.col("__b")).alias("energy"))


def gathered(values: DataFrame, neighbours: DataFrame, by: list[str], value: str = "value") -> DataFrame:
    """Values at each row's neighbours: neighbours (by, pos, nth, at) with values (by, pos, value) of place ``at``."""
    there = values.select(*by, F.col("pos").alias("at"), F.col(value).alias(value))
    return neighbours.join(there, [*by, "at"], "left").select(*by, "pos", "nth", "at", value)


def norm_penalty(self_e: DataFrame, pair_e: DataFrame, lengths: DataFrame, by: list[str]) -> DataFrame:
    """Mean over structures of the sum of absolute energies for each residue: penalty, n (residues); lengths: by, length."""
    sums = self_e.select(*by, "e").unionAll(pair_e.select(*by, "e")).groupBy(*by).agg(F.sum(F.abs("e")).alias("__sum"))
    each = lengths.join(sums, list(by), "left")
    return each.agg(F.avg(F.coalesce("__sum", F.lit(0.0)) / F.col("length")).alias("penalty"), F.sum("length").cast("long").alias("n"))


def pair_self_ratio(self_e: DataFrame, pair_e: DataFrame) -> DataFrame:
    """Root mean square of the pair energies over that of the self energies, zeros left out: ratio."""
    size = lambda df, name: df.filter("e <> 0").agg(F.sqrt(F.avg(F.col("e") * F.col("e"))).alias(name))
    return size(pair_e, "__p").crossJoin(size(self_e, "__s")).select(F.try_divide("__p", "__s").alias("ratio"))


def correlation_loss(self_e: DataFrame, pair_e: DataFrame, seq: DataFrame, reference: DataFrame, binder: str = "binder") -> DataFrame:
    """-r of the energies of sequences (name, pos, aa, binder) with reference ones (name, energy), without those that lie
    inside the target alone: loss, n."""
    own = self_e.join(seq.filter(F.col(binder)).select("pos").distinct(), "pos", "left_semi")
    inside = seq.filter(~F.col(binder)).select("pos").distinct()
    i, j = inside.withColumnRenamed("pos", "pos_i"), inside.withColumnRenamed("pos", "pos_j")
    target = pair_e.join(i, "pos_i", "left_semi").join(j, "pos_j", "left_semi").select("pos_i", "pos_j").distinct()
    between = pair_e.join(target, ["pos_i", "pos_j"], "left_anti")
    both = sequence_energy(own, between, seq.select("name", "pos", "aa")).join(reference.select("name", F.col("energy").alias("__r")), "name")
    return both.agg((-F.corr("energy", "__r")).alias("loss"), F.count(F.lit(1)).alias("n"))


def structure_loss(scores: DataFrame, by: list[str], score: str, truth: str, mask: str) -> DataFrame:
    """Mean over structures of the mean squared difference over residues that the mask keeps: loss, n."""
    each = scores.filter(F.col(mask)).groupBy(*by).agg(F.avg((F.col(score) - F.col(truth)) * (F.col(score) - F.col(truth))).alias("__mse"), F.count(F.lit(1)).alias("__n"))
    return each.agg(F.avg("__mse").alias("loss"), F.sum("__n").alias("n"))
