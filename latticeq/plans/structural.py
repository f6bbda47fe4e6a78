"""Queries of sequences, texts, chains, geometry, energy tables and grouped algorithms, with SQL where it can say it."""

from __future__ import annotations

from pyspark.sql import functions as F

from latticeq.functions import geometry as g
from latticeq.functions import sequences as s
from latticeq.operators import chains, energy, grouped
from latticeq.plans.tables import BASES, ENERGIES, POINTS, RESIDUES, SEQUENCES, bases, energies, points, residues, sequences, structures, table

QUERIES: dict = {}
SQL: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_STIRLING = "(0.5::DOUBLE * ln(2 * pi() * {n}) + {n} * ln({n} / exp(1.0::DOUBLE)))"


@query(f"""WITH {SEQUENCES}, c AS (SELECT chain, letter, count(*) AS n FROM r GROUP BY ALL),
t AS (SELECT chain, sum(n) AS total, sum({_STIRLING.format(n="CAST(n AS DOUBLE)")}) AS parts FROM c GROUP BY chain)
SELECT chain, round(({_STIRLING.format(n="CAST(total AS DOUBLE)")} - parts) / total, 6) AS complexity FROM t""")
def seq_complexity(spark, d):
    return sequences(spark, d).select("chain", F.round(s.complexity(F.col("s")), 6).alias("complexity"))


_WINDOWS = f"{RESIDUES}, w AS (SELECT chain, pos, string_agg(letter, '') OVER (PARTITION BY chain ORDER BY pos ROWS BETWEEN CURRENT ROW AND 6 FOLLOWING) AS s, count(*) OVER (PARTITION BY chain ORDER BY pos ROWS BETWEEN CURRENT ROW AND 6 FOLLOWING) AS n FROM r), v AS (SELECT chain, pos, s, lead(s, 7) OVER (PARTITION BY chain ORDER BY pos) AS t FROM w WHERE n = 7)"
_DIFFERENT = "list_sum(list_transform(range(1, 8), lambda i: CASE WHEN substr(s, i, 1) <> substr(t, i, 1) THEN 1 ELSE 0 END))"


def _window_pairs(spark, d):
    rows = chains.segments(residues(spark, d), "chain", ["pos"], "letter", 7).withColumn("s", F.array_join("segment", ""))
    from pyspark.sql import Window

    return rows.withColumn("t", F.lead("s", 7).over(Window.partitionBy("chain").orderBy("pos"))).filter("t IS NOT NULL")


@query(f"WITH {_WINDOWS} SELECT chain, pos, CAST({_DIFFERENT} AS BIGINT) AS different FROM v WHERE t IS NOT NULL")
def hamming(spark, d):
    """Places at which a window of seven letters differs from the next one."""
    return _window_pairs(spark, d).select("chain", "pos", s.hamming(F.col("s"), F.col("t")).alias("different"))


@query(f"WITH {_WINDOWS} SELECT chain, pos, round(100.0::DOUBLE * (7 - {_DIFFERENT}) / 7, 6) AS seq_id FROM v WHERE t IS NOT NULL")
def seq_identity(spark, d):
    return _window_pairs(spark, d).select("chain", "pos", F.round(s.identity_percent(F.col("s"), F.col("t")), 6).alias("seq_id"))


@query(f"WITH {BASES} SELECT doc_id, reverse(translate(s, 'ACGTacgt', 'TGCAtgca')) AS s FROM b")
def reverse_complement(spark, d):
    return bases(spark, d).select("doc_id", s.reverse_complement(F.col("s")).alias("s"))


def _codon_sql() -> str:
    from latticeq.functions.alphabet import CODONS

    # one codon is left out, so that translation stops at it
    pairs = {k: v for k, v in CODONS.items() if k != "GGG"}
    return f"MAP {{{', '.join(f"'{k}': '{v}'" for k, v in pairs.items())}}}"


@query(f"""WITH {BASES}, t AS (SELECT doc_id, array_to_string(list_transform(range(1, length(s) - 1, 3), lambda i: coalesce(({_codon_sql()})[substr(s, i, 3)], '?')), '') AS a FROM b)
SELECT doc_id, split_part(a, '?', 1) AS protein FROM t""")
def translate_codons(spark, d):
    from latticeq.functions.alphabet import CODONS

    return bases(spark, d).select("doc_id", s.translate_codons(F.col("s"), {k: v for k, v in CODONS.items() if k != "GGG"}).alias("protein"))


@query("SELECT doc_id, substr(split_part(replace(coalesce(text, ''), 'x', '*'), '*', 1), 2) AS kept FROM documents")
def trim_stop(spark, d):
    text = F.replace(F.coalesce("text", F.lit("")), F.lit("x"), F.lit("*"))
    return table(spark, d, "documents").select("doc_id", s.trim_stop(text).alias("kept"))


@query(f"WITH {BASES} SELECT doc_id, substr(s, strpos(s, 'ACGT') + 4) AS rest FROM b WHERE strpos(s, 'ACGT') > 0")
def primer_slice(spark, d):
    rest = s.after_primer(F.col("s"), "ACGT")
    return bases(spark, d).select("doc_id", rest.alias("rest")).filter("rest IS NOT NULL")


@query("SELECT page_id, regexp_replace(html, '<[^<]+?>', '', 'g') AS text FROM pages")
def strip_tags(spark, d):
    return table(spark, d, "pages").select("page_id", s.strip_tags(F.col("html")).alias("text"))


@query(r"""SELECT page_id, regexp_extract(url, '^(https?)://', 1) AS scheme, len(string_split(split_part(url, '://', 2), '/')) AS n_parts,
CASE WHEN len(string_split(split_part(url, '://', 2), '/')) = 3 THEN 'native' ELSE 'other' END AS kind, regexp_extract(url, '/([0-9]+)', 1) AS number FROM pages""")
def regex_parse_records(spark, d):
    parts = F.size(F.split(F.split_part("url", F.lit("://"), F.lit(2)), "/"))
    return table(spark, d, "pages").select(
        "page_id", F.regexp_extract("url", "^(https?)://", 1).alias("scheme"), parts.cast("long").alias("n_parts"),
        F.when(parts == 3, "native").otherwise("other").alias("kind"), F.regexp_extract("url", "/([0-9]+)", 1).alias("number"),
    )


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_fields(spark, d):
    return table(spark, d, "events").select("event_id", F.from_json("props", "k long").k.alias("k"))


@query(f"WITH {RESIDUES} SELECT chain, pos, string_agg(letter, '') OVER (PARTITION BY chain ORDER BY pos ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS flank FROM r")
def flank_window(spark, d):
    return chains.flanks(residues(spark, d), "chain", ["pos"], "letter", 2).select("chain", "pos", F.array_join("flank", "").alias("flank"))


@query(f"WITH {RESIDUES}, w AS (SELECT chain, pos, string_agg(letter, '') OVER z AS segment, count(*) OVER z AS n FROM r WINDOW z AS (PARTITION BY chain ORDER BY pos ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING)) SELECT chain, pos, segment FROM w WHERE n = 5")
def sliding_segments(spark, d):
    return chains.segments(residues(spark, d), "chain", ["pos"], "letter", 5).select("chain", "pos", F.array_join("segment", "").alias("segment"))


@query(f"WITH {RESIDUES} SELECT chain, pos, CASE WHEN abs(value - lag(value) OVER z) < 20 THEN lag(letter) OVER z END AS previous FROM r WINDOW z AS (PARTITION BY chain ORDER BY pos)")
def lag_bonded(spark, d):
    from pyspark.sql import Window

    gap = F.abs(F.col("value") - F.lag("value").over(Window.partitionBy("chain").orderBy("pos")))
    return chains.bonded_previous(residues(spark, d), "chain", ["pos"], gap, 20.0, "letter").select("chain", "pos", "previous")


@query("""WITH l AS (SELECT o_custkey, o_orderkey, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL)
SELECT o_custkey, o_orderkey, n, CAST(coalesce(sum(n) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset" FROM l""")
def running_renumber(spark, d):
    l = table(spark, d, "lineitem").select("l_orderkey").join(table(spark, d, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    return chains.renumbered(l.groupBy("o_custkey", "o_orderkey").agg(F.count(F.lit(1)).alias("n")), "o_custkey", ["o_orderkey"], "n")


@query(f"""WITH {RESIDUES}, n AS (SELECT chain, pos, CASE WHEN event_id - lag(event_id) OVER (PARTITION BY chain ORDER BY event_id) > 50 THEN 1 ELSE 0 END AS new, event_id FROM r),
g AS (SELECT chain, event_id, CAST(sum(new) OVER (PARTITION BY chain ORDER BY event_id) AS BIGINT) AS run FROM n)
SELECT chain, event_id, run, CAST(row_number() OVER (PARTITION BY chain, run ORDER BY event_id) - 1 - count(*) OVER (PARTITION BY chain, run) // 2 AS BIGINT) AS "index" FROM g""")
def gap_split(spark, d):
    return chains.gap_groups(residues(spark, d), "chain", ["event_id"], "event_id", 50).select("chain", "event_id", "run", "index")


@query(f"""WITH {RESIDUES}, v AS (SELECT chain, pos, lead(value, 4) OVER z - value AS step FROM r WINDOW z AS (PARTITION BY chain ORDER BY pos))
SELECT chain, round(avg(step), 6) AS step, count(*) AS n FROM v WHERE step IS NOT NULL GROUP BY chain""")
def moving_orientation(spark, d):
    out = chains.moving_orientation(residues(spark, d), "chain", ["pos"], ["value"], 4)
    return out.select("chain", F.round("value", 6).alias("step"), "n")


@query(f"""WITH {RESIDUES}, w AS (SELECT chain, pos, list(value) OVER (PARTITION BY chain ORDER BY pos ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) AS v FROM r), u AS (SELECT * FROM w WHERE len(v) = 3),
m AS (SELECT x.chain AS a, y.chain AS b, x.pos AS i, y.pos AS j, sqrt(((x.v[1]-y.v[1])*(x.v[1]-y.v[1]) + (x.v[2]-y.v[2])*(x.v[2]-y.v[2]) + (x.v[3]-y.v[3])*(x.v[3]-y.v[3])) / 3) AS rmsd FROM u x JOIN u y ON x.chain <> y.chain WHERE x.chain % 100 = 0)
SELECT a, b, i, j, round(rmsd, 6) AS rmsd FROM m QUALIFY row_number() OVER (PARTITION BY a, b ORDER BY rmsd, i, j) = 1""")
def best_window_alignment(spark, d):
    """Best windows of each query chain (numbers divisible by 100) with every other."""
    w = chains.segments(residues(spark, d), "chain", ["pos"], "value", 3)
    out = chains.best_window(w.filter("chain % 100 = 0"), w, "chain", "pos", "segment", 3)
    return out.select("a", "b", "i", "j", F.round("rmsd", 6).alias("rmsd"))


@query("""WITH l AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS nth, CAST(l_quantity AS BIGINT) AS n FROM lineitem),
p AS (SELECT l_orderkey, nth, n, CAST(coalesce(sum(n - 3) OVER (PARTITION BY l_orderkey ORDER BY nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM l)
SELECT l_orderkey, nth, start, start + n AS "end", nth = 1 OR n > 3 AS valid FROM p""")
def topology_positions(spark, d):
    rows = chains.numbered(table(spark, d, "lineitem"), "l_orderkey", ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity"], "nth").select("l_orderkey", "nth", F.col("l_quantity").cast("long").alias("n"))
    return chains.topology_positions(rows, "l_orderkey", ["nth"], "n").select("l_orderkey", "nth", "start", "end", "valid")


# geometry over points in a chain of their identifiers


@query(f"""WITH {POINTS}, t AS (SELECT a.vec_id, b.x-a.x AS ux, b.y-a.y AS uy, b.z-a.z AS uz, c.x-b.x AS vx, c.y-b.y AS vy, c.z-b.z AS vz FROM p a JOIN p b ON b.vec_id = a.vec_id + 1 JOIN p c ON c.vec_id = a.vec_id + 2)
SELECT vec_id, round(sqrt(ux*ux+uy*uy+uz*uz), 6) AS length, round((ux*vx+uy*vy+uz*vz) / (sqrt(ux*ux+uy*uy+uz*uz) * sqrt(vx*vx+vy*vy+vz*vz)), 6) AS cosine, round(uy*vz-uz*vy, 6) AS cx, round(uz*vx-ux*vz, 6) AS cy, round(ux*vy-uy*vx, 6) AS cz FROM t""")
def vector_geometry(spark, d):
    """Bond length, cosine and cross product of successive points."""
    p = points(spark, d).select("vec_id", g.vec(F.col("x"), F.col("y"), F.col("z")).alias("p"))
    a, b, c = (p.select((F.col("vec_id") - k).alias("vec_id"), F.col("p").alias(n)) for k, n in enumerate("abc"))
    t = a.join(b, "vec_id").join(c, "vec_id")
    u, v = g.sub(F.col("b"), F.col("a")), g.sub(F.col("c"), F.col("b"))
    t = t.select("vec_id", u.alias("u"), v.alias("v"), g.cross(u, v).alias("w"))
    return t.select("vec_id", F.round(g.norm(F.col("u")), 6).alias("length"), F.round(g.cosine(F.col("u"), F.col("v")), 6).alias("cosine"), *(F.round(F.col("w")[k], 6).alias(f"c{k}") for k in "xyz"))


@query(f"""WITH {POINTS}, t AS (SELECT a.vec_id, a.x AS px, a.y AS py, a.z AS pz, b.x AS ax, b.y AS ay, b.z AS az, c.x-b.x AS dx, c.y-b.y AS dy, c.z-b.z AS dz FROM p a JOIN p b ON b.vec_id = a.vec_id + 1 JOIN p c ON c.vec_id = a.vec_id + 2),
s AS (SELECT *, ((px-ax)*dx + (py-ay)*dy + (pz-az)*dz) / (dx*dx+dy*dy+dz*dz) AS t FROM t)
SELECT vec_id, CASE WHEN t BETWEEN 0 AND 1 THEN round(sqrt((px-ax-t*dx)*(px-ax-t*dx) + (py-ay-t*dy)*(py-ay-t*dy) + (pz-az-t*dz)*(pz-az-t*dz)), 6) END AS distance FROM s""")
def segment_distance(spark, d):
    p = points(spark, d).select("vec_id", g.vec(F.col("x"), F.col("y"), F.col("z")).alias("p"))
    a, b, c = (p.select((F.col("vec_id") - k).alias("vec_id"), F.col("p").alias(n)) for k, n in enumerate("abc"))
    t = a.join(b, "vec_id").join(c, "vec_id")
    return t.select("vec_id", F.round(g.segment_distance(F.col("a"), F.col("b"), F.col("c")), 6).alias("distance"))


# energy tables


@query(f"""WITH {ENERGIES} SELECT round((SELECT sum(e) FROM self_e JOIN seq USING (pos, aa)) + (SELECT sum(e) FROM pair_e JOIN seq i ON pos_i = i.pos AND aa_i = i.aa JOIN seq j ON pos_j = j.pos AND aa_j = j.aa), 6) AS energy""")
def energy_of_sequence(spark, d):
    own, pair, seq = energies(spark, d)
    return energy.sequence_energy(own, pair, seq.withColumn("name", F.lit("native"))).select(F.round("energy", 6).alias("energy"))


_POSITION = "pe AS (SELECT pos, aa, sum(e) AS e FROM (SELECT pos, aa, {own} AS e FROM self_e UNION ALL SELECT pos_i, aa_i, e FROM both_e JOIN seq j ON pos_j = j.pos AND aa_j = j.aa JOIN seq i ON pos_i = i.pos WHERE {keep}) GROUP BY pos, aa)"
_ALL = _POSITION.format(own="e", keep="true")


@query(f"WITH {ENERGIES}, {_ALL} SELECT pe.pos, pe.aa, round(pe.e - o.e, 6) AS delta FROM pe JOIN seq ON seq.pos = pe.pos JOIN pe o ON o.pos = seq.pos AND o.aa = seq.aa")
def mutation_delta(spark, d):
    return energy.mutation_deltas(*energies(spark, d)).select("pos", "aa", F.round("delta", 6).alias("delta"))


@query(f"WITH {ENERGIES}, {_ALL} SELECT pos, aa, round(exp(-e) / sum(exp(-e)) OVER (PARTITION BY pos), 6) AS p FROM pe")
def softmax_probs(spark, d):
    out = energy.letter_probabilities(energy.position_energies(*energies(spark, d)), ["pos"])
    return out.select("pos", "aa", F.round("p", 6).alias("p"))


def _mode(name: str, own: str, keep: str):
    def run(spark, d):
        return energy.position_energies(*energies(spark, d), mode=name, binder="binder").select("pos", "aa", F.round("e", 6).alias("e"))

    run.__name__ = f"{name}_score"
    return query(f"WITH {ENERGIES}, {_POSITION.format(own=own, keep=keep)} SELECT pos, aa, round(e, 6) AS e FROM pe")(run)


_mode("interface_only", "0.0::DOUBLE", "i.binder <> j.binder")
_mode("omit_peptide", "e", "NOT (i.binder AND j.binder)")
_mode("omit_target", "e", "i.binder = j.binder")


@query(f"""WITH {ENERGIES}, {_ALL}, pu AS (SELECT pos, aa, exp(-e) / sum(exp(-e)) OVER (PARTITION BY pos) AS p FROM (SELECT pos, aa, e FROM self_e)), pb AS (SELECT pos, aa, exp(-e) / sum(exp(-e)) OVER (PARTITION BY pos) AS p FROM pe)
SELECT pos, aa, round(-ln(pb.p / pu.p), 6) AS score FROM seq JOIN pb USING (pos, aa) JOIN pu USING (pos, aa)""")
def binder_score(spark, d):
    own, pair, seq = energies(spark, d)
    bound = energy.letter_probabilities(energy.position_energies(own, pair, seq), ["pos"])
    return energy.binder_scores(bound, energy.letter_probabilities(own, ["pos"]), seq).select("pos", "aa", F.round("score", 6).alias("score"))


@query(f"""WITH {ENERGIES}, dup AS (SELECT * FROM pair_e UNION ALL SELECT pos_j, pos_i, aa_j, aa_i, e + 0.5::DOUBLE FROM pair_e)
SELECT pos_i, pos_j, aa_i, aa_j, round(e + 0.25::DOUBLE, 6) AS e FROM pair_e""")
def edge_merge_mean(spark, d):
    _, pair, _ = energies(spark, d)
    twin = pair.select(F.col("pos_j").alias("pos_i"), F.col("pos_i").alias("pos_j"), F.col("aa_j").alias("aa_i"), F.col("aa_i").alias("aa_j"), (F.col("e") + 0.5).alias("e"))
    return energy.canonical_pairs(pair.unionAll(twin)).withColumn("e", F.round("e", 6))


@query(f"""WITH {ENERGIES} SELECT pos, aa, round(sum(e), 6) AS e FROM (SELECT pos, aa, e FROM self_e WHERE pos < 20 UNION ALL
SELECT pos_i, aa_i, e FROM both_e JOIN seq j ON pos_j = j.pos AND aa_j = j.aa WHERE pos_i < 20 AND pos_j >= 20) GROUP BY pos, aa""")
def energy_condense(spark, d):
    own, pair, seq = energies(spark, d)
    return energy.condensed(own, pair, seq.filter("pos >= 20"))[0].withColumn("e", F.round("e", 6))


@query("SELECT l_suppkey % 10 AS i, l_partkey % 10 AS j, round(avg(l_discount), 6) AS value FROM lineitem GROUP BY ALL")
def scatter_mean(spark, d):
    rows = table(spark, d, "lineitem").select((F.col("l_suppkey") % 10).alias("i"), (F.col("l_partkey") % 10).alias("j"), F.col("l_discount").alias("value"))
    return energy.scatter_mean(rows).withColumn("value", F.round("value", 6))


# grouped algorithms: rows only; tests hold them against plain Python


def _flat(spark, d):
    return table(spark, d, "embeddings").select("vec_id", F.col("label").cast("long").alias("label"), F.slice("embedding", 1, 63).cast("array<double>").alias("v"))


@query()
def kabsch_rmsd(spark, d):
    """Superposed RMSD of each vector, as points, with the first of its label."""
    rows = _flat(spark, d)
    heads = rows.groupBy("label").agg(F.min_by("v", "vec_id").alias("head"))
    out = rows.join(F.broadcast(heads), "label").select("vec_id", grouped.kabsch("v", "head").alias("superposed"), grouped.plain_rmsd(F.col("v"), F.col("head")).alias("plain"))
    return out.select("vec_id", F.round("superposed", 5).alias("superposed"), F.round("plain", 5).alias("plain"))


@query()
def cluster_greedy(spark, d):
    return grouped.greedy_clusters(_flat(spark, d), "label", "vec_id", "v", 0.22, coverage=0.9)


@query()
def select_distinct_greedy(spark, d):
    w = chains.segments(residues(spark, d), "chain", ["pos"], "letter", 7).select("chain", "pos", F.array_join("segment", "").alias("s"))
    return grouped.greedy_distinct(w, "chain", "s", "pos", 5, 10)


@query()
def complete_linkage(spark, d):
    """Clusters of all suppliers by their parts."""
    from latticeq.operators.counting import similar_sets

    # clusters depend on no pair farther apart than the cut
    pairs = similar_sets(table(spark, d, "lineitem"), "l_suppkey", "l_partkey", 1 - 0.75).select("a", "b", "jaccard")
    # each with itself, so that those who share no part with another are there
    k = F.col("s_suppkey")
    pairs = pairs.unionAll(table(spark, d, "supplier").select(k.alias("a"), k.alias("b"), F.lit(1.0).alias("jaccard")))
    return grouped.linkage_clusters(pairs, 0.75)


@query()
def segment_overlap_graph(spark, d):
    """Edges from each query vector (identifiers divisible by 100) to all vectors."""
    rows = _flat(spark, d)
    return grouped.overlap_edges(rows.filter("vec_id % 100 = 0"), "vec_id", "v", 2, 0.08, rows)


@query()
def anneal_sequences(spark, d):
    out = grouped.anneal(structures(spark, d), "sid", cycles=3, steps=2000)
    return out.select("sid", "cycle", "best_seq", F.round("best_seq_e", 6).alias("best_seq_e"))


@query()
def exact_small(spark, d):
    return grouped.exact(structures(spark, d), "sid", count=3, differ=2).withColumn("e", F.round("e", 6))
