"""Readers and writers of multi-record and fixed-width text."""

from __future__ import annotations

import gzip
import io

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from latticeq.functions.alphabet import normal_residue, residue_letter
from latticeq.operators.selection import first_per_key


def read_entries(spark: SparkSession, path: str) -> DataFrame:
    """Entries of multi-entry structure files (``HEADER    name`` to ``END``): name, body. ``FILEEND`` may be missing."""
    rows = spark.read.option("lineSep", "\nEND\n").text(path)
    name = F.regexp_extract("value", r"(?:^|\n)HEADER +(\S+)", 1)
    return rows.select(name.alias("name"), F.regexp_replace("value", r"\n?(END|FILEEND)\s*$", "").alias("body")).filter("name <> ''")


def entry_text(name: Column, body: Column) -> Column:
    """An entry as text, with its header line if the body lacks one."""
    return F.concat(F.when(body.startswith("HEADER"), body).otherwise(F.concat(F.lit("HEADER    "), name, F.lit("\n"), body)), F.lit("\nEND"))


def write_entries(entries: DataFrame, path: str, order: list[str], strict: bool = False) -> None:
    """Write entries as multi-entry files; of equal names the first in ``order`` stays (strict: an error)."""
    if strict and not entries.groupBy("name").count().filter("count > 1").isEmpty():
        raise ValueError("duplicate names")
    first_per_key(entries, ["name"], order).select(entry_text(F.col("name"), F.col("body")).alias("value")).write.text(path)


def copy_entries(entries: DataFrame, names: DataFrame, renames: dict[str, str] | None = None) -> DataFrame:
    """Listed entries, some under new names (also in their header line)."""
    out = entries.join(names.select("name").distinct(), "name", "left_semi")
    if renames:
        pairs = F.create_map(*(F.lit(x) for pair in renames.items() for x in pair))
        new = F.coalesce(F.try_element_at(pairs, F.col("name")), F.col("name"))
        out = out.select(new.alias("name"), F.regexp_replace("body", F.lit(r"(?m)^HEADER +\S+"), F.concat(F.lit("HEADER    "), new)).alias("body"))
    return out


def export_entries(entries: DataFrame, names: DataFrame, path: str) -> None:
    """Each listed entry in a folder of its own (``name=...``)."""
    chosen = copy_entries(entries, names)
    chosen.select("name", entry_text(F.col("name"), F.col("body")).alias("value")).write.partitionBy("name").text(path)


def read_files(spark: SparkSession, path: str, chains: list[str] | None = None) -> DataFrame:
    """Whole structure files as entries named by their file, with the atom lines of the given chains only."""
    rows = spark.read.text(path, wholetext=True).withColumn("file", F.input_file_name())
    name = F.regexp_replace(F.element_at(F.split("file", "/"), -1), r"\.pdb$", "")
    lines = F.filter(F.split("value", "\n"), lambda x: x.startswith("ATOM") | x.startswith("HETATM") | x.startswith("TER"))
    if chains:
        lines = F.filter(lines, lambda x: F.substring(x, 22, 1).isin(*chains))
    return rows.select(name.alias("name"), F.array_join(lines, "\n").alias("body"))


def parse_atoms(entries: DataFrame) -> DataFrame:
    """Fixed-width atom lines of entries: name, model, chain, resnum (with insertion code), resname, atom, altloc, x, y, z, bfac, line."""
    rows = entries.select("name", F.posexplode(F.split("body", "\n")).alias("line", "text"))
    # models count from 1 by the MODEL lines before
    model = F.sum(F.col("text").startswith("MODEL").cast("int")).over(Window.partitionBy("name").orderBy("line"))
    rows = rows.filter("text LIKE 'ATOM%' OR text LIKE 'HETATM%' OR text LIKE 'MODEL%'").withColumn("model", F.greatest(model, F.lit(1)))
    cut = lambda a, n: F.trim(F.substring("text", a, n))
    number = lambda a, n: F.expr(f"try_cast(trim(substring(text, {a}, {n})) AS double)")
    return rows.filter("text NOT LIKE 'MODEL%'").select(
        "name", F.col("model").cast("long").alias("model"), F.substring("text", 22, 1).alias("chain"), cut(23, 5).alias("resnum"), cut(18, 3).alias("resname"),
        cut(13, 4).alias("atom"), F.substring("text", 17, 1).alias("altloc"), number(31, 8).alias("x"), number(39, 8).alias("y"), number(47, 8).alias("z"), number(62, 5).alias("bfac"), F.col("line").cast("long").alias("line"),
    )


def clean_backbone(atoms: DataFrame, drop_chains: list[str] = ()) -> DataFrame:
    """N, CA, C and O of residues that have all four: the first alternate location stays, OXT serves for a missing O."""
    kept = atoms.filter(~F.col("chain").isin(*drop_chains)) if drop_chains else atoms
    key = ["name", "model", "chain", "resnum"]
    kept = first_per_key(kept, [*key, "atom"], ["line"])
    residue = Window.partitionBy(*key)
    has = lambda a: F.max((F.col("atom") == a).cast("int")).over(residue) == 1
    kept = kept.withColumns({"__o": has("O"), "__first": F.min("line").over(residue)})
    kept = kept.withColumn("atom", F.when((F.col("atom") == "OXT") & ~F.col("__o"), "O").otherwise(F.col("atom"))).filter(F.col("atom").isin("N", "CA", "C", "O"))
    kept = kept.withColumn("__n", F.count(F.lit(1)).over(residue)).filter("__n = 4")
    return kept.withColumn("resname", normal_residue(F.col("resname"))).drop("__o", "__n", "__first")


def residues(atoms: DataFrame) -> DataFrame:
    """One row a residue with its backbone points, letter and number in its chain (by first line)."""
    point = lambda a: F.first(F.when(F.col("atom") == a, F.struct("x", "y", "z")), ignorenulls=True).alias(a.lower())
    out = atoms.groupBy("name", "model", "chain", "resnum").agg(F.min("line").alias("line"), F.min_by("resname", "line").alias("resname"), *(point(a) for a in ("N", "CA", "C", "O")), F.avg("bfac").alias("bfac"))
    nth = F.row_number().over(Window.partitionBy("name", "model", "chain").orderBy("line")).cast("long")
    return out.select("name", "model", "chain", nth.alias("pos"), "resnum", "resname", residue_letter(F.col("resname")).alias("letter"), "n", "ca", "c", "o", "bfac")


def chain_sequences(res: DataFrame) -> DataFrame:
    """Sequence of each chain: name, model, chain, sequence."""
    ordered = F.array_sort(F.collect_list(F.struct("pos", "letter")))
    return res.groupBy("name", "model", "chain").agg(F.array_join(F.transform(ordered, lambda x: x.letter), "").alias("sequence"))


def collapse_ter(lines: DataFrame, by: str, order: str, text: str = "text") -> DataFrame:
    """Lines without a TER that follows another TER."""
    before = F.lag(text).over(Window.partitionBy(by).orderBy(order))
    return lines.withColumn("__before", before).filter(~(F.col(text).startswith("TER") & F.coalesce(F.col("__before").startswith("TER"), F.lit(False)))).drop("__before")


def remap_chains(res: DataFrame, keep: list[str], names: dict[str, str]) -> DataFrame:
    """Rows of some chains, renumbered from 1 across them and renamed; the map must be injective on them."""
    if len({names.get(c, c) for c in keep}) < len(set(keep)):
        raise ValueError("two chains would get one name")
    kept = res.filter(F.col("chain").isin(*keep))
    kept = kept.withColumn("resnum", F.row_number().over(Window.partitionBy("name", "model").orderBy("chain", "pos")).cast("string"))
    return kept.withColumn("chain", F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for p in names.items() for x in p)), F.col("chain")), F.col("chain"))) if names else kept


def thread_sequence(res: DataFrame, sequences: DataFrame) -> DataFrame:
    """Rows with letters replaced by those of ``sequences`` (name, chain, sequence) at their positions."""
    letters = sequences.select("name", "chain", F.posexplode(F.filter(F.split("sequence", ""), lambda c: c != "")).alias("__at", "__letter"))
    letters = letters.select("name", "chain", (F.col("__at") + 1).cast("long").alias("pos"), "__letter")
    return res.join(letters, ["name", "chain", "pos"], "left").withColumn("letter", F.coalesce("__letter", "letter")).drop("__letter")


def with_property(res: DataFrame, values: DataFrame, value: str, to: str = "bfac") -> DataFrame:
    """Rows with a per-residue property (chain, resnum, value) in column ``to``; null where there is none."""
    return res.drop(to).join(values.select("chain", "resnum", F.col(value).alias(to)), ["chain", "resnum"], "left")


def split_target(entries: DataFrame, suffix: str = "_target", fallback: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The target entry (its name ends so) and the others; where there is none, the entries of ``fallback``, another file."""
    mark = F.col("name").endswith(suffix)
    target = entries.filter(mark)
    if fallback is not None:
        there = target.agg((F.count(F.lit(1)) > 0).alias("__there"))  # one row
        target = target.unionByName(fallback.select(*entries.columns).crossJoin(F.broadcast(there)).filter("NOT __there").drop("__there"))
    return target, entries.filter(~mark)


def combine_files(spark: SparkSession, path: str, out: str, chains: list[str] | None = None) -> None:
    """Many single-structure files as one multi-entry file, in the order of their names, some chains only."""
    whole = spark.read.text(path, wholetext=True).withColumn("name", F.regexp_extract(F.input_file_name(), r"([^/]+?)(\.[^./]*)?$", 1))
    lines = F.filter(F.split("value", "\n"), lambda x: ~x.rlike(r"^(HEADER|END|FILEEND)") & (x != ""))
    if chains is not None:
        lines = F.filter(lines, lambda x: ~x.rlike("^(ATOM|HETATM)") | F.substring(x, 22, 1).isin(chains))
    rows = whole.select("name", entry_text(F.col("name"), F.array_join(lines, "\n")).alias("value"))
    rows.orderBy("name").select("value").coalesce(1).write.text(out)  # one file is what is asked for


def read_energy_table(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Text energy tables: self rows ``chain,res aa e`` and pair rows ``chain,res chain,res aa aa e``."""
    parts = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).select(parts.alias("p"))
    at = lambda i: F.element_at("p", i)
    own = rows.filter(F.size("p") == 3).select(at(1).alias("pos"), at(2).alias("aa"), at(3).cast("double").alias("e"))
    pair = rows.filter(F.size("p") == 5).select(at(1).alias("pos_i"), at(2).alias("pos_j"), at(3).alias("aa_i"), at(4).alias("aa_j"), at(5).cast("double").alias("e"))
    return own, pair


def write_energy_table(own: DataFrame, pair: DataFrame, path: str) -> None:
    line = lambda df: df.select(F.concat_ws(" ", *(F.col(c).cast("string") for c in df.columns)).alias("value"))
    line(own.select("pos", "aa", "e")).unionAll(line(pair.select("pos_i", "pos_j", "aa_i", "aa_j", "e"))).write.text(path)


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """Designed sequences: header fields, kind (native: 8 comma fields, design: 5), sequence."""
    rows = spark.read.option("lineSep", ">").text(path).filter(F.trim("value") != "")
    header = F.substring_index("value", "\n", 1)
    body = F.regexp_replace(F.substr("value", F.length(header) + 2), r"\s", "")
    fields = F.transform(F.split(header, ","), lambda x: F.trim(x))
    kind = F.when(F.size(fields) == 8, "native").when(F.size(fields) == 5, "design").otherwise("other")
    return rows.select(fields.alias("fields"), kind.alias("kind"), body.alias("sequence"))


def read_fastq(spark: SparkSession, path: str) -> DataFrame:
    """Reads of (gzipped) FASTQ files: id (before ``/``), seq, qual as numbers. One task a file: gzip can't be split."""

    def run(batches):
        for pdf in batches:
            for content in pdf["content"]:
                raw = gzip.GzipFile(fileobj=io.BytesIO(content)) if content[:2] == b"\x1f\x8b" else io.BytesIO(content)
                ids, seqs, quals = [], [], []
                lines = (x.rstrip(b"\r\n").decode("ascii", "replace") for x in raw)
                for head in lines:
                    if not head:
                        continue
                    seq, _, qual = next(lines, ""), next(lines, ""), next(lines, "")
                    ids.append(head[1:].partition("/")[0])
                    seqs.append(seq)
                    quals.append(qual)
                    if len(ids) == 20_000:
                        yield pd.DataFrame({"id": ids, "seq": seqs, "qual": quals})
                        ids, seqs, quals = [], [], []
                yield pd.DataFrame({"id": ids, "seq": seqs, "qual": quals})

    rows = spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, "id string, seq string, qual string")
    numbers = F.transform(F.filter(F.split("qual", ""), lambda c: c != ""), lambda c: F.ascii(c) - 33)
    return rows.select("id", "seq", numbers.alias("qual"))


def good_reads(reads: DataFrame, least: int = 30) -> DataFrame:
    """Reads of which every base has at least this quality."""
    return reads.filter(F.forall("qual", lambda q: q >= least))


def read_term_records(spark: SparkSession, path: str) -> DataFrame:
    """Blank-line separated records of ``key value...`` lines in whole files: file, record, key, values."""
    rows = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.posexplode(F.split("value", r"\n\s*\n")).alias("record", "block"))
    lines = rows.select("file", F.col("record").cast("long").alias("record"), F.explode(F.split(F.trim("block"), "\n")).alias("line")).filter(F.trim("line") != "")
    words = F.split(F.trim("line"), r"\s+")
    return lines.select("file", "record", F.element_at(words, 1).alias("key"), F.slice(words, 2, F.size(words)).alias("values"))


def read_densities(spark: SparkSession, path: str) -> DataFrame:
    """Histograms in JSON (``histList``), a row for each cell: cont_type, aa, bins and ranges of both axes, i, j, n."""
    cell = "struct<contType:string,AA3:string,nBins:array<int>,var1Range:array<double>,var2Range:array<double>,countsArray:array<array<long>>>"
    rows = spark.read.text(path, wholetext=True).select(F.from_json("value", f"struct<histList:array<{cell}>>").histList.alias("list"), F.from_json("value", f"array<{cell}>").alias("bare"))
    rows = rows.select(F.explode(F.coalesce("list", "bare")).alias("h"))
    axes = [F.col("h.nBins")[k].alias(f"bins{k + 1}") for k in range(2)] + [F.col(f"h.var{k}Range")[i].alias(f"{n}{k}") for k in (1, 2) for i, n in enumerate(("low", "high"))]
    cells = rows.select(F.col("h.contType").alias("cont_type"), F.col("h.AA3").alias("aa"), *axes, F.posexplode("h.countsArray").alias("i", "row"))
    return cells.select(*(c for c in cells.columns if c not in ("i", "row")), F.col("i").cast("long").alias("i"), F.posexplode("row").alias("j", "n")).withColumn("j", F.col("j").cast("long"))


TOPOLOGY = "map<string, map<string, struct<topologyPosition:int, nterm_trim:int, cterm_trim:int, aaSeq:string, isSeed:boolean>>>"


def read_topologies(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Fragments of topologies from JSON files; a topology in a later file replaces the earlier: topology, fragment, fields."""
    parts = None
    for i, path in enumerate(paths):
        rows = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", TOPOLOGY)).alias("topology", "fragments")).withColumn("load", F.lit(i))
        parts = rows if parts is None else parts.unionAll(rows)
    latest = parts.groupBy("topology").agg(F.max("load").alias("load"))
    return parts.join(latest, ["topology", "load"]).select("topology", F.explode("fragments").alias("fragment", "f")).select("topology", "fragment", "f.*")


def write_topologies(fragments: DataFrame, path: str) -> None:
    """Fragments as JSON, one object of topologies in each file; columns as ``read_topologies`` gives them."""
    fields = F.struct("topologyPosition", "nterm_trim", "cterm_trim", "aaSeq", "isSeed")
    each = fragments.groupBy("topology").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("fragment"), fields.alias("f"))), lambda a, b: F.when(a.fragment < b.fragment, -1).when(a.fragment > b.fragment, 1).otherwise(0))).alias("fragments"))
    each.select(F.to_json(F.create_map("topology", "fragments")).alias("value")).write.option("maxRecordsPerFile", 1).text(path)


# fixed values: columns of the tables that the programs exchange as CSV (header names in some differ from their order)
RELATIONS = {
    "fragments": "fragName string, chainID string, resNum int, numMatches int, numSeeds int",
    "seeds": "seedName string, numRes int, target_idx int, target_name string, match_res_chain_id string, match_res_num int, seed_res_chain_id string, seed_res_num int",
    "peptide_rmsd": "seedName string, rmsd double, peptideChainID string, peptideResIdx int, seedResIdx int, length int",
    "binder_scores": "name string, score_mode string, N_target_res int, N_peptide_res int, seqstruct_score double, struct_score double",
    "peptide_sequences": "name string, nat_seq string, consensus_seq string, seq_id double",
    "letter_probabilities": "name string, pep_res_idx int, chain_id string, resnum int, aa_prob double, aa string",
}


def read_table(spark: SparkSession, path: str, schema: str, header: bool = True) -> DataFrame:
    """A CSV table with a schema, or the name of one of ``RELATIONS``; columns go by position, whatever the header says."""
    return spark.read.schema(RELATIONS.get(schema, schema)).option("header", header).option("enforceSchema", True).csv(path)


def write_table(df: DataFrame, path: str, header: bool = True) -> None:
    df.write.option("header", header).csv(path)


def read_radii(spark: SparkSession, path: str) -> DataFrame:
    """Radius table: ``RESIDUE ATOM ALA 5`` lines carried on to their ``ATOM CA 1.87 1`` lines. One file, read whole."""
    rows = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\n")).alias("n", "line"))
    name = F.nullif(F.regexp_extract("line", r"^RESIDUE\s+\S+\s+(\S+)", 1), F.lit(""))
    carried = F.last(name, ignorenulls=True).over(Window.orderBy("n").rowsBetween(Window.unboundedPreceding, 0))
    atom, radius = (F.regexp_extract("line", r"^ATOM\s+(\S+)\s+([0-9.]+)", i) for i in (1, 2))
    return rows.select(carried.alias("resname"), atom.alias("atom"), radius.alias("r")).filter("r <> ''").select("resname", "atom", F.col("r").cast("double").alias("radius"))


def read_result_logs(spark: SparkSession, path: str, fields: dict[str, str]) -> DataFrame:
    """One row a log file with the first match of each field's expression (null if it has none)."""
    rows = spark.read.text(path, wholetext=True).withColumn("file", F.input_file_name())
    return rows.select("file", *(F.nullif(F.regexp_extract("value", pattern, 1), F.lit("")).alias(name) for name, pattern in fields.items()))


def read_model_scores(spark: SparkSession, path: str) -> DataFrame:
    """Ranking files of structure predictions: run (folder), model and score of the top-ranked model."""
    rows = spark.read.text(path, wholetext=True).withColumn("run", F.element_at(F.split(F.input_file_name(), "/"), -2))
    scores = F.explode(F.from_json(F.get_json_object("value", "$['iptm+ptm']"), "map<string,double>"))
    return rows.select("run", scores.alias("model", "score")).groupBy("run").agg(F.max(F.struct("score", "model")).alias("m")).select("run", "m.model", "m.score")


def first_chain_mean(values: Column, length: Column) -> Column:
    """Mean of per-residue values over the first chain, of so many residues."""
    first = F.slice(values, F.lit(1), length.cast("int"))
    return F.try_divide(F.aggregate(first, F.lit(0.0), lambda t, v: t + v), F.size(first))


def merge_databases(parts: list[DataFrame]) -> DataFrame:
    """Structure, frame or residue-pair tables as one; columns are matched by name."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
